"""Near duplicates by a signature-coordinate inverted join.

Every text is the set of its distinct word shingles. Texts with equal sets are one class, and classes are what is joined:

1. A class has a MinHash signature of ``coordinates`` values, each made of ``minima`` minima. Two sets of similarity s agree in a
   coordinate with probability s ** minima, so that texts which share no more than a common passage hardly ever do.
2. It is posted under each (coordinate, value) pair of its prefix. A link needs ``matches`` equal coordinates, so two linked classes
   share a list among the ``coordinates - matches + 1`` first of each. Lists of one class are dropped by an exact count.
3. The members of a list meet in cells of at most ``block`` rows a side. In a cell collisions of whole signatures are counted; a pair
   is skipped in all lists but that of its first common coordinate, so that it is merged once. Those above the match threshold are
   compared by their sketches: 16 bits of each shingle, of large sets a sample that both sides draw alike. A sketch of a whole set
   counts at least the true intersection, so it loses no link. Nothing of a pair that fails leaves the task.
4. The first round takes the lists of the ``first`` coordinates and gives of each cell a spanning forest, not its pairs. These are
   confirmed on full sets and joined to components. The second round takes all lists whose members are in different components:
   those outside of the list's main component are held against all members, in a grid of cells, and every pair of different
   components that passes is confirmed. Copies of one text are in one component by then and give no rows.

With the values given here a link of similarity 0.8 agrees in fewer than 2 of 17 coordinates with a probability of 9e-7. Sketches of sets
over ``sketch`` shingles are samples; a link is lost if its sample is off by ``margin`` standard deviations (3e-7). Nothing else can be lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import textvec as V
from cuelake.llm.columns import read_table
from cuelake.llm.components import components
from cuelake.llm.scratch import Scratch


@dataclass(frozen=True)
class Settings:
    """``percent``: the least similarity, 100 * intersection >= percent * union. ``block``: rows of one side of a cell."""

    words: int = 5
    percent: int = 80
    coordinates: int = 17
    minima: int = 2
    matches: int = 2
    first: int = 4
    sketch: int = 512
    margin: float = 5.0
    block: int = 512
    seed: int = 7

    @property
    def prefix(self) -> int:
        return self.coordinates - self.matches + 1


#: Most rows of classes that are broadcast to pick their texts; more are joined by a shuffle.
MOST_BROADCAST = 1 << 18
#: Levels of a sketch: of level k is one shingle in 2 ** k.
LEVELS = 16
#: Lists up to so many rows are paired all at once.
SMALL = 48


class _Signer:
    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        shape = (s.minima * s.coordinates, 1)
        self.settings = s
        self.xor = rng.integers(0, 1 << 63, shape, dtype=np.uint64)
        self.mul = rng.integers(0, 1 << 63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, x: np.ndarray) -> np.ndarray:
        """A key for each coordinate, which it is mixed into. Large sets go in blocks."""
        low = np.full(len(self.xor), np.uint64((1 << 64) - 1))
        for a in range(0, len(x), 2048):
            low = np.minimum(low, ((x[a : a + 2048] ^ self.xor) * self.mul).min(axis=1))
        out = np.arange(1, self.settings.coordinates + 1, dtype=np.uint64)
        for part in low.reshape(self.settings.minima, -1):
            out = V.mix(out + V.mix(part))
        return out.astype(np.int64)

    def sketch(self, x: np.ndarray) -> bytes:
        """Level, numbers of shingles of each level and above, then 16 bits of each shingle of the level, higher levels first."""
        z = V.mix(x)
        high = (z >> np.uint64(16)) | np.uint64(1 << (LEVELS - 1))
        level = np.bitwise_count((high & (~high + np.uint64(1))) - np.uint64(1))
        counts = np.cumsum(np.bincount(level, minlength=LEVELS)[::-1])[::-1]
        own = int(np.argmax(counts <= self.settings.sketch)) if counts[-1] <= self.settings.sketch else LEVELS - 1
        values = (z & np.uint64(0xFFFF)).astype("<u2")[np.argsort(-level.astype(np.int8), kind="stable")[: counts[own]]]
        return np.append(own, counts).astype("<u4").tobytes() + values.tobytes()


def _sets(values: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    data, offsets = V.column(values)
    for lo, hi in V.pieces(offsets):
        at = offsets[lo : hi + 1]
        part = data[at[0] : at[-1]]
        s, e, bounds = V.spans(part, at - at[0])
        h = V.word_hashes(part, s, e)
        runs = V.shingles(h, words)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield np.unique(runs[a : b - words + 1] if b - a >= words else V.shingles(h[a:b], words))


def _mark(x: np.ndarray) -> tuple[int, int, int]:
    """(size, two sums) of a set of hashes, by which equal sets are one class."""
    return len(x), int(x.sum().astype(np.int64)), int(V.mix(x).sum().astype(np.int64))


def _signed(settings: Settings, kept: list[str]):
    """Columns row_id, text and ``kept`` in; the set of a text, its signature and its sketch out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _Signer(settings)
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                marks, sig, sketch = [], [], []
                for x in _sets(batch.column(1), settings.words):
                    marks.append(_mark(x))
                    sig.append(signer.signature(x) if len(x) else None)
                    sketch.append(signer.sketch(x) if len(x) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), *batch.columns[2:], *(pa.array([m[k] for m in marks], pa.int64()) for k in range(3)),
                        pa.array(sig, pa.list_(pa.int64())), pa.array(sketch, pa.binary()),
                    ],
                    ["row_id", *kept, "n_shingles", "one", "two", "sig", "sketch"],
                )

    return run


class _Cells:
    """Rows of whole cells, sorted by cell."""

    def __init__(self, table: pa.Table, settings: Settings):
        self.s = settings
        column = lambda name: table[name].combine_chunks().to_numpy(zero_copy_only=False)
        self.x, self.y, self.out = (column(c) for c in ("x", "y", "out"))
        self.cls, self.n, self.label = (column(c) for c in ("cls", "n", "label"))
        self.sig = table["sig"].combine_chunks().flatten().to_numpy().reshape(-1, settings.coordinates)
        self.at = np.argmax(self.sig == column("key")[:, None], axis=1)  # this list's coordinate
        parts = [np.frombuffer(v.as_buffer(), "<u2") for v in table["sketch"].combine_chunks()]
        head = np.array([p[: 2 * (LEVELS + 1)] for p in parts]).view("<u4").reshape(len(parts), LEVELS + 1).astype(np.int64)
        self.level, self.counts = head[:, 0], head[:, 1:]
        self.values = [p[2 * (LEVELS + 1) :] for p in parts]
        self.there = np.zeros(1 << 16, bool)

    def meets(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which rows j are to be compared with rows i, of the same cells."""
        n, m = self.n[i], self.n[j]
        ok = (np.minimum(n, m) * 100 >= np.maximum(n, m) * self.s.percent) & (self.label[i] != self.label[j])
        ok &= (self.x[i] & self.y[j] & (~self.out[j] | (self.cls[i] < self.cls[j]))) | (self.x[j] & self.y[i] & (~self.out[i] | (self.cls[j] < self.cls[i])))
        at = np.flatnonzero(ok)
        same = self.sig[i[at]] == self.sig[j[at]]
        ok[at] = (same.sum(axis=1) >= self.s.matches) & (np.argmax(same, axis=1) == self.at[i[at]])
        return ok

    def alike(self, i: int, j: np.ndarray) -> np.ndarray:
        """Which rows j may be as similar to row i as a link has to be, by sketches."""
        p = self.s.percent / 100
        ok = np.zeros(len(j), bool)
        level = np.maximum(self.level[i], self.level[j])
        for k in np.unique(level):
            of = np.flatnonzero(level == k)
            own = self.values[i][: self.counts[i, k]]
            size = self.counts[j[of], k]
            self.there[own] = True
            hit = self.there[np.concatenate([self.values[r][:c] for r, c in zip(j[of].tolist(), size.tolist())])]
            self.there[own] = False
            total = np.concatenate([[0], np.cumsum(hit)])
            ends = np.cumsum(size)
            common = np.minimum(total[ends] - total[ends - size], len(own))
            union = len(own) + size - common
            if k:
                ok[of] = common >= p * union - self.s.margin * np.sqrt(p * (1 - p) * union)
            else:
                ok[of] = 100 * common >= self.s.percent * union
        return ok

    def small(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows (i, j) to be compared, i ascending, of the cells bounds[k]:bounds[k + 1] of up to ``SMALL`` rows."""
        size = np.diff(bounds)
        cell = np.repeat(np.arange(len(size)), size)
        left = bounds[1:][cell] - np.arange(len(cell)) - 1  # rows of the cell behind each one
        left[size[cell] > SMALL] = 0
        found = [(np.zeros(0, np.int64),) * 2]
        for d in range(1, SMALL):
            i = np.flatnonzero(left >= d)
            if not len(i):
                break
            ok = self.meets(i, i + d)
            found.append((i[ok], i[ok] + d))
        i, j = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(i, kind="stable")
        return i[order], j[order]

    def tests(self, bounds: np.ndarray, joined: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
        """(row, rows to compare with it). ``joined``: groups of rows that are known to be connected, whose pairs need no test."""
        i, j = self.small(bounds)
        first = np.flatnonzero(np.diff(i, prepend=-1))
        for a, b in zip(first, np.append(first[1:], len(i))):
            yield int(i[a]), j[a:b]
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a > SMALL:
                for k in range(a, b - 1):
                    rest = np.arange(k + 1, b)
                    if joined is not None:
                        rest = rest[joined[k + 1 : b] != joined[k]]
                    rest = rest[self.meets(np.full(len(rest), k), rest)]
                    if len(rest):
                        yield k, rest

    def pairs(self, bounds: np.ndarray, forest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        joined = np.arange(len(self.cls)) if forest else None
        for i, j in self.tests(bounds, joined):
            if not forest:
                j = j[self.alike(i, j)]
                yield self.cls[np.full(len(j), i)], self.cls[j]
                continue
            j = j[joined[j] != joined[i]]
            j = j[self.alike(i, j)] if len(j) else j
            groups, first = np.unique(joined[j], return_index=True)
            j = j[first]
            yield self.cls[np.full(len(j), i)], self.cls[j]
            a, b = bounds[np.searchsorted(bounds, i, side="right") - 1 :][:2]
            for g in groups:
                own = joined[a:b]
                own[own == g] = joined[i]


def _compared(settings: Settings, forest: bool):
    """(a, b): classes of one cell that may be linked; with ``forest`` as many as connect all of them that are in one cell."""

    def found(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        both = list(_Cells(table, settings).pairs(bounds, forest))
        a, b = (np.concatenate([p[k] for p in both]) if both else np.zeros(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            cell = [table[c].to_numpy() for c in ("key", "bx", "by")]
            starts = np.flatnonzero(np.concatenate([[True], np.any([np.diff(c) != 0 for c in cell], axis=0)]))
            if len(starts) > 1:  # the last cell may go on in the next batch
                yield found(table.slice(0, starts[-1]), starts)
            held = table.slice(starts[-1])
        if held is not None:
            yield found(held, np.array([0, held.num_rows]))

    return run


def _set_rows(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):  # sets are as large as texts
                part = batch.slice(a, 256)
                sets = list(_sets(part.column(1), settings.words))
                marks = [pa.array([_mark(x)[k] for x in sets], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([part.column(0), *marks, pa.array([x.tobytes() for x in sets], pa.binary())], ["cls", "n_shingles", "one", "two", "members"])

    return run


def _confirmed(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= settings.percent * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])

    return run


def _links(pairs: DataFrame, classes: DataFrame, texts: DataFrame, settings: Settings, scratch: Scratch, name: str) -> DataFrame:
    """Those of the pairs (a, b) that are confirmed on full sets."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    rep = scratch.save(asked.join(classes.select("cls", "rep_row"), "cls"), f"{name}-rep")
    few = rep.count() <= MOST_BROADCAST
    sets = texts.join(F.broadcast(rep) if few else rep, F.col("row_id") == F.col("rep_row")).select("cls", "text")
    sets = sets.mapInArrow(_set_rows(settings), "cls bigint, n_shingles bigint, one bigint, two bigint, members binary")
    sets = sets.where(F.col("cls") == F.xxhash64("n_shingles", "one", "two"))  # rows of one id may have different texts
    sets = scratch.save(sets.select("cls", "members"), f"{name}-sets").dropDuplicates(["cls"])
    side = lambda c: sets.select(F.col("cls").alias(c), F.col("members").alias(f"set_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
    links = scratch.save(both.mapInArrow(_confirmed(settings), "a bigint, b bigint"), f"{name}-links")
    scratch.drop(f"{name}-sets", f"{name}-rep")
    return links


def _met(cells: DataFrame, classes: DataFrame, settings: Settings, forest: bool) -> DataFrame:
    """Pairs (a, b) that pass in the cells, rows (key, bx, by, x, y, out, label, cls)."""
    rows = cells.join(classes.select("cls", "n", "sig", "sketch"), "cls").repartition("key", "bx", "by").sortWithinPartitions("key", "bx", "by")
    return rows.mapInArrow(_compared(settings, forest), "a bigint, b bigint").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(), mark: str | None = None) -> DataFrame:
    """(id_col, n_shingles, component_id, kept, n_links) for each row of ``df``, and the long ``mark`` of the row if one is named.

    component_id is the smallest id reachable over links, kept whether that is the row's own id. Repeated rows, of one id and
    one text, are all kept or none; rows of one id with different texts are in components of their own. Texts without words (null
    too) have no shingles and no links. Rows without an id take part in no link
    and have no component. Other columns of ``df`` are not read. n_links: other classes that the row's class was linked with directly
    on the way; enough to connect the component, not all that there are.
    """
    scratch = Scratch(df.sparkSession, "near-duplicates")
    texts = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))
    marked = texts if mark is None else df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"), F.col(mark).alias("row_mark"))
    kept = marked.columns[2:]
    kind = df.schema[id_col].dataType.simpleString()
    signed = marked.mapInArrow(_signed(settings, kept), f"row_id {kind}, {'row_mark bigint, ' * len(kept)}n_shingles bigint, one bigint, two bigint, sig array<bigint>, sketch binary")
    signed = scratch.save(signed.withColumn("cls", F.xxhash64("n_shingles", "one", "two")).drop("one", "two"), "signed")
    classes = scratch.save(
        signed.where((F.col("n_shingles") > 0) & F.col("row_id").isNotNull())
        .groupBy("cls")
        .agg(F.min("row_id").alias("rep_row"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch")),
        "classes",
    )
    postings = classes.select("cls", F.posexplode(F.slice("sig", 1, settings.prefix)).alias("pos", "key"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    lists = scratch.save(postings.join(sizes, "key"), "lists")
    block = F.lit(settings.block)
    dealt = lambda of: F.pmod(F.xxhash64("cls", "key"), F.ceil(of / block)).cast("int")
    flag = lambda *on: [F.lit(v).alias(c) for c, v in zip(("x", "y", "out"), on)]

    # first round: each list in cells of its own members
    cells = lists.where(F.col("pos") < settings.first).select("key", F.lit(0).alias("bx"), dealt(F.col("size")).alias("by"), *flag(True, True, True), F.col("cls").alias("label"), "cls")
    tried = scratch.save(_met(cells, classes, settings, forest=True), "tried")
    links = _links(tried, classes, texts, settings, scratch, "first")
    labels = scratch.save(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch), "labels")

    # second round: lists whose members are in different components; the only pair of a list of two has been tried
    placed = lists.where((F.col("size") > 2) | (F.col("pos") >= settings.first)).join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    placed = scratch.save(placed.select("key", "cls", "size", F.coalesce("label", "cls").alias("label")), "placed")
    in_list = placed.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = in_list.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    mixed = placed.join(main.select("key", "main"), "key").withColumn("out", F.col("label") != F.col("main.label"))
    bx, by = dealt(F.col("size") - F.col("main.n")), dealt(F.col("size"))
    nx, ny = (F.ceil(of / block).cast("int") for of in (F.col("size") - F.col("main.n"), F.col("size")))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda i, j, x, y: F.struct(i.alias("bx"), j.alias("by"), x.alias("x"), y.alias("y"))
    as_y = F.transform(F.filter(upto(nx), lambda i: ~F.col("out") | (i != bx)), lambda i: cell(i, by, F.lit(False), F.lit(True)))
    as_x = F.transform(F.when(F.col("out"), upto(ny)).otherwise(F.array().cast("array<int>")), lambda j: cell(bx, j, F.lit(True), j == by))
    cells = mixed.select("key", "cls", "label", "out", F.inline(F.concat(as_x, as_y)))
    again = scratch.save(_met(cells, classes, settings, forest=False).join(tried, ["a", "b"], "left_anti"), "again")
    more = _links(again, classes, texts, settings, scratch, "second")

    links = scratch.save(links.unionByName(more), "links")
    final = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch, "final")
    placed = classes.select("cls", "rep_row").join(final.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least_of = placed.groupBy("label").agg(F.min("rep_row").alias("component_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    of_class = scratch.save(placed.join(least_of, "label").join(degree, "cls", "left").select("cls", "component_id", "n_links"), "of-class")
    scratch.drop("classes", "lists", "tried", "labels", "placed", "again", "links", "first-links", "second-links")
    linked = (F.col("n_shingles") > 0) & F.col("row_id").isNotNull()
    return (
        signed.select("row_id", *kept, "n_shingles", F.when(linked, F.col("cls")).alias("cls"))
        .join(of_class, "cls", "left")
        .select(
            F.col("row_id").alias(id_col),
            "n_shingles",
            F.coalesce("component_id", "row_id").alias("component_id"),
            F.coalesce(F.col("row_id") == F.coalesce("component_id", "row_id"), F.lit(False)).alias("kept"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            *[F.col(c).alias(mark) for c in kept],
        )
    )


#: The contract's sets: distinct 2-word shingles.
CONTRACT = Settings(words=2, percent=80)


def op3_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents``."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), settings=CONTRACT)
