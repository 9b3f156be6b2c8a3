"""Benchmark decontamination by latent semantic retrieval.

One scan of the texts writes the places of benchmark terms of every document; all that follows reads this small table.
Documents are overlapping passages of ``WIDTH`` words. A passage is the TF-IDF vector of the benchmark terms in it; terms that more than
``COMMON`` of all passages have weigh nothing. A randomised SVD of all passages gives the latent space: each task adds its passages
to a sketch of fixed size (terms x rank) of their Gram matrix, sketches are added up in two levels, and the driver finds the leading
vectors from the sum (Nystroem's formula; Tropp and others, 2017). Passages whose latent vectors have a cosine of at least ``cosine`` with
a benchmark item are its candidates, and so are, by an exact search, those in which ``GRAM`` of its words stand in a row: an item of
common words has hardly a direction of its own, and a verbatim copy is a candidate whatever its words weigh. A candidate is a leak if
the longest common subsequence of the item's words with the passage and its surroundings covers the item, and its answer, the last
third, is covered as well: paraphrases keep most words in order.

The benchmark is taken in groups of ``VOCABULARY`` different terms, one scan of the texts each, and in them by blocks of ``BLOCK`` items
with a latent space of their own; blocks of up to ``TOGETHER`` terms are held against the table at once. These bounds hold for all that
is broadcast. Texts never leave the task that reads them, and no row of documents is shuffled.
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
from cuelake.llm.scratch import Scratch

#: Items of a block, and characters of their texts unless one alone has more.
BLOCK, BLOCK_CHARS = 256, 1 << 18
#: Different terms that one scan of the texts looks for, and terms of the blocks that one pass over their places is for.
VOCABULARY, TOGETHER = 1 << 20, 1 << 15
#: Words of a passage; passages start every half of it.
WIDTH = 64
HALF = WIDTH // 2
#: Words of an item in a query; longer items are several queries.
QUERY = 96
#: Terms in more than this share of half passages weigh nothing.
COMMON = 0.02
#: Least weight of an item's terms where a candidate is judged, and in vectors of those of an item that has common terms only.
LEAST_WEIGHT = 0.1
#: Words in a row that make a passage a candidate; all of a shorter item.
GRAM = 3
#: Places that are worked on at once; a document with more is worked on alone.
PIECE = 1 << 17


@dataclass(frozen=True)
class Settings:
    """``covered`` and ``answer``: the least shares of an item's words and of its answer's in the common subsequence."""

    rank: int = 96
    oversample: int = 8
    cosine: float = 0.3
    covered: float = 0.6
    answer: float = 0.5
    rare: float = 0.4
    seed: int = 5


@dataclass(frozen=True)
class _Query:
    item: int | None
    words: tuple[int, ...]


@dataclass(frozen=True)
class _Block:
    """``terms``: numbers of the block's terms in the vocabulary, ascending. Queries have words numbered by them.

    ``columns``: of each term its column in vectors, -1 for those that weigh nothing; ``basis`` (columns x rank) and ``latent``
    (queries x rank) once they are known.
    """

    queries: tuple[_Query, ...]
    terms: np.ndarray
    weights: np.ndarray
    columns: np.ndarray
    basis: np.ndarray | None = None
    latent: np.ndarray | None = None


def _word_hashes(values: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, word hashes, bounds of texts in them)."""
    data, offsets = V.column(values)
    for lo, hi in V.pieces(offsets):
        at = offsets[lo : hi + 1]
        part = data[at[0] : at[-1]]
        s, e, bounds = V.spans(part, at - at[0], V.ALNUM)
        yield lo, hi, V.word_hashes(part, s, e), bounds


#: Leading bits of a hash by which most words are told to be no term before they are searched for.
SIEVE_BITS = 20


def _sieve(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << SIEVE_BITS, bool)
    out[hashes >> np.uint64(64 - SIEVE_BITS)] = True
    return out


def _lookup(h: np.ndarray, hashes: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Number of each hash among ``hashes``, -1 for others."""
    out = np.full(len(h), -1)
    if len(hashes):
        maybe = np.flatnonzero(sieve[h >> np.uint64(64 - SIEVE_BITS)])
        at = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
        out[maybe] = np.where(hashes[at] == h[maybe], at, -1)
    return out


def _found_terms(vocabulary):
    """(doc, n, gaps, terms) of each text: its number of words, and the places and numbers of the vocabulary's words.

    A gap is the distance to the place before, of 1 byte each if all fit and of 4 else; a term has 2 or 4.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = vocabulary.value
        sieve, kind = _sieve(hashes), "<u2" if len(hashes) <= 1 << 16 else "<u4"
        for batch in batches:
            for lo, hi, h, bounds in _word_hashes(batch.column(0)):
                number = _lookup(h, hashes, sieve)
                at = np.flatnonzero(number >= 0)
                terms = number[at].astype(kind)
                first = np.searchsorted(at, bounds)
                gap = np.diff(at, prepend=0)
                some = first[:-1][first[:-1] < first[1:]]
                gap[some] = at[some] - bounds[np.searchsorted(bounds, at[some], side="right") - 1]
                small = gap.astype(np.uint8)
                gaps = []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    gaps.append((small[a:b] if b == a or gap[a:b].max() < 256 else gap[a:b].astype("<u4")).tobytes())
                found = [terms[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                columns = [batch.column(1).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(gaps, pa.binary()), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "gaps", "terms"])

    return run


@dataclass(frozen=True)
class _Places:
    """Places of vocabulary terms of some documents, in order: ``of`` is the document, ``at`` the word in it, ``bounds`` theirs by document."""

    n: np.ndarray
    of: np.ndarray
    at: np.ndarray
    term: np.ndarray
    bounds: np.ndarray

    def terms_of(self, table: np.ndarray) -> _Places:
        """Those of the terms that ``table`` has a number for, so numbered."""
        term = table[self.term]
        keep = np.flatnonzero(term >= 0)
        return _Places(self.n, self.of[keep], self.at[keep], term[keep], np.searchsorted(keep, self.bounds))


def _places(batch: pa.RecordBatch, wide: bool) -> Iterator[tuple[int, _Places]]:
    """(first row, places) of pieces of the rows n, gaps, terms."""
    size = 4 if wide else 2
    n = batch["n"].to_numpy()
    terms = [np.frombuffer(x.as_buffer(), f"<u{size}") for x in batch["terms"]]
    gaps = [np.frombuffer(x.as_buffer(), "<u1" if len(x.as_buffer()) == len(t) else "<u4") for x, t in zip(batch["gaps"], terms)]
    ends = np.cumsum([len(t) for t in terms])
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE, side="right")))
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in terms[lo:hi]])])
        of = np.repeat(np.arange(hi - lo), np.diff(bounds))
        total = np.cumsum(np.concatenate([np.zeros(1, np.int64), *gaps[lo:hi]]), dtype=np.int64)
        at = total[1:] - total[bounds[:-1]][of]
        yield lo, _Places(n[lo:hi], of, at, np.concatenate(terms[lo:hi]).astype(np.int64), bounds)
        lo = hi


def _passages(places: _Places, block: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of all passages with a weighty term: (passage, column, value), sorted by passage, and the first passage of each text."""
    count = np.maximum(1, -(-places.n // HALF) - 1)
    base = np.concatenate([[0], np.cumsum(count)])
    weighty = np.flatnonzero(block.columns[places.term] >= 0)
    text, part, term = places.of[weighty], places.at[weighty] // HALF, places.term[weighty]
    last = count[text] - 1
    rows = np.concatenate([base[text] + np.minimum(part, last), base[text] + part - 1])
    both = np.concatenate([np.ones(len(text), bool), (part >= 1) & (part <= last)])
    size = max(1, len(block.terms))
    key, tf = np.unique(rows[both] * size + np.concatenate([term, term])[both], return_counts=True)
    row, term = key // size, key % size
    value = np.sqrt(tf) * block.weights[term]
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        norm = np.sqrt(np.add.reduceat(value * value, first))
        value = value / np.repeat(norm, np.diff(np.append(first, len(row))))
    return row, block.columns[term], value.astype(np.float32), base


def _project(row: np.ndarray, col: np.ndarray, value: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages, their rows times ``basis``)."""
    if not len(row):
        return row, np.zeros((0, basis.shape[1]), np.float32)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    size = np.diff(np.append(first, len(row)))
    out = basis[col[first]] * value[first, None]
    for k in range(1, int(size.max())):  # the k-th column of all passages that have so many
        more = np.flatnonzero(size > k)
        at = first[more] + k
        out[more] += basis[col[at]] * value[at, None]
    return row[first], out


def _document_counts(size: int):
    """(term, n) over half passages, and term -1 for their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(size, np.int64), 0
        for batch in batches:
            for _, p in _places(batch, size > 1 << 16):
                base = np.concatenate([[0], np.cumsum(-(-p.n // HALF))])
                passages += int(base[-1])
                total += np.bincount(np.unique((base[p.of] + p.at // HALF) * size + p.term) % size, minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], passages))], ["term", "n"])

    return run


def _tables(blocks: list[_Block], size: int) -> list[np.ndarray]:
    """For each block the number in it of every term of the vocabulary, -1 for others."""
    out = []
    for b in blocks:
        table = np.full(size, -1, np.int32)
        table[b.terms] = np.arange(len(b.terms))
        out.append(table)
    return out


def _omega(block: _Block, settings: Settings) -> np.ndarray:
    columns = int((block.columns >= 0).sum())
    rank = min(settings.rank + settings.oversample, columns)
    return np.random.default_rng(settings.seed).standard_normal((columns, rank)).astype(np.float32)


#: Rows of a sketch that are one row of the table that is added up.
SLICE = 256


def _sketched(shared, size: int, settings: Settings):
    """(block, slice, sketch) of each block: the Gram matrix of a task's passages times a random matrix, ``SLICE`` rows in each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        tables, omegas = _tables(blocks, size), [_omega(b, settings) for b in blocks]
        sums = [np.zeros(w.shape, np.float32) for w in omegas]
        for batch in batches:
            for _, places in _places(batch, size > 1 << 16):
                for block, table, w, out in zip(blocks, tables, omegas, sums):
                    row, col, value, _ = _passages(places.terms_of(table), block)
                    if len(row):
                        kept, y = _project(row, col, value, w)
                        order = np.argsort(col, kind="stable")
                        at, first = np.searchsorted(kept, row)[order], np.flatnonzero(np.diff(col[order], prepend=-1))
                        for a in range(0, len(first), SLICE):
                            x = first[a]
                            y_of = slice(x, first[a + SLICE] if a + SLICE < len(first) else len(order))
                            out[col[order[first[a : a + SLICE]]]] += np.add.reduceat(y[at[y_of]] * value[order[y_of], None], first[a : a + SLICE] - x)
        for k, out in enumerate(sums):
            for a in range(0, len(out), SLICE):
                if out[a : a + SLICE].any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([a], pa.int32()), pa.array([out[a : a + SLICE].tobytes()], pa.binary())], ["block", "slice", "sketch"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in table["sketch"])
    return pa.table({"block": table["block"][:1], "slice": table["slice"][:1], "sketch": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _sketches(hits: DataFrame, blocks: list[_Block], size: int, settings: Settings) -> list[np.ndarray]:
    """The sum of all tasks' sketches for each block, added up on the executors: some tasks' at a time, then all."""
    schema = "block int, slice int, sketch binary"
    rows = hits.mapInArrow(_sketched(hits.sparkSession.sparkContext.broadcast(blocks), size, settings), schema)
    groups = max(1, int(hits.rdd.getNumPartitions() ** 0.5))
    some = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(groups))).groupBy("block", "slice", "part").applyInArrow(_added, schema)
    out = [np.zeros(_omega(b, settings).shape) for b in blocks]
    for r in some.groupBy("block", "slice").applyInArrow(_added, schema).collect():
        to = out[r["block"]]
        part = np.frombuffer(r["sketch"], np.float32).reshape(-1, to.shape[1])
        to[r["slice"] : r["slice"] + len(part)] = part
    return out


def _latent(block: _Block, sketch: np.ndarray, settings: Settings) -> _Block:
    """The block with the leading vectors of its passages' Gram matrix, from its sketch, and its queries in their space."""
    rows = np.zeros((len(block.queries), sketch.shape[0]))
    for i, q in enumerate(block.queries):  # the items themselves are passages too
        term, tf = np.unique(np.array(q.words), return_counts=True)
        on = block.columns[term] >= 0
        rows[i, block.columns[term[on]]] = np.sqrt(tf[on]) * block.weights[term[on]]
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    omega = _omega(block, settings).astype(np.float64)
    y = sketch + rows.T @ (rows @ omega)
    shift = 1e-6 * np.linalg.norm(y)  # keeps the small matrix definite in spite of rounding
    y = y + shift * omega
    core = omega.T @ y
    value, turn = np.linalg.eigh((core + core.T) / 2)
    half = y @ (turn / np.sqrt(np.maximum(value, max(value.max(initial=0.0) * 1e-10, 1e-30))))
    basis = np.linalg.svd(half, full_matrices=False)[0][:, : min(settings.rank, omega.shape[1])]
    latent = rows @ basis
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    return _Block(block.queries, block.terms, block.weights, block.columns, basis.astype(np.float32), latent.astype(np.float32))


def common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Bits of a longest common subsequence of a query (bit masks of each word's places, ``size`` words) and words: its length.

    Bit-parallel (Hyyrö, 2004); the place of a zero bit in the state is a matched place of the query.
    """
    full = (1 << size) - 1
    state = full
    for w in words:
        m = masks.get(w)
        if m:
            u = state & m
            state = ((state + u) | (state - u)) & full
    return size - state.bit_count()


def _masks(words: tuple[int, ...]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def _runs(terms: list[np.ndarray], size: int) -> np.ndarray:
    """A hash of each row of term numbers, ``terms`` has one array for each place in a row."""
    out = np.full(len(terms[0]), size, np.uint64)
    for t in terms:
        out = V.mix(out * np.uint64(0x9E3779B97F4A7C15) + t.astype(np.uint64) + np.uint64(1))
    return out


def _gram_table(queries: tuple[_Query, ...]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By size: hashes of the queries' runs of ``GRAM`` words, ascending, their sieve, and bounds of each one's queries in the last array."""
    out = {}
    for size in range(1, GRAM + 1):
        own = []
        for k, q in enumerate(queries):
            if min(GRAM, len(q.words)) == size:
                w = np.array(q.words)
                own += [(int(g), k) for g in set(_runs([w[j : len(w) - size + 1 + j] for j in range(size)], size).tolist())]
        if own:
            own.sort()
            hashes, first = np.unique(np.array([g for g, _ in own], np.uint64), return_index=True)
            out[size] = hashes, _sieve(hashes), np.append(first, len(own)), np.array([k for _, k in own])
    return out


def _gram_hits(p: _Places, base: np.ndarray, grams: dict) -> Iterator[tuple[int, int]]:
    """(passage, query) of all passages that a run of a query's words starts in."""
    for size, (hashes, sieve, first, queries) in grams.items():
        starts = np.arange(max(0, len(p.at) - size + 1))
        for j in range(1, size):
            starts = starts[(p.of[starts + j] == p.of[starts]) & (p.at[starts + j] == p.at[starts] + j)]
        number = _lookup(_runs([p.term[starts + j] for j in range(size)], size), hashes, sieve)
        hit = np.flatnonzero(number >= 0)
        text = p.of[starts[hit]]
        passage = np.minimum(base[text] + p.at[starts[hit]] // HALF, base[text + 1] - 1)
        found = np.unique(passage * max(1, len(hashes)) + number[hit])
        for x, g in zip((found // max(1, len(hashes))).tolist(), (found % max(1, len(hashes))).tolist()):
            for k in queries[first[g] : first[g + 1]].tolist():
                yield x, k


class _Judge:
    """Finds a block's leaks in places of its terms."""

    def __init__(self, block: _Block, settings: Settings):
        self.block, self.settings, qs = block, settings, block.queries
        self.has = np.zeros((int((block.columns >= 0).sum()), len(qs)), np.float32)  # weight of each column in each query
        for k, q in enumerate(qs):
            own = np.array(q.words)[block.columns[np.array(q.words)] >= 0]
            self.has[block.columns[own], k] = block.weights[own]
        self.total = self.has.sum(axis=0)
        self.column_weight = np.zeros(len(self.has), np.float32)
        self.column_weight[block.columns[block.columns >= 0]] = block.weights[block.columns >= 0]
        self.whole = [(_masks(q.words), len(q.words)) for q in qs]
        tail = [q.words[-max(1, len(q.words) // 3) :] for q in qs]
        self.answers = [(_masks(x), len(x)) for x in tail]
        self.weight = np.maximum(block.weights, LEAST_WEIGHT).tolist()
        self.heavy = [sum(self.weight[w] for w in set(q.words)) for q in qs]
        self.grams = _gram_table(qs)

    def near(self, row: np.ndarray, col: np.ndarray, value: np.ndarray) -> dict[tuple[int, int], float]:
        """Cosine of (passage, query) that are candidates: near in the latent space, with enough of the query's weighty terms."""
        s, b = self.settings, self.block
        if not len(row):
            return {}
        first = np.flatnonzero(np.diff(row, prepend=-1))
        size = np.diff(np.append(first, len(row)))
        # a passage whose terms weigh less than any query asks for has enough of none
        may = np.add.reduceat(self.column_weight[col], first) >= s.rare / 2 * self.total.min() * (1 - 1e-5)
        keep = np.repeat(may, size)
        row, col, value = row[keep], col[keep], value[keep]
        out = {}
        first = np.flatnonzero(np.diff(row, prepend=-1))
        for a in range(0, len(first), 4096):
            x, y = first[a], first[a + 4096] if a + 4096 < len(first) else len(row)
            kept, vectors = _project(row[x:y], col[x:y], value[x:y], b.basis)
            cos = (vectors @ b.latent.T) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            some = np.flatnonzero((cos >= s.cosine).any(axis=1))
            if len(some):
                begin = first[a : a + 4096] - x
                end = np.append(begin[1:], y - x)
                take = np.concatenate([np.arange(begin[p], end[p]) for p in some])
                starts = np.concatenate([[0], np.cumsum(end[some] - begin[some])])[:-1]
                enough = np.add.reduceat(self.has[col[x:y][take]], starts, axis=0) >= s.rare / 2 * self.total
                for p, k in zip(*np.nonzero(enough & (cos[some] >= s.cosine))):
                    out[int(kept[some[p]]), int(k)] = float(cos[some[p], k])
        return out

    def leaks(self, places: _Places) -> Iterator[tuple[int, int, tuple[float, float, float, int, int]]]:
        """(text, query, (covered, answer, cosine, first word, end word)) of the candidates that are leaks."""
        s = self.settings
        row, col, value, base = _passages(places, self.block)
        near = self.near(row, col, value)
        for passage, k in sorted(near.keys() | set(_gram_hits(places, base, self.grams))):
            text = int(np.searchsorted(base, passage, side="right")) - 1
            first = (passage - int(base[text])) * HALF
            masks, size = self.whole[k]
            a, b = max(0, first - size), min(int(places.n[text]), first + WIDTH + size)
            x, y = places.bounds[text : text + 2]
            x, y = x + np.searchsorted(places.at[x:y], (a, b))
            words = places.term[x:y].tolist()  # other words are in no query
            if sum(self.weight[w] for w in masks.keys() & words) / self.heavy[k] < s.rare:
                continue
            covered = common_subsequence(masks, size, words) / size
            if covered < s.covered:
                continue
            masks, part = self.answers[k]
            answer = common_subsequence(masks, part, words) / part
            if answer >= s.answer:
                yield text, k, (covered, answer, near.get((passage, k), 0.0), a, b)


def _leaks(shared, size: int, settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        judges, tables = [_Judge(b, settings) for b in blocks], _tables(blocks, size)
        for batch in batches:
            found: dict[tuple[int, int, int], tuple[float, float, float, int, int]] = {}
            for lo, places in _places(batch, size > 1 << 16):
                for j, (judge, table) in enumerate(zip(judges, tables)):
                    for text, k, got in judge.leaks(places.terms_of(table)):
                        found[lo + text, j, k] = max(found.get((lo + text, j, k), (0.0, 0.0, 0.0, 0, 0)), got)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc"].take(pa.array([i for i, _, _ in found], pa.int64())),
                    pa.array([blocks[j].queries[k].item for _, j, k in found], pa.int64()),
                    *(pa.array([x[j] for x in found.values()], pa.float64()) for j in range(3)),
                    *(pa.array([x[j] for x in found.values()], pa.int64()) for j in (3, 4)),
                ],
                ["doc", "item_id", "covered", "answer", "cosine", "first_word", "last_word"],
            )

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    block, chars = [], 0
    for r in items.toLocalIterator():
        if block and (len(block) >= BLOCK or chars + len(r["text"]) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((r["item_id"], r["text"]))
        chars += len(r["text"])
    if block:
        yield block


def _queries(block: list[tuple[int | None, str]]) -> list[_Query]:
    out = []
    for _, _, h, bounds in _word_hashes(pa.array([t for _, t in block], pa.string())):
        for a, b in zip(bounds[:-1], bounds[1:]):
            item = block[len(out)][0]
            out.append(_Query(item, tuple(int(x) for x in h[a:b])))
    parts = []
    for q in out:
        n = max(1, -(-len(q.words) // QUERY))
        step = -(-len(q.words) // n)
        parts += [_Query(q.item, q.words[a : a + step]) for a in range(0, len(q.words), step)] if q.words else []
    return parts


def _groups(items: DataFrame) -> Iterator[list[list[_Query]]]:
    """Blocks of queries, as many at a time as have ``VOCABULARY`` different terms together, or one."""
    group, seen = [], set()
    for block in _blocks(items):
        qs = _queries(block)
        own = {w for q in qs for w in q.words}
        if group and len(seen | own) > VOCABULARY:
            yield group
            group, seen = [], set()
        if qs:
            group.append(qs)
            seen |= own
    if group:
        yield group


def _weighted(queries: list[_Query], vocabulary: np.ndarray, idf: np.ndarray) -> _Block:
    """The block of these queries, whose words are hashes, with the weights of its terms."""
    terms = np.unique(np.searchsorted(vocabulary, np.array([w for q in queries for w in q.words], np.uint64)))
    number = {int(h): k for k, h in enumerate(vocabulary[terms])}
    qs = tuple(_Query(q.item, tuple(number[w] for w in q.words)) for q in queries)
    own = idf[terms]
    weights = np.maximum(0.0, own - min(-np.log(COMMON), 0.5 * own.max()))
    for q in qs:  # one of common words only keeps all of them
        if not weights[list(q.words)].any():
            weights[list(q.words)] = LEAST_WEIGHT
    columns = np.where(weights > 0, np.cumsum(weights > 0) - 1, -1)
    return _Block(qs, terms, weights, columns)


def _together(blocks: list[_Block]) -> Iterator[list[_Block]]:
    chunk, terms = [], 0
    for b in blocks:
        if chunk and terms + len(b.terms) > TOGETHER:
            yield chunk
            chunk, terms = [], 0
        chunk.append(b)
        terms += len(b.terms)
    if chunk:
        yield chunk


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(id_col, item_id, covered, answer, cosine, first_word, last_word): benchmark items that documents leak, best passage first.

    Null and blank texts leak nothing and blank items are leaked by none; an empty table on either side gives an empty result.
    Repeated rows of documents are each found, repeated items under each of their ids; a document that leaks several parts of one
    long item has one row for it, its best part's. Of equally good passages the one that ends last is named. Other columns of the
    tables, whatever their names, are not read.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    scratch = Scratch(spark, "decontamination")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.lower(F.col(text_col)).alias("text"), F.col(id_col).alias("doc"))
    schema = f"doc {kind}, item_id bigint, covered double, answer double, cosine double, first_word bigint, last_word bigint"
    found = spark.createDataFrame([], schema)
    wanted = items.where(F.col("text").isNotNull()).select("item_id", F.lower("text").alias("text")).orderBy("item_id", "text")
    for g, group in enumerate(_groups(wanted)):
        vocabulary = np.unique(np.array([w for qs in group for q in qs for w in q.words], np.uint64))
        size = len(vocabulary)
        hits = scratch.save(texts.mapInArrow(_found_terms(share(vocabulary)), f"doc {kind}, n bigint, gaps binary, terms binary"), f"places-{g}")
        counts = hits.mapInArrow(_document_counts(size), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        term, n = counts["term"].to_numpy(), counts["n"].to_numpy()
        passages, df = n[term < 0].sum(), np.zeros(size)
        df[term[term >= 0]] = n[term >= 0]
        if passages:
            idf = np.log((passages + 1) / (df + 1))
            for c, blocks in enumerate(_together([_weighted(qs, vocabulary, idf) for qs in group])):
                ready = [_latent(b, y, settings) for b, y in zip(blocks, _sketches(hits, blocks, size, settings))]
                rows = hits.mapInArrow(_leaks(share(ready), size, settings), schema)
                found = found.unionByName(scratch.save(rows, f"found-{g}-{c}"))
        scratch.drop(f"places-{g}")
    best = F.max(F.struct("covered", "answer", "cosine", "first_word", "last_word")).alias("best")
    return found.groupBy("doc", "item_id").agg(best).select(F.col("doc").alias(id_col), "item_id", "best.*")


def op2_latent_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of ``benchmark`` that whole texts of ``documents`` leak, with or without paraphrase; ties and odd rows as ``leaks`` has them."""
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
