"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams of its letters, square root of the count times the inverse document frequency, scaled to
length 1. Each language has some centroids from spherical k-means; the nearest one by cosine decides. A text that is much farther
from all centroids than any training text of about its length is rejected.

Model: a matrix of fixed size, fitted in one task on a bounded sample of labelled rows and sent to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import textvec as V
from cuelake.llm.columns import free_name, held_out, read_table, with_fields
from cuelake.llm.fitting import fitted

#: Languages of more than this number of different labels are not told apart by a sample of ``Settings.sample`` rows.
MOST_LABELS = 512
UNKNOWN = "und"
#: A letter of any script.
LETTER = "\\p{L}"

_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_FOLDED = np.where(_LETTER, V.LOWER, 32).astype(np.uint8)


@dataclass(frozen=True)
class Settings:
    """``sample``: about so many labelled rows are learnt from, as many of each language. ``slack``: a text is rejected whose
    cosine is under this share of the least one of training texts of its length class."""

    dims: int = 4096
    clusters: int = 4
    sample: int = 3000
    slack: float = 0.5
    seed: int = 11


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: tuple[str, ...]
    of_centroid: np.ndarray
    least: np.ndarray


def _length_class(letters: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array([16, 64, 256, 1024, 4096]), letters)


def vectors(values: pa.Array, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(counts of hashed 1-, 2- and 3-grams, letters) of the texts, some at a time. Runs of other characters are one blank."""
    data, offsets = V.column(values)
    mask = np.uint32(dims - 1)
    for lo, hi in V.pieces(offsets):
        at = offsets[lo : hi + 1]
        raw = data[at[0] : at[-1]]
        at = at - at[0]
        letter = _LETTER[raw]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first blank after a letter
        to = np.concatenate([[0], np.cumsum(keep)])[at]
        d = _FOLDED[raw][keep].astype(np.uint32)
        n_letters = np.concatenate([[0], np.cumsum(letter)])[at]
        h = [d * np.uint32(0x9E3779B1)]
        h.append(h[0][:-1] * np.uint32(0x85EBCA6B) + d[1:] * np.uint32(0xC2B2AE35))
        h.append(h[1][:-1] * np.uint32(0x27D4EB2F) + d[2:] * np.uint32(0x165667B1))
        h = [((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(11)) & mask for x in h]
        for a in range(lo, hi, 256):
            rows = range(a - lo, min(hi, a + 256) - lo)
            out = np.zeros((len(rows), dims), np.float32)
            for k, i in enumerate(rows):
                x, y = to[i], to[i + 1]
                if y > x:
                    out[k] = np.bincount(np.concatenate([h[0][x:y], h[1][x : max(x, y - 1)], h[2][x : max(x, y - 2)]]), minlength=dims)
            yield out, n_letters[rows.start + 1 : rows.stop + 1] - n_letters[rows.start : rows.stop]


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def sample_by_label(df: DataFrame, label: str, rows: int, key: list[str]) -> DataFrame:
    """About ``rows`` rows of ``df``, as many of each label, chosen by a hash of ``key``; a label with fewer gives all it has.

    More than ``MOST_LABELS`` labels are an error; none is left out. Counts of labels are taken over all rows. The expected size is the bound; it does not grow with the table.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().orderBy(F.desc("count"), label).limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels in {label}: a sample of {rows} rows cannot tell them apart")
    if not counts:
        return df.limit(0)
    quota = max(1, rows // len(counts))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, quota / n))])
    draw = F.pmod(F.xxhash64(*key, F.lit(label)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return df.where(F.element_at(share, F.col(label)) > draw)


def learn(sample: dict[str, list], settings: Settings) -> Model:
    """The model of a sample: counts of n-grams (2 bytes each), letters and lang of each text."""
    letters = np.array(sample["letters"], np.int64)
    counts = np.array([np.frombuffer(x, np.uint16) for x in sample["counts"]], np.float32).reshape(-1, settings.dims)[letters > 0]
    label = np.array(sample["lang"], object)[letters > 0]
    letters = letters[letters > 0]
    order = np.lexsort((counts @ np.random.default_rng(0).random(settings.dims).astype(np.float32), label.astype(str)))  # whatever order rows came in
    counts, label, letters = counts[order], label[order], letters[order]
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    x = _weighted(counts, idf)
    centroids, of = [], []
    langs = tuple(sorted(set(label)))
    rng = np.random.default_rng(settings.seed)
    for i, name in enumerate(langs):
        own = x[label == name]
        c = own[rng.choice(len(own), min(settings.clusters, len(own)), replace=False)]
        for _ in range(10):
            near = (own @ c.T).argmax(axis=1)
            sums = np.array([own[near == k].sum(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
            c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        centroids.append(c)
        of += [i] * len(c)
    all_c = np.concatenate(centroids).astype(np.float32) if centroids else np.zeros((0, settings.dims), np.float32)
    least = np.zeros(6, np.float32)
    if len(x):
        best = (x @ all_c.T).max(axis=1)
        for k in range(2, 6):  # texts of under 64 letters are too short to be called far
            near = best[_length_class(letters) == k]
            least[k] = settings.slack * near.min() if len(near) else 0
    return Model(idf, all_c, langs, np.array(of, np.int64), least)


def fit(df: DataFrame, text: str, lang: str, key: str, settings: Settings = Settings()) -> Model:
    """Learn from the rows of ``df`` with a language. Without such rows the model knows no language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for counts, letters in vectors(batch.column(0), settings.dims):
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.astype(np.uint16).tobytes() for x in np.minimum(counts, 65535)]), pa.array(letters), batch.column(1).slice(at, n)],
                    ["counts", "letters", "lang"],
                )
                at += n

    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key"))
    rows = sample_by_label(known, "lang", settings.sample, ["key", "text"])
    sample = rows.select("text", "lang").mapInArrow(run, "counts binary, letters bigint, lang string")
    return fitted(sample, lambda columns: learn(columns, settings))


RESULT = "lang_pred string, score double, distance double, rejected boolean"


def identified(text: Column, model: Model, spark: SparkSession) -> Column:
    """A struct of lang_pred, score, distance and rejected; all other columns of a row stay in the JVM.

    ``und``: null texts and texts without a letter (Unicode category L), score 0, distance 1, rejected; so is every text if the
    model knows no language. Else lang_pred is the language of the nearest centroid, the first by name of equally near ones;
    distance is 1 - cosine and score is the nearest one's part of the sum of its cosine and the next language's. Repeated rows get
    equal results.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def nearest_language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        dims, names = len(m.idf), np.array([*m.langs, UNKNOWN], object)
        for texts in batches:
            pred, score, far, out = [], [], [], []
            for counts, letters in vectors(texts, dims):
                if not len(m.langs):
                    best, nearest, second = np.zeros(len(counts)), np.zeros(len(counts), np.int64), np.zeros(len(counts))
                else:
                    cos = _weighted(counts, m.idf) @ m.centroids.T
                    by_lang = np.full((len(cos), len(m.langs)), -1.0, np.float32)
                    for c, i in enumerate(m.of_centroid):
                        by_lang[:, i] = np.maximum(by_lang[:, i], cos[:, c])
                    nearest = by_lang.argmax(axis=1)
                    best = by_lang.max(axis=1)
                    by_lang[np.arange(len(by_lang)), nearest] = -1
                    second = np.maximum(by_lang.max(axis=1), 0) if len(m.langs) > 1 else np.zeros(len(best))
                none = (letters == 0) | (len(m.langs) == 0)
                pred.append(np.where(none, names[-1], names[nearest]))
                score.append(np.where(none, 0, np.clip(best / np.maximum(best + second, 1e-9), 0, 1)))
                far.append(np.where(none, 1, np.clip(1 - best, 0, 1)))
                out.append(none | (best < m.least[_length_class(letters)]))
            join = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
            fields = [join(pred, pa.string()), join(score, pa.float64()), join(far, pa.float64()), join(out, pa.bool_())]
            yield pa.StructArray.from_arrays(fields, ["lang_pred", "score", "distance", "rejected"])

    # bytes beyond ASCII count as letters in vectors, so texts of such symbols only are told apart here and sent as empty ones
    return nearest_language(F.when(text.rlike(LETTER), F.lower(text)).otherwise(""))


def predict(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep`` of ``df`` and the fields of ``identified``; columns of equal names are an error."""
    found = df.select(*[F.col(c) for c in keep], identified(F.col(text), model, df.sparkSession).alias(free_name(keep)))
    return with_fields(found, keep)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id")))


def op10_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, learnt from rows that are not held out.

    Ties go to the language that is first by name; other columns of the table, whatever their names, are not read.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(training_rows(docs).withColumn("text", F.lower("text")), "text", "lang", "doc_id")
    found = predict(docs.select("doc_id", "text"), model, keep=("doc_id",))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "distance", "rejected")
