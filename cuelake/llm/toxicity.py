"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words is the number of 4-byte subsequences that they share, each occurrence weighted by ``DECAY`` to the power of
the bytes it stretches over; values are scaled by the words' own. Between any two neighbours of a subsequence one inserted byte may
stand. A word with other characters than letters and digits among these is scored without them as well, however many they are and
whatever their bytes, and the worse score counts. Letters that stand alone one after another ("i d i o t") are one word.

A text is scored by its worst words. Training knows labels of texts only. Examples are the words of toxic texts with a piece that
is far more frequent there than in clean texts; counterexamples are words of clean texts, above all those that the machine of the
round before scored worst. Nyström features are
the kernel's values with landmark words, whitened; the machine is linear in them, and so in subsequences. Its weights are
folded into one table of the landmarks' subsequences, by which whole texts are scored in vectors: a word's score is exactly that
of the machine.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import textvec as V
from cuelake.llm.columns import free_name, held_out, read_table, with_fields
from cuelake.llm.fitting import fitted
from cuelake.llm.language_id import sample_by_label

DECAY = 0.6
#: Bytes that stand before and after each word, so that subsequences tell its ends.
BEFORE, AFTER = 1, 2
#: Places of the second to fourth byte of a subsequence after its first.
PATTERNS = tuple((a, a + b, a + b + c) for a, b, c in product((1, 2), repeat=3))
#: Sizes of the pieces, from and to, that tell example words.
PIECE_SIZES = (4, 7)
#: Words whose mean counts beside the worst one alone.
WORST = 3
#: Subsequences are told apart by a hash of so many bits.
CODE_BITS = 24


@dataclass(frozen=True)
class Settings:
    """``sample``: about so many labelled texts are learnt from, half of them toxic. ``landmarks``: half of them from toxic texts.
    ``support`` and ``odds``: the least share of toxic texts with a typical piece, and how many times its share of clean texts."""

    sample: int = 2000
    landmarks: int = 300
    counterexamples: int = 8000
    rounds: int = 3
    support: float = 0.015
    odds: float = 8.0
    ridge: float = 0.05
    cost: float = 30.0
    threshold: float = 0.7
    seed: int = 3


@dataclass(frozen=True)
class Model:
    """Weight of each subsequence code, the machine's bias, and the logistic scale of text scores."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def known(self) -> np.ndarray:
        table = np.zeros(1 << CODE_BITS, bool)
        table[self.codes] = True
        return table


def marked(d: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``d`` with a mark before and one after each, and their starts."""
    size = np.diff(np.append(starts, len(d)))
    to = starts + 2 * np.arange(len(starts))
    out = np.empty(len(d) + 2 * len(starts), np.uint8)
    out[to], out[to + size + 1] = BEFORE, AFTER
    out[np.arange(len(d)) + np.repeat(2 * np.arange(len(starts)) + 1, size)] = d
    return out, to


def characters(d: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number of each UTF-8 character, its bytes, its size, and the words' starts in characters."""
    head = (d & 0xC0) != 0x80
    head[starts] = True
    at = np.flatnonzero(head)
    out = d[at].astype(np.uint32)
    size = np.diff(np.append(at, len(d)))
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        out[more] |= d[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out, size, np.searchsorted(at, starts)


def _inserted(c: np.ndarray) -> np.ndarray:
    """Which characters are neither letters nor digits."""
    out = ~V.ALNUM[c & 0xFF]
    wide = np.flatnonzero(c >= 128)
    kinds, at = np.unique(c[wide], return_inverse=True)
    other = [category(int(x).to_bytes(4, "little").rstrip(b"\0").decode("utf-8", "replace")[0])[0] not in "LN" for x in kinds]
    out[wide] = np.array(other, bool)[at]
    return out


def joined(d: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, bytes, starts) of the words with inserted characters between letters, without these; ends stay as they are."""
    c, size, starts = characters(d, starts)
    inserted = _inserted(c)
    word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(c))))
    letter = np.flatnonzero(~inserted)
    between = np.flatnonzero(inserted)
    k = np.searchsorted(letter, between)
    ok = (k > 0) & (k < len(letter))
    between, k = between[ok], k[ok]
    between = between[(word[letter[k - 1]] == word[between]) & (word[letter[k]] == word[between])]
    numbers = np.unique(word[between])
    keep = np.isin(word, numbers)
    keep[between] = False
    word, keep = np.repeat(word, size), np.repeat(keep, size)
    return numbers, d[keep], np.searchsorted(word[keep], numbers)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes without blanks, word starts in them, bounds of texts in words); runs of 3 or more single-byte words are one word."""
    s, e, bounds = V.spans(data, offsets)
    size = e - s
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    single = size == 1
    after = np.zeros(len(s), bool)  # goes on the run of the word before
    after[1:] = single[1:] & single[:-1] & (text[1:] == text[:-1])
    head = np.flatnonzero(~after)
    run = np.diff(np.append(head, len(s)))
    split = np.repeat(run, run) < 3  # too short a run: leave its words alone
    first = ~after | split
    starts = np.concatenate([[0], np.cumsum(size)])[:-1][first]
    bounds = np.concatenate([[0], np.cumsum(first)])[bounds]
    return data[V.NOT_BLANK[data]], starts, bounds


def _norms(size: np.ndarray) -> np.ndarray:
    """Kernel of words of these sizes with themselves, square root; as if no subsequence occurred twice."""
    total = np.zeros(len(size))
    for *_, c in PATTERNS:
        total += np.maximum(size - c, 0) * DECAY ** (2 * (c + 1))
    return np.sqrt(np.maximum(total, DECAY**8))


def _occurrences(d: np.ndarray, starts: np.ndarray, known: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(place, code, weight) of subsequences within words, those in the table ``known`` only."""
    if not len(d):
        return
    size = np.diff(np.append(starts, len(d)))
    left = np.repeat(starts + size, size) - np.arange(len(d))  # bytes to the word's end, this one included
    x = d.astype(np.uint32)
    parts = [x * np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]
    for a, b, c in PATTERNS:
        n = len(x) - c
        if n <= 0:
            continue
        code = parts[0][:n] + parts[1][a : a + n] + parts[2][b : b + n] + parts[3][c : c + n]
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - CODE_BITS)
        ok = left[:n] > c
        if known is not None:
            ok &= known[code]
        at = np.flatnonzero(ok)
        yield at, code[at].astype(np.int64), DECAY ** (c + 1)


def _kernel_scores(d: np.ndarray, starts: np.ndarray, model: Model, known: np.ndarray) -> np.ndarray:
    x, first = marked(d, starts)
    total = np.zeros(len(x))
    for at, code, weight in _occurrences(x, first, known):
        total[at] += weight * model.weights[np.searchsorted(model.codes, code)]
    sums = np.add.reduceat(total, first) if len(first) else np.zeros(0)
    return sums / _norms(np.diff(np.append(first, len(x)))) + model.bias


def _word_scores(d: np.ndarray, starts: np.ndarray, model: Model, known: np.ndarray) -> np.ndarray:
    """Scores of the words of bytes ``d``, the worse of a word as it is and without inserted characters."""
    scores = _kernel_scores(d, starts, model, known)
    numbers, bare, at = joined(d, starts)
    if len(numbers):
        scores[numbers] = np.maximum(scores[numbers], _kernel_scores(bare, at, model, known))
    return scores


def word_scores(data: np.ndarray, offsets: np.ndarray, model: Model, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(score of each word, bytes without blanks, word starts, bounds)."""
    d, starts, bounds = words_of(data, offsets)
    return _word_scores(d, starts, model, known), d, starts, bounds


def text_scores(scores: np.ndarray, bounds: np.ndarray, empty: float) -> np.ndarray:
    """Each text's worst word and its ``WORST`` worst ones, half and half; a text of fewer words has words of score ``empty``."""
    out = np.full(len(bounds) - 1, empty)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        if b > a:
            own = scores[a:b] if b - a >= WORST else np.append(scores[a:b], [empty] * (WORST - b + a))
            top = np.partition(own, len(own) - WORST)[-WORST:]
            out[i] = (top.max() + top.mean()) / 2
    return out


def _features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, code, scaled weight) of all subsequences of the words."""
    d = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    d, starts = marked(d, np.concatenate([[0], np.cumsum(size)])[:-1])
    number = np.repeat(np.arange(len(words)), size + 2)
    norms = _norms(size + 2)
    got = [(number[at], code, w / norms[number[at]]) for at, code, w in _occurrences(d, starts, None)]
    return tuple(np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))


def _kernel(words: list[bytes], codes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Kernel of the words with the landmarks, whose scaled subsequence weights are ``marks`` (codes x landmarks)."""
    out = np.zeros((len(words), marks.shape[1]))
    number, code, weight = _features(words)
    at = np.searchsorted(codes, code)
    hit = (at < len(codes)) & (codes[np.minimum(at, len(codes) - 1)] == code)
    order = np.argsort(number[hit], kind="stable")
    number, at, weight = number[hit][order], at[hit][order], weight[hit][order]
    for a in range(0, len(number), 1 << 14):
        b = slice(a, a + (1 << 14))
        first = np.flatnonzero(np.concatenate([[True], np.diff(number[b]) > 0]))
        out[number[b][first]] += np.add.reduceat(marks[at[b]] * weight[b][:, None], first)
    return out


def _machine(z: np.ndarray, y: np.ndarray, cost: float) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps. Of the rarer class each example weighs more."""
    x = np.hstack([z, np.ones((len(z), 1))])
    weight = np.where(y > 0, np.sqrt(max(1, (y < 0).sum()) / max(1, (y > 0).sum())), 1.0) * cost
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    before = None
    for _ in range(30):
        on = y * (x @ w) < 1
        if before is not None and (on == before).all():
            break
        before = on
        xs = x[on] * weight[on][:, None]
        w = np.linalg.solve(ridge + xs.T @ x[on], xs.T @ y[on])
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[float, float]:
    """(slope, shift) of a logistic score that reaches ``threshold`` where the fewest training texts are on the wrong side.

    The cut is the middle of the widest of the best gaps between neighbouring text scores, and the slope makes it three
    logits from the median clean text to the cut.
    """
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(y > 0)]) + (y <= 0).sum() - np.concatenate([[0], np.cumsum(y <= 0)])
    gaps = np.concatenate([[0.0], np.diff(x), [0.0]])
    k = max(np.flatnonzero(wrong == wrong.min()), key=lambda i: gaps[i])
    cut = (x[k - 1] + x[k]) / 2 if 0 < k < len(x) else x[0] if k == 0 else x[-1]
    slope = 3.0 / max(cut - float(np.median(x[y <= 0])), 0.05)
    return slope, float(np.log(threshold / (1 - threshold)) - slope * cut)


def _pieces_of(d: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, word numbers) of all pieces of ``PIECE_SIZES`` bytes of the words, and of shorter words as wholes. Codes are exact."""
    size = np.diff(np.append(starts, len(d)))
    left = np.repeat(starts + size, size) - np.arange(len(d))
    word = np.repeat(np.arange(len(starts)), size)
    x = d.astype(np.uint64)
    codes, words = [], []
    for n in range(1, PIECE_SIZES[1] + 1):
        if n > len(x):
            break
        at = left[: len(x) - n + 1] >= n
        if n < PIECE_SIZES[0]:  # whole words only
            at &= (size[word] == n)[: len(at)] & (left[: len(at)] == n)
        at = np.flatnonzero(at)
        code = np.full(len(at), n, np.uint64) << np.uint64(56)
        for k in range(n):
            code |= x[at + k] << np.uint64(8 * k)
        codes.append(code)
        words.append(word[at])
    return (np.concatenate(codes), np.concatenate(words)) if codes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def train(texts: list[bytes], labels: np.ndarray, settings: Settings = Settings()) -> Model:
    """Learn from texts (lower case, UTF-8) with labels 0 or 1. With one class only every text gets a score near 0.

    Texts are gone through one by one; what is kept of them is their distinct words.
    """
    blank = Model(np.zeros(0, np.int64), np.zeros(0), -1.0, 1.0, -30.0)
    if not (labels > 0).any() or not (labels <= 0).any():
        return blank
    rng = np.random.default_rng(settings.seed)
    name: dict[bytes, bytes] = {}  # one object for each distinct word
    docs: list[list[bytes]] = []
    for t in texts:
        d, starts, _ = words_of(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        raw, ends = d.tobytes(), np.append(starts[1:], len(d))
        docs.append(sorted({name.setdefault(w, w) for w in (raw[a:b] for a, b in zip(starts, ends))}))
    toxic, clean = [w for w, y in zip(docs, labels) if y > 0 and w], [w for w, y in zip(docs, labels) if y <= 0 and w]
    if not toxic or not clean:
        return blank

    # examples: words that clean texts hardly have, with a piece of 4 to 7 bytes that is far more frequent in toxic texts
    def own(doc: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return _pieces_of(np.frombuffer(b"".join(doc), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in doc])])[:-1])

    rate = lambda x, n: (x + 0.5) / (n + 1)
    codes, times = np.unique(np.concatenate([np.unique(own(doc)[0]) for doc in toxic]), return_counts=True)
    often = times >= max(2, settings.support * len(toxic))
    codes, times = codes[often], times[often]
    in_clean = np.zeros(len(codes), np.int64)
    for doc in clean if len(codes) else []:
        found = np.unique(own(doc)[0])
        at = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
        in_clean[at[codes[at] == found]] += 1
    codes = codes[rate(times, len(toxic)) > settings.odds * rate(in_clean, len(clean))]
    often_toxic, often_clean = (Counter(w for doc in group for w in doc) for group in (toxic, clean))
    every = sorted(often_toxic)
    found, number = own(every)
    has = set(number[np.isin(found, codes)].tolist())
    examples = [w for k, w in enumerate(every) if k in has and rate(often_toxic[w], len(toxic)) > settings.odds / 4 * rate(often_clean[w], len(clean))]
    if not examples:
        return blank
    pool = sorted(often_clean)
    single = [w for w in pool if often_clean[w] == 1]
    counter = {w for w, _ in sorted(often_clean.items(), key=lambda x: (-x[1], x[0]))[: settings.counterexamples]}
    counter |= {single[k] for k in rng.choice(len(single), min(settings.counterexamples // 2, len(single)), replace=False)}
    half = settings.landmarks // 2
    marks = sorted(examples, key=lambda w: (-often_toxic[w], w))[: half // 2]
    others = sorted(set(examples) - set(marks))
    marks += [others[k] for k in rng.choice(len(others), min(half - len(marks), len(others)), replace=False)]
    marks += sorted(counter - set(examples), key=lambda w: (-often_clean[w], w))[: half // 2]
    model = blank
    for _ in range(settings.rounds):
        negative = sorted(counter - set(examples))
        number, code, weight = _features(marks)
        codes, at = np.unique(code, return_inverse=True)
        if not len(codes):
            return blank
        table = np.zeros((len(codes), len(marks)))
        np.add.at(table, (at, number), weight)
        lam, u = np.linalg.eigh(_kernel(marks, codes, table))
        whiten = u / np.sqrt(np.maximum(lam, 0) + settings.ridge)
        z = _kernel(examples + negative, codes, table) @ whiten
        w, bias = _machine(z, np.concatenate([np.ones(len(examples)), -np.ones(len(negative))]), settings.cost)
        model = Model(codes.astype(np.int64), table @ (whiten @ w), bias, 1.0, 0.0)
        known = model.known()
        hard = Counter()
        for doc in clean:
            scores = _scores_of(doc, model, known)
            hard.update(doc[k] for k in np.argsort(-scores, kind="stable")[:5] if scores[k] > -1)
        new = [w for w, _ in sorted(hard.items(), key=lambda x: (-x[1], x[0])) if w not in set(marks)]
        counter |= set(hard)
        marks += new[: half // settings.rounds]
    known = model.known()
    whole = np.empty(len(texts))
    for k, t in enumerate(texts):
        scores, _, _, bounds = word_scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]), model, known)
        whole[k] = text_scores(scores, bounds, model.bias)[0]
    slope, shift = _logistic(whole, labels, settings.threshold)
    return Model(model.codes, model.weights, model.bias, slope, shift)


def _scores_of(words: list[bytes], model: Model, known: np.ndarray) -> np.ndarray:
    """Scores of single words."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    d = data[V.NOT_BLANK[data]]
    size = np.array([len(w) for w in words])
    return _word_scores(d, np.concatenate([[0], np.cumsum(size)])[:-1], model, known)


def fit(rows: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from rows (text, label), a bounded sample, which are gathered in one task; whole texts. Null texts teach nothing."""

    def learn(columns: dict[str, list]) -> Model:
        pairs = sorted(zip(columns["text"], columns["label"]))  # whatever order rows came in
        return train([t.encode() for t, _ in pairs], np.array([y for _, y in pairs]), settings)

    known = rows.where(F.col("label").isNotNull() & F.col("text").isNotNull())
    return fitted(known.select(F.lower("text").alias("text"), F.when(F.col("label") > 0, 1).otherwise(0).alias("label")), learn)


RESULT = "score double, predicted int, worst_word string"


def scored(text: Column, model: Model, spark: SparkSession, threshold: float = Settings.threshold) -> Column:
    """A struct of score (0 to 1), predicted (1 from ``threshold``) and worst_word; all other columns of a row stay in the JVM.

    Texts without words, null too, get the score of a word without any known subsequence and no worst word. Of equally bad words
    the first is named. Whole texts are scored; a text is cut at no length. Repeated rows get equal results.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def toxic_score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        known = m.known()
        for texts in batches:
            data, offsets = V.column(texts)
            score, worst = [], []
            for lo, hi in V.pieces(offsets):
                at = offsets[lo : hi + 1]
                scores, d, starts, bounds = word_scores(data[at[0] : at[-1]], at - at[0], m, known)
                x = text_scores(scores, bounds, m.bias)
                score.append(1 / (1 + np.exp(-np.clip(m.slope * x + m.shift, -30, 30))))
                ends = np.append(starts[1:], len(d))
                first = [a + int(scores[a:b].argmax()) if b > a else -1 for a, b in zip(bounds[:-1], bounds[1:])]
                worst += [d[starts[k] : ends[k]].tobytes().decode("utf-8", "replace") if k >= 0 else None for k in first]
            p = np.concatenate(score) if score else np.zeros(0)
            fields = [pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(worst, pa.string())]
            yield pa.StructArray.from_arrays(fields, ["score", "predicted", "worst_word"])

    return toxic_score(F.lower(text))


def predict(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = (), threshold: float = Settings.threshold) -> DataFrame:
    """Columns ``keep`` of ``df`` and the fields of ``scored``; columns of equal names are an error."""
    found = df.select(*[F.col(c) for c in keep], scored(F.col(text), model, df.sparkSession, threshold).alias(free_name(keep)))
    return with_fields(found, keep)


def fit_labelled(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """The model of ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic), from rows that are not held out.

    The sample is chosen among the labels, so only its ids, about ``Settings.sample``, are broadcast, and no text is shuffled.
    """
    rows = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("label"))
    chosen = sample_by_label(rows, "label", settings.sample, ["doc_id"])
    return fit(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label"), settings)


def op4_subsequence_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``, learnt from labelled rows that are not held out.

    Of rows of ``labels`` for one doc_id the toxic one counts. Other columns of the tables, whatever their names, are not read.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_labelled(docs, read_table(spark, sf_dir, "labels"))
    found = predict(docs, model, keep=("doc_id",))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "worst_word")
