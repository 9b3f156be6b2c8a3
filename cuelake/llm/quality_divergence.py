"""Quality rules by distribution divergence. JVM side only: one scan learns the references, one judges, no Python.

A document's histograms of character classes and of common words are compared with those of language references by the
Jensen-Shannon distance (base 2: 0 equal, 1 disjoint). Short documents have too few words for a histogram and are not judged by it.

A reference is the mean histogram of all documents of a language that are long enough and no heaps of symbols, each counting once. For the languages of
``COMMON`` fixed shares stand in with the weight of ``PRIOR`` documents, so that a small table does not judge itself. A document is
compared with the classes of its own language; without one, with the nearest of ``COMMON``. Languages without a word list are judged
by their classes alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.columns import BLANKS, read_table, words

#: The commonest words of each language, commonest first.
COMMON = {
    "en": "the of and to a in is that it for was on with as be by".split(),
    "fr": "de la le et les des en un du une que pour est dans qui par".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem".split(),
    "es": "de la que el en y los se las del por un con no una para".split(),
}
#: Before documents are seen, the share of the commonest word in running text; the n-th commonest has a 1/n of it (Zipf's law).
TOP_SHARE = 0.055
#: Documents that the fixed shares count as.
PRIOR = 50
#: Documents with a greater share of symbols teach nothing.
MOST_SYMBOLS = 0.02
#: Languages whose references are kept at most; more are an error.
MOST_LANGUAGES = 512
#: Before documents are seen, shares of lower case, upper case, sentence punctuation, digits, symbols and anything else among the characters of words.
CLASSES = {"lower": 0.9535, "upper": 0.0165, "point": 0.0275, "digit": 0.0015, "symbol": 0.0005, "other": 0.0005}


@dataclass(frozen=True)
class Limits:
    """A document is far off beyond one of the first two distances, or beyond both of the next two.

    ``min_words`` guards the word histogram, ``min_chars`` the other one: a shorter text is not judged by it.
    """

    max_class_distance: float = 0.24
    max_word_distance: float = 0.30
    both_class_distance: float = 0.18
    both_word_distance: float = 0.25
    min_words: int = 80
    min_chars: int = 100


def _term(p: Column, q: Column | float) -> Column:
    """What a bin with shares p > 0 and q adds to twice the Jensen-Shannon divergence in bits; q may be 0."""
    q = F.lit(q) if isinstance(q, float) else q
    m = (p + q) / 2
    return p * F.log2(p / m) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)


def _distance(twice: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), twice / 2)))


def fixed_words(lang: str) -> dict[str, float]:
    return {w: round(TOP_SHARE / (i + 1), 6) for i, w in enumerate(COMMON[lang])}


@dataclass(frozen=True)
class References:
    """Shares by language: ``classes`` of character classes, ``words`` of the common words (languages of ``COMMON`` only)."""

    classes: dict[str, dict[str, float]] = field(default_factory=lambda: {k: dict(CLASSES) for k in COMMON})
    words: dict[str, dict[str, float]] = field(default_factory=lambda: {k: fixed_words(k) for k in COMMON})


def class_distance(p: Column, q: Column) -> Column:
    """Distance between two arrays of shares of character classes."""
    parts = F.zip_with(p, q, lambda x, y: F.when(x > 0, _term(x, y)).otherwise(y))  # an empty bin adds q * log2(q / (q / 2)) = q
    return _distance(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))


def own_class_distance(p: Column, q: Column | None, lang: Column | None, classes: dict[str, dict[str, float]]) -> Column:
    """Distance of the shares ``p`` to ``q``, those of the row's language, null for none; to the nearest of ``COMMON`` without a language."""
    near = F.array_min(F.transform(F.array(*[F.array(*[F.lit(float(classes[k][c])) for c in CLASSES]) for k in COMMON]), lambda x: class_distance(p, x)))
    return near if lang is None else F.when(lang.isNull(), near).when(q.isNotNull(), class_distance(p, q))


def word_distance(runs: Column, n: Column, shares: dict[str, float]) -> Column:
    """Distance between the common words of a document, ``runs`` of (word, n), and a language's; all other words are one bin."""
    known = F.create_map(*[F.lit(x) for w, q in shares.items() for x in (w, q)])
    rest = 1.0 - sum(shares.values())
    own = F.filter(runs, lambda r: r["word"].isin(*shares))
    seen = F.aggregate(
        own,
        F.struct(F.lit(0.0).alias("twice"), F.lit(0.0).alias("q"), F.lit(0.0).alias("p")),
        lambda a, r: F.struct(
            (a["twice"] + _term(r["n"] / n, F.element_at(known, r["word"]))).alias("twice"),
            (a["q"] + F.element_at(known, r["word"])).alias("q"),
            (a["p"] + r["n"] / n).alias("p"),
        ),
        lambda a: a["twice"] + (F.lit(1.0 - rest) - a["q"]) + F.when(a["p"] < 1, _term(1 - a["p"], rest)).otherwise(rest),
    )
    return F.when(n > 0, _distance(seen))


def run_starts(w: str) -> Column:
    """Places, from 1, at which the runs of equal words of the sorted array column ``w`` start."""
    starts = f"filter(sequence(1, size({w})), k -> k = 1 OR {w}[k - 1] <> {w}[k - 2])"
    return F.expr(f"CASE WHEN size({w}) = 0 THEN CAST(array() AS array<int>) ELSE {starts} END")


#: Up to so many distinct repeated windows their places are found by search in a list, beyond by sorting all windows.
FEW_REPEATS = 64


def repeated_words(h: str) -> Column:
    """Words in 3-word windows that are found twice or more, the first included, from the window hashes ``h`` in order.

    Most texts repeat no window, which their distinct hashes show. In others the places of the repeated hashes are taken, by
    sorting (hash, place) pairs where there are many, so that the work is n log n in the text's length.
    """
    twice = f"array_distinct(transform(filter(sequence(1, size({h}) - 1), k -> s[k] = s[k - 1]), k -> s[k]))"
    few = f"filter(sequence(0, size({h}) - 1), i -> array_contains(d, {h}[i]))"
    pairs = f"array_sort(transform({h}, (x, i) -> struct(x AS h, i AS i)))"
    near = "(k > 1 AND p[k - 1].h = p[k - 2].h) OR (k < size(p) AND p[k - 1].h = p[k].h)"
    many = f"transform(array({pairs}), p -> array_sort(transform(filter(sequence(1, size(p)), k -> {near}), k -> p[k - 1].i)))[0]"
    covered = "aggregate(sequence(1, size(at)), 0, (a, k) -> a + CASE WHEN k < size(at) THEN least(3, at[k] - at[k - 1]) ELSE 3 END)"
    return F.expr(
        f"CASE WHEN size(array_distinct({h})) = size({h}) THEN 0 ELSE "
        f"transform(transform(transform(array(sort_array({h})), s -> {twice}), "
        f"d -> CASE WHEN size(d) <= {FEW_REPEATS} THEN {few} ELSE {many} END), at -> {covered})[0] END"
    ).cast("bigint")


def histograms(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the words, their number and characters, the common ones and the counts of character classes. Null text has none."""
    common = sorted({w for ws in COMMON.values() for w in ws})
    df = df.withColumn("_w", words(F.col(text)))
    df = df.withColumns({"n_words": F.size("_w").cast("bigint"), "_joined": F.array_join("_w", ""), "_common": F.filter("_w", lambda x: x.isin(*common))})
    df = df.withColumns({"word_chars": F.length("_joined").cast("bigint"), "_rest": F.regexp_replace("_joined", "\\p{Ll}+", "")})
    left = lambda c, pattern: F.length(F.regexp_replace(c, pattern, ""))
    return df.withColumns(
        {
            "_n_rest": F.length("_rest"),
            "n_symbols": (F.length("_rest") - left("_rest", "[#*$%&|<>]")).cast("bigint"),
            "_upper": F.length("_rest") - left("_rest", "\\p{Lu}"),
            "_point": F.length("_rest") - left("_rest", "[.,;:!?'\"()-]"),
            "_digit": F.length("_rest") - left("_rest", "[0-9]"),
        }
    )


def class_counts() -> dict[str, Column]:
    """Counts of the classes of ``CLASSES`` from the columns of ``histograms``."""
    other = F.col("_n_rest") - F.col("_upper") - F.col("_point") - F.col("_digit") - F.col("n_symbols")
    return {"lower": F.col("word_chars") - F.col("_n_rest"), "upper": F.col("_upper"), "point": F.col("_point"), "digit": F.col("_digit"), "symbol": F.col("n_symbols"), "other": other}


def learnt(df: DataFrame, text: str = "text", lang: str = "lang", limits: Limits = Limits()) -> References:
    """References from all documents with a language, enough words and at most ``MOST_SYMBOLS`` symbols: one scan, one aggregation of the shares of a few names.

    Documents without language or text teach nothing; repeated rows count as often as they come. An empty table gives the fixed shares.
    """
    rows = histograms(df.where(F.col(lang).isNotNull()).select(F.col(lang).alias("_lang"), F.col(text).alias("_text")), "_text")
    teaches = (F.col("n_words") >= limits.min_words) & (F.col("n_symbols") <= MOST_SYMBOLS * F.col("word_chars"))
    one = lambda kind, name, share: F.struct(F.lit(kind).alias("kind"), name.alias("name"), share.cast("double").alias("share"))
    classes = [one("class", F.lit(k), n / F.col("word_chars")) for k, n in class_counts().items()]
    all_shares = F.concat(F.array(*classes, one("docs", F.lit(""), F.lit(1.0))), F.transform("_common", lambda w: one("word", w, 1 / F.col("n_words"))))
    # a filter would be pushed below the histograms and compute them a second time; rows that teach nothing give a null
    found = rows.select("_lang", F.explode_outer(F.when(teaches, all_shares)).alias("x"))
    sums = found.groupBy("_lang", "x.kind", "x.name").agg(F.sum("x.share").alias("share"))
    names = len(CLASSES) + 2 + len({w for ws in COMMON.values() for w in ws})
    got = sums.limit(MOST_LANGUAGES * names + 1).collect()  # a row for each language and name; more languages than the bound are an error
    shares = {(r["_lang"], r["kind"], r["name"]): r["share"] for r in got}
    langs = {r["_lang"] for r in got if r["kind"] == "docs"}
    if len(langs) > MOST_LANGUAGES or len(got) > MOST_LANGUAGES * names:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    fixed = References()

    def mean(k: str, kind: str, name: str, before: float | None) -> float:
        docs = shares.get((k, "docs", ""), 0.0)
        total = shares.get((k, kind, name), 0.0)
        return round(total / docs if before is None else (total + PRIOR * before) / (docs + PRIOR), 6)

    return References(
        {k: {c: mean(k, "class", c, fixed.classes[k][c] if k in COMMON else None) for c in CLASSES} for k in sorted({*COMMON, *langs})},
        {k: {w: mean(k, "word", w, q) for w, q in fixed.words[k].items()} for k in COMMON},
    )


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts and histograms that the verdict needs. Null text counts as text without words."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = histograms(df, text).withColumn("_lines", lines)
    df = df.withColumns(
        {
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_hashes": F.transform("_w", lambda x: F.xxhash64(x)),
            "_common": F.array_sort("_common"),
        }
    )
    windows = F.expr(
        "CASE WHEN size(_hashes) < 4 THEN CAST(array() AS array<bigint>) ELSE "
        "transform(sequence(1, size(_hashes) - 2), i -> xxhash64(_hashes[i - 1], _hashes[i], _hashes[i + 1])) END"
    )
    df = df.withColumn("_windows", windows).withColumns({"n_repeat_words": repeated_words("_windows"), "_starts": run_starts("_common")})
    runs = F.expr("transform(_starts, (p, j) -> struct(_common[p - 1] AS word, coalesce(get(_starts, j + 1), size(_common) + 1) - p AS n))")
    return df.withColumn("_runs", runs)


def judge(df: DataFrame, text: str = "text", limits: Limits = Limits(), lang: str | None = None, references: References = References()) -> DataFrame:
    """``df`` with word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words, class_distance, word_distance, nearest_lang,
    base_failed and kept.

    Null and blank texts have no words, no distances (null) and fail the base rules. Languages are compared in the order of
    ``COMMON``; the first nearest one wins a tie. With ``lang``, the name of a column, rows of a language without a reference are not
    judged by it: word_distance and nearest_lang are null where it has no word list, class_distance where no document taught it. Every
    row is judged on its own, so repeated rows get equal verdicts.
    """
    df = features(df, text)
    language = F.col(lang) if lang else None
    by_lang = [F.struct(word_distance(F.col("_runs"), F.col("n_words"), references.words[k]).alias("d"), F.lit(i).alias("i"), F.lit(k).alias("lang")) for i, k in enumerate(COMMON)]
    near = F.array_min(F.array(*by_lang))
    if language is not None:
        near = F.when(language.isNull() | language.isin(*COMMON), near)
    own = None
    if language is not None:
        own = F.try_element_at(F.create_map(*[x for k, q in references.classes.items() for x in (F.lit(k), F.array(*[F.lit(float(q[c])) for c in CLASSES]))]), language)
    shares = F.when(F.col("word_chars") > 0, F.array(*[n / F.col("word_chars") for n in class_counts().values()]))
    df = df.withColumns({"_p": shares, "_q": own if own is not None else F.lit(None).cast("array<double>")})  # columns first: each is used many times
    distance = F.when(F.col("_p").isNotNull(), own_class_distance(F.col("_p"), F.col("_q"), language, references.classes))
    df = df.withColumns({"class_distance": distance, "_near": near})
    enough_chars, enough_words = F.col("word_chars") >= limits.min_chars, F.col("n_words") >= limits.min_words
    far_class = enough_chars & (F.col("class_distance") > limits.max_class_distance)
    far_words = enough_words & (F.col("_near.d") > limits.max_word_distance)
    far_both = enough_chars & enough_words & (F.col("class_distance") > limits.both_class_distance) & (F.col("_near.d") > limits.both_word_distance)
    df = df.withColumns(
        {
            "word_distance": F.col("_near.d"),
            "nearest_lang": F.when(F.col("_near.d").isNotNull(), F.col("_near.lang")),
            "base_failed": (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50),
            "_far": F.coalesce(far_class, F.lit(False)) | F.coalesce(far_words, F.lit(False)) | F.coalesce(far_both, F.lit(False)),
        }
    )
    df = df.withColumn("kept", ~F.col("base_failed") & ~F.col("_far"))
    return df.drop("_w", "_lines", "_joined", "_hashes", "_windows", "_common", "_rest", "_starts", "_runs", "_n_rest", "_upper", "_point", "_digit", "_p", "_q", "_near", "_far")


def op7_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict on every whole text of ``documents``; only doc_id, text and lang are read."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs, lang="lang", references=learnt(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "word_distance", "nearest_lang",
    )
