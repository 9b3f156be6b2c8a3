"""What a recogniser gives for windows of a media, as segments on the media's timeline. Expressions only, no row meets another.

Rows are (media_id, win_id, text, chunks, by_word, shift, core_start, core_end, keep_suffix, regions). ``chunks`` are structs of
text, start_time and end_time in the window's own time, ``shift`` seconds behind the media's. A window owns what begins from ``core_start``
to before ``core_end`` (null: no border). ``regions`` are structs of start_time and end_time with speech.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import glue
from cuelake.functions.time import rounded

#: Seconds of a crossing segment that stay, of speech that is evidence, of a segment without times, and its confidence.
LEAST_SUFFIX, LEAST_EVIDENCE, LONGEST_FALLBACK, FALLBACK_CONFIDENCE = 0.5, 0.5, 8.0, 0.35

_WORDS = "array<struct<text:string,start_time:double,end_time:double>>"
_SEGMENT = f"struct<start_time:double,end_time:double,text:string,confidence:double,crosses:boolean,words:{_WORDS}>"


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def usable_chunks(chunks: Column) -> Column:
    """Chunks with text and a range of finite times, texts trimmed."""
    tidy = F.transform(chunks, lambda c: F.struct(_trimmed(c["text"]).alias("text"), c["start_time"].alias("start_time"), c["end_time"].alias("end_time")))
    ok = lambda c: (F.coalesce(c["text"], F.lit("")) != "") & _finite(c["start_time"]) & _finite(c["end_time"]) & (c["end_time"] > c["start_time"])
    return F.coalesce(F.filter(tidy, ok), F.array().cast(_WORDS))


def owned(chunks: Column, shift: Column, core_start: Column, core_end: Column, keeps: Column) -> Column:
    """Usable chunks on the media's timeline that the window owns, as segments.

    One that begins before the core belongs to the window before; if ``keeps``, its part in the core stays when it is long enough,
    marked ``crosses``, for its text may repeat what that window has.
    """
    low = F.coalesce(core_start, F.lit(float("-inf")))
    at = lambda x: rounded(F.greatest(F.lit(0.0), x))

    def place(c: Column) -> Column:
        start, end = c["start_time"] + shift, c["end_time"] + shift
        return F.struct(
            at(F.greatest(start, low)).alias("start_time"), at(end).alias("end_time"), c["text"].alias("text"), F.lit(None).cast("double").alias("confidence"),
            (start < low).alias("crosses"), F.lit(None).cast(_WORDS).alias("words"),
        )

    def own(c: Column) -> Column:
        start, end = c["start_time"] + shift, c["end_time"] + shift
        inside = (start >= low) | (keeps & (end - low + 0.001 >= LEAST_SUFFIX))
        return (end > start) & inside & (start < F.coalesce(core_end, F.lit(float("inf"))))

    return F.filter(F.transform(F.filter(chunks, own), place), lambda c: c["end_time"] > c["start_time"])


def as_one(segments: Column) -> Column:
    """Segments of single words, sorted by time, as one segment with word times; none of none."""
    times = F.transform(segments, lambda c: F.struct(c["start_time"].alias("start_time"), c["end_time"].alias("end_time"), c["text"].alias("text")))
    words = F.transform(F.array_sort(times), lambda c: F.struct(c["text"].alias("text"), c["start_time"].alias("start_time"), c["end_time"].alias("end_time")))
    one = F.struct(
        words[0]["start_time"].alias("start_time"), F.element_at(words, -1)["end_time"].alias("end_time"), glue(F.transform(words, lambda w: w["text"])).alias("text"),
        F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("crosses"), words.alias("words"),
    )
    return F.when(F.size(segments) > 0, F.array(one)).otherwise(F.array().cast(f"array<{_SEGMENT}>"))


def without_times(text: Column, regions: Column, low: Column, high: Column) -> Column:
    """A text without any usable chunk as one segment of low confidence, if the window's speech is in one piece; else none."""
    top = F.coalesce(high, F.lit(float("inf")))
    cut = F.transform(
        F.coalesce(regions, F.array().cast("array<struct<start_time:double,end_time:double>>")),
        lambda r: F.struct(F.greatest(F.lit(0.0), low, r["start_time"]).alias("start_time"), F.least(top, r["end_time"]).alias("end_time")),
    )
    long = F.array_sort(F.filter(cut, lambda r: r["end_time"] - r["start_time"] >= LEAST_EVIDENCE))
    state = lambda pieces, end: F.struct(pieces.alias("pieces"), end.alias("end"))
    merged = F.aggregate(
        long, state(F.lit(0), F.lit(float("-inf"))), lambda now, r: state(now["pieces"] + F.when(r["start_time"] <= now["end"], 0).otherwise(1), F.greatest(now["end"], r["end_time"]))
    )
    start = long[0]["start_time"]
    end = F.least(top, merged["end"], start + LONGEST_FALLBACK)
    one = F.struct(
        rounded(start).alias("start_time"), rounded(end).alias("end_time"), _trimmed(text).alias("text"), F.lit(FALLBACK_CONFIDENCE).alias("confidence"),
        F.lit(False).alias("crosses"), F.lit(None).cast(_WORDS).alias("words"),
    )
    ok = F.coalesce(text.rlike("[\\p{L}\\p{N}]"), F.lit(False)) & (merged["pieces"] == 1) & (end > start)
    return F.when(ok, F.array(one)).otherwise(F.array().cast(f"array<{_SEGMENT}>"))


def segments(results: DataFrame) -> DataFrame:
    """(media_id, win_id, ord, start_time, end_time, text, confidence, crosses, words) of all windows' results.

    Windows with usable chunks that are all their neighbours' give nothing; those without any give their text if speech shows where it
    belongs. ``ord`` is the place in the window.
    """
    col = F.col
    chunks = usable_chunks(col("chunks"))
    by_word = F.coalesce(col("by_word"), F.lit(False))
    keeps = ~by_word & F.coalesce(col("keep_suffix"), F.lit(False))
    shift = F.coalesce(col("shift"), F.lit(0.0))
    placed = owned(col("_chunks"), shift, col("core_start"), col("core_end"), keeps)
    found = (
        F.when(F.size("_chunks") == 0, without_times(col("text"), col("regions"), F.coalesce(col("core_start"), shift), col("core_end")))
        .when(by_word, as_one(col("_placed")))
        .otherwise(col("_placed"))
    )
    return (
        results.withColumn("_chunks", chunks)
        .withColumn("_placed", placed)
        .select("media_id", "win_id", F.posexplode(found).alias("ord", "_segment"))
        .select("media_id", "win_id", "ord", "_segment.*")
    )
