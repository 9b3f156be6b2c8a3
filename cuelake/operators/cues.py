"""Cues: rows (media_id, ord, start_time, end_time, text, ...). Operators work by media and keep other columns.

``ord`` is the input order and the last tie-break of every sort; it also tells cues of a media apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.text import collapse, normalise_lines
from cuelake.functions.time import clamp, rounded, srt_timestamp, vtt_timestamp

MEDIA = "media_id"
LEAST_LENGTH = 0.1


def in_order() -> Window:
    return Window.partitionBy(MEDIA).orderBy("start_time", "end_time", "ord")


def renumber(cues: DataFrame) -> DataFrame:
    """``index``: 1 to n by start, end and input order."""
    return cues.withColumn("index", F.row_number().over(in_order()))


def normalise(cues: DataFrame) -> DataFrame:
    """Times to milliseconds and texts without stray white space."""
    return cues.withColumns({"start_time": rounded(F.col("start_time")), "end_time": rounded(F.col("end_time")), "text": normalise_lines(F.col("text"))})


def is_blank(text: Column) -> Column:
    return text.isNull() | F.coalesce(collapse(text) == "", F.lit(True))


def validate(cues: DataFrame, duration: Column | None = None) -> DataFrame:
    """(media_id, ord, level, code): a row for each issue of a cue.

    Overlap is between neighbours by start time and is an issue of both. ``beyond-duration`` needs a duration.
    """
    start, end = F.col("start_time"), F.col("end_time")
    bad = lambda t: t.isNull() | F.isnan(t) | (F.abs(t) == float("inf"))
    by = Window.partitionBy(MEDIA).orderBy("start_time", "ord")
    rows = cues.withColumns({"_before": F.lag("end_time").over(by), "_after": F.lead("start_time").over(by)})
    issue = lambda cond, level, code: F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code")))
    rules = [
        issue(bad(start) | bad(end), "error", "malformed-time"),
        issue((start < 0) | (end < 0), "error", "negative-time"),
        issue(end <= start, "error", "invalid-range"),
        issue((start > duration) | (end > duration), "warning", "beyond-duration") if duration is not None else F.lit(None),
        issue(is_blank(F.col("text")), "warning", "empty-text"),
        issue(start < F.col("_before"), "error", "overlap"),
        issue(F.col("_after") < end, "error", "overlap"),
    ]
    found = rows.select(MEDIA, "ord", F.explode(F.array_compact(F.array(*rules))).alias("issue"))
    return found.select(MEDIA, "ord", "issue.level", "issue.code")


def exportable(cues: DataFrame) -> DataFrame:
    """Cues without errors and with text, renumbered. Both cues of an overlap go."""
    errors = validate(cues).where("level = 'error'").select(MEDIA, "ord").distinct()
    return renumber(cues.join(errors, [MEDIA, "ord"], "left_anti").where(~is_blank(F.col("text"))))


def with_issues(cues: DataFrame) -> DataFrame:
    """Cues that have any issue, warnings too."""
    return cues.join(validate(cues).select(MEDIA, "ord").distinct(), [MEDIA, "ord"], "left_semi")


def issues_by_cue(cues: DataFrame) -> DataFrame:
    return validate(cues).groupBy(MEDIA, "ord").agg(F.array_sort(F.collect_list(F.struct("level", "code"))).alias("issues"))


def _joined(cues: DataFrame, line: Column, separator: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("index", line.alias("line")))), lambda x: x["line"])
    return exportable(cues).groupBy(MEDIA).agg(F.array_join(lines, separator).alias("body"))


def to_srt(cues: DataFrame) -> DataFrame:
    """(media_id, content): a SubRip file of each media."""
    line = F.concat(F.col("index").cast("string"), F.lit("\n"), srt_timestamp(F.col("start_time")), F.lit(" --> "), srt_timestamp(F.col("end_time")), F.lit("\n"), F.trim("text"))
    return _joined(cues, line, "\n\n").select(MEDIA, F.concat("body", F.lit("\n")).alias("content"))


def to_vtt(cues: DataFrame) -> DataFrame:
    """(media_id, content): a WebVTT file of each media."""
    line = F.concat(vtt_timestamp(F.col("start_time")), F.lit(" --> "), vtt_timestamp(F.col("end_time")), F.lit("\n"), F.trim("text"))
    return _joined(cues, line, "\n\n").select(MEDIA, F.concat(F.lit("WEBVTT\n\n"), "body", F.lit("\n")).alias("content"))


def to_transcript(cues: DataFrame, timestamps: bool = False) -> DataFrame:
    """(media_id, content): a line for each cue, its own line breaks as blanks."""
    text = F.trim(F.regexp_replace("text", "\\s*\\n\\s*", " "))
    line = F.concat(F.lit("["), vtt_timestamp(F.col("start_time")), F.lit("] "), text) if timestamps else text
    return _joined(cues, line, "\n").select(MEDIA, F.col("body").alias("content"))


def shift(cues: DataFrame, milliseconds: float, duration: Column | None = None) -> DataFrame:
    """All times moved, kept within [0, duration], at least a tenth of a second long. Words move along where there are any.

    If a word collapses, the cue's words and confidence go.
    """
    by = milliseconds / 1000.0
    start = clamp(F.col("start_time") + by, duration)
    end = F.greatest(clamp(F.col("end_time") + by, duration), rounded(start + LEAST_LENGTH))
    if duration is not None:
        end = F.least(end, F.coalesce(F.greatest(F.lit(0.0), duration), F.lit(float("inf"))))
        start = F.when(end - start < LEAST_LENGTH, F.greatest(F.lit(0.0), rounded(end - LEAST_LENGTH))).otherwise(start)
    out = cues.withColumns({"start_time": start, "end_time": end})
    if "words" not in cues.columns:
        return out
    moved = lambda w: w.withField("start_time", F.greatest(F.col("start_time"), rounded(w["start_time"] + by))).withField(
        "end_time", F.least(F.col("end_time"), rounded(w["end_time"] + by))
    )
    out = out.withColumn("_words", F.filter(F.transform("words", moved), lambda w: w["end_time"] > w["start_time"]))
    whole = F.size("_words") == F.size("words")
    out = out.withColumn("words", F.when(whole, F.col("_words")))
    if "confidence" in cues.columns:
        out = out.withColumn("confidence", F.when(F.coalesce(whole, F.lit(True)), F.col("confidence")))
    return out.drop("_words")


def drop_blank(cues: DataFrame) -> DataFrame:
    return cues.where(~is_blank(F.col("text")))


def can_split(at: Column, least: float = LEAST_LENGTH) -> Column:
    """May a cue be parted at this time, both sides long enough?"""
    side = max(LEAST_LENGTH, least) - 1e-9
    return F.coalesce(~F.isnan(at) & (at - F.col("start_time") >= side) & (F.col("end_time") - at >= side), F.lit(False))


def split_at(cues: DataFrame, at: Column) -> DataFrame:
    """Cues that ``at`` may part become two, text at the blank nearest to the share of the time; others stay. Words go from both."""
    ratio = (at - F.col("start_time")) / (F.col("end_time") - F.col("start_time"))
    words = F.split(collapse(F.col("text")), " ")
    n = F.greatest(F.lit(1), F.least(F.size(words) - 1, F.round(F.size(words) * ratio).cast("int")))
    one, two = F.array_join(F.slice(words, F.lit(1), n), " "), F.array_join(F.slice(words, n + 1, F.size(words)), " ")
    text = F.col("text")
    part = lambda k, s, e, t: F.struct(F.lit(k).alias("part"), s.alias("start_time"), e.alias("end_time"), t.alias("text"))
    whole = F.array(part(0, F.col("start_time"), F.col("end_time"), text))
    both = F.array(
        part(1, F.col("start_time"), rounded(at), F.when(F.size(words) > 1, one).otherwise(text)),
        part(2, rounded(at), F.col("end_time"), F.when(F.size(words) > 1, two).otherwise(text)),
    )
    kept = [c for c in cues.columns if c not in ("start_time", "end_time", "text", "words", "part")]
    return cues.withColumn("_part", F.explode(F.when(can_split(at), both).otherwise(whole))).select(*kept, "_part.*")


def _is(media_id: str, ord_: int) -> Column:
    """Is this the cue with this key? ``ord`` alone is one of every media."""
    return (F.col(MEDIA) == F.lit(media_id)) & (F.col("ord") == F.lit(ord_))


def merge_with_next(cues: DataFrame, media_id: str, ord_: int) -> DataFrame:
    """This cue of this media and the one after it as one: least start, greatest end, texts on two lines, words of both in a row.

    Other columns are those of the first. The last cue of a media, and all cues of others, stay as they are.
    """
    after = Window.partitionBy(MEDIA).orderBy("index")
    nth = renumber(cues).withColumn("_first", F.coalesce(_is(media_id, ord_), F.lit(False)))
    nth = nth.withColumns({"_gone": F.coalesce(F.lag("_first").over(after), F.lit(False))})
    both = {
        "start_time": F.least("start_time", F.lead("start_time").over(after)),
        "end_time": F.greatest("end_time", F.lead("end_time").over(after)),
        "text": normalise_lines(F.concat_ws("\n", "text", F.lead("text").over(after))),
    }
    if "words" in cues.columns:
        both["words"] = F.coalesce(F.concat("words", F.lead("words").over(after)), "words", F.lead("words").over(after))
    nth = nth.withColumns({c: F.when(F.col("_first"), v).otherwise(F.col(c)) for c, v in both.items()})
    return renumber(nth.where(~F.col("_gone")).drop("_first", "_gone"))


def clip(cues: DataFrame, start: Column, end: Column) -> DataFrame:
    """Cues that overlap [start, end), cut to it."""
    inside = cues.where((F.col("end_time") > start) & (F.col("start_time") < end))
    return inside.withColumns({"start_time": rounded(F.greatest("start_time", start)), "end_time": rounded(F.least("end_time", end))})


def replace_range(cues: DataFrame, replacement: DataFrame, start: float, end: float) -> DataFrame:
    """Cues that overlap the range go, and replacements, cut to it, take their place."""
    kept = cues.where((F.col("end_time") <= start) | (F.col("start_time") >= end))
    return renumber(kept.unionByName(clip(replacement, F.lit(start), F.lit(end)), allowMissingColumns=True))


def update(cues: DataFrame, media_id: str, ord_: int, **patch: Column) -> DataFrame:
    return renumber(cues.withColumns({k: F.when(_is(media_id, ord_), v).otherwise(F.col(k)) for k, v in patch.items()}))


def delete(cues: DataFrame, media_id: str, ord_: int) -> DataFrame:
    return renumber(cues.where(~F.coalesce(_is(media_id, ord_), F.lit(False))))


def duplicate(cues: DataFrame, media_id: str, ord_: int) -> DataFrame:
    """A copy of the cue a tenth of a second after it, as long as it is."""
    length = F.greatest(F.lit(LEAST_LENGTH), F.col("end_time") - F.col("start_time"))
    copy = cues.where(_is(media_id, ord_)).withColumn("_length", length).withColumn("start_time", rounded(F.col("end_time") + LEAST_LENGTH))
    copy = copy.withColumn("end_time", rounded(F.col("start_time") + F.col("_length"))).drop("_length")
    return renumber(cues.unionByName(copy))


def search(cues: DataFrame, query: str) -> DataFrame:
    """Cues whose lower-cased text contains the query."""
    return cues.where(F.contains(F.lower("text"), F.lit(query.strip().lower())))


def active_at(cues: DataFrame, probes: DataFrame, width: float = 600.0) -> DataFrame:
    """``probes`` (media_id, t) with ``active``: the ord of the first cue with start <= t <= end, both included; else null."""
    bucket = lambda t: F.floor(t / width)
    spread = cues.where(F.col("end_time") >= F.col("start_time")).select(
        MEDIA, "ord", "start_time", "end_time", F.explode(F.sequence(bucket(F.col("start_time")), bucket(F.col("end_time")))).alias("_bucket")
    )
    found = probes.withColumn("_bucket", bucket(F.col("t"))).join(spread, [MEDIA, "_bucket"]).where(F.col("t").between(F.col("start_time"), F.col("end_time")))
    first = found.groupBy(MEDIA, "t").agg(F.min(F.struct("start_time", "end_time", "ord"))["ord"].alias("active"))
    return probes.join(first, [MEDIA, "t"], "left")


def changed_rows(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(media_id, ord, change): rows deleted, inserted or edited between two versions of a table."""
    row = lambda df, name: df.select(MEDIA, "ord", F.struct(*columns).alias(name))
    both = row(before, "old").join(row(after, "new"), [MEDIA, "ord"], "full_outer")
    change = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "insert").when(~F.col("old").eqNullSafe(F.col("new")), "edit")
    return both.select(MEDIA, "ord", change.alias("change")).where(F.col("change").isNotNull())


def distinct_candidates(candidates: DataFrame, by: list[str], text: str = "text", most: int = 3) -> DataFrame:
    """First-seen candidates with different texts, empty ones dropped, at most ``most`` of each group, in order."""
    from cuelake.functions.text import comparable

    norm = candidates.withColumn("_norm", comparable(F.col(text))).where(F.col("_norm") != "")
    first = norm.withColumn("_nth", F.row_number().over(Window.partitionBy(*by, "_norm").orderBy("ord"))).where("_nth = 1")
    return first.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("ord"))).where(F.col("_rank") <= most).drop("_norm", "_nth", "_rank")




#: What a cue that is added by hand says, and how long it is.
NEW_TEXT = "New subtitle"
NEW_LENGTH = 2.0


def new_at(at: Column, duration: Column | None = None) -> Column:
    """Struct (start_time, end_time, text) of a cue added at a time: two seconds long, within the media where its length is known.

    At or beyond the end it is the last tenth of a second. A missing or infinite time is zero.
    """
    finite = at.isNotNull() & ~F.isnan(at) & (F.abs(at) < float("inf"))
    start = F.when(finite, F.greatest(F.lit(0.0), rounded(at))).otherwise(0.0)
    end = rounded(start + NEW_LENGTH)
    if duration is not None:
        known = F.coalesce((duration > 0) & ~F.isnan(duration) & (duration < float("inf")), F.lit(False))
        late = known & (start >= duration)
        end = F.when(known, F.least(duration, end)).otherwise(end)
        start = F.when(late, rounded(duration - F.least(F.lit(LEAST_LENGTH), duration))).otherwise(start)
        end = F.when(known, rounded(end)).otherwise(end)
    return F.struct(start.alias("start_time"), end.alias("end_time"), F.lit(NEW_TEXT).alias("text"))


def insert_beside(cues: DataFrame, media_id: str, ord_: int, after: bool) -> DataFrame:
    """A new cue before or after this one, with the next free ``ord`` of the media; other columns null."""
    a, b = F.col("start_time"), F.col("end_time")
    start = b + 0.1 if after else F.greatest(F.lit(0.0), a - 2)
    end = b + 2 if after else F.greatest(start + 1, a - 0.1)
    free = cues.where(F.col(MEDIA) == F.lit(media_id)).agg((F.max("ord") + 1).alias("_free"))
    new = cues.where(_is(media_id, ord_)).join(free).select(MEDIA, F.col("_free").alias("ord"), rounded(start).alias("start_time"), rounded(end).alias("end_time"), F.lit(NEW_TEXT).alias("text"))
    return renumber(cues.unionByName(new, allowMissingColumns=True))


def moved(cues: DataFrame, media_id: str, index: int, down: bool) -> DataFrame:
    """Rows with an ``index`` of which this one and its neighbour change places; the first and the last stay where they cannot go."""
    other = index + 1 if down else index - 1
    size = F.max("index").over(Window.partitionBy(MEDIA))
    here = (F.col(MEDIA) == F.lit(media_id)) & (size >= max(index, other)) & F.lit(other >= 1)
    return cues.withColumn("index", F.when(here & (F.col("index") == index), other).when(here & (F.col("index") == other), index).otherwise(F.col("index")))


def neighbours(cues: DataFrame, probes: DataFrame, slack: float = 0.05) -> DataFrame:
    """``probes`` (media_id, t) with ``next_start`` and ``previous_start``.

    The next cue is the first that starts more than ``slack`` after t; the previous one the last, in order of start, end and ord, that
    ends more than ``slack`` before t. Two as-of joins by one sort each; no pairs are made.
    """
    w = Window.partitionBy(MEDIA)
    key = F.struct("start_time", "end_time", "ord")
    own = lambda at, value: cues.select(MEDIA, F.col(at).alias("_at"), value.alias("_value"), F.lit(False).alias("_probe"))
    ask = lambda at: probes.select(MEDIA, "t", at.alias("_at"), F.lit(True).alias("_probe"))
    ahead = ask(F.col("t") + slack).unionByName(own("start_time", F.col("start_time")), allowMissingColumns=True)
    ahead = ahead.withColumn("next_start", F.last("_value", True).over(w.orderBy(F.desc("_at"), F.desc("_probe")).rowsBetween(Window.unboundedPreceding, -1)))
    back = ask(F.col("t") - slack).unionByName(own("end_time", key), allowMissingColumns=True)
    back = back.withColumn("previous_start", F.max("_value").over(w.orderBy(F.asc("_at"), F.desc("_probe")).rowsBetween(Window.unboundedPreceding, -1))["start_time"])
    nexts = ahead.where("_probe").select(MEDIA, "t", "next_start").distinct()
    befores = back.where("_probe").select(MEDIA, "t", "previous_start").distinct()
    return probes.join(nexts, [MEDIA, "t"], "left").join(befores, [MEDIA, "t"], "left")


def extent(cues: DataFrame, duration: DataFrame | None = None, least: float = 30.0) -> DataFrame:
    """(media_id, extent): the media's length or the end of its last cue, half a minute at least."""
    last = cues.groupBy(MEDIA).agg(F.max(F.struct("start_time", "end_time", "ord"))["end_time"].alias("_last"))
    if duration is None:
        return last.select(MEDIA, F.greatest(F.lit(least), "_last").alias("extent"))
    return last.join(duration, MEDIA, "full_outer").select(MEDIA, F.greatest(F.lit(least), F.coalesce("duration", F.lit(0.0)), F.coalesce("_last", F.lit(0.0))).alias("extent"))


def without_stale_words(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` without the words and confidence of cues whose edit left them behind.

    They stay if the cue is new, if its words are other ones than before, or if its text is the same but for white space and its times
    are the same or still hold all words, a millisecond to spare.
    """
    old = before.select(MEDIA, "ord", F.struct("start_time", "end_time", "text", "words").alias("_old"))
    rows = after.join(old, [MEDIA, "ord"], "left")
    same_text = collapse(F.col("text")).eqNullSafe(collapse(F.col("_old.text")))
    same_time = (F.col("start_time") == F.col("_old.start_time")) & (F.col("end_time") == F.col("_old.end_time"))
    has = F.coalesce(F.size("words") > 0, F.lit(False))
    inside = F.forall("words", lambda x: (x["start_time"] >= F.col("start_time") - 0.001) & (x["end_time"] <= F.col("end_time") + 0.001))
    fresh = has & ~F.col("words").eqNullSafe(F.col("_old.words"))
    keep = F.col("_old").isNull() | fresh | (same_text & (same_time | (has & F.coalesce(inside, F.lit(False)))))
    return rows.withColumns({c: F.when(keep, F.col(c)) for c in ("words", "confidence") if c in after.columns}).drop("_old")
