"""Queries over the cue view and the text tables, each with its DuckDB twin.

Both sides round alike: floor(x * 10^p + 0.5) / 10^p in doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.functions.time import format_duration, milliseconds, parse_timestamp, rounded, srt_timestamp, vtt_timestamp
from cuelake.operators import cues as C
from cuelake.operators import folds
from cuelake.operators import intervals as I
from cuelake.operators import metrics as M
from cuelake.operators import recognition as R
from cuelake.operators import windows as W
from cuelake.tables import cue_sql, cue_view, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CUE = f"cue AS ({cue_sql()})"
R3 = lambda x: f"floor(({x}) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE"
R6 = lambda x: f"floor(({x}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"
#: Union of a CTE's valid intervals by media, as CTE ``name``.
UNION = lambda name, source, gap=0: f"""
{name}_m AS (SELECT *, max(end_time) OVER (PARTITION BY media_id ORDER BY start_time, end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM {source} WHERE start_time >= 0 AND end_time > start_time),
{name}_g AS (SELECT *, sum(CASE WHEN seen IS NULL OR start_time - seen > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY start_time, end_time ROWS UNBOUNDED PRECEDING) AS island FROM {name}_m),
{name} AS (SELECT media_id, min(start_time) AS start_time, max(end_time) AS end_time, count(*) AS members FROM {name}_g GROUP BY media_id, island)"""  # noqa: E731
REF = "ref AS (SELECT * FROM cue WHERE text IN ('view', 'click'))"
CAND = "cand AS (SELECT * FROM cue WHERE text IN ('purchase', 'signup'))"


def query(sql: str | None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cues = cue_view(spark, sf_dir)
    return cues.where(F.col("text").isin("view", "click")), cues.where(F.col("text").isin("purchase", "signup"))


@query(f"WITH {CUE} SELECT media_id, ord, row_number() OVER (PARTITION BY media_id ORDER BY start_time, end_time, ord) AS index FROM cue")
def cue_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.renumber(cue_view(spark, sf_dir)).select("media_id", "ord", F.col("index").cast("bigint").alias("index"))


@query(
    f"""WITH {CUE}, s AS (SELECT media_id, ord, greatest(0.0::DOUBLE, {R3("start_time - 3600.0::DOUBLE")}) AS a, greatest(0.0::DOUBLE, {R3("end_time - 3600.0::DOUBLE")}) AS e FROM cue)
SELECT media_id, ord, a AS start_time, greatest(e, {R3("a + 0.1::DOUBLE")}) AS end_time FROM s"""
)
def cue_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.shift(cue_view(spark, sf_dir), -3600_000).select("media_id", "ord", "start_time", "end_time")


#: Cues as a recogniser would give them for windows of an hour with ten minutes on either side, in the windows' own time.
_HEARD = f"""WITH {CUE}, c AS (SELECT *, unnest(range(floor((start_time - 600) / 3600)::BIGINT, floor((start_time + 600) / 3600)::BIGINT + 1)) AS win_id FROM cue),
h AS (SELECT media_id, win_id, ord, text, (start_time - (win_id * 3600.0::DOUBLE - 600.0::DOUBLE)) + (win_id * 3600.0::DOUBLE - 600.0::DOUBLE) AS a,
(end_time - (win_id * 3600.0::DOUBLE - 600.0::DOUBLE)) + (win_id * 3600.0::DOUBLE - 600.0::DOUBLE) AS e, win_id * 3600.0::DOUBLE AS low FROM c WHERE end_time > start_time AND trim(text) <> ''),
o AS (SELECT media_id, win_id, ord, text, {R3("greatest(0.0::DOUBLE, a, low)")} AS start_time, {R3("greatest(0.0::DOUBLE, e)")} AS end_time, a < low AS crosses FROM h WHERE a < low + 3600.0::DOUBLE AND e > a AND"""


def _heard(spark: SparkSession, sf_dir: str, by_word: bool) -> DataFrame:
    win = lambda t: F.floor(t / 3600)
    c = cue_view(spark, sf_dir).withColumn("win_id", F.explode(F.sequence(win(F.col("start_time") - 600), win(F.col("start_time") + 600))))
    low = F.col("win_id") * 3600.0
    c = c.withColumn("chunk", F.struct("ord", "text", (F.col("start_time") - (low - 600.0)).alias("start_time"), (F.col("end_time") - (low - 600.0)).alias("end_time")))
    c = c.groupBy("media_id", "win_id").agg(F.array_sort(F.collect_list("chunk")).alias("chunks"))
    regions = F.lit(None).cast("array<struct<start_time:double,end_time:double>>").alias("regions")
    more = (F.lit(by_word).alias("by_word"), (low - 600.0).alias("shift"), low.alias("core_start"), (low + 3600.0).alias("core_end"), F.lit(True).alias("keep_suffix"), regions)
    return R.segments(c.select("media_id", "win_id", "chunks", F.lit("").alias("text"), *more))


@query(
    _HEARD + """ (a >= low OR e - low + 0.001::DOUBLE >= 0.5::DOUBLE))
SELECT media_id, win_id, row_number() OVER (PARTITION BY media_id, win_id ORDER BY ord) - 1 AS ord, start_time, end_time, text, crosses FROM o WHERE end_time > start_time"""
)
def recognised_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that windows own, with the parts of those that cross into them."""
    return _heard(spark, sf_dir, False).select("media_id", "win_id", F.col("ord").cast("bigint").alias("ord"), "start_time", "end_time", "text", "crosses")


@query(
    _HEARD + """ a >= low)
SELECT media_id, win_id, min(start_time) AS start_time, arg_max(end_time, (start_time, end_time, text)) AS end_time, string_agg(text, ' ' ORDER BY start_time, end_time, text) AS text, count(*) AS words FROM o WHERE end_time > start_time GROUP BY 1, 2"""
)
def recognised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment of the words that each window owns."""
    return _heard(spark, sf_dir, True).select("media_id", "win_id", "start_time", "end_time", "text", F.size("words").cast("bigint").alias("words"))


#: The least cue of the least media, which the edits below are made to.
_FIRST = "one AS (SELECT media_id AS m, ord AS o FROM cue ORDER BY media_id, ord LIMIT 1), tagged AS (SELECT cue.*, media_id = m AND ord = o AS is_it FROM cue, one)"
_EDITED = lambda body: f"WITH {CUE}, {_FIRST}, edited AS ({body}) SELECT media_id, ord, start_time, end_time, text, row_number() OVER (PARTITION BY media_id ORDER BY start_time, end_time, ord) AS index FROM edited"


def _edit(spark: SparkSession, sf_dir: str, change: Callable[[DataFrame, str, int], DataFrame]) -> DataFrame:
    cues = cue_view(spark, sf_dir)
    key = cues.agg(F.min(F.struct("media_id", "ord")).alias("key")).select("key.*").first()
    out = change(cues, key["media_id"], key["ord"]) if key["ord"] is not None else C.renumber(cues)
    return out.select("media_id", "ord", "start_time", "end_time", "text", F.col("index").cast("bigint").alias("index"))


@query(_EDITED("SELECT media_id, ord, start_time, end_time, text FROM tagged WHERE NOT is_it"))
def cue_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edit(spark, sf_dir, C.delete)


@query(_EDITED("SELECT media_id, ord, start_time, CASE WHEN is_it THEN start_time + 1.0::DOUBLE ELSE end_time END AS end_time, CASE WHEN is_it THEN 'edited' ELSE text END AS text FROM tagged"))
def cue_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edit(spark, sf_dir, lambda cues, m, o: C.update(cues, m, o, text=F.lit("edited"), end_time=F.col("start_time") + 1.0))


@query(
    _EDITED(
        f"""SELECT media_id, ord, start_time, end_time, text FROM tagged WHERE NOT is_it UNION ALL SELECT media_id, ord, start_time, end_time, text FROM tagged WHERE is_it
UNION ALL SELECT media_id, ord, a, {R3("a + greatest(0.1::DOUBLE, end_time - start_time)")}, text FROM (SELECT *, {R3("end_time + 0.1::DOUBLE")} AS a FROM tagged WHERE is_it)"""
    )
)
def cue_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edit(spark, sf_dir, C.duplicate)


@query(
    _EDITED(
        """SELECT media_id, ord, CASE WHEN is_it THEN least(start_time, coalesce(s, start_time)) ELSE start_time END AS start_time, CASE WHEN is_it THEN greatest(end_time, coalesce(e, end_time)) ELSE end_time END AS end_time,
CASE WHEN is_it THEN concat_ws(chr(10), text, t) ELSE text END AS text FROM (SELECT *, lead(start_time) OVER w AS s, lead(end_time) OVER w AS e, lead(text) OVER w AS t, coalesce(lag(is_it) OVER w, false) AS gone
FROM tagged WINDOW w AS (PARTITION BY media_id ORDER BY start_time, end_time, ord)) WHERE NOT gone"""
    )
)
def cue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edit(spark, sf_dir, C.merge_with_next)


@query(None)
def phrase_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of 2 to 5 words that whole turns say again at once, and their words."""
    found = _turns(spark, sf_dir).select("conv_id", "turn", M.repeated_phrases(T.tokens(T.comparable(F.col("text")))).alias("x"))
    return found.select("conv_id", "turn", "x.*")


_VALIDATE = f"""{CUE}, w AS (SELECT *, lag(end_time) OVER o AS before, lead(start_time) OVER o AS after FROM cue WINDOW o AS (PARTITION BY media_id ORDER BY start_time, ord)),
issues AS (
SELECT media_id, ord, 'error' AS level, 'negative-time' AS code FROM w WHERE start_time < 0 OR end_time < 0
UNION ALL SELECT media_id, ord, 'error', 'invalid-range' FROM w WHERE end_time <= start_time
UNION ALL SELECT media_id, ord, 'warning', 'empty-text' FROM w WHERE text IS NULL OR trim(text) = ''
UNION ALL SELECT media_id, ord, 'error', 'overlap' FROM w WHERE start_time < before
UNION ALL SELECT media_id, ord, 'error', 'overlap' FROM w WHERE after < end_time)"""


@query(f"WITH {_VALIDATE} SELECT * FROM issues")
def cue_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.validate(cue_view(spark, sf_dir))


@query(
    f"""WITH {_VALIDATE} SELECT media_id, ord, row_number() OVER (PARTITION BY media_id ORDER BY start_time, end_time, ord) AS index
FROM cue WHERE trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM issues i WHERE i.level = 'error' AND i.media_id = cue.media_id AND i.ord = cue.ord)"""
)
def cue_exportable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exportable(cue_view(spark, sf_dir)).select("media_id", "ord", F.col("index").cast("bigint").alias("index"))


def _clock(separator: str, x: str) -> str:
    ms = f"floor({x} * 1000.0::DOUBLE + 0.5::DOUBLE)::BIGINT"
    pad = lambda v, n: f"lpad(({v})::VARCHAR, {n}, '0')"
    hours = f"({ms} // 3600000)"
    return f"CASE WHEN {hours} < 10 THEN {pad(hours, 2)} ELSE {hours}::VARCHAR END || ':' || {pad(f'{ms} // 60000 % 60', 2)} || ':' || {pad(f'{ms} // 1000 % 60', 2)} || '{separator}' || {pad(f'{ms} % 1000', 3)}"


@query(f"WITH {CUE} SELECT media_id, ord, {_clock(',', 'start_time')} AS srt, {_clock('.', 'end_time')} AS vtt FROM cue")
def fmt_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue_view(spark, sf_dir).select("media_id", "ord", srt_timestamp(F.col("start_time")).alias("srt"), vtt_timestamp(F.col("end_time")).alias("vtt"))


@query(f"WITH {CUE} SELECT media_id, ord, {R3('start_time')} AS seconds, floor(end_time * 1000.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS ms FROM cue")
def parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written and parsed again."""
    c = cue_view(spark, sf_dir)
    return c.select("media_id", "ord", parse_timestamp(vtt_timestamp(F.col("start_time"))).alias("seconds"), milliseconds(F.col("end_time")).alias("ms"))


_MS = "floor(greatest(0.0::DOUBLE, end_time - start_time) * 1000.0::DOUBLE + 0.5::DOUBLE)::BIGINT"


@query(
    f"""WITH {CUE}, d AS (SELECT media_id, ord, {_MS} AS ms FROM cue)
SELECT media_id, ord, CASE WHEN ms >= 3600000 THEN CASE WHEN ms < 36000000 THEN '0' ELSE '' END || (ms // 3600000)::VARCHAR || ':' ELSE '' END
|| lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || CASE WHEN ms % 1000 = 0 THEN '' ELSE '.' || lpad((ms % 1000)::VARCHAR, 3, '0') END AS duration FROM d"""
)
def fmt_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue_view(spark, sf_dir).select("media_id", "ord", format_duration(F.col("end_time") - F.col("start_time")).alias("duration"))


@query(f"WITH {CUE}, {UNION('u', 'cue')} SELECT media_id, {R3('start_time')} AS start_time, {R3('end_time')} AS end_time, members FROM u")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.union(cue_view(spark, sf_dir), "media_id").select("media_id", rounded(F.col("start_time")).alias("start_time"), rounded(F.col("end_time")).alias("end_time"), "members")


@query(f"WITH {CUE}, {UNION('u', 'cue', 600)} SELECT media_id, {R3('start_time')} AS start_time, {R3('end_time')} AS end_time, members FROM u")
def session_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues at most ten minutes apart are one session."""
    u = I.union(cue_view(spark, sf_dir), "media_id", gap=600.0)
    return u.select("media_id", rounded(F.col("start_time")).alias("start_time"), rounded(F.col("end_time")).alias("end_time"), "members")


@query(
    f"""WITH {CUE}, {UNION('u', 'cue')}, c AS (SELECT media_id, count(*) AS islands, sum(end_time - start_time) AS covered FROM u GROUP BY media_id),
x AS (SELECT media_id, max(end_time) AS extent FROM cue GROUP BY media_id)
SELECT media_id, islands, {R3('covered')} AS covered, floor(least(1.0::DOUBLE, covered / extent) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS ratio FROM c JOIN x USING (media_id)"""
)
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of each media that its cues cover, and their share of its extent."""
    cues = cue_view(spark, sf_dir)
    extent = cues.groupBy("media_id").agg(F.max("end_time").alias("extent"))
    covered = I.union(cues, "media_id").groupBy("media_id").agg(F.count("*").alias("islands"), F.sum(F.col("end_time") - F.col("start_time")).alias("covered"))
    return covered.join(extent, "media_id").select(
        "media_id", "islands", rounded(F.col("covered")).alias("covered"), rounded(F.least(F.lit(1.0), F.col("covered") / F.col("extent")), 4).alias("ratio")
    )


_BOTH = f"{CUE}, {REF}, {CAND}, {UNION('a', 'ref')}, {UNION('b', 'cand')}, x AS (SELECT a.media_id, greatest(a.start_time, b.start_time) AS start_time, least(a.end_time, b.end_time) AS end_time FROM a JOIN b ON a.media_id = b.media_id AND a.start_time < b.end_time AND b.start_time < a.end_time)"


@query(f"WITH {_BOTH} SELECT media_id, {R3('start_time')} AS start_time, {R3('end_time')} AS end_time FROM x")
def interval_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return I.intersect(a, b, "media_id").select("media_id", rounded(F.col("start_time")).alias("start_time"), rounded(F.col("end_time")).alias("end_time"))


@query(
    f"""WITH {_BOTH}, e AS (SELECT media_id, start_time AS t, 1 AS da, 0 AS db FROM a UNION ALL SELECT media_id, end_time, -1, 0 FROM a
UNION ALL SELECT media_id, start_time, 0, 1 FROM b UNION ALL SELECT media_id, end_time, 0, -1 FROM b),
s AS (SELECT media_id, t, sum(da) AS da, sum(db) AS db FROM e GROUP BY media_id, t),
r AS (SELECT media_id, t, lead(t) OVER w AS u, sum(da) OVER (w ROWS UNBOUNDED PRECEDING) AS a, sum(db) OVER (w ROWS UNBOUNDED PRECEDING) AS b FROM s WINDOW w AS (PARTITION BY media_id ORDER BY t))
SELECT media_id, {R3('t')} AS start_time, {R3('u')} AS end_time FROM r WHERE a > 0 AND b = 0 AND u IS NOT NULL"""
)
def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return I.subtract(a, b, "media_id").select("media_id", rounded(F.col("start_time")).alias("start_time"), rounded(F.col("end_time")).alias("end_time"))


@query(
    f"""WITH {_BOTH}, s AS (SELECT media_id, sum(end_time - start_time) AS speech FROM a GROUP BY 1), c AS (SELECT media_id, sum(end_time - start_time) AS cues FROM b GROUP BY 1),
v AS (SELECT media_id, sum(end_time - start_time) AS covered FROM x GROUP BY 1),
o AS (SELECT k.media_id, k.ord, any_value(k.end_time - k.start_time) AS len, sum(CASE WHEN a.media_id IS NULL THEN 0 ELSE least(k.end_time, a.end_time) - greatest(k.start_time, a.start_time) END) AS shared
  FROM (SELECT * FROM cand WHERE start_time >= 0 AND end_time > start_time) k LEFT JOIN a ON a.media_id = k.media_id AND a.start_time < k.end_time AND k.start_time < a.end_time GROUP BY 1, 2),
z AS (SELECT media_id, count(*) FILTER (shared / len < 0.5) AS mostly_silent FROM o GROUP BY 1)
SELECT media_id, {R3('coalesce(speech, 0)')} AS speech, {R3('coalesce(covered, 0)')} AS covered, {R3('coalesce(speech, 0) - coalesce(covered, 0)')} AS missed,
{R3('coalesce(cues, 0) - coalesce(covered, 0)')} AS over_silence, coalesce(mostly_silent, 0) AS mostly_silent
FROM s FULL JOIN c USING (media_id) LEFT JOIN v USING (media_id) LEFT JOIN z USING (media_id)"""
)
def missed_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.speech_coverage(*_sides(spark, sf_dir))
    return found.select("media_id", *[rounded(F.col(c)).alias(c) for c in ("speech", "covered", "missed", "over_silence")], "mostly_silent")


@query(
    f"""WITH {CUE}, v AS (SELECT * FROM cue WHERE start_time >= 0 AND end_time > start_time),
p AS (SELECT a.media_id, count(*) AS pairs, sum(least(a.end_time, b.end_time) - greatest(a.start_time, b.start_time)) AS seconds
FROM v a JOIN v b ON a.media_id = b.media_id AND a.ord < b.ord AND a.start_time < b.end_time AND b.start_time < a.end_time GROUP BY 1)
SELECT media_id, coalesce(pairs, 0) AS pairs, {R3('coalesce(seconds, 0)')} AS seconds FROM (SELECT DISTINCT media_id FROM cue) LEFT JOIN p USING (media_id)"""
)
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.overlaps(cue_view(spark, sf_dir)).select("media_id", "pairs", rounded(F.col("seconds")).alias("seconds"))


_GAPS = f"{CUE}, g AS (SELECT media_id, lead(start_time) OVER (PARTITION BY media_id ORDER BY start_time, end_time, ord) - end_time AS gap FROM cue WHERE start_time >= 0 AND end_time > start_time)"
_DIST = lambda x: f"count({x}) AS n, " + ", ".join(f"{R3(R6(f'{f}({x})'))} AS {n}" for f, n in (("min", "minimum"), ("max", "maximum"), ("avg", "mean"), ("median", "median")))


@query(f"WITH {_GAPS} SELECT media_id, {_DIST('gap')}, count(*) FILTER (gap < 0) AS negative, count(*) FILTER (gap = 0) AS zero, count(*) FILTER (gap > 0) AS positive FROM g WHERE gap IS NOT NULL GROUP BY 1")
def gap_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.gap_statistics(cue_view(spark, sf_dir))
    return d.select("media_id", "n", *[rounded(F.col(c)).alias(c) for c in ("minimum", "maximum", "mean", "median")], "negative", "zero", "positive")


@query(f"WITH {CUE} SELECT media_id, {_DIST('end_time - start_time')} FROM cue GROUP BY 1")
def duration_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.distribution(cue_view(spark, sf_dir).withColumn("seconds", F.col("end_time") - F.col("start_time")), ["media_id"], "seconds")
    return d.select("media_id", "n", *[rounded(F.col(c)).alias(c) for c in ("minimum", "maximum", "mean", "median")])


@query(
    f"""WITH {CUE}, s AS (SELECT * FROM cue WHERE text = 'purchase'), t AS (SELECT DISTINCT media_id, start_time AS b FROM cue WHERE text = 'view'),
n AS (SELECT s.media_id, s.ord, (arg_min(b, (abs(b - s.start_time), b))) AS near, min(abs(b - s.start_time)) AS d FROM s LEFT JOIN t ON s.media_id = t.media_id GROUP BY 1, 2)
SELECT media_id, ord, CASE WHEN d <= 3600 THEN {R3('near')} END AS nearest FROM n"""
)
def nearest_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = cue_view(spark, sf_dir)
    found = I.nearest(cues.where("text = 'purchase'").select("media_id", "ord", "start_time"), cues.where("text = 'view'").select("media_id", F.col("start_time").alias("b")), "media_id", "start_time", "b", 3600.0)
    return found.select("media_id", "ord", rounded(F.col("nearest")).alias("nearest"))


@query(
    f"""WITH {CUE}, p AS (SELECT media_id, ord, start_time + 30.0::DOUBLE AS t FROM cue WHERE text = 'click')
SELECT p.media_id, p.ord AS probe, (SELECT arg_min(c.ord, (c.start_time, c.end_time, c.ord)) FROM cue c WHERE c.media_id = p.media_id AND p.t BETWEEN c.start_time AND c.end_time) AS active FROM p"""
)
def active_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = cue_view(spark, sf_dir)
    probes = cues.where("text = 'click'").select("media_id", F.col("ord").alias("probe"), (F.col("start_time") + 30.0).alias("t"))
    return C.active_at(cues, probes).select("media_id", "probe", "active")


@query(
    """WITH d AS (SELECT c_custkey AS media_id, (c_custkey % 300 + 10)::DOUBLE AS duration FROM customer), w AS (SELECT media_id, duration, unnest(range(ceil(duration / 18.0)::BIGINT)) AS win_id FROM d)
SELECT media_id, win_id::INT AS win_id, win_id * 18.0::DOUBLE AS core_start, least(duration, (win_id + 1) * 18.0::DOUBLE) AS core_end,
greatest(0.0::DOUBLE, win_id * 18.0::DOUBLE - 4.0::DOUBLE) AS slice_start, least(duration, least(duration, (win_id + 1) * 18.0::DOUBLE) + 4.0::DOUBLE) AS slice_end FROM w"""
)
def tumbling_overlap_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("media_id"), (F.col("c_custkey") % 300 + 10).cast("double").alias("duration"))
    return W.plan(media, 26.0, 4.0).select("media_id", "win_id", "core_start", "core_end", "slice_start", "slice_end")


@query(
    f"""WITH s AS (SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, avg(value * value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS m FROM events)
SELECT media_id, k AS frame_start, {R3('sqrt(m)')} AS rms FROM s WHERE k % 2 = 0"""
)
def sliding_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").select(F.col("user_id").alias("media_id"), F.col("event_id").alias("ord"), F.col("value").alias("sample"))
    return W.sliding_rms(samples, "media_id", 5, 2).select("media_id", F.col("frame_start").cast("bigint").alias("frame_start"), rounded(F.col("rms")).alias("rms"))


@query("SELECT user_id AS media_id, (list_sort(list(value)))[(floor(0.2 * (count(*) - 1)))::INT + 1] AS noise FROM events GROUP BY 1")
def noise_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").withColumns({"nth": F.row_number().over(by.orderBy("value")), "n": F.count("*").over(by)})
    return e.where(F.col("nth") == F.floor(F.lit(0.2) * (F.col("n") - 1)) + 1).select(F.col("user_id").alias("media_id"), F.col("value").alias("noise"))


@query(
    """WITH e AS (SELECT user_id AS media_id, event_id AS ord, value > 20 AS loud FROM events),
i AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY ord) - row_number() OVER (PARTITION BY media_id, loud ORDER BY ord) AS island FROM e)
SELECT media_id, min(ord) AS first, max(ord) AS last, count(*) AS frames FROM i WHERE loud GROUP BY media_id, island"""
)
def rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("media_id"), F.col("event_id").alias("ord"), (F.col("value") > 20).alias("loud"))
    return W.runs(e, "media_id", "ord", "loud")


_TURNS = "t AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL)"
_NORM = "trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "text")


def _norm_text(t: DataFrame) -> DataFrame:
    return t.select("conv_id", "turn", T.comparable(F.col("text")).alias("norm"))


def _distinct_candidates(t: DataFrame) -> DataFrame:
    return C.distinct_candidates(t.withColumn("ord", F.col("turn")), ["conv_id"]).select("conv_id", "turn")


def _token_similarity(t: DataFrame) -> DataFrame:
    k = t.select("conv_id", "turn", T.tokens(T.comparable(F.col("text"))).alias("x"))
    p = k.join(k.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y")), ["conv_id", "turn"]).where((F.size("x") > 0) & (F.size("y") > 0))
    x, y = F.col("x"), F.col("y")
    return p.select("conv_id", "turn", rounded(T.token_similarity(x, y), 6).alias("token_similarity"), rounded(T.dice(x, y), 6).alias("dice"))


def _adjacent_repeats(t: DataFrame) -> DataFrame:
    t = t.withColumn("w", T.tokens(T.comparable(F.col("text"))))
    return t.select("conv_id", "turn", T.adjacent_repeats(F.col("w")).cast("bigint").alias("repeats"))


@query(f"WITH {_TURNS} SELECT conv_id, turn, {_NORM} AS norm FROM t")
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _norm_text(_turns(spark, sf_dir))


@query(
    f"""WITH {_TURNS}, n AS (SELECT conv_id, turn, {_NORM} AS norm FROM t), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, norm ORDER BY turn) AS nth FROM n WHERE norm <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM f WHERE nth = 1) SELECT conv_id, turn FROM r WHERE k <= 3"""
)
def distinct_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinct_candidates(_turns(spark, sf_dir))


_PAIRS = f"""{_TURNS}, k AS (SELECT conv_id, turn, list_filter(string_split({_NORM}, ' '), lambda x: x <> '') AS w FROM t),
p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
c AS (SELECT conv_id, turn, sum(least(nx, ny)) AS shared FROM (SELECT p.conv_id, p.turn, u.token, len(list_filter(x, lambda z: z = u.token)) AS nx, len(list_filter(y, lambda z: z = u.token)) AS ny FROM p, unnest(list_distinct(x)) AS u(token)) GROUP BY 1, 2)"""


@query(
    f"""WITH {_PAIRS} SELECT p.conv_id, p.turn, {R6("coalesce(shared, 0)::DOUBLE / greatest(len(x), len(y))")} AS token_similarity, {R6("2.0::DOUBLE * coalesce(shared, 0) / (len(x) + len(y))")} AS dice
FROM p LEFT JOIN c USING (conv_id, turn) WHERE len(x) > 0 AND len(y) > 0"""
)
def token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_similarity(_turns(spark, sf_dir))


@query(None)
def char_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance of neighbouring turns, whole texts of any script. SQL takes it of bytes, so there is no twin."""
    t = _turns(spark, sf_dir).withColumnRenamed("text", "x")
    p = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y")), ["conv_id", "turn"]).where(F.length("x") > 0)
    d = F.levenshtein("x", "y")
    return p.select("conv_id", "turn", d.cast("bigint").alias("distance"), M.error_rate(d, F.length("x")).alias("cer"))


@query(None)
def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutions, deletions and insertions between neighbouring turns, whole texts of any script."""
    t = _turns(spark, sf_dir).select("conv_id", "turn", T.tokens(T.comparable(F.col("text"))).alias("x"))
    p = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y")), ["conv_id", "turn"])
    return M.word_errors(p.withColumn("case_id", F.concat_ws("-", "conv_id", "turn")), "case_id", "x", "y")


@query(f"WITH {_TURNS}, k AS (SELECT conv_id, turn, list_filter(string_split({_NORM}, ' '), lambda x: x <> '') AS w FROM t) SELECT conv_id, turn, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS repeats FROM k")
def adjacent_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjacent_repeats(_turns(spark, sf_dir))


@query(
    """WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS ord, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS cues, count(*) FILTER (length(line) > 42) AS wide, count(*) FILTER (trim(line) = '') AS blank, max(length(line)) AS longest FROM l GROUP BY 1"""
)
def line_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("cues"), F.count_if(F.length("line") > 42).alias("wide"), F.count_if(F.trim("line") == "").alias("blank"), F.max(F.length("line")).cast("bigint").alias("longest")
    )


@query(
    f"""WITH {CUE}, e AS (SELECT media_id, text AS stage, lead(start_time) OVER (PARTITION BY media_id ORDER BY start_time) - start_time AS s FROM cue)
SELECT media_id, stage, {R3('sum(s)')} AS seconds FROM e WHERE s IS NOT NULL GROUP BY 1, 2"""
)
def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.stage_durations(cue_view(spark, sf_dir).withColumnRenamed("text", "stage"), "media_id", "stage", "start_time")
    return found.select("media_id", "stage", rounded(F.col("seconds")).alias("seconds"))


@query("SELECT user_id AS media_id, event_id AS ord, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS progress FROM events")
def running_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("media_id"), F.col("event_id").alias("ord"), "value")
    return M.running_progress(e, "media_id", "ord", "value").select("media_id", "ord", "progress")


@query(
    """WITH e AS (SELECT user_id AS media_id, event_id AS ord, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth, sum(strlen(props)) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS bytes FROM events)
SELECT media_id, ord FROM e WHERE nth <= 20 AND (bytes <= 150 OR nth = 1)"""
)
def ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("media_id"), F.col("event_id").alias("ord"), "props")
    return M.last_events(e, "media_id", "ord", F.octet_length("props"), 20, 150).select("media_id", "ord")


_CASES = "c AS (SELECT user_id AS media_id, count(*) FILTER (event_type = 'error') AS errors, count(*) AS words FROM events GROUP BY 1)"


@query(f"WITH {_CASES} SELECT media_id % 5 AS suite, count(*) AS cases, {R6('sum(errors)::DOUBLE / sum(words)')} AS rate, {R6('max(errors::DOUBLE / words)')} AS worst FROM c GROUP BY 1")
def suite_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("media_id")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("words"))
    return c.groupBy((F.col("media_id") % 5).alias("suite")).agg(
        F.count("*").alias("cases"), M.suite(c, "errors", "words").alias("rate"), rounded(F.max(F.col("errors") / F.col("words")), 6).alias("worst")
    )


@query(
    f"""WITH a AS (SELECT user_id AS media_id, count(*)::DOUBLE AS n, sum(value) AS total FROM events WHERE event_type = 'view' GROUP BY 1),
b AS (SELECT user_id AS media_id, count(*)::DOUBLE AS n, sum(value) AS total FROM events WHERE event_type = 'click' GROUP BY 1),
l AS (SELECT media_id, 'n' AS path, a.n AS x, b.n AS y FROM a FULL JOIN b USING (media_id) UNION ALL SELECT media_id, 'total', a.total, b.total FROM a FULL JOIN b USING (media_id))
SELECT media_id, path, {R3('x')} AS baseline, {R3('y')} AS candidate, {R3('y - x')} AS difference, {R3('(y - x) * 100.0::DOUBLE / abs(nullif(x, 0))')} AS percent FROM l"""
)
def report_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    side = lambda kind: e.where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("media_id")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    found = M.compare_reports(side("view"), side("click"), "media_id")
    return found.select("media_id", "path", *[rounded(F.col(c)).alias(c) for c in ("baseline", "candidate", "difference", "percent")])


def _fold_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue_view(spark, sf_dir, 60.0)


@query(
    f"""WITH RECURSIVE {CUE.replace("300.0", "60.0")}, o AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_time, end_time, ord) AS k FROM cue),
f AS (SELECT media_id, ord, k, {R3("start_time")} AS s, {R3(f"greatest(end_time, {R3('start_time')} + 1.1::DOUBLE)")} AS e FROM o WHERE k = 1
UNION ALL SELECT o.media_id, o.ord, o.k, CASE WHEN {R3("o.start_time")} < f.e + 0.08::DOUBLE THEN {R3("f.e + 0.08::DOUBLE")} ELSE {R3("o.start_time")} END,
CASE WHEN {R3("o.start_time")} < f.e + 0.08::DOUBLE THEN greatest({R3(f"greatest(o.end_time, {R3('o.start_time')} + 1.1::DOUBLE)")}, {R3(f"{R3('f.e + 0.08::DOUBLE')} + 1.1::DOUBLE")})
ELSE {R3(f"greatest(o.end_time, {R3('o.start_time')} + 1.1::DOUBLE)")} END FROM f JOIN o ON o.media_id = f.media_id AND o.k = f.k + 1)
SELECT media_id, ord, {R3("s")} AS start_time, {R3("e")} AS end_time FROM f"""
)
def pushed_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues pushed forward so that none overlaps the one before: each depends on what became of the last."""
    return folds.fold(_fold_input(spark, sf_dir), folds.pushed_apart).select("media_id", "ord", "start_time", "end_time")


@query(None)
def spaced_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold(_fold_input(spark, sf_dir), folds.spaced)


@query(None)
def without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold(_fold_input(spark, sf_dir), folds.without_repeats)


@query(None)
def packed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues packed into windows of at most 29 seconds."""
    cues = cue_view(spark, sf_dir, 0.5)
    extent = cues.groupBy("media_id").agg(F.max("end_time").alias("duration"))
    return W.pack(cues.join(extent, "media_id"))


@query(None)
def cue_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onset and offset errors of cues that are aligned by their texts."""
    a, b = ((x.withColumn("tokens", F.array("text", F.lit("cue"))) for x in _sides(spark, sf_dir)))
    return M.cue_timing(a, b)


@query(None)
def uncovered_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.uncovered(*_sides(spark, sf_dir), "media_id")


@query(None)
def srt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SubRip file of each media, written and parsed again."""
    from cuelake.sources import captions

    return captions.parse_captions(C.to_srt(cue_view(spark, sf_dir)), "srt")


@query(None)
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations broken into two caption lines."""
    return _turns(spark, sf_dir).select("conv_id", "turn", T.wrap(F.col("text"), 42).alias("wrapped"))


@query(None)
def dominant_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").withColumn("w", T.tokens(T.comparable(F.col("text"))))
    return t.select("conv_id", "turn", T.dominant_repetition(F.col("w")).alias("repetition"))


@query(
    f"""WITH {CUE}, v AS (SELECT *, end_time - start_time AS s, length(text) AS n, start_time >= 0 AND end_time > start_time AND trim(text) <> '' AS ok FROM cue)
SELECT media_id, count(*) AS cues, count(*) FILTER (NOT ok) AS invalid, count(*) FILTER (ok AND n / s > 21.0::DOUBLE + 1e-9) AS fast, {R3("max(CASE WHEN ok THEN n / s END)")} AS fastest,
count(*) FILTER (ok AND n > 42) AS wide, 0 AS tall, count(*) FILTER (ok AND s < 60.0::DOUBLE - 1e-9) AS short, count(*) FILTER (ok AND s > 7200.0::DOUBLE + 1e-9) AS long FROM v GROUP BY 1"""
)
def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.quality(cue_view(spark, sf_dir), least=60.0, most=7200.0).withColumn("fastest", rounded(F.col("fastest"))).withColumn("tall", F.col("tall").cast("int"))


@query(None)
def formatted_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, 30 seconds each, as readable captions."""
    from cuelake.operators.formatting import format_captions

    t = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    start = F.col("turn") * 30.0
    return format_captions(t.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("ord"), start.alias("start_time"), (start + 29.0).alias("end_time"), "text"))


@query(None)
def snapped_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of cues snapped to the other borders of their media, at a scale of one pixel a second."""
    from cuelake.operators import timeline

    cues = cue_view(spark, sf_dir)
    joined = cues.join(timeline.targets(cues), "media_id")
    at = timeline.with_ends(F.col("targets"), F.lit(None), F.lit(None), F.col("ord"))
    return joined.select("media_id", "ord", timeline.snap(F.col("start_time"), at, F.lit(1.0)).alias("snapped"))
