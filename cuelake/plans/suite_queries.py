"""Queries of suites of cases and of edits at a time, each with its DuckDB twin. A suite is five media's remainder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.functions.time import rounded
from cuelake.operators import cues as C
from cuelake.operators import metrics as M
from cuelake.operators import suites as S
from cuelake.plans.interval_queries import _DIST, _EDITED, _GAPS, _TURNS, CUE, ORACLES, R3, R6, _edit, _sides, _turns, query
from cuelake.tables import cue_view, table

def _suite(n: int = 5) -> Column:
    return (F.col("media_id") % n).alias("suite")


_ERRORS = f"""{CUE}, e AS (SELECT media_id, (start_time - lag(start_time) OVER (PARTITION BY media_id ORDER BY start_time, ord)) / 86400.0::DOUBLE - 1.0::DOUBLE AS error FROM cue),
s AS (SELECT media_id, count(error) AS n, {R6("avg(abs(error))")} AS mean_absolute, {R6("median(abs(error))")} AS median_absolute, {R6("max(abs(error))")} AS maximum_absolute, {R6("avg(error)")} AS mean_signed,
count(*) FILTER (abs(error) <= 0.25::DOUBLE + 1e-9) AS within_250ms, count(*) FILTER (abs(error) <= 0.5::DOUBLE + 1e-9) AS within_500ms, count(*) FILTER (abs(error) <= 1.0::DOUBLE + 1e-9) AS within_1000ms FROM e GROUP BY 1)"""


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("start_time").over(Window.partitionBy("media_id").orderBy("start_time", "ord"))
    days = (F.col("start_time") - before) / 86400.0 - 1.0
    return S.error_statistics(cue_view(spark, sf_dir).withColumn("error", days), ["media_id"], "error")


def _three(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c)) for c in columns})


@query(
    f"""WITH {_ERRORS} SELECT media_id, n, {R3("mean_absolute")} AS mean_absolute, {R3("median_absolute")} AS median_absolute, {R3("maximum_absolute")} AS maximum_absolute, {R3("mean_signed")} AS mean_signed,
within_250ms, within_500ms, within_1000ms FROM s"""
)
def timing_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the days between cues against one day: mean, median, greatest, and how many are small."""
    return _three(_errors(spark, sf_dir), "mean_absolute", "median_absolute", "maximum_absolute", "mean_signed")


@query(
    f"""WITH {_ERRORS} SELECT media_id % 5 AS suite, count(*) AS cases, sum(n)::BIGINT AS n, {R3("sum(CASE WHEN n > 0 THEN mean_absolute * n END) / sum(CASE WHEN mean_absolute IS NOT NULL THEN n END)")} AS mean_absolute, {R3("max(maximum_absolute)")} AS maximum_absolute,
sum(within_250ms)::BIGINT AS within_250ms, {R3("sum(within_250ms) * 100.0::DOUBLE / sum(n)")} AS within_250ms_percent, sum(within_500ms)::BIGINT AS within_500ms, {R3("sum(within_500ms) * 100.0::DOUBLE / sum(n)")} AS within_500ms_percent,
sum(within_1000ms)::BIGINT AS within_1000ms, {R3("sum(within_1000ms) * 100.0::DOUBLE / sum(n)")} AS within_1000ms_percent FROM s GROUP BY 1"""
)
def suite_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.summarise_errors(_errors(spark, sf_dir).withColumn("suite", _suite()), ["suite"])
    return _three(found, *[c for c in found.columns if c.endswith(("absolute", "percent"))])


@query(
    f"""WITH c AS ({ORACLES["missed_speech"]}) SELECT media_id % 5 AS suite, {R3("sum(speech)")} AS speech, {R3("sum(missed)")} AS missed, {R3("sum(missed) / nullif(sum(speech), 0)")} AS missed_share,
{R3("sum(over_silence)")} AS over_silence, sum(mostly_silent)::BIGINT AS mostly_silent FROM c GROUP BY 1"""
)
def suite_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _three(M.speech_coverage(*_sides(spark, sf_dir)), "speech", "missed", "over_silence")
    return _three(S.summarise_speech(cases.withColumn("suite", _suite()), ["suite"]), "speech", "missed", "missed_share", "over_silence")


_OVER = lambda c: f"sum(greatest(0, {c} - coalesce(r_{c}, 0)))::BIGINT"


@query(
    f"""WITH {_TURNS}, c AS (SELECT conv_id, turn, strlen(text) AS units, turn % 3 AS adjacent, turn % 7 AS said, lag(turn % 3) OVER (PARTITION BY conv_id ORDER BY turn) AS r_adjacent, lag(turn % 7) OVER (PARTITION BY conv_id ORDER BY turn) AS r_said FROM t)
SELECT turn AS suite, count(*) AS cases, sum(units)::BIGINT AS units, sum(adjacent)::BIGINT AS adjacent, {_OVER("adjacent")} AS excess_adjacent, sum(said)::BIGINT AS said, {_OVER("said")} AS excess_said,
{R6("sum(adjacent)::DOUBLE / nullif(sum(units), 0)")} AS adjacent_rate, {R6(_OVER("adjacent") + "::DOUBLE / nullif(sum(units), 0)")} AS excess_adjacent_rate,
{R6("sum(said)::DOUBLE / nullif(sum(units), 0)")} AS said_rate, {R6(_OVER("said") + "::DOUBLE / nullif(sum(units), 0)")} AS excess_said_rate FROM c GROUP BY 1"""
)
def suite_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of repeats by the turn's place; what a turn has beyond the one before is excess. The counts stand for measured ones."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = _turns(spark, sf_dir).withColumns({"units": F.octet_length("text"), "adjacent": F.col("turn") % 3, "said": F.col("turn") % 7})
    c = c.withColumns({f"reference_{x}": F.coalesce(F.lag(x).over(w), F.lit(0)) for x in ("adjacent", "said")})
    return S.summarise_repeats(c.withColumn("suite", F.col("turn")), ["suite"])


@query(
    f"""WITH {_GAPS}, d AS (SELECT media_id, {_DIST("gap")} FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT media_id % 20 AS suite, sum(n)::BIGINT AS n, min(minimum) AS minimum, max(maximum) AS maximum, {R3("sum(mean * n) / sum(n)")} AS mean, CASE WHEN count(*) = 1 THEN max(median) END AS median FROM d GROUP BY 1"""
)
def suite_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _three(M.gap_statistics(cue_view(spark, sf_dir)), "minimum", "maximum", "mean", "median")
    return _three(S.summarise_distributions(d.withColumn("suite", _suite(20)), ["suite"]), "mean")


@query(
    f"""WITH {CUE}, d AS (SELECT media_id, text AS stage, lead(start_time) OVER (PARTITION BY media_id ORDER BY start_time) - start_time AS s FROM cue), o AS (SELECT media_id, stage, {R3("sum(s)")} AS seconds FROM d WHERE s IS NOT NULL AND media_id % 3 <> length(stage) % 3 GROUP BY 1, 2),
n AS (SELECT media_id % 5 AS suite, count(DISTINCT media_id) AS cases FROM cue GROUP BY 1), m AS (SELECT media_id % 5 AS suite, stage, {R3("sum(seconds)")} AS measured, count(*) AS measured_cases FROM o GROUP BY 1, 2)
SELECT suite, stage, measured, measured_cases, cases - measured_cases AS missing_cases, CASE WHEN cases = measured_cases THEN measured END AS total FROM m JOIN n USING (suite)"""
)
def suite_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of each stage of a suite; cases that did not measure a stage are counted as missing."""
    cues = cue_view(spark, sf_dir)
    each = _three(M.stage_durations(cues.withColumnRenamed("text", "stage"), "media_id", "stage", "start_time"), "seconds")
    each = each.where(F.col("media_id") % 3 != F.length("stage") % 3)
    found = S.summarise_stages(each.withColumn("suite", _suite()), cues.select("media_id", _suite()), ["suite"], "media_id")
    return _three(found, "measured", "total")


@query(
    """WITH m AS (SELECT c_custkey AS id, count(*) AS manifest_rows FROM customer GROUP BY 1), r AS (SELECT user_id * 2 AS id, count(*) AS run_rows FROM events GROUP BY 1)
SELECT id, CASE WHEN id IS NULL THEN 'unnamed' WHEN manifest_rows IS NULL THEN 'unknown' WHEN run_rows IS NULL THEN 'missing' WHEN manifest_rows > 1 OR run_rows > 1 THEN 'duplicate' ELSE 'ok' END AS status,
coalesce(manifest_rows, 0) AS manifest_rows, coalesce(run_rows, 0) AS run_rows FROM m FULL JOIN r USING (id)"""
)
def suite_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a manifest (customers) and of a run (events of users): unknown, missing, duplicate or right."""
    manifest, run = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "events").select((F.col("user_id") * 2).alias("id"))
    return S.joined_cases(manifest, run, "id")


@query(f"WITH {CUE} SELECT media_id, greatest(30.0::DOUBLE, {R3('arg_max(end_time, (start_time, end_time, ord))')}) AS extent FROM cue GROUP BY 1")
def timeline_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three(C.extent(cue_view(spark, sf_dir)), "extent")


@query(
    f"""WITH {CUE}, p AS (SELECT DISTINCT media_id, end_time + 5.0::DOUBLE AS t FROM cue WHERE text = 'click')
SELECT media_id, {R3("t")} AS t, {R3("(SELECT min(c.start_time) FROM cue c WHERE c.media_id = p.media_id AND c.start_time > p.t + 0.05::DOUBLE)")} AS next_start,
{R3("(SELECT arg_max(c.start_time, (c.start_time, c.end_time, c.ord)) FROM cue c WHERE c.media_id = p.media_id AND c.end_time < p.t - 0.05::DOUBLE)")} AS previous_start FROM p"""
)
def neighbour_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cues that a jump forward and back from a time reaches."""
    cues = cue_view(spark, sf_dir)
    probes = cues.where("text = 'click'").select("media_id", (F.col("end_time") + 5.0).alias("t")).distinct()
    return _three(C.neighbours(cues, probes), "t", "next_start", "previous_start")


@query(
    f"""WITH {CUE}, p AS (SELECT media_id, ord, greatest(0.0::DOUBLE, {R3("start_time")}) AS a, (ord % 30 * 86400.0::DOUBLE) + 1.0::DOUBLE AS d FROM cue)
SELECT media_id, ord, CASE WHEN a >= d THEN {R3("d - 0.1::DOUBLE")} ELSE a END AS start_time, least(d, {R3("a + 2.0::DOUBLE")}) AS end_time, 'New subtitle' AS text FROM p"""
)
def cue_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cue that is added at a time of a media whose length is known."""
    c = cue_view(spark, sf_dir)
    return c.select("media_id", "ord", C.new_at(F.col("start_time"), F.col("ord") % 30 * 86400.0 + 1.0).alias("x")).select("media_id", "ord", "x.*")


@query(
    _EDITED(
        f"""SELECT media_id, ord, start_time, end_time, text FROM tagged UNION ALL SELECT media_id, (SELECT max(ord) + 1 FROM cue, one WHERE media_id = one.m), {R3("end_time + 0.1::DOUBLE")}, {R3("end_time + 2.0::DOUBLE")}, 'New subtitle' FROM tagged WHERE is_it"""
    )
)
def cue_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edit(spark, sf_dir, lambda cues, m, o: C.insert_beside(cues, m, o, after=True))


@query(
    f"""WITH {CUE}, n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_time, end_time, ord) AS i, count(*) OVER (PARTITION BY media_id) AS size FROM cue), f AS (SELECT min(media_id) AS m FROM cue)
SELECT media_id, ord, CASE WHEN media_id = m AND size >= 2 AND i = 1 THEN 2 WHEN media_id = m AND size >= 2 AND i = 2 THEN 1 ELSE i END AS index FROM n, f"""
)
def cue_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first cue of the least media one place down."""
    cues = C.renumber(cue_view(spark, sf_dir))
    first = cues.agg(F.min("media_id")).first()[0]
    return C.moved(cues, first, 1, down=True).select("media_id", "ord", F.col("index").cast("bigint").alias("index"))


@query(
    f"WITH {CUE} SELECT media_id, ord, ord % 4 IN (0, 3) AS kept FROM cue WHERE end_time > start_time"
)
def stale_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of one word each: as before, with another text, starting a minute later, starting a little earlier. Do their words stay?"""
    c = cue_view(spark, sf_dir).where("end_time > start_time")
    word = F.struct((F.col("start_time") + 1.0).alias("start_time"), F.col("end_time").alias("end_time"), F.col("text").alias("text"))
    before = c.withColumns({"words": F.array(word), "confidence": F.lit(0.5)})
    k = F.col("ord") % 4
    start = F.when(k == 2, F.col("start_time") + 60.0).when(k == 3, F.col("start_time") - 1.0).otherwise(F.col("start_time"))
    after = before.withColumns({"text": F.when(k == 1, F.concat(F.lit("no "), "text")).otherwise(F.concat("text", F.lit(" "))), "start_time": start})
    return C.without_stale_words(before, after).select("media_id", "ord", (F.col("words").isNotNull() & F.col("confidence").isNotNull()).alias("kept"))


@query(
    f"WITH {CUE}, n AS (SELECT media_id, ord, start_time, lead(start_time) OVER (PARTITION BY media_id ORDER BY start_time) AS after FROM cue) SELECT media_id, ord FROM n WHERE after IS NULL OR after - start_time >= 3600.0::DOUBLE"
)
def debounced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that nothing follows for an hour."""
    return S.debounced(cue_view(spark, sf_dir), "media_id", "start_time", 3600.0).select("media_id", "ord")


@query(
    """WITH e AS (SELECT user_id % 5 AS suite, event_type AS kind, strlen(props) AS b FROM events) SELECT suite, kind, count(*) AS messages, sum(b)::BIGINT AS bytes FROM e GROUP BY 1, 2
UNION ALL SELECT suite, NULL, count(*), sum(b)::BIGINT FROM e GROUP BY 1"""
)
def message_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and their bytes by suite and kind, and of all kinds."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("suite"), F.col("event_type").alias("kind"), "props")
    return S.message_totals(e, ["suite"], "kind", F.octet_length("props"))


@query(None)
def word_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time errors of the words of each turn against those of the turn before, half a second a word."""
    t = _turns(spark, sf_dir).withColumns({"before": F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), "case_id": F.concat_ws("-", "conv_id", "turn")})
    said = lambda c, late: t.select("case_id", F.posexplode(F.split(T.collapse(F.col(c)), " ")).alias("ord", "text")).select(
        "case_id", "ord", (F.col("ord") * 0.5 + late).alias("start_time"), (F.col("ord") * 0.5 + late + 0.4).alias("end_time"), "text"
    )
    return S.word_timing(said("before", 0.0), said("text", 0.1), "case_id")
