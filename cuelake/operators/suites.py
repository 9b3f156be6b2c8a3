"""Errors of matched times, and summaries of a suite's cases: one row a case in, one row a suite out, by partial aggregation.

Means of cases are weighted by what was matched in them. A median of medians is none: it is kept only where one case has rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.functions.time import metric, ratio
from cuelake.operators import intervals
from cuelake.operators.metrics import align

#: Seconds within which an error counts as small.
TOLERANCES = (0.25, 0.5, 1.0)


def tolerance_key(seconds: float) -> str:
    return f"within_{int(seconds * 1000 + 0.5)}ms"


def error_statistics(df: DataFrame, by: list[str], error: str, tolerances: tuple[float, ...] = TOLERANCES) -> DataFrame:
    """(by, n, mean_absolute, median_absolute, maximum_absolute, mean_signed, within_...) of signed errors; null errors do not count."""
    x = F.abs(F.col(error))
    return df.groupBy(*by).agg(
        F.count(x).alias("n"), metric(F.avg(x)).alias("mean_absolute"), metric(F.median(x)).alias("median_absolute"), metric(F.max(x)).alias("maximum_absolute"),
        metric(F.avg(error)).alias("mean_signed"), *[F.count_if(x <= t + 1e-9).alias(tolerance_key(t)) for t in tolerances],
    )


def timed_tokens(words: DataFrame, key: str) -> DataFrame:
    """(key, tokens, starts, ends): the tokens of each case's valid words in order, each with its word's times.

    ``words`` has (key, ord, start_time, end_time, text). Words without text or with no valid interval have no tokens.
    """
    kept = words.where(intervals.valid(F.col("start_time"), F.col("end_time")) & F.col("text").isNotNull())
    each = kept.select(key, "ord", "start_time", "end_time", F.posexplode(T.tokens(T.scored(F.col("text")))).alias("nth", "token"))
    rows = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "nth", "token", "start_time", "end_time"))).alias("x"))
    return rows.select(key, F.col("x.token").alias("tokens"), F.col("x.start_time").alias("starts"), F.col("x.end_time").alias("ends"))


def word_timing(reference: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """(key, reference_words, candidate_words, matched, match_ratio, start and end errors) of words aligned by their tokens.

    A case is a row of two token arrays; its words are aligned in order and only equal ones matched. Cases without reference tokens
    give no row; those without candidate tokens have zero matches and null errors.
    """
    a = timed_tokens(reference, key)
    b = timed_tokens(candidate, key).select(key, *[F.col(c).alias(f"{c}_b") for c in ("tokens", "starts", "ends")])
    none = {c: F.coalesce(c, F.array().cast(kind)) for c, kind in (("tokens_b", "array<string>"), ("starts_b", "array<double>"), ("ends_b", "array<double>"))}
    cases = a.join(b, key, "left").withColumns(none)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                pairs = [(i, j) for op, i, j in align(list(r.tokens), list(r.tokens_b)) if op == "equal"]
                errors = [{"start_error": float(r.starts_b[j] - r.starts[i]), "end_error": float(r.ends_b[j] - r.ends[i])} for i, j in pairs]
                out.append((getattr(r, key), len(r.tokens), len(r.tokens_b), errors))
            yield pd.DataFrame(out, columns=[key, "reference_words", "candidate_words", "errors"])

    kind = cases.schema[key].dataType.simpleString()
    found = cases.mapInPandas(run, f"{key} {kind}, reference_words bigint, candidate_words bigint, errors array<struct<start_error:double,end_error:double>>")
    abs_of = lambda name: F.transform(F.col(f"errors.{name}"), F.abs)
    mean_of = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(xs), F.lit(0))
    n = F.size("errors").cast("bigint")
    return found.select(
        key, "reference_words", "candidate_words", n.alias("matched"), ratio(n, F.col("reference_words")).alias("match_ratio"),
        metric(mean_of(abs_of("start_error"))).alias("start_mean"), metric(F.array_max(abs_of("start_error"))).alias("start_max"),
        metric(mean_of(abs_of("end_error"))).alias("end_mean"), metric(F.array_max(abs_of("end_error"))).alias("end_max"),
    )


def weighted_mean(value: str, weight: str) -> Column:
    """Mean of cases by weight; cases without value or weight do not count."""
    counts = F.col(value).isNotNull() & (F.col(weight) > 0)
    return ratio(F.sum(F.when(counts, F.col(value) * F.col(weight))), F.sum(F.when(counts, F.col(weight))).cast("double"))


def summarise_errors(cases: DataFrame, by: list[str], tolerances: tuple[float, ...] = TOLERANCES) -> DataFrame:
    """Suites' rows from the rows of ``error_statistics``: weighted mean, greatest error, share of errors within each tolerance."""
    n = F.sum("n")
    shares = [x for t in tolerances for x in (F.sum(tolerance_key(t)).alias(tolerance_key(t)), ratio(F.sum(tolerance_key(t)) * 100.0, n.cast("double")).alias(f"{tolerance_key(t)}_percent"))]
    return cases.groupBy(*by).agg(F.count("*").alias("cases"), n.alias("n"), weighted_mean("mean_absolute", "n").alias("mean_absolute"), metric(F.max("maximum_absolute")).alias("maximum_absolute"), *shares)


def summarise_speech(cases: DataFrame, by: list[str]) -> DataFrame:
    """Suites' rows from those of ``metrics.speech_coverage``: sums, and rates of the sums."""
    total = lambda c: F.sum(c)
    return cases.groupBy(*by).agg(
        metric(total("speech")).alias("speech"), metric(total("missed")).alias("missed"), ratio(total("missed"), total("speech")).alias("missed_share"),
        metric(total("over_silence")).alias("over_silence"), total("mostly_silent").alias("mostly_silent"),
    )


def summarise_repeats(cases: DataFrame, by: list[str]) -> DataFrame:
    """Suites' rows from cases with (units, adjacent, said, reference_adjacent, reference_said).

    Excess is what the candidate repeats beyond its reference, at least zero in each case.
    """
    over = lambda c: F.greatest(F.lit(0), F.col(c) - F.col(f"reference_{c}"))
    units = F.sum("units").cast("double")
    sums = {"adjacent": F.sum("adjacent"), "excess_adjacent": F.sum(over("adjacent")), "said": F.sum("said"), "excess_said": F.sum(over("said"))}
    rates = [ratio(x.cast("double"), units).alias(f"{name}_rate") for name, x in sums.items()]
    return cases.groupBy(*by).agg(F.count("*").alias("cases"), F.sum("units").alias("units"), *[x.cast("bigint").alias(name) for name, x in sums.items()], *rates)


def summarise_distributions(cases: DataFrame, by: list[str]) -> DataFrame:
    """Suites' rows from (n, minimum, maximum, mean, median); cases with n = 0 do not count. The median is null for two cases or more."""
    has = F.col("n") > 0
    return cases.groupBy(*by).agg(
        F.sum("n").alias("n"), metric(F.min(F.when(has, F.col("minimum")))).alias("minimum"), metric(F.max(F.when(has, F.col("maximum")))).alias("maximum"),
        weighted_mean("mean", "n").alias("mean"), F.when(F.count_if(has) == 1, F.max(F.when(has, F.col("median")))).alias("median"),
    )


def summarise_stages(stages: DataFrame, cases: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, stage, measured, measured_cases, missing_cases, total): seconds of each stage of a suite.

    ``stages`` has (by, key, stage, seconds); ``cases`` all cases, (by, key). ``total`` is null unless every case measured the stage.
    """
    size = cases.select(*by, key).distinct().groupBy(*by).agg(F.count("*").alias("_all"))
    one = stages.where(F.col("seconds").isNotNull()).groupBy(*by, key, "stage").agg(F.sum("seconds").alias("seconds"))
    sums = one.groupBy(*by, "stage").agg(metric(F.sum("seconds")).alias("measured"), F.count("*").alias("measured_cases")).join(size, by)
    missing = F.col("_all") - F.col("measured_cases")
    return sums.select(*by, "stage", "measured", "measured_cases", missing.alias("missing_cases"), F.when(missing == 0, F.col("measured")).alias("total"))


def performance(telemetry: DataFrame, processing: str = "processing_ms", audio: str = "audio_seconds") -> DataFrame:
    """``telemetry`` with ``real_time_factor``: seconds of work for each second of audio, null without either."""
    return telemetry.withColumn("real_time_factor", ratio(F.col(processing) / 1000.0, F.col(audio)))


def joined_cases(manifest: DataFrame, run: DataFrame, key: str) -> DataFrame:
    """(key, status, manifest_rows, run_rows) of each id of either side.

    ``unknown``: in the run alone; ``missing``: in the manifest alone; ``duplicate``: several rows on a side; else ``ok``. Rows without
    an id are ``unnamed``. One shuffle of counts, which are summed before it.
    """
    side = lambda df, m, r: df.groupBy(key).agg((F.count("*") * m).alias("manifest_rows"), (F.count("*") * r).alias("run_rows"))
    both = side(manifest, 1, 0).unionByName(side(run, 0, 1)).groupBy(key).agg(F.sum("manifest_rows").alias("manifest_rows"), F.sum("run_rows").alias("run_rows"))
    status = (
        F.when(F.col(key).isNull(), "unnamed").when(F.col("manifest_rows") == 0, "unknown").when(F.col("run_rows") == 0, "missing")
        .when((F.col("manifest_rows") > 1) | (F.col("run_rows") > 1), "duplicate").otherwise("ok")
    )
    return both.select(key, status.alias("status"), "manifest_rows", "run_rows")


def debounced(events: DataFrame, key: str, at: str, seconds: float) -> DataFrame:
    """The events of a key after which nothing comes for ``seconds``; of events at one time, one of the last rows."""
    from pyspark.sql import Window

    after = F.lead(at).over(Window.partitionBy(key).orderBy(at))
    return events.withColumn("_after", after).where(F.col("_after").isNull() | (F.col("_after") - F.col(at) >= seconds)).drop("_after")


def message_totals(messages: DataFrame, by: list[str], kind: str, size: Column) -> DataFrame:
    """(by, kind, messages, bytes) and, with a null kind, the totals of ``by``."""
    each = messages.groupBy(*by, kind).agg(F.count("*").alias("messages"), F.sum(size).alias("bytes"))
    return each.unionByName(each.groupBy(*by).agg(F.sum("messages").alias("messages"), F.sum("bytes").alias("bytes")).withColumn(kind, F.lit(None).cast("string")))
