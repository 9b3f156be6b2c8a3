"""Scores of candidate cues against reference ones, and their roll-ups.

Rates are null, not zero, where there is nothing to divide by. Alignments are grouped Arrow functions, one case a group; everything
else is expressions and joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.text import SPACE
from cuelake.functions.time import metric, ratio
from cuelake.operators import intervals

#: Cells of a cue alignment beyond which it is not computed, as in the scorer's contract.
CELLS = 1_000_000


def error_rate(distance: Column, size: Column) -> Column:
    return ratio(distance.cast("double"), size.cast("double"))


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, minimum, maximum, mean and median of a column, six places."""
    x = F.col(value)
    return df.groupBy(*by).agg(
        F.count(x).alias("n"), metric(F.min(x)).alias("minimum"), metric(F.max(x)).alias("maximum"), metric(F.avg(x)).alias("mean"), metric(F.median(x)).alias("median")
    )


def gaps(cues: DataFrame, by: str = "media_id") -> DataFrame:
    """(by, gap): seconds from each cue's end to the next one's start; negative where they overlap."""
    w = Window.partitionBy(by).orderBy("start_time", "end_time", "ord")
    rows = cues.where(intervals.valid(F.col("start_time"), F.col("end_time"))).withColumn("gap", F.lead("start_time").over(w) - F.col("end_time"))
    return rows.where("gap IS NOT NULL").select(by, "gap")


def gap_statistics(cues: DataFrame, by: str = "media_id") -> DataFrame:
    g = gaps(cues, by)
    signs = g.groupBy(by).agg(F.count_if(F.col("gap") < 0).alias("negative"), F.count_if(F.col("gap") == 0).alias("zero"), F.count_if(F.col("gap") > 0).alias("positive"))
    return distribution(g, [by], "gap").join(signs, by)


def overlaps(cues: DataFrame, by: str = "media_id") -> DataFrame:
    """(by, pairs, seconds): all pairs of valid cues that overlap, and the sum of what they share.

    One sweep over the borders, no pair is made: a cue that starts meets all that are open, and while n are open n * (n - 1) / 2 pairs
    share the time.
    """
    ok = cues.where(intervals.valid(F.col("start_time"), F.col("end_time")))
    edges = ok.select(by, F.explode(F.array(F.struct(F.col("start_time").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_time").alias("t"), F.lit(-1).alias("d")))).alias("x"))
    order = Window.partitionBy(by).orderBy("x.t", "x.d")  # ends come before starts of the same time
    rows = edges.withColumns({"_open": F.sum("x.d").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.lead("x.t").over(order)})
    met = F.sum(F.when(F.col("x.d") == 1, F.col("_open") - 1))
    shared = F.sum((F.col("_next") - F.col("x.t")) * F.col("_open") * (F.col("_open") - 1) / 2)
    found = rows.groupBy(by).agg(met.alias("pairs"), shared.alias("seconds"))
    return cues.select(by).distinct().join(found, by, "left").select(by, F.coalesce("pairs", F.lit(0)).alias("pairs"), metric(F.coalesce("seconds", F.lit(0.0))).alias("seconds"))


def quality(cues: DataFrame, by: str = "media_id", max_cps: float = 21.0, width: int = 42, lines: int = 2, least: float = 0.0, most: float = 1e9) -> DataFrame:
    """Counts of invalid cues and of those against the limits of speed, line length, line count and duration."""
    ok = intervals.valid(F.col("start_time"), F.col("end_time")) & (F.trim(F.coalesce("text", F.lit(""))) != "")
    seconds = F.col("end_time") - F.col("start_time")
    chars = F.length(F.regexp_replace("text", f"{SPACE}+", ""))
    rows = F.split("text", "\n", -1)
    longest = F.array_max(F.transform(rows, lambda x: F.length(x)))
    count = lambda cond: F.count_if(ok & cond)
    return cues.groupBy(by).agg(
        F.count("*").alias("cues"),
        F.count_if(~ok).alias("invalid"),
        count(chars / seconds > max_cps + 1e-9).alias("fast"),
        metric(F.max(F.when(ok, chars / seconds))).alias("fastest"),
        count(longest > width).alias("wide"),
        count(F.size(rows) > lines).alias("tall"),
        count(seconds < least - 1e-9).alias("short"),
        count(seconds > most + 1e-9).alias("long"),
    )


def speech_coverage(reference: DataFrame, candidate: DataFrame, by: str = "media_id", least_share: float = 0.5) -> DataFrame:
    """Seconds of reference speech that candidate cues cover and miss, seconds of cues over silence, and cues mostly over silence.

    Both sides are swept over once, so rows do not become more with their length. Sides without a media have a row each. Cues that share
    media and id are one. Borders are shuffled once; all else is summed up where they are.
    """
    known, nothing = F.col(by).isNotNull(), F.lit(0.0)
    reference, candidate = (df.withColumn("_side", F.when(~known, F.lit(side))) for df, side in ((reference, "reference"), (candidate, "candidate")))
    borders = intervals.covered_borders(reference, candidate, [by, "_side"], "ord")
    first, cue = F.col("_first"), F.col("_cue")
    ends = [F.when(cue, F.when(first, x).otherwise(y)).alias(c) for c, x, y in (("_start", F.col("_t"), F.col("_other")), ("_end", F.col("_other"), F.col("_t")))]
    at = lambda cond, name, *columns: [F.max(F.when(cond, F.col(c))).alias(f"{name}_{c}") for c in columns]
    key, totals = [by, "_side"], [F.max(c).alias(c) for c in ("a", "b", "both")]
    each = borders.groupBy(*key, "_cue", "ord", *ends).agg(
        F.count_if(first).alias("_n"), *at(first, "i", "nth", "from_", "to", "before"), *at(cue & ~first, "j", "nth", "from_", "to", "before", "previous"), *totals
    )
    start, end = F.col("_start"), F.col("_end")
    apart, tail = F.col("j_nth") - F.col("i_nth"), F.least(end, "j_to")
    upto = F.coalesce(F.col("i_before") + (F.col("i_to") - F.col("i_from_")), nothing)
    last = tail - F.col("j_from_")
    shared = (
        F.when(F.col("j_nth") == 0, nothing).when(apart == 0, F.greatest(nothing, tail - start))
        .when((F.col("i_nth") == 0) | F.col("i_to").isNotNull(), F.col("j_before") - upto + last)  # no region is open at the start
        .when(apart == 1, F.col("j_previous") - start + last).otherwise(F.col("j_before") - F.col("i_before") - (start - F.col("i_from_")) + last)
    )
    own = each.groupBy(*key, "_cue", "ord").agg(F.sum(shared * F.col("_n")).alias("shared"), F.first(end - start).alias("length"), *totals)
    silent = F.count_if(known & cue & (F.col("shared") / F.col("length") < least_share)).alias("mostly_silent")
    out = own.groupBy(*key).agg(silent, *totals).withColumnsRenamed({"a": "speech", "b": "cues", "both": "covered"})
    return out.select(
        by, metric(F.col("speech")).alias("speech"), metric(F.col("covered")).alias("covered"), metric(F.col("speech") - F.col("covered")).alias("missed"),
        ratio(F.col("speech") - F.col("covered"), F.col("speech")).alias("missed_share"), metric(F.col("cues") - F.col("covered")).alias("over_silence"),
        "mostly_silent",
    )


def repeated_phrases(tokens: Column, least: int = 2, most: int = 5) -> Column:
    """Struct (times, said) of a token array: phrases of ``least`` to ``most`` tokens that are said again at once, and their tokens.

    At a place the longest such phrase counts, and the places of its repetition are passed over. Null for null.
    """
    state = lambda free, times, total: F.struct(free.cast("int").alias("free"), times.cast("int").alias("times"), total.cast("int").alias("said"))
    taken = lambda now, x: F.when(x["at"] < now["free"], now).otherwise(state(x["at"] + x["size"], now["times"] + 1, now["said"] + x["size"]))

    def found(t: Column) -> Column:
        same = lambda at, size: [F.get(t, at - 1 + k).eqNullSafe(F.get(t, at - 1 + k - size)) for k in range(size)]
        again = lambda at, size: reduce(lambda a, b: a & b, same(at, size), (at > size) & (at + size - 1 <= F.size(t)))  # noqa: E731  mostly the first word tells
        places = F.when(F.size(t) > least, F.sequence(F.lit(least + 1), F.size(t))).otherwise(F.array().cast("array<int>"))
        longest = F.transform(places, lambda at: F.struct(at.alias("at"), F.coalesce(*[F.when(again(at, n), n) for n in range(most, least - 1, -1)], F.lit(0)).alias("size")))
        heard = F.filter(longest, lambda x: x["size"] > 0)
        out = F.aggregate(heard, state(F.lit(0), F.lit(0), F.lit(0)), taken, lambda x: F.struct(x["times"].alias("times"), x["said"].alias("said")))
        return F.when(t.isNotNull(), out)

    return F.transform(F.array(tokens), found)[0]  # a lambda's parameter is computed once, a column that it names once a place


def _distances(row: np.ndarray, part: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of the table of edit distances after ``row``, one for each code in ``part``."""
    places = np.arange(len(b) + 1)
    for x in part:
        pair_or_drop = np.minimum(row[:-1] + (b != x), row[1:] + 1)
        row = np.minimum.accumulate(np.append(row[0] + 1, pair_or_drop) - places) + places
        yield row


def align(a: list[str], b: list[str]) -> list[tuple[str, int | None, int | None]]:
    """Least-cost alignment of token lists: (equal, substitute, delete or insert; place in a; place in b).

    Ties are resolved from the end: a pair first, then a deletion, then an insertion. One row in about the root of all is kept; those
    between are computed again on the way back, so memory is that of the root of len(a) rows.
    """
    code = {t: k for k, t in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([code[t] for t in side], np.int64) for side in (a, b))
    step = max(1, int(len(a) ** 0.5))
    kept = [np.arange(len(b) + 1)]
    for k, row in enumerate(_distances(kept[0], x, y), 1):
        if k % step == 0:
            kept.append(row)
    out: list[tuple[str, int | None, int | None]] = []
    i, j = len(a), len(b)
    low, rows = len(a) + 1, []
    while i or j:
        if i and i <= low:
            low = (i - 1) // step * step
            rows = [kept[low // step], *_distances(kept[low // step], x[low:i], y)]
        here = rows[i - low][j] if i else j
        if i and j and here == rows[i - 1 - low][j - 1] + (x[i - 1] != y[j - 1]):
            i, j = i - 1, j - 1
            out.append(("equal" if x[i] == y[j] else "substitute", i, j))
        elif i and here == rows[i - 1 - low][j] + 1:
            i -= 1
            out.append(("delete", i, None))
        else:
            j -= 1
            out.append(("insert", None, j))
    return out[::-1]


def word_errors(cases: DataFrame, by: str, reference: str, candidate: str) -> DataFrame:
    """(by, words, substitutions, deletions, insertions, wer) of two token-array columns, one case a row."""
    kind = cases.schema[by].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for key, a, b in zip(pdf[by], pdf[reference], pdf[candidate]):
                ops = [op for op, _, _ in align(list(a), list(b))]
                s, d, i = (ops.count(x) for x in ("substitute", "delete", "insert"))
                rows.append((key, len(a), s, d, i, math.floor((s + d + i) / len(a) * 1e6 + 0.5) / 1e6 if len(a) else None))
            yield pd.DataFrame(rows, columns=[by, "words", "substitutions", "deletions", "insertions", "wer"])

    schema = f"{by} {kind}, words bigint, substitutions bigint, deletions bigint, insertions bigint, wer double"
    return cases.select(by, reference, candidate).mapInPandas(run, schema)


def matched_cues(reference: list[dict], candidate: list[dict], least: float = 0.25) -> list[tuple[int, int]]:
    """Pairs of cues in order with the least cost: 1 - dice of their tokens for a pair of at least ``least``, 1 for each cue left out."""
    n, m = len(reference), len(candidate)

    def dice(x: list[str], y: list[str]) -> float:
        if not x or not y:
            return float(x == y)
        left: dict[str, int] = {}
        for t in x:
            left[t] = left.get(t, 0) + 1
        shared = 0
        for t in y:
            if left.get(t, 0):
                left[t] -= 1
                shared += 1
        return 2 * shared / (len(x) + len(y))

    cost = [[float(i + j) if not i or not j else 0.0 for j in range(m + 1)] for i in range(n + 1)]
    pick = [[1 if not j else 2 for j in range(m + 1)] for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d = dice(reference[i - 1]["tokens"], candidate[j - 1]["tokens"])
            pair = cost[i - 1][j - 1] + 1 - d if d >= least else math.inf
            drop, add = cost[i - 1][j] + 1, cost[i][j - 1] + 1
            if pair <= min(drop, add) + 1e-12:
                cost[i][j], pick[i][j] = pair, 0
            elif drop <= add:
                cost[i][j], pick[i][j] = drop, 1
            else:
                cost[i][j], pick[i][j] = add, 2
    out, i, j = [], n, m
    while i and j:
        if pick[i][j] == 0:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif pick[i][j] == 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def cue_timing(reference: DataFrame, candidate: DataFrame, key: str = "media_id") -> DataFrame:
    """(key, available, matched, mean and largest onset and offset error) of cues with a ``tokens`` column, one media a group.

    Not available where the alignment has more than ``CELLS`` cells.
    """
    kind = reference.schema[key].dataType.simpleString()
    names = [key, "available", "matched", "onset_mean", "onset_max", "offset_mean", "offset_max"]

    def run(k: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = (d if "start_time" in d.columns else d.iloc[:0] for d in (a, b))  # a side without rows may come without columns
        if (len(a) + 1) * (len(b) + 1) > CELLS:
            return pd.DataFrame([(k[0], False, None, None, None, None, None)], columns=names)
        x, y = (d.sort_values(["start_time", "end_time"]).to_dict("records") if "start_time" in d.columns else [] for d in (a, b))
        for r in x + y:
            r["tokens"] = list(r["tokens"])
        pairs = matched_cues(x, y)
        on = [abs(y[j]["start_time"] - x[i]["start_time"]) for i, j in pairs]
        off = [abs(y[j]["end_time"] - x[i]["end_time"]) for i, j in pairs]
        six = lambda v: math.floor(v * 1e6 + 0.5) / 1e6
        stats = [six(f(v)) if v else None for v in (on, off) for f in (lambda q: sum(q) / len(q), max)]
        return pd.DataFrame([(k[0], True, len(pairs), *stats)], columns=names)

    schema = f"{key} {kind}, available boolean, matched bigint, onset_mean double, onset_max double, offset_mean double, offset_max double"
    return reference.groupBy(key).cogroup(candidate.groupBy(key)).applyInPandas(run, schema)


def suite(cases: DataFrame, errors: str, size: str) -> Column:
    """Micro average: sum of errors by sum of sizes over the cases that have both."""
    both = F.col(errors).isNotNull() & F.col(size).isNotNull()
    return ratio(F.sum(F.when(both, F.col(errors))).cast("double"), F.sum(F.when(both, F.col(size))).cast("double"))


def compare_reports(baseline: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """(key, path, baseline, candidate, difference, percent) of the numeric columns of two reports with the same cases.

    A case in one report alone has nulls on the other side.
    """
    columns = [f.name for f in baseline.schema if f.name != key and f.dataType.simpleString() in ("int", "bigint", "double", "float")]
    long = lambda df, name: df.select(
        key, F.explode(F.array(*[F.struct(F.lit(c).alias("path"), F.col(c).cast("double").alias(name)) for c in columns])).alias("x")
    ).select(key, "x.path", f"x.{name}")
    both = long(baseline, "baseline").join(long(candidate, "candidate"), [key, "path"], "full_outer")
    diff = F.col("candidate") - F.col("baseline")
    return both.select(key, "path", "baseline", "candidate", metric(diff).alias("difference"), ratio(diff * 100.0, F.abs("baseline")).alias("percent"))


def stage_durations(events: DataFrame, job: str, stage: str, at: str) -> DataFrame:
    """(job, stage, seconds): time from each stage event to the next one of its job, summed; the last one is open and counts nothing."""
    w = Window.partitionBy(job).orderBy(at)
    rows = events.withColumn("_s", F.lead(at).over(w) - F.col(at))
    return rows.where("_s IS NOT NULL").groupBy(job, stage).agg(F.sum("_s").alias("seconds"))


def running_progress(events: DataFrame, job: str, at: str, value: str) -> DataFrame:
    """``events`` with ``progress``: the greatest value so far; progress never goes back."""
    w = Window.partitionBy(job).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("progress", F.max(value).over(w))


def last_events(events: DataFrame, by: str, order: str, size: Column, most: int = 1000, most_bytes: int = 2_000_000) -> DataFrame:
    """The last events of a log: at most ``most`` and ``most_bytes`` together, the last one always."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    rows = events.withColumn("_nth", F.row_number().over(w)).withColumn("_bytes", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("_nth") <= most) & ((F.col("_bytes") <= most_bytes) | (F.col("_nth") == 1))).drop("_nth", "_bytes")
