"""Set operations on time intervals, by key. All are DataFrame plans: one shuffle on the key, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid(start: Column, end: Column) -> Column:
    """A finite interval that starts at zero or later and ends after its start."""
    inf = F.lit(float("inf"))
    return start.isNotNull() & end.isNotNull() & ~F.isnan(start) & ~F.isnan(end) & (start >= 0) & (end > start) & (end < inf)


def union(df: DataFrame, key: str, start: str = "start_time", end: str = "end_time", gap: float = 0.0) -> DataFrame:
    """Union of each key's intervals: touching ones merge, and so do those at most ``gap`` apart. Invalid ones are dropped."""
    by = Window.partitionBy(key).orderBy(start, end)
    seen = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.where(valid(F.col(start), F.col(end))).select(key, start, end, seen.alias("_seen"))
    opens = F.when(F.col("_seen").isNull() | (F.col(start) - F.col("_seen") > gap), 1).otherwise(0)
    island = F.sum(opens).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return (
        marked.withColumn("_island", island)
        .groupBy(key, "_island")
        .agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members"))
        .drop("_island")
    )


def range_join(a: DataFrame, b: DataFrame, key: str, width: float, start: str = "start_time", end: str = "end_time", suffix: str = "_b") -> DataFrame:
    """Pairs of a key's intervals that overlap (strictly): all columns of ``a`` and those of ``b`` with ``suffix``.

    Both sides are dealt to buckets of ``width`` seconds and joined by (key, bucket), so no key is held as a whole; a pair counts in
    the bucket in which its overlap starts, once. Intervals much longer than ``width`` are in many buckets.
    """
    right = b.select(key, *[F.col(c).alias(c + suffix) for c in b.columns if c != key])
    bucket = lambda t: F.floor(t / F.lit(float(width)))
    deal = lambda df, s, e: df.where(valid(F.col(s), F.col(e))).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(s)), bucket(F.col(e)))))
    x, y = deal(a, start, end), deal(right, start + suffix, end + suffix)
    from_ = F.greatest(F.col(start), F.col(start + suffix))
    return (
        x.join(y, [key, "_bucket"])
        .where((F.col(start) < F.col(end + suffix)) & (F.col(start + suffix) < F.col(end)) & (F.col("_bucket") == bucket(from_)))
        .drop("_bucket")
    )


def stretches(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """(key, start_time, end_time, in_a, in_b): each key's time cut where the union of ``a`` or that of ``b`` opens or closes, and which is open.

    One sweep: each side's borders as +1 and -1, and running sums of them. No interval is copied, however long it is.
    """
    border = lambda c, d, side: F.struct(F.col(c).alias("t"), *[F.lit(d if side == x else 0).alias(f"in_{x}") for x in "ab"])
    edge = lambda df, side: df.where(valid(F.col("start_time"), F.col("end_time"))).select(
        *key, F.explode(F.array(border("start_time", 1, side), border("end_time", -1, side))).alias("x")
    )
    by = Window.partitionBy(*key).orderBy("t")
    open_ = lambda side: F.sum(f"in_{side}").over(by.rowsBetween(Window.unboundedPreceding, 0)) > 0
    edges = edge(a, "a").unionByName(edge(b, "b")).select(*key, "x.*")
    # the last border of a time has the sums of all of them
    times = edges.select(*key, "t", open_("a").alias("in_a"), open_("b").alias("in_b"), F.lead("t").over(by).alias("_next")).where("_next IS NULL OR _next > t")
    turns = times.withColumns({f"_{c}": F.lag(c).over(by) for c in ("in_a", "in_b")}).where("_in_a IS NULL OR _in_a != in_a OR _in_b != in_b")
    return turns.select(*key, F.col("t").alias("start_time"), F.lead("t").over(by).alias("end_time"), "in_a", "in_b").where("end_time IS NOT NULL")


def intersect(a: DataFrame, b: DataFrame, key: str, width: float = 600.0) -> DataFrame:
    """(key, start_time, end_time): what the unions of both sides share. A null key is nobody's. ``width`` is not needed any more."""
    return stretches(a.where(F.col(key).isNotNull()), b.where(F.col(key).isNotNull()), key).where("in_a AND in_b").select(key, "start_time", "end_time")


def subtract(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, start_time, end_time): what the union of ``a`` has and that of ``b`` does not."""
    return stretches(a, b, key).where("in_a AND NOT in_b").select(key, "start_time", "end_time")


def shared_seconds(df: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """Valid rows of ``df`` with ``shared``: the seconds of each that the union of ``regions`` covers. A null key shares nothing.

    Two as-of joins by sorting: the last region at a row's start and the one at its end; those between count by the difference of running
    sums, which is exactly zero where there are none.
    """
    nothing = F.lit(0.0)
    by = Window.partitionBy(key).orderBy("start_time")
    upto = F.sum(F.col("end_time") - F.col("start_time")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    own = union(regions.where(F.col(key).isNotNull()), key).withColumn("_upto", upto)
    own = own.withColumn("_region", F.struct("start_time", "end_time", F.coalesce(F.lag("_upto").over(by), nothing).alias("before"), F.col("_upto").alias("upto")))
    rows = df.where(valid(F.col("start_time"), F.col("end_time"))).withColumns({"_from": F.col("start_time"), "_to": F.col("end_time"), "_row": F.lit(1)})
    both = rows.unionByName(own.select(key, "_region", F.col("start_time").alias("_from"), F.col("start_time").alias("_to"), F.lit(0).alias("_row")), allowMissingColumns=True)
    last = lambda t: F.last("_region", ignorenulls=True).over(Window.partitionBy(key).orderBy(t, "_row").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_i", last("_from")).withColumn("_j", last("_to")).where("_row = 1")
    start, end, i, j = F.col("start_time"), F.col("end_time"), F.col("_i"), F.col("_j")
    tail = F.least(end, j["end_time"])
    several = F.coalesce(F.greatest(nothing, i["end_time"] - start), nothing) + (j["before"] - F.coalesce(i["upto"], nothing)) + (tail - j["start_time"])
    shared = F.when(j.isNull(), nothing).when(i["start_time"] == j["start_time"], F.greatest(nothing, tail - start)).otherwise(several)
    return found.withColumn("shared", shared).select(*df.columns, "shared")


def covered_borders(regions: DataFrame, rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """Both borders of each valid one of ``rows`` with the last region of the union of ``regions`` that starts by then, and seconds so far.

    (key, name, _cue, _first, _t, _other, nth, from_, to, before, previous, a, b, both): ``_t`` is the border, ``_other`` the row's other one,
    ``_first`` is true at a start; ``nth`` counts the regions, ``to`` is null while the region is open, ``before`` has the seconds of those
    before it and ``previous`` the end of the last of these; ``a``, ``b`` and ``both`` are the seconds so far of the unions of ``regions``,
    of ``rows`` and of what they share, so a key's greatest are its totals. Where a region ends is a border too, without ``_cue``.
    One shuffle and one sort of narrow rows; no interval is copied, however long it is.
    """
    # 1 and 2: a region opens and closes, 4 and 8: a row does
    border = lambda kind, t, other: F.struct(F.lit(kind).alias("_kind"), F.col(t).alias("_t"), F.col(other).alias("_other"))
    edge = lambda df, own, k: df.where(valid(F.col("start_time"), F.col("end_time"))).select(
        *key, own.alias(name), F.explode(F.array(border(k, "start_time", "end_time"), border(2 * k, "end_time", "start_time"))).alias("x")
    )
    edges = edge(rows, F.col(name), 4).unionByName(edge(regions, F.lit(None).cast(rows.schema[name].dataType), 1)).select(*key, name, "x.*")
    by = Window.partitionBy(*key).orderBy("_t")
    upto, t, kind = by.rowsBetween(Window.unboundedPreceding, 0), F.col("_t"), F.col("_kind")
    latest = lambda cond, x, over=upto: F.last(F.when(cond, x), ignorenulls=True).over(over)
    # borders of one time are peers: each has the sums of all of them, and only the first one sees them change
    peers = by.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = lambda k: F.sum(F.when(kind == k, 1).when(kind == 2 * k, -1).otherwise(0)).over(peers) > 0
    now = edges.withColumns({"_a": open_(1), "_b": open_(4)})
    now = now.withColumns({f"_was{x}": F.coalesce(F.lag(x).over(by), F.lit(False)) for x in ("_a", "_b")})
    opens, closes = F.col("_a") & ~F.col("_was_a"), ~F.col("_a") & F.col("_was_a")
    turn = (F.col("_a") != F.col("_was_a")) | (F.col("_b") != F.col("_was_b"))
    since = latest(turn, t, by.rowsBetween(Window.unboundedPreceding, -1))
    now = now.withColumns({"nth": F.count(F.when(opens, 1)).over(upto), "from_": latest(opens, t), "_closed": latest(closes, t), "_since": since})
    seconds = lambda cond, start: F.coalesce(F.sum(F.when(cond, t - F.col(start))).over(upto), F.lit(0.0))
    was_a, was_b = turn & F.col("_was_a"), turn & F.col("_was_b")
    sums = {"a": seconds(was_a, "_since"), "b": seconds(was_b, "_since"), "both": seconds(was_a & F.col("_was_b"), "_since")}
    now = now.withColumns(sums | {"_done": seconds(closes, "from_"), "previous": latest(opens, F.col("_closed"))})
    now = now.withColumn("before", latest(opens, F.col("_done"))).where((kind >= 4) | closes)
    to = F.when(~F.col("_a"), F.col("_closed")).alias("to")
    return now.select(*key, name, (kind >= 4).alias("_cue"), (kind == 4).alias("_first"), "_t", "_other", "nth", "from_", to, "before", "previous", "a", "b", "both")


def total(df: DataFrame, key: str, name: str = "seconds") -> DataFrame:
    return df.groupBy(key).agg(F.sum(F.col("end_time") - F.col("start_time")).alias(name))


def nearest(points: DataFrame, targets: DataFrame, key: str, at: str, target: str, radius: float) -> DataFrame:
    """``points`` with ``nearest``: the target of the same key nearest to ``at`` within ``radius``, the earlier of two; else null.

    An as-of join in both directions by one sort: the last target before and the first one after each point.
    """
    tag = points.withColumn("_t", F.col(at).cast("double")).withColumn("_target", F.lit(None).cast("double")).withColumn("_point", F.lit(1))
    own = targets.select(key, F.col(target).cast("double").alias("_t")).distinct().withColumn("_target", F.col("_t")).withColumn("_point", F.lit(0))
    both = tag.unionByName(own, allowMissingColumns=True)
    last = lambda t: F.last("_target", ignorenulls=True).over(Window.partitionBy(key).orderBy(t, "_point").rowsBetween(Window.unboundedPreceding, 0))
    before, after = last("_t"), last(F.desc("_t"))  # a frame that reaches forward would be gone through once a row
    found = both.withColumns({"_before": before, "_after": after}).where("_point = 1")
    gap = lambda c: F.abs(F.col(c) - F.col("_t"))
    pick = F.when(F.col("_after").isNull() | (gap("_before") <= gap("_after")), F.col("_before")).otherwise(F.col("_after"))
    return found.withColumn("nearest", F.when(F.abs(pick - F.col("_t")) <= radius, pick)).drop("_t", "_target", "_point", "_before", "_after")


def uncovered(
    speech: DataFrame, evidence: DataFrame, key: str, tolerance: float = 0.1, ignore: float = 0.25, least: float = 0.5, share: float = 0.4, large: float = 2.0
) -> DataFrame:
    """(key, start_time, end_time): stretches of speech that no evidence covers.

    Evidence within speech counts, widened by ``tolerance`` within it. Gaps under ``ignore`` seconds are none. A region has gaps if
    they take ``share`` of it or one is at least ``large``; of those, gaps of at least ``least`` seconds are returned.
    """
    known = F.col(key).isNotNull()
    speech = speech.where(known)
    wide = intersect(evidence, speech, key).select(key, (F.col("start_time") - tolerance).alias("start_time"), (F.col("end_time") + tolerance).alias("end_time"))
    wide = wide.withColumn("start_time", F.greatest(F.lit(0.0), "start_time"))
    length = F.col("end_time") - F.col("start_time")
    gaps = subtract(speech, wide, key).where(length >= ignore)
    # a gap is in one region, the last that starts by then
    regions = union(speech, key).select(key, "start_time", "end_time", F.struct("start_time", length.alias("length")).alias("_region"))
    both = gaps.withColumn("_gap", F.lit(1)).unionByName(regions.withColumn("_gap", F.lit(0)), allowMissingColumns=True)
    last = F.last("_region", ignorenulls=True).over(Window.partitionBy(key).orderBy("start_time", "_gap").rowsBetween(Window.unboundedPreceding, 0))
    inside = both.withColumn("_in", last).where("_gap = 1").select(key, "start_time", "end_time", F.col("_in.start_time").alias("_region"), F.col("_in.length").alias("_length"))
    by = Window.partitionBy(key, "_region")
    bad = (F.sum(length).over(by) >= share * F.col("_length")) | (F.max(length).over(by) >= large)
    return inside.withColumn("_bad", bad).where(F.col("_bad") & (length >= least)).select(key, "start_time", "end_time")
