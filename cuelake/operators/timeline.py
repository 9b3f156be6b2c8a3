"""Snapping of dragged times to cue borders, the playhead, the ends of a media and a half-second grid. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.time import rounded

#: Pixels within which a border and the grid catch, the grid's reach and step in seconds, and priorities.
PIXELS, GRID_PIXELS, GRID_REACH, GRID = 10.0, 4.0, 0.1, 0.5
PLAYHEAD, BORDER, EDGE, GRID_PRIORITY = 300, 250, 200, 100
SHORTEST = 0.1


def targets(cues: DataFrame, key: str = "media_id") -> DataFrame:
    """(key, targets): the borders of each media's cues as an array of (time, priority, ord)."""
    border = lambda c: F.struct(F.col(c).alias("time"), F.lit(BORDER).alias("priority"), F.col("ord").cast("bigint").alias("ord"))
    rows = cues.select(key, F.explode(F.array(border("start_time"), border("end_time"))).alias("t")).where("t.time IS NOT NULL AND NOT isnan(t.time)")
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("t")).alias("targets"))


def with_ends(targets_: Column, playhead: Column, duration: Column, moving: Column | None = None) -> Column:
    """Targets without the moving cue's own, with the playhead and both ends of the media where they are known."""
    own = targets_ if moving is None else F.filter(targets_, lambda t: ~t["ord"].eqNullSafe(moving))
    more = lambda c, p: F.struct(c.cast("double").alias("time"), F.lit(p).alias("priority"), F.lit(None).cast("bigint").alias("ord"))
    extra = F.filter(F.array(more(playhead, PLAYHEAD), more(F.lit(0.0), EDGE), more(duration, EDGE)), lambda t: t["time"].isNotNull())
    return F.concat(own, extra)


def nearest_target(time: Column, targets_: Column, pixels_per_second: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """(distance, rank, time) of the nearest target within reach, the one of higher priority of equally near ones; else null."""
    scale = F.greatest(F.lit(0.01), pixels_per_second)
    low, high = F.lit(float("-inf")) if low is None else low, F.lit(float("inf")) if high is None else high
    grid = F.floor(time / GRID + 0.5) * GRID
    at = lambda t, p: F.struct(F.round(F.abs(t - time), 9).alias("distance"), (-p).alias("rank"), t.alias("time"))
    inside = F.filter(targets_, lambda t: (t["time"] >= low) & (t["time"] <= high) & (F.abs(t["time"] - time) <= PIXELS / scale))
    found = F.transform(inside, lambda t: at(t["time"], t["priority"]))
    reach = F.least(F.lit(GRID_REACH), GRID_PIXELS / scale)
    on_grid = F.filter(F.array(at(grid, F.lit(GRID_PRIORITY))), lambda g: (g["distance"] <= reach) & (g["time"] >= low) & (g["time"] <= high))
    return F.array_min(F.concat(found, on_grid))


def snap(time: Column, targets_: Column, pixels_per_second: Column) -> Column:
    """The time after snapping, in milliseconds' places."""
    return rounded(F.coalesce(nearest_target(time, targets_, pixels_per_second)["time"], time))


def moved(start: Column, end: Column, by: Column, targets_: Column, pixels_per_second: Column, duration: Column) -> Column:
    """(start_time, end_time) of a cue dragged by some seconds: kept within the media, snapped by whichever border is nearer."""
    length = end - start
    limit = F.coalesce(duration, F.lit(float("inf")))
    a = F.greatest(F.lit(0.0), F.least(start + by, limit - length))
    one = nearest_target(a, targets_, pixels_per_second, F.lit(0.0), limit - length)
    two = nearest_target(a + length, targets_, pixels_per_second, length, limit)
    shift = F.array_min(
        F.filter(
            F.array(
                F.struct(one["distance"].alias("d"), one["rank"].alias("r"), (one["time"] - a).alias("by")),
                F.struct(two["distance"].alias("d"), two["rank"].alias("r"), (two["time"] - a - length).alias("by")),
            ),
            lambda x: x["d"].isNotNull(),
        )
    )["by"]
    s = rounded(a + F.coalesce(shift, F.lit(0.0)))
    return F.struct(s.alias("start_time"), rounded(s + length).alias("end_time"))


def resized(start: Column, end: Column, edge: str, to: Column, targets_: Column, pixels_per_second: Column, duration: Column, longest: float | None = None) -> Column:
    """(start_time, end_time) with one border dragged to a time, snapped, the cue at least a tenth of a second long."""
    t = snap(to, targets_, pixels_per_second)
    limit = F.coalesce(duration, F.lit(float("inf")))
    if edge == "start":
        low = F.lit(0.0) if longest is None else F.greatest(F.lit(0.0), end - longest)
        return F.struct(rounded(F.greatest(low, F.least(t, end - SHORTEST))).alias("start_time"), end.alias("end_time"))
    high = limit if longest is None else F.least(limit, start + longest)
    return F.struct(start.alias("start_time"), rounded(F.least(high, F.greatest(t, start + SHORTEST))).alias("end_time"))
