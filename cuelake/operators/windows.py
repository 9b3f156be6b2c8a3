"""Windows over a media's time: tumbling cores with overlapping slices, ownership of events, sliding energy, repair and packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.time import rounded

LONGEST, SHORTEST = 29.0, 5.0


def plan(media: DataFrame, window: float, overlap: float, duration: str = "duration") -> DataFrame:
    """``media`` with a row for each window: win_id, core_start, core_end, slice_start, slice_end.

    Windows are 5 to 29 seconds long, the overlap is a quarter of one at most; cores tile the duration.
    """
    w = min(LONGEST, max(SHORTEST, window))
    o = min(w / 4, max(0.0, overlap))
    core = w - 2 * o
    d = F.col(duration)
    ids = F.when(d > 0, F.sequence(F.lit(0), (F.ceil(d / core) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = media.withColumn("win_id", F.explode(ids))
    rows = rows.withColumns({"core_start": F.col("win_id") * core, "core_end": F.least(d, (F.col("win_id") + 1) * core)})
    return rows.withColumns({"slice_start": F.greatest(F.lit(0.0), F.col("core_start") - o), "slice_end": F.least(d, F.col("core_end") + o)})


def owned(chunks: DataFrame, windows: DataFrame, key: str = "media_id", suffix: float = 0.5) -> DataFrame:
    """Chunks of a window, their times counted from its slice, on the media's timeline: those that start in its core.

    One that starts before the core but has ``suffix`` seconds in it is kept from the core's start and marked ``from_context``.
    """
    start, end = F.col("slice_start") + F.col("start_time"), F.col("slice_end")
    placed = chunks.join(windows.select(key, "win_id", "core_start", "core_end", "slice_start", "slice_end"), [key, "win_id"]).withColumns(
        {"_start": start, "_end": F.least(end, F.col("slice_start") + F.col("end_time"))}
    )
    inside = (F.col("_start") >= F.col("core_start")) & (F.col("_start") < F.col("core_end"))
    tail = (F.col("_start") < F.col("core_start")) & (F.col("_end") - F.col("core_start") >= suffix)
    kept = placed.where((F.col("_end") > F.col("_start")) & (inside | tail))
    times = {"start_time": rounded(F.greatest("_start", F.when(tail, F.col("core_start")).otherwise(F.col("_start")))), "end_time": rounded(F.col("_end")), "from_context": tail}
    return kept.withColumns(times).drop("_start", "_end", "core_start", "core_end", "slice_start", "slice_end")


def repair_windows(gaps: DataFrame, key: str = "media_id", duration: str = "duration", context: float = 0.75, least: float = 0.5, most: int = 20) -> DataFrame:
    """Slices of at most 29 seconds around gaps of at least ``least``: gap_start, gap_end, slice_start, slice_end; the first ``most`` of a media."""
    piece = LONGEST - 2 * context
    length = F.col("end_time") - F.col("start_time")
    parts = gaps.where(length >= least).withColumn("_n", F.ceil(length / piece).cast("int")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    step = length / F.col("_n")
    parts = parts.withColumns({"gap_start": F.col("start_time") + F.col("_k") * step, "gap_end": F.col("start_time") + (F.col("_k") + 1) * step})
    parts = parts.withColumns({"slice_start": F.greatest(F.lit(0.0), F.col("gap_start") - context), "slice_end": F.least(F.col(duration), F.col("gap_end") + context)})
    nth = F.row_number().over(Window.partitionBy(key).orderBy("gap_start"))
    return parts.withColumn("_nth", nth).where(F.col("_nth") <= most).select(key, "gap_start", "gap_end", "slice_start", "slice_end")


def regeneration_slice(start: Column, end: Column, duration: Column) -> Column:
    """(slice_start, slice_end): the range with up to 2 seconds of context on both sides, 29 seconds at most."""
    context = F.least(F.lit(2.0), (F.lit(LONGEST) - (end - start)) / 2)
    return F.struct(rounded(F.greatest(F.lit(0.0), start - context)).alias("slice_start"), rounded(F.least(duration, end + context)).alias("slice_end"))


def sliding_rms(samples: DataFrame, key: str, frame: int, hop: int, order: str = "ord", value: str = "sample") -> DataFrame:
    """(key, frame_start, rms): root mean square of each frame of ``frame`` samples, one every ``hop``; the last are shorter.

    Written as a window, so Spark streams a key's samples in order; ``rolling_rms`` does the same on arrays.
    """
    by = Window.partitionBy(key).orderBy(order).rowsBetween(0, frame - 1)
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    framed = samples.withColumns({"frame_start": nth, "_mean": F.avg(F.col(value) * F.col(value)).over(by)})
    return framed.where(F.col("frame_start") % hop == 0).select(key, "frame_start", F.sqrt("_mean").alias("rms"))


def rolling_rms(x: np.ndarray, frame: int, hop: int) -> np.ndarray:
    """The same of an array, by prefix sums, as 4-byte floats."""
    sums = np.concatenate([[0.0], np.cumsum(x.astype(np.float64) ** 2)])
    a = np.arange(0, len(x), hop)
    b = np.minimum(a + frame, len(x))
    return np.sqrt(np.maximum(0.0, (sums[b] - sums[a]) / np.maximum(1, b - a))).astype(np.float32)


def pack(regions: DataFrame, key: str = "media_id", target: float = 26.0, overlap: float = 1.5, longest: float = LONGEST) -> DataFrame:
    """(key, win_id, core_start, core_end, slice_start, slice_end): windows that regions are packed into greedily, in order.

    A region joins the window before it if the whole stays within the target core; a longer one is cut at the target. Slices get
    the overlap, at least 5 seconds and at most ``longest``. Packing depends on all regions before, so a media is one task's group.
    """
    core = max(0.1, target - 2 * overlap)
    most = max(0.1, longest - 2 * overlap)
    kind = regions.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        duration = float(pdf["duration"].iloc[0])
        rows = pdf.sort_values(["start_time", "end_time"])
        merged: list[list[float]] = []
        for s, e in zip(rows["start_time"], rows["end_time"]):
            s, e = max(0.0, s), min(duration, e)
            if e <= s:
                continue
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        groups: list[list[float]] = []
        for s, e in merged:
            first = True
            while e - s > 0:
                stop = s + core if e - s > most else e
                if first and groups and stop - groups[-1][0] <= core:
                    groups[-1][1] = stop
                else:
                    groups.append([s, stop])
                first, s = False, stop
        out = []
        for k, (s, e) in enumerate(groups):
            a, b = max(0.0, s - overlap), min(duration, e + overlap)
            if b - a < SHORTEST:
                a = max(0.0, a - (SHORTEST - (b - a)) / 2)
                b = min(duration, a + SHORTEST)
            out.append((pdf[key].iloc[0], k, s, e, a, min(b, a + longest)))
        return pd.DataFrame(out, columns=[key, "win_id", "core_start", "core_end", "slice_start", "slice_end"])

    return regions.groupBy(key).applyInPandas(run, f"{key} {kind}, win_id int, core_start double, core_end double, slice_start double, slice_end double")


def speech_regions(
    samples: np.ndarray, rate: int = 16000, least: float = 0.25, merge_gap: float = 0.35, before: float = 0.2, after: float = 0.3, floor_rms: float = 0.003,
    factor: float = 2.5, off_ratio: float = 0.72, adapt: float = 0.025,
) -> list[dict[str, float]]:
    """Regions of an array in which sliding energy stays above an adaptive noise floor, with hysteresis.

    start_time and end_time are padded, raw_start and raw_end are not; average_rms is over the raw frames.
    """
    frame, hop = round(0.03 * rate), round(0.01 * rate)
    rms = rolling_rms(samples, frame, hop)
    if not len(rms):
        return []
    floor = float(np.sort(rms)[int(0.2 * (len(rms) - 1))])
    on_now, speech, level = False, np.zeros(len(rms), bool), []
    for k, x in enumerate(map(float, rms)):
        on = max(floor_rms, min(0.03, floor * factor))
        off = max(floor_rms * off_ratio, on * off_ratio)
        on_now = x > (off if on_now else on)
        speech[k] = on_now
        level.append(min(1.0, max(0.0, (x - off) / max(floor_rms, on - off))))
        seen = min(x, max(floor_rms, floor * 1.25))
        floor = max(0.0, floor + (seen - floor) * adapt * (0.08 if on_now else 1.0))
    smooth = speech.copy()
    if len(speech) > 2:
        same = speech[:-2] == speech[2:]
        smooth[1:-1] = np.where(same, speech[:-2], speech[1:-1])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], smooth.astype(int), [0]])))
    raw = []
    for a, b in zip(edges[::2], edges[1::2]):
        s, e = a * hop / rate, min(len(samples), (b - 1) * hop + frame) / rate
        if e - s >= least:
            raw.append([s, e, float(rms[a:b].mean()), float(np.mean(level[a:b]))])
    merged: list[list[float]] = []
    for s, e, r, c in raw:
        if merged and s - merged[-1][1] <= merge_gap:
            p = merged[-1]
            x, y = p[1] - p[0], e - s
            p[2], p[3], p[1] = (p[2] * x + r * y) / (x + y), (p[3] * x + c * y) / (x + y), e
        else:
            merged.append([s, e, r, c])
    end = len(samples) / rate
    return [
        {"start_time": max(0.0, s - before), "end_time": min(end, e + after), "raw_start": s, "raw_end": e, "average_rms": r, "confidence": c} for s, e, r, c in merged
    ]


def detect_speech(audio: DataFrame, key: str = "media_id", samples: str = "samples", rate: str = "sample_rate", **options: float) -> DataFrame:
    """(key, start_time, end_time, raw_start, raw_end, average_rms, confidence) for rows with an array of samples each."""
    kind = audio.schema[key].dataType.simpleString()
    names = ["start_time", "end_time", "raw_start", "raw_end", "average_rms", "confidence"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{key: k, **r} for k, x, n in zip(pdf[key], pdf[samples], pdf[rate]) for r in speech_regions(np.asarray(x, np.float32), int(n), **options)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return audio.select(key, samples, rate).mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names))


def runs(frames: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """(key, first, last, frames): stretches of rows in order whose ``flag`` is true."""
    by = Window.partitionBy(key).orderBy(order)
    island = F.row_number().over(by) - F.row_number().over(Window.partitionBy(key, flag).orderBy(order))
    marked = frames.withColumn("_island", island).where(F.col(flag))
    return marked.groupBy(key, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("frames")).drop("_island")
