"""Streams of recognised segments: event-time windows, suffix deltas of snapshots, and reconciliation across windows.

State is kept by media. A watermark on the event time lets Spark drop it: a media without rows for ``IDLE`` of event time is over.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuelake.operators import folds

IDLE = 10 * 60 * 1000


def counts_by_window(events: DataFrame, at: str, by: str, length: str, step: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events of each ``by`` in tumbling or, with ``step``, sliding windows of event time; rows later than ``late`` are dropped."""
    window = F.window(at, length, step) if step else F.window(at, length)
    return events.withWatermark(at, late).groupBy(window, by).agg(F.count("*").alias("n")).select(by, "window.start", "window.end", "n")


def sessions(events: DataFrame, at: str, by: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each ``by``: events at most ``gap`` apart."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n")).select(by, "session_window.start", "session_window.end", "n")


def latest_only(events: DataFrame, key: str, job: str, current: DataFrame) -> DataFrame:
    """Rows of each key's current job; rows of jobs that were given up are dropped. ``current`` (key, job) is a static table."""
    return events.join(current.select(key, job), [key, job], "left_semi")


def delta(before: list, after: list) -> tuple[int, list]:
    """(replace_from, new rows): what turns one list into the other, after their common head."""
    k = 0
    while k < len(before) and k < len(after) and before[k] == after[k]:
        k += 1
    return k, after[k:]


def apply_delta(before: list, replace_from: int, total: int, rows: list) -> list:
    """The list after a delta; one that does not fit is an error."""
    if not 0 <= replace_from <= len(before) or replace_from + len(rows) != total:
        raise ValueError("delta does not fit")
    return before[:replace_from] + rows


def suffix_deltas(snapshots: DataFrame, at: str, late: str = "10 minutes") -> DataFrame:
    """(media_id, version, replace_from, total, segments) for a stream of snapshots (media_id, version, segments as JSON, ``at``).

    Versions of a media are taken in order within a batch; one that is no newer than the last is dropped. Segments are JSON again.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        version, kept = state.get if state.exists else (-1, "[]")
        now, out = json.loads(kept), []
        rows = pd.concat(list(batches)).sort_values("version")
        for v, text in zip(rows["version"], rows["segments"]):
            if v <= version:
                continue
            after = json.loads(text)
            start, new = delta(now, after)
            out.append((key[0], int(v), start, len(after), json.dumps(new, ensure_ascii=False)))
            version, now = int(v), after
        state.update((version, json.dumps(now, ensure_ascii=False)))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + IDLE)
        yield pd.DataFrame(out, columns=["media_id", "version", "replace_from", "total", "segments"])

    return (
        snapshots.withWatermark(at, late)
        .groupBy("media_id")
        .applyInPandasWithState(
            run, "media_id string, version long, replace_from long, total long, segments string", "version long, segments string", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


#: Segments of a media's tail that the next window may still change.
TAIL = 3


def reconciled_stream(results: DataFrame, at: str, late: str = "10 minutes") -> DataFrame:
    """(media_id, start_time, end_time, text): segments of windows (media_id, win_id, core_start, segments as JSON, ``at``), overlap said once.

    Windows are taken in order of win_id; one that comes early waits in the state for those before it. A segment is emitted when
    it leaves the tail; the last ones of a media when it has been idle.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nxt, kept, waiting = state.get if state.exists else (0, "[]", "{}")
        tail, early, out = json.loads(kept), json.loads(waiting), []
        if state.hasTimedOut:
            for win in sorted(early, key=int):
                tail = folds.reconciled(tail, early[win][1], early[win][0])
            out, tail = tail, []
            state.remove()
        else:
            for pdf in batches:
                for win, core, text in zip(pdf["win_id"], pdf["core_start"], pdf["segments"]):
                    if win >= nxt:
                        early[str(int(win))] = (float(core), json.loads(text))
            while str(nxt) in early:
                core, head = early.pop(str(nxt))
                tail = folds.reconciled(tail, head, core)
                nxt += 1
            out, tail = (tail[:-TAIL], tail[-TAIL:]) if len(tail) > TAIL else ([], tail)
            state.update((nxt, json.dumps(tail, ensure_ascii=False), json.dumps(early, ensure_ascii=False)))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + IDLE)
        yield pd.DataFrame([(key[0], r["start_time"], r["end_time"], r["text"]) for r in out], columns=["media_id", "start_time", "end_time", "text"])

    return (
        results.withWatermark(at, late)
        .groupBy("media_id")
        .applyInPandasWithState(
            run, "media_id string, start_time double, end_time double, text string", "next long, tail string, early string", "append", GroupStateTimeout.EventTimeTimeout
        )
    )
