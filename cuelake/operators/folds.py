"""Operators whose rows depend on what became of the rows before: a fold over each media's cues in order.

A media is one group and one task; groups are as large as one media's cues, never as its samples. Folds are plain functions on lists
of dicts, so that they can be tested and reused by the streaming processors.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

Row = dict


def r3(x: float) -> float:
    return math.floor(x * 1000 + 0.5) / 1000


def fold(cues: DataFrame, fn: Callable[[list[Row]], list[Row]], key: str = "media_id") -> DataFrame:
    """``fn`` on each media's rows by start, end and input order; it returns rows of the same columns."""
    columns = cues.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["start_time", "end_time", "ord"], kind="stable").to_dict("records")
        return pd.DataFrame(fn(rows), columns=columns)

    return cues.groupBy(key).applyInPandas(run, cues.schema)


def pushed_apart(rows: list[Row], gap: float = 0.08, least: float = 1.1, duration: float | None = None) -> list[Row]:
    """Each cue starts at least ``gap`` after the adjusted one before and lasts at least ``least`` seconds, within the duration."""
    cap = (lambda x: x) if duration is None else (lambda x: min(x, max(0.0, duration)))
    out: list[Row] = []
    for row in rows:
        start = cap(max(0.0, r3(row["start_time"])))
        end = cap(max(0.0, r3(max(row["end_time"], start + least))))
        if out and start < out[-1]["end_time"] + gap:
            start = r3(out[-1]["end_time"] + gap)
            end = max(end, r3(start + least))
        if duration is not None:
            end = min(end, duration)
            if start >= end:
                start = max(0.0, end - least)
        out.append({**row, "start_time": r3(start), "end_time": r3(end)})
    return out


def comparable(text: str) -> str:
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text.lower()).split())


def similarity(a: str, b: str) -> float:
    """Common tokens by the longer text's number of tokens."""
    x, y = a.split(), b.split()
    if not x or not y:
        return float(x == y)
    return sum((Counter(x) & Counter(y)).values()) / max(len(x), len(y))


def near_repeat(a: Row, b: Row, gap: float = 0.75, least: float = 0.82, long_enough: int = 12) -> bool:
    """Do two cues in a row say the same: equal, one within the other, or nearly the same words?"""
    if b["start_time"] - a["end_time"] > gap:
        return False
    x, y = comparable(a["text"]), comparable(b["text"])
    if not x or not y:
        return False
    inside = min(len(x), len(y)) >= long_enough and (x in y or y in x)
    return x == y or inside or similarity(x, y) >= least


def without_repeats(rows: list[Row]) -> list[Row]:
    """Of cues that repeat the last kept one the longer text stays, over the time of both."""
    out: list[Row] = []
    for row in rows:
        if out and near_repeat(out[-1], row):
            best = row if len(row["text"]) > len(out[-1]["text"]) else out[-1]
            out[-1] = {**best, "start_time": min(out[-1]["start_time"], row["start_time"]), "end_time": max(out[-1]["end_time"], row["end_time"])}
        else:
            out.append(row)
    return out


def spaced(rows: list[Row], gap: float = 0.08) -> list[Row]:
    """Neighbours at least ``gap`` apart where their times allow, sharing what is missing; in whole milliseconds.

    Cues that overlap meet in the middle; each keeps at least a millisecond.
    """
    out = [dict(r) for r in rows]
    g = round(gap * 1000)
    for a, b in zip(out, out[1:]):
        end, start = math.floor(a["end_time"] * 1000 + 0.5), math.floor(b["start_time"] * 1000 + 0.5)
        if start - end >= g:
            continue
        low, high = math.floor(a["start_time"] * 1000 + 0.5) + 1, math.floor(b["end_time"] * 1000 + 0.5) - 1
        if low > high:
            continue
        if start >= end:
            first = min(max((end + start - g) // 2, low), high)
            a["end_time"], b["start_time"] = first / 1000, min(first + g, high) / 1000
        else:
            middle = min(max((end + start) // 2, low), high)
            a["end_time"] = b["start_time"] = middle / 1000
    return out


_UNIT = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def units(text: str) -> list[str]:
    """Comparison units: words in compatibility form and lower case; letters of scripts without blanks one by one."""
    out = []
    for word in _UNIT.findall(unicodedata.normalize("NFKC", text).lower()):
        if any("฀" <= c <= "໿" or "က" <= c <= "႟" or "ក" <= c <= "៿" or "぀" <= c <= "鿿" or "가" <= c <= "힯" for c in word):
            out += list(word)
        else:
            out.append(word)
    return out


def overlap_units(a: list[str], b: list[str]) -> int:
    """Longest suffix of ``a`` that is a prefix of ``b``, by the prefix function of b + a's tail."""
    if not a or not b:
        return 0
    joined: list[str | None] = [*b, None, *a[-len(b) :]]
    border = [0] * len(joined)
    for i in range(1, len(joined)):
        k = border[i - 1]
        while k and joined[i] != joined[k]:
            k = border[k - 1]
        border[i] = k + (joined[i] == joined[k])
    return border[-1]


def reconciled(tail: list[Row], head: list[Row], boundary: float, search: float = 2.0, least: int = 2, segments: int = 3, most: int = 512) -> list[Row]:
    """``tail`` with ``head`` after it, what both say around the boundary once.

    The last units of up to three tail segments that are the first ones of the head are dropped from the head, if both reach
    within ``search`` seconds of the boundary and overlap in time. Of a segment wholly repeated its closing punctuation stays.
    """
    near = lambda r: r["end_time"] >= boundary - search and r["start_time"] <= boundary + search
    if not tail or not head or not any(map(near, tail[-segments:])) or not any(map(near, head[:segments])):
        return tail + head
    a = [u for r in tail[-segments:] for u in units(r["text"])][-most:]
    b = [u for r in head[:segments] for u in units(r["text"])][:most]
    k = overlap_units(a, b)
    single = k == 1 and len(units(tail[-1]["text"])) == 1 and len(units(head[0]["text"])) == 1
    in_time = head[0]["start_time"] < tail[-1]["end_time"] or any(r.get("from_context") for r in head[:segments])
    if not (k >= least or single) or not in_time:
        return tail + head
    tail, left, out = [dict(r) for r in tail], k, []
    for row in head:
        own = units(row["text"])
        if left >= len(own) and left:
            left -= len(own)
            mark = re.search(r"[.!?…,;:]+[\"')\]]*\s*$", row["text"])
            if mark and left == 0 and not re.search(r"[.!?…,;:][\"')\]]*\s*$", tail[-1]["text"]):
                tail[-1]["text"] += mark.group().strip()
            tail[-1]["end_time"] = max(tail[-1]["end_time"], min(row["end_time"], tail[-1]["end_time"]))
            continue
        if left:
            words = row["text"].split()
            drop = 0
            while drop < len(words) and sum(len(units(w)) for w in words[: drop + 1]) <= left:
                drop += 1
            share = (len(own) - left) / len(own)
            start = max(tail[-1]["end_time"], row["end_time"] - (row["end_time"] - row["start_time"]) * share)
            row = {**row, "text": " ".join(words[drop:]), "start_time": r3(min(start, row["end_time"] - 0.001))}
            left = 0
        out.append(row)
    return tail + out


def nearest_edges(rows: list[Row], starts: list[float], ends: list[float], reach: tuple[float, float] = (0.2, 0.3), pad: tuple[float, float] = (0.08, 0.18), gap: float = 0.08) -> list[Row]:
    """Cues' times moved to the nearest raw onset and offset within reach, with a lead and a tail, then spaced."""

    def near(x: float, edges: list[float], most: float) -> float | None:
        best = min(edges, key=lambda e: (abs(e - x), e), default=None)
        return best if best is not None and abs(best - x) <= most else None

    out = []
    for row in rows:
        s, e = near(row["start_time"], starts, reach[0]), near(row["end_time"], ends, reach[1])
        start = max(0.0, s - pad[0]) if s is not None else row["start_time"]
        end = e + pad[1] if e is not None else row["end_time"]
        out.append({**row, "start_time": r3(start), "end_time": r3(end)} if end > start else row)
    return spaced(out, gap)
