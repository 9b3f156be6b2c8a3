"""Readable captions from recognised segments: a fold over each media's segments in order.

Segments are cleaned, repeats joined, durations brought to a readable length, long texts parted at sentences, clauses or words, fragments
joined to their neighbours, overlaps removed and lines broken. No word of a kept segment is lost and the order never changes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from cuelake.functions.text import WEAK_ENDS
from cuelake.operators.folds import Row, fold, r3, without_repeats


@dataclass(frozen=True)
class Preferences:
    """Characters of a line and a cue, seconds, characters a second."""

    line: int = 42
    cue: int = 84
    shortest: float = 1.1
    longest: float = 6.0
    gap: float = 0.08
    lead: float = 0.08
    tail: float = 0.18
    target_speed: float = 20.0
    top_speed: float = 21.0


#: The least professional duration, a pause that is kept, and the confidence under which timing is not trusted.
LEAST, PAUSE, SURE = 5 / 6, 0.35, 0.5
_EPS = 0.001


def _least(p: Preferences) -> float:
    return min(p.longest, max(0.25, LEAST, p.shortest)) if p.shortest >= 0.25 else min(p.longest, max(0.25, LEAST))


def _readable(text: str, p: Preferences) -> float:
    return max(len(text) / p.target_speed, min(p.longest, max(0.25, p.shortest)))


def _unsure(row: Row) -> bool:
    c = row.get("confidence")
    return c is not None and c == c and c < SURE


def _clean(row: Row, p: Preferences, duration: float | None) -> Row | None:
    text = " ".join(str(row["text"] or "").split())
    start, end = max(0.0, row["start_time"]), row["end_time"]
    words = [w for w in (row.get("words") if row.get("words") is not None else []) if w["end_time"] > w["start_time"] and str(w["text"]).strip()]
    if words and len(words) >= 0.65 * len(text.split()):
        start, end = max(0.0, words[0]["start_time"] - p.lead), words[-1]["end_time"] + p.tail
    else:
        words = []
    if duration is not None:
        end = min(end, duration)
    return {**row, "text": text, "start_time": r3(start), "end_time": r3(end), "_words": words} if text and end > start else None


def _cut(text: str, p: Preferences) -> int:
    """Index of the word at which a text is best parted: after a sentence, a clause, else where both sides are most alike."""
    words = text.split(" ")

    def cost(k: int) -> tuple:
        one, two = " ".join(words[:k]), " ".join(words[k:])
        last = words[k - 1].rstrip("\"')]")
        bonus = 60 if last[-1:] in ".!?" else 30 if last[-1:] in ",;:–—" else 0
        weak = 35 if words[k - 1].lower().strip(".,;:!?\"'") in WEAK_ENDS else 0
        alone = 45 * (k == 1) + 55 * (k == len(words) - 1)
        return (abs(len(one) - len(two)) + weak + alone - bonus, k)

    return min(range(1, len(words)), key=cost)


def parts(text: str, seconds: float, p: Preferences) -> list[str]:
    """A text in pieces that fit a cue, each read within the longest duration at the top speed. Text without blanks is cut at the line."""
    size = min(p.cue, 2 * p.line)
    out, todo = [], [(text, seconds)]
    while todo:
        t, s = todo.pop()
        words = t.split(" ")
        fits = len(t) <= size and all(len(w) <= p.line for w in words) and s <= p.longest + _EPS
        if fits or (len(t) <= size and len(words) == 1 and len(t) <= p.line) or len(t) < 2:
            out.append(t)
        elif len(words) == 1:
            todo += [(t[p.line :], s / 2), (t[: p.line], s / 2)] if len(t) > p.line else [(t, 0.0)]
        else:
            k = _cut(t, p)
            one, two = " ".join(words[:k]), " ".join(words[k:])
            share = len(one) / max(1, len(one) + len(two))
            todo += [(two, s * (1 - share)), (one, s * share)]
    return out


def _split(row: Row, p: Preferences) -> list[Row]:
    seconds = row["end_time"] - row["start_time"]
    if _unsure(row):
        return [] if len(row["text"]) / max(1.0, p.top_speed) > seconds + _EPS else [row]
    pieces = parts(row["text"], seconds, p)
    if len(pieces) == 1:
        return [row]
    words, out = list(row["_words"]), []
    total, at = sum(len(x) for x in pieces), row["start_time"]
    for k, text in enumerate(pieces):
        n = len(text.split(" "))
        if len(words) >= n:
            own, words = words[:n], words[n:]
            start, end = max(at, own[0]["start_time"] - p.lead), own[-1]["end_time"] + p.tail
        else:
            own, start = [], at
            end = row["end_time"] if k == len(pieces) - 1 else at + seconds * len(text) / total
        end = min(end, start + p.longest)
        at = max(at + _EPS, end)
        out.append({**row, "text": text, "start_time": r3(start), "end_time": r3(max(end, start + _EPS)), "_words": own})
    return out


def _joined(rows: list[Row], p: Preferences) -> list[Row]:
    """Fragments joined to the neighbour that they run into."""
    out: list[Row] = []
    size = min(p.cue, 2 * p.line)
    abrupt = lambda r: r["end_time"] - r["start_time"] < _least(p) - _EPS or len(r["text"]) > p.top_speed * (r["end_time"] - r["start_time"])
    for row in rows:
        if out:
            a = out[-1]
            text, seconds = f"{a['text']} {row['text']}", row["end_time"] - a["start_time"]
            ends = a["text"].rstrip("\"')]")[-1:] in ".!?"
            if (abrupt(a) or abrupt(row)) and row["start_time"] - a["end_time"] < PAUSE - _EPS and not ends and len(text) <= size and seconds <= p.longest and not (_unsure(a) or _unsure(row)):
                out[-1] = {**a, "text": text, "end_time": max(a["end_time"], row["end_time"]), "_words": a["_words"] + row["_words"]}
                continue
        out.append(row)
    return out


def _lengthened(rows: list[Row], p: Preferences, duration: float | None) -> list[Row]:
    """Ends moved out to a readable length where the next cue leaves room; kept pauses stay pauses."""
    out = []
    for k, row in enumerate(rows):
        end = max(row["end_time"], min(row["start_time"] + _readable(row["text"], p), row["start_time"] + p.longest))
        if k + 1 < len(rows):
            room = rows[k + 1]["start_time"]
            kept = PAUSE if room - row["end_time"] >= PAUSE - _EPS else p.gap
            end = max(row["end_time"], min(end, room - kept))
        if duration is not None:
            end = min(end, duration)
        out.append(row if _unsure(row) else {**row, "end_time": r3(max(end, row["start_time"] + _EPS))})
    return out


def _apart(rows: list[Row]) -> list[Row]:
    """Overlaps given to the later cue; a cue that would have nothing left keeps a millisecond."""
    out: list[Row] = []
    for row in rows:
        if out and row["start_time"] < out[-1]["end_time"]:
            end = max(out[-1]["start_time"] + _EPS, row["start_time"])
            out[-1] = {**out[-1], "end_time": r3(end)}
            row = {**row, "start_time": r3(max(row["start_time"], end)), "end_time": r3(max(row["end_time"], end + _EPS))}
        out.append(row)
    return out


def lines(text: str, width: int) -> str:
    """At most two lines, both within the width where a break allows it."""
    words = text.split(" ")
    if len(text) <= width or len(words) < 2:
        return text if len(text) <= width or len(words) > 1 else "\n".join(text[k : k + width] for k in range(0, len(text), width))
    fit = [k for k in range(1, len(words)) if len(" ".join(words[:k])) <= width and len(" ".join(words[k:])) <= width]

    def cost(k: int) -> tuple:
        one, two = " ".join(words[:k]), " ".join(words[k:])
        last = words[k - 1].rstrip("\"')]")[-1:]
        weak = 35 if words[k - 1].lower().strip(".,;:!?\"'") in WEAK_ENDS else 0
        alone = 22 * (k == 1) + 45 * (k == len(words) - 1)
        return (1.7 * abs(len(one) - len(two)) + weak + alone - (22 if last in ".!?" else 12 if last in ",;:" else 0), k)

    k = min(fit, key=cost) if fit else -(-len(words) // 2)
    return " ".join(words[:k]) + "\n" + " ".join(words[k:])


def formatted(rows: list[Row], p: Preferences = Preferences(), duration: float | None = None) -> list[Row]:
    """Captions of one media's segments, in order."""
    clean = [x for r in rows if (x := _clean(r, p, duration))]
    single = [{**r, "_words": r.get("_words", [])} for r in without_repeats(clean)]
    split = [x for r in _lengthened(single, p, duration) for x in _split(r, p)]
    split.sort(key=lambda r: (r["start_time"], r["end_time"]))
    out = _apart(_lengthened(_joined(split, p), p, duration))
    return [{**{k: v for k, v in r.items() if k != "_words"}, "text": lines(r["text"], max(18, p.line))} for r in out]


def format_captions(segments: DataFrame, preferences: Preferences = Preferences()) -> DataFrame:
    """Segments (media_id, ord, start_time, end_time, text, ...) as captions with the same columns."""
    return fold(segments, lambda rows: formatted(rows, preferences))
