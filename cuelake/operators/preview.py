"""Live merge of generated cues with what the user has edited, and undo history. Plain functions over lists of rows.

A state is small and by media: which cues were generated, edited or removed. It goes through a grouped fold or a stateful stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

Row = dict


def _closeness(a: Row, b: Row) -> float:
    """How likely b is a's next version: overlap in time, near borders and the order of words; minus infinity if hardly."""
    far = max(0.0, b["start_time"] - a["end_time"], a["start_time"] - b["end_time"])
    x, y = a["text"].lower().split(), b["text"].lower().split()
    if far > 1.5 or not x or not y:
        return float("-inf")
    row = [0] * (len(y) + 1)
    for u in x[:64]:
        old = 0
        for j, v in enumerate(y[:64], 1):
            old, row[j] = row[j], old + 1 if u == v else max(row[j], row[j - 1])
    same = row[min(64, len(y))] / max(min(64, len(x)), min(64, len(y)))
    if same < 0.35 and x != y:
        return float("-inf")
    shared = max(0.0, min(a["end_time"], b["end_time"]) - max(a["start_time"], b["start_time"]))
    whole = max(a["end_time"], b["end_time"]) - min(a["start_time"], b["start_time"])
    near = lambda k: max(0.0, 1 - abs(a[k] - b[k]) / 1.5)
    return 4 * (shared / whole if whole > 0 else 0.0) + near("start_time") + near("end_time") + 2 * same + (x == y)


@dataclass(frozen=True)
class Preview:
    """``base``: ids before the run; ``made``: last generated rows; ``edited`` and ``removed``: ids that the user changed or deleted."""

    base: frozenset[str] = frozenset()
    made: tuple[tuple[str, tuple], ...] = ()
    edited: frozenset[str] = frozenset()
    removed: frozenset[str] = frozenset()
    counter: int = 0


def _shape(r: Row) -> tuple:
    return (r["start_time"], r["end_time"], r["text"])


def mark_edits(before: list[Row], after: list[Row], state: Preview) -> Preview:
    """Note what the user deleted or changed of the generated rows."""
    now = {r["id"]: _shape(r) for r in after}
    old = {r["id"]: _shape(r) for r in before}
    made = {k for k, _ in state.made}
    gone = {k for k in old if k in made and k not in now}
    changed = {k for k in old if k in made and k in now and now[k] != old[k]}
    return replace(state, removed=state.removed | gone, edited=(state.edited | changed) - gone)


def merged(current: list[Row], generated: list[Row], state: Preview) -> tuple[list[Row], Preview]:
    """(rows, state) after a new list of generated rows.

    A generated row keeps the id of the one it is the next version of; ids never go back in order. Rows that the user edited
    stay as they are, removed ones stay away, rows of his own stay; base rows go as soon as there is a generated one.
    """
    kept = list(state.made)
    out, used, made, counter = [], -1, [], state.counter
    for row in generated:
        best, at = 2.0, None
        for k in range(used + 1, len(kept)):
            s, e, t = kept[k][1]
            score = _closeness({"start_time": s, "end_time": e, "text": t}, row)
            if score >= best and (at is None or score > best):
                best, at = score, k
        if at is None:
            counter += 1
            name = f"generated-live-{counter}"
        else:
            used, name = at, kept[at][0]
        made.append((name, _shape(row)))
        out.append({**row, "id": name})
    have = {r["id"]: r for r in current}
    names = {n for n, _ in made}
    rows = [have[r["id"]] if r["id"] in state.edited and r["id"] in have else r for r in out if r["id"] not in state.removed]
    was = {k for k, _ in kept}
    rows += [r for r in current if r["id"] in state.edited and r["id"] not in names]
    rows += [r for r in current if r["id"] not in was and r["id"] not in names and (r["id"] not in state.base or not generated)]
    rows.sort(key=lambda r: (r["start_time"], r["end_time"]))
    return [{**r, "index": i} for i, r in enumerate(rows, 1)], replace(state, made=tuple(made), counter=counter)


@dataclass
class History:
    """Versions of a list of rows: at most ``depth`` to go back to. Within a transaction nothing is kept until it is committed."""

    present: list[Row]
    depth: int = 80
    past: list[list[Row]] = field(default_factory=list)
    future: list[list[Row]] = field(default_factory=list)
    draft: tuple[str, list[Row]] | None = None

    def commit(self, rows: list[Row]) -> None:
        if rows != self.present:
            self.past = (self.past + [self.present])[-self.depth :]
            self.present, self.future = rows, []

    def undo(self) -> None:
        if self.past:
            self.future.insert(0, self.present)
            self.present = self.past.pop()

    def redo(self) -> None:
        if self.future:
            self.past.append(self.present)
            self.present = self.future.pop(0)

    def begin(self, name: str) -> None:
        self.draft = (name, self.present)

    def update(self, name: str, rows: list[Row]) -> bool:
        """Change the draft; one of another transaction is stale and ignored."""
        if self.draft is None or self.draft[0] != name:
            return False
        self.draft = (name, rows)
        return True

    def finish(self, name: str, keep: bool = True) -> bool:
        if self.draft is None or self.draft[0] != name:
            return False
        rows, self.draft = self.draft[1], None
        if keep:
            self.commit(rows)
        return True
