"""Standing matches in plain Python, for keyed state in streams and for small data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from trendloom.plans.pattern import Step
from trendloom.plans.spec import Absence, Relation

Event = dict[str, Any]


def order(e: Event) -> tuple[int, int]:
    return e["event_time_ms"], e["event_id"]


def local_paths(steps: Sequence[Step], events: Sequence[Event], within_ms: int) -> list[tuple[Event, ...]]:
    """All paths of a key's events, each once, in order of their positions."""
    line = sorted(events, key=order)
    found: dict[tuple[int, ...], None] = {}

    def extend(at: tuple[int, ...], i: int, r: int) -> None:
        """Paths that begin with the positions `at`, of which the last was the r-th of step i."""
        if at and r >= (steps[i].least if i >= 0 else 0) and all(s.optional for s in steps[i + 1 :]):
            found[at] = None
        for p in range(at[-1] + 1 if at else 0, len(line)):
            e = line[p]
            if at and e["event_time_ms"] - line[at[0]]["event_time_ms"] > within_ms:
                break
            for j, n in _moves(steps, i, r):
                if e["event_type"] in steps[j].types:
                    extend((*at, p), j, n)

    extend((), -1, 0)
    return [tuple(line[p] for p in at) for at in sorted(found)]


def _moves(steps: Sequence[Step], i: int, r: int) -> Iterator[tuple[int, int]]:
    if i >= 0 and (steps[i].most is None or r < steps[i].most):
        yield i, r + 1
    if i < 0 or r >= steps[i].least:
        for j in range(i + 1, len(steps)):
            if steps[j].most != 0:
                yield j, 1
            if not steps[j].optional:
                return


def local_holds(relation: Relation, path: Sequence[Event]) -> bool:
    chosen = [path[i] for i in relation.steps if 0 <= i < len(path)] if relation.steps else path
    values = [e.get(relation.field) for e in chosen if e.get(relation.field) is not None]
    return len(set(values)) <= 1 if relation.op == "same" else len(set(values)) == len(values)


def local_absent(absence: Absence, path: Sequence[Event], events: Sequence[Event]) -> bool:
    """No absent event within the path's time; the absence's own conditions must have been applied to its events."""
    times = [e["event_time_ms"] for e in path]
    held = {e["event_id"] for e in path}
    start, end = min(times), max(times)
    if absence.within_ms is not None:
        end = min(end, start + absence.within_ms)
    return not any(e["event_type"] == absence.event_type and start <= e["event_time_ms"] <= end and e["event_id"] not in held for e in events)


def local_walks(steps: Sequence[tuple[str, bool]], events: Sequence[Event], within_ms: int) -> list[tuple[int, ...]]:
    """Identifiers of all walks over consecutive events, each once."""
    line = sorted(events, key=order)
    found = {}
    for s, seed in enumerate(line):
        if seed["event_type"] != steps[0][0]:
            continue
        at = {1}
        if len(steps) == 1:
            found[(s, s)] = None
        for p in range(s + 1, len(line)):
            if line[p]["event_time_ms"] - seed["event_time_ms"] > within_ms:
                break
            then = set()
            for i in at:
                if i == len(steps):
                    continue
                fits = line[p]["event_type"] == steps[i][0]
                if fits:
                    then.add(i + 1)
                if not fits or steps[i][1]:
                    then.add(i)
            if len(steps) in then:
                found[(s, p)] = None
            at = then
    return [tuple(e["event_id"] for e in line[s : p + 1]) for s, p in sorted(found)]


def local_walk_ways(steps: Sequence[tuple[str, bool]], events: Sequence[Event], within_ms: int) -> set[tuple[tuple[int, ...], tuple[int, ...]]]:
    """(identifiers of a walk, of the events that took a step) for every way of matching each walk, one event a step."""
    line = sorted(events, key=order)
    found = set()

    def extend(s: int, took: tuple[int, ...], p: int) -> None:
        if len(took) == len(steps):
            found.add((tuple(e["event_id"] for e in line[s:p]), tuple(line[i]["event_id"] for i in took)))
            return
        if p == len(line) or line[p]["event_time_ms"] - line[s]["event_time_ms"] > within_ms:
            return
        name, repeats = steps[len(took)]
        fits = line[p]["event_type"] == name
        if fits:
            extend(s, (*took, p), p + 1)
        if not fits or repeats:
            extend(s, took, p + 1)

    for s, seed in enumerate(line):
        if seed["event_type"] == steps[0][0]:
            extend(s, (s,), s + 1)
    return found
