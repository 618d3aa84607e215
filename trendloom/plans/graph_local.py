"""Walks over a graph searched block by block of time: no walk moves between tasks.

Seeds of a block lead no further than the window after it, so a block with the events of that time holds all that its walks need. Blocks are as long as the window: each event is in two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.functions.predicates import field
from trendloom.plans.match import event_of
from trendloom.plans.spec import QuerySpec
from trendloom.plans.walk import repeats_take, walk_steps

#: Events that one block may hold; where one holds more, the walks move level by level (`trendloom.plans.graph_match`).
HELD = 1_000_000
#: Events on the partial walks that are taken a step further at once.
CELLS = 1_000_000
#: Events of a task.
TASK_EVENTS = 100_000

#: Kinds of events besides those that a step names: others that a walk may pass, and those on no walk, which only take part in edges.
OTHER, OUTSIDE = -1, -2

Batches = Iterator[pa.RecordBatch]


def _blocks(t: Column, within_ms: int) -> Column:
    """The blocks of seeds whose walks may reach an event of time t."""
    at = lambda x: F.floor(x / max(1, within_ms))
    return F.explode(F.sequence(at(t - within_ms), at(t)))


def fits(events: DataFrame, within_ms: int) -> bool:
    """Whether events can be searched by block: whole numbers for identifiers and times, no event twice, and no block with too many."""
    if not all(isinstance(events.schema[c].dataType, (T.LongType, T.IntegerType)) for c in ("event_id", "event_time_ms")):
        return False
    known = events.where("event_id IS NOT NULL AND event_time_ms IS NOT NULL")
    per_block = known.select(_blocks(F.col("event_time_ms").cast("long"), within_ms).alias("block")).groupBy("block").count()
    return per_block.where(F.col("count") > HELD).isEmpty() and events.where("event_id IS NOT NULL").groupBy("event_id").count().where("count > 1").isEmpty()


def local_walks(events: DataFrame, hidden: DataFrame | None, spec: QuerySpec, fields: tuple[str, ...], keys: tuple[str, ...], max_gap_ms: int | None, max_length: int | None, ways: bool, text: bool) -> DataFrame:
    """Walks (partition_key, path, with `ways` matched) over the graph of events (`operators.graph.event_graph`).

    The edges of a block are worked out from its events: with all events of its time they are the
    graph's edges that lie within it. `hidden` (seed, hidden) has the absent events (at, other) that
    may lie in the time of a seed's walks; walks over one that took no step are left out. With
    `text` a path is its identifiers with commas.
    """
    steps, within_ms = walk_steps(spec), spec.within_ms
    kinds = list(dict.fromkeys(name for name, _ in steps))
    known = events.where("event_id IS NOT NULL AND event_time_ms IS NOT NULL")
    node = reduce(lambda a, b: a & b, (p.column(known) for p in spec.where), F.col("partition_key").isNotNull() & F.col("event_type").isNotNull())
    kind = F.coalesce(*(F.when(F.col("event_type") == name, F.lit(i)) for i, name in enumerate(kinds)), F.lit(OTHER))
    t = F.col("event_time_ms").cast("long")
    shared = [F.nullif(field(known, k).cast("string"), F.lit("")).alias(f"by_{i}") for i, k in enumerate(keys)]
    process = [field(known, c).cast("string").alias(n) for c, n in (("process_id", "process"), ("parent_process_id", "parent"))]
    event = [] if text and not ways else [event_of(known, fields).alias("ev")]
    rows = known.select(F.col("event_id").cast("long").alias("id"), t.alias("t"), F.when(node, kind).otherwise(F.lit(OUTSIDE)).alias("kind"), F.col("partition_key").alias("key"), *shared, *process, *event)
    if hidden is not None:
        rows = rows.join(hidden, rows["id"] == hidden["seed"], "left").drop("seed")
    tasks = max(4 * events.sparkSession.sparkContext.defaultParallelism, events.count() // TASK_EVENTS)
    placed = rows.withColumn("block", _blocks(F.col("t"), within_ms)).withColumn("own", F.col("block") == F.floor(F.col("t") / max(1, within_ms)))
    spread = placed.repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int")).sortWithinPartitions("block")
    of_event = f"array<{known.select(event_of(known, fields).alias('ev')).schema['ev'].dataType.simpleString()}>"
    schema = f"partition_key string, path {'string' if text else of_event}" + f", matched {of_event}" * ways
    wanted = np.array([kinds.index(name) for name, _ in steps] + [OUTSIDE])
    repeats = np.array([k for _, k in steps] + [False])
    return spread.mapInArrow(_run(wanted, repeats, within_ms, max_gap_ms, repeats_take(spec) and ways, ways, max_length, text), schema)


def _run(wanted: np.ndarray, repeats: np.ndarray, within_ms: int, max_gap_ms: int | None, takes: bool, ways: bool, max_length: int | None, text: bool) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for rows in _by_block(batches):
            b = _Block(rows, within_ms, max_gap_ms)
            for path, took in b.walks(wanted, repeats, takes, max_length):
                parts = [b.key.take(pa.array(path[:, 0])), b.text(path) if text else b.events(path, np.ones_like(took))]
                if ways:
                    parts.append(b.events(path, took))
                yield pa.RecordBatch.from_arrays(parts, names=["partition_key", "path", "matched"][: len(parts)])

    return run


def _by_block(batches: Batches) -> Iterator[pa.Table]:
    """The rows of each block, of batches in order of blocks."""
    held: list[pa.RecordBatch] = []
    at = None
    for b in batches:
        block = b.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if held and block[lo] != at:
                yield pa.Table.from_batches(held)
                held = []
            at = block[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _codes(values: pa.Array) -> np.ndarray:
    """A number for each value, -1 for null."""
    return pc.fill_null(values.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _to_next(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From each event to the next of the same number."""
    line = np.argsort(codes, kind="stable")
    same = (codes[line[1:]] == codes[line[:-1]]) & (codes[line[1:]] >= 0)
    return line[:-1][same], line[1:][same]


class _Block:
    """A block's events, numbered from 0 in order of time and identifier, and the edges between them in order of their source."""

    def __init__(self, rows: pa.Table, within_ms: int, max_gap_ms: int | None) -> None:
        rows = rows.sort_by([("t", "ascending"), ("id", "ascending")]).combine_chunks()
        column = lambda name: pa.concat_arrays(rows[name].chunks)
        self.within_ms = within_ms
        self.ids, self.t, self.kind, self.own = (column(c).to_numpy(zero_copy_only=False) for c in ("id", "t", "kind", "own"))
        self.key, self.id_text = column("key"), pc.cast(column("id"), pa.string())
        self.ev = column("ev") if "ev" in rows.schema.names else None
        self.n_hidden = np.zeros(len(self.ids), np.int64)
        if "hidden" in rows.schema.names:
            hidden = column("hidden")
            self.n_hidden = pc.fill_null(pc.list_value_length(hidden), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            self.hidden_from = np.cumsum(self.n_hidden) - self.n_hidden
            self.hidden_at, self.hidden_id = (pc.struct_field(hidden.flatten(), f).to_numpy(zero_copy_only=False) for f in ("at", "other"))
        found = [_to_next(_codes(column(c))) for c in rows.schema.names if c == "key" or c.startswith("by_")]
        found.append(self._from_parents(_codes(pa.concat_arrays([column("process"), column("parent")]))))
        src, dst = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        gap = self.t[dst] - self.t[src]
        kept = (src != dst) & (gap <= (within_ms if max_gap_ms is None else min(within_ms, max_gap_ms))) & (self.kind[src] != OUTSIDE) & (self.kind[dst] != OUTSIDE)
        pairs = np.unique(src[kept] * len(self.ids) + dst[kept])
        src, self.dst = pairs // len(self.ids), pairs % len(self.ids)
        self.edges_from = np.searchsorted(src, np.arange(len(self.ids)))
        self.n_edges = np.bincount(src, minlength=len(self.ids))
        #: whether a walk may come back to an event: among events of one time only
        self.turns = bool((self.dst < src).any())

    def _from_parents(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """To each event from the last one, at or before its time, whose process is its parent's."""
        n = len(self.ids)
        process, parent = codes[:n], codes[n:]
        line = np.flatnonzero(process >= 0)
        line = line[np.argsort(process[line], kind="stable")]
        places = process[line] * (n + 1) + line
        child = np.flatnonzero(parent >= 0)
        at = np.searchsorted(places, parent[child] * (n + 1) + np.searchsorted(self.t, self.t[child], side="right")) - 1
        child, at = child[at >= 0], at[at >= 0]
        same = process[line[at]] == parent[child]
        return line[at[same]], child[same]

    def walks(self, wanted: np.ndarray, repeats: np.ndarray, takes: bool, max_length: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Complete walks as rows of events' numbers, all of one length at a time, with which of them took a step."""
        last = len(wanted) - 1
        first = np.flatnonzero(self.own & (self.kind == wanted[0])).astype(np.int32)[:, None]
        # the longest come first, so few wait: no more than the edges of one bundle for each length
        waiting = [(first[i : i + CELLS], np.ones((len(first[i : i + CELLS]), 1), bool), np.ones(len(first[i : i + CELLS]), np.int64)) for i in range(0, len(first), CELLS)]
        while waiting:
            path, took, step = waiting.pop()
            done = step == last
            if done.any():
                seen = self.unhidden(path[done], took[done])
                if seen.any():
                    yield path[done][seen], took[done][seen]
                path, took, step = path[~done], took[~done], step[~done]
            length = path.shape[1]
            if not len(path) or (max_length is not None and length >= max_length):
                continue
            row, new = self.hops(path)
            fit = self.kind[new] == wanted[step[row]]
            again = fit & repeats[step[row]]
            goes = [(np.flatnonzero(fit), 1, True), (np.flatnonzero(~fit | again), 0, False), *([(np.flatnonzero(again), 0, True)] if takes else [])]
            pick = np.concatenate([x for x, _, _ in goes])
            on = np.concatenate([np.full(len(x), n) for x, n, _ in goes])
            mark = np.concatenate([np.full(len(x), m) for x, _, m in goes])
            size = max(1, CELLS // (length + 1))
            for i in range(0, len(pick), size):
                p, r = pick[i : i + size], row[pick[i : i + size]]
                longer = np.empty((len(p), length + 1), np.int32)
                longer[:, :-1], longer[:, -1] = path[r], new[p]
                marks = np.empty((len(p), length + 1), bool)
                marks[:, :-1], marks[:, -1] = took[r], mark[i : i + size]
                waiting.append((longer, marks, step[r] + on[i : i + size]))

    def hops(self, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each walk's number with each event that it can take next."""
        at = path[:, -1]
        n = self.n_edges[at]
        row = np.repeat(np.arange(len(path)), n)
        new = self.dst[np.arange(len(row)) + np.repeat(self.edges_from[at] - (np.cumsum(n) - n), n)]
        near = self.t[new] - self.t[path[row, 0]] <= self.within_ms
        row, new = row[near], new[near]
        if self.turns:
            fresh = np.ones(len(row), bool)
            for i in range(path.shape[1]):
                fresh &= path[row, i] != new
            row, new = row[fresh], new[fresh]
        return row, new

    def unhidden(self, path: np.ndarray, took: np.ndarray) -> np.ndarray:
        """Which walks have no absent event in their time but those that took a step."""
        n = self.n_hidden[path[:, 0]]
        row = np.repeat(np.arange(len(path)), n)
        if not len(row):
            return np.ones(len(path), bool)
        i = np.arange(len(row)) + np.repeat(self.hidden_from[path[:, 0]] - (np.cumsum(n) - n), n)
        counts = self.hidden_at[i] <= self.t[path[row, -1]]
        row, other = row[counts], self.hidden_id[i[counts]]
        for j in range(path.shape[1]):
            free = ~(took[row, j] & (self.ids[path[row, j]] == other))
            row, other = row[free], other[free]
        return np.bincount(row, minlength=len(path)) == 0

    def text(self, path: np.ndarray) -> pa.Array:
        ends = np.arange(len(path) + 1, dtype=np.int32) * path.shape[1]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), self.id_text.take(pa.array(path.ravel()))), ",")

    def events(self, path: np.ndarray, chosen: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(chosen.sum(axis=1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), self.ev.take(pa.array(path[chosen])))
