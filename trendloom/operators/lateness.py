"""Aggregates per period of event time, corrected as late records arrive, up to a cut-off."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MINUTE_MS, HOUR_MS, DAY_MS = 60_000, 3_600_000, 86_400_000

_CORRECTIONS = "period_start_ms bigint, batch_id bigint, n_added bigint, n_before bigint, n_after bigint, n_window bigint, corrects boolean"


class _Node:
    __slots__ = ("keys", "kids", "count", "parent")

    def __init__(self, keys: list[int], kids: list, count: int, parent: _Node | None = None) -> None:
        self.keys, self.kids, self.count, self.parent = keys, kids, count, parent


class FingerTree:
    """A B-tree of counts keyed by time, entered at its latest leaf (the finger).

    A leaf holds sorted keys and their counts; an inner node holds children and the lowest
    key of each; every node holds the sum below it. An insertion climbs from the finger
    only as far as its key's subtree and then goes down, so a record in order is placed at
    once and one that is d keys late after O(log d) steps; then the sums of its ancestors
    change, as many as the tree is high.
    """

    WIDTH = 16

    def __init__(self) -> None:
        self.root = self.finger = _Node([], None, 0)
        self.evicted_to: int | None = None

    def add(self, key: int, n: int) -> bool:
        """Add n at `key`; False, and no change, if the cut-off has passed it."""
        if self.evicted_to is not None and key < self.evicted_to:
            return False
        node = self.finger
        while node.parent is not None and (not node.keys or key < node.keys[0]):
            node = node.parent
        while node.kids is not None and not isinstance(node.kids, dict):
            i = max(0, bisect_left(node.keys, key + 1) - 1)
            node.keys[i] = min(node.keys[i], key)
            node = node.kids[i]
        if node.kids is None:
            node.kids = {}
        if key in node.kids:
            node.kids[key] += n
        else:
            insort(node.keys, key)
            node.kids[key] = n
        up: _Node | None = node
        while up is not None:
            up.count += n
            if up.parent is not None and up.keys[0] < up.parent.keys[0] and up is up.parent.kids[0]:
                up.parent.keys[0] = up.keys[0]
            up = up.parent
        if len(node.keys) > self.WIDTH:
            self._split(node)
        return True

    def _split(self, node: _Node) -> None:
        half = len(node.keys) // 2
        leaf = isinstance(node.kids, dict)
        right = _Node(node.keys[half:], {k: node.kids.pop(k) for k in node.keys[half:]} if leaf else node.kids[half:], 0, node.parent)
        node.keys = node.keys[:half]
        if leaf:
            right.count = sum(right.kids.values())
            if self.finger is node:
                self.finger = right
        else:
            node.kids = node.kids[:half]
            right.count = sum(k.count for k in right.kids)
            for k in right.kids:
                k.parent = right
        node.count -= right.count
        if node.parent is None:
            self.root = node.parent = right.parent = _Node([node.keys[0], right.keys[0]], [node, right], node.count + right.count)
            return
        at = node.parent.kids.index(node) + 1
        node.parent.keys.insert(at, right.keys[0])
        node.parent.kids.insert(at, right)
        if len(node.parent.keys) > self.WIDTH:
            self._split(node.parent)

    def total(self, low: int | None = None, high: int | None = None) -> int:
        """Sum of the counts of keys in [low, high); whole subtrees count by their partial."""
        return self._below(self.root, high) - (0 if low is None else self._below(self.root, low))

    def _below(self, node: _Node, high: int | None) -> int:
        if high is None:
            return node.count
        done = 0
        while True:
            if node.kids is None:
                return done
            if isinstance(node.kids, dict):
                return done + sum(node.kids[k] for k in node.keys[: bisect_left(node.keys, high)])
            i = bisect_left(node.keys, high)
            if not i:
                return done
            done += sum(k.count for k in node.kids[: i - 1])
            node = node.kids[i - 1]

    def evict(self, before: int, grain: int = 1) -> int:
        """Turn away keys below `before` from now on and drop those below it, whole subtrees at
        once; a multiple of `grain` that `before` falls into stays whole. Returns the count dropped."""
        if self.evicted_to is not None and before <= self.evicted_to:
            return 0
        self.evicted_to = before
        before -= before % grain
        return self._prune(self.root, before) if self.root.keys and self.root.keys[0] < before else 0

    def _prune(self, node: _Node, before: int) -> int:
        i = bisect_left(node.keys, before)
        if isinstance(node.kids, dict):
            gone = sum(node.kids.pop(k) for k in node.keys[:i])
            node.keys = node.keys[i:]
        else:
            whole = max(0, i - 1)
            gone = sum(k.count for k in node.kids[:whole])
            node.keys, node.kids = node.keys[whole:], node.kids[whole:]
            if i:
                gone += self._prune(node.kids[0], before)
                if not node.kids[0].keys and len(node.kids) > 1:
                    node.keys, node.kids = node.keys[1:], node.kids[1:]
                elif node.kids[0].keys:
                    node.keys[0] = node.kids[0].keys[0]
        node.count -= gone
        return gone

    def items(self, node: _Node | None = None) -> Iterator[tuple[int, int]]:
        node = node or self.root
        if isinstance(node.kids, dict):
            yield from ((k, node.kids[k]) for k in node.keys)
        elif node.kids:
            for k in node.kids:
                yield from self.items(k)


def _replay(period_ms: int, cutoff_us: int):
    """Partials of one shard of event time through a tree, in order of arrival."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "batch", "key"], kind="stable")
        tree = FingerTree()
        out: dict[tuple, list] = {}
        # a null batch has become the lowest long, which no batch has
        for pane, batch, at, key, late, n in zip(*(pdf[c].tolist() for c in ("pane", "batch", "at", "key", "late", "n")), strict=True):
            tree.evict(-((cutoff_us - at) // 1000), period_ms)  # the lowest whole millisecond that is not beyond the cut-off
            period = pane // period_ms * period_ms
            before = tree.total(period, period + period_ms)
            added = n if tree.add(key, n) else 0
            row = out.setdefault((period, batch), [0, before, 0, 0, False])
            row[0] += added
            row[2] = before + added
            row[3] = tree.root.count
            row[4] = row[4] or (late and added > 0)
        return pd.DataFrame([(p, b, *r) for (p, b), r in out.items()], columns=["period_start_ms", "batch_id", "n_added", "n_before", "n_after", "n_window", "corrects"])

    return run


def late_corrections(
    kept: DataFrame,
    *,
    time_ms: str = "t",
    arrived_us: str = "ingested_us",
    batch_id: str = "batch_id",
    period_ms: int = HOUR_MS,
    on_time_ms: int = 30 * MINUTE_MS,
    cutoff_ms: int = DAY_MS,
    pane_ms: int = MINUTE_MS,
    shard_ms: int = HOUR_MS,
) -> DataFrame:
    """What each batch adds to each period of event time, of one row per event.

    Columns: period_start_ms, batch_id, n_added (events counted), n_before and n_after
    (the period's count before the batch's first and after its last record), n_window (events
    held in the shard after it, by default the period's own), corrects (the batch adds an event that arrived more than
    `on_time_ms` after it happened). An event that arrives more than `cutoff_ms` after it
    happened is not counted; exactly `cutoff_ms` is. Both are compared in microseconds.

    Method: a finger B-tree of partial counts keyed by event time takes the records in
    order of arrival. Records near the latest time enter at the finger; late ones update
    the partials of their ancestors; the cut-off of each arrival evicts older subtrees in
    bulk and turns away what would fall into them. Time is split into shards of `shard_ms`,
    each with its own tree: a period lies in one shard, and there are as many tasks' worth of
    trees as periods. Before the shuffle, events of one
    batch, pane of event time and pane of arrival that lie on the same side of both limits
    become one partial, so a tree takes as many as there are panes and batches, however many
    events there are. A partial stands for its events exactly: within the cut-off it arrives
    with its first event and has the earliest event time, beyond it with its last and the latest.

    `shard_ms` must be a multiple of `period_ms`, and that of `pane_ms`. Events without a
    time or an arrival do not count; a null batch is a batch of its own; arrival before the
    event is on time. An empty table gives no rows.
    """
    if period_ms % pane_ms or shard_ms % period_ms:
        raise ValueError("shard_ms must be a multiple of period_ms, and that of pane_ms")
    t, at = F.col(time_ms).cast("long"), F.col(arrived_us).cast("long")
    delay = at - t * 1000
    partial = (
        kept.where(t.isNotNull() & at.isNotNull())
        .select(
            (t - F.pmod(t, F.lit(pane_ms))).alias("pane"),
            F.coalesce(F.col(batch_id).cast("long"), F.lit(-(2**63))).alias("batch"),
            at.alias("at"),
            F.when(delay > cutoff_ms * 1000, 2).when(delay > on_time_ms * 1000, 1).otherwise(0).alias("side"),
            t.alias("t"),
        )
        .groupBy("pane", "batch", F.floor(F.col("at") / (pane_ms * 1000)).alias("arrival"), "side")
        .agg(F.min("t").alias("low"), F.max("t").alias("high"), F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
        .select("pane", "batch", F.expr("if(side = 2, last, first)").alias("at"), F.expr("if(side = 2, high, low)").alias("key"), F.expr("side = 1").alias("late"), "n")
    )
    # a fixed number of partitions: partials are few bytes but much work, so they must not be put together by size
    tasks = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = (
        partial.withColumn("shard", F.floor(F.col("pane") / shard_ms))
        .repartition(tasks, "shard")
        .groupBy("shard")
        .applyInPandas(_replay(period_ms, cutoff_ms * 1000), _CORRECTIONS)
    )
    return out.withColumn("batch_id", F.when(F.col("batch_id") != -(2**63), F.col("batch_id")))
