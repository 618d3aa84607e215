"""Standing queries over a stream: matches as they appear, cancellations as they vanish."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trendloom.functions.predicates import field
from trendloom.plans.local import local_absent, local_holds, local_paths
from trendloom.plans.spec import QuerySpec

CHANGES = "trend_id string, query_id string, query_version string, partition_key string, path array<bigint>, change string, revision bigint, error string"
COLUMNS = [c.split()[0] for c in CHANGES.split(", ")]
_STATE = "held string, active string, revision bigint"


def _usable(events: DataFrame, spec: QuerySpec) -> tuple[Column, list[str]]:
    """Which events a query keeps in state, and the fields it needs of them; conditions are checked here, in columns."""
    steps = sorted({t for s in spec.steps for t in s.types})
    use = F.col("event_type").isin(steps)
    for a in spec.absence:
        own = F.col("event_type") == a.event_type
        for p in a.where:
            own = own & p.column(events)
        use = use | own
    for p in spec.where:
        use = use & p.column(events)
    return use, list(dict.fromkeys(r.field for r in spec.relations))


def moves(events: DataFrame, previous_key: str = "previous_key") -> DataFrame:
    """Events of which `previous_key` tells the key they had before, so that both keys are looked at again.

    One that has moved comes twice: it is taken back in its old key and set in its new one. Where
    the column is null or the same key, the event comes once.
    """
    moved = F.col(previous_key).isNotNull() & (F.col(previous_key) != F.coalesce("partition_key", F.lit("default")))
    here = F.struct(F.col("partition_key").alias("key"), F.col("op").alias("op"))
    there = F.struct(F.col(previous_key).alias("key"), F.lit("delete").alias("op"))
    both = events.withColumn("_at", F.explode(F.when(moved, F.array(there, here)).otherwise(F.array(here))))
    return both.withColumn("partition_key", F.col("_at.key")).withColumn("op", F.col("_at.op")).drop("_at", previous_key)


@dataclass(frozen=True)
class StandingOptions:
    """What a standing query keeps and tells.

    `most_events` limits the events of a key (the latest stay) and `most_matches` its active trends
    (the first by identity stay); by default neither is limited. Without `cancellations` only
    matches are told. With `max_gap_ms` consecutive events of a path are at most so far apart.
    """

    most_events: int | None = None
    most_matches: int | None = None
    cancellations: bool = True
    max_gap_ms: int | None = None


def standing_changes(events: DataFrame, spec: QuerySpec, *, lateness_ms: int = 1_800_000, options: StandingOptions | None = None, sequence: str | None = None, timed: str | None = None) -> DataFrame:
    """Changes (trend_id, query, key, path, change, revision) of a query's matches over a stream of events.

    Input: event_id, partition_key, event_type, event_time_ms, `op` (`delete` takes an event back,
    all else sets it) and the fields of the query's conditions. A later row of an identifier
    replaces an earlier one; of rows in one micro-batch the one with the highest `sequence` (a column
    of rising numbers, nulls first) wins, and without such a column a `delete` does. A change is
    `match` or `cancel`; per key and micro-batch the net changes come out, matches first, each in
    order of trend_id. Where a key can't be worked out, an `error` row with the reason comes out
    instead, its state stays as it was, and the other keys go on. `moves` prepares events that
    change their key.

    State per key: the events of the last `within_ms` + `lateness_ms` of event time, and the active
    trends that begin in it. What is older can't change any more: it leaves the state without a
    cancellation. `timed` names a timestamp column with a watermark; the state of keys that stay quiet
    beyond it is then dropped.
    """
    o = options or StandingOptions()
    use, fields = _usable(events, spec)
    names = {f: f"_f{i}" for i, f in enumerate(fields)}
    rows = events.select(
        F.coalesce(F.col("partition_key"), F.lit("default")).alias("partition_key"), "event_id", "event_type", "event_time_ms",
        F.coalesce(F.col("op") != "delete", F.lit(True)).alias("kept"), use.alias("use"), (F.lit(None) if sequence is None else F.col(sequence)).cast("long").alias("_seq"), *([F.col(timed).alias("_at")] if timed else []), *(field(events, f).cast("string").alias(n) for f, n in names.items()),
    ).where("event_id IS NOT NULL AND event_time_ms IS NOT NULL")
    steps, span = spec.steps, spec.within_ms + lateness_ms

    def evaluate(held: list[dict]) -> dict[str, list[int]]:
        found = {}
        for path in local_paths(steps, held, spec.within_ms):
            if o.max_gap_ms is not None and any(b["event_time_ms"] - a["event_time_ms"] > o.max_gap_ms for a, b in zip(path, path[1:], strict=False)):
                continue
            if all(local_holds(r, path) for r in spec.relations) and all(local_absent(a, path, held) for a in spec.absence):
                ids = [e["event_id"] for e in path]
                text = f"{spec.query_id}:{spec.version}:{path[0]['partition_key']}:{','.join(map(str, ids))}"
                found[hashlib.sha256(text.encode()).hexdigest()] = ids
        return found

    def changed(key: str, before: list[dict], arrived: list[dict]) -> tuple[list[dict], dict[str, list[int]]]:
        """A key's events within the horizon and its trends, after rows in order of arrival."""
        held = {e["event_id"]: e for e in before}
        for row in arrived:
            ident = int(row["event_id"])
            held.pop(ident, None)
            if row["kept"] and row["use"]:
                held[ident] = {"event_id": ident, "partition_key": key, "event_type": row["event_type"], "event_time_ms": int(row["event_time_ms"])} | {f: row[n] for f, n in names.items() if row[n] is not None}
        horizon = max((e["event_time_ms"] for e in held.values()), default=0) - span
        events_ = sorted((e for e in held.values() if e["event_time_ms"] >= horizon), key=lambda e: (e["event_time_ms"], e["event_id"]))
        if o.most_events is not None:
            events_ = events_[-o.most_events :]
        now = evaluate(events_)
        if o.most_matches is not None:
            now = {k: now[k] for k in sorted(now)[: o.most_matches]}
        return events_, now

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held_text, active_text, revision = state.get if state.exists else ("[]", "{}", 0)
        # rows of one key in a micro-batch come in any order
        arrived = pd.concat(list(batches)).sort_values(["_seq", "kept"], ascending=[True, False], na_position="first", kind="stable").to_dict("records")
        try:
            events_, now = changed(key[0], json.loads(held_text), arrived)
        except Exception as e:  # noqa: BLE001 - one key's data must not end the stream
            yield pd.DataFrame([(None, spec.query_id, spec.version, key[0], None, "error", revision, f"{type(e).__name__}: {e}")], columns=COLUMNS)
            return
        latest = max((e["event_time_ms"] for e in events_), default=0)
        start_of = {e["event_id"]: e["event_time_ms"] for e in events_}
        before = {k: v for k, v in json.loads(active_text).items() if v[1] >= latest - span}
        out = [(k, now[k], "match") for k in sorted(now.keys() - before.keys())]
        if o.cancellations:
            out += [(k, before[k][0], "cancel") for k in sorted(before.keys() - now.keys())]
        revision += 1
        state.update((json.dumps(events_), json.dumps({k: (v, start_of[v[0]]) for k, v in now.items()}), revision))
        if timed and state.getCurrentWatermarkMs() > 0:
            state.setTimeoutTimestamp(max(latest + span, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame([(k, spec.query_id, spec.version, key[0], ids, change, revision, None) for k, ids, change in out], columns=COLUMNS)

    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return rows.groupBy("partition_key").applyInPandasWithState(update, CHANGES, _STATE, "append", timeout)


def active_set(changes: DataFrame) -> DataFrame:
    """Trends whose last change is a match."""
    last = changes.where("trend_id IS NOT NULL").groupBy("trend_id").agg(F.max_by(F.struct("change", "query_id", "query_version", "partition_key", "path"), "revision").alias("x"))
    return last.where("x.change = 'match'").select("trend_id", "x.query_id", "x.query_version", "x.partition_key", "x.path")
