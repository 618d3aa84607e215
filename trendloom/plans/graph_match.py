"""Walks over a graph of events: temporal, entity and process edges."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.operators.graph import RELATIONS, event_graph
from trendloom.plans import graph_local
from trendloom.plans.match import candidates, holds, path_text, stretch, with_anchors, without_absent
from trendloom.plans.spec import QuerySpec
from trendloom.plans.walk import repeats_take, walk_steps
from trendloom.session import settle


#: Levels of a search between two writings.
LEVELS = 8


def _search(events: DataFrame, edges: DataFrame, spec: QuerySpec, fields: tuple[str, ...], max_length: int | None, ways: bool, counted: bool) -> dict[str, DataFrame]:
    """The levels of the search: `found` walks, and if counted `rejected` expansions, `cut` partial walks and `seeds`.

    One join of the partial walks with the edges per level, on the source event; edges carry their
    target, so the walks alone move, and what is complete is carried along. A walk comes up once, as
    its edges do, so nothing has to be made distinct. Every few levels the walks are written down,
    so none is worked out twice.
    """
    steps = walk_steps(spec)
    nodes = candidates(events, spec, fields).select(F.col("ev")["id"].alias("node"), "partition_key", "ev")
    src = nodes.select(F.col("node").alias("src"), F.col("ev")["t"].alias("src_t"))
    dst = nodes.select(F.col("node").alias("dst"), F.col("ev").alias("next"))
    windowed = F.col("window_end_ms") > F.col("window_start_ms")
    inside = F.col("src_t").between(F.col("window_start_ms"), F.col("window_end_ms")) & F.col("next")["t"].between(F.col("window_start_ms"), F.col("window_end_ms"))
    backward = F.col("next").isNull() | (F.col("next")["t"] < F.col("src_t")) | (F.col("next")["t"] - F.col("src_t") > spec.within_ms)
    reason = F.when(backward, "temporal").when(windowed & ~inside, "edge_window")
    hops = edges.join(src, "src").join(dst, "dst", "left" if counted else "inner").select("src", "dst", "next", reason.alias("reason"))
    if not counted:
        hops = hops.where("reason IS NULL")
    hops = settle(hops.distinct(), "hops")

    first = nodes.where(F.col("ev")["y"] == steps[0][0])
    start = [F.array("ev").alias("matched")] if ways else []
    walks = first.select("partition_key", F.col("node").alias("at"), F.lit(1).alias("step"), F.array("ev").alias("path"), *start, F.lit(None).cast("string").alias("reason"))
    seeds = walks.select("partition_key")
    active = (F.col("step") < len(steps)) & F.col("reason").isNull()

    # columns are made once: each level is the same plan over the last one's walks
    hops = hops.select("src", F.col("dst").alias("to"), "next", F.col("reason").alias("barred"))
    leads_on = (F.col("at") == F.col("src")) & active
    late = F.coalesce(F.col("next")["t"] - F.col("path")[0]["t"] > spec.within_ms, F.lit(False))
    why = F.when((F.col("barred") == "temporal") | late, "temporal").otherwise(F.col("barred"))
    again = F.array_contains(F.transform("path", lambda e: e["id"]), F.col("to"))
    usable = ~active | (F.col("src").isNotNull() & ~again & (F.lit(counted) | F.col("why").isNull()))

    def hop(front: DataFrame) -> DataFrame:
        """Partial walks with each edge that leads on (`to`, `next`) and why it can't be taken (`why`); all others as they are."""
        return front.join(hops, leads_on, "left").withColumn("why", why).where(usable)

    awaited = F.element_at(F.array(*(F.lit(n) for n, _ in steps)), F.col("step") + 1)
    repeats = F.element_at(F.array(*(F.lit(k) for _, k in steps)), F.col("step") + 1)
    fits = F.coalesce(F.col("next")["y"] == awaited, F.lit(False)) & F.col("why").isNull()
    to = lambda step, took: F.struct(step.alias("step"), F.lit(took).alias("took"))
    stays, moves = to(F.col("step"), False), to(F.col("step") + 1, True)
    stays_or_moves = [stays, moves, to(F.col("step"), True)] if ways and repeats_take(spec) else [stays, moves]
    goes = F.when(~active | ~fits, F.array(stays)).when(repeats, F.array(*stays_or_moves)).otherwise(F.array(moves))
    new = lambda moved, name: F.when(F.col("live"), moved).otherwise(F.col(name)).alias(name)
    took = [F.when(F.col("live") & F.col("go.took"), F.concat("matched", F.array("next"))).otherwise(F.col("matched")).alias("matched")] if ways else []
    tried = ["*", active.alias("live"), F.explode(goes).alias("go")]
    after = ["partition_key", new(F.col("to"), "at"), F.col("go.step").alias("step"), new(F.concat("path", F.array("next")), "path"), *took, new(F.col("why"), "reason")]
    complete = F.col("step") == len(steps)
    found, rejected, left = [], [], None if max_length is None else max_length - 1
    while left is None or left > 0:
        levels = LEVELS if left is None else min(LEVELS, left)
        for _level in range(levels):
            walks = hop(walks).select(*tried).select(*after)
        walks = settle(walks, "walks")
        left = None if left is None else left - levels
        found.append(walks.where(complete))
        rejected.append(walks.where("reason IS NOT NULL").select("partition_key", "reason"))
        walks = walks.where(active)
        if walks.isEmpty():
            break
    if not found:
        found = [walks.where(complete)]
    out = {"found": reduce(DataFrame.unionByName, found).select("partition_key", "path", *(["matched"] if ways else []))}
    if counted:
        out["seeds"] = seeds
        out["rejected"] = reduce(DataFrame.unionByName, rejected) if rejected else seeds.limit(0).withColumn("reason", F.lit(""))
        out["cut"] = hop(walks.where(active)).where("why IS NULL").select("partition_key", "at", "step", "path").distinct().select("partition_key")
    return out


def match_graph(events: DataFrame, edges: DataFrame, spec: QuerySpec, fields: tuple[str, ...] = (), max_length: int | None = None, ways: bool = False) -> DataFrame:
    """All walks (partition_key, path) along edges (src, dst, window_start_ms, window_end_ms), each once.

    As walks over consecutive events, but the next event is any that an edge leads to: of the
    awaited type it moves the pattern on, else it is only put on the path. Its time must not be
    before that of the event before, nor more than `within_ms` after the first; where an edge has
    a window, both ends must lie in it. Parallel edges give a path once, and a path holds no event
    twice (events of one time may lie on a cycle), so the frontier runs until it is empty. With
    `max_length` longer paths are left out: a parameter of the question, and `graph_statistics`
    tells how many partial walks it cuts. partition_key is that of the first event. Edges to
    unknown events lead nowhere.

    With `ways` a path comes once for each way of matching it, with `matched`, the events that took
    a step (`trendloom.plans.walk`).
    """
    found = _search(events, edges, spec, fields, max_length, ways, False)["found"]
    return found.distinct() if ways else found.withColumn("ids", path_text(F.col("path"))).dropDuplicates(["partition_key", "ids"]).drop("ids")


def find_graph(events: DataFrame, spec: QuerySpec, fields: tuple[str, ...] = (), keys: tuple[str, ...] = tuple(RELATIONS), max_gap_ms: int | None = None, max_length: int | None = None, text: bool = False) -> DataFrame:
    """Valid walks (partition_key, path), each once, over the graph of the events of a query's types; with `text` a path is its
    identifiers with commas.

    Relations and absence look at the events that took a step, in every way of matching a walk. The
    walks are searched by block of time where each block's events fit a task and no event comes
    twice (`trendloom.plans.graph_local`), else level by level.
    """
    by_block = graph_local.fits(events, spec.within_ms)
    # without `+` a walk can be matched in one way only
    one_way = by_block and not any(repeats for _, repeats in walk_steps(spec)[1:])
    ways = bool(spec.relations) or (bool(spec.absence) and not one_way)
    if by_block:
        found = graph_local.local_walks(events, _hidden(events, spec) if spec.absence else None, spec, fields, keys, max_gap_ms, max_length, ways, text)
    else:
        found = match_graph(events, event_graph(events, keys, max_gap_ms, once=False), spec, fields, max_length, ways)
    for r in spec.relations:
        found = found.where(holds(r, F.col("matched")))
    if not by_block:
        found = without_absent(found, events, spec, "matched")
        found = found.withColumn("path", path_text(F.col("path"))) if text else found
    if not one_way and (by_block or ways):
        found = found.withColumn("ids", F.col("path") if text else path_text(F.col("path"))).dropDuplicates(["partition_key", "ids"])
    return found.select("partition_key", "path")


def _hidden(events: DataFrame, spec: QuerySpec) -> DataFrame:
    """(seed, hidden): the absent events (at, other) of a seed's key that its walks may have in their time."""
    nodes = candidates(events, spec).where(F.col("event_type") == walk_steps(spec)[0][0])
    seeds = nodes.select(F.col("ev")["id"].alias("seed"), F.col("partition_key").alias("k"), F.col("t").alias("t0"), stretch(F.col("t"), spec.within_ms).alias("anchor"))
    parts = []
    for a in spec.absence:
        rows = events.where((F.col("event_type") == a.event_type) & F.col("event_id").isNotNull())
        for p in (*spec.where, *a.where):
            rows = rows.where(p.column(events))
        rows = with_anchors(rows.select(F.col("partition_key").alias("k2"), F.col("event_time_ms").cast("long").alias("at"), F.col("event_id").cast("long").alias("other")), spec.within_ms, "at").withColumnRenamed("anchor", "a2")
        most = spec.within_ms if a.within_ms is None else min(a.within_ms, spec.within_ms)
        near = (F.col("k") == F.col("k2")) & (F.col("anchor") == F.col("a2")) & F.col("at").between(F.col("t0"), F.col("t0") + most) & (F.col("other") != F.col("seed"))
        parts.append(seeds.join(rows, near).select("seed", "at", "other"))
    return reduce(DataFrame.unionByName, parts).groupBy("seed").agg(F.collect_set(F.struct("at", "other")).alias("hidden"))


def graph_statistics(events: DataFrame, edges: DataFrame, spec: QuerySpec, max_length: int | None = None) -> DataFrame:
    """What a search over a graph did, by key of the first event: (partition_key, seed_paths, paths_found, max_depth,
    paths_truncated, states_truncated, temporal_rejects, edge_window_rejects, overflow).

    A reject is an edge that a partial walk could not take, each once for each partial walk:
    `temporal` where its event is unknown, earlier than the one before or beyond `within_ms`, else
    `edge_window` where one of its ends lies outside its window. paths_truncated counts the partial
    walks that `max_length` cut although an edge leads on; states_truncated is 0, since no state is
    ever dropped. `overflow` is 1 where anything was cut.
    """
    s = _search(events, edges, spec, (), max_length, False, True)
    one = lambda df, name, n=None: df.select("partition_key", F.lit(name).alias("m"), (F.lit(1) if n is None else n).cast("long").alias("n"))
    found = s["found"].withColumn("ids", path_text(F.col("path"))).dropDuplicates(["partition_key", "ids"])
    rows = [one(s["seeds"], "seed_paths"), one(found, "paths_found"), one(found, "max_depth", F.size("path")), one(s["cut"], "paths_truncated")]
    rows.append(s["rejected"].select("partition_key", F.concat("reason", F.lit("_rejects")).alias("m"), F.lit(1).cast("long").alias("n")))
    total = lambda m: F.coalesce(F.sum(F.when(F.col("m") == m, F.col("n"))), F.lit(0)).alias(m)
    out = reduce(DataFrame.unionByName, rows).groupBy("partition_key").agg(
        total("seed_paths"), total("paths_found"), F.coalesce(F.max(F.when(F.col("m") == "max_depth", F.col("n"))), F.lit(0)).alias("max_depth"), total("paths_truncated"),
        F.lit(0).cast("long").alias("states_truncated"), total("temporal_rejects"), total("edge_window_rejects"),
    )
    return out.withColumn("overflow", (F.col("paths_truncated") > 0).cast("long"))
