"""Walks: from a seed event on, every following event of the key is on the path until the pattern is complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.plans.match import ID, TIME, TYPE, candidates, with_anchors
from trendloom.plans.pattern import parse_pattern
from trendloom.plans.spec import QuerySpec


def walk_steps(spec: QuerySpec) -> list[tuple[str, bool]]:
    """(type, repeats) of the plain steps; ValueError where the pattern needs more than exact types and `+`."""
    lacking = spec.beyond_walk() & {"optional", "bounded", "or"}
    if lacking:
        raise ValueError(f"a walk can't express {sorted(lacking)}; match the pattern as a standing query")
    return [(s.types[0], s.kleene) for s in parse_pattern(spec.walk_pattern())]


def repeats_take(spec: QuerySpec) -> bool:
    """Whether it matters which repetitions of a `+` step take it: where one of its types must be absent otherwise."""
    repeated = {s.types[0] for s in parse_pattern(spec.walk_pattern()) if s.kleene}
    return any(a.event_type in repeated for a in spec.absence)


def match_walks(events: DataFrame, spec: QuerySpec, fields: tuple[str, ...] = (), edge_window: tuple[int, int] | None = None, ways: bool = False) -> DataFrame:
    """All walks (partition_key, path) of a query, each once.

    A walk begins at an event of the first type. Each following event of the key in order of
    (time, identifier) is put on the path; one of the awaited type moves the pattern on (or, with
    `+` after the first step, may also leave it where it is). It ends where the pattern is
    complete, at most `within_ms` after its first event; equal times are admissible. A walk is
    thus fixed by its two ends. With `edge_window` all its events must lie in that time.

    With `ways` a walk comes once for each way of matching it, with `matched`, the events that took
    a step: for what relations and absence look at. An event that a `+` step leaves where it is
    takes none, so each step has one event; only where a repeated type must be absent otherwise
    do repetitions take the step as well, in every combination.

    Plan: a fold per (key, anchor) over sorted events that carries (step, first position, positions
    that took a step), see `trendloom.plans.match` for anchors. The query's `where` binds seeds and all others.
    """
    steps = walk_steps(spec)
    rows = candidates(events, spec, fields, types=False)
    if edge_window is not None:
        rows = rows.where(F.col("t").between(*edge_window))
    within = spec.within_ms
    kind = rows.schema["ev"].dataType.simpleString()
    item = F.struct(F.col("ev")[TIME].alias("t"), F.col("ev")[ID].alias("id"), F.col("own"), F.col("ev"))
    lists = with_anchors(rows, within).groupBy("partition_key", "anchor").agg(F.sort_array(F.collect_list(item)).alias("items"))
    lists = lists.where(F.exists("items", lambda x: x["own"] & (x["ev"][TYPE] == steps[0][0])))
    partial = "array<struct<i:int,first:int,t0:bigint,took:array<int>>>"
    start = F.struct(F.lit(0).alias("n"), F.array().cast(partial).alias("p"), F.array().cast("array<struct<first:int,last:int,took:array<int>>>").alias("d"))
    none = F.array().cast("array<int>")

    def partials(*options: Column) -> Column:
        return F.filter(F.array(*options), lambda o: o.isNotNull())

    def at(i: int, first: Column, t0: Column, took: Column, n: Column) -> Column:
        return F.struct(F.lit(i).alias("i"), first.alias("first"), t0.alias("t0"), (F.concat(took, F.array(n)) if ways else none).alias("took"))

    def go_on(x: Column, e: Column, n: Column) -> Column:
        """Where a partial stands after event n: on, still there, or both."""
        options = []
        for i, (name, repeats) in enumerate(steps):
            if not i:
                continue
            here, fits = x["i"] == i, e[TYPE] == name
            options.append(F.when(here & (~fits | F.lit(repeats)), x))
            options.append(F.when(here & fits, at(i + 1, x["first"], x["t0"], x["took"], n)))
            if repeats and ways and repeats_take(spec):
                options.append(F.when(here & fits, at(i, x["first"], x["t0"], x["took"], n)))
        return partials(*options)

    def step(acc: Column, x: Column) -> Column:
        e = x["ev"]
        alive = F.filter(acc["p"], lambda p: e[TIME] - p["t0"] <= within)
        seeds = partials(F.when(x["own"] & (e[TYPE] == steps[0][0]), at(1, acc["n"], e[TIME], none, acc["n"])))
        new = F.array_distinct(F.concat(F.flatten(F.transform(alive, lambda p: go_on(p, e, acc["n"]))), seeds))
        done = F.transform(F.filter(new, lambda p: p["i"] == len(steps)), lambda p: F.struct(p["first"].alias("first"), acc["n"].alias("last"), p["took"].alias("took")))
        return F.struct((acc["n"] + 1).alias("n"), F.filter(new, lambda p: p["i"] < len(steps)).alias("p"), F.concat(acc["d"], done).alias("d"))

    found = lists.select("partition_key", "items", F.explode(F.array_distinct(F.aggregate("items", start, step, lambda a: a["d"]))).alias("span"))
    path = F.transform(F.slice("items", F.col("span.first") + 1, F.col("span.last") - F.col("span.first") + 1), lambda x: x["ev"])
    path = path.cast(f"array<{kind}>").alias("path")
    if not ways:
        return found.select("partition_key", path)
    return found.select("partition_key", path, F.transform("span.took", lambda i: F.get("items", i)["ev"]).cast(f"array<{kind}>").alias("matched"))


def walk_rejects(events: DataFrame, spec: QuerySpec) -> DataFrame:
    """(n_seeds, n_edges, n_backward, n_beyond_window): what admissibility turns away over edges (src, dst) given
    in order of arrival: a next event earlier than the one before, or beyond the window from it."""
    lag = F.lag("event_time_ms").over(_arrival())
    seeds = F.sum((F.col("event_type") == walk_steps(spec)[0][0]).cast("long"))
    return events.withColumn("before", lag).agg(
        F.coalesce(seeds, F.lit(0)).alias("n_seeds"),
        F.count("before").alias("n_edges"),
        F.count_if(F.col("event_time_ms") < F.col("before")).alias("n_backward"),
        F.count_if(F.col("event_time_ms") - F.col("before") > spec.within_ms).alias("n_beyond_window"),
    )


def _arrival():
    from pyspark.sql import Window

    return Window.partitionBy("partition_key").orderBy("event_id")
