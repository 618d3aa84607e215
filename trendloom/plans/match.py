"""Standing matches: every subsequence of a key's events, in order of time and identifier, that fits a pattern.

Two plans give the same paths. Patterns that can be written out become chains of equi-joins;
others a fold over sorted arrays. Both work per (key, anchor), where the anchor is the stretch
of `within_ms` in which a path begins: its events lie in that stretch and the next, so a hot
key is spread over its stretches and no array holds more than two of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions.predicates import field
from trendloom.plans.pattern import Step, fixed_sequences
from trendloom.plans.spec import QuerySpec, Relation

#: A condition on an event of a path and the next one.
Between = Callable[[Column, Column], Column]

#: Names of the parts of an event inside a path.
ID, TIME, TYPE = "id", "t", "y"


def candidates(events: DataFrame, spec: QuerySpec, fields: tuple[str, ...] = (), types: bool = True) -> DataFrame:
    """Events that a query may use, as (partition_key, event_type, t, ev): its types and conditions, its fields only.

    Events without identifier, key, type or time can't be on a path.
    """
    rows = events.where(F.col("event_id").isNotNull() & F.col("partition_key").isNotNull() & F.col("event_type").isNotNull() & F.col("event_time_ms").isNotNull())
    if types:
        rows = rows.where(F.col("event_type").isin(spec.types()))
    for p in spec.where:
        rows = rows.where(p.column(events))
    return rows.select("partition_key", "event_type", F.col("event_time_ms").cast("long").alias("t"), event_of(events, fields).alias("ev"))


def event_of(events: DataFrame, fields: tuple[str, ...]) -> Column:
    """An event as it is on a path."""
    parts = [F.col("event_id").cast("long").alias(ID), F.col("event_time_ms").cast("long").alias(TIME), F.col("event_type").alias(TYPE)]
    return F.struct(*parts, *(field(events, f).alias(f) for f in fields))


def stretch(t: Column, within_ms: int) -> Column:
    """Where the stretch of time that holds t begins, in whole numbers."""
    return t - F.pmod(t, F.lit(max(1, within_ms)))


def with_anchors(df: DataFrame, within_ms: int, t: str = "t") -> DataFrame:
    """Each row for the two anchors whose paths it can be on; `own` where a path may begin."""
    at = stretch(F.col(t), within_ms)
    return df.withColumn("anchor", F.explode(F.array(at, at - max(1, within_ms)))).withColumn("own", F.col("anchor") == at)


def _after(a: Column, b: Column) -> Column:
    return (b[TIME] > a[TIME]) | ((b[TIME] == a[TIME]) & (b[ID] > a[ID]))


def _join_chain(rows: DataFrame, anchored: DataFrame, sequence: tuple[tuple[str, ...], ...], within_ms: int, between: Between | None) -> DataFrame:
    """Paths of one written-out sequence: joins on key and anchor, each later than the one before."""
    paths = rows.where(F.col("event_type").isin(list(sequence[0]))).select("partition_key", stretch(F.col("t"), within_ms).alias("anchor"), F.col("ev").alias("e0"))
    for i, accepted in enumerate(sequence[1:], 1):
        right = anchored.where(F.col("event_type").isin(list(accepted))).select(F.col("partition_key").alias("k2"), F.col("anchor").alias("a2"), F.col("ev").alias(f"e{i}"))
        first, last, new = F.col("e0"), F.col(f"e{i - 1}"), F.col(f"e{i}")
        on = (F.col("partition_key") == F.col("k2")) & (F.col("anchor") == F.col("a2")) & _after(last, new) & (new[TIME] - first[TIME] <= within_ms)
        if between is not None:
            on = on & F.coalesce(between(last, new), F.lit(False))
        paths = paths.join(right, on).drop("k2", "a2")
    return paths.select("partition_key", F.array(*(f"e{i}" for i in range(len(sequence)))).alias("path"))


def _targets(steps: tuple[Step, ...], i: int) -> list[int]:
    """Steps that may follow step i at once: the next ones up to the first that isn't optional."""
    out = []
    for j in range(i + 1, len(steps)):
        if steps[j].most != 0:
            out.append(j)
        if not steps[j].optional:
            break
    return out


def _fold(rows: DataFrame, steps: tuple[Step, ...], within_ms: int, between: Between | None) -> DataFrame:
    """Paths by a fold over the sorted events of each (key, anchor), carrying partial paths.

    A partial is (step, repeats, time of its first event, path); repeats count up to what the
    step needs. A pass from the end first finds, for each position and step, when a path that
    takes the step there can be complete at the earliest (repeats and `between` left aside), and
    the same for the events from there on. Only partials that can still be complete within the
    window are kept: so each that is held begins some path, however many events repeat a step.
    """
    kind = rows.schema["ev"].dataType.simpleString()
    partial = f"array<struct<i:int,r:int,t0:bigint,path:array<{kind}>>>"
    ends = [all(s.optional for s in steps[i + 1 :]) for i in range(len(steps))]
    begin = [j for j in _targets(steps, -1)]

    def made(i: int, r: Column, t0: Column, path: Column) -> Column:
        return F.struct(F.lit(i).alias("i"), r.cast("int").alias("r"), t0.alias("t0"), path.alias("path"))

    def fits(j: int, e: Column) -> Column:
        return e[TYPE].isin(list(steps[j].types))

    n = len(steps)
    follow = [_targets(steps, i) for i in range(n)]
    least_of = lambda xs: F.least(*xs) if len(xs) > 1 else xs[0]

    def back(acc: Column, item: Column) -> Column:
        """The events seen so far from the end, each with `g`, the earliest end of a path that takes each step there, and `f`, there or later."""
        e, f = item["ev"], acc["f"]
        g = [F.when(fits(j, e), e[TIME] if ends[j] else least_of([F.get(f, F.lit(k)) for k in follow[j]])) for j in range(n)]
        now = F.array(*(F.least(F.get(f, F.lit(j)), g[j]) for j in range(n)))
        seen = F.struct(item["own"].alias("own"), e.alias("ev"), F.array(*g).alias("g"), now.alias("f"))
        return F.struct(now.alias("f"), F.concat(acc["out"], F.array(seen)).alias("out"))

    def in_time(x: Column, g: Column) -> Column:
        """Whether a partial that has just taken its step can be complete in time."""
        return F.coalesce(F.get(g, x["i"]) - x["t0"] <= within_ms, F.lit(False))

    def lives(x: Column, f: Column) -> Column:
        """Whether a partial can be complete in time with events from here on."""
        ways = [F.when((x["i"] == i) & (least_of([F.get(f, F.lit(k)) for k in [i, *follow[i]]]) - x["t0"] <= within_ms), True) for i in range(n)]
        return F.coalesce(*ways, F.lit(False))

    def go_on(x: Column, e: Column) -> Column:
        options = []
        holds_ = F.lit(True) if between is None else F.coalesce(between(F.element_at(x["path"], -1), e), F.lit(False))
        for i, s in enumerate(steps):
            here = (x["i"] == i) & holds_
            longer = F.concat(x["path"], F.array(e))
            cap = s.most if s.most is not None else max(s.least, 1)
            again = fits(i, e) if s.most is None else fits(i, e) & (x["r"] < s.most)
            options.append(F.when(here & again, made(i, F.least(x["r"] + 1, F.lit(cap)), x["t0"], longer)))
            for j in follow[i]:
                options.append(F.when(here & (x["r"] >= s.least) & fits(j, e), made(j, F.lit(1), x["t0"], longer)))
        return F.filter(F.array(*options), lambda o: o.isNotNull())

    def accepted(x: Column) -> Column:
        return reduce(lambda a, b: a | b, [(x["i"] == i) & (x["r"] >= s.least) for i, s in enumerate(steps) if ends[i]])

    def step(acc: Column, item: Column) -> Column:
        e = item["ev"]
        alive = F.filter(acc["p"], lambda x: lives(x, item["f"]))
        begun = F.filter(F.array(*(F.when(item["own"] & fits(j, e), made(j, F.lit(1), e[TIME], F.array(e))) for j in begin)), lambda o: o.isNotNull())
        new = F.filter(F.concat(F.flatten(F.transform(alive, lambda x: go_on(x, e))), begun), lambda x: in_time(x, item["g"]))
        done = F.transform(F.filter(new, accepted), lambda x: x["path"])
        return F.struct(F.concat(alive, new).alias("p"), F.concat(acc["d"], done).alias("d"))

    start = F.struct(F.array().cast(partial).alias("p"), F.array().cast(f"array<array<{kind}>>").alias("d"))
    seen = f"array<struct<own:boolean,ev:{kind},g:array<bigint>,f:array<bigint>>>"
    start_back = F.struct(F.array(*[F.lit(None).cast("long")] * n).alias("f"), F.array().cast(seen).alias("out"))
    item = F.struct(F.col("ev")[TIME].alias("t"), F.col("ev")[ID].alias("id"), F.col("own"), F.col("ev"))
    lists = with_anchors(rows, within_ms).groupBy("partition_key", "anchor").agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
    lists = lists.where(F.exists("items", lambda x: x["own"])).select("partition_key", F.reverse(F.aggregate("items", start_back, back, lambda a: a["out"])).alias("items"))
    return lists.select("partition_key", F.explode(F.array_distinct(F.aggregate("items", start, step, lambda a: a["d"]))).alias("path"))


def ids(path: Column) -> Column:
    return F.transform(path, lambda e: e[ID])


def path_text(path: Column) -> Column:
    """Identifiers of a path, with commas."""
    return F.array_join(F.transform(path, lambda e: e[ID].cast("string")), ",")


def match_paths(events: DataFrame, spec: QuerySpec, fields: tuple[str, ...] = (), plan: str = "auto", between: Between | None = None) -> DataFrame:
    """All paths (partition_key, path) of a query before relations and absence; each once.

    A path is an array of events (id, t, y and `fields`). Positions rise strictly in order of
    (time, identifier); the last event is at most `within_ms` after the first. `plan` is `join`,
    `fold` or `auto`: joins where the pattern can be written out. `between` is a condition on each
    event of a path and the next one, given their `fields`; where it is null it doesn't hold.
    """
    steps = spec.steps
    rows = candidates(events, spec, fields)
    sequences = None if plan == "fold" else fixed_sequences(steps)
    if plan == "join" and sequences is None:
        raise ValueError("the pattern can't be written out for joins")
    if sequences is None:
        return _fold(rows, steps, spec.within_ms, between)
    anchored = with_anchors(rows, spec.within_ms)
    parts = [_join_chain(rows, anchored, s, spec.within_ms, between) for s in sequences]
    found = reduce(DataFrame.unionByName, parts)
    # two ways of writing a pattern out may accept one path
    return found if len(sequences) == 1 else found.withColumn("ids", path_text(F.col("path"))).dropDuplicates(["partition_key", "ids"]).drop("ids")


def holds(relation: Relation, path: Column) -> Column:
    """A relation over a path: nulls are left out, and one value or none passes."""
    chosen = path
    if relation.steps:
        at = F.array(*(F.lit(i) for i in relation.steps if i >= 0)) if any(i >= 0 for i in relation.steps) else F.array().cast("array<int>")
        chosen = F.transform(F.filter(at, lambda i: i < F.size(path)), lambda i: F.get(path, i))
    values = F.filter(F.transform(chosen, lambda e: e[relation.field]), lambda v: v.isNotNull())
    distinct = F.size(F.array_distinct(values))
    return distinct <= 1 if relation.op == "same" else distinct == F.size(values)


def without_absent(paths: DataFrame, events: DataFrame, spec: QuerySpec, matched: str = "path") -> DataFrame:
    """Paths in whose time no absent event lies: same key, from the first to the last time, not on the path.

    An anti-join on key and anchor for each absence. The query's own conditions hold for absent
    events too.
    """
    if not spec.absence:
        return paths
    first = F.array_min(F.transform(matched, lambda e: e[TIME]))
    last = F.array_max(F.transform(matched, lambda e: e[TIME]))
    paths = paths.withColumn("t0", first).withColumn("t1", last).withColumn("anchor", stretch(F.col("t0"), spec.within_ms)).withColumn("held", ids(F.col(matched)))
    for a in spec.absence:
        rows = events.where(F.col("event_type") == a.event_type)
        for p in (*spec.where, *a.where):
            rows = rows.where(p.column(events))
        rows = with_anchors(rows.select(F.col("partition_key").alias("k2"), F.col("event_time_ms").cast("long").alias("at"), F.col("event_id").alias("other")), spec.within_ms, "at").withColumnRenamed("anchor", "a2")
        on = (F.col("partition_key") == F.col("k2")) & (F.col("anchor") == F.col("a2")) & F.col("at").between(F.col("t0"), F.col("t1")) & ~F.array_contains("held", F.col("other"))
        if a.within_ms is not None:
            on = on & (F.col("at") - F.col("t0") <= a.within_ms)
        paths = paths.join(rows, on, "left_anti")
    return paths.drop("t0", "t1", "anchor", "held")


def match(events: DataFrame, spec: QuerySpec, fields: tuple[str, ...] = (), plan: str = "auto", between: Between | None = None) -> DataFrame:
    """All valid paths (partition_key, path) of a query: pattern, conditions, relations and absence."""
    wanted = tuple(dict.fromkeys([*fields, *(r.field for r in spec.relations)]))
    paths = match_paths(events, spec, wanted, plan, between)
    for r in spec.relations:
        paths = paths.where(holds(r, F.col("path")))
    return without_absent(paths, events, spec)
