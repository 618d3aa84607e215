"""Queries over the activity, trend and registry tables: matching, graphs, enrichment, replay, windows, metrics.

Each has its SQL for an oracle, over the same whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.engine import Options, compare, find, find_texts, run, stats
from trendloom.functions.canonical import checked, from_activity, from_ecs, from_ocsf, normalise
from trendloom.operators import graph, knowledge, metrics, replay, windows
from trendloom.operators.enrich import entities, features, risk, trends
from trendloom.plans.match import match, path_text
from trendloom.plans.spec import QuerySpec, Registry, compile_chains, compile_rule, latest_versions
from trendloom.plans.walk import walk_rejects
from trendloom.session import settle, spread
from trendloom.tables import table

HOUR, DAY = 3_600_000, 86_400_000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def events(spark: SparkSession, d: str) -> DataFrame:
    return from_activity(spread(table(spark, d, "events")))


def spec(pattern: str, within_ms: int, **more: object) -> QuerySpec:
    return QuerySpec.of({"query_id": "q", "pattern": pattern, "within_ms": within_ms, **more})


def shown(paths: DataFrame) -> DataFrame:
    return paths.select("partition_key", path_text(F.col("path")).alias("path"))


# the canonical events as SQL; c is what every oracle below starts from
C = """c AS (SELECT *, CASE WHEN k % 3 <> 0 THEN 'a' || (k % 10) END AS asset_id, k % 20 AS process_id, CASE WHEN k % 4 = 0 THEN (k + 1) % 20 END AS parent_process_id, (k % 10)::double AS asset_criticality
FROM (SELECT event_id, user_id::varchar AS partition_key, event_type, epoch_us(ts) // 1000 AS event_time_ms, json_extract_string(props, '$.k')::int AS k, 'u' || user_id AS user_id, 'h' || (user_id % 7) AS host_id,
 's' || user_id || '-' || ((epoch_us(ts) // 1000) // 86400000) AS session_id FROM events))"""


def later(a: str, b: str) -> str:
    return f"{b}.partition_key = {a}.partition_key AND ({b}.event_time_ms > {a}.event_time_ms OR ({b}.event_time_ms = {a}.event_time_ms AND {b}.event_id > {a}.event_id))"


def chain(types: list[str], within_ms: int, where: str = "true", source: str = "c") -> str:
    """Joins of one written-out sequence, under the names s0, s1, ..."""
    out = f"(SELECT * FROM {source} WHERE event_type IN ({types[0]})) s0"
    for i, t in enumerate(types[1:], 1):
        out += f" JOIN (SELECT * FROM {source} WHERE event_type IN ({t})) s{i} ON {later(f's{i - 1}', f's{i}')} AND s{i}.event_time_ms - s0.event_time_ms <= {within_ms}"
    return f"{out} WHERE {where}"


def path_sql(n: int) -> str:
    return " || ',' || ".join(f"s{i}.event_id" for i in range(n))


def chain_paths(types: list[str], within_ms: int, where: str = "true", source: str = "c") -> str:
    return f"SELECT s0.partition_key, {path_sql(len(types))} AS path FROM {chain(types, within_ms, where, source)}"


def simple(name: str, pattern: str, within_ms: int, sequences: list[list[str]]) -> None:
    """A standing query and its SQL as a union of written-out sequences."""
    sql = f"WITH {C} " + " UNION ".join(chain_paths(s, within_ms) for s in sequences)
    add(name, lambda s, d: shown(match(events(s, d), spec(pattern, within_ms))), sql)


CVP = ["'click'", "'view'", "'purchase'"]

# canonical events
CANON = ("event_id", "partition_key", "event_type", "event_time_ms", "user_id", "host_id", "session_id", "asset_id", "process_id", "parent_process_id", "asset_criticality")
add("canon_events", lambda s, d: events(s, d).select(*CANON), f"WITH {C} SELECT {', '.join(CANON)} FROM c")


def _rejects(spark: SparkSession, d: str) -> DataFrame:
    marked = checked(table(spark, d, "cet_event_buffer_v5").select("event_id", "partition_key", "event_type", "event_time_ms"))
    return marked.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_ids"))


add(
    "reject_events",
    _rejects,
    """WITH m AS (SELECT *, count(*) OVER (PARTITION BY event_id) AS copies FROM cet_event_buffer_v5)
SELECT CASE WHEN event_id IS NULL THEN 'missing event_id' WHEN partition_key IS NULL THEN 'missing partition_key' WHEN event_type IS NULL THEN 'missing event_type' WHEN event_time_ms IS NULL THEN 'missing event_time_ms'
  WHEN event_type = '' THEN 'empty event_type' WHEN copies > 1 THEN 'duplicate event_id' END AS reason, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM m GROUP BY 1""",
)

# adapters: documents made of the activity, and back
def _documents(e: DataFrame, **fields: object) -> DataFrame:
    return e.select(F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))).alias("raw_json"))


def _ecs(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    named = {"event": F.struct(F.col("event_id").cast("string").alias("id"), F.when(F.col("k") % 5 != 0, F.col("event_type")).alias("action"), F.upper("event_type").alias("category")), "user": F.struct(F.when(F.col("k") % 2 == 0, F.col("user_id")).alias("id"), F.concat(F.lit("n-"), "user_id").alias("name"))}
    docs = _documents(e, **named, host=F.struct(F.col("host_id").alias("name")), source=F.struct(F.lit("").alias("ip")), event_time_ms=F.col("event_time_ms"))
    return from_ecs(docs).select("event_id", "partition_key", "event_type", "event_time_ms", *(F.col("attributes")[f].alias(f) for f in ("user_id", "host_id", "source_ip")))


_WHO = "CASE WHEN k % 2 = 0 THEN user_id ELSE 'n-' || user_id END"
add("adapt_ecs", _ecs, f"WITH {C} SELECT event_id, {_WHO} AS partition_key, CASE WHEN k % 5 <> 0 THEN event_type ELSE upper(event_type) END AS event_type, event_time_ms, {_WHO} AS user_id, host_id, NULL::varchar AS source_ip FROM c")


def _ocsf(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(events(spark, d), uid=F.col("event_id"), class_name=F.col("event_type"), time=F.col("event_time_ms"), device=F.struct(F.col("host_id").alias("hostname")), actor=F.struct(F.struct(F.when(F.col("k") % 2 == 0, F.col("user_id")).alias("uid")).alias("user")), cloud=F.struct(F.col("asset_id").alias("account_uid")))
    return from_ocsf(docs).select("event_id", "partition_key", "event_type", "event_time_ms", *(F.col("attributes")[f].alias(f) for f in ("user_id", "host_id", "cloud_account_id")))


add("adapt_ocsf", _ocsf, f"WITH {C} SELECT event_id, coalesce(CASE WHEN k % 2 = 0 THEN user_id END, host_id) AS partition_key, event_type, event_time_ms, CASE WHEN k % 2 = 0 THEN user_id END AS user_id, host_id, asset_id AS cloud_account_id FROM c")


def _normalised(spark: SparkSession, d: str) -> DataFrame:
    odd = F.col("k") % 2 == 1
    docs = _documents(events(spark, d), id=F.col("event_id"), tenant_id=F.when(odd, ""), payload=F.struct(F.col("user_id").alias("user_id"), F.when(odd, F.col("event_type")).alias("eventName")), activity_name=F.concat(F.lit("x-"), "event_type"), timestamp_ms=F.when(F.col("k") % 3 == 0, F.col("event_time_ms")))
    return normalise(docs, "raw", 7).select("event_id", "partition_key", "event_type", "event_time_ms", "source_name")


add("normalise_raw", _normalised, f"WITH {C} SELECT event_id, user_id AS partition_key, CASE WHEN k % 2 = 1 THEN event_type ELSE 'x-' || event_type END AS event_type, CASE WHEN k % 3 = 0 THEN event_time_ms ELSE 7 END AS event_time_ms, 'raw' AS source_name FROM c")

# compilers: what they make, run
CHAIN = {"chain_id": "chain", "within_ms": 12 * HOUR, "steps": [{"event_type": "click"}, {"event_type": "view", "min_repeats": 0}, {"event_type": "purchase"}]}
RULE = {"title": "rule", "sequence": ["click", "purchase"], "condition_fields": {"host_id": "h3"}, "timeframe_ms": DAY}
add("compiled_chain", lambda s, d: shown(match(events(s, d), QuerySpec.of(compile_chains({"attack_chains": [CHAIN]})["queries"][0]))), f"WITH {C} " + " UNION ".join(chain_paths(x, 12 * HOUR) for x in (["'click'", "'purchase'"], CVP)))
add("compiled_rule", lambda s, d: shown(match(events(s, d), QuerySpec.of(compile_rule(RULE)))), f"WITH {C}, w AS (SELECT * FROM c WHERE host_id = 'h3') " + chain_paths(["'click'", "'purchase'"], DAY, source="w"))

# standing matches: fixed sequences, alternatives, optional and bounded steps
simple("seq3_any_1d", "click,view,purchase", DAY, [CVP])
simple("seq3_alternative", "click,(view|signup),purchase", DAY, [["'click'", "'view','signup'", "'purchase'"]])
simple("seq_optional", "click,view?,purchase", 12 * HOUR, [["'click'", "'purchase'"], CVP])
simple("seq_bounded_1_2", "click,view{1,2},purchase", DAY, [CVP, ["'click'", "'view'", "'view'", "'purchase'"]])
simple("seq_bounded_exact2", "click,view{2},purchase", 2 * DAY, [["'click'", "'view'", "'view'", "'purchase'"]])
simple("seq_leading_optional", "signup?,(error|click){1,2}", 6 * HOUR, [["'error','click'"], ["'error','click'"] * 2, ["'signup'", "'error','click'"], ["'signup'", "'error','click'", "'error','click'"]])


def recursive(start: str, moves: list[tuple[int, str, int]], last: int, within_ms: int, least: int = 1) -> str:
    """A recursive query: `moves` are (state, type, next state); paths end in state `last`; `n` counts repeats of state 1."""
    ways = " OR ".join(f"(r.state = {a} AND b.event_type = '{t}'" + (f" AND r.n >= {least}" if a == 1 and z != 1 else "") + ")" for a, t, z in moves)
    to = "CASE " + " ".join(f"WHEN r.state = {a} AND b.event_type = '{t}' THEN {z}" for a, t, z in moves) + " END"
    return f"""WITH RECURSIVE {C},
r AS (SELECT partition_key, event_id, event_time_ms, event_time_ms AS t0, event_id::varchar AS path, 1 AS state, 1 AS n FROM c WHERE event_type = '{start}'
  UNION ALL SELECT b.partition_key, b.event_id, b.event_time_ms, r.t0, r.path || ',' || b.event_id, {to}, r.n + CASE WHEN r.state = 1 AND b.event_type = '{start}' THEN 1 ELSE 0 END
  FROM r JOIN c b ON {later("r", "b")} AND b.event_time_ms - r.t0 <= {within_ms} AND ({ways}))
SELECT partition_key, path FROM r WHERE state = {last}"""


KLEENE = [(1, "error", 1), (1, "view", 2), (2, "purchase", 3)]
add("seq_kleene_1d", lambda s, d: shown(match(events(s, d), spec("error+,view,purchase", DAY))), recursive("error", KLEENE, 3, DAY))
add("seq_kleene_3d", lambda s, d: shown(match(events(s, d), spec("error+,view,purchase", 3 * DAY))), recursive("error", KLEENE, 3, 3 * DAY))
add("seq_kleene_open_2", lambda s, d: shown(match(events(s, d), spec("error{2,},purchase", DAY))), recursive("error", [(1, "error", 1), (1, "purchase", 2)], 2, DAY, least=2))
add("seq_fold_equals_join", lambda s, d: shown(match(events(s, d), spec("click,view?,purchase", 12 * HOUR), plan="fold")), SQL["seq_optional"])

# conditions
WHERE: dict[str, tuple[dict[str, object], str]] = {
    "eq": ({"field": "host_id", "op": "eq", "value": "h3"}, "host_id = 'h3'"),
    "ne": ({"field": "asset_id", "op": "!=", "value": "a1"}, "asset_id IS DISTINCT FROM 'a1'"),
    "in": ({"field": "asset_id", "op": "in", "value": ["a1", "a4", "a7"]}, "coalesce(asset_id IN ('a1', 'a4', 'a7'), false)"),
    "not_in": ({"field": "asset_id", "op": "not_in", "value": ["a1", "a4"]}, "NOT coalesce(asset_id IN ('a1', 'a4'), false)"),
    "contains": ({"field": "session_id", "op": "contains", "value": "-1972"}, "contains(session_id, '-1972')"),
    "regex": ({"field": "user_id", "op": "regex", "value": "^u[0-4]*$"}, "regexp_matches(user_id, '^u[0-4]*$')"),
    "gt": ({"field": "k", "op": ">", "value": 50}, "k > 50"),
    "gte": ({"field": "k", "op": "gte", "value": "50"}, "k >= 50"),
    "lt": ({"field": "asset_criticality", "op": "lt", "value": 5}, "asset_criticality < 5"),
    "lte": ({"field": "k", "op": "<=", "value": 33.5}, "k <= 33.5"),
    "exists": ({"field": "parent_process_id", "op": "exists"}, "parent_process_id IS NOT NULL"),
    "not_exists": ({"field": "asset_id", "op": "absent"}, "asset_id IS NULL"),
    "typed": ({"field": "k", "op": "gt", "value": 50, "event_type": "click"}, "(event_type <> 'click' OR k > 50)"),
}
for _name, (_doc, _sql) in WHERE.items():
    add(
        f"seq_where_{_name}",
        lambda s, d, doc=_doc: shown(match(events(s, d), spec("click,purchase", DAY, where=[doc]))),
        f"WITH {C}, w AS (SELECT * FROM c WHERE {_sql}) " + chain_paths(["'click'", "'purchase'"], DAY, source="w"),
    )


# conditions between an event of a path and the next
_RISING = f"WITH {C} {chain_paths(CVP, DAY, 's1.k > s0.k AND s2.k > s1.k')}"
for _plan in ("join", "fold"):
    add(f"seq_between_{_plan}", lambda s, d, plan=_plan: shown(match(events(s, d), spec("click,view,purchase", DAY), ("k",), plan, lambda a, b: b["k"] > a["k"])), _RISING)


# relations and absence
def related(name: str, relation: dict[str, object], test: str, within_ms: int = DAY) -> None:
    add(name, lambda s, d: shown(match(events(s, d), spec("click,view,purchase", within_ms, relations=[relation]))), f"WITH {C} {chain_paths(CVP, within_ms, test)}")


def _all_same(f: str, at: tuple[int, ...] = (0, 1, 2)) -> str:
    return " AND ".join(f"(s{i}.{f} = s{j}.{f} OR s{i}.{f} IS NULL OR s{j}.{f} IS NULL)" for i in at for j in at if i < j)


def _all_different(f: str) -> str:
    return " AND ".join(f"(s{i}.{f} <> s{j}.{f} OR s{i}.{f} IS NULL OR s{j}.{f} IS NULL)" for i in range(3) for j in range(i))


related("rel_same_session", {"field": "session_id", "op": "same"}, _all_same("session_id"))
related("rel_different_asset", {"field": "asset_id", "op": "different"}, _all_different("asset_id"))
related("rel_null_ignored", {"field": "asset_id", "op": "same"}, _all_same("asset_id"), 3 * DAY)
related("rel_steps_subset", {"field": "process_id", "op": "same", "steps": [0, 2, 9]}, _all_same("process_id", (0, 2)), 3 * DAY)


def absent(name: str, absence: dict[str, object], test: str) -> None:
    gone = f"NOT EXISTS (SELECT 1 FROM c x WHERE x.partition_key = s0.partition_key AND x.event_type = 'error' AND x.event_time_ms BETWEEN s0.event_time_ms AND s2.event_time_ms AND {test})"
    add(name, lambda s, d: shown(match(events(s, d), spec("click,view,purchase", DAY, absence=[absence]))), f"WITH {C} {chain_paths(CVP, DAY, gone)}")


absent("absence_between", {"event_type": "error"}, "true")
absent("absence_within_cap", {"event_type": "error", "within_ms": 6 * HOUR}, f"x.event_time_ms - s0.event_time_ms <= {6 * HOUR}")
absent("absence_with_where", {"event_type": "error", "where": [{"field": "k", "op": "gte", "value": 50}]}, "x.k >= 50")

# walks
NUMBERED = f"""WITH {C}, p AS (SELECT *, row_number() OVER (PARTITION BY partition_key ORDER BY event_time_ms, event_id) AS pos FROM c{{where}}),
n AS (SELECT *, min(CASE WHEN event_type = 'view' THEN pos END) OVER w AS nv, min(CASE WHEN event_type = 'purchase' THEN pos END) OVER w AS np FROM p
  WINDOW w AS (PARTITION BY partition_key ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
w AS ({{spans}}),
g AS (SELECT DISTINCT w.partition_key, w.s, w.e FROM w JOIN p a ON a.partition_key = w.partition_key AND a.pos = w.s JOIN p z ON z.partition_key = w.partition_key AND z.pos = w.e WHERE z.event_time_ms - a.event_time_ms <= {7 * DAY})
SELECT g.partition_key, string_agg(x.event_id::varchar, ',' ORDER BY x.pos) AS path FROM g JOIN p x ON x.partition_key = g.partition_key AND x.pos BETWEEN g.s AND g.e GROUP BY g.partition_key, g.s, g.e"""
NEXT = "SELECT a.partition_key, a.pos AS s, v.np AS e FROM n a JOIN n v ON v.partition_key = a.partition_key AND v.pos = a.nv WHERE a.event_type = 'click' AND v.np IS NOT NULL"
MID = "SELECT a.partition_key, a.pos AS s, v.np AS e FROM n a JOIN n v ON v.partition_key = a.partition_key AND v.pos > a.pos AND v.event_type = 'view' WHERE a.event_type = 'click' AND v.np IS NOT NULL"
_EDGE = (1_704_067_200_000 + 5 * DAY, 1_704_067_200_000 + 15 * DAY)
_WALK = Options(mode="walk")
add("walk_next_match_7d", lambda s, d: shown(find(events(s, d), spec("click,view,purchase", 7 * DAY), _WALK)), NUMBERED.format(where="", spans=NEXT))
add("walk_kleene_mid", lambda s, d: shown(find(events(s, d), spec("click,view+,purchase", 7 * DAY), _WALK)), NUMBERED.format(where="", spans=MID))


# relations and absence look at the events that take a step, in every way of matching a walk
ONE_USER = [{"field": "asset_id", "op": "same"}]
_SAME = lambda a, b: f"(coalesce({a}.asset_id = {b}.asset_id, true))"
_WAYS = MID.replace(" WHERE ", " JOIN p z ON z.partition_key = v.partition_key AND z.pos = v.np WHERE ")
add("walk_relation", lambda s, d: shown(find(events(s, d), spec("click,view+,purchase", 7 * DAY, relations=ONE_USER), _WALK)), NUMBERED.format(where="", spans=f"{_WAYS} AND {_SAME('a', 'v')} AND {_SAME('v', 'z')} AND {_SAME('a', 'z')}"))
_STEPS = NEXT.replace(" WHERE ", " JOIN p z ON z.partition_key = v.partition_key AND z.pos = v.np WHERE ")
add(
    "walk_absence",
    lambda s, d: shown(find(events(s, d), spec("click,view,purchase", 7 * DAY, absence=[{"event_type": "error", "within_ms": DAY}]), _WALK)),
    NUMBERED.format(where="", spans=f"{_STEPS} AND NOT EXISTS (SELECT 1 FROM c x WHERE x.partition_key = a.partition_key AND x.event_type = 'error' AND x.event_time_ms BETWEEN a.event_time_ms AND z.event_time_ms AND x.event_time_ms - a.event_time_ms <= {DAY})"),
)


def _walk_edge(spark: SparkSession, d: str) -> DataFrame:
    from trendloom.plans.walk import match_walks

    return shown(match_walks(events(spark, d), spec("click,view,purchase", 7 * DAY), edge_window=_EDGE))


add("walk_edge_window", _walk_edge, NUMBERED.format(where=f" WHERE event_time_ms BETWEEN {_EDGE[0]} AND {_EDGE[1]}", spans=NEXT))
add(
    "walk_rejects",
    lambda s, d: walk_rejects(events(s, d), spec("click,view", HOUR)),
    f"""WITH {C}, b AS (SELECT *, lag(event_time_ms) OVER (PARTITION BY partition_key ORDER BY event_id) AS before FROM c)
SELECT sum((event_type = 'click')::int)::bigint AS n_seeds, count(before) AS n_edges, count(*) FILTER (WHERE event_time_ms < before) AS n_backward, count(*) FILTER (WHERE event_time_ms - before > {HOUR}) AS n_beyond_window FROM b""",
)

# graphs
T_EDGES = """SELECT event_id AS src, lead(event_id) OVER w AS dst, 'temporal_next' AS relation, event_time_ms AS window_start_ms, lead(event_time_ms) OVER w AS window_end_ms FROM {c} WINDOW w AS (PARTITION BY partition_key ORDER BY event_time_ms, event_id)"""
E_EDGES = " UNION ALL ".join(
    f"SELECT event_id, lead(event_id) OVER w, '{r}', event_time_ms, lead(event_time_ms) OVER w FROM {{c}} WHERE {f} IS NOT NULL AND {f}::varchar <> '' WINDOW w AS (PARTITION BY {f} ORDER BY event_time_ms, event_id)"
    for f, r in (("host_id", "same_host"), ("session_id", "same_session"), ("asset_id", "same_asset"))
)
P_EDGES = """SELECT p.event_id, ch.event_id, 'parent_process', p.event_time_ms, ch.event_time_ms FROM {c} ch JOIN {c} p ON p.process_id = ch.parent_process_id AND p.event_time_ms <= ch.event_time_ms
 QUALIFY row_number() OVER (PARTITION BY ch.event_id ORDER BY p.event_time_ms DESC, p.event_id DESC) = 1"""
KEYS = ("host_id", "session_id", "asset_id")
COLS = ("src", "dst", "relation", "window_start_ms", "window_end_ms")
edges_sql = lambda body, more="": f"WITH {C}, x(src, dst, relation, window_start_ms, window_end_ms) AS ({body.replace('{c}', 'c')}) SELECT DISTINCT * FROM x WHERE dst IS NOT NULL AND src <> dst{more}"
add("edges_temporal", lambda s, d: graph.temporal_edges(events(s, d)).select(*COLS), edges_sql(T_EDGES))
add("edges_entity", lambda s, d: graph.entity_edges(events(s, d), KEYS).select(*COLS), edges_sql(E_EDGES))
# every entity field that the events fill: the operator's default keys
E_ALL = E_EDGES + "".join(
    f" UNION ALL SELECT event_id, lead(event_id) OVER w, '{r}', event_time_ms, lead(event_time_ms) OVER w FROM {{c}} WHERE {f} IS NOT NULL AND {f}::varchar <> '' WINDOW w AS (PARTITION BY {f} ORDER BY event_time_ms, event_id)"
    for f, r in (("user_id", "same_user"), ("process_id", "same_process"))
)
add("edges_entity_all", lambda s, d: graph.entity_edges(events(s, d)).select(*COLS), edges_sql(E_ALL))
add("edges_parent_asof", lambda s, d: graph.parent_edges(events(s, d)).select(*COLS), edges_sql(P_EDGES))
add("edges_max_gap", lambda s, d: graph.event_graph(events(s, d), KEYS, HOUR).select(*COLS), edges_sql(f"{T_EDGES} UNION ALL {E_EDGES} UNION ALL SELECT * FROM ({P_EDGES})", f" AND window_end_ms - window_start_ms <= {HOUR}"))
add("edges_max_gap_all", lambda s, d: graph.event_graph(events(s, d), max_gap_ms=HOUR).select(*COLS), edges_sql(f"{T_EDGES} UNION ALL {E_ALL} UNION ALL SELECT * FROM ({P_EDGES})", f" AND window_end_ms - window_start_ms <= {HOUR}"))
add(
    "edges_all_pairs",
    lambda s, d: graph.all_pair_edges(events(s, d), "session_id", 6 * HOUR).select(*COLS),
    f"WITH {C} SELECT a.event_id AS src, b.event_id AS dst, 'same_session' AS relation, a.event_time_ms AS window_start_ms, b.event_time_ms AS window_end_ms FROM c a JOIN c b ON a.session_id = b.session_id AND (b.event_time_ms > a.event_time_ms OR (b.event_time_ms = a.event_time_ms AND b.event_id > a.event_id)) AND b.event_time_ms - a.event_time_ms <= {6 * HOUR}",
)
add(
    "edges_chain_window",
    lambda s, d: graph.chain_edges(events(s, d)),
    f"""WITH {C}, x AS (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY partition_key ORDER BY event_time_ms, event_id) AS dst, min(event_time_ms) OVER (PARTITION BY partition_key) AS window_start_ms, max(event_time_ms) OVER (PARTITION BY partition_key) AS window_end_ms FROM c)
SELECT * FROM x WHERE dst IS NOT NULL""",
)
def _changes(spark: SparkSession, d: str) -> DataFrame:
    """The activity table as changes: every third event is taken back later, every fifth is sent again with another type."""
    e = events(spark, d).select("event_id", "partition_key", "event_type", "event_time_ms")
    first = e.withColumn("op", F.lit("upsert")).withColumn("seq", F.col("event_id") * 3)
    gone = e.where("event_id % 3 = 0").withColumn("op", F.lit("delete")).withColumn("seq", F.col("event_id") * 3 + 1)
    again = e.where("event_id % 5 = 0").withColumn("event_type", F.lit("fixed")).withColumn("op", F.lit("upsert")).withColumn("seq", F.col("event_id") * 3 + 2)
    return first.unionByName(gone).unionByName(again)


CHANGES = f"""WITH {C}, ch AS (SELECT event_id, partition_key, event_type, event_time_ms, 'upsert' AS op, event_id * 3 AS seq FROM c UNION ALL SELECT event_id, partition_key, event_type, event_time_ms, 'delete', event_id * 3 + 1 FROM c WHERE event_id % 3 = 0
 UNION ALL SELECT event_id, partition_key, 'fixed', event_time_ms, 'upsert', event_id * 3 + 2 FROM c WHERE event_id % 5 = 0)"""
add("graph_mutations", lambda s, d: graph.mutation_log(_changes(s, d)), f"{CHANGES} SELECT op, event_id, partition_key, row_number() OVER (PARTITION BY partition_key ORDER BY seq) AS revision, event_time_ms AS happened_at_ms FROM ch")
add(
    "graph_current_edges",
    lambda s, d: graph.temporal_edges(graph.current_events(_changes(s, d))).select(*COLS),
    f"{CHANGES}, x AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq DESC) = 1), y AS (SELECT * FROM x WHERE op <> 'delete'), z AS ({T_EDGES.replace('{c}', 'y')}) SELECT * FROM z WHERE dst IS NOT NULL",
)
# the window ends every walk, and no walk is cut
_GRAPH = Options(mode="graph", entity_keys=KEYS, max_gap_ms=6 * HOUR)


def graph_walks(within_ms: int, where: str) -> str:
    return f"""WITH RECURSIVE {C}, f AS (SELECT * FROM c WHERE event_type IN ('click', 'purchase')),
x(src, dst, relation, a, z) AS ({T_EDGES.replace("{c}", "f")} UNION ALL {E_EDGES.replace("{c}", "f")} UNION ALL SELECT * FROM ({P_EDGES.replace("{c}", "f")})),
h AS (SELECT DISTINCT src, dst, b.event_type, b.event_time_ms, b.asset_id FROM x JOIN f b ON b.event_id = dst WHERE src <> dst AND z - a <= {6 * HOUR}),
r AS (SELECT partition_key, event_id AS at, event_time_ms AS t0, asset_id AS a0, asset_id AS a1, [event_id] AS path, false AS done FROM f WHERE event_type = 'click'
  UNION SELECT r.partition_key, h.dst, r.t0, r.a0, h.asset_id, list_append(r.path, h.dst), h.event_type = 'purchase' FROM r JOIN h ON h.src = r.at WHERE NOT r.done AND NOT list_contains(r.path, h.dst) AND h.event_time_ms - r.t0 <= {within_ms})
SELECT DISTINCT partition_key, array_to_string(path, ',') AS path FROM r WHERE done AND {where}"""


add("graph_walk_2step", lambda s, d: find_texts(events(s, d), spec("click,purchase", 2 * HOUR), _GRAPH), graph_walks(2 * HOUR, "true"))
add("graph_walk_whole", lambda s, d: find_texts(events(s, d), spec("click,purchase", 12 * HOUR), _GRAPH), graph_walks(12 * HOUR, "true"))
add("graph_walk_relation", lambda s, d: find_texts(events(s, d), spec("click,purchase", 4 * HOUR, relations=ONE_USER), _GRAPH), graph_walks(4 * HOUR, "coalesce(a0 = a1, true)"))
add(
    "graph_walk_absence",
    lambda s, d: find_texts(events(s, d), spec("click,purchase", 4 * HOUR, absence=[{"event_type": "click"}]), _GRAPH),
    graph_walks(4 * HOUR, "NOT EXISTS (SELECT 1 FROM c e, c y WHERE e.event_id = r.at AND y.partition_key = r.partition_key AND y.event_type = 'click' AND y.event_time_ms BETWEEN r.t0 AND e.event_time_ms AND y.event_id <> r.path[1])"),
)


# what a graph run does: the events' graph with windows of two hours, and every tenth edge the other way as well; walks of
# up to four events, the others counted as cut
STATS = Registry.of([{"query_id": "buy", "pattern": "click,purchase", "within_ms": 4 * HOUR, "where": [{"field": "k", "op": "gte", "value": 20, "event_type": "purchase"}]}, {"query_id": "wide", "pattern": "(click|view),purchase", "within_ms": HOUR}])
_SHORT = Options(mode="graph", max_length=4)


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    from trendloom.engine import statistics

    e = events(spark, d)
    forth = graph.event_graph(e.where(F.col("event_type").isin("click", "purchase")), KEYS, 6 * HOUR).select("src", "dst", "window_start_ms", (F.col("window_start_ms") + 2 * HOUR).alias("window_end_ms"))
    back = forth.where("src % 10 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "window_start_ms", "window_end_ms")
    return statistics(e, STATS, _SHORT, settle(forth.unionByName(back), "edges"))


GSTATS = f"""WITH RECURSIVE {C}, f AS (SELECT * FROM c WHERE event_type IN ('click', 'purchase')),
x0(src, dst, relation, a, z) AS ({T_EDGES.replace("{c}", "f")} UNION ALL {E_EDGES.replace("{c}", "f")} UNION ALL SELECT * FROM ({P_EDGES.replace("{c}", "f")})),
x1 AS (SELECT src, dst, a FROM x0 WHERE src <> dst AND z - a <= {6 * HOUR}), x AS (SELECT * FROM x1 UNION ALL SELECT dst, src, a FROM x1 WHERE src % 10 = 0),
g AS (SELECT * FROM f WHERE event_type = 'click' OR k >= 20),
h AS (SELECT DISTINCT s.event_id AS src, x.dst, b.event_type, b.event_time_ms AS t,
  CASE WHEN b.event_id IS NULL OR b.event_time_ms < s.event_time_ms OR b.event_time_ms - s.event_time_ms > {4 * HOUR} THEN 'temporal' WHEN NOT (s.event_time_ms BETWEEN x.a AND x.a + {2 * HOUR} AND b.event_time_ms BETWEEN x.a AND x.a + {2 * HOUR}) THEN 'edge_window' END AS reason
  FROM x JOIN g s ON s.event_id = x.src LEFT JOIN g b ON b.event_id = x.dst),
r AS (SELECT partition_key, event_id AS at, event_time_ms AS t0, [event_id] AS path, false AS done FROM g WHERE event_type = 'click'
  UNION SELECT r.partition_key, h.dst, r.t0, list_append(r.path, h.dst), h.event_type = 'purchase' FROM r JOIN h ON h.src = r.at WHERE NOT r.done AND len(r.path) < 4 AND h.reason IS NULL AND NOT list_contains(r.path, h.dst) AND h.t - r.t0 <= {4 * HOUR}),
j AS (SELECT r.*, h.dst, CASE WHEN h.reason = 'temporal' OR h.t - r.t0 > {4 * HOUR} THEN 'temporal' ELSE h.reason END AS why FROM r JOIN h ON h.src = r.at WHERE NOT r.done AND NOT list_contains(r.path, h.dst)),
m AS (SELECT partition_key, len(path) = 1 AS seed, done, len(path) AS n, 0 AS cut, 0 AS tr, 0 AS er FROM r
  UNION ALL SELECT partition_key, false, false, 0, 0, (why = 'temporal')::int, (why = 'edge_window')::int FROM j WHERE why IS NOT NULL AND len(path) < 4
  UNION ALL SELECT partition_key, false, false, 0, 1, 0, 0 FROM (SELECT DISTINCT partition_key, j.at, path FROM j WHERE why IS NULL AND len(path) = 4)),
st AS (SELECT partition_key, count(*) FILTER (WHERE seed) AS seed_paths, count(*) FILTER (WHERE done) AS paths_found, coalesce(max(n) FILTER (WHERE done), 0)::bigint AS max_depth, sum(cut)::bigint AS paths_truncated, 0::bigint AS states_truncated,
  sum(tr)::bigint AS temporal_rejects, sum(er)::bigint AS edge_window_rejects FROM m GROUP BY 1),
gs AS (SELECT 'buy' AS query_id, 'v1' AS query_version, st.*, (paths_truncated > 0)::bigint AS overflow, (SELECT count(*) FROM f WHERE f.partition_key = st.partition_key AND event_type = 'purchase' AND k < 20) AS predicate_rejects, 'ok' AS status FROM st
 UNION ALL SELECT 'wide', 'v1', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'err')"""
add("graph_statistics", lambda s, d: _statistics(s, d).drop("error"), f"{GSTATS} SELECT * FROM gs")

# enrichment
FULL = ("user_id", "host_id", "session_id", "asset_id", "asset_criticality")
HIGH = spec("click,view,purchase", DAY, severity="high", score={"boost": 5})
SHA = lambda n: f"sha256('q:v1:' || s0.partition_key || ':' || {path_sql(n)})"
add("trend_ids", lambda s, d: trends(match(events(s, d), HIGH), HIGH).select("trend_id", "partition_key"), f"WITH {C} SELECT {SHA(3)} AS trend_id, s0.partition_key FROM {chain(CVP, DAY)}")


def _features(spark: SparkSession, d: str) -> DataFrame:
    f = features(F.col("path"))
    rows = match(events(spark, d), spec("(click|error){1,2},purchase", 12 * HOUR)).select("partition_key", path_text(F.col("path")).alias("path"), f.alias("f"))
    return rows.select("partition_key", "path", "f.event_count", "f.trend_start_time_ms", "f.trend_end_time_ms", "f.duration_ms", F.array_join("f.event_types", ",").alias("event_types"), F.array_join("f.distinct_event_types", ",").alias("distinct_event_types"))


_CE = "'click','error'"


def _feature_sql(n: int) -> str:
    types = ", ".join(f"s{i}.event_type" for i in range(n))
    return f"SELECT s0.partition_key, {path_sql(n)} AS path, {n}::bigint AS event_count, s0.event_time_ms AS trend_start_time_ms, s{n - 1}.event_time_ms AS trend_end_time_ms, s{n - 1}.event_time_ms - s0.event_time_ms AS duration_ms, array_to_string([{types}], ',') AS event_types, array_to_string(list_sort(list_distinct([{types}])), ',') AS distinct_event_types FROM {chain([_CE] * (n - 1) + ["'purchase'"], 12 * HOUR)}"


add("features", _features, f"WITH {C} {_feature_sql(2)} UNION ALL {_feature_sql(3)}")


def _entities(spark: SparkSession, d: str) -> DataFrame:
    rows = match(events(spark, d), HIGH, FULL[:4]).select("partition_key", path_text(F.col("path")).alias("path"), entities(F.col("path"), FULL[:4]).alias("m"))
    return rows.select("partition_key", "path", *(F.array_join(F.try_element_at("m", F.lit(b)), ",").alias(b) for b in ("users", "hosts", "sessions", "assets")))


_listed = lambda f: f"nullif(array_to_string(list_sort(list_distinct(list_filter([s0.{f}, s1.{f}, s2.{f}], lambda x: x IS NOT NULL))), ','), '')"
add("entities", _entities, f"WITH {C} SELECT s0.partition_key, {path_sql(3)} AS path, {_listed('user_id')} AS users, {_listed('host_id')} AS hosts, {_listed('session_id')} AS sessions, {_listed('asset_id')} AS assets FROM {chain(CVP, DAY)}")


def _risk(spark: SparkSession, d: str) -> DataFrame:
    rows = match(events(spark, d), HIGH, FULL).select("partition_key", path_text(F.col("path")).alias("path"), risk(F.col("path"), F.lit("high"), "asset_criticality", 5.0).alias("r"))
    return rows.select("partition_key", "path", "r.risk_score", "r.severity", "r.explanation.path_bonus", "r.explanation.asset_criticality_bonus")


_CRIT = "greatest(s0.asset_criticality, s1.asset_criticality, s2.asset_criticality)"
_SCORE = f"least(100.0, 75.0 + 2.0 + {_CRIT} + 5.0)::double"
add("risk_score", _risk, f"WITH {C} SELECT s0.partition_key, {path_sql(3)} AS path, {_SCORE} AS risk_score, CASE WHEN {_SCORE} >= 90 THEN 'critical' ELSE 'high' END AS severity, 2.0::double AS path_bonus, {_CRIT} AS asset_criticality_bonus FROM {chain(CVP, DAY)}")

# knowledge graph, evidence, timelines
NAMED = f"""WITH {C}, n AS (SELECT event_id, event_time_ms, o, kind, key, sha256(kind || ':' || key) AS id FROM (
 SELECT event_id, event_time_ms, 0 AS o, 'user' AS kind, user_id AS key FROM c UNION ALL SELECT event_id, event_time_ms, 1, 'host', host_id FROM c UNION ALL SELECT event_id, event_time_ms, 2, 'session', session_id FROM c
 UNION ALL SELECT event_id, event_time_ms, 5, 'process', process_id::varchar FROM c UNION ALL SELECT event_id, event_time_ms, 6, 'asset', asset_id FROM c) WHERE key IS NOT NULL AND key <> '')"""
add("kg_entities", lambda s, d: knowledge.kg_entities(events(s, d)).drop("source_field"), f"{NAMED} SELECT id AS entity_id, kind AS entity_type, key AS entity_key, min(event_time_ms) AS first_seen_ms, max(event_time_ms) AS last_seen_ms FROM n GROUP BY ALL")
add(
    "kg_relations",
    lambda s, d: knowledge.kg_relations(events(s, d)),
    f"{NAMED} SELECT a.id AS src_entity_id, b.id AS dst_entity_id, 'co_observed:' || a.kind || ':' || b.kind AS relation_type, a.event_id, a.event_time_ms FROM n a JOIN n b ON a.event_id = b.event_id AND a.o < b.o",
)


def _trends(spark: SparkSession, d: str) -> DataFrame:
    return run(events(spark, d), Registry((HIGH,)), Options())


T3 = f"t AS (SELECT {SHA(3)} AS trend_id, s0.partition_key, s0.event_id AS e0, s1.event_id AS e1, s2.event_id AS e2, {_SCORE} AS risk_score, CASE WHEN {_SCORE} >= 90 THEN 'critical' ELSE 'high' END AS severity, s0.event_time_ms AS t0, s2.event_time_ms AS t2 FROM {chain(CVP, DAY)})"
EV3 = f"WITH {C}, {T3}, v AS (SELECT trend_id, e0 AS event_id, 0::bigint AS ordinal, risk_score FROM t UNION ALL SELECT trend_id, e1, 1, risk_score FROM t UNION ALL SELECT trend_id, e2, 2, risk_score FROM t)"
add("kg_evidence", lambda s, d: knowledge.trend_evidence(_trends(s, d)), f"{EV3} SELECT trend_id, 'q' AS query_id, event_id, ordinal, risk_score FROM v")
add("timeline", lambda s, d: knowledge.timelines(_trends(s, d), events(s, d)), f"{EV3} SELECT trend_id, ordinal, event_id, event_type, event_time_ms, partition_key FROM v JOIN c USING (event_id)")
TEXTS = {"checks": ("Was this approved work?",), "serious_checks": ("Has a second person looked at it?",)}
add(
    "investigation_flags",
    lambda s, d: knowledge.investigations(_trends(s, d), events(s, d), {"q": ["T1078"]}, TEXTS).select("trend_id", "severity", F.element_at("timeline", 1)["event_type"].alias("first_type"), F.size("timeline").cast("long").alias("n_timeline"), F.size("checks").cast("long").alias("n_checks"), F.array_join("techniques", ",").alias("techniques"), F.array_join("questions", " ").alias("questions")),
    f"""WITH {C}, {T3} SELECT trend_id, severity, 'click' AS first_type, 3::bigint AS n_timeline, 2::bigint AS n_checks, 'T1078' AS techniques,
 'What else did user_id ' || a.user_id || ' do around this time? What else did host_id ' || a.host_id || ' do around this time? ' || CASE WHEN a.session_id = b.session_id AND b.session_id = z.session_id THEN 'What else did session_id ' || a.session_id || ' do around this time?' ELSE 'Why does session_id change along the path?' END AS questions
FROM t JOIN c a ON a.event_id = e0 JOIN c b ON b.event_id = e1 JOIN c z ON z.event_id = e2""",
)


def _evidence_edges(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return graph.path_edges(_trends(spark, d).select("trend_id", F.col("path").alias("ids")), graph.entity_edges(e, KEYS)).drop("evidence")


add("path_edge_evidence", _evidence_edges, f"WITH {C}, x(src, dst, relation, a, z) AS ({E_EDGES.replace('{c}', 'c')}), {T3}, p AS (SELECT trend_id, 0::bigint AS ordinal, e0 AS src, e1 AS dst FROM t UNION ALL SELECT trend_id, 1, e1, e2 FROM t) SELECT DISTINCT trend_id, ordinal, p.src, p.dst, relation FROM p JOIN x ON x.src = p.src AND x.dst = p.dst")

def _evidence_all(spark: SparkSession, d: str) -> DataFrame:
    return graph.path_edges(_trends(spark, d).select("trend_id", F.col("path").alias("ids")), graph.event_graph(events(spark, d))).drop("evidence")


add("path_edge_evidence_all", _evidence_all, f"WITH {C}, x(src, dst, relation, a, z) AS ({T_EDGES.replace('{c}', 'c')} UNION ALL {E_ALL.replace('{c}', 'c')} UNION ALL SELECT * FROM ({P_EDGES.replace('{c}', 'c')})), {T3}, p AS (SELECT trend_id, 0::bigint AS ordinal, e0 AS src, e1 AS dst FROM t UNION ALL SELECT trend_id, 1, e1, e2 FROM t) SELECT DISTINCT trend_id, ordinal, p.src, p.dst, relation FROM p JOIN x ON x.src = p.src AND x.dst = p.dst")

# several queries, comparisons
REGISTRY = Registry.of(
    [
        {"query_id": "buy", "pattern": "click,view,purchase", "within_ms": 12 * HOUR, "severity": "high"},
        {"query_id": "errors", "pattern": "error{2},purchase", "within_ms": DAY, "severity": "critical", "relations": [{"field": "session_id", "op": "same"}]},
        {"query_id": "join", "pattern": "signup,(view|click)", "within_ms": 6 * HOUR, "version": "v2", "absence": [{"event_type": "error"}]},
        {"query_id": "off", "pattern": "click", "within_ms": 1, "enabled": False},
    ]
)


def _multi(spark: SparkSession, d: str) -> DataFrame:
    return run(events(spark, d), REGISTRY).select("query_id", "query_version", "partition_key", F.concat_ws(",", F.transform("path", lambda x: x.cast("string"))).alias("path"), "event_count", "severity")


_NOERR = "NOT EXISTS (SELECT 1 FROM c x WHERE x.partition_key = s0.partition_key AND x.event_type = 'error' AND x.event_time_ms BETWEEN s0.event_time_ms AND s1.event_time_ms)"
_band = lambda base, n: "CASE WHEN {0} >= 90 THEN 'critical' WHEN {0} >= 75 THEN 'high' WHEN {0} >= 50 THEN 'medium' ELSE 'low' END".format(f"least(100.0, {base} + {2.0 * (n - 2)} + greatest({', '.join(f's{i}.asset_criticality' for i in range(n))}))")
MULTI = f"""SELECT 'buy' AS query_id, 'v1' AS query_version, s0.partition_key, {path_sql(3)} AS path, 3::bigint AS event_count, {_band(75.0, 3)} AS severity FROM {chain(CVP, 12 * HOUR)}
UNION ALL SELECT 'errors', 'v1', s0.partition_key, {path_sql(3)}, 3, {_band(90.0, 3)} FROM {chain(["'error'", "'error'", "'purchase'"], DAY, _all_same("session_id"))}
UNION ALL SELECT 'join', 'v2', s0.partition_key, {path_sql(2)}, 2, {_band(50.0, 2)} FROM {chain(["'signup'", "'view','click'"], 6 * HOUR, _NOERR)}"""
add("multi_query", _multi, f"WITH {C} {MULTI}")
add("run_stats", lambda s, d: stats(run(events(s, d), REGISTRY)), f"WITH {C}, m AS ({MULTI}) SELECT query_id, query_version, count(*) AS paths_found, max(event_count) AS max_depth FROM m GROUP BY ALL")
_NARROW, _WIDE = (Registry.of([{"query_id": "q", "pattern": "click,view,purchase", "within_ms": w}]) for w in (12 * HOUR, DAY))
DIFF = f"WITH {C}, w AS (SELECT {SHA(3)} AS trend_id, s2.event_time_ms - s0.event_time_ms AS span FROM {chain(CVP, DAY)})"
add("trend_diff_window", lambda s, d: compare(events(s, d), _NARROW, _WIDE), f"{DIFF} SELECT trend_id, CASE WHEN span <= {12 * HOUR} THEN 'common' ELSE 'added' END AS diff FROM w")
add("counterfactual_counts", lambda s, d: compare(events(s, d), _WIDE, _NARROW).groupBy("diff").agg(F.count(F.lit(1)).alias("n")), f"{DIFF} SELECT CASE WHEN span <= {12 * HOUR} THEN 'common' ELSE 'removed' END AS diff, count(*) AS n FROM w GROUP BY 1")

# metrics
add("metrics_by_query", lambda s, d: metrics.trend_metrics(run(events(s, d), REGISTRY)), f"WITH {C}, m AS ({MULTI}) SELECT query_id, 'trends_emitted' AS metric_name, count(*)::double AS metric_value FROM m GROUP BY query_id UNION ALL SELECT '_all', 'trends_emitted', count(*)::double FROM m")


def _batch(spark: SparkSession, d: str) -> DataFrame:
    """What the graph run did by query and key, with the dead letters of the buffer as failed rows of their keys."""
    ran = _statistics(spark, d).select("query_id", "query_version", "partition_key", *(F.coalesce(m, F.lit(0)).alias(m) for m in metrics.METRICS[:4]), "status")
    dead = table(spark, d, "cet_dead_letter_v5").select(F.lit("_all").alias("query_id"), F.lit("v1").alias("query_version"), "partition_key", *(F.lit(0).cast("long").alias(m) for m in metrics.METRICS[:4]), F.lit("err").alias("status"))
    return metrics.batch_metrics(ran.unionByName(dead))


BATCH = f"""{GSTATS}, rs AS (SELECT query_id, query_version, partition_key, coalesce(paths_found, 0) AS paths_found, coalesce(paths_truncated, 0) AS paths_truncated, coalesce(states_truncated, 0) AS states_truncated, coalesce(temporal_rejects, 0) AS temporal_rejects, status FROM gs
 UNION ALL SELECT '_all', 'v1', partition_key, 0, 0, 0, 0, 'err' FROM cet_dead_letter_v5),
b AS (SELECT query_id, query_version, partition_key, sum(paths_found)::bigint AS paths_found, sum(paths_truncated)::bigint AS paths_truncated, sum(states_truncated)::bigint AS states_truncated,
 sum(temporal_rejects)::bigint AS temporal_rejects, count(*) FILTER (WHERE status = 'err') AS error_records, count(*) FILTER (WHERE status = 'ok') AS success_records FROM rs GROUP BY ALL)"""
add("batch_metrics", _batch, f"{BATCH} SELECT * FROM b")
_long = " UNION ALL ".join(f"SELECT query_id, query_version, partition_key, '{m}' AS metric_name, {m}::double AS metric_value FROM b" for m in metrics.METRICS)
add("metrics_unpivot", lambda s, d: metrics.long_metrics(_batch(s, d), ["query_id", "query_version", "partition_key"], list(metrics.METRICS)), f"{BATCH} {_long}")
RATIOS = f"""{BATCH}, ra AS (SELECT 'dead_letter_ratio' AS metric_name, (sum(error_records) / nullif(sum(error_records) + sum(success_records), 0))::double AS metric_value FROM b
 UNION ALL SELECT 'truncation_ratio', (sum(paths_truncated) / greatest(sum(paths_found), 1))::double FROM b UNION ALL SELECT 'temporal_reject_rate', (sum(temporal_rejects) / greatest(sum(paths_found), 1))::double FROM b
 UNION ALL SELECT 'hot_partition_paths', max(paths_found)::double FROM b)"""
add("derived_ratios", lambda s, d: metrics.derived_ratios(_batch(s, d)), f"{RATIOS} SELECT * FROM ra")
RULES = (("dead_letters", "dead_letter_ratio", 0.005, "page"), ("truncated", "truncation_ratio", 0.0, "page"), ("rejects", "temporal_reject_rate", 1e6, "ticket"), ("hot_key", "hot_partition_paths", 3.0, "ticket"))
add(
    "alert_breaches",
    lambda s, d: metrics.alerts(metrics.derived_ratios(_batch(s, d)), RULES),
    f"{RATIOS}, a(alert, metric_name, threshold, severity) AS (VALUES {', '.join(map(str, RULES))}) SELECT alert, severity, metric_name, metric_value FROM ra JOIN a USING (metric_name) WHERE metric_value > threshold",
)
# an hour's events by type as samples of a metric; the busy alert asks for three hours above its threshold
BUSY = [("busy", "click", 1.0, "page", 2 * 3600), ("any", "error", 2.0, "ticket", 0)]


def _samples(spark: SparkSession, d: str) -> DataFrame:
    hour = F.col("event_time_ms") - F.pmod("event_time_ms", F.lit(HOUR))
    return events(spark, d).groupBy(F.col("event_type").alias("metric_name"), hour.alias("at_ms")).agg(F.count(F.lit(1)).cast("double").alias("metric_value"))


add(
    "alerts_sustained",
    lambda s, d: metrics.sustained_alerts(_samples(s, d), BUSY),
    f"""WITH {C}, s AS (SELECT event_type AS metric_name, event_time_ms // {HOUR} * {HOUR} AS at_ms, count(*)::double AS v FROM c GROUP BY ALL), a(alert, metric_name, threshold, severity, seconds) AS (VALUES {', '.join(map(str, BUSY))}),
m AS (SELECT *, v > threshold AS over FROM s JOIN a USING (metric_name)), n AS (SELECT *, sum((NOT over)::int) OVER (PARTITION BY alert ORDER BY at_ms) AS nth FROM m)
SELECT alert, severity, metric_name, min(at_ms) AS since_ms, max(at_ms) AS until_ms FROM n WHERE over GROUP BY alert, severity, metric_name, seconds, nth HAVING max(at_ms) - min(at_ms) >= seconds * 1000""",
)
add(
    "replay_backlog",
    lambda s, d: metrics.replay_backlog(table(s, d, "cet_impacted_windows_v2"), table(s, d, "cet_complete_trends_v2")),
    """SELECT 'replay_backlog' AS metric_name, count(*)::double AS metric_value FROM cet_impacted_windows_v2 w LEFT JOIN (SELECT query_id, query_version, partition_key, max(coalesce(updated_at, created_at)) AS written FROM cet_complete_trends_v2 GROUP BY ALL) t
 ON t.query_id = w.query_id AND t.query_version = w.query_version AND t.partition_key = w.partition_key WHERE w.query_id IS NOT NULL AND w.query_version IS NOT NULL AND w.partition_key IS NOT NULL AND w.created_at IS NOT NULL AND (written IS NULL OR written < w.created_at)""",
)
add("event_quality", lambda s, d: metrics.event_quality(events(s, d)), f"WITH {C} SELECT event_type, count(*) AS event_count, count(DISTINCT partition_key) AS partition_count, min(event_time_ms) AS min_event_time_ms, max(event_time_ms) AS max_event_time_ms FROM c GROUP BY 1")

# replay
LATE = (1_704_067_200_000 + 25 * DAY, 1_704_067_200_000 + 31 * DAY)
IMPACTED = f"""i AS (SELECT query_id, query_version, partition_key, lo - within_ms - 1800000 AS window_start_ms, hi + within_ms + 1800000 AS window_end_ms, lo AS source_min_event_time_ms, hi AS source_max_event_time_ms
 FROM (SELECT partition_key, min(event_time_ms) AS lo, max(event_time_ms) AS hi FROM c WHERE event_time_ms BETWEEN {LATE[0]} AND {LATE[1]} GROUP BY 1) CROSS JOIN cet_query_registry_v4 WHERE enabled)"""
add("impacted_windows", lambda s, d: replay.impacted_windows(replay.changed_between(events(s, d), *LATE), table(s, d, "cet_query_registry_v4")), f"WITH {C}, {IMPACTED} SELECT * FROM i")
add(
    "impacted_by_lateness",
    lambda s, d: replay.impacted_windows(replay.changed_late(events(s, d), LATE[1], 12 * HOUR, 5 * DAY), table(s, d, "cet_query_registry_v4")).groupBy("query_id", "query_version").agg(F.count(F.lit(1)).alias("n_keys"), F.min("window_start_ms").alias("first_ms"), F.max("window_end_ms").alias("last_ms")),
    f"WITH {C}, k AS (SELECT partition_key, min(event_time_ms) AS lo, max(event_time_ms) AS hi FROM c WHERE event_time_ms >= {LATE[1] - 5 * DAY} AND event_time_ms < {LATE[1] - 12 * HOUR} GROUP BY 1) SELECT query_id, query_version, count(*) AS n_keys, min(lo - within_ms - 1800000) AS first_ms, max(hi + within_ms + 1800000) AS last_ms FROM k CROSS JOIN cet_query_registry_v4 WHERE enabled GROUP BY ALL",
)


def _in_windows(spark: SparkSession, d: str) -> DataFrame:
    found = replay.events_in_windows(table(spark, d, "cet_event_buffer_v5"), table(spark, d, "cet_impacted_windows_v2").where("query_id IS NOT NULL AND query_version IS NOT NULL AND partition_key <> ''"))
    return found.groupBy("query_id", "query_version", "partition_key").agg(F.count_distinct("event_id").alias("n_events"), F.min("event_time_ms").alias("first_ms"), F.max("event_time_ms").alias("last_ms"))


add(
    "recompute_scope",
    _in_windows,
    """SELECT w.query_id, w.query_version, b.partition_key, count(DISTINCT b.event_id) AS n_events, min(b.event_time_ms) AS first_ms, max(b.event_time_ms) AS last_ms
FROM cet_event_buffer_v5 b JOIN cet_impacted_windows_v2 w ON b.partition_key = w.partition_key AND b.event_time_ms BETWEEN w.window_start_ms AND w.window_end_ms
WHERE w.query_id IS NOT NULL AND w.query_version IS NOT NULL AND w.partition_key <> '' GROUP BY ALL""",
)


def _current(spark: SparkSession, d: str) -> DataFrame:
    """The trend table, one row per trend: the state written last."""
    t = table(spark, d, "cet_complete_trends_v2").withColumn("written", F.coalesce("updated_at", "created_at"))
    return replay.latest_by(t.select("trend_id", "query_id", "query_version", "partition_key", "path", "trend_start_time_ms", "trend_end_time_ms", "event_count", "state", "written"), ["trend_id"], ["written", "state", "trend_end_time_ms", "event_count"])


CURRENT = """cur AS (SELECT trend_id, query_id, query_version, partition_key, path, trend_start_time_ms, trend_end_time_ms, event_count, state, coalesce(updated_at, created_at) AS written FROM cet_complete_trends_v2
 QUALIFY row_number() OVER (PARTITION BY trend_id ORDER BY coalesce(updated_at, created_at) DESC NULLS LAST, state DESC NULLS LAST, trend_end_time_ms DESC NULLS LAST, event_count DESC NULLS LAST) = 1)"""


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events as a first run saw them, as they are now, and those that changed: in the last days every fourth came late, and every
    seventh of the others had its asset's criticality corrected to 9.5."""
    now = events(spark, d)
    recent = F.col("event_time_ms").between(*LATE)
    late, wrong = recent & (F.col("event_id") % 4 == 0), recent & (F.col("event_id") % 4 != 0) & (F.col("event_id") % 7 == 0)
    fixed = now.withColumn("asset_criticality", F.when(wrong, F.lit(9.5)).otherwise(F.col("asset_criticality")))
    return now.where(~late), fixed, now.where(late | wrong)


_KEPT = ("trend_id", "query_id", "query_version", "partition_key", "path", "trend_start_time_ms", "trend_end_time_ms", "event_count", "risk_score", "severity")


def _replayed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trends of the first run, trends found again in the windows that the changed events impact, and the windows."""
    before, now, changed = _versions(spark, d)
    windows_ = settle(replay.impacted_windows(changed, REGISTRY.table(spark)), "windows")
    current = run(before, REGISTRY).select(*_KEPT, "state")
    found = replay.recompute(now, windows_, REGISTRY).select(*_KEPT, "state")
    return settle(current, "current"), settle(found, "recomputed"), windows_


def _versioned(query: str, source: str, within: int, n: int, types: list[str], base: float, where: str = "true", version: str = "v1") -> str:
    score = f"least(100.0, {base} + {2.0 * (n - 2)} + greatest({', '.join(f's{i}.asset_criticality' for i in range(n))}))::double"
    return f"""SELECT sha256('{query}:{version}:' || s0.partition_key || ':' || {path_sql(n)}) AS trend_id, '{query}' AS query_id, '{version}' AS query_version, s0.partition_key, {path_sql(n)} AS path, s0.event_time_ms AS t0, s{n - 1}.event_time_ms AS t1, {n}::bigint AS event_count, {score} AS risk_score,
 {_band(base, n)} AS severity FROM {chain(types, within, where, source)}"""


def _all_versions(source: str) -> str:
    """The registry's trends over one version of the events, or over the events in each query's windows."""
    at = lambda q: source if source == "c0" else f"{source}_{q}"
    return " UNION ALL ".join(
        [
            _versioned("buy", at("buy"), 12 * HOUR, 3, CVP, 75.0),
            _versioned("errors", at("errors"), DAY, 3, ["'error'", "'error'", "'purchase'"], 90.0, _all_same("session_id")),
            _versioned("join", at("join"), 6 * HOUR, 2, ["'signup'", "'view','click'"], 50.0, _NOERR.replace("FROM c x", f"FROM {at('join')} x"), "v2"),
        ]
    )


_SPANS = {"buy": 12 * HOUR, "errors": DAY, "join": 6 * HOUR}
_RECENT = f"event_time_ms BETWEEN {LATE[0]} AND {LATE[1]}"
REPLAYED = f"""WITH {C}, c0 AS (SELECT * FROM c WHERE NOT ({_RECENT} AND event_id % 4 = 0)), c1 AS (SELECT * REPLACE (CASE WHEN {_RECENT} AND event_id % 4 <> 0 AND event_id % 7 = 0 THEN 9.5 ELSE asset_criticality END AS asset_criticality) FROM c),
k AS (SELECT partition_key, min(event_time_ms) AS lo, max(event_time_ms) AS hi FROM c WHERE {_RECENT} AND (event_id % 4 = 0 OR event_id % 7 = 0) GROUP BY 1),
{", ".join(f"c1_{q} AS (SELECT c1.* FROM c1 JOIN k USING (partition_key) WHERE event_time_ms BETWEEN lo - {2 * w + 1_800_000} AND hi + {2 * w + 1_800_000})" for q, w in _SPANS.items())},
w AS ({" UNION ALL ".join(f"SELECT '{q}' AS query_id, partition_key, lo - {w + 1_800_000} AS ws, hi + {w + 1_800_000} AS we FROM k" for q, w in _SPANS.items())}),
cur AS ({_all_versions("c0")}), rec AS ({_all_versions("c1")}),
st AS (SELECT DISTINCT cur.trend_id FROM cur JOIN w ON w.query_id = cur.query_id AND w.partition_key = cur.partition_key AND cur.t1 >= w.ws AND cur.t0 <= w.we WHERE cur.trend_id NOT IN (SELECT trend_id FROM rec)),
ups AS (SELECT trend_id, query_id, path, risk_score, severity, 'active' AS state FROM rec UNION ALL SELECT trend_id, query_id, path, risk_score, severity, CASE WHEN trend_id IN (SELECT trend_id FROM st) THEN 'retracted' ELSE 'active' END FROM cur WHERE trend_id NOT IN (SELECT trend_id FROM rec))"""


def _stale(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    current, found, windows_ = _replayed(spark, d)
    return current, found, replay.stale_trends(current, windows_, found)


def _upserted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    current, found, stale = _stale(spark, d)
    return replay.upsert(replay.retract(current, stale), found, ["trend_id"]), found


_path = lambda: F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path")
add("recomputed_trends", lambda s, d: _replayed(s, d)[1].select("trend_id", "query_id", "query_version", "partition_key", _path(), "event_count", "risk_score", "severity"), f"{REPLAYED} SELECT trend_id, query_id, query_version, partition_key, path, event_count, risk_score, severity FROM rec")
add("dedupe_latest", lambda s, d: _current(s, d).select("trend_id", "state", "event_count", F.unix_micros("written").alias("written_us")), f"WITH {CURRENT} SELECT trend_id, state, event_count, epoch_us(written) AS written_us FROM cur")
add("retract_stale", lambda s, d: _stale(s, d)[2], f"{REPLAYED} SELECT trend_id FROM st")
add("replay_upsert", lambda s, d: _upserted(s, d)[0].select("trend_id", "query_id", "state", "risk_score", "severity", _path()), f"{REPLAYED} SELECT trend_id, query_id, state, risk_score, severity, path FROM ups")
add("replay_validation", lambda s, d: replay.validation_counts(*_upserted(s, d)), f"{REPLAYED} SELECT 'recomputed_count' AS check_name, count(*) AS value FROM rec UNION ALL SELECT 'retracted_count', count(*) FROM ups WHERE state = 'retracted' UNION ALL SELECT 'active_after_replay_count', count(*) FROM ups WHERE state = 'active'")


def _diff(spark: SparkSession, d: str) -> DataFrame:
    """Differences between what was found in the impacted windows before and what is found there now."""
    current, found, windows_ = _replayed(spark, d)
    hit = replay.overlapping(current, windows_)
    return replay.replay_diff(hit, found.join(current.join(hit, "trend_id", "left_anti"), "trend_id", "left_anti"), ("path", "risk_score", "severity"))


add(
    "replay_diff",
    _diff,
    f"""{REPLAYED}, hit AS (SELECT DISTINCT cur.* FROM cur JOIN w ON w.query_id = cur.query_id AND w.partition_key = cur.partition_key AND cur.t1 >= w.ws AND cur.t0 <= w.we),
rin AS (SELECT * FROM rec WHERE trend_id NOT IN (SELECT trend_id FROM cur) OR trend_id IN (SELECT trend_id FROM hit))
SELECT trend_id, 'stale_retract' AS diff_type FROM hit WHERE trend_id NOT IN (SELECT trend_id FROM rin) UNION ALL SELECT trend_id, 'new_insert' FROM rin WHERE trend_id NOT IN (SELECT trend_id FROM hit) UNION ALL SELECT rin.trend_id, 'changed_update' FROM rin JOIN hit USING (trend_id) WHERE rin.path IS DISTINCT FROM hit.path OR rin.risk_score IS DISTINCT FROM hit.risk_score OR rin.severity IS DISTINCT FROM hit.severity""",
)
add(
    "insert_absent",
    lambda s, d: (lambda current, found, _: replay.insert_absent(current.select("trend_id", "state"), found.select("trend_id", F.lit("inserted").alias("state")), ["trend_id"]))(*_replayed(s, d)),
    f"{REPLAYED} SELECT trend_id, 'active' AS state FROM cur UNION ALL SELECT trend_id, 'inserted' FROM rec WHERE trend_id NOT IN (SELECT trend_id FROM cur)",
)


def _states(spark: SparkSession, d: str) -> DataFrame:
    """Partial trends after each of two runs: prefixes click, view; the second run saw them an hour later."""
    p = match(events(spark, d), spec("click,view", 6 * HOUR))
    first = p.select(F.lit("q").alias("query_id"), F.lit("v1").alias("query_version"), "partition_key", F.transform("path", lambda e: e["id"]).alias("prefix_path"), F.col("path")[0]["t"].alias("start_time_ms"), F.col("path")[1]["t"].alias("last_event_time_ms"))
    both = first.unionByName(first.where(F.col("prefix_path")[0] % 2 == 0).withColumn("last_event_time_ms", F.col("last_event_time_ms") + HOUR))
    return both.withColumn("expiry_time_ms", F.col("last_event_time_ms") + 6 * HOUR)


STATES = f"""WITH {C}, s AS (SELECT sha256('q:v1:' || s0.partition_key || ':' || {path_sql(2)}) AS state_id, s0.event_id AS e0, s1.event_time_ms AS last_event_time_ms FROM {chain(["'click'", "'view'"], 6 * HOUR)}),
b AS (SELECT state_id, last_event_time_ms, last_event_time_ms + {6 * HOUR} AS expiry_time_ms FROM s UNION ALL SELECT state_id, last_event_time_ms + {HOUR}, last_event_time_ms + {7 * HOUR} FROM s WHERE e0 % 2 = 0)"""
add("state_compact", lambda s, d: replay.compact_states(_states(s, d)).select("state_id", "last_event_time_ms", "expiry_time_ms"), f"{STATES} SELECT state_id, max(last_event_time_ms) AS last_event_time_ms, max(expiry_time_ms) AS expiry_time_ms FROM b GROUP BY 1")
add("state_expire", lambda s, d: replay.expire_states(_states(s, d), LATE[0]).select(replay.state_id().alias("state_id"), "expiry_time_ms"), f"{STATES} SELECT state_id, expiry_time_ms FROM b WHERE expiry_time_ms >= {LATE[0]}")
add(
    "state_ttl",
    lambda s, d: replay.ttl(table(s, d, "cet_complete_trends_v2"), "updated_at", F.lit("2015-01-26 00:00:00").cast("timestamp"), "7 DAYS")[1],
    "SELECT count(*) FILTER (WHERE updated_at < TIMESTAMPTZ '2015-01-19 00:00:00+00') AS dropped FROM cet_complete_trends_v2",
)


def _hits(spark: SparkSession, d: str) -> DataFrame:
    at = match(events(spark, d), spec("click,view,purchase", DAY)).select(F.posexplode("path").alias("seq_idx", "e"))
    return replay.cache_hits(at.select(F.col("e.id").alias("key_vertex"), F.col("seq_idx").cast("long").alias("seq_idx")))


add("partial_cache_hits", _hits, f"WITH {C}, p AS (SELECT s0.event_id AS a, s1.event_id AS b, s2.event_id AS z FROM {chain(CVP, DAY)}) SELECT key_vertex, seq_idx, count(*) AS hits FROM (SELECT a AS key_vertex, 0::bigint AS seq_idx FROM p UNION ALL SELECT b, 1 FROM p UNION ALL SELECT z, 2 FROM p) GROUP BY ALL")

# windows and plans
add("sliding_windows", lambda s, d: windows.sliding_windows(s, 0, 1_000_000, 6_000, 700), "SELECT i AS idx, i * 700 AS window_start, i * 700 + 6000 AS window_end FROM range(0, 1421) t(i) WHERE i * 700 + 6000 <= 1000000")
add(
    "window_assign",
    lambda s, d: windows.assign_windows(events(s, d), 6 * HOUR, 2 * HOUR).groupBy("window_start").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("partition_key").alias("n_keys")),
    f"WITH {C}, s AS (SELECT DISTINCT (event_time_ms // {2 * HOUR} - o) * {2 * HOUR} AS window_start FROM c CROSS JOIN range(0, 4) r(o)) SELECT window_start, count(*) AS n, count(DISTINCT partition_key) AS n_keys FROM s JOIN c ON event_time_ms BETWEEN window_start AND window_start + {6 * HOUR} GROUP BY 1",
)
G = "g AS (SELECT i AS idx, i * 10 AS window_start, i * 10 + 20 + (i * 37) % 50 AS window_end FROM range(0, 40) t(i)), k AS (SELECT *, (window_end - window_start) // 10 + 1 AS vertices, (window_end - window_start) // 8 + 1 AS edges FROM g), q AS (SELECT *, vertices * 0.7::double + edges * 0.3::double AS memory_cost, edges * 0.8::double + vertices * 0.2::double AS cpu_cost FROM k)"


def _graphlets(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    return windows.graphlets(spark.range(40).select(i.alias("idx"), (i * 10).alias("window_start"), (i * 10 + 20 + (i * 37) % 50).alias("window_end")))


add("graphlet_costs", _graphlets, f"WITH {G} SELECT * FROM q")
add(
    "graphlet_delta",
    lambda s, d: windows.graphlet_delta(windows.sliding_windows(s, 0, 1000, 20, 10), windows.sliding_windows(s, 500, 1500, 20, 10)),
    "WITH a AS (SELECT i * 10 AS window_start, i * 10 + 20 AS window_end FROM range(0, 99) t(i)), b AS (SELECT 500 + i * 10 AS window_start, 520 + i * 10 AS window_end FROM range(0, 99) t(i)) SELECT coalesce(a.window_start, b.window_start) AS window_start, coalesce(a.window_end, b.window_end) AS window_end, CASE WHEN a.window_start IS NULL THEN 'new' WHEN b.window_start IS NULL THEN 'expired' ELSE 'shared' END AS delta FROM a FULL JOIN b ON a.window_start = b.window_start AND a.window_end = b.window_end",
)
add(
    "graphlet_greedy",
    lambda s, d: windows.greedy_plan(_graphlets(s, d), 60.0).select("idx"),
    f"""WITH RECURSIVE {G}, o AS (SELECT *, row_number() OVER (ORDER BY cpu_cost + memory_cost, idx) AS n FROM q),
r AS (SELECT 0::bigint AS n, 0.0::double AS used, -1::bigint AS idx UNION ALL SELECT o.n, CASE WHEN r.used + o.memory_cost <= 60 THEN r.used + o.memory_cost ELSE r.used END, CASE WHEN r.used + o.memory_cost <= 60 THEN o.idx ELSE -1 END FROM r JOIN o ON o.n = r.n + 1)
SELECT idx FROM r WHERE idx >= 0""",
)
add("graphlet_min_cpu", lambda s, d: windows.least_cpu_plan(_graphlets(s, d), 60.0).select("idx", "cpu_cost"), f"WITH {G} SELECT idx, cpu_cost FROM q WHERE memory_cost <= 60 ORDER BY cpu_cost, idx DESC LIMIT 1")

def _calibrated(spark: SparkSession, d: str) -> DataFrame:
    g = _graphlets(spark, d)
    return windows.calibrate_costs(g, "cpu_cost").select(F.round("per_vertex", 6).alias("per_vertex"), F.round("per_edge", 6).alias("per_edge"))


add("graphlet_calibration", _calibrated, "SELECT 0.2::double AS per_vertex, 0.8::double AS per_edge")

# registry
add(
    "registry_latest",
    lambda s, d: latest_versions(table(s, d, "cet_query_registry_v4")),
    "SELECT query_id, query_version FROM cet_query_registry_v4 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_transform(regexp_extract_all(query_version, '[0-9]+'), lambda x: x::bigint) DESC) = 1",
)


def _registry(spark: SparkSession, d: str) -> Registry:
    """The registry table with its types spelled as type keys; all else as it stands there."""
    from dataclasses import replace

    def spelled(rules: tuple) -> tuple:
        return tuple(replace(r, event_type=r.event_type and r.event_type.lower()) for r in rules)

    def absences(q: QuerySpec) -> tuple:
        return tuple(replace(a, event_type=a.event_type.lower(), where=spelled(a.where)) for a in q.absence)

    return Registry(tuple(replace(q, pattern=q.pattern.lower(), where=spelled(q.where), absence=absences(q)) for q in Registry.from_table(table(spark, d, "cet_query_registry_v4")).queries))


def _buffer(spark: SparkSession, d: str, registry: Registry) -> DataFrame:
    """The buffer's events of the types that enabled queries name, with the fields of their relations and conditions."""
    from trendloom.operators.buffer_events import canonical_events, type_key

    queries = registry.enabled()
    rules = [r for q in queries for r in (*q.relations, *q.where, *(w for a in q.absence for w in a.where))]
    fields = tuple(dict.fromkeys(r.field for r in rules))
    types = sorted({t for q in queries for t in q.types()})
    rows = table(spark, d, "cet_event_buffer_v5").where(type_key(F.col("event_type")).isin(types))
    return canonical_events(rows, fields=fields).select("event_id", F.col("k").alias("partition_key"), F.col("type_key").alias("event_type"), F.col("t").alias("event_time_ms"), *(F.col(f"`{f}`") for f in fields))


def _registry_trends(spark: SparkSession, d: str) -> DataFrame:
    """All enabled queries of the registry table, relations included, over the buffer's events, types without regard to spelling."""
    registry = _registry(spark, d)
    buffer = settle(_buffer(spark, d, registry), "events")  # seven plans read it
    return run(buffer, registry).groupBy("query_id", "query_version").agg(F.count(F.lit(1)).alias("n_trends"), F.count_distinct("partition_key").alias("n_keys"), F.max("event_count").alias("longest"))


# the enabled queries of the registry table, which is fixed: id, version, types (the first repeats where it ends in +), window, field that must be the same
REGISTERED = (
    ("vault_drain", "v4.1.0", ("badgefail+", "vaultopen", "vaultexport"), 1_800_000, False),
    ("cert_swap", "v4.0.2", ("certrevoke", "certgrant", "tunnelopen"), 900_000, False),
    ("ledger_replay", "v4.0.0", ("ledgerwrite+", "ledgersync", "ledgerreset"), 7_200_000, True),
    ("mail_rules", "v4.0.1", ("mailboxwrite", "policywrite", "mailboxexport"), 2_700_000, False),
    ("kernel_beacon", "v4.2.0", ("kernelwrite", "shellopen", "beaconsync", "tunnelwrite"), 1_800_000, True),
    ("quota_probe", "v4.0.0", ("quotaread+", "probescan", "quotareset"), 600_000, False),
    ("schema_leak", "v4.0.3", ("schemaread", "replicaopen", "replicaexport"), 3_600_000, True),
)


def _registered(i: int) -> str:
    """Paths (partition_key, n) of a registered query, one state for each step, as a recursive query."""
    _, _, types, within, same = REGISTERED[i]
    names = [t.rstrip("+") for t in types]
    again = f"(r.state = 1 AND b.event_type = '{names[0]}')" if types[0].endswith("+") else "false"
    on = " OR ".join(f"(r.state = {k} AND b.event_type = '{t}')" for k, t in enumerate(names) if k)
    host = " AND (r.host IS NULL OR b.host_id IS NULL OR r.host = b.host_id)" if same else ""
    return f"""q{i} AS (SELECT partition_key, event_id, event_time_ms, event_time_ms AS t0, host_id AS host, 1 AS n, 1 AS state FROM c WHERE event_type = '{names[0]}'
  UNION ALL SELECT b.partition_key, b.event_id, b.event_time_ms, r.t0, coalesce(r.host, b.host_id), r.n + 1, CASE WHEN {again} THEN 1 ELSE r.state + 1 END FROM q{i} r JOIN c b ON {later("r", "b")} AND b.event_time_ms - r.t0 <= {within} AND ({again} OR {on}){host})"""


add(
    "registry_trends",
    _registry_trends,
    f"""WITH RECURSIVE b AS (SELECT event_id, partition_key, event_time_ms, lower(regexp_replace(event_type, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS event_type, ingested_at, batch_id,
  CASE WHEN json_valid(payload) THEN nullif(coalesce(json_extract_string(payload, '$.host_id'), json_extract_string(payload, '$.attributes.host_id')), '') END AS host
  FROM cet_event_buffer_v5 WHERE event_id IS NOT NULL AND partition_key <> '' AND event_type <> '' AND event_time_ms > 0),
c AS (SELECT event_id, partition_key, event_time_ms, event_type, last(host ORDER BY ingested_at NULLS FIRST, batch_id NULLS FIRST, host) FILTER (WHERE host IS NOT NULL) AS host_id FROM b GROUP BY ALL HAVING event_type IN ({", ".join(sorted({repr(t.rstrip("+")) for q in REGISTERED for t in q[2]}))})),
{", ".join(map(_registered, range(len(REGISTERED))))}
{" UNION ALL ".join(f"SELECT '{q[0]}' AS query_id, '{q[1]}' AS query_version, count(*) AS n_trends, count(DISTINCT partition_key) AS n_keys, max(n)::bigint AS longest FROM q{i} WHERE state = {len(q[2])} HAVING count(*) > 0" for i, q in enumerate(REGISTERED))}""",
)


def _standing(spark: SparkSession, d: str) -> DataFrame:
    from trendloom.streaming.replay_files import stream_in_files

    return stream_in_files(events(spark, d), spec("click,view,purchase", DAY), 3)


add("standing_replay_active", _standing, f"WITH {C} SELECT {SHA(3)} AS trend_id, s0.partition_key, {path_sql(3)} AS path FROM {chain(CVP, DAY)}")
