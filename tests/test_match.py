import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trendloom.engine import Options, find, find_texts, run, statistics
from trendloom.functions.predicates import Predicate
from trendloom.plans import graph_local
from trendloom.plans.local import local_absent, local_holds, local_paths, local_walk_ways, local_walks
from trendloom.plans.graph_match import graph_statistics
from trendloom.plans.match import match, match_paths
from trendloom.plans.pattern import parse_pattern
from trendloom.plans.spec import Absence, QuerySpec, Registry, Relation
from trendloom.plans.walk import match_walks, walk_steps


def ids(df):
    return sorted(tuple(e["id"] for e in r["path"]) for r in df.collect())


def q(pattern, within=100, **more):
    return QuerySpec.of({"query_id": "q", "pattern": pattern, "within_ms": within, **more})


CASES = [
    ("1A@1 2B@2 3C@3", "A,B,C", 60_000, [(1, 2, 3)]),
    ("1A@1 2B@100", "A,B", 1, []),
    ("1A 2X 3B 4C", "A,B,C", 100, [(1, 3, 4)]),
    ("1A@100 2B@50", "A,B", 100, []),
    ("1A 2X 3A 4B 5C", "A+,B,C", 100, [(1, 3, 4, 5), (1, 4, 5), (3, 4, 5)]),
    ("1A 2A 3B", "A?,B", 100, [(1, 3), (2, 3), (3,)]),
    ("1A@5 2B@5", "A,B", 0, [(1, 2)]),
    ("1B@5 2A@5", "A,B", 0, []),
    ("1A 2A 3A", "A{2}", 100, [(1, 2), (1, 3), (2, 3)]),
    ("1A 2B", "A?,B?", 100, [(1,), (1, 2), (2,)]),
]


@pytest.mark.parametrize(("text", "pattern", "within", "expected"), CASES)
def test_fixtures(chain, text, pattern, within, expected):
    events = chain(text)
    for plan in ("auto", "fold"):
        assert ids(match_paths(events, q(pattern, within), plan=plan)) == expected


PATTERNS = ["A,B,C", "A+,B", "A,B?,C", "(A|B){1,2},C", "A?,A?,B", "A,B+,C", "A{2,},B", "A{0,2},(B|C)+", "B{0},C"]


def test_random_streams_join_fold_and_brute_force(spark):
    """Many random keys in one table: joins, folds and brute force agree, ties and repeats of times included."""
    rng = random.Random(7)
    rows, by_key = [], {}
    for key in range(40):
        for i in range(rng.randint(0, 9)):
            e = {"event_id": key * 100 + i, "partition_key": str(key), "event_type": rng.choice("ABCX"), "event_time_ms": rng.randint(-5, 25)}
            rows.append(tuple(e.values()))
            by_key.setdefault(str(key), []).append(e)
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "event_id bigint, partition_key string, event_type string, event_time_ms bigint").cache()
    for pattern in PATTERNS:
        steps = parse_pattern(pattern)
        expected = sorted(tuple(e["event_id"] for e in p) for es in by_key.values() for p in local_paths(steps, es, 12))
        assert ids(match_paths(events, q(pattern, 12), plan="fold")) == expected, pattern
        assert ids(match_paths(events, q(pattern, 12))) == expected, pattern
    for pattern in ("A,B,C", "A,B+,C", "A+,B", "A,A"):
        steps = walk_steps(q(pattern))
        expected = sorted(w for es in by_key.values() for w in local_walks(steps, es, 12))
        assert ids(match_walks(events, q(pattern, 12))) == expected, pattern


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ABC"), st.integers(0, 20)), max_size=7), st.sampled_from(PATTERNS))
def test_brute_force_does_not_depend_on_arrival(items, pattern):
    es = [{"event_id": i, "partition_key": "p", "event_type": y, "event_time_ms": t} for i, (y, t) in enumerate(items)]
    found = local_paths(parse_pattern(pattern), es, 10)
    assert found == local_paths(parse_pattern(pattern), es[::-1], 10)
    assert len({tuple(e["event_id"] for e in p) for p in found}) == len(found)
    assert all(p[-1]["event_time_ms"] - p[0]["event_time_ms"] <= 10 for p in found)


def test_absence_and_relations(spark, chain):
    events = chain("1A@1 2D@2 3B@3")
    assert ids(match(events, q("A,B", absence=[{"event_type": "D"}]))) == []
    assert ids(match(events, q("A,B", absence=[{"event_type": "E"}]))) == [(1, 3)]
    rows = [(1, "p", "A", 1, "u1"), (2, "p", "B", 2, "u2"), (3, "p", "B", 3, "u1"), (4, "p", "B", 4, None)]
    e = spark.createDataFrame(rows, "event_id bigint, partition_key string, event_type string, event_time_ms bigint, user_id string")
    assert ids(match(e, q("A,B", relations=[{"field": "user_id"}]))) == [(1, 3), (1, 4)]
    assert ids(match(e, q("A,B", relations=[{"field": "user_id", "op": "different"}]))) == [(1, 2), (1, 4)]
    assert ids(match(e, q("A,B", relations=[{"field": "user_id", "op": "different", "steps": [1, 7]}]))) == [(1, 2), (1, 3), (1, 4)]
    assert ids(match(e, q("A,B", relations=[{"field": "no_such"}]))) == [(1, 2), (1, 3), (1, 4)]


def test_local_conditions():
    path = [{"event_id": 1, "event_type": "A", "event_time_ms": 1, "f": "x"}, {"event_id": 3, "event_type": "B", "event_time_ms": 9}]
    held = [*path, {"event_id": 2, "event_type": "D", "event_time_ms": 5}]
    assert not local_absent(Absence("D"), path, held)
    assert local_absent(Absence("D", within_ms=3), path, held)
    assert local_holds(Relation("f"), path) and local_holds(Relation("f", "different"), path)
    with pytest.raises(ValueError):
        Relation("f", "other")


def test_nulls_empty_and_extra_columns(spark):
    schema = "event_id bigint, partition_key string, event_type string, event_time_ms bigint, anchor bigint, path string, e0 string, t string"
    rows = [(1, "p", "A", 1, 0, "", "", ""), (2, "p", "B", 2, None, None, None, None), (None, "p", "B", 3, 0, "", "", ""), (3, None, "B", 3, 0, "", "", ""), (4, "p", None, 3, 0, "", "", ""), (5, "p", "B", None, 0, "", "", "")]
    for plan in ("auto", "fold"):
        assert ids(match_paths(spark.createDataFrame(rows, schema), q("A,B"), plan=plan)) == [(1, 2)]
        assert ids(match_paths(spark.createDataFrame([], schema), q("A,B"), plan=plan)) == []
    assert ids(match_walks(spark.createDataFrame(rows, schema), q("A,B"))) == [(1, 2)]


def test_walks(chain):
    assert ids(match_walks(chain("1A 2X 3B 4C"), q("A,B,C"))) == [(1, 2, 3, 4)]
    assert ids(match_walks(chain("1A 2X 3A 4B 5C"), q("A+,B,C"))) == [(1, 2, 3, 4, 5), (3, 4, 5)]
    assert ids(match_walks(chain("1A 2X 3A 4B 5C 6A 7B 8C"), q("A+,B,C"))) == [(1, 2, 3, 4, 5), (3, 4, 5), (6, 7, 8)]
    assert ids(match_walks(chain("1A 2B 3B 4C"), q("A,B+,C"))) == [(1, 2, 3, 4)]
    assert ids(match_walks(chain("1A@10 2B@20"), q("A,B"), edge_window=(100, 200))) == []
    with pytest.raises(ValueError):
        match_walks(chain("1A"), q("(A|B),C"))
    # an absent event that lies on the walk still counts
    assert ids(find(chain("1A 2D 3B"), q("A,B", absence=[{"event_type": "D"}]), Options(mode="walk"))) == []


def test_graph_walks_once_over_parallel_edges(spark):
    rows = [(1, "p", "A", 1, "u", "h"), (2, "p", "B", 2, "u", "h"), (3, "p", "C", 3, "u", "h")]
    e = spark.createDataFrame(rows, "event_id bigint, partition_key string, event_type string, event_time_ms bigint, user_id string, host_id string")
    assert ids(find(e, q("A,B,C"), Options(mode="graph"))) == [(1, 2, 3)]
    assert ids(find(e, q("A,C"), Options(mode="graph"))) == [(1, 3)]
    with pytest.raises(ValueError):
        find(e, q("A"), Options(mode="no"))


OPS = [
    ("exists", None, "u", True), ("exists", None, None, False), ("absent", None, None, True), ("eq", "u", "u", True), ("==", None, None, True), ("eq", "u", None, False),
    ("ne", "u", None, True), ("!=", "u", "u", False), ("in", ["u"], "u", True), ("in", ["u"], None, False), ("in", None, "u", False), ("in", [None], None, True),
    ("not_in", ["u"], None, True), ("not_in", ["u"], "u", False), ("contains", "b", "abc", True), ("contains", "b", None, False), ("regex", "^a.c$", "abc", True), ("regex", "x", None, False),
    (">", 5, "6", True), ("gte", "5", "5", True), ("<", 5, "x", False), ("lte", 5, None, False), ("gt", "x", "6", False),
]


def test_predicates(spark):
    df = spark.createDataFrame([(i, "A", v) for i, (_, _, v, _) in enumerate(OPS)], "i int, event_type string, f string")
    for i, (op, value, _, expected) in enumerate(OPS):
        got = df.where(F.col("i") == i).select(Predicate("f", op, value).column(df).alias("x")).first()["x"]
        assert got is expected, (op, value)
    typed = df.select(Predicate("f", "eq", "none", "B").column(df).alias("x")).distinct().collect()
    assert [r["x"] for r in typed] == [True]
    with pytest.raises(ValueError):
        Predicate("f", "like", 1)


def test_predicate_fields_in_bags(spark):
    df = spark.sql("SELECT 'A' AS event_type, map('a', 'x') AS attributes UNION ALL SELECT 'A', NULL")
    assert df.where(Predicate("a", "eq", "x").column(df)).count() == 1
    df = spark.sql("""SELECT 'A' AS event_type, '{"a": {"b": "7"}}' AS payload UNION ALL SELECT 'A', '{"a' UNION ALL SELECT 'A', ''""")
    assert df.where(Predicate("a.b", "gt", 6).column(df)).count() == 1
    df = spark.sql("SELECT 'A' AS event_type, named_struct('a', named_struct('b', 7)) AS attributes")
    assert df.where(Predicate("a.b", "eq", 7).column(df)).count() == 1
    assert df.where(Predicate("a.c", "exists").column(df)).count() == 0


def test_run_scores(spark):
    rows = [(1, "p", "AuthFail", 1, "u1", 5.0), (2, "p", "PrivEsc", 2, "u1", None), (3, "p", "DataAccess", 3, "u1", None)]
    e = spark.createDataFrame(rows, "event_id bigint, partition_key string, event_type string, event_time_ms bigint, user_id string, asset_criticality double")
    r = Registry.of([{"id": "x", "pattern": "AuthFail,PrivEsc,DataAccess", "within_ms": 60_000, "severity": "high", "relations": [{"field": "user_id"}]}])
    (t,) = run(e, r).collect()
    assert (t["risk_score"], t["severity"], t["event_count"], t["path"]) == (82.0, "high", 3, [1, 2, 3])
    r = Registry.of([{"id": "x", "pattern": "AuthFail", "within_ms": 1, "severity": "critical", "score": {"boost": 50}}])
    assert run(e, r).first()["risk_score"] == 100.0


def test_graph_walks_of_any_length(spark, chain):
    events = chain(" ".join(f"{i}A" for i in range(1, 20)) + " 20B").selectExpr("*", "'u' AS user_id", "'h' AS host_id")
    q = QuerySpec.of({"id": "q", "pattern": "A,B", "within_ms": 1000})
    got = {len(r["path"]) for r in find(events, q, Options(mode="graph")).collect()}
    assert got == set(range(2, 21))


def attributed(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, partition_key string, event_type string, event_time_ms bigint, user_id string")


def test_every_way_of_matching_counts(spark):
    e = attributed(spark, [(1, "p", "A", 1, "u"), (2, "p", "B", 2, "u"), (3, "p", "B", 3, "x"), (4, "p", "C", 4, "u")])
    same = {"relations": [{"field": "user_id", "op": "same"}]}
    for mode in ("walk", "graph"):
        o = Options(mode=mode, entity_keys=())
        for pattern in ("A,B+,C", "A,B,C"):
            assert ids(find(e, q(pattern, **same), o)) == [(1, 2, 3, 4)], (mode, pattern)
        # events of an absent type that take a step are not absent
        assert ids(find(e, q("A,B+,C", absence=[{"event_type": "B"}]), o)) == [(1, 2, 3, 4)]
        assert ids(find(e, q("A,B,C", absence=[{"event_type": "B"}]), o)) == []


def test_ways_against_brute_force(spark):
    rng = random.Random(3)
    for pattern in ("A,B+,C", "A,B,C", "A+,B"):
        data = [(i, rng.choice("pq"), rng.choice("ABCX"), rng.randint(1, 40), rng.choice("uvw")) for i in range(60)]
        e = attributed(spark, data)
        users = {r[0]: r[4] for r in data}
        expected = set()
        for k in "pq":
            line = [{"event_id": r[0], "event_type": r[2], "event_time_ms": r[3]} for r in data if r[1] == k]
            expected |= {path for path, took in local_walk_ways(walk_steps(q(pattern, 12)), line, 12) if len({users[i] for i in took}) == 1}
        found = ids(find(e, q(pattern, 12, relations=[{"field": "user_id", "op": "same"}]), Options(mode="walk")))
        assert found == sorted(expected), pattern


def test_graph_statistics(spark):
    e = attributed(spark, [(i, "p", "A" if i < 6 else "C", i, "u") for i in range(1, 7)])
    edges = spark.createDataFrame([*((i, i + 1, 0, 0) for i in range(1, 6)), (2, 1, 0, 0), (3, 99, 0, 0), (3, 5, 50, 60), (4, 6, 0, 100)], "src bigint, dst bigint, window_start_ms bigint, window_end_ms bigint")
    s = graph_statistics(e, edges, q("A,C", 10)).first().asDict()
    assert (s["seed_paths"], s["paths_found"], s["max_depth"], s["paths_truncated"], s["temporal_rejects"], s["edge_window_rejects"], s["overflow"]) == (5, 9, 6, 0, 4, 3, 0)
    assert graph_statistics(e, edges, q("A,C", 3)).first()["temporal_rejects"] == 9
    cut = graph_statistics(e, edges, q("A,C", 10), max_length=3).first()
    assert (cut["paths_found"], cut["paths_truncated"], cut["overflow"]) == (4, 3, 1)
    bad = statistics(e, Registry.of([{"id": "ok", "pattern": "A,C", "within_ms": 10, "where": [{"field": "user_id", "op": "eq", "value": "u", "event_type": "C"}]}, {"id": "bad", "pattern": "(A|B),C", "within_ms": 1}]), edges=edges)
    assert {r["query_id"]: (r["status"], r["paths_found"], r["predicate_rejects"]) for r in bad.collect()} == {"ok": ("ok", 9, 0), "bad": ("err", None, None)}


def _tangled(spark):
    """Events of several keys, many at one time, so that walks may turn back; one of another type, one without a key."""
    rng = random.Random(7)
    rows = [(i, rng.choice("pqr"), rng.choice("AABBCX"), rng.randint(1, 30) // 2, rng.choice("uvw"), rng.choice("hg")) for i in range(1, 45)]
    return spark.createDataFrame([*rows, (99, None, "A", 5, "u", "h")], "event_id bigint, partition_key string, event_type string, event_time_ms bigint, user_id string, host_id string")


def _texts(found):
    return sorted(map(tuple, found.collect()))


def _level_by_level(monkeypatch, e, spec, o):
    with monkeypatch.context() as m:
        m.setattr(graph_local, "HELD", 0)
        return _texts(find_texts(e, spec, o))


def _each_plan(spark, monkeypatch, pattern, cells, **more):
    e, o = _tangled(spark), Options(mode="graph", entity_keys=("user_id", "host_id"))
    expected = _level_by_level(monkeypatch, e, q(pattern, 6, **more), o)
    monkeypatch.setattr(graph_local, "CELLS", cells)
    found = find_texts(e, q(pattern, 6, **more), o)
    assert _texts(found) == expected and expected
    assert sorted(",".join(str(x["id"]) for x in r["path"]) for r in find(e, q(pattern, 6, **more), o).collect()) == sorted(t for _, t in expected)
    return found


@pytest.mark.parametrize("pattern", ["A,B", "A,B+,C", "A"])
def test_graph_walks_by_block_as_level_by_level(spark, monkeypatch, pattern):
    _each_plan(spark, monkeypatch, pattern, 7)


def test_graph_walks_do_not_move(spark):
    plan = find_texts(_tangled(spark), q("A,B", 6), Options(mode="graph"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("MapInArrow"), plan[:200]


@pytest.mark.parametrize("pattern", ["A,B", "A,B+,C"])
def test_graph_absence_by_block_as_level_by_level(spark, monkeypatch, pattern):
    absent = [{"event_type": "B", "within_ms": 3}, {"event_type": "X", "where": [{"field": "user_id", "op": "ne", "value": "w"}]}]
    found = _each_plan(spark, monkeypatch, pattern, 50, absence=absent)
    # with one way of matching a walk, walks are not joined with the absent events
    assert pattern != "A,B" or "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_graph_relations_by_block_as_level_by_level(spark, monkeypatch):
    found = _each_plan(spark, monkeypatch, "A,B", 50, relations=[{"field": "user_id"}])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # walks are neither joined nor made distinct once they are found
    assert not {"Join", "Aggregate"} & set(plan[: plan.index("MapInArrow")].replace("(", " ").split())
