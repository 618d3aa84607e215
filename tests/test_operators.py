import json

import pytest
from pyspark.sql import functions as F

from trendloom.functions.canonical import checked, from_ecs, from_ocsf, rejects, sound
from trendloom.operators import graph, knowledge, metrics, replay, windows
from trendloom.sources.readers import SourceConfig, batches, http_messages, http_poll, in_memory, json_lines, json_lines_stream
from trendloom.sources.writers import to_http, to_json_lines
from trendloom.store import Snapshots

EVENT = "event_id bigint, partition_key string, event_type string, event_time_ms bigint, user_id string, host_id string"


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_edges(spark):
    e = spark.createDataFrame([(1, "p", "A", 1, "u", "h"), (2, "p", "B", 2, "u", "h"), (3, "p", "C", 3, "u", "h")], EVENT)
    found = rows(graph.event_graph(e), "src", "dst", "relation")
    assert found == sorted((a, b, r) for a, b in ((1, 2), (2, 3)) for r in ("temporal_next", "same_user", "same_host"))
    assert graph.event_graph(e, max_gap_ms=0).count() == 0
    assert graph.event_graph(e.limit(0)).count() == 0


def test_entity_edges_skip_null_and_empty(spark):
    e = spark.createDataFrame([(1, "p", "A", 1, None, ""), (2, "q", "B", 1, "u", ""), (3, "r", "C", 1, "u", None)], EVENT)
    assert rows(graph.entity_edges(e), "src", "dst", "relation") == [(2, 3, "same_user")]


def test_parent_edges_take_the_latest_at_or_before(spark):
    schema = "event_id bigint, partition_key string, event_type string, event_time_ms bigint, process_id bigint, parent_process_id bigint"
    e = spark.createDataFrame([(1, "p", "A", 1, 7, None), (2, "p", "A", 5, 7, None), (3, "p", "A", 5, 9, 7), (4, "p", "A", 6, 7, None), (5, "p", "A", 0, 9, 7), (6, "p", "A", 9, 8, 8)], schema)
    assert rows(graph.parent_edges(e), "src", "dst") == [(2, 3)]


def test_knowledge_graph(spark):
    e = spark.createDataFrame([(1, "p", "A", 1, "u1", "h1"), (2, "p", "B", 2, "u1", "h1")], EVENT)
    assert rows(knowledge.kg_entities(e), "entity_type", "first_seen_ms", "last_seen_ms") == [("host", 1, 2), ("user", 1, 2)]
    assert rows(knowledge.kg_relations(e), "relation_type", "event_id") == [("co_observed:user:host", 1), ("co_observed:user:host", 2)]
    t = spark.createDataFrame([("t", "q", [1, 2, 99], "high", 80.0)], "trend_id string, query_id string, path array<bigint>, severity string, risk_score double")
    assert knowledge.trend_evidence(t).count() == 3
    (x,) = knowledge.investigations(t, e, {"q": ["T1078"]}, {"checks": ("a",), "serious_checks": ("b",), "questions": ("c",)}).collect()
    assert [s["event_id"] for s in x["timeline"]] == [99, 1, 2] and x["techniques"] == ["T1078"] and x["checks"] == ["a", "b"] and x["actions"] == []
    assert x["questions"] == ["What else did user_id u1 do around this time?", "What else did host_id h1 do around this time?", "c"]
    (y,) = knowledge.investigations(t.withColumn("severity", F.lit("low")), e.withColumn("host_id", F.col("event_type")), texts={"checks": ("a",), "serious_checks": ("b",)}).collect()
    assert y["techniques"] == [] and y["checks"] == ["a"] and y["questions"][1] == "Why does host_id change along the path?"


def test_states(spark):
    schema = "query_id string, query_version string, partition_key string, prefix_path array<bigint>, last_event_time_ms bigint, expiry_time_ms bigint"
    s = spark.createDataFrame([("q", "v", "p", [1, 2], 2, 10), ("q", "v", "p", [1, 2], 3, 12), ("q", "v", "p", [9], 1, 9)], schema)
    c = replay.compact_states(s)
    assert rows(c, "last_event_time_ms", "expiry_time_ms") == [(1, 9), (3, 12)]
    assert replay.expire_states(c, 10).count() == 1


def test_diff_upsert_retract(spark):
    a = spark.createDataFrame([("a", "active", 1), ("b", "active", 2)], "trend_id string, state string, n bigint")
    b = spark.createDataFrame([("a", 5), ("c", 7)], "trend_id string, n bigint")
    assert rows(replay.diff_trends(a, b)) == [("a", "common"), ("b", "removed"), ("c", "added")]
    got = {r["trend_id"]: (r["state"], r["n"]) for r in replay.upsert(a, b, ["trend_id"], keep=["n"]).collect()}
    assert got == {"a": ("active", 1), "b": ("active", 2), "c": (None, 7)}
    got = {r["trend_id"]: r["state"] for r in replay.retract(a, a.where("trend_id = 'b'")).collect()}
    assert got == {"a": "active", "b": "retracted"}
    nulls = spark.createDataFrame([(None, "x", 1)], a.schema)
    assert replay.upsert(nulls, nulls.withColumn("n", F.lit(2).cast("long")), ["trend_id"]).collect()[0]["n"] == 2


def test_snapshots(spark, tmp_path):
    t = Snapshots(spark, str(tmp_path / "t"))
    assert not t.exists()
    with pytest.raises(FileNotFoundError):
        t.read()
    make = lambda xs: spark.createDataFrame(xs, "k string, v bigint")
    t.upsert(make([("a", 1), ("b", 2)]), ["k"])
    t.upsert(make([("b", 3), ("c", 4)]), ["k"])
    assert rows(t.read()) == [("a", 1), ("b", 3), ("c", 4)]
    assert rows(t.read(1)) == [("a", 1), ("b", 2)]
    t.insert(make([("a", 9), ("d", 5)]), ["k"])
    t.delete(F.col("v") > 4)
    t.overwrite(make([("z", 0)]), F.col("k") == "a")
    assert rows(t.read()) == [("b", 3), ("c", 4), ("z", 0)]
    assert t.version() == 5


def test_windows(spark):
    w = windows.sliding_windows(spark, 0, 100, 20, 10)
    assert rows(w)[0] == (0, 0, 20) and rows(w)[-1] == (8, 80, 100) and w.count() == 9
    assert windows.sliding_windows(spark, 0, 10, 20, 10).count() == 0
    delta = windows.graphlet_delta(windows.sliding_windows(spark, 0, 90, 20, 10), windows.sliding_windows(spark, 10, 100, 20, 10))
    assert dict(delta.groupBy("delta").count().collect()) == {"shared": 7, "new": 1, "expired": 1}
    g = windows.graphlets(windows.sliding_windows(spark, 10, 100, 20, 10))
    assert windows.greedy_plan(g, 1000).agg(F.count("*"), F.round(F.sum("memory_cost"), 6), F.round(F.sum("cpu_cost"), 6)).first()[:] == (8, 24.0, 24.0)
    assert windows.least_cpu_plan(g, 1000).first()["idx"] == 7
    assert windows.least_cpu_plan(g, 0).count() == 0
    e = spark.createDataFrame([(20,), (-1,)], "event_time_ms bigint")
    assert rows(windows.assign_windows(e, 20, 10)) == [(-1, -20), (-1, -10), (20, 0), (20, 10), (20, 20)]


def test_adapters(spark):
    make = lambda d: spark.createDataFrame([(json.dumps(d),)], "raw_json string")
    r = from_ecs(make({"event": {"id": "5", "action": "AuthFail"}, "user": {"name": "u"}, "@timestamp": "2024-01-01T00:00:00Z"})).first()
    assert (r["event_id"], r["partition_key"], r["event_type"], r["event_time_ms"], r["attributes"]) == (5, "u", "AuthFail", 1704067200000, {"user_id": "u"})
    r = from_ocsf(make({"uid": 7, "class_name": "PrivEsc", "time": 9, "device": {"hostname": "h"}})).first()
    assert (r["event_id"], r["partition_key"], r["event_type"], r["event_time_ms"]) == (7, "h", "PrivEsc", 9)
    r = from_ecs(make({})).first()
    assert (r["partition_key"], r["event_type"], r["event_time_ms"]) == ("default", "Unknown", 0)


def test_sources(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"event_id": 1, "type": "AuthFail", "timestamp_ms": 10, "user_id": "u1"}\n\n{"id": "x", "message": 1}\n')
    got = {r["event_type"]: r for r in json_lines(spark, SourceConfig("bus", str(tmp_path / "in.jsonl")), now_ms=3).collect()}
    assert (got["AuthFail"]["partition_key"], got["AuthFail"]["source_name"], got["AuthFail"]["event_time_ms"]) == ("u1", "bus", 10)
    assert got["Unknown"]["event_time_ms"] == 3 and got["Unknown"]["event_id"] >= 0
    m = in_memory(spark, [{"id": 2, "type": "PrivEsc", "timestamp_ms": 20, "host_id": "h1", "partition_key": ""}], SourceConfig("m")).first()
    assert (m["event_id"], m["partition_key"]) == (2, "h1")
    at = str(tmp_path / "asked")

    def fetch(url, headers):
        with open(at, "w") as f:
            f.write(url + headers["Authorization"])
        return '[{"id": 1, "type": "A"}, {"id": 2}]'

    df = http_poll(spark, SourceConfig("h", "http://x", token="t", max_messages=1), fetch)
    assert df.count() == 1 and open(at).read() == "http://xBearer t"
    assert http_messages('{\n "a": 1\n}') == ['{"a": 1}'] and http_messages('{"a": 1}\n\n{"b": 2}') == ['{"a": 1}', '{"b": 2}'] and http_messages("") == []
    with pytest.raises(ValueError):
        json_lines_stream(spark, SourceConfig("f", str(tmp_path), max_messages=1))
    assert batches(spark.range(100).withColumnRenamed("id", "event_id"), 10).select("batch").distinct().count() == 10


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t1", [1, 2, 3])], "trend_id string, path array<bigint>")
    to_json_lines(df, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0]) == {"trend_id": "t1", "path": [1, 2, 3]}
    at = str(tmp_path / "posted")

    def post(url, body, headers):
        with open(at, "ab") as f:
            f.write(body)

    to_http(df, "http://x", post)
    with open(at) as f:
        assert json.load(f) == [{"trend_id": "t1", "path": [1, 2, 3]}]


def test_checked(spark):
    schema = "event_id bigint, partition_key string, event_type string, event_time_ms bigint, reason2 string"
    e = spark.createDataFrame([(1, "p", "A", 1, ""), (2, "p", "", 1, ""), (3, "p", "A", 1, ""), (3, "p", "A", 1, ""), (None, "p", "A", 1, ""), (4, None, "A", 1, ""), (5, "p", "A", None, "")], schema)
    assert dict(checked(e).groupBy("reason").count().collect()) == {None: 1, "empty event_type": 1, "duplicate event_id": 2, "missing event_id": 1, "missing partition_key": 1, "missing event_time_ms": 1}
    assert sound(e).count() == 1 and rejects(e).count() == 6


def test_measured_and_required_metrics(spark):
    df, seen = metrics.observed(spark.range(5), rows=F.count(F.lit(1)), highest=F.max("id"))
    assert df.where("id > 2").count() == 2 and seen.get == {"rows": 5, "highest": 4}
    got = {r["metric_name"]: r for r in metrics.required_metrics(spark.createDataFrame([("events_in", 2.0), ("events_in", 3.0), ("other", 1.0)], "metric_name string, metric_value double")).collect()}
    assert len(got) == 15 and got["events_in"]["metric_value"] == 5.0 and not got["dlq_ratio"]["measured"]


def test_alerts_that_last(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("alerts:\n- {name: slow, expr: ms > 10, for: 1m, severity: page}\n- {name: any, expr: ms > 10}\n")
    rules = metrics.load_rules(tmp_path / "r.yaml")
    assert rules == [("slow", "ms", 10.0, "page", 60), ("any", "ms", 10.0, "page", 0)]
    samples = [("ms", t * 1000, v) for t, v in [(0, 11.0), (30, 12.0), (59, 11.0), (70, 1.0), (80, 20.0), (140, 20.0), (150, None), (160, 11.0)]] + [("other", 0, 99.0)]
    got = rows(metrics.sustained_alerts(spark.createDataFrame(samples, "metric_name string, at_ms bigint, metric_value double"), rules), "alert", "since_ms", "until_ms")
    assert got == [("any", 0, 59_000), ("any", 80_000, 140_000), ("any", 160_000, 160_000), ("slow", 80_000, 140_000)]


def test_mutations(spark):
    schema = "seq bigint, op string, event_id bigint, partition_key string, event_type string, event_time_ms bigint"
    log = spark.createDataFrame([(1, "upsert", 1, "p", "A", 1), (2, "upsert", 2, "p", "B", 2), (3, "delete", 1, "p", "A", 1), (4, None, 2, "q", "C", 3)], schema)
    assert rows(graph.mutation_log(log), "partition_key", "revision", "op", "event_id") == [("p", 1, "upsert", 1), ("p", 2, "upsert", 2), ("p", 3, "delete", 1), ("q", 1, "upsert", 2)]
    assert rows(graph.current_events(log), "event_id", "partition_key", "event_type") == [(2, "q", "C")]


def test_calibration(spark):
    g = windows.graphlets(windows.sliding_windows(spark, 0, 400, 20, 10).withColumn("window_end", F.col("window_end") + F.col("idx") * 3), cpu=(0.5, 0.25))
    r = windows.calibrate_costs(g, "cpu_cost").first()
    assert (round(r["per_vertex"], 6), round(r["per_edge"], 6)) == (0.25, 0.5)


def test_pipeline_and_schemas(spark):
    from trendloom.schemas import TABLES, bridge_view, create_tables
    from trendloom.streaming.pipeline import canonical, rejected

    raw = spark.createDataFrame([('{"id": 1, "type": "A", "timestamp_ms": 5}',), ('{"id": 2, "type": "A"}',), ("not json",)], "raw_json string")
    assert canonical(raw, "s").count() == 1 and rejected(raw, "s").count() == 2
    for ddl in TABLES.values():
        assert spark.createDataFrame([], ddl).count() == 0
    try:
        create_tables(spark, "made_here", ("trends", "metrics"))
        spark.sql("INSERT INTO made_here.metrics VALUES ('s', 1, 'q', 'v', 'p', 'm', 2.0)")
        bridge_view(spark, "made_here.bridged", "made_here.metrics")
        assert spark.table("made_here.bridged").first()["metric_value"] == 2.0 and spark.table("made_here.trends").count() == 0
    finally:
        spark.sql("DROP DATABASE IF EXISTS made_here CASCADE")


def test_spread(spark):
    from trendloom.session import spread

    cores = spark.sparkContext.defaultParallelism
    few = spark.range(0, 100, 1, 1)
    assert spread(few).rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, cores + 1)
    assert spread(many) is many
    grouped = few.groupBy("id").count()
    assert spread(grouped) is grouped


def test_next_events_in_blocks(spark):
    import random

    from pyspark.sql import Window

    rng = random.Random(6)
    data = [(i, rng.choice(["hot", "hot", "hot", "a", None]), rng.randint(0, 300)) for i in range(400)]
    df = spark.createDataFrame(data, "event_id bigint, partition_key string, event_time_ms bigint")
    w = Window.partitionBy("partition_key").orderBy("event_time_ms", "event_id")
    expected = rows(df.select("event_id", F.lead("event_id").over(w).alias("n"), F.lead("event_time_ms").over(w).alias("nt")).where("n IS NOT NULL"))
    for block in (1, 7, 10_000):
        assert rows(graph.with_next(df, ["partition_key"], block).where("n IS NOT NULL"), "event_id", "n", "nt") == expected


def test_graph_snapshot_and_costs(spark, tmp_path):
    from trendloom.store import load_graph, save_graph

    e = spark.createDataFrame([(1, "p", "A", 1, "u", "h"), (2, "p", "B", 2, "u", "h")], EVENT)
    save_graph(e, graph.event_graph(e), str(tmp_path / "g"))
    events_, edges = load_graph(spark, str(tmp_path / "g"))
    assert events_.count() == 2 and rows(edges, "relation") == rows(graph.event_graph(e), "relation")
    c = spark.createDataFrame([(1.0, 2.0, 5), (3.0, 4.0, 7), (9.0, 9.0, None)], "per_vertex double, per_edge double, created_at bigint")
    assert rows(windows.latest_costs(c)) == [(3.0, 4.0)] and windows.latest_costs(c.limit(0)).count() == 0


def test_options_from_the_environment(monkeypatch):
    from trendloom.engine import Options

    monkeypatch.setenv("TRENDLOOM_MODE", "graph")
    monkeypatch.setenv("TRENDLOOM_MAX_GAP_MS", "5")
    monkeypatch.setenv("TRENDLOOM_MAX_LENGTH", "x")
    monkeypatch.setenv("TRENDLOOM_ENTITY_KEYS", "user_id, host_id")
    o = Options.from_env()
    assert (o.mode, o.max_gap_ms, o.max_length, o.entity_keys, o.plan) == ("graph", 5, None, ("user_id", "host_id"), "auto")
    monkeypatch.setenv("TRENDLOOM_MODE", "other")
    with pytest.raises(ValueError):
        Options.from_env()
