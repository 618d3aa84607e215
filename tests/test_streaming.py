import json

import pytest
from pyspark.sql import functions as F

from trendloom.engine import run
from trendloom.plans.spec import QuerySpec, Registry
from trendloom.sources.writers import to_memory
from trendloom.streaming.buffered import BufferedRun
from trendloom.streaming.replay_files import stream_in_files
from trendloom.streaming.sessions import first_deliveries, period_counts, session_stream
from trendloom.streaming.standing import StandingOptions, active_set, moves, standing_changes

SCHEMA = "event_id bigint, partition_key string, event_type string, event_time_ms bigint, op string, user_id string"


def feed(spark, tmp_path, batches, schema=SCHEMA):
    for i, b in enumerate(batches):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(x) for x in b))
        import os

        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def event(i, kind, t=None, op="upsert", user="u1", key="p"):
    return {"event_id": i, "partition_key": key, "event_type": kind, "event_time_ms": t or i, "op": op, "user_id": user}


def changes(spark, tmp_path, spec, batches):
    q = to_memory(standing_changes(feed(spark, tmp_path, batches), spec), f"out_{tmp_path.name}".replace("-", "_"))
    q.awaitTermination()
    return spark.table(q.name)


def test_match_then_cancel(spark, tmp_path):
    spec = QuerySpec.of({"id": "q", "pattern": "AuthFail+,PrivEsc,DataAccess", "within_ms": 100})
    out = changes(spark, tmp_path, spec, [[event(1, "AuthFail")], [event(2, "PrivEsc")], [event(3, "DataAccess")], [event(3, "DataAccess", op="delete")]])
    assert [(r["change"], r["path"]) for r in out.orderBy("revision").collect()] == [("match", [1, 2, 3]), ("cancel", [1, 2, 3])]
    assert active_set(out).count() == 0


def test_relations_and_late_absent_event(spark, tmp_path):
    spec = QuerySpec.of({"id": "q", "pattern": "AuthFail,PrivEsc", "within_ms": 100, "relations": [{"field": "user_id"}], "absence": [{"event_type": "Ok"}]})
    out = changes(spark, tmp_path, spec, [[event(1, "AuthFail"), event(2, "PrivEsc", user="u2"), event(4, "PrivEsc")], [event(3, "Ok")]])
    assert sorted((r["change"], tuple(r["path"])) for r in out.collect()) == [("cancel", (1, 4)), ("match", (1, 4))]


def test_stream_gives_what_the_table_gives(spark):
    e = spark.range(300).select(F.col("id").alias("event_id"), (F.col("id") % 7).cast("string").alias("partition_key"), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.hash("id") % 3 + 3).cast("int") % 3 + 1).alias("event_type"), (F.col("id") * 10).alias("event_time_ms"))
    spec = QuerySpec.of({"id": "q", "pattern": "A,B+", "within_ms": 200})
    got = {r["trend_id"] for r in stream_in_files(e, spec, 3).collect()}
    assert got == {r["trend_id"] for r in run(e, Registry((spec,))).collect()} and got
    assert stream_in_files(e.limit(0), spec, 3).count() == 0


def test_buffered_run_is_idempotent(spark, tmp_path):
    registry = Registry.of([{"id": "q", "pattern": "A,B", "within_ms": 100}])
    target = BufferedRun(str(tmp_path / "tables"), registry)
    make = lambda xs: spark.createDataFrame(xs, "event_id bigint, partition_key string, event_type string, event_time_ms bigint")
    target(make([(1, "p", "A", 1), (None, "p", "A", 1), (7, "p", "", 1)]), 0)
    target(make([(2, "p", "B", 5), (2, "p", "B", 5)]), 1)
    target(make([(2, "p", "B", 5)]), 1)
    at = lambda n: target.table(spark, n).read()
    assert [r["path"] for r in at("trends").collect()] == [[1, 2]]
    assert at("rejects").count() == 2 and at("buffer").count() == 2
    assert {(r["batch_id"], r["metric_name"]): r["metric_value"] for r in at("metrics").collect()}[(0, "error_records")] == 2.0


def test_buffered_run_over_a_stream_with_a_restart(spark, tmp_path):
    good = {"id": "q", "pattern": "A,B+", "within_ms": 40}
    bad = {"id": "bad", "pattern": "A,B", "within_ms": 40, "where": [{"field": "user_id", "op": "regex", "value": "("}]}
    rng = __import__("random").Random(4)
    rows = [event(i, rng.choice("AB"), t=i * 5, key=rng.choice("pqrs")) for i in range(1, 80)]
    late = rows[50]
    first, second = [r for r in rows[:60] if r is not late], [late, *rows[55:]]
    target = BufferedRun(str(tmp_path / "tables"), Registry.of([good, bad]), lateness_ms=200, buckets=3)
    schema = "event_id bigint, partition_key string, event_type string, event_time_ms bigint, user_id string"
    for batches in ([first[:30], first[30:]], [first[:30], first[30:], second]):
        query = target.start(feed(spark, tmp_path, batches, schema), str(tmp_path / "checkpoint"))
        query.awaitTermination()
    whole = spark.createDataFrame([tuple(r[c] for c in ("event_id", "partition_key", "event_type", "event_time_ms", "user_id")) for r in rows], schema)
    expected = {r["trend_id"] for r in run(whole, Registry.of([good])).collect()}
    assert {r["trend_id"] for r in target.table(spark, "trends").read().collect()} == expected and expected
    failures = target.table(spark, "failures").read().collect()
    assert {(r["batch_id"], r["query_id"]) for r in failures} == {(0, "bad"), (1, "bad"), (2, "bad")}
    held = target.table(spark, "buffer").read()
    assert held.count() < len(rows) and held.groupBy("partition_key").agg((F.max("event_time_ms") - F.min("event_time_ms")).alias("d")).agg(F.max("d")).first()[0] <= 240


def test_order_within_a_batch_moves_options_and_errors(spark, tmp_path):
    spec = QuerySpec.of({"id": "q", "pattern": "A,B", "within_ms": 100})
    schema = SCHEMA + ", seq bigint, previous_key string"
    numbered = lambda xs: [x | {"seq": n} for n, x in enumerate(xs)]
    batches = [
        numbered([event(1, "A"), event(2, "B"), event(3, "B"), event(3, "B", op="delete"), event(4, "A", op="delete"), event(4, "A")]),
        [event(2, "B", key="r") | {"previous_key": "p", "seq": 9}, event(5, "B") | {"seq": 10}],
    ]
    stream = moves(feed(spark, tmp_path, batches, schema))
    q = to_memory(standing_changes(stream, spec, sequence="seq"), "ordered_out")
    q.awaitTermination()
    got = sorted((r["change"], tuple(r["path"]), r["revision"]) for r in spark.table("ordered_out").collect())
    assert got == [("cancel", (1, 2), 2), ("match", (1, 2), 1), ("match", (1, 5), 2), ("match", (4, 5), 2)]
    quiet = standing_changes(moves(feed(spark, tmp_path, batches, schema)), spec, sequence="seq", options=StandingOptions(cancellations=False, max_gap_ms=1, most_matches=1))
    q = to_memory(quiet, "quiet_out")
    q.awaitTermination()
    assert sorted((r["change"], tuple(r["path"])) for r in spark.table("quiet_out").collect()) == [("match", (1, 2)), ("match", (4, 5))]


def test_a_key_that_fails_does_not_end_the_stream(spark, tmp_path, monkeypatch):
    spec = QuerySpec.of({"id": "q", "pattern": "A{3},B", "within_ms": 100, "relations": [{"field": "user_id"}]})
    import trendloom.streaming.standing as standing

    real = standing.local_paths
    monkeypatch.setattr(standing, "local_paths", lambda steps, held, within: real(steps, held, within) if held[0]["partition_key"] != "bad" else [][1])
    stream = feed(spark, tmp_path, [[event(1, "A"), event(2, "A"), event(3, "A"), event(4, "B"), event(9, "A", key="bad")]])
    q = to_memory(standing_changes(stream, spec), "failing_out")
    q.awaitTermination()
    got = {r["partition_key"]: (r["change"], r["error"]) for r in spark.table("failing_out").collect()}
    assert got["p"] == ("match", None) and got["bad"][0] == "error" and "IndexError" in got["bad"][1]
    assert active_set(spark.table("failing_out")).count() == 1


def test_declared_pipeline_runs(spark, tmp_path, monkeypatch):
    """The declarations, run once by hand: each dataset's function over tables of the names it reads."""
    import types

    made = {}
    keep = lambda name=None, **o: lambda f: made.setdefault(name, f)
    fake = types.SimpleNamespace(table=keep, append_flow=keep, materialized_view=keep, create_streaming_table=lambda *a, **o: None)
    monkeypatch.setitem(__import__("sys").modules, "pyspark.pipelines", fake)
    monkeypatch.setattr("pyspark.pipelines", fake, raising=False)
    from trendloom.streaming import pipeline

    raw = spark.createDataFrame([('{"id": 1, "type": "A", "timestamp_ms": 5}',), ('{"id": 2, "type": "A"}',)], "raw_json string")
    raw.createOrReplaceTempView("raw_events")
    spark.createDataFrame([("q", True), ("r", False)], "query_id string, enabled boolean").createOrReplaceTempView("queries_table")
    batch = types.SimpleNamespace(readStream=spark.read, read=spark.read)
    pipeline.define(batch, "raw_events", "queries_table")
    made["canonical_events"]().createOrReplaceTempView("canonical_events")
    assert made["rejected_events"]().count() == 1 and made["append_to_buffer"]().count() == 1
    assert made["event_quality"]().first()["event_count"] == 1 and made["active_queries"]().count() == 1


@pytest.mark.parametrize("gap", ["10 seconds"])
def test_sessions_of_a_stream(spark, tmp_path, gap):
    stamp = lambda s: f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z"
    batches = [[{"k": "a", "t": stamp(0), "i": 1}, {"k": "a", "t": stamp(20), "i": 2}], [{"k": "a", "t": stamp(9), "i": 3}, {"k": "a", "t": stamp(9), "i": 3}], [{"k": "a", "t": stamp(600), "i": 4}], [{"k": "a", "t": stamp(900), "i": 5}]]
    stream = feed(spark, tmp_path, batches, "k string, t timestamp, i bigint")
    once = first_deliveries(stream, event_id="i", time="t", within="1 minute")
    q = to_memory(session_stream(once, key="k", time="t", gap=gap, lateness=None), "sessions_out")
    q.awaitTermination()
    assert sorted((r["start"].second, r["end"].second, r["n_events"]) for r in spark.table("sessions_out").where("minute(start) = 0").collect()) in ([(0, 9, 2), (20, 20, 1)], [(0, 20, 3)])
    q = to_memory(period_counts(feed(spark, tmp_path, [], "k string, t timestamp, i bigint"), time="t", period="1 minute", cutoff="1 hour"), "periods_out", "complete")
    q.awaitTermination()
    assert sum(r["n_events"] for r in spark.table("periods_out").collect()) == 6
