import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trendloom.operators.buffer_events import canonical_events
from trendloom.operators.delivery import SeenRanges, deliver_once
from trendloom.operators.features import dense_blocks, feature_entries, feature_table
from trendloom.operators.hot_keys import block_number, hot_blocks, with_block_length
from trendloom.operators.intervals import IntervalMap, periods_and_gaps
from trendloom.operators.lateness import FingerTree, late_corrections
from trendloom.operators.sessions import sessionize

BASE = datetime(2015, 1, 5, tzinfo=timezone.utc)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_canonical_events(spark, buffer_schema):
    t = BASE
    data = [
        (1, "k", "Token Read", t, 5, "{", 1, t), (1, "k", "token_read", None, 5, None, 2, None), (2, "k", "TOKEN.READ2", t, 6, "", None, t), (3, "", "A", t, 6, "", 1, t), (4, None, "A", t, 6, "", 1, t),
        (5, "k", "", t, 6, "", 1, t), (6, "k", None, t, 6, "", 1, t), (7, "k", "A", t, 0, "", 1, t), (8, "k", "A", t, None, "", 1, t), (None, "k", "A", t, 6, "", 1, t), (9, "k", "ÄÖ-1", t, 7, "", 1, t),
    ]
    df = spark.createDataFrame(data, buffer_schema).withColumn("k", F.lit("clash")).withColumn("t", F.lit(0))
    assert rows(canonical_events(df)) == [(1, "k", 5, "tokenread"), (2, "k", 6, "tokenread2"), (9, "k", 7, "äö1")]
    assert canonical_events(df.limit(0)).count() == 0
    assert canonical_events(df, event_type=None).count() == 5


def brute_sessions(events, gap):
    out = []
    for k in sorted({k for k, _ in events}):
        times = sorted(t for x, t in events if x == k)
        start = n = 0
        for i, t in enumerate(times):
            if i and t - times[i - 1] > gap:
                out.append((k, times[start], times[i - 1], n))
                start, n = i, 0
            n += 1
        out.append((k, times[start], times[-1], n))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_sessions(spark, block):
    rng = random.Random(3)
    data = [(k, rng.randint(1, 400)) for k in "abc" for _ in range(60)] + [("hot", 5)] * 50 + [("edge", 1), ("edge", 11), ("edge", 22), ("far", 2**62), ("far", 2**62 + 10)]
    df = spark.createDataFrame([*data, (None, 1), ("a", None)], "k string, t bigint").withColumn("w", F.lit(1)).withColumn("block", F.lit(1))
    got = rows(sessionize(df, gap_ms=10, block_ms=block), "k", "start_ms", "end_ms", "n_events")
    assert got == brute_sessions(data, 10)
    assert sessionize(df.limit(0), gap_ms=10).count() == 0
    with pytest.raises(ValueError):
        sessionize(df, gap_ms=0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=12), max_size=8))
def test_seen_ranges(batches):
    seen, known = SeenRanges(), set()
    for b in batches:
        mask = seen.accept(np.array(b, np.int64))
        expected = []
        for x in b:
            expected.append(x not in known)
            known.add(x)
        assert mask.tolist() == expected
        assert (seen.starts[1:] > seen.ends[:-1]).all()
        assert sorted(known) == [x for s, e in zip(seen.starts, seen.ends, strict=True) for x in range(s, e)]


def test_deliver_once(spark, buffer_schema):
    rng = random.Random(5)
    data = []
    for _ in range(600):
        i = rng.choice([None, 0, -3, 7_000_000_001, 7_000_065_536, 8_000_000_000, 5] + list(range(7_000_000_100, 7_000_000_180)))
        at = rng.choice([None] + [BASE + timedelta(microseconds=x) for x in range(4)])
        data.append((i, "k", "A", None, rng.choice([None, 9]), None, rng.choice([None, 1, 2, 3]), at))
    df = spark.createDataFrame(data, buffer_schema).repartition(7)
    big = (datetime.max.replace(tzinfo=timezone.utc), 10**9)
    expected = {}
    for r in data:
        if r[0] is not None:
            key = (r[7] or big[0], r[6] if r[6] is not None else big[1])
            best, n, carry = expected.get(r[0], (key, 0, None))
            expected[r[0]] = (min(best, key), n + 1, r[4] if carry is None else carry)
    got = {r["event_id"]: r for r in deliver_once(df, carry=F.col("event_time_ms"), shard_span=64).collect()}
    assert got.keys() == expected.keys()
    for i, ((at, batch), n, carry) in expected.items():
        r = got[i]
        assert r["batch_id"] == (None if batch == big[1] else batch) and r["n_copies"] == n and r["carry"] == carry
        assert r["ingested_us"] == (None if at == big[0] else int((at - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1)))
    assert deliver_once(df.limit(0)).count() == 0


def test_features(spark):
    rng = random.Random(2)
    data = [(i, rng.choice("abcdef"), rng.randint(1, 1000), f"type{rng.randint(0, 30)}") for i in range(2000)] + [(10_000 + i, "hot", 1 + i, "type1") for i in range(1500)]
    df = spark.createDataFrame(data, "event_id bigint, k string, t bigint, type_key string").withColumn("n", F.lit(9)).withColumn("last", F.lit(9))
    expected = {}
    for _, k, t, y in data:
        n, last = expected.get((k, y), (0, 0))
        expected[k, y] = (n + 1, max(last, t))
    got = {(r["k"], r["type_key"]): (r["n"], r["last"]) for r in feature_entries(df, local_rows=100).collect()}
    assert got == expected
    wide = {r["partition_key"]: r for r in feature_table(df).collect()}
    assert wide["hot"]["n_events"] == 1500 and wide["hot"]["n_type1"] == 1500 and wide["hot"]["n_type2"] == 0 and wide["hot"]["last_type2"] is None and wide["hot"]["n_types"] == 1
    assert sum(r["n_type7"] for r in wide.values()) == sum(n for (_, y), (n, _) in expected.items() if y == "type7")
    chosen = feature_table(df, ["type1", "never"])
    assert set(chosen.columns) == {"partition_key", "n_events", "last_event_time_ms", "n_types", "n_type1", "last_type1", "n_never", "last_never"}
    assert feature_entries(df.limit(0)).count() == 0 and feature_table(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        feature_table(df, max_types=3)


def test_dense_blocks_in_small_blocks():
    e, k, t = np.array([4, 0, 4, 2]), np.array([1, 0, 1, 1]), np.array([5, 6, 7, 8])
    blocks = list(dense_blocks(e, k, None, t, 5, 2, cells=2))
    assert [b for b, _, _ in blocks] == [0, 2, 4]
    assert blocks[-1][1].tolist() == [[0, 2]] and blocks[-1][2].tolist() == [[0, 7]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["add", "evict"]), st.integers(-300, 300), st.integers(1, 5)), max_size=120))
def test_finger_tree(steps):
    tree, held, line = FingerTree(), {}, None
    for op, key, n in steps:
        if op == "add":
            ok = tree.add(key, n)
            assert ok == (line is None or key >= line)
            if ok:
                held[key] = held.get(key, 0) + n
        elif line is None or key > line:
            line = key
            gone = tree.evict(key)
            assert gone == sum(v for k, v in held.items() if k < key)
            held = {k: v for k, v in held.items() if k >= key}
        assert tree.root.count == sum(held.values())
        assert tree.total(-50, 60) == sum(v for k, v in held.items() if -50 <= k < 60)
    assert list(tree.items()) == sorted(held.items())


def test_finger_tree_in_order_and_late():
    tree = FingerTree()
    for i in range(5000):
        tree.add(i, 1)
        tree.add(max(0, i - 700), 1)
    assert tree.root.count == 10_000 and tree.total(0, 100) == 200 + 700
    assert tree.evict(2500) == sum(1 for i in range(5000) if i < 2500) + sum(1 for i in range(5000) if max(0, i - 700) < 2500)


def test_late_corrections(spark):
    rng = random.Random(8)
    minute, hour, day = 60_000, 3_600_000, 86_400_000
    data = []
    for _ in range(800):
        t = rng.randint(1, 3 * day)
        delay = rng.choice([-5, 0, 30 * minute * 1000, 30 * minute * 1000 + 1, day * 1000, day * 1000 + 1, rng.randint(0, 26 * hour * 1000)])
        data.append((t, t * 1000 + delay, rng.choice([None, 1, 2, 3, 4, 5])))
    df = spark.createDataFrame([*data, (None, 5, 1), (5, None, 1)], "t bigint, ingested_us bigint, batch_id bigint").withColumn("pane", F.lit(1)).withColumn("shard", F.lit(1))
    expected = {(t // hour * hour, b) for t, at, b in data if 30 * minute * 1000 < at - t * 1000 <= day * 1000}
    found = late_corrections(df).cache()
    assert {(r["period_start_ms"], r["batch_id"]) for r in found.where("corrects").collect()} == expected
    counts = {}
    for t, at, _ in data:
        if at - t * 1000 <= day * 1000:
            counts[t // hour * hour] = counts.get(t // hour * hour, 0) + 1
    got = {r["period_start_ms"]: r["n"] for r in found.groupBy("period_start_ms").agg(F.sum("n_added").alias("n")).where("n > 0").collect()}
    assert got == counts
    assert {r["period_start_ms"]: r["n"] for r in found.groupBy("period_start_ms").agg(F.max("n_after").alias("n")).where("n > 0").collect()} == counts
    assert late_corrections(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        late_corrections(df, period_ms=90_000)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 12)), max_size=25))
def test_interval_map(spans):
    held, points = IntervalMap(), set()
    for s, n in spans:
        held.add(s, s + n)
        points |= set(range(2 * s, 2 * (s + n) + 1))
    merged = [x for s, e in zip(held.starts, held.ends, strict=True) for x in range(2 * s, 2 * e + 1)]
    assert merged == sorted(points)
    assert all(b > a for a, b in held.gaps())


def brute_periods(spans):
    out = []
    for k in sorted({k for k, _, _ in spans}):
        held = IntervalMap()
        for x, s, e in spans:
            if x == k:
                held.add(s, e)
        out += [(k, "period", s, e) for s, e in zip(held.starts, held.ends, strict=True)] + [(k, "gap", a, b) for a, b in held.gaps()]
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [{"least_rows": 3, "at_most": 10_000, "least_block_ms": 3}, {"least_rows": 10, "at_most": 10_000, "least_block_ms": 40}, {}])
def test_periods_and_gaps(spark, hot):
    rng = random.Random(4)
    data = [(k, s, s + rng.choice([0, 1, 3, rng.randint(0, 120)])) for k in "abcde" for s in (rng.randint(-50, 900) for _ in range(rng.randint(1, 45)))]
    data += [("wide", 0, 2**62), ("wide", 5, 6), ("touch", 1, 5), ("touch", 5, 8), ("touch", 9, 9), ("touch", 9, 9)]
    junk = [(None, 1, 2), ("", 1, 2), ("a", None, 2), ("a", 1, None), ("a", 5000, 1)]
    df = spark.createDataFrame(data + junk, "partition_key string, window_start_ms bigint, window_end_ms bigint").withColumn("slice", F.lit("x")).withColumn("s", F.lit(0))
    assert rows(periods_and_gaps(df, **hot)) == brute_periods(data)
    assert periods_and_gaps(df.limit(0)).count() == 0


def test_hot_blocks(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), F.col("id").alias("t"))
    blocks = hot_blocks(df, key="k", time_ms="t", least_rows=1000, at_most=20, least_block_ms=1)
    assert blocks == {"hot": 9999 * 1000 // 10_000}
    number = block_number(F.col("t"), F.col("block_ms")).alias("b")
    assert with_block_length(df, blocks).select(number).distinct().count() == 12
    assert with_block_length(df, {}).select(number).where("b IS NOT NULL").count() == 0


def test_settled_tables_are_released(spark):
    import os

    from trendloom.session import release, settle

    df = settle(spark.range(3).toDF("x"), "test")
    path = df.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert df.count() == 3 and os.path.exists(path)
    assert release(spark) >= 1 and not os.path.exists(path) and release(spark) == 0
