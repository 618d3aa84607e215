import random

import numpy as np
import pyarrow as pa
import pytest

from trendloom.llm.subsequences import _encode, frequent_triples


def brute(events, within, one_in, least):
    by = {}
    for _, k, t, y in events:
        by.setdefault(k, []).append((t, y))
    support = {}
    for es in by.values():
        held = set()
        for t1, a in es:
            for t2, b in es:
                if b == a or not t1 < t2 <= t1 + within:
                    continue
                held.update((a, b, c) for t3, c in es if c not in (a, b) and t2 < t3 <= t1 + within)
        for p in held:
            support[p] = support.get(p, 0) + 1
    need = max(least, -(-len(by) // one_in))
    return sorted((*p, n) for p, n in support.items() if n >= need)


def found(df, **options):
    return sorted(tuple(r) for r in frequent_triples(df, **options).collect())


@pytest.mark.parametrize("hot", [{}, {"least_rows": 20, "at_most": 10_000, "least_block_ms": 4}])
@pytest.mark.parametrize("chunk_rows", [30, 100_000])
def test_against_brute_force(spark, hot, chunk_rows):
    rng = random.Random(11)
    events = [(i, f"k{rng.randint(0, 12)}", rng.randint(1, 120), rng.choice("abcdefg")) for i in range(260)]
    events += [(1000 + i, "hot", rng.randint(1, 400), rng.choice("abcdefgh")) for i in range(500)]
    events += [(5000, "far", 2**61, "a"), (5001, "far", 2**61 + 1, "b"), (5002, "far", 2**61 + 2, "c"), (5003, "far", 1, "a")]
    df = spark.createDataFrame(events, "event_id bigint, k string, t bigint, type_key string").selectExpr("*", "1 AS kind", "2 AS own")
    expected = brute(events, 20, 5, 3)
    assert expected
    assert found(df.unionByName(df.where('event_id % 3 = 0')), within_ms=20, one_in=5, least=3, chunk_rows=chunk_rows, **hot) == expected


def test_ties_have_no_order_and_window_is_inclusive(spark):
    events = []
    for k in ("p", "q", "r"):
        events += [(1, k, 10, "a"), (2, k, 10, "b"), (3, k, 15, "b"), (4, k, 20, "c"), (5, k, 21, "d")]
    df = spark.createDataFrame(events, "event_id bigint, k string, t bigint, type_key string")
    assert found(df, within_ms=10, one_in=2, least=3) == [("a", "b", "c", 3), ("b", "c", "d", 3)]


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None, 1, "x"), (2, "k", None, "x"), (3, "k", 1, None), (4, "k", 1, "x")], "event_id bigint, k string, t bigint, type_key string")
    assert found(df, least=1, one_in=1) == []
    assert found(df.limit(0)) == []


def test_an_entity_within_one_task_is_cut_by_time():
    rng = random.Random(5)
    when = sorted(rng.randint(0, 3_000) for _ in range(900))
    t = pa.table({"k": ["a"] * 900 + ["b"] * 4, "t": [*when, 1, 2, 3, 4], "kind": pa.array([rng.randint(0, 3) for _ in range(904)], pa.int32()), "block": pa.array([None] * 904, pa.int64()), "own": [True] * 904})
    parts = [r for b in _encode(50, 20)(iter(t.to_batches(max_chunksize=25))) for r in b.to_pylist()]
    assert len(parts) > 10 and max(len(r["times"]) // 8 for r in parts) < 120
    assert {x for r in parts[:-1] for x in r["split"]} == {"a"} and parts[-1]["split"] == ["a", None]
    own = [x for r in parts for x, o in zip(np.frombuffer(r["times"], np.int64), np.frombuffer(r["own"], bool), strict=True) if o]
    assert sorted(own) == sorted([*when, 1, 2, 3, 4])
