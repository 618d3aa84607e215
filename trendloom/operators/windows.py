"""Sliding windows, and plans of which of their graphlets to hold in memory."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sliding_windows(spark: SparkSession, start: int, end: int, within: int, slide: int) -> DataFrame:
    """(idx, window_start, window_end): all windows of length `within` every `slide` that end by `end`."""
    n = max(0, (end - within - start) // slide + 1)
    return spark.range(n).select(F.col("id").alias("idx"), (F.col("id") * slide + start).alias("window_start"), (F.col("id") * slide + start + within).alias("window_end"))


def assign_windows(events: DataFrame, within_ms: int, slide_ms: int, t: str = "event_time_ms") -> DataFrame:
    """Each event once for every window [window_start, window_start + within_ms] that holds it; both ends included."""
    last = F.col(t) - F.pmod(F.col(t), F.lit(slide_ms))
    low = F.col(t) - within_ms
    first = low + F.pmod(-low, F.lit(slide_ms))
    starts = F.when(first <= last, F.sequence(first, last, F.lit(slide_ms)))
    return events.withColumn("window_start", F.explode(starts))


def graphlets(windows: DataFrame, mem: tuple[float, float] = (0.7, 0.3), cpu: tuple[float, float] = (0.8, 0.2)) -> DataFrame:
    """A graphlet per window with estimated size and cost.

    Vertices are length / 10 + 1 and edges length / 8 + 1; `mem` weighs vertices and edges, `cpu`
    edges and vertices.
    """
    length = F.col("window_end") - F.col("window_start")
    v, e = F.floor(length / 10) + 1, F.floor(length / 8) + 1
    g = windows.select("idx", "window_start", "window_end", v.alias("vertices"), e.alias("edges"))
    return g.withColumn("memory_cost", F.col("vertices") * mem[0] + F.col("edges") * mem[1]).withColumn("cpu_cost", F.col("edges") * cpu[0] + F.col("vertices") * cpu[1])


def graphlet_delta(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(window_start, window_end, delta): `shared`, `new` or `expired`."""
    a = previous.select("window_start", "window_end").distinct().withColumn("_a", F.lit(True))
    b = current.select("window_start", "window_end").distinct().withColumn("_b", F.lit(True))
    delta = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "expired").otherwise("shared")
    return a.join(b, ["window_start", "window_end"], "full_outer").select("window_start", "window_end", delta.alias("delta"))


def greedy_plan(g: DataFrame, memory: float) -> DataFrame:
    """Graphlets taken cheapest first (cpu + memory, then index) as long as each fits in what memory is left.

    One that doesn't fit is passed over, so each choice hangs on those before it: the graphlets run
    in order through one task, which sorts them on disk if need be and holds one batch at a time.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = 0.0
        for b in batches:
            taken = []
            for cost in b["memory_cost"].to_pylist():
                fits = cost is not None and used + cost <= memory
                used += cost if fits else 0.0
                taken.append(fits)
            yield b.filter(pa.array(taken, pa.bool_())).select(["idx", "memory_cost", "cpu_cost"])

    rows = g.select("idx", F.col("memory_cost").cast("double").alias("memory_cost"), F.col("cpu_cost").cast("double").alias("cpu_cost"))
    line = rows.repartition(1).sortWithinPartitions(F.col("cpu_cost") + F.col("memory_cost"), "idx")
    return line.mapInArrow(take, "idx bigint, memory_cost double, cpu_cost double")


def least_cpu_plan(g: DataFrame, memory: float) -> DataFrame:
    """The set of graphlets of least cpu cost that fits in memory and isn't empty: the single cheapest; of equals the last."""
    best = g.where(F.col("memory_cost") <= memory).agg(F.min_by(F.struct("idx", "memory_cost", "cpu_cost"), F.struct("cpu_cost", (-F.col("idx")).alias("n"))).alias("x"))
    return best.where("x IS NOT NULL").select("x.*")


def calibrate_costs(observed: DataFrame, cost: str) -> DataFrame:
    """(per_vertex, per_edge): the least-squares weights of vertices and edges for an observed cost, in one aggregate.

    Null where vertices and edges don't vary independently.
    """
    v, e, c = F.col("vertices").cast("double"), F.col("edges").cast("double"), F.col(cost).cast("double")
    sums = observed.agg(F.sum(v * v).alias("vv"), F.sum(e * e).alias("ee"), F.sum(v * e).alias("ve"), F.sum(v * c).alias("vc"), F.sum(e * c).alias("ec"))
    det = F.nullif(F.col("vv") * F.col("ee") - F.col("ve") * F.col("ve"), F.lit(0.0))
    return sums.select(((F.col("vc") * F.col("ee") - F.col("ec") * F.col("ve")) / det).alias("per_vertex"), ((F.col("ec") * F.col("vv") - F.col("vc") * F.col("ve")) / det).alias("per_edge"))


def latest_costs(calibrations: DataFrame, at: str = "created_at") -> DataFrame:
    """(per_vertex, per_edge) of the calibration made last; of equals the one with the greater weights. Empty without any."""
    best = calibrations.agg(F.max_by(F.struct("per_vertex", "per_edge"), F.struct(F.col(at), "per_vertex", "per_edge")).alias("x"))
    return best.where("x IS NOT NULL").select("x.*")
