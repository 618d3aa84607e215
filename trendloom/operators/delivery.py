"""Exactly one row for each message of an at-least-once delivery."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Microseconds and batch numbers of a missing value: they sort last.
LAST = np.iinfo(np.int64).max

_PARTIAL = "producer bigint, shard bigint, seq bigint, at bigint, batch bigint, n bigint, carry bigint"
_KEPT = "event_id bigint, at bigint, batch bigint, n_copies bigint, carry bigint"


class SeenRanges:
    """The numbers of one producer seen so far, as disjoint half-open ranges in order."""

    def __init__(self) -> None:
        self.starts = np.empty(0, np.int64)
        self.ends = np.empty(0, np.int64)

    def covers(self, numbers: np.ndarray) -> np.ndarray:
        """Which of `numbers` lie in a range; binary search."""
        if not len(self.starts):
            return np.zeros(len(numbers), bool)
        i = np.searchsorted(self.starts, numbers, side="right") - 1
        return (i >= 0) & (numbers < self.ends[np.maximum(i, 0)])

    def accept(self, numbers: np.ndarray) -> np.ndarray:
        """Take in `numbers`, in order of delivery; True for each uncovered one, the first time."""
        fresh = np.flatnonzero(~self.covers(numbers))
        first, where = np.unique(numbers[fresh], return_index=True)
        mask = np.zeros(len(numbers), bool)
        mask[fresh[where]] = True
        self._merge(first)
        return mask

    def _merge(self, numbers: np.ndarray) -> None:
        """Add sorted new numbers; ranges that touch become one."""
        if not len(numbers):
            return
        cut = np.flatnonzero(np.diff(numbers) != 1) + 1
        starts = np.concatenate([self.starts, numbers[np.concatenate([[0], cut])]])
        ends = np.concatenate([self.ends, numbers[np.concatenate([cut - 1, [len(numbers) - 1]])] + 1])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        opens = np.concatenate([[True], starts[1:] > ends[:-1]])
        self.starts = starts[opens]
        self.ends = ends[np.concatenate([opens[1:], [True]])]


def _ints(column: pa.ChunkedArray | pa.Array, missing: int) -> np.ndarray:
    return column.fill_null(missing).to_numpy(zero_copy_only=False)


def _ordered(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    order = np.lexsort((columns["batch"], columns["at"]))
    return {k: v[order] for k, v in columns.items()}


def _totals(of: np.ndarray, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers in order, and of each the sum of n and the greatest carry."""
    numbers, inverse = np.unique(of, return_inverse=True)
    n = np.zeros(len(numbers), np.int64)
    np.add.at(n, inverse, rows["n"])
    carry = np.full(len(numbers), -LAST)
    np.maximum.at(carry, inverse, rows["carry"])
    return numbers, n, carry


def _null_where(values: np.ndarray, missing: int) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == missing)


def _local(span: int, shard_span: int):
    """Map side: in each Arrow batch one row per number, the first delivered, with the copies' count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _ordered({"id": _ints(b["id"], 0), "at": _ints(b["at"], LAST), "batch": _ints(b["batch"], LAST), "carry": _ints(b["carry"], -LAST), "n": np.ones(len(b), np.int64)})
            kept = SeenRanges().accept(rows["id"])
            numbers, n, carry = _totals(rows["id"], rows)
            ids = rows["id"][kept]
            at = np.searchsorted(numbers, ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids // span), pa.array(ids % span // shard_span), pa.array(ids % span), _null_where(rows["at"][kept], LAST), _null_where(rows["batch"][kept], LAST), pa.array(n[at]), _null_where(carry[at], -LAST)],
                ["producer", "shard", "seq", "at", "batch", "n", "carry"],
            )

    return run


def _shard(span: int, step: int = 16_384):
    """Reduce side: the rows of one producer's shard in order of delivery, against its ranges."""

    def run(t: pa.Table) -> pa.Table:
        rows = _ordered({"seq": _ints(t["seq"], 0), "at": _ints(t["at"], LAST), "batch": _ints(t["batch"], LAST), "n": _ints(t["n"], 0), "carry": _ints(t["carry"], -LAST)})
        seen = SeenRanges()
        kept = np.concatenate([seen.accept(rows["seq"][i : i + step]) for i in range(0, len(t), step)])
        numbers, n, carry = _totals(rows["seq"], rows)
        seq = rows["seq"][kept]
        at = np.searchsorted(numbers, seq)
        producer = t["producer"][0].as_py()
        return pa.table([pa.array(seq + producer * span), _null_where(rows["at"][kept], LAST), _null_where(rows["batch"][kept], LAST), pa.array(n[at]), _null_where(carry[at], -LAST)], ["event_id", "at", "batch", "n_copies", "carry"])

    return run


def deliver_once(
    df: DataFrame,
    *,
    event_id: str = "event_id",
    ingested_at: str = "ingested_at",
    batch_id: str = "batch_id",
    carry: F.Column | None = None,
    producer_span: int = 1_000_000_000,
    shard_span: int = 65_536,
) -> DataFrame:
    """One row (event_id, batch_id, ingested_us, n_copies, carry) for each non-null identifier.

    The row kept is the one with the earliest `ingested_at`, then the lowest `batch_id`;
    null comes last in both. `n_copies` counts all rows of the identifier, `carry` is the
    greatest value of the given bigint column over them (null where it is null in all).

    Method: an identifier above 0 is producer * `producer_span` + number. Disjoint seen
    ranges are kept per producer; rows go through in order of delivery, each number that no
    range covers is accepted once, and ranges that touch merge. Ranges of one producer are
    split into shards of `shard_span` numbers, so that a producer with a third of all rows
    is spread. Before the shuffle the same runs within each Arrow batch, so that a group of
    copies of any size sends one row a batch. Identifiers of 0 or less are malformed (no
    producer) and are resolved by exact keyed lookup instead.

    Rows without identifier are left out; an empty table gives no rows; extra columns are
    not read.
    """
    rows = df.where(F.col(event_id).isNotNull()).select(
        F.col(event_id).cast("long").alias("id"),
        F.unix_micros(F.col(ingested_at).cast("timestamp")).alias("at"),
        F.col(batch_id).cast("long").alias("batch"),
        (F.lit(None) if carry is None else carry).cast("long").alias("carry"),
    )
    sound = (
        rows.where("id > 0")
        .mapInArrow(_local(producer_span, shard_span), _PARTIAL)
        .groupBy("producer", "shard")
        .applyInArrow(_shard(producer_span), _KEPT)
    )
    first = F.min(F.struct(F.col("at").isNull().alias("a"), F.col("at"), F.col("batch").isNull().alias("b"), F.col("batch")))
    malformed = (
        rows.where("id <= 0")
        .groupBy("id")
        .agg(first.alias("f"), F.count(F.lit(1)).alias("n_copies"), F.max("carry").alias("carry"))
        .select(F.col("id").alias("event_id"), "f.at", "f.batch", "n_copies", "carry")
    )
    return sound.unionByName(malformed).select("event_id", F.col("batch").alias("batch_id"), F.col("at").alias("ingested_us"), "n_copies", "carry")
