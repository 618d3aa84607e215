"""A feature table with one row per entity from events of hundreds of types."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ENTRIES = "k string, type_key string, n bigint, last bigint"


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Index of each value in the list of distinct ones, and that list."""
    encoded = column.combine_chunks()
    encoded = (encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded).dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary


def dense_blocks(entity: np.ndarray, kind: np.ndarray, n: np.ndarray | None, last: np.ndarray, n_entities: int, n_kinds: int, cells: int = 2_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks (first entity, counts, latest) over entity and type indices.

    counts and latest are dense arrays of entities x types: counts by numpy's bincount,
    latest by a maximum scatter. A block holds as many entities as `cells` allows.
    """
    order = np.argsort(entity, kind="stable")
    entity, kind, last = entity[order], kind[order], last[order]
    n = None if n is None else n[order]
    step = max(1, cells // max(1, n_kinds))
    edges = np.searchsorted(entity, np.arange(0, n_entities + step, step))
    for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if i == j:
            continue
        height = min(step, n_entities - b * step)
        cell = (entity[i:j] - b * step) * n_kinds + kind[i:j]
        if n is None:
            counts = np.bincount(cell, minlength=height * n_kinds)
        else:
            counts = np.zeros(height * n_kinds, np.int64)
            np.add.at(counts, cell, n[i:j])
        latest = np.zeros(height * n_kinds, np.int64)
        np.maximum.at(latest, cell, last[i:j])
        yield b * step, counts.reshape(height, n_kinds), latest.reshape(height, n_kinds)


def _entries(t: pa.Table) -> Iterator[pa.RecordBatch]:
    entity, entities = _codes(t["k"])
    kind, kinds = _codes(t["type_key"])
    n = t["n"].to_numpy() if "n" in t.column_names else None
    for first, counts, latest in dense_blocks(entity, kind, n, t["last"].to_numpy(), len(entities), len(kinds)):
        e, k = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([entities.take(pa.array(e + first)), kinds.take(pa.array(k)), pa.array(counts[e, k]), pa.array(latest[e, k])], ["k", "type_key", "n", "last"])


def _partial(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Map side: entries of every `rows` rows, so that a hot entity sends at most one row per type for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size >= rows:
                yield from _entries(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from _entries(pa.Table.from_batches(held))

    return run


def _whole_entities(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables that hold whole entities, from batches sorted by entity."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        size += len(b)
        if size < rows:
            continue
        t = pa.Table.from_batches(held)
        tail = pc.equal(t["k"], t["k"][-1]).to_numpy()
        cut = int(np.argmax(tail))
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).to_batches()
        size = sum(map(len, held))
        rows = max(rows, 2 * size)
    if held:
        yield pa.Table.from_batches(held)


def _final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _whole_entities(batches):
        yield from _entries(t)


def feature_entries(events: DataFrame, *, local_rows: int = 200_000) -> DataFrame:
    """The non-zero entries (k, type_key, n, last) of the feature table of canonical events.

    n is the number of events of the type, last the latest time. Entities are hash-bucketed;
    in each bucket, entities and types become indices, counts come from numpy's bincount
    and the latest times from a maximum scatter on dense blocks, and the entries leave as
    Arrow columns. The same runs on the map side for every `local_rows` rows first: a hot
    entity reaches its bucket as one row per type for each of these.
    Any number of types goes: each task indexes those it has. No events give no entries.
    """
    return _bucketed(events, local_rows).mapInArrow(_final, _ENTRIES)


def _bucketed(events: DataFrame, local_rows: int) -> DataFrame:
    local = events.select("k", "type_key", F.col("t").alias("last")).mapInArrow(_partial(local_rows), _ENTRIES)
    return local.repartition("k").sortWithinPartitions("k")


def _wide(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    index = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_entities(batches):
            entity, entities = _codes(t["k"])
            kind, kinds = _codes(t["type_key"])
            kind = np.array([index[x] for x in kinds.to_pylist()])[kind]
            for first, counts, latest in dense_blocks(entity, kind, t["n"].to_numpy(), t["last"].to_numpy(), len(entities), len(names)):
                columns = [entities.slice(first, len(counts)), pa.array(counts.sum(1)), pa.array(latest.max(1)), pa.array((counts > 0).sum(1))]
                for i in range(len(names)):
                    columns += [pa.array(counts[:, i]), pa.array(latest[:, i], mask=counts[:, i] == 0)]
                yield pa.RecordBatch.from_arrays(columns, ["partition_key", "n_events", "last_event_time_ms", "n_types", *(f"{p}_{x}" for x in names for p in ("n", "last"))])

    return run


def feature_table(events: DataFrame, types: list[str] | None = None, *, max_types: int = 5_000, local_rows: int = 200_000) -> DataFrame:
    """One row per entity: totals, then n_<type> (0 where none) and last_<type> (null) of each type.

    `types` are the columns wanted; by default all types that occur, of which there may be
    `max_types` at most (a schema, not the data, bounds a table's width: beyond it use
    `feature_entries`). Given types that don't occur give zero columns; events of types not
    given count nowhere.
    """
    if types is None:
        found = events.select("type_key").distinct().orderBy("type_key").limit(max_types + 1).collect()
        if len(found) > max_types:
            raise ValueError(f"more than {max_types} types; use feature_entries")
        types = [r[0] for r in found]
    else:
        events = events.where(F.col("type_key").isin(list(types)))
    names = sorted(set(types))
    schema = "partition_key string, n_events bigint, last_event_time_ms bigint, n_types bigint" + "".join(f", `{p}_{x}` bigint" for x in names for p in ("n", "last"))
    return _bucketed(events, local_rows).mapInArrow(_wide(names), schema)
