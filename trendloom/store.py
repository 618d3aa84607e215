"""Tables as snapshots: each change writes a new version, and a pointer names the current one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.operators.replay import insert_absent, upsert


class Snapshots:
    """A parquet table with upsert, delete and partial overwrite, on any Hadoop file system.

    A version is written whole beside the current one; then one small pointer file, named by a
    rising number, makes it current. Readers see one version or the next, never a mixture, and a
    write that dies leaves no trace in the table. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2) -> None:
        self.spark, self.path, self.keep = spark, path, keep
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._to = hadoop.Path
        self._fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[tuple[int, str]]:
        at = self._to(f"{self.path}/_current")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in names if n[0].isdigit())

    def version(self) -> int:
        """The number of the current version, 0 where there is none yet."""
        held = self._pointers()
        return held[-1][0] if held else 0

    def exists(self) -> bool:
        return self.version() > 0

    def read(self, version: int | None = None) -> DataFrame:
        """The current version, or an earlier one that is still kept."""
        held = dict(self._pointers())
        if not held:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/{held[max(held) if version is None else version]}")

    def replace(self, df: DataFrame) -> None:
        """Make `df` the table; it may be made from the current version."""
        held = self._pointers()
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        number = held[-1][0] + 1 if held else 1
        self._fs.mkdirs(self._to(f"{self.path}/_current"))
        self._fs.create(self._to(f"{self.path}/_current/{number}-{name}"), False).close()
        for n, old in held[: max(0, len(held) + 1 - self.keep)]:
            self._fs.delete(self._to(f"{self.path}/_current/{n}-{old}"), False)
            self._fs.delete(self._to(f"{self.path}/{old}"), True)

    def upsert(self, rows: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> None:
        """Rows replace those with the same keys or join them (see `trendloom.operators.replay.upsert`)."""
        self.replace(upsert(self.read(), rows, keys, keep) if self.exists() else rows)

    def insert(self, rows: DataFrame, keys: Sequence[str]) -> None:
        """Add the rows whose keys the table lacks."""
        self.replace(insert_absent(self.read(), rows, keys) if self.exists() else rows)

    def delete(self, where: Column) -> None:
        """Drop rows for which the condition is true."""
        self.replace(self.read().where(~F.coalesce(where, F.lit(False))))

    def overwrite(self, rows: DataFrame, where: Column) -> None:
        """Put `rows` in the place of those for which the condition is true."""
        self.replace(self.read().where(~F.coalesce(where, F.lit(False))).unionByName(rows) if self.exists() else rows)


class Buckets:
    """A parquet table in buckets by the hash of one column, on any Hadoop file system: a change writes the touched buckets only.

    Each change writes the new contents of its buckets beside the old ones; then one small pointer
    file, named by a rising number, says which folder holds each bucket. Readers see one version or
    the next, never a mixture. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, by: str, buckets: int = 64, keep: int = 2) -> None:
        self.spark, self.path, self.by, self.buckets, self.keep = spark, path, by, buckets, keep
        self._to = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._to(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        at = self._to(f"{self.path}/_current")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _places(self, version: int) -> dict[str, str]:
        stream = self._fs.open(self._to(f"{self.path}/_current/{version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def exists(self) -> bool:
        return bool(self._versions())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.by)), F.lit(self.buckets)).cast("int")

    def _read(self, places: dict[str, str], schema: object) -> DataFrame:
        folders = [f"{self.path}/{name}/_bucket={b}" for b, name in places.items()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The current contents; FileNotFoundError where there are none yet."""
        held = self._versions()
        if not held:
            raise FileNotFoundError(self.path)
        places = self._places(held[-1])
        some = [f"{self.path}/{name}/_bucket={b}" for b, name in places.items()]
        if not some:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(*some)

    def change(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], only: Sequence[int] | None = None) -> None:
        """Put `merge(old, rows)` in the place of the buckets that `rows` touch (or `only` these).

        `old` holds the touched buckets' rows in the columns of `rows`. Which buckets are touched is
        all that the driver gets.
        """
        touched = sorted({r[0] for r in rows.select(self._bucket()).distinct().collect()} if only is None else only)
        if not touched:
            return
        held = self._versions()
        places = self._places(held[-1]) if held else {}
        old = self._read({b: places[b] for b in map(str, touched) if b in places}, rows.schema)
        name = f"v-{uuid.uuid4().hex}"
        merge(old, rows).withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        written = {s.getPath().getName().partition("=")[2] for s in self._fs.listStatus(self._to(f"{self.path}/{name}")) if "=" in s.getPath().getName()}
        places = {b: n for b, n in places.items() if int(b) not in touched} | dict.fromkeys(sorted(written), name)
        number = held[-1] + 1 if held else 1
        self._fs.mkdirs(self._to(f"{self.path}/_current"))
        out = self._fs.create(self._to(f"{self.path}/_current/{number}"), False)
        out.write(bytearray(json.dumps(places).encode()))
        out.close()
        self._clean([*held, number])

    def _clean(self, held: list[int]) -> None:
        """Drop versions beyond `keep`, and folders that no kept version names."""
        for n in held[: -self.keep]:
            self._fs.delete(self._to(f"{self.path}/_current/{n}"), False)
        named = {name for n in held[-self.keep :] for name in self._places(n).values()}
        for s in self._fs.listStatus(self._to(self.path)):
            name = s.getPath().getName()
            if name.startswith("v-") and name not in named:
                self._fs.delete(s.getPath(), True)

    def upsert(self, rows: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> None:
        """Rows replace those with the same keys or join them (see `trendloom.operators.replay.upsert`)."""
        self.change(rows, lambda old, new: upsert(old, new, keys, keep))


def save_graph(events: DataFrame, edges: DataFrame, path: str) -> None:
    """Keep a graph of events: its events and edges as snapshot tables under one folder."""
    Snapshots(events.sparkSession, f"{path}/events").replace(events)
    Snapshots(events.sparkSession, f"{path}/edges").replace(edges)


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, edges) of the graph kept last."""
    return Snapshots(spark, f"{path}/events").read(), Snapshots(spark, f"{path}/edges").read()
