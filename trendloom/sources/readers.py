"""Sources of events: JSON lines, HTTP, tables, lists in memory."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from trendloom.functions.canonical import normalise

Fetch = Callable[[str, dict[str, str]], str]


@dataclass(frozen=True)
class SourceConfig:
    """What a source reads: its name in the data's lineage, where, at most how many messages, and of a stream how many files a trigger."""

    name: str
    location: str = ""
    token: str | None = None
    max_messages: int | None = None
    max_files: int | None = None

    @classmethod
    def from_env(cls, name: str, prefix: str) -> SourceConfig:
        """From the environment: <prefix>_LOCATION, _TOKEN and _MAX_MESSAGES."""
        most = os.environ.get(f"{prefix}_MAX_MESSAGES")
        return cls(name, os.environ.get(f"{prefix}_LOCATION", ""), os.environ.get(f"{prefix}_TOKEN"), int(most) if most else None)


def _limited(df: DataFrame, config: SourceConfig) -> DataFrame:
    return df if config.max_messages is None else df.limit(config.max_messages)


def json_lines(spark: SparkSession, config: SourceConfig, now_ms: int | None = None) -> DataFrame:
    """Canonical events of files of JSON lines; blank lines are skipped."""
    lines = spark.read.text(config.location).where(F.trim("value") != "").select(F.col("value").alias("raw_json"))
    return normalise(_limited(lines, config), config.name, now_ms)


def json_lines_stream(spark: SparkSession, config: SourceConfig, now_ms: int | None = None) -> DataFrame:
    """The same as a stream: files that appear in a folder, at most `max_files` a trigger."""
    if config.max_messages is not None:
        raise ValueError("a stream of files is limited by max_files, not by messages")
    reader = spark.readStream
    if config.max_files is not None:
        reader = reader.option("maxFilesPerTrigger", config.max_files)
    return normalise(reader.text(config.location).where(F.trim("value") != "").select(F.col("value").alias("raw_json")), config.name, now_ms)


def _get(url: str, headers: dict[str, str]) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as answer:
        return answer.read().decode("utf-8")


def http_messages(text: str) -> list[str]:
    """Messages of an answer: a JSON array, one JSON object however it is laid out, or JSON lines."""
    try:
        whole = json.loads(text)
    except ValueError:
        return [line for line in text.splitlines() if line.strip()]
    return [json.dumps(x) for x in (whole if isinstance(whole, list) else [whole])]


def http_source(fetch: Fetch = _get) -> type[DataSource]:
    """A data source `trendloom_http` (options url and token): one poll of an endpoint, by an executor, when the plan runs."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]) -> None:
            self.options = options

        def read(self, partition: object) -> Iterator[tuple[str]]:
            token = self.options.get("token")
            headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
            yield from ((m,) for m in http_messages(fetch(self.options["url"], headers)))

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "trendloom_http"

        def schema(self) -> str:
            return "raw_json string"

        def reader(self, schema: object) -> DataSourceReader:
            return Reader(dict(self.options))

    return Source


def http_poll(spark: SparkSession, config: SourceConfig, fetch: Fetch = _get, now_ms: int | None = None) -> DataFrame:
    """Canonical events of a poll of an HTTP endpoint, with a bearer token if there is one; polled anew whenever the plan runs."""
    spark.dataSource.register(http_source(fetch))
    reader = spark.read.format("trendloom_http").option("url", config.location)
    raw = (reader if config.token is None else reader.option("token", config.token)).load()
    return normalise(_limited(raw, config), config.name, now_ms)


def in_memory(spark: SparkSession, messages: Iterable[dict], config: SourceConfig, now_ms: int | None = None) -> DataFrame:
    """Canonical events of given messages, for tests."""
    rows = [(json.dumps(m),) for m in messages]
    return normalise(_limited(spark.createDataFrame(rows, "raw_json string"), config), config.name, now_ms)


def batches(df: DataFrame, size: int, order: str = "event_id") -> DataFrame:
    """Rows with `batch`, a number for about every `size` rows, without sorting them all in one task."""
    n = max(1, -(-df.count() // size))
    return df.withColumn("batch", F.pmod(F.xxhash64(order), F.lit(n)))
