"""Sinks for trends and changes: memory, JSON lines, HTTP."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Post = Callable[[str, bytes, dict[str, str]], None]


def to_memory(stream: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """A table in the driver's memory, for tests and small results."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()


def to_json_lines(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines, keys in order of columns."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def _post(url: str, body: bytes, headers: dict[str, str]) -> None:
    with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers, method="POST"), timeout=60):
        pass


def to_http(df: DataFrame, url: str, post: Post = _post, token: str | None = None, batch: int = 500) -> None:
    """Post rows as JSON arrays of up to `batch`, from the executors."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})

    def send(rows: Iterator[Row]) -> None:
        held: list[str] = []
        for r in rows:
            held.append(r["value"])
            if len(held) == batch:
                post(url, f"[{','.join(held)}]".encode(), headers)
                held = []
        if held:
            post(url, f"[{','.join(held)}]".encode(), headers)

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).foreachPartition(send)
