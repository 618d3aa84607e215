import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trendloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def chain(spark):
    """Events of one key from a text like `1A@1 2B@2`, in canonical columns."""

    def make(text, key="p", **more):
        rows = []
        for token in text.split():
            head, _, t = token.partition("@")
            ident = int("".join(x for x in head if x.isdigit()))
            rows.append((ident, key, "".join(x for x in head if not x.isdigit()), int(t or ident)))
        return spark.createDataFrame(rows, "event_id bigint, partition_key string, event_type string, event_time_ms bigint")

    return make


@pytest.fixture(scope="session")
def buffer_schema():
    return "event_id bigint, partition_key string, event_type string, event_time timestamp, event_time_ms bigint, payload string, batch_id bigint, ingested_at timestamp"
