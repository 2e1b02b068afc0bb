import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from earshot.session import local_session  # noqa: E402
from earshot.sources.mart import Mart  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(shuffle_partitions=4)


@pytest.fixture(scope="session")
def mart(spark):
    return Mart(spark, SF_DIR)


@pytest.fixture(scope="session")
def rows(spark):
    """Build a frame from rows and a schema text."""
    def make(data, schema):
        return spark.createDataFrame(data, schema)
    return make


@pytest.fixture(scope="session")
def plays(spark):
    """Build plays from (user, 'yyyy-mm-dd hh:mm') pairs, or with further columns by name."""
    from pyspark.sql import functions as F

    defaults = {"session_id": None, "track_id": "t1", "listen_duration_ms": 60_000,
                "track_duration_ms": 200_000, "skipped": False, "context": "playlist", "device": "mobile"}
    schema = ("session_id string, user_id string, track_id string, ts string, listen_duration_ms bigint, "
              "track_duration_ms bigint, skipped boolean, context string, device string")

    def make(*items):
        data = []
        for i, item in enumerate(items):
            user, ts, more = (*item, {})[:3]
            row = {**defaults, "session_id": f"s{i}", **more}
            data.append((row["session_id"], user, row["track_id"], ts, row["listen_duration_ms"],
                         row["track_duration_ms"], row["skipped"], row["context"], row["device"]))
        df = spark.createDataFrame(data, schema)
        return df.withColumn("timestamp", F.to_timestamp("ts")).drop("ts")
    return make
