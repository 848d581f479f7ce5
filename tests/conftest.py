import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F

from skeinlog.operators.framing import frame_json
from skeinlog.session import local_session

LINES = "host string, path string, blk long, mid long, value string, whole boolean"


@pytest.fixture(scope="session")
def spark():
    # Small splits, so that files of a few kilobytes are read by several tasks.
    return local_session(
        4, **{"spark.sql.files.maxPartitionBytes": "8192", "spark.sql.files.openCostInBytes": "1"}
    )


@pytest.fixture
def lines_of(spark):
    def make(values, host="h1", path="/logs/a.log"):
        rows = [(host, path, 0, i, v, True) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, LINES).coalesce(1)

    return make


@pytest.fixture
def bodies(lines_of):
    """JSON objects as a frame with columns mid and body."""
    return lambda objects: frame_json(
        lines_of([o if isinstance(o, str) else json.dumps(o) for o in objects])
    )


@pytest.fixture
def log_root(tmp_path):
    """A root folder and a function that appends text to a host's file."""
    root = tmp_path / "root"

    def put(host, path, text):
        file = root / host / path.lstrip("/")
        file.parent.mkdir(parents=True, exist_ok=True)
        with open(file, "a", encoding="utf-8") as out:
            out.write(text)

    return str(root), put


def messages(events):
    return sorted(r.message for r in events.select("message").collect())


def first_column(df):
    return [r[0] for r in df.collect()]


__all__ = ["F", "messages", "first_column"]
