"""Some registered queries beside their SQL on the smallest tables (all: check_queries.py)."""

import os
import re

import pytest

import __spark_entry__ as entry
from tests.check_queries import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = (
    "search_flagship", "search_bool_mix", "search_flat_dotted", "search_exists", "search_limit_any",
    "frame_json", "frame_multiline_over_splits", "frame_multiline_next_over_splits",
    "demux_capture", "window_text_lines", "tags_parse_failure", "event_time_auto",
    "sample_last_lines", "inventory", "prune_files", "event_table_search",
)


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, db, name):
    assert compare(spark, db, name, SF).startswith("ok ")


def test_every_query_has_sql_and_entry_runs(spark):
    own = {n for n in entry.queries() if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert own <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["event_id", "host_name", "event_time"]
