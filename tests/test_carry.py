import random

import pytest
from pyspark.sql import functions as F

from skeinlog.operators.carry import carry_forward
from skeinlog.operators.demux import demux

LINES = "host string, path string, blk long, mid long, value string"


def plain(rows):
    out, files = [], {}
    for r in rows:
        files.setdefault(r[:2], []).append(r)
    for lines in files.values():
        current = None
        for r, following in zip(lines, [*lines[1:], None]):
            mark = r[4] if r[4].startswith("#") else None
            current = mark or current
            out.append((*r, mark, current, following is not None and following[4].startswith("#")))
    return sorted(map(str, out))


@pytest.mark.parametrize("split", [1, 2, 7, 1000])
def test_marks_over_splits_and_batches(spark, split):
    rng = random.Random(split)
    rows = []
    for path in ("a", "b", "c"):
        n = rng.choice([1, 40, 90])
        rows += [("h", path, i // split, i, f"#{i}" if rng.random() < 0.15 else "x") for i in range(n)]
    lines = spark.createDataFrame(rows, LINES).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = carry_forward(lines, F.when(F.col("value").startswith("#"), F.col("value"))).select(
                "host", "path", "blk", "mid", "value", "_mark", "_current", "_next_marked"
            )
            assert sorted(str(tuple(r)) for r in got.collect()) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_an_empty_table_and_the_plan(spark):
    none = spark.createDataFrame([], LINES)
    assert demux(none, ["/a"]).count() == 0
    plan = demux(spark.createDataFrame([("h", "p", 0, 0, "x")], LINES), ["/a"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("BroadcastExchange") == 1
