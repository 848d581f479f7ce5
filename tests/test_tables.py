"""How much of a table a task gets, and what a shuffle puts into one."""

from pyspark.sql import functions as F

from skeinlog.session import prepare
from skeinlog.sources import tables


def test_a_task_has_no_more_of_a_larger_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    for n in (1000, 5000):
        spark.range(n).coalesce(1).write.parquet(f"{tmp_path}/{n}/t.parquet")
        found = tables.read(spark, f"{tmp_path}/{n}", "t")
        sizes = [r.n for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == n and max(sizes) <= 110
        assert found.agg(F.sum("id")).first()[0] == n * (n - 1) // 2


def test_long_texts_are_spread_by_their_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "TASK_BYTES", 2000)
    rows = spark.range(40).select(F.sha2(F.col("id").cast("string"), 512).alias("text"), F.lit(None).cast("string").alias("k"))
    rows.union(rows).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    found = tables.read(spark, str(tmp_path), "t")
    assert found.rdd.getNumPartitions() > 4 and found.count() == 80


def test_an_empty_table(spark, tmp_path):
    spark.range(0).write.parquet(f"{tmp_path}/t.parquet")
    assert tables.read(spark, str(tmp_path), "t").collect() == []


def test_a_cluster_keeps_its_own_size_of_a_task(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.unset(key)
    assert prepare(spark).conf.get(key) == "16m"
    spark.conf.set(key, "8m")
    assert prepare(spark).conf.get(key) == "8m"
    spark.conf.unset(key)
