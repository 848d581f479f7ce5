"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import skeinlog

# Settings that decide results, not speed.
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",  # a repeated JSON key: the last one wins
    "spark.sql.ansi.enabled": "true",
}

# Settings for large inputs. A stored event body is shredded into typed Parquet
# columns, so a search on a stored table reads only the fields it names.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.variant.writeShredding.enabled": "true",
    "spark.sql.variant.inferShreddingSchema": "true",
    "spark.sql.variant.pushVariantIntoScan": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Kept where a cluster has its own: how much of a shuffle Spark puts into one task. Events lie packed
# in a shuffle; a task that sorts or compares them takes some thirty times as much.
TASK_CONF = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that already exists. The Python steps of this
    package travel with the job, so executors need no installed copy."""
    cloudpickle.register_pickle_by_value(skeinlog)
    for key, value in {**RESULT_CONF, **SCALE_CONF}.items():
        spark.conf.set(key, value)
    for key, value in TASK_CONF.items():
        spark.conf.set(key, spark.conf.get(key, value))
    return spark


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skeinlog")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
