"""Tables as log lines: the given Parquet tables in the shapes that log files have."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.functions.variants import bind
from skeinlog.sources.lines import table_lines


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


# A task's share of a table: rows that become lines and events of many times their size, or bytes of long texts.
TASK_ROWS = 1 << 16
TASK_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """Parsing costs far more than reading, and an event takes many times the room of its row. A table
    that comes in fewer splits than there are cores, or than its rows and bytes ask for, is spread, so
    that a task has no more of a larger table than of a small one."""
    files = df.groupBy("_metadata.file_path", "_metadata.file_size").agg(F.count("*").alias("n"))
    n, size = files.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("file_size"), F.lit(0))).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, -(-n // TASK_ROWS), -(-size // TASK_BYTES))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with its host, file and JSON parts as columns."""
    return read(spark, sf_dir, "events").select(
        "*",
        F.concat(F.lit("h"), F.col("user_id") % 4).alias("host"),
        F.concat(F.lit("/logs/"), "event_type", F.lit(".json")).alias("path"),
        F.get_json_object("props", "$.k").alias("k"),
    )


def as_lines(rows: DataFrame, line: Column, order: str) -> DataFrame:
    """A lines table from rows with host and path. The line is made once, like one read from a
    file, and not again in every expression that reads it."""
    return bind(rows, "_line", line).select(
        "host",
        "path",
        F.lit(0).cast("long").alias("blk"),
        F.col(order).cast("long").alias("mid"),
        F.col("_line").alias("value"),
        F.lit(True).alias("whole"),
    )


def event_object() -> Column:
    """One event as a log record: ``props.k`` is a text, as logs often write numbers."""
    return F.struct(
        utc_text(F.col("ts")).alias("timestamp"),
        "event_id",
        F.struct(F.col("user_id").alias("id")).alias("user"),
        "event_type",
        "value",
        F.struct("k").alias("props"),
    )


def event_lines(spark: SparkSession, sf_dir: str, record: Column | None = None) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    return as_lines(rows, F.to_json(record if record is not None else event_object()), "event_id")


def document_lines(spark: SparkSession, sf_dir: str, split_every: int | None = None) -> DataFrame:
    """Every document as a file of text lines; with ``split_every`` as a file in several splits."""
    docs = read(spark, sf_dir, "documents")
    path = F.concat(F.lit("/docs/"), F.col("doc_id"), F.lit(".txt"))
    lines = table_lines(docs, F.col("source"), path, F.col("text"))
    if split_every:
        lines = lines.withColumns(
            {"blk": F.floor(F.col("mid") / split_every).cast("long"), "whole": F.lit(False)}
        )
    return lines


def doc_id(path: str = "path") -> Column:
    return F.regexp_extract(path, r"(\d+)\.txt", 1).cast("long")


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see: below the cluster's checkpoint folder. Only a local
    session without one may use the machine's own temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        name = spark.range(1).select(F.expr("uuid()")).first()[0]
        return f"{base.rstrip('/')}/skeinlog-{name}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return os.path.join(tempfile.mkdtemp(prefix="skeinlog-"), "run")


def save(df: DataFrame, path: str) -> DataFrame:
    """Write a small result that several steps read, so that each doesn't make it anew."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
