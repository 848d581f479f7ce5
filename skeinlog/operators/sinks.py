"""Events out: newline-delimited JSON and the stored event table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinlog.functions.instants import iso_text
from skeinlog.functions.variants import as_object, bind, json_path
from skeinlog.operators.predicates import RESERVED


def _envelope_json() -> Column:
    return F.to_json(
        F.struct(
            iso_text(F.col("`@timestamp`")).alias("@timestamp"),
            "message",
            F.struct(
                F.col("event.dataset").alias("dataset"),
                iso_text(F.col("event.created")).alias("created"),
            ).alias("event"),
            "host",
            "agent",
            "log",
            "labels",
            "ecs",
            "tags",
        )
    )


def _body_json() -> Column:
    """The body without reserved keys; only a body that has one is taken apart for that."""
    body = F.col("body")
    taken = [F.try_variant_get(body, json_path([key]), "variant").isNotNull() for key in RESERVED]
    free = F.map_filter(as_object(body), lambda k, _: ~k.isin(*RESERVED))
    return F.when(reduce(Column.__or__, taken), F.to_json(free)).otherwise(F.to_json(body))


def to_ndjson(events: DataFrame) -> DataFrame:
    """Column ``value``: one event as compact JSON, the envelope first, then the body's keys at top
    level. NULL columns are left out; nulls inside the body stay."""
    parts = bind(bind(events, "_envelope", _envelope_json()), "_own", _body_json())
    opened = F.substr("_envelope", F.lit(1), F.length("_envelope") - 1)
    joined = F.concat(opened, F.lit(","), F.substr("_own", F.lit(2)))
    return parts.select(
        F.when(F.length("_own") > 2, joined).otherwise(F.col("_envelope")).alias("value")
    )


def write_ndjson(events: DataFrame, path: str) -> None:
    """Append the events as JSON lines; what is there already stays."""
    to_ndjson(events).write.mode("append").text(path)


def write_event_table(events: DataFrame, path: str, mode: str = "append") -> None:
    """Store events as Parquet by dataset and host, in time order inside each file, so that a
    search prunes directories by dataset and host and row groups by time. Each task writes its
    own rows: no shuffle brings a large host or dataset into one task."""
    dataset, host = F.col("event.dataset").alias("dataset"), F.col("host.name").alias("host_name")
    (
        events.select("*", dataset, host)
        .sortWithinPartitions("dataset", "host_name", "@timestamp")
        .write.mode(mode)
        .partitionBy("dataset", "host_name")
        .parquet(path)
    )


def read_event_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored events, with the dataset and host of the envelope taken from the directories."""
    reader = spark.read.option("mergeSchema", "false")
    fields = reader.parquet(path).schema.fields
    # As text: a name such as 042 or 2024-01-01 would else become a number or a date.
    named = [T.StructField(f.name, T.StringType()) if f.name in ("dataset", "host_name") else f for f in fields]
    stored = spark.read.schema(T.StructType(named)).parquet(path)
    stored = stored.withColumns(
        {
            "event": F.struct(
                F.col("dataset").cast("string").alias("dataset"),
                F.col("event.created").alias("created"),
            ),
            "host": F.struct(F.col("host_name").cast("string").alias("name")),
        }
    )
    return stored.drop("dataset", "host_name")
