"""What the operators of this folder share: tables, scratch tables, Arrow steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder, removed when the session's JVM ends.
    Only a local session that names no such folder gets one on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="skeinlog-llm-")
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def save(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a step's rows to the shared folder and go on from there: a lost executor costs the
    tasks it ran, and later steps know the table's size."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_step(
    df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | T.StructType
) -> DataFrame:
    """mapInArrow for a step that yields one dict of columns per batch. Batches are cut by bytes,
    so that a worker holds a few MB of long texts and their results at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for columns in step(batches):
            arrays = [
                x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type)
                for f, x in zip(arrow, (columns[f.name] for f in arrow))
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


ROW = "_whole_row"


def packed(df: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns an operator reads, beside the rest of the row in one column, so that no other column of
    the row can clash with what the operator adds. Columns given by name are not kept twice."""
    given = {c for c in columns if isinstance(c, str)}
    rest = [c for c in df.columns if c not in given]
    return df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"_{c}") for c in rest]).alias(ROW), *columns)


def unpacked(df: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The rows as they were, with the ``new`` columns in place of the old ones."""
    rest = df.schema[ROW].dataType.names

    def column(name: str) -> Column:
        if name in new:
            return new[name]
        return F.col(f"{ROW}.`_{name}`") if f"_{name}" in rest else F.col(f"`{name}`")

    return df.select(*[column(c).alias(c) for c in names])


def part_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_fold(doc_id: Column) -> Column:
    """The remainder that decides about held-out rows; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0))




class BitFilter:
    """Tells for most values that they are not in a set. Its size follows the set up to ``MOST_BITS``;
    beyond that more values pass, and none of the set is ever missed."""

    LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 20, 1 << 26, 8

    def __init__(self, rows: DataFrame, value: Column):
        """value: a column of hashes (long)."""
        rows = rows.select(value.alias("value"))
        wanted = rows.count() * self.BITS_EACH
        self.bits = min(self.MOST_BITS, max(self.LEAST_BITS, 1 << max(wanted - 1, 1).bit_length()))
        place = F.col("value").bitwiseAND(F.lit(self.bits - 1))
        word = F.shiftright(place, 6).alias("word")
        bit = F.expr(f"shiftleft(1L, cast((value & {self.bits - 1}) & 63 as int))")
        # At most one row for each 64 bits reaches the driver.
        found = rows.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()
        table = np.zeros(self.bits // 64, np.uint64)
        table[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
        self.shared = rows.sparkSession.sparkContext.broadcast(table)

    def holds(self, values: pa.Array) -> pa.Array:
        """Inside a task: which of the values may be in the set."""
        at = values.fill_null(0).to_numpy(zero_copy_only=False) & np.int64(self.bits - 1)
        hit = (self.shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        return pa.array(hit.astype(bool) & values.is_valid().to_numpy(zero_copy_only=False))

    def may_hold(self, value: Column) -> Column:
        return F.arrow_udf(self.holds, "boolean")(value)
