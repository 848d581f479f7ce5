"""The last lines of files, read from their ends; compressed files have to be read whole."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinlog.plans.profile import LogInput, Profile
from skeinlog.sources.lines import LINE_COLUMNS, input_lines, last_lines, raw_files
from skeinlog.streaming.follow import store_of

_LINES = "host string, path string, blk bigint, mid bigint, value string, whole boolean"
_STEP = 64 << 10


def _last_lines(uri: str, length: int, n: int) -> tuple[list[bytes], int]:
    """The last ``n`` lines and the byte they start at, reading only as far back as needed."""
    store, path = store_of(uri)
    with store.open_input_file(path) as file:
        at, data = length, b""
        while at > 0 and data.count(b"\n", 0, max(len(data) - 1, 0)) < n:
            step = min(_STEP, at)
            at -= step
            data = file.read_at(step, at) + data
    if not data:
        return [], 0
    ended = data[:-1] if data.endswith(b"\n") else data
    lines = ended.split(b"\n")
    kept = lines[-n:]
    start = at + sum(len(line) + 1 for line in lines[: len(lines) - len(kept)])
    return kept, start


def sample_lines(files: DataFrame, n: int) -> DataFrame:
    """A lines table with the last ``n`` lines of every file of an inventory. Each task seeks to
    the end of its files, so a sample of 100 TB of logs reads a few blocks per file."""
    if n < 1:
        raise ValueError("a sample needs at least one line per file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    lines, start = _last_lines(row["uri"], row["length"], n)
                except FileNotFoundError:
                    continue  # rotated away since it was listed
                mids, at = [], start
                for line in lines:
                    mids.append(at)
                    at += len(line) + 1
                count = len(lines)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["host"]] * count, pa.string()),
                        pa.array([row["path"]] * count, pa.string()),
                        pa.array([0] * count, pa.int64()),
                        pa.array(mids, pa.int64()),
                        pa.array([line.decode("utf-8", "replace") for line in lines], pa.string()),
                        pa.array([True] * count, pa.bool_()),
                    ],
                    names=["host", "path", "blk", "mid", "value", "whole"],
                )

    return files.select("host", "path", "uri", F.col("length").cast("long")).mapInArrow(read, _LINES)


def is_compressed(spark: SparkSession, path: Column) -> Column:
    """Whether the text scan decodes a file of this name."""
    jvm, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    found = jvm.io.compress.CompressionCodecFactory.getCodecClasses(conf)
    suffixes = [jvm.util.ReflectionUtils.newInstance(c, conf).getDefaultExtension() for c in found]
    tests = [path.endswith(s) for s in suffixes if s]
    return F.exists(F.array(*tests), lambda x: x) if tests else F.lit(False)


def scanned_sample(spark: SparkSession, root: str, profile: Profile, inp: LogInput, n: int) -> DataFrame:
    """A lines table with the last ``n`` lines of every compressed file of an input; ``mid`` is 0 only
    for a file's first line."""
    raw = raw_files(spark, root, profile, inp.framing.delimiter)
    lines = input_lines(raw, root, profile, inp, lambda _, path: is_compressed(spark, path))
    # One line more tells whether the file has lines before the sample.
    file = Window.partitionBy("host", "path")
    ranked = last_lines(lines, n + 1).select(
        "host", "path", "value", F.count("*").over(file).alias("held"),
        F.row_number().over(file.orderBy("blk", "mid")).cast("long").alias("at"),
    )
    kept = ranked.where((F.col("held") <= n) | (F.col("at") > 1)).select(
        "host", "path", F.lit(0).cast("long").alias("blk"), (F.col("at") - 1).alias("mid"), "value",
        F.lit(True).alias("whole"),
    )
    return kept.sortWithinPartitions("host", "path", "mid").select(*LINE_COLUMNS)
