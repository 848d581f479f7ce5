"""Sharding with sampled splitters: records in key order, cut into shards of nearly equal bytes.

The key is (hash of the text, doc_id, row mark), so equal texts lie side by side. They share a shard,
or neighbouring ones where a group of copies is larger than a shard. Keys are sampled with a chance
in proportion to their size; quantiles of the sample are the splitters of many small ranges. A range
that turns out to hold more than ``OVERFULL`` times the mean of rows gets splitters of its own from
a new sample inside it. Each range is sorted in its task, and the sums of the ranges before it place
its records in the whole order. A group of equal texts goes to the shard in which its middle byte lies,
and so does each record of a group that is larger than a shard; so no shard is off by more than half
a group at each end. Groups that go over the border of ranges are put together from one row for each
range.

Bounds: ``MAX_RANGES`` ranges and ``PER_RANGE`` sampled keys for each of them (on average); only
samples and the ranges' sums reach the driver.

Defined results: a null text has no bytes; a row's size is its bytes and ``ROW_BYTES``. Rows without
doc_id come first among equal texts. Repeated rows keep a place each. Columns of the input other than
doc_id and text are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinlog.llm.common import arrow_step, part_count, save, scratch

SHARDS, ROW_BYTES = 24, 8
PER_RANGE, MAX_RANGES, ROWS_PER_RANGE = 32, 20_000, 500_000
OVERFULL, ROUNDS = 4, 4
KEY = ["text_hash", "id_key", "mark"]


def packed(hashes: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Three signed 64-bit parts as one byte string that sorts the same way."""
    parts = np.stack([hashes, ids, marks], axis=1).astype(np.int64)
    return np.ascontiguousarray((parts.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")).view("S24").ravel()


def _sampled(rows: DataFrame, chance) -> np.ndarray:
    """Keys drawn with the given chance; the draw depends on the row alone, not on the task."""
    draw = F.pmod(F.xxhash64(*KEY, F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    found = rows.where(draw < chance).select(*KEY).toPandas()
    return np.sort(packed(*(found[c].to_numpy(np.int64) for c in KEY)))


def _quantiles(keys: np.ndarray, parts: int) -> np.ndarray:
    return keys[(np.arange(1, parts) * len(keys)) // parts] if len(keys) else keys


def _in_ranges(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(splitters)  # at most MAX_RANGES keys and the subdivisions
    names = rows.columns
    schema = T.StructType(rows.schema.fields + [T.StructField("range", T.IntegerType())])

    def step(batches):
        for batch in batches:
            keys = packed(*(batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in KEY))
            yield {
                **{n: batch.column(i) for i, n in enumerate(names)},
                "range": np.searchsorted(shared.value, keys, side="right").astype(np.int32),
            }

    return arrow_step(rows, step, schema)


def _range_sums(rows: DataFrame):
    return rows.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).orderBy("range").toPandas()


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row of docs once."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    rows = save(
        docs.select(
            doc_id.alias("doc_id"),
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),
            F.coalesce(doc_id, F.lit(-(1 << 63))).alias("id_key"),
            F.monotonically_increasing_id().alias("mark"),  # fixed from here on, as it is written
        ),
        folder,
        "rows",
    )
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    if not total.n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = min(MAX_RANGES, max(4 * shards, 2 * part_count(spark), total.n // ROWS_PER_RANGE))
    chance = F.col("size") * F.lit(ranges * PER_RANGE / total.bytes)
    splitters = np.unique(_quantiles(_sampled(rows, chance), ranges))
    for _ in range(ROUNDS):
        ranged = _in_ranges(rows, splitters)
        sums = _range_sums(ranged)
        full = sums[sums.n > max(OVERFULL * total.n / ranges, PER_RANGE)]
        if not len(full):
            break
        chances = spark.createDataFrame(
            [(int(r), float(OVERFULL * ranges * PER_RANGE / total.n)) for r in full.range], "range int, chance double"
        )
        drawn = _sampled(ranged.join(F.broadcast(chances), "range"), F.col("chance"))
        inside = np.searchsorted(splitters, drawn, side="right")
        parts = [_quantiles(drawn[inside == r], int(n * 2 * ranges // total.n) + 1) for r, n in zip(full.range, full.n)]
        splitters = np.unique(np.concatenate([splitters, *parts]))
    ranged = _in_ranges(rows, splitters)
    order = Window.partitionBy("range").orderBy(*KEY)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("range", "text_hash")
    sorted_rows = ranged.select(
        "doc_id", "size", "text_crc32", "range", "text_hash",
        F.row_number().over(order).alias("place"), (F.sum("size").over(upto) - F.col("size")).alias("before"),
    ).withColumns({"group_before": F.min("before").over(group), "group_bytes": F.sum("size").over(group)})
    sorted_rows = save(sorted_rows, folder, "sorted")

    offsets, wholes = _order_of(sorted_rows)
    placed = sorted_rows.join(F.broadcast(offsets), "range").join(F.broadcast(wholes), ["range", "text_hash"], "left")
    begin = F.coalesce("whole_start", F.col("start") + F.col("group_before")).cast("double")
    held = F.coalesce("whole_bytes", "group_bytes")
    own = (F.col("start") + F.col("before")).cast("double") + F.col("size") / 2
    middle = F.when(held * shards <= F.lit(total.bytes), begin + held / 2).otherwise(own)
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / float(total.bytes))).cast("int"))
    # A shard's part of a range: at most one row for each range and each shard's edge.
    parts = placed.groupBy("range", "shard").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    parts = parts.orderBy("range", "shard").toPandas()
    base = parts.groupby("shard").n.cumsum() - parts.n - parts["first"]
    slots = spark.createDataFrame(
        [(int(r), int(s), int(b)) for r, s, b in zip(parts.range, parts["shard"], base)], "range int, shard int, base long"
    )
    found = placed.join(F.broadcast(slots), ["range", "shard"])
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("place")).alias("slot"))


def _order_of(sorted_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(range, start): the bytes before each range; and (range, text_hash, whole_start, whole_bytes) of the
    groups that lie in several ranges. Both have a row or two for each range."""
    spark = sorted_rows.sparkSession
    edge = F.struct("text_hash", "group_bytes")
    sums = sorted_rows.groupBy("range").agg(
        F.sum("size").alias("bytes"), F.min(edge).alias("first"), F.max(edge).alias("last"),
    ).orderBy("range").collect()
    starts, pieces, at = [], {}, 0
    for row in sums:
        starts.append((row.range, at))
        for hash_, held in {(row.first.text_hash, row.first.group_bytes), (row["last"].text_hash, row["last"].group_bytes)}:
            begin = at if hash_ == row.first.text_hash else at + row.bytes - held
            pieces.setdefault(hash_, []).append((row.range, begin, held))
        at += row.bytes
    wholes = [
        (range_, hash_, min(b for _, b, _ in parts), sum(n for _, _, n in parts))
        for hash_, parts in pieces.items() if len(parts) > 1 for range_, _, _ in parts
    ]
    return (
        spark.createDataFrame(starts, "range int, start long"),
        spark.createDataFrame(wholes, "range int, text_hash long, whole_start long, whole_bytes long"),
    )
