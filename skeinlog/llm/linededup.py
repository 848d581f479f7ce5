"""Removing repeated lines, with levelled sorted runs of line hashes.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased. A key of at
least ``MIN_CHARS`` code points that ``MIN_DOCS`` documents or more hold loses all its lines but
those in the document of the largest doc_id among them.

The keys come in batches. A run is a table (key, docs, keeper), bucketed and sorted by key: in how
many documents of its batches the key stood, and the largest of their ids. A new batch is
merge-anti-joined with every run: keys that the run has settled already (enough documents, and no
larger id in the batch) are let go, the rest is written as the batch's own run. When a level has
``FANOUT`` runs they are merged into one run of the next level. All runs have the same buckets, so
neither a merge nor the join's stored side moves its rows again.

Defined results: a null or empty text is one empty line. Rows that share a doc_id are one document when
documents are counted. Rows without doc_id neither count nor lose lines. A text whose lines all go is
empty. Columns named like a result (n_lines, n_dropped) are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.llm.common import packed, part_count, save, scratch, unpacked

MIN_CHARS, MIN_DOCS = 20, 3
BATCHES, FANOUT = 4, 2
# The white space that is stripped, and the letters that are lower-cased.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(lines: Column, min_chars: int = MIN_CHARS) -> Column:
    """A 128-bit hash of each line's key; null for a key that is too short."""
    bare = F.transform(lines, lambda line: F.btrim(line, F.lit(SPACES)))
    # lower() changes A-Z only in pure ASCII, and is much faster there than translate().
    lowered = F.transform(
        bare,
        lambda line: F.when(F.char_length(line) < min_chars, F.lit(None).cast("string"))
        .when(F.octet_length(line) == F.char_length(line), F.lower(line))
        .otherwise(F.translate(line, UPPER, LOWER)),
    )
    return F.transform(lowered, lambda key: F.unhex(F.md5(key.cast("binary"))))


class LineRuns:
    """The state: runs by level, oldest first."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT, min_docs: int = MIN_DOCS):
        self.spark, self.folder, self.fanout, self.min_docs = spark, folder, fanout, min_docs
        self.buckets = part_count(spark)
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"llm_run_{uuid.uuid4().hex}"
        (
            rows.repartition(self.buckets, "key").sortWithinPartitions("key")
            .write.bucketBy(self.buckets, "key").sortBy("key")
            .option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name)
        )
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        rows = self.spark.table(names[0])
        for name in names[1:]:
            rows = rows.unionByName(self.spark.table(name))
        return rows.groupBy("key").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))

    def add(self, batch: DataFrame) -> None:
        """batch: (key, docs, keeper), each key once."""
        for name in [n for level in self.levels for n in level]:
            run = self.spark.table(name).where(F.col("docs") >= self.min_docs)
            run = run.select(F.col("key").alias("old_key"), F.col("keeper").alias("old_keeper"))
            settled = (F.col("key") == F.col("old_key")) & (F.col("keeper") <= F.col("old_keeper"))
            batch = batch.join(run.hint("merge"), settled, "left_anti")
        self._push(0, self._write(batch))

    def _push(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            names, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._write(self._merged(names)))
            for old in names:
                self.spark.sql(f"DROP TABLE {old}")

    def frequent(self) -> DataFrame:
        """(key, keeper) of the keys found in enough documents."""
        names = [n for level in self.levels for n in level]
        return self._merged(names).where(F.col("docs") >= self.min_docs).select("key", "keeper")

    def close(self) -> None:
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES
) -> DataFrame:
    """docs with the text that is left and the columns n_lines and n_dropped."""
    spark = docs.sparkSession
    folder = scratch(spark)
    doc_id = F.col("doc_id").cast("long")
    narrow = docs.where("doc_id is not null").select(doc_id.alias("doc_id"), "text")
    keys = narrow.select(
        "doc_id",
        F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"),
        F.explode(F.array_distinct(line_keys(lines_of(F.col("text")), min_chars))).alias("key"),
    ).where("key is not null")
    staged = keys.groupBy("batch", "key").agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("keeper"))
    staged = save(staged, folder, "staged")
    runs = LineRuns(spark, folder, min_docs=min_docs)
    try:
        for batch in range(batches):
            runs.add(staged.where(F.col("batch") == batch).select("key", "docs", "keeper"))
        frequent = save(runs.frequent(), folder, "frequent")
    finally:
        runs.close()

    version = F.xxhash64("text").alias("version")  # rows of one id can have different texts
    placed = narrow.select(
        "doc_id", version, F.posexplode(line_keys(lines_of(F.col("text")), min_chars)).alias("place", "key")
    ).where("key is not null")
    gone = placed.join(frequent, "key").where("doc_id <> keeper").groupBy("doc_id", "version").agg(
        F.sort_array(F.collect_set("place")).alias("gone")
    )
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.col("gone").alias("_gone"))
    named = packed(docs, doc_id.alias("doc_id"), "text").withColumn("_own", F.xxhash64("text"))
    joined = named.join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("_own") == F.col("_version")), "left")
    lines = lines_of(F.col("text"))
    # The lines between two that go, one slice after another: linear in the number of lines.
    edges = F.concat(F.array(F.lit(-1)), F.col("_gone"), F.array(F.size(lines)))
    pieces = F.transform(
        F.sequence(F.lit(1), F.size("_gone") + 1),
        lambda i: F.slice(F.col("_lines"), F.get("_edges", i - 1) + 2, F.get("_edges", i) - F.get("_edges", i - 1) - 1),
    )
    joined = joined.withColumns({"_lines": F.when(F.col("_gone").isNotNull(), lines), "_edges": edges})
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(pieces), "\n"))
    found = {"text": text, "n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return unpacked(joined, [*names, "n_lines", "n_dropped"], **found)
