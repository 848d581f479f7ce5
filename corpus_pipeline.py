"""The corpus pipeline: stages that each take (spark, docs, sf_dir) and return documents, the last one
their pieces.

Defined results: an empty table passes every stage; rows without doc_id are neither line-deduplicated
nor anyone's near copy and stay; a null source is a source of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.llm import langid, linededup, mixing, neardup, unigram
from skeinlog.llm.common import ROW, BitFilter, packed, save, scratch, table, unpacked


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, which have no language, go; without a labelled text all others stay."""
    found = langid.identify(packed(docs, "text"), langid.train(docs))
    return unpacked(found.where("lettered"), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; every document stays."""
    kept = linededup.drop_repeated_lines(packed(docs, "doc_id", "text", "n_chars"))
    length = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return unpacked(kept, docs.columns, text=F.col("text"), n_chars=length)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, and every row without doc_id. A row goes by its
    doc_id and its text."""
    key = F.xxhash64("doc_id", "digest")
    found = neardup.near_duplicates(docs).where("doc_id is not null").groupBy("doc_id", "digest")
    found = found.agg(F.max("kept").alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1")
    found = save(found, scratch(spark), "marked")
    own = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), neardup.digest(F.col("text")).alias("digest"))
    # Most rows are not marked, and a filter of the marks lets them stay where they are.
    may_go = BitFilter(found, key).may_hold(key)
    own = own.withColumn("may_go", may_go)
    some = own.where("may_go").drop("may_go").join(found, ["doc_id", "digest"], "left")
    repeated = some.where("stays").dropDuplicates(["doc_id", "digest"])
    others = own.where("not may_go").select(ROW).unionByName(some.where("stays is null").select(ROW))
    return unpacked(others.unionByName(repeated.select(ROW)), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, twice at most; every document stays at least once."""
    return unpacked(mixing.mix(packed(docs, "doc_id", "source", "text")), docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, and whether they decode to its text."""
    model = unigram.Unigram(*unigram.read_model())
    found = unigram.round_trip(docs.select("doc_id", "text", "lang", "source", "n_chars"), model)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return found.select(
        "doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_pieces"), same.alias("round_trip")
    )


STAGES = [
    ("language", language), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("pieces", pieces),
]
ORACLE_SQL = None  # language ID can't be expressed in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark)
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), folder, name)
    return docs
