"""Which files exist, which input they belong to, and which hosts are missing."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.plans.profile import LogInput, Profile
from skeinlog.sources.lines import absolute, file_host, file_path, host_paths, in_scope, listed_as


def list_files(spark: SparkSession, root: str, profile: Profile) -> DataFrame:
    """host, path, length, modified and uri of every file of the scoped hosts. The content
    column is not selected, so no file is opened."""
    uri = F.col("path")
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(host_paths(root, profile.hosts))
        .select(
            file_host(uri, root).alias("host"),
            file_path(uri, root).alias("path"),
            "length",
            F.col("modificationTime").alias("modified"),
            uri.alias("uri"),
        )
    )


def input_files(spark: SparkSession, root: str, profile: Profile, inp: LogInput, file_filter=None) -> DataFrame:
    """host, path, length and uri of the files of one input. Only the files' own metadata are read,
    so Spark drops the others while it lists them. ``file_filter(host, path)`` may add a condition."""
    uri = F.col("_metadata.file_path")
    host, path = file_host(uri, root), file_path(uri, root)
    keep = in_scope(uri, root, inp, profile.base_dir)
    if file_filter is not None:
        keep = keep & file_filter(host, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(host_paths(root, profile.hosts))
    return files.where(keep).select(
        host.alias("host"), path.alias("path"), F.col("_metadata.file_size").alias("length"), uri.alias("uri")
    )


def assign_inputs(files: DataFrame, profile: Profile) -> DataFrame:
    """One row per (file, input); a file that two inputs match comes twice."""
    listings = []
    for inp in profile.inputs:
        name = listed_as(F.col("path"), inp, profile.base_dir)
        listings.append(
            F.when(name.isNotNull(), F.struct(F.lit(inp.type).alias("type"), name.alias("listed_as")))
        )
    return files.select("*", F.inline(F.array_compact(F.array(*listings))))


def expected(spark: SparkSession, profile: Profile) -> DataFrame:
    """All (host, type) pairs of the profile."""
    rows = [(h, i.type) for h in profile.hosts for i in profile.inputs]
    return spark.createDataFrame(rows, "host string, type string")


def discover(files: DataFrame, profile: Profile) -> DataFrame:
    """host, type and the sorted files, as paths below the base directory where they are below
    it. A pair without a file keeps its row with an empty list."""
    found = (
        assign_inputs(files, profile)
        .groupBy("host", "type")
        .agg(F.array_sort(F.collect_list("listed_as")).alias("files"))
    )
    pairs = expected(files.sparkSession, profile)
    return pairs.join(found, ["host", "type"], "left").withColumn(
        "files", F.coalesce("files", F.array().cast("array<string>"))
    )


def missing_hosts(files: DataFrame, profile: Profile, problems: dict[str, str] | None = None) -> DataFrame:
    """Hosts of the profile without any file, with a reason; the others are not affected. ``problems`` are
    the reasons of hosts that were not read at all."""
    spark = files.sparkSession
    hosts = spark.createDataFrame([(h,) for h in profile.hosts], "host string")
    seen = files.select("host").distinct()
    none = hosts.join(seen, "host", "left_anti").select(
        "host", F.lit("no directory or no file for this host").alias("reason")
    )
    return none.unionByName(spark.createDataFrame(list((problems or {}).items()), "host string, reason string"))


def listing_problem(spark: SparkSession, uri: str) -> str | None:
    """Why a directory can't be listed, or None. A missing directory is no problem: it has no files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    try:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    except Py4JJavaError as error:
        cause = error.java_exception
        kind = cause.getClass().getSimpleName()
        return None if kind == "FileNotFoundException" else f"{kind}: {cause.getMessage()}"
    return None


def reachable(spark: SparkSession, root: str, profile: Profile) -> tuple[Profile, dict[str, str]]:
    """The profile with the hosts whose directories can be listed, and the reasons of the others. One
    listing for each host's directory and base directory, many at a time."""

    def problem(host: str) -> str | None:
        top = f"{root.rstrip('/')}/{host}"
        return listing_problem(spark, top) or listing_problem(spark, top + absolute("", profile.base_dir).rstrip("/"))

    with ThreadPoolExecutor(16) as pool:
        found = dict(zip(profile.hosts, pool.map(problem, profile.hosts)))
    problems = {host: reason for host, reason in found.items() if reason is not None}
    if problems and len(problems) == len(found):
        raise OSError(f"no host can be read: {problems}")
    return replace(profile, hosts=tuple(h for h in profile.hosts if h not in problems)), problems
