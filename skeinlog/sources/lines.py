"""Log files as ordered lines.

A lines table has the columns ``host, path, blk, mid, value, whole``: ``blk`` is the start of the
file split the line was read from, ``mid`` rises along the lines of a split, and
``(path, blk, mid)`` is the order of the lines of a file. ``whole`` says that the split is the
entire file. ``host`` and ``path`` together name a file.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinlog.functions.patterns import path_glob, uri_globs, value_glob
from skeinlog.plans.profile import LogInput, Profile

LINE_COLUMNS = ("host", "path", "blk", "mid", "value", "whole")


def host_paths(root: str, hosts: tuple[str, ...]) -> str:
    """One glob over the directories of the hosts; a missing directory is not an error there."""
    return f"{root.rstrip('/')}/{{{','.join(hosts)}}}"


def root_tail(root: str) -> str:
    """The root as it is spelled inside a file URI, without scheme."""
    tail = root.rstrip("/").split("://")[-1]
    return quote(tail.removeprefix("file:"), safe="/:@+,=~!$&()*;'")


def _below_root(uri: Column, root: str) -> Column:
    tail = root_tail(root) + "/"
    return F.substr(uri, F.locate(tail, uri) + F.lit(len(tail)))


def file_host(uri: Column, root: str) -> Column:
    """The directory right below the root names the host."""
    return F.substring_index(_below_root(uri, root), "/", 1)


def file_path(uri: Column, root: str) -> Column:
    """The absolute path of the file on its host. Only names with escapes are decoded."""
    path = F.substr(_below_root(uri, root), F.length(file_host(uri, root)) + F.lit(1))
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(path, F.lit("%")), decoded).otherwise(path)


def absolute(pattern: str, base_dir: str) -> str:
    """A path or glob of an input as an absolute one; one that is absolute already stays."""
    if pattern.startswith("/"):
        return pattern
    base = "" if base_dir in ("", ".") else base_dir.strip("/")
    return "/" + (f"{base}/{pattern}" if base else pattern)


def relative(path: Column, base_dir: str) -> Column:
    """The path below the base directory; exclude globs are matched against it."""
    base = absolute("", base_dir).rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def listed_as(path: Column, inp: LogInput, base_dir: str) -> Column:
    """The name under which the input lists a file, NULL if the file is not one of its files.
    Include globs are shell globs, exclude globs let ``*`` cross ``/``. A file is named relative
    to the base directory, or absolutely if the glob is absolute."""
    names = []
    for glob in inp.path:
        shown = path if glob.startswith("/") else relative(path, base_dir)
        hit = path.rlike(path_glob(absolute(glob, base_dir)))
        for exclude in inp.exclude:
            hit = hit & ~shown.rlike(value_glob(exclude))
        names.append(F.when(hit, shown))
    return F.coalesce(*names, F.lit(None).cast("string"))


def in_scope(uri: Column, root: str, inp: LogInput, base_dir: str) -> Column:
    """The same test on the URI of a scanned file, as few regular expressions as possible: it
    prunes files while Spark lists them, and is evaluated on every line afterwards."""
    if inp.exclude:
        return listed_as(file_path(uri, root), inp, base_dir).isNotNull()
    return uri.rlike(uri_globs([absolute(g, base_dir) for g in inp.path], root_tail(root)))


def raw_files(spark: SparkSession, root: str, profile: Profile, delimiter: str = "\n") -> DataFrame:
    """The text scan over the scoped hosts; nothing is read before an action."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("lineSep", delimiter)
        .option("ignoreMissingFiles", "true")
        .text(host_paths(root, profile.hosts))
    )


def input_lines(
    raw: DataFrame, root: str, profile: Profile, inp: LogInput, file_filter=None
) -> DataFrame:
    """The lines of one input. Every condition on the file stands in front of the line numbers
    and uses only the file's own metadata, so Spark drops whole files while it lists them.
    ``file_filter(host, path)`` may add a condition."""
    uri = F.col("_metadata.file_path")
    host, path = file_host(uri, root), file_path(uri, root)
    keep = in_scope(uri, root, inp, profile.base_dir)
    if file_filter is not None:
        keep = keep & file_filter(host, path)
    return raw.where(keep).select(
        host.alias("host"),
        path.alias("path"),
        F.col("_metadata.file_block_start").alias("blk"),
        F.monotonically_increasing_id().alias("mid"),
        "value",
        (F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")).alias("whole"),
    )


def table_lines(df: DataFrame, host, path, text, delimiter: str = "\n") -> DataFrame:
    """The lines of a table that holds one whole file per row."""
    pieces = df.select(
        host.alias("host"),
        path.alias("path"),
        F.posexplode(F.split(text, "\\Q" + delimiter + "\\E")).alias("at", "value"),
    )
    return pieces.select(
        "host",
        "path",
        F.lit(0).cast("long").alias("blk"),
        F.col("at").cast("long").alias("mid"),
        "value",
        F.lit(True).alias("whole"),
    )


def last_lines(lines: DataFrame, n: int) -> DataFrame:
    """The last ``n`` lines of every file of a lines table. Spark cuts each task's rows to ``n``
    per file before the shuffle, so a huge file costs no more than a small one there."""
    newest = Window.partitionBy("host", "path").orderBy(F.desc("blk"), F.desc("mid"))
    return lines.withColumn("_rank", F.row_number().over(newest)).where(f"_rank <= {int(n)}").drop("_rank")
