"""Search: read the scoped hosts and inputs, filter, order by time, limit."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skeinlog.operators.events import EVENT_ORDER, to_events
from skeinlog.operators.framing import frame
from skeinlog.operators.predicates import EventFields, Query, compile_query
from skeinlog.operators.prefilter import file_condition, line_condition, record_window, text_in_window
from skeinlog.operators.sinks import to_ndjson
from skeinlog.plans.profile import LogInput, Profile
from skeinlog.sources.inventory import assign_inputs, input_files, list_files, missing_hosts, reachable
from skeinlog.sources.lines import input_lines, raw_files
from skeinlog.sources.records import cuttable, range_records, seekable
from skeinlog.sources.samples import is_compressed


def order_events(events: DataFrame) -> DataFrame:
    """Ascending event time; host, file and place in the file decide between equal times.

    A range sort first samples its input, which would read and parse the logs twice. The shuffle
    in front holds the matches, so that both the sampling and the sort read those instead."""
    return events.repartition("host.name", "log.file.path", "_blk", "_mid").orderBy(*EVENT_ORDER)


def search_events(
    events: DataFrame,
    filter_: str | dict[str, Any] | Query,
    limit: int | None = None,
    limit_mode: str = "any",
) -> DataFrame:
    """Matching events in time order. With a limit, mode ``any`` stops each task after that many
    matches and sorts what was found (not the earliest overall); ``earliest`` reads everything
    and keeps the earliest with one small heap per task."""
    query = filter_ if isinstance(filter_, Query) else compile_query(filter_)
    found = events.where(query.column(EventFields()))
    if limit is None:
        return order_events(found)
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise ValueError(f"limit must be a positive whole number, not {limit!r}")
    if limit_mode == "any":
        return found.limit(limit).orderBy(*EVENT_ORDER)
    if limit_mode == "earliest":
        return found.orderBy(*EVENT_ORDER).limit(limit)
    raise ValueError(f"limit_mode is any or earliest, not {limit_mode!r}")


def lines_to_events(
    lines: DataFrame,
    profile: Profile,
    inp: LogInput,
    collected: datetime,
    query: Query | None = None,
    prefilter: bool = True,
    scan_order: bool = True,
) -> DataFrame:
    """Frame and wrap the lines of one input, after the raw-line condition of the query."""
    if query is not None and prefilter:
        condition = line_condition(query, inp, collected)
        if condition is not None:
            lines = lines.where(condition)
    return to_events(frame(lines, inp.framing, scan_order), profile, inp, collected)


def read_events(
    spark: SparkSession,
    root: str,
    profile: Profile,
    collected: datetime | None = None,
    query: Query | None = None,
    prefilter: bool = True,
) -> DataFrame:
    """All events of a scoped profile. One scan definition serves all inputs, so the files are
    listed once; with a query, files and lines that cannot match are dropped before parsing."""
    collected = collected or datetime.now(timezone.utc)
    used = query if prefilter else None
    can_seek = seekable(root)
    scans: dict[str, DataFrame] = {}
    parts = []
    for inp in profile.inputs:
        delimiter = inp.framing.delimiter
        if delimiter not in scans:
            scans[delimiter] = raw_files(spark, root, profile, delimiter)
        keep = file_condition(used, profile, inp) if used is not None else None
        if inp.framing.codec == "multiline" and can_seek and cuttable(inp.framing):
            records = multiline_records(spark, scans[delimiter], root, profile, inp, collected, used, keep)
            parts.append(to_events(records, profile, inp, collected))
        else:
            lines = input_lines(scans[delimiter], root, profile, inp, keep)
            parts.append(lines_to_events(lines, profile, inp, collected, query, prefilter))
    return reduce(DataFrame.unionByName, parts)


def multiline_records(
    spark: SparkSession, raw: DataFrame, root: str, profile: Profile, inp: LogInput, collected: datetime,
    query: Query | None = None, keep=None,
) -> DataFrame:
    """The multi-line records of one input, each file read once; compressed files are decoded by the
    text scan. With a query, records whose first line lies outside its time window are not made."""
    window = record_window(query, inp, collected) if query is not None else None

    def condition(compressed: bool):
        def of(host, path):
            packed = is_compressed(spark, path)
            chosen = packed if compressed else ~packed
            return chosen if keep is None else chosen & keep(host, path)

        return of

    read = range_records(input_files(spark, root, profile, inp, condition(False)), inp.framing, window)
    decoded = frame(input_lines(raw, root, profile, inp, condition(True)), inp.framing)
    if window is not None:
        decoded = decoded.where(text_in_window(F.col("value"), window))
    return read.unionByName(decoded)


@dataclass
class SearchResult:
    """``events`` is lazy. ``matches`` holds the count after an action on ``events``; ``files``
    are the files a run reads and ``missing`` the hosts without files."""

    events: DataFrame
    files: DataFrame
    missing: DataFrame
    matches: Observation

    def ok(self) -> bool:
        return self.missing.isEmpty()


def files_to_read(
    files: DataFrame, profile: Profile, query: Query | None, prefilter: bool = True
) -> DataFrame:
    """The inventory rows a search opens, after pruning by the query."""
    assigned = assign_inputs(files, profile)
    if query is None or not prefilter:
        return assigned
    kept = F.lit(False)
    for inp in profile.inputs:
        condition = file_condition(query, profile, inp)(F.col("host"), F.col("path"))
        kept = kept | ((F.col("type") == inp.type) & condition)
    return assigned.where(kept)


def search(
    spark: SparkSession,
    root: str,
    profile: Profile,
    filter_: str | dict[str, Any],
    type_: str | None = None,
    hosts: Any = None,
    limit: int | None = None,
    limit_mode: str = "any",
    prefilter: bool = True,
    collected: datetime | None = None,
) -> SearchResult:
    """Search the log files below ``root/<host>/``. A bad filter, host or type raises before
    anything is read; hosts without files, or whose directories can't be listed, are reported and the
    others still searched."""
    query = compile_query(filter_)
    scoped, problems = reachable(spark, root, profile.scope(type_, hosts))
    files = list_files(spark, root, scoped)
    events = read_events(spark, root, scoped, collected, query, prefilter)
    matches = Observation("matches")
    found = search_events(events, query, limit, limit_mode)
    return SearchResult(
        found.observe(matches, F.count(F.lit(1)).alias("matches")),
        files_to_read(files, scoped, query, prefilter),
        missing_hosts(files, scoped, problems),
        matches,
    )


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Events that only one of two results has, as JSON text with the side and how often. Empty
    means that a pre-filter changed nothing. Each side is read once, and equal events cancel out
    before the shuffle where they meet in one task."""
    both = to_ndjson(left).withColumn("_n", F.lit(1)).unionByName(
        to_ndjson(right).withColumn("_n", F.lit(-1))
    )
    surplus = both.groupBy("value").agg(F.sum("_n").alias("n")).where("n <> 0")
    side = F.when(F.col("n") > 0, "left").otherwise("right").alias("side")
    return surplus.select("value", side, F.abs("n").alias("n"))


def audit_prefilter(
    spark: SparkSession, root: str, profile: Profile, filter_: Any, collected: datetime | None = None
) -> DataFrame:
    """The differences between a search with and without pre-filters."""
    collected = collected or datetime.now(timezone.utc)
    query = compile_query(filter_)
    runs = [
        read_events(spark, root, profile, collected, query, on).where(query.column(EventFields()))
        for on in (True, False)
    ]
    return differences(*runs)
