"""Field discovery over the files of a profile."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.operators.catalog import field_caps
from skeinlog.operators.events import to_events
from skeinlog.operators.framing import RECORD_COLUMNS, frame, local_records
from skeinlog.operators.summary import examples, summarize
from skeinlog.plans.profile import Framing, Profile
from skeinlog.plans.search import read_events
from skeinlog.sources.inventory import assign_inputs, list_files, missing_hosts, reachable
from skeinlog.sources.samples import is_compressed, sample_lines, scanned_sample


@dataclass
class Discovery:
    """``report`` is one row of JSON, ``catalog`` the counts behind it (cached; ``unpersist`` it
    when the report is done), ``missing`` the hosts without files."""

    report: DataFrame
    catalog: DataFrame
    missing: DataFrame


def sampled_records(lines: DataFrame, framing: Framing) -> DataFrame:
    """Records of lines that may begin in the middle of a file. A first multi-line record whose
    beginning was not read is left out, unless it is all there is."""
    if framing.codec != "multiline":
        return frame(lines, framing)
    cut = F.col("is_first") & ~F.col("is_last") & F.col("joins_back") & (F.col("mid") > 0)
    return local_records(lines, framing).where(~cut).select(*RECORD_COLUMNS)


def discover_fields(
    spark: SparkSession,
    root: str,
    profile: Profile,
    type_: str | None = None,
    hosts: Any = None,
    sample: int | None = 500,
    max_depth: int | None = None,
    collected: datetime | None = None,
) -> Discovery:
    """Which fields the events have. ``sample`` is the number of last lines per file; None reads
    everything. Hosts with files count as sampled even if they gave no event."""
    scoped, problems = reachable(spark, root, profile.scope(type_, hosts))
    collected = collected or datetime.now(timezone.utc)
    files = list_files(spark, root, scoped)
    if sample is None:
        events = read_events(spark, root, scoped, collected)
    else:
        assigned = assign_inputs(files, scoped)
        parts = []
        for inp in scoped.inputs:
            plain = assigned.where((F.col("type") == inp.type) & ~is_compressed(spark, F.col("path")))
            for lines in (sample_lines(plain, sample), scanned_sample(spark, root, scoped, inp, sample)):
                parts.append(to_events(sampled_records(lines, inp.framing), scoped, inp, collected))
        events = reduce(DataFrame.unionByName, parts)
    # A few rows for each field, read by every part of the report; without this each part would
    # read and parse the logs again.
    catalog = summarize(events, max_depth).persist()
    reached = files.select("host").distinct()
    report = field_caps(catalog, examples(catalog), reached)
    return Discovery(report, catalog, missing_hosts(files, scoped, problems))
