"""Live follow: appended lines to events, merged over hosts and inputs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skeinlog.functions.patterns import path_glob, value_glob
from skeinlog.operators.events import to_events
from skeinlog.operators.framing import frame
from skeinlog.operators.predicates import EventFields, compile_query
from skeinlog.operators.sinks import to_ndjson
from skeinlog.plans.profile import LogInput, Profile
from skeinlog.sources.lines import absolute
from skeinlog.sources.records import cuttable, record_batches
from skeinlog.streaming.follow import follow, store_of

def open_records(spark: SparkSession, root: str, profile: Profile, type_: str, progress: str) -> DataFrame:
    """The multi-line records that are still open where a stopped run has come to, as a records table:
    what a follower flushes when its stream ends."""
    store, base = store_of(f"{progress.rstrip('/')}/{type_}")
    with store.open_input_file(f"{base}/planned") as file:
        files = json.loads(file.read())["files"]
    delimiter = profile.input(type_).framing.delimiter.encode()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = store_of(f"{root.rstrip('/')}/{row['name']}")
                host, _, rest = row["name"].partition("/")
                try:
                    with store.open_input_file(path) as file:
                        data = file.read_at(max(0, file.size() - row["at"]), row["at"])
                except FileNotFoundError:
                    continue
                whole = data[: data.rfind(delimiter)] if delimiter in data else None
                found = [(row["at"], whole.decode("utf-8", "replace"))] if whole is not None else []
                yield from record_batches(iter(found), host, "/" + rest, row["at"])

    rows = spark.createDataFrame(list(files.items()), "name string, at long")
    return rows.mapInArrow(read, "host string, path string, blk long, mid long, value string")


def scopes(inp: LogInput, base_dir: str) -> list[dict]:
    """The files of an input as the source's scopes: the same rule as ``sources.lines.listed_as``."""

    def python(pattern: str) -> str:
        return pattern.replace(r"\z", r"\Z")

    base = absolute("", base_dir).rstrip("/") + "/"
    return [
        {
            "include": python(path_glob(absolute(glob, base_dir))),
            "base": "" if glob.startswith("/") else base,
            "exclude": [python(value_glob(exclude)) for exclude in inp.exclude],
        }
        for glob in inp.path
    ]


def tail_input(
    spark: SparkSession,
    root: str,
    profile: Profile,
    inp: LogInput,
    flush_after_ms: int | None = None,
    progress: str | None = None,
    **options: Any,
) -> DataFrame:
    """The events of one input as they are appended. Only its hosts are listed, and only its files read."""
    framing, rule = inp.framing, None
    if framing.codec == "multiline":
        if not cuttable(framing):
            raise ValueError(f"the delimiter of a followed multi-line input may not overlap itself: {framing.delimiter!r}")
        rule = json.dumps({k: getattr(framing, k) for k in ("pattern", "negate", "what", "delimiter")})
    found = follow(
        spark,
        root,
        hosts=json.dumps(profile.hosts),
        scope=json.dumps(scopes(inp, profile.base_dir)),
        startingPosition=inp.start_position,
        progress=progress and f"{progress.rstrip('/')}/{inp.type}",
        rule=rule,
        flushAfterMs=flush_after_ms,
        **options,
    )
    records = found if rule else frame(found.withColumn("whole", F.lit(False)), framing)
    return to_events(records, profile, inp, F.current_timestamp())


def tail(
    spark: SparkSession,
    root: str,
    profile: Profile,
    type_: str | None = None,
    hosts: Any = None,
    filter_: Any = None,
    flush_after_ms: int | None = None,
    progress: str | None = None,
    **options: Any,
) -> DataFrame:
    """Events of all scoped hosts and inputs in one stream, in no order between files. A filter
    may be given. Rotated and new files are picked up with every batch. ``progress`` is a folder beside
    the checkpoint that bounds the first batch after a restart."""
    scoped = profile.scope(type_, hosts)
    query = compile_query(filter_) if filter_ is not None else None
    parts = [
        tail_input(spark, root, scoped, inp, flush_after_ms, progress, **options) for inp in scoped.inputs
    ]
    events = reduce(DataFrame.unionByName, parts)
    return events.where(query.column(EventFields())) if query is not None else events


def write_stream(
    events: DataFrame, path: str, checkpoint: str, available_now: bool = False, **trigger: Any
) -> StreamingQuery:
    """Append a stream of events as JSON lines. The checkpoint holds the offsets; a run that starts again from it neither loses nor repeats a line."""
    writer = (
        to_ndjson(events)
        .writeStream.format("text")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        trigger = {"availableNow": True}
    return writer.trigger(**trigger).start() if trigger else writer.start()
