"""Lines to records.

Records keep the order columns of their first line: ``host, path, blk, mid, value``.

Multi-line records are joined where the lines already lie side by side, in the task that reads
the split. That takes no shuffle of the log text; only the first and last record of a split can
continue in its neighbour, and only those few rows are brought together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.functions.patterns import java_regex
from skeinlog.functions.variants import parse_objects
from skeinlog.plans.profile import Framing

RECORD_COLUMNS = ("host", "path", "blk", "mid", "value")
_ORDER = ("blk", "mid")
_PIECES = (
    "host string, path string, blk bigint, mid bigint, whole boolean, value string, "
    "is_first boolean, is_last boolean, joins_back boolean, joins_on boolean"
)


def frame_plain(lines: DataFrame) -> DataFrame:
    """One record per line, blank lines included."""
    return lines.select(*RECORD_COLUMNS)


def frame_json(lines: DataFrame) -> DataFrame:
    """One record per non-blank line with VARIANT column ``body``; a line that is not one JSON
    object keeps its text and has a NULL body."""
    filled = F.col("value").rlike(r"\S")
    return parse_objects(lines.where(filled).select(*RECORD_COLUMNS), "value", "body")


def triggers(value: Column, framing: Framing) -> Column:
    hit = value.rlike(java_regex(framing.pattern).pattern)
    return ~hit if framing.negate else hit


def _join_neighbours(what: str):
    """The per-task step: join adjacent lines of one file split. Works on whole Arrow batches
    and holds back only the record that is still open at the end of a batch."""
    previous = what == "previous"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row: dict | None = None  # first-line columns and flags of the open record
        open_text: list[str] = []
        last_key, last_trigger = None, False

        def emit(rows: list[dict], texts: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r["host"] for r in rows], pa.string()),
                    pa.array([r["path"] for r in rows], pa.string()),
                    pa.array([r["blk"] for r in rows], pa.int64()),
                    pa.array([r["mid"] for r in rows], pa.int64()),
                    pa.array([r["whole"] for r in rows], pa.bool_()),
                    texts,
                    *[
                        pa.array([r[k] for r in rows], pa.bool_())
                        for k in ("is_first", "is_last", "joins_back", "joins_on")
                    ],
                ],
                names=_NAMES,
            )

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            host, path, blk = (batch.column(k) for k in ("host", "path", "blk"))
            trigger = batch.column("trigger").to_numpy(zero_copy_only=False)
            # A chunk is one file split: a run of rows with the same host, path and blk.
            new_chunk = np.zeros(n, dtype=bool)
            for column in (host, path, blk):
                same = pc.equal(column.slice(1), column.slice(0, n - 1))
                new_chunk[1:] |= ~pc.fill_null(same, True).to_numpy(zero_copy_only=False)
            first_key = (host[0].as_py(), path[0].as_py(), blk[0].as_py())
            new_chunk[0] = first_key != last_key
            before = np.concatenate(([last_trigger], trigger[:-1]))
            # previous: a line without a trigger opens a record; next: so does the line after one.
            opens = ~trigger if previous else ~before
            starts = np.flatnonzero(new_chunk | opens)

            values = batch.column("value")
            head = int(starts[0]) if len(starts) else n
            if head:  # these lines belong to the record left open by the batch before
                open_text.extend(values.slice(0, head).to_pylist())
            if len(starts):
                if open_row is not None:
                    at = int(starts[0])
                    open_row["is_last"] = bool(new_chunk[at])
                    open_row["joins_on"] = open_row["is_last"] and (previous or bool(before[at]))
                    yield emit([open_row], pa.array(["\n".join(open_text)], pa.string()))
                closed = len(starts) - 1
                ends_chunk = new_chunk[starts[1:]]
                joins_on = ends_chunk & (True if previous else before[starts[1:]])
                is_first = new_chunk[starts]
                joins_back = is_first & (trigger[starts] if previous else True)
                if closed:
                    first = pa.array(starts[:-1])
                    offsets = pa.array(starts.astype(np.int32))
                    body = values.slice(0, int(starts[-1]))
                    joined = pc.binary_join(pa.ListArray.from_arrays(offsets, body), "\n")
                    yield pa.RecordBatch.from_arrays(
                        [
                            host.take(first),
                            path.take(first),
                            blk.take(first),
                            batch.column("mid").take(first),
                            batch.column("whole").take(first),
                            joined,
                            pa.array(is_first[:-1]),
                            pa.array(ends_chunk),
                            pa.array(joins_back[:-1]),
                            pa.array(joins_on),
                        ],
                        names=_NAMES,
                    )
                at = int(starts[-1])
                open_row = {k: batch.column(k)[at].as_py() for k in _CARRIED}
                open_row["is_first"] = bool(is_first[-1])
                open_row["joins_back"] = bool(joins_back[-1])
                open_text = values.slice(at).to_pylist()
            last_key = (host[n - 1].as_py(), path[n - 1].as_py(), blk[n - 1].as_py())
            last_trigger = bool(trigger[-1])
        if open_row is not None:
            open_row["is_last"] = True
            open_row["joins_on"] = previous or last_trigger
            yield emit([open_row], pa.array(["\n".join(open_text)], pa.string()))

    return step


_NAMES = [part.split()[0] for part in _PIECES.split(", ")]
_CARRIED = ("host", "path", "blk", "mid", "whole")


def local_records(lines: DataFrame, framing: Framing) -> DataFrame:
    """Records of each split by itself. ``joins_back`` marks a first record that may continue
    the split before, ``joins_on`` a last record that may continue in the split behind."""
    marked = lines.select(
        *RECORD_COLUMNS, "whole", F.coalesce(triggers(F.col("value"), framing), F.lit(False)).alias("trigger")
    )
    return marked.mapInArrow(_join_neighbours(framing.what), _PIECES)


def frame_multiline(lines: DataFrame, framing: Framing, scan_order: bool = True) -> DataFrame:
    """Join lines into records.

    ``scan_order`` says that the lines still come as the scan delivered them; lines that went
    through a shuffle are first brought back together by split.
    """
    if not scan_order:
        lines = lines.repartition("host", "path", "blk").sortWithinPartitions("host", "path", *_ORDER)
    # A split that is a whole file is finished locally, so its lines leave the second pass before
    # they reach the join step.
    border = F.col("is_first") | F.col("is_last")
    done = local_records(lines, framing).where(F.col("whole") | ~border)
    open_ended = local_records(lines.where(~F.col("whole")), framing).where(border)
    return done.select(*RECORD_COLUMNS).unionByName(stitch(open_ended))


def stitch(pieces: DataFrame) -> DataFrame:
    """Join the border records of neighbouring splits; a record may run over many splits."""
    in_file = Window.partitionBy("host", "path").orderBy(*_ORDER)
    continues = F.col("joins_back") & F.coalesce(F.lag("joins_on").over(in_file), F.lit(False))
    numbered = pieces.withColumn("_opens", F.when(continues, 0).otherwise(1)).withColumn(
        "_record", F.sum("_opens").over(in_file)
    )
    ordered = F.array_sort(F.collect_list(F.struct(*_ORDER, "value")))
    return (
        numbered.groupBy("host", "path", "_record")
        .agg(ordered.alias("_parts"))
        .select(
            "host",
            "path",
            F.col("_parts")[0]["blk"].alias("blk"),
            F.col("_parts")[0]["mid"].alias("mid"),
            F.array_join("_parts.value", "\n").alias("value"),
        )
    )


def frame(lines: DataFrame, framing: Framing, scan_order: bool = True) -> DataFrame:
    """Records of one input, with the columns of ``RECORD_COLUMNS``."""
    if framing.codec == "json":
        return frame_json(lines)
    if framing.codec == "multiline":
        return frame_multiline(lines, framing, scan_order)
    return frame_plain(lines)
