"""Carry a value forward along the lines of a file, over any number of splits.

A prefix scan in segments: the lines of a split lie side by side in the task that reads it, so each
task carries marks along its own lines. What crosses the border of splits is a summary of each split,
its last mark and whether its first line has one; summaries of neighbours compose in a window over one
small row for each split. The composed summaries are written, so that Spark knows their size: it sends
them to the tasks while they are small, and then no line goes through a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinlog.sources.tables import save, scratch

CHUNK = ["host", "path", "blk"]
_ADDED = "_local string, _next_local boolean"
_SUMMARY = "host string, path string, blk bigint, first_marked boolean, last_mark string"


def chunk_starts(batch: pa.RecordBatch, before: tuple | None) -> np.ndarray:
    """Where rows of another split begin; ``before`` is the split of the row before the batch."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in CHUNK]
    starts = np.zeros(batch.num_rows, bool)
    for column in columns:
        same = pc.equal(column.slice(1), column.slice(0, len(column) - 1))
        starts[1:] |= ~pc.fill_null(same, True).to_numpy(zero_copy_only=False)
    starts[0] = tuple(c[0].as_py() for c in columns) != before
    return starts


def _last_chunk(batch: pa.RecordBatch) -> tuple:
    return tuple(batch.column(batch.schema.get_field_index(c))[batch.num_rows - 1].as_py() for c in CHUNK)


def _carried(marks: pa.Array, starts: np.ndarray, held: str | None) -> pa.Array:
    """The last mark at or before each row of its split; ``held`` is that of the row before the batch."""
    n, rows = len(marks), np.arange(len(marks))
    last = np.maximum.accumulate(np.where(marks.is_valid().to_numpy(zero_copy_only=False), rows, -1))
    begins = np.maximum.accumulate(np.where(starts, rows, -1))
    # Place n stands for the mark that comes from the batch before.
    at = np.where(last >= np.maximum(begins, 0), last, np.where(begins < 0, n, -1))
    both = pa.concat_arrays([marks, pa.array([held], marks.type)])
    return both.take(pa.array(at, mask=at < 0))


def _along(names: list[str]):
    """Add to each line the mark it has inside its split, and whether the next line there has one."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held, waiting = None, None, None  # waiting: the last row, until its successor is known
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = chunk_starts(batch, before)
            marks = batch.column(names.index("_mark"))
            local = _carried(marks, starts, held)
            valid = marks.is_valid().to_numpy(zero_copy_only=False)
            following = pa.array(valid[1:], pa.bool_(), mask=starts[1:])
            rows = pa.RecordBatch.from_arrays([*batch.columns, local], names=[*names, "_local"])
            if waiting is not None:
                yield _with_next(waiting, pa.array(valid[:1], pa.bool_(), mask=starts[:1]))
            yield _with_next(rows.slice(0, batch.num_rows - 1), following)
            waiting = rows.slice(batch.num_rows - 1)
            before, held = _last_chunk(batch), local[batch.num_rows - 1].as_py()
        if waiting is not None:
            yield _with_next(waiting, pa.nulls(1, pa.bool_()))

    return step


def _with_next(rows: pa.RecordBatch, following: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, following], names=[*rows.schema.names, "_next_local"])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each split: whether its first line has a mark, and its last mark."""
    open_, names = None, [part.split()[0] for part in _SUMMARY.split(", ")]

    def rows(found: list) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
        columns = zip(*found) if found else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = chunk_starts(batch, open_ and tuple(open_[:3]))
        marks = batch.column(batch.schema.get_field_index("_mark"))
        local, done = _carried(marks, starts, open_ and open_[4]), []
        begins = [*np.flatnonzero(starts).tolist(), batch.num_rows]
        if open_ is not None and begins[0] > 0:
            open_[4] = local[begins[0] - 1].as_py()
        for begin, end in zip(begins, begins[1:]):
            if open_ is not None:
                done.append(open_)
            key = [batch.column(batch.schema.get_field_index(c))[begin].as_py() for c in CHUNK]
            open_ = [*key, marks[begin].is_valid, local[end - 1].as_py()]
        yield rows(done)
    if open_ is not None:
        yield rows([open_])


def carry_forward(lines: DataFrame, mark: Column) -> DataFrame:
    """Add ``_mark``, ``_current`` (the last mark at or before the line, NULL before the first)
    and ``_next_marked`` (whether the following line has a mark). The lines come as a scan delivers
    them: those of a split in one task, in their order."""
    lines = lines.select("*", mark.cast("string").alias("_mark"))
    schema = T.StructType(lines.schema.fields + T.StructType.fromDDL(_ADDED).fields)
    local = lines.mapInArrow(_along(lines.columns), schema)
    in_file = Window.partitionBy("host", "path").orderBy("blk")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    edges = lines.select(*CHUNK, "_mark").mapInArrow(_summaries, _SUMMARY).select(
        *CHUNK,
        F.last("last_mark", ignorenulls=True).over(before).alias("_carried"),
        F.lead("first_marked").over(in_file).alias("_next_chunk"),
    )
    edges = save(edges, scratch(lines.sparkSession))
    return (
        local.join(edges, CHUNK)
        .withColumn("_current", F.coalesce("_local", "_carried"))
        .withColumn("_next_marked", F.coalesce("_next_local", "_next_chunk", F.lit(False)))
        .drop("_local", "_carried", "_next_local", "_next_chunk")
    )
