"""Multi-line records of files, read once.

A file is cut into byte ranges. A range has the records whose first line starts in it: its reader
skips the lines of a record that began before, and reads on past its end until its last record is
closed. So every record is made in one task, whatever the cuts, and no line goes through a shuffle.

With a time window a record is decided by its first line; the lines of a record that is let go are
counted past, but neither decoded nor joined.

The files must lie in a store that tasks can seek in. Compressed files and other stores go through
Spark's text scan, see ``operators.framing``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.operators.prefilter import Window
from skeinlog.plans.profile import Framing
from skeinlog.streaming.follow import store_of

RANGE_BYTES = 64 << 20
TASK_BYTES = 16 << 20
MAX_TASKS = 100_000
_RECORDS = "host string, path string, blk bigint, mid bigint, value string"
_BATCH_CHARS = 4 << 20
_BLOCK = 4 << 20
_BEYOND = 16 << 10  # read with a small range, as its last record may be closed there


@dataclass(frozen=True)
class LineRule:
    """Which lines belong together; a picklable form of :class:`Framing`."""

    pattern: str
    negate: bool
    what: str
    delimiter: bytes

    @classmethod
    def of(cls, framing: Framing) -> LineRule:
        return cls(framing.pattern, framing.negate, framing.what, framing.delimiter.encode())

    def triggers(self) -> Callable[[bytes], bool]:
        search, negate = re.compile(self.pattern).search, self.negate
        return lambda line: (search(line.decode("utf-8", "replace")) is None) == negate


def cuttable(framing: Framing) -> bool:
    """Whether line ends can be found from any place: no delimiter may overlap the next one."""
    d = framing.delimiter
    return not any(d.startswith(d[i:]) for i in range(1, len(d)))


def _lines(file, at: int, delimiter: bytes, block: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(first bytes, lines) of the whole lines from byte ``at`` on, block by block; the file's last
    line may lack its end."""
    step, rest, ended = len(delimiter), b"", False
    while not ended:
        pieces, read_from, complete = [rest], at + len(rest), False
        while not complete:  # a line longer than a block is read in pieces that are joined once
            data = file.read_at(block, read_from)
            read_from += len(data)
            ended = len(data) < block
            # A delimiter may lie across two pieces.
            tail = pieces[-1][max(0, len(pieces[-1]) - step + 1) :]
            complete = ended or delimiter in tail + data
            pieces.append(data)
        lines = b"".join(pieces).split(delimiter)
        rest = lines.pop()
        if ended and rest:
            lines.append(rest)
        lengths = np.fromiter(map(len, lines), np.int64, len(lines)) + step
        starts = at + np.cumsum(lengths) - lengths
        at += int(lengths.sum())
        if lines:
            yield starts, lines


def _whole_line(file, at: int, tail: bytes, delimiter: bytes) -> bytes:
    """The line that ends with ``tail``, which begins at byte ``at`` of the file."""
    head, step = b"", 64 << 10
    while at > 0:
        begin = max(0, at - step)
        head = file.read_at(at - begin, begin) + head
        if delimiter in head:
            return head.rsplit(delimiter, 1)[-1] + tail
        at, step = begin, 2 * step
    return head + tail


def read_range(
    file, start: int, end: int, rule: LineRule, keep: Callable[[str], bool] | None = None, block: int = _BLOCK,
    opens: bool = False,
) -> Iterator[tuple[int, str]]:
    """(first byte, text) of the records whose first line starts in the bytes [start, end). ``opens``: the
    line at ``start`` begins a record, whatever it is."""
    triggered, previous = rule.triggers(), rule.what == "previous"
    first, held = 0, None  # the open record: its first byte and, unless it is let go, its lines
    inside = False  # whether a record of this range is open
    joins = False  # whether the line before the one in hand goes on in it
    behind = start == 0  # whether the line that began before the range is passed

    # The line before the range's first line ends at ``start`` or later, so reading begins right there.
    for starts, lines in _lines(file, max(0, start - len(rule.delimiter)), rule.delimiter, block):
        for at, line in zip(starts.tolist(), lines):
            if not behind:
                behind = True
                joins = not previous and triggered(_whole_line(file, at, line, rule.delimiter))
                continue
            hit = triggered(line)
            if at == 0 or (opens and at == start) or not (hit if previous else joins):
                if held is not None:
                    yield first, rule.delimiter.join(held).decode("utf-8", "replace")
                if at >= end:
                    return
                wanted = keep is None or keep(line.decode("utf-8", "replace"))
                first, held, inside = at, [] if wanted else None, True
            elif not inside and at >= end:
                return  # a record of an earlier range goes on beyond this one
            if held is not None:
                held.append(line)
            joins = hit
    if held is not None:
        yield first, rule.delimiter.join(held).decode("utf-8", "replace")


def last_border(file, start: int, end: int, rule: LineRule, step: int = 64 << 10) -> int:
    """The last byte up to ``end`` at which a record begins after others are closed; ``start`` if there is
    none behind it. Only lines that end by ``end`` count. Read from the end on, as far as is needed."""
    triggered, delimiter = rule.triggers(), rule.delimiter
    while True:
        begin = max(start, end - step)
        data = file.read_at(end - begin, begin)
        at = begin
        if begin > start:  # the first line may have begun before
            cut = data.find(delimiter) + len(delimiter)
            at, data = (begin + cut, data[cut:]) if cut >= len(delimiter) else (end, b"")
        lines = data.split(delimiter)[:-1]
        place = at + sum(len(line) + len(delimiter) for line in lines)
        for line in reversed(lines):
            first = place - len(line) - len(delimiter)
            border = (first if rule.what == "previous" else place) if not triggered(line) else start
            if border > start:
                return border
            place = first
        if begin == start:
            return start
        step *= 2


def next_border(file, start: int, end: int, size: int, rule: LineRule) -> int:
    """The first such byte behind ``end``, for a record that is longer than the bytes up to there; ``start``
    if it isn't closed."""
    triggered, begin = rule.triggers(), max(start, end - len(rule.delimiter))
    for starts, lines in _lines(file, begin, rule.delimiter, _BLOCK):
        for at, line in zip(starts.tolist(), lines):
            place = at + len(line) + len(rule.delimiter)
            if place > size:
                return start
            if rule.what == "next" and not triggered(_whole_line(file, at, line, rule.delimiter) if at == begin else line):
                return place
            if rule.what == "previous" and at > begin and not triggered(line):
                return at
    return start


def complete_end(file, start: int, end: int, delimiter: bytes, step: int = 64 << 10) -> int:
    """The end of the last line that ends by ``end``; ``start`` if none does."""
    while True:
        begin = max(start, end - step)
        found = file.read_at(end - begin, begin).rfind(delimiter)
        if found >= 0:
            return begin + found + len(delimiter)
        if begin == start:
            return start
        step *= 2


def seekable(root: str) -> bool:
    """Whether tasks can open files of this store by themselves."""
    try:
        store_of(root)
    except Exception:  # noqa: BLE001 - every store has errors of its own
        return False
    return True


def range_records(
    files: DataFrame, framing: Framing, window: Window | None = None, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """The records of the files of an inventory, with the columns of ``framing.RECORD_COLUMNS``:
    ``blk`` is the start of the range and ``mid`` the first byte of the record."""
    rule = LineRule.of(framing)
    keep = window.may_hold if window is not None else None

    block = min(_BLOCK, range_bytes + _BEYOND)
    run_bytes = range_bytes * max(1, TASK_BYTES // range_bytes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = store_of(row["uri"])
                try:
                    file = store.open_input_file(path)
                except FileNotFoundError:
                    continue  # rotated away since it was listed
                with file:
                    for start in range(row["start"], row["end"], range_bytes):
                        found = read_range(file, start, min(start + range_bytes, row["end"]), rule, keep, block)
                        yield from record_batches(found, row["host"], row["path"], start)

    # A task has a run of neighbouring ranges, one if they are large: small ones don't pay for a task each.
    ends = F.least(F.col("start") + F.lit(run_bytes), F.col("length"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(run_bytes).cast("long")))
    runs = files.where("length > 0").select("host", "path", "uri", "length", starts.alias("start"))
    runs = runs.select("host", "path", "uri", "start", ends.alias("end"))
    # As many tasks as runs: their rows are tiny, so Spark would put all of them into one.
    count = files.agg(F.sum(F.ceil(F.col("length") / F.lit(run_bytes)))).first()[0] or 0
    return runs.repartition(max(1, min(int(count), MAX_TASKS))).mapInArrow(read, _RECORDS)


def record_batches(records: Iterator[tuple[int, str]], host: str, path: str, blk: int) -> Iterator[pa.RecordBatch]:
    places, texts, chars = [], [], 0

    def batch() -> pa.RecordBatch:
        n = len(texts)
        columns = [[host] * n, [path] * n, [blk] * n, places, texts]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES)

    for at, text in records:
        places.append(at)
        texts.append(text)
        chars += len(text)
        if chars >= _BATCH_CHARS:
            yield batch()
            places, texts, chars = [], [], 0
    if texts:
        yield batch()


_NAMES = [part.split()[0] for part in _RECORDS.split(", ")]
