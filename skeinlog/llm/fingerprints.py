"""Document fingerprints by winnowing.

Every run of ``k`` code points has a rolling hash; of each window of ``w`` neighbouring runs the
smallest hash is kept, the rightmost of equal ones, together with its position. Any passage of at
least ``w + k - 1`` code points that two texts share leaves at least one common mark in both. With
the fixed ``RUN`` and ``WINDOW`` these are 15, so a text of 29 code points or more always shares a mark
with its half-edited copy; a shorter one need not.

Defined results: a null text counts as empty; an empty text has no marks; a text of fewer than
``k`` code points has one mark, the hash of the whole text at position 0; with fewer than ``w``
runs there is one window. Likeness is the Jaccard index of the two sets of mark hashes, 1 for two
empty sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinlog.llm.common import arrow_step, part_count

RUN, WINDOW = 8, 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_BLOCK = 1 << 19  # windows hashed at once: bounds the memory for a very long text


def run_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k code points, by joining hashes of shorter runs."""
    piece, length = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1
    piece ^= piece >> np.uint64(32)
    done, covered = None, 0
    while True:
        if k & length:
            if done is None:
                done, covered = piece, length
            else:
                n = len(codes) - covered - length + 1
                done = done[:n] * _power(length) + piece[covered : covered + n]
                covered += length
        if covered == k:
            break
        n = len(piece) - length
        piece, length = piece[:n] * _power(length) + piece[length : length + n], length * 2
    done = done ^ (done >> np.uint64(29))
    done = done * np.uint64(0xBF58476D1CE4E5B9)
    return done ^ (done >> np.uint64(32))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each window of w values, by doubling."""
    w = min(w, len(values))
    span = 1
    while span * 2 <= w:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = w - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def winnow(text: str | None, k: int = RUN, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the marks, by position."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(codes)
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    if n < k:
        return (run_hashes(codes, n) & _LOW).astype(np.uint32), np.zeros(1, np.int64)
    runs = n - k + 1
    windows = max(1, runs - w + 1)
    hashes, positions = [], []
    for begin in range(0, windows, _BLOCK):
        count = min(_BLOCK, windows - begin)
        part = run_hashes(codes[begin : begin + count + w + k - 2], k)
        # Hash above, position from the right below: the minimum is the rightmost of equal hashes.
        keyed = (part << np.uint64(32)) | (_LOW - np.arange(len(part), dtype=np.uint64))
        least = window_minima(keyed, w)
        least = least[np.concatenate(([True], least[1:] != least[:-1]))]
        hashes.append((least >> np.uint64(32)).astype(np.uint32))
        positions.append((_LOW - (least & _LOW)).astype(np.int64) + begin)
    hashes, positions = np.concatenate(hashes), np.concatenate(positions)
    fresh = np.concatenate(([True], positions[1:] != positions[:-1]))  # over block borders
    return hashes[fresh], positions[fresh]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(marks: tuple[np.ndarray, np.ndarray]) -> str:
    """All marks as hex digits: eight for the hash and eight for the position of each."""
    both = np.empty((len(marks[0]), 2), ">u4")
    both[:, 0], both[:, 1] = marks
    return both.tobytes().hex()


def fingerprints(df: DataFrame, text: str = "text", into: str = "marks", k: int = RUN, w: int = WINDOW) -> DataFrame:
    """The rows with a further column of marks: array<struct<hash: long, position: long>>."""
    if into in df.columns:
        raise ValueError(f"column {into} exists already")
    schema = T.StructType(df.schema.fields + T.StructType.fromDDL(f"{into} array<struct<hash: long, position: long>>").fields)
    names = df.columns

    def step(batches):
        for batch in batches:
            marks = [winnow(t, k, w) for t in batch.column(names.index(text)).to_pylist()]
            rows = [[{"hash": int(h), "position": int(p)} for h, p in zip(*m)] for m in marks]
            yield {**{n: batch.column(i) for i, n in enumerate(names)}, into: rows}

    return arrow_step(df, step, schema)


def with_followers(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bucket, tail), dealt out by ranges of doc_id and sorted inside each task, so
    that a document's follower is the next row. A range ends with a copy of the first document of
    the next range (``tail``; after the last range: of the first), so no task needs another's rows.
    Rows of equal doc_id are ordered by text; null ids come last."""
    spark = docs.sparkSession
    ranges = 8 * part_count(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # The sketch and the list of range heads hold a few values per range, however many rows.
    cuts = rows.select("doc_id").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    cuts = np.unique(np.array([math.floor(c) for c in cuts], np.int64))

    def range_of(ids: pa.Array) -> np.ndarray:
        # As whole numbers: a float would round large ids, also those beside a null.
        found = np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), len(cuts), found).astype(np.int32)

    place = F.arrow_udf(lambda ids: pa.array(range_of(ids)), "int")
    firsts = rows.select("doc_id", place("doc_id").alias("bucket")).groupBy("bucket").agg(F.min("doc_id").alias("head"))
    heads = {r.bucket: r.head for r in firsts.collect()}  # one row per range
    order = sorted(heads)
    before = {heads[b]: order[i - 1] for i, b in enumerate(order)}

    def places(ids: pa.Array) -> pa.Array:
        found = zip(range_of(ids).tolist(), ids.to_pylist())
        return pa.array([[b, before[i]] if i in before else [b] for b, i in found], pa.list_(pa.int32()))

    both = F.arrow_udf(places, "array<int>")
    dealt = rows.withColumn("places", both("doc_id")).select("doc_id", "text", F.posexplode("places").alias("tail", "bucket"))
    return dealt.repartition(part_count(spark), "bucket").sortWithinPartitions(
        "bucket", "tail", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text"
    )


_EDITED = (
    "doc_id long, n_chars long, n_edited long, n_marks long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def edited_likeness(docs: DataFrame, k: int = RUN, w: int = WINDOW) -> DataFrame:
    """Each document's fingerprint beside that of its edited text, whose last half comes from the
    beginning of the document that follows by doc_id, and beside that of the follower."""

    def compare(row, follower):
        (doc_id, text, marks), (_, other, others) = row, follower
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        own = winnow(edited, k, w)
        return (
            doc_id, len(text), len(edited), len(marks[0]),
            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            as_text(marks), as_text(own), likeness(marks[0], own[0]), likeness(marks[0], others[0]),
        )

    names = T.StructType.fromDDL(_EDITED).names

    def step(batches):
        held, bucket, closed = None, None, False
        for batch in batches:
            found = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "tail", "bucket"))
            for doc_id, text, tail, b in zip(*columns):
                if b != bucket:
                    held, bucket, closed = None, b, False
                if closed:
                    continue
                row = (doc_id, text, winnow(text, k, w))
                if held is not None:
                    found.append(compare(held, row))
                held, closed = row, bool(tail)
            if found:
                yield dict(zip(names, zip(*found)))

    return arrow_step(with_followers(docs), step, _EDITED)
