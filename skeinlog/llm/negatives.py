"""Hard negatives by segment summaries.

A vector is cut into segments; of each its mean and its deviation (the length of what is left after
the mean) are stored. The inner product of two segments is the product of their means, times their
length, plus or minus at most the product of their deviations. Sums of these bound a score from
above and below. The bounds of a few long segments are taken for all vectors; those that may still be among
an anchor's best are looked at in shorter segments, and only what is left is scored exactly.

Anchors stand in blocks, vectors in slices of at most ``CELLS`` components; each block meets each
slice once, in a task of its own. Slices come in passes, each as many as all before it: what an
anchor has found so far is the floor of the next pass, so that a pass returns about as many rows as
the result has, not as many for each slice. Positives meet only slices of the anchor's own label; a label of
many rows has many slices.

Defined results: rows with a null id or label, a null vector or a null or non-finite component take
no part. Missing components of shorter vectors count as 0; vectors of no components score 0. Rows with
the anchor's id are its own and no candidates; an anchor id that stands on several rows is asked
once, with its smallest (label, vector); other repeated rows each count. Ties go to the smaller id.
Components are taken as floor(scale * x); scores times 100 must fit a long.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.llm.common import save, scratch
from skeinlog.llm.knn import products

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score
LEVELS = (4, 16)  # segments of a vector, coarse to fine
CELLS = 1 << 20  # components in a slice; a block of anchors has a quarter of it
_CHUNK = 64  # anchors bounded at once
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_FOUND = "anchor_id long, target int, vec_id long, score long"


def usable(table: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vec): the rows that take part."""
    vector = F.col("embedding")
    good = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & good).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("vec"),
    )


def summaries(vectors: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean times root of length, deviation) of each segment of each vector."""
    width = vectors.shape[1]
    starts = np.unique(np.arange(min(segments, width)) * width // max(min(segments, width), 1))
    lengths = np.diff(np.append(starts, width))
    sums = np.add.reduceat(vectors, starts, axis=1)
    squares = np.add.reduceat(vectors * vectors, starts, axis=1)
    means = sums / np.sqrt(lengths)
    return means, np.sqrt(np.maximum(squares - means * means, 0))


class Bounds:
    """Summaries of all vectors of a slice, or of all anchors of a block, by level."""

    def __init__(self, vectors: np.ndarray, levels=LEVELS):
        real = vectors.astype(float)
        self.levels = [summaries(real, s) for s in levels] if vectors.shape[1] else []
        self.norms = np.sqrt((real * real).sum(axis=1))

    def between(self, others: Bounds, level: int, mine, theirs) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the scores of some of my vectors with some others."""
        (means, spread), (other_means, other_spread) = self.levels[level], others.levels[level]
        middle = means[mine] @ other_means[theirs].T
        # Summaries and sums are rounded; the slack is far above that error.
        slack = 1e-9 * np.multiply.outer(self.norms[mine], others.norms[theirs]) + 1
        around = spread[mine] @ other_spread[theirs].T + slack
        return middle - around, middle + around


def _kth_largest(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _open(lower: np.ndarray, upper: np.ndarray, targets: np.ndarray, k: int) -> np.ndarray:
    """Which candidates may be among the k best of any target (low, high)."""
    keep = np.zeros(len(lower), bool)
    for low, high in targets:
        sure = (lower >= low) & (upper <= high)
        floor = max(float(low), _kth_largest(lower[sure], k))
        keep |= (upper >= floor) & (lower <= high)
    return keep


def _best(ids: np.ndarray, scores: np.ndarray, low: int, high: int, k: int) -> np.ndarray:
    inside = np.flatnonzero((scores >= low) & (scores <= high))
    return inside[np.lexsort((ids[inside], -scores[inside]))[:k]]


def _matrix(column: pa.ChunkedArray, rows: int, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64, copy=False).reshape(rows, width)


def _solver(width: int, same_label: bool, k: int) -> Callable:
    """Each anchor's k best of a slice for each of its targets."""
    schema = pa.schema([("anchor_id", pa.int64()), ("target", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def solve(_, anchors: pa.Table, data: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(anchors) and len(data):
            vectors, asked = _matrix(data["vec"], len(data), width), _matrix(anchors["vec"], len(anchors), width)
            ids, labels = data["vec_id"].to_numpy(), data["label"].to_numpy()
            names, own_labels = anchors["anchor_id"].to_numpy(), anchors["label"].to_numpy()
            targets = anchors["targets"].to_pylist()
            theirs, mine = Bounds(vectors), Bounds(asked)
            everyone = np.arange(len(ids))
            for begin in range(0, len(names), _CHUNK):
                chunk = np.arange(begin, min(begin + _CHUNK, len(names)))
                coarse = mine.between(theirs, 0, chunk, everyone) if width else None
                for i in chunk:
                    limits = np.array([(t["low"], t["high"]) for t in targets[i]], np.int64).reshape(-1, 2)
                    some = np.flatnonzero((ids != names[i]) & ((labels == own_labels[i]) == same_label))
                    if width:
                        some = some[_open(coarse[0][i - begin][some], coarse[1][i - begin][some], limits, k)]
                    for level in range(1, len(mine.levels)):
                        if len(some) > k:
                            lower, upper = mine.between(theirs, level, [i], some)
                            some = some[_open(lower[0], upper[0], limits, k)]
                    scores = products(asked[i : i + 1], vectors[some])[0]
                    for t in targets[i]:
                        best = _best(ids[some], scores, t["low"], t["high"], k)
                        found += [(names[i], t["target"], a, b) for a, b in zip(ids[some][best], scores[best])]
        columns = zip(*found) if found else [[]] * 4
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return solve


def _blocked(data: DataFrame, anchors: DataFrame, width: int, by_label: bool) -> tuple[DataFrame, DataFrame, int]:
    """Slices of the data and blocks of the anchors, of one label each or of all rows; and the
    largest number of slices."""
    room = max(1, CELLS // max(width, 1))
    part = F.col("label") if by_label else F.lit(0).cast("long")
    data, anchors = data.withColumn("part", part), anchors.withColumn("part", part)

    def sizes(rows, name, of):
        return rows.groupBy("part").agg(F.ceil(F.count("*") / F.lit(of)).cast("int").alias(name))

    parts = sizes(data, "n_slices", room).join(sizes(anchors, "n_blocks", max(1, room // 4)), "part")
    most = parts.agg(F.max("n_slices")).first()[0] or 0
    data = data.join(parts, "part").withColumn("slice", F.pmod(F.xxhash64("mark"), F.col("n_slices")).cast("int"))
    data = data.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    anchors = anchors.join(parts, "part").withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.col("n_blocks")).cast("int"))
    return data.drop("n_slices", "n_blocks"), anchors.drop("n_blocks"), most


def best_of(
    data: DataFrame, anchors: DataFrame, targets: DataFrame, width: int, same_label: bool, k: int, folder: str, name: str
) -> DataFrame:
    """(anchor_id, target, vec_id, score): the k best rows for each row of targets (anchor_id,
    target, low, high), of the anchor's label or of the others."""
    data, anchors, slices = _blocked(data, anchors, width, by_label=same_label)
    by = Window.partitionBy("anchor_id", "target").orderBy(F.desc("score"), "vec_id")
    solve = _solver(width, same_label, k)
    best, begin, end = None, 0, 1
    while best is None or begin < slices:
        limits = targets
        if best is not None:
            floors = best.where(F.col("rank") == k).select("anchor_id", "target", F.col("score").alias("floor"))
            limits = targets.join(floors, ["anchor_id", "target"], "left").withColumn("low", F.greatest("low", "floor"))
        asked = limits.groupBy("anchor_id").agg(F.collect_list(F.struct("target", "low", "high")).alias("targets"))
        left = anchors.where(F.col("n_slices") > begin).join(asked, "anchor_id").withColumn(
            "slice", F.explode(F.sequence(F.lit(begin), F.least(F.lit(end), "n_slices") - 1))
        ).select("part", "block", "slice", "anchor_id", "label", "vec", "targets")
        right = data.where(F.col("slice").between(begin, end - 1)).select("part", "block", "slice", "vec_id", "label", "vec")
        keys = ["part", "block", "slice"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(solve, _FOUND)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = save(found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k), folder, f"{name}-{begin}")
        begin, end = end, 2 * end
    return best


def _hundredth(x: Column) -> Column:
    """floor(x / 100) of a long."""
    return F.call_function("div", x - F.pmod(x, F.lit(100).cast("long")), F.lit(100).cast("long"))


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score) for
    the rows (vec_id, label, vec) where ``anchors``, a condition on vec_id, holds. A negative's score
    lies between ``low`` and ``high`` percent of the positive's."""
    spark, folder = rows.sparkSession, scratch(rows.sparkSession)
    rows = save(rows.withColumn("mark", F.monotonically_increasing_id()), folder, "usable")
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    padded = F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("vec")))
    rows = rows.withColumn("vec", padded)
    asked = rows.where(anchors).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "vec")).alias("a"))
    asked = save(asked.select("anchor_id", "a.label", "a.vec"), folder, "anchors")
    all_scores = asked.select(
        "anchor_id", F.lit(0).alias("target"), F.lit(_LEAST).cast("long").alias("low"), F.lit(_MOST).cast("long").alias("high")
    )
    near = best_of(rows, asked, all_scores, width, True, positives, folder, "positives")
    near = near.select(
        "anchor_id", F.col("rank").cast("int").alias("target"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    # The whole numbers between the two shares: the lower one rounded up, the upper one down.
    least, most = F.expr(f"-positive_score * {low}L"), F.expr(f"positive_score * {high}L")
    limits = near.select("anchor_id", "target", (-_hundredth(least)).alias("low"), _hundredth(most).alias("high"))
    limits = limits.where("low <= high")
    found = best_of(rows, asked, limits, width, False, negatives, folder, "negatives")
    return found.withColumnRenamed("vec_id", "negative_id").join(near, ["anchor_id", "target"]).select(
        "anchor_id", "positive_id", F.col("target").alias("positive_rank"), F.col("rank").cast("int").alias("rank"),
        "negative_id", "positive_score", F.col("score").alias("negative_score"),
    )
