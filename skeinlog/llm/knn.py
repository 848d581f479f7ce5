"""Exact top-k search by inner product as a Voronoi kNN join.

A vector x with whole components gets one more coordinate, sqrt(M - |x|^2) with M the largest
squared length, and a query gets 0 there: the nearest vector is then the one of the highest inner
product, and the triangle inequality holds. Every vector belongs to the cell of its nearest pivot.
A cell's summary is the k + 1 ids whose vectors are nearest to the pivot, their distances, and the
largest distance of its queries. From the summaries alone comes a bound for a cell of queries: k
vectors with other ids than the query's lie within it. A vector is copied to a group of query
cells only where its distance from its own pivot leaves it a chance to lie within the bound; copies
are split into slices, the group's queries are sent to each slice, and the best k of the slices win.

Bounds: ``PIVOTS`` pivots (a sample by hash), ``GROUP`` queries in a group (a larger cell is split) and about
``SLICE`` vectors in a slice. Pivots, summaries and thresholds are all that reaches the driver.

Defined results: rows without id or vector, or with a null or non-finite component, take no part.
Missing components of shorter vectors count as 0. Rows with the query's id are its own, not
candidates; a repeated query id is asked once, with its smallest vector; other repeated rows all
count. Ties go to the smaller id. Components are taken as floor(scale * x); scores must fit a long.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinlog.llm.common import arrow_step, save, scratch

K, SCALE = 5, 256
PIVOTS, GROUP, SLICE = 96, 4096, 16_384
_BLOCK = 256
_SLACK = 1e-6  # of the longest distance: more than the error of the float distances


def whole_vectors(table: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, vec): the rows that take part."""
    vector = F.col(vector_column)
    good = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return table.where(F.col(id_column).isNotNull() & vector.isNotNull() & good).select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("vec"),
    )


def matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole vectors, exact: in doubles while all sums stay below 2**53."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def _lifted(vectors: np.ndarray, largest: int) -> np.ndarray:
    squares = (vectors.astype(float) ** 2).sum(axis=1)
    return np.column_stack([vectors.astype(float), np.sqrt(np.maximum(largest - squares, 0))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _in_cells(rows: DataFrame, pivots: np.ndarray, width: int, largest: int) -> DataFrame:
    """vec_id, vec with the cell and distance of the row as a vector and as a query."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType(
        rows.select("vec_id", "vec", "is_query", "mark").schema.fields
        + T.StructType.fromDDL("cell int, dist double, query_cell int, query_dist double").fields
    )

    def nearest(points):
        far = _distances(points, shared.value)
        cell = far.argmin(axis=1)
        return cell.astype(np.int32), np.linalg.norm(points - shared.value[cell], axis=1)

    def step(batches):
        for batch in batches:
            vectors = matrix(batch.column(1).to_numpy(zero_copy_only=False), width)
            cell, dist = nearest(_lifted(vectors, largest))
            query_cell, query_dist = nearest(np.column_stack([vectors.astype(float), np.zeros(len(vectors))]))
            yield {
                "vec_id": batch.column(0), "vec": batch.column(1), "is_query": batch.column(2), "mark": batch.column(3),
                "cell": cell, "dist": dist, "query_cell": query_cell, "query_dist": query_dist,
            }

    return arrow_step(rows.select("vec_id", "vec", "is_query", "mark"), step, schema)


def _nearest_of_cells(rows: DataFrame, k: int) -> pd.DataFrame:
    """The k ids nearest to each cell's pivot, with their distances: first of each task, then of all.
    An id that stands on many rows counts once, by its nearest."""

    def step(batches):
        best = pd.DataFrame({"cell": np.empty(0, np.int32), "vec_id": np.empty(0, np.int64), "dist": np.empty(0)})
        for batch in batches:
            found = pd.concat([best, batch.to_pandas()]).sort_values("dist", kind="stable")
            best = found.drop_duplicates(["cell", "vec_id"]).groupby("cell").head(k)
        yield {c: best[c].to_numpy() for c in ("cell", "vec_id", "dist")}

    partial = arrow_step(rows.select("cell", "vec_id", "dist"), step, "cell int, vec_id long, dist double")
    partial = partial.groupBy("cell", "vec_id").agg(F.min("dist").alias("dist"))
    by = Window.partitionBy("cell").orderBy("dist", "vec_id")
    return partial.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k).toPandas()


def _reach(upper: np.ndarray, ids: np.ndarray, k: int) -> float:
    """The distance within which k + 1 ids lie, so k of them are not the query's own."""
    order = np.argsort(upper, kind="stable")
    _, first = np.unique(ids[order], return_index=True)
    return float(upper[order][np.sort(first)[k]]) if len(first) > k else float("inf")


def _groups(cells: pd.DataFrame, between: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Groups of (query cell, part, parts): neighbouring cells together up to GROUP queries, larger cells in parts."""
    left = {int(c): int(n) for c, n in zip(cells.query_cell, cells.n)}
    out: list[list[tuple[int, int, int]]] = []
    held, at = 0, None
    while left:
        at = min(left) if at is None else min(left, key=lambda c: (between[at, c], c))
        n = left.pop(at)
        parts = math.ceil(n / GROUP)
        if parts > 1:
            out.extend([[(at, p, parts)] for p in range(parts)])
            held = GROUP
        elif out and held + n <= GROUP:
            out[-1].append((at, 0, 1))
            held += n
        else:
            out.append([(at, 0, 1)])
            held = n
    return out


def _solver(k: int, width: int):
    def solve(key, queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        ids = data.vec_id.to_numpy(np.int64)
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], matrix(data.vec.to_numpy()[order], width)
        asked = queries.query_id.to_numpy(np.int64)
        points = matrix(queries.query_vec.to_numpy(), width)
        found = []
        for b in range(0, len(asked), _BLOCK):
            scores = products(points[b : b + _BLOCK], vectors)
            for query, row in zip(asked[b : b + _BLOCK], scores):
                keep = ids != query
                here, values = ids[keep], row[keep]
                if len(values) > k:
                    least = np.partition(values, len(values) - k)[len(values) - k]
                    some = values >= least
                    here, values = here[some], values[some]
                best = np.lexsort((here, -values))[:k]
                found.append(pd.DataFrame({"query_id": query, "vec_id": here[best], "score": values[best]}))
        if not found:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
        return pd.concat(found)

    return solve


def top_k(table: DataFrame, id_column: str, vector_column: str, queries: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of the table where ``queries``, a condition on vec_id, holds."""
    spark, folder = table.sparkSession, scratch(table.sparkSession)
    rows = save(
        whole_vectors(table, id_column, vector_column, scale).withColumns(
            {"is_query": F.coalesce(queries, F.lit(False)), "mark": F.monotonically_increasing_id()}
        ),
        folder,
        "vectors",
    )
    square = F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x * x)
    size = rows.agg(F.max(square).alias("largest"), F.max(F.size("vec")).alias("width")).first()
    if size.width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, largest = max(size.width, 1), size.largest
    chosen = rows.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(PIVOTS).select("vec").collect()
    pivots = np.unique(_lifted(matrix([r.vec for r in chosen], width), largest), axis=0)
    rows = save(_in_cells(rows, pivots, width, largest), folder, "cells")

    near = _nearest_of_cells(rows, k + 1)
    asked = rows.where("is_query").groupBy("query_cell").agg(F.count("*").alias("n"), F.max("query_dist").alias("far")).toPandas()
    cells = sorted(set(near.cell.to_numpy(int).tolist()))
    between = _distances(pivots, pivots)
    slack = _SLACK * (1 + 4 * math.sqrt(float(largest) + 1))
    # Some k vectors other than a query lie within this distance of every query of the cell.
    reach, near_ids = {}, near.vec_id.to_numpy(np.int64)
    for cell, far in zip(asked.query_cell, asked.far):
        upper = between[int(cell), near.cell.to_numpy(int)] + near.dist.to_numpy() + far
        reach[int(cell)] = _reach(upper, near_ids, k) + slack
    farthest = {int(c): f for c, f in zip(asked.query_cell, asked.far)}
    groups = _groups(asked, between)
    copies, places = [], []
    for g, members in enumerate(groups):
        for cell in cells:
            least = min(between[c, int(cell)] - farthest[c] - reach[c] for c, _, _ in members)
            copies.append((int(cell), g, float(least - slack)))
        places.extend([(c, p, parts, g) for c, p, parts in members])
    copy_table = spark.createDataFrame(copies, "cell int, grp int, least double")
    place_table = spark.createDataFrame(places, "query_cell int, part int, parts int, grp int")

    # A vector's distance from its pivot shows whether it can lie within the bound. A group has as
    # many slices as the vectors that are left to it need.
    data = rows.join(copy_table, "cell").where("dist >= least").select("grp", "mark", "vec_id", "vec")
    held = data.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(SLICE)).cast("int").alias("slices"))
    held = save(held, folder, "slices")
    data = data.join(held, "grp").select(
        "grp", F.pmod(F.xxhash64("mark"), F.col("slices")).cast("int").alias("slice"), "vec_id", "vec"
    )
    mine = (F.col("parts") == 1) | (F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col("parts")) == F.col("part"))
    once = rows.where("is_query").groupBy("vec_id").agg(
        F.min(F.struct("vec", "query_cell")).alias("q")
    ).select("vec_id", "q.vec", "q.query_cell")
    points = once.join(place_table, "query_cell").where(mine).join(held, "grp").select(
        F.col("grp").alias("to_grp"),
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("to_slice"),
        F.col("vec_id").alias("query_id"),
        F.col("vec").alias("query_vec"),
    )
    local = points.groupBy("to_grp", "to_slice").cogroup(data.groupBy("grp", "slice")).applyInPandas(
        _solver(k, width), "query_id long, vec_id long, score long"
    )
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = local.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
