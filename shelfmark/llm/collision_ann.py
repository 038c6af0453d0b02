"""Nearest neighbours by collision-counting hashing.

Every vector is projected on ``PROJECTIONS`` random lines, and each line's values are kept sorted. A
query opens a window centred on its own projection in every array; the windows widen together with a
radius (virtual rehashing), and a vector that has fallen into at least ``THRESHOLD`` of them is
verified with its exact distance. At radius R the window catches a vector at distance R on a line with
probability 0.83, so a neighbour within R misses the threshold with a chance below one in a hundred;
the search ends when the k-th best verified distance is within R, or all windows hold every row.

Vectors are dealt to blocks of about ``BLOCK_ROWS`` rows by position, whatever their values, and
queries to blocks of ``QUERY_ROWS``; a task holds one pair of blocks, and only each block's k best
leave it. All rows are indexed.

Vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors of
different dimension are never compared. Rows that share a vec_id are one row, at their least
distance; rows without one take no part. Ties go to the smaller vec_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 48
WINDOW = 2.72
THRESHOLD = 32
GROWTH = 1.25
BLOCK_ROWS = 16_384
QUERY_ROWS = 2_048
SEED = 7


def block_neighbours(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of one block for every query, as found by collision counting."""
    n, width = vectors.shape
    lines = np.random.default_rng(SEED).standard_normal((width, PROJECTIONS))
    projected, centre = vectors @ lines, queries @ lines
    order = np.argsort(projected, axis=0, kind="stable").T.copy()
    arrays = np.take_along_axis(projected.T, order, axis=1)
    unit = max(float(projected.std()) / 16, 1e-9)
    need = THRESHOLD if len(np.unique(ids)) > k else 0
    out = []
    for row, (own, query) in enumerate(zip(query_ids, queries, strict=True)):
        count = np.zeros(n, np.int16)
        verified = np.zeros(n, bool)
        distance = np.full(n, np.inf)
        low = high = np.array([np.searchsorted(arrays[j], centre[row, j]) for j in range(PROJECTIONS)])
        radius = unit
        while True:
            half = WINDOW * radius / 2
            new_low = np.array([np.searchsorted(arrays[j], centre[row, j] - half, "left") for j in range(PROJECTIONS)])
            new_high = np.array([np.searchsorted(arrays[j], centre[row, j] + half, "right") for j in range(PROJECTIONS)])
            new_low, new_high = np.minimum(new_low, low), np.maximum(new_high, high)
            for j in range(PROJECTIONS):
                if new_low[j] < low[j]:
                    count[order[j, new_low[j] : low[j]]] += 1
                if new_high[j] > high[j]:
                    count[order[j, high[j] : new_high[j]]] += 1
            low, high = new_low, new_high
            fresh = np.flatnonzero((count >= need) & ~verified)
            verified[fresh] = True
            fresh = fresh[ids[fresh] != own]
            distance[fresh] = np.sqrt(np.square(vectors[fresh] - query).sum(axis=1))
            near = np.flatnonzero(distance <= radius)
            if len(near) >= k and len(np.unique(ids[near])) >= k or verified.all() or (low.max() == 0 and high.min() == n):
                break
            radius *= GROWTH
        found = np.flatnonzero(np.isfinite(distance))
        found = found[np.lexsort((ids[found], distance[found]))]
        _, first = np.unique(ids[found], return_index=True)
        found = found[np.sort(first)][:k]
        out.append(pd.DataFrame({"query_id": own, "vec_id": ids[found], "score": distance[found]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def usable(column: str) -> F.Column:
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest vectors.

    Both inputs have vec_id and embedding.
    """
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable("embedding"))
    rows, asked = clean(vectors), clean(queries).dropDuplicates(["vec_id"])
    blocks = max(1, -(-vectors.count() // BLOCK_ROWS))
    query_blocks = max(1, -(-queries.count() // QUERY_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    width = F.size("embedding").alias("width")
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    left = rows.withColumn("block", spread).select("vec_id", "embedding", width, "block", every(query_blocks).alias("part"))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")
    right = asked.withColumn("part", part).select("vec_id", "embedding", width, every(blocks).alias("block"), "part")
    keys = ["block", "part", "width"]

    def run(index: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(wanted):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        matrix = lambda df: np.stack(df["embedding"].to_numpy()).astype(np.float64)
        return block_neighbours(index["vec_id"].to_numpy(np.int64), matrix(index), wanted["vec_id"].to_numpy(np.int64), matrix(wanted), k)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
