"""Packing into optimal length buckets.

Lengths of all documents are counted into one histogram; dynamic programming over it chooses the
bucket boundaries that minimise padding, and batches of a fixed token budget are formed inside each
bucket. The histogram has one bin per length up to ``EXACT`` and ``PER_OCTAVE`` bins per doubling
beyond, so its size is bounded whatever the number of documents.

Rows are numbered within shards of bounded size, and shards by a running sum of their counts, so no
bucket is ever gathered in one task. A null or empty text has no tokens and goes to the first bucket;
repeated rows are packed each for itself. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm import words as W
from shelfmark.llm.tables import stage

EXACT = 256
PER_OCTAVE = 128
BUCKETS = 12
TOKEN_BUDGET = 65_536
SHARD_ROWS = 32_768


def lengths(docs: DataFrame) -> DataFrame:
    """doc_id and n_tokens, the number of words of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, words in W.word_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(words.counts.astype(np.int64))], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def bin_of(length: F.Column) -> F.Column:
    """The largest length of the bin that a length falls in."""
    octave = F.floor(F.log2(F.greatest(length - 1, F.lit(EXACT)).cast("double")))
    step = F.pow(F.lit(2.0), octave - int(np.log2(PER_OCTAVE)))
    return F.when(length <= EXACT, F.greatest(length, F.lit(1))).otherwise(F.ceil(length / step) * step).cast("long")


def boundaries(bins: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper ends of at most ``buckets`` buckets over sorted bins, with the least total padded length.

    ``best[j]`` is the least cost of the first j bins with the buckets so far; a last bucket over bins
    i to j costs the number of its rows times bin j.
    """
    n = len(bins)
    if not n:
        return []
    before = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    best = np.full(n + 1, np.inf)
    best[0] = 0
    choices = []
    for _ in range(min(buckets, n)):
        now, choice = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        now[0] = 0
        for j in range(1, n + 1):
            cost = best[:j] + bins[j - 1] * (before[j] - before[:j])
            choice[j] = int(np.argmin(cost))
            now[j] = cost[choice[j]]
        best = now
        choices.append(choice)
    ends, j = [], n
    for choice in reversed(choices):
        if j == 0:
            break
        ends.append(int(bins[j - 1]))
        j = int(choice[j])
    return ends[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_length, batch_id (within the bucket), slot and padding.

    Each batch of a bucket but its last is full: as many rows as the budget allows at the bucket's
    length, one at least. Which rows of a bucket share a batch follows the order of files and splits.
    """
    sized = stage(lengths(docs), "packing-lengths").withColumn("bin", bin_of(F.col("n_tokens")))
    histogram = sized.groupBy("bin").agg(F.count("*").alias("n")).toPandas().sort_values("bin")
    ends = boundaries(histogram["bin"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), buckets)
    ends_sql = F.array(*[F.lit(e).cast("long") for e in ends]) if ends else F.expr("cast(array() as array<bigint>)")
    bucket = F.size(F.filter(ends_sql, lambda e: e < F.col("bin")))
    rows = sized.withColumn("row", F.monotonically_increasing_id()).withColumn("bucket", bucket)
    rows = rows.withColumn("shard", F.floor(F.col("row") / SHARD_ROWS).cast("long"))
    counts = rows.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    running = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = counts.select("bucket", "shard", (F.sum("n").over(running) - F.col("n")).alias("first"))
    inside = Window.partitionBy("bucket", "shard").orderBy("row")
    place = F.col("first") + F.row_number().over(inside) - 1
    padded = F.try_element_at(ends_sql, F.col("bucket") + 1)
    numbered = rows.join(first, ["bucket", "shard"]).withColumn("place", place).withColumn("padded_length", padded)
    capacity = F.greatest(F.floor(F.lit(budget) / F.col("padded_length")), F.lit(1)).cast("long")
    return numbered.select(
        "doc_id", "n_tokens", "bucket", "padded_length", F.floor(F.col("place") / capacity).cast("long").alias("batch_id"),
        (F.col("place") % capacity).alias("slot"), (F.col("padded_length") - F.col("n_tokens")).alias("padding"),
    )
