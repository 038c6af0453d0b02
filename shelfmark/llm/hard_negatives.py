"""Hard negatives by a secondary-sort shuffle.

An anchor's positives are its highest-scoring other rows of the same label. Each positive opens a window
of scores, from ``LOW`` to ``HIGH`` hundredths of its own score, and the highest-scoring rows of other
labels inside it are its hard negatives.

Scored pairs are packed into binary keys (anchor, descending score, positive before negative, id) whose
byte order is that order, and go through one shuffle: dealt by anchor, sorted by key within partitions
(``repartitionAndSortWithinPartitions`` in its DataFrame form). A streaming iterator walks each anchor's
keys once: a positive opens its window, negatives that fall into open windows are emitted, and nothing
of an anchor is held but its open windows. A window lies below its positive's score (a positive below
zero opens none, as its window would be empty), so it is open before its first negative passes.

Pairs are cut down before that shuffle, exactly: all rows stream past blocks of anchors, and a task keeps
for each anchor its best positives, later for each window its best negatives; what it drops can be in no
answer. Rows are dealt to parts by a hash of their id, and ``ANCHOR_BYTES`` bounds what a task holds.

Components become floor(256 * x) and scores are exact integers, whatever their size; a score beyond
a long saturates. Rows with a null vec_id, label or vector or any null or non-finite component take no
part. Rows that share a vec_id are one row, the least by (label, vector). Vectors of different
length are never compared; an empty or zero vector scores 0. Ties go to the smaller vec_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.tables import stage

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
#: Anchors of one block, as float64; rows that stream past a block in one part; rows and anchors scored at once.
ANCHOR_BYTES, PART_ROWS = 4 << 20, 262_144
CHUNK_ROWS, CHUNK_ANCHORS = 4_096, 256
#: Integers and their sums below this are exact in float64.
EXACT = 2.0**53

PAIRS = "anchor_id long, score long, id long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """vec_id, label and embedding of the rows that take part, one per vec_id."""
    x = F.col("embedding")
    # x * 0 is 0 for finite components only
    finite = F.coalesce(F.forall(x, lambda v: v.isNotNull() & (v.cast("double") * 0 == 0)), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite)
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.*")


# ---------------------------------------------------------------- scoring


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(256 * x), as floats where those are exact and as Python integers elsewhere."""
    if not values.size or np.abs(values).max() < EXACT / 256:
        return np.floor(256 * values)
    whole = [int(v) * 256 if abs(v) >= EXACT else math.floor(256 * v) for v in values.ravel()]
    return np.array(whole, dtype=object).reshape(values.shape)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: float64 where every sum is exact, else integers that saturate."""
    most = lambda x: int(np.abs(x).max()) if x.size else 0
    if a.dtype != object and b.dtype != object and most(a) * most(b) * max(a.shape[1], 1) < EXACT:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T if a.size else np.zeros((len(a), len(b)), object)
    edge = np.iinfo(np.int64)
    return np.clip(exact, edge.min, edge.max).astype(np.int64)


class Best:
    """The ``k`` best (score, id) of each of an anchor block's windows, over rows that come in the order of their ids."""

    def __init__(self, windows: int, k: int):
        self.k = k
        self.window, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(windows, np.iinfo(np.int64).min)  # of full windows; a later row must exceed it

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(window):
            return
        window, score, ids = (np.concatenate(x) for x in ((self.window, window), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, np.invert(score), window))
        window, score, ids = window[order], score[order], ids[order]
        first = np.searchsorted(window, window)
        place = np.arange(len(window)) - first
        keep = place < self.k
        self.window, self.score, self.id = window[keep], score[keep], ids[keep]
        full = place == self.k - 1
        self.least[window[full]] = score[full]


def top_of(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of at most k best allowed scores per row, first columns first among ties, and perhaps more."""
    if np.count_nonzero(allowed) <= 4 * k * len(scores) or scores.shape[1] <= k:
        return np.nonzero(allowed)
    if max(int(scores.max()), -int(scores.min())) * scores.shape[1] < EXACT / 2:
        keyed = np.where(allowed, scores.astype(np.float64) * scores.shape[1] - np.arange(scores.shape[1]), -np.inf)
        column = np.argpartition(keyed, -k, axis=1)[:, -k:]
    else:
        keyed = np.where(allowed, scores, np.iinfo(np.int64).min)
        column = np.argsort(np.invert(keyed.astype(np.int64)), axis=1, kind="stable")[:, :k]
    row = np.repeat(np.arange(len(scores)), k)
    column = column.ravel()
    keep = allowed[row, column]
    return row[keep], column[keep]


class Block:
    """A block of anchors past which rows stream."""

    def __init__(self, ids, labels, vectors, windows, step: int):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.windows = windows  # per anchor a list of (low, high), or None to look for positives
        self.wide = max((len(w) for w in windows), default=0) if windows is not None else 1
        self.parts = [slice(low, low + step) for low in range(0, len(ids), step)]
        count = POSITIVES if windows is None else NEGATIVES
        self.best = [Best(len(ids[p]) * self.wide, count) for p in self.parts]
        if windows is not None:  # a window that is not there lets nothing in
            edge = np.iinfo(np.int64)
            self.low, self.high = np.full((2, len(ids), self.wide), edge.max)
            self.high[:] = edge.min
            for n, own in enumerate(windows):
                for w, (low, high) in enumerate(own):
                    self.low[n, w], self.high[n, w] = low, high

    def see(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        for part, best in zip(self.parts, self.best, strict=True):
            scores = products(self.vectors[part], vectors)
            same = self.labels[part, None] == labels[None]
            for w in range(self.wide):
                least = best.least.reshape(-1, self.wide)[:, w, None]
                allowed = scores > least
                allowed |= least == np.iinfo(np.int64).min
                if self.windows is None:
                    allowed &= same & (self.ids[part, None] != ids[None])
                else:
                    allowed &= ~same & (scores >= self.low[part, w, None]) & (scores <= self.high[part, w, None])
                row, column = top_of(scores, allowed, best.k)
                best.add(row * self.wide + w, scores[row, column].astype(np.int64), ids[column])

    def found(self) -> Iterator[pa.RecordBatch]:
        for part, best in zip(self.parts, self.best, strict=True):
            # windows overlap: a pair is sent once
            rows = np.unique(np.stack([best.window // self.wide, best.score, best.id]) if self.wide else np.zeros((3, 0), np.int64), axis=1)
            if rows.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[part][rows[0]]), pa.array(rows[1]), pa.array(rows[2])], ["anchor_id", "score", "id"])


def window(score: int) -> tuple[int, int]:
    """Least and greatest negative score of a positive's window."""
    return -(-LOW * score // 100), HIGH * score // 100


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if not width:
        return np.zeros((len(column), 0))
    return scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width))


def _scan(batches: Iterator[pa.RecordBatch], chunk_rows: int, chunk_anchors: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive by (block, part, width, side): the anchors of a block, then the rows of a part by id."""

    def stack(rows: list[pa.RecordBatch], width: int):
        table = pa.Table.from_batches(rows)
        ids, labels = (table.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
        return ids, labels, np.concatenate([_matrix(c, width) for c in table.column("embedding").chunks])

    def close(state) -> Iterator[pa.RecordBatch]:
        if state and state["block"]:
            flush(state)
            yield from state["block"].found()

    def flush(state) -> None:
        if state["rows"] and state["block"]:
            state["block"].see(*stack(state["rows"], state["key"][2]))
        state["rows"], state["held"] = [], 0

    def open_block(state) -> None:
        scores = pa.Table.from_batches(state["anchors"]).column("positives").to_pylist()
        windows = None if not scores or scores[0] is None else [[window(s) for s in own if s >= 0] for own in scores]
        state["block"] = Block(*stack(state["anchors"], state["key"][2]), windows, chunk_anchors)
        state["anchors"] = []

    state = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("block", "part", "width", "side")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for low, high in zip(cuts[:-1], cuts[1:]):
            if low == high:
                continue
            key, side = tuple(keys[low, :3].tolist()), int(keys[low, 3])
            if state is None or key != state["key"]:
                yield from close(state)
                state = {"key": key, "anchors": [], "rows": [], "held": 0, "block": None}
            if side == 0:
                state["anchors"].append(batch.slice(low, high - low))
                continue
            if state["anchors"]:
                open_block(state)
            while low < high and state["block"]:  # rows of a block without anchors are of no use
                take = min(high - low, chunk_rows - state["held"])
                state["rows"].append(batch.slice(low, take))
                state["held"], low = state["held"] + take, low + take
                if state["held"] >= chunk_rows:
                    flush(state)
    yield from close(state)


def _streamed(rows: DataFrame, anchors: DataFrame, blocks: DataFrame, parts: int) -> DataFrame:
    """anchor_id, score and id of the pairs kept, with all rows of a length past all anchors of that length.

    A block's anchors go to each part and each row to each block of its length; both are
    bounded, so one partition's task never holds more than a block and a chunk of rows.
    """
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    none = F.lit(None).cast("array<long>")
    width = F.size("embedding").alias("width")
    left = anchors.join(blocks, "width").select(
        _block().alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "width", F.lit(0).alias("side"), "vec_id", "label", "embedding", "positives"
    )
    right = rows.select("*", width).join(blocks, "width").select(
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part.alias("part"), "width", F.lit(1).alias("side"), "vec_id", "label", "embedding", none.alias("positives")
    )
    dealt = left.unionByName(right).repartition("block", "part", "width")
    ordered = dealt.sortWithinPartitions("block", "part", "width", "side", "vec_id")
    chunks = CHUNK_ROWS, CHUNK_ANCHORS
    return ordered.mapInArrow(lambda batches: _scan(batches, *chunks), PAIRS)


def _block() -> Column:
    return F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("blocks")).cast("int")


# ---------------------------------------------------------------- packed keys


def packed(anchor: Column, score: Column, side: Column, id_: Column) -> Column:
    """25 bytes whose order is (anchor, descending score, side, id)."""
    sign = F.lit(-(2**63)).cast("long")
    word = lambda c: F.lpad(F.hex(c), 16, "0")
    text = F.concat(word(anchor.bitwiseXOR(sign)), word(F.bitwise_not(score).bitwiseXOR(sign)), F.lpad(F.hex(side), 2, "0"), word(id_.bitwiseXOR(sign)))
    return F.unhex(text)


def unpacked(keys: pa.Array) -> tuple[np.ndarray, ...]:
    """anchor, score, side and id of packed keys."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), np.uint8).reshape(-1, 25)
    word = lambda low: (np.ascontiguousarray(raw[:, low : low + 8]).view(">u8")[:, 0].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
    return word(0), np.invert(word(8)), raw[:, 16], word(17)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed pairs in key order to mined rows; holds the open windows of one anchor."""
    names = [c.split()[0] for c in MINED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    own, opened, seen = None, [], 0
    for batch in batches:
        out: list[tuple] = []
        for anchor, score, side, id_ in zip(*(x.tolist() for x in unpacked(batch.column("key")))):
            if anchor != own:
                own, opened, seen = anchor, [], 0
            if side == 0:
                seen += 1
                if seen <= POSITIVES:
                    opened.append([id_, score, *window(score), 0])
                continue
            for w in opened:
                if w[2] <= score <= w[3] and w[4] < NEGATIVES:
                    w[4] += 1
                    out.append((anchor, w[0], w[4], id_, w[1], score))
            opened = [w for w in opened if w[2] <= score and w[4] < NEGATIVES]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def secondary_sort(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Positives and candidate negatives (anchor_id, score, id) through one sorted shuffle to mined rows."""
    key = lambda side: packed(F.col("anchor_id"), F.col("score"), F.lit(side).cast("long"), F.col("id")).alias("key")
    pairs = positives.select("anchor_id", key(0)).unionByName(negatives.select("anchor_id", key(1)))
    return pairs.repartition("anchor_id").sortWithinPartitions("key").select("key").mapInArrow(_walk, MINED)


def _first_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first positives of each anchor out of packed pairs in key order."""
    own, seen = None, 0
    for batch in batches:
        out = []
        for anchor, score, _, id_ in zip(*(x.tolist() for x in unpacked(batch.column("key")))):
            own, seen = (anchor, seen + 1) if anchor == own else (anchor, 1)
            if seen <= POSITIVES:
                out.append((anchor, score, id_))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["anchor_id", "score", "id"])


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of all anchors.

    ``vectors`` has vec_id, label and embedding; ``is_anchor`` tests vec_id; ``label`` replaces the column.
    """
    spark = vectors.sparkSession
    rows = stage(usable(vectors, F.col("label") if label is None else label), "hard-negative-rows")
    anchors = rows.where(is_anchor).select("*", F.size("embedding").alias("width"))
    per_block = F.greatest(F.lit(1), F.floor(F.lit(ANCHOR_BYTES) / (8 * F.greatest("width", F.lit(1)))))
    blocks = anchors.groupBy("width").agg(F.ceil(F.count("*") / F.first(per_block)).cast("int").alias("blocks"))
    total = rows.count()
    # a layout only: parts bound what one task reads, and small tables still use all cores
    parts = max(1, -(-total // PART_ROWS), min(-(-total // CHUNK_ROWS), 2 * spark.sparkContext.defaultParallelism))
    asked = anchors.withColumn("positives", F.lit(None).cast("array<long>"))
    near = _streamed(rows, asked, blocks, parts)
    keyed = near.select("anchor_id", packed(F.col("anchor_id"), F.col("score"), F.lit(0).cast("long"), F.col("id")).alias("key"))
    keyed = keyed.repartition("anchor_id").sortWithinPartitions("key").select("key")
    positives = stage(keyed.mapInArrow(_first_positives, PAIRS), "hard-negative-positives")
    opened = positives.where("score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("score").alias("positives"))
    negatives = _streamed(rows, anchors.join(opened, "vec_id"), blocks, parts)
    return secondary_sort(positives, negatives)
