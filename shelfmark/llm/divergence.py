"""Source divergence audit by one-hot level products.

For each language: how far does each source's use of words lie from each other source's, and which terms
does a source overuse against its whole language? Terms are runs of letters (ASCII or any character beyond),
ASCII capitals lowered; a language keeps those in ``LEAST_DOCS`` of its documents. A group's price of a
term that it holds c times is ``p(c) = 1 + floor(SCALE (c + 1) / (N + V))``, N its kept words and V
the kept terms; the divergence of p from q is the sum of ``floor((p - q)^2 / q)`` over all kept terms.

A price depends on the count alone, so a pair of sources needs only its joint table: how many terms have
level i in the one and level j in the other. Every (source, count level) is an indicator column over the
terms, and the product of the transposed matrix with itself holds the joint tables of all pairs. The
matrix is cut into blocks of terms and of ``BLOCK_SOURCES`` sources; a task multiplies the blocks of one
cell, prices the joint tables and adds up one integer per pair. Terms of like frequency share a block,
as they have few levels; a term that no source of a block holds counts in its level zero. Products count
terms in float32 below 2**24, prices are integers, so all of it is exact.

Null text, lang and source are empty strings; texts are read whole, as Arrow batches where they lie, and
only counts move. Every occurring (lang, source) counts as a group, even without terms. Equal values
rank by the UTF-8 order of the item; each rank's order is total, as items of a group are distinct.
Other columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.tables import stage
from shelfmark.llm.words import slices, split, text_buffers

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP_TERMS = 200
SLICE_BYTES = 1 << 24
BLOCK_SOURCES = 32
#: Terms of one block, by the binary logarithm of their count in the language: rare ones have few levels.
BLOCK_TERMS = ((6, 2048), (9, 512), (64, 128))
PAIR, TERM = "pair", "term"

NO_TERM = np.ones(256, bool)
NO_TERM[97:123] = NO_TERM[128:] = False

# ---------------------------------------------------------------- counting


def _term_counts(batches: Iterator[pa.RecordBatch], slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """lang, source, term, how often and in how many documents, once per slice of texts."""
    for batch in batches:
        raw, at = text_buffers(batch.column("text"))
        groups = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
        pairs: dict[tuple, int] = {}
        group = np.array([pairs.setdefault((g["lang"], g["source"]), len(pairs)) for g in groups.to_pylist()], np.int64)
        names = list(pairs)
        for low, high in slices(at, slice_bytes):
            words = split(raw[at[low] : at[high]], at[low : high + 1] - at[low], True, NO_TERM)
            if not len(words.start):
                continue
            data = words.raw[~words.space]
            ends = np.zeros(len(words.start) + 1, np.int64)
            np.cumsum(words.end - words.start, out=ends[1:])
            tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
            coded = tokens.dictionary_encode()
            many = len(coded.dictionary)
            key, count = np.unique(words.doc * many + coded.indices.to_numpy(), return_counts=True)
            doc, code = np.divmod(key, many)
            wide = group[low:high][doc] * many + code
            order = np.argsort(wide, kind="stable")
            wide, first = np.unique(wide[order], return_index=True)
            total = np.add.reduceat(count[order], first)
            docs = np.diff(np.append(first, len(order)))
            own, code = np.divmod(wide, many)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([n[0] for n in names], pa.string()).take(pa.array(own)),
                    pa.array([n[1] for n in names], pa.string()).take(pa.array(own)),
                    coded.dictionary.take(pa.array(code)).cast(pa.binary()),
                    pa.array(total),
                    pa.array(docs.astype(np.int64)),
                ],
                ["lang", "source", "term", "n", "docs"],
            )


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs of every term of every source; ``term`` holds its UTF-8 bytes."""
    size = SLICE_BYTES
    rows = docs.mapInArrow(lambda batches: _term_counts(batches, size), "lang string, source string, term binary, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ---------------------------------------------------------------- prices


def price(count: Column, weight: Column) -> Column:
    """1 + floor(SCALE (count + 1) / weight), exact for any counts."""
    big = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", big, weight.cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); prices are at most SCALE + 1, so squares fit a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def prices(counts: np.ndarray, weight: int) -> np.ndarray:
    if len(counts) and int(counts.max()) >= (1 << 62) // SCALE:
        return np.array([1 + SCALE * (int(c) + 1) // weight for c in counts], np.int64)
    return 1 + SCALE * (counts + 1) // weight


# ---------------------------------------------------------------- level products


class Side:
    """One-hot level columns of the sources of a block over the terms of a cell."""

    def __init__(self, term: np.ndarray, source: np.ndarray, count: np.ndarray, weights: list[int], terms: int):
        level = np.lexsort((count, source))
        term, source, count = term[level], source[level], count[level]
        fresh = np.ones(len(source), bool)
        fresh[1:] = (source[1:] != source[:-1]) | (count[1:] != count[:-1])
        held = np.bincount(source[fresh], minlength=len(weights))
        #: column of each source's level zero; its other levels follow
        self.zero = np.concatenate([[0], np.cumsum(held + 1)])
        column = np.cumsum(fresh) - 1 + source + 1
        self.matrix = np.zeros((terms, self.zero[-1]), np.float32)
        self.matrix[term, column] = 1
        present = np.zeros((terms, len(weights)), np.float32)
        present[term, source] = 1
        self.matrix[:, self.zero[:-1]] = 1 - present
        levels = np.zeros(self.zero[-1], np.int64)
        levels[column] = count
        self.price = np.concatenate([prices(levels[a:b], w) for a, b, w in zip(self.zero[:-1], self.zero[1:], weights)])
        self.source = np.repeat(np.arange(len(weights)), held + 1)


def cell_sums(left: Side, right: Side, absent: int, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Divergence of left sources from right ones, and of right from left if ``both``, over one cell's terms.

    ``absent`` terms of the cell are in no source of either side: level zero in all of them.
    """
    n, m = len(left.zero) - 1, len(right.zero) - 1
    there, back = np.zeros((n, m), np.int64), np.zeros((m, n), np.int64)
    for a in range(n):
        columns = slice(left.zero[a], left.zero[a + 1])
        joint = left.matrix[:, columns].T @ right.matrix
        joint[0, right.zero[:-1]] += absent
        i, j = np.nonzero(joint)
        many, p, q = joint[i, j].astype(np.int64), left.price[columns][i], right.price[j]
        square = (p - q) ** 2
        np.add.at(there[a], right.source[j], square // q * many)
        if both:
            np.add.at(back[:, a], right.source[j], square // p * many)
    return there, back


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells in order: a head row with the sources' weights, then (term, source, count) rows of either side."""
    sums: dict[tuple, tuple] = {}
    head, rows = None, []

    def settle() -> None:
        nonlocal rows
        if head is None:
            return
        lang, a, b, left_weights, right_weights, terms = head
        side, term, source, count = (np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64) for k in range(4))
        rows = []
        known, term = np.unique(term, return_inverse=True)
        make = lambda k, weights: Side(term[side == k], source[side == k], count[side == k], weights, len(known))
        left = make(1, left_weights)
        there, back = cell_sums(left, left if a == b else make(2, right_weights), terms - len(known), a != b)
        if (lang, a, b) in sums:
            there, back = there + sums[lang, a, b][0], back + sums[lang, a, b][1]
        sums[lang, a, b] = there, back

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, a, b), (there, back) in sums.items():
            for low, high, table in ((a, b, there), (b, a, back if a != b else None)):
                if table is None:
                    continue
                i, j = (x.ravel() for x in np.indices(table.shape))
                same = lambda x: pa.array(np.full(table.size, x))
                columns = [pa.array([lang] * table.size, pa.string()), same(low), same(high), pa.array(i), pa.array(j), pa.array(table.ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "i", "j", "value"])
        sums.clear()

    for batch in batches:
        side = batch.column("side").to_numpy()
        heads = np.flatnonzero(side == 0)
        values = [pc.fill_null(batch.column(c), 0).to_numpy() for c in ("term", "number", "n")]
        for low, high in zip([0, *heads.tolist()], [*heads.tolist(), len(side)]):
            if low == high:
                continue
            if side[low] == 0:
                settle()
                row = batch.slice(low, 1).to_pylist()[0]
                head = row["lang"], row["a"], row["b"], row["left_weights"], row["right_weights"], row["n"]
                if sums and head[:3] not in sums:  # cells are sorted by their sources
                    yield from out()
                low += 1
            if low < high:
                rows.append((side[low:high].astype(np.int64), *(v[low:high].astype(np.int64) for v in values)))
    settle()
    yield from out()


def pair_sums(kept: DataFrame, counts: DataFrame, sources: DataFrame) -> DataFrame:
    """lang, a, b and value: the divergence of source number a from b, over all kept terms.

    ``kept`` has lang, term, total and a unique ``id`` of each kept term, ``counts`` lang, term, source and n
    with the term's id and total, ``sources`` lang, source, their ``number`` in the language and ``weight``.
    """
    size, at = F.lit(BLOCK_TERMS[-1][1]), F.floor(F.log2(F.col("total").cast("double"))).cast("int")
    for top, terms in reversed(BLOCK_TERMS[:-1]):
        size = F.when(at < top, F.lit(terms)).otherwise(size)
    classed = lambda df: df.withColumns({"class": at, "size": size})
    classes = classed(kept).groupBy("lang", "class").agg(F.ceil(F.count("*") / F.first("size")).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    terms = classed(kept).join(classes, ["lang", "class"]).groupBy("lang", "class", block).agg(F.count("*").alias("n"))
    part = F.floor(F.col("number") / BLOCK_SOURCES).cast("int")
    weights = F.transform(F.array_sort(F.collect_list(F.struct("number", "weight"))), lambda x: x["weight"])
    parts = sources.withColumn("part", part).groupBy("lang", "part").agg(weights.alias("weights"))
    a = parts.select("lang", F.col("part").alias("a"), F.col("weights").alias("left_weights"))
    b = parts.select("lang", F.col("part").alias("b"), F.col("weights").alias("right_weights"))
    # the grid of blocks: each cell is one product
    heads = terms.join(a, "lang").join(b, "lang").where("a <= b")
    null = lambda kind: F.lit(None).cast(kind)
    heads = heads.select("lang", "class", "block", "a", "b", F.lit(0).alias("side"), null("long").alias("term"), null("int").alias("number"), "n", "left_weights", "right_weights")
    numbered = classed(counts).join(classes, ["lang", "class"]).join(sources.select("lang", "source", "number"), ["lang", "source"])
    last = parts.groupBy("lang").agg(F.max("part").alias("last"))
    own = numbered.select("lang", "class", block, part.alias("part"), F.col("id").alias("term"), F.col("number") % BLOCK_SOURCES, "n").toDF("lang", "class", "block", "part", "term", "number", "n")
    spread = own.join(last, "lang")
    left = spread.withColumn("b", F.explode(F.sequence("part", "last"))).select("lang", "class", "block", F.col("part").alias("a"), "b", F.lit(1).alias("side"), "term", "number", "n")
    right = spread.where("part > 0").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("part") - 1))).select("lang", "class", "block", "a", F.col("part").alias("b"), F.lit(2).alias("side"), "term", "number", "n")
    entries = left.unionByName(right).withColumns({"left_weights": null("array<long>"), "right_weights": null("array<long>")})
    cells = heads.unionByName(entries).repartition("lang", "a", "b", "class", "block").sortWithinPartitions("lang", "a", "b", "class", "block", "side")
    sums = cells.select("side", "lang", "a", "b", "term", "number", "n", "left_weights", "right_weights").mapInArrow(_cells, "lang string, a long, b long, i long, j long, value long")
    whole = lambda block, place: (F.col(block) * BLOCK_SOURCES + F.col(place)).alias(block)
    return sums.groupBy("lang", whole("a", "i"), whole("b", "j")).agg(F.sum("value").alias("value"))


# ---------------------------------------------------------------- audit


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank.

    Part ``pair`` has every other source of the language by falling divergence from it, part ``term``
    the ``TOP_TERMS`` terms that the source prices furthest above its language.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    texts = docs.select(blank("lang"), blank("source"), F.col("text").cast("string").alias("text"))
    found = stage(term_counts(texts), "divergence-counts")
    kept = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
    kept = kept.where(F.col("docs") >= LEAST_DOCS).select("lang", "term", "total", F.monotonically_increasing_id().alias("id"))
    kept = stage(kept, "divergence-kept")
    counts = stage(found.drop("docs").join(kept, ["lang", "term"]), "divergence-levels")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    words = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    sources = texts.select("lang", "source").distinct().join(langs, "lang", "left").join(words, ["lang", "source"], "left")
    sources = sources.select("lang", "source", number.cast("int").alias("number"), (zero(F.col("n")) + zero(F.col("v"))).alias("weight"), (zero(F.col("lang_n")) + zero(F.col("v"))).alias("lang_weight"))
    sources = stage(sources, "divergence-sources")

    a, b = (sources.select("lang", F.col("source").alias(s), F.col("number").alias(n)) for s, n in (("source", "a"), ("item", "b")))
    pairs = a.join(b, "lang").where("a <> b").join(pair_sums(kept, counts, sources), ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit(PAIR).alias("part"), "item", zero(F.col("value")).alias("value"))
    rank = lambda item: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), item)).alias("rank")
    pairs = pairs.select("*", rank("item"))

    priced = counts.join(sources, ["lang", "source"]).select("lang", "source", "term", price(F.col("n"), F.col("weight")).alias("p"), price(F.col("total"), F.col("lang_weight")).alias("q"))
    over = priced.where("p > q").select("lang", "source", F.lit(TERM).alias("part"), F.col("term").cast("string").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    over = over.select("*", rank("item")).where(F.col("rank") <= TOP_TERMS)
    return pairs.unionByName(over).withColumn("rank", F.col("rank").cast("int"))
