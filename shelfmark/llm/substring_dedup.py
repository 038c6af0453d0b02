"""Repeated passages by compact windows.

A text is a sequence of five-word shingles. For each of ``HASHES`` hash functions the Cartesian tree over
the sequence's hashes gives compact windows: position c with bounds l and r, such that every subsequence
between l and r that holds c has its minimum there. Only windows of at least a passage's length count;
they are the top of the tree, and their number is about two per passage length. Documents with windows of
one function at an equal shingle share the minimum of all subsequences that fit both windows.

Windows meet by that shingle: in each batch of rows first, where all but the least document become pairs
with it, then among the batches' least ones, so a passage that a third of all documents hold moves as
many rows as there are batches. Every pair of documents with a window that leaves room for a passage is
verified on the shingles of the part that its windows span: passages are the
stretches of at least ``MIN_WORDS`` words with a Jaccard similarity of 0.75 or more, of which at least 6
in 7 shingles are shared, or 3 in 4 where words were put in. Windows outside the passages found, which may have met another document than
the one they share a passage with, meet again by their shingle and a second one 22 places before or after
it, one of which every such passage holds.

A null or short text has no passages. Rows with one doc_id are one document, rows without are left out.
Repeated documents are one long passage. Passages are counted in words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm import words as W
from shelfmark.llm.tables import forget, freed, stage, with_narrow

MIN_WORDS = 50
HASHES = 5
#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 19
#: Bytes of a shingle's hash that are moved: two of one pair's shingles agree by chance once in 2**48.
MOVED = 6
#: Documents with lists of positions or cuts that may be broadcast.
BROADCAST_LISTS = 200_000
PERCENT = 75
#: A shingle not shared costs as much as so many shared ones gain: a share of 6 in 7 is a Jaccard similarity of 0.75.
COST = 6

_SEEDS = W.mix(np.arange(101, 101 + HASHES, dtype=np.uint64)) | np.uint64(1)


def window_minima(value: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the (leftmost) minimum of some window of ``width`` within one text.

    The low bits of a value give way to its position, so the minimum of a window tells where it is and the
    leftmost of equal values is the least. Values that agree in all other bits (44 for a slice) count as equal.
    """
    n = len(value)
    if n < width:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << n.bit_length()) - 1)
    least, have = (value & ~low) | np.arange(n, dtype=np.uint64), 1
    while have < width:
        shift = min(have, width - have)
        least = np.minimum(least[:-shift], least[shift:])
        have += shift
    at = (least[doc[width - 1 :] == doc[: n - width + 1]] & low).astype(np.int64)
    new = np.ones(len(at), bool)  # the minimum of a later window does not stand earlier
    np.not_equal(at[1:], at[:-1], out=new[1:])
    return at[new]


def _run_before(value: np.ndarray, room: np.ndarray, equal: bool) -> np.ndarray:
    """How many of the ``room`` values right before each one are greater than it, or with ``equal`` at least it,
    without a gap; found by halving over the minima of stretches of 1, 2, 4, … values."""
    least = [value]
    for k in range(int(room.max(initial=0)).bit_length() - 1):
        least.append(np.minimum(least[k][: -(1 << k)], least[k][1 << k :]))
    run = np.zeros(len(value), np.int64)
    place = np.arange(len(value))
    for k in range(len(least) - 1, -1, -1):
        some = np.flatnonzero(run + (1 << k) <= room)
        stretch = least[k][place[some] - run[some] - (1 << k)]
        run[some[stretch >= value[some] if equal else stretch > value[some]]] += 1 << k
    return run


def bounds(position: np.ndarray, value: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right bounds of the windows at the given positions: up to a value as small before, and a smaller one after.

    The nearest smaller values on both sides are themselves minima of windows as long, so the given
    positions are enough.
    """
    n, place = len(position), np.arange(len(position))
    first, last = np.searchsorted(doc, doc), np.searchsorted(doc, doc, "right")
    before = place - 1 - _run_before(value, place - first, equal=False)
    after = place + 1 + _run_before(value[::-1], (last - 1 - place)[::-1], equal=True)[::-1]
    left = np.where(before >= first, position[np.maximum(before, 0)] + 1, begin[doc])
    right = np.where(after < last, position[np.minimum(after, n - 1)], end[doc]) - 1
    return left, right


def compact_windows(token: np.ndarray, begin: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(function, position, text, left, right) of all windows of at least ``width`` shingles."""
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    for k, seed in enumerate(_SEEDS):
        value = (token ^ seed) * seed
        at = window_minima(value, doc, width)
        yield k, at, doc[at], *bounds(at, value[at], doc[at], begin[:-1], begin[1:])


def sequences(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    return W.shingles(words.hashes(), words.first)


def window_rows(docs: DataFrame, width: int) -> DataFrame:
    """Windows that may meet windows of other batches, and pairs that have met within one.

    ``x`` holds the position and the room to its left; ``y`` the room to its right and, if ``lead`` is
    set, before it the position in that document. The room of a pair is what both windows have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            parts: list[list[np.ndarray]] = [[], [], [], [], []]
            for low, _, words in W.word_slices(batch.column("text"), lower=True, limit=SLICE_BYTES):
                token, begin = sequences(words)
                for k, at, doc, left, right in compact_windows(token, begin, width):
                    key = W.mix(token[at] + np.uint64(k + 1))
                    places = ((at - begin[doc]).astype(np.int32), (at - left).astype(np.int32), (right - at).astype(np.int32))
                    for part, x in zip(parts, (key, ids[doc + low], *places), strict=True):
                        part.append(x)
            if not parts[0]:
                continue
            key, doc, at, left, right = (np.concatenate(parts.pop(0)) for _ in range(5))
            order = np.lexsort((at, doc, key))
            key, doc = key[order], doc[order]
            at, left, right = (x[order].astype(np.int64) for x in (at, left, right))
            del order, parts
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else np.zeros(0, np.int64)
            met = doc != doc[lead]
            both = np.minimum(left, left[lead])[met], np.minimum(right, right[lead])[met]
            x, names = (at << 32) | left, ["key", "doc", "x", "y", "lead"]
            some = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([W.signed(key[some]), pa.array(doc[some]), pa.array(x[some]), pa.array(right[some]), pa.nulls(len(some), pa.int64())], names)
            some = np.flatnonzero(met)
            spread = W.signed(W.mix(key[some] + W.mix(doc[some].astype(np.uint64))))
            yield pa.RecordBatch.from_arrays([spread, pa.array(doc[some]), pa.array((at[some] << 32) | both[0]), pa.array((at[lead[some]] << 32) | both[1]), pa.array(doc[lead[some]])], names)

    return docs.select("doc_id", "text").mapInArrow(freed(run), "key long, doc long, x long, y long, lead long")


def meetings(docs: DataFrame, width: int) -> DataFrame:
    """doc, lead (a lesser document with an equal minimum), their positions ``at`` and ``lead_at``, and the
    room that both windows have to the left and right."""
    rows = window_rows(docs, width)
    # a key has one row per batch at most, whatever the number of its documents
    least = F.min(F.struct("doc", "x", "y")).over(Window.partitionBy("key"))
    rows = rows.withColumn("least", F.when(F.col("lead").isNull(), least))
    apart = rows.where(F.col("lead").isNotNull() | (F.col("doc") != F.col("least.doc")))
    low = lambda c: F.col(c).bitwiseAND(0xFFFFFFFF)
    own = F.col("lead").isNotNull()
    return apart.select(
        "doc", F.coalesce("lead", "least.doc").alias("lead"), F.shiftright("x", 32).cast("int").alias("at"),
        F.when(own, F.shiftright("y", 32)).otherwise(F.shiftright("least.x", 32)).cast("int").alias("lead_at"),
        F.when(own, low("x")).otherwise(F.least(low("x"), low("least.x"))).cast("int").alias("left"),
        F.when(own, low("y")).otherwise(F.least(low("y"), low("least.y"))).cast("int").alias("right"),
    )


def shared_stretches(shared: np.ndarray, width: int, cost: int = COST) -> list[tuple[int, int]]:
    """Stretches [i, j) of at least ``width`` flags, by default with at least 6 in 7 set, found run by run."""
    if not shared.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[False], shared, [False]]).astype(np.int8)))
    # stretches so far, none of which gains by joining the one before: score before and after, first and last flag
    kept: list[tuple[int, int, int, int]] = []
    score, last = 0, 0
    for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        before = score - cost * (i - last)
        score, last = before + j - i, j
        start = i
        while True:
            n = next((n for n in range(len(kept) - 1, -1, -1) if kept[n][0] < before), -1)
            if n < 0 or kept[n][1] >= score:
                kept.append((before, score, start, j))
                break
            before, start = kept[n][0], kept[n][2]
            del kept[n:]
    return [(i, j) for _, _, i, j in kept if j - i >= width]


def longest_around(shared: np.ndarray, cost: int) -> Callable[[int], tuple[int, int]]:
    """The longest stretch [i, j) around a given set flag in which each unset flag is paid by ``cost`` set ones.

    What does not depend on the given flag is computed once.
    """
    total = np.concatenate([[0], np.cumsum(np.where(shared, 1, -cost))])
    lowest = np.flatnonzero(total < np.concatenate([[1 << 62], np.minimum.accumulate(total)[:-1]]))
    falling = -np.maximum.accumulate(total[::-1])[::-1]  # the best end from here on, negative
    wanted = -total[lowest]
    flags = np.flatnonzero(shared)

    def around(at: int) -> tuple[int, int]:
        most = lowest.searchsorted(at, "right")
        end = at + falling[at + 1 :].searchsorted(wanted[:most], "right")
        n = int(np.where(end > at, end - lowest[:most], -1).argmax())
        i, j = flags.searchsorted(lowest[n]), flags.searchsorted(end[n])
        return (int(flags[i]), int(flags[j - 1]) + 1) if i < j else (at, at)

    return around


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array. A pair's parts are short, and numpy's set functions sort them several times."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _distinct(values: np.ndarray) -> np.ndarray:
    ordered = np.sort(values)
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return ordered[new]


def passages_of(own: np.ndarray, other: np.ndarray, at: np.ndarray, lead_at: np.ndarray, width: int) -> list[tuple[int, int, int, int, float]]:
    """(start, end, other start, other end, similarity) in shingles of the passages that a pair shares
    around the positions of common minima."""
    diagonal = lead_at - at
    solved = np.zeros(len(at), bool)
    found = []

    def holds(i: int, j: int, low: int, high: int) -> bool:
        if j - i == high - low and np.array_equal(own[i:j], other[low:high]):
            found.append((i, j, low, high, 1.0))
            solved[(at >= i) & (at < j)] = True
            return True
        a, b = _distinct(own[i:j]), _distinct(other[low:high])
        common = int(np.count_nonzero(_among(a, b)))
        enough = common * 100 >= PERCENT * (len(a) + len(b) - common)
        if enough:
            found.append((i, j, low, high, common / (len(a) + len(b) - common)))
            solved[(at >= i) & (at < j)] = True
        return enough

    def ends(i: int, j: int, d: int) -> tuple[int, int]:
        """The other text's part from the place of the first shingle to that of the last, as near as can be to a diagonal."""
        first, last = np.flatnonzero(other == own[i]), np.flatnonzero(other == own[j - 1])
        return int(first[np.abs(first - i - d).argmin()]), int(last[np.abs(last - j + 1 - d).argmin()]) + 1

    shared = _among(own, np.sort(other))
    if np.count_nonzero(shared) * 100 < PERCENT * width:  # too few for any passage
        return found
    for i, j in shared_stretches(shared, width):
        use = (at >= i) & (at < j)
        if use.any():
            holds(i, j, max(0, int(diagonal[use].min()) + i), min(len(other), int(diagonal[use].max()) + j))
    # where texts repeat within a document, or parts stand in another order, each diagonal is looked at alone
    for d in np.unique(diagonal[~solved]).tolist():
        low, high = max(0, -d), min(len(own), len(other) - d)
        equal = own[low:high] == other[low + d : high + d]
        for i, j in shared_stretches(equal, width):
            if ((diagonal == d) & ~solved & (at >= low + i) & (at < low + j)).any() and not holds(low + i, low + j, low + i + d, low + j + d):
                for a, b in shared_stretches(equal[i:j], width, j - i):  # its parts without a gap
                    holds(low + i + a, low + i + b, low + i + a + d, low + i + b + d)
    # a change in the middle of a short passage costs more than either half gains, and words put in or left
    # out move the other end; 3 in 4 shingles are shared at least where words are put in only
    tried = set()
    rest = np.flatnonzero(~solved).tolist()
    arounds = [cache(longest_around(shared, cost)) for cost in (COST, 3)] if rest else []
    for n in rest:
        for around in arounds:
            if solved[n]:
                break
            i, j = around(int(at[n]))
            if j - i < width:
                continue
            span = (i, j, *ends(i, j, int(diagonal[n])))
            if span not in tried and span[2] < span[3]:
                tried.add(span)
                holds(*span)
    return found


_PASSAGE = "doc_id long, start int, end int, match_doc_id long, match_start int, match_end int, similarity double"


def candidates(met: DataFrame, width: int) -> DataFrame:
    """Pairs with a common minimum that leaves room for the shingles a passage shares, and the parts they span.

    Where words are put in or left out, the room that both windows have is that of the shared shingles
    only, at least ``PERCENT`` of a passage. A part is longer than the windows by two passages on each
    side: near copies go on past a minimum that only one of them has.
    """
    roomy = met.where(F.col("left") + F.col("right") + 1 >= -(-PERCENT * width // 100))
    left, right = F.col("left") + 2 * width, F.col("right") + 2 * width
    return roomy.groupBy("doc", "lead").agg(
        F.collect_list(F.struct("at", "lead_at")).alias("anchors"),
        F.greatest(F.min(F.col("at") - left), F.lit(0)).alias("low"), F.max(F.col("at") + right).alias("high"),
        F.greatest(F.min(F.col("lead_at") - left), F.lit(0)).alias("lead_low"), F.max(F.col("lead_at") + right).alias("lead_high"),
    )


def unpacked(raw: np.ndarray) -> np.ndarray:
    """Shingles of a packed sequence."""
    wide = np.zeros((len(raw) // MOVED, 8), np.uint8)
    wide[:, :MOVED] = raw.reshape(-1, MOVED)
    return wide.view("<i8")[:, 0]


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of packed sequences, and where each begins."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, raw = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), at


def verified(pairs: DataFrame, full: DataFrame, width: int) -> DataFrame:
    """Passages of candidate pairs. Only the spanned parts of sequences are moved with a pair."""
    most = F.lit(1 << 28)  # no text has as many words, and the bytes still count as an int
    part = lambda low, high: F.substring("tokens", F.col(low) * MOVED + 1, F.least(F.col(high) - F.col(low) + 1, most) * MOVED)
    both = pairs.join(full.withColumnRenamed("doc_id", "doc"), "doc").withColumn("own", part("low", "high")).drop("tokens")
    both = both.join(full.withColumnRenamed("doc_id", "lead"), "lead").withColumn("other", part("lead_low", "lead_high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in _PASSAGE.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
        size = W.SHINGLE - 1
        for batch in batches:
            rows: list[tuple] = []
            doc, lead, low, lead_low = (batch.column(c).to_pylist() for c in ("doc", "lead", "low", "lead_low"))
            if not len(batch):
                continue
            (own, own_at), (other, other_at) = packed(batch.column("own")), packed(batch.column("other"))
            anchors = batch.column("anchors")
            ats, lead_ats = (anchors.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            first = anchors.offsets.to_numpy().astype(np.int64)
            first = (first - first[0]).tolist()
            for n in range(len(batch)):
                mine = slice(first[n], first[n + 1])
                sides = unpacked(own[own_at[n] : own_at[n + 1]]), unpacked(other[other_at[n] : other_at[n + 1]])
                found = passages_of(*sides, ats[mine] - low[n], lead_ats[mine] - lead_low[n], width)
                rows += [(doc[n], low[n] + i, low[n] + j + size, lead[n], lead_low[n] + a, lead_low[n] + b + size, s) for i, j, a, b, s in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names)

    return both.select("doc", "lead", "anchors", "low", "lead_low", "own", "other").mapInArrow(freed(run), _PASSAGE)


def second_shingles(docs: DataFrame, met: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """doc_id, at, and the shingle there paired with those ``after`` and ``before`` it: of met windows
    outside passages, and of all windows that they or others met."""
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    own = met.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set("at").alias("places"))
    inside = lambda p: F.exists("spans", lambda s: (s["start"] <= p) & (p <= s["end"] - W.SHINGLE))
    open_ = F.filter("places", lambda p: ~F.coalesce(inside(p), F.lit(False)))
    own = own.join(spans, "doc_id", "left").select("doc_id", F.explode(open_).alias("at"))
    leads = met.select(F.col("lead").alias("doc_id"), F.col("lead_at").alias("at"))
    wanted = own.union(leads).groupBy("doc_id").agg(F.collect_set("at").alias("places"))
    far = (width - 2) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, words in W.word_slices(batch.column("text"), lower=True, limit=SLICE_BYTES):
                token, begin = sequences(words)
                rows = batch.slice(low, high - low)
                lists = rows.column("places")
                row = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
                at = lists.flatten().to_numpy().astype(np.int64)
                place = begin[row] + at
                inside = place < begin[row + 1]
                row, at, place = row[inside], at[inside], place[inside]
                pairs = []
                for step in (far, -far):
                    second = place + step
                    there = (second >= begin[row]) & (second < begin[row + 1])
                    pair = W.mix(W.mix(token[place]) + token[np.where(there, second, place)])
                    pairs.append(pa.array(pair.view(np.int64), mask=~there))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(row)), pa.array(at.astype(np.int32)), *pairs], ["doc_id", "at", "after", "before"])

    marked = with_narrow(docs, stage(wanted, "passages-open"), "doc_id", rows=BROADCAST_LISTS).select("doc_id", "text", "places")
    return marked.mapInArrow(freed(run), "doc_id long, at int, after long, before long")


def _again(rest: DataFrame, by: str) -> DataFrame:
    """Pairs of windows outside passages that agree in the second shingle as well; their room is not known."""
    rows = rest.where(F.col(by).isNotNull()).select("doc_id", "at", by)
    least = rows.groupBy(by).agg(F.min(F.struct("doc_id", "at")).alias("l"))
    pairs = rows.join(least, by).where(F.col("doc_id") != F.col("l.doc_id"))
    room = F.lit(1 << 29)
    return pairs.select(F.col("doc_id").alias("doc"), F.col("l.doc_id").alias("lead"), "at", F.col("l.at").alias("lead_at"), room.alias("left"), room.alias("right"))


def token_sequences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and all shingles in order, packed, of the documents of a staged list of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, words in W.word_slices(batch.column("text"), lower=True, limit=SLICE_BYTES):
                token, begin = sequences(words)
                raw = np.ascontiguousarray(token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :MOVED])
                tokens = pa.BinaryArray.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer((begin * MOVED).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), tokens], ["doc_id", "tokens"])

    return with_narrow(docs, wanted, "doc_id").select("doc_id", "text").mapInArrow(freed(run), "doc_id long, tokens binary")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per passage of a document that a document with a lesser id holds as well.

    doc_id, start and end (words, end excluded), match_doc_id, match_start, match_end, similarity.
    """
    width = min_words - W.SHINGLE + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    met = stage(meetings(rows, width), "passages-met")
    forget(docs.sparkSession)  # the windows themselves

    def check(pairs: DataFrame, name: str) -> DataFrame:
        pairs = stage(pairs, f"{name}-pairs")
        ids = stage(pairs.select(F.col("doc").alias("doc_id")).union(pairs.select("lead")).distinct(), f"{name}-ids")
        found = stage(verified(pairs, token_sequences(rows, ids), width), name)
        forget(docs.sparkSession)  # sequences and their parts
        return found

    first = check(candidates(met, width), "passages-first")
    rest = stage(second_shingles(rows, met, first, width), "passages-rest")
    second = check(candidates(_again(rest, "after").union(_again(rest, "before")), width), "passages-second")
    return first.union(second).distinct()


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Documents with their repeated passages cut out; those left without words go.

    The text between a passage's first word and the next word after it is cut; all else stays. The
    columns are the documents' own; ``n_chars``, if there, is the new length.
    """
    cuts = stage(passages.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("__cuts")), "passages-cuts")
    names = docs.columns
    marked = with_narrow(docs, cuts, "doc_id", "left", BROADCAST_LISTS).select(*names, "__cuts")
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            left = np.ones(len(batch), bool)
            for low, _, words in W.word_slices(batch.column("text")):
                for d in range(words.rows):
                    cuts = batch.column("__cuts")[low + d].as_py()
                    if not cuts:
                        continue
                    base, stop = words.first[d], words.first[d + 1]
                    gone = np.zeros(stop - base, bool)
                    for cut in cuts:
                        gone[cut["start"] : cut["end"]] = True
                    raw = words.raw[words.at[d] : words.at[d + 1]].tobytes()
                    start = (words.start[base:stop] - words.at[d]).tolist() + [len(raw)]
                    edge = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
                    kept = [raw[: start[0]]] if not gone[0] else []
                    kept += [raw[start[a] : start[b]] for a, b in zip(edge[::2], edge[1::2], strict=True)]
                    texts[low + d] = b"".join(kept).decode("utf-8", "replace")
                    left[low + d] = not gone.all()
            new = pa.array(texts, pa.string())
            columns = {c: batch.column(c) for c in names} | {"text": new}
            if "n_chars" in columns:
                columns["n_chars"] = pc.utf8_length(new).cast(batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names).filter(pa.array(left))

    return marked.mapInArrow(freed(run), ", ".join(f"`{c}` {kinds[c]}" for c in names))
