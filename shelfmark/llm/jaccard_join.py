"""N-gram Jaccard join with a token-group matrix.

A document is the set of its distinct five-word shingles. Similar documents are put into groups, and
each group stores the union of its members' tokens, as rows of (token, group). The tokens that two
groups share bound the overlap of any two of their documents; only groups whose bound can reach the
threshold are opened and their documents compared, exactly.

What keeps the matrix small, all of it exact:

- equal sets are one class with one representative;
- representatives that min-hash bands bring together are compared with a leader of their bucket first,
  in large buckets again and again, and those linked form clusters: links inside a cluster are not sought
  again, and clusters, cut into slices of ``GROUP_ROWS``, are the groups;
- two sets with Jaccard similarity t share one of the first n - ceil(t n) + 1 tokens of each, in any
  common order; tokens found to be frequent come last in that order, and only such prefixes enter the
  matrix. With k shared prefix tokens, two sets can share no more than k and what follows the prefix.

A null or empty text has the empty set and is linked with nothing. Rows with one doc_id are one
document, which their links reach from each of its texts; rows without get no component. Every row given
gets its row, repeated ones too. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import words as W
from shelfmark.llm.components import components
from shelfmark.llm.tables import freed, stage, with_narrow

#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 20
#: Linked if PERCENT of the union's size is shared.
PERCENT = 75
BANDS, BAND_ROWS = 8, 3
ROUNDS = 2
GROUP_ROWS = 64
#: A bucket with many clusters goes on while a turn leaves no more than this part of them.
LEFT = 15 / 16
#: Tokens found this often in one batch of rows, and so many in all, are put last in prefixes.
FREQUENT_IN_BATCH = 3
FREQUENT_TOKENS = 500_000

_SEEDS = W.mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def sets(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, one text after the other, and where each begins."""
    value, begin = W.shingles(words.hashes(), words.first)
    doc = np.repeat(np.arange(words.rows), np.diff(begin))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.searchsorted(doc[new], np.arange(words.rows + 1))


def _reduce(how: np.ufunc, values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A reduction per text; 0 for texts without tokens."""
    out = np.zeros(len(begin) - 1, np.uint64)
    some = np.diff(begin) > 0
    if some.any():
        out[some] = how.reduceat(values, begin[:-1][some])
    return out


def _digest(token: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """128 bits of each text's set."""
    return [_reduce(np.add, W.mix(token ^ np.uint64(salt)), begin) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]


def profiles(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, n (set size), hi and lo (digest of the set) and the min-hash band keys of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, words in W.word_slices(batch.column("text"), lower=True, limit=SLICE_BYTES):
                token, begin = sets(words)
                digest = _digest(token, begin)
                least = [_reduce(np.minimum, (token ^ seed) * seed, begin) for seed in _SEEDS]
                bands = np.zeros((words.rows, BANDS), np.uint64)
                for b in range(BANDS):
                    for r in range(BAND_ROWS):
                        bands[:, b] = W.mix(bands[:, b] + least[b * BAND_ROWS + r])
                    bands[:, b] = W.mix(bands[:, b] + np.uint64(b))
                columns = [*(batch.column(c).slice(low, high - low) for c in carry), pa.array(np.diff(begin)), W.signed(digest[0]), W.signed(digest[1])]
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(words.rows + 1) * BANDS, pa.int32()), W.signed(bands.ravel())))
                yield pa.RecordBatch.from_arrays(columns, [*carry, "n", "hi", "lo", "bands"])

    ids = ", ".join(f"{c} long" for c in carry)
    return docs.select(*carry, "text").mapInArrow(freed(run), f"{ids}, n long, hi long, lo long, bands array<long>")


def _own_texts(batch: pa.RecordBatch, low: int, token: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Which texts of a slice are their class's: those of a doc_id that has several texts tell them by ``check``."""
    check = batch.column("check").slice(low, len(begin) - 1)
    if check.null_count == len(check):
        return np.ones(len(begin) - 1, bool)
    hi = _digest(token, begin)[0].view(np.int64)
    return np.asarray(check.is_null()) | (check.fill_null(0).to_numpy() == hi)


def token_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, n and tokens of staged classes (rep, doc_id, check)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, words in W.word_slices(batch.column("text"), lower=True, limit=SLICE_BYTES):
                token, begin = sets(words)
                tokens = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), W.signed(token))
                rows = pa.RecordBatch.from_arrays([batch.column("rep").slice(low, high - low), pa.array(np.diff(begin)), tokens], ["rep", "n", "tokens"])
                own = _own_texts(batch, low, token, begin)
                yield rows if own.all() else rows.filter(pa.array(own))

    # equal rows of one doc_id give equal sets
    told = with_narrow(docs, wanted, "doc_id").select("rep", "check", "text")
    return told.mapInArrow(freed(run), "rep long, n long, tokens array<long>").dropDuplicates(["rep"])


def linked(a: str, b: str) -> F.Column:
    """Whether two sets reach the threshold, by exact overlap of their token arrays."""
    shared = F.size(F.array_intersect(F.col(f"{a}.tokens"), F.col(f"{b}.tokens")))
    return shared * 100 >= (F.col(f"{a}.n") + F.col(f"{b}.n") - shared) * PERCENT


def like_sizes(a: F.Column, b: F.Column) -> F.Column:
    return (a * 100 >= b * PERCENT) & (b * 100 >= a * PERCENT)


def clusters(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Representatives brought together by bands: (rep, first leader), and (rep, cluster) by exact links.

    In each turn every bucket has a leader, each representative is compared with one leader of another
    cluster, and the clusters that links connect become one. Buckets that still hold more clusters than a
    group holds rows go on: there each representative is compared with the leaders of all its buckets, until a
    turn leaves a bucket almost as it was. A large group of like texts so becomes one cluster with a number of
    comparisons in proportion to its size, and not all of its pairs are sought and told as links.
    """
    bands = classes.select("rep", F.explode("bands").alias("band")).distinct()
    shared = bands.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("rows")).where("low < high")
    shared = shared.select("band", F.col("low").alias("leader"), (F.col("rows") > GROUP_ROWS).alias("large"))
    near = stage(bands.join(shared, "band").select("band", "rep", "leader", "large"), "jaccard-near")
    leaders = near.groupBy("rep").agg(F.min("leader").alias("leader"))
    own = stage(near.select("rep", F.col("rep").alias("cluster")).distinct(), "jaccard-clusters")
    if own.isEmpty():
        return leaders, own
    full = stage(token_sets(docs, stage(classes.select("rep", "doc_id", "check").join(own.select("rep"), "rep"), "jaccard-near-docs")), "jaccard-near-sets")
    for turn in range(ROUNDS):
        pairs = to_leaders(near, own, F.xxhash64("rep", F.lit(turn)))
        pairs = pairs.groupBy("rep", "cluster").agg(F.min(F.struct("o", "leader", "of")).alias("c")).select("rep", "cluster", "c.leader", "c.of")
        own = stage(merged(own, links_to(full, pairs)), "jaccard-clusters")
    large, turn = near.where("large").select("band", "rep"), ROUNDS
    crowded = stage(clusters_held(large, own), "jaccard-crowded")
    while not crowded.isEmpty():
        rows = large.join(crowded.select("band"), "band")
        pairs = to_leaders(rows, own, F.xxhash64("rep", "band", F.lit(turn))).select("rep", "cluster", "leader", "of").distinct()
        own = stage(merged(own, links_to(full, pairs)), "jaccard-clusters")
        left = clusters_held(rows, own).withColumnRenamed("held", "still").join(crowded, "band")
        crowded = stage(left.where(F.col("still") <= F.col("held") * LEFT).select("band", F.col("still").alias("held")), "jaccard-crowded")
        turn += 1
    return leaders, own


def to_leaders(near: DataFrame, own: DataFrame, order: F.Column) -> DataFrame:
    """Representatives with each bucket's leader, the least in an order, where that is of another cluster."""
    rows = near.select("band", "rep").join(own, "rep")
    rank = F.struct(order.alias("o"), F.col("rep").alias("leader"), F.col("cluster").alias("of"))
    chief = rows.groupBy("band").agg(F.min(rank).alias("c")).select("band", F.col("c.o").alias("o"), F.col("c.leader").alias("leader"), F.col("c.of").alias("of"))
    return rows.join(chief, "band").where(F.col("cluster") != F.col("of"))


def links_to(full: DataFrame, pairs: DataFrame) -> DataFrame:
    """Clusters (a, b) of the representatives that are linked with their leaders."""
    found = pairs.alias("p").join(full.alias("a"), F.col("p.rep") == F.col("a.rep")).join(full.alias("b"), F.col("leader") == F.col("b.rep"))
    found = found.where(like_sizes(F.col("a.n"), F.col("b.n"))).where(linked("a", "b"))
    return found.select(F.col("cluster").alias("a"), F.col("of").alias("b"))


def clusters_held(near: DataFrame, own: DataFrame) -> DataFrame:
    """(band, held) of the buckets with more clusters than a group has rows."""
    return near.join(own, "rep").groupBy("band").agg(F.countDistinct("cluster").alias("held")).where(F.col("held") > GROUP_ROWS)


def merged(own: DataFrame, edges: DataFrame) -> DataFrame:
    """(rep, cluster) after the clusters that edges (a, b) connect have become one."""
    joined = components(edges).select(F.col("node").alias("cluster"), "component")
    return own.join(joined, "cluster", "left").select("rep", F.coalesce("component", "cluster").alias("cluster"))


def groups(classes: DataFrame, leaders: DataFrame, own: DataFrame) -> DataFrame:
    """Every representative's group, with the group's least and largest set, and its cluster if it has just one."""
    rows = classes.select("rep", "doc_id", "check", "n").join(leaders, "rep", "left").join(own, "rep", "left")
    rows = rows.withColumn("cluster", F.coalesce("cluster", "rep"))
    alone = F.col("cluster") == F.col("rep")
    first = F.when(alone, F.coalesce("leader", "rep")).otherwise(F.col("cluster"))
    alike = F.floor(F.log("n") / np.log(1.12))
    key = F.xxhash64(first, alike)
    # only keys with more rows than a group holds have to be cut; they are few
    size = stage(rows.withColumn("key", key).groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > GROUP_ROWS), "jaccard-sizes")
    rows = rows.withColumn("key", key).join(size, "key", "left")
    cut = F.pmod(F.xxhash64("rep"), F.ceil(F.coalesce("rows", F.lit(1)) / GROUP_ROWS))
    rows = rows.withColumn("gid", F.xxhash64("key", cut)).select("rep", "doc_id", "check", "gid", "cluster", "n")
    info = rows.groupBy("gid").agg(
        F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min("cluster").alias("c_min"), F.max("cluster").alias("c_max"), F.count("*").alias("rows")
    ).where("rows > 1")
    many = F.col("n_min").isNotNull()
    return rows.join(info, "gid", "left").select(
        "rep", "doc_id", "check", "gid", "cluster", F.coalesce("n_min", "n").alias("n_min"), F.coalesce("n_max", "n").alias("n_max"),
        many.alias("many"), F.when(F.col("c_min") == F.col("c_max"), F.col("c_min")).alias("uniform"),
    )


def frequent_tokens(docs: DataFrame) -> np.ndarray:
    """Tokens that several documents of one batch have; at most ``FREQUENT_TOKENS``, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [np.zeros(0, np.uint64), *(sets(words)[0] for _, _, words in W.word_slices(batch.column("text"), lower=True, limit=SLICE_BYTES))]
            token = np.concatenate(every)
            del every
            token.sort()
            more = FREQUENT_IN_BATCH - 1
            token, n = np.unique(token[: len(token) - more][token[: len(token) - more] == token[more:]], return_counts=True)
            yield pa.RecordBatch.from_arrays([W.signed(token), pa.array(n + more)], ["token", "n"])

    found = docs.select("text").mapInArrow(freed(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= 2 * FREQUENT_IN_BATCH)
    listed = found.orderBy(F.desc("n"), "token").limit(FREQUENT_TOKENS).toPandas()["token"].to_numpy(np.int64)
    return np.sort(listed.view(np.uint64))


def prefixes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Rows of the token-group matrix: token, gid, sizes of the group's sets, and its cluster if it has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gid", "n_min", "n_max", "uniform"]
        for batch in batches:
            for low, _, words in W.word_slices(batch.column("text"), lower=True, limit=SLICE_BYTES):
                token, begin = sets(words)
                n = np.diff(begin)
                doc = np.repeat(np.arange(words.rows), n)
                own = _own_texts(batch, low, token, begin)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)
                    order = np.lexsort((frequent[at] == token, doc))  # stable: ascending tokens stay so
                    token = token[order]
                place = np.arange(len(token)) - begin[doc]
                kept = (place <= (n - (n * PERCENT + 99) // 100)[doc]) & own[doc]
                rows = pa.array(doc[kept] + low)
                yield pa.RecordBatch.from_arrays([W.signed(token[kept]), *(batch.column(c).take(rows) for c in names)], ["token", *names])

    return docs.mapInArrow(freed(run), "token long, gid long, n_min long, n_max long, uniform long")


def opened(matrix: DataFrame) -> DataFrame:
    """Pairs of groups whose shared tokens leave room for two linked documents of different clusters."""
    sizes = F.shiftleft("n_min", 32).bitwiseOR(F.col("n_max"))
    rows = matrix.select("token", "gid", sizes.alias("sizes"), "uniform").repartition("token").dropDuplicates(["token", "gid"])
    side = lambda s: rows.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("gid", "sizes", "uniform")))
    apart = F.coalesce(F.col("uniform_a") != F.col("uniform_b"), F.lit(True))
    pairs = side("a").join(side("b"), "token").where((F.col("gid_a") < F.col("gid_b")) & apart)
    shared = pairs.groupBy("gid_a", "gid_b", "sizes_a", "sizes_b").agg(F.count("*").alias("k"))
    low = lambda s: F.shiftright(f"sizes_{s}", 32)
    high = lambda s: F.col(f"sizes_{s}").bitwiseAND(0xFFFFFFFF)
    # of n tokens ceil(t n) - 1 follow the prefix; an overlap of t / (1 + t) of both sizes is needed
    rest = F.ceil(F.greatest(high("a"), high("b")) * PERCENT / 100) - 1
    needed = (low("a") + low("b")) * PERCENT / (100 + PERCENT)
    reach = (high("a") * 100 >= low("b") * PERCENT) & (high("b") * 100 >= low("a") * PERCENT)
    return shared.where(reach & (F.col("k") + rest >= needed - 1e-6)).select("gid_a", "gid_b")


def links_between(docs: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Clusters (a, b) of opened groups between whose documents there is an exact link."""
    wanted = pairs.select(F.col("gid_a").alias("gid")).union(pairs.select("gid_b")).distinct()
    inside = stage(members.select("rep", "doc_id", "check", "gid", "cluster").join(wanted, "gid", "left_semi"), "jaccard-members")
    full = stage(token_sets(docs, inside.select("rep", "doc_id", "check")).join(inside.select("rep", "gid", "cluster"), "rep"), "jaccard-sets")
    left = pairs.join(full.alias("a"), F.col("gid_a") == F.col("a.gid"))
    new = (F.col("a.cluster") != F.col("b.cluster")) & ((F.col("gid_a") != F.col("gid_b")) | (F.col("a.rep") < F.col("b.rep")))
    both = left.join(full.alias("b"), (F.col("gid_b") == F.col("b.gid")) & new & like_sizes(F.col("a.n"), F.col("b.n")))
    return both.where(linked("a", "b")).select(F.col("a.cluster").alias("a"), F.col("b.cluster").alias("b")).distinct()


def text_clusters(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(carried columns, n, hi, lo) of every row, and (hi, lo, cluster, doc_id) of every set that rows with a
    doc_id have: sets whose links connect them have one cluster; doc_id is the least of the set's rows.

    ``carry`` names long columns, doc_id among them.
    """
    texts = docs.select("doc_id", "text")
    seen = stage(profiles(docs, carry), "jaccard-profiles")
    named = seen.where("n > 0 and doc_id is not null")
    alike = named.groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    alike = stage(alike.withColumn("rep", F.monotonically_increasing_id()), "jaccard-alike")
    several = alike.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id", F.lit(True).alias("several"))
    # a doc_id may be the least of one set only and still have other texts
    several = several.union(several_texts(named)).distinct()
    check = F.when(F.col("several"), F.col("hi")).alias("check")
    classes = stage(alike.join(several, "doc_id", "left").select("rep", "doc_id", check, "hi", "lo", "n", "bands"), "jaccard-classes")
    leaders, own = clusters(texts, classes)
    members = stage(groups(classes, leaders, own), "jaccard-groups")
    narrow = members.select("doc_id", "check", "gid", "n_min", "n_max", "uniform")
    told = with_narrow(texts, narrow, "doc_id")
    matrix = prefixes(told, frequent_tokens(told))
    mixed = members.where("many and uniform is null").select(F.col("gid").alias("gid_a"), F.col("gid").alias("gid_b")).distinct()
    pairs = stage(opened(matrix).union(mixed), "jaccard-opened")
    found = links_between(texts, members, pairs)
    final = merged(members.select("rep", "cluster"), found)
    return seen, stage(classes.join(final, "rep").select("hi", "lo", "cluster", "doc_id"), "jaccard-final")


def several_texts(named: DataFrame) -> DataFrame:
    """(doc_id, several) of the doc_ids that have different sets."""
    ends = named.groupBy("doc_id").agg(F.min(F.struct("hi", "lo")).alias("a"), F.max(F.struct("hi", "lo")).alias("b"))
    return ends.where("a < b").select("doc_id", F.lit(True).alias("several"))


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen, sets_of = text_clusters(docs)
    # a doc_id with several texts links their clusters
    several = stage(several_texts(seen.where("n > 0 and doc_id is not null")), "jaccard-several")
    held = seen.join(several, "doc_id").join(sets_of.select("hi", "lo", "cluster"), ["hi", "lo"]).select("doc_id", "cluster").distinct()
    first = held.groupBy("doc_id").agg(F.min("cluster").alias("a"))
    joined = merged(sets_of.select(F.col("cluster").alias("rep"), "cluster").distinct(), held.join(first, "doc_id").select("a", F.col("cluster").alias("b")))
    whole = sets_of.join(joined.select(F.col("rep").alias("cluster"), F.col("cluster").alias("whole")), "cluster")
    least = whole.groupBy("whole").agg(F.min("doc_id").alias("component"))
    of_set = whole.join(least, "whole").select("hi", "lo", "component")
    rows = seen.select("doc_id", "n", "hi", "lo").join(of_set, ["hi", "lo"], "left")
    # rows without words go with the other texts of their doc_id
    empty = seen.where("n = 0 and doc_id is not null").select("doc_id").distinct()
    other = seen.where("n > 0").join(empty, "doc_id").join(of_set, ["hi", "lo"]).groupBy("doc_id").agg(F.min("component").alias("other"))
    rows = with_narrow(rows, stage(other, "jaccard-other"), "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "other", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
