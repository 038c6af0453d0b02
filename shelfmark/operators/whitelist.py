"""Labelling rows against the trusted-seller list.

A name matches an entry when one contains the other, ignoring case. A whitelist table of any
size is matched through an inverted index of short pieces of the distinct names and entries: each
pattern stands under its rarest piece only, so the rows that are joined grow with the length of the
texts, not with its square. An explicit Python list can be put into the row expression itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, strip
from ..session import stage
from .joins import join_shuffled

YES, NO = "Whitelisted", "False"


def normal_name(name: Column) -> Column:
    """Stripped lower-case name; NULL when blank, so that blanks match nothing."""
    n = F.lower(strip(name))
    return F.when(n != "", n)


def matches_any(name: Column, entries: Column) -> Column:
    """Does the normal name contain, or lie within, any entry of the normal array?"""

    def test(n):
        hit = F.exists(entries, lambda w: F.contains(n, w) | F.contains(w, n))
        return F.coalesce(n.isNotNull() & hit, F.lit(False))

    return let(name, test)


def label_expr(seller: Column, maker: Column, entries: Column) -> Column:
    """Label by an array of normal entries (literal or column)."""
    hit = matches_any(normal_name(seller), entries) | matches_any(normal_name(maker), entries)
    return F.when(hit, F.lit(YES)).otherwise(F.lit(NO))


def label_with_list(
    df: DataFrame, entries: list[str], seller: str = "seller_name", maker: str = "manufacturer_name"
) -> DataFrame:
    """Label by a short explicit list; entries are made normal once, when the plan is made."""
    arr = F.array_compact(F.array(*[normal_name(F.lit(e)) for e in entries])) if entries else F.array().cast("array<string>")
    return df.withColumn("is_whitelisted", label_expr(F.col(seller), F.col(maker), arr))


#: Length of the pieces that patterns are looked up by; shorter patterns are looked up whole.
PIECE = 4


def _pieces(text: Column, length: int) -> Column:
    """Distinct pieces of one length; none if the text is shorter. One pass over the text: to cut each
    piece out by its place would count from the start every time."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1)))


def _digest(name: str) -> Column:
    """Stands for a text of any length where it need only be told from others."""
    return F.unhex(F.sha2(F.col(name), 256)).alias(f"{name}_digest")


def _hash(name: str) -> Column:
    """Eight bytes for a text, where two that share them do no harm."""
    return F.xxhash64(name).alias(f"{name}_hash")


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pairs (text, pattern) of distinct non-empty texts and patterns of which one contains the other.

    A pattern can only lie in texts that hold all of its pieces, so it is compared with those under
    the one that fewest texts hold; a pattern with a piece that no text holds is dropped at
    once. What shares that piece is tested exactly. Pieces carry a digest of the pattern they were cut
    from, not the whole of it, and of texts, which are many more, a hash only: texts that share it are all tested.
    Patterns and texts are joined back to the few pairs left. The explodes are
    outer ones: for an inner one Spark cuts all pieces once more, before names are deduplicated, to see if
    there are any.
    """
    held = texts.select(_hash("text"), _pieces(F.col("text"), PIECE).alias("pieces"))
    held = held.select("text_hash", F.explode_outer("pieces").alias("piece"))
    counts = held.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    long = patterns.filter(F.length("pattern") >= PIECE)
    own = long.select(_digest("pattern"), _pieces(F.col("pattern"), PIECE).alias("pieces"))
    own = own.select("pattern_digest", F.size("pieces").alias("size"), F.explode_outer("pieces").alias("piece"))
    found = join_shuffled(own, counts, "piece").groupBy("pattern_digest", "size").agg(
        F.min(F.struct("n", "piece")).alias("rarest"), F.count(F.lit(1)).alias("known")
    )
    index = found.filter("known = size").select("pattern_digest", F.col("rarest.piece").alias("piece"))
    near = join_shuffled(held, index, "piece").select("text_hash", "pattern_digest")
    near = join_shuffled(near, long.select("pattern", _digest("pattern")), "pattern_digest")
    pairs = join_shuffled(near, texts.select("text", _hash("text")), "text_hash")
    pairs = pairs.filter(F.contains("text", "pattern")).select("text", "pattern")
    short = patterns.filter(F.length("pattern") < PIECE)
    whole = F.flatten(F.array(*[_pieces(F.col("text"), n) for n in range(1, PIECE)]))
    cut = texts.select(_hash("text"), whole.alias("pieces")).select("text_hash", F.explode_outer("pieces").alias("pattern"))
    cut = join_shuffled(cut, short, "pattern")
    found_short = join_shuffled(cut, texts.select("text", _hash("text")), "text_hash").filter(F.contains("text", "pattern"))
    return pairs.unionByName(found_short.select("text", "pattern"))


def matching_names(names: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Those of the distinct ``name`` rows that match an entry, without pairing all with all."""
    entries = whitelist.select(normal_name(F.col("entry")).alias("sub")).filter(F.col("sub").isNotNull()).distinct()
    as_ = lambda df, column, role: df.select(F.col(column).alias(role))
    holds_entry = containing(as_(names, "name", "text"), as_(entries, "sub", "pattern")).select(F.col("text").alias("name"))
    # a name longer than every entry lies in none
    longest = entries.agg(F.coalesce(F.max(F.length("sub")), F.lit(0)).alias("longest"))
    fitting = names.filter(F.length("name") <= longest.scalar())
    lies_in = containing(as_(entries, "sub", "text"), as_(fitting, "name", "pattern")).select(F.col("pattern").alias("name"))
    return holds_entry.unionByName(lies_in).distinct()


def label(
    df: DataFrame,
    whitelist: DataFrame,
    seller: str = "seller_name",
    maker: str = "manufacturer_name",
) -> DataFrame:
    """Label by a whitelist table of any size: no broadcast, no nested loop.

    The narrow rows are staged, so that what they were cut out of is read once. Names are
    deduplicated before matching, pairs of names before labelling; the rows themselves are
    joined once.
    """
    rows = stage(df, "label-rows")
    keyed = rows.withColumns(
        {
            "_seller": F.coalesce(normal_name(F.col(seller)), F.lit("")),
            "_maker": F.coalesce(normal_name(F.col(maker)), F.lit("")),
        }
    )
    pairs = keyed.select("_seller", "_maker").distinct()
    names = (
        pairs.select(F.explode(F.array("_seller", "_maker")).alias("name"))
        .filter(F.col("name") != "")
        .distinct()
    )
    hits = matching_names(names, whitelist)
    sides = [join_shuffled(pairs, hits.withColumnRenamed("name", side), side, "left_semi") for side in ("_seller", "_maker")]
    good = sides[0].unionByName(sides[1]).distinct().withColumn("_hit", F.lit(True))
    out = join_shuffled(keyed, good, ["_seller", "_maker"], "left")
    text = F.when(F.col("_hit"), F.lit(YES)).otherwise(F.lit(NO))
    return out.withColumn("is_whitelisted", text).select(*rows.columns, "is_whitelisted")


def trusted_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_whitelisted") == YES)
