"""Merkle fixity audit of WARC replicas.

Records are laid out in files by offset and hashed. A file's records form a tree over its ordered
offset ranges: a leaf covers ``LEAF_BYTES`` of the file, an inner node ``FANOUT`` neighbouring nodes,
and each hash covers the ordered hashes below it. Two replicas are compared root by root; only below
mismatching nodes are children compared, level by level, down to the damaged records.

All of it is SQL over (file, offset, length, digest) rows; record bytes are hashed where they are
read and never moved. A null URL or body counts as empty text. Rows without a page_id are spread over
files of their own by hash. Equal rows of one page are one record with a number of copies. Extra
columns are ignored; empty tables give an empty report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.tables import stage

RECORDS_PER_FILE = 1_000
UNNAMED_FILES = 1 << 20
LEAF_BYTES = 1 << 16
FANOUT = 16
CHANGED, MISSING, EXTRA = "changed", "missing", "extra"
#: The trial replica: pages with these remainders of page_id are damaged or lost.
TRIAL_MODULUS, TRIAL_CHANGED, TRIAL_MISSING = 101, 7, 8


def record_text() -> F.Column:
    """A response record of a page, headers included."""
    body, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def layout(pages: DataFrame, carry: dict[str, F.Column] | None = None) -> DataFrame:
    """file, offset, length, copies, page_id and digest of every record, in page order per file.

    ``carry`` adds columns computed from ``record`` before the text is dropped.
    """
    unnamed = F.lit(-1) - F.pmod(F.xxhash64("url", "html"), F.lit(UNNAMED_FILES))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.floor(F.col("page_id") / RECORDS_PER_FILE), unnamed).cast("long").alias("file"),
        record_text().alias("record"),
    )
    extra = carry or {}
    rows = rows.select("page_id", "file", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), *(c.alias(n) for n, c in extra.items()))
    rows = rows.groupBy("page_id", "file", "length", "digest", *extra).agg(F.count("*").alias("copies"))
    before = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("offset", F.sum(F.col("length") * F.col("copies")).over(before) - F.col("length") * F.col("copies"))


def _combined(order: str, text: F.Column) -> F.Column:
    """One hash over a node's children in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return F.sha2(F.array_join(F.transform(listed, lambda x: x.t), ","), 256).alias("hash")


def leaves(records: DataFrame) -> DataFrame:
    text = F.concat_ws(":", "offset", "length", "digest")
    return records.groupBy("side", "file", F.floor(F.col("offset") / LEAF_BYTES).cast("long").alias("node")).agg(_combined("offset", text))


def parents(level: DataFrame) -> DataFrame:
    text = F.concat_ws(":", "node", "hash")
    return level.groupBy("side", "file", F.floor(F.col("node") / FANOUT).cast("long").alias("node_")).agg(_combined("node", text)).withColumnRenamed("node_", "node")


def _differing(level: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose value differs between the sides, or that one side lacks."""
    of = lambda side: level.where(F.col("side") == side).select(*keys, F.col(value).alias(side))
    return of("primary").join(of("replica"), keys, "full").where(~F.col("primary").eqNullSafe(F.col("replica")))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """One row per damaged record: file, offset, status, and both sides' page_id, length and digest.

    Both inputs have file, offset, length, digest and page_id.
    """
    columns = ["file", "offset", "length", "digest", "page_id"]
    both = primary.select(F.lit("primary").alias("side"), *columns).unionByName(replica.select(F.lit("replica").alias("side"), *columns))
    records = stage(both, "fixity-records")
    levels = [stage(leaves(records), "fixity-leaves")]
    highest = levels[0].agg(F.max("node")).first()[0] or 0
    while highest:
        levels.append(parents(levels[-1]))
        highest //= FANOUT
    bad = _differing(levels[-1], ["file", "node"], "hash").select("file", "node")
    for level in reversed(levels[:-1]):
        below = bad.select("file", F.col("node").alias("up"))
        children = level.withColumn("up", F.floor(F.col("node") / FANOUT).cast("long")).join(below, ["file", "up"], "left_semi")
        bad = _differing(children, ["file", "node"], "hash").select("file", "node")
    inside = records.withColumn("node", F.floor(F.col("offset") / LEAF_BYTES).cast("long")).join(bad, ["file", "node"], "left_semi")
    side = lambda name: inside.where(F.col("side") == name).select("file", "offset", F.struct("page_id", "length", "digest").alias(name))
    found = side("primary").join(side("replica"), ["file", "offset"], "full")
    status = F.when(F.col("replica").isNull(), MISSING).when(F.col("primary").isNull(), EXTRA).otherwise(CHANGED)
    differs = ~F.struct("primary.length", "primary.digest").eqNullSafe(F.struct("replica.length", "replica.digest"))
    return found.where(differs | F.col("replica").isNull() | F.col("primary").isNull()).select(
        F.coalesce("primary.page_id", "replica.page_id").alias("page_id"), "file", "offset",
        F.coalesce("primary.length", "replica.length").alias("length"), status.alias("status"),
        F.col("primary.digest").alias("expected"), F.col("replica.digest").alias("found"),
    )


def audit_trial_replica(pages: DataFrame) -> DataFrame:
    """Lay pages out as WARC files, derive a replica with known damage, and locate it."""
    damaged = F.sha2(F.concat(F.expr("substr(record, 1, length(record) - 1)"), F.lit("~")), 256)
    both = stage(layout(pages, {"damaged": damaged}), "fixity-layout")
    left = F.coalesce(F.pmod("page_id", F.lit(TRIAL_MODULUS)), F.lit(-1))
    replica = both.where(left != TRIAL_MISSING).withColumn("digest", F.when(left == TRIAL_CHANGED, F.col("damaged")).otherwise(F.col("digest")))
    return audit(both, replica)
