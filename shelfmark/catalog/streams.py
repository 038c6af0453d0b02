"""Queries over streams whose inputs arrive in parts and out of order, over committed runs and over places in written tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions.platforms import detect
from ..functions.urls import host
from ..operators.extract import extract_products, kept_products
from ..operators.variants import extract_variants
from ..plans.rules import AMAZON
from ..session import stage, stage_path
from ..sinks.runs import RunLog
from ..sinks.tables import product_rows, read_session, session_label, write_bundle, write_session_table
from ..sources.pages import stream_pages
from ..streaming.catalog import read_catalog, start_catalog
from ..streaming.walk import read_requests, start_requests
from . import inputs as i
from .products import trusted_sellers
from .sessions import ASIDE, REQUESTS, SNAPSHOT, STATES, TRUST, VARIANTS, mains_of
from .urls import HOST_SQL


def _folder(spark, rows, name, most, per_file, files=6):
    """The rows as files that mix them without regard to their order, and how many files there are.

    A file is read by one task, so more rows come in more files; ``most`` is a plain table with at least as many.
    """
    path = stage_path(spark, f"stream-{name}")
    files = max(files, -(-most.count() // per_file))
    rows.repartition(files, F.xxhash64(*rows.columns[:2], F.lit(name))).write.parquet(path)
    return path, files


def stream_requests(spark, sf):
    """Requests of sessions and listing pages that arrive mixed, in several batches."""
    out = stage_path(spark, "stream-requests")
    sessions, n = _folder(spark, i.sessions(spark, sf), "sessions", i.table(spark, sf, "orders"), 250_000)
    listings, m = _folder(spark, i.listing_pages(spark, sf), "listings", i.table(spark, sf, "lineitem"), 25_000)
    start_requests(
        stream_pages(spark, sessions, schemas.SESSIONS, files_per_batch=-(-n * 2 // 3)),
        stream_pages(spark, listings, schemas.LISTING_PAGES, files_per_batch=-(-m // 3)),
        AMAZON, out, f"{out}/checkpoint",
    ).awaitTermination()
    return read_requests(spark, out)


def _late(spark, sf):
    """Two runs of one stream. The first has half of the pages, second snapshots that will not count,
    and a third of the variant snapshots; the others come after options were already carried over."""
    out = stage_path(spark, "stream-catalog")
    pages, variants = i.snapshots(spark, sf), i.variant_pages(spark, sf)
    late_pages = F.col("page_id").between(0, 1 << 40) & (F.col("page_id") % 2 == 1)
    first_variants = F.pmod(F.xxhash64("url"), F.lit(3)) == 0
    folders = [stage_path(spark, f"stream-late-{n}") for n in ("pages", "variants")]
    for now in (lambda c: c, lambda c: ~c):
        pages.filter(now(~late_pages)).write.mode("append").parquet(folders[0])
        variants.filter(now(first_variants)).write.mode("append").parquet(folders[1])
        start_catalog(
            stream_pages(spark, folders[0], schemas.PAGES),
            stream_pages(spark, folders[1], schemas.VARIANT_PAGES),
            AMAZON, trusted_sellers(spark, sf), out, f"{out}/checkpoint",
        ).awaitTermination()
    return out


def stream_snapshots(spark, sf):
    """One product row per URL, although better snapshots of some arrive later."""
    return product_rows(read_catalog(spark, _late(spark, sf), "products"))


def stream_variants_late(spark, sf):
    """Variant rows after late snapshots have corrected carried ones."""
    return read_catalog(spark, _late(spark, sf), "variants")


def stream_quarantine(spark, sf):
    """Unreadable pages and options at the end of the stream; rows that were mended are taken back."""
    return read_catalog(spark, _late(spark, sf), "quarantine")


def repeatable_append(spark, sf):
    """Orders by month appended as runs: each run first breaks off, then goes through, then is repeated."""
    log = RunLog(spark, stage_path(spark, "runs"))
    orders = i.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    for status in ("F", "O", "P"):
        rows = orders.filter(F.col("o_orderstatus") == status)
        log.write({"orders": rows})  # breaks off before its commit
        log.append({"orders": rows}, run=status)
        log.append({"orders": rows}, run=status)
        log.compact(after=2)
    return log.read("orders")


def bundle_positions(spark, sf):
    """Both members of the bundle with each row's place in the whole output."""
    mains = stage(mains_of(spark, sf), "mains")
    place = {"session_id": F.col("page_id"), "page_no": F.lit(1), "link_ord": F.lit(1)}
    records = extract_products(i.variant_pages(spark, sf), AMAZON)
    found = extract_variants(mains, records, keep=("page_id",)).withColumns(place)
    products = kept_products(mains.drop("dims")).withColumns(place)
    paths = write_bundle(products, found, stage_path(spark, "bundle"), positions=True)
    parts = [
        spark.read.parquet(paths[member]).select(F.lit(member).alias("member"), "position", F.col(url).alias("url"), "title")
        for member, url in (("Products", "product_url"), ("Variants", "variant_product_url"))
    ]
    return parts[0].unionByName(parts[1])


def session_lookup(spark, sf):
    """All orders written as a clustered session table, and the session of the last order read back."""
    rows = i.table(spark, sf, "orders").select(
        F.expr(i.START_URL).alias("product_url"), F.col("o_orderdate").alias("session_ts"), F.col("o_orderkey").cast("string").alias("title")
    )
    rows = rows.withColumn("domain", host(F.col("product_url"))).withColumn("platform", detect(F.col("domain")))
    path = stage_path(spark, "session-clusters")
    write_session_table(rows, schemas.PRODUCT_COLUMNS, path, mode="overwrite", clustered=True, row_group_bytes=1 << 16)
    named = session_label(F.col("platform"), F.col("domain"), F.col("session_ts"))
    last = rows.agg(F.max_by(named, F.col("title").cast("long"))).first()[0]
    return read_session(spark, path, last).select("session_label", "product_url", "title")


_PLACED = STATES.replace("SELECT ", "SELECT dim_ord, opt_ord, ", 1)
_LABELS = (
    f"o AS (SELECT o_orderkey, o_orderdate, {i.START_URL} AS url FROM orders), "
    f"d AS (SELECT *, {HOST_SQL.format(u='url')} AS domain FROM o), s AS (SELECT o_orderkey, url, CASE "
    "WHEN domain LIKE '%amazon.%' THEN 'amazon' WHEN domain LIKE '%flipkart.%' THEN 'flipkart' "
    "ELSE 'generic' END || '-' || domain || '-' || strftime(o_orderdate, '%Y-%m-%d--%H-%M-%S') AS label FROM d)"
)
QUERIES = {
    "bundle_positions": (
        bundle_positions,
        "SELECT 'Products' AS member, row_number() OVER (ORDER BY p_partkey) AS position, url, title FROM "
        f"{SNAPSHOT} WHERE title <> '' OR price <> '' UNION ALL SELECT 'Variants', row_number() OVER (ORDER BY page_id, "
        f"dim_ord, opt_ord), variant_product_url, title FROM ({_PLACED}) WHERE bad = 0",
    ),
    "session_lookup": (
        session_lookup,
        f"WITH {_LABELS} SELECT label AS session_label, url AS product_url, CAST(o_orderkey AS STRING) AS title FROM s "
        "WHERE label = (SELECT max_by(label, o_orderkey) FROM s)",
    ),
    "stream_requests": (
        stream_requests,
        f"SELECT session_id, page_no, link_ord, requested_url FROM {REQUESTS}",
    ),
    "stream_snapshots": (
        stream_snapshots,
        f"SELECT url AS product_url, title, price, seller_name, manufacturer_name, image_url, {TRUST} AS is_whitelisted "
        f"FROM {SNAPSHOT} WHERE title <> '' OR price <> ''",
    ),
    "stream_variants_late": (
        stream_variants_late,
        f"SELECT variant_product_url, main_product_url, title, variant_price, seller_name, manufacturer_name, "
        f"image_url, {TRUST} AS is_whitelisted FROM ({VARIANTS})",
    ),
    "stream_quarantine": (
        stream_quarantine,
        f"SELECT p_partkey AS page_id, {i.PAGE_URL} AS url, 'product' AS stage, 'no html' AS error FROM part WHERE "
        f"{i.NO_HTML} UNION ALL {ASIDE}",
    ),
    "repeatable_append": (
        repeatable_append,
        "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')",
    ),
}
