"""Queries over product pages: extraction, labels, sinks, quarantine, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..operators.extract import extract_by_platform, extract_products, kept_products
from ..operators.quarantine import split
from ..operators.whitelist import label, trusted_only
from ..functions.selectors import css_class, tag
from ..plans.rules import AMAZON, PlatformRules
from ..session import stage_path
from ..sinks.tables import (
    product_rows,
    session_label,
    write_csv,
    write_session_table,
)
from ..sources.csv import read_products_csv
from ..sources.pages import stream_pages
from ..functions.urls import host
from ..functions.platforms import detect
from ..streaming.extract import start_dual_sink
from . import inputs as i
from .urls import H1, HOST_SQL

_FIELDS = schemas.PRODUCT_COLUMNS[:-1]

_EXPECTED = (
    f"SELECT p_partkey AS page_id, {i.PAGE_URL} AS product_url, "
    + ", ".join(
        f"CASE WHEN {i.NO_HTML} THEN '' ELSE {value} END AS {name}"
        for name, value in (
            ("title", i.TITLE),
            ("price", i.FINAL_PRICE),
            ("seller_name", i.SELLER),
            ("manufacturer_name", i.MAKER),
            ("image_url", i.IMAGE),
        )
    )
    + " FROM part"
)
_KEPT = f"(SELECT * FROM ({_EXPECTED}) WHERE title <> '' OR price <> '')"
_LIST = "SELECT lower('Shop ' || CAST(n_nationkey + 30 AS STRING)) AS entry FROM nation"
_LABEL = (
    "CASE WHEN EXISTS (SELECT 1 FROM w WHERE "
    "(seller_name <> '' AND (contains(lower(seller_name), entry) OR contains(entry, lower(seller_name)))) OR "
    "(manufacturer_name <> '' AND (contains(lower(manufacturer_name), entry) OR "
    "contains(entry, lower(manufacturer_name))))) THEN 'Whitelisted' ELSE 'False' END"
)
_LABELLED = f"WITH w AS ({_LIST}), l AS (SELECT *, {_LABEL} AS is_whitelisted FROM {_KEPT}) "
_SEVEN = ", ".join(schemas.PRODUCT_COLUMNS)


def trusted_sellers(spark, sf):
    n = i.table(spark, sf, "nation")
    return n.select(F.expr("'Shop ' || CAST(n_nationkey + 30 AS STRING)").alias("entry"))


def _extracted(spark, sf):
    return extract_products(i.product_pages(spark, sf), AMAZON)


def product_extract(spark, sf):
    return _extracted(spark, sf).select("page_id", *_FIELDS)


def page_extract(spark, sf):
    """The same rules over the given pages, which are articles: title only."""
    return extract_products(i.pages(spark, sf), AMAZON).select("page_id", *_FIELDS)


def products_labelled(spark, sf):
    kept = kept_products(_extracted(spark, sf))
    return product_rows(label(kept, trusted_sellers(spark, sf)))


def trusted_products(spark, sf):
    kept = kept_products(_extracted(spark, sf))
    return product_rows(trusted_only(label(kept, trusted_sellers(spark, sf))))


def quarantine(spark, sf):
    return split(_extracted(spark, sf), "product", "product_url")[1]


def session_label_query(spark, sf):
    o = i.table(spark, sf, "orders").select(
        "o_orderkey", "o_orderdate", F.expr(i.START_URL).alias("start_url")
    )
    domain = host(F.col("start_url"))
    return o.select(
        "o_orderkey", session_label(detect(domain), domain, F.col("o_orderdate")).alias("label")
    )


# Texts that a CSV reader could get wrong.
_AWKWARD = {
    "title": i.pick(
        "p_partkey % 6",
        ["'a \"q\" b'", "''", "' x '", "'y,z'", "'NA'", "'two\nlines \"\" end'"],
    ),
    "price": i.pick("p_partkey % 4", ["'₹1,299'", "''", "'Out of stock'", "'null'"]),
    "seller_name": "p_name",
    "manufacturer_name": "p_brand || ','",
    "image_url": "''",
    "is_whitelisted": i.pick("p_partkey % 2", ["'False'", "'Whitelisted'"]),
}


def csv_roundtrip(spark, sf):
    part = i.table(spark, sf, "part")
    cols = [F.expr(x).alias(c) for c, x in _AWKWARD.items()]
    rows = part.select(F.expr(i.PAGE_URL).alias("product_url"), *cols)
    path = stage_path(spark, "products-csv")
    write_csv(product_rows(rows), path, "overwrite")
    return read_products_csv(spark, path)


def session_layout(spark, sf):
    """Rows written into session folders and read back with their folder columns."""
    rows = i.table(spark, sf, "orders").select(
        F.expr(i.START_URL).alias("product_url"),
        F.col("o_orderdate").alias("session_ts"),
        F.col("o_orderpriority").alias("title"),
    )
    rows = rows.withColumn("domain", host(F.col("product_url")))
    rows = rows.withColumn("platform", detect(F.col("domain")))
    path = stage_path(spark, "session-layout")
    write_session_table(rows, schemas.PRODUCT_COLUMNS, path, mode="overwrite")
    back = spark.read.parquet(path)
    return back.select(
        "platform",
        F.col("session_month").cast("string").alias("session_month"),
        "session_label",
        "product_url",
        "title",
        "is_whitelisted",
    )


def stream_products(spark, sf):
    """The pages table read as a file stream and extracted batch by batch."""
    out = stage_path(spark, "stream-products")
    pages = stream_pages(spark, f"{sf}/pages.parquet")
    start_dual_sink(pages, i.variant_pages(spark, sf), AMAZON, trusted_sellers(spark, sf), out, f"{out}/checkpoint").awaitTermination()
    return product_rows(spark.read.parquet(f"{out}/products"))


#: A second platform, plugged in for this query only.
_OTHER = PlatformRules(name="flipkart", title=(tag("h2"),), price=(css_class("amount"),))
_OTHER_HTML = "'<h1>no</h1><h2>' || p_name || '</h2><b class=\"amount\">' || CAST(p_size AS STRING) || '</b>'"


def extract_by_platform_query(spark, sf):
    """Pages of three platforms, two of which have rules."""
    name = i.pick("p_partkey % 3", ["'amazon'", "'flipkart'", "'ebay'"])
    html = f"CASE p_partkey % 3 WHEN 1 THEN {_OTHER_HTML} ELSE '<h1>' || p_name || '</h1><b class=\"price\">Rs 5</b>' END"
    pages = i.dealt(i.table(spark, sf, "part"), "p_partkey").select(
        F.col("p_partkey").alias("page_id"), F.expr(i.PAGE_URL).alias("url"), F.expr(html).alias("html"), F.expr(name).alias("platform")
    )
    out = extract_by_platform(pages, rules={"amazon": AMAZON, "flipkart": _OTHER})
    return out.select("page_id", "platform", "product_url", "title", "price")


_PAGE_ROWS = (
    f"SELECT page_id, url AS product_url, {H1} AS title, '' AS price, '' AS seller_name, "
    "'' AS manufacturer_name, '' AS image_url FROM pages"
)

QUERIES = {
    "product_extract": (product_extract, _EXPECTED),
    "page_extract": (page_extract, _PAGE_ROWS),
    "products_labelled": (products_labelled, _LABELLED + f"SELECT {_SEVEN} FROM l"),
    "trusted_products": (
        trusted_products,
        _LABELLED + f"SELECT {_SEVEN} FROM l WHERE is_whitelisted = 'Whitelisted'",
    ),
    "quarantine": (
        quarantine,
        f"SELECT p_partkey AS page_id, {i.PAGE_URL} AS url, 'product' AS stage, 'no html' AS error FROM part "
        f"WHERE {i.NO_HTML}",
    ),
    "session_label": (
        session_label_query,
        f"WITH o AS (SELECT o_orderkey, o_orderdate, {i.START_URL} AS url FROM orders), "
        f"d AS (SELECT *, {HOST_SQL.format(u='url')} AS domain FROM o) SELECT o_orderkey, CASE "
        "WHEN domain LIKE '%amazon.%' THEN 'amazon' WHEN domain LIKE '%flipkart.%' THEN 'flipkart' "
        "ELSE 'generic' END || '-' || domain || '-' || strftime(o_orderdate, '%Y-%m-%d--%H-%M-%S') AS label FROM d",
    ),
    "csv_roundtrip": (
        csv_roundtrip,
        f"SELECT {i.PAGE_URL} AS product_url, "
        + ", ".join(f"{x} AS {c}" for c, x in _AWKWARD.items())
        + " FROM part",
    ),
    "session_layout": (
        session_layout,
        f"WITH o AS (SELECT {i.START_URL} AS product_url, o_orderdate, o_orderpriority AS title FROM orders), "
        f"d AS (SELECT *, {HOST_SQL.format(u='product_url')} AS domain FROM o), n AS (SELECT *, CASE "
        "WHEN domain LIKE '%amazon.%' THEN 'amazon' WHEN domain LIKE '%flipkart.%' THEN 'flipkart' "
        "ELSE 'generic' END AS platform FROM d) SELECT platform, strftime(o_orderdate, '%Y-%m') AS "
        "session_month, platform || '-' || domain || '-' || strftime(o_orderdate, '%Y-%m-%d--%H-%M-%S') AS "
        "session_label, product_url, title, 'False' AS is_whitelisted FROM n",
    ),
    "stream_products": (
        stream_products,
        f"WITH w AS ({_LIST}), l AS (SELECT *, {_LABEL} AS is_whitelisted FROM ({_PAGE_ROWS}) WHERE title <> '') "
        f"SELECT {_SEVEN} FROM l",
    ),
    "extract_by_platform": (
        extract_by_platform_query,
        f"SELECT p_partkey AS page_id, CASE p_partkey % 3 WHEN 0 THEN 'amazon' ELSE 'flipkart' END AS platform, {i.PAGE_URL} "
        "AS product_url, p_name AS title, CASE p_partkey % 3 WHEN 0 THEN '₹5' ELSE CAST(p_size AS STRING) END AS price FROM "
        "part WHERE p_partkey % 3 < 2",
    ),
}
