"""Queries over variants, listing pages and whole sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.nodes import with_dom
from ..functions.text import or_blank
from ..functions.urls import canonical
from ..operators.extract import extract_products, kept_products
from ..operators.joins import join_shuffled
from ..operators.paging import has_next, listing_horizon, page_limit
from ..operators.summary import (
    options_per_dimension,
    products_with_variant_counts,
    session_totals,
    variants_per_product,
)
from ..operators.variants import QUARANTINE, dimensions, extract_variants, flatten_options, split_variants, variant_states
from ..plans.retail import (
    classify_sessions,
    listing_facts,
    listing_requests,
    one_per_url,
    product_facts,
    run,
    single_requests,
    walked_pages,
)
from ..operators.whitelist import label
from ..plans.rules import AMAZON
from ..session import stage, stage_path
from ..sinks.tables import product_rows, variant_rows, write_bundle, write_variants
from ..sources.csv import read_variants_csv
from ..sources.pages import stream_pages
from ..streaming.extract import read_totals, start_dual_sink, start_totals
from . import inputs as i
from .products import trusted_sellers

_BIG = "bigint"


def mains_of(spark, sf):
    """Product pages with their dimensions; the URL is asked for without its query."""
    facts = product_facts(i.product_pages(spark, sf), AMAZON)
    return facts.withColumn("main_product_url", canonical(F.col("product_url")))


def _dims(spark, sf):
    dom = with_dom(i.product_pages(spark, sf), AMAZON.wanted_variants())
    return dom.select("page_id", dimensions(AMAZON).alias("dims"))


def variant_dims(spark, sf):
    """Dimension names of each page in order, as one text; '' without any."""
    return _dims(spark, sf).select(
        "page_id",
        or_blank(F.array_join(F.transform("dims", lambda d: d["dim"]), ">")).alias("dims"),
    )


def variant_options(spark, sf):
    return flatten_options(_dims(spark, sf)).select(
        "page_id",
        F.col("dim_ord").cast(_BIG).alias("dim_ord"),
        "dim",
        F.col("opt_ord").cast(_BIG).alias("opt_ord"),
        "name",
        "asin",
        "value",
    )


def options_per_dimension_query(spark, sf):
    return options_per_dimension(_dims(spark, sf)).select("page_id", "dim", "n_options")


def _variants(spark, sf, **how):
    records = extract_products(i.variant_pages(spark, sf), AMAZON)
    return extract_variants(mains_of(spark, sf), records, **how, keep=("page_id",))


_VARIANT_OUT = (
    "page_id",
    "variant_product_url",
    "main_product_url",
    "title",
    "variant_price",
    "seller_name",
    "manufacturer_name",
    "image_url",
    "variant_type",
    "variant_option",
    "variant_asin",
    "is_carried",
)


def variants(spark, sf):
    return _variants(spark, sf).select(*_VARIANT_OUT)


def variants_matched_only(spark, sf):
    return _variants(spark, sf, on_missing=QUARANTINE).select(*_VARIANT_OUT)


def variant_sink_rows(spark, sf):
    return variant_rows(_variants(spark, sf))


def variants_per_product_query(spark, sf):
    return variants_per_product(_variants(spark, sf))


def products_with_variants(spark, sf):
    mains = stage(mains_of(spark, sf), "mains")
    records = extract_products(i.variant_pages(spark, sf), AMAZON)
    found = extract_variants(mains, records)
    products = mains.filter("title <> '' OR price <> ''").select(
        "page_id", F.col("main_product_url").alias("requested_url")
    )
    return products_with_variant_counts(products, found)


def variant_quarantine(spark, sf):
    """Options whose snapshot is missing or cannot be read, where both are set aside."""
    records = extract_products(i.variant_pages(spark, sf), AMAZON)
    states = variant_states(flatten_options(mains_of(spark, sf)), records)
    return split_variants(states, QUARANTINE)[1].select("url", "stage", "error")


def variant_csv_roundtrip(spark, sf):
    path = stage_path(spark, "variants-csv")
    write_variants(_variants(spark, sf), path, "overwrite", "csv")
    return read_variants_csv(spark, path)


def bundle_export(spark, sf):
    """Both members of the bundle read back: their rows, and whether each file is in order."""
    mains = stage(mains_of(spark, sf), "mains")
    place = {"session_id": F.col("page_id"), "page_no": F.lit(1), "link_ord": F.lit(1)}
    products = label(kept_products(mains.drop("dims")), trusted_sellers(spark, sf)).withColumns(place)
    records = extract_products(i.variant_pages(spark, sf), AMAZON)
    found = extract_variants(mains, records, keep=("page_id",)).withColumns(place)
    paths = write_bundle(products, label(found, trusted_sellers(spark, sf)), stage_path(spark, "bundle"))
    parts = []
    for member, key in (("Products", "product_url"), ("Variants", "main_product_url")):
        rows = spark.read.parquet(paths[member]).select("*", "_metadata.file_name", "_metadata.row_index")
        before = F.lag(key).over(Window.partitionBy("file_name").orderBy("row_index"))
        parts.append(
            rows.select(
                F.lit(member).alias("member"), F.col(key).alias("url"), "title", "is_whitelisted",
                F.coalesce(before <= F.col(key), F.lit(True)).alias("in_order"),
            )
        )
    return parts[0].unionByName(parts[1])


#: A larger input comes in larger files and not in more batches, each of which has a cost of its own.
STREAM_FILES = 16


def _staged_pages(spark, sf):
    """Product snapshots as a folder that a stream can watch, with the session that asked for them."""
    path = stage_path(spark, "stream-input")
    rows = i.product_pages(spark, sf).withColumn("session_id", F.col("page_id") % 50)
    rows.coalesce(STREAM_FILES).write.parquet(path)
    return stream_pages(spark, path, rows.schema, files_per_batch=4)


def stream_variants(spark, sf):
    """Variant table written batch by batch next to the products."""
    out = stage_path(spark, "stream-variants")
    pages, extra = _staged_pages(spark, sf), i.variant_pages(spark, sf)
    start_dual_sink(pages, extra, AMAZON, trusted_sellers(spark, sf), out, f"{out}/checkpoint").awaitTermination()
    return variant_rows(spark.read.parquet(f"{out}/variants"))


def stream_totals(spark, sf):
    out = stage_path(spark, "stream-totals")
    start_totals(_staged_pages(spark, sf), AMAZON, out, f"{out}/checkpoint", by="session_id").awaitTermination()
    return read_totals(spark, out, "session_id")


# ---------------------------------------------------------------- listing pages


def next_page_flag(spark, sf):
    p = i.listing_pages(spark, sf)
    dom = with_dom(p, AMAZON.wanted_listing())
    return dom.select("session_id", "page_no", has_next(AMAZON).alias("has_next"))


def page_limits(spark, sf):
    o = i.table(spark, sf, "orders")
    paging = F.expr("CASE o_orderkey % 4 WHEN 3 THEN 'no_pagination' ELSE 'pagination' END")
    return o.select("o_orderkey", page_limit(F.expr(i.LIMIT_TEXT), paging).alias("page_limit"))


def listing_horizon_query(spark, sf):
    lines = (
        i.table(spark, sf, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_partkey").alias("pk"))
    )
    pages = lines.select(
        "l_orderkey",
        "l_linenumber",
        F.expr("pk % 10").alias("n_links"),
        F.expr("pk % 7 <> 0").alias("has_next"),
    )
    limits = i.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.expr("o_orderkey % 5").alias("page_limit")
    )
    walked = listing_horizon(pages, limits, "l_orderkey", "l_linenumber")
    return walked.select("l_orderkey", "l_linenumber")


def _requests(spark, sf):
    sess = stage(classify_sessions(i.sessions(spark, sf)), "sessions").filter("platform = 'amazon'")
    pages = walked_pages(i.listing_pages(spark, sf), sess)
    facts = stage(listing_facts(pages, AMAZON), "listing-facts")
    return single_requests(sess).unionByName(listing_requests(facts, sess))


def product_requests(spark, sf):
    """Product URLs asked for by each session: routing, links, paging walk, union."""
    return _requests(spark, sf).select(
        "session_id",
        F.col("page_no").cast(_BIG).alias("page_no"),
        F.col("link_ord").cast(_BIG).alias("link_ord"),
        "requested_url",
    )


def listing_to_product(spark, sf):
    """Requests joined to product records; unmatched ones stay with a blank title."""
    requests = _requests(spark, sf).withColumn("key", canonical(F.col("requested_url")))
    facts = one_per_url(product_facts(i.snapshots(spark, sf), AMAZON)).drop("dims")
    joined = join_shuffled(requests, facts, "key", "left")
    return joined.select(
        "session_id",
        "requested_url",
        F.col("page_id").isNotNull().alias("found"),
        or_blank(F.col("title")).alias("title"),
        or_blank(F.col("price")).alias("price"),
    )


def _run(spark, sf):
    return run(
        i.sessions(spark, sf),
        i.listing_pages(spark, sf),
        i.snapshots(spark, sf),
        i.variant_pages(spark, sf),
        trusted_sellers(spark, sf),
    )


def session_totals_query(spark, sf):
    return _run(spark, sf).totals


def session_products(spark, sf):
    return _run(spark, sf).products.select(
        "session_id", "requested_url", "title", "price", "is_whitelisted"
    )


def session_variants(spark, sf):
    return _run(spark, sf).variants.select(
        "session_id", "main_product_url", "variant_product_url", "title", "variant_price",
        "is_whitelisted",
    )


def session_quarantine(spark, sf):
    return _run(spark, sf).quarantine


# ---------------------------------------------------------------- expected SQL

_P = f"(SELECT *, {i.VARIANT_KIND} AS vkind FROM part WHERE NOT {i.NO_HTML})"
_CODE = i.option_asin("slot")
_OPTIONS = f"{_P} AS p JOIN {i.OPTIONS_SQL} ON p.vkind = o.kind"
_HIT = f"({i.HAS_VARIANT_PAGE})"
_W = (
    "OVER (PARTITION BY p_partkey ORDER BY dim_ord, opt_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
)


def _state(hit: str, main: str) -> str:
    return f"coalesce(last_value(CASE WHEN {_HIT} THEN {hit} END IGNORE NULLS) {_W}, {main})"


STATES = (
    f"SELECT p_partkey AS page_id, {_state(i.VARIANT_PAGE_URL, i.PAGE_URL)} AS variant_product_url, "
    f"{i.product_url()} AS main_product_url, {_state(i.VARIANT_TITLE, i.TITLE)} AS title, "
    f"{_state(chr(39) + '₹' + chr(39) + ' || ' + i.VARIANT_PRICE, i.FINAL_PRICE)} AS variant_price, "
    f"{_state(i.SHOP, i.SELLER)} AS seller_name, {_state('p_brand', i.MAKER)} AS manufacturer_name, "
    f"{_state(chr(39) * 2, i.IMAGE)} AS image_url, dim AS variant_type, name AS variant_option, "
    f"{_CODE} AS variant_asin, NOT {_HIT} AND NOT {i.BAD_VARIANT_PAGE} AS is_carried, coalesce(last_value(CASE WHEN {_HIT} "
    f"THEN 0 WHEN {i.BAD_VARIANT_PAGE} THEN 1 END IGNORE NULLS) {_W}, 0) AS bad FROM {_OPTIONS}"
)
VARIANTS = f"SELECT * EXCLUDE (bad) FROM ({STATES}) WHERE bad = 0"
#: Quarantine rows of options whose state cannot be read.
ASIDE = f"SELECT NULL, main_product_url || '#' || variant_asin, 'variant', 'no html' FROM ({STATES}) WHERE bad = 1"
_ASIDE_URL = f"({i.product_url()} || '#' || {_CODE})"
_LISTING = f"({i.LISTING_SQL})"


def _walk(pages: str, keys: str = "s") -> str:
    """Pages kept of rows (s, n, links, nxt, lim): contiguous from 1 and no stop before."""
    return (
        f"(SELECT * FROM (SELECT *, row_number() OVER w AS rn, "
        "coalesce(bool_or(links = 0) OVER w, false) AS empty_seen, coalesce(bool_or(NOT nxt) OVER "
        "(PARTITION BY s ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended "
        f"FROM {pages} WHERE lim = 0 OR n <= lim WINDOW w AS (PARTITION BY s ORDER BY n ROWS BETWEEN "
        "UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE rn = n AND NOT empty_seen AND NOT ended)"
    )


_SESSION_PAGES = (
    f"(SELECT l_orderkey AS s, l_linenumber AS n, pk, CASE WHEN {i.NO_LINKS} THEN 0 ELSE 3 END AS links, "
    f"{i.HAS_NEXT} AS nxt, {i.LIMIT} AS lim FROM {_LISTING} JOIN orders ON o_orderkey = l_orderkey "
    f"WHERE {i.SESSION_KIND} IN (1, 2, 4, 5))"
)
REQUESTS = (
    f"(SELECT s AS session_id, CAST(n AS BIGINT) AS page_no, j + 1 AS link_ord, {i.product_url('pk + j')} "
    f"AS requested_url, pk + j AS part FROM {_walk(_SESSION_PAGES)}, "
    "(VALUES (CAST(0 AS BIGINT)), (1), (2)) AS t(j) UNION ALL "
    f"SELECT o_orderkey, 1, 1, {i.product_url('o_orderkey % 3000')} || '?th=1', o_orderkey % 3000 FROM orders "
    f"WHERE {i.SESSION_KIND} = 0)"
)
SNAPSHOT = (
    f"(SELECT p_partkey, {i.PAGE_URL} AS url, "
    + ", ".join(
        f"CASE WHEN {i.NO_HTML} THEN '' ELSE {x} END AS {n}"
        for n, x in (
            ("title", i.TITLE),
            ("price", i.FINAL_PRICE),
            ("seller_name", i.SELLER),
            ("manufacturer_name", i.MAKER),
            ("image_url", i.IMAGE),
        )
    )
    + " FROM part)"
)
TRUST = (
    "CASE WHEN EXISTS (SELECT 1 FROM nation WHERE "
    "(seller_name <> '' AND (contains(lower(seller_name), lower('Shop ' || CAST(n_nationkey + 30 AS STRING))) OR "
    "contains(lower('Shop ' || CAST(n_nationkey + 30 AS STRING)), lower(seller_name)))) OR "
    "(manufacturer_name <> '' AND (contains(lower(manufacturer_name), lower('Shop ' || CAST(n_nationkey + 30 AS "
    "STRING))) OR contains(lower('Shop ' || CAST(n_nationkey + 30 AS STRING)), lower(manufacturer_name))))) "
    "THEN 'Whitelisted' ELSE 'False' END"
)
_S_PRODUCTS = (
    f"(SELECT r.session_id, r.requested_url, title, price, {TRUST} AS is_whitelisted FROM {REQUESTS} r "
    f"JOIN {SNAPSHOT} s ON s.p_partkey = r.part WHERE (title <> '' OR price <> ''))"
)
_S_VARIANTS = (
    f"(SELECT r.session_id, r.requested_url AS main_product_url, v.variant_product_url, v.title, "
    f"v.variant_price, {TRUST} AS is_whitelisted FROM {REQUESTS} r JOIN ({VARIANTS}) v ON v.page_id = r.part)"
)

QUERIES = {
    "variant_dims": (
        variant_dims,
        f"WITH d AS (SELECT p_partkey, string_agg(DISTINCT dim_ord || dim, '>' ORDER BY dim_ord || dim) AS x FROM "
        f"{_OPTIONS} GROUP BY 1) SELECT part.p_partkey AS page_id, "
        "coalesce(regexp_replace(x, '[0-9]', '', 'g'), '') AS dims FROM part LEFT JOIN d USING (p_partkey)",
    ),
    "variant_options": (
        variant_options,
        "SELECT p_partkey AS page_id, CAST(dim_ord AS BIGINT) AS dim_ord, dim, CAST(opt_ord AS BIGINT) AS opt_ord, "
        f"name, {_CODE} AS asin, CASE WHEN coded THEN 'v' || slot ELSE {_CODE} END AS value FROM {_OPTIONS}",
    ),
    "options_per_dimension": (
        options_per_dimension_query,
        f"SELECT p_partkey AS page_id, dim, count(*) AS n_options FROM {_OPTIONS} GROUP BY 1, 2",
    ),
    "variants": (variants, VARIANTS),
    "variants_matched_only": (
        variants_matched_only,
        f"SELECT * FROM ({VARIANTS}) WHERE NOT is_carried",
    ),
    "variant_sink_rows": (
        variant_sink_rows,
        "SELECT variant_product_url, main_product_url, title, variant_price, seller_name, manufacturer_name, "
        f"image_url, 'False' AS is_whitelisted FROM ({VARIANTS})",
    ),
    "variants_per_product": (
        variants_per_product_query,
        f"SELECT main_product_url, count(*) AS n_variants FROM ({VARIANTS}) GROUP BY 1",
    ),
    "products_with_variants": (
        products_with_variants,
        f"WITH c AS (SELECT page_id AS p_partkey, count(*) AS n FROM ({VARIANTS}) GROUP BY 1) SELECT s.p_partkey AS page_id, "
        f"{i.product_url('s.p_partkey')} AS requested_url, coalesce(n, 0) AS n_variants FROM {SNAPSHOT} s "
        "LEFT JOIN c ON c.p_partkey = s.p_partkey WHERE title <> '' OR price <> ''",
    ),
    "next_page_flag": (
        next_page_flag,
        f"SELECT l_orderkey AS session_id, l_linenumber AS page_no, {i.HAS_NEXT} AS has_next FROM {_LISTING}",
    ),
    "page_limits": (
        page_limits,
        f"SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE {i.LIMIT} END AS BIGINT) AS page_limit "
        "FROM orders",
    ),
    "listing_horizon": (
        listing_horizon_query,
        "SELECT s AS l_orderkey, n AS l_linenumber FROM "
        + _walk(
            "(SELECT l_orderkey AS s, l_linenumber AS n, pk % 10 AS links, pk % 7 <> 0 AS nxt, "
            f"l_orderkey % 5 AS lim FROM {_LISTING})"
        ),
    ),
    "product_requests": (
        product_requests,
        f"SELECT session_id, page_no, link_ord, requested_url FROM {REQUESTS}",
    ),
    "listing_to_product": (
        listing_to_product,
        "SELECT session_id, requested_url, s.p_partkey IS NOT NULL AS found, coalesce(title, '') AS title, "
        f"coalesce(price, '') AS price FROM {REQUESTS} r LEFT JOIN {SNAPSHOT} s ON s.p_partkey = r.part",
    ),
    "session_products": (session_products, f"SELECT * FROM {_S_PRODUCTS}"),
    "session_variants": (session_variants, f"SELECT * FROM {_S_VARIANTS}"),
    "session_totals": (
        session_totals_query,
        "SELECT session_id, CAST(sum(p) AS BIGINT) AS total_products, CAST(sum(v) AS BIGINT) AS total_variants FROM "
        f"(SELECT session_id, 1 AS p, 0 AS v FROM {_S_PRODUCTS} UNION ALL SELECT session_id, 0, 1 FROM "
        f"{_S_VARIANTS} UNION ALL SELECT o_orderkey, 0, 0 FROM orders) GROUP BY 1",
    ),
    "variant_quarantine": (
        variant_quarantine,
        f"SELECT {_ASIDE_URL} AS url, 'variant' AS stage, CASE WHEN {i.BAD_VARIANT_PAGE} THEN 'no html' ELSE "
        f"'no snapshot' END AS error FROM {_OPTIONS} WHERE NOT {_HIT}",
    ),
    "variant_csv_roundtrip": (
        variant_csv_roundtrip,
        "SELECT variant_product_url, main_product_url, title, variant_price, seller_name, manufacturer_name, "
        f"image_url, 'False' AS is_whitelisted FROM ({VARIANTS})",
    ),
    "bundle_export": (
        bundle_export,
        f"SELECT 'Products' AS member, url, title, {TRUST} AS is_whitelisted, true AS in_order FROM {SNAPSHOT} WHERE "
        f"title <> '' OR price <> '' UNION ALL SELECT 'Variants', main_product_url, title, {TRUST}, true FROM "
        f"({VARIANTS})",
    ),
    "stream_variants": (
        stream_variants,
        f"SELECT variant_product_url, {i.PAGE_URL.replace('p_partkey', 'page_id')} AS main_product_url, title, "
        f"variant_price, seller_name, manufacturer_name, image_url, {TRUST} AS is_whitelisted FROM ({VARIANTS})",
    ),
    "stream_totals": (
        stream_totals,
        f"WITH o AS (SELECT p_partkey, count(*) AS n FROM {_OPTIONS} GROUP BY 1) SELECT p_partkey % 50 AS session_id, "
        "CAST(sum(CASE WHEN title <> '' OR price <> '' THEN 1 ELSE 0 END) AS BIGINT) AS total_products, "
        f"CAST(sum(coalesce(n, 0)) AS BIGINT) AS total_variants FROM {SNAPSHOT} LEFT JOIN o USING (p_partkey) GROUP BY 1",
    ),
    "session_quarantine": (
        session_quarantine,
        f"SELECT s.p_partkey AS page_id, r.requested_url AS url, 'product' AS stage, CASE WHEN s.p_partkey IS NULL "
        f"THEN 'no snapshot' ELSE 'no html' END AS error FROM {REQUESTS} r LEFT JOIN {SNAPSHOT} s ON "
        "s.p_partkey = r.part WHERE s.p_partkey IS NULL OR s.p_partkey % 101 IN (50, 51) UNION ALL "
        f"SELECT NULL, {i.START_URL}, 'session', CASE WHEN {i.SESSION_KIND} IN (3, 6) THEN 'no rules' ELSE 'page limit' "
        f"END FROM orders WHERE {i.SESSION_KIND} IN (3, 6) OR {i.LIMIT} IS NULL UNION ALL "
        + ASIDE,
    ),
}
