"""Queries over URLs, platforms and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.nodes import with_dom
from ..functions.platforms import detect
from ..functions.selectors import Wanted, first_text, has, tag
from ..functions.text import collapse, or_blank, unescape_markup
from ..functions.urls import canonical, host, is_single_product, resolve
from ..operators.links import (
    explode_links,
    has_product_id,
    link_progress,
    links_native,
    links_of,
    not_excluded,
    on_site,
    product_links,
    top_links,
    first_links,
)
from ..plans.rules import AMAZON
from ..sources.platforms import with_platform_facts
from . import inputs as i

HOST_SQL = (
    "trim(lower(regexp_extract({u}, "
    r"'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)', 1)), '[]')"
)
_HREFS = (
    "SELECT page_id, url, unnest(l) AS raw_href, generate_subscripts(l, 1) AS ord FROM (SELECT page_id, url, "
    "regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1) AS l FROM pages)"
)
_RAW_H1 = r"regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"
for _name, _char in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#x27;", "''"), ("&amp;?", "&")):
    _RAW_H1 = f"regexp_replace({_RAW_H1}, '{_name}', '{_char}', 'g')"
H1 = rf"trim(regexp_replace({_RAW_H1}, '\s+', ' ', 'g'))"
_ENCODED = (
    "list_aggregate(list_transform(string_split(raw_href, ''), lambda c: CASE WHEN regexp_matches(c, "
    r''''[^\x21-\x7E]|["<>]') THEN regexp_replace(hex(encode(c)), '(..)', '%\1', 'g') '''
    "ELSE c END), 'string_agg', '')"
)
# Expected facts per platform, stated apart from the dimension under test.
_PLATFORM_ROWS = (
    "('amazon', 'pagination', true, 'AMAZON'), ('flipkart', 'pagination', true, 'FLIPKART'), "
    "('myntra', 'pagination', true, 'MYNTRA'), ('ebay', 'pagination', true, 'EBAY'), "
    "('walmart', 'pagination', true, 'WALMART'), ('redbubble', 'pagination', true, 'REDBUBBLE'), "
    "('shopsy', 'pagination', false, 'SHOPSY'), ('meesho', 'infinite_scroll', false, 'MEESHO'), "
    "('ajio', 'infinite_scroll', true, 'AJIO'), ('indiamart', 'infinite_scroll', false, 'INDIAMART'), "
    "('nykaa', 'infinite_scroll', true, 'NYKAA'), ('snapdeal', 'infinite_scroll', false, 'SNAPDEAL'), "
    "('tatacliq', 'no_pagination', true, 'TATA CLIQ'), "
    "('generic', 'pagination', false, 'UNKNOWN PLATFORM (Generic Mode)')"
)
# Order in which host names are tested.
_TESTED = (
    "amazon", "flipkart", "myntra", "meesho", "ajio", "ebay", "redbubble", "snapdeal", "shopsy", "nykaa", "tatacliq",
    "indiamart", "walmart",
)
_DETECT = "CASE " + " ".join(f"WHEN contains(h, '{p}.') THEN '{p}'" for p in _TESTED) + " ELSE 'generic' END"
_LINES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_RANKED = "row_number() OVER (PARTITION BY {p} ORDER BY {o})"


def url_host(spark, sf):
    return i.table(spark, sf, "pages").select("page_id", host(F.col("url")).alias("host"))


def platform_detect(spark, sf):
    p = i.table(spark, sf, "part").select("p_partkey", F.expr(i.HOST).alias("host"))
    p = p.withColumn("platform", detect(F.col("host")))
    return with_platform_facts(p).select(
        "p_partkey", "host", "platform", "display_name", "paging", "variant_support"
    )


def url_class(spark, sf):
    p = i.table(spark, sf, "part").select("p_partkey", F.expr(i.SHOP_URL).alias("url"))
    p = p.withColumn("platform", detect(host(F.col("url"))))
    return p.withColumn("is_single", is_single_product(F.col("url"), F.col("platform")))


def url_canonical(spark, sf):
    return i.table(spark, sf, "pages").select("page_id", canonical(F.col("url")).alias("url"))


def page_links(spark, sf):
    p = i.table(spark, sf, "pages")
    return explode_links(p, links_native(F.col("html"))).select(
        "page_id", F.col("ord").cast("bigint").alias("ord"), "raw_href"
    )


def page_links_parsed(spark, sf):
    p = with_dom(i.pages(spark, sf), Wanted([has("href", "a")], ["href"]))
    return explode_links(p, links_of()).select(
        "page_id", F.col("ord").cast("bigint").alias("ord"), "raw_href"
    )


def page_links_abs(spark, sf):
    p = i.table(spark, sf, "pages")
    return explode_links(p, links_native(F.col("html"))).select(
        "page_id",
        F.col("ord").cast("bigint").alias("ord"),
        resolve(F.col("raw_href"), F.col("url")).alias("url"),
    )


def link_resolution(spark, sf):
    href = i.pick("(l_linenumber + l_suppkey) % 11", [a for a, _ in _HREF_CASES])
    page = "('https://Shop.Example/a/b/p' || CAST(l_suppkey AS STRING) || '?q=1#z')"
    rows = i.lineitem(spark, sf).select(
        *_LINES, F.expr(href).alias("href"), F.expr(page).alias("page")
    )
    return rows.select(*_LINES, resolve(F.col("href"), F.col("page")).alias("url"))


_KEY = "CAST(l_partkey AS STRING)"
# Link text and, for a page https://Shop.Example/a/b/p<supplier>?q=1#z, its absolute form.
_HREF_CASES = (
    (f"'../c/./' || {_KEY}", f"'https://shop.example/a/c/' || {_KEY}"),
    (f"' /r?x=' || {_KEY} || ' '", f"'https://shop.example/r?x=' || {_KEY}"),
    (f"'//CDN.example/' || {_KEY}", f"'https://cdn.example/' || {_KEY}"),
    (f"'?p=' || {_KEY}", f"'https://shop.example/a/b/p' || CAST(l_suppkey AS STRING) || '?p=' || {_KEY}"),
    (
        f"'#t' || {_KEY}",
        f"'https://shop.example/a/b/p' || CAST(l_suppkey AS STRING) || '?q=1#t' || {_KEY}",
    ),
    ("'HTTP://Other.Example'", "'http://other.example/'"),
    (f"'mailto:a@b.example?' || {_KEY}", f"'mailto:a@b.example?' || {_KEY}"),
    ("'ü x/..'", "'https://shop.example/a/b/'"),
    (f"'https://User:Pa@Shop.Example:443/' || {_KEY}", f"'https://User:Pa@shop.example/' || {_KEY}"),
    (f"'http://Shop.Example:80/' || {_KEY}", f"'http://shop.example/' || {_KEY}"),
    (f"'http://Shop.Example:443/' || {_KEY}", f"'http://shop.example:443/' || {_KEY}"),
)


def links_per_host(spark, sf):
    p = i.table(spark, sf, "pages").select(
        host(F.col("url")).alias("host"), F.size(links_native(F.col("html"))).alias("n")
    )
    return p.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum(F.col("n").cast("bigint")).alias("n_links")
    )


def page_title(spark, sf):
    p = with_dom(i.pages(spark, sf), Wanted([tag("h1")]))
    return p.select("page_id", or_blank(first_text([tag("h1")])).alias("title"))


def page_title_native(spark, sf):
    raw = F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1)
    text = F.regexp_replace(raw, "<[^>]*>", "")
    title = collapse(unescape_markup(text))
    return i.table(spark, sf, "pages").select("page_id", title.alias("title"))


def sponsored_filter(spark, sf):
    raw = F.expr(i.raw_link(i.LINK_KIND, "l_partkey"))
    rows = i.lineitem(spark, sf).select(*_LINES, raw.alias("raw_url"))
    u = F.col("raw_url")
    return rows.select(
        *_LINES,
        not_excluded(u, AMAZON).alias("not_excluded"),
        has_product_id(u, AMAZON).alias("has_product_id"),
        on_site(canonical(u), AMAZON).alias("on_site"),
    )


def product_links_query(spark, sf):
    raw = F.expr(i.raw_link(i.LINK_KIND, "l_partkey"))
    rows = i.lineitem(spark, sf).select("l_orderkey", *i.LINK_ORDER, raw.alias("raw_url"))
    return product_links(rows, AMAZON, ["l_orderkey"], i.LINK_ORDER).select(
        "l_orderkey", F.col("ord").cast("bigint").alias("ord"), "url"
    )


_TOP_ORDER = ["l_orderkey", "l_linenumber", "l_shipdate"]


def _top(spark, sf):
    rows = i.lineitem(spark, sf).select(
        "l_suppkey", *_TOP_ORDER, F.expr(i.product_url("l_partkey")).alias("url")
    )
    unique = first_links(rows, ["l_suppkey"], _TOP_ORDER)
    # Two links may share an order key; the URL settles their order.
    return top_links(unique, ["l_suppkey"], [*_TOP_ORDER, "url"])


def top_links_per_page(spark, sf):
    return _top(spark, sf).select("l_suppkey", F.col("ord").cast("bigint").alias("ord"), "url")


def link_progress_query(spark, sf):
    return link_progress(_top(spark, sf), ["l_suppkey"]).select(
        "l_suppkey", F.col("ord").cast("bigint").alias("ord"), "n_links"
    )


_UNIQUE_TOP = (
    f"SELECT l_suppkey, url, row_number() OVER (PARTITION BY l_suppkey ORDER BY "
    "l_orderkey, l_linenumber, l_shipdate, url) AS ord FROM (SELECT *, row_number() OVER "
    "(PARTITION BY l_suppkey, url ORDER BY l_orderkey, l_linenumber, l_shipdate) AS r FROM "
    f"(SELECT *, {i.product_url('l_partkey')} AS url FROM lineitem)) WHERE r = 1"
)

QUERIES = {
    "url_host": (url_host, f"SELECT page_id, {HOST_SQL.format(u='url')} AS host FROM pages"),
    "platform_detect": (
        platform_detect,
        f"WITH d(platform, paging, variant_support, display_name) AS (VALUES {_PLATFORM_ROWS}), "
        f"p AS (SELECT p_partkey, {i.HOST} AS host, lower({i.HOST}) AS h FROM part), "
        f"n AS (SELECT p_partkey, host, {_DETECT} AS platform FROM p) SELECT p_partkey, host, platform, "
        "display_name, paging, variant_support FROM n JOIN d USING (platform)",
    ),
    "url_class": (
        url_class,
        f"WITH p AS (SELECT p_partkey, {i.SHOP_URL} AS url, lower({i.HOST}) AS h FROM part), "
        f"n AS (SELECT p_partkey, url, {_DETECT} AS platform FROM p) SELECT *, CASE platform "
        "WHEN 'amazon' THEN contains(url, '/dp/') OR contains(url, '/gp/product/') "
        "WHEN 'flipkart' THEN contains(url, '/p/') OR contains(url, '/item/') "
        "WHEN 'myntra' THEN contains(url, '/buy/') WHEN 'ebay' THEN contains(url, '/itm/') "
        "WHEN 'walmart' THEN contains(url, '/ip/') ELSE len(string_split(url, '/')) > 6 AND "
        "regexp_matches(lower(url), 'product|item|buy|dp|p/|itm|ip/') END AS is_single FROM n",
    ),
    "url_canonical": (
        url_canonical,
        "SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS url FROM pages",
    ),
    "page_links": (page_links, f"SELECT page_id, ord, raw_href FROM ({_HREFS})"),
    "page_links_parsed": (page_links_parsed, f"SELECT page_id, ord, raw_href FROM ({_HREFS})"),
    "page_links_abs": (
        page_links_abs,
        "SELECT page_id, ord, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) || "
        f"{_ENCODED} AS url FROM ({_HREFS})",
    ),
    "link_resolution": (
        link_resolution,
        f"SELECT {', '.join(_LINES)}, {i.pick('(l_linenumber + l_suppkey) % 11', [b for _, b in _HREF_CASES])} AS url "
        "FROM lineitem",
    ),
    "links_per_host": (
        links_per_host,
        f"SELECT {HOST_SQL.format(u='url')} AS host, count(*) AS n_pages, CAST(sum(len(regexp_extract_all(html, "
        "'<a\\s[^>]*?href=\"([^\"]*)\"', 1))) AS BIGINT) AS n_links FROM pages GROUP BY 1",
    ),
    "page_title": (page_title, f"SELECT page_id, {H1} AS title FROM pages"),
    "page_title_native": (page_title_native, f"SELECT page_id, {H1} AS title FROM pages"),
    "sponsored_filter": (
        sponsored_filter,
        f"SELECT {', '.join(_LINES)}, {i.LINK_KIND} NOT IN (4, 8) AS not_excluded, "
        f"{i.LINK_KIND} NOT IN (5, 9) AS has_product_id, {i.LINK_KIND} NOT IN (3, 10) AS on_site FROM lineitem",
    ),
    "product_links": (
        product_links_query,
        "WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, "
        f"{i.clean_link(i.LINK_KIND, 'l_partkey')} AS url FROM lineitem), f AS (SELECT *, row_number() OVER "
        f"(PARTITION BY l_orderkey, url ORDER BY {', '.join(i.LINK_ORDER)}) AS r FROM c WHERE url IS NOT NULL), "
        f"n AS (SELECT l_orderkey, {_RANKED.format(p='l_orderkey', o=', '.join(i.LINK_ORDER))} AS ord, url "
        "FROM f WHERE r = 1) SELECT * FROM n WHERE ord <= 50",
    ),
    "top_links_per_page": (
        top_links_per_page,
        f"SELECT l_suppkey, ord, url FROM ({_UNIQUE_TOP}) WHERE ord <= 50",
    ),
    "link_progress": (
        link_progress_query,
        f"SELECT l_suppkey, ord, count(*) OVER (PARTITION BY l_suppkey) AS n_links FROM ({_UNIQUE_TOP}) "
        "WHERE ord <= 50",
    ),
}
