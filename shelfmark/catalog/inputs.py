"""Retail pages, links and names derived row by row from the given tables.

The given tables hold no shop pages, so each query builds its input from them. The
generator texts below are plain SQL that both engines read alike; what they should
lead to is stated separately in each query's expected SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str, per_task: int = 2_500, most: DataFrame | None = None) -> DataFrame:
    """Narrow rows dealt by their number, before a page grows out of each.

    ``most`` is a plain table with at least as many rows; its count costs no computation.
    """
    return rows.repartition(max(1, -(-(rows if most is None else most).count() // per_task)), key)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages."""
    return table(spark, sf_dir, "pages")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that links are derived from."""
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    return table(spark, sf_dir, "lineitem").select(*cols)


def pick(key: str, values, default: str | None = None) -> str:
    """CASE over ``key``; values are SQL expressions by position."""
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"(CASE {key} {whens}{'' if default is None else ' ELSE ' + default} END)"


def q(text: str) -> str:
    assert "'" not in text and "\\" not in text, text
    return f"'{text}'"


def text_of(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def asin(key: str) -> str:
    return f"('B' || lpad({text_of(key)}, 9, '0'))"


# ------------------------------------------------------------- hosts and URLs

HOSTS = (
    "www.amazon.in",
    "www.flipkart.com",
    "www.myntra.com",
    "www.meesho.com",
    "www.ajio.com",
    "www.ebay.com",
    "www.redbubble.com",
    "www.snapdeal.com",
    "www.shopsy.in",
    "www.nykaa.com",
    "www.tatacliq.com",
    "dir.indiamart.com",
    "www.walmart.com",
    "notamazon.com",
    "ebay.amazon.example",
    "WWW.FLIPKART.COM",
    "amazon",
    "shopclues.com",
    "shop.example",
)
HOST = pick(f"p_partkey % {len(HOSTS)}", [q(h) for h in HOSTS])

PATHS = (
    "/dp/B0FMXNKHSW",
    "/s?k=shoes",
    "/s?k=/dp/",
    "/x/p/itm123",
    "/a/b/c/123/buy",
    "/a/b/c/buy/123",
    "/itm/123",
    "/ip/123",
    "/a/b/c/product/1",
    "/product/1",
    "/A/B/C/ITEM/1",
    "/gp/product/B0FMXNKHSW",
    "/a/item/7",
)
# 19 hosts and 13 paths are coprime: every pair occurs.
SHOP_URL = f"('https://' || {HOST} || {pick(f'p_partkey % {len(PATHS)}', [q(p) for p in PATHS])})"


def raw_link(kind: str, key: str) -> str:
    """Absolute raw link of one of 11 kinds that the product-link rules tell apart."""
    a = asin(key)
    return pick(
        kind,
        [
            f"'https://www.amazon.in/Shoe/dp/' || {a} || '?tag=x#r'",
            f"'https://www.amazon.in/Shoe/dp/' || {a} || '#r'",
            f"'https://www.amazon.in/Shoe/dp/' || {a} || '/ref=sr_1_1'",
            f"'https://www.amazon.com/Shoe/dp/' || {a}",
            f"'https://aax-eu-zaz.amazon.in/x/c/q/dp/' || {a}",
            f"'https://www.amazon.in/dp/' || lower({a})",
            f"'https://www.amazon.in/dp/' || {a} || 'XYZ'",
            f"'https://www.amazon.in/go?u=/dp/' || {a}",
            f"'https://www.amazon.in/dp/' || {a} || '?back=amazon.in/s?k=q'",
            f"'https://www.amazon.in/gp/product/' || {a}",
            f"'https://x.example/?u=amazon.in/dp/' || {a}",
        ],
    )


def clean_link(kind: str, key: str) -> str:
    """What the rules make of ``raw_link``; NULL where the link is dropped."""
    a = asin(key)
    return pick(
        kind,
        [
            f"'https://www.amazon.in/Shoe/dp/' || {a}",
            f"'https://www.amazon.in/Shoe/dp/' || {a}",
            f"'https://www.amazon.in/Shoe/dp/' || {a} || '/ref=sr_1_1'",
            "NULL",
            "NULL",
            "NULL",
            f"'https://www.amazon.in/dp/' || {a} || 'XYZ'",
            "'https://www.amazon.in/go'",
            "NULL",
            "NULL",
            "NULL",
        ],
    )


LINK_KIND = "(l_suppkey + l_linenumber) % 11"
LINK_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


# ------------------------------------------------------------- product pages

K = "p_partkey"
SIZE = text_of("p_size")
SHOP = f"('Shop ' || {text_of(K + ' % 97')})"
CDN = f"('cdn.example/' || {text_of(K)})"

TITLE_HTML = pick(
    f"{K} % 6",
    [
        "'<h1 id=\"title\"> ' || p_name || ' </h1>'",
        "'<h1> </h1><div class=\"product-title\">' || p_name || '</div>'",
        "'<h1>' || p_name || '&nbsp; X</h1>'",
        "''",
        "'<div data-testid=\"product-title\">' || p_name || '</div>'",
        "'<h1>Other</h1><h1 id=\"title\">' || p_name || '<br>&amp; co</h1>'",
    ],
)
TITLE = pick(
    f"{K} % 6",
    ["p_name", "p_name", "p_name || ' X'", "''", "p_name", "p_name || ' & co'"],
)

PRICE_HTML = pick(
    f"{K} % 7",
    [
        f"'<span class=\"a-price-whole\">' || {SIZE} || ',299</span>'",
        f"'<span class=\"a-price x\"><span class=\"a-offscreen\">$ ' || {SIZE} || '.50</span></span>'",
        f"'<b class=\"price\">MRP: ₹ ' || {SIZE} || '</b>'",
        f"'<span class=\"a-offscreen\">' || {SIZE} || '</span>'",
        "'<span class=\"product-price\">Free</span>'",
        f"'<i data-testid=\"price\">1.' || {SIZE} || ',00 €</i>'",
        f"'<p class=\"a-price-range\">₹' || {SIZE} || ' - ₹900</p>'",
    ],
)
PRICE = pick(
    f"{K} % 7",
    [
        f"'₹' || {SIZE} || ',299'",
        f"'₹' || {SIZE} || '.50'",
        f"'₹' || {SIZE}",
        "''",
        "'₹'",
        f"'₹1.' || {SIZE} || ',00'",
        f"'₹' || {SIZE} || '₹900'",
    ],
)

STOCK_HTML = pick(
    f"{K} % 5",
    [
        "''",
        "'<div id=\"availability\"><span>Currently OUT OF STOCK.</span></div>'",
        "'<div id=\"availability\"><span> </span></div><div id=\"outOfStock\">In stock</div>'",
        "'<div id=\"availability\"><span>In stock</span><span>Out of stock</span></div>'",
        "'<span class=\"a-color-state a-size-medium\">Only 2 left</span>'",
    ],
)
FINAL_PRICE = f"(CASE WHEN {K} % 5 = 1 THEN 'Out of stock' ELSE {PRICE} END)"

SELLER_HTML = pick(
    f"{K} % 8",
    [
        f"'<a id=\"sellerProfileTriggerId\">' || {SHOP} || '</a>'",
        f"'<span class=\"a-color-secondary a-size-small\">' || {SHOP} || '</span>'",
        f"'<a class=\"x a-link-normal\" href=\"/s\">' || {SHOP} || '</a>'",
        f"'<p><span>Sold by</span> <b>z</b><span>' || {SHOP} || '</span></p>'",
        f"'<div id=\"x-merchant-info\"><p><a href=\"/m\">' || {SHOP} || '</a></p></div>'",
        "''",
        f"'<div id=\"merchant-info\">  ' || {SHOP} || ' <script>var a=1;</script></div>'",
        f"'<div data-testid=\"seller-name\">' || {SHOP} || '</div>'",
    ],
)
MAKER_HTML = pick(
    f"{K} % 11",
    [
        "'<a id=\"bylineInfo\">' || p_brand || '</a>'",
        "'<ul class=\"a-unordered-list a-nostyle a-vertical a-spacing-none detail-bullet-list\">"
        "<li>x<li><span>Brand:</span> ' || p_brand || ' Packer: Q</ul>'",
        "'<div id=\"productDetails\"><table><tr><th>Manufacturer<td>' || p_brand || '</table></div>'",
        "''",
        "'<div id=\"detailBulletsWrapper_feature_div\"><span>Brand <i>x</i></span>"
        "<span>: ' || p_brand || ' :</span></div>'",
        "'<i class=\"manufacturer-name\">' || p_brand || '</i>'",
        "'<div id=\"productDetails_detailBullets_sections1\"><table><tr><th> Brand <td> ' || "
        "p_brand || ' Imported by Foo</table></div>'",
        "'<div id=\"productDetails\"><table><tr><th>Brand<td>Seller Direct</table></div>'",
        "''",
        "''",
        "''",
    ],
)
_CLASS_SHOP = f"{K} % 8 = 1"
_BYLINE = f"{K} % 11 = 0"
SELLER = (
    f"(CASE WHEN {K} % 8 IN (0, 1, 7) THEN {SHOP} WHEN {_BYLINE} THEN p_brand "
    f"WHEN {K} % 8 = 5 THEN '' ELSE {SHOP} END)"
)
MAKER = (
    f"(CASE WHEN {_BYLINE} THEN p_brand WHEN {_CLASS_SHOP} THEN {SHOP} "
    f"WHEN {K} % 11 IN (1, 2, 4, 5, 6) THEN p_brand ELSE '' END)"
)

IMAGE_HTML = pick(
    f"{K} % 9",
    [
        f"'<meta property=\"og:image\" content=\"//' || {CDN} || '.jpg\">'",
        f"'<meta property=\"og:image\" content=\" https://' || {CDN} || '.jpg\">'",
        f"'<img id=\"landingImage\" src=\"\" data-src=\"//' || {CDN} || '.png\">'",
        f"'<img class=\"a-dynamic-image\" src=\"data:a\" data-src=\"https://' || {CDN} || '.png\">'",
        f"'<img src=\"/rel.png\"><img id=\"imgBlkFront\" src=\"https://' || {CDN} || '.jpg\">'",
        f"'<img data-old-hires=\"z\" src=\"http://' || {CDN} || '.jpg\">'",
        "''",
        f"'<img class=\"a-dynamic-image\" data-lazy-src=\"https://' || {CDN} || '.webp\">'",
        f"'<p><img src=https://' || {CDN} || '.gif></p>'",
    ],
)
IMAGE = pick(
    f"{K} % 9",
    [
        f"'https://' || {CDN} || '.jpg'",
        "''",
        f"'https://' || {CDN} || '.png'",
        "''",
        f"'https://' || {CDN} || '.jpg'",
        f"'http://' || {CDN} || '.jpg'",
        "''",
        f"'https://' || {CDN} || '.webp'",
        f"'https://' || {CDN} || '.gif'",
    ],
)


def product_url(key: str = K) -> str:
    return f"('https://www.amazon.in/Item/dp/' || {asin(key)})"


PAGE_URL = f"({product_url()} || '?ref=' || {text_of(K)})"
NO_HTML = f"({K} % 101 IN (50, 51))"

# ------------------------------------------------------------- variants


def option_asin(slot: str, key: str = K) -> str:
    return asin(f"{key} * 10 + {slot}")


def _li(slot: int, inner: str, more: str = "") -> str:
    return f"'<li data-asin=\"' || {option_asin(str(slot))} || '\"{more}>{inner}</li>'"


def _swatch(text: str) -> str:
    return f'<span class="swatch-title-text-display"> {text} </span>'


def _row(name: str, *items: str) -> str:
    return f"'<div id=\"inline-twister-row-{name}\"><ul>' || {' || '.join(items)} || '</ul></div>'"


def _select(name: str, *options: str) -> str:
    body = " || ".join(options)
    return f"'<select name=\"{name}\">' || {body} || '</select>'"


def _opt(slot: int, text: str, with_asin: bool) -> str:
    code = option_asin(str(slot))
    if with_asin:
        return f"'<option value=\"v{slot}\" data-asin=\"' || {code} || '\">{text}'"
    return f"'<option value=\"' || {code} || '\">{text}</option>'"


_PLACEHOLDERS = "'<option value=\"\">Choose<option value=\"x\"> Select </option>'"
VARIANT_KIND = f"{K} % 6"
VARIANT_HTML = pick(
    VARIANT_KIND,
    [
        "''",
        _row(
            "color_name",
            _li(1, _swatch("Red")),
            _li(2, _swatch("Green"), ' data-initiallyUnavailable="true"'),
            _li(3, '<img alt=" Blue ">'),
        ),
        _row("size_name_name", _li(1, '<span class="swatch-title-text-display"> </span>')),
        _select("dropdown_selected_size_name", _PLACEHOLDERS, _opt(1, "S", False), _opt(2, "M", True)),
        _row("color_name", _li(1, _swatch("Red")), _li(2, _swatch("Blue")))
        + " || "
        + _row("size_name", _li(6, '<b class="a-button-text">XL</b>'))
        + " || "
        + _select(
            "dropdown_selected_color_name",
            _opt(3, "Cyan", True),
            _opt(4, "Pink", False),
            _opt(5, "Gold", True),
        ),
        _row("color_name", _li(1, _swatch("Red")), _li(2, _swatch("Blue")))
        + " || "
        + _row("size_name", _li(3, _swatch("S")), _li(4, _swatch("M")), _li(5, _swatch("L")))
        + " || "
        + _row("style_name", _li(7, _swatch("None"), " data-initiallyunavailable=true")),
    ],
)
#: Expected options: kind, dim_ord, dim, opt_ord, name, slot, is the value ``v<slot>``?
OPTIONS = (
    (1, 1, "color", 1, "Red", 1, False),
    (1, 1, "color", 2, "Blue", 3, False),
    (2, 1, "size_name", 1, "Unknown", 1, False),
    (3, 1, "size", 1, "S", 1, False),
    (3, 1, "size", 2, "M", 2, True),
    (4, 1, "color", 1, "Cyan", 3, True),
    (4, 1, "color", 2, "Pink", 4, False),
    (4, 1, "color", 3, "Gold", 5, True),
    (4, 2, "size", 1, "XL", 6, False),
    (5, 1, "color", 1, "Red", 1, False),
    (5, 1, "color", 2, "Blue", 2, False),
    (5, 2, "size", 1, "S", 3, False),
    (5, 2, "size", 2, "M", 4, False),
    (5, 2, "size", 3, "L", 5, False),
)
_OPTION_ROWS = ", ".join(
    f"({k}, {d}, '{dim}', {o}, '{name}', {slot}, {str(v).lower()})"
    for k, d, dim, o, name, slot, v in OPTIONS
)
OPTIONS_SQL = f"(VALUES {_OPTION_ROWS}) AS o(kind, dim_ord, dim, opt_ord, name, slot, coded)"
SLOTS = 6

PAGE_HTML = (
    "('<!DOCTYPE html><html><head><meta charset=utf-8>' || "
    f"(CASE WHEN {K} % 9 < 2 THEN {IMAGE_HTML} ELSE '' END) || '</head><body><div>' || "
    f"{TITLE_HTML} || {PRICE_HTML} || {STOCK_HTML} || '</div>' || {SELLER_HTML} || {MAKER_HTML} || "
    f"(CASE WHEN {K} % 9 < 2 THEN '' ELSE {IMAGE_HTML} END) || {VARIANT_HTML} || "
    "'<!-- ' || p_type || ' --></body></html>')"
)


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product snapshot per part; some without HTML."""
    html = f"CASE {K} % 101 WHEN 50 THEN NULL WHEN 51 THEN '' ELSE {PAGE_HTML} END"
    return dealt(table(spark, sf_dir, "part"), K).select(
        F.col(K).alias("page_id"), F.expr(PAGE_URL).alias("url"), F.expr(html).alias("html")
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product snapshots, some URLs with a second one: unreadable and earlier, or later and other."""
    own = product_pages(spark, sf_dir)
    earlier = own.filter("page_id % 7 = 2").select((-F.col("page_id")).alias("page_id"), "url", F.lit(None).cast("string").alias("html"))
    later = own.filter("page_id % 7 = 3").select((F.col("page_id") + (1 << 40)).alias("page_id"), "url", F.lit("<h1>Later</h1>").alias("html"))
    rows = earlier.unionByName(later)
    return own.unionByName(rows.filter("abs(page_id) % 1099511627776 % 101 NOT IN (50, 51)"))


HAS_VARIANT_PAGE = "(p_partkey + slot) % 3 <> 0"
BAD_VARIANT_PAGE = "((p_partkey + slot) % 9 = 0)"
VARIANT_TITLE = f"(p_name || ' v' || {text_of('slot')})"
VARIANT_PRICE = f"({text_of('slot')} || '00')"
VARIANT_PAGE_URL = f"('https://www.amazon.in/Item/dp/' || {option_asin('slot')})"


def variant_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of the pages behind variant options; about a third are missing or unreadable,
    and some readable ones have an unreadable twin with a lesser URL."""
    html = (
        f"'<h1>' || {VARIANT_TITLE} || '</h1><b class=\"price\">' || {VARIANT_PRICE} || '</b>"
        f"<i id=\"bylineInfo\">' || p_brand || '</i><p class=\"seller-name\">' || {SHOP} || '</p>'"
    )
    slots = F.explode(F.sequence(F.lit(1), F.lit(SLOTS))).alias("slot")
    every = dealt(table(spark, sf_dir, "part"), K).select("*", slots)
    twin = f"{HAS_VARIANT_PAGE} AND (p_partkey + slot) % 5 = 1"
    state = f"explode(CASE WHEN {twin} THEN array('good', 'twin') WHEN {HAS_VARIANT_PAGE} THEN array('good') WHEN {BAD_VARIANT_PAGE} THEN array('bad') ELSE array() END)"
    rows = every.withColumn("state", F.expr(state))
    url = f"CASE state WHEN 'twin' THEN 'https://www.amazon.in/A' ELSE {VARIANT_PAGE_URL} END"
    html = f"CASE state WHEN 'good' THEN {html} END"
    return rows.select(
        F.expr(product_url()).alias("main_product_url"),
        F.expr(option_asin("slot")).alias("asin"),
        F.expr(url).alias("url"),
        F.expr(html).alias("html"),
    )


# ------------------------------------------------------------- sessions

SESSION_KIND = "o_orderkey % 7"
START_URL = pick(
    SESSION_KIND,
    [
        f"{product_url('o_orderkey % 3000')} || '?th=1'",
        "'https://www.amazon.in/s?k=shoes'",
        "'https://www.amazon.in/b?node=1'",
        "'https://www.flipkart.com/search?q=x'",
        "'https://www.amazon.in/s?k=bags'",
        "'https://www.amazon.in/s?k=hats'",
        "'https://shop.example/list'",
    ],
)
LIMIT_TEXT = pick("o_orderkey % 6", ["''", "'0'", "' 2 '", "'-1'", "'x'", "'3'"])
LIMIT = pick("o_orderkey % 6", ["100", "0", "2", "NULL", "NULL", "3"])


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session_id"),
        F.expr(START_URL).alias("start_url"),
        F.col("o_orderdate").alias("session_ts"),
        F.expr(LIMIT_TEXT).alias("page_limit"),
    )


#: One listing page per (order, line number); gaps in the numbers end a walk.
LISTING_SQL = (
    "SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk FROM lineitem "
    "GROUP BY l_orderkey, l_linenumber"
)
NEXT_HTML = pick(
    "pk % 5",
    [
        "'<a href=\"/n\" aria-label=\"Next Page\">more</a>'",
        "'<a href=\"/n\">NEXT</a>'",
        "'<a href=\"/n\" aria-label=\"Next Page\">a</a><a href=\"/m\" aria-label=\"Next Page\">b</a>"
        "<ul class=\"a-pagination\"><li class=\"a-last\"><a href=\"/n\">more</a></li></ul>'",
        "'<a href=\"/n\" aria-label=\"Next Page\" aria-disabled=\"true\">more</a>'",
        "'<span data-testid=\"pagination-next-button\">more</span>'",
    ],
)
HAS_NEXT = "(pk % 5 <> 3)"
NO_LINKS = "(pk % 9 = 4)"


#: A quarter of the pages name their links' folder in a base element.
_BASE = "(CASE pk % 4 WHEN 3 THEN '<base href=\"https://www.amazon.in/Item/dp/\">' ELSE '' END)"
_FOLDER = "(CASE pk % 4 WHEN 3 THEN '' ELSE '/Item/dp/' END)"


def _anchor(key: str, tail: str = "") -> str:
    return f"'<li><a href=\"' || {_FOLDER} || {asin(key)} || '{tail}\">x</a></li>'"


LISTING_HTML = (
    f"({_BASE} || '<ul>' || (CASE WHEN {NO_LINKS} THEN '<li><a href=\"/s?k=none\">x</a></li>' ELSE "
    f"{_anchor('pk', '?ref=a')} || {_anchor('pk + 1')} || {_anchor('pk', '#top')} || "
    f"'<li><a href=\"https://aax-eu-zaz.amazon.in/x/c/q/dp/' || {asin('pk')} || '\">ad</a></li>' || "
    f"{_anchor('pk + 2', '?tag=b')} END) || '</ul>' || {NEXT_HTML})"
)


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_partkey").alias("pk"))
    )
    return dealt(lines, "l_orderkey", 25_000, table(spark, sf_dir, "lineitem")).select(
        F.col("l_orderkey").alias("session_id"),
        F.col("l_linenumber").alias("page_no"),
        F.lit("https://www.amazon.in/s?k=q").alias("url"),
        F.expr(LISTING_HTML).alias("html"),
    )
