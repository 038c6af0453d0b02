"""Table schemas. Output columns are strings and never NULL."""

from __future__ import annotations

from pyspark.sql import types as T

# Headers of the two output tables.
PRODUCT_COLUMNS = (
    "product_url",
    "title",
    "price",
    "seller_name",
    "manufacturer_name",
    "image_url",
    "is_whitelisted",
)
VARIANT_COLUMNS = (
    "variant_product_url",
    "main_product_url",
    "title",
    "variant_price",
    "seller_name",
    "manufacturer_name",
    "image_url",
    "is_whitelisted",
)


def _strings(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


PRODUCTS = _strings(PRODUCT_COLUMNS)
VARIANTS = _strings(VARIANT_COLUMNS)

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
LISTING_PAGES = T.StructType(
    [
        T.StructField("session_id", T.LongType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
SESSIONS = T.StructType(
    [
        T.StructField("session_id", T.LongType()),
        T.StructField("start_url", T.StringType()),
        T.StructField("session_ts", T.TimestampType()),
        T.StructField("page_limit", T.StringType()),
    ]
)
VARIANT_PAGES = T.StructType(
    [
        T.StructField("main_product_url", T.StringType()),
        T.StructField("asin", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

#: One element of a page. ``ord``/``end`` are pre-order numbers: d lies inside a
#: iff ``a.ord < d.ord <= a.end``; siblings share ``parent``. ``own`` is the first
#: text node directly below the element. ``text`` is all text below it, with
#: U+001F where a line break or block boundary lies.
NODE = T.StructType(
    [
        T.StructField("ord", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("classes", T.ArrayType(T.StringType())),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("own", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
#: A parsed page: its elements, and for each index entry (``h1``, ``#title``,
#: ``.price``, ``[src]``) the positions of the elements it names.
DOM = T.StructType(
    [
        T.StructField("nodes", T.ArrayType(NODE)),
        T.StructField("index", T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))),
    ]
)
