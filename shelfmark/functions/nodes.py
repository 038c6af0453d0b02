"""The one Python function of the library: page HTML to an indexed array of elements."""

from __future__ import annotations

import gc
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from .markup import read_elements
from .selectors import Wanted

_NODE = pa.struct(
    [
        ("ord", pa.int32()),
        ("end", pa.int32()),
        ("parent", pa.int32()),
        ("tag", pa.string()),
        ("id", pa.string()),
        ("classes", pa.list_(pa.string())),
        ("attrs", pa.map_(pa.string(), pa.string())),
        ("own", pa.string()),
        ("text", pa.string()),
    ]
)

def _offsets(sizes) -> pa.Array:
    return pa.array(list(accumulate(sizes, initial=0)), type=pa.int32())


def _maps(dicts, value_type: pa.DataType) -> pa.Array:
    """Arrow map array of Python dictionaries with plain values."""
    keys = [k for d in dicts for k in d]
    values = [v for d in dicts for v in d.values()]
    return pa.MapArray.from_arrays(
        _offsets(map(len, dicts)), pa.array(keys, pa.string()), pa.array(values, value_type)
    )


def _to_arrow(pages: list) -> pa.Array:
    """Pack a batch of ``(elements, index)`` pages into one Arrow struct array."""
    missing = [p is None for p in pages]
    elements = [p[0] if p is not None else [] for p in pages]
    flat = [e for page in elements for e in page]
    cols = list(zip(*flat)) if flat else [()] * len(_NODE)
    arrays = [
        _maps(values, pa.string()) if f.name == "attrs" else pa.array(values, type=f.type)
        for f, values in zip(_NODE, cols)
    ]
    nodes = pa.ListArray.from_arrays(
        _offsets(map(len, elements)), pa.StructArray.from_arrays(arrays, fields=list(_NODE))
    )
    indexes = [p[1] if p is not None else {} for p in pages]
    index = _maps(indexes, pa.list_(pa.int32()))
    return pa.StructArray.from_arrays(
        [nodes, index], names=["nodes", "index"], mask=pa.array(missing, type=pa.bool_())
    )


def read_batch(batch: pa.Array, wanted: Wanted) -> pa.Array:
    """Elements of each page of a batch; a page that is missing or cannot be read is NULL."""
    collects = gc.isenabled()
    gc.disable()  # what is read holds no cycles; the collector would walk it again and again
    try:
        pages = []
        for text in batch.to_pylist():
            try:
                pages.append(read_elements(text, wanted) if text else None)
            except Exception:  # one bad page must not stop the others
                pages.append(None)
        return _to_arrow(pages)
    finally:
        if collects:
            gc.enable()


def page_dom(html: Column, wanted: Wanted) -> Column:
    """Elements of each page that ``wanted`` names; NULL where HTML is missing or unreadable.

    Declared non-deterministic so that the optimizer never copies the call into a
    filter or a second projection: a page is parsed once.
    """

    return F.arrow_udf(lambda batch: read_batch(batch, wanted), schemas.DOM).asNondeterministic()(html)


def with_dom(df: DataFrame, wanted: Wanted, html: str = "html") -> DataFrame:
    """Replace the HTML column by ``dom`` and ``parse_error``."""
    has_html = F.coalesce(F.length(html) > 0, F.lit(False))
    error = F.when(~F.col("_has_html"), F.lit("no html")).when(
        F.col("dom").isNull(), F.lit("unreadable html")
    )
    return (
        df.select("*", page_dom(F.col(html), wanted).alias("dom"), has_html.alias("_has_html"))
        .withColumn("parse_error", error)
        .drop(html, "_has_html")
    )
