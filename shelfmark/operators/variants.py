"""Variant dimensions of a product page and the records of its variants."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.selectors import sql_attr, sql_select, sql_within, tag
from ..functions.text import (
    sql_collapse,
    sql_literal,
    sql_non_blank,
    sql_strip,
    sql_text_content,
)
from ..functions.urls import canonical
from ..plans.rules import PlatformRules
from .extract import FIELDS
from .joins import first_rows, join_shuffled
from .quarantine import rejected

UNKNOWN = "Unknown"
CARRY, QUARANTINE = "carry_forward", "quarantine"


def _drop_first(x: str, literal: str) -> str:
    pattern = "(?s)^(.*?)" + re.escape(literal)
    return f"regexp_replace({x}, {sql_literal(pattern)}, '$1')"


def _dimension_name(x: str, prefix: str, suffix: str) -> str:
    return _drop_first(_drop_first(x, prefix), suffix)


def _first_inside(pool: str, o: str) -> str:
    """First element of ``pool`` inside element ``o``."""
    return f"get(filter({pool}, x -> {sql_within('x', o)}), 0)"


def swatch_dimensions(rules: PlatformRules, dom: str = "dom") -> str:
    """SQL array of (dim, options) of the swatch rows; unavailable options left out.

    What can name an option is first narrowed to the row, once, so that a page full of
    images costs one pass per row and not one per option.
    """
    pools = dict(zip(("t", "i", "b"), rules.swatch_name), o=rules.swatch_option)
    in_row = ", ".join(
        f"'{k}', filter({sql_select(dom, sel)}, x -> {sql_within('x', 'r')})"
        for k, sel in pools.items()
    )
    names = [
        sql_strip(sql_text_content(_first_inside("p.t", "o") + ".text")),
        sql_strip(sql_attr(_first_inside("p.i", "o"), "alt")),
        sql_strip(sql_text_content(_first_inside("p.b", "o") + ".text")),
    ]
    name = f"coalesce({', '.join(map(sql_non_blank, names))}, {sql_literal(UNKNOWN)})"
    asin = sql_attr("o", "data-asin")
    there = f"coalesce({sql_attr('o', rules.swatch_gone)} <> 'true', true)"
    options = (
        f"transform(filter(p.o, o -> {there}), "
        f"o -> named_struct('name', {name}, 'asin', {asin}, 'value', {asin}))"
    )
    dim = _dimension_name("r.id", rules.swatch_row_prefix, rules.dimension_suffix)
    row = (
        f"get(transform(array(named_struct({in_row})), "
        f"p -> named_struct('dim', {dim}, 'options', {options})), 0)"
    )
    return f"transform({sql_select(dom, rules.swatch_row)}, r -> {row})"


def dropdown_dimensions(rules: PlatformRules, dom: str = "dom") -> str:
    """SQL array of (dim, options) of the dropdowns; placeholders left out."""
    text = sql_text_content("o.text")
    value = f"coalesce({sql_attr('o', 'value')}, {sql_collapse(text)})"
    asin = f"coalesce({sql_non_blank(sql_attr('o', 'data-asin'))}, {value})"
    real = f"{value} <> '' AND {sql_strip(text)} <> {sql_literal(rules.dropdown_placeholder)}"
    options = (
        f"transform(filter({sql_select(dom, tag('option'))}, o -> {sql_within('o', 's')} AND {real}), "
        f"o -> named_struct('name', {sql_strip(text)}, 'asin', {asin}, 'value', {value}))"
    )
    dim = _dimension_name(sql_attr("s", "name"), rules.dropdown_prefix, rules.dimension_suffix)
    boxes = sql_select(dom, rules.dropdown)
    return f"transform({boxes}, s -> named_struct('dim', {dim}, 'options', {options}))"


def dimensions(rules: PlatformRules, dom: str = "dom") -> Column:
    """``array<struct<dim, options array<struct<name, asin, value>>>>`` of a parsed page.

    Dimensions without options vanish. Of several with one name the last one's
    options count, in the place of the first.
    """
    parts = [swatch_dimensions(rules, dom), dropdown_dimensions(rules, dom)]
    both = f"concat({', '.join(f'coalesce({p}, array())' for p in parts)})"
    named = (
        "transform(array_distinct(transform(ds, d -> d.dim)), k -> named_struct('dim', k, "
        "'options', element_at(filter(ds, d -> d.dim = k), -1).options))"
    )
    return F.expr(f"get(transform(array(filter({both}, d -> size(d.options) > 0)), ds -> {named}), 0)")


def flatten_options(df: DataFrame, dims: str = "dims") -> DataFrame:
    """One row per option: dimensions one after another, not their cross product."""
    keep = [c for c in df.columns if c != dims]
    by_dim = df.select(*keep, F.posexplode(dims).alias("dim_ord", "_d"))
    by_opt = by_dim.select(
        *keep,
        (F.col("dim_ord") + 1).alias("dim_ord"),
        F.col("_d.dim").alias("dim"),
        F.posexplode("_d.options").alias("opt_ord", "_o"),
    )
    return by_opt.select(
        *keep, "dim_ord", "dim", (F.col("opt_ord") + 1).alias("opt_ord"), F.col("_o.*")
    )


_STATE = ("product_url", *FIELDS, "parse_error")


def one_per_option(records: DataFrame) -> DataFrame:
    """Variant records keyed by (main page, ASIN).

    Of several snapshots a readable one counts before an unreadable one, then the lowest
    URL, then a hash of the record.
    """
    key = canonical(F.col("main_product_url")).alias("main_key")
    rows = records.select(key, "asin", F.struct(*_STATE).alias("variant"))
    order = [F.col("variant.parse_error").isNotNull(), "variant.product_url", F.xxhash64("variant")]
    return first_rows(rows, ["main_key", "asin"], order)


def carry_states(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Options with their own ``variant`` record or NULL to the ``state`` each one selects.

    An unmatched option keeps the state before it, at first the main page's own record. The
    window covers the options of one page, which ``keys`` tell apart.
    """
    w = (
        Window.partitionBy(*keys)
        .orderBy("dim_ord", "opt_ord")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    state = F.coalesce(F.last("variant", ignorenulls=True).over(w), F.struct(*_STATE))
    return joined.withColumns({"state": state, "is_carried": F.col("variant").isNull()}).drop("variant")


def variant_states(
    options: DataFrame,
    records: DataFrame,
    page: str = "page_id",
    main_url: str = "main_product_url",
) -> DataFrame:
    """Join every option to its snapshot and carry the last one over unmatched options.

    ``options`` are flattened and still hold the main page's own record. Pages are told apart
    by URL and page together, as a page_id may be missing or shared.
    """
    return states_among(options, one_per_option(records), page, main_url)


def states_among(options: DataFrame, kept: DataFrame, page: str = "page_id", main_url: str = "main_product_url") -> DataFrame:
    """``variant_states`` where ``one_per_option`` has chosen the records already."""
    keyed = options.withColumn("main_key", canonical(F.col(main_url)))
    joined = join_shuffled(keyed, kept, ["main_key", "asin"], "left")
    return carry_states(joined, ["main_key", page]).drop("main_key")


def variant_records(
    states: DataFrame, main_url: str = "main_product_url", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Variant table with its internal extras; pages that could not be read are left out."""
    s = {k: F.col(f"state.{k}") for k in _STATE}
    extra = [c for c in (*keep, "dim_ord", "opt_ord", "is_carried") if c in states.columns]
    return states.filter(s["parse_error"].isNull()).select(
        *extra,
        s["product_url"].alias("variant_product_url"),
        F.col(main_url).alias("main_product_url"),
        s["title"].alias("title"),
        s["price"].alias("variant_price"),
        s["seller_name"].alias("seller_name"),
        s["manufacturer_name"].alias("manufacturer_name"),
        s["image_url"].alias("image_url"),
        s["price"].alias("price"),
        s["product_url"].alias("product_url"),
        F.col("dim").alias("variant_type"),
        F.col("name").alias("variant_option"),
        F.col("asin").alias("variant_asin"),
    )


def split_variants(
    states: DataFrame,
    on_missing: str = CARRY,
    main_url: str = "main_product_url",
    keep: tuple[str, ...] = (),
    keep_aside: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """Variant records of joined options, and quarantine rows of the others.

    An option whose state cannot be read yields no record but a quarantine row; so does an
    option without snapshot if ``on_missing`` says so.
    """
    if on_missing not in (CARRY, QUARANTINE):
        raise ValueError(on_missing)
    error, found = F.col("state.parse_error"), states
    if on_missing == QUARANTINE:
        error = F.when(F.col("is_carried"), F.lit("no snapshot")).otherwise(error)
        found = states.filter(~F.col("is_carried"))
    named = states.withColumn("_url", F.concat_ws("#", main_url, "asin"))
    aside = rejected(named, "variant", error, url="_url", keep=keep_aside)
    return variant_records(found, main_url, keep), aside


def extract_variants(
    mains: DataFrame,
    records: DataFrame,
    on_missing: str = CARRY,
    page: str = "page_id",
    main_url: str = "main_product_url",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Variants of product pages: ``mains`` with ``dims`` and product fields, joined to
    the product records of variant snapshots (``main_product_url, asin, …``)."""
    states = variant_states(flatten_options(mains), records, page, main_url)
    return split_variants(states, on_missing, main_url, keep)[0]
