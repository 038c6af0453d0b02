"""Structured Streaming: snapshots in, product and variant rows out as they arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.nodes import with_dom
from ..functions.urls import host
from ..operators.extract import extract_products, keep_record, kept_products, with_product
from ..operators.quarantine import rejected
from ..operators.variants import CARRY, dimensions, flatten_options, one_per_option, split_variants, states_among
from ..operators.whitelist import label
from ..plans.rules import PlatformRules
from ..session import stage
from ..sinks.runs import ChangeLog
from ..sinks.tables import product_rows, variant_rows


def page_records(pages: DataFrame, rules: PlatformRules) -> DataFrame:
    """Product record and variant dimensions per page; stateless, batch or stream."""
    return with_product(
        with_dom(pages, rules.wanted_product_and_variants()), rules, dims=dimensions(rules)
    )


def start_dual_sink(
    pages: DataFrame,
    variant_pages: DataFrame,
    rules: PlatformRules,
    whitelist: DataFrame,
    out: str,
    checkpoint: str,
    once: bool = True,
    on_missing: str = CARRY,
) -> StreamingQuery:
    """Append products, then their variants, then quarantine rows of every micro-batch.

    ``variant_pages`` is a table of snapshots, parsed and chosen from once before the stream starts;
    where they arrive meanwhile, use ``catalog.start_catalog``. Each batch writes to folders named by its id
    and replaces them, and ``checkpoint`` remembers which batches are done, so a restart neither
    loses nor repeats rows. Pages are parsed once per batch.
    """
    records = stage(one_per_option(extract_products(variant_pages, rules)), "variant-records")

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = batch.persist()
        try:
            mains = parsed.filter("parse_error IS NULL").withColumn("main_product_url", F.col("product_url"))
            states = states_among(flatten_options(mains), records)
            variants, aside = split_variants(states, on_missing)
            products = kept_products(parsed).drop("dims").withColumn("table", F.lit("products"))
            # both tables are labelled at once
            named = products.unionByName(variants.withColumn("table", F.lit("variants")), allowMissingColumns=True)
            labelled = stage(label(named, whitelist), "labelled")
            unread = rejected(parsed, "product", F.col("parse_error"), F.col("page_id"), "product_url")
            outputs = {
                "products": product_rows(labelled.filter("table = 'products'")),
                "variants": variant_rows(labelled.filter("table = 'variants'")),
                "quarantine": unread.unionByName(aside),
            }
            for name, rows in outputs.items():
                rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        finally:
            parsed.unpersist()

    writer = page_records(pages, rules).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def start_totals(
    pages: DataFrame,
    rules: PlatformRules,
    out: str,
    checkpoint: str,
    once: bool = True,
    by: str = "domain",
    compact_after: int = 64,
) -> StreamingQuery:
    """Running product and variant totals per session or domain; each batch commits what changed.

    ``by`` is a column of the pages, such as ``session_id``, or ``domain``. After ``compact_after``
    batches the changes become one base table, so readers never open more folders than that.
    """
    spark = pages.sparkSession
    records = page_records(pages, rules)
    key: Column = host(F.col("product_url")) if by == "domain" else F.col(by)
    is_product = keep_record(F.col("title"), F.col("price")).cast("bigint")
    options = F.aggregate(
        "dims", F.lit(0).cast("bigint"), lambda n, d: n + F.size(d["options"]).cast("bigint")
    )
    totals = records.groupBy(key.alias("key")).agg(
        F.sum(is_product).alias("total_products"),
        F.sum(F.coalesce(options, F.lit(0).cast("bigint"))).alias("total_variants"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        log = ChangeLog(spark, f"{out}/totals")
        if log.has(number=batch_id):
            return
        rows = batch.withColumn("version", F.lit(batch_id).cast("long")).persist()
        try:
            log.append({ChangeLog.CHANGED: rows.select("key", "version"), "totals": rows}, number=batch_id)
        finally:
            rows.unpersist()
        log.compact(after=compact_after)

    writer = totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def read_totals(spark: SparkSession, out: str, by: str = "domain") -> DataFrame:
    """Latest totals of each session or domain."""
    rows = ChangeLog(spark, f"{out}/totals").latest("totals")
    return rows.select(F.col("key").alias(by), "total_products", "total_variants")
