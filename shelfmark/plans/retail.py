"""End-to-end batch flow: sessions and snapshots to products, variants and totals."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nodes import with_dom
from ..functions.platforms import detect
from ..functions.urls import canonical, host, is_single_product
from ..operators import quarantine as quarantine_ops
from ..operators.extract import extract_products, kept_products, with_product
from ..operators.joins import first_rows, join_shuffled, likely_among, mark_likely
from ..operators.links import page_product_links
from ..operators.paging import has_next, listing_horizon, page_limit
from ..operators.summary import session_totals
from ..operators.variants import CARRY, dimensions, flatten_options, split_variants, variant_states
from ..operators.whitelist import label
from ..session import stage
from ..sources.platforms import supports_variants, with_platform_facts
from .rules import PlatformRules, rules_for


def on_platform(rules: PlatformRules, url: str = "url") -> Column:
    """Is the snapshot of the rules' platform? Tested before anything is parsed."""
    return detect(host(F.col(url))) == rules.name


def classify(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``domain``, ``platform`` and ``is_single`` by the URL alone."""
    return (
        df.withColumn("domain", host(F.col(url)))
        .withColumn("platform", detect(F.col("domain")))
        .withColumn("is_single", is_single_product(F.col(url), F.col("platform")))
    )


def classify_sessions(sessions: DataFrame) -> DataFrame:
    facts = with_platform_facts(classify(sessions, "start_url"))
    return facts.withColumn("page_limit", page_limit(F.col("page_limit"), F.col("paging")))


def single_requests(sessions: DataFrame) -> DataFrame:
    """Product requests of sessions that start at a product page."""
    return sessions.filter("is_single AND has_rules").select(
        "session_id",
        F.lit(1).alias("page_no"),
        F.lit(1).alias("link_ord"),
        F.col("start_url").alias("requested_url"),
    )


def listing_facts(listing_pages: DataFrame, rules: PlatformRules, walks: str | None = None) -> DataFrame:
    """Product links and next-page flag of listing snapshots; the HTML ends here.

    Pages whose column ``walks`` is not true are read, but their links are not looked for.
    """
    dom = with_dom(listing_pages.filter(on_platform(rules)), rules.wanted_listing())
    links, more = page_product_links(rules), has_next(rules)
    if walks:
        links, more = F.when(F.col(walks), links), F.when(F.col(walks), more)
    found = F.struct(links.alias("links"), more.alias("has_next"))
    return dom.select(
        "session_id", "page_no", "url", "parse_error", *([walks] if walks else []), F.inline(F.array(found))
    ).withColumn("n_links", F.coalesce(F.size("links"), F.lit(0)))


def _walking(sessions: DataFrame) -> DataFrame:
    return sessions.filter("NOT is_single AND has_rules AND page_limit IS NOT NULL")


def walked_pages(listing_pages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Listing snapshots of the sessions that walk at all, and of few others; tested before the parse."""
    return likely_among(listing_pages, F.col("session_id"), _walking(sessions), "session_id")


def listing_requests(facts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Product requests of listing sessions, page by page until the walk stops."""
    limits = sessions.filter("NOT is_single AND has_rules").select("session_id", "page_limit")
    walked = listing_horizon(facts, limits)
    links = walked.select("session_id", "page_no", F.posexplode("links").alias("i", "requested_url"))
    return links.select(
        "session_id", "page_no", (F.col("i") + 1).alias("link_ord"), "requested_url"
    )


def product_facts(pages: DataFrame, rules: PlatformRules) -> DataFrame:
    """Product record and variant dimensions of each product snapshot, read once.

    Only pages of the rules' platform are parsed. HTML is never shuffled: records
    are cut out first and joined afterwards.
    """
    dom = with_dom(pages.filter(on_platform(rules)), rules.wanted_product_and_variants())
    return with_product(dom, rules, dims=dimensions(rules))


_FACTS = (
    "page_id",
    "product_url",
    "title",
    "price",
    "seller_name",
    "manufacturer_name",
    "image_url",
    "parse_error",
    "dims",
)


def one_per_url(facts: DataFrame) -> DataFrame:
    """One record per canonical URL: a readable snapshot before an unreadable one, then the
    lowest page_id."""
    asked = "requested_url" if "requested_url" in facts.columns else "product_url"
    rows = facts.select(canonical(F.col(asked)).alias("key"), *_FACTS)
    order = [F.col("parse_error").isNotNull(), "page_id", F.xxhash64("product_url", "title", "price")]
    return first_rows(rows, ["key"], order)


class Result:
    """Outputs of the flow for one platform. Each is planned when it is asked for; what several
    of them read is staged the first time, so one output does not pay for the others."""

    def __init__(self, sessions, listing_pages, pages, variant_pages, whitelist, rules, on_missing, with_variants):
        self._given = sessions
        self._listing_pages, self._pages, self._variant_pages = listing_pages, pages, variant_pages
        self._whitelist, self._rules = whitelist, rules
        self._on_missing, self._with_variants = on_missing, with_variants

    @cached_property
    def _sessions(self) -> DataFrame:
        return stage(classify_sessions(self._given), "sessions")

    @cached_property
    def _own(self) -> DataFrame:
        """Sessions of the platform."""
        return self._sessions.filter(F.col("platform") == self._rules.name)

    @cached_property
    def _listings(self) -> DataFrame:
        """Of the sessions that walk; no other listing page is parsed, unless all are for another output."""
        if "_all_listings" in self.__dict__:
            return self._all_listings.filter("walks")
        return stage(listing_facts(walked_pages(self._listing_pages, self._own), self._rules), "listing-facts")

    @cached_property
    def _all_listings(self) -> DataFrame:
        """Of all listing pages; links of those that ``walked_pages`` would give."""
        pages = mark_likely(self._listing_pages, F.col("session_id"), _walking(self._own), "session_id", "walks")
        return stage(listing_facts(pages, self._rules, "walks"), "all-listing-facts")

    @cached_property
    def _requests(self) -> DataFrame:
        found = single_requests(self._own).unionByName(listing_requests(self._listings, self._own))
        return stage(found.withColumn("key", canonical(F.col("requested_url"))), "requests")

    @cached_property
    def _facts(self) -> DataFrame:
        """Of the pages that are asked for; no other product page is parsed."""
        wanted = likely_among(self._pages, canonical(F.col("url")), self._requests, "key")
        return stage(one_per_url(product_facts(wanted, self._rules)), "product-facts")

    @cached_property
    def _states(self) -> DataFrame:
        """Options of the pages that are asked for with the state they select."""
        wanted = likely_among(self._variant_pages, canonical(F.col("main_product_url")), self._requests, "key")
        return stage(self._selected(self._facts, wanted), "variants")

    @cached_property
    def _all_facts(self) -> DataFrame:
        return stage(one_per_url(product_facts(self._pages, self._rules)), "all-product-facts")

    def _selected(self, facts: DataFrame, variant_pages: DataFrame) -> DataFrame:
        records = extract_products(variant_pages.filter(on_platform(self._rules)), self._rules)
        mains = facts.filter("size(dims) > 0").withColumn("main_product_url", F.col("key"))
        mains = mains.filter(F.lit(self._with_variants))
        return variant_states(flatten_options(mains), records)

    def _requested(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumnRenamed("main_product_url", "key")
        found = join_shuffled(self._requests, rows, "key")
        return found.withColumnRenamed("requested_url", "main_product_url").drop("key")

    @cached_property
    def products(self) -> DataFrame:
        labelled = label(self._facts.filter("parse_error IS NULL").drop("dims"), self._whitelist)
        opened = join_shuffled(self._requests, labelled, "key")
        return kept_products(opened).drop("key", "page_id", "parse_error")

    @cached_property
    def variants(self) -> DataFrame:
        found, _ = split_variants(self._states, self._on_missing)
        return self._requested(label(found, self._whitelist))

    @cached_property
    def quarantine(self) -> DataFrame:
        """Of all snapshots given, asked for or not. Requests are then found among all listing pages, parsed once."""
        listings = self._all_listings
        opened = join_shuffled(self._requests, self._all_facts.select("key", "page_id", "parse_error"), "key", "left")
        missing = F.when(F.col("page_id").isNull(), F.lit("no snapshot")).otherwise(F.col("parse_error"))
        bad = F.when(~F.col("has_rules"), F.lit("no rules")).when(F.col("page_limit").isNull(), F.lit("page limit"))
        rows = (
            quarantine_ops.rejected(opened, "product", missing, F.col("page_id"), "requested_url")
            .unionByName(quarantine_ops.rejected(listings, "listing", F.col("parse_error")))
            .unionByName(quarantine_ops.rejected(self._sessions, "session", bad, url="start_url"))
        )
        return rows.unionByName(self.variant_quarantine)

    @cached_property
    def variant_quarantine(self) -> DataFrame:
        states = self._selected(self._all_facts, self._variant_pages)
        return split_variants(states, self._on_missing)[1]

    @cached_property
    def totals(self) -> DataFrame:
        """Of every session, also of those that found nothing."""
        variants = self._requested(split_variants(self._states, self._on_missing)[0])
        opened = join_shuffled(self._requests, self._facts.filter("parse_error IS NULL"), "key")
        return session_totals(self._sessions, kept_products(opened), variants)


def run(
    sessions: DataFrame,
    listing_pages: DataFrame,
    pages: DataFrame,
    variant_pages: DataFrame,
    whitelist: DataFrame,
    platform: str = "amazon",
    on_missing: str = CARRY,
    check_variant_support: bool = False,
) -> Result:
    """Both flows for one platform; rows of all sessions and pages are appended.

    Variants are always looked for unless ``check_variant_support`` asks to heed the
    platform dimension.
    """
    with_variants = supports_variants(platform) or not check_variant_support
    return Result(
        sessions, listing_pages, pages, variant_pages, whitelist, rules_for(platform), on_missing, with_variants
    )
