"""Joins of tables that grow with the input are never broadcast, whatever size Spark estimates."""

import re

from pyspark.sql import functions as F

from shelfmark.operators.paging import listing_horizon
from shelfmark.operators.summary import products_with_variant_counts
from shelfmark.operators.variants import variant_states
from shelfmark.operators.whitelist import containing, label
from shelfmark.plans.rules import AMAZON

FIELDS = "product_url string, title string, price string, seller_name string, manufacturer_name string, image_url string, parse_error string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_options_meet_their_snapshots_by_shuffle(spark):
    options = spark.createDataFrame(
        [(1, "https://x.example/a", 1, "color", 1, "Red", "B1", *["own"] * 6, None), (1, "https://x.example/a", 1, "color", 2, "Blue", "B2", *["own"] * 6, None)],
        f"page_id long, main_product_url string, dim_ord int, dim string, opt_ord int, name string, asin string, {FIELDS}",
    )
    records = spark.createDataFrame([("https://x.example/a", "B2", *["found"] * 6, None)], f"main_product_url string, asin string, {FIELDS}")
    states = variant_states(options, records)
    assert "Broadcast" not in plan(states)
    assert {(r.asin, r.state.title, r.is_carried) for r in states.collect()} == {("B1", "own", True), ("B2", "found", False)}


def test_labels_are_found_by_shuffle(spark):
    rows = spark.createDataFrame([(1, "Big Shop", ""), (2, "op", ""), (3, "", "none"), (4, None, "My Shop 9")], "id long, seller_name string, manufacturer_name string")
    labelled = label(rows, spark.createDataFrame([("shop",), (None,)], "entry string"))
    assert "Broadcast" not in plan(labelled)
    assert {(r.id, r.is_whitelisted) for r in labelled.collect()} == {(1, "Whitelisted"), (2, "Whitelisted"), (3, "False"), (4, "Whitelisted")}


def test_long_texts_do_not_travel_with_their_pieces(spark):
    texts = spark.createDataFrame([("ab cd " * 50 + "x1",), ("ab cd " * 50 + "x2",)], "text string")
    patterns = spark.createDataFrame([("d x1",), ("cd ab",), ("x2",), ("zzzz",)], "pattern string")
    pairs = containing(texts, patterns)
    shuffled = [line for line in plan(pairs).splitlines() if "Exchange hashpartitioning(piece#" in line]
    carried = re.findall(r"explode\(pieces#\d+\), (\[[^]]*\])?", plan(pairs))
    assert shuffled and carried and not any("text#" in c or "pattern#" in c for c in carried)
    assert sorted((r.text[-2:], r.pattern) for r in pairs.collect()) == [("x1", "cd ab"), ("x1", "d x1"), ("x2", "cd ab"), ("x2", "x2")]


def test_counts_and_walks_are_joined_by_shuffle(spark):
    products = spark.createDataFrame([("u",), ("v",)], "requested_url string")
    counted = products_with_variant_counts(products, spark.createDataFrame([("u",)], "main_product_url string"))
    assert "Broadcast" not in plan(counted) and {tuple(r) for r in counted.collect()} == {("u", 1), ("v", 0)}
    pages = spark.createDataFrame([(1, 1, 2, True), (1, 2, 2, False), (1, 3, 2, True)], "session_id long, page_no int, n_links int, has_next boolean")
    walked = listing_horizon(pages, spark.createDataFrame([(1, 0)], "session_id long, page_limit long"))
    assert "Broadcast" not in plan(walked) and sorted(r.page_no for r in walked.collect()) == [1, 2]


def test_a_larger_stream_input_has_no_more_files(spark, monkeypatch):
    from shelfmark.catalog import sessions

    pages = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "'<p>' AS html").repartition(40)
    monkeypatch.setattr(sessions.i, "product_pages", lambda *_: pages)
    paths = []
    monkeypatch.setattr(sessions, "stream_pages", lambda spark, path, *_, **__: paths.append(path))
    sessions._staged_pages(spark, "")
    written = spark.read.parquet(paths[0])
    assert len(written.inputFiles()) <= sessions.STREAM_FILES and written.count() == 400


def test_marks_are_those_of_the_filter(spark):
    """Links are looked for on marked pages only; the others are read for their errors."""
    from shelfmark.operators.joins import likely_among, mark_likely
    from shelfmark.plans.retail import listing_facts

    rows = spark.createDataFrame([(k, n) for n, k in enumerate((*range(50), 7, None))], "k long, v long")
    keys = spark.createDataFrame([(k,) for k in (3, 3, 7, 900, None)], "k long")
    marked = mark_likely(rows, F.col("k"), keys, "k", "likely").collect()
    asked = sorted(map(str, likely_among(rows, F.col("k"), keys, "k").collect()))
    assert len(marked) == 52 and sorted(str(r).replace(", likely=True", "") for r in marked if r.likely) == asked
    page = "<a href='/x/dp/B000000001'>x</a><a>Next</a>"
    pages = spark.createDataFrame([(1, 1, "https://www.amazon.in/s", page, w) for w in (True, False, None)] + [(2, 1, "https://www.amazon.in/s", None, False)], "session_id long, page_no int, url string, html string, walks boolean")
    got = [(r.walks, r.n_links, r.has_next, r.parse_error) for r in listing_facts(pages, AMAZON, "walks").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(True, 1, True, None), (False, 0, None, None), (None, 0, None, None), (False, 0, None, "no html")]))
