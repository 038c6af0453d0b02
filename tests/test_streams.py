"""Streams whose inputs arrive in any order give what the batch gives."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators.extract import extract_products, kept_products
from shelfmark.operators.variants import flatten_options, split_variants, variant_states
from shelfmark.operators.whitelist import label
from shelfmark.plans.retail import classify_sessions, listing_facts, listing_requests, on_platform, one_per_url, product_facts, run, single_requests
from shelfmark.plans.rules import AMAZON
from shelfmark.sinks.runs import RunLog
from shelfmark.sinks.tables import product_rows, variant_rows
from shelfmark.sources.pages import stream_pages
from shelfmark.sources.whitelist import from_setting
from shelfmark.streaming.catalog import read_catalog, start_catalog
from shelfmark.streaming.extract import read_totals, start_dual_sink, start_totals
from shelfmark.streaming.walk import read_rejected, read_requests, start_requests

SITE = "https://www.amazon.in"


def bag(df):
    return sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())


class Folder:
    """A folder of snapshots to which files are added one by one."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema
        spark.createDataFrame([], schema).coalesce(1).write.parquet(self.path)

    def add(self, *rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self, files=None):
        return stream_pages(self.spark, self.path, self.schema, files_per_batch=files)

    def table(self):
        return self.spark.read.schema(self.schema).parquet(self.path)


# ---------------------------------------------------------------- listing walks


def listing(session, no, *codes, more=True):
    links = "".join(f'<a href="/x/dp/{c}">x</a>' for c in codes)
    return session, no, f"{SITE}/s?k=q", f"{links}<a href='/n'>{'Next' if more else 'End'}</a>"


def code(n):
    return f"B{n:09d}"


SESSIONS = [
    (1, f"{SITE}/s?k=a", None, ""),
    (2, f"{SITE}/s?k=b", None, "2"),
    (3, f"{SITE}/x/dp/{code(7)}", None, ""),
    (4, "https://shop.example/list", None, ""),
    (5, f"{SITE}/s?k=c", None, "-1"),
    (6, f"{SITE}/s?k=d", None, "0"),
    (7, f"{SITE}/s?k=e", None, "1"),
]
PAGES = [
    *(listing(1, n, code(n), code(n + 1)) for n in (1, 2, 3, 5)),
    *(listing(2, n, code(20 + n)) for n in (1, 2, 3)),
    listing(5, 1, code(50)),
    listing(6, 1, code(60)),
    listing(6, 2, code(61), more=False),
    listing(6, 3, code(62)),
    listing(6, 2, code(63), code(64)),  # a second snapshot of a page
    listing(1, 3),  # and one that ends the walk
    (7, 1, f"{SITE}/s?k=e", None),
    listing(9, 1, code(90)),
    listing(1, 0, code(99)),
    listing(None, 1, code(98)),
]


def batch_requests(sessions, pages):
    own = classify_sessions(sessions).filter("platform = 'amazon'")
    facts = listing_facts(pages.filter("page_no >= 1"), AMAZON)
    return single_requests(own).unionByName(listing_requests(facts, own))


@pytest.mark.parametrize("order", ["pages first", "backwards", "at once"])
def test_requests_for_any_order_of_files(spark, tmp_path, order):
    sessions, pages = (Folder(spark, tmp_path / n, s) for n, s in (("s", schemas.SESSIONS), ("p", schemas.LISTING_PAGES)))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def go():
        start_requests(sessions.stream(), pages.stream(), AMAZON, out, mark, compact_after=2).awaitTermination()

    halves = (lambda: sessions.add(*SESSIONS)), (lambda: [pages.add(*c) for c in itertools.batched(PAGES, 5)])
    if order == "pages first":
        halves = halves[::-1]
    if order == "backwards":
        for rows in (PAGES[6:], PAGES[:6]):
            pages.add(*rows)
            go()
        sessions.add(*SESSIONS)
    else:
        for half in halves:
            half()
            if order != "at once":
                go()
    go()
    if order == "at once":
        go()  # finds nothing new
    want = batch_requests(sessions.table(), pages.table())
    assert bag(read_requests(spark, out)) == bag(want)
    assert {r.session_id for r in want.collect()} == {1, 2, 3, 6}
    assert sorted((r.stage, r.error) for r in read_rejected(spark, out).collect()) == [("listing", "no html"), ("session", "no rules"), ("session", "page limit")]


def test_a_page_beyond_the_stop_is_taken_back(spark, tmp_path):
    sessions, pages = (Folder(spark, tmp_path / n, s) for n, s in (("s", schemas.SESSIONS), ("p", schemas.LISTING_PAGES)))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    sessions.add(SESSIONS[0])
    pages.add(*(listing(1, n, code(n)) for n in (1, 2, 3)))
    for again in ([], [listing(1, 2)], [listing(1, 4, code(4)), listing(1, 1, code(8))]):
        if again:
            pages.add(*again)
        start_requests(sessions.stream(), pages.stream(), AMAZON, out, mark).awaitTermination()
    assert sorted(r.requested_url[-1] for r in read_requests(spark, out).collect()) == ["1", "8"]
    assert RunLog(spark, out).read("requests").count() == 4
    assert [r.stop for r in RunLog(spark, out).read("stops").collect()] == [2]


def test_walks_by_tables_are_the_walks_by_key(spark, tmp_path):
    """Batch by batch the same requests and stops, and no Python call per session where the state is a table."""
    rnd = random.Random(5)
    starts = [(s, f"{SITE}/s?k=a" if s % 4 else f"{SITE}/x/dp/{code(s)}", None, ("", "0", "3", "x")[s % 5 % 4]) for s in (*range(1, 30), 3)]
    rows = [listing(s, no, *[code(100 * s + no + k) for k in range(rnd.choice((0, 1, 1, 1, 2, 2, 2)))], more=rnd.random() < 0.9) for s in range(35) for no in range(1, 8) for _ in range(rnd.choice((0, 1, 1, 1, 2)))]
    rows += [listing(1, no, code(no)) for no in range(8, 40)]
    rnd.shuffle(rows)
    found = {}
    for keyed in (True, False):
        sessions, pages = (Folder(spark, tmp_path / f"{n}{keyed}", s) for n, s in (("s", schemas.SESSIONS), ("p", schemas.LISTING_PAGES)))
        out, mark = str(tmp_path / f"out{keyed}"), str(tmp_path / f"mark{keyed}")
        for some, more in zip((starts[:10], starts[10:], []), itertools.batched(rows, -(-len(rows) // 3))):
            if some:
                sessions.add(*some)
            pages.add(*more)
            query = start_requests(sessions.stream(), pages.stream(), AMAZON, out, mark, compact_after=2, keyed=keyed)
            query.awaitTermination()
            assert bool(query.lastProgress["stateOperators"]) == keyed
        log = RunLog(spark, out)
        found[keyed] = [bag(read_requests(spark, out)), bag(read_rejected(spark, out)), bag(log.read("requests")), bag(log.read("stops"))]
    assert found[False] == found[True]
    own = bag(batch_requests(sessions.table().filter("session_id <> 3"), pages.table()))
    assert own == [r for r in found[False][0] if r[-1] != "3"] and len(own) > 50


# ---------------------------------------------------------------- products and variants


def product(title, asins=(), price="<b class='price'>₹5</b>"):
    options = "".join(f"<li data-asin={a}><span class='swatch-title-text-display'>{a}</span></li>" for a in asins)
    return f"<h1>{title}</h1>{price}<div id=inline-twister-row-color_name><ul>{options}</ul></div>"


def url(n):
    return f"{SITE}/x/dp/{code(n)}"


SNAPSHOTS = [
    (5, url(1) + "?a", product("One", [code(11), code(12), code(13)])),
    (3, url(1), None),
    (4, url(1) + "#b", product("One first", [code(11), code(12), code(13), code(14)])),
    (None, url(2), product("Two", [code(21)])),
    (None, url(3), product("Three", [code(31), code(32)])),
    (6, url(4), None),
    (7, url(5), ""),
    (7, url(6), product("Six", [code(21), code(61)])),
    (8, url(7), product("", [code(71)], "")),
    (9, "https://www.ebay.com/itm/1", product("Other")),
    (10, None, product("Nowhere")),
    (11, url(5), product("Five")),
]
VARIANTS = [
    (url(1), code(12), url(12), product("Blue")),
    (url(1) + "?x", code(12), url(10), product("Blue, lower URL")),
    (url(1), code(13), url(13), None),
    (url(1), code(14), url(14), product("Late")),
    (url(2), code(21), url(21), product("Two A")),
    (url(3), code(32), url(32), product("Three B")),
    (url(6), code(21), url(21), None),
    (url(6), code(21), url(22), product("Six A, readable")),
    (url(7), code(71), url(71), product("Seven A")),
    (url(8), code(81), url(81), product("No main page")),
    (url(1), None, url(82), product("No ASIN")),
    (None, code(11), url(83), product("No main URL")),
]


def batch_catalog(pages, variants, whitelist):
    facts = one_per_url(product_facts(pages.filter(on_platform(AMAZON)), AMAZON))
    records = extract_products(variants.filter(on_platform(AMAZON)), AMAZON)
    mains = facts.filter("size(dims) > 0").withColumn("main_product_url", F.col("key"))
    found, aside = split_variants(variant_states(flatten_options(mains), records))
    unread = facts.filter("parse_error IS NOT NULL").selectExpr("page_id", "product_url AS url", "'product' AS stage", "parse_error AS error")
    return {
        "products": product_rows(label(kept_products(facts.filter("parse_error IS NULL")).drop("dims"), whitelist)),
        "variants": variant_rows(label(found, whitelist)),
        "quarantine": unread.unionByName(aside),
    }


@pytest.mark.parametrize("backwards", [False, True])
def test_catalog_for_any_order_of_snapshots(spark, tmp_path, backwards):
    pages, variants = (Folder(spark, tmp_path / n, s) for n, s in (("p", schemas.PAGES), ("v", schemas.VARIANT_PAGES)))
    out, mark, wl = str(tmp_path / "out"), str(tmp_path / "mark"), from_setting(spark, "Nike")
    first, second = itertools.batched(SNAPSHOTS, 6)
    chunks = [(pages, first), (variants, VARIANTS), (pages, second)]
    for folder, rows in reversed(chunks) if backwards else chunks:
        folder.add(*rows)
        start_catalog(pages.stream(), variants.stream(), AMAZON, wl, out, mark, compact_after=2).awaitTermination()
    want = batch_catalog(pages.table(), variants.table(), wl)
    for name, rows in want.items():
        assert bag(read_catalog(spark, out, name)) == bag(rows), name
    assert {r.title for r in want["variants"].collect()} >= {"Blue, lower URL", "Late", "Six A, readable", "Three"}


def test_pages_are_merged_with_a_table_of_records(spark, tmp_path):
    """No Python call per page: what counts rests in a table, to which a batch adds the records that count from then on."""
    pages, variants = (Folder(spark, tmp_path / n, s) for n, s in (("p", schemas.PAGES), ("v", schemas.VARIANT_PAGES)))
    out, mark, wl = str(tmp_path / "out"), str(tmp_path / "mark"), from_setting(spark, "Nike")
    kept, versions = [], []
    for more in (SNAPSHOTS[2:3], SNAPSHOTS[:2], ()):
        pages.add(*more)
        variants.add(*([] if more else [*VARIANTS[1:2], (url(1), code(99), url(99), product("Not an option"))]))
        query = start_catalog(pages.stream(), variants.stream(), AMAZON, wl, out, mark)
        query.awaitTermination()
        assert query.lastProgress["stateOperators"] == []
        records = RunLog(spark, f"{out}/state").read("records").collect()
        kept.append(sorted((r.asin or "", r.page_id or 0, r.url or "") for r in records))
        versions.append(len(RunLog(spark, out).read("changed").collect()))
    assert kept[0] == kept[1] == [("", 4, "")]  # neither a later nor an unreadable snapshot counts
    assert kept[2] == [("", 4, ""), (code(12), 0, url(10)), (code(99), 0, url(99))] and versions == [1, 1, 2]
    want = batch_catalog(pages.table(), variants.table(), wl)
    assert all(bag(read_catalog(spark, out, name)) == bag(rows) for name, rows in want.items())


def test_one_run_holds_all_tables_of_a_batch(spark, tmp_path):
    pages, variants = (Folder(spark, tmp_path / n, s) for n, s in (("p", schemas.PAGES), ("v", schemas.VARIANT_PAGES)))
    out, mark, wl = str(tmp_path / "out"), str(tmp_path / "mark"), from_setting(spark, "Nike")
    pages.add(*SNAPSHOTS)
    start_catalog(pages.stream(), variants.stream(), AMAZON, wl, out, mark).awaitTermination()
    (commit,) = RunLog(spark, out).commits()
    assert set(commit.paths) == {"changed", "products", "variants", "quarantine"}
    assert {r.stage for r in read_catalog(spark, out, "quarantine").collect()} == {"product"}


def test_dual_sink_sets_unreadable_pages_aside(spark, tmp_path):
    pages = Folder(spark, tmp_path / "p", schemas.PAGES)
    pages.add((1, url(1), product("One")), (2, url(2), None), (3, url(3), ""))
    none = spark.createDataFrame([], schemas.VARIANT_PAGES)
    start_dual_sink(pages.stream(), none, AMAZON, from_setting(spark, "x"), str(tmp_path / "o"), str(tmp_path / "m")).awaitTermination()
    aside = spark.read.parquet(str(tmp_path / "o/quarantine"))
    assert sorted((r.page_id, r.url, r.stage, r.error) for r in aside.collect()) == [(2, url(2), "product", "no html"), (3, url(3), "product", "no html")]


def test_totals_open_few_folders_after_many_batches(spark, tmp_path):
    pages = Folder(spark, tmp_path / "p", schemas.PAGES)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for n in range(7):
        pages.add((n, url(n), product(f"T{n}", [code(1)])), (n + 100, f"https://host{n % 2}.example/x", product("X")))
    start_totals(pages.stream(1), AMAZON, out, mark, compact_after=3).awaitTermination()
    assert len(RunLog(spark, out + "/totals").folders("totals")) <= 3
    totals = {r.domain: (r.total_products, r.total_variants) for r in read_totals(spark, out).collect()}
    assert totals == {"www.amazon.in": (7, 7), "host0.example": (4, 0), "host1.example": (3, 0)}


def test_pages_that_share_a_page_id_keep_their_own_state(spark):
    """Two URLs with one page_id, and two without any."""
    for ids in ((7, 7), (None, None)):
        rows = [(ids[0], url(1), product("One", [code(11)])), (ids[1], url(2), product("Two", [code(21), code(22)]))]
        mains = product_facts(spark.createDataFrame(rows, schemas.PAGES), AMAZON).withColumn("main_product_url", F.col("product_url"))
        extra = spark.createDataFrame([(url(1), code(11), url(11), product("One A"))], schemas.VARIANT_PAGES)
        found, _ = split_variants(variant_states(flatten_options(mains), extract_products(extra, AMAZON)))
        assert sorted((r.variant_asin, r.title, r.is_carried) for r in found.collect()) == [
            (code(11), "One A", False), (code(21), "Two", True), (code(22), "Two", True),
        ]
