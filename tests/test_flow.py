import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators.extract import extract_by_platform, kept_products
from shelfmark.operators.whitelist import label
from shelfmark.plans.retail import classify, run
from shelfmark.plans.rules import AMAZON
from shelfmark.session import stage, stage_root
from shelfmark.sinks.tables import (
    product_rows,
    session_label,
    variant_rows,
    write_bundle,
    write_csv,
    write_products,
    write_session_table,
)
from shelfmark.sources.csv import read_products_csv
from shelfmark.sources.pages import stream_pages
from shelfmark.sources.whitelist import from_setting
from shelfmark.streaming.extract import (
    page_records,
    read_totals,
    start_dual_sink,
    start_totals,
)

SITE = "https://www.amazon.in"
TS = datetime.datetime(2024, 1, 2, 3, 4, 5)


def product(title, seller="Nike Store", extra=""):
    return f"<h1>{title}</h1><b class=price>10</b><i class=seller-name>{seller}</i>{extra}"


SWATCH = (
    '<div id="inline-twister-row-color_name"><li data-asin="B000000011"><img alt=Red></li>'
    '<li data-asin="B000000012"><img alt=Blue></li></div>'
)


@pytest.fixture(scope="module")
def result(spark):
    link = '<a href="/p/dp/B00000000{}?r=1">x</a>'
    nxt = "<a aria-label='Next Page'>n</a>"
    sessions = spark.createDataFrame(
        [
            (1, f"{SITE}/s?k=q", TS, ""),
            (2, f"{SITE}/p/dp/B000000001?th=1", TS, ""),
            (3, f"{SITE}/s?k=z", TS, "bad"),
            (4, "https://www.flipkart.com/s", TS, ""),
        ],
        schemas.SESSIONS,
    )
    listing = spark.createDataFrame(
        [
            (1, 1, f"{SITE}/s?k=q", link.format(1) + link.format(2) + link.format(1) + nxt),
            (1, 2, f"{SITE}/s?k=q", link.format(2) + link.format(3)),
            (1, 3, f"{SITE}/s?k=q", link.format(1)),
            (3, 1, f"{SITE}/s?k=z", link.format(1)),
            (4, 1, "https://www.flipkart.com/s", link.format(1)),
        ],
        schemas.LISTING_PAGES,
    )
    pages = spark.createDataFrame(
        [
            (10, f"{SITE}/p/dp/B000000001?x=1", product("One", extra=SWATCH)),
            (11, f"{SITE}/p/dp/B000000001", product("One again")),
            (12, f"{SITE}/p/dp/B000000002", product("Two", "Nobody")),
            (13, "https://www.flipkart.com/p/dp/B000000003", product("Three")),
        ],
        schemas.PAGES,
    )
    variant_pages = spark.createDataFrame(
        [(f"{SITE}/p/dp/B000000001", "B000000012", f"{SITE}/p/dp/B000000012", product("One Blue", "Zed"))],
        schemas.VARIANT_PAGES,
    )
    return run(sessions, listing, pages, variant_pages, from_setting(spark, "Nike, Puma"))


def test_products(result):
    rows = sorted(
        (r.session_id, r.page_no, r.link_ord, r.title, r.product_url, r.is_whitelisted)
        for r in result.products.collect()
    )
    one, two = f"{SITE}/p/dp/B000000001?x=1", f"{SITE}/p/dp/B000000002"
    assert rows == [
        (1, 1, 1, "One", one, "Whitelisted"),
        (1, 1, 2, "Two", two, "False"),
        (1, 2, 1, "Two", two, "False"),
        (2, 1, 1, "One", one, "Whitelisted"),
    ]


def test_variants(result):
    rows = sorted(
        (r.session_id, r.main_product_url, r.variant_option, r.title, r.is_whitelisted)
        for r in result.variants.collect()
    )
    clean = f"{SITE}/p/dp/B000000001"
    assert rows == [
        (1, clean, "Blue", "One Blue", "False"),
        (1, clean, "Red", "One", "Whitelisted"),
        (2, clean + "?th=1", "Blue", "One Blue", "False"),
        (2, clean + "?th=1", "Red", "One", "Whitelisted"),
    ]


def test_totals_and_quarantine(result):
    totals = {r.session_id: (r.total_products, r.total_variants) for r in result.totals.collect()}
    assert totals == {1: (3, 2), 2: (1, 2), 3: (0, 0), 4: (0, 0)}
    bad = sorted((r.stage, r.url, r.error) for r in result.quarantine.collect())
    assert bad == [
        ("product", f"{SITE}/p/dp/B000000003", "no snapshot"),
        ("session", f"{SITE}/s?k=z", "page limit"),
        ("session", "https://www.flipkart.com/s", "no rules"),
    ]


def test_routing(spark):
    df = spark.createDataFrame([(f"{SITE}/dp/x",), (f"{SITE}/s",), ("nonsense",)], "url string")
    got = [(r.platform, r.is_single) for r in classify(df).collect()]
    assert got == [("amazon", True), ("amazon", False), ("generic", False)]


def test_platforms_without_rules_give_no_rows(spark):
    df = spark.createDataFrame(
        [(1, f"{SITE}/dp/x", "<h1>a</h1>", "amazon"), (2, "https://f/", "<h1>b</h1>", "flipkart")],
        "page_id long, url string, html string, platform string",
    )
    assert [r.page_id for r in extract_by_platform(df).collect()] == [1]


# ---------------------------------------------------------------- sinks


def test_csv_bytes(spark, tmp_path):
    rows = spark.createDataFrame([('a "q" b', "", " x ", "y,z", "NA", "two  b", "False")], schemas.PRODUCTS)
    path = str(tmp_path / "csv")
    write_csv(rows.coalesce(1), path)
    (part,) = glob.glob(path + "/part-*")
    with open(part, newline="") as f:
        text = f.read()
    assert text == (
        "product_url,title,price,seller_name,manufacturer_name,image_url,is_whitelisted\r\n"
        '"a ""q"" b",, x ,"y,z",NA,two  b,False\r\n'
    )
    assert read_products_csv(spark, path).collect() == rows.collect()


def test_sink_defaults_and_append(spark, tmp_path):
    df = spark.createDataFrame([("u", None)], "product_url string, title string")
    assert product_rows(df).first() == ("u", "", "", "", "", "", "False")
    assert variant_rows(df).columns == list(schemas.VARIANT_COLUMNS)
    for _ in range(2):
        write_products(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_bundle_and_layout(spark, result, tmp_path):
    paths = write_bundle(result.products, result.variants, str(tmp_path / "b"))
    assert set(paths) == {"Products", "Variants"}
    assert spark.read.parquet(paths["Products"]).columns == list(schemas.PRODUCT_COLUMNS)
    assert spark.read.parquet(paths["Variants"]).count() == 4
    lab = F.lit("amazon"), F.lit("www.amazon.in"), F.lit(TS)
    rows = result.products.withColumns({"platform": lab[0], "domain": lab[1], "session_ts": lab[2]})
    write_session_table(rows, schemas.PRODUCT_COLUMNS, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    want = "amazon-www.amazon.in-2024-01-02--03-04-05"
    assert {r.session_label for r in back.collect()} == {want} and back.count() == 4
    assert os.path.isdir(tmp_path / "s" / "platform=amazon" / "session_month=2024-01")
    assert spark.range(1).select(session_label(*lab).alias("x")).first().x == want


def test_stage_uses_the_session_folder(spark):
    root = stage_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir")
    df = stage(spark.range(5), "x")
    assert df.count() == 5 and all(f"{root}/shelfmark/x-" in f for f in df.inputFiles())


# ---------------------------------------------------------------- streams


def write_parts(spark, folder, n=4):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").drop("page_id")
    extra = spark.createDataFrame(
        [(f"{SITE}/dp/B00000000{k}", product(f"T{k}", extra=SWATCH)) for k in range(3)], pages.schema
    )
    rows = pages.unionByName(extra).withColumn("page_id", F.xxhash64("url", "html"))
    rows.select("page_id", "url", "html").repartition(n).write.parquet(folder)
    return spark.read.parquet(folder)


def test_stream_equals_batch_and_restart_adds_nothing(spark, tmp_path):
    src, out, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    batch = write_parts(spark, src)
    wl = from_setting(spark, "Nike")
    extra = [(f"{SITE}/dp/B000000001", "B000000012", f"{SITE}/dp/B000000012", product("Blue"))]
    extra += [(f"{SITE}/dp/B000000002", "B000000011", f"{SITE}/dp/B000000011", None)]
    extra = spark.createDataFrame(extra, schemas.VARIANT_PAGES)
    for files in (1, 3):  # the second start, with another batch size, finds nothing new
        stream = stream_pages(spark, src, files_per_batch=files)
        start_dual_sink(stream, extra, AMAZON, wl, out, mark).awaitTermination()
        records = label(page_records(batch, AMAZON).drop("dims"), wl)
        want = product_rows(kept_products(records))
        got = spark.read.parquet(out + "/products").drop("batch")
        assert got.count() == want.count() == 53
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        got = spark.read.parquet(out + "/variants").drop("batch")
        assert got.columns == list(schemas.VARIANT_COLUMNS)
        assert sorted(r.title for r in got.collect()) == ["Blue", "T0", "T0", "T1"]
        aside = spark.read.parquet(out + "/quarantine").filter("stage = 'variant'").collect()
        assert sorted(r.url[-10:] for r in aside) == ["B000000011", "B000000012"]
    assert len(glob.glob(out + "/products/batch=*")) == 4


def test_stream_totals(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_parts(spark, src)
    start_totals(stream_pages(spark, src, files_per_batch=1), AMAZON, out, out + "/mark").awaitTermination()
    totals = {r.domain: (r.total_products, r.total_variants) for r in read_totals(spark, out).collect()}
    assert totals["www.amazon.in"] == (3, 6)
    assert sum(p for p, _ in totals.values()) == 53


def test_stream_totals_by_session(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(n % 2, n, f"{SITE}/dp/B00000000{n}", product(f"T{n}", extra=SWATCH)) for n in range(5)]
    df = spark.createDataFrame(rows, "session_id long, page_id long, url string, html string")
    df.repartition(3).write.parquet(src)
    stream = stream_pages(spark, src, df.schema, files_per_batch=1)
    start_totals(stream, AMAZON, out, out + "/mark", by="session_id").awaitTermination()
    totals = {r.session_id: (r.total_products, r.total_variants) for r in read_totals(spark, out, "session_id").collect()}
    assert totals == {0: (3, 6), 1: (2, 4)}


def test_links_under_a_base_are_resolved(pages_of):
    from shelfmark.functions.nodes import with_dom
    from shelfmark.operators.links import page_product_links

    page = f'<base href="{SITE}/Item/dp/"><a href="B000000001">x</a>'
    df = with_dom(pages_of(page, url=f"{SITE}/s?k=q"), AMAZON.wanted_listing())
    assert df.select(page_product_links(AMAZON).alias("l")).first().l == [f"{SITE}/Item/dp/B000000001"]


def test_staging_needs_a_shared_folder_on_a_cluster():
    from shelfmark import session

    class Conf:
        def get(self, key, default=None):
            return "spark://host:7077" if key == "spark.master" else default

    class Cluster:
        conf = Conf()

    with pytest.raises(ValueError):
        session.stage_root(Cluster())


def test_tables_are_read_with_their_schemas(spark, tmp_path):
    from shelfmark.sources import pages, whitelist

    readers = {
        schemas.LISTING_PAGES: pages.read_listing_pages,
        schemas.SESSIONS: pages.read_sessions,
        schemas.VARIANT_PAGES: pages.read_variant_pages,
    }
    for n, (schema, read) in enumerate(readers.items()):
        rows = spark.createDataFrame([], schema)
        rows.write.parquet(str(tmp_path / f"t{n}"))
        assert read(spark, str(tmp_path / f"t{n}")).schema == schema
    from_setting(spark, "a, b").write.parquet(str(tmp_path / "w"))
    assert sorted(r.entry for r in whitelist.read_whitelist(spark, str(tmp_path / "w")).collect()) == ["a", "b"]


def test_platforms_without_variants_can_be_heeded(spark, monkeypatch):
    from shelfmark.plans import retail

    pages = spark.createDataFrame([(1, f"{SITE}/p/dp/B000000001", product("One", extra=SWATCH))], schemas.PAGES)
    sessions = spark.createDataFrame([(2, f"{SITE}/p/dp/B000000001", TS, "")], schemas.SESSIONS)
    empty = [spark.createDataFrame([], s) for s in (schemas.LISTING_PAGES, schemas.VARIANT_PAGES)]
    monkeypatch.setattr(retail, "supports_variants", lambda platform: False)
    out = run(sessions, empty[0], pages, empty[1], from_setting(spark, ""), check_variant_support=True)
    assert (out.products.count(), out.variants.count()) == (1, 0)
    assert run(sessions, empty[0], pages, empty[1], from_setting(spark, "")).variants.count() == 2


def test_one_output_does_not_pay_for_the_others(spark, result, monkeypatch):
    """Quarantine needs no label, products need no variants."""
    from shelfmark.plans import retail

    staged = []
    monkeypatch.setattr(retail, "stage", lambda df, name: staged.append(name) or stage(df, name))
    pages = spark.createDataFrame([(1, f"{SITE}/p/dp/B000000001", product("One"))], schemas.PAGES)
    sessions = spark.createDataFrame([(2, f"{SITE}/p/dp/B000000001", TS, "")], schemas.SESSIONS)
    empty = [spark.createDataFrame([], s) for s in (schemas.LISTING_PAGES, schemas.VARIANT_PAGES)]
    out = run(sessions, empty[0], pages, empty[1], from_setting(spark, ""))
    assert staged == []
    assert out.products.count() == 1
    assert "variants" not in staged


def test_quarantine_reads_each_listing_page_once(spark, result, monkeypatch):
    import shelfmark.plans.retail as retail

    read, own = [], retail.with_dom

    def counted(df, *a, **k):
        read.append("page_no" in df.columns)
        return own(df, *a, **k)

    monkeypatch.setattr(retail, "with_dom", counted)
    fresh = retail.Result(result._given, result._listing_pages, result._pages, result._variant_pages, result._whitelist, AMAZON, "carry_forward", True)
    every = sorted(map(str, fresh.quarantine.collect()))
    assert sum(read) == 1
    asked = sorted(map(str, fresh.products.collect()))
    assert sum(read) == 1 and asked == sorted(map(str, result.products.collect())) and every == sorted(map(str, result.quarantine.collect()))
