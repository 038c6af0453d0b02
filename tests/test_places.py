"""Row numbers over whole tables, clustered session tables, and filters before the parse."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import joins
from shelfmark.operators.joins import likely_among, with_position
from shelfmark.plans.retail import listing_facts, walked_pages
from shelfmark.plans.rules import AMAZON
from shelfmark.session import stage
from shelfmark.sinks.tables import read_session, write_bundle, write_session_table

from tests.conftest import plan_of


def test_positions_over_all_partitions(spark, monkeypatch):
    key, staged = "spark.sql.adaptive.coalescePartitions.enabled", []
    monkeypatch.setattr(joins, "stage", lambda df, name: staged.append(stage(df, name)) or staged[0])
    spark.conf.set(key, "false")
    df = spark.range(5_000).select((F.col("id") * 7919 % 5_000).alias("a"), F.lit("x").alias("b")).repartition(13)
    got = with_position(df, ["a"])
    assert got.columns == ["a", "b", "position"]
    spark.conf.unset(key)
    assert sorted((r.a, r.position) for r in got.collect()) == [(n, n + 1) for n in range(5_000)]
    assert staged[0].select(F.shiftright("_at", 33)).distinct().count() > 4


def test_positions_of_ties_and_of_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (1, "a"), (0, "c")], "k int, v string")
    got = sorted(with_position(df, ["k"]).collect(), key=lambda r: r.position)
    assert [r.k for r in got] == [None, 0, 1, 1] and [r.position for r in got] == [1, 2, 3, 4]
    assert with_position(df.limit(0), ["k"]).count() == 0


def test_bundle_keeps_its_columns_and_adds_positions(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "session_id long, title string")
    paths = write_bundle(rows, rows, str(tmp_path / "b"), positions=True)
    back = spark.read.parquet(paths["Products"])
    assert back.columns == [*schemas.PRODUCT_COLUMNS, "position"]
    assert sorted((r.position, r.title) for r in back.collect()) == [(1, "a"), (2, "b")]


def test_one_session_opens_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "sessions")
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 500 * 60)
    rows = spark.range(200_000).select(
        F.lit("amazon").alias("platform"), F.lit("www.amazon.in").alias("domain"), ts.alias("session_ts"),
        F.sha2(F.col("id").cast("string"), 256).alias("product_url"),
    )
    write_session_table(rows, schemas.PRODUCT_COLUMNS, path, mode="overwrite", clustered=True, row_group_bytes=1 << 18)
    label = "amazon-www.amazon.in-2023-11-14--23-13-20"
    assert read_session(spark, path, label).count() == 400
    groups = []
    for f in glob.glob(f"{path}/*/*/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.to_arrow_schema().names.index("session_label")
        groups += [meta.row_group(n).column(at).statistics for n in range(meta.num_row_groups)]
    own = [g for g in groups if g.min <= label <= g.max]
    assert len(groups) >= 20 and len(own) <= 3
    plan = plan_of(read_session(spark, path, label))
    assert "EqualTo(session_label" in plan and "session_month" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_only_parquet_is_clustered(spark, tmp_path):
    with pytest.raises(ValueError):
        write_session_table(spark.range(0).withColumn("session_ts", F.current_timestamp()).withColumns({"platform": F.lit("a"), "domain": F.lit("b")}), schemas.PRODUCT_COLUMNS, str(tmp_path / "x"), fmt="csv", clustered=True)


def test_filter_loses_no_key_and_few_others_pass(spark, monkeypatch):
    keys = spark.range(0, 3_000, 3).select(F.concat(F.lit("k"), "id").alias("key")).union(spark.sql("select cast(null as string)"))
    rows = spark.range(30_000).select("id", F.concat(F.lit("k"), "id").alias("mine")).union(spark.sql("select -1L, null"))
    got = {r.id for r in likely_among(rows, F.col("mine"), keys, "key").collect()}
    assert got >= set(range(0, 3_000, 3)) and len(got) < 1_100 and -1 not in got
    monkeypatch.setattr(joins, "FILTER_WORDS", 4)  # overfull: everything may pass, nothing is lost
    assert {r.id for r in likely_among(rows, F.col("mine"), keys, "key").collect()} >= set(range(0, 3_000, 3))
    assert likely_among(rows, F.col("mine"), keys.limit(0), "key").count() == 0


def test_pages_are_filtered_below_the_parse(spark):
    sessions = spark.createDataFrame([(1, False, True, 3)], "session_id long, is_single boolean, has_rules boolean, page_limit long")
    pages = spark.createDataFrame([(1, 1, "https://www.amazon.in/s", "<a href=x>"), (2, 1, "https://www.amazon.in/s", "<a>")], schemas.LISTING_PAGES)
    facts = listing_facts(walked_pages(pages, sessions), AMAZON)
    plan = plan_of(facts)
    assert plan.index("ArrowEvalPython") < plan.index("BroadcastHashJoin") and "LeftSemi" in plan
    assert [r.session_id for r in facts.collect()] == [1]


def test_a_key_filter_has_a_row_per_many_words_and_every_bit_of_its_keys(spark):
    keys = spark.range(5_000).selectExpr("if(id % 50 = 0, null, id) AS key")
    rows = {r._row: r._words for r in joins.key_filter(keys, "key").collect()}
    assert len(rows) <= joins.FILTER_WORDS // joins.ROW_WORDS and {len(w) for w in rows.values()} == {joins.ROW_WORDS}
    word, bits = joins._place(F.col("key"))
    placed = {(r.w, r.b) for r in keys.filter("key IS NOT NULL").select(word.alias("w"), bits.alias("b")).collect()}
    assert all(rows[w // joins.ROW_WORDS][w % joins.ROW_WORDS] & b == b for w, b in placed)
    used = {w for w, _ in placed}
    assert all(not bits for r, words in rows.items() for i, bits in enumerate(words) if r * joins.ROW_WORDS + i not in used)
