from pyspark.sql import functions as F

from shelfmark.llm import fixity as X


def pages_of(spark, n=300):
    rows = [(i, f"http://h/{i}", f"<p>{'x' * (i % 97 * 40)}{i}</p>", "digest") for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_records_follow_each_other(spark, monkeypatch):
    monkeypatch.setattr(X, "RECORDS_PER_FILE", 100)
    rows = sorted(X.layout(pages_of(spark)).collect(), key=lambda r: (r.file, r.offset))
    assert {r.file for r in rows} == {0, 1, 2}
    for a, b in zip(rows, rows[1:], strict=False):
        assert b.offset == (a.offset + a.length if a.file == b.file else 0)


def test_damage_of_every_kind_is_located(spark, monkeypatch):
    monkeypatch.setattr(X, "LEAF_BYTES", 1 << 10)
    monkeypatch.setattr(X, "FANOUT", 3)
    primary = X.layout(pages_of(spark)).cache()
    changed = F.when(F.col("page_id").isin(3, 299), F.sha2("digest", 256)).otherwise(F.col("digest"))
    replica = primary.where("page_id not in (10, 11, 120)").withColumn("digest", changed)
    stray = primary.where("page_id = 50").withColumn("offset", F.col("offset") + 1)
    moved = primary.where("page_id = 0").withColumn("file", F.lit(77).cast("long"))
    got = X.audit(primary, replica.union(stray).union(moved)).collect()
    assert sorted((r.page_id, r.status) for r in got) == [(0, "extra"), (3, "changed"), (10, "missing"), (11, "missing"), (50, "extra"), (120, "missing"), (299, "changed")]
    assert X.audit(primary, primary).count() == 0


def test_only_mismatching_branches_are_opened(spark):
    primary = X.layout(pages_of(spark))
    levels = X.leaves(primary.withColumn("side", F.lit("primary")))
    assert X.parents(levels).count() <= levels.count()


def test_odd_rows(spark):
    rows = [(1, None, None, 0), (1, None, None, 0), (None, "u", "h", 0), (None, "v", "h", 0), (7, "http://h/", "x" * 500_000, 0), (8, "u", "", 0), (8, "u", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file long")
    got = X.audit_trial_replica(pages).collect()
    assert sorted((r.page_id, r.status) for r in got) == [(7, "changed"), (8, "missing")]
    assert X.audit_trial_replica(pages.limit(0)).count() == 0
