import pytest

from shelfmark.sinks.runs import ChangeLog, RunLog
from shelfmark.sinks.tables import append_run, read_run_table
from shelfmark.schemas import PRODUCT_COLUMNS


def nums(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n long")


def read(log, name="t"):
    return sorted(r.n for r in log.read(name).collect())


def test_a_run_is_visible_as_a_whole_and_once(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    assert log.commits() == [] and not log.has("a")
    with pytest.raises(ValueError):
        log.read("t")
    log.write({"t": nums(spark, 1, 2), "u": nums(spark, 9)})  # dies before its commit
    assert log.commits() == []
    assert log.append({"t": nums(spark, 1, 2), "u": nums(spark, 9)}, run="a")
    assert not log.append({"t": nums(spark, 1, 2), "u": nums(spark, 9)}, run="a")
    late = log.write({"t": nums(spark, 1, 2)})  # a second attempt that was under way meanwhile
    assert not log.commit(late, run="a")
    assert log.append({"t": nums(spark, 3)}, run="b")
    assert read(log) == [1, 2, 3] and read(log, "u") == [9]


def test_a_run_has_one_name_or_number(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    for wrong in ({}, {"run": "a", "number": 1}):
        with pytest.raises(ValueError):
            log.append({"t": nums(spark, 1)}, **wrong)


def test_compaction_bounds_what_readers_open(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    for n in range(14):
        assert log.append({"t": nums(spark, n)}, number=n)
        log.compact(after=4)
        assert len(log.folders("t")) <= 4 and len(log.commits()) <= 5
    assert read(log) == list(range(14))
    assert not any(log.append({"t": nums(spark, 99)}, number=n) for n in range(14))
    assert log.append({"t": nums(spark, 14)}, run="named") and not log.append({"t": nums(spark, 14)}, run="named")
    assert log.compact() and log.has(run="named") and log.has(number=3)
    assert read(log) == list(range(15))


def test_a_later_set_of_a_key_replaces_the_earlier(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"))
    sets = lambda *rows: spark.createDataFrame(rows, "key string, version long, n long")

    def put(number, changed, rows):
        log.append({log.CHANGED: spark.createDataFrame(changed, "key string, version long"), "t": sets(*rows) if rows else sets(("", 0, 0)).limit(0)}, number=number)

    put(0, [("a", 1), ("b", 1), (None, 1)], [("a", 1, 10), ("a", 1, 11), ("b", 1, 20), (None, 1, 30)])
    put(1, [("a", 2), ("b", 2)], [("a", 2, 12)])
    for _ in range(2):
        assert sorted((r.key or "-", r.n) for r in log.latest("t").collect()) == [("-", 30), ("a", 12)]
        log.compact()
    assert log.folders("t") == log.folders("t")[:1]
    put(2, [(None, 2)], [])
    assert [(r.key, r.n) for r in log.latest("t").collect()] == [("a", 12)]


def test_sink_rows_can_be_appended_again_without_doubling(spark, tmp_path):
    path = str(tmp_path / "sink")
    rows = spark.createDataFrame([("u", "t")], "product_url string, title string")
    for _ in range(2):
        append_run(spark, path, "2024-01-01", products=rows)
    append_run(spark, path, "2024-01-02", products=rows, variants=spark.createDataFrame([("v",)], "variant_product_url string"))
    found = read_run_table(spark, path, "products")
    assert found.columns == list(PRODUCT_COLUMNS)
    assert [tuple(r) for r in found.collect()] == [("u", "t", "", "", "", "", "False")] * 2
    assert read_run_table(spark, path, "variants").count() == 1
