import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfmark import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (
        session.builder("shelfmark-tests")
        .master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate an expression builder over rows of strings; one result per row."""

    def run(rows, build, names=("a",)):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        data = [(n, *r) for n, r in enumerate(rows)]
        schema = "n int, " + ", ".join(f"{c} string" for c in names)
        from pyspark.sql import functions as F

        df = spark.createDataFrame(data, schema)
        out = df.select("n", build(*[F.col(c) for c in names]).alias("out")).collect()
        return [r.out for r in sorted(out, key=lambda r: r.n)]

    return run


@pytest.fixture(scope="session")
def pages_of(spark):
    """Snapshot table from HTML texts, numbered from 0."""

    def make(*htmls, url="https://www.amazon.in/dp/B000000001"):
        rows = [(n, url, h) for n, h in enumerate(htmls)]
        return spark.createDataFrame(rows, "page_id long, url string, html string")

    return make


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
