"""Session settings and the staging area for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every flow relies on. Shuffle partition count is left to the cluster
#: (AQE coalesces); small Arrow batches keep large HTML rows within worker memory.
CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


def builder(app: str = "shelfmark") -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    for k, v in CONF.items():
        b = b.config(k, v)
    return b


def stage_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir`` of the session.

    Only a local master (tests, benchmarks) may go without: a local folder is then made
    and set, once per session. On a cluster executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="shelfmark-stage-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{stage_root(spark).rstrip('/')}/shelfmark/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared staging folder and read it back.

    Several outputs can then use it without parsing pages twice, and a lost
    executor costs no recomputation.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
