"""Re-reading the written CSV tables with their fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..sinks.tables import CSV_FORM


def read_products_csv(spark: SparkSession, path: str) -> DataFrame:
    """Nothing is inferred: texts such as ``NA`` stay texts, blanks come back as ''."""
    return _read(spark, path, schemas.PRODUCTS)


def read_variants_csv(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.VARIANTS)


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    df = (
        spark.read.schema(schema)
        .options(header="true", multiLine="true", nullValue="\x00", **CSV_FORM)
        .csv(path)
    )
    return df.fillna("")
