"""The trusted-seller list: one comma-separated setting or a one-column table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip


def parse_entries(setting: Column) -> Column:
    """Split at commas, strip, drop blanks; an absent setting is the empty list."""
    parts = F.filter(F.transform(F.split(setting, ","), strip), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def whitelist_table(settings: DataFrame, column: str = "setting") -> DataFrame:
    """One row per entry of every setting row."""
    return settings.select(F.explode(parse_entries(F.col(column))).alias("entry"))


def from_setting(spark: SparkSession, setting: str) -> DataFrame:
    return whitelist_table(spark.createDataFrame([(setting,)], "setting string"))


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("entry string").parquet(path)


def size_of(setting: Column) -> Column:
    return F.size(parse_entries(setting))
