"""Rows that could not be processed, kept apart so that the others go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rejected(
    df: DataFrame,
    stage: str,
    error: Column,
    page_id: Column | None = None,
    url: str = "url",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(page_id, url, stage, error)`` for rows whose ``error`` is not NULL, after columns to ``keep``."""
    ident = F.lit(None).cast("bigint") if page_id is None else page_id.cast("bigint")
    return df.select(
        *keep,
        ident.alias("page_id"),
        F.col(url).alias("url"),
        F.lit(stage).alias("stage"),
        error.alias("error"),
    ).filter(F.col("error").isNotNull())


def split(df: DataFrame, stage: str, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantine rows of a table with ``page_id`` and ``parse_error``."""
    error = F.col("parse_error")
    return df.filter(error.isNull()), rejected(df, stage, error, F.col("page_id"), url)
