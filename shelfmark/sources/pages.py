"""Snapshot tables, batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas


def read_pages(spark: SparkSession, path: str, schema=schemas.PAGES) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stream_pages(
    spark: SparkSession, path: str, schema=schemas.PAGES, files_per_batch: int | None = None, **options
) -> DataFrame:
    """File stream over a growing snapshot folder, or over one file.

    Without ``files_per_batch`` a batch takes all new files; set it to bound a batch.
    """
    reader = spark.readStream.schema(schema)
    listed = spark.read.format("binaryFile").load(path).select("path").limit(1).first()
    if listed and listed.path.rstrip("/").endswith("/" + path.rstrip("/").rsplit("/", 1)[-1]):
        # one file: a stream reads folders, so pick the file in its folder
        folder, name = path.rstrip("/").rsplit("/", 1)
        reader, path = reader.option("pathGlobFilter", name), folder
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.options(**options).parquet(path)


def read_listing_pages(spark: SparkSession, path: str) -> DataFrame:
    return read_pages(spark, path, schemas.LISTING_PAGES)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return read_pages(spark, path, schemas.SESSIONS)


def read_variant_pages(spark: SparkSession, path: str) -> DataFrame:
    return read_pages(spark, path, schemas.VARIANT_PAGES)
