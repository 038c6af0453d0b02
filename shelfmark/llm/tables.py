"""Reading the given tables, staging intermediate ones, and joining wide rows with narrow ones."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import words

#: Narrow tables of at most this many rows (a long and a few more columns) may be broadcast.
BROADCAST_ROWS = 1_000_000


#: Rows of one Arrow message from a worker to its executor.
HANDED_ROWS = 65_536


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local master, as in tests, may go without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="shelfmark-")
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Have the executors delete the shuffle files of plans that are no longer held.

    The driver notices such plans when it collects garbage, which a driver with little to do may put
    off for long while the files fill the executors' disks. Twice, as the first time frees the
    handles by which Python holds the plans.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def with_narrow(wide: DataFrame, narrow: DataFrame, on: str, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join rows that carry texts with a narrow staged table, without moving the texts if that is small.

    The row count is measured; beyond ``rows`` it is an ordinary shuffle join, with the same result.
    """
    if narrow.count() <= rows:
        narrow = F.broadcast(narrow)
    return wide.join(narrow, on, how)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *drop: Callable[[], None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for ``mapInArrow``; at its end the worker, which goes on to other tasks, calls ``drop``, which
    clear what it has cached, and returns what it has freed. Large results are handed on in pieces."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in run(batches):
            for low in range(0, max(len(rows), 1), HANDED_ROWS):
                yield rows.slice(low, HANDED_ROWS)
            del rows
        for clear in (words.drop_tables, *drop):
            clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if trim:
            trim(0)

    return whole
