"""Joins that never broadcast; one row per key, chosen by an order; row numbers over a whole table; a filter for rows
whose key may be wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def join_shuffled(left: DataFrame, right: DataFrame, on: list[str] | str | Column, how: str = "inner") -> DataFrame:
    """Equi-join of two tables that grow with the input, always by shuffle and sort.

    Spark estimates rows that were parsed out of pages, or exploded, by the size of the narrow file they
    began with. Left to that estimate it broadcasts tables of any size, through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def first_rows(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key. Every task cuts its rows to one per key before the shuffle,
    so a key with very many rows stays cheap."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Each row's number from 1 in the order of the whole table, in a last column.

    The table is sorted by ranges, so every task holds a stretch of it, and numbered within its
    stretch; what lies before a stretch is the sum of the counts of those before it, one row per
    task. The sorted rows are staged, as a second sort could draw other ranges. Rows are sent once.
    """
    at = F.monotonically_increasing_id()  # of a sorted table: the task in the upper bits, the row below
    rows = stage((df.orderBy(*order) if order else df).withColumn("_at", at), "positions")
    task, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_task", F.coalesce(before, F.lit(0)).alias("_start"))
    numbered = rows.withColumns({"_task": task, "_place": place}).join(F.broadcast(starts), "_task")
    return numbered.select(*df.columns, (F.col("_start") + F.col("_place") + 1).alias(name))


#: Words of 64 bits of a key filter, whatever the number of keys: 8 MB.
FILTER_WORDS = 1 << 20
#: Words of one row of the filter. A row per word would cost the driver several times its bits.
ROW_WORDS = 128


def _place(key: Column) -> tuple[Column, Column]:
    """Word of a key, and its four bits there."""
    h = F.xxhash64(key)
    bit = lambda low: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, low).bitwiseAND(F.lit(63)).cast("int"))
    bits = bit(24).bitwiseOR(bit(31)).bitwiseOR(bit(38)).bitwiseOR(bit(45))
    return h.bitwiseAND(F.lit(FILTER_WORDS - 1)), bits


def _in_row(word: Column) -> tuple[Column, Column]:
    """Row of a word, and its place there."""
    return F.shiftright(word, ROW_WORDS.bit_length() - 1), (word % ROW_WORDS).cast("int")


def key_filter(keys: DataFrame, name: str) -> DataFrame:
    """``_row, _words`` of a Bloom filter over the values of a column, NULL left out; rows without a key are missing."""
    word, bits = _place(F.col(name))
    known = keys.filter(F.col(name).isNotNull()).select(word.alias("_word"), bits.alias("_bits"))
    known = known.groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    row, place = _in_row(F.col("_word"))
    found = known.groupBy(row.alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct(place, "_bits"))).alias("_found"))
    each = F.sequence(F.lit(0), F.lit(ROW_WORDS - 1))
    return found.select("_row", F.transform(each, lambda i: F.coalesce(F.element_at("_found", i), F.lit(0))).alias("_words"))


def likely_among(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among the values of ``keys``; no such row is lost.

    A Bloom filter in blocks of one word: wide rows are tested where they lie, before anything costly
    is done with them, and are not shuffled. Some others pass (about one in a thousand at four
    million keys, more beyond), so an exact join must follow. NULL keys do not pass.
    """
    return df.join(F.broadcast(key_filter(keys, name)), _hit(key), "left_semi")


def mark_likely(df: DataFrame, key: Column, keys: DataFrame, name: str, mark: str) -> DataFrame:
    """All rows of ``df``, and in ``mark`` whether ``likely_among`` would let them pass."""
    found = df.join(F.broadcast(key_filter(keys, name)), _hit(key), "left")  # a word stands in one row of the filter
    return found.withColumn(mark, F.col("_row").isNotNull()).drop("_row", "_words")


def _hit(key: Column) -> Column:
    word, bits = _place(key)
    row, place = _in_row(word)
    return (row == F.col("_row")) & (F.get(F.col("_words"), place).bitwiseAND(bits) == bits) & key.isNotNull()
