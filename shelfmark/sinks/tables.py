"""Product and variant sinks, session folders and the two-table bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.joins import with_position
from .runs import RunLog

#: CSV in the usual spreadsheet form: quotes doubled, empty strings as nothing,
#: blanks kept, lines ended by CR LF. A line break inside a value is written as CR LF
#: too and read back as LF; extracted texts are collapsed and hold none.
CSV_FORM = {
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def sink_projection(df: DataFrame, columns) -> DataFrame:
    """Fixed columns in fixed order; missing ones blank, a missing label ``False``."""
    out = []
    for c in columns:
        default = F.lit("False" if c == "is_whitelisted" else "")
        have = c in df.columns
        out.append((F.coalesce(F.col(c), default) if have else default).alias(c))
    return df.select(*out)


def product_rows(df: DataFrame) -> DataFrame:
    return sink_projection(df, schemas.PRODUCT_COLUMNS)


def variant_rows(df: DataFrame) -> DataFrame:
    return sink_projection(df, schemas.VARIANT_COLUMNS)


def write_csv(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).options(header="true", lineSep="\r\n", **CSV_FORM).csv(path)


def write_products(df: DataFrame, path: str, mode: str = "append", fmt: str = "parquet") -> None:
    _write(product_rows(df), path, mode, fmt)


def write_variants(df: DataFrame, path: str, mode: str = "append", fmt: str = "parquet") -> None:
    _write(variant_rows(df), path, mode, fmt)


def append_run(
    spark: SparkSession,
    path: str,
    run: str,
    products: DataFrame | None = None,
    variants: DataFrame | None = None,
) -> bool:
    """Append a run's product and variant rows as one commit; a run that is there already adds nothing.

    Unlike a plain append this can be repeated after any failure: what a broken attempt
    left is never read. ``read_run_table`` follows the commits.
    """
    tables = {} if products is None else {"products": product_rows(products)}
    tables |= {} if variants is None else {"variants": variant_rows(variants)}
    return RunLog(spark, path).append(tables, run=run)


def read_run_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """All committed ``products`` or ``variants`` rows."""
    return RunLog(spark, path).read(table)


def _write(rows: DataFrame, path: str, mode: str, fmt: str) -> None:
    if fmt == "csv":
        write_csv(rows, path, mode)
    else:
        rows.write.mode(mode).format(fmt).save(path)


def session_label(platform: Column, domain: Column, ts: Column) -> Column:
    """``platform-domain-timestamp``, the name of a session's folder."""
    return F.concat_ws("-", platform, domain, F.date_format(ts, "yyyy-MM-dd--HH-mm-ss"))


#: Folders of the session layout. Their number grows with shops and months, not
#: with sessions; the session itself is the ``session_label`` column.
LAYOUT = ("platform", "session_month")
PRODUCT_ORDER = ("session_id", "page_no", "link_ord")
VARIANT_ORDER = (*PRODUCT_ORDER, "dim_ord", "opt_ord")


def write_session_table(
    df: DataFrame,
    columns,
    path: str,
    fmt: str = "parquet",
    mode: str = "append",
    clustered: bool = False,
    row_group_bytes: int = 32 << 20,
) -> None:
    """Append rows with their session label under ``platform=/session_month=`` folders.

    The rebalance hint gives every folder few files and splits a folder that would
    overload one task. ``clustered`` (Parquet) orders a folder's rows by session instead, so that each
    file and row group covers a range of labels, and adds Bloom filters on the label:
    ``read_session`` then opens few row groups of a month. Rows of one large session are spread
    over tasks by their first column.
    """
    out = df.select(
        "platform",
        F.date_format("session_ts", "yyyy-MM").alias("session_month"),
        session_label(F.col("platform"), F.col("domain"), F.col("session_ts")).alias(
            "session_label"
        ),
        *[c for c in columns if c in df.columns],
    )
    out = sink_projection(out, (*LAYOUT, "session_label", *columns))
    if clustered:
        if fmt != "parquet":
            raise ValueError("only Parquet files are clustered")
        order = [*LAYOUT, "session_label", *columns[:1]]
        # a platform known when the query is planned would be folded and leave the sort, and the
        # writer, which needs rows in the order of their folders, would sort anew by folder alone
        unfolded = F.when(F.monotonically_increasing_id() >= 0, F.col("platform"))
        out = out.withColumn("platform", F.coalesce(unfolded, F.lit("")))
        writer = out.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy(*LAYOUT)
        own = {"parquet.bloom.filter.enabled#session_label": "true", "parquet.block.size": str(row_group_bytes)}
        writer.options(**own).parquet(path)
        return
    writer = out.hint("rebalance", *LAYOUT).write.mode(mode).partitionBy(*LAYOUT)
    if fmt == "csv":
        writer.options(header="true", lineSep="\r\n", **CSV_FORM).csv(path)
    else:
        writer.format(fmt).save(path)


def read_session(spark: SparkSession, path: str, label: str) -> DataFrame:
    """The rows of one session of a Parquet session table.

    Platform and month are read off the label, so one folder is listed; inside it files and row
    groups are skipped by their range of labels and their Bloom filters.
    """
    rows = spark.read.parquet(path)
    month = F.col("session_month").cast("string") == label[-20:-13]
    return rows.filter((F.col("platform") == label.split("-")[0]) & month & (F.col("session_label") == label))


def write_bundle(
    products: DataFrame,
    variants: DataFrame,
    path: str,
    fmt: str = "parquet",
    positions: bool = False,
) -> dict[str, str]:
    """Both tables as one deliverable with members ``Products`` and ``Variants``.

    Rows are in output order: session, page, link, then dimension and option. The
    sort is a range partitioning, so it spreads over the cluster. ``positions`` adds each row's
    place in that order as a last column, for readers of several files.
    """
    out = {}
    for name, df, columns, order in (
        ("Products", products, schemas.PRODUCT_COLUMNS, PRODUCT_ORDER),
        ("Variants", variants, schemas.VARIANT_COLUMNS, VARIANT_ORDER),
    ):
        keys = [c for c in order if c in df.columns]
        out[name] = f"{path}/{name}"
        if positions:
            placed = with_position(sink_projection(df, (*keys, *columns)), keys)
            _write(placed.select(*columns, "position"), out[name], "overwrite", fmt)
            continue
        ordered = df.orderBy(*keys) if keys else df
        _write(sink_projection(ordered, columns), out[name], "overwrite", fmt)
    return out
