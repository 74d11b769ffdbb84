"""Sessions, tables, and the sources and sinks of records."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that never leave a device, and so are neither exported nor synced.
LOCAL_ONLY = ("blob", "meta", "outbox", "sync_state", "sync_conflict", "search_token", "asset_facet", "reindex_queue")
FORMAT, VERSION = "footage-snapshot", 2
PAGE = 500


def session(cpus: int | str = "*", partitions: int | None = None, memory: str = "6g") -> SparkSession:
    """A local session with UTC times and adaptive plans, for tests and benches."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def local(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """A small table that the planner knows the size of, so it is broadcast where that pays."""
    return spark.createDataFrame(pa.table(columns))


def after_cursor(df: DataFrame, at: Column | None, row_id: Column | None, time: str, key: str, page: int | None = PAGE) -> DataFrame:
    """Keyset page: rows strictly after (time, key), in that order; all that follow without ``page``."""
    if at is not None and row_id is not None:
        df = df.filter((F.col(time) > at) | ((F.col(time) == at) & (F.col(key) > row_id)))
    ordered = df.orderBy(time, key)
    return ordered if page is None else ordered.limit(page)


def upsert(base: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of ``incoming`` in place of those of the same key."""
    return base.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def exportable(names: list[str]) -> list[str]:
    return [n for n in names if n not in LOCAL_ONLY]


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of each table."""
    each = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, each)


def export_snapshot(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes exportable tables, tombstones included, as JSON lines and a manifest; returns the manifest."""
    chosen = {n: tables[n] for n in exportable(list(tables))}
    for name, df in chosen.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")
    manifest = row_counts(chosen).select(F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), "table", "rows")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/_manifest")
    return manifest


def import_snapshot(spark: SparkSession, folder: str, tables: dict[str, DataFrame], key: str = "id") -> dict[str, DataFrame]:
    """``tables`` with a snapshot's rows put in by key; nothing is cleared.

    A snapshot of another format, or of a later version, is refused.
    """
    manifest = spark.read.json(f"{folder}/_manifest").collect()  # a row for each table
    if not manifest or any(r["format"] != FORMAT for r in manifest):
        raise ValueError("not a snapshot")
    if any(r["version"] > VERSION for r in manifest):
        raise ValueError("the snapshot is of a later version")
    out = dict(tables)
    for r in manifest:
        name = r["table"]
        if name in tables and name not in LOCAL_ONLY:
            rows = spark.read.schema(tables[name].schema).json(f"{folder}/{name}")
            out[name] = upsert(tables[name], rows, key)
    return out


def storage_verdict(sentinel_rows: Column, rows: Column) -> Column:
    """first_run without a sentinel; evicted where it counted rows that are gone; else intact."""
    return F.when(sentinel_rows.isNull(), "first_run").when((sentinel_rows > 0) & (rows == 0), "evicted").otherwise("intact")


def bytes_by_kind(blobs: DataFrame) -> DataFrame:
    """(kind, blobs, bytes) of blobs (key, bytes); a kind is what stands before the key's slash."""
    return blobs.groupBy(F.split_part("key", F.lit("/"), F.lit(1)).alias("kind")).agg(F.count("*").alias("blobs"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
