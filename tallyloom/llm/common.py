"""What the operators of this package share: shared storage, tables and runs of sorted rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: whatever lies between white space of ASCII.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch while something is materialised.
BATCH_ROWS = 1024
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Rows that are decoded together while Parquet is read narrowly.
READ_ROWS = 256
_READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; set here only where the session names none, and all run in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-"))
    return context._jsc.sc().getCheckpointDir().get()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_ROWS rows at most for what runs meanwhile: texts are wide."""
    before = spark.conf.get(_ARROW_ROWS)
    rows = int(before)
    spark.conf.set(_ARROW_ROWS, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, before)


@contextmanager
def narrow_reads(spark: SparkSession) -> Iterator[None]:
    """Parquet is decoded READ_ROWS rows at a time for what runs meanwhile: 4,096 texts make arrays of many MB, which a JVM's heap grows for."""
    before = spark.conf.get(_READ_ROWS)
    spark.conf.set(_READ_ROWS, str(min(int(before), READ_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(_READ_ROWS, before)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Files of shuffles go with the query that wrote them, for queries meanwhile, and don't wait for the driver's garbage collection."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again; it goes with the session."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyloom-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what ``materialised`` wrote, once nothing needs it any more."""
    found = {p.rsplit("/", 1)[0] for p in df.inputFiles()}
    for entry in [e for e in _written if any(f.rstrip("/").endswith(e[1].rsplit("/", 1)[1]) for f in found)]:
        _remove(*entry)
        _written.remove(entry)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # the JVM has ended; its shared folder goes with it
            return


def word_count(text: Column) -> Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_count(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def set_apart(df: DataFrame, needed: list[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` with columns that an operator doesn't read under names that nothing clashes with, and how to give them back theirs."""
    names = {c: c if c in needed else f"_apart_{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Groups of equal ``key`` (a long) from batches that are sorted by it, one table each."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        keys = rows[key].combine_chunks()
        edges = pc.indices_nonzero(pc.not_equal(keys[1:], keys[:-1])).to_pylist() if len(keys) > 1 else []
        bounds = [0, *(e + 1 for e in edges), len(keys)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            part = rows.slice(a, b - a)
            if held and held[-1][key][0] != part[key][0]:
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)
