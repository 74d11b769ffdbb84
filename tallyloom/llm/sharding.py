"""Sharding by histogram sort.

Rows are ordered by a key of two 64-bit digits, and shard borders are keys.  Each round
counts, over all partitions, the exact bytes between candidate borders (probes) in one
narrow aggregation, and then puts new probes only around the borders that are further from
their goal than the tolerance.  When every border is near enough, the rows are exchanged
once, by key range.

The first digit is the hash of the text, so equal texts are neighbours, and probes lie
between texts.  Only in a group of equal texts whose ends are both further from a border's
goal than GROUP of a share do probes fall on the second digit, the hash of the row's id; so
equal texts lie in one shard unless they are many.  Only probes and their counts come to the driver, a number that the
parameters set.

Defined results: null and empty texts weigh one byte and are rows like any other; a null id
is a value of its own; rows that agree in text and id stay side by side; an empty table
gives an empty table; other columns travel along, whatever their names (those that begin
with ``_hs_`` are refused).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_count, discard, materialised, table

SHARDS = 16
#: A shard's border may be off by this part of a shard's share; a border inside a shard by INNER.
TOLERANCE, INNER = 0.001, 0.05
#: A border doesn't part equal texts if the end of their group is off by no more than this part of a share.
GROUP = 0.01
#: Probes in the first round (at least), and for each unsettled border in later ones.
FIRST, LATER = 4096, 64
#: Ranges in a shard, so that no shard is sorted by one task: RANGES, or more of about RANGE_BYTES, up to MOST_RANGES.
RANGES, RANGE_BYTES, MOST_RANGES = 16, 512 << 20, 1024
#: More rounds than 128 bits of key take.
ROUNDS = 64

_HALF, _DIGIT = 1 << 63, 1 << 64


@dataclass(frozen=True)
class Splitters:
    """Ascending border keys, and how many rows lie in each range between them."""

    borders: list[int]
    rows: list[int]
    rounds: int


def _keyed(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    clash = [c for c in df.columns if c.startswith("_hs_")]
    if clash:
        raise ValueError(f"columns of these names can't be sharded: {clash}")
    text = F.col(text_column)
    return df.select(
        "*",
        F.xxhash64(F.lit(0), text).alias("_hs_text"),
        F.xxhash64(F.lit(1), F.col(id_column)).alias("_hs_id"),
        (byte_count(text) + 1).alias("_hs_size"),
    )


def _position(borders: list[int]) -> Column:
    """How many borders are at or below a row's key."""
    texts = np.array([(k >> 64) - _HALF for k in borders], dtype=np.int64)
    ids = np.array([k % _DIGIT - _HALF for k in borders], dtype=np.int64)

    @F.pandas_udf("int")
    def position(text: pd.Series, own: pd.Series) -> pd.Series:
        key, second = text.to_numpy(), own.to_numpy()
        low = np.searchsorted(texts, key, "left")
        high = np.searchsorted(texts, key, "right")
        for at in np.unique(low[high > low]):
            rows = (low == at) & (high > low)
            end = high[rows][0]
            high[rows] = at + np.searchsorted(ids[at:end], second[rows], "right")
        return pd.Series(high.astype(np.int32))

    return position("_hs_text", "_hs_id")


def splitters(keys: DataFrame, shards: int, tolerance: float) -> Splitters:
    """Borders between ``shards`` equal parts of the bytes, with further borders inside them."""
    total = keys.agg(F.sum("_hs_size")).first()[0] or 0
    inside = min(max(RANGES, -(-total // (shards * RANGE_BYTES))), MOST_RANGES)
    parts = shards * inside
    share = total / shards
    goals = [(total * i / parts, share * (tolerance if i % inside == 0 else INNER)) for i in range(1, parts)]
    chosen: dict[int, int] = {}
    first = max(FIRST, 4 * parts)
    probes = [(_DIGIT * i // first) << 64 for i in range(1, first)]
    parted: set[int] = set()
    rounds = 0
    while total and len(chosen) < len(goals) and rounds < ROUNDS:
        rounds += 1
        counted = keys.groupBy(_position(probes).alias("at")).agg(
            F.sum("_hs_size").alias("bytes"),
            F.min(F.struct("_hs_text", "_hs_id")).alias("low"),
            F.max(F.struct("_hs_text", "_hs_id")).alias("high"),
        )
        found = {r["at"]: r for r in counted.collect()}
        below, spans = 0, []
        for at in range(len(probes) + 1):
            if row := found.get(at):
                low, high = (((x[0] + _HALF) << 64) + x[1] + _HALF for x in (row["low"], row["high"]))
                spans.append((below, below + row["bytes"], low, high))
                below += row["bytes"]
        ends = np.array([s[1] for s in spans])
        wanted: set[int] = set()
        for i, (goal, slack) in enumerate(goals):
            if i in chosen:
                continue
            start, end, low, high = spans[int(np.searchsorted(ends, goal, "left"))]
            near, border = min((goal - start, low), (end - goal, high + 1))
            first_text, last_text = low >> 64, high >> 64
            if near <= slack or low == high:
                chosen[i] = border
            elif first_text != last_text:
                wanted.update((first_text + (last_text - first_text) * j // LATER) << 64 for j in range(1, LATER + 1))
                wanted.update((first_text << 64, (first_text + 1) << 64, (last_text + 1) << 64))
            elif near <= GROUP * share and i not in parted:
                # all rows of one text, as no probe has parted them
                chosen[i] = border
            else:
                parted.add(i)
                wanted.update(low + (high - low) * j // LATER for j in range(1, LATER + 1))
                wanted.update((low, high + 1))
        probes = sorted(wanted)
    if total and len(chosen) < len(goals):
        raise RuntimeError(f"borders are not settled after {ROUNDS} rounds")
    borders = [chosen.get(i, 0) for i in range(len(goals))]
    borders = np.maximum.accumulate(np.array(borders, dtype=object)).tolist() if borders else []
    counts = {r["at"]: r["n"] for r in keys.groupBy(_position(borders).alias("at")).agg(F.count("*").alias("n")).collect()} if total else {}
    return Splitters(borders, [counts.get(i, 0) for i in range(parts)], rounds)


def histogram_sort(df: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``df`` with ``size``, ``shard`` and ``slot``: the place within the shard, in key order."""
    keyed = _keyed(df, id_column, text_column)
    keys = materialised(keyed.select("_hs_text", "_hs_id", "_hs_size"))
    found = splitters(keys, shards, tolerance)
    inside = len(found.rows) // shards
    starts = [sum(found.rows[i - i % inside : i]) for i in range(len(found.rows))]
    discard(keys)
    spark: SparkSession = df.sparkSession
    placed = keyed.withColumn("_hs_range", _position(found.borders) if found.borders else F.lit(0))
    # a row for each range, a number that RANGES or the bytes set
    offsets = spark.createDataFrame([(i, i // inside, s) for i, s in enumerate(starts)], "_hs_range int, _hs_shard int, _hs_start long")
    order = Window.partitionBy("_hs_range").orderBy("_hs_text", "_hs_id")
    numbered = placed.withColumn("_hs_place", F.row_number().over(order)).join(F.broadcast(offsets), "_hs_range")
    kept = [c for c in df.columns if c not in ("size", "shard", "slot")]
    return numbered.select(
        *kept,
        F.col("_hs_size").alias("size"),
        F.col("_hs_shard").alias("shard"),
        (F.col("_hs_start") + F.col("_hs_place") - 1).cast("long").alias("slot"),
    )


def op7_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    sharded = histogram_sort(table(spark, sf_dir, "documents"))
    return sharded.select(
        "doc_id",
        "size",
        F.crc32("text").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
