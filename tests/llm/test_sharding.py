import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.llm.sharding import histogram_sort, op7_histogram_sort

SCHEMA = "doc_id long, text string"


def rows_of(spark, rows, **how):
    return histogram_sort(spark.createDataFrame(rows, SCHEMA), **how).collect()


def check(rows, found, shards, slack):
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter(rows)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in found:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(sizes.values()) / shards
    assert all(abs(sizes[i] - share) <= slack for i in range(shards))


def test_bytes_are_near_equal(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randrange(40)) for i in range(3000)] + [(5000, None), (5001, "")]
    check(rows, rows_of(spark, rows), 16, 100)


def test_equal_texts_are_neighbours(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("abcdefgh") * 50) for i in range(400)] + [(i, f"{i} " * 9) for i in range(1000, 3000)]
    found = rows_of(spark, rows)
    check(rows, found, 16, 2500)
    by_text = defaultdict(list)
    for r in found:
        by_text[r["text"]].append((r["shard"], r["slot"]))
    for places in by_text.values():
        places.sort()
        assert all(b[0] > a[0] or b[1] == a[1] + 1 for a, b in zip(places, places[1:]))


def test_small_groups_of_equal_texts_lie_in_one_shard(spark):
    rng = random.Random(4)
    rows = [(i, f"text {i % 3000} " * (1 + i % 3000 % 5)) for i in range(9000)]
    rng.shuffle(rows)
    found = rows_of(spark, rows)
    total = sum(len(t) + 1 for _, t in rows)
    check(rows, found, 16, 0.011 * total / 16)
    shards = defaultdict(set)
    for r in found:
        shards[r["text"]].add(r["shard"])
    assert {len(s) for s in shards.values()} == {1}


def test_a_very_long_text_counts_whole(spark):
    rows = [(1, "x" * 2_000_000)] + [(i, "y" * 100) for i in range(2, 2000)]
    found = rows_of(spark, rows, shards=2)
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((i, len(t) + 1) for i, t in rows)


def test_a_text_that_is_a_third_of_all_is_split(spark):
    rows = [(i, "same" * 20) for i in range(1000)] + [(i, f"{i:080d}") for i in range(1000, 3000)]
    found = rows_of(spark, rows)
    check(rows, found, 16, 250)
    assert len({r["shard"] for r in found if r["text"] == "same" * 20}) >= 5


def test_repeats_empty_tables_and_clashes(spark):
    assert rows_of(spark, []) == []
    check([(1, "a")] * 5 + [(None, None)], rows_of(spark, [(1, "a")] * 5 + [(None, None)]), 1, 1e9)
    df = spark.createDataFrame([(1, "a", 7)], "doc_id long, text string, slot int")
    assert histogram_sort(df).columns == ["doc_id", "text", "size", "shard", "slot"]
    with pytest.raises(ValueError):
        histogram_sort(df.withColumn("_hs_x", F.lit(1)))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    found = op7_histogram_sort(spark, folder)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert found.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, op7_histogram_sort(spark, folder).collect()))
