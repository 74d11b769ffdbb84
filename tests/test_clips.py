"""Clips of frames: first priors by median and acceptance in order, against loops over all pairs."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import duplicates

SCHEMA = "delivery string, id long, ord long, hashes array<long>, known boolean"


def signed(h):
    return None if h is None else h - (1 << 64) if h >= 1 << 63 else h


def compared(a, b):
    n = min(len(a), len(b))
    far = [bin((x ^ y) & ((1 << 64) - 1)).count("1") for x, y in zip(a, b, strict=False) if x is not None and y is not None]
    return (n, statistics.median(far), min(far), max(far)) if n and len(far) == n else None


def near(a, b, distance):
    found = compared(a, b)
    return found is not None and found[1] <= distance


def made(seed, n=90, deliveries=3):
    """Clips that are versions of a few, with frames that many of them share, some without a hash, and copies."""
    rng = random.Random(seed)
    base = [[rng.getrandbits(64) for _ in range(6)] for _ in range(8)]
    black, rows = rng.getrandbits(64), []
    for i in range(n):
        frames = [h ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 6, 9]))) for h in rng.choice(base)][: rng.choice([1, 2, 3, 4, 5, 6, 6])]
        if rng.random() < 0.5:
            frames[0] = black
        if rng.random() < 0.1:
            frames[rng.randrange(len(frames))] = None
        if rows and rng.random() < 0.2:
            frames = rng.choice(rows)[3]
        if rng.random() < 0.03:
            frames = []
        rows.append((f"d{i % deliveries}", i, rng.randrange(30), [signed(h) for h in frames], rng.random() < 0.1))
    return rows


def test_a_clip_that_is_near_in_most_frames_is_found_behind_one_that_is_near_in_few(spark):
    a, b, c = 1, 1 << 20 | 3, 0xFFFF << 30
    far = [0x0F0F0F0F0F0F0F0F, 0x00FF00FF00FF00FF, 0x3333333333333333]
    sets = [(0, [a, far[0], far[1]]), (1, [far[1], b, far[2]]), (2, [a, b, far[0]]), (3, [a, b, c])]
    df = spark.createDataFrame([(i, i, h) for i, h in sets], "id long, ord long, hashes array<long>")
    assert [(r["id"], r["prior_id"], r["median"]) for r in duplicates.first_priors(df, 4).collect()] == [(3, 2, 0.0)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_priors_equal_a_loop(spark, seed):
    rows = made(seed)
    got = {(r["delivery"], r["id"]): (r["prior_id"], r["n"], r["median"], r["least"], r["most"]) for r in duplicates.first_priors(spark.createDataFrame(rows, SCHEMA), 4, ["delivery"]).collect()}
    want = {}
    for d, i, o, h, _ in rows:
        earlier = sorted((p for p in rows if p[0] == d and (p[2], p[1]) < (o, i) and near(h, p[3], 4)), key=lambda p: (p[2], p[1]))
        if earlier:
            want[d, i] = (earlier[0][1], *compared(h, earlier[0][3]))
    assert got == want and len(want) > 20


def test_only_compared_clips_are_priors(spark):
    rows = made(4, deliveries=1)
    got = {r["id"]: r["prior_id"] for r in duplicates.first_priors(spark.createDataFrame(rows, SCHEMA), 4, compared=F.col("known")).collect()}
    want = {}
    for _, i, o, h, _ in rows:
        earlier = [(p[2], p[1]) for p in rows if p[4] and (p[2], p[1]) < (o, i) and near(h, p[3], 4)]
        if earlier:
            want[i] = min(earlier)[1]
    assert got == want


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_acceptance_equals_a_loop(spark, seed):
    rows = made(seed)
    got = {r["id"]: (r["accepted"], r["prior_id"]) for r in duplicates.accepted_in_order(spark.createDataFrame(rows, SCHEMA), 4, ["delivery"]).collect()}
    want, taken = {}, []
    for d, i, _, h, known in sorted(rows, key=lambda r: (not r[4], r[2], r[1])):
        prior = next((p[1] for p in taken if p[0] == d and near(h, p[3], 4)), None)
        want[i] = (known or prior is None, None if known else prior)
        if want[i][0]:
            taken.append((d, i, None, h))
    assert got == want
    assert {a for a, _ in want.values()} == {True, False}


def test_a_chain_alternates(spark):
    rows = [("d", i, i, [(1 << (3 * i)) - 1 if i < 21 else 0], False) for i in range(21)]
    got = [r["accepted"] for r in duplicates.accepted_in_order(spark.createDataFrame(rows, SCHEMA), 3, ["delivery"]).orderBy("id").collect()]
    assert got == [i % 2 == 0 for i in range(21)]


def test_no_clips(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert duplicates.first_priors(empty, 4, ["delivery"]).collect() == [] and duplicates.accepted_in_order(empty, 4, ["delivery"]).collect() == []
