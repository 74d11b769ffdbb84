"""Faded counters, index upkeep and the ladder of tiers against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import demand, lifecycle
from tallyloom.plans import catalogue

LOG = "token string, asset_id long, clicked boolean, at long"
DAY = 86_400_000


def events(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice("abc"), rng.randrange(5), rng.random() < 0.3, rng.randrange(90 * DAY)) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_of_counters_in_any_order_equal_one_pass(spark, seed):
    rows, half = events(seed), 7.0 * DAY
    rng, last = random.Random(seed), max(e[3] for e in rows)
    want = {}
    for token, asset, clicked, at in rows:
        w = 0.5 ** ((last - at) / half)
        c, s = want.get((token, asset), (0.0, 0.0))
        want[token, asset] = (c + w * clicked, s + w)
    parts = [rows[i::4] for i in range(4)]
    rng.shuffle(parts)
    batches = [demand.counters(spark.createDataFrame(p, LOG), ["token", "asset_id"], half) for p in parts]
    first = demand.merged_counters(batches[:2], ["token", "asset_id"], half)
    got = demand.merged_counters([batches[3], first, batches[2]], ["token", "asset_id"], half).collect()
    assert {(r["token"], r["asset_id"]): (r["clicks"], r["shown"]) for r in got} == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}
    assert {r["at"] for r in got} == {last}


def test_ranking_takes_every_signal(spark):
    counter = lambda rows, keys: spark.createDataFrame(rows, f"{keys}, clicks double, shown double")
    results = spark.createDataFrame([(1, "u", "t", i, "f", 1.0) for i in range(5)] + [(2, "v", "t", 0, "g", 1.0)], "query_id long, user_id string, token string, asset_id long, facet string, score double")
    by_token = counter([("t", 1, 4.0, 7.0), ("t", 2, 0.0, 9.0), ("t", 3, 0.0, 4.0)], "token string, asset_id long")
    ranked = demand.reranked(results, by_token, counter([(4, 6.0, 6.0)], "asset_id long"), counter([("u", "f", 1.0, 1.0), ("u", "h", 3.0, 3.0)], "user_id string, facet string"))
    rows = {(r["query_id"], r["asset_id"]): r for r in ranked.collect()}
    assert rows[1, 0]["ranked"] == pytest.approx(1.25) and rows[2, 0]["ranked"] == pytest.approx(1.0)  # leanings
    assert rows[1, 1]["ranked"] == pytest.approx(1.25 + 2 * 4 / 8)  # clicked for the token
    assert (rows[1, 2]["demoted"], rows[1, 2]["ranked"]) == (True, pytest.approx(0.625)) and not rows[1, 3]["demoted"]
    assert rows[1, 4]["prior"] == pytest.approx(1.9459101)
    assert [i for _, i in sorted((r["place"], r["asset_id"]) for r in rows.values() if r["query_id"] == 1)] == [4, 1, 0, 3, 2]


def test_tags_that_mislead(spark):
    tags = spark.createDataFrame([(i, "dim", "ai", i == 0, "r1") for i in range(4)] + [(i, "wide", "ai", None, "r1") for i in range(4)] + [(9, "dim", "human", True, "r1")], "asset_id long, tag string, source string, rejected boolean, run string")
    by_asset = spark.createDataFrame([(1, 0.0, 3.0), (2, 1.0, 3.0)], "asset_id long, clicks double, shown double")
    assert [tuple(r) for r in demand.low_precision_tags(tags, by_asset, 4, 0.5).collect()] == [("r1", "dim", 4, 2)]


def test_an_index_after_batches_equals_a_rebuild(spark):
    rng = random.Random(3)
    words = "sun sea dog red".split()
    weights = {"text": 2, "kind": 1}
    build = lambda rows: demand.token_index(rows, weights)
    rows = {i: (" ".join(rng.choices(words, k=3)), rng.choice([None, "a", "b"])) for i in range(30)}
    frame = lambda: spark.createDataFrame([(i, *v) for i, v in rows.items()], "id long, text string, kind string")
    before = frame()
    index = build(before)
    for _ in range(3):
        for i in rng.sample(sorted(rows), 6):
            rows.pop(i)
        rows |= {rng.randrange(40): (" ".join(rng.choices(words, k=2)), None) for _ in range(5)}
        after = frame()
        queue = demand.reindex_queue(before, after, list(weights))
        changes = demand.index_changes(index, after, queue, build)
        touched = {r["id"] for r in queue.collect()}
        assert {r["id"] for r in changes.collect()} <= touched
        index = spark.createDataFrame(demand.index_applied(index, changes).collect(), index.schema)
        before = after
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, build(before).collect()))


def test_an_index_holds_a_row_as_often_as_its_assets_do(spark):
    build = lambda rows: demand.asset_facets(rows, ["room"])
    before, after = ([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, None)], [(1, "a"), (1, "b"), (1, "b"), (2, "a"), (3, "c"), (3, "c")])
    index, after = build(spark.createDataFrame(before, "id long, room string")), spark.createDataFrame(after, "id long, room string")
    queue = spark.createDataFrame([(1,), (3,)], "id long")
    applied = demand.index_applied(index, demand.index_changes(index, after, queue, build))
    assert sorted(map(tuple, applied.collect())) == sorted(map(tuple, build(after).collect()))


@pytest.mark.parametrize("name", ["q92_index_upkeep", "q93_facet_upkeep"])
def test_upkeep_is_without_unions(spark, name):
    """Adaptive plans take a union of sides partitioned alike for partitioned, and fail once they change one of them."""
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Union" not in plan


def test_a_queue_names_what_changed_and_what_an_alias_touches(spark):
    schema = "id long, text string"
    before, after = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "")], schema), spark.createDataFrame([(1, "a"), (2, ""), (3, "d"), (5, "e")], schema)
    assert {(r["id"], r["reason"]) for r in demand.reindex_queue(before, after, ["text"]).collect()} == {(2, "changed"), (3, "changed"), (4, "removed"), (5, "added")}
    index = spark.createDataFrame([("dusk", 1, 2), ("dawn", 2, 2), ("sea", 3, 2)], "token string, id long, weight int")
    aliases = spark.createDataFrame([("dusk", "dawn")], "alias string, term string")
    assert {r["id"] for r in demand.alias_queue(index, aliases).collect()} == {1, 2}


def test_a_session_never_goes_up(spark):
    rng = random.Random(4)
    sessions = [(s, rng.choice(lifecycle.TIERS), rng.choice([None, 3, 60, 61]), rng.choice([True, False, None])) for s in range(60)]
    requests = [(s, o, rng.choice([*lifecycle.TIERS, "faster", None]), f"r{o}") for s in range(60) for o in range(rng.randrange(5))]
    want = {}
    for s, tier, files, worker in sessions:
        notes = [] if worker else ["no_worker: extraction runs on the main thread, so concurrency is capped"]
        if tier == "ample" and (files or 0) > 60:
            tier, notes = "standard", [*notes, f"large_batch: {files} files, so concurrency is reduced"]
        for _, _, to, reason in sorted(r for r in requests if r[0] == s):
            if to in lifecycle.TIERS and lifecycle.TIERS.index(to) > lifecycle.TIERS.index(tier):
                notes.append(f"{tier} -> {to}: {reason}")
                tier = to
        want[s] = (tier, notes)
    df, asked = spark.createDataFrame(sessions, "session_id long, tier string, files int, has_worker boolean"), spark.createDataFrame(requests, "session_id long, ord int, to string, reason string")
    got = {r["session_id"]: r for r in lifecycle.ingest_policy(df, asked).collect()}
    assert {s: (r["tier"], r["downgrades"]) for s, r in got.items()} == want
    assert all(r[name] == pytest.approx(value) for r in got.values() for name, value in lifecycle.PROFILES[r["tier"]].items())


def test_frames_and_sheets(spark):
    cases = [(6.0, "ample", 5), (6.0, "constrained", 3), (60.0, "ample", 7), (1.0, "standard", 4), (None, "ample", 5), (-1.0, "standard", 4), (float("nan"), "ample", 5), (9.0, "standard", 6)]
    df = spark.createDataFrame([(i, d, t) for i, (d, t, _) in enumerate(cases)], "i int, d double, t string")
    assert [r["n"] for r in df.select("i", lifecycle.frame_count(F.col("d"), F.col("t")).alias("n")).orderBy("i").collect()] == [c[2] for c in cases]
    assert [r["s"] for r in spark.range(0, 10).select(lifecycle.sheet_layout(F.col("id")).alias("s")).collect()] == ["1x3"] * 4 + ["1x4", "1x5", "1x6"] + ["1x7"] * 3
