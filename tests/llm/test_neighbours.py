import numpy as np

import pytest

from tallyloom.llm import neighbours
from tallyloom.llm.neighbours import grown, nearest, op6_nn_descent

SCHEMA = "vec_id long, embedding array<float>"


def exact(vectors, q, k):
    ids = np.array([i for i in vectors if i != q])
    far = np.sqrt(((np.array([vectors[i] for i in ids], np.float64) - np.array(vectors[q], np.float64)) ** 2).sum(axis=1))
    order = np.lexsort((ids, far))[:k]
    return [(int(ids[i]), float(far[i])) for i in order]


def test_recall_over_a_table(spark):
    folder = "/root/testdata/sf0.01"
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    found = {}
    for r in op6_nn_descent(spark, folder).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in vectors if i % 100 == 0}
    hits = total = 0
    for q, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        assert [(s, i) for _, i, s in rows] == sorted((s, i) for _, i, s in rows)
        for _, i, s in rows:
            assert s == np.sqrt(((np.array(vectors[i], np.float64) - np.array(vectors[q], np.float64)) ** 2).sum())
        hits += len({i for _, i, _ in rows} & {i for i, _ in exact(vectors, q, 10)})
        total += 10
    assert hits >= 0.9 * total


def test_few_candidates_ties_and_vectors_without_a_place(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, None]), (8, [1.0]), (0, [1.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA + ", score int")
    found = nearest(df, df.filter("vec_id % 100 = 0")).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in found] == [(0, 1, 1), (0, 2, 2)]
    assert found[0]["score"] == np.sqrt(2)


def test_copies_are_at_no_distance(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(8))]) for i in range(50)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = nearest(df, df.filter("vec_id = 0")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(100 + i, 0.0) for i in range(10)]


def test_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nearest(empty, empty).count() == 0
    alone = spark.createDataFrame([(0, [1.0])], SCHEMA)
    assert nearest(alone, alone).count() == 0


@pytest.mark.parametrize("kind", ["far off", "clusters"])
def test_leaves_are_alike_in_size_and_recall_holds_anywhere(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 12))
    x += 6 if kind == "far off" else 40 * rng.integers(0, 3, (3000, 1)) ** 2
    forest = grown(x[:1500], 4)
    sizes = [np.unique(forest.leaves(x)[:, t], return_counts=True)[1] for t in range(neighbours.TREES)]
    assert all(len(s) == 16 and s.max() < 2 * 3000 / 16 for s in sizes)
    rows = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {}
    for r in nearest(df, df.filter("vec_id % 100 = 0")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    vectors = dict(rows)
    hits = sum(len(found[q] & {i for i, _ in exact(vectors, q, 10)}) for q in found)
    assert len(found) == 30 and hits >= 0.9 * 300
