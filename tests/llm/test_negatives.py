"""Hard negatives against brute force: cells, groups, slices, ties, copies and odd rows."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import negatives
from tallyloom.llm.negatives import Mining, mined

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, is_anchor, how=Mining()):
    good = [(i, y, v) for i, y, v in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    kept = {(i, y, tuple(math.floor(256 * x) for x in np.float32(v).astype(float))) for i, y, v in good}
    out = []
    for a in kept:
        if not is_anchor(a[0]):
            continue
        scored = sorted((-sum(p * q for p, q in zip(a[2], x[2], strict=True)), x[0], x[1]) for x in kept if x != a)
        for s, i, _ in [x for x in scored if x[2] == a[1]][: how.positives]:
            fit = [x for x in scored if x[2] != a[1] and how.least * -s <= 100 * -x[0] <= how.most * -s][: how.negatives]
            out += [(a[0], i, r, x[1], -s, -x[0]) for r, x in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows, is_anchor=lambda c: c % 5 == 0, how=Mining()):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in mined(df, is_anchor(F.col("vec_id")), how).collect())


def clustered(n, dims, seed, centres=6):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, dims))
    x = middle[rng.integers(0, centres, n)] + rng.standard_normal((n, dims)) * 0.4
    return [(i, int(y), v.tolist()) for i, (y, v) in enumerate(zip(rng.integers(0, 3, n), x, strict=True))]


def shrunk(monkeypatch):
    for name, value in {"CELL": 40, "GROUP": 8, "PART": 30, "SLICE": 2, "BLOCK": 16}.items():
        monkeypatch.setattr(negatives, name, value)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    shrunk(monkeypatch)
    rows = clustered(600, 5, seed)
    got = run(spark, rows)
    assert got == brute(rows, lambda i: i % 5 == 0)
    assert len(got) > 500


def test_norms_that_differ_ties_and_copies(spark, monkeypatch):
    shrunk(monkeypatch)
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, (rng.integers(-3, 4, 3) / 4 * 10.0 ** (i % 3)).tolist()) for i in range(250)]
    rows += [(1000 + i, i % 2, [1.0, 0.5, -0.25]) for i in range(200)]  # a hot vector
    rows += rows[:20]  # repeated rows
    rows += [(7, 1, [9.0, 9.0, 9.0])]  # an id with other contents
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_rings_leave_cells_out(spark, monkeypatch):
    shrunk(monkeypatch)
    rng = np.random.default_rng(4)
    corners = rng.standard_normal((12, 6)) * 10
    rows = [(i, (i // 12) % 2, (corners[i % 12] + rng.standard_normal(6) * 0.05).tolist()) for i in range(960)]
    cells = negatives.celled(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0)
    size = len(cells.space.pivots)
    anchors = cells.rows.filter("anchor").select(F.col("home").cast("long").alias("grp"), "home", "small", F.array(F.lit(100)).alias("lows"), F.array(F.lit(negatives.MOST)).alias("highs"))
    top = anchors.join(cells.rows.groupBy(F.col("cell").alias("home")).count(), "home")
    far = top.withColumn("lows", F.array(F.lit(int(256 * 256 * 400))))  # what only near rows reach
    rings = far.mapInArrow(negatives._routes(cells), "grp long, cell int, lo double, hi double").select("grp", "cell").distinct().count()
    assert size > 10
    assert rings < size * anchors.select("grp").distinct().count() / 2
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = clustered(80, 3, 5)
    one = 1.0
    odd = [(200, None, [one] * 3), (205, 1, None), (None, 1, [one] * 3), (210, 1, [one, None, one]), (215, 1, [one, nan, one]), (220, 2, [one, one, inf]), (225, 1, [])]
    zero = [(230, 1, [0.0, 0.0, 0.0]), (231, 2, [0.0, -0.0, 0.0])]
    assert run(spark, rows + odd + zero) == brute(rows + odd + zero, lambda i: i % 5 == 0)
    assert run(spark, rows + [(300, 1, [1.0, 2.0])]) == brute(rows, lambda i: i % 5 == 0)  # another length


def test_few_rows_empty_tables_and_clashing_columns(spark):
    assert run(spark, []) == [] and run(spark, [(5, None, None)]) == []
    assert run(spark, [(5, 1, [1.0, 1.0])]) == []
    few = [(5, 1, [1.0, 1.0]), (6, 1, [1.0, 0.9]), (7, 2, [0.7, 0.9])]
    assert run(spark, few) == brute(few, lambda i: i % 5 == 0) != []
    df = spark.createDataFrame(few, SCHEMA).select("*", *(F.lit("mine").alias(c) for c in ("cell", "own", "away", "anchor", "small", "grp", "lows", "score")))
    assert sorted(tuple(r) for r in mined(df, F.col("vec_id") % 5 == 0).collect()) == brute(few, lambda i: i % 5 == 0)


def test_large_numbers_are_exact_or_refused(spark):
    rows = [(i, i % 2, [float(2**15 + i), float(2**16 - i * 3)]) for i in range(30)]
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0)
    with pytest.raises(OverflowError):
        run(spark, [(5, 1, [1e30, 1.0])])


def test_other_numbers_of_positives_and_negatives(spark):
    rows, how = clustered(200, 4, 6), Mining(positives=2, negatives=5, least=10, most=99)
    assert run(spark, rows, how=how) == brute(rows, lambda i: i % 5 == 0, how)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = con.execute(negatives.ORACLE_SQL).df()
    got = negatives.op11_voronoi_negatives(spark, DATA).toPandas()
    order = ["anchor_id", "positive_id", "rank"]
    assert len(want)
    assert got.sort_values(order).values.tolist() == want[got.columns].sort_values(order).values.tolist()
