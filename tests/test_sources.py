import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.merge import Policy
from tallyloom.sources import tables
from tallyloom.sources.batches import Batches
from tallyloom.streaming import sync


def test_snapshot_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", None), ("b", "y", 7)], "id string, name string, deleted_at long")
    there = spark.createDataFrame([("a", "old", None), ("c", "kept", None)], "id string, name string, deleted_at long")
    tables.export_snapshot({"asset": rows, "outbox": rows}, str(tmp_path / "s"))
    back = tables.import_snapshot(spark, str(tmp_path / "s"), {"asset": there, "outbox": there})
    assert sorted(tuple(r) for r in back["asset"].collect()) == sorted([("a", "x", None), ("b", "y", 7), ("c", "kept", None)], key=str)
    assert back["outbox"].count() == 2


def test_a_later_version_is_refused(spark, tmp_path):
    (tmp_path / "s" / "_manifest").mkdir(parents=True)
    (tmp_path / "s" / "_manifest" / "m.json").write_text(json.dumps({"format": tables.FORMAT, "version": 99, "table": "asset", "rows": 0}))
    with pytest.raises(ValueError, match="later version"):
        tables.import_snapshot(spark, str(tmp_path / "s"), {})


def test_keyset_pages_meet(spark):
    df = spark.range(1, 21).select((F.col("id") % 4).alias("at"), F.col("id"))
    seen, cursor = [], (None, None)
    while True:
        page = tables.after_cursor(df, *[None if v is None else F.lit(v) for v in cursor], "at", "id", 6).collect()
        if not page:
            break
        seen += [(r["at"], r["id"]) for r in page]
        cursor = seen[-1]
    assert seen == sorted((i % 4, i) for i in range(1, 21))


PATCH = "row_id string, seq long, updated_at long, patch map<string,string>"


def test_a_drained_stream_equals_one_batch(spark, tmp_path):
    patches = [("r1", 1, 1, {"x": "1"}), ("r1", 2, 5, {"x": "2"}), ("r2", 3, 2, {"y": '"a"'}), ("r1", 4, 3, {"x": "3", "z": "9"})]
    policy, folder = Policy(write_once=("z",)), str(tmp_path / "in")
    for part in (patches[:2], patches[2:]):
        spark.createDataFrame(part, PATCH).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(PATCH).parquet(folder)
        sync.drain(source, spark, str(tmp_path / "out"), policy, str(tmp_path / "check"), lambda: 100).awaitTermination()
    got = {r["row_id"]: r["row"] for r in Batches(spark, str(tmp_path / "out"), sync.DRAINED).current("rows").collect()}
    assert got["r2"] == {"y": '"a"'}
    assert got["r1"]["z"] == "9"


def test_unchanged_rows_are_not_stamped(spark):
    before = spark.createDataFrame([("a", {"x": "1"}, 3)], "row_id string, row map<string,string>, rev long")
    after = spark.createDataFrame([("a", {"x": "1"}), ("b", {"x": "2"})], "row_id string, row map<string,string>")
    assert [tuple(r) for r in sync.stamped(before, after, 50).select("row_id", "rev", "server_updated_at").collect()] == [("b", 1, 50)]


def test_pull_by_cursor(spark):
    rows = spark.createDataFrame([("t", 5, "a"), ("t", 5, "b"), ("t", 6, "a"), ("u", 1, "z")], "table string, server_updated_at long, row_id string")
    cursor = spark.createDataFrame([("t", 5, "a")], "table string, server_updated_at long, row_id string")
    page = sync.pulled(rows, cursor)
    assert sorted(tuple(r) for r in page.select("table", "server_updated_at", "row_id").collect()) == [("t", 5, "b"), ("t", 6, "a"), ("u", 1, "z")]
    assert sorted(tuple(r) for r in sync.advanced(cursor, page).select("table", "server_updated_at", "row_id").collect()) == [("t", 6, "a"), ("u", 1, "z")]
