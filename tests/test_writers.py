"""Writers: envelope, mirrors, what is queued, scope, and batches that are there whole or not at all."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyloom.operators import writers
from tallyloom.operators.merge import Policy
from tallyloom.operators.scope import ScopeError, creator_token, editor, manager
from tallyloom.sources.batches import Batches
from tallyloom.streaming import sync

ASSET = writers.record("collab_id string, branch_id string, bytes long, is_published boolean, is_published_i int, upload_state string")
CHANGES = "id string, changes map<string,string>"


@pytest.fixture
def book(spark, tmp_path):
    return Batches(spark, str(tmp_path), {"asset": ASSET, "meta": writers.record("value string"), "outbox": writers.OUTBOX_TABLE})


def writer(book, session=None, start=100):
    now = iter(range(start, 10_000, 100))
    return writers.Writer(book, session or manager("o1", "u"), "dev", lambda: next(now))


def rows_of(book, table="asset"):
    return {r["id"]: r.asDict() for r in book.current(table).collect()}


def queued(book):
    return [(r["seq"], r["table"], r["row_id"], r["op"], {k: json.loads(v) for k, v in r["patch"].items()}, r["base_rev"]) for r in book.current("outbox").orderBy("seq").collect()]


def test_create_fills_the_envelope_and_queues_the_row(spark, book):
    writer(book).create("one", "asset", spark.createDataFrame([("a", True, "here"), ("", False, None), (None, None, None)], "id string, is_published boolean, upload_state string"))
    rows = rows_of(book)
    a = rows.pop("a")
    assert (a["org_id"], a["created_at"], a["updated_at"], a["server_updated_at"], a["deleted_at"], a["rev"], a["origin_device"]) == ("o1", 100, 100, None, None, 1, "dev")
    assert (a["is_published"], a["is_published_i"], a["upload_state"]) == (True, 1, "here")
    assert len(rows) == 2 and all(len(i) == 36 for i in rows) and {r["is_published_i"] for r in rows.values()} == {0}
    entries = queued(book)
    assert [e[0] for e in entries] == [1, 2, 3]
    said = next(e for e in entries if e[2] == "a")
    assert said[3] == "put" and said[4]["is_published_i"] == 1 and "upload_state" not in said[4] and "bytes" not in said[4] and said[5] == 0


def test_patch_says_what_changed_and_its_mirror(spark, book):
    w = writer(book)
    w.create("one", "asset", spark.createDataFrame([("a", True, 5), ("b", True, 6)], "id string, is_published boolean, bytes long"))
    w.patch("two", "asset", spark.createDataFrame([("a", {"is_published": "false", "bytes": "7", "id": '"z"'}), ("b", {"upload_state": '"half"'})], CHANGES))
    rows = rows_of(book)
    assert (rows["a"]["is_published"], rows["a"]["is_published_i"], rows["a"]["bytes"], rows["a"]["rev"], rows["a"]["updated_at"], rows["a"]["created_at"]) == (False, 0, 7, 2, 200, 100)
    assert (rows["b"]["upload_state"], rows["b"]["rev"]) == ("half", 2)
    assert queued(book)[2:] == [(3, "asset", "a", "patch", {"is_published": False, "is_published_i": 0, "bytes": 7, "updated_at": 200}, 1)]
    w.patch("three", "asset", spark.createDataFrame([("a", {"bytes": "null"})], CHANGES))
    assert rows_of(book)["a"]["bytes"] is None and queued(book)[-1][4] == {"bytes": None, "updated_at": 300}


def test_soft_delete_leaves_a_tombstone_and_absent_rows_alone(spark, book):
    w = writer(book)
    w.create("one", "asset", spark.createDataFrame([("a",)], "id string"))
    w.soft_delete("two", "asset", spark.createDataFrame([("a",), ("nowhere",)], "id string"))
    a = rows_of(book)["a"]
    assert (a["deleted_at"], a["updated_at"], a["rev"]) == (200, 200, 2)
    assert queued(book)[1:] == [(2, "asset", "a", "soft_delete", {"deleted_at": 200, "updated_at": 200}, 1)]
    with pytest.raises(PySparkException, match="not visible"):
        w.soft_delete("three", "asset", spark.createDataFrame([("a",)], "id string"))


def test_what_may_not_be_written_fails_the_batch_whole(spark, book):
    writer(book).create("one", "asset", spark.createDataFrame([("a", "c1"), ("b", "c2")], "id string, collab_id string"))
    before, said = rows_of(book), queued(book)
    changes = lambda *ids: spark.createDataFrame([(i, {"bytes": "1"}) for i in ids], CHANGES)
    with pytest.raises(PySparkException, match="does not exist"):
        writer(book).patch("two", "asset", changes("a", "x"))
    with pytest.raises(PySparkException, match="not visible"):
        writer(book, creator_token("o1", "c1")).patch("two", "asset", changes("a", "b"))
    with pytest.raises(ScopeError):
        writer(book, editor("o1", "u")).create("two", "asset", changes("a").select("id"))
    assert (rows_of(book), queued(book)) == (before, said)
    writer(book, creator_token("o1", "c1")).patch("two", "asset", changes("a"))
    assert rows_of(book)["a"]["bytes"] == 1


def test_tables_of_a_device_reach_no_outbox(spark, book):
    writer(book).create("one", "meta", spark.createDataFrame([("k", "v")], "id string, value string"))
    assert rows_of(book, "meta")["k"]["value"] == "v" and queued(book) == []


@pytest.mark.parametrize("killed", ["outbox", "manifest"])
def test_a_job_killed_between_the_writes_leaves_neither(spark, book, monkeypatch, killed):
    writer(book).create("one", "asset", spark.createDataFrame([("a", 1)], "id string, bytes long"))
    before, said = rows_of(book), queued(book)
    stage = Batches.stage

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Batches, "stage", lambda self, b, n, table, rows: die() if table == killed else stage(self, b, n, table, rows))
        if killed == "manifest":
            m.setattr(Batches, "publish", die)
        with pytest.raises(KeyboardInterrupt):
            writer(book, start=500).patch("two", "asset", spark.createDataFrame([("a", {"bytes": "2"})], CHANGES))
    assert (rows_of(book), queued(book)) == (before, said)
    for _ in range(2):  # run again, and once more: the second time it is there
        writer(book, start=700).patch("two", "asset", spark.createDataFrame([("a", {"bytes": "2"})], CHANGES))
    assert (rows_of(book)["a"]["bytes"], rows_of(book)["a"]["rev"], len(queued(book))) == (2, 2, 2)


def test_a_number_is_taken_once(spark, book):
    writer(book).create("one", "asset", spark.createDataFrame([("a",)], "id string"))
    with pytest.raises(Exception, match="(?i)exist"):
        book.publish("other", 0, ["asset"], 0)
    assert [r["batch"] for r in book.committed()] == ["one"]


def test_compaction_changes_nothing(spark, book):
    w = writer(book)
    w.create("one", "asset", spark.createDataFrame([("a", 1), ("b", 1)], "id string, bytes long"))
    w.patch("two", "asset", spark.createDataFrame([("a", {"bytes": "2"})], CHANGES))
    before = rows_of(book)
    book.compact("asset")
    assert rows_of(book) == before and book.read("asset").count() == 2
    w.patch("three", "asset", spark.createDataFrame([("b", {"bytes": "3"})], CHANGES))
    assert {i: r["bytes"] for i, r in rows_of(book).items()} == {"a": 2, "b": 3} and len(queued(book)) == 4


PATCH = "row_id string, seq long, updated_at long, patch map<string,string>"


def drained(spark, tmp_path, parts, policy=Policy()):
    folder = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, PATCH).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(PATCH).parquet(folder)
        sync.drain(source, spark, str(tmp_path / "out"), policy, str(tmp_path / "check"), lambda: 100).awaitTermination()
    return Batches(spark, str(tmp_path / "out"), sync.DRAINED)


def test_a_drained_batch_writes_what_changed(spark, tmp_path):
    many = [(f"r{i:05d}", i, 1, {"x": json.dumps(f"{i * 7919 % 10007}")}) for i in range(20_000)]
    book = drained(spark, tmp_path, [many, [("r00005", 20_001, 2, {"x": '"new"'})]])
    size = [sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "out" / "rows" / f"epoch-{e}") for f in fs) for e in (0, 1)]
    assert size[1] * 10 < size[0]
    rows = {r["row_id"]: (r["row"]["x"], r["rev"], r["server_updated_at"]) for r in book.current("rows").filter(F.col("row_id").isin("r00005", "r00006")).collect()}
    assert rows == {"r00005": ('"new"', 2, 101), "r00006": (f'"{6 * 7919 % 10007}"', 1, 100)}


def test_an_entry_that_fails_fails_alone_and_a_replay_adds_nothing(spark, tmp_path):
    part = [("a", 1, 1, {"x": "1"}), ("a", 2, 2, {"x": "{torn"}), (None, 3, 2, {"x": "3"}), ("b", 4, 2, None), ("a", 5, 1, {"y": "null"})]
    book = drained(spark, tmp_path, [part])
    assert {r["seq"]: r["error"] for r in book.current("entries").collect()} == {1: None, 2: "not JSON: x", 3: "no row", 4: "no patch", 5: None}
    assert {r["row_id"]: r["row"] for r in book.current("rows").collect()} == {"a": {"x": "1", "y": "null"}}
    again = sync.drain(spark.readStream.schema(PATCH).parquet(str(tmp_path / "in")), spark, str(tmp_path / "out"), Policy(), str(tmp_path / "fresh"), lambda: 900)
    again.awaitTermination()
    assert [r["batch"] for r in book.committed()] == ["epoch-0"]


def test_many_batches_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sync, "COMPACTED", 2)
    book = drained(spark, tmp_path, [[("a", i, i, {"x": str(i)})] for i in range(3)])
    assert [bool(r["bases"]) for r in book.committed()] == [False, False, True, False, True]
    assert [(r["row"], r["rev"]) for r in book.current("rows").collect()] == [({"x": "2"}, 3)]
