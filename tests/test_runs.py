"""Runs: one answer for equal requests, guards before, failures with whole metadata only, and replays."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import runs
from tallyloom.sources.batches import Batches

SCHEMA = "request_id string, asset_id string, sheet_key string, input string, values map<string,string>"


@pytest.fixture
def book(spark, tmp_path):
    return Batches(spark, str(tmp_path), runs.TABLES)


def call(provider="mock", template="Look at {{what}}"):
    return runs.Call("vision_tag", provider, "m1", template, "3", "vision", "2", lambda x: F.get_json_object(x, "$.ok").isNotNull(), ("what",))


def request(i, subject="a1", sheet="s", what="sea"):
    return (i, subject, sheet, what if what is None or what[0] == "{" else json.dumps({"what": what, "n": 1.0}), {"what": what})


def answers(seen):
    def produce(prompts):
        rows = prompts.collect()  # a test's few
        seen.extend(r["prompt"] for r in rows)
        made = []
        for r in rows:
            what = r["prompt"].removeprefix("Look at ")
            if what != "silent":
                made.append((r["cache_key"], json.dumps({"ok" if what != "bad" else "no": what}), 5, "refused" if what == "never" else None))
        return prompts.sparkSession.createDataFrame(made, "cache_key string, output string, latency_ms long, error_code string")

    return produce


def test_equal_requests_are_produced_once_and_remembered(spark, book):
    seen = []
    rows = [request("r1"), request("r2", "a2"), ("r3", "a3", "s", '{"n": 1, "what": "sea"}', {"what": "sea"}), request("r4", what="dog")]
    runs.run(book, "one", call(), spark.createDataFrame(rows, SCHEMA), answers(seen))
    assert sorted(seen) == ["Look at dog", "Look at sea"] and book.read("memo").count() == 2
    runs.run(book, "two", call(), spark.createDataFrame([request("r5"), request("r6", what="cat")], SCHEMA), answers(seen))
    assert sorted(seen)[0] == "Look at cat" and len(seen) == 3 and book.read("memo").count() == 3
    got = {r["request_id"]: r for r in book.current("ai_run").collect()}
    assert sorted(got) == ["r1", "r2", "r3", "r4", "r5", "r6"] and {r["status"] for r in got.values()} == {"ok"}
    assert got["r1"]["input_hash"] == got["r3"]["input_hash"] and (got["r2"]["subject_type"], got["r2"]["subject_id"]) == ("asset", "a2")
    assert (got["r1"]["model_id"], got["r1"]["simulated_model_id"], got["r1"]["model_key"], got["r1"]["latency_source"]) == (None, "m1", "mock:m1", "simulated")
    # another prompt or model is another key
    runs.run(book, "three", call("live"), spark.createDataFrame([request("r7")], SCHEMA), answers(seen))
    runs.run(book, "four", call(template="Look at {{what}}!"), spark.createDataFrame([request("r8")], SCHEMA), answers(seen))
    assert len(seen) == 5
    assert [(r["model_id"], r["latency_source"]) for r in book.current("ai_run").filter("request_id = 'r7'").collect()] == [("m1", "measured")]


def test_what_may_not_be_run_leaves_no_trace(spark, book):
    rows = [request("r1", sheet=" "), request("r2", sheet=None), request("r3", subject=None), request("r4")]
    refused = runs.run(book, "one", call(), spark.createDataFrame(rows, SCHEMA), answers([]))
    assert {r["request_id"]: r["reason"] for r in refused.collect()} == {"r1": "no_stills", "r2": "no_stills", "r3": "missing_asset_id"}
    assert [r["request_id"] for r in book.current("ai_run").collect()] == ["r4"]


def test_failures_are_kept_whole_and_not_remembered(spark, book):
    rows = [request("r1", what="bad"), request("r2", what="silent"), request("r3", what="never"), request("r4", what="{torn"), request("r5", what=None)]
    runs.run(book, "one", call(), spark.createDataFrame(rows, SCHEMA), answers([]))
    got = {r["request_id"]: (r["status"], r["error_code"], r["schema_valid"], r["output"]) for r in book.current("ai_run").collect()}
    # without an input hash there is nothing honest to write
    assert got == {"r1": ("error", "invalid_output", False, '{"no": "bad"}'), "r2": ("error", "no_answer", True, None), "r3": ("refused", "refused", True, '{"ok": "never"}')}
    assert book.read("memo").count() == 0
    seen = []
    runs.run(book, "two", call(), spark.createDataFrame([request("r6", what="bad")], SCHEMA), answers(seen))
    assert seen == ["Look at bad"]


def test_a_batch_that_ran_isnt_run_again_and_templates_are_held(spark, book):
    seen, df = [], spark.createDataFrame([request("r1")], SCHEMA)
    for _ in range(2):
        runs.run(book, "one", call(), df, answers(seen))
    assert len(seen) == 1 and len(book.committed()) == 1
    with pytest.raises(ValueError, match="needs"):
        runs.run(book, "two", call(template="{{else}}"), df, answers(seen))


def test_schema_for_the_wire():
    schema = {"type": "object", "minItems": 1, "properties": {"minimum": {"type": "integer", "minimum": 0}, "a": {"anyOf": [{"type": "string", "maxLength": 3}, {"type": "null"}]}}, "items": {"uniqueItems": True, "enum": ["x"]}}
    assert runs.wire_schema(schema) == {"type": "object", "properties": {"minimum": {"type": "integer"}, "a": {"anyOf": [{"type": "string"}, {"type": "null"}]}}, "items": {"enum": ["x"]}}
