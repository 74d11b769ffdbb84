import json
import random

import pytest

from tallyloom.llm.chat import formatted, op3_tool_call_links

SCHEMA = "conv_id long, turn long, role string, text string"
TOOLS = json.dumps({"tools": [{"name": "add", "parameters": {"properties": {"x": {"type": "integer"}, "y": {"type": "string"}}, "required": ["x"]}}]})


def call(*calls):
    return json.dumps({"content": None, "tool_calls": [dict(zip(("id", "name", "arguments", "after"), c, strict=False)) for c in calls]})


def result(of, content="ok"):
    return json.dumps({"tool_call_id": of, "content": content})


def run(spark, rows):
    found = formatted(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    for r in found:
        # canonical: keys in order, no blanks
        assert r["message"] == json.dumps(json.loads(r["message"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return {(r["conv_id"], r["turn"]): r for r in found}


def test_plain_messages(spark):
    found = run(spark, [(1, 0, "user", 'a "b" \n é \\ /'), (1, 1, "assistant", None), (1, 2, None, "{broken"), (1, 3, "user", '{"tool_calls": []}')])
    assert json.loads(found[1, 0]["message"]) == {"role": "user", "content": 'a "b" \n é \\ /'}
    assert json.loads(found[1, 1]["message"])["content"] is None
    assert {r["kind"] for r in found.values()} == {"plain"}


def test_calls_are_linked_ordered_and_validated(spark):
    rows = [
        (1, 0, "system", TOOLS),
        (1, 1, "assistant", call(("b", "add", {"y": "q", "x": 1}, ["a"]), ("a", "add", '{"x": 2}'), ("c", "add", {"x": "no", "z": 0}))),
        (1, 2, "tool", result("b")),
        (1, 3, "tool", result("a", {"k": [1, 2]})),
        (1, 4, "tool", result("nobody")),
        (2, 0, "tool", result("a")),
    ]
    found = run(spark, rows)
    message = json.loads(found[1, 1]["message"])
    assert [c["id"] for c in message["tool_calls"]] == ["a", "c", "b"]
    assert message["tool_calls"][0]["arguments"] == {"x": 2}
    assert (found[1, 1]["n_calls"], found[1, 1]["n_linked"], found[1, 1]["n_invalid"]) == (3, 2, 1)
    assert [(found[1, t]["anchor_turn"], found[1, t]["level"], found[1, t]["kind"]) for t in (3, 2, 4)] == [(1, 1, "result"), (1, 2, "result"), (4, 0, "orphan")]
    assert found[2, 0]["kind"] == "orphan"


def test_a_cycle_has_no_level_and_a_repeated_id_counts_once(spark):
    rows = [(1, 1, "assistant", call(("a", "f", {}, ["b"]), ("b", "f", {}, ["a"]))), (1, 2, "assistant", call(("a", "f", {}))), (1, 3, "tool", result("a"))]
    found = run(spark, rows)
    assert found[1, 3]["anchor_turn"] == 1 and found[1, 3]["level"] is None
    assert (found[1, 1]["n_linked"], found[1, 2]["n_linked"]) == (1, 0)


def test_missing_arguments(spark):
    found = run(spark, [(1, 0, "system", TOOLS), (1, 1, "assistant", call(("a", "add", {"y": "v"}), ("b", "add", None), ("c", "other", {"x": "free"})))])
    assert found[1, 1]["n_invalid"] == 2


def test_repeats_extra_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, 1, "assistant", call(("a", "f", {})), "k")] * 2 + [(1, 2, "tool", result("a"), "k")], SCHEMA + ", key string")
    found = formatted(df).collect()
    assert len(found) == 3
    assert len({r["message"] for r in found if r["kind"] == "call"}) == 1
    assert formatted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_all_conversations(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/conversations.parquet").collect()
    found = {(r["conv_id"], r["turn"]): json.loads(r["message"]) for r in op3_tool_call_links(spark, folder).collect()}
    assert found == {(r["conv_id"], r["turn"]): {"role": r["role"], "content": r["text"]} for r in rows}


def test_a_chain_deeper_than_any_bound(spark):
    n = 70
    rows = [(1, 0, "assistant", call(*[(f"c{i}", "f", {}, [f"c{i - 1}"] if i else []) for i in reversed(range(n))])), *[(1, 1 + i, "tool", result(f"c{i}")) for i in range(n)]]
    found = run(spark, rows)
    assert [found[1, 1 + i]["level"] for i in range(n)] == [i + 1 for i in range(n)]
    assert [c["id"] for c in json.loads(found[1, 0]["message"])["tool_calls"]] == [f"c{i}" for i in range(n)]


def test_white_space_before_an_object(spark):
    found = run(spark, [(1, 0, "assistant", " \n\t" + call(("a", "f", {}))), (1, 1, "tool", "\n" + result("a"))])
    assert (found[1, 0]["kind"], found[1, 1]["kind"], found[1, 0]["n_linked"]) == ("call", "result", 1)


def brute_levels(calls):
    """Of one conversation's calls (turn, id, after), in order: level by id."""
    first = {}
    for turn, i, after in calls:
        first.setdefault(i, (turn, after))
    level = {}
    while True:
        more = {}
        for i, (turn, after) in first.items():
            needs = [n for n in after if n in first and first[n][0] <= turn]
            if i not in level and all(n in level for n in needs):
                more[i] = max((level[n] + 1 for n in needs), default=0)
        if not more:
            return level, first
        level |= more


def test_links_and_levels_are_those_of_brute_force(spark):
    rng = random.Random(3)
    rows, wanted = [], {}
    for conv in range(40):
        calls = []
        for turn in range(rng.randrange(1, 5)):
            made = []
            for _ in range(rng.randrange(1, 5)):
                i = f"c{rng.randrange(9)}"
                after = [f"c{rng.randrange(9)}" for _ in range(rng.randrange(3))]
                if i not in [m[0] for m in made]:
                    made.append((i, "f", {}, after))
                    calls.append((turn, i, after))
            rows.append((conv, turn, "assistant", call(*made)))
        level, first = brute_levels(calls)
        for k in range(9):
            rows.append((conv, 10 + k, "tool", result(f"c{k}")))
            i = f"c{k}"
            wanted[conv, 10 + k] = ("result", first[i][0], level[i] + 1 if i in level else None) if i in first else ("orphan", 10 + k, 0)
    found = run(spark, rows)
    assert {k: (found[k]["kind"], found[k]["anchor_turn"], found[k]["level"]) for k in wanted} == wanted


SCHEMA_TOOLS = {
    "type": "object",
    "properties": {
        "place": {"type": "object", "properties": {"city": {"type": "string", "minLength": 2}, "at": {"type": "array", "items": {"type": "number", "minimum": 0, "maximum": 9}}}, "required": ["city"], "additionalProperties": False},
        "unit": {"enum": ["c", "f", 1]},
        "many": {"type": ["integer", "null"]},
        "a/b": {"type": "boolean"},
    },
    "required": ["unit"],
}


@pytest.mark.parametrize("tool", [SCHEMA_TOOLS])
def test_arguments_are_held_against_nested_schemas(spark, tool):
    cases = [
        ({"unit": "c"}, 0),
        ({"unit": "c", "unknown": 1}, 0),
        ({"unit": "x"}, 1),
        ({}, 1),
        ({"unit": 1, "many": None, "a/b": True}, 0),
        ({"unit": 1, "many": 1.5}, 1),
        ({"unit": "f", "a/b": 1}, 1),
        ({"unit": "f", "place": {"city": "Rome", "at": [1, 2.5]}}, 0),
        ({"unit": "f", "place": {"at": []}}, 1),
        ({"unit": "f", "place": {"city": "Rome", "zip": 1}}, 1),
        ({"unit": "f", "place": {"city": "R"}}, 1),
        ({"unit": "f", "place": {"city": "Rome", "at": [1, 10]}}, 1),
        ({"unit": "f", "place": {"city": "Rome", "at": [1, "2"]}}, 1),
        ({"unit": "f", "place": "Rome"}, 1),
        ([1], 1),
    ]
    rows = [(1, 0, "system", json.dumps({"tools": [{"name": "t", "parameters": tool}, {"name": "free"}]}))]
    rows += [(1, 1 + i, "assistant", call((f"c{i}", "t", a))) for i, (a, _) in enumerate(cases)] + [(1, 99, "assistant", call(("z", "free", {"any": [1]})))]
    found = run(spark, rows)
    assert [found[1, 1 + i]["n_invalid"] for i in range(len(cases))] == [n for _, n in cases]
    assert found[1, 99]["n_invalid"] == 0


def test_null_conversations_and_very_long_texts(spark):
    long = "x" * 3_000_000
    found = formatted(spark.createDataFrame([(None, 0, "user", long), (None, None, "assistant", call(("a", "f", {"x": long}))), (None, 2, "tool", result("a"))], SCHEMA)).collect()
    assert len(found) == 3 and max(len(r["message"]) for r in found) > 3_000_000
