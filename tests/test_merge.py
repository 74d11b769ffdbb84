"""The merge against a fold over patches in plain Python, and its cases one by one."""

import json
import random

from tallyloom.operators.merge import ENVELOPE_STICKY, ENVELOPE_WRITE_ONCE, POLICIES, SERVER_OWNED, Policy, merge

SCHEMA = "row_id string, seq long, updated_at long, patch map<string,string>"


def run(spark, patches, policy):
    rows = [(r, s, at, {k: json.dumps(v) for k, v in p.items()}) for r, s, at, p in patches]
    found = merge(spark.createDataFrame(rows, SCHEMA), policy)
    state = {r["row_id"]: {k: json.loads(v) for k, v in r["row"].items()} for r in found.rows.collect()}
    clashes = sorted((r["row_id"], r["seq"], tuple(r["fields"]), r["policy"], r["kept"], r["refused"]) for r in found.conflicts.collect())
    return state, clashes


def last(spark, policy, *patches):
    state, clashes = run(spark, [("r", i, at, p) for i, (at, p) in enumerate(patches)], policy)
    return state["r"], clashes


ASSET = POLICIES["asset"]


def test_a_late_approval_never_beats_a_rejection(spark):
    row, clashes = last(spark, ASSET, (1, {"review_status": "pending"}), (5, {"review_status": "rejected"}), (9, {"review_status": "approved"}))
    assert row["review_status"] == "rejected"
    assert [(c[3], c[4], c[5]) for c in clashes] == [("ordinal", '"rejected"', '"approved"')]


def test_a_rejection_unpublishes(spark):
    row, clashes = last(spark, ASSET, (1, {"review_status": "approved", "is_published": True}), (5, {"review_status": "rejected"}))
    assert row == {"review_status": "rejected", "is_published": False}
    assert [c[3] for c in clashes] == ["implies"]


def test_write_once_takes_a_value_over_null_and_no_other(spark):
    row, clashes = last(spark, ASSET, (1, {"bytes": None}), (2, {"bytes": 10}), (3, {"bytes": 10}), (4, {"bytes": 11}))
    assert row["bytes"] == 10
    assert [c[1] for c in clashes] == [3]


def test_a_refused_group_is_refused_whole(spark):
    row, clashes = last(spark, ASSET, (1, {"review_status": "rejected", "reject_reason_text": "dark"}), (9, {"reject_reason_text": "fine", "review_status": "approved"}))
    assert row["reject_reason_text"] == "dark"
    assert clashes[0][2] == ("review_status", "reject_reason_text")


def test_nothing_is_resurrected_and_server_fields_are_not_taken(spark):
    row, _ = last(spark, Policy(), (1, {"deleted_at": 7, "rev": 3}), (9, {"deleted_at": None, "server_updated_at": 1}))
    assert row == {"deleted_at": 7}


def test_last_write_wins_both_ways(spark):
    assert last(spark, Policy(), (5, {"x": "a"}), (9, {"x": "b"}))[0] == {"x": "b"}
    assert last(spark, Policy(), (5, {"x": "a"}), (1, {"x": "b"}))[0] == {"x": "a"}


def test_an_immutable_table_keeps_its_first_row(spark):
    assert last(spark, POLICIES["ai_run"], (1, {"x": 1}), (9, {"x": 2})) == ({"x": 1}, [])


def fold(patches, policy):
    """One row's patches, one after the other."""
    rank = lambda f, v: policy.ordinal[f].index(v) if v in policy.ordinal[f] else -1
    grouped = {f for g in policy.coupled for f in g}
    sticky = {k: v for k, v in {**ENVELOPE_STICKY, **policy.sticky}.items() if k not in grouped}
    once = set((*ENVELOPE_WRITE_ONCE, *policy.write_once)) - grouped - set(sticky)
    row, latest = None, 0
    for at, patch in patches:
        patch = {k: v for k, v in patch.items() if k not in SERVER_OWNED}
        if row is None:
            row, latest = dict(patch), at
            continue
        wins = at >= latest
        for group in policy.coupled:
            ladder = next((f for f in group if f in policy.ordinal), None)
            accept = wins
            if ladder in patch:
                new, old = rank(ladder, patch[ladder]), rank(ladder, row.get(ladder)) if row.get(ladder) is not None else -1
                accept = new > old or new == old and wins
            if accept:
                row |= {f: patch[f] for f in group if f in patch}
        for f, v in patch.items():
            if f in grouped or f in policy.recompute:
                continue
            if f in sticky:
                held = row.get(f)
                stuck = held is not None if sticky[f] is None else held == sticky[f]
                if not stuck:
                    row[f] = v
            elif f in once:
                if row.get(f) is None:
                    row[f] = v
            elif f in policy.ordinal:
                if rank(f, v) > (rank(f, row[f]) if row.get(f) is not None else -1):
                    row[f] = v
            elif wins:
                row[f] = v
        latest = max(latest, at)
    return row


def test_random_patches_fold_alike(spark):
    policy = Policy(write_once=("bytes",), ordinal={"status": ("open", "closed"), "stage": ("a", "b", "c")}, sticky={"life": "blocked"}, coupled=(("status", "why"),), recompute=("used",))
    rng = random.Random(5)
    values = {"bytes": [None, 1, 2], "status": ["open", "closed", "odd"], "why": ["x", "y"], "stage": ["a", "b", "c", "odd"], "life": ["on", "blocked"], "used": [1, 2], "note": ["p", "q"], "deleted_at": [None, 4]}
    patches = {f"r{i}": [(rng.randrange(6), {f: rng.choice(v) for f, v in values.items() if rng.random() < 0.5 or n == 0}) for n in range(rng.randint(1, 6))] for i in range(150)}
    state, _ = run(spark, [(r, s, at, p) for r, ps in patches.items() for s, (at, p) in enumerate(ps)], policy)
    assert state == {r: fold(ps, policy) for r, ps in patches.items()}
