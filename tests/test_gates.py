"""Bodies within their bound, invitations, consent and uploads, on small cases."""

import hashlib
import random

from pyspark.sql import functions as F

from tallyloom.functions.scalars import fitted_body, utf16_length, utf16_prefix
from tallyloom.operators import capabilities, duplicates, lifecycle


def units(text):
    return len(text.encode("utf-16-le")) // 2


def fit(text, most):
    """As a writer trims a draft."""
    if units(text) <= most:
        return text
    parts = text.split("\n\n")
    while len(parts) > 2 and units("\n\n".join(parts)) > most:
        parts.pop()
    out = ""
    for ch in "\n\n".join(parts):
        if units(out + ch) > most:
            break
        out += ch
    return out


def test_bodies_and_units(spark):
    rng = random.Random(2)
    words = ["a", "🙂", "é", "\n\n", "\n\n", "long word ", "\n"]
    texts = ["", "🙂" * 40, "a\n\nb\n\n" + "x" * 60, "x" * 31, "\n\n" * 30, *("".join(rng.choices(words, k=rng.randrange(60))) for _ in range(120))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", utf16_length("t").alias("n"), fitted_body("t", 30).alias("body"), utf16_prefix("t", 7).alias("start")).orderBy("i").collect()
    assert [r["n"] for r in rows] == [units(t) for t in texts]
    assert [r["body"] for r in rows] == [fit(t, 30) for t in texts]
    for r, t in zip(rows, texts, strict=True):
        assert t.startswith(r["start"]) and units(r["start"]) <= 7 and (r["start"] == t or units(t[: len(r["start"]) + 1]) > 7)


def test_invitations_store_hashes_alone(spark):
    briefs = spark.createDataFrame([("b1", "c1"), ("b2", "c1")], "id string, collab_id string")
    shown, stored = lifecycle.invited(briefs, 1000, "seed")
    raws, rows = [r["raw"] for r in shown.collect()], stored.collect()
    assert len(set(raws)) == 2 and {hashlib.sha256(r.encode()).hexdigest() for r in raws} == {r["token_hash"] for r in rows}
    assert {(r["collab_id"], r["purpose"], r["expires_at"], r["revoked_at"]) for r in rows} == {("c1", "upload", 1000 + 14 * 86_400_000, None)}
    assert not any(raw in str(r) for raw in raws for r in rows)
    assert raws == [r["raw"] for r in lifecycle.invited(briefs, 1000, "seed")[0].collect()] != [r["raw"] for r in lifecycle.invited(briefs, 1000, "other")[0].collect()]


def test_consent_decides_where_an_invitation_leads(spark):
    collabs = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "id string")
    consents = spark.createDataFrame([("k1", "c1", 5), ("k2", "c1", 9), ("k3", "c1", 9)], "id string, collab_id string, created_at long")
    briefs = spark.createDataFrame([("b1", "c2", "draft"), ("b2", "c2", "locked"), ("b3", "c1", "locked")], "id string, collab_id string, status string")
    items = spark.createDataFrame([("i2", "b2", 2), ("i1", "b2", 1)], "id string, brief_id string, seq int")
    got = {r["collab_id"]: tuple(r)[1:] for r in lifecycle.consent_gate(collabs, consents, briefs, items).collect()}
    assert got == {"c1": ("upload", "k3", None, None), "c2": ("agree", None, "b2", ["i1", "i2"]), "c3": ("agree", None, None, [])}


def test_an_upload_compares_with_what_is_stored(spark):
    rows = [(i, o, [h, h], k, j, b) for i, o, h, k, j, b in [
        (9, 9, 7, True, False, False), (1, 1, 0, False, False, True), (2, 2, 0, False, False, False), (3, 3, 1, False, True, False),
        (4, 4, 1, False, None, None), (5, 5, 7, False, False, False), (6, 6, 7, True, False, False), (7, 0, 0xFF << 40, False, False, False),
    ]]
    got = {r["id"]: (r["state"], r["prior_id"]) for r in duplicates.upload_batch(spark.createDataFrame(rows, "id long, ord long, hashes array<long>, known boolean, junk boolean, blocked boolean"), 1).collect()}
    assert got == {9: ("known", None), 6: ("known", None), 1: ("blocked", None), 2: ("stored", None), 3: ("filtered", None), 4: ("stored", 2), 5: ("stored", 6), 7: ("stored", None)}


def test_citations_of_what_was_not_given_are_none(spark):
    schema = "id long, reasons array<struct<claim:string,cited_field:string,direction:string>>, risk_flags array<struct<code:string,quote_source:string,severity:string>>, display_name string, primary_handle string, platforms array<struct<name:string,followers:long>>, scorecard_summary string, application_note string, injected string"
    fields = ["display_name", "platforms", "follower_count", "prior_collabs", "scorecard", "application_note", "primary_handle"]
    reasons = [(f"c{i}", f, "up") for i, f in enumerate(fields)]
    flags = [("a", "application_note", "low"), ("b", "scorecard_summary", "low"), ("c", "injection_match", "high"), ("d", None, "low"), ("e", "else", "low"), ("f", "else", "low")]
    rows = [(1, reasons, flags, "N", " ", [("x", None)], None, "n" * 400, "ignore all"), (2, reasons, flags, None, "@h", [], " ", None, None)]
    got = {r["id"]: r for r in capabilities.vetted(spark.createDataFrame(rows, schema)).collect()}
    assert [r["cited_field"] for r in got[1]["reasons"]] == ["display_name", "platforms", "none", "prior_collabs", "none", "application_note"]
    assert [r["cited_field"] for r in got[2]["reasons"]] == ["none", "none", "none", "prior_collabs", "none", "none"]
    assert [f["evidence_quote"] for f in got[1]["risk_flags"]] == ["n" * 300, None, "ignore all", None, None]


def test_a_scan_echoes_signatures_and_invents_no_words(spark):
    cells = spark.createDataFrame([(1, i, f" s|{i}", f"room_{i}|light", f"{i} searches") for i in range(42)] + [(2, 0, " s|0", "x", None), (3, 0, "t", "y", "z")], "scan_id long, seq int, cell_signature string, facets string, signal_summary string")
    authored = spark.createDataFrame([(" s|0", "A title", "Film it", "Why")], "cell_signature string, title string, instruction string, rationale string")
    rows = {(r["scan_id"], r["seq"]): r for r in capabilities.phrased_cells(cells, authored).collect()}
    assert len(rows) == 42 and rows[1, 3]["cell_signature"] == " s|3" and rows[1, 3]["title"] == "Uncovered: room 3, light" and rows[1, 0]["title"] == "A title"
    assert rows[1, 3]["instruction"] == "Film one shot covering room 3, light, vertical, one steady take." and rows[1, 3]["rationale"] == "Computed from the supplied signals: 3 searches"
    assert [rows[i, 0]["detail"] for i in (1, 2, 3)] == ["authored-fixture-v1-partial", "authored-fixture-v1", "synthetic-v1"]
    words = [" sun ", "sun", "", "  ", "w" * 70, *[f"x{i}" for i in range(20)]]
    told = spark.createDataFrame([(words,)], "t array<string>").select(capabilities.vocabulary_candidates(F.col("t")).alias("v")).first()["v"]
    assert told == ["sun", "w" * 60, *[f"x{i}" for i in range(10)]]
