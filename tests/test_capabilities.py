import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import canonical, frames
from tallyloom.operators import capabilities as cap
from tallyloom.sources import generator, media

TAXONOMY = {"hands": "subject", "oil": "subject", "sauna": "room", "closeup": "shot_type", "warm_light": "light"}


def parsed(spark, text, branches=()):
    return cap.parse_queries(spark.createDataFrame([(1, text)], "query_id long, text string"), TAXONOMY, branches).first()


def test_longer_phrases_are_taken_first(spark):
    row = parsed(spark, "Golden hour close-up of hands, moody light under 12 seconds")
    assert [(m["raw"], m["term"]) for m in row["mappings"]] == [("golden hour", "warm_light"), ("close up", "closeup"), ("moody", "moody"), ("hands", "hands"), ("max", "max 12s")]
    assert (row["unmapped"], row["duration"]["max_s"], row["duration"]["min_s"]) == (["light"], 12, None)
    assert row["boost_terms"] == ["hands", "closeup", "warm_light", "moody"]


def test_branches_and_stopwords(spark):
    row = parsed(spark, "show me clips from san jose and los gatos 42", ("branch-san-jose", "branch-los-gatos"))
    assert list(row["filters"]["branch"]) == ["branch-san-jose"]
    assert row["unmapped"] == ["los", "gatos"]


def test_nothing_to_map(spark):
    row = parsed(spark, "liminal")
    assert (row["mappings"], row["unmapped"], row["filters"]["room"]) == ([], ["liminal"], [])


def test_vetting_checks(spark):
    schema = "score int, band string, reasons array<struct<cited_field:string>>, risk_flags array<struct<evidence_quote:string>>, suggested_tier string, reliability string"
    rows = [
        (98, "strong", [("bio",), ("none",)], [("said so",), (None,), (" ",)], "vip_full", "proven"),
        (70, "insufficient_evidence", [("bio",)], [], "half_day", "new"),
        (98, "strong", [("bio",), ("reach",)], [], None, "trusted"),
    ]
    found = cap.checked_vet(spark.createDataFrame(rows, schema)).collect()
    assert [(r["score"], r["band"], len(r["risk_flags"]), r["suggested_tier"]) for r in found] == [(None, "insufficient_evidence", 1, None), (None, "insufficient_evidence", 0, "half_day"), (98, "strong", 0, None)]
    assert found[0]["notes"] == ["boundary_score_thin_evidence", "unevidenced_risk_flag_dropped", "tier_outside_band"]
    assert found[1]["notes"] == ["score_without_band"]


def test_templates(spark):
    with pytest.raises(ValueError):
        cap.filled("{{a}} {{b}}", {"a": F.lit(1)})
    assert spark.range(1).select(cap.filled("{{a}}, {{b}}!", {"a": F.lit(1), "b": F.lit(None)})).first()[0] == "1, not provided!"


def test_tags_outside_the_taxonomy_go(spark):
    schema = "asset_id string, run_id string, provider string, description string, tags array<struct<term:string,confidence:double>>, light_quality string, framing string, review_flags array<string>"
    runs = spark.createDataFrame([("a", "r1", "mock", "d", [("oil", 0.9), ("odd", 0.9)], "good", "poor", ["face"]), ("a", "r2", "live", "d", [], None, "usable", [])], schema)
    fields, tags = cap.tagged(runs, F.array(F.lit("oil")))
    assert [(r["term"], r["ai_run_id"]) for r in tags.collect()] == [("oil", "r1")]
    first = fields.first()
    assert (first["ai_quality_score"], first["ai_framing_score"], first["ai_brand_safety"], first["ai_terms"]) == (0.8, 0.3, "review", ["oil"])
    assert cap.provenance_of(runs).first()["ai_provenance"] == "mixed"


def test_briefs_are_cut_and_numbered_anew(spark):
    items = spark.createDataFrame([("b", i * 3, i % 2) for i in range(30)], "brief_id string, position int, gap_index int")
    gaps = spark.createDataFrame([("b", 0, "g0")], "brief_id string, gap_index int, gap_id string")
    found = cap.brief(items, gaps).orderBy("seq").collect()
    assert [r["seq"] for r in found] == list(range(1, 25))
    assert [r["origin_gap_id"] for r in found[:2]] == ["g0", None]


def test_the_model_fills_only_what_the_lookup_left(spark):
    floor = spark.createDataFrame([(1, 0, "hands", "hands", "subject"), (1, 1, "glow", None, None)], "query_id long, position int, raw string, term string, kind string")
    model = spark.createDataFrame([(1, "glow", "warm_light", "light", 0.9), (1, "hands", "oil", "subject", 0.9), (1, "glow", "hands", "subject", 0.9), (1, "glow", "moody", "vibe", 0.2)], "query_id long, raw string, term string, kind string, confidence double")
    assert {(r["term"], r["source"]) for r in cap.parse_merged(floor, model).collect()} == {("hands", "lookup"), ("warm_light", "model")}


def jpeg(w, h):
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", 8) + b"Exif\0\0" + b"\xff\xc2" + struct.pack(">HBHHB", 9, 8, h, w, 1) + b"\0" * 9


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h)


def box(name, payload):
    return struct.pack(">I4s", 8 + len(payload), name) + payload


def clip():
    matrix = struct.pack(">9i", 0, 1 << 16, 0, -(1 << 16), 0, 0, 0, 0, 1 << 30)
    tkhd = box(b"tkhd", b"\0" * 40 + matrix + b"\0" * 8)
    entry = struct.pack(">I4s", 86, b"hvc1") + b"\0" * 24 + struct.pack(">HH", 1920, 1080) + b"\0" * 50
    mdia = box(b"mdia", box(b"hdlr", b"\0" * 8 + b"vide" + b"\0" * 12) + box(b"minf", box(b"stbl", box(b"stsd", b"\0" * 4 + struct.pack(">I", 1) + entry))))
    sound = box(b"trak", box(b"mdia", box(b"hdlr", b"\0" * 8 + b"soun" + b"\0" * 12)))
    place = b"+37.3382-121.8863/"
    udta = box(b"udta", box(b"\xa9xyz", struct.pack(">HH", len(place), 0) + place))
    mvhd = box(b"mvhd", b"\0" * 4 + struct.pack(">IIII", media.EPOCH_1904_S + 5, 0, 600, 3000))
    return box(b"ftyp", b"qt  ") + box(b"moov", mvhd + box(b"trak", tkhd + mdia) + sound + udta) + box(b"mdat", b"x" * 50)


def test_pictures():
    size = lambda data: (media.still_facts(data)["width"], media.still_facts(data)["height"])
    assert size(jpeg(640, 480)) == (640, 480) and media.still_facts(jpeg(1, 1))["exif"]
    assert size(png(3, 70000)) == (3, 70000)
    assert size(b"GIF89a" + struct.pack("<HH", 10, 20) + b"\0\0") == (10, 20)
    assert size(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")) == (100, 50)
    assert size(b"RIFF\0\0\0\0WEBPVP8L" + b"\0" * 4 + b"\x2f" + struct.pack("<I", (7 << 14) | 3)) == (4, 8)
    assert [media.still_facts(d)["reason"] for d in (b"", b"hello, this is text", b"\0\0\0\x18ftypheic\0\0", jpeg(5, 5)[:16], png(0, 5))] == ["empty_file", "not_a_still", "no_heif_parser", "truncated", "dimensions_not_declared"]


def test_clips_from_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in {"a.mov": clip(), "b.JPG": jpeg(8, 6), "c.txt": b"x", "d.mp4": clip()[:40], "e.png": b"x"}.items():
        (tmp_path / "in" / name).write_bytes(data)
    found = {r["path"][-5:]: r for r in media.with_facts(media.files(spark, str(tmp_path))).collect()}
    assert set(found) == {"a.mov", "b.JPG", "d.mp4", "e.png"}
    c = found["a.mov"]["clip"]
    assert (c["ok"], c["duration_s"], c["created_s"], c["coded_width"], c["coded_height"], c["rotation_deg"], c["codec"], c["has_audio"], c["location"]) == (True, 5.0, 5, 1920, 1080, 90, "hvc1", True, "+37.3382-121.8863/")
    assert (found["b.JPG"]["still"]["width"], found["b.JPG"]["clip"]["reason"]) == (8, "not_isobmff")
    assert not found["d.mp4"]["clip"]["ok"]
    assert found["e.png"]["still"]["reason"] == "not_a_still"


def test_frame_hashes(spark):
    falling = np.repeat(np.linspace(255, 0, 90).astype(np.uint8)[None, :, None], 80, 0).repeat(3, 2)
    rows = [(1, falling.tobytes(), 90, 80), (2, bytes([7]) * 90 * 80 * 3, 90, 80)]
    found = frames.hashed(spark.createDataFrame(rows, "id long, pixels binary, width int, height int")).orderBy("id").collect()
    assert [(r["hash"], r["blank"]) for r in found] == [("f" * 16, False), ("0" * 16, True)]
    plane = np.arange(12.0).reshape(3, 4)
    assert np.allclose(frames.area_means(plane, 2, 1), [[plane[:, :2].mean(), plane[:, 2:].mean()]])
    assert np.isclose(frames.area_means(plane, 3, 2).mean(), plane.mean())


def test_canonical_json(spark):
    texts = ['{"b": 1.0, "a": [true, null, -0.0, 1e21, 1e-7, 0.1, 123456.75], "é": "x\\u0001"}', "nope", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(canonical.canonical_json("t").alias("c")).collect()
    assert [r["c"] for r in rows] == ['{"a":[true,null,0,1e+21,1e-7,0.1,123456.75],"b":1,"é":"x\\u0001"}', None, None]
    assert [canonical._number(x) for x in (5e-324, 1.5e300, 0.000001, 12.5, -0.25)] == ["5e-324", "1.5e+300", "0.000001", "12.5", "-0.25"]


def test_identifiers_sort_by_time(spark):
    ids = [r[0] for r in spark.range(5).select(canonical.uuid7(F.col("id") + 1_700_000_000_000, F.col("id"), "id")).collect()]
    assert ids == sorted(ids) and all(i[14] == "7" and i[19] in "89ab" and len(i) == 36 for i in ids)


def test_invented_records_are_the_same_each_time(spark):
    once, again = (generator.assets(spark, 200, seed=3).repartition(n).orderBy("id").collect() for n in (1, 5))
    assert once == again
    assert generator.searches(spark, 200).filter("result_count = 0").count() > 10
