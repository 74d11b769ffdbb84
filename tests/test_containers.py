"""Containers by ranged reads: facts, places, sample tables and budgets, on hand-made files."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import containers

IDENTITY, TURNED = (65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30), (0, 65536, 0, -65536, 0, 0, 0, 0, 1 << 30)


def box(name, *parts, wide=False):
    body = b"".join(parts)
    return (struct.pack(">I4sQ", 1, name, len(body) + 16) if wide else struct.pack(">I4s", len(body) + 8, name)) + body


def full(name, *parts, version=0):
    return box(name, bytes([version, 0, 0, 0]), *parts)


def u32(*values):
    return struct.pack(f">{len(values)}I", *values)


def table(name, *rows):
    return full(name, u32(len(rows)), *[u32(*(r if isinstance(r, tuple) else (r,))) for r in rows])


def track(kind, codec, *tables, matrix=IDENTITY, config=b"", scale=600, length=6000):
    entry = box(codec, bytes(6), u32(1)[2:], bytes(16), struct.pack(">HH", 1920, 1080), bytes(50), config) if kind == b"vide" else box(codec, bytes(28))
    stbl = box(b"stbl", full(b"stsd", u32(1), entry), *tables)
    tkhd = full(b"tkhd", u32(0, 0, 1, 0, length), bytes(16), struct.pack(">9i", *matrix), u32(1920 << 16, 1080 << 16))
    return box(b"trak", tkhd, box(b"mdia", full(b"mdhd", u32(5, 5, scale, length)), full(b"hdlr", bytes(4), kind, bytes(12)), box(b"minf", stbl)))


def said(name, text):
    return box(name, struct.pack(">HH", len(text), 0x55C4), text)


def apple(*pairs, plain=False):
    keys = full(b"keys", u32(len(pairs)), *[box(b"mdta", k) for k, _ in pairs])
    items = box(b"ilst", *[box(u32(i), box(b"data", u32(1, 0), v)) for i, (_, v) in enumerate(pairs, 1)])
    return box(b"meta", *([] if plain else [bytes(4)]), full(b"hdlr", bytes(4), b"mdta", bytes(12)), keys, items)


def movie(*parts, created=3_800_000_000, scale=1000, length=10_500):
    return box(b"moov", full(b"mvhd", u32(created, 0, scale, length), bytes(80)), *parts)


FTYP = box(b"ftyp", b"qt  ", u32(0))
AVCC = box(b"avcC", bytes([1, 0x64, 0, 0x28, 255, 225]))
TABLES = (table(b"stts", (3, 100), (2, 50)), table(b"stsc", (1, 2, 1), (2, 1, 1)), full(b"stsz", u32(0, 5), u32(10, 20, 30, 40, 50)), table(b"stco", 1000, 2000, 3000, 4000), table(b"stss", 1, 4), table(b"ctts", (1, 0), (9, 0xFFFFFFCE)))


@pytest.fixture(scope="module")
def read(spark):
    containers.register(spark)
    return lambda folder, **options: spark.read.format("footage_containers").options(**options).load(str(folder))


def test_facts_of_a_clip_whose_movie_stands_at_the_end(read, tmp_path):
    udta = box(b"udta", said(b"\xa9day", b"2024-05-01T10:00:00+0200"), said(b"\xa9xyz", b"+37.3349-122.0090+010.5/"))
    moov = movie(track(b"vide", b"avc1", *TABLES, matrix=TURNED, config=AVCC), track(b"soun", b"mp4a"), udta)
    (tmp_path / "a.mov").write_bytes(FTYP + box(b"mdat", bytes(5000), wide=True) + moov)
    r = read(tmp_path).withColumn("place", containers.place()).withColumn("name", containers.codec_string(F.col("codec"), F.col("config"))).first()
    assert (r["ok"], r["reason"], r["brand"], r["container"], r["types"], r["moov_position"]) == (True, None, "qt  ", "mov", ["ftyp", "mdat", "moov"], "end")
    assert (r["duration_s"], r["created_s"], r["coded_width"], r["coded_height"], r["rotation_deg"]) == (10.5, 3_800_000_000 - 2082844800, 1920, 1080, 90)
    assert (r["codec"], r["name"], r["timescale"], r["track_s"], r["video_tracks"], r["has_audio"], r["audio_codec"]) == ("avc1", "avc1.640028", 600, 10.0, 1, True, "mp4a")
    assert (r["day"], tuple(r["place"])) == ("2024-05-01T10:00:00+0200", (37.3349, -122.009, 10.5))
    assert r["bytes_read"] < 3 * 16 + 4 + len(moov) + 1


def test_a_clip_of_gigabytes_is_read_within_the_budget(read, tmp_path):
    moov = movie(track(b"vide", b"hvc1", *TABLES))
    with open(tmp_path / "long.mp4", "wb") as out:
        out.write(FTYP + struct.pack(">I4sQ", 1, b"mdat", 3_200_000_000))
        out.truncate(len(FTYP) + 3_200_000_000)
        out.seek(len(FTYP) + 3_200_000_000)
        out.write(moov)
    r = read(tmp_path).first()
    assert (r["ok"], r["length"], r["duration_s"], r["codec"]) == (True, len(FTYP) + 3_200_000_000 + len(moov), 10.5, "hvc1")
    assert r["bytes_read"] < 2 * 1024 * 1024
    assert read(tmp_path, rows="samples").count() == 5


def loop(sizes, chunks, stsc, stts, ctts, stss, scale):
    """Sample by sample, as a player walks the tables."""
    deltas = [d for n, d in stts for _ in range(n)]
    shifts = [d for n, d in ctts for _ in range(n)]
    out, time = [], 0
    for c, at in enumerate(chunks, 1):
        each = [n for first, n, _ in stsc if first <= c]
        for _ in range(each[-1] if each else 0):
            i = len(out)
            if i == len(sizes):
                return out
            shift = (shifts[i] if i < len(shifts) else shifts[-1]) if shifts else 0
            out.append((i, at, sizes[i], time / scale * 1000, (time + shift) / scale * 1000, stss is None or i + 1 in stss))
            at += sizes[i]
            time += deltas[i] if i < len(deltas) else deltas[-1]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_samples_equal_a_walk(read, tmp_path, seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 60)
    sizes = [rng.randrange(1, 99) for _ in range(n)] if seed % 3 else [17] * n
    stsc, chunk = [], 1
    for _ in range(rng.randrange(1, 4)):
        stsc.append((chunk, rng.randrange(1, 5), 1))
        chunk += rng.randrange(1, 6)
    chunks = sorted(rng.randrange(1 << 33 if seed % 2 else 1 << 30) for _ in range(rng.randrange(1, 30)))
    stts = [(rng.randrange(1, 20), rng.randrange(1, 90)) for _ in range(rng.randrange(1, 5))]
    ctts = [(rng.randrange(1, 20), rng.randrange(-50, 50)) for _ in range(rng.randrange(0, 4))]
    stss = sorted(rng.sample(range(1, n + 1), rng.randrange(1, n + 1))) if seed % 4 else None
    stsz = full(b"stsz", u32(0, n), u32(*sizes)) if seed % 3 else full(b"stsz", u32(17, n))
    places = full(b"co64", u32(len(chunks)), struct.pack(f">{len(chunks)}Q", *chunks)) if seed % 2 else table(b"stco", *chunks)
    more = [table(b"ctts", *[(k, d & 0xFFFFFFFF) for k, d in ctts])] * bool(ctts) + [table(b"stss", *(stss or []))] * (stss is not None)
    (tmp_path / "x.mp4").write_bytes(FTYP + movie(track(b"vide", b"avc1", table(b"stts", *stts), table(b"stsc", *stsc), stsz, places, *more)))
    got = [tuple(r)[1:] for r in read(tmp_path, rows="samples").orderBy("sample").collect()]
    assert got == loop(sizes, chunks, stsc, stts, ctts, stss, 600)


@pytest.mark.parametrize("plain", [False, True])
def test_places_and_apple_keys(read, tmp_path, plain):
    loci = full(b"loci", u32(0)[:2], b"name\0", b"\0", struct.pack(">3i", int(-122.5 * 65536), int(37.25 * 65536), 65536), b"earth\0")
    keys = apple((b"com.apple.quicktime.creationdate", b"2023-01-02T03:04:05-0800"), (b"com.apple.quicktime.location.ISO6709", b"+48.8584+002.2945+033.0/"), plain=plain)
    (tmp_path / "a.mov").write_bytes(FTYP + movie(box(b"udta", loci), created=0))
    (tmp_path / "b.mov").write_bytes(FTYP + movie(box(b"udta", loci, said(b"\xa9xyz", b"+10.0+020.0/"), keys)))
    a, b = read(tmp_path).withColumn("place", containers.place()).orderBy("path").collect()
    assert tuple(a["place"]) == (37.25, -122.5, 1.0) and a["created_s"] is None
    assert tuple(b["place"]) == (48.8584, 2.2945, 33.0) and b["apple_created"] == "2023-01-02T03:04:05-0800"


def test_files_that_are_no_clips(read, tmp_path):
    files = {
        "a": b"", "b": b"\xff\xd8\xff" + bytes(40), "c": FTYP + box(b"mdat", bytes(50)), "d": FTYP + box(b"moov"), "e": FTYP + movie()[:20],
        "f": FTYP + struct.pack(">I4s", 4, b"moov"), "g": b"\0\0", "h": box(b"free", b"") * 600 + movie(),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.mp4").write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1][0]: (r["ok"], r["reason"], r["boxes"]) for r in read(tmp_path).collect()}
    assert {k: v[1] for k, v in got.items()} == {
        "a": "empty_file", "b": "not_isobmff", "c": "moov_not_found", "d": "metadata_unparseable", "e": "metadata_unparseable", "f": "moov_not_found", "g": "not_isobmff", "h": "moov_not_found",
    }
    assert got["h"][2] == 512 and not any(v[0] for v in got.values())
    assert read(tmp_path, rows="samples").collect() == []
    (tmp_path / "none").mkdir()
    assert read(tmp_path / "none").collect() == []


def test_a_budget_stops_the_reading(read, tmp_path):
    (tmp_path / "a.mp4").write_bytes(FTYP + movie(track(b"vide", b"avc1", *TABLES), box(b"free", bytes(100_000))))
    assert [(r["ok"], r["bytes_read"]) for r in read(tmp_path, maxBytes="2000").collect()] == [(True, 2000)]
    assert read(tmp_path, maxBytes="50").first()["reason"] == "metadata_unparseable"


def test_codec_names(spark):
    hevc = lambda b1, flags, constraints, level: bytes([1, b1]) + struct.pack(">I", flags) + bytes(constraints) + bytes([level])
    cases = [
        ("avc1", bytes([1, 0x42, 0xE0, 0x1E]), "avc1.42E01E"), ("avc3", bytes([1, 0x64, 0x00, 0x0A, 9]), "avc3.64000A"), ("avc1", b"\1\2", None), ("avc1", None, None),
        ("hvc1", hevc(0x01, 0x60000000, [0x90, 0, 0, 0, 0, 0], 93), "hvc1.1.6.L93.90"), ("hev1", hevc(0x22, 0x20000000, [0xB0, 0, 0x23, 0, 0, 0], 153), "hev1.2.4.H153.b0.0.23"),
        ("hvc1", hevc(0x41, 0x80000001, [0] * 6, 60), "hvc1.A1.80000001.L60"), ("hvc1", bytes(12), None), ("av01", bytes([0x81, 0x08, 0x0C, 0]), "av01.0.08M.08"), ("av01", bytes([0x81, 0x4D, 0xEC, 0]), "av01.2.13H.12"), ("apcn", bytes(20), None),
    ]
    df = spark.createDataFrame([(i, f, c) for i, (f, c, _) in enumerate(cases)], "i int, fourcc string, config binary")
    assert [r["name"] for r in df.select("i", containers.codec_string(F.col("fourcc"), F.col("config")).alias("name")).orderBy("i").collect()] == [c[2] for c in cases]
