"""Clips' headers by ranged reads: a data source that deals out files and seeks within them.

``spark.read.format("footage_containers").load(folder)`` gives a row of facts for each file, and with
``.option("rows", "samples")`` a row for each sample of its first video track.  A reader hops from one
outer box to the next by their headers and reads the movie box alone, wherever it stands, so a
clip of any length costs a few reads; ``maxBytes`` and ``maxBoxes`` bound what one file may take.

Files are listed on the driver, their names only, as Spark's own sources do; FILES of them make a
partition.  Paths are those that ``pyarrow.fs`` opens: local, HDFS, S3, GCS.

Defined results: a file that can't be understood is a row with ``ok`` false and a ``reason``, and has
no samples; fields that a file doesn't state are null; fragmented files have facts and no samples; a table
that states more than MOST_SAMPLES samples is refused like one that is torn.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tallyloom.functions.scalars import iso6709
from tallyloom.sources.media import EPOCH_1904_S, FIRST_BOXES, boxes, turned

#: What may be read of one file.
MOST_BYTES, MOST_BOXES = 2 * 1024 * 1024, 512
#: More outer boxes, and more boxes that hold boxes.
OUTER = (*FIRST_BOXES, b"styp", b"moof", b"mfra", b"junk", b"pict", b"sidx", b"ssix")
INNER = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta", b"edts", b"dinf", b"tapt", b"gmhd", b"mvex", b"ilst", b"wave")
CONFIGS = (b"avcC", b"hvcC", b"vpcC", b"av1C")
CREATED, PLACE = "com.apple.quicktime.creationdate", "com.apple.quicktime.location.ISO6709"

FILES, MOST_SAMPLES = 64, 1 << 24

FACTS = (
    "path string, length long, ok boolean, reason string, brand string, container string, types array<string>, moov_position string, boxes int, bytes_read long, "
    "duration_s double, created_s long, video_tracks int, coded_width int, coded_height int, rotation_deg int, codec string, config binary, timescale long, track_s double, "
    "has_audio boolean, audio_codec string, day string, apple_created string, xyz string, apple_location string, loci struct<lat:double,lng:double,alt_m:double>"
)
SAMPLES = "path string, sample int, offset long, size long, dts_ms double, cts_ms double, sync boolean"


class Refused(Exception):
    """Why a file has no facts."""


@dataclass
class Ranged:
    """A file that counts what is read of it."""

    file: pa.NativeFile
    size: int
    most_bytes: int
    most_boxes: int
    bytes_read: int = 0
    boxes: int = 0

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at, self.most_bytes - self.bytes_read))
        self.file.seek(at)
        data = self.file.read(n)
        self.bytes_read += len(data)
        return data

    def outer(self) -> Iterator[tuple[bytes, int, int, int]]:
        """(name, start, payload start, end) of the outer boxes, as far as they are whole and within the budget."""
        at = 0
        while at + 8 <= self.size and self.boxes < self.most_boxes:
            head = self.read(at, 16)
            if len(head) < 8:
                return
            self.boxes += 1
            size, name = struct.unpack_from(">I4s", head)
            body = 8
            if size == 1:
                if len(head) < 16:
                    return
                (size,), body = struct.unpack_from(">Q", head, 8), 16
            elif size == 0:
                size = self.size - at
            if size < body:
                return
            yield name, at, at + body, min(at + size, self.size)
            at += size


@dataclass
class Movie:
    """The movie box of a file and what was seen before it."""

    data: bytes
    facts: dict
    #: Sample tables of the first video track: payloads by box name.
    tables: dict[bytes, bytes] = field(default_factory=dict)


def _text(data: bytes) -> str:
    """A QuickTime text: two bytes of length, two of language."""
    if len(data) <= 4:
        return ""
    (size,) = struct.unpack_from(">H", data)
    size = size if 0 < size <= len(data) - 4 else len(data) - 4
    return data[4 : 4 + size].decode("utf-8", "replace").rstrip("\0").strip()


def _loci(data: bytes) -> dict | None:
    """The 3GPP place: longitude first, numbers of 16.16 bits behind a name."""
    end = data.find(b"\0", 6)
    if end < 0 or end + 14 > len(data):
        return None
    lng, lat, alt = (x / 65536 for x in struct.unpack_from(">3i", data, end + 2))
    there = abs(lat) <= 90 and abs(lng) <= 180 and (lat, lng) != (0, 0)
    return {"lat": round(lat, 6), "lng": round(lng, 6), "alt_m": round(alt, 3)} if there else None


def _apple(data: bytes, at: int, end: int) -> dict[str, str]:
    """Key and value pairs of a ``meta`` box; its children begin four bytes later where it states a version."""
    start = at if data[at + 4 : at + 8] in (b"hdlr", b"keys", b"ilst", b"mdta") else at + 4
    keys, values = [], {}
    held = {path[0]: (a, b) for path, a, b in boxes(data, start, end) if len(path) == 1}
    if b"keys" not in held or b"ilst" not in held:
        return {}
    keys = [data[a:b].decode("utf-8", "replace") for path, a, b in boxes(data, held[b"keys"][0] + 8, held[b"keys"][1])]
    for path, a, b in boxes(data, *held[b"ilst"]):
        number = int.from_bytes(path[0], "big")
        if 0 < number <= len(keys):
            for inner, c, d in boxes(data, a, b):
                if inner == (b"data",):
                    values[keys[number - 1]] = data[c + 8 : d].decode("utf-8", "replace").rstrip("\0").strip()
    return values


def _described(movie: Movie, ranged: Ranged) -> None:
    """Fills the facts from the boxes of the movie."""
    out, data, track = movie.facts, movie.data, {}
    for path, at, end in boxes(data, parents=INNER):
        ranged.boxes += 1
        if ranged.boxes > ranged.most_boxes:
            return
        name, wide = path[-1], at < end and data[at] == 1
        if name == b"mvhd":
            created, _, scale, length = struct.unpack_from(">QQIQ" if wide else ">IIII", data, at + 4)
            out["created_s"] = created - EPOCH_1904_S if created else None
            out["duration_s"] = round(length / scale, 6) if scale else None
        elif name == b"trak":
            track = {}
        elif name == b"tkhd":
            track["turned"] = turned(struct.unpack_from(">9i", data, at + (52 if wide else 40)))
        elif name == b"mdhd":
            _, _, track["scale"], track["length"] = struct.unpack_from(">QQIQ" if wide else ">IIII", data, at + 4)
        elif name == b"hdlr" and path[-2] == b"mdia":
            track["kind"] = data[at + 8 : at + 12]
            out["has_audio"] |= track["kind"] == b"soun"
            out["video_tracks"] += track["kind"] == b"vide"
            track["first"] = track["kind"] == b"vide" and out["video_tracks"] == 1
        elif name == b"stsd" and track.get("kind") == b"soun" and out["audio_codec"] is None:
            out["audio_codec"] = data[at + 12 : at + 16].decode("latin-1")
        elif name == b"stsd" and track.get("first"):
            scale = track.get("scale") or None
            out |= {"codec": data[at + 12 : at + 16].decode("latin-1"), "rotation_deg": track.get("turned"), "timescale": scale, "track_s": round(track["length"] / scale, 6) if scale else None}
            out["coded_width"], out["coded_height"] = struct.unpack_from(">HH", data, at + 40)
            out["config"] = next((data[a:b] for p, a, b in boxes(data, at + 94, end, parents=()) if p[0] in CONFIGS), None)
        elif track.get("first") and name in (b"stts", b"stsc", b"stsz", b"stco", b"co64", b"stss", b"ctts"):
            movie.tables[name] = data[at + 4 : end]
        elif name in (b"\xa9day", b"\xa9xyz"):
            out["day" if name == b"\xa9day" else "xyz"] = _text(data[at:end]) or None
        elif name == b"loci":
            out["loci"] = _loci(data[at:end])
        elif name == b"meta":
            told = _apple(data, at, end)
            out["apple_created"], out["apple_location"] = told.get(CREATED, out["apple_created"]), told.get(PLACE, out["apple_location"])


def movie_of(ranged: Ranged) -> Movie:
    """The facts of one file; ``ok`` is false, with a reason, where it can't be understood."""
    columns = [f.split(" ")[0] for f in FACTS.split(", ")]
    out = dict.fromkeys(columns) | {"ok": False, "types": [], "has_audio": False, "video_tracks": 0}
    movie = Movie(b"", out)
    try:
        if not ranged.size:
            raise Refused("empty_file")
        moov = mdat = None
        for name, start, body, end in ranged.outer():
            if not out["types"] and name not in OUTER:
                raise Refused("not_isobmff")
            out["types"].append(name.decode("latin-1"))
            if name == b"ftyp" and out["brand"] is None:
                out["brand"] = ranged.read(body, 4).decode("latin-1")
                out["container"] = "mov" if out["brand"].startswith("qt") else "mp4"
            elif name == b"moov" and moov is None:
                moov = (start, end)
            elif name == b"mdat" and mdat is None:
                mdat = start
        if not out["types"]:
            raise Refused("not_isobmff")
        if moov is None:
            raise Refused("moov_not_found")
        out["moov_position"] = "start" if mdat is None or moov[0] < mdat else "end"
        movie.data = ranged.read(moov[0], moov[1] - moov[0])
        _described(movie, ranged)
        if not out["video_tracks"] and out["duration_s"] is None and out["created_s"] is None:
            raise Refused("metadata_unparseable")
        out["ok"] = True
    except Refused as why:
        out["reason"] = str(why)
    except (struct.error, IndexError):
        out["reason"] = "metadata_unparseable"
    out["boxes"], out["bytes_read"] = min(ranged.boxes, ranged.most_boxes), ranged.bytes_read
    return movie


def _runs(table: bytes, n: int, signed: bool = False) -> np.ndarray:
    """A value for each of ``n`` samples from pairs of count and value; the last one goes on."""
    (rows,) = struct.unpack_from(">I", table)
    pairs = np.frombuffer(table, ">u4", min(rows, (len(table) - 4) // 8) * 2, 4).reshape(-1, 2)
    if not len(pairs):
        return np.zeros(n, np.int64)
    values = pairs[:, 1].astype(np.uint32).view(np.int32 if signed else np.uint32).astype(np.int64)
    ends = np.cumsum(pairs[:, 0].astype(np.int64))
    return values[np.minimum(np.searchsorted(ends, np.arange(n), "right"), len(values) - 1)]


def samples_of(movie: Movie) -> dict[str, np.ndarray] | None:
    """Place, size and times of each sample of the first video track; None where its tables are missing."""
    t, scale = movie.tables, movie.facts["timescale"]
    places = t.get(b"stco") or t.get(b"co64")
    if not scale or places is None or not {b"stts", b"stsc", b"stsz"} <= set(t):
        return None
    kind, width = (">u4", 4) if b"stco" in t else (">u8", 8)
    (chunks,) = struct.unpack_from(">I", places)
    starts = np.frombuffer(places, kind, min(chunks, (len(places) - 4) // width), 4).astype(np.int64)
    (rows,) = struct.unpack_from(">I", t[b"stsc"])
    dealt = np.frombuffer(t[b"stsc"], ">u4", min(rows, (len(t[b"stsc"]) - 4) // 12) * 3, 4).reshape(-1, 3).astype(np.int64)
    at = np.searchsorted(dealt[:, 0], np.arange(1, len(starts) + 1), "right") - 1
    each = np.where(at >= 0, dealt[np.maximum(at, 0), 1], 0) if len(dealt) else np.zeros(len(starts), np.int64)
    uniform, stated = struct.unpack_from(">II", t[b"stsz"])
    n = min(stated if uniform else min(stated, (len(t[b"stsz"]) - 8) // 4), int(each.sum()))
    if n > MOST_SAMPLES:
        raise Refused("too_many_samples")
    size = np.full(n, uniform, np.int64) if uniform else np.frombuffer(t[b"stsz"], ">u4", n, 8).astype(np.int64)
    before = np.cumsum(each)
    chunk = np.searchsorted(before, np.arange(n), "right")
    passed = np.cumsum(size) - size
    first = np.minimum((before - each)[chunk], max(n - 1, 0))
    delta = _runs(t[b"stts"], n)
    time = np.cumsum(delta) - delta
    shift = _runs(t[b"ctts"], n, signed=True) if b"ctts" in t else np.zeros(n, np.int64)
    sync = np.ones(n, bool)
    if b"stss" in t:
        (held,) = struct.unpack_from(">I", t[b"stss"])
        keys = np.frombuffer(t[b"stss"], ">u4", min(held, (len(t[b"stss"]) - 4) // 4), 4).astype(np.int64) - 1
        sync[:] = False
        sync[keys[(keys >= 0) & (keys < n)]] = True
    return {
        "sample": np.arange(n, dtype=np.int32), "offset": starts[chunk] + passed - passed[first], "size": size,
        "dts_ms": time / scale * 1000, "cts_ms": (time + shift) / scale * 1000, "sync": sync,
    }


@dataclass
class Some(InputPartition):
    files: list[tuple[str, int]]


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        given = {k.lower(): v for k, v in options.items()}
        self.folder, self.samples = given["path"], given.get("rows") == "samples"
        self.most = int(given.get("maxbytes", MOST_BYTES)), int(given.get("maxboxes", MOST_BOXES))

    def _opened(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.folder) if "://" in self.folder else (pafs.LocalFileSystem(), self.folder.removeprefix("file:"))

    def partitions(self) -> list[InputPartition]:
        files, root = self._opened()
        info = files.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(root, recursive=True))
        named = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))
        return [Some(named[i : i + FILES]) for i in range(0, len(named), FILES)] or [Some([])]

    def read(self, partition: Some) -> Iterator[pa.RecordBatch]:
        files, _ = self._opened()
        for path, size in partition.files:
            with files.open_input_file(path) as file:
                movie = movie_of(Ranged(file, size, *self.most))
            if not self.samples:
                yield pa.RecordBatch.from_pylist([movie.facts | {"path": path, "length": size}], _ARROW)
                continue
            try:
                found = samples_of(movie) if movie.facts["ok"] else None
            except (Refused, struct.error):
                found = None
            for at in range(0, len(found["sample"]) if found else 0, 1 << 16):
                some = {k: pa.array(v[at : at + (1 << 16)]) for k, v in found.items()}
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(some["sample"]))} | some)


_ARROW = pa.schema([
    ("path", pa.string()), ("length", pa.int64()), ("ok", pa.bool_()), ("reason", pa.string()), ("brand", pa.string()), ("container", pa.string()), ("types", pa.list_(pa.string())), ("moov_position", pa.string()),
    ("boxes", pa.int32()), ("bytes_read", pa.int64()), ("duration_s", pa.float64()), ("created_s", pa.int64()), ("video_tracks", pa.int32()), ("coded_width", pa.int32()), ("coded_height", pa.int32()),
    ("rotation_deg", pa.int32()), ("codec", pa.string()), ("config", pa.binary()), ("timescale", pa.int64()), ("track_s", pa.float64()), ("has_audio", pa.bool_()), ("audio_codec", pa.string()), ("day", pa.string()),
    ("apple_created", pa.string()), ("xyz", pa.string()), ("apple_location", pa.string()), ("loci", pa.struct([("lat", pa.float64()), ("lng", pa.float64()), ("alt_m", pa.float64())])),
])


class ContainerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "footage_containers"

    def schema(self) -> str:
        return SAMPLES if self.options.get("rows") == "samples" else FACTS

    def reader(self, schema: StructType) -> ContainerReader:
        return ContainerReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ContainerSource)


def place() -> Column:
    """(lat, lng, alt_m) of a row of facts: Apple's own place before the QuickTime text before the 3GPP box."""
    return F.coalesce(iso6709(F.col("apple_location")), iso6709(F.col("xyz")), F.col("loci"))


def codec_string(fourcc: Column, config: Column) -> Column:
    """The RFC 6381 name of a codec from its configuration record (binary); null without one, and for codecs that have none."""

    def byte(n: int) -> Column:
        return F.conv(F.hex(F.substring(config, n + 1, 1)), 16, 10).cast("int")

    def bits(n: int, shift: int, count: int) -> Column:
        return F.shiftright(byte(n), shift).bitwiseAND(F.lit((1 << count) - 1))

    size = F.octet_length(config)
    avc = F.concat(fourcc, F.lit("."), F.hex(F.substring(config, 2, 3)))
    space = F.when(bits(1, 6, 2) == 0, "").otherwise(F.chr(64 + bits(1, 6, 2)))
    flags = F.conv(F.reverse(F.lpad(F.conv(F.hex(F.substring(config, 3, 4)), 16, 2), 32, "0")), 2, 16)
    tier = F.when(bits(1, 5, 1) == 0, "L").otherwise("H")
    constraints = F.array_join(F.transform(F.sequence(F.lit(7), F.lit(12)), lambda i: F.conv(F.hex(F.substr(config, i, F.lit(1))), 16, 16)), ".")
    trimmed = F.regexp_replace(F.concat(F.lit("."), F.lower(constraints)), r"(\.0)+$", "")
    hevc = F.concat(fourcc, F.lit("."), space, bits(1, 0, 5), F.lit("."), F.lower(flags), F.lit("."), tier, byte(12), trimmed)
    depth = F.when((bits(1, 5, 3) == 2) & (bits(2, 5, 1) == 1), 12).when(bits(2, 6, 1) == 1, 10).otherwise(8)
    av1 = F.concat(fourcc, F.lit("."), bits(1, 5, 3), F.lit("."), F.lpad(bits(1, 0, 5).cast("string"), 2, "0"), F.when(bits(2, 7, 1) == 0, "M").otherwise("H"), F.lit("."), F.lpad(depth.cast("string"), 2, "0"))
    return F.when(fourcc.isin("avc1", "avc3") & (size >= 4), avc).when(fourcc.isin("hvc1", "hev1") & (size >= 13), hevc).when((fourcc == "av01") & (size >= 4), av1)
