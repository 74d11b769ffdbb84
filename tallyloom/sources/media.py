"""Facts from the headers of pictures and clips: a small reader per format over a binary column.

Spark reads and deals out the files (``binaryFile``); per file a few headers are looked at,
never the samples.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Magic numbers (offset, bytes) by format, and brands of HEIF.
MAGIC = (("jpeg", 0, b"\xff\xd8\xff"), ("png", 0, b"\x89PNG\r\n\x1a\n"), ("gif", 0, b"GIF"), ("webp", 8, b"WEBP"))
HEIF_BRANDS = (b"heic", b"heix", b"heif", b"mif1", b"msf1")
#: Boxes at the start of a clip, and boxes that hold boxes.
FIRST_BOXES = (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"pnot", b"uuid", b"meta")
PARENTS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta")
#: Headers that are looked at in one file; and where a picture's header must end.
MOST_BOXES, HEAD = 512, 128 * 1024
EPOCH_1904_S = 2082844800

FILE_NAMES = r"(?i)\.(mp4|mov|m4v|jpe?g|png|gif|webp|heic|heif)$"

STILL = "struct<ok:boolean,reason:string,format:string,width:int,height:int,exif:boolean>"
CLIP = (
    "struct<ok:boolean,reason:string,brand:string,duration_s:double,created_s:bigint,coded_width:int,coded_height:int,"
    "rotation_deg:int,codec:string,has_audio:boolean,location:string,day:string,boxes:int>"
)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of all media files below a folder; Spark passes over empty files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.filter(F.col("path").rlike(FILE_NAMES)).select("path", "length", "content")


def still_format(data: bytes) -> str | None:
    for name, at, magic in MAGIC:
        if data[at : at + len(magic)] == magic:
            return name
    return "heif" if data[4:8] == b"ftyp" and data[8:12] in HEIF_BRANDS else None


def _jpeg_segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, payload) up to the scan."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF or data[at + 1] == 0xFF:
            at += 1
        elif data[at + 1] == 0x01 or 0xD0 <= data[at + 1] <= 0xD9:  # no payload
            at += 2
        else:
            (size,) = struct.unpack_from(">H", data, at + 2)
            if size < 2 or data[at + 1] == 0xDA:
                return
            yield data[at + 1], data[at + 4 : at + 2 + size]
            at += 2 + size


def _webp_size(data: bytes) -> tuple[int, int] | None:
    kind = data[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    if kind == b"VP8 ":
        w, h = struct.unpack_from("<HH", data, 26)
        return w & 0x3FFF, h & 0x3FFF
    if kind == b"VP8L":
        (bits,) = struct.unpack_from("<I", data, 21)
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    return None


def still_facts(content: bytes) -> dict:
    """Size as the header states it, or the reason why there is none."""
    out = {"ok": False, "reason": None, "format": None, "width": None, "height": None, "exif": False}
    data = content[:HEAD]
    if not data:
        return out | {"reason": "empty_file"}
    kind = still_format(data) if len(data) >= 12 else None
    if kind is None:
        return out | {"reason": "not_a_still"}
    out["format"] = kind
    if kind == "heif":
        return out | {"reason": "no_heif_parser"}
    size = None
    try:
        if kind == "png" and data[12:16] == b"IHDR":
            size = struct.unpack_from(">II", data, 16)
        elif kind == "gif":
            size = struct.unpack_from("<HH", data, 6)
        elif kind == "webp":
            size = _webp_size(data)
        elif kind == "jpeg":
            out["reason"] = "truncated"
            for marker, payload in _jpeg_segments(data):
                out["exif"] |= marker == 0xE1 and payload.startswith(b"Exif")
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack_from(">HH", payload, 1)
                    size, out["reason"] = (w, h), None
                    break
    except struct.error:
        return out | {"reason": "truncated"}
    if not size or not all(size):
        return out | {"reason": out["reason"] or "dimensions_not_declared"}
    return out | {"ok": True, "reason": None, "width": size[0], "height": size[1]}


def boxes(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = (), parents: tuple[bytes, ...] = PARENTS) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, payload start, payload end) of all boxes, parents before children."""
    at, end = start, len(data) if end is None else end
    while at + 8 <= end:
        size, name = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            (size,), head = struct.unpack_from(">Q", data, at + 8), 16
        elif size == 0:
            size = end - at
        if size < head:
            return
        stop = min(at + size, end)
        yield (*path, name), at + head, stop
        if name in parents:
            yield from boxes(data, at + head, stop, (*path, name), parents)
        at += size


def turned(matrix: tuple[int, ...]) -> int:
    a, b, c, d = matrix[0], matrix[1], matrix[3], matrix[4]
    signs = {(1, 0, 0, 1): 0, (0, 1, -1, 0): 90, (-1, 0, 0, -1): 180, (0, -1, 1, 0): 270}
    return signs.get(tuple((x > 0) - (x < 0) for x in (a, b, c, d)), 0)


def clip_facts(content: bytes) -> dict:
    """Duration, size, rotation, codec, times and place of a clip, as its boxes state them."""
    out = dict.fromkeys(("reason", "brand", "duration_s", "created_s", "coded_width", "coded_height", "rotation_deg", "codec", "location", "day")) | {"ok": False, "has_audio": False, "boxes": 0}
    if not content:
        return out | {"reason": "empty_file"}
    if content[4:8] not in FIRST_BOXES:
        return out | {"reason": "not_isobmff"}
    seen = False
    track: dict = {}
    try:
        for path, at, end in boxes(content):
            out["boxes"] += 1
            if out["boxes"] > MOST_BOXES:
                return out | {"reason": "too_many_boxes"}
            name = path[-1]
            wide = at < end and content[at] == 1
            if name == b"ftyp":
                out["brand"] = content[at : at + 4].decode("latin-1")
            elif name == b"mvhd":
                seen = True
                created, _, scale, length = struct.unpack_from(">QQIQ" if wide else ">IIII", content, at + 4)
                out["duration_s"] = length / scale if scale else None
                out["created_s"] = created - EPOCH_1904_S if created else None
            elif name == b"trak":
                track = {}
            elif name == b"tkhd":
                matrix = struct.unpack_from(">9i", content, at + (52 if wide else 40))
                track = {"rotation_deg": turned(matrix)}
            elif name == b"hdlr" and len(path) > 2:
                track["kind"] = content[at + 8 : at + 12]
                out["has_audio"] |= track["kind"] == b"soun"
            elif name == b"stsd" and track.get("kind") == b"vide" and out["codec"] is None:
                out["codec"] = content[at + 12 : at + 16].decode("latin-1")
                out["coded_width"], out["coded_height"] = struct.unpack_from(">HH", content, at + 40)
                out["rotation_deg"] = track.get("rotation_deg")
            elif name in (b"\xa9xyz", b"\xa9day"):
                (size,) = struct.unpack_from(">H", content, at)
                out["location" if name == b"\xa9xyz" else "day"] = content[at + 4 : at + 4 + size].decode("utf-8", "replace")
    except struct.error:
        return out | {"reason": "truncated"}
    return out | ({"ok": True} if seen else {"reason": "no_movie_header"})


def _facts(read, kind: str):
    @F.pandas_udf(kind)
    def facts(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(bytes(c) if c is not None else b"") for c in content], columns=[f.split(":")[0] for f in kind[7:-1].split(",")])

    return facts


def with_facts(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with ``still`` and ``clip``; the content itself is left out."""
    return df.withColumn("still", _facts(still_facts, STILL)(content)).withColumn("clip", _facts(clip_facts, CLIP)(content)).drop(content)
