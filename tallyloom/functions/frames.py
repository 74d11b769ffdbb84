"""Picture kernels: luma, area-average resampling, difference hashes, blank frames and contact sheets, on Arrow batches of raw pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
COLUMNS, ROWS, BLANK_VARIANCE = 9, 8, 0.5
LUMA = (0.299, 0.587, 0.114)
#: Fixed value: the longest edge of a sheet.
SHEET_CAP = 1024


def area_means(plane: np.ndarray, columns: int, rows: int) -> np.ndarray:
    """Means over equal parts of a plane; a pixel on a border counts for each side by its part."""

    def weights(size: int, parts: int) -> np.ndarray:
        edges = np.linspace(0, size, parts + 1)
        low, high = np.maximum(edges[:-1, None], np.arange(size)), np.minimum(edges[1:, None], np.arange(size) + 1)
        return np.clip(high - low, 0, None) * parts / size

    return weights(plane.shape[0], rows) @ plane @ weights(plane.shape[1], columns).T


def frame_hash(pixels: bytes, width: int, height: int) -> tuple[str, float]:
    """The difference hash of RGB pixels as 16 hex digits, and the variance of the small picture."""
    rgb = np.frombuffer(pixels, np.uint8).reshape(height, width, 3)
    small = area_means(rgb @ np.array(LUMA), COLUMNS, ROWS)
    bits = (small[:, :-1] > small[:, 1:]).ravel()
    return np.packbits(bits).tobytes().hex(), float(small.var())


def hashed(frames: DataFrame) -> DataFrame:
    """``frames`` (pixels, width, height, ...) with ``hash`` and ``blank``, without their pixels."""

    @F.pandas_udf("struct<hash:string,variance:double>")
    def kernel(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
        rows = [frame_hash(p, int(w), int(h)) for p, w, h in zip(pixels, width, height, strict=True)]
        return pd.DataFrame(rows, columns=["hash", "variance"])

    found = frames.withColumn("_frame", kernel("pixels", "width", "height"))
    kept = [c for c in frames.columns if c != "pixels"]
    return found.select(*kept, F.col("_frame.hash").alias("hash"), (F.col("_frame.variance") < BLANK_VARIANCE).alias("blank"))


def scaled(pixels: bytes, width: int, height: int, columns: int, rows: int) -> bytes:
    """RGB pixels as a picture of ``columns`` by ``rows``: means over whole pixels, one at least for each; black where there is no picture."""
    if min(width, height) <= 0:
        return bytes(columns * rows * 3)
    sums = np.zeros((height + 1, width + 1, 3), np.int64)
    sums[1:, 1:] = np.frombuffer(pixels, np.uint8).reshape(height, width, 3).cumsum(axis=0, dtype=np.int64).cumsum(axis=1)

    def spans(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        edges = np.arange(parts + 1) * size // parts
        return edges[:-1], np.maximum(edges[:-1] + 1, edges[1:])

    (top, bottom), (left, right) = spans(height, rows), spans(width, columns)
    boxes = sums[bottom][:, right] - sums[bottom][:, left] - sums[top][:, right] + sums[top][:, left]
    count = ((bottom - top)[:, None] * (right - left))[..., None]
    return ((2 * boxes + count) // (2 * count)).astype(np.uint8).tobytes()


def tile_size(width: Column, height: Column, frames: Column, long_edge: Column | int, cap: int = SHEET_CAP) -> Column:
    """(width, height) of each tile of a sheet: the first frame's shape, smaller where the strip would be longer than ``cap``."""
    edge = long_edge if isinstance(long_edge, Column) else F.lit(long_edge)
    aspect = width / height
    wide = F.when(aspect >= 1, edge).otherwise(F.greatest(F.lit(1), F.floor(edge * aspect + 0.5)))
    high = F.when(aspect >= 1, F.greatest(F.lit(1), F.floor(edge / aspect + 0.5))).otherwise(edge)
    strip = F.greatest(wide * frames, high)
    fit = lambda x: F.when(strip > cap, F.greatest(F.lit(1), F.floor(x * (F.lit(cap) / strip)))).otherwise(x).cast("int")
    return F.struct(fit(wide).alias("width"), fit(high).alias("height"))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c) for c in ("pixels", "width", "height", "tile_width", "tile_height")), strict=True)
        made = [scaled(p.as_py(), w.as_py() or 0, h.as_py() or 0, tw.as_py(), th.as_py()) for p, w, h, tw, th in rows]  # one frame at a time
        kept = ["asset_id", "place", "frames", "tile_width", "tile_height"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(made, pa.binary())], [*kept, "tile"])


def _strip(tiles: pa.Table) -> pa.Table:
    tiles = tiles.sort_by("place")
    wide, high, n = (tiles[c][0].as_py() for c in ("tile_width", "tile_height", "frames"))
    sheet = np.zeros((high, wide * n, 3), np.uint8)
    for i, tile in enumerate(tiles["tile"]):
        sheet[:, i * wide : (i + 1) * wide] = np.frombuffer(tile.as_py(), np.uint8).reshape(high, wide, 3)
    row = {"asset_id": tiles["asset_id"][0].as_py(), "frames": n, "width": wide * n, "height": high, "tile_width": wide, "tile_height": high, "pixels": sheet.tobytes()}
    return pa.Table.from_pylist([row], pa.schema([("asset_id", tiles.schema.field("asset_id").type), *((c, pa.int32()) for c in ("frames", "width", "height", "tile_width", "tile_height")), ("pixels", pa.binary())]))


def sheets(frames: DataFrame, long_edge: int, cap: int = SHEET_CAP) -> DataFrame:
    """(asset_id, frames, width, height, tile_width, tile_height, pixels): each asset's frames side by side, alike in size, in order of ``position``.

    ``frames``: asset_id, position, width, height, pixels (RGB).  Frames are scaled where they lie, and only tiles,
    a strip of ``cap`` pixels together, meet.  An asset whose first frame has no size has no sheet; other frames without one are black.
    """
    kind = dict(frames.dtypes)["asset_id"]
    first = frames.groupBy("asset_id").agg(F.min_by(F.struct("width", "height"), "position").alias("first"), F.count("*").cast("int").alias("frames"))
    sized = first.filter("first.width > 0 AND first.height > 0").withColumn("t", tile_size(F.col("first.width"), F.col("first.height"), F.col("frames"), long_edge, cap))
    place = F.row_number().over(Window.partitionBy("asset_id").orderBy("position"))
    placed = frames.select("asset_id", "position", "width", "height", "pixels").withColumn("place", place)
    joined = placed.join(sized.select("asset_id", "frames", F.col("t.width").alias("tile_width"), F.col("t.height").alias("tile_height")), "asset_id")
    tiles = joined.drop("position").mapInArrow(_tiles, f"asset_id {kind}, place int, frames int, tile_width int, tile_height int, tile binary")
    return tiles.groupBy("asset_id").applyInArrow(_strip, f"asset_id {kind}, frames int, width int, height int, tile_width int, tile_height int, pixels binary")
