"""Contact sheets: pixels equal a loop over them."""

import math
import random

from tallyloom.functions import frames


def looped(rows, edge, cap):
    """Pixel by pixel."""
    _, _, w, h, _ = rows[0]
    if w <= 0 or h <= 0:
        return None
    aspect, n = w / h, len(rows)
    tw = edge if aspect >= 1 else max(1, math.floor(edge * aspect + 0.5))
    th = max(1, math.floor(edge / aspect + 0.5)) if aspect >= 1 else edge
    if (strip := max(tw * n, th)) > cap:
        tw, th = max(1, math.floor(tw * (cap / strip))), max(1, math.floor(th * (cap / strip)))
    out = bytearray(tw * n * th * 3)
    for i, (_, _, w, h, data) in enumerate(rows):
        for y in range(th if w > 0 and h > 0 else 0):
            y0, y1 = y * h // th, max(y * h // th + 1, (y + 1) * h // th)
            for x in range(tw):
                x0, x1 = x * w // tw, max(x * w // tw + 1, (x + 1) * w // tw)
                for c in range(3):
                    box = [data[(b * w + a) * 3 + c] for b in range(y0, y1) for a in range(x0, x1)]
                    out[(y * tw * n + i * tw + x) * 3 + c] = math.floor(sum(box) / len(box) + 0.5)
    return n, tw * n, th, tw, th, bytes(out)


def test_sheets_equal_a_loop(spark):
    rng = random.Random(1)
    rows = []
    for asset in range(8):
        w, h = rng.choice([(16, 9), (9, 16), (5, 5), (1, 7), (40, 3)])
        for position in range(rng.randrange(1, 6)):
            fw, fh = (w, h) if rng.random() < 0.7 else (rng.randrange(1, 20), rng.randrange(1, 20))
            rows.append((asset, position * 10, fw, fh, rng.randbytes(fw * fh * 3)))
    rows += [(8, 0, 0, 0, b""), (8, 1, 2, 2, bytes(12)), (9, 0, 2, 2, bytes(range(12))), (9, 1, 0, 0, b"")]
    df = spark.createDataFrame(rows, "asset_id long, position int, width int, height int, pixels binary").repartition(3)
    for edge, cap in ((12, 1024), (12, 30), (1, 1)):
        got = {r["asset_id"]: (r["frames"], r["width"], r["height"], r["tile_width"], r["tile_height"], bytes(r["pixels"])) for r in frames.sheets(df, edge, cap).collect()}
        want = {a: looped([r for r in rows if r[0] == a], edge, cap) for a in range(10)}
        assert got == {a: s for a, s in want.items() if s}
