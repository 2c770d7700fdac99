"""PNG decoding against an encoder of its own, bands from files, letterbox tensors against loops."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import pixels, raster
from panelweave.sources import web


def png(image: np.ndarray, colour: int, filters, palette: np.ndarray | None = None) -> bytes:
    """image: (h, w, channels). Row filters in turn."""
    h, w, step = image.shape
    rows, above = b"", np.zeros(w * step, np.int64)
    for y in range(h):
        row = image[y].ravel().astype(np.int64)
        left, corner = (np.concatenate((np.zeros(step, np.int64), v[:-step])) for v in (row, above))
        p = left + above - corner
        near = np.argmin(np.stack((abs(p - left), abs(p - above), abs(p - corner))), axis=0)
        paeth = np.choose(near, (left, above, corner))
        kind = filters[y % len(filters)]
        base = (0, left, above, (left + above) // 2, paeth)[kind]
        rows += bytes([kind]) + ((row - base) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    body = zlib.compress(rows)
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)), *([chunk(b"PLTE", palette.tobytes())] if palette is not None else []), chunk(b"IDAT", body[:7]), chunk(b"IDAT", body[7:]), chunk(b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(parts)


@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (3,), (4,), (4, 3, 2, 1, 0)])
def test_png(filters):
    rng = np.random.default_rng(sum(filters))
    for colour, step in pixels.CHANNELS.items():
        image = rng.integers(0, 256, (9, 13, step)).astype(np.uint8)
        palette = rng.integers(0, 256, (256, 3)).astype(np.uint8) if colour == 3 else None
        want = palette[image[:, :, 0]] if colour == 3 else np.repeat(image[:, :, :1], 3, axis=2) if step < 3 else image[:, :, :3]
        assert (pixels.decode_png(png(image, colour, filters, palette)) == want).all()
    with pytest.raises(ValueError, match="PNG"):
        pixels.decode_png(b"GIF89a")


def test_bands_from_files(spark, tmp_path):
    """Several sizes, one of them without bands; as the relational form has it."""
    rng, rows, sizes = np.random.default_rng(5), [], []
    o = raster.Options(least_length=30)
    for c, (w, h) in enumerate([(110, 70), (64, 150), (200, 90), (40, 40)]):
        gray = rng.integers(90, 255, (h, w)).astype(np.uint8)
        if c < 3:
            gray[h // 2 : h // 2 + 3, 0 : w - 5] = 10
            gray[5 : h - 5, w // 2 : w // 2 + 2] = 20
        (tmp_path / f"{c}.png").write_bytes(png(np.repeat(gray[:, :, None], 3, axis=2), 2, (4, 1, 2, 3, 0)))
        rows += [(c, x, y, int(gray[y, x])) for y in range(h) for x in range(w)]
        sizes.append((c, w, h))
    got = pixels.bands_of_images(web.captures(spark, str(tmp_path)), o)
    want = raster.border_bands(spark.createDataFrame(rows, "capture_id long, x int, y int, g int"), spark.createDataFrame(sizes, "capture_id long, width int, height int"), o)
    own = got.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("c"), "orient", "x0", "y0", "x1", "y1")
    found = sorted(map(tuple, own.collect()))
    assert found == sorted(map(tuple, want.select("capture_id", "orient", "x0", "y0", "x1", "y1").collect())) and {r[0] for r in found} == {0, 1, 2}
    assert {(r.width, r.height) for r in got.collect()} == {(110, 70), (64, 150), (200, 90)}


def test_letterbox_against_loops():
    rng = np.random.default_rng(6)
    for w, h in ((5, 3), (40, 7), (3, 50), (16, 16), (1, 1)):
        image = rng.integers(0, 256, (h, w, 3)).astype(np.uint8)
        tensor, scale, left, top = pixels.letterboxed(image, 16)
        nw, nh = int(w * scale + 0.5) or 1, int(h * scale + 0.5) or 1
        assert (left, top) == ((16 - nw) // 2, (16 - nh) // 2)
        for y in range(16):
            for x in range(16):
                for c in range(3):
                    v = 114
                    if left <= x < left + nw and top <= y < top + nh:
                        sx, sy = (min(n - 1, max(0, (q + 0.5) * n / m - 0.5)) for q, n, m in ((x - left, w, nw), (y - top, h, nh)))
                        x0, y0 = int(sx), int(sy)
                        x1, y1, fx, fy = min(x0 + 1, w - 1), min(y0 + 1, h - 1), sx - x0, sy - y0
                        p = image[:, :, c].astype(float)
                        v = int((p[y0, x0] * (1 - fx) + p[y0, x1] * fx) * (1 - fy) + (p[y1, x0] * (1 - fx) + p[y1, x1] * fx) * fy + 0.5)
                    assert tensor[c, y, x] == np.float32(v) / np.float32(255)


def test_tensors_as_bytes_and_arrays(spark):
    rng = np.random.default_rng(7)
    rows = [(c, w, h, rng.integers(0, 256, w * h * k).astype(np.uint8).tobytes()) for c, (w, h, k) in enumerate([(4, 6, 3), (9, 2, 1)])]
    df = spark.createDataFrame(rows, "capture_id long, width int, height int, pixels binary")
    a, b = ({r.capture_id: r.tensor for r in pixels.letterbox_tensors(df, 8, flag).collect()} for flag in (False, True))
    assert all(np.frombuffer(a[c], "<f4").tolist() == b[c] and len(b[c]) == 192 for c in (0, 1)) and len(a) == 2
