"""Pixels of captures: PNG files to gray rasters and border bands, rasters to detector tensors. One image is in memory at
a time, whatever a batch holds."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.geometry import INPUT_SIZE
from .raster import Options, bands_of

FILL = 114  # of what the letterbox leaves free
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # by PNG colour type


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """One row of bytes; ``step``: bytes of a pixel."""
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return row + above
    out, up = bytearray(row.tobytes()), above.tobytes()
    for i, x in enumerate(out):
        a, b, c = (out[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
        if kind == 3:
            out[i] = x + (a + b) // 2 & 255
        elif kind == 4:
            to_a, to_b, to_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            out[i] = x + (a if to_a <= to_b and to_a <= to_c else b if to_b <= to_c else c) & 255
        else:
            raise ValueError("not a PNG row filter")
    return np.frombuffer(bytes(out), np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, 3) of a PNG with 8 bits a channel, not interlaced. Transparency is dropped."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, palette = 8, [], None
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            w, h, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunk)
            if bits != 8 or interlaced:
                raise ValueError("only 8 bits a channel, not interlaced")
        elif name == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body.append(chunk)
        at += size + 12
    step = CHANNELS[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * step)
    out, above = np.empty((h, w * step), np.uint8), np.zeros(w * step, np.uint8)
    for y, row in enumerate(rows):
        above = out[y] = _unfiltered(int(row[0]), row[1:], above, step)
    out = out.reshape(h, w, step)
    if colour == 3:
        return palette[out[:, :, 0]]
    return np.repeat(out[:, :, :1], 3, axis=2) if step < 3 else out[:, :, :3]


def luma(rgb: np.ndarray) -> np.ndarray:
    """Gray as bytes; halves go to the even one."""
    r, g, b = (rgb[..., k].astype(float) for k in range(3))
    return np.clip(np.rint(0.299 * r + 0.587 * g + 0.114 * b), 0, 255).astype(np.uint8)


BANDS = "path string, width int, height int, orient string, x0 int, y0 int, x1 int, y1 int"


def bands_of_images(files: DataFrame, options: Options | None = None) -> DataFrame:
    """files: path, content (PNG), as the binaryFile source gives them. Border bands of each, with the image's size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                gray = luma(decode_png(content.as_py()))
                found = bands_of(gray, options)
                n = len(found)
                sizes = [pa.array([v] * n, pa.int32()) for v in (gray.shape[1], gray.shape[0])]
                sides = [pa.array(found[c].to_numpy(np.int32), pa.int32()) for c in ("x0", "y0", "x1", "y1")]
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * n, pa.string()), *sizes, pa.array(found["orient"].tolist(), pa.string()), *sides], [c.split(" ")[0] for c in BANDS.split(", ")])

    return files.select("path", "content").mapInArrow(work, BANDS)


def resampled(pixels: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear between pixel centres, as bytes (halves up). pixels: (height, width, channels)."""

    def places(n: int, old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) * old / n - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, old - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = places(h, pixels.shape[0]), places(w, pixels.shape[1])
    fx, fy, p = fx[None, :, None], fy[:, None, None], pixels.astype(float)
    rows = lambda y: p[y][:, x0] * (1 - fx) + p[y][:, x1] * fx
    return np.floor(rows(y0) * (1 - fy) + rows(y1) * fy + 0.5).astype(np.uint8)


def letterboxed(pixels: np.ndarray, size: int = INPUT_SIZE) -> tuple[np.ndarray, float, int, int]:
    """(channels first, 0 to 1; scale; left pad; top pad): the image in a gray square, its aspect kept."""
    h, w = pixels.shape[:2]
    scale = min(size / w, size / h)
    new_w, new_h = (max(1, int(np.floor(d * scale + 0.5))) for d in (w, h))
    left, top = (size - new_w) // 2, (size - new_h) // 2
    square = np.full((size, size, 3), FILL, np.uint8)
    square[top : top + new_h, left : left + new_w] = resampled(pixels, new_w, new_h)
    return square.transpose(2, 0, 1).astype(np.float32) / np.float32(255), scale, left, top


def letterbox_tensors(rasters: DataFrame, size: int = INPUT_SIZE, as_array: bool = False) -> DataFrame:
    """rasters: capture_id, width, height, pixels (binary, row by row, one byte a pixel or three). The detector's input:
    scale, pad_left, pad_top and tensor (little-endian floats, channels first; or an array of them)."""
    kind = rasters.schema["capture_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w, h, raw = (batch.column(c)[i].as_py() for c in ("width", "height", "pixels"))
                pixels = np.frombuffer(raw, np.uint8).reshape(h, w, -1)
                tensor, scale, left, top = letterboxed(np.repeat(pixels, 3, axis=2) if pixels.shape[2] == 1 else pixels, size)
                held = pa.array([tensor.ravel()], pa.list_(pa.float32())) if as_array else pa.array([tensor.astype("<f4").tobytes()])
                numbers = [pa.array([scale]), *(pa.array([v], pa.int32()) for v in (left, top))]
                yield pa.RecordBatch.from_arrays([batch.column("capture_id").slice(i, 1), *numbers, held], ["capture_id", "scale", "pad_left", "pad_top", "tensor"])

    held = "array<float>" if as_array else "binary"
    return rasters.select("capture_id", "width", "height", "pixels").mapInArrow(work, f"capture_id {kind}, scale double, pad_left int, pad_top int, tensor {held}")
