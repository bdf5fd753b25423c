"""What the engine reads of image files itself: frame size, orientation, and the turn and cut of decoded pixels.

Decoding is an adapter of the caller; headers are parsed here, from the first bytes of a file."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the JPEG and EXIF formats: markers without a length, frame headers, the orientation tag.
_BARE = {0x01, *range(0xD0, 0xD9)}
_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
_ORIENTATION = 0x0112


def _segments(data: bytes):
    """(marker, payload) of a JPEG's segments up to its first scan."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF or marker in _BARE:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xDA:
            return
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + max(size, 2)


def orientation_of(data: bytes | None) -> int:
    """The EXIF orientation 1 to 8 of a JPEG; 1 where there is none or it cannot be read."""
    if not data or data[:2] != b"\xff\xd8":
        return 1
    for marker, payload in _segments(data):
        if marker == 0xE1 and payload[:6] == b"Exif\0\0":
            tiff = payload[6:]
            order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
            try:
                first = struct.unpack_from(f"{order}I", tiff, 4)[0]
                for i in range(struct.unpack_from(f"{order}H", tiff, first)[0]):
                    tag, _, _, value = struct.unpack_from(f"{order}HHIH", tiff, first + 2 + 12 * i)
                    if tag == _ORIENTATION and 1 <= value <= 8:
                        return value
            except struct.error:
                return 1
    return 1


def frame_of(data: bytes | None) -> tuple[int, int] | None:
    """Width and height of a PNG or JPEG as stored; none where they cannot be read."""
    if not data:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"\xff\xd8":
        for marker, payload in _segments(data):
            if marker in _FRAMES and len(payload) >= 5:
                height, width = struct.unpack(">HH", payload[1:5])
                return width, height
    return None


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("width", "height", "orientation")]))
def header(content: pd.Series) -> pd.DataFrame:
    """Frame size as stored (null if unreadable) and orientation of each file."""
    frames = [frame_of(x) or (None, None) for x in content]
    return pd.DataFrame({"width": pd.array([w for w, _ in frames], dtype="Int32"), "height": pd.array([h for _, h in frames], dtype="Int32"), "orientation": [orientation_of(x) for x in content]})


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels (rows, columns, ...) as they are to be shown. Values 2, 4, 5 and 7 mirror, 3, 5 to 8 turn."""
    if orientation in (5, 6, 7, 8):
        pixels = np.swapaxes(pixels, 0, 1)
    if orientation in (3, 4, 7, 8):
        pixels = pixels[::-1]
    if orientation in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    return pixels


def cropped(pixels: np.ndarray, box: list[int]) -> np.ndarray:
    """The part of upright pixels inside of a padded box (x1, y1, x2, y2)."""
    x1, y1, x2, y2 = box
    return pixels[y1:y2, x1:x2]


@F.arrow_udf(T.BinaryType())
def packed(vectors: pa.Array) -> pa.Array:
    """A vector as little-endian doubles, one after another."""
    return pa.array([None if v is None else np.asarray(v, dtype="<f8").tobytes() for v in vectors.to_pylist()], pa.binary())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def unpacked(data: pa.Array) -> pa.Array:
    return pa.array([None if x is None else np.frombuffer(x, dtype="<f8") for x in data.to_pylist()], pa.list_(pa.float64()))
