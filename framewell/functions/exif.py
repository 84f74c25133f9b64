"""How a camera was held: the orientation tag of a picture's file, and the turn that undoes it."""

from __future__ import annotations

import struct

import numpy as np

ORIENTATION = 0x0112


def _of_tags(data: bytes) -> int:
    """Orientation in a block of tags that begins with its byte order; 1 without one."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        return 1
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    for k in range(n):
        tag, kind, _, value = struct.unpack_from(order + "HHIH", data, at + 2 + 12 * k)
        if tag == ORIENTATION and kind == 3:
            return value if 1 <= value <= 8 else 1
    return 1


def orientation(data: bytes | None) -> int:
    """1 to 8 as the file of a picture tells it; 1 where it tells none or can't be read."""
    data = data or b""
    try:
        if data[:4] in (b"II*\0", b"MM\0*"):
            return _of_tags(data)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            at = 8
            while at + 8 <= len(data):
                size, kind = struct.unpack_from(">I4s", data, at)
                if kind == b"eXIf":
                    return _of_tags(data[at + 8 : at + 8 + size])
                at += 12 + size
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
                (size,) = struct.unpack_from(">H", data, at + 2)
                if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                    return _of_tags(data[at + 10 : at + 2 + size])
                at += 2 + size
    except struct.error:
        pass
    return 1


def turned(raster: np.ndarray, how: int | None) -> np.ndarray:
    """Rows and columns of a picture as it was seen."""
    if how in (5, 6, 7, 8):
        raster = raster.swapaxes(0, 1)
    if how in (3, 4, 7, 8):
        raster = raster[::-1]
    if how in (2, 3, 6, 7):
        raster = raster[:, ::-1]
    return raster
