"""Greyscale and colour PNG of 8 and 16 bits as arrays of their own depth, which Spark's image source truncates to 8."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type; palettes and depths below 8 bits are not read.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def chunks(data: bytes):
    """``kind, body`` of each chunk up to the end; a checksum that does not fit is an error."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack(">I", data[at + 8 + size : at + 12 + size] or b"\0\0\0\0")[0] != zlib.crc32(kind + body):
            raise ValueError("broken chunk")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise ValueError("no end")


def decode(data: bytes) -> np.ndarray:
    """Height x width (x channels) of ``uint8`` or ``uint16``; ValueError for what can't be read."""
    head, packed = None, []
    for kind, body in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None:
        raise ValueError("no header")
    width, height, bits, colour, _, _, interlace = head
    if bits not in (8, 16) or colour not in CHANNELS or interlace:
        raise ValueError("depth, palette or interlacing not read")
    channels = CHANNELS[colour]
    step, line = channels * bits // 8, width * channels * bits // 8
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError("broken data") from e
    if len(raw) != height * (line + 1):
        raise ValueError("too few rows")
    rows = np.frombuffer(raw, np.uint8).reshape(height, line + 1)
    out = _unfiltered(rows[:, 0], rows[:, 1:], step)
    out = out.reshape(height, width, channels, bits // 8)
    whole = out[..., 0].astype(np.uint16) << 8 | out[..., 1] if bits == 16 else out[..., 0]
    return whole[..., 0] if channels == 1 else whole


def _unfiltered(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Bytes from what each row's filter left of them: by the pixel to the left, the row above, or both."""
    out = np.zeros((len(rows) + 1, rows.shape[1] + step), np.uint8)
    for y, (kind, row) in enumerate(zip(kinds.tolist(), rows, strict=True), 1):
        above, own = out[y - 1], out[y]
        if kind == 0:
            own[step:] = row
        elif kind == 1:
            own[step:] = np.add.accumulate(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            own[step:] = row + above[step:]
        elif kind in (3, 4):
            # Each pixel needs the one before it, so these go byte by byte.
            left, up, now = [0] * step, above.tolist(), row.tolist()
            for i, v in enumerate(now):
                a, b, c = left[i], up[i + step], up[i]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                left.append((v + guess) & 255)
            own[:] = left
        else:
            raise ValueError("unknown filter")
    return out[1:, step:]
