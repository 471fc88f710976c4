"""PNG images of 8 and 16 bits, not interlaced: grey, RGB, with or without alpha, palettes."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def parse_png(data: bytes) -> np.ndarray:
    """(rows, cols, bands) without alpha."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, palette, head = 8, b"", None, None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + size
    width, height, bits, color, _, _, interlace = head
    if bits not in (8, 16) or interlace:
        raise ValueError("only PNG files of 8 or 16 bits that are not interlaced are supported")
    n, step = CHANNELS[color], bits // 8
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * n * step)
    out, gap = np.zeros((height, width * n * step), np.uint8), n * step
    above = np.zeros(width * n * step, np.uint8)
    for y in range(height):
        out[y] = above = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, gap)
    px = (out.view(">u2").astype(np.uint16) if bits == 16 else out).reshape(height, width, n)
    if color == 3:
        return palette[px[:, :, 0]]
    return px[:, :, : n - (color in (4, 6))]


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, gap: int) -> np.ndarray:
    if kind == 0:
        return row.copy()
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, gap), axis=0, dtype=np.uint8).ravel()
    out = np.zeros(len(row) + gap, np.int64)
    up = np.concatenate([np.zeros(gap, np.int64), above.astype(np.int64)])
    for i in range(gap, len(out)):
        a, b, c = out[i - gap], up[i], up[i - gap]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        out[i] = (int(row[i - gap]) + guess) & 255
    return out[gap:].astype(np.uint8)


def png_bytes(a: np.ndarray) -> bytes:
    """Grey (rows, cols), RGB or RGBA (rows, cols, 3 or 4) of uint8."""
    a = np.atleast_3d(np.asarray(a, np.uint8))
    height, width, n = a.shape
    color = {1: 0, 3: 2, 4: 6}[n]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = np.concatenate([np.zeros((height, 1), np.uint8), a.reshape(height, -1)], axis=1).tobytes()
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")
