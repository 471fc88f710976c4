"""TIFF files read by byte ranges: a header costs its directory, a window its blocks, whatever the size of the file.

Strips and tiles, 32- and 64-bit offsets, plain, deflated or LZW-compressed, with horizontal or floating-point prediction. Blocks without bytes
are invalid everywhere.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property
from typing import NamedTuple, Protocol
from xml.sax.saxutils import unescape

import numpy as np
from pyarrow import fs

#: Fixed values of the format: bytes and codes of field kinds, tag numbers, compression codes.
KINDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, BANDS, ROWS, STRIP_SIZES, PLANES, PREDICTOR, TILE_W, TILE_H, TILES, TILE_SIZES, FORMAT, SUBFILE = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339, 254
SCALE, TIEPOINT, MATRIX, GEOKEYS, GDAL_TAGS, GDAL_NODATA = 33550, 33922, 34264, 34735, 42112, 42113
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
HORIZONTAL, FLOATING = 2, 3
#: Bytes that are read together where a header is.
PAGE = 4096


class Source(Protocol):
    """Bytes by place. `taken` counts what was read."""

    taken: int

    def read(self, at: int, n: int) -> bytes: ...


class Memory:
    def __init__(self, data: bytes) -> None:
        self.data, self.taken = data, 0

    def read(self, at: int, n: int) -> bytes:
        self.taken += n
        return self.data[at : at + n]


class Stored:
    """A file in any store that pyarrow knows by its address. Small reads are served from pages that are kept; large ones go to the file."""

    def __init__(self, uri: str) -> None:
        store, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("/") else fs.FileSystem.from_uri(uri.replace("file:", "file://", 1))
        self.file, self.taken, self.pages = store.open_input_file(path), 0, {}

    def _page(self, k: int) -> bytes:
        if k not in self.pages:
            self.pages[k] = self.file.read_at(PAGE, k * PAGE)
            self.taken += len(self.pages[k])
        return self.pages[k]

    def read(self, at: int, n: int) -> bytes:
        if n > PAGE:
            self.taken += n
            return self.file.read_at(n, at)
        first, last = at // PAGE, (at + max(n, 1) - 1) // PAGE
        joined = b"".join(self._page(k) for k in range(first, last + 1))
        return joined[at - first * PAGE : at - first * PAGE + n]

    def close(self) -> None:
        self.file.close()


def affine_from_tags(scale=None, tiepoint=None, matrix=None, pixel_is_point: bool = False) -> tuple[float, ...] | None:
    """(a, b, c, d, e, f) for pixel corners; a point raster's positions are pixel centres, so it moves by half a pixel."""
    if matrix is not None:
        t = (matrix[0], matrix[1], matrix[3], matrix[4], matrix[5], matrix[7])
    elif scale is not None and tiepoint is not None:
        i, j, _, x, y = tiepoint[:5]
        t = (scale[0], 0.0, x - i * scale[0], 0.0, -scale[1], y + j * scale[1])
    else:
        return None
    if pixel_is_point:
        t = (t[0], t[1], t[2] - (t[0] + t[1]) / 2, t[3], t[4], t[5] - (t[3] + t[4]) / 2)
    return t


def crs_from_geokeys(keys) -> tuple[str | None, bool]:
    """(EPSG code of the projected or else the geographic CRS, whether pixels are points)."""
    rows = {keys[4 + 4 * k]: keys[7 + 4 * k] for k in range(keys[3])} if keys else {}
    code = next((rows[k] for k in (3072, 2048) if rows.get(k) not in (None, 32767)), None)
    return (f"EPSG:{code}" if code else None), rows.get(1025) == 2


def unpacked_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from 9 to 12 bits, most significant bit first, that grow one code early."""
    clear, end = 256, 257
    table: list[bytes] = []
    out, bits, held, width, last = [], 0, 0, 9, b""
    for byte in data:
        bits, held = (bits << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == end:
            break
        if code == clear:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("an LZW strip has to begin with a clear code")
        if not last:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("an LZW code is ahead of its table")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


class Block(NamedTuple):
    """A strip or tile: its number, the plane that it holds (None: all bands), and where it begins."""

    k: int
    plane: int | None
    row: int
    col: int


class Tiff:
    """The first image of a file. Fields are read when they are asked for."""

    def __init__(self, source: Source) -> None:
        self.source = source
        head = source.read(0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack_from(self.order + "H", head, 2)[0] if self.order and len(head) >= 8 else 0
        if version not in (42, 43):
            raise ValueError("not a TIFF file")
        self.wide = version == 43
        at = struct.unpack_from(self.order + ("Q" if self.wide else "I"), head, 8 if self.wide else 4)[0]
        self.fields, self._next = self._directory(at)

    def _directory(self, at: int) -> tuple[dict[int, tuple[int, int, int]], int]:
        """tag -> (kind, count, where the values are), and the place of the next directory."""
        o, lead, entry, inline, number = (self.order, 8, 20, 8, "Q") if self.wide else (self.order, 2, 12, 4, "I")
        n = struct.unpack(o + ("Q" if self.wide else "H"), self.source.read(at, lead))[0]
        raw = self.source.read(at + lead, n * entry + inline)
        out = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(o + "HH" + number, raw, k * entry)
            if kind in KINDS:
                where = at + lead + k * entry + entry - inline
                if KINDS[kind][0] * count > inline:
                    where = struct.unpack_from(o + number, raw, k * entry + entry - inline)[0]
                out[tag] = (kind, count, where)
        return out, struct.unpack_from(o + number, raw, n * entry)[0]

    def get(self, tag: int, default=None, first: int = 0, count: int | None = None):
        """A field's values, or those from `first` on; text as one string."""
        if tag not in self.fields:
            return default
        kind, n, where = self.fields[tag]
        size, code = KINDS[kind]
        count = n - first if count is None else min(count, n - first)
        raw = self.source.read(where + first * size, count * size)
        if kind == 2:
            return raw.split(b"\0")[0].decode("utf-8", "replace")
        return struct.unpack(f"{self.order}{count * len(code)}{code[0]}", raw)

    def one(self, tag: int, default=None):
        return self.get(tag, (default,), 0, 1)[0]

    @property
    def further(self) -> int:
        """The number of further images, overviews among them."""
        n, at = 0, self._next
        while at:
            n, at = n + 1, self._directory(at)[1]
        return n

    @cached_property
    def size(self) -> tuple[int, int, int]:
        """(bands, rows, columns)."""
        return self.one(BANDS, 1), self.one(HEIGHT), self.one(WIDTH)

    @cached_property
    def dtype(self) -> np.dtype:
        return np.dtype(f"{self.order}{ {1: 'u', 2: 'i', 3: 'f'}[self.one(FORMAT, 1)]}{self.one(BITS, 8) // 8}")

    @cached_property
    def tiled(self) -> bool:
        return TILES in self.fields

    @cached_property
    def planar(self) -> bool:
        return self.one(PLANES, 1) == 2 and self.one(BANDS, 1) > 1

    @cached_property
    def block_shape(self) -> tuple[int, int]:
        _, h, w = self.size
        return (self.one(TILE_H), self.one(TILE_W)) if self.tiled else (min(h, self.one(ROWS, h)), w)

    @property
    def georeference(self) -> tuple[str | None, tuple[float, ...] | None]:
        """(CRS, transform)."""
        crs, point = crs_from_geokeys(self.get(GEOKEYS))
        return crs, affine_from_tags(self.get(SCALE), self.get(TIEPOINT), self.get(MATRIX), point)

    @property
    def tags(self) -> dict[str, str]:
        return {k: unescape(v) for k, v in re.findall(r'<Item name="([^"]*)"[^>]*>([^<]*)</Item>', self.get(GDAL_TAGS, ""))}

    @cached_property
    def nodata(self) -> float | None:
        text = self.get(GDAL_NODATA, "")
        return float(text) if text.strip() else None

    def blocks(self, window: tuple[int, int, int, int] | None = None, bands: Iterable[int] | None = None) -> Iterator[Block]:
        """The blocks that hold any pixel of a window (r0, c0, r1, c1; ends exclusive) and of the bands (from 1), in file order."""
        n, h, w = self.size
        bh, bw = self.block_shape
        across, down = -(-w // bw), -(-h // bh)
        r0, c0, r1, c1 = window or (0, 0, h, w)
        r0, c0, r1, c1 = max(0, r0), max(0, c0), min(h, r1), min(w, c1)
        if r0 >= r1 or c0 >= c1:
            return
        for plane in sorted({b - 1 for b in bands or range(1, n + 1)}) if self.planar else [None]:
            for y in range(r0 // bh, -(-r1 // bh)):
                for x in range(c0 // bw, -(-c1 // bw)):
                    yield Block((plane or 0) * across * down + y * across + x, plane, y * bh, x * bw)

    @property
    def block_count(self) -> int:
        n, h, w = self.size
        bh, bw = self.block_shape
        return -(-w // bw) * -(-h // bh) * (n if self.planar else 1)

    def decoded(self, b: Block) -> np.ndarray | None:
        """The pixels (rows, columns, bands of the block) inside the image; None where the file has no bytes."""
        n, h, w = self.size
        bh, bw = self.block_shape
        at, size = (self.get(t, None, b.k, 1)[0] for t in ((TILES, TILE_SIZES) if self.tiled else (STRIPS, STRIP_SIZES)))
        if not size:
            return None
        compression, predictor, kind = self.one(COMPRESSION, PLAIN), self.one(PREDICTOR, 1), self.dtype
        raw, c = self.source.read(at, size), 1 if b.plane is not None else n
        rows = bh if self.tiled else min(bh, h - b.row)
        if compression in (DEFLATE, OLD_DEFLATE):
            raw = zlib.decompress(raw)
        elif compression == LZW:
            raw = unpacked_lzw(raw)
        elif compression != PLAIN:
            raise ValueError(f"TIFF compression {compression} is not supported")
        raw = raw[: rows * bw * c * kind.itemsize]
        if predictor == FLOATING:
            # each row: differences of bytes, the most significant bytes of all values first
            a = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, bw * kind.itemsize, c) if c > 1 else np.frombuffer(raw, np.uint8).reshape(rows, -1, 1), axis=1, dtype=np.uint8)
            a = np.moveaxis(a.reshape(rows, kind.itemsize, bw * c), 1, 2)
            a = np.ascontiguousarray(a).view(kind.newbyteorder(">")).reshape(rows, bw, c)
        else:
            a = np.frombuffer(raw, kind, rows * bw * c).reshape(rows, bw, c)
            if predictor == HORIZONTAL:
                a = np.cumsum(a, axis=1, dtype=kind.newbyteorder("="))
            elif predictor != 1:
                raise ValueError(f"TIFF predictor {predictor} is not supported")
        return a[: h - b.row, : w - b.col].astype(kind.newbyteorder("="), copy=False)

    def window(self, row: int, col: int, height: int, width: int, bands: Sequence[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(values (bands, height, width), validity (height, width)) of a window, which may reach beyond the image; only its blocks are read.

        Invalid are pixels outside, in blocks without bytes, and those that are not finite or nodata in any of the bands. Outside and without bytes, values are 0."""
        n, h, w = self.size
        chosen = list(bands or range(1, n + 1))
        out, there = np.zeros((len(chosen), height, width), self.dtype.newbyteorder("=")), np.zeros((height, width), bool)
        missing = np.zeros((height, width), bool)
        for b in self.blocks((row, col, row + height, col + width), chosen):
            a = self.decoded(b)
            bh, bw = self.block_shape
            y0, x0, y1, x1 = max(b.row, row), max(b.col, col), min(b.row + bh, row + height, h), min(b.col + bw, col + width, w)
            to = (slice(y0 - row, y1 - row), slice(x0 - col, x1 - col))
            there[to] = True
            if a is None:
                missing[to] = True
                continue
            part = a[y0 - b.row : y1 - b.row, x0 - b.col : x1 - b.col]
            for i, band in enumerate(chosen):
                if b.plane is None:
                    out[(i, *to)] = part[:, :, band - 1]
                elif b.plane == band - 1:
                    out[(i, *to)] = part[:, :, 0]
        return out, there & ~missing & self.valid(out).all(axis=0)

    def valid(self, values: np.ndarray) -> np.ndarray:
        ok, nodata = np.isfinite(values), self.nodata
        if nodata is not None and not np.isnan(nodata):
            ok &= values != np.array(nodata).astype(values.dtype)
        return ok
