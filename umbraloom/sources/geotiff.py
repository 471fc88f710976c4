"""GeoTIFF: strips and tiles, plain or deflated, with tags, nodata, transform and CRS; tiled files with overviews are written and validated."""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, unescape

import numpy as np

#: Fixed values of the format: bytes and codes of field kinds, tag numbers.
KINDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, BANDS, ROWS, STRIP_SIZES, PLANES, PREDICTOR, TILE_W, TILE_H, TILES, TILE_SIZES, FORMAT, SUBFILE = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339, 254
SCALE, TIEPOINT, MATRIX, GEOKEYS, GDAL_TAGS, GDAL_NODATA = 33550, 33922, 34264, 34735, 42112, 42113
BLOCK = 256


@dataclass
class Raster:
    """Bands (bands, rows, cols), validity (rows, cols), affine (a, b, c, d, e, f), CRS, tags and nodata."""

    bands: np.ndarray
    valid: np.ndarray
    transform: tuple[float, ...] | None = None
    crs: str | None = None
    tags: dict[str, str] = field(default_factory=dict)
    nodata: float | None = None
    block: tuple[int, int] | None = None
    overviews: int = 0


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


def _fields(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    out = {}
    n = struct.unpack_from(order + "H", data, at)[0]
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in KINDS:
            continue
        size, code = KINDS[kind]
        where = at + 10 + 12 * k
        if size * count > 4:
            where = struct.unpack_from(order + "I", data, where)[0]
        if kind == 2:
            out[tag] = data[where : where + count].split(b"\0")[0].decode("utf-8", "replace")
        else:
            out[tag] = struct.unpack_from(f"{order}{count * len(code)}{code[0]}", data, where)
    return out, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def read_header(data: bytes) -> tuple[dict[int, tuple], str, int]:
    """Fields of the first image, the byte order and the number of further images."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    first, nxt = _fields(data, order, struct.unpack_from(order + "I", data, 4)[0])
    more = 0
    while nxt:
        more, nxt = more + 1, _fields(data, order, nxt)[1]
    return first, order, more


def parse_geotiff(data: bytes, bands: list[int] | None = None) -> Raster:
    """A raster with chosen bands (from 1). Blocks without bytes, NaN and nodata are invalid."""
    f, order, more = read_header(data)
    one = lambda t, d=None: f[t][0] if t in f else d
    width, height, n = one(WIDTH), one(HEIGHT), one(BANDS, 1)
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one(FORMAT, 1)]}{one(BITS, 8) // 8}")
    compression, predictor, planar = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANES, 1) == 2
    if compression not in (1, 8, 32946) or predictor not in (1, 2):
        raise ValueError(f"TIFF compression {compression} with predictor {predictor} is not supported")
    tiled = TILES in f
    bw, bh = (one(TILE_W), one(TILE_H)) if tiled else (width, one(ROWS, height))
    offsets, sizes = (f[TILES], f[TILE_SIZES]) if tiled else (f[STRIPS], f[STRIP_SIZES])
    across, down = -(-width // bw), -(-height // bh)
    out, there = np.zeros((n, height, width), kind.newbyteorder("=")), np.ones((height, width), bool)
    for k, (o, size) in enumerate(zip(offsets, sizes, strict=True)):
        plane, k = (k // (across * down), k % (across * down)) if planar else (None, k)
        y, x = k // across * bh, k % across * bw
        if not size:
            there[y : y + bh, x : x + bw] = False
            continue
        raw = data[o : o + size] if compression == 1 else zlib.decompress(data[o : o + size])
        c = 1 if planar else n
        rows = bh if tiled else min(bh, height - y)
        a = np.frombuffer(raw, kind, rows * bw * c).reshape(rows, bw, c)
        if predictor == 2:
            a = np.cumsum(a, axis=1, dtype=a.dtype)
        a = a[: height - y, : width - x]
        target = out[plane : plane + 1] if planar else out
        target[:, y : y + bh, x : x + bw] = np.moveaxis(a, 2, 0)
    crs, point = crs_from_geokeys(f.get(GEOKEYS))
    nodata = float(f[GDAL_NODATA]) if GDAL_NODATA in f and f[GDAL_NODATA].strip() else None
    if bands:
        out = out[[b - 1 for b in bands]]
    valid = there & np.isfinite(out).all(axis=0)
    if nodata is not None and not np.isnan(nodata):
        valid &= (out != np.array(nodata).astype(out.dtype)).all(axis=0)
    tags = {k: unescape(v) for k, v in re.findall(r'<Item name="([^"]*)"[^>]*>([^<]*)</Item>', f.get(GDAL_TAGS, ""))}
    return Raster(out, valid, affine_from_tags(f.get(SCALE), f.get(TIEPOINT), f.get(MATRIX), point), crs, tags, nodata, (bh, bw) if tiled else None, more)


def _halved(a: np.ndarray) -> np.ndarray:
    return a[::2, ::2]


def geotiff_bytes(a: np.ndarray, transform: tuple[float, ...] | None = None, epsg: int | None = None, tags: dict[str, str] | None = None, nodata: float | None = None, cog: bool = True) -> bytes:
    """One band as a deflated file. cog: 256-pixel tiles and halved overviews, their headers before all pixels. A finite nodata may not be among valid values."""
    a = np.ascontiguousarray(a)
    levels = [a]
    while cog and max(levels[-1].shape) > BLOCK:
        levels.append(_halved(levels[-1]))
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    heads, bodies = [], []
    for k, z in enumerate(levels):
        h, w = z.shape
        bh, bw = (BLOCK, BLOCK) if cog else (h, w)
        blocks = []
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                b = z[y : y + bh, x : x + bw]
                if cog:
                    b = np.pad(b, ((0, bh - b.shape[0]), (0, bw - b.shape[1])), mode="edge")
                blocks.append(zlib.compress(b.astype(a.dtype.newbyteorder("<")).tobytes(), 6))
        f = [(SUBFILE, 4, [1 if k else 0]), (WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [a.dtype.itemsize * 8]), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [1]), (BANDS, 3, [1]), (PLANES, 3, [1]), (FORMAT, 3, [kind])]
        f += [(TILE_W, 3, [bw]), (TILE_H, 3, [bh]), (TILES, 4, [0] * len(blocks)), (TILE_SIZES, 4, [len(b) for b in blocks])] if cog else [(ROWS, 4, [h]), (STRIPS, 4, [0]), (STRIP_SIZES, 4, [len(blocks[0])])]
        if not k:
            if transform and transform[1] == transform[3] == 0:
                f += [(SCALE, 12, [transform[0], -transform[4], 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, transform[2], transform[5], 0.0])]
            elif transform:
                f.append((MATRIX, 12, [transform[0], transform[1], 0.0, transform[2], transform[3], transform[4], 0.0, transform[5], *[0.0] * 7, 1.0]))
            if epsg:
                projected = not 4000 <= epsg < 5000
                f.append((GEOKEYS, 3, [1, 1, 0, 3, 1024, 0, 1, 1 if projected else 2, 1025, 0, 1, 1, 3072 if projected else 2048, 0, 1, epsg]))
            if tags:
                f.append((GDAL_TAGS, 2, "<GDALMetadata>" + "".join(f'<Item name="{escape(n)}">{escape(str(v))}</Item>' for n, v in tags.items()) + "</GDALMetadata>"))
        if nodata is not None:
            f.append((GDAL_NODATA, 2, repr(float(nodata))))
        heads.append(sorted(f))
        bodies.append(blocks)

    def packed(kind: int, v) -> bytes:
        return v.encode() + b"\0" if kind == 2 else struct.pack(f"<{len(v)}{KINDS[kind][1]}", *v)

    def size(f) -> int:
        return 6 + 12 * len(f) + sum(len(b) + len(b) % 2 for _, k, v in f for b in [packed(k, v)] if len(b) > 4)

    at = 8 + sum(map(size, heads))
    for f, blocks in zip(heads, bodies, strict=True):
        offsets = []
        for b in blocks:
            offsets.append(at)
            at += len(b)
        for i, (tag, kind_, _) in enumerate(f):
            if tag in (TILES, STRIPS):
                f[i] = (tag, kind_, offsets)
    out = bytearray(struct.pack("<2sHI", b"II", 42, 8))
    for k, f in enumerate(heads):
        start, end = len(out), len(out) + size(f)
        extra = start + 6 + 12 * len(f)
        body = b""
        out += struct.pack("<H", len(f))
        for tag, kind_, v in f:
            raw = packed(kind_, v)
            out += struct.pack("<HHI", tag, kind_, len(raw) if kind_ == 2 else len(v))
            if len(raw) <= 4:
                out += raw.ljust(4, b"\0")
            else:
                out += struct.pack("<I", extra + len(body))
                body += raw + b"\0" * (len(raw) % 2)
        out += struct.pack("<I", end if k + 1 < len(heads) else 0) + body
    return bytes(out) + b"".join(b for blocks in bodies for b in blocks)


def validate(data: bytes, expected: np.ndarray, transform=None, epsg: int | None = None, nodata: float | None = None, cog: bool = True, atol: float = 0.0) -> list[str]:
    """What a file that was read again does not keep: empty if all is well."""
    r = parse_geotiff(data)
    got = r.bands[0]
    bad = []
    if got.shape != expected.shape:
        return [f"size {got.shape} instead of {expected.shape}"]
    if got.dtype != expected.dtype:
        bad.append(f"kind {got.dtype} instead of {expected.dtype}")
    if cog and (r.block != (BLOCK, BLOCK) or max(got.shape) > BLOCK and not r.overviews):
        bad.append("no tiles or no overviews")
    if transform and (r.transform is None or max(abs(x - y) for x, y in zip(r.transform, transform, strict=True)) > 1e-9):
        bad.append("transform differs")
    if epsg and r.crs != f"EPSG:{epsg}":
        bad.append(f"CRS {r.crs}")
    if nodata is not None and r.nodata != nodata and not (np.isnan(nodata) and r.nodata is not None and np.isnan(r.nodata)):
        bad.append("nodata differs")
    if not np.allclose(got.astype(float), expected.astype(float), rtol=0, atol=atol, equal_nan=True):
        bad.append("values differ")
    return bad
