"""TIFF files by byte ranges, and the data sources on them."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbraloom.sources import raster_source as R
from umbraloom.sources import tiff_ranges as T
from umbraloom.sources.geotiff import geotiff_bytes, parse_geotiff


def packed_lzw(data):
    """LZW as TIFF has it, written plainly."""
    bits, table, width, word = [], {bytes([k]): k for k in range(256)}, 9, b""

    def put(code):
        bits.extend((code >> i) & 1 for i in range(width - 1, -1, -1))

    put(256)
    size = 258
    for b in data:
        longer = word + bytes([b])
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        if size == 4094:
            put(256)
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        else:
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        word = bytes([b])
    if word:
        put(table[word])
    size += 1
    width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    bits += [0] * (-len(bits) % 8)
    return bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))


def tiff(bands, block=(16, 16), compression=1, predictor=1, planar=False, order="<", wide=False, strips=False, empty=(), nodata=None, gap=0):
    """A file of bands (n, rows, columns), any layout. gap: bytes left out before the pixels (the file has a hole there)."""
    n, h, w = bands.shape
    bh, bw = (block[0], w) if strips else block
    kind = bands.dtype.newbyteorder(order)
    blocks = []
    for plane in range(n) if planar else [None]:
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                rows = min(bh, h - y) if strips else bh
                part = np.zeros((rows, bw, 1 if planar else n), bands.dtype)
                own = bands[[plane] if planar else slice(None), y : y + rows, x : x + bw]
                part[: own.shape[1], : own.shape[2]] = np.moveaxis(own, 0, 2)
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                raw = part.astype(kind).tobytes()
                if predictor == 3:
                    c = part.shape[2]
                    split = np.moveaxis(np.frombuffer(part.astype(bands.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(rows, bw * c, -1), 2, 1).reshape(rows, -1)
                    steps = split.reshape(rows, -1, c)
                    raw = np.diff(steps, axis=1, prepend=np.zeros_like(steps[:, :1])).astype(np.uint8).tobytes()
                raw = {1: lambda r: r, 5: packed_lzw, 8: zlib.compress}[compression](raw)
                blocks.append(b"" if len(blocks) in empty else raw)
    code = {"u": 1, "i": 2, "f": 3}[bands.dtype.kind]
    number, offset = ("Q", 16) if wide else ("I", 4)
    f = {T.WIDTH: (4, [w]), T.HEIGHT: (4, [h]), T.BITS: (3, [bands.dtype.itemsize * 8] * n), T.COMPRESSION: (3, [compression]), T.BANDS: (3, [n]), T.PLANES: (3, [2 if planar else 1]), T.FORMAT: (3, [code] * n), T.PREDICTOR: (3, [predictor])}
    at, size = (T.STRIPS, T.STRIP_SIZES) if strips else (T.TILES, T.TILE_SIZES)
    f |= {T.ROWS: (3, [bh])} if strips else {T.TILE_W: (3, [bw]), T.TILE_H: (3, [bh])}
    f[size] = (4, [len(b) for b in blocks])
    f[at] = (offset, [0] * len(blocks))
    if nodata is not None:
        f[T.GDAL_NODATA] = (2, str(nodata).encode() + b"\0")
    letter = {2: "s", 3: "H", 4: "I", 16: "Q"}
    head = struct.pack(order + ("2sHHHQ" if wide else "2sHI"), b"II" if order == "<" else b"MM", *((43, 8, 0, 16) if wide else (42, 8)))
    lead, entry, inline = (8, 20, 8) if wide else (2, 12, 4)

    def data_of(kind_, v):
        return v if kind_ == 2 else struct.pack(f"{order}{len(v)}{letter[kind_]}", *v)

    begin = len(head) + lead + entry * len(f) + inline
    extra = sum(len(d) for k, v in f.values() for d in [data_of(k, v)] if len(d) > inline)
    place = begin + extra + gap
    offsets = []
    for b in blocks:
        offsets.append(place if b else 0)
        place += len(b)
    f[at] = (offset, offsets)
    out, body = head + struct.pack(order + ("Q" if wide else "H"), len(f)), b""
    for tag, (kind_, v) in sorted(f.items()):
        d = data_of(kind_, v)
        out += struct.pack(order + "HH" + number, tag, kind_, len(v))
        if len(d) <= inline:
            out += d.ljust(inline, b"\0")
        else:
            out += struct.pack(order + number, begin + len(body))
            body += d
    return out + struct.pack(order + number, 0) + body, b"".join(blocks)


def whole(*a, **k):
    head, pixels = tiff(*a, **k)
    return head + pixels


def image(kind, n=2, h=37, w=45):
    rng = np.random.default_rng(4)
    smooth = np.add.outer(np.arange(n) * 50, np.add.outer(np.arange(h), np.arange(w))) % 251
    return (smooth + rng.integers(0, 3, (n, h, w))).astype(kind)


@pytest.mark.parametrize("strips", [False, True])
@pytest.mark.parametrize("compression", [1, 5, 8])
@pytest.mark.parametrize(("kind", "predictor"), [("u1", 1), ("u2", 2), ("i4", 2), ("f4", 3), ("f8", 3), ("f4", 1)])
@pytest.mark.parametrize(("order", "wide", "planar"), [("<", False, False), (">", True, True), ("<", True, False)])
def test_all_layouts(strips, compression, kind, predictor, order, wide, planar):
    a = image(kind)
    t = T.Tiff(T.Memory(whole(a, compression=compression, predictor=predictor, planar=planar, order=order, wide=wide, strips=strips)))
    got, ok = t.window(0, 0, 37, 45)
    assert t.size == (2, 37, 45) and (got == a).all() and ok.all() and got.dtype == a.dtype
    got, ok = t.window(-3, 30, 20, 40, [2])
    assert (got[0, 3:, :15] == a[1, :17, 30:]).all() and ok[3:, :15].all() and ok.sum() == 17 * 15 and not got[0, :3].any()


def test_lzw_of_all_widths():
    data = np.random.default_rng(2).integers(0, 256, 30_000).astype(np.uint8).tobytes() + b"a" * 5000
    assert T.unpacked_lzw(packed_lzw(data)) == data
    assert T.unpacked_lzw(packed_lzw(b"")) == b"" and T.unpacked_lzw(packed_lzw(b"x")) == b"x"
    with pytest.raises(ValueError, match="clear code"):
        T.unpacked_lzw(b"\x00\x00\x00")


def test_same_as_the_whole_file_reader():
    a = np.random.default_rng(1).random((300, 520)).astype("f4")
    a[3, 4] = np.nan
    data = geotiff_bytes(a, (0.5, 0.0, 700000.0, 0.0, -0.5, 3170000.0), 32643, {"note": "a < b & c"}, float("nan"))
    t, r = T.Tiff(T.Memory(data)), parse_geotiff(data)
    got, ok = t.window(0, 0, 300, 520)
    assert np.array_equal(got, r.bands, equal_nan=True) and (ok == r.valid).all() and t.tags == r.tags and t.georeference == (r.crs, r.transform) and t.further == r.overviews and np.isnan(t.nodata)


def test_a_gigabyte_costs_some_kilobytes(spark, tmp_path):
    """A sparse file of 2 GB: header and window read no more than they need."""
    a = image("u2", 1, 4000, 5000)
    head, pixels = tiff(a, block=(256, 256), compression=8, wide=True, gap=2 << 30)
    with open(tmp_path / "big.tif", "wb") as f:
        f.write(head)
        f.seek(len(head) + (2 << 30))
        f.write(pixels)
    row = R.scan_headers(spark, str(tmp_path)).first()
    assert (row["width"], row["height"], row["blocks"], row["block_height"], row["compression"], row["dtype"]) == (5000, 4000, 320, 256, 8, "uint16") and row["bytes_read"] < 20_000
    source = T.Stored(str(tmp_path / "big.tif"))
    got, ok = T.Tiff(source).window(1000, 2000, 300, 100)
    assert (got[0] == a[0, 1000:1300, 2000:2100]).all() and ok.all() and source.taken < 400_000
    blocks = R.scan_blocks(spark, str(tmp_path), window=(1000, 2000, 300, 100))
    assert blocks.rdd.getNumPartitions() > 30
    px = {(r["row_off"], r["col_off"]): np.array(r["data"]).reshape(r["height"], r["width"]) for r in blocks.collect()}
    assert sorted(px) == [(1000, 2000), (1000, 2048), (1024, 2000), (1024, 2048), (1280, 2000), (1280, 2048)]
    for (y, x), z in px.items():
        assert (z == a[0, y : y + z.shape[0], x : x + z.shape[1]]).all()


def test_blocks_bands_and_conditions(spark, tmp_path):
    a, b = image("f4", 3), image("f4", 3) + 1000
    b[1, 5, 7] = -9
    (tmp_path / "a.tif").write_bytes(whole(a))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.tif").write_bytes(whole(b, planar=True, nodata=-9, empty=(0,)))
    (tmp_path / "c.txt").write_text("no raster")
    df = R.scan_blocks(spark, str(tmp_path))
    assert df.count() == 2 * 3 * 9 and df.select("path").distinct().count() == 2
    one = df.where("band = 2 and path like '%b.tif' and row_off >= 16 and col_off in (0, 32)")
    got = {(r["row_off"], r["col_off"]): r for r in one.collect()}
    assert sorted(got) == [(16, 0), (16, 32), (32, 0), (32, 32)] and (np.array(got[16, 32]["data"]).reshape(16, 13) == b[1, 16:32, 32:]).all()
    assert df.where("band = 1 and path like '%b.tif' and row_off = 0 and col_off = 0").select(F.forall("data", lambda v: F.isnan(v)).alias("gone")).first()["gone"]  # no bytes in the file
    bad = df.where("band = 2 and path like '%b.tif' and row_off = 0 and col_off = 0").first()["data"]
    assert [k for k, v in enumerate(bad) if np.isnan(v)] == [5 * 16 + 7]
    assert R.scan_blocks(spark, str(tmp_path), bands=[3]).select("band").distinct().collect() == [(3,)]
    assert R.scan_blocks(spark, str(tmp_path), columns=["path", "band", "row_off"]).columns == ["path", "band", "row_off"]
    assert R.scan_blocks(spark, str(tmp_path), window=(100, 100, 5, 5)).count() == 0 and R.scan_blocks(spark, str(tmp_path), "*.none").count() == 0
    with pytest.raises(Exception, match="has bands 1 to 3"):
        R.scan_blocks(spark, str(tmp_path), bands=[4]).count()
    with pytest.raises(Exception, match="not a TIFF"):
        R.scan_blocks(spark, str(tmp_path), "*.txt").count()


def test_conditions_prune_before_bytes_are_read(tmp_path):
    (tmp_path / "a.tif").write_bytes(whole(image("u1")))
    (tmp_path / "b.tif").write_bytes(whole(image("u1")))
    from pyspark.sql import datasource as D

    r = R.BlockReader({"path": str(tmp_path)}, None)
    rest = list(r.pushFilters([D.StringEndsWith(("path",), "b.tif"), D.EqualTo(("band",), 2), D.GreaterThan(("height",), 1), D.Not(D.In(("row_off",), (16,)))]))
    assert rest == [D.GreaterThan(("height",), 1)] and len(r.filters) == 3
    assert [p.rsplit("/", 1)[1] for p, _ in r._files()] == ["b.tif"]
    assert [len(p.value) for p in r.partitions()] == [1]
