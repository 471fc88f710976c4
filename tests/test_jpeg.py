"""JPEG and BMP images, written plainly here, read there."""

import struct

import numpy as np
import pytest

from umbraloom.sources import jpeg, rasters

WAVES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
WAY = []
for s in range(15):  # the diagonals, in turn up and down
    line = [(i, s - i) for i in range(8) if 0 <= s - i < 8]
    WAY += line if s % 2 else line[::-1]
AC = [(run << 4) | size for run in range(16) for size in range(1, 11)] + [0x00, 0xF0]


def coded(v):
    size = int(abs(v)).bit_length()
    return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""


def block_bits(z, last):
    size, extra = coded(int(z[0] - last))
    out, run = format(size, "04b") + extra, 0
    for v in z[1:]:
        if not v:
            run += 1
            continue
        while run > 15:
            out, run = out + format(AC.index(0xF0), "08b"), run - 16
        size, extra = coded(int(v))
        out, run = out + format(AC.index((run << 4) | size), "08b") + extra, 0
    return out + (format(AC.index(0), "08b") if run else "")


def written(planes, sampling, quantiser, width, height, restart=0, adobe=None, progressive=False):
    """Planes of whole blocks as a JPEG file; sampling: (across, down) of each."""
    seg = lambda kind, body: bytes((0xFF, kind)) + struct.pack(">H", len(body) + 2) + body
    q = bytes(int(quantiser[i, j]) for i, j in WAY)
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0" + bytes(9)) + (seg(0xEE, b"Adobe" + bytes(6) + bytes([adobe])) if adobe is not None else b"") + seg(0xDB, b"\0" + q)
    head += seg(0xC2 if progressive else 0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes((k + 1, (a << 4) | d, 0)) for k, (a, d) in enumerate(sampling)))
    head += seg(0xC4, b"\x00" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))) + seg(0xC4, b"\x10" + bytes([0] * 7 + [len(AC)] + [0] * 8) + bytes(AC))
    if restart:
        head += seg(0xDD, struct.pack(">H", restart))
    head += seg(0xDA, bytes([len(planes)]) + b"".join(bytes((k + 1, 0)) for k in range(len(planes))) + b"\x00\x3f\x00")
    zs = []
    for p in planes:
        b = (p.astype(float) - 128).reshape(p.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3)
        f = np.rint(WAVES @ b @ WAVES.T / quantiser).astype(int)
        zs.append(np.stack([f[:, :, i, j] for i, j in WAY], axis=2))
    a, d = sampling[0]
    rows, cols = zs[0].shape[0] // d, zs[0].shape[1] // a
    body, bits, last, mark = b"", "", [0] * len(planes), 0

    def flushed(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    for m in range(rows * cols):
        if restart and m and m % restart == 0:
            body += flushed(bits) + bytes((0xFF, 0xD0 + mark % 8))
            bits, last, mark = "", [0] * len(planes), mark + 1
        for k, (across, down) in enumerate(sampling):
            for y in range(down):
                for x in range(across):
                    z = zs[k][m // cols * down + y, m % cols * across + x]
                    bits += block_bits(z, last[k])
                    last[k] = z[0]
    return head + body + flushed(bits) + b"\xff\xd9"


def smooth(h, w, k):
    r, c = np.mgrid[0:h, 0:w]
    return 128 + 90 * np.sin(r / (9 + k) + k) * np.cos(c / (11 + 2 * k))


@pytest.mark.parametrize("restart", [0, 3])
def test_grey(restart):
    a = np.rint(smooth(40, 56, 1) + np.random.default_rng(1).integers(-6, 7, (40, 56)))
    got = jpeg.parse_jpeg(written([a], [(1, 1)], np.ones((8, 8)), 51, 37, restart))
    assert got.shape == (37, 51, 1) and np.abs(got[:, :, 0].astype(int) - a[:37, :51]).max() <= 1
    coarse = np.add.outer(np.arange(8), np.arange(8)) + 3.0
    got = jpeg.parse_jpeg(written([a], [(1, 1)], coarse, 56, 40, restart))[:, :, 0]
    b = (a - 128).reshape(5, 8, 7, 8).transpose(0, 2, 1, 3)
    want = (WAVES.T @ (np.rint(WAVES @ b @ WAVES.T / coarse) * coarse) @ WAVES).transpose(0, 2, 1, 3).reshape(40, 56) + 128
    assert np.abs(got - np.clip(want, 0, 255)).max() <= 0.51


@pytest.mark.parametrize("sampling", [[(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
def test_colours(sampling):
    (a, d), h, w = sampling[0], 48, 64
    full = [np.clip(np.rint(smooth(h, w, k)), 0, 255) for k in range(3)]
    planes = [full[0], *(p[::d, ::a] for p in full[1:])]
    got = jpeg.parse_jpeg(written(planes, sampling, np.ones((8, 8)), w, h)).astype(float)
    y, b, r = (p.repeat(h // p.shape[0], axis=0).repeat(w // p.shape[1], axis=1) for p in planes)
    want = np.clip(np.stack([y + 1.402 * (r - 128), y - 0.344136 * (b - 128) - 0.714136 * (r - 128), y + 1.772 * (b - 128)], axis=2), 0, 255)
    assert np.abs(got - want).max() <= 4 and np.abs(got - want).mean() < 0.7  # a step of each plane, carried through the colours
    rgb = jpeg.parse_jpeg(written(full, [(1, 1)] * 3, np.ones((8, 8)), w, h, adobe=0))
    assert np.abs(rgb - np.stack(full, axis=2)).max() <= 1


def test_refused():
    a = smooth(8, 8, 0)
    for data, what in ((b"abc", "not a JPEG"), (written([a], [(1, 1)], np.ones((8, 8)), 8, 8, progressive=True), "sequential"), (b"\xff\xd8\xff\xd9", "without a scan"), (written([smooth(80, 80, 0)], [(1, 1)], np.ones((8, 8)), 80, 80)[:-400], "cut|too long")):
        with pytest.raises(ValueError, match=what):
            jpeg.parse_jpeg(data)


def bmp(a, bits, top_down=False):
    h, w, _ = a.shape
    rows = a if top_down else a[::-1]
    px = rows[:, :, ::-1]
    palette = b""
    if bits == 8:
        palette = bytes(v for k in range(256) for v in (k, 255 - k, 7, 0))
        body = np.pad(rows[:, :, 2], ((0, 0), (0, -w % 4))).tobytes()
    else:
        px = px if bits == 24 else np.concatenate([px, np.full((h, w, 1), 255, np.uint8)], axis=2)
        body = np.pad(px.reshape(h, -1), ((0, 0), (0, -(w * bits // 8) % 4))).tobytes()
    begin = 54 + len(palette)
    return struct.pack("<2sIHHI", b"BM", begin + len(body), 0, 0, begin) + struct.pack("<IiiHHIIiiII", 40, w, -h if top_down else h, 1, bits, 0, len(body), 0, 0, 0, 0) + palette + body


def test_bmp(spark, tmp_path):
    a = np.random.default_rng(3).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    for bits in (24, 32):
        for top_down in (False, True):
            assert (jpeg.parse_bmp(bmp(a, bits, top_down)) == a).all()
    got = jpeg.parse_bmp(bmp(a, 8))
    assert (got[:, :, 2] == a[:, :, 2]).all() and (got[:, :, 1] == 255 - a[:, :, 2]).all() and (got[:, :, 0] == 7).all()
    with pytest.raises(ValueError, match="not a BMP"):
        jpeg.parse_bmp(b"xx")
    (tmp_path / "a.bmp").write_bytes(bmp(a, 24))
    grey = np.clip(np.rint(smooth(16, 16, 2)), 0, 255)
    (tmp_path / "b.jpg").write_bytes(written([grey], [(1, 1)], np.ones((8, 8)), 16, 16))
    px = {(r["band"], r["row"], r["col"]): r["value"] for r in rasters.pixels(rasters.read_blocks(spark, str(tmp_path), "*.bmp")).collect()}
    assert len(px) == 105 and all(px[k + 1, r, c] == a[r, c, k] for r in range(5) for c in range(7) for k in range(3))
    px = rasters.pixels(rasters.read_blocks(spark, str(tmp_path), "*.jpg")).collect()
    assert all(abs(r["value"] - grey[r["row"], r["col"]]) <= 1 for r in px) and len(px) == 256
