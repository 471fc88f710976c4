"""JPEG images of the sequential Huffman kind with 8 bits: grey or three components, any whole sampling factors, restarts. BMP images without compression."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format: markers.
SOI, EOI, SOS, DQT, DHT, DRI, ADOBE = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xEE
SEQUENTIAL, OTHER_FRAMES = (0xC0, 0xC1), (0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)

#: Places of the 64 coefficients of a block in the order in which they are coded: along diagonals, in turn up and down.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_WAVES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


@dataclass
class Component:
    name: int
    across: int
    down: int
    quantiser: int
    dc: int = 0
    ac: int = 0


@dataclass
class Frame:
    width: int = 0
    height: int = 0
    parts: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[tuple[int, int], list] = field(default_factory=dict)
    restart: int = 0
    transform: int | None = None


def huffman(counts: bytes, symbols: bytes) -> list[tuple[int, int] | None]:
    """(bits, symbol) by the next 16 bits of a stream."""
    out: list[tuple[int, int] | None] = [None] * 65536
    code, k = 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            low = code << (16 - bits)
            out[low : low + (1 << (16 - bits))] = [(bits, symbols[k])] * (1 << (16 - bits))
            code, k = code + 1, k + 1
        code <<= 1
    return out


class Bits:
    """A stretch of coded bytes, most significant bit first; behind its end there are ones."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def peek(self) -> int:
        while self.n < 16:
            self.held = (self.held << 8) | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at, self.n = self.at + 1, self.n + 8
        return (self.held >> (self.n - 16)) & 0xFFFF

    def skip(self, n: int) -> None:
        self.n -= n
        self.held &= (1 << self.n) - 1

    def symbol(self, table: list) -> int:
        hit = table[self.peek()]
        if hit is None or self.at > len(self.data) + 4:
            raise ValueError("a code of a JPEG file is unknown, or the file is cut")
        self.skip(hit[0])
        return hit[1]

    def number(self, size: int) -> int:
        """A signed number of so many bits: those with a leading 0 are below zero."""
        if not size:
            return 0
        v = self.peek() >> (16 - size)
        self.skip(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


def _read(data: bytes) -> tuple[Frame, bytes]:
    """The frame and the coded bytes of its only scan."""
    if data[:2] != bytes((0xFF, SOI)):
        raise ValueError("not a JPEG file")
    f, at = Frame(), 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a JPEG marker is missing")
        if data[at + 1] == 0xFF:  # fill byte
            at += 1
            continue
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind in OTHER_FRAMES:
            raise ValueError("only sequential Huffman-coded JPEG files are supported")
        if kind == DQT:
            k = 0
            while k < len(body):
                wide, n = body[k] >> 4, body[k] & 15
                f.quantisers[n] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.int64)
                k += 1 + 64 * (2 if wide else 1)
        elif kind == DHT:
            k = 0
            while k < len(body):
                counts = body[k + 1 : k + 17]
                f.tables[body[k] >> 4, body[k] & 15] = huffman(counts, body[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif kind == DRI:
            f.restart = struct.unpack(">H", body)[0]
        elif kind == ADOBE and body[:5] == b"Adobe":
            f.transform = body[11]
        elif kind in SEQUENTIAL:
            bits, f.height, f.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or n not in (1, 3):
                raise ValueError("only JPEG files of 8 bits with one or three components are supported")
            f.parts = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif kind == SOS:
            if body[0] != len(f.parts):
                raise ValueError("only JPEG files of one scan are supported")
            for k in range(body[0]):
                part = next(p for p in f.parts if p.name == body[1 + 2 * k])
                part.dc, part.ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
            return f, data[at:]
    raise ValueError("a JPEG file without a scan")


def _stretches(coded: bytes) -> list[bytes]:
    """The coded bytes between restarts, without what stands in for a byte of ones."""
    out, begin, at = [], 0, coded.find(b"\xff")
    while 0 <= at < len(coded) - 1:
        mark = coded[at + 1]
        if 0xD0 <= mark <= 0xD7:
            out.append(coded[begin:at])
            begin = at + 2
        elif mark not in (0x00, 0xFF):
            break
        at = coded.find(b"\xff", at + (1 if mark == 0xFF else 2))
    out.append(coded[begin:at] if at >= 0 else coded[begin:])
    return [s.replace(b"\xff\x00", b"\xff") for s in out]


def _coefficients(f: Frame, coded: bytes) -> list[np.ndarray]:
    """For each component (block rows, block columns, 64) in coding order."""
    most = max(p.across for p in f.parts), max(p.down for p in f.parts)
    alone = len(f.parts) == 1
    cols, rows = -(-f.width // (8 * most[0])), -(-f.height // (8 * most[1]))
    if alone:
        f.parts[0].across = f.parts[0].down = 1
        cols, rows = -(-f.width // 8), -(-f.height // 8)
    out = [np.zeros((rows * p.down, cols * p.across, 64), np.int64) for p in f.parts]
    streams = iter(_stretches(coded))
    bits, last = Bits(next(streams)), [0] * len(f.parts)
    for m in range(rows * cols):
        if f.restart and m and m % f.restart == 0:
            bits, last = Bits(next(streams, b"")), [0] * len(f.parts)
        for k, p in enumerate(f.parts):
            dc, ac = f.tables[0, p.dc], f.tables[1, p.ac]
            for y in range(p.down):
                for x in range(p.across):
                    block = out[k][m // cols * p.down + y, m % cols * p.across + x]
                    last[k] += bits.number(bits.symbol(dc))
                    block[0] = last[k]
                    at = 1
                    while at < 64:
                        s = bits.symbol(ac)
                        run, size = s >> 4, s & 15
                        if not size:
                            if run != 15:
                                break
                            at += 16
                            continue
                        at += run
                        if at > 63:
                            raise ValueError("a block of a JPEG file is too long")
                        block[at] = bits.number(size)
                        at += 1
    return out


def parse_jpeg(data: bytes) -> np.ndarray:
    """(rows, cols, bands) of uint8: one band, or red, green and blue."""
    f, coded = _read(data)
    planes, most = [], (max(p.across for p in f.parts), max(p.down for p in f.parts))
    sampled = [(p.across, p.down) for p in f.parts]
    for (across, down), p, z in zip(sampled, f.parts, _coefficients(f, coded), strict=True):
        blocks = np.zeros((*z.shape[:2], 64))
        blocks[:, :, ZIGZAG] = z * f.quantisers[p.quantiser]
        px = _WAVES.T @ blocks.reshape(*z.shape[:2], 8, 8) @ _WAVES
        plane = np.clip(np.rint(px + 128), 0, 255).transpose(0, 2, 1, 3).reshape(z.shape[0] * 8, -1)
        if len(f.parts) > 1:
            plane = plane.repeat(most[1] // down, axis=0).repeat(most[0] // across, axis=1)
        planes.append(plane[: f.height, : f.width])
    a = np.stack(planes, axis=2)
    if len(planes) == 3 and f.transform != 0:
        y, b, r = a[:, :, 0], a[:, :, 1] - 128, a[:, :, 2] - 128
        a = np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=2)
    return np.clip(np.rint(a), 0, 255).astype(np.uint8)


def parse_bmp(data: bytes) -> np.ndarray:
    """(rows, cols, 3) of uint8 from 8 bits with a palette, 24 or 32 bits; rows stand from the bottom up unless the height is below zero."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    begin, head, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if bits not in (8, 24, 32) or packed not in (0, 3) or (packed == 3 and bits != 32):
        raise ValueError("only BMP files of 8, 24 or 32 bits without compression are supported")
    step = (width * bits // 8 + 3) // 4 * 4
    raw = np.frombuffer(data, np.uint8, step * abs(height), begin).reshape(abs(height), step)[:, : width * bits // 8]
    a = raw.reshape(abs(height), width, bits // 8)
    if bits == 8:
        colors = np.frombuffer(data, np.uint8, begin - 14 - head, 14 + head)
        a = colors[: len(colors) // 4 * 4].reshape(-1, 4)[a[:, :, 0]]
    return (a if height < 0 else a[::-1])[:, :, 2::-1].copy()
