"""Words of many texts at once: their places, hashes and runs as arrays, and words as symbols of an automaton."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that are hashed at a time.
CHUNK = 1 << 18
DIGIT = 64  # symbols of each digit of a word's number
_SEEDS = np.random.default_rng(7)
_ODD = _SEEDS.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: For each of two independent hashes a number for each byte, and the base of the polynomial.
_BYTES = _SEEDS.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: A table for bytes that leaves words of any bytes but white space as they are, and one that lower-cases A-Z.
SPACES = bytes(0x20 if 0x09 <= c <= 0x0D else c for c in range(256))
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else SPACES[c] for c in range(256))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The powers of a base modulo 2^64."""
    if len(_powers.get(base, ())) < n:
        all_of = np.full(max(n, CHUNK + 1024), base, np.uint64)
        all_of[0] = 1
        _powers[base] = np.cumprod(all_of)
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of several texts in UTF-8, one text after the other.

    table: what each byte becomes first; a space ends a word. first and counts say which words are a text's, text which text is a
    word's, starts and ends where a word is in data, begin where a text is."""

    def __init__(self, texts: list[bytes], table: bytes = SPACES) -> None:
        self.data = np.frombuffer(b" ".join([b"", *texts, b""]).translate(table), np.uint8)
        space = self.data == 0x20
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = edge[0::2], edge[1::2]
        at = np.cumsum([1, *(len(t) + 1 for t in texts)])
        cut = np.searchsorted(self.starts, at)
        self.first, self.counts, self.begin = cut[:-1], np.diff(cut), at[:-1]
        self.text = np.repeat(np.arange(len(texts)), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial of its bytes' numbers."""
        out, i, base = np.empty(len(self), np.uint64), 0, _BASES[which]
        back = pow(base, -1, 1 << 64)
        while i < len(out):
            begin = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, begin + CHUNK, side="right")))
            size = int(self.ends[j - 1] - begin)
            total = np.zeros(size + 1, np.uint64)
            np.cumsum(_BYTES[which][self.data[begin : begin + size]] * _power(base, size), out=total[1:])
            s, e = self.starts[i:j] - begin, self.ends[i:j] - begin
            out[i:j] = mixed((total[e] - total[s]) * _power(back, size)[s] + (e - s).astype(np.uint64))
            i = j
        return out

    def runs_inside(self, k: int) -> np.ndarray:
        """Where runs of k words start that lie in one text."""
        left = np.repeat(self.first + self.counts, self.counts) - np.arange(len(self))
        return np.flatnonzero(left >= k)


def slices(texts: list[bytes], size: int = 16 * CHUNK) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about so many bytes together, but of one text at least."""
    x = held = 0
    for y, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield x, y + 1
            x, held = y + 1, 0
    if x < len(texts):
        yield x, len(texts)


def parts_of(column, size: int = 16 * CHUNK) -> Iterator[tuple[int, list[bytes | None]]]:
    """The values of an Arrow column of bytes in lists of about so many bytes, but of one value at least, each with the place of its first. A list is made when it is asked for,
    so a batch of long texts is not held twice."""
    x = held = 0
    for y, n in enumerate(np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)).tolist() if len(column) else []):
        held += n
        if held >= size:
            yield x, column.slice(x, y + 1 - x).to_pylist()
            x, held = y + 1, 0
    if x < len(column):
        yield x, column.slice(x).to_pylist()


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words, by its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:n] * _ODD[0] + np.uint64(k)
    for i in range(1, k):
        total += hashes[i : i + n] * _ODD[i]
    return mixed(total)


def covered(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of n places lie in a stretch from a start up to its stop."""
    return np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(stops, minlength=n + 1))[:n] > 0


class Symbols:
    """Words, given by hashes, as strings of symbols of one length: the digits of a known word's rank, each place with symbols of its own.

    A node of an automaton then has DIGIT children at most, which matters as they are searched one by one, and no
    match can start inside a word. Other words are strings that no known one shares a symbol with.
    """

    def __init__(self, known: np.ndarray) -> None:
        self.known = np.unique(known)
        self.digits = 1
        while DIGIT**self.digits < len(self.known):
            self.digits += 1
        rank = np.arange(len(self.known))
        self.table = np.zeros((len(self.known) + 1, self.digits), "<u4")  # the last row is for all other words
        for k in range(self.digits):
            self.table[:-1, k] = 1 + DIGIT * k + rank // DIGIT**k % DIGIT

    def of(self, hashes: np.ndarray) -> str:
        at = np.searchsorted(self.known, hashes)
        if len(self.known):
            at[self.known[np.minimum(at, len(self.known) - 1)] != hashes] = len(self.known)
        return self.table[at].tobytes().decode("utf-32-le")
