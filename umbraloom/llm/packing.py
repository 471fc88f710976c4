"""Best-fit packing of tokenised documents into sequences of fixed capacity, large pieces matched first.

Where a piece goes depends on its length alone, so the whole plan is made from the number of pieces of each length: at
most `capacity` numbers, whatever the corpus. The plan is a list of (pattern of lengths, number of sequences). Each piece
then finds its place by its rank among those of its length. Ranks come from a piece's rank within the task that cut
it, plus a running sum over tasks: no length, however common, is gathered anywhere.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbraloom.llm.common import Scratch
from umbraloom.llm.tokens import ByteBpe

CAPACITY = 2048
END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all but the first are full."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with the number of sequences of each, for so many pieces of each length.

    Pieces of more than a third of the capacity come first: the largest is matched with the largest other one that fits
    beside it, so at most two share a sequence. Smaller pieces follow, longest first, each into the smallest gap that
    holds it. Alike pieces and alike gaps are handled together, so the work depends on the number of lengths.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    gaps: dict[int, list[list]] = defaultdict(list)  # by gap: [pattern, number]
    sizes: list[int] = []  # gaps in use, ascending

    def put(pattern: tuple[int, ...], number: int) -> None:
        if not number:
            return
        gap = capacity - sum(pattern)
        if gap not in gaps or not gaps[gap]:
            insort(sizes, gap)
        gaps[gap].append([pattern, number])

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect_left(large, capacity - n + 1) - 1
        mate = large[at] if at >= 0 else None
        if mate is None or mate == n and left[n] < 2:
            if mate is not None and at > 0:  # a single one of its length: the next smaller fits too
                mate = large[at - 1]
            else:
                put((n,), left.pop(n))
                large.pop()
                continue
        k = left[n] // 2 if mate == n else min(left[n], left[mate])
        put((n, mate), k)
        for x in (n, mate):
            left[x] -= k
        for x in {n, mate}:
            if not left[x]:
                del left[x]
                large.remove(x)
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            at = bisect_left(sizes, n)
            if at == len(sizes):  # no gap holds it
                fit = capacity // n
                put((n,) * fit, c // fit)
                put((n,) * (c % fit), 1 if c % fit else 0)
                break
            gap = sizes[at]
            pattern, number = gaps[gap].pop()
            if not gaps[gap]:
                del sizes[at]
            fit = min(gap // n, c)
            # best fit fills one sequence after another: its gap stays the smallest that holds the piece
            whole = min(number, c // fit)
            put((*pattern, *(n,) * fit), whole)
            c -= whole * fit
            number -= whole
            if number and 0 < c < fit:
                put((*pattern, *(n,) * c), 1)
                number, c = number - 1, 0
            put(pattern, number)
    return [(p, k) for held in gaps.values() for p, k in held]


class Places:
    """For each length, which ranks go to which sequences and offsets."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]) -> None:
        self.sequences = 0
        rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        rank: dict[int, int] = defaultdict(int)
        for pattern, number in patterns:
            offset = 0
            for n in pattern:
                rows[n].append((rank[n], self.sequences, offset))
                rank[n] += number
                offset += n
            self.sequences += number
        self.by = {n: np.array(r, np.int64).T for n, r in rows.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for n in np.unique(lengths):
            m = lengths == n
            first, base, at = self.by[int(n)]
            k = np.searchsorted(first, ranks[m], side="right") - 1
            sequence[m], offset[m] = base[k] + ranks[m] - first[k], at[k]
        return sequence, offset


def pieces(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document, with their rank among those of their length in the same task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, seen, part = ByteBpe(vocabulary, pattern, special_as_text=False), defaultdict(int), TaskContext.get().partitionId()
        for b in batches:
            out: list[list] = [[] for _ in range(7 + with_ids)]
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.array([*e.encode(text.as_py() or ""), END], "<u4")
                for k, (start, n) in enumerate(cuts(len(ids), capacity)):
                    own = ids[start : start + n]
                    for c, v in zip(out, (doc_id, k, start, n, zlib.crc32(own.tobytes()), part, seen[n], own.tolist() if with_ids else None), strict=False):
                        c.append(v)
                    seen[n] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place", "ids"][: 7 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds[: 7 + with_ids], strict=False)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for each piece of every row of docs.

    vocabulary is a byte-level tokenizers file, pattern what its texts are split by. Null text is empty, and an empty text has one piece with the end id alone. A null doc_id is passed on; repeated rows are
    packed each. Very long texts, runs of one character among them, have the ids that the tokenizers library gives. doc_id must be a number, or text of one. An empty table gives no rows. Sequences are numbered from 0. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.keep(pieces(docs, vocabulary, pattern, capacity, with_ids), "pieces")
    counted = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = {int(r["length"]): int(r["n"]) for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length: capacity rows at most
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(totals, capacity)))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.value.find(b.column("length").to_numpy(), b.column("rank").to_numpy())
            more = [b.column("ids")] if with_ids else []
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(offset), *more], [*kept, "sequence_id", "offset", *["ids"] * with_ids])

    ranked = cut.join(ranks, ["part", "length"]).select(*kept, (F.col("base") + F.col("place")).cast("long").alias("rank"), *["ids"] * with_ids)
    return ranked.mapInArrow(locate, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from pack(..., with_ids=True). A group holds one capacity at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
