"""Alignment of two tokenizers' tokens by a dangling-suffix transducer.

Two token strings spell the same bytes. Reading both at once, one side leads by some bytes that the other has not reached: the residual, the
dangling suffix of the leading token. The next token comes from the side that is behind; it leaves a shorter residual of the same side, or
one of its own side, or none, and then a group closes. What a token does to a residual depends on the two alone, so transitions are
kept in a table and computed once in a worker. Each step is one link: the token just read overlaps the token that leads.

A pair's count is how many documents hold it linked. The most frequent pairs, of a bounded number, are broadcast with their counts; documents get those of
all other pairs by a join. Both ways give the same numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraloom.llm.common import Scratch, frequent
from umbraloom.llm.tokens import ByteBpe, Pieces

#: Most pairs whose counts are broadcast: 16 MB.
BROADCAST = 1 << 20
#: Most transitions that a worker keeps.
KEPT = 1 << 20
A_LEADS, B_LEADS = 0, 1


class Transducer:
    """States are residuals with the side that leads: above 0 those of B, below 0 those of A; state 0 is the empty residual."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]) -> None:
        self.bytes, self.width = (a_bytes, b_bytes), len(b_bytes)
        self.span = max(len(a_bytes), len(b_bytes))
        self.clear()

    def clear(self) -> None:
        """Forgets all transitions."""
        self.ids: dict[tuple[int, bytes], int] = {}
        self.states: dict[int, tuple[int, bytes]] = {0: (A_LEADS, b"")}
        self.moves: dict[int, int] = {}  # by state and next token: the state after
        self.opened: dict[int, int | str] = {}  # by the two next tokens, from the empty residual: the state after, or the group that they are

    def state(self, side: int, residual: bytes) -> int:
        if not residual:
            return 0
        if (got := self.ids.get(key := (side, residual))) is None:
            got = self.ids[key] = len(self.states) if side == B_LEADS else -len(self.states)
            self.states[got] = key
        return got

    def after(self, side: int, residual: bytes, token: bytes) -> int:
        """The state after the side that is behind reads a token."""
        if len(token) <= len(residual):
            if not residual.startswith(token):
                raise ValueError("the two token strings spell different bytes")
            return self.state(side, residual[len(token) :])
        if not token.startswith(residual):
            raise ValueError("the two token strings spell different bytes")
        return self.state(1 - side, token[len(residual) :])

    def align(self, a: list[int], b: list[int]) -> tuple[list[int], list[str]]:
        """Links as numbers a * width + b in reading order, and each closed group as text. A ValueError where the lists do not spell the same bytes."""
        links, groups, width, span = [], [], self.width, self.span
        if len(self.moves) + len(self.opened) > KEPT:
            self.clear()
        moves, opened, link, close = self.moves.get, self.opened.get, links.append, groups.append
        i = j = 0
        n, m = len(a), len(b)
        try:
            while i < n:
                x, y = a[i], b[j]
                pair = x * width + y
                link(pair)
                s = opened(pair)
                if s is None:
                    s = self.after(A_LEADS, self.bytes[0][x], self.bytes[1][y]) or f"{x}|{y}"
                    self.opened[pair] = s
                i += 1
                j += 1
                if s.__class__ is str:  # most groups are one token of each
                    close(s)
                    continue
                i0, j0 = i - 1, j - 1
                while s:
                    if s > 0:  # b leads, so a reads
                        x = a[i]
                        i += 1
                        t = moves(s * span + x)
                        if t is None:
                            t = self.moves[s * span + x] = self.after(*self.states[s], self.bytes[0][x])
                    else:
                        y = b[j]
                        j += 1
                        t = moves(s * span + y)
                        if t is None:
                            t = self.moves[s * span + y] = self.after(*self.states[s], self.bytes[1][y])
                    link(x * width + y)
                    s = t
                if i - i0 == 1 and j - j0 == 2:
                    close(f"{x}|{b[j0]},{y}")
                elif i - i0 == 2 and j - j0 == 1:
                    close(f"{a[i0]},{x}|{y}")
                else:
                    close(f"{','.join(map(str, a[i0:i]))}|{','.join(map(str, b[j0:j]))}")
        except IndexError:
            j = -1
        if j != m:
            raise ValueError("the two token strings spell different bytes")
        return links, groups


_FIELDS = [("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<long>, times array<int>"


def aligned(docs: DataFrame, encoders: Callable[[], tuple[ByteBpe, Pieces]], with_groups: bool = False) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups, pairs, times) for every row of docs: pairs are the document's different
    linked pairs as a * (B's size) + b, times how many links each has. row numbers rows by task; groups is null unless asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = encoders()
        machine, row = Transducer(first.bytes, second.bytes), TaskContext.get().partitionId() << 40
        a_of = first.bytes.__getitem__
        for batch in batches:
            out, size = [[] for _ in _FIELDS], 0
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text, a, b, links, groups = value.as_py() or "", [], [], [], []
                if text:
                    whole = " " + text
                    a, b = first.encode(whole), second.encode(text)
                    try:  # the transducer reads every byte of both, so B's bytes are A's
                        if b"".join(map(a_of, a)) != whole.encode():
                            raise ValueError("the tokens do not spell the text")
                        links, groups = machine.align(a, b)
                    except ValueError:
                        a, b, links, groups = [], [], [], []
                pairs, times = np.unique(np.array(links, np.int64), return_counts=True)
                told = ";".join(groups)
                sha = hashlib.sha256(told.encode()).hexdigest() if groups else ""
                for c, v in zip(out, (row, doc_id, len(a), len(b), len(groups), len(links), sha, told if with_groups else None, pairs, times.astype(np.int32)), strict=True):
                    c.append(v)
                row, size = row + 1, size + len(text)
                if size > 8 << 20:
                    yield _batch(out)
                    out, size = [[] for _ in _FIELDS], 0
            if out[0]:
                yield _batch(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ALIGNED)


def _batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def pair_counts(table: DataFrame, width: int) -> DataFrame:
    """(pair, n, best) for every pair that any document links: how many documents do, and whether no other pair of its A id has more."""
    counts = table.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    return counts.withColumn("a", F.expr(f"pair div {width}"))


def align_tokenizers(docs: DataFrame, encoders: Callable[[], tuple[ByteBpe, Pieces]], width: int, with_groups: bool = False, most: int = BROADCAST) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) for every row of docs, one for one.

    encoders gives both encoders, width is the size of B's vocabulary; most bounds the pairs that are broadcast and does not change results.
    Null and empty texts, and texts that either side does not spell byte by byte (with a space before), have no tokens: zeros and an empty digest.
    A null doc_id is passed on; repeated rows are documents of their own, and count as such. Very long texts take time in proportion. An
    empty table gives no rows. Other columns are not read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    held = scratch.keep(aligned(docs, encoders, with_groups), "aligned")
    counts = scratch.keep(pair_counts(held, width), "counts")
    # a row for each id of A: as many as its vocabulary at most
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    ranked = scratch.keep(counts.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "ranked")
    common = frequent(ranked, "n", most)
    hot = ranked.where(common).select("pair", "n", "best").toArrow().sort_by("pair")  # `most` rows at most
    table = docs.sparkSession.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = table.value
        for b in batches:
            pairs, times = b.column("pairs"), b.column("times").flatten().to_numpy().astype(np.int64)
            flat, cut = pairs.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())]).astype(np.int64)
            at = np.minimum(np.searchsorted(keys, flat), max(0, len(keys) - 1))
            known = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            sums = [np.concatenate([[0], np.cumsum(v)]) for v in ((times * best[at] * known, times * n[at] * known) if len(keys) else (times * 0, times * 0))]
            rest = np.concatenate([[0], np.cumsum(~known)]).astype(np.int32)[cut]
            lists = lambda v, t: pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(v[~known], t))
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(np.diff(s[cut])) for s in sums), lists(flat, pa.int64()), lists(times, pa.int64())], ["row", "n_best", "count_sum", "pairs", "times"])

    summed = scratch.keep(held.select("row", "pairs", "times").mapInArrow(look_up, "row long, n_best long, count_sum long, pairs array<long>, times array<long>"), "summed")
    rare = summed.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("k"))
    more = rare.join(ranked.where(~common), "pair").groupBy("row").agg(F.sum(F.col("k") * F.col("best").cast("long")).alias("b"), F.sum(F.col("k") * F.col("n")).alias("c"))
    both = summed.select("row", "n_best", "count_sum").unionAll(more.select("row", "b", "c")).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups]
    return held.drop("pairs", "times").join(both, "row").select(*kept)
