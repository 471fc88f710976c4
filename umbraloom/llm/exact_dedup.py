"""Exact dedup by a log-structured merge index over digests.

Each task collects (digest, id) in a memtable, and flushes it when full as sorted runs, one for each shard of the digest
space, each with its Bloom filter. Compaction merges a shard's runs, a few at a time, keeps each digest's smallest
id and adds up its rows; the filters tell which digests of a run can occur in others at all, so only those are
compared. A hit (a digest of several rows) is then verified byte by byte against the text of the id that stays; texts
that differ under one digest are grouped by their bytes instead.

A run holds each digest once, so a text with any number of copies sends at most one entry from each memtable:
no shard grows with a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraloom.llm.common import LAST, IdFilter, Scratch, fresh, pieces_of, spread_join, without

MEMTABLE_ROWS = 200_000
#: Rows behind an index shard; rows of a digest, and most digests, that are broadcast with their answer.
SHARD_ROWS, HOT_ROWS, HOT_DIGESTS = 500_000, 10_000, 100_000
FAN_IN = 8
FILTER_BITS, FILTER_PROBES = 12, 4  # bits for each digest, cells for each digest
RUN = pa.schema([("shard", pa.int32()), ("run", pa.string()), ("digests", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("filter", pa.binary())])
RUN_SQL = "shard int, run string, digests binary, ids binary, counts binary, filter binary"
#: Runs of white space other than one space; only these need a replacement.
ODD_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ODD_SPACE, " ")


def _cells(digests: np.ndarray, cells: int) -> np.ndarray:
    """Where a filter of so many cells has its bits for each digest, one row for each probe."""
    words = np.frombuffer(digests.tobytes(), ">u8").reshape(len(digests), -1).astype(np.uint64)
    a, b = words[:, 0] * np.uint64(0x9E3779B97F4A7C15), words[:, -1] | np.uint64(1)
    return np.stack([((a + np.uint64(i) * b) >> np.uint64(7)) % np.uint64(cells) for i in range(FILTER_PROBES)])


def make_filter(digests: np.ndarray) -> bytes:
    bits = np.zeros(max(64, FILTER_BITS * len(digests) + 7 & ~7), bool)
    bits[_cells(digests, len(bits)).ravel()] = True
    return np.packbits(bits).tobytes()


def accepts(filter_: bytes, digests: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(filter_, np.uint8)
    at = _cells(digests, 8 * len(bits))
    return ((bits[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=0)


def merge(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], filters: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One sorted run out of several: the smallest id and the sum of counts of each digest."""
    shared = [np.zeros(len(d), bool) for d, _, _ in runs]
    for i, (d, _, _) in enumerate(runs):
        for j, f in enumerate(filters):
            if i != j and len(d):
                shared[i] |= accepts(f, d)
    alone = [[x[~m] for x in r] for r, m in zip(runs, shared, strict=True)]
    met = [np.concatenate([r[k][m] for r, m in zip(runs, shared, strict=True)]) for k in range(3)]
    if len(met[0]):
        order = np.lexsort((met[1], met[0]))
        d, i, c = (x[order] for x in met)
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        met = [d[first], i[first], np.add.reduceat(c, first)]
    out = [np.concatenate([met[k], *(a[k] for a in alone)]) for k in range(3)]
    order = np.argsort(out[0], kind="stable")
    return out[0][order], out[1][order], out[2][order]


def _packed(d: np.ndarray, i: np.ndarray, c: np.ndarray) -> dict:
    return {"digests": d.tobytes(), "ids": i.tobytes(), "counts": c.tobytes(), "filter": make_filter(d)}


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return np.frombuffer(row["digests"], f"S{len(row['digests']) // max(1, len(ids)) or 32}"), ids, np.frombuffer(row["counts"], np.int64)


def flush(batches: Iterator[pa.RecordBatch], n_shards: int, memtable_rows: int) -> Iterator[pa.RecordBatch]:
    """A task's memtables as sorted runs by shard."""
    held, rows, seq = [], 0, 0

    def sorted_runs() -> pa.RecordBatch:
        d, i = (np.concatenate([h[k] for h in held]) for k in range(2))
        order = np.lexsort((i, d))
        d, i = d[order], i[order]
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        c = np.diff(np.append(first, len(d))).astype(np.int64)
        d, i = d[first], i[first]
        lead = np.frombuffer(d.tobytes(), ">u4").reshape(len(d), -1)[:, 0].astype(np.uint64)
        cut = np.searchsorted((lead * np.uint64(n_shards)) >> np.uint64(32), np.arange(n_shards + 1))
        run = f"{TaskContext.get().partitionId()}-{seq}"
        return pa.RecordBatch.from_pylist([{"shard": s, "run": run} | _packed(d[x:y], i[x:y], c[x:y]) for s, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x], RUN)

    for b in batches:
        if not b.num_rows:
            continue
        col = b.column("digest")
        width = len(col[0].as_py())
        held.append((np.array(col.to_pylist(), f"S{width}"), b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)))
        rows += b.num_rows
        if rows >= memtable_rows:
            yield sorted_runs()
            held, rows, seq = [], 0, seq + 1
    if rows:
        yield sorted_runs()


def compact(runs: pa.Table) -> pa.Table:
    """All runs of one shard as one, FAN_IN at a time."""
    rows = [(_unpacked(r), r["filter"]) for r in runs.sort_by("run").to_pylist()]
    while len(rows) > 1:
        merged = []
        for k in range(0, len(rows), FAN_IN):
            part = rows[k : k + FAN_IN]
            one = part[0][0] if len(part) == 1 else merge([r for r, _ in part], [f for _, f in part])
            merged.append((one, part[0][1] if len(part) == 1 else make_filter(one[0])))
        rows = merged
    return pa.Table.from_pylist([{"shard": runs["shard"][0].as_py(), "run": "compacted"} | _packed(*rows[0][0])], RUN)


def build_index(digests: DataFrame, n_shards: int, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """The compacted index of (doc_id, digest): a row for each shard."""
    runs = digests.mapInArrow(lambda it: flush(it, n_shards, memtable_rows), RUN_SQL)
    return runs.groupBy("shard").applyInArrow(compact, RUN_SQL)


def hits(index: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of the digests with several rows."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                d, i, c = _unpacked(r)
                m = c > 1
                raw, w = r["digests"], d.itemsize
                yield pa.RecordBatch.from_arrays([pa.array([raw[w * k : w * k + w] for k in np.flatnonzero(m)], pa.binary()), pa.array(i[m]), pa.array(c[m])], ["digest", "keep_id", "group_size"])

    return index.select("digests", "ids", "counts").mapInArrow(unpack, "digest binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, digest_bytes: int = 32, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every document.

    Texts are equal when they are after each run of white space has become one space. Null text counts as empty, and
    empty texts are equal to each other. Each row has a result of its own, rows that repeat a doc_id among them: they count in
    group_size, and all rows with the smallest doc_id of a text are kept. A doc_id with different texts is judged by each text. A null doc_id is an id like others that comes after all of
    them. doc_id must be a number, or text of one, below 2^63 - 1. An empty table gives no rows. Other columns are not read. digest_bytes, a
    multiple of 8, shortens the digests of the index; results are the same for any, as hits are verified.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    norm, ids = normalised(F.col("text")), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id")
    seen = scratch.keep(docs.select(ids, F.unhex(F.sha2(norm, 256)).alias("sha")), "digests")
    one, rows = seen.select("doc_id", "sha", F.substring("sha", 1, digest_bytes).alias("digest")), seen.count()
    n_shards = pieces_of(rows, SHARD_ROWS)
    index = scratch.keep(build_index(one.select("doc_id", "digest"), n_shards, memtable_rows), "index")
    found = scratch.keep(hits(index), "hits")
    # a digest of many rows is broadcast with its answer: there are few, as their rows add up to no more than the table's
    many = max(HOT_ROWS, rows // HOT_DIGESTS)
    hot = scratch.keep(found.where(F.col("group_size") > many), "hot")
    known = one.join(F.broadcast(hot), "digest", "left")
    rest = known.where("keep_id is null").select(*one.columns).join(found.where(F.col("group_size") <= many), "digest", "left")
    joined = scratch.keep(known.where("keep_id is not null").unionAll(rest.select(*known.columns)), "joined")

    # verify: members of a group, and the texts they are held against; only texts that may be hits leave their place
    member = joined.where("keep_id is not null").select("doc_id", "digest", "sha", "keep_id")
    grouped = joined.where("keep_id is not null").count()
    text = IdFilter(scratch, member, "doc_id", grouped, "filter").maybe_in(docs.select(ids, norm.alias("norm")), "doc_id")
    own = text.select("doc_id", "norm", F.unhex(F.sha2("norm", 256)).alias("sha"))
    if not member.groupBy("doc_id", "sha").count().where("count > 1").isEmpty():  # repeated rows: one text for each
        own = own.dropDuplicates(["doc_id", "sha"])
    keys = ["doc_id", "sha"]
    kept = member.where("doc_id = keep_id").select("digest", *keys).distinct().join(own, keys).groupBy("digest").agg(F.min("norm").alias("kept_norm"))
    others = scratch.keep(member.where("doc_id != keep_id"), "others")
    held = spread_join(others, kept, "digest", scratch, "others").join(own, keys)
    differ = scratch.keep(held.where("norm != kept_norm").select("doc_id", "digest", "sha", "norm"), "differ")
    scratch.drop("digests", "index", "hits", "hot", "filter", "others", "others_heavy")  # what is returned reads the other two
    out = joined
    if not differ.isEmpty():
        apart = differ.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep2"), F.count("*").alias("n2"))
        moved = differ.join(apart, ["digest", "norm"]).select("doc_id", "sha", "keep2", "n2").distinct()
        fewer = differ.groupBy("digest").agg(F.count("*").alias("less"))
        out = joined.join(moved, ["doc_id", "sha"], "left").join(fewer, "digest", "left").select(
            "doc_id", "sha", F.coalesce("keep2", "keep_id").alias("keep_id"), F.coalesce("n2", F.col("group_size") - F.coalesce("less", F.lit(0))).alias("group_size"))
    keep = F.coalesce("keep_id", "doc_id")
    real = lambda c: F.nullif(c, F.lit(LAST))
    return out.select(real(F.col("doc_id")).alias("doc_id"), real(keep).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("doc_id") == keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: the first of equal texts. A row that repeats both doc_id and text stays once; of a doc_id with
    several texts each text is judged by itself. Columns may have any names."""
    scratch = Scratch(docs.sparkSession, "keep_first")
    told = exact_dedup(docs.select("doc_id", "text"))
    members = scratch.keep(told.where("group_size > 1").select(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), F.col("text_sha256").alias("_sha"), "kept"), "members")
    digest = F.sha2(normalised(F.col("text")), 256)
    twice = scratch.keep(members.where("kept").groupBy("_id", "_sha").count().where("count > 1").select("_id", "_sha"), "twice")
    left = without(docs, members.where("not kept").select("_id", "_sha"), scratch, "gone", digest)
    if twice.isEmpty():
        return left
    # rows that repeat others: one of each stays, beside all other rows
    own, mine = fresh(docs, "_own"), fresh(docs, "_mine")
    marked = docs.withColumns({own: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), mine: digest})
    again = marked.join(twice, (F.col(own) == twice["_id"]) & (F.col(mine) == twice["_sha"]), "left_semi").dropDuplicates([own, mine]).drop(own, mine)
    return without(left, twice, scratch, "repeated", digest).unionAll(again)
