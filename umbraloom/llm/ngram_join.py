"""Exact set-similarity self-join over word shingles, by the relations between sets.

Documents with the same set are one class from the start. Then, in two rounds:

1. Leaders. Classes that share two minima of their hashed shingles are held against the smallest class among them. This
   finds nearly all links inside groups of near copies with as many comparisons as members, and gives each member a
   leader and its exact overlap with it. Linked classes form components.
2. The rest, exactly. A prefix join: shingles are ordered by a corpus-wide count (rare ones first), and two sets that
   link must share one of their first ones. Index lists are sorted by set size; a position says how large a partner can be,
   so each entry skips to the stretch of its list that can qualify. Pairs inside one component are not formed, and pairs
   whose parity maps differ too much are dropped. A pair's
   answer is derived from its member's leader where possible: |x & y| lies between |x & L| - |L - y| and |x & L| + |y - L|,
   and only pairs that these bounds leave open, between components that are still apart, are compared themselves.

The order of shingles and the leaders decide how much is compared, never the result: each pair of classes that link is
either compared, or its ends are in one component already.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraloom.llm.common import IdFilter, Scratch, components, pieces_of, spread_join, without
from umbraloom.llm.words import LOWER, Words, mixed, parts_of, runs, slices

WIDTH = 5
NUMERATOR, DENOMINATOR = 80, 100  # least similarity
BINS, BANDS = 16, 8
CELLS, CHUNKS = 1 << 20, 64  # of the count of shingles: 8 MB whatever the corpus
SHARD_SHINGLES = 2_000_000  # behind an index shard
LONG = 20_000  # a shingle that may be in more places has its list cut by set size
STEP = np.log(DENOMINATOR / NUMERATOR)  # sizes of linked sets are at most so far apart, as logarithms
PAIRS_AT_ONCE = 2_000_000
PARITY = 2048  # bits of a set's parity map
_ODD_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    texts = [t or b"" for t in texts]
    for x, y in slices(texts):
        words = Words(texts[x:y], LOWER)
        hashes = words.hashes()
        shingles = runs(hashes, width)
        for at, n in zip(words.first.tolist(), words.counts.tolist(), strict=True):
            yield np.unique(shingles[at : at + n - width + 1]) if n >= width else runs(hashes[at : at + n], max(n, 1))


def bands(s: np.ndarray) -> list[int]:
    """Hashes of pairs of minima; a minimum is the least shingle in one of BINS equal parts of the hash space."""
    at = np.searchsorted(s, np.arange(BINS, dtype=np.uint64) << np.uint64(60))
    bound = np.append(at[1:], len(s))
    least = np.where(at < bound, s[np.minimum(at, len(s) - 1)], np.uint64(0))
    pairs = least[0::2] * np.uint64(0x9E3779B97F4A7C15) + (least[1::2] ^ (least[1::2] >> np.uint64(29))) + np.arange(BANDS, dtype=np.uint64)
    return pairs.view(np.int64).tolist()


def parity(s: np.ndarray) -> bytes:
    """A bit for each of PARITY classes of shingles: whether the set has an odd number of them.

    The maps of two sets differ in no more bits than the sets differ in shingles."""
    return np.packbits(np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).tobytes()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def signatures(texts: DataFrame) -> DataFrame:
    """(doc_id, n, key, bands, bits) of each document, and each task's count of shingles as rows (chunk, part, counts)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint64)
        for b in batches:
            n, keys, marks, maps = [], [], [], []
            for _, texts in parts_of(b.column("text")):
                seen = []
                for s in shingle_sets(texts):
                    n.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    marks.append(bands(s) if len(s) else [])
                    maps.append(parity(s))
                    seen.append(((s >> np.uint64(20)) & np.uint64(CELLS - 1)).astype(np.int32))
                cells += np.bincount(np.concatenate(seen), minlength=CELLS).astype(np.uint64)
            none = pa.nulls(b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int32()), pa.array(keys, pa.binary()), pa.array(marks, pa.list_(pa.int64())), pa.array(maps, pa.binary()), none, none, pa.nulls(b.num_rows, pa.binary())], ["doc_id", "n", "key", "bands", "bits", "chunk", "part", "counts"])
        rows = [{"chunk": i, "part": TaskContext.get().partitionId(), "counts": zlib.compress(c.tobytes(), 1)} for i, c in enumerate(cells.reshape(CHUNKS, -1))]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("bits", pa.binary()), ("chunk", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())]))

    return texts.mapInArrow(sign, "doc_id long, n int, key binary, bands array<long>, bits binary, chunk int, part int, counts binary")


def _added(rows: pa.Table) -> pa.Table:
    total = np.zeros(CELLS // CHUNKS, np.uint64)
    for c in rows["counts"]:
        total += np.frombuffer(zlib.decompress(c.as_py()), np.uint64)
    return pa.table({"chunk": rows["chunk"][:1], "part": pa.array([0], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)])})


def corpus_counts(signed: DataFrame) -> np.ndarray:
    """The tasks' counts added up, in two steps so that no step gathers those of all tasks."""
    rows = signed.where("chunk is not null").select("chunk", "part", "counts")
    for keys in (["chunk", F.col("part") % 64], ["chunk"]):
        rows = rows.groupBy(*keys).applyInArrow(lambda t: _added(t), "chunk int, part int, counts binary")
    out = np.zeros(CELLS, np.uint64).reshape(CHUNKS, -1)
    for chunk, _, counts in rows.collect():  # CHUNKS rows, 8 MB in all
        out[chunk] = np.frombuffer(zlib.decompress(counts), np.uint64)
    return out.ravel()


def screened(pairs: DataFrame, signed: DataFrame, ends: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs that can link by their sets' sizes and parity maps: an exact bound at a sixteenth of the sets' bytes."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [b.column(c).to_numpy().astype(np.int64) for c in ("n_x", "n_y")]
            s, t = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, PARITY // 64) for c in ("bits_x", "bits_y"))
            apart = np.maximum(np.bitwise_count(s ^ t).sum(axis=1, dtype=np.int64), np.abs(n[0] - n[1]))
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], ["x", "y"]).filter(pa.array(apart <= n[0] + n[1] - 2 * least_overlap(*n)))

    own = IdFilter(scratch, ends, "doc_id", 2 * pairs.count(), f"{name}_ends").maybe_in(signed.where("chunk is null").select("doc_id", "n", "bits"), "doc_id")
    of = lambda c: own.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    return spread_join(pairs, of("y"), "y", scratch, name).join(of("x"), "x").select("x", "y", "n_x", "n_y", "bits_x", "bits_y").mapInArrow(screen, "x long, y long")


def compared(pairs: DataFrame, sets: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(x, y, n_x, n_y, overlap) for written pairs (x, y), with the sets of both."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_x, n_y, both = [], [], []
            for p, q in zip(b.column("s"), b.column("t"), strict=True):
                s, t = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
                n_x.append(len(s))
                n_y.append(len(t))
                both.append(len(np.intersect1d(s, t, assume_unique=True)))
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), *(pa.array(v, pa.int32()) for v in (n_x, n_y, both))], ["x", "y", "n_x", "n_y", "overlap"])

    near = spread_join(pairs, sets.select(F.col("doc_id").alias("y"), F.col("s").alias("t")), "y", scratch, name).join(sets.select(F.col("doc_id").alias("x"), F.col("s")), "x")
    return near.select("x", "y", "s", "t").mapInArrow(count, "x long, y long, n_x int, n_y int, overlap int")


def sets_of(texts: DataFrame, ids: DataFrame, most: int, scratch: Scratch, name: str) -> DataFrame:
    """(doc_id, s): the sets of the documents in ids, and of others that share their filter bits. Other texts stay where they are."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, part in parts_of(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(x, len(part)), pa.array([s.tobytes() for s in shingle_sets(part)], pa.binary())], ["doc_id", "s"])

    return IdFilter(scratch, ids, "doc_id", most, f"{name}_filter").maybe_in(texts, "doc_id").mapInArrow(build, "doc_id long, s binary")


def least_overlap(n_x, n_y):
    """The least overlap of sets of these sizes that link: ceil(t / (1 + t) * (n_x + n_y))."""
    return -(-(NUMERATOR * (n_x + n_y)) // (NUMERATOR + DENOMINATOR))


def linked() -> F.Column:
    return F.col("overlap") * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (F.col("n_x") + F.col("n_y"))


def prefixes(docs: DataFrame, counts: np.ndarray, n_shards: int) -> DataFrame:
    """Index entries of documents (doc_id, component, text): blocks of entries by shard of the shingles' hashes.

    The list of a shingle that may be long is cut by set size: a set goes to the part of its size and to the next, so two sets that link
    share a part, and each part has a hash of its own in place of the shingle's.
    """
    order = docs.sparkSession.sparkContext.broadcast(counts)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            token, doc, place, size = [], [], [], []
            for k, s in enumerate(s for _, part in parts_of(b.column("text")) for s in shingle_sets(part)):
                n = len(s)
                size.append(n)
                if n:
                    p = n - -(-NUMERATOR * n // DENOMINATOR) + 1
                    seen = order.value[(s >> np.uint64(20)).astype(np.int64) & (CELLS - 1)]
                    first = np.lexsort((s, seen))[:p]
                    own, at = s[first], np.arange(p, dtype=np.int32)
                    long = np.flatnonzero(seen[first] > LONG)
                    if len(long):
                        part = int(np.log(n) / STEP) + np.array([[1], [2]], np.uint64)
                        cut = mixed(own[long] + _ODD_STEP * part)
                        own, at = np.concatenate([np.delete(own, long), *cut]), np.concatenate([np.delete(at, long), at[long], at[long]])
                    token.append(own)
                    doc.append(np.full(len(own), k, np.int32))
                    place.append(at)
            if not token:
                continue
            token, doc, place = map(np.concatenate, (token, doc, place))
            shard = ((token >> np.uint64(32)) * np.uint64(n_shards)) >> np.uint64(32)
            by = np.lexsort((token, shard))
            token, doc, place, shard = token[by], doc[by], place[by], shard[by]
            cut = np.searchsorted(shard, np.arange(n_shards + 1))
            ids, comps, size = b.column("doc_id").to_numpy(), b.column("component").to_numpy(), np.array(size, np.int32)
            rows = []
            for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if y > x:
                    used, local = np.unique(doc[x:y], return_inverse=True)
                    # the shard tells the higher half of a hash; where two lower ones are equal by chance, the pair is compared for nothing
                    cols = {"token": token[x:y].astype(np.uint32), "doc": local.astype(np.int32), "place": place[x:y], "ids": ids[used], "comps": comps[used] - ids[used], "sizes": size[used]}
                    rows.append({"shard": i} | {c: pack(v.tobytes()) for c, v in cols.items()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("token", "doc", "place", "ids", "comps", "sizes"))]))

    return docs.mapInArrow(index, "shard int, token binary, doc binary, place binary, ids binary, comps binary, sizes binary")


def candidates(blocks: pa.Table) -> pa.Table:
    """The pairs of one shard's lists that can link and lie in different components."""
    parts = {c: [] for c in ("token", "place", "id", "comp", "size")}
    unpack = zstandard.ZstdDecompressor().decompress
    for r in blocks.to_pylist():
        doc, token, place, ids, comps, size = (np.frombuffer(unpack(r[c]), k) for c, k in (("doc", np.int32), ("token", np.uint32), ("place", np.int32), ("ids", np.int64), ("comps", np.int64), ("sizes", np.int32)))
        for c, v in (("token", token), ("place", place), ("id", ids[doc]), ("comp", (comps + ids)[doc]), ("size", size[doc])):
            parts[c].append(v)
    token, place, ids, comp, size = (np.concatenate(p) for p in parts.values())
    by = np.lexsort((size, token))  # lists by set size
    token, place, ids, comp, size = token[by], place[by], ids[by], comp[by], size[by].astype(np.int64)
    place = place.astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    length = np.diff(np.append(start, len(token)))
    mixed = np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start)
    keep = np.repeat(mixed, length)  # a list inside one component has nothing left to find
    place, ids, comp, size, length = place[keep], ids[keep], comp[keep], size[keep], length[mixed]
    out = [np.empty((0, 2), np.int64)]
    if len(size):
        listed = np.repeat(np.arange(len(length)), length)
        # of x, as the smaller set: overlap <= n_x - place, so n_y <= (n_x - place) * (1 + t) / t - n_x: skip all that is larger
        most = (size - place) * (NUMERATOR + DENOMINATOR) // NUMERATOR - size
        scale = int(size.max()) + 2
        stop = np.searchsorted(listed * scale + size, listed * scale + np.minimum(most, scale - 1), side="right")
        reach = np.maximum(0, stop - np.arange(len(size)) - 1)
        ends = np.cumsum(reach)
        x0 = 0
        while x0 < len(size):
            x1 = max(x0 + 1, int(np.searchsorted(ends, (ends[x0 - 1] if x0 else 0) + PAIRS_AT_ONCE, side="right")))
            part = reach[x0:x1]
            x = np.repeat(np.arange(x0, x1), part)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(part) - part, part)
            need = least_overlap(size[x], size[y])
            ok = (comp[x] != comp[y]) & (size[y] - place[y] >= need) & (size[x] - place[x] >= need)
            x, y = x[ok], y[ok]
            if len(x):
                out.append(np.unique(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])], axis=1), axis=0))
            x0 = x1
    pairs = np.unique(np.concatenate(out), axis=0)
    return pa.table({"x": pa.array(pairs[:, 0]), "y": pa.array(pairs[:, 1])})


def _rows_apart(texts: DataFrame, scratch: Scratch) -> DataFrame | None:
    """A written table (row, doc_id, text) with a number for each row, if any doc_id repeats."""
    if texts.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return None
    return scratch.keep(texts.withColumn("row", F.monotonically_increasing_id()), "rows")


def ngram_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs, one for one.

    Null and empty texts, and texts of white space, have an empty set and are linked with nothing. Rows that repeat a doc_id have a set each, link
    as any others do, and each has the smallest doc_id that it reaches. Rows without doc_id link with
    nothing and have a null component_id. doc_id must be a number, or text of one. An empty table gives no rows. Other columns
    are not read. Shingles are held as 64-bit hashes.
    """
    scratch = Scratch(docs.sparkSession, "ngram")
    texts = _texts(docs)
    rows = _rows_apart(texts, scratch)
    if rows is None:
        return _components(texts, scratch)
    return _by_row(rows, scratch).drop("row")


def _by_row(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, doc_id, n_shingles, component_id) of a table where ids repeat: rows are linked by their own numbers."""
    ids = rows.select("row", F.col("doc_id").alias("id"))
    got = _components(rows.select(F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("doc_id"), "text"), scratch)
    got = scratch.keep(got.where("doc_id is not null").withColumnRenamed("doc_id", "row").join(ids, "row"), "by_row")
    least = got.groupBy("component_id").agg(F.min("id").alias("least"))
    known = got.join(least, "component_id").select("row", F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))
    lone = rows.where("doc_id is null")
    sizes = signatures(lone.select(F.col("row").alias("doc_id"), "text")).where("chunk is null")
    return known.unionAll(sizes.select(F.col("doc_id").alias("row"), F.lit(None).cast("long"), F.col("n").cast("long"), F.lit(None).cast("long")))


def _components(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The same for texts (doc_id, text) whose ids do not repeat, but for null ones."""
    signed = scratch.keep(signatures(texts), "signed")
    own, texts = signed.where("chunk is null and doc_id is not null"), texts.where("doc_id is not null")
    reps = scratch.keep(own.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "reps")

    # round 1: leaders
    marks = scratch.keep(reps.select("rep", F.explode("bands").alias("band")), "marks")
    leaders = marks.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("c")).where("c > 1").select("band", "leader")
    ends = lambda p: p.select(F.col("x").alias("doc_id")).unionAll(p.select("y")).distinct()
    met = scratch.keep(spread_join(marks, leaders, "band", scratch, "marks").where("rep != leader").select(F.col("rep").alias("x"), F.col("leader").alias("y")).distinct(), "met1")
    pairs = scratch.keep(screened(met, signed, ends(met), scratch, "met1"), "pairs1")
    sets = scratch.keep(sets_of(texts, ends(pairs), 2 * pairs.count(), scratch, "sets1"), "sets1")
    links = scratch.keep(compared(pairs, sets, scratch, "pairs1").where(linked()), "links1")
    scratch.drop("sets1", "marks")
    first = scratch.keep(components(links.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch, "first"), "labels1")
    family = scratch.keep(links.groupBy("x").agg(F.min(F.struct("y", "overlap", "n_x", "n_y")).alias("l")).select(F.col("x").alias("y"), F.col("l.y").alias("leader"), (F.col("l.n_x") - F.col("l.overlap")).alias("more"), (F.col("l.n_y") - F.col("l.overlap")).alias("less")), "family")

    # round 2: documents whose label is not just themselves are looked up; all others are indexed where they are read
    info = own.where("n > 0").join(reps.select("key", "rep"), "key").join(first, F.col("rep") == F.col("node"), "left")
    info = scratch.keep(info.select("doc_id", "n", "rep", F.coalesce("component", "rep").alias("component")).where("doc_id != rep or component != doc_id or node is not null"), "info")
    listed = IdFilter(scratch, info, "doc_id", info.count(), "info_filter")
    plain = listed.not_in(texts, "doc_id").select("doc_id", F.col("doc_id").alias("component"), "text")
    known = listed.maybe_in(texts, "doc_id").join(info, "doc_id", "left").where("rep is null or rep = doc_id").select("doc_id", F.coalesce("component", "doc_id").alias("component"), "text")
    n_shards = pieces_of(own.agg(F.sum("n")).first()[0], SHARD_SHINGLES)
    blocks = prefixes(plain.unionAll(known), corpus_counts(signed), n_shards)
    found = blocks.groupBy("shard").applyInArrow(candidates, "x long, y long")
    met = scratch.keep(found.distinct(), "met2")
    pairs = scratch.keep(screened(met, signed, ends(met), scratch, "met2").join(family, "y", "left"), "pairs2")
    label = first.select(F.col("node"), "component")
    at = lambda df, c: df.join(label.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")), c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))
    through = scratch.keep(pairs.select("x", F.coalesce("leader", "y").alias("y")).where("x != y").distinct(), "asked2")
    sets = scratch.keep(sets_of(texts, ends(through.unionAll(pairs.select("x", "y"))), 3 * pairs.count(), scratch, "sets2"), "sets2")
    known2 = scratch.keep(compared(through, sets, scratch, "through2"), "through2")
    near = at(at(known2.where(linked()), "x"), "y").select("_x", "_y").distinct()
    bound = pairs.where("leader is not null and x != leader").join(known2.select("x", F.col("y").alias("leader"), F.col("overlap").alias("through"), F.col("n_x").alias("size_x"), F.col("n_y").alias("size_l")), ["x", "leader"])
    bound = bound.withColumn("need", F.ceil(NUMERATOR * (F.col("size_x") + F.col("size_l") - F.col("less") + F.col("more")) / F.lit(NUMERATOR + DENOMINATOR)))
    sure = bound.where("through - less >= need")
    open_ = bound.where("through - less < need and through + more >= need - 1")  # one to spare for rounding
    open_ = scratch.keep(at(at(open_, "x"), "y").join(near, ["_x", "_y"], "left_anti").select("x", "y"), "open2")
    links2 = near.unionAll(at(at(sure, "x"), "y").select("_x", "_y")).unionAll(at(at(compared(open_, sets, scratch, "open2").where(linked()), "x"), "y").select("_x", "_y"))
    second = scratch.keep(components(scratch.keep(links2.select(F.col("_x").alias("a"), F.col("_y").alias("b")).distinct(), "links2"), scratch, "second"), "labels2")
    scratch.drop("sets2", "through2", "pairs2")
    out = own.select("doc_id", "n").join(info.select("doc_id", "component"), "doc_id", "left").withColumn("_c", F.coalesce("component", "doc_id"))
    out = out.join(second.select(F.col("node").alias("_c"), F.col("component").alias("_d")), "_c", "left").select("doc_id", "n", F.coalesce("_d", "_c").alias("component_id"))
    return out.unionAll(signed.where("chunk is null and doc_id is null").select("doc_id", "n", F.lit(None).cast("long"))).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their component. Rows without doc_id stay. Of rows that repeat a doc_id, each is judged by its own text; equal ones stay or
    go together. Columns may have any names."""
    scratch = Scratch(docs.sparkSession, "keep_one")
    rows = _rows_apart(_texts(docs), scratch)
    if rows is None:
        gone = scratch.keep(_components(_texts(docs), scratch).where("doc_id != component_id").select(F.col("doc_id").alias("_id")), "gone")
        return without(docs, gone, scratch, "filter")
    told = _by_row(rows, scratch).where("doc_id != component_id").select("row", F.col("doc_id").alias("_id"))
    gone = scratch.keep(told.join(rows.select("row", F.sha2("text", 256).alias("_sha")), "row").select("_id", "_sha"), "gone")
    return without(docs, gone, scratch, "filter", F.sha2(F.col("text").cast("binary"), 256))


SQL = r"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
         k AS (SELECT DISTINCT id, array_to_string(w[s : s + 4], ' ') AS key FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS s FROM d WHERE len(w) > 0)),
         n AS (SELECT id, count(*) AS n FROM k GROUP BY id),
         p AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM k a JOIN k b ON a.key = b.key AND a.id < b.id GROUP BY 1, 2),
         l AS (SELECT x, y FROM p JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
         e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
         r AS (SELECT id AS a, id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (id) JOIN (SELECT r.a AS id, min(d.doc_id) AS component_id FROM r JOIN d ON d.id = r.b GROUP BY r.a) m USING (id)"""
