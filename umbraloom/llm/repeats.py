"""Removal of passages that repeat across documents, by automata over repeated phrases.

A window is WINDOW consecutive words. Of the phrases of PHRASE words in it the one with the least hash is its anchor, so equal
windows have equal anchors, and a document has about one anchor for each five words.

Documents lie in buckets of BUCKET_BYTES of text: the text is shuffled once, into a bucketed table, and stays there.

1. Anchors that occur in two documents at least are repeated phrases.
2. The phrases are sharded by the buckets that hold them. For each bucket an Aho-Corasick automaton is compiled over its repeated
   phrases (one example of each suffices), and its documents are streamed through it: every place of a repeated phrase is
   found by its words, and only windows around such places can repeat.
3. Windows that occur in several documents are confirmed by 96 bits of two independent hashes, with the smallest doc_id; the bucket's other documents
   lose the words that such windows of earlier documents cover.

What goes to an index shard is one entry for each phrase or window and bucket, whatever the number of copies, so a passage that a third
of all documents share is no heavy key. Buckets, shards and tasks have a fixed size; their number grows with the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraloom.llm.common import Scratch, pieces_of, shards
from umbraloom.llm.words import Symbols, Words, covered, runs

WINDOW, PHRASE = 13, 5
SPAN = WINDOW - PHRASE + 1  # phrases in a window
#: Bytes of text in a bucket, in a task's file of buckets, and behind an index shard.
BUCKET_BYTES, FILE_BYTES, SHARD_BYTES = 4 << 20, 64 << 20, 16 << 20
ROWS = 1 << 17  # windows that are searched for their anchors at a time
#: Entries as arrays: two hashes, the least doc_id that has it, a place of it there, and whether other documents have it. Phrases have no second hash, windows no place.
KINDS = {"hash": np.uint64, "check": np.uint32, "doc": np.int64, "place": np.int32, "many": np.bool_}
BLOCK = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in KINDS)])
BLOCK_SQL = "shard int, bucket int, hash binary, check binary, doc binary, place binary, many binary"
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
RESULT_SQL = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def anchors(words: Words, phrases: np.ndarray) -> np.ndarray:
    """Where the anchors of the windows are."""
    at, window = words.runs_inside(WINDOW), sliding_window_view(phrases, SPAN) if len(phrases) >= SPAN else None
    return np.unique(np.concatenate([np.empty(0, np.int64), *(x + window[x].argmin(axis=1) for x in (at[k : k + ROWS] for k in range(0, len(at), ROWS)))]))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new key starts in sorted arrays."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def entries(bucket: int, cols: dict[str, np.ndarray], n_shards: int) -> pa.Table:
    """A bucket's blocks for the index shards: each hash once, with the least doc_id that has it and whether others do."""
    if not len(cols["hash"]):
        return pa.Table.from_pylist([], BLOCK)
    cols = {c: v.astype(KINDS[c]) for c, v in cols.items()}
    keys = [cols[c] for c in ("hash", "check") if c in cols]
    by = np.lexsort((cols["doc"], *reversed(keys)))
    cols = {c: v[by] for c, v in cols.items()}
    first = _starts(*(k[by] for k in keys))
    many = np.maximum.reduceat(cols["doc"], first) != cols["doc"][first]
    cols = {c: v[first] for c, v in cols.items()} | {"many": many}
    cut = np.searchsorted(((cols["hash"] >> np.uint64(32)) * np.uint64(n_shards)) >> np.uint64(32), np.arange(n_shards + 1))
    return pa.Table.from_pylist([{"shard": s, "bucket": bucket} | {c: v[x:y].tobytes() for c, v in cols.items()} for s, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x], BLOCK)


def _arrays(rows: pa.Table, columns: Iterable[str]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([np.empty(0, KINDS[c]), *(np.frombuffer(v, KINDS[c]) for v in rows[c].to_pylist())]) for c in columns if not rows[c].null_count}


def answers(blocks: pa.Table, only_later: bool) -> pa.Table:
    """For each bucket the hashes of a shard that occur in several documents.

    With only_later: those that a document of the bucket has after the first one, whose doc_id is then told."""
    cols = _arrays(blocks, KINDS)
    cols["bucket"] = np.repeat(blocks["bucket"].to_numpy(), [len(v) // 8 for v in blocks["hash"].to_pylist()])
    keys = [cols[c] for c in ("hash", "check") if c in cols]
    by = np.lexsort((cols["doc"], *reversed(keys)))
    cols, d, many = {c: v[by] for c, v in cols.items()}, cols["doc"][by], cols["many"][by]
    first = _starts(*(k[by] for k in keys))
    length = np.diff(np.append(first, len(d)))
    least = np.repeat(d[first], length)
    if only_later:
        keep, cols["doc"] = (d > least) | many, least
    else:
        keep = np.repeat((np.maximum.reduceat(d, first) != d[first]) | np.logical_or.reduceat(many, first), length)
    by = np.flatnonzero(keep)
    by = by[np.argsort(cols["bucket"][by], kind="stable")]
    cut = _starts(cols["bucket"][by]) if len(by) else by
    shard, told = blocks["shard"][0].as_py(), [c for c in cols if c not in ("bucket", "many")]
    return pa.Table.from_pylist([{"shard": shard, "bucket": int(cols["bucket"][k[0]])} | {c: cols[c][k].tobytes() for c in told} for k in np.split(by, cut[1:]) if len(k)], BLOCK)


def find(texts: pa.Table, n_shards: int) -> pa.Table:
    """The anchors of one bucket's documents, as entries for the index shards."""
    words, ids = Words(texts["text"].to_pylist()), texts["doc_id"].to_numpy()
    phrases = runs(words.hashes(), PHRASE)
    at = anchors(words, phrases)
    text = words.text[at]
    return entries(texts["bucket"][0].as_py(), {"hash": phrases[at], "doc": ids[text], "place": at - words.first[text]}, n_shards)


def examples(words: Words, ids: np.ndarray, told: pa.Table) -> np.ndarray:
    """Where a bucket's repeated phrases start, each in a document that has it; in all rows of the document."""
    doc, place = _arrays(told, ("doc", "place")).values()
    order = np.argsort(ids, kind="stable")
    left, right = (np.searchsorted(ids[order], doc, side) for side in ("left", "right"))
    many = right - left
    row = order[np.repeat(left - np.cumsum(many) + many, many) + np.arange(many.sum())]
    place = np.repeat(place, many)
    return (words.first[row] + place)[place + PHRASE <= words.counts[row]]


def ends_of(phrases: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where phrases, which are rows of words, end in a sequence of words: the automaton over them, run once over it."""
    symbols, automaton = Symbols(phrases), ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    all_of, size = symbols.of(phrases.ravel()), phrases.shape[1] * symbols.digits
    for k in range(0, len(all_of), size):
        automaton.add_word(all_of[k : k + size])
    if not len(automaton):
        return np.empty(0, np.int64)
    automaton.make_automaton()
    return np.array([e for e, _ in automaton.iter(symbols.of(hashes))], np.int64) // symbols.digits


def locate(texts: pa.Table, told: pa.Table, n_shards: int) -> pa.Table:
    """The windows around repeated phrases of one bucket, as entries for the index shards."""
    if not texts.num_rows or not told.num_rows:
        return pa.Table.from_pylist([], BLOCK)
    words, ids = Words(texts["text"].to_pylist()), texts["doc_id"].to_numpy()
    hashes = words.hashes()
    ends = ends_of(hashes[examples(words, ids, told)[:, None] + np.arange(PHRASE)], hashes)
    near = covered(len(words), np.maximum(ends - WINDOW + 1, 0), np.maximum(ends - PHRASE + 2, 0))
    at = words.runs_inside(WINDOW)
    at = at[near[at]]
    return entries(texts["bucket"][0].as_py(), {"hash": runs(hashes, WINDOW)[at], "check": _check(words, at), "doc": ids[words.text[at]]}, n_shards)


def _check(words: Words, at: np.ndarray) -> np.ndarray:
    return (runs(words.hashes(1), WINDOW)[at] >> np.uint64(32)).astype(np.uint32) if len(at) else np.empty(0, np.uint32)


def _result(doc: int | None, words: list[bytes], kept: list[bytes], with_text: bool) -> dict:
    joined = b" ".join(kept)
    return {"doc_id": doc, "n_words": len(words), "n_removed": len(words) - len(kept), "kept_sha256": hashlib.sha256(joined).hexdigest(), "kept": joined.decode() if with_text else None}


def remove(texts: pa.Table, told: pa.Table, with_text: bool) -> pa.Table:
    """One bucket's documents without the words that windows of earlier documents cover."""
    if not texts.num_rows:
        return pa.Table.from_pylist([], RESULT)
    window, check, first = _arrays(told, ("hash", "check", "doc")).values()
    all_of, ids = texts["text"].to_pylist(), texts["doc_id"].to_numpy()
    words = Words(all_of)
    gone = np.zeros(len(words), bool)
    if len(window):
        by = np.lexsort((check, window))
        window, check, first = window[by], check[by], first[by]
        alike = int(np.diff(np.append(_starts(window), len(window))).max())  # windows under one hash
        low, known = np.uint64((1 << 20) - 1), np.zeros(1 << 20, bool)  # most windows are told apart by a few bits
        known[(window & low).astype(np.int64)] = True
        own, at = runs(words.hashes(), WINDOW), words.runs_inside(WINDOW)
        at = at[known[(own[at] & low).astype(np.int64)]]
        k = np.minimum(np.searchsorted(window, own[at]), len(window) - 1)
        hit = window[k] == own[at]
        at, k = at[hit], k[hit]
        own, second, doc, later = own[at], _check(words, at), ids[words.text[at]], np.zeros(len(at), bool)
        for more in range(alike):
            j = np.minimum(k + more, len(window) - 1)
            later |= (window[j] == own) & (check[j] == second) & (first[j] < doc)
        gone = covered(len(words), at[later], at[later] + WINDOW)
    touched = np.bincount(words.text[gone], minlength=len(ids)) > 0
    out = []
    for d, text, x, n, less in zip(ids.tolist(), all_of, words.first.tolist(), words.counts.tolist(), touched.tolist(), strict=True):
        own = text.split()
        out.append(_result(d, own, list(compress(own, (~gone[x : x + n]).tolist())) if less else own, with_text))
    return pa.Table.from_pylist(out, RESULT)


def untouched(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """The results of documents that lose nothing."""
    for b in batches:
        rows = [_result(None, w, w, with_text) for w in (t.as_py().split() for t in b.column("text"))]
        yield pa.RecordBatch.from_pylist(rows, RESULT)


def remove_repeats(docs: DataFrame, with_text: bool = True, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row of docs; kept, the words that stay, is null unless with_text.

    Null texts, and texts without words, have none and lose none. A window that repeats inside one document only is kept, and so
    is it in all rows that share the smallest doc_id; rows that repeat a doc_id get a row each. A row without doc_id
    comes before and after no other: it keeps its words and takes none away. doc_id must be a number, or text of one.
    An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    n = pieces_of(total, SHARD_BYTES)
    ids = F.col("doc_id").cast("long")
    bucket = F.pmod(F.xxhash64(ids), F.lit(pieces_of(total, bucket_bytes))).cast("int")
    files = max(pieces_of(total, FILE_BYTES), shards(docs.sparkSession))  # with fewer than the session's partitions Spark would shuffle them again
    by = scratch.keep_bucketed(docs.select(ids.alias("doc_id"), bucket.alias("bucket"), text.alias("text")).where("doc_id is not null"), "texts", files, "bucket").groupBy("bucket")
    index = lambda found, later: found.groupBy("shard").applyInArrow(lambda t: answers(t, later), BLOCK_SQL)
    phrases = scratch.keep(index(by.applyInArrow(lambda t: find(t, n), BLOCK_SQL), False).select("bucket", "doc", "place"), "phrases")
    found = by.cogroup(phrases.groupBy("bucket")).applyInArrow(lambda a, b: locate(a, b, n), BLOCK_SQL)
    windows = scratch.keep(index(found, True).select("bucket", "hash", "check", "doc"), "windows")
    scratch.drop("phrases")
    out = by.cogroup(windows.groupBy("bucket")).applyInArrow(lambda a, b: remove(a, b, with_text), RESULT_SQL)
    none = docs.where(ids.isNull()).select(text.alias("text")).mapInArrow(lambda it: untouched(it, with_text), RESULT_SQL)
    return out.unionAll(none)


SQL = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
         k AS (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS key FROM (SELECT *, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
         f AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key),
         h AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS pos FROM k JOIN f USING (key) WHERE first < doc_id),
         x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
         g AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM x ANTI JOIN h USING (doc_id, pos) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""
