"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items, one scan of each text.

Each window is represented by its least hashed phrase of PHRASE words, which the automaton looks for; where one occurs, the windows around it
are looked up and confirmed by 128 bits. So the automaton grows with the items' words and not with their windows' lengths. Its
symbols are digits of word numbers, so a step is short whatever the vocabulary. Words are found in the text's bytes as they are
(lower-casing A-Z moves nothing), so each word has its place in the original.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraloom.llm.common import Scratch
from umbraloom.llm.words import Symbols, Words, covered, runs, slices

WINDOW, PHRASE = 10, 3
#: Bytes of test items in one automaton. More items are scanned for in further blocks of this size.
BLOCK_BYTES = 16 << 20
#: For bytes of UTF-8: A-Z become a-z; what is neither digit, letter nor beyond ASCII becomes a space.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
HITS = pa.list_(pa.struct([("word", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


class Items:
    """A block of test items as they are sent to the workers."""

    def __init__(self, items: list[tuple[str, str]]) -> None:
        self.items, self.token = items, uuid.uuid4().hex


class Matcher:
    """The automaton and the windows of a block of items: for each length of windows their two hashes, sorted, with the item of each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.names = [name for name, _ in items]
        words = Words([text.encode() for _, text in items], FOLD)
        hashes, checks = words.hashes(), words.hashes(1)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        phrases: dict[int, list[np.ndarray]] = {}
        for n in range(1, window + 1):
            at = words.runs_inside(n)
            if n < window:  # an item of fewer words is one window
                at = at[words.counts[words.text[at]] == n]
            if not len(at):
                continue
            h, c, item, m = runs(hashes, n)[at], runs(checks, n)[at], words.text[at], min(PHRASE, n)
            by = np.lexsort((item, c, h))
            self.windows[n] = h[by], c[by], item[by]
            least = sliding_window_view(runs(hashes, m), n - m + 1)[at].argmin(axis=1)
            phrases.setdefault(m, []).append(hashes[np.unique(at + least)[:, None] + np.arange(m)])
        self.symbols = Symbols(np.concatenate([np.empty(0, np.uint64), *(p.ravel() for of in phrases.values() for p in of)]))
        self.automaton = ahocorasick.Automaton()
        for m, of in phrases.items():
            rows = np.unique(np.concatenate(of), axis=0)
            text, size = self.symbols.of(rows.ravel()), m * self.symbols.digits
            for k in range(0, len(text), size):
                self.automaton.add_word(text[k : k + size], m)
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, item) of each window that occurs in texts, one row for each of its items."""
        none = np.empty(0, np.int64)
        if not len(self.automaton) or not len(words):
            return none, none, none
        hashes = words.hashes()
        met = np.array([(e, m) for e, m in self.automaton.iter(self.symbols.of(hashes))], np.int64).reshape(-1, 2)
        if not len(met):
            return none, none, none
        size, first = met[:, 1], met[:, 0] // self.symbols.digits - met[:, 1] + 1
        checks, out = words.hashes(1), [(none, none, none)]
        for n, (h, c, item) in self.windows.items():
            own = first[size == min(PHRASE, n)]
            if not len(own):
                continue
            at = words.runs_inside(n)
            at = at[covered(len(words), np.maximum(own - n + min(PHRASE, n), 0), own + 1)[at]]
            key = runs(hashes, n)[at]
            left, right = np.searchsorted(h, key, "left"), np.searchsorted(h, key, "right")
            many = right - left
            entry = np.repeat(left - np.cumsum(many) + many, many) + np.arange(many.sum())
            at = np.repeat(at, many)
            same = c[entry] == runs(checks, n)[at]
            out.append((at[same], np.full(int(same.sum()), n), item[entry[same]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_compiled: dict[str, Matcher] = {}


def matcher(items: Items) -> Matcher:
    """Compiled once in each worker, which keeps the last one from task to task."""
    if items.token not in _compiled:
        _compiled.clear()
        _compiled[items.token] = Matcher(items.items)
    return _compiled[items.token]


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in blocks of bounded size, one at a time on the driver; one block at least."""
    held, size, seen = [], 0, False
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").where("item_id is not null and text is not null").toLocalIterator():
        held.append((item, text))
        size += len(text)
        if size >= block_bytes:
            yield Items(held)
            held, size, seen = [], 0, True
    if held or not seen:
        yield Items(held)


def _places(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Places of bytes as code points."""
    points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return (points[starts] - 1).tolist(), points[ends - 1].tolist()


def scanned(texts: list[bytes | None], m: Matcher) -> Iterator[tuple[int, list[dict], list[str]]]:
    """For each text its number of words, its hit words with their places in code points, and the sorted items."""
    texts = [t or b"" for t in texts]
    for x, y in slices(texts):
        part = texts[x:y]
        words = Words(part, FOLD)
        start, length, item = m.found(words)
        hit = np.flatnonzero(covered(len(words), start, start + length)) if len(start) else start
        cut = np.searchsorted(words.text[hit], np.arange(len(part) + 1))
        pairs = np.unique(np.stack([words.text[start], item], axis=1), axis=0) if len(start) else np.empty((0, 2), np.int64)
        of = np.searchsorted(pairs[:, 0], np.arange(len(part) + 1))
        for k, n in enumerate(words.counts.tolist()):
            own, hits = hit[cut[k] : cut[k + 1]], []
            if len(own):
                a, b = _places(part[k], words.starts[own] - words.begin[k], words.ends[own] - words.begin[k])
                hits = [{"word": w, "start": s, "end": e} for w, s, e in zip((own - words.first[k]).tolist(), a, b, strict=True)]
            yield n, hits, sorted({m.names[i] for i in pairs[of[k] : of[k + 1], 1]})


def _scan(docs: DataFrame, found: Items) -> DataFrame:
    """(doc_id, text_sha256, n_words, hits, items): hits are the words of windows with their places in the original text, in code points."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    items = docs.sparkSession.sparkContext.broadcast(found)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(items.value)
        for b in batches:
            n, hits, names = ([], [], []) if not b.num_rows else map(list, zip(*scanned(b.column("text").to_pylist(), m), strict=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_sha256"), pa.array(n, pa.int64()), pa.array(hits, HITS), pa.array(names, pa.list_(pa.string()))], ["doc_id", "text_sha256", "n_words", "hits", "items"])

    text = F.col("text").cast("binary")
    return docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("text_sha256")).mapInArrow(scan, f"doc_id {ids}, text_sha256 string, n_words long, hits array<struct<word:int,start:int,end:int>>, items array<string>")


#: Runs of hit words as places.
SPANS = """zip_with(filter(hits, (h, k) -> k = 0 or hits[k - 1].word + 1 < h.word), filter(hits, (h, k) -> k = size(hits) - 1 or hits[k + 1].word > h.word + 1),
           (a, b) -> named_struct('start', a.start, 'end', b.end))"""


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans) for every row of docs, one for one.

    Null or empty texts have no words and no hits; null items, or items without words, have no windows; an item_id that
    repeats unites its texts' windows. An empty benchmark hits nothing, an empty docs gives no rows. A null doc_id
    is passed on, and repeated rows get a row each, whatever the number of blocks. Other columns are not read.
    """
    scans = [_scan(docs, w) for w in blocks(benchmark, block_bytes)]
    out = scans[0]
    if len(scans) > 1:
        for s in scans[1:]:
            out = out.unionAll(s)
        # rows of the same doc_id and text have the same hits: each group's rows come back as often as they were
        union = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_set(c))))
        out = out.groupBy("doc_id", "text_sha256", "n_words").agg(union("hits").alias("hits"), union("items").alias("items"), F.count("*").alias("n"))
        out = out.withColumn("n", F.explode(F.sequence(F.lit(1), F.expr(f"n div {len(scans)}"))))
    n = F.size("hits").cast("long")
    return out.select("doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n > 0).alias("contaminated"), "items", F.expr(SPANS).alias("spans"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of an item; rows without text or doc_id are judged like any other.

    No shuffle: rows are judged where they are. With several blocks a table is written between two, so a worker holds one automaton.
    """
    scratch, parts = Scratch(docs.sparkSession, "clean"), list(blocks(benchmark, block_bytes))
    for k, items in enumerate(parts):
        docs = _keep_clean(docs if k == 0 else scratch.keep(docs, f"block{k}"), items)
    return docs


def _keep_clean(docs: DataFrame, found: Items) -> DataFrame:
    items = docs.sparkSession.sparkContext.broadcast(found)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(items.value)
        for b in batches:
            texts, clean = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()], np.ones(b.num_rows, bool)
            for x, y in slices(texts):
                words = Words(texts[x:y], FOLD)
                clean[x + words.text[m.found(words)[0]]] = False
            yield b.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)


SQL = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
                      regexp_extract_all(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS pieces FROM documents),
         i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
         k AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS key
               FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)),
         lens AS (SELECT DISTINCT n FROM k),
         o AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS key
               FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
         h AS (SELECT o.doc_id, o.s, o.n, k.item_id FROM o JOIN k ON o.n = k.n AND o.key = k.key),
         x AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS pos FROM h),
         p AS (SELECT doc_id, count(*) AS n_hit FROM x GROUP BY doc_id),
         q AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY doc_id),
         e AS (SELECT doc_id, pos, sum(len(piece)) OVER (PARTITION BY doc_id ORDER BY pos) AS stop, len(word) AS n
               FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(pieces) AS piece, unnest(w) AS word FROM d WHERE doc_id IN (SELECT doc_id FROM p))),
         g AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM x),
         r AS (SELECT doc_id, run, min(stop - n) AS start, max(stop) AS stop FROM g JOIN e USING (doc_id, pos) GROUP BY doc_id, run),
         t AS (SELECT doc_id, string_agg(start::BIGINT || '-' || stop::BIGINT, ',' ORDER BY start) AS spans FROM r GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
           sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
    FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id) LEFT JOIN t USING (doc_id)"""
