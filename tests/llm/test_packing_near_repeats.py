"""Packing, shingle join, repeated passages and the pipeline, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from umbraloom.llm.common import table
from umbraloom.llm.ngram_join import keep_one, ngram_components
from umbraloom.llm.packing import pack, plan, sequences
from umbraloom.llm.repeats import remove_repeats
from umbraloom.llm.tokens import ByteBpe
from umbraloom.llm.words import Words

DOCS = "doc_id long, text string"
VOCABULARY = P.path("byte_bpe_50k.json")


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1, max_size=25))
def test_plan_places_every_piece(counts):
    got, bins = Counter(), 0
    for pattern, k in plan(counts, 60):
        assert sum(pattern) <= 60 and k > 0 and sum(3 * n > 60 for n in pattern) <= 2
        bins += k
        for n in pattern:
            got[n] += k
    assert got == Counter(counts)
    total, big = sum(n * c for n, c in counts.items()), sum(c for n, c in counts.items() if 2 * n > 60)
    assert bins <= max(2 * -(-total // 60), big + 1)


def one_by_one(lengths, capacity):
    """The number of sequences when pieces are handled singly: large ones, the largest first, each with the largest other one that fits, then small ones, the longest first, into the smallest gap."""
    large, gaps = sorted(n for n in lengths if 3 * n > capacity), []
    while large:
        n = large.pop()
        mates = [k for k, m in enumerate(large) if n + m <= capacity]
        gaps.append(capacity - n - (large.pop(mates[-1]) if mates else 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - n)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 12), min_size=1, max_size=20))
def test_plan_against_single_pieces(counts):
    assert sum(k for _, k in plan(counts, 60)) == one_by_one([n for n, c in counts.items() for _ in range(c)], 60)


def test_packing_of_very_long_runs(spark):
    texts = [" " * 2_000_000, "\n" * 2_000_000, "a" * 500_000, "1" * 500_000, "a" + " \n" * 600_000 + "<|endoftext|>"]
    rows = pack(spark.createDataFrame(list(enumerate(texts)), DOCS), VOCABULARY, P.PATTERN).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    t = Tokenizer.from_file(VOCABULARY)
    assert {r["doc_id"]: r["n"] for r in rows} == {k: len(t.encode(x, add_special_tokens=False).ids) + 1 for k, x in enumerate(texts)}


def test_ids_are_those_of_the_tokenizer():
    t, e = Tokenizer.from_file(P.path("byte_bpe_50k.json")), ByteBpe(VOCABULARY, P.PATTERN, special_as_text=False)
    rng = random.Random(1)
    texts = ["", "a <|endoftext|>b", "  \t\n x  ", "é́中文😀'll \r\n", "a" * 5000, *("".join(chr(rng.choice([*range(32, 0x800), *range(0x2000, 0x2100), 9, 10, 0x1F600])) for _ in range(300)) for _ in range(50))]
    for x in texts:
        assert t.encode(x, add_special_tokens=False).ids == e.encode(x)


def test_ids_of_all_documents():
    t, e = Tokenizer.from_file(P.path("byte_bpe_50k.json")), ByteBpe(VOCABULARY, P.PATTERN, special_as_text=False)
    texts = [x or "" for x in pq.read_table(SF.replace("0.001", "0.1") + "/documents.parquet", columns=["text"])["text"].to_pylist()]
    for k in range(0, len(texts), 500):
        part = texts[k : k + 500]
        assert [x.ids for x in t.encode_batch(part, add_special_tokens=False)] == [e.encode(x) for x in part]


def test_packing(spark):
    docs = [(1, "hello world " * 3000), (2, None), (3, ""), (None, "a b"), (4, "x y z " * 200), (4, "x y z " * 200)]
    df = spark.createDataFrame(docs, DOCS).withColumns({"length": F.lit(1), "rank": F.lit(1), "part": F.lit(1)}).repartition(3)
    rows = pack(df, VOCABULARY, P.PATTERN, with_ids=True).cache()
    by = defaultdict(list)
    for r in rows.collect():
        assert r["length"] == len(r["ids"]) <= 2048 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by[r["sequence_id"]].append(r)
    for s in by.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    one = sorted((r for s in by.values() for r in s if r["doc_id"] == 1), key=lambda r: r["piece"])
    assert [x for r in one for x in r["ids"]] == [*t.encode(docs[0][1], add_special_tokens=False).ids, 0] and all(r["length"] == 2048 for r in one[1:])
    assert [r["start"] for r in one] == [sum(q["length"] for q in one[:k]) for k in range(len(one))]
    assert sum(len(r["ids"]) for r in sequences(rows).collect()) == sum(r["length"] for s in by.values() for r in s)
    assert pack(df.limit(0), VOCABULARY, P.PATTERN).count() == 0


def brute_components(docs):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    s = {i: shingles(t) for i, t in docs}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            n = len(s[i] & s[j])
            if s[i] and s[j] and 100 * n >= 80 * len(s[i] | s[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_shingle_join(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs, n = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "one two three")], 6
    for _ in range(12):  # families that drift apart step by step, so that links form chains
        t = [rng.choice(words) for _ in range(rng.choice([6, 30, 60, 120]))]
        for _ in range(rng.randint(1, 9)):
            docs.append((n, (" " if n % 2 else "  ").join(t)))
            n += 1
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = rng.choice(words)
    passage = [rng.choice(words) for _ in range(40)]
    for _ in range(25):  # a passage that many share, with more or less around it
        docs.append((n, " ".join([*(rng.choice(words) for _ in range(rng.randint(0, 14))), *passage])))
        n += 1
    df = spark.createDataFrame(docs, DOCS).withColumns({"component": F.lit(1), "rep": F.lit(2), "n": F.lit(3)}).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(df).collect()}
    assert got == brute_components(docs)


def test_shingle_join_odd_tables(spark):
    assert ngram_components(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f")], DOCS)
    assert sorted(((r["doc_id"], r["component_id"]) for r in ngram_components(df).collect()), key=repr) == [(1, 1), (2, 1), (2, 1), (None, None)]
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "g h i j k l"), (1, "a b c d e f"), (2, "g h i j k l"), (7, "long " * 100_000), (8, "LONG\t" * 100_000)], DOCS)
    assert sorted((r["doc_id"], r["component_id"]) for r in ngram_components(df).collect()) == [(1, 1), (2, 2), (5, 1), (5, 2), (7, 7), (8, 7)]  # each row by its own text
    extra = spark.createDataFrame([(None, None, 1), (3, "a b", 2), (4, "A  B", 3), (None, "a b", 4)], "doc_id long, text string, component_id int")
    assert sorted(r["component_id"] for r in keep_one(extra).collect()) == [1, 2, 4] and keep_one(extra.limit(0)).columns == extra.columns


def test_long_lists_are_cut_by_size(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"c{i}" for i in range(40)]
    docs = [(i, " ".join(base[: rng.randint(5, 40)] + [f"x{rng.randrange(9)}" for _ in range(rng.randint(0, 6))])) for i in range(150)]
    from umbraloom.llm import ngram_join as N

    monkeypatch.setattr(N, "LONG", 3)
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    rows = df.select("doc_id", F.lit(0).cast("long").alias("component"), F.col("text").cast("binary").alias("text")).collect()
    import pyarrow as pa

    class Fake:
        sparkSession = spark

        def mapInArrow(self, f, _):  # in this process, so that LONG is as set
            t = pa.table({"doc_id": pa.array([r["doc_id"] for r in rows], pa.int64()), "component": pa.array([r["doc_id"] for r in rows], pa.int64()), "text": pa.array([bytes(r["text"]) for r in rows], pa.binary())})
            return pa.Table.from_batches(list(f(iter(t.to_batches()))))

    def pairs(counts):
        blocks = N.prefixes(Fake(), counts, 1)
        got = N.candidates(blocks)
        return set(zip(got["x"].to_pylist(), got["y"].to_pylist(), strict=True))

    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in docs}
    near = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    for counts in (np.full(N.CELLS, 9, np.uint64), np.zeros(N.CELLS, np.uint64)):  # all lists cut, none cut
        assert near <= pairs(counts)


def test_repeats(spark):
    rng = random.Random(3)
    words = ["the", "The", "é", *(f"v{i}" for i in range(40))]
    passages = [[rng.choice(words) for _ in range(n)] for n in (13, 14, 20, 60)]
    docs = [(0, None), (1, " "), (2, "a " * 40), (3, "a " * 40), (4, "b " * 12), (5, "b " * 12), (60, "long " * 30_000)]
    for i in range(6, 50):
        t = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            t += p[rng.randint(0, 3) :] + [rng.choice(words) for _ in range(rng.randint(0, 3))]
        docs.append((i, ("\n" if i % 3 else "  ").join(t)))
    first = {}
    split = {i: (t or "").encode().split() for i, t in docs}
    for i in sorted(split):
        for k in range(len(split[i]) - 12):
            first.setdefault(tuple(split[i][k : k + 13]), i)
    want = {}
    for i, w in split.items():
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    df = spark.createDataFrame(docs, DOCS).withColumns({"bucket": F.lit(1), "shard": F.lit(2), "hash": F.lit(3)}).repartition(3)
    assert {r["doc_id"]: tuple(r)[1:] for r in remove_repeats(df).collect()} == want
    assert sum(w[1] for w in want.values()) > 200
    assert {r["doc_id"]: tuple(r)[1:] for r in remove_repeats(df, bucket_bytes=2000).collect()} == want
    assert remove_repeats(df.limit(0)).count() == 0


def test_repeats_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(20))
    docs = [(1, long), (1, long), (1, "x " + long), (None, long), (None, None), (2, long + " y"), (3, long.replace(" ", "\x0b\n")), (4, long.upper())]
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept"]) for r in remove_repeats(spark.createDataFrame(docs, DOCS)).collect()))
    assert got == [(0, 0, 0, ""), (0, 20, 0, long), (1, 20, 0, long), (1, 20, 0, long), (1, 21, 0, "x " + long), (2, 21, 20, "y"), (3, 20, 20, ""), (4, 20, 0, long.upper())]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab é\t\n\x0c\x00\u00a0", max_size=30), max_size=6))
def test_words_of_many_texts(texts):
    raw = [t.encode() for t in texts]
    w = Words(raw)
    words = [x for t in raw for x in t.split()]
    assert [bytes(w.data[a:b]) for a, b in zip(w.starts, w.ends, strict=True)] == words and w.counts.tolist() == [len(t.split()) for t in raw]
    for k in (0, 1):
        h = w.hashes(k).tolist()
        assert len(set(h)) == len(set(words)) == len(set(zip(words, h, strict=True)))
    assert w.runs_inside(2).tolist() == [a + k for a, n in zip(w.first.tolist(), w.counts.tolist(), strict=True) for k in range(n - 1)]


def test_pipeline(spark):
    import corpus_pipeline as C

    docs, kept, texts = table(spark, SF, "documents"), [], []
    for _, stage in C.STAGES[:-1]:
        texts.append(dict(map(tuple, docs.select("doc_id", "text").collect())))
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append([r["doc_id"] for r in docs.select("doc_id").collect()])
        assert set(kept[-1]) <= set(texts[-1]) and len(kept[-1]) == len(set(kept[-1]))
    first = {}
    for i in sorted(texts[1]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[1][i] or ""), i)
    assert sorted(kept[1]) == sorted(first.values())
    assert sorted(kept[2]) == sorted(i for i, (_, c) in brute_components(list(texts[2].items())).items() if i == c)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = {tuple(w[k : k + 10]) for r in table(spark, SF, "benchmark").collect() for w in [words(r["text"])] for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    assert sorted(kept[3]) == sorted(i for i, t in texts[3].items() if not hit(words(t)))
    assert len(kept[-1]) > 100
    comp = brute_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert all(i == c for i, (_, c) in comp.items())  # nothing that links is left
    out = C.run(spark, SF).collect()
    assert sorted({r["doc_id"] for r in out}) == sorted(kept[-1])


def test_pipeline_stages_on_odd_tables(spark):
    from umbraloom.llm.decontamination import clean_documents
    from umbraloom.llm.exact_dedup import keep_first
    from umbraloom.llm.quality import keep_good

    schema = "doc_id long, text string, lang string, component_id int, kept boolean, score double, items string"
    rows = [(None, "one two three four five", "x", 1, True, 0.1, "a"), (1, None, None, 2, None, None, None), (2, "", "x", 3, False, 0.2, "b"), (3, "one two three four five", "x", 4, True, 0.3, "c")]
    df, bench = spark.createDataFrame(rows, schema), spark.createDataFrame([(1, "one two")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for stage, want in ((lambda d: keep_good(d, labels), {1, 2, 3, 4}), (keep_first, {2, 4}), (keep_one, {1, 2, 3, 4}), (lambda d: clean_documents(d, bench), {2, 3})):
        got = stage(df)
        assert got.columns == df.columns and {r["component_id"] for r in got.collect()} == want
        assert stage(df.limit(0)).count() == 0
