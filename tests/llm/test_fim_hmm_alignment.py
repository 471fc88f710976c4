"""Fill-in-the-middle, hidden Markov scores and token alignment, against brute force."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from umbraloom.llm import alignment, fill_in_middle, hmm
from umbraloom.llm.common import table
from umbraloom.llm.fill_in_middle import MARKS, Mix, draws, ends_at, restored, transform
from umbraloom.llm.tokens import ByteBpe, Pieces

UNIT = re.compile(fill_in_middle.UNIT)
DOCS = "doc_id long, text string"
EXTRA = "doc_id long, text string, row long, pair long, word string, held boolean, n long, symbols string, output string, n_best long"


def with_clashes(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 8) for r in rows], EXTRA)


# fill in the middle -----------------------------------------------------------------------------------------------------

pieces = st.text(st.sampled_from(list("ab <>PSM\n\té中😀Z")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(pieces, st.integers(-5, 10**12))
def test_cuts_against_a_list_of_units(text, doc_id):
    n, form, prefix, middle, out = transform(text, doc_id, UNIT, Mix())
    units = re.findall(fill_in_middle.UNIT, text)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    assert (n, draws(doc_id)) == (len(units), (h1, h2, h3, h4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    plain = not text or any(x in text for x in MARKS) or h3 % 100 >= 90
    wanted = ("plain", None, None, text) if plain else ("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")
    assert (form, prefix, middle, out) == wanted


def test_the_matcher_stops_at_the_second_rank():
    class Counted:
        read = 0

        def finditer(self, text):
            for m in UNIT.finditer(text):
                Counted.read += 1
                yield m

    assert ends_at(Counted(), "ab c de " * 1000, 2, 5) == (3, 7)
    assert Counted.read == 5


def test_restored_texts(spark):
    texts = ["", "a", "<P", "S>", "M><", "<<P <<S <<M", "x <S", "<M>", "é中😀 \n\n\ta b", "ab " * 700_000, "\n" * 300_000]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 9)], DOCS)
    got = fill_in_middle.fill_in_middle(docs).select("doc_id", "form", restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == dict(enumerate(texts * 9))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_fim_odd_tables(spark):
    rows = [(None, "a b"), (None, None), (1, None), (1, ""), (2, "x"), (2, "x")]
    got = fill_in_middle.fill_in_middle(with_clashes(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["n"]) for r in got) == [(0, 0), (0, 3), (1, 0), (1, 0), (2, 1), (2, 1)]
    assert fill_in_middle.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0
    all_plain = fill_in_middle.fill_in_middle(table(spark, SF, "documents"), Mix(transformed=0))
    assert all_plain.where("form <> 'plain' or prefix_chars is not null").count() == 0


# hidden Markov model ----------------------------------------------------------------------------------------------------


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def base_scores(rows):
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows]


def some_model(symbols, states, seed):
    rng = np.random.default_rng(seed)
    part = lambda *s: (x := rng.random(s) + 0.05) / x.sum(axis=-1, keepdims=True)
    return hmm.Model(part(states), part(states), part(states, states), part(states, symbols).T.copy())


def over_paths(m, seq, first):
    """The sum over all paths of states, and the expected emissions, moves and first states of it."""
    total, emits, moves, start = 0.0, np.zeros_like(m.emits), np.zeros_like(m.moves), np.zeros(m.states)
    for path in itertools.product(range(m.states), repeat=len(seq)):
        p = first[path[0]] * np.prod([m.emits[s, q] for s, q in zip(seq, path, strict=True)]) * np.prod([m.moves[a, b] for a, b in itertools.pairwise(path)])
        total += p
        start[path[0]] += p
        for s, q in zip(seq, path, strict=True):
            emits[s, q] += p
        for a, b in itertools.pairwise(path):
            moves[a, b] += p
    return total, emits / total, moves / total, start / total


def test_recursions_against_all_paths():
    m, rng = some_model(5, 3, 1), np.random.default_rng(2)
    texts = [rng.integers(0, 5, n) for n in (1, 4, 6, 2, 5)]
    flat, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
    assert np.allclose(hmm.likelihoods(m, flat, lengths), [math.log10(over_paths(m, t, m.first)[0]) for t in texts])
    begin, n, opening = hmm.stretches(lengths, 4)
    assert list(zip(begin.tolist(), n.tolist(), opening.tolist(), strict=True)) == [(0, 1, True), (1, 4, True), (5, 4, True), (9, 2, False), (11, 2, True), (13, 4, True), (17, 1, False)]
    emits, moves, first, middle = hmm.expected(m, flat, begin, n, opening)
    all_of = [over_paths(m, flat[b : b + k], m.first if o else m.middle) for b, k, o in zip(begin, n, opening, strict=True)]
    assert np.allclose(emits, sum(x[1] for x in all_of), atol=1e-4) and np.allclose(moves, sum(x[2] for x in all_of), atol=1e-4)
    assert np.allclose(first, sum(x[3] for x, o in zip(all_of, opening, strict=True) if o), atol=1e-4)
    assert np.allclose(middle, sum(x[3] for x, o in zip(all_of, opening, strict=True) if not o), atol=1e-4)


def test_all_texts_of_a_length_have_probability_one():
    m = some_model(3, 2, 4)
    flat = np.array([s for t in itertools.product(range(3), repeat=4) for s in t])
    assert abs((10 ** hmm.likelihoods(m, flat, np.full(81, 4))).sum() - 1) < 1e-9


def test_rounds_raise_the_likelihood(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [0 if rng.random() < 0.1 else int(x) for x in rng.integers(1 + 10 * (k % 2), 11 + 10 * (k % 2), 30)]) for k in range(200)]
    data, unigram = spark.createDataFrame(rows, "row long, symbols array<int>").repartition(3), np.full(21, 10.0)
    flat, lengths = np.concatenate([t for _, t in rows]), np.full(200, 30)
    model, seen = hmm.started(unigram, 2), []
    for _ in range(6):
        seen.append(hmm.likelihoods(model, flat, lengths).sum())
        model = hmm.baum_welch(data, model, unigram)
    assert seen == sorted(seen) and seen[-1] > seen[0] + 1000


@pytest.mark.parametrize("most", [1, 40, 1 << 17])
def test_counts_and_base_scores(spark, most):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = hmm.hmm_scores(table(spark, SF, "documents"), symbols=30, states=2, most=most).collect()
    mine = sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert mine == sorted((*x[:5], round(x[5], 6)) for x in base_scores(rows))
    assert all(r["score"] < 0 for r in got)


def test_scores_do_not_depend_on_what_is_broadcast(spark):
    docs = table(spark, SF, "documents").repartition(3, "doc_id").sortWithinPartitions("doc_id")
    runs = [{r["doc_id"]: r["score"] for r in hmm.hmm_scores(docs, symbols=30, states=2, most=m).collect()} for m in (2000, 1 << 17)]
    assert all(abs(a - runs[1][k]) < 1e-6 * abs(a) for k, a in runs[0].items())


def test_the_model_knows_held_out_texts_better(spark):
    got = hmm.hmm_scores(table(spark, SF.replace("0.001", "0.01"), "documents")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (got["s"] - got["b"]) / got["n"] > 0.25  # log10 units a token


def test_held_out_texts_teach_nothing(spark):
    rows = [(k, f"the cat sat on the mat {k % 3} dog {'x' * (k % 5)}.") for k in range(60)]
    other = [(k, "quite different words" if held(k) else t) for k, t in rows]
    a, b = ({r["doc_id"]: r for r in hmm.hmm_scores(spark.createDataFrame(x, DOCS).coalesce(1), states=2).collect()} for x in (rows, other))
    assert any(held(k) for k, _ in rows)
    for k, _ in rows:
        if not held(k):
            assert abs(a[k]["score"] - b[k]["score"]) < 1e-6 and a[k]["train_tokens"] == b[k]["train_tokens"]


def test_hmm_odd_tables(spark):
    rows = [(None, "a b a"), (None, None), (5, None), (5, ""), (1, "A b\x0bc d"), (1, "A b\x0bc d"), (9, "w" * 100_000), (26, " \n ")]
    got = hmm.hmm_scores(with_clashes(spark, rows)).collect()
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == sorted((x[2], x[3], round(x[5], 6)) for x in base_scores(rows))
    assert all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert hmm.hmm_scores(spark.createDataFrame([], DOCS)).count() == 0
    only_held = [k for k in range(60) if held(k)][:3]
    got = hmm.hmm_scores(spark.createDataFrame([(k, "a b") for k in only_held], DOCS)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(0, 0, 0.0)] * 3


# alignment --------------------------------------------------------------------------------------------------------------

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return ByteBpe(A, P.PATTERN), Pieces(B)


def by_offsets(text, both):
    """Groups and links from byte ranges."""
    a, b = both[0].encode(" " + text), both[1].encode(text)
    x, y = [both[0].bytes[i] for i in a], [both[1].bytes[i] for i in b]
    if not text or b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
        return [], [], [], []
    ends = lambda v: list(itertools.accumulate(map(len, v)))
    ea, eb = ends(x), ends(y)
    cuts = sorted(set(ea) & set(eb))
    groups, low = [], 0
    for c in cuts:
        groups.append(",".join(str(i) for i, e in zip(a, ea, strict=True) if low < e <= c) + "|" + ",".join(str(i) for i, e in zip(b, eb, strict=True) if low < e <= c))
        low = c
    links = [(i, j) for i, e, t in zip(a, ea, x, strict=True) for j, f, u in zip(b, eb, y, strict=True) if max(e - len(t), f - len(u)) < min(e, f)]
    return a, b, groups, links


TEXTS = [None, "", "hello world", " leading", "<|endoftext|> a <s> b</s><unk>", "▁x", "é中文😀'll \r\n", "a b", "  \t\n x  ", "aaaa" * 50, "\x00\x01", "The and attion to thanedble", "naïve ﬁ ½"]


def test_alignment_against_byte_ranges(spark, both):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").where("length(text) < 1500").limit(60).collect()] + [(1000 + k, t) for k, t in enumerate(TEXTS)]
    wanted = {k: by_offsets(t or "", both) for k, t in docs}
    counts = Counter(p for w in wanted.values() for p in set(w[3]))
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    for most in (1 << 20, 500, 0):
        got = {r["doc_id"]: r for r in alignment.align_tokenizers(spark.createDataFrame(docs, DOCS).repartition(3), lambda: (ByteBpe(A, P.PATTERN), Pieces(B)), both[1].size, with_groups=True, most=most).collect()}
        assert len(got) == len(docs)
        for k, (a, b, groups, links) in wanted.items():
            r, told = got[k], ";".join(groups)
            assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (len(a), len(b), len(groups), len(links))
            assert r["groups"] == told and r["groups_sha256"] == (hashlib.sha256(told.encode()).hexdigest() if a else "")
            assert (r["n_best"], r["count_sum"]) == (sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links))
    assert any(not w[0] for k, w in wanted.items() if docs and k == 1005)  # a text that the pieces do not spell


def test_the_transducer_forgets_and_goes_on(both, monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 10)
    t = alignment.Transducer(both[0].bytes, both[1].bytes)
    for text in ["hello strange wordlings", "reentrance of unlikelihoods", "zxqv jjk"] * 3:
        links, groups = t.align(both[0].encode(" " + text), both[1].encode(text))
        _, _, g, k = by_offsets(text, both)
        assert groups == g and sorted(links) == sorted(a * both[1].size + b for a, b in k)
    with pytest.raises(ValueError, match="different bytes"):
        t.align(both[0].encode(" abc"), both[1].encode("abd"))


def test_encoders_against_the_tokenizers_library(both):
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    texts = [x for x in TEXTS if x] + [" " * 2_000_000, "\n" * 2_000_000, "a" * 400_000, "7" * 400_000, "a" + " \n" * 800_000 + "b <|endoftext|>"]
    for x in texts:
        assert both[0].encode(x) == t.encode(x, add_special_tokens=False).ids
    special = Tokenizer.from_file(A)
    as_token = ByteBpe(A, P.PATTERN, special_as_text=False)
    for x in ["a <|endoftext|>b", " " * 1_000_000 + "<|endoftext|>"]:
        assert as_token.encode(x) == special.encode(x, add_special_tokens=False).ids


def test_alignment_odd_tables(spark, both):
    make = lambda: (ByteBpe(A, P.PATTERN), Pieces(B))
    rows = [(None, "a b"), (None, None), (1, "a b"), (1, "a b"), (2, ""), (3, " " * 1_200_000)]
    got = alignment.align_tokenizers(with_clashes(spark, rows), make, both[1].size).collect()
    assert len(got) == 6
    assert {r["count_sum"] // r["n_links"] for r in got if r["n_links"] == 2} == {3}  # three rows hold the same links
    assert [r for r in got if r["doc_id"] == 3][0]["n_a"] == 1_200_001
    assert alignment.align_tokenizers(spark.createDataFrame([], DOCS), make, both[1].size).count() == 0
