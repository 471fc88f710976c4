"""Hidden Markov language model: latent states trained by Baum-Welch, exact likelihoods by the scaled forward recursion.

What a state emits is a symbol: one of the most frequent words, the end of a text, or the kind of any other word (its ending, or which characters it
is made of). Within a kind a word's probability is its own count's, smoothed. So every text of any words has a probability, and a state needs a number
for each symbol only, of which there is a bounded number however large the vocabulary is.

Counts of words come from all texts: a shuffled table with a row for each word. The most frequent words, of a bounded number, are broadcast; texts get the counts of
all others by a join. Baum-Welch runs over all training texts: each task adds up its expected counts, one row for each symbol, Spark adds up the tasks'. To start from
states that tell something, the first rounds take an eighth of the texts; the last ones take all of them. For training, texts are cut into stretches of
STRETCH tokens with a starting distribution of their own; scores follow each text from its first token to its end.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraloom.llm.common import Scratch, frequent

STATES, SYMBOLS, KINDS = 8, 8192, 512
#: Most words whose counts are broadcast, and their longest: some 10 MB.
BROADCAST, LONGEST = 1 << 17, 64
FOLDS, HELD = 7, 2
#: Rounds over a share of the training texts, then over all.
WARM_ROUNDS, WARM_SHARE, ROUNDS = 10, 8, 2
STRETCH = 128
#: Tokens that are handled at a time, and different words that a task counts before it passes them on.
AT_ONCE, WORDS_AT_ONCE = 1 << 19, 1 << 18
END = b""  # no word is empty
SMOOTH_EMISSIONS, SMOOTH_MOVES = 200.0, 1.0

_CLASSES = bytes(0x30 if 0x30 <= c <= 0x39 else 0x61 if c >= 0x80 or 0x61 <= c <= 0x7A else c for c in range(256))
_STOPS = b".,;:!?"


def kind_of(word: bytes) -> int:
    """The kind of a lower-cased word: by its last letters and what follows them, or by its characters' classes if it has other ones than letters."""
    core = word.rstrip(_STOPS)
    shape = core.translate(_CLASSES)
    if shape.strip(b"a"):
        return zlib.crc32(re.sub(rb"(.)\1+", rb"\1", shape[:64], flags=re.S)) % (KINDS // 4)
    return KINDS // 4 + zlib.crc32(core[-3:] + b"|" + word[len(core) :][:1]) % (KINDS - KINDS // 4)


@dataclass
class Vocabulary:
    """The broadcast words with their training counts, which of them are symbols, and each kind's totals without those."""

    words: list[bytes]
    counts: np.ndarray
    symbol: np.ndarray  # of each word
    kind_logs: np.ndarray  # log10 of the denominator of each kind
    tokens: int
    distinct: int
    unigram: np.ndarray  # training counts of the symbols

    @property
    def size(self) -> int:
        return len(self.unigram)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.distinct + 1))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, kind, n, n_train) for every word of docs (held, text), and for the end of a text as the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())  # trained from, held out

        def told() -> pa.RecordBatch:
            words = [*seen[0], *(w for w in seen[1] if w not in seen[0])]
            train = np.array([seen[0][w] for w in words], np.int64)
            rest = np.array([seen[1][w] for w in words], np.int64)
            kinds = pa.array([kind_of(w) for w in words], pa.int32())
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), kinds, pa.array(train + rest), pa.array(train)], ["word", "kind", "n", "n_train"])

        for b in batches:
            for held, text in zip(b.column("held").to_pylist(), b.column("text"), strict=True):
                c = seen[held]
                c.update((text.as_py() or b"").lower().split())
                c[END] += 1
                if len(seen[0]) + len(seen[1]) > WORDS_AT_ONCE:
                    yield told()
        if seen[0] or seen[1]:
            yield told()

    return docs.select("held", "text").mapInArrow(count, "word binary, kind int, n long, n_train long").groupBy("word").agg(F.first("kind").alias("kind"), F.sum("n").alias("n"), F.sum("n_train").alias("n_train"))


def vocabulary(counts: DataFrame, most: int = BROADCAST, symbols: int = SYMBOLS) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of a written table of word_counts, and the rows of the words that are not in it."""
    short = F.length("word") <= LONGEST
    common = frequent(counts.where(short), "n", most) & short
    hot = counts.where(common).select("word", "kind", "n_train").toArrow()  # `most` rows of LONGEST bytes at most
    order = hot.sort_by([("n_train", "descending"), ("word", "ascending")])
    words, kinds, n = order.column("word").to_pylist(), order.column("kind").to_numpy(), order.column("n_train").to_numpy()
    names = [i for i, w in enumerate(words) if w != END and n[i] > 0][: symbols - 1]
    symbol, first_kind = np.zeros(len(words), np.int32), len(names) + 1
    symbol[:] = first_kind + kinds
    symbol[names] = 1 + np.arange(len(names))
    symbol[[i for i, w in enumerate(words) if w == END]] = 0
    by = counts.groupBy("kind").agg(F.sum("n_train").alias("n"), F.sum((F.col("n_train") > 0).cast("long")).alias("v"), F.sum(F.when(F.length("word") == 0, F.col("n_train")).otherwise(0)).alias("ends")).collect()  # a row for each kind
    total, different = np.zeros(KINDS, np.int64), np.zeros(KINDS, np.int64)
    for r in by:
        total[r["kind"]], different[r["kind"]] = r["n"], r["v"]
    tokens, distinct, ends = int(total.sum()), int(different.sum()), sum(int(r["ends"] or 0) for r in by)
    own = symbol < first_kind
    np.subtract.at(total, kinds[own], n[own])
    np.subtract.at(different, kinds[own], (n[own] > 0).astype(np.int64))
    if not (symbol == 0).any() and ends:  # the end is a symbol even where it is not among the broadcast words
        total[kind_of(END)] -= ends
        different[kind_of(END)] -= 1
    unigram = np.concatenate([[ends], n[names], total]).astype(np.float64)
    return Vocabulary(words, n, symbol, np.log10(total + different + 1), tokens, distinct, unigram), counts.where(~common)


_ENCODED = [("row", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("inside", pa.float64()), ("symbols", pa.list_(pa.int32())), ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))]
_ENCODED_SQL = "row long, doc_id long, held boolean, n_tokens long, n_known long, base double, inside double, symbols array<int>, rare array<binary>, times array<int>"


def encoded(docs: DataFrame, shared) -> DataFrame:
    """Every row's symbols, what its broadcast words add to both scores, and its other words with how often they occur. shared: a broadcast Vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, row = shared.value, TaskContext.get().partitionId() << 40
        index = {w: i for i, w in enumerate(v.words)}
        end = index.get(END, -1)
        first_kind = v.size - KINDS
        base, known = v.base(v.counts), v.counts > 0
        inside = np.where(v.symbol >= first_kind, np.log10(v.counts + 1) - v.kind_logs[np.maximum(0, v.symbol - first_kind)], 0.0)
        kinds: dict[bytes, int] = {}
        for b in batches:
            out, size = [[] for _ in _ENCODED], 0
            for doc_id, held, text in zip(b.column("doc_id").to_pylist(), b.column("held").to_pylist(), b.column("text"), strict=True):
                words = (text.as_py() or b"").lower().split()
                at = np.array([*map(index.get, words, [-1] * len(words)), end], np.int64)
                here = at[at >= 0]
                symbols = np.zeros(len(at), np.int32)
                symbols[at >= 0] = v.symbol[here]
                places = np.flatnonzero(at[:-1] < 0)
                rare = [words[i] for i in places]
                for i, w in zip(places, rare, strict=True):
                    if (k := kinds.get(w)) is None:
                        if len(kinds) > WORDS_AT_ONCE:
                            kinds.clear()
                        k = kinds[w] = kind_of(w)
                    symbols[i] = first_kind + k
                times = Counter(rare)
                if end < 0:
                    times[END] = 1
                for c, x in zip(out, (row, doc_id, held, len(at), int(known[here].sum()), float(base[here].sum()), float(inside[here].sum()), symbols, [*times], [*times.values()]), strict=True):
                    c.append(x)
                row, size = row + 1, size + len(at)
                if size > AT_ONCE:
                    yield _batch(out)
                    out, size = [[] for _ in _ENCODED], 0
            if out[0]:
                yield _batch(out)

    return docs.mapInArrow(run, _ENCODED_SQL)


def _batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _ENCODED, strict=True)], [n for n, _ in _ENCODED])


@dataclass
class Model:
    """first and middle: the states' probabilities at a text's start and at a stretch's; moves: from state to state; emits: by symbol and state."""

    first: np.ndarray
    middle: np.ndarray
    moves: np.ndarray
    emits: np.ndarray

    @property
    def states(self) -> int:
        return len(self.first)


def started(unigram: np.ndarray, states: int = STATES) -> Model:
    """States that stay as they are and emit the symbols' frequencies, each disturbed in its own way (by a fixed seed)."""
    rng = np.random.default_rng(11)
    moves = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    np.fill_diagonal(moves, 0.9 if states > 1 else 1.0)
    emits = (unigram + 1)[:, None] * rng.gamma(1.0, size=(len(unigram), states))
    even = np.full(states, 1 / states)
    return Model(even, even, moves, emits / emits.sum(axis=0))


def improved(sums: dict[int, np.ndarray], unigram: np.ndarray, states: int) -> Model:
    """The model of expected counts, smoothed towards the symbols' frequencies. sums: by symbol; -1 and -2 are starts of texts and of stretches, -3 - k the moves from k."""
    none = np.zeros(states)
    shared = (unigram + 1) / (unigram + 1).sum()
    emits = np.array([sums.get(s, none) for s in range(len(unigram))]) + SMOOTH_EMISSIONS * shared[:, None]
    moves = np.array([sums.get(-3 - k, none) for k in range(states)]) + SMOOTH_MOVES
    first, middle = sums.get(-1, none) + SMOOTH_MOVES, sums.get(-2, none) + SMOOTH_MOVES
    return Model(first / first.sum(), middle / middle.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))


def expected(model: Model, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, opening: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of stretches symbols[start : start + length]: of emissions, moves, and states at the starts of texts (opening) and of others."""
    k, order = model.states, np.argsort(-lengths, kind="stable")
    starts, lengths, opening = starts[order], lengths[order], opening[order]
    n, top = len(starts), int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(top), side="left")  # stretches with more than t tokens
    seen = symbols[np.minimum(starts[None] + np.arange(top)[:, None], len(symbols) - 1)]
    # by token, state and stretch: sums over states are then sums of whole rows
    moves, back = np.ascontiguousarray(model.moves.T.astype(np.float32)), model.moves.astype(np.float32)
    e = np.empty((top, k, n), np.float32)
    table = model.emits.T.astype(np.float32)
    for s in range(k):
        e[:, s] = table[s][seen]
    alpha, scale = np.zeros((top, k, n), np.float32), np.ones((top, n), np.float32)
    alpha[0] = np.where(opening, model.first.astype(np.float32)[:, None], model.middle.astype(np.float32)[:, None]) * e[0]
    for t in range(top):
        m = active[t]
        if t:
            np.multiply(moves @ alpha[t - 1, :, :m], e[t, :, :m], out=alpha[t, :, :m])
        scale[t, :m] = alpha[t, :, :m].sum(axis=0)
        alpha[t, :, :m] /= scale[t, :m]
    gone, beta = np.zeros((k, k)), np.ones((k, n), np.float32)
    for t in range(top - 1, -1, -1):
        if t + 1 < top:
            m = active[t + 1]
            after = e[t + 1, :, :m] * beta[:, :m]
            after /= scale[t + 1, :m]
            gone += alpha[t, :, :m] @ after.T
            beta[:, :m] = back @ after
        alpha[t] *= beta  # the states' probabilities: alpha[t] has been used for the last time
    mask = np.arange(top)[:, None] < lengths[None]
    at = seen[mask]
    emits = np.stack([np.bincount(at, alpha[:, s][mask], minlength=len(model.emits)) for s in range(k)], axis=1)
    return emits, gone * model.moves, alpha[0][:, opening].sum(axis=1, dtype=np.float64), alpha[0][:, ~opening].sum(axis=1, dtype=np.float64)


def stretches(lengths: np.ndarray, size: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where stretches of texts that follow each other start, their lengths, and which open a text."""
    pieces = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), pieces)
    rank = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = (np.cumsum(lengths) - lengths)[text] + rank * size
    return begin, np.minimum(size, lengths[text] - rank * size), rank == 0


def baum_welch(table: DataFrame, model: Model, unigram: np.ndarray) -> Model:
    """One round over all rows of a table with symbols."""
    shared, k = table.sparkSession.sparkContext.broadcast(model), model.states
    names = [f"g{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, emits, rest = shared.value, None, np.zeros((2 + k, k))
        for b in batches:
            lists = b.column("symbols")
            flat, (begin, lengths, opening) = lists.flatten().to_numpy(), stretches(lists.value_lengths().to_numpy().astype(np.int64))
            for i in range(0, len(begin), AT_ONCE // STRETCH):
                cut = slice(i, i + AT_ONCE // STRETCH)
                e, moves, first, middle = expected(m, flat, begin[cut], lengths[cut], opening[cut])
                emits = e if emits is None else emits + e
                rest += np.concatenate([first[None], middle[None], moves])
        if emits is not None:
            used = np.flatnonzero(emits.sum(axis=1))
            symbol, values = np.concatenate([used, -1 - np.arange(2 + k)]).astype(np.int32), np.concatenate([emits[used], rest])
            yield pa.RecordBatch.from_arrays([pa.array(symbol), *(pa.array(c) for c in values.T.copy())], ["symbol", *names])

    sums = table.select("symbols").mapInArrow(run, "symbol int, " + ", ".join(f"{g} double" for g in names)).groupBy("symbol").agg(*(F.sum(g).alias(g) for g in names)).toArrow()  # a row for each symbol at most
    values = np.stack([sums.column(g).to_numpy() for g in names], axis=1)
    return improved(dict(zip(sums.column("symbol").to_pylist(), values, strict=True)), unigram, k)


def likelihoods(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 of the probability of each of the texts that follow each other in symbols, each with one token at least. All texts take a step at a time, each until its end."""
    out, starts = np.zeros(len(lengths)), np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    sums, cut = np.cumsum(lengths[order]), 0
    while cut < len(order):
        upto = max(cut + 1, int(np.searchsorted(sums, (sums[cut - 1] if cut else 0) + AT_ONCE, side="right")))
        own = order[cut:upto]
        n, at = lengths[own], starts[own]
        active = np.searchsorted(-n, -np.arange(int(n[0])), side="left")
        total = np.zeros(len(own))
        alpha = model.first * model.emits[symbols[at]]
        for t in range(int(n[0])):
            m = active[t]
            if t:
                alpha = (alpha[:m] @ model.moves) * model.emits[symbols[at[:m] + t]]
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            total[:m] += np.log10(scale)
        out[own] = total
        cut = upto
    return out


def train(table: DataFrame, unigram: np.ndarray, scratch: Scratch, states: int = STATES) -> Model:
    """The model of the table's texts outside the held-out fold."""
    model, learnt = started(unigram, states), table.where("not held").select("row", "symbols")
    warm = scratch.keep(learnt.where(F.pmod(F.xxhash64("row"), F.lit(WARM_SHARE)) == 0), "warm")
    for rows in [warm] * WARM_ROUNDS + [learnt] * ROUNDS:
        model = baum_welch(rows, model, unigram)
    return model


def hmm_scores(docs: DataFrame, scratch: Scratch | None = None, states: int = STATES, symbols: int = SYMBOLS, most: int = BROADCAST) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs, one for one.

    Tokens are words of whole texts, lower-cased from A to Z, then one end. Texts whose crc32 of doc_id is 2 modulo 7 are held out: neither counts nor states learn from
    them. base_score is the log10 probability under add-one unigram counts, score that under the hidden Markov model. Null text counts as empty, and an empty text
    has its end alone. A null doc_id is passed on and learnt from. Repeated rows count each. An empty table gives no rows. `most` bounds the words that are broadcast
    and changes no count; `symbols` and `states` set the model's size. Other columns are not read, whatever their names.
    """
    scratch = scratch or Scratch(docs.sparkSession, "hmm")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), F.col("text").cast("binary").alias("text"))
    counts = scratch.keep(word_counts(texts), "counts")
    v, others = vocabulary(counts, most, symbols)
    sc = docs.sparkSession.sparkContext
    table = scratch.keep(encoded(texts, sc.broadcast(v)), "encoded")
    model = sc.broadcast(train(table, v.unigram, scratch, states))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("symbols")
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(likelihoods(model.value, lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)))], ["row", "likelihood"])

    followed = table.select("row", "symbols").mapInArrow(follow, "row long, likelihood double")
    logs = F.array(*(F.lit(float(x)) for x in v.kind_logs))
    rare = table.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("k"))
    one = F.col("k") * F.log10(F.col("n_train") + 1.0)
    inside = F.when(F.length("word") == 0, 0.0).otherwise(one - F.col("k") * F.get(logs, F.col("kind")))
    added = rare.join(others, "word").groupBy("row").agg(
        F.sum(F.when(F.col("n_train") > 0, F.col("k")).otherwise(0)).cast("long").alias("n_known"), F.sum(one - F.col("k") * float(np.log10(v.tokens + v.distinct + 1))).alias("base"), F.sum(inside).alias("score"))
    own = table.select("row", "n_known", "base", F.col("inside").alias("score"))
    parts = own.unionAll(followed.select("row", F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base"), F.col("likelihood").alias("score"))).unionAll(added)
    sums = parts.groupBy("row").agg(F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    out = table.select("row", "doc_id", F.col("held").alias("held_out"), "n_tokens").join(sums, "row")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.tokens).cast("long").alias("train_tokens"), "base_score", "score")
