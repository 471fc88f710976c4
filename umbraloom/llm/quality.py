"""Quality classifier: regularised quadratic discriminant analysis over transformed statistics of a text.

Each class has a mean and a covariance, shrunk towards its diagonal. A score is the logistic function of the difference of
the classes' log densities, which are Mahalanobis distances taken with Cholesky factors that are computed once, over a
temperature. The fit needs only each class's count, sums and sums of products, which Spark adds up over all labelled rows: no sample.
As statistics are not independent normal ones, the difference overstates what is known; the temperature, fitted to the same rows by the
logarithmic loss, makes the score a probability. It needs the differences' histogram by class alone.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraloom.llm.common import IdFilter, Scratch

FOLDS = 5
CUT = 0.3
SHRINKAGE = 0.2  # of the covariances' other entries towards zero
RIDGE = 0.15  # least standard deviation of a statistic
TEMPERATURES = np.geomspace(1, 64, 97)
FARTHEST = 2000  # differences beyond count as such
SYMBOLS, UPPER, DIGITS, BANGS = b"#$%&*|<>{}[]\\^~`_=+@/", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?"
STATISTICS = ("symbols", "capitals", "digits", "bangs", "echoes", "repeated_words", "repeated_pairs", "repeated_lines", "word_length", "longest_word", "words")


def statistics(text: bytes | None) -> list[float]:
    """The transformed statistics of a whole text in UTF-8: logarithms of shares and of lengths."""
    text = text or b""
    words = text.split()
    n, size = len(words), len(text)
    share = lambda x, of, least, more=20: float(np.log(least + max(0, x) / (max(0, of) + more)))  # noqa: E731  more: a short text's shares say little
    count = lambda chars: size - len(text.translate(None, chars))
    lines = [x for x in text.split(b"\n") if x]
    return [
        share(count(SYMBOLS), size, 0.01, 100),
        share(count(UPPER), size, 0.02, 100),
        share(count(DIGITS), size, 0.1, 100),
        share(count(BANGS), size, 0.01, 100),
        share(sum(map(operator.eq, words, words[1:])), n - 1, 0.02, 10),
        share(n - len(set(words)), n, 0.5),  # grows with length in good texts too, so it weighs little
        share(n - 1 - len(set(zip(words, words[1:], strict=False))), n - 1, 0.1),
        share(len(lines) - len(set(lines)), len(lines), 0.5),
        float(np.log(1 + sum(map(len, words)) / n)) if n else 0.0,
        float(np.log(1 + max(map(len, words)))) if n else 0.0,
        0.2 * float(np.log(1 + n)),
    ]


@dataclass
class Model:
    """Two classes' means, inverse Cholesky factors, log determinants and temperature; share of label 1 if a class is missing."""

    means: np.ndarray | None
    factors: np.ndarray | None
    offset: float
    share: float
    temperature: float = 1.0

    def differences(self, x: np.ndarray) -> np.ndarray:
        """The differences of the classes' log densities."""
        far = [(((x - m) @ f.T) ** 2).sum(axis=1) for m, f in zip(self.means, self.factors, strict=True)]
        return 0.5 * (far[0] - far[1]) + self.offset

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.differences(x) / self.temperature, -500, 500)))


def learnt(sums: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """The model of each class's number of rows, sums and sums of products (upper triangle, row by row)."""
    k, means, factors, logs = len(STATISTICS), [], [], []
    if len(sums) < 2:
        return Model(None, None, 0.0, float(next(iter(sums), 0.5)))
    for c in (0, 1):
        n, s, p = sums[c]
        cov = np.zeros((k, k))
        cov[np.triu_indices(k)] = p / n
        cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(s / n, s / n)
        cov = (1 - SHRINKAGE) * cov + SHRINKAGE * np.diag(np.diag(cov)) + RIDGE**2 * np.eye(k)
        lower = np.linalg.cholesky(cov)
        means.append(s / n)
        factors.append(np.linalg.inv(lower))
        logs.append(2 * np.log(np.diag(lower)).sum())
    return Model(np.array(means), np.array(factors), 0.5 * (logs[0] - logs[1]) + np.log(sums[1][0] / sums[0][0]), sums[1][0] / (sums[0][0] + sums[1][0]))


def best_temperature(differences: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The one of TEMPERATURES with the least logarithmic loss; good and bad count rows at each difference."""
    at = differences[None] / TEMPERATURES[:, None]
    loss = np.logaddexp(0, -at) @ good + np.logaddexp(0, at) @ bad
    return float(TEMPERATURES[loss.argmin()])


def fit(features: DataFrame, labels: DataFrame, scratch: Scratch) -> Model:
    """From all labelled rows outside the held-out fold; labels that are null are left out."""
    k = len(STATISTICS)
    rows = scratch.keep(features.where(~_held_out(F.col("doc_id"))).join(_marks(labels), "doc_id").select("x", "_quality"), "learnt_from")
    x = [F.col("x")[i] for i in range(k)]
    sums = rows.groupBy("_quality").agg(F.count("*").alias("n"), F.array(*(F.sum(c) for c in x)).alias("s"), F.array(*(F.sum(x[i] * x[j]) for i in range(k) for j in range(i, k))).alias("p")).collect()
    model = learnt({int(r["_quality"]): (r["n"], np.array(r["s"]), np.array(r["p"])) for r in sums})
    if model.means is None:
        return model
    raw = rows.sparkSession.sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = np.clip(np.rint(raw.value.differences(b.column("x").flatten().to_numpy().reshape(b.num_rows, k))), -FARTHEST, FARTHEST)
                yield pa.RecordBatch.from_arrays([b.column("_quality"), pa.array(at.astype(np.int32))], ["good", "at"])

    counts = rows.withColumn("_quality", F.col("_quality").cast("int")).mapInArrow(bins, "good int, at int").groupBy("good", "at").count().collect()  # two rows for each whole difference at most
    both = np.zeros((2, 2 * FARTHEST + 1))
    for r in counts:
        both[r["good"], r["at"] + FARTHEST] = r["count"]
    model.temperature = best_temperature(np.arange(-FARTHEST, FARTHEST + 1.0), both[1], both[0])
    return model


def _marks(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("_quality")).where("doc_id is not null and _quality in (0, 1)")


def _held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with the statistics of each text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([statistics(t.as_py()) for t in b.column("text")], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(measure, "doc_id long, x array<double>")


def quality_scores(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, one for one.

    Null text counts as empty, and an empty text has a score. A null doc_id is passed on, is held out from nothing
    and learns nothing. Without labels of both classes all scores are the share of label 1 among the labels,
    or 0.5 without any. An empty docs gives no rows. Other columns are not read.
    """
    measured = scratch.keep(features(docs), "features")
    model = docs.sparkSession.sparkContext.broadcast(fit(measured, labels, scratch))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.value.scores(x))], ["doc_id", "score"])

    out = measured.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text has at least the score CUT. Rows are judged where they are; rows without text or doc_id
    are judged like any other. Only labelled rows are measured for the fit."""
    scratch = Scratch(docs.sparkSession, "keep_good")
    marks = _marks(labels)
    labelled = IdFilter(scratch, marks, "doc_id", labels.count(), "labelled").maybe_in(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    model = docs.sparkSession.sparkContext.broadcast(fit(features(labelled.where(~_held_out(F.col("doc_id")))), labels, scratch))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([statistics(t) for t in b.column("text").cast(pa.binary()).to_pylist()])
                yield b.filter(pa.array(model.value.scores(x) >= CUT))

    return docs.mapInArrow(keep, docs.schema)
