"""A fit by rounds: the head of a height model as gradient steps over a table, with a frozen split, the best round by validation, and resumption.

The head is linear in its features and predicts a logarithmic height. A sample (a tile) has many pixels and one scale-invariant loss: the mean of d^2 less LAMBDA times the squared mean of d,
where d is the difference of logarithms. A round is one aggregation by sample and one over samples, both with partial sums where the rows are; the driver gets some
sums and takes one step. What a round leaves is written before the next begins, so a run that stops goes on where it was.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weight of the squared mean, least valid pixels of a sample.
LAMBDA, MIN_PIXELS = 0.85, 32


@dataclass
class State:
    """Weights (the last is the constant), the round that is next with them, and what has been seen so far."""

    weights: list[float]
    round: int = 0
    history: list[dict] = field(default_factory=list)
    best_round: int | None = None
    best_loss: float | None = None
    best_weights: list[float] | None = None


def sums(rows: DataFrame, features: Sequence[str], target: str, weights: Sequence[float], sample: str, split: str, min_pixels: int = MIN_PIXELS, balance: float = LAMBDA) -> dict[str, dict]:
    """By side of the split: the number of samples, their mean loss, and its gradient. Rows with a target that is null, not finite or not above zero, or with
    a null feature, count for nothing; samples with fewer than min_pixels of the others neither."""
    x = [*(F.col(f).cast("double") for f in features), F.lit(1.0)]
    d = sum((F.lit(float(w)) * f for w, f in zip(weights, x, strict=True)), F.lit(0.0)) - F.ln(F.col(target))
    kept = rows.where((F.col(target) > 0) & (F.col(target) < float("inf"))).withColumn("_d", d).where("_d is not null and not isnan(_d)")
    by = kept.groupBy(split, sample).agg(F.count("*").alias("_n"), F.avg("_d").alias("_m"), F.avg(F.col("_d") * F.col("_d")).alias("_q"), *(F.avg(f).alias(f"_x{i}") for i, f in enumerate(x)), *(F.avg(f * F.col("_d")).alias(f"_g{i}") for i, f in enumerate(x)))
    m = F.col("_m")
    loss = F.col("_q") - balance * m * m
    slope = [2 * (F.col(f"_g{i}") - balance * m * F.col(f"_x{i}")) for i in range(len(x))]
    total = by.where(F.col("_n") >= min_pixels).groupBy(split).agg(F.count("*").alias("n"), F.avg(loss).alias("loss"), *(F.avg(s).alias(f"s{i}") for i, s in enumerate(slope)))
    return {r[split]: {"n": r["n"], "loss": r["loss"], "slope": [r[f"s{i}"] for i in range(len(x))]} for r in total.collect()}  # two rows


def fit_rounds(rows: DataFrame, features: Sequence[str], target: str, sample: str, split: str, rounds: int, rate: float, folder: str | None = None, min_pixels: int = MIN_PIXELS, balance: float = LAMBDA) -> State:
    """`rounds` steps from zero, or from the state in `folder` on, where each round's is written. split is a column that says 'train' or 'val' and has to be the same for all rows of a sample; only training rows move the
    weights, validation rows choose the best round: the first with the least mean loss. Features should be scaled. Without training samples, or where a loss is no longer finite, it raises."""
    mixed = rows.groupBy(sample).agg(F.min(split).alias("a"), F.max(split).alias("b"), F.count(F.when(F.col(split).isNull() | ~F.col(split).isin("train", "val"), 1)).alias("odd"))
    if not mixed.where("a != b or odd > 0").isEmpty():
        raise ValueError("a sample is on both sides of the split, or on none")
    state = _stored(folder) or State([0.0] * (len(features) + 1))
    while state.round <= rounds:
        got = sums(rows, features, target, state.weights, sample, split, min_pixels, balance)
        if "train" not in got:
            raise ValueError("no training sample has enough valid pixels")
        train, val = got["train"], got.get("val")
        if not np.isfinite(train["loss"]):
            raise ValueError(f"the loss is not finite in round {state.round}: a smaller rate may help")
        state.history.append({"round": state.round, "train": train["loss"], "val": val["loss"] if val else None, "weights": list(state.weights)})
        held = (val or train)["loss"]
        if state.best_loss is None or held < state.best_loss:
            state.best_loss, state.best_round, state.best_weights = held, state.round, list(state.weights)
        state.weights = [w - rate * s for w, s in zip(state.weights, train["slope"], strict=True)]
        state.round += 1
        _store(folder, state)
    return state


def predicted(rows: DataFrame, features: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """Rows with z_rel, the logarithm of the relative height."""
    return rows.withColumn("z_rel", sum((F.lit(float(w)) * F.col(f) for w, f in zip(weights, features, strict=False)), F.lit(float(weights[-1]))))


def _store(folder: str | None, state: State) -> None:
    """The state under the name of its round; then only does `last` name it, so a reader never sees half a file."""
    if folder:
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/writing") as f:
            f.write(json.dumps(asdict(state)).encode())
        store.move(f"{at}/writing", f"{at}/state-{state.round:06d}.json")


def _stored(folder: str | None) -> State | None:
    if not folder:
        return None
    store, at = fs.FileSystem.from_uri(folder)
    if store.get_file_info(at).type != fs.FileType.Directory:
        return None
    names = sorted(i.path for i in store.get_file_info(fs.FileSelector(at)) if i.base_name.startswith("state-"))
    if not names:
        return None
    with store.open_input_stream(names[-1]) as f:
        return State(**json.loads(f.read()))
