"""The order of samples in each epoch: a keyed permutation that gives any step's sample at once, without a sort and without a stored order.

Swap-or-not: each round pairs every number x with (k - x) mod n and swaps the pair or not, as a keyed bit of the larger of the two says. Each round is its own inverse, so the
whole is a permutation of 0 to n - 1 for any n.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 40
PRIME = (1 << 31) - 1  # bits come from a line modulo this prime


def round_keys(seed: int, epoch: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """(k, a, b) of each round: what pairs numbers, and the line whose parity is the bit."""
    out = []
    for r in range(rounds):
        d = hashlib.sha256(f"{seed}:{epoch}:{r}".encode()).digest()
        k, a, b = (int.from_bytes(d[i : i + 8], "big") for i in (0, 8, 16))
        out.append((k >> 1, 1 + a % (PRIME - 1), b % PRIME))
    return out


def permuted(x: Column, n: Column | int, keys: list[tuple[int, int, int]]) -> Column:
    """The sample at a place x of an epoch of n samples, below 2^31."""
    n = n if isinstance(n, Column) else F.lit(n).cast("long")
    rows = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for k, a, b in keys))

    def step(v: Column, key: Column) -> Column:
        other = (key["k"] % n + n - v) % n
        bit = (F.greatest(v, other) * key["a"] + key["b"]) % PRIME % 2
        return F.when(bit == 1, other).otherwise(v)

    return F.aggregate(rows, x.cast("long"), step)


def place_of(sample: Column, n: Column | int, keys: list[tuple[int, int, int]]) -> Column:
    """The place of a sample in an epoch: the rounds in reverse."""
    return permuted(sample, n, keys[::-1])


def epoch(spark: SparkSession, n: int, seed: int, number: int, workers: int = 1, worker: int = 0, batch: int = 1, start: int = 0) -> DataFrame:
    """(step, place, sample) of one worker's steps of an epoch from step `start` on. Places are dealt to workers in turn, and the last step takes what is left. The rows are a range,
    so any step is reached at once, on any number of partitions."""
    rows = spark.range(max(0, start) * batch, -(-n // workers))
    place = F.col("id") * workers + worker
    return rows.where(place < n).select(F.floor(F.col("id") / batch).alias("step"), place.alias("place"), permuted(place, n, round_keys(seed, number)).alias("sample"))
