"""Error sums kept up by a stream of pixels.

The state is one row of sums for each key, whatever the number of pixels; batches add to it, and metrics follow at any time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from umbraloom.functions.values import not_finite
from umbraloom.operators.metrics import error_sums, merged_errors


def streaming_errors(pixels: DataFrame, by: Sequence[str], p: str = "p", r: str = "r") -> DataFrame:
    """MAE, RMSE and bias so far, for complete or update mode."""
    e = F.col(p) - F.col(r)
    return pixels.where(~(not_finite(p) | not_finite(r))).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def windowed_errors(pixels: DataFrame, ts: str, width: str, late: str, by: Sequence[str], p: str = "p", r: str = "r") -> DataFrame:
    """The same by event-time window; rows later than the watermark are left out, and closed windows leave the state."""
    e = F.col(p) - F.col(r)
    return pixels.withWatermark(ts, late).where(~(not_finite(p) | not_finite(r))).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))


def append_sums(pixels: DataFrame, by: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's sums as Parquet; a batch that runs again after a failure replaces its own folder, so nothing counts twice."""

    def add(batch: DataFrame, number: int) -> None:
        error_sums(batch, by).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pixels.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark, path: str, by: Sequence[str]) -> DataFrame:
    return merged_errors(spark.read.parquet(path), by)
