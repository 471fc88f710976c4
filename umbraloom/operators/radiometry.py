"""Radiometric statistics: percentile stretches and Otsu's threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbraloom.functions.radiometry import stretched
from umbraloom.functions.values import equals_nodata, not_finite

#: Percentiles of a stretch.
LOW, HIGH = 2.0, 98.0


def band_stretches(pixels: DataFrame, by: Sequence[str], value: str = "value", low: float = LOW, high: float = HIGH, nodata: float | None = None) -> DataFrame:
    """(by, low, high, degenerate): linear percentiles of finite values that are not nodata, by band; for a shared stretch group by less.

    Equal percentiles fall back to the extremes; a flat band is degenerate, an empty one too, with 0 and 1.
    """
    v = F.col(value)
    ok = ~not_finite(v) & (~equals_nodata(v, nodata) if nodata is not None else F.lit(True))
    v = F.when(ok, v)
    out = pixels.groupBy(*by).agg(F.percentile(v, F.array(F.lit(low / 100), F.lit(high / 100))).alias("_q"), F.min(v).alias("_min"), F.max(v).alias("_max"))
    wide = F.coalesce(F.col("_q")[1] > F.col("_q")[0], F.lit(False))
    return out.select(*by, F.coalesce(F.when(wide, F.col("_q")[0]).otherwise(F.col("_min")), F.lit(0.0)).alias("low"), F.coalesce(F.when(wide, F.col("_q")[1]).otherwise(F.col("_max")), F.lit(1.0)).alias("high"), (F.col("_min").isNull() | (F.col("_min") == F.col("_max"))).alias("degenerate"))


def apply_stretch(pixels: DataFrame, stretches: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    return pixels.join(stretches, list(by)).withColumn("stretched", stretched(F.col(value), F.col("low"), F.col("high"), F.col("degenerate"))).drop("low", "high", "degenerate")


def otsu(pixels: DataFrame, by: Sequence[str], v: str = "v") -> DataFrame:
    """(by, threshold, separability, dark) of 8-bit values 0 to 255: the first threshold with the largest variance between classes.

    The histogram is at most 256 rows for each group, so the windows see no pixel. Dark pixels are v <= threshold.
    """
    hist = pixels.where(F.col(v).between(0, 255)).groupBy(*by, F.col(v).cast("int").alias("t")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    t, n = F.col("t").cast("double"), F.col("n")
    all_n = F.sum(n).over(whole)
    got = hist.select(*by, "t", (F.sum(n).over(upto) / all_n).alias("w"), (F.sum(t * n).over(upto) / all_n).alias("m"), (F.sum(t * n).over(whole) / all_n).alias("mt"), (F.sum(t * t * n).over(whole) / all_n).alias("sq"))
    w, m, mt = F.col("w"), F.col("m"), F.col("mt")
    between = F.when((w > 0) & (w < 1), F.try_divide((mt * w - m) * (mt * w - m), w * (1 - w))).otherwise(0.0)
    first = Window.partitionBy(*by).orderBy(F.desc("between"), "t")
    best = got.withColumn("between", F.coalesce(between, F.lit(0.0))).withColumn("_k", F.row_number().over(first)).where("_k = 1")
    return best.select(*by, F.col("t").alias("threshold"), F.coalesce(F.try_divide(F.col("between"), F.col("sq") - mt * mt), F.lit(0.0)).alias("separability"), w.alias("dark"))


def detect_shadow(pixels: DataFrame, by: Sequence[str], v: str = "v", fixed: int | None = None, suspicious: tuple[float, float] = (0.01, 0.6)) -> DataFrame:
    """The pixels with is_shadow, score (darkness, 0 to 1) and whether the share of shadow is suspicious. Thresholds are a row for each group."""
    if fixed is None:
        limits = otsu(pixels, by, v).select(*by, "threshold", "dark")
    else:
        limits = pixels.groupBy(*by).agg(F.lit(fixed).alias("threshold"), F.avg((F.col(v) <= fixed).cast("double")).alias("dark"))
    out = pixels.join(limits, list(by))
    return out.select(*pixels.columns, (F.col(v) <= F.col("threshold")).alias("is_shadow"), (1 - F.col(v) / 255.0).alias("score"), ~F.col("dark").between(*suspicious).alias("suspicious"))
