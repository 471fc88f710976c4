"""Tile diagnostics as pixels: line segments, outlines of masks, and layers laid over each other, all as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment_pixels(segments: DataFrame, by: Sequence[str], height: int, width: int) -> DataFrame:
    """(by, row, col) of segments (by, r0, c0, r1, c1) between whole pixels: one pixel for each step along the longer axis, both ends included, halves rounded to even. What lies outside of the
    image is left out, and so are segments with a null end; a segment of no length is its pixel."""
    dr, dc = F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")
    n = F.greatest(F.abs(dr), F.abs(dc))
    steps = segments.where(n.isNotNull()).select(*by, "r0", "c0", dr.alias("_dr"), dc.alias("_dc"), n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long"))).alias("_k"))
    at = lambda start, d: (F.col(start) + F.rint(F.coalesce(F.try_divide(F.col(d) * F.col("_k"), F.col("_n").cast("double")), F.lit(0.0)))).cast("int")
    return steps.select(*by, at("r0", "_dr").alias("row"), at("c0", "_dc").alias("col")).where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).distinct()


def outline_pixels(mask: DataFrame, by: Sequence[str]) -> DataFrame:
    """The pixels of a mask (by, row, col) that lack one of their four neighbours in it; those at an image's border are such. Neighbours are looked up along lines, rows and columns in turn."""
    px = mask.select(*by, "row", "col").distinct()

    def both(along: str, across: str) -> Column:
        w = Window.partitionBy(*by, across).orderBy(along)
        return (F.lag(along).over(w) == F.col(along) - 1) & (F.lead(along).over(w) == F.col(along) + 1)

    marked = px.withColumn("_r", F.coalesce(both("col", "row"), F.lit(False))).withColumn("_c", F.coalesce(both("row", "col"), F.lit(False)))
    return marked.where(~(F.col("_r") & F.col("_c"))).drop("_r", "_c")


def composed(base: DataFrame, layers: Sequence[tuple[DataFrame, tuple[int, int, int]]], by: Sequence[str], value: str = "v") -> DataFrame:
    """(by, row, col, red, green, blue): base's grey of 0 to 255, black where it is null, below layers of pixels (by, row, col) with a colour each; later ones lie above.

    A layer shows on pixels of the base only."""
    at = [*by, "row", "col"]
    over = None
    for k, (px, (r, g, b)) in enumerate(layers):
        one = px.select(*at, F.struct(F.lit(k).alias("k"), F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b")).alias("_top"))
        over = one if over is None else over.unionAll(one)
    grey = F.coalesce(F.rint(F.least(F.greatest(F.col(value), F.lit(0)), F.lit(255))), F.lit(0.0)).cast("int")
    if over is None:
        return base.select(*at, *(grey.alias(c) for c in ("red", "green", "blue")))
    shown = base.join(over.groupBy(*at).agg(F.max("_top").alias("_top")), at, "left")
    return shown.select(*at, *(F.coalesce(F.col(f"_top.{k}"), grey).alias(c) for k, c in zip("rgb", ("red", "green", "blue"), strict=True)))
