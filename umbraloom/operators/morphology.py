"""Stencils on dense grids: erosion, dilation, opening, ground filter, summed areas, nearest fill.

A frame of k rows before and after, clipped at the border, gives what a reflecting border does, since a reflected sample is
in the frame already. Frames count rows, so a grid has to be dense: densify it first.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slope and least object height of the ground filter.
SLOPE, MIN_OBJECT_M = 0.05, 2.0


def densify(cells: DataFrame, by: Sequence[str], height: int, width: int, value: str = "z") -> DataFrame:
    """Every (row, col) of each grid, null where there was no cell."""
    grid = cells.select(*by).distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return grid.join(cells.select(*by, "row", "col", value), [*by, "row", "col"], "left")


def _pass(cells: DataFrame, by: Sequence[str], value: str, size: int, pick) -> DataFrame:
    """A square window as two passes of a line each: 2n reads for each cell instead of n squared."""
    k = size // 2
    line = lambda along, across: Window.partitionBy(*by, across).orderBy(along).rowsBetween(-k, k)
    return cells.withColumn(value, pick(value).over(line("col", "row"))).withColumn(value, pick(value).over(line("row", "col")))


def erosion(cells: DataFrame, by: Sequence[str], value: str = "z", size: int = 3) -> DataFrame:
    return _pass(cells, by, value, size, F.min)


def dilation(cells: DataFrame, by: Sequence[str], value: str = "z", size: int = 3) -> DataFrame:
    return _pass(cells, by, value, size, F.max)


def opening(cells: DataFrame, by: Sequence[str], value: str = "z", size: int = 3) -> DataFrame:
    return dilation(erosion(cells, by, value, size), by, value, size)


def window_schedule(gsd: float, extent_m: float) -> list[int]:
    """3, 5, 9, 17, ... below the smallest odd window over extent / gsd, then that one."""
    final = int(np.floor(extent_m / gsd)) + 1
    final += final % 2 == 0
    out, w = [], 3
    while w < final:
        out.append(w)
        w = 2 * w - 1
    return [*out, max(final, 3)]


def ground_filter(cells: DataFrame, by: Sequence[str], value: str = "z", gsd: float = 1.0, extent_m: float = 8.0, slope: float = SLOPE, min_object_m: float = MIN_OBJECT_M) -> DataFrame:
    """The cells of a dense grid with is_ground: not flagged by any stage of progressive opening, and valid.

    Holes must be filled in a column `filled`, or the value has none.
    """
    surface = "filled" if "filled" in cells.columns else value
    out = cells.withColumns({"_s": F.col(surface), "_flag": F.lit(False)})
    for w in window_schedule(gsd, extent_m):
        out = opening(out.withColumn("_o", F.col("_s")), by, "_o", w)
        limit = min_object_m + slope * w * gsd
        out = out.withColumns({"_flag": F.col("_flag") | F.coalesce(F.col("_s") - F.col("_o") > limit, F.lit(False)), "_s": F.col("_o")})
    return out.select(*cells.columns, (F.col(value).isNotNull() & ~F.col("_flag")).alias("is_ground"))


def summed_area(cells: DataFrame, by: Sequence[str], what: Column, name: str = "sat") -> DataFrame:
    """The sum of a quantity over all cells above and to the left, inclusive, on a dense grid."""
    rows = Window.partitionBy(*by, "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    cols = Window.partitionBy(*by, "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("_r", F.sum(what).over(rows)).withColumn(name, F.sum("_r").over(cols)).drop("_r")


def block_sums(blocks: DataFrame, sat: DataFrame, by: Sequence[str], name: str = "sat") -> DataFrame:
    """Blocks (r0, c0, r1, c1), ends inclusive, with the sum inside: four look-ups of the summed area, whatever their size."""
    out = blocks
    for k, (r, c) in enumerate((("r1", "c1"), ("r0 - 1", "c1"), ("r1", "c0 - 1"), ("r0 - 1", "c0 - 1"))):
        look = sat.select(*by, F.col("row").alias(f"_r{k}"), F.col("col").alias(f"_c{k}"), F.col(name).alias(f"_v{k}"))
        out = out.withColumns({f"_r{k}": F.expr(r), f"_c{k}": F.expr(c)}).join(look, [*by, f"_r{k}", f"_c{k}"], "left")
    v = [F.coalesce(f"_v{k}", F.lit(0)) for k in range(4)]
    return out.select(*blocks.columns, (v[0] - v[1] - v[2] + v[3]).alias("inside"))


def nearest_fill(cells: DataFrame, by: Sequence[str], value: str = "z", strip: int = 16) -> DataFrame:
    """The cells of a dense grid with `filled`: invalid ones take the value of the nearest valid cell (Euclidean; ties by row, then col).

    Two passes over lines, so no task holds a raster. Along each row, windows find the nearest valid cell. Along each column the least squared distance over all rows is the lower
    envelope of one parabola for each row, which is exact; columns are dealt in strips. A grid without valid cells stays null.
    """
    seen = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.struct(F.col("col").alias("c"), F.col(value).cast("double").alias("z")))
    row = Window.partitionBy(*by, "row").orderBy("col")
    left, right = F.last(seen, ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0)), F.first(seen, ignorenulls=True).over(row.rowsBetween(0, Window.unboundedFollowing))
    near = cells.withColumns({"_l": left, "_r": right})
    nearer = F.col("_r").isNull() | (F.col("col") - F.col("_l.c") <= F.col("_r.c") - F.col("col"))  # the left one of two
    at = F.when(F.col("_l").isNotNull() & nearer, F.col("_l")).otherwise(F.col("_r"))
    near = near.withColumn("_a", at).withColumns({"_d": F.abs(F.col("col") - F.col("_a.c")).cast("long"), "_z": F.col("_a.z"), "_strip": F.floor(F.col("col") / strip)}).drop("_l", "_r", "_a")
    kept, names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema.fields), cells.columns

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["col", "row"], kind="stable").reset_index(drop=True)
        out = pdf["_z"].to_numpy(float).copy()
        rows, d, ok = pdf["row"].to_numpy(np.int64), pdf["_d"].fillna(-1).to_numpy(np.int64), pdf["_d"].notna().to_numpy()
        cut = [0, *np.flatnonzero(np.diff(pdf["col"].to_numpy())) + 1, len(pdf)]
        for a, b in itertools.pairwise(cut):
            if d[a:b].any() and ok[a:b].any():
                best = nearest_rows(rows[a:b], np.where(ok[a:b], d[a:b], -1))
                out[a:b] = out[a + best]
        return pdf[names].assign(filled=out)

    return near.groupBy(*by, "_strip").applyInPandas(fill, f"{kept}, filled double")


def nearest_rows(rows: np.ndarray, distances: np.ndarray) -> np.ndarray:
    """For each of the ascending rows of a column, which index k makes (row - rows[k])^2 + distances[k]^2 least; the first of equal ones. -1: k is no candidate, but some k is."""
    ks: list[int] = []
    starts: list[int] = []  # from which row on each beats all before it
    row, far = rows.tolist(), distances.tolist()
    for k, (r, d) in enumerate(zip(row, far, strict=True)):
        if d < 0:
            continue
        height, start = r * r + d * d, row[0]
        while ks:
            j = ks[-1]
            start = (height - row[j] ** 2 - far[j] ** 2) // (2 * (r - row[j])) + 1
            if start > starts[-1]:
                break
            ks.pop()
            starts.pop()
            start = row[0]
        ks.append(k)
        starts.append(start)
    return np.array(ks)[np.searchsorted(starts, rows, side="right") - 1]
