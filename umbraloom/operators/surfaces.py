"""Surface products: DSM, nDSM, terrain under objects, look-ups, tolerance checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraloom.functions.geometry import map_to_pixel_index
from umbraloom.functions.values import calibrated_agl, checked_calibration
from umbraloom.operators.morphology import ground_filter
from umbraloom.operators.terrain import interpolate_dtm


def fuse_dsm(terrain: DataFrame, relative: DataFrame, a, b, at: Sequence[str] = ("scene_id", "row", "col"), require_positive_scale: bool = True) -> DataFrame:
    """terrain + a * exp(z_rel) + b where both sides are valid; grids are joined by position. Parameters that are not finite, and a scale that is not positive unless allowed, are refused."""
    a, b = checked_calibration(a, b, require_positive_scale)
    both = terrain.join(relative, list(at), "full")
    agl = calibrated_agl(F.col("z_rel"), a, b)
    return both.select(*at, "terrain", agl.alias("agl"), (F.col("terrain") + agl).alias("dsm"))


def ndsm(surface: DataFrame, dsm: str = "dsm", dtm: str = "dtm") -> DataFrame:
    """dsm - dtm, negatives kept and marked."""
    return surface.withColumn("ndsm", F.col(dsm) - F.col(dtm)).withColumn("negative", F.coalesce(F.col("ndsm") < 0, F.lit(False)))


def same_grid(a: DataFrame, b: DataFrame, what: str, by: str = "scene_id") -> DataFrame:
    """Two tables of grid structs by scene; an error where sizes or transforms differ by more than 1e-9."""
    near = lambda k: F.abs(F.col(f"x.{k}") - F.col(f"y.{k}")) <= 1e-9
    ok = (F.col("x.width") == F.col("y.width")) & (F.col("x.height") == F.col("y.height"))
    for k in "abcdef":
        ok = ok & near(k)
    both = a.select(by, F.col("grid").alias("x")).join(b.select(by, F.col("grid").alias("y")), by)
    return both.select(by, F.when(~ok, F.raise_error(F.lit(f"{what}: grids differ")).cast("boolean")).otherwise(True).alias("same"))


def height_at(points: DataFrame, pixels: DataFrame, grids: DataFrame, value: str = "z", by: str = "scene_id") -> DataFrame:
    """Points (scene_id, x, y) with the value of the pixel that they fall on; null outside or where there is none."""
    p = points.join(grids, by).withColumn("_p", map_to_pixel_index(F.col("grid"), "x", "y", F.col("grid.width"), F.col("grid.height")))
    p = p.withColumns({"row": F.col("_p.row"), "col": F.col("_p.col")}).drop("_p", "grid")
    return p.join(pixels.select(by, "row", "col", value), [by, "row", "col"], "left")


def bilinear(z: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Values at fractional pixel centres; NaN where any of the four neighbours is invalid or outside."""
    h, w = z.shape
    r, c = rows - 0.5, cols - 0.5
    r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
    fr, fc = r - r0, c - c0
    ok = (r0 >= 0) & (c0 >= 0) & (r0 + (fr > 0) < h) & (c0 + (fc > 0) < w)
    at = lambda i, j: z[np.clip(i, 0, h - 1), np.clip(j, 0, w - 1)]
    parts = ((at(r0, c0), (1 - fr) * (1 - fc)), (at(r0, c0 + 1), (1 - fr) * fc), (at(r0 + 1, c0), fr * (1 - fc)), (at(r0 + 1, c0 + 1), fr * fc))
    out = sum(np.where(k > 0, v * k, 0.0) for v, k in parts)  # a neighbour without weight may be invalid
    return np.where(ok, out, np.nan)


def resample_terrain(targets: DataFrame, dem: DataFrame, grids: DataFrame, dem_id: str = "dem_id") -> DataFrame:
    """Targets (dem_id, row, col, x, y in the DEM's CRS) with terrain by bilinear interpolation of dem (dem_id, row, col, z).

    Four look-ups on equal keys, then one weighted sum; null where a neighbour with weight is missing.
    """
    g = F.col("grid")
    t = targets.join(grids, dem_id)
    det = g["a"] * g["e"] - g["b"] * g["d"]
    c = F.try_divide(g["e"] * (F.col("x") - g["c"]) - g["b"] * (F.col("y") - g["f"]), det) - 0.5
    r = F.try_divide(g["a"] * (F.col("y") - g["f"]) - g["d"] * (F.col("x") - g["c"]), det) - 0.5
    t = t.withColumns({"_r": F.floor(r).cast("int"), "_c": F.floor(c).cast("int"), "_fr": r - F.floor(r), "_fc": c - F.floor(c)}).drop("grid")
    w = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), ((F.col("_fr") if i else 1 - F.col("_fr")) * (F.col("_fc") if j else 1 - F.col("_fc"))).alias("w")) for i in (0, 1) for j in (0, 1)))
    four = t.withColumn("_n", F.explode(w)).withColumns({"_dr": F.col("_r") + F.col("_n.i"), "_dc": F.col("_c") + F.col("_n.j"), "_w": F.col("_n.w")}).where("_w > 0")
    got = four.join(dem.select(dem_id, F.col("row").alias("_dr"), F.col("col").alias("_dc"), F.col("z").alias("_z")), [dem_id, "_dr", "_dc"], "left")
    return got.groupBy(*targets.columns).agg(F.when(F.count("_z") == F.count("*"), F.sum(F.col("_z") * F.col("_w"))).alias("terrain"))


def acceptance(pixels: DataFrame, by: Sequence[str], derived: str, truth: str, tolerance: float) -> DataFrame:
    """max, mean absolute, RMSE and bias of a derived surface, and whether the largest is within the tolerance."""
    e = F.col(derived) - F.col(truth)
    return pixels.groupBy(*by).agg(F.count(e).alias("n"), F.max(F.abs(e)).alias("max_abs"), F.avg(F.abs(e)).alias("mean_abs"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias")).withColumn("accepted", F.coalesce(F.col("max_abs") <= tolerance, F.lit(False)))


def derive_surfaces(dsm: DataFrame, by: Sequence[str], gsd: float, extent_m: float, value: str = "z", readmit_m: float = 0.5, extractor: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A dense DSM's cells with is_ground, dtm, is_final_ground, ndsm and non_ground (valid, but no ground): ground -> terrain -> height above it.

    extractor: any function from cells to cells with is_ground; the progressive opening by default.
    """
    found = (extractor or (lambda c: ground_filter(c, by, value, gsd, extent_m)))(dsm)
    out = interpolate_dtm(found, by, value, readmit_m)
    return ndsm(out, value, "dtm").withColumn("non_ground", F.col(value).isNotNull() & ~F.col("is_ground"))


def overlapping(a: DataFrame, b: DataFrame, by: str = "scene_id") -> DataFrame:
    """(by, overlap) of two tables of extents (by, left, bottom, right, top) in one CRS: whether they share an area; touching edges do not."""
    both = a.select(by, F.struct("left", "bottom", "right", "top").alias("x")).join(b.select(by, F.struct("left", "bottom", "right", "top").alias("y")), by)
    apart = (F.col("y.right") <= F.col("x.left")) | (F.col("y.left") >= F.col("x.right")) | (F.col("y.top") <= F.col("x.bottom")) | (F.col("y.bottom") >= F.col("x.top"))
    return both.select(by, (~apart).alias("overlap"))
