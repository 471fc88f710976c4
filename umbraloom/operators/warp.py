"""Rasters carried over to other grids and coordinate systems, block by block.

Each target pixel is mapped back into the source: its middle, through both coordinate systems, to a fractional place. It belongs to the source block that holds
this place; blocks get a rim of their neighbours' pixels as wide as the kernel. So targets and blocks meet on equal block numbers, and no group holds more than
a block and what falls on it, cut by a salt where much does.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbraloom.functions.geometry import utm_forward, utm_inverse
from umbraloom.operators.lineage import cut

#: Pixels of a kernel before and after the one that holds a place.
RIMS = {"nearest": 0, "bilinear": 1, "cubic": 2}
BLOCK = 256
#: Targets that share a copy of a block.
TARGETS_AT_ONCE = 1 << 18


def _zone(crs: str) -> tuple[int, bool] | None:
    """(zone, whether south) of a UTM code on WGS84; None for geographic coordinates."""
    code = int(crs.upper().removeprefix("EPSG:"))
    if code == 4326:
        return None
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return code % 100, code > 32700
    raise ValueError(f"{crs} is neither WGS84 nor one of its UTM zones")


def reprojected(df: DataFrame, x: str, y: str, source: str, target: str) -> DataFrame:
    """Positions in columns x and y from one coordinate system in another: WGS84 and its UTM zones. Each series is a step of its own: written as one
    expression, every place where the second uses its latitude would hold the whole first."""
    a, b = _zone(source), _zone(target)
    if a == b:
        return df
    if a is not None:
        ll = utm_inverse(F.col(x), F.col(y), F.lit(a[0]), F.lit(a[1]))
        df = df.withColumn("_ll", ll).withColumns({x: F.col("_ll.lon"), y: F.col("_ll.lat")}).drop("_ll")
    if b is None:
        return df
    en = df.withColumn("_en", utm_forward(F.col(x), F.col(y), F.lit(b[0])))
    # a zone's northing counts from the equator on its own side
    shift = F.when(F.col(y) >= 0, 10_000_000.0).otherwise(0.0) if b[1] else F.when(F.col(y) < 0, -10_000_000.0).otherwise(0.0)
    return en.withColumns({x: F.col("_en.easting"), y: F.col("_en.northing") + shift}).drop("_en")


def source_places(targets: DataFrame, target_grid: Sequence[float], target_crs: str, source_grid: Sequence[float], source_crs: str) -> DataFrame:
    """Targets (row, col, ...) with the fractional place (src_r, src_c) of their middle in the source; the middle of its first pixel is at 0.5."""
    a, b, c, d, e, f = (float(v) for v in target_grid)
    x = F.lit(a) * (F.col("col") + 0.5) + F.lit(b) * (F.col("row") + 0.5) + F.lit(c)
    y = F.lit(d) * (F.col("col") + 0.5) + F.lit(e) * (F.col("row") + 0.5) + F.lit(f)
    at = reprojected(targets.withColumns({"_x": x, "_y": y}), "_x", "_y", target_crs, source_crs)
    sa, sb, sc, sd, se, sf = (float(v) for v in source_grid)
    det = sa * se - sb * sd
    if not det:
        raise ValueError("the source's transform is degenerate")
    x, y = F.col("_x") - sc, F.col("_y") - sf
    return at.withColumns({"src_c": (se * x - sb * y) / det, "src_r": (sa * y - sd * x) / det}).drop("_x", "_y")


def weights(t: np.ndarray, kernel: str) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, weights (n, taps)) for places t along one axis, counted from the first tap's pixel at floor(t) of a shifted axis."""
    if kernel == "nearest":
        return np.floor(t).astype(np.int64)[:, None], np.ones((len(t), 1))
    base = np.floor(t - 0.5).astype(np.int64)
    s = t - 0.5 - base
    if kernel == "bilinear":
        return base[:, None] + np.arange(2), np.stack([1 - s, s], axis=1)
    d = np.abs(s[:, None] - np.arange(-1, 3))
    near, far = 1.5 * d**3 - 2.5 * d**2 + 1, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2  # cubic convolution of parameter -1/2
    return base[:, None] + np.arange(-1, 3), np.where(d <= 1, near, np.where(d < 2, far, 0.0))


def sampled(z: np.ndarray, r: np.ndarray, c: np.ndarray, low: tuple[int, int], shape: tuple[int, int], kernel: str) -> np.ndarray:
    """Values at places (r, c) of a source of `shape`, of which z holds the pixels from `low` on; NaN outside and where a pixel of the kernel with weight is invalid. Pixels beyond the
    source's border have no weight; the others make up for it."""
    rows, wr = weights(r, kernel)
    cols, wc = weights(c, kernel)
    wr = np.where((rows >= 0) & (rows < shape[0]), wr, 0.0)
    wc = np.where((cols >= 0) & (cols < shape[1]), wc, 0.0)
    total, value, bad = np.zeros(len(r)), np.zeros(len(r)), np.zeros(len(r), bool)
    for i in range(rows.shape[1]):
        for j in range(cols.shape[1]):
            w = wr[:, i] * wc[:, j]
            v = z[np.clip(rows[:, i] - low[0], 0, z.shape[0] - 1), np.clip(cols[:, j] - low[1], 0, z.shape[1] - 1)]
            bad |= (w != 0) & ~np.isfinite(v)
            value += np.where(w != 0, np.nan_to_num(v) * w, 0.0)
            total += w
    inside = (r >= 0) & (r < shape[0]) & (c >= 0) & (c < shape[1])
    return np.where(inside & ~bad & (total > 0), value / np.where(total > 0, total, 1), np.nan)


def warp(targets: DataFrame, source: DataFrame, shape: tuple[int, int], kernel: str = "bilinear", block: int = BLOCK) -> DataFrame:
    """Targets (row, col, src_r, src_c) with `value` from source pixels (row, col, z); null outside the source, where the kernel meets an invalid or absent pixel, and where the
    place is null. shape: the source's (rows, columns). Targets and pixels have a row each; an empty table gives no rows."""
    if kernel not in RIMS:
        raise ValueError(f"kernel {kernel} is none of {', '.join(RIMS)}")
    rim = RIMS[kernel]
    targets = cut(targets)  # read twice; and a condition on a place would else be pushed below its series, which it would repeat
    inside = F.coalesce((F.col("src_r") >= 0) & (F.col("src_r") < shape[0]) & (F.col("src_c") >= 0) & (F.col("src_c") < shape[1]), F.lit(False))
    names = targets.columns
    div = lambda c: F.floor(c / block).cast("int")
    asked = targets.where(inside).withColumns({"_br": div(F.col("src_r")), "_bc": div(F.col("src_c"))})
    counts = asked.groupBy("_br", "_bc").agg(F.ceil(F.count("*") / TARGETS_AT_ONCE).cast("int").alias("_copies"))
    asked = asked.join(counts, ["_br", "_bc"]).withColumn("_salt", F.pmod(F.xxhash64("row", "col"), F.col("_copies")).cast("int")).drop("_copies")
    span = lambda c: F.explode(F.sequence(div(F.col(c) - rim), div(F.col(c) + rim)))
    pixels = source.select(F.col("row").cast("int").alias("_r"), F.col("col").cast("int").alias("_c"), F.col("z").cast("double").alias("_z")).where("_z is not null")
    pixels = pixels.select("_r", "_c", "_z", span("_r").alias("_br")).withColumn("_bc", span("_c"))
    copied = pixels.join(counts, ["_br", "_bc"]).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in targets.schema.fields)

    def run(key, own: pd.DataFrame, px: pd.DataFrame) -> pd.DataFrame:
        br, bc, _ = key
        low, size = (int(br) * block - rim, int(bc) * block - rim), block + 2 * rim
        z = np.full((size, size), np.nan)
        z[px["_r"] - low[0], px["_c"] - low[1]] = px["_z"]
        return own[names].assign(value=sampled(z, own["src_r"].to_numpy(float), own["src_c"].to_numpy(float), low, shape, kernel))

    keys = ["_br", "_bc", "_salt"]
    got = asked.groupBy(*keys).cogroup(copied.groupBy(*keys)).applyInPandas(run, f"{kinds}, value double")
    got = got.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    return got.unionAll(targets.where(~inside).withColumn("value", F.lit(None).cast("double")))
