"""Connected components of footprint pixels, tile by tile."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraloom.operators.lineage import cut
from umbraloom.operators.unions import ranked, united

#: Least footprint area, class of roofs.
MIN_AREA_PX, BUILDING_CLASS = 50, 6


def label_grid(mask: np.ndarray, connectivity: int = 4) -> np.ndarray:
    """Labels 1, 2, ... in row-major order of each component's first pixel; 0 for background.

    Runs of each row are joined with those that they touch in the row before, by union-find over runs.
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    parent = np.arange(len(row))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    reach = 1 if connectivity == 8 else 0
    at = np.searchsorted(row, np.arange(h + 1))
    for r in range(1, h):
        i, j = at[r - 1], at[r]
        while i < at[r] and j < at[r + 1]:
            if first[i] < stop[j] + reach and first[j] < stop[i] + reach:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if stop[i] < stop[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(row))], int)
    number = np.unique(roots, return_inverse=True)[1] + 1 if len(roots) else roots
    out = np.zeros((h, w), np.int32)
    for r, x, y, n in zip(row, first, stop, number, strict=True):
        out[r, x:y] = n
    return out


def footprints(labels: DataFrame, building_class: int = BUILDING_CLASS, connectivity: int = 4, by: Sequence[str] = ("tile_id",)) -> DataFrame:
    """labels (tile_id, row, col, cls) -> (tile_id, building_id, row, col) of the class's components; ids are <tile>:b0001 in raster order."""
    by = list(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = pdf["row"].min(), pdf["col"].min()
        mask = np.zeros((pdf["row"].max() - r0 + 1, pdf["col"].max() - c0 + 1), bool)
        mask[pdf["row"] - r0, pdf["col"] - c0] = True
        tag = ":".join(str(pdf[b].iloc[0]) for b in by)
        return pdf[[*by, "row", "col"]].assign(building_id=[f"{tag}:b{n:04d}" for n in label_grid(mask, connectivity)[pdf["row"] - r0, pdf["col"] - c0]])

    kinds = ", ".join(f"{b} {labels.schema[b].dataType.simpleString()}" for b in by)
    return labels.where(F.col("cls") == building_class).select(*by, F.col("row").cast("int"), F.col("col").cast("int")).groupBy(*by).applyInPandas(run, f"{kinds}, row int, col int, building_id string")


def screen_footprints(pixels: DataFrame, height, width, by: Sequence[str] = ("tile_id",), min_area: int = MIN_AREA_PX) -> DataFrame:
    """(by, building_id, area_px, bounding box, extent, rejection): extent is the share of the box; area is tested before the touch of an edge."""
    agg = pixels.groupBy(*by, "building_id").agg(F.count("*").alias("area_px"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    edge = (F.col("r0") == 0) | (F.col("c0") == 0) | (F.col("r1") == height - 1) | (F.col("c1") == width - 1)
    box = (F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1)
    return agg.select("*", (F.col("area_px") / box).alias("extent"), F.when(F.col("area_px") < min_area, "min_area").when(edge, "edge_touching").alias("rejection"))


def rejection_counts(screened: DataFrame) -> DataFrame:
    return screened.groupBy(F.coalesce("rejection", F.lit("kept")).alias("rejection")).agg(F.count("*").alias("n"))


def zonal_means(pixels: DataFrame, zones: DataFrame, zone: str, value: str, min_valid: float = 0.9, at: Sequence[str] = ("scene_id", "row", "col")) -> DataFrame:
    """(zone, n, valid_fraction, mean): null mean below the least share of valid pixels."""
    got = zones.join(pixels.select(*at, value), list(at), "left").groupBy(zone).agg(F.count("*").alias("n"), (F.count(value) / F.count("*")).alias("valid_fraction"), F.avg(value).alias("mean"))
    return got.withColumn("mean", F.when(F.col("valid_fraction") >= min_valid, F.col("mean")))


def hull_pixels(rows: np.ndarray, cols: np.ndarray) -> int:
    """The number of pixels whose centre lies in the convex hull of the pixels' edge middles, border included."""
    p = np.unique(np.concatenate([np.stack([rows + dr, cols + dc], axis=1) for dr, dc in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))]), axis=0)
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    sides = []
    for points in (p.tolist(), p[::-1].tolist()):
        side: list[list[float]] = []
        for q in points:
            while len(side) > 1 and cross(side[-2], side[-1], q) <= 0:
                side.pop()
            side.append(q)
        sides += side[:-1]
    r, c = np.mgrid[rows.min() : rows.max() + 1, cols.min() : cols.max() + 1]
    inside = np.ones(r.shape, bool)
    for (ar, ac), (br, bc) in zip(sides, [*sides[1:], sides[0]], strict=True):
        inside &= (br - ar) * (c - ac) - (bc - ac) * (r - ar) >= -1e-9
    return int(inside.sum())


def solidity(pixels: DataFrame, by: Sequence[str] = ("tile_id", "building_id")) -> DataFrame:
    """(by, area_px, hull_px, solidity): the share of the convex hull that a footprint fills. A building is one group, which is small by its nature."""
    by = list(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = hull_pixels(pdf["row"].to_numpy(float), pdf["col"].to_numpy(float))
        return pd.DataFrame([{**{b: pdf[b].iloc[0] for b in by}, "area_px": len(pdf), "hull_px": n, "solidity": len(pdf) / n}])

    kinds = ", ".join(f"{b} {pixels.schema[b].dataType.simpleString()}" for b in by)
    return pixels.select(*by, "row", "col").distinct().groupBy(*by).applyInPandas(run, f"{kinds}, area_px long, hull_px long, solidity double")


def isolation(footprints: DataFrame, buildings: DataFrame, distance: int, by: Sequence[str] = ("tile_id",), key: str = "building_id") -> DataFrame:
    """(by, building_id, isolated): whether no building pixel outside of the footprint lies within so many steps to the four sides.

    Steps become rows, so the join is on equal keys; 0 finds all isolated.
    """
    steps = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in range(-distance, distance + 1) for c in range(abs(r) - distance, distance - abs(r) + 1))))
    near = footprints.withColumn("_s", steps).select(*by, key, (F.col("row") + F.col("_s.r")).alias("row"), (F.col("col") + F.col("_s.c")).alias("col")).distinct()
    other = near.join(buildings.select(*by, "row", "col").distinct(), [*by, "row", "col"]).join(footprints.select(*by, key, "row", "col"), [*by, key, "row", "col"], "left_anti")
    met = other.select(*by, key).distinct().withColumn("_met", F.lit(True))
    return footprints.select(*by, key).distinct().join(met, [*by, key], "left").select(*by, key, F.col("_met").isNull().alias("isolated"))


def windows(footprints: DataFrame, margin: int, height, width, by: Sequence[str] = ("tile_id", "building_id")) -> DataFrame:
    """(by, r0, r1, c0, c1), ends exclusive: each footprint's box with a margin, cut at the image's edge."""
    lo = lambda c: F.greatest(F.lit(0), F.min(c) - margin)
    return footprints.groupBy(*by).agg(lo("row").alias("r0"), F.least(F.lit(height), F.max("row") + margin + 1).alias("r1"), lo("col").alias("c0"), F.least(F.lit(width), F.max("col") + margin + 1).alias("c1"))


def assessed(shadows: DataFrame, footprints: DataFrame, agl: DataFrame, buildings: DataFrame, distance: int, zone: DataFrame, by: Sequence[str] = ("tile_id",), key: str = "building_id") -> DataFrame:
    """Measured buildings (by, key, usable, confidence, length_px, spread_px) with all that a reference is judged by: area, solidity, isolation, share of valid
    heights, median height, relative spread and the shadow zone's share of open ground (zone: by, key, ground_share)."""
    at, px = [*by, key], [*by, "row", "col"]
    heights = footprints.select(*at, "row", "col").join(agl.select(*px, "z"), px, "left").groupBy(*at).agg((F.count("z") / F.count("*")).alias("valid_fraction"), F.percentile("z", 0.5).alias("height_m"))
    out = shadows.join(solidity(footprints, at), at, "left").join(isolation(footprints, buildings, distance, by, key), at, "left").join(heights, at, "left").join(zone, at, "left")
    return out.withColumn("rel_spread", F.try_divide(F.col("spread_px"), F.col("length_px")))


def tiled_footprints(labels: DataFrame, tile: int = 512, building_class: int = BUILDING_CLASS, connectivity: int = 4, by: Sequence[str] = ("scene_id",)) -> DataFrame:
    """labels (by, row, col, cls) of rasters of any size -> (by, building_id, row, col) of the class's components; ids are <by>:b0001 in raster order of each component's first pixel.

    Pixels are labelled within tiles, so a group is a tile. A label is its first pixel's place in the whole raster. Pixels that touch across a border tie labels together,
    and the labels, not the pixels, are united. A component that stays inside its tile has no tie and takes no part in that. Results do not depend on the size of tiles.
    Rows whose place is null are left out; repeated pixels count once; an empty table gives no rows.
    """
    by = list(by)
    place = F.col("row").cast("long") * (1 << 32) + F.col("col")
    kinds = ", ".join(f"{b} {labels.schema[b].dataType.simpleString()}" for b in by)
    px = labels.where((F.col("cls") == building_class) & F.col("row").isNotNull() & F.col("col").isNotNull()).select(*by, F.col("row").cast("int"), F.col("col").cast("int")).distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
        r, c = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        mask = np.zeros((r.max() + 1, c.max() + 1), bool)
        mask[r, c] = True
        found = label_grid(mask, connectivity)
        first = np.full(found.max() + 1, np.iinfo(np.int64).max)
        rows, cols = np.nonzero(found)
        np.minimum.at(first, found[rows, cols], (rows + r0).astype(np.int64) * (1 << 32) + cols + c0)
        return pdf[[*by, "row", "col"]].assign(label=first[found[r, c]])

    cells = px.withColumns({"_tr": F.floor(F.col("row") / tile), "_tc": F.floor(F.col("col") / tile)})
    marked = cut(cells.groupBy(*by, "_tr", "_tc").applyInPandas(run, f"{kinds}, row int, col int, label long"))
    # pixels of the last row or column of a tile, beside those of the next tiles; diagonal ones as well where eight neighbours touch
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    lies = lambda dr, dc: (F.floor((F.col("row") + dr) / tile) != F.floor(F.col("row") / tile)) | (F.floor((F.col("col") + dc) / tile) != F.floor(F.col("col") / tile))
    moved = F.filter(F.array(*(F.when(lies(dr, dc), F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"))) for dr, dc in steps)), lambda s: s.isNotNull())
    across = marked.select(*by, F.col("label").alias("a"), F.explode(moved).alias("s")).select(*by, "a", F.col("s.row").alias("row"), F.col("s.col").alias("col"))
    edge = (F.pmod("row", F.lit(tile)) == 0) | (F.pmod("col", F.lit(tile)).isin(0, tile - 1))
    ties = across.join(marked.where(edge).select(*by, "row", "col", F.col("label").alias("b")), [*by, "row", "col"]).select(*by, "a", "b").where("a != b").distinct()
    roots = united(ties, by)
    whole = marked.join(roots, [*by, "label"], "left").select(*by, "row", "col", F.coalesce("root", "label").alias("_root"))
    numbers = ranked(whole.where(F.col("_root") == place).select(*by, "_root"), by, "_root", "_k", bits=42)
    tag = F.concat_ws(":", *(F.col(b).cast("string") for b in by), F.concat(F.lit("b"), F.lpad(F.col("_k").cast("string"), 4, "0")))
    wide = F.concat_ws(":", *(F.col(b).cast("string") for b in by), F.concat(F.lit("b"), F.col("_k").cast("string")))
    return whole.join(numbers, [*by, "_root"]).select(*by, F.when(F.col("_k") < 10_000, tag).otherwise(wide).alias("building_id"), "row", "col")
