"""Tile plans: origins, exclusive valid spans, pixels to tiles, evenly spaced views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbraloom.functions.values import col

#: Tile size and overlap in pixels.
TILE, OVERLAP = 512, 64


def axis_offsets(size, tile: int = TILE, overlap: int = OVERLAP) -> Column:
    """Origins 0, stride, ... along an axis, the last pushed back to end at the edge; a short axis has one."""
    size, stride = col(size).cast("int"), tile - overlap
    last = F.greatest(size - tile, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def axis_spans(offsets: Column, size, tile: int = TILE) -> Column:
    """array<struct<idx, off, length, first, stop>>: an exact partition of the axis, cut in the middle of each overlap."""
    size = col(size).cast("int")
    n = F.size(offsets)
    end = lambda i: F.least(F.get(offsets, i) + tile, size)
    cut = lambda i: ((F.get(offsets, i + 1) + end(i)) / 2).cast("int")
    return F.transform(
        offsets,
        lambda o, i: F.struct(i.alias("idx"), o.alias("off"), (end(i) - o).alias("length"), F.when(i == 0, F.lit(0)).otherwise(cut(i - 1)).alias("first"), F.when(i == n - 1, size).otherwise(cut(i)).alias("stop")),
    )


def tile_plan(scenes: DataFrame, tile: int = TILE, overlap: int = OVERLAP) -> DataFrame:
    """A row for each tile of scenes (scene_id, width, height): origin, extent and exclusive valid span in both axes, rows first."""
    axis = lambda c: axis_spans(axis_offsets(c, tile, overlap), c, tile)
    rows = scenes.select("scene_id", F.explode(axis("height")).alias("r"), "width")
    both = rows.select("scene_id", "r", F.explode(axis("width")).alias("c"), F.size(axis_offsets("width", tile, overlap)).alias("_n"))
    return both.select("scene_id", (F.col("r.idx") * F.col("_n") + F.col("c.idx")).alias("tile_id"), F.col("r.off").alias("row_off"), F.col("c.off").alias("col_off"), F.col("r.length").alias("height"), F.col("c.length").alias("width"), F.col("r.first").alias("valid_row"), F.col("r.stop").alias("valid_row_stop"), F.col("c.first").alias("valid_col"), F.col("c.stop").alias("valid_col_stop"))


def local_valid(plan: DataFrame) -> DataFrame:
    """The valid span in a tile's own coordinates."""
    return plan.select("*", *((F.col(f"valid_{a}{s}") - F.col(f"{a}_off")).alias(f"local_{a}{s}") for a in ("row", "col") for s in ("", "_stop")))


def pixels_to_tiles(pixels: DataFrame, plan: DataFrame, stride: int = TILE - OVERLAP, exclusive: bool = True) -> DataFrame:
    """Each pixel with its tile, in whose valid span it lies; or with all tiles that hold it.

    Tiles are looked up by the coarse cells of the stride that they touch, so the join is on equal keys.
    """
    cell = lambda a, b: F.sequence((F.col(a) / stride).cast("int"), ((F.col(b) - 1) / stride).cast("int"))
    lo, hi = (("valid_row", "valid_row_stop"), ("valid_col", "valid_col_stop")) if exclusive else (("row_off", "_r1"), ("col_off", "_c1"))
    t = plan.withColumns({"_r1": F.col("row_off") + F.col("height"), "_c1": F.col("col_off") + F.col("width")})
    keyed = t.withColumn("_br", F.explode(cell(*lo))).withColumn("_bc", F.explode(cell(*hi))).select("scene_id", "tile_id", "_br", "_bc", *(F.col(c).alias(f"_{k}") for k, c in enumerate((*lo, *hi))))
    p = pixels.withColumns({"_br": (F.col("row") / stride).cast("int"), "_bc": (F.col("col") / stride).cast("int")})
    got = p.join(keyed, ["scene_id", "_br", "_bc"]).where("row >= _0 and row < _1 and col >= _2 and col < _3")
    return got.select(*pixels.columns, "tile_id")


def select_views(pairs: DataFrame, scene: str, key: str, n: int) -> DataFrame:
    """n rows of each scene in the order of key, evenly spaced from the first to the last (half-even rounding); all of a scene with fewer."""
    w = Window.partitionBy(scene)
    got = pairs.withColumns({"_k": F.row_number().over(w.orderBy(key)) - 1, "_n": F.count("*").over(w)})
    k = F.least(F.lit(n), F.col("_n").cast("int"))
    step = F.when(k > 1, (F.col("_n") - 1) / (k - 1)).otherwise(0.0)
    wanted = F.exists(F.sequence(F.lit(0), k - 1), lambda i: F.rint(i * step) == F.col("_k"))
    return got.where(wanted).drop("_k", "_n")
