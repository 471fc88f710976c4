"""Synthetic city scenes: boxes, their shadows, terrain, all as generated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraloom.functions.geometry import shadow_pixel_offset

#: Reflectances of ground, roof and shadow; terrain base and slopes.
GROUND, ROOF, SHADOW = 0.35, 0.65, 0.08
BASE_M, SLOPE_EAST, SLOPE_NORTH = 540.0, 0.02, -0.015
#: The default city: name, x, y, width, depth, height in metres, on 512 x 512 pixels of 0.5 m under a sun at 45 and 135 degrees.
CITY = (("tower_a", 40.0, 40.0, 20.0, 20.0, 30.0), ("block_b", 140.0, 60.0, 30.0, 15.0, 12.0), ("slab_c", 60.0, 150.0, 15.0, 40.0, 45.0), ("low_d", 170.0, 170.0, 25.0, 25.0, 6.0))
SIDE, GSD, SUN_ELEVATION, SUN_AZIMUTH = 512, 0.5, 45.0, 135.0


def city(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("city", *b) for b in CITY], "scene_id string, building_id string, x_m double, y_m double, width_m double, depth_m double, height_m double")


def grid(spark: SparkSession, height: int, width: int, scene: str = "city") -> DataFrame:
    """All pixels of a scene, generated where they are used: spark.range is split over executors."""
    return spark.range(height * width).select(F.lit(scene).alias("scene_id"), (F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))


def boxes_px(buildings: DataFrame, gsd: float, height: int, width: int) -> DataFrame:
    """Pixel boxes (r0, r1, c0, c1), ends exclusive, by half-even rounding; an error for boxes outside of the scene."""
    px = lambda e: F.rint(e / gsd).cast("int")
    out = buildings.withColumns({"r0": px(F.col("y_m")), "r1": px(F.col("y_m") + F.col("depth_m")), "c0": px(F.col("x_m")), "c1": px(F.col("x_m") + F.col("width_m"))})
    bad = (F.col("r0") < 0) | (F.col("c0") < 0) | (F.col("r1") > height) | (F.col("c1") > width) | (F.col("r1") <= F.col("r0")) | (F.col("c1") <= F.col("c0"))
    return out.withColumn("r0", F.when(bad, F.raise_error(F.concat(F.lit("outside of the scene: "), F.col("building_id"))).cast("int")).otherwise(F.col("r0")))


def box_pixels(boxes: DataFrame) -> DataFrame:
    rows = boxes.withColumn("row", F.explode(F.sequence("r0", F.col("r1") - 1)))
    return rows.withColumn("col", F.explode(F.sequence("c0", F.col("c1") - 1))).select("scene_id", "building_id", "row", "col", "height_m")


def shifted(pixels: DataFrame, d_row, d_col, height: int, width: int) -> DataFrame:
    """The pixels moved by an offset; those that leave the scene are dropped."""
    out = pixels.withColumns({"row": (F.col("row") + d_row).cast("int"), "col": (F.col("col") + d_col).cast("int")})
    return out.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))


def swept_shadow(boxes: DataFrame, sun_elevation, sun_azimuth, gsd: float, height: int, width: int) -> DataFrame:
    """(scene_id, row, col) in the shadow of any box: the union of its rectangles moved step by step to the tip.

    Steps are half pixels; each row of a moved box is one interval, so pixels are generated from intervals and then made distinct.
    """
    off = shadow_pixel_offset(F.col("height_m"), sun_elevation, sun_azimuth, F.lit(gsd))
    at = boxes.withColumn("_o", off).withColumn("_n", F.greatest(F.lit(1), F.ceil(2 * F.greatest(F.abs(F.col("_o.d_row")), F.abs(F.col("_o.d_col")))).cast("int")))
    steps = at.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n")))).withColumns({"_dr": F.rint(F.col("_o.d_row") * F.col("_k") / F.col("_n")).cast("int"), "_dc": F.rint(F.col("_o.d_col") * F.col("_k") / F.col("_n")).cast("int")})
    moved = steps.select("scene_id", "building_id", *((F.col(c) + F.col(d)).alias(c) for c, d in (("r0", "_dr"), ("r1", "_dr"), ("c0", "_dc"), ("c1", "_dc")))).distinct()
    inside = moved.select("scene_id", *(F.greatest(F.lit(0), F.least(F.col(c), F.lit(m))).alias(c) for c, m in (("r0", height), ("r1", height), ("c0", width), ("c1", width)))).where("r1 > r0 and c1 > c0")
    rows = inside.withColumn("row", F.explode(F.sequence("r0", F.col("r1") - 1)))
    return rows.withColumn("col", F.explode(F.sequence("c0", F.col("c1") - 1))).select("scene_id", "row", "col").distinct()


def noise(sigma: float, seed: int) -> Column:
    """Normal noise by hashed uniforms: the same for a pixel on every run."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "scene_id", "row", "col"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return sigma * F.sqrt(-2 * F.log(u(1))) * F.cos(2 * 3.141592653589793 * u(2))


def render(spark: SparkSession, buildings: DataFrame, height: int = SIDE, width: int = SIDE, gsd: float = GSD, sun_elevation: float = SUN_ELEVATION, sun_azimuth: float = SUN_AZIMUTH, sigma: float = 0.0, seed: int = 0) -> DataFrame:
    """(scene_id, row, col, value, height_m, building_id, is_shadow): ground, then shadow, then roofs over both; value 0 to 255."""
    boxes = boxes_px(buildings, gsd, height, width)
    at = ["scene_id", "row", "col"]
    roof = box_pixels(boxes).groupBy(*at).agg(F.max("height_m").alias("height_m"), F.min("building_id").alias("building_id"))
    dark = swept_shadow(boxes, F.lit(sun_elevation), F.lit(sun_azimuth), gsd, height, width).withColumn("_s", F.lit(True))
    out = grid(spark, height, width).join(roof, at, "left").join(dark, at, "left")
    shadow = F.coalesce("_s", F.lit(False)) & F.col("height_m").isNull()
    base = F.when(F.col("height_m").isNotNull(), ROOF).when(shadow, SHADOW).otherwise(GROUND)
    v = base + noise(sigma, seed) if sigma else base
    return out.select(*at, F.rint(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))).cast("int").alias("value"), F.coalesce("height_m", F.lit(0.0)).alias("height_m"), "building_id", shadow.alias("is_shadow"))


def terrain(pixels: DataFrame, gsd: float = GSD) -> DataFrame:
    """The pixels with the tilted plane's elevation at their centres."""
    return pixels.withColumn("terrain", BASE_M + SLOPE_EAST * (F.col("col") + 0.5) * gsd - SLOPE_NORTH * (F.col("row") + 0.5) * gsd)
