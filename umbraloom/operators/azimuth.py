"""The sun's azimuth from where shadows lie around buildings."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the band in pixels, step in degrees, fewest building pixels, least ratio of peak to median.
BAND_PX, STEP_DEG, MIN_PX, MIN_PEAK = 8, 1, 200, 1.25


def azimuth_scores(buildings: DataFrame, shadow: DataFrame, height: int, width: int, band_px: int = BAND_PX, step_deg: int = STEP_DEG, by: str = "scene_id") -> DataFrame:
    """(scene_id, azimuth, score, band_n): the share of shadow in the band behind all buildings, for each candidate, and the pixels of that band; without any, score is 0.

    Many candidates shift a pixel to the same place, so places are found once for each distinct offset and only then dealt to
    candidates. The offsets, at most 17 x 17, are part of the plan; joins are on equal keys.
    """
    candidates = [float(a) for a in range(0, 360, step_deg)]
    by_offset: dict[tuple[int, int], set[float]] = {}
    for a in candidates:
        rad = math.radians((a + 180) % 360)
        for k in range(1, band_px + 1):
            by_offset.setdefault((round(-math.cos(rad) * k), round(math.sin(rad) * k)), set()).add(a)
    shifts = F.from_json(F.lit(json.dumps([{"dr": dr, "dc": dc, "azimuths": sorted(az)} for (dr, dc), az in sorted(by_offset.items())])), "array<struct<dr:int,dc:int,azimuths:array<double>>>")
    px = buildings.select(by, "row", "col").distinct()
    moved = px.withColumn("_s", F.explode(shifts)).select(by, (F.col("row") + F.col("_s.dr")).alias("row"), (F.col("col") + F.col("_s.dc")).alias("col"), "_s.azimuths")
    moved = moved.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).join(px, [by, "row", "col"], "left_anti")
    band = moved.withColumn("azimuth", F.explode("azimuths")).select(by, "azimuth", "row", "col").distinct()
    score = band.join(shadow.select(by, "row", "col", F.lit(1.0).alias("_s")).distinct(), [by, "row", "col"], "left").groupBy(by, "azimuth").agg(F.avg(F.coalesce("_s", F.lit(0.0))).alias("score"), F.count("*").alias("band_n"))
    every = px.select(by).distinct().withColumn("azimuth", F.explode(F.from_json(F.lit(json.dumps(candidates)), "array<double>")))
    return every.join(score, [by, "azimuth"], "left").fillna(0, ["score", "band_n"])


def estimate_azimuth(scores: DataFrame, building_px: DataFrame, by: str = "scene_id", min_px: int = MIN_PX, min_peak: float = MIN_PEAK) -> DataFrame:
    """(scene_id, azimuth, peak, ratio, reason): the circular mean of the plateau around the peak, or the reason why there is none."""
    n = building_px.groupBy(by).agg(F.count("*").alias("n_px"))
    top = scores.groupBy(by).agg(F.max("score").alias("peak"), F.percentile("score", 0.5).alias("median"))
    flat = scores.join(top, by).where(F.col("score") >= F.col("peak") * (1 - 1e-12)).groupBy(by).agg(F.avg(F.sin(F.radians("azimuth"))).alias("_y"), F.avg(F.cos(F.radians("azimuth"))).alias("_x"))
    ratio = F.when(F.col("median") > 0, F.col("peak") / F.col("median")).otherwise(F.lit(float("inf")))
    reason = F.when(F.col("n_px") < min_px, F.format_string(f"too few building pixels: %d, need at least {min_px}", "n_px")).when(F.col("peak") <= 0, "no shadow beside any building").when(F.col("ratio") < min_peak, "no clear peak")
    out = top.join(n, by).join(flat, by).withColumn("ratio", ratio).withColumn("reason", reason)
    return out.select(by, F.when(F.col("reason").isNull(), F.pmod(F.degrees(F.atan2("_y", "_x")), F.lit(360.0))).alias("azimuth"), "peak", "ratio", "reason")
