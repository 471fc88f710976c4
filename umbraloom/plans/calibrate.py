"""Calibration of tiles: references give a scale, shadows give heights, heights fit the relative field, the fit is scored.

All steps are keyed by tile, so one partitioning by tile serves references, scale, constraints and fit; the report is a
reduction over tile rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraloom.functions.values import calibrated_agl, height_group
from umbraloom.operators import calibration, distributions, metrics

ESTIMATORS = ("k_median", "k_mean", "k_weighted")


def calibrate(candidates: DataFrame, estimator: str = "k_median", references: int = calibration.REFERENCES, explicit_dl: float | None = None) -> DataFrame:
    """A row for each tile: status, scale, fit with its label, and the reason where there is none.

    candidates: a row for each building with tile_id, building_id, gate inputs, height_m (known height), length_px, spread_px,
    confidence and r_bar (mean of the relative field over its footprint).
    """
    if estimator not in ESTIMATORS:
        raise ValueError(f"estimator must be one of {ESTIMATORS}")
    ranked = calibration.ranked_references(candidates.withColumn("gate", calibration.reference_gate()), ["tile_id"], k=references)
    ref = ranked.where("is_reference")
    scale = calibration.scale_estimates(ref, ["tile_id"], "height_m", "length_px", "rel_spread").select("tile_id", F.col("n").alias("n_references"), F.col(estimator).alias("k"))
    enough = ranked.join(scale.where(F.col("n_references") >= calibration.MIN_REFERENCES), "tile_id")
    points = calibration.height_constraints(enough, F.col("k"), ref, ["tile_id", "building_id"], explicit_dl=explicit_dl).where("usable")
    fits = calibration.fit_labels(calibration.wls(points.select("tile_id", F.col("r_bar").alias("x"), F.col("h").alias("y"), F.col("weight").alias("w")), ["tile_id"], least=calibration.MIN_CONSTRAINTS))
    tiles = candidates.groupBy("tile_id").agg(F.max("height_m").alias("max_height_m"), F.count("*").alias("n_buildings"))
    out = tiles.join(scale, "tile_id", "left").join(fits.withColumnRenamed("n", "n_constraints"), "tile_id", "left")
    few = F.coalesce("n_references", F.lit(0)) < calibration.MIN_REFERENCES
    status = F.when(few, "calibration_insufficient").when(F.col("a").isNull(), "fit_failed").otherwise("calibrated")
    reason = F.when(few, F.format_string(f"%d references, need at least {calibration.MIN_REFERENCES}", F.coalesce("n_references", F.lit(0)))).when(F.col("a").isNull(), F.coalesce("reason", F.lit("no constraints")))
    return out.withColumns({"status": status, "reason": reason, "height_group": height_group("max_height_m")})


def dense_errors(pixels: DataFrame, fits: DataFrame) -> DataFrame:
    """(tile_id, region, n, sum_abs, sum_sq, sum_err) of calibrated heights: building and ground pixels; add them up for all."""
    ok = fits.where("status = 'calibrated'").select("tile_id", "a", "b")
    agl = calibrated_agl(F.col("z_rel"), F.col("a"), F.col("b"))
    got = pixels.join(ok, "tile_id").select("tile_id", F.when(F.col("is_building"), "building").otherwise("ground").alias("region"), agl.alias("p"), F.col("height_m").alias("r"))
    return metrics.error_sums(got, ["tile_id", "region"])


def report(tiles: DataFrame, sums: DataFrame, city: str = "city") -> tuple[DataFrame, DataFrame]:
    """(summary by city and together, errors by region and for all)."""
    summary = distributions.grouped_summary(tiles.withColumn("_ok", F.when(F.col("status") == "calibrated", "ok").otherwise("failed")), city, "tile_id", "_ok", "max_height_m")
    by = metrics.merged_errors(sums, ["region"], "tile_id").unionAll(metrics.merged_errors(sums.withColumn("region", F.lit("all")), ["region"], "tile_id"))
    return summary, by


def sensitivity(candidates: DataFrame, counts: tuple[int, ...] = (2, 3, 5)) -> DataFrame:
    """(references, calibrated, median_a): how the fit moves with the number of references."""
    out = None
    for n in counts:
        row = calibrate(candidates, references=n).agg(F.lit(n).alias("references"), F.count(F.when(F.col("status") == "calibrated", 1)).alias("calibrated"), F.percentile("a", 0.5).alias("median_a"))
        out = row if out is None else out.unionAll(row)
    return out
