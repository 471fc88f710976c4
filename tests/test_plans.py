"""Calibration and validation as whole plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbraloom.operators.predictor import predict
from umbraloom.plans import calibrate as C
from umbraloom.plans import validate as V


def buildings(spark, n=12, tile="t1", k=0.5, a=2.0, b=1.0):
    rows = []
    for i in range(n):
        length = 20.0 + 3 * i
        rows.append((tile, f"b{i:02d}", True, "NOMINAL", 300 + i, 0.9, True, 1.0, k * length, 0.1, 0.9, length, 1.0, (k * length - b) / a + 1e-4 * (-1) ** i))
    return spark.createDataFrame(rows, "tile_id string, building_id string, usable boolean, confidence string, area_px int, solidity double, isolated boolean, valid_fraction double, height_m double, rel_spread double, ground_share double, length_px double, spread_px double, r_bar double")


def test_calibration_recovers_the_line(spark):
    both = buildings(spark).unionAll(buildings(spark, 4, "t2")).unionAll(buildings(spark, 6, "t3").withColumn("isolated", F.lit(False)))
    got = {r["tile_id"]: r for r in C.calibrate(both).collect()}
    assert got["t1"]["status"] == "calibrated" and got["t1"]["a"] == pytest.approx(2, abs=1e-3) and got["t1"]["b"] == pytest.approx(1, abs=1e-3) and got["t1"]["label"] == "identifiable_positive"
    assert got["t2"]["status"] == "fit_failed" and "need at least" in got["t2"]["reason"]
    assert got["t3"]["status"] == "calibration_insufficient"
    assert [r["calibrated"] for r in C.sensitivity(both).orderBy("references").collect()] == [1, 1, 1]
    px = spark.createDataFrame([("t1", i % 2 == 0, float(np.log(1 + i)), 2.0 * (1 + i) + 1 + 0.5) for i in range(10)], "tile_id string, is_building boolean, z_rel double, height_m double")
    tiles = C.calibrate(both).withColumn("city", F.lit("c"))
    summary, errors = C.report(tiles, C.dense_errors(px, tiles))
    assert {r["region"]: round(r["bias"], 2) for r in errors.collect()} == {"building": -0.5, "ground": -0.5, "all": -0.5}
    assert {r["city"]: r["ok"] for r in summary.collect()} == {"c": 1, "combined": 1}


def test_validation_and_refusal(spark):
    px = spark.createDataFrame([(1.0, 2.0, 2, False, False, 30.0), (5.0, 4.0, 6, True, False, 30.0), (float("nan"), 1.0, 6, False, False, 30.0)], "p double, r double, cls int, shadow boolean, water boolean, sun_elevation double")
    pairs = spark.createDataFrame([("a", "s1", "train"), ("b", "s2", "validation")], "region string, scene_id string, side string")
    good = spark.createDataFrame([("a", "train"), ("b", "validation")], "region string, side string")
    m, x = V.validate(px, good, pairs)
    got = {r["group"]: r["n"] for r in m.collect()}
    assert got == {"overall": 2, "category:terrain": 1, "category:building": 1, "confidence:HIGH": 1, "confidence:REDUCED": 1}
    assert {r["reason"]: r["n"] for r in x.collect()} == {"valid": 2, "prediction_nonfinite": 1}
    with pytest.raises(V.Refused, match="heldout_region_trained_on"):
        V.validate(px, spark.createDataFrame([("a", "validation")], "region string, side string"), pairs)


def test_predictor_is_checked(spark):
    tiles = spark.createDataFrame([("s", 1, 2, 2, [float(i) for i in range(12)])], "scene_id string, tile_id long, height int, width int, rgb array<double>")
    assert predict(tiles, lambda x: x[0] * 0 + 3).first()["z"] == [3.0] * 4
    assert predict(tiles, None, True).first()["fallback"]
    with pytest.raises(ValueError):
        predict(tiles, None)
    with pytest.raises(Exception, match="not finite"):
        predict(tiles, lambda x: x[0] * float("nan")).collect()
