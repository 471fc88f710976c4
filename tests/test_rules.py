"""Rules worked out by hand: crops, views, gates, consensus, hulls, registration."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from umbraloom.functions import metadata as M
from umbraloom.functions import values as V
from umbraloom.operators import calibration, components, rays, splits, surfaces, tiling
from umbraloom.sources import rasters, sinks


def test_crops_reach_the_edge(spark):
    s = spark.createDataFrame([("a", 600, 256), ("b", 100, 512), ("c", 257, 700)], "scene_id string, width int, height int")
    got = {}
    for r in splits.validation_crops(s, 256).collect():
        got.setdefault(r["scene_id"], []).append((r["row_off"], r["col_off"]))
    assert sorted(got["a"]) == [(0, 0), (0, 256), (0, 344)] and sorted(got["b"]) == [(0, 0), (256, 0)]
    assert sorted(got["c"]) == [(r, c) for r in (0, 256, 444) for c in (0, 1)]


def test_views_are_spread_to_the_last(spark):
    rows = [("s", i) for i in range(7)] + [("t", i) for i in range(2)] + [("u", i) for i in range(6)]
    df = spark.createDataFrame(rows, "scene string, k int")
    for n in (1, 2, 3, 4, 5):
        got = tiling.select_views(df, "scene", "k", n).collect()
        for scene, many in (("s", 7), ("t", 2), ("u", 6)):
            want = np.unique(np.linspace(0, many - 1, min(n, many)).round().astype(int)).tolist()
            assert sorted(r["k"] for r in got if r["scene"] == scene) == want


def test_references_once(spark):
    est = spark.createDataFrame([("a", 5.0), ("b", 6.0)], "building_id string, estimate double")
    ref = spark.createDataFrame([("a", 4.0, 2), ("a", 3.0, 1)], "building_id string, reference double, line int")
    assert {r["building_id"]: r["reference"] for r in calibration.evaluate(est, ref, order="line").collect()} == {"a": 3.0, "b": None}
    with pytest.raises(Exception, match="duplicate reference"):
        calibration.evaluate(est, ref).collect()


def test_edge_share_is_of_hits(spark):
    rows = [("x", True, 5.0, "image_edge"), ("x", True, 6.0, "gap"), ("x", False, None, "image_edge"), ("x", False, None, "image_edge"), ("y", False, None, "image_edge")]
    got = {r["b"]: r["edge_fraction"] for r in rays.measure(spark.createDataFrame(rows, "b string, hit boolean, length_px double, terminated_by string"), ["b"]).collect()}
    assert got == {"x": 0.5, "y": 0.0}


def test_consensus_rules():
    rng = np.random.default_rng(8)
    x = rng.random(30) * 10
    y = 2 * x + 1 + rng.normal(0, 0.02, 30)
    y[:12] += 30
    got = calibration.consensus(x, y, np.full(30, 0.05), np.ones(30), 1)
    keep = np.abs(y - 2 * x - 1) < 1
    a, b = np.polyfit(x[keep], y[keep], 1)
    assert (got["inliers"], got["outliers"]) == (18, 12) and got["a"] == pytest.approx(a) and got["b"] == pytest.approx(b)
    _, cov = np.polyfit(x[keep], y[keep], 1, cov=True)
    assert got["se_a"] == pytest.approx(cov[0, 0] ** 0.5) and got["se_b"] == pytest.approx(cov[1, 1] ** 0.5)
    assert "finite" in calibration.consensus(x, y, np.zeros(30), np.ones(30), 1)["reason"]
    assert calibration.consensus(np.ones(9), y[:9], np.ones(9), np.ones(9), 0)["reason"].startswith("degenerate")
    assert "at most" in calibration.consensus(x[:6], rng.random(6) * 1e6, np.full(6, 1e-6), np.ones(6), 0)["reason"]
    assert calibration.solve(np.array([1.0, 1 + 1e-9]), np.array([1.0, 2.0]), np.ones(2))["reason"].startswith("ill-conditioned")


@settings(max_examples=40, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=20))
def test_hull_against_half_planes(points):
    p = np.array(sorted(points), float)
    edge = np.concatenate([p + d for d in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))])
    inside = 0
    for r in range(7):
        for c in range(7):
            out = False
            for k in range(0, 3600, 5):  # a centre outside of the hull is beyond it in some direction
                d = np.array([np.cos(k * np.pi / 1800), np.sin(k * np.pi / 1800)])
                out |= (np.array([r, c]) @ d) > (edge @ d).max() + 1e-6
            inside += not out
    assert abs(components.hull_pixels(p[:, 0], p[:, 1]) - inside) <= (0 if len(points) < 3 else 1)


def test_footprints_are_assessed(spark):
    square = [("t", "a", r, c) for r in range(4) for c in range(4)]
    ell = [("t", "b", r, c) for r in range(10, 16) for c in range(6) if r == 15 or c == 0]
    f = spark.createDataFrame(square + ell, "tile_id string, building_id string, row int, col int")
    s = {r["building_id"]: r for r in components.solidity(f).collect()}
    assert s["a"]["solidity"] == 1.0 and s["b"]["area_px"] == 11 and s["b"]["solidity"] < 0.6
    more = f.unionAll(spark.createDataFrame([("t", "z", 5, 0)], f.schema))
    assert {r["building_id"]: r["isolated"] for r in components.isolation(f, more, 2).collect()} == {"a": False, "b": True}
    assert {r["isolated"] for r in components.isolation(f, more, 0).collect()} == {True}
    agl = spark.createDataFrame([("t", r, c, 5.0 + c) for r in range(3) for c in range(4)], "tile_id string, row int, col int, z double")
    shadows = spark.createDataFrame([("t", "a", True, "NOMINAL", 10.0, 1.0), ("t", "b", True, "NOMINAL", 8.0, None)], "tile_id string, building_id string, usable boolean, confidence string, length_px double, spread_px double")
    zone = spark.createDataFrame([("t", "a", 0.9)], "tile_id string, building_id string, ground_share double")
    got = {r["building_id"]: r for r in components.assessed(shadows, f, agl, f, 2, zone).withColumn("gate", calibration.reference_gate()).collect()}
    assert got["a"]["valid_fraction"] == 0.75 and got["a"]["height_m"] == 6.5 and got["a"]["rel_spread"] == 0.1 and got["a"]["isolated"] and got["a"]["gate"] == "small"


def test_registration_by_all_corners(spark):
    head = "struct<width:int,height:int,crs:string,transform:array<double>>"
    t = [0.5, 0.0, 10.0, 0.0, -0.5, 20.0]
    image = (100, 100, "EPSG:1", t)
    cases = [(image, image, None), (image, (100, 100, "EPSG:1", [0.501, *t[1:]]), "corners differ"), (image, (50, 50, "EPSG:1", [1.0, 0.0, 10.0, 0.0, -1.0, 20.0]), None), (image, (50, 50, "EPSG:1", [1.0, 0.0, 10.6, 0.0, -1.0, 20.0]), "corners differ"),
             (image, (100, 100, None, t), "only one has a CRS"), (image, (100, 100, "EPSG:2", t), "CRS differ"), (image, (100, 100, "EPSG:1", [0.5, 0.1, *t[2:]]), "rotations differ"),
             ((9, 9, None, t), (9, 9, None, t), None), ((9, 9, None, t), (9, 8, None, t), "sizes differ and there is no CRS"), ((9, 9, None, t), (9, 9, None, [0.6, *t[1:]]), "grids differ and there is no CRS")]
    df = spark.createDataFrame([(k, i, h) for k, (i, h, _) in enumerate(cases)], f"k int, image {head}, height {head}")
    assert [r["reason"] for r in rasters.registration(df).orderBy("k").collect()] == [c[2] for c in cases]


def test_surfaces_of_a_plane(spark):
    cells = [("s", r, c, 5 + 0.1 * r + (8.0 if 6 <= r < 10 and 6 <= c < 10 else 0.0)) for r in range(20) for c in range(20)]
    got = surfaces.derive_surfaces(spark.createDataFrame(cells, "scene string, row int, col int, z double"), ["scene"], 1.0, 6.0).collect()
    for r in got:
        house = 6 <= r["row"] < 10 and 6 <= r["col"] < 10
        assert r["non_ground"] == house and r["ndsm"] == pytest.approx(8.0 if house else 0.0, abs=1e-9)


def test_keys_and_refused_files(spark, tmp_path):
    assert M.checked_keys({"a": 1}, {"a": True, "b": False}, "fit") == {"a": 1}
    with pytest.raises(ValueError, match="unknown keys .'c'.; missing keys .'a'."):
        M.checked_keys({"c": 1}, {"a": True, "b": False}, "fit")
    bad = spark.createDataFrame([("x.tif", bytearray(b"1"), ["values differ"])], "name string, content binary, problems array<string>")
    with pytest.raises(Exception, match="values differ"):
        sinks.save_files(bad, str(tmp_path))
    regions = spark.createDataFrame([("a",), (None,)], "city string")
    with pytest.raises(Exception, match="no city"):
        splits.selected_regions(regions, ("a",)).collect()


def test_calibrations_are_refused(spark):
    for a, b, what in (("x", 1, "real numbers"), (None, 1, "real numbers"), (float("nan"), 1, "finite"), (1, float("inf"), "finite"), (0, 1, "positive scale"), (-2.0, 1, "positive scale")):
        with pytest.raises(ValueError, match=what):
            V.checked_calibration(a, b)
    ok = spark.range(1).select(*(c.alias(n) for n, c in zip("ab", V.checked_calibration(-2, 3, require_positive_scale=False), strict=True))).first()
    assert tuple(ok) == (-2.0, 3.0)
    rows = spark.createDataFrame([(1.0, 2.0), (0.5, -1.0)], "a double, b double")
    pick = lambda df, *k: df.select(*(c.alias(n) for n, c in zip("xy", V.checked_calibration(F.col("a"), F.col("b"), *k), strict=True))).collect()
    assert [tuple(r) for r in pick(rows)] == [(1.0, 2.0), (0.5, -1.0)]
    for bad, what in ((None, "finite"), (float("nan"), "finite"), (-1.0, "positive scale")):
        with pytest.raises(Exception, match=what):
            pick(spark.createDataFrame([(bad, 1.0)], "a double, b double"))


def test_missing_sun_angles_are_named(spark):
    kind = "path string, tables array<struct<label:string,table:map<string,string>>>"
    good = spark.createDataFrame([("a.tif", [("gdal:default", {"SUN_ELEVATION": "40", "SUN_AZIMUTH": "100"})])], kind)
    got = good.select(M.required_sun(F.col("tables"), "path").alias("s")).first()["s"]
    assert (got["elevation"]["value"], got["azimuth"]["value"]) == (40.0, 100.0)
    for table, what in (({"SUN_ELEVATION": "40"}, "missing: sun_azimuth_deg in b.tif; probed: gdal:default"), ({"SUN_AZIMUTH": "x"}, "missing: sun_elevation_deg, sun_azimuth_deg in b.tif")):
        with pytest.raises(Exception, match=what):
            spark.createDataFrame([("b.tif", [("gdal:default", table)])], kind).select(M.required_sun(F.col("tables"), "path").alias("s")).collect()
    with pytest.raises(Exception, match="probed: nothing"):
        spark.createDataFrame([("c.tif", [])], kind).select(M.required_sun(F.col("tables"), "path").alias("s")).collect()
