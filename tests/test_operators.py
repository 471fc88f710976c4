"""Operators against closed forms and brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from umbraloom.functions import geometry as G
from umbraloom.functions import metadata as M
from umbraloom.functions import values as V
from umbraloom.operators import azimuth, calibration, components, metrics, morphology, radiometry, rays, scenes, splits, surfaces, tiling
from umbraloom.plans.heights import shadow_heights


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_geometry(spark):
    r = one(spark, G.shadow_length_m(F.lit(10.0), F.lit(45.0)).alias("a"), G.shadow_length_m(F.lit(10.0), F.lit(90.0)).alias("b"), G.shadow_length_m(F.lit(10.0), F.lit(0.0)).alias("c"), G.shadow_azimuth_deg(F.lit(270.0)).alias("d"), G.angular_difference_deg(F.lit(350.0), F.lit(10.0)).alias("e"), G.shadow_length_m(F.lit(-1.0), F.lit(45.0)).alias("f"))
    assert r["a"] == pytest.approx(10) and r["b"] == 0 and r["c"] is None and r["d"] == 90 and r["e"] == 20 and r["f"] is None
    with pytest.raises(Exception, match="sun elevation must be"):
        one(spark, G.checked_elevation(F.lit(91.0)))
    assert G.angular_resolution_deg(8) == pytest.approx(3.58, abs=0.01)


def test_utm_round_trip(spark):
    r = one(spark, G.utm_inverse(F.lit(700000.0), F.lit(3170000.0), F.lit(43)).alias("p"))["p"]
    back = one(spark, G.utm_forward(F.lit(r["lon"]), F.lit(r["lat"]), F.lit(43)).alias("q"))["q"]
    assert back["easting"] == pytest.approx(700000, abs=1e-3) and back["northing"] == pytest.approx(3170000, abs=1e-3)


def test_affine(spark):
    t = F.struct(*(F.lit(v).alias(k) for k, v in dict(a=0.5, b=0.1, c=7.0, d=-0.2, e=-0.5, f=9.0).items()))
    p = G.pixel_to_map(t, F.lit(3.0), F.lit(4.0))
    r = one(spark, G.map_to_pixel(t, p["x"], p["y"]).alias("p"), G.map_to_pixel_index(t, F.lit(1e6), F.lit(0.0), F.lit(9), F.lit(9)).alias("o"))
    assert (r["p"]["col"], r["p"]["row"]) == (pytest.approx(3), pytest.approx(4)) and r["o"] is None


def test_metadata(spark):
    text = 'BEGIN_GROUP = IMAGE\n\tmeanSunEl = 51.2;\n\tsatId = "WV02";\n\tmeanSunAz = 160.5;\nEND_GROUP = IMAGE\n'
    tables = F.array(F.struct(F.lit("imd").alias("label"), M.parsed_imd(F.lit(text)).alias("table")))
    r = one(spark, M.resolved_sun(tables).alias("s"), M.parsed_imd(F.lit(text)).alias("m"), M.normalised_path(F.lit("a//b/./../c")).alias("p"))
    assert r["m"]["satId"] == "WV02" and r["s"]["elevation"]["value"] == 51.2 and r["s"]["azimuth"]["key"] == "meanSunAz" and r["p"] == "a/c"


def test_states_and_labels(spark):
    r = one(spark, V.confidence_state(F.lit(True)).alias("a"), V.confidence_state(F.lit(True), F.lit(False), F.lit(False), F.lit(30.0)).alias("b"), V.confidence_state(F.lit(False), F.lit(True)).alias("c"), V.height_group(F.lit(-3.0)).alias("d"), V.classify_fit(F.lit(2.0), F.lit(0.5)).alias("e"), V.classify_fit(F.lit(0.5), F.lit(0.5)).alias("f"))
    assert tuple(r) == ("NOT_ASSESSED", "HIGH", "INVALID", "0-5 m", "identifiable_positive", "statistically_weak")
    with pytest.raises(ValueError):
        V.category_of("c", (1, 2), (2,))


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("b", float("nan"), 1.0), ("b", None, 1.0)], "c string, p double, r double")
    got = {r["c"]: r for r in metrics.metrics(df, ["c"]).collect()}
    assert set(got) == {"a", "overall"} and got["a"]["mae"] == 0.5 and got["a"]["pearson"] is None
    with pytest.raises(Exception, match="not finite"):
        metrics.metrics(df, ["c"], strict=True).collect()
    assert metrics.merged_errors(metrics.error_sums(df, ["c"]), ["c"]).count() == 1


def test_flat_band_and_otsu(spark):
    df = spark.createDataFrame([("f", 5.0), ("f", 5.0), ("e", None), ("v", 1.0), ("v", 3.0)], "band string, value double")
    got = {r["band"]: r for r in radiometry.band_stretches(df, ["band"]).collect()}
    assert got["f"]["degenerate"] and got["e"]["degenerate"] and got["e"]["low"] == 0 and not got["v"]["degenerate"]
    two = spark.createDataFrame([("a", v) for v in [10] * 5 + [200] * 5], "band string, v int")
    assert radiometry.otsu(two, ["band"]).first()["threshold"] == 10


def test_tiles_partition_exactly(spark):
    s = spark.createDataFrame([("s", 900, 1200), ("t", 100, 600)], "scene_id string, height int, width int")
    plan = tiling.tile_plan(s, 512, 64)
    assert plan.where("scene_id = 's'").count() == 6
    px = s.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(37)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(41)))).select("scene_id", "row", "col")
    got = tiling.pixels_to_tiles(px, plan)
    assert got.count() == px.count() == got.select("scene_id", "row", "col").distinct().count()


def test_stencils_against_numpy(spark):
    rng = np.random.default_rng(3)
    z = rng.integers(0, 50, (9, 11)).astype(float)
    df = spark.createDataFrame([("g", r, c, float(z[r, c])) for r in range(9) for c in range(11)], "scene string, row int, col int, z double")

    def brute(a, k, f):
        return np.array([[f(a[max(0, r - k) : r + k + 1, max(0, c - k) : c + k + 1]) for c in range(a.shape[1])] for r in range(a.shape[0])])

    want = brute(brute(z, 2, np.min), 2, np.max)
    for r in morphology.opening(df, ["scene"], size=5).collect():
        assert r["z"] == want[r["row"], r["col"]]
    assert morphology.window_schedule(1.0, 20.0) == [3, 5, 9, 17, 21]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 12), st.sampled_from([4, 8]))
def test_components_against_flood(seed, h, w, n):
    m = np.random.default_rng(seed).random((h, w)) < 0.5
    got, want, k = components.label_grid(m, n), np.zeros((h, w), int), 0
    for r, c in np.argwhere(m):
        if not want[r, c]:
            k, stack = k + 1, [(r, c)]
            while stack:
                y, x = stack.pop()
                if 0 <= y < h and 0 <= x < w and m[y, x] and not want[y, x]:
                    want[y, x] = k
                    stack += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (n == 8 or abs(a) + abs(b) == 1)]
    assert (got == want).all()


def test_ray_stops_at_gap_and_skips(spark):
    marks = "ssskk.....s"  # s shadow, k skipped, . neither
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(marks, 1)] + [(2, i, "s") for i in range(1, 4)], "ray int, k int, m string")
    got = {r["ray"]: r for r in rays.walk(df, ["ray"], "k", F.col("m") == "s", F.col("m") == "k", F.col("k") < 20).collect()}
    assert (got[1]["last_hit"], got[1]["shadow_samples"], got[1]["terminated_by"]) == (3, 3, "gap")
    assert (got[2]["last_hit"], got[2]["terminated_by"]) == (3, "max_length")


def test_pipeline_needs_angles(spark):
    with pytest.raises(ValueError, match="sun_azimuth"):
        shadow_heights(None, None, 0.5, 45.0, None, 1, 1)


def test_wls_against_numpy(spark):
    rng = np.random.default_rng(1)
    x, w = rng.random(40) * 9, rng.random(40) + 0.1
    y = 2.5 * x - 4 + rng.normal(0, 0.2, 40)
    rows = [("a", *map(float, p)) for p in zip(x, y, w)] + [("b", 1.0, 2.0, 1.0)] * 6 + [("c", 1.0, 2.0, 1.0)] + [("d", float(i), 1.0, -1.0) for i in range(6)]
    got = {r["t"]: r for r in calibration.fit_labels(calibration.wls(spark.createDataFrame(rows, "t string, x double, y double, w double"), ["t"], least=5)).collect()}
    a = np.stack([x, np.ones(40)], 1) * np.sqrt(w)[:, None]
    sol, rss, _, sv = np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)
    assert got["a"]["a"] == pytest.approx(sol[0]) and got["a"]["b"] == pytest.approx(sol[1]) and got["a"]["chi2_red"] == pytest.approx(rss[0] / 38) and got["a"]["condition"] == pytest.approx(sv[0] / sv[1])
    assert got["b"]["reason"].startswith("degenerate") and got["c"]["label"] == "insufficient_constraints" and got["d"]["reason"].startswith("weights")


def test_consensus_finds_the_line():
    rng = np.random.default_rng(2)
    x = rng.random(60) * 10
    y = 1.5 * x + 2 + rng.normal(0, 0.05, 60)
    y[:18] += rng.random(18) * 40 + 5
    got = calibration.consensus(x, y, np.full(60, 0.1), np.ones(60), 0)
    assert got["a"] == pytest.approx(1.5, abs=0.05) and got["inliers"] >= 38
    assert "need at least" in calibration.consensus(x[:3], y[:3], np.ones(3), np.ones(3), 0)["reason"]


def test_azimuth_of_city(spark):
    b = scenes.city(spark)
    px = scenes.box_pixels(scenes.boxes_px(b, 0.5, 512, 512))
    shadow = scenes.render(spark, b).where("is_shadow")
    got = azimuth.estimate_azimuth(azimuth.azimuth_scores(px, shadow, 512, 512, step_deg=5), px).first()
    assert got["reason"] is None and abs(got["azimuth"] - 135) <= 3.58
    few = px.limit(10)
    assert azimuth.estimate_azimuth(azimuth.azimuth_scores(few, shadow, 512, 512, step_deg=45), few).first()["reason"].startswith("too few")


def test_box_outside_is_refused(spark):
    b = spark.createDataFrame([("s", "x", 250.0, 0.0, 20.0, 20.0, 5.0)], "scene_id string, building_id string, x_m double, y_m double, width_m double, depth_m double, height_m double")
    with pytest.raises(Exception, match="outside of the scene"):
        scenes.boxes_px(b, 0.5, 512, 512).collect()


def test_resampled_plane(spark):
    dem = spark.createDataFrame([("d", r, c, 3.0 + 2 * (c + 0.5) - (r + 0.5)) for r in range(6) for c in range(6)], "dem_id string, row int, col int, z double")
    t = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(0.0).alias("d"), F.lit(1.0).alias("e"), F.lit(0.0).alias("f"))
    grids = spark.range(1).select(F.lit("d").alias("dem_id"), t.alias("grid"))
    targets = spark.createDataFrame([("d", 0, 0, 2.3, 3.1), ("d", 0, 1, 0.1, 3.0)], "dem_id string, row int, col int, x double, y double")
    got = {r["col"]: r["terrain"] for r in surfaces.resample_terrain(targets, dem, grids).collect()}
    assert got[0] == pytest.approx(3 + 2 * 2.3 - 3.1) and got[1] is None


def test_splits(spark):
    im = spark.createDataFrame([("JAX_001_RGB", "a"), ("OMA_002_RGB", "b")], "stem string, path string")
    ht = spark.createDataFrame([("JAX_001_RGB", "c")], "stem string, path string")
    with pytest.raises(Exception, match="image without a height file"):
        splits.discover_pairs(im, ht, "^([A-Z]+_[0-9]+)_(RGB)").collect()
    rows = spark.createDataFrame([(f"c{i % 3}", f"s{i}") for i in range(30)] + [("lone", "s99")], "city string, scene string")
    a, b = (sorted(map(tuple, splits.per_group_validation(rows, "city", "scene", 0.2).collect())) for _ in range(2))
    assert a == b and sum(x[2] == "validation" for x in a) == 6 and ("lone", "s99", "train") in a
    crops = splits.train_crops(spark.createDataFrame([("s", 600, 700)], "scene_id string, height int, width int"), 512, 20, 1)
    assert crops.where("row_off > 88 or col_off > 188 or row_off < 0").count() == 0


def test_selection_audit(spark):
    audit = spark.createDataFrame([("a", 0, True)], "check string, n long, ok boolean")
    r = lambda *x: spark.createDataFrame([(v,) for v in x], "region string")
    assert splits.audit_selection(audit, r("a"), r("b"), "best").first()["ok"]
    assert not splits.audit_selection(audit, r("b"), r("b"), "best").first()["ok"]
    assert splits.audit_selection(audit, r("b"), r("b"), "final_epoch").first()["ok"]


def test_math_of_grid_dl(spark):
    assert one(spark, G.explicit_grid_dl_px(F.lit(135.0)).alias("x"))["x"] == pytest.approx(1 / math.sqrt(2))


def test_balanced_nodes(spark):
    from umbraloom.operators import lod

    cells = spark.range(64 * 64).select(F.lit("s").alias("scene"), (F.col("id") / 64).cast("int").alias("row"), (F.col("id") % 64).cast("int").alias("col"), F.col("id").cast("double").alias("z"))
    nodes = lod.quadtree_nodes(cells, ["scene"], "z", 3, 8)
    fine = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 0), *((3, 4 + i, 4 + j) for i in range(4) for j in range(4))], "level int, nr int, nc int")
    got = [tuple(r) for r in lod.balanced(fine, nodes, 3, 8).collect()]
    area = sum((64 >> r[0]) ** 2 for r in got)
    assert area == 64 * 64 and len(got) == len(set(got)) and (2, 1, 3) in got and (1, 0, 0) in got and (1, 0, 1) not in got


def test_small_lookups(spark):
    tables = F.array(F.struct(F.lit("rpc").alias("label"), F.create_map(*map(F.lit, ("LINE_OFF", "5", "SAMP_OFF", "6", "LAT_OFF", "7.5", "LONG_OFF", "8", "HEIGHT_OFF", "9"))).alias("table")))
    t = F.struct(*(F.lit(v).alias(k) for k, v in dict(a=0.5, b=0.0, c=699750.0, d=0.0, e=-0.5, f=3170250.0).items()))
    r = one(spark, M.rpc_offsets(tables).alias("r"), G.centre_lonlat(t, F.lit(1000), F.lit(1000), F.lit(43)).alias("c"), G.utm_inverse(F.lit(700000.0), F.lit(3170000.0), F.lit(43)).alias("w"))
    assert r["r"]["lat"] == 7.5 and r["c"] == r["w"]
    grid = lambda p, w: F.struct(F.lit("x").alias("path"), F.lit(p).alias("product_type"), F.lit(w).alias("width"), F.lit(5).alias("height"), F.array(F.lit(1.0)).alias("transform"))
    r = one(spark, V.overlay_reason(grid("dsm", 5), grid("error", 5)).alias("a"), V.overlay_reason(grid("dsm", 5), grid("error", 6)).alias("b"), V.overlay_reason(grid("dtm", 5), grid("error", 5)).alias("c"))
    assert tuple(r) == (None, "sizes differ", "the surface is not a DSM")
