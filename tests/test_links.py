"""Keys, checkpoints, linked rasters and products, stitched meshes, funnels: small cases worked out by hand."""

import collections
import io
import os
import pickle
import zipfile

import pytest
from pyspark.sql import functions as F

from umbraloom.functions import metadata as M
from umbraloom.functions import values as V
from umbraloom.operators import distributions, links, lod, metrics
from umbraloom.sources import checkpoints

GRID = dict(a=0.5, b=0.0, c=100.0, d=0.0, e=-0.5, f=200.0)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def raster(**given):
    return dict(path="s", product_type="dsm", mode="ABSOLUTE", units="m", crs="x", width=8, height=8, grid=GRID) | given


def test_keys(spark):
    t = "map<string,string>"
    df = spark.createDataFrame([({"a": "1", "z": "2", "y": "3"},), ({},), (None,), ({"a": "1", "b": "2"},)], f"m {t}")
    got = [(r.p.unknown, r.p.missing) for r in df.select(M.key_problems("m", ["a", "b"], ["a"]).alias("p")).collect()]
    assert got == [(["y", "z"], []), ([], ["a"]), ([], ["a"]), ([], [])]


def test_tags_by_table_then_alias_then_entry(spark):
    tables = "array(struct('one' AS label, map('SUN_ELEV', 'n/a', 'SUNEL', '31', 'sun-elevation', '30', 'Sun Azimuth', '5') AS table), struct('two' AS label, map('SUN_ELEVATION_DEG', '60', 'SUN_AZIMUTH_DEG', '7') AS table))"
    s = one(spark, M.resolved_sun(F.expr(tables)).alias("s")).s
    assert (s.elevation.value, s.elevation.key, s.elevation.source, s.elevation.conversion) == (30.0, "sun-elevation", "one", None)
    assert (s.azimuth.value, s.azimuth.raw_value) == (5.0, "5")
    assert one(spark, M.resolved_sun(F.expr("array(struct('one' AS label, map('SUNEL', '3') AS table))")).alias("s")).s is None


class Torn:
    def __reduce__(self):
        return os.getcwd, ()


def archive(payload):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("model/data.pkl", pickle.dumps(payload))
    return out.getvalue()


def test_checkpoints_are_read_but_never_run(spark, tmp_path):
    good = {"model_state": collections.OrderedDict(w=1), "config": {"model": {"encoder": "e"}, "training": {"epochs": 5}}, "model_description": {"encoder": "e", "weights_source": "random_init"}, "epoch": 4, "best_epoch": 2, "includes_encoder": True}
    files = {
        "good": archive(good), "bare": pickle.dumps(good), "early": archive(good | {"epoch": 2}), "other": archive(good | {"model_description": {"encoder": "f"}}), "random": archive(good | {"includes_encoder": False}),
        "parts": archive({k: v for k, v in good.items() if k != "model_state"}), "noconfig": archive({"epoch": 1}), "torn": archive(good | {"x": Torn()}), "short": b"PK",
    }
    for name, data in files.items():
        (tmp_path / f"{name}.pt").write_bytes(data)
    got = {r.path.rpartition("/")[2][:-3]: r for r in checkpoints.read_checkpoints(spark, str(tmp_path)).collect()}
    assert set(got) == set(files)
    assert got["good"].reason is None and got["good"].final_epoch and (got["good"].epoch, got["good"].epochs, got["good"].encoder) == (4, 5, "e")
    assert got["bare"].reason is None and got["early"].final_epoch is False and got["short"].final_epoch is None
    for name, said in (("other", "its config says e"), ("random", "did not save"), ("parts", "no model_state"), ("noconfig", "embeds no config"), ("torn", "not allowed"), ("short", "not readable")):
        assert said in got[name].reason


def test_shapes_stand_for_tensors():
    assert checkpoints._shape(None, 0, (3, 4), (4, 1)) == (3, 4) and checkpoints._shape(checkpoints.Shape((2,)), True) == (2,)


def test_alignment(spark):
    cases = [(raster(), None, ["no 2D raster"]), (raster(), raster(width=9, crs="y"), []), (raster(grid=None, crs=None), raster(path="t", grid=None, crs=None), []), (raster(), raster(path="t", grid=GRID | {"c": 100.1}, crs=None, height=2), ["sizes differ", "transforms differ", "CRS differ"]), (raster(), raster(path="t", grid=None), ["no transform on the image"])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, a {links.RASTER}, b {links.RASTER}")
    got = {r.i: r.l for r in df.select("i", links.link_alignment(F.col("a"), F.col("b")).alias("l")).collect()}
    assert [(got[i].aligned, got[i].reasons) for i in range(len(cases))] == [(not w, w) for _, _, w in cases]


def test_points_on_two_rasters(spark):
    plain = raster(path="p", grid=None, crs=None, mode="RELATIVE", units=None)
    cases = [(0, 1.2, 0.6, raster(), raster()), (1, 1.2, 0.6, raster(), raster(path="m", grid=GRID | {"a": 1.0, "e": -1.0}, width=4, height=4)), (2, 99.0, 0.0, raster(), raster()), (3, 0.0, 0.0, raster(), plain), (4, 2.5, 3.5, plain, plain), (5, 3.2, 3.2, raster(), raster())]
    df = spark.createDataFrame([(i, x, z, 0.0 if i == 4 else 100.0, 0.0 if i == 4 else 200.0, s, m) for i, x, z, s, m in cases], f"point_id int, x double, z double, origin_x double, origin_y double, shown {links.RASTER}, measured {links.RASTER}")
    pixels = spark.createDataFrame([("s", 1, 2, 7.0), ("m", 0, 1, 9.0), ("p", 3, 2, 4.0), ("s", 6, 6, float("inf"))], "path string, row int, col int, value double")
    got = {r.point_id: r for r in links.measured_at(df, pixels).collect()}
    assert (got[0].value, got[0].displayed, got[0].units, got[0].map_x) == (7.0, None, "metres", 101.2)
    assert (got[1].value, got[1].displayed, got[1].row, got[1].col) == (9.0, 7.0, 0, 1)
    assert got[2].reason == "outside the raster" and got[3].reason.startswith("the measured raster has no georeferencing")
    assert (got[4].value, got[4].units, got[4].map_x) == (4.0, "unitless (relative)", None) and got[5].reason.startswith("non-finite")


def test_products_are_asked_for_by_name(spark):
    s = spark.createDataFrame([("a/r.json", "x"), ("a/r.json", "y"), ("b", "y"), ("b", "y")], "report string, product string")
    got = {(r.report, r.product): r.reason for r in links.product_problems(s, [("a//r.json", "x"), ("b", "y"), ("b", "z")]).collect()}
    assert got == {("a//r.json", "x"): None, ("b", "y"): "several such products", ("b", "z"): "no such product"}


def test_stitched_tiles_have_no_cracks(spark):
    cells = spark.createDataFrame([("s", r, c, 1.0) for r in range(17) for c in range(17)], "scene string, row int, col int, z double")
    tiles = [("s", 0, 0, 0, 8, 8, 1, 0, 2, 0, 2), ("s", 1, 0, 8, 8, 16, 2, 0, 4, 1, 0), ("s", 2, 8, 0, 16, 8, 2, 1, 0, 0, 4), ("s", 3, 8, 8, 16, 16, 4, 2, 0, 2, 0)]
    boxes = spark.createDataFrame(tiles, "scene string, node_id int, r0 int, c0 int, r1 int, c1 int, stride int, top int, bottom int, left int, right int")
    got = [[(v.row, v.col) for v in (t.p, t.q, t.s)] for t in lod.stitched_triangles(boxes, cells, ["scene"]).collect()]
    area = [((q[0] - p[0]) * (s[1] - p[1]) - (q[1] - p[1]) * (s[0] - p[0])) / 2 for p, q, s in got]
    assert min(area) >= 0 and sum(area) == 256  # one orientation, the whole square, nothing twice
    edges = collections.Counter((t[i], t[(i + 1) % 3]) for t in got for i in range(3))
    outer = lambda a, b: any(a[k] == b[k] and a[k] in (0, 16) for k in (0, 1))
    assert all(edges[b, a] == n for (a, b), n in edges.items() if not outer(a, b))


def test_exact_triangles_spare_the_fourth_corner(spark):
    cells = spark.createDataFrame([("s", r, c, None if (r, c) == (0, 0) else 1.0) for r in range(3) for c in range(3)], "scene string, row int, col int, z double")
    box = "scene string, node_id int, r0 int, c0 int, r1 int, c1 int, stride int, top int, bottom int, left int, right int"
    for stride, want in ((1, 7), (2, 0)):
        assert lod.stitched_triangles(spark.createDataFrame([("s", 0, 0, 0, 2, 2, stride, 0, 0, 0, 0)], box), cells, ["scene"]).count() == want
    assert lod.stitched_triangles(spark.createDataFrame([("s", 0, 0, 0, 0, 2, 1, 0, 0, 0, 0)], box), cells, ["scene"]).count() == 0


def test_funnel_and_counts(spark):
    t = spark.createDataFrame([("a", "i", "s", "calibrated", 2, True, 3, "identifiable_positive"), ("a", "j", "s", "fit_failed", 0, None, None, None), (None, "k", "t", "no_sun", 1, False, 1, None)], "city string, image string, scene_id string, status string, surviving int, azimuth_ok boolean, eligible int, fit_class string")
    got = {r.city: r for r in distributions.funnel(t, "city").collect()}
    assert set(got) == {"a", None, "combined"}
    c = got["combined"]
    assert (c.tiles, c.images, c.scenes, c.with_buildings, c.azimuth_recovered, c.reached_selection, c.with_references, c.sun_calibrated, c.fit_returned, c.fit_identifiable, c.calibrated_images) == (3, 3, 2, 2, 1, 2, 1, 2, 1, 1, 1)
    n = spark.createDataFrame([("a", {"x": 1, "y": 2}), ("b", {"x": 4}), ("b", {}), ("b", None)], "city string, m map<string,long>")
    assert {(r.city, r.reason): r.n for r in distributions.merged_counts(n, "city", "m").collect()} == {("a", "x"): 1, ("a", "y"): 2, ("b", "x"): 4, ("combined", "x"): 5, ("combined", "y"): 2}
    assert [r.n for r in spark.createDataFrame([(0,), (1,), (9,), (33,)], "t int").select(distributions.expected_steps("t", 4, 2).alias("n")).collect()] == [0, 1, 2, 5]


def test_height_groups_of_odd_heights(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 4.9, 5.0, 20.0, None, float("nan"), float("inf"))], "h double")
    assert [r.g for r in df.select(V.height_group("h").alias("g")).collect()] == ["0-5 m", "0-5 m", "0-5 m", "5-10 m", ">=20 m", *["no buildings"] * 3]
    t = spark.createDataFrame([("0-5 m", "a"), ("0-5 m", "a"), ("0-5 m", "b")], "height_group string, status string")
    got = {r.height_group: (r.tiles, r.status) for r in distributions.height_group_table(t, ["0-5 m", "5-10 m"]).collect()}
    assert got == {"0-5 m": (3, {"a": 2, "b": 1}), "5-10 m": (0, {})}


def test_census_counts_a_scene_once(spark):
    pairs = spark.createDataFrame([("X", "s1", "v2"), ("X", "s1", "v1"), ("X", "s2", "v3"), ("Y", "s3", "v4")], "city string, scene_id string, stem string")
    rows = [("v1", 1, 5.0), ("v1", 1, 7.0), ("v1", 1, None), ("v1", 2, 99.0), ("v2", 1, 50.0), ("v3", 1, float("nan")), ("v3", 1, None), ("v3", 1, None)]
    got = {r.city: r for r in distributions.city_census(pairs, spark.createDataFrame(rows, "stem string, building_id int, height_m double"), 3).collect()}
    x, y = got["X"], got["Y"]
    assert (x.scenes, x.components, x.small, x.pixels, x.small_pixels, x.heights, x.p50) == (2, 3, 1, 7, 1, 1, 6.0)
    assert (y.scenes, y.components, y.pixels, y.p50) == (1, 0, 0, None)


def test_gap_is_over_common_tiles(spark):
    s = "region string, tile int, n long, sum_abs double, sum_sq double, sum_err double"
    a = spark.createDataFrame([("b", 1, 2, 4.0, 8.0, 0.0), ("b", 2, 1, 100.0, 1e4, 0.0), ("g", 1, 1, 3.0, 9.0, 3.0)], s)
    b = spark.createDataFrame([("b", 1, 2, 2.0, 2.0, 0.0), ("b", 3, 1, 50.0, 1.0, 0.0)], s)
    got = {r.region: r for r in metrics.paired_gap(a, b, ["region"], "tile").collect()}
    assert (got["b"].tiles, got["b"].mae_gap, got["b"].rmse_gap) == (1, 1.0, 1.0) and got["g"].mae_gap is None


def test_layers_lie_over_the_validated_surface_only(spark):
    s, e = raster(), raster(path="e", product_type="error")
    cases = [("error", s, e, "d/x", "d//x", "dsm", None), ("error", raster(product_type="dtm"), e, None, None, None, "source DSM"), ("error", s, None, None, None, None, "no error raster"), ("error", s, s, None, None, None, "no error product"), ("error", s, e, None, None, "dtm", "another product"), ("error", s, e, "d/y", "d/x", None, "another DSM"), ("confidence", s, e | {"product_type": "confidence", "crs": None}, None, "d/x", "dtm", "CRS differ")]
    for kind, a, b, said, validated, product, want in cases:
        df = spark.createDataFrame([(a, b, said, validated, product)], f"a {links.RASTER}, b {links.RASTER}, said string, validated string, product string")
        got = df.select(links.diagnostic_eligibility(kind, F.col("a"), F.col("b"), F.col("said"), F.col("validated"), F.col("product")).alias("g")).first().g
        assert got.available == (want is None) and (want or "") in (got.reason or "")


def test_tag_tables_in_order(spark):
    d = "array(struct('A' AS name, map('k', '1') AS table), struct('A' AS name, map('k', '2') AS table), struct('B' AS name, map() AS table))"
    t = one(spark, M.candidate_tables(F.expr("map('x', 'y')"), F.expr(d).cast("array<struct<name:string,table:map<string,string>>>")).alias("t"), M.candidate_tables(F.lit(None).cast("map<string,string>")).alias("n"))
    assert [(x.label, x.table) for x in t.t] == [("gdal:default", {"x": "y"}), ("gdal:A", {"k": "1"})] and t.n == []
