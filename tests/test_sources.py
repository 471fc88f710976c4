"""Formats by round trips, and a stream of metrics."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbraloom.sources import mesh, npy, png, rasters, records, sinks
from umbraloom.sources.geotiff import geotiff_bytes, parse_geotiff, validate
from umbraloom.streaming import metrics as S


@pytest.mark.parametrize("kind", ["<f4", ">f8", "|u1", "<i2", ">u4", "|b1"])
def test_npy(kind):
    a = (np.arange(12).reshape(3, 4) % 2).astype(kind)
    assert (npy.parse_npy(npy.npy_bytes(a)) == a).all()
    with pytest.raises(ValueError):
        npy.parse_npy(npy.npy_bytes(a)[:-1])


def test_npy_fortran():
    a = np.asfortranarray(np.arange(6.0).reshape(2, 3))
    head = b"{'descr': '<f8', 'fortran_order': True, 'shape': (2, 3), }"
    assert (npy.parse_npy(npy.MAGIC + b"\x01\x00" + struct.pack("<H", len(head)) + head + a.tobytes(order="F")) == a).all()


@pytest.mark.parametrize("n", [1, 3, 4])
def test_png(n):
    a = np.random.default_rng(n).integers(0, 256, (7, 5, n)).astype(np.uint8)
    assert (png.parse_png(png.png_bytes(a)) == a[:, :, : 3 if n == 4 else n]).all()


def test_png_filters():
    a = np.random.default_rng(0).integers(0, 256, (5, 6)).astype(np.int64)
    rows = b""
    for y in range(5):
        up = a[y - 1] if y else np.zeros(6, int)
        left, diag = np.r_[0, a[y, :-1]], np.r_[0, up[:-1]]
        p = left + up - diag
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - diag)), left, np.where(abs(p - up) <= abs(p - diag), up, diag))
        rows += bytes([y]) + ((a[y] - (0, left, up, (left + up) // 2, near)[y]) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (png.parse_png(data)[:, :, 0] == a).all()


@pytest.mark.parametrize("cog", [True, False])
def test_geotiff(cog):
    a = np.random.default_rng(1).random((300, 520)).astype("f4")
    a[3, 4] = np.nan
    t = (0.5, 0.0, 700000.0, 0.0, -0.5, 3170000.0)
    data = geotiff_bytes(a, t, 32643, {"SUN_ELEVATION_DEG": "45", "note": "a < b & c"}, float("nan"), cog)
    r = parse_geotiff(data)
    assert validate(data, a, t, 32643, float("nan"), cog) == []
    assert r.tags["note"] == "a < b & c" and not r.valid[3, 4] and r.valid.sum() == a.size - 1 and r.crs == "EPSG:32643"
    assert validate(data, a + 1, t, 32643, float("nan"), cog) == ["values differ"]


def test_glb():
    z = np.random.default_rng(2).random((6, 7))
    z[2, 2] = np.nan
    v, t = mesh.grid_mesh(z)
    got = mesh.parse_glb(mesh.glb_bytes(v, t, {"units": "m"}))
    assert (got[0] == v).all() and (got[1] == t).all() and got[2] == {"units": "m"} and len(t) == 2 * (30 - 4)


def test_files_as_tables(spark, tmp_path):
    cells = spark.range(300 * 280).select(F.lit("s").alias("scene"), (F.col("id") / 280).cast("int").alias("row"), (F.col("id") % 280).cast("int").alias("col"), F.when(F.col("id") != 5, F.col("id") * 0.5).alias("z"))
    t = (0.5, 0.0, 10.0, 0.0, -0.5, 20.0)
    assert sinks.save_files(sinks.raster_files(cells, ["scene"], "z", t, 32643, {"PRODUCT": "dsm"}), str(tmp_path)) == ["s-z.tif"]
    sinks.save_files(sinks.array_files(cells, ["scene"], "z"), str(tmp_path))
    h = rasters.read_headers(spark, str(tmp_path)).first()
    assert (h["width"], h["height"], h["crs"], h["tags"]["PRODUCT"], h["georeferenced"]) == (280, 300, "EPSG:32643", "dsm", True) and list(h["transform"]) == list(t)
    for kind in ("*.tif", "*.npy"):
        px = rasters.pixels(rasters.read_blocks(spark, str(tmp_path), kind))
        assert px.count() == 84000 and px.where("value is null").select("row", "col").collect() == [(0, 5)]
        assert px.join(cells, ["row", "col"]).where("abs(value - z) > 1e-3").count() == 0


def test_records(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"kind": "surveyed", "measurements": [{"building_id": "a", "reference_height_m": 3.5, "source": "tape"}]}))
    (tmp_path / "r.csv").write_text("building_id,reference_height_m,source,measured_by,measured_on,note\nb,4.5,lidar,,,\n")
    assert records.reference_set(spark, str(tmp_path / "r.json")).first()["kind"] == "surveyed"
    assert records.reference_set(spark, str(tmp_path / "r.csv"), "lidar").first()["reference_height_m"] == 4.5
    with pytest.raises(ValueError):
        records.reference_set(spark, str(tmp_path / "r.csv"))
    (tmp_path / "X.tif.IMD").write_text("meanSunEl = 40.0;\nmeanSunAz = 100;\n")
    assert records.sidecars(spark, str(tmp_path)).first()["stem"] == "X"
    reports = spark.createDataFrame([("out/a.json",), ("out/b.json",), ("./out//b.json",)], "path string")
    links = spark.createDataFrame([("s", "out/./a.json"), ("s", "out/b.json"), ("s", "none.json")], "source string, target string")
    got = {r["target"]: r for r in records.linked(reports, links).collect()}
    assert got["out/./a.json"]["path"] == "out/a.json" and got["out/b.json"]["reason"].startswith("more than one") and got["none.json"]["path"] is None
    assert json.loads(records.report_json({"a": float("nan"), "b": np.arange(2)})) == {"a": None, "b": [0, 1]}
    assert "[1] too few" in records.report_markdown("T", [{"n": 3, "mae": None, "reason": "too few"}])


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 3).cast("string").alias("c"), F.col("id").cast("double").alias("p"), (F.col("id") * 0.9).alias("r"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    S.append_sums(stream, ["c"], str(tmp_path / "sums"), str(tmp_path / "cp")).awaitTermination()
    got = {r["c"]: r for r in S.totals(spark, str(tmp_path / "sums"), ["c"]).collect()}
    want = df.groupBy("c").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("p") - F.col("r"))).alias("mae")).collect()
    assert all(got[r["c"]]["n"] == r["n"] and got[r["c"]]["mae"] == pytest.approx(r["mae"]) for r in want)


def test_plans_index_and_figures(spark, tmp_path):
    from umbraloom.operators.tiling import tile_plan
    from umbraloom.sources import plots

    plan = tile_plan(spark.createDataFrame([("s", 600, 700)], "scene_id string, height int, width int"))
    records.save_tile_plan(plan, str(tmp_path / "plan"))
    assert records.tile_plan(spark, str(tmp_path / "plan")).count() == plan.count() == 4
    (tmp_path / "out" / "a").mkdir(parents=True)
    for n in ("r.json", "a/x.npy", "a/y.txt"):
        (tmp_path / "out" / n).write_text("1")
    assert sorted(r["kind"] for r in records.output_index(spark, str(tmp_path / "out")).collect()) == ["array", "report"]
    assert plots.scatter_png(np.array([np.nan]), np.array([1.0])) is None
    assert png.parse_png(plots.scatter_png(np.array([1.0, 5.0]), np.array([2.0, 4.0]))).shape == (400, 400, 3)
    got = png.parse_png(plots.error_map_png(np.array([[0.0, 2.0], [-2.0, np.nan]])))
    assert got.tolist() == [[[255, 255, 255], [255, 0, 0]], [[0, 0, 255], [128, 128, 128]]]


def test_error_and_prediction_files(spark, tmp_path):
    from umbraloom.operators import predictor

    cells = spark.createDataFrame([("s", r, c, None if (r, c) == (1, 2) else float(r - c)) for r in range(5) for c in range(6)], "scene string, row int, col int, error double")
    for epsg in (None, 32643):
        f = sinks.error_files(cells, ["scene"], "error", (1.0, 0.0, 0.0, 0.0, -1.0, 9.0) if epsg else None, epsg, tags={"UNITS": "m"}).first()
        r = parse_geotiff(bytes(f["content"]))
        assert f["problems"] == [] and r.tags["UNITS"] == "m" and r.tags["CONTENT"].startswith("error") and r.nodata == -9999 and not r.valid[1, 2] and r.valid.sum() == 29 and r.bands[0][4, 1] == 3
    bad = sinks.error_files(cells.withColumn("error", F.lit(-9999.0)), ["scene"]).first()
    assert any("nodata" in p for p in bad["problems"])
    with pytest.raises(ValueError, match="needs a reason"):
        predictor.load_fallback("m", " ", lambda s: None)
    with pytest.raises(ValueError, match="cannot be had .OSError: gone"):
        predictor.load_fallback("m", "why", lambda s: (_ for _ in ()).throw(OSError("gone")))
    tiles = spark.createDataFrame([("s", 7, 2, 3, [float(v) for v in range(18)])], "scene_id string, tile_id long, height int, width int, rgb array<double>")
    model = predictor.load_fallback(str(tmp_path), "stalled", lambda s: lambda x: x[0])
    with pytest.raises(ValueError, match="not allowed"):
        predictor.predict(tiles, model)
    got = predictor.predict(tiles, model, allow_fallback=True)
    assert got.first()["reason"] == f"stalled (local:{tmp_path})" and got.first()["fallback"]
    with pytest.raises(Exception, match="refusing to export a surface: a fallback made tile 7"):
        predictor.refused_fallbacks(got, "export a surface").collect()
    assert predictor.refused_fallbacks(predictor.predict(tiles, lambda x: x[1]), "x").first()["fallback"] is False
    assert sinks.save_files(sinks.prediction_files(got), f"file://{tmp_path}/out") == ["s-7.json", "s-7.png", "s-7_relative_height.npy"]
    about = json.loads((tmp_path / "out" / "s-7.json").read_text())
    assert about["fallback"] and about["reason"].startswith("stalled") and about["units"].endswith("not metres") and (about["height"], about["width"]) == (2, 3)
    assert np.allclose(np.load(tmp_path / "out" / "s-7_relative_height.npy"), (np.arange(0, 18, 3).reshape(2, 3) / 255 - 0.485) / 0.229, atol=1e-6) and len(list((tmp_path / "out").iterdir())) == 3


def test_exported_meshes(spark):
    cells = spark.createDataFrame([(s, r, c, None if (r, c) == (2, 2) else float(r * c)) for s in ("a/b.tif", "x_dsm") for r in range(5) for c in range(6)] + [("line", 0, c, 1.0) for c in range(4)], "scene string, row int, col int, z double")
    got = {r["name"]: r for r in mesh.export_meshes(cells, ["scene"], "z", "dsm", "ABSOLUTE", now=lambda: 2.0).collect()}
    assert sorted(got) == ["b_dsm_ABSOLUTE.glb", "line_dsm_ABSOLUTE.glb", "x_dsm_ABSOLUTE.glb"]
    good = got["b_dsm_ABSOLUTE.glb"]
    assert good["problems"] == [] and (good["vertices"], good["triangles"], good["export_ms"]) == (29, 2 * (20 - 4), 0.0)
    assert mesh.parse_glb(bytes(good["content"]))[2]["product"] == "dsm" and mesh.inspected(bytes(good["content"])) == {"bytes": len(good["content"]), "primitives": 1, "compressed": 0, "uses": False}
    assert got["line_dsm_ABSOLUTE.glb"]["problems"] == ["no square of valid cells"]
    with pytest.raises(ValueError, match="no encoder is given"):
        mesh.export_meshes(cells, ["scene"], "z", "dsm", "ABSOLUTE", compressed=True)

    def packed(v, t, extras):
        data = mesh.glb_bytes(v, t, extras)
        n = struct.unpack_from("<I", data, 12)[0]
        doc = json.loads(data[20 : 20 + n])
        doc["extensionsUsed"] = ["KHR_draco_mesh_compression"]
        doc["meshes"][0]["primitives"][0]["extensions"] = {"KHR_draco_mesh_compression": {}}
        text = json.dumps(doc).encode()
        text += b" " * (-len(text) % 4)
        rest = data[20 + n :]
        return struct.pack("<4sII", b"glTF", 2, 20 + len(text) + len(rest)) + struct.pack("<I4s", len(text), b"JSON") + text + rest

    one = cells.where("scene = 'x_dsm'")
    assert mesh.export_meshes(one, ["scene"], "z", "dsm", "RELATIVE", compressed=True, encoder=packed).first()["problems"] == []
    assert mesh.export_meshes(one, ["scene"], "z", "dsm", "RELATIVE", compressed=True, encoder=mesh.glb_bytes).first()["problems"] == ["compression was asked for but the file is not compressed"]
    assert mesh.export_meshes(one, ["scene"], "z", "dsm", "RELATIVE", encoder=packed).first()["problems"] == ["the file is compressed, unasked"]
    for data in (b"", b"glTF" + bytes(30), bytes(good["content"])[:-4]):
        with pytest.raises(ValueError, match="GLB"):
            mesh.inspected(data)
