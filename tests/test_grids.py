"""Warps, windows of pairs and epochs, against plain numpy."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from umbraloom.operators import epochs, warp
from umbraloom.sources import pair_windows
from umbraloom.sources.geotiff import geotiff_bytes
from umbraloom.sources.tiff_ranges import Memory, Tiff

# warps ------------------------------------------------------------------------------------------------------------------


def plainly(z, r, c, kernel):
    """One place at a time."""
    h, w = z.shape
    if not (0 <= r < h and 0 <= c < w):
        return math.nan
    if kernel == "nearest":
        return z[int(r), int(c)]
    f = {"bilinear": lambda d: max(0.0, 1 - abs(d)), "cubic": lambda d: 1.5 * abs(d) ** 3 - 2.5 * d * d + 1 if abs(d) <= 1 else -0.5 * abs(d) ** 3 + 2.5 * d * d - 4 * abs(d) + 2 if abs(d) < 2 else 0.0}[kernel]
    total = value = 0.0
    for i, j in itertools.product(range(max(0, int(r) - 3), min(h, int(r) + 4)), range(max(0, int(c) - 3), min(w, int(c) + 4))):
        k = f(r - 0.5 - i) * f(c - 0.5 - j)
        if k:
            value, total = value + k * z[i, j], total + k
    return value / total


@pytest.mark.parametrize("kernel", ["nearest", "bilinear", "cubic"])
def test_warp_against_single_places(spark, kernel):
    rng = np.random.default_rng(6)
    z = rng.random((23, 31)) * 10
    z[5, 7] = z[18, 30] = np.nan
    places = [(k, 0, float(r), float(c)) for k, (r, c) in enumerate([(0.0, 0.0), (0.2, 30.9), (22.99, 30.99), (-0.01, 3.0), (23.0, 3.0), (5.5, 7.5), (4.5, 7.5), (12.0, 16.0), (7.5, 8.5), *zip(rng.uniform(-2, 25, 300), rng.uniform(-2, 33, 300), strict=True)])]
    targets = spark.createDataFrame([*places, (999, 0, None, 1.0)], "row int, col int, src_r double, src_c double")
    source = spark.createDataFrame([(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)], "row int, col int, z double")
    for block in (4, 16, 256):
        got = {r["row"]: r["value"] for r in warp.warp(targets, source, z.shape, kernel, block).collect()}
        assert len(got) == len(places) + 1 and got[999] is None
        for k, _, r, c in places:
            want = plainly(z, r, c, kernel)
            assert (got[k] is None and np.isnan(want)) or abs(got[k] - want) < 1e-9, (k, r, c)
    assert warp.warp(targets.limit(0), source, z.shape, kernel).count() == 0
    assert warp.warp(targets, source.limit(0), z.shape, kernel).where("value is not null").count() == 0


def test_a_place_goes_there_and_back(spark):
    grid = spark.range(100).select(F.expr("cast(id div 10 as int)").alias("row"), (F.col("id") % 10).cast("int").alias("col"))
    a = (30.0, 0.0, 250000.0, 0.0, -30.0, 3000000.0)
    for crs, limit in (("EPSG:32644", 1e-9), ("EPSG:32643", 0.02), ("EPSG:4326", 0.02)):
        there = grid.select("row", "col", (250000 + 30 * (F.col("col") + 0.5)).alias("x"), (3000000 - 30 * (F.col("row") + 0.5)).alias("y"))
        back = warp.reprojected(warp.reprojected(there, "x", "y", "EPSG:32644", crs), "x", "y", crs, "EPSG:32644")
        for r in back.collect():
            assert abs(r["x"] - (a[2] + 30 * (r["col"] + 0.5))) < limit and abs(r["y"] - (a[5] - 30 * (r["row"] + 0.5))) < limit
    south = spark.createDataFrame([(30.0, -1.0)], "x double, y double")
    en = warp.reprojected(south, "x", "y", "EPSG:4326", "EPSG:32735").first()
    assert 9_880_000 < en["y"] < 9_900_000
    with pytest.raises(ValueError, match="neither"):
        warp.reprojected(south, "x", "y", "EPSG:4326", "EPSG:3857")


# pairs ------------------------------------------------------------------------------------------------------------------


def test_windows_of_pairs(spark, tmp_path):
    rng = np.random.default_rng(3)
    image, height = rng.integers(0, 200, (60, 80)).astype("u1"), rng.random((30, 20)).astype("f4") * 50
    height[4, 5], height[6, 7] = np.nan, -9
    (tmp_path / "i.tif").write_bytes(geotiff_bytes(image))
    (tmp_path / "h.tif").write_bytes(geotiff_bytes(height, nodata=-8.0))
    windows = [(0, 0), (-5, -3), (50, 70), (7, 20), (200, 0), (59, 79)]
    ask = spark.createDataFrame([("s", f"{tmp_path}/i.tif", f"{tmp_path}/h.tif", r, c) for r, c in windows], "stem string, image_path string, height_path string, row_off int, col_off int")
    got = {(t["row_off"], t["col_off"]): t for t in pair_windows.pair_tiles(ask, 16, nodata=-9.0, max_height=45.0).collect()}
    assert len(got) == 6 and pair_windows.pair_tiles(ask.limit(0), 16).count() == 0
    for (r0, c0), t in got.items():
        z, px, ok = (np.array(t[k]).reshape(*s) for k, s in (("height_m", (16, 16)), ("image", (3, 16, 16)), ("valid", (16, 16))))
        assert t["resampled"]
        for i, j in itertools.product(range(16), range(16)):
            r, c = r0 + i, c0 + j
            inside = 0 <= r < 60 and 0 <= c < 80
            assert (px[:, i, j] == (image[r, c] if inside else 0)).all()
            h = height[math.floor((r + 0.5) * 0.5), math.floor((c + 0.5) * 0.25)] if inside else np.nan
            good = bool(np.isfinite(h) and h != -9 and h <= 45)
            assert ok[i, j] == good and z[i, j] == pytest.approx(h if good else 0)
    with pytest.raises(Exception, match="but the heights"):
        pair_windows.pair_tiles(ask, 16, resample=False).count()
    with pytest.raises(Exception, match="fewer than a tile"):
        pair_windows.pair_tiles(ask, 64, allow_padding=False).count()


def test_blocks_outside_a_window_are_never_decoded():
    image = np.arange(1024 * 1024, dtype="u4").reshape(1024, 1024)
    t = Tiff(Memory(geotiff_bytes(image)))
    seen = []
    real = t.decoded
    t.decoded = lambda b: seen.append((b.row, b.col)) or real(b)
    pair_windows.cut_pair(t, Tiff(Memory(geotiff_bytes(image[::2, ::2].copy()))), 300, 500, 20)
    assert seen == [(256, 256), (256, 512)]


# epochs -----------------------------------------------------------------------------------------------------------------


def swapped(x, n, keys):
    for k, a, b in keys:
        other = (k % n + n - x) % n
        if (max(x, other) * a + b) % epochs.PRIME % 2:
            x = other
    return x


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(0, 10**6), st.integers(0, 50))
def test_each_epoch_is_a_permutation(n, seed, number):
    keys = epochs.round_keys(seed, number)
    order = [swapped(x, n, keys) for x in range(n)]
    assert sorted(order) == list(range(n))
    assert [swapped(s, n, keys[::-1]) for s in order] == list(range(n))


def test_epochs_of_workers(spark):
    n, keys = 1003, epochs.round_keys(5, 2)
    want = [swapped(x, n, keys) for x in range(n)]
    runs = []
    for parts in (1, 7):
        rows = [r for w in range(4) for r in epochs.epoch(spark, n, 5, 2, 4, w, 8).repartition(parts).collect()]
        assert len(rows) == n and {r["place"]: r["sample"] for r in rows} == dict(enumerate(want))
        runs.append(sorted(map(tuple, rows)))
    assert runs[0] == runs[1]
    later = epochs.epoch(spark, n, 5, 2, 4, 1, 8, start=20).collect()
    assert sorted(map(tuple, later)) == [r for r in runs[0] if r[1] % 4 == 1 and r[0] >= 20]
    back = spark.range(n).select("id", epochs.place_of(F.col("id"), n, keys).alias("place")).collect()
    assert all(want[r["place"]] == r["id"] for r in back)
    assert epochs.epoch(spark, 0, 5, 2).count() == 0
    moved = np.array([swapped(x, n, epochs.round_keys(5, 3)) for x in range(n)])
    assert (moved != np.array(want)).mean() > 0.98 and abs(np.corrcoef(moved, np.arange(n))[0, 1]) < 0.15


# diagnostics ------------------------------------------------------------------------------------------------------------


def test_segments_outlines_and_layers(spark):
    from umbraloom.operators import diagnostic

    ends = [("s", 2, 3, 2, 3), ("s", 0, 0, 5, 5), ("s", 7, 1, 4, 9), ("s", -3, 4, 3, 4), ("s", None, 1, 1, 1)]
    got = {(r["row"], r["col"]) for r in diagnostic.segment_pixels(spark.createDataFrame(ends, "scene string, r0 int, c0 int, r1 int, c1 int"), ["scene"], 8, 10).collect()}
    want = set()
    for _, r0, c0, r1, c1 in ends[:4]:
        n = max(abs(r1 - r0), abs(c1 - c0))
        want |= {(r0 + int(np.rint((r1 - r0) * k / n if n else 0)), c0 + int(np.rint((c1 - c0) * k / n if n else 0))) for k in range(n + 1)}
    assert got == {(r, c) for r, c in want if 0 <= r < 8 and 0 <= c < 10}
    m = np.random.default_rng(4).random((12, 14)) < 0.8
    mask = spark.createDataFrame([("s", int(r), int(c)) for r, c in np.argwhere(m)], "scene string, row int, col int")
    inner = np.pad(m, 1)
    edge = m & ~(inner[:-2, 1:-1] & inner[2:, 1:-1] & inner[1:-1, :-2] & inner[1:-1, 2:])
    assert {(r["row"], r["col"]) for r in diagnostic.outline_pixels(mask.unionAll(mask), ["scene"]).collect()} == {(int(r), int(c)) for r, c in np.argwhere(edge)}
    base = spark.createDataFrame([("s", r, c, None if (r, c) == (1, 1) else 300.0 * c) for r in range(3) for c in range(3)], "scene string, row int, col int, v double")
    dot = lambda *p: spark.createDataFrame([("s", *x) for x in p], "scene string, row int, col int")
    out = {(r["row"], r["col"]): (r["red"], r["green"], r["blue"]) for r in diagnostic.composed(base, [(dot((0, 0), (0, 1)), (1, 2, 3)), (dot((0, 1), (9, 9)), (4, 5, 6))], ["scene"]).collect()}
    assert len(out) == 9 and out[0, 0] == (1, 2, 3) and out[0, 1] == (4, 5, 6) and out[1, 1] == (0, 0, 0) and out[2, 2] == (255, 255, 255) and out[2, 0] == (0, 0, 0)
    assert diagnostic.composed(base, [], ["scene"]).count() == 9
