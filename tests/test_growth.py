"""What grows with the input stays off the driver, out of single tasks and out of repeated work; results stay those of the SQL."""

import datetime
import glob
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbraloom.llm import alignment
from umbraloom.operators import calibration, distributions, rays
from umbraloom.plans import catalogue
from umbraloom.sources import pair_windows
from umbraloom.sources.geotiff import geotiff_bytes
from umbraloom.sources.tiff_ranges import Block, Memory, Tiff


def test_merged_fraction_joins_no_rays_to_rays(spark):
    """A join of rays to the touched ones broadcast these from the driver; one join, to footprints, is enough."""
    feet = spark.createDataFrame([("s", "a", 5, 5), ("s", "b", 3, 3), ("s", "c", 3, 3), ("s", "a", 1, 1)], "scene_id string, building_id string, row int, col int")
    rows = [(1, 5, 5, True, 6.0), (1, 5, 5, True, 6.0), (2, 5, 5, True, 0.7), (3, 5, 5, True, -1.0), (4, 5, 5, True, 0.0), (5, 5, 5, False, 6.0), (None, 5, 5, True, 6.0)]
    r = spark.createDataFrame([("s", "a", *x) for x in rows] + [("s", "d", 1, 0, 9, True, 2.0), ("t", "b", 1, 5, 5, True, 6.0)], "scene_id string, building_id string, ray_id int, start_row int, start_col int, hit boolean, length_px double")
    got = rays.merged_fraction(r, ["scene_id", "building_id"], feet, F.lit(135.0))
    # of a: both rays 1 touch b and c; 2 is too short, 3 has no way, a ray without a number touches nothing
    assert {tuple(x) for x in got.collect()} == {("s", "a", 0.4), ("s", "d", 0.0), ("t", "b", 0.0)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_azimuths_without_a_band_have_no_row(spark, tmp_path):
    """Where all cells are buildings, no candidate has a band, and the SQL has no row."""
    when = datetime.datetime(2000, 1, 1)
    full = [(r * 64 + c, (r * 64 + c) // 64, "O", 300000.0, when, "1") for r in range(64) for c in range(64)]
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(full, schema).write.parquet(f"{tmp_path}/full/orders.parquet")
    assert catalogue.azimuth_scores(spark, f"{tmp_path}/full").collect() == []
    # one free cell, in shadow: a candidate has a band if it moves any cell there
    spark.createDataFrame([(k, c, s, 1000.0 if k == 32 * 64 + 32 else p, d, q) for k, c, s, p, d, q in full], schema).write.parquet(f"{tmp_path}/free/orders.parquet")
    assert {tuple(x) for x in catalogue.azimuth_scores(spark, f"{tmp_path}/free").collect()} == {(float(a), 1.0) for a in range(0, 360, 10)}


def test_windows_are_dealt_to_tasks(spark, tmp_path):
    """Requests of few bytes ended up in one task, which did all the work."""
    (tmp_path / "i.tif").write_bytes(geotiff_bytes(np.arange(6400.0).reshape(80, 80)))
    ask = spark.range(80).select(F.col("id").alias("stem"), *(F.lit(f"{tmp_path}/i.tif").alias(c) for c in ("image_path", "height_path")), F.col("id").cast("int").alias("row_off"), F.lit(3).alias("col_off"))
    got = pair_windows.pair_tiles(ask, 4).select("stem", F.element_at("height_m", 1).alias("z"), F.spark_partition_id().alias("task")).collect()
    assert {(int(t["stem"]), t["z"]) for t in got} == {(k, 80.0 * k + 3) for k in range(80)}
    assert len({t["task"] for t in got}) > 1


def test_blocks_are_decoded_once_while_they_fit():
    t, seen = Tiff(Memory(geotiff_bytes(np.arange(4096.0).reshape(64, 64)))), []
    real = t.decoded

    def decode(b):
        seen.append(b)
        return real(b)

    block = next(t.blocks())
    once = pair_windows.kept(decode)
    assert (once(block) == real(block)).all() and (once(block) == real(block)).all() and seen == [block]
    none = pair_windows.kept(lambda b: seen.append(b) or np.zeros(10), most=100)  # room for one block of 80 bytes
    for k in (0, 0, 1, 0):
        none(Block(k, None, 0, 0))
    assert [b.k for b in seen[1:]] == [0, 1, 0]


def test_references_are_found_without_a_window_over_all_rows(spark):
    """Tiles against a plain version; ids that repeat and keys that are null count as before, and no row but the first eligible ones is sorted."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):
        rows.append((str(k % 2), 0, [None, "x", "y"][k % 3], int(rng.integers(0, 6)), k // 2 if k < 40 else k, bool(k % 7), "edge" if k % 11 == 0 else None, [None, 0.2, 0.9][int(rng.integers(0, 3))], "NOMINAL", 190.0 + k % 40, 0.9, {0: True, 4: k % 4 > 0}, 0.95, float(rng.integers(2, 30)), float(rng.integers(0, 4)), float(rng.integers(4, 8)), 0.9, float(k % 13)))
    rows += [("0", 0, "x", 9, 1, True, None, 0.1, "NOMINAL", 300.0, 0.9, {0: True, 4: True}, 0.95, 5.0, 1.0, 4.0, 0.9, 1.0)] * 5  # one building five times: three are references
    kinds = "mode string, gap int, city string, tile int, id int, ok boolean, rejection string, merged double, confidence string, area double, solidity double, isolated map<int,boolean>, valid_fraction double, h double, spread double, length double, zone_ground double, hit_fraction double"
    judged = calibration.variants(spark.createDataFrame(rows, kinds), (0, 4))
    got = calibration.variant_summary(judged)
    tiles, groups = {}, {}
    for r in judged.collect():
        tiles.setdefault((r.mode, r.isolation, r.merged_check, r.city, r.tile), []).append(r)
    for (mode, isolation, check, city, _), of in tiles.items():
        fit = sorted((r for r in of if r.gate is None), key=lambda r: (r.spread / r.length, -r.area, r.id, r.h, r.length))
        refs = fit[:3]
        errors = []
        if len(fit) >= 2:
            scale, left = float(np.median([r.h / r.length for r in refs])), list(refs)
            for r in of:
                if r in left:
                    left.remove(r)
                elif r.with_truth:
                    errors.append(scale * r.length - r.h)
        for name in (city, "combined"):
            g = groups.setdefault((mode, isolation, check, name), [0, 0, [], []])
            g[0], g[1] = g[0] + len(of), g[1] + (len(fit) >= 2)
            g[2] += errors
            g[3] += [r.hit_fraction for r in of]
    assert got.count() == len(groups)
    for r in got.collect():
        n, with_refs, errors, hits = groups[r["mode"], r["isolation"], r["merged_check"], r["city"]]
        assert (r["buildings"], r["tiles_with_references"], r["n_errors"], r["median_hit_fraction"]) == (n, with_refs, len(errors), np.median(hits))
        assert (r["mae_m"], r["median_ae_m"], r["bias_m"]) == tuple(pytest.approx(f(errors)) for f in (lambda e: np.mean(np.abs(e)), lambda e: np.median(np.abs(e)), np.mean))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()  # ranks are cut off before


def test_token_lists_that_spell_other_bytes_are_told_by_the_transducer():
    """The transducer reads all bytes of both sides, so B's need no check of their own; groups of one token each are kept as text."""
    t = alignment.Transducer([b" a", b"b", b" ab", b"c"], [b" ", b"ab", b" a", b"b", b"bc"])
    for _ in range(2):  # the second time from the kept transitions
        assert t.align([0, 1], [2, 3]) == ([2, 1 * 5 + 3], ["0|2", "1|3"])
        assert t.align([2], [0, 1]) == ([2 * 5, 2 * 5 + 1], ["2|0,1"])
        assert t.align([0, 1, 3], [2, 4]) == ([2, 5 + 4, 3 * 5 + 4], ["0|2", "1,3|4"])
        assert t.align([], []) == ([], [])
        for a, b in (([0], [2, 3]), ([0, 1], [2]), ([0], [0]), ([2], [2, 1]), ([], [0]), ([0], [])):
            with pytest.raises(ValueError, match="different bytes"):
                t.align(a, b)
    assert t.opened[2] == "0|2"


@pytest.mark.parametrize("sizes", [{}, {"few": 0}, {"cells": 3, "few": 4}, {"cells": 3, "few": 0, "rounds": 1}])
def test_medians_are_those_of_percentile(spark, sizes):
    """Whatever the cells and rounds: outliers, two heaps, values that are not finite, differences over the largest double, weights, nulls."""
    rng = np.random.default_rng(7)
    big, inf, nan = 1.7e308, math.inf, math.nan
    sets = [[*rng.normal(0, 1, 60)], [*rng.normal(5, 1e-9, 31), 1e300, -1e300], [0.0] * 10 + [1000.0] * 10, [1e-9 * k for k in range(9)] + [1000 + 1e-9 * k for k in range(9)], [-big, -1.0, 2.0, big], [-inf, -inf, 1.0, 2.0, inf], [-big, big, big, inf, nan, nan, nan],
            [5e-324, 1e-323, 1.5e-323, 0.0, -0.0], [2.5], [None, None], [None, 1.0, 4.0], [10.0 ** k for k in range(-300, 300, 7)]]
    rows = [("k", [None, "x", "y"][(k + i) % 3], str(i), None if v is None else float(v), int(k % 4)) for i, of in enumerate(sets) for k, v in enumerate(of)] + [(None, "x", "0", 3.0, 1), (None, "x", "0", 8.0, 2)]
    df = spark.createDataFrame(rows, "a string, part string, b string, v double, n int")
    got = {(r["a"], r["b"], r["part"], r["_all"]): r["median"] for r in distributions.medians(df, ["a", "b"], "part", "v", "n", **sizes).collect()}
    want = df.groupingSets([["a", "b", "part"], ["a", "b"]], "a", "b", "part").agg(F.percentile("v", 0.5, F.col("n")).alias("m"), F.grouping("part").alias("g")).where("m is not null")
    want = {(r["a"], r["b"], r["part"], r["g"]): r["m"] for r in want.collect()}
    assert got.keys() == want.keys()
    assert {k: (v, got[k]) for k, v in want.items() if not (v == got[k] or math.isnan(v) and math.isnan(got[k]))} == {}


def test_summaries_hold_no_group_of_values_in_memory(spark, monkeypatch):
    """`percentile` kept all distinct errors of a variant in one task's memory; only the few references of a tile may be held so. Tables in between are deleted."""
    seen, real = [], F.percentile
    monkeypatch.setattr(F, "percentile", lambda *a: seen.append(a) or real(*a))
    kinds = "mode string, gap int, city string, tile int, id int, ok boolean, rejection string, merged double, confidence string, area double, solidity double, isolated map<int,boolean>, valid_fraction double, h double, spread double, length double, zone_ground double, hit_fraction double"
    rows = [("m", 0, "xy"[k % 2], k % 3, k, True, None, 0.1, "NOMINAL", 300.0, 0.9, {0: True, 4: True}, 0.95, 5.0 + k, 1.0, 4.0 + k % 5, 0.9, k / 40) for k in range(40)]
    got = calibration.variant_summary(calibration.variants(spark.createDataFrame(rows, kinds), (0,)))
    assert {(r["city"], r["buildings"], r["n_errors"], r["median_hit_fraction"]) for r in got.collect()} == {("x", 20, 11, 0.475), ("y", 20, 11, 0.5), ("combined", 40, 22, 0.4875)}
    assert len(seen) == 1 and "ercentile" not in got._jdf.queryExecution().optimizedPlan().toString()
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert glob.glob(f"{shared}/variant-*") == []
