"""Rays against all triangles; fits by rounds against numpy, unbroken and resumed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbraloom.operators import raycast, rounds

RAYS = "scene string, ray_id long, ox double, oy double, oz double, dx double, dy double, dz double"


def first_hit(z, o, d):
    """(t, row, col, half) over all triangles, one after the other."""
    best = None
    for r in range(z.shape[0] - 1):
        for c in range(z.shape[1] - 1):
            q = {k: np.array([c + k % 2, r + k // 2, z[r + k // 2, c + k % 2]], float) for k in range(4)}
            if not all(np.isfinite(v[2]) for v in q.values()):
                continue
            for half, (i, j, k) in enumerate(((0, 2, 1), (1, 2, 3))):
                m = np.stack([q[j] - q[i], q[k] - q[i], -np.array(d)], axis=1)
                if abs(np.linalg.det(m)) < 1e-12:
                    continue
                u, v, t = np.linalg.solve(m, np.array(o) - q[i])
                if u >= -1e-12 and v >= -1e-12 and u + v <= 1 + 1e-12 and t >= 0 and (best is None or t < best[0] - 1e-12):
                    best = (t, r, c, half)
    return best


def test_rays_against_all_triangles(spark):
    rng = np.random.default_rng(7)
    z = rng.random((13, 17)) * 4
    z[3, 4] = np.nan
    grids = {"a": z, "b": np.full((5, 5), 2.0)}
    cells = spark.createDataFrame([(s, r, c, None if np.isnan(v) else float(v)) for s, g in grids.items() for (r, c), v in np.ndenumerate(g)], "scene string, row int, col int, z double")
    rays = [("a", k, *rng.uniform(-3, 18, 2), rng.uniform(-2, 12), *rng.normal(size=3)) for k in range(250)]
    rays += [("a", 900, 6.3, 5.2, 50.0, 0.0, 0.0, -1.0), ("a", 901, 6.3, 5.2, -50.0, 0.0, 0.0, 2.0), ("a", 902, -5.0, 6.3, 1.5, 1.0, 0.0, 0.0), ("b", 1, 1.3, 1.4, 9.0, 0.1, 0.2, -1.0), ("b", 2, 1.3, 1.4, 1.0, 0.0, 0.0, -1.0)]
    odd = [("b", 3, 1.0, 1.0, 9.0, 0.0, 0.0, 0.0), ("b", 4, None, 1.0, 9.0, 0.0, 0.0, -1.0), ("none", 5, 1.0, 1.0, 9.0, 0.0, 0.0, -1.0)]
    df = spark.createDataFrame([tuple(v if isinstance(v, (str, int)) or v is None else float(v) for v in r) for r in rays + odd], RAYS).repartition(3)
    for depth, leaf in ((2, 4), (5, 1), (0, 32)):
        got = {(r["scene"], r["ray_id"]): r for r in raycast.raycast(df, cells, ["scene"], depth=depth, leaf=leaf).collect()}
        assert len(got) == len(rays) + len(odd) and all(got[r[0], r[1]]["t"] is None for r in odd)
        hits = 0
        for s, k, *v in rays:
            want, r = first_hit(grids[s], v[:3], v[3:]), got[s, k]
            assert (want is None) == (r["t"] is None)
            if want:
                hits += 1
                assert abs(r["t"] - want[0]) < 1e-9 and abs(r["z"] - (v[2] + want[0] * v[5])) < 1e-9 and (r["row"], r["col"], r["half"]) == want[1:]
        assert hits > 60
    assert raycast.raycast(df.limit(0), cells, ["scene"]).count() == 0


def test_few_nodes_are_entered(spark):
    """A ray straight down meets one node on each level."""
    cells = spark.range(64 * 64).select(F.lit("s").alias("scene"), F.expr("cast(id div 64 as int)").alias("row"), (F.col("id") % 64).cast("int").alias("col"), (F.col("id") % 7).cast("double").alias("z"))
    nodes = raycast.square_nodes(raycast.triangles(cells, ["scene"], "z"), ["scene"], 4, 4)
    down = spark.createDataFrame([("s", 1, 20.3, 33.4, 90.0, 0.0, 0.0, -1.0)], RAYS)
    box = raycast._meets_box([F.col("nc") * F.lit(4) * F.expr("shiftleft(1, 4 - level)"), F.col("nr") * F.lit(4) * F.expr("shiftleft(1, 4 - level)"), F.col("low")], [(F.col("nc") + 1) * F.lit(4) * F.expr("shiftleft(1, 4 - level)"), (F.col("nr") + 1) * F.lit(4) * F.expr("shiftleft(1, 4 - level)"), F.col("high")])
    assert sorted((r["level"], r["nr"], r["nc"]) for r in nodes.join(down, "scene").where(box).collect()) == [(0, 0, 0), (1, 1, 0), (2, 2, 1), (3, 4, 2), (4, 8, 5)]


def table(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 2))
    tile = rng.integers(0, 40, 4000)
    h = np.exp(0.7 * x[:, 0] - 0.2 * x[:, 1] + 0.05 * tile + 0.1 * rng.normal(size=4000))
    rows = [(int(t), "val" if t % 4 == 0 else "train", float(a), float(b), float(v)) for t, (a, b), v in zip(tile, x, h, strict=True)]
    return spark.createDataFrame([*rows, (1, "train", None, 1.0, 5.0), (1, "train", 1.0, 1.0, None), (1, "train", 1.0, 1.0, -3.0), (1, "train", 1.0, 1.0, float("nan")), (77, "train", 9.0, 9.0, 1.0)], "tile int, side string, a double, b double, h double").repartition(5), np.array(rows, object)


def plain_rounds(rows, n, rate):
    w, out = np.zeros(3), []
    for _ in range(n + 1):
        loss, slope = {"train": [], "val": []}, []
        for t in sorted({r[0] for r in rows}):
            own = rows[[r[0] == t for r in rows]]
            x = np.column_stack([own[:, 2].astype(float), own[:, 3].astype(float), np.ones(len(own))])
            d = x @ w - np.log(own[:, 4].astype(float))
            loss[own[0, 1]].append((d**2).mean() - 0.85 * d.mean() ** 2)
            if own[0, 1] == "train":
                slope.append(2 * (x * d[:, None]).mean(axis=0) - 1.7 * d.mean() * x.mean(axis=0))
        out.append((np.mean(loss["train"]), np.mean(loss["val"]), w.copy()))
        w = w - rate * np.mean(slope, axis=0)
    return out


def test_rounds_against_numpy_and_resumed(spark, tmp_path):
    df, rows = table(spark)
    whole = rounds.fit_rounds(df, ["a", "b"], "h", "tile", "side", 6, 0.3)
    for h, (train, val, w) in zip(whole.history, plain_rounds(rows, 6, 0.3), strict=True):
        assert abs(h["train"] - train) < 1e-9 and abs(h["val"] - val) < 1e-9 and np.allclose(h["weights"], w)
    losses = [h["train"] for h in whole.history]
    assert losses == sorted(losses, reverse=True) and losses[-1] < losses[0] / 2 and abs(whole.best_weights[0] - 0.7) < 0.05
    at = f"file://{tmp_path}/run"
    for upto in (2, 3, 6):  # three runs, each of which goes on from the folder
        part = rounds.fit_rounds(df, ["a", "b"], "h", "tile", "side", upto, 0.3, at)
    assert part.round == whole.round and part.best_round == whole.best_round and np.allclose(part.best_weights, whole.best_weights)
    assert [h["round"] for h in part.history] == list(range(7)) and np.allclose([h["val"] for h in part.history], [h["val"] for h in whole.history])
    z = rounds.predicted(df.where("a is not null"), ["a", "b"], whole.best_weights).first()
    assert abs(z["z_rel"] - (whole.best_weights[0] * z["a"] + whole.best_weights[1] * z["b"] + whole.best_weights[2])) < 1e-12


def test_the_best_round_is_chosen_by_validation(spark):
    df, _ = table(spark)
    wild = rounds.fit_rounds(df, ["a", "b"], "h", "tile", "side", 5, 2.0)
    held = [h["val"] for h in wild.history]
    assert wild.best_round == int(np.argmin(held)) < 5 and wild.best_weights == wild.history[wild.best_round]["weights"]
    no_val = rounds.fit_rounds(df.where("side = 'train'"), ["a", "b"], "h", "tile", "side", 1, 0.3)
    assert no_val.history[0]["val"] is None and no_val.best_round == 1


def test_refused_fits(spark):
    df, _ = table(spark)
    with pytest.raises(ValueError, match="both sides"):
        rounds.fit_rounds(df.withColumn("side", F.when(F.col("a") > 0, "val").otherwise("train")), ["a"], "h", "tile", "side", 1, 0.1)
    with pytest.raises(ValueError, match="no training sample"):
        rounds.fit_rounds(df.where("side = 'val'"), ["a"], "h", "tile", "side", 1, 0.1)
    with pytest.raises(ValueError, match="smaller rate"):
        rounds.fit_rounds(df, ["a", "b"], "h", "tile", "side", 60, 1e9)
