"""Operators on rasters that are cut into tiles: results do not depend on the cut, and are those of brute force."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from umbraloom.operators import components, morphology, surfaces, terrain, unions


def as_cells(spark, grids, kind="double", value="z"):
    rows = [(s, r, c, None if v is None or v != v else v) for s, z in grids.items() for r, line in enumerate(z.tolist()) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, f"scene_id string, row int, col int, {value} {kind}").repartition(3)


# components -------------------------------------------------------------------------------------------------------------


def flooded(mask, n):
    out, k = np.zeros(mask.shape, int), 0
    for r, c in np.argwhere(mask):
        if not out[r, c]:
            k, stack = k + 1, [(r, c)]
            while stack:
                y, x = stack.pop()
                if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                    out[y, x] = k
                    stack += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (n == 8 or abs(a) + abs(b) == 1)]
    return out


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_do_not_depend_on_tiles(spark, connectivity):
    rng = np.random.default_rng(3)
    snake = np.zeros((27, 25), bool)
    snake[::2] = True  # one component through all tiles
    snake[1::4, -1] = snake[3::4, 0] = True
    grids = {"noise": rng.random((30, 23)) < 0.5, "snake": snake, "empty": np.zeros((4, 4), bool), "full": np.ones((9, 9), bool)}
    labels = as_cells(spark, {k: np.where(m, 6, 2) for k, m in grids.items()}, "int", "cls")
    want = {(s, int(r), int(c)): f"{s}:b{n:04d}" for s, m in grids.items() for f in [flooded(m, connectivity)] for (r, c), n in np.ndenumerate(f) if n}
    for tile in (3, 9, 64):
        got = components.tiled_footprints(labels.unionAll(labels.where("row = 0")), tile, connectivity=connectivity).collect()
        assert len(got) == len(want) and {(r["scene_id"], r["row"], r["col"]): r["building_id"] for r in got} == want
    assert components.tiled_footprints(labels.where("cls = 99"), 3).count() == 0
    odd = labels.unionAll(spark.createDataFrame([("full", None, 3, 6), ("full", 3, None, 6)], labels.schema))
    assert components.tiled_footprints(odd, 4, connectivity=connectivity).count() == len(want)


def test_unions_and_ranks(spark):
    chain = [("a", k, k + 1) for k in range(200)] + [("b", 5, 3), ("b", 3, 5), ("b", 7, 7), ("b", 9, 8)]
    got = {(r["by"], r["label"]): r["root"] for r in unions.united(spark.createDataFrame(chain, "by string, a long, b long"), ["by"]).collect()}
    assert got == {("a", k): 0 for k in range(201)} | {("b", 3): 3, ("b", 5): 3, ("b", 8): 8, ("b", 9): 8}
    rows = spark.createDataFrame([(g, v) for g in "xy" for v in (5, 3, 900, 17, 64, 4096)], "g string, v long")
    for bits in (1, 5, 40):
        assert {(r["g"], r["v"]): r["rank"] for r in unions.ranked(rows, ["g"], "v", bits=bits).collect()} == {(g, v): k for g in "xy" for k, v in enumerate(sorted((5, 3, 900, 17, 64, 4096)), 1)}


# nearest fill -----------------------------------------------------------------------------------------------------------


def nearest(z):
    """The nearest valid value of each cell; ties by row, then column."""
    ok = np.argwhere(~np.isnan(z))
    out = z.copy()
    for r, c in np.argwhere(np.isnan(z)) if len(ok) else []:
        d = ((ok - [r, c]) ** 2).sum(axis=1)
        out[r, c] = z[tuple(ok[np.argmin(d)])]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-1, 6), min_size=1, max_size=25).filter(lambda d: max(d) >= 0))
def test_lower_envelope(d):
    rows = np.cumsum(np.arange(len(d)) % 3 + 1) - 4
    best = morphology.nearest_rows(rows, np.array(d))
    for r, k in zip(rows, best, strict=True):
        far = [(r - q) ** 2 + x * x if x >= 0 else 10**9 for q, x in zip(rows, d, strict=True)]
        assert k == int(np.argmin(far))


def test_nearest_fill_against_brute(spark):
    rng = np.random.default_rng(5)
    grids = {k: np.where(rng.random((h, w)) < share, rng.random((h, w)), np.nan) for k, (h, w, share) in {"a": (13, 40, 0.1), "b": (41, 9, 0.02), "c": (6, 6, 1.0), "d": (5, 4, 0.0)}.items()}
    for strip in (1, 7, 100):
        got = morphology.nearest_fill(as_cells(spark, grids), ["scene_id"], strip=strip).collect()
        assert len(got) == sum(z.size for z in grids.values())
        for s, z in grids.items():
            want = nearest(z)
            assert all((r["filled"] is None and np.isnan(want[r["row"], r["col"]])) or r["filled"] == want[r["row"], r["col"]] for r in got if r["scene_id"] == s)


# terrain ----------------------------------------------------------------------------------------------------------------


def lifted(p, lift, a, b, c, q):
    """Whether q is in the circle of a, b, c, ties broken by the lifts; all exact."""
    rows = [[p[i][0] - p[q][0], p[i][1] - p[q][1]] for i in (a, b, c)]
    det = lambda w: sum(w[i] * (rows[j][0] * rows[k][1] - rows[k][0] * rows[j][1]) for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))
    turn = (p[b][0] - p[a][0]) * (p[c][1] - p[a][1]) - (p[b][1] - p[a][1]) * (p[c][0] - p[a][0])
    if not turn:
        return True
    d = det([x * x + y * y for x, y in rows]) or det([lift[i] - lift[q] for i in (a, b, c)])
    return d * turn > 0


@settings(max_examples=120, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=14))
def test_triangulation_against_all_triples(places):
    p = np.array(sorted(places)).reshape(-1, 2)
    lift = [int(v) for v in terrain.draw(p[:, 0], p[:, 1])]
    q = [tuple(map(int, x)) for x in p]
    got = {tuple(sorted(map(int, t))) for t in terrain.Triangulation(p, np.array(lift)).triangles()}
    want = {t for t in itertools.combinations(range(len(q)), 3) if not any(lifted(q, lift, *t, k) for k in range(len(q)) if k not in t) and lifted_turn(q, t)}
    assert got == want


def lifted_turn(p, t):
    a, b, c = (p[i] for i in t)
    return (b[0] - a[0]) * (c[1] - a[1]) != (b[1] - a[1]) * (c[0] - a[0])


def test_many_points_are_triangulated_fast():
    rng = np.random.default_rng(1)
    p = np.unique(rng.integers(0, 2000, (20_000, 2)), axis=0)
    t = terrain.Triangulation(p, terrain.draw(p[:, 0], p[:, 1])).triangles()
    chain = terrain.hull(p)
    area = lambda q: sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(q, [*q[1:], q[0]], strict=True))
    corners = p[t]
    twice = np.abs((corners[:, 1, 0] - corners[:, 0, 0]) * (corners[:, 2, 1] - corners[:, 0, 1]) - (corners[:, 1, 1] - corners[:, 0, 1]) * (corners[:, 2, 0] - corners[:, 0, 0]))
    assert twice.sum() == abs(area(chain)) and (twice > 0).all()


@settings(max_examples=100, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=12))
def test_rows_of_a_hull(places):
    p = np.array(sorted(places))
    chain, inside = terrain.hull(p), set()
    for r, c in itertools.product(range(10), range(10)):
        turns = [(b[0] - a[0]) * (c - a[1]) - (b[1] - a[1]) * (r - a[0]) for a, b in zip(chain, [*chain[1:], chain[0]], strict=True)]
        box = p.min(axis=0)[0] <= r <= p.max(axis=0)[0] and p.min(axis=0)[1] <= c <= p.max(axis=0)[1]
        if box and (all(t >= 0 for t in turns) or all(t <= 0 for t in turns)):
            inside.add((r, c))
    assert {(r, c) for r, a, b in terrain.hull_rows(p) for c in range(a, b + 1)} == inside


def scenes():
    rng = np.random.default_rng(8)
    r, c = np.mgrid[0:48, 0:48]
    town = 5 + 0.1 * r - 0.05 * c
    ground = np.ones((48, 48), bool)
    for y, x, h, w in ((4, 4, 9, 14), (20, 17, 12, 13), (38, 0, 6, 8), (33, 33, 15, 15), (0, 30, 5, 9)):
        town[y : y + h, x : x + w] += 9 + rng.random((min(h, 48 - y), min(w, 48 - x)))
        ground[y : y + h, x : x + w] = False
    noise, sparse = rng.random((48, 48)) * 4, rng.random((48, 48)) * 50
    noise[rng.random((48, 48)) < 0.1] = np.nan
    return {"town": (town, ground), "noise": (noise, rng.random((48, 48)) < 0.4), "sparse": (sparse, rng.random((48, 48)) < 0.01), "none": (sparse, np.zeros((48, 48), bool)), "line": (sparse, r == c)}


def terrain_of(spark, tile, halo, passes=5):
    rows = [(s, r, c, None if np.isnan(z[r, c]) else float(z[r, c]), bool(g[r, c])) for s, (z, g) in scenes().items() for r in range(48) for c in range(48)]
    cells = spark.createDataFrame(rows, "scene_id string, row int, col int, z double, is_ground boolean").repartition(3)
    got = surfaces.interpolate_dtm(cells, ["scene_id"], tile=tile, halo=halo, passes=passes).collect()
    assert len(got) == len(rows)
    return {(r["scene_id"], r["row"], r["col"]): (r["dtm"], r["is_final_ground"]) for r in got}


def by_all_triples(z, ground):
    """The terrain of one grid without re-admission: heights on triangles found by insertion, without tiles, and nearest ground outside of the hull."""
    ground = ground & ~np.isnan(z)
    rim = np.array([(r, c) for r, c in np.argwhere(ground) if r in (0, 47) or c in (0, 47) or not ground[r - 1 : r + 2, c - 1 : c + 2].all()]).reshape(-1, 2)
    out = np.where(ground, z, np.nan)
    near = nearest(out)
    gaps = np.argwhere(~ground)
    got = terrain.interpolated(rim, z[tuple(rim.T)], gaps, (0, 0, 47, 47), (0, 0, 47, 47)) if len(rim) else np.full(len(gaps), np.nan)
    out[tuple(gaps.T)] = np.where(np.isnan(got), near[tuple(gaps.T)], got)
    return out


def test_terrain_does_not_depend_on_tiles(spark):
    one = terrain_of(spark, 48, 48)
    for tile, halo in ((24, 4), (12, 3)):
        got = terrain_of(spark, tile, halo)
        for k, (h, g) in one.items():
            assert got[k][1] == g and (h is None and got[k][0] is None or abs(h - got[k][0]) < 1e-9)
    plain = terrain_of(spark, 12, 6, passes=0)
    for s, (z, g) in scenes().items():
        want = by_all_triples(z, g)
        assert all((plain[s, r, c][0] is None and np.isnan(want[r, c])) or abs(plain[s, r, c][0] - want[r, c]) < 1e-9 for r in range(48) for c in range(48))


def test_terrain_under_a_box(spark):
    got = terrain_of(spark, 16, 4)
    for r, c in itertools.product(range(20, 32), range(17, 30)):
        assert abs(got["town", r, c][0] - (5 + 0.1 * r - 0.05 * c)) < 1e-9 and not got["town", r, c][1]
    assert all(got["none", r, 5] == (None, False) for r in range(48))


def test_terrain_keeps_columns_of_any_name(spark):
    names = ["filled", "raster", "tin", "_g", "_e", "_h", "gap"]
    rows = [("s", r, c, 5.0 + (9.0 if 3 <= r < 6 and 3 <= c < 6 else 0.0), not (3 <= r < 6 and 3 <= c < 6), *[f"{r}-{c}-{n}" for n in names]) for r in range(9) for c in range(9) if (r, c) not in ((0, 0),)]
    rows.append(("s", 0, 0, None, False, *[f"0-0-{n}" for n in names]))
    cells = spark.createDataFrame(rows, "scene_id string, row int, col int, z double, is_ground boolean, " + ", ".join(f"`{n}` string" for n in names))
    got = surfaces.interpolate_dtm(cells, ["scene_id"], tile=4, halo=2)
    assert got.columns == [*cells.columns, "dtm", "is_final_ground"]
    for r in got.collect():
        assert r["dtm"] == 5.0 and all(r[n] == f"{r['row']}-{r['col']}-{n}" for n in names)
