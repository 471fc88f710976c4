"""Terrain between ground pixels: a triangulation over tiles with a halo, whose result does not depend on the cut.

Whether a triangle belongs to the Delaunay triangulation depends on the points in its circle alone. A tile sees its points and those of a halo around it; a triangle
whose circle, as far as the raster reaches, lies in what the tile sees is one of the whole raster's. Pixels that no such triangle covers go into
another round with twice the halo. Points on a grid often lie on one circle, where a plain Delaunay rule leaves a choice: ties are broken by a
number that is drawn from each point's place in the raster, as if it were lifted by that much of an infinitesimal, so that every tile breaks them alike.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraloom.operators.lineage import cut
from umbraloom.operators.morphology import erosion, nearest_fill

TILE, HALO = 256, 64
#: Fixed value: passes of the terrain's re-admission.
PASSES = 5
GHOST = -1  # the vertex at infinity


def draw(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """A number below 2^40 for each place."""
    x = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + cols.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(24)).astype(np.int64)


def _along_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The order of points along a curve that fills the plane, so that each is near the one before."""
    code = np.zeros(len(x), np.uint64)
    for bit in range(24):
        code |= ((x.astype(np.uint64) >> np.uint64(bit)) & np.uint64(1)) << np.uint64(2 * bit)
        code |= ((y.astype(np.uint64) >> np.uint64(bit)) & np.uint64(1)) << np.uint64(2 * bit + 1)
    return np.argsort(code, kind="stable")


class Triangulation:
    """The Delaunay triangulation of different points with integer coordinates from 0 on, by insertion. Arithmetic is exact.

    apex[u, v] is the third corner of the triangle to the left of the edge from u to v; beyond an edge of the hull it is GHOST."""

    def __init__(self, points: np.ndarray, lifts: np.ndarray) -> None:
        self.p, self.lift = [tuple(map(int, q)) for q in points], [int(v) for v in lifts]
        self.apex: dict[tuple[int, int], int] = {}
        order = _along_curve(points[:, 0], points[:, 1]).tolist() if len(points) else []
        third = next((k for k in range(2, len(order)) if self._side(order[0], order[1], self.p[order[k]])), None)
        if third is None:
            return
        a, b, c = order[0], order[1], order.pop(third)
        if self._side(a, b, self.p[c]) < 0:
            a, b = b, a
        for u, v, w in ((a, b, c), (b, a, GHOST), (c, b, GHOST), (a, c, GHOST)):
            self._put(u, v, w)
        self.near = (a, b)
        for k in order[2:]:
            self._insert(k)

    def triangles(self) -> np.ndarray:
        """The corners of each triangle once, counter-clockwise in (x, y)."""
        return np.array([(u, v, w) for (u, v), w in self.apex.items() if GHOST not in (u, v, w) and u < v and u < w], int).reshape(-1, 3)

    def _side(self, a: int, b: int, q: tuple[int, int]) -> int:
        (ax, ay), (bx, by) = self.p[a], self.p[b]
        return (bx - ax) * (q[1] - ay) - (by - ay) * (q[0] - ax)

    def _put(self, u: int, v: int, w: int) -> None:
        self.apex[u, v] = w
        self.apex[v, w] = u
        self.apex[w, u] = v

    def _meets(self, u: int, v: int, w: int, k: int) -> bool:
        """Whether point k lies in the circle of a triangle; that of a ghost is the open half-plane beyond its edge, with the edge's inside."""
        if GHOST in (u, v, w):
            while w != GHOST:
                u, v, w = v, w, u
            q = self.p[k]
            side = self._side(u, v, q)
            if side:
                return side > 0
            (ax, ay), (bx, by) = self.p[u], self.p[v]
            return (q[0] - ax) * (q[0] - bx) + (q[1] - ay) * (q[1] - by) < 0
        x, y = self.p[k]
        (ax, ay), (bx, by), (cx, cy) = self.p[u], self.p[v], self.p[w]
        ax, ay, bx, by, cx, cy = ax - x, ay - y, bx - x, by - y, cx - x, cy - y
        bc, ca, ab = bx * cy - cx * by, cx * ay - ax * cy, ax * by - bx * ay
        d = (ax * ax + ay * ay) * bc + (bx * bx + by * by) * ca + (cx * cx + cy * cy) * ab
        if not d:
            n, lift = self.lift[k], self.lift
            d = (lift[u] - n) * bc + (lift[v] - n) * ca + (lift[w] - n) * ab
        return d > 0

    def _found(self, k: int) -> tuple[int, int]:
        """An edge whose left triangle meets point k: a walk from the last one towards it."""
        q, (u, v) = self.p[k], self.near
        if (u, v) not in self.apex:
            u, v = next(iter(self.apex))
        w = self.apex[u, v]
        if GHOST in (u, v, w):  # start from the triangle inside
            while w != GHOST:
                u, v, w = v, w, u
            u, v = v, u
        if self._side(u, v, q) < 0:
            u, v = v, u
        while True:
            w = self.apex[u, v]
            if w == GHOST:
                return u, v
            if self._side(v, w, q) < 0:
                u, v = w, v
            elif self._side(w, u, q) < 0:
                u, v = u, w
            else:
                return u, v

    def _insert(self, k: int) -> None:
        u, v = self._found(k)
        first = (u, v, self.apex[u, v])
        gone, rim, todo = {frozenset(first): first}, [], [first]
        while todo:
            t = todo.pop()
            for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                c = self.apex[b, a]
                if (key := frozenset((a, b, c))) in gone:
                    continue
                if self._meets(b, a, c, k):
                    gone[key] = (b, a, c)
                    todo.append((b, a, c))
                else:
                    rim.append((a, b))
        for a, b, c in gone.values():
            del self.apex[a, b], self.apex[b, c], self.apex[c, a]
        for a, b in rim:
            self._put(a, b, k)
            if GHOST not in (a, b):
                self.near = (a, b)


def reach(corners: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """Least and greatest coordinates (x0, y0, x1, y1) of what the circles of triangles (n, 3, 2) cover of a box (x0, y0, x1, y1)."""
    (ax, ay), (bx, by), (cx, cy) = (corners[:, k].T.astype(float) for k in range(3))
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    sa, sb, sc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    x, y = (sa * (by - cy) + sb * (cy - ay) + sc * (ay - by)) / d, (sa * (cx - bx) + sb * (ax - cx) + sc * (bx - ax)) / d
    r2 = (ax - x) ** 2 + (ay - y) ** 2
    r2 = r2 * (1 + 1e-9) + 1e-6  # rounding may only make a circle larger
    x0, y0, x1, y1 = box
    # the widest chord along one axis is at the box's line next to the centre
    half_x = np.sqrt(np.maximum(0, r2 - (np.clip(y, y0, y1) - y) ** 2))
    half_y = np.sqrt(np.maximum(0, r2 - (np.clip(x, x0, x1) - x) ** 2))
    return np.stack([np.maximum(x0, x - half_x), np.maximum(y0, y - half_y), np.minimum(x1, x + half_x), np.minimum(y1, y + half_y)], axis=1)


def interpolated(points: np.ndarray, z: np.ndarray, gaps: np.ndarray, seen: tuple[int, int, int, int], raster: tuple[int, int, int, int]) -> np.ndarray:
    """Heights at gaps (rows, columns) from points (rows, columns) that are all those inside `seen` (r0, c0, r1, c1; ends inclusive); NaN where no triangle that is surely
    one of the whole raster's covers a gap."""
    out = np.full(len(gaps), np.nan)
    if len(points) < 3 or not len(gaps):
        return out
    order = np.lexsort((points[:, 1], points[:, 0]))  # so that corners have the same order in every tile
    points, z = points[order], z[order]
    r0, c0 = seen[0], seen[1]
    t = Triangulation(points - (r0, c0), draw(points[:, 0], points[:, 1])).triangles()
    if not len(t):
        return out
    cover = reach(points[t], raster)
    own = np.array([-np.inf if seen[k] <= raster[k] else seen[k] for k in (0, 1)] + [np.inf if seen[k] >= raster[k] else seen[k] for k in (2, 3)])
    t = t[(cover[:, 0] >= own[0]) & (cover[:, 1] >= own[1]) & (cover[:, 2] <= own[2]) & (cover[:, 3] <= own[3])]
    if not len(t):
        return out
    t = np.sort(t, axis=1)
    t = t[np.lexsort((t[:, 2], t[:, 1], t[:, 0]))]
    lo_r, lo_c, hi_r, hi_c = gaps[:, 0].min(), gaps[:, 1].min(), gaps[:, 0].max(), gaps[:, 1].max()
    where = np.full((hi_r - lo_r + 1, hi_c - lo_c + 1), -1)
    where[gaps[:, 0] - lo_r, gaps[:, 1] - lo_c] = np.arange(len(gaps))
    count = np.pad(np.cumsum(np.cumsum(where >= 0, axis=0), axis=1), ((1, 0), (1, 0)))
    low = np.maximum(points[t].min(axis=1) - (lo_r, lo_c), 0)
    high = np.minimum(points[t].max(axis=1) - (lo_r, lo_c) + 1, where.shape)
    some = (low < high).all(axis=1)
    t, low, high = t[some], low[some], high[some]
    n = count[high[:, 0], high[:, 1]] - count[low[:, 0], high[:, 1]] - count[high[:, 0], low[:, 1]] + count[low[:, 0], low[:, 1]]
    for (i, j, k), a, b in zip(t[n > 0], low[n > 0], high[n > 0], strict=True):
        ids = where[a[0] : b[0], a[1] : b[1]].ravel()
        ids = ids[ids >= 0]
        q = gaps[ids] - points[i]
        (ur, uc), (vr, vc) = points[j] - points[i], points[k] - points[i]
        d = ur * vc - uc * vr
        u, v = q[:, 0] * vc - q[:, 1] * vr, ur * q[:, 1] - uc * q[:, 0]
        if d < 0:
            d, u, v = -d, -u, -v
        inside = (u >= 0) & (v >= 0) & (u + v <= d) & np.isnan(out[ids])
        out[ids[inside]] = z[i] + (u[inside] * (z[j] - z[i]) + v[inside] * (z[k] - z[i])) / d
    return out


def hull_rows(points: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, first column, last column) of the places inside the convex hull of points (rows, columns), border included."""
    chain = hull(points)
    low: dict[int, int] = {}
    high: dict[int, int] = {}
    for (r0, c0), (r1, c1) in zip(chain, [*chain[1:], chain[0]], strict=True):
        if r0 > r1:
            r0, c0, r1, c1 = r1, c1, r0, c0
        for r in range(r0, r1 + 1):
            up, down = (c0, c0) if r0 == r1 else (-((-c0 * (r1 - r0) - (c1 - c0) * (r - r0)) // (r1 - r0)), (c0 * (r1 - r0) + (c1 - c0) * (r - r0)) // (r1 - r0))
            low[r], high[r] = min(low.get(r, up), up), max(high.get(r, down), down)
    return [(r, low[r], high[r]) for r in sorted(low)]


def hull(points: np.ndarray) -> list[tuple[int, int]]:
    """The corners of the convex hull in turn."""
    p = sorted({(int(r), int(c)) for r, c in points})
    if len(p) < 3:
        return p
    sides: list[tuple[int, int]] = []
    for run in (p, p[::-1]):
        side: list[tuple[int, int]] = []
        for q in run:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (q[1] - side[-2][1]) - (side[-1][1] - side[-2][1]) * (q[0] - side[-2][0]) <= 0:
                side.pop()
            side.append(q)
        sides += side[:-1]
    return sides


def _kinds(df: DataFrame, by: Sequence[str]) -> str:
    return ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)


def inside_hull(points: DataFrame, by: Sequence[str], tile: int) -> DataFrame:
    """(by, row, _c0, _c1): which columns of each row lie inside the hull of points (by, row, col). Hulls of tiles, then of rows of tiles, then of rasters: a group
    holds corners of hulls only."""
    by = list(by)
    kinds = _kinds(points, by)

    def corners(*keys: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            h = np.array(hull(pdf[["row", "col"]].to_numpy())).reshape(-1, 2)
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(h) for k in (*by, *keys)}, "row": h[:, 0], "col": h[:, 1]})

        return run

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        got = pd.DataFrame(hull_rows(pdf[["row", "col"]].to_numpy()), columns=["row", "_c0", "_c1"])
        return got.assign(**{b: pdf[b].iloc[0] for b in by})[[*by, "row", "_c0", "_c1"]]

    cells = points.select(*by, "row", "col", F.floor(F.col("row") / tile).alias("_tr"), F.floor(F.col("col") / tile).alias("_tc"))
    tiles = cells.groupBy(*by, "_tr", "_tc").applyInPandas(corners("_tr"), f"{kinds}, _tr long, row int, col int")
    bands = tiles.groupBy(*by, "_tr").applyInPandas(corners(), f"{kinds}, row int, col int")
    return bands.groupBy(*by).applyInPandas(rows, f"{kinds}, row int, _c0 int, _c1 int")


def _round(points: DataFrame, gaps: DataFrame, by: Sequence[str], tile: int, halo: int) -> DataFrame:
    """Gaps (by, row, col, raster) with `tin` where the triangles that their tile and its halo are sure of cover them."""
    by = list(by)
    at = lambda c: F.floor(c / tile).cast("int")
    wanted = gaps.select(*by, at(F.col("row")).alias("_tr"), at(F.col("col")).alias("_tc"), "row", "col", F.lit(None).cast("double").alias("z"), "raster", F.lit(True).alias("gap"))
    span = lambda c: F.explode(F.sequence(at(F.col(c) - halo), at(F.col(c) + halo)))
    spread = points.select(*by, "row", "col", "z", span("row").alias("_tr")).withColumn("_tc", span("col"))
    spread = spread.join(wanted.select(*by, "_tr", "_tc").distinct(), [*by, "_tr", "_tc"])  # tiles with gaps only
    both = wanted.unionByName(spread.withColumns({"raster": F.lit(None).cast("array<int>"), "gap": F.lit(False)}))
    kinds = _kinds(gaps, by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g, p = pdf[pdf["gap"]], pdf[~pdf["gap"]]
        raster = tuple(int(v) for v in g["raster"].iloc[0]) if len(g) else (0, 0, 0, 0)
        tr, tc = int(pdf["_tr"].iloc[0]), int(pdf["_tc"].iloc[0])
        seen = (max(raster[0], tr * tile - halo), max(raster[1], tc * tile - halo), min(raster[2], (tr + 1) * tile - 1 + halo), min(raster[3], (tc + 1) * tile - 1 + halo))
        p = p[p["row"].between(seen[0], seen[2]) & p["col"].between(seen[1], seen[3])]
        got = interpolated(p[["row", "col"]].to_numpy(np.int64), p["z"].to_numpy(float), g[["row", "col"]].to_numpy(np.int64), seen, raster)
        return g[[*by, "row", "col", "raster"]].assign(tin=got)

    return both.groupBy(*by, "_tr", "_tc").applyInPandas(run, f"{kinds}, row int, col int, raster array<int>, tin double")


def triangulated(points: DataFrame, gaps: DataFrame, by: Sequence[str], tile: int = TILE, halo: int = HALO) -> DataFrame:
    """Gaps (by, row, col, raster) inside the hull of points (by, row, col, z) with their height `tin` in the points' triangulation; `raster` is the raster's
    (first row, first column, last row, last column). Null where points on one line leave no triangle."""
    size = gaps.agg(F.max(F.greatest(F.col("raster")[2] - F.col("raster")[0], F.col("raster")[3] - F.col("raster")[1]))).first()[0]
    if size is None:
        return gaps.withColumn("tin", F.lit(None).cast("double"))
    done, todo = None, gaps
    while True:
        got = cut(_round(points, todo, by, tile, halo))
        if halo >= size:
            return got if done is None else done.unionAll(got)
        found, todo = got.where("tin is not null"), got.where("tin is null").drop("tin")
        done = found if done is None else done.unionAll(found)
        if todo.isEmpty():
            return done
        halo *= 2


def interpolate_dtm(cells: DataFrame, by: Sequence[str], value: str = "z", readmit_m: float = 0.5, passes: int = PASSES, tile: int = TILE, halo: int = HALO) -> DataFrame:
    """The cells of dense grids (with is_ground) with dtm and is_final_ground.

    Ground keeps its height; gaps inside the hull of the ground lie on a triangulation of the ground beside gaps and at the raster's border, those outside take the
    nearest ground. Each pass takes valid cells within readmit_m of the terrain back as ground; passes end when none takes any. Neither the tiles nor the halo change a
    result. A grid without ground has no terrain: null. Groups are tiles with their halo, and lines.
    """
    by, at = list(by), [*by, "row", "col"]
    edges = cells.groupBy(*by).agg(F.array(*(F.expr(f"cast({f}({c}) as int)") for f, c in (("min", "row"), ("min", "col"), ("max", "row"), ("max", "col")))).alias("raster")).withColumnRenamed("raster", "_raster")
    valid = F.col(value).isNotNull() & ~F.isnan(value)
    # the caller's other columns go by names of their own meanwhile
    own = {c: f"_own{i}" for i, c in enumerate(cells.columns) if c not in (*at, value)}
    base = cells.join(edges, by).select(*(F.col(c).alias(own.get(c, c)) for c in cells.columns), F.col("_raster").alias("raster"), (F.coalesce(F.col("is_ground"), F.lit(False)) & valid).alias("_g"))
    for k in range(passes + 1):
        base = cut(base)
        lone = erosion(base.withColumn("_e", F.col("_g").cast("int")), by, "_e", 3)  # 1 where all around is ground
        border = (F.col("row") == F.col("raster")[0]) | (F.col("col") == F.col("raster")[1]) | (F.col("row") == F.col("raster")[2]) | (F.col("col") == F.col("raster")[3])
        points = cut(lone.where(F.col("_g") & (border | (F.col("_e") == 0))).select(*by, F.col("row").cast("int"), F.col("col").cast("int"), F.col(value).cast("double").alias("z")))
        gaps = base.where(~F.col("_g")).select(*by, F.col("row").cast("int"), F.col("col").cast("int"), "raster")
        inside = gaps.join(inside_hull(points, by, tile), [*by, "row"]).where(F.col("col").between(F.col("_c0"), F.col("_c1"))).drop("_c0", "_c1")
        tin = triangulated(points, cut(inside), by, tile, halo)
        filled = base.join(tin.select(*at, "tin"), at, "left").withColumn("_h", F.when(F.col("_g"), F.col(value).cast("double")).otherwise(F.col("tin"))).drop("tin")
        filled = cut(filled)
        if not filled.where("_h is null").isEmpty():  # outside of the hull
            ground = filled.withColumn("_v", F.when(F.col("_g"), F.col(value).cast("double")))
            filled = cut(nearest_fill(ground, by, "_v").withColumn("_h", F.coalesce("_h", "filled")).drop("_v", "filled"))
        again = ~F.col("_g") & valid & F.coalesce(F.abs(F.col(value) - F.col("_h")) <= readmit_m, F.lit(False))
        if k == passes or filled.where(again).isEmpty():
            return filled.select(*(F.col(own.get(c, c)).alias(c) for c in cells.columns), F.col("_h").alias("dtm"), F.col("_g").alias("is_final_ground"))
        base = filled.withColumn("_g", F.col("_g") | again).drop("_h")
    raise AssertionError
