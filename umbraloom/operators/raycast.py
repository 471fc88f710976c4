"""Where rays meet a height field: a walk down a quadtree of least and greatest heights, then the triangles of the leaves that are left.

Coordinates are those of the grid: x along columns, y along rows, z the height; a cell's height stands at its whole row and column, and each square of four
valid cells has the two triangles of the mesh. Rays are a table; each level is a join on node numbers and drops the nodes whose box a ray misses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbraloom.operators.lod import triangles

#: By how much boxes are larger than what they hold, so that a ray along a border is in both.
SLACK = 1e-9


def square_nodes(mesh: DataFrame, by: Sequence[str], depth: int, leaf: int) -> DataFrame:
    """(by, level, nr, nc, low, high) of the squares of a mesh for levels 0 (all) to depth, of leaf * 2^(depth - level) squares a side."""
    z = [F.col(f"z{k}") for k in range(3)]
    at = {n: F.floor(F.col(c) / leaf).cast("int") for n, c in (("nr", "row"), ("nc", "col"))}
    leaves = mesh.groupBy(*by, *(e.alias(n) for n, e in at.items())).agg(F.min(F.least(*z)).alias("low"), F.max(F.greatest(*z)).alias("high"))
    up = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    higher = up.withColumns({n: F.expr(f"shiftright({n}, {depth} - level)") for n in ("nr", "nc")})
    return higher.groupBy(*by, "level", "nr", "nc").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _meets_box(lo: Sequence[Column], hi: Sequence[Column]) -> Column:
    """Whether a ray meets a box: the stretches of the ray between each pair of faces have a part in common that is not behind it."""
    enters, leaves, inside = [F.lit(0.0)], [F.lit(float("inf"))], F.lit(True)
    for axis, a, b in zip("xyz", lo, hi, strict=True):
        o, d = F.col(f"o{axis}"), F.col(f"d{axis}")
        s, t = F.try_divide(a - SLACK - o, d), F.try_divide(b + SLACK - o, d)
        enters.append(F.coalesce(F.least(s, t), F.lit(0.0)))
        leaves.append(F.coalesce(F.greatest(s, t), F.lit(float("inf"))))
        inside = inside & ((d != 0) | ((o >= a - SLACK) & (o <= b + SLACK)))
    return inside & (F.greatest(*enters) <= F.least(*leaves))


def _hit() -> Column:
    """The distance along a ray, in lengths of its direction, to the triangle of the row; null if it misses. Both sides count."""
    one = F.lit(1.0)
    corner = {0: (F.col("col"), F.col("row")), 1: (F.col("col") + 1, F.col("row")), 2: (F.col("col"), F.col("row") + 1), 3: (F.col("col") + 1, F.col("row") + 1)}
    pick = lambda a, b: F.when(F.col("half") == 0, a).otherwise(b)
    first, second = (0, 2, 1), (1, 2, 3)
    p = [tuple(pick(corner[first[i]][k], corner[second[i]][k]).cast("double") for k in (0, 1)) + (F.col(f"z{i}"),) for i in range(3)]
    o, d = [F.col(f"o{a}") for a in "xyz"], [F.col(f"d{a}") for a in "xyz"]
    minus = lambda a, b: [x - y for x, y in zip(a, b, strict=True)]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    e1, e2, s = minus(p[1], p[0]), minus(p[2], p[0]), minus(o, p[0])
    h, q = cross(d, e2), cross(s, e1)
    det = dot(e1, h)
    u, v, t = (F.try_divide(x, det) for x in (dot(s, h), dot(d, q), dot(e2, q)))
    return F.when((u >= -SLACK) & (v >= -SLACK) & (u + v <= one + 2 * SLACK) & (t >= 0), t)


def raycast(rays: DataFrame, cells: DataFrame, by: Sequence[str], value: str = "z", depth: int = 8, leaf: int = 4, key: str = "ray_id") -> DataFrame:
    """Rays (by, ray_id, ox, oy, oz, dx, dy, dz) with their first hit: (t, x, y, z, row, col, half), ties by row, column and half; nulls where a ray meets nothing, has no
    direction or a null in it. leaf * 2^depth squares have to cover each grid. Cells that are null or not finite have no triangles; an empty table of rays gives no rows."""
    by, own = list(by), [f"{a}{b}" for a in "od" for b in "xyz"]
    mesh = triangles(cells, by, value)
    nodes = square_nodes(mesh, by, depth, leaf)
    at = rays.select(*by, key, *(F.col(c).cast("double").alias(c) for c in own), F.lit(0).alias("nr"), F.lit(0).alias("nc")).where("dx != 0 or dy != 0 or dz != 0")
    for level in range(depth + 1):
        side = leaf << (depth - level)
        met = at.join(nodes.where(F.col("level") == level).drop("level"), [*by, "nr", "nc"])
        box = _meets_box([F.col("nc") * side, F.col("nr") * side, F.col("low")], [(F.col("nc") + 1) * side, (F.col("nr") + 1) * side, F.col("high")])
        at = met.where(box).drop("low", "high")
        if level < depth:
            four = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
            at = at.withColumn("_k", four).withColumns({"nr": F.col("nr") * 2 + F.col("_k.i"), "nc": F.col("nc") * 2 + F.col("_k.j")}).drop("_k")
    leaves = mesh.withColumns({"nr": F.floor(F.col("row") / leaf).cast("int"), "nc": F.floor(F.col("col") / leaf).cast("int")})
    hit = at.join(leaves, [*by, "nr", "nc"]).withColumn("t", _hit()).where("t is not null")
    first = hit.groupBy(*by, key).agg(F.min(F.struct("t", "row", "col", "half")).alias("_h"))
    out = rays.join(first, [*by, key], "left")
    t = F.col("_h.t")
    return out.select(*rays.columns, t.alias("t"), *((F.col(f"o{a}") + t * F.col(f"d{a}")).alias(a) for a in "xyz"), F.col("_h.row").alias("row"), F.col("_h.col").alias("col"), F.col("_h.half").alias("half"))
