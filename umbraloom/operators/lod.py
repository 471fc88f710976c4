"""Level of detail: quadtree nodes, neighbours, selection, mesh rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbraloom.functions.values import not_finite
from umbraloom.operators.lineage import cut
from umbraloom.operators.morphology import block_sums, summed_area


def quadtree_nodes(cells: DataFrame, by: Sequence[str], value: str, depth: int, leaf: int) -> DataFrame:
    """(by, level, nr, nc, n, n_valid, low, high) for levels 0 (all) to depth, of leaf * 2^(depth - level) cells a side.

    Leaves are aggregated from cells once; each coarser level from the four below it, so cells are read once.
    """
    ok = F.when(~not_finite(value), F.col(value))
    level = cells.groupBy(*by, F.floor(F.col("row") / leaf).cast("int").alias("nr"), F.floor(F.col("col") / leaf).cast("int").alias("nc")).agg(F.count("*").alias("n"), F.count(ok).alias("n_valid"), F.min(ok).alias("low"), F.max(ok).alias("high"))
    # a node belongs to one ancestor on each level: dealt out once, then one aggregation for all levels
    up = level.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    by_level = up.withColumns({c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.lit(depth) - F.col("level"))).cast("int") for c in ("nr", "nc")})
    return by_level.groupBy(*by, "level", "nr", "nc").agg(F.sum("n").alias("n"), F.sum("n_valid").alias("n_valid"), F.min("low").alias("low"), F.max("high").alias("high"))


def node_boxes(nodes: DataFrame, depth: int, leaf: int) -> DataFrame:
    side = (F.lit(leaf) * F.pow(F.lit(2.0), F.lit(depth) - F.col("level"))).cast("int")
    return nodes.select("*", (F.col("nr") * side).alias("r0"), (F.col("nc") * side).alias("c0"), ((F.col("nr") + 1) * side).alias("r1"), ((F.col("nc") + 1) * side).alias("c1"))


def shared_edges(boxes: DataFrame, by: Sequence[str], key: str = "node_id") -> DataFrame:
    """Pairs of boxes (r0, c0, r1, c1) that meet in an edge of some length, each once: (a, b, axis, start, stop).

    Boxes meet where one's end is the other's start, so the join is on equal coordinates, and only overlaps are tested inside.
    """
    out = None
    for axis, (lo, hi, s0, s1) in {"col": ("c0", "c1", "r0", "r1"), "row": ("r0", "r1", "c0", "c1")}.items():
        x = boxes.select(*by, F.col(key).alias("a"), F.col(hi).alias("at"), F.col(s0).alias("_a0"), F.col(s1).alias("_a1"))
        y = boxes.select(*by, F.col(key).alias("b"), F.col(lo).alias("at"), F.col(s0).alias("_b0"), F.col(s1).alias("_b1"))
        start, stop = F.greatest("_a0", "_b0"), F.least("_a1", "_b1")
        got = x.join(y, [*by, "at"]).where(start < stop).select(*by, "a", "b", F.lit(axis).alias("axis"), start.alias("start"), stop.alias("stop"))
        out = got if out is None else out.unionAll(got)
    return out


def selected_nodes(nodes: DataFrame, camera: tuple[float, float, float], depth: int, leaf: int, factor: float = 1.5) -> DataFrame:
    """Nodes to draw for a camera (row, col, height above the terrain, in cells): those whose parent is split and that are not.

    A node is split while the camera is nearer to its box than factor times its side, and there is a finer level. Distances
    of nested boxes only grow, so a node's ancestors are all split if its parent is: no recursion is needed.
    """
    row, c, up = camera
    side = (F.lit(leaf) * F.pow(F.lit(2.0), F.lit(depth) - F.col("level"))).cast("double")

    def far(nr, nc, s):
        dr = F.greatest(nr * s - row, F.lit(row) - (nr + 1) * s, F.lit(0.0))
        dc = F.greatest(nc * s - c, F.lit(c) - (nc + 1) * s, F.lit(0.0))
        return F.sqrt(dr * dr + dc * dc + F.lit(up * up))

    split = (F.col("level") < depth) & (far(F.col("nr"), F.col("nc"), side) < factor * side)
    parent = far(F.floor(F.col("nr") / 2), F.floor(F.col("nc") / 2), 2 * side) < factor * 2 * side
    return nodes.where(~split & ((F.col("level") == 0) | parent))


def triangles(cells: DataFrame, by: Sequence[str], value: str = "z", stride: int = 1) -> DataFrame:
    """(by, row, col, half, z0, z1, z2): two triangles for each square of valid neighbours; squares that touch nodata are left out.

    Each cell is sent to the four squares that it is a corner of: one aggregation instead of a self-join.
    """
    at = cells.where((F.col("row") % stride == 0) & (F.col("col") % stride == 0) & ~not_finite(value))
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    sq = at.withColumn("_k", corner).select(*by, (F.col("row") - F.col("_k.i") * stride).alias("row"), (F.col("col") - F.col("_k.j") * stride).alias("col"), (F.col("_k.i") * 2 + F.col("_k.j")).alias("_n"), value)
    z = [F.max(F.when(F.col("_n") == k, F.col(value))).alias(f"_z{k}") for k in range(4)]
    full = sq.groupBy(*by, "row", "col").agg(F.count("*").alias("_c"), *z).where("_c = 4")
    half = F.explode(F.array(*(F.struct(F.lit(h).alias("half"), *(F.col(f"_z{k}").alias(f"z{i}") for i, k in enumerate(ks))) for h, ks in enumerate(((0, 2, 1), (1, 2, 3))))))
    return full.withColumn("_t", half).select(*by, "row", "col", "_t.half", "_t.z0", "_t.z1", "_t.z2")


def valid_stats(cells: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    ok = F.when(~not_finite(value), F.col(value))
    return cells.groupBy(*by).agg(F.count(ok).alias("n_valid"), F.min(ok).alias("low"), F.max(ok).alias("high"))


def balanced(selected: DataFrame, nodes: DataFrame, depth: int, leaf: int) -> DataFrame:
    """Selected nodes (level, nr, nc), split until neighbours differ by one level at most; sorted order is (level, nr, nc).

    Each round splits all nodes that touch one two levels finer; depth rounds are enough, as each adds a level at most,
    and a round that splits nothing is the last.
    """
    at = ["level", "nr", "nc"]
    selected, nodes = cut(selected.select(*at)), cut(nodes.select(*at))
    for _ in range(depth):
        boxes = node_boxes(selected.select(*at), depth, leaf).withColumn("node_id", F.concat_ws(":", *at)).withColumn("page", F.lit(0))
        pairs = shared_edges(boxes, ["page"])
        level = boxes.select("node_id", "level")
        met = pairs.join(level.select(F.col("node_id").alias("a"), F.col("level").alias("la")), "a").join(level.select(F.col("node_id").alias("b"), F.col("level").alias("lb")), "b")
        coarse = cut(met.where("lb - la >= 2").select(F.col("a").alias("node_id")).unionAll(met.where("la - lb >= 2").select(F.col("b").alias("node_id"))).distinct())
        if coarse.isEmpty():
            break
        split = boxes.join(coarse, "node_id", "left_semi").select(*at)
        four = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
        children = split.withColumn("_k", four).select((F.col("level") + 1).alias("level"), (F.col("nr") * 2 + F.col("_k.i")).alias("nr"), (F.col("nc") * 2 + F.col("_k.j")).alias("nc"))
        selected = cut(selected.select(*at).join(split, at, "left_anti").unionAll(children.join(nodes.select(*at), at, "left_semi")))
    return selected.select(*at)


def stitched_triangles(boxes: DataFrame, cells: DataFrame, by: Sequence[str], value: str = "z", key: str = "node_id") -> DataFrame:
    """(by, key, p, q, s) triangles of tiles that meet coarser ones without cracks; p, q and s are struct(row, col), counter-clockwise seen from above.

    boxes: (by, key, r0, c0, r1, c1, stride, top, bottom, left, right), ends inclusive, the last four the strides of the neighbours
    there. A corner on an edge that the neighbour does not sample moves back to one that it does; triangles that collapse go, as do
    those whose bounding block holds a cell without a value (at stride 1 and unmoved, those with such a corner). Neighbours should
    be one level apart, as `balanced` leaves them: further apart, a triangle may fold over where two coarser tiles meet.
    """
    ends = lambda a, b: F.concat(F.when(F.col(b) > F.col(a), F.sequence(F.col(a), F.col(b) - 1, F.col("stride"))).otherwise(F.array().cast("array<int>")), F.array(F.col(b)))
    lines = boxes.withColumns({"_rs": ends("r0", "r1"), "_cs": ends("c0", "c1")})
    steps = lambda xs: F.explode(F.zip_with(F.slice(xs, F.lit(1), F.size(xs) - 1), F.slice(xs, F.lit(2), F.size(xs) - 1), lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))))
    squares = lines.where((F.col("r1") > F.col("r0")) & (F.col("c1") > F.col("c0"))).withColumn("_r", steps(F.col("_rs"))).withColumn("_c", steps(F.col("_cs")))

    def along(v: Column, step: str, end: str) -> Column:
        return F.when(v == F.col(end), v).otherwise(v - v % F.col(step))

    def corner(r: Column, c: Column) -> Column:
        col = F.when((r == F.col("r0")) & (F.col("top") > F.col("stride")), along(c, "top", "c1")).when((r != F.col("r0")) & (r == F.col("r1")) & (F.col("bottom") > F.col("stride")), along(c, "bottom", "c1")).otherwise(c)
        # a corner that has moved along a row edge may by that have come to a column edge
        row = F.when((col == F.col("c0")) & (F.col("left") > F.col("stride")), along(r, "left", "r1")).when((col != F.col("c0")) & (col == F.col("c1")) & (F.col("right") > F.col("stride")), along(r, "right", "r1")).otherwise(r)
        return F.struct(row.alias("row"), col.alias("col"))

    at = {f"_{r}{c}": corner(F.col(f"_r.{r}"), F.col(f"_c.{c}")) for r in ("lo", "hi") for c in ("lo", "hi")}
    names = {f"_{r}{c}": F.struct(F.col(f"_r.{r}").alias("row"), F.col(f"_c.{c}").alias("col")) for r in ("lo", "hi") for c in ("lo", "hi")}
    moved = F.lit(False)
    for k, where in names.items():
        moved = moved | (F.col(k) != where)
    tri = lambda a, b, c: F.struct(F.col(a).alias("p"), F.col(b).alias("q"), F.col(c).alias("s"))
    both = F.explode(F.array(tri("_lolo", "_hilo", "_lohi"), tri("_lohi", "_hilo", "_hihi")))
    got = squares.withColumns(at).withColumn("_exact", (F.col("stride") == 1) & ~moved).withColumn("_t", both).select(*by, key, "_exact", "_t.p", "_t.q", "_t.s")
    pqs = ("p", "q", "s")
    got = got.where("p != q and q != s and p != s")
    box = {f"{n}{i}": f(*(F.col(f"{k}.{n}") for k in pqs)) for n in ("row", "col") for i, f in ((0, F.least), (1, F.greatest))}
    got = got.withColumns(box).withColumnsRenamed({"row0": "r0", "row1": "r1", "col0": "c0", "col1": "c1"})
    judged = block_sums(got, summed_area(cells, by, not_finite(value).cast("int")), by)
    # an exact triangle does not touch the fourth corner of its square, so that may be without a value
    fourth = {f"_{n}": 2 * (F.col(f"{a}0") + F.col(f"{a}1")) - F.col(f"p.{n}") - F.col(f"q.{n}") - F.col(f"s.{n}") for n, a in (("row", "r"), ("col", "c"))}
    bad = cells.where(not_finite(value)).select(*by, F.col("row").alias("_row"), F.col("col").alias("_col"), F.lit(1).alias("_bad"))
    judged = judged.withColumns(fourth).join(bad, [*by, "_row", "_col"], "left")
    spared = F.when(F.col("_exact"), F.coalesce("_bad", F.lit(0))).otherwise(0)
    return judged.where(F.col("inside") == spared).select(*by, key, *pqs)
