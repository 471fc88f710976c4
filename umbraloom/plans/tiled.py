"""The part of the query catalogue on rasters that are cut into tiles, read by windows, carried over to other grids, and dealt to epochs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraloom.functions.geometry import WGS84_A, WGS84_E2
from umbraloom.operators import components, epochs, lineage, morphology, surfaces, warp
from umbraloom.plans.catalogue import CELLS, QUERIES, SQL, cells, query, read, rounded

#: Two scenes of 96 x 96 pixels.
SCENES = "cells2 AS (SELECT 's' || (o_orderkey % 2) AS scene_id, (o_custkey % 96)::INT AS row, (o_orderkey // 2 % 96)::INT AS col, max(o_totalprice) AS z FROM orders GROUP BY 1, 2, 3)"
TILE = 32


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    keys = F.concat(F.lit("s"), (k % 2).cast("string")).alias("scene_id"), (F.col("o_custkey") % 96).cast("int").alias("row"), F.expr("cast(o_orderkey div 2 % 96 as int)").alias("col")
    return read(spark, sf_dir, "orders").groupBy(*keys).agg(F.max("o_totalprice").alias("z"))


@query("components_across_tiles", f"""WITH RECURSIVE {SCENES}, f AS (SELECT scene_id, row, col, row * 1000 + col AS id FROM cells2 WHERE z > 230000), e AS (SELECT f.scene_id, f.id, g.id AS nb FROM f, range(-1, 2) a(dr), range(-1, 2) b(dc) JOIN f g ON g.scene_id = f.scene_id AND g.row = f.row + dr AND g.col = f.col + dc WHERE g.id <> f.id),
    l AS (SELECT scene_id, id, id AS root FROM f UNION SELECT l.scene_id, e.nb, l.root FROM l JOIN e ON e.scene_id = l.scene_id AND e.id = l.id), m AS (SELECT scene_id, id, min(root) AS root FROM l GROUP BY 1, 2),
    n AS (SELECT scene_id, root, row_number() OVER (PARTITION BY scene_id ORDER BY root) AS k FROM (SELECT DISTINCT scene_id, root FROM m)) SELECT scene_id, scene_id || ':b' || lpad(k::VARCHAR, 4, '0') AS building_id, (id // 1000)::INT AS row, (id % 1000)::INT AS col FROM m JOIN n USING (scene_id, root)""")
def components_across_tiles(spark, sf_dir):
    """Components of eight neighbours in scenes of nine tiles."""
    c = scenes(spark, sf_dir).select("scene_id", "row", "col", F.when(F.col("z") > 230000, 6).otherwise(2).alias("cls"))
    return components.tiled_footprints(c, TILE, connectivity=8)


@query("nearest_fill_scenes", f"""WITH {SCENES}, d AS (SELECT s.scene_id, r.row::INT AS row, c.col::INT AS col, z FROM (SELECT DISTINCT scene_id FROM cells2) s CROSS JOIN range(96) r(row) CROSS JOIN range(96) c(col) LEFT JOIN cells2 ON cells2.scene_id = s.scene_id AND cells2.row = r.row AND cells2.col = c.col AND z > 150000),
    n AS (SELECT d.scene_id, d.row, d.col, arg_min(v.z, ((d.row - v.row) * (d.row - v.row) + (d.col - v.col) * (d.col - v.col))::BIGINT * 100000000 + v.row * 1000 + v.col) AS z FROM d JOIN d v ON v.scene_id = d.scene_id AND v.z IS NOT NULL WHERE d.z IS NULL GROUP BY 1, 2, 3)
    SELECT scene_id, row, col, z AS filled FROM d WHERE z IS NOT NULL UNION ALL SELECT * FROM n""")
def nearest_fill_scenes(spark, sf_dir):
    """Two scenes at once; no task holds one."""
    c = scenes(spark, sf_dir)
    grid = morphology.densify(c.withColumn("z", F.when(F.col("z") > 150000, F.col("z"))), ["scene_id"], 96, 96)
    return morphology.nearest_fill(grid, ["scene_id"]).select("scene_id", "row", "col", "filled")


@query("terrain_across_tiles")
def terrain_across_tiles(spark, sf_dir):
    """Terrain of scenes of nine tiles; the tests hold it against the same without tiles."""
    c = morphology.densify(scenes(spark, sf_dir), ["scene_id"], 96, 96)
    ground = c.withColumn("is_ground", F.coalesce(F.col("z") < 120000, F.lit(False)))
    return rounded(surfaces.interpolate_dtm(ground, ["scene_id"], readmit_m=500.0, tile=TILE, halo=8).select("scene_id", "row", "col", "dtm", "is_final_ground"))


# files ------------------------------------------------------------------------------------------------------------------


def scene_files(spark: SparkSession, sf_dir: str, factor: int = 1) -> str:
    """A folder with a GeoTIFF of whole hundreds for each scene; factor: every so many lines and columns only."""
    from umbraloom.sources import sinks

    folder = f"{lineage.shared_folder(spark)}/scenes-{uuid.uuid4().hex}"
    c = scenes(spark, sf_dir).where((F.col("row") % factor == 0) & (F.col("col") % factor == 0))
    corner = spark.createDataFrame([(f"s{k}", 96 // factor - 1, 96 // factor - 1, None) for k in (0, 1)], "scene_id string, row int, col int, z double")  # the size does not depend on the rows
    small = c.select("scene_id", F.expr(f"cast(row div {factor} as int)").alias("row"), F.expr(f"cast(col div {factor} as int)").alias("col"), F.floor(F.col("z") / 100).cast("double").alias("z"))
    px = small.unionAll(corner).groupBy("scene_id", "row", "col").agg(F.max("z").alias("z"))
    sinks.save_files(sinks.raster_files(px, ["scene_id"], "z", (0.5 * factor, 0.0, 10.0, 0.0, -0.5 * factor, 20.0), 32643, {"PRODUCT": "dsm"}), folder)
    return folder


@query("raster_headers", f"WITH {SCENES} SELECT scene_id || '-z.tif' AS name, 96 AS width, 96 AS height, 1 AS bands, 'EPSG:32643' AS crs, 0.5::DOUBLE AS gsd, 'dsm' AS product, 1::BIGINT AS blocks, true AS small FROM cells2 GROUP BY scene_id")
def raster_headers(spark, sf_dir):
    """Headers by the data source, which reads no pixel for them."""
    from umbraloom.sources.raster_source import scan_headers

    h = scan_headers(spark, scene_files(spark, sf_dir))
    return h.select(F.substring_index("path", "/", -1).alias("name"), "width", "height", "bands", "crs", F.col("transform")[0].alias("gsd"), F.col("tags")["PRODUCT"].alias("product"), "blocks", (F.col("bytes_read") < 10_000).alias("small"))


@query("raster_window", f"WITH {SCENES} SELECT row, col, floor(z / 100)::DOUBLE AS value FROM cells2 WHERE scene_id = 's1' AND row BETWEEN 10 AND 59 AND col BETWEEN 20 AND 59")
def raster_window(spark, sf_dir):
    """A window of one band of one file, which the source prunes by its conditions."""
    from umbraloom.sources import rasters
    from umbraloom.sources.raster_source import scan_blocks

    b = scan_blocks(spark, scene_files(spark, sf_dir), window=(10, 20, 50, 40)).where("band = 1").where(F.col("path").endswith("s1-z.tif"))
    return rasters.pixels(b).where("value is not null").select("row", "col", "value")


@query("pair_windows", f"""WITH {SCENES}, w AS (SELECT s_suppkey, 's' || (s_suppkey % 2) AS scene_id, (s_suppkey * 7 % 100 - 6)::INT AS row_off, (s_suppkey * 11 % 100 - 6)::INT AS col_off FROM supplier), p AS (SELECT w.*, row_off + i AS r, col_off + j AS c FROM w, range(8) a(i), range(8) b(j)),
    q AS (SELECT p.s_suppkey, coalesce(floor(x.z / 100), 0) AS v, CASE WHEN r BETWEEN 0 AND 95 AND c BETWEEN 0 AND 95 AND floor(y.z / 100) <= 3000 THEN floor(y.z / 100) END AS h FROM p LEFT JOIN cells2 x ON x.scene_id = p.scene_id AND x.row = r AND x.col = c LEFT JOIN cells2 y ON y.scene_id = p.scene_id AND y.row = floor((r + 0.5) / 2) * 2 AND y.col = floor((c + 0.5) / 2) * 2)
    SELECT s_suppkey, sum(v)::DOUBLE AS image_sum, count(h) AS valid, coalesce(sum(h), 0)::DOUBLE AS height_sum FROM q GROUP BY s_suppkey""")
def pair_windows(spark, sf_dir):
    """Windows, some of which reach over the border, of images and of heights with half as many lines."""
    from umbraloom.sources.pair_windows import pair_tiles

    image, height, k = scene_files(spark, sf_dir), scene_files(spark, sf_dir, 2), F.col("s_suppkey")
    name = F.concat(F.lit("/s"), (k % 2).cast("string"), F.lit("-z.tif"))
    w = read(spark, sf_dir, "supplier").select(k.cast("string").alias("stem"), F.concat(F.lit(image), name).alias("image_path"), F.concat(F.lit(height), name).alias("height_path"), (k * 7 % 100 - 6).cast("int").alias("row_off"), (k * 11 % 100 - 6).cast("int").alias("col_off"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return pair_tiles(w, 8, max_height=3000.0).select(F.col("stem").cast("long").alias("s_suppkey"), (total("image") / 3).alias("image_sum"), F.size(F.filter("valid", lambda v: v)).cast("long").alias("valid"), total("height_m").alias("height_sum"))


# epochs -----------------------------------------------------------------------------------------------------------------

SEED, EPOCHS, WORKERS, BATCH = 17, (0, 1), 3, 4


def _epoch_sql() -> str:
    keys = ", ".join(f"({e}, {r}, {k}, {a}, {b})" for e in EPOCHS for r, (k, a, b) in enumerate(epochs.round_keys(SEED, e)))
    return f"""WITH RECURSIVE keys(epoch, r, k, a, b) AS (VALUES {keys}), n AS (SELECT count(*) AS n FROM part), s AS (SELECT epoch, range AS place, range AS x, 0 AS r FROM range((SELECT n FROM n)), (SELECT DISTINCT epoch FROM keys)
        UNION ALL SELECT s.epoch, place, CASE WHEN (greatest(x, (k % n + n - x) % n) * a::BIGINT + b) % {epochs.PRIME} % 2 = 1 THEN (k % n + n - x) % n ELSE x END, s.r + 1 FROM s JOIN keys ON keys.epoch = s.epoch AND keys.r = s.r, n)
        SELECT epoch, (place % {WORKERS})::INT AS worker, place // {WORKERS} // {BATCH} AS step, place, p_partkey, p_size FROM s JOIN part ON p_partkey = x + 1 WHERE r = {epochs.ROUNDS}"""


@query("epoch_order", _epoch_sql())
def epoch_order(spark, sf_dir):
    """The samples of all steps of two epochs for three workers, each worker's on its own."""
    part = read(spark, sf_dir, "part")
    n, out = part.count(), None
    for e in EPOCHS:
        for w in range(WORKERS):
            own = epochs.epoch(spark, n, SEED, e, WORKERS, w, BATCH).select(F.lit(e).alias("epoch"), F.lit(w).alias("worker"), "step", "place", (F.col("sample") + 1).alias("p_partkey"))
            out = own if out is None else out.unionAll(own)
    return out.join(part.select("p_partkey", "p_size"), "p_partkey")


# warps ------------------------------------------------------------------------------------------------------------------

#: A source of 64 x 64 pixels in the eastern zone, and a turned grid of 60 x 60 in the western one that reaches over its border.
SOURCE_GRID, SOURCE_CRS = (30.0, 0.0, 200000.0, 0.0, -30.0, 3000000.0), "EPSG:32644"
TARGET_GRID, TARGET_CRS, SIDE = (31.0, 2.0, 795000.0, 1.5, -31.0, 2999900.0), "EPSG:32643", 60


def warp_sql(kernel: str) -> str:
    """Both zones' series and the kernel's sums as steps of a query."""
    e2, k0 = WGS84_E2, 0.9996
    ep2, e1 = e2 / (1 - e2), (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    a, b, c, d, e, f = TARGET_GRID
    sa, _, sc, _, se, sf = SOURCE_GRID
    taps = {"nearest": (0, 1), "bilinear": (0, 2), "cubic": (-1, 3)}[kernel]
    shift = 0.0 if kernel == "nearest" else 0.5
    away = lambda x: {"nearest": "1.0", "bilinear": f"(1 - abs({x}))", "cubic": f"(CASE WHEN abs({x}) <= 1 THEN 1.5 * abs({x}) ** 3 - 2.5 * abs({x}) ** 2 + 1 WHEN abs({x}) < 2 THEN -0.5 * abs({x}) ** 3 + 2.5 * abs({x}) ** 2 - 4 * abs({x}) + 2 ELSE 0 END)"}[kernel]
    return f"""WITH {CELLS}, t0 AS (SELECT r.row::INT AS row, q.col::INT AS col, {a} * (q.col + 0.5) + {b} * (r.row + 0.5) + {c} AS x, {d} * (q.col + 0.5) + {e} * (r.row + 0.5) + {f} AS y FROM range({SIDE}) r(row), range({SIDE}) q(col)),
        t1 AS (SELECT *, y / {k0} / ({WGS84_A} * (1 - {e2} / 4 - 3 * {e2} ** 2 / 64 - 5 * {e2} ** 3 / 256)) AS mu FROM t0),
        t2 AS (SELECT *, mu + (3 * {e1} / 2 - 27 * {e1} ** 3 / 32) * sin(2 * mu) + (21 * {e1} ** 2 / 16 - 55 * {e1} ** 4 / 32) * sin(4 * mu) + 151 * {e1} ** 3 / 96 * sin(6 * mu) + 1097 * {e1} ** 4 / 512 * sin(8 * mu) AS phi FROM t1),
        t3 AS (SELECT *, tan(phi) ** 2 AS tt, {ep2} * cos(phi) ** 2 AS cc, {WGS84_A} / sqrt(1 - {e2} * sin(phi) ** 2) AS n, {WGS84_A} * (1 - {e2}) / (1 - {e2} * sin(phi) ** 2) ** 1.5 AS r FROM t2),
        t4 AS (SELECT *, (x - 500000.0) / (n * {k0}) AS d FROM t3),
        t5 AS (SELECT row, col, phi - n * tan(phi) / r * (d ** 2 / 2 - (5 + 3 * tt + 10 * cc - 4 * cc ** 2 - 9 * {ep2}) * d ** 4 / 24 + (61 + 90 * tt + 298 * cc + 45 * tt ** 2 - 252 * {ep2} - 3 * cc ** 2) * d ** 6 / 720) AS lat,
            (d - (1 + 2 * tt + cc) * d ** 3 / 6 + (5 - 2 * cc + 28 * tt - 3 * cc ** 2 + 8 * {ep2} + 24 * tt ** 2) * d ** 5 / 120) / cos(phi) + radians(75.0 - 81.0) AS lam FROM t4),
        t6 AS (SELECT row, col, lat, tan(lat) ** 2 AS tt, {ep2} * cos(lat) ** 2 AS cc, {WGS84_A} / sqrt(1 - {e2} * sin(lat) ** 2) AS n, lam * cos(lat) AS aa FROM t5),
        t7 AS (SELECT row, col, {k0} * n * (aa + (1 - tt + cc) * aa ** 3 / 6 + (5 - 18 * tt + tt ** 2 + 72 * cc - 58 * {ep2}) * aa ** 5 / 120) + 500000.0 AS x,
            {k0} * ({WGS84_A} * ((1 - {e2} / 4 - 3 * {e2} ** 2 / 64 - 5 * {e2} ** 3 / 256) * lat - (3 * {e2} / 8 + 3 * {e2} ** 2 / 32 + 45 * {e2} ** 3 / 1024) * sin(2 * lat) + (15 * {e2} ** 2 / 256 + 45 * {e2} ** 3 / 1024) * sin(4 * lat) - 35 * {e2} ** 3 / 3072 * sin(6 * lat))
                + n * tan(lat) * (aa ** 2 / 2 + (5 - tt + 9 * cc + 4 * cc ** 2) * aa ** 4 / 24 + (61 - 58 * tt + tt ** 2 + 600 * cc - 330 * {ep2}) * aa ** 6 / 720)) AS y FROM t6),
        t8 AS (SELECT row, col, (x - {sc}) / {sa} AS sc, (y - {sf}) / {se} AS sr FROM t7),
        t9 AS (SELECT row, col, sr, sc, floor(sr - {shift})::INT AS r0, floor(sc - {shift})::INT AS c0 FROM t8 WHERE sr >= 0 AND sr < 64 AND sc >= 0 AND sc < 64),
        k AS (SELECT t9.row, t9.col, r0 + i AS r, c0 + j AS c, {away(f'(sr - {shift} - r0 - i)')} * {away(f'(sc - {shift} - c0 - j)')} AS w FROM t9, range({taps[0]}, {taps[1]}) p(i), range({taps[0]}, {taps[1]}) q(j)),
        s AS (SELECT k.row, k.col, count(*) FILTER (cells.z IS NULL) AS gone, sum(w * cells.z) / sum(w) AS v FROM k LEFT JOIN cells ON cells.row = r AND cells.col = c WHERE w <> 0 AND r BETWEEN 0 AND 63 AND c BETWEEN 0 AND 63 GROUP BY 1, 2)
        SELECT t0.row, t0.col, {'CASE WHEN gone = 0 THEN v END' if kernel == 'nearest' else 'round(CASE WHEN gone = 0 THEN v END / 100000, 5)'} AS value FROM t0 LEFT JOIN s ON s.row = t0.row AND s.col = t0.col"""


def warped(spark: SparkSession, sf_dir: str, kernel: str) -> DataFrame:
    grid = spark.range(SIDE * SIDE).select(F.expr(f"cast(id div {SIDE} as int)").alias("row"), (F.col("id") % SIDE).cast("int").alias("col"))
    places = warp.source_places(grid, TARGET_GRID, TARGET_CRS, SOURCE_GRID, SOURCE_CRS)
    got = warp.warp(places, cells(spark, sf_dir).drop("scene"), (64, 64), kernel, block=16).select("row", "col", "value")
    return got if kernel == "nearest" else got.withColumn("value", F.round(F.col("value") / 100000, 5))


@query("warp_nearest", warp_sql("nearest"))
def warp_nearest(spark, sf_dir):
    return warped(spark, sf_dir, "nearest")


@query("warp_bilinear", warp_sql("bilinear"))
def warp_bilinear(spark, sf_dir):
    return warped(spark, sf_dir, "bilinear")


@query("warp_cubic", warp_sql("cubic"))
def warp_cubic(spark, sf_dir):
    return warped(spark, sf_dir, "cubic")


# rays and rounds --------------------------------------------------------------------------------------------------------


@query("raycast", f"""WITH {CELLS}, c AS (SELECT row, col, z / 10000 AS z FROM cells), q AS (SELECT a.row, a.col, a.z AS z00, b.z AS z01, c.z AS z10, d.z AS z11 FROM c a JOIN c b ON b.row = a.row AND b.col = a.col + 1 JOIN c ON c.row = a.row + 1 AND c.col = a.col JOIN c d ON d.row = a.row + 1 AND d.col = a.col + 1),
    t AS (SELECT row, col, 0 AS half, col AS x0, row AS y0, z00 AS z0, col AS x1, row + 1 AS y1, z10 AS z1, col + 1 AS x2, row AS y2, z01 AS z2 FROM q UNION ALL SELECT row, col, 1, col + 1, row, z01, col, row + 1, z10, col + 1, row + 1, z11 FROM q),
    r AS (SELECT s_suppkey AS ray_id, s_suppkey * 7 % 61 + 0.37 AS ox, s_suppkey * 13 % 61 + 0.41 AS oy, 60.0 AS oz, (s_nationkey - 12) / 10 AS dx, (s_suppkey % 11 - 5) / 10 AS dy, -1.0 AS dz FROM supplier),
    e AS (SELECT ray_id, row, col, half, dx, dy, dz, x1 - x0 AS ax, y1 - y0 AS ay, z1 - z0 AS az, x2 - x0 AS bx, y2 - y0 AS by_, z2 - z0 AS bz, ox - x0 AS sx, oy - y0 AS sy, oz - z0 AS sz FROM r, t),
    f AS (SELECT *, dy * bz - dz * by_ AS hx, dz * bx - dx * bz AS hy, dx * by_ - dy * bx AS hz, sy * az - sz * ay AS qx, sz * ax - sx * az AS qy, sx * ay - sy * ax AS qz FROM e),
    g AS (SELECT *, ax * hx + ay * hy + az * hz AS det FROM f), h AS (SELECT ray_id, row, col, half, (sx * hx + sy * hy + sz * hz) / det AS u, (dx * qx + dy * qy + dz * qz) / det AS v, (bx * qx + by_ * qy + bz * qz) / det AS t FROM g WHERE det <> 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY t, row, col, half) AS o FROM h WHERE u >= 0 AND v >= 0 AND u + v <= 1 AND t >= 0)
    SELECT r.ray_id, round(k.t, 6) AS t, round(oz + k.t * dz, 6) AS z, k.row, k.col, k.half::INT AS half FROM r LEFT JOIN k ON k.ray_id = r.ray_id AND k.o = 1""")
def raycast(spark, sf_dir):
    from umbraloom.operators.raycast import raycast as cast

    k = F.col("s_suppkey")
    r = read(spark, sf_dir, "supplier").select(F.lit("orders").alias("scene"), k.alias("ray_id"), (k * 7 % 61 + 0.37).alias("ox"), (k * 13 % 61 + 0.41).alias("oy"), F.lit(60.0).alias("oz"), ((F.col("s_nationkey") - 12) / 10).alias("dx"), ((k % 11 - 5) / 10).alias("dy"), F.lit(-1.0).alias("dz"))
    got = cast(r, cells(spark, sf_dir).withColumn("z", F.col("z") / 10000), ["scene"], depth=4, leaf=4)
    return rounded(got.select("ray_id", "t", "z", "row", "col", "half"))


ROUNDS, RATE = 4, 0.3


def _rounds_sql() -> str:
    """Each round as a step of a query: sums by tile, over tiles, then the next weights."""
    steps = ["p AS (SELECT l_suppkey AS tile, CASE WHEN l_suppkey % 5 = 0 THEN 'val' ELSE 'train' END AS side, l_quantity / 50 AS x0, l_discount * 10 AS x1, ln(l_extendedprice / 10000) AS y FROM lineitem)", "w0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c)"]
    for k in range(ROUNDS + 1):
        steps.append(f"d{k} AS (SELECT tile, side, x0, x1, a * x0 + b * x1 + c - y AS d FROM p, w{k})")
        steps.append(f"s{k} AS (SELECT side, tile, avg(d) AS m, avg(d * d) AS q, avg(x0) AS x0, avg(x1) AS x1, avg(x0 * d) AS g0, avg(x1 * d) AS g1 FROM d{k} GROUP BY ALL HAVING count(*) >= 32)")
        steps.append(f"t{k} AS (SELECT side, avg(q - 0.85 * m * m) AS loss, avg(2 * (g0 - 0.85 * m * x0)) AS sa, avg(2 * (g1 - 0.85 * m * x1)) AS sb, avg(2 * (m - 0.85 * m)) AS sc FROM s{k} GROUP BY side)")
        steps.append(f"w{k + 1} AS (SELECT a - {RATE} * sa AS a, b - {RATE} * sb AS b, c - {RATE} * sc AS c FROM w{k}, t{k} WHERE side = 'train')")
    rows = " UNION ALL ".join(f"SELECT {k} AS round, (SELECT loss FROM t{k} WHERE side = 'train') AS train, (SELECT loss FROM t{k} WHERE side = 'val') AS val, a, b, c FROM w{k}" for k in range(ROUNDS + 1))
    return f"WITH {', '.join(steps)}, r AS ({rows}) SELECT round::INT AS round, round(train, 6) AS train, round(val, 6) AS val, round(a, 6) AS w0, round(b, 6) AS w1, round(c, 6) AS bias, val = min(val) OVER () AS best FROM r"


@query("fit_rounds", _rounds_sql())
def fit_rounds(spark, sf_dir):
    """The losses and weights of each round over all line items as pixels, suppliers as tiles."""
    from umbraloom.operators import rounds

    p = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tile"), F.when(F.col("l_suppkey") % 5 == 0, "val").otherwise("train").alias("side"), (F.col("l_quantity") / 50).alias("x0"), (F.col("l_discount") * 10).alias("x1"), (F.col("l_extendedprice") / 10000).alias("height"))
    got = rounds.fit_rounds(p, ["x0", "x1"], "height", "tile", "side", ROUNDS, RATE)
    rows = [(h["round"], h["train"], h["val"], *h["weights"], h["round"] == got.best_round) for h in got.history]
    return rounded(spark.createDataFrame(rows, "round int, train double, val double, w0 double, w1 double, bias double, best boolean"))


# predictions and files --------------------------------------------------------------------------------------------------


def rgb_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells' grid as tiles of 16 x 16 pixels with three channels of 0 to 255."""
    whole = morphology.densify(cells(spark, sf_dir), ["scene"], 64, 64).withColumn("v", F.floor(F.coalesce("z", F.lit(0.0)) / 100))
    channels = F.array(*(F.pmod(F.floor(F.col("v") / k), F.lit(256)).cast("double") for k in (1, 7, 13)))
    px = whole.select(F.col("scene").alias("scene_id"), (F.floor(F.col("row") / 16) * 4 + F.floor(F.col("col") / 16)).alias("tile_id"), ((F.col("row") % 16) * 16 + F.col("col") % 16).alias("k"), channels.alias("c"))
    rows = px.groupBy("scene_id", "tile_id").agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("p"))  # 256 pixels each
    return rows.select("scene_id", "tile_id", F.lit(16).alias("height"), F.lit(16).alias("width"), F.flatten(F.transform("p", lambda x: x["c"])).alias("rgb"))


TILES_SQL = f"WITH {CELLS}, d AS (SELECT r.row, c.col, coalesce(floor(z / 100), 0)::BIGINT AS v FROM range(64) r(row) CROSS JOIN range(64) c(col) LEFT JOIN cells ON cells.row = r.row AND cells.col = c.col), n AS (SELECT row, col, (v % 256 / 255 - 0.485) / 0.229 AS red, (v // 7 % 256 / 255 - 0.456) / 0.224 AS green FROM d)"


@query("predicted_tiles", f"{TILES_SQL} SELECT row // 16 * 4 + col // 16 AS tile_id, sum((red > green)::INT)::BIGINT AS redder, true AS fallback, 'no training yet (named:rule)' AS reason FROM n GROUP BY 1")
def predicted_tiles(spark, sf_dir):
    """An injected predictor on all tiles, labelled as what it is."""
    from umbraloom.operators.predictor import load_fallback, predict

    rule = load_fallback("rule", "no training yet", lambda _: lambda x: (x[0] > x[1]).astype("f4"))
    got = predict(rgb_tiles(spark, sf_dir), rule, allow_fallback=True)
    return got.select("tile_id", F.aggregate("z", F.lit(0.0), lambda s, x: s + x).cast("long").alias("redder"), "fallback", "reason")


@query("error_rasters", f"WITH {CELLS} SELECT row, col, round(round(z / 1000, 2) - 150, 3) AS value FROM cells WHERE z > 100000")
def error_rasters(spark, sf_dir):
    """Errors as a verified raster, read again by the data source."""
    from umbraloom.sources import rasters, sinks
    from umbraloom.sources.raster_source import scan_blocks

    folder = f"{lineage.shared_folder(spark)}/errors-{uuid.uuid4().hex}"
    e = morphology.densify(cells(spark, sf_dir), ["scene"], 64, 64).withColumn("error", F.when(F.col("z") > 100000, F.round(F.col("z") / 1000, 2) - 150))
    sinks.save_files(sinks.error_files(e, ["scene"], "error", (0.5, 0.0, 10.0, 0.0, -0.5, 20.0), 32643), folder)
    return rasters.pixels(scan_blocks(spark, folder)).where("value is not null").select("row", "col", F.round("value", 3).alias("value"))


# diagnostics and consensus ----------------------------------------------------------------------------------------------


@query("tile_diagnostic", f"""WITH {CELLS}, m AS (SELECT row, col FROM cells WHERE z > 200000), o AS (SELECT row, col FROM m WHERE (SELECT count(*) FROM m n WHERE abs(n.row - m.row) + abs(n.col - m.col) = 1) < 4),
    g AS (SELECT s_suppkey, (s_suppkey * 7 % 80 - 8)::INT AS r0, (s_suppkey * 5 % 64)::INT AS c0, (s_suppkey * 11 % 64)::INT AS r1, (s_suppkey * 13 % 80)::INT AS c1 FROM supplier WHERE s_suppkey % 5 = 0), n AS (SELECT *, greatest(abs(r1 - r0), abs(c1 - c0)) AS n FROM g),
    p AS (SELECT DISTINCT (r0 + round_even((r1 - r0) * k / greatest(n, 1)::DOUBLE, 0))::INT AS row, (c0 + round_even((c1 - c0) * k / greatest(n, 1)::DOUBLE, 0))::INT AS col FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM n))
    SELECT c.row, c.col, CASE WHEN p.row IS NOT NULL THEN 0 WHEN o.row IS NOT NULL THEN 255 ELSE round_even(least(z / 2000, 255), 0)::INT END AS red, CASE WHEN p.row IS NOT NULL THEN 200 WHEN o.row IS NOT NULL THEN 64 ELSE round_even(least(z / 2000, 255), 0)::INT END AS green,
        CASE WHEN p.row IS NOT NULL THEN 0 WHEN o.row IS NOT NULL THEN 64 ELSE round_even(least(z / 2000, 255), 0)::INT END AS blue FROM cells c LEFT JOIN o ON o.row = c.row AND o.col = c.col LEFT JOIN p ON p.row = c.row AND p.col = c.col""")
def tile_diagnostic(spark, sf_dir):
    """Cells in grey, outlines of the high ones above them, and rays above both."""
    from umbraloom.operators import diagnostic

    c, k = cells(spark, sf_dir), F.col("s_suppkey")
    rays = read(spark, sf_dir, "supplier").where(k % 5 == 0).select(F.lit("orders").alias("scene"), (k * 7 % 80 - 8).alias("r0"), (k * 5 % 64).alias("c0"), (k * 11 % 64).alias("r1"), (k * 13 % 80).alias("c1"))
    layers = [(diagnostic.outline_pixels(c.where("z > 200000"), ["scene"]), (255, 64, 64)), (diagnostic.segment_pixels(rays, ["scene"], 64, 64), (0, 200, 0))]
    return diagnostic.composed(c.withColumn("v", F.col("z") / 2000), layers, ["scene"]).drop("scene")


@query("pair_consensus", """WITH p AS (SELECT l_suppkey AS tile, l_orderkey * 10 + l_linenumber AS id, max(l_quantity) AS x, max(l_extendedprice) / 1000 AS y FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY id) AS k FROM p), q AS (SELECT a.tile, a.id AS i, b.id AS j, a.x AS xi, a.y AS yi, (b.y - a.y) / (b.x - a.x) AS a FROM r a JOIN r b ON b.tile = a.tile AND b.k > a.k WHERE a.k <= 6 AND b.k <= 6 AND a.x <> b.x),
    o AS (SELECT q.tile, i, j, a, yi - a * xi AS b, abs(a * (x - xi) + yi - y) AS off FROM q JOIN p ON p.tile = q.tile), c AS (SELECT tile, i, j, a, b, count(*) FILTER (off <= 15) AS inliers, coalesce(sum(off) FILTER (off <= 15), 0) AS residual FROM o GROUP BY 1, 2, 3, 4, 5),
    w AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY inliers DESC, round(residual, 9), i, j) AS k FROM c) SELECT tile, i, j, round(a, 6) AS a, round(b, 6) AS b, inliers, round(residual / inliers, 6) AS mean_off FROM w WHERE k = 1""")
def pair_consensus(spark, sf_dir):
    """The best of all pairs of each tile's first six points."""
    from pyspark.sql import Window

    from umbraloom.operators import calibration

    keys = F.col("l_suppkey").alias("tile"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")
    p = read(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.max("l_quantity").alias("x"), (F.max("l_extendedprice") / 1000).alias("y")).withColumn("dh", F.lit(5.0))
    first = p.withColumn("k", F.row_number().over(Window.partitionBy("tile").orderBy("id"))).where("k <= 6")
    pairs = first.select("tile", F.col("id").alias("i"), F.col("k").alias("ki")).join(first.select("tile", F.col("id").alias("j"), F.col("k").alias("kj")), "tile").where("kj > ki").select("tile", "i", "j")
    got = calibration.pair_consensus(p, pairs, "tile")
    return got.select("tile", "i", "j", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "inliers", F.round(F.col("residual") / F.col("inliers"), 6).alias("mean_off"))


# round trips ------------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{lineage.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _product(path: str) -> F.Column:
    """The product in a file's name, <scene>-<product>.<suffix>."""
    return F.regexp_extract(path, r"-([a-z]+)\.[a-z]+$", 1)


@query("array_round_trip", f"WITH {CELLS} SELECT row, col, floor(z / 100)::DOUBLE AS value FROM cells")
def array_round_trip(spark, sf_dir):
    """A grid saved as an array file and read again."""
    from umbraloom.sources import rasters, sinks

    folder = _folder(spark, "arrays")
    sinks.save_files(sinks.array_files(cells(spark, sf_dir).withColumn("z", F.floor(F.col("z") / 100).cast("double")), ["scene"], "z"), folder)
    return rasters.pixels(rasters.read_blocks(spark, folder, "*.npy")).where("value is not null").select("row", "col", "value")


@query("surface_round_trip", f"""WITH {CELLS}, d AS (SELECT r.row::INT AS row, c.col::INT AS col, floor(coalesce(z, 0) / 100)::DOUBLE AS dsm, floor(coalesce(z, 0) / 200)::DOUBLE AS dtm FROM range(64) r(row) CROSS JOIN range(64) c(col) LEFT JOIN cells ON cells.row = r.row AND cells.col = c.col)
    SELECT 'dsm' AS product, row, col, dsm AS value FROM d UNION ALL SELECT 'dtm', row, col, dtm FROM d UNION ALL SELECT 'ndsm', row, col, dsm - dtm FROM d UNION ALL SELECT 'ground', row, col, (dsm < 1500)::INT::DOUBLE FROM d""")
def surface_round_trip(spark, sf_dir):
    """The four surfaces of a scene as validated rasters, read again by the data source."""
    from umbraloom.sources import rasters, sinks
    from umbraloom.sources.raster_source import scan_blocks

    folder, z = _folder(spark, "surfaces"), F.coalesce("z", F.lit(0.0))
    d = morphology.densify(cells(spark, sf_dir), ["scene"], 64, 64).select("scene", "row", "col", F.floor(z / 100).cast("double").alias("dsm"), F.floor(z / 200).cast("double").alias("dtm"))
    d = d.withColumns({"ndsm": F.col("dsm") - F.col("dtm"), "ground": (F.col("dsm") < 1500).cast("int")})
    sinks.save_files(sinks.surface_files(d, ["scene"], (0.5, 0.0, 10.0, 0.0, -0.5, 20.0), 32643), folder)
    return rasters.pixels(scan_blocks(spark, folder)).select(_product("path").alias("product"), "row", "col", "value")


@query("confidence_round_trip", f"WITH {CELLS}, d AS (SELECT r.row::INT AS row, c.col::INT AS col, coalesce(z, 0) AS z FROM range(64) r(row) CROSS JOIN range(64) c(col) LEFT JOIN cells ON cells.row = r.row AND cells.col = c.col) SELECT row, col, CASE WHEN z > 250000 THEN 4 WHEN z > 150000 THEN 2 WHEN z > 0 THEN 1 ELSE 0 END::DOUBLE AS value, 'HIGH' AS high FROM d")
def confidence_round_trip(spark, sf_dir):
    """Codes of confidence states with a tag for each state."""
    from umbraloom.sources import rasters, sinks
    from umbraloom.sources.raster_source import scan_blocks, scan_headers

    folder = _folder(spark, "confidence")
    d = morphology.densify(cells(spark, sf_dir), ["scene"], 64, 64).withColumn("confidence", F.when(F.col("z") > 250000, 4).when(F.col("z") > 150000, 2).when(F.col("z") > 0, 1).otherwise(0))
    sinks.save_files(sinks.confidence_files(d, ["scene"]), folder)
    tags = scan_headers(spark, folder).select("path", F.col("tags")["STATE_4"].alias("high"))
    return rasters.pixels(scan_blocks(spark, folder)).join(tags, "path").select("row", "col", "value", "high")


@query("tile_plan_file", SQL["tile_plan"])
def tile_plan_file(spark, sf_dir):
    """The tile plan as a file of JSON lines, read again."""
    from umbraloom.sources import records

    records.save_tile_plan(QUERIES["tile_plan"](spark, sf_dir), folder := _folder(spark, "plan"))
    return records.tile_plan(spark, folder).withColumn("scene_id", F.col("scene_id").cast("long"))


@query("mesh_exports", f"WITH {SCENES}, c AS (SELECT * FROM cells2 WHERE row < 48 AND col < 48), q AS (SELECT a.scene_id FROM c a JOIN c b ON b.scene_id = a.scene_id AND b.row = a.row AND b.col = a.col + 1 JOIN c d ON d.scene_id = a.scene_id AND d.row = a.row + 1 AND d.col = a.col JOIN c e ON e.scene_id = a.scene_id AND e.row = a.row + 1 AND e.col = a.col + 1), n AS (SELECT scene_id, 2 * count(*) AS triangles FROM q GROUP BY 1) SELECT c.scene_id || '_dsm_ABSOLUTE.glb' AS name, count(*) AS vertices, coalesce(any_value(triangles), 0) AS triangles, any_value(triangles) IS NOT NULL AS sound FROM c LEFT JOIN n USING (scene_id) GROUP BY c.scene_id")
def mesh_exports(spark, sf_dir):
    """A mesh file of each scene, verified."""
    from umbraloom.sources.mesh import export_meshes

    c = scenes(spark, sf_dir).where("row < 48 and col < 48")
    got = export_meshes(c, ["scene_id"], "z", "dsm", "ABSOLUTE")
    return got.select("name", "vertices", "triangles", (F.size("problems") == 0).alias("sound"))
