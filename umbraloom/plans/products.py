"""More of the query catalogue: gates, variants, products, grids and files, each beside the same question as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from umbraloom.functions import geometry as G
from umbraloom.functions import values as V
from umbraloom.operators import calibration, components, lineage, metrics, rays, splits, surfaces
from umbraloom.plans.calibrate import dense_errors
from umbraloom.plans.catalogue import CELLS, PX, SCENES_SQL, WALK_SQL, cells, ground_mask, ground_sql, px, query, read, rounded, tile_scenes, wls_points
from umbraloom.plans.catalogue import dense as dense_cells
from umbraloom.plans.validate import product_metrics

EDGE_SQL = WALK_SQL.replace("sh AND NOT sk AS hit, NOT sh AND NOT sk AS miss FROM e)", "k <= 30 AND sh AND NOT sk AS hit, k <= 30 AND NOT sh AND NOT sk AS miss FROM e)").replace(
    "count(*) FILTER (gap > 2) OVER (PARTITION BY user_id ORDER BY k) AS ended FROM g)", "count(*) FILTER (gap > 2 OR k > 30) OVER (PARTITION BY user_id ORDER BY k) AS ended FROM g)"
).replace("CASE WHEN max(ended) > 0 THEN 'gap' ELSE 'max_length' END", "CASE WHEN max(ended) = 0 THEN 'max_length' WHEN min(k) FILTER (ended > 0) > 30 THEN 'image_edge' ELSE 'gap' END")


@query("edge_fractions", f"WITH {EDGE_SQL} SELECT user_id % 7 AS building_id, round(coalesce(avg((terminated_by = 'image_edge')::INT) FILTER (last_hit IS NOT NULL), 0), 6) AS edge_fraction FROM walked GROUP BY 1")
def edge_fractions(spark, sf_dir):
    from pyspark.sql import Window

    s = read(spark, sf_dir, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    walked = rays.walk(s, ["user_id"], "k", F.col("event_type").isin("click", "purchase"), F.col("value") < 5, F.col("k") <= 30)
    r = walked.select((F.col("user_id") % 7).alias("building_id"), "hit", (F.col("last_hit") * 0.5).alias("length_px"), "terminated_by")
    return rounded(rays.measure(r, ["building_id"]).select("building_id", "edge_fraction"))


FOOT_SQL = "f AS (SELECT DISTINCT c_nationkey AS tile_id, 'x' || (c_custkey % 40) AS building_id, (c_custkey * 13 % 64)::INT AS row, (c_custkey * 29 % 64)::INT AS col FROM customer)"


def feet(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("tile_id"), F.concat(F.lit("x"), F.col("c_custkey") % 40).alias("building_id"), (F.col("c_custkey") * 13 % 64).cast("int").alias("row"), (F.col("c_custkey") * 29 % 64).cast("int").alias("col")).distinct()


@query("isolation", f"WITH {FOOT_SQL} SELECT tile_id, building_id, NOT bool_or(EXISTS (SELECT 1 FROM f g WHERE g.tile_id = f.tile_id AND abs(g.row - f.row) + abs(g.col - f.col) <= 2 AND NOT EXISTS (SELECT 1 FROM f o WHERE o.tile_id = f.tile_id AND o.building_id = f.building_id AND o.row = g.row AND o.col = g.col))) AS isolated FROM f GROUP BY 1, 2")
def isolation(spark, sf_dir):
    f = feet(spark, sf_dir)
    return components.isolation(f, f, 2)


@query("footprint_windows", f"WITH {FOOT_SQL} SELECT tile_id, building_id, greatest(0, min(row) - 3) AS r0, least(64, max(row) + 4) AS r1, greatest(0, min(col) - 3) AS c0, least(64, max(col) + 4) AS c1 FROM f GROUP BY 1, 2")
def footprint_windows(spark, sf_dir):
    return components.windows(feet(spark, sf_dir), 3, 64, 64)


@query("solidity", f"""WITH {FOOT_SQL}, p AS (SELECT DISTINCT tile_id, building_id, 2 * row + dr AS r, 2 * col + dc AS c FROM f, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dr, dc)), e AS (SELECT tile_id, building_id, r, min(c) AS c FROM p GROUP BY 1, 2, 3 UNION SELECT tile_id, building_id, r, max(c) FROM p GROUP BY 1, 2, 3),
    h AS (SELECT a.tile_id, a.building_id, a.r AS ar, a.c AS ac, b.r AS br, b.c AS bc FROM e a JOIN e b ON b.tile_id = a.tile_id AND b.building_id = a.building_id AND (b.r <> a.r OR b.c <> a.c) JOIN e d ON d.tile_id = a.tile_id AND d.building_id = a.building_id GROUP BY ALL HAVING min((b.r - a.r) * (d.c - a.c) - (b.c - a.c) * (d.r - a.r)) >= 0),
    x AS (SELECT tile_id, building_id, count(*) AS area_px, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM f GROUP BY 1, 2), q AS (SELECT tile_id, building_id, y.row AS row, z.col AS col FROM x, range(64) y(row), range(64) z(col) WHERE y.row BETWEEN r0 AND r1 AND z.col BETWEEN c0 AND c1),
    i AS (SELECT q.tile_id, q.building_id, q.row, q.col FROM q JOIN h ON h.tile_id = q.tile_id AND h.building_id = q.building_id GROUP BY ALL HAVING min((br - ar) * (2 * q.col - ac) - (bc - ac) * (2 * q.row - ar)) >= 0), n AS (SELECT tile_id, building_id, count(*) AS hull_px FROM i GROUP BY 1, 2)
    SELECT tile_id, building_id, area_px, hull_px, round(area_px / hull_px, 6) AS solidity FROM x JOIN n USING (tile_id, building_id)""")
def solidity(spark, sf_dir):
    return rounded(components.solidity(feet(spark, sf_dir)))


ROWS_SQL = """r AS (SELECT l_suppkey % 20 AS tile, l_returnflag AS city, l_linestatus AS mode, (l_linenumber % 2)::INT AS gap, l_orderkey * 10 + l_linenumber AS id, l_quantity > 4 AS ok, CASE WHEN l_discount >= 0.1 THEN 'edge' END AS rejection,
        l_tax * 10 AS merged, CASE WHEN l_partkey % 9 = 0 THEN 'REDUCED' ELSE 'NOMINAL' END AS confidence, 180 + l_partkey % 200 AS area, 0.75 + (l_partkey % 20) / 80 AS solidity, l_partkey % 4 > 0 AS iso4, 0.85 + l_discount AS valid_fraction,
        CASE WHEN l_partkey % 11 > 0 THEN l_extendedprice / 2000 END AS h, l_quantity / 4 AS spread, l_quantity AS length, 0.7 + (l_partkey % 5) / 10 AS zone_ground, 0.5 + l_discount AS hit_fraction FROM lineitem),
    v AS (SELECT r.*, isolation, merged_check FROM r, (VALUES (0), (4)) i(isolation), (VALUES (false), (true)) m(merged_check)),
    j AS (SELECT *, CASE WHEN NOT ok THEN 'failed_measurement' WHEN rejection IS NOT NULL THEN rejection WHEN merged_check AND merged > 0.5 THEN 'merged_shadow' WHEN confidence != 'NOMINAL' THEN 'not_nominal' WHEN area < 200 THEN 'below_reference_min_area'
        WHEN solidity < 0.8 THEN 'low_solidity' WHEN isolation = 4 AND NOT iso4 THEN 'not_isolated' WHEN valid_fraction < 0.9 THEN 'insufficient_valid_agl' WHEN h IS NULL OR h < 3 THEN 'below_reference_min_height' WHEN spread / length > 0.5 THEN 'unreliable_shadow_spread'
        WHEN zone_ground < 0.8 THEN 'shadow_zone_not_open_ground' END AS gate, ok AND rejection IS NULL AS usable, ok AND rejection IS NULL AND h IS NOT NULL AND valid_fraction >= 0.9 AND NOT (merged_check AND merged > 0.5) AS with_truth FROM v)"""


def judged(spark, sf_dir):
    c = F.col
    r = read(spark, sf_dir, "lineitem").select(
        (c("l_suppkey") % 20).alias("tile"), c("l_returnflag").alias("city"), c("l_linestatus").alias("mode"), (c("l_linenumber") % 2).cast("int").alias("gap"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), (c("l_quantity") > 4).alias("ok"),
        F.when(c("l_discount") >= 0.1, "edge").alias("rejection"), (c("l_tax") * 10).alias("merged"), F.when(c("l_partkey") % 9 == 0, "REDUCED").otherwise("NOMINAL").alias("confidence"), (180 + c("l_partkey") % 200).alias("area"),
        (0.75 + (c("l_partkey") % 20) / 80).alias("solidity"), F.create_map(F.lit(0), F.lit(True), F.lit(4), c("l_partkey") % 4 > 0).alias("isolated"), (0.85 + c("l_discount")).alias("valid_fraction"),
        F.when(c("l_partkey") % 11 > 0, c("l_extendedprice") / 2000).alias("h"), (c("l_quantity") / 4).alias("spread"), c("l_quantity").alias("length"), (0.7 + (c("l_partkey") % 5) / 10).alias("zone_ground"), (0.5 + c("l_discount")).alias("hit_fraction"),
    )
    return calibration.variants(r, (0, 4))


@query("variant_gates", f"WITH {ROWS_SQL} SELECT mode, gap, isolation, merged_check, coalesce(gate, 'eligible') AS gate, count(*) AS n, count(*) FILTER (with_truth) AS with_truth FROM j GROUP BY 1, 2, 3, 4, 5")
def variant_gates(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("mode", "gap", "isolation", "merged_check", F.coalesce("gate", F.lit("eligible")).alias("gate")).agg(F.count("*").alias("n"), F.count(F.when(F.col("with_truth"), 1)).alias("with_truth"))


@query("variant_summary", f"""WITH {ROWS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY mode, gap, isolation, merged_check, city, tile ORDER BY gate IS NOT NULL, spread / length, area DESC, id) AS rank, count(*) FILTER (gate IS NULL) OVER (PARTITION BY mode, gap, isolation, merged_check, city, tile) AS eligible FROM j),
    s AS (SELECT mode, gap, isolation, merged_check, city, tile, quantile_cont(h / length, 0.5) AS scale FROM k WHERE gate IS NULL AND rank <= 3 GROUP BY ALL),
    e AS (SELECT k.*, CASE WHEN eligible >= 2 AND NOT (gate IS NULL AND rank <= 3) AND with_truth THEN scale * length - h END AS e FROM k LEFT JOIN s USING (mode, gap, isolation, merged_check, city, tile))
    SELECT mode, gap, isolation, merged_check, coalesce(city, 'combined') AS city, count(*) AS buildings, count(*) FILTER (ok) AS measured_ok, count(*) FILTER (usable) AS usable, round(quantile_cont(hit_fraction, 0.5), 6) AS median_hit_fraction,
        round(quantile_cont(CASE WHEN usable THEN spread / length END, 0.5), 6) AS median_relative_spread, round(avg((spread / length > 0.5)::INT) FILTER (usable), 6) AS high_spread_fraction, round(avg((merged > 0.5)::INT) FILTER (usable), 6) AS merged_fraction_of_usable,
        count(*) FILTER (gate IS NULL) AS eligible_references, count(DISTINCT CASE WHEN eligible >= 2 THEN city || tile END) AS tiles_with_references, count(e) AS n_errors, round(avg(abs(e)), 6) AS mae_m, round(quantile_cont(abs(e), 0.5), 6) AS median_ae_m, round(avg(e), 6) AS bias_m
    FROM e GROUP BY GROUPING SETS ((mode, gap, isolation, merged_check, city), (mode, gap, isolation, merged_check))""")
def variant_summary(spark, sf_dir):
    return rounded(calibration.variant_summary(judged(spark, sf_dir)))


@query("oracle_fits", """WITH s AS (SELECT l_suppkey AS tile, count(*) AS n, sum(l_quantity) AS sx, sum(y) AS sy, sum(l_quantity * l_quantity) AS sxx, sum(l_quantity * y) AS sxy, min(l_quantity) AS x0, max(l_quantity) AS x1 FROM (SELECT *, l_extendedprice / 1000 AS y FROM lineitem WHERE l_discount < 0.09) GROUP BY 1)
    SELECT tile, n, round(CASE WHEN n >= 5 AND x0 < x1 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) END, 6) AS a, round(CASE WHEN n >= 5 AND x0 < x1 THEN (sxx * sy - sx * sxy) / (n * sxx - sx * sx) END, 6) AS b FROM s""")
def oracle_fits(spark, sf_dir):
    b = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tile"), F.col("l_quantity").alias("r_bar"), F.when(F.col("l_discount") < 0.09, F.col("l_extendedprice") / 1000).alias("height_m"))
    return rounded(calibration.oracle_fits(b, ["tile"]).select("tile", "n", "a", "b"))


@query("evaluation_metrics", """WITH e AS (SELECT 'k' || (s_nationkey % 3) AS kind, s_acctbal AS p, c_acctbal AS r, s_acctbal - c_acctbal AS e FROM supplier JOIN customer ON s_suppkey = c_custkey)
    SELECT kind, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias, round(max(abs(e)), 6) AS max_abs, round(CASE WHEN count(*) >= 3 AND min(p) < max(p) AND min(r) < max(r) THEN corr(p, r) END, 6) AS pearson FROM e GROUP BY kind""")
def evaluation_metrics(spark, sf_dir):
    est = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("building_id"), F.col("s_acctbal").alias("estimate"), F.concat(F.lit("k"), F.col("s_nationkey") % 3).alias("kind"))
    ref = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("building_id"), F.col("c_acctbal").alias("reference"))
    return rounded(calibration.evaluation_metrics(calibration.evaluate(est, ref)))


@query("product_metrics", f"""WITH {PX}, j AS (SELECT p, r, CASE WHEN category = 'A' THEN 'terrain' WHEN category = 'R' THEN 'building' END AS category, CASE WHEN state = 'F' THEN 'REDUCED' ELSE 'HIGH' END AS confidence FROM px WHERE disc < 0.1),
    g AS (SELECT 'overall' AS "group", p, r FROM j UNION ALL SELECT 'category:' || coalesce(category, 'other'), p, r FROM j UNION ALL SELECT 'confidence:' || confidence, p, r FROM j)
    SELECT "group", count(*) AS n, round(avg(abs(p - r)), 6) AS mae, round(sqrt(avg((p - r) * (p - r))), 6) AS rmse, round(avg(p - r), 6) AS bias, round(max(abs(p - r)), 6) AS max_abs FROM g GROUP BY 1""")
def products(spark, sf_dir):
    j = px(spark, sf_dir).withColumns({"reason": F.when(F.col("disc") >= 0.1, "reference_invalid"), "confidence": F.when(F.col("state") == "F", "REDUCED").otherwise("HIGH")})
    j = j.withColumn("category", F.when(F.col("category") == "A", "terrain").when(F.col("category") == "R", "building"))
    return rounded(product_metrics(j).select("group", "n", "mae", "rmse", "bias", "max_abs"))


@query("pool_confidence", "SELECT l_returnflag AS city, sum(l_linenumber)::BIGINT AS n_high, sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber * 2 END)::BIGINT AS n_reduced, round(sum(l_linenumber) / (sum(l_linenumber) + coalesce(sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber * 2 END), 0)), 6) AS share_high, round(sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber * 2 END) / (sum(l_linenumber) + coalesce(sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber * 2 END), 0)), 6) AS share_reduced FROM lineitem GROUP BY 1")
def pool_confidence(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("city"), F.col("l_linenumber").cast("long").alias("n_high"), F.when(F.col("l_linestatus") == "F", F.col("l_linenumber").cast("long") * 2).alias("n_reduced"))
    return rounded(metrics.pool_confidence(d, ["city"]))


@query("dense_errors", "WITH f AS (SELECT s_suppkey AS tile_id, 1 + s_nationkey / 10 AS a, s_acctbal / 1000 AS b FROM supplier WHERE s_nationkey % 4 > 0), e AS (SELECT tile_id, CASE WHEN l_returnflag = 'R' THEN 'building' ELSE 'ground' END AS region, a * exp(l_discount) + b - l_quantity AS e FROM lineitem JOIN f ON l_suppkey = tile_id) SELECT tile_id, region, count(*) AS n, round(sum(abs(e)), 6) AS sum_abs, round(sum(e * e), 4) AS sum_sq, round(sum(e), 6) AS sum_err FROM e GROUP BY 1, 2")
def dense(spark, sf_dir):
    f = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tile_id"), F.when(F.col("s_nationkey") % 4 > 0, "calibrated").otherwise("fit_failed").alias("status"), (1 + F.col("s_nationkey") / 10).alias("a"), (F.col("s_acctbal") / 1000).alias("b"))
    p = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tile_id"), (F.col("l_returnflag") == "R").alias("is_building"), F.col("l_discount").alias("z_rel"), F.col("l_quantity").alias("height_m"))
    return rounded(dense_errors(p, f).withColumn("sum_sq", F.round("sum_sq", 4)))


@query("georeference_reasons", "SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'no CRS' WHEN s_suppkey % 7 = 0 THEN 'no spatial transform' WHEN s_suppkey % 11 = 0 THEN 'degenerate transform' WHEN s_suppkey % 13 = 0 THEN 'invalid dimensions' ELSE 'ok' END AS reason, count(*) AS n FROM supplier GROUP BY 1")
def georeference_reasons(spark, sf_dir):
    k = F.col("s_suppkey")
    t = lambda **v: F.struct(*(F.lit(float(v.get(x, 0))).alias(x) for x in "abcdef"))
    grid = F.when(k % 7 == 0, t(a=1, e=1)).when(k % 11 == 0, t(a=1, b=2, d=1, e=2)).otherwise(t(a=0.5, c=10, e=-0.5, f=20))
    reason = G.georeference_reason(F.when(k % 5 > 0, "EPSG:32643"), grid, F.when(k % 13 == 0, 0).otherwise(5), F.lit(5))
    return read(spark, sf_dir, "supplier").groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("world_transforms", "SELECT p_partkey, round((p_size + 0.5) * 0.5 + 100 - 7, 6)::DOUBLE AS x, round(-(200 - (p_partkey % 90 + 0.5) * 0.5 - 9), 6)::DOUBLE AS z, round((p_size + 0.5) * 0.5 + 100, 6)::DOUBLE AS map_x, round(200 - (p_partkey % 90 + 0.5) * 0.5, 6)::DOUBLE AS map_y, round(p_retailprice / 2, 6) AS value FROM part")
def world_transforms(spark, sf_dir):
    t = F.struct(*(F.lit(v).alias(k) for k, v in dict(a=0.5, b=0.0, c=100.0, d=0.0, e=-0.5, f=200.0).items()))
    p = read(spark, sf_dir, "part").withColumn("w", G.sample_xz(t, F.col("p_partkey") % 90, F.col("p_size"), F.lit(7.0), F.lit(9.0)))
    m = G.world_to_map(F.col("w.x"), F.col("w.z"), F.lit(7.0), F.lit(9.0))
    return rounded(p.select("p_partkey", "w.x", "w.z", m["x"].alias("map_x"), m["y"].alias("map_y"), G.world_y_to_value("p_retailprice", F.lit(2.0)).alias("value")))


@query("extent_overlap", "SELECT s_suppkey AS scene_id, NOT (10 + s_nationkey <= s_suppkey % 17 OR s_nationkey >= s_suppkey % 17 + 5 OR 8 <= s_suppkey % 13 OR 0 >= s_suppkey % 13 + 2) AS overlap FROM supplier")
def extent_overlap(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "scene_id")
    a = s.select("scene_id", F.col("s_nationkey").alias("left"), F.lit(0).alias("bottom"), (10 + F.col("s_nationkey")).alias("right"), F.lit(8).alias("top"))
    k = F.col("scene_id")
    b = s.select("scene_id", (k % 17).alias("left"), (k % 13).alias("bottom"), (k % 17 + 5).alias("right"), (k % 13 + 2).alias("top"))
    return surfaces.overlapping(a, b)


@query("log_space", "SELECT s_suppkey, round(CASE WHEN s_acctbal >= 0 THEN ln(s_acctbal + 1) ELSE -ln(1 - s_acctbal) END, 6) AS log_h, round((s_nationkey * 10 / 255 - 0.485) / 0.229, 6) AS channel, round(s_nationkey * 10.0, 6)::DOUBLE AS back FROM supplier")
def log_space(spark, sf_dir):
    c = V.normalised_channel(F.col("s_nationkey") * 10, F.lit(0.485), F.lit(0.229))
    return rounded(read(spark, sf_dir, "supplier").select("s_suppkey", V.log_height("s_acctbal").alias("log_h"), c.alias("channel"), V.denormalised_channel(c, F.lit(0.485), F.lit(0.229)).alias("back")))


@query("overlay_colors", """WITH v AS (SELECT s_suppkey, s_nationkey, greatest(-1, least(1, s_acctbal / 5000)) AS v FROM supplier), f AS (SELECT *, round_even(255 * (1 - abs(v)), 0)::INT AS fade FROM v)
    SELECT s_suppkey, CASE WHEN v >= 0 THEN 255 ELSE fade END AS red, fade AS green, CASE WHEN v >= 0 THEN fade ELSE 255 END AS blue, round_even(CASE WHEN s_nationkey % 3 = 0 THEN 40 ELSE 40 * (1 - 0.25) + fade * 0.25 END, 0)::INT AS blended FROM f""")
def overlay_colors(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").withColumn("c", V.diverging_color("s_acctbal", F.lit(5000.0)))
    return s.select("s_suppkey", F.col("c")[0].alias("red"), F.col("c")[1].alias("green"), F.col("c")[2].alias("blue"), V.composite(F.lit(40), F.when(F.col("s_nationkey") % 3 > 0, F.col("c")[1]), F.lit(0.25)).alias("blended"))


@query("product_types", """WITH t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'dsm' WHEN 1 THEN 'dtm' END AS said, CASE p_partkey % 3 WHEN 0 THEN 'dsm' WHEN 1 THEN 'ndsm' END AS want FROM part)
    SELECT p_partkey, CASE WHEN said != want THEN NULL ELSE coalesce(want, said) END AS product_type, CASE WHEN said != want THEN 'expected ' || want || ' but the file says ' || said END AS reason, CASE WHEN p_partkey % 2 = 0 AND want IS NOT NULL THEN 'm' ELSE 'unitless' END AS units FROM t""")
def product_types(spark, sf_dir):
    k = F.col("p_partkey")
    said = V.inferred_product_type(F.create_map(F.lit("PRODUCT"), F.when(F.col("p_size") % 4 == 0, "DSM").when(F.col("p_size") % 4 == 1, "dtm").when(F.col("p_size") % 4 == 2, "other")))
    want = F.when(k % 3 == 0, "dsm").when(k % 3 == 1, "ndsm")
    r = V.reconciled_product_type(want, said)
    return read(spark, sf_dir, "part").select("p_partkey", r["product_type"].alias("product_type"), r["reason"].alias("reason"), V.mode_units(F.when(k % 2 == 0, "ABSOLUTE").otherwise("RELATIVE"), want.isNotNull()).alias("units"))


@query("crops_with_data", f"""WITH {SCENES_SQL}, c AS (SELECT scene_id, k, (k * 37 % 120)::INT AS row_off, (k * 53 % 120)::INT AS col_off FROM scenes, range(4) t(k)), v AS (SELECT DISTINCT l_suppkey AS scene_id, (l_partkey % 150)::INT AS row, (l_orderkey % 150)::INT AS col FROM lineitem),
    s AS (SELECT c.scene_id, k, row_off, col_off, count(v.row) / 1024.0 AS share FROM c LEFT JOIN v ON v.scene_id = c.scene_id AND row BETWEEN row_off AND row_off + 31 AND col BETWEEN col_off AND col_off + 31 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY CASE WHEN share >= 0.002 THEN k END NULLS LAST, share DESC, k) AS o FROM s) SELECT scene_id, k, row_off, col_off, round(share, 6)::DOUBLE AS share FROM r WHERE o = 1""")
def crops_with_data(spark, sf_dir):
    c = tile_scenes(spark, sf_dir).select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<long>")).alias("k")).withColumns({"row_off": (F.col("k") * 37 % 120).cast("int"), "col_off": (F.col("k") * 53 % 120).cast("int")})
    v = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("scene_id"), (F.col("l_partkey") % 150).cast("int").alias("row"), (F.col("l_orderkey") % 150).cast("int").alias("col")).distinct()
    return rounded(splits.crops_with_data(c, v, 32, 0.002))


@query("selected_regions", "SELECT lang, count(*) AS n FROM documents WHERE lang IN ('de', 'es') GROUP BY lang")
def selected_regions(spark, sf_dir):
    return splits.selected_regions(read(spark, sf_dir, "documents").select("lang", "doc_id"), ("de", "es"), "lang").groupBy("lang").agg(F.count("*").alias("n"))


@query("ransac_labels")
def ransac_labels(spark, sf_dir):
    p = wls_points(spark, sf_dir).select("tile", "x", "y", F.lit(5.0).alias("dh"), F.col("w").alias("weight"))
    return rounded(calibration.fit_labels(calibration.ransac(p, "tile")).select("tile", "inliers", "outliers", "label"))


@query("raster_round_trip", f"WITH {CELLS} SELECT row, col, floor(z / 100)::DOUBLE AS value FROM cells")
def raster_round_trip(spark, sf_dir):
    """Cells written as a GeoTIFF, validated, and read again."""
    from umbraloom.sources import rasters, sinks

    folder = f"{lineage.shared_folder(spark)}/rasters-{uuid.uuid4().hex}"
    sinks.save_files(sinks.raster_files(cells(spark, sf_dir).withColumn("z", F.floor(F.col("z") / 100).cast("double")), ["scene"], "z", (0.5, 0.0, 10.0, 0.0, -0.5, 20.0), 32643, {"PRODUCT": "dsm"}), folder)
    return rasters.pixels(rasters.read_blocks(spark, folder, "*.tif")).where("value is not null").select("row", "col", "value")


DIRECTION = "-cos(radians(315)) AS dr, sin(radians(315)) AS dc"


@query("merged_fraction", f"""WITH {FOOT_SQL}, y AS (SELECT p_partkey AS ray_id, p_partkey % 25 AS scene_id, 'x' || (p_partkey % 40) AS building_id, p_size AS r0, p_partkey % 64 AS c0, p_size * 0.7 AS len, {DIRECTION} FROM part WHERE p_partkey % 5 > 0),
    t AS (SELECT *, unnest(range(1, ceil(len / 0.5)::BIGINT + 1)) * 0.5 AS t FROM y), m AS (SELECT DISTINCT ray_id FROM t JOIN f ON f.tile_id = scene_id AND f.building_id != t.building_id AND f.row = round_even(r0 + dr * t, 0) AND f.col = round_even(c0 + dc * t, 0))
    SELECT scene_id, building_id, round(avg((m.ray_id IS NOT NULL)::INT), 6) AS merged_fraction FROM y LEFT JOIN m USING (ray_id) GROUP BY 1, 2""")
def merged_fraction(spark, sf_dir):
    k = F.col("p_partkey")
    r = read(spark, sf_dir, "part").select(k.alias("ray_id"), (k % 25).alias("scene_id"), F.concat(F.lit("x"), k % 40).alias("building_id"), F.col("p_size").alias("start_row"), (k % 64).alias("start_col"), (k % 5 > 0).alias("hit"), (F.col("p_size") * 0.7).alias("length_px"))
    return rounded(rays.merged_fraction(r, ["scene_id", "building_id"], feet(spark, sf_dir).withColumnRenamed("tile_id", "scene_id"), F.lit(135.0)))


@query("shadow_zone", f"""WITH {FOOT_SQL}, {CELLS}, d AS (SELECT {DIRECTION}), z AS (SELECT DISTINCT tile_id, building_id, f.row + round_even(dr * k, 0)::INT AS row, f.col + round_even(dc * k, 0)::INT AS col FROM f, d, range(1, 5) t(k)),
    o AS (SELECT z.* FROM z ANTI JOIN f USING (tile_id, building_id, row, col)), s AS (SELECT tile_id, building_id, avg((cells.z > 150000)::INT) AS g FROM o JOIN cells USING (row, col) GROUP BY 1, 2)
    SELECT tile_id AS scene_id, building_id, round(coalesce(g, 0), 6) AS ground_share FROM (SELECT DISTINCT tile_id, building_id FROM f) LEFT JOIN s USING (tile_id, building_id)""")
def shadow_zone(spark, sf_dir):
    f = feet(spark, sf_dir).withColumnRenamed("tile_id", "scene_id")
    c = cells(spark, sf_dir).select("row", "col", F.when(F.col("z") > 150000, 2).otherwise(6).alias("cls"))
    labels = c.withColumn("scene_id", F.explode(F.sequence(F.lit(0), F.lit(24))))  # the same labels in each of the scenes
    got = rays.shadow_zone(f.withColumn("key", F.concat_ws("|", "scene_id", "building_id")), ["key"], F.lit(135.0), F.lit(3.5), labels, (2,))
    return rounded(got.select(F.split("key", "[|]")[0].cast("int").alias("scene_id"), F.split("key", "[|]")[1].alias("building_id"), "ground_share"))


@query("non_ground", f"WITH {CELLS}, g AS ({ground_sql()}) SELECT g.row, g.col FROM g JOIN cells USING (row, col) WHERE NOT is_ground")
def non_ground(spark, sf_dir):
    """A DSM's chain with an extractor of the caller's: what is valid but no ground."""
    g = ground_mask(spark, sf_dir)
    c = dense_cells(spark, sf_dir)
    return surfaces.derive_surfaces(c, ["scene"], 1.0, 8.0, extractor=lambda x: x.join(g, ["row", "col"])).where("non_ground").select("row", "col")


@query("derived_surfaces")
def derived_surfaces(spark, sf_dir):
    c = dense_cells(spark, sf_dir).withColumn("filled", F.coalesce("z", F.lit(0.0)))
    return rounded(surfaces.derive_surfaces(c, ["scene"], 1.0, 8.0).select("row", "col", "is_ground", "dtm", "ndsm", "non_ground"))
