"""The part of the query catalogue about what belongs together: keys, rasters, products, neighbouring tiles, steps of a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbraloom.functions import metadata as M
from umbraloom.functions import values as V
from umbraloom.operators import distributions, links, lod, metrics
from umbraloom.plans.catalogue import CELLS, DENSE, cells, query, read, rounded
from umbraloom.plans.catalogue import dense as dense_cells


def raster(path, width, height, crs, a, c, f, product="dsm", mode="ABSOLUTE", units="m", bare=None):
    """A raster's struct with square pixels of size a, its corner at (c, f); where bare, without a grid."""
    grid = F.struct(*(F.lit(v).cast("double").alias(k) for k, v in dict(a=a, b=0, c=c, d=0, e=-a, f=f).items()))
    grid = grid if bare is None else F.when(~bare, grid)
    given = dict(path=path, product_type=product, mode=mode, units=units, crs=crs, width=width, height=height)
    return F.struct(*(F.lit(v).alias(k) for k, v in given.items()), grid.alias("grid"))


@query("key_problems", "SELECT event_id, concat_ws(',', CASE WHEN event_type <> 'view' THEN event_type END) AS unknown, CASE WHEN user_id % 3 = 0 THEN 'alpha,beta' WHEN user_id % 3 = 1 THEN 'alpha' ELSE '' END AS missing FROM events")
def key_problems(spark, sf_dir):
    k, v = F.col("user_id") % 3, F.lit("1")
    kind = F.create_map("event_type", v)
    settings = F.when(k == 0, kind).when(k == 1, F.map_concat(kind, F.create_map(F.lit("beta"), v))).otherwise(F.map_concat(kind, F.create_map(F.lit("beta"), v, F.lit("alpha"), v)))
    bad = read(spark, sf_dir, "events").select("event_id", M.key_problems(settings, ["view", "alpha", "beta"], ["beta", "alpha"]).alias("p"))
    return bad.select("event_id", F.array_join("p.unknown", ",").alias("unknown"), F.array_join("p.missing", ",").alias("missing"))


@query("link_alignment", """WITH p AS (SELECT p_partkey, p_partkey % 7 = 0 AS none, p_partkey % 5 = 0 AS same, p_partkey % 3 = 0 AS bare, p_partkey % 11 = 0 AS surface_bare, p_size % 4 = 0 AS wide, p_size % 6 = 0 AS shifted, p_partkey % 2 = 0 AS crs FROM part),
    r AS (SELECT *, CASE WHEN none THEN 'no 2D raster' WHEN same OR (bare AND surface_bare AND NOT crs AND NOT wide) THEN '' ELSE concat_ws('; ', CASE WHEN wide THEN 'sizes differ' END, CASE WHEN bare AND surface_bare THEN 'no transform on either grid' WHEN bare THEN 'no transform on the image' WHEN surface_bare THEN 'no transform on the raster' WHEN shifted THEN 'transforms differ' END, CASE WHEN (CASE WHEN NOT surface_bare THEN 'x' END) IS DISTINCT FROM (CASE WHEN crs THEN 'x' END) THEN 'CRS differ' END) END AS reasons FROM p)
    SELECT p_partkey, reasons = '' AS aligned, reasons FROM r""")
def link_alignment(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    surface = raster("s", 64, 64, F.when(k % 11 > 0, "x"), 0.5, 10, 20, bare=k % 11 == 0)
    panel = F.when(k % 7 > 0, raster(F.when(k % 5 == 0, "s").otherwise("t"), F.when(s % 4 == 0, 65).otherwise(64), 64, F.when(k % 2 == 0, "x"), 0.5, F.when(s % 6 == 0, 11).otherwise(10), 20, bare=k % 3 == 0))
    got = read(spark, sf_dir, "part").select("p_partkey", links.link_alignment(surface, panel).alias("l"))
    return got.select("p_partkey", "l.aligned", F.array_join("l.reasons", "; ").alias("reasons"))


@query("measured_points", f"""WITH {CELLS}, p AS (SELECT p_partkey, p_size - 20 + 116 AS mx, 184 - ((p_partkey % 90) / 2 - 20) AS my, p_partkey % 5 = 0 AS bare, p_partkey % 7 = 0 AS other_crs FROM part),
    q AS (SELECT *, floor(mx - 100)::INT AS mc, floor(200 - my)::INT AS mr, floor((mx - 100) / 0.5)::INT AS sc, floor((200 - my) / 0.5)::INT AS sr, CASE WHEN bare THEN 'the measured raster has no georeferencing and is not the displayed grid' WHEN other_crs THEN 'CRS differs' WHEN floor(mx - 100) NOT BETWEEN 0 AND 31 OR floor(200 - my) NOT BETWEEN 0 AND 31 THEN 'outside the raster' END AS why FROM p)
    SELECT p_partkey, CASE WHEN why IS NULL THEN mr END AS row, CASE WHEN why IS NULL THEN mc END AS col, CASE WHEN why IS NULL THEN mx::DOUBLE END AS map_x, CASE WHEN why IS NULL THEN my::DOUBLE END AS map_y, CASE WHEN why IS NULL THEN round(m.z * 2, 6) END AS value, CASE WHEN why IS NULL AND m.z IS NOT NULL THEN round(s.z, 6) END AS displayed, coalesce(why, CASE WHEN m.z IS NULL THEN 'nodata at this pixel' END) AS reason
    FROM q LEFT JOIN cells m ON why IS NULL AND m.row = mr AND m.col = mc LEFT JOIN cells s ON s.row = sr AND s.col = sc""")
def measured_points(spark, sf_dir):
    k = F.col("p_partkey")
    shown = raster("shown", 64, 64, "x", 0.5, 100, 200)
    measured = raster("measured", 32, 32, F.when(k % 7 == 0, "y").otherwise("x"), 1.0, 100, 200, product="ndsm", bare=k % 5 == 0)
    points = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") - 20.0).alias("x"), ((k % 90) / 2 - 20).alias("z"), F.lit(116.0).alias("origin_x"), F.lit(184.0).alias("origin_y"), shown.alias("shown"), measured.alias("measured"))
    c = cells(spark, sf_dir)
    pixels = c.select(F.lit("shown").alias("path"), "row", "col", F.col("z").alias("value")).unionAll(c.select(F.lit("measured").alias("path"), "row", "col", (F.col("z") * 2).alias("value")))
    return rounded(links.measured_at(points, pixels, "p_partkey").drop("path", "units"))


@query("linked_products", """WITH v AS (SELECT 'out/d' || (n_nationkey * 3 % 40) AS dsm, CASE WHEN n_nationkey % 4 > 0 THEN 'e/' || n_nationkey END AS e, CASE WHEN n_nationkey % 5 > 0 THEN 'c/' || n_nationkey END AS c FROM nation UNION ALL SELECT 'out/d' || r_regionkey * 3, 'e/r', 'c/r' FROM region),
    g AS (SELECT dsm, count(*) AS n, min(e) AS e, min(c) AS c FROM v GROUP BY dsm), s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 9 > 0 THEN 'out/d' || (s_suppkey % 40) END AS dsm, CASE WHEN s_suppkey % 11 > 0 THEN s_suppkey % 13 END AS img FROM supplier)
    SELECT 'out/' || k || '/report.json' AS report, s.dsm AS source_dsm, 'dsm/' || k AS dsm, CASE WHEN k % 4 > 0 THEN 'dtm/' || k END AS dtm, CASE WHEN k % 4 = 0 THEN 'no validated dtm recorded' END AS dtm_reason, CASE WHEN k % 5 > 0 THEN 'ndsm/' || k END AS ndsm,
    CASE WHEN img < 5 AND img <> 2 THEN 'i/' || img END AS image, CASE WHEN img IS NULL THEN 'the report names no image report' WHEN img >= 5 THEN 'the image report is not there' WHEN img = 2 THEN 'the image report records no image' END AS image_reason,
    CASE WHEN n = 1 THEN e END AS error, CASE WHEN s.dsm IS NULL THEN 'no source DSM recorded' WHEN n IS NULL THEN 'no report validated this DSM' WHEN n > 1 THEN 'ambiguous: several reports validated this DSM' WHEN e IS NULL THEN 'the report records no error raster' END AS error_reason,
    CASE WHEN n = 1 THEN c END AS confidence FROM s LEFT JOIN g ON g.dsm = s.dsm""")
def linked_products(spark, sf_dir):
    k = F.col("s_suppkey")
    text = lambda *parts: F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))
    layer = lambda path, ok: F.struct(path.alias("path"), ok.alias("ok"))
    three = F.map_from_arrays(F.array(*map(F.lit, links.SURFACES)), F.array(layer(text("dsm/", k), F.lit(None).cast("boolean")), layer(text("dtm/", k), k % 4 > 0), layer(text("ndsm//", k), F.lit(True))))
    exports = F.when(k % 5 > 0, three).otherwise(F.map_filter(three, lambda name, _: name != "ndsm"))
    s = read(spark, sf_dir, "supplier").select(text("out/", k, "/report.json").alias("report"), F.lit("main").alias("product"), F.when(k % 9 > 0, text("out//./d", k % 40)).alias("source_dsm"), exports.alias("exports"), F.when(k % 11 > 0, text("/img\\", k % 13)).alias("image_report"))
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    v = read(spark, sf_dir, "nation").select(text("v/", n).alias("report"), text("out/x/../d", n * 3 % 40).alias("prediction"), F.when(n % 4 > 0, text("e/", n)).alias("error"), F.when(n % 5 > 0, text("c/", n)).alias("confidence"))
    regions = read(spark, sf_dir, "region")
    v = v.unionAll(regions.select(text("w/", r), text("out/d", r * 3), F.lit("e/r"), F.lit("c/r")))
    i = regions.select(text("img/", r).alias("report"), F.when(r != 2, text("i/", r)).alias("image"))
    return links.resolved_products(s, v, i).select("report", "source_dsm", "dsm", "dtm", "dtm_reason", "ndsm", "image", "image_reason", "error", "error_reason", "confidence")


STRIDE = "(1 << (({i} + 2 * ({j})) % 3))"


@query("stitched_mesh", f"""WITH {DENSE}, t AS (SELECT n AS node_id, (n // 4)::INT AS i, (n % 4)::INT AS j FROM range(16) x(n)),
    b AS (SELECT node_id, i * 16 AS r0, j * 16 AS c0, least(i * 16 + 16, 63) AS r1, least(j * 16 + 16, 63) AS c1, {STRIDE.format(i='i', j='j')} AS stride, CASE WHEN i > 0 THEN {STRIDE.format(i='i - 1', j='j')} ELSE 0 END AS top, CASE WHEN i < 3 THEN {STRIDE.format(i='i + 1', j='j')} ELSE 0 END AS bottom, CASE WHEN j > 0 THEN {STRIDE.format(i='i', j='j - 1')} ELSE 0 END AS lft, CASE WHEN j < 3 THEN {STRIDE.format(i='i', j='j + 1')} ELSE 0 END AS rgt FROM t),
    q AS (SELECT b.*, r AS lr, least(r + stride, r1) AS hr, c AS lc, least(c + stride, c1) AS hc FROM b, range(64) x(r), range(64) y(c) WHERE r >= r0 AND r < r1 AND c >= c0 AND c < c1 AND (r - r0) % stride = 0 AND (c - c0) % stride = 0),
    v AS (SELECT q.*, k, CASE WHEN k >= 2 THEN hr ELSE lr END AS vr, CASE WHEN k % 2 = 1 THEN hc ELSE lc END AS vc FROM q, range(4) x(k)),
    w AS (SELECT *, CASE WHEN vc = c1 THEN vc WHEN vr = r0 AND top > stride THEN vc - vc % top WHEN vr = r1 AND bottom > stride THEN vc - vc % bottom ELSE vc END AS sc FROM v),
    u AS (SELECT *, CASE WHEN vr = r1 THEN vr WHEN sc = c0 AND lft > stride THEN vr - vr % lft WHEN sc = c1 AND rgt > stride THEN vr - vr % rgt ELSE vr END AS sr FROM w),
    m AS (SELECT *, bool_or(sr <> vr OR sc <> vc) OVER (PARTITION BY node_id, lr, lc) AS moved FROM u),
    f AS (SELECT p.node_id, p.stride = 1 AND NOT p.moved AS exact, p.sr AS pr, p.sc AS pc, q.sr AS qr, q.sc AS qc, s.sr AS sr, s.sc AS sc FROM (VALUES (0, 2, 1), (1, 2, 3)) h(a, b, c) JOIN m p ON p.k = a JOIN m q ON q.k = b AND q.node_id = p.node_id AND q.lr = p.lr AND q.lc = p.lc JOIN m s ON s.k = c AND s.node_id = p.node_id AND s.lr = p.lr AND s.lc = p.lc),
    bad AS (SELECT row AS br, col AS bc FROM dense WHERE z IS NULL)
    SELECT node_id, pr, pc, qr, qc, sr, sc FROM f WHERE NOT (pr = qr AND pc = qc) AND NOT (qr = sr AND qc = sc) AND NOT (pr = sr AND pc = sc)
    AND NOT EXISTS (SELECT 1 FROM bad WHERE br BETWEEN least(pr, qr, sr) AND greatest(pr, qr, sr) AND bc BETWEEN least(pc, qc, sc) AND greatest(pc, qc, sc) AND (NOT exact OR (br = pr AND bc = pc) OR (br = qr AND bc = qc) OR (br = sr AND bc = sc)))""")
def stitched_mesh(spark, sf_dir):
    i, j = F.floor(F.col("id") / 4).cast("int"), (F.col("id") % 4).cast("int")
    stride = lambda a, b: F.call_function("shiftleft", F.lit(1), (a + 2 * b) % 3)
    beside = {"top": (i > 0, i - 1, j), "bottom": (i < 3, i + 1, j), "left": (j > 0, i, j - 1), "right": (j < 3, i, j + 1)}
    b = spark.range(16).select(F.lit("orders").alias("scene"), F.col("id").alias("node_id"), (i * 16).alias("r0"), (j * 16).alias("c0"), F.least(i * 16 + 16, F.lit(63)).alias("r1"), F.least(j * 16 + 16, F.lit(63)).alias("c1"), stride(i, j).alias("stride"), *(F.when(c, stride(x, y)).otherwise(0).alias(k) for k, (c, x, y) in beside.items()))
    got = lod.stitched_triangles(b, dense_cells(spark, sf_dir), ["scene"])
    return got.select("node_id", *(F.col(f"{k}.{n}").alias(k + n[0]) for k in "pqs" for n in ("row", "col")))


@query("tile_funnel", """WITH t AS (SELECT o_orderpriority AS city, o_custkey % 97 AS image, o_custkey % 41 AS scene_id, CASE o_orderkey % 4 WHEN 0 THEN 'calibrated' WHEN 1 THEN 'fit_failed' ELSE 'too_few' END AS status, o_custkey % 3 AS surviving, o_totalprice > 100000 AS azimuth_ok, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 6 END AS eligible, o_orderstatus = 'F' AS positive FROM orders)
    SELECT coalesce(city, 'combined') AS city, count(*) AS tiles, count(DISTINCT image) AS images, count(DISTINCT scene_id) AS scenes, count(*) FILTER (surviving > 0) AS with_buildings, count(*) FILTER (azimuth_ok) AS azimuth_recovered, count(eligible) AS reached_selection, count(*) FILTER (eligible >= 2) AS with_references, count(*) FILTER (status <> 'too_few') AS sun_calibrated, count(*) FILTER (status = 'calibrated') AS fit_returned, count(*) FILTER (status = 'calibrated' AND positive) AS fit_identifiable, count(DISTINCT image) FILTER (status = 'calibrated') AS calibrated_images, count(DISTINCT scene_id) FILTER (status = 'calibrated') AS calibrated_scenes FROM t GROUP BY GROUPING SETS ((city), ())""")
def tile_funnel(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("city"), (c % 97).alias("image"), (c % 41).alias("scene_id"), F.when(k % 4 == 0, "calibrated").when(k % 4 == 1, "fit_failed").otherwise("too_few").alias("status"), (c % 3).alias("surviving"), (F.col("o_totalprice") > 100000).alias("azimuth_ok"), F.when(k % 5 > 0, c % 6).alias("eligible"), F.when(F.col("o_orderstatus") == "F", "identifiable_positive").otherwise("statistically_weak").alias("fit_class"))
    return distributions.funnel(t, "city")


@query("merged_counts", "WITH e AS (SELECT o_orderpriority AS city, 'a' AS reason, o_custkey % 4 AS n FROM orders UNION ALL SELECT o_orderpriority, 'b' || o_orderstatus, 2 FROM orders WHERE o_orderkey % 3 = 0) SELECT coalesce(city, 'combined') AS city, reason, sum(n)::BIGINT AS n FROM e GROUP BY GROUPING SETS ((city, reason), (reason))")
def merged_counts(spark, sf_dir):
    n = (F.col("o_custkey") % 4).cast("long")
    counts = F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("a"), n, F.concat(F.lit("b"), "o_orderstatus"), F.lit(2).cast("long"))).otherwise(F.create_map(F.lit("a"), n))
    return distributions.merged_counts(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("city"), counts.alias("counts")), "city", "counts")


@query("expected_steps", "SELECT o_custkey AS scene_id, count(*) AS tiles, ceil(ceil(count(*) / 4) / 3)::BIGINT AS steps FROM orders GROUP BY o_custkey")
def expected_steps(spark, sf_dir):
    n = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("scene_id")).agg(F.count("*").alias("tiles"))
    return n.withColumn("steps", distributions.expected_steps("tiles", 4, 3))


@query("city_census", """WITH p AS (SELECT p_partkey AS stem, 'city' || p_size % 3 AS city, p_partkey % 60 AS scene_id FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY stem) AS k FROM p),
    c AS (SELECT city, stem, l_suppkey % 4 AS building_id, count(*) AS n, median(CASE WHEN l_quantity > 5 THEN l_quantity END) AS h FROM lineitem JOIN f ON stem = l_partkey AND k = 1 GROUP BY ALL)
    SELECT city, count(DISTINCT scene_id) AS scenes, coalesce(any_value(components), 0) AS components, coalesce(any_value(small), 0) AS small, coalesce(any_value(pixels), 0) AS pixels, coalesce(any_value(small_pixels), 0) AS small_pixels, coalesce(any_value(heights), 0) AS heights, round(any_value(p50), 6) AS p50, round(any_value(p90), 6) AS p90
    FROM f LEFT JOIN (SELECT city, count(*) AS components, count(*) FILTER (n < 6) AS small, sum(n)::BIGINT AS pixels, (sum(n) FILTER (n < 6))::BIGINT AS small_pixels, count(h) FILTER (n >= 6) AS heights, quantile_cont(h, 0.5) FILTER (n >= 6) AS p50, quantile_cont(h, 0.9) FILTER (n >= 6) AS p90 FROM c GROUP BY city) g USING (city) WHERE k = 1 GROUP BY city""")
def city_census(spark, sf_dir):
    k = F.col("p_partkey")
    pairs = read(spark, sf_dir, "part").select(k.alias("stem"), F.concat(F.lit("city"), (F.col("p_size") % 3).cast("string")).alias("city"), (k % 60).alias("scene_id"))
    px = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("stem"), (F.col("l_suppkey") % 4).alias("building_id"), F.when(F.col("l_quantity") > 5, F.col("l_quantity").cast("double")).otherwise(float("nan")).alias("height_m"))
    return rounded(distributions.city_census(pairs, px, 6))


FITS_SQL = "f AS (SELECT o_orderpriority AS city, CASE o_orderkey % 6 WHEN 0 THEN 'identifiable_positive' WHEN 1 THEN 'statistically_weak' WHEN 2 THEN 'non_positive' WHEN 3 THEN 'numerically_unstable' WHEN 4 THEN 'insufficient_constraints' END AS c, CASE WHEN o_orderkey % 6 < 3 OR o_orderkey % 6 = 5 THEN o_totalprice END AS a FROM orders)"


@query("fit_stats", f"WITH {FITS_SQL} SELECT city, count(c) AS attempted, count(a) FILTER (c IS NOT NULL) AS returned, count(*) FILTER (c = 'identifiable_positive') AS identifiable_positive, count(*) FILTER (c = 'statistically_weak') AS statistically_weak, count(*) FILTER (c = 'non_positive') AS non_positive, count(*) FILTER (c = 'numerically_unstable') AS numerically_unstable, count(*) FILTER (c = 'insufficient_constraints') AS insufficient_constraints, round(median(a) FILTER (c IS NOT NULL), 6) AS median_slope, round(count(*) FILTER (c = 'identifiable_positive') / nullif(count(c), 0), 6) AS identifiable_share FROM f GROUP BY city")
def fit_stats(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    names = F.array(*map(F.lit, distributions.FIT_CLASSES))
    f = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("city"), F.get(names, k.cast("int")).alias("fit_class"), F.when((k < 3) | (k == 5), F.col("o_totalprice")).alias("a"))
    return rounded(distributions.fit_stats(f, ["city"]))


@query("height_group_tiles", "WITH g(height_group, low, high) AS (VALUES ('0-5 m', -1e9, 5), ('5-10 m', 5, 10), ('10-20 m', 10, 20), ('>=20 m', 20, 1e9)), t AS (SELECT s_nationkey % 12 * 1.5 AS h, 'status' || s_suppkey % 3 AS status FROM supplier), n AS (SELECT height_group, status, count(status) AS n FROM g LEFT JOIN t ON h >= low AND h < high GROUP BY 1, 2) SELECT height_group, sum(n)::BIGINT AS tiles, coalesce(string_agg(status || '=' || n, ',' ORDER BY status), '') AS status FROM n GROUP BY 1")
def height_group_tiles(spark, sf_dir):
    t = read(spark, sf_dir, "supplier").select(V.height_group(F.col("s_nationkey") % 12 * 1.5).alias("height_group"), F.concat(F.lit("status"), (F.col("s_suppkey") % 3).cast("string")).alias("status"))
    got = distributions.height_group_table(t, [x for _, x in V.HEIGHT_GROUPS])
    text = F.array_join(F.transform(F.map_entries("status"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return got.select("height_group", "tiles", text.alias("status"))


@query("paired_gap", """WITH a AS (SELECT l_returnflag AS region, l_suppkey AS tile, l_quantity AS p, l_linenumber AS r FROM lineitem WHERE l_suppkey % 3 > 0), b AS (SELECT l_returnflag AS region, l_suppkey AS tile, l_quantity / 2 AS p, l_linenumber AS r FROM lineitem WHERE l_suppkey % 5 > 0),
    x AS (SELECT region, count(DISTINCT tile) AS tiles, avg(abs(p - r)) AS mae, sqrt(avg((p - r) * (p - r))) AS rmse FROM a WHERE tile IN (SELECT tile FROM b) GROUP BY region), y AS (SELECT region, avg(abs(p - r)) AS mae, sqrt(avg((p - r) * (p - r))) AS rmse FROM b WHERE tile IN (SELECT tile FROM a) GROUP BY region)
    SELECT region, tiles, round(x.mae - y.mae, 6) AS mae_gap, round(x.rmse - y.rmse, 6) AS rmse_gap FROM x LEFT JOIN y USING (region)""")
def paired_gap(spark, sf_dir):
    px = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("region"), F.col("l_suppkey").alias("tile"), F.col("l_quantity").alias("p"), F.col("l_linenumber").alias("r"))
    a = metrics.error_sums(px.where("tile % 3 > 0"), ["region", "tile"])
    b = metrics.error_sums(px.where("tile % 5 > 0").withColumn("p", F.col("p") / 2), ["region", "tile"])
    return rounded(metrics.paired_gap(a, b, ["region"], "tile"))


@query("candidate_tables", "SELECT event_id, concat_ws(',', CASE WHEN event_type = 'view' THEN 'gdal:default' END, CASE WHEN user_id % 2 = 0 THEN 'gdal:A' END, 'gdal:B', CASE WHEN user_id % 3 = 0 THEN 'rpc' END, CASE WHEN user_id % 5 = 0 THEN 'imd:x.IMD' END) AS labels, CASE WHEN user_id % 2 = 0 THEN '1' ELSE '2' END AS first_of_b FROM events")
def candidate_tables(spark, sf_dir):
    u, empty = F.col("user_id"), F.create_map().cast("map<string,string>")
    table = lambda v: F.create_map(F.lit("k"), F.lit(v))
    named = lambda name, t: F.struct(F.lit(name).alias("name"), t.alias("table"))
    domains = F.when(u % 2 == 0, F.array(named("A", table("0")), named("B", table("1")), named("B", table("2")))).otherwise(F.array(named("A", empty), named("B", table("2"))))
    e = read(spark, sf_dir, "events").select("event_id", M.candidate_tables(F.when(F.col("event_type") == "view", table("d")).otherwise(empty), domains, F.when(u % 3 == 0, table("r")), F.when(u % 5 == 0, F.array(named("x.IMD", table("s"))))).alias("t"))
    return e.select("event_id", F.array_join(F.transform("t", lambda x: x["label"]), ",").alias("labels"), F.get(F.filter("t", lambda x: x["label"] == "gdal:B"), 0)["table"]["k"].alias("first_of_b"))


@query("layer_eligibility", """SELECT p_partkey, reason IS NULL AS available, reason FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'error is of the source DSM, not of this surface' WHEN p_partkey % 5 = 0 THEN 'no error raster' WHEN p_partkey % 3 = 0 THEN 'the linked file is no error product' WHEN p_size % 4 = 0 THEN 'the error map validates another product' WHEN p_size % 6 = 1 THEN 'another DSM was validated' WHEN p_size % 5 = 0 THEN 'sizes differ; CRS differ' END AS reason FROM part)""")
def layer_eligibility(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    surface = raster("s", 64, 64, "x", 0.5, 10, 20, product=F.when(k % 7 == 0, "dtm").otherwise("dsm"))
    layer = F.when(k % 5 > 0, raster("e", F.when(s % 5 == 0, 65).otherwise(64), 64, F.when(s % 5 > 0, "x"), 0.5, 10, 20, product=F.when(k % 3 == 0, "confidence").otherwise("error")))
    got = links.diagnostic_eligibility("error", surface, layer, F.when(s % 6 == 1, "a/c").otherwise("a/./b"), F.lit("a//b"), F.when(s % 4 == 0, "dtm").otherwise("dsm"))
    return read(spark, sf_dir, "part").select("p_partkey", got.alias("g")).select("p_partkey", "g.*")
