"""Shadow rays from footprints: launch pixels, the walk, lengths, merged fractions, gates.

Rays are rows, and their samples are rows too: the walk is a set of windows over each ray's samples in order, so rays spread over
executors by their key, and no loop runs on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbraloom.functions.geometry import shadow_direction_pixels
from umbraloom.functions.values import col

#: Step and gap tolerance in pixels, fewest rays, hit fractions, percentile, most rays.
STEP, GAP, MIN_RAYS, MIN_HITS, FULL_HITS, PERCENTILE, MAX_RAYS = 0.5, 2.0, 3, 0.5, 0.8, 0.5, 512


def launch_pixels(footprints: DataFrame, by: Sequence[str], sun_azimuth, max_rays: int = MAX_RAYS) -> DataFrame:
    """Footprint pixels (by, row, col) whose next step along the shadow leaves the footprint; every ceil(n / max)-th of them, in row-major order.

    One anti join on equal keys: the neighbour one step ahead must not be in the footprint.
    """
    d = shadow_direction_pixels(sun_azimuth)
    ahead = footprints.select(*by, "row", "col", (F.col("row") + F.rint(d["d_row"]).cast("int")).alias("_r"), (F.col("col") + F.rint(d["d_col"]).cast("int")).alias("_c"))
    edge = ahead.join(footprints.select(*by, F.col("row").alias("_r"), F.col("col").alias("_c")), [*by, "_r", "_c"], "left_anti").select(*by, "row", "col")
    w = Window.partitionBy(*by)
    k, n = F.row_number().over(w.orderBy("row", "col")) - 1, F.count("*").over(w)
    stride = F.ceil(n / F.lit(float(max_rays)))
    out = edge.withColumns({"_k": k, "_s": stride}).where((F.col("_k") % F.col("_s") == 0) & (F.col("_k") / F.col("_s") < max_rays))
    return out.select(*by, (F.col("_k") / F.col("_s")).cast("int").alias("ray_id"), F.col("row").alias("start_row"), F.col("col").alias("start_col"))


def ray_samples(rays: DataFrame, by: Sequence[str], d_row, d_col, max_length_px, step: float = STEP) -> DataFrame:
    """A row for each step of each ray: t, and the pixel it falls on by half-even rounding."""
    at = rays.withColumns({"_dr": col(d_row), "_dc": col(d_col)}).withColumn("k", F.explode(F.sequence(F.lit(1), F.floor(col(max_length_px) / step).cast("int"))))
    t = F.col("k") * step
    return at.withColumn("t", t).withColumns({"row": F.rint(F.col("start_row") + F.col("_dr") * t).cast("int"), "col": F.rint(F.col("start_col") + F.col("_dc") * t).cast("int")})


def walk(samples: DataFrame, ray: Sequence[str], order: str, shadow: Column, skip: Column, inside: Column, step: float = STEP, gap: float = GAP) -> DataFrame:
    """A row for each ray: hit, last_hit (the value of order), shadow_samples, terminated_by.

    A ray ends at the first sample outside of the image (image_edge), or where more than `gap` of samples that are neither
    shadow nor skipped have followed the last shadow one (gap), or with its samples (max_length). Skipped samples leave
    the gap as it is, and so do not break it.
    """
    w = Window.partitionBy(*ray).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    s = samples.withColumns({"_in": F.coalesce(inside, F.lit(False)), "_skip": F.coalesce(skip, F.lit(False))})
    s = s.withColumns({"_hit": F.col("_in") & ~F.col("_skip") & F.coalesce(shadow, F.lit(False))})
    s = s.withColumns({"_miss": F.col("_in") & ~F.col("_skip") & ~F.col("_hit"), "_island": F.sum(F.col("_hit").cast("int")).over(so_far)})
    run = Window.partitionBy(*ray, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_gap", F.sum(F.col("_miss").cast("int")).over(run) * step)
    s = s.withColumn("_end", F.when(~F.col("_in"), "image_edge").when(F.col("_gap") > gap, "gap"))
    s = s.withColumn("_ended", F.count("_end").over(so_far))
    live = F.col("_ended") == 0
    out = s.groupBy(*ray).agg(
        F.max(F.when(live & F.col("_hit"), F.col(order))).alias("last_hit"), F.count(F.when(live & F.col("_hit"), 1)).alias("shadow_samples"),
        F.coalesce(F.min(F.when(F.col("_ended") == 1, F.struct(F.col(order), F.col("_end")))).getField("_end"), F.lit("max_length")).alias("terminated_by"),
    )
    return out.withColumn("hit", F.col("last_hit").isNotNull())


def cast_rays(rays: DataFrame, by: Sequence[str], shadow: DataFrame, occupied: DataFrame, sun_azimuth, height: int, width: int, max_length_px: float | None = None) -> DataFrame:
    """rays (by, ray_id, start_row, start_col) with hit, length_px, shadow_samples and terminated_by.

    shadow and occupied hold (scene_id, row, col) of shadow pixels and of footprints; both are joined on equal keys to the samples.
    """
    d = shadow_direction_pixels(sun_azimuth)
    cap = max_length_px or float((height**2 + width**2) ** 0.5)
    s = ray_samples(rays, by, d["d_row"], d["d_col"], F.lit(cap))
    at = ["scene_id", "row", "col"]
    s = s.join(shadow.select(*at, F.lit(True).alias("_sh")), at, "left").join(occupied.select(*at, F.lit(True).alias("_oc")).distinct(), at, "left")
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    walked = walk(s, [*by, "ray_id"], "k", F.col("_sh"), F.col("_oc"), inside)
    hit = s.select(*by, "ray_id", F.col("k").alias("last_hit"), ((F.col("row") - F.col("start_row")) * F.col("_dr") + (F.col("col") - F.col("start_col")) * F.col("_dc")).alias("length_px"))
    return rays.join(walked, [*by, "ray_id"], "left").join(hit, [*by, "ray_id", "last_hit"], "left").drop("last_hit")


def measure(rays: DataFrame, by: Sequence[str], percentile: float = PERCENTILE, min_rays: int = MIN_RAYS) -> DataFrame:
    """A length for each building from its rays, with spread, hit fraction, share of hits whose ray ends at the image's edge, failure and reasons for reduced confidence."""
    length = F.when(F.col("hit"), F.col("length_px"))
    agg = rays.groupBy(*by).agg(F.count("*").alias("n_rays"), F.count(length).alias("n_hits"), F.percentile(length, F.array(F.lit(percentile), F.lit(0.84), F.lit(0.16))).alias("_q"), F.coalesce(F.avg(F.when(F.col("hit"), F.when(F.col("terminated_by") == "image_edge", 1.0).otherwise(0.0))), F.lit(0.0)).alias("edge_fraction"))
    share = F.try_divide(F.col("n_hits"), F.col("n_rays"))
    failure = (
        F.when(F.col("n_rays") < min_rays, F.format_string("too few rays: %d of at least %d", "n_rays", F.lit(min_rays))).when(share < MIN_HITS, "too few hits: hit fraction below 0.5")
        .when(F.coalesce(F.col("_q")[0], F.lit(0.0)) <= 0, "no length: percentile not above zero")
    )
    out = agg.withColumns({"hit_fraction": share, "failure_reason": failure})
    ok = F.col("failure_reason").isNull()
    reasons = F.array_compact(F.array(F.when(F.col("hit_fraction") < FULL_HITS, "hit fraction below 0.8")))
    return out.select(*by, "n_rays", "n_hits", "hit_fraction", "edge_fraction", F.when(ok, F.col("_q")[0]).alias("length_px"), F.when(ok, F.col("_q")[1] - F.col("_q")[2]).alias("spread_px"), "failure_reason", F.when(ok, reasons).alias("reduced_reasons"))


def merged_fraction(rays: DataFrame, by: Sequence[str], footprints: DataFrame, sun_azimuth, step: float = STEP) -> DataFrame:
    """(by, merged_fraction): of the rays with a hit at some length, the share whose way to it, by whole steps to its end or just beyond, touches another building; null without such rays."""
    d = shadow_direction_pixels(sun_azimuth)
    c, length = F.col, F.col("length_px")
    hits = rays.where("hit and length_px != 0").select(*by, "ray_id", "start_row", "start_col", "length_px", F.when(length > 0, F.sequence(F.lit(1), F.ceil(length / step).cast("int"))).alias("_ks"), *(v.alias(n) for n, v in (("_dr", d["d_row"]), ("_dc", d["d_col"]))))
    s = hits.repartition(*by, "ray_id").select("*", F.explode_outer("_ks").alias("k")).withColumn("t", c("k") * step)
    s = s.select(*by, "ray_id", F.coalesce(c("k") == 1, F.lit(True)).alias("_first"), F.rint(c("start_row") + c("_dr") * c("t")).cast("int").alias("row"), F.rint(c("start_col") + c("_dc") * c("t")).cast("int").alias("col"))
    # the least and the greatest building of a pixel tell whether any other one lies there, so a sample stays one row and rays need no second join
    held = footprints.groupBy("scene_id", "row", "col").agg(F.min("building_id").alias("_lo"), F.max("building_id").alias("_hi"))
    touch = F.coalesce(((c("_lo") != c("building_id")) | (c("_hi") != c("building_id"))) & c("ray_id").isNotNull(), F.lit(False))
    of_ray = s.join(held, ["scene_id", "row", "col"], "left").groupBy(*by, "ray_id").agg(F.count(F.when(c("_first"), 1)).alias("_n"), F.max(touch.cast("int")).alias("_t"))
    return of_ray.groupBy(*by).agg((F.sum(c("_n") * c("_t")) / F.sum("_n")).alias("merged_fraction"))


def shadow_gate(measured: DataFrame, max_edge: float = 0.5, max_merged: float = 0.5) -> DataFrame:
    """The measurements with `rejection`: the first of failed, outside_band (if known), edge_truncated, merged."""
    no = F.lit(False)
    cols = set(measured.columns)
    band = F.coalesce(F.col("band") != "within", no) if "band" in cols else no
    merged = F.coalesce(F.col("merged_fraction") > max_merged, no) if "merged_fraction" in cols else no
    return measured.withColumn("rejection", F.when(F.col("failure_reason").isNotNull(), "failed").when(band, "outside_band").when(F.col("edge_fraction") > max_edge, "edge_truncated").when(merged, "merged"))


def shadow_zone(footprints: DataFrame, by: Sequence[str], sun_azimuth, length_px, labels: DataFrame, surface: Sequence[int]) -> DataFrame:
    """(by, ground_share): share of surface classes in the zone that the footprint sweeps, itself left out; 0 for an empty zone."""
    d = shadow_direction_pixels(sun_azimuth)
    swept = footprints.withColumn("_k", F.explode(F.sequence(F.lit(1), F.ceil(col(length_px)).cast("int"))))
    zone = swept.select("scene_id", *by, (F.col("row") + F.rint(d["d_row"] * F.col("_k"))).cast("int").alias("row"), (F.col("col") + F.rint(d["d_col"] * F.col("_k"))).cast("int").alias("col")).distinct()
    zone = zone.join(footprints.select(*by, "row", "col"), [*by, "row", "col"], "left_anti").join(labels, ["scene_id", "row", "col"])
    share = zone.groupBy(*by).agg(F.avg(F.col("cls").isin(*surface).cast("double")).alias("ground_share"))
    return footprints.select(*by).distinct().join(share, list(by), "left").fillna(0.0, ["ground_share"])
