"""Distributions, bins, reasons, ranks: exact quantiles throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbraloom.functions.values import not_finite
from umbraloom.operators.lineage import cut, light

#: Percentiles of a distribution, height limits that are counted, edges of height bins.
PERCENTILES = (10, 25, 50, 75, 90, 95)
LIMITS = (10, 20, 30)
BINS = (0.0, 5.0, 10.0, 20.0, 40.0, float("inf"))
#: Fixed values of medians: cells of a round, rows that are left to be told apart by value, rounds.
CELLS, FEW, MEDIAN_ROUNDS = 1024, 1_000_000, 8
#: Classes of a fit.
FIT_CLASSES = ("identifiable_positive", "statistically_weak", "non_positive", "numerically_unstable", "insufficient_constraints")


def distribution(rows: DataFrame, by: Sequence[str], value: str, limits: Sequence[int] = LIMITS) -> DataFrame:
    """count, mean, min, max, linear percentiles and counts above limits of finite values."""
    v = F.col(value)
    agg = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, F.array(*(F.lit(q / 100) for q in PERCENTILES))).alias("_q"), *(F.count(F.when(v > x, 1)).alias(f"over_{x}") for x in limits)]
    out = rows.where(~not_finite(value)).groupBy(*by).agg(*agg)
    return out.select(*by, "n", "mean", "min", "max", *(F.col("_q")[k].alias(f"p{q}") for k, q in enumerate(PERCENTILES)), *(f"over_{x}" for x in limits))


def bin_of(value: Column, edges: Sequence[float] = BINS) -> Column:
    """The number of a value's half-open bin; null outside."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        inside = value >= edges[k]
        if edges[k + 1] != float("inf"):
            inside = inside & (value < edges[k + 1])
        out = F.when(inside, k).otherwise(out)
    return out


def binned_errors(rows: DataFrame, p: str = "p", r: str = "r", edges: Sequence[float] = BINS) -> DataFrame:
    """(bin, low, n, mae, rmse, bias) by bins of the true value, empty bins kept."""
    e = F.col(p) - F.col(r)
    got = rows.where(~(not_finite(p) | not_finite(r))).groupBy(bin_of(F.col(r), edges).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))
    bins = rows.sparkSession.createDataFrame([(k, float(edges[k])) for k in range(len(edges) - 1)], "bin int, low double")
    return bins.join(got, "bin", "left").select("bin", "low", F.coalesce("n", F.lit(0)).alias("n"), "mae", "rmse", "bias")


def reason_counts(rows: DataFrame, reason: str) -> DataFrame:
    """(reason, n, position): histogram of what stands before a reason's first colon, largest first, then by name."""
    got = rows.where(F.col(reason).isNotNull()).groupBy(F.trim(F.substring_index(F.col(reason), ":", 1)).alias("reason")).agg(F.count("*").alias("n"))
    return got.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "reason")).cast("long"))  # few distinct reasons


def spearman(rows: DataFrame, by: str, x: str, y: str, key: str) -> DataFrame:
    """Pearson of ordinal ranks by group; equal values rank in the order of key."""
    from umbraloom.operators.metrics import pearson

    rank = lambda c: F.row_number().over(Window.partitionBy(by).orderBy(c, key)).cast("double")
    ranked = rows.where(~(not_finite(x) | not_finite(y))).select(by, rank(x).alias("_x"), rank(y).alias("_y"))
    return ranked.groupBy(by).agg(F.count("*").alias("n"), pearson("_x", "_y", 2).alias("spearman"))


def abs_percentile(rows: DataFrame, by: Sequence[str], value: str, q: float) -> DataFrame:
    """Nearest-rank percentile of absolute values, for colour scales."""
    return rows.where(~not_finite(value)).groupBy(*by).agg(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY abs({value}))").alias("value"))


def medians(rows: DataFrame, by: Sequence[str], part: str, value: str, weight: str, cells: int = CELLS, few: int = FEW, rounds: int = MEDIAN_ROUNDS) -> DataFrame:
    """(by, part, _all, median) of values that count weight times, nulls left out: for each part (_all 0), and for all parts together (part null, _all 1).

    `percentile` holds all values of a group in one task's memory. Here a round counts the values in cells between the least and greatest one, and goes on with the cell
    that holds the middle; no more than the counts is held, and they can spill. Once few rows are left, or after so many rounds, a cell is one value. Reads rows in each round.
    """
    c, kind = F.col, rows.schema[part].dataType
    each = F.explode(F.array(F.struct(F.lit(0).alias("_all"), c("_part")), F.struct(F.lit(1).alias("_all"), F.lit(None).cast(kind).alias("_part"))))
    scoped = lambda df, *cols: df.withColumn("_s", each).select(F.struct(*by, "_s._all", "_s._part").alias("_g"), *cols)
    rows = rows.select(*by, c(part).alias("_part"), c(value).cast("double").alias("_v"), c(weight).cast("long").alias("_n")).where("_v is not null and _n > 0")
    held = rows.groupBy(*by, "_part").agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_rows"))
    held = scoped(held, "_n", "_lo", "_hi", "_rows").groupBy("_g").agg(F.sum("_n").alias("_n"), F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), F.sum("_rows").alias("rows"))
    # ranks a to b are asked of the values from lo to hi, before which there are `before` others
    at = cut(held.select("_g", "lo", "hi", F.lit(0).cast("long").alias("before"), F.shiftright(c("_n") - 1, 1).alias("a"), F.shiftright("_n", 1).alias("b"), "rows"))
    place = (c("_v") - c("lo")) / (c("hi") - c("lo")) * (cells - 2)  # never falls as _v grows; not a number only where these differ by more than a double
    cell = F.when(c("_v") == c("lo"), 0).when(c("_v") == c("hi"), cells).when(F.isnan(place), cells - 1).otherwise(F.least(F.lit(cells - 1), F.floor(place) + 1))
    w = Window.partitionBy("_g", "lo").orderBy("_cell")
    for k in range(rounds + 1):
        todo = at.where("lo != hi")
        n, left = todo.agg(F.count("*"), F.sum("rows")).first()
        if not n:
            break
        met = scoped(rows, "_v", "_n").join(light(todo.drop("rows"), n), "_g").where(c("_v").between(c("lo"), c("hi")))
        cell = c("_v") if left <= few or k == rounds else cell
        found = met.groupBy("_g", "lo", "before", "a", "b", cell.alias("_cell")).agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("rows"))
        found = found.withColumn("_to", c("before") + F.sum("_n").over(w)).withColumn("_from", c("_to") - c("_n")).where((c("_from") <= c("b")) & (c("_to") > c("a")))
        found = found.select("_g", c("_lo").alias("lo"), c("_hi").alias("hi"), c("_from").alias("before"), F.greatest("a", "_from").alias("a"), F.least("b", c("_to") - 1).alias("b"), "rows")
        at = cut(found.unionAll(at.where("lo = hi")))
    out = at.groupBy("_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return out.select(*(c(f"_g.{k}").alias(k) for k in by), c("_g._part").alias(part), c("_g._all").alias("_all"), F.when(c("lo") == c("hi"), c("lo")).otherwise(c("lo") * 0.5 + c("hi") * 0.5).alias("median"))


def grouped_summary(records: DataFrame, group: str, scene: str, status: str, value: str, total: str = "combined") -> DataFrame:
    """Records by group and together: rows, distinct scenes, share that succeeded, mean and median of a value."""
    out = records.groupingSets([[F.col(group)], []], group).agg(F.count("*").alias("records"), F.countDistinct(scene).alias("scenes"), F.count(F.when(F.col(status) == "ok", 1)).alias("ok"), F.avg(value).alias("mean"), F.percentile(F.col(value), 0.5).alias("median"), F.grouping(group).alias("_all"))
    return out.select(F.when(F.col("_all") == 1, total).otherwise(F.col(group)).alias(group), "records", "scenes", "ok", F.try_divide(F.col("ok"), F.col("records")).alias("rate"), "mean", "median")


def variant_cross(rows: DataFrame, variants: Sequence[str], group: str, agg: Sequence[Column], total: str = "combined") -> DataFrame:
    """Aggregates for each combination of variants, by group and for all groups together."""
    cols = [F.col(v) for v in variants]
    out = rows.groupingSets([[*cols, F.col(group)], cols], *variants, group).agg(*agg, F.grouping(group).alias("_all"))
    return out.select(*variants, F.when(F.col("_all") == 1, total).otherwise(F.col(group)).alias(group), *(c for c in out.columns if c not in (*variants, group, "_all")))


def within_tile_mad(rows: DataFrame, by: Sequence[str], tile: str, ratio: str, least: int = 3) -> DataFrame:
    """Median over tiles of the median absolute deviation of log(ratio) inside a tile with `least` rows."""
    lg = rows.where(F.col(ratio) > 0).select(*by, tile, F.log(ratio).alias("_l"))
    mid = lg.groupBy(*by, tile).agg(F.percentile("_l", 0.5).alias("_m"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    mad = lg.join(mid, [*by, tile]).groupBy(*by, tile).agg(F.percentile(F.abs(F.col("_l") - F.col("_m")), 0.5).alias("_d"))
    return mad.groupBy(*by).agg(F.percentile("_d", 0.5).alias("mad"), F.count("*").alias("tiles")) if by else mad.agg(F.percentile("_d", 0.5).alias("mad"), F.count("*").alias("tiles"))


def height_scaling(rows: DataFrame, tile: str, length: str, height: str, least: int = 5, edges: Sequence[float] = BINS) -> DataFrame:
    """(bin, n, length_ratio, height_ratio): medians of length and height over their tile's medians, by height bin, for tiles with `least` rows."""
    med = rows.groupBy(tile).agg(F.percentile(F.col(length), 0.5).alias("_l"), F.percentile(F.col(height), 0.5).alias("_h"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    return rows.join(med, tile).groupBy(bin_of(F.col(height), edges).alias("bin")).agg(F.count("*").alias("n"), F.percentile(F.try_divide(F.col(length), F.col("_l")), 0.5).alias("length_ratio"), F.percentile(F.try_divide(F.col(height), F.col("_h")), 0.5).alias("height_ratio"))


def height_census(pixels: DataFrame, by: Sequence[str] = ("scene_id", "building_id"), height: str = "height_m", speckle_px: int = 10) -> DataFrame:
    """(scene_id, components, speckles, speckle_share, median_height): medians of components' median heights; small components are counted apart."""
    scene = by[0]
    each = pixels.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile(F.col(height), 0.5).alias("_h"))
    small = F.col("_n") < speckle_px
    return each.groupBy(scene).agg(F.count("*").alias("components"), F.count(F.when(small, 1)).alias("speckles"), F.avg(small.cast("double")).alias("speckle_share"), F.percentile(F.when(~small, F.col("_h")), 0.5).alias("median_height"))


#: Statuses of tiles on which the sun was calibrated.
SUN_CALIBRATED = ("calibrated", "fit_failed")


def funnel(records: DataFrame, group: str, least_references: int = 2, total: str = "combined") -> DataFrame:
    """How many tiles reach each step, by group and for all together.

    records: (group, image, scene_id, status, surviving, azimuth_ok, eligible, fit_class); eligible is null for a tile that
    never came to the choice of references. A group that is null is a group, apart from the total.
    """
    n = lambda cond: F.count(F.when(cond, 1))
    done = F.col("status") == "calibrated"
    steps = {
        "tiles": F.count("*"), "images": F.countDistinct("image"), "scenes": F.countDistinct("scene_id"), "with_buildings": n(F.col("surviving") > 0), "azimuth_recovered": n(F.col("azimuth_ok")),
        "reached_selection": F.count("eligible"), "with_references": n(F.col("eligible") >= least_references), "sun_calibrated": n(F.col("status").isin(*SUN_CALIBRATED)), "fit_returned": n(done),
        "fit_identifiable": n(done & (F.col("fit_class") == "identifiable_positive")), "calibrated_images": F.countDistinct(F.when(done, F.col("image"))), "calibrated_scenes": F.countDistinct(F.when(done, F.col("scene_id"))),
    }
    out = records.groupingSets([[F.col(group)], []], group).agg(*(c.alias(k) for k, c in steps.items()), F.grouping(group).alias("_all"))
    return out.select(F.when(F.col("_all") == 1, total).otherwise(F.col(group)).alias(group), *steps)


def merged_counts(records: DataFrame, group: str, counts: str, total: str = "combined") -> DataFrame:
    """(group, reason, n): maps of reason to count, added up by group and for all together."""
    each = records.select(group, F.explode(counts).alias("reason", "_n"))
    out = each.groupingSets([[F.col(group), F.col("reason")], [F.col("reason")]], group, "reason").agg(F.sum("_n").alias("n"), F.grouping(group).alias("_all"))
    return out.select(F.when(F.col("_all") == 1, total).otherwise(F.col(group)).alias(group), "reason", "n")


def expected_steps(tiles, batch: int, accumulation: int) -> Column:
    """Optimiser steps of one epoch: batches rounded up, then groups of them rounded up."""
    t = F.col(tiles) if isinstance(tiles, str) else tiles
    return F.ceil(F.ceil(t / batch) / accumulation)


def first_views(pairs: DataFrame, scene: str = "scene_id", stem: str = "stem") -> DataFrame:
    """One pair for each scene: the one whose stem sorts first."""
    w = Window.partitionBy(scene).orderBy(stem)
    return pairs.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def city_census(pairs: DataFrame, pixels: DataFrame, min_area: int, city: str = "city") -> DataFrame:
    """Buildings of each city, each scene counted by its first view alone.

    pairs: (city, scene_id, stem); pixels: (stem, building_id, height_m), a row for each building pixel. Heights are medians of a
    component's finite pixels, and only of components with min_area pixels; a component without any has none.
    """
    first = first_views(pairs).select(city, "scene_id", "stem")
    each = pixels.join(first.select("stem", city), "stem").groupBy(city, "stem", "building_id").agg(F.count("*").alias("_n"), F.percentile(F.when(~not_finite("height_m"), F.col("height_m")), 0.5).alias("_h"))
    small, h = F.col("_n") < min_area, F.when(F.col("_n") >= min_area, F.col("_h"))
    got = each.groupBy(city).agg(F.count("*").alias("components"), F.count(F.when(small, 1)).alias("small"), F.sum("_n").alias("pixels"), F.sum(F.when(small, F.col("_n")).otherwise(0)).alias("small_pixels"), F.count(h).alias("heights"), *(F.percentile(h, q / 100).alias(f"p{q}") for q in (50, 90)))
    out = first.groupBy(city).agg(F.countDistinct("scene_id").alias("scenes")).join(got, city, "left")
    return out.fillna(0, ["components", "small", "pixels", "small_pixels", "heights"])


def fit_stats(records: DataFrame, by: Sequence[str], fit_class: str = "fit_class", slope: str = "a") -> DataFrame:
    """Attempted and returned fits, how many of each class, the share that is identifiable, and the median slope.

    A record without a class was not attempted; one without a slope came to nothing.
    """
    n = lambda name: F.count(F.when(F.col(fit_class) == name, 1))
    tried = records.groupBy(*by).agg(F.count(fit_class).alias("attempted"), F.count(F.when(F.col(fit_class).isNotNull(), F.col(slope))).alias("returned"), *(n(c).alias(c) for c in FIT_CLASSES), F.percentile(F.when(F.col(fit_class).isNotNull(), F.col(slope)), 0.5).alias("median_slope"))
    return tried.withColumn("identifiable_share", F.try_divide(F.col("identifiable_positive"), F.col("attempted")))


def height_group_table(records: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(height_group, tiles, status): tiles of each status as a map, for every label, also those without tiles."""
    n = records.groupBy("height_group", "status").agg(F.count("*").alias("n"))
    by = n.groupBy("height_group").agg(F.sum("n").alias("tiles"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("status"))  # a few statuses
    every = records.sparkSession.createDataFrame([(x,) for x in labels], "height_group string")
    none = F.create_map().cast("map<string,bigint>")
    return every.join(by, "height_group", "left").select("height_group", F.coalesce("tiles", F.lit(0)).alias("tiles"), F.coalesce("status", none).alias("status"))
