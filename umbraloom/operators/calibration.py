"""Scale from references, weighted least squares, consensus fits, gates and rankings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbraloom.functions.values import classify_failure, classify_fit, col, not_finite
from umbraloom.operators.distributions import medians
from umbraloom.operators.lineage import cut, kept, light
from umbraloom.operators.metrics import pearson

#: Reference gates, references used, constraints of a fit, limits of its condition and consensus.
MIN_AREA, MIN_SOLIDITY, MIN_HEIGHT, MIN_VALID, MIN_GROUND, MAX_SPREAD = 200, 0.8, 3.0, 0.9, 0.8, 0.5
REFERENCES, MIN_REFERENCES = 3, 2
MIN_CONSTRAINTS, MAX_CONDITION = 5, 1e6
SIGMAS, PAIRS, REFINEMENTS = 3.0, 500, 10


def reference_gate(c: dict[str, Column] | None = None) -> Column:
    """The first gate that a candidate fails, or null: usable, nominal, area, solidity, isolation, coverage, height, spread, open ground."""
    c = {k: F.col(k) for k in ("usable", "confidence", "area_px", "solidity", "isolated", "valid_fraction", "height_m", "rel_spread", "ground_share")} | (c or {})
    no = F.lit(False)
    return (
        F.when(~F.coalesce(c["usable"], no), "not_usable").when(c["confidence"] != "NOMINAL", "not_nominal").when(c["area_px"] < MIN_AREA, "small").when(c["solidity"] < MIN_SOLIDITY, "not_solid")
        .when(~F.coalesce(c["isolated"], no), "not_isolated").when(c["valid_fraction"] < MIN_VALID, "low_coverage").when(F.coalesce(c["height_m"] < MIN_HEIGHT, ~no), "low")
        .when(F.coalesce(c["rel_spread"] > MAX_SPREAD, ~no), "spread").when(F.coalesce(c["ground_share"] < MIN_GROUND, ~no), "no_open_ground")
    )


def ranked_references(candidates: DataFrame, by: Sequence[str], key: str = "building_id", k: int = REFERENCES, gate: str = "gate", spread: str = "rel_spread", area: str = "area_px") -> DataFrame:
    """Candidates with rank and is_reference: eligible ones by spread, then area from the largest, then key; the rejected after them."""
    w = Window.partitionBy(*by).orderBy(F.col(gate).isNotNull(), spread, F.desc(area), key)
    return candidates.withColumn("rank", F.row_number().over(w)).withColumn("is_reference", F.col(gate).isNull() & (F.col("rank") <= k))


def scale_estimates(references: DataFrame, by: Sequence[str], height: str, length: str, spread: str) -> DataFrame:
    """(by, n, k_median, k_mean, k_weighted) of height / length; weights are inverse squares of the relative spread, null unless all are above zero."""
    ratio = F.when(F.col(length) > 0, F.col(height) / F.col(length))
    rel = F.when(F.col(spread) > 0, F.col(spread))
    w = 1 / (rel * rel)
    n = F.count(ratio)
    weighted = F.when(F.count(rel) == F.count("*"), F.try_divide(F.sum(ratio * w), F.sum(F.when(ratio.isNotNull(), w))))
    return references.groupBy(*by).agg(n.alias("n"), F.percentile(ratio, 0.5).alias("k_median"), F.avg(ratio).alias("k_mean"), weighted.alias("k_weighted"))


def height_constraints(buildings: DataFrame, k, references: DataFrame, key: Sequence[str], length: str = "length_px", spread: str = "spread_px", explicit_dl: float | None = None, reduced_factor: float = 0.5) -> DataFrame:
    """h = k * length and dh = k * dL for buildings that are no references; rows without a positive finite dL are dropped; weight = factor / dh^2."""
    dl = F.lit(explicit_dl) if explicit_dl is not None else F.col(spread)
    out = buildings.join(references.select(*key).distinct(), list(key), "left_anti").withColumns({"h": col(k) * F.col(length), "dh": col(k) * dl})
    factor = F.when(F.col("confidence") == "NOMINAL", 1.0).otherwise(reduced_factor)
    return out.where(~not_finite("dh") & (F.col("dh") > 0) & ~not_finite("h")).withColumn("weight", factor / (F.col("dh") * F.col("dh")))


def wls(points: DataFrame, by: Sequence[str], x: str = "x", y: str = "y", w: str = "w", least: int = 2, max_condition: float = MAX_CONDITION) -> DataFrame:
    """y = a x + b by weighted least squares for each group, in closed form from sums: one aggregation, whatever the number of points.

    (by, n, a, b, se_a, se_b, chi2_red, rmse, condition, reason): null with a reason for too few points, values that are not finite,
    weights that are not above zero, equal x, or a condition number over the limit.
    """
    x_, y_, w_ = (F.col(c).cast("double") for c in (x, y, w))
    bad = not_finite(x_) | not_finite(y_) | not_finite(w_)
    ok = F.when(~bad & (w_ > 0), F.lit(1))
    mean = lambda v: F.sum(F.when(ok.isNotNull(), v))
    s = points.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("_bad"), F.count(F.when(w_ <= 0, 1)).alias("_neg"), F.min(x_).alias("_x0"), F.max(x_).alias("_x1"),
        mean(w_).alias("sw"), mean(w_ * x_).alias("sx"), mean(w_ * y_).alias("sy"), mean(w_ * x_ * x_).alias("sxx"), mean(w_ * x_ * y_).alias("sxy"), mean(w_ * y_ * y_).alias("syy"),
    )
    c = {k: F.col(k) for k in ("sw", "sx", "sy", "sxx", "sxy", "syy")}
    det = c["sw"] * c["sxx"] - c["sx"] * c["sx"]
    half, off = (c["sxx"] + c["sw"]) / 2, F.sqrt(F.pow((c["sxx"] - c["sw"]) / 2, F.lit(2.0)) + c["sx"] * c["sx"])
    # squared singular values of the weighted design are the eigenvalues of its normal matrix; their product is det
    condition = F.sqrt(F.try_divide((half + off) * (half + off), det))
    need = max(2, least)
    reason = (
        F.when(F.col("n") < need, F.format_string(f"underdetermined: %d points, need at least {need}", "n")).when(F.col("_bad") > 0, "not finite: a point or weight").when(F.col("_neg") > 0, "weights: not above zero")
        .when(F.col("_x0") == F.col("_x1"), "degenerate: all x are equal").when((det <= 0) | F.coalesce(condition > max_condition, F.lit(True)), "ill-conditioned: condition number over the limit")
    )
    s = s.withColumns({"reason": reason, "condition": condition, "_det": det})
    fit = F.col("reason").isNull()
    s = s.withColumn("a", F.when(fit, F.try_divide(c["sw"] * c["sxy"] - c["sx"] * c["sy"], F.col("_det")))).withColumn("b", F.when(fit, F.try_divide(c["sxx"] * c["sy"] - c["sx"] * c["sxy"], F.col("_det"))))
    rss = F.greatest(F.lit(0.0), c["syy"] - F.col("a") * c["sxy"] - F.col("b") * c["sy"])
    s = s.withColumn("chi2_red", F.when(fit, F.when(F.col("n") > 2, rss / (F.col("n") - 2))))
    return s.select(*by, "n", "a", "b", F.sqrt(F.try_divide(c["sw"], F.col("_det")) * F.col("chi2_red")).alias("se_a"), F.sqrt(F.try_divide(c["sxx"], F.col("_det")) * F.col("chi2_red")).alias("se_b"), "chi2_red", F.when(fit, F.sqrt(F.try_divide(rss, c["sw"]))).alias("rmse"), F.when(fit, F.col("condition")).alias("condition"), "reason")


def fit_labels(fits: DataFrame) -> DataFrame:
    return fits.withColumn("label", F.when(F.col("reason").isNotNull(), classify_failure("reason")).otherwise(classify_fit("a", "se_a")))


def solve(x: np.ndarray, y: np.ndarray, w: np.ndarray, max_condition: float = MAX_CONDITION) -> dict:
    """The weighted line of points with its standard errors, or the reason why there is none."""
    if len(x) < 2 or np.ptp(x) == 0:
        return {"reason": "degenerate: all x are equal"}
    design = np.sqrt(w)[:, None] * np.stack([x, np.ones(len(x))], axis=1)
    singular = np.linalg.svd(design, compute_uv=False)
    if singular[1] == 0 or singular[0] / singular[1] > max_condition:
        return {"reason": "ill-conditioned: condition number over the limit"}
    normal = np.linalg.inv(design.T @ design)
    a, b = normal @ (design.T @ (np.sqrt(w) * y))
    chi2 = float((w * (a * x + b - y) ** 2).sum() / (len(x) - 2)) if len(x) > 2 else None
    se = [float(np.sqrt(normal[k, k] * chi2)) if chi2 is not None else None for k in (0, 1)]
    return {"a": float(a), "b": float(b), "se_a": se[0], "se_b": se[1], "chi2_red": chi2, "reason": None}


def consensus(x: np.ndarray, y: np.ndarray, dh: np.ndarray, w: np.ndarray, seed: int, least: int = MIN_CONSTRAINTS, pairs: int = PAIRS) -> dict:
    """Seeded pairs of different points; the line with most points within SIGMAS * dh, then the least residual of those, then the first; refitted until its points stay the same,
    as long as enough points are left."""
    nothing = {"a": None, "b": None, "se_a": None, "se_b": None, "chi2_red": None, "inliers": 0, "outliers": 0}
    n, limit = len(x), SIGMAS * dh
    if n < max(2, least):
        return nothing | {"reason": f"underdetermined: {n} points, need at least {max(2, least)}"}
    if not (np.isfinite(limit).all() and (limit > 0).all()):
        return nothing | {"reason": "not finite: a point's uncertainty"}
    if np.ptp(x) == 0:
        return nothing | {"reason": "degenerate: all x are equal"}
    rng = np.random.default_rng(seed)
    i, j = rng.integers(0, n, pairs), rng.integers(0, n - 1, pairs)
    j += j >= i
    ok = x[i] != x[j]
    i, j = i[ok], j[ok]
    if not len(i):
        return nothing | {"reason": f"at most 0 points agree, need at least {least}"}
    a = (y[j] - y[i]) / (x[j] - x[i])
    off = np.abs(a[:, None] * (x - x[i][:, None]) + y[i][:, None] - y)
    near = off <= limit
    inside = near[np.lexsort((np.where(near, off, 0).sum(axis=1), -near.sum(axis=1)))[0]]
    if inside.sum() < least:
        return nothing | {"reason": f"at most {int(inside.sum())} points agree, need at least {least}"}
    line = solve(x[inside], y[inside], w[inside])
    for _ in range(REFINEMENTS):
        if line["reason"]:
            return nothing | line
        now = np.abs(line["a"] * x + line["b"] - y) <= limit
        if (now == inside).all() or now.sum() < least:
            break
        inside = now
        line = solve(x[inside], y[inside], w[inside])
    return nothing | line | {"inliers": int(inside.sum()), "outliers": int(n - inside.sum())}


def ransac(points: DataFrame, by: str, seed: int = 0) -> DataFrame:
    """(by, n, a, b, se_a, se_b, chi2_red, inliers, outliers, reason) for points (x, y, dh, weight). A tile's buildings are one group, which is small by its nature."""
    kind = points.schema[by].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        got = consensus(*(pdf[c].to_numpy(float) for c in ("x", "y", "dh", "weight")), seed)
        return pd.DataFrame([{by: pdf[by].iloc[0], "n": len(pdf), **got}])

    return points.groupBy(by).applyInPandas(fit, f"{by} {kind}, n long, a double, b double, se_a double, se_b double, chi2_red double, inliers long, outliers long, reason string")


def pair_consensus(points: DataFrame, pairs: DataFrame, by: str, key: str = "id") -> DataFrame:
    """(by, i, j, a, b, inliers, residual) of the best of given pairs (by, i, j) of points (by, key, x, y, dh): the line through both that most points lie within SIGMAS * dh of, then the one with the
    least sum of their distances, then the first by i and j. Pairs of equal x give no line; groups without one give no row. A pair meets the points of its own group only."""
    end = lambda k: points.select(by, F.col(key).alias(k), F.col("x").alias(f"_x{k}"), F.col("y").alias(f"_y{k}"))
    lines = pairs.select(by, "i", "j").join(end("i"), [by, "i"]).join(end("j"), [by, "j"]).where("_xi != _xj").withColumn("a", (F.col("_yj") - F.col("_yi")) / (F.col("_xj") - F.col("_xi")))
    off = F.abs(F.col("a") * (F.col("x") - F.col("_xi")) + F.col("_yi") - F.col("y"))
    met = lines.join(points.select(by, "x", "y", "dh"), by)
    counted = met.groupBy(by, "i", "j", "a", (F.col("_yi") - F.col("a") * F.col("_xi")).alias("b")).agg(F.count(F.when(off <= SIGMAS * F.col("dh"), 1)).alias("inliers"), F.coalesce(F.sum(F.when(off <= SIGMAS * F.col("dh"), off)), F.lit(0.0)).alias("residual"))
    best = counted.groupBy(by).agg(F.min(F.struct((-F.col("inliers")).alias("n"), F.round("residual", 9).alias("r"), "i", "j", "a", "b", "inliers", "residual")).alias("_b"))
    return best.select(by, *(F.col(f"_b.{c}").alias(c) for c in ("i", "j", "a", "b", "inliers", "residual")))


def leave_references_out(buildings: DataFrame, tile: str, height: str, length: str, rank: str = "rank", k: int = REFERENCES, least: int = MIN_REFERENCES) -> DataFrame:
    """(n, mae, rmse, bias, tiles, undefined): a tile's scale is the median ratio of its first k references; errors are of all its other buildings."""
    ok = buildings.where((F.col(length) > 0) & F.col(height).isNotNull())
    ref = ok.groupBy(tile).agg(F.percentile(F.when(F.col(rank) <= k, F.col(height) / F.col(length)), 0.5).alias("_k"), F.count(F.when(F.col(rank) <= k, 1)).alias("_n"))
    e = F.when(F.col("_n") >= least, F.col("_k") * F.col(length) - F.col(height))
    rest = ok.where(F.col(rank) > k).join(ref, tile)
    return rest.agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.countDistinct(F.when(e.isNotNull(), F.col(tile))).alias("tiles"), F.countDistinct(F.when(F.col("_n") < least, F.col(tile))).alias("undefined"))


def evaluate(estimates: DataFrame, references: DataFrame, key: str = "building_id", estimate: str = "estimate", reference: str = "reference", order: str | None = None) -> DataFrame:
    """All estimates with their reference and error, null where there is none. Several references to a building are an error, unless a column of their order is given: then the first counts."""
    w = Window.partitionBy(key)
    if order is None:
        once = F.when(F.count("*").over(w) > 1, F.raise_error(F.concat(F.lit("duplicate reference: "), F.col(key).cast("string"))).cast(references.schema[key].dataType)).otherwise(F.col(key))
        first = references.withColumn(key, once)
    else:
        first = references.withColumn("_k", F.row_number().over(w.orderBy(order))).where("_k = 1")
    return estimates.join(first.select(key, reference, *([c for c in ("kind",) if c in references.columns])), key, "left").withColumn("error", F.col(estimate) - F.col(reference))


def evaluation_metrics(evaluated: DataFrame, kind: str = "kind", estimate: str = "estimate", reference: str = "reference") -> DataFrame:
    """(kind, n, mae, rmse, bias, max_abs, pearson) of evaluated buildings by kind of reference; without any reference no row."""
    e = F.col("error")
    ok = evaluated.where(F.col(reference).isNotNull() & F.col(estimate).isNotNull())
    return ok.groupBy(kind).agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.max(F.abs(e)).alias("max_abs"), pearson(estimate, reference).alias("pearson"))


def oracle_fits(buildings: DataFrame, by: Sequence[str], relative: str = "r_bar", truth: str = "height_m", least: int = MIN_CONSTRAINTS) -> DataFrame:
    """The unweighted line of each group through its buildings' true heights, labelled; buildings without truth are left out."""
    points = buildings.select(*by, F.col(relative).alias("x"), F.when(F.col(truth).isNotNull(), F.col(truth)).alias("y"), F.lit(1.0).alias("w")).where("y is not null")
    return fit_labels(wls(points, by, least=least))


#: Reasons of the gates of an ablation's variants, in order.
VARIANT_GATES = ("failed_measurement", "rejected", "merged_shadow", "not_nominal", "below_reference_min_area", "low_solidity", "not_isolated", "insufficient_valid_agl", "below_reference_min_height", "unreliable_shadow_spread", "shadow_zone_not_open_ground")


def variants(rows: DataFrame, isolations: Sequence[int], max_merged: float = 0.5) -> DataFrame:
    """Measured buildings once for each variant (isolation, merged_check), with the first gate that fails there, and whether they are usable with truth.

    rows: ok, rejection, merged, confidence, area, solidity, isolated (map of distance to boolean), valid_fraction, h, spread, length, zone_ground.
    """
    v = F.array(*(F.struct(F.lit(i).alias("isolation"), F.lit(m).alias("merged_check")) for i in isolations for m in (False, True)))
    out = rows.withColumn("_v", F.explode(v)).select("*", "_v.isolation", "_v.merged_check").drop("_v")
    c, no = F.col, F.lit(False)
    merged = c("merged_check") & F.coalesce(c("merged") > max_merged, no)
    tests = (
        ~c("ok"), c("rejection").isNotNull(), merged, c("confidence") != "NOMINAL", c("area") < MIN_AREA, c("solidity") < MIN_SOLIDITY, ~F.coalesce(F.element_at("isolated", c("isolation")), no),
        c("valid_fraction") < MIN_VALID, F.coalesce(c("h") < MIN_HEIGHT, ~no), F.coalesce(c("spread") / c("length") > MAX_SPREAD, ~no), F.coalesce(c("zone_ground") < MIN_GROUND, ~no),
    )
    gate = F.when(tests[0], VARIANT_GATES[0]).when(tests[1], c("rejection"))
    for test, name in zip(tests[2:], VARIANT_GATES[2:], strict=True):
        gate = gate.when(test, name)
    usable = c("ok") & c("rejection").isNull()
    return out.withColumns({"gate": gate, "usable": usable, "with_truth": usable & c("h").isNotNull() & (c("valid_fraction") >= MIN_VALID) & ~merged})


def variant_summary(judged: DataFrame, keys: Sequence[str] = ("mode", "gap", "isolation", "merged_check"), tile: str = "tile", city: str = "city") -> DataFrame:
    """A row for each variant and city, and for all cities together (city `combined`): rates, medians, references, and the error of heights from references' scale.

    A tile with MIN_REFERENCES eligible buildings has a scale: the median ratio of its REFERENCES first ones by spread, area and key; errors are of its
    other buildings with truth. Only the first eligible buildings of each tile are ranked; rows that agree in what is asked of them become one with their
    number before anything is summed up for a city and for all. Errors are written once, without a shuffle; medians hold no group's values in memory.
    """
    c = F.col
    at, rel = [*keys, city, tile], c("spread") / c("length")
    place = F.struct(rel.alias("rel"), c("area").isNull().alias("no_area"), (-c("area")).alias("area"), c("id").alias("id"))
    w = Window.partitionBy(*at).orderBy("_at")
    first = judged.where("gate is null").select(*at, place.alias("_at"), "h", "length", "with_truth").withColumn("_rank", F.rank().over(w)).where(c("_rank") <= REFERENCES)
    first = cut(first.withColumn("_k", F.row_number().over(w)))  # more than REFERENCES of a tile only where ids repeat
    scale = F.percentile(F.when(c("_k") <= REFERENCES, c("h") / c("length")), 0.5)
    tiles = cut(first.groupBy(*at).agg(scale.alias("_scale"), F.max("_at").alias("_last"), F.count("*").alias("_n")).where(c("_n") >= MIN_REFERENCES).drop("_n"))
    to = light(tiles.select(F.struct(*at).alias("_tile"), "_scale", "_last"))
    e = (c("_scale") * c("length") - c("h")).alias("e")
    others = judged.where("with_truth").withColumns({"_tile": F.struct(*at), "_at": place}).join(to, "_tile").where(c("gate").isNotNull() | (c("_at") > c("_last"))).select(*keys, city, e)
    repeated = first.where((c("_k") > REFERENCES) & c("with_truth")).withColumn("_tile", F.struct(*at)).join(to, "_tile").select(*keys, city, e)
    asked = {"hit": c("hit_fraction"), "rel": F.when(c("usable"), rel), "merged": F.when(c("usable"), c("merged") > 0.5), "ok": c("ok"), "usable": c("usable"), "fit": c("gate").isNull()}
    rates = judged.select(*keys, city, *(v.alias(k) for k, v in asked.items())).groupBy(*keys, city, *asked).agg(F.count("*").alias("n"))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, c("n"))), F.lit(0))
    sums = {"buildings": F.sum("n"), "measured_ok": n(c("ok")), "usable": n(c("usable")), "_high": n(c("rel") > MAX_SPREAD), "_rel": n(c("rel").isNotNull()), "_merged": n(c("merged")), "_of": n(c("merged").isNotNull()), "eligible_references": n(c("fit"))}
    of = {"median_hit_fraction": "hit", "median_relative_spread": "rel", "median_ae_m": "e"}
    with kept(rates, "variant-rates") as rates, kept(others.unionAll(repeated).where("e is not null"), "variant-errors") as errors:
        r = rates.groupBy(*keys, city).agg(*(v.alias(k) for k, v in sums.items()))
        r = r.unionByName(errors.groupBy(*keys, city).agg(F.count("*").alias("n_errors"), F.sum(F.abs("e")).alias("_abs"), F.sum("e").alias("_e")), allowMissingColumns=True)
        r = cut(r.unionByName(tiles.groupBy(*keys, city).agg(F.count("*").alias("tiles_with_references")), allowMissingColumns=True))
        v = rates.select(*keys, city, F.explode(F.array(*(F.struct(F.lit(k).alias("_of"), c(f).alias("_v")) for k, f in of.items() if f != "e"))).alias("_m"), "n").select(*keys, city, "_m.*", "n")
        v = v.unionByName(errors.select(*keys, city, F.lit("median_ae_m").alias("_of"), F.abs("e").alias("_v"), F.lit(1).cast("long").alias("n")))
        middle = cut(medians(v, ["_of", *keys], city, "_v", "n"))
    total = lambda k: F.coalesce(F.sum(k), F.lit(0)).alias(k)
    out = r.groupingSets([[c(k) for k in (*keys, city)], [c(k) for k in keys]], *keys, city).agg(
        F.sum("buildings").alias("buildings"), total("measured_ok"), total("usable"), F.try_divide(F.sum("_high"), F.sum("_rel")).alias("high_spread_fraction"), F.try_divide(F.sum("_merged"), F.sum("_of")).alias("merged_fraction_of_usable"),
        total("eligible_references"), total("tiles_with_references"), total("n_errors"), F.try_divide(F.sum("_abs"), F.sum("n_errors")).alias("mae_m"), F.try_divide(F.sum("_e"), F.sum("n_errors")).alias("bias_m"), F.grouping(city).cast("int").alias("_all"),
    )
    group = F.struct(*keys, "_all", city).alias("_g")  # nulls are equal in it
    middle = middle.groupBy(group).agg(*(F.max(F.when(c("_of") == k, c("median"))).alias(k) for k in of))
    out = out.withColumn("_g", group).join(middle, "_g", "left").withColumn(city, F.when(c("_all") == 1, "combined").otherwise(c(city).cast("string")))
    return out.select(*keys, city, "buildings", "measured_ok", "usable", "median_hit_fraction", "median_relative_spread", "high_spread_fraction", "merged_fraction_of_usable", "eligible_references", "tiles_with_references", "n_errors", "mae_m", "median_ae_m", "bias_m")
