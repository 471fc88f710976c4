"""Error metrics as one mergeable aggregation: MAE, RMSE, bias, Pearson r, delta accuracy, log-space errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbraloom.functions.values import col, not_finite

#: Ratios of the delta accuracies, and fewest pixels for a correlation.
DELTAS = (1.25, 1.25**2, 1.25**3)
MIN_PEARSON = 3


def pearson(p, r, least: int = MIN_PEARSON) -> Column:
    """r between -1 and 1; null for fewer than `least` rows or a side without spread."""
    p, r = col(p), col(r)
    value = F.try_divide(F.covar_pop(p, r), F.stddev_pop(p) * F.stddev_pop(r))
    return F.when((F.count(p) >= least) & (F.min(p) < F.max(p)) & (F.min(r) < F.max(r)), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def metric_columns(p: str = "p", r: str = "r", deltas: Sequence[float] = DELTAS) -> list[Column]:
    """Aggregates over valid rows: Spark adds them up partially on each executor, and shuffles a row for each group and task."""
    e, dom = F.col(p) - F.col(r), (F.col(p) > 0) & (F.col(r) > 0)
    ratio = F.when(dom, F.greatest(F.try_divide(F.col(p), F.col(r)), F.try_divide(F.col(r), F.col(p))))
    n_dom = F.count(F.when(dom, 1))
    return [
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.max(F.abs(e)).alias("max_abs"), pearson(p, r).alias("pearson"),
        n_dom.alias("n_delta_domain"), *(F.try_divide(F.count(F.when(ratio < d, 1)), n_dom).alias(f"delta_{k}") for k, d in enumerate(deltas, 1)),
    ]


def metrics(pixels: DataFrame, by: Sequence[str] = (), p: str = "p", r: str = "r", total: str | None = "overall", strict: bool = False) -> DataFrame:
    """Metrics by the columns `by`, with a row for all of them together, named `total`, from the same pass (grouping sets).

    Rows where either side is not finite are left out, or with strict raise an error.
    """
    bad = not_finite(p) | not_finite(r)
    if strict:
        pixels = pixels.withColumn(p, F.when(bad, F.raise_error("a metric's input is not finite").cast("double")).otherwise(F.col(p)))
    else:
        pixels = pixels.where(~bad)
    if not by:
        return pixels.agg(*metric_columns(p, r))
    if total is None:
        return pixels.groupBy(*by).agg(*metric_columns(p, r))
    sets = [[F.col(b) for b in by], []]
    out = pixels.groupingSets(sets, *by).agg(*metric_columns(p, r), F.grouping(by[0]).alias("_all"))
    return out.select(*(F.when(F.col("_all") == 1, total).otherwise(F.col(b).cast("string")).alias(b) for b in by), *(c for c in out.columns if c not in (*by, "_all")))


def exclusion_counts(pixels: DataFrame, reason: str = "reason") -> DataFrame:
    """(reason, n): each excluded pixel under its first reason, valid ones under `valid`."""
    return pixels.groupBy(F.coalesce(reason, F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def error_sums(pixels: DataFrame, by: Sequence[str], p: str = "p", r: str = "r") -> DataFrame:
    """Sufficient statistics (n, sum_abs, sum_sq, sum_err): add them up over any further key."""
    e = F.col(p) - F.col(r)
    return pixels.where(~(not_finite(p) | not_finite(r))).groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.abs(e)).alias("sum_abs"), F.sum(e * e).alias("sum_sq"), F.sum(e).alias("sum_err"))


def merged_errors(sums: DataFrame, by: Sequence[str], tile: str | None = None) -> DataFrame:
    """MAE, RMSE and bias from sufficient statistics, with the number of distinct tiles; null with a reason without any row."""
    n = F.sum("n")
    agg = [n.alias("n"), F.try_divide(F.sum("sum_abs"), n).alias("mae"), F.sqrt(F.try_divide(F.sum("sum_sq"), n)).alias("rmse"), F.try_divide(F.sum("sum_err"), n).alias("bias")]
    if tile:
        agg.append(F.countDistinct(tile).alias("tiles"))
    return sums.groupBy(*by).agg(*agg).withColumn("reason", F.when(F.coalesce("n", F.lit(0)) == 0, "not yet measured"))


def paired_gap(sums: DataFrame, control: DataFrame, by: Sequence[str], tile: str) -> DataFrame:
    """(by, tiles, mae_gap, rmse_gap): errors less those of a control, over the tiles that have both; null where either has no row.

    Both are sufficient statistics (by, tile, n, sum_abs, sum_sq, sum_err).
    """
    both = sums.select(tile).distinct().join(control.select(tile).distinct(), tile, "left_semi")
    a, b = (merged_errors(s.join(both, tile, "left_semi"), by, tile).select(*by, "tiles", *(F.col(c).alias(f"_{c}{k}") for c in ("mae", "rmse"))) for k, s in enumerate((sums, control)))
    return a.join(b.drop("tiles"), [*by], "left").select(*by, "tiles", *((F.col(f"_{c}0") - F.col(f"_{c}1")).alias(f"{c}_gap") for c in ("mae", "rmse")))


def scale_invariant_loss(pixels: DataFrame, sample: str, p: str = "p", r: str = "r", lam: float = 0.5, least: int = 32) -> DataFrame:
    """(sample, n, usable, loss): mean(d^2) - lam * mean(d)^2 of d = log p - log r, at least 0; a sample needs min(least, its pixels) valid ones."""
    ok = (F.col(p) > 0) & (F.col(r) > 0) & ~(not_finite(p) | not_finite(r))
    d = F.when(ok, F.log(F.when(ok, F.col(p))) - F.log(F.when(ok, F.col(r))))
    out = pixels.groupBy(sample).agg(F.count("*").alias("_all"), F.count(d).alias("n"), F.avg(d * d).alias("_sq"), F.avg(d).alias("_m"))
    usable = (F.col("n") >= F.least(F.lit(least), F.col("_all"))) & (F.col("n") > 0)
    return out.select(sample, "n", usable.alias("usable"), F.when(usable, F.greatest(F.lit(0.0), F.col("_sq") - lam * F.col("_m") * F.col("_m"))).alias("loss"))


def relative_metrics(pixels: DataFrame, by: str, p: str = "p", r: str = "r") -> DataFrame:
    """Metrics of a field without scale, after its mean log offset is taken out: si_rmse, log_rmse, abs_rel, deltas."""
    ok = pixels.where((F.col(p) > 0) & (F.col(r) > 0) & ~(not_finite(p) | not_finite(r)))
    shift = ok.groupBy(by).agg(F.avg(F.log(r) - F.log(p)).alias("_s"))
    d0 = F.log(p) - F.log(r)
    al = ok.join(F.broadcast(shift) if by == "_one" else shift, by).withColumn("_p", F.col(p) * F.exp("_s"))
    ratio = F.greatest(F.col("_p") / F.col(r), F.col(r) / F.col("_p"))
    return al.groupBy(by).agg(
        F.count("*").alias("n"), F.first("_s").alias("log_shift"), F.sqrt(F.greatest(F.lit(0.0), F.avg(d0 * d0) - F.pow(F.avg(d0), F.lit(2.0)))).alias("si_rmse"), F.sqrt(F.avg(d0 * d0)).alias("log_rmse"),
        F.avg(F.abs(F.col("_p") - F.col(r)) / F.col(r)).alias("abs_rel"), *(F.avg((ratio < t).cast("double")).alias(f"delta_{k}") for k, t in enumerate(DELTAS, 1)),
    )


def weighted_pool(batches: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """Weighted mean of batch values; batches that are NaN are skipped."""
    ok = ~not_finite(value) & (F.col(weight) > 0)
    w = F.sum(F.when(ok, F.col(weight)))
    return batches.groupBy(*by).agg(F.try_divide(F.sum(F.when(ok, F.col(value) * F.col(weight))), w).alias(value), w.alias(weight), F.count(F.when(~ok, 1)).alias("skipped"))


def pool_confidence(diagnostics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pixel counts of tiles' confidence states added up; a check without input in all tiles stays null; shares computed again."""
    states = [c for c in diagnostics.columns if c.startswith("n_")]
    out = diagnostics.groupBy(*by).agg(*(F.sum(c).alias(c) for c in states))
    total = sum((F.coalesce(c, F.lit(0)) for c in states), F.lit(0))
    return out.select("*", *(F.try_divide(F.col(c), total).alias(f"share_{c[2:]}") for c in states))
