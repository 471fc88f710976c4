"""Validation of a product: the split is audited first, then pixels are judged, counted and measured in one pass each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraloom.functions.values import category_of, confidence_state, exclusion_reason
from umbraloom.operators import metrics, splits

#: Label classes of terrain and of buildings.
TERRAIN, BUILDING = (2,), (6,)


class Refused(ValueError):
    """A validation that would not mean what it says."""


def audited(declared: DataFrame, pairs: DataFrame) -> None:
    bad = splits.audit_split(declared, pairs).where("not ok").collect()  # five rows at most
    if bad:
        raise Refused("; ".join(f"{r['check']}: {r['n']}" for r in bad))


def judged(pixels: DataFrame, prediction_nodata: float | None = None, reference_nodata: float | None = None) -> DataFrame:
    """The pixels (p, r, cls, and shadow, water, sun_elevation where known) with reason, category and confidence."""
    cols = set(pixels.columns)
    known = {k: F.col(k) for k in ("shadow", "water", "sun_elevation") if k in cols}
    out = pixels.withColumn("reason", exclusion_reason("p", "r", prediction_nodata, reference_nodata))
    return out.withColumns({"category": category_of("cls", TERRAIN, BUILDING), "confidence": confidence_state(F.col("reason").isNull(), **known)})


def product_metrics(pixels: DataFrame) -> DataFrame:
    """Metrics overall, by category and by confidence state, in one pass over grouping sets."""
    valid = pixels.where("reason is null")
    out = valid.groupingSets([[F.col("category")], [F.col("confidence")], []], "category", "confidence").agg(*metrics.metric_columns(), F.grouping_id().alias("_g"))
    kind = F.when(F.col("_g") == 1, F.concat(F.lit("category:"), F.coalesce("category", F.lit("other")))).when(F.col("_g") == 2, F.concat(F.lit("confidence:"), "confidence")).otherwise("overall")
    return out.select(kind.alias("group"), *(c for c in out.columns if c not in ("category", "confidence", "_g")))


def error_pixels(pixels: DataFrame) -> DataFrame:
    """prediction - reference where valid, else null."""
    return pixels.withColumn("error", F.when(F.col("reason").isNull(), F.col("p") - F.col("r")))


def validate(pixels: DataFrame, declared: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metrics, exclusion counts), or Refused."""
    audited(declared, pairs)
    j = judged(pixels)
    return product_metrics(j), metrics.exclusion_counts(j)
