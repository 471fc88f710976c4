"""Values with reasons, labels, units, states and colours as column expressions.

A value that cannot be computed is null and comes with a reason; it never is 0 or a default.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower edges of the height groups and their labels.
HEIGHT_GROUPS = ((0.0, "0-5 m"), (5.0, "5-10 m"), (10.0, "10-20 m"), (20.0, ">=20 m"))
#: Confidence states and their codes.
CONFIDENCE = {"INVALID": 0, "UNSUITABLE": 1, "REDUCED": 2, "NOT_ASSESSED": 3, "HIGH": 4}
#: Least ratio of a slope to its standard error that identifies it.
IDENTIFIABLE_T = 2.0
#: Exclusion reasons in their order of precedence.
EXCLUSIONS = ("prediction_nodata", "prediction_nonfinite", "reference_nodata", "reference_nonfinite", "reference_invalid", "outside_region", "excluded")


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def metric_value(value: Column, units: str, n: Column, reason: Column) -> Column:
    """struct(value, units, n, reason): either a value or a reason."""
    return F.struct(value.alias("value"), F.lit(units).alias("units"), n.cast("long").alias("n"), F.when(value.isNull(), F.coalesce(reason, F.lit("not yet measured"))).alias("reason"))


def equals_nodata(x, nodata) -> Column:
    """Whether a value is the nodata value, which may be NaN; never without one."""
    x, nodata = col(x), col(nodata)
    return F.coalesce(F.when(F.isnan(nodata), F.isnan(x)).otherwise(x == nodata), F.lit(False))


def not_finite(x) -> Column:
    x = col(x)
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def exclusion_reason(prediction, reference, prediction_nodata=None, reference_nodata=None, reference_valid=None, region=None, exclude=None) -> Column:
    """The first test that excludes a pixel, or null for a valid one."""
    no = F.lit(False)
    tests = (
        equals_nodata(prediction, prediction_nodata) if prediction_nodata is not None else no,
        not_finite(prediction),
        equals_nodata(reference, reference_nodata) if reference_nodata is not None else no,
        not_finite(reference),
        ~F.coalesce(col(reference_valid), F.lit(False)) if reference_valid is not None else no,
        ~F.coalesce(col(region), F.lit(False)) if region is not None else no,
        F.coalesce(col(exclude), F.lit(False)) if exclude is not None else no,
    )
    out = F.when(tests[0], EXCLUSIONS[0])
    for test, name in zip(tests[1:], EXCLUSIONS[1:], strict=True):
        out = out.when(test, name)
    return out


def category_of(label, terrain: tuple[int, ...], building: tuple[int, ...]) -> Column:
    """terrain, building or null by class membership; a class may not be in both."""
    if set(terrain) & set(building):
        raise ValueError(f"classes in both categories: {sorted(set(terrain) & set(building))}")
    return F.when(col(label).isin(*terrain), "terrain").when(col(label).isin(*building), "building")


def confidence_state(valid, shadow=None, water=None, sun_elevation=None, low: float = 25.0, high: float = 45.0) -> Column:
    """INVALID over UNSUITABLE (water) over REDUCED (shadow, or sun outside of the band); else HIGH if all three inputs are there, else NOT_ASSESSED."""
    null = F.lit(None)
    shadow, water, sun = (col(x) if x is not None else null for x in (shadow, water, sun_elevation))
    off = (sun < low) | (sun > high)
    checked = shadow.isNotNull() & water.isNotNull() & sun.isNotNull()
    return (
        F.when(~F.coalesce(col(valid), F.lit(False)), "INVALID").when(F.coalesce(water.cast("boolean"), F.lit(False)), "UNSUITABLE")
        .when(F.coalesce(shadow.cast("boolean"), F.lit(False)) | F.coalesce(off, F.lit(False)), "REDUCED").when(checked, "HIGH").otherwise("NOT_ASSESSED")
    )


def confidence_code(state) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), col(state)).cast("tinyint")


def height_group(h) -> Column:
    """The label of a height's half-open bin; negative heights are in the lowest, null, NaN and infinity are no buildings."""
    h = col(h)
    out = F.when(not_finite(h), "no buildings")
    for low, label in reversed(HEIGHT_GROUPS[1:]):
        out = out.when(h >= low, label)
    return out.otherwise(HEIGHT_GROUPS[0][1])


def classify_fit(a, se_a, threshold: float = IDENTIFIABLE_T) -> Column:
    a, se = col(a), col(se_a)
    return F.when(a.isNull(), None).when(a <= 0, "non_positive").when(F.coalesce(F.try_divide(a, se) >= threshold, F.lit(False)), "identifiable_positive").otherwise("statistically_weak")


def classify_failure(reason) -> Column:
    """insufficient_constraints if the text says that there were too few, else numerically_unstable."""
    return F.when(F.lower(col(reason)).rlike("underdetermined|at most|need at least"), "insufficient_constraints").otherwise("numerically_unstable")


def log_height(h, epsilon: float = 1.0) -> Column:
    """log(h + epsilon), continued below 0 as an odd function around log(epsilon)."""
    h = col(h)
    return F.when(h >= 0, F.log(h + epsilon)).otherwise(2 * F.log(F.lit(epsilon)) - F.log(epsilon - h))


def linearise_relative(z, limit: float = 709.0) -> Column:
    """exp(z); null where that overflows or z is not finite."""
    z = col(z)
    return F.when(~not_finite(z) & (z <= limit), F.exp(z))


def apply_affine(r, a, b) -> Column:
    return col(a) * col(r) + col(b)


def checked_calibration(a, b, require_positive_scale: bool = True) -> tuple[Column, Column]:
    """Both parameters of a calibration as numbers, or an error: not real, not finite, or a scale that is not above zero (heights would fall as the relative ones rise),
    unless that is allowed. Given as numbers they are refused at once, as columns where a row shows it."""
    if isinstance(a, Column) or isinstance(b, Column):
        a, b = (v if isinstance(v, Column) else F.lit(v) for v in (a, b))
        text = lambda what: F.raise_error(F.concat(F.lit(f"calibration parameters must be {what}: a="), F.coalesce(a.cast("string"), F.lit("null")), F.lit(", b="), F.coalesce(b.cast("string"), F.lit("null")))).cast("double")
        bad = F.when(not_finite(a.cast("double")) | not_finite(b.cast("double")), text("finite"))
        if require_positive_scale:
            bad = bad.when(a <= 0, text("of a positive scale"))
        return bad.otherwise(a.cast("double")), b.cast("double")
    try:
        a, b = float(a), float(b)
    except (TypeError, ValueError) as e:
        raise ValueError(f"calibration parameters must be real numbers: a={a!r}, b={b!r}") from e
    if not (math.isfinite(a) and math.isfinite(b)):
        raise ValueError(f"calibration parameters must be finite: a={a}, b={b}")
    if require_positive_scale and a <= 0:
        raise ValueError(f"calibration parameters must be of a positive scale: a={a}, b={b}")
    return F.lit(a), F.lit(b)


def calibrated_agl(z, a, b, valid=True) -> Column:
    """a * exp(z) + b for a positive finite scale, where valid."""
    ok = col(valid) & (col(a) > 0) & ~not_finite(a) & ~not_finite(b)
    return F.when(ok, apply_affine(linearise_relative(z), a, b))


def normalised_channel(x, mean, std) -> Column:
    return (col(x) / 255.0 - col(mean)) / col(std)


def denormalised_channel(x, mean, std) -> Column:
    return (col(x) * col(std) + col(mean)) * 255.0


def mode_units(mode, metric_product) -> Column:
    """m only for an absolute metric product, else unitless."""
    return F.when((col(mode) == "ABSOLUTE") & col(metric_product), "m").otherwise("unitless")


def inferred_product_type(tags) -> Column:
    """dsm, dtm, ndsm, error, confidence or relative from a map of tags, else null."""
    t = F.lower(F.coalesce(F.element_at(col(tags), "PRODUCT"), F.element_at(col(tags), "product"), F.element_at(col(tags), "PRODUCT_TYPE")))
    return F.when(t.isin("dsm", "dtm", "ndsm", "error", "confidence", "relative"), t)


def reconciled_product_type(expected, declared) -> Column:
    """struct(product_type, reason): the one type that both give; a conflict is a reason."""
    e, d = col(expected), col(declared)
    clash = e.isNotNull() & d.isNotNull() & (e != d)
    return F.struct(F.when(~clash | clash.isNull(), F.coalesce(e, d)).alias("product_type"), F.when(clash, F.concat(F.lit("expected "), e, F.lit(" but the file says "), d)).alias("reason"))


def diverging_color(value, limit) -> Column:
    """array(r, g, b), 0 to 255: blue below zero, white at zero, red above, full at the limit; null without a value."""
    v = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.try_divide(col(value), col(limit))))
    fade = F.rint(255 * (1 - F.abs(v))).cast("int")
    full = F.lit(255)
    return F.when(v.isNotNull(), F.when(v >= 0, F.array(full, fade, fade)).otherwise(F.array(fade, fade, full)))


def composite(base, overlay, opacity) -> Column:
    """The blend of two channels; the base where the overlay has no value."""
    return F.rint(F.when(col(overlay).isNull(), col(base)).otherwise(col(base) * (1 - col(opacity)) + col(overlay) * col(opacity))).cast("int")


def overlay_reason(surface: Column, diagnostic: Column) -> Column:
    """Why a diagnostic layer may not lie over a surface, or null: both are struct(path, product_type, width, height, transform array)."""
    apart = F.exists(F.zip_with(surface["transform"], diagnostic["transform"], lambda a, b: F.abs(a - b) > 1e-9), lambda x: x)
    return (
        F.when(surface["product_type"] != "dsm", "the surface is not a DSM").when(diagnostic["path"].isNull(), "no such product")
        .when((surface["width"] != diagnostic["width"]) | (surface["height"] != diagnostic["height"]), "sizes differ").when(apart, "grids differ")
    )
