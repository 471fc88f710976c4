"""Pixel values: unit scale, value and saturation, stretch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbraloom.functions.values import col, not_finite

#: Largest value of each integer kind of pixel.
FULL_SCALE = {"uint8": 255.0, "uint16": 65535.0}


def unit_float(x, kind: str, observed_max=None) -> Column:
    """A pixel between 0 and 1: integers by their kind's full scale, floats by the largest one seen if that is over 1."""
    if kind in FULL_SCALE:
        return col(x) / FULL_SCALE[kind]
    top = col(observed_max)
    return F.when(top > 1, F.try_divide(col(x), top)).otherwise(col(x))


def value_saturation(r, g, b) -> Column:
    """struct(v, s): the largest channel, and its distance to the smallest as a share; 0 for black."""
    top, low = F.greatest(col(r), col(g), col(b)), F.least(col(r), col(g), col(b))
    return F.struct(top.alias("v"), F.coalesce(F.try_divide(top - low, top), F.lit(0.0)).alias("s"))


def value_u8(v) -> Column:
    return F.rint(col(v) * 255).cast("int")


def stretched(x, low, high, degenerate, full: float = 255.0) -> Column:
    """rint(clip((x - low) / (high - low)) * full): NaN, null and -inf become 0, +inf the full value; 0 for a flat band."""
    x, low, high = col(x).cast("double"), col(low), col(high)
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(x - low, high - low)))
    return F.when(F.coalesce(col(degenerate), F.lit(True)), 0).when(x == float("inf"), full).when(not_finite(x), 0).otherwise(F.rint(share * full)).cast("int")
