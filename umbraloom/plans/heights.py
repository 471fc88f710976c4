"""From a scene's pixels and footprints to building heights, as one plan.

detect -> launch -> cast -> measure -> invert; the detector may be any function from pixels to pixels with is_shadow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraloom.functions.geometry import height_from_shadow, pixels_to_metres
from umbraloom.operators.lineage import cut
from umbraloom.operators.radiometry import detect_shadow
from umbraloom.operators.rays import cast_rays, launch_pixels, measure, merged_fraction, shadow_gate

BY = ["scene_id", "building_id"]


def require(**given) -> None:
    """Refuses a run without ground distance or sun angles: nothing is invented."""
    missing = [k for k, v in given.items() if v is None]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")


def shadow_heights(pixels: DataFrame, footprints: DataFrame, gsd: float | None, sun_elevation: float | None, sun_azimuth: float | None, height: int, width: int, detector: Callable[[DataFrame], DataFrame] | None = None, max_rays: int = 512, max_length_px: float | None = None, uncertainty_px: float = 0.5) -> DataFrame:
    """A row for each building: length, height, uncertainty, confidence with reasons, and rejection.

    pixels: (scene_id, row, col, v) with v of 0 to 255; footprints: (scene_id, building_id, row, col).
    """
    require(gsd=gsd, sun_elevation=sun_elevation, sun_azimuth=sun_azimuth)
    found = (detector or (lambda p: detect_shadow(p, ["scene_id"])))(pixels)
    shadow = found.where("is_shadow").select("scene_id", "row", "col")
    az = F.lit(float(sun_azimuth))
    rays = cut(cast_rays(launch_pixels(footprints, BY, az, max_rays), BY, shadow, footprints, az, height, width, max_length_px))  # read twice below
    got = measure(rays, BY).join(merged_fraction(rays, BY, footprints, az), BY, "left")
    metres = pixels_to_metres("length_px", F.lit(gsd))
    est = height_from_shadow(metres, F.lit(float(sun_elevation)), F.lit(uncertainty_px * gsd), F.col("reduced_reasons"))
    got = got.withColumns({"length_m": metres, "_e": est}).select("*", "_e.*").drop("_e")
    ok = F.col("failure_reason").isNull()
    got = got.withColumns({c: F.when(ok, F.col(c)) for c in ("height_m", "uncertainty_m", "confidence", "reasons")})
    return shadow_gate(got)
