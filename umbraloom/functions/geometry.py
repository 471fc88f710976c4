"""Sun, shadow and grid geometry as column expressions.

Angles are degrees. Azimuths run clockwise from north; rows grow to the south and columns to the east. What cannot be computed is
null; the checked_ functions raise instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbraloom.functions.values import col

#: The usable band of sun elevations, both ends included.
SUN_BAND_MIN, SUN_BAND_MAX = 25.0, 45.0
#: WGS84 semi-major axis and first eccentricity squared.
WGS84_A, WGS84_E2 = 6378137.0, 0.00669437999014


def finite(x) -> Column:
    """The value as a double, null where it is NaN or infinite."""
    x = col(x).cast("double")
    return F.when(F.abs(x) < float("inf"), x)  # NaN is greater than infinity here


def elevation(x) -> Column:
    """A sun elevation in (0, 90], else null."""
    x = col(x).cast("double")
    return F.when((x > 0) & (x <= 90), x)


def checked_elevation(x) -> Column:
    x = col(x)
    return F.when(elevation(x).isNull(), F.raise_error(F.concat(F.lit("sun elevation must be in (0, 90] degrees, got "), F.coalesce(x.cast("string"), F.lit("null")))).cast("double")).otherwise(elevation(x))


def _tan(el: Column) -> Column:
    return F.tan(F.radians(el))


def shadow_length_m(height, sun_elevation) -> Column:
    """Length of the shadow of a height; 0 with the sun overhead; null for a negative height."""
    h, el = col(height).cast("double"), elevation(sun_elevation)
    return F.when((h >= 0) & (h < float("inf")), F.when(el == 90, F.lit(0.0)).otherwise(F.try_divide(h, _tan(el))))


def height_from_shadow_length_m(length, sun_elevation) -> Column:
    length = col(length).cast("double")
    return F.when((length >= 0) & (length < float("inf")), length * _tan(elevation(sun_elevation)))


def height_uncertainty_m(sun_elevation, length_uncertainty) -> Column:
    return height_from_shadow_length_m(length_uncertainty, sun_elevation)


def shadow_azimuth_deg(sun_azimuth) -> Column:
    return F.pmod(finite(sun_azimuth) + 180.0, F.lit(360.0))


def shadow_direction_unit(sun_azimuth) -> Column:
    """struct(east, north) of unit length."""
    az = F.radians(shadow_azimuth_deg(sun_azimuth))
    return F.struct(F.sin(az).alias("east"), F.cos(az).alias("north"))


def shadow_direction_pixels(sun_azimuth) -> Column:
    """struct(d_row, d_col) of unit length."""
    az = F.radians(shadow_azimuth_deg(sun_azimuth))
    return F.struct((-F.cos(az)).alias("d_row"), F.sin(az).alias("d_col"))


def shadow_pixel_offset(height, sun_elevation, sun_azimuth, gsd) -> Column:
    """struct(d_row, d_col) from the base of a wall to the tip of its shadow, in pixels."""
    length, az = F.try_divide(shadow_length_m(height, sun_elevation), col(gsd)), F.radians(shadow_azimuth_deg(sun_azimuth))
    return F.struct((-F.cos(az) * length).alias("d_row"), (F.sin(az) * length).alias("d_col"))


def sun_band_status(sun_elevation, low: float = SUN_BAND_MIN, high: float = SUN_BAND_MAX) -> Column:
    """struct(status, reason): below, within or above the band; a reason unless within. Nothing is rejected."""
    el = finite(sun_elevation)
    status = F.when(el < low, "below").when(el > high, "above").when(el.isNotNull(), "within")
    reason = F.when(status != "within", F.concat(F.lit("sun elevation is "), status, F.lit(f" the band of {low:g} to {high:g} degrees"))).when(status.isNull(), "sun elevation is unknown")
    return F.struct(status.alias("status"), reason.alias("reason"))


def pixels_to_metres(length_px, gsd) -> Column:
    return finite(length_px) * finite(gsd)


def height_from_shadow(length, sun_elevation, length_uncertainty=None, extra_reasons=None, low: float = SUN_BAND_MIN, high: float = SUN_BAND_MAX) -> Column:
    """struct(height_m, uncertainty_m, band, confidence, reasons): REDUCED if there is any reason, else NOMINAL."""
    band = sun_band_status(sun_elevation, low, high)
    extra = F.coalesce(extra_reasons, F.array().cast("array<string>")) if extra_reasons is not None else F.array().cast("array<string>")
    reasons = F.concat(F.array_compact(F.array(band["reason"])), extra)
    dh = height_uncertainty_m(sun_elevation, length_uncertainty) if length_uncertainty is not None else F.lit(None).cast("double")
    return F.struct(height_from_shadow_length_m(length, sun_elevation).alias("height_m"), dh.alias("uncertainty_m"), band["status"].alias("band"), F.when(F.size(reasons) > 0, "REDUCED").otherwise("NOMINAL").alias("confidence"), reasons.alias("reasons"))


def angular_difference_deg(a, b) -> Column:
    """The smaller angle between two bearings, 0 to 180."""
    d = F.pmod(F.abs(finite(a) - finite(b)), F.lit(360.0))
    return F.least(d, 360.0 - d)


def angular_resolution_deg(band_px: float) -> float:
    """Bearings closer than this move no pixel of a band that wide."""
    return math.degrees(math.atan2(0.5, band_px))


def explicit_grid_dl_px(sun_azimuth) -> Column:
    """Half the distance between pixel centres along a shadow's direction: what a length on the grid cannot tell."""
    az = F.radians(finite(sun_azimuth))
    return 0.5 / F.greatest(F.abs(F.sin(az)), F.abs(F.cos(az)))


def scale_from_known_geometry(gsd, sun_elevation) -> Column:
    """Metres of height for each pixel of shadow."""
    return finite(gsd) * _tan(elevation(sun_elevation))


def pixel_to_map(t: Column, c, r) -> Column:
    """struct(x, y) of a pixel corner; t is struct(a, b, c, d, e, f). Pixel centres are at +0.5."""
    c, r = col(c), col(r)
    return F.struct((t["a"] * c + t["b"] * r + t["c"]).alias("x"), (t["d"] * c + t["e"] * r + t["f"]).alias("y"))


def translate_transform(t: Column, col_off, row_off) -> Column:
    at = pixel_to_map(t, col_off, row_off)
    return F.struct(t["a"].alias("a"), t["b"].alias("b"), at["x"].alias("c"), t["d"].alias("d"), t["e"].alias("e"), at["y"].alias("f"))


def map_to_pixel(t: Column, x, y) -> Column:
    """struct(col, row) as fractions; null if the transform has no inverse."""
    det, dx, dy = t["a"] * t["e"] - t["b"] * t["d"], col(x) - t["c"], col(y) - t["f"]
    return F.struct(F.try_divide(t["e"] * dx - t["b"] * dy, det).alias("col"), F.try_divide(t["a"] * dy - t["d"] * dx, det).alias("row"))


def map_to_pixel_index(t: Column, x, y, width, height) -> Column:
    """struct(col, row) as the integers below; null outside of the raster."""
    p = map_to_pixel(t, x, y)
    c, r = F.floor(p["col"]).cast("int"), F.floor(p["row"]).cast("int")
    return F.when((c >= 0) & (r >= 0) & (c < col(width)) & (r < col(height)), F.struct(c.alias("col"), r.alias("row")))


def bounds(t: Column, width, height) -> Column:
    """struct(left, bottom, right, top) around all four corners."""
    w, h = col(width), col(height)
    xs = [t["c"], t["c"] + t["a"] * w, t["c"] + t["b"] * h, t["c"] + t["a"] * w + t["b"] * h]
    ys = [t["f"], t["f"] + t["d"] * w, t["f"] + t["e"] * h, t["f"] + t["d"] * w + t["e"] * h]
    return F.struct(F.least(*xs).alias("left"), F.least(*ys).alias("bottom"), F.greatest(*xs).alias("right"), F.greatest(*ys).alias("top"))


def metres_per_degree(latitude) -> Column:
    """struct(lat, lon): metres of one degree on the WGS84 ellipsoid, from its radii of curvature."""
    s = F.sin(F.radians(finite(latitude)))
    w = 1 - WGS84_E2 * s * s
    rad = math.pi / 180
    return F.struct((F.lit(WGS84_A * (1 - WGS84_E2) * rad) / F.pow(w, F.lit(1.5))).alias("lat"), (F.lit(WGS84_A * rad) * F.cos(F.radians(finite(latitude))) / F.sqrt(w)).alias("lon"))


def gsd_m(t: Column, geographic, latitude=None, unit_m=1.0) -> Column:
    """Ground distance of a pixel: the mean of the lengths of its sides, for square pixels their length."""
    u = col(unit_m) if not isinstance(unit_m, float) else F.lit(unit_m)
    m = metres_per_degree(latitude if latitude is not None else F.lit(0.0))
    fx, fy = F.when(col(geographic), m["lon"]).otherwise(u), F.when(col(geographic), m["lat"]).otherwise(u)
    return (F.hypot(t["a"] * fx, t["d"] * fy) + F.hypot(t["b"] * fx, t["e"] * fy)) / 2


def utm_forward(lon, lat, zone) -> Column:
    """struct(easting, northing) on WGS84 by the transverse Mercator series; exact to under a millimetre inside a zone."""
    a, e2 = WGS84_A, WGS84_E2
    ep2, k0 = e2 / (1 - e2), 0.9996
    phi = F.radians(col(lat))
    lam = F.radians(col(lon) - (col(zone) * 6.0 - 183.0))
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi)
    n, t2, c2, aa = a / F.sqrt(1 - e2 * s * s), t * t, ep2 * c * c, lam * c
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi))
    east = k0 * n * (aa + (1 - t2 + c2) * F.pow(aa, F.lit(3.0)) / 6 + (5 - 18 * t2 + t2 * t2 + 72 * c2 - 58 * ep2) * F.pow(aa, F.lit(5.0)) / 120) + 500000.0
    north = k0 * (m + n * t * (aa * aa / 2 + (5 - t2 + 9 * c2 + 4 * c2 * c2) * F.pow(aa, F.lit(4.0)) / 24 + (61 - 58 * t2 + t2 * t2 + 600 * c2 - 330 * ep2) * F.pow(aa, F.lit(6.0)) / 720))
    return F.struct(east.alias("easting"), F.when(col(lat) < 0, north + 10000000.0).otherwise(north).alias("northing"))


def utm_inverse(easting, northing, zone, south=None) -> Column:
    """struct(lon, lat) of a WGS84 UTM position."""
    a, e2 = WGS84_A, WGS84_E2
    ep2, k0, e1 = e2 / (1 - e2), 0.9996, (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    north = col(northing) - (F.when(col(south), 10000000.0).otherwise(0.0) if south is not None else F.lit(0.0))
    mu = north / k0 / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    phi = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi)
    w = 1 - e2 * s * s
    n, r, t2, c2 = a / F.sqrt(w), a * (1 - e2) / F.pow(w, F.lit(1.5)), t * t, ep2 * c * c
    d = (col(easting) - 500000.0) / (n * k0)
    lat = phi - (n * t / r) * (d * d / 2 - (5 + 3 * t2 + 10 * c2 - 4 * c2 * c2 - 9 * ep2) * F.pow(d, F.lit(4.0)) / 24 + (61 + 90 * t2 + 298 * c2 + 45 * t2 * t2 - 252 * ep2 - 3 * c2 * c2) * F.pow(d, F.lit(6.0)) / 720)
    lon = (d - (1 + 2 * t2 + c2) * F.pow(d, F.lit(3.0)) / 6 + (5 - 2 * c2 + 28 * t2 - 3 * c2 * c2 + 8 * ep2 + 24 * t2 * t2) * F.pow(d, F.lit(5.0)) / 120) / c
    return F.struct((F.degrees(lon) + (col(zone) * 6.0 - 183.0)).alias("lon"), F.degrees(lat).alias("lat"))


def centre_lonlat(t: Column, width, height, zone=None, south=None) -> Column:
    """struct(lon, lat) of a raster's centre: of its own coordinates, or of its UTM zone."""
    c = pixel_to_map(t, col(width) / 2, col(height) / 2)
    return F.struct(c["x"].alias("lon"), c["y"].alias("lat")) if zone is None else utm_inverse(c["x"], c["y"], zone, south)


def georeference_reason(crs, transform: Column, width, height) -> Column:
    """Why a grid does not say where it lies on the Earth, or null."""
    t, c = transform, col(crs)
    same = lambda k, v: t[k] == v
    identity = same("a", 1) & same("b", 0) & same("c", 0) & same("d", 0) & same("e", 1) & same("f", 0)
    return (
        F.when(c.isNull() | (c == ""), "no CRS").when(t.isNull() | identity, "no spatial transform").when(t["a"] * t["e"] - t["b"] * t["d"] == 0, "degenerate transform")
        .when((col(width) <= 0) | (col(height) <= 0), "invalid dimensions")
    )


def sample_xz(transform: Column, row, column, origin_x, origin_y) -> Column:
    """struct(x, z): a pixel centre in the scene's horizontal coordinates, z to the south."""
    p = pixel_to_map(transform, col(column) + 0.5, col(row) + 0.5)
    return F.struct((p["x"] - col(origin_x)).alias("x"), (col(origin_y) - p["y"]).alias("z"))


def world_to_map(x, z, origin_x, origin_y) -> Column:
    """struct(x, y) in map coordinates of a point in the scene's."""
    return F.struct((col(x) + col(origin_x)).alias("x"), (col(origin_y) - col(z)).alias("y"))


def world_y_to_value(y, vertical_scale) -> Column:
    return F.try_divide(col(y), col(vertical_scale))
