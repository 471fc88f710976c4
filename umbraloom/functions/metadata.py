"""Key/value metadata: aliases by priority, numbers in text, sun angles, modes, paths."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbraloom.functions.values import col

#: Names under which sensors give the sun's angles, by priority; compared in normalised form.
SUN_ELEVATION_KEYS = ("SUN_ELEVATION_DEG", "SUN_ELEVATION", "SUN_ELEV", "SUNEL", "meanSunEl", "SOLAR_ELEVATION", "SUN_ELEVATION_ANGLE")
SUN_ZENITH_KEYS = ("MEAN_SUN_ZENITH_ANGLE", "SUN_ZENITH", "SUN_ZENITH_ANGLE", "SOLAR_ZENITH", "SOLAR_ZENITH_ANGLE")
SUN_AZIMUTH_KEYS = ("SUN_AZIMUTH_DEG", "SUN_AZIMUTH", "SUNAZ", "meanSunAz", "SOLAR_AZIMUTH", "MEAN_SUN_AZIMUTH_ANGLE", "SUN_AZIMUTH_ANGLE")
#: Suffixes of images that carry metadata, and of plain ones.
GEO_SUFFIXES, PLAIN_SUFFIXES = ("tif", "tiff"), ("png", "jpg", "jpeg", "bmp", "webp")


def normalised_key(k) -> Column:
    return F.regexp_replace(F.lower(col(k)), "[^a-z0-9]", "")


def first_number(raw) -> Column:
    """The first number in a text, thousands commas removed; null if there is none."""
    text = F.regexp_replace(col(raw).cast("string"), ",", "")
    return F.nullif(F.regexp_extract(text, r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?", 0), F.lit("")).cast("double")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def numbered(tables: Column) -> Column:
    """The tables' entries that hold a number, keys normalised: array<struct<label, entries>>, for all aliases at once."""
    read = lambda e: F.struct(normalised_key(e["key"]).alias("k"), first_number(e["value"]).alias("value"), e["key"].alias("key"), e["value"].alias("raw_value"))
    return F.transform(tables, lambda t: F.struct(t["label"].alias("label"), F.filter(F.transform(F.map_entries(t["table"]), read), lambda e: e["value"].isNotNull()).alias("entries")))


def resolved(numbers: Column, keys: tuple[str, ...]) -> Column:
    """The first hit in numbered tables: tables in order, aliases in order inside a table, entries in order inside an alias.

    struct(value, source, key, raw_value), or null; a value without a number is no hit."""
    names = F.array(*(F.lit(re.sub("[^a-z0-9]", "", k.lower())) for k in keys))

    def hits(t: Column, n: Column) -> Column:
        ranked = lambda e, i: F.struct(n.alias("table"), F.array_position(names, e["k"]).alias("alias"), i.alias("entry"), F.struct(e["value"].alias("value"), t["label"].alias("source"), e["key"].alias("key"), e["raw_value"].alias("raw_value")).alias("hit"))
        return F.filter(F.transform(t["entries"], ranked), lambda h: h["alias"] > 0)

    return F.array_min(F.flatten(F.transform(numbers, hits)))["hit"]


def resolved_sun(tables: Column) -> Column:
    """struct(elevation, azimuth), each struct(value, source, key, raw_value, conversion): both or neither. Without an elevation, 90 - zenith."""
    given = lambda s, v, how: F.struct(v.alias("value"), s["source"].alias("source"), s["key"].alias("key"), s["raw_value"].alias("raw_value"), F.lit(how).cast("string").alias("conversion"))

    def both(s: Column) -> Column:
        el, zen, az = s["el"], s["zen"], s["az"]
        elevation = F.when(el.isNotNull(), given(el, el["value"], None)).when(zen.isNotNull(), given(zen, 90.0 - zen["value"], "90 - zenith"))
        return F.when((el.isNotNull() | zen.isNotNull()) & az.isNotNull(), F.struct(elevation.alias("elevation"), given(az, az["value"], None).alias("azimuth")))

    found = lambda n: F.struct(resolved(n, SUN_ELEVATION_KEYS).alias("el"), resolved(n, SUN_ZENITH_KEYS).alias("zen"), resolved(n, SUN_AZIMUTH_KEYS).alias("az"))
    return bound(numbered(tables), lambda n: bound(found(n), both))


def required_sun(tables: Column, path=None) -> Column:
    """resolved_sun, or an error that names what is missing, the tables that were probed and the keys that were tried."""
    found = lambda n: F.struct((resolved(n, SUN_ELEVATION_KEYS).isNull() & resolved(n, SUN_ZENITH_KEYS).isNull()).alias("el"), resolved(n, SUN_AZIMUTH_KEYS).isNull().alias("az"))
    missing = bound(numbered(tables), lambda n: bound(found(n), lambda m: F.concat_ws(", ", F.when(m["el"], F.lit("sun_elevation_deg")), F.when(m["az"], F.lit("sun_azimuth_deg")))))
    probed = F.concat_ws(", ", F.transform(tables, lambda t: t["label"]))
    where = F.concat(F.lit(" in "), col(path)) if path is not None else F.lit("")
    tried = ", ".join((*SUN_ELEVATION_KEYS, *SUN_ZENITH_KEYS, *SUN_AZIMUTH_KEYS))
    told = F.concat(F.lit("missing: "), missing, where, F.lit("; probed: "), F.coalesce(F.nullif(probed, F.lit("")), F.lit("nothing")), F.lit(f"; tried: {tried}"))
    return bound(resolved_sun(tables), lambda s: F.when(s.isNotNull(), s).otherwise(F.when(F.raise_error(told).isNull(), s)))


def candidate_tables(default, domains=None, rpc=None, sidecars=None) -> Column:
    """Tag tables by priority as array<struct<label, table>>: default, domains in their order, RPC, sidecars; empty ones are left out.

    domains and sidecars: array<struct<name, table>>; of several domains of one name the first counts.
    """
    empty = F.array().cast("array<struct<name:string,table:map<string,string>>>")
    listed = lambda xs: empty if xs is None else F.coalesce(col(xs), empty)
    named = lambda prefix, xs: F.transform(xs, lambda d: F.struct(F.concat(F.lit(prefix), d["name"]).alias("label"), d["table"].alias("table")))
    single = lambda label, t: F.array(F.struct(F.lit(label).alias("label"), col(t).alias("table")))
    given = listed(domains)
    once = F.filter(given, lambda d, i: F.array_position(F.transform(given, lambda e: e["name"]), d["name"]) == i + 1)
    parts = [single("gdal:default", default), named("gdal:", once), *([] if rpc is None else [single("rpc", rpc)]), named("imd:", listed(sidecars))]
    return F.filter(F.concat(*parts), lambda t: F.coalesce(F.size(t["table"]), F.lit(0)) > 0)


def key_problems(settings, known: Sequence[str], required: Sequence[str] = ()) -> Column:
    """struct(unknown, missing) keys of a map of settings, sorted; a null map lacks all that is required."""
    keys = F.coalesce(F.map_keys(col(settings)), F.array().cast("array<string>"))
    texts = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    return F.struct(F.sort_array(F.array_except(keys, texts(known))).alias("unknown"), F.sort_array(F.array_except(texts(required), keys)).alias("missing"))


def suffix(path) -> Column:
    return F.lower(F.regexp_extract(col(path), r"\.([A-Za-z0-9]+)$", 1))


def route(path, crs, has_transform, sun_elevation, sun_azimuth) -> Column:
    """struct(mode, downgrade_reason): ABSOLUTE needs a metadata format, a CRS, a real transform and both sun angles."""
    s = suffix(path)
    reason = (
        F.when(s.isin(*PLAIN_SUFFIXES), "plain images carry no georeference").when(~s.isin(*GEO_SUFFIXES), "unsupported suffix")
        .when(col(crs).isNull(), "no CRS").when(~F.coalesce(col(has_transform), F.lit(False)), "no geotransform")
        .when(col(sun_elevation).isNull() | col(sun_azimuth).isNull(), "no sun angles")
    )
    return F.struct(F.when(reason.isNull(), "ABSOLUTE").otherwise("RELATIVE").alias("mode"), reason.alias("downgrade_reason"))


def required_mode(routed: Column, required: str) -> Column:
    """The mode, or an error if a stricter one is required."""
    return F.when((F.lit(required) == "ABSOLUTE") & (routed["mode"] != "ABSOLUTE"), F.raise_error(F.concat(F.lit("ABSOLUTE is required: "), routed["downgrade_reason"])).cast("string")).otherwise(routed["mode"])


def parsed_imd(text) -> Column:
    """map of `key = value;` lines; BEGIN_GROUP and END_GROUP lines are left out, quotes and semicolons stripped, the first of equal keys kept."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lines = F.filter(F.split(col(text), "\r?\n"), lambda x: x.contains("=") & ~F.upper(x).rlike(r"^\s*(BEGIN|END)_GROUP"))
    pairs = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, "=", 1)).alias("key"), F.regexp_replace(strip(F.regexp_replace(x, "^[^=]*=", "")), '^"|"?;?$', "").alias("value")))
    firsts = F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda a, p: F.when(F.exists(a, lambda q: q["key"] == p["key"]), a).otherwise(F.array_append(a, p)))
    return F.map_from_entries(firsts)


def normalised_path(p) -> Column:
    """Forward slashes, no empty or . parts, .. taken back, no leading slash."""
    parts = F.filter(F.split(F.regexp_replace(col(p), r"\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)))
    return F.array_join(kept, "/")


def scene_of(stem, pattern: str) -> Column:
    """struct(scene_id, city): groups 1 and 2 of a pattern; a stem that does not match is its own scene, without a city."""
    s = col(stem)
    hit = s.rlike(pattern)
    return F.struct(F.when(hit, F.regexp_extract(s, pattern, 1)).otherwise(s).alias("scene_id"), F.when(hit, F.regexp_extract(s, pattern, 2)).alias("city"))


def rpc_offsets(tables: Column) -> Column:
    """struct(line, samp, lat, long, height) of the first table that has an RPC's offsets, else null."""
    keys = ("LINE_OFF", "SAMP_OFF", "LAT_OFF", "LONG_OFF", "HEIGHT_OFF")
    has = F.try_element_at(F.filter(tables, lambda t: F.map_contains_key(t["table"], F.lit(keys[0])) & F.map_contains_key(t["table"], F.lit(keys[1]))), F.lit(1))
    given = F.struct(*(first_number(F.element_at(has["table"], k)).alias(k.split("_")[0].lower()) for k in keys))
    return F.when(has.isNotNull(), given)


def checked_keys(data: object, known: dict[str, bool], where: str) -> dict:
    """A mapping whose keys are all known (name -> whether it is required) and none that is required is missing; else an error that names them."""
    if not isinstance(data, dict):
        raise ValueError(f"{where}: expected a mapping, got {type(data).__name__}")
    unknown, missing = sorted(set(data) - set(known)), sorted(k for k, needed in known.items() if needed and k not in data)
    if unknown or missing:
        raise ValueError(f"{where}: " + "; ".join(f"{what} {names}" for what, names in (("unknown keys", unknown), ("missing keys", missing)) if names))
    return data
