"""Pixels and products that belong together: alignment of rasters, look-ups across two of them, reports that name each other.

A raster is a struct(path, product_type, mode, units, crs, width, height, grid), its grid struct(a, b, c, d, e, f) or null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbraloom.functions.geometry import map_to_pixel, world_to_map
from umbraloom.functions.metadata import bound, normalised_path

RASTER = "struct<path:string,product_type:string,mode:string,units:string,crs:string,width:int,height:int,grid:struct<a:double,b:double,c:double,d:double,e:double,f:double>>"
#: Surfaces that a product may export.
SURFACES = ("dsm", "dtm", "ndsm")


def alignment_reasons(surface: Column, image: Column, tolerance: float = 1e-9) -> Column:
    """Why an image may not lie over a surface, as an array: sizes, grids, CRS; empty if it may."""
    bare_s, bare_i = surface["grid"].isNull(), image["grid"].isNull()
    apart = F.lit(False)
    for k in "abcdef":
        apart = apart | (F.abs(surface["grid"][k] - image["grid"][k]) > tolerance)
    size = F.when((surface["width"] != image["width"]) | (surface["height"] != image["height"]), "sizes differ")
    grid = F.when(bare_s & bare_i, "no transform on either grid").when(bare_i, "no transform on the image").when(bare_s, "no transform on the raster").when(apart, "transforms differ")
    return F.array_compact(F.array(size, grid, F.when(~surface["crs"].eqNullSafe(image["crs"]), "CRS differ")))


def link_alignment(surface: Column, panel: Column) -> Column:
    """struct(aligned, reasons): whether a panel's pixels are those of the surface; two plain grids of one size are."""
    plain = F.lit(True)
    for r in (surface, panel):
        plain = plain & r["grid"].isNull() & r["crs"].isNull()
    plain = plain & (surface["width"] == panel["width"]) & (surface["height"] == panel["height"])
    free = (surface["path"] == panel["path"]) | plain
    reasons = F.when(panel.isNull(), F.array(F.lit("no 2D raster"))).when(F.coalesce(free, F.lit(False)), F.array().cast("array<string>")).otherwise(alignment_reasons(surface, panel))
    return bound(reasons, lambda r: F.struct((F.size(r) == 0).alias("aligned"), r.alias("reasons")))


def diagnostic_eligibility(kind: str, surface: Column, diagnostic: Column, source_dsm=None, validated_dsm=None, product=None) -> Column:
    """struct(available, reason): an error or confidence layer lies only over the very DSM that was validated, on the same grid.

    source_dsm: what the surface says it was exported from; validated_dsm: what the diagnostic validates; product: what it says it is of.
    """
    none = F.lit(None).cast("string")
    declared, validated, of = (none if x is None else x for x in (source_dsm, validated_dsm, product))
    apart = alignment_reasons(surface, diagnostic)
    reason = (
        F.when(~surface["product_type"].eqNullSafe(F.lit("dsm")), f"{kind} is of the source DSM, not of this surface").when(diagnostic.isNull(), f"no {kind} raster")
        .when(~diagnostic["product_type"].eqNullSafe(F.lit(kind)), f"the linked file is no {kind} product")
    )
    if kind == "error":
        reason = reason.when(of != "dsm", "the error map validates another product")
    reason = reason.when(normalised_path(declared) != normalised_path(validated), "another DSM was validated").when(F.size(apart) > 0, F.array_join(apart, "; "))
    return bound(reason, lambda r: F.struct(r.isNull().alias("available"), r.alias("reason")))


def pixel_for(shown: Column, measured: Column, x: Column, z: Column, origin_x: Column, origin_y: Column) -> Column:
    """struct(row, col, map_x, map_y, reason): the measured raster's pixel below a world point of the shown surface.

    A surface without a grid is in pixels: its map coordinates are its column and, as y grows upwards, its row below zero.
    """
    m = world_to_map(x, z, origin_x, origin_y)
    unit = F.struct(*(F.lit(v).alias(k) for k, v in dict(a=1.0, b=0.0, c=0.0, d=0.0, e=-1.0, f=0.0).items()))
    bare, shown_bare = measured["grid"].isNull(), shown["grid"].isNull()
    other = (measured["width"] != shown["width"]) | (measured["height"] != shown["height"])
    reason = (
        F.when(~bare & shown_bare, "the measured raster is georeferenced but the displayed surface is not")
        .when(~bare & ~shown["crs"].eqNullSafe(measured["crs"]), "CRS differs")
        .when(bare & (~shown_bare | other), "the measured raster has no georeferencing and is not the displayed grid")
    )

    def at(p: Column) -> Column:
        row, col = F.floor(p["p"]["row"]).cast("int"), F.floor(p["p"]["col"]).cast("int")
        inside = F.coalesce((row >= 0) & (col >= 0) & (row < p["height"]) & (col < p["width"]), F.lit(False))
        why = F.when(p["reason"].isNotNull(), p["reason"]).when(~inside, "outside the raster")
        ok = why.isNull()
        on_map = ok & ~p["bare"]
        return F.struct(F.when(ok, row).alias("row"), F.when(ok, col).alias("col"), F.when(on_map, p["m"]["x"]).alias("map_x"), F.when(on_map, p["m"]["y"]).alias("map_y"), why.alias("reason"))

    p = map_to_pixel(F.coalesce(measured["grid"], unit), m["x"], m["y"])
    return bound(F.struct(p.alias("p"), m.alias("m"), bare.alias("bare"), reason.alias("reason"), measured["width"].alias("width"), measured["height"].alias("height")), at)


def measured_at(points: DataFrame, pixels: DataFrame, key: str = "point_id") -> DataFrame:
    """Points (key, x, z, origin_x, origin_y, shown, measured) with row, col, value, units, displayed and the reason for no value.

    pixels: (path, row, col, value), valid ones only. displayed is the shown surface's own value where that is another raster.
    """
    px = pixel_for(F.col("shown"), F.col("measured"), F.col("x"), F.col("z"), F.col("origin_x"), F.col("origin_y"))
    own = pixel_for(F.col("shown"), F.col("shown"), F.col("x"), F.col("z"), F.col("origin_x"), F.col("origin_y"))
    p = points.withColumns({"_p": px, "_d": own}).withColumns({"path": F.col("measured.path"), "row": F.col("_p.row"), "col": F.col("_p.col")})
    got = p.join(pixels.select("path", "row", "col", "value"), ["path", "row", "col"], "left")
    shown = pixels.select(F.col("path").alias("_path"), F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("value").alias("displayed"))
    apart = F.col("shown.path") != F.col("path")
    got = got.join(shown, apart & (F.col("shown.path") == F.col("_path")) & (F.col("_d.row") == F.col("_row")) & (F.col("_d.col") == F.col("_col")), "left")
    finite = F.abs(F.col("value")) < float("inf")
    reason = F.when(F.col("_p.reason").isNotNull(), F.col("_p.reason")).when(F.col("value").isNull(), "nodata at this pixel").when(~finite, "non-finite value at this pixel")
    metric = (F.col("measured.mode") == "ABSOLUTE") & F.lower("measured.units").isin("m", "metre", "metres", "meter", "meters")
    units = F.when(metric, "metres").otherwise("unitless (relative)")
    return got.select(key, "path", "row", "col", F.col("_p.map_x").alias("map_x"), F.col("_p.map_y").alias("map_y"), F.when(reason.isNull(), F.col("value")).alias("value"), units.alias("units"), F.when(reason.isNull(), F.col("displayed")).alias("displayed"), reason.alias("reason"))


def resolved_products(surfaces: DataFrame, validations: DataFrame, images: DataFrame) -> DataFrame:
    """Products followed through the reports that name them: a path or a reason for each layer, never a guess.

    surfaces: (report, product, source_dsm, exports map<type, struct<path, ok>>, image_report); validations: (report, prediction, error,
    confidence); images: (report, image). Paths are compared in normalised form. Several validations of one DSM are ambiguous.
    """
    s = surfaces.withColumns({"_dsm": normalised_path("source_dsm"), "_img": normalised_path("image_report")})
    v = validations.withColumn("_dsm", normalised_path("prediction")).groupBy("_dsm").agg(F.count("*").alias("_n"), F.min("report").alias("_v"), F.min("error").alias("_e"), F.min("confidence").alias("_c"))
    i = images.withColumn("_img", normalised_path("report")).groupBy("_img").agg(F.min("image").alias("_image"))
    got = s.join(v, "_dsm", "left").join(i.withColumn("_known", F.lit(True)), "_img", "left")
    out, one = ["report", "product", F.col("_dsm").alias("source_dsm")], F.col("_n") == 1
    for t in SURFACES:
        e = F.try_element_at("exports", F.lit(t))
        ok = e["path"].isNotNull() & F.coalesce(e["ok"], F.lit(True))
        out += [F.when(ok, normalised_path(e["path"])).alias(t), F.when(~ok, f"no validated {t} recorded").alias(f"{t}_reason")]
    why = F.when(F.col("image_report").isNull(), "the report names no image report").when(F.col("_known").isNull(), "the image report is not there").when(F.col("_image").isNull(), "the image report records no image")
    out += [normalised_path("_image").alias("image"), why.alias("image_reason")]
    for name, c in (("error", "_e"), ("confidence", "_c")):
        why = F.when(F.col("source_dsm").isNull(), "no source DSM recorded").when(F.col("_n").isNull(), "no report validated this DSM").when(~one, "ambiguous: several reports validated this DSM").when(F.col(c).isNull(), f"the report records no {name} raster")
        out += [F.when(one, normalised_path(c)).alias(name), why.alias(f"{name}_reason")]
    return got.select(*out)


def product_problems(surfaces: DataFrame, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """(report, product, reason) of asked products: not in the report, or in it more than once; reason is null for those that are there."""
    asked = surfaces.sparkSession.createDataFrame(list(wanted), "report string, product string").withColumn("_k", normalised_path("report"))
    have = surfaces.groupBy(normalised_path("report").alias("_k"), "product").agg(F.count("*").alias("_n"))
    got = asked.join(have, ["_k", "product"], "left")
    return got.select("report", "product", F.when(F.col("_n").isNull(), "no such product").when(F.col("_n") > 1, "several such products").alias("reason"))
