"""Raster files as tables: headers, blocks of pixels, pixels, windows of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraloom.sources import geotiff as T
from umbraloom.sources.geotiff import Raster, affine_from_tags, crs_from_geokeys, parse_geotiff, read_header
from umbraloom.sources.jpeg import parse_bmp, parse_jpeg
from umbraloom.sources.npy import parse_npy
from umbraloom.sources.png import parse_png

BLOCK = 256
HEADER_SQL = "path string, width int, height int, bands int, crs string, transform array<double>, tags map<string,string>, nodata double, georeferenced boolean"
BLOCKS_SQL = "path string, band int, row_off int, col_off int, height int, width int, data array<double>"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def decode(path: str, data: bytes) -> Raster:
    """By suffix: TIFF, NPY, PNG, JPEG or BMP; all but the first have no georeference, whatever lies beside them."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("tif", "tiff"):
        return parse_geotiff(data)
    if kind == "npy":
        a = parse_npy(data)
        a = a.astype(float) if a.ndim == 3 else a.astype(float)[None]
    elif kind == "png":
        a = np.moveaxis(parse_png(data), 2, 0)
    elif kind in ("jpg", "jpeg"):
        a = np.moveaxis(parse_jpeg(data), 2, 0)
    elif kind == "bmp":
        a = np.moveaxis(parse_bmp(data), 2, 0)
    else:
        raise ValueError(f"no reader for .{kind}")
    return Raster(a, np.isfinite(a.astype(float)).all(axis=0))


def read_headers(spark: SparkSession, path: str, pattern: str = "*.tif*") -> DataFrame:
    """A row for each file, without decoding pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                f, _, _ = read_header(bytes(data))
                crs, point = crs_from_geokeys(f.get(T.GEOKEYS))
                t = affine_from_tags(f.get(T.SCALE), f.get(T.TIEPOINT), f.get(T.MATRIX), point)
                tags = {k: T.unescape(v) for k, v in T.re.findall(r'<Item name="([^"]*)"[^>]*>([^<]*)</Item>', f.get(T.GDAL_TAGS, ""))}
                nodata = f.get(T.GDAL_NODATA)
                rows.append((p, f[T.WIDTH][0], f[T.HEIGHT][0], f.get(T.BANDS, (1,))[0], crs, list(t) if t else None, tags, float(nodata) if nodata else None, bool(crs and t and t != (1, 0, 0, 0, 1, 0))))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "bands", "crs", "transform", "tags", "nodata", "georeferenced"])

    return files(spark, path, pattern).select("path", "content").mapInPandas(run, HEADER_SQL)


def read_blocks(spark: SparkSession, path: str, pattern: str = "*", bands: list[int] | None = None) -> DataFrame:
    """Blocks of at most 256 x 256 pixels, row by row; NaN where invalid. Bands from 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                r = decode(p, bytes(data))
                z = np.where(r.valid, r.bands.astype(float), np.nan)
                for b in bands or range(1, len(z) + 1):
                    for y in range(0, z.shape[1], BLOCK):
                        for x in range(0, z.shape[2], BLOCK):
                            part = z[b - 1, y : y + BLOCK, x : x + BLOCK]
                            yield pd.DataFrame([(p, b, y, x, *part.shape, part.ravel())], columns=["path", "band", "row_off", "col_off", "height", "width", "data"])

    return files(spark, path, pattern).select("path", "content").mapInPandas(run, BLOCKS_SQL)


def pixels(blocks: DataFrame) -> DataFrame:
    """(path, band, row, col, value) from blocks; null where invalid. The explode stays in the JVM."""
    px = blocks.select("path", "band", "row_off", "col_off", "width", F.posexplode("data").alias("k", "v"))
    return px.select("path", "band", (F.col("row_off") + (F.col("k") / F.col("width")).cast("int")).alias("row"), (F.col("col_off") + F.col("k") % F.col("width")).cast("int").alias("col"), F.when(~F.isnan("v"), F.col("v")).alias("value"))


def rgb_bands(n: int) -> list[int]:
    """Bands to read for RGB: one is used three times, more than three are cut, two are refused."""
    if n == 2:
        raise ValueError("an image of two bands is neither grey nor RGB")
    return [1, 1, 1] if n == 1 else [1, 2, 3]


def pair_pixels(image: DataFrame, height: DataFrame, max_height: float, by: str = "stem") -> DataFrame:
    """Pixels of an image joined with its heights by position; heights that are null, NaN, negative or over the limit are invalid and 0."""
    both = image.join(height.withColumnRenamed("value", "_h"), [by, "row", "col"], "left")
    ok = F.col("_h").isNotNull() & ~F.isnan("_h") & F.col("_h").between(0, max_height)
    return both.withColumns({"valid": ok, "height_m": F.when(ok, F.col("_h")).otherwise(0.0)}).drop("_h")


def registration(pairs: DataFrame, tolerance_px: float = 0.01, resampled_px: float = 0.5) -> DataFrame:
    """Pairs of header structs (image, height) with `reason`: one CRS only, CRS, rotations or any of the four corners that do not agree; without any CRS the grids must be the same.

    Corners may be tolerance_px of the image's pixel apart, or resampled_px of the coarser one where sizes differ.
    """
    i, h = F.col("image"), F.col("height")
    t = lambda s, k: s["transform"]["abcdef".index(k)]
    px = lambda s: F.greatest(F.abs(t(s, "a")), F.abs(t(s, "e")), F.lit(1e-12))
    x = lambda s, c, r: t(s, "a") * c + t(s, "b") * r + t(s, "c")
    y = lambda s, c, r: t(s, "d") * c + t(s, "e") * r + t(s, "f")
    zero = F.lit(0)
    corners = [(lambda s: zero, lambda s: zero), (lambda s: s["width"], lambda s: zero), (lambda s: zero, lambda s: s["height"]), (lambda s: s["width"], lambda s: s["height"])]
    worst = F.greatest(*(F.abs(at(i, c(i), r(i)) - at(h, c(h), r(h))) for c, r in corners for at in (x, y)))
    none = i["crs"].isNull() & h["crs"].isNull()
    size = (i["width"] != h["width"]) | (i["height"] != h["height"])
    limit = F.when(size, resampled_px * F.greatest(px(i), px(h))).otherwise(tolerance_px * px(i))
    turned = F.greatest(F.abs(t(i, "b") - t(h, "b")), F.abs(t(i, "d") - t(h, "d"))) > 1e-9 * F.greatest(px(i), px(h))
    reason = (
        F.when(none & size, "sizes differ and there is no CRS").when(none & ~i["transform"].eqNullSafe(h["transform"]), "grids differ and there is no CRS").when(none, None)
        .when(i["crs"].isNull() | h["crs"].isNull(), "only one has a CRS").when(i["crs"] != h["crs"], "CRS differ").when(turned, "rotations differ").when(worst > limit, "corners differ")
    )
    return pairs.withColumn("reason", reason)
