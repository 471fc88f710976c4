"""Products as files: grids become GeoTIFF, NPY or PNG on executors, and are saved there."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from umbraloom.functions.values import CONFIDENCE
from umbraloom.sources.geotiff import geotiff_bytes, validate
from umbraloom.sources.npy import npy_bytes
from umbraloom.sources.png import png_bytes

FILE_SQL = "name string, content binary, problems array<string>"


def _grid(pdf: pd.DataFrame, value: str, kind: str) -> np.ndarray:
    out = np.full((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1), np.nan if kind.startswith("f") else 0, kind)
    out[pdf["row"], pdf["col"]] = pdf[value].astype(kind)
    return out


def raster_files(cells: DataFrame, by: Sequence[str], value: str, transform: Sequence[float] | None = None, epsg: int | None = None, tags: dict[str, str] | None = None, kind: str = "f4", nodata: float | None = float("nan"), cog: bool = True) -> DataFrame:
    """(name, content, problems): a GeoTIFF for each grid of cells (by, row, col, value), read again and validated. A grid is one group: tile large ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = _grid(pdf, value, kind)
        keep = nodata if kind.startswith("f") else None
        data = geotiff_bytes(z, tuple(transform) if transform else None, epsg, tags, keep, cog)
        return pd.DataFrame([("-".join(str(pdf[b].iloc[0]) for b in by) + f"-{value}.tif", data, validate(data, z, tuple(transform) if transform else None, epsg, keep, cog))], columns=["name", "content", "problems"])

    return cells.groupBy(*by).applyInPandas(run, FILE_SQL)


def surface_files(cells: DataFrame, by: Sequence[str], transform: Sequence[float], epsg: int | None) -> DataFrame:
    """dsm, dtm and ndsm as 32-bit floats and the ground mask as bytes, each validated."""
    out = None
    for value, kind in (("dsm", "f4"), ("dtm", "f4"), ("ndsm", "f4"), ("ground", "u1")):
        part = raster_files(cells, by, value, transform, epsg, {"PRODUCT": value}, kind)
        out = part if out is None else out.unionAll(part)
    return out


def confidence_files(cells: DataFrame, by: Sequence[str], transform: Sequence[float] | None = None, epsg: int | None = None) -> DataFrame:
    """The codes of confidence states, with a tag for each state."""
    return raster_files(cells, by, "confidence", transform, epsg, {"PRODUCT": "confidence"} | {f"STATE_{v}": k for k, v in CONFIDENCE.items()}, "u1")


def array_files(cells: DataFrame, by: Sequence[str], value: str, suffix: str = "npy") -> DataFrame:
    """NPY, or PNG of values between 0 and 255."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = _grid(pdf, value, "f4")
        data = npy_bytes(z) if suffix == "npy" else png_bytes(np.clip(np.nan_to_num(z), 0, 255).astype(np.uint8))
        return pd.DataFrame([("-".join(str(pdf[b].iloc[0]) for b in by) + f"-{value}.{suffix}", data, [])], columns=["name", "content", "problems"])

    return cells.groupBy(*by).applyInPandas(run, FILE_SQL)


def error_files(cells: DataFrame, by: Sequence[str], value: str = "error", transform: Sequence[float] | None = None, epsg: int | None = None, nodata: float = -9999.0, tags: dict[str, str] | None = None) -> DataFrame:
    """A GeoTIFF of each grid's errors as 32-bit floats, nodata where there is none, read again and validated; tiled with overviews where there is a CRS. An error that equals nodata is a
    problem, as it would be lost. A grid is one group."""
    told = {"CONTENT": "error = prediction - reference (positive = over-prediction)"} | (tags or {})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = _grid(pdf, value, "f4")
        stored = np.where(np.isfinite(z), z, np.float32(nodata)).astype(np.float32)
        at = tuple(transform) if transform else None
        data = geotiff_bytes(stored, at, epsg, told, nodata, cog=epsg is not None)
        bad = [f"nodata {nodata} is an error's value"] if (z == np.float32(nodata)).any() else []
        return pd.DataFrame([("-".join(str(pdf[b].iloc[0]) for b in by) + f"-{value}.tif", data, bad + validate(data, stored, at, epsg, nodata, epsg is not None))], columns=["name", "content", "problems"])

    return cells.groupBy(*by).applyInPandas(run, FILE_SQL)


def prediction_files(predictions: DataFrame) -> DataFrame:
    """Three files for each tile of predict(): the field as NPY, a grey figure as PNG, and a JSON sidecar with size, units, range, and whether and why it is a fallback's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf.itertuples():
                z = np.asarray(t.z, np.float32).reshape(t.height, t.width)
                low, high = float(z.min()), float(z.max())
                about = {"scene_id": t.scene_id, "tile_id": int(t.tile_id), "height": int(t.height), "width": int(t.width), "quantity": "relative height", "units": "unitless, not metres", "min": low, "max": high, "fallback": bool(t.fallback), "reason": t.reason}
                name, grey = f"{t.scene_id}-{t.tile_id}", np.rint((z - low) / (high - low or 1) * 255)
                out += [(f"{name}_relative_height.npy", npy_bytes(z), []), (f"{name}.png", png_bytes(grey.astype(np.uint8)), []), (f"{name}.json", json.dumps(about, indent=2, sort_keys=True).encode(), [])]
            yield pd.DataFrame(out, columns=["name", "content", "problems"])

    return predictions.select("scene_id", "tile_id", "height", "width", "z", "fallback", "reason").mapInPandas(run, FILE_SQL)


def save_text(spark: SparkSession, path: str, text: str) -> None:
    _save(spark, path, text.encode())


def save_files(files: DataFrame, folder: str) -> list[str]:
    """Saves files where they are made, on the executors, into a folder that all of them share; one with problems is refused. Names come back.

    A file is written beside its place and then moved there, so no reader sees half of one, and a lost task leaves none."""

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        for pdf in batches:
            for name, content, problems in zip(pdf["name"], pdf["content"], pdf["problems"], strict=True):
                if len(problems):
                    raise ValueError(f"{name}: {', '.join(problems)}")
                beside = f"{at.rstrip('/')}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(beside) as out:
                    out.write(bytes(content))
                store.move(beside, f"{at.rstrip('/')}/{name}")
            yield pdf[["name"]]

    return sorted(r["name"] for r in files.mapInPandas(save, "name string").collect())


def _save(spark: SparkSession, path: str, data: bytes) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data), 0, len(data))
    finally:
        out.close()
