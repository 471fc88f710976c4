"""Tile predictors: any function from an RGB tile to a relative field, run over tile rows.

The engine brings no trained network; a predictor is injected. What it returns is checked: finite, of the tile's size, never a
silent substitute. A fallback is allowed, but its rows say so.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Predictor = Callable[[np.ndarray], np.ndarray]
#: Channel means and deviations that encoders expect.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
OUT_SQL = "scene_id string, tile_id long, height int, width int, z array<float>, fallback boolean, reason string"


def normalised_tile(rgb: np.ndarray) -> np.ndarray:
    """(3, rows, cols) from (rows, cols, 3) of 0 to 255."""
    return np.moveaxis((rgb / 255.0 - np.array(MEAN)) / np.array(STD), 2, 0).astype(np.float32)


def checked(z: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    if z.shape != shape:
        raise ValueError(f"the predictor returned {z.shape} for a tile of {shape}")
    if not np.isfinite(z).all():
        raise ValueError("the predictor returned values that are not finite")
    return z


def luminance_field(x: np.ndarray) -> np.ndarray:
    """The labelled fallback: local brightness as a relative field, without any claim to heights."""
    return x.mean(axis=0)


@dataclass(frozen=True)
class Fallback:
    """A predictor that stands in for the trained one, with where its weights come from and why it is used."""

    predictor: Predictor
    source: str
    reason: str

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.predictor(x)


def load_fallback(source: str, reason: str, loader: Callable[[str], Predictor]) -> Fallback:
    """What a loader returns for a source (the folder of a model, or its name), labelled. A reason is required; a loader that fails is an error that names the source: nothing is put in
    the place of weights that cannot be had."""
    if not reason or not reason.strip():
        raise ValueError("a fallback needs a reason: its output has to say why the trained model was not used")
    try:
        predictor = loader(str(source))
    except Exception as e:
        raise ValueError(f"the fallback's weights {str(source)!r} cannot be had ({type(e).__name__}: {e}); random ones are not put in their place") from e
    if not callable(predictor):
        raise ValueError(f"the loader of {str(source)!r} returned no predictor")
    return Fallback(predictor, f"{'local' if os.path.isdir(source) else 'named'}:{source}", reason.strip())


def refused_fallbacks(predictions: DataFrame, context: str) -> DataFrame:
    """Predictions as they are, or an error that names the context and the reason where one is a fallback's: before figures are reported or surfaces exported."""
    told = F.concat(F.lit(f"refusing to {context}: a fallback made tile "), F.col("tile_id").cast("string"), F.lit(" ("), F.coalesce("reason", F.lit("no reason")), F.lit(")"))
    return predictions.withColumn("fallback", F.when(F.col("fallback"), F.raise_error(told).cast("boolean")).otherwise(F.col("fallback")))


def predict(tiles: DataFrame, predictor: Predictor | None, allow_fallback: bool = False) -> DataFrame:
    """tiles (scene_id, tile_id, height, width, rgb array<double>, row by row and band last) with z; a tile is the unit of memory.

    Rows of a Fallback, and of the field of brightness that stands in where no predictor is given and that is allowed, say so and why."""
    if predictor is None and not allow_fallback:
        raise ValueError("no predictor is given and a fallback is not allowed")
    labelled = isinstance(predictor, Fallback)
    if labelled and not allow_fallback:
        raise ValueError(f"a fallback is given and not allowed: {predictor.reason}")
    reason = f"{predictor.reason} ({predictor.source})" if labelled else "no predictor was given" if predictor is None else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf.itertuples():
                x = normalised_tile(np.asarray(t.rgb, float).reshape(t.height, t.width, 3))
                z = checked(np.asarray((predictor or luminance_field)(x)), (t.height, t.width))
                rows.append((t.scene_id, t.tile_id, t.height, t.width, z.astype(np.float32).ravel(), reason is not None, reason))
            yield pd.DataFrame(rows, columns=["scene_id", "tile_id", "height", "width", "z", "fallback", "reason"])

    return tiles.select("scene_id", "tile_id", "height", "width", "rgb").mapInPandas(run, OUT_SQL)
