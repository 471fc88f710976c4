"""Checkpoints of trained models: what they say of themselves, read without running anything that they hold."""

from __future__ import annotations

import io
import json
import math
import pickle
import zipfile
from collections import OrderedDict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "epoch int, best_epoch int, epochs int, encoder string, weights_source string, includes_encoder boolean, parameters long, config string, reason string"
#: The parts a checkpoint must have, and the name of weights that nothing was trained for.
PARTS = ("model_state", "config", "model_description")
RANDOM_WEIGHTS = "random_init"


class Shape(tuple):
    """Stands for a tensor: its sizes alone."""


def _shape(*args: Any) -> Any:
    """Whatever rebuilds a tensor gives its sizes, whatever wraps one gives what it wraps."""
    return next((Shape(a) for a in args if isinstance(a, tuple) and all(isinstance(n, int) for n in a)), args[0] if args else None)


class Inert(pickle.Unpickler):
    """Plain values only: tensors become their sizes, any other class or function is refused."""

    def find_class(self, module: str, name: str) -> Any:
        if (module, name) == ("collections", "OrderedDict"):
            return OrderedDict
        if module.split(".")[0] == "pathlib" and name.endswith("Path"):
            return lambda *parts: "/".join(parts)
        if module == "torch" or module.startswith("torch."):
            return _shape
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed")

    def persistent_load(self, pid: Any) -> None:
        return None  # the numbers of a tensor stay where they are


def payload(data: bytes) -> Any:
    """The object in a zip with one data.pkl, or in a bare pickle."""
    file = io.BytesIO(data)
    if not zipfile.is_zipfile(file):
        return Inert(io.BytesIO(data)).load()
    with zipfile.ZipFile(file) as z:
        name = next((n for n in z.namelist() if n.rpartition("/")[2] == "data.pkl"), None)
        if name is None:
            raise ValueError("no data.pkl in the archive")
        return Inert(io.BytesIO(z.read(name))).load()


def _whole(v: Any) -> int | None:
    return int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


def described(data: bytes, random_weights: str = RANDOM_WEIGHTS) -> dict[str, Any]:
    """A row of CHECKPOINT; reason says why it cannot be used, with whatever could be read beside it."""
    row: dict[str, Any] = dict.fromkeys(c.split()[0] for c in CHECKPOINT.split(", "))
    try:
        got = payload(data)
    except Exception as e:  # any broken or refused file is a reason, not a crash
        return row | {"reason": f"not readable: {e}"}
    if not isinstance(got, dict) or not isinstance(got.get("config"), dict):
        return row | {"reason": "embeds no config; its training split cannot be verified"}
    config, about = got["config"], got.get("model_description") or {}
    model, training = config.get("model") or {}, config.get("training") or {}
    state = got.get("model_state") or {}
    row |= {"epoch": _whole(got.get("epoch")), "best_epoch": _whole(got.get("best_epoch")), "epochs": _whole(training.get("epochs")), "encoder": about.get("encoder"), "weights_source": about.get("weights_source")}
    row |= {"includes_encoder": bool(got.get("includes_encoder", False)), "parameters": sum(math.prod(s) for s in state.values() if isinstance(s, Shape)), "config": json.dumps(config, sort_keys=True, default=str)}
    missing = [k for k in PARTS if k not in got]
    if missing:
        row["reason"] = f"not a checkpoint: no {', '.join(missing)}"
    elif row["encoder"] != model.get("encoder"):
        row["reason"] = f"records encoder {row['encoder']} but its config says {model.get('encoder')}"
    elif not row["includes_encoder"] and row["weights_source"] == random_weights:
        row["reason"] = "trained on a random encoder that it did not save"
    return row


def read_checkpoints(spark: SparkSession, path: str, glob: str = "*.pt") -> DataFrame:
    """(path, epoch, best_epoch, epochs, encoder, weights_source, includes_encoder, parameters, config, reason, final_epoch) of each file below 2 GB; empty files are not listed.

    final_epoch: whether it holds the last planned epoch, counted from 0; null if it does not say.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    about = F.udf(described, f"struct<{', '.join(':'.join(c.split()) for c in CHECKPOINT.split(', '))}>")
    got = files.select("path", about("content").alias("c")).select("path", "c.*")
    return got.withColumn("final_epoch", F.col("epoch") == F.col("epochs") - 1)
