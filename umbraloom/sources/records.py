"""Records: sidecars, reference sets, tile plans, JSON lines, report links."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraloom.functions.metadata import normalised_path, parsed_imd

REFERENCE = "building_id string, reference_height_m double, source string, measured_by string, measured_on string, note string"
#: Of a tile's record, what the reports use; a branch that a status does not have is null.
TILE_RECORD = "tile_id string, city string, image string, scene_id string, row_off int, col_off int, status string, status_reason string, height_group string, fit_class string, fit struct<a:double,b:double,se_a:double,n:int>, dense struct<building:struct<n:long,sum_abs:double,sum_sq:double,sum_err:double>,ground:struct<n:long,sum_abs:double,sum_sq:double,sum_err:double>>"


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(stem, label, table) of .IMD files beside images; X.IMD and X.tif.IMD both belong to X."""
    got = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.[iI][mM][dD]").option("recursiveFileLookup", "true").text(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    return got.select(F.regexp_replace(name, r"(?i)(\.tiff?)?\.imd$", "").alias("stem"), F.lit("sidecar").alias("label"), parsed_imd("value").alias("table"))


def reference_set(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """References from JSON, which names its kind, or CSV, whose kind must be given; another suffix is refused."""
    if path.endswith(".json"):
        doc = spark.read.schema(f"kind string, description string, measurements array<struct<{REFERENCE}>>").option("multiLine", "true").option("mode", "FAILFAST").json(path)
        return doc.select(F.coalesce(F.lit(kind).cast("string"), "kind").alias("kind"), F.explode("measurements").alias("m")).select("kind", "m.*")
    if path.endswith(".csv"):
        if kind is None:
            raise ValueError("a CSV reference set needs a kind")
        return spark.read.schema(REFERENCE).option("header", "true").option("mode", "FAILFAST").csv(path).withColumn("kind", F.lit(kind))
    raise ValueError(f"reference sets are .json or .csv, not {path}")


def tile_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TILE_RECORD).json(path)


def selected_tiles(records: DataFrame, heldout: DataFrame, classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): calibrated tiles of held-out scenes with a chosen fit class; the others counted by their first reason."""
    r = records.join(heldout.select("scene_id", F.lit(True).alias("_h")), "scene_id", "left")
    why = F.when(F.col("_h").isNull(), "not_held_out").when(F.col("status") != "calibrated", "not_calibrated").when(~F.coalesce(F.col("fit_class").isin(*classes), F.lit(False)), "other_fit_class")
    r = r.withColumn("skip_reason", why)
    return r.where("skip_reason is null").drop("_h", "skip_reason"), r.where("skip_reason is not null").groupBy("skip_reason").agg(F.count("*").alias("n"))


def linked(reports: DataFrame, links: DataFrame) -> DataFrame:
    """Links (source, target) followed to reports (path): struct of one match, or the reason for none or several; never a guess."""
    r = reports.select(normalised_path("path").alias("_k"), "path")
    asked = links.withColumn("_k", normalised_path("target"))
    got = asked.join(r, "_k", "left").groupBy("source", "target").agg(F.count("path").alias("n"), F.min("path").alias("path"))
    return got.select("source", "target", F.when(F.col("n") == 1, F.col("path")).alias("path"), F.when(F.col("n") == 0, "no report at this path").when(F.col("n") > 1, "more than one report at this path").alias("reason"))


def jsonable(value: Any) -> Any:
    """Plain JSON values: arrays as lists, rows as objects, NaN and infinities as null."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [jsonable(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def report_json(payload: Any) -> str:
    return json.dumps(jsonable(payload), indent=2, sort_keys=True, allow_nan=False)


def report_markdown(title: str, rows: list[Any]) -> str:
    """A table of recorded values; a missing one is a dash with a footnote that gives the row's reason."""
    rows = [jsonable(r) for r in rows]
    cols = [c for c in (rows[0] if rows else {}) if c != "reason"]
    notes: list[str] = []

    def cell(r: dict, c: str) -> str:
        v = r[c]
        if v is None:
            notes.append(str(r.get("reason") or "not yet measured"))
            return f"– [{len(notes)}]"
        return f"{v:.4f}" if isinstance(v, float) else str(v)

    body = ["| " + " | ".join(cell(r, c) for c in cols) + " |" for r in rows]
    return "\n".join([f"# {title}", "", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *body, "", *(f"[{k}] {n}" for k, n in enumerate(notes, 1))]) + "\n"


TILE_PLAN = "scene_id string, tile_id long, row_off int, col_off int, height int, width int, valid_row int, valid_row_stop int, valid_col int, valid_col_stop int"


def save_tile_plan(plan: DataFrame, path: str) -> None:
    plan.write.mode("overwrite").json(path)


def tile_plan(spark: SparkSession, path: str) -> DataFrame:
    """A saved plan; a file that does not fit the schema is an error."""
    return spark.read.schema(TILE_PLAN).option("mode", "FAILFAST").json(path)


def output_index(spark: SparkSession, root: str, depth: int = 6) -> DataFrame:
    """(path, length, kind) of reports and arrays up to so many folders below root; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    below = F.regexp_replace("path", r"^.*?\Q" + root.rstrip("/").rpartition("/")[2] + r"\E/", "")
    kind = F.when(F.lower("path").rlike(r"\.(json|md)$"), "report").when(F.lower("path").rlike(r"\.(npy|tiff?)$"), "array")
    return listed.withColumn("kind", kind).where((F.size(F.split(below, "/")) <= depth) & F.col("kind").isNotNull())
