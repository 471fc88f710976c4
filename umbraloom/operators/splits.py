"""Pairs of images and heights, splits without leaks, audits, crops and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbraloom.functions.metadata import scene_of
from umbraloom.operators.tiling import axis_offsets


def discover_pairs(images: DataFrame, heights: DataFrame, pattern: str, strict: bool = True) -> DataFrame:
    """(stem, scene_id, city, image_path, height_path) for images (stem, path) and heights (stem, path); an image without heights is an error."""
    both = images.select("stem", F.col("path").alias("image_path")).join(heights.select("stem", F.col("path").alias("height_path")), "stem", "left" if strict else "inner")
    s = scene_of(F.col("stem"), pattern)
    path = F.when(F.col("height_path").isNull(), F.raise_error(F.concat(F.lit("image without a height file: "), F.col("image_path"))).cast("string")).otherwise(F.col("height_path")) if strict else F.col("height_path")
    return both.select("stem", s["scene_id"].alias("scene_id"), s["city"].alias("city"), "image_path", path.alias("height_path"))


def split_pairs(pairs: DataFrame, heldout: DataFrame, key: str = "scene_id") -> tuple[DataFrame, DataFrame]:
    """(train, validation): an anti and a semi join against the held-out scenes."""
    return pairs.join(heldout.select(key), key, "left_anti"), pairs.join(heldout.select(key), key, "left_semi")


def split_by_prefix(pairs: DataFrame, prefixes: Sequence[str], key: str = "scene_id") -> DataFrame:
    """The pairs with `side`: validation if the scene starts with a prefix."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col(key).startswith(p)
    return pairs.withColumn("side", F.when(hit, "validation").otherwise("train"))


def per_group_validation(pairs: DataFrame, group: str, scene: str, fraction: float, seed: str = "0") -> DataFrame:
    """(group, scene, side): by group, scenes in hash order, clamp(rint(n * fraction), 1, n - 1) of them to validation; a single scene trains."""
    scenes = pairs.select(group, scene).distinct()
    w = Window.partitionBy(group)
    out = scenes.withColumns({"_k": F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(scene).cast("string"))), scene)), "_n": F.count("*").over(w)})
    take = F.when(F.col("_n") == 1, 0).otherwise(F.greatest(F.lit(1), F.least(F.rint(F.col("_n") * fraction).cast("int"), F.col("_n").cast("int") - 1)))
    return out.select(group, scene, F.when(F.col("_k") <= take, "validation").otherwise("train").alias("side"))


def audit_split(declared: DataFrame, pairs: DataFrame, region: str = "region", scene: str = "scene_id") -> DataFrame:
    """(check, n, ok) for declared (region, side) and pairs (region, side, scene_id): every count must be 0, but for the last, which must not.

    One pass over the pairs: regions and scenes become rows (kind, name) with flags for the sides that they are on and those declared.
    """
    side = lambda c, v: F.max(F.when(c, F.col("side") == v).otherwise(False))
    both = F.array(F.struct(F.lit("region").alias("kind"), F.col(region).cast("string").alias("name")), F.struct(F.lit("scene").alias("kind"), F.col(scene).cast("string").alias("name")))
    seen = pairs.select(F.explode(both).alias("_k"), "side").select("_k.*", "side", F.lit(False).alias("said"))
    said = declared.select(F.lit("region").alias("kind"), F.col(region).cast("string").alias("name"), "side", F.lit(True).alias("said"))
    f = seen.unionAll(said).where("name is not null").groupBy("kind", "name").agg(
        side(~F.col("said"), "train").alias("train"), side(~F.col("said"), "validation").alias("held"), side(F.col("said"), "train").alias("said_train"), side(F.col("said"), "validation").alias("said_held"))
    r, s = F.col("kind") == "region", F.col("kind") == "scene"
    tests = {
        "heldout_region_trained_on": r & F.col("said_held") & F.col("train"), "trained_region_undeclared": r & F.col("train") & ~F.col("said_train"), "declared_region_unused": r & F.col("said_train") & ~F.col("train"),
        "shared_scenes": s & F.col("train") & F.col("held"), "heldout_pairs": r & F.col("held"),
    }
    counts = f.agg(*(F.count(F.when(t, 1)).alias(k) for k, t in tests.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("n"), ((F.col(k) > 0) if k == "heldout_pairs" else (F.col(k) == 0)).alias("ok")) for k in tests)))
    return counts.select(rows.alias("_t")).select("_t.*")


def audit_selection(audit: DataFrame, selection_regions: DataFrame, heldout: DataFrame, rule: str, region: str = "region") -> DataFrame:
    """(overlap, ok, reason): a model selected on held-out regions is allowed only by the final-epoch rule."""
    shared = selection_regions.select(region).distinct().join(heldout.select(region).distinct(), region).agg(F.count("*").alias("overlap"), F.lit(0).alias("failed"))
    failed = audit.agg(F.lit(0).alias("overlap"), F.count(F.when(~F.col("ok"), 1)).alias("failed"))
    n = shared.unionAll(failed).agg(F.sum("overlap").alias("overlap"), F.sum("failed").alias("failed"))
    ok = ((F.col("overlap") == 0) | F.lit(rule == "final_epoch")) & (F.col("failed") == 0)
    return n.select("overlap", ok.alias("ok"), F.when(~ok, "selected on held-out regions, or the split failed its audit").alias("reason"))


def fixed_sample(rows: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """n rows by the order of a seeded hash, without replacement: the same ones on every run and cluster."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    return rows.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def region_counts(pairs: DataFrame, region: str) -> DataFrame:
    return pairs.groupBy(region).agg(F.count("*").alias("pairs"), F.countDistinct("scene_id").alias("scenes"))


def validation_crops(scenes: DataFrame, size: int) -> DataFrame:
    """The crops that cover scenes (scene_id, width, height), rows first: side by side, the last of a row or column pushed back to end at the edge;
    a scene smaller than a crop has one at its origin."""
    return scenes.select("scene_id", "width", F.explode(axis_offsets("height", size, 0)).alias("row_off")).select("scene_id", "row_off", F.explode(axis_offsets("width", size, 0)).alias("col_off"))


def train_crops(scenes: DataFrame, size: int, n: int, epoch: int, seed: int = 0) -> DataFrame:
    """n crops of each scene at hashed origins: set by (seed, epoch, scene, number), so a lost task makes the same ones again."""
    k = scenes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = lambda extent, axis: F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "scene_id", "k", F.lit(axis)), F.greatest(F.col(extent).cast("long") - size + 1, F.lit(1))).cast("int")
    return k.select("scene_id", "k", at("height", "row").alias("row_off"), at("width", "col").alias("col_off"))


def crops_with_data(crops: DataFrame, valid: DataFrame, size: int, least: float, tries: str = "k") -> DataFrame:
    """The first crop of each scene whose share of valid pixels reaches `least`, else the best; crops (scene_id, k, row_off, col_off) by valid (scene_id, row, col).

    Pixels are joined to crops by the coarse cells of the crop's size that both lie in: four for a crop, one for a pixel.
    """
    cell = lambda c: F.floor(F.col(c) / size).cast("int")
    cells = lambda c: F.sequence(cell(c), F.floor((F.col(c) + size - 1) / size).cast("int"))
    keyed = crops.withColumn("_r", F.explode(cells("row_off"))).withColumn("_c", F.explode(cells("col_off")))
    inside = F.col("row").between(F.col("row_off"), F.col("row_off") + size - 1) & F.col("col").between(F.col("col_off"), F.col("col_off") + size - 1)
    px = valid.select("scene_id", "row", "col", cell("row").alias("_r"), cell("col").alias("_c"))
    at = ["scene_id", tries, "row_off", "col_off"]
    share = keyed.join(px, ["scene_id", "_r", "_c"], "left").groupBy(*at).agg((F.count(F.when(inside, 1)) / float(size * size)).alias("share"))
    w = Window.partitionBy("scene_id").orderBy(F.when(F.col("share") >= least, F.col(tries)).asc_nulls_last(), F.desc("share"), tries)
    return share.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def representative_tiles(records: DataFrame, group: str = "city", key: str = "tile_id", n: str = "n_footprints", height_group: str = "height_group", tallest: str = "max_height_m", ok: str = "azimuth_ok") -> DataFrame:
    """(group, dense_urban, sparse_urban, low_rise, tallest): tiles picked by structure alone among those with an azimuth, the first by key of equal ones:
    most footprints, fewest of three at least, most where all is low, and the tallest building."""
    first = lambda order, cond: F.min_by(F.when(cond, F.col(key)), F.when(cond, F.struct(order, F.col(key))))
    every = F.lit(True)
    return records.where(F.col(ok)).groupBy(group).agg(
        first(-F.col(n), every).alias("dense_urban"), first(F.col(n), F.col(n) >= 3).alias("sparse_urban"),
        first(-F.col(n), F.col(height_group) == "0-5 m").alias("low_rise"), first(-F.col(tallest), F.col(tallest).isNotNull()).alias("tallest"),
    )


def missing_regions(pairs: DataFrame, region: str = "city") -> DataFrame:
    """The pairs; one without a region is an error."""
    return pairs.withColumn(region, F.when(F.col(region).isNull(), F.raise_error(F.lit(f"a pair has no {region}")).cast("string")).otherwise(F.col(region)))


def selected_regions(pairs: DataFrame, regions: Sequence[str], region: str = "city") -> DataFrame:
    """The pairs of some regions."""
    return missing_regions(pairs, region).where(F.col(region).isin(*regions))
