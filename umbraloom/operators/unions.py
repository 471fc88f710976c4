"""Union of labels that edges tie together, by contracting stars; ranks without one global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbraloom.operators.lineage import cut


def united(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, label, root) for all ends of edges (by, a, b): root is the least label that can be reached.

    Each round every label takes over the least label around it (a star), then stars are hung on the least of their own
    centres; rows never exceed twice the edges and rounds are logarithmic in the longest chain. Each round's rows are checkpointed, and the
    rounds end when a whole round changes no row.
    """
    by = list(by)
    at = cut(edges.select(*by, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    told = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(38,0)"))).first())
    was = None
    while (now := told(at)) != was:
        was = now
        both = at.unionAll(at.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*by, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, [*by, "u"]).where("v > u").select(*by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(*by, "u").agg(F.min("v").alias("m"))
        small = large.join(low, [*by, "u"]).select(*by, F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        at = cut(small.where("u != v").distinct())
    ends = at.groupBy(*by, F.col("u").alias("label")).agg(F.min("v").alias("root"))
    return ends.unionAll(at.select(*by, F.col("v").alias("label"), F.col("v").alias("root")).distinct())


def ranked(rows: DataFrame, by: Sequence[str], order: str, name: str = "rank", bits: int = 32) -> DataFrame:
    """Rows with their rank from 1 by an integer column within each group, ties apart arbitrarily. The column is cut into bands of 2^bits: ranks are taken inside a
    band, and a running sum over the bands' sizes is added, so that no task sorts a whole group."""
    by, b = list(by), F.shiftright(F.col(order), bits)
    sized = rows.withColumn("_band", b)
    sizes = sized.groupBy(*by, "_band").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = sized.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_band").orderBy(order)))
    return inside.join(before, [*by, "_band"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_band", "_in", "_before")
