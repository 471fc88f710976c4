"""What several corpus operators share: reading tables, scratch tables in the cluster's shared folder, id filters, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAST = (1 << 63) - 1  # stands for a null doc_id
#: Most words of 64 bits in an id filter: 8 MB of bits.
FILTER_WORDS = 1 << 20
#: Rows of one key that need no spreading, and most keys that are spread.
HEAVY, HEAVY_KEYS = 500, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where none is set, a session on one machine gets a
    folder of its own, and a cluster is an error: a folder of the driver's machine would not do."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="umbraloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def shards(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that a table lacks: the name, with as many underscores as it takes."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def pieces_of(total: int, each: int) -> int:
    """How many pieces of a size a total is cut into."""
    return max(1, -(-int(total or 0) // each))


class Scratch:
    """Written tables that cut lineage. They survive a lost executor, since they lie in the shared folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(at := f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(at)

    def keep_bucketed(self, df: DataFrame, name: str, n: int, col: str) -> DataFrame:
        """The same as a table cut into n files by a column, so that later groups by it need no shuffle of the table."""
        n = max(1, min(n, 100_000))
        df.repartition(n, col).write.bucketBy(n, col).option("compression", "zstd").option("path", f"{self.root}/{name}").saveAsTable(held := f"{name}_{uuid.uuid4().hex}")
        return self.spark.table(held)

    def drop(self, *names: str) -> None:
        """Deletes tables that no returned DataFrame reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class IdFilter:
    """Bits that hold every id of a column, and by chance others. `most` bounds the number of ids; the filter has 32 bits for each,
    but FILTER_WORDS words of 64 at most, so that it may be broadcast whatever the table. A full one lets all rows pass."""

    def __init__(self, scratch: Scratch, ids: DataFrame, col: str, most: int, name: str) -> None:
        self.words = min(FILTER_WORDS, max(1 << 10, 1 << (int(most) // 2).bit_length()))
        word, bit = self._spot(col)
        self.bits = scratch.keep(ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), name)

    def _spot(self, col: str) -> tuple:
        h = F.xxhash64(col)
        return F.pmod(h, F.lit(self.words)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int"))

    def _met(self, df: DataFrame, col: str, how: str) -> tuple[DataFrame, Column, list[str]]:
        """df with the filter's words beside its rows, the bit of each row, and the names that were added."""
        word, bit = self._spot(col)
        at, held = fresh(df, "_word"), fresh(df, "_bits")
        bits = self.bits.select(F.col("_word").alias(at), F.col("_bits").alias(held))
        return df.join(F.broadcast(bits), word == F.col(at), how), F.col(held).bitwiseAND(bit), [at, held]

    def maybe_in(self, df: DataFrame, col: str) -> DataFrame:
        """The rows whose id may be in the filter."""
        met, bit, added = self._met(df, col, "inner")
        return met.where(bit != 0).drop(*added)

    def not_in(self, df: DataFrame, col: str) -> DataFrame:
        """The other rows: ids that are surely not in the filter, and null ones."""
        met, bit, added = self._met(df, col, "left")
        return met.where(F.coalesce(bit, F.lit(0)) == 0).drop(*added)


def frequent(counts: DataFrame, col: str, most: int) -> Column:
    """Which rows are the most frequent, as a condition that at most `most` rows meet: those whose count is in the highest of its eighths of octaves.
    Only the number of rows of each of these, some 500 at most, comes to the driver."""
    step = F.floor(F.log2(F.col(col).cast("double")) * 8)
    held = {int(r["s"]): int(r["n"]) for r in counts.where(F.col(col) > 0).groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()}
    least = max(held, default=0) + 1
    for s in sorted(held, reverse=True):
        most -= held[s]
        if most < 0:
            break
        least = s
    return F.coalesce((F.col(col) > 0) & (step >= least), F.lit(False))


def spread_join(left: DataFrame, right: DataFrame, key: str, scratch: Scratch, name: str) -> DataFrame:
    """The inner join of a written table with one that has each key once, with the rows of heavy keys spread by a salt.

    A key is heavy with more than HEAVY left rows, or a HEAVY_KEYS-th of them all: so the list of heavy keys, which is broadcast, is bounded, and
    the right rows are copied once for each HEAVY left ones at most.
    """
    each = max(HEAVY, left.count() // HEAVY_KEYS)
    heavy = scratch.keep(left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > each).select(key, F.ceil(F.col("_n") / each).cast("int").alias("_copies")), f"{name}_heavy")
    if heavy.isEmpty():
        return left.join(right, key)
    heavy = F.broadcast(heavy)
    salted = left.join(heavy, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_copies")), F.lit(0)).cast("int")).drop("_copies")
    copied = right.join(heavy, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    return salted.join(copied, [key, "_salt"]).drop("_salt")


def without(docs: DataFrame, gone: DataFrame, scratch: Scratch, name: str, digest: Column | None = None) -> DataFrame:
    """The rows of docs whose doc_id is not in a written column of ids, _id; with a digest of the text, whose (doc_id, digest) is not in (_id, _sha). Only rows
    that may be in it leave their place. Columns of docs may have any names."""
    own, there, sha, mine = (fresh(docs, n) for n in ("_own", "_id", "_sha", "_mine"))
    marked = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    listed = IdFilter(scratch, gone, "_id", gone.count(), name)
    some = listed.maybe_in(marked, own)
    ids = gone.select(F.col("_id").alias(there), *([F.col("_sha").alias(sha)] if digest is not None else [])).distinct()
    on = F.col(own) == F.col(there)
    if digest is not None:
        some, on = some.withColumn(mine, digest), on & (F.col(mine) == F.col(sha))
    # an anti join would be pushed below the filter's join, to where all rows are shuffled; an outer one stays above it
    rest = some.join(ids, on, "left").where(F.col(there).isNull()).drop(there, sha, mine)
    return listed.not_in(marked, own).unionAll(rest.select(*marked.columns)).drop(own)


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for all ends of edges (a, b): component is the smallest node that can be reached.

    Alternating large-star and small-star steps: each is a group by node that keeps a star's centre and members,
    so rows never outnumber twice the edges, and the number of rounds is logarithmic in the diameter. Every round is
    a written table; the round before it is deleted.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    state = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    at = scratch.keep(both, f"{name}0")
    was, k = state(at), 0
    while was[0]:
        # large star: of a node's neighbours and itself take the least; the larger neighbours point to it
        sym = at.unionAll(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: of a node and its smaller neighbours, all point to the least
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        k += 1
        at = scratch.keep(small, f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        now = state(at)
        if now == was:
            break
        was = now
    return at.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionAll(at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
