"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master (tests on one machine) may do without: there it is a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="ckpt-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Bytes of rows, about, that Spark hands a Python worker at a time.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of ``BATCH_BYTES`` from now on in this session, unless it has a lesser bound.

    Spark's own bounds are 10,000 rows and 64 MB, which a task of long texts takes as one batch. It is held several times over, by
    vectors that double outside the JVM's heap and by the worker, and both keep much of the memory that they once took.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)b?\s*", spark.conf.get(name).lower()).groups()
    if not 0 < int(size) << 10 * " kmgtp".index(unit or " ") <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of frames that nothing refers to any more.

    Its cleaner follows the driver's garbage collection, which may be far off while only executors work.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(columns: list[str], stem: str) -> str:
    """A column name that none of ``columns`` has, in either case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def row_hash(docs: DataFrame):
    """A hash of all columns; those that Spark can't hash (maps, variants) by their JSON."""

    def hashable(f):
        c = F.col(f"`{f.name.replace('`', '``')}`")
        kind = f.dataType.simpleString()
        return F.to_json(F.struct(c.alias("v"))) if "map<" in kind or "variant" in kind else c

    return F.xxhash64(*(hashable(f) for f in docs.schema.fields))


#: Rows of keys that are broadcast at most (they have under 100 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 200_000


def sized(keys: DataFrame) -> DataFrame:
    """Narrow rows of keys, ready to be joined to a wide table: broadcast if they are few, which their count decides, so that
    the wide table isn't shuffled; else by a hash join of both sides."""
    keys = checkpoint(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys.hint("shuffle_hash")


def keep_rows(docs: DataFrame, key, best: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` (a column expression) is in ``best``; of equal rows one. ``counts`` has the number of rows of every key.

    Rows travel inside one struct, so their column names can't clash with those used here. Rows to drop are fewer
    than rows to keep, as a rule, so it is they that meet the table.
    """
    rows = docs.select(key.alias("key"), F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("row"))
    marked = checkpoint(counts.join(best.select("key", F.lit(True).alias("kept")), "key", "left").where("kept is null or count > 1"))
    single = rows.join(sized(marked.select("key")), "key", "left_anti").select("row")
    repeated = rows.join(sized(marked.where("kept").select("key")), "key", "left_semi").dropDuplicates(["key"]).select("row")
    return single.unionAll(repeated).select("row.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str = "text"):
    """The column's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


#: Edges that one task of ``connected_components`` takes, about.
EDGES = 200_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is
    the least node reachable.

    Alternates large-star and small-star steps: each is a ``min`` per node
    (combined before the shuffle) and a join, so a node with a third of all
    edges is neither sorted nor gathered in one task. Rows are checkpointed
    each round; only two numbers per round reach the driver.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(low, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        kept = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return kept.unionAll(low.where("a <> m").select("a", F.col("m").alias("b"))).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())

    def gathered(e: DataFrame, n: int) -> DataFrame:
        """As many tasks as the edges are worth: each one's shuffle files cost the same however few rows they have."""
        return e.coalesce(1 + n // EDGES)

    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        e = checkpoint(gathered(star(gathered(star(gathered(e, before[0]), True), before[0]), False), before[0]))
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
