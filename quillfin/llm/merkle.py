"""Merkle manifest of a table, with its nodes in an external store.

A leaf is the hash of a row. The leaves of one group (a language, say) ascend by id and form one tree: while
several nodes remain, every two consecutive ones become their hash, the last of an odd number its own. The trees' tops, in
the order of their groups, are the leaves of a last tree, whose top is the root. H is SHA-256 in lower-case hex of its inputs put
together, digests as hex text; the store has them as 32 bytes.

Nothing holds a whole level. Leaves are range-partitioned by (group, id) and sorted; these sorted runs are numbered by their counts, so no
task meets all rows. A band of ``BAND`` levels is then built over strips of 2^BAND nodes, read in order of their
places, and written to one folder a level; the next band reads the last of these. Heights are
logarithms: 1e11 leaves take four bands. Proofs come back from the top: a merge of each band's nodes, in order of their places, with what
lies above each strip, so that common parts are stored once a strip and whole paths exist only while a task hashes them.

Inputs: any column may be null; the null group comes first. Null ids come first in their group. Repeated ids are ordered by
their leaves, so equal rows are interchangeable; a row comes out as often as it came in. Empty texts are hashed with length 0, null ones
as ``-``; texts are taken whole. An empty table has no root and gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder

#: Levels built and read at a time; a strip has two to this power of nodes.
BAND = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A step of a path: where the sibling is, and its digest.
NONE, RIGHT, LEFT = 0, 1, 2
STEP = 33
NODES = "tree string, pos long, hash binary, n long, level int"


def framed(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def row_digest(columns: list[Column]) -> Column:
    """The row's leaf, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(framed(c) for c in columns)).cast("binary"), 256))


def leaves(rows: DataFrame, fields=FIELDS, group: str = "lang", id_col: str = "doc_id", changed: dict[str, Column] | None = None) -> DataFrame:
    """(tree, id, hash, other) of each row: ``tree`` sorts like the group, null first; ``other`` is the leaf with the ``changed`` columns, null where they are as they were."""
    tree = F.when(F.col(group).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    other = F.lit(None).cast("binary")
    if changed:
        new = F.lit(False)
        for c, to in changed.items():
            new = new | ~to.eqNullSafe(F.col(c))
        other = F.when(new, row_digest([changed.get(c, F.col(c)) for c in fields]))
    return rows.select(tree.alias("tree"), F.col(id_col).cast("long").alias("id"), row_digest([F.col(c) for c in fields]).alias("hash"), other.alias("other"))


def plant(rows: DataFrame, order: list[str], folder: str) -> DataFrame:
    """``rows`` (tree, hash, ...) with their place in the tree in this order, ``pos``, and the tree's size, ``n``; written to ``folder``."""
    spark = rows.sparkSession
    rows.withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")
    by = ["tree", *order, "row"]
    runs = spark.read.parquet(f"{folder}/rows").repartitionByRange(*by).sortWithinPartitions(*by).drop("row")
    # counted after the sort, so that each row knows its place in its run
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    runs.withColumn("run", F.spark_partition_id()).withColumn("nth", nth).write.parquet(f"{folder}/runs")
    runs = spark.read.parquet(f"{folder}/runs")
    # a run holds whole trees, but for its first and last: no more rows here than runs and trees
    parts = runs.groupBy("tree", "run").agg(F.count("*").alias("c"), F.min("nth").alias("first"))
    every = Window.partitionBy("tree")
    start = F.coalesce(F.sum("c").over(every.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("tree", "run", (start - F.col("first")).alias("shift"), F.sum("c").over(every).alias("n"))
    runs.join(parts, ["tree", "run"]).withColumn("pos", F.col("nth") + F.col("shift")).drop("run", "nth", "shift").write.parquet(f"{folder}/leaves")
    return spark.read.parquet(f"{folder}/leaves")


def height(n: int) -> int:
    """Levels above n leaves."""
    return max(0, n - 1).bit_length()


def height_of(n: str) -> Column:
    return F.when(F.col(n) > 1, F.length(F.bin(F.col(n) - 1))).otherwise(0)


def parent(*nodes: bytes) -> bytes:
    return hashlib.sha256(b"".join(x.hex().encode() for x in nodes)).digest()


def level(spark: SparkSession, folder: str, band: int) -> DataFrame:
    """(tree, pos, hash, n, level) of a band's lowest level, of the trees that rise above it."""
    if band == 0:
        return spark.read.parquet(f"{folder}/leaves").select("tree", "pos", "hash", "n", F.lit(0).alias("level"))
    below = spark.read.schema(NODES).parquet(f"{folder}/nodes/band={band - 1}")
    return below.where((F.col("level") == BAND * band) & (height_of("n") > BAND * band))


def build(spark: SparkSession, folder: str) -> int:
    """Writes all levels above the leaves in ``folder``; the number of bands."""
    tallest = height(level(spark, folder, 0).agg(F.max("n")).first()[0] or 0)
    band = 0
    while band == 0 or tallest > BAND * band:
        low = BAND * band

        def rise(t: pa.Table) -> pa.Table:
            t = t.sort_by("pos")
            first, n, nodes, out = t["pos"][0].as_py(), t["n"][0].as_py(), t["hash"].to_pylist(), []
            for k in range(1, min(BAND, height(n) - low) + 1):
                nodes = [parent(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
                out += [((first >> k) + i, h, low + k) for i, h in enumerate(nodes)]
            pos, hashes, levels = zip(*out) if out else ((), (), ())
            columns = [pa.repeat(t["tree"][0], len(out)), pa.array(pos, pa.int64()), pa.array(hashes, pa.binary()), pa.repeat(t["n"][0], len(out)), pa.array(levels, pa.int32())]
            return pa.table(columns, names=["tree", "pos", "hash", "n", "level"])

        strips = level(spark, folder, band).drop("level").withColumn("strip", F.shiftright("pos", BAND))
        strips.groupBy("tree", "strip").applyInArrow(rise, NODES).write.partitionBy("level").parquet(f"{folder}/nodes/band={band}")
        band += 1
    return band


def tops(spark: SparkSession, folder: str, bands: int) -> DataFrame:
    """(tree, n, hash): the top of every tree."""
    out = level(spark, folder, 0).where("n = 1")
    for band in range(bands):
        out = out.unionByName(spark.read.schema(NODES).parquet(f"{folder}/nodes/band={band}").where(F.col("level") == height_of("n")))
    return out.select("tree", "n", "hash")


def steps(i: int, levels: list[list[bytes]]) -> bytes:
    """The path of a strip's node i to the strip's top; strips begin at even places on all levels."""
    out = []
    for k, nodes in enumerate(levels):
        j = i >> k
        if j & 1:
            out.append(bytes([LEFT]) + nodes[j - 1])
        else:
            out.append(bytes([RIGHT]) + nodes[j + 1] if j + 1 < len(nodes) else bytes(STEP))
    return b"".join(out)


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    for k in range(0, len(path), STEP):
        side, sibling = path[k], path[k + 1 : k + STEP]
        leaf = parent(sibling, leaf) if side == LEFT else parent(leaf, sibling) if side == RIGHT else parent(leaf)
    return leaf


def siblings_digest(path: bytes) -> str:
    """H of the path's siblings from the leaf up."""
    return hashlib.sha256(b"".join(path[k + 1 : k + STEP].hex().encode() for k in range(0, len(path), STEP) if path[k] != NONE)).hexdigest()


def _merged(spark: SparkSession, folder: str, band: int, lowest: DataFrame, above: DataFrame, emit, schema: str) -> DataFrame:
    """``emit(strip's lowest rows, their paths, top)`` for each strip of a band: its nodes, in order of their places, merged with what lies ``above`` (tree, strip, path, top).

    ``lowest`` has the band's lowest nodes with any other columns.
    """
    low = BAND * band
    upper = spark.read.schema(NODES).parquet(f"{folder}/nodes/band={band}").where(F.col("level") < F.least(F.lit(low + BAND), height_of("n")))
    both = lowest.unionByName(upper, allowMissingColumns=True)
    both = both.withColumn("strip", F.expr(f"shiftright(pos, {low + BAND} - level)"))

    def run(t: pa.Table, u: pa.Table) -> pa.Table:
        t = t.sort_by([("level", "ascending"), ("pos", "ascending")])
        rise = min(BAND, height(t["n"][0].as_py()) - low)
        levels = [[] for _ in range(max(1, rise))]
        for k, h in zip(t["level"].to_pylist(), t["hash"].to_pylist()):
            levels[k - low].append(h)
        rows = t.slice(0, len(levels[0]))
        top = u["path"][0].as_py()
        return emit(rows, [steps(i, levels[:rise]) + top for i in range(rows.num_rows)], u["top"][0])

    return both.groupBy("tree", "strip").cogroup(above.groupBy("tree", "strip")).applyInArrow(run, schema)


def proofs(spark: SparkSession, folder: str, bands: int, tops_above: DataFrame, emit, schema: str) -> DataFrame:
    """``emit`` for all strips of leaves; ``tops_above`` (tree, n, path, top) has the path that begins at each tree's top."""
    above = None
    for band in reversed(range(bands)):
        low = BAND * band
        ends = (height_of("n") > low) & (height_of("n") <= low + BAND)
        here = tops_above.where(ends if band else height_of("n") <= BAND).select("tree", F.lit(0).cast("long").alias("strip"), "path", "top")
        above = here if above is None else here.unionByName(above)
        if band == 0:
            rows = spark.read.parquet(f"{folder}/leaves").withColumn("level", F.lit(0))
            return _merged(spark, folder, 0, rows, above, emit, schema)

        def down(rows: pa.Table, paths: list[bytes], top) -> pa.Table:
            return pa.table([rows["tree"], rows["pos"], pa.array(paths, pa.binary()), pa.repeat(top, rows.num_rows)], names=["tree", "strip", "path", "top"])

        above = _merged(spark, folder, band, level(spark, folder, band), above, down, "tree string, strip long, path binary, top binary")
        above.write.parquet(f"{folder}/above/band={band}")
        above = spark.read.parquet(f"{folder}/above/band={band}")
    raise ValueError("no bands")


def root_paths(spark: SparkSession, folder: str, subroots: DataFrame) -> tuple[str | None, DataFrame]:
    """(the root, (tree, n, path, top) of each subroot (tree, n, hash)): a tree over them in order of their groups."""
    own = subroots.select(F.lit("").alias("tree"), "hash", F.col("tree").alias("of"), F.col("n").alias("size"))
    plant(own, ["of"], folder)
    bands = build(spark, folder)
    top = tops(spark, folder, bands).first()
    whole = spark.createDataFrame([("", top.n, b"", top.hash)] if top else [], "tree string, n long, path binary, top binary")

    def emit(rows: pa.Table, paths: list[bytes], _) -> pa.Table:
        return pa.table([rows["of"], rows["size"], pa.array(paths, pa.binary()), rows["hash"]], names=["tree", "n", "path", "top"])

    found = proofs(spark, folder, bands, whole, emit, "tree string, n long, path binary, top binary")
    return (bytes(top.hash).hex() if top else None), found


def manifest(rows: DataFrame, fields=FIELDS, group: str = "lang", id_col: str = "doc_id", changed: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified), a row for each of ``rows``.

    The root is folded again from each leaf and its path; with ``changed``, from the leaf of the row
    so changed, which shows what a check against the manifest finds.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/merkle-{uuid.uuid4().hex}"
    plant(leaves(rows, fields, group, id_col, changed), ["id", "hash"], f"{folder}/groups")
    bands = build(spark, f"{folder}/groups")
    root, above = root_paths(spark, f"{folder}/root", tops(spark, f"{folder}/groups", bands))
    above.write.parquet(f"{folder}/above")

    def emit(rows: pa.Table, paths: list[bytes], top) -> pa.Table:
        own, other = rows["hash"].to_pylist(), rows["other"].to_pylist()
        folded = [fold(x or h, p).hex() for h, x, p in zip(own, other, paths)]
        columns = [rows["id"], pa.array([h.hex() for h in own]), pa.repeat(top.as_py().hex(), len(own)), pa.repeat(root, len(own)), pa.array([siblings_digest(p) for p in paths]), pa.array(folded), pa.array([f == root for f in folded])]
        return pa.table(columns, names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return proofs(spark, f"{folder}/groups", bands, spark.read.parquet(f"{folder}/above"), emit, schema)
