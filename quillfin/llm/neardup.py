"""Near copies by exact similarity of word shingles, found with SimHash and Golay keys.

``simhash`` links fingerprints at three bits, which near copies with a few
changed words often exceed. Here a document's SimHash has 138 bits, over its distinct
words, in six words of the Golay code. Each of them decodes to the indices of
the codewords of all words within one error (up to six keys), so that two words
at most two errors apart always share one. A key also holds the least of six
hashes of the document's three-word shingles, which keeps strangers apart.

Documents that share a key with another are candidates. Comparing all pairs in a bucket would be quadratic in a
group of copies, so candidates first meet their buckets' centres, for a few rounds: in the first the one which
shares the most keys with others, then the one with the most verified links (of variants of one text, the text
itself). These rounds only join large groups cheaply. Then an exact join compares all candidates in
different components: two sets alike must share one of their first few shingles in an order that puts
shingles common in a sample last (prefix filter), far enough from both ends (positional
filter). Pairs are verified by the Jaccard similarity of their sets of five-word shingles, as 64-bit hashes; links form components.

Texts are compared in lower case (A-Z) and with single spaces; texts equal in that form
are one node, with a 64-bit hash as its name. Nulls count as empty, and empty texts are
copies of each other; texts of fewer words than a shingle are one shingle; very long ones are taken whole. Rows with null ids
come last in the choice of a group's row, equal rows are one row, and all other columns, whatever their names or
types, come out as they were. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, keep_rows, release, row_hash, sized, small_batches, utf8
from .simhash import decode

WORDS, BITS, SHINGLE, SIMILARITY = 6, 23, 5, 0.8
#: Rounds of centres at most, and the share of nodes that the next one must gain links for.
ROUNDS, FEW = 4, 0.01
#: Equal least hashes of pairs that the rounds look at.
AGREE = 2
#: Bins of hashes that bound what two sets share; a power of two.
BINS = 128
#: One node in so many is sampled for common shingles, at every size alike; and the most shingles taken from them.
SAMPLE, COMMON = 4, 400_000
_U = np.uint64
_MIX = [_U(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64) for k in range(WORDS)]


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of hashes, different for each k."""
    with np.errstate(over="ignore"):
        x = (h ^ _MIX[k]) * _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(29)
        return x * _U(0x94D049BB133111EB) ^ (x >> _U(32))


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of the distinct shingles."""
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + size])) for i in range(n)], dtype=_U))


def signature(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(23-bit words of the SimHash, least hashes of three-word shingles)."""
    digest = xxhash.xxh64_intdigest
    own = np.array([digest(w) for w in set(words)], dtype=_U)
    ones = np.zeros(192, dtype=np.int64)
    for k in range(0, len(own), 32_768):
        part = np.stack([_mix(own[k : k + 32_768], j) for j in range(3)], axis=1)
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(own))[: WORDS * BITS].reshape(WORDS, BITS)
    grams = _hashes(words, 3)
    return bits @ (1 << np.arange(BITS)), np.array([_mix(grams, k).min() for k in range(WORDS)], dtype=_U)


def bucket_keys(codes: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) for arrays of signatures, by row and table."""
    keys, rows = [], []
    for t in range(WORDS):
        w = codes[:, t].astype(np.uint32)
        near = np.stack([decode(w)] + [decode(w ^ np.uint32(1 << i)) for i in range(BITS)], axis=1).astype(_U)
        near.sort(axis=1)
        fresh = np.concatenate([np.ones((len(w), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
        row = np.nonzero(fresh)[0]
        with np.errstate(over="ignore"):
            keys.append(_mix(least[row, t] * _U(31) + near[fresh] + _U(t << 40), t))
        rows.append(row)
    return np.concatenate(keys).view(np.int64), np.concatenate(rows)


def signatures(keyed: DataFrame) -> DataFrame:
    """(key, node, codes, least) of (key, text)."""
    rows = keyed.select("key", utf8("text").alias("bytes"))
    kind = keyed.schema["key"].dataType.simpleString()

    def run(batches):
        for b in batches:
            nodes, codes, least = [], [], []
            for t in b.column(1):
                words = t.as_buffer().to_pybytes().lower().split()
                nodes.append(xxhash.xxh64_intdigest(b" ".join(words), 7))
                c, m = signature(words) if words else (np.zeros(WORDS, dtype=np.int64), np.zeros(WORDS, dtype=_U))
                codes.append(c.tolist())
                least.append(m.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(nodes, dtype=_U).view(np.int64)), pa.array(codes, pa.list_(pa.int32())), pa.array(least, pa.list_(pa.int64()))], names=["key", "node", "codes", "least"]
            )

    return rows.mapInArrow(run, f"key {kind}, node long, codes array<int>, least array<long>")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(k, node, n) of the buckets with more than one node."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                p = b.slice(k, 1024)
                if not p.num_rows:
                    continue
                node = p.column(0).to_numpy(zero_copy_only=False)
                codes = np.array(p.column(1).to_pylist(), dtype=np.int64)
                least = np.array(p.column(2).to_pylist(), dtype=np.int64).view(_U)
                keys, rows = bucket_keys(codes, least)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node[rows])], names=["k", "node"])

    rows = nodes.select("node", "codes", "least").mapInArrow(run, "k long, node long")
    return rows.join(rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "k")


def verified_links(shared: DataFrame, signed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of each candidate a to the least node b that a chain of similar pairs joins it to.

    Only links that join components are wanted, so a pair is left out where both
    nodes are in one component already, or where the sizes of their sets rule the
    similarity out. The first round compares a node with the widest of its
    centres alone; the later ones, with all of its centres, rank these by the links of the rounds
    before. Rounds only verify pairs with ``AGREE`` equal least hashes (in ``signed``), as shuffling sets is what
    costs. All pairs left are then met by ``prefix_pairs``, so what rounds there
    are changes the work, not the result. Every round joins the components of the one before
    by its own links, so links of earlier rounds aren't gone over again.
    """
    spread = shared.groupBy("node").agg(F.sum("n").alias("spread"))
    nodes = checkpoint(spread.join(sets.select("node", "size"), "node"))
    at = nodes.withColumn("degree", F.lit(0).cast("long")).withColumn("component", F.col("node"))
    least = signed.select("node", "least")
    few = nodes.count() * FEW
    seen = links = None
    for turn in range(ROUNDS):
        ranked = shared.select("k", "node").join(at, "node")
        centre = ranked.groupBy("k").agg(F.max(F.struct("degree", "spread", "node", "size", "component")).alias("c"))
        fits = F.least("size", "c.size") / F.greatest("size", "c.size") >= similarity
        met = ranked.join(centre, "k").where(fits & (F.col("component") != F.col("c.component")))
        met = met.groupBy("node", "component").agg(F.max("c").alias("c")) if turn == 0 else met
        pairs = met.select("node", F.col("c.node").alias("centre"), F.col("component").alias("a"), F.col("c.component").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["node", "centre"], "left_anti")
        equal = F.zip_with("least", "other", lambda a, b: (a == b).cast("int"))
        signs = pairs.join(least, "node").join(least.toDF("centre", "other"), "centre")
        likely = signs.where(F.aggregate(equal, F.lit(0), lambda n, x: n + x) >= AGREE).select("node", "centre", "a", "b")
        scored = checkpoint(verified(likely, sets, similarity))
        new = scored.where("alike")
        links = new if links is None else links.unionAll(new)
        seen = scored.select("node", "centre") if seen is None else seen.unionAll(scored.select("node", "centre"))
        degree = links.select(F.explode(F.array("node", "centre")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        placed = joined(at, new).join(nodes, "node").join(degree, "node", "left")
        at = checkpoint(placed.select("node", "spread", "size", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), "component"))
        del ranked, centre, met, pairs, signs, likely, scored, degree, placed
        release(at.sparkSession)
        if turn and new.count() <= few:
            break
    del seen, links, new
    release(at.sparkSession)
    at = at.select("node", "component")
    rest = verified(bounded(prefix_pairs(sets, at, similarity).toDF("node", "centre"), sets, similarity), sets, similarity).where("alike")
    ends = rest.join(at.toDF("node", "a"), "node").join(at.toDF("centre", "b"), "centre")
    return checkpoint(joined(at, ends).toDF("a", "b"))


def joined(at: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of ``at`` after links (a, b) between its components."""
    last = connected_components(links.select("a", "b")).select(F.col("node").alias("component"), F.col("component").alias("last"))
    return at.select("node", "component").join(last, "component", "left").select("node", F.coalesce("last", "component").alias("component"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (node, centre) and their other columns, with ``alike``. Only the sets of these are shuffled, once for both joins."""
    pairs = checkpoint(pairs)
    sets = sets.join(sized(pairs.select("node").union(pairs.select("centre")).distinct()), "node", "left_semi")
    first = pairs.join(sets.select("node", F.col("grams").alias("own")), "node")
    both = first.join(sets.select(F.col("node").alias("centre"), "grams"), "centre")
    return both.select(*pairs.columns, (jaccard("own", "grams") >= similarity).alias("alike"))


def bounded(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets may be alike: two sets share no more than, by bins of their hashes, the lesser of both counts."""
    pairs = checkpoint(pairs)
    bins = sets.select("node", "size", "bins").join(sized(pairs.select("node").union(pairs.select("centre")).distinct()), "node", "left_semi")
    both = pairs.join(bins, "node").join(bins.toDF("centre", "size2", "bins2"), "centre")
    most = F.aggregate(F.zip_with("bins", "bins2", lambda a, b: F.least(a, b)), F.lit(0), lambda n, x: n + x)
    return both.where(most >= similarity / (1 + similarity) * (F.col("size") + F.col("size2")) - 1e-6).select("node", "centre")


def common_grams(sets: DataFrame, components: DataFrame) -> np.ndarray:
    """Shingles of several components in a sample, at most ``COMMON``; any choice gives the same pairs."""
    chosen = components.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0)

    def run(batches):
        for b in batches:
            for node, grams in zip(b.column(0).to_pylist(), b.column(1)):
                g = grams.values.to_numpy()
                for k in range(0, len(g), 65_536):
                    part = g[k : k + 65_536]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), node))], names=["gram", "component"])

    rows = sets.join(chosen, "node").select("component", "grams").mapInArrow(run, "gram long, component long")
    counts = rows.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high")
    return np.sort(np.array([r.gram for r in counts.orderBy(F.desc("n"), "gram").select("gram").limit(COMMON).collect()], dtype=np.int64))


def prefix_pairs(sets: DataFrame, components: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes in different components, all with a similarity of at least ``similarity`` among them.

    In an order of all shingles (those common in a sample last), sets of m and n
    shingles so alike share at least t = s / (1 + s) * (m + n), so their first common
    shingle is among the first n - ceil(s * n) + 1 of each, and t or more, it
    included, are left from there in each. So a row with ``left`` shingles from there on fits partners of
    at most (1 + s) / s * left - n shingles. Where that is less than its own n it can't meet another such
    row, as both would have to be the smaller one; the documents that are mostly one
    template are such rows. And under a shingle, the nodes of the component that has the most meet only those outside it. So
    what is compared is far from all pairs of a shingle's nodes.
    """
    common = sets.sparkSession.sparkContext.broadcast(common_grams(sets, components))

    def run(batches):
        late = common.value
        for b in batches:
            for k in range(0, b.num_rows, 256):
                p = b.slice(k, 256)
                first, size = [], []
                for grams in p.column(1):
                    g = grams.values.to_numpy()
                    keep = len(g) - int(np.ceil(similarity * len(g) - 1e-9)) + 1
                    is_late = late[np.minimum(np.searchsorted(late, g), len(late) - 1)] == g if len(late) else np.zeros(len(g), bool)
                    first.append(np.concatenate([g[~is_late], g[is_late]])[:keep])
                    size.append(len(g))
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(size, pa.int32()), pa.array(first, pa.list_(pa.int64()))], names=["node", "size", "first"])

    prefixes = sets.select("node", "grams").mapInArrow(run, "node long, size int, first array<long>")
    prefixes = checkpoint(prefixes.join(components, "node"))
    rows = prefixes.select("node", "size", "component", F.posexplode("first").alias("at", "gram"))
    rows = rows.select("gram", "node", "component", "size", (F.col("size") - F.col("at")).alias("left"))
    several = rows.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("gram")
    rows = checkpoint(rows.join(several, "gram"))
    main = rows.groupBy("gram", "component").agg(F.count("*").alias("n")).groupBy("gram").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
    rows = checkpoint(rows.join(main, "gram"))
    most = (1 + similarity) / similarity * F.col("left") - F.col("size") + 1e-6
    x = rows.where(most >= F.col("size")).alias("x")
    y = rows.alias("y")
    enough = F.least("x.left", "y.left") >= similarity / (1 + similarity) * (F.col("x.size") + F.col("y.size")) - 1e-6
    fits = (F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size") - 1e-6) & enough & (F.col("x.component") != F.col("y.component"))
    outside = x.where("component <> main").join(y, (F.col("x.gram") == F.col("y.gram")) & fits)
    inside = x.where("component = main").join(y.where("component <> main"), (F.col("x.gram") == F.col("y.gram")) & fits)
    met = outside.select("x.node", F.col("y.node").alias("other")).unionAll(inside.select("x.node", F.col("y.node").alias("other")))
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, grams: sorted hashes of five-word shingles, size, bins: how many hashes are in each of ``BINS``) of (node, text)."""
    rows = texts.select("node", utf8("text").alias("bytes"))

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                p = b.slice(k, 256)
                grams = [_hashes(t.as_buffer().to_pybytes().lower().split(), SHINGLE).view(np.int64) for t in p.column(1)]
                bins = [np.bincount(g & (BINS - 1), minlength=BINS) for g in grams]
                columns = [p.column(0), pa.array(grams, pa.list_(pa.int64())), pa.array([len(g) for g in grams], pa.int32()), pa.array(bins, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "grams", "size", "bins"])

    return rows.mapInArrow(run, "node long, grams array<long>, size int, bins array<int>")


def jaccard(left: str, right: str):
    """Jaccard similarity of two columns of sets."""
    both = F.size(F.array_intersect(left, right))
    return both / (F.size(left) + F.size(right) - both)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: the least id (nulls last), then the least hash of all
    columns; of equal rows one. Columns are those of ``docs``."""
    small_batches(docs.sparkSession)
    key = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).cast("long").alias("i"), row_hash(docs).alias("h"))
    keyed = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    rows = checkpoint(signatures(keyed))
    nodes = checkpoint(rows.groupBy("node").agg(F.min("key").alias("key"), F.first("codes").alias("codes"), F.first("least").alias("least")))
    shared = checkpoint(shared_buckets(nodes))
    counts = checkpoint(rows.groupBy("key").count())
    wanted = checkpoint(shared.select("node").distinct().join(nodes.select("node", "key"), "node").join(counts, "key"))
    once = keyed.join(sized(wanted.where("count = 1").select("key", "node")), "key").select("node", "text")
    # of equal rows any will do
    again = keyed.join(sized(wanted.where("count > 1").select("key", "node")), "key").groupBy("node").agg(F.first("text").alias("text"))
    sets = checkpoint(shingle_sets(once.unionAll(again)))
    release(docs.sparkSession)
    members = verified_links(shared, nodes, sets, similarity).toDF("node", "component")
    best = nodes.select("node", "key").join(members, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("key").alias("key"))
    return keep_rows(docs, key, best, counts)
