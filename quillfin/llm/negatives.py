"""Hard negatives by distributed radix selection.

A row's score is its inner product with an anchor, in whole numbers. Of each anchor the first ``positives`` rows of its label are
selected, then for each of these the first ``negatives`` rows of other labels whose score lies in a window below the positive's. Both are the
same selection: the first k rows of a window in order of (score, descending; id, ascending).

Scores are never sorted or kept. Every task counts its rows by digits of their scores, for each window; the counts, added up, show the bucket with the
kth row; the next round splits that bucket by its next digit, until it is as small as what is wanted of it. If more rows than wanted share the
last score, their ids' digits follow. Then one more pass gathers the rows at or above the bounds so found: k for each window. A task leaves out the
buckets below its own kth row, which can't hold the window's kth row, so what is shuffled is k counts for each window and task at most.

Scoring compares all rows with the anchors, in blocks: anchors go out in slabs of about ``SLAB`` rows (a bound in bytes, whatever the table's size),
and each task multiplies blocks of its rows with them. Rows are never shuffled by key, so a hot label or vector costs no more than others.

Inputs: rows with a null id, label or vector, or with a null or non-finite component, take no part, nor do those with a component of 2^20 or more in size (256 times
that doesn't fit the scores). Vectors of different lengths count missing components as 0. Rows with the anchor's own id are not "other rows". Repeated
rows count as often as they occur, equal anchors are answered once; equal scores go by id, and rows with equal ids and scores are interchangeable. An empty
table, or one without anchors, gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder

SCALE = 256
#: Components beyond this are left out.
LARGEST = float(1 << 20)
#: Anchors that are sent to tasks at a time, about.
SLAB = 8192
#: Bits of a digit; scores of a block of rows at a time; counts that a task holds before it adds them up.
DIGIT, BLOCK, HELD = 12, 1 << 22, 1 << 20
_SCORE, _ID, _DONE = 0, 1, 2
_LEAST = np.iinfo(np.int64).min


def prepared(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id, label, q: whole components) of the rows that take part, dealt evenly and written."""
    spark = rows.sparkSession
    v = F.col(vector_col)
    usable = F.coalesce(F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST, F.lit(False))), F.lit(False))
    own = rows.where(F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & usable)
    own = own.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("q"))
    out = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).write.parquet(out)
    return spark.read.parquet(out)


def matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    """A list column as rows of ``width`` numbers, shorter ones filled up with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width).astype(dtype)
    out = np.zeros((len(lengths), width), dtype)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


@dataclass
class Slab:
    """Anchors, and ``slots`` windows of scores for each; window w belongs to anchor w // slots."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray  # a column for each anchor
    same: bool  # rows of the anchor's label, else of others
    slots: int
    want: int
    low: np.ndarray  # by window: its bounds
    high: np.ndarray
    digit: int  # bits of a digit

    def start(self, ids: tuple[int, int]) -> None:
        self.id_bounds = ids
        n = len(self.low)
        self.a, self.b = self.low.copy(), self.high.copy()
        self.need = np.full(n, self.want)
        self.phase = np.where(self.low <= self.high, _SCORE, _DONE)
        self.score, self.value = self.low.copy(), np.full(n, _LEAST)

    @property
    def shift(self) -> np.ndarray:
        """Bits of the present bucket below the next digit."""
        width = np.maximum(self.b - self.a, 0)
        bits = np.array([int(x).bit_length() for x in width])
        return np.maximum(bits - self.digit, 0)

    def entries(self, batch: pa.RecordBatch, lower: np.ndarray, upper: np.ndarray):
        """(row's id, anchor, score) of a batch's rows within bounds by anchor, a block at a time."""
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        x = matrix(batch.column(2), len(self.vectors), self.vectors.dtype)
        step = max(1, BLOCK // max(1, len(self.ids)))
        for k in range(0, len(ids), step):
            s = x[k : k + step] @ self.vectors
            alike = labels[k : k + step, None] == self.labels
            met = (s >= lower) & (s <= upper) & (alike if self.same else ~alike)
            r, c = np.nonzero(met)
            score, own = s[r, c].astype(np.int64), ids[k : k + step][r]
            other = own != self.ids[c]
            yield own[other], c[other], score[other]

    def by_anchor(self, x: np.ndarray, pick) -> np.ndarray:
        return pick(x.reshape(-1, self.slots), axis=1)

    def update(self, found: list) -> None:
        """The buckets (window, digit from the top, rows above, rows inside) that hold the kth rows; windows without one have fewer rows."""
        w, top, above, inside = (np.array(c, dtype=np.int64) for c in (zip(*found) if found else ((), (), (), ())))
        shift = self.shift
        left = np.ones(len(self.low), dtype=bool)
        left[w] = False
        self.phase[left] = _DONE
        a = self.a[w] + (((1 << self.digit) - 1 - top) << shift[w])
        b = np.minimum(self.b[w], a + (1 << shift[w]) - 1)
        need = self.need[w] - above
        by_id = self.phase[w] == _ID
        self.score[w] = np.where(by_id, self.score[w], a)
        self.value[w] = np.where(by_id, a, _LEAST)
        whole = (inside == need) | by_id & (shift[w] == 0)
        turn = ~whole & ~by_id & (shift[w] == 0)
        self.need[w], self.phase[w] = need, np.where(whole, _DONE, np.where(turn, _ID, self.phase[w]))
        self.a[w], self.b[w] = np.where(turn, -self.id_bounds[1], a), np.where(turn, -self.id_bounds[0], b)


def _histogram(rows: DataFrame, slab: Slab) -> DataFrame:
    """(w, top, n, need): rows of each window's bucket by their next digit, counted from the top."""
    sent = rows.sparkSession.sparkContext.broadcast(slab)

    def run(batches):
        s: Slab = sent.value
        shift, floor = s.shift, s.a.copy()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added():
            codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([n for _, n in held]), len(codes)).astype(np.int64)
            w = codes >> s.digit
            first = np.searchsorted(w, w)
            before = np.cumsum(counts) - counts
            before -= before[first]
            keep = before < s.need[w]
            reached = keep & (before + counts >= s.need[w])
            low = s.a[w[reached]] + (((1 << s.digit) - 1 - (codes[reached] & ((1 << s.digit) - 1))) << shift[w[reached]])
            floor[w[reached]] = np.maximum(floor[w[reached]], low)
            held[:] = [(codes[keep], counts[keep])]

        def bounds():
            off = s.phase == _DONE
            lower = np.where(off, np.iinfo(np.int64).max, np.where(s.phase == _ID, s.score, floor))
            upper = np.where(off, _LEAST, np.where(s.phase == _ID, s.score, s.b))
            return s.by_anchor(lower, np.min), s.by_anchor(upper, np.max)

        lower, upper = bounds()
        for batch in batches:
            for ids, anchor, score in s.entries(batch, lower, upper):
                for j in range(s.slots):
                    w = anchor * s.slots + j
                    by_id = s.phase[w] == _ID
                    v = np.where(by_id, -ids, score)
                    keep = (s.phase[w] != _DONE) & (v >= floor[w]) & (v <= s.b[w]) & (~by_id | (score == s.score[w]))
                    w, v = w[keep], v[keep]
                    top = (1 << s.digit) - 1 - ((v - s.a[w]) >> shift[w])
                    held.append((w << s.digit | top, np.ones(len(w), dtype=np.int64)))
                if sum(len(c) for c, _ in held) > HELD + 2 * len(s.low) * s.want:
                    added()
                    lower, upper = bounds()
        if held:
            added()
            codes, counts = held[0]
            w = codes >> s.digit
            for k in range(0, len(w), 1 << 16):
                p = slice(k, k + (1 << 16))
                columns = [pa.array(w[p].astype(np.int32)), pa.array((codes[p] & ((1 << s.digit) - 1)).astype(np.int32)), pa.array(counts[p]), pa.array(s.need[w[p]].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["w", "top", "n", "need"])

    return rows.mapInArrow(run, "w int, top int, n long, need int")


def _gather(rows: DataFrame, slab: Slab) -> DataFrame:
    """(w, score, id) of the rows at or above the windows' bounds; of each task the first ``want`` of a window, as equal rows may be any number."""
    sent = rows.sparkSession.sparkContext.broadcast(slab)

    def run(batches):
        s: Slab = sent.value
        empty = s.low > s.high
        lower = s.by_anchor(np.where(empty, np.iinfo(np.int64).max, s.score), np.min)
        upper = s.by_anchor(np.where(empty, _LEAST, s.high), np.max)
        found = [np.zeros((3, 0), dtype=np.int64)]

        def first():
            w, score, ids = np.concatenate(found, axis=1)
            order = np.lexsort((ids, -score, w))
            w, score, ids = w[order], score[order], ids[order]
            keep = np.arange(len(w)) - np.searchsorted(w, w) < s.want
            found[:] = [np.stack([w[keep], score[keep], ids[keep]])]

        for batch in batches:
            for ids, anchor, score in s.entries(batch, lower, upper):
                for j in range(s.slots):
                    w = anchor * s.slots + j
                    keep = (score <= s.high[w]) & ((score > s.score[w]) | (score == s.score[w]) & (-ids >= s.value[w])) & ~empty[w]
                    found.append(np.stack([w[keep], score[keep], ids[keep]]))
                if sum(f.shape[1] for f in found) > HELD + 2 * len(s.low) * s.want:
                    first()
        first()
        w, score, ids = found[0]
        for k in range(0, len(w), 1 << 16):
            p = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(w[p].astype(np.int32)), pa.array(score[p]), pa.array(ids[p])], names=["w", "score", "id"])

    found = rows.mapInArrow(run, "w int, score long, id long")
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= slab.want)


def select(rows: DataFrame, slab: Slab, ids: tuple[int, int]) -> DataFrame:
    """(w, rank, score, id): the first rows of each of the slab's windows."""
    slab.start(ids)
    while (slab.phase != _DONE).any():
        counts = _histogram(rows, slab).groupBy("w", "top").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
        above = F.coalesce(F.sum("n").over(Window.partitionBy("w").orderBy("top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # one bucket a window, so no more than the slab's windows
        slab.update(counts.withColumn("above", above).where("above < need and above + n >= need").select("w", "top", "above", "n").collect())
    return _gather(rows, slab)


def bound(anchor: np.ndarray, longest: int) -> np.ndarray:
    """By Cauchy and Schwarz, the largest score of each anchor; ``longest`` is the largest squared length of a row."""
    return np.array([math.isqrt(int(n) * longest) + 1 for n in anchor], dtype=np.int64)


def mine(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, at_least: tuple[int, int] = (80, 100), id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` (over ``id`` and ``label``) tells which rows are anchors. A negative's score, times ``at_least[1]``, is at least ``at_least[0]`` times the positive's, and the score
    at most the positive's.
    """
    spark = rows.sparkSession
    own = prepared(rows, id_col, vector_col, F.col("label") if label is None else label)
    length = F.aggregate("q", F.lit(0).cast("long"), lambda n, x: n + x.cast("long") * x.cast("long"))
    s = own.agg(F.max(length).alias("longest"), F.max(F.size("q")).alias("width"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    chosen = own.where(anchor).distinct()
    n = chosen.count()
    out = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(out)
    if n == 0:
        return spark.read.schema(schema).parquet(out)
    if s.longest >= 1 << 62:
        raise ValueError("scores of these vectors don't fit 64 bits")
    exact = np.float64 if s.longest < 1 << 53 else np.int64
    slabs = -(-n // SLAB)
    for k in range(slabs):
        t = chosen.where(F.pmod(F.xxhash64("id", "q"), F.lit(slabs)) == k).toArrow()
        if not t.num_rows:
            continue
        ids, labels = t["id"].to_numpy(), t["label"].to_numpy()
        vectors = matrix(t["q"], s.width, np.int64)
        most = bound((vectors**2).sum(axis=1), s.longest)
        vectors = np.ascontiguousarray(vectors.T.astype(exact))
        first = select(own, Slab(ids, labels, vectors, True, 1, positives, -most, most, DIGIT), (s.low, s.high)).toArrow()
        w, rank, score, own_id = (first[c].to_numpy() for c in ("w", "rank", "score", "id"))
        # windows of no scores stand for positives that an anchor lacks
        at = w * positives + rank - 1
        low, high, positive = np.ones(len(ids) * positives, dtype=np.int64), np.zeros(len(ids) * positives, dtype=np.int64), np.zeros(len(ids) * positives, dtype=np.int64)
        low[at], high[at], positive[at] = -((-at_least[0] * score) // at_least[1]), score, own_id
        found = select(own, Slab(ids, labels, vectors, False, positives, negatives, low, high, DIGIT), (s.low, s.high))
        windows = spark.createDataFrame(pa.table([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(np.repeat(ids, positives)), pa.array(positive), pa.array(high)], names=["w", "anchor_id", "positive_id", "positive_score"]))
        named = found.join(windows, "w").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        named.write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)
