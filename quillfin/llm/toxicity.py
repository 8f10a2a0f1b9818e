"""Toxicity by maximum-scoring segments of token log-odds.

Fitting, on a bounded sample of labelled rows (``max_rows``, the least hashes of
their ids): document counts of words and word beginnings in toxic and clean
rows give log-odds with a Dirichlet prior proportional to the whole sample's
counts; features of five documents or more whose log-odds lie several standard errors from zero form the
model. A token weighs what its longest feature in the model says, and a fixed
penalty if it has none.

Scoring: one linear-time scan over a document's token weights finds all
maximal scoring segments (Ruzzo and Tompa). A segment's score s among n tokens has
the extreme-value chance 1 - exp(-K n exp(-lambda s)), with lambda the positive root of
E[exp(lambda weight)] = 1 over the clean rows' tokens and K fitted to their best
segments. The score of a document is a logistic function, fitted on the sample, of the evidence of its
best segment and of all its significant segments together.

Null and empty texts have no tokens and get the score of no evidence. Rows stay
as many as they are; very long texts are scored whole. An id with several texts is learnt from one of them. Labelled rows without a document, with a null label or id are
passed over. Without both labels in the sample, the score is its share of toxic rows
(0 without rows).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small_batches

MAX_ROWS = 20_000
PREFIXES = (5, 6, 7, 8)
PRIOR = 50.0
MIN_Z = 3.5
MIN_DOCS = 5
#: Weight of a token without a feature, in nats; other weights are cut to WEIGHTS.
PENALTY = -0.25
WEIGHTS = (-2.0, 6.0)
SIGNIFICANT = 0.05
WORD = re.compile(r"[^\W\d_]+")
#: Tokens remembered by a worker, and the longest ones that are.
MEMO, MEMO_LENGTH = 300_000, 48


def word_of(token: str) -> str:
    """The first run of letters, in lower case."""
    m = WORD.search(token.lower())
    return m[0] if m else ""


def features_of(word: str) -> list[str]:
    """The word itself, then its beginnings, longest first."""
    return [word] + [word[:n] + "*" for n in reversed(PREFIXES) if len(word) > n] if word else []


def segments(weights: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), left to right, in linear time."""
    total = 0.0
    stack: list[list] = []  # start, end, sum before, sum after
    for i, w in enumerate(weights):
        before, total = total, total + w
        if w <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new.append(j)
                stack.append(new)
                break
            new[0], new[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, y - x) for a, b, x, y, _ in stack]


@dataclass
class Model:
    weights: dict[str, float]
    base: float = 0.0
    lam: float = 1.0
    log_k: float = 0.0
    beta: tuple[float, ...] = (0.0, 0.0, 0.0)
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def weight(self, token: str) -> float:
        w = self.memo.get(token)
        if w is None:
            w = next((self.weights[f] for f in features_of(word_of(token)) if f in self.weights), PENALTY)
            if len(token) <= MEMO_LENGTH:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[token] = w
        return w

    def spans(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, maximal segments."""
        tokens = text.split()
        w = list(map(self.memo.get, tokens))
        if None in w:
            w = [self.weight(t) if x is None else x for t, x in zip(tokens, w)]
        if not w or max(w) <= 0:
            return len(w), []
        return len(w), segments(w)

    def evidence(self, score: float, n: int) -> float:
        """Minus the logarithm of a score's extreme-value chance among n tokens, at most 60."""
        expected = math.exp(min(self.log_k + math.log(n) - self.lam * score, 50.0))
        return min(-math.log(max(-math.expm1(-expected), 1e-26)), 60.0)

    def summary(self, text: str) -> tuple[float, float]:
        """Evidence of the best segment; of all significant ones together."""
        n, found = self.spans(text)
        each = [self.evidence(s, n) for _, _, s in found]
        return max(each, default=0.0), sum(e for e in each if e >= -math.log(SIGNIFICANT))

    def terms(self, text: str) -> tuple[float, float]:
        """What the logistic function takes."""
        best, all_ = self.summary(text)
        return math.sqrt(best), math.log1p(all_)

    def score(self, text: str) -> float:
        if not self.beta:
            return self.base
        best, all_ = self.terms(text)
        z = self.beta[0] + self.beta[1] * best + self.beta[2] * all_
        return 1 / (1 + math.exp(-max(min(z, 40.0), -40.0)))


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, toxic) of at most ``max_rows`` labelled ids, one text each; the labels' bound makes them fit to broadcast."""
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    own = own.groupBy("id").agg((F.max("toxic") == 1).cast("int").alias("toxic"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(own), "id")
    return checkpoint(rows.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("r")).select("r.text", "r.toxic"))


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> Model:
    """``labels`` has the rows to learn from; see the module.

    Features are chosen, and scores counted, by Spark: the driver gets the features of the model,
    and histograms with values rounded to hundredths.
    """
    small_batches(docs.sparkSession)
    sample = _sample(docs, labels, max_rows, id_col, text_col, label_col)
    n_clean, n_toxic = sample.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    if not n_clean or not n_toxic:
        return Model({}, base=n_toxic / max(n_clean + n_toxic, 1), beta=())

    def count(batches):
        counts: dict[str, list[int]] = {}
        for b in batches:
            for text, y in _rows(b):
                for f in {f for w in {word_of(t) for t in set(text.split())} for f in features_of(w)}:
                    counts.setdefault(f, [0, 0])[y] += 1
                if len(counts) > 200_000:
                    yield _counts(counts)
                    counts = {}
        yield _counts(counts)

    counted = sample.mapInArrow(count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    # log-odds with the prior's counts in proportion to those of both labels together, and their standard error
    prior = PRIOR * (F.col("c") + F.col("t") + 1) / (n_clean + n_toxic + 2)
    has_t, has_c = F.col("t") + prior, F.col("c") + prior
    not_t, not_c = n_toxic + PRIOR - has_t, n_clean + PRIOR - has_c
    odds = F.log(has_t / not_t) - F.log(has_c / not_c)
    z = odds / F.sqrt(1 / has_t + 1 / has_c + 1 / not_t + 1 / not_c)
    chosen = counted.where(F.col("c") + F.col("t") >= MIN_DOCS).select("f", odds.alias("odds"), z.alias("z")).where(F.abs("z") >= MIN_Z)
    model = Model({r.f: min(max(r.odds, WEIGHTS[0]), WEIGHTS[1]) for r in chosen.select("f", "odds").toLocalIterator()})

    def scan(batches):
        """Rows (what, value, n): weights of clean tokens, tokens of clean texts, and best segments of clean texts."""
        seen: Counter = Counter()
        for b in batches:
            for text, y in _rows(b):
                if y == 0 and (tokens := text.split()):
                    weights = list(map(model.weight, tokens))
                    seen.update(("weight", round(w, 2)) for w in weights)
                    seen["tokens", 0.0] += len(tokens)
                    seen["best", round(max((s for _, _, s in segments(weights)), default=0.0), 2)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([v for _, v in seen], pa.float64()), pa.array(list(seen.values()), pa.int64())], names=["what", "value", "n"])

    histogram = sample.mapInArrow(scan, "what string, value double, n long").groupBy("what", "value").agg(F.sum("n").alias("n")).collect()
    model.lam = _root({r.value: r.n for r in histogram if r.what == "weight"})
    best = sorted((r.value, r.n) for r in histogram if r.what == "best")
    own = [(s, n) for s, n in best if s > 0]
    # the mean number of best segments at or above a level, per token, at the level their median reaches
    if own:
        half, level = sum(n for _, n in own) / 2, own[-1][0]
        for s, n in own:
            half -= n
            if half <= 0:
                level = s
                break
        quiet = sum(n for _, n in best)
        share = min(sum(n for s, n in own if s >= level) / quiet, 1 - 1e-6)
        model.log_k = math.log(-math.log1p(-share) * quiet / sum(r.n for r in histogram if r.what == "tokens")) + model.lam * level

    def evidences(batches):
        seen: Counter = Counter()
        for b in batches:
            seen.update((*(round(x, 2) for x in model.terms(text)), y) for text, y in _rows(b))
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in seen], pa.float64()) for i in (0, 1)), pa.array([k[2] for k in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["best", "all", "toxic", "n"])

    cells = sample.mapInArrow(evidences, "best double, all double, toxic long, n long").groupBy("best", "all", "toxic").agg(F.sum("n").alias("n")).collect()
    cells.sort()
    model.beta = _logistic(np.array([(1.0, r.best, r["all"]) for r in cells]), np.array([r.toxic for r in cells], dtype=float), np.array([r.n for r in cells], dtype=float))
    return model


def _rows(b: pa.RecordBatch) -> Iterator[tuple[str, int]]:
    """(text, toxic), a string at a time."""
    return ((text.as_py(), y) for text, y in zip(b.column(0), b.column(1).to_pylist()))


def _counts(counts: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1))], names=["f", "clean", "toxic"])


def _root(background: dict[float, int]) -> float:
    """The positive lambda with mean exp(lambda weight) = 1, or 1 where none exists."""
    v, k = np.array(list(background)), np.array(list(background.values()), dtype=float)
    if not len(v) or v.max() <= 0 or (v * k).sum() >= 0:
        return 1.0
    low, high = 1e-6, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (k * np.exp(np.minimum(mid * v, 600))).sum() < k.sum() else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Coefficients for rows that count n times each."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        beta += np.linalg.solve(h, x.T @ (n * (y - p)) - ridge * beta)
    return tuple(beta.tolist())


def score_column(model: Model, text_col: str = "text"):
    """The score of a text column. A batch's texts become strings one at a time, as a worker keeps the memory that it once took;
    what it remembers of tokens goes with the task."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                yield pa.array((model.score(t.as_py() or "") for t in texts), pa.float64())
        finally:
            model.memo.clear()

    return score(F.col(text_col))


def toxic_segments(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_token, end_token, score, evidence) of every significant segment."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for pdf in batches:
            out = []
            for i, text in zip(pdf.id, pdf.text):
                n, found = model.spans(text)
                out += [(i, a, b, s, e) for a, b, s in found if (e := model.evidence(s, n)) >= -math.log(SIGNIFICANT)]
            yield pd.DataFrame(out, columns=["id", "start_token", "end_token", "score", "evidence"]).astype({"id": "Int64"})

    return rows.mapInPandas(run, "id long, start_token int, end_token int, score double, evidence double")


def held_out(id_col: str = "doc_id"):
    """Rows kept from learning: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))
