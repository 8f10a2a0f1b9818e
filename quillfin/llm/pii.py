"""Personal data: patterns, and a skip-chain conditional random field.

Patterns give the base spans. Nodes of the field are the base spans, whose labels are
observed, and further mentions that look like personal data (long numbers,
near-addresses). Neighbours in a text share a transition potential; mentions
whose last digits, or mailbox names, are alike share a skip potential with their
previous such mention however far away. Loopy sum-product message passing makes a document's labels
consistent: a number seen once as ``+49 30 ...`` is a phone number elsewhere in that document too.
Mentions whose likeliest label isn't ``none`` are added spans.

Weights are fitted on a bounded sample of texts (``max_docs`` distinct ones, those of least hash), labelled by the patterns. All of them,
those of nodes, transitions and skips, maximise the sample's pseudo-likelihood: the chance of each label given its
mention and the labels of its neighbours, with a Gaussian prior around zero (skips: around ``SKIP_PRIOR`` for equal labels).
A mention without a pattern may be personal data all the same, so it says nothing about skips in the sample. Each base span
counts twice, once with what its pattern goes by hidden (the sign of an address, the plus of a number): so the field learns to find such data by its shape and surroundings, too.
On texts in which such a mark is missing, tests hold that it does; where all that patterns miss is no personal data (numbers with a wrong check digit), it adds none.

Null texts count as empty, without spans; rows stay as many as they are; rows with null ids keep them; an
empty table gives an empty result; other columns are ignored. Very long texts are searched whole; time and memory are linear in
a text's length: every mention has at most two edges to earlier ones. So is each round and sweep of
messages; sweeps go on until messages settle, as a rule after a few.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
MAX_DOCS = 4_000
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NUMBER = re.compile(r"(?<![0-9])[0-9](?:[ ().-]{0,2}[0-9]){6,}")
MARK = re.compile(r"\(at\)|\[at\]| at ")
SHORT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+")
NOT_DIGIT = re.compile(r"[^0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CONTEXT = 32
NEAR = 300
SKIP_PRIOR = 2.0
SETTLED = 1e-3


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind, then start."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((0, begin, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


FEATURES = ("bias", "at", "plus", "paren", "space", "hyphen", "dots=0", "dots=1-2", "dots=3", "dots=4+", "digits<7", "digits=7-9", "digits=10-15", "digits=16-19", "digits=20+", "luhn", "group<=3")


#: Marks that the patterns go by and writers leave out (a wrong check digit or a part over 255 is another matter); hidden from some of the sample's mentions, so that the rest of a mention and its surroundings must tell.
CUES = frozenset(FEATURES.index(c) for c in ("at", "plus"))


@dataclass
class Node:
    start: int
    end: int
    label: int | None
    key: str
    features: tuple[int, ...]


def mentions(text: str) -> list[tuple[int, int]]:
    """Spans that look like numbers or addresses, leftmost and not overlapping."""
    found = [m.span() for m in NUMBER.finditer(text)]
    for m in MARK.finditer(text):
        begin = m.start()
        # no run of such characters has a mark inside, so each is walked once
        while begin > 0 and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        if begin < m.start() and (d := DOMAIN.match(text, m.end())):
            found.append((begin, d.end()))
    if "@" in text:
        found += [m.span() for m in SHORT.finditer(text)]
    out, reach = [], 0
    for s, e in sorted(found, key=lambda x: (x[0], -x[1])):
        if s >= reach:
            out.append((s, e))
            reach = e
    return out


def nodes(text: str, base: list[tuple[int, int, int]]) -> list[Node]:
    """Base spans and further mentions not overlapping them, by start."""
    taken = sorted((s, e, k) for k, s, e in base)
    found = list(taken)
    i, reach = 0, -1
    for s, e in mentions(text):
        while i < len(taken) and taken[i][0] < e:
            reach = max(reach, taken[i][1])
            i += 1
        if s >= reach:
            found.append((s, e, None))
    found.sort(key=lambda x: (x[0], x[1], -1 if x[2] is None else x[2]))
    out = []
    for s, e, label in found:
        t = text[s:e]
        digits = NOT_DIGIT.sub("", t)
        mail = "@" in t or " at " in t or "(at)" in t or "[at]" in t
        key = "m" + re.split(r"@| at |\(at\)|\[at\]", t)[0].lower() if mail else "n" + digits[-7:]
        n, dots = len(digits), t.count(".")
        f = [0]
        f += [1] * mail + [2] * (t[0] == "+") + [3] * ("(" in t) + [4] * (" " in t) + [5] * ("-" in t)
        f.append(6 if dots == 0 else 7 if dots <= 2 else 8 if dots == 3 else 9)
        f.append(10 if n < 7 else 11 if n < 10 else 12 if n < 16 else 13 if n < 20 else 14)
        f += [15] * (16 <= n <= 19 and luhn(digits)) + [16] * (not mail and max(map(len, re.split(r"[^0-9]+", t))) <= 3)
        before = text[max(0, s - 24) : s].lower().split()
        f.append(len(FEATURES) + zlib.crc32(before[-1].encode("utf-8", "replace")) % CONTEXT if before else 0)
        out.append(Node(s, e, label, key, tuple(sorted(set(f)))))
    return out


def edges(ns: list[Node]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between neighbours in reach, skip edges to the last mention alike."""
    chain = [(i - 1, i) for i in range(1, len(ns)) if ns[i].start - ns[i - 1].end <= NEAR]
    skip, last = [], {}
    for i, n in enumerate(ns):
        if n.key in last:
            skip.append((last[n.key], i))
        last[n.key] = i
    return chain, skip


@dataclass
class Field:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels, logarithms
    skip: np.ndarray

    def marginals(self, ns: list[Node], rounds: int = 12, damping: float = 0.3) -> np.ndarray:
        """Label probabilities of each node by loopy belief propagation: rounds in step, then sweeps where these don't settle."""
        u = np.array([self.unary[list(n.features)].sum(axis=0) for n in ns])
        seen = np.array([-1 if n.label is None else n.label for n in ns])
        u[seen >= 0] = -1e3
        u[seen >= 0, seen[seen >= 0]] = 0.0
        chain, skip = edges(ns)
        pairs = chain + skip
        if pairs:
            a, b = np.array(pairs).T
            src, dst = np.concatenate([a, b]), np.concatenate([b, a])
            pot = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
            pot = np.concatenate([pot, pot.transpose(0, 2, 1)])  # from src (rows) to dst
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            msg = np.zeros((len(src), NONE + 1))
            for _ in range(rounds):
                belief = u.copy()
                np.add.at(belief, dst, msg)
                out = belief[src] - msg[back]
                new = np.logaddexp.reduce(out[:, :, None] + pot, axis=1)
                new -= new.max(axis=1, keepdims=True)
                moved = np.abs(new - msg).max()
                msg = damping * msg + (1 - damping) * new
            if moved > SETTLED:
                self.sweep(u, src, dst, pot, back, msg)
            np.add.at(u, dst, msg)
        u -= u.max(axis=1, keepdims=True)
        p = np.exp(u)
        return p / p.sum(axis=1, keepdims=True)

    @staticmethod
    def sweep(u, src, dst, pot, back, msg, damping: float = 0.3) -> None:
        """Passes messages on in the order of the text, then against it, until they
        settle: one sweep takes a label along a whole skip chain. At most as many
        sweeps as there are nodes."""
        belief = u.copy()
        np.add.at(belief, dst, msg)
        ahead = src < dst
        order = np.concatenate([np.nonzero(ahead)[0][np.lexsort((dst[ahead], src[ahead]))], np.nonzero(~ahead)[0][np.lexsort((-dst[~ahead], -src[~ahead]))]])
        for _ in range(len(u)):
            moved = 0.0
            for e in order:
                t = (belief[src[e]] - msg[back[e]])[:, None] + pot[e]
                top = t.max(axis=0)
                new = top + np.log(np.exp(t - top).sum(axis=0))
                step = (1 - damping) * (new - new.max() - msg[e])
                msg[e] += step
                belief[dst[e]] += step
                moved = max(moved, np.abs(step).max())
            if moved <= SETTLED:
                return

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(base spans, all spans): (kind, start, end), by kind, then start."""
        base = base_spans(text)
        if not any(c in text for c in "0123456789@") and " at " not in text and "at)" not in text and "at]" not in text:
            return base, base
        ns = nodes(text, base)
        if all(n.label is not None for n in ns):
            return base, base
        best = self.marginals(ns).argmax(axis=1)
        added = [(int(k), n.start, n.end) for k, n in zip(best, ns) if n.label is None and k != NONE]
        return base, sorted(base + added)


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, text_col: str = "text") -> Field:
    rows = docs.select(F.col(text_col).alias("text")).where("text is not null").select("text", F.xxhash64("text").alias("h"))
    chosen = rows.select("h").distinct().orderBy("h").limit(max_docs)
    sample = rows.join(F.broadcast(chosen), "h").dropDuplicates(["h"]).select("text")

    def run(batches):
        """Rows (label, features, counts of neighbours' labels, n); counts are those before, after and over skips."""
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                ns = nodes(text, base_spans(text))
                near = np.zeros((len(ns), 3, NONE + 1), dtype=int)
                chain, skip = edges(ns)
                label = [NONE if n.label is None else n.label for n in ns]
                for i, j in chain:
                    near[j, 0, label[i]] += 1
                    near[i, 1, label[j]] += 1
                for i, j in skip:
                    if NONE not in (label[i], label[j]):
                        near[j, 2, label[i]] += 1
                        near[i, 2, label[j]] += 1
                counts.update((y, n.features, tuple(x.ravel().tolist())) for y, n, x in zip(label, ns, near))
                # every base span again as if no pattern had found it
                counts.update((y, tuple(f for f in n.features if f not in CUES), tuple(x.ravel().tolist())) for y, n, x in zip(label, ns, near) if y != NONE)
        keys = list(counts)
        ints = pa.list_(pa.int32())
        columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], ints), pa.array([k[2] for k in keys], ints), pa.array([counts[k] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["label", "features", "near", "n"])

    schema = "label int, features array<int>, near array<int>, n long"
    # patterns of a mention are few kinds of shapes
    patterns = sorted(sample.mapInArrow(run, schema).groupBy("label", "features", "near").agg(F.sum("n").alias("n")).collect())
    width, labels = len(FEATURES) + CONTEXT, NONE + 1
    x, near = np.zeros((len(patterns), width)), np.zeros((len(patterns), 3, labels))
    for i, r in enumerate(patterns):
        x[i, r.features], near[i] = 1, np.reshape(r.near, (3, labels))
    # labels chosen by the patterns alone are known too well: some of the count goes to all the others
    target = np.full((len(patterns), labels), 0.1)
    target[np.arange(len(patterns)), np.array([r.label for r in patterns], dtype=int)] += 1
    target /= target.sum(axis=1, keepdims=True)
    share = np.sqrt([r.n for r in patterns])
    share /= max(share.sum(), 1)
    return Field(*maximise(x, near, target, share))


def maximise(x: np.ndarray, near: np.ndarray, target: np.ndarray, share: np.ndarray, steps: int = 400, rate: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, transition, skip weights) of the most penalised pseudo-likelihood, by gradient ascent.

    A label's score is its node weights' sum, plus transitions from the label before and to the one after, plus skips, which have no direction.
    """
    labels = target.shape[1]
    prior = SKIP_PRIOR * np.eye(labels)
    w, chain, skip = np.zeros((x.shape[1], labels)), np.zeros((labels, labels)), prior.copy()
    before, after, over = near[:, 0], near[:, 1], near[:, 2]
    for _ in range(steps):
        z = x @ w + before @ chain + after @ chain.T + over @ skip
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (target - p) * share[:, None]
        w += rate * (x.T @ error - 1e-4 * w)
        chain += rate * (before.T @ error + error.T @ after - 1e-2 * chain)
        both = over.T @ error
        skip += rate * ((both + both.T) / 2 - 1e-2 * (skip - prior))
    return w, chain, skip


def find(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): arrays of struct<kind, start, end>, by kind, then start; a row for each row of ``docs``."""
    field = field or fit(docs, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def named(spans):
        return [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans]

    def run(batches):
        for pdf in batches:
            found = [shared.value.spans(t) for t in pdf.text]
            yield pd.DataFrame({"id": pdf.id.astype("Int64"), "base": [named(b) for b, _ in found], "spans": [named(a) for _, a in found]})

    span = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInPandas(run, f"id long, base {span}, spans {span}")
