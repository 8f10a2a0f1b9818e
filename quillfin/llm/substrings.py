"""Passages that other documents repeat, found by doubling and removed.

A window is ``window`` consecutive words; it goes, with all its words, where a document with a smaller id has it too. Windows
repeated at half that length (rounded up) alone are extended to the whole:

* Half. Inside a document the hashes of 2, 4, 8, ... words are put together from those of half as many, up to the half length. Each whole window
  stands under its least half window (by hash; the first of equal ones), which equal windows share whatever lies around them. Neighbouring windows
  mostly share it, so these marks are two of ``window - half + 2`` positions. Marks that no two documents share are no candidates and end here.
* Whole, at once. All windows under one mark make a stretch of ``window`` to twice as many words. Stretches are compared first: where a smaller document
  has the same, all its windows go. Of equal stretches only the least document's goes on, so that copies are compared once.
* Whole, one by one. Marks that still have different stretches are the edges of passages. The windows under these are compared by themselves.

No candidates are left then: a repeat longer than the window is the union of its windows. Hashes have 64 bits; stretches and windows are equal only if their mark's are, too, which makes 128. All
steps are aggregates and joins of narrow rows by hash; counts are combined before the shuffle, and hot keys meet one row of the
other side, so that they are split at will.

Words are the runs of bytes other than space, tab, line feed, vertical tab, form feed and return, unchanged. Texts are taken whole, in pieces of bounded memory. Null texts have no words; those shorter than a
window lose none. Rows with a null id are kept as they are and take part in nothing; rows with equal ids don't remove each other's words. A row
comes out as often as it came in. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, utf8

WINDOW = 50
#: Words hashed at a time, bytes of a text split at a time, and bytes of texts in a result batch.
WORDS, PIECE, BATCH = 1 << 18, 1 << 20, 1 << 25
_SPACE = b" \t\n\v\f\r"
_U = np.uint64


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    a = 0
    while a < len(text):
        b = min(a + PIECE, len(text))
        while b < len(text) and text[b] not in _SPACE:
            b += 1
        yield text[a:b].split()
        a = b


def word_hashes(text: bytes) -> np.ndarray:
    parts = [np.fromiter(map(xxhash.xxh64_intdigest, w), dtype=_U, count=len(w)) for w in pieces(text)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=_U)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    with np.errstate(over="ignore"):
        x = a * _U(0x9E3779B97F4A7C15) + (b ^ (b >> _U(31))) * _U(0xC2B2AE3D27D4EB4F) + _U(0x165667B19E3779F9)
        x ^= x >> _U(29)
        x *= _U(0xBF58476D1CE4E5B9)
        return x ^ (x >> _U(32))


def runs_of(one: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, by doubling: two runs of half the length, which overlap where the length is odd."""
    if size == 1:
        return one
    half = runs_of(one, (size + 1) // 2)
    step = size // 2
    return mixed(half[: len(half) - step], half[step:])


def first_least(values: np.ndarray, size: int) -> np.ndarray:
    """Of all runs of ``size`` values, where the least is; the first of equal ones."""
    at, span = np.arange(len(values)), 1
    while span < size:
        step = min(span, size - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        span += step
    return at


def stretches(one: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(mark's hash, stretch's hash, first window, windows) of a row of word hashes of several texts; ``end`` says for each word where its text ends."""
    half = (window + 1) // 2
    halves = runs_of(one, half)
    step = window // 2
    whole = mixed(halves[: len(halves) - step], halves[step:])
    at = first_least(mixed(halves, halves), window - half + 1)
    own = np.nonzero(np.arange(len(whole)) + window <= end[: len(whole)])[0]
    new = np.ones(len(own), dtype=bool)
    new[1:] = (at[own][1:] != at[own][:-1]) | (own[1:] != own[:-1] + 1)
    first = own[new]
    count = np.diff(np.append(np.nonzero(new)[0], len(own)))
    shape = (at[first] - first).astype(_U) << _U(32) | count.astype(_U)
    return halves[at[first]], mixed(mixed(whole[first], whole[first + count - 1]), shape), first, count


def _joined(rows: Iterator[tuple], window: int) -> Iterator[tuple]:
    """Word hashes of many texts (tag, hashes) put together: (tags, offsets of their first words in their texts, starts in the row, the row, ends). Long texts are cut into overlapping parts: each window is in one of them."""
    tags, offsets, parts, held = [], [], [], 0

    def full():
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths)
        return tags, np.array(offsets), ends - lengths, np.concatenate(parts), np.repeat(ends, lengths)

    for tag, hashes in rows:
        for a in range(0, len(hashes) - window + 1, WORDS):
            part = hashes[a : a + WORDS + window - 1]
            tags.append(tag)
            offsets.append(a)
            parts.append(part)
            held += len(part)
            if held >= WORDS:
                yield full()
                tags, offsets, parts, held = [], [], [], 0
    if parts:
        yield full()


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, h, bytes): rows with equal id and hash have the same words."""
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("h"), utf8(text_col).alias("bytes"))


def marks(texts: DataFrame, window: int) -> DataFrame:
    """(g: mark, c: stretch, doc, h, at, n) of all stretches: n windows from word ``at`` on."""

    def run(batches):
        for b in batches:
            doc, h = b.column(0).to_numpy(), b.column(1).to_numpy()
            rows = ((i, word_hashes(t.as_buffer().to_pybytes())) for i, t in enumerate(b.column(2)))
            for tags, offsets, starts, row, ends in _joined(rows, window):
                g, c, first, count = stretches(row, ends, window)
                part = np.searchsorted(starts, first, side="right") - 1
                of = np.array(tags)[part]
                columns = [g.view(np.int64), c.view(np.int64), doc[of], h[of], (first - starts[part] + offsets[part]).astype(np.int32), count.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["g", "c", "doc", "h", "at", "n"])

    return texts.where("doc is not null").mapInArrow(run, "g long, c long, doc long, h long, at int, n int")


def windows(texts: DataFrame, open_: DataFrame, window: int) -> DataFrame:
    """(g, w: window, doc, h, at) of the windows in open stretches (g, doc, h, at, n)."""
    wanted = open_.groupBy("doc", "h").agg(F.collect_set(F.struct("g", "at", "n")).alias("s"))
    wanted = wanted.select("doc", "h", "s.g", "s.at", "s.n")

    def run(batches):
        for b in batches:
            doc, h = b.column("doc").to_numpy(), b.column("h").to_numpy()
            rows = ((i, word_hashes(t.as_buffer().to_pybytes())) for i, t in enumerate(b.column("bytes")))
            sought = [tuple(x.values.to_numpy() for x in (g, at, n)) for g, at, n in zip(b.column("g"), b.column("at"), b.column("n"))]
            for tags, offsets, starts, row, _ in _joined(rows, window):
                whole = runs_of(row, window)
                for tag, offset, start, after in zip(tags, offsets, starts, [*starts[1:], len(row)]):
                    g, at, n = sought[tag]
                    here = (at >= offset) & (at <= offset + after - start - window)
                    g, at, n = g[here], at[here], n[here]
                    if not len(g):
                        continue
                    place = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    k = len(place)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(g, n)), pa.array(whole[place - offset + start].view(np.int64)), pa.array(np.full(k, doc[tag])), pa.array(np.full(k, h[tag])), pa.array(place.astype(np.int32))],
                        names=["g", "w", "doc", "h", "at"],
                    )

    return texts.join(wanted, ["doc", "h"]).mapInArrow(run, "g long, w long, doc long, h long, at int")


def repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, h, at, n): windows at ``n`` places from word ``at`` on that a smaller document has, too."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/substrings-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    texts = texts_of(docs, id_col, text_col)
    every = stored(marks(texts, window), "marks")
    shared = every.groupBy("g").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("g")
    # written first: AQE splits a join's hot keys only where both sides come straight from a shuffle
    half = stored(every.join(stored(shared, "shared"), "g"), "half")
    least = stored(half.groupBy("g", "c").agg(F.min("doc").alias("least")), "stretches")
    several = least.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g")
    known = stored(half.join(least, ["g", "c"]), "known")
    gone = known.where("doc > least").select("doc", "h", "at", "n")
    open_ = stored(known.where("doc = least").join(stored(several, "several"), "g").select("g", "doc", "h", "at", "n"), "open")
    single = stored(windows(texts, open_, window), "windows")
    earlier = single.groupBy("g", "w").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("g", "w", "a")
    alone = single.join(stored(earlier, "earlier"), ["g", "w"]).where("doc > a").select("doc", "h", "at", F.lit(1).alias("n"))
    return gone.unionByName(alone)


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept): a row for each of ``docs``, with the words that stay joined by one space."""
    found = repeats(docs, window, id_col, text_col).groupBy("doc", "h").agg(F.collect_set(F.struct("at", "n")).alias("s"))
    found = found.select("doc", "h", "s.at", "s.n")

    def run(batches):
        names = ["id", "n_words", "n_removed", "kept"]
        for b in batches:
            out, size = [], 0
            for i, t, at, n in zip(b.column("doc").to_pylist(), b.column("bytes"), b.column("at"), b.column("n")):
                text = t.as_buffer().to_pybytes()
                words, gone = 0, None
                if at.is_valid:
                    # words gone: depth of the ranges that cover them
                    start, stop = at.values.to_numpy(), at.values.to_numpy() + n.values.to_numpy() + window - 1
                    depth = np.zeros(stop.max() + 1, dtype=np.int64)
                    np.add.at(depth, start, 1)
                    np.add.at(depth, stop, -1)
                    gone = np.cumsum(depth) > 0
                kept, lost = [], 0
                for w in pieces(text):
                    if gone is not None and words < len(gone):
                        g = gone[words : words + len(w)]
                        lost += int(g.sum())
                        stay = [x for x, y in zip(w, g.tolist()) if not y] + w[len(g) :]
                    else:
                        stay = w
                    words += len(w)
                    if stay:
                        kept.append(b" ".join(stay))
                out.append((i, words, lost, b" ".join(kept)))
                size += len(out[-1][-1])
                if size >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=names)

    rows = texts_of(docs, id_col, text_col).join(found, ["doc", "h"], "left").mapInArrow(run, "id long, n_words long, n_removed long, kept binary")
    return rows.withColumn("kept", F.col("kept").cast("string"))
