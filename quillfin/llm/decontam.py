"""Benchmark decontamination with BM25 and block-max WAND.

Spark counts the test items' words; so the number of items, mean length and document frequencies
are those of the whole test set. An item's BM25 impacts are shares of the score
that it gets from its own text. Every training passage is a query: windows of twice as many
words as an item may have at strides of that length, so that a copy of an item lies whole in some
window. Items are searched by length (up to 64 words, up to 512, and so on), so one long item doesn't widen the windows of all. Postings are sorted by item and cut into blocks of items with the largest impact
of each word and block. The sums of these bounds say which blocks may hold an item that reaches its limit;
in those WAND walks the postings from the block's offset on and scores every item that can.

The limit follows from the verification: a text that has ``overlap`` of an item's
five-word shingles has at least a certain share of the item's score, whichever shingles are missing
(``least_share``), so the search loses no item that verification would accept. Items found are verified: the window
must have that share of the whole item's shingles, and that of the question's or of the answer's.

The index is cut into parts of bounded size, each broadcast for one job of its own over all
documents and dropped afterwards, so that a larger test set needs more passes and no more memory. A
part changes what is searched at a time, not the statistics, so results don't depend on it.

An item's first sentence is its question, the rest its answer; items of fewer than
five words are one shingle. Items without words, null texts and empty ones match nothing; equal items each
match. Rows with null ids keep their nulls, repeated rows are each judged, other columns are left alone. Very long
texts are searched whole, some windows at a time. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small_batches

SHINGLE = 5
OVERLAP = 0.8
K1, B = 1.2, 0.75
BLOCK = 4
#: Bounds of one part of the index: items, and their words in all unless one item has more.
MAX_ITEMS, MAX_WORDS = 4096, 400_000
#: Tokens remembered by a worker, and the longest ones that are.
MEMO, MEMO_LENGTH = 200_000, 48
#: Windows of a text that are searched at a time.
WINDOWS = 64
#: Most words of the items in the first length class; the next ones have eight times as many each.
SPAN = 64
#: Not part of a word at its ends.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’¿¡…–—·"


def words(text: str) -> list[str]:
    """Lower-case words without punctuation at either end."""
    return [w for t in text.lower().split() if (w := t.strip(PUNCTUATION))]


def question_answer(text: str) -> tuple[str, str]:
    parts = re.split(r"(?<=[.?!])\s+|\n+", text.strip(), maxsplit=1)
    return parts[0], parts[1] if len(parts) > 1 else ""


def shingles(numbers: list[int]) -> set[tuple[int, ...]]:
    return {tuple(numbers[i : i + SHINGLE]) for i in range(max(1, len(numbers) - SHINGLE + 1))} if numbers else set()


def least_share(numbers: np.ndarray, shares: dict[int, float], overlap: float) -> float:
    """The least share of an item's score left in a text that has ``overlap`` of its distinct shingles.

    A word is gone only if all shingles with it are. At most r of the m shingles are missing and each
    has five words at most, so the words gone have 5 r places in shingles between them, and none more than r:
    the worst choice is bounded by taking the most score per place, the last word in part.
    """
    own = shingles(numbers.tolist())
    missing = len(own) - math.ceil(overlap * len(own) - 1e-9)
    places: dict[int, int] = {}
    for s in own:
        for w in set(s):
            places[w] = places.get(w, 0) + 1
    room, lost = SHINGLE * missing, 0.0
    for w, k in sorted(((w, k) for w, k in places.items() if k <= missing), key=lambda x: -shares[x[0]] / x[1]):
        lost += shares[w] * min(1.0, room / k)
        room -= k
        if room <= 0:
            break
    return max(1.0 - lost, 1e-6)


class Postings:
    """Postings of the items of one length class: sorted by word and item, with an entry (start, largest impact) for each word and block of items."""

    def __init__(self, posts: list[tuple[int, int, float]], n_words: int, n_items: int, span: int):
        """``posts``: (word, item, impact as a multiple of the item's limit); ``span``: the most words of an item."""
        posts.sort()
        self.span = span
        word = np.array([p[0] for p in posts], dtype=np.int64)
        self.item = np.array([p[1] for p in posts], dtype=np.int32)
        self.impact = np.array([p[2] for p in posts], dtype=np.float64)
        self.n_blocks = max(1, -(-n_items // BLOCK))
        key = word * self.n_blocks + self.item // BLOCK
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.entry_block = (key[begins] % self.n_blocks).astype(np.int32)
        self.entry_begin = np.r_[begins, len(key)]
        self.entry_bound = np.maximum.reduceat(self.impact, begins)
        self.first_entry = np.searchsorted(key[begins] // self.n_blocks, np.arange(n_words + 1))
        self.largest = np.zeros(n_words)
        np.maximum.at(self.largest, word, self.impact)

    def cells(self, window: np.ndarray, terms: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window * n_blocks + block where the bounds of a window's distinct words let some item of the block reach its limit, where each begins in the entries, the entries in that order), of ``n`` windows at once."""
        count = self.first_entry[terms + 1] - self.first_entry[terms]
        entries = np.repeat(self.first_entry[terms] - np.cumsum(count) + count, count) + np.arange(count.sum())
        at = np.repeat(window * self.n_blocks, count) + self.entry_block[entries]
        can = np.bincount(at, self.entry_bound[entries], minlength=n * self.n_blocks) >= 1 - 1e-6
        cells = np.flatnonzero(can)
        if not len(cells):
            return cells, cells, cells
        kept = can[at]
        entries, at = entries[kept], at[kept]
        order = np.argsort(at, kind="stable")
        return cells, np.searchsorted(at[order], np.append(cells, n * self.n_blocks)), entries[order]

    def wand(self, entries: list[int]) -> list[tuple[int, float]]:
        """(item, score) of all items of one block that reach their limit, from the block's entries of the query's words."""
        # current item, items and impacts, position, bound
        cursors = []
        for e in entries:
            items = self.item[self.entry_begin[e] : self.entry_begin[e + 1]].tolist()
            cursors.append([items[0], items, self.impact[self.entry_begin[e] : self.entry_begin[e + 1]].tolist(), 0, float(self.entry_bound[e])])
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, None
            for c in cursors:
                total += c[4]
                if total >= 1 - 1e-9:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            target = pivot
            if cursors[0][0] == pivot:
                score = sum(c[2][c[3]] for c in cursors if c[0] == pivot)
                if score >= 1 - 1e-9:
                    out.append((pivot, score))
                target = pivot + 1
            for c in cursors:
                while c[0] < target:
                    c[3] += 1
                    c[0] = c[1][c[3]] if c[3] < len(c[1]) else 1 << 40
            cursors = [c for c in cursors if c[0] < 1 << 40]
        return out

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """(item, score as a multiple of its limit) of all items that a set of distinct words brings to their limit."""
        return [x for _, found in self.wanted(np.zeros(len(terms), dtype=np.int64), terms, 1) for x in found]

    def wanted(self, window: np.ndarray, terms: np.ndarray, n: int) -> Iterator[tuple[int, list[tuple[int, float]]]]:
        """(window, its items as of ``search``), a block at a time."""
        cells, cuts, entries = self.cells(window, terms, n)
        for k, cell in enumerate(cells.tolist()):
            yield cell // self.n_blocks, self.wand(entries[cuts[k] : cuts[k + 1]].tolist())

    def windows(self, numbers: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, list[tuple[int, float]]]]:
        """(first word, items found) of the windows whose words' largest impacts sum up to a limit, some windows at a time."""
        terms = numbers[hits]
        begins = np.arange(0, max(len(numbers) - self.span, 1), self.span)
        first, last = np.searchsorted(hits, begins), np.searchsorted(hits, begins + 2 * self.span)
        sums = np.zeros(len(terms) + 1)
        np.cumsum(self.largest[terms], out=sums[1:])
        may = np.flatnonzero(sums[last] - sums[first] >= 1 - 1e-6)
        n_words = len(self.largest)
        for k in range(0, len(may), WINDOWS):
            own = may[k : k + WINDOWS]
            size = last[own] - first[own]
            places = np.repeat(first[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
            # a window's distinct words
            window, distinct = np.divmod(np.unique(np.repeat(np.arange(len(own)) * n_words, size) + terms[places]), n_words)
            enough = np.bincount(window, self.largest[distinct], minlength=len(own)) >= 1 - 1e-6
            kept = enough[window]
            for w, found in self.wanted(window[kept], distinct[kept], len(own)):
                yield int(begins[own[w]]), found


class Index:
    """Items and their postings by length class; see the module.

    ``stats``: items in all, mean length, document frequency of each word, of the whole test set.
    """

    def __init__(self, items: list[tuple[int | None, str]], stats: tuple[int, float, dict[str, int]], overlap: float = OVERLAP):
        n, mean, df = stats
        self.overlap = overlap
        self.ids: list[int | None] = []
        self.number: dict[str, int] = {}
        self.sequences: list[np.ndarray] = []  # word numbers
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []  # question, answer
        posts: dict[int, list[tuple[int, int, float]]] = {}
        for item_id, text in items:
            ws = words(text)
            if not ws:
                continue
            as_numbers = lambda x: np.array([self.number.setdefault(w, len(self.number)) for w in x], dtype=np.int32)
            own = as_numbers(ws)
            at = len(self.ids)
            self.ids.append(item_id)
            self.sequences.append(own)
            self.parts.append(tuple(as_numbers(words(x)) for x in question_answer(text)))
            raw = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(ws) / mean)) for w, f in Counter(ws).items()}
            whole = sum(raw.values())
            shares = {self.number[w]: x / whole for w, x in raw.items()}
            limit = least_share(own, shares, overlap)
            span = SPAN
            while span < len(ws):
                span *= 8
            posts.setdefault(span, []).extend((w, at, x / limit) for w, x in shares.items())
        self.classes = [Postings(p, len(self.number), len(self.ids), span) for span, p in sorted(posts.items())]
        self.memo: dict[str, int] = {}

    def numbers(self, tokens: list[str]) -> list[int]:
        """A word's number; -1: in no item; -2: no word."""
        got = list(map(self.memo.get, tokens))
        if None in got:
            fresh = {t for t, g in zip(tokens, got) if g is None}
            new = {t: self.number.get(w, -1) if (w := t.strip(PUNCTUATION)) else -2 for t in fresh}
            if len(self.memo) + len(new) > MEMO:
                self.memo.clear()
            self.memo.update((t, k) for t, k in new.items() if len(t) <= MEMO_LENGTH)
            got = [new[t] if g is None else g for t, g in zip(tokens, got)]
        return got

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        return [x for c in self.classes for x in c.search(terms)]

    def matches(self, text: str) -> list[tuple[int | None, float, float, float, float]]:
        """(item id, score, overlap, question's, answer's) of each verified item; score is that of the best window, as a multiple of the item's limit."""
        if not self.ids or not text:
            return []
        numbers = np.array(self.numbers(text.lower().split()), dtype=np.int32)
        numbers = numbers[numbers > -2]
        hits = np.flatnonzero(numbers >= 0)
        best: dict[int, tuple[float, ...]] = {}
        if not len(hits):
            return []
        for c in self.classes:
            for begin, found in c.windows(numbers, hits):
                have: dict[int, set] = {}
                for item, score in found:
                    window = numbers[begin : begin + 2 * c.span].tolist()
                    shares = []
                    for part in self.sets(item):
                        size = len(next(iter(part))) if part else 0
                        if size and size not in have:
                            have[size] = {tuple(window[i : i + size]) for i in range(len(window) - size + 1)}
                        shares.append(len(part & have[size]) / len(part) if part else None)
                    w, q, a = shares
                    q, a = w if q is None else q, w if a is None else a
                    if w >= self.overlap and max(q, a) >= self.overlap:
                        best[item] = max(best.get(item, (0.0,) * 4), (w, score, q, a))
        return [(self.ids[k], s, w, q, a) for k, (w, s, q, a) in sorted(best.items())]

    def sets(self, item: int) -> tuple[frozenset, frozenset, frozenset]:
        """Shingles of an item, its question and its answer."""
        q, a = self.parts[item]
        return _sets(self.sequences[item].tobytes()), _sets(q.tobytes()), _sets(a.tobytes())


@lru_cache(512)
def _sets(numbers: bytes) -> frozenset:
    return frozenset(shingles(np.frombuffer(numbers, dtype=np.int32).tolist()))


def parts_of_index(benchmark: DataFrame, max_items: int = MAX_ITEMS, max_words: int = MAX_WORDS, overlap: float = OVERLAP, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """The index in parts, one after another; their statistics are those of all items."""
    small_batches(benchmark.sparkSession)
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")

    def cut(batches):
        part, items, size = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if ws := words(t):
                    if items and (items >= max_items or size + len(ws) > max_words):
                        part, items, size = part + 1, 0, 0
                    items, size = items + 1, size + len(ws)
                    out.append((i, t, part, ws))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string())))], names=["id", "text", "part", "words"])

    count, characters = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    few = max(1, -(-count // max_items), -(-characters // (6 * max_words)))
    found = rows.coalesce(few).mapInArrow(cut, "id long, text string, part long, words array<string>")
    items = checkpoint(found)
    n, total = items.agg(F.count("*"), F.sum(F.size("words"))).first()
    if not n:
        return
    df = checkpoint(items.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df")))
    for p in sorted(r.part for r in items.select("part").distinct().collect()):
        own = items.where(F.col("part") == p)
        known = own.select(F.explode("words").alias("word")).distinct().join(df, "word").collect()  # bounded by max_words
        yield Index(sorted(((r.id, r.text) for r in own.select("id", "text").toLocalIterator()), key=lambda x: (x[0] is None, x[0] or 0, x[1])), (n, total / n, {r.word: r.df for r in known}), overlap)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, max_items: int = MAX_ITEMS, max_words: int = MAX_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, item_id, score, overlap, question_overlap, answer_overlap) for each document and test item found in it."""
    schema = "id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    result, one = None, None
    for index in parts_of_index(benchmark, max_items, max_words, overlap):
        if one is not None:  # several parts: a job for each
            result = _done(one, result)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for pdf in batches:
                out = [(i, *m) for i, t in zip(pdf.id, pdf.text) for m in shared.value.matches(t)]
                yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")]).astype({"id": "Int64", "item_id": "Int64"})

        one = (rows.mapInPandas(run, schema), shared)
    if one is None:
        return docs.sparkSession.createDataFrame([], schema)
    return one[0] if result is None else _done(one, result)


def _done(one, result: DataFrame | None) -> DataFrame:
    """The rows of a part are written and its index is dropped."""
    found, shared = one
    found = checkpoint(found)
    shared.destroy()
    return found if result is None else result.unionAll(found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, max_items: int = MAX_ITEMS, max_words: int = MAX_WORDS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no test item is found."""
    before = None
    for index in parts_of_index(benchmark, max_items, max_words, overlap):
        if before is not None:
            docs = checkpoint(docs)
            before.destroy()
        before = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.where(_clean(before)(F.col(text_col)))
    return docs


def _clean(shared):
    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = shared.value
        try:
            for texts in batches:
                # a batch's texts become strings one at a time, as a worker keeps the memory that it once took
                yield pa.array((not t or not index.matches(t) for t in (x.as_py() for x in texts)), pa.bool_())
        finally:
            index.memo.clear()  # a worker that idles still holds the index

    return clean
