"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document longer than a
window is cut into full windows and a rest; a rest goes to the open window
which it fills best; when none fits and all are open, the fullest is emitted.
What is open at a partition's end is merged: the leftovers of every
``MERGE`` partitions are packed again by the same rule, longest pieces first, and
so on up, so that no task ever sees more than ``MERGE`` times the open windows.

Null texts count as empty: one token, the end mark. Repeated rows are packed as
often as they come; null ids stay null; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small_batches, utf8
from .tokens import encoder, vocabulary_path

WINDOW = 4096
OPEN = 64
MERGE = 32
END_ID = 2
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, filled long"


class Packer:
    """Best-fit packing with at most ``limit`` open windows."""

    def __init__(self, window: int, limit: int):
        self.window, self.limit = window, limit
        self.free: list[tuple[int, int]] = []  # (free tokens, number), ascending
        self.content: dict[int, list] = {}
        self.next = 0

    def add(self, piece, length: int):
        """Windows that closed by this: (number, pieces)."""
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            left, number = self.free.pop(at)
            self.content[number].append(piece)
            left -= length
            if left:
                insort(self.free, (left, number))
                return
            yield number, self.content.pop(number)
            return
        number, self.next = self.next, self.next + 1
        if length == self.window:
            yield number, [piece]
            return
        if len(self.free) == self.limit:
            _, fullest = self.free.pop(0)
            yield fullest, self.content.pop(fullest)
        self.content[number] = [piece]
        insort(self.free, (self.window - length, number))

    def rest(self):
        yield from sorted(self.content.items())


def _rows(number: int, pieces: list, prefix: int, open_part: int | None) -> list[tuple]:
    out, offset, filled = [], 0, sum(p[2] for p in pieces)
    for p in pieces:
        out.append((*p, prefix | number, offset, -1 if open_part is None else open_part, filled))
        offset += p[2]
    return out


def pack(
    docs: DataFrame, path: str | None = None, window: int = WINDOW, open_windows: int = OPEN, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or vocabulary_path()
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("bytes"))
    fields = SCHEMA.replace(" long", "").split(", ")

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=fields)

    def run(batches):
        enc, part = encoder(path), TaskContext.get().partitionId()
        end, prefix = np.array([end_id], dtype="<u4").tobytes(), part << 28
        packer, out = Packer(window, open_windows), []
        for b in batches:
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = enc.encode(t.as_buffer().to_pybytes()) + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    own = ids[4 * start : 4 * (start + window)]
                    for number, pieces in packer.add((doc_id, start, len(own) // 4, zlib.crc32(own), total), len(own) // 4):
                        out += _rows(number, pieces, prefix, None)
                if len(out) >= 10_000:
                    yield batch(out)
                    out = []
        for number, pieces in packer.rest():
            out += _rows(number, pieces, prefix, part)
        if out:
            yield batch(out)

    def merge(level: int):
        def again(key, pdf: pd.DataFrame) -> pd.DataFrame:
            packer, out = Packer(window, open_windows), []
            prefix = level << 56 | int(key[0]) << 28
            pdf = pdf.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True])
            pieces = zip(*(pdf[c].astype(object).where(pdf[c].notna(), None) for c in PIECE))
            for p in pieces:
                p = tuple(None if x is None else int(x) for x in p)
                for number, done in packer.add(p, p[2]):
                    out += _rows(number, done, prefix, None)
            for number, left in packer.rest():
                out += _rows(number, left, prefix, int(key[0]))
            return pd.DataFrame(out, columns=fields).astype({c: "Int64" for c in fields})

        return again

    packed = checkpoint(rows.mapInArrow(run, SCHEMA))
    done, left = [packed.where("part < 0")], packed.where("part >= 0")
    groups, level = int(left.agg(F.max("part")).first()[0] or 0) + 1, 0
    while groups > 1:
        level, groups = level + 1, -(-groups // MERGE)
        merged = checkpoint(left.withColumn("part", F.expr(f"part div {MERGE}")).groupBy("part").applyInPandas(merge(level), SCHEMA))
        done.append(merged.where("part < 0"))
        left = merged.where("part >= 0")
    result = left
    for d in done:
        result = result.unionAll(d)
    return result.select(*PIECE, "sequence_id", "offset")
