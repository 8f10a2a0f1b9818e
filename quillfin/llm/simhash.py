"""SimHash near-duplicates, found with Golay-code fuzzy keys.

A fingerprint of 64 bits is cut into four 16-bit segments. If two fingerprints
differ in at most three bits, the segments' errors sum to at most three, so by
the pigeonhole principle some segment ``e`` is equal and the segment after it
(cyclically) differs in at most one bit:

* some segment has no error; call those segments Z;
* only one segment can hold two or more errors, and then Z has at least two
  members, of which at most one is followed by that segment.

A segment, padded to 23 bits, decodes to the index of its Golay codeword (the
code is perfect: each word lies within three errors of just one codeword). Two
words one error apart share a key if one side gives the index of its own
codeword and the other those of all words within one error: up to six keys, as
most of the neighbours decode alike. Index rows give 4 keys, probe rows at most
24, of 28 bits and the number of ``e``. The join's condition verifies the whole
distance, so no link is lost and none is false.

Equal fingerprints are one node, so copies are never expanded into pairs.

Inputs: null texts count as empty, empty ones have fingerprint zero and are
linked like any others; null ids keep their row and are ignored as component
ids unless a component has no other; repeated rows come out as often as they
came in; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import starmap

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, keep_rows, row_hash, utf8

SEED = 42
SEGMENTS = 4
#: Generator polynomial of the binary Golay code (23, 12, 7).
GOLAY = 0b110001110101


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash over XXH64 of space-joined word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        pieces = [joined]
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        pieces = map(joined.__getitem__, starmap(slice, zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, SEED) for p in pieces], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@lru_cache(1)
def _decoder() -> np.ndarray:
    """Codeword index of each 23-bit word's syndrome shift: error pattern by syndrome."""

    def remainder(w: int) -> int:
        for i in range(22, 10, -1):
            if w >> i & 1:
                w ^= GOLAY << (i - 11)
        return w

    bit = [remainder(1 << i) for i in range(23)]
    error = np.zeros(2048, dtype=np.uint32)
    for i in range(23):
        error[bit[i]] = 1 << i
        for j in range(i):
            error[bit[i] ^ bit[j]] = 1 << i | 1 << j
            for k in range(j):
                error[bit[i] ^ bit[j] ^ bit[k]] = 1 << i | 1 << j | 1 << k
    return error


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the one Golay codeword within three errors of each 23-bit word."""
    w = words.astype(np.uint32)
    rest = w.copy()
    for i in range(22, 10, -1):
        rest ^= np.where(rest >> i & 1, np.uint32(GOLAY << (i - 11)), np.uint32(0))
    return (w ^ _decoder()[rest]) >> 11


@lru_cache(1)
def _segment_keys() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 16-bit word: its own index; all indices within one error, and where they start."""
    words = np.arange(1 << 16, dtype=np.uint32)
    near = np.stack([decode(words)] + [decode(words ^ (1 << i)) for i in range(16)], axis=1)
    own = near[:, 0].copy()
    near.sort(axis=1)
    fresh = np.concatenate([np.ones((len(near), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
    return own, near[fresh], np.concatenate([[0], np.cumsum(fresh.sum(axis=1))])


def golay_keys(fps: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(key, position of the fingerprint) for unsigned 64-bit fingerprints."""
    own, near, starts = _segment_keys()
    segments = [(fps >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(SEGMENTS)]
    keys, rows = [], []
    for e in range(SEGMENTS):
        high = (e << 28) | (segments[e] << 12)
        partner = segments[(e + 1) % SEGMENTS]
        if probe:
            n = starts[partner + 1] - starts[partner]
            row = np.repeat(np.arange(len(fps)), n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            keys.append(high[row] | near[starts[partner][row] + nth])
            rows.append(row)
        else:
            keys.append(high | own[partner])
            rows.append(np.arange(len(fps)))
    return np.concatenate(keys).astype(np.int64), np.concatenate(rows)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp: the 64 bits as a signed long), a row for each row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("bytes"))

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_buffer().to_pybytes(), shingle) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(run, "id long, fp long")


def _keyed(fps: DataFrame, probe: bool, name: str) -> DataFrame:
    """(key, name, component) of (fp, component)."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                v, c = (b.column(i).slice(k, 4096).to_numpy(zero_copy_only=False) for i in (0, 1))
                keys, rows = golay_keys(v.view(np.uint64), probe)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(v[rows]), pa.array(c[rows])], names=["key", "fp", "component"])

    rows = fps.select("fp", "component").mapInArrow(run, "key long, fp long, component long")
    return rows.withColumnsRenamed({"fp": name, "component": f"{name}_component"})


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of distinct values of ``fp`` at most ``max_bits`` (3 or fewer) apart."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the keys cover up to three differing bits")
    own = fps.select("fp", F.col("fp").alias("component"))
    probe, index = _keyed(own, True, "a"), _keyed(own, False, "b")
    near = probe.join(index, (probe["key"] == index["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    return near.select("a", "b").distinct()


def components(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(fp, component) of distinct values of ``fp`` joined by links of at most ``max_bits``; component is the least signed value.

    Many links say the same where fingerprints crowd, so they aren't all made: first every key's rows
    meet the key's least one only (an aggregate, combined before the shuffle), which joins most of a crowd; then all
    pairs under a key meet, but only those in different components become rows. Each link is
    either made or lies inside a component, so none is lost. A hot key's sort-merge partition is split by AQE.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the keys cover up to three differing bits")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    own = fps.select("fp", F.col("fp").alias("component"))
    centre = _keyed(own, False, "b").groupBy("key").agg(F.min("b").alias("b"))
    first = checkpoint(_keyed(own, True, "a").join(centre, "key").where((F.col("a") != F.col("b")) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    placed = own.select("fp").join(connected_components(first).withColumnRenamed("node", "fp"), "fp", "left")
    placed = checkpoint(placed.select("fp", F.coalesce("component", "fp").alias("component")))
    probe, index = _keyed(placed, True, "a"), _keyed(placed, False, "b")
    met = probe.join(index, (probe["key"] == index["key"]) & (F.col("a_component") != F.col("b_component")) & near)
    second = checkpoint(met.select(F.least("a_component", "b_component").alias("a"), F.greatest("a_component", "b_component").alias("b")).distinct())
    last = connected_components(second).select(F.col("node").alias("component"), F.col("component").alias("last"))
    return placed.join(last, "component", "left").select("fp", F.coalesce("last", "component").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): a row for each row of ``docs``."""
    rows = checkpoint(fingerprints(docs, shingle, id_col, text_col))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min("id").alias("least")))
    joined = nodes.join(components(nodes, max_bits), "fp")
    named = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = joined.join(named, "component").select("fp", "component_id")
    return rows.join(classes, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: the least id (nulls last), then the least hash of all
    columns; of equal rows one. Columns are those of ``docs``, whatever their names."""
    key = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).cast("long").alias("i"), row_hash(docs).alias("h"))
    keyed = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    rows = checkpoint(_keyed_fingerprints(keyed, shingle))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min("key").alias("least")))
    best = nodes.join(components(nodes, max_bits), "fp").groupBy("component").agg(F.min("least").alias("key"))
    return keep_rows(docs, key, best, rows.groupBy("key").count())


def _keyed_fingerprints(keyed: DataFrame, shingle: int) -> DataFrame:
    kind = keyed.schema["key"].dataType.simpleString()
    rows = keyed.select("key", utf8("text").alias("bytes"))

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_buffer().to_pybytes(), shingle) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    return rows.mapInArrow(run, f"key {kind}, fp long")
