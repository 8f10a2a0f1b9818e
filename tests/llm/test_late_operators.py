"""Merkle manifest, hard negatives and substring removal against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfin.llm import merkle, negatives, queries, substrings


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def same(df, want):
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(want, key=str)


# --- merkle


def brute_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha(*map(framed, r))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = brute_tree([leaf(r) for r in groups[lang]])
    crown = brute_tree([trees[lang][-1][0] for lang in langs])
    out = []
    for place, lang in enumerate(langs):
        for i, r in enumerate(groups[lang]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node, path = leaf((*r[:3], r[3] + 1, r[4]) if hit else r), []
            for levels, p in ((trees[lang], i), (crown, place)):
                for k in range(len(levels) - 1):
                    run = list(levels[k][(p >> k) & ~1 :][:2])
                    path += [x for j, x in enumerate(run) if j != (p >> k) & 1]
                    run[(p >> k) & 1] = node
                    node = sha(*run)
            out.append((r[0], trees[lang][0][i], trees[lang][-1][0], crown[-1][0], sha(*path), node, node == crown[-1][0]))
    return out


def manifest(docs):
    more = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    return merkle.manifest(docs, changed={"n_chars": more})


DOCS = "doc_id long, source string, lang string, n_chars long, text string, id string, hash string, tree int"


@pytest.mark.parametrize("band", [1, 2, 10])
def test_manifest_is_that_of_whole_trees(spark, monkeypatch, band):
    monkeypatch.setattr(merkle, "BAND", band)
    langs = [None, "", "a", "é", "zz", "b"]
    rows = [(i, None if i % 3 else "s", langs[i % 6] if i < 40 else None, None if i % 4 == 0 else i, None if i % 5 == 0 else "x" * i) for i in range(60)]
    rows += [(None, None, None, None, "q")] * 3 + [(3, None, "lone", (1 << 63) - 1, "")] + [rows[8]] * 2 + [(8, "t", rows[8][2], 1, "other")]
    got = manifest(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS))
    assert got.columns == ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    same(got, brute_manifest(rows))


def test_manifest_of_nothing_and_of_one(spark):
    assert manifest(spark.createDataFrame([], DOCS)).collect() == []
    one = [(1, "s", "en", 2, "ab")]
    got = manifest(spark.createDataFrame([(*one[0], "x", "y", 1)], DOCS)).collect()
    assert got[0].leaf == got[0].subroot == got[0].root and got[0].proof_sha256 == sha()


def test_manifest_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    same(queries.op11_merkle_manifest(spark, sf), brute_manifest([tuple(r) for r in docs.collect()]))


# --- hard negatives


def brute_negatives(rows):
    usable = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    own = [(i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in e)) for i, e, label in usable]
    out = []
    for anchor in {r for r in own if r[0] % 100 == 0}:
        scored = [(-sum(p * q for p, q in zip(anchor[2], r[2])), r[0], r[1]) for r in own if r[0] != anchor[0]]
        for positive, of, _ in sorted(x for x in scored if x[2] == anchor[1])[:5]:
            fits = sorted(x for x in scored if x[2] != anchor[1] and 80 * -positive <= 100 * -x[0] <= 100 * -positive)[:5]
            out += [(anchor[0], of, k + 1, x[1], -positive, -x[0]) for k, x in enumerate(fits)]
    return out


def mined(df):
    label = F.col("label").cast("long")
    return negatives.mine(df, F.col("id") % 100 == 0, label=F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


VECTORS = "vec_id long, embedding array<float>, label int, id string, q string, w int"


@pytest.mark.parametrize(("digit", "slab"), [(12, 8192), (3, 4)])
def test_negatives_are_the_first_of_their_windows(spark, monkeypatch, digit, slab):
    monkeypatch.setattr(negatives, "DIGIT", digit)
    monkeypatch.setattr(negatives, "SLAB", slab)
    rng = random.Random(1)
    odd = {1: None, 2: [float("nan")] * 3, 3: [0.1, None, 0.2], 4: [0.9], 5: [float("inf"), 0.0, 0.0], 6: [-3.0, 1e4, -0.001], 7: []}
    rows = []
    for i in range(700):
        e = [round(rng.random(), 1) for _ in range(3)] if i % 3 else [0.5, 0.5, 0.5]  # many ties
        rows.append((i, odd.get(i % 50, e), None if i % 41 == 0 and i % 100 else i % 3, "x", "y", 1))
    rows += [rows[100]] * 3 + [rows[300]] * 40 + [(None, [1.0, 1.0, 1.0], 1, "", "", 1)] + [(5000, [0.5, 0.5, 0.5], 1, "", "", 1)] * 200
    same(mined(spark.createDataFrame(rows, VECTORS)), brute_negatives([r[:3] for r in rows]))


def test_negatives_of_nothing_and_out_of_range(spark):
    assert mined(spark.createDataFrame([], VECTORS)).collect() == []
    no_anchor = [(1, [1.0], 1, "", "", 1), (None, [1.0], 1, "", "", 1)]
    assert mined(spark.createDataFrame(no_anchor, VECTORS)).collect() == []
    huge = [(100, [1.0], 1, "", "", 1), (102, [1.0], 1, "", "", 1), (103, [1e30], 2, "", "", 1), (104, [0.9], 2, "", "", 1)]
    assert [tuple(r) for r in mined(spark.createDataFrame(huge, VECTORS)).collect()] == [(100, 102, 1, 104, 256 * 256, 230 * 256)]


def test_negatives_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    same(queries.op12_hard_negatives(spark, sf), brute_negatives(rows))


# --- substrings


def brute_repeats(rows, window):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in texts:
        for s in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[s : s + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1 if i is not None else 0):
            if least[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.mark.parametrize(("seed", "window"), [(0, 50), (1, 3), (2, 2), (3, 8), (4, 1)])
def test_repeated_windows_go(spark, seed, window):
    rng = random.Random(seed)
    rows = []
    for i in range(100):
        words = [rng.choice("ab") if window > 1 else str(rng.randint(0, 300)) for _ in range(rng.randint(0, 300 if window == 50 else 40))]
        if rows and rng.random() < 0.6 and (other := rng.choice(rows)[1]):
            part = other.split()
            a = rng.randint(0, len(part))
            words = words[:20] + part[a : a + rng.randint(0, 200)] + words[20:]
        rows.append((rng.choice([i, i, i, rng.randint(0, 50), None]), None if rng.random() < 0.03 else rng.choice([" ", "\n", "\t \x0b"]).join(words)))
    rows += [rows[3]] * 5 + [(200, "\x1c é\xa0b \x00"), (201, "")]
    got = substrings.without_repeats(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, h string, g int, at int"), window)
    same(got, brute_repeats(rows, window))


def test_long_texts_in_parts_have_the_same_windows(monkeypatch):
    rng = random.Random(9)
    text = " ".join(rng.choices(["alpha", "be", "c"], k=5000)).encode()
    whole = substrings.word_hashes(text)
    monkeypatch.setattr(substrings, "PIECE", 64)
    assert (substrings.word_hashes(text) == whole).all() and b" ".join(w for p in substrings.pieces(text) for w in p) == text

    def marked(rows):
        out = {}
        for tags, offsets, starts, row, ends in substrings._joined(iter(rows), 50):
            g, _, first, n = substrings.stretches(row, ends, 50)
            for mark, a, k in zip(g, first, n):
                part = np.searchsorted(starts, a, side="right") - 1
                out |= {(tags[part], a - starts[part] + offsets[part] + x): mark for x in range(k)}
        return out

    rows = [(0, whole), (1, whole[:49]), (2, whole[100:700])]
    want = marked(rows)
    monkeypatch.setattr(substrings, "WORDS", 60)
    assert marked(rows) == want and len(want) == 4951 + 551


def test_substrings_of_nothing(spark):
    assert substrings.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_substring_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    same(queries.op13_substring_dedup(spark, sf), [(i, n, k, sha(t)) for i, n, k, t in brute_repeats(rows, 50)])
