"""The corpus pipeline, stage by stage, against brute force on a small table."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillfin.llm import toxicity
from quillfin.llm import neardup, packing, simhash
from tests.llm.test_operators import EDGE, SCHEMA, brute_secrets, packed_ok, rows


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_representatives(texts):
    """The least id of each component of documents at least 0.8 alike."""
    sets, least = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                least[b] = a
    return {find(i) for i in texts}


def test_near_copies_of_one_text(spark):
    """Variants are alike the text, but less so each other; a group of them is one component."""
    rng = random.Random(4)
    base = [f"word{k}" for k in range(300)]
    texts = {0: " ".join(base)}
    for i in range(1, 120):
        w = base[:]
        for k in rng.sample(range(300), 5):
            w[k] = f"new{i}x{k}"
        texts[i] = " ".join(w)
    texts |= {500 + i: " ".join(f"own{i}w{k}" for k in range(50)) for i in range(40)}
    docs = spark.createDataFrame(rows(texts.items()), SCHEMA)
    kept = {r.doc_id for r in neardup.keep_one(docs).collect()}
    assert kept == brute_representatives(texts) == {0, *range(500, 540)}
    edge = spark.createDataFrame(rows(EDGE), SCHEMA)
    out = neardup.keep_one(edge)
    assert out.columns == edge.columns and sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == [(False, 0), (False, 3), (False, 7), (False, 9), (True, None)]
    assert neardup.keep_one(edge.limit(0)).count() == 0


def components_of_buckets(spark, texts, buckets):
    """Sets of nodes that ``verified_links`` joins, of texts by node and buckets of nodes."""
    shared = spark.createDataFrame([(k, i, len(b)) for k, b in enumerate(buckets) for i in b], "k long, node long, n long")
    given = spark.createDataFrame(list(texts.items()), "node long, text string")
    sets, signed = neardup.shingle_sets(given), neardup.signatures(given.withColumnRenamed("node", "key")).select("key", "least").toDF("node", "least")
    groups = {}
    for r in neardup.connected_components(neardup.verified_links(shared, signed, sets, neardup.SIMILARITY)).collect():
        groups.setdefault(r.component, set()).add(r.node)
    return sorted(map(sorted, groups.values()))


def changed(base, name, at):
    return " ".join(f"{name}{k}" if k in at else w for k, w in enumerate(base))


def test_centres_are_ranked_by_first_links(spark):
    """A bucket's widest node is unlike all; the text that the first round gave links is met there afterwards."""
    base = [f"word{k}" for k in range(300)]
    texts = {1: " ".join(base), 2: changed(base, "a", {10, 60}), 3: changed(base, "b", {110, 160}), 4: changed(base, "w", {210, 260})}
    texts |= {i: " ".join(f"own{i}w{k}" for k in range(300)) for i in range(9, 30)}
    # 9 is the widest node of the bucket of 1 and 4; 1 is that of its bucket with 2 and 3
    buckets = [[1, 2, 3], [1, 4, 9], [2, 3], *([9, i] for i in range(10, 30))]
    texts[9] = " ".join(f"far{k}" for k in range(600))
    assert components_of_buckets(spark, texts, buckets) == [[1, 2, 3, 4]]


def test_copies_meet_without_a_centre(spark):
    """The only centre of all buckets is alike to nobody; an edited copy is found all the same, in every group."""
    license_ = [f"license{k}" for k in range(60)]
    texts = {i: " ".join(license_ + [f"own{i}w{k}" for k in range(80)]) for i in range(1, 60)}
    texts |= {100 + i: changed(texts[i].split(), "new", {70}) for i in (3, 4, 50)} | {203: changed(texts[3].split(), "x", {75, 90})}
    texts[900] = " ".join(license_ + [f"hub{k}" for k in range(90)])
    buckets = [list(texts), list(texts), *([900, i] for i in range(1, 60))]
    assert components_of_buckets(spark, texts, buckets) == [[3, 103, 203], [4, 104], [50, 150]]


def test_prefix_pairs_hold_all_alike(spark):
    rng = random.Random(7)
    texts = {}
    for i in range(150):
        w = texts[rng.randrange(i)].split() if i and rng.random() < 0.7 else [f"t{i}w{k}" for k in range(rng.choice([1, 4, 6, 40, 120]))]
        for k in rng.sample(range(len(w)), min(len(w), rng.choice([0, 1, 1, 2]))):
            w[k] = f"e{i}x{k}"
        texts[i] = " ".join(w[: len(w) - rng.choice([0, 0, 1, 3])] or w)
    sets = neardup.shingle_sets(spark.createDataFrame(list(texts.items()), "node long, text string"))
    alone = sets.select("node", sets["node"].alias("component"))
    found = {(r.a, r.b) for r in neardup.prefix_pairs(sets, alone, 0.8).collect()}
    s = {i: shingles(t) for i, t in texts.items()}
    alike = {(i, j) for i in s for j in s if i < j and len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.8}
    assert len(alike) > 20 and alike <= found and len(found) < 150 * 149 / 2


def test_stages_against_brute_force(spark, sf):
    model = corpus_pipeline.toxicity_model(spark, sf)
    benchmark = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name == "toxicity":
            want = {i: r for i, r in want.items() if model.score(r.text) < 0.3}
        elif name == "simhash near-dedup":
            want = {i: want[i] for i in brute_representatives({i: r.text for i, r in want.items()})}
        elif name == "benchmark decontamination":
            gone = set(want) - {r.doc_id for r in docs.collect()}
            assert {i for i, r in want.items() if any(b in r.text for b in benchmark)} <= gone
            assert len(gone) < 0.1 * len(want)
            want = {i: r for i, r in want.items() if i not in gone}
        elif name == "secret scan":
            got = {r.doc_id: r for r in docs.collect()}
            for i, r in want.items():
                spans = brute_secrets(r.text)
                assert (got[i].text == r.text) == (not spans) or "[SECRET]" in got[i].text
                assert not [s for s in brute_secrets(got[i].text) if s not in spans] and got[i].n_chars == len(got[i].text)
        else:
            packed_ok(docs.collect())
            assert {r.doc_id for r in docs.collect()} == set(want)
            break
        assert docs.columns == columns
        assert {r.doc_id for r in docs.collect()} == set(want)


def test_run_is_the_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "secret scan", "packing"]
    packed_ok(corpus_pipeline.run(spark, sf).collect())


@pytest.mark.parametrize("texts", [EDGE, []])
def test_stages_on_edge_cases(spark, sf, texts):
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, sf)
        if name == "packing":
            packed_ok(out.collect())
        else:
            assert out.columns == docs.columns
            assert {r.doc_id for r in out.collect()} <= {i for i, _ in texts}


CLASHING = ["_key", "_count", "_score", "secret_spans", "secret_spans__base", "row", "key", "KEPT", "count", "component", "node", "base", "more", "spans", "a.b", "r", "h", "i", "n"]


def test_no_column_name_clashes(spark, sf):
    """All stages but the last give back columns of any name or type as they were."""
    from pyspark.sql import functions as F

    texts = [(1, "one two three four five six"), (2, "one two three four five six"), (2, "one two three four five six"), (3, "password=abcdef123456 is a secret here"), (None, None), (4, "")]
    docs = spark.createDataFrame(rows(texts), "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, bytes string, key2 string").drop("key2")
    docs = docs.select("*", *(F.lit(f"x{k}").alias(c) for k, c in enumerate(CLASHING)), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {1, 3, 4}
            break
        assert out.schema.names == docs.schema.names
        for r in out.collect():
            assert [r[c] for c in CLASHING] == [f"x{k}" for k in range(len(CLASHING))] and r["m"] == {"a": 1}
        docs = out
    once = simhash.keep_one(docs)
    assert once.columns == docs.columns and once.count() == docs.count()


def test_masked_text(spark, sf):
    docs = spark.createDataFrame(rows([(1, "password=abcdef123456"), (2, None)]), SCHEMA)
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.mask_secrets(spark, docs, sf).collect()}
    assert out == {1: ("[SECRET]", 8), 2: (None, None)}


def test_toxic_documents_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    score = toxicity.score_column(corpus_pipeline.toxicity_model(spark, sf))
    kept = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == docs.where(score < 0.3).count()


def test_python_workers_get_small_batches(spark):
    """A task of long texts isn't handed to a worker as one batch of 10,000 rows; a lesser bound of the session's holds."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["bytes"])

    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 1000).alias("text"))
    try:
        spark.conf.unset(name)
        packing.pack(docs.limit(1))
        got = [r.bytes for r in docs.mapInArrow(sizes, "bytes long").collect()]
        assert sum(got) > 12_000_000 and max(got) < 5_000_000
        spark.conf.set(name, "1m")
        packing.pack(docs.limit(1))
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)
