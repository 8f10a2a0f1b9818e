"""The operators' queries over the synthetic tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontam, merkle, mpegts, negatives, packing, pii, secrets, simhash, substrings, tokens, toxicity, urls, warc
from .common import table


def op1_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = secrets.scan(docs)
    base = F.filter("secret_spans", lambda x: x["name"] != "entropy")
    count = lambda n: F.size(F.filter("secret_spans", lambda x: x["name"] == n)).cast("long").alias(f"n_{n}")
    return s.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("secret_spans")).alias("spans")
    )


def op3_pii_skip_chain_crf(spark, sf_dir):
    found = pii.find(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in pii.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op4_mpeg_transport_stream(spark, sf_dir):
    found = mpegts.inspect(mpegts.store(table(spark, sf_dir, "documents")))
    return found.drop("pts", "random_access").withColumnRenamed("id", "doc_id")


def op5_benchmark_decontamination(spark, sf_dir):
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def toxicity_model(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    return toxicity.fit(table(spark, sf_dir, "documents"), labels)


def op6_toxicity_segments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), toxicity.held_out().alias("held_out"), toxicity.score_column(toxicity_model(spark, sf_dir)).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_token_counts(spark, sf_dir):
    found = tokens.count_tokens(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


def op8_warc_derivatives(spark, sf_dir):
    found = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return found.select(F.col("id").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "n_links", "block", F.sha2("record", 256).alias("record_sha256"))


def op9_url_filters(spark, sf_dir):
    return urls.classify(table(spark, sf_dir, "pages").select("page_id", "url")).withColumnRenamed("id", "page_id")


def op10_bounded_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1  # beyond the largest long, too
    found = merkle.manifest(table(spark, sf_dir, "documents"), changed={"n_chars": F.when(tampered, more).otherwise(F.col("n_chars"))})
    return found.withColumnRenamed("id", "doc_id")


def op12_hard_negatives(spark, sf_dir):
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


def op13_substring_dedup(spark, sf_dir):
    found = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def queries():
    return {
        f.__name__: f
        for f in (
            op1_simhash_near_dedup,
            op2_secret_scan,
            op3_pii_skip_chain_crf,
            op4_mpeg_transport_stream,
            op5_benchmark_decontamination,
            op6_toxicity_segments,
            op7_token_counts,
            op8_warc_derivatives,
            op9_url_filters,
            op10_bounded_packing,
            op11_merkle_manifest,
            op12_hard_negatives,
            op13_substring_dedup,
        )
    }


def _frame(c):
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(n_chars):
    return f"sha256({' || '.join(_frame(c) for c in ('doc_id', 'source', 'lang'))} || {_frame(n_chars)} || {_frame('text')})"


#: CRC-32 of the decimal id, a bit at a time: each byte is followed by seven zeros.
TAMPERED = """SELECT doc_id FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) WHERE xor(list_reduce(list_concat([4294967295::BIGINT],
  flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) % 7 = 0"""
#: Levels one by one; a path's digests are put together from the leaf up.
MERKLE = f"""WITH RECURSIVE d AS (SELECT doc_id, lang, n_chars, {_leaf('n_chars')} AS leaf, {_leaf('n_chars + 1')} AS changed FROM documents),
grown AS (
  SELECT CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree, 0 AS level, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS hash, count(*) OVER (PARTITION BY lang) AS n FROM d
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (n + 1) // 2 FROM grown WHERE n > 1 GROUP BY tree, level, pos // 2, n),
sub AS (SELECT tree, hash, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM grown WHERE n = 1),
crown AS (SELECT 0 AS level, pos, hash, n FROM sub UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (n + 1) // 2 FROM crown WHERE n > 1 GROUP BY level, pos // 2, n),
own AS (SELECT *, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
start AS (SELECT doc_id, tree, leaf, pos, CASE WHEN n_chars IS NOT NULL AND bad.doc_id IS NOT NULL THEN changed ELSE leaf END AS folded FROM own LEFT JOIN ({TAMPERED}) bad USING (doc_id)),
up AS (
  SELECT doc_id, tree, leaf, pos AS place, 0 AS level, pos, folded, '' AS path FROM start
  UNION ALL
  SELECT u.doc_id, u.tree, u.leaf, u.place, u.level + 1, u.pos // 2, sha256(CASE WHEN u.pos % 2 = 1 THEN s.hash || u.folded ELSE u.folded || coalesce(s.hash, '') END), u.path || coalesce(s.hash, '')
  FROM up u JOIN grown o ON o.tree = u.tree AND o.level = u.level AND o.pos = u.pos AND o.n > 1 LEFT JOIN grown s ON s.tree = u.tree AND s.level = u.level AND s.pos = xor(u.pos, 1)),
tip AS (SELECT u.doc_id, u.tree, u.leaf, u.place, u.folded, u.path, s.hash AS subroot, s.pos FROM up u JOIN grown g ON g.tree = u.tree AND g.level = u.level AND g.n = 1 JOIN sub s ON s.tree = u.tree),
over_ AS (
  SELECT doc_id, tree, leaf, place, subroot, 0 AS level, pos, folded, path FROM tip
  UNION ALL
  SELECT u.doc_id, u.tree, u.leaf, u.place, u.subroot, u.level + 1, u.pos // 2, sha256(CASE WHEN u.pos % 2 = 1 THEN s.hash || u.folded ELSE u.folded || coalesce(s.hash, '') END), u.path || coalesce(s.hash, '')
  FROM over_ u JOIN crown o ON o.level = u.level AND o.pos = u.pos AND o.n > 1 LEFT JOIN crown s ON s.level = u.level AND s.pos = xor(u.pos, 1))
SELECT doc_id, leaf, subroot, r.hash AS root, sha256(path) AS proof_sha256, folded AS folded_root, folded = r.hash AS verified
FROM over_ u, (SELECT hash, level FROM crown WHERE n = 1) r WHERE u.level = r.level"""

NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS alike, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score FROM v a JOIN v r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE alike) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

SUBSTRINGS = """WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, a, md5(array_to_string(list_slice(w, a, a + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS a FROM t)),
gone AS (SELECT DISTINCT doc_id, a + k AS j FROM win JOIN (SELECT h, min(doc_id) AS least FROM win GROUP BY h) USING (h), range(50) r(k) WHERE least < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM t),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS text FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""


def oracle_sql():
    return {"op11_merkle_manifest": MERKLE, "op12_hard_negatives": NEGATIVES, "op13_substring_dedup": SUBSTRINGS}
