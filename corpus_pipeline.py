"""Corpus pipeline: each stage's result is written as Parquet and read as the next one's documents."""

from __future__ import annotations

import uuid

from quillfin.llm import decontam, neardup, packing, secrets, toxicity
from quillfin.llm.common import shared_folder, table
from quillfin.llm.queries import toxicity_model


def drop_toxic(spark, docs, sf_dir):
    """Documents that score 0.3 or more go."""
    return docs.where(toxicity.score_column(toxicity_model(spark, sf_dir)) < 0.3)


def drop_near_duplicates(spark, docs, sf_dir):
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the row with the least
    doc_id stays (nulls last; of rows with that id, the one with the least hash; equal rows are one)."""
    return neardup.keep_one(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark, docs, sf_dir):
    """Secrets are masked in the text; null texts stay null."""
    return secrets.mask(docs)


def pack_sequences(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scan", mask_secrets),
    ("packing", pack_sequences),
]

#: A fitted score and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; the folders between them lie in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = f"{root}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
