"""JSON that may be damaged: what can be read is used, the rest is kept as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """The JSON value as a variant, null where the text is none."""
    return F.try_parse_json(text)


def object_of(text: Column) -> Column:
    """The text where it is a JSON object, else null."""
    return F.when(F.schema_of_variant(parsed(text)).startswith("OBJECT"), text)


def claims(text: Column) -> Column:
    """An agent's evidence as an array of (claim, source).

    A JSON array of objects is read as such, entries of other kinds as claims without a source; an object counts as its one entry. Blank or null text is an empty array,
    and text that is no JSON is one claim without a source, so nothing that was said gets lost.
    """
    value = parsed(text)
    kind = F.schema_of_variant(value)
    one = "struct<claim:string,source:string>"
    single = lambda v: F.struct(F.coalesce(F.try_variant_get(v, "$.claim", "string"), v.cast("string")).alias("claim"), F.coalesce(F.try_variant_get(v, "$.source", "string"), F.lit("")).alias("source"))
    entries = F.transform(F.try_variant_get(value, "$", "array<variant>"), single)
    whole = F.array(F.struct(text.alias("claim"), F.lit("").alias("source")))
    empty = F.array().cast(f"array<{one}>")
    return (
        F.when(text.isNull() | (F.trim(text) == ""), empty).when(kind.startswith("ARRAY"), entries).when(kind.startswith("OBJECT"), F.array(single(value))).otherwise(whole)
    )


def read_objects(rows: DataFrame, column: str, schema: str, keep: str = "_corrupt") -> DataFrame:
    """``rows`` with the fields of a JSON column under ``schema``; rows whose text doesn't fit have null fields and their text in ``keep``."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    read = F.from_json(column, f"{schema}, {keep} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": keep})
    return rows.withColumn("_j", read).select("*", *(F.col(f"_j.{c}").alias(c) for c in [*names, keep])).drop("_j")


def summary_of(runs: DataFrame, inputs: str = "inputs", findings: str = "findings") -> DataFrame:
    """``runs`` with ``n_claims``, ``n_sourced`` and ``damaged``: what a run says and how much of it names a source."""
    c = claims(F.col(findings))
    damaged = (F.trim(F.coalesce(findings, F.lit(""))) != "") & parsed(F.col(findings)).isNull()
    return runs.withColumns({"n_claims": F.size(c), "n_sourced": F.size(F.filter(c, lambda x: x["source"] != "")), "damaged": damaged, "readable": object_of(F.col(inputs)).isNotNull()})
