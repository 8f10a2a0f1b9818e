"""Upserts: the merged table from a stored one and new rows, to be written in its place."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Rule = str | Callable[[Column, Column], Column]


def merge(stored: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Rule] | None = None, default: Rule = "new", delete_missing: bool = False) -> DataFrame:
    """``stored`` with ``new`` merged in by ``keys`` (one row each on both sides).

    Rules per column, on rows in both: ``new`` overwrites, ``keep`` keeps, ``first`` keeps what is not null, ``fill`` takes the new
    value if not null, or a function of (stored, new). Columns only in ``stored`` stay. With ``delete_missing`` rows not in ``new`` go.
    """
    rules = rules or {}
    s = stored.select(F.struct(*stored.columns).alias("_s"), *keys)
    n = new.select(F.struct(*new.columns).alias("_n"), *keys)
    both = s.join(n, keys, "right" if delete_missing else "full_outer")
    out = []
    for c in stored.columns:
        if c in keys:
            out.append(F.col(c))
            continue
        old = F.col(f"_s.{c}")
        if c not in new.columns:
            out.append(old.alias(c))
            continue
        fresh, rule = F.col(f"_n.{c}"), rules.get(c, default)
        merged = {"new": fresh, "keep": old, "first": F.coalesce(old, fresh), "fill": F.coalesce(fresh, old)}[rule] if isinstance(rule, str) else rule(old, fresh)
        out.append(F.when(F.col("_s").isNull(), fresh).when(F.col("_n").isNull(), old).otherwise(merged).alias(c))
    return both.select(*out)


#: Merge rules of the tables that ingestion writes.
FILINGS = {"available_at": "keep", "available_basis": "keep", "first_seen_at": "first", "index_seen_at": "first", "search_seen_at": "first", "filer_name": "fill"}
TRADES_KEEP = ("symbol", "ticker_status", "is_etf", "sector", "mcap_bucket", "committee_relevant")


def available_at(stored_at: Column, stored_basis: Column, new_at: Column) -> Column:
    """When a filing became public never changes, except that a backfilled row without a date gets one."""
    return F.when(stored_at.isNull() | ((stored_basis == "filed") & stored_at.isNull()), new_at).otherwise(stored_at)


def drop_stale(trades: DataFrame, kept: DataFrame, *references: DataFrame) -> DataFrame:
    """``trades`` without rows past their filing's ``keep`` lines, unless a reference table (trade_id) names them."""
    used = references[0].select("trade_id")
    for r in references[1:]:
        used = used.unionAll(r.select("trade_id"))
    marked = trades.join(kept, "doc_id", "left")
    stale = marked.where("line_no > keep").join(used.distinct(), "trade_id", "left_anti").select("trade_id")
    return trades.join(stale, "trade_id", "left_anti")


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write ``df`` in place of a Parquet table that it may read: to a new folder first, renamed when complete."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.part-{uuid.uuid4().hex}")
    df.write.parquet(part.toString())
    fs.delete(target, True)
    fs.rename(part, target)


def replace_partition(df: DataFrame, path: str, column: str = "as_of") -> None:
    """Overwrite only the partitions of ``column`` that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
