"""Places in a global order, found without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def sorted_runs(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, with ``_run`` and the place in it, ``_nth``, from 0; written, so that both stay as they are."""
    runs = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(runs.withColumn("_run", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """``df`` with its place, from 1, in the order of these columns, which tell all rows apart.

    Only the number of rows of each partition meets in one place; equal rows
    would be numbered in any order. An empty table stays empty.
    """
    runs = sorted_runs(df, order)
    counts = sorted((r["_run"], r["count"]) for r in runs.groupBy("_run").count().collect())  # a number for each partition
    starts, total = [], 0
    for run, count in counts:
        starts.append((run, total))
        total += count
    start = F.broadcast(df.sparkSession.createDataFrame(starts, "_run int, _start long"))
    return runs.join(start, "_run").withColumn(name, F.col("_start") + F.col("_nth") + 1).drop("_run", "_nth", "_start")


def batches(starts: DataFrame, key: str, start: str, size: int = 50) -> DataFrame:
    """(batch, start, keys) of rows (key, start): ``size`` keys each, by start and key; a batch begins at its least start."""
    if size < 1:
        raise ValueError("a batch needs at least one row")
    placed = numbered(starts.select(key, start), [start, key])
    rows = placed.withColumn("batch", ((F.col("n") - 1) / size).cast("long"))
    return rows.groupBy("batch").agg(F.min(start).alias(start), F.sort_array(F.collect_list(F.struct(start, key)))[key].alias("keys"))


def stalest(rows: DataFrame, key: str, last: str, fresh_days: Column, today: str, limit: int = 300) -> DataFrame:
    """Rows that are due, the ones never seen first, then those seen longest ago, numbered by ``n``; at most ``limit`` (the pass's size)."""
    due = rows.where(F.col(last).isNull() | (F.col(last) < F.date_sub(F.lit(today).cast("date"), fresh_days)))
    return numbered(due.orderBy(F.asc_nulls_first(last), key).limit(limit), [last, key])


def values_at(counts: DataFrame, scope: list[str], value: str, count: str, places: dict[str, Column]) -> DataFrame:
    """(scope, a column for each of ``places``): the values at these places, from 0, among all values of a scope in order.

    ``counts`` has a row for each (scope, value); a place is an expression over ``n``, the scope's size. Whole sorted runs are passed over by their sums, and only the
    run that holds a place is looked into.
    """
    runs = sorted_runs(counts.select(*scope, value, count), [*scope, value])
    sums = runs.groupBy(*scope, "_run").agg(F.sum(count).alias("_s"))
    inside = sums.groupBy(*scope).agg(F.sum("_s").alias("n"), F.collect_list(F.struct("_run", "_s")).alias("_runs"))  # one entry a run
    before = F.aggregate(F.filter("_runs", lambda x: x["_run"] < F.col("_run")), F.lit(0).cast("long"), lambda a, x: a + x["_s"])
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("_place"), p.cast("long").alias("_at")) for k, p in places.items())))
    each = inside.select(*scope, "_runs", wanted.alias("_w")).select(*scope, "_runs", "_w._place", "_w._at").select("*", F.explode("_runs").alias("_r"))
    each = each.select(*scope, "_place", "_at", F.col("_r._run").alias("_run"), F.col("_r._s").alias("_s"), "_runs").withColumn("_before", before)
    each = each.where("_before <= _at and _at < _before + _s").drop("_runs", "_s")
    near = runs.join(each, [*scope, "_run"])
    until = F.sum(count).over(Window.partitionBy(*scope, "_run", "_place").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    hit = near.withColumn("_until", F.col("_before") + until).where("_until > _at")
    found = hit.groupBy(*scope, "_place").agg(F.min(value).alias("_v"))
    return found.groupBy(*scope).agg(*(F.max(F.when(F.col("_place") == k, F.col("_v"))).alias(k) for k in places))
