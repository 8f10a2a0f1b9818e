"""Grouped samples and empirical-Bayes shrinkage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import values_at
from ..session import written


def two_level(df: DataFrame, group: list[str], unit: list[str], values: dict[str, Column], count: str = "n_trades") -> DataFrame:
    """Means per unit (one observation each): the first level of a two-level mean."""
    return df.groupBy(*group, *[u for u in unit if u not in group]).agg(*(F.avg(v).alias(k) for k, v in values.items()), F.count("*").alias(count))


def sample_var(c: Column) -> Column:
    """Sample variance, 0 for a single value."""
    return F.coalesce(F.var_samp(c), F.lit(0.0))


def shrink(groups: DataFrame, scope: list[str], n: str = "n", mean: str = "mean", var: str = "var", out: str = "shrunk") -> DataFrame:
    """``groups`` with the group mean drawn toward the scope's pooled mean.

    mu = sum(n mean) / sum(n); s2 = sum((n - 1) var) / sum(n - 1); tau2 = max(var_samp(mean) - avg(s2 / n), 0), both
    unweighted; weight tau2 / (tau2 + s2 / n), 1 where that is 0 / 0. A single group keeps its mean.
    """
    n_, m_, v_ = F.col(n), F.col(mean), F.col(var)
    groups = written(groups)  # read twice
    parts = groups.groupBy(*scope).agg(
        F.sum(n_ - 1).alias("_d"), (F.sum(n_ * m_) / F.sum(n_)).alias("_mu"), F.sum((n_ - 1) * v_).alias("_sv"), F.count("*").alias("_k"), F.var_samp(m_).alias("_vm"), F.avg(1 / n_).alias("_inv")
    )
    both = groups.join(parts, scope) if scope else groups.crossJoin(F.broadcast(parts))  # one row
    s2 = F.when(F.col("_d") > 0, F.col("_sv") / F.col("_d")).otherwise(0.0)
    tau2 = F.greatest(F.coalesce(F.col("_vm"), F.lit(0.0)) - F.col("_s2") * F.col("_inv"), F.lit(0.0))
    both = both.withColumn("_s2", s2).withColumn("_tau2", tau2)
    total = F.col("_tau2") + F.col("_s2") / n_
    weight = F.when(total > 0, F.col("_tau2") / F.when(total > 0, total)).otherwise(1.0)
    value = F.when(F.col("_k") < 2, m_).otherwise(F.col("_mu") + weight * (m_ - F.col("_mu")))
    return both.withColumn(out, value).withColumn("pooled", F.col("_mu")).drop("_d", "_mu", "_sv", "_k", "_vm", "_inv", "_s2", "_tau2")


def clip_bounds(df: DataFrame, value: str, scope: list[str], share: float = 0.01) -> DataFrame:
    """(scope, low, high): the values at positions round(share (n - 1)) of the sorted values, halves to even.

    Equal values are one row with a count, and only the sorted runs that hold the two positions are ranked.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*scope, value).agg(F.count("*").alias("_c"))
    if not scope:
        counts = counts.withColumn("_all", F.lit(1))
    at = lambda s: F.bround(F.lit(s) * (F.col("n") - 1), 0)
    return values_at(counts, scope or ["_all"], value, "_c", {"low": at(share), "high": at(1 - share)}).drop("_all")


def medians(rows: DataFrame, by: list[str], value: str, out: str = "median", error: float = 0.001) -> DataFrame:
    """(by, median of the values that aren't null) of written ``rows``, exactly.

    Quantiles known to within a share of the ranks enclose the middle; values outside of them are only counted, so that no task holds a group's values.
    """
    around = F.percentile_approx(value, [0.5 - 5 * error, 0.5 + 5 * error], int(1 / error))
    known = rows.where(F.col(value).isNotNull())
    bounds = written(known.groupBy(*by).agg(around.alias("_b"), F.count("*").alias("_n")))
    v = F.col(value)
    inside = known.join(bounds, by).where(v <= F.col("_b")[1])
    # what lies below is one row
    counts = inside.groupBy(*by, "_n", F.when(v >= F.col("_b")[0], v).alias("_v")).agg(F.count("*").alias("_c"))
    until = F.sum("_c").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))
    low, high = F.expr("(_n + 1) div 2"), F.expr("_n div 2 + 1")
    at = lambda place: F.min(F.when(F.col("_until") >= place, F.col("_v")))
    return counts.withColumn("_until", until).where("_v is not null").groupBy(*by).agg((at(low) * 0.5 + at(high) * 0.5).alias(out))
