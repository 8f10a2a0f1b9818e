"""Maxima over intervals of a series, two lookups each, by a sparse table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sparse_table(series: DataFrame, key: str, place: str, value: str, longest: int) -> DataFrame:
    """``series`` with ``m``: at k the maximum of the 2^k values from this place on (fewer at the series' end); nulls are passed over.

    ``place`` counts from 0 without gaps. Each power is the greater of two of the power below, so building costs rows times the logarithm of ``longest``.
    """
    w = Window.partitionBy(key).orderBy(place)
    out, names = series.withColumn("_m0", F.col(value)), ["_m0"]
    for k in range(max(0, longest).bit_length() - 1 if longest > 1 else 0):
        out = out.withColumn(f"_m{k + 1}", F.greatest(f"_m{k}", F.lead(f"_m{k}", 1 << k).over(w)))
        names.append(f"_m{k + 1}")
    return out.withColumn("m", F.array(*names)).drop(*names)


def range_max(intervals: DataFrame, table: DataFrame, key: str, place: str, low: str, high: str, name: str) -> DataFrame:
    """``intervals`` with the maximum of the series' values from ``low`` to ``high``, both included; null for an empty interval.

    The two powers of two that cover an interval may overlap, which a maximum doesn't mind. Both lookups are equi-joins, whatever the intervals' length.
    """
    size = F.col(high) - F.col(low) + 1
    own = intervals.withColumn("_k", F.when(size > 0, F.length(F.bin(size)) - 1)).withColumn("_b", F.expr(f"{high} - shiftleft(1L, _k) + 1"))
    left = table.select(F.col(key), F.col(place).alias("_a"), F.col("m").alias("_ma"))
    right = table.select(F.col(key), F.col(place).alias("_b"), F.col("m").alias("_mb"))
    met = own.withColumn("_a", F.when(size > 0, F.col(low))).join(left, [key, "_a"], "left").join(right, [key, "_b"], "left")
    return met.withColumn(name, F.greatest(F.get("_ma", F.col("_k")), F.get("_mb", F.col("_k")))).drop("_k", "_a", "_b", "_ma", "_mb")
