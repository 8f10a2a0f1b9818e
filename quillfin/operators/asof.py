"""As-of lookups: union, window, keep the probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(
    probes: DataFrame, bars: DataFrame, key: str, probe_date: str, value: list[str], forward: bool = False, strict: bool = False, bar_date: str = "date", prefix: str = "asof_"
) -> DataFrame:
    """``probes`` with the values of the last bar on or before (or first on or after) their date.

    One shuffle by key serves both sides, and the work is linear in rows, where a range join would pair
    every probe with all earlier bars. Struct values carry nulls: a bar with a null value still
    counts as the last one; filter the bars first to pass over such.
    """
    cols = probes.columns
    # at equal dates: bars come first looking back, unless strict; the other way round looking forward
    bar_first = strict if forward else not strict
    left = probes.select(F.col(key).alias("_k"), F.col(probe_date).alias("_d"), F.lit(1 if bar_first else 0).alias("_side"), F.struct(*cols).alias("_row"), F.lit(None).cast(_struct(bars, bar_date, value)).alias("_v"))
    right = bars.select(F.col(key).alias("_k"), F.col(bar_date).alias("_d"), F.lit(0 if bar_first else 1).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.struct(F.col(bar_date).alias("date"), *value).alias("_v"))
    both = left.unionByName(right)
    w = Window.partitionBy("_k").orderBy("_d", "_side")
    if forward:
        found = F.first("_v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    else:
        found = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("_f", found).where("_row is not null")
    return rows.select("_row.*", *(F.col(f"_f.{c}").alias(prefix + c) for c in ["date", *value]))


def _struct(bars: DataFrame, bar_date: str, value: list[str]) -> str:
    fields = [f"date:{bars.schema[bar_date].dataType.simpleString()}"] + [f"{c}:{bars.schema[c].dataType.simpleString()}" for c in value]
    return f"struct<{','.join(fields)}>"
