"""The benchmark's trading calendar and alignment to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BENCHMARK = "SPY"
ZONE = "America/New_York"


def trading_days(prices: DataFrame, benchmark: str = BENCHMARK) -> DataFrame:
    """(date, i): the benchmark's days, numbered from 0. A few thousand rows whatever the
    number of trades, so the one-partition window is bounded by the calendar."""
    days = prices.where(F.col("symbol") == benchmark).select("date").distinct()
    return days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("i"))


def next_day_map(days: DataFrame) -> DataFrame:
    """(date, next_i): for every calendar date from the first trading day to the last,
    the number of the first trading day on or after it. Small; joined by broadcast."""
    ahead = days.select("date", "i", F.lag("date").over(Window.orderBy("date")).alias("before"))
    begin = F.coalesce(F.date_add("before", 1), F.col("date"))
    return ahead.select(F.explode(F.sequence(begin, F.col("date"))).alias("date"), F.col("i").alias("next_i"))


def last_day_map(days: DataFrame, until: Column | None = None) -> DataFrame:
    """(date, last_i): for every date from the first trading day to the last, the number
    of the last trading day on or before it."""
    ahead = days.select("date", "i", F.lead("date").over(Window.orderBy("date")).alias("after"))
    end = F.coalesce(F.date_sub("after", 1), F.col("date"))
    return ahead.select(F.explode(F.sequence(F.col("date"), end)).alias("date"), F.col("i").alias("last_i"))


def eastern(ts: Column) -> Column:
    """A UTC wall-clock timestamp in New York's."""
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), ts.cast("timestamp_ntz"))


def entry_date(available_at: Column) -> Column:
    """The first date whose open lies after the moment: that day before 09:30 in New York, else the next.

    Before the calendar's first day there is none: the map has no such dates.
    """
    et = eastern(available_at)
    early = (F.hour(et) * 60 + F.minute(et)) < 9 * 60 + 30
    return F.when(early, F.to_date(et)).otherwise(F.date_add(F.to_date(et), 1))


def with_entry(trades: DataFrame, days: DataFrame, column: str = "available_at") -> DataFrame:
    """``trades`` with ``d0`` (day number) and ``d0_date``; rows without an entry day are dropped (pending).

    A moment on a date before the first trading day has no entry, even if the next open is the first day's.
    """
    first = days.agg(F.min("date").alias("first_day"))
    keyed = trades.withColumn("_et", F.to_date(eastern(F.col(column)))).withColumn("_entry", entry_date(F.col(column)))
    found = keyed.join(F.broadcast(next_day_map(days)).withColumnRenamed("date", "_entry"), "_entry").join(F.broadcast(first)).where("_et >= first_day")
    return found.join(F.broadcast(days.select(F.col("date").alias("d0_date"), F.col("i").alias("next_i"))), "next_i").withColumnRenamed("next_i", "d0").drop("_et", "_entry", "first_day")
