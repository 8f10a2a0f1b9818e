"""Live arrival as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import merge, replace_table


def first_seen(listings: DataFrame, delay: str = "7 days") -> DataFrame:
    """A stream of listings (doc_id, seen_at, ...) from several sources with only the first of each filing within the overlap window."""
    return listings.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["doc_id"])


def arrivals_per_window(listings: DataFrame, window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Filings per source and window of event time; late ones count until the watermark passes."""
    return listings.withWatermark("seen_at", delay).groupBy(F.window("seen_at", window), "source").agg(F.count("*").alias("filings"))


def upsert_into(spark: SparkSession, stream: DataFrame, path: str, keys: list[str], rules: dict, checkpoint: str, schema) -> StreamingQuery:
    """Each micro-batch is merged into a Parquet table; a batch that runs again changes nothing.

    The table is rewritten per batch: meant for the filings table, which holds thousands of rows a year. For larger
    ones use a table format with MERGE.
    """

    def write(batch: DataFrame, _: int) -> None:
        once = batch.groupBy(*keys).agg(*(F.min_by(c, "seen_at").alias(c) for c in batch.columns if c not in keys))
        try:
            stored = batch.sparkSession.read.schema(schema).parquet(path)
            stored.take(1)
        except Exception:  # no table yet
            stored = batch.sparkSession.createDataFrame([], schema)
        replace_table(batch.sparkSession, merge(stored, once, keys, rules), path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alerts(stream: DataFrame, log: str, checkpoint: str, start_at: str) -> StreamingQuery:
    """Trades seen since ``start_at`` are appended once each to the alert log; the log itself says what was sent."""

    def write(batch: DataFrame, _: int) -> None:
        new = batch.where(F.col("seen_at") >= F.lit(start_at).cast("timestamp")).dropDuplicates(["trade_id"])
        try:
            new = new.join(batch.sparkSession.read.parquet(log).select("trade_id"), "trade_id", "left_anti")
        except Exception:  # no log yet
            pass
        new.write.mode("append").parquet(log)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
