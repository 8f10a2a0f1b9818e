"""Exit alerts of positions from a stream of prices, each rule once per position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ALERTS = "position_id long, rule string, at timestamp, price double"


class Watch(StatefulProcessor):
    """State of a position: the rules that have fired. A timer on event time ends the longest hold, whether prices come or not."""

    def __init__(self, hold_ms: int):
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fired = handle.getMapState("fired", "rule string", "at timestamp")
        self.deadline = handle.getValueState("deadline", "ms long")

    def _alert(self, key, rule: str, at: pd.Timestamp, price: float | None) -> list[tuple]:
        if self.fired.containsKey((rule,)):
            return []
        self.fired.updateValue((rule,), (at,))
        return [(key[0], rule, at, price)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first: dict[str, tuple] = {}  # of each rule the earliest hit of this batch
        start = None
        for df in rows:
            # plain arrays: most groups are a few rows, for which pandas' own sorting and filtering cost more than the rows
            at, tick, price = df["at"].to_numpy(), df["tick"].to_numpy(), df["price"].to_numpy(dtype=float, na_value=np.nan)
            start = at.min() if start is None else min(start, at.min())
            for rule, hit in (("stop", price <= df["stop"].to_numpy()), ("target", price >= df["target"].to_numpy())):
                if (k := np.flatnonzero(hit)).size:
                    i = k[np.lexsort((tick[k], at[k]))[0]]
                    best = (at[i], tick[i], price[i])
                    first[rule] = min(first.get(rule, best), best)
        if start is not None and not self.deadline.exists():
            end = int(pd.Timestamp(start).value // 1_000_000) + self.hold_ms
            self.deadline.update((end,))
            self.handle.registerTimer(end)
        out = [a for rule, (at, _, price) in sorted(first.items()) for a in self._alert(key, rule, pd.Timestamp(at), float(price))]
        if out:
            yield pd.DataFrame(out, columns=["position_id", "rule", "at", "price"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        if out := self._alert(key, "hold", pd.Timestamp(end, unit="ms"), None):
            yield pd.DataFrame(out, columns=["position_id", "rule", "at", "price"])

    def close(self) -> None:
        pass


def watch(ticks: DataFrame, hold_days: int, late: str = "1 hour") -> DataFrame:
    """Alerts (position_id, rule, at, price) of a stream (position_id, tick, at, price, stop, target): the first price at or below the stop, the first at or above the target, and the end of the longest hold.

    ``tick`` orders prices of one moment. Prices later than ``late`` after the newest are still watched, but the timer doesn't wait for them.
    """
    keyed = ticks.withWatermark("at", late).groupBy("position_id")
    return keyed.transformWithStateInPandas(Watch(hold_days * 86_400_000), ALERTS, "Append", "eventTime")


def log_alerts(spark: SparkSession, alerts: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Everything that has arrived is watched and its alerts appended to ``log``; the state in ``checkpoint`` says what has fired, so a restart repeats none."""
    # every task of a batch starts a Python worker and opens a store, so there are as many as cores can use; a restart keeps the checkpoint's number
    confs = dict([PROVIDER, ("spark.sql.shuffle.partitions", str(2 * spark.sparkContext.defaultParallelism))])
    before = {k: spark.conf.get(k, None) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        return alerts.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def replayed(spark: SparkSession, parts: list[DataFrame], folder: str, hold_days: int) -> DataFrame:
    """The log after each of ``parts`` has arrived in turn, with the query stopped and started again in between."""
    schema = parts[0].schema
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        query = log_alerts(spark, watch(spark.readStream.schema(schema).parquet(f"{folder}/in"), hold_days), f"{folder}/log", f"{folder}/state")
        query.awaitTermination()
    return spark.read.schema(ALERTS).parquet(f"{folder}/log").select("position_id", "rule", F.col("at").cast("timestamp_ntz").alias("at"), "price")
