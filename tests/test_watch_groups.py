"""Few workers a batch, whatever the session's shuffles, and no frames without alerts."""

from datetime import datetime, timedelta

import pandas as pd

from quillfin.streaming import watch as wt


def test_alerts_of_ties_and_nothing():
    class Fired(dict):
        containsKey, updateValue = dict.__contains__, dict.__setitem__

    class Value:
        def exists(self):
            return hasattr(self, "v")

        def update(self, v):
            self.v = v

    w = wt.Watch(1000)
    w.fired, w.deadline, w.handle = Fired(), Value(), type("H", (), {"registerTimer": lambda self, ms: None})()
    t = pd.Timestamp("2024-01-01")
    df = pd.DataFrame({"at": [t, t, t], "tick": [3, 1, 2], "price": [1.0, 2.0, None], "stop": [2.5] * 3, "target": [9.0] * 3})
    (out,) = w.handleInputRows((7,), iter([df]), None)
    assert out.values.tolist() == [[7, "stop", t, 2.0]] and w.deadline.v == (t.value // 1_000_000 + 1000,)
    assert list(w.handleInputRows((7,), iter([df]), None)) == []


def test_partitions_follow_the_cores(spark, tmp_path):
    t = datetime(2024, 1, 1)
    ticks = spark.createDataFrame([(k, k, t + timedelta(hours=k), 1.0, 2.0, 9.0) for k in range(6)], "position_id long, tick long, at timestamp, price double, stop double, target double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        got = wt.replayed(spark, [ticks], str(tmp_path / "w"), 20)
        assert got.count() == 6 and spark.conf.get("spark.sql.shuffle.partitions") == "31"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    stores = [p for p in (tmp_path / "w/state/state/0").iterdir() if p.name.isdigit()]
    assert len(stores) == 2 * spark.sparkContext.defaultParallelism
