"""What meets in one group, or is found once, stays the same however many trades share it."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillfin.functions.stats import medians
from quillfin.operators import exits as ex
from quillfin.plans import backtest as bt
from quillfin.session import written

TRADE = "book string, trade_id long, doc_id string, symbol string, d0 int, exit_i int, exit_at string, exit_net double, entry_net double"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ledger_of_many_trades_a_day(spark, seed):
    """A book gets one trade a day and symbol, and still settles every trade as a walk over all of them does."""
    r = random.Random(seed)
    rows = []
    for k in range(1500):
        d0 = r.randrange(30)
        at = r.choice(["open", "close", "intraday"])
        rows.append(("b", k, f"F{r.randrange(900)}", r.choice("ABCDEFG"), d0, d0 + r.randrange(1, 9) if at == "open" else d0 + r.randrange(9), at, 9.0 + r.random() * 2, 10.0))
    trades = spark.createDataFrame(rows, TRADE)
    closes = {s: (list(range(50)), [10.0 + (i * ord(s)) % 7 for i in range(50)]) for s in "ABCDEFG"}
    bars = spark.createDataFrame([(s, i, c) for s, (days, prices) in closes.items() for i, c in zip(days, prices)], "symbol string, i int, c double")
    want = [("b", *e) for e in bt.Book(100.0, 0.2, 4, 0.0, closes).run(pd.DataFrame(rows, columns=[c.split()[0] for c in TRADE.split(", ")]))]
    clean = lambda rows: sorted((x[1], x[2], -1 if pd.isna(x[3]) else int(x[3]), x[4] or "", *(None if pd.isna(v) else round(v, 9) for v in x[5:])) for x in rows)
    assert clean(bt.ledger(trades, bars, capital=100.0, size=0.2, max_positions=4).collect()) == clean(want)
    assert bt.offers(trades).count() <= 30 * 7


def test_signals_that_start_alike_are_found_once(spark, monkeypatch):
    bars = spark.createDataFrame([("A", i, 10.0, 11.0, 9.0, 10.0) for i in range(80)], "symbol string, i int, o double, h double, l double, c double")
    sig = spark.range(300).select(F.col("id").alias("trade_id"), F.lit("A").alias("symbol"), (F.col("id") % 3).cast("int").alias("d0"), F.when(F.col("id") % 2 == 0, 7).alias("sale"))
    asked, found = [], ex.first_exits
    monkeypatch.setattr(ex, "first_exits", lambda starts, *rest: asked.append(starts.count()) or found(starts, *rest))
    out = ex.simulate(sig, bars, (ex.Rule("fixed_hold", 5), ex.Rule("member_sale")), 80)
    assert asked == [3, 6]  # days; days with and without a sale
    assert {(r.d, r.rule_no, r.s, r.exit_i) for r in out.selectExpr("trade_id % 3 as d", "trade_id % 2 = 0 as s", "rule_no", "exit_i").collect()} == {
        (d, k, s, d + 5 if k == 0 else 7 if s else d + 60) for d in range(3) for k in (0, 1) for s in (True, False)
    }
    assert out.count() == 600


def test_next_sale_by_days(spark):
    r = random.Random(5)
    sig = [(k, r.choice(["M", "N", None]), r.choice("AB"), r.randrange(40)) for k in range(300)]
    sold = [(r.choice(["M", "N"]), r.choice("AB"), r.randrange(40)) for _ in range(20)]
    got = ex.next_sale(spark.createDataFrame(sig, "trade_id long, member_id string, symbol string, d0 int"), spark.createDataFrame(sold, "member_id string, symbol string, d0 int"))
    assert "sale" in got.columns and not [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and " > " in x]  # days aren't paired
    want = {k: min((d for a, b, d in sold if (a, b) == (m, s) and d > d0), default=None) for k, m, s, d0 in sig}
    assert {x.trade_id: x.sale for x in got.collect()} == want


@pytest.mark.parametrize("n", [1, 2, 7, 400, 5001, 40000])
def test_medians(spark, n):
    v = F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.rand(n) - 0.5)
    rows = written(spark.range(n).select(F.lit("all").alias("g"), v.alias("v")).unionByName(spark.range(3).select(F.lit("b").alias("g"), F.when(F.col("id") > 0, F.col("id").cast("double")).alias("v"))))
    got = {r.g: r.median for r in medians(rows, ["g"], "v").collect()}
    assert got == {r.g: pytest.approx(r.m, abs=1e-15) for r in rows.groupBy("g").agg(F.median("v").alias("m")).collect()} and got["b"] == 1.5
