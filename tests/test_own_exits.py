"""Own positions' exits read the lines a fixed number of times, and next sales are found in one pass."""

import random
from datetime import date, datetime, timedelta

from quillfin.plans import positions as ps
from quillfin.sources.fixture import Fixture


def test_lines_are_read_once_for_next_sales(spark, sf):
    fx = Fixture(spark, sf)
    plan = ps.member_sales(fx["positions"], fx["trades"], fx["filings"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and plan.count("REPARTITION_BY_COL") == 1


def test_filters_on_a_trades_number_apply_before_lines_move(spark, sf):
    plan = Fixture(spark, sf)["trades"].where("trade_id % 211 = 0")._jdf.queryExecution().executedPlan().toString()
    assert "% 211" in plan.split("REPARTITION_BY_COL")[1]


def test_next_sales_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    day = lambda n: date(2001, 1, 1) + timedelta(n)
    pick = lambda *xs: rng.choice(xs)
    filings = [(f"F{k}", pick(None, datetime(2001, 1, 1) + timedelta(hours=rng.randint(0, 600))), pick(None, datetime(2001, 1, 1) + timedelta(hours=rng.randint(0, 600)))) for k in range(60)]
    trades = [(k, pick(None, "M1", "M2", "M3"), pick(None, "A", "B"), pick(None, f"F{rng.randint(0, 70)}", f"F{rng.randint(0, 70)}"), pick("BUY", "SELL", "SELL_PARTIAL", None)) for k in range(300)]
    positions = [(1000 + n, pick(None, *range(310)), pick("a", "B", None), pick(None, *(day(rng.randint(0, 30)) for _ in range(9)))) for n in range(200)]
    public = {d: a or s for d, a, s in filings}
    want = {}
    for p, source, ticker, bought in positions:
        for t, member, symbol, _, _ in trades:
            symbol = symbol or (ticker and ticker.upper())
            if t != source or member is None or symbol is None or bought is None:
                continue
            later = [(public[d], d) for _, m, s, d, a in trades if m == member and s == symbol and a in ("SELL", "SELL_PARTIAL") and public.get(d) and public[d].date() >= bought]
            if later:
                want[p] = (min(later)[1], min(later)[0].date())
    found = ps.member_sales(
        spark.createDataFrame(positions, "position_id long, trade_id long, ticker string, buy_date date"),
        spark.createDataFrame(trades, "trade_id long, member_id string, symbol string, doc_id string, action string"),
        spark.createDataFrame(filings, "doc_id string, available_at timestamp_ntz, first_seen_at timestamp_ntz"),
    )
    assert {r.position_id: (r.doc_id, r.sold_on) for r in found.collect()} == want and len(want) > 50
