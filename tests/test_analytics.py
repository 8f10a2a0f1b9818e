"""Analyses on hand-made tables, and the engine's own invariants."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillfin.functions import scalars as sc
from quillfin.functions.stats import clip_bounds, shrink
from quillfin.operators import exits as ex
from quillfin.operators import matching, merge
from quillfin.operators.asof import asof
from quillfin.operators.calendar import trading_days, with_entry
from quillfin.plans import backtest as bt
from quillfin.plans import outcomes as oc
from quillfin.plans import queries as q
from quillfin.sources import filings as src
from quillfin.sources.fixture import Fixture

PRICES = "symbol string, date date, open double, high double, low double, close double, adj_close double, volume bigint"


def weekdays(n, start=date(2026, 2, 23)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += timedelta(days=1)
    return out


def bars(spark, paths, n=80):
    days = weekdays(n)
    rows = []
    for symbol, f in {"SPY": lambda i: 400.0 + 2 * i, **paths}.items():
        for i, d in enumerate(days):
            p = f(i)
            if p is not None:
                o, h, low, c = p if isinstance(p, tuple) else (p, p, p, p)
                rows.append((symbol, d, o, h, low, c, c, 1))
    return spark.createDataFrame(rows, PRICES)


def test_entry_days(spark):
    days = spark.createDataFrame([(date(2026, 3, 2), 0), (date(2026, 3, 3), 1), (date(2026, 3, 6), 2), (date(2026, 3, 9), 3)], "date date, i int")
    cases = {
        "2026-03-02T21:00": "2026-03-03", "2026-03-03T13:00": "2026-03-03", "2026-03-03T14:31": "2026-03-06", "2026-03-06T22:00": "2026-03-09", "2026-03-07T15:00": "2026-03-09", "2026-03-09T13:00": "2026-03-09",
        "2026-03-09T14:00": None, "2026-02-01T15:00": None,
    }
    df = spark.createDataFrame([(k, datetime.fromisoformat(k)) for k in cases], "k string, available_at timestamp_ntz")
    got = {r.k: str(r.d0_date) for r in with_entry(df, days).collect()}
    assert got == {k: v for k, v in cases.items() if v}


TRADES = "trade_id long, doc_id string, member_id string, symbol string, ticker_status string, action string, asset_type string, asset_name string, description string, tx_date date, mcap_bucket string"


def trade(i, symbol, action="BUY", kind="stock", name="", text=None, tx=date(2026, 2, 24), status="listed", doc="F1"):
    return (i, doc, "M1", symbol, status, action, kind, name, text, tx, "large")


def test_outcomes(spark):
    days = weekdays(80)
    p = bars(spark, {"A": lambda i: 100.0 + i, "GAP": lambda i: None if i == 7 else 50.0, "GONE": lambda i: 10.0 if i < 5 else None})
    f = spark.createDataFrame([("F1", datetime(2026, 2, 25, 22), None, "text"), ("F2", datetime(2026, 2, 25, 22), None, "vision"), ("F3", datetime(2027, 1, 1), None, None)], "doc_id string, available_at timestamp_ntz, first_seen_at timestamp_ntz, parse_method string")
    t = spark.createDataFrame([
        trade(1, "A"), trade(2, "A", "SELL"), trade(3, "A", kind="option", text="Put options"), trade(4, "A", kind="option", name="XYZ", text="CALL options"), trade(5, "SPY"), trade(6, "GONE"), trade(7, "A", tx=date(2027, 1, 1)),
        trade(8, None), trade(9, "A", doc="F3"), trade(10, "A", doc="F2"), trade(11, "A", status="delisted"), trade(12, "GAP"),
    ], TRADES)
    out = {r.trade_id: r for r in oc.compute(t, f, p).collect()}
    assert sorted(out) == [1, 2, 3, 4, 5, 6, 7, 12]
    a = out[1]
    assert a.d0_date == days[3] and a.d0_open == 103 and a.complete
    assert a.ret_20 == pytest.approx(123 / 103 - 1) and a.abn_ret_20 == pytest.approx(123 / 103 - 1 - (446 / 406 - 1)) and a.win_20
    assert a.tx_ret == pytest.approx(103 / 101 - 1) and a.open_infl_2 == pytest.approx(103 / 105 - 1)
    assert [out[i].copyable for i in (1, 2, 3, 4, 5)] == [True, False, False, True, True] and out[2].win_20 is None
    assert out[5].abn_ret_20 == 0 and out[5].win_20 is False
    assert out[6].ret_1 is not None and out[6].ret_5 is None and out[7].tx_ret is None
    assert out[12].ret_5 is not None and out[12].open_infl_5 is not None and out[12].ret_1 is not None


def test_shrink(spark):
    df = spark.createDataFrame([("a", 30, 0.04, 0.01), ("b", 10, -0.02, 0.02), ("c", 1, 0.30, 0.0)], "g string, n int, mean double, var double")
    got = {r.g: r.shrunk for r in shrink(df, []).collect()}
    n, m, v = [30, 10, 1], [0.04, -0.02, 0.30], [0.01, 0.02, 0.0]
    mu = sum(a * b for a, b in zip(n, m)) / 41
    s2 = (29 * 0.01 + 9 * 0.02) / 38
    mean = sum(m) / 3
    tau2 = max(sum((x - mean) ** 2 for x in m) / 2 - sum(s2 / k for k in n) / 3, 0)
    for g, k, x in zip("abc", n, m):
        assert got[g] == pytest.approx(mu + tau2 / (tau2 + s2 / k) * (x - mu))
    assert shrink(df.where("g = 'a'"), []).first().shrunk == 0.04


def test_clip_bounds_take_positions_rounded_to_even(spark):
    values = [float(i) for i in range(151)]  # 0.01 * 150 = 1.5 -> 2
    r = clip_bounds(spark.createDataFrame([(v,) for v in values], "v double"), "v", []).first()
    assert (r.low, r.high) == (2.0, 148.0)


SIG = "trade_id long, symbol string, d0 int"


def sim(spark, path, rule, n=80, d0=2, sale=None):
    p = bars(spark, {"A": path}, n)
    days, _ = ex.benchmark(p)
    s = spark.createDataFrame([(1, "A", d0)], SIG).withColumn("sale", F.lit(sale).cast("int"))
    r = ex.simulate(s, ex.series(p, days), rule, n).collect()
    return (r[0].exit_i, round(r[0].exit_price, 6), r[0].exit_at, r[0].reason) if r else None


def test_exit_rules(spark):
    flat = lambda i: 100.0
    assert sim(spark, flat, ex.Rule("fixed_hold", 5)) == (7, 100, "close", "hold")
    assert sim(spark, lambda i: None if i == 7 else 100.0, ex.Rule("fixed_hold", 5)) == (8, 100, "open", "hold")
    assert sim(spark, lambda i: 100.0 if i < 5 else None, ex.Rule("fixed_hold", 20)) == (4, 100, "close", "data_end")
    assert sim(spark, flat, ex.Rule("fixed_hold", 60), n=30) == (29, 100, "close", "open")
    dip = lambda i: (100.0, 100.0, 85.0, 95.0) if i == 4 else 100.0
    assert sim(spark, dip, ex.Rule("stop_target", stop=0.1)) == (4, 90, "intraday", "stop")
    gap = lambda i: 80.0 if i >= 4 else 100.0
    assert sim(spark, gap, ex.Rule("stop_target", stop=0.1)) == (4, 80, "open", "stop")
    both = lambda i: (100.0, 130.0, 85.0, 100.0) if i == 4 else 100.0
    assert sim(spark, both, ex.Rule("stop_target", stop=0.1, target=0.2)) == (4, 90, "intraday", "stop")
    rise = lambda i: (120.0, 125.0, 100.0, 120.0) if i == 6 else 100.0 + (20 if i > 3 else 0)
    assert sim(spark, rise, ex.Rule("trailing_stop", pct=0.1)) == (6, 108, "intraday", "stop")
    assert sim(spark, flat, ex.Rule("member_sale"), sale=9) == (9, 100, "open", "sale")
    assert sim(spark, flat, ex.Rule("member_sale"), sale=1)[3] == "hold"
    assert sim(spark, lambda i: None if i == 2 else 100.0, ex.Rule("fixed_hold", 5)) is None
    swing = lambda i: (100.0, 102.0, 98.0, 100.0) if i < 30 else 80.0
    assert sim(spark, swing, ex.Rule("atr_stop", mult=3), d0=20) == (30, 80, "open", "stop")
    assert sim(spark, swing, ex.Rule("atr_stop", mult=3), d0=5)[3] == "hold"  # too few bars before


def test_ledger_cash_settles_a_day_later(spark):
    p = bars(spark, {s: (lambda i: 10.0) for s in "ABCD"})
    days, spy = ex.benchmark(p)
    s = ex.series(p, days)
    sig = spark.createDataFrame([(k, f"F{k}", "M", "ABCD"[k], 1 + (k > 1), "large") for k in range(4)], "trade_id long, doc_id string, member_id string, symbol string, d0 int, mcap_bucket string")
    trades = ex.evaluate(ex.simulate(sig, s, ex.Rule("fixed_hold", 1), 80), sig, spy, costs=False).withColumn("book", F.lit("b"))
    ev = bt.ledger(trades, s, capital=100.0, size=0.5, max_positions=3).orderBy("i").collect()
    kinds = {(r.kind, r.trade_id) for r in ev if r.trade_id is not None}
    # both of day 1 take all cash; it is back, settled, only after day 2
    assert kinds == {("buy", 0), ("buy", 1), ("cash", 2), ("cash", 3)}
    assert all(r.amount >= 0 for r in ev if r.kind == "buy") and [r.equity for r in ev if r.kind == "day"] == [pytest.approx(100.0)] * 3


def test_ledger_refuses_what_is_held_and_what_is_too_much():
    import pandas as pd

    rows = [(1, "F1", "A", 0, 5, "close", 11.0), (2, "F2", "A", 1, 6, "close", 10.0), (3, "F3", "B", 1, 3, "open", 12.0), (4, "F4", "C", 2, 6, "close", 10.0), (5, "F5", "C", 3, 6, "close", 10.0)]
    trades = pd.DataFrame(rows, columns=["trade_id", "doc_id", "symbol", "d0", "exit_i", "exit_at", "exit_net"]).assign(entry_net=10.0)
    closes = {s: ([0, 2], [10.0, 11.0]) for s in "ABC"}
    events = list(bt.Book(100.0, 0.1, 2, 0.0, closes).run(trades))
    # A is held on day 1; two positions fill the book on day 2; B is sold at the open of day 3, before the purchase
    assert [(e[0], e[2]) for e in events if e[0] != "day"] == [("buy", 1), ("held", 2), ("buy", 3), ("full", 4), ("buy", 5)]
    worth = {e[1]: e[5] for e in events if e[0] == "day"}
    assert worth[1] == 100.0 and worth[2] == pytest.approx(102.0) and worth[3] == pytest.approx(103.0 + 0.1 * 10.2)
    assert worth[6] == pytest.approx(100.0 + 1.0 + 2.0) and list(worth) == list(range(7))


def test_fixed_holds_equal_outcomes(spark):
    rows = q.queries()["d34_engine_self_check"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r.n for r in rows) > 0 and all((r.max_diff or 0) < 1e-9 for r in rows)


def test_thirty_trades_in_one_filing_count_once(spark):
    fx = Fixture(spark, "/root/testdata/sf0.001")
    out = oc.compute(fx["trades"], fx["filings"], fx["prices"])
    per = q.rk.filing_means(out)
    assert per.count() == per.select("horizon", "member_id", "doc_id").distinct().count()


def test_asof(spark):
    b = spark.createDataFrame([("a", date(2026, 1, 1), 1.0), ("a", date(2026, 1, 5), None), ("a", date(2026, 1, 9), 3.0)], "symbol string, date date, close double")
    pr = spark.createDataFrame([(1, "a", date(2026, 1, 5)), (2, "a", date(2025, 1, 1)), (3, "z", date(2026, 1, 5)), (4, "a", date(2026, 1, 6))], "id int, symbol string, d date")
    back = {r.id: (r.asof_date, r.asof_close) for r in asof(pr, b, "symbol", "d", ["close"]).collect()}
    assert back == {1: (date(2026, 1, 5), None), 2: (None, None), 3: (None, None), 4: (date(2026, 1, 5), None)}
    ahead = {r.id: r.asof_close for r in asof(pr, b, "symbol", "d", ["close"], forward=True, strict=True).collect()}
    assert ahead == {1: 3.0, 2: 1.0, 3: None, 4: 3.0}


def test_member_resolution(spark):
    people = spark.createDataFrame([
        ("A1", "Van Orden", "Derrick", ["WI03"], ["WI"], False), ("A2", "Scott", "Austin", ["GA08"], ["GA"], False), ("A3", "Scott", "David", ["GA13"], ["GA"], False), ("A4", "McConnell", "A. Mitchell", [], ["KY"], True), ("A5", "Luján", "Ben Ray", [], ["NM"], True),
    ], "member_id string, last_name string, given_names string, house_seats array<string>, states array<string>, senator boolean")
    cases = {
        ("Hon. Derrick Van Orden", "house", "WI03"): "A1", ("Austin Scott", "house", "GA08"): "A2", ("Hon. David Scott", "house", "GA99"): "A3", ("Scott", "house", "GA"): None,
        ("A. Mitchell McConnell, Jr.", "senate", None): "A4", ("Ben Ray Lujan", "senate", None): "A5", ("Derrick Orden", "house", "WI03"): None, ("Some One", "house", "WI03"): "A1", ("No Member", "senate", None): None,
    }
    f = spark.createDataFrame(list(cases), "filer_name string, chamber string, state_district string")
    o = spark.createDataFrame([("Some One", "A1"), ("No Member", "-")], "filer_name string, bioguide string")
    got = {(r.filer_name, r.chamber, r.state_district): r for r in matching.resolve_members(f, people, o).collect()}
    assert {k: v.member_id for k, v in got.items()} == cases and got[("No Member", "senate", None)].status == "not a member"


def test_scalars(spark):
    def one(**cols):
        return spark.range(1).select(*(v.alias(k) for k, v in cols.items())).first()

    lit = F.lit
    r = one(a=sc.clean(lit(" a\u00a0 b\n")), b=sc.action(lit("Sale  (Partial)")), c=sc.owner(lit("")), d=sc.owner(lit("zz")), e=sc.us_date(lit("2/30/2026")), f=sc.us_date(lit("09/04/2026")), g=sc.ticker(lit(" -- ")), h=sc.ticker(lit("brk.b")))
    assert tuple(r) == ("a b", "SELL_PARTIAL", "self", None, None, date(2026, 9, 4), None, "BRK.B")
    got = [one(x=sc.amount(lit(v))[0], y=sc.amount(lit(v))[1]) for v in ("$1,001 - $15,000", "Over $50,000,000", "$5,000,001 +", "$250", "none")]
    assert [tuple(x) for x in got] == [(1001, 15000), (50_000_001, None), (5_000_001, None), (250, 250), (None, None)]
    names = {"Apple Inc. (OLD) (AAPL)": "AAPL", "MRSH - Marsh & McLennan": "MRSH", "NVDA CALL": "NVDA", "SPYM": "SPYM", "Corporate Bond (571903BM4)": None, "Plain name": None}
    assert {k: one(x=sc.ticker_in_name(lit(k))).x for k in names} == names
    assert one(x=sc.listed_name(lit("Alford, Hon.. Mark")), y=sc.full_name(lit("RICHARD "), lit("BLUMENTHAL"))) == ("Hon. Mark Alford", "Richard Blumenthal")
    assert one(x=sc.business_days(lit("2026-03-06").cast("date"), lit("2026-03-09").cast("date"))).x == 1
    assert one(x=sc.rule_text(lit("stop_target(stop=0.08, target=None)"))).x == "stop 8% below entry"


def test_merge_is_idempotent(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x"), ("b", None, "y")], "k string, v int, w string")
    new = spark.createDataFrame([("b", 5, None), ("c", 7, "z"), ("a", 9, "q")], "k string, v int, w string")
    once = merge.merge(old, new, ["k"], {"v": "first", "w": "fill"})
    assert sorted(map(tuple, once.collect())) == [("a", 1, "q"), ("b", 5, "y"), ("c", 7, "z")]
    assert sorted(map(tuple, merge.merge(once, new, ["k"], {"v": "first", "w": "fill"}).collect())) == sorted(map(tuple, once.collect()))
    path = str(tmp_path / "t")
    merge.replace_table(spark, old, path)
    merge.replace_table(spark, merge.merge(spark.read.parquet(path), new, ["k"]), path)
    assert spark.read.parquet(path).count() == 3
    assert merge.merge(old, new, ["k"], delete_missing=True).count() == 3


def test_readers(spark, tmp_path):
    (tmp_path / "i.xml").write_text("<L><Member><Prefix>Hon.</Prefix><Last>Roe</Last><First>Jane</First><Suffix/><FilingType>P</FilingType><StateDst>OH04</StateDst><Year>2026</Year><FilingDate>1/5/2026</FilingDate><DocID>20001</DocID></Member><Member><Last>No</Last><FilingType>C</FilingType><DocID>3</DocID></Member></L>")
    r = src.house_index(spark, str(tmp_path / "i.xml")).collect()
    assert [(x.doc_id, x.filer_name, x.filing_date, x.doc_format) for x in r] == [("20001", "Hon. Jane Roe", date(2026, 1, 5), "electronic")]
    (tmp_path / "s.html").write_text('<table><tr><td data-label="Name"><a href="/ptr-pdfs/2026/20007.pdf">Roe, Hon.. Jane</a></td><td data-label="Office">OH04</td><td data-label="Filing">PTR Original</td></tr><tr><td data-label="Name"><a href="/x/1.pdf">A</a></td><td data-label="Filing">FD</td></tr></table>')
    assert [tuple(x) for x in src.house_search(spark, str(tmp_path / "s.html")).collect()] == [("20007", 2026, "Hon. Jane Roe", "OH04")]
    (tmp_path / "s.json").write_text('[["RON ", "DOE", "x", "<a href=\\"/search/view/PTR/008809fb-0861-4493-ba69-6520d89fd4ac/\\">Report  for</a>", "03/02/2026"], ["short"]]')
    assert [tuple(x) for x in src.senate_search(spark, str(tmp_path / "s.json")).collect()] == [("008809fb-0861-4493-ba69-6520d89fd4ac", "ptr", "Ron Doe", date(2026, 3, 2), "Report for")]
    (tmp_path / "r.html").write_text(
        "<table><tr><th>x</th></tr></table><table><tr><th>#</th><th>Transaction Date</th><th>Owner</th><th>Ticker</th><th>Asset Name</th><th>Asset Type</th><th>Type</th><th>Amount</th><th>Comment</th></tr>"
        "<tr><td>2</td><td>03/01/2026</td><td>Spouse</td><td>--</td><td>NVDA CALL</td><td>Stock</td><td>Purchase</td><td>$1,001 - $15,000</td><td>--</td></tr></table>"
    )
    r = src.normalized(src.report_rows(spark, str(tmp_path / "r.html"))).first()
    assert (r.line_no, r.owner, r.ticker, r.asset_type, r.action, r.amount_max, r.description) == (2, "spouse", "NVDA", "option", "BUY", 15000, None)
    (tmp_path / "n.txt").write_text("Symbol|Security Name|Test Issue|ETF\nAAPL|Apple|N|N\nZZT|Test|Y|N\nFile Creation Time: 1||\n")
    (tmp_path / "o.txt").write_text("ACT Symbol|Security Name|ETF|Test Issue\nSPY|Fund|Y|N\nFile Creation Time: 1||\n")
    assert sorted(map(tuple, src.listed_symbols(spark, str(tmp_path / "n.txt"), str(tmp_path / "o.txt")).collect())) == [("AAPL", False), ("SPY", True)]
    (tmp_path / "c.yaml").write_text("SSAF:\n- name: A\n  title: Chair\n  bioguide: B1\nSSAF13:\n- name: A\n  bioguide: B1\n- name: C\n  title: Chair\n  bioguide: B2\n")
    assert sorted(map(tuple, src.committee_seats(spark, str(tmp_path / "c.yaml"), 119).collect())) == [("B1", 119, "SSAF", "Chair"), ("B2", 119, "SSAF", None)]
    with pytest.raises(ValueError):
        src.read_only(spark, "DROP TABLE x")
    assert src.read_only(spark, "SELECT 1 AS a;").count() == 1


def test_streams(spark, tmp_path):
    from quillfin.streaming import arrivals as ar

    folder = str(tmp_path / "in")
    schema = "doc_id string, source string, seen_at timestamp, filer_name string, trade_id long"
    rows = [("a", "index", datetime(2026, 1, 2), None, 1), ("a", "search", datetime(2026, 1, 1), "N", 1), ("b", "index", datetime(2026, 1, 3), "M", 2)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    table = str(tmp_path / "t")
    rules = {"seen_at": "first", "filer_name": "fill"}
    for k in range(2):  # a run on the same input again changes nothing
        ar.upsert_into(spark, stream, table, ["doc_id"], rules, str(tmp_path / f"c{k}"), "doc_id string, source string, seen_at timestamp, filer_name string, trade_id long").awaitTermination()
        assert sorted((r.doc_id, r.seen_at.day, r.filer_name) for r in spark.read.parquet(table).collect()) == [("a", 1, "N"), ("b", 3, "M")]
    log = str(tmp_path / "log")
    for k in range(2):
        ar.alerts(stream, log, str(tmp_path / f"d{k}"), "2026-01-01 00:00:00").awaitTermination()
        assert sorted(r.trade_id for r in spark.read.parquet(log).collect()) == [1, 2]
    query = ar.first_seen(stream).writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "e")).start()
    query.awaitTermination()
    assert spark.table("seen").count() == 2


def test_calendar_numbers(spark):
    got = trading_days(bars(spark, {}, 5)).orderBy("i").collect()
    assert [(r.i, r.date) for r in got] == list(enumerate(weekdays(5)))


def test_a_query_reads_its_folder_anew(spark, sf, tmp_path):
    """Nothing is kept from one call to the next: half of the orders gone is seen."""
    from __spark_entry__ import queries

    for name in ("orders", "lineitem", "supplier"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    scope = queries()["p01_trades_in_scope"]
    before = scope(spark, str(tmp_path)).count()
    half = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 2 = 0")
    half.write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    assert 0 < scope(spark, str(tmp_path)).count() < before


@pytest.mark.parametrize("age", [1, 100])
def test_a_lot_counts_at_its_last_close_however_old(spark, age):
    """A symbol without a close since ``age`` days before the purchase."""
    trade = [("b", 1, "F1", "X", 200, 202, "close", 10.0, 10.0)]
    trades = spark.createDataFrame(trade, "book string, trade_id long, doc_id string, symbol string, d0 int, exit_i int, exit_at string, exit_net double, entry_net double")
    bars = spark.createDataFrame([("X", 200 - age, 10.0)], "symbol string, i int, c double")
    days = bt.ledger(trades, bars, capital=100.0, size=0.5).where("kind = 'day'").orderBy("i").collect()
    assert [round(r.equity, 6) for r in days] == [100.0, 100.0, 100.0]
