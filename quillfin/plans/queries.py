"""Queries by name, each with its statement for the oracle engine where one exists."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.tolerant import summary_of
from ..operators import exits as ex
from ..operators import matching, merge
from ..operators.asof import asof
from ..operators.calendar import trading_days, with_entry
from ..operators.numbering import batches, numbered, stalest
from ..operators.snapshots import Versioned
from ..session import near, shared, written
from ..sources import printed, remote
from ..sources.fixture import Fixture
from ..streaming.watch import replayed
from . import backtest as bt
from . import decisions as dn
from . import facts as ft
from . import outcomes as oc
from . import positions as ps
from . import rankings as rk
from . import reads as rd
from . import reports as rp
from . import weekly as wk
from .oracles import COPY, H, K, shrunk, sql

REGISTRY: dict[str, tuple[Callable[[Fixture], DataFrame], str | None]] = {}
ATTENTION = ["M1", "M2", "M3"]


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[Fixture], DataFrame]):
        REGISTRY[name] = (f, oracle)
        return f

    return add


def r6(*names: str):
    """Doubles rounded to 6 digits, under their names."""
    return [F.round(n, 6).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def outcomes_of(fx: Fixture) -> DataFrame:
    return fx.keep("outcomes", lambda: oc.compute(fx["trades"], fx["filings"], fx["prices"]))


def outcomes_once(fx: Fixture, *also: str) -> DataFrame:
    """Outcomes for a query that reads them once, with these columns of the trades: not written, and only the columns read are made."""
    return oc.compute(fx["trades"], fx["filings"], fx["prices"], also=also)


def inflation_of(fx: Fixture, median: bool = True) -> DataFrame:
    return rk.inflation_stats(rk.inflation_groups(outcomes_once(fx, "mcap_bucket"), None, ATTENTION), median)


def factors_of(fx: Fixture) -> DataFrame:
    return rk.signal_factors(outcomes_once(fx, *rk.LEVELS_OF))


def days_of(fx: Fixture) -> DataFrame:
    return fx.keep("days", lambda: trading_days(fx["prices"]))


@query("n03_trading_calendar", "SELECT date, i FROM cal")
def _(fx):
    return trading_days(fx["prices"])


@query("p01_trades_in_scope", "SELECT trade_id, doc_id, symbol, moment AS available_at, copyable FROM scope")
def _(fx):
    return oc.in_scope(fx["trades"], fx["filings"]).select("trade_id", "doc_id", "symbol", F.col("available_at").cast("timestamp_ntz").alias("available_at"), oc.copyable().alias("copyable"))


@query("d02_entry_day", "SELECT trade_id, d0, d0_date FROM ent")
def _(fx):
    return with_entry(oc.in_scope(fx["trades"], fx["filings"]), trading_days(fx["prices"])).select("trade_id", "d0", "d0_date")


@query(
    "d04_trade_outcomes",
    "SELECT trade_id, d0_date, complete, copyable, " + s6("d0_open", *(f"{c}_{h}" for h in H for c in ("ret", "abn_ret")), "tx_ret", "tx_abn_ret") + ", " + ", ".join(f"win_{h}" for h in H) + " FROM outcomes",
)
def _(fx):
    return oc.compute(fx["trades"], fx["filings"], fx["prices"]).select("trade_id", "d0_date", "complete", "copyable", *r6("d0_open", *(f"{c}_{h}" for h in H for c in ("ret", "abn_ret")), "tx_ret", "tx_abn_ret"), *(f"win_{h}" for h in H))


@query("d09_open_inflation", "SELECT trade_id, " + s6(*(f"open_infl_{k}" for k in K)) + " FROM outcomes")
def _(fx):
    return outcomes_once(fx).select("trade_id", *r6(*(f"open_infl_{k}" for k in K)))


@query("d10_open_inflation_stats", "SELECT group_type, group_key, k, n, CAST(n_trades AS BIGINT) AS n_trades, " + s6("mean", "median", "share_pos", "shrunk_mean") + " FROM infl_stats")
def _(fx):
    return inflation_of(fx).select("group_type", "group_key", "k", "n", "n_trades", *r6("mean", "median", "share_pos", "shrunk_mean"))


@query("d11_entry_delays", "SELECT group_type, group_key, n, CAST(n_trades AS BIGINT) AS n_trades, best_k, " + s6("gain") + " FROM delays")
def _(fx):
    return rk.entry_delays(inflation_of(fx, median=False)).select("group_type", "group_key", "n", "n_trades", "best_k", *r6("gain"))


MEMBER = ("mean_ret", "mean_spy_ret", "median_abn_ret", "hit_rate", "shrunk_score")


@query("a01_filing_means", "SELECT horizon, member_id, doc_id, n_trades, " + s6("ret", "abn") + " FROM per_filing")
def _(fx):
    return rk.filing_means(outcomes_once(fx)).select("horizon", "member_id", "doc_id", "n_trades", *r6("ret", "abn"))


@query("d12_member_horizon_stats", "SELECT horizon, member_id, n_filings, CAST(n_trades AS BIGINT) AS n_trades, " + s6(*MEMBER) + ", round(mean_ret - mean_spy_ret, 6) AS mean_abn_ret FROM member_stats")
def _(fx):
    return rk.member_horizon_stats(outcomes_once(fx)).select("horizon", "member_id", "n_filings", "n_trades", *r6(*MEMBER, "mean_abn_ret"))


@query("d13_member_scores", "SELECT member_id, n_filings, CAST(n_trades AS BIGINT) AS n_trades, rank, " + s6(*MEMBER, "mean_abn_ret", "consistency") + " FROM scores")
def _(fx):
    return rk.member_scores(outcomes_of(fx)).select("member_id", "n_filings", "n_trades", "rank", *r6(*MEMBER, "mean_abn_ret", "consistency"))


@query("a06_clip_bounds", "SELECT horizon, " + s6("low", "high") + " FROM cut")
def _(fx):
    from ..functions.stats import clip_bounds

    return clip_bounds(rk.filing_means(outcomes_once(fx)), "abn", ["horizon"]).select("horizon", *r6("low", "high"))


@query("d15_signal_factors", "SELECT factor, level, n, CAST(n_trades AS BIGINT) AS n_trades, " + s6("mean", "shrunk") + ", round(shrunk - pooled, 6) AS effect FROM factors")
def _(fx):
    return factors_of(fx).select("factor", "level", "n", "n_trades", *r6("mean", "shrunk", "effect"))


# --- exits and books


def signals_of(fx: Fixture) -> tuple[DataFrame, DataFrame]:
    """(signals, days of sales)."""
    kept = ["trade_id", "doc_id", "member_id", "symbol", "action", "mcap_bucket", oc.copyable().alias("copyable"), "d0", "d0_date"]
    entries = fx.keep("entries", lambda: with_entry(oc.in_scope(fx["trades"], fx["filings"]), days_of(fx)).select(*kept).where("copyable or action <> 'BUY'"))
    return fx.keep("signals", lambda: ex.signals(entries)), ex.sale_days(entries)


#: The grid, then a hold of one day.
RULES = (*ex.GRID, ex.Rule("fixed_hold", 1))


def grid_of(fx: Fixture) -> tuple[DataFrame, DataFrame]:
    """(signals, starts) with the exits under ``RULES``."""
    sig, sales = signals_of(fx)
    own, starts = bt.packed_grid(sig, sales, fx["prices"], RULES)
    return written(own), near(written(starts))


def hold_20_of(fx: Fixture) -> DataFrame:
    sig, sales = signals_of(fx)
    return fx.keep("hold_20", lambda: bt.evaluate_rules(sig, sales, fx["prices"], (ex.Rule("fixed_hold", 20),)))


SIM = """, sig AS (SELECT trade_id, symbol, d0 FROM (SELECT o.*, row_number() OVER (PARTITION BY doc_id, symbol ORDER BY d0, trade_id) AS rn FROM outcomes o WHERE copyable) WHERE rn = 1),
ser AS (SELECT symbol, i, CASE WHEN ok THEN open * adj_close / close END AS o, CASE WHEN adj_close > 0 THEN adj_close END AS c,
  CASE WHEN ok THEN greatest(high * (adj_close / close), open * adj_close / close, adj_close) END AS h, CASE WHEN ok THEN least(low * (adj_close / close), open * adj_close / close, adj_close) END AS l
  FROM (SELECT p.*, cal.i, coalesce(p.open > 0 AND p.close > 0 AND p.adj_close > 0, false) AS ok FROM prices p JOIN cal USING (date))),
ends AS (SELECT symbol, max(i) AS last, arg_max(c, i) AS last_c FROM ser WHERE c IS NOT NULL GROUP BY symbol),
path AS (SELECT g.trade_id, g.d0, g.symbol, b.i, b.o, b.h, b.l, b.c, e.o AS entry,
    greatest(e.o, max(b.h) OVER (PARTITION BY g.trade_id ORDER BY b.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS high
  FROM sig g JOIN ser e ON e.symbol = g.symbol AND e.i = g.d0 AND e.o IS NOT NULL JOIN ser b ON b.symbol = g.symbol AND b.c IS NOT NULL AND b.i BETWEEN g.d0 AND g.d0 + {hold} + 250),
lvl AS (SELECT *, {stop} AS stop, {target} AS target FROM path),
act AS (SELECT *, CASE WHEN i > d0 + {hold} THEN 'hold' WHEN i > d0 AND o <= stop THEN 'stop' WHEN i > d0 AND o >= target THEN 'target' WHEN l <= stop THEN 'stop' WHEN h >= target THEN 'target' WHEN i >= d0 + {hold} THEN 'hold' END AS reason,
   CASE WHEN i > d0 + {hold} THEN CASE WHEN o IS NULL THEN 'close' ELSE 'open' END WHEN i > d0 AND (o <= stop OR o >= target) THEN 'open' WHEN l <= stop OR h >= target THEN 'intraday' ELSE 'close' END AS exit_at,
   CASE WHEN i > d0 + {hold} THEN coalesce(o, c) WHEN i > d0 AND (o <= stop OR o >= target) THEN o WHEN l <= stop THEN stop WHEN h >= target THEN target ELSE c END AS price FROM lvl),
hit AS (SELECT trade_id, any_value(symbol) AS symbol, any_value(entry) AS entry, arg_min(i, i) FILTER (reason IS NOT NULL) AS exit_i, arg_min(price, i) FILTER (reason IS NOT NULL) AS price, arg_min(exit_at, i) FILTER (reason IS NOT NULL) AS exit_at, arg_min(reason, i) FILTER (reason IS NOT NULL) AS reason FROM act GROUP BY trade_id)
SELECT trade_id, round(entry, 6) AS entry, CAST(coalesce(exit_i, CASE WHEN last < n - 1 THEN last ELSE n - 1 END) AS INT) AS exit_i, round(coalesce(price, last_c), 6) AS exit_price, coalesce(exit_at, 'close') AS exit_at,
  coalesce(reason, CASE WHEN last < n - 1 THEN 'data_end' ELSE 'open' END) AS reason FROM hit JOIN ends USING (symbol), (SELECT count(*) AS n FROM cal)"""


def simulated(rule):
    def run(fx):
        sig, sales = signals_of(fx)
        days = days_of(fx)
        bars = ex.series(fx["prices"], days)
        n_days = int(days.agg(F.max("i")).first()[0]) + 1
        return ex.simulate(ex.next_sale(sig, sales) if rule.kind == "member_sale" else sig, bars, rule, n_days).select("trade_id", *r6("entry"), "exit_i", *r6("exit_price"), "exit_at", "reason")

    return run


NONE = "CAST(NULL AS DOUBLE)"
query("d22_exit_fixed_hold", SIM.format(hold=20, stop=NONE, target=NONE))(simulated(ex.Rule("fixed_hold", 20)))
query("d22_exit_stop_target", SIM.format(hold=60, stop="entry * (1 - 0.08::DOUBLE)", target="entry * (1 + 0.2::DOUBLE)"))(simulated(ex.Rule("stop_target", stop=0.08, target=0.2)))
query("d22_exit_trailing_stop", SIM.format(hold=60, stop="coalesce(high, entry) * (1 - 0.1::DOUBLE)", target=NONE))(simulated(ex.Rule("trailing_stop", pct=0.1)))
#: True ranges: mean of the last 14 with close and high before the entry day.
ATR = """, tr AS (SELECT symbol, i, greatest(h, p) - least(l, p) AS tr, row_number() OVER (PARTITION BY symbol ORDER BY i) AS k FROM (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY i) AS p FROM ser WHERE c IS NOT NULL AND h IS NOT NULL)),
atr AS (SELECT symbol, i, CASE WHEN k > 14 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END AS atr FROM tr),
lvl0 AS (SELECT p.*, a.atr FROM path p LEFT JOIN (SELECT g.trade_id, a.atr FROM sig g ASOF LEFT JOIN atr a ON a.symbol = g.symbol AND a.i < g.d0) a USING (trade_id)),"""
SIM_ATR = SIM.replace("lvl AS (SELECT *,", ATR.removeprefix(", ") + "\nlvl AS (SELECT *,").replace("FROM path),\nact", "FROM lvl0),\nact")
query("d22_exit_atr_stop", SIM_ATR.format(hold=60, stop="coalesce(high, entry) - 3 * atr", target=NONE))(simulated(ex.Rule("atr_stop", mult=3)))
SALES = """, own AS (SELECT o.trade_id, o.symbol, o.member_id, o.d0 FROM outcomes o JOIN (SELECT trade_id FROM (SELECT o.*, row_number() OVER (PARTITION BY doc_id, symbol ORDER BY d0, trade_id) AS rn FROM outcomes o WHERE copyable) WHERE rn = 1) USING (trade_id)),
sold AS (SELECT DISTINCT member_id, symbol, d0 AS s FROM ent WHERE action IN ('SELL', 'SELL_PARTIAL') AND member_id IS NOT NULL),
due AS (SELECT g.trade_id, min(s.s) AS sale FROM own g JOIN sold s ON s.member_id = g.member_id AND s.symbol = g.symbol AND s.s > g.d0 GROUP BY g.trade_id),
lim AS (SELECT g.trade_id, least(g.d0 + 60, coalesce(sale, 1000000)) AS fin, sale FROM own g LEFT JOIN due USING (trade_id)),"""
SIM_SALE = (
    SIM.replace("lvl AS (SELECT *,", SALES.removeprefix(", ") + "\nlvl AS (SELECT path.*, lim.fin, lim.sale,").replace("FROM path),\nact", "FROM path JOIN lim USING (trade_id)),\nact")
    .replace("CASE WHEN i > d0 + {hold} THEN 'hold' WHEN", "CASE WHEN i > fin OR i = sale THEN CASE WHEN fin = sale THEN 'sale' ELSE 'hold' END WHEN")
    .replace("CASE WHEN i > d0 + {hold} THEN CASE", "CASE WHEN i > fin OR i = sale THEN CASE").replace("CASE WHEN i > d0 + {hold} THEN coalesce", "CASE WHEN i > fin OR i = sale THEN coalesce")
)
query("d22_exit_member_sale", SIM_SALE.format(hold=60, stop=NONE, target=NONE))(simulated(ex.Rule("member_sale")))


COST = """, res AS (SELECT trade_id, entry * (1 + slip) AS entry_net, exit_price * (1 - slip) AS exit_net, exit_i, reason, (CASE exit_at WHEN 'open' THEN x.o ELSE x.c END) / e.o - 1 AS spy
  FROM ({sim}) r JOIN (SELECT trade_id, symbol, d0 FROM sig) g USING (trade_id) JOIN (SELECT trade_id, CASE mcap_bucket WHEN 'mega' THEN 5 WHEN 'large' THEN 10 WHEN 'mid' THEN 20 WHEN 'small' THEN 40 ELSE 75 END / 10000::DOUBLE AS slip FROM trades) t USING (trade_id)
  LEFT JOIN ser e ON e.symbol = 'SPY' AND e.i = g.d0 LEFT JOIN ser x ON x.symbol = 'SPY' AND x.i = r.exit_i)
SELECT trade_id, exit_i, reason, round(entry_net, 6) AS entry_net, round(exit_net, 6) AS exit_net, round(exit_net / entry_net - 1, 6) AS ret, round(exit_net / entry_net - 1 - spy, 6) AS abn FROM res"""
HOLD_20 = SIM.format(hold=20, stop=NONE, target=NONE)
_cut = HOLD_20.index("\nSELECT trade_id, round(entry, 6)")


@query("d25_evaluated_hold", HOLD_20[:_cut] + COST.format(sim=HOLD_20[_cut:].replace("round(entry, 6) AS entry", "entry").replace("round(coalesce(price, last_c), 6)", "coalesce(price, last_c)")))
def _(fx):
    return hold_20_of(fx).select("trade_id", "exit_i", "reason", *r6("entry_net", "exit_net", "ret", "abn"))


QUARTERS = """SELECT CAST(date_trunc('quarter', date) AS DATE) AS q, min(i) AS start, max(i) AS "end", min(date) AS start_date, CAST(min(date) - INTERVAL 24 MONTH AS DATE) >= (SELECT min(date) FROM cal) AND max(i) + 60 < (SELECT count(*) FROM cal) AS is_test FROM cal GROUP BY 1"""


@query("d29_quarters", f'SELECT q, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end", start_date, is_test FROM ({QUARTERS})')
def _(fx):
    return bt.quarters(days_of(fx))


@query("d27_ledger_hold_20")
def _(fx):
    trades = hold_20_of(fx).withColumn("book", F.lit("hold_20"))
    return bt.ledger(trades, ex.series(fx["prices"], days_of(fx))).select("book", "kind", "i", "trade_id", *r6("amount", "equity", "drawdown"))


@query("d26_ranked_universe", f""", qs AS (SELECT q, c.date AS cut FROM ({QUARTERS}) s JOIN cal c ON c.i = s.start - 20 WHERE s.start > 20),
per AS (SELECT q, member_id, doc_id, avg(abn) AS abn FROM matured m JOIN qs ON m.d0_date < qs.cut WHERE horizon = 20 AND member_id IS NOT NULL GROUP BY ALL),
b AS (SELECT q, max(CASE WHEN r = CAST(round_even(0.01::DOUBLE * (n - 1), 0) AS BIGINT) THEN abn END) AS low, max(CASE WHEN r = CAST(round_even(0.99::DOUBLE * (n - 1), 0) AS BIGINT) THEN abn END) AS high
  FROM (SELECT q, abn, row_number() OVER (PARTITION BY q ORDER BY abn) - 1 AS r, count(*) OVER (PARTITION BY q) AS n FROM per) GROUP BY q),
g AS (SELECT q, member_id, count(*) AS n, avg(least(greatest(abn, low), high)) AS m, coalesce(var_samp(least(greatest(abn, low), high)), 0) AS v FROM per JOIN b USING (q) GROUP BY q, member_id),
z AS ({shrunk("g", "q", "n", "m", "v", "score")}) SELECT q, member_id FROM z WHERE n >= 20 AND score > 0""")
def _(fx):
    days = days_of(fx)
    return bt.ranked_universe(outcomes_once(fx), bt.quarters(days), days)


def books_of(fx: Fixture) -> DataFrame:
    def make():
        own, starts = grid_of(fx)
        days = days_of(fx)
        q = bt.quarters(days)
        stats, firsts, _ = bt.walk_forward(own, starts, q, RULES)
        events = written(bt.fold(written(firsts), ex.series(fx["prices"], days)))
        return bt.book_rows(stats, events, q)

    return fx.keep("books", make)


@query("d31_walk_forward_books")
def _(fx):
    return books_of(fx).select("book", "q", "n_filings", *r6("mean_ret", "mean_abn_ret", "hit_rate", "max_drawdown", "total_return"), "skipped_cash")


@query("d53_exit_report")
def _(fx):
    return ft.exit_report(books_of(fx)).select("book", "n_filings", *r6("mean_abn_ret"), "beaten", "confidence")


@query("d34_engine_self_check", "SELECT horizon, count(*) AS n, 0::DOUBLE AS max_diff FROM matured GROUP BY horizon")
def _(fx):
    return bt.self_check(outcomes_of(fx), fx["prices"])


# --- read endpoints and reports


@query("q01_dashboard_summary", """SELECT (SELECT count(*) FROM filings) AS filings, (SELECT count(*) FROM filings WHERE parse_status = 'needs_review') AS needs_review, (SELECT max(first_seen_at) FROM filings) AS last_filing_seen_at,
  (SELECT count(*) FROM trades) AS trades, (SELECT count(*) FROM alerts) AS alerts, (SELECT count(*) FROM watchlist WHERE active = 1) AS watchlist, (SELECT count(*) FROM positions WHERE status = 'open') AS open_positions""")
def _(fx):
    return rd.summary(fx["filings"], fx["trades"], fx["alerts"], fx["watchlist"], fx["positions"])


@query("q02_recent_filings", """SELECT doc_id, f.chamber, filing_date, parse_status, doc_format, coalesce(name, filer_name) AS member_name FROM filings f LEFT JOIN members m ON m.member_id = f.member_id
ORDER BY first_seen_at DESC, filing_date DESC, doc_id DESC LIMIT 50""")
def _(fx):
    return rd.recent_filings(fx["filings"], fx["members"])


@query("q03_recent_alerts", """SELECT alert_id, score, ticker, action, amount_min, amount_max, m.name AS member_name FROM alerts a JOIN trades t ON t.trade_id = a.trade_id LEFT JOIN members m ON m.member_id = t.member_id
ORDER BY sent_at DESC, alert_id DESC LIMIT 50""")
def _(fx):
    return rd.recent_alerts(fx["alerts"], fx["trades"], fx["members"])


@query("q04_trades_filtered", """SELECT t.trade_id, ticker, symbol, action, tx_date, disclosure_date, amount_min, coalesce(name, filer_name) AS member_name, party, f.chamber, score
FROM trades t LEFT JOIN members m ON m.member_id = t.member_id LEFT JOIN filings f ON f.doc_id = t.doc_id LEFT JOIN (SELECT trade_id, max(score) AS score FROM alerts GROUP BY trade_id) a ON a.trade_id = t.trade_id
WHERE coalesce(name, filer_name) ILIKE '%member 1%' AND (ticker = 'N7' OR symbol = 'N7') AND action = 'BUY' ORDER BY disclosure_date DESC, t.trade_id DESC LIMIT 100""")
def _(fx):
    return rd.trade_list(fx["trades"], fx["members"], fx["filings"], fx["alerts"], "member 1", "n7", "BUY")


@query("q05_leaderboard", "SELECT s.member_id, CASE WHEN n_filings >= 20 THEN row_number() OVER (PARTITION BY n_filings >= 20 ORDER BY shrunk_score DESC, mean_ret - mean_spy_ret DESC, s.member_id) END AS rank, n_filings, name, chamber, party, round(shrunk_score, 6) AS shrunk_score, round(consistency, 6) AS consistency FROM member_stats s JOIN members m ON m.member_id = s.member_id LEFT JOIN steady c ON c.member_id = s.member_id WHERE horizon = 5")
def _(fx):
    out = outcomes_of(fx)
    return rd.leaderboard(rk.member_horizon_stats(out), rk.member_scores(out), fx["members"], 5).select("member_id", "rank", "n_filings", "name", "chamber", "party", *r6("shrunk_score", "consistency"))


@query("q06_outcome_summary", "SELECT horizon, count(*) AS n_filings, CAST(sum(n) AS BIGINT) AS n_trades, round(avg(r), 6) AS mean_ret, round(avg(s), 6) AS mean_spy_ret, round(avg(r) - avg(s), 6) AS mean_abn_ret, round(avg(CASE WHEN a > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END), 6) AS hit_rate FROM (SELECT horizon, doc_id, count(*) AS n, avg(ret) AS r, avg(ret - abn) AS s, avg(abn) AS a FROM matured GROUP BY ALL) GROUP BY horizon")
def _(fx):
    return rd.outcome_summary(outcomes_of(fx)).select("horizon", "n_filings", "n_trades", *r6("mean_ret", "mean_spy_ret", "mean_abn_ret", "hit_rate"))


@query("q07_outcome_members", "SELECT m.member_id, m.name, count(DISTINCT o.doc_id) AS n_filings FROM outcomes o JOIN members m ON m.member_id = o.member_id WHERE copyable GROUP BY ALL")
def _(fx):
    return rd.outcome_members(outcomes_of(fx), fx["members"])


@query("q08_outcome_trades", "SELECT o.trade_id, t.symbol, t.tx_date, d0_date, coalesce(name, filer_name) AS member_name, available_basis, complete, round(ret_20, 6) AS ret_20 FROM outcomes o JOIN trades t ON t.trade_id = o.trade_id LEFT JOIN members m ON m.member_id = t.member_id LEFT JOIN filings f ON f.doc_id = t.doc_id WHERE copyable ORDER BY d0_date DESC, o.trade_id DESC LIMIT 100")
def _(fx):
    return rd.outcome_trades(outcomes_of(fx), fx["trades"], fx["members"], fx["filings"]).select("trade_id", "symbol", "tx_date", "d0_date", "member_name", "available_basis", "complete", *r6("ret_20"))


@query("q09_open_inflation_table", "SELECT group_type, group_key, d.n, CAST(d.n_trades AS BIGINT) AS n_trades, best_k, m.name, " + ", ".join(f"round(max(CASE WHEN k = {k} THEN mean END), 6) AS mean_{k}" for k in K) + " FROM infl_stats s JOIN delays d USING (group_type, group_key) LEFT JOIN members m ON group_type = 'member' AND m.member_id = group_key GROUP BY ALL")
def _(fx):
    stats = written(inflation_of(fx, median=False))
    return rd.inflation_table(stats, rk.entry_delays(stats), fx["members"]).select("group_type", "group_key", "n", "n_trades", "best_k", "name", *r6(*(f"mean_{k}" for k in K)))


@query("q11_trade_prices", """SELECT s.date, round(s.close, 3) AS spy_close, round(p.open, 3) AS open, round(p.close, 3) AS close FROM prices s LEFT JOIN prices p ON p.date = s.date AND p.symbol = 'N3'
WHERE s.symbol = 'SPY' AND s.date BETWEEN DATE '1998-03-02' - 10 AND DATE '1998-05-01' + 95""")
def _(fx):
    return rd.trade_prices(fx["prices"], "N3", "1998-03-02", "1998-05-01").select("date", *(F.round(c, 3).alias(c) for c in ("spy_close", "open", "close")))


@query("q12_members_watched", "SELECT m.member_id, name, chamber, party, state, coalesce(w.active, 0) AS watched FROM members m LEFT JOIN watchlist w ON w.member_id = m.member_id WHERE m.active = 1")
def _(fx):
    return rd.members_watched(fx["members"], fx["watchlist"])


@query("q13_watchlist", "SELECT w.member_id, reason, name, chamber, party FROM watchlist w JOIN members m ON m.member_id = w.member_id WHERE w.active = 1")
def _(fx):
    return rd.watched(fx["watchlist"], fx["members"])


VALUED = """, cl AS (SELECT * FROM prices WHERE close IS NOT NULL), spyc AS (SELECT * FROM cl WHERE symbol = 'SPY'),
fst AS (SELECT p.*, f.date AS first_date, f.close AS first_close, coalesce(abs(f.close / buy_price - 1) > 0.4::DOUBLE, false) AS split FROM positions p ASOF LEFT JOIN cl f ON f.symbol = p.ticker AND f.date >= p.buy_date),
lst AS (SELECT symbol, arg_max(close, date) AS last_close, max(date) AS last_date FROM cl GROUP BY symbol),
now_ AS (SELECT f.*, CASE WHEN status = 'open' THEN CASE WHEN NOT split AND first_date IS NOT NULL THEN last_close END ELSE sell_price END AS price, CASE WHEN status = 'open' THEN CASE WHEN NOT split AND first_date IS NOT NULL THEN last_date END ELSE sell_date END AS end_date FROM fst f LEFT JOIN lst ON symbol = ticker),
val AS (SELECT n.*, a.close AS si, b.close AS so FROM now_ n ASOF LEFT JOIN spyc a ON a.date <= n.buy_date ASOF LEFT JOIN spyc b ON b.date <= n.end_date)"""


@query("q15_positions_value", VALUED + """, w AS (SELECT v.*, triggered_on, e.reason AS exit_reason, status = 'open' AND triggered_on IS NULL AS watched, regexp_extract(exit_rule, '^([a-z_]+)', 1) AS rule FROM val v LEFT JOIN exit_alerts e ON e.position_id = v.position_id),
later AS (SELECT position_id, max(high) AS high FROM w JOIN prices p ON p.symbol = w.ticker AND p.date > w.first_date GROUP BY position_id),
held AS (SELECT position_id, count(*) AS n FROM w JOIN prices s ON s.symbol = 'SPY' AND s.date > w.buy_date GROUP BY position_id),
tr AS (SELECT symbol, date, greatest(high, pc) - least(low, pc) AS tr, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM cl WHERE high IS NOT NULL)),
atr AS (SELECT symbol, date, CASE WHEN k > 14 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END AS atr FROM tr),
x AS (SELECT w.*, greatest(buy_price, first_close, later.high) AS high, atr.atr, coalesce(held.n, 0) AS days FROM (SELECT w.* FROM w) w ASOF LEFT JOIN atr ON atr.symbol = w.ticker AND atr.date < w.first_date LEFT JOIN later USING (position_id) LEFT JOIN held USING (position_id))
SELECT position_id, status, round(price, 6) AS price, round(price * shares, 4) AS value, round((price - buy_price) * shares, 4) AS pnl, round(price / buy_price - 1, 6) AS ret, round(CASE WHEN price IS NOT NULL THEN so / si - 1 END, 6) AS spy_ret, round(CASE WHEN price IS NOT NULL THEN price / buy_price - 1 - (so / si - 1) END, 6) AS excess,
  split, triggered_on, exit_reason, CASE WHEN watched THEN CAST(days AS INT) END AS days_held, CASE WHEN watched THEN CASE rule WHEN 'fixed_hold' THEN 20 ELSE 60 END END AS max_hold,
  round(CASE WHEN watched THEN CASE rule WHEN 'stop_target' THEN buy_price * (1 - 0.08::DOUBLE) WHEN 'trailing_stop' THEN CASE WHEN NOT split AND first_date IS NOT NULL THEN high END * (1 - 0.1::DOUBLE) WHEN 'atr_stop' THEN CASE WHEN NOT split AND first_date IS NOT NULL THEN high - 3 * atr END END END, 4) AS stop_level,
  round(CASE WHEN watched AND rule = 'stop_target' THEN buy_price * (1 + 0.2::DOUBLE) END, 4) AS target_level FROM x""")
def _(fx):
    rows = ps.rule_status(ps.valued(fx["positions"], fx["prices"]), fx["prices"], fx["exit_alerts"])
    level = lambda c: F.round(c, 4).alias(c)
    return rows.select("position_id", "status", *r6("price"), level("value"), level("pnl"), *r6("ret", "spy_ret", "excess"), "split", "triggered_on", "exit_reason", F.col("days_held").cast("int").alias("days_held"), "max_hold", level("stop_level"), level("target_level"))


@query("a26_portfolio_totals", VALUED + " SELECT round(sum(buy_price * shares), 2) AS cost, round(sum(price * shares), 2) AS value, round(sum((price - buy_price) * shares), 2) AS pnl FROM val WHERE status = 'open' AND price IS NOT NULL")
def _(fx):
    return rd.portfolio_totals(ps.valued(fx["positions"], fx["prices"])).select(*(F.round(c, 2).alias(c) for c in ("cost", "value", "pnl")))


@query("j16_member_sales", """SELECT p.position_id, arg_min(s.doc_id, (coalesce(f.available_at, f.first_seen_at), s.doc_id)) AS doc_id, CAST(min(coalesce(f.available_at, f.first_seen_at)) AS DATE) AS sold_on
FROM positions p JOIN trades src ON src.trade_id = p.trade_id JOIN trades s ON s.member_id = src.member_id AND s.symbol = coalesce(src.symbol, p.ticker) JOIN filings f ON f.doc_id = s.doc_id
WHERE s.action IN ('SELL', 'SELL_PARTIAL') AND CAST(coalesce(f.available_at, f.first_seen_at) AS DATE) >= p.buy_date GROUP BY p.position_id""")
def _(fx):
    return ps.member_sales(fx["positions"], fx["trades"], fx["filings"])


#: The rules that the fixture's positions carry, by their stored labels.
OWN_RULES = {"fixed_hold(days=20)": ex.Rule("fixed_hold", 20), "trailing_stop(pct=0.1)": ex.Rule("trailing_stop", pct=0.1), "stop_target(stop=0.08, target=0.2)": ex.Rule("stop_target", stop=0.08, target=0.2), "atr_stop(mult=3, n=14)": ex.Rule("atr_stop", mult=3, n=14), "member_sale()": ex.Rule("member_sale")}


@query("d35_due_exits")
def _(fx):
    found = ps.due_exits(fx["positions"], fx["trades"], fx["filings"], fx["prices"], OWN_RULES, fx["exit_alerts"])
    return found.select("position_id", "reason", "day", *r6("price", "close"))


@query("a12_review_queue", """SELECT chamber, filing_year, count(*) AS filings, count(*) FILTER (parse_status = 'parsed') AS parsed, count(*) FILTER (parse_status = 'needs_review' AND doc_format = 'scanned') AS scanned,
  count(*) FILTER (parse_status = 'needs_review' AND doc_format <> 'scanned') AS needs_review, count(*) FILTER (parse_status = 'failed') AS failed, count(*) FILTER (parse_status = 'pending') AS pending FROM filings GROUP BY ALL""")
def _(fx):
    return rd.review_queue(fx["filings"])


@query("q20_pipeline_health", """SELECT max(run_id) AS last_run, arg_max(status, run_id) AS last_status, max(run_id) FILTER (status = 'ok') AS last_ok_run,
  count(*) FILTER (status = 'failed' AND run_id > (SELECT coalesce(max(run_id), 0) FROM runs WHERE status = 'ok')) AS failure_streak, count(*) FILTER (started_at >= (SELECT max(started_at) FROM runs) - to_hours(24)) AS runs_24h FROM runs""")
def _(fx):
    return rd.pipeline_health(fx["runs"])


@query("q18_pipeline_runs", "SELECT run_id, status FROM runs ORDER BY run_id DESC LIMIT 50")
def _(fx):
    return fx["runs"].orderBy(F.desc("run_id")).limit(50).select("run_id", "status")


#: By the rule in force since 2007: second Sunday of March to first Sunday of November.
EASTERN = """CASE WHEN {t} >= CAST(make_date(year({t}), 3, 8) + CAST((7 - dayofweek(make_date(year({t}), 3, 8))) % 7 AS INT) AS TIMESTAMP) + to_hours(7)
  AND {t} < CAST(make_date(year({t}), 11, 1) + CAST((7 - dayofweek(make_date(year({t}), 11, 1))) % 7 AS INT) AS TIMESTAMP) + to_hours(6) THEN {t} - to_hours(4) ELSE {t} - to_hours(5) END"""


@query("n08_schedule_gaps", """, g AS (SELECT run_id, started_at, lag(started_at) OVER (ORDER BY started_at, run_id) AS b FROM runs),
m AS (SELECT run_id, epoch_us(started_at) - epoch_us(b) AS us, CASE WHEN dayofweek(CAST(""" + EASTERN.format(t="b") + """ AS DATE)) IN (0, 6) THEN 135 ELSE 45 END AS lim FROM g WHERE b IS NOT NULL)
SELECT run_id, CAST(floor(us / 60000000) AS BIGINT) AS minutes, CAST(lim AS INT) AS "limit" FROM m WHERE floor(us / 60000000) > lim""")
def _(fx):
    return rd.schedule_gaps(fx["runs"])


@query("a21_detection_lag", """, lag AS (SELECT date_diff('day', filing_date, CAST(first_seen_at AS DATE)) AS lag FROM filings WHERE filing_date IS NOT NULL),
o AS (SELECT lag, row_number() OVER (ORDER BY lag) AS r, count(*) OVER () AS n FROM lag)
SELECT max(n) AS n, CAST(max(CASE WHEN r = greatest(1, floor(n * 0.9)) THEN lag END) AS INT) AS p90, round(count(*) FILTER (lag <= 0) / max(n), 6) AS same_day, round(count(*) FILTER (lag <= 1) / max(n), 6) AS next_day FROM o""")
def _(fx):
    return rd.detection_lag(fx["filings"])


@query("a22_alert_latency", """, per AS (SELECT sent_at, min(first_seen_at) AS seen FROM alerts a JOIN trades t ON t.trade_id = a.trade_id JOIN filings f ON f.doc_id = t.doc_id GROUP BY sent_at),
m AS (SELECT date_diff('minute', seen, sent_at) AS m FROM per) SELECT count(*) AS n, median(m) AS median_min, max(m) AS max_min FROM m WHERE m >= 0""")
def _(fx):
    return rd.alert_latency(fx["alerts"], fx["trades"], fx["filings"])


@query("d49_outcome_report", "SELECT year(t.disclosure_date) AS year, count(*) AS rows, count(abn_ret_1) AS priced, count(*) FILTER (complete) AS complete FROM outcomes o JOIN trades t ON t.trade_id = o.trade_id GROUP BY 1")
def _(fx):
    return rd.outcome_report(outcomes_of(fx), fx["trades"])


@query("d49_horizon_report", "SELECT horizon, count(*) AS n, round(avg(abn), 6) AS mean, round(median(abn), 6) AS median, round(avg(CASE WHEN abn > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END), 6) AS hit FROM matured GROUP BY horizon")
def _(fx):
    return rd.horizon_report(outcomes_of(fx)).select("horizon", "n", *r6("mean", "median", "hit"))


NEED = ", need AS (SELECT upper(symbol) AS symbol, greatest(min(least(coalesce(tx_date, disclosure_date), disclosure_date)) - 30, DATE '1995-12-01') AS needed_from, max(disclosure_date) AS needed_to FROM trades WHERE symbol IS NOT NULL GROUP BY 1)"


@query("d37_price_needs", NEED + " SELECT * FROM need")
def _(fx):
    return rd.price_needs(fx["trades"], "1995-12-01")


@query("d39_price_coverage", NEED + """, have AS (SELECT symbol, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows FROM prices WHERE close IS NOT NULL GROUP BY symbol)
SELECT symbol, needed_from, first_date, last_date, coalesce(n_rows, 0) AS n_rows, CASE WHEN n_rows IS NULL THEN 'missing' WHEN first_date > needed_from + 4 OR last_date < needed_to - 7 THEN 'partial' ELSE 'ok' END AS status,
  CASE WHEN n_rows IS NULL THEN 'no prices' WHEN first_date > needed_from + 4 THEN 'starts late' WHEN last_date < needed_to - 7 THEN 'ends early' END AS note FROM need LEFT JOIN have USING (symbol)""")
def _(fx):
    return rd.coverage(rd.price_needs(fx["trades"], "1995-12-01"), fx["prices"])


@query("d38_rebased", """, fresh AS (SELECT symbol, date, close * CASE WHEN symbol IN ('N3', 'N8') THEN 2::DOUBLE ELSE 1::DOUBLE END AS close FROM prices), b AS (SELECT p.symbol, p.date, p.close AS old, f.close AS new FROM prices p JOIN fresh f ON f.symbol = p.symbol AND f.date = p.date)
SELECT b.symbol, coalesce(max(CASE WHEN date < latest AND old > 0 THEN abs(new / old - 1) END), 0) > 0.0005 AS rebased FROM b JOIN (SELECT symbol, max(date) AS latest FROM b GROUP BY symbol) USING (symbol) GROUP BY b.symbol""")
def _(fx):
    p = fx["prices"]
    fresh = p.withColumn("close", p["close"] * F.when(p["symbol"].isin("N3", "N8"), 2.0).otherwise(1.0))
    return rd.rebased(p, fresh)


@query("j05_size_at_disclosure", """, ref AS (SELECT symbol, close AS r FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM prices) WHERE rn = 1), c AS (SELECT t.trade_id, CASE WHEN p.close > 0 AND r > 0 THEN market_cap * p.close / r ELSE market_cap END AS cap FROM (SELECT * FROM trades WHERE symbol IS NOT NULL) t ASOF LEFT JOIN prices p ON p.symbol = t.symbol AND p.date <= t.disclosure_date LEFT JOIN securities s ON s.symbol = t.symbol LEFT JOIN ref ON ref.symbol = t.symbol)
SELECT trade_id, CASE WHEN cap IS NULL THEN NULL WHEN cap >= 200e9 THEN 'mega' WHEN cap >= 10e9 THEN 'large' WHEN cap >= 2e9 THEN 'mid' WHEN cap >= 300e6 THEN 'small' ELSE 'micro' END AS bucket FROM c""")
def _(fx):
    return rd.size_at_disclosure(fx["trades"], fx["prices"], fx["securities"])


@query("j14_committee_relevance", """SELECT trade_id, CASE WHEN EXISTS (SELECT 1 FROM committees c JOIN committee_sectors s ON s.committee_id = c.committee_id WHERE c.member_id = t.member_id AND s.sector = t.sector
  AND c.congress = CAST(floor((year(t.tx_date - 2) - 1789) / 2) + 1 AS INT)) THEN 1 ELSE 0 END AS relevant FROM trades t""")
def _(fx):
    return rd.committee_relevance(fx["trades"], fx["committees"], fx["committee_sectors"])


WATCHED = "(SELECT w.member_id FROM watchlist w JOIN members m ON m.member_id = w.member_id WHERE w.active = 1)"


@query("d41_alert_candidates", f""", live AS (SELECT * FROM filings WHERE first_seen_at >= TIMESTAMP '2000-01-01' AND available_basis = 'seen'),
fresh AS (SELECT t.*, {COPY} AS copy FROM trades t JOIN live f ON f.doc_id = t.doc_id WHERE t.symbol <> '' AND t.member_id IN {WATCHED} AND t.trade_id NOT IN (SELECT trade_id FROM alerts)),
ruled AS (SELECT CASE WHEN copy THEN 'watchlist_buy' WHEN action IN ('SELL', 'SELL_PARTIAL') AND upper(symbol) IN (SELECT upper(ticker) FROM positions WHERE status = 'open') THEN 'held_sale' END AS rule, trade_id, doc_id FROM fresh)
SELECT rule, trade_id, doc_id FROM ruled WHERE rule IS NOT NULL
UNION ALL SELECT 'scanned', NULL, doc_id FROM live WHERE doc_format = 'scanned' AND parse_method IS NULL AND member_id IN {WATCHED} AND doc_id NOT IN (SELECT doc_id FROM filing_alerts)""")
def _(fx):
    return rd.alert_candidates(fx["trades"], fx["filings"], fx["members"], fx["watchlist"], fx["positions"], fx["alerts"], fx["filing_alerts"], "2000-01-01 00:00:00")


@query("d40_watchlist_candidates", """, r AS (SELECT s.*, coalesce(w.active, 0) AS watched FROM scores s LEFT JOIN watchlist w ON w.member_id = s.member_id WHERE rank IS NOT NULL),
k AS (SELECT member_id, CASE WHEN watched = 0 AND rank <= 5 AND shrunk_score >= 0.005 AND hit_rate >= 0.5 THEN 'add' WHEN watched = 1 AND shrunk_score < 0 THEN 'remove' END AS kind FROM r)
SELECT member_id, kind FROM k WHERE kind IS NOT NULL AND NOT EXISTS (SELECT 1 FROM proposals p WHERE p.member_id = k.member_id AND p.kind = k.kind
  AND ((applied_on IS NULL AND (approved IS NULL OR approved = 1)) OR (approved = 0 AND decided_on >= DATE '2001-07-01' - 90)))""")
def _(fx):
    return rd.watchlist_candidates(rk.member_scores(outcomes_of(fx)), fx["watchlist"], fx["proposals"], "2001-07-01")


@query("n11_momentum", """, w AS (SELECT symbol, date, close, lag(close, 20) OVER (PARTITION BY symbol ORDER BY date) AS was FROM prices WHERE close IS NOT NULL) SELECT symbol, round(arg_max(close, date) / arg_max(coalesce(was, -1), date) - 1, 6) AS move FROM w GROUP BY symbol""")
def _(fx):
    return rd.momentum(fx["prices"], 20).select("symbol", *r6("move"))


@query("d16_score_v1", """, p AS (SELECT trade_id, asset_type = 'option' AND lower(coalesce(asset_name, '') || ' ' || coalesce(description, '')) LIKE '%call%' AND lower(coalesce(asset_name, '') || ' ' || coalesce(description, '')) NOT LIKE '%put%' AS call,
  CASE WHEN amount_min >= 500001 THEN 20 WHEN amount_min >= 250001 THEN 16 WHEN amount_min >= 100001 THEN 13 WHEN amount_min >= 50001 THEN 10 WHEN amount_min >= 15001 THEN 5 ELSE 0 END AS a, filing_delay_days AS d,
  CASE WHEN d IS NULL THEN 0 WHEN d <= 7 THEN 15 WHEN d <= 14 THEN 10 WHEN d <= 30 THEN 5 WHEN d <= 45 THEN 0 ELSE -5 END AS s, CASE WHEN ticker_status NOT IN ('listed', 'renamed') THEN -10 WHEN is_etf <> 0 THEN 5 ELSE 15 END AS l FROM trades WHERE action = 'BUY')
SELECT trade_id, CAST(greatest(0, least(100, CASE WHEN call THEN 40 ELSE 50 END + a + s + l)) AS INT) AS score,
  CASE WHEN call THEN 'bought calls (as the stock) 40' ELSE 'buy 50' END || '; amount +' || a || '; ' || CASE WHEN d IS NULL THEN 'delay unknown +0' ELSE 'disclosed after ' || d || 'd ' || CASE WHEN s >= 0 THEN '+' ELSE '' END || s END || '; '
  || CASE l WHEN 5 THEN 'listed ETF +5' WHEN 15 THEN 'listed stock +15' ELSE 'not on NYSE/Nasdaq -10' END AS reasons FROM p""")
def _(fx):
    points, reasons = rk.score_v1()
    return fx["trades"].where("action = 'BUY'").select("trade_id", points.alias("score"), F.array_join(reasons, "; ").alias("reasons"))


@query("d17_score_v2", """SELECT t.trade_id, CAST(greatest(0, least(100, round_even(50 + 1000 * (CASE WHEN s.n_filings >= 20 THEN s.shrunk_score ELSE (SELECT max(shrunk) FROM factors WHERE factor = 'all') END
  + coalesce(a.shrunk - a.pooled, 0) + coalesce(b.shrunk - b.pooled, 0) + coalesce(c.shrunk - c.pooled, 0) + coalesce(d.shrunk - d.pooled, 0) + coalesce(e.shrunk - e.pooled, 0)), 0))) AS INT) AS score
FROM trades t JOIN lev l ON l.trade_id = t.trade_id LEFT JOIN scores s ON s.member_id = t.member_id LEFT JOIN factors a ON a.factor = 'mcap' AND a.level = l.mcap LEFT JOIN factors b ON b.factor = 'delay' AND b.level = l.delay
LEFT JOIN factors c ON c.factor = 'amount' AND c.level = l.amount LEFT JOIN factors d ON d.factor = 'committee' AND d.level = l.committee LEFT JOIN factors e ON e.factor = 'kind' AND e.level = l.kind WHERE t.action = 'BUY'""")
def _(fx):
    out = fx.keep("outcomes_levels", lambda: outcomes_once(fx, *rk.LEVELS_OF))
    return rk.score_v2(fx["trades"].where("action = 'BUY'"), rk.signal_factors(out), rk.member_scores(out)).select("trade_id", "score")


@query("d18_suggested_entry", """, k AS (SELECT * FROM delays WHERE best_k IS NOT NULL) SELECT trade_id, coalesce(m.best_k, c.best_k, a.best_k) AS best_k, coalesce(m.n, c.n, a.n) AS basis_n, coalesce(m.group_type, c.group_type, a.group_type) AS basis
FROM trades t LEFT JOIN k m ON m.group_type = 'member' AND m.group_key = t.member_id LEFT JOIN k c ON c.group_type = 'mcap' AND c.group_key = coalesce(t.mcap_bucket, 'unknown') LEFT JOIN k a ON a.group_type = 'all' WHERE action = 'BUY'""")
def _(fx):
    stats = written(inflation_of(fx, median=False))
    return rk.suggested_entry(fx["trades"].where("action = 'BUY'"), rk.entry_delays(stats)).select("trade_id", "best_k", "basis_n", "basis")



# --- normalisation, resolution, merges, work lists


@query("f01_clean_text", "SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v\\x{a0}]+', ' ', 'g')) AS text FROM documents")
def _(fx):
    return fx["documents"].select("doc_id", sc.clean(F.col("text")).alias("text"))


@query("f02_enum_maps", """SELECT trade_id, CASE action WHEN 'EXCHANGE' THEN 'EXCHANGE' WHEN 'SELL' THEN 'SELL' WHEN 'SELL_PARTIAL' THEN 'SELL_PARTIAL' END AS action,
  CASE trade_id % 5 WHEN 0 THEN 'self' WHEN 1 THEN 'spouse' WHEN 2 THEN 'joint' WHEN 3 THEN 'dependent' END AS owner, CASE asset_type WHEN 'other' THEN 'other' ELSE asset_type END AS kind FROM trades""")
def _(fx):
    t = fx["trades"]
    raw = F.when(t["action"] == "SELL", " Sale (Full) ").when(t["action"] == "SELL_PARTIAL", "S  (partial)").when(t["action"] == "EXCHANGE", "e").otherwise("unknown")
    who = F.element_at(F.array(F.lit(""), F.lit("SP"), F.lit("Joint"), F.lit(" DC "), F.lit("?")), (t["trade_id"] % 5 + 1).cast("int"))
    code = F.when(t["asset_type"] == "stock", "ST").when(t["asset_type"] == "option", "Stock Option").otherwise("GS")
    return t.select("trade_id", sc.action(raw).alias("action"), sc.owner(who).alias("owner"), sc.asset_type(code).alias("kind"))


@query("f04_amount_range", "SELECT trade_id, amount_min + CASE WHEN amount_max IS NULL THEN 1 ELSE 0 END AS low, amount_max AS high FROM trades")
def _(fx):
    t = fx["trades"]
    raw = F.when(t["amount_max"].isNull(), F.concat(F.lit("Over $"), F.format_number("amount_min", 0))).otherwise(F.concat(F.lit("$"), F.format_number("amount_min", 0), F.lit(" -  $"), F.format_number("amount_max", 0)))
    low, high = sc.amount(raw)
    return t.select("trade_id", low.alias("low"), high.alias("high"))


@query("f05_us_dates", "SELECT doc_id, filing_date AS d FROM filings")
def _(fx):
    return fx["filings"].select("doc_id", sc.us_date(F.date_format("filing_date", "M/d/yyyy")).alias("d"))


@query("f06_ticker_in_name", "SELECT trade_id, ticker FROM trades")
def _(fx):
    name = F.when(F.col("trade_id") % 2 == 0, F.concat(F.lit("Old (X) Corp. ("), "ticker", F.lit(")"))).otherwise(F.concat(F.lit("Some Bank ("), "ticker", F.lit(") common")))
    return fx["trades"].select("trade_id", sc.ticker_in_name(name).alias("ticker"))


@query("f13_delay_and_weekdays", """SELECT trade_id, CAST(disclosure_date - tx_date AS INT) AS days,
  CAST((SELECT count(*) FROM range(1, CAST(disclosure_date - tx_date AS BIGINT) + 1) r(k) WHERE dayofweek(tx_date + CAST(k AS INT)) NOT IN (0, 6)) AS INT) AS weekdays FROM trades""")
def _(fx):
    return fx["trades"].select("trade_id", F.datediff("disclosure_date", "tx_date").alias("days"), sc.business_days(F.col("tx_date"), F.col("disclosure_date")).alias("weekdays"))


@query("f14_rule_labels", """, p AS (SELECT position_id, regexp_extract(exit_rule, '^([a-z_]+)', 1) AS rule, regexp_extract(exit_rule, '\\((.*)\\)', 1) AS args, regexp_extract(exit_rule, 'days=([0-9]+)', 1) AS days, regexp_extract(exit_rule, 'mult=([0-9.]+)', 1) AS mult,
  CAST(nullif(regexp_extract(exit_rule, 'pct=([0-9.]+)', 1), '') AS DOUBLE) AS pct, CAST(nullif(regexp_extract(exit_rule, 'stop=([0-9.]+)', 1), '') AS DOUBLE) AS stop, CAST(nullif(regexp_extract(exit_rule, 'target=([0-9.]+)', 1), '') AS DOUBLE) AS target FROM positions)
SELECT position_id, rule, CASE WHEN args <> '' THEN '{"' || replace(replace(replace(args, ' ', ''), '=', '":"'), ',', '","') || '"}' END AS params, CASE rule WHEN 'fixed_hold' THEN 'hold ' || days || ' trading days'
  WHEN 'stop_target' THEN 'stop ' || CAST(round(stop * 100) AS INT) || '% below entry, target ' || CAST(round(target * 100) AS INT) || '% above entry' WHEN 'trailing_stop' THEN 'stop ' || CAST(round(pct * 100) AS INT) || '% below the high' WHEN 'atr_stop' THEN 'stop ' || mult || ' true ranges below the high' ELSE 'sell when the member does' END AS text FROM p""")
def _(fx):
    name, params = sc.rule_parts(F.col("exit_rule"))
    return fx["positions"].select("position_id", name.alias("rule"), F.to_json(params).alias("params"), sc.rule_text(F.col("exit_rule")).alias("text"))


@query("f20_periods", "SELECT doc_id, isoyear(filing_date) || '-W' || lpad(CAST(week(filing_date) AS VARCHAR), 2, '0') AS week, CAST(date_trunc('month', filing_date) AS DATE) AS month_start, last_day(filing_date) AS month_end, year(filing_date) AS year FROM filings")
def _(fx):
    d = F.col("filing_date")
    return fx["filings"].select("doc_id", sc.iso_week(d).alias("week"), F.trunc(d, "month").alias("month_start"), F.last_day(d).alias("month_end"), F.year(d).cast("long").alias("year"))


@query("f08_row_problems", """SELECT trade_id, CASE WHEN trade_id % 7 = 0 THEN 'owner' ELSE '' END || CASE WHEN trade_id % 7 = 0 AND tx_date > disclosure_date - 5 THEN ',' ELSE '' END || CASE WHEN tx_date > disclosure_date - 5 THEN 'tx_date after filing date' ELSE '' END AS problems,
  CASE WHEN trade_id % 7 = 0 OR tx_date > disclosure_date - 5 THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS confidence FROM trades""")
def _(fx):
    t = fx["trades"]
    found = sc.problems(F.when(t["trade_id"] % 7 != 0, "self"), t["action"], t["tx_date"], t["amount_min"], F.date_sub("disclosure_date", 5))
    return t.select("trade_id", F.array_join(found, ",").alias("problems"), sc.confidence(found, F.lit(False)).cast("double").alias("confidence"))


@query("j12_member_resolution", "SELECT 'Hon. A. ' || n_name || ', Jr.' AS filer_name, 'P' || CAST(n_nationkey AS STRING) AS member_id, 'matched' AS status FROM nation UNION ALL SELECT 'Nobody Known', NULL, 'unmatched'")
def _(fx):
    n = fx["nation"].withColumn("st", F.concat(F.lit("S"), F.col("n_regionkey").cast("string")))
    seat = F.concat("st", F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    people = n.select(F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("member_id"), F.col("n_name").alias("last_name"), F.lit("A B").alias("given_names"), F.array(seat).alias("house_seats"), F.array("st").alias("states"), F.lit(False).alias("senator"))
    filers = n.select(F.concat(F.lit("Hon. A. "), "n_name", F.lit(", Jr.")).alias("filer_name"), F.lit("house").alias("chamber"), seat.alias("state_district"))
    filers = filers.unionByName(filers.limit(1).select(F.lit("Nobody Known").alias("filer_name"), "chamber", "state_district"))
    return matching.resolve_members(filers, people).select("filer_name", "member_id", "status")


@query("j13_ticker_resolution", """SELECT trade_id, CASE ticker WHEN 'N20' THEN 'N1' WHEN 'N21' THEN NULL WHEN 'N22' THEN CASE WHEN tx_date < DATE '1998-01-01' THEN 'N2' ELSE 'N22' END ELSE ticker END AS symbol,
  CASE WHEN ticker = 'N20' THEN 'renamed' WHEN ticker = 'N21' THEN 'delisted' WHEN ticker = 'N22' THEN CASE WHEN tx_date < DATE '1998-01-01' THEN 'renamed' ELSE 'unlisted' END WHEN CAST(substr(ticker, 2) AS INT) < 16 THEN 'listed' ELSE 'unlisted' END AS ticker_status,
  CASE WHEN ticker = 'N20' THEN false WHEN ticker = 'N21' THEN false WHEN ticker = 'N22' THEN tx_date < DATE '1998-01-01' ELSE CAST(substr(ticker, 2) AS INT) < 16 AND CAST(substr(ticker, 2) AS INT) % 2 = 0 END AS is_etf FROM trades""")
def _(fx):
    listed = fx["nation"].where("n_nationkey < 16").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("symbol"), (F.col("n_nationkey") % 2 == 0).alias("is_etf"))
    aliases = fx.spark.createDataFrame([("n20", "N1", None), ("N21", "-", None), ("N22", "N2", "1998-01-01")], "old string, new string, until string").withColumn("until", F.col("until").cast("date"))
    return matching.resolve_tickers(fx["trades"], listed, aliases)


@query("j06_last_close_before", "SELECT t.trade_id, p.date AS asof_date FROM (SELECT * FROM trades WHERE symbol IS NOT NULL) t ASOF LEFT JOIN (SELECT * FROM prices WHERE close IS NOT NULL) p ON p.symbol = t.symbol AND p.date <= t.tx_date")
def _(fx):
    t = fx["trades"].where("symbol is not null").select("trade_id", "symbol", "tx_date")
    return asof(t, fx["prices"].where("close is not null"), "symbol", "tx_date", ["close"]).select("trade_id", "asof_date")


@query("j07_first_bar_after", "SELECT t.position_id, p.date AS asof_date, round(p.close, 3) AS close FROM positions t ASOF LEFT JOIN (SELECT * FROM prices WHERE close IS NOT NULL) p ON p.symbol = t.ticker AND p.date >= t.buy_date")
def _(fx):
    t = fx["positions"].select("position_id", F.col("ticker").alias("symbol"), "buy_date")
    return asof(t, fx["prices"].where("close is not null"), "symbol", "buy_date", ["close"], forward=True).select("position_id", "asof_date", F.round("asof_close", 3).alias("close"))


@query("w01_merge_filings", """, n AS (SELECT doc_id, DATE '2002-01-01' AS filing_date, 'New ' || filer_name AS filer_name, parse_method FROM filings WHERE CAST(substr(doc_id, 2) AS BIGINT) % 4 = 0), o AS (SELECT doc_id, CASE WHEN CAST(substr(doc_id, 2) AS BIGINT) % 8 = 0 THEN NULL ELSE filing_date END AS filing_date, filer_name, parse_method FROM filings WHERE CAST(substr(doc_id, 2) AS BIGINT) % 3 > 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.filing_date, n.filing_date) AS filing_date, coalesce(n.filer_name, o.filer_name) AS filer_name, CASE WHEN o.doc_id IS NULL THEN n.parse_method ELSE o.parse_method END AS parse_method FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def _(fx):
    key = F.substring("doc_id", 2, 20).cast("bigint")
    f = fx["filings"].select("doc_id", "filing_date", "filer_name", "parse_method")
    new = f.where(key % 4 == 0).select("doc_id", F.lit("2002-01-01").cast("date").alias("filing_date"), F.concat(F.lit("New "), "filer_name").alias("filer_name"), "parse_method")
    old = f.where(key % 3 > 0).withColumn("filing_date", F.when(key % 8 != 0, F.col("filing_date")))
    return merge.merge(old, new, ["doc_id"], {"filing_date": "first", "filer_name": "fill", "parse_method": "keep"})


@query("w05_drop_stale_rows", "SELECT trade_id FROM trades WHERE NOT (line_no > 3 AND trade_id NOT IN (SELECT trade_id FROM alerts UNION ALL SELECT trade_id FROM positions))")
def _(fx):
    keep = fx["filings"].select("doc_id", F.lit(3).alias("keep"))
    return merge.drop_stale(fx["trades"], keep, fx["alerts"], fx["positions"]).select("trade_id")


@query("u01_priced_symbols", "SELECT DISTINCT upper(symbol) AS symbol FROM (SELECT symbol FROM trades WHERE symbol IS NOT NULL UNION ALL SELECT ticker FROM positions)")
def _(fx):
    return fx["trades"].where("symbol is not null").select(F.upper("symbol").alias("symbol")).union(fx["positions"].select(F.upper("ticker"))).distinct()


@query("u03_symbols_without_prices", "SELECT DISTINCT symbol FROM trades WHERE symbol IS NOT NULL AND symbol NOT IN (SELECT symbol FROM prices WHERE date < DATE '1995-01-10')")
def _(fx):
    early = fx["prices"].where(F.col("date") < F.lit("1995-01-10").cast("date")).select("symbol")
    return fx["trades"].where("symbol is not null").select("symbol").distinct().join(early, "symbol", "left_anti")


@query("t07_reading_queue", """, c AS (SELECT doc_id, first_seen_at, CASE WHEN first_seen_at >= TIMESTAMP '2001-06-01' THEN 'live' ELSE 'backlog' END AS class FROM filings WHERE doc_format = 'scanned' AND parse_status IN ('pending', 'needs_review')),
r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY first_seen_at DESC, doc_id DESC) AS rn FROM c) SELECT doc_id, class FROM r WHERE rn <= CASE class WHEN 'live' THEN 5 ELSE 3 END""")
def _(fx):
    from pyspark.sql import Window

    c = fx["filings"].where((F.col("doc_format") == "scanned") & F.col("parse_status").isin("pending", "needs_review"))
    c = c.withColumn("class", F.when(F.col("first_seen_at") >= F.lit("2001-06-01").cast("timestamp_ntz"), "live").otherwise("backlog"))
    rn = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("first_seen_at"), F.desc("doc_id")))
    return c.withColumn("rn", rn).where(F.col("rn") <= F.when(F.col("class") == "live", 5).otherwise(3)).select("doc_id", "class")


@query("t10_gaps_most_traded", "SELECT symbol, count(*) AS n_trades FROM trades WHERE symbol IS NOT NULL AND ticker_status = 'unlisted' GROUP BY symbol ORDER BY n_trades DESC, symbol LIMIT 10")
def _(fx):
    return fx["trades"].where("symbol is not null and ticker_status = 'unlisted'").groupBy("symbol").agg(F.count("*").alias("n_trades")).orderBy(F.desc("n_trades"), "symbol").limit(10)


@query("a14_symbols_per_filing", "SELECT doc_id, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols, max(CASE WHEN trade_id IN (SELECT trade_id FROM alerts) THEN 1 ELSE 0 END) AS alerted FROM trades WHERE symbol IS NOT NULL GROUP BY doc_id")
def _(fx):
    marked = fx["trades"].where("symbol is not null").join(fx["alerts"].select("trade_id", F.lit(1).alias("hit")).distinct(), "trade_id", "left")
    return marked.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("symbol")), ",").alias("symbols"), F.max(F.coalesce("hit", F.lit(0))).alias("alerted"))


@query("a29_enrichment_counts", "SELECT ticker_status, coalesce(mcap_bucket, 'none') AS bucket, count(*) AS n, count(*) FILTER (committee_relevant = 1) AS relevant FROM trades GROUP BY ALL")
def _(fx):
    return fx["trades"].groupBy("ticker_status", F.coalesce("mcap_bucket", F.lit("none")).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("committee_relevant") == 1).alias("relevant"))


@query("p05_trades_without_alert", "SELECT trade_id FROM trades WHERE action = 'BUY' AND NOT EXISTS (SELECT 1 FROM alerts a WHERE a.trade_id = trades.trade_id) AND EXISTS (SELECT 1 FROM watchlist w WHERE w.member_id = trades.member_id AND w.active = 1)")
def _(fx):
    return fx["trades"].where("action = 'BUY'").join(fx["alerts"], "trade_id", "left_anti").join(F.broadcast(fx["watchlist"].where("active = 1")), "member_id", "left_semi").select("trade_id")


@query("d56_filing_status", """SELECT doc_id, CASE WHEN count(*) FILTER (trade_id % 7 = 0) > 0 THEN 'needs_review' ELSE 'parsed' END AS status, count(*) = max(line_no) AS gapless FROM trades GROUP BY doc_id""")
def _(fx):
    return fx["trades"].groupBy("doc_id").agg(F.when(F.count_if(F.col("trade_id") % 7 == 0) > 0, "needs_review").otherwise("parsed").alias("status"), (F.count("*") == F.max("line_no")).alias("gapless"))


@query("d44_outcomes_today", "SELECT trade_id, horizon, round(abn, 6) AS abn FROM matured WHERE d0_date = (SELECT max(d0_date) FROM matured WHERE horizon = 60) ORDER BY abs(abn) DESC, trade_id, horizon LIMIT 5")
def _(fx):
    m = rk.matured(outcomes_of(fx))
    last = m.where("horizon = 60").agg(F.max("d0_date").alias("d0_date"))
    return m.join(F.broadcast(last), "d0_date", "left_semi").orderBy(F.desc(F.abs("abn")), "trade_id", "horizon").limit(5).select("trade_id", "horizon", *r6("abn"))


@query("j18_rank_changes", """, b AS (SELECT member_id, CASE WHEN n_filings >= 20 THEN row_number() OVER (PARTITION BY n_filings >= 20 ORDER BY shrunk_score DESC, mean_ret - mean_spy_ret DESC, member_id) END AS rank FROM member_stats WHERE horizon = 5)
SELECT * FROM (SELECT coalesce(b.member_id, s.member_id) AS member_id, b.rank AS old_rank, s.rank AS new_rank, CASE WHEN b.rank IS NULL THEN 'entered' WHEN s.rank IS NULL THEN 'left' WHEN b.rank <> s.rank THEN 'moved' END AS change
FROM (SELECT * FROM b WHERE rank IS NOT NULL) b FULL JOIN (SELECT * FROM scores WHERE rank IS NOT NULL) s ON s.member_id = b.member_id) WHERE change IS NOT NULL""")
def _(fx):
    out = outcomes_of(fx)
    return rd.snapshot_changes(rk.member_scores(out), rk.member_scores(out, 5))



@query("t09_asset_batches", """, starts AS (SELECT asset_name, min(tx_date) AS start FROM trades GROUP BY asset_name), o AS (SELECT *, row_number() OVER (ORDER BY start, asset_name) AS n FROM starts)
SELECT (n - 1) // 50 AS batch, min(start) AS start, count(*) AS n_assets, string_agg(asset_name, ',' ORDER BY n) AS assets FROM o GROUP BY 1""")
def _(fx):
    starts = fx["trades"].groupBy("asset_name").agg(F.min("tx_date").alias("start"))
    return batches(starts, "asset_name", "start").select("batch", "start", F.size("keys").cast("long").alias("n_assets"), F.array_join("keys", ",").alias("assets"))


@query("t08_stalest_first", """, seen AS (SELECT ticker, max(disclosure_date) AS last FROM trades GROUP BY ticker), d AS (SELECT s.symbol, s.market_cap, seen.last, CASE WHEN market_cap IS NULL THEN 7 ELSE 30 END AS fresh_days FROM securities s LEFT JOIN seen ON seen.ticker = s.symbol)
SELECT symbol, row_number() OVER (ORDER BY last NULLS FIRST, symbol) AS n FROM d WHERE last IS NULL OR last < DATE '2001-12-31' - fresh_days ORDER BY n LIMIT 300""")
def _(fx):
    seen = fx["trades"].groupBy(F.col("ticker").alias("symbol")).agg(F.max("disclosure_date").alias("last"))
    due = fx["securities"].join(seen, "symbol", "left").withColumn("fresh_days", F.when(F.col("market_cap").isNull(), 7).otherwise(30))
    return stalest(due, "symbol", "last", F.col("fresh_days"), "2001-12-31").select("symbol", "n")


# --- versioned tables, decisions, report windows


def folder(fx: Fixture, name: str) -> str:
    return f"{shared(fx.spark)}/{name}-{uuid.uuid4().hex}"


@query("w08_outcomes_replaced", "SELECT trade_id, symbol, d0_date, complete, " + s6("ret_20", "abn_ret_20") + " FROM outcomes WHERE trade_id IN (SELECT trade_id FROM trades WHERE NOT (trade_id % 16 = 3 AND ticker_status = 'renamed'))")
def _(fx):
    """All outcomes are stored; then some symbols leave the scope, and their rows go from the stored table."""
    schema = "trade_id long, symbol string, d0_date date, complete boolean, ret_20 double, abn_ret_20 double"
    stored = Versioned(fx.spark, folder(fx, "outcomes"), schema, ["trade_id"])
    out = outcomes_of(fx)
    oc.store(stored, out)
    gone = fx["trades"].where("trade_id % 16 = 3 and ticker_status = 'renamed'").select("trade_id")
    oc.store(stored, out.join(gone, "trade_id", "left_anti"))
    return stored.read().select("trade_id", "symbol", "d0_date", "complete", *r6("ret_20", "abn_ret_20"))


#: Some proposals of the fixture more often, so that members have several in a row.
ASKED = """SELECT proposal_id + 1000 * k AS proposal_id, CASE WHEN k = 0 THEN kind WHEN proposal_id % 11 = 0 THEN 'note' WHEN (proposal_id + k) % 3 = 0 THEN 'add' ELSE 'remove' END AS kind, member_id, 'proposal ' || CAST(proposal_id + 1000 * k AS STRING) AS title,
  CASE WHEN k = 0 THEN approved END AS approved, CAST(CASE WHEN k = 0 THEN decided_on END AS TIMESTAMP) AS decided_at, CAST(CASE WHEN k = 0 THEN applied_on END AS TIMESTAMP) AS applied_at, CASE WHEN k = 0 AND applied_on IS NOT NULL THEN 'applied' END AS apply_result
FROM proposals CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) AS ks"""
DECIDED = "SELECT CAST(CASE WHEN proposal_id % 13 = 5 THEN proposal_id + 90000 ELSE proposal_id END AS INT) AS proposal_id, CASE WHEN proposal_id % 4 = 0 THEN 0 ELSE 1 END AS approved, CAST(DATE '2001-08-01' AS TIMESTAMP) AS decided_at FROM asked"


def desk_of(fx: Fixture) -> tuple[dn.Desk, DataFrame]:
    """The fixture's proposals and watchlist as stored, and decisions on them."""
    desk = dn.Desk(fx.spark, folder(fx, "desk"))
    asked = fx.spark.sql(ASKED.replace("FROM proposals", "FROM {proposals}"), proposals=fx["proposals"])
    desk.proposals.commit(asked, 0)
    start = F.lit("2000-01-01").cast("timestamp_ntz")
    desk.watchlist.commit(fx["watchlist"].select("member_id", start.alias("added_at"), "reason", "active", F.lit("2001-07-01").cast("timestamp_ntz").alias("changed_at")), 0)
    return desk, fx.spark.sql(DECIDED.replace("FROM asked", "FROM {asked}"), asked=asked)


@query("q22_decisions", f", asked AS ({ASKED}), d AS ({DECIDED}) SELECT d.proposal_id, CASE WHEN a.proposal_id IS NULL THEN 'not found' WHEN a.applied_at IS NOT NULL THEN 'already applied' ELSE 'decided' END AS state FROM d LEFT JOIN asked a ON a.proposal_id = d.proposal_id")
def _(fx):
    desk, decisions = desk_of(fx)
    return desk.decide(decisions)


APPLIED = f""", asked AS ({ASKED}), d AS ({DECIDED}), p AS (SELECT a.*, CASE WHEN a.applied_at IS NULL AND d.decided_at IS NOT NULL THEN d.approved ELSE a.approved END AS ok FROM asked a LEFT JOIN d ON d.proposal_id = a.proposal_id),
old AS (SELECT member_id, kind, title, proposal_id FROM asked WHERE apply_result = 'applied' AND member_id NOT IN (SELECT member_id FROM watchlist)),
due AS (SELECT p.*, coalesce(w.active, CASE WHEN p.member_id IN (SELECT member_id FROM old WHERE kind = 'add') THEN 1 END) AS active, lag(CASE WHEN kind <> 'note' THEN kind END IGNORE NULLS) OVER (PARTITION BY p.member_id ORDER BY proposal_id) AS was FROM p LEFT JOIN watchlist w ON w.member_id = p.member_id WHERE ok = 1 AND applied_at IS NULL),
res AS (SELECT *, CASE WHEN kind = 'note' THEN 'acknowledged' WHEN kind = 'add' OR coalesce(was = 'add', active = 1, false) THEN 'applied' ELSE 'failed: not on the watchlist any more' END AS result FROM due)"""


@query("d59_applied_proposals", APPLIED + " SELECT p.proposal_id, p.ok AS approved, coalesce(res.result, p.apply_result) AS apply_result, p.applied_at IS NOT NULL OR res.result IS NOT NULL AS applied FROM p LEFT JOIN res ON res.proposal_id = p.proposal_id")
def _(fx):
    desk, decisions = desk_of(fx)
    desk.decide(decisions)
    desk.apply("2001-08-02")
    desk.apply("2001-08-03")  # nothing is applied twice
    return desk.proposals.read().select("proposal_id", "approved", "apply_result", F.col("applied_at").isNotNull().alias("applied"))


@query("d59_watchlist", APPLIED + """, fin AS (SELECT member_id, arg_max(kind, proposal_id) AS kind, arg_max(title, CASE WHEN kind = 'add' THEN proposal_id END) AS title FROM (SELECT member_id, kind, title, proposal_id FROM res WHERE result = 'applied' UNION ALL SELECT * FROM old) GROUP BY member_id)
SELECT coalesce(w.member_id, fin.member_id) AS member_id, CASE fin.kind WHEN 'add' THEN 1 WHEN 'remove' THEN 0 ELSE w.active END AS active, coalesce(fin.title, w.reason) AS reason FROM watchlist w FULL JOIN fin ON fin.member_id = w.member_id""")
def _(fx):
    desk, decisions = desk_of(fx)
    desk.decide(decisions)
    desk.apply("2001-08-02")
    return desk.watchlist.read().select("member_id", "active", "reason")


RUNS_AT = ("1996-01-01 12:00:00", "1998-06-01 00:00:00", "1998-06-02 18:00:00", "2001-03-01 00:00:00")


@query("r11_report_windows", f"""SELECT CASE WHEN first_seen_at < TIMESTAMP '{RUNS_AT[0]}' THEN '1995-12-31T12:00' WHEN first_seen_at < TIMESTAMP '{RUNS_AT[2]}' THEN '1996-01-01T12:00' ELSE '1998-06-02T18:00' END AS since, count(*) AS filings, min(first_seen_at) AS first_at, max(first_seen_at) AS last_at
FROM filings WHERE first_seen_at >= TIMESTAMP '1995-12-31 12:00:00' AND first_seen_at < TIMESTAMP '{RUNS_AT[3]}' GROUP BY 1""")
def _(fx):
    """Reports at four moments; the second fails after it has written, so the third covers its window, too."""
    markers = Versioned(fx.spark, folder(fx, "markers"), dn.MARKERS, ["source"])
    out = folder(fx, "reports")

    def write(rows, name):
        rows.select("doc_id", F.col("first_seen_at").cast("timestamp_ntz").alias("at")).write.mode("overwrite").parquet(f"{out}/window={name}")

    def broken(rows, name):
        write(rows, name)
        raise OSError("no connection")

    for k, now in enumerate(RUNS_AT):
        try:
            dn.report(markers, "digest", fx["filings"], "first_seen_at", datetime.fromisoformat(now), broken if k == 1 else write)
        except OSError:
            continue
    rows = fx.spark.read.schema("doc_id string, at timestamp_ntz, window string").parquet(out)
    since = F.date_format(F.to_timestamp_ntz(F.substring("window", 8, 15), F.lit("yyyyMMdd'T'HHmmss")), "yyyy-MM-dd'T'HH:mm")
    return rows.groupBy(since.alias("since")).agg(F.count("*").alias("filings"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


# --- streams and sources

TICKS = "SELECT user_id AS position_id, event_id AS tick, ts AS moment, value AS price, 0.5 + CAST(user_id % 7 AS DOUBLE) / 10 AS stop, 90 + CAST(user_id % 50 AS DOUBLE) * 2 AS target FROM events"


@query("r07_alerts_once", f"""WITH t AS ({TICKS.replace("0.5 +", "0.5::DOUBLE +")}), f AS (SELECT position_id, min(moment) + to_days(20) AS ends FROM t GROUP BY position_id)
SELECT position_id, 'stop' AS rule, min(moment) AS fired_at, arg_min(price, (moment, tick)) AS price FROM t WHERE price <= stop GROUP BY position_id
UNION ALL SELECT position_id, 'target', min(moment), arg_min(price, (moment, tick)) FROM t WHERE price >= target GROUP BY position_id
UNION ALL SELECT position_id, 'hold', date_trunc('milliseconds', ends), NULL FROM f WHERE ends <= (SELECT max(moment) FROM t) - to_hours(1)""")
def _(fx):
    """Events as prices of positions, in three parts; the stream is started anew for each."""
    ticks = fx.spark.sql(TICKS.replace("FROM events", "FROM {events}"), events=fx["events"]).withColumn("at", F.col("moment").cast("timestamp")).drop("moment")
    cut = [F.lit(d).cast("timestamp") for d in ("2024-01-05", "2024-01-19")]
    parts = [ticks.where(F.col("at") < cut[0]), ticks.where((F.col("at") >= cut[0]) & (F.col("at") < cut[1])), ticks.where(F.col("at") >= cut[1])]
    return replayed(fx.spark, parts, folder(fx, "watch"), 20).withColumnRenamed("at", "fired_at")


@query("s04_paged_listing", "SELECT CAST((row_number() OVER (ORDER BY page_id) - 1) // 100 AS INT) AS page, CAST((row_number() OVER (ORDER BY page_id) - 1) % 100 AS INT) AS position, CAST(page_id AS VARCHAR) AS doc_id, url AS title FROM pages")
def _(fx):
    """The table's URLs published as pages of a listing, and read back page by page."""
    path = folder(fx, "listing")
    remote.publish_listing(numbered(fx["pages"].select("page_id", "url"), ["page_id"]).select((F.col("n") - 1).alias("n"), F.col("page_id").cast("string").alias("doc_id"), F.col("url").alias("title")), path)
    return remote.listing(fx.spark, path)


@query("s13_quotes", "SELECT symbol, date, round(open, 3) AS open, round(close, 3) AS close, CAST(volume AS BIGINT) AS volume FROM prices WHERE symbol IN ('N3', 'N8', 'SPY') AND date >= DATE '1998-01-01' AND date < DATE '1999-07-01'")
def _(fx):
    path = folder(fx, "quotes")
    remote.publish_quotes(fx["prices"], path)
    own = remote.quotes(fx.spark, path).where(F.col("symbol").isin("N3", "N8", "SPY") & (F.col("date") >= F.lit("1998-01-01").cast("date")) & (F.col("date") < F.lit("1999-07-01").cast("date")))
    return own.select("symbol", "date", F.round("open", 3).alias("open"), F.round("close", 3).alias("close"), "volume")


# --- the weekly review

TODAY = "2001-06-30"


@query("a27_alert_performance", f""", per AS (SELECT t.doc_id, x.h, min(o.d0_date) AS d0, avg(CASE x.h WHEN 5 THEN abn_ret_5 ELSE abn_ret_20 END) AS abn FROM alerts a JOIN trades t ON t.trade_id = a.trade_id JOIN outcomes o ON o.trade_id = t.trade_id JOIN filings f ON f.doc_id = t.doc_id, (VALUES (5), (20)) x(h)
  WHERE a.rule = 'watchlist' AND o.copyable AND f.available_basis = 'seen' AND CASE x.h WHEN 5 THEN abn_ret_5 ELSE abn_ret_20 END IS NOT NULL GROUP BY t.doc_id, x.h)
SELECT s.span, CAST(k.h AS INT) AS horizon, count(per.abn) AS filings, round(avg(abn), 6) AS mean_abn_ret, round(avg(CASE WHEN abn > 0 THEN 1::DOUBLE WHEN abn IS NOT NULL THEN 0::DOUBLE END), 6) AS hit_rate
FROM (VALUES ('all'), ('recent')) s(span) CROSS JOIN (VALUES (5), (20)) k(h) LEFT JOIN per ON per.h = k.h AND (s.span = 'all' OR d0 >= DATE '{TODAY}' - 90) GROUP BY s.span, k.h""")
def _(fx):
    return wk.alert_performance(fx["alerts"], fx["trades"], fx["filings"], outcomes_of(fx), TODAY).select("span", "horizon", "filings", *r6("mean_abn_ret", "hit_rate"))


@query("d43_ranking_moves", """, b AS (SELECT member_id, shrunk_score, CASE WHEN n_filings >= 20 THEN row_number() OVER (PARTITION BY n_filings >= 20 ORDER BY shrunk_score DESC, mean_ret - mean_spy_ret DESC, member_id) END AS rank FROM member_stats WHERE horizon = 5),
j AS (SELECT m.member_id, m.name, s.member_id IS NOT NULL AS here, s.rank, b.rank AS rank_before, s.shrunk_score, b.shrunk_score AS score_before, coalesce(w.active, 0) = 1 AS watched FROM members m LEFT JOIN scores s ON s.member_id = m.member_id LEFT JOIN b ON b.member_id = m.member_id LEFT JOIN watchlist w ON w.member_id = m.member_id),
x AS (SELECT 'top' AS section, * FROM j WHERE rank <= 10 UNION ALL SELECT 'newly ranked', * FROM j WHERE rank IS NOT NULL AND rank_before IS NULL UNION ALL SELECT 'dropped', * FROM j WHERE rank IS NULL AND rank_before IS NOT NULL UNION ALL SELECT 'watched', * FROM j WHERE watched AND here)
SELECT section, member_id, name, rank, rank_before, round(shrunk_score, 6) AS shrunk_score, round(score_before, 6) AS score_before FROM x""")
def _(fx):
    out = outcomes_of(fx)
    return wk.ranking_moves(rk.member_scores(out), rk.member_scores(out, 5), fx["members"], fx["watchlist"]).select("section", "member_id", "name", "rank", "rank_before", *r6("shrunk_score", "score_before"))


@query("d43_weekly_facts")
def _(fx):
    out = outcomes_of(fx)
    books = wk.last_books(fx["runs"].select((F.col("run_id") % 6).cast("string").alias("book"), "run_id", "status"))
    pending = fx["proposals"].where("approved is null and applied_on is null").select("proposal_id", "kind", "member_id")
    notes = wk.caveats(rd.coverage(rd.price_needs(fx["trades"], "1995-12-01"), fx["prices"]), fx["filings"])
    performance = wk.alert_performance(fx["alerts"], fx["trades"], fx["filings"], out, TODAY)
    return wk.facts("2001-W26", performance, wk.ranking_moves(rk.member_scores(out), rk.member_scores(out, 5), fx["members"], fx["watchlist"]), books, pending, notes)


@query("j19_last_books", "SELECT book, run_id, status FROM (SELECT CAST(run_id % 6 AS VARCHAR) AS book, run_id, status, row_number() OVER (PARTITION BY run_id % 6 ORDER BY run_id DESC) AS k FROM runs) WHERE k = 1")
def _(fx):
    return wk.last_books(fx["runs"].select((F.col("run_id") % 6).cast("string").alias("book"), "run_id", "status"))


#: Findings of runs, some of them damaged: cut off, blank, no JSON, an object, an array with odd entries.
FINDINGS = """SELECT event_id AS run_id, CASE event_id % 7 WHEN 0 THEN props WHEN 1 THEN '[' || props || ', {"claim": "c' || CAST(event_id AS STRING) || '", "source": "s"}]' WHEN 2 THEN substr(props, 1, 4) WHEN 3 THEN '  ' WHEN 4 THEN NULL
  WHEN 5 THEN '["plain", {"claim": "x"}, 3]' ELSE 'not "JSON" at all' END AS findings, CASE WHEN event_id % 3 = 0 THEN '[1]' ELSE props END AS inputs FROM events"""


@query("f23_tolerant_findings", f"""WITH f AS ({FINDINGS}) SELECT run_id, CAST(CASE run_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN 0 WHEN 5 THEN 3 ELSE 1 END AS INT) AS n_claims, CAST(CASE WHEN run_id % 7 = 1 THEN 1 ELSE 0 END AS INT) AS n_sourced,
  coalesce(trim(findings) <> '' AND NOT json_valid(findings), false) AS damaged, json_valid(inputs) AND inputs LIKE '{{%' AS readable FROM f""")
def _(fx):
    return summary_of(fx.spark.sql(FINDINGS.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}"), events=fx["events"])).select("run_id", "n_claims", "n_sourced", "damaged", "readable")


# --- printed forms, reports and upkeep

#: Orders' lines as trades of forms, numbered.
FORM_TRADES = """SELECT 'F' || CAST(l_orderkey AS STRING) AS doc_id, l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_shipdate AS d,
  row_number() OVER (PARTITION BY doc_id ORDER BY l_linenumber) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n, l_orderkey % 6 = 1 AS old FROM {line_once}"""

#: Words of forms laid out from them: three trades a page, wrapped names and amounts, details over all columns, headers on every page of even orders only, an old font, a footnote with a stray trade after it.
FORMS = """WITH r AS (SELECT *, CAST(k DIV 3 AS INT) AS page, 120 + (k % 3) * 60 + (p % 3) * 0.5 AS y FROM {t}),
w AS (SELECT doc_id, page, inline(concat(
  filter(array(
    named_struct('x', 30, 'dy', 0.0, 'text', CASE p % 4 WHEN 0 THEN 'SP' WHEN 1 THEN 'JT' WHEN 2 THEN 'DC' END), named_struct('x', 70, 'dy', 0.9, 'text', 'Part ' || CAST(p AS STRING)),
    named_struct('x', 300, 'dy', 0.0, 'text', CASE WHEN s % 3 = 0 THEN 'S' ELSE 'P' END), named_struct('x', 312, 'dy', 0.9, 'text', CASE WHEN s % 6 = 0 THEN '(partial)' END),
    named_struct('x', 350, 'dy', 0.0, 'text', date_format(d, 'M/d/yyyy')), named_struct('x', 420, 'dy', 0.0, 'text', date_format(date_add(d, 30), 'MM/dd/yyyy')),
    named_struct('x', 488, 'dy', 0.0, 'text', CASE WHEN p % 5 = 0 THEN 'Over $50,000' ELSE '$' || CAST(p AS STRING) || ',001 -' END)), c -> c.text IS NOT NULL),
  filter(array(
    named_struct('x', 70, 'dy', 12.0, 'text', CASE WHEN old THEN '(n' || CAST(s % 25 AS STRING) || ') [sT]' ELSE '(N' || CAST(s % 25 AS STRING) || ') [OP]' END),
    named_struct('x', 490, 'dy', 12.0, 'text', CASE WHEN p % 5 <> 0 THEN '$' || CAST(p + 7 AS STRING) || ',000' END),
    named_struct('x', 70, 'dy', 24.0, 'text', CASE WHEN old THEN 'FILINg STATuS: New' ELSE 'F' || char(0) || ' S' || char(0) || ': New' END),
    named_struct('x', 70, 'dy', 36.0, 'text', CASE WHEN s % 2 = 0 AND old THEN 'DESCRIPTIoN: from' WHEN s % 2 = 0 THEN 'D' || char(0) || ': from' END),
    named_struct('x', 301, 'dy', 45.0, 'text', CASE WHEN s % 2 = 0 THEN 'supplier ' || CAST(s AS STRING) END)), c -> c.text IS NOT NULL))), y FROM r),
h AS (SELECT DISTINCT doc_id, page, old FROM r WHERE page = 0 OR o % 2 = 0),
f AS (SELECT doc_id, page, max(y) + 50 AS y FROM r WHERE k >= (n - 1) DIV 3 * 3 GROUP BY doc_id, page)
SELECT doc_id, page, CAST(x AS DOUBLE) AS x0, CAST(y + dy AS DOUBLE) AS top, text FROM w
UNION ALL SELECT doc_id, page, x0, 100D, CASE WHEN old THEN lower(text) ELSE text END FROM h LATERAL VIEW stack(7, 30D, 'Owner', 70D, 'Asset', 300D, 'Transaction', 350D, 'Date', 420D, 'Notification', 490D, 'Amount', 560D, 'Cap.') v AS x0, text
UNION ALL SELECT doc_id, page, x0, 108D, text FROM h LATERAL VIEW stack(2, 300D, 'Type', 560D, 'Gains >') v AS x0, text
UNION ALL SELECT doc_id, page, 30D, CAST(y AS DOUBLE), '* For the complete list of asset types' FROM f
UNION ALL SELECT doc_id, page + 1, x0, 60D, text FROM f LATERAL VIEW stack(5, 70D, 'Stray', 300D, 'P', 350D, '1/1/2000', 420D, '1/2/2000', 490D, '$1') v AS x0, text"""


@query("s06_printed_forms", """, t AS (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k, l_orderkey % 6 = 1 AS old FROM line_once l)
SELECT 'F' || CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(k AS INT) AS line_no, CASE l_partkey % 4 WHEN 0 THEN 'spouse' WHEN 1 THEN 'joint' WHEN 2 THEN 'dependent' ELSE 'self' END AS owner,
  'Part ' || CAST(l_partkey AS VARCHAR) || CASE WHEN old THEN ' (n' ELSE ' (N' END || CAST(l_suppkey % 25 AS VARCHAR) || ')' AS asset_name, 'N' || CAST(l_suppkey % 25 AS VARCHAR) AS ticker, CASE WHEN old THEN 'ST' ELSE 'OP' END AS asset_code,
  CASE WHEN old THEN 'stock' ELSE 'option' END AS asset_type, CASE WHEN l_suppkey % 6 = 0 THEN 'SELL_PARTIAL' WHEN l_suppkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS action, CAST(l_shipdate AS DATE) AS tx_date,
  CASE WHEN l_partkey % 5 = 0 THEN 50001 ELSE l_partkey * 1000 + 1 END AS amount_min, CASE WHEN l_partkey % 5 <> 0 THEN (l_partkey + 7) * 1000 END AS amount_max, CASE WHEN l_suppkey % 2 = 0 THEN 'from supplier ' || CAST(l_suppkey AS VARCHAR) END AS description FROM t""")
def _(fx):
    trades = fx.keep("form_trades", lambda: fx.spark.sql(FORM_TRADES, line_once=fx["line_once"]))  # words, headers and footnotes come from it
    # a task sorts some million words, of which a trade has 15 or so, several times over in memory; Spark's own partitions have a multiple of that
    parts = trades.count() * 15 // 1_000_000
    return printed.trades(fx.spark.sql(FORMS, t=trades), parts if parts > fx.spark.sparkContext.defaultParallelism else None)


SEEN = "SELECT doc_id, CASE WHEN parse_status <> 'failed' THEN available_at END AS index_seen_at, CASE WHEN filing_year IS NOT NULL THEN first_seen_at END AS search_seen_at FROM "


@query("a23_source_race", f""", s AS ({SEEN} filings), l AS (SELECT *, CASE WHEN search_seen_at < index_seen_at THEN epoch(index_seen_at - search_seen_at) / 3600 END AS lag FROM s)
SELECT count(*) AS tracked, count(*) FILTER (index_seen_at = search_seen_at) AS same, count(lag) AS search_first, count(*) FILTER (index_seen_at < search_seen_at) AS index_first, count(*) FILTER (index_seen_at IS NULL AND search_seen_at IS NOT NULL) AS only_search,
  count(*) FILTER (index_seen_at IS NOT NULL AND search_seen_at IS NULL) AS only_index, median(lag) AS median_lag_h, max(lag) AS max_lag_h FROM l""")
def _(fx):
    return rp.source_race(fx.spark.sql(SEEN + "{filings}", filings=fx["filings"]))


@query("a28_unmatched_filers", "SELECT DISTINCT filer_name FROM filings WHERE member_id IS NULL AND filer_name NOT IN (SELECT 'Filer ' || substr(member_id, 2) FROM members WHERE active = 0)")
def _(fx):
    others = fx["members"].where("active = 0").select(F.concat(F.lit("Filer "), F.expr("substr(member_id, 2)")).alias("filer_name"))
    return rp.unmatched_filers(fx["filings"], others)


@query("j24_review_queue", """SELECT chamber, filing_year AS year, count(*) AS filings, count(*) FILTER (parse_status = 'parsed') AS parsed, count(*) FILTER (parse_status = 'needs_review' AND doc_format = 'scanned') AS scanned, count(*) FILTER (parse_status = 'needs_review' AND doc_format <> 'scanned') AS review,
  count(*) FILTER (parse_status = 'failed') AS failed, count(*) FILTER (parse_status = 'pending') AS pending, count(*) FILTER (available_basis = 'filed') AS backfilled,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS trades FROM filings f LEFT JOIN (SELECT doc_id, count(*) AS n FROM trades GROUP BY doc_id) t ON t.doc_id = f.doc_id GROUP BY chamber, filing_year""")
def _(fx):
    return rp.review_queue(fx["filings"], fx["trades"])


@query("d51_leaderboard_report", """, x AS (SELECT h.*, m.name, h.mean_ret - h.mean_spy_ret AS excess, s.consistency FROM member_stats h JOIN members m ON m.member_id = h.member_id LEFT JOIN scores s ON s.member_id = h.member_id WHERE h.horizon = 20),
b AS (SELECT *, row_number() OVER (ORDER BY shrunk_score DESC, excess DESC, member_id) AS place FROM x WHERE n_filings >= 20 ORDER BY place LIMIT 30),
u AS (SELECT *, NULL AS place FROM x WHERE n_filings < 20 ORDER BY n_filings DESC, member_id LIMIT 10)
SELECT row_number() OVER (ORDER BY place NULLS LAST, n_filings DESC, member_id) AS line, place, member_id, name, n_filings, round(consistency, 6) AS consistency, round(shrunk_score, 6) AS shrunk_score FROM (SELECT * FROM b UNION ALL SELECT * FROM u)""")
def _(fx):
    out = outcomes_of(fx)
    return rp.leaderboard(rk.member_horizon_stats(out), rk.member_scores(out), fx["members"]).select("line", "place", "member_id", "name", "n_filings", *r6("consistency", "shrunk_score"))


@query("d52_factor_report", "SELECT row_number() OVER (ORDER BY factor = 'all' DESC, factor, n DESC, level) AS line, factor, level, n, round(shrunk - pooled, 6) AS effect FROM factors")
def _(fx):
    return rp.factor_lines(factors_of(fx)).select("line", "factor", "level", "n", *r6("effect"))


@query("w10_committee_names", """, s AS (SELECT member_id, to_json(list(committee_id ORDER BY committee_id)) AS committees FROM committees WHERE congress = 105 GROUP BY member_id)
SELECT m.member_id, CASE WHEN m.active = 0 THEN m.name ELSE m.name || ' ' || m.state END AS name, m.active, CAST(s.committees AS VARCHAR) AS committees FROM members m LEFT JOIN s ON s.member_id = m.member_id""")
def _(fx):
    people = fx["members"].where("active = 1").select("member_id", F.concat_ws(" ", "name", "state").alias("name"))
    seats = fx["committees"].withColumn("committee_name", F.lit(None).cast("string"))
    return rp.with_committees(rp.refreshed_members(fx["members"], people), seats, F.lit("1998-03-01").cast("date")).select("member_id", "name", "active", "committees")


@query("w11_downloads", """, d AS (SELECT 'F' || CAST(o_orderkey AS VARCHAR) AS doc_id, 'raw/' || CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 4 = 0 THEN 'scanned' ELSE 'electronic' END AS fmt FROM orders WHERE o_orderstatus <> 'P')
SELECT f.doc_id, d.path AS raw_path, coalesce(d.fmt, f.doc_format) AS doc_format, CASE WHEN d.fmt IS NULL OR f.parse_status NOT IN ('pending', 'needs_review') THEN f.parse_status WHEN d.fmt = 'electronic' THEN 'pending' ELSE 'needs_review' END AS parse_status FROM filings f LEFT JOIN d ON d.doc_id = f.doc_id""")
def _(fx):
    key = F.col("o_orderkey").cast("string")
    content = F.concat(F.lit("%PDF "), F.when(F.col("o_orderkey") % 4 == 0, "/Image").otherwise("/Font"), F.lit(" "), "o_clerk" if "o_clerk" in fx["orders"].columns else key)
    files = fx["orders"].where("o_orderstatus <> 'P'").select(F.concat(F.lit("F"), key).alias("doc_id"), F.concat(F.lit("raw/"), key).alias("raw_path"), content.cast("binary").alias("content"))
    return rp.downloaded(fx["filings"], files).select("doc_id", "raw_path", "doc_format", "parse_status")


#: Events as runs for filings; a seventh have damaged inputs, an eleventh no output.
BRIEFS = """SELECT event_id AS run_id, CASE WHEN event_id % 5 = 0 THEN 'other' ELSE 'researcher' END AS agent, CASE WHEN event_id % 13 = 0 THEN 'failed' ELSE 'ok' END AS status, CAST(ts AS TIMESTAMP) AS started_at,
  '{"doc_id": "F' || CAST(event_id % 2000 AS STRING) || CASE WHEN event_id % 7 = 0 THEN '"' ELSE '"}' END AS inputs, CASE WHEN event_id % 11 = 0 THEN '' ELSE props END AS output FROM events"""


@query("d55_research_gate", f""", r AS ({BRIEFS}), b AS (SELECT t.doc_id, count(*) AS buys, max(a.score) AS best FROM alerts a JOIN trades t ON t.trade_id = a.trade_id WHERE a.score >= 60 AND t.symbol <> '' GROUP BY t.doc_id),
l AS (SELECT json_extract_string(inputs, '$.doc_id') AS doc_id, run_id, output FROM r WHERE json_valid(inputs) AND agent = 'researcher' AND status = 'ok' AND started_at >= TIMESTAMP '2024-01-10'),
x AS (SELECT doc_id, max(run_id) AS run_id, arg_max(output, run_id) AS output FROM l GROUP BY doc_id)
SELECT b.doc_id, buys, best, CASE WHEN output <> '' THEN run_id END AS run_id, CASE WHEN output <> '' THEN output END AS brief FROM b LEFT JOIN x ON x.doc_id = b.doc_id""")
def _(fx):
    runs = fx.spark.sql(BRIEFS.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}"), events=fx["events"])
    buys = fx["alerts"].join(fx["trades"].select("trade_id", "doc_id", "symbol"), "trade_id").select("doc_id", "symbol", "score")
    return rp.research_gate(buys, runs, F.lit("2024-01-30").cast("timestamp"), hours=480)


@query("f22_amount_texts", """SELECT trade_id, CASE WHEN amount_max IS NULL THEN 'over $' || format('{:,}', amount_min - 1) ELSE '$' || format('{:,}', amount_min) || '–$' || format('{:,}', amount_max) END AS amount FROM trades""")
def _(fx):
    return fx["trades"].select("trade_id", rp.amount_text(F.col("amount_min"), F.col("amount_max")).alias("amount"))


# --- facts, positions, nested reads


@query("d33_recommendation")
def _(fx):
    return ft.recommendation(*grid_of(fx), days_of(fx)).select("rule", "n", "fallback", *r6("train_score"))


@query("d35_position_exits")
def _(fx):
    days, _ = ex.benchmark(fx["prices"])
    n_days = int(days.agg(F.max("i")).first()[0]) + 1
    return ft.position_exits(fx["positions"], ex.series(fx["prices"], days), days, n_days, ex.Rule("trailing_stop", pct=0.1)).select("position_id", "exit_i", *r6("exit_price"), "exit_at", "reason")


@query("q10_trade_detail", """SELECT t.trade_id, t.symbol, coalesce(m.name, f.filer_name) AS member_name, f.filing_date, o.d0_date, o.complete, round(ret_20, 6) AS ret_20 FROM trades t LEFT JOIN members m ON m.member_id = t.member_id LEFT JOIN filings f ON f.doc_id = t.doc_id
LEFT JOIN outcomes o ON o.trade_id = t.trade_id WHERE t.trade_id = 10011""")
def _(fx):
    return ft.trade_detail(10011, fx["trades"], fx["members"], fx["filings"], outcomes_of(fx)).select("trade_id", "symbol", "member_name", "filing_date", "d0_date", "complete", *r6("ret_20"))


@query("q14_watchlist_changes", """SELECT coalesce(w.member_id, c.member_id) AS member_id, coalesce(c.active, w.active) AS active, coalesce(c.reason, w.reason) AS reason FROM watchlist w FULL JOIN (SELECT 'M1' AS member_id, 0 AS active, NULL AS reason UNION ALL SELECT 'M5', 1, 'again' UNION ALL SELECT 'M9', 1, 'new') c ON c.member_id = w.member_id""")
def _(fx):
    return ft.watch(fx["watchlist"], fx.spark.createDataFrame([("M1", 0, None), ("M5", 1, "again"), ("M9", 1, "new")], "member_id string, active int, reason string"))


@query("q16_exit_rules", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{r.label}')" for k, r in enumerate(ex.GRID)) + ") x(position, label)")
def _(fx):
    return fx.spark.createDataFrame([(k, r.label) for k, r in enumerate(ex.GRID)], "position int, label string").orderBy("position")


@query("q17_close_positions", "SELECT position_id, CASE WHEN status = 'open' AND position_id % 2 = 0 THEN 'closed' ELSE status END AS status, CASE WHEN status = 'open' AND position_id % 2 = 0 THEN 99::DOUBLE ELSE sell_price END AS sell_price FROM positions")
def _(fx):
    sold = fx["positions"].where("position_id % 2 = 0").select("position_id", F.lit("2002-01-01").cast("date").alias("sell_date"), F.lit(99.0).alias("sell_price"))
    return ft.close_positions(fx["positions"], sold).select("position_id", "status", "sell_price")


@query("q19_history", NEED + """, have AS (SELECT symbol, min(date) AS first_date, max(date) AS last_date FROM prices WHERE close IS NOT NULL GROUP BY symbol),
c AS (SELECT symbol, CASE WHEN first_date IS NULL THEN 'missing' WHEN first_date > needed_from + 4 OR last_date < needed_to - 7 THEN 'partial' ELSE 'ok' END AS status FROM need LEFT JOIN have USING (symbol))
SELECT s.status, (SELECT count(*) FROM c WHERE c.status = s.status) AS symbols, (SELECT count(*) FROM trades t JOIN c ON c.symbol = t.symbol WHERE c.status = s.status) AS trades FROM (VALUES ('ok'), ('partial'), ('missing')) s(status)""")
def _(fx):
    return ft.history(rd.coverage(rd.price_needs(fx["trades"], "1995-12-01"), fx["prices"]), fx["trades"])


@query("q21_nested_reads", """SELECT f.doc_id, string_agg(CAST(t.line_no AS VARCHAR) || ':' || t.action, ',' ORDER BY t.line_no) AS lines FROM (SELECT doc_id FROM filings ORDER BY doc_id DESC LIMIT 50) f LEFT JOIN trades t ON t.doc_id = f.doc_id GROUP BY f.doc_id""")
def _(fx):
    rows = ft.nested(fx["filings"].select("doc_id"), fx["trades"].select("doc_id", "line_no", "action"), "doc_id", "line_no", "lines")
    text = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["line_no"].cast("string"), x["action"])), ",")
    return rows.select("doc_id", text.alias("lines"))


@query("d42_month_positions", """, h AS (SELECT * FROM positions WHERE buy_date <= DATE '1999-06-30' AND (sell_date IS NULL OR sell_date >= DATE '1999-06-01')), c AS (SELECT * FROM prices WHERE close IS NOT NULL),
v AS (SELECT h.*, b.close AS b, e.close AS e FROM (SELECT *, DATE '1999-05-31' AS lo, DATE '1999-06-30' AS hi FROM h) h ASOF LEFT JOIN c b ON b.symbol = h.ticker AND b.date <= h.lo ASOF LEFT JOIN c e ON e.symbol = h.ticker AND e.date <= h.hi)
SELECT position_id, round((CASE WHEN sell_date <= DATE '1999-06-30' THEN sell_price ELSE e END - CASE WHEN buy_date >= DATE '1999-06-01' THEN buy_price ELSE b END) * shares, 2) AS pnl FROM v""")
def _(fx):
    return ft.month_positions(fx["positions"], fx["prices"], "1999-06-01", "1999-06-30").select("position_id", F.round("pnl", 2).alias("pnl"))


@query("d58_checked_proposals", """, p AS (SELECT CAST(row_number() OVER (ORDER BY member_id) AS INT) AS proposal_id, CASE WHEN substr(member_id, 2, 1) < '5' THEN 'add' ELSE 'remove' END AS kind, member_id, CASE WHEN member_id LIKE '%7' THEN NULL ELSE 'x' END AS evidence FROM members)
SELECT proposal_id, member_id, CASE WHEN r IS NULL THEN kind ELSE 'note' END AS kind, r AS reason FROM (SELECT *, CASE WHEN evidence IS NULL THEN 'no evidence' WHEN kind = 'add' AND member_id IN (SELECT member_id FROM watchlist WHERE active = 1) THEN 'already watched' WHEN kind = 'remove' AND member_id NOT IN (SELECT member_id FROM watchlist WHERE active = 1) THEN 'not watched' END AS r FROM p)""")
def _(fx):
    from pyspark.sql import Window

    p = fx["members"].select(F.row_number().over(Window.orderBy("member_id")).alias("proposal_id"), F.when(F.substring("member_id", 2, 1) < "5", "add").otherwise("remove").alias("kind"), "member_id", F.when(~F.col("member_id").endswith("7"), "x").alias("evidence"))
    return ft.checked_proposals(p, fx["members"], fx["watchlist"])



def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(f):
        return lambda spark, sf_dir: f(Fixture(spark, sf_dir))

    return {name: bind(f) for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql(o) for name, (_, o) in REGISTRY.items() if o}
