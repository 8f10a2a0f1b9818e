"""Trade outcomes: returns from the first open after a filing became public."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.calendar import BENCHMARK, last_day_map, trading_days, with_entry
from ..operators.snapshots import Versioned
from ..session import near, written

HORIZONS = (1, 5, 10, 20, 60)
DELAYS = (1, 2, 3, 5)
PRICED = ("listed", "renamed", "unlisted")


def availability(filing_date: Column, first_seen_at: Column, backfill: Column) -> tuple[Column, Column]:
    """(available_at, basis): backfilled filings with a date count as public at 21:00 UTC on it."""
    filed = backfill & filing_date.isNotNull()
    at = filing_date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(21))
    return F.when(filed, at).otherwise(first_seen_at.cast("timestamp_ntz")), F.when(filed, "filed").otherwise("seen")


def priced(trades: DataFrame) -> DataFrame:
    """Trades with a priced symbol."""
    return trades.where(F.col("symbol").isNotNull() & F.col("ticker_status").isin(*PRICED))


def readable(filings: DataFrame) -> DataFrame:
    """(doc_id, available_at): filings that weren't read from a scan, with the moment they became public."""
    return filings.where(F.coalesce("parse_method", F.lit("text")) != "vision").select("doc_id", F.coalesce("available_at", "first_seen_at").alias("available_at"))


def in_scope(trades: DataFrame, filings: DataFrame) -> DataFrame:
    """Trades with a priced symbol whose filing wasn't read from a scan, with the moment they became public."""
    return priced(trades).join(readable(filings), "doc_id")


def copyable() -> Column:
    """A buy that can be copied: no option, or one whose name says call and not put (as substrings)."""
    text = F.lower(F.concat(F.coalesce("asset_name", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    return (F.col("action") == "BUY") & ((F.coalesce("asset_type", F.lit("")) != "option") | (text.contains("call") & ~text.contains("put")))


def positive(*columns: str) -> Column:
    """All present and above zero."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.col(c) > 0, F.lit(False))
    return out


def bars_by_day(prices: DataFrame, days: DataFrame) -> DataFrame:
    """(symbol, i, raw_open, adj_open, adj_close) on trading days, nulls where a price is missing or not positive."""
    adjusted = F.when(positive("open", "close", "adj_close"), F.col("open") * F.col("adj_close") / F.col("close"))
    return prices.join(F.broadcast(days), "date").select(
        "symbol", "i", F.when(positive("open"), F.col("open")).alias("raw_open"), adjusted.alias("adj_open"), F.when(positive("adj_close"), F.col("adj_close")).alias("adj_close")
    )


def reach(prices: DataFrame, days: DataFrame, horizons=HORIZONS, delays=DELAYS, benchmark: str = BENCHMARK) -> DataFrame:
    """Bars with what lies ahead of them: own prices, the benchmark's of that day, and those of the days that are a number of trading days later.

    A window by day number finds them, null where the symbol has no bar on just that day. There are as many rows as bars, however many trades meet them.
    """
    bars = bars_by_day(prices, days)
    spy = F.broadcast(bars.where(F.col("symbol") == benchmark).select("i", F.col("adj_open").alias("spy_open"), F.col("adj_close").alias("spy_close")))
    w = Window.partitionBy("symbol").orderBy("i")

    def later(c: str, n: int) -> Column:
        return F.max(c).over(w.rangeBetween(n, n))

    ahead = bars.select("*", *(later("adj_close", h).alias(f"p{h}") for h in horizons), *(later("raw_open", k).alias(f"o{k}") for k in delays))
    # a calendar day each, so the benchmark's later closes are found once
    by_day = Window.orderBy("i")
    spy_later = spy.select("i", "spy_open", "spy_close", *(F.max("spy_close").over(by_day.rangeBetween(h, h)).alias(f"s{h}") for h in horizons))
    return ahead.join(F.broadcast(spy_later), "i", "left")


def returns(ahead: DataFrame, horizons=HORIZONS, delays=DELAYS) -> DataFrame:
    """What a trade gets that enters on a bar: (symbol, d0, d0_open, entry, spy_entry, ret_*, abn_ret_*, open_infl_*), found once per bar."""
    ready = F.col("adj_open").isNotNull() & F.col("spy_open").isNotNull()
    out = {"d0_open": F.col("raw_open"), "entry": F.col("adj_open"), "spy_entry": F.col("spy_open")}
    for h in horizons:
        ok = ready & F.col(f"p{h}").isNotNull() & F.col(f"s{h}").isNotNull()
        ret = F.col(f"p{h}") / F.col("adj_open") - 1
        out |= {f"ret_{h}": F.when(ok, ret), f"abn_ret_{h}": F.when(ok, ret - (F.col(f"s{h}") / F.col("spy_open") - 1))}
    for k in delays:
        out[f"open_infl_{k}"] = F.when(F.col("raw_open").isNotNull() & F.col(f"o{k}").isNotNull(), F.col("raw_open") / F.col(f"o{k}") - 1)
    return ahead.select("symbol", F.col("i").alias("d0"), *(v.alias(k) for k, v in out.items()), "adj_close", "spy_close")


def compute(trades: DataFrame, filings: DataFrame, prices: DataFrame, horizons=HORIZONS, delays=DELAYS, benchmark: str = BENCHMARK, also: tuple[str, ...] = ()) -> DataFrame:
    """A row for each trade in scope with an entry day, and its columns ``also``.

    A trade meets two rows of bars only, that of its entry day, which has all returns from there, and that of the day it was made.
    Trades don't move for that while bars are few enough to be broadcast.
    """
    days = written(trading_days(prices, benchmark))  # a few thousand rows that many parts of the plan read
    n_days = days.agg((F.max("i") + 1).alias("n_days"))
    keep = ["trade_id", "doc_id", "member_id", "symbol", "tx_date", "d0", "d0_date", "copyable", *also]
    entered = with_entry(readable(filings), days)  # found once per filing
    rows = priced(trades).join(entered, "doc_id").withColumn("copyable", copyable()).select(*keep)
    before = last_day_map(days).select(F.col("date").alias("tx_date"), F.col("last_i"))
    rows = rows.join(F.broadcast(before), "tx_date", "left").withColumn("tx_i", F.when(F.col("tx_date") < F.col("d0_date"), F.col("last_i"))).drop("last_i", "tx_date")
    bars = near(written(returns(reach(prices, days, horizons, delays, benchmark).where("raw_open is not null or adj_close is not null"), horizons, delays)))
    made = bars.select("symbol", F.col("d0").alias("tx_i"), F.col("adj_close").alias("ptx"), F.col("spy_close").alias("stx"))
    joined = rows.join(bars.drop("adj_close", "spy_close"), ["symbol", "d0"], "left").join(made, ["symbol", "tx_i"], "left").join(F.broadcast(n_days))
    out = {"d0_open": F.col("d0_open"), "complete": F.col("d0") + max(horizons) < F.col("n_days")}
    for h in horizons:
        out |= {f"ret_{h}": F.col(f"ret_{h}"), f"abn_ret_{h}": F.col(f"abn_ret_{h}"), f"win_{h}": F.when(F.col("copyable"), F.col(f"abn_ret_{h}") > 0)}
    okt = F.col("entry").isNotNull() & F.col("spy_entry").isNotNull() & F.col("ptx").isNotNull() & F.col("stx").isNotNull()
    tx = F.col("entry") / F.col("ptx") - 1
    out |= {"tx_ret": F.when(okt, tx), "tx_abn_ret": F.when(okt, tx - (F.col("spy_entry") / F.col("stx") - 1))}
    out |= {f"open_infl_{k}": F.col(f"open_infl_{k}") for k in delays}
    return joined.select("trade_id", "doc_id", "member_id", "symbol", "d0", "d0_date", "copyable", *also, *(v.alias(k) for k, v in out.items()))


def store(table: Versioned, outcomes: DataFrame) -> dict[str, int]:
    """Outcomes in place of the stored ones: what fell out of scope goes, and only buckets in which a row differs are written."""
    return table.update(lambda _: outcomes)
