"""Recommendation, position watch, nested reads, proposals and fact sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import exits as ex
from ..operators.asof import asof
from ..operators.calendar import next_day_map
from ..operators.merge import merge
from . import backtest as bt


def recommendation(signals: DataFrame, starts: DataFrame, days: DataFrame) -> DataFrame:
    """(rule, n, fallback, train_score): the rule to use from now on, from trades of the last two years that have exited."""
    now = days.agg((F.max("i") + 1).alias("start"), F.date_add(F.max("date"), 1).alias("start_date")).select(F.col("start_date").alias("q"), "start", "start_date")
    labels = F.array(*(F.lit(r.label) for r in ex.GRID))
    return bt.choose(signals, starts, now).select(F.element_at(labels, F.col("rule_no") + 1).alias("rule"), "n", "fallback", "train_score")


def exit_report(rows: DataFrame) -> DataFrame:
    """(book, n_filings, mean_abn_ret, beaten, confidence) of the whole span: how many fixed holds the walk-forward book beats."""
    whole = rows.where("q is null").select("book", "n_filings", "mean_abn_ret")
    walk = F.broadcast(whole.where("book = 'walk_forward'").select(F.col("mean_abn_ret").alias("w"), F.col("n_filings").alias("wn")))
    beaten = whole.where("book <> 'walk_forward'").join(walk).groupBy("w", "wn").agg(F.count_if(F.col("w") > F.col("mean_abn_ret")).alias("beaten"))
    level = bt.confidence(F.col("w"), F.col("beaten"), F.col("wn"))
    return whole.join(F.broadcast(beaten.withColumn("confidence", level)), F.col("book") == "walk_forward", "left").select("book", "n_filings", "mean_abn_ret", "beaten", "confidence")


def position_exits(positions: DataFrame, bars: DataFrame, days: DataFrame, n_days: int, rule: ex.Rule) -> DataFrame:
    """Exits of open positions under a rule from their own fill, bought on the first trading day on or after the purchase date."""
    own = positions.where("status = 'open'").select(F.col("position_id").alias("trade_id"), F.col("ticker").alias("symbol"), "buy_date", "buy_price")
    ahead = next_day_map(days).select(F.col("date").alias("buy_date"), F.col("next_i").alias("d0"))
    before = days.agg(F.min("date").alias("first_day"), F.min("i").alias("first_i"))
    placed = own.join(F.broadcast(before)).join(F.broadcast(ahead), "buy_date", "left").withColumn("d0", F.when(F.col("buy_date") < F.col("first_day"), F.col("first_i")).otherwise(F.col("d0"))).where("d0 is not null")
    return ex.simulate(placed.select("trade_id", "symbol", "d0", "buy_price"), bars, rule, n_days, entry_col="buy_price", intraday=True).withColumnRenamed("trade_id", "position_id")


def trade_detail(trade_id, trades: DataFrame, members: DataFrame, filings: DataFrame, outcomes: DataFrame) -> DataFrame:
    t = trades.where(F.col("trade_id") == trade_id)
    o = outcomes.select("trade_id", "d0_date", "copyable", "ret_20", "abn_ret_20", "complete")
    return t.join(members.select("member_id", "name", "party"), "member_id", "left").join(filings.select("doc_id", "filing_date", "available_basis", "filer_name"), "doc_id", "left").join(o, "trade_id", "left").withColumn("member_name", F.coalesce("name", "filer_name"))


def nested(parents: DataFrame, children: DataFrame, key: str, order: str, name: str, limit: int = 50) -> DataFrame:
    """The last ``limit`` parents with their children as an array, in order."""
    top = parents.orderBy(F.desc(key)).limit(limit)
    cols = [order, *(c for c in children.columns if c not in (key, order))]
    grouped = children.join(F.broadcast(top.select(key)), key, "left_semi").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    return top.join(grouped, key, "left")


def history(coverage: DataFrame, trades: DataFrame) -> DataFrame:
    """Symbols by coverage status (every status has a row), and trades with a symbol of that status."""
    statuses = coverage.sparkSession.createDataFrame([("ok",), ("partial",), ("missing",)], "status string")
    n = coverage.groupBy("status").agg(F.count("*").alias("symbols"))
    t = trades.join(F.broadcast(coverage.select("symbol", "status")), "symbol").groupBy("status").agg(F.count("*").alias("trades"))
    return statuses.join(n, "status", "left").join(t, "status", "left").select("status", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("trades", F.lit(0)).alias("trades"))


def watch(watchlist: DataFrame, changes: DataFrame) -> DataFrame:
    """The watchlist after changes (member_id, active, reason): added ones become active, removed ones inactive, their reason kept."""
    return merge(watchlist, changes, ["member_id"], {"reason": "fill", "active": "new"})


def close_positions(positions: DataFrame, closed: DataFrame) -> DataFrame:
    """Positions after sales (position_id, sell_date, sell_price); only open ones can be closed."""
    c = closed.select("position_id", F.col("sell_date").alias("_d"), F.col("sell_price").alias("_p"))
    hit = (F.col("status") == "open") & F.col("_p").isNotNull()
    out = positions.join(c, "position_id", "left")
    new = {"sell_date": F.when(hit, F.col("_d")).otherwise(F.col("sell_date")), "sell_price": F.when(hit, F.col("_p")).otherwise(F.col("sell_price")), "status": F.when(hit, "closed").otherwise(F.col("status"))}
    return out.withColumns(new).select(*positions.columns)


def checked_proposals(proposals: DataFrame, members: DataFrame, watchlist: DataFrame) -> DataFrame:
    """``proposals`` (proposal_id, kind, member_id, evidence) with ``kind`` lowered to ``note`` and the reason, where it can't be applied."""
    active = watchlist.where("active = 1").select("member_id", F.lit(True).alias("_w"))
    known = members.select("member_id", F.lit(True).alias("_k"))
    rows = proposals.join(known, "member_id", "left").join(active, "member_id", "left")
    first = rows.groupBy("kind", "member_id").agg(F.min("proposal_id").alias("_first"))
    rows = rows.join(first, ["kind", "member_id"], "left")
    reason = (
        F.when(F.coalesce("evidence", F.lit("")) == "", "no evidence").when(F.col("_k").isNull(), "unknown member").when((F.col("kind") == "add") & F.col("_w").isNotNull(), "already watched")
        .when((F.col("kind") == "remove") & F.col("_w").isNull(), "not watched").when(F.col("proposal_id") > F.col("_first"), "duplicate")
    )
    return rows.withColumn("reason", reason).select("proposal_id", "member_id", F.when(F.col("reason").isNull(), F.col("kind")).otherwise("note").alias("kind"), "reason")


def month_positions(positions: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """Positions held in a month: value at its start (or the purchase) and end (or the sale), and the profit between."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    held = positions.where((F.col("buy_date") <= hi) & (F.col("sell_date").isNull() | (F.col("sell_date") >= lo))).withColumns({"lo": F.date_sub(lo, 1), "hi": hi, "symbol": F.col("ticker")})
    closes = prices.where("close is not null")
    rows = asof(asof(held, closes, "symbol", "lo", ["close"], prefix="b_"), closes, "symbol", "hi", ["close"], prefix="e_")
    first = F.when(F.col("buy_date") >= lo, F.col("buy_price")).otherwise(F.col("b_close"))
    last = F.when(F.col("sell_date") <= hi, F.col("sell_price")).otherwise(F.col("e_close"))
    return rows.select("position_id", first.alias("start_price"), last.alias("end_price"), ((last - first) * F.col("shares")).alias("pnl"))
