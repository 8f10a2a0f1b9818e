"""Own positions: value, gain over the benchmark, where their exit rule stands, and which exits are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import rule_parts
from ..operators import exits as ex
from ..operators.asof import asof
from ..operators.calendar import BENCHMARK, last_day_map, trading_days
from ..operators.rangemax import range_max, sparse_table
from ..session import near, written

#: How far the first close may be from the price paid before a split is supposed, and trading days that a symbol may be late.
SPLIT, STALE = 0.4, 5
MAX_HOLD = ex.MAX_HOLD


def calendar_closes(prices: DataFrame) -> DataFrame:
    """(date, last_i, spy): for each date from the first trading day to the last, the number of the last trading day up to it and the benchmark's last close. A few thousand rows."""
    days = trading_days(prices)
    own = prices.where((F.col("symbol") == BENCHMARK)).select("date", "close")
    known = days.join(own, "date", "left").select("i", F.last("close", ignorenulls=True).over(Window.orderBy("i")).alias("spy"))
    return last_day_map(days).join(F.broadcast(known.withColumnRenamed("i", "last_i")), "last_i").select("date", "last_i", "spy")


def _upto(rows: DataFrame, calendar: DataFrame, last: DataFrame, date: str, name: str) -> DataFrame:
    """``rows`` with ``{name}_i`` and ``{name}_spy`` as of a date; null before the first trading day."""
    at = calendar.select(F.col("date").alias("_d"), F.col("last_i").alias(f"{name}_i"), F.col("spy").alias(f"{name}_spy"))
    # the map ends with the calendar, later dates see its last day
    return rows.crossJoin(F.broadcast(last)).withColumn("_d", F.least(F.col(date), F.col("_last"))).join(F.broadcast(at), "_d", "left").drop("_d", "_last", "_n_days")


def param(rule: Column, name: str) -> Column:
    return rule_parts(rule)[1][name].cast("double")


def valued(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Positions with their price now (the last close; of closed ones that of the sale), value, profit, return, the benchmark's return over the same days and the excess.

    Where the first close since the purchase is far from the price paid, stored prices have been split since: an open position then has no price, and ``price_note`` says so.
    """
    calendar = calendar_closes(prices)
    end_of = calendar.agg(F.max("date").alias("_last"), (F.max("last_i") + 1).alias("_n_days"))
    closes = prices.where("close is not null")
    own = positions.withColumn("symbol", F.upper("ticker"))
    w = Window.partitionBy("symbol").orderBy("date")
    placed = closes.withColumn("last_close", F.last("close").over(w.rowsBetween(0, Window.unboundedFollowing))).withColumn("last_date", F.last("date").over(w.rowsBetween(0, Window.unboundedFollowing)))
    rows = asof(own, placed, "symbol", "buy_date", ["close", "last_close", "last_date"], forward=True, prefix="first_")
    split = F.coalesce(F.abs(F.col("first_close") / F.col("buy_price") - 1) > SPLIT, F.lit(False))
    open_ = F.col("status") == "open"
    price = F.when(open_, F.when(~split, F.col("first_last_close"))).otherwise(F.col("sell_price"))
    rows = rows.withColumns({"split": split, "price": price, "end_date": F.when(open_, F.when(~split, F.col("first_last_date"))).otherwise(F.col("sell_date"))})
    rows = _upto(_upto(rows, calendar, end_of, "buy_date", "in"), calendar, end_of, "end_date", "out")
    ret = F.col("price") / F.col("buy_price") - 1
    spy = F.when(F.col("price").isNotNull(), F.col("out_spy") / F.col("in_spy") - 1)
    note = F.when(split, "stored prices are far from the price paid (a split?)")
    out = rows.withColumns({"value": F.col("price") * F.col("shares"), "pnl": (F.col("price") - F.col("buy_price")) * F.col("shares"), "ret": ret, "spy_ret": spy, "price_note": note})
    return out.withColumn("excess", F.col("ret") - F.col("spy_ret")).drop("symbol", "first_last_close", "first_last_date", "out_i", "in_spy", "out_spy")


def rule_status(rows: DataFrame, prices: DataFrame, exit_alerts: DataFrame) -> DataFrame:
    """``valued`` positions with the exit that was sent (``triggered_on``, ``exit_reason``) and, for open ones without, days held, the longest hold, and the levels that the next check uses.

    The high since the purchase begins at the price paid or the first day's close, and takes the later days' highs: a maximum over an interval of
    the symbol's bars, looked up in a sparse table rather than over all its days again.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    bars = prices.withColumn("place", F.row_number().over(w) - 1).select("symbol", "date", "place", "high", "low", "close", F.count("*").over(Window.partitionBy("symbol")).alias("size"))
    longest = bars.agg(F.max("size")).first()[0] or 0
    table = sparse_table(bars.select("symbol", "place", "high"), "symbol", "place", "high", longest)
    rule, params = rule_parts(F.col("exit_rule"))
    own = rows.join(exit_alerts.select("position_id", "triggered_on", F.col("reason").alias("exit_reason")), "position_id", "left").withColumns({"symbol": F.upper("ticker"), "rule": rule, "_p": params})
    watched = (F.col("status") == "open") & F.col("rule").isNotNull() & F.col("triggered_on").isNull()
    # the first bar with a close, unless a split makes it useless
    first = F.when(~F.col("split"), F.col("first_date"))
    own = own.withColumns({"watched": watched, "_first": F.when(watched, first)})
    at = bars.select("symbol", F.col("date").alias("_first"), (F.col("place") + 1).cast("long").alias("_low"), (F.col("size") - 1).alias("_high"))
    own = range_max(own.join(at, ["symbol", "_first"], "left"), table, "symbol", "place", "_low", "_high", "later_high")
    high = F.when(F.col("_first").isNotNull(), F.greatest("buy_price", "first_close", "later_high"))
    number = lambda k: F.col("_p")[k].cast("double")
    widths = [r.n for r in own.where("watched and rule = 'atr_stop'").select(number("n").cast("int").alias("n")).distinct().collect()]  # rules' parameters, a few
    out = own.withColumn("trailing_high", high).withColumn("atr", F.lit(None).cast("double"))
    for n in widths:
        tr = ex.atr(bars.select("symbol", F.col("date").alias("i"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c")), n)
        # the bar before the first
        tr = asof(out.where("_first is not null").select("position_id", "symbol", "_first"), tr.withColumnRenamed("i", "date"), "symbol", "_first", ["atr"], strict=True, prefix="tr_")
        out = out.join(tr.select("position_id", "tr_atr"), "position_id", "left").withColumn("atr", F.when(number("n") == n, F.col("tr_atr")).otherwise(F.col("atr"))).drop("tr_atr")
    high = F.col("trailing_high")
    stop = F.when(F.col("rule") == "stop_target", F.col("buy_price") * (1 - number("stop"))).when(F.col("rule") == "trailing_stop", high * (1 - number("pct"))).when(F.col("rule") == "atr_stop", high - number("mult") * F.col("atr"))
    last = calendar_closes(prices).agg((F.max("last_i") + 1).alias("n_days"))
    held = F.col("n_days") - F.coalesce(F.col("in_i") + 1, F.lit(0))
    hold = F.when(F.col("rule") == "fixed_hold", number("days")).otherwise(F.coalesce(number("max_hold"), F.lit(float(MAX_HOLD))))
    out = out.crossJoin(F.broadcast(last)).withColumns({
        "days_held": F.when(F.col("watched"), held), "max_hold": F.when(F.col("watched"), hold.cast("int")), "stop_level": F.when(F.col("watched"), stop),
        "target_level": F.when(F.col("watched") & (F.col("rule") == "stop_target"), F.col("buy_price") * (1 + number("target"))),
    })
    return out.drop("symbol", "_p", "_first", "_low", "_high", "later_high", "atr", "n_days", "watched", "in_i")


def member_sales(positions: DataFrame, trades: DataFrame, filings: DataFrame) -> DataFrame:
    """(position_id, doc_id, sold_on): the source member's first sale of the symbol that became public on or after the day of purchase.

    Sales and the positions' own trades come from one pass over the trades; a window per member and symbol finds each purchase's next sale, so that the work is linear in rows.
    """
    own = near(written(positions.select("position_id", F.col("trade_id").alias("_source"), F.upper("ticker").alias("_ticker"), "buy_date")))
    public = filings.select("doc_id", F.coalesce("available_at", "first_seen_at").alias("public_at"))
    sale = F.coalesce(F.col("action").isin("SELL", "SELL_PARTIAL"), F.lit(False)).alias("_sale")
    seen = trades.select("trade_id", "member_id", "symbol", "doc_id", sale).join(own, F.col("trade_id") == F.col("_source"), "left")
    seen = seen.where("member_id is not null and (_sale or _source is not null)").join(public, "doc_id", "left")
    sold = F.when(F.col("_sale") & F.col("public_at").isNotNull(), F.struct("symbol", F.to_date("public_at").alias("day"), F.struct("public_at", "doc_id").alias("s"), F.lit(None).alias("position_id")))
    bought = F.when(F.col("_source").isNotNull(), F.struct(F.coalesce("symbol", "_ticker").alias("symbol"), F.col("buy_date").alias("day"), F.lit(None).alias("s"), "position_id"))
    rows = seen.select("member_id", F.explode(F.array(sold, bought)).alias("e")).select("member_id", "e.*").where("symbol is not null and day is not null")
    # later days first; on a day sales come before purchases, the one that became public first last
    upto = Window.partitionBy("member_id", "symbol").orderBy(F.desc("day"), F.desc_nulls_last("s")).rowsBetween(Window.unboundedPreceding, 0)
    later = F.last("s", ignorenulls=True).over(upto)
    first = rows.withColumn("_next", later).where("position_id is not null and _next is not null").groupBy("position_id").agg(F.min("_next").alias("s"))
    return first.select("position_id", "s.doc_id", F.to_date("s.public_at").alias("sold_on"))


def due_exits(positions: DataFrame, trades: DataFrame, filings: DataFrame, prices: DataFrame, rules: dict[str, ex.Rule], sent: DataFrame) -> DataFrame:
    """(position_id, reason, day, price, close): exits of open positions that are due and haven't been ``sent``, by their own rule (``rules``: by its label as it is stored).

    Prices aren't adjusted, as what was paid isn't. A member's sale comes before the longest hold; positions whose prices have been split aren't watched; a symbol without a bar
    for ``STALE`` trading days counts as ended, a late bar doesn't.
    """
    days = trading_days(prices)
    n_days = int(days.agg(F.max("i")).first()[0]) + 1
    raw = prices.select("symbol", "date", "open", "high", "low", "close", F.col("close").alias("adj_close"))
    bars = ex.series(raw, days)
    open_ = valued(positions.where("status = 'open'").join(sent.select("position_id"), "position_id", "left_anti"), prices).where(~F.col("split")).withColumn("symbol", F.upper("ticker"))
    calendar = calendar_closes(prices).select("date", F.col("last_i").alias("upto"))
    ends = days.agg(F.min("date").alias("_first_day"), F.max("date").alias("_last_day"))
    placed = open_.crossJoin(F.broadcast(ends)).join(F.broadcast(calendar.withColumnRenamed("date", "buy_date")), "buy_date", "left")
    day = F.col("buy_date")
    # first trading day on or after the purchase
    exact = placed.join(F.broadcast(days.select(F.col("date").alias("buy_date"), F.col("i").alias("on"))), "buy_date", "left")
    d0 = F.when(day <= F.col("_first_day"), 0).when(F.col("on").isNotNull(), F.col("on")).when(day <= F.col("_last_day"), F.col("upto") + 1)
    own = written(exact.withColumn("d0", d0.cast("int")).where("d0 is not null"))  # few rows, read by each step below
    following = own.where(rule_parts(F.col("exit_rule"))[0] == "member_sale")
    sold = written(following.join(member_sales(following, trades, filings), "position_id").select("position_id", F.lit("sale").alias("reason"), F.col("sold_on").alias("day"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("double").alias("close")))
    rest = own.join(sold.select("position_id"), "position_id", "left_anti")
    labels = list(rules)
    hits = ex.simulate(rest.select(F.col("position_id").alias("trade_id"), "symbol", "d0", "buy_price"), bars, tuple(rules.values()), n_days, entry_col="buy_price", intraday=True)
    hits = hits.withColumn("exit_rule", F.get(F.array(*(F.lit(x) for x in labels)), F.col("rule_no"))).withColumnRenamed("trade_id", "position_id").join(rest.select("position_id", "exit_rule", "symbol"), ["position_id", "exit_rule"])
    late = (F.col("reason") == "data_end") & (F.lit(n_days - 1) - F.col("exit_i") < STALE)
    hits = hits.where((F.col("reason") != "open") & ~late)
    named = hits.join(F.broadcast(days.select(F.col("i").alias("exit_i"), F.col("date").alias("day"))), "exit_i").join(bars.select("symbol", F.col("i").alias("exit_i"), "c"), ["symbol", "exit_i"], "left")
    simulated = named.select("position_id", "reason", "day", F.col("exit_price").alias("price"), F.col("c").alias("close"))
    # no bar since the purchase, and long enough ago
    unseen = rest.join(bars.where("c is not null").groupBy("symbol").agg(F.max("i").alias("last")), "symbol", "left").where("last is null or last < d0")
    gap = F.lit(n_days - 1) - F.greatest(F.coalesce("last", F.lit(-1)), F.col("d0") - 1)
    ended = unseen.where(gap >= STALE).join(F.broadcast(days.select(F.col("i").alias("last_day"), F.col("date").alias("day"))), F.col("last_day") == F.greatest(F.coalesce("last", F.lit(0)), F.lit(0)))
    ended = ended.select("position_id", F.lit("data_end").alias("reason"), "day", F.lit(None).cast("double").alias("price"), F.lit(None).cast("double").alias("close"))
    return sold.unionByName(simulated).unionByName(ended)
