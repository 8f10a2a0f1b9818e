"""Read endpoints and quality reports, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.asof import asof
from ..operators.calendar import eastern
from .outcomes import HORIZONS, copyable
from .rankings import MIN_N

LIST_CAP = 1000


def horizon_checked(h: int) -> int:
    if h not in HORIZONS:
        raise ValueError(f"horizon must be one of {HORIZONS}")
    return h


def share(c: Column) -> Column:
    return F.avg(c.cast("double"))


def summary(filings: DataFrame, trades: DataFrame, alerts: DataFrame, watchlist: DataFrame, positions: DataFrame) -> DataFrame:
    one = filings.agg(F.count("*").alias("filings"), F.count_if(F.col("parse_status") == "needs_review").alias("needs_review"), F.max("first_seen_at").cast("timestamp_ntz").alias("last_filing_seen_at"))
    for name, df in {
        "trades": trades, "alerts": alerts, "watchlist": watchlist.where("active = 1"), "open_positions": positions.where("status = 'open'"),
    }.items():
        one = one.join(F.broadcast(df.agg(F.count("*").alias(name))))
    return one


def recent_filings(filings: DataFrame, members: DataFrame, limit: int = 50) -> DataFrame:
    named = filings.join(members.select("member_id", "name"), "member_id", "left").withColumn("member_name", F.coalesce("name", "filer_name"))
    top = named.orderBy(F.desc("first_seen_at"), F.desc("filing_date"), F.desc("doc_id")).limit(min(limit, LIST_CAP))
    return top.select("doc_id", "chamber", "filing_date", "parse_status", "doc_format", "member_name")


def recent_alerts(alerts: DataFrame, trades: DataFrame, members: DataFrame, limit: int = 50) -> DataFrame:
    rows = alerts.join(trades.select("trade_id", "ticker", "action", "amount_min", "amount_max", "member_id"), "trade_id").join(members.select("member_id", F.col("name").alias("member_name")), "member_id", "left")
    return rows.orderBy(F.desc("sent_at"), F.desc("alert_id")).limit(min(limit, LIST_CAP)).select("alert_id", "score", "ticker", "action", "amount_min", "amount_max", "member_name")


def trade_list(trades: DataFrame, members: DataFrame, filings: DataFrame, alerts: DataFrame, member: str = "", ticker: str = "", action: str = "", limit: int = 100) -> DataFrame:
    """Trades by optional filters, newest disclosure first; member matches anywhere, in either case."""
    best = alerts.groupBy("trade_id").agg(F.max("score").alias("score"))
    f = filings.select("doc_id", "filer_name", F.col("chamber"), "available_basis", "parse_method")
    rows = trades.join(members.select("member_id", "name", "party"), "member_id", "left").join(f, "doc_id", "left").withColumn("member_name", F.coalesce("name", "filer_name"))
    if member:
        rows = rows.where(F.col("member_name").ilike(f"%{member}%"))
    if ticker:
        rows = rows.where((F.col("ticker") == ticker.upper()) | (F.col("symbol") == ticker.upper()))
    if action:
        rows = rows.where(F.col("action") == action)
    top = rows.orderBy(F.desc("disclosure_date"), F.desc("trade_id")).limit(min(limit, LIST_CAP))
    return top.join(best, "trade_id", "left").select("trade_id", "ticker", "symbol", "action", "tx_date", "disclosure_date", "amount_min", "member_name", "party", "chamber", "score")


def leaderboard(stats: DataFrame, scores: DataFrame, members: DataFrame, horizon: int) -> DataFrame:
    """Statistics at a horizon with rank for members with enough filings."""
    ok = F.col("n_filings") >= MIN_N
    w = Window.partitionBy(ok).orderBy(F.desc("shrunk_score"), F.desc("mean_abn_ret"), "member_id")
    rows = stats.where(F.col("horizon") == horizon_checked(horizon)).withColumn("rank", F.when(ok, F.row_number().over(w)))
    rows = rows.join(members.select("member_id", "name", "chamber", "party"), "member_id").join(scores.select("member_id", "consistency"), "member_id", "left")
    return rows.orderBy(F.asc_nulls_last("rank"), F.desc("n_filings"))


def outcome_summary(outcomes: DataFrame, member_id: str = "") -> DataFrame:
    """Per horizon, copyable buys with one observation per filing (members apart or not); empty horizons don't appear."""
    rows = outcomes.where("copyable")
    if member_id:
        rows = rows.where(F.col("member_id") == member_id)
    by = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"ret_{h}").alias("r"), F.col(f"abn_ret_{h}").alias("a")) for h in HORIZONS))).alias("x")
    per = rows.select("doc_id", by).where("x.r is not null and x.a is not null").groupBy("x.horizon", "doc_id").agg(F.count("*").alias("n"), F.avg("x.r").alias("r"), F.avg(F.col("x.r") - F.col("x.a")).alias("s"), F.avg("x.a").alias("a"))
    return per.groupBy("horizon").agg(
        F.count("*").alias("n_filings"), F.sum("n").alias("n_trades"), F.avg("r").alias("mean_ret"), F.avg("s").alias("mean_spy_ret"), (F.avg("r") - F.avg("s")).alias("mean_abn_ret"), share(F.col("a") > 0).alias("hit_rate")
    )


def outcome_members(outcomes: DataFrame, members: DataFrame) -> DataFrame:
    return outcomes.where("copyable").join(members.select("member_id", "name"), "member_id").groupBy("member_id", "name").agg(F.count_distinct("doc_id").alias("n_filings")).orderBy("name")


def outcome_trades(outcomes: DataFrame, trades: DataFrame, members: DataFrame, filings: DataFrame, limit: int = 100) -> DataFrame:
    rows = outcomes.where("copyable").drop("member_id", "symbol", "doc_id").join(trades.select("trade_id", "doc_id", "member_id", "symbol", "tx_date", "disclosure_date"), "trade_id")
    rows = rows.orderBy(F.desc("d0_date"), F.desc("trade_id")).limit(min(limit, LIST_CAP))
    rows = rows.join(members.select("member_id", "name"), "member_id", "left").join(filings.select("doc_id", "filer_name", "available_basis"), "doc_id", "left")
    return rows.withColumn("member_name", F.coalesce("name", "filer_name"))


def inflation_table(stats: DataFrame, delays: DataFrame, members: DataFrame) -> DataFrame:
    """One row per group: means pivoted over delays, the best delay, the member's name for member groups."""
    wide = stats.groupBy("group_type", "group_key").pivot("k", [1, 2, 3, 5]).agg(F.first("mean"))
    wide = wide.select("group_type", "group_key", *(F.col(str(k)).alias(f"mean_{k}") for k in (1, 2, 3, 5)))
    m = members.select("member_id", "name")
    return wide.join(delays, ["group_type", "group_key"]).join(m, (F.col("group_type") == "member") & (F.col("member_id") == F.col("group_key")), "left").drop("member_id")


def trade_prices(prices: DataFrame, symbol: str, start, end) -> DataFrame:
    """The benchmark's days from 10 days before the start to 95 after the end, with the symbol's close and open where it has a bar."""
    window = F.col("date").between(F.date_sub(F.lit(start).cast("date"), 10), F.date_add(F.lit(end).cast("date"), 95))
    spy = prices.where((F.col("symbol") == "SPY") & window).select("date", F.col("close").alias("spy_close"))
    own = prices.where((F.col("symbol") == symbol) & window).select("date", "open", "close")
    return spy.join(own, "date", "left").orderBy("date")


def members_watched(members: DataFrame, watchlist: DataFrame) -> DataFrame:
    w = watchlist.select("member_id", F.col("active").alias("w"))
    return members.where("active = 1").join(w, "member_id", "left").select("member_id", "name", "chamber", "party", "state", F.coalesce("w", F.lit(0)).alias("watched"))


def watched(watchlist: DataFrame, members: DataFrame) -> DataFrame:
    return watchlist.where("active = 1").select("member_id", "reason").join(members.select("member_id", "name", "chamber", "party"), "member_id").orderBy("name")


def portfolio_totals(valued: DataFrame) -> DataFrame:
    own = valued.where("status = 'open' and value is not null")
    return own.agg(F.sum(F.col("buy_price") * F.col("shares")).alias("cost"), F.sum("value").alias("value"), F.sum("pnl").alias("pnl"))


def review_queue(filings: DataFrame) -> DataFrame:
    """Filings by chamber and year (nulls are a group) and parse status."""
    s, scanned = F.col("parse_status"), F.col("doc_format") == "scanned"
    return filings.groupBy("chamber", "filing_year").agg(
        F.count("*").alias("filings"), F.count_if(s == "parsed").alias("parsed"), F.count_if((s == "needs_review") & scanned).alias("scanned"),
        F.count_if((s == "needs_review") & ~scanned).alias("needs_review"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "pending").alias("pending"),
    )


def pipeline_health(runs: DataFrame) -> DataFrame:
    """Last run, last good one, failures since, runs in the 24 hours before the last start."""
    a = runs.agg(F.max("run_id").alias("last_run"), F.max_by("status", "run_id").alias("last_status"), F.max(F.when(F.col("status") == "ok", F.col("run_id"))).alias("last_ok_run"), F.max("started_at").alias("latest"))
    joined = runs.crossJoin(F.broadcast(a))
    return joined.groupBy("last_run", "last_status", "last_ok_run").agg(
        F.count_if((F.col("status") == "failed") & (F.col("run_id") > F.coalesce("last_ok_run", F.lit(0)))).alias("failure_streak"), F.count_if(F.col("started_at") >= F.col("latest") - F.expr("interval 24 hours")).alias("runs_24h")
    )


def schedule_gaps(runs: DataFrame, weekday_min: int = 30, weekend_min: int = 120, grace_min: int = 15) -> DataFrame:
    """Starts that came later after the one before than the schedule of that day in New York allows.

    Days are windows of their own, with each day's first start compared with the last of the days before.
    """
    day = runs.withColumn("et", eastern(F.col("started_at"))).withColumn("day", F.to_date("et"))
    ends = day.groupBy("day").agg(F.max("started_at").alias("ends"))
    prior = ends.select("day", F.lag("ends").over(Window.orderBy("day")).alias("prior"))  # one row a day
    w = Window.partitionBy("day").orderBy("started_at", "run_id")
    gaps = day.join(F.broadcast(prior), "day").withColumn("before", F.coalesce(F.lag("started_at").over(w), F.col("prior")))
    limit = F.when(F.dayofweek(F.to_date(eastern(F.col("before")))).isin(1, 7), weekend_min).otherwise(weekday_min) + grace_min
    minutes = F.timestamp_diff("MINUTE", F.col("before").cast("timestamp"), F.col("started_at").cast("timestamp"))
    return gaps.where(minutes > limit).select("run_id", minutes.alias("minutes"), limit.alias("limit"))


def detection_lag(filings: DataFrame) -> DataFrame:
    """Lag in days from filing to first sight: count, median, 90th by position floor(0.9 n) - 1, same and next day shares."""
    lag = F.datediff(F.to_date("first_seen_at"), "filing_date")
    rows = filings.where("filing_date is not null").select(lag.alias("lag"))
    counts = rows.groupBy("lag").agg(F.count("*").alias("c"))
    w = Window.orderBy("lag")  # one row per distinct lag
    n = F.sum("c").over(Window.partitionBy())
    placed = counts.select("lag", "c", F.sum("c").over(w).alias("until"), n.alias("n"))
    at = F.greatest(F.floor(F.col("n") * 0.9).cast("long"), F.lit(1))
    return placed.agg(F.max("n").alias("n"), F.min(F.when(F.col("until") >= at, F.col("lag"))).alias("p90"), F.round(F.sum(F.when(F.col("lag") <= 0, F.col("c")).otherwise(0)) / F.max("n"), 6).alias("same_day"), F.round(F.sum(F.when(F.col("lag") <= 1, F.col("c")).otherwise(0)) / F.max("n"), 6).alias("next_day"))


def alert_latency(alerts: DataFrame, trades: DataFrame, filings: DataFrame) -> DataFrame:
    """Minutes from first sight to alert, per message; negative ones are dropped."""
    rows = alerts.join(trades.select("trade_id", "doc_id"), "trade_id").join(filings.select("doc_id", "first_seen_at"), "doc_id")
    per = rows.groupBy("sent_at").agg(F.min("first_seen_at").alias("seen"))
    minutes = F.timestamp_diff("MINUTE", F.col("seen").cast("timestamp"), F.col("sent_at").cast("timestamp"))
    return per.select(minutes.alias("m")).where("m >= 0").agg(F.count("*").alias("n"), F.median("m").alias("median_min"), F.max("m").alias("max_min"))


def outcome_report(outcomes: DataFrame, trades: DataFrame) -> DataFrame:
    rows = outcomes.join(trades.select("trade_id", F.year("disclosure_date").alias("year")), "trade_id")
    return rows.groupBy("year").agg(F.count("*").alias("rows"), F.count("abn_ret_1").alias("priced"), F.count_if("complete").alias("complete"))


def horizon_report(outcomes: DataFrame) -> DataFrame:
    by = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"abn_ret_{h}").alias("a")) for h in HORIZONS))).alias("x")
    rows = outcomes.where("copyable").select(by).where("x.a is not null")
    return rows.groupBy("x.horizon").agg(F.count("*").alias("n"), F.avg("x.a").alias("mean"), F.median("x.a").alias("median"), share(F.col("x.a") > 0).alias("hit"))


def coverage(need: DataFrame, prices: DataFrame, start_slack: int = 4, stale: int = 7) -> DataFrame:
    """Price coverage per symbol (symbol, needed_from, needed_to): ok, partial with the first reason that holds, missing."""
    have = prices.where("close is not null").groupBy("symbol").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_rows"))
    rows = need.join(have, "symbol", "left")
    late = F.col("first_date") > F.date_add("needed_from", start_slack)
    early = F.col("last_date") < F.date_sub("needed_to", stale)
    status = F.when(F.col("n_rows").isNull(), "missing").when(late | early, "partial").otherwise("ok")
    note = F.when(F.col("n_rows").isNull(), "no prices").when(late, "starts late").when(early, "ends early")
    return rows.select("symbol", "needed_from", "first_date", "last_date", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), status.alias("status"), note.alias("note"))


def price_needs(trades: DataFrame, floor: str = "2019-12-01", lead_days: int = 30) -> DataFrame:
    """(symbol, needed_from, needed_to): from the earliest trade or disclosure less a lead, never before the floor."""
    day = F.least(F.coalesce("tx_date", "disclosure_date"), "disclosure_date")
    per = trades.where("symbol is not null").groupBy(F.upper("symbol").alias("symbol")).agg(F.min(day).alias("d"), F.max("disclosure_date").alias("needed_to"))
    return per.select("symbol", F.greatest(F.date_sub("d", lead_days), F.lit(floor).cast("date")).alias("needed_from"), "needed_to")


def rebased(stored: DataFrame, fresh: DataFrame, tolerance: float = 5e-4) -> DataFrame:
    """(symbol, rebased): whether any overlapping bar but the latest stored one differs by more than the tolerance."""
    both = stored.select("symbol", "date", F.col("close").alias("old")).join(fresh.select("symbol", "date", F.col("close").alias("new")), ["symbol", "date"])
    latest = both.groupBy("symbol").agg(F.max("date").alias("latest"))
    diff = F.abs(F.col("new") / F.col("old") - 1)
    return both.join(F.broadcast(latest), "symbol").groupBy("symbol").agg(F.coalesce(F.max(F.when((F.col("date") < F.col("latest")) & (F.col("old") > 0), diff)), F.lit(0.0)).alias("d")).select("symbol", (F.col("d") > tolerance).alias("rebased"))


def size_at_disclosure(trades: DataFrame, prices: DataFrame, securities: DataFrame) -> DataFrame:
    """``trade_id, bucket``: today's size scaled by the close at disclosure over the symbol's last close; today's size where either is missing or 0."""
    ref = prices.groupBy("symbol").agg(F.max_by("close", "date").alias("close_ref"))
    then = asof(trades.where("symbol is not null").select("trade_id", "symbol", "disclosure_date"), prices, "symbol", "disclosure_date", ["close"], prefix="then_")
    rows = then.join(securities.select("symbol", "market_cap"), "symbol", "left").join(ref, "symbol", "left")
    good = F.coalesce((F.col("then_close") > 0) & (F.col("close_ref") > 0), F.lit(False))
    cap = F.when(good, F.col("market_cap") * F.col("then_close") / F.col("close_ref")).otherwise(F.col("market_cap"))
    return rows.select("trade_id", size_bucket(cap).alias("bucket"))


def size_bucket(cap: Column) -> Column:
    return F.when(cap.isNull(), None).when(cap >= 200e9, "mega").when(cap >= 10e9, "large").when(cap >= 2e9, "mid").when(cap >= 300e6, "small").otherwise("micro")


def congress_of(day: Column) -> Column:
    """Number of the Congress in session; terms begin on 3 January of odd years."""
    y = F.year(F.date_sub(day, 2))
    return (F.floor((y - 1789) / 2) + 1).cast("int")


def committee_relevance(trades: DataFrame, seats: DataFrame, sectors: DataFrame) -> DataFrame:
    """(trade_id, relevant): whether the member sat, in that Congress, on a committee that covers the sector."""
    covered = seats.join(F.broadcast(sectors), "committee_id").select("member_id", "congress", "sector").distinct()
    keyed = trades.withColumn("congress", congress_of(F.col("tx_date")))
    hit = keyed.join(covered, ["member_id", "congress", "sector"], "left_semi").select("trade_id", F.lit(1).alias("relevant"))
    return trades.select("trade_id").join(hit, "trade_id", "left").select("trade_id", F.coalesce("relevant", F.lit(0)).alias("relevant"))


def alert_candidates(trades: DataFrame, filings: DataFrame, members: DataFrame, watchlist: DataFrame, positions: DataFrame, alerts: DataFrame, filing_alerts: DataFrame, since: str) -> DataFrame:
    """(rule, trade_id, doc_id): what watched members' filings, detected live and first seen since, give reason to alert and haven't yet: copyable
    buys with a symbol, sales of held symbols, and scans that nobody has read."""
    watched = watchlist.where("active = 1").join(members, "member_id", "left_semi").select("member_id")
    live = filings.where((F.col("first_seen_at") >= F.lit(since).cast("timestamp_ntz")) & (F.col("available_basis") == "seen"))
    fresh = trades.where("symbol <> ''").join(live.select("doc_id"), "doc_id", "left_semi").join(watched, "member_id", "left_semi").join(alerts, "trade_id", "left_anti")
    held = positions.where("status = 'open'").select(F.upper("ticker").alias("held")).distinct()
    marked = fresh.join(held, F.upper("symbol") == F.col("held"), "left")
    rule = F.when(copyable(), "watchlist_buy").when(F.col("action").isin("SELL", "SELL_PARTIAL") & F.col("held").isNotNull(), "held_sale")
    scans = live.where("doc_format = 'scanned' and parse_method is null").join(watched, "member_id", "left_semi").join(filing_alerts, "doc_id", "left_anti")
    return marked.select(rule.alias("rule"), "trade_id", "doc_id").where("rule is not null").unionByName(scans.select(F.lit("scanned").alias("rule"), F.lit(None).cast("bigint").alias("trade_id"), "doc_id"))


def snapshot_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(member_id, old_rank, new_rank, change) of ranked members that entered, left or moved."""
    both = before.where("rank is not null").select("member_id", F.col("rank").alias("old_rank")).join(now.where("rank is not null").select("member_id", F.col("rank").alias("new_rank")), "member_id", "full_outer")
    change = F.when(F.col("old_rank").isNull(), "entered").when(F.col("new_rank").isNull(), "left").when(F.col("old_rank") != F.col("new_rank"), "moved")
    return both.withColumn("change", change).where("change is not null")


def watchlist_candidates(scores: DataFrame, watchlist: DataFrame, proposals: DataFrame, today: str, top: int = 5, least: float = 0.005, cooldown: int = 90) -> DataFrame:
    """(member_id, kind): add the top ranked with a good record who aren't watched; remove watched ones with a negative score. Neither if
    the same proposal is still open, or was turned down within the cooldown."""
    active = watchlist.where("active = 1").select("member_id", F.lit(True).alias("watched"))
    ranked = scores.where("rank is not null").join(active, "member_id", "left").withColumn("watched", F.coalesce("watched", F.lit(False)))
    add = ~F.col("watched") & (F.col("rank") <= top) & (F.col("shrunk_score") >= least) & (F.coalesce("hit_rate", F.lit(0.0)) >= 0.5)
    kind = F.when(add, "add").when(F.col("watched") & (F.col("shrunk_score") < 0), "remove")
    open_ = F.col("applied_on").isNull() & (F.coalesce("approved", F.lit(1)) == 1)
    refused = (F.col("approved") == 0) & (F.col("decided_on") >= F.date_sub(F.lit(today).cast("date"), cooldown))
    before = proposals.where(open_ | refused).select("member_id", "kind")
    return ranked.select("member_id", kind.alias("kind")).where("kind is not null").join(before, ["member_id", "kind"], "left_anti")


def momentum(prices: DataFrame, bars: int) -> DataFrame:
    """(symbol, move): last close over the one ``bars`` bars before, null without so many."""
    w = Window.partitionBy("symbol").orderBy("date")
    rows = prices.where("close is not null").withColumn("was", F.lag("close", bars).over(w))
    return rows.groupBy("symbol").agg((F.max_by("close", "date") / F.max_by("was", "date") - 1).alias("move"))
