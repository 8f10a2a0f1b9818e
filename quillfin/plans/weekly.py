"""Facts for the weekly review: how alerts did, how the ranking moved, and what waits for a decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tolerant import object_of

HORIZONS, RECENT_DAYS, TOP = (5, 20), 90, 10


def alert_performance(alerts: DataFrame, trades: DataFrame, filings: DataFrame, outcomes: DataFrame, today: str, rule: str = "watchlist", horizons=HORIZONS, recent_days: int = RECENT_DAYS) -> DataFrame:
    """(span, horizon, filings, mean_abn_ret, hit_rate): alerted copyable buys, one observation per filing, of all time and of the last days; a span without any has a row, too.

    Only filings that were seen live count: a backfilled one's alert went out long after its entry day. Both spans come from one pass: each filing is put in those it belongs to, before the second mean.
    """
    own = alerts.where(F.col("rule") == rule).select("trade_id")  # alerts of one trade count as often as they were sent
    live = filings.where("available_basis = 'seen'").select("doc_id")
    rows = own.join(trades.select("trade_id", "doc_id"), "trade_id").join(live, "doc_id", "left_semi").join(outcomes.where("copyable").select("trade_id", "d0_date", *(f"abn_ret_{h}" for h in horizons)), "trade_id")
    by = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"abn_ret_{h}").alias("abn")) for h in horizons))).alias("x")
    per = rows.select("doc_id", "d0_date", by).where("x.abn is not null").groupBy("doc_id", "x.horizon").agg(F.min("d0_date").alias("d0"), F.avg("x.abn").alias("abn"))
    recent = F.col("d0") >= F.date_sub(F.lit(today).cast("date"), recent_days)
    spans = F.explode(F.when(recent, F.array(F.lit("all"), F.lit("recent"))).otherwise(F.array(F.lit("all")))).alias("span")
    found = per.select("horizon", "abn", spans).groupBy("span", "horizon").agg(F.count("*").alias("filings"), F.avg("abn").alias("mean_abn_ret"), F.avg((F.col("abn") > 0).cast("double")).alias("hit_rate"))
    spark = alerts.sparkSession
    every = spark.createDataFrame([(s, h) for s in ("all", "recent") for h in horizons], "span string, horizon int")
    return every.join(found, ["span", "horizon"], "left").withColumn("filings", F.coalesce("filings", F.lit(0)))


def ranking_moves(now: DataFrame, before: DataFrame, members: DataFrame, watchlist: DataFrame, top: int = TOP) -> DataFrame:
    """(section, member_id, name, rank, rank_before, shrunk_score, score_before): the first ``top``, those newly ranked, those that dropped out, and those watched. Without an earlier ranking nobody is new or dropped."""
    n = now.select("member_id", "rank", "shrunk_score", F.lit(True).alias("_n"))
    b = before.select("member_id", F.col("rank").alias("rank_before"), F.col("shrunk_score").alias("score_before"), F.lit(True).alias("_b"))
    some = before.agg((F.count("*") > 0).alias("_some"))
    w = watchlist.where("active = 1").select("member_id", F.lit(True).alias("_w"))
    both = n.join(b, "member_id", "full_outer").join(w, "member_id", "left").join(members.select("member_id", "name"), "member_id").crossJoin(F.broadcast(some))
    ranked = F.coalesce(F.col("_n"), F.lit(False)) & F.col("rank").isNotNull()
    sections = F.array_compact(F.array(
        F.when(ranked & (F.col("rank") <= top), "top"), F.when(ranked & F.col("rank_before").isNull() & F.col("_some"), "newly ranked"),
        F.when(~ranked & F.col("rank_before").isNotNull(), "dropped"), F.when(F.col("_w") & F.col("_n"), "watched"),
    ))
    return both.select(F.explode(sections).alias("section"), "member_id", "name", "rank", "rank_before", "shrunk_score", "score_before")


def last_books(backtests: DataFrame) -> DataFrame:
    """The last run's row of each book (book, run_id, ...)."""
    columns = [c for c in backtests.columns if c != "book"]
    return backtests.groupBy("book").agg(F.max_by(F.struct(*columns), "run_id").alias("r")).select("book", "r.*")


def previous_snapshot(runs: DataFrame, agent: str) -> DataFrame:
    """(run_id, snapshot): of the agent's last good run, null where its inputs are no JSON object or have none."""
    last = runs.where((F.col("agent") == agent) & (F.col("status") == "ok")).groupBy().agg(F.max_by(F.struct("run_id", "inputs"), "run_id").alias("r"))
    return last.where("r is not null").select("r.run_id", F.get_json_object(object_of(F.col("r.inputs")), "$.snapshot").alias("snapshot"))


def caveats(coverage: DataFrame, filings: DataFrame) -> DataFrame:
    """(what, n): symbols by price coverage, and scans that nobody has read."""
    scans = filings.where("doc_format = 'scanned' and parse_method is null").agg(F.lit("scanned unread").alias("what"), F.count("*").alias("n"))
    return coverage.groupBy(F.concat(F.lit("prices "), "status").alias("what")).agg(F.count("*").alias("n")).unionByName(scans)


def facts(week: str, performance: DataFrame, moves: DataFrame, books: DataFrame, pending: DataFrame, notes: DataFrame) -> DataFrame:
    """(week, section, facts): each section as a JSON array, in a fixed order, for a report's template. Sections have tens of rows."""
    parts = {"alerts": (performance, ["span", "horizon"]), "leaderboard": (moves, ["section", "rank", "member_id"]), "books": (books, ["book"]), "proposals": (pending, ["proposal_id"]), "caveats": (notes, ["what"])}
    out = None
    for name, (rows, order) in parts.items():
        columns = [*order, *(c for c in rows.columns if c not in order)]
        one = rows.groupBy().agg(F.to_json(F.sort_array(F.collect_list(F.struct(*columns)))).alias("facts")).select(F.lit(week).alias("week"), F.lit(name).alias("section"), "facts")
        out = one if out is None else out.unionByName(one)
    return out
