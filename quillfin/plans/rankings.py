"""Member rankings, entry delays and feature effects from outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clip_bounds, medians, sample_var, shrink
from ..session import written
from .outcomes import DELAYS, HORIZONS

MIN_N = 20
RANK_HORIZON = 20
YEAR_MIN_FILINGS = 3
FACTORS = ("mcap", "delay", "amount", "committee", "kind")


def matured(outcomes: DataFrame, horizons=HORIZONS) -> DataFrame:
    """(horizon, trade columns, ret, abn) of copyable buys whose horizon has passed."""
    by = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"ret_{h}").alias("ret"), F.col(f"abn_ret_{h}").alias("abn")) for h in horizons))).alias("x")
    return outcomes.where("copyable").select("*", by).where("x.ret is not null and x.abn is not null").select("trade_id", "doc_id", "member_id", "symbol", "d0_date", "x.*")


def filing_means(outcomes: DataFrame, horizons=HORIZONS, d0_before: str | None = None) -> DataFrame:
    """(horizon, member_id, doc_id, d0_year, n_trades, ret, spy, abn): one observation per filing."""
    rows = matured(outcomes, horizons).where("member_id is not null")
    if d0_before:
        rows = rows.where(F.col("d0_date") < F.lit(d0_before).cast("date"))
    per = rows.groupBy("horizon", "member_id", "doc_id").agg(F.count("*").alias("n_trades"), F.avg("ret").alias("ret"), F.avg("abn").alias("abn"), F.year(F.min("d0_date")).alias("d0_year"))
    return per.withColumn("spy", F.col("ret") - F.col("abn"))


def member_horizon_stats(outcomes: DataFrame, horizons=HORIZONS, d0_before: str | None = None) -> DataFrame:
    """Per member and horizon: unclipped means, median, hit rate, and the score shrunk on clipped excesses."""
    per = written(filing_means(outcomes, horizons, d0_before))
    bounds = clip_bounds(per, "abn", ["horizon"])
    clipped = per.join(F.broadcast(bounds), "horizon").withColumn("clip", F.greatest(F.least("abn", "high"), "low"))
    grouped = clipped.groupBy("horizon", "member_id").agg(
        F.count("*").alias("n_filings"), F.sum("n_trades").alias("n_trades"), F.avg("ret").alias("mean_ret"), F.avg("spy").alias("mean_spy_ret"),
        F.avg((F.col("abn") > 0).cast("double")).alias("hit_rate"),
        F.avg("clip").alias("_mean"), sample_var(F.col("clip")).alias("_var"),
    )
    grouped = grouped.join(medians(per, ["horizon", "member_id"], "abn", "median_abn_ret"), ["horizon", "member_id"])
    out = shrink(grouped, ["horizon"], "n_filings", "_mean", "_var", "shrunk_score")
    return out.withColumn("mean_abn_ret", F.col("mean_ret") - F.col("mean_spy_ret")).drop("_mean", "_var", "pooled")


def consistency(per: DataFrame) -> DataFrame:
    """(member_id, consistency): share of years with enough filings whose mean is above zero; null under two such years."""
    years = per.groupBy("member_id", "d0_year").agg(F.count("*").alias("n"), F.avg("abn").alias("m")).where(F.col("n") >= YEAR_MIN_FILINGS)
    return years.groupBy("member_id").agg(F.when(F.count("*") >= 2, F.avg((F.col("m") > 0).cast("double"))).alias("consistency"))


def member_scores(outcomes: DataFrame, horizon: int = RANK_HORIZON, min_n: int = MIN_N) -> DataFrame:
    """The ranking horizon's statistics with rank (eligible members only) and consistency."""
    stats = member_horizon_stats(outcomes, (horizon,))
    eligible = F.col("n_filings") >= min_n
    w = Window.partitionBy(eligible).orderBy(F.desc("shrunk_score"), F.desc("mean_abn_ret"), "member_id")
    ranked = stats.withColumn("rank", F.when(eligible, F.row_number().over(w)))
    return ranked.join(consistency(filing_means(outcomes, (horizon,))), "member_id", "left")


def inflation_groups(outcomes: DataFrame, trades: DataFrame | None = None, attention: list[str] = (), delays=DELAYS) -> DataFrame:
    """(group_type, group_key, k, doc_id, infl, n): per filing means of each copyable buy's open inflation, in every group it is part of.

    Without ``trades``, outcomes have their ``mcap_bucket``. A filing's trades meet once, for all groups and delays.
    """
    rows = outcomes.where("copyable")
    if trades is not None:
        rows = rows.join(trades.select("trade_id", "mcap_bucket"), "trade_id")
    infl = [f"open_infl_{k}" for k in delays]
    rows = rows.select("doc_id", "member_id", "mcap_bucket", *infl).where(F.coalesce(*infl).isNotNull()).repartition("doc_id")
    groups = F.array(
        F.struct(F.lit("all").alias("group_type"), F.lit("all").alias("group_key")),
        F.struct(F.lit("mcap").alias("group_type"), F.coalesce("mcap_bucket", F.lit("unknown")).alias("group_key")),
        F.struct(F.lit("attention").alias("group_type"), F.when(F.col("member_id").isin(*attention), "high").otherwise("other").alias("group_key")),
        F.struct(F.lit("member").alias("group_type"), F.col("member_id").alias("group_key")),
    )
    fanned = rows.select("doc_id", *infl, F.inline(groups)).where("group_key is not null")
    per = fanned.groupBy("group_type", "group_key", "doc_id").agg(*(f(c).alias(f"{n}_{c}") for c in infl for n, f in (("mean", F.avg), ("count", F.count))))
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"mean_{c}").alias("infl"), F.col(f"count_{c}").alias("n")) for k, c in zip(delays, infl)))
    return per.select("group_type", "group_key", "doc_id", F.inline(each)).where("infl is not null").select("group_type", "group_key", "k", "doc_id", "infl", "n")


def inflation_stats(groups: DataFrame, median: bool = True) -> DataFrame:
    """(group_type, group_key, k, n, n_trades, mean[, median], share_pos, shrunk_mean)."""
    by = ["group_type", "group_key", "k"]
    if median:
        groups = written(groups.drop("doc_id"))
    agg = groups.groupBy(*by).agg(
        F.count("*").alias("cnt"), F.sum("n").alias("n_trades"), F.avg("infl").alias("mean"),
        F.avg((F.col("infl") > 0).cast("double")).alias("share_pos"), sample_var(F.col("infl")).alias("_var"),
    )
    if median:
        agg = agg.join(medians(groups, by, "infl"), by)
    return shrink(agg, ["group_type", "k"], "cnt", "mean", "_var", "shrunk_mean").withColumnRenamed("cnt", "n").drop("_var", "pooled")


def entry_delays(stats: DataFrame, min_n: int = MIN_N) -> DataFrame:
    """Best delay per group: null under ``min_n`` filings, 0 if no delay pays, ties to the larger delay."""
    best = stats.groupBy("group_type", "group_key").agg(F.max("n").alias("n"), F.max("n_trades").alias("n_trades"), F.max(F.struct("shrunk_mean", "k")).alias("b"))
    enough, pays = F.col("n") >= min_n, F.col("b.shrunk_mean") > 0
    return best.select(
        "group_type", "group_key", "n", "n_trades", F.when(enough, F.when(pays, F.col("b.k")).otherwise(0)).alias("best_k"), F.when(enough, F.when(pays, F.col("b.shrunk_mean")).otherwise(0.0)).alias("gain")
    )


def levels() -> dict[str, Column]:
    """Factor -> level of a trade."""
    d, a = F.col("filing_delay_days"), F.coalesce("amount_min", F.lit(0))
    delay = F.when(d.isNull(), "unknown").when(d <= 7, "<=7d").when(d <= 14, "8-14d").when(d <= 30, "15-30d").when(d <= 45, "31-45d").otherwise(">45d")
    amount = F.when(a >= 250_001, "$250k+").when(a >= 50_001, "$50k-250k").when(a >= 15_001, "$15k-50k").otherwise("<$15k")
    kind = F.when(F.col("asset_type") == "option", "call").when(F.col("ticker_status") == "unlisted", "unlisted").when(F.coalesce("is_etf", F.lit(0)) != 0, "etf").otherwise("stock")
    return {
        "mcap": F.coalesce("mcap_bucket", F.lit("unknown")), "delay": delay, "amount": amount,
        "committee": F.when(F.coalesce("committee_relevant", F.lit(0)) != 0, "yes").otherwise("no"), "kind": kind,
    }


#: Columns of a trade that its factors' levels come from.
LEVELS_OF = ("mcap_bucket", "filing_delay_days", "amount_min", "committee_relevant", "asset_type", "ticker_status", "is_etf")


def signal_factors(outcomes: DataFrame, trades: DataFrame | None = None, horizon: int = RANK_HORIZON) -> DataFrame:
    """(factor, level, n, n_trades, mean, shrunk, effect): clipped excess per filing by level of each factor, and of all.

    Without ``trades``, outcomes have the columns of ``LEVELS_OF``. A filing's trades meet once, for all factors.
    """
    ok = F.col("copyable") & F.col(f"ret_{horizon}").isNotNull() & F.col(f"abn_ret_{horizon}").isNotNull()
    rows = outcomes.where(ok).withColumn("abn", F.col(f"abn_ret_{horizon}"))
    if trades is not None:
        rows = rows.join(trades.select("trade_id", *LEVELS_OF), "trade_id")
    rows = rows.select("doc_id", "abn", *LEVELS_OF).repartition("doc_id")
    fans = F.array(F.struct(F.lit("all").alias("factor"), F.lit("all").alias("level")), *(F.struct(F.lit(f).alias("factor"), v.alias("level")) for f, v in levels().items()))
    per = rows.select("doc_id", "abn", F.inline(fans)).groupBy("factor", "level", "doc_id").agg(F.avg("abn").alias("abn"), F.count("*").alias("c"))
    per = written(per.select("factor", "level", "abn", "c"))
    bounds = clip_bounds(per.where("factor = 'all'"), "abn", [])
    agg = per.crossJoin(F.broadcast(bounds)).groupBy("factor", "level").agg(
        F.count("*").alias("n"), F.sum("c").alias("n_trades"), F.avg(F.greatest(F.least("abn", "high"), "low")).alias("mean"), sample_var(F.greatest(F.least("abn", "high"), "low")).alias("_var")
    )
    return shrink(agg, ["factor"], "n", "mean", "_var").withColumn("effect", F.col("shrunk") - F.col("pooled")).drop("_var", "pooled")


def score_v1() -> tuple[Column, Column]:
    """(points 0 to 100, reasons) by fixed rules."""
    # fixed values
    amounts = ((500_001, 20), (250_001, 16), (100_001, 13), (50_001, 10), (15_001, 5))
    delays, late = ((7, 15), (14, 10), (30, 5), (45, 0)), -5
    text = F.lower(F.concat(F.coalesce("asset_name", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    call = (F.coalesce("asset_type", F.lit("")) == "option") & text.contains("call") & ~text.contains("put")
    amount = F.coalesce("amount_min", F.lit(0))
    bonus = F.lit(0)
    for low, p in reversed(amounts):
        bonus = F.when(amount >= low, p).otherwise(bonus)
    d = F.col("filing_delay_days")
    speed = F.lit(late)
    for limit, p in reversed(delays):
        speed = F.when(d <= limit, p).otherwise(speed)
    speed = F.when(d.isNull(), 0).otherwise(speed)
    etf = F.coalesce("is_etf", F.lit(0)) != 0
    listed = F.when(F.col("ticker_status").isin("listed", "renamed"), F.when(etf, 5).otherwise(15)).otherwise(-10)
    points = F.greatest(F.lit(0), F.least(F.lit(100), F.when(call, 40).otherwise(50) + bonus + speed + listed))
    reasons = F.array(
        F.when(call, "bought calls (as the stock) 40").otherwise("buy 50"),
        F.concat(F.lit("amount +"), bonus.cast("string")),
        F.when(d.isNull(), "delay unknown +0").otherwise(F.concat(F.lit("disclosed after "), d.cast("string"), F.lit("d "), F.when(speed >= 0, "+").otherwise(""), speed.cast("string"))),
        F.when(F.col("ticker_status").isin("listed", "renamed"), F.when(etf, "listed ETF +5").otherwise("listed stock +15")).otherwise("not on NYSE/Nasdaq -10"),
    )
    return points, reasons


def score_v2(trades: DataFrame, factors: DataFrame, scores: DataFrame, min_n: int = MIN_N) -> DataFrame:
    """``trades`` with ``expected`` (excess) and ``score``: the member's shrunk record, or the pooled mean, plus level effects."""
    pooled = factors.where("factor = 'all'").agg(F.max("shrunk").alias("pooled"))
    m = scores.select("member_id", F.col("shrunk_score").alias("_m"), F.col("n_filings").alias("_n"))
    out = trades.join(F.broadcast(pooled)).join(m, "member_id", "left")
    expected = F.when(F.col("_n") >= min_n, F.col("_m")).otherwise(F.col("pooled"))
    for f, level in levels().items():
        # at most a handful of levels per factor
        effect = factors.where(F.col("factor") == f).select(F.col("level").alias(f"_l_{f}"), F.col("effect").alias(f"_e_{f}"))
        out = out.withColumn(f"_l_{f}", level).join(F.broadcast(effect), f"_l_{f}", "left")
        expected = expected + F.coalesce(F.col(f"_e_{f}"), F.lit(0.0))
    points = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(50 + 1000 * F.col("expected"), 0).cast("int")))
    return out.withColumn("expected", expected).withColumn("score", points).drop("_m", "_n", "pooled", *(f"_{a}_{f}" for a in "le" for f in FACTORS))


def suggested_entry(trades: DataFrame, delays: DataFrame) -> DataFrame:
    """``trades`` with the best delay of the first group that has one: member, size, all."""
    known = delays.where("best_k is not null").select("group_type", "group_key", F.struct("best_k", "gain", "n", F.col("group_type").alias("basis")).alias("d"))
    m = known.where("group_type = 'member'").select(F.col("group_key").alias("member_id"), F.col("d").alias("_m"))
    c = F.broadcast(known.where("group_type = 'mcap'").select(F.col("group_key").alias("_b"), F.col("d").alias("_c")))
    a = F.broadcast(known.where("group_type = 'all'").agg(F.max("d").alias("_a")))
    out = trades.withColumn("_b", F.coalesce("mcap_bucket", F.lit("unknown"))).join(m, "member_id", "left").join(c, "_b", "left").join(a)
    s = F.coalesce("_m", "_c", "_a")
    return out.withColumns({"best_k": s["best_k"], "gain": s["gain"], "basis_n": s["n"], "basis": s["basis"]}).drop("_b", "_m", "_c", "_a")
