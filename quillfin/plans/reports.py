"""Reports and upkeep of tables: source race, review queue, leaderboard, factors, committees, downloads, research gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators.merge import merge
from .rankings import MIN_N, RANK_HORIZON
from .reads import congress_of

# Kinds of securities that are funds, statuses that a download may change, least score and age in hours of a brief.
FUNDS = ("ETF", "MUTUALFUND")
UNREAD = ("pending", "needs_review")
MIN_SCORE = 60
REUSE_HOURS = 24


def source_race(filings: DataFrame) -> DataFrame:
    """One row: which of two sources listed a filing first (``index_seen_at``, ``search_seen_at``), and by how many hours where the search did."""
    i, s = F.col("index_seen_at"), F.col("search_seen_at")
    lag = F.when(s < i, sc.hours_between(s, i))
    return filings.agg(
        F.count("*").alias("tracked"), F.count_if(i == s).alias("same"), F.count_if(s < i).alias("search_first"), F.count_if(i < s).alias("index_first"),
        F.count_if(i.isNull() & s.isNotNull()).alias("only_search"), F.count_if(i.isNotNull() & s.isNull()).alias("only_index"),
        F.median(lag).alias("median_lag_h"), F.max(lag).alias("max_lag_h"),
    )


def review_queue(filings: DataFrame, trades: DataFrame) -> DataFrame:
    """Filings by chamber and year (which may be null) in each state of reading, with the number of their trades."""
    status, scan = F.col("parse_status"), F.col("doc_format")
    per = filings.groupBy("chamber", F.col("filing_year").alias("year")).agg(
        F.count("*").alias("filings"), F.count_if(status == "parsed").alias("parsed"), F.count_if((status == "needs_review") & (scan == "scanned")).alias("scanned"),
        F.count_if((status == "needs_review") & (scan != "scanned")).alias("review"), F.count_if(status == "failed").alias("failed"), F.count_if(status == "pending").alias("pending"),
        F.count_if(F.col("available_basis") == "filed").alias("backfilled"),
    )
    counts = trades.groupBy("doc_id").agg(F.count("*").alias("n")).join(filings.select("doc_id", "chamber", "filing_year"), "doc_id")
    counts = counts.groupBy(F.col("chamber").alias("_c"), F.col("filing_year").alias("_y")).agg(F.sum("n").alias("trades"))
    met = per.join(counts, (F.col("chamber") == F.col("_c")) & F.col("year").eqNullSafe(F.col("_y")), "left")
    return met.withColumn("trades", F.coalesce("trades", F.lit(0).cast("long"))).drop("_c", "_y")


def unmatched_filers(filings: DataFrame, others: DataFrame) -> DataFrame:
    """(filer_name): names on filings without a member, each once, but for those known to be no members (``others``: filer_name)."""
    names = filings.where("member_id is null and filer_name is not null").select("filer_name").distinct()
    return names.join(others.select(F.col("filer_name").alias("_o")).distinct(), F.trim("filer_name") == F.col("_o"), "left_anti")


def leaderboard(stats: DataFrame, scores: DataFrame, members: DataFrame, horizon: int = RANK_HORIZON, limit: int = 30, rest: int = 10, min_n: int = MIN_N) -> DataFrame:
    """The report's lines in order (``line``): the best ``limit`` members with ``min_n`` filings by score and excess, then ``rest`` others by number of filings.

    ``place`` is null for the latter; consistency is shown at the ranking horizon only. Ties go by member.
    """
    rows = stats.where(F.col("horizon") == horizon).join(members.select("member_id", "name"), "member_id")
    consistent = F.col("consistency") if horizon == RANK_HORIZON else F.lit(None).cast("double")
    rows = rows.join(scores.select("member_id", "consistency"), "member_id", "left").withColumn("consistency", consistent)
    best = rows.where(F.col("n_filings") >= min_n).orderBy(F.desc("shrunk_score"), F.desc("mean_abn_ret"), "member_id").limit(limit)
    others = rows.where(F.col("n_filings") < min_n).orderBy(F.desc("n_filings"), "member_id").limit(rest)
    placed = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("shrunk_score"), F.desc("mean_abn_ret"), "member_id")))  # at most ``limit`` rows
    unplaced = others.withColumn("place", F.lit(None).cast("int"))
    return placed.unionByName(unplaced).withColumn("line", F.row_number().over(Window.orderBy(F.asc_nulls_last("place"), F.desc("n_filings"), "member_id")))


def factor_lines(factors: DataFrame) -> DataFrame:
    """Factors in the report's order (``line``): all trades first, then by factor and number of filings."""
    w = Window.orderBy(F.desc(F.col("factor") == "all"), "factor", F.desc("n"), "level")  # a row for each level of a factor
    return factors.withColumn("line", F.row_number().over(w))


def refreshed_members(stored: DataFrame, people: DataFrame) -> DataFrame:
    """``stored`` with new and changed people; nobody goes, and columns that ``people`` lacks, such as committees, stay."""
    return merge(stored, people, ["member_id"])


def with_committees(members: DataFrame, seats: DataFrame, today: Column) -> DataFrame:
    """``members`` with ``committees``: the names on this Congress's seats as a sorted JSON array, null without any. A committee without a name goes by its id."""
    now = seats.where(F.col("congress") == congress_of(today))
    names = now.groupBy("member_id").agg(F.to_json(F.sort_array(F.collect_list(F.coalesce("committee_name", "committee_id")))).alias("committees"))
    return members.drop("committees").join(names, "member_id", "left")


def content_format(content: Column) -> Column:
    """Documents that name a font have text; the others are scans."""
    return F.when(F.contains(content, F.lit(b"/Font")), "electronic").otherwise("scanned")


def downloaded(filings: DataFrame, files: DataFrame) -> DataFrame:
    """``filings`` after downloads (doc_id, raw_path, content): path and real format are recorded, and the status of what nobody has read yet follows the format."""
    new = files.select("doc_id", F.col("raw_path").alias("_path"), content_format(F.col("content")).alias("_format"))
    met = filings.join(new, "doc_id", "left")
    got = F.col("_format").isNotNull()
    status = F.when(F.col("_format") == "electronic", "pending").otherwise("needs_review")
    changed = {
        "raw_path": F.when(got, F.col("_path")).otherwise(F.col("raw_path")) if "raw_path" in filings.columns else F.col("_path"),
        "doc_format": F.coalesce("_format", "doc_format"),
        "parse_status": F.when(got & F.col("parse_status").isin(*UNREAD), status).otherwise(F.col("parse_status")),
    }
    return met.withColumns(changed).drop("_path", "_format")


def security_record(info: DataFrame) -> DataFrame:
    """(symbol, name, quote_type, sector, industry, market_cap, shares_outstanding, status) from quotes' fields: funds have the sector ETF and no size, and what has no type is missing."""
    known = F.coalesce(~F.col("quote_type").isin("", "NONE"), F.lit(False))
    fund = F.col("quote_type").isin(*FUNDS)
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    fields = {
        "name": F.coalesce(some("long_name"), F.col("short_name")), "quote_type": F.col("quote_type"), "sector": F.when(fund, "ETF").otherwise(F.col("sector")),
        "industry": F.when(fund, F.col("category")).otherwise(F.col("industry")), "market_cap": F.when(~fund, F.col("market_cap")), "shares_outstanding": F.col("shares_outstanding"),
    }
    return info.select("symbol", *(F.when(known, v).alias(k) for k, v in fields.items()), F.when(known, "ok").otherwise("missing").alias("status"))


def amount_text(low: Column, high: Column) -> Column:
    """A range of dollars in words."""
    dollars = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    return F.when(low.isNull(), "amount unknown").when(high.isNull(), F.concat(F.lit("over "), dollars(low - 1))).when(low == high, dollars(low)).otherwise(F.concat(dollars(low), F.lit("–"), dollars(high)))


def percent_text(x: Column, places: int = 1) -> Column:
    """A share with its sign, half away from zero."""
    value = F.format_number(F.abs(x) * 100, places)
    return F.when(x.isNull(), "n/a").otherwise(F.concat(F.when(x < 0, "-").otherwise("+"), F.replace(value, F.lit(",")), F.lit("%")))


def research_gate(buys: DataFrame, runs: DataFrame, now: Column, agent: str = "researcher", min_score: int = MIN_SCORE, hours: int = REUSE_HOURS) -> DataFrame:
    """(doc_id, buys, best, run_id, brief): filings with a buy (doc_id, symbol, score) good enough for a brief, and the brief to use again, if any.

    That is the output of the last good run (run_id, agent, status, started_at, inputs, output) for the filing within so many hours; an empty one is not used. Inputs that are no JSON name no filing.
    """
    high = buys.where((F.col("score") >= min_score) & (F.col("symbol") != "")).groupBy("doc_id").agg(F.count("*").alias("buys"), F.max("score").alias("best"))
    fresh = runs.where((F.col("agent") == agent) & (F.col("status") == "ok") & (F.col("started_at") >= now - F.make_dt_interval(hours=F.lit(hours))))
    last = fresh.withColumn("doc_id", F.try_variant_get(F.try_parse_json("inputs"), "$.doc_id", "string")).where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("run_id", "output")).alias("r"))
    usable = F.col("r.output") != ""
    return high.join(last, "doc_id", "left").select("doc_id", "buys", "best", F.when(usable, F.col("r.run_id")).alias("run_id"), F.when(usable, F.col("r.output")).alias("brief"))
