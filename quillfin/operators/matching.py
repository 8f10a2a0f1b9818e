"""Resolution of filers to members and of tickers to symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import class_form, name_tokens


def resolve_members(filers: DataFrame, people: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(filer_name, chamber, state_district, member_id, status) of distinct filers.

    ``people``: member_id, last_name, given_names, house_seats, states (arrays), senator. All runs of
    words of a filer's name, up to the longest last name, meet last names in an equi-join, then: the seat, else its state, for the House;
    senators for the Senate; ties go to those that share a given name. One left over is the match. An override wins, ``-`` says
    there is no member.
    """
    f = filers.select("filer_name", "chamber", "state_district").where("filer_name is not null").distinct()
    f = f.withColumn("words", name_tokens(F.col("filer_name"))).withColumn("id", F.xxhash64("filer_name", "chamber", "state_district"))
    p = people.select("member_id", F.array_join(name_tokens(F.col("last_name")), " ").alias("last"), F.size(name_tokens(F.col("last_name"))).alias("n_words"), name_tokens(F.col("given_names")).alias("given"), "house_seats", "states", "senator").where("last <> ''")
    longest = p.agg(F.coalesce(F.max("n_words"), F.lit(1))).first()[0]
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice("words", i, n), " "))))
    keys = f.select("*", F.explode(F.array_distinct(runs)).alias("last"))
    named = keys.join(p, "last")
    seat = F.upper(F.coalesce("state_district", F.lit("")))
    exact = F.array_contains("house_seats", seat)
    level = F.when(F.col("chamber") == "house", F.when(exact, 2).when(F.array_contains("states", F.substring(seat, 1, 2)), 1)).otherwise(F.when(F.col("senator"), 2))
    found = named.withColumn("level", level).where("level is not null").withColumn("shared", F.arrays_overlap("given", "words").cast("int"))
    top = found.groupBy("id").agg(F.max("level").alias("level"))
    kept = found.join(top, ["id", "level"]).select("id", "member_id", "shared").groupBy("id", "member_id").agg(F.max("shared").alias("shared"))
    best = kept.groupBy("id").agg(F.count("*").alias("n"), F.sum("shared").alias("n_shared"), F.max("member_id").alias("any_id"), F.max(F.when(F.col("shared") == 1, F.col("member_id"))).alias("shared_id"))
    chosen = best.select("id", F.when(F.col("n") == 1, F.col("any_id")).when(F.col("n_shared") == 1, F.col("shared_id")).alias("member"))
    out = f.join(chosen, "id", "left")
    if overrides is not None:
        out = out.join(overrides.select(F.trim("filer_name").alias("_o"), F.trim("bioguide").alias("_b")), F.trim("filer_name") == F.col("_o"), "left")
        member = F.when(F.col("_b").isNotNull(), F.when(F.col("_b") != "-", F.col("_b"))).otherwise(F.col("member"))
        status = F.when(F.col("_b") == "-", "not a member").when(member.isNull(), "unmatched").otherwise("matched")
    else:
        member, status = F.col("member"), F.when(F.col("member").isNull(), "unmatched").otherwise("matched")
    return out.select("filer_name", "chamber", "state_district", member.alias("member_id"), status.alias("status"))


def resolve_tickers(trades: DataFrame, listed: DataFrame, aliases: DataFrame) -> DataFrame:
    """``trade_id, symbol, ticker_status, is_etf``: an alias in force on the trade's date, the listed symbol, its class form, else as filed.

    ``listed``: symbol, is_etf. ``aliases``: old, new (``-``: delisted), until.
    """
    a = aliases.where("new is not null and new <> ''").select(F.upper(F.trim("old")).alias("filed"), F.upper(F.trim("new")).alias("new"), "until")
    one, two, three = (listed.select(F.col("symbol").alias(f"s{k}"), F.col("is_etf").alias(f"e{k}")) for k in (1, 2, 3))
    rows = trades.select("trade_id", "tx_date", F.upper(F.trim("ticker")).alias("filed")).join(a, "filed", "left")
    rows = rows.withColumn("new", F.when(F.col("until").isNull() | F.col("tx_date").isNull() | (F.col("tx_date") < F.col("until")), F.col("new")))
    rows = rows.join(one, F.col("filed") == F.col("s1"), "left").join(two, class_form(F.col("filed")) == F.col("s2"), "left").join(three, F.col("new") == F.col("s3"), "left")
    none = F.coalesce("filed", F.lit("")) == ""
    status = F.when(none, "none").when(F.col("new") == "-", "delisted").when(F.col("new").isNotNull(), "renamed").when(F.col("s1").isNotNull() | F.col("s2").isNotNull(), "listed").otherwise("unlisted")
    symbol = F.when(none | (F.col("new") == "-"), None).otherwise(F.coalesce("new", "s1", "s2", "filed"))
    etf = F.when(none | (F.col("new") == "-"), False).when(F.col("new").isNotNull(), F.coalesce("e3", F.lit(False))).otherwise(F.coalesce("e1", "e2", F.lit(False)))
    return rows.select("trade_id", symbol.alias("symbol"), status.alias("ticker_status"), etf.alias("is_etf"))
