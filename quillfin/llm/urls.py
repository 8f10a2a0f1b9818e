"""URL filters: host and path rules, then association rules mined from labels.

URLs that a rule judges are the labelled ones. Spark's FP-growth mines their
token combinations with the label as one more item; combinations that imply
``block`` with enough confidence and support become rules. A URL that no host rule fits is blocked if it holds
all tokens of a mined rule: its tokens meet the rules' postings, and rules all of whose parts are
met are hits (an inverted index). DataFrame functions and Spark ML only.

Only least rules are mined, as one with another inside is met only where that one is. So (1) a token that implies
``block`` alone is a rule, and needs no combinations; (2) tokens that the same labelled URLs hold are one item
(in a least rule none of them stands beside another, as the rule without it has the same
URLs), met by any of them; (3) tokens too rare among blocked URLs are left out. What URLs are blocked is the same as with
all combinations. A URL in many copies with many parts of its own is thus one item, not two to the power of its
parts. FP-growth's work still grows with two to the power of the number of different items that are left in one URL.

URLs are matched once per set of tokens, so frequent hosts or copies are one row.
Null URLs and URLs without ``://`` have empty host and path and no tokens, and are allowed; repeated rows stay; very
long URLs are taken whole; of hits equally confident the one that comes last in order of its text is named; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.9
LABEL = "label="
#: Items and postings of at most this many rows are broadcast; more are joined by shuffle.
BROADCAST_RULES = 50_000


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judged(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, v) if verdict is None else F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens, sorted: the host's ending, its first label, parts of the path (numbers as #), query keys."""
    labels = F.split(host, r"\.")
    query = F.when(url.contains("://"), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)).otherwise(F.lit(""))
    number = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    return F.array_sort(
        F.array_distinct(
            F.concat(
                F.when(host != "", F.array(F.concat(F.lit("end="), F.element_at(labels, -1)), F.concat(F.lit("first="), F.element_at(labels, 1)))).otherwise(F.array().cast("array<string>")),
                F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), number(F.lower(x)))),
                F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.lower(F.substring_index(x, "=", 1)))),
            )
        )
    )


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(rules, members) from (tokens, verdict): rules (items, n_items, confidence, support) imply ``block``; members (item, token) says what tokens are an item."""
    spark = labelled.sparkSession
    baskets = checkpoint(labelled.groupBy("tokens").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("bad")))
    total, bad = (x or 0 for x in baskets.agg(F.sum("n"), F.sum("bad")).first())
    rules = spark.createDataFrame([], "items array<string>, n_items int, confidence double, support double")
    members = spark.createDataFrame([], "item string, token string")
    if not bad:
        return rules, members
    least = min_support * total
    # (count, sum and least of its sets' hashes): equal for tokens in the same sets
    mark = F.xxhash64("tokens")
    counted = baskets.select(F.explode("tokens").alias("token"), "n", "bad", mark.alias("h")).groupBy("token").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("sets"), F.sum(F.pmod("h", F.lit(1 << 40))).alias("s"), F.bit_xor("h").alias("x"), F.min("h").alias("m")
    )
    frequent = checkpoint(counted.where(F.col("bad") >= least))
    same = ["n", "bad", "sets", "s", "x", "m"]
    items = frequent.groupBy(*same).agg(F.min("token").alias("item"))
    members = checkpoint(frequent.join(items, same).select("item", "token"))
    sure = F.col("bad") / F.col("n") >= min_confidence
    alone = items.where(sure).select(F.array("item").alias("items"), F.lit(1).alias("n_items"), (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / total).alias("support"))
    open_ = F.broadcast(items.where(~sure).select(F.col("item").alias("token"))) if items.count() <= BROADCAST_RULES else items.where(~sure).select(F.col("item").alias("token"))
    short = baskets.select("tokens", F.explode("tokens").alias("token")).join(open_, "token").groupBy("tokens").agg(F.collect_list("token").alias("items")).where(F.size("items") > 1)
    left = checkpoint(labelled.join(short, "tokens").select(F.concat("items", F.array(F.concat(F.lit(LABEL), F.col("verdict")))).alias("items")))
    rows = left.count()
    if not rows:
        return checkpoint(alone), members
    # as many rows as are the least of all; FP-growth rounds up
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(math.ceil(least - 1e-9) - 0.5, 0.5) / rows), minConfidence=min_confidence).fit(left)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(LABEL + "block"))).where(~F.exists("antecedent", lambda x: x.startswith(LABEL)))
    found = checkpoint(found.where(F.size("antecedent") > 1).select(F.array_sort("antecedent").alias("items"), F.size("antecedent").alias("n_items"), "confidence", (F.col("support") * rows / total).alias("support")))
    # a rule that has another one inside adds nothing
    postings = found.select(F.col("items").alias("inner"), F.col("n_items").alias("size"), F.explode("items").alias("token"))
    whole = found.select("items", F.explode("items").alias("token"), F.col("n_items").alias("whole"))
    covered = whole.join(postings, "token").where("size < whole").groupBy("items", "inner", "size").count().where("count = size").select("items").distinct()
    return checkpoint(alone.unionByName(found.join(covered, "items", "left_anti"))), members


def classify(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, mined): mined is the association rule that blocked, if one did, as a JSON array of the tokens met."""
    url = F.col("url")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"))
    host, path = host_path(url)
    rows = rows.select("id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = judged(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), tokens(F.col("host"), F.col("path"), url).alias("tokens"))
    mined, members = mine(rows.where("verdict is not null").select("tokens", "verdict"), min_support, min_confidence)
    index = mined.select(F.to_json("items").alias("of"), "n_items", "confidence", F.explode("items").alias("item")).join(members, "item")
    index = checkpoint(index.select("of", "n_items", "confidence", "item", "token"))
    if index.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    sets = rows.where("verdict is null").select("tokens").distinct()
    parts = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").groupBy("tokens", "of", "n_items", "confidence", "item").agg(F.min("token").alias("token"))
    met = parts.groupBy("tokens", "of", "n_items", "confidence").agg(F.count("*").alias("n"), F.to_json(F.array_sort(F.collect_list("token"))).alias("mined")).where("n = n_items")
    best = met.groupBy("tokens").agg(F.max(F.struct("confidence", "mined")).alias("best"))
    joined = rows.join(best, "tokens", "left")
    by_method = F.col("verdict").isNull() & F.col("best").isNotNull()
    return joined.select(
        "id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("best").isNotNull(), "block").otherwise("allow")).alias("verdict"), F.when(by_method, F.col("best.mined")).alias("mined")
    )
