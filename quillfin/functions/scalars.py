"""Normalisation of filed values, as column expressions."""

from __future__ import annotations

from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Source spellings of each action, owner and asset type, words that are no names, forms of tickers in names.
ACTIONS = {
    "p": "BUY", "purchase": "BUY", "s": "SELL", "sale": "SELL", "sale (full)": "SELL", "s (partial)": "SELL_PARTIAL", "sale (partial)": "SELL_PARTIAL", "e": "EXCHANGE", "exchange": "EXCHANGE",
}
OWNERS = {"": "self", "self": "self", "sp": "spouse", "spouse": "spouse", "jt": "joint", "joint": "joint", "dc": "dependent", "child": "dependent", "dependent": "dependent"}
STOCKS = ("st", "stock")
OPTIONS = ("op", "stock option", "option", "options")
NOISE = ("hon", "honorable", "the", "mr", "mrs", "ms", "dr", "jr", "sr", "ii", "iii", "iv", "v")
IN_PARENS = r"\(([A-Z][A-Z0-9.$/-]{0,7})\)"
LEADING = r"^([A-Z][A-Z.]{0,5}(?:-[A-Z])?)(?:\s*- |\s+(?:CALL|PUT)S?\b|$)"
OPTION_FIRST = r"^[A-Z][A-Z.]{0,5}(?:-[A-Z])?\s+(?:CALL|PUT)S?\b"


def clean(c: Column) -> Column:
    """Runs of white space, no-break spaces included, become one space; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s   -     　\x1c-\x1f\x85]+", " "))


def _mapped(c: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for x in chain(*values.items()))), F.lower(clean(c)))


def action(c: Column) -> Column:
    return _mapped(c, ACTIONS)


def owner(c: Column) -> Column:
    return _mapped(c, OWNERS)


def asset_type(code: Column) -> Column:
    x = F.lower(clean(code))
    return F.when(x.isin(*STOCKS), "stock").when(x.isin(*OPTIONS), "option").otherwise("other")


def option_first(asset: Column) -> Column:
    """An option written with its ticker first."""
    return clean(asset).rlike(OPTION_FIRST)


def dollars(x: Column) -> Column:
    """The dollar values in a clean text."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"\$\s*([\d,]+)"), F.lit(1)), lambda v: F.replace(v, F.lit(",")).cast("bigint"))


def amount(c: Column) -> tuple[Column, Column]:
    """(least, most) of a range: two values, "Over" one, one with a plus, or an exact one."""
    x = clean(c)
    return amount_of(x, dollars(x))


def amount_of(x: Column, values: Column) -> tuple[Column, Column]:
    """``amount`` of a clean text whose dollar values are known."""
    n, first = F.size(values), F.get(values, F.lit(0))
    over = F.lower(x).contains("over")
    low = F.when(n >= 2, first).when((n == 1) & over, first + 1).when(n == 1, first)
    high = F.when(n >= 2, F.get(values, F.lit(1))).when((n == 1) & (over | x.endswith("+")), None).when(n == 1, first)
    return low, high


def us_date(c: Column) -> Column:
    """A date written month/day/year, or null."""
    return F.when(clean(c).rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(clean(c), "M/d/yyyy"))


def any_date(c: Column) -> Column:
    """A date in any of the forms that scans give."""
    x = clean(c)
    forms = {r"^\d{1,2}/\d{1,2}/\d{4}$": "M/d/yyyy", r"^\d{4}-\d{2}-\d{2}$": "yyyy-MM-dd", r"^\d{1,2}/\d{1,2}/\d{2}$": "M/d/yy", r"^\d{1,2}-\d{1,2}-\d{4}$": "M-d-yyyy"}
    return F.coalesce(*(F.when(x.rlike(p), F.try_to_date(x, f)) for p, f in forms.items()))


def ticker(c: Column) -> Column:
    x = F.upper(clean(c))
    return F.when(~x.isin("", "--"), x)


def ticker_in_name(asset: Column) -> Column:
    """The last ticker in parentheses in an asset's name, else one at its start."""
    return ticker_of(clean(asset))


def ticker_of(x: Column) -> Column:
    """``ticker_in_name`` of a clean name."""
    lead = F.regexp_extract(x, LEADING, 1)
    return F.coalesce(F.try_element_at(F.regexp_extract_all(x, F.lit(IN_PARENS), F.lit(1)), F.lit(-1)), F.when(lead != "", lead))


def problems(row_owner: Column, row_action: Column, tx_date: Column, amount_min: Column, filed_on: Column) -> Column:
    """Names of the fields that are missing or can't be right."""
    late = F.coalesce(tx_date > filed_on, F.lit(False))
    named = {"owner": row_owner.isNull(), "action": row_action.isNull(), "tx_date": tx_date.isNull(), "amount_min": amount_min.isNull(), "tx_date after filing date": late}
    return F.array_compact(F.array(*(F.when(v, k) for k, v in named.items())))


def confidence(found: Column, vision: Column) -> Column:
    clean_row = F.when(vision, 0.7).otherwise(1.0)
    return F.when(F.size(found) == 0, clean_row).otherwise(0.5)


@F.pandas_udf(StringType())
def folded(names: pd.Series) -> pd.Series:
    """Names with accents taken off (compatibility decomposition without combining marks)."""
    return names.str.normalize("NFKD").str.replace("[\u0300-\u036f]", "", regex=True)


def name_tokens(name: Column) -> Column:
    """Lower-case words of a name without accents, titles and suffixes."""
    words = F.regexp_extract_all(F.lower(folded(F.coalesce(name, F.lit("")))), F.lit(r"[a-z][a-z'\-]*"), F.lit(0))
    return F.transform(F.filter(words, lambda w: ~w.isin(*NOISE)), lambda w: F.replace(w, F.lit("'")))


def listed_name(raw: Column) -> Column:
    """ "Last, Hon.. First" -> "Hon. First Last"."""
    x = F.regexp_replace(raw, r"\.{2,}", ".")
    last, rest = F.substring_index(x, ",", 1), F.when(x.contains(","), F.regexp_replace(x, r"^[^,]*,", "")).otherwise("")
    return clean(F.concat(F.trim(rest), F.lit(" "), F.trim(last)))


def full_name(first: Column, last: Column) -> Column:
    """First and last; names in capitals get title case."""
    x = clean(F.concat_ws(" ", first, last))
    return F.when((F.upper(x) == x) & (F.lower(x) != x), F.initcap(F.lower(x))).otherwise(x)


def doc_format(doc_id: Column) -> Column:
    return F.when(doc_id.startswith("2"), "electronic").otherwise("scanned")


def class_form(symbol: Column) -> Column:
    return F.regexp_replace(symbol, "[-/ ]", ".")


def source_form(symbol: Column) -> Column:
    return F.replace(symbol, F.lit("."), F.lit("-"))


def iso_week(day: Column) -> Column:
    """2026-W40, with the year of the week."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), day).cast("string"), 2, "0"))


def business_days(start: Column, end: Column) -> Column:
    """Weekdays after the start up to the end, in closed form."""

    def upto(d: Column) -> Column:
        n = F.datediff(d, F.lit("1970-01-05").cast("date"))  # a Monday
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(4))

    return (upto(end) - upto(start)).cast("int")


def hours_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("SECOND", a.cast("timestamp"), b.cast("timestamp")) / 3600


def flags(status: Column, parse_method: Column, conf: Column) -> Column:
    return F.array_compact(F.array(F.when(status == "unlisted", "unlisted"), F.when(status == "renamed", "renamed"), F.when(parse_method == "vision", "read from a scan"), F.when(conf < 1, "low confidence")))


def rule_parts(label: Column) -> tuple[Column, Column]:
    """(name, map of parameters) of a rule label such as ``trailing_stop(pct=0.1)``."""
    name = F.regexp_extract(label, r"^\s*([a-z_]+)\((.*)\)\s*$", 1)
    inner = F.regexp_extract(label, r"^\s*([a-z_]+)\((.*)\)\s*$", 2)
    return F.when(name != "", name), F.when(inner != "", F.str_to_map(F.regexp_replace(inner, r"\s", ""), F.lit(","), F.lit("=")))


def rule_text(label: Column) -> Column:
    """A rule in words."""
    name, p = rule_parts(label)
    pct = lambda k: F.concat(F.format_number(p[k].cast("double") * 100, 0), F.lit("%"))
    return (
        F.when(name == "fixed_hold", F.concat(F.lit("hold "), p["days"], F.lit(" trading days")))
        .when(name == "stop_target", F.concat_ws(", ", F.when(p["stop"] != "None", F.concat(F.lit("stop "), pct("stop"), F.lit(" below entry"))), F.when(p["target"] != "None", F.concat(F.lit("target "), pct("target"), F.lit(" above entry")))))
        .when(name == "trailing_stop", F.concat(F.lit("stop "), pct("pct"), F.lit(" below the high")))
        .when(name == "atr_stop", F.concat(F.lit("stop "), p["mult"], F.lit(" true ranges below the high")))
        .when(name == "member_sale", "sell when the member does")
    )
