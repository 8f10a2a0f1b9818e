"""Readers of raw listings, reports and reference files."""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from .adhoc import checked

CELL = re.compile(r"<t[dh]\b([^>]*)>(.*?)</t[dh]\s*>", re.S | re.I)
ROW = re.compile(r"<tr\b[^>]*>(.*?)</tr\s*>", re.S | re.I)
TABLE = re.compile(r"<table\b[^>]*>(.*?)</table\s*>", re.S | re.I)
TAG = re.compile(r"<[^>]*>")
#: Links to reports.
PTR_LINK = re.compile(r"ptr-pdfs/(\d{4})/(\w+)\.pdf", re.I)
REPORT_LINK = r"(?i)/search/view/(ptr|paper)/([0-9a-f-]{36})/"
#: Report table headers and the fields they name.
HEADERS = {
    "#": "line_no", "transaction date": "date", "owner": "owner", "ticker": "ticker", "asset name": "asset", "asset type": "asset_type", "type": "type", "amount": "amount", "comment": "comment",
}
REQUIRED = {"date", "owner", "asset", "type", "amount"}
RAW = "path string, position int, line_no string, date string, owner string, ticker string, asset string, asset_type string, type string, amount string, comment string"


def _text(cell: str) -> str:
    return " ".join(entities.unescape(TAG.sub(" ", cell)).split())


def house_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, year, filer_name, state_district, filing_date) of transaction reports in a yearly index (XML rows ``Member``)."""
    schema = "Prefix string, Last string, First string, Suffix string, FilingType string, StateDst string, Year int, FilingDate string, DocID string"
    rows = spark.read.format("xml").option("rowTag", "Member").schema(schema).load(path).where("FilingType = 'P'")
    name = sc.clean(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("Prefix", "First", "Last", "Suffix"))))
    return rows.select(F.col("DocID").alias("doc_id"), F.col("Year").alias("year"), name.alias("filer_name"), F.when(F.col("StateDst") != "", F.col("StateDst")).alias("state_district"), sc.us_date(F.col("FilingDate")).alias("filing_date"), sc.doc_format(F.col("DocID")).alias("doc_format"))


def house_search(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, year, filer_name, state_district) of transaction reports on search result pages."""

    def run(batches):
        for pdf in batches:
            out = []
            for page in pdf.value:
                for row in ROW.findall(page):
                    cells = {m[1]: body for attrs, body in CELL.findall(row) if (m := re.search(r'data-label="([^"]*)"', attrs))}
                    link = PTR_LINK.search(cells.get("Name", ""))
                    if link and _text(cells.get("Filing", "")).upper().startswith("PTR"):
                        anchor = re.search(r"<a\b[^>]*>(.*?)</a>", cells["Name"], re.S)
                        out.append((link[2], int(link[1]), _text(anchor[1] if anchor else cells["Name"]), _text(cells.get("Office", "")) or None))
            yield pd.DataFrame(out, columns=["doc_id", "year", "raw_name", "state_district"])

    rows = spark.read.text(path, wholetext=True).mapInPandas(run, "doc_id string, year int, raw_name string, state_district string")
    return rows.select("doc_id", "year", sc.listed_name(F.col("raw_name")).alias("filer_name"), "state_district")


def senate_search(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, kind, filer_name, filing_date, title) from arrays [first, last, office, link, date]."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("r")).where(F.size("r") >= 5)
    get = lambda i: F.get("r", F.lit(i))
    kind, doc = F.regexp_extract(get(3), REPORT_LINK, 1), F.regexp_extract(get(3), REPORT_LINK, 2)
    title = sc.clean(F.regexp_replace(get(3), "<[^>]*>", " "))
    return rows.where(doc != "").select(F.lower(doc).alias("doc_id"), F.lower(kind).alias("kind"), sc.full_name(get(0), get(1)).alias("filer_name"), sc.us_date(get(4)).alias("filing_date"), title.alias("title"))


def report_rows(spark: SparkSession, path: str) -> DataFrame:
    """Cells of the transaction tables of HTML reports, matched by header text: raw strings, a row each."""
    names = [c.split()[0] for c in RAW.split(", ")]

    def run(batches):
        for pdf in batches:
            out = []
            for where, page in zip(pdf.path, pdf.value):
                for table in TABLE.findall(page):
                    trs = ROW.findall(table)
                    columns = [HEADERS.get(_text(b).lower()) for _, b in CELL.findall(trs[0])] if trs else []
                    if not REQUIRED <= set(columns):
                        continue
                    for position, tr in enumerate(trs[1:], 1):
                        cells = [_text(b) for _, b in CELL.findall(tr)]
                        if len(cells) == len(columns):
                            row = {k: v for k, v in zip(columns, cells) if k}
                            out.append((where, position, *(row.get(n) for n in names[2:])))
                    break
            yield pd.DataFrame(out, columns=names)

    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return pages.mapInPandas(run, RAW)


def normalized(rows: DataFrame) -> DataFrame:
    """Report rows with enums, dates, amounts and tickers normalised."""
    low, high = sc.amount(F.col("amount"))
    number = F.when(F.col("line_no").rlike(r"^\d+$"), F.col("line_no").cast("int")).otherwise(F.col("position"))
    kind = F.when(sc.option_first(F.col("asset")), "option").otherwise(sc.asset_type(F.col("asset_type")))
    comment = F.when(~F.coalesce("comment", F.lit("")).isin("", "--"), F.col("comment"))
    return rows.select(
        "path", number.alias("line_no"), sc.owner(F.col("owner")).alias("owner"), F.coalesce("asset", F.lit("")).alias("asset_name"),
        F.coalesce(sc.ticker(F.col("ticker")), sc.ticker_in_name(F.col("asset"))).alias("ticker"), F.when(F.col("asset_type") != "", F.col("asset_type")).alias("asset_code"), kind.alias("asset_type"),
        sc.action(F.col("type")).alias("action"), sc.us_date(F.col("date")).alias("tx_date"), low.alias("amount_min"), high.alias("amount_max"), comment.alias("description"),
    )


def listed_symbols(spark: SparkSession, nasdaq: str, other: str) -> DataFrame:
    """(symbol, is_etf) of both pipe-separated lists, without test issues and footers; the second list wins."""

    def read(path: str, column: str, order: int) -> DataFrame:
        raw = spark.read.option("sep", "|").option("header", True).option("quote", "").csv(path)
        good = F.col(column).isNotNull() & ~F.col(column).startswith("File Creation Time") & (F.coalesce(F.col("`Test Issue`"), F.lit("")) != "Y")
        return raw.where(good).select(F.col(column).alias("symbol"), (F.col("ETF") == "Y").alias("is_etf"), F.lit(order).alias("o"))

    both = read(nasdaq, "Symbol", 1).unionByName(read(other, "ACT Symbol", 2))
    return both.groupBy("symbol").agg(F.coalesce(F.max_by("is_etf", "o"), F.lit(False)).alias("is_etf"))


def legislators(spark: SparkSession, path: str, active: bool, since: str = "2019-01-01") -> DataFrame:
    """People with a term ending since a date: member_id, name, chamber, party, state, active, last_name, given_names, house_seats, states, senator."""
    term = "array<struct<type:string,start:string,end:string,state:string,district:int,party:string>>"
    schema = f"id struct<bioguide:string>, name struct<first:string,middle:string,nickname:string,last:string,official_full:string>, terms {term}"
    rows = spark.read.option("multiLine", True).schema(schema).json(path)
    recent = F.filter("terms", lambda t: t["end"] >= since)
    last = F.try_element_at("terms", F.lit(-1))
    reps = F.filter(recent, lambda t: (t["type"] == "rep") & t["district"].isNotNull())
    return rows.where(F.size(recent) > 0).select(
        F.col("id.bioguide").alias("member_id"), F.coalesce("name.official_full", F.concat_ws(" ", "name.first", "name.last")).alias("name"), F.when(last["type"] == "sen", "senate").otherwise("house").alias("chamber"),
        F.substring(last["party"], 1, 1).alias("party"), last["state"].alias("state"), F.lit(active).alias("active"), F.col("name.last").alias("last_name"), F.concat_ws(" ", "name.first", "name.middle", "name.nickname").alias("given_names"),
        F.array_distinct(F.transform(reps, lambda t: F.concat(t["state"], F.lpad(t["district"].cast("string"), 2, "0")))).alias("house_seats"), F.array_distinct(F.transform(recent, lambda t: t["state"])).alias("states"), F.exists(recent, lambda t: t["type"] == "sen").alias("senator"),
    )


def committee_seats(spark: SparkSession, path: str, congress: int) -> DataFrame:
    """(member_id, congress, committee_id, role) of YAML membership files (committee key, then a list of people): subcommittees count for
    their parent; a title on the parent wins."""

    def run(batches):
        for pdf in batches:
            out = []
            for text in pdf.value:
                key = person = None
                for line in text.splitlines():
                    if m := re.match(r"([A-Z0-9]+):\s*$", line):
                        key = m[1]
                    elif m := re.match(r"(- |\s+)\s*(\w+):\s*(.*)$", line):
                        if m[1] == "- ":
                            person = {"key": key}
                            out.append(person)
                        if person is not None:
                            person[m[2]] = m[3].strip().strip("'\"")
            rows = [(p["bioguide"], p["key"], p.get("title")) for p in out if p.get("bioguide")]
            yield pd.DataFrame(rows, columns=["member_id", "key", "title"])

    rows = spark.read.text(path, wholetext=True).mapInPandas(run, "member_id string, key string, title string")
    parent = F.when(F.length("key") == 4, F.col("title"))
    return rows.groupBy("member_id", F.lit(congress).alias("congress"), F.substring("key", 1, 4).alias("committee_id")).agg(F.max(parent).alias("role"))


def lookup(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A small CSV with a header, by column names."""
    return spark.read.option("header", True).csv(path).select(*(F.trim(c).alias(c) for c in columns))


def bars(quotes: DataFrame) -> DataFrame:
    """Price rows from a source: no close, no row; NaN is null."""
    numbers = ["open", "high", "low", "close", "adj_close"]
    fixed = quotes.select("symbol", "date", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in numbers), F.col("volume").cast("bigint").alias("volume"))
    return fixed.where("close is not null")


def read_only(spark: SparkSession, sql: str, rows: int = 200) -> DataFrame:
    """A single SELECT over the session's views, with at most ``rows`` rows; anything else is refused."""
    return checked(spark, sql).limit(rows)
