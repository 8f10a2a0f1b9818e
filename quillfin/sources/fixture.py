"""The driver's star schema presented as disclosure tables.

Only a fixture: the same statements make the tables in Spark and in the oracle
engine. Prices come from whole cents and counts, so both engines get equal doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

#: name -> SELECT; ``{hours}`` adds a number of hours to a timestamp.
TABLES = {
    "px_own": """
SELECT 'N' || CAST(s.s_nationkey AS STRING) AS symbol, CAST(l.l_shipdate AS DATE) AS date, l.l_linestatus AS st,
       CAST(floor(l.l_extendedprice * 100 / l.l_quantity) AS BIGINT) AS c, CAST(floor(l.l_discount * 1000 + 0.5) AS BIGINT) AS d
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey""",
    "px_sym": """
SELECT symbol, date,
       CAST(coalesce(sum(CASE WHEN st = 'O' THEN c END), 0) AS BIGINT) AS so, count(CASE WHEN st = 'O' THEN 1 END) AS no,
       CAST(coalesce(sum(CASE WHEN st = 'F' THEN c END), 0) AS BIGINT) AS sf, count(CASE WHEN st = 'F' THEN 1 END) AS nf,
       CAST(sum(d) AS BIGINT) AS sd, count(*) AS n, max(c) AS hi, min(c) AS lo
FROM px_own GROUP BY symbol, date""",
    "px_day": """
SELECT symbol, date, so, no, sf, nf, sd, n, hi, lo FROM px_sym
UNION ALL
SELECT 'SPY', date, CAST(sum(so) AS BIGINT), CAST(sum(no) AS BIGINT), CAST(sum(sf) AS BIGINT), CAST(sum(nf) AS BIGINT), CAST(sum(sd) AS BIGINT), CAST(sum(n) AS BIGINT), max(hi), min(lo) FROM px_sym GROUP BY date""",
    "px_run": """
SELECT symbol, date, no, nf, n, hi, lo,
       CAST(sum(so) OVER before AS BIGINT) AS os, CAST(sum(no) OVER before AS BIGINT) AS oc,
       CAST(sum(sf) OVER upto AS BIGINT) AS cs, CAST(sum(nf) OVER upto AS BIGINT) AS cc,
       CAST(sum(sd) OVER upto AS BIGINT) AS ds, CAST(sum(n) OVER upto AS BIGINT) AS dc
FROM px_day
WINDOW before AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING),
       upto AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)""",
    "px_oc": """
SELECT symbol, date, n, hi, lo, ds, dc,
       CASE WHEN no > 0 AND oc > 0 THEN CAST(os AS DOUBLE) / (CAST(oc AS DOUBLE) * 100) END AS open,
       CASE WHEN nf > 0 AND cc > 0 THEN CAST(cs AS DOUBLE) / (CAST(cc AS DOUBLE) * 100) END AS close
FROM px_run""",
    "prices": """
SELECT symbol, date, open,
       greatest(open, close) * (1 + CAST(hi % 40 AS DOUBLE) / 1000) AS high,
       least(open, close) * (1 - CAST(lo % 40 AS DOUBLE) / 1000) AS low,
       close, close * (1 - CAST(ds AS DOUBLE) / (CAST(dc AS DOUBLE) * 1000)) AS adj_close, n * 100 AS volume
FROM px_oc""",
    "members": """
SELECT 'M' || CAST(c_custkey % 97 AS STRING) AS member_id, 'Member ' || CAST(c_custkey % 97 AS STRING) AS name,
       min(CASE WHEN c_custkey % 97 % 3 = 0 THEN 'senate' ELSE 'house' END) AS chamber,
       min(c_mktsegment) AS party, min(CAST(c_nationkey AS STRING)) AS state, max(CASE WHEN c_custkey % 97 % 5 = 0 THEN 0 ELSE 1 END) AS active
FROM customer GROUP BY c_custkey % 97""",
    "filings": """
SELECT 'F' || CAST(o_orderkey AS STRING) AS doc_id,
       CASE WHEN o_orderkey % 53 = 0 THEN CAST(NULL AS STRING) ELSE 'M' || CAST(o_custkey % 97 AS STRING) END AS member_id,
       CASE WHEN o_custkey % 97 % 3 = 0 THEN 'senate' ELSE 'house' END AS chamber,
       CAST(o_orderdate AS DATE) AS filing_date,
       CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + {hours:CAST(o_orderkey % 24 AS INT)} AS available_at,
       CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + {hours:CAST(o_orderkey % 72 AS INT)} AS first_seen_at,
       CASE WHEN o_orderstatus = 'P' THEN 'filed' ELSE 'seen' END AS available_basis,
       CASE WHEN o_orderpriority LIKE '5%' AND o_orderkey % 3 = 0 THEN 'vision' WHEN o_orderkey % 7 = 0 THEN CAST(NULL AS STRING) ELSE 'text' END AS parse_method,
       CASE WHEN o_orderkey % 9 = 0 THEN 'scanned' ELSE 'electronic' END AS doc_format,
       CASE o_orderkey % 11 WHEN 0 THEN 'pending' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'failed' ELSE 'parsed' END AS parse_status,
       'Filer ' || CAST(o_custkey % 97 AS STRING) AS filer_name,
       CASE WHEN o_orderkey % 13 = 0 THEN CAST(NULL AS INT) ELSE CAST(year(o_orderdate) AS INT) END AS filing_year
FROM orders""",
    "line_once": """
SELECT * FROM (
  SELECT l.*, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS rn FROM lineitem l) x WHERE rn = 1""",
    "trades": """
SELECT l.l_orderkey * 10 + l.l_linenumber AS trade_id, f.doc_id, CAST(l.l_linenumber AS INT) AS line_no, f.member_id,
       'N' || CAST(s.s_nationkey AS STRING) AS ticker,
       CASE WHEN l.l_partkey % 29 = 0 THEN CAST(NULL AS STRING) ELSE 'N' || CAST(s.s_nationkey AS STRING) END AS symbol,
       CASE l.l_partkey % 17 WHEN 0 THEN 'none' WHEN 1 THEN 'delisted' WHEN 2 THEN 'unlisted' WHEN 3 THEN 'renamed' ELSE 'listed' END AS ticker_status,
       CASE WHEN l.l_returnflag = 'R' THEN 'SELL' WHEN l.l_partkey % 7 = 0 THEN 'SELL_PARTIAL' WHEN l.l_partkey % 41 = 0 THEN 'EXCHANGE' ELSE 'BUY' END AS action,
       CASE WHEN l.l_partkey % 11 = 0 THEN 'option' WHEN l.l_partkey % 23 = 0 THEN 'other' ELSE 'stock' END AS asset_type,
       'Asset ' || CAST(l.l_partkey AS STRING) AS asset_name,
       CASE WHEN l.l_partkey % 11 = 0 THEN CASE l.l_suppkey % 3 WHEN 0 THEN 'Call options' WHEN 1 THEN 'PUT options' ELSE 'Computer call' END END AS description,
       f.filing_date - CAST(l.l_partkey % 60 AS INT) AS tx_date, f.filing_date AS disclosure_date,
       CAST(CASE WHEN l.l_extendedprice < 10000 THEN 1001 WHEN l.l_extendedprice < 40000 THEN 15001 WHEN l.l_extendedprice < 80000 THEN 50001 ELSE 250001 END AS BIGINT) AS amount_min,
       CAST(CASE WHEN l.l_extendedprice < 10000 THEN 15000 WHEN l.l_extendedprice < 40000 THEN 50000 WHEN l.l_extendedprice < 80000 THEN 250000 END AS BIGINT) AS amount_max,
       CASE WHEN l.l_partkey % 31 = 0 THEN CAST(NULL AS INT) ELSE CAST(l.l_partkey % 60 AS INT) END AS filing_delay_days,
       CASE WHEN l.l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS committee_relevant, CASE WHEN l.l_partkey % 13 = 0 THEN 1 ELSE 0 END AS is_etf,
       CASE l.l_suppkey % 6 WHEN 0 THEN 'mega' WHEN 1 THEN 'large' WHEN 2 THEN 'mid' WHEN 3 THEN 'small' WHEN 4 THEN 'micro' END AS mcap_bucket,
       CASE l.l_suppkey % 4 WHEN 0 THEN 'Technology' WHEN 1 THEN 'Energy' WHEN 2 THEN 'Health' END AS sector
FROM line_once l JOIN filings f ON f.doc_id = 'F' || CAST(l.l_orderkey AS STRING) JOIN supplier s ON s.s_suppkey = l.l_suppkey""",
    "filing_alerts": """
SELECT doc_id, 'scanned' AS kind, first_seen_at AS sent_at FROM filings WHERE doc_format = 'scanned' AND filing_year % 2 = 0""",
    "proposals": """
SELECT CAST(substr(member_id, 2, 3) AS INT) AS proposal_id, CASE WHEN member_id LIKE '%1' OR member_id LIKE '%3' THEN 'remove' ELSE 'add' END AS kind, member_id,
       CASE WHEN member_id LIKE '%2' THEN 0 WHEN member_id LIKE '%4' THEN 1 END AS approved, CASE WHEN member_id LIKE '%4' THEN DATE '2001-05-01' END AS applied_on,
       CASE WHEN member_id LIKE '%22' THEN DATE '2001-01-01' WHEN member_id LIKE '%2' OR member_id LIKE '%4' THEN DATE '2001-06-01' END AS decided_on
FROM members WHERE member_id LIKE '%1' OR member_id LIKE '%2' OR member_id LIKE '%4' OR member_id LIKE '%7'""",
    "watchlist": """
SELECT member_id, CASE WHEN member_id IN ('M5', 'M50') THEN 0 ELSE 1 END AS active, 'watched' AS reason
FROM members WHERE member_id IN ('M1', 'M2', 'M3', 'M5', 'M8', 'M13', 'M21', 'M34', 'M50', 'M55')""",
    "alerts": """
SELECT trade_id * 2 + 1 AS alert_id, t.trade_id, f.available_at + {hours:1} AS sent_at, CAST(trade_id % 101 AS INT) AS score, 'watchlist' AS rule
FROM trades t JOIN filings f ON f.doc_id = t.doc_id WHERE t.action = 'BUY' AND t.trade_id % 19 = 0
UNION ALL
SELECT trade_id * 2, t.trade_id, f.available_at + {hours:3}, CAST(trade_id % 97 AS INT), 'held'
FROM trades t JOIN filings f ON f.doc_id = t.doc_id WHERE t.action = 'BUY' AND t.trade_id % 38 = 0""",
    "positions": """
SELECT t.trade_id AS position_id, t.trade_id, t.symbol AS ticker, f.filing_date + 1 AS buy_date, CAST(2800 + 50 * (t.trade_id % 90) AS DOUBLE) AS buy_price,
       CAST(1 + t.trade_id % 20 AS DOUBLE) AS shares,
       CASE t.trade_id % 5 WHEN 0 THEN 'fixed_hold(days=20)' WHEN 1 THEN 'trailing_stop(pct=0.1)' WHEN 2 THEN 'stop_target(stop=0.08, target=0.2)' WHEN 3 THEN 'atr_stop(mult=3, n=14)' ELSE 'member_sale()' END AS exit_rule,
       CASE WHEN t.trade_id % 3 = 0 THEN f.filing_date + 40 END AS sell_date, CASE WHEN t.trade_id % 3 = 0 THEN CAST(3000 + 40 * (t.trade_id % 80) AS DOUBLE) END AS sell_price,
       CASE WHEN t.trade_id % 3 = 0 THEN 'closed' ELSE 'open' END AS status
FROM trades t JOIN filings f ON f.doc_id = t.doc_id WHERE t.action = 'BUY' AND t.symbol IS NOT NULL AND t.trade_id % 211 = 0""",
    "exit_alerts": """
SELECT position_id, buy_date + 30 AS triggered_on, 'stop' AS reason FROM positions WHERE status = 'open' AND position_id % 7 = 3""",
    "runs": """
SELECT event_id AS run_id, CAST(ts AS TIMESTAMP) + {hours:CAST(floor(event_id / 500) AS INT) * 3} AS started_at,
       CAST(ts AS TIMESTAMP) + {hours:CAST(floor(event_id / 500) AS INT) * 3 + CAST(event_id % 2 AS INT)} AS finished_at,
       CASE WHEN event_id % 10 = 0 THEN 'failed' WHEN event_id % 17 = 0 THEN 'partial' ELSE 'ok' END AS status, props AS stages
FROM events""",
    "securities": """
SELECT 'N' || CAST(n_nationkey AS STRING) AS symbol, n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN 'Technology' WHEN 1 THEN 'Energy' WHEN 2 THEN 'Health' END AS sector,
       CASE WHEN n_nationkey % 8 = 7 THEN CAST(NULL AS DOUBLE) ELSE CAST(n_nationkey AS DOUBLE) * 12000000000 + 150000000 END AS market_cap
FROM nation""",
    "committees": """
SELECT 'M' || CAST(c_custkey % 97 AS STRING) AS member_id, CAST(104 + c_custkey % 4 AS INT) AS congress, 'C' || CAST(c_custkey % 6 AS STRING) AS committee_id
FROM customer GROUP BY c_custkey % 97, 104 + c_custkey % 4, c_custkey % 6""",
    "committee_sectors": """
SELECT 'C0' AS committee_id, 'Technology' AS sector UNION ALL SELECT 'C1', 'Energy' UNION ALL SELECT 'C3', 'Health' UNION ALL SELECT 'C4', 'Technology'""",
}
DRIVER = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def _hours(sql: str, form: str) -> str:
    while (a := sql.find("{hours:")) >= 0:
        b = sql.index("}", a)
        sql = sql[:a] + form.format(sql[a + 7 : b]) + sql[b + 1 :]
    return sql


def needed(*names: str) -> list[str]:
    """The fixture tables that these need, themselves included, in order."""
    import re

    want = set(names)
    for t in reversed(list(TABLES)):
        if t in want:
            want |= {u for u in TABLES if u != t and re.search(rf"\b{u}\b", TABLES[t])}
    return [t for t in TABLES if t in want]


def oracle(body: str, *names: str) -> str:
    """A statement for the oracle engine: ``body`` after the fixture tables it names."""
    import re

    names = names or tuple(t for t in TABLES if re.search(rf"\b{t}\b", body))
    ctes = [f"{t} AS ({_hours(TABLES[t], 'to_hours({})')})" for t in needed(*names)]
    return ("WITH " + ",\n".join(ctes) + ("" if body.lstrip().startswith(",") else "\n") + body) if ctes else body


MATERIALISED = ("px_sym", "prices", "positions")

#: What Spark runs in place of these: the same rows. Lines have the key of their filing and move once, by it, so that copies of a line, a line and its filing, and later a filing's trades are together. Filters on a trade's number, which both keys of a line give, apply before lines move.
MOVED_ONCE = {
    "line_once": TABLES["line_once"].replace("PARTITION BY l_orderkey", "PARTITION BY doc_id, l_orderkey"),
    "trades": TABLES["trades"].replace("f.doc_id = 'F' || CAST(l.l_orderkey AS STRING)", "f.doc_id = l.doc_id"),
}


class Fixture:
    """Lazily made fixture tables of one folder, by name.

    Made for one call of one query: tables and results that this query reads more than once are written once. Another call reads the folder again.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}
        self._kept: dict[str, DataFrame] = {}

    def keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The frame written under this name, made where there is none yet."""
        if name not in self._kept:
            self._kept[name] = written(make())
        return self._kept[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                parts = {t: self[t] for t in (*DRIVER, *TABLES) if t != name and self._mentions(name, t)}
                if name == "line_once":
                    parts["lineitem"] = parts["lineitem"].withColumn("doc_id", F.concat(F.lit("F"), F.col("l_orderkey").cast("string"))).repartition("doc_id")
                sql = _hours(MOVED_ONCE.get(name, TABLES[name]), "make_dt_interval(0, {})")
                for t in parts:
                    import re

                    sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
                make = lambda: self.spark.sql(sql, **parts)
                self._made[name] = self.keep(name, make) if name in MATERIALISED else make()
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    @staticmethod
    def _mentions(name: str, other: str) -> bool:
        import re

        return bool(re.search(rf"\b(FROM|JOIN) {other}\b", TABLES[name]))
