"""Statements for the oracle engine, over the fixture tables."""

from __future__ import annotations

from ..sources.fixture import oracle

H = (1, 5, 10, 20, 60)
K = (1, 2, 3, 5)
COPY = "(t.action = 'BUY' AND (coalesce(t.asset_type, '') <> 'option' OR (lower(coalesce(t.asset_name, '') || ' ' || coalesce(t.description, '')) LIKE '%call%' AND lower(coalesce(t.asset_name, '') || ' ' || coalesce(t.description, '')) NOT LIKE '%put%')))"

#: Named steps; each may use those before it and the fixture's tables.
STEPS = {
    "cal": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM prices WHERE symbol = 'SPY')",
    "scope": f"""SELECT t.*, {COPY} AS copyable, coalesce(f.available_at, f.first_seen_at) AS moment
FROM trades t JOIN filings f ON f.doc_id = t.doc_id
WHERE t.symbol IS NOT NULL AND t.ticker_status IN ('listed', 'renamed', 'unlisted') AND coalesce(f.parse_method, 'text') <> 'vision'""",
    # daylight saving by the rule in force until 2006: first Sunday of April to last Sunday of October
    "et": """SELECT s.*, moment - CASE WHEN
  moment >= CAST(make_date(year(moment), 4, 1) + CAST((7 - dayofweek(make_date(year(moment), 4, 1))) % 7 AS INT) AS TIMESTAMP) + to_hours(7)
  AND moment < CAST(make_date(year(moment), 10, 31) - CAST(dayofweek(make_date(year(moment), 10, 31)) AS INT) AS TIMESTAMP) + to_hours(6)
  THEN to_hours(4) ELSE to_hours(5) END AS eastern FROM scope s""",
    "entries": """SELECT e.*, (SELECT min(c.i) FROM cal c WHERE c.date >= CAST(e.eastern AS DATE) + CASE WHEN hour(e.eastern) * 60 + minute(e.eastern) < 570 THEN 0 ELSE 1 END) AS d0
FROM et e WHERE CAST(e.eastern AS DATE) >= (SELECT min(date) FROM cal)""",
    "ent": "SELECT e.*, c.date AS d0_date FROM entries e JOIN cal c ON c.i = e.d0",
    "bar": """SELECT p.symbol, c.i, CASE WHEN p.open > 0 THEN p.open END AS raw_open,
  CASE WHEN p.open > 0 AND p.close > 0 AND p.adj_close > 0 THEN p.open * p.adj_close / p.close END AS ao, CASE WHEN p.adj_close > 0 THEN p.adj_close END AS ac
FROM prices p JOIN cal c ON c.date = p.date""",
    "spy": "SELECT * FROM bar WHERE symbol = 'SPY'",
    "outcomes": "SELECT e.trade_id, e.doc_id, e.member_id, e.symbol, e.d0, e.d0_date, e.copyable, b0.raw_open AS d0_open, e.d0 + 60 < (SELECT count(*) FROM cal) AS complete"
    + "".join(f", b{h}.ac / b0.ao - 1 + 0 * s0.ao + 0 * s{h}.ac AS ret_{h}, b{h}.ac / b0.ao - 1 - (s{h}.ac / s0.ao - 1) AS abn_ret_{h}, CASE WHEN e.copyable THEN b{h}.ac / b0.ao - 1 - (s{h}.ac / s0.ao - 1) > 0 END AS win_{h}" for h in H)
    + ", b0.ao / bt.ac - 1 + 0 * s0.ao + 0 * st.ac AS tx_ret, b0.ao / bt.ac - 1 - (s0.ao / st.ac - 1) AS tx_abn_ret"
    + "".join(f", b0.raw_open / k{k}.raw_open - 1 AS open_infl_{k}" for k in K)
    + " FROM ent e LEFT JOIN bar b0 ON b0.symbol = e.symbol AND b0.i = e.d0 LEFT JOIN spy s0 ON s0.i = e.d0"
    + "".join(f" LEFT JOIN bar b{h} ON b{h}.symbol = e.symbol AND b{h}.i = e.d0 + {h} LEFT JOIN spy s{h} ON s{h}.i = e.d0 + {h}" for h in H)
    + "".join(f" LEFT JOIN bar k{k} ON k{k}.symbol = e.symbol AND k{k}.i = e.d0 + {k}" for k in K)
    + """ LEFT JOIN (SELECT e2.trade_id, max(c.i) AS ti FROM ent e2 JOIN cal c ON c.date <= e2.tx_date WHERE e2.tx_date < e2.d0_date GROUP BY e2.trade_id) x ON x.trade_id = e.trade_id
 LEFT JOIN bar bt ON bt.symbol = e.symbol AND bt.i = x.ti LEFT JOIN spy st ON st.i = x.ti""",
    "matured": " UNION ALL ".join(f"SELECT {h} AS horizon, trade_id, doc_id, member_id, d0_date, ret_{h} AS ret, abn_ret_{h} AS abn FROM outcomes WHERE copyable AND ret_{h} IS NOT NULL AND abn_ret_{h} IS NOT NULL" for h in H),
    "per_filing": "SELECT horizon, member_id, doc_id, count(*) AS n_trades, avg(ret) AS ret, avg(abn) AS abn, avg(ret) - avg(abn) AS spy_ret, year(min(d0_date)) AS y FROM matured WHERE member_id IS NOT NULL GROUP BY ALL",
    "cut": """SELECT horizon, max(CASE WHEN r = CAST(round_even(0.01::DOUBLE * (n - 1), 0) AS BIGINT) THEN abn END) AS low, max(CASE WHEN r = CAST(round_even(0.99::DOUBLE * (n - 1), 0) AS BIGINT) THEN abn END) AS high
FROM (SELECT horizon, abn, row_number() OVER (PARTITION BY horizon ORDER BY abn) - 1 AS r, count(*) OVER (PARTITION BY horizon) AS n FROM per_filing) GROUP BY horizon""",
    "by_member": """SELECT p.horizon, member_id, count(*) AS n_filings, sum(n_trades) AS n_trades, avg(ret) AS mean_ret, avg(spy_ret) AS mean_spy_ret, median(abn) AS median_abn_ret,
  avg(CASE WHEN abn > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) AS hit_rate, avg(least(greatest(abn, low), high)) AS m, coalesce(var_samp(least(greatest(abn, low), high)), 0) AS v
FROM per_filing p JOIN cut USING (horizon) GROUP BY p.horizon, member_id""",
}


def shrunk(source: str, scope: str, n: str, m: str, v: str, out: str) -> str:
    """SELECT of ``source`` with its shrunk mean and pooled mean, within ``scope`` (columns, or a constant)."""
    return f"""SELECT g.*, q.mu AS pooled, CASE WHEN q.n_groups < 2 THEN {m} ELSE q.mu + coalesce(tau2 / nullif(tau2 + q.s2 / {n}, 0), 1) * ({m} - q.mu) END AS {out}
FROM {source} g JOIN (
  SELECT a.*, greatest(coalesce(vm, 0) - s2 * inv, 0) AS tau2 FROM (
    SELECT {scope}, sum({n} * {m}) / sum({n}) AS mu, coalesce(sum(({n} - 1) * {v}) / nullif(sum({n} - 1), 0), 0) AS s2, count(*) AS n_groups, var_samp({m}) AS vm, avg(1 / CAST({n} AS DOUBLE)) AS inv
    FROM {source} GROUP BY {scope}) a) q USING ({scope})"""


STEPS |= {
    "member_stats": shrunk("by_member", "horizon", "n_filings", "m", "v", "shrunk_score"),
    "years": "SELECT member_id, y, count(*) AS n, avg(abn) AS m FROM per_filing WHERE horizon = 20 GROUP BY member_id, y HAVING count(*) >= 3",
    "steady": "SELECT member_id, CASE WHEN count(*) >= 2 THEN avg(CASE WHEN m > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) END AS consistency FROM years GROUP BY member_id",
    "scores": """SELECT s.*, mean_ret - mean_spy_ret AS mean_abn_ret, consistency,
  CASE WHEN n_filings >= 20 THEN row_number() OVER (PARTITION BY n_filings >= 20 ORDER BY shrunk_score DESC, mean_ret - mean_spy_ret DESC, s.member_id) END AS rank
FROM member_stats s LEFT JOIN steady c ON c.member_id = s.member_id WHERE horizon = 20""",
    "infl": " UNION ALL ".join(
        f"SELECT {g}, {k} AS k, doc_id, avg(open_infl_{k}) AS infl, count(*) AS c FROM outcomes o JOIN (SELECT trade_id, mcap_bucket FROM trades) t USING (trade_id) WHERE copyable AND open_infl_{k} IS NOT NULL{w} GROUP BY 1, 2, doc_id"
        for k in K
        for g, w in (
            ("'all' AS group_type, 'all' AS group_key", ""),
            ("'mcap' AS group_type, coalesce(mcap_bucket, 'unknown') AS group_key", ""),
            ("'attention' AS group_type, CASE WHEN member_id IN ('M1', 'M2', 'M3') THEN 'high' ELSE 'other' END AS group_key", ""),
            ("'member' AS group_type, member_id AS group_key", " AND member_id IS NOT NULL"),
        )
    ),
    "infl_groups": "SELECT group_type, group_key, k, count(*) AS n, sum(c) AS n_trades, avg(infl) AS mean, median(infl) AS median, avg(CASE WHEN infl > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) AS share_pos, coalesce(var_samp(infl), 0) AS v FROM infl GROUP BY ALL",
    "infl_stats": shrunk("infl_groups", "group_type, k", "n", "mean", "v", "shrunk_mean"),
    "delays": """SELECT group_type, group_key, max(n) AS n, max(n_trades) AS n_trades,
  CASE WHEN max(n) >= 20 THEN CASE WHEN max(shrunk_mean) > 0 THEN arg_max(k, (shrunk_mean, k)) ELSE 0 END END AS best_k, CASE WHEN max(n) >= 20 THEN greatest(max(shrunk_mean), 0) END AS gain
FROM infl_stats GROUP BY group_type, group_key""",
    "lev": """SELECT trade_id, coalesce(mcap_bucket, 'unknown') AS mcap,
  CASE WHEN filing_delay_days IS NULL THEN 'unknown' WHEN filing_delay_days <= 7 THEN '<=7d' WHEN filing_delay_days <= 14 THEN '8-14d' WHEN filing_delay_days <= 30 THEN '15-30d' WHEN filing_delay_days <= 45 THEN '31-45d' ELSE '>45d' END AS delay,
  CASE WHEN coalesce(amount_min, 0) >= 250001 THEN '$250k+' WHEN coalesce(amount_min, 0) >= 50001 THEN '$50k-250k' WHEN coalesce(amount_min, 0) >= 15001 THEN '$15k-50k' ELSE '<$15k' END AS amount,
  CASE WHEN committee_relevant <> 0 THEN 'yes' ELSE 'no' END AS committee,
  CASE WHEN asset_type = 'option' THEN 'call' WHEN ticker_status = 'unlisted' THEN 'unlisted' WHEN is_etf <> 0 THEN 'etf' ELSE 'stock' END AS kind FROM trades""",
    "fac": " UNION ALL ".join(
        f"SELECT '{f}' AS factor, {e} AS level, doc_id, avg(abn) AS abn, count(*) AS c FROM matured JOIN lev USING (trade_id) WHERE horizon = 20 GROUP BY 2, doc_id"
        for f, e in (("all", "'all'"), *((x, x) for x in ("mcap", "delay", "amount", "committee", "kind")))
    ),
    "fcut": """SELECT max(CASE WHEN r = CAST(round_even(0.01::DOUBLE * (n - 1), 0) AS BIGINT) THEN abn END) AS low, max(CASE WHEN r = CAST(round_even(0.99::DOUBLE * (n - 1), 0) AS BIGINT) THEN abn END) AS high
FROM (SELECT abn, row_number() OVER (ORDER BY abn) - 1 AS r, count(*) OVER () AS n FROM fac WHERE factor = 'all')""",
    "fgroups": "SELECT factor, level, count(*) AS n, sum(c) AS n_trades, avg(least(greatest(abn, low), high)) AS mean, coalesce(var_samp(least(greatest(abn, low), high)), 0) AS v FROM fac, fcut GROUP BY factor, level",
    "factors": shrunk("fgroups", "factor", "n", "mean", "v", "shrunk"),
}


def sql(body: str) -> str:
    """``body`` with the steps and fixture tables it needs put before it."""
    import re

    want: set[str] = set()
    for t in reversed(STEPS):
        if any(re.search(rf"\b(FROM|JOIN) {t}\b|, {t}\b", x) for x in (body, *(STEPS[u] for u in want))):
            want.add(t)
    steps = [t for t in STEPS if t in want]
    text = ", ".join(f"{t} AS ({STEPS[t]})" for t in steps)
    from ..sources.fixture import TABLES

    names = [t for t in TABLES if re.search(rf"\b{t}\b", text + body)]
    tail = f",\n{text}\n{body}" if names and steps else (f"WITH {text}\n{body}" if steps else body)
    return oracle(tail, *names) if names else tail
