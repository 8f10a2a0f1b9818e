"""Reports, upkeep of tables, the research gate and strangers' statements."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillfin.plans import reports as rp
from quillfin.sources import adhoc

T0 = datetime(2026, 3, 2, 12)


def test_a_brief_is_used_again_within_a_day_only(spark):
    buys = spark.createDataFrame([("a", "X", 60), ("a", "Y", 90), ("a", "Z", 59), ("b", "X", 70), ("c", "X", 99), ("d", "", 99), ("e", "X", None), ("f", "X", 80), ("g", "X", 61)], "doc_id string, symbol string, score int")
    hour = lambda n: T0 - timedelta(hours=n)
    runs = [
        (1, "researcher", "ok", hour(3), '{"doc_id": "a"}', "old"), (2, "researcher", "ok", hour(2), '{"doc_id": "a"}', "new"), (3, "researcher", "failed", hour(1), '{"doc_id": "a"}', "no"),
        (4, "researcher", "ok", hour(25), '{"doc_id": "b"}', "late"), (5, "other", "ok", hour(1), '{"doc_id": "b"}', "not mine"), (6, "researcher", "ok", hour(1), '{"doc_id": "c', "cut"),
        (7, "researcher", "ok", hour(1), None, "none"), (8, "researcher", "ok", hour(2), '{"doc_id": "f"}', "one"), (9, "researcher", "ok", hour(1), '{"doc_id": "f"}', ""), (10, "researcher", "ok", hour(24), '{"doc_id": "g"}', "just"),
    ]
    out = rp.research_gate(buys, spark.createDataFrame(runs, "run_id long, agent string, status string, started_at timestamp, inputs string, output string"), F.lit(T0))
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert got == {"a": (2, 90, 2, "new"), "b": (1, 70, None, None), "c": (1, 99, None, None), "f": (1, 80, None, None), "g": (1, 61, 10, "just")}


def test_downloads_change_only_what_nobody_has_read(spark):
    filings = spark.createDataFrame([(d, s, "electronic") for d, s in zip("abcde", ("pending", "needs_review", "parsed", "failed", "pending"), strict=True)], "doc_id string, parse_status string, doc_format string")
    files = spark.createDataFrame([("a", "p/a", b"x"), ("b", "p/b", b"%PDF /Font 1"), ("c", "p/c", b"\xff\x00"), ("d", "p/d", b"")], "doc_id string, raw_path string, content binary")
    got = {r.doc_id: (r.raw_path, r.doc_format, r.parse_status) for r in rp.downloaded(filings, files).collect()}
    assert got == {"a": ("p/a", "scanned", "needs_review"), "b": ("p/b", "electronic", "pending"), "c": ("p/c", "scanned", "parsed"), "d": ("p/d", "scanned", "failed"), "e": (None, "electronic", "pending")}
    again = {r.doc_id: r.raw_path for r in rp.downloaded(rp.downloaded(filings, files), files.where("doc_id = 'e'")).collect()}
    assert again["a"] == "p/a" and again["e"] is None


def test_members_stay_and_committees_are_of_this_congress(spark):
    stored = spark.createDataFrame([("a", "A", 1, "[]"), ("b", "B", 1, None)], "member_id string, name string, active int, committees string")
    people = spark.createDataFrame([("b", "Bee", 0), ("c", "C", 1)], "member_id string, name string, active int")
    out = rp.refreshed_members(stored, people)
    assert {r.member_id: (r.name, r.active, r.committees) for r in out.collect()} == {"a": ("A", 1, "[]"), "b": ("Bee", 0, None), "c": ("C", 1, None)}
    seats = spark.createDataFrame([("a", 119, "X1", "Rules"), ("a", 119, "X2", None), ("a", 118, "X3", "Old"), ("b", 118, "X1", "Rules")], "member_id string, congress int, committee_id string, committee_name string")
    got = {r.member_id: r.committees for r in rp.with_committees(out, seats, F.lit("2026-03-02").cast("date")).collect()}
    assert json.loads(got["a"]) == ["Rules", "X2"] and got["b"] is None and got["c"] is None


def test_source_race_and_review_queue(spark):
    rows = [("a", T0, T0), ("b", T0, T0 - timedelta(hours=2)), ("c", T0, T0 - timedelta(hours=5)), ("d", T0, T0 + timedelta(hours=1)), ("e", T0, None), ("f", None, T0), ("g", None, None)]
    got = rp.source_race(spark.createDataFrame(rows, "doc_id string, index_seen_at timestamp, search_seen_at timestamp")).first()
    assert tuple(got) == (7, 1, 2, 1, 1, 1, 3.5, 5.0)
    schema = "doc_id string, chamber string, filing_year int, parse_status string, doc_format string, available_basis string"
    filings = spark.createDataFrame([("a", "house", None, "needs_review", "scanned", "filed"), ("b", "house", None, "needs_review", "electronic", "seen"), ("c", "house", 2025, "parsed", None, None)], schema)
    trades = spark.createDataFrame([("a",), ("a",), ("b",), ("x",)], "doc_id string")
    got = {r.year: tuple(r)[2:] for r in rp.review_queue(filings, trades).collect()}
    assert got == {None: (2, 0, 1, 1, 0, 0, 1, 3), 2025: (1, 1, 0, 0, 0, 0, 0, 0)}
    empty = rp.source_race(spark.createDataFrame([], "index_seen_at timestamp, search_seen_at timestamp")).first()
    assert empty.tracked == 0 and empty.median_lag_h is None


def test_texts_and_security_records(spark):
    row = spark.range(1).select(*(rp.amount_text(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in ((None, 1), (50001, None), (1234567, 1234567), (1001, 15000))), *(rp.percent_text(F.lit(x).cast("double")) for x in (None, 0.1234, -12.5, 0.0)))
    assert tuple(row.first()) == ("amount unknown", "over $50,000", "$1,234,567", "$1,001–$15,000", "n/a", "+12.3%", "-1250.0%", "+0.0%")
    schema = "symbol string, long_name string, short_name string, quote_type string, sector string, category string, industry string, market_cap double, shares_outstanding long"
    info = [("A", None, "a", "EQUITY", "Tech", "c", "i", 5.0, 7), ("B", "b", "x", "ETF", None, "Large", "i", 5.0, None), ("C", "c", "c", "NONE", "s", "c", "i", 5.0, 1), ("D", "d", "d", None, "s", "c", "i", 5.0, 1)]
    got = {r.symbol: tuple(r)[1:] for r in rp.security_record(spark.createDataFrame(info, schema)).collect()}
    none = (None,) * 6
    assert got == {"A": ("a", "EQUITY", "Tech", "i", 5.0, 7, "ok"), "B": ("b", "ETF", "ETF", "Large", None, None, "ok"), "C": (*none, "missing"), "D": (*none, "missing")}


@pytest.mark.parametrize("text", ["DROP TABLE t", "SET a=b", "CACHE TABLE v", "INSERT INTO v VALUES (1)", "CREATE TABLE t AS SELECT 1", "CREATE TEMP VIEW w AS SELECT 1", "WITH a AS (SELECT 1) INSERT INTO v SELECT * FROM a", "BEGIN SELECT 1; END"])
def test_statements_that_do_something_are_refused(spark, text):
    spark.range(3).createOrReplaceTempView("v")
    got = adhoc.answer(spark, text)
    assert got.error and "not allowed" in got.content
    assert not spark.catalog.tableExists("w") and spark.table("v").count() == 3


def test_answers_are_bounded_in_rows_characters_and_time(spark):
    spark.range(500).createOrReplaceTempView("v")
    whole, more = adhoc.answer(spark, "SELECT id FROM v LIMIT 200;"), adhoc.answer(spark, "SELECT id, 'insert into' AS t FROM v")
    assert (whole.rows, whole.truncated) == (200, False) and (more.rows, more.truncated) == (200, True)
    assert json.loads(more.content)["rows"][0] == [0, "insert into"]
    wide = adhoc.answer(spark, "SELECT id, repeat('x', 1000) AS t FROM v")
    assert len(wide.content) <= adhoc.MAX_CHARS and wide.truncated and 0 < wide.rows < 200
    assert adhoc.answer(spark, "SELECT nothing FROM v").error and adhoc.answer(spark, "SELEC 1").error
    begun = datetime.now()
    slow = adhoc.answer(spark, "SELECT count_if(sha2(cast(id AS string), 512) LIKE 'a%') AS n FROM range(100000000000)", seconds=3)
    assert slow.error and "took over 3 s" in slow.content and (datetime.now() - begun).total_seconds() < 60
    assert adhoc.answer(spark, "SELECT count(*) AS n FROM v").rows == 1  # the session goes on
