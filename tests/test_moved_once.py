"""Lines move once, by their filing's key, and what a bar gives is found once per bar, in code small enough to be compiled."""

import re

from quillfin.plans.queries import REGISTRY
from quillfin.sources.fixture import TABLES, Fixture


def test_lines_move_once(spark, sf):
    """Where only suppliers are broadcast, lines are shuffled once for the window and the join with their filings."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8000")
    try:
        fx = Fixture(spark, sf)
        plan = fx["trades"].join(fx["filings"].select("doc_id", "parse_status"), "doc_id").drop("ticker", "symbol")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert sum("doc_id" in x for x in moved) == 3 and not any("l_orderkey" in x or "l_linenumber" in x for x in moved)  # lines, and filings twice


def test_rows_are_those_of_the_statement(spark, sf):
    """Copies of a line and orders without a number, too."""
    fx = Fixture(spark, sf)
    lines = fx["lineitem"].limit(300)
    fx._made["lineitem"] = lines.unionByName(lines.withColumn("l_partkey", lines.l_partkey + 1)).unionByName(lines.selectExpr("CAST(NULL AS BIGINT) AS l_orderkey", *lines.columns[1:]))
    fx._made["lineitem"].createOrReplaceTempView("lineitem_twice")
    want = spark.sql(TABLES["line_once"].replace("FROM lineitem", "FROM lineitem_twice"))
    got = fx["line_once"].select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_compiled_methods(spark, sf):
    """The JVM interprets methods of more than 8,000 bytes."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = REGISTRY["d04_trade_outcomes"][0](Fixture(spark, sf))
        code = spark.sparkContext._jvm.org.apache.spark.sql.execution.debug.package.codegenString(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000
