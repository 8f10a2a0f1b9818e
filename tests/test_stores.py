"""Versioned tables, decisions, report windows, numbering and range maxima."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillfin.functions.stats import clip_bounds, shrink
from quillfin.operators import numbering
from quillfin.operators.rangemax import range_max, sparse_table
from quillfin.operators.snapshots import Conflict, Versioned
from quillfin.plans import decisions as dn

ROW = "id long, v string"


def state(table, version=None):
    return {r.id: r.v for r in table.read(version).collect()}


def test_a_commit_replaces_only_buckets_that_changed(spark, tmp_path):
    t = Versioned(spark, f"{tmp_path}/t", ROW, ["id"], buckets=8)
    assert t.version() == 0 and state(t) == {}
    rows = spark.range(100).select("id", F.lit("a").alias("v"))
    assert t.commit(rows, 0) == {"added": 100, "changed": 0, "removed": 0, "buckets": 8, "version": 1}
    assert t.commit(rows, 1)["version"] == 1  # nothing differs, nothing is written
    out = t.commit(rows.where("id <> 7").withColumn("v", F.when(F.col("id") == 3, "b").otherwise(F.col("v"))), 1)
    assert (out["changed"], out["removed"], out["version"]) == (1, 1, 2) and out["buckets"] <= 2
    assert state(t) == {i: "b" if i == 3 else "a" for i in range(100) if i != 7}
    assert state(t, 1) == dict.fromkeys(range(100), "a")  # old versions stay
    assert t.commit(rows.where("false"), 2)["removed"] == 99 and state(t) == {}


def test_of_two_writers_one_wins_and_the_other_starts_over(spark, tmp_path):
    path = f"{tmp_path}/t"
    mine, other = (Versioned(spark, path, ROW, ["id"]) for _ in range(2))
    mine.commit(spark.createDataFrame([(1, "a")], ROW), 0)
    other.commit(spark.createDataFrame([(1, "b")], ROW), 1)
    with pytest.raises(Conflict):
        mine.commit(spark.createDataFrame([(1, "c")], ROW), 1)
    assert state(mine) == {1: "b"}
    raced = []

    def change(rows):
        if not raced:  # the other writer commits between our reading and our commit
            raced.append(other.commit(spark.createDataFrame([(1, "b"), (2, "x")], ROW), 2))
        return rows.withColumn("v", F.concat("v", F.lit("!")))

    mine.update(change)
    assert state(mine) == {1: "b!", 2: "x!"}


def test_a_half_written_version_is_none(spark, tmp_path):
    t = Versioned(spark, f"{tmp_path}/t", ROW, ["id"])
    t.commit(spark.createDataFrame([(1, "a")], ROW), 0)
    (tmp_path / "t/log/000000002").write_text("{")
    assert t.version() == 1 and state(t) == {1: "a"}


def test_decisions_are_applied_once_and_in_order(spark, tmp_path):
    desk = dn.Desk(spark, str(tmp_path))
    t0 = datetime(2001, 1, 1)
    asked = [(1, "add", "A", "p1"), (2, "remove", "A", "p2"), (3, "remove", "A", "p3"), (4, "remove", "B", "p4"), (5, "note", None, "p5"), (6, "sing", "C", "p6"), (7, "add", "D", "p7")]
    desk.proposals.commit(spark.createDataFrame([(*p, None, None, None, None) for p in asked], dn.PROPOSALS), 0)
    desk.watchlist.commit(spark.createDataFrame([("B", t0, "old", 1, t0)], dn.WATCHLIST), 0)
    ask = lambda ids, ok: spark.createDataFrame([(i, ok, t0) for i in ids], "proposal_id int, approved int, decided_at timestamp_ntz")
    assert {r.proposal_id: r.state for r in desk.decide(ask([1, 2, 3, 4, 5, 6, 99], 1)).collect()} == {**dict.fromkeys(range(1, 7), "decided"), 99: "not found"}
    # the run dies after its first commit: the next one brings the watchlist up to date
    desk.proposals.update(lambda p: dn.apply_approved(p, desk.watchlist.read(), datetime(2001, 1, 2)))
    assert {r.member_id for r in desk.watchlist.read().collect()} == {"B"}
    desk.apply(datetime(2001, 1, 3))
    results = {r.proposal_id: r.apply_result for r in desk.proposals.read().collect()}
    assert results == {1: "applied", 2: "applied", 3: "failed: not on the watchlist any more", 4: "applied", 5: "acknowledged", 6: "failed: unknown kind sing", 7: None}
    watched = {r.member_id: (r.active, r.reason, r.changed_at) for r in desk.watchlist.read().collect()}
    assert watched == {"A": (0, "p1", datetime(2001, 1, 2)), "B": (0, "old", datetime(2001, 1, 2))}
    assert [r.state for r in desk.decide(ask([1], 0)).collect()] == ["already applied"]
    version = desk.watchlist.version()
    desk.apply(datetime(2001, 1, 4))
    assert desk.watchlist.version() == version


def test_every_row_is_in_one_report(spark, tmp_path):
    markers = Versioned(spark, f"{tmp_path}/m", dn.MARKERS, ["source"])
    rows = spark.createDataFrame([(i, datetime(2001, 1, 1 + i)) for i in range(9)], "id int, at timestamp_ntz")
    sent = {}

    def write(df, name):
        sent[name] = sorted(r.id for r in df.collect())

    def broken(df, name):
        write(df, name)
        raise OSError

    dn.report(markers, "d", rows, "at", datetime(2001, 1, 2), write)
    with pytest.raises(OSError):
        dn.report(markers, "d", rows, "at", datetime(2001, 1, 5), broken)
    dn.report(markers, "d", rows, "at", datetime(2001, 1, 6), write)
    dn.report(markers, "d", rows, "at", datetime(2001, 1, 6), write)  # nothing left
    assert list(sent.values()) == [[0], [1, 2, 3, 4]]
    dn.report(markers, "other", rows, "at", datetime(2001, 1, 8), write)
    assert sorted(r.source for r in markers.read().collect()) == ["d", "other"]


def test_numbers_and_batches(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("id")).repartition(5)
    got = sorted((r.id, r.n) for r in numbering.numbered(rows, ["id"]).collect())
    assert [n for _, n in got] == list(range(1, 1001))
    plan = numbering.numbered(rows, ["id"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    assert numbering.numbered(rows.where("false"), ["id"]).collect() == []
    starts = spark.createDataFrame([(f"s{i:03d}", i // 40) for i in range(120)], "k string, start int")
    out = sorted((r.batch, r.start, len(r["keys"]), r["keys"][0]) for r in numbering.batches(starts, "k", "start").collect())
    assert out == [(0, 0, 50, "s000"), (1, 1, 50, "s050"), (2, 2, 20, "s100")]


@pytest.mark.parametrize("n", [1, 2, 3, 51, 400])
def test_clip_bounds_are_those_of_the_sorted_values(spark, n):
    rng = random.Random(n)
    values = {s: [rng.randint(0, 30) / 4 for _ in range(n * (k + 1))] for k, s in enumerate("ab")}
    df = spark.createDataFrame([(s, v) for s, vs in values.items() for v in vs] + [("a", None)], "s string, v double")
    place = lambda x, share: sorted(x)[round(share * (len(x) - 1))]
    assert {r.s: (r.low, r.high) for r in clip_bounds(df, "v", ["s"]).collect()} == {s: (place(x, 0.01), place(x, 0.99)) for s, x in values.items()}
    every = sum(values.values(), [])
    assert [tuple(r) for r in clip_bounds(df, "v", []).collect()] == [(place(every, 0.01), place(every, 0.99))]


def test_shrinkage_without_a_scope_is_that_of_one(spark):
    df = spark.createDataFrame([(f"g{i}", 5 + i, i * 0.01, 0.02 + i * 0.001, 1) for i in range(8)], "g string, n int, mean double, var double, all int")
    got = lambda x: {r.g: (round(r.shrunk, 12), round(r.pooled, 12)) for r in x.collect()}
    assert got(shrink(df, [])) == got(shrink(df, ["all"]))


def test_range_maxima(spark):
    rng = random.Random(4)
    series = {s: [rng.choice([None, rng.random()]) for _ in range(n)] for s, n in (("a", 1), ("b", 37), ("c", 64))}
    bars = spark.createDataFrame([(s, i, v) for s, x in series.items() for i, v in enumerate(x)], "s string, i int, v double")
    table = sparse_table(bars, "s", "i", "v", 64)
    asked = [(s, a, b) for s, x in series.items() for a in range(len(x)) for b in range(a - 1, len(x), 5)] + [("zz", 0, 3), ("a", None, 0)]
    got = range_max(spark.createDataFrame(asked, "s string, lo long, hi long"), table, "s", "i", "lo", "hi", "most")
    want = {(s, a, b): max((v for v in series[s][a : b + 1] if v is not None), default=None) if s in series and a is not None else None for s, a, b in asked}
    assert {(r.s, r.lo, r.hi): r.most for r in got.collect()} == want


# --- streams and sources


def test_rules_fire_once_whatever_restarts(spark, tmp_path):
    from quillfin.streaming.watch import replayed

    day = lambda d, h=0: datetime(2001, 1, d, h)
    schema = "position_id long, tick long, at timestamp, price double, stop double, target double"
    ticks = [
        [(1, 1, day(1), 10.0, 9.0, 12.0), (1, 3, day(1, 5), 8.0, 9.0, 12.0), (1, 2, day(1, 5), 8.5, 9.0, 12.0), (2, 4, day(1), 10.0, 9.0, 12.0)],
        [(1, 5, day(2), 7.0, 9.0, 12.0), (1, 6, day(3), 13.0, 9.0, 12.0), (2, 7, day(3), 10.0, 9.0, 12.0), (2, 8, day(9), 10.0, 9.0, 12.0)],
        [(1, 9, day(10), 8.0, 9.0, 12.0), (2, 10, day(10), 12.0, 9.0, 12.0), (3, 11, day(10), None, 9.0, None)],
    ]
    parts = [spark.createDataFrame(t, schema) for t in ticks]
    got = sorted((r.position_id, r.rule, r.at, r.price) for r in replayed(spark, parts, str(tmp_path), 5).collect())
    assert got == [(1, "hold", day(6), None), (1, "stop", day(1, 5), 8.5), (1, "target", day(3), 13.0), (2, "hold", day(6), None), (2, "target", day(10), 12.0)]


def test_only_changed_pages_are_read_again(spark, tmp_path):
    import json

    from quillfin.sources import remote

    def publish(page, rows):
        (tmp_path / f"in/page={page}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"in/page={page}/a.json").write_text(json.dumps({"total": 5, "data": rows}))

    publish(0, [["F1", "one"], ["F2", "two"]])
    publish(1, [["F3", "three"]])
    path, table, state = (f"{tmp_path}/{x}" for x in ("in", "table", "state"))
    assert remote.listing(spark, path).rdd.getNumPartitions() == 2
    assert sorted(tuple(r) for r in remote.listing(spark, path).collect()) == [(0, 0, "F1", "one"), (0, 1, "F2", "two"), (1, 0, "F3", "three")]
    remote.follow(spark, path, table, state)
    publish(1, [["F3", "three"], ["F4", "four"]])
    publish(2, [["F5", "five"]])
    remote.follow(spark, path, table, state)
    remote.follow(spark, path, table, state)  # nothing new
    seen = sorted(r.doc_id for r in spark.read.parquet(table).collect())
    assert seen == ["F1", "F2", "F3", "F3", "F4", "F5"]  # page 0 once, page 1 twice


def test_filters_reach_the_source_of_quotes(spark, tmp_path):
    from datetime import date

    from quillfin.sources import remote

    rows = [(s, date(2001, 1, d), 1.0, 1.0, 1.0, float(d), 1.0, 1) for s in "ABC" for d in range(1, 11)]
    remote.publish_quotes(spark.createDataFrame(rows, remote.QUOTES), str(tmp_path))
    q = remote.quotes(spark, str(tmp_path)).where("symbol in ('A', 'C', 'Z') and date > '2001-01-03' and date <= '2001-01-05' and close < 5")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "close" in plan.split("Filter", 1)[1].split("\n")[0] and "symbol" not in plan.split("Filter", 1)[1].split("\n")[0]  # only the close is left to Spark
    assert q.rdd.getNumPartitions() == 2
    assert sorted((r.symbol, r.date.day) for r in q.collect()) == [("A", 4), ("C", 4)]
    assert remote.quotes(spark, str(tmp_path)).where("symbol = 'Z'").count() == 0
    assert remote.quotes(spark, str(tmp_path)).count() == 30


def brute_due(p, bars, days):
    """(reason, day) of one position with a trailing stop of a tenth, by a plain walk."""
    later = [d for d in days if d >= p["buy"]]
    own = [b for b in bars if b[0] >= p["buy"]]
    if not later or not own or abs(own[0][4] / p["price"] - 1) > 0.4:
        return None
    high = p["price"]
    for k, (day, op, hi, lo, cl) in enumerate(own):
        stop, held = high * 0.9, days.index(day) - days.index(later[0])
        if k == 0 and day == later[0]:
            if cl <= stop:
                return "stop", day
            high = max(high, cl)
            continue
        if held > 60:
            return "hold", day
        if op <= stop or lo <= stop:
            return "stop", day
        if held == 60:
            return "hold", day
        high = max(high, hi)
    gap = len(days) - 1 - days.index(own[-1][0])
    return ("data_end", own[-1][0]) if gap >= 5 else None


def test_due_exits_are_those_of_a_plain_walk(spark):
    from datetime import date, timedelta

    from quillfin.operators import exits as ex
    from quillfin.plans import positions as ps

    rng = random.Random(11)
    days = [date(2001, 1, 1) + timedelta(d) for d in range(140)]
    prices = [("SPY", d, 1.0, 1.0, 1.0, 1.0, 1.0, 1) for d in days]
    walks = {}
    for k in range(12):
        level, own = 100.0, []
        for i, d in enumerate(days[: 140 if k % 3 else 100 + k * 4]):
            level *= 1 + rng.uniform(-0.012, 0.013)
            if (i + k) % 11 == 0:
                continue  # a gap
            op, cl = level * rng.uniform(0.99, 1.01), level
            own.append((d, op, max(op, cl) * 1.01, min(op, cl) * 0.99, cl))
        walks[f"S{k}"] = own
        prices += [(f"S{k}", d, o, h, low, c, c, 1) for d, o, h, low, c in own]
    held = [{"id": n, "symbol": f"S{n % 12}", "buy": date(2000, 12, 30) + timedelta(rng.randint(0, 150)), "price": rng.choice([98.0, 102.0, 300.0])} for n in range(60)]
    rows = [(p["id"], None, p["symbol"].lower(), p["buy"], p["price"], 1.0, "trailing_stop(pct=0.1)", None, None, "open") for p in held]
    positions = spark.createDataFrame(rows, "position_id long, trade_id long, ticker string, buy_date date, buy_price double, shares double, exit_rule string, sell_date date, sell_price double, status string")
    bars = spark.createDataFrame(prices, "symbol string, date date, open double, high double, low double, close double, adj_close double, volume long")
    trades = spark.createDataFrame([], "trade_id long, member_id string, symbol string, doc_id string, action string")
    filings = spark.createDataFrame([], "doc_id string, available_at timestamp_ntz, first_seen_at timestamp_ntz")
    sent = spark.createDataFrame([(5,)], "position_id long")
    found = ps.due_exits(positions, trades, filings, bars, {"trailing_stop(pct=0.1)": ex.Rule("trailing_stop", pct=0.1)}, sent)
    got = {r.position_id: (r.reason, r.day) for r in found.collect()}
    want = {p["id"]: hit for p in held if p["id"] != 5 and (hit := brute_due(p, walks[p["symbol"]], days)) is not None}
    unseen = {p["id"] for p in held if not [b for b in walks[p["symbol"]] if b[0] >= p["buy"]]}
    assert {k: v for k, v in got.items() if k not in unseen} == want
    assert {v[0] for k, v in got.items() if k in unseen} <= {"data_end"} and len({v[0] for v in want.values()}) >= 2


# --- weekly review, tolerant JSON


def test_claims_of_damaged_findings(spark):
    from quillfin.functions import tolerant as tl

    texts = {
        '[{"claim": "a", "source": "s"}, "b", 3, {"source": "t"}]': [("a", "s"), ("b", ""), ("3", ""), ('{"source":"t"}', "t")], '{"claim": "x"}': [("x", "")], "[]": [], " ": [], None: [],
        '[{"claim": "a"': [('[{"claim": "a"', "")], "plain words": [("plain words", "")],
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: [tuple(c) for c in r.c] for r in rows.select("i", tl.claims(F.col("t")).alias("c")).collect()}
    assert got == dict(enumerate(texts.values()))
    read = tl.read_objects(rows, "t", "claim string, source string").select("i", "claim", "_corrupt").collect()
    assert {r.i: r.claim for r in read}[1] == "x" and {r.i: r._corrupt for r in read}[6] == "plain words"


def test_alert_performance_has_both_spans_and_empty_ones(spark):
    from datetime import date

    from quillfin.plans import weekly as wk

    alerts = spark.createDataFrame([(1, "watchlist"), (2, "watchlist"), (3, "watchlist"), (4, "other"), (5, "watchlist")], "trade_id long, rule string")
    trades = spark.createDataFrame([(1, "F1"), (2, "F1"), (3, "F2"), (4, "F3"), (5, "F4")], "trade_id long, doc_id string")
    filings = spark.createDataFrame([("F1", "seen"), ("F2", "seen"), ("F3", "seen"), ("F4", "filed")], "doc_id string, available_basis string")
    out = [(1, True, date(2001, 1, 1), 0.1, None), (2, True, date(2001, 1, 5), 0.3, None), (3, True, date(2001, 6, 1), -0.2, None), (4, True, date(2001, 6, 1), 9.0, 9.0), (5, True, date(2001, 6, 1), 9.0, 9.0)]
    outcomes = spark.createDataFrame(out, "trade_id long, copyable boolean, d0_date date, abn_ret_5 double, abn_ret_20 double")
    got = {(r.span, r.horizon): (r.filings, r.mean_abn_ret and round(r.mean_abn_ret, 9), r.hit_rate) for r in wk.alert_performance(alerts, trades, filings, outcomes, "2001-06-30").collect()}
    assert got == {("all", 5): (2, 0.0, 0.5), ("recent", 5): (1, -0.2, 0.0), ("all", 20): (0, None, None), ("recent", 20): (0, None, None)}


def test_previous_snapshot_of_a_damaged_run_is_null(spark):
    from quillfin.plans import weekly as wk

    runs = [(1, "w", "ok", '{"snapshot": {"week": "W1"}}'), (2, "w", "failed", "{}"), (3, "x", "ok", "nothing")]
    df = spark.createDataFrame(runs, "run_id long, agent string, status string, inputs string")
    got = {a: [tuple(r) for r in wk.previous_snapshot(df, a).collect()] for a in "wxy"}
    assert got == {"w": [(1, '{"week":"W1"}')], "x": [(3, None)], "y": []}
    moves = wk.ranking_moves(
        spark.createDataFrame([("A", 1, 0.5), ("B", None, 0.1)], "member_id string, rank int, shrunk_score double"), spark.createDataFrame([], "member_id string, rank int, shrunk_score double"),
        spark.createDataFrame([("A", "a"), ("B", "b")], "member_id string, name string"), spark.createDataFrame([("B", 1)], "member_id string, active int"),
    )
    assert sorted((r.section, r.member_id) for r in moves.collect()) == [("top", "A"), ("watched", "B")]
