"""Exit simulation on daily bars: first hits as window expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .calendar import BENCHMARK, trading_days

MAX_HOLD = 60


@dataclass(frozen=True)
class Rule:
    """One exit rule; ``kind`` is fixed_hold, stop_target, trailing_stop, atr_stop or member_sale."""

    kind: str
    hold: int = MAX_HOLD
    stop: float | None = None
    target: float | None = None
    pct: float | None = None
    mult: float | None = None
    n: int = 14

    @property
    def label(self) -> str:
        shown = {
            "fixed_hold": [("days", self.hold)],
            "stop_target": [("stop", self.stop), ("target", self.target)],
            "trailing_stop": [("pct", self.pct)],
            "atr_stop": [("mult", self.mult), ("n", self.n)],
            "member_sale": [],
        }[self.kind]
        if self.kind != "fixed_hold" and self.hold != MAX_HOLD:
            shown.append(("max_hold", self.hold))
        return f"{self.kind}({', '.join(f'{k}={v}' for k, v in shown)})"

    def levels(self, entry: Column, high: Column, atr: Column) -> tuple[Column, Column]:
        """(stop, target) prices for the next check."""
        none = F.lit(None).cast("double")
        if self.kind == "stop_target":
            return (entry * (1 - self.stop) if self.stop is not None else none, entry * (1 + self.target) if self.target is not None else none)
        if self.kind == "trailing_stop":
            return high * (1 - self.pct), none
        if self.kind == "atr_stop":
            return high - self.mult * atr, none
        return none, none


#: The grid of rules that training chooses from; ties go to the earlier one.
GRID = (
    Rule("fixed_hold", 5), Rule("fixed_hold", 10), Rule("fixed_hold", 20), Rule("fixed_hold", 60),
    Rule("stop_target", stop=0.08), Rule("stop_target", stop=0.15), Rule("stop_target", stop=0.08, target=0.20),
    Rule("trailing_stop", pct=0.10), Rule("trailing_stop", pct=0.20),
    Rule("atr_stop", mult=2), Rule("atr_stop", mult=3),
    Rule("member_sale"),
)
SLIPPAGE_BPS = {"mega": 5, "large": 10, "mid": 20, "small": 40, "micro": 75}
OTHER_BPS = 75
#: Columns of a signal that its result has, besides its trade.
OF_SIGNAL = ("trade_id", "doc_id", "member_id", "symbol", "d0", "mcap_bucket")


def series(prices: DataFrame, days: DataFrame) -> DataFrame:
    """(symbol, i, o, h, l, c): adjusted bars on trading days; c is null without a usable adjusted close, the rest also without open or close."""
    c = F.when(F.col("adj_close") > 0, F.col("adj_close"))
    full = (F.col("adj_close") > 0) & (F.col("open") > 0) & (F.col("close") > 0)
    f = F.col("adj_close") / F.col("close")
    o = F.when(full, F.col("open") * F.col("adj_close") / F.col("close"))
    h = F.when(full, F.greatest(F.when(F.col("high") > 0, F.col("high") * f), o, c))
    low = F.when(full, F.least(F.when(F.col("low") > 0, F.col("low") * f), o, c))
    return prices.join(F.broadcast(days), "date").select("symbol", "i", o.alias("o"), h.alias("h"), low.alias("l"), c.alias("c"))


def atr(bars: DataFrame, n: int) -> DataFrame:
    """(symbol, i, atr): mean true range of the last n bars with close and high up to day i, null under n + 1 of them."""
    good = bars.where("c is not null and h is not null")
    w = Window.partitionBy("symbol").orderBy("i")
    tr = good.withColumn("p", F.lag("c").over(w)).withColumn("tr", F.greatest("h", "p") - F.least("l", "p"))
    last = w.rowsBetween(-n + 1, 0)
    return tr.select("symbol", "i", F.when(F.row_number().over(w) > n, F.avg("tr").over(last)).alias("atr"))


def next_sale(signals: DataFrame, sales: DataFrame) -> DataFrame:
    """``signals`` with ``sale``: day number of the member's next sale of the symbol after d0.

    Each day of a member and symbol is one row, whichever signals ask for it; a window backwards finds the nearest later sale.
    """
    by = ["member_id", "symbol"]
    marked = lambda df, asked: df.select(*by, "d0", F.lit(asked).alias("asked"), F.when(F.lit(not asked), F.col("d0")).alias("s"))
    days = marked(signals, True).unionByName(marked(sales, False)).where("member_id is not null")
    days = days.groupBy(*by, "d0").agg(F.max("asked").alias("asked"), F.max("s").alias("s"))
    later = F.min("s").over(Window.partitionBy(*by).orderBy(F.desc("d0")).rowsBetween(Window.unboundedPreceding, -1))
    found = days.withColumn("sale", later).where("asked and sale is not null").select(*by, "d0", "sale")
    return signals.join(found, [*by, "d0"], "left")


#: Where on a day an exit was, and why.
AT = ("", "close", "open", "intraday")
CLOSE, OPEN, INTRADAY = 1, 2, 3
WHY = ("", "stop", "target", "hold", "sale", "data_end", "open")
STOP, TARGET, HOLD, SALE, DATA_END, STILL_OPEN, DUE = range(1, 8)
#: Days of a bin, and signals that one task takes of a symbol's bin, about; a hotter one is dealt to several.
BIN, MOST = 256, 100_000
#: Types of a start's columns and of what is found for it.
START = {"symbol": "string", "d0": "int", "sale": "int", "fill": "double"}
EXITS = "rule_no int, entry double, exit_i int, exit_price double, exit_at string, reason string"
#: In place of a sale where there is none before the longest hold ends.
NO_SALE = -1


def with_atr(bars: DataFrame, n: int | None) -> DataFrame:
    """Bars with a close, with ``atr``: the mean true range up to the last bar with close and high before them."""
    closes = bars.where("c is not null")
    if n is None:
        return closes.withColumn("atr", F.lit(None).cast("double"))
    own = closes.join(atr(closes, n).withColumn("known", F.struct("atr")).drop("atr"), ["symbol", "i"], "left")
    w = Window.partitionBy("symbol").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("atr", F.last("known", ignorenulls=True).over(w)["atr"]).drop("known")


def _first_hits(signals: dict[str, np.ndarray], bars: dict[str, np.ndarray], rules: tuple[Rule, ...], intraday: bool) -> dict[str, np.ndarray]:
    """The first exit of every signal under every rule, day by day for all of them at once; NaN is null. Signals without a bar or an entry have none."""
    i, o, h, low, c = (bars[k] for k in ("i", "o", "h", "l", "c"))
    n, r = len(signals["d0"]), len(rules)
    row, rule_no = np.repeat(np.arange(n), r), np.tile(np.arange(r), n)
    d0 = signals["d0"][row]
    j = np.searchsorted(i, d0)
    has = j < len(i)
    at0 = np.where(has, j, 0)
    on_day = has & (i[at0] == d0)
    entry = signals["fill"][row] if "fill" in signals else np.where(on_day, o[at0], np.nan)
    keep = has & ~np.isnan(entry)
    row, rule_no, d0, j, entry, on_day, at0 = (x[keep] for x in (row, rule_no, d0, j, entry, on_day, at0))
    by_rule = lambda f: np.array([np.nan if (v := f(x)) is None else v for x in rules], dtype=float)[rule_no]
    hold_end = d0 + by_rule(lambda x: x.hold)
    sale = np.where(by_rule(lambda x: x.kind == "member_sale") > 0, signals["sale"][row], np.nan)
    sale = np.where(sale > d0, sale, np.nan)
    end = np.fmin(hold_end, sale)
    pct, mult = by_rule(lambda x: x.pct), by_rule(lambda x: x.mult)
    stop0 = entry * (1 - by_rule(lambda x: x.stop))
    target = entry * (1 + by_rule(lambda x: x.target))
    # true ranges of the entry day only
    atr0 = np.where(on_day, bars["atr"][at0], np.nan)
    last = np.minimum(np.searchsorted(i, end), len(i) - 1)
    k = len(row)
    out = {"row": row, "rule_no": rule_no, "entry": entry, "exit_i": np.full(k, -1), "price": np.full(k, np.nan), "at": np.zeros(k, dtype=int), "reason": np.zeros(k, dtype=int)}
    high, live = entry.copy(), np.arange(k)
    while len(live):
        x = j[live]
        day, op, hi, lo, cl, e0 = i[x], o[x], h[x], low[x], c[x], d0[live]
        stop = np.fmax(np.fmax(stop0[live], high[live] * (1 - pct[live])), high[live] - mult[live] * atr0[live])
        goal, first = target[live], day == e0
        bought = first & intraday
        opened = day > e0
        late = (day > end[live]) | (day == sale[live])
        checks = [
            (bought & (cl <= stop), cl, CLOSE, STOP), (bought & (cl >= goal), cl, CLOSE, TARGET), (bought & (day < hold_end[live]), None, 0, 0),
            (late & ~np.isnan(op), op, OPEN, DUE), (late, cl, CLOSE, DUE), (opened & (op <= stop), op, OPEN, STOP), (opened & (op >= goal), op, OPEN, TARGET),
            (lo <= stop, stop, INTRADAY, STOP), (hi >= goal, goal, INTRADAY, TARGET), (day >= hold_end[live], cl, CLOSE, HOLD),
        ]
        open_, gone = np.ones(len(live), dtype=bool), np.zeros(len(live), dtype=bool)
        for met, price, at, why in checks:
            now = open_ & met
            open_ &= ~met
            if price is not None and now.any():
                w = live[now]
                out["exit_i"][w], out["price"][w], out["at"][w], out["reason"][w] = day[now], price[now], at, why
                gone |= now
        seen = np.where(first, cl, hi) if intraday else hi
        high[live] = np.fmax(high[live], seen)
        j[live] += 1
        live = live[~gone & (j[live] <= last[live])]
    due = out["reason"] == DUE
    out["reason"] = np.where(due, np.where(end == sale, SALE, HOLD), out["reason"])
    return out


def first_exits(starts: DataFrame, bars: DataFrame, rules: dict[int, Rule], n_days: int, intraday: bool = False) -> DataFrame:
    """(columns of ``starts``, rule_no, entry, exit_i, exit_price, exit_at, reason) for each distinct start (symbol, d0[, sale][, fill]) with an entry price, under each rule.

    Starts meet the bars of their holding period in bins of days, each start once for all rules, and the first bar past its end where the exit day has none. A task steps through the days of a bin for all its starts
    at once; a bin with many starts is dealt to several tasks, each of which gets its bars. ``data_end`` is the symbol's last bar, ``open`` the calendar's end.
    """
    numbers, listed = np.array(list(rules), dtype=np.int32), tuple(rules.values())
    widths = {r.n for r in listed if r.kind == "atr_stop"}
    if len(widths) > 1:
        raise ValueError("one number of bars for all true ranges")
    hold = max(r.hold for r in listed)
    keys = starts.columns
    own = starts.withColumn("bin", F.expr(f"d0 div {BIN}").cast("int"))
    # as many rows as symbols have bins
    parts = own.groupBy("symbol", "bin").agg(F.expr(f"cast(count(*) div {MOST} + 1 as int)").alias("parts"))
    own = own.join(parts, ["symbol", "bin"]).withColumn("part", F.pmod(F.xxhash64(*keys), F.col("parts")).cast("int")).drop("parts")
    w = Window.partitionBy("symbol").orderBy("i")
    every = Window.partitionBy("symbol")
    known = with_atr(bars, widths.pop() if widths else None)
    known = known.withColumns({"last": F.max("i").over(every), "last_c": F.max_by("c", "i").over(every), "before": F.coalesce(F.lag("i").over(w), F.lit(0))})
    # a bin's bars, to the longest hold's end and one more
    first_bin = F.greatest(F.ceil((F.col("before") - (BIN - 1) - hold) / BIN), F.lit(0)).cast("int")
    known = known.select("*", F.explode(F.sequence(first_bin, F.expr(f"cast(i div {BIN} as int)"))).alias("bin"))
    known = known.join(parts, ["symbol", "bin"]).select("symbol", "bin", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "i", "o", "h", "l", "c", "atr", "last", "last_c")
    names = [*keys, *(c.split()[0] for c in EXITS.split(", "))]
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    types = [*(kinds[START[c]] for c in keys), *(kinds[c.split()[1]] for c in EXITS.split(", "))]

    def run(s: pa.Table, b: pa.Table) -> pa.Table:
        if not s.num_rows or not b.num_rows:
            return pa.table([pa.array([], kind) for kind in types], names=names)
        b = b.sort_by("i")
        last, last_c = b["last"][0].as_py(), b["last_c"][0].as_py()
        whole = lambda t, c: t[c].to_numpy().astype(np.int64 if c in ("i", "d0") else float)
        given = {c: whole(s, c) for c in keys if c != "symbol"}
        given.setdefault("sale", np.full(s.num_rows, np.nan))
        found = _first_hits(given, {c: whole(b, c) for c in ("i", "o", "h", "l", "c", "atr")}, listed, intraday)
        none = found["exit_i"] < 0
        found["exit_i"][none], found["price"][none], found["at"][none], found["reason"][none] = min(last, n_days - 1), last_c, CLOSE, DATA_END if last < n_days - 1 else STILL_OPEN
        of = lambda texts, codes: pa.array(np.array(texts, dtype=object)[codes], pa.string())
        start = s.select(keys).take(pa.array(found["row"])).columns
        columns = [pa.array(numbers[found["rule_no"]]), pa.array(found["entry"]), pa.array(found["exit_i"].astype(np.int32)), pa.array(found["price"])]
        return pa.table([*start, *columns, of(AT, found["at"]), of(WHY, found["reason"])], names=names)

    by = ["symbol", "bin", "part"]
    schema = ", ".join([*(f"{c} {START[c]}" for c in keys), EXITS])
    return own.groupBy(*by).cogroup(known.groupBy(*by)).applyInArrow(run, schema)


def _by_start(signals: DataFrame, bars: DataFrame, rules: tuple[Rule, ...], n_days: int, intraday: bool = False) -> tuple[DataFrame, list[tuple[list[str], DataFrame]]]:
    """(signals with the columns that tell starts apart, a list of (those columns, exits by start)): only rules that follow sales tell these apart, and only sales within their hold.

    There are as many starts as bars, or as bars and days of a hold, however many signals share them.
    """
    follow = [r.hold for r in rules if r.kind == "member_sale"]
    sale = F.lit(None)
    if follow and "sale" in signals.columns:
        sale = F.when((F.col("sale") > F.col("d0")) & (F.col("sale") <= F.col("d0") + max(follow)), F.col("sale"))
    own = signals.withColumns({"d0": F.col("d0").cast("int"), "sale": F.coalesce(sale.cast("int"), F.lit(NO_SALE))})
    fill = [c for c in ("fill",) if c in signals.columns]
    sets = []
    for follows in (False, True):
        some = {k: r for k, r in enumerate(rules) if (r.kind == "member_sale") == follows}
        if some:
            by = ["symbol", "d0", *(["sale"] if follows else []), *fill]
            sets.append((by, first_exits(written(own.select(*by).distinct()), bars, some, n_days, intraday)))
    return own, sets


def simulate(signals: DataFrame, bars: DataFrame, rules: Rule | tuple[Rule, ...], n_days: int, entry_col: str | None = None, intraday: bool = False, kept: tuple[str, ...] = ()) -> DataFrame:
    """(trade_id, kept columns, rule_no, rule, entry, exit_i, exit_price, exit_at, reason) for each signal (trade_id, symbol, d0[, sale]) with an entry price, under each rule.

    Signals that start alike have the same exits, which are found once. ``entry_col`` gives the fill of a real position; with ``intraday`` its first day's low and high may lie before the purchase, so only that
    day's close counts.
    """
    rules = (rules,) if isinstance(rules, Rule) else tuple(rules)
    own, sets = _by_start(signals.withColumn("fill", F.col(entry_col).cast("double")) if entry_col else signals, bars, rules, n_days, intraday)
    label = F.get(F.array(*(F.lit(r.label) for r in rules)), F.col("rule_no")).alias("rule")
    out = None
    for by, found in sets:
        mine = own.select("trade_id", *dict.fromkeys([*by, *kept]))
        one = mine.join(found, by).select("trade_id", *kept, "rule_no", label, "entry", "exit_i", "exit_price", "exit_at", "reason")
        out = one if out is None else out.unionByName(one)
    return out


def with_market(exits: DataFrame, spy: DataFrame) -> DataFrame:
    """``exits`` (with d0) with ``market``, the benchmark's return from the entry's open to the exit's open or close."""
    joined = exits.join(F.broadcast(spy.select(F.col("i").alias("d0"), F.col("o").alias("spy_in"))), "d0", "left")
    joined = joined.join(F.broadcast(spy.select(F.col("i").alias("exit_i"), F.col("o").alias("spy_o"), F.col("c").alias("spy_c"))), "exit_i", "left")
    out = F.when(F.col("exit_at") == "open", F.col("spy_o")).otherwise(F.col("spy_c"))
    return joined.withColumn("market", out / F.col("spy_in") - 1).drop("spy_in", "spy_o", "spy_c")


def packed(signals: DataFrame, bars: DataFrame, spy: DataFrame, rules: tuple[Rule, ...], n_days: int) -> tuple[DataFrame, DataFrame]:
    """(``signals`` with ``sold``, (symbol, d0, entry, x) for each start with an entry price): ``x`` has the exits under the rules that follow no sale, in order, ``sold`` that under the one that does.

    An exit has exit_i, at_open, price, market, whether it is still open, and whether it was held to a close. See ``places``.
    """
    own, sets = _by_start(signals, bars, rules, n_days)
    what = F.struct("rule_no", "exit_i", (F.col("exit_at") == "open").alias("at_open"), F.col("exit_price").alias("price"), "market", (F.col("reason") == "open").alias("open"), ((F.col("reason") == "hold") & (F.col("exit_at") == "close")).alias("held"))
    starts = None
    for by, found in sets:
        one = with_market(found, spy)
        if "sale" in by:
            own = own.join(one.select(*by, what.alias("sold")), by, "left")
        else:
            starts = one.groupBy(*by).agg(F.max("entry").alias("entry"), F.array_sort(F.collect_list(what)).alias("x"))
    return own.drop("sale"), starts


def places(rules: tuple[Rule, ...]) -> list[Column]:
    """Where the exit under each rule is in rows of ``packed`` signals and starts."""
    plain = [r for r in rules if r.kind != "member_sale"]
    return [F.col("sold") if r.kind == "member_sale" else F.get("x", F.lit(plain.index(r))) for r in rules]


def slippage(bucket: str = "mcap_bucket") -> Column:
    """Share of the price lost per side, by size."""
    out = F.lit(OTHER_BPS)
    for k, v in SLIPPAGE_BPS.items():
        out = F.when(F.col(bucket) == k, v).otherwise(out)
    return out.cast("double") / 10_000


def evaluate(exits: DataFrame, signals: DataFrame | None, spy: DataFrame, costs: bool = True) -> DataFrame:
    """``exits`` with net prices, ``ret`` and ``abn`` (excess over the benchmark from its entry open to the exit's open or close).

    Without ``signals``, ``exits`` has their columns.
    """
    joined = exits if signals is None else exits.join(signals.select(*OF_SIGNAL), "trade_id")
    slip = slippage() if costs else F.lit(0.0)
    joined = with_market(joined, spy).withColumns({"entry_net": F.col("entry") * (1 + slip), "exit_net": F.col("exit_price") * (1 - slip)})
    ret = F.col("exit_net") / F.col("entry_net") - 1
    return joined.withColumn("ret", ret).withColumn("abn", ret - F.col("market")).drop("market")


def signals(entries: DataFrame) -> DataFrame:
    """Copyable buys of trades with an entry day, the first row of each (filing, symbol) in order of d0 and trade."""
    kept = ["trade_id", "doc_id", "member_id", "symbol", "d0", "d0_date", "mcap_bucket"]
    # combined before the shuffle, unlike a window
    least = F.min(F.struct("d0", "trade_id", "member_id", "d0_date", "mcap_bucket")).alias("s")
    return entries.where("copyable").groupBy("doc_id", "symbol").agg(least).select("doc_id", "symbol", "s.*").select(*kept)


def sale_days(entries: DataFrame) -> DataFrame:
    """(member_id, symbol, d0) of sales with an entry day."""
    return entries.where(F.col("action").isin("SELL", "SELL_PARTIAL") & F.col("member_id").isNotNull()).select("member_id", "symbol", "d0").distinct()


def benchmark(prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trading days, the benchmark's series)."""
    days = trading_days(prices)
    return days, series(prices.where(F.col("symbol") == BENCHMARK), days)
