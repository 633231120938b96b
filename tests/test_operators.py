"""Operators on small tables: hand values, identities, no look-ahead."""

import math
import random
import re
from collections import Counter
from datetime import date, timedelta
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import options as o
from tidemark.functions import ta
from tidemark.functions import windows as w
from tidemark.operators import levels, market, primitives, store, strategies, text, trading
from tidemark.plans import registry


def walk(symbols=("A", "B"), n=320, seed=42):
    r, rows = random.Random(seed), []
    for s in symbols:
        c = 100.0
        for i in range(n):
            o_ = c * math.exp(r.gauss(0, 0.004))
            c = o_ * math.exp(r.gauss(0, 0.012))
            rows.append((s, date(2000, 1, 3) + timedelta(days=i), o_, max(o_, c) * (1 + abs(r.gauss(0, 0.004))), min(o_, c) * (1 - abs(r.gauss(0, 0.004))), c, c, int(r.uniform(1e6, 5e6))))
    return rows


SCHEMA = "symbol string, bar_date date, open double, high double, low double, close double, adj_close double, volume long"


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(), SCHEMA).cache()


def test_wilder_and_rsi_by_hand():
    x = np.array([1.0, 2.0, 3.0, 4.0])
    assert ta.wilder(x, 2).tolist()[1:] == [1.5, 2.25, 3.125] and math.isnan(ta.wilder(x, 2)[0])
    assert np.isnan(ta.wilder(x, 5)).all()
    flat, up, down = np.full(20, 5.0), np.arange(1.0, 21.0), np.arange(20.0, 0.0, -1.0)
    assert ta.rsi(flat)[-1] == 100 and ta.rsi(up)[-1] == 100 and ta.rsi(down)[-1] == 0
    assert np.isnan(ta.rsi(up)[:13]).all()
    r = ta.rsi(np.array([b[5] for b in walk(("A",))]))
    assert ((r[13:] >= 0) & (r[13:] <= 100)).all()


def test_ema_and_macd_start():
    x = np.arange(1.0, 60.0)
    e = ta.ema(x, 3)
    assert np.isnan(e[:2]).all() and e[2] == 1 + 0.5 * (2 - 1) + 0.5 * (3 - 1.5)
    line, signal = ta.macd(x)
    assert np.isnan(line[:25]).all() and not np.isnan(line[25]) and np.isnan(signal[:33]).all() and not np.isnan(signal[33])


def test_ewm_variance_matches_its_definition():
    b = walk(("A",), 60)
    arrays = [np.array([r[i] for r in b]) for i in (2, 3, 4, 5)]
    v = ta.yang_zhang_ewm(*arrays)
    assert np.isnan(v[:2]).all() and (v[3:] > 0).all()


def test_full_windows_need_all_values(spark):
    df = spark.createDataFrame([("A", date(2000, 1, i), x) for i, x in enumerate([1.0, None, 3.0, 4.0, 5.0], 1)], "symbol string, bar_date date, close double")
    got = [r.s for r in df.withColumn("s", w.sma("close", 2)).orderBy("bar_date").collect()]
    assert got == [None, None, None, 3.5, 4.5]


def test_rank_definitions(spark):
    df = spark.createDataFrame([("A", date(2000, 1, i), float(x)) for i, x in enumerate([3, 1, 2, 2, 5], 1)], "symbol string, bar_date date, v double")
    rows = df.withColumns({"a": w.rank_average("v", 4), "b": w.rank_at_most("v", 4)}).orderBy("bar_date").collect()
    assert [r.a for r in rows] == [None, None, None, 2.5 / 4, 1.0] and rows[3].b == 3 / 4


@pytest.mark.parametrize("cut", [date(2000, 9, 20), date(2000, 11, 1)])
def test_no_look_ahead(spark, bars, cut):
    """The row of a date is the same whether or not later bars exist."""

    def all_reads(df):
        df = strategies.features(df)
        df = primitives.fibonacci(primitives.volume_confirm(primitives.pivot_proximity(primitives.reversal_trigger(primitives.trend_location(df)))))
        df = strategies.previous_breakout(df)
        cols = ["rsi2", "adx14", "macd", "sma200", "closeness", "trend_raw", "reversal_raw", "support", "pivot_raw", "volume_score", "turtle"]
        return {(r.symbol,): tuple(r[c] for c in cols) for r in df.filter(F.col("bar_date") == cut).collect()}

    assert all_reads(bars) == all_reads(bars.filter(F.col("bar_date") <= cut))


def test_one_exchange_for_all_windows_of_a_symbol(bars):
    df = bars.withColumns({"a": w.sma("close", 20), "b": w.sma("close", 200), "c": F.max("high").over(w.last(20)), "d": w.lag("close")})
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_filters_reach_the_scan(spark, tmp_path, bars):
    bars.write.parquet(str(tmp_path / "bars"))
    df = spark.read.parquet(str(tmp_path / "bars")).filter((F.col("symbol") == "A") & (F.col("bar_date") >= "2000-02-01")).select("bar_date", "close")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(symbol,A)" in plan and "GreaterThanOrEqual(bar_date" in plan and "volume" not in plan.split("ReadSchema")[1]


def test_normal_distribution_and_parity(spark):
    n = NormalDist()
    df = spark.createDataFrame([(float(x),) for x in np.linspace(-8, 8, 65)], "x double")
    assert all(abs(r[1] - n.cdf(r[0])) < 1e-13 for r in df.select("x", o.norm_cdf(F.col("x"))).collect())
    p = spark.createDataFrame([(float(x),) for x in (1e-9, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.999)], "p double")
    assert all(abs(r[1] - n.inv_cdf(r[0])) < 1e-7 for r in p.select("p", o.norm_ppf(F.col("p"))).collect())
    args = [F.lit(x) for x in (100.0, 100.0, 1.0, 0.05, 0.2)]
    call, put = spark.range(1).select(o.price("call", *args), o.price("put", *args)).first()
    assert round(call, 4) == 10.4506 and round(put, 4) == 5.5735 and abs(call - put - (100 - 100 * math.exp(-0.05))) < 1e-9
    assert spark.range(1).select(o.price("call", F.lit(0.0), *args[1:])).first()[0] is None
    k = spark.range(1).select(o.strike_for_delta("put", F.lit(-0.2), args[0], args[2], args[3], args[4]).alias("k")).select(o.greeks("put", args[0], F.col("k"), *args[2:])["delta"]).first()[0]
    assert abs(k + 0.2) < 1e-6


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, v double")
    new = spark.createDataFrame([(2, None, 9.0), (3, "c", 3.0), (3, "c", 4.0)], "k int, s string, v double")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(store.upsert(old, new, ["k"])) == [(1, "a", 1.0), (2, None, 9.0), (3, "c", 4.0)]
    assert rows(store.upsert_coalesce(old, new.filter("v <> 4"), ["k"])) == [(1, "a", 1.0), (2, "b", 9.0), (3, "c", 3.0)]
    assert rows(store.insert_ignore(old, new.filter("v <> 4"), ["k"])) == [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)]
    assert rows(store.without_orphans(new, old, ["k"])) == [(2, None, 9.0)]


def test_as_of_joins(spark):
    left = spark.createDataFrame([("A", 1), ("A", 5), ("A", 9), ("B", 5)], "k string, t int")
    right = spark.createDataFrame([("A", 2, 20.0), ("A", 5, None), ("A", 7, 70.0)], "k string, t int, v double")
    rows = lambda **kw: sorted(tuple(r) for r in store.as_of(left, right, ["k"], "t", ["v"], **kw).collect())
    assert rows() == [("A", 1, None), ("A", 5, None), ("A", 9, 70.0), ("B", 5, None)]
    assert rows(strict=True)[1] == ("A", 5, 20.0) and rows(forward=True)[0] == ("A", 1, 20.0)


def test_intervals_are_half_open(spark):
    facts = spark.createDataFrame([("A", date(2000, 1, d)) for d in (1, 2, 3, 4)], "s string, d date")
    spans = spark.createDataFrame([("A", date(2000, 1, 2), date(2000, 1, 3)), ("A", date(2000, 1, 2), date(2000, 1, 4))], "s string, a date, b date")
    assert [r.d.day for r in store.in_interval(facts, spans, ["s"], "d", "a", "b").orderBy("d").collect()] == [2, 3]


def test_adjusted_bars(spark):
    b = spark.createDataFrame([("A", date(2000, 1, 1), 10.0, 12.0, 8.0, 10.0, 5.0, 100), ("A", date(2000, 1, 2), 10.0, 12.0, 8.0, 10.0, None, 100)], SCHEMA)
    one, two = store.adjusted(b).orderBy("bar_date").collect()
    assert (one.open, one.high, one.low, one.close, one.volume, one.close_raw) == (5.0, 6.0, 4.0, 5.0, 200.0, 10.0) and (two.close, two.volume) == (10.0, 100.0)


def test_sizing_reasons(spark):
    df = spark.createDataFrame([(100.0, 95.0), (100.0, 100.0), (0.0, -1.0), (100.0, 0.5), (90000.0, 100.0), (10.0, 9.99)], "e double, s double")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in strategies.position_size(F.col("e"), F.col("s")).items()]).collect()]
    assert got == [(800, None), (0, "stop_above_entry"), (0, "invalid_entry_price"), (100, None), (0, "qty_zero"), (8000, None)]


def test_registry_contract():
    assert len(strategies.REGISTRY) == 5 and all(s.history > 0 for s in strategies.REGISTRY.values())
    with pytest.raises(ValueError):
        strategies.register(strategies.REGISTRY["rsi2_meanrev"])
    assert strategies.affinity_for(strategies.REGISTRY["donchian_trend"], "choppy") == 0.25 and strategies.affinity_for(strategies.REGISTRY["donchian_trend"], None) == 1.0


def test_corrections(spark):
    closes = [100, 95, 89, 92, 88, 94, 96, 101, 100, 85, 80]
    s = spark.createDataFrame([("M", date(2000, 1, i), float(c)) for i, c in enumerate(closes, 1)], "series string, bar_date date, close double")
    got = [(r.start_date.day, r.end_date.day) for r in market.corrections(market.drawdowns(s)).orderBy("start_date").collect()]
    assert got == [(3, 5), (10, 11)]


def test_composite_uses_what_is_there(spark):
    df = spark.createDataFrame([(1.0, 0.0, None, None), (None, None, None, None)], "vol_score double, trend_score double, breadth_score double, credit_score double")
    assert [r[0] for r in df.select(market.composite()).collect()] == [pytest.approx(0.4 / 0.65), None]


def test_clusters_follow_the_running_mean(spark):
    found = spark.createDataFrame([("A", "high", i, p, 1.0, 1.0) for i, p in enumerate([100.0, 101.0, 101.9, 104.0, 110.0])], "symbol string, origin string, rn int, price double, volume double, prominence double")
    assert [r.cluster for r in levels.clustered(found).orderBy("price").collect()] == [0, 0, 0, 1, 2]


def test_triple_barrier_labels(spark):
    rows = [(1, 10, 10.5, 9.5), (2, 10, 12.5, 9.8), (3, 10, 13, 7), (4, 10.2, 10.4, 10.1)]
    b = spark.createDataFrame([("A", date(2000, 1, i), float(c), float(h), float(lo)) for i, c, h, lo in rows], "symbol string, bar_date date, close double, high double, low double")
    got = [r.label for r in trading.triple_barrier(b, F.col("close") - 2, F.col("close") + 2, 2).orderBy("bar_date").collect()]
    assert got == [1, 0, 1, None]


def test_importance_over_matches_and_search(spark):
    df = spark.createDataFrame([("FOMC minutes",), ("Tourism arrivals",), ("Bank holiday",)], "n string")
    assert [r[0] for r in df.select(text.importance(F.col("n"))).collect()] == ["high", "medium", "low"]
    expected = {
        "high": ["CPI MoM", "cpi mom", "Core CPI", "Nonfarm Payrolls", "Non-Farm Payrolls", "Unemployment Rate", "FOMC Economic Projections", "Federal Funds Rate", "Interest Rate Decision", "PCE Price Index", "PPI"],
        "medium": ["ISM Manufacturing PMI", "Retail Sales MoM", "GDP Growth Rate", "JOLTS Job Openings", "Initial Jobless Claims", "Consumer Confidence", "Durable Goods Orders", "Housing Starts", "Trade Balance", "Factory Orders"],
        "low": ["10-Year Bond Auction", "Mortgage Applications", "API Crude Oil Stock Change", "Capital Expenditure", "", None],
    }
    names = spark.createDataFrame([(n, k) for k, many in expected.items() for n in many], "n string, k string")
    assert [r.n for r in names.filter(text.importance(F.col("n")) != F.col("k")).collect()] == []
    docs = spark.createDataFrame([(1, "Alpha beta beta"), (2, "alpha"), (3, None)], "i int, t string")
    assert [(r.i, round(r.score, 6)) for r in text.search(docs, "t", ["ALPHA", "beta"]).collect()] == [(1, round(3 / (1 + math.log(3)), 6))]


def test_sessions(spark):
    times = ["2024-01-05 23:30:00", "2024-01-05 20:00:00", "2024-01-06 12:00:00", "2024-01-08 03:00:00", "2024-01-08 15:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(text.latest_session(F.col("t").cast("timestamp")).alias("d"))
    assert [r.d.day for r in df.collect()] == [5, 4, 5, 5, 5]


def test_symbols(spark):
    df = spark.createDataFrame([(1, " aapl, BRK.B;9x  AAPL\ntoolongsymbol1 ")], "k int, t string")
    assert [(r.symbol, r.valid) for r in text.added_symbols(df, "k", "t").orderBy("place").collect()] == [("AAPL", True), ("BRK.B", True), ("9X", False), ("TOOLONGSYMBOL1", False)]


def test_recursive_columns_have_no_nan(bars):
    df = ta.with_recursive(bars, ["rsi14", "adx14", "macd_signal", "yz_ewm"])
    assert df.filter(" or ".join(f"isnan({c})" for c in ("rsi14", "adx14", "macd_signal", "yz_ewm"))).count() == 0
    assert isinstance(df.limit(1).toPandas(), pd.DataFrame)


def test_numbers_by_ranges(spark):
    r = random.Random(2)
    rows = [(r.choice([None, *range(40)]), f"k{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(5)
    for ascending in (True, False):
        want = {b: n for n, (_, b) in enumerate(sorted(rows, key=lambda x: (x[0] is None, (x[0] or 0) * (1 if ascending else -1), x[1])), 1)}
        assert {x.b: x.n for x in store.numbered(df, ["a", "b"], "n", ascending).collect()} == want
    known = [a for a, _ in rows if a is not None]
    got = {(x.b, x.p) for x in store.percent_ranked(df.filter("a is not null"), "a", "p").collect()}
    assert got == {(b, 100 * sum(y < a for y in known) / (len(known) - 1)) for a, b in rows if a is not None}
    assert store.numbered(df.limit(0), ["a", "b"], "n").count() == 0


def test_ratchet_counts_from_each_entry(spark):
    df = spark.createDataFrame([("A", date(2000, 1, 1) + timedelta(days=i), i + 1, 100.0 + (i if i < 30 else 60 - i), 95.0 if i in (0, 5) else None) for i in range(60)], "symbol string, bar_date date, rn long, close double, stop double")
    got = [(r.entry_date.day, (r.bar_date - r.entry_date).days, r.level, r.stop) for r in trading.ratcheted(df, F.col("close") - 2, 14, 42).orderBy("entry_date", "bar_date").collect()]
    assert got == [(2, 14, 113.0, 113.0), (2, 28, 127.0, 127.0), (2, 42, 115.0, 127.0), (7, 14, 118.0, 118.0), (7, 28, 124.0, 124.0), (7, 42, 110.0, 124.0)]


def test_models_split_by_day_and_report(spark):
    from tidemark.operators import models

    r = random.Random(1)
    rows = [(date(2000, 1, 1) + timedelta(days=i // 10), x := r.random(), int(x + r.gauss(0, 0.2) > 0.3)) for i in range(1000)]
    df = spark.createDataFrame(rows, "bar_date date, x double, label int")
    older, newer = models.split(df, "bar_date", 0.2)
    assert older.count() + newer.count() == 1000 and 180 <= newer.count() <= 220
    assert older.agg(F.max("bar_date")).first()[0] < newer.agg(F.min("bar_date")).first()[0]
    scored = models.score(models.fit(older, ["x"], trees=5), newer, ["x"]).select("label", "p_win").collect()
    m = models.metrics(spark.createDataFrame(scored)).first()
    won, lost = [s.p_win for s in scored if s.label], [s.p_win for s in scored if not s.label]
    assert m.auc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in won for b in lost) / (len(won) * len(lost)), abs=1e-9) and m.auc > 0.8
    picked = [s for s in scored if s.p_win >= 0.55]
    assert m.precision == pytest.approx(sum(s.label for s in picked) / len(picked)) and m.recall == pytest.approx(sum(s.label for s in picked) / len(won))


def test_articles_of_a_symbol_lie_together(spark, tmp_path):
    """A task has the long lists of few symbols, so that its file may hold each once; one symbol's articles may be in several tasks."""
    spark.range(400).selectExpr("id as doc_id", "'text' as text", "'en' as lang", "'src' as source").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(100).selectExpr("id as c_custkey", "'MACHINERY' as c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    df = registry.QUERIES["join_correlated_array_agg"](spark, str(tmp_path))
    tasks = df.rdd.mapPartitions(lambda rows: [[tuple(r["items"]) for r in rows]]).collect()
    assert sum(map(len, tasks)) == 400 and len({x for t in tasks for x in t}) == 10
    assert len([t for t in tasks if t]) > 1 and sum(len(set(t)) for t in tasks) <= len(tasks) + 9


def test_long_frames_equal_moving_windows(spark):
    """Columns of long frames are those of Spark's windows, with gaps, short histories and ties, and make no window over 5 bars."""
    rows = []
    for symbol, n in (("A", 330), ("B", 61), ("C", 3), ("D", 1)):
        for i in range(n):
            c = 100.0 + (i * 7919 % 41) / 4 + i / 16
            rows.append((symbol, date(2000, 1, 1) + timedelta(days=i), c - 0.5, c + 1 + i % 3, c - 1 - i % 2, None if symbol == "A" and i == 40 else c, float(1000 * (i * 31 % 17 + 1))))
    bars = spark.createDataFrame(rows, "symbol string, bar_date date, open double, high double, low double, close double, volume double").repartition(3)
    names = ["sma5", "sma200", "closeness252", "prior55", "high_before20", "low_before20", "volume_before19", "squeeze126", "slope_quality90", "support_3_60", "resistance_3_60"]
    df = primitives.numbered(ta.with_recursive(bars, names))
    w = Window.partitionBy("symbol").orderBy("bar_date")
    over = lambda a, b: w.rowsBetween(a, b)
    whole = lambda value, n, to=0: F.when(F.count("close").over(over(to - n + 1, to)) == n, value)
    df = df.withColumn("bbw", whole(F.round(4 * F.stddev_samp("close").over(over(-19, 0)) / F.avg("close").over(over(-19, 0)), 9), 20))
    df = df.withColumns({"last": F.lag("bbw").over(w), "bbws": F.collect_list("bbw").over(over(-126, -1))})
    least, most = F.min("low").over(over(-3, 3)), F.max("high").over(over(-3, 3))
    both = F.count("low").over(over(-3, 3)) == 7
    df = df.withColumns({"lo": F.when(both & (F.col("low") == least), F.col("low")), "hi": F.when(both & (F.col("high") == most), F.col("high"))})
    df = df.withColumns({"los": F.collect_list("lo").over(over(-60, -3)), "his": F.collect_list("hi").over(over(-60, -3))})
    want = {
        "sma5": whole(F.avg("close").over(over(-4, 0)), 5), "sma200": whole(F.avg("close").over(over(-199, 0)), 200), "closeness252": whole(F.col("close") / F.max("close").over(over(-251, 0)), 252),
        "prior55": whole(F.max("close").over(over(-55, -1)), 55, -1), "high_before20": F.max("high").over(over(-20, -1)), "low_before20": F.min("low").over(over(-20, -1)),
        "volume_before19": F.avg("volume").over(over(-19, -1)), "squeeze126": F.when(F.size("bbws") > 0, F.size(F.filter("bbws", lambda v: v <= F.col("last"))) / F.nullif(F.size("bbws"), F.lit(0))),
        "slope_quality90": ta.slope_quality(90), "support_3_60": F.array_max(F.filter("los", lambda x: x <= F.col("close"))), "resistance_3_60": F.array_min(F.filter("his", lambda x: x >= F.col("close"))),
    }
    seen = Counter()
    for r in df.select("symbol", "rn", *names, *[v.alias(f"w_{k}") for k, v in want.items()]).collect():
        for k in names:
            a, b = r[k], r[f"w_{k}"]
            seen[k] += a is not None
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-11), (k, r.symbol, r.rn, a, b)
    assert len(seen) == len(names) and min(seen.values()) > 0
    # A frame of more than 5 rows would be added up anew for each row.
    marked = strategies.features(bars, strategies.RECURSIVE + strategies.FRAMES).withColumn("cap_pct", F.lit(90.0)).withColumn("market_ret60", F.lit(0.0)).withColumn("rs_raw", F.lit(0.1))
    for s in strategies.REGISTRY.values():
        marked = s.mark(marked)
    plan = marked.select(*strategies.REGISTRY)._jdf.queryExecution().optimizedPlan().toString()
    assert max(int(x) for x in re.findall(r"specifiedwindowframe\(RowFrame, -(\d+),", plan)) <= 60 and "collect_list" not in plan
