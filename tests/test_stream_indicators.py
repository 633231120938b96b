import pickle
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ta
from tidemark.streaming import bars as st
from tidemark.streaming import indicators as si


def made(n, seed):
    r, c, out = random.Random(seed), 100.0, []
    for i in range(n):
        c = max(1.0, c + r.randrange(-40, 41) / 16)
        high, low = c + r.randrange(0, 20) / 16, c - r.randrange(0, 20) / 16
        out.append((date(2000, 1, 1) + timedelta(days=i), high, low, c if r.random() > 0.05 else out[-1][3] if out else c))
    return out


def whole(bars):
    """The same columns by the functions over whole arrays."""
    h, low, c = (np.array([b[i] for b in bars]) for i in (1, 2, 3))
    line, signal = ta.macd(c)
    roll = lambda x, n, f: np.array([f(x[i - n + 1 : i + 1]) if i >= n - 1 else np.nan for i in range(len(x))])
    return np.column_stack([ta.ema(c, 12), ta.ema(c, 26), line, signal, ta.rsi(c), ta.atr(h, low, c), ta.adx(h, low, c), roll(c, 50, lambda v: v.sum() / 50), roll(h, 20, max), roll(low, 20, min)])


def same(rows, bars):
    got = np.array([r[1:] for r in rows], float)
    assert [r[0] for r in rows] == [b[0] for b in bars]
    np.testing.assert_array_equal(got, whole(bars))


@pytest.mark.parametrize("n", [1, 13, 14, 40, 400])
def test_a_bar_at_a_time_is_the_whole_history_bit_for_bit(n):
    bars, symbol = made(n, n), si.Symbol()
    same([r for b in bars for r in symbol.add([b])], bars)


def test_late_bars_are_replayed_and_too_late_ones_change_nothing():
    bars, symbol, rows = made(200, 3), si.Symbol(), {}
    order = list(range(200))
    order.remove(150), order.insert(170, 150)  # comes after bar 170
    for i in order:
        rows |= {r[0]: r for r in symbol.add([bars[i]])}
    corrected = (bars[190][0], 500.0, 1.0, 250.0)
    rows |= {r[0]: r for r in symbol.add([corrected])}
    bars[190] = corrected
    same([rows[d] for d in sorted(rows)], bars)
    assert symbol.add([(bars[100][0], 1.0, 1.0, 1.0)]) == [] and symbol.add([bars[-1]])[0][1:] == pytest.approx(rows[bars[-1][0]][1:])


def test_the_state_is_of_one_size():
    sizes = []
    for n in (300, 3000):
        symbol = si.Symbol()
        symbol.add(made(n, 1))
        sizes.append(len(pickle.dumps(symbol)))
    assert sizes[1] < sizes[0] * 1.2


def test_a_stream_over_several_triggers(spark, tmp_path):
    bars = {s: made(90, k) for k, s in enumerate("AB")}
    rows = [(s, *b) for s, own in bars.items() for b in own]
    frame = spark.createDataFrame(rows, "symbol string, bar_date date, high double, low double, close double")
    days = [date(2000, 1, 1) + timedelta(days=i) for i in (0, 30, 60, 90)]
    for a, b in zip(days, days[1:]):
        frame.filter((F.col("bar_date") >= a) & (F.col("bar_date") < b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with si.rocks(spark):
        out = st.merged_to_end(si.indicators(st.landed(spark, str(tmp_path / "in"), frame.schema)), ["symbol", "bar_date"], str(tmp_path / "state"), str(tmp_path / "out"))
    for s, own in bars.items():
        same([(r.bar_date, *[np.nan if r[c] is None else r[c] for c in si.COLUMNS]) for r in out.filter(F.col("symbol") == s).orderBy("bar_date").collect()], own)


def test_records_of_a_symbol_fire_each_alert_once(spark, tmp_path):
    import os
    import random
    from datetime import datetime, timedelta

    from tidemark.streaming import bars as st

    r = random.Random(4)
    ticks = [(s, datetime(2001, 1, 1) + timedelta(days=i), float(r.randrange(20, 60))) for s in "AB" for i in range(60)]
    items = [(i, "ABC"[i % 3], float(r.randrange(10, 70)), ("above", "below")[i % 2]) for i in range(120)]
    for k in range(3):  # twenty days land together
        spark.createDataFrame([x for j, x in enumerate(ticks) if j % 60 // 20 == k], "symbol string, bar_ts timestamp, close double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/k={k}")
        fs = [f for f in (tmp_path / "in" / f"k={k}").iterdir() if f.suffix == ".parquet"]
        for f in fs:
            os.utime(f, (1000 + k, 1000 + k))
    bars = st.landed(spark, f"{tmp_path}/in", "symbol string, bar_ts timestamp, close double, k int")
    watched = spark.createDataFrame(items, "item_id long, symbol string, target double, direction string")
    records = st.records(bars)
    out = st.run_to_end(st.crossed(records, watched), f"{tmp_path}/state", f"{tmp_path}/out")
    got = sorted((x.item_id, x.fired_at, x.close) for x in out.collect())
    met = lambda d, c, t: c >= t if d == "above" else c <= t
    want = [(i, *min((ts, c) for y, ts, c in ticks if y == s and met(d, c, t))) for i, s, t, d in items if any(y == s and met(d, c, t) for y, _, c in ticks)]
    assert got == sorted(want) and 0 < len(want) < len(items)


def test_bars_of_a_trigger_are_taken_once_and_symbols_by_buckets(spark, monkeypatch):
    taken, add = [], si.State.add
    monkeypatch.setattr(si.State, "add", lambda self, bars: taken.append(len(bars)) or add(self, bars))
    bars, symbol = made(400, 5), si.Symbol()
    same(symbol.add(bars), bars)
    assert sum(taken) == 400
    frame = spark.createDataFrame([("A", *b) for b in bars[:2]], "symbol string, bar_date date, high double, low double, close double")
    plan = si.indicators(frame)._jdf.queryExecution().logical().toString()
    assert "bucket" in plan


def test_late_bars_that_come_together_equal_the_whole_history():
    bars, symbol, rows = made(300, 8), si.Symbol(), {}
    late = [250, 255, 269]
    rows |= {r[0]: r for r in symbol.add([b for i, b in enumerate(bars[:270]) if i not in late])}
    rows |= {r[0]: r for r in symbol.add([bars[i] for i in late] + bars[270:])}
    same([rows[d] for d in sorted(rows)], bars)
