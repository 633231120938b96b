"""Recursive indicators one bar at a time: the state of a symbol is of one size, however long its history is.

The numbers are those of functions.ta over the whole history, bit for bit: the same recurrences, with seeds kept
until they are complete, sums over a ring of closes, and monotone queues for highs and lows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

NAN = float("nan")
#: Bars that may come late: the state keeps them, and what it was before them.
TAIL = 32
#: Buckets of symbols by their hash; fixed while a stream's checkpoint lives.
BUCKETS = 512
COLUMNS = ("ema12", "ema26", "macd", "macd_signal", "rsi14", "atr14", "adx14", "sma50", "high20", "low20")
OUT = "symbol string, bar_date date, " + ", ".join(f"{c} double" for c in COLUMNS)


class Mean:
    """An exponential mean: from the first value on, shown after n values."""

    def __init__(self, alpha: float, n: int):
        com = (1 - alpha) / alpha
        self.alpha, self.n, self.seen, self.value = 1.0 / (1.0 + com), n, 0, NAN

    def add(self, xs: list[float]) -> list[float]:
        value, alpha, old, out = self.value, self.alpha, 1.0 - self.alpha, []
        if xs and not self.seen:
            value = xs[0]
        for x in xs:
            if value != x:
                value = (old * value + alpha * x) / (old + alpha)
            out.append(value)
        hidden = max(0, min(self.n - 1 - self.seen, len(xs)))
        self.value, self.seen = value, self.seen + len(xs)
        return [NAN] * hidden + out[hidden:]


class Wilder:
    """Wilder's mean: the mean of the first n values that there are, then a step of 1 / n to each value."""

    def __init__(self, n: int):
        self.n, self.seed, self.mean = n, [], None

    def add(self, xs: list[float]) -> list[float]:
        out = []
        if self.mean is None:
            xs, taken = xs[self.n - len(self.seed) :], xs[: self.n - len(self.seed)]
            self.seed, out = self.seed + taken, [NAN] * len(taken)
            if len(self.seed) < self.n:
                return out
            self.mean = Mean(1 / self.n, 1)
            out[-1:] = self.mean.add([float(np.nanmean(self.seed))])
            self.seed = []
        return out + self.mean.add(xs)


class Best:
    """The greatest of the last n values; the last n - 1 are kept."""

    def __init__(self, n: int):
        self.n, self.last = n, np.zeros(0)

    def add(self, x: np.ndarray) -> np.ndarray:
        known = np.concatenate([self.last, x])
        out = np.full(len(x), NAN)
        if len(known) >= self.n:
            out[self.n - 1 - len(self.last) :] = sliding_window_view(known, self.n).max(1)
        self.last = known[1 - self.n :].copy()
        return out


class State:
    """All indicators of a symbol after some bars."""

    def __init__(self):
        self.day: date | None = None
        self.bar = (NAN, NAN, NAN)
        self.fast, self.slow, self.signal = Mean(2 / 13, 12), Mean(2 / 27, 26), Mean(2 / 10, 9)
        self.gain, self.loss, self.range, self.plus, self.minus, self.dx = (Wilder(14) for _ in range(6))
        self.closes, self.sum = [], 0.0
        self.high, self.low = Best(20), Best(20)

    def add(self, bars: list[tuple]) -> np.ndarray:
        """Takes bars (day, high, low, close), at least one, in the order of their days; a row of COLUMNS for each."""
        high, low, close = (np.array(x) for x in list(zip(*bars))[1:])
        ph, pl, pc = (np.concatenate([[was], x[:-1]]) for was, x in zip(self.bar, (high, low, close)))
        self.day, self.bar = bars[-1][0], bars[-1][1:]
        closes = close.tolist()
        fast, slow = np.array(self.fast.add(closes)), np.array(self.slow.add(closes))
        macd = fast - slow
        known = macd == macd
        signal = np.full(len(bars), NAN)
        signal[known] = self.signal.add(macd[known].tolist())
        step = close - pc
        gain, loss = np.array(self.gain.add(np.maximum(step, 0.0).tolist())), np.array(self.loss.add(np.maximum(-step, 0.0).tolist()))
        tr = np.fmax(high - low, np.fmax(np.abs(high - pc), np.abs(low - pc)))
        up, down = high - ph, -(low - pl)
        atr, plus, minus = (np.array(w.add(x.tolist())) for w, x in ((self.range, tr), (self.plus, np.where((up > down) & (up > 0), up, 0.0)), (self.minus, np.where((down > up) & (down > 0), down, 0.0))))
        with np.errstate(divide="ignore", invalid="ignore"):
            rsi = np.where(gain != gain, NAN, np.where(loss > 0, np.where(gain > 0, 100 - 100 / (1 + gain / loss), 0.0), 100.0))
            dp, dm = 100 * plus / atr, 100 * minus / atr
            dx = 100 * np.abs(dp - dm) / (dp + dm)
        adx = self.dx.add(np.where(np.isfinite(dx), dx, 0.0).tolist())
        return np.column_stack([fast, slow, macd, signal, rsi, atr, adx, self._means(closes), self.high.add(high), -self.low.add(-low)])

    def _means(self, closes: list[float]) -> list[float]:
        known, start, total, out = self.closes + closes, len(self.closes), self.sum, []
        for i in range(start, len(known)):
            total += known[i]
            if i >= 50:
                total -= known[i - 50]
            out.append(total / 50 if i >= 49 else NAN)
        self.closes, self.sum = known[-50:], total
        return out


class Symbol:
    """The state after all bars, the last TAIL bars, and the state before them."""

    def __init__(self):
        self.before, self.now, self.tail = State(), State(), []

    def add(self, bars: list[tuple]) -> list[tuple]:
        """Takes bars (day, high, low, close) in the order of their days; returns rows (day, *COLUMNS) that are new or have changed.

        A bar of a day that is in the tail, or falls between its days, takes its place there, and all bars from it on are
        made again; a bar from before the tail is too late and changes nothing. Of several bars of a day the last counts.
        """
        days, rows = self.changed(bars)
        return [(d, *row) for d, row in zip(days, rows.tolist())]

    def changed(self, bars: list[tuple]) -> tuple[list[date], np.ndarray]:
        """add(), as days and their rows. A bar that comes in order is taken once, and once more only if fewer than TAIL come with it."""
        last, least = self.now.day, self.before.day
        new = list({b[0]: b for b in bars if last is None or b[0] > last}.values())
        late = {b[0]: b for b in bars if last is not None and b[0] <= last and (least is None or b[0] > least)}
        days, rows = [], [np.zeros((0, len(COLUMNS)))]
        if late:
            first = min(late)
            self.tail = sorted(({b[0]: b for b in self.tail} | late).values())
            self.now = pickle.loads(pickle.dumps(self.before))
            made, at = self.now.add(self.tail), [i for i, b in enumerate(self.tail) if b[0] >= first]
            days += [self.tail[i][0] for i in at]
            rows.append(made[at])
            self._shift()
        if len(new) > TAIL:
            # The state that the new tail needs is met on the way.
            rows.append(self.now.add(new[:-TAIL]))
            self.before, self.tail = pickle.loads(pickle.dumps(self.now)), []
            rows.append(self.now.add(new[-TAIL:]))
            self.tail = new[-TAIL:]
        elif new:
            rows.append(self.now.add(new))
            self.tail = self.tail + new
            self._shift()
        return days + [b[0] for b in new], np.concatenate(rows)

    def _shift(self) -> None:
        out = len(self.tail) - TAIL
        if out > 0:
            self.before.add(self.tail[:out])
            self.tail = self.tail[out:]


class Processor(StatefulProcessor):
    """The states of a bucket's symbols are read, written and handed on together: a call costs more than a symbol's bars."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "packed binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = self.state.get()
        symbols = pickle.loads(bytes(was[0])) if was else {}
        came: dict[str, set] = {}
        for part in rows:
            for symbol, *bar in zip(part["symbol"].tolist(), part["bar_date"].tolist(), *(part[c].astype(float).tolist() for c in ("high", "low", "close"))):
                came.setdefault(symbol, set()).add(tuple(bar))
        names, days, made = [], [], []
        for symbol, bars in came.items():
            own, values = symbols.setdefault(symbol, Symbol()).changed(sorted(bars))
            names += [symbol] * len(own)
            days += own
            made.append(values)
        self.state.update((pickle.dumps(symbols, -1),))
        out = pd.DataFrame(np.concatenate(made), columns=list(COLUMNS))  # NaN becomes null on its way to Spark
        out.insert(0, "bar_date", pd.Series(days, dtype=object))
        out.insert(0, "symbol", pd.Series(names, dtype=object))
        yield out

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession):
    """The state store that such state needs, for the streams that start inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)


def indicators(bars: DataFrame) -> DataFrame:
    """A stream of bars (symbol, bar_date, high, low, close; none null) as rows of indicators: one for each bar, and new ones
    for the bars that a late one changes, so the last row of a day counts. A symbol's state holds some hundred numbers; those of
    a bucket lie together, so a trigger writes the states of the buckets in which a bar came.

    Of several bars of one day in a trigger, the greatest in high, low and close counts. To be started within rocks().
    """
    rows = bars.select("symbol", "bar_date", "high", "low", "close").withColumn("bucket", F.pmod(F.xxhash64("symbol"), F.lit(BUCKETS))).groupBy("bucket")
    return rows.transformWithStateInPandas(Processor(), OUT, "Update", "None")
