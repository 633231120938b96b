"""Technical indicators: plain windows where a frame says it, one grouped map for the recursive ones."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, IntegerType, StructType

from tidemark.functions.windows import full, lag, last, sma

DAYS = 252


def true_range() -> Column:
    """The widest of high - low, |high - previous close|, |low - previous close|; the first bar has only the first."""
    pc = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def donchian(n: int = 20) -> dict[str, Column]:
    up, low = full(F.max("high").over(last(n)), "high", n), full(F.min("low").over(last(n)), "low", n)
    return {"upper": up, "lower": low, "middle": (up + low) / 2}


def bollinger(n: int = 20, k: float = 2.0) -> dict[str, Column]:
    """Mean and mean -/+ k population deviations."""
    mid, dev = sma("close", n), full(F.stddev_pop("close").over(last(n)), "close", n)
    return {"bb_mid": mid, "bb_upper": mid + k * dev, "bb_lower": mid - k * dev}


def avg_dollar_volume(n: int = 20) -> Column:
    return sma(F.col("close") * F.col("volume"), n)


def yang_zhang_parts() -> dict[str, Column]:
    """Overnight and open-to-close log returns, and the Rogers-Satchell term of a bar."""
    u, d, c = F.ln(F.col("high") / F.col("open")), F.ln(F.col("low") / F.col("open")), F.ln(F.col("close") / F.col("open"))
    return {"yz_o": F.ln(F.col("open") / lag("close")), "yz_c": c, "yz_rs": u * (u - c) + d * (d - c)}


def yang_zhang_k(n: float) -> float:
    return 0.34 / (1.34 + (n + 1) / (n - 1)) if n > 1 else 0.0


def yang_zhang(n: int) -> Column:
    """Annualised volatility over n bars, from the columns of yang_zhang_parts; null for the first n rows."""
    k = yang_zhang_k(n)
    var = F.var_samp("yz_o").over(last(n)) + k * F.var_samp("yz_c").over(last(n)) + (1 - k) * F.avg("yz_rs").over(last(n))
    return full(F.sqrt(F.greatest(var, F.lit(0.0)) * DAYS), "yz_o", n)


# Recursive indicators. Arrays with NaN for missing; NaN never reaches a Spark column.


def ema(x: np.ndarray, n: int) -> np.ndarray:
    """Exponential mean of span n that starts at the first value and shows after n values."""
    s = pd.Series(x)
    return s.ewm(span=n, adjust=False, min_periods=n).mean().to_numpy()


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's mean: the mean of the first n rows at row n - 1, then y += (x - y) / n."""
    out = np.full(len(x), np.nan)
    if len(x) < n or np.isnan(x[:n]).all():
        return out
    rest = x[n:]
    known = len(rest) if not np.isnan(rest).any() else int(np.argmax(np.isnan(rest)))  # a gap ends the recurrence
    start = np.concatenate([[np.nanmean(x[:n])], rest[:known]])
    out[n - 1 : n + known] = pd.Series(start).ewm(alpha=1 / n, adjust=False).mean().to_numpy()
    return out


def _diff(c: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.nan], np.diff(c)])[: len(c)]


def rsi(c: np.ndarray, n: int = 14) -> np.ndarray:
    """100 - 100 / (1 + gain / loss) of Wilder means; no loss: 100, no gain: 0; missing for the first n - 1 rows."""
    d = _diff(c)
    gain, loss = wilder(np.where(np.isnan(d), d, np.maximum(d, 0)), n), wilder(np.where(np.isnan(d), d, np.maximum(-d, 0)), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(loss > 0, np.where(gain > 0, 100 - 100 / (1 + gain / loss), 0.0), 100.0)
    return np.where(np.isnan(gain), np.nan, out)


def _range(h: np.ndarray, low: np.ndarray, c: np.ndarray) -> np.ndarray:
    pc = np.concatenate([[np.nan], c[:-1]])[: len(c)]
    return np.fmax(h - low, np.fmax(np.abs(h - pc), np.abs(low - pc)))


def atr(h: np.ndarray, low: np.ndarray, c: np.ndarray, n: int = 14) -> np.ndarray:
    return wilder(_range(h, low, c), n)


def adx(h: np.ndarray, low: np.ndarray, c: np.ndarray, n: int = 14) -> np.ndarray:
    """Average directional index; the directional index counts as 0 before it exists."""
    up, down = _diff(h), -_diff(low)
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    tr, p, m = wilder(_range(h, low, c), n), wilder(plus, n), wilder(minus, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        dp, dm = 100 * p / tr, 100 * m / tr
        dx = 100 * np.abs(dp - dm) / (dp + dm)
    return wilder(np.where(np.isfinite(dx), dx, 0.0), n)


def macd(c: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray]:
    line = ema(c, fast) - ema(c, slow)
    first = np.argmax(~np.isnan(line)) if (~np.isnan(line)).any() else len(line)
    sig = np.full(len(line), np.nan)
    sig[first:] = ema(line[first:], signal)
    return line, sig


def yang_zhang_ewm(o: np.ndarray, h: np.ndarray, low: np.ndarray, c: np.ndarray, lam: float = 0.94) -> np.ndarray:
    """Yang-Zhang volatility with exponentially weighted, debiased variances."""
    with np.errstate(divide="ignore", invalid="ignore"):
        pc = np.concatenate([[np.nan], c[:-1]])[: len(c)]
        on, oc, u, d = np.log(o / pc), np.log(c / o), np.log(h / o), np.log(low / o)
    rs = u * (u - oc) + d * (d - oc)
    k = yang_zhang_k((1 + lam) / (1 - lam))
    w = {"alpha": 1 - lam, "adjust": False}
    var = pd.Series(on).ewm(**w).var(bias=False) + k * pd.Series(oc).ewm(**w).var(bias=False) + (1 - k) * pd.Series(rs).ewm(**w).mean()
    return np.sqrt(np.maximum(var.to_numpy(), 0) * DAYS)


def median_before(x: np.ndarray, n: int, skip: int) -> np.ndarray:
    """The median of the n values that end `skip` before each one (fewer at the start), by a skip list: O(log n) a value."""
    return pd.Series(x).rolling(n, min_periods=1).median().shift(skip).to_numpy()


# Long frames. Spark adds up a moving frame anew for each row, row by row; here a symbol's frames are columns of one array.


def _frames(x: np.ndarray, n: int, skip: int = 0) -> np.ndarray:
    """A row for each value: the n values that end `skip` before it, NaN before the first."""
    return sliding_window_view(np.concatenate([np.full(n - 1 + skip, np.nan), x]), n)[: len(x)]


def mean_last(x: np.ndarray, n: int) -> np.ndarray:
    """The mean of the last n values, added from the oldest on; NaN with a missing one."""
    p = np.concatenate([np.full(n - 1, np.nan), x])
    total = p[: len(x)].copy()
    for i in range(1, n):
        total += p[i : i + len(x)]
    return total / n


def mean_before(x: np.ndarray, n: int) -> np.ndarray:
    """The mean of those of the n values before each one that there are."""
    f = _frames(x, n, 1)
    known = ~np.isnan(f)
    with np.errstate(invalid="ignore"):
        return np.where(known, f, 0.0).sum(1) / known.sum(1)


def highest_last(x: np.ndarray, n: int) -> np.ndarray:
    return _frames(x, n).max(1)


def squeeze(c: np.ndarray, n: int, width: int = 20) -> np.ndarray:
    """The share of the band widths (4 deviations over the mean of `width` closes) of the n bars before that are at most the last of these."""
    f = _frames(c, width)
    mean = f.mean(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        bands = np.round(4 * np.sqrt(((f - mean[:, None]) ** 2).sum(1) / (width - 1)) / mean, 9)
        before = _frames(bands, n, 1)
        return (before <= before[:, -1:]).sum(1) / (~np.isnan(before)).sum(1)


def slope_quality_last(c: np.ndarray, n: int) -> np.ndarray:
    """slope_quality() of the last n bars."""
    with np.errstate(divide="ignore", invalid="ignore"):
        f = _frames(np.log(c), n)
        y, x = f - f.mean(1)[:, None], np.arange(n) - (n - 1) / 2
        xy, xx, yy = y @ x, float(x @ x), (y * y).sum(1)
        fit = np.where(yy > 0, xy * xy / (xx * yy), np.where(np.isnan(yy), np.nan, 0.0))
        return 1 / (1 + np.exp(-3 * (xy / xx) * DAYS * fit))


def swings(x: np.ndarray, c: np.ndarray, k: int, look: int) -> np.ndarray:
    """The greatest swing low of x at or under the close: the least of the k bars on both sides, seen from k to `look` bars later. NaN: none."""
    least = np.append(_frames(x, 2 * k + 1)[k:].min(1), np.full(min(k, len(x)), np.nan))
    seen = _frames(np.where(x == least, x, np.nan), look - k + 1, k)
    best = np.where(seen <= c[:, None], seen, -np.inf).max(1)
    return np.where(np.isfinite(best), best, np.nan)


def volume_scores(h: np.ndarray, low: np.ndarray, c: np.ndarray, v: np.ndarray, base: int, spike: float) -> np.ndarray:
    """The strongest rejection of the last RECENT bars, against the median volume and spread of the `base` bars before them: in [0, 1]."""
    volume, spread = median_before(v, base, RECENT), median_before(h - low, base, RECENT)
    pc = np.concatenate([[np.nan], c[:-1]])[: len(c)]
    best = np.zeros(len(c))
    with np.errstate(divide="ignore", invalid="ignore"):
        clv = ((c - low) - (h - c)) / (h - low)
        turned = np.where((c < pc) & (clv > 0), clv, np.where((c > pc) & (clv < 0), -clv, 0.0))
        for b in range(RECENT):
            rng, vol, turn = (np.concatenate([np.full(b, np.nan), x])[: len(c)] for x in (h - low, v, turned))
            rvol, ratio = vol / volume, rng / spread
            strength = np.clip((rvol - spike) / spike, 0.0, 1.0)
            weight = np.where(ratio >= 1.3, 1.0, np.where(ratio <= 0.7, 0.85, 0.5))
            best = np.fmax(best, np.where((rng > 0) & (rvol >= 1), strength * turn * weight, 0.0))
        return np.where((volume > 0) & (spread > 0), best, np.nan)


def _ago(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([np.full(n, np.nan), x])[: len(x)]


def deviation_last(x: np.ndarray, n: int) -> np.ndarray:
    """The sample deviation of the last n values; NaN with a missing one, 0 for equal ones."""
    f = _frames(x, n)
    f = f - f[:, :1]  # equal values differ by nothing, whatever their size
    return np.sqrt(((f - f.mean(1)[:, None]) ** 2).sum(1) / (n - 1))


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x > 0, np.log(x), np.nan)


def yang_zhang_last(o: np.ndarray, h: np.ndarray, low: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """yang_zhang() of the last n bars."""
    with np.errstate(divide="ignore", invalid="ignore"):
        u, d, oc, gap = _log(h / o), _log(low / o), _log(c / o), _log(o / _ago(c, 1))
    k, rs = yang_zhang_k(n), _frames(u * (u - oc) + d * (d - oc), n).mean(1)
    var = deviation_last(gap, n) ** 2 + k * deviation_last(oc, n) ** 2 + (1 - k) * rs
    return np.sqrt(np.maximum(var, 0.0) * DAYS)


def rank_last(x: np.ndarray, n: int) -> np.ndarray:
    """The share of the last n values that are at most the current one; NaN with a missing one."""
    f = _frames(x, n)
    share = (f <= x[:, None]).sum(1) / n
    known = pd.Series(~np.isnan(x)).rolling(n).sum().to_numpy() == n
    return np.where(known, share, np.nan)


def _rounded(x: np.ndarray) -> np.ndarray:
    """x to 6 digits, halves up, as columns of volatilities are."""
    return np.floor(x * 1e6 + 0.5) / 1e6


def barrier(h: np.ndarray, low: np.ndarray, c: np.ndarray, stop: np.ndarray, target: np.ndarray, hold: int) -> np.ndarray:
    """operators.trading.triple_barrier() as numbers: 1, 0, NaN for no label."""
    ahead = lambda x: sliding_window_view(np.concatenate([x[1:], np.full(hold, np.nan)]), hold)[: len(x)]
    lows, highs = ahead(low), ahead(h)
    hits = (lows <= stop[:, None]) | (highs >= target[:, None])
    first, rows = hits.argmax(1), np.arange(len(c))
    end = c[np.minimum(rows + hold, len(c) - 1)]
    label = np.where(hits.any(1), np.where(lows[rows, first] <= stop, 0.0, 1.0), (end > c) * 1.0)
    return np.where((rows < len(c) - 1) & (stop < c) & (c < target), label, np.nan)


def strength(c: np.ndarray, level: np.ndarray, look: int) -> np.ndarray:
    """operators.primitives.relative_strength() of closes against the levels of a series on the same days."""
    with np.errstate(divide="ignore", invalid="ignore"):
        rs = np.clip(((c / _ago(c, look) - 1) - (level / _ago(level, look) - 1)) / 0.15, -1.0, 1.0)
        mean = mean_last(c / level, 20)
        then = _ago(mean, 20)
        slope = np.clip((mean - then) / then / 0.05, -1.0, 1.0)
    return np.clip(0.7 * rs + 0.3 * np.where(np.isnan(slope), 0.0, slope), -1.0, 1.0)


#: Bars after the base of volumes and spreads: the ones that are compared with it.
RECENT = 5


#: name -> function of the bars' arrays (o, h, low, c, v); macd makes three columns.
def _named(name: str):
    kind = re.sub(r"_?\d+", "", name)
    n, m = [*map(int, re.findall(r"\d+", name)), 0, 0][:2]
    return {
        "ema": lambda o, h, low, c, v: ema(c, n),
        "rsi": lambda o, h, low, c, v: rsi(c, n),
        "atr": lambda o, h, low, c, v: atr(h, low, c, n),
        "adx": lambda o, h, low, c, v: adx(h, low, c, n),
        "yz_ewm": lambda o, h, low, c, v: yang_zhang_ewm(o, h, low, c),
        "macd": lambda o, h, low, c, v: macd(c)[0],
        "macd_signal": lambda o, h, low, c, v: macd(c)[1],
        "volume_median": lambda o, h, low, c, v: median_before(v, n, RECENT),
        "spread_median": lambda o, h, low, c, v: median_before(h - low, n, RECENT),
        "volume_score": lambda o, h, low, c, v: volume_scores(h, low, c, v, n, m / 100),
        "sma": lambda o, h, low, c, v: mean_last(c, n),
        "closeness": lambda o, h, low, c, v: c / highest_last(c, n),
        "slope_quality": lambda o, h, low, c, v: slope_quality_last(c, n),
        "prior": lambda o, h, low, c, v: _frames(c, n, 1).max(1),
        "high_before": lambda o, h, low, c, v: np.fmax.reduce(_frames(h, n, 1), axis=1),
        "low_before": lambda o, h, low, c, v: np.fmin.reduce(_frames(low, n, 1), axis=1),
        "volume_before": lambda o, h, low, c, v: mean_before(v, n),
        "squeeze": lambda o, h, low, c, v: squeeze(c, n),
        "support": lambda o, h, low, c, v: swings(low, c, n, m),
        "resistance": lambda o, h, low, c, v: -swings(-h, -c, n, m),
        "tr": lambda o, h, low, c, v: _range(h, low, c),
        "high_last": lambda o, h, low, c, v: np.fmax.reduce(_frames(h, n), axis=1),
        "low_last": lambda o, h, low, c, v: np.fmin.reduce(_frames(low, n), axis=1),
        "close_ago": lambda o, h, low, c, v: _ago(c, n),
        "ret": lambda o, h, low, c, v: c / _ago(c, n) - 1,
        "vol": lambda o, h, low, c, v: deviation_last(_log(c / _ago(c, 1)), n) * DAYS**0.5,
        "nearness": lambda o, h, low, c, v: c / pd.Series(c).rolling(n, min_periods=1).max().to_numpy(),
        "yz": lambda o, h, low, c, v: yang_zhang_last(o, h, low, c, n),
        "yz_rank": lambda o, h, low, c, v: rank_last(_rounded(100 * yang_zhang_last(o, h, low, c, n)), m),
    }[kind]


#: Types of columns that are no doubles, by the names without numbers.
TYPES = {"rn": IntegerType(), "reach": DateType()}


def _made(name: str, rows: pa.Table, arrays: list, order: str) -> pa.Array:
    """One column of with_recursive() from a symbol's sorted rows with the columns made so far."""
    kind = re.sub(r"_?\d+", "", name)
    numbers = [int(x) for x in re.findall(r"\d+", name)]
    number = lambda c: rows.column(c).cast(pa.float64()).to_numpy()
    if kind == "rn":
        return pa.array(np.arange(1, rows.num_rows + 1), pa.int32())
    if kind == "reach":
        return rows.column(order).combine_chunks().take(pa.array(np.minimum(np.arange(rows.num_rows) + numbers[0], rows.num_rows - 1)))
    if kind == "hist":
        made = number("macd") - number("macd_signal")
    elif name.endswith("_prev"):
        made = _ago(number(name.removesuffix("_prev")), 1)
    elif kind == "rs":
        made = strength(arrays[3], number("level"), numbers[0])
    elif kind == "barrier":
        _, h, low, c, _ = arrays
        a = number("atr14")
        made = barrier(h, low, c, c - numbers[0] / 10 * a, c + numbers[1] / 10 * a, numbers[2])
    else:
        made = _named(name)(*arrays)
    return pa.array(np.asarray(made, float), from_pandas=True)


def with_recursive(bars: DataFrame, names: list[str], key: str = "symbol", order: str = "bar_date") -> DataFrame:
    """bars (symbol, bar_date, open, high, low, close, ...) with recursive columns such as ema12, rsi14,
    atr14, adx14, macd, macd_signal, yz_ewm, over each symbol's whole history, the medians volume_median50 and
    spread_median50 of the bars before the last RECENT, and columns of long frames such as sma200, closeness252,
    slope_quality90, prior55, high_before20, squeeze126, support_3_60; one shuffle for all of them.

    rn numbers a symbol's bars from 1; x_prev is the column x (of bars, or one of an earlier name) of the bar before, close_ago60
    the close 60 bars before; hist reads macd and macd_signal, rs63 the column level, barrier_25_20_20 (stop at 2.5 and
    target at 2.0 times atr14, within 20 bars) the column atr14; reach20 is the day 20 bars on, or the last one."""
    schema = StructType([*bars.schema.fields])
    for n in names:
        schema = schema.add(n, TYPES.get(re.sub(r"_?\d+", "", n), DoubleType()))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        arrays = [rows.column(c).cast(pa.float64()).to_numpy() if c in rows.column_names else None for c in ("open", "high", "low", "close", "volume")]
        for n in names:
            rows = rows.append_column(n, _made(n, rows, arrays, order))
        return rows

    return bars.groupBy(key).applyInArrow(run, schema)


def with_missing(bars: DataFrame, names: list[str]) -> DataFrame:
    """bars with those of the columns of with_recursive() that it doesn't have."""
    missing = [n for n in names if n not in bars.columns]
    return with_recursive(bars, missing) if missing else bars


def slope_quality(n: int = 90) -> Column:
    """Sigmoid of three times the annualised slope of ln(close) over n bars, weighted by the fit's R squared.

    Needs a column `rn`, the number of the bar; the slope depends on its differences only.
    """
    w = last(n)
    slope, r2 = F.regr_slope(F.ln("close"), F.col("rn")).over(w), F.regr_r2(F.ln("close"), F.col("rn")).over(w)
    return full(1 / (1 + F.exp(-3 * slope * DAYS * F.greatest(F.lit(0.0), F.coalesce(r2, F.lit(0.0))))), "close", n)
