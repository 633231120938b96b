"""Composite reads of a bar: trend, reversal, pivots, volume, relative strength, retracements.

Each is a column set over (symbol, bar_date): the row of a date reads bars up to that date only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ta
from tidemark.functions.windows import by_symbol, clip, lag, last, sma
from tidemark.operators.store import as_of


def numbered(bars: DataFrame) -> DataFrame:
    """bars with rn, the number of the bar in its symbol's history."""
    return bars if "rn" in bars.columns else bars.withColumn("rn", F.row_number().over(by_symbol()))


def trend_location(bars: DataFrame) -> DataFrame:
    """bars with trend_raw in [-1, 1] from bar 60 on: place against SMA 50 (and, from bar 220, SMA 200) and SMA 50's slope."""
    df = numbered(bars)
    df = df.withColumns({f"sma{n}": sma("close", n) for n in (50, 200) if f"sma{n}" not in df.columns})
    before_50 = lag("sma50", 20)
    pos50 = clip((F.col("close") - F.col("sma50")) / F.col("sma50") / 0.10)
    pos200 = clip((F.col("close") - F.col("sma200")) / F.col("sma200") / 0.25)
    slope = F.coalesce(clip((F.col("sma50") - before_50) / before_50 / 0.05), F.lit(0.0))
    raw = F.when(F.col("rn") >= 220, 0.4 * pos50 + 0.2 * pos200 + 0.4 * slope).otherwise(0.5 * pos50 + 0.5 * slope)
    return df.withColumn("trend_raw", F.when(F.col("rn") >= 60, raw))


def reversal_trigger(bars: DataFrame) -> DataFrame:
    """bars (with rn, rsi2) with reversal_raw: how far RSI(2) was stretched in two bars, if it and the close turned."""
    before = lambda c: F.col(f"{c}_prev") if f"{c}_prev" in bars.columns else lag(c)
    a, b, c, pc = F.col("rsi2"), before("rsi2"), F.col("close"), before("close")
    low, high = F.least(a, b), F.greatest(a, b)
    half = lambda cond: F.when(cond, 0.5).otherwise(0.0)
    bull = F.when(low <= 10, clip((10 - low) / 10, 0.0) * (half(a > b) + half(c > pc))).otherwise(0.0)
    bear = F.when(high >= 90, clip((high - 90) / 10, 0.0) * (half(a < b) + half(c < pc))).otherwise(0.0)
    return bars.withColumn("reversal_raw", F.when((F.col("rn") >= 15) & a.isNotNull() & b.isNotNull(), clip(bull - bear)))


def pivot_proximity(bars: DataFrame, k: int = 3, look: int = 60, reach: float = 1.5) -> DataFrame:
    """bars (with rn, atr14) with support, resistance, near_sup, near_res, pivot_raw.

    A swing low is the least of the k bars on both sides; it counts from k bars later on, so the centred
    frame never shows a later bar: candidates of row t end at t - k.
    """
    names = {"support": f"support_{k}_{look}", "resistance": f"resistance_{k}_{look}"}
    found = ta.with_missing(bars, [*names.values(), "low_last3", "high_last3"])
    found = found.withColumns({"__l3": F.col("low_last3"), "__h3": F.col("high_last3"), **{c: F.col(n) for c, n in names.items()}})
    ready = (F.col("rn") >= look + k + 1) & (F.col("atr14") > 0)
    closeness = lambda gap: F.coalesce(clip(1 - gap / (reach * F.col("atr14")), 0.0), F.lit(0.0))
    out = found.withColumns({"near_sup": F.when(ready, closeness(F.col("__l3") - F.col("support"))), "near_res": F.when(ready, closeness(F.col("resistance") - F.col("__h3")))})
    return out.withColumns({"support": F.when(ready, F.col("support")), "resistance": F.when(ready, F.col("resistance")), "pivot_raw": clip(F.col("near_sup") - F.col("near_res"))}).drop("__l3", "__h3", "low_last3", "high_last3", *names.values())


def volume_confirm(bars: DataFrame, base: int = 50, spike: float = 1.5, floor: float = 0.75) -> DataFrame:
    """bars (with rn) with volume_score in [0, 1] and volume_multiplier in [floor, 1].

    The baseline of a row is the median volume and spread of the `base` bars before its last ta.RECENT bars;
    the strongest rejection among those bars counts. `spike` counts in hundredths. The score is made with the recursive indicators where
    bars don't have it already (volume_score_50_150).
    """
    name = f"volume_score_{base}_{round(100 * spike)}"
    df = ta.with_missing(bars, [name])
    df = df.withColumn("volume_score", F.when(F.col("rn") >= base + ta.RECENT + 1, F.col(name)))
    return df.withColumn("volume_multiplier", floor + (1 - floor) * clip(F.col("volume_score"), 0.0)).drop(name)


def relative_strength(bars: DataFrame, series: DataFrame | None, keys: list[str], look: int = 63) -> DataFrame:
    """bars (with rn and keys) with rs_raw: 63-bar return against the keyed series' (keys, bar_date, level), and the slope of the ratio's SMA 20.

    The series is read as of each bar; without one, bars have the level already. Bars without a value of it,
    and the first 63 bars, have null.
    """
    df = bars if series is None else as_of(bars, series, keys, "bar_date", ["level"])
    own, ref = F.col("close") / lag("close", look) - 1, F.col("level") / lag("level", look) - 1
    rs = clip((own - ref) / 0.15)
    df = df.withColumn("__rs", rs).withColumn("__line", F.col("close") / F.col("level")).withColumn("__avg", sma("__line", 20))
    then = lag("__avg", 20)
    slope = F.coalesce(clip((F.col("__avg") - then) / then / 0.05), F.lit(0.0))
    return df.withColumn("rs_raw", F.when((F.col("rn") > look) & F.col("__rs").isNotNull(), clip(0.7 * F.col("__rs") + 0.3 * slope))).drop("__rs", "__line", "__avg", "level")


def fibonacci(bars: DataFrame, n: int = 120) -> DataFrame:
    """bars (with rn) with fib: high, low, direction and levels of the last n bars, measured from the high; null where flat or short."""
    w = last(n)
    hi, lo = F.max("high").over(w), F.min("low").over(w)
    at_hi = F.max_by("rn", F.struct("high", -F.col("rn"))).over(w)
    at_lo = F.min_by("rn", F.struct("low", "rn")).over(w)
    levels = F.transform(F.array(*[F.lit(x) for x in (0.236, 0.382, 0.5, 0.618, 0.786)]), lambda r: hi - r * (hi - lo))
    fib = F.struct(hi.alias("high"), lo.alias("low"), F.when(at_hi >= at_lo, "down_from_high").otherwise("up_from_low").alias("direction"), levels.alias("levels"))
    return bars.withColumn("fib", F.when((F.col("rn") >= n) & (hi > lo), fib))
