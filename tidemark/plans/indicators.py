"""Queries of the indicator library: every bar of every symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ta
from tidemark.functions.windows import by_symbol, sma
from tidemark.plans.registry import query
from tidemark.plans.sql import with_bars, with_tech
from tidemark.sources.driver import bars

KEYS = ["symbol", "bar_date"]


def _with(spark: SparkSession, sf_dir: str, columns: dict) -> DataFrame:
    return bars(spark, sf_dir).select(*KEYS, *[c.alias(n) for n, c in columns.items()])


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*KEYS, *[F.round(n, 6).alias(n) for n in names])


def _frame(n: int) -> str:
    return f"over (partition by symbol order by bar_date rows between {n - 1} preceding and current row)"


@query("sma", with_bars() + f" select symbol, bar_date, case when rn >= 20 then avg(close) {_frame(20)} end as sma20, case when rn >= 200 then avg(close) {_frame(200)} end as sma200 from n")
def _sma(spark, sf):
    return _with(spark, sf, {"sma20": sma("close", 20), "sma200": sma("close", 200)})


@query("true_range", with_bars() + " select symbol, bar_date, tr from n")
def _true_range(spark, sf):
    return _with(spark, sf, {"tr": ta.true_range()})


@query("donchian", with_bars() + (
    f" select symbol, bar_date, case when rn >= 20 then max(high) {_frame(20)} end as upper, case when rn >= 20 then min(low) {_frame(20)} end as lower, "
    f"case when rn >= 20 then (max(high) {_frame(20)} + min(low) {_frame(20)}) / 2 end as middle from n"
))
def _donchian(spark, sf):
    return _with(spark, sf, ta.donchian(20))


@query("bollinger", with_bars() + (
    f", b as (select symbol, bar_date, rn, avg(close) {_frame(20)} as m, stddev_pop(close) {_frame(20)} as s from n) select symbol, bar_date, case "
    f"when rn >= 20 then m end as bb_mid, case when rn >= 20 then round(m + 2 * s, 6) end as bb_upper, case "
    f"when rn >= 20 then round(m - 2 * s, 6) end as bb_lower from b"
))
def _bollinger(spark, sf):
    return _with(spark, sf, {n: c if n == "bb_mid" else F.round(c, 6) for n, c in ta.bollinger().items()})


@query("avg_dollar_volume", with_bars() + f" select symbol, bar_date, case when rn >= 20 then round(avg(close * volume) {_frame(20)}, 4) end as adv20 from n")
def _adv(spark, sf):
    return _with(spark, sf, {"adv20": F.round(ta.avg_dollar_volume(20), 4)})


_YZ = ", y as (select *, ln(open / pc) as yo, ln(close / open) as yc, ln(high / open) * (ln(high / open) - ln(close / open)) + ln(low / open) * (ln(low / open) - ln(close / open)) as rs from n)"


@query("yz_components", with_bars() + _YZ + " select symbol, bar_date, round(yo, 8) as yz_o, round(yc, 8) as yz_c, round(rs, 8) as yz_rs from y")
def _yz_components(spark, sf):
    return _with(spark, sf, {n: F.round(c, 8) for n, c in ta.yang_zhang_parts().items()})


@query("yz_k", with_bars() + " select symbol, count(*) as n, round(case when count(*) <= 1 then 0 else 0.34::double / (1.34::double + (count(*) + 1) / (count(*) - 1)::double) end, 12) as k from bars group by 1")
def _yz_k(spark, sf):
    """The weight of a window as long as each symbol's history."""
    n = F.col("n")
    sizes = bars(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("symbol", "n", F.round(F.when(n <= 1, 0.0).otherwise(0.34 / (1.34 + F.try_divide(n + 1, n - 1))), 12).alias("k"))


@query("yang_zhang", with_bars() + _YZ + (
    f", v as (select symbol, bar_date, rn, var_samp(yo) {_frame(21)} + {ta.yang_zhang_k(21)!r}::double * var_samp(yc) {_frame(21)} + "
    f"{1 - ta.yang_zhang_k(21)!r}::double * avg(rs) {_frame(21)} as v from y) select symbol, bar_date, case "
    f"when rn > 21 then round(sqrt(greatest(v, 0) * 252), 6) end as yz21 from v"
))
def _yang_zhang(spark, sf):
    return _with_parts(spark, sf).select(*KEYS, F.round(ta.yang_zhang(21), 6).alias("yz21"))


def _with_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).withColumns(ta.yang_zhang_parts())


@query("slope_quality", with_bars() + (
    f", s as (select symbol, bar_date, rn, regr_slope(ln(close), rn) {_frame(90)} as b, regr_r2(ln(close), rn) {_frame(90)} as r from n) "
    f"select symbol, bar_date, case when rn >= 90 then round(1 / (1 + exp(-3 * b * 252 * greatest(0, coalesce(r, 0)))), 6) end as slope_quality from s"
))
def _slope_quality(spark, sf):
    return bars(spark, sf).withColumn("rn", F.row_number().over(by_symbol())).select(*KEYS, F.round(ta.slope_quality(90), 6).alias("slope_quality"))


@query("ema", with_tech() + " select symbol, bar_date, round(ema9, 6) as ema9, round(ema50, 6) as ema50, round(ema200, 6) as ema200 from tech")
def _ema(spark, sf):
    return _rounded(ta.with_recursive(bars(spark, sf), ["ema9", "ema50", "ema200"]), "ema9", "ema50", "ema200")


@query("rsi", with_tech() + " select symbol, bar_date, round(rsi2, 6) as rsi2, round(rsi14, 6) as rsi14 from tech")
def _rsi(spark, sf):
    return _rounded(ta.with_recursive(bars(spark, sf), ["rsi2", "rsi14"]), "rsi2", "rsi14")


@query("wilder", with_tech() + " select symbol, bar_date, round(atr20, 6) as atr20, round(atr22, 6) as atr22 from tech")
def _wilder(spark, sf):
    return _rounded(ta.with_recursive(bars(spark, sf), ["atr20", "atr22"]), "atr20", "atr22")


@query("atr", with_tech() + " select symbol, bar_date, round(atr14, 6) as atr14 from tech")
def _atr(spark, sf):
    return _rounded(ta.with_recursive(bars(spark, sf), ["atr14"]), "atr14")


@query("adx", with_tech() + " select symbol, bar_date, round(adx14, 6) as adx14 from tech")
def _adx(spark, sf):
    return _rounded(ta.with_recursive(bars(spark, sf), ["adx14"]), "adx14")


@query("macd", with_tech() + " select symbol, bar_date, round(macd, 6) as macd, round(macd_signal, 6) as macd_signal, round(macd - macd_signal, 6) as macd_hist from tech")
def _macd(spark, sf):
    df = ta.with_recursive(bars(spark, sf), ["macd", "macd_signal"]).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    return _rounded(df, "macd", "macd_signal", "macd_hist")


_EWM = with_bars() + _YZ + """,
ye as (
  select symbol, rn, cast(yo as double) as mu, 0::double as cov, 1::double as s2 from y where rn = 2
  union all
  select b.symbol, b.rn, 0.94::double * e.mu + 0.06::double * b.yo, 0.94::double * (e.cov + (e.mu - (0.94::double * e.mu + 0.06::double * b.yo)) ** 2)
+ 0.06::double * (b.yo - (0.94::double * e.mu + 0.06::double * b.yo)) ** 2, e.s2 * 0.94::double ** 2 + 0.06::double ** 2
  from ye e join y b on b.symbol = e.symbol and b.rn = e.rn + 1),
ce as (
  select symbol, rn, cast(yc as double) as mu, 0::double as cov, 1::double as s2, cast(rs as double) as r from y where rn = 1
  union all
  select b.symbol, b.rn, 0.94::double * e.mu + 0.06::double * b.yc, 0.94::double * (e.cov + (e.mu - (0.94::double * e.mu + 0.06::double * b.yc)) ** 2)
+ 0.06::double * (b.yc - (0.94::double * e.mu + 0.06::double * b.yc)) ** 2, e.s2 * 0.94::double ** 2 + 0.06::double ** 2, 0.94::double * e.r +
0.06::double * b.rs
  from ce e join y b on b.symbol = e.symbol and b.rn = e.rn + 1)
"""
_EWM_K = ta.yang_zhang_k((1 + 0.94) / (1 - 0.94))


@query("yang_zhang_ewm", _EWM + (
    f" select y.symbol, y.bar_date, case when ye.s2 < 1 "
    f"and ce.s2 < 1 then round(sqrt(greatest(ye.cov / (1 - ye.s2) + {_EWM_K!r}::double * ce.cov / (1 - ce.s2) + {1 - _EWM_K!r}::double * ce.r, 0) * 252), 6) "
    f"end as yz_ewm from y left join ye using (symbol, rn) left join ce using (symbol, rn)"
))
def _yang_zhang_ewm(spark, sf):
    return _rounded(ta.with_recursive(bars(spark, sf), ["yz_ewm"]), "yz_ewm")
