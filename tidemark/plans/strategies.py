"""Queries of strategies, sizing, filters and scans over all symbols and dates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import ta
from tidemark.operators import primitives as p
from tidemark.operators import store
from tidemark.operators import strategies as s
from tidemark.plans.market import LABELS, PIVOTS, REGIME, REVERSAL, RS, VOLUME, clip, frame, market_labels, regime
from tidemark.plans.registry import query
from tidemark.plans.sql import with_tech
from tidemark.sources import driver as d
from tidemark.sources.driver import with_views

COLUMNS = ["symbol", "bar_date"]


def features(spark, sf, *names):
    """The features of some strategies, of all without names: only the indicators that they read."""
    names = names or tuple(s.REGISTRY)
    needs, bars = [n for x in names for n in s.REGISTRY[x].needs], d.bars(spark, sf)
    if "reversal_swing" in names or "donchian_trend" in names:  # the benchmark's day is joined before the grouped map, which reads it by symbol
        bars = with_market(bars, spark, sf)
    return s.features(bars, needs + ["rs63"] * ("reversal_swing" in names))


def caps(spark, sf):
    """symbol, cap_pct: percent rank of the market cap among all symbols."""
    known = d.fundamentals(spark, sf).filter("market_cap is not null").select("symbol", "market_cap")
    return store.percent_ranked(known, "market_cap", "cap_pct")


def with_caps(df, spark, sf):
    return df.join(caps(spark, sf).select("symbol", "cap_pct"), "symbol", "left")


def with_market(df, spark, sf):
    """df with market_ret60 and level of the benchmark, which has one row a day."""
    w = Window.partitionBy("series").orderBy("bar_date")
    mkt = d.market(spark, sf).withColumn("series", F.lit("MKT"))
    daily = mkt.select("bar_date", F.col("close").alias("level"), (F.col("close") / F.lag("close", 60).over(w) - 1).alias("market_ret60"))
    return df.join(F.broadcast(daily), "bar_date", "left")


def inputs(spark, sf, *names):
    """Features of some strategies (all without names) with what their rules read of other tables."""
    names = names or tuple(s.REGISTRY)
    df = features(spark, sf, *names)
    if "reversal_swing" in names:
        df = df.withColumnRenamed("rs63", "rs_raw").drop("level")
    return with_caps(df, spark, sf) if "largecap_rebound" in names else df


def signals(spark, sf, *names):
    """strategy, symbol, bar_date, close, score, stop: the signals of some strategies from one pass over the bars."""
    df = inputs(spark, sf, *names)
    for name in names or s.REGISTRY:
        df = s.REGISTRY[name].mark(df)
    found = F.array(*[F.when(F.col(name).isNotNull(), F.struct(F.lit(name).alias("strategy"), f"{name}.*")) for name in names or s.REGISTRY])
    return df.select(*COLUMNS, "close", F.inline(F.array_compact(found)))


def out(found):
    return found.select(*COLUMNS, F.round("score", 6).alias("score"), F.round("stop", 4).alias("stop"))


FEATURES = f""", ft as (select *, macd - macd_signal as hist, lag(macd - macd_signal) over w as hist_prev, lag(rsi14) over w as rsi14_prev, case
when rn >= 50 then avg(close) over {frame(50)} end as s50, case when rn >= 200 then avg(close) over {frame(200)} end as s200,
   case when rn >= 5 then avg(close) over {frame(5)} end as s5, case when rn >= 252 then close / max(close) over {frame(252)} end as closeness
from tech window w as (partition by symbol order by bar_date))"""
RSI2_SQL = "select symbol, bar_date, close, 1 - rsi2 / 10 as score, close - 2.5::double * atr14 as stop from ft where rn >= 220 and atr14 > 0 and close > s200 and round(rsi2, 9) < 10"
LARGECAP_SQL = """select symbol, bar_date, close, least(1, 0.6::double * least(1, (s200 - close) / s200 * 5) + 0.4::double * (rsi14 - 35) / 65) as score, close - 2.5::double * atr14 as stop from ft
   join (select symbol, 100 * percent_rank() over (order by market_cap) as cap_pct from fundamentals where market_cap is not null) using (symbol)
   where rn >= 283 and atr14 > 0 and cap_pct >= 80 and close < s200 and round(adx14, 9) >= 20 and round(rsi14, 9) >= 35
and round(rsi14, 9) > round(rsi14_prev, 9) and round(hist, 9) > 0 and round(hist, 9) <= 1 and round(hist, 9) > round(hist_prev, 9)"""
SLOPE = f", sq as (select *, 1 / (1 + exp(-3 * regr_slope(ln(close), rn) over {frame(90)} * 252 * greatest(0, coalesce(regr_r2(ln(close), rn) over {frame(90)}, 0)))) as q from ft)"
MOMENTUM_SQL = "select symbol, bar_date, close, 0.7::double * closeness + 0.3::double * q as score, close - 2.0::double * atr20 as stop from sq where rn >= 257 and atr20 > 0 and closeness >= 0.95::double"
DONCHIAN = f""", mr as (select bar_date, close / lag(close, 60) over (order by bar_date) - 1 as mret from market),
d0 as (select ft.*, mret, case when rn >= 21 then max(close) over p20 end as p20, case
when rn >= 56 then max(close) over p55 end as p55, avg(volume) over p19 as v19, max(high) over p20 as h20, min(low) over p20 as l20,
   case when rn >= 20 then round(4 * stddev_samp(close) over {frame(20)} / avg(close) over {frame(20)}, 9) end as bbw, close / lag(close, 60) over w - 1 as ret60 from ft left join mr using (bar_date)
   window w as (partition by symbol order by bar_date), p20 as (partition by symbol order by bar_date rows between 20 preceding and 1 preceding),
p55 as (partition by symbol order by bar_date rows between 55 preceding and 1 preceding), p19 as (partition by symbol
order by bar_date rows between 19 preceding and 1 preceding)),
d1 as (select *, lag(bbw) over (partition by symbol order by bar_date) as bp, list(bbw) filter (where bbw is not null) over (partition by symbol
order by bar_date rows between 126 preceding and 1 preceding) as bbws from d0),
d2 as (select *, case when close > p55 then p55 when close > p20 then p20 end as top from d1)"""
DONCHIAN_SQL = """select symbol, bar_date, close, least(1, (close - top) / atr20) as score, close - 2.0::double * atr20 as stop from d2 where rn >= 215 and atr20 > 0
and top is not null and close > s200 and s50 > s200 and volume >= 1.5::double * v19
   and round(tr, 9) >= round(atr14, 9) and (h20 - l20) / ((h20 + l20) / 2) <= 0.15::double
and len(list_filter(bbws, lambda v: v <= bp)) / len(bbws)::double <= 0.30::double and close <= 1.15::double * s50 and round(rsi14_prev, 9) < 65
and (mret is null or round(ret60, 9) > round(mret, 9))"""


@query("sig_rsi2", with_tech() + FEATURES + f", sg as ({RSI2_SQL}) select symbol, bar_date, round(score, 6) as score, round(stop, 4) as stop from sg")
def sig_rsi2(spark, sf):
    return out(signals(spark, sf, "rsi2_meanrev"))


@query("sig_largecap", with_tech("fundamentals") + FEATURES + f", sg as ({LARGECAP_SQL}) select symbol, bar_date, round(score, 6) as score, round(stop, 4) as stop from sg")
def sig_largecap(spark, sf):
    return out(signals(spark, sf, "largecap_rebound"))


@query("sig_momentum52", with_tech() + FEATURES + SLOPE + f", sg as ({MOMENTUM_SQL}) select symbol, bar_date, round(score, 6) as score, round(stop, 4) as stop from sg")
def sig_momentum52(spark, sf):
    return out(signals(spark, sf, "momentum_52w_high"))


@query("sig_donchian", with_tech("market") + FEATURES + DONCHIAN + f", sg as ({DONCHIAN_SQL}) select symbol, bar_date, round(score, 6) as score, round(stop, 4) as stop from sg")
def sig_donchian(spark, sf):
    return out(signals(spark, sf, "donchian_trend"))


SCORES = REVERSAL + PIVOTS + VOLUME + RS + f""", rx as (
  select t.symbol, t.bar_date, t.rn, t.close, t.atr14, case when t.rn >= 15 then {clip('rw.bull - rw.bear')} end as trig, case when t.rn >= 64 then pz.ns - pz.nr end as piv,
         case when t.rn > 63 and rd.rs is not null then
{clip(f'0.7::double * rd.rs + 0.3::double * coalesce({clip("(rd.av - rd.av0) / rd.av0 / 0.05::double")}, 0)')} end as rs, case
when vd.score is not null then 0.75::double + 0.25::double * least(1, vd.score) else 1 end as mult
  from tech t join rw using (symbol, bar_date) join pz using (symbol, bar_date) join rd using (symbol, bar_date) left join vd using (symbol, bar_date)),
ry as (select *, case when trig > 0 and round(piv, 9) > 0
and (rs is null or rs >= -0.5) then {clip('(0.35::double * trig + 0.30::double * piv + coalesce(0.20::double * rs, 0)) / (0.65::double + case when rs is null then 0 else 0.20::double end) * mult')}
end as score from rx)"""
REVERSAL_SQL = "select symbol, bar_date, close, score, close - 2.5::double * atr14 as stop from ry where rn >= 230 and atr14 > 0 and round(score, 9) >= 0.25"


@query("reversal_score", with_tech("market") + SCORES + " select symbol, bar_date, round(score, 6) as score from ry where score is not null")
def reversal_score(spark, sf):
    return s.reversal_scores(inputs(spark, sf, "reversal_swing")).filter("reversal_score is not null").select(*COLUMNS, F.round("reversal_score", 6).alias("score"))


@query("sig_reversal", with_tech("market") + SCORES + f", sg as ({REVERSAL_SQL}) select symbol, bar_date, round(score, 6) as score, round(stop, 4) as stop from sg")
def sig_reversal(spark, sf):
    return out(signals(spark, sf, "reversal_swing"))


@query("turtle_1l", with_tech() + """, b0 as (select *, case when rn > 21 and close > max(close) over (partition by symbol order by bar_date rows between 20 preceding
and 1 preceding) then rn end as b, close < min(low) over (partition by symbol order by bar_date rows between 10 preceding and 1 preceding) as gone
from tech),
b1 as (select x.symbol, x.rn as b, x.close as entry, x.atr20, min(y.rn) filter (where y.low <= x.close - 2.0::double * x.atr20 or y.gone) as at,
max(y.close) filter (where y.rn = x.rn + 60) as fin from b0 x left join b0 y on x.symbol = y.symbol and y.rn > x.rn and y.rn <= x.rn + 60
where x.b is not null group by all),
b2 as (select b1.*, y.low > entry - 2.0::double * b1.atr20 and y.close > entry as won from b1 left join b0 y on y.symbol = b1.symbol and y.rn = b1.at),
b3 as (select symbol, bar_date, rn, close, last_value(b ignore nulls) over (partition by symbol order by bar_date rows between unbounded preceding and 1 preceding) as pb from b0)
select b3.symbol, b3.bar_date, case when b2.b is null or b2.atr20 is null or b2.atr20 <= 0 then 'none' when case when b2.at <= b3.rn then b2.won else
case when b3.rn > b2.b + 60 then fin else b3.close end > entry end then 'winner' else 'loser' end as turtle from b3 left
join b2 on b2.symbol = b3.symbol and b2.b = b3.pb""")
def turtle_1l(spark, sf):
    df = p.numbered(ta.with_recursive(d.bars(spark, sf), ["atr20"]))
    return s.previous_breakout(df).select(*COLUMNS, "turtle")


@query("exits", with_tech() + FEATURES + """, ex as (select *, min(low) over (partition by symbol order by bar_date rows between 10 preceding and 1 preceding) as l10, max(high) over (partition by symbol order by bar_date rows between 21 preceding and current row) as h22 from ft)
select symbol, bar_date, close > s5 as rsi2_exit, round(hist, 9) <= 0 as largecap_exit, close < l10 as donchian_exit, round(close - (h22 - 3 * atr22), 9) <= 0 as chandelier_exit, round(close - 2 * atr20, 4) as ratchet_level from ex where rn >= 200""")
def exits(spark, sf):
    return exit_columns(s.features(d.bars(spark, sf), EXIT_NEEDS)).filter("rn >= 200").select(*COLUMNS, "rsi2_exit", "largecap_exit", "donchian_exit", "chandelier_exit", F.round("ratchet_level", 4).alias("ratchet_level"))


EXIT_NEEDS = ("macd", "macd_signal", "atr20", "atr22")


def exit_columns(df):
    """df with what of each exit rule doesn't depend on the entry: a position adds its stop and its age."""
    from tidemark.functions.windows import before, last

    h22 = F.max("high").over(last(22))
    return df.withColumns({
        "rsi2_exit": F.col("close") > F.col("sma5"), "largecap_exit": F.round("hist", 9) <= 0, "donchian_exit": F.col("close") < F.min("low").over(before(10)),
        "chandelier_exit": F.round(F.col("close") - (h22 - 3 * F.col("atr22")), 9) <= 0, "ratchet_level": F.col("close") - 2 * F.col("atr20"),
    })


@query("affinity_for", with_views("bars") + ", " + LABELS + (
    " select strategy, bar_date, case when strategy = 'donchian_trend' and label = 'choppy' then 0.25::double else 1.0::double end as affinity "
    "from lb, (values ('donchian_trend'), ('rsi2_meanrev')) t(strategy) where mrn >= 230 and label in ('choppy', 'trending_up')"
))
def affinity_for(spark, sf):
    """How much of its size a strategy gets on each day of two labels."""
    days = market_labels(spark, sf).filter(F.col("label").isin("choppy", "trending_up"))
    of = F.array(*[F.struct(F.lit(n).alias("strategy"), F.when(F.col("label") == "choppy", s.affinity_for(s.REGISTRY[n], "choppy")).otherwise(s.affinity_for(s.REGISTRY[n], "trending_up")).alias("affinity")) for n in ("donchian_trend", "rsi2_meanrev")])
    return days.select("bar_date", F.inline(of)).select("strategy", "bar_date", "affinity")


SIZE = """qty_raw as (select *, cast(round(entry * 10000) as bigint) as e, cast(round(stop * 10000) as bigint) as st from src),
sized as (select *, case when e <= 0 then 'invalid_entry_price' when st >= e then 'stop_above_entry'
when least({risk} // nullif(e - st, 0), 800000000 // e) <= 0 then 'qty_zero' end as size_reason, case
when e > st then greatest(least({risk} // nullif(e - st, 0), 800000000 // e), 0) else 0 end as qty0 from qty_raw)"""


@query("position_size", with_views("trades") + ", src as (select trade_id, entry, case when trade_id % 7 = 0 then entry + 1 else stop end as stop from trades), " + SIZE.format(risk=100000000) + " select trade_id, cast(qty0 as bigint) as qty, size_reason from sized")
def position_size(spark, sf):
    t = d.trades(spark, sf).withColumn("stop", F.when(F.col("trade_id") % 7 == 0, F.col("entry") + 1).otherwise(F.col("stop")))
    return t.withColumns(s.position_size(F.col("entry"), F.col("stop"))).select("trade_id", F.col("qty"), "size_reason")


@query("filter_chain", with_views("trades") + """ select trade_id, case when (1000000.0 - (1000000.0 - trade_id % 200 * 1000)) / 1000000.0 > 0.15 then 'drawdown'
when trade_id % 11 = 0 then 'already_held' when trade_id % 13 between 0 and 7 and trade_id % 2 = 0 then 'earnings'
when trade_id % 17 >= 15 then 'max_positions'
   when entry * qty / (1000000.0 - trade_id % 200 * 1000) > 0.08 then 'position_size'
when (trade_id % 5 * 60000 + entry * qty) / (1000000.0 - trade_id % 200 * 1000) > 0.25 then 'sector'
when entry * qty / nullif(trade_id % 19 * 10000, 0) > 0.05 then 'liquidity' end as reason from trades""")
def filter_chain(spark, sf):
    k = F.col("trade_id")
    reason = s.filter_chain(1000000.0 - k % 200 * 1000, F.lit(1000000.0), k % 11 == 0, F.when(k % 2 == 0, k % 13), k % 17, F.col("entry") * F.col("qty"), k % 5 * 60000, F.nullif(k % 19 * 10000, F.lit(0)))
    return d.trades(spark, sf).select("trade_id", reason.alias("reason"))


# Scans: signals -> size -> regime -> reasons -> rank


def _scan_sql(signals: str, risk: int, affinity: dict[str, float], ctes: str, *views: str) -> str:
    regime_ctes = REGIME.split(", mp as", 1)[1]
    cases = " ".join(f"when '{k}' then {v}::double" for k, v in affinity.items())
    return (
        with_tech("market", "macro", "earnings", *views) + ", mp as" + regime_ctes + ", " + LABELS + ctes
        + ", rl as (select bar_date, label, round(composite, 9) as composite, credit_stress from gc join lb using (bar_date) where mrn >= 230)"
        + f", sg as ({signals}), src as (select symbol, bar_date, score, round(close, 4) as entry, round(stop, 4) as stop from sg), " + SIZE.format(risk=risk)
        + f""", sc as (select z.*, cast(round_even(case when size_reason is null then qty0 else 0 end *
case label {cases} else 1 end * coalesce(0.5 + 0.5 * composite, 1) * case
when credit_stress then 0.5 else 1 end, 0) as bigint) as qty, coalesce(credit_stress, false) as stress,
             exists (select 1 from earnings e where e.symbol = z.symbol and z.bar_date between e.report_date - 7 and e.report_date) as soon from sized z left join rl using (bar_date)),
           sr2 as (select *, coalesce(size_reason, case when stress then 'credit_stress_long_block' when qty <= 0 then 'regime_zero_size' when soon then 'earnings' end) as reason from sc),
           st2 as (select *, case when reason is null then 'new' else 'rejected' end as status from sr2)
           select symbol, bar_date, round(score, 6) as score, entry, stop, qty, status, reason, case
when status = 'new' then cast(row_number() over (partition by bar_date, status
order by round(score, 9) desc nulls last, symbol) as integer) end as place from st2"""
    )


def scanned(spark, sf, *names):
    """The scan of some strategies, of all without names."""
    return s.scan(signals(spark, sf, *names), d.earnings(spark, sf), regime(spark, sf)).withColumn("score", F.round("score", 6))


SCANS: dict[str, str] = {}


def _scan(query_name: str, strategy: str, signals_sql: str, risk: int, ctes: str, *views: str) -> None:
    SCANS[strategy] = _scan_sql(signals_sql, risk, s.REGISTRY[strategy].affinity, ctes, *views)
    query(query_name, SCANS[strategy])(lambda spark, sf: scanned(spark, sf, strategy).drop("strategy"))


_scan("scan_rsi2", "rsi2_meanrev", RSI2_SQL, 100000000, FEATURES)
_scan("scan_largecap", "largecap_rebound", LARGECAP_SQL, 100000000, FEATURES, "fundamentals")
_scan("scan_momentum52", "momentum_52w_high", MOMENTUM_SQL, 75000000, FEATURES + SLOPE)
_scan("scan_donchian", "donchian_trend", DONCHIAN_SQL, 75000000, FEATURES + DONCHIAN)
_scan("scan_reversal", "reversal_swing", REVERSAL_SQL, 100000000, SCORES)


@query("scan_run", " union all ".join(f"select '{name}' as strategy, * from ({sql})" for name, sql in SCANS.items()))
def scan_run(spark, sf):
    """The scan of all strategies from one pass over the bars."""
    return scanned(spark, sf)


@query("signal_dedupe", with_views("trades") + " select symbol, entry_date, max(trade_id) as signal_id from trades group by 1, 2")
def signal_dedupe(spark, sf):
    latest = F.row_number().over(Window.partitionBy("symbol", "entry_date").orderBy(F.desc("trade_id")))
    return d.trades(spark, sf).withColumn("k", latest).filter("k = 1").select("symbol", "entry_date", F.col("trade_id").alias("signal_id"))


@query("query_signals", with_views("trades") + " select trade_id as signal_id, symbol, score from trades where side = 'long' and score >= 0.5 and upper(symbol) like '%S1%' order by score desc nulls last, trade_id limit 100")
def query_signals(spark, sf):
    from tidemark.plans.store import where

    found = where(d.trades(spark, sf).filter(F.col("symbol").ilike("%s1%")), side="long", score_min=0.5)
    return found.orderBy(F.desc_nulls_last("score"), "trade_id").limit(100).select(F.col("trade_id").alias("signal_id"), "symbol", "score")


@query("signals_backfill", with_views("bars", "trades") + (
    ", dd as (select bar_date, row_number() over (order by bar_date) as k from (select distinct bar_date from bars)) select bar_date from dd "
    "where k % 5 = 1 and bar_date not in (select entry_date from trades)"
))
def signals_backfill(spark, sf):
    days = d.bars(spark, sf).select("bar_date").distinct().withColumn("k", F.row_number().over(Window.orderBy("bar_date")))
    done = d.trades(spark, sf).select(F.col("entry_date").alias("bar_date"))
    return days.filter("k % 5 = 1").join(done, "bar_date", "left_anti").select("bar_date")



