"""Queries of trades, portfolios, labels, proposals, backtests and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import ta
from tidemark.functions.windows import full, last
from tidemark.operators import backtest as bt
from tidemark.operators import boosting
from tidemark.operators import models
from tidemark.operators import primitives as p
from tidemark.operators import store
from tidemark.operators import strategies as s
from tidemark.operators import trading as t
from tidemark.plans import market as pm
from tidemark.plans import strategies as ps
from tidemark.plans.market import frame
from tidemark.plans.registry import query
from tidemark.plans.sql import with_tech
from tidemark.sources import driver as d
from tidemark.sources import shared
from tidemark.sources.driver import with_views

KEYS = ["symbol", "bar_date"]


@query("trading_days", with_views("bars") + " select distinct bar_date from bars where symbol = 'S1' and bar_date between date '1996-01-01' and date '1997-12-31'")
def trading_days(spark, sf):
    return d.bars(spark, sf).filter((F.col("symbol") == "S1") & F.col("bar_date").between("1996-01-01", "1997-12-31")).select("bar_date").distinct()


@query("slippage", with_views("trades") + (
    ", x as (select *, case when side = 'long' then 1 else -1 end as k from trades) "
    "select trade_id, entry as none, entry * (1 + k * 5.0::double / 10000) as fixed, entry * (1 + k * (5.0::double + 2.0::double * (qty / 1000.0::double) * "
    "100) / 10000) as volume from x"
))
def slippage(spark, sf):
    side = F.when(F.col("side") == "long", "buy").otherwise("sell")
    kinds = {k: t.slippage(k, F.col("entry"), side, F.col("qty") / F.lit(1000.0)) for k in ("none", "fixed", "volume")}
    return d.trades(spark, sf).select("trade_id", *[c.alias(k) for k, c in kinds.items()])


RESULTS = with_views("trades") + (
    ", rs as (select *, case when side = 'short' then entry - exit else exit - entry end as move from trades), "
    "res as (select *, move * qty - commission as pnl, move / entry as ret, exit_date - entry_date as days, case "
    "when entry - stop > 0 then move / (entry - stop) end as r from rs)"
)


@query("trade_metrics", RESULTS + " select trade_id, pnl, ret, cast(days as integer) as days, r from res")
def trade_metrics(spark, sf):
    return t.with_results(d.trades(spark, sf)).select("trade_id", "pnl", "ret", "days", "r")


@query("trade_stats", RESULTS + (
    " select symbol, count(*) as n, round(avg(case "
    "when pnl > 0 then 1.0 else 0.0 end), 8) as win_rate, round(avg(pnl) filter (where pnl > 0), 6) as avg_win, round(avg(pnl) filter (where pnl < 0), 6) "
    "as avg_loss, round(sum(pnl) filter (where pnl > 0) / nullif(-sum(pnl) filter (where pnl < 0), 0), 8) as profit_factor, round(avg(pnl), 6) as "
    "expectancy from res group by 1"
))
def trade_stats(spark, sf):
    stats = t.trade_stats(t.with_results(d.trades(spark, sf)), "symbol")
    return stats.select("symbol", "n", *[F.round(c, k).alias(c) for c, k in (("win_rate", 8), ("avg_win", 6), ("avg_loss", 6), ("profit_factor", 8), ("expectancy", 6))])


EQUITY = with_views("equity") + """, e0 as (select *, equity / lag(equity) over (order by as_of_date) - 1 as ret, max(equity) over (order by as_of_date rows between unbounded preceding and current row) as peak from equity),
e1 as (select *, (equity - peak) / peak as dd, greatest(0, least(1, positions_value / equity)) as held, ret - 0.04::double / 252 as x from e0),
e2 as (select *, sum(case when dd = 0 then 1 else 0 end) over (order by as_of_date rows between unbounded preceding and current row) as spell from e1),
e3 as (select *, sum(case when dd < 0 then 1 else 0 end) over (partition by spell) as under from e2),
e4 as (select arg_min(equity, as_of_date) as f, arg_max(equity, as_of_date) as l, max(as_of_date) - min(as_of_date) as days, avg(x) as m,
stddev_samp(x) as s, stddev_samp(x) filter (where x < 0) as dn, min(dd) as mdd, max(under) as longest, avg(held) as exposure from e3)"""


def _equity(name: str, columns: dict[str, str]) -> None:
    def run(spark, sf):
        stats = t.equity_stats(d.equity(spark, sf))
        return stats.select(*[F.col(c).cast("long").alias(c) if c == "longest_drawdown" else F.round(c, 8).alias(c) for c in columns])

    query(name, EQUITY + " select " + ", ".join(f"{sql} as {c}" for c, sql in columns.items()) + " from e4")(run)


_CAGR = {"cagr": "round(pow(l / f, 365.25::double / days) - 1, 8)"}
_SHARPE = {"sharpe": "round(m / s * sqrt(252.0::double), 8)", "sortino": "round(m / dn * sqrt(252.0::double), 8)"}
_DRAW = {"max_drawdown": "round(mdd, 8)", "longest_drawdown": "cast(longest as bigint)"}
_equity("cagr", _CAGR)
_equity("sharpe_sortino", _SHARPE)
_equity("max_drawdown", _DRAW)
_equity("exposure", {"exposure": "round(exposure, 8)"})
_equity("performance_report", _CAGR | _SHARPE | _DRAW | {"exposure": "round(exposure, 8)"})


@query("save_run", with_views("equity") + " select as_of_date, equity, max(equity) over (order by as_of_date rows between unbounded preceding and current row) as hwm, equity - positions_value as cash, 0 as num_open from equity")
def save_run(spark, sf):
    hwm = F.max("equity").over(Window.orderBy("as_of_date").rowsBetween(Window.unboundedPreceding, 0))
    return d.equity(spark, sf).select("as_of_date", "equity", hwm.alias("hwm"), (F.col("equity") - F.col("positions_value")).alias("cash"), F.lit(0).alias("num_open"))


@query("triple_barrier", with_tech() + """, tb as (select symbol, bar_date, rn, close, close - 2.5::double * atr14 as stp, close + 2.0::double * atr14 as tgt, list({'h': high, 'l': low, 'c':
close}) over (partition by symbol order by bar_date rows between 1 following and 20 following) as nx from tech where atr14 is not null or true),
tc as (select *, list_filter(nx, lambda b: b.l <= stp or b.h >= tgt) as hits from tb)
select symbol, bar_date, case when len(nx) > 0 and stp < close and close < tgt then case when len(hits) > 0 then case
when hits[1].l <= stp then 0 else 1 end else case when nx[len(nx)].c > close then 1 else 0 end end end as label from tc""")
def triple_barrier(spark, sf):
    df = ta.with_recursive(d.bars(spark, sf), ["atr14"])
    return t.triple_barrier(df, F.col("close") - 2.5 * F.col("atr14"), F.col("close") + 2.0 * F.col("atr14")).select(*KEYS, "label")


_VOLS = ", ".join(f"case when count(r) over {frame(n)} = {n} then stddev_samp(r) over {frame(n)} * sqrt(252.0::double) end as vol{n}" for n in (5, 21, 63))
_RETS = ", ".join(f"close / lag(close, {n}) over w - 1 as ret{n}" for n in (5, 21, 63))
_NEUTRAL = ", ".join(f"round(coalesce({f'nullif({c}, 0)' if c.startswith('vol') else c}, {v}), 6) as {c}" for c, v in t.NEUTRAL.items())
_LABELLED = ", ".join(f"case when label is not null then case when label = '{x}' then 1.0 else 0.0 end::double end as {x}" for x in ("trending_up", "trending_down", "choppy", "transitioning"))


@query("ml_features", with_tech("market", "macro") + ", mp as" + pm.REGIME.split(", mp as", 1)[1] + ", " + pm.LABELS + ps.FEATURES + f""", f0 as (select *, ln(close / pc) as r from tech), sg as ({ps.RSI2_SQL}),
rl as (select bar_date, label, round(composite, 9) as regime_composite, credit_stress::int::double as credit_stress from gc join lb using (bar_date)
where mrn >= 230),
f1 as (select symbol, bar_date, case when rn >= 30 then rsi14 end as rsi14, case when rn >= 5 then rsi2 end as rsi2, {_RETS}, {_VOLS}, case
when rn >= 5 then close / max(close) over {frame(252)} end as closeness, case when rn >= 21 then atr14 / close end as atr_pct from f0
window w as (partition by symbol order by bar_date)),
f2 as (select f1.*, sg.score as signal_score, regime_composite, credit_stress, {_LABELLED} from f1 left join sg using (symbol, bar_date) left
join rl using (bar_date)) select symbol, bar_date, {_NEUTRAL} from f2""")
def ml_features(spark, sf):
    return _features(spark, sf).select(*KEYS, *[F.round(c, 6).alias(c) for c in t.NEUTRAL])


def _features(spark, sf):
    """The model's inputs of every bar; the score is that of the mean-reversion strategy where it signals."""
    df = s.REGISTRY["rsi2_meanrev"].mark(s.features(d.bars(spark, sf), ("rsi14", "rsi2", "atr14", *s.OTHERS[1:])))
    return t.ml_features(df.withColumn("signal_score", F.col("rsi2_meanrev.score")), pm.regime(spark, sf))


ANALYSIS = (
    "select trade_id, symbol, (exit - entry) / entry * 100 as move, (['up', 'strong_up', 'neutral', 'down', 'strong_down'])[trade_id % 5 + 1] as bucket, "
    "trade_id % 9 * 1.0::double as to_support, trade_id % 7 * 1.0::double as to_resistance, case "
    "when trade_id % 10 <> 0 then trade_id % 120 * 1.0::double end as iv, trade_id % 4 as confluences, 13 as dte, case "
    "when trade_id % 3 = 0 then trade_id % 40 end as days_to_earnings, entry * qty * 4000 as dollar_volume from trades"
)


def _analysis(spark, sf):
    k = F.col("trade_id")
    bucket = F.element_at(F.array(*[F.lit(b) for b in ("up", "strong_up", "neutral", "down", "strong_down")]), (k % 5 + 1).cast("int"))
    return d.trades(spark, sf).select("trade_id", "symbol", ((F.col("exit") - F.col("entry")) / F.col("entry") * 100).alias("move"), bucket.alias("bucket"), (k % 9 * 1.0).alias("to_support"), (k % 7 * 1.0).alias("to_resistance"), F.when(k % 10 != 0, k % 120 * 1.0).alias("iv"), (k % 4).alias("confluences"), F.lit(13).alias("dte"), F.when(k % 3 == 0, k % 40).alias("days_to_earnings"), (F.col("entry") * F.col("qty") * 4000).alias("dollar_volume"))


PROPOSE = with_views("trades") + f""", an as ({ANALYSIS}), a1 as (select *, case when move <= -1.5 then 'sell_put' when move >= 1.5 and to_resistance <= 4 and bucket <> 'strong_up' then 'sell_call' end as side from an),
a2 as (select *, case side when 'sell_put' then case when bucket in ('up', 'strong_up') then 1.0
when bucket in ('down', 'strong_down') then 0.35 else 0.55 end when 'sell_call' then case when bucket in ('up', 'strong_up') then 0.45
when bucket in ('down', 'strong_down') then 1.0 else 0.7 end end::double as alignment, case side when 'sell_put' then to_support
when 'sell_call' then to_resistance end as threat from a1),
pr as (select *, case when side is not null then case when days_to_earnings <= dte + 2 then 'earnings_in_expiry'
when dollar_volume < 5000000 then 'illiquid' when iv is null or iv < 20 then 'iv_too_low' end end as reject,
  case when side is not null then 0.30::double * greatest(0, least(1, iv / 150)) + 0.20::double * greatest(0, least(1, coalesce(threat, 0) / 12)) +
0.15::double * greatest(0, least(1, confluences / 3.0::double)) + 0.25::double * alignment + 0.10::double * greatest(0, least(1, abs(move) / 5)) end
as score from a2)"""


@query("propose_side", PROPOSE + " select trade_id, side, alignment, threat from pr")
def propose_side(spark, sf):
    return t.propose(_analysis(spark, sf)).select("trade_id", "side", "alignment", "threat")


@query("propose_filters", PROPOSE + " select trade_id, reject from pr where side is not null")
def propose_filters(spark, sf):
    return t.propose(_analysis(spark, sf)).filter("side is not null").select("trade_id", "reject")


@query("propose_score", PROPOSE + " select trade_id, round(score, 8) as score from pr where side is not null and iv is not null")
def propose_score(spark, sf):
    return t.propose(_analysis(spark, sf)).filter("side is not null and iv is not null").select("trade_id", F.round("score", 8).alias("score"))


@query("propose_book", PROPOSE + (
    ", b1 as (select *, row_number() over (partition by symbol order by round(score, 9) desc, trade_id) as k from pr where side is not null "
    "and reject is null), b2 as (select *, row_number() over (partition by side order by round(score, 9) desc, trade_id) as c from b1 where k = 1) "
    "select trade_id, symbol, side, round(score, 8) as score, round(0.75::double * case when side = 'sell_call' then 0.70::double else 1 end, 4) as size "
    "from b2 where c <= 4 order by round(score, 9) desc, trade_id limit 30"
))
def propose_book(spark, sf):
    from tidemark.plans.store import book

    found = t.propose(_analysis(spark, sf)).filter("side is not null and reject is null").withColumn("exact", F.col("score")).withColumn("score", F.round("score", 9))
    picked = book(found, "side", 0.0, 4, 30)
    # Size: half to full with the market's score (one half here), calls cut where breadth is thin.
    size = (0.5 + 0.5 * F.lit(0.5)) * F.when(F.col("side") == "sell_call", 0.70).otherwise(1.0)
    return picked.select("trade_id", "symbol", "side", F.round("exact", 8).alias("score"), F.round(size, 4).alias("size"))


MARKS = with_views("trades", "bars") + (
    ", lc as (select symbol, arg_max(close, bar_date) as close from bars group by 1), mk as (select trade_id, t.symbol, side, entry, qty, close as mark, "
    "case when side = 'long' then close - entry else entry - close end as move, trade_id % 3 * 1.0::double as mfe0, stop, entry + 4 as target, trade_id % "
    "40 as age from trades t left join lc using (symbol))"
)


def _marks(spark, sf):
    last = store.latest(d.bars(spark, sf), ["symbol"], "bar_date", ["close"])
    positions = d.trades(spark, sf).withColumns({"mfe": F.col("trade_id") % 3 * 1.0, "mae": F.lit(None).cast("double")})
    return t.marked(positions, last)


@query("mark_to_market", MARKS + " select trade_id, mark, move * qty as open_pnl, greatest(mfe0, 100 * move / entry) as mfe, least(0, 100 * move / entry) as mae from mk")
def mark_to_market(spark, sf):
    return _marks(spark, sf).select("trade_id", "mark", "open_pnl", "mfe", "mae")


@query("auto_close", MARKS + """, ac as (select *, case when case when side = 'long' then mark <= stop else mark >= stop end then 'stop_hit' when case when side = 'long' then mark >= target else mark <= target end then 'target_hit' when age >= 30 then 'time_stop'
  when case when side = 'long' then mark <= entry - 1 else mark >= entry - 1 end then 'chandelier_stop' when side = 'long' and mark <= entry - 0.5 then 'exit_below_n_day_low' end as reason from mk)
select trade_id, reason as close_reason, case reason when 'stop_hit' then stop when 'target_hit' then target else case when reason is not null then mark end end as close_price from ac""")
def auto_close(spark, sf):
    marks = _marks(spark, sf).withColumns({"target": F.col("entry") + 4, "age": F.col("trade_id") % 40, "max_age": F.lit(30), "chandelier": F.col("entry") - 1, "day_low": F.col("entry") - 0.5})
    return t.auto_close(marks).select("trade_id", "close_reason", "close_price")


@query("paper_trades", with_views("trades") + (
    " select trade_id, case when exit_date > date '2001-01-01' then 'open' else 'closed' end as status, case when exit_date <= date '2001-01-01' then (case "
    "when side = 'short' then entry - exit else exit - entry end) * qty end as realized from trades"
))
def paper_trades(spark, sf):
    closed = F.col("exit_date") <= F.lit("2001-01-01").cast("date")
    move = F.when(F.col("side") == "short", F.col("entry") - F.col("exit")).otherwise(F.col("exit") - F.col("entry"))
    return d.trades(spark, sf).select("trade_id", F.when(closed, "closed").otherwise("open").alias("status"), F.when(closed, move * F.col("qty")).alias("realized"))


@query("broker_account", with_views("equity", "trades") + " select (select arg_max(equity, as_of_date) from equity) as equity, (select count(*) from trades where exit_date > date '2001-07-01') as open_positions")
def broker_account(spark, sf):
    e = d.equity(spark, sf).agg(F.max_by("equity", "as_of_date").alias("equity"))
    n = d.trades(spark, sf).agg(F.count_if(F.col("exit_date") > F.lit("2001-07-01").cast("date")).alias("open_positions"))
    return e.join(F.broadcast(n))


# Sequential runs


def _marked(spark, sf, runs):
    """The bars with what the positions of some runs read; each bar once."""
    names = tuple(dict.fromkeys(strategy for _, strategy, _ in runs))
    df = ps.inputs(spark, sf, *names)
    for name in names:
        df = s.REGISTRY[name].mark(df)
    return df


def _orders(spark, sf, runs):
    """The orders of some runs from one pass over the bars."""
    adv = full(F.avg(F.col("close") * F.col("volume")).over(last(20)), "close", 20)
    return bt.orders(_marked(spark, sf, runs).withColumn("adv", adv).join(d.sectors(spark, sf), "symbol", "left"), runs)


#: A run of each strategy with five basis points of slippage.
RUNS = [(name, name, 5.0) for name in s.REGISTRY]


def backtested(spark, sf, runs=RUNS):
    """The runs over all trading days of the benchmark, sized by its label, over the index members of each day."""
    label = F.when(F.col("label").isNotNull(), F.col("label"))
    of = lambda name: F.coalesce(*[F.when(label == k, v) for k, v in s.REGISTRY[name].affinity.items()], F.lit(1.0))
    daily = d.market(spark, sf).select(F.col("bar_date").alias("day")).join(pm.market_labels(spark, sf).withColumnRenamed("bar_date", "day"), "day", "left")
    days = daily.select("day", F.inline(F.array(*[F.struct(F.lit(run).alias("run"), of(name).alias("factor"), F.lit(float(bps)).alias("bps")) for run, name, bps in runs])))
    return bt.backtest_of(_orders(spark, sf, runs), days, members=d.membership(spark, sf))


@query("backtest_run", None)
def backtest_run(spark, sf):
    return bt.trades(backtested(spark, sf))


@query("backtest_equity", None)
def backtest_equity(spark, sf):
    return bt.equity(backtested(spark, sf))


@query("backtest_report", None)
def backtest_report(spark, sf):
    """Each run's own equity curve and trades, summarised."""
    result = shared.written(backtested(spark, sf), "backtest")
    return t.equity_stats(bt.equity(result), "run").join(t.trade_stats(bt.trades(result), "run"), "run", "left")


#: Of each strategy: CTEs and signals in SQL, further views, and its exits in their order (x: the bar, c: the entry).
_RATES = {
    "rsi2_meanrev": (ps.FEATURES, ps.RSI2_SQL, (), {"time_stop": "x.rn - c.er >= 10", "mean_reverted_above_sma5": "x.close > x.s5", "hard_stop": "x.close <= c.entry - 2.5::double * x.atr14"}),
    "largecap_rebound": (ps.FEATURES, ps.LARGECAP_SQL, ("fundamentals",), {"hard_stop": "x.close <= c.entry - 2.5::double * x.atr14", "macd_below_zero": "round(x.hist, 9) <= 0"}),
    "momentum_52w_high": (ps.FEATURES + ps.SLOPE, ps.MOMENTUM_SQL, (), {}),
    "donchian_trend": (ps.FEATURES + ps.DONCHIAN, ps.DONCHIAN_SQL, ("market",), {"exit_below_n_day_low": "x.close < x.l10", "chandelier_stop": "round(x.close - (x.h22 - 3 * x.atr22), 9) <= 0"}),
    "reversal_swing": (ps.FEATURES + ps.SCORES, ps.REVERSAL_SQL, ("market",), {"time_stop": "x.rn - c.er >= 30", "hard_stop": "x.close <= c.entry - 2.5::double * x.atr14"}),
}


def _rates_sql(name: str) -> str:
    ctes, signals, views, exits = _RATES[name]
    cases = " ".join(f"when {cond} then '{reason}'" for reason, cond in exits.items()) or "when false then ''"
    return (
        with_tech(*views) + ctes
        + f""", sg as ({signals}), ex as (select *, min(low) over (partition by symbol order by bar_date rows between 10 preceding
and 1 preceding) as l10, max(high) over (partition by symbol order by bar_date rows between 21 preceding
and current row) as h22, max(rn) over (partition by symbol) as top from ft),
cs as (select e.symbol, t.rn as sr, e.rn as er, e.bar_date as entry_date, e.open as entry, e.top from sg g join tech t using (symbol, bar_date)
join ex e on e.symbol = g.symbol and e.rn = t.rn + 1 where t.rn > {s.REGISTRY[name].history}),
xs as (select c.symbol, c.sr, min(x.rn) as xr from cs c join ex x on x.symbol = c.symbol and x.rn >= c.er and x.rn < c.top where case {cases} end is not null group by 1, 2),
fx as (select c.*, xr, coalesce(xr + 1, top) as last from cs c left join xs using (symbol, sr)),
ch as (select symbol, min(sr) as sr from fx group by 1 union all select f.symbol, min(f.sr) as sr from ch join fx cur on cur.symbol = ch.symbol
and cur.sr = ch.sr join fx f on f.symbol = ch.symbol and f.sr > cur.last group by f.symbol)
select '{name}' as strategy, c.symbol, c.entry_date, c.entry, o.bar_date as exit_date, case
when c.xr is null then o.close else o.open end as exit, coalesce(case {cases} end, 'open_at_end') as reason, case
when c.xr is null then o.close else o.open end / c.entry - 1 as ret
from ch join fx c using (symbol, sr) join ex o on o.symbol = c.symbol and o.rn = c.last left join ex x on x.symbol = c.symbol and x.rn = c.xr"""
    )


BASE_RATES = " union all ".join(f"select * from ({_rates_sql(name)})" for name in _RATES)


@query("base_rates", BASE_RATES)
def base_rates(spark, sf):
    return bt.setups(_marked(spark, sf, RUNS), RUNS).withColumn("ret", F.col("exit") / F.col("entry") - 1)


@query("base_rate_summary", f"""select strategy, symbol, count(*) as n, round(avg(case
when ret > 0 then 1.0 else 0.0 end), 9) as win_rate, round(avg(ret), 9) as expectancy, round(median(ret), 9) as median, round(sum(ret) filter (where
ret > 0) / nullif(-sum(ret) filter (where ret < 0), 0), 9) as profit_factor,
  round(avg(exit_date - entry_date), 9) as avg_days, count(*) < 50 as small_sample from ({BASE_RATES}) group by 1, 2""")
def base_rate_summary(spark, sf):
    won, ret = F.col("ret") > 0, F.col("ret")
    gains, losses = F.sum(F.when(won, ret)), F.sum(F.when(ret < 0, ret))
    r9 = lambda c, name: F.round(c, 9).alias(name)
    return base_rates(spark, sf).groupBy("strategy", "symbol").agg(
        F.count(F.lit(1)).alias("n"), r9(F.avg(won.cast("double")), "win_rate"), r9(F.avg("ret"), "expectancy"), r9(F.percentile("ret", F.lit(0.5)), "median"),
        r9(F.try_divide(gains, -losses), "profit_factor"), r9(F.avg(F.datediff("exit_date", "entry_date")), "avg_days"), (F.count(F.lit(1)) < 50).alias("small_sample"),
    )


@query("per_day_scores", with_tech() + " select symbol, bar_date, case when rn < 220 then 'warmup' when rsi2 is null then 'abstained' else 'scored' end as phase, case when rn >= 220 then round(1 - rsi2 / 10, 6) end as score from tech")
def per_day_scores(spark, sf):
    df = p.numbered(ta.with_recursive(d.bars(spark, sf), ["rsi2"]))
    phase = F.when(F.col("rn") < 220, "warmup").when(F.col("rsi2").isNull(), "abstained").otherwise("scored")
    return df.select(*KEYS, phase.alias("phase"), F.when(F.col("rn") >= 220, F.round(1 - F.col("rsi2") / 10, 6)).alias("score"))


_MODELS: dict[tuple, object] = {}


def _model(spark, sf, kind: str, rows, reach: str = "reach"):
    """The model of the older four fifths of the dates of labelled rows, fitted once for an application and folder; None of too few rows."""
    key = (*shared.stamp(spark, sf), kind)
    if key not in _MODELS:
        older, _ = models.split(rows.filter("label is not null"), "bar_date", 0.2, reach)
        try:
            _MODELS[key] = models.fit(older, list(t.NEUTRAL))
        except boosting.TooFewRows:
            _MODELS[key] = None
    return _MODELS[key]


def _labelled(spark, sf):
    """The model's inputs of every bar with its label and the last day that this looks at."""
    return _features(spark, sf).withColumn("label", F.col("barrier_25_20_20").cast("int")).withColumnRenamed("reach20", "reach")


def _p_win(model, rows):
    return rows.withColumn("p_win", F.lit(None).cast("double")) if model is None else models.score(model, rows, list(t.NEUTRAL))


def _scored(spark, sf):
    """label and p_win of the newest fifth of the dates, by a model of the others."""
    rows = shared.written(_labelled(spark, sf).filter("label is not null").select(*KEYS, "label", "reach", *t.NEUTRAL), "training")
    return _p_win(_model(spark, sf, "all bars", rows), models.split(rows, "bar_date", 0.2)[1])


@query("ml_train_score", None)
def ml_train_score(spark, sf):
    return _scored(spark, sf).select(*KEYS, "label", F.round("p_win", 6).alias("p_win"))


@query("ml_metrics", None)
def ml_metrics(spark, sf):
    """How well the model ranks and picks on the dates that it has not seen."""
    return models.metrics(shared.written(_scored(spark, sf).select("label", "p_win"), "scored"))


@query("meta_score", None)
def meta_score(spark, sf):
    """p_win on the passing rows of the mean-reversion scan, by a model of its own older signals; other rows have none."""
    rows = shared.written(_labelled(spark, sf).filter("rsi2_meanrev is not null").select(*KEYS, "label", "reach", *t.NEUTRAL), "signals")
    scored = _p_win(_model(spark, sf, "rsi2_meanrev", rows), rows).select(*KEYS, "p_win")
    found = ps.scanned(spark, sf, "rsi2_meanrev")
    return found.join(scored, KEYS, "left").select(*KEYS, "status", F.when(F.col("status") == "new", F.round("p_win", 6)).alias("p_win"))
