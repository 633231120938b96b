"""Queries that run a whole flow: analysis of every symbol, watchlists, observations, proposals, signals as stored."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import options as o
from tidemark.functions import ta
from tidemark.functions.windows import lag, last
from tidemark.operators import levels as lv
from tidemark.operators import primitives as p
from tidemark.operators import store
from tidemark.operators import trading as t
from tidemark.plans import market as pm
from tidemark.plans.analysis import LEVELS, TREND, VOL, _levels, trend
from tidemark.plans.indicators import _EWM_K
from tidemark.plans.market import frame
from tidemark.plans.registry import query
from tidemark.plans.sql import with_bars, with_tech
from tidemark.plans.store import book
from tidemark.sources import driver as d
from tidemark.sources.driver import with_views

#: The day that earnings are looked up from; the last bar of each symbol is what the rest reads.
DAY = "2000-06-01"
#: Days of the nearest tenor, the delta that its strikes aim at, the rate, and how near in ATR a level is to a strike.
TENOR, DELTA, RATE, NEAR = 6, 0.15, 0.04, 0.5
BANDS = (9, 50, 200)


def contexts(spark, sf):
    """One row for each symbol with 200 bars: its last bar's reads, nearest levels and earnings."""
    names = ["adx14", "rsi14", "atr14", "yz_ewm", *[f"ema{n}" for n in BANDS]]
    df = p.numbered(ta.with_recursive(d.bars(spark, sf), [*names, "yz_rank_21_252"]))
    df = df.withColumns({"pct": F.round(100.0 * F.col("yz_rank_21_252"), 6), "move": (F.col("close") / lag("close") - 1) * 100, "dollar_volume": F.avg(F.col("close") * F.col("volume")).over(last(20))})
    reads = ["bar_date", "close", "bucket", "pct", "move", "dollar_volume", *names]
    now = store.latest(trend(df), ["symbol"], "bar_date", reads)
    near = lv.nearest(_levels(spark, sf))
    best = {k: F.max(F.when((F.col("kind") == k) & (F.col("place") == 1), F.struct("price", "flipped"))) for k in ("support", "resistance")}
    per = near.groupBy("symbol").agg(best["support"].alias("sup"), best["resistance"].alias("res"), F.collect_list("price").alias("prices"))
    soon = d.earnings(spark, sf).filter(F.col("report_date") >= F.lit(DAY).cast("date")).groupBy("symbol").agg(F.min("report_date").alias("next"))
    df = now.join(per, "symbol", "left").join(soon, "symbol", "left")
    away = lambda gap: gap / F.col("close") * 100
    return df.withColumns({
        "to_support": away(F.col("close") - F.col("sup.price")), "to_resistance": away(F.col("res.price") - F.col("close")), "days_to_earnings": F.datediff("next", F.lit(DAY).cast("date")),
        "vol_bucket": F.when(F.col("pct") < 25, "low").when(F.col("pct") < 75, "normal").when(F.col("pct") < 90, "elevated").when(F.col("pct").isNotNull(), "extreme"),
    })


CONTEXT = with_tech("earnings") + VOL[len(with_bars()) :] + LEVELS + TREND + f""", vx as (select v2.symbol, v2.bar_date, case when have = 252 then round(100.0::double * len(list_filter(vols, lambda v: v <= yz21)) / 252, 6) end as pct,
   case when ye.s2 < 1 and ce.s2 < 1 then sqrt(greatest(ye.cov / (1 - ye.s2) + {_EWM_K!r}::double * ce.cov / (1 - ce.s2) + {1 - _EWM_K!r}::double *
ce.r, 0) * 252) end as fwd from v2 left join ye using (symbol, rn) left join ce using (symbol, rn)),
nr as (select *, row_number() over (partition by symbol, kind
order by round(strength, 9) desc, price) as place, (origin = 'high') = (kind = 'support') as flipped from lvls where abs(distance_pct) <= 25
and strength >= 0.10),
np as (select symbol, max(price) filter (where kind = 'support' and place = 1) as sup, bool_or(flipped) filter (where kind = 'support'
and place = 1) as sup_flip, max(price) filter (where kind = 'resistance' and place = 1) as res,
   bool_or(flipped) filter (where kind = 'resistance' and place = 1) as res_flip, list(price) as prices from nr where place <= 3 group by 1),
dv as (select symbol, bar_date, avg(close * volume) over {frame(20)} as dollar_volume, (close / pc - 1) * 100 as move from n),
nx as (select symbol, min(report_date) - date '{DAY}' as days_to_earnings from earnings where report_date >= date '{DAY}' group by 1),
cx as (select t.symbol, t.close, t.bucket, t.atr14, t.rsi14, t.ema9, t.ema50, t.ema200, pct, fwd, dollar_volume, move, sup, sup_flip, res, res_flip,
prices, days_to_earnings, (t.close - sup) / t.close * 100 as to_support, (res - t.close) / t.close * 100 as to_resistance
   from (select * from trend qualify row_number() over (partition by symbol order by bar_date desc) = 1) t left join vx using (symbol, bar_date) left
join dv using (symbol, bar_date) left join np using (symbol) left join nx using (symbol))"""


@query("observations", CONTEXT + """ select symbol, list_filter([
  case when days_to_earnings <= 0 then 'earnings_reported' when days_to_earnings <= 5 then 'earnings_within_days' when days_to_earnings <= 30 then 'earnings_within_month' end,
  case when bucket in ('strong_up', 'up') then case when to_support < 3 then 'up_near_support' when to_resistance < 3 then 'up_at_resistance' when to_support is not null and to_resistance is not null then 'up_between_levels' end
       when bucket in ('strong_down', 'down') then case when to_resistance < 3 then 'down_near_resistance' when to_support < 3 then 'down_at_support' when to_support is not null and to_resistance is not null then 'down_between_levels' end
       when to_support is not null and to_resistance is not null then 'range_between_levels' end,
  case when sup_flip and to_support < 5 then 'support_was_resistance' end, case when res_flip and to_resistance < 5 then 'resistance_was_support' end,
  case when pct < 25 then 'volatility_low' end, case when fwd is not null then 'expected_range' end], lambda x: x is not null) as observations, round(to_support, 4) as to_support, round(to_resistance, 4) as to_resistance from cx""")
def observations(spark, sf):
    """What holds of each symbol's last bar, most urgent first: earnings, trend at its levels, levels that changed sides, volatility."""
    c = F.col
    both = c("to_support").isNotNull() & c("to_resistance").isNotNull()
    up = F.when(c("to_support") < 3, "up_near_support").when(c("to_resistance") < 3, "up_at_resistance").when(both, "up_between_levels")
    down = F.when(c("to_resistance") < 3, "down_near_resistance").when(c("to_support") < 3, "down_at_support").when(both, "down_between_levels")
    said = F.array_compact(F.array(
        F.when(c("days_to_earnings") <= 0, "earnings_reported").when(c("days_to_earnings") <= 5, "earnings_within_days").when(c("days_to_earnings") <= 30, "earnings_within_month"),
        F.when(c("bucket").isin("strong_up", "up"), up).when(c("bucket").isin("strong_down", "down"), down).when(both, "range_between_levels"),
        F.when(c("sup.flipped") & (c("to_support") < 5), "support_was_resistance"),
        F.when(c("res.flipped") & (c("to_resistance") < 5), "resistance_was_support"),
        F.when(c("vol_bucket") == "low", "volatility_low"),
        F.when(c("yz_ewm").isNotNull(), "expected_range"),
    ))
    return contexts(spark, sf).select("symbol", said.alias("observations"), F.round("to_support", 4).alias("to_support"), F.round("to_resistance", 4).alias("to_resistance"))


@query("analyze_watchlist", CONTEXT.replace(with_tech("earnings"), with_tech("earnings", "watchlist"), 1) + """, ws as (select distinct symbol from watchlist), nb as (select symbol, count(*) as n from bars group by 1)
select symbol, cx.symbol is not null as available, case when nb.n is null then 'no_bars'
when cx.symbol is null then 'short_history' end as reason, bucket as trend, round(rsi14, 6) as rsi14, close from ws left join nb using (symbol) left
join cx using (symbol)""")
def analyze_watchlist(spark, sf):
    """Every watched symbol: its analysis, or a row that says why there is none."""
    watched = d.watchlist(spark, sf).select("symbol").distinct()
    counts = d.bars(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    df = watched.join(counts, "symbol", "left").join(contexts(spark, sf).withColumn("found", F.lit(True)), "symbol", "left")
    available = F.coalesce("found", F.lit(False))
    return df.select("symbol", available.alias("available"), F.when(F.col("n").isNull(), "no_bars").when(~available, "short_history").alias("reason"), F.col("bucket").alias("trend"), F.round("rsi14", 6).alias("rsi14"), "close")


def _strike_sql(kind: str) -> str:
    ppf = o.ppf_sql(f"{DELTA if kind == 'call' else 1 - DELTA}::double")
    return f"close * exp(({RATE}::double + fwd * fwd / 2) * {TENOR}::double / 365 - {ppf} * fwd * sqrt({TENOR}::double / 365))"


@query("generate_book", CONTEXT.replace(with_tech("earnings"), with_tech("earnings", "sectors", "market", "macro"), 1) + ", mp as" + pm.REGIME.split(", mp as", 1)[1] + f""",
rg as (select composite, breadth_score, credit_stress from gc order by bar_date desc limit 1),
b0 as (select *, case when move <= -1.5 then 'sell_put' when move >= 1.5 and to_resistance <= 4 and bucket <> 'strong_up' then 'sell_call' end as side from cx where fwd is not null),
b1 as (select *, round(case when side = 'sell_put' then {_strike_sql('put')} else {_strike_sql('call')} end, 2) as strike, fwd * 100 as iv, case
when side = 'sell_put' then to_support else to_resistance end as threat,
   case side when 'sell_put' then case when bucket in ('up', 'strong_up') then 1.0 when bucket in ('down', 'strong_down') then 0.35 else 0.55 end else
case when bucket in ('up', 'strong_up') then 0.45 when bucket in ('down', 'strong_down') then 1.0 else 0.7 end end::double as alignment from b0
where side is not null),
b2 as (select *, len(list_filter(list_concat(coalesce(prices, []), [ema9, ema50, ema200]), lambda x: abs(strike - x) <= {NEAR}::double * atr14)) as confluences from b1),
b3 as (select *, case when days_to_earnings <= {TENOR} + 2 then 'earnings_in_expiry' when dollar_volume < 5000000 then 'illiquid' when iv < 20 then 'iv_too_low' end as reject,
   round(0.30::double * greatest(0, least(1, iv / 150)) + 0.20::double * greatest(0, least(1, coalesce(threat, 0) / 12)) + 0.15::double * greatest(0,
least(1, confluences / 3.0::double)) + 0.25::double * alignment + 0.10::double * greatest(0, least(1, abs(move) / 5)), 9) as score from b2),
b4 as (select b3.*, coalesce(sector, 'none') as cluster, row_number() over (partition by coalesce(sector, 'none') order by score desc, symbol) as k
from b3 left join sectors using (symbol) where reject is null)
select symbol, side, strike, confluences, round(score, 6) as score, round((0.5 + 0.5 * composite) * case when credit_stress then 0.5 else 1 end * case
when side = 'sell_call' and breadth_score < 0.40 then 0.70::double else 1 end, 3) as size from b4, rg where k <= 2 order by b4.score desc, symbol
limit 30""")
def generate_book(spark, sf):
    """From the analysis of every symbol to a sized book: side of the day's move, hard filters, score, at most two of a sector, 30 in all."""
    df = contexts(spark, sf).filter("yz_ewm is not null").withColumns({"iv": F.col("yz_ewm") * 100, "dte": F.lit(TENOR)})
    years, sigma = F.lit(TENOR / 365), F.col("yz_ewm")
    strike = {k: F.round(o.strike_for_delta(k, F.lit(x), F.col("close"), years, F.lit(RATE), sigma), 2) for k, x in (("call", DELTA), ("put", -DELTA))}
    sided = t.propose(df.withColumn("confluences", F.lit(0))).filter("side is not null").drop("score")
    levels = F.concat(F.coalesce("prices", F.array().cast("array<double>")), F.array(*[F.col(f"ema{n}") for n in BANDS]))
    sided = sided.withColumn("strike", F.when(F.col("side") == "sell_put", strike["put"]).otherwise(strike["call"])).withColumn("confluences", F.size(F.filter(levels, lambda x: F.abs(F.col("strike") - x) <= NEAR * F.col("atr14"))).cast("long"))
    scored = t.propose(sided.drop("side", "alignment", "threat", "reject")).filter("reject is null").withColumn("score", F.round("score", 9))
    clustered = scored.join(d.sectors(spark, sf), "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit("none")))
    picked = book(clustered, "sector", 0.0, 2, 30, "symbol")
    market = pm.regime_frame(spark, sf).agg(*[F.max_by(c, "bar_date").alias(c) for c in ("composite", "breadth_score", "credit_stress")])
    size = (0.5 + 0.5 * F.col("composite")) * F.when(F.col("credit_stress"), 0.5).otherwise(1.0) * F.when((F.col("side") == "sell_call") & (F.col("breadth_score") < 0.40), 0.70).otherwise(1.0)
    return picked.join(F.broadcast(market)).select("symbol", "side", "strike", "confluences", F.round("score", 6).alias("score"), F.round(size, 3).alias("size"))


# Signals as stored


@query("get_signal", with_views("trades") + " select trade_id as signal_id, symbol, entry_date, score, entry, stop from trades where trade_id = 7")
def get_signal(spark, sf):
    return d.trades(spark, sf).filter("trade_id = 7").select(F.col("trade_id").alias("signal_id"), "symbol", "entry_date", "score", "entry", "stop")


@query("signals_freshness", with_views("trades", "bars") + (
    " select (select max(entry_date) from trades) as latest_signal_date, (select max(exit_date) from trades) as latest_run, (select max(bar_date) "
    "from bars) as latest_bar_date, (select count(*) from trades where entry_date = date '2000-06-01') as signals_today"
))
def signals_freshness(spark, sf):
    """The newest signal, run (the day a trade was last written) and bar, and the day's number of signals; nulls where a table is empty."""
    signals = d.trades(spark, sf).agg(F.max("entry_date").alias("latest_signal_date"), F.max("exit_date").alias("latest_run"), F.count_if(F.col("entry_date") == F.lit(DAY).cast("date")).alias("signals_today"))
    return signals.join(F.broadcast(d.bars(spark, sf).agg(F.max("bar_date").alias("latest_bar_date")))).select("latest_signal_date", "latest_run", "latest_bar_date", "signals_today")


@query("signals_replay", with_views("trades") + """, kept as (select symbol, entry_date, trade_id, score from trades where not (entry_date between date '2000-01-01' and date '2000-03-31')),
again as (select symbol, entry_date, max(trade_id) as trade_id, round(max(score) * 2, 6) as score from trades
where entry_date between date '2000-01-01' and date '2000-03-31' and side = 'long' group by 1, 2) select * from kept union all select * from again""")
def signals_replay(spark, sf):
    """A bounded replay: the stored signals of a range of days go, what the replay of these days finds takes their place."""
    stored = d.trades(spark, sf).select("symbol", "entry_date", "trade_id", "score", "side")
    inside = F.col("entry_date").between("2000-01-01", "2000-03-31")
    again = stored.filter(inside & (F.col("side") == "long")).groupBy("symbol", "entry_date").agg(F.max("trade_id").alias("trade_id"), F.round(F.max("score") * 2, 6).alias("score"))
    return stored.filter(~inside).drop("side").unionByName(again)


@query("list_runs", with_views("trades") + " select side as run, count(*) as trades, min(entry_date) as first_day, max(exit_date) as last_day, row_number() over (order by max(exit_date) desc, side) as place from trades group by 1")
def list_runs(spark, sf):
    """Stored runs, newest first: the sides of the trades stand for runs."""
    runs = d.trades(spark, sf).groupBy(F.col("side").alias("run")).agg(F.count(F.lit(1)).alias("trades"), F.min("entry_date").alias("first_day"), F.max("exit_date").alias("last_day"))
    return runs.withColumn("place", F.row_number().over(Window.orderBy(F.desc("last_day"), "run")).cast("long"))


@query("export_run", with_views("trades") + " select to_json({'symbol': symbol, 'entry': cast(entry_date as varchar), 'exit': cast(exit_date as varchar), 'qty': qty, 'reason': exit_reason}) as line from trades where side = 'long'")
def export_run(spark, sf):
    """The trades of one run as lines of JSON, as they are written to a file."""
    run = d.trades(spark, sf).filter("side = 'long'")
    return run.select(F.to_json(F.struct("symbol", F.col("entry_date").cast("string").alias("entry"), F.col("exit_date").cast("string").alias("exit"), "qty", F.col("exit_reason").alias("reason"))).alias("line"))
