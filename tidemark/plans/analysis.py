"""Queries of per-symbol analysis: levels, trend, volatility, momentum, options."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import options as o
from tidemark.functions import ta
from tidemark.functions.windows import sma
from tidemark.operators import levels as lv
from tidemark.operators import primitives as p
from tidemark.operators import store
from tidemark.plans.indicators import _EWM, _EWM_K
from tidemark.plans.market import frame
from tidemark.plans.registry import query
from tidemark.plans.sql import with_bars, with_tech
from tidemark.plans.store import resampled
from tidemark.sources import driver as d

KEYS = ["symbol", "bar_date"]
#: Prices lie on half steps of the sixth decimal at times; off them, both engines round alike.
OFF = 0.00000013

PIVOTS = """, pv0 as (select *, count(high) over c as k, max(high) over c as mh, min(low) over c as ml, min(low) over a as fl, max(high) over a as fh from n
   window c as (partition by symbol order by bar_date rows between 5 preceding and 5 following), a as (partition by symbol order by bar_date rows between current row and 5 following)),
pvs as (select symbol, 'high' as origin, rn, bar_date, high as price, volume, high - fl as prominence from pv0 where k = 11 and high >= mh union all select symbol, 'low', rn, bar_date, low, volume, fh - low from pv0 where k = 11 and low <= ml)"""


@query("find_pivots", with_bars() + PIVOTS + " select symbol, origin, bar_date, price, prominence from pvs")
def find_pivots(spark, sf):
    return lv.pivots(p.numbered(d.bars(spark, sf))).select("symbol", "origin", "bar_date", "price", "prominence")


WEEKLY = """, wk as (select symbol, cast(date_trunc('week', bar_date) as date) as week, max(high) as high, min(low) as low from bars group by 1, 2),
wp as (select *, count(high) over c as k, max(high) over c as mh, min(low) over c as ml from wk window c as (partition by symbol order by week rows between 3 preceding and 3 following)),
wps as (select symbol, week, 'high' as origin, high as price from wp where k = 7 and high >= mh union all select symbol, week, 'low', low from wp where k = 7 and low <= ml)"""


@query("weekly_pivots", with_bars() + WEEKLY + " select * from wps")
def weekly_pivots(spark, sf):
    return _weekly(spark, sf).select("symbol", F.col("bar_date").alias("week"), "origin", "price")


def _weekly(spark, sf):
    weeks = resampled(d.bars(spark, sf), "week").withColumnRenamed("week", "bar_date")
    return lv.pivots(p.numbered(weeks), 3)


CLUSTERS = PIVOTS + """, pk as materialized (select *, row_number() over (partition by symbol, origin order by price, rn) as k from pvs),
cl as (select symbol, origin, k, 0 as cluster, price as s, 1 as c from pk where k = 1 union all
  select b.symbol, b.origin, b.k, case when abs(b.price - s / c) / greatest(s / c, 1e-9) * 100 > 1.5 then cluster + 1 else cluster end,
         case when abs(b.price - s / c) / greatest(s / c, 1e-9) * 100 > 1.5 then b.price else s + b.price end, case when abs(b.price - s / c) / greatest(s / c, 1e-9) * 100 > 1.5 then 1 else c + 1 end
  from cl join pk b on b.symbol = cl.symbol and b.origin = cl.origin and b.k = cl.k + 1),
cs as (select pk.*, cl.cluster from pk join cl using (symbol, origin, k))"""


@query("cluster_levels", with_bars() + CLUSTERS + " select symbol, origin, rn, price, cluster from cs")
def cluster_levels(spark, sf):
    return lv.clustered(lv.pivots(p.numbered(d.bars(spark, sf)))).select("symbol", "origin", F.col("rn").cast("long").alias("rn"), "price", "cluster")


LEVELS = CLUSTERS + WEEKLY + """, en as (select symbol, max(rn) as n_bars, arg_max(close, rn) as last_close from n group by 1),
ca as (select symbol, origin, cluster, avg(price) as price, count(*) as touches, sum(volume) as volume, max(rn) as last_rn, max(prominence) as prominence from cs group by 1, 2, 3),
cb as (select *, max(volume) over w as mv, max(touches) over w as mt, max(prominence) over w as mp from ca window w as (partition by symbol, origin)),
cc as (select cb.*, n_bars - last_rn as age, last_close, exists (select 1 from wps where wps.symbol = cb.symbol
and abs(wps.price - cb.price) / cb.price * 100 <= 1.5) as confirmed from cb join en using (symbol)),
cd as (select *, 0.5::double * case when mv > 0 then volume / mv else touches / mt end + 0.3::double * greatest(0, 1 - age / 252.0::double) +
0.2::double * least(1, prominence / case when mp > 0 then mp else 1 end) as raw from cc),
lvls as (select symbol, origin, price, touches, age, case when confirmed then least(1, raw * 1.3::double) else raw end as strength, case
when price >= last_close then 'resistance' else 'support' end as kind, (price - last_close) / last_close * 100 as distance_pct, confirmed from cd)"""


def _levels(spark, sf):
    bars = p.numbered(d.bars(spark, sf))
    ends = bars.groupBy("symbol").agg(F.max("rn").alias("n_bars"), F.max_by("close", "rn").alias("last_close"))
    return lv.levels(lv.clustered(lv.pivots(bars)), ends, _weekly(spark, sf).select("symbol", "price"))


@query("level_strength", with_bars() + LEVELS + " select symbol, origin, round(price + 0.00000013::double, 6) as price, touches, age, round(strength, 6) as strength, kind, confirmed from lvls")
def level_strength(spark, sf):
    return _levels(spark, sf).select("symbol", "origin", F.round(F.col("price") + OFF, 6).alias("price"), "touches", F.col("age").cast("long").alias("age"), F.round("strength", 6).alias("strength"), "kind", "confirmed")


@query("find_support_resistance", with_bars() + LEVELS + (
    ", nr as (select *, row_number() over (partition by symbol, kind order by round(strength, 9) desc, price) as place from lvls "
    "where abs(distance_pct) <= 25 and strength >= 0.10) "
    "select symbol, kind, cast(place as integer) as place, round(price + 0.00000013::double, 6) as price, round(strength, 6) as strength, (origin = 'high') "
    "= (kind = 'support') as flipped from nr where place <= 3"
))
def find_support_resistance(spark, sf):
    return lv.nearest(_levels(spark, sf)).select("symbol", "kind", "place", F.round(F.col("price") + OFF, 6).alias("price"), F.round("strength", 6).alias("strength"), "flipped")


TREND = f""", tr0 as (select *, case when rn >= 20 then avg(close) over {frame(20)} end as s20, case when rn >= 50 then avg(close) over {frame(50)} end as s50,
case when rn >= 200 then avg(close) over {frame(200)} end as s200,
   (close / lag(close, 5) over w - 1) * 100 as r5, (close / lag(close, 21) over w - 1) * 100 as r21, (close / lag(close, 63) over w - 1) * 100 as r63
from tech window w as (partition by symbol order by bar_date)),
tr1 as (select *, case when close > s20 and s20 > s50 and s50 > s200 then 'aligned_bullish' when close < s20 and s20 < s50
and s50 < s200 then 'aligned_bearish' else 'mixed' end as alignment, r5 > 0 and r21 > 0 and r63 > 0 as pos, r5 < 0 and r21 < 0
and r63 < 0 as neg, (r5 + r21 + r63) / 3 as mean from tr0 where rn >= 200),
trend as (select *, case when alignment = 'aligned_bullish' and round(adx14, 9) >= 25 and pos then 'strong_up' when alignment = 'aligned_bearish'
and round(adx14, 9) >= 25 and neg then 'strong_down' when alignment = 'aligned_bullish' or (pos and mean > 1) then 'up'
when alignment = 'aligned_bearish' or (neg and mean < -1) then 'down' else 'neutral' end as bucket from tr1)"""


def trend(bars):
    """bars (with rn, adx14) from bar 200 on with alignment, returns r5, r21, r63 in % and trend bucket."""
    from tidemark.functions.windows import lag

    df = bars.withColumns({f"s{n}": sma("close", n) for n in (20, 50, 200)} | {f"r{n}": (F.col("close") / lag("close", n) - 1) * 100 for n in (5, 21, 63)}).filter("rn >= 200")
    c = F.col
    up = (c("close") > c("s20")) & (c("s20") > c("s50")) & (c("s50") > c("s200"))
    down = (c("close") < c("s20")) & (c("s20") < c("s50")) & (c("s50") < c("s200"))
    pos, neg = (c("r5") > 0) & (c("r21") > 0) & (c("r63") > 0), (c("r5") < 0) & (c("r21") < 0) & (c("r63") < 0)
    strong, mean = F.round("adx14", 9) >= 25, (c("r5") + c("r21") + c("r63")) / 3
    bucket = F.when(up & strong & pos, "strong_up").when(down & strong & neg, "strong_down").when(up | (pos & (mean > 1)), "up").when(down | (neg & (mean < -1)), "down").otherwise("neutral")
    return df.withColumns({"alignment": F.when(up, "aligned_bullish").when(down, "aligned_bearish").otherwise("mixed"), "bucket": bucket})


@query("compute_trend", with_tech() + TREND + " select symbol, bar_date, alignment, bucket, round(r5, 6) as r5, round((close - s50) / s50 * 100, 6) as above50 from trend")
def compute_trend(spark, sf):
    df = trend(p.numbered(ta.with_recursive(d.bars(spark, sf), ["adx14"])))
    return df.select(*KEYS, "alignment", "bucket", F.round("r5", 6).alias("r5"), F.round((F.col("close") - F.col("s50")) / F.col("s50") * 100, 6).alias("above50"))


VOL = _EWM + f""", v0 as (select y.*, {ta.yang_zhang_k(21)!r}::double as k, var_samp(yo) over {frame(21)} as vo, var_samp(yc) over {frame(21)} as vc, avg(rs) over {frame(21)} as vr from y),
v1 as (select symbol, bar_date, rn, close, case when rn > 21 then round(100 * sqrt(greatest(vo + k * vc + (1 - k) * vr, 0) * 252), 6) end as yz21 from v0),
v2 as (select *, count(yz21) over {frame(252)} as have, list(yz21) over {frame(252)} as vols from v1)"""


@query("compute_volatility", VOL + (
    f", v3 as (select v2.*, case when have = 252 then round(100.0::double * len(list_filter(vols, lambda v: v <= yz21)) / 252, 6) end as pct, case "
    f"when ye.s2 < 1 and ce.s2 < 1 then sqrt(greatest(ye.cov / (1 - ye.s2) + {_EWM_K!r}::double * ce.cov / (1 - ce.s2) + {1 - _EWM_K!r}::double * ce.r, 0) * "
    f"252) end as fwd from v2 left join ye using (symbol, rn) left join ce using (symbol, rn)) select symbol, bar_date, yz21, pct, case "
    f"when pct < 25 then 'low' when pct < 75 then 'normal' when pct < 90 then 'elevated' "
    f"when pct is not null then 'extreme' end as bucket, round(close * fwd * sqrt(7 / 252.0::double), 6) as move7, round(close * fwd * sqrt(30 / "
    f"252.0::double), 6) as move30 from v3"
))
def compute_volatility(spark, sf):
    df = ta.with_recursive(d.bars(spark, sf), ["yz_ewm", "yz21", "yz_rank_21_252"])
    df = df.withColumns({"yz21": F.round(100 * F.col("yz21"), 6), "pct": F.round(100.0 * F.col("yz_rank_21_252"), 6)})
    bucket = F.when(F.col("pct") < 25, "low").when(F.col("pct") < 75, "normal").when(F.col("pct") < 90, "elevated").when(F.col("pct").isNotNull(), "extreme")
    move = lambda h: F.round(F.col("close") * F.col("yz_ewm") * (h / 252) ** 0.5, 6)
    return df.select(*KEYS, "yz21", "pct", bucket.alias("bucket"), move(7).alias("move7"), move(30).alias("move30"))


@query("compute_momentum", with_tech() + """, m0 as (select *, round(macd - macd_signal, 9) as h, round(rsi14, 9) as r from tech), m1 as (select *, lag(h) over (partition by symbol order by bar_date) as hp from m0)
select symbol, bar_date, case when r <= 30 then 'oversold' when r <= 40 then 'low' when r <= 60 then 'neutral' when r <= 70 then 'high' else 'overbought' end as rsi_bucket,
  case when hp <= 0 and h > 0 then 'bullish_cross' when hp >= 0 and h < 0 then 'bearish_cross' when h > 0 then 'bullish' when h < 0 then 'bearish' else 'neutral' end as macd_state from m1 where rn >= 35""")
def compute_momentum(spark, sf):
    from tidemark.functions.windows import lag

    df = p.numbered(ta.with_recursive(d.bars(spark, sf), ["rsi14", "macd", "macd_signal"])).withColumns({"h": F.round(F.col("macd") - F.col("macd_signal"), 9), "r": F.round("rsi14", 9)}).withColumn("hp", lag("h"))
    h, hp, r = F.col("h"), F.col("hp"), F.col("r")
    rsi = F.when(r <= 30, "oversold").when(r <= 40, "low").when(r <= 60, "neutral").when(r <= 70, "high").otherwise("overbought")
    state = F.when((hp <= 0) & (h > 0), "bullish_cross").when((hp >= 0) & (h < 0), "bearish_cross").when(h > 0, "bullish").when(h < 0, "bearish").otherwise("neutral")
    return df.filter("rn >= 35").select(*KEYS, rsi.alias("rsi_bucket"), state.alias("macd_state"))


@query("analyze_symbol", with_tech() + TREND + (
    f", a0 as (select symbol, arg_max({{'b': bucket, 'a': alignment, 'r': round(rsi14, 6), 'x': round(adx14, 6), 'c': close}}, bar_date) as l, max(bar_date) "
    f"as as_of from trend group by 1) select symbol, as_of, l.b as trend, l.a as alignment, l.r as rsi14, l.x as adx14, l.c as close from a0"
))
def analyze_symbol(spark, sf):
    df = trend(p.numbered(ta.with_recursive(d.bars(spark, sf), ["adx14", "rsi14"])))
    latest = store.latest(df, ["symbol"], "bar_date", ["bar_date", "bucket", "alignment", "rsi14", "adx14", "close"])
    return latest.select("symbol", F.col("bar_date").alias("as_of"), F.col("bucket").alias("trend"), "alignment", F.round("rsi14", 6).alias("rsi14"), F.round("adx14", 6).alias("adx14"), "close")


@query("chart_payload", with_bars() + (
    f", c0 as (select *, max(rn) over (partition by symbol) as top, case when rn >= 20 then avg(close) over {frame(20)} end as s20 from n) "
    f"select symbol, count(*) as n, list(close order by bar_date) as closes, list(case when s20 is null then -1 else s20 end order by bar_date) as sma20 "
    f"from c0 where rn > top - 50 group by 1"
))
def chart_payload(spark, sf):
    df = p.numbered(d.bars(spark, sf)).withColumn("s20", F.coalesce(sma("close", 20), F.lit(-1.0)))
    from pyspark.sql import Window

    df = df.withColumn("top", F.max("rn").over(Window.partitionBy("symbol"))).filter("rn > top - 50")
    rows = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("bar_date", "close", "s20"))).alias("x"))
    return rows.select("symbol", "n", F.transform("x", lambda r: r["close"]).alias("closes"), F.transform("x", lambda r: r["s20"]).alias("sma20"))


# Options: the grid of fixtures, one row for each underlying price of the trades

GRID = (
    "select trade_id, entry as s, entry * (0.8::double + trade_id % 5 / 10.0::double) as k, (7 + trade_id % 60) / 365.0::double as t, 0.04::double as r, "
    "(15 + trade_id % 40) / 100.0::double as v from trades"
)
D1 = "(ln(s / k) + (r + v * v / 2) * t) / (v * sqrt(t))"


def _grid(spark, sf):
    k = F.col("trade_id")
    return d.trades(spark, sf).select("trade_id", F.col("entry").alias("s"), (F.col("entry") * (0.8 + k % 5 / F.lit(10.0))).alias("k"), ((7 + k % 60) / F.lit(365.0)).alias("t"), F.lit(0.04).alias("r"), ((15 + k % 40) / F.lit(100.0)).alias("v"))




def _args():
    return [F.col(c) for c in ("s", "k", "t", "r", "v")]


@query("bs_d1_d2", d.with_views("trades") + f", g as ({GRID}) select trade_id, round({D1}, 9) as d1, round({D1} - v * sqrt(t), 9) as d2 from g")
def bs_d1_d2(spark, sf):
    a = o.d1(*_args())
    return _grid(spark, sf).select("trade_id", F.round(a, 9).alias("d1"), F.round(a - F.col("v") * F.sqrt("t"), 9).alias("d2"))


@query("norm_cdf", d.with_views("trades") + (
    f", g as ({GRID}), x as (select trade_id, {D1} as x, (trade_id % 997 + 1) / 998.0::double as p from g) "
    f"select trade_id, round({o.cdf_sql('x')}, 9) as cdf, round({o.ppf_sql('p')}, 9) as ppf from x"
))
def norm_cdf(spark, sf):
    """The chance of each option's d1, and the quantile of a share that its trade's number gives."""
    x = _grid(spark, sf).select("trade_id", o.d1(*_args()).alias("x"), ((F.col("trade_id") % 997 + 1) / F.lit(998.0)).alias("p"))
    return x.select("trade_id", F.round(o.norm_cdf(F.col("x")), 9).alias("cdf"), F.round(o.norm_ppf(F.col("p")), 9).alias("ppf"))


BS = d.with_views("trades") + (
    f", g as ({GRID}), g1 as (select *, {D1} as a, {D1} - v * sqrt(t) as b from g), "
    f"g2 as (select *, {o.cdf_sql('a')} as na, {o.cdf_sql('b')} as nb, {o.cdf_sql('(-a)')} as ma, {o.cdf_sql('(-b)')} as mb, exp(-a * a / 2) / "
    f"2.5066282746310002::double as pa from g1)"
)


@query("bs_price", BS + " select trade_id, round(s * na - k * exp(-r * t) * nb, 6) as call, round(k * exp(-r * t) * mb - s * ma, 6) as put from g2")
def bs_price(spark, sf):
    return _grid(spark, sf).select("trade_id", F.round(o.price("call", *_args()), 6).alias("call"), F.round(o.price("put", *_args()), 6).alias("put"))


@query("bs_greeks", BS + (
    " select trade_id, round(na - 1, 8) + 0.0::double as delta, round(pa / (s * v * sqrt(t)), 8) as gamma, round((-s * pa * v / (2 * sqrt(t)) + r * k * "
    "exp(-r * t) * mb) / 365, 8) + 0.0::double as theta, round(s * pa * sqrt(t) / 100, 8) as vega from g2"
))
def bs_greeks(spark, sf):
    return _grid(spark, sf).select("trade_id", *[(F.round(c, 8) + F.lit(0.0)).alias(n) for n, c in o.greeks("put", *_args()).items()])


TENORS = [(6, 0.15), (13, 0.15), (30, 0.20)]


@query("strike_sets", d.with_views("trades") + (
    f", g as ({GRID}), tn(days, target) as (values (6, 0.15::double), (13, 0.15::double), (30, 0.20::double)), "
    f"g1 as (select trade_id, s, r, v, days, days / 365.0::double as t, kind, case when kind = 'call' then target else 1 - target end as p "
    f"from g, tn, (values ('call'), ('put')) k(kind)) "
    f"select trade_id, kind, days, round(s * exp((r + v * v / 2) * t - {o.ppf_sql('p')} * v * sqrt(t)), 2) as strike from g1"
))
def strike_sets(spark, sf):
    tenors = F.explode(F.array(*[F.struct(F.lit(days).alias("days"), F.lit(x).alias("target"), F.lit(k).alias("kind")) for days, x in TENORS for k in ("call", "put")])).alias("tenor")
    g = _grid(spark, sf).select("trade_id", "s", "r", "v", tenors).select("trade_id", "s", "r", "v", "tenor.*").withColumn("t", F.col("days") / F.lit(365.0))
    at = lambda kind: o.strike_for_delta(kind, F.col("target") if kind == "call" else -F.col("target"), F.col("s"), F.col("t"), F.col("r"), F.col("v"))
    return g.select("trade_id", "kind", "days", F.round(F.when(F.col("kind") == "call", at("call")).otherwise(at("put")), 2).alias("strike"))


@query("strike_confluences", with_tech() + """, la as (select symbol, arg_max({'c': close, 'a': atr14, 'e9': ema9, 'e50': ema50, 'e200': ema200}, bar_date) as l from tech group by 1)
select symbol, list_filter(['ema9', 'ema50', 'ema200'], lambda e: abs(case e when 'ema9' then l.e9 when 'ema50' then l.e50 else l.e200 end - round(l.c)) <= 0.5::double * l.a) as near from la""")
def strike_confluences(spark, sf):
    df = ta.with_recursive(d.bars(spark, sf), ["atr14", "ema9", "ema50", "ema200"])
    latest = store.latest(df, ["symbol"], "bar_date", ["close", "atr14", "ema9", "ema50", "ema200"])
    near = F.array_compact(F.array(*[F.when(F.abs(F.col(e) - F.round("close")) <= 0.5 * F.col("atr14"), e) for e in ("ema9", "ema50", "ema200")]))
    return latest.select("symbol", near.alias("near"))


@query("options_context", with_bars("earnings") + LEVELS + """, oc as (select en.symbol, last_close, max(price) filter (where price < last_close
and strength >= 0.1) as support, min(price) filter (where price >= last_close and strength >= 0.1) as resistance from en left join lvls using (symbol)
group by 1, 2),
ea as (select symbol, min(report_date) as next_report from earnings where report_date >= date '2000-06-01' group by 1)
select symbol, round(support + 0.00000013::double, 6) as support, round(resistance + 0.00000013::double, 6) as resistance, cast(next_report - date
'2000-06-01' as integer) as days_to_earnings, coalesce(next_report - date '2000-06-01' <= 7, false) as earnings_soon from oc left
join ea using (symbol)""")
def options_context(spark, sf):
    found = _levels(spark, sf).filter("strength >= 0.1")
    per = found.groupBy("symbol").agg(F.max(F.when(F.col("kind") == "support", F.col("price"))).alias("support"), F.min(F.when(F.col("kind") == "resistance", F.col("price"))).alias("resistance"))
    day = F.lit("2000-06-01").cast("date")
    soon = d.earnings(spark, sf).filter(F.col("report_date") >= day).groupBy("symbol").agg(F.min("report_date").alias("next"))
    df = d.bars(spark, sf).select("symbol").distinct().join(per, "symbol", "left").join(soon, "symbol", "left")
    days = F.datediff("next", day)
    return df.select("symbol", F.round(F.col("support") + OFF, 6).alias("support"), F.round(F.col("resistance") + OFF, 6).alias("resistance"), days.alias("days_to_earnings"), F.coalesce(days <= 7, F.lit(False)).alias("earnings_soon"))
