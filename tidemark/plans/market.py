"""Queries of composite reads, regime, sectors, breadth, structure and calendar."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import ta
from tidemark.functions.windows import last
from tidemark.operators import market as m
from tidemark.operators import primitives as p
from tidemark.plans.registry import query
from tidemark.plans.sql import wilder, with_bars, with_tech
from tidemark.plans.store import members_as_of
from tidemark.sources import driver as d
from tidemark.sources.driver import with_views

KEYS = ["symbol", "bar_date"]
CLIP = "greatest(-1.0::double, least(1.0::double, {}))".format


def clip(x: str, low: str = "-1.0::double") -> str:
    return f"(case when ({x}) is not null then greatest({low}, least(1.0::double, ({x}))) end)"


def frame(n: int, key: str = "symbol") -> str:
    return f"(partition by {key} order by bar_date rows between {n - 1} preceding and current row)"


TREND = with_bars() + f""", s as (select *, case when rn >= 50 then avg(close) over {frame(50)} end as s50, case when rn >= 200 then avg(close) over {frame(200)} end as s200 from n),
t as (select *, lag(s50, 20) over (partition by symbol order by bar_date) as b50 from s),
u as (select *, {clip('(close - s50) / s50 / 0.10::double')} as p50, {clip('(close - s200) / s200 / 0.25::double')} as p200, coalesce({clip('(s50 - b50) / b50 / 0.05::double')}, 0) as sl from t)"""


@query("trend_location", TREND + (
    " select symbol, bar_date, case when rn >= 220 then round(0.4::double * p50 + 0.2::double * p200 + 0.4::double * sl, 6) "
    "when rn >= 60 then round(0.5::double * p50 + 0.5::double * sl, 6) end as trend_raw from u"
))
def trend_location(spark, sf):
    return p.trend_location(d.bars(spark, sf)).select(*KEYS, F.round("trend_raw", 6).alias("trend_raw"))


REVERSAL = f""", rv as (select *, lag(rsi2) over (partition by symbol order by bar_date) as b from tech),
rw as (select *, case when least(rsi2, b) <= 10 then {clip('(10 - least(rsi2, b)) / 10', '0.0::double')} * (case when rsi2 > b then 0.5 else 0 end + case when close > pc then 0.5 else 0 end) else 0 end as bull,
          case when greatest(rsi2, b) >= 90 then {clip('(greatest(rsi2, b) - 90) / 10', '0.0::double')} * (case when rsi2 < b then 0.5 else 0 end + case when close < pc then 0.5 else 0 end) else 0 end as bear from rv)"""


@query("reversal_trigger", with_tech() + REVERSAL + f" select symbol, bar_date, case when rn >= 15 then round({clip('bull - bear')}, 6) end as reversal_raw from rw")
def reversal_trigger(spark, sf):
    df = p.reversal_trigger(p.numbered(ta.with_recursive(d.bars(spark, sf), ["rsi2"])))
    return df.select(*KEYS, F.round("reversal_raw", 6).alias("reversal_raw"))


PIVOTS = """, pv as (select *, case when count(low) over c = 7 and low = min(low) over c then low end as plow, case when count(high) over c = 7 and high = max(high) over c then high end as phigh,
   min(low) over l3 as l3, max(high) over l3 as h3 from tech window c as (partition by symbol order by bar_date rows between 3 preceding and 3 following), l3 as (partition by symbol order by bar_date rows between 2 preceding and current row)),
pw as (select *, list(plow) over e as lows, list(phigh) over e as highs from pv window e as (partition by symbol order by bar_date rows between 60 preceding and 3 preceding)),
px as (select *, list_max(list_filter(lows, lambda x: x is not null and x <= close)) as sup, list_min(list_filter(highs, lambda x: x is not null and x >= close)) as res from pw),
py as (select *, coalesce(greatest(0, least(1, 1 - (l3 - sup) / (1.5::double * atr14))), 0) as ns0, coalesce(greatest(0, least(1, 1 - (res - h3) / (1.5::double * atr14))), 0) as nr0 from px),
pz as (select *, case when sup is null then 0 else ns0 end as ns, case when res is null then 0 else nr0 end as nr from py)"""


@query("pivot_proximity", with_tech() + PIVOTS + (
    " select symbol, bar_date, case when rn >= 64 then sup end as support, case when rn >= 64 then res end as resistance, case "
    "when rn >= 64 then round(ns, 6) end as near_sup, case when rn >= 64 then round(nr, 6) end as near_res, case "
    "when rn >= 64 then round(ns - nr, 6) end as pivot_raw from pz"
))
def pivot_proximity(spark, sf):
    df = p.pivot_proximity(p.numbered(ta.with_recursive(d.bars(spark, sf), ["atr14"])))
    return df.select(*KEYS, "support", "resistance", *[F.round(c, 6).alias(c) for c in ("near_sup", "near_res", "pivot_raw")])


VOLUME = """, va as (select symbol, bar_date, rn, list_median(list(volume) over b50) as vm, list_median(list(high - low) over b50) as sm from n
   window b50 as (partition by symbol order by bar_date rows between 54 preceding and 5 preceding)),
vb as (select va.symbol, va.bar_date, vm, sm, {'h': high, 'l': low, 'c': close, 'v': volume, 'p': pc} as b from (select *, unnest([0, 1, 2, 3, 4]) as back from va where rn >= 56 and vm > 0 and sm > 0) va
   join n on n.symbol = va.symbol and n.rn = va.rn - back),
vc as (select symbol, bar_date, b.h - b.l as rng, b.v / vm as rv, ((b.c - b.l) - (b.h - b.c)) / nullif(b.h - b.l, 0) as clv, (b.h - b.l) / sm as sr, b.c as c, b.p as pc from vb),
vd as (select symbol, bar_date, max(case when rng > 0 and rv >= 1 then greatest(0, least(1, (rv - 1.5) / 1.5)) * (case when c < pc
and clv > 0 then clv when c > pc and clv < 0 then -clv else 0 end) * (case when sr >= 1.3 then 1.0
when sr <= 0.7 then 0.85 else 0.5 end) else 0 end) as score from vc group by 1, 2)"""


@query("volume_confirm", with_bars() + VOLUME + (
    " select n.symbol, n.bar_date, round(score, 6) as volume_score, case "
    "when score is not null then round(0.75 + 0.25 * least(1, score), 6) end as volume_multiplier from n left join vd using (symbol, bar_date)"
))
def volume_confirm(spark, sf):
    df = p.volume_confirm(p.numbered(d.bars(spark, sf)))
    return df.select(*KEYS, F.round("volume_score", 6).alias("volume_score"), F.round("volume_multiplier", 6).alias("volume_multiplier"))


RS = f""", ra as (select n.*, v.close as level from n asof left join market v on n.bar_date >= v.bar_date),
rb as (select *, {clip('((close / lag(close, 63) over w - 1) - (level / lag(level, 63) over w - 1)) / 0.15::double')} as rs, close / level as line from ra window w as (partition by symbol order by bar_date)),
rc as (select *, case when rn >= 20 then avg(line) over {frame(20)} end as av from rb),
rd as (select *, lag(av, 20) over (partition by symbol order by bar_date) as av0 from rc)"""


@query("relative_strength", with_bars("market") + RS + f" select symbol, bar_date, case when rn > 63 then round({clip(f'0.7::double * rs + 0.3::double * coalesce({clip("(av - av0) / av0 / 0.05::double")}, 0)')}, 6) end as rs_raw from rd")
def relative_strength(spark, sf):
    # The benchmark has one row a day and a row for every bar's day.
    level = d.market(spark, sf).withColumnRenamed("close", "level")
    bars = p.numbered(d.bars(spark, sf)).join(F.broadcast(level), "bar_date")
    return p.relative_strength(bars, None, ["symbol"]).select(*KEYS, F.round("rs_raw", 6).alias("rs_raw"))


@query("sector_relative_strength", with_bars("sectors") + """, sd as (select bar_date, lag(bar_date) over (order by bar_date) as pb from (select distinct bar_date from bars)),
sr as (select n.symbol, n.bar_date, case when lag(n.bar_date) over (partition by n.symbol order by n.bar_date) = pb then close / pc - 1 end as ret from n join sd using (bar_date)),
ss as (select sector, bar_date, case when count(ret) >= 1 then avg(ret) end as ret from sr join sectors using (symbol) where sector is not null group by 1, 2),
sl as (select sector, bar_date, 100 * product(1 + coalesce(ret, 0)) over (partition by sector order by bar_date rows between unbounded preceding and current row) as level from ss),
ra as (select n.*, l.level from n left join sectors s using (symbol) asof left join sl l on s.sector = l.sector and n.bar_date >= l.bar_date),""" + RS.split("),", 1)[1] + f" select symbol, bar_date, case when rn > 63 then round({clip(f'0.7::double * rs + 0.3::double * coalesce({clip("(av - av0) / av0 / 0.05::double")}, 0)')}, 4) + 0.0::double end as rs_raw from rd")
def sector_relative_strength(spark, sf):
    bars, sectors = p.numbered(d.bars(spark, sf)), d.sectors(spark, sf)
    levels = m.chained(m.sector_returns(m.panel_returns(bars), sectors, 1)).select("sector", "bar_date", "level")
    tagged = bars.join(sectors, "symbol", "left")
    own = tagged.select("symbol", "sector", "bar_date").join(levels, ["sector", "bar_date"]).select("symbol", "bar_date", "level")
    return p.relative_strength(bars, own, ["symbol"]).select(*KEYS, (F.round("rs_raw", 4) + F.lit(0.0)).alias("rs_raw"))


@query("fibonacci", with_bars() + """, f as (select *, max(high) over w as hi, min(low) over w as lo, arg_max(rn, {'h': high, 'r': -rn}) over w as ph_, arg_min(rn, {'l': low, 'r': rn})
over w as pl_ from n window w as (partition by symbol order by bar_date rows between 119 preceding and current row))
select symbol, bar_date, hi as high, lo as low, case
when ph_ >= pl_ then 'down_from_high' else 'up_from_low' end as direction, hi - 0.382::double * (hi - lo) as r382, hi - 0.618::double * (hi - lo) as
r618 from f where rn >= 120 and hi > lo""")
def fibonacci(spark, sf):
    df = p.fibonacci(p.numbered(d.bars(spark, sf))).filter("fib is not null")
    return df.select(*KEYS, "fib.high", "fib.low", "fib.direction", F.col("fib.levels")[1].alias("r382"), F.col("fib.levels")[3].alias("r618"))


# Regime: one row for each day of the series


def regime_frame(spark, sf):
    """series, bar_date, close (equal weights), vix, oas, weighted (by volume), with the components of the composite."""
    mkt = d.market(spark, sf).select(F.lit("MKT").alias("series"), "bar_date", "close")
    macro = d.macro(spark, sf).groupBy(F.col("as_of_date").alias("bar_date")).agg(F.max(F.when(F.col("series_code") == "VIX", F.col("value"))).alias("vix"), F.max(F.when(F.col("series_code") == "OAS", F.col("value"))).alias("oas"))
    weighted = d.bars(spark, sf).groupBy("bar_date").agg((F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("weighted"))
    df = mkt.join(macro, "bar_date").join(weighted, "bar_date").select("series", "bar_date", "close", "vix", "oas", "weighted")
    df = m.breadth_score(m.trend_score(df), "close", "weighted")
    df = m.credit_stress(df.withColumns({"vol_score": m.calm_score("vix"), "credit_score": m.calm_score("oas"), "oas_z": m.zscore("oas")}), "oas")
    return df.withColumn("composite", m.composite())


def _rank(c: str) -> str:
    return (
        f"case when count({c}) over {frame(252, 'series')} = 252 then (list_sum(list_transform(list({c}) over {frame(252, 'series')}, lambda v: case "
        f"when v < {c} then 1 else 0 end)) + (list_sum(list_transform(list({c}) over {frame(252, 'series')}, lambda v: case "
        f"when v = {c} then 1 else 0 end)) + 1) / 2.0::double) / 252 end"
    )


REGIME = with_views("bars", "market", "macro") + f""", mp as (select as_of_date as bar_date, max(value) filter (where series_code = 'VIX') as vix, max(value) filter (where series_code = 'OAS') as oas from macro group by 1),
eq as (select bar_date, sum(close * volume) / cast(sum(volume) as double) as weighted from bars group by 1),
g0 as (select 'MKT' as series, bar_date, close, vix, oas, weighted, close / weighted as r, row_number() over (order by bar_date) as rn from market join mp using (bar_date) join eq using (bar_date)),
g1 as (select *, case when rn >= 200 then avg(close) over {frame(200, 'series')} end as s, case
when rn >= 20 then avg(r) over {frame(20, 'series')} end as a, case when rn >= 200 then avg(r) over {frame(200, 'series')} end as b,
   {_rank('vix')} as vr, {_rank('oas')} as cr, avg(oas) over {frame(252, 'series')} as om, stddev_pop(oas) over {frame(252, 'series')} as od from g0),
g2 as (select *, lag(s, 20) over (order by bar_date) as s0, lag(oas, 5) over (order by bar_date) as o5 from g1),
g as (select series, bar_date, close, 1 - vr as vol_score, 1 - cr as credit_score,
{clip(f"0.5::double + 0.25::double * ({clip('(close - s) / s / 0.05::double')} + {clip('(s - s0) / s0 / 0.02::double')})", '0.0::double')} as
trend_score,
   0.5::double + 0.5::double * {clip('(a - b) / b / 0.05::double')} as breadth_score, coalesce(cr > 0.85 and oas > o5, false) as credit_stress, case
when rn >= 252 then (oas - om) / nullif(od, 0) end as oas_z from g2),
gc as (select *, (coalesce(0.40::double * vol_score, 0) + coalesce(0.25::double * trend_score, 0) + coalesce(0.20::double * breadth_score, 0) +
coalesce(0.15::double * credit_score, 0)) / nullif(case when vol_score is null then 0 else 0.40::double end + case
when trend_score is null then 0 else 0.25::double end + case when breadth_score is null then 0 else 0.20::double end + case
when credit_score is null then 0 else 0.15::double end, 0) as composite from g)"""


def _regime(name: str, columns: list[str], sql: list[str]) -> None:
    def run(spark, sf):
        df = regime_frame(spark, sf)
        return df.select("bar_date", *[(c if df.schema[c].dataType.simpleString() != "double" else F.round(c, 6).alias(c)) for c in columns])

    query(name, REGIME + " select bar_date, " + ", ".join(sql) + " from gc")(run)


for _name, _column in (("vol_score", "vol_score"), ("credit_score", "credit_score"), ("regime_trend_score", "trend_score"), ("breadth_score", "breadth_score"), ("hy_oas_zscore", "oas_z"), ("composite_score", "composite")):
    _regime(_name, [_column], [f"round({_column}, 6) as {_column}"])
_regime("credit_stress_flag", ["credit_stress"], ["credit_stress"])


@query("classify_regime", with_tech() + (
    f" select symbol, bar_date, case when adx14 > 25 then case when close > avg(close) over {frame(200)} then 'trending_up' else 'trending_down' end "
    f"when adx14 < 18 then 'choppy' else 'transitioning' end as label from tech qualify rn >= 230"
))
def classify_regime(spark, sf):
    df = p.numbered(ta.with_recursive(d.bars(spark, sf), ["adx14"]))
    from tidemark.functions.windows import sma

    return df.withColumn("s", sma("close", 200)).filter("rn >= 230").select(*KEYS, m.label(F.col("adx14"), F.col("close"), F.col("s")).alias("label"))


@query("regime_factor", REGIME + (
    ", a(strategy, affinity) as (values ('rsi2', 0.7::double), ('donchian', 0.5::double)) "
    "select strategy, bar_date, round(affinity * coalesce(0.5 + 0.5 * composite, 1) * case when credit_stress then 0.5 else 1 end, 6) as factor from gc, a"
))
def regime_factor(spark, sf):
    affinity = F.explode(F.array(F.struct(F.lit("rsi2").alias("strategy"), F.lit(0.7).alias("affinity")), F.struct(F.lit("donchian").alias("strategy"), F.lit(0.5).alias("affinity")))).alias("a")
    df = regime_frame(spark, sf).select("*", affinity).select("*", "a.*")
    return df.select("strategy", "bar_date", F.round(m.regime_factor(F.col("affinity"), F.col("composite"), F.col("credit_stress")), 6).alias("factor"))


# The benchmark as bars: the market's label, and with it the regime that sizes of scans and backtests follow


def market_bars(spark, sf):
    """The benchmark's bars: means over all symbols."""
    means = [F.avg(c).alias(c) for c in ("open", "high", "low", "close")]
    bars = d.bars(spark, sf).groupBy("bar_date").agg(*means, F.sum("volume").alias("volume"))
    return bars.select(F.lit("MKT").alias("symbol"), "bar_date", "open", "high", "low", "close", "volume")


def market_labels(spark, sf):
    """bar_date, label from bar 230 of the benchmark on."""
    mkt = p.numbered(ta.with_recursive(market_bars(spark, sf), ["adx14"]))
    return mkt.withColumn("label", m.label(F.round("adx14", 6), F.col("close"), F.avg("close").over(last(200)))).filter("rn >= 230").select("bar_date", "label")


def regime(spark, sf):
    """bar_date, label, composite, credit_stress from bar 230 of the benchmark on."""
    return regime_frame(spark, sf).join(market_labels(spark, sf), "bar_date").select("bar_date", "label", F.round("composite", 9).alias("composite"), "credit_stress")


#: CTEs for `lb`: bar_date, label, mrn of the benchmark, by its own chain of Wilder means.
LABELS = ",".join([
    """mbars as (select 'MKT' as symbol, bar_date, avg(high) as high, avg(low) as low, avg(close) as close from bars group by bar_date),
mn0 as materialized (select *, row_number() over w as rn, lag(close) over w as pc, lag(high) over w as ph, lag(low) over w as pl from mbars window w as (order by bar_date)),
mn as materialized (select *, greatest(high - low, abs(high - pc), abs(low - pc)) as tr,
   case when high - ph > pl - low and high - ph > 0 then high - ph else 0 end as pdm, case when pl - low > high - ph and pl - low > 0 then pl - low else 0 end as mdm from mn0)""",
    wilder("mw14", 14, {"a14": "tr", "p14": "pdm", "m14": "mdm"}, "mn"),
    """mdx as materialized (select mn.symbol, mn.rn, case when w.a14 > 0 and w.p14 + w.m14 > 0 then 100 * abs(w.p14 - w.m14) / (w.p14 + w.m14) else 0 end as dx from mn left join mw14 w on mn.rn = w.rn)""",
    wilder("mwx", 14, {"adx": "dx"}, "mdx"),
    """lb as (select bar_date, case when round(adx, 6) > 25 then case when close > avg(close) over (order by bar_date rows between 199 preceding and current row) then 'trending_up' else 'trending_down' end
   when round(adx, 6) < 18 then 'choppy' else 'transitioning' end as label, mn.rn as mrn from mn left join mwx using (rn))""",
])


@query("detect_regime", REGIME + ", " + LABELS + " select gc.bar_date, label, round(round(composite, 9) + 3e-10::double, 6) as composite, credit_stress from gc join lb using (bar_date) where mrn >= 230")
def detect_regime(spark, sf):
    # Many composites end in 5 at the seventh digit: three tenths of the ninth one keep them off the border.
    return regime(spark, sf).withColumn("composite", F.round(F.col("composite") + 3e-10, 6))


# Sectors and breadth

PANEL = """, sd as (select bar_date, lag(bar_date) over (order by bar_date) as pb from (select distinct bar_date from bars)),
sr as (select n.symbol, n.bar_date, case when lag(n.bar_date) over (partition by n.symbol order by n.bar_date) = pb then close / pc - 1 end as ret from n join sd using (bar_date))"""


@query("daily_returns", with_bars() + PANEL + " select symbol, bar_date, ret from sr")
def daily_returns(spark, sf):
    return m.panel_returns(d.bars(spark, sf))


@query("sector_code", with_views("sectors") + " select symbol, upper(trim(regexp_replace(sector || ' & co.', '[^A-Za-z0-9]+', '_', 'g'), '_')) as code from sectors where sector is not null")
def sector_code(spark, sf):
    return d.sectors(spark, sf).filter("sector is not null").select("symbol", m.sector_code(F.concat("sector", F.lit(" & co."))).alias("code"))


SECTORS = PANEL + ", ss as (select sector, bar_date, case when count(ret) >= 3 then avg(ret) end as ret, count(ret) as members from sr join sectors using (symbol) where sector is not null group by 1, 2)"


@query("sector_daily_returns", with_bars("sectors") + SECTORS + " select sector, bar_date, round(ret, 8) as ret, members from ss")
def sector_daily_returns(spark, sf):
    return m.sector_returns(m.panel_returns(d.bars(spark, sf)), d.sectors(spark, sf)).withColumn("ret", F.round("ret", 8))


@query("chain_to_levels", with_bars("sectors") + SECTORS + " select sector, bar_date, round(100 * product(1 + coalesce(ret, 0)) over (partition by sector order by bar_date rows between unbounded preceding and current row), 4) as level from ss")
def chain_to_levels(spark, sf):
    return m.chained(m.sector_returns(m.panel_returns(d.bars(spark, sf)), d.sectors(spark, sf))).select("sector", "bar_date", F.round("level", 4).alias("level"))


@query("sector_composite_bars", with_bars("sectors", "membership") + PANEL + """, ss as (select sector, sr.bar_date, case when count(ret) >= 3 then avg(ret) end as ret from sr join sectors using (symbol)
join membership m on m.symbol = sr.symbol and joined_date <= sr.bar_date and (left_date is null or left_date > sr.bar_date) where sector is not null
group by 1, 2),
sl as (select sector, bar_date, round(100 * product(1 + coalesce(ret, 0)) over (partition by sector order by bar_date rows between unbounded preceding and current row), 4) as level from ss)
select '$EWSECTOR:' || replace(upper(sector), ' ', '_') as symbol, bar_date, level as open, level as high, level as low, level as close, cast(0 as bigint) as volume from sl""")
def sector_composite_bars(spark, sf):
    from tidemark.operators.store import in_interval

    held = in_interval(m.panel_returns(d.bars(spark, sf)), d.membership(spark, sf), ["symbol"], "bar_date", "joined_date", "left_date")
    levels = m.chained(m.sector_returns(held, d.sectors(spark, sf))).withColumn("level", F.round("level", 4))
    return levels.select(F.concat(F.lit("$EWSECTOR:"), m.sector_code(F.col("sector"))).alias("symbol"), "bar_date", *[F.col("level").alias(c) for c in ("open", "high", "low", "close")], F.lit(0).cast("long").alias("volume"))


@query("breadth_above_sma200", with_views("bars", "membership") + """, c as (select symbol from membership where joined_date <= date '1999-06-30' and (left_date is null or left_date > date '1999-06-30')),
r as (select *, row_number() over (partition by symbol order by bar_date desc) as k from bars where bar_date < date '1999-06-30' and symbol in (select symbol from c)),
s as (select symbol, avg(close) as a, arg_max(close, bar_date) as c from r where k <= 200 group by 1 having count(*) = 200),
t as (select count(*) as eligible, count(*) filter (where c > a) as above from s)
select eligible, above, 100.0::double * above / nullif(eligible, 0) as pct_above, case when 100.0 * above / nullif(eligible, 0) >= 70 then 'strong'
when 100.0 * above / nullif(eligible, 0) >= 50 then 'healthy' when 100.0 * above / nullif(eligible, 0) >= 30 then 'weak' else 'poor' end as label
from t""")
def breadth_above_sma200(spark, sf):
    return m.breadth(d.bars(spark, sf), members_as_of(d.membership(spark, sf), "1999-06-30"), "1999-06-30")


# Calendar, drawdown, structure of the market series

MONTHS = with_views("bars", "market") + ", mc as (select year(bar_date) as year, month(bar_date) as month, arg_max(close, bar_date) as close from market group by 1, 2)"


@query("monthly_seasonality", MONTHS + (
    ", r as (select year, month, close / lag(close) over (order by year, month) - 1 as ret from mc) "
    "select cast(month as integer) as month, count(ret) as n, round(avg(ret), 8) as avg, round(quantile_cont(ret, 0.5), 8) as median, round(max(ret), 8) as "
    "best, round(min(ret), 8) as worst, count(*) filter (where ret > 0) as positives, cast(min(year) as integer) as first_year, cast(max(year) as integer) "
    "as last_year from r where ret is not null and not (year = 2001 and month = 6) group by 1 having count(ret) >= 3"
))
def monthly_seasonality(spark, sf):
    s = m.seasonality(m.month_closes(d.market(spark, sf)), 2001, 6)
    return s.select("month", "n", *[F.round(c, 8).alias(c) for c in ("avg", "median", "best", "worst")], "positives", "first_year", "last_year")


@query("halloween", MONTHS + (
    ", r as (select 'winter' as season, a.close / o.close - 1 as ret from mc a join mc o on a.year = o.year + 1 and a.month = 4 and o.month = 10 union all "
    "select 'summer', o.close / a.close - 1 from mc a join mc o on a.year = o.year and a.month = 4 and o.month = 10) "
    "select season, count(ret) as n, round(avg(ret), 8) as avg, round(avg(case when ret > 0 then 1.0 else 0.0 end), 8) as positive_rate from r group by 1 "
    "having count(ret) >= 3"
))
def halloween(spark, sf):
    return m.halloween(m.month_closes(d.market(spark, sf))).select("season", "n", F.round("avg", 8).alias("avg"), F.round("positive_rate", 8).alias("positive_rate"))


@query("january_barometer", MONTHS + (
    ", y as (select sign(j.close - b.close) = sign(e.close - b.close) as hit from mc b join mc j on j.year = b.year + 1 and j.month = 1 "
    "join mc e on e.year = j.year and e.month = 12 where b.month = 12) select count(*) as n, count(*) filter (where hit) as hits, round(avg(case "
    "when hit then 1.0 else 0.0 end), 8) as rate from y"
))
def january_barometer(spark, sf):
    return m.january_barometer(m.month_closes(d.market(spark, sf))).withColumn("rate", F.round("rate", 8))


@query("cycle_years", with_views("bars") + (
    " select distinct cast(year(bar_date) as integer) as year, (['post_election', 'midterm', 'pre_election', 'election'])[((year(bar_date) - 2025) % 4 + 4) "
    "% 4 + 1] as term, cast(year(bar_date) % 10 as integer) as digit from bars"
))
def cycle_years(spark, sf):
    year = F.year("bar_date")
    return d.bars(spark, sf).select(year.alias("year")).distinct().select("year", m.presidential(F.col("year")).alias("term"), (F.col("year") % 10).alias("digit"))


@query("turn_of_month", with_views("bars") + """, dd as (select distinct bar_date as day from bars)
select day, isodow(day) <= 5 and ((select count(*) from range(date_trunc('month', day)::timestamp, (day + 1)::timestamp, interval 1 day) r(x) where isodow(x) <= 5) <= 4
  or day = last_day(day) - cast(greatest(isodow(last_day(day)) - 5, 0) as integer)) as inside from dd""")
def turn_of_month(spark, sf):
    return d.bars(spark, sf).select(F.col("bar_date").alias("day")).distinct().select("day", m.turn_of_month(F.col("day")).alias("inside"))


@query("santa_claus", with_views("bars") + """, wd as (select distinct bar_date as day from bars where isodow(bar_date) <= 5
and not (month(bar_date) = 12 and day(bar_date) = 25) and not (month(bar_date) = 1 and day(bar_date) = 1)),
k as (select day, case when month(day) = 12 then row_number() over (partition by year(day), month(day) order by day desc) <= 5
when month(day) = 1 then row_number() over (partition by year(day), month(day) order by day) <= 2 else false end as inside from wd) select day from k
where inside""")
def santa_claus(spark, sf):
    """The last five weekdays with bars of each December and the first two of each January."""
    days = d.bars(spark, sf).select(F.col("bar_date").alias("day")).distinct()
    fixed = ((F.month("day") == 12) & (F.dayofmonth("day") == 25)) | ((F.month("day") == 1) & (F.dayofmonth("day") == 1))
    weekdays = days.filter((F.weekday("day") < 5) & ~fixed).filter(F.month("day").isin(1, 12))
    w = Window.partitionBy(F.year("day"), F.month("day"))
    late, early = F.row_number().over(w.orderBy(F.desc("day"))), F.row_number().over(w.orderBy("day"))
    return weekdays.select("day", F.when(F.month("day") == 12, late <= 5).otherwise(early <= 2).alias("inside")).filter("inside").select("day")


DRAWN = with_views("bars") + (
    ", dr as (select symbol as series, bar_date, close, max(close) over w as peak, arg_max(bar_date, {'c': close, 'd': -cast(bar_date - date '1970-01-01' "
    "as integer)}) over w as peak_date, close / max(close) over w - 1 as drawdown from bars window w as (partition by symbol "
    "order by bar_date rows between unbounded preceding and current row))"
)


def _series(spark, sf):
    return d.bars(spark, sf).select(F.col("symbol").alias("series"), "bar_date", "close")


@query("drawdown_state", DRAWN + " select series, bar_date, peak, peak_date, drawdown, cast(bar_date - peak_date as integer) as days from dr")
def drawdown_state(spark, sf):
    return m.drawdowns(_series(spark, sf)).select("series", "bar_date", "peak", "peak_date", "drawdown", F.datediff("bar_date", "peak_date").alias("days"))


EPISODES = DRAWN + """, st as (select *, coalesce(last_value(case when drawdown <= -0.10 then 1 when drawdown >= -0.05 then 0 end ignore nulls) over (partition by series order by bar_date rows between unbounded preceding and current row), 0) as state from dr),
sb as (select *, case when state = 1 and coalesce(lag(state) over (partition by series order by bar_date), 0) = 0 then 1 else 0 end as starts from st),
sc as (select *, sum(starts) over (partition by series order by bar_date rows between unbounded preceding and current row) as e from sb),
ep as (select series, min(bar_date) as start_date, max(bar_date) filter (where drawdown <= -0.10) as end_date, min(drawdown) as depth from sc where state = 1 group by series, e)"""


@query("correction_episodes", EPISODES + " select * from ep")
def correction_episodes(spark, sf):
    return m.corrections(m.drawdowns(_series(spark, sf)))


@query("correction_gap", EPISODES + (
    ", gp as (select series, cast(lead(start_date) over (partition by series order by start_date) - end_date as integer) as gap from ep) "
    "select series, count(gap) as n, quantile_cont(gap, 0.5) as median_gap, max(gap) as longest from gp where gap is not null group by 1"
))
def correction_gap(spark, sf):
    gap = F.datediff(F.lead("start_date").over(Window.partitionBy("series").orderBy("start_date")), "end_date")
    gaps = m.corrections(m.drawdowns(_series(spark, sf))).select("series", gap.alias("gap")).filter("gap is not null")
    return gaps.groupBy("series").agg(F.count("gap").alias("n"), F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.max("gap").alias("longest"))


@query("adx_state", with_tech() + (
    " select symbol, bar_date, case when round(adx14, 9) < 18 then 'weak' when round(adx14, 9) < 25 then 'emerging' when round(adx14, 9) < 40 then 'strong' "
    "when round(adx14, 9) < 60 then 'very_strong' else 'extreme' end as bucket from tech where adx14 is not null"
))
def adx_state(spark, sf):
    a = F.round("adx14", 9)
    df = ta.with_recursive(d.bars(spark, sf), ["adx14"]).filter(a.isNotNull())
    return df.select(*KEYS, F.when(a < 18, "weak").when(a < 25, "emerging").when(a < 40, "strong").when(a < 60, "very_strong").otherwise("extreme").alias("bucket"))


BANDS = with_bars() + f""", bb as (select *, avg(close) over {frame(20)} as mid, stddev_pop(close) over {frame(20)} as dev from n),
bw as (select symbol, bar_date, close, case when dev > 0 then round((close - (mid - 2 * dev)) / (4 * dev), 6) end as pct_b, round(4 * dev / mid, 8) as width from bb where rn >= 20),
bx as (select *, count(width) over {frame(126)} as have, list(width) over {frame(126)} as widths from bw)"""


@query("bollinger_state", BANDS + " select symbol, bar_date, pct_b, width, case when have >= 30 then round(100.0::double * len(list_filter(widths, lambda v: v <= width)) / have, 6) end as width_pct from bx")
def bollinger_state(spark, sf):
    from tidemark.functions.windows import last

    df = p.numbered(d.bars(spark, sf)).withColumns({"mid": F.avg("close").over(last(20)), "dev": F.stddev_pop("close").over(last(20))})
    pct_b = F.when(F.col("dev") > 0, F.round((F.col("close") - (F.col("mid") - 2 * F.col("dev"))) / (4 * F.col("dev")), 6))
    df = df.withColumns({"pct_b": pct_b, "width": F.round(4 * F.col("dev") / F.col("mid"), 8)}).filter("rn >= 20")
    widths = F.collect_list("width").over(last(126))
    n = F.size("widths")
    share = F.when(n >= 30, F.round(100.0 * F.size(F.filter("widths", lambda v: v <= F.col("width"))) / n, 6))
    return df.withColumn("widths", widths).select(*KEYS, "pct_b", "width", share.alias("width_pct"))

