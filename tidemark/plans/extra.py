"""Queries that combine others: provider documents, state bundles, registries, summaries, stored models."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import options as o
from tidemark.functions import ta
from tidemark.functions.windows import last
from tidemark.operators import market as m
from tidemark.operators import store
from tidemark.operators import strategies as s
from tidemark.operators import trading as t
from tidemark.plans import market as pm
from tidemark.plans import strategies as ps
from tidemark.plans.analysis import GRID, _grid
from tidemark.plans.registry import query
from tidemark.plans.sql import TECH, with_tech
from tidemark.plans.trading import _labelled
from tidemark.sources import driver as d
from tidemark.sources import shared
from tidemark.sources.driver import with_views

# Provider documents: one JSON line a record, as they land; a schema reads them back, bad lines are left out


def landed(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("line"))


def parsed(lines: DataFrame, schema: str, *needed: str) -> DataFrame:
    """The records of JSON lines; those without the needed fields are left out."""
    rows = lines.select(F.from_json("line", schema).alias("r")).select("r.*")
    for c in needed:
        rows = rows.filter(F.col(c).isNotNull())
    return rows


@query("provider_earnings", with_views("earnings") + " select symbol, report_date, estimate, actual from earnings")
def provider_earnings(spark, sf):
    return parsed(landed(d.earnings(spark, sf)), "symbol string, report_date date, estimate double, actual double", "symbol", "report_date")


@query("provider_insider", with_views("insider") + " select code, filed_on, transaction_code, shares, price, value from insider where transaction_code in ('P', 'S')")
def provider_insider(spark, sf):
    rows = parsed(landed(d.insider(spark, sf)), "code string, filed_on date, transaction_code string, shares long, price double, value double", "code", "filed_on")
    return rows.filter(F.col("transaction_code").isin("P", "S"))


@query("provider_econ", with_views("economic_events") + " select event_id, country, name, value from economic_events where country <> 'JP'")
def provider_econ(spark, sf):
    e = d.economic_events(spark, sf).select("event_id", F.when(F.col("country") != "JP", F.col("country")).alias("country"), "name", "value")
    return parsed(landed(e), "event_id long, country string, name string, value double", "country")


@query("provider_news", with_views("news") + " select article_id, title, tags from news")
def provider_news(spark, sf):
    return parsed(landed(d.news(spark, sf).select("article_id", "title", "tags")), "article_id string, title string, tags array<string>", "article_id")


@query("provider_fundamentals", with_views("fundamentals") + " select symbol, sector_name as sector, raw_cap as market_cap from fundamentals")
def provider_fundamentals(spark, sf):
    schema = "General struct<Code: string, Sector: string>, Highlights struct<MarketCapitalization: long>"
    rows = d.fundamentals(spark, sf).select(F.from_json("payload", schema).alias("r"))
    return rows.select(F.col("r.General.Code").alias("symbol"), F.col("r.General.Sector").alias("sector"), F.col("r.Highlights.MarketCapitalization").alias("market_cap"))


@query("insert_returning", with_views("watchlist") + (
    ", mx as (select max(item_id) as top from watchlist) select list_name, symbol, top + row_number() over (order by list_name, symbol) as item_id "
    "from (select distinct list_name, symbol from watchlist) x, mx"
))
def insert_returning(spark, sf):
    """New rows get ids after the greatest one, by natural key."""
    w = d.watchlist(spark, sf)
    top = w.agg(F.max("item_id").alias("top"))
    new = store.numbered(w.select("list_name", "symbol").distinct(), ["list_name", "symbol"], "n")
    return new.join(F.broadcast(top)).select("list_name", "symbol", (F.col("top") + F.col("n")).alias("item_id"))


@query("project_params_hash", with_views("trades") + (
    """ select trade_id, sha256('{"qty":' || qty || ',"side":"' || side || '","symbol":"' || symbol || '"}') as hash from trades"""
))
def project_params_hash(spark, sf):
    """The hash of each trade's parameters: of the JSON of its fields in the order of their names."""
    return d.trades(spark, sf).select("trade_id", F.sha2(F.to_json(F.struct(*sorted(["symbol", "side", "qty"]))), 256).alias("hash"))


@query("strategy_registry", with_views("bars") + (
    ", h as (select symbol, count(*) as n from bars group by 1) select t.*, (select count(*) from h where h.n > t.history) as n_symbols "
    "from (values ('rsi2_meanrev', '1.0.0', 220, 0.01::double), ('largecap_rebound', '1.0.0', 283, 0.01::double), ('momentum_52w_high', '1.0.0', "
    "257, 0.0075::double), ('donchian_trend', '1.3.0', 215, 0.0075::double), ('reversal_swing', '1.5.0', 230, 0.01::double)) t(name, version, history, risk)"
))
def strategy_registry(spark, sf):
    """The strategies, each with the number of symbols whose history is long enough for it."""
    known = spark.createDataFrame([(x.name, x.version, x.history, x.risk) for x in s.REGISTRY.values()], "name string, version string, history int, risk double")
    long = d.bars(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    enough = [F.count_if(F.col("n") > x.history).alias(x.name) for x in s.REGISTRY.values()]
    counted = long.agg(*enough).select(F.explode(F.create_map(*[y for x in s.REGISTRY for y in (F.lit(x), F.col(x))])).alias("name", "n_symbols"))
    return known.join(F.broadcast(counted), "name")  # a row for each strategy


# The benchmark's structure


_MKT = (
    ", mbars as materialized (select 'MKT' as symbol, bar_date, avg(open) as open, avg(high) as high, avg(low) as low, avg(close) as close, "
    "cast(sum(volume) as bigint) as volume from bars group by bar_date),"
) + TECH.replace("from bars window", "from mbars window")


@query("index_structure", with_views("bars") + _MKT + (
    f", ix as (select bar_date, close, adx14, avg(close) over {pm.frame(20)} as mid, stddev_pop(close) over {pm.frame(20)} as dev from tech) "
    f"select max(bar_date) as as_of, arg_max(case when adx14 < 18 then 'weak' when adx14 < 25 then 'emerging' when adx14 < 40 then 'strong' "
    f"when adx14 < 60 then 'very_strong' else 'extreme' end, bar_date) as adx_bucket, round(arg_max((close - (mid - 2 * dev)) / (4 * dev), bar_date), 6) as "
    f"pct_b from ix"
))
def index_structure(spark, sf):
    """The benchmark's last bar: strength of trend and place in its bands."""
    df = ta.with_recursive(pm.market_bars(spark, sf), ["adx14"])
    a = F.col("adx14")
    bucket = F.when(a < 18, "weak").when(a < 25, "emerging").when(a < 40, "strong").when(a < 60, "very_strong").otherwise("extreme")
    mid, dev = F.avg("close").over(last(20)), F.stddev_pop("close").over(last(20))
    df = df.withColumns({"bucket": bucket, "pct_b": F.try_divide(F.col("close") - (mid - 2 * dev), 4 * dev)})
    return df.agg(F.max("bar_date").alias("as_of"), F.max_by("bucket", "bar_date").alias("adx_bucket"), F.round(F.max_by("pct_b", "bar_date"), 6).alias("pct_b"))


@query("calendar_state", pm.MONTHS + (
    ", r as (select year, month, close / lag(close) over (order by year, month) - 1 as ret from mc), "
    "dd as (select max(close) as peak, arg_max(close, bar_date) as now from market) select (select round(avg(ret), 8) from r where month = 7 "
    "and year < 2001) as month_avg, (select count(*) from r where month = 7 and year < 2001 "
    "and ret > 0) as positives, 'post_election' as term, (select round(now / peak - 1, 8) from dd) as drawdown"
))
def calendar_state(spark, sf):
    """One row for July 2001: the month's history, the term's year, the drawdown."""
    mkt = d.market(spark, sf)
    history = m.seasonality(m.month_closes(mkt), 2001, 7).filter("month = 7").select(F.round("avg", 8).alias("month_avg"), "positives")
    state = mkt.agg(F.round(F.max_by("close", "bar_date") / F.max("close") - 1, 8).alias("drawdown"))
    return history.join(F.broadcast(state)).select("month_avg", "positives", m.presidential(F.lit(2001)).alias("term"), "drawdown")


# Options, exits, scans, models


@query("suggest_strike", d.with_views("trades") + (
    f", g as ({GRID}), g0 as (select *, s * exp((r + v * v / 2) * t - {o.ppf_sql('0.8::double')} * v * sqrt(t)) as kk from g), "
    f"g1 as (select trade_id, s, kk as k, t, r, v, (ln(s / kk) + (r + v * v / 2) * t) / (v * sqrt(t)) as a from g0), g2 as (select *, a - v * sqrt(t) as b "
    f"from g1) select trade_id, round(k, 2) as strike, round((s - k) / s * 100, 2) as pct_otm, round({o.cdf_sql('a')} - 1, 4) as delta, round(k * exp(-r * "
    f"t) * {o.cdf_sql('(-b)')} - s * {o.cdf_sql('(-a)')}, 2) as price from g2"
))
def suggest_strike(spark, sf):
    """A put of delta -0.2: strike, distance, delta and price; greeks use the unrounded strike."""
    S, T, R, V = F.col("s"), F.col("t"), F.col("r"), F.col("v")
    g = _grid(spark, sf).withColumn("k", o.strike_for_delta("put", F.lit(-0.2), S, T, R, V))
    K = F.col("k")
    return g.select("trade_id", F.round("k", 2).alias("strike"), F.round((S - K) / S * 100, 2).alias("pct_otm"), F.round(o.greeks("put", S, K, T, R, V)["delta"], 4).alias("delta"), F.round(o.price("put", S, K, T, R, V), 2).alias("price"))




def _exit(name: str, column: str, sql: str, *needs: str) -> None:
    def run(spark, sf):
        return ps.exit_columns(s.features(d.bars(spark, sf), ps.EXIT_NEEDS)).filter("rn >= 200").select("symbol", "bar_date", column)

    windows = (
        "ex as (select *, min(low) over (partition by symbol order by bar_date rows between 10 preceding "
        "and 1 preceding) as l10, max(high) over (partition by symbol order by bar_date rows between 21 preceding and current row) as h22 from ft)"
    )
    query(name, with_tech() + ps.FEATURES + f", {windows} select symbol, bar_date, {sql} as {column} from ex where rn >= 200")(run)


_exit("exit_rsi2", "rsi2_exit", "close > s5")
_exit("exit_largecap", "largecap_exit", "round(hist, 9) <= 0")
_exit("exit_donchian", "donchian_exit", "close < l10")
_exit("exit_chandelier", "chandelier_exit", "round(close - (h22 - 3 * atr22), 9) <= 0")


@query("ratchet_stop", with_tech("market") + ps.FEATURES + ps.DONCHIAN + f", sg as ({ps.DONCHIAN_SQL.replace('select symbol,', 'select rn, symbol,', 1)})" + """,
en as (select g.symbol, g.rn + 1 as er, b.bar_date as entry_date, round(g.stop, 4) as first_stop from sg g join tech b on b.symbol = g.symbol and b.rn = g.rn + 1),
rt as (select e.*, b.bar_date, round(b.close - 2 * b.atr20, 4) as level from en e join tech b on b.symbol = e.symbol and b.rn > e.er and b.rn <= e.er + 70 and (b.rn - e.er) % 14 = 0)
select symbol, entry_date, bar_date, level, greatest(first_stop, max(level) over (partition by symbol, entry_date order by bar_date)) as stop from rt""")
def ratchet_stop(spark, sf):
    """The stop of positions that breakouts open, at every 14th bar after their own entry, for 70 bars: it only rises."""
    df = s.REGISTRY["donchian_trend"].mark(ps.inputs(spark, sf, "donchian_trend"))
    return t.ratcheted(df.withColumn("stop", F.round("donchian_trend.stop", 4)), F.round(F.col("close") - 2 * F.col("atr20"), 4), s.RATCHET, 70)


@query("sink_model", None)
def sink_model(spark, sf):
    """Trains a model, writes it to the shared folder, reads it back and scores the signals of one strategy."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from tidemark.plans.streams import _shared

    f = shared.written(_labelled(spark, sf).select("symbol", "bar_date", "label", *t.NEUTRAL, F.col("rsi2_meanrev").isNotNull().alias("signal")), "features")
    known = f.filter(F.col("label").isNotNull() & (F.col("bar_date") < "2000-01-01")).withColumn("label", F.col("label").cast("double"))
    stages = [VectorAssembler(inputCols=list(t.NEUTRAL), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features"), LogisticRegression(maxIter=20)]
    path = f"{_shared(spark)}/{uuid.uuid4().hex}"
    Pipeline(stages=stages).fit(known).write().overwrite().save(path)
    scored = PipelineModel.load(path).transform(f.filter("signal"))
    return scored.select("symbol", "bar_date", F.round(vector_to_array("probability")[1], 6).alias("p_win"))


@query("news_any", with_views("news") + " select article_id, symbol from news order by published_on desc, article_id limit 50")
def news_any(spark, sf):
    return d.news(spark, sf).orderBy(F.desc("published_on"), "article_id").limit(50).select("article_id", "symbol")


@query("get_article", with_views("news") + " select article_id, title, body from news where doc_id = 42")
def get_article(spark, sf):
    key = F.substring(F.sha2(F.lit("doc/42"), 256), 1, 32)
    return d.news(spark, sf).filter(F.col("article_id") == key).select("article_id", "title", "body")


@query("nightly_summary", with_views("bars", "watchlist") + (
    ", lb as (select symbol, arg_max(close, bar_date) as close from bars group by 1) "
    "select list_name, format('{}: {} of {} items at their target', list_name, count(*) filter (where case direction "
    "when 'above' then close >= target_price when 'below' then close <= target_price else false end), count(*)) as line from watchlist left "
    "join lb using (symbol) group by 1"
))
def nightly_summary(spark, sf):
    from tidemark.plans.text import _items

    per = _items(spark, sf).groupBy("list_name").agg(F.count_if(F.coalesce("met", F.lit(False))).alias("met"), F.count(F.lit(1)).alias("n"))
    return per.select("list_name", F.format_string("%s: %d of %d items at their target", "list_name", "met", "n").alias("line"))


@query("trading_days_since", with_views("bars") + (
    ", l as (select symbol, max(bar_date) as d from bars group by 1) select symbol, cast((select count(*) "
    "from range(cast(d + 1 as timestamp), timestamp '2002-01-11', interval 1 day) r(x) where isodow(x) <= 5) as integer) as days from l"
))
def trading_days_since(spark, sf):
    from tidemark.operators.text import weekdays_since

    latest = d.bars(spark, sf).groupBy("symbol").agg(F.max("bar_date").alias("d"))
    return latest.select("symbol", weekdays_since(F.col("d"), F.lit("2002-01-10").cast("date")).alias("days"))


@query("trades_positions", with_views("trades") + (
    " select trade_id, symbol, row_number() over (partition by symbol order by exit_date desc, trade_id) as place from trades "
    "where exit_date <= date '2000-12-31' qualify row_number() over (partition by symbol order by exit_date desc, trade_id) <= 5"
))
def trades_positions(spark, sf):
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("exit_date"), "trade_id"))
    closed = d.trades(spark, sf).filter(F.col("exit_date") <= F.lit("2000-12-31").cast("date"))
    return closed.withColumn("place", place).filter("place <= 5").select("trade_id", "symbol", F.col("place").cast("long").alias("place"))


