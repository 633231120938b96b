"""Queries that run a stream over landed files to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.plans.sql import with_tech
from tidemark.sources import driver as d
from tidemark.sources import shared
from tidemark.sources.driver import with_views
from tidemark.streaming import bars as st
from tidemark.streaming import indicators as si


def _shared(spark: SparkSession) -> str:
    return shared.folder(spark, "stream")


def _landed(df: DataFrame, folder: str) -> DataFrame:
    """df as files that land one after another, a year in each: a trigger reads one, so several triggers follow each other.

    One job writes all years, a task each; the files' times then follow their years.
    """
    spark = df.sparkSession
    years = df.withColumn("year", F.year("bar_ts")).repartition("year")
    years.write.partitionBy("year").parquet(f"{folder}/in")
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/in")
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for year in fs.listStatus(root):
        name = year.getPath().getName()
        if name.startswith("year=") and name[5:].isdigit():
            for file in fs.listStatus(year.getPath()):
                fs.setTimes(file.getPath(), 1000 * int(name[5:]), -1)
    return st.landed(spark, f"{folder}/in", years.schema).drop("year")


def _bars(spark, sf) -> DataFrame:
    b = d.bars(spark, sf)
    return b.withColumn("bar_ts", F.col("bar_date").cast("timestamp")).drop("bar_date", "adj_close")


@query("stream_weekly_bars", with_views("bars") + (
    " select symbol, cast(date_trunc('week', bar_date) as date) as week, arg_min(open, bar_date) as open, max(high) as high, min(low) as low, "
    "arg_max(close, bar_date) as close, cast(sum(volume) as bigint) as volume from bars group by 1, 2"
))
def stream_weekly_bars(spark, sf):
    folder = _shared(spark)
    return st.merged_to_end(st.weekly(_landed(_bars(spark, sf), folder)), ["symbol", "week"], f"{folder}/state", f"{folder}/out")


@query("stream_dedupe", with_views("bars") + " select symbol, bar_date, close from bars")
def stream_dedupe(spark, sf):
    folder = _shared(spark)
    b = _bars(spark, sf)
    with si.rocks(spark):  # a year's keys lie on disk, not in the tasks' heap
        out = st.run_to_end(st.deduplicated(_landed(b.unionAll(b), folder)), f"{folder}/state", f"{folder}/out")
    return out.select("symbol", F.col("bar_ts").cast("date").alias("bar_date"), "close")


@query("stream_alerts", with_views("bars", "watchlist") + (
    ", m as (select w.item_id, b.bar_date, b.close from watchlist w join bars b using (symbol) where w.alert_enabled and case w.direction "
    "when 'above' then b.close >= w.target_price when 'below' then b.close <= w.target_price else false end) "
    "select item_id, cast(min(bar_date) as timestamp) as fired_at, arg_min(close, bar_date) as close from m group by 1"
))
def stream_alerts(spark, sf):
    folder = _shared(spark)
    items = d.watchlist(spark, sf).filter("alert_enabled and target_price is not null").select("item_id", "symbol", F.col("target_price").alias("target"), "direction")
    watched = _bars(spark, sf).join(items.select("symbol").distinct(), "symbol", "left_semi")
    out = st.run_to_end(st.crossed(st.records(_landed(watched, folder)), items), f"{folder}/state", f"{folder}/out")
    return out.select("item_id", F.col("fired_at").cast("timestamp_ntz").alias("fired_at"), "close")


@query("stream_indicators", with_tech() + (
    " select symbol, bar_date, round(rsi14, 6) as rsi14, round(atr14, 6) as atr14, round(adx14, 6) as adx14, round(macd, 6) as macd, round(macd_signal, 6) as macd_signal, "
    "case when rn >= 50 then avg(close) over (partition by symbol order by bar_date rows between 49 preceding and current row) end as sma50, "
    "case when rn >= 20 then max(high) over (partition by symbol order by bar_date rows between 19 preceding and current row) end as high20 from tech"
))
def stream_indicators(spark, sf):
    """Indicators of bars that land year by year, from states of one size."""
    folder = _shared(spark)
    bars = _landed(_bars(spark, sf), folder).withColumn("bar_date", F.col("bar_ts").cast("date"))
    read = ("rsi14", "atr14", "adx14", "macd", "macd_signal", "sma50", "high20")
    with si.rocks(spark):
        out = st.merged_to_end(si.indicators(bars).select("symbol", "bar_date", *read), ["symbol", "bar_date"], f"{folder}/state", f"{folder}/out")
    return out.select("symbol", "bar_date", *[F.round(c, 6).alias(c) for c in ("rsi14", "atr14", "adx14", "macd", "macd_signal")], "sma50", "high20")
