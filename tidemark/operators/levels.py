"""Support and resistance: swing pivots, price clusters and their strength."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import by_symbol


def pivots(bars: DataFrame, half: int = 5) -> DataFrame:
    """symbol, origin (high or low), rn, bar_date, price, volume, prominence of bars (with rn) that top or bottom `half` bars on both sides."""
    w, ahead = by_symbol().rowsBetween(-half, half), by_symbol().rowsBetween(0, half)
    df = bars.withColumns({"n": F.count("high").over(w), "mh": F.max("high").over(w), "ml": F.min("low").over(w), "fl": F.min("low").over(ahead), "fh": F.max("high").over(ahead)}).filter(F.col("n") == 2 * half + 1)
    top = F.when(F.col("high") >= F.col("mh"), F.struct(F.lit("high").alias("origin"), F.col("high").alias("price"), (F.col("high") - F.col("fl")).alias("prominence")))
    low = F.when(F.col("low") <= F.col("ml"), F.struct(F.lit("low").alias("origin"), F.col("low").alias("price"), (F.col("fh") - F.col("low")).alias("prominence")))
    return df.select("symbol", "rn", "bar_date", "volume", F.explode(F.array_compact(F.array(top, low))).alias("p")).select("symbol", "p.origin", "rn", "bar_date", "p.price", "volume", "p.prominence")


def clustered(found: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """found with cluster (int): in order of price, a pivot joins the cluster while within tolerance % of its running mean."""
    schema = found.select("symbol", "origin", "rn", "price", "volume", "prominence").schema.simpleString()[7:-1] + ",cluster:int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["price", "rn"], ignore_index=True)
        ids, total, n, cluster = [], 0.0, 0, 0
        for price in pdf["price"].tolist():
            if n and abs(price - total / n) / max(total / n, 1e-9) * 100 > tolerance:
                total, n, cluster = 0.0, 0, cluster + 1
            total, n = total + price, n + 1
            ids.append(cluster)
        return pdf[["symbol", "origin", "rn", "price", "volume", "prominence"]].assign(cluster=ids)

    return found.groupBy("symbol", "origin").applyInPandas(run, schema.replace(",", ", ").replace(":", " "))


def levels(clusters: DataFrame, ends: DataFrame, weekly: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """symbol, origin, price, touches, age, strength, kind, distance_pct, confirmed of each cluster.

    ends: symbol, n_bars, last_close. weekly: symbol, price of weekly pivots; a level within tolerance %
    of one is confirmed. Strength blends volume, recency and prominence, relative to the largest of the origin.
    """
    c = clusters.groupBy("symbol", "origin", "cluster").agg(F.avg("price").alias("price"), F.count(F.lit(1)).alias("touches"), F.sum("volume").alias("volume"), F.max("rn").alias("last_rn"), F.max("prominence").alias("prominence"))
    w = Window.partitionBy("symbol", "origin")
    c = c.withColumns({"mv": F.max("volume").over(w), "mt": F.max("touches").over(w), "mp": F.max("prominence").over(w)}).join(ends, "symbol")
    share = F.when(F.col("mv") > 0, F.col("volume") / F.col("mv")).otherwise(F.col("touches") / F.col("mt"))
    age = F.col("n_bars") - F.col("last_rn")
    strength = 0.5 * share + 0.3 * F.greatest(F.lit(0.0), 1 - age / 252) + 0.2 * F.least(F.lit(1.0), F.col("prominence") / F.when(F.col("mp") > 0, F.col("mp")).otherwise(1.0))
    near = weekly.groupBy("symbol").agg(F.collect_list("price").alias("weekly"))
    c = c.join(near, "symbol", "left").withColumn("confirmed", F.coalesce(F.exists("weekly", lambda x: F.abs(x - F.col("price")) / F.col("price") * 100 <= tolerance), F.lit(False)))
    strength = F.when(F.col("confirmed"), F.least(F.lit(1.0), strength * 1.3)).otherwise(strength)
    return c.select("symbol", "origin", "price", "touches", age.alias("age"), strength.alias("strength"), F.when(F.col("price") >= F.col("last_close"), "resistance").otherwise("support").alias("kind"), ((F.col("price") - F.col("last_close")) / F.col("last_close") * 100).alias("distance_pct"), "confirmed")


def nearest(found: DataFrame, most: float = 25.0, least: float = 0.10, n: int = 3) -> DataFrame:
    """The n strongest levels on each side within `most` %, with flipped: a high below the price or a low above it."""
    near = found.filter((F.abs("distance_pct") <= most) & (F.col("strength") >= least))
    place = F.row_number().over(Window.partitionBy("symbol", "kind").orderBy(F.desc(F.round("strength", 9)), "price"))
    flipped = ((F.col("origin") == "high") & (F.col("kind") == "support")) | ((F.col("origin") == "low") & (F.col("kind") == "resistance"))
    return near.withColumn("place", place).filter(F.col("place") <= n).withColumn("flipped", flipped)
