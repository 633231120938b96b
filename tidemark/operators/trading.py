"""Trades and portfolios: slippage, metrics, labels, features, proposals, marks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ta
from tidemark.functions.windows import by_symbol, lag


def slippage(kind: str, price: Column, side: Column, volume_share: Column | None = None, bps: float = 5.0) -> Column:
    """The filled price: none, fixed basis points, or 5 + 2 basis points for each 1% of the day's volume."""
    points = {"none": F.lit(0.0), "fixed": F.lit(bps), "volume": bps + 2.0 * F.coalesce(volume_share, F.lit(0.0)) * 100}[kind]
    return price * (1 + F.when(side == "buy", points).otherwise(-points) / 10000)


def with_results(trades: DataFrame) -> DataFrame:
    """trades with pnl, ret, days and r (multiples of the risk to the stop; null without risk)."""
    move = F.when(F.col("side") == "short", F.col("entry") - F.col("exit")).otherwise(F.col("exit") - F.col("entry"))
    risk = F.col("entry") - F.col("stop")
    return trades.withColumns({"pnl": move * F.col("qty") - F.col("commission"), "ret": move / F.col("entry"), "days": F.datediff("exit_date", "entry_date"), "r": F.when(risk > 0, move / risk)})


def trade_stats(results: DataFrame, *keys: str) -> DataFrame:
    """n, win_rate, avg_win, avg_loss, profit_factor (null without losses), expectancy of each key's trades."""
    won, lost = F.col("pnl") > 0, F.col("pnl") < 0
    gains, losses = F.sum(F.when(won, F.col("pnl"))), F.sum(F.when(lost, F.col("pnl")))
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(won.cast("double")).alias("win_rate"), F.avg(F.when(won, F.col("pnl"))).alias("avg_win"), F.avg(F.when(lost, F.col("pnl"))).alias("avg_loss"),
        F.try_divide(gains, -losses).alias("profit_factor"), F.avg("pnl").alias("expectancy"),
    )


def equity_stats(curve: DataFrame, *keys: str, rate: float = 0.04) -> DataFrame:
    """cagr, sharpe, sortino, max_drawdown, longest_drawdown (rows), exposure of as_of_date, equity, positions_value, of each key's account."""
    w = Window.partitionBy(*keys).orderBy("as_of_date")  # one row for each day of an account
    df = curve.withColumns({"ret": F.col("equity") / F.lag("equity").over(w) - 1, "peak": F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    df = df.withColumns({"dd": (F.col("equity") - F.col("peak")) / F.col("peak"), "held": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("positions_value") / F.col("equity")))})
    spell = F.sum((F.col("dd") == 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("spell", spell).withColumn("under", F.sum((F.col("dd") < 0).cast("int")).over(Window.partitionBy(*keys, "spell")))
    excess = F.col("ret") - rate / 252
    ends = df.groupBy(*keys).agg(
        F.min_by("equity", "as_of_date").alias("first"), F.max_by("equity", "as_of_date").alias("final"), F.datediff(F.max("as_of_date"), F.min("as_of_date")).alias("days"),
        F.avg(excess).alias("mean"), F.stddev_samp(excess).alias("dev"), F.stddev_samp(F.when(excess < 0, excess)).alias("down"),
        F.min("dd").alias("max_drawdown"), F.max("under").alias("longest_drawdown"), F.avg("held").alias("exposure"),
    )
    cagr = F.pow(F.col("final") / F.col("first"), F.lit(365.25) / F.col("days")) - 1
    return ends.select(*keys, cagr.alias("cagr"), (F.col("mean") / F.col("dev") * F.sqrt(F.lit(252.0))).alias("sharpe"), (F.col("mean") / F.col("down") * F.sqrt(F.lit(252.0))).alias("sortino"), "max_drawdown", "longest_drawdown", "exposure")


def triple_barrier(bars: DataFrame, stop: Column, target: Column, hold: int = 20) -> DataFrame:
    """bars with label: 1 if the target, 0 if the stop comes first in the next `hold` bars (stop first on one bar), else close above entry at the end.

    Null without later bars, or unless stop < close < target.
    """
    ahead = by_symbol().rowsBetween(1, hold)
    df = bars.withColumns({"__n": F.collect_list(F.struct("high", "low", "close")).over(ahead), "__s": stop, "__t": target})
    hit = F.get(F.filter("__n", lambda b: (b["low"] <= F.col("__s")) | (b["high"] >= F.col("__t"))), F.lit(0))
    end = F.element_at("__n", -1)["close"]
    label = F.when(hit.isNotNull(), F.when(hit["low"] <= F.col("__s"), 0).otherwise(1)).otherwise((end > F.col("close")).cast("int"))
    ready = (F.size("__n") > 0) & (F.col("__s") < F.col("close")) & (F.col("close") < F.col("__t"))
    return df.withColumn("label", F.when(ready, label)).drop("__n", "__s", "__t")


#: What stands for features that can't be computed.
NEUTRAL = {
    "ret5": 0.0, "ret21": 0.0, "ret63": 0.0, "vol5": 0.20, "vol21": 0.20, "vol63": 0.20, "rsi14": 50.0, "rsi2": 50.0, "closeness": 0.85, "atr_pct": 0.02, "signal_score": 0.5,
    "regime_composite": 0.5, "trending_up": 0.0, "trending_down": 0.0, "choppy": 0.0, "transitioning": 0.0, "credit_stress": 0.0,
}


def ml_features(bars: DataFrame, regime: DataFrame) -> DataFrame:
    """bars (with rn, rsi14, rsi2, atr14, signal_score) with the model's inputs, neutral where they can't be computed.

    regime: bar_date, label, composite, credit_stress; the row of a bar's own day is read, none is no regime.
    """
    df = ta.with_missing(bars, [*[f"{c}{n}" for c in ("ret", "vol") for n in (5, 21, 63)], "nearness252"])
    cols = {f"vol{n}": F.when(F.col(f"vol{n}") > 0, F.col(f"vol{n}")) for n in (5, 21, 63)}
    since = lambda n, x: F.when(F.col("rn") >= n, x)
    cols |= {"closeness": since(5, F.col("nearness252")), "atr_pct": since(21, F.col("atr14") / F.col("close")), "rsi14": since(30, F.col("rsi14")), "rsi2": since(5, F.col("rsi2"))}
    days = regime.select("bar_date", F.col("label").alias("__label"), F.col("composite").alias("regime_composite"), F.col("credit_stress").cast("double").alias("credit_stress"))
    df = df.withColumns(cols).drop("nearness252").join(F.broadcast(days), "bar_date", "left")  # one row for each trading day
    df = df.withColumns({x: F.when(F.col("__label").isNotNull(), (F.col("__label") == x).cast("double")) for x in ("trending_up", "trending_down", "choppy", "transitioning")})
    return df.drop("__label").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in NEUTRAL.items()})


def propose(analysis: DataFrame) -> DataFrame:
    """analysis (symbol, move, bucket, to_support, to_resistance, iv, confluences, dte, days_to_earnings, dollar_volume)
    with side, alignment, threat, reject and score of a premium-selling proposal; side is null without a trigger."""
    up, down = F.col("bucket").isin("up", "strong_up"), F.col("bucket").isin("down", "strong_down")
    put = F.col("move") <= -1.5
    call = (F.col("move") >= 1.5) & (F.col("to_resistance") <= 4) & (F.col("bucket") != "strong_up")
    side = F.when(put, "sell_put").when(call, "sell_call")
    align = F.when(put, F.when(up, 1.0).when(down, 0.35).otherwise(0.55)).when(call, F.when(up, 0.45).when(down, 1.0).otherwise(0.7))
    threat = F.when(put, F.col("to_support")).when(call, F.col("to_resistance"))
    reject = F.when(F.col("days_to_earnings") <= F.col("dte") + 2, "earnings_in_expiry").when(F.col("dollar_volume") < 5_000_000, "illiquid").when(F.col("iv").isNull() | (F.col("iv") < 20), "iv_too_low")
    share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    score = 0.30 * share(F.col("iv") / 150) + 0.20 * share(F.coalesce(threat, F.lit(0.0)) / 12) + 0.15 * share(F.col("confluences") / 3) + 0.25 * align + 0.10 * share(F.abs("move") / 5)
    return analysis.withColumns({"side": side, "alignment": align, "threat": threat, "reject": F.when(side.isNotNull(), reject)}).withColumn("score", F.when(F.col("side").isNotNull(), score))


def marked(positions: DataFrame, closes: DataFrame) -> DataFrame:
    """positions (symbol, side, entry, qty, mfe, mae) with mark, open_pnl, pct and the excursions carried on."""
    p = positions.join(closes.select("symbol", F.col("close").alias("mark")), "symbol", "left")
    move = F.when(F.col("side") == "long", F.col("mark") - F.col("entry")).otherwise(F.col("entry") - F.col("mark"))
    pct = 100 * move / F.col("entry")
    return p.withColumns({"open_pnl": move * F.col("qty"), "pct": pct, "mfe": F.greatest(F.coalesce("mfe", F.lit(0.0)), pct), "mae": F.least(F.coalesce("mae", F.lit(0.0)), pct)})


def auto_close(marks: DataFrame) -> DataFrame:
    """marks (side, mark, stop, target, age, max_age, chandelier, day_low) with close_reason and close_price: the first rule that holds."""
    long, m = F.col("side") == "long", F.col("mark")
    stop = F.when(long, m <= F.col("stop")).otherwise(m >= F.col("stop"))
    target = F.when(long, m >= F.col("target")).otherwise(m <= F.col("target"))
    chandelier = F.when(long, m <= F.col("chandelier")).otherwise(m >= F.col("chandelier"))
    reason = F.when(stop, "stop_hit").when(target, "target_hit").when(F.col("age") >= F.col("max_age"), "time_stop").when(chandelier, "chandelier_stop").when(long & (m <= F.col("day_low")), "exit_below_n_day_low")
    price = F.when(reason == "stop_hit", F.col("stop")).when(reason == "target_hit", F.col("target")).otherwise(m)
    return marks.withColumns({"close_reason": reason, "close_price": F.when(reason.isNotNull(), price)})


def ratcheted(df: DataFrame, level: Column, every: int, hold: int) -> DataFrame:
    """symbol, entry_date, bar_date, level, stop of positions: df has stop (null: no signal), each opens on its symbol's next bar.

    Every `every` bars after its own entry, for `hold` bars, the stop rises to the level of that bar; it never falls. A symbol's
    bars are read once, in one grouped map.
    """
    rows = df.select("symbol", "bar_date", F.col("stop").cast("double").alias("stop"), level.cast("double").alias("level"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bar_date").combine_chunks()
        stop, levels, n = table.column("stop").to_numpy(), table.column("level").to_numpy(), table.num_rows
        opened = np.flatnonzero(~np.isnan(stop[:-1]))
        steps = np.arange(every, hold + 1, every)
        at = opened[:, None] + 1 + steps
        there = at < n
        seen = np.where(there, levels[np.minimum(at, n - 1)], np.nan)
        risen = np.fmax(np.fmax.accumulate(seen, axis=1), stop[opened][:, None])
        entry, bar = np.broadcast_to(opened[:, None] + 1, at.shape)[there], at[there]
        symbol, day = table.column("symbol"), table.column("bar_date")
        number = lambda x: pa.array(x[there], from_pandas=True)
        return pa.table({"symbol": symbol.take(pa.array(bar)), "entry_date": day.take(pa.array(entry)), "bar_date": day.take(pa.array(bar)), "level": number(seen), "stop": number(risen)})

    return rows.groupBy("symbol").applyInArrow(run, "symbol string, entry_date date, bar_date date, level double, stop double")
