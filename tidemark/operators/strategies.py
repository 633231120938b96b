"""Rule-based strategies over all symbols and dates at once: entry signals, sizing, filters and scans."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ta
from tidemark.functions.windows import before, by_symbol, clip, last
from tidemark.operators import primitives as p

RECURSIVE = ["rsi2", "rsi14", "atr14", "atr20", "atr22", "adx14", "macd", "macd_signal", "volume_median50", "spread_median50"]
#: Columns of long frames that single strategies read, made in the same pass.
FRAMES = ["slope_quality90", "prior20", "prior55", "volume_before19", "high_before20", "low_before20", "squeeze126", "support_3_60", "resistance_3_60", "volume_score_50_150", "close_ago60", "rsi2_prev", "close_prev", "low_last3", "high_last3"]
#: Columns that single plans read: strength against the column level, labels and inputs of models.
OTHERS = ["rs63", *[f"{c}{n}" for c in ("ret", "vol") for n in (5, 21, 63)], "nearness252", "barrier_25_20_20", "reach20"]


def features(bars: DataFrame, names: Iterable[str] = RECURSIVE) -> DataFrame:
    """bars with rn, means, the recursive indicators `names` and what the rules compare: one grouped map by symbol, no window after it."""
    names = [n for n in RECURSIVE + FRAMES + OTHERS if n in set(names)]
    common = [n for n in ("rn", "sma5", "sma50", "sma200") if n not in bars.columns]
    compared = (["hist", "hist_prev"] if "macd_signal" in names else []) + (["rsi14_prev"] if "rsi14" in names else [])
    return ta.with_recursive(bars, [*names, *common, "closeness252", "tr", *compared]).withColumnRenamed("closeness252", "closeness")


@dataclass(frozen=True)
class Strategy:
    """mark: features -> features with a column of the strategy's name, struct(score, stop), null where there is no signal.

    needs: the recursive indicators that mark() and the exits read. Affinity by regime label, 1 for others.
    Exits in the order of `exits`: time (after `hold` bars), rule (a reason, from rule()), hard (the close is
    `hard` ATR(14) under the cost); ratchet: every RATCHET bars the stop rises to 2 ATR(20) under the close.
    """

    name: str
    version: str
    history: int
    mark: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...]
    affinity: dict[str, float] = field(default_factory=dict)
    risk: float = 0.01
    exits: tuple[str, ...] = ()
    hold: int | None = None
    hard: float = 2.5
    rule: Callable[[], Column] | None = None
    ratchet: bool = False

    def signals(self, df: DataFrame) -> DataFrame:
        """features -> rows (symbol, bar_date, close, score, stop)."""
        return self.mark(df).filter(F.col(self.name).isNotNull()).select("symbol", "bar_date", "close", f"{self.name}.*")


#: Bars between two rises of a ratcheted stop.
RATCHET = 14


REGISTRY: dict[str, Strategy] = {}


def register(strategy: Strategy) -> Strategy:
    if strategy.name in REGISTRY:
        raise ValueError(f"strategy {strategy.name} is there already")
    if strategy.history <= 0:
        raise ValueError("a strategy needs a positive history")
    REGISTRY[strategy.name] = strategy
    return strategy


def affinity_for(strategy: Strategy, label: str | None) -> float:
    return strategy.affinity.get(label or "", 1.0)


def _marked(df: DataFrame, name: str, history: int, rule: Column, score: Column, atr: str, times: float) -> DataFrame:
    found = (F.col("rn") >= history) & (F.col(atr) > 0) & rule
    return df.withColumn(name, F.when(found, F.struct(score.alias("score"), (F.col("close") - times * F.col(atr)).alias("stop"))))


def mark_rsi2(df: DataFrame) -> DataFrame:
    """Oversold (RSI(2) below 10) above the 200-bar mean."""
    rsi = F.round("rsi2", 9)
    return _marked(df, "rsi2_meanrev", 220, (F.col("close") > F.col("sma200")) & (rsi < 10), 1 - F.col("rsi2") / 10, "atr14", 2.5)


def mark_largecap(df: DataFrame) -> DataFrame:
    """Large caps (cap_pct >= 80) below the 200-bar mean whose RSI(14) and MACD turn up."""
    hist, rsi = F.round("hist", 9), F.round("rsi14", 9)
    rising = (rsi > F.round("rsi14_prev", 9)) & (hist > 0) & (hist <= 1) & (hist > F.round("hist_prev", 9))
    rule = (F.col("cap_pct") >= 80) & (F.col("close") < F.col("sma200")) & (F.round("adx14", 9) >= 20) & (rsi >= 35) & rising
    below = (F.col("sma200") - F.col("close")) / F.col("sma200")
    score = F.least(F.lit(1.0), 0.6 * F.least(F.lit(1.0), below * 5) + 0.4 * (F.col("rsi14") - 35) / 65)
    return _marked(df, "largecap_rebound", 283, rule, score, "atr14", 2.5)


def mark_momentum(df: DataFrame) -> DataFrame:
    """Close within 5% of its 252-bar high, by closeness and slope quality."""
    df = ta.with_missing(df, ["slope_quality90"])
    score = 0.7 * F.col("closeness") + 0.3 * F.col("slope_quality90")
    return _marked(df, "momentum_52w_high", 257, F.col("closeness") >= 0.95, score, "atr20", 2.0)


def mark_donchian(df: DataFrame) -> DataFrame:
    """Breakouts above the closes of 55 or 20 bars from a narrow base, in an uptrend, on volume.

    df has market_ret60, the benchmark's 60-bar return on the day (null: not asked).
    """
    df = ta.with_missing(df, ["prior20", "prior55", "volume_before19", "high_before20", "low_before20", "squeeze126", "close_ago60"])
    top = F.when(F.col("close") > F.col("prior55"), F.col("prior55")).when(F.col("close") > F.col("prior20"), F.col("prior20"))
    hi, lo = F.col("high_before20"), F.col("low_before20")
    rule = (
        top.isNotNull()
        & (F.col("close") > F.col("sma200")) & (F.col("sma50") > F.col("sma200"))
        & (F.col("volume") >= 1.5 * F.col("volume_before19"))
        & (F.round("tr", 9) >= F.round("atr14", 9))
        & ((hi - lo) / ((hi + lo) / 2) <= 0.15)
        & (F.col("squeeze126") <= 0.30)
        & (F.col("close") <= 1.15 * F.col("sma50"))
        & (F.round("rsi14_prev", 9) < 65)
        & (F.col("market_ret60").isNull() | (F.round(F.col("close") / F.col("close_ago60") - 1, 9) > F.round("market_ret60", 9)))
    )
    df = df.withColumn("__rule", rule).withColumn("__top", top)
    return _marked(df, "donchian_trend", 215, F.col("__rule"), F.least(F.lit(1.0), (F.col("close") - F.col("__top")) / F.col("atr20")), "atr20", 2.0)


def reversal_scores(df: DataFrame) -> DataFrame:
    """df (features with rs_raw) with the confluence score of a bottom; null where a gate fails."""
    df = p.trend_location(p.volume_confirm(p.pivot_proximity(p.reversal_trigger(df))))
    parts = {"reversal_raw": 0.35, "pivot_raw": 0.30, "rs_raw": 0.20}
    total = sum((F.coalesce(w * F.col(c), F.lit(0.0)) for c, w in parts.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    gate = (F.col("reversal_raw") > 0) & (F.round("pivot_raw", 9) > 0) & (F.col("rs_raw").isNull() | (F.col("rs_raw") >= -0.5))
    return df.withColumn("reversal_score", F.when(gate, clip(total / weight * F.coalesce("volume_multiplier", F.lit(1.0)))))


def mark_reversal(df: DataFrame) -> DataFrame:
    df = reversal_scores(df)
    return _marked(df, "reversal_swing", 230, F.round("reversal_score", 9) >= 0.25, F.col("reversal_score"), "atr14", 2.5)


def _mean_reverted() -> Column:
    return F.when(F.col("close") > F.col("sma5"), "mean_reverted_above_sma5")


def _rolled_over() -> Column:
    return F.when(F.round("hist", 9) <= 0, "macd_below_zero")


def _left_channel() -> Column:
    chandelier = F.round(F.col("close") - (F.max("high").over(last(22)) - 3 * F.col("atr22")), 9) <= 0
    return F.when(F.col("close") < F.min("low").over(before(10)), "exit_below_n_day_low").when(chandelier, "chandelier_stop")


#: How much of a position each strategy takes in each regime, risks, and bars until the time stop.
register(Strategy("rsi2_meanrev", "1.0.0", 220, mark_rsi2, ("rsi2", "atr14"), {"trending_up": 1.0, "trending_down": 0.0, "choppy": 1.0, "transitioning": 0.7}, exits=("time", "rule", "hard"), hold=10, rule=_mean_reverted))
register(Strategy("largecap_rebound", "1.0.0", 283, mark_largecap, ("rsi14", "adx14", "macd", "macd_signal", "atr14"), {"trending_up": 1.0, "trending_down": 0.0, "choppy": 0.4, "transitioning": 0.7}, exits=("hard", "rule"), rule=_rolled_over))
register(Strategy("momentum_52w_high", "1.0.0", 257, mark_momentum, ("atr20", "slope_quality90"), {"trending_up": 1.0, "trending_down": 0.0, "choppy": 0.4, "transitioning": 0.7}, 0.0075, ratchet=True))
register(Strategy("donchian_trend", "1.3.0", 215, mark_donchian, ("rsi14", "atr14", "atr20", "atr22", "prior20", "prior55", "volume_before19", "high_before20", "low_before20", "squeeze126", "close_ago60"), {"trending_up": 1.0, "trending_down": 1.0, "choppy": 0.25, "transitioning": 0.5}, 0.0075, exits=("rule",), rule=_left_channel, ratchet=True))
register(Strategy("reversal_swing", "1.5.0", 230, mark_reversal, ("rsi2", "atr14", "volume_score_50_150", "support_3_60", "resistance_3_60", "rsi2_prev", "close_prev", "low_last3", "high_last3"), {"trending_up": 1.0, "trending_down": 0.5, "choppy": 1.0, "transitioning": 0.7}, exits=("time", "hard"), hold=30))


def previous_breakout(df: DataFrame, n: int = 20, exit_n: int = 10, hold: int = 60) -> DataFrame:
    """df (features) with turtle: outcome at the row of the latest earlier breakout of n bars: winner, loser or none.

    A breakout's first stop or exit within `hold` bars is found once; a row looks at it only if it came by then.
    """
    broke = F.when((F.count("close").over(before(n)) == n) & (F.col("close") > F.max("close").over(before(n))) & (F.col("rn") > n + 1), F.col("rn"))
    left = F.col("close") < F.min("low").over(before(exit_n))
    df = df.withColumns({"__b": broke, "__left": left})
    ahead = by_symbol().rowsBetween(1, hold)
    df = df.withColumn("__next", F.when(F.col("__b").isNotNull(), F.collect_list(F.struct("rn", "low", "close", "__left")).over(ahead)))
    level = F.col("close") - 2.0 * F.col("atr20")
    event = F.get(F.filter("__next", lambda x: (x["low"] <= level) | x["__left"]), F.lit(0))
    told = F.struct(F.col("rn").alias("b"), F.col("close").alias("entry"), F.col("atr20").alias("atr"), event["rn"].alias("at"), ((event["low"] > level) & (event["close"] > F.col("close"))).alias("won"), F.get(F.col("__next"), F.lit(hold - 1))["close"].alias("end"))
    df = df.withColumn("__told", F.when(F.col("__b").isNotNull(), told))
    seen = F.last("__told", ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__o", seen)
    o = F.col("__o")
    marked = F.when(o["at"] <= F.col("rn"), o["won"]).otherwise(F.when(F.col("rn") > o["b"] + hold, o["end"]).otherwise(F.col("close")) > o["entry"])
    known = o.isNotNull() & (o["atr"] > 0)
    return df.withColumn("turtle", F.when(~F.coalesce(known, F.lit(False)), "none").when(F.coalesce(marked, F.when(F.col("rn") > o["b"] + hold, o["end"]).otherwise(F.col("close")) > o["entry"]), "winner").otherwise("loser")).drop("__b", "__left", "__next", "__told", "__o")


def position_size(entry: Column, stop: Column, equity: float = 1_000_000.0, risk: float = 0.01, most: float = 0.08) -> dict[str, Column]:
    """qty (long) and reason of a long entry; prices count in ten-thousandths, so all divisions are exact.

    qty = floor(round(equity * risk, 2) / (entry - stop)), at most floor(equity * most / entry).
    """
    ticks = lambda x: F.round(x * 10000).cast("long")
    e, s = ticks(entry), ticks(stop)
    cents = F.bround(F.lit(equity * risk).cast("decimal(20,4)"), 2).cast("decimal(20,2)") * 100
    by_risk = F.floor(cents.cast("long") * 100 / F.when(e > s, e - s)).cast("long")
    by_size = F.floor(F.lit(round(equity * most * 10000)).cast("long") / F.when(e > 0, e)).cast("long")
    qty = F.greatest(F.least(by_risk, by_size), F.lit(0).cast("long"))
    reason = F.when(e <= 0, "invalid_entry_price").when(s >= e, "stop_above_entry").when(F.lit(risk <= 0), "invalid_risk_pct").when(F.lit(equity <= 0), "no_equity").when(qty <= 0, "qty_zero")
    return {"qty": F.when(reason.isNull(), qty).otherwise(F.lit(0).cast("long")), "size_reason": reason}


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that fails; null where none does. Unknown values pass."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), name) for bad, name in checks])


def filter_chain(equity: Column, peak: Column, held: Column, to_earnings: Column, positions: Column, notional: Column, sector_notional: Column, adv: Column) -> Column:
    """Portfolio filters in their order; thresholds are the risk defaults."""
    return first_reason(
        ((peak - equity) / peak > 0.15, "drawdown"),
        (held, "already_held"),
        ((to_earnings >= 0) & (to_earnings <= 7), "earnings"),
        (positions >= 15, "max_positions"),
        (notional / equity > 0.08, "position_size"),
        ((sector_notional + notional) / equity > 0.25, "sector"),
        (notional / adv > 0.05, "liquidity"),
    )


def scan(signals: DataFrame, earnings: DataFrame, regime: DataFrame) -> DataFrame:
    """strategy, symbol, bar_date, score, entry, stop, qty, status, reason, place for every signal of every date.

    signals: strategy, symbol, bar_date, close, score, stop. earnings: symbol, report_date. regime: bar_date,
    label, composite, credit_stress (missing dates: full size). Rejections in order: sizing, long block under
    credit stress, zero size in the regime, earnings within 7 days. place ranks the passed signals of a
    strategy and date by score, ties by symbol.
    """
    s = signals.select("strategy", "symbol", "bar_date", "score", F.round("close", 4).alias("entry"), F.round("stop", 4).alias("stop"))
    of = lambda value, other: F.coalesce(*[F.when(F.col("strategy") == x.name, value(x)) for x in REGISTRY.values()], other)
    sized = [position_size(F.col("entry"), F.col("stop"), risk=r) for r in sorted({x.risk for x in REGISTRY.values()})]
    by_risk = dict(zip(sorted({x.risk for x in REGISTRY.values()}), sized))
    s = s.withColumns({c: of(lambda x, c=c: by_risk[x.risk][c], F.lit(None)) for c in ("qty", "size_reason")})
    affinity = of(lambda x: F.coalesce(*[F.when(F.col("label") == k, v) for k, v in sorted(x.affinity.items())], F.lit(1.0)), F.lit(1.0))
    s = s.join(F.broadcast(regime), "bar_date", "left")  # one row for each trading day
    stress = F.coalesce("credit_stress", F.lit(False))
    scaled = F.bround(F.col("qty") * affinity * F.coalesce(0.5 + 0.5 * F.col("composite"), F.lit(1.0)) * F.when(stress, 0.5).otherwise(1.0), 0).cast("long")
    s = s.withColumn("qty", scaled)
    soon = earnings.select("symbol", F.explode(F.sequence(F.date_sub("report_date", 7), "report_date")).alias("bar_date")).distinct().withColumn("soon", F.lit(True))
    s = s.join(soon, ["symbol", "bar_date"], "left")
    reason = F.coalesce("size_reason", first_reason((stress, "credit_stress_long_block"), (F.col("qty") <= 0, "regime_zero_size"), (F.col("soon"), "earnings")))
    s = s.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "new").otherwise("rejected"))
    rank = F.row_number().over(Window.partitionBy("strategy", "bar_date", "status").orderBy(F.desc_nulls_last(F.round("score", 9)), "symbol"))
    return s.withColumn("place", F.when(F.col("status") == "new", rank)).select("strategy", "symbol", "bar_date", "score", "entry", "stop", "qty", "status", "reason", "place")
