"""SQL texts that several oracles share."""

from __future__ import annotations

from tidemark.sources.driver import with_views

#: Bars with their number, previous values, and the inputs of Wilder's means.
NUMBERED = """
n0 as materialized (
  select *, row_number() over w as rn, lag(close) over w as pc, lag(high) over w as ph, lag(low) over w as pl from bars window w as (partition by symbol order by bar_date)),
n as materialized (
  select *, greatest(high - low, abs(high - pc), abs(low - pc)) as tr,
         case when pc is not null then greatest(close - pc, 0) end as gain, case when pc is not null then greatest(pc - close, 0) end as loss,
         case when high - ph > pl - low and high - ph > 0 then high - ph else 0 end as pdm,
         case when pl - low > high - ph and pl - low > 0 then pl - low else 0 end as mdm from n0)"""


def wilder(name: str, n: int, columns: dict[str, str], src: str = "n") -> str:
    """CTE `name`: symbol, rn and each column's Wilder mean over n rows."""
    means = ", ".join(f"avg({x}) as {c}" for c, x in columns.items())
    steps = ", ".join(f"w.{c} + (b.{x} - w.{c}) / {n}" for c, x in columns.items())
    inputs = ", ".join(dict.fromkeys(columns.values()))
    return f"""{name} as (
      select symbol, cast({n} as bigint) as rn, {means} from {src} where rn <= {n} group by symbol having count(*) = {n}
      union all
      select b.symbol, b.rn, {steps} from {name} w join (select symbol, rn, {inputs} from {src}) b on b.symbol = w.symbol and b.rn = w.rn + 1)"""


def ema(name: str, spans: dict[str, int], x: str = "close", src: str = "n", start: int = 1) -> str:
    """CTE `name`: symbol, rn and exponential means of x that start at row `start` (shown from the first row)."""
    first = ", ".join(f"cast({x} as double) as {c}" for c in spans)
    steps = ", ".join(f"e.{c} + (b.{x} - e.{c}) * 2.0::double / {s + 1}" for c, s in spans.items())
    return f"""{name} as (
      select symbol, rn, {first} from {src} where rn = {start}
      union all
      select b.symbol, b.rn, {steps} from {name} e join (select symbol, rn, {x} from {src}) b on b.symbol = e.symbol and b.rn = e.rn + 1)"""


def rsi(gain: str, loss: str) -> str:
    return f"case when {gain} is null then null when {loss} > 0 then case when {gain} > 0 then 100 - 100 / (1 + {gain} / {loss}) else 0 end else 100 end"


#: View `tech`: bars with rn, rsi2, rsi14, atr14, atr20, atr22, adx14, ema9, ema12, ema26, ema50, ema200, macd, macd_signal.
TECH = ",".join([
    NUMBERED,
    wilder("w2", 2, {"g2": "gain", "l2": "loss"}),
    wilder("w14", 14, {"g14": "gain", "l14": "loss", "a14": "tr", "p14": "pdm", "m14": "mdm"}),
    wilder("w20", 20, {"a20": "tr"}),
    wilder("w22", 22, {"a22": "tr"}),
    """dx as materialized (
      select n.symbol, n.rn, case when w.a14 > 0 and w.p14 + w.m14 > 0 then 100 * abs(w.p14 - w.m14) / (w.p14 + w.m14) else 0 end as dx
      from n left join w14 w on n.symbol = w.symbol and n.rn = w.rn)""",
    wilder("wx", 14, {"adx": "dx"}, "dx"),
    ema("em", {"e9": 9, "e12": 12, "e26": 26, "e50": 50, "e200": 200}),
    "ml as materialized (select symbol, rn, e12 - e26 as line from em where rn >= 26)",
    ema("ms", {"sig": 9}, "line", "ml", 26),
    f"""tech as materialized (
      select n.*, {rsi('w2.g2', 'w2.l2')} as rsi2, {rsi('w14.g14', 'w14.l14')} as rsi14, w14.a14 as atr14, w20.a20 as atr20, w22.a22 as atr22, wx.adx as adx14,
             case when n.rn >= 9 then em.e9 end as ema9, case when n.rn >= 12 then em.e12 end as ema12, case when n.rn >= 26 then em.e26 end as ema26,
             case when n.rn >= 50 then em.e50 end as ema50, case when n.rn >= 200 then em.e200 end as ema200, ml.line as macd, case when n.rn >= 34 then ms.sig end as macd_signal
      from n left join w2 using (symbol, rn) left join w14 using (symbol, rn) left join w20 using (symbol, rn) left join w22 using (symbol, rn) left join wx using (symbol, rn)
             left join em using (symbol, rn) left join ml using (symbol, rn) left join ms using (symbol, rn))""",
])


def with_bars(*more: str) -> str:
    """WITH clause of bars, numbered, and further views."""
    return with_views("bars", *more) + "," + NUMBERED


def with_tech(*more: str) -> str:
    return with_views("bars", *more) + "," + TECH
