"""Normal distribution and closed-form option prices as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the normal distribution (double precision), and Acklam's
# approximation of its inverse.
CDF_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
PPF_EDGE = 0.02425


def _horner(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def norm_cdf(x: Column) -> Column:
    """Cumulative normal distribution, absolute error below 1e-14."""
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    tail = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
    upper = F.when(a > 37, 0.0).when(a < 7.07106781186547, e * _horner(a, CDF_TOP) / _horner(a, CDF_BOTTOM)).otherwise(e / tail / 2.506628274631)
    return F.when(x > 0, 1 - upper).otherwise(upper)


def norm_ppf(p: Column) -> Column:
    """Inverse of norm_cdf for p within [1e-12, 1 - 1e-12], relative error about 1e-9."""
    p = F.when(p.isNotNull(), F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p)))
    q = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    side = _horner(q, PPF_C) / _horner(q, PPF_D)
    r = (p - 0.5) * (p - 0.5)
    return F.when(p < PPF_EDGE, side).when(p > 1 - PPF_EDGE, -side).otherwise((p - 0.5) * _horner(r, PPF_A) / _horner(r, PPF_B))


def d1(s: Column, k: Column, t: Column, r: Column, v: Column) -> Column:
    return (F.ln(s / k) + (r + v * v / 2) * t) / (v * F.sqrt(t))


def price(kind: str, s: Column, k: Column, t: Column, r: Column, v: Column) -> Column:
    """Price of a European call or put; null where an input is not positive."""
    a, b = d1(s, k, t, r, v), d1(s, k, t, r, v) - v * F.sqrt(t)
    paid = k * F.exp(-r * t)
    value = s * norm_cdf(a) - paid * norm_cdf(b) if kind == "call" else paid * norm_cdf(-b) - s * norm_cdf(-a)
    return F.when((s > 0) & (k > 0) & (t > 0) & (v > 0), value)


def greeks(kind: str, s: Column, k: Column, t: Column, r: Column, v: Column) -> dict[str, Column]:
    """delta, gamma, theta of a day, vega of a point."""
    a = d1(s, k, t, r, v)
    b = a - v * F.sqrt(t)
    carry = r * k * F.exp(-r * t)
    decay = -s * norm_pdf(a) * v / (2 * F.sqrt(t))
    theta = decay - carry * norm_cdf(b) if kind == "call" else decay + carry * norm_cdf(-b)
    return {"delta": norm_cdf(a) if kind == "call" else norm_cdf(a) - 1, "gamma": norm_pdf(a) / (s * v * F.sqrt(t)), "theta": theta / 365, "vega": s * norm_pdf(a) * F.sqrt(t) / 100}


def strike_for_delta(kind: str, delta: Column, s: Column, t: Column, r: Column, v: Column) -> Column:
    """The strike whose option has the delta (negative for puts)."""
    p = delta if kind == "call" else delta + 1
    return s * F.exp((r + v * v / 2) * t - norm_ppf(p) * v * F.sqrt(t))


# The same in SQL, for the oracle.


def _sql_horner(x: str, coefficients) -> str:
    out = f"{coefficients[0]!r}::double"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::double)"
    return out


def cdf_sql(x: str) -> str:
    a = f"abs({x})"
    tail = f"({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65::double)))))"
    up = f"case when {a} > 37 then 0.0::double when {a} < 7.07106781186547 then exp(-{a} * {a} / 2) * {_sql_horner(a, CDF_TOP)} / {_sql_horner(a, CDF_BOTTOM)} else exp(-{a} * {a} / 2) / {tail} / 2.506628274631::double end"
    return f"(case when {x} > 0 then 1 - ({up}) else {up} end)"


def ppf_sql(p: str) -> str:
    q = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    side = f"({_sql_horner(q, PPF_C)} / {_sql_horner(q, PPF_D)})"
    r = f"(({p} - 0.5::double) * ({p} - 0.5::double))"
    return f"(case when {p} < {PPF_EDGE} then {side} when {p} > {1 - PPF_EDGE} then -{side} else ({p} - 0.5::double) * {_sql_horner(r, PPF_A)} / {_sql_horner(r, PPF_B)} end)"
