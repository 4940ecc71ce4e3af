"""Black-Scholes prices and implied volatilities. Spark has no erf, so the normal distribution is Hart's rational form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hart's double-precision coefficients for the upper normal tail.
UPPER = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
LOWER = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
VOL_LOW, VOL_HIGH, HALVINGS = 1e-6, 8.0, 60


def _poly(coefficients: list[float], x):
    out = coefficients[0] * x + coefficients[1]
    for c in coefficients[2:]:
        out = out * x + c
    return out


def normal_cdf(x: Column) -> Column:
    z = F.abs(x)
    e = F.exp(-z * z / 2)
    near = e * _poly(UPPER, z) / _poly(LOWER, z)
    far = e / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / 2.506628274631
    tail = F.when(z > 37, 0.0).when(z < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def black_scholes(call: Column, s: Column, k: Column, t: Column, r: Column, q: Column, vol: Column) -> Column:
    """The European price with dividend yield; null where an input is not positive."""
    sd = vol * F.sqrt(t)
    d1 = (F.log(s / k) + (r - q + vol * vol / 2) * t) / sd
    d2 = d1 - sd
    spot, strike = s * F.exp(-q * t), k * F.exp(-r * t)
    price = F.when(call, spot * normal_cdf(d1) - strike * normal_cdf(d2)).otherwise(strike * normal_cdf(-d2) - spot * normal_cdf(-d1))
    return F.when((s > 0) & (k > 0) & (t > 0) & (vol > 0), price)


def _cdf(x: np.ndarray) -> np.ndarray:
    z = np.minimum(np.abs(x), 37.5)
    e = np.exp(-z * z / 2)
    far = e / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / 2.506628274631
    tail = np.where(np.abs(x) > 37, 0.0, np.where(z < 7.07106781186547, e * _poly(UPPER, z) / _poly(LOWER, z), far))
    return np.where(x > 0, 1 - tail, tail)


def _price(call, s, k, t, r, q, vol):
    sd = vol * np.sqrt(t)
    d1 = (np.log(s / k) + (r - q + vol * vol / 2) * t) / sd
    spot, strike = s * np.exp(-q * t), k * np.exp(-r * t)
    return np.where(call, spot * _cdf(d1) - strike * _cdf(d1 - sd), strike * _cdf(sd - d1) - spot * _cdf(-d1))


def _solve(call, s, k, t, r, q, price):
    """Bisection of a whole batch; NaN where the bracket has no change of sign."""
    lo, hi = np.full(len(s), VOL_LOW), np.full(len(s), VOL_HIGH)
    bracket = (_price(call, s, k, t, r, q, lo) - price) * (_price(call, s, k, t, r, q, hi) - price) <= 0
    for _ in range(HALVINGS):
        mid = (lo + hi) / 2
        below = _price(call, s, k, t, r, q, mid) < price
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return np.where(bracket & (price > 0), (lo + hi) / 2, np.nan)


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("bid", "mid", "ask")]))
def implied_vols(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """Volatilities at bid, mid and ask of (call, s, k, t, r, q, bid, mid, ask); null inputs give nulls."""
    for call, s, k, t, r, q, bid, mid, ask in batches:
        args = [x.to_numpy(dtype=float, na_value=np.nan) for x in (s, k, t, r, q)]
        with np.errstate(all="ignore"):
            out = {n: _solve(call.to_numpy(dtype=float, na_value=0.0) > 0, *args, x.to_numpy(dtype=float, na_value=np.nan)) for n, x in (("bid", bid), ("mid", mid), ("ask", ask))}
        yield pd.DataFrame({n: pd.Series(v).where(np.isfinite(v), None) for n, v in out.items()})


def implied_vol_folded(call: Column, s: Column, k: Column, t: Column, r: Column, q: Column, price: Column) -> Column:
    """The same root by a fold in SQL expressions, as a check; null without a root."""
    def step(state: Column, _: Column) -> Column:
        mid = (state["lo"] + state["hi"]) / 2
        below = black_scholes(call, s, k, t, r, q, mid) < price
        return F.struct(F.when(below, mid).otherwise(state["lo"]).alias("lo"), F.when(below, state["hi"]).otherwise(mid).alias("hi"))

    ends = [black_scholes(call, s, k, t, r, q, F.lit(v)) - price for v in (VOL_LOW, VOL_HIGH)]
    found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.lit(VOL_LOW).alias("lo"), F.lit(VOL_HIGH).alias("hi")), step, lambda x: (x["lo"] + x["hi"]) / 2)
    return F.when((ends[0] * ends[1] <= 0) & (price > 0), found)


def add_implied_vols(quotes: DataFrame, eligible: Column) -> DataFrame:
    """quotes with iv (struct). Rows that are not eligible send nulls to Python."""
    cols = [F.when(eligible, F.col(c)) for c in ("underlying_price", "strike", "maturity", "risk_free_rate", "dividend_yield", "bid", "mid", "ask")]
    return quotes.withColumn("iv", implied_vols(F.when(eligible, F.col("option_type") == "CALL"), *cols))
