"""Statistical functions: value(error) text, bounds, q-values, chiral and finite-volume terms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def scale_ve(v: Column, k: Column) -> Column:
    """min, low, central, high, max, check times k; a negative factor swaps the bounds."""
    pick = lambda a, b: F.when(k < 0, v[b] * k).otherwise(v[a] * k)
    return F.struct(pick("min", "max").alias("min"), pick("low", "high").alias("low"), (v["central"] * k).alias("central"), pick("high", "low").alias("high"), pick("max", "min").alias("max"), v["check"].alias("check"))


def fmt_val_err(central: Column, low: Column, high: Column, digits: int = 2) -> Column:
    """Value and error in its last digits, as 0.1234(56). The error is half the width. Beyond 10**6 or below 10**-4, as (1.234(56))e7. A
    central value outside the bounds has the error marked by a minus. Without a finite error the value has 2 * digits + 1 digits."""
    error = (high - low) / 2
    exponent = F.floor(F.log10(F.abs(error))).cast("int")
    carry = F.abs(error) + 0.5 * F.pow(F.lit(10.0), exponent - (digits - 1)) >= F.pow(F.lit(10.0), exponent + 1)
    exponent = exponent + F.when(carry, 1).otherwise(0)
    top = F.when(central == 0, exponent).otherwise(F.greatest(F.floor(F.log10(F.abs(central))).cast("int"), exponent))
    wide = (top >= 6) | (top < -4)
    shift = F.when(wide, top).otherwise(0)
    places = F.greatest(F.lit(0), digits - 1 - exponent + shift)
    number = _fixed(central / F.pow(F.lit(10.0), shift), places)
    unit = F.pow(F.lit(10.0), F.when(places > 0, exponent - (digits - 1)).otherwise(0))
    shown = F.round(error / unit).cast("long").cast("string")
    mark = F.when((central < low) | (central > high), "-").otherwise("")
    text = F.concat(number, F.lit("("), mark, shown, F.lit(")"))
    text = F.when(wide, F.concat(F.lit("("), text, F.lit(")e"), shift.cast("string"))).otherwise(text)
    plain = F.format_string(f"%.{2 * digits}e", central)
    return F.when(F.isnan(error) | (error == 0) | (F.abs(error) == float("inf")), plain).otherwise(text)


def _fixed(x: Column, places: Column) -> Column:
    """x with a number of decimal places that differs from row to row (up to 17)."""
    out = F.format_string("%.0f", x)
    for k in range(1, 18):
        out = F.when(places == k, F.format_string(f"%.{k}f", x)).otherwise(out)
    return out


def chi_square_tail(x: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Upper tail of chi-square: a finite sum for each degree of freedom. dof 0 or less gives 1."""
    x, dof = np.maximum(np.asarray(x, dtype=float), 0), np.asarray(dof, dtype=int)
    odd = dof % 2 == 1
    half = x / 2
    total = np.where(odd, np.array([math.erfc(v) for v in np.sqrt(half)]), np.exp(-half))
    with np.errstate(divide="ignore", invalid="ignore"):
        log_half = np.log(half)
        for k in range(1, int(dof.max(initial=0)) // 2 + 1):
            for is_odd, power in ((False, float(k)), (True, k - 0.5)):
                add = np.where(half > 0, np.exp(power * log_half - half - math.lgamma(power + 1)), 0.0)
                total = total + np.where((odd == is_odd) & (power < dof / 2), add, 0.0)
    return np.where(dof <= 0, 1.0, np.minimum(total, 1.0))


@F.pandas_udf(DoubleType())
def q_chisq(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(chi_square_tail(x.to_numpy(), dof.to_numpy()), index=x.index)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for x > 0: Stirling's series from 16 on, below by its recurrence."""
    x = np.array(x, dtype=float)
    shift = np.zeros_like(x)
    for _ in range(16):
        low = x < 16
        shift = np.where(low, shift + np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1, x)
    z = 1 / (x * x)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


def beta_tail(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by a continued fraction evaluated from below, all at once."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (x, a, b)))
    turned = x > (a + 1) / (a + b + 2)
    p, q = np.where(turned, b, a), np.where(turned, a, b)
    inside = (x > 0) & (x < 1)
    z = np.where(inside, np.where(turned, 1 - x, x), 0.5)
    value = np.zeros(z.shape)
    for m in range(300, 0, -1):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        value = even / (1 + odd / (1 + value))
    first = -(p + q) * z / (p + 1)
    tail = np.exp(p * np.log(z) + q * np.log1p(-z) + log_gamma(p + q) - log_gamma(p) - log_gamma(q)) / p / (1 + first / (1 + value))
    return np.where(inside, np.where(turned, 1 - tail, tail), (x >= 1).astype(float))


def hotelling_tail(t2: np.ndarray, p: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Upper tail of Hotelling's T-squared of p dimensions and m degrees of freedom; chi-square where it is not defined (p > m)."""
    t2, p, m = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (t2, p, m)))
    usable = (p > 0) & (p <= m)
    k, n = np.where(usable, p, 1.0), np.where(usable, m, 1.0)
    d2 = n - k + 1
    f = t2 * d2 / (k * n)
    return np.where(p <= 0, 1.0, np.where(usable, beta_tail(d2 / (d2 + k * f), d2 / 2, k / 2), chi_square_tail(np.atleast_1d(t2), np.atleast_1d(p)).reshape(t2.shape)))


@F.pandas_udf(DoubleType())
def q_hotelling(t2: pd.Series, p: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series(hotelling_tail(t2.to_numpy(), p.to_numpy(), m.to_numpy()), index=t2.index)


def q_chisq_ve(v: Column, dof: Column) -> Column:
    """q-value of a chi-square with bounds, which swap."""
    q = {c: q_chisq(v[c], dof) for c in ("min", "low", "central", "high", "max")}
    return F.struct(q["max"].alias("min"), q["high"].alias("low"), q["central"].alias("central"), q["low"].alias("high"), q["min"].alias("max"), v["check"].alias("check"))


def chiral_log(m: Column, scale: float) -> Column:
    return 2 * m * m * F.log(F.abs(m / scale))


def bessel_k1(x: np.ndarray) -> np.ndarray:
    """K1 by the trapezoidal rule on its integral of exp(-x cosh u) cosh u, which converges geometrically."""
    x = np.asarray(x, dtype=float)
    top = np.arccosh(1 + 750 / np.maximum(x, 1e-3))
    u = np.linspace(0, 1, 401)[:, None] * top[None, :]
    y = np.exp(-x * np.cosh(u)) * np.cosh(u)
    return (y.sum(axis=0) - 0.5 * (y[0] + y[-1])) * top / 400


@F.pandas_udf(DoubleType())
def k1(x: pd.Series) -> pd.Series:
    return pd.Series(bessel_k1(x.to_numpy()), index=x.index)


def finite_volume(df, m: str, length: str, sites: int, key: list[str]):
    """Adds fv: 4 m / L times the sum of K1(n m L) / n over the lattice points of the half cube, weighted for its symmetry. Points of
    one square of n are summed first: one row for each square, some (sites / 2)**2 of them."""
    from corvane.operators.resample import attach

    half = sites // 2
    axis = F.explode(F.sequence(F.lit(0), F.lit(half)))
    weight = lambda c: F.when((F.col(c) == 0) | (F.col(c) == half), 1).otherwise(2)
    spark = df.sparkSession
    points = spark.range(1).select(axis.alias("x")).select("x", axis.alias("y")).select("x", "y", axis.alias("z"))
    n2 = (F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")).alias("n2")
    squares = points.select(n2, (weight("x") * weight("y") * weight("z")).alias("w")).where("n2 > 0").groupBy("n2").agg(F.sum("w").alias("w"))
    table = squares.agg(F.array_sort(F.collect_list(F.struct("n2", "w"))).alias("lattice"))
    spread = attach(df, table).select("*", F.explode("lattice").alias("s")).drop("lattice")
    n = F.sqrt(F.col("s.n2").cast("double"))
    summed = spread.groupBy(*key).agg(F.sum(k1(n * F.col(m) * F.col(length)) / n * F.col("s.w")).alias("__s"))
    return df.join(summed, key).withColumn("fv", 4 * F.col(m) / F.col(length) * F.col("__s")).drop("__s")


def average_vs(v1: Column, s1: Column, v2: Column, s2: Column, w1: int = 1, w2: int = 1) -> tuple[Column, Column]:
    """Weighted mean of two values; equal errors stay with equal weights, else relative errors are added in quadrature."""
    n = float(w1 + w2)
    value = (w1 * v1 + w2 * v2) / n
    if w1 == w2:
        rel = F.sqrt(F.pow(s1 / v1, 2) + F.pow(s2 / v2, 2))
        return value, F.when(s1 == s2, s1).otherwise(rel * value)
    return value, F.sqrt((w1 * F.pow(s1 / v1, 2) + w2 * F.pow(s2 / v2, 2)) / n) * value


def z_mixed(z0: Column, z1: Column, z2: Column, r0: Column, r1: Column, r2: Column) -> tuple[Column, Column]:
    """z2 / sqrt(z0 z1) and its error from relative errors added as r2 + (r0 + r1) / 4 in squares."""
    value = z2 / F.sqrt(z0 * z1)
    return value, value * F.sqrt(r2 * r2 + 0.25 * (r0 * r0 + r1 * r1))
