"""Algebra of periodic series (corr_id, replica, t, re, im); t is an ordinal in 0..nt-1 that wraps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .resample import attach


def align_t(df: DataFrame, t0: Column | int, nt: int) -> DataFrame:
    """Times relative to the source: out[t] = in[(t + t0) mod nt]."""
    t0 = F.lit(t0) if isinstance(t0, int) else t0
    return df.withColumn("t", F.pmod(F.col("t") - t0, F.lit(nt)))


def time_reverse(df: DataFrame, t0: int, dt: int, nt: int) -> DataFrame:
    """out[t0 + t] = conj(in[t0 + dt - t]), all times modulo nt."""
    return df.withColumns({"t": F.pmod(F.lit(2 * t0 + dt) - F.col("t"), F.lit(nt)), "im": -F.col("im")})


def negate_star(df: DataFrame, mode: Column | str) -> DataFrame:
    """mode: '' none, '-' negate, '*' conjugate, '-*' both."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    neg, star = mode.contains("-"), mode.contains("*")
    return df.withColumns({"re": F.when(neg, -F.col("re")).otherwise(F.col("re")), "im": F.when(neg != star, -F.col("im")).otherwise(F.col("im"))})


def spread_components(df: DataFrame, columns: tuple[str, str, str] = ("px", "py", "pz")) -> DataFrame:
    """A row for each component of the momentum that is not zero, divided by it."""
    parts = F.array(*[F.struct(F.lit(n).alias("component"), F.col(c).alias("p")) for n, c in zip("XYZ", columns)])
    out = df.withColumn("x", F.explode(F.filter(parts, lambda x: x["p"] != 0))).select("*", "x.component", F.col("x.p").alias("p")).drop("x")
    return out.withColumns({"re": F.col("re") / F.col("p"), "im": F.col("im") / F.col("p")})


def sym_ops(df: DataFrame) -> DataFrame:
    """Rows of unequal sink and source count for the sample in both orders; the pair is named in order."""
    swapped = df.where("snk <> src").withColumns({"snk": F.col("src"), "src": F.col("snk")})
    both = df.unionByName(swapped)
    return both.withColumn("pair", F.concat_ws("_", F.least("snk", "src"), F.greatest("snk", "src")))


def pick(df: DataFrame, part: str) -> DataFrame:
    """The real ('r') or imaginary ('i') part as x."""
    return df.withColumn("x", F.col("im" if part == "i" else "re")).drop("re", "im")


def rps_mul(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Product of (reality real/imag, parity even/odd, sign 1/-1): imag times imag is real and turns the sign."""
    reality = F.when(a[0] == b[0], "real").otherwise("imag")
    parity = F.when(a[1] == b[1], "even").otherwise("odd")
    return reality, parity, a[2] * b[2] * F.when((a[0] == "imag") & (b[0] == "imag"), -1).otherwise(1)


def _mirrored(df: DataFrame, at: Column, by: list[str], value: str = "x") -> DataFrame:
    other = df.select(*by, at.alias("t"), F.col(value).alias("mirror"))
    return df.join(other, [*by, "t"], "left")


def fold(df: DataFrame, nt: int, part: str = "r", odd: bool = False, negative: bool = False, t0_abs: bool = True, by: tuple[str, ...] = ("corr_id", "replica")) -> DataFrame:
    """Mean of forward and backward times, nt // 2 + 1 long (odd parity: nt // 2). Time 0 has neither the half nor the sign; it
    is the absolute value unless t0_abs is false."""
    x = pick(df, part)
    met = _mirrored(x, F.pmod(F.lit(nt) - F.col("t"), F.lit(nt)), list(by))
    half = (-0.5 if negative else 0.5) * (F.col("x") - F.col("mirror") if odd else F.col("x") + F.col("mirror"))
    first = F.abs("x") if t0_abs else F.col("x")
    return met.where(F.col("t") < (nt // 2 if odd else nt // 2 + 1)).select(*by, "t", F.when(F.col("t") == 0, first).otherwise(half).alias("x"))


def fold_raw(df: DataFrame, nt: int, odd: bool = False, preserve_sign: bool = False, by: tuple[str, ...] = ("corr_id",)) -> DataFrame:
    """Folding on import: times 0 < t < nt / 2 are averaged with nt - t, ends stay; if preserve_sign is false the whole sample takes
    the sign that makes its element at nt / 4 positive. Column x."""
    met = _mirrored(df, F.lit(nt) - F.col("t"), list(by))
    mixed = (F.col("x") - F.col("mirror") if odd else F.col("x") + F.col("mirror")) / 2
    out = met.where(F.col("t") <= nt // 2).select(*by, "t", F.when((F.col("t") == 0) | (2 * F.col("t") == nt), F.col("x")).otherwise(mixed).alias("x"))
    if preserve_sign:
        return out
    sign = df.where(F.col("t") == nt // 4).select(*by, F.when(F.col("x") < 0, -1).otherwise(1).alias("sign"))
    return out.join(sign, list(by)).select(*by, "t", (F.col("x") * F.col("sign")).alias("x"))


def wrap_neighbours(df: DataFrame, value: str = "x", by: tuple[str, ...] = ("corr_id", "replica")) -> DataFrame:
    """Adds prev and next, the last row being before the first."""
    w = W.partitionBy(*by).orderBy("t")
    full = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return df.withColumns({"prev": F.coalesce(F.lag(value).over(w), F.last(value).over(full)), "next": F.coalesce(F.lead(value).over(w), F.first(value).over(full))})


def eff_mass(df: DataFrame, nt: int, folded: bool = False, value: str = "x", by: tuple[str, ...] = ("corr_id", "replica")) -> DataFrame:
    """Adds log_mass (NaN at 0, forwards to the middle, backwards after it) and cosh_mass."""
    mid = nt if folded else nt // 2
    x = F.col(value)
    ratio = F.when(F.col("t") <= mid, F.col("prev") / x).otherwise(F.col("next") / x)
    arg = (F.col("prev") + F.col("next")) / (2 * x)
    log_mass = F.when((F.col("t") == 0) | (ratio < 0), F.lit(float("nan"))).otherwise(F.log(ratio))
    return wrap_neighbours(df, value, by).withColumns({"log_mass": log_mass, "cosh_mass": F.when(arg < 1, F.lit(float("nan"))).otherwise(F.acosh(arg))}).drop("prev", "next")


def gap_log_ratio(df: DataFrame, value: str = "x", by: tuple[str, ...] = ("corr_id",)) -> DataFrame:
    """Between consecutive fitted times: the middle time and log(x[prev] / x) over the gap."""
    w = W.partitionBy(*by).orderBy("t")
    before = df.withColumns({"t_prev": F.lag("t").over(w), "x_prev": F.lag(value).over(w)}).where("t_prev IS NOT NULL")
    return before.select(*by, ((F.col("t") + F.col("t_prev")) / 2).alias("t_mid"), (F.log(F.col("x_prev") / F.col(value)) / (F.col("t") - F.col("t_prev"))).alias("log_ratio"))


def symmetrise(df: DataFrame, dt: int, value: str = "x", by: tuple[str, ...] = ("corr_id", "replica")) -> DataFrame:
    """Mean of t and dt - t; dt must be even."""
    if dt % 2:
        raise ValueError("dt must be even")
    met = _mirrored(df.where(F.col("t") <= dt), F.lit(dt) - F.col("t"), list(by), value)
    return met.select(*by, "t", ((F.col(value) + F.col("mirror")) / 2).alias(value))


def complex_divide(a_re: Column, a_im: Column, b_re: Column, b_im: Column) -> tuple[Column, Column]:
    norm = b_re * b_re + b_im * b_im
    return (a_re * b_re + a_im * b_im) / norm, (a_im * b_re - a_re * b_im) / norm


def component_ops(df: DataFrame) -> DataFrame:
    """Adds, for re, im and re2, im2: quotients, squares and relative differences component by component, and the squared modulus."""
    return df.withColumns({
        "div_re": F.col("re") / F.col("re2"), "div_im": F.col("im") / F.col("im2"), "sq_re": F.col("re") * F.col("re"), "sq_im": F.col("im") * F.col("im"),
        "rel_re": rel_diff(F.col("re"), F.col("re2")), "rel_im": rel_diff(F.col("im"), F.col("im2")), "mod_sq": F.col("re") * F.col("re") + F.col("im") * F.col("im"),
    })


def rel_diff(a: Column, b: Column) -> Column:
    """(b - a) / a, 0 if both are equal."""
    return F.when(a == b, 0.0).otherwise((b - a) / a)


def series_summary(raw: DataFrame, nt: int, by: tuple[str, ...] = ("corr_id",)) -> DataFrame:
    """Value, log and cosh mass of a single series, without replicas."""
    return eff_mass(raw, nt, by=by)


def join_checked(a: DataFrame, b: DataFrame, attr_a: DataFrame, attr_b: DataFrame, same: tuple[str, ...] = ("nt", "seed", "sample_size"), on: tuple[str, ...] = ("corr_id", "replica", "t")) -> DataFrame:
    """Inner join on replica and t, so the smaller replica count rules. Attributes that must agree and do not are an error."""
    met = attr_a.select("corr_id", *[F.col(c).alias(f"a_{c}") for c in same]).join(attr_b.select("corr_id", *[F.col(c).alias(f"b_{c}") for c in same]), "corr_id")
    differ = F.lit(False)
    for c in same:
        differ = differ | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    fine = met.select("corr_id", F.when(differ, F.raise_error(F.concat(F.lit("not compatible: "), "corr_id"))).alias("fault")).where("fault IS NULL").select("corr_id")
    return a.join(b, list(on)).join(fine, "corr_id", "left_semi")


def divide(num: DataFrame, den: DataFrame, on: tuple[str, ...] = ("replica", "t"), value: str = "x") -> DataFrame:
    """Every numerator over one denominator, replica by replica. Binned and raw data divide in the same way on their own keys; where
    the denominator lacks a row the numerator's goes."""
    d = den.select(*on, F.col(value).alias("__d"))
    return num.join(d, list(on)).withColumn(value, F.col(value) / F.col("__d")).drop("__d")


def divide_parts(num: dict[str, DataFrame], den: dict[str, DataFrame], value: str = "x", by: tuple[str, ...] = ("corr_id",)) -> dict[str, DataFrame]:
    """divide() for all parts of a sample (replica, binned, raw; each with its row column of that name, bin or row). Binned and raw parts of a
    numerator that have another number of rows than the denominator's are left out whole."""
    rows = {"replica": "replica", "binned": "bin", "raw": "row"}
    out = {}
    for part, df in num.items():
        if part not in den:
            continue
        if part != "replica":
            one = den[part].agg(F.count_distinct(rows[part]).alias("__want"))
            own = attach(df.groupBy(*by).agg(F.count_distinct(rows[part]).alias("__have")), one)
            df = df.join(own.where("__have = __want").select(*by), list(by), "left_semi")
        out[part] = divide(df, den[part], (rows[part], "t"), value)
    return out


def conj_average(df: DataFrame, on: tuple[str, ...] = ("replica", "t"), value: str = "x") -> DataFrame:
    """Half of snk-src and src-snk, for snk < src. Rows of snk = src are an error."""
    checked = df.withColumn("snk", F.when(F.col("snk") == F.col("src"), F.raise_error(F.lit("sink and source are the same"))).otherwise(F.col("snk")))
    a, b = checked.where("snk < src"), checked.where("snk > src")
    other = b.select(F.col("src").alias("snk"), F.col("snk").alias("src"), *on, F.col(value).alias("__o"))
    return a.join(other, ["snk", "src", *on]).withColumn(value, (F.col(value) + F.col("__o")) / 2).drop("__o")


def compare_reversed(a: DataFrame, b: DataFrame, dt: int, negate: bool = False, value: str = "x", by: tuple[str, ...] = ("corr_id",)) -> DataFrame:
    """a[t] and b[dt - t], both divided by a's value at dt / 2; b negated if asked for."""
    scale = a.where(F.col("t") == dt // 2).select(*by, F.col(value).alias("scale"))
    other = b.where(F.col("t") <= dt).select(*by, (F.lit(dt) - F.col("t")).alias("t"), (F.col(value) * (-1 if negate else 1)).alias("reversed"))
    met = a.join(other, [*by, "t"]).join(scale, list(by))
    return met.select(*by, "t", (F.col(value) / F.col("scale")).alias("forward"), (F.col("reversed") / F.col("scale")).alias("reversed"))


def table_diff(a: DataFrame, b: DataFrame, keys: tuple[str, ...], value: str | tuple[str, str] = "x", rtol: float = 0.0, n: int | None = None) -> DataFrame:
    """Rows that only one side has, or whose values differ by more than rtol of a's; with n the first n by key. Two names stand for the
    parts of complex values, which differ by the modulus of their difference: then a and b are structs of both."""
    if not isinstance(value, str):
        pair = lambda df: df.withColumn("__z", F.struct(F.col(value[0]).alias("re"), F.col(value[1]).alias("im"))).select(*keys, "__z")
        met = pair(a).withColumnRenamed("__z", "a").join(pair(b).withColumnRenamed("__z", "b"), list(keys), "full_outer")
        near = F.hypot(F.col("a.re") - F.col("b.re"), F.col("a.im") - F.col("b.im")) <= rtol * F.hypot(F.col("a.re"), F.col("a.im"))
        unlike = met.where(~F.coalesce(near, F.lit(False)))
        return unlike if n is None else unlike.orderBy(*keys).limit(n)
    met = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), list(keys), "full_outer")
    near = (F.col("a") == F.col("b")) | (F.abs(F.col("a") - F.col("b")) <= rtol * F.abs("a"))
    unlike = met.where(~F.coalesce(near, F.lit(False)))
    return unlike if n is None else unlike.orderBy(*keys).limit(n)
