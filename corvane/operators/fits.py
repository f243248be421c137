"""Models as column expressions, linear and non-linear fits as one Spark job over (fit, replica), and what is made from fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .joint import CHUNK, fit_joint
from .resample import attach

# Models. Energies, amplitudes and matrix elements are lists of columns, one for each level.


def m_exp(t: Column, energy: list[Column], a_src: list[Column], a_snk: list[Column] | None = None, normalised: bool = False) -> Column:
    """Sum of A A exp(-E t) / 2E (without 2E if normalised)."""
    return _levels(energy, a_src, a_snk, normalised, lambda e: F.exp(-e * t))


def m_cosh(t: Column, energy: list[Column], a_src: list[Column], nt: int, a_snk: list[Column] | None = None, normalised: bool = False) -> Column:
    return _levels(energy, a_src, a_snk, normalised, lambda e: F.exp(-e * t) + F.exp(-e * (nt - t)))


def m_sinh(t: Column, energy: list[Column], a_src: list[Column], nt: int, a_snk: list[Column] | None = None, normalised: bool = False) -> Column:
    return _levels(energy, a_src, a_snk, normalised, lambda e: F.exp(-e * t) - F.exp(-e * (nt - t)))


def _levels(energy, a_src, a_snk, normalised, wave) -> Column:
    total = F.lit(0.0)
    for e, a, b in zip(energy, a_src, a_snk or a_src, strict=True):
        total = total + a * b * wave(e) / (F.lit(1.0) if normalised else 2 * e)
    return total


def m_3pt(t: Column, dt: int, e_src: list[Column], e_snk: list[Column], a_src: list[Column], a_snk: list[Column], mel: list[list[Column]], all_levels: bool = False) -> Column:
    """Sum over sink and source levels of A A M exp(-E_snk (dt - t) - E_src t) / (4 E E). Two excited levels together only if
    all_levels. mel[snk][src]."""
    total = F.lit(0.0)
    for k, (ek, ak) in enumerate(zip(e_snk, a_snk)):
        for s, (es, a) in enumerate(zip(e_src, a_src)):
            if not k or not s or all_levels:
                total = total + ak * a * mel[k][s] * F.exp(-ek * (dt - t) - es * t) / (4 * ek * es)
    return total


def m_r3(c3: Column, c2_src: Column, c2_snk_reversed: Column, z_src: Column | None = None, z_snk: Column | None = None) -> Column:
    """C3(t) / (C2(t) C2(dt - t)), times the overlaps unless raw."""
    ratio = c3 / (c2_src * c2_snk_reversed)
    return ratio if z_src is None else ratio * z_src * z_snk


def m_zv(c2_dt: Column, c3: Column) -> Column:
    return c2_dt / c3


def m_const(k: Column) -> Column:
    return k


def m_misc(t: Column, a: Column, b: Column, c: Column) -> Column:
    return a * (1 + b * F.exp(-c * t))


def m_continuum(el: Column, a_inv: Column, delta: Column, lam: float, c0: Column, chi_fv: Column, c1: Column, d_mpi: Column, e: list[Column], d: list[Column]) -> Column:
    """lam / (el + delta) times chiral, mass, energy and discretisation terms."""
    inner = c0 * (1 + chi_fv) + c1 * d_mpi
    for k, x in enumerate(e, 1):
        inner = inner + x * F.pow(el / lam, F.lit(float(k)))
    for k, x in enumerate(d, 1):
        inner = inner + x * F.pow(lam / a_inv, F.lit(2.0 * k))
    return lam / (el + delta) * inner


def default_model(name: Column, parity: Column) -> Column:
    """By the parts of a name, else by parity."""
    low = F.lower(name)
    return F.when(low.rlike(r"(^|_)r3"), "R3").when(low.rlike(r"(^|_)zv"), "ZV").when(low.rlike(r"(^|_)3pt"), "ThreePoint").when(parity == "even", "Cosh").when(parity == "odd", "Sinh").otherwise("Exp")


def guess(points: DataFrame, value: str = "x", by: tuple[str, ...] = ("corr_id",)) -> DataFrame:
    """First guess of one level: energy from the last two points, amplitude so that the last point is met; and the mean."""
    w = W.partitionBy(*by).orderBy("t")
    pairs = points.withColumns({"__t": F.lag("t").over(w), "__x": F.lag(value).over(w)})
    last = F.max_by(F.struct("t", F.col(value).alias("x"), "__t", "__x"), "t")
    g = pairs.groupBy(*by).agg(last.alias("p"), F.avg(value).alias("mean"))
    energy = F.log(F.abs(F.col("p.__x") / F.col("p.x"))) / (F.col("p.t") - F.col("p.__t"))
    out = g.withColumn("energy", energy)
    return out.select(*by, "energy", F.sqrt(F.abs(2 * F.col("energy") * F.col("p.x") * F.exp(F.col("energy") * F.col("p.t")))).alias("amplitude"), "mean")


def guess_levels(points: DataFrame, levels: int, value: str = "x", by: tuple[str, ...] = ("corr_id",), sweeps: int = 60) -> DataFrame:
    """First guess of several levels by peeling: by, energies and amplitudes (arrays, lowest first), left (largest residual relative to the
    data). The lowest level comes from the last two points; with it taken off, the next from two points further in front, where it
    stands out most, and so on; then each is taken again from what the others leave, until nothing moves. Amplitudes come from the residual
    at the later point of a pair. A level that what is left does not show (two values of unlike sign) ends the list. Models divide by 2 E."""
    types = dict(points.dtypes)
    packed = points.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("t").cast("double").alias("t"), F.col(value).cast("double").alias("x")))).alias("p"))
    fields = ", ".join(f"`{c}` {types[c]}" for c in by)
    schema = points.sparkSession.createDataFrame([], fields + ", energies array<double>, amplitudes array<double>, left double").schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in by], *_peel_lists(batch.column("t"), batch.column("x"), levels, sweeps)], schema=arrow)

    return packed.select(*by, F.col("p.t").alias("t"), F.col("p.x").alias("x")).mapInArrow(run, schema)


def _peel_lists(t: pa.ListArray, x: pa.ListArray, levels: int, sweeps: int) -> list[pa.Array]:
    """_peel() of the series of a batch, those of one length at once."""
    n, first = t.value_lengths().to_numpy(), t.offsets.to_numpy()[:-1] - t.offsets[0].as_py()
    t, x = (v.flatten().to_numpy(zero_copy_only=False) for v in (t, x))
    energy, weight, found, left = np.zeros((len(n), levels)), np.zeros((len(n), levels)), np.zeros(len(n), dtype=int), np.full(len(n), np.nan)
    for size in np.unique(n[n >= 2 * levels]):
        rows = np.flatnonzero(n == size)
        at = first[rows, None] + np.arange(size)
        whole = np.isfinite(x[at]).all(axis=1)
        rows, at = rows[whole], at[whole]
        energy[rows], weight[rows], found[rows], left[rows] = _peel(t[at], x[at], levels, sweeps)
    shown, ends = np.arange(levels) < found[:, None], np.concatenate([[0], np.cumsum(found)]).astype(np.int32)
    with np.errstate(all="ignore"):
        lists = [pa.ListArray.from_arrays(ends, v[shown]) for v in (energy, np.sqrt(np.abs(2 * energy * weight)))]
    return [*lists, pa.array(left)]


def _peel(t: np.ndarray, x: np.ndarray, levels: int, sweeps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Series as rows: energies and weights (lowest first, zeros behind those found), how many are found, the largest residual. A series
    leaves the sweeps once it no longer moves."""
    rows, n = t.shape
    # pairs of points: the last two for the lowest level, the first two for the highest, between them geometrically
    at = [n - 2] + [int(round((n - 2) * (1 / (n - 2)) ** (k / (levels - 1)))) if k < levels - 1 else 0 for k in range(1, levels)]
    energy, weight, found = np.zeros((rows, levels)), np.zeros((rows, levels)), np.zeros(rows, dtype=int)
    live = np.arange(rows)
    with np.errstate(all="ignore"):
        for sweep in range(sweeps):
            e, w, f, before = energy[live], weight[live], found[live], energy[live]
            going = np.ones(len(live), dtype=bool)
            for k in range(levels):
                ta, tb = t[live, at[k]], t[live, at[k] + 1]
                a, b = (x[live, at[k] + i] - sum(w[:, j] * np.exp(-e[:, j] * u) for j in range(levels) if j != k) for i, u in enumerate((ta, tb)))
                new = np.log(a / b) / (tb - ta)
                shows = going & (b != 0) & (a / b > 0) & np.isfinite(new) & (new > 0)
                if not sweep:
                    going = shows
                e[:, k], w[:, k], f = np.where(shows, new, e[:, k]), np.where(shows, b * np.exp(new * tb), w[:, k]), np.where(shows, np.maximum(f, k + 1), f)
            energy[live], weight[live], found[live] = e, w, f
            live = live[~(np.abs(e - before) <= 1e-12 * np.abs(before)).all(axis=1)]
            if not len(live):
                break
        order = np.argsort(np.where(np.arange(levels) < found[:, None], energy, np.inf), axis=1, kind="stable")
        energy, weight = np.take_along_axis(energy, order, 1), np.take_along_axis(weight, order, 1)
        rest = x - sum((np.where(k < found, weight[:, k], 0.0)[:, None] * np.exp(-energy[:, k, None] * t) for k in range(levels)), np.zeros(t.shape))
        left = (np.abs(rest) / np.abs(x)).max(axis=1)
    return energy, weight, found, left


def guess_matrix_element(c3: Column, t: Column, dt: int, e_src: Column, e_snk: Column, a_src: Column, a_snk: Column) -> Column:
    """Of a three-point value, ground states alone."""
    return c3 * 4 * e_src * e_snk / (a_src * a_snk) * F.exp(e_snk * (dt - t) + e_src * t)


def guess_from_r3(r3: Column) -> Column:
    """The matrix element that a plateau of R3 with its overlaps shows: the value itself."""
    return r3


def guess_from_zv(zv: Column, e_src: Column) -> Column:
    """The matrix element 2 E / Z_V at a plateau."""
    return 2 * e_src / zv


# Fits.


def fit_constant(points: DataFrame, by: tuple[str, ...] = ("corr_id", "replica")) -> DataFrame:
    """Mean weighted by 1 / sigma**2. points: (by, x, sigma)."""
    w = 1 / (F.col("sigma") * F.col("sigma"))
    return points.groupBy(*by).agg((F.sum(w * F.col("x")) / F.sum(w)).alias("value"), F.count("*").alias("points"))


def fit_line(points: DataFrame, by: tuple[str, ...] = ("corr_id", "replica"), at: str = "t") -> DataFrame:
    """Weighted straight line by normal equations, all in one aggregation: intercept, slope, chi_sq, dof."""
    w = 1 / (F.col("sigma") * F.col("sigma"))
    x, y = F.col(at), F.col("x")
    s = points.groupBy(*by).agg(F.sum(w).alias("s"), F.sum(w * x).alias("sx"), F.sum(w * x * x).alias("sxx"), F.sum(w * y).alias("sy"), F.sum(w * x * y).alias("sxy"), F.sum(w * y * y).alias("syy"), F.count("*").alias("n"))
    det = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    s = s.withColumns({"intercept": (F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy")) / det, "slope": (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / det})
    chi = F.col("syy") - F.col("intercept") * F.col("sy") - F.col("slope") * F.col("sxy")
    return s.select(*by, "intercept", "slope", chi.alias("chi_sq"), (F.col("n") - 2).alias("dof"))


def _group_schema(df: DataFrame, by: tuple[str, ...]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{c}` {types[c]}" for c in by)


def fit_linear(design: DataFrame, chol: DataFrame | None = None, by: tuple[str, ...] = ("corr_id", "replica"), chunk: int = CHUNK) -> DataFrame:
    """Least squares of whitened residuals for each group; the last of ``by`` numbers replicas, of which a job takes ``chunk`` at a time. design: (by,
    t, x, sigma, row array<double>) with the basis functions of each point; chol: (corr_id, i, j, chol) lower factor of the inverse
    correlation, which comes once a job."""
    schema = _group_schema(design, by) + ", params array<double>, chi_sq double, dof int"

    def fit(pdf: pd.DataFrame, factor: pd.DataFrame | None) -> pd.DataFrame:
        out = []
        for key, g in pdf.sort_values("t").groupby(list(by), sort=False):
            s = g["sigma"].to_numpy()
            a, y = np.array(g["row"].tolist()) / s[:, None], g["x"].to_numpy() / s
            if factor is not None:
                at = pd.Index(g["t"])
                rows, columns = at.get_indexer(factor["i"]), at.get_indexer(factor["j"])
                known = (rows >= 0) & (columns >= 0)
                lower = np.zeros((len(g), len(g)))
                lower[rows[known], columns[known]] = factor["chol"].to_numpy()[known]
                a, y = lower.T @ a, lower.T @ y
            p = np.linalg.lstsq(a, y, rcond=None)[0]
            r = a @ p - y
            out.append((*key, p.tolist(), float(r @ r), len(y) - len(p)))
        return pd.DataFrame(out, columns=[*by, "params", "chi_sq", "dof"])

    dealt = design.withColumn("__chunk", F.floor(F.col(by[-1]) / chunk).cast("int"))
    keys = [*by[:-1], "__chunk"]
    if chol is None:
        return dealt.groupBy(*keys).applyInPandas(lambda pdf: fit(pdf, None), schema)
    chunks = dealt.select("corr_id", "__chunk").distinct().select(F.col("corr_id").alias("of"), F.col("__chunk").alias("of_chunk"))
    factors = chol.select(F.col("corr_id").alias("of"), "i", "j", "chol").join(chunks, "of")

    def job(pdf: pd.DataFrame, factor: pd.DataFrame) -> pd.DataFrame:
        return fit(pdf, factor) if len(pdf) and len(factor) else pd.DataFrame(columns=[*by, "params", "chi_sq", "dof"])

    return dealt.groupBy("corr_id", "__chunk").cogroup(factors.groupBy("of", "of_chunk")).applyInPandas(job, schema)


def fit_replicas(points: DataFrame, model: str, nt: int, start: list[float], chol: DataFrame | None = None) -> DataFrame:
    """A non-linear fit of every (fit_id, replica), each fit of one series. points: (fit_id, replica, t, x, sigma). Two-point models take and give
    (energy, amplitude) for each level. The central replica is fitted from ``start``, without correlation first, and its parameters start
    all others. Failures are rows with an error, not exceptions."""
    two_point, n = model in ("exp", "cosh", "sinh"), len(start)
    names = [f"p{k:02d}" for k in range(n)]
    spec = {"series": F.lit("s"), "model": F.lit(model), "src": F.lit(n // 2 if two_point else 0), "snk": F.lit(0), "nt": F.lit(nt), "dt": F.lit(0), "params": F.array(*[F.lit(x) for x in (names[::2] + names[1::2] if two_point else names)])}
    fits = points.select("fit_id").distinct()
    begin = fits.select("fit_id", F.explode(F.create_map(*[F.lit(x) for pair in zip(names, map(float, start)) for x in pair])).alias("name", "value"))
    lower = None if chol is None else chol.select("fit_id", F.lit("s").alias("series_i"), "i", F.lit("s").alias("series_j"), "j", "chol")
    found = fit_joint(points.withColumn("series", F.lit("s")), fits.withColumns(spec), begin, lower)
    params = F.transform("params", lambda x, k: F.when(k % 2 == 1, F.abs(x)).otherwise(x)) if two_point else F.col("params")
    return found.select("fit_id", "replica", params.alias("params"), "chi_sq", "dof", "error", "state")


def scan_fits(points: DataFrame, ranges: DataFrame, model: str, nt: int, start: list[float]) -> DataFrame:
    """One fit for each range (range_id, fit_times array) of each series, all replicas, in one job. A range needs few rows."""
    r = ranges.select("range_id", F.explode("fit_times").alias("t"))
    chosen = points.join(r, "t").withColumn("fit_id", F.concat_ws("_", "corr_id", "range_id"))
    return fit_replicas(chosen.select("fit_id", "replica", "t", "x", "sigma"), model, nt, start)


def expand_ranges(ranges: DataFrame, min_points: int = 1) -> DataFrame:
    """ranges: (range_id, ti, tf, dti, dtf, thin, skip): every start in [ti, ti + dti) with every end in [tf, tf + dtf), every thin-th time
    from skip on. Gives range_id, ti, tf, fit_times; lists of fewer than min_points and repeats are dropped."""
    starts = ranges.withColumn("a", F.explode(F.sequence(F.col("ti"), F.col("ti") + F.col("dti") - 1)))
    both = starts.withColumn("b", F.explode(F.sequence(F.col("tf"), F.col("tf") + F.col("dtf") - 1))).where("b >= a")
    times = F.when(F.col("a") + F.col("skip") <= F.col("b"), F.sequence(F.col("a") + F.col("skip"), F.col("b"), F.col("thin"))).otherwise(F.array().cast("array<int>"))
    out = both.select("range_id", F.col("a").alias("ti"), F.col("b").alias("tf"), times.alias("fit_times"))
    return out.where(F.size("fit_times") >= min_points).dropDuplicates(["range_id", "fit_times"])


def relative_ranges(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Ranges relative to another one: children (range_id, offset, ti, tf, dti, dtf, thin, skip) take the start and end of the range with
    number range_id + offset. A range relative to itself is an error."""
    checked = children.withColumn("parent", F.when(F.col("offset") == 0, F.raise_error(F.lit("a range depends on itself")).cast("int")).otherwise(F.col("range_id") + F.col("offset")))
    p = parents.select(F.col("range_id").alias("parent"), F.col("ti").alias("pi"), F.col("tf").alias("pf"))
    return checked.join(p, "parent").withColumns({"ti": F.col("ti") + F.col("pi"), "tf": F.col("tf") + F.col("pf")}).drop("pi", "pf", "offset")


# Fit results.


def fit_stats(fits: DataFrame, sample_size: int) -> DataFrame:
    """Adds chi_sq_dof, pvalue and pvalue_h (Hotelling with sample_size - 1; chi-square where that is not defined)."""
    from corvane.functions.statistics import q_chisq, q_hotelling

    one = F.when(F.col("dof") == 0, 1.0)
    return fits.withColumns({
        "chi_sq_dof": F.when(F.col("dof") == 0, F.col("chi_sq")).otherwise(F.col("chi_sq") / F.col("dof")),
        "pvalue": one.otherwise(q_chisq(F.col("chi_sq"), F.col("dof"))), "pvalue_h": one.otherwise(q_hotelling(F.col("chi_sq"), F.col("dof"), F.lit(sample_size - 1))),
    })


def accept_fits(fits: DataFrame, min_dof: int = 0, hotelling: float | None = None, chi_max: float | None = None, e_max: float | None = None) -> DataFrame:
    ok = F.col("dof") >= min_dof
    for limit, test in ((hotelling, lambda x: F.col("pvalue_h") >= x), (chi_max, lambda x: F.col("chi_sq_dof") <= x), (e_max, lambda x: F.col("energy") <= x)):
        ok = ok & test(limit) if limit is not None else ok
    return fits.where(ok)


def level_separation(param: DataFrame, least: float, by: tuple[str, ...] = ("fit_id", "name")) -> DataFrame:
    """Fits none of whose levels is less than ``least`` times the one below: by, ok."""
    w = W.partitionBy(*by).orderBy("idx")
    ratio = param.withColumn("r", F.col("value") / F.lag("value").over(w))
    return ratio.groupBy(*by).agg(F.min(F.coalesce(F.col("r") >= least, F.lit(True))).alias("ok"))


def check_params(summary: DataFrame, strict: int = 0, e_max: float | None = None, by: tuple[str, ...] = ("fit_id", "name")) -> DataFrame:
    """Adds ok: the bounds do not hold 0, monotonic values are at most e_max, and they do not overlap a lower level's. strict 1: the
    first test by min and max; 2: the last one. summary: (by, idx, monotonic, min, low, central, high, max)."""
    a, b = ("min", "max") if strict & 1 else ("low", "high")
    lo, hi = ("min", "max") if strict & 2 else ("low", "high")
    own = (F.col(a) > 0) | (F.col(b) < 0)
    if e_max is not None:
        own = own & ~(F.col("monotonic") & (F.col("central") > e_max))
    left = summary.withColumn("__own", own)
    right = summary.select(*by, F.col("idx").alias("__j"), F.col(lo).alias("__lo"), F.col(hi).alias("__hi"))
    met = left.join(right, list(by)).where(F.col("__j") < F.col("idx"))
    clash = met.where(~((F.col(lo) > F.col("__hi")) | (F.col(hi) < F.col("__lo")))).select(*by, "idx").distinct().withColumn("__clash", F.lit(True))
    return left.join(clash, [*by, "idx"], "left").withColumn("ok", F.col("__own") & F.col("__clash").isNull()).drop("__own", "__clash")


def from_monotonic(param: DataFrame, by: tuple[str, ...] = ("fit_id", "replica", "name")) -> DataFrame:
    """Levels from steps: each is the one below plus the square of its step."""
    w = W.partitionBy(*by).orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    return param.withColumn("value", F.sum(F.when(F.col("idx") == 0, F.col("value")).otherwise(F.col("value") * F.col("value"))).over(w))


def to_monotonic(param: DataFrame, by: tuple[str, ...] = ("fit_id", "replica", "name")) -> DataFrame:
    w = W.partitionBy(*by).orderBy("idx")
    return param.withColumn("value", F.when(F.col("idx") == 0, F.col("value")).otherwise(F.sqrt(F.col("value") - F.lag("value").over(w))))


def adjust_signs(param: DataFrame, by: tuple[str, ...] = ("fit_id", "replica", "set_id")) -> DataFrame:
    """Of each linked set all values turn if the first (idx 0) is negative."""
    first = F.first("value").over(W.partitionBy(*by).orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return param.withColumn("value", F.when(first < 0, -F.col("value")).otherwise(F.col("value")))


def summarise_fits(fits: DataFrame, rows_per_page: int = 50, params: DataFrame | None = None, strict: int = 0, e_max: float | None = None) -> DataFrame:
    """Good fits, one for each list of fit times (the first loaded), ranked by pvalue_h and paged. params: summaries of their parameters as
    check_params() takes them; fits with one that is not significant go first."""
    from .select import rank_fits, with_page

    if params is not None:
        bad = check_params(params, strict, e_max).where(~F.col("ok")).select("fit_id").distinct()
        fits = fits.join(bad, "fit_id", "left_anti")
    good = fits.where("dof >= 0").withColumn("__n", F.row_number().over(W.partitionBy("base", "fit_times").orderBy("load_order"))).where("__n = 1").drop("__n")
    return with_page(rank_fits(good), rows_per_page)


def fit_report(data: DataFrame, theory: DataFrame, by: tuple[str, ...] = ("corr_id",)) -> DataFrame:
    """Every point with its data, theory if it was fitted, a flag, and log ratios: of the data to the point before, of the theory to the fitted
    point before, both over the time between them, at its middle. data: (by, t, x), theory: (by, t, y)."""
    w = W.partitionBy(*by).orderBy("t")
    f = W.partitionBy(*by, "fitted").orderBy("t")
    met = data.join(theory, [*by, "t"], "left").withColumn("fitted", F.col("y").isNotNull())
    ratio = lambda c, v: F.log(F.lag(c).over(v) / F.col(c)) / (F.col("t") - F.lag("t").over(v))
    middle = (F.col("t") + F.coalesce(F.lag("t").over(w), F.col("t") - 1)) / 2
    return met.withColumns({"t_mid": middle, "log_data": ratio("x", w), "log_theory": F.when(F.col("fitted"), ratio("y", f)), "t_mid_theory": F.when(F.col("fitted"), (F.col("t") + F.lag("t").over(f)) / 2)})


def global_report(points: DataFrame, theory: DataFrame, x_columns: DataFrame, by: tuple[str, ...] = ("ensemble", "x_key")) -> DataFrame:
    """One row for each data point: data and theory with errors beside the x columns. Inputs are summaries (by, low, central, high)."""
    side = lambda df, n: df.select(*by, *[F.col(c).alias(f"{n}_{c}") for c in ("low", "central", "high")])
    return side(points, "data").join(side(theory, "theory"), list(by)).join(x_columns, list(by)).orderBy(*by)


def derive_energies(param: DataFrame, n_sites: int, momenta: DataFrame, kind: str = "lattice") -> DataFrame:
    """Energies at momenta (nx, ny, nz) from the energy at rest: one row for each momentum, few for each fit."""
    from corvane.functions.kinematics import dispersion

    all_p = momenta.agg(F.collect_list(F.struct("nx", "ny", "nz")).alias("p"))
    met = attach(param, all_p).select("*", F.explode("p").alias("q")).drop("p").select("*", "q.*").drop("q")
    return met.withColumn("energy", dispersion(F.col("value"), n_sites, F.col("nx"), F.col("ny"), F.col("nz"), kind))


# Global fits.


def design_columns(terms: dict[str, bool], n_e: int, n_d: int) -> list[str]:
    """The columns of a form factor's design matrix that are enabled: c0, c1, e1.., d1... ."""
    names = ["c0", "c1", *[f"e{k}" for k in range(1, n_e + 1)], *[f"d{k}" for k in range(1, n_d + 1)]]
    return [n for n in names if terms.get(n, True)]


def with_design(df: DataFrame, lam: float, columns: list[str]) -> DataFrame:
    """Adds row: the basis functions at a point (el, a_inv, delta, chi_fv, d_mpi), pole included."""
    c = F.col
    pole = lam / (c("el") + c("delta"))
    basis = {"c0": 1 + c("chi_fv"), "c1": c("d_mpi")}
    basis |= {f"e{k}": F.pow(c("el") / lam, F.lit(float(k))) for k in range(1, 10)} | {f"d{k}": F.pow(lam / c("a_inv"), F.lit(2.0 * k)) for k in range(1, 10)}
    return df.withColumn("row", F.array(*[pole * basis[n] for n in columns]))


def derive_constants(param: DataFrame, const: DataFrame, scale: float, m_pi_phys: float) -> DataFrame:
    """For each ensemble and replica: delta from pole and state masses, chi (chiral log) and the mass difference. param: (ensemble,
    replica, m_pi), const: (ensemble, m_pole, m_state, l)."""
    from corvane.functions.statistics import chiral_log

    met = param.join(const, "ensemble")
    return met.withColumns({
        "delta": F.col("m_pole") - F.col("m_state"), "chi": chiral_log(F.col("m_pi"), scale) / (16 * 3.141592653589793**2 * 0.13 * 0.13),
        "d_mpi": (F.col("m_pi") * F.col("m_pi") - m_pi_phys * m_pi_phys) / (scale * scale),
    })


def to_common_units(df: DataFrame, form_factor: str = "f_par") -> DataFrame:
    """f_par times the root of a_inv, f_perp over it; f_zero and f_plus have no unit."""
    root = F.sqrt("a_inv")
    return df.withColumn("x", F.col("x") * (root if form_factor == "f_par" else 1 / root if form_factor == "f_perp" else F.lit(1.0)))


def apply_constraint(design: DataFrame, at: list[float], value: float, solve: int) -> DataFrame:
    """One linear constraint at . p = value takes parameter ``solve`` out: its column is folded into the others and x moves."""
    pivot = at[solve]
    others = [k for k in range(len(at)) if k != solve]
    row = F.col("row")
    new = F.array(*[row[k] - row[solve] * (at[k] / pivot) for k in others])
    return design.withColumns({"x": F.col("x") - row[solve] * (value / pivot), "row": new})


def fit_band(param: DataFrame, x_min: float, x_max: float, ticks: int = 200, extra: list[float] | None = None) -> DataFrame:
    """The curve sum of params[k] x**k at ticks + 1 places and extra ones, for every replica: (fit_id, replica, x, y)."""
    xs = [x_min + (x_max - x_min) * k / ticks for k in range(ticks + 1)] + (extra or [])
    at = param.select("fit_id", "replica", "params", F.explode(F.array(*[F.lit(float(v)) for v in xs])).alias("x"))
    y = F.aggregate(F.reverse("params"), F.lit(0.0), lambda acc, p: acc * F.col("x") + p)
    return at.select("fit_id", "replica", "x", y.alias("y"))


def adjust_points(points: DataFrame, param: DataFrame, columns: list[str], lam: float) -> DataFrame:
    """Data points with the chiral, mass and discretisation terms of the fit taken off and the pole removed: adds adjusted. points have a
    row (with_design) and (fit_id, replica, el, delta, x); param: (fit_id, replica, params)."""
    met = points.join(param.select("fit_id", "replica", "params"), ["fit_id", "replica"])
    total = F.lit(0.0)
    for k, n in enumerate(columns):
        if n == "c0":
            total = total + F.col("params")[k] * (F.col("row")[k] - lam / (F.col("el") + F.col("delta")))
        elif n == "c1" or n.startswith("d"):
            total = total + F.col("params")[k] * F.col("row")[k]
    return met.withColumn("adjusted", (F.col("x") - total) * (F.col("el") + F.col("delta")) / lam).drop("params")


def run_variations(design: DataFrame, variations: DataFrame) -> DataFrame:
    """All variations of a linear fit in one job: (variation, drop array of ensembles) beside the group key."""
    listed = variations.agg(F.collect_list(F.struct("variation", "drop")).alias("__v"))
    spread = attach(design, listed).select("*", F.explode("__v").alias("v")).drop("__v").select("*", "v.*").drop("v")
    return fit_linear(spread.where(~F.array_contains("drop", F.col("ensemble"))), by=("variation", "replica"))


def comparison_table(attr: DataFrame, band: DataFrame, x_low: float, x_high: float) -> DataFrame:
    """For each variation its fit quality beside the curve's central value at two places."""
    ends = band.where("replica = -1").groupBy("fit_id").agg(F.max(F.when(F.col("x") == x_low, F.col("y"))).alias("y_low"), F.max(F.when(F.col("x") == x_high, F.col("y"))).alias("y_high"))
    return attr.join(ends, "fit_id")


def disc_error(df: DataFrame, lam: float, order: int) -> DataFrame:
    """Size of the next discretisation term on the finest ensemble relative to y: (d_last, a_inv, y) by x."""
    finest = df.groupBy("x").agg(F.max_by(F.struct("d_last", "a_inv", "y"), "a_inv").alias("f")).select("x", "f.*")
    return finest.select("x", F.abs(F.col("d_last") * F.pow(lam / (2 * F.col("a_inv")), F.lit(2.0 * (order + 1))) / F.col("y")).alias("error"))


def fit_linear_chunks(design: DataFrame, values: DataFrame, by: tuple[str, ...] = ("variation",)) -> DataFrame:
    """Linear fits of many replicas at once where the design is the same for all (frozen covariance): one solve for each group and
    chunk of replicas. design: (by, t, sigma, row), values: (t, chunk, first, xs array) with replicas first, first + 1, ... of a chunk."""
    met = design.join(values, "t")

    def job(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        s = pdf["sigma"].to_numpy()[:, None]
        a, y = np.array(pdf["row"].tolist()) / s, np.array(pdf["xs"].tolist()) / s
        p = np.linalg.lstsq(a, y, rcond=None)[0]
        r = a @ p - y
        n = y.shape[1]
        return pd.DataFrame({**{c: [k] * n for c, k in zip(by, key)}, "replica": int(pdf["first"].iloc[0]) + np.arange(n), "params": list(p.T), "chi_sq": (r * r).sum(axis=0), "dof": len(a) - len(p)})

    return met.groupBy(*by, "chunk").applyInPandas(job, _group_schema(design, by) + ", replica int, params array<double>, chi_sq double, dof int")


def gaussian_chunks(points: DataFrame, replicas: int, seed: int, chunk: int = 1000) -> DataFrame:
    """Gaussian replicas of points (t, x, sigma) as chunks of arrays: (t, chunk, first, xs); replica -1 is the value itself."""

    def make(frames):
        for pdf in frames:
            rows = []
            for t, x, sigma, c, key in pdf.itertuples(index=False):
                n = min(chunk, replicas - c * chunk)
                xs = np.random.Generator(np.random.PCG64([seed, c, key & 0xFFFFFFFF])).normal(x, sigma, n)
                rows.append((t, c, c * chunk - (c == 0), np.concatenate(([x], xs)) if c == 0 else xs))
            yield pd.DataFrame(rows, columns=["t", "chunk", "first", "xs"])

    spread = points.select("t", "x", "sigma", F.explode(F.sequence(F.lit(0), F.lit(-(-replicas // chunk) - 1))).alias("chunk")).withColumn("key", F.xxhash64("t"))
    return spread.mapInPandas(make, f"t {dict(points.dtypes)['t']}, chunk int, first int, xs array<double>")
