"""Fits of several series that share parameters, many replicas at a time.

A specification has one row a series: its model and the names of its parameters in the model's order. Series that have a name in common
are fitted together: they form a component of the graph of series and names (linked_fits), and a parameter's place in the fit's vector
is its place among the component's names (positions). A job takes one fit and a chunk of CHUNK replicas; the fit's set-up, with the factor of
its inverse correlation, comes once a job by cogroup. Inside, Levenberg-Marquardt runs on replica x parameter arrays with a damping
for each replica and one mask of those still under way; the Jacobian has a block for each series, filled where a parameter enters its model.

The central replica goes into every chunk and is fitted first, without correlation and then with it; its parameters start all others.
Every replica ends in a state: ``gradient`` (converged: the step that the gradient asks for would gain nothing), or an error: no step improves,
too many steps, not finite, singular, retries differ, points are missing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.scratch import staged

#: Replicas that one job fits.
CHUNK = 1000
STEPS, TOLERANCE = 200, 1e-20
#: What a step may still gain, as a share of the sum of squares, where LAST undamped steps end a fit.
NEAR, LAST = 1e-12, 4
#: A damping beyond which no shorter step is tried.
DAMP_MAX = 1e16
CONVERGED = ("gradient",)

#: Columns of a specification beside fit_id. src, snk: levels at source and sink; nt: period (0: none); dt: separation of three-point functions.
SPEC = "series string, model string, src int, snk int, nt int, dt int, params array<string>"


# Models: parameters in local order, each an array (replicas, 1), and times (1, points). All are analytic, so that a step along the
# imaginary axis gives derivatives without cancellation.


def _wave(kind: str) -> Callable:
    if kind == "exp":
        return lambda e, t, nt: np.exp(-e * t)
    sign = 1 if kind == "cosh" else -1
    return lambda e, t, nt: np.exp(-e * t) + sign * np.exp(-e * (nt - t))


def _two_point(kind: str) -> Callable:
    wave = _wave(kind)

    def f(p, t, s):
        n = s["src"]
        left = p[n : 2 * n]
        right = p[2 * n : 3 * n] or left
        return sum(a * b / (2 * e) * wave(e, t, s["nt"]) for e, a, b in zip(p[:n], left, right))

    return f


def _parts(p, s):
    """Energies and overlaps of source and sink, and the matrix elements by sink and source level."""
    cuts = np.cumsum([s["src"], s["snk"], s["src"], s["snk"]])
    e_src, e_snk, a_src, a_snk = (p[a:b] for a, b in zip([0, *cuts], cuts))
    mel = p[cuts[-1] :]
    return e_src, e_snk, a_src, a_snk, [mel[k * s["src"] : (k + 1) * s["src"]] for k in range(s["snk"])]


def _three_point(p, t, s):
    """All levels meet from three on; of two, excited ones meet ground states only."""
    e_src, e_snk, a_src, a_snk, mel = _parts(p, s)
    total, full = 0, max(s["src"], s["snk"]) > 2
    for k in range(s["snk"]):
        for i in range(s["src"]):
            if full or not k or not i:
                total = total + a_snk[k] * a_src[i] * mel[k][i] * np.exp(-e_snk[k] * (s["dt"] - t) - e_src[i] * t) / (4 * e_snk[k] * e_src[i])
    return total


def _c2(e, a, t, s):
    wave = _wave("cosh" if s["nt"] else "exp")
    return sum(x * x / (2 * y) * wave(y, t, s["nt"]) for x, y in zip(a, e))


def _r3(p, t, s):
    e_src, e_snk, a_src, a_snk, _ = _parts(p, s)
    return _three_point(p, t, s) / (_c2(e_src, a_src, t, s) * _c2(e_snk, a_snk, s["dt"] - t, s)) * a_src[0] * a_snk[0]


def _zv(p, t, s):
    e_src, _, a_src, _, _ = _parts(p, s)
    return _c2(e_src, a_src, np.full((1, 1), float(s["dt"])), s) / _three_point(p, t, s)


MODELS: dict[str, Callable] = {
    "exp": _two_point("exp"), "cosh": _two_point("cosh"), "sinh": _two_point("sinh"), "3pt": _three_point, "r3": _r3, "zv": _zv,
    "const": lambda p, t, s: p[0] + 0 * t, "misc": lambda p, t, s: p[0] * (1 + p[1] * np.exp(-p[2] * t)),
}


def derived(s: dict, p: list) -> dict[str, np.ndarray]:
    """What follows from a series' parameters: energy difference of sink and source, raw R3, ZV."""
    if s["model"] not in ("3pt", "r3", "zv"):
        return {}
    e_src, e_snk, a_src, a_snk, mel = _parts(p, s)
    out = {"EDiff": e_snk[0] - e_src[0]}
    if s["model"] == "r3":
        out["R3Raw"] = mel[0][0] / (a_src[0] * a_snk[0])
    if s["model"] == "zv":
        out["ZV"] = 2 * e_src[0] / mel[0][0]
    return {f"{s['series']}.{n}": v[:, 0] for n, v in out.items()}


class Problem:
    """One fit's residuals for a block of replicas. y: (replicas, points), points in the order of specs and their times; fixed: values
    (replicas, names); lower: factor of the inverse correlation (points, points) or None."""

    def __init__(self, specs: list[dict], times: list[np.ndarray], variable: list[str], fixed_names: list[str], y: np.ndarray, fixed: np.ndarray, sigma: np.ndarray, lower: np.ndarray | None = None):
        self.specs, self.y, self.fixed, self.sigma, self.lower = specs, y, fixed, sigma, lower
        self.times, self.size = [t[None, :].astype(float) for t in times], len(variable)
        place = {n: k for k, n in enumerate(variable)} | {n: -1 - k for k, n in enumerate(fixed_names)}
        self.where = [[place[n] for n in s["params"]] for s in specs]
        ends = np.cumsum([len(t) for t in times])
        self.columns = [slice(b - len(t), b) for t, b in zip(times, ends)]

    def local(self, k: int, p: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        return [p[:, j : j + 1] if j >= 0 else self.fixed[rows, -1 - j][:, None].astype(p.dtype) for j in self.where[k]]

    def theory(self, p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([np.broadcast_to(MODELS[s["model"]](self.local(k, p, rows), self.times[k], s), (len(p), self.times[k].shape[1])) for k, s in enumerate(self.specs)], axis=1)

    def white(self, r: np.ndarray, axis: int = 1) -> np.ndarray:
        if self.lower is None:
            return r
        return np.moveaxis(np.moveaxis(r, axis, -1) @ self.lower, -1, axis)

    def residual(self, p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.white((self.theory(p, rows) - self.y[rows]) / self.sigma)

    def jacobian(self, p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(p), self.y.shape[1], self.size))
        for k, s in enumerate(self.specs):
            for j in {j for j in self.where[k] if j >= 0}:
                moved = p.astype(complex)
                moved[:, j] += 1e-30j
                out[:, self.columns[k], j] = MODELS[s["model"]](self.local(k, moved, rows), self.times[k], s).imag / 1e-30 / self.sigma[self.columns[k]]
        return self.white(out)


def minimise(problem, start: np.ndarray, steps: int = STEPS, tol: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Levenberg-Marquardt on all replicas at once, from start (replicas, parameters): parameters, sums of squares, states and steps."""
    p, n = start.astype(float).copy(), len(start)
    state, taken = np.full(n, "", dtype=object), np.zeros(n, dtype=int)
    every = np.arange(n)
    with np.errstate(all="ignore"):
        r = problem.residual(p, every)
        cost = (r * r).sum(axis=1)
        state[~np.isfinite(cost)] = "not finite"
        known = problem.white(problem.y / problem.sigma)
        floor = (4e-16) ** 2 * (known * known).sum(axis=1)  # what rounding of the data alone leaves
        damp, g, m = np.full(n, 1e-3), np.zeros(p.shape), np.zeros((*p.shape, p.shape[1]))
        fresh, last = np.ones(n, dtype=bool), np.zeros(n, dtype=int)
        for _ in range(steps):
            on = np.flatnonzero(state == "")
            if not len(on):
                break
            new = on[fresh[on]]
            if len(new):
                jac = problem.jacobian(p[new], new)
                g[new], m[new] = np.einsum("rpk,rp->rk", jac, r[new]), np.einsum("rpk,rpl->rkl", jac, jac)
                fresh[new] = False
                bad = ~(np.isfinite(g[new]).all(axis=1) & np.isfinite(m[new]).all(axis=(1, 2)))
                state[new[bad]] = "not finite"
                blind = ~bad & (np.einsum("rkk->rk", m[new]) <= 0).any(axis=1)
                state[new[blind]] = "singular"
                good = new[~bad & ~blind]
                gain = -np.einsum("rk,rk->r", g[good], _solve(m[good], -g[good]))
                state[good[(gain <= np.maximum(tol * cost[good], floor[good])) | (last[good] == LAST)]] = "gradient"
                last[good[gain <= np.maximum(NEAR * cost[good], floor[good])]] += 1
                on = np.flatnonzero(state == "")
                if not len(on):
                    break
            scale = np.einsum("rkk->rk", m[on])
            free = last[on] > 0  # so near that sums of squares no longer tell: a few undamped steps end it
            damp[on[free]] = 0
            step = _solve(m[on] + damp[on, None, None] * np.einsum("rk,kl->rkl", scale, np.eye(p.shape[1])), -g[on])
            tried = p[on] + step
            after = problem.residual(tried, on)
            value = (after * after).sum(axis=1)
            better = np.isfinite(value) & ((value <= cost[on]) | free)
            won = on[better]
            p[won], r[won], cost[won] = tried[better], after[better], value[better]
            damp[won], fresh[won] = np.maximum(damp[won] / 10, 1e-12), True
            taken[won] += 1
            lost = on[~better]
            damp[lost] = np.maximum(damp[lost] * 10, 1e-12)
            lost = lost[damp[lost] > DAMP_MAX]
            if len(lost):
                # no step however short helps: at rounding's limit that is a minimum, else it is not
                gain = -np.einsum("rk,rk->r", g[lost], _solve(m[lost], -g[lost]))
                flat = np.abs(gain) <= np.maximum(1e-10 * cost[lost], 100 * floor[lost])
                state[lost] = np.where(flat, "gradient", "no step improves")
    state[state == ""] = "too many steps"
    return p, cost, list(state), taken


def _solve(m: np.ndarray, b: np.ndarray) -> np.ndarray:
    """m x = b for each replica, in units in which m's diagonal is 1."""
    root = np.sqrt(np.maximum(np.einsum("rkk->rk", m), 1e-300))
    scaled = m / root[:, :, None] / root[:, None, :]
    try:
        x = np.linalg.solve(scaled, (b / root)[..., None])[..., 0]
    except np.linalg.LinAlgError:
        x = np.einsum("rkl,rl->rk", np.linalg.pinv(scaled, hermitian=True), b / root)
    return x / root


# Parameter graph.


def linked_fits(specs: DataFrame) -> DataFrame:
    """specs: (series, params, ...). Adds fit_id: the least series of those that a chain of shared names joins. Labels go from series to
    names and back, and to the label's own label, until none changes."""
    links = staged(specs.select("series", F.explode(F.array_distinct("params")).alias("name")))
    label, changed = specs.select("series", F.col("series").alias("label")), True
    while changed:
        by_name = links.join(label, "series").groupBy("name").agg(F.min("label").alias("low"))
        near = links.join(by_name, "name").groupBy("series").agg(F.min("low").alias("low"))
        met = label.join(near, "series", "left").withColumn("low", F.coalesce("low", "label"))
        far = met.select(F.col("series").alias("low"), F.col("low").alias("jump"))
        new = staged(met.join(far, "low", "left").select("series", F.col("label").alias("old"), F.least("low", "jump").alias("label")))
        changed = not new.where("label <> old").isEmpty()
        label = new.select("series", "label")
    return specs.join(label.withColumnRenamed("label", "fit_id"), "series")


def positions(specs: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """specs: (fit_id, series, params), fixed: (fit_id, name, ...). The position of each variable parameter in its fit's vector: fit_id, name, position."""
    names = specs.select("fit_id", F.explode("params").alias("name")).distinct()
    if fixed is not None:
        names = names.join(fixed.select("fit_id", "name").distinct(), ["fit_id", "name"], "left_anti")
    return names.withColumn("position", F.row_number().over(W.partitionBy("fit_id").orderBy("name")) - 1)


def named(fits: DataFrame, place: DataFrame) -> DataFrame:
    """Fits' parameters by name: fit_id, replica, name, value."""
    long = fits.select("fit_id", "replica", F.posexplode("params").alias("position", "value"))
    return long.join(place, ["fit_id", "position"]).select("fit_id", "replica", "name", "value")


# The job.

RESULT = "fit_id {kind}, replica int, params array<double>, chi_sq double, dof int, state string, error string, steps int, derived map<string, double>"


def fit_joint(points: DataFrame, specs: DataFrame, start: DataFrame, chol: DataFrame | None = None, fixed: DataFrame | None = None, retries: int = 0, chunk: int = CHUNK, steps: int = STEPS) -> DataFrame:
    """A row for each (fit_id, replica): params by position, chi_sq, dof, state, error (null if it converged), steps, derived.

    points: (fit_id, replica, series, t, x, sigma), replica -1 the central one; sigma of the central one counts. specs: (fit_id, SPEC).
    start: (fit_id, name, value). chol: (fit_id, series_i, i, series_j, j, chol), the lower factor of the inverse correlation of all
    points of a fit. fixed: (fit_id, replica, name, value): parameters that are not fitted, by replica; a replica without a value has that of
    replica -1. retries: each fit is repeated from its end until it gives the same sum of squares, at most so often."""
    rows = points.select("fit_id", "replica", "series", "t", F.lit(None).cast("string").alias("name"), F.col("x").cast("double").alias("x"), F.col("sigma").cast("double").alias("sigma"))
    if fixed is not None:
        rows = rows.unionByName(fixed.select("fit_id", "replica", F.lit(None).cast("string").alias("series"), F.lit(None).cast("int").alias("t"), "name", F.col("value").cast("double").alias("x"), F.lit(None).cast("double").alias("sigma")))
    most = points.agg(F.max("replica")).first()[0]
    chunks = 0 if most is None else max(0, most) // chunk
    rows = rows.withColumn("chunk", F.explode(F.when(F.col("replica") < 0, F.sequence(F.lit(0), F.lit(chunks))).otherwise(F.array(F.floor(F.col("replica") / chunk).cast("int")))))
    setup = specs.groupBy("fit_id").agg(F.collect_list(F.struct(*[c.split()[0] for c in SPEC.split(", ")])).alias("specs"))
    setup = setup.join(start.groupBy("fit_id").agg(F.collect_list(F.struct("name", "value")).alias("start")), "fit_id", "left")
    if chol is not None:
        setup = setup.join(chol.groupBy("fit_id").agg(F.collect_list(F.struct("series_i", "i", "series_j", "j", "chol")).alias("chol")), "fit_id", "left")
    else:
        setup = setup.withColumn("chol", F.lit(None).cast("array<struct<series_i: string, i: int, series_j: string, j: int, chol: double>>"))
    setup = setup.select(F.col("fit_id").alias("of_fit"), F.explode(F.sequence(F.lit(0), F.lit(chunks))).alias("of_chunk"), "specs", "start", "chol")
    kind = points.sparkSession.createDataFrame([], RESULT.format(kind=dict(points.dtypes)["fit_id"])).schema
    arrow = to_arrow_schema(kind)

    def job(key: tuple, table: pa.Table, head: pa.Table) -> pa.Table:
        if not head.num_rows or not table.num_rows:
            return arrow.empty_table()
        found = _fit_chunk(table, head.to_pylist()[0], retries, steps)
        first = key[1].as_py() == 0
        rows = [(key[0].as_py(), *r) for r in found if r[0] >= 0 or first]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), arrow, strict=True)], schema=arrow) if rows else arrow.empty_table()

    return rows.groupBy("fit_id", "chunk").cogroup(setup.groupBy("of_fit", "of_chunk")).applyInArrow(job, kind)


def _fit_chunk(table: pa.Table, head: dict, retries: int, steps: int) -> list[tuple]:
    columns = {c: np.array(table.column(c).to_pylist(), dtype=object) for c in ("replica", "series", "t", "name")}
    x, sigma = (table.column(c).to_numpy().astype(float) for c in ("x", "sigma"))
    data = np.array([s is not None for s in columns["series"]], dtype=bool)
    specs = sorted(head["specs"], key=lambda s: s["series"])
    replicas = np.array(sorted(set(columns["replica"][data])), dtype=int)
    at = {int(r): k for k, r in enumerate(replicas)}
    points = sorted(set(zip(columns["series"][data], columns["t"][data])))
    place = {k: n for n, k in enumerate(points)}
    y, s = np.full((len(replicas), len(points)), np.nan), np.full((len(replicas), len(points)), np.nan)
    for r, series, t, v, w in zip(*(columns[c][data] for c in ("replica", "series", "t")), x[data], sigma[data]):
        y[at[int(r)], place[series, t]], s[at[int(r)], place[series, t]] = v, w
    specs = [f for f in specs if any(series == f["series"] for series, _ in points)]
    times = [np.array([t for series, t in points if series == f["series"]]) for f in specs]
    fixed_names = sorted(set(columns["name"][~data]))
    fixed = np.full((len(replicas), len(fixed_names)), np.nan)
    given = {(n, int(r)): v for n, r, v in zip(columns["name"][~data], columns["replica"][~data], x[~data])}
    for j, n in enumerate(fixed_names):
        fixed[:, j] = [given.get((n, int(r)), given.get((n, -1), np.nan)) for r in replicas]
    names = sorted({n for f in specs for n in f["params"]}.difference(fixed_names))
    begin = {v["name"]: v["value"] for v in head["start"] or []}
    if missing := [n for n in names if n not in begin]:
        return [(int(r), None, None, None, None, f"no start value for {', '.join(missing)}", 0, {}) for r in replicas]
    lower = None
    if head["chol"] is not None:
        lower = np.zeros((len(points), len(points)))
        for e in head["chol"]:
            a, b = place.get((e["series_i"], e["i"])), place.get((e["series_j"], e["j"]))
            if a is not None and b is not None:
                lower[a, b] = e["chol"]
    width = s[at[-1]] if -1 in at else s[0]
    first = np.tile([begin[n] for n in names], (len(replicas), 1)) if names else np.zeros((len(replicas), 0))
    whole = np.isfinite(y).all(axis=1)

    def run(rows: np.ndarray, factor, p: np.ndarray):
        problem = Problem(specs, times, names, fixed_names, y[rows], fixed[rows], width, factor)
        if not names:
            r = problem.residual(p, np.arange(len(rows)))
            return p, (r * r).sum(axis=1), ["gradient"] * len(rows), np.zeros(len(rows), dtype=int)
        p, cost, state, taken = minimise(problem, p, steps)
        for _ in range(retries):
            again, value, state, more = minimise(problem, p, steps)
            taken, same = taken + more, np.isclose(value, cost, rtol=1e-12, atol=0)
            p, cost = again, value
            if same.all():
                return p, cost, state, taken
            state = [st if ok or st not in CONVERGED else "retries differ" for st, ok in zip(state, same)]
        return p, cost, state, taken

    p, cost, state, taken = first.copy(), np.full(len(replicas), np.nan), ["points are missing"] * len(replicas), np.zeros(len(replicas), dtype=int)

    def put(rows: np.ndarray, found) -> None:
        for k, row in enumerate(rows):
            p[row], cost[row], state[row], taken[row] = found[0][k], found[1][k], found[2][k], found[3][k]

    if -1 in at and whole[at[-1]]:
        middle = np.array([at[-1]])
        guess = first[middle]
        if lower is not None:
            guess = run(middle, None, guess)[0]
        put(middle, run(middle, lower, guess))
        if state[at[-1]] in CONVERGED:
            first[:] = p[at[-1]]
    rest = np.array([k for r, k in at.items() if r >= 0 and whole[k]], dtype=int)
    if len(rest):
        put(rest, run(rest, lower, first[rest]))
    problem = Problem(specs, times, names, fixed_names, y, fixed, width)
    every, extra = np.arange(len(replicas)), {}
    for k, f in enumerate(specs):
        extra |= derived(f, problem.local(k, p, every))
    return [(int(r), p[k].tolist(), float(cost[k]), len(points) - len(names), state[k], None if state[k] in CONVERGED else state[k], int(taken[k]), {n: float(v[k]) for n, v in extra.items()}) for r, k in at.items()]
