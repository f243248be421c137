"""Global fits of two form factors over ensembles: correlated, constrained, every replica, all variations in one job.

A point belongs to an ensemble, a form factor and a series. Its model is linear in the coefficients of
    scale / (E + delta) [c0 (1 + chi) + c1 dm + sum e_k (E / scale)^k + sum d_k (scale a)^2k],
with energies, spacings, masses and poles of the replica at hand, so that each replica has a design of its own, while the factor of
the inverse correlation is shared. Where both form factors are fitted they are equal at zero momentum transfer: a . p = 0, with a from the replica's
masses. A reflection that takes a to the first axis gives a basis of all p that obey it, and the fit runs in that basis.

Replicas come as chunks of arrays (name, chunk, first, xs): y/<t> and el/<t> of point t, a_inv/<ensemble>, m_pi/<ensemble>, pole/<form factor>, and
m_pi_phys, f_pi, m_light, m_heavy; replica -1 is the central one. Variations are rows of overrides: which ensembles are dropped, the largest
n2 of an ensemble, another series for an ensemble (or for all, under the name ''), terms that are off, fixed poles, numbers of terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.functions.statistics import bessel_k1

from .covariance import inverse_cholesky
from .resample import ONE_SIGMA, attach

FORM_FACTORS = ("f_zero", "f_plus")
VARIATION = "variation string, drop array<string>, caps map<string, int>, series map<string, string>, disable array<string>, poles map<string, double>, n_e int, n_d int"


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [v.values.to_numpy(zero_copy_only=False) for v in column]


def _arrays(table: pa.Table) -> dict[str, np.ndarray]:
    return dict(zip(table.column("name").to_pylist(), _lists(table.column("xs"))))


def terms_of(disable: list[str], n_e: int, n_d: int) -> list[str]:
    """Names of the coefficients that are fitted: form factor, point, term. disable: such names, or a term alone for both form factors."""
    every = [f"{ff}.{t}" for ff in FORM_FACTORS for t in ("c0", "c1", *[f"e{k}" for k in range(1, n_e + 1)], *[f"d{k}" for k in range(1, n_d + 1)])]
    return [t for t in every if t not in disable and t.split(".")[1] not in disable]


def selected_points(points: DataFrame, variations: DataFrame, series: str) -> DataFrame:
    """points (t, ensemble, form_factor, n2, series, sites), each variation with those that it uses. variations: (VARIATION), a few rows."""
    listed = variations.agg(F.collect_list(F.struct("variation", "drop", "caps", F.col("series").alias("of"))).alias("__v"))
    spread = attach(points, listed).withColumn("v", F.explode("__v")).drop("__v")
    v = lambda c: F.col(f"v.{c}")
    wanted = F.coalesce(v("of")[F.col("ensemble")], v("of")[F.lit("")], F.lit(series))
    dropped = F.coalesce(F.array_contains(v("drop"), F.col("ensemble")), F.lit(False))
    used = ~dropped & (F.col("series") == wanted) & F.coalesce(F.col("n2") <= v("caps")[F.col("ensemble")], F.lit(True))
    return spread.where(used).select(v("variation").alias("variation"), *points.columns)


def block_covariance(points: DataFrame, values: DataFrame, by_form_factor: bool = False) -> DataFrame:
    """Covariance over replicas of the points of one ensemble (and form factor): i, j, cov. A job makes the products of one block and chunk of
    replicas as a matrix; blocks of unlike ensembles are zero and are not made."""
    block = F.concat_ws("/", "ensemble", *["form_factor"] * by_form_factor)
    data = values.where("name like 'y/%'").select(F.substring("name", 3, 20).cast("int").alias("t"), "chunk", "first", "xs")
    met = data.join(points.select("t", block.alias("block")), "t")
    schema = values.sparkSession.createDataFrame([], "i int, j int, product double, a double, b double, n long").schema
    arrow = to_arrow_schema(schema)

    def job(table: pa.Table) -> pa.Table:
        t = table.column("t").to_numpy()
        x = np.stack(_lists(table.column("xs")))
        x = x[:, 1:] if table.column("first")[0].as_py() < 0 else x  # without the central one
        i, j = (v.ravel() for v in np.meshgrid(np.arange(len(t)), np.arange(len(t)), indexing="ij"))
        sums = x.sum(axis=1)
        columns = t[i], t[j], (x @ x.T).ravel(), sums[i], sums[j], np.full(len(i), x.shape[1])
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(columns, arrow)], schema=arrow)

    # about the central value, so that products stay small
    middle = data.where("first < 0").select("t", F.get("xs", F.lit(0)).alias("middle"))
    moved = met.join(middle, "t").select("t", "chunk", "first", "block", F.transform("xs", lambda x: x - F.col("middle")).alias("xs"))
    sums = moved.groupBy("block", "chunk").applyInArrow(job, schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("product", "a", "b", "n")])
    return sums.select("i", "j", ((F.col("product") - F.col("a") * F.col("b") / F.col("n")) / F.col("n")).alias("cov"))


def finite_volume_curve(m: np.ndarray, length: np.ndarray, sites: int) -> np.ndarray:
    """4 m / L times the weighted sum of K1(n m L) / n, a function of m L only beside its factor: interpolated over the replicas' range."""
    z = m * length
    half = sites // 2
    axis = np.arange(half + 1)
    weight = np.where((axis == 0) | (axis == half), 1, 2)
    n2 = (axis[:, None, None] ** 2 + axis[None, :, None] ** 2 + axis[None, None, :] ** 2).ravel()
    w = np.bincount(n2, weights=(weight[:, None, None] * weight[None, :, None] * weight[None, None, :]).ravel())
    n = np.sqrt(np.flatnonzero(w)[1:])
    w = w[w > 0][1:]
    low, high = float(z.min()), float(z.max())

    def exact(zs):
        near = n * low < 700
        return np.array([(w[near] * bessel_k1(n[near] * v) / n[near]).sum() for v in np.atleast_1d(zs)])

    if high - low < 1e-9 * high:
        return 4 * m / length * exact(low)[0]
    curve = np.polynomial.Chebyshev.interpolate(exact, 16, domain=[low, high])
    return 4 * m / length * curve(z)


def chiral_terms(x: dict[str, np.ndarray], ensemble: str, sites: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Chiral and finite-volume corrections of an ensemble against the physical point, for each replica."""
    m, phys, length = x[f"m_pi/{ensemble}"], x["m_pi_phys"], sites / x[f"a_inv/{ensemble}"]
    log = lambda v: 2 * v * v * np.log(np.abs(v / scale))
    factor = -0.75 / (4 * np.pi * x["f_pi"]) ** 2
    return factor * (log(m) - log(phys)), factor * (finite_volume_curve(m, length, sites) - finite_volume_curve(phys, length, sites))


def corrections(points: DataFrame, values: DataFrame, scale: float) -> DataFrame:
    """log/<ensemble> and volume/<ensemble>, chunks as values has them; once for all variations."""
    lattices = points.select("ensemble", "sites").distinct().agg(F.map_from_entries(F.collect_list(F.struct("ensemble", "sites"))).alias("sites"))
    needed = attach(values.where("name like 'a_inv/%' or name like 'm_pi%' or name = 'f_pi'"), lattices)
    arrow = to_arrow_schema(values.schema)

    def job(table: pa.Table) -> pa.Table:
        x, out = _arrays(table), []
        chunk, first = table.column("chunk")[0].as_py(), table.column("first")[0].as_py()
        for e, sites in table.column("sites")[0].as_py():
            for name, v in zip(("log", "volume"), chiral_terms(x, e, sites, scale)):
                out.append({"name": f"{name}/{e}", "chunk": chunk, "first": first, "xs": v})
        return pa.Table.from_pylist(out, schema=arrow)

    return needed.groupBy("chunk").applyInArrow(job, values.schema)


def pole(x: dict[str, np.ndarray], ff: str, poles: dict[str, float]) -> np.ndarray:
    """delta of a form factor: fixed, or from its pole mass and the masses of both mesons."""
    if ff in poles:
        return np.full(len(x["m_heavy"]), poles[ff])
    return 0.5 * ((x[f"pole/{ff}"] ** 2 - x["m_light"] ** 2) / x["m_heavy"] - x["m_heavy"])


def physical_row(energy: np.ndarray, ff: str, terms: list[str], delta: np.ndarray, scale: float) -> np.ndarray:
    """The design (replicas, terms) of a form factor at an energy in the physical limit: no chiral, mass or spacing terms."""
    row = np.zeros((len(energy), len(terms)))
    for k, name in enumerate(terms):
        own, t = name.split(".")
        if own == ff and (t == "c0" or t[0] == "e"):
            row[:, k] = scale / (energy + delta) * (1 if t == "c0" else (energy / scale) ** int(t[1:]))
    return row


def design_of(x: dict[str, np.ndarray], points: list[dict], terms: list[str], v: dict, scale: float) -> np.ndarray:
    """(replicas, points, terms)."""
    n, off = len(x["m_heavy"]), set(v["disable"] or [])
    a = np.zeros((n, len(points), len(terms)))
    deltas = {ff: pole(x, ff, v["poles"]) for ff in FORM_FACTORS}
    for i, p in enumerate(points):
        ff, e, energy = p["form_factor"], p["ensemble"], x[f"el/{p['t']}"]
        log, volume = x[f"log/{e}"], x[f"volume/{e}"]
        on = [0 if {t, f"{ff}.{t}"} & off else 1 for t in ("X", "V")]
        dm = (x[f"m_pi/{e}"] ** 2 - x["m_pi_phys"] ** 2) / scale**2
        for k, name in enumerate(terms):
            own, t = name.split(".")
            if own == ff:
                value = 1 + on[0] * log + on[1] * volume if t == "c0" else dm if t == "c1" else (energy / scale) ** int(t[1:]) if t[0] == "e" else (scale / x[f"a_inv/{e}"]) ** (2 * int(t[1:]))
                a[:, i, k] = scale / (energy + deltas[ff]) * value
    return a


def null_basis(a: np.ndarray) -> np.ndarray:
    """(replicas, n, n - 1): an orthonormal basis of what is orthogonal to each row of a (replicas, n), by a reflection."""
    v = a / np.linalg.norm(a, axis=1, keepdims=True)
    v[:, 0] += np.where(v[:, 0] < 0, -1, 1)
    h = np.eye(a.shape[1]) - 2 * v[:, :, None] * v[:, None, :] / (v * v).sum(axis=1)[:, None, None]
    return h[:, :, 1:]


def solve(design: np.ndarray, y: np.ndarray, sigma: np.ndarray, lower: np.ndarray, at: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Least squares of whitened residuals for every replica, at . p = 0 if ``at`` is given: p and chi-square."""
    a = np.einsum("pq,rpk->rqk", lower, design / sigma[:, None])
    b = (y / sigma) @ lower
    basis = null_basis(at) if at is not None else None
    inside = a if basis is None else a @ basis
    size = np.sqrt((inside * inside).sum(axis=1, keepdims=True))
    q, r = np.linalg.qr(inside / size)
    z = np.linalg.solve(r, np.einsum("rpk,rp->rk", q, b)[..., None])[..., 0] / size[:, 0]
    p = z if basis is None else np.einsum("rnk,rk->rn", basis, z)
    left = np.einsum("rpk,rk->rp", a, p) - b
    return p, (left * left).sum(axis=1)


def fit_variations(points: DataFrame, values: DataFrame, variations: DataFrame, scale: float, series: str, constrained: bool = True, by_form_factor: bool = False) -> DataFrame:
    """A row for each variation and replica, with its chunk: terms (names), params, chi_sq, dof, gap (how far the constraint is from zero, relative to its
    terms; null without one). points: (t int, ensemble, form_factor, n2, series, sites)."""
    used = selected_points(points, variations, series)
    cov = block_covariance(points, values, by_form_factor)
    own = cov.join(used.select("variation", F.col("t").alias("i")), "i").join(used.select("variation", F.col("t").alias("j")), ["variation", "j"])
    chol = inverse_cholesky(own.select("variation", "i", "j", "cov"), ("variation",)).where("chol <> 0 or i = j")
    factor = chol.groupBy("variation").agg(F.collect_list(F.struct("i", "j", "chol", "sigma")).alias("factor"))
    listed = used.groupBy("variation").agg(F.array_sort(F.collect_list(F.struct("t", "ensemble", "form_factor", "sites"))).alias("points"))
    heads = variations.join(listed, "variation").join(factor, "variation")
    of_point = values.withColumn("t", F.regexp_extract("name", r"^(?:y|el)/(\d+)$", 1))
    of_point = of_point.withColumn("t", F.when(F.col("t") != "", F.col("t").cast("int")))
    mine = of_point.where("t is not null").join(used.select("variation", "t"), "t").select("variation", "chunk", "first", "name", "xs")
    all_v = variations.agg(F.collect_list("variation").alias("__v"))
    shared = of_point.where("t is null").select(*values.columns).unionByName(corrections(points, values, scale))
    rest = attach(shared, all_v).select(F.explode("__v").alias("variation"), "chunk", "first", "name", "xs")
    chunks = values.select("chunk").distinct().agg(F.array_sort(F.collect_list("chunk")).alias("__c"))
    heads = attach(heads, chunks).select(F.col("variation").alias("of"), F.explode("__c").alias("of_chunk"), "disable", "poles", "n_e", "n_d", "points", "factor")
    kind = values.sparkSession.createDataFrame([], "variation string, chunk int, replica int, terms array<string>, params array<double>, chi_sq double, dof int, gap double").schema
    arrow = to_arrow_schema(kind)

    def job(key: tuple, table: pa.Table, head: pa.Table) -> pa.Table:
        if not head.num_rows or not table.num_rows:
            return arrow.empty_table()
        v, x = head.to_pylist()[0], _arrays(table)
        v["poles"] = dict(v["poles"] or [])
        terms, pts = terms_of(v["disable"] or [], v["n_e"], v["n_d"]), v["points"]
        found = [ff for ff in FORM_FACTORS if any(p["form_factor"] == ff for p in pts)]
        terms = [t for t in terms if t.split(".")[0] in found]
        place = {p["t"]: k for k, p in enumerate(pts)}
        lower, sigma = np.zeros((len(pts), len(pts))), np.zeros(len(pts))
        for e in v["factor"]:
            lower[place[e["i"]], place[e["j"]]], sigma[place[e["i"]]] = e["chol"], e["sigma"]
        at = constraint_of(x, terms, v["poles"], scale) if constrained and len(found) == 2 else None
        p, chi_sq = solve(design_of(x, pts, terms, v, scale), np.stack([x[f"y/{q['t']}"] for q in pts], axis=1), sigma, lower, at)
        n, first = len(p), table.column("first")[0].as_py()
        gap = None if at is None else np.abs((at * p).sum(axis=1)) / np.abs(at * p).sum(axis=1)
        dof = len(pts) - len(terms) + (at is not None)
        columns = [[key[0].as_py()] * n, [key[1].as_py()] * n, np.arange(first, first + n), [terms] * n, p.tolist(), chi_sq, np.full(n, dof), [None] * n if gap is None else gap]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return mine.unionByName(rest).groupBy("variation", "chunk").cogroup(heads.groupBy("of", "of_chunk")).applyInArrow(job, kind)


def constraint_of(x: dict[str, np.ndarray], terms: list[str], poles: dict[str, float], scale: float) -> np.ndarray:
    """a, (replicas, terms): both form factors' difference at zero momentum transfer is a . p."""
    energy = (x["m_heavy"] ** 2 + x["m_light"] ** 2) / (2 * x["m_heavy"])
    rows = [physical_row(energy, ff, terms, pole(x, ff, poles), scale) for ff in FORM_FACTORS]
    return rows[0] - rows[1]


def band(fits: DataFrame, values: DataFrame, variations: DataFrame, scale: float, ticks: int = 200) -> DataFrame:
    """The curves of every variation and form factor with bounds: variation, form_factor, tick, q2, and y and plain (without the pole) as structs
    (min, low, central, high, max). Ticks go evenly from momentum transfer 0 (tick 0) to the largest, (m_heavy - m_light)^2, of the central
    replica. Curves are matrices (ticks, replicas) of a chunk; a job then has all replicas of one curve's tick and takes the order
    statistics by partial selection, not by sorting."""
    constants = values.where("name in ('m_light', 'm_heavy') or name like 'pole/%'")
    edge = constants.where("first < 0 and name like 'm%'").groupBy().agg(*[F.max(F.when(F.col("name") == n, F.get("xs", F.lit(0)))).alias(n) for n in ("m_light", "m_heavy")])
    span = edge.select(F.pow(F.col("m_heavy") - F.col("m_light"), F.lit(2.0)).alias("__span"))
    rows = attach(fits.join(variations.select("variation", "poles"), "variation"), span).select("variation", "chunk", "replica", "terms", "params", "poles", F.col("__span").alias("span"))
    one = constants.select(F.col("chunk").alias("of_chunk"), "first", "name", "xs")
    kinds = rows.select("variation", "chunk").distinct()
    one = kinds.select(F.col("variation").alias("of"), F.col("chunk").alias("of_chunk")).join(one, "of_chunk")
    kind = values.sparkSession.createDataFrame([], "variation string, form_factor string, tick int, q2 double, first int, y array<double>, plain array<double>").schema
    arrow = to_arrow_schema(kind)

    def job(key: tuple, table: pa.Table, constant: pa.Table) -> pa.Table:
        if not table.num_rows or not constant.num_rows:
            return arrow.empty_table()
        table = table.sort_by("replica")
        x = _arrays(constant)
        p, terms, poles = np.stack(_lists(table.column("params"))), table.column("terms")[0].as_py(), dict(table.column("poles")[0].as_py() or [])
        first, out = table.column("replica")[0].as_py(), []
        for ff in sorted({t.split(".")[0] for t in terms}):
            delta = pole(x, ff, poles)
            for k in range(ticks + 1):
                q2 = table.column("span")[0].as_py() * k / ticks
                energy = (x["m_heavy"] ** 2 + x["m_light"] ** 2 - q2) / (2 * x["m_heavy"])
                y = (physical_row(energy, ff, terms, delta, scale) * p).sum(axis=1)
                out.append((key[0].as_py(), ff, k, q2, first, y, y * (energy + delta) / scale))
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), arrow)], schema=arrow)

    curves = rows.groupBy("variation", "chunk").cogroup(one.groupBy("of", "of_chunk")).applyInArrow(job, kind)
    bounds = "struct<min: double, low: double, central: double, high: double, max: double>"
    result = values.sparkSession.createDataFrame([], f"variation string, form_factor string, tick int, q2 double, y {bounds}, plain {bounds}").schema
    final = to_arrow_schema(result)

    def bound(key: tuple, table: pa.Table) -> pa.Table:
        first = table.column("first").to_pylist()
        out = {"variation": key[0].as_py(), "form_factor": key[1].as_py(), "tick": key[2].as_py(), "q2": table.column("q2")[0].as_py()}
        for c in ("y", "plain"):
            parts = _lists(table.column(c))
            central = next((v[0] for v, f in zip(parts, first) if f < 0), float("nan"))
            v = np.concatenate([v[1:] if f < 0 else v for v, f in zip(parts, first)])
            v = v[np.isfinite(v)]
            if len(v):
                k = int(np.floor(ONE_SIGMA * len(v) + 0.5))
                v = np.partition(v, [0, k, len(v) - 1 - k, len(v) - 1])
                out[c] = {"min": v[0], "low": v[k], "central": central, "high": v[-1 - k], "max": v[-1]}
            else:
                out[c] = dict.fromkeys(("min", "low", "high", "max"), central) | {"central": central}
        return pa.Table.from_pylist([out], schema=final)

    return curves.groupBy("variation", "form_factor", "tick").applyInArrow(bound, result)


def variation_table(spark, rows: dict[str, dict], n_e: int, n_d: int) -> DataFrame:
    """VARIATION rows from overrides by name; what a row does not name is as in the reference fit."""
    full = {"drop": [], "caps": {}, "series": {}, "disable": [], "poles": {}, "n_e": n_e, "n_d": n_d}
    return spark.createDataFrame([(name, *(full | r).values()) for name, r in rows.items()], VARIATION)


def named_params(fits: DataFrame) -> DataFrame:
    """variation, replica, name, value."""
    pairs: Column = F.explode(F.arrays_zip("terms", "params")).alias("p")
    return fits.select("variation", "replica", pairs).select("variation", "replica", F.col("p.terms").alias("name"), F.col("p.params").alias("value"))
