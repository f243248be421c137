"""Joint and batched fits against known parameters, plain arrays and one-by-one fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import joint as jt
from corvane.plans import q_fits

NT, DT = 64, 20
#: Two-exponential truth; amplitudes by the fit's norm, which divides by twice the energy.
TRUTH = {"E0": 0.8, "E1": 1.2, "A0": np.sqrt(50 * 1.6), "A1": np.sqrt(25 * 2.4), "B0": np.sqrt(100 * 1.6), "B1": -np.sqrt(200 * 2.4), "F0": 0.6, "C0": 5.0, "M": 1.7, "K": 3.25}

TRUTH = {n: float(v) for n, v in TRUTH.items()}


def spec(series, model, params, src=1, snk=1, nt=NT, dt=DT):
    return (series, model, src, snk, nt, dt, params)


SPECS = [
    spec("a", "cosh", ["E0", "E1", "A0", "A1"], 2), spec("b", "cosh", ["E0", "E1", "B0", "B1"], 2), spec("c", "exp", ["F0", "C0"], nt=0), spec("d", "3pt", ["E0", "F0", "A0", "C0", "M"]),
    spec("r", "r3", ["E0", "F0", "A0", "C0", "M"]), spec("z", "zv", ["F0", "F0", "C0", "C0", "M"]), spec("k", "const", ["K"]),
]


def theory(s, t):
    keys = [x.split()[0] for x in jt.SPEC.split(", ")]
    one = dict(zip(keys, s))
    return jt.MODELS[s[1]]([np.array([[TRUTH[n]]]) for n in s[6]], np.asarray(t, dtype=float)[None, :], one)[0]


def frames(spark, noise, replicas):
    rng = np.random.default_rng(5)
    rows = []
    for s in SPECS:
        t = np.arange(1, 13) if s[1] in ("cosh", "exp") else np.arange(4, 17)
        x = theory(s, t)
        rows += [(s[0], r, int(u), float(v * (1 + noise * rng.normal() * (r >= 0))), float(abs(v) * 1e-3)) for r in range(-1, replicas) for u, v in zip(t, x)]
    points = spark.createDataFrame(rows, "series string, replica int, t int, x double, sigma double")
    specs = jt.linked_fits(spark.createDataFrame(SPECS, jt.SPEC))
    begin = {n: v * 1.05 for n, v in TRUTH.items()}
    start = jt.positions(specs).select("fit_id", "name").join(spark.createDataFrame(list(begin.items()), "name string, value double"), "name")
    return points.join(specs.select("series", "fit_id"), "series"), specs, start


def test_truth_comes_back_from_one_joint_fit(spark):
    points, specs, start = frames(spark, 0.0, 0)
    assert specs.select("series", "fit_id").distinct().groupBy("fit_id").count().orderBy("fit_id").collect() == [("a", 6), ("k", 1)]
    found = jt.fit_joint(points, specs, start)
    got = {r["name"]: r["value"] for r in jt.named(found, jt.positions(specs)).collect()}
    assert set(got) == set(TRUTH) and all(np.isclose(got[n], v, rtol=1e-7) for n, v in TRUTH.items())
    one = found.where("fit_id = 'a'").first()
    assert one["error"] is None and one["chi_sq"] < 1e-12 and one["dof"] == 12 * 3 + 13 * 3 - 9
    assert np.isclose(one["derived"]["z.ZV"], 2 * 0.6 / 1.7) and np.isclose(one["derived"]["r.EDiff"], -0.2) and np.isclose(one["derived"]["r.R3Raw"], 1.7 / (TRUTH["A0"] * 5))


def test_nothing_shared_equals_separate_fits(spark):
    points, specs, start = frames(spark, 1e-3, 3)
    apart = specs.withColumns({"fit_id": F.col("series"), "params": F.transform("params", lambda x: F.concat("series", F.lit("."), x))})
    begin = spark.createDataFrame([(f"{s[0]}.{n}", TRUTH[n] * 1.02) for s in SPECS for n in s[6]], "name string, value double").distinct()
    only = apart.where("series in ('a', 'c', 'k')")
    own = points.where("series in ('a', 'c', 'k')")
    each = jt.fit_joint(own.withColumn("fit_id", F.col("series")), only, jt.positions(only).join(begin, "name"))
    one = only.withColumn("fit_id", F.lit("all"))
    together = jt.fit_joint(own.withColumn("fit_id", F.lit("all")), one, jt.positions(one).join(begin, "name"))
    a = {(r["replica"], r["name"]): r["value"] for r in jt.named(each, jt.positions(only)).collect()}
    b = {(r["replica"], r["name"]): r["value"] for r in jt.named(together, jt.positions(one)).collect()}
    assert a.keys() == b.keys() and all(np.isclose(a[k], b[k], rtol=1e-6) for k in a)


def test_ten_thousand_replicas_equal_one_by_one_fits(spark):
    """Correlated fits of a falling exponential and a constant with one fixed parameter, in ten chunks."""
    n, t = 10_000, np.arange(1, 9)
    noise = (F.shiftrightunsigned(F.xxhash64("replica", "t", "series"), 11).cast("double") / float(1 << 53) - 0.5) * 0.02
    base = spark.range(-1, n).select(F.col("id").cast("int").alias("replica")).crossJoin(spark.createDataFrame([(s, int(u)) for s in "ab" for u in t], "series string, t int"))
    value = F.when(F.col("series") == "a", 50 / 1.6 * F.exp(-0.8 * F.col("t"))).otherwise(F.lit(2.0))
    points = base.select(F.lit("f").alias("fit_id"), "replica", "series", "t", (value * (1 + noise)).alias("x"), (value * 0.01).alias("sigma"))
    specs = spark.createDataFrame([("f", *spec("a", "exp", ["E", "A"])), ("f", *spec("b", "misc", ["A2", "B", "C"]))], "fit_id string, " + jt.SPEC)
    start = spark.createDataFrame([("f", "E", 0.7), ("f", "A", 6.0), ("f", "A2", 1.0)], "fit_id string, name string, value double")
    fixed = spark.createDataFrame([("f", -1, "B", 0.5), ("f", -1, "C", 4.0), ("f", 7, "B", 0.25)], "fit_id string, replica int, name string, value double")
    m = np.eye(16) + 0.3 * np.exp(-np.abs(np.subtract.outer(np.arange(16), np.arange(16))))
    lower = np.linalg.cholesky(np.linalg.inv(m))
    place = [(s, int(u)) for s in "ab" for u in t]
    chol = spark.createDataFrame([("f", *place[i], *place[j], float(lower[i, j])) for i in range(16) for j in range(i + 1)], "fit_id string, series_i string, i int, series_j string, j int, chol double")
    found = jt.fit_joint(points, specs, start, chol, fixed).toPandas().set_index("replica").sort_index()
    assert len(found) == n + 1 and found.error.isna().all() and set(found.state) <= set(jt.CONVERGED)
    names = sorted(["E", "A", "A2"])
    wide = points.where("replica in (-1, 7) or replica % 97 = 0").toPandas()
    for r, g in wide.groupby("replica"):
        g = g.sort_values(["series", "t"])
        keep = {"B": 0.25 if r == 7 else 0.5, "C": 4.0}
        x, s = g.x.to_numpy(), g.sigma.to_numpy()

        def residual(p, x=x, s=s, keep=keep):
            v = dict(zip(names, p)) | keep
            f = np.concatenate([v["A"] ** 2 / (2 * v["E"]) * np.exp(-v["E"] * t), v["A2"] * (1 + v["B"] * np.exp(-v["C"] * t))])
            return lower.T @ ((f - x) / s)

        p = np.array([6.0, 1.0, 0.7])
        for _ in range(60):  # Gauss-Newton from near by, derivatives by differences
            j = np.array([(residual(p + h) - residual(p - h)) / 2e-5 for h in 1e-5 * np.eye(3)]).T
            p = p - np.linalg.lstsq(j, residual(p), rcond=None)[0]
        assert np.allclose(found.params[r], p, rtol=1e-9), r
        assert np.isclose(found.chi_sq[r], residual(p) @ residual(p), rtol=1e-9)


class Odd:
    """Residuals for which every step is rejected, or that have no bottom."""

    def __init__(self, f, y=1.0):
        self.f, self.y, self.sigma = f, np.full((1, 1), y), np.ones(1)

    def white(self, r):
        return r

    def residual(self, p, rows):
        return self.f(p)

    def jacobian(self, p, rows):
        return np.ones((len(p), 1, p.shape[1]))


@pytest.mark.parametrize("f,state", [
    (lambda p: np.where(p == 0, 1.0, 2.0), "no step improves"), (lambda p: np.exp(-p * 1e-3) + 1, "too many steps"), (lambda p: np.full_like(p, np.nan), "not finite"), (lambda p: p - 3, "gradient"),
])
def test_ends_that_are_no_minimum_are_told(f, state):
    p, cost, found, _ = jt.minimise(Odd(f), np.zeros((1, 1)), 40)
    assert found == [state]


def test_steps_that_run_out_are_an_error(spark):
    points, specs, start = frames(spark, 1e-3, 2)
    found = jt.fit_joint(points, specs, start, steps=1).where("fit_id = 'a'").collect()
    assert {r["error"] for r in found} == {"too many steps"}


def test_missing_points_and_start_values_are_errors(spark):
    points, specs, start = frames(spark, 1e-3, 2)
    holes = jt.fit_joint(points.where("not (replica = 1 and series = 'c' and t = 3)"), specs, start, retries=3).collect()
    assert {(r["fit_id"], r["replica"]) for r in holes if r["error"]} == {("a", 1)}
    none = jt.fit_joint(points, specs, start.where("name <> 'K'")).where("fit_id = 'k'").collect()
    assert {r["error"] for r in none} == {"no start value for K"}


def test_query_equals_arrays(spark, sf_dir):
    points = q_fits.joint_series(spark, sf_dir)[0].where("replica = 3").toPandas()
    got = q_fits.j12_joint_fit(spark, sf_dir).where("replica = 3").toPandas()
    assert got.error.isna().all() and set(got.dof) == {5, 9}
    for flag, g in points.groupby("corr_id"):
        value = got.set_index("name").value
        e = value[f"{flag}_E"]
        cost, slope = 0.0, 0.0
        for part, name in (("re", "A"), ("im", "B")):
            s = g[g.series == f"{flag}_{part}"]
            t, w, a = s.t.to_numpy(dtype=float), s.sigma.to_numpy(), value[f"{flag}_{name}"]
            f = a * a / (2 * e) * np.exp(-e * t)
            r = (f - s.x.to_numpy()) / w
            assert abs(r @ (2 * f / a / w)) < 1e-6 * np.linalg.norm(2 * f / a / w)  # no slope in its amplitude
            cost, slope = cost + r @ r, slope + r @ (f * (-1 / e - t) / w)
        assert abs(slope) < 1e-4 * max(1, cost)
        assert np.isclose(got.set_index("name").chi_sq[f"{flag}_E"], cost)
        k = g[g.series == f"{flag}_ratio"]
        assert np.isclose(value[f"{flag}_K"], (k.x / k.sigma**2).sum() / (1 / k.sigma**2).sum())
