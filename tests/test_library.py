"""Properties and closed forms of what SQL cannot express."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.functions import kinematics as kn
from corvane.functions import statistics as st
from corvane.operators import covariance as cv
from corvane.operators import fits as ft
from corvane.operators import resample as rs
from corvane.operators import series as sr
from corvane.sources import files as fl


@pytest.fixture(scope="module")
def binned(spark):
    rng = np.random.default_rng(1)
    rows = [("a", b, t, float(rng.normal(10 - t, 1)), float(rng.normal()), 1) for b in range(20) for t in range(6)]
    return spark.createDataFrame(rows, "corr_id string, bin int, t int, re double, im double, n int").cache()


def matrix(df, value="re"):
    return df.toPandas().pivot(index="replica", columns="t", values=value)


def test_jackknife_mean_is_central(binned):
    j = matrix(rs.jackknife(binned))
    assert np.allclose(j.loc[0:].mean(), j.loc[-1])


def test_jackknife_needs_two_bins(binned):
    with pytest.raises(Exception, match="two bins"):
        rs.jackknife(binned.where("bin = 0")).collect()


def test_boot_index_counts(spark):
    i = rs.boot_index(spark, 5, 30, 7).toPandas()
    assert (i.groupby("replica").size() == 30).all() and i.bin.between(0, 29).all()


def test_matrix_path_equals_join_path(spark, binned):
    got = rs.bootstrap(binned, 3, 9).toPandas().set_index("replica")
    rng = np.random.Generator(np.random.PCG64([9, 20, 0]))
    draws = rng.integers(0, 20, size=(3, 20))
    index = spark.createDataFrame([(9, r, d, int(b)) for r in range(3) for d, b in enumerate(draws[r])], "seed long, replica int, draw int, bin int")
    joined = matrix(rs.bootstrap_join(binned, index))
    for r in range(3):
        assert np.allclose(got.loc[r, "re"], joined.loc[r], atol=1e-12)


def test_poisson_bootstrap_has_the_spread_of_the_mean(binned):
    p = rs.bootstrap_poisson(binned, 400, 3).where("t = 0").toPandas().re
    x = binned.where("t = 0").toPandas().re
    assert abs(p.std() / (x.std() / math.sqrt(20)) - 1) < 0.25


def test_stats_order_rule(spark):
    x = spark.createDataFrame([("a", 0, r, float((r * 37) % 101)) for r in range(101)] + [("a", 0, -1, 500.0)], "corr_id string, t int, replica int, re double")
    got = rs.stats(x).first()
    k = math.floor(0.158655 * 101 + 0.5)
    assert (got["min"], got["low"], got["central"], got["high"], got["max"], got["check"]) == (0, k, 500, 100 - k, 100, 1)


def test_stats_without_replicas(spark):
    got = rs.stats(spark.createDataFrame([("a", 0, -1, 2.0)], "corr_id string, t int, replica int, re double")).first()
    assert got["low"] == got["high"] == 2 and got["check"] == 1


def test_stats_drops_what_is_not_finite(spark):
    rows = [("a", 0, r, float("nan") if r % 2 else float(r)) for r in range(10)] + [("a", 0, -1, 1.0)]
    got = rs.stats(spark.createDataFrame(rows, "corr_id string, t int, replica int, re double")).first()
    assert got["check"] == 0.5 and got["max"] == 8


def test_fold_of_an_even_series_keeps_it(spark):
    x = spark.createDataFrame([("a", 0, t, float(min(t, 8 - t) + 1), 0.0) for t in range(8)], "corr_id string, replica int, t int, re double, im double")
    got = {r["t"]: r["x"] for r in sr.fold(x, 8).collect()}
    assert got == {t: t + 1.0 for t in range(5)}


def test_covariance_equals_numpy(binned):
    got = cv.covariance(binned, "bin", "sample", "re").toPandas().pivot(index="i", columns="j", values="cov").to_numpy()
    want = np.cov(binned.toPandas().pivot(index="bin", columns="t", values="re").to_numpy().T)
    assert np.allclose(got, want) and np.linalg.eigvalsh(got).min() > -1e-12


def test_inverse_cholesky(binned):
    cov = cv.covariance(binned, "bin", "sample", "re")
    got = cv.inverse_cholesky(cov).toPandas()
    inverse = got.pivot(index="i", columns="j", values="inverse").to_numpy()
    lower = got.pivot(index="i", columns="j", values="chol").to_numpy()
    r = cv.correlation(cov).toPandas().pivot(index="i", columns="j", values="corr").to_numpy()
    assert np.allclose(inverse @ r, np.eye(6)) and np.allclose(lower @ lower.T, inverse)


def test_singular_correlation_has_a_pseudo_inverse(spark):
    x = spark.createDataFrame([("a", b, t, float(b)) for b in range(5) for t in range(2)], "corr_id string, bin int, t int, re double")
    got = cv.inverse_cholesky(cv.covariance(x, "bin", "sample", "re")).toPandas().pivot(index="i", columns="j", values="inverse").to_numpy()
    assert np.allclose(got, np.full((2, 2), 0.25))


@pytest.mark.parametrize(("x", "dof", "q"), [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (18.307038053275146, 10, 0.05), (24.995790139728616, 15, 0.05)])
def test_chi_square_points(x, dof, q):
    assert abs(st.chi_square_tail(np.array([x]), np.array([dof]))[0] - q) < 1e-10


def test_hotelling():
    assert abs(st.hotelling_tail(2.0 * 2.0, 1, 10) - 0.0733880348) < 1e-7  # two-sided t of 2 with 10 degrees of freedom
    assert st.hotelling_tail(3.0, 5, 4) == pytest.approx(st.chi_square_tail(np.array([3.0]), np.array([5]))[0])


def test_bessel_k1():
    assert np.allclose(st.bessel_k1(np.array([0.1, 1.0, 5.0])), [9.853844780870606, 0.6019072301972346, 0.004044613445452164], rtol=1e-7)


def test_value_error_text(spark):
    rows = [(0.123456, 0.1228, 0.1241), (1234567.0, 1234000.0, 1235000.0), (-3.0, -4.0, -2.0), (5.0, 6.0, 8.0)]
    df = spark.createDataFrame(rows, "c double, lo double, hi double")
    got = [r[0] for r in df.select(st.fmt_val_err(F.col("c"), F.col("lo"), F.col("hi"))).collect()]
    assert got == ["0.12346(65)", "(1.23457(50))e6", "-3.0(10)", "5.0(-10)"]


def test_p2_components_may_fail(spark):
    got = spark.range(13).select(kn.p2_components(F.col("id").cast("int")).alias("c")).toPandas().c
    assert got[12] is None and got[7] is None and tuple(got[9]) == (3, 0, 0)


def test_dispersion_inverse(spark):
    m, z = F.col("m"), F.lit(0)
    df = spark.createDataFrame([(0.4,), (1.3,)], "m double")
    for kind in ("continuum", "lattice", "lattice_no_sin"):
        e = kn.dispersion(m, 24, F.lit(2), F.lit(1), z, kind)
        got = df.withColumn("e", e).select("m", kn.dispersion(F.col("e"), 24, F.lit(2), F.lit(1), z, kind, inverse=True)).toPandas()
        assert np.allclose(got.iloc[:, 0], got.iloc[:, 1])


def test_unknown_quark_is_an_error(spark):
    with pytest.raises(Exception, match="unknown quark"):
        spark.createDataFrame([("q",)], "q string").select(kn.quark_weight(F.col("q"))).collect()


def two_levels(jitter, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(33)
    truth = [(0.8, 50.0), (1.2, 25.0)]
    wave = sum(a * (np.exp(-e * t) + np.exp(-e * (64 - t))) for e, a in truth)
    return [("a", r, int(k), float(wave[k] * (1 + jitter * (r >= 0) * rng.normal())), float(wave[k] * 1e-3)) for r in range(-1, 3) for k in range(2, 14)]


def test_fit_recovers_the_truth(spark):
    p = spark.createDataFrame(two_levels(0.0), "fit_id string, replica int, t int, x double, sigma double")
    got = ft.fit_replicas(p, "cosh", 64, [0.7, 8.0, 1.5, 8.0]).toPandas()
    assert len(got) == 4 and got.error.isna().all()
    for v in got.params:
        assert np.allclose(v, [0.8, math.sqrt(50 * 1.6), 1.2, math.sqrt(25 * 2.4)], rtol=1e-3)


def test_fit_line_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    rows = [("a", 0, t, 2.0 + 0.5 * t + rng.normal() * 0.1, 0.1 + 0.01 * t) for t in range(8)]
    p = spark.createDataFrame(rows, "corr_id string, replica int, t int, x double, sigma double")
    a = ft.fit_line(p).first()
    b = ft.fit_linear(p.withColumn("row", F.array(F.lit(1.0), F.col("t").cast("double")))).first()
    assert np.allclose([a["intercept"], a["slope"], a["chi_sq"]], [*b["params"], b["chi_sq"]]) and a["dof"] == b["dof"] == 6


def test_semi_frozen_keeps_each_replicas_variance(spark, binned):
    index = rs.boot_index(spark, 1, 20, 3)
    own = cv.resampled_covariance(binned.withColumn("x", F.col("re")), index)
    semi = cv.frozen_modes(cv.covariance(binned, "bin", "raw_binned", "re"), own, "semi")
    a, b = (d.where("i = j").toPandas().set_index(["replica", "i"])["cov"].sort_index() for d in (own, semi))
    assert np.allclose(a, b)


def test_write_samples_skips(spark, binned, tmp_path):
    path = str(tmp_path / "s")
    assert fl.write_samples(binned, path) and not fl.write_samples(binned, path) and fl.write_samples(binned, path, overwrite=True)
    assert fl.load_samples(spark, path).count() == 120


def test_key_values(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# note\na 1 2\n\nb # only\na 3\n")
    assert fl.read_kv(spark, str(tmp_path), multi=True).count() == 3
    with pytest.raises(Exception, match="key comes twice"):
        fl.read_kv(spark, str(tmp_path)).collect()


def test_rehydrate_uses_what_is_stored(spark, binned):
    index = rs.boot_index(spark, 1, 20, 6)
    stored = rs.bootstrap_join(binned, index)
    assert rs.rehydrated(stored, None, index, 4).where("replica >= 0").select("replica").distinct().count() == 4
    with pytest.raises(ValueError, match="stored"):
        rs.rehydrated(stored, None, index, 9)


def test_finite_volume_equals_a_plain_sum(spark):
    got = st.finite_volume(spark.createDataFrame([(1, 0.3, 6.0)], "k int, m double, l double"), "m", "l", 4, ["k"]).first()["fv"]
    total = 0.0
    for x in range(3):
        for y in range(3):
            for z in range(3):
                if x or y or z:
                    w = np.prod([1 if c in (0, 2) else 2 for c in (x, y, z)])
                    n = math.sqrt(x * x + y * y + z * z)
                    total += w * float(st.bessel_k1(np.array([n * 1.8]))[0]) / n
    assert got == pytest.approx(4 * 0.3 / 6 * total)


def test_parametric_replicas(spark):
    c = spark.createDataFrame([("a", 2.0, 0.5)], "name string, value double, sigma double")
    p = rs.parametric_replicas(c, 2000, 3).toPandas()
    v = p[p.replica >= 0].value
    assert p[p.replica == -1].value.iloc[0] == 2 and abs(v.mean() - 2) < 0.05 and abs(v.std() - 0.5) < 0.03
    assert isinstance(p, pd.DataFrame)


def symmetric(spark, blocks):
    """Matrices (name -> array) as rows corr_id, i, j, cov."""
    rows = [(name, i, j, float(m[i, j])) for name, m in blocks.items() for i in range(len(m)) for j in range(len(m))]
    return spark.createDataFrame(rows, "corr_id string, i int, j int, cov double")


def test_condition_of_two_by_two_blocks(spark):
    blocks = {"a": np.array([[4.0, 1.0], [1.0, 3.0]]), "b": np.array([[2.0, 0.0], [0.0, -8.0]]), "c": np.array([[1.0, 0.5], [0.5, 1.0]])}
    found = {r.corr_id: r for r in cv.block_condition(symmetric(spark, blocks)).collect()}
    for name, ((a, b), (_, d)) in blocks.items():
        half = math.sqrt((a - d) ** 2 / 4 + b * b)
        low, high = (a + d) / 2 - half, (a + d) / 2 + half
        assert np.allclose(found[name].eigenvalues, [low, high])
        assert found[name].condition == pytest.approx(max(abs(low), abs(high)) / min(abs(low), abs(high)))


def test_whitened_residuals_square_to_chi_square(spark):
    rng = np.random.default_rng(5)
    mats = {n: (lambda x: x @ x.T + np.eye(4))(rng.normal(size=(4, 4))) for n in ("a", "b")}
    r = rng.normal(size=(2, 3, 4))
    rows = [(n, k, t, float(r[x, k, t])) for x, n in enumerate(mats) for k in range(3) for t in range(4)]
    residual = spark.createDataFrame(rows, "corr_id string, replica int, t int, r double")
    w = cv.whiten(residual, cv.inverse_cholesky(symmetric(spark, mats))).toPandas()
    assert len(w) == 2 * 3 * 4
    for x, (n, c) in enumerate(mats.items()):
        s = np.sqrt(np.diag(c))
        factor = np.linalg.cholesky(np.linalg.inv(c / np.outer(s, s)))
        for k in range(3):
            one = w[(w.corr_id == n) & (w.replica == k)].sort_values("j").w.to_numpy()
            assert np.allclose(one, factor.T @ (r[x, k] / s))
            assert one @ one == pytest.approx(r[x, k] @ np.linalg.solve(c, r[x, k]))


def test_fit_stats_closed_forms_of_two_degrees(spark):
    chi, size = [0.0, 0.5, 3.0, 12.0], 100
    fits = spark.createDataFrame([(k, c, d) for k, c in enumerate(chi) for d in (0, 2)], "fit_id int, chi_sq double, dof int")
    for f in ft.fit_stats(fits, size).collect():
        if f.dof == 0:
            assert (f.chi_sq_dof, f.pvalue, f.pvalue_h) == (f.chi_sq, 1.0, 1.0)
            continue
        m = size - 1
        below = m - 2 + 1  # F of (2, below) degrees: its tail is a power
        assert f.chi_sq_dof == pytest.approx(f.chi_sq / 2)
        assert f.pvalue == pytest.approx(math.exp(-f.chi_sq / 2), rel=1e-9)
        assert f.pvalue_h == pytest.approx((1 + f.chi_sq / m) ** (-below / 2), rel=1e-9)


def solved(rows, x, sigma):
    """Normal equations of a weighted line: parameters and chi-square."""
    a, w = np.array(rows), 1 / np.array(sigma) ** 2
    p = np.linalg.solve(a.T @ (w[:, None] * a), a.T @ (w * x))
    return p, float(w @ (a @ p - x) ** 2)


def test_variations_equal_normal_equations(spark):
    rng = np.random.default_rng(8)
    names, basis, sigma = ["A", "A", "B", "B", "C", "C", "C"], [[1.0, float(t)] for t in range(7)], (0.5 + rng.random(7)).tolist()
    x = rng.normal(size=(2, 7))
    rows = [(k - 1, t, names[t], float(x[k, t]), sigma[t], basis[t]) for k in range(2) for t in range(7)]
    design = spark.createDataFrame(rows, "replica int, t int, ensemble string, x double, sigma double, row array<double>")
    drops = {"all": [], "no_a": ["A"], "no_bc": ["B", "C"]}
    out = ft.run_variations(design, spark.createDataFrame(list(drops.items()), "variation string, drop array<string>")).collect()
    assert sorted((r.variation, r.replica) for r in out) == sorted((v, k) for v in drops for k in (-1, 0))
    for r in out:
        at = [t for t in range(7) if names[t] not in drops[r.variation]]
        p, chi = solved([basis[t] for t in at], x[r.replica + 1, at], [sigma[t] for t in at])
        assert np.allclose(r.params, p) and r.chi_sq == pytest.approx(chi, abs=1e-9) and r.dof == len(at) - 2


def test_chunked_variations_equal_normal_equations(spark):
    basis, sigma = [[1.0, float(t), float(t * t)] for t in range(6)], [0.5, 1.0, 0.7, 1.2, 0.9, 0.6]
    points = spark.createDataFrame([(t, 3.0 - t, sigma[t]) for t in range(6)], "t int, x double, sigma double")
    values = ft.gaussian_chunks(points, 25, 3, chunk=10).cache()
    x = {}
    for r in values.collect():
        for k, v in enumerate(r.xs):
            x[r.first + k, r.t] = v
    assert {k for k, _ in x} == set(range(-1, 25)) and [x[-1, t] for t in range(6)] == [3.0 - t for t in range(6)]
    sets = {"all": list(range(6)), "late": list(range(1, 6))}
    design = spark.createDataFrame([(v, t, sigma[t], basis[t]) for v, ts in sets.items() for t in ts], "variation string, t int, sigma double, row array<double>")
    out = ft.fit_linear_chunks(design, values).collect()
    assert sorted((r.variation, r.replica) for r in out) == sorted((v, k) for v in sets for k in range(-1, 25))
    for r in out:
        at = sets[r.variation]
        p, chi = solved([basis[t] for t in at], np.array([x[r.replica, t] for t in at]), [sigma[t] for t in at])
        assert np.allclose(r.params, p) and r.chi_sq == pytest.approx(chi, abs=1e-9) and r.dof == len(at) - 3


def test_resampled_covariance_of_ten_thousand_replicas(spark):
    """In blocks of bins and chunks of replicas, against plain arrays; no row for each replica, bin and pair of times in the plan."""
    x = np.random.default_rng(2).normal(1000, 1, (30, 4))
    bins = spark.createDataFrame([(s, b, t, float(x[b, t] * k)) for s, k in (("a", 1), ("b", -2)) for b in range(30) for t in range(4)], "corr_id string, bin int, t int, x double")
    index = rs.boot_index(spark, 3, 30, 10_000)
    got = cv.resampled_covariance(bins, index, chunk=999, block=7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    found = got.toPandas()
    assert len(found) == 2 * 10_000 * 16
    draws = index.where("replica in (0, 998, 999, 9999)").toPandas().groupby("replica").bin.apply(list)
    for r, d in draws.items():
        for s, k in (("a", 1), ("b", -2)):
            want = np.cov(x[d].T * k) * 29 / (30 * 29)
            m = found[(found.replica == r) & (found.corr_id == s)].pivot(index="i", columns="j", values="cov").to_numpy()
            assert np.allclose(m, want, rtol=1e-9, atol=1e-12)
