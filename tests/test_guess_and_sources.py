"""Guesses by peeling, nested bootstraps, divisions of parts, tolerant differences, q-values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import statistics as st
from corvane.operators import covariance as cv
from corvane.operators import fits as ft
from corvane.operators import resample as rs
from corvane.operators import series as sr
from corvane.operators import select as sl
from corvane.plans import q_fits


@pytest.mark.parametrize("energies,amplitudes", [([0.8, 1.2], [9.0, 7.0]), ([0.4, 1.1, 2.2], [3.0, 5.0, 6.0]), ([0.5], [2.0])])
def test_levels_are_peeled(spark, energies, amplitudes):
    t = np.arange(0, 22)
    x = sum(a * a / (2 * e) * np.exp(-e * t) for e, a in zip(energies, amplitudes))
    p = spark.createDataFrame([("s", int(u), float(v)) for u, v in zip(t, x)] + [("few", 1, 2.0), ("few", 2, float("nan"))], "corr_id string, t int, x double")
    got = {r["corr_id"]: r for r in ft.guess_levels(p, len(energies)).collect()}
    assert np.allclose(got["s"]["energies"], energies, rtol=0.05) and np.allclose(got["s"]["amplitudes"], amplitudes, rtol=0.05)
    assert got["few"]["energies"] == []


def test_two_negative_levels(spark):
    """The second correlator of the two-level truth, whose upper level has the other sign."""
    t = np.arange(1, 20)
    x = 100 * np.exp(-0.8 * t) - 200 * np.exp(-1.2 * t)
    got = ft.guess_levels(spark.createDataFrame([("b", int(u), float(v)) for u, v in zip(t, x)], "corr_id string, t int, x double"), 2).first()
    assert np.allclose(got["energies"], [0.8, 1.2], rtol=0.05)


def test_query_finds_each_orders_levels(spark, sf_dir):
    truth = q_fits.par(spark, sf_dir).toPandas().set_index("k")
    got = q_fits.j9_guess_levels(spark, sf_dir).toPandas().set_index("k")
    assert len(got) == len(truth) and all(len(e) == 2 for e in got.energies)
    off = [max(abs(e[0] / v.e0 - 1), abs(e[1] / v.e1 - 1)) for e, v in ((got.energies[k], truth.loc[k]) for k in truth.index)]
    assert max(off) < 0.05


def test_ratio_rules(spark):
    e, a, m, dt = (0.6, 0.9), (2.0, 3.0), 1.7, 16
    lits = [F.lit(v) for v in (*e, *a)]
    c3 = ft.m_3pt(F.lit(8), dt, [lits[0]], [lits[1]], [lits[2]], [lits[3]], [[F.lit(m)]])
    two = lambda k, t: ft.m_exp(F.lit(t), [F.lit(e[k])], [F.lit(a[k])])
    r3 = ft.m_r3(c3, two(0, 8), two(1, dt - 8), lits[2], lits[3])
    same = ft.m_3pt(F.lit(8), dt, [lits[0]], [lits[0]], [lits[2]], [lits[2]], [[F.lit(m)]])
    zv = ft.m_zv(two(0, dt), same)
    row = spark.range(1).select(ft.guess_matrix_element(c3, F.lit(8), dt, *lits).alias("a"), ft.guess_from_r3(r3).alias("b"), ft.guess_from_zv(zv, lits[0]).alias("c")).first()
    assert np.allclose(list(row), m)


@pytest.fixture(scope="module")
def bins(spark):
    x = np.random.default_rng(8).normal(10, 1, (25, 3))
    return spark.createDataFrame([("a", b, t, float(x[b, t])) for b in range(25) for t in range(3)], "corr_id string, bin int, t int, x double"), x


def test_reboot_agrees_with_the_covariance_of_the_drawn_bins(spark, bins):
    """Many inner draws come to the drawn bins' covariance over n."""
    index = rs.boot_index(spark, 3, 25, 4)
    got = cv.rebooted_covariance(bins[0], index, 40_000, 1, chunk=3).toPandas()
    draws = index.toPandas().groupby("replica").bin.apply(list)
    for r, d in draws.items():
        want = np.cov(bins[1][d].T, bias=True) / 25
        m = got[got.replica == r].pivot(index="i", columns="j", values="cov").to_numpy()
        assert np.allclose(m, want, rtol=0.05, atol=0.02 * want.max())
    again = cv.rebooted_covariance(bins[0], index, 40_000, 1, chunk=2).toPandas()
    key = ["replica", "i", "j"]
    assert np.allclose(got.sort_values(key)["cov"], again.sort_values(key)["cov"])  # chunks do not matter


def test_given_inverse(spark, bins):
    cov = cv.covariance(bins[0], "bin", "sample")
    own = cv.inverse_cholesky(cov)
    given = cv.given_inverse(own.select("corr_id", "i", "j", "inverse"), own.where("i = j").select("corr_id", "i", "sigma")).toPandas()
    want = own.toPandas().sort_values(["i", "j"])
    assert np.allclose(given.sort_values(["i", "j"])["chol"], want["chol"]) and np.allclose(given.sort_values(["i", "j"])["sigma"], want["sigma"])


def test_bin_sizes_are_checked(spark, bins):
    with pytest.raises(ValueError):
        cv.rebinned(bins[0], [], ["bin"])


def test_parts_of_unequal_length_are_dropped_whole(spark):
    table = lambda ids, n, row: spark.createDataFrame([(i, r, t, 6.0) for i in ids for r in range(n[i]) for t in range(2)], f"corr_id string, {row} int, t int, x double")
    num = {"replica": table("ab", {"a": 3, "b": 3}, "replica"), "binned": table("ab", {"a": 4, "b": 5}, "bin"), "raw": table("ab", {"a": 2, "b": 9}, "row")}
    den = {"replica": table("d", {"d": 3}, "replica"), "binned": table("d", {"d": 4}, "bin"), "raw": table("d", {"d": 9}, "row")}
    out = {k: sorted({r["corr_id"] for r in v.collect()}) for k, v in sr.divide_parts(num, den).items()}
    assert out == {"replica": ["a", "b"], "binned": ["a"], "raw": ["b"]}
    assert {r["x"] for r in sr.divide_parts(num, den)["binned"].collect()} == {1.0}


def test_differences(spark):
    a = spark.createDataFrame([(k, 3.0, 4.0) for k in range(5)], "k int, re double, im double")
    b = spark.createDataFrame([(0, 3.0, 4.0), (1, 3.0, 4.04), (2, 3.0, 4.06), (4, -3.0, 4.0)], "k int, re double, im double")
    assert [r["k"] for r in sr.table_diff(a, b, ("k",), ("re", "im"), 0.01).orderBy("k").collect()] == [2, 3, 4]
    assert [r["k"] for r in sr.table_diff(a, b, ("k",), ("re", "im"), 0.01, n=2).collect()] == [2, 3]
    assert [r["k"] for r in sr.table_diff(a, b, ("k",), "im", 0.0, n=1).collect()] == [1]


def test_requests_of_columns(spark):
    p = spark.createDataFrame([("E0", 1.0), ("e", 2.0), ("Mass12", 3.0), ("mass", 4.0), ("other", None)], "name string, value double")
    got = sorted((r["request"], r["name"] or "", r["value"]) for r in sl.get_columns(p, ["e", "E0", "mass", "none"], ["AS", "the"]).collect())
    assert got == sorted([("e", "E0", 1.0), ("e", "e", 2.0), ("E0", "E0", 1.0), ("E0", "e", 2.0), ("mass", "Mass12", 3.0), ("mass", "mass", 4.0), ("none", "", 0.0), ("AS", "Mass12", 3.0), ("AS", "mass", 4.0), ("the", "other", 0.0)])
    plan = sl.get_columns(p, ["e"], ["m"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tails():
    x = np.array([1e-3, 0.5, 1.0, 7.3, 15.9, 16.1, 200.0, 4000.5])
    assert np.allclose(st.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    # beta(x; 1, b) and beta(x; a, 1) in closed form, and both ends
    assert np.allclose(st.beta_tail(np.array([0.2, 0.9]), np.array([1.0, 1.0]), np.array([3.0, 50.0])), [1 - 0.8**3, 1 - 0.1**50])
    assert np.allclose(st.beta_tail(np.array([0.2, 0.9]), np.array([4.0, 9.0]), 1.0), [0.2**4, 0.9**9])
    assert list(st.beta_tail(np.array([0.0, 1.0]), 2.0, 3.0)) == [0.0, 1.0]
    # one dimension: the square of Student's t with three degrees of freedom
    t = 2.0
    want = 1 - 2 / math.pi * (t / math.sqrt(3) / (1 + t * t / 3) + math.atan(t / math.sqrt(3)))
    got = st.hotelling_tail(np.array([t * t, 5.0, 3.0]), np.array([1, 0, 4]), np.array([3, 3, 2]))
    assert np.isclose(got[0], want) and got[1] == 1 and np.isclose(got[2], st.chi_square_tail(np.array([3.0]), np.array([4]))[0])


def test_half_hundredths_are_ranked_as_in_sql(spark, tmp_path):
    """Balances whose ten thousandth is half a hundredth in decimals, but not as a double times 100."""
    import duckdb

    from corvane.plans import catalogue

    balances = [1450.0, 1449.0, 1500.0, 2850.0, 2800.0, 5650.0, 5600.0, 5750.0, 5700.0, 50.0, -50.0, -0.3, 0.0, None]
    f = str(tmp_path / "customer.parquet")
    con = duckdb.connect()
    con.execute("create table customer (c_custkey bigint, c_mktsegment varchar, c_acctbal double)")
    con.executemany("insert into customer values (?, 'one', ?)", [(180 * i, b) for i, b in enumerate(balances)])
    con.execute(f"copy customer to '{f}'")
    want = con.execute(catalogue.oracle_sql()["f4_rank_fits"]).fetchall()
    assert sorted(map(tuple, q_fits.f4_rank_fits(spark, str(tmp_path)).collect())) == sorted(want)


def test_series_of_a_length_are_peeled_at_once(monkeypatch):
    """One call for each length, whatever the number of series; each series as if it were alone."""
    import pyarrow as pa

    rng, calls, peel = np.random.default_rng(3), [], ft._peel
    monkeypatch.setattr(ft, "_peel", lambda t, *a: calls.append(t.shape) or peel(t, *a))
    lengths = [0, 3, 8, 12, 8, 12, 9, 8] * 40
    ts = [np.arange(n, dtype=float) + 1 for n in lengths]
    xs = [9 * np.exp(-0.5 * t) + rng.normal(3, 3) * np.exp(-rng.uniform(0.6, 2) * t) * (1 + 0.1 * rng.normal(size=len(t))) for t in ts]
    xs[2][4], xs[3][-1] = np.nan, 0.0
    lists = [pa.array([v.tolist() for v in vs], pa.list_(pa.float64())).slice(2) for vs in (ts, xs)]
    got = list(zip(*[c.to_pylist() for c in ft._peel_lists(*lists, 2, 60)]))
    assert len(calls) == 3 and sum(len(g[0]) == 2 for g in got) > 100 and len({len(g[0]) for g in got}) > 1
    for g, t, x in zip(got, ts[2:], xs[2:]):
        alone = [c.to_pylist()[0] for c in ft._peel_lists(*(pa.array([v.tolist()], pa.list_(pa.float64())) for v in (t, x)), 2, 60)]
        assert len(g[0]) == len(alone[0]) and all(np.array_equal(a, b, equal_nan=True) for a, b in zip(g, alone))
