"""The constrained global fit against normal equations with a multiplier, replica by replica."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import statistics as st
from corvane.operators import globalfit as gf
from corvane.operators import resample as rs
from corvane.plans import q_fits
from corvane.sources.scratch import staged

REPLICAS = 120


@pytest.fixture(scope="module")
def inputs(spark):
    points, values, variations = q_fits.global_inputs(spark, "/root/testdata/sf0.01", REPLICAS)
    return staged(points), staged(values), staged(variations)


@pytest.fixture(scope="module")
def fits(inputs):
    return staged(gf.fit_variations(*inputs, 1.0, "BUILDING"))


def row_of(p, x, r, terms, off, poles):
    """A point's design for one replica, from the formula."""
    ff, e = p.form_factor, p.ensemble
    at = lambda n: x[n][r]
    delta = poles.get(ff, 0.5 * ((at(f"pole/{ff}") ** 2 - at("m_light") ** 2) / at("m_heavy") - at("m_heavy")))
    m, phys, length = at(f"m_pi/{e}"), at("m_pi_phys"), p.sites / at(f"a_inv/{e}")
    log = lambda v: 2 * v * v * math.log(abs(v))
    chi = log(m) - log(phys) + (0 if "V" in off else volume(m, length, p.sites) - volume(phys, length, p.sites))
    chi *= -0.75 / (4 * math.pi * at("f_pi")) ** 2
    energy, out = at(f"el/{p.t}"), []
    for t in terms:
        own, t = t.split(".")
        v = {"c0": 1 + chi, "c1": m * m - phys * phys}.get(t)
        if v is None:
            v = energy ** int(t[1:]) if t[0] == "e" else (1 / at(f"a_inv/{e}")) ** (2 * int(t[1:]))
        out.append(v / (energy + delta) if own == ff else 0.0)
    return out


def volume(m, length, sites):
    total, half = 0.0, sites // 2
    for a in range(half + 1):
        for b in range(half + 1):
            for c in range(half + 1):
                n = math.sqrt(a * a + b * b + c * c)
                if 0 < n * m * length < 60:
                    w = math.prod(1 if v in (0, half) else 2 for v in (a, b, c))
                    total += w * float(st.bessel_k1(np.array([n * m * length]))[0]) / n
    return 4 * m / length * total


def arrays(values):
    x = {}
    for r in sorted(values.collect(), key=lambda r: r["chunk"]):
        x[r["name"]] = np.concatenate([x.get(r["name"], []), r["xs"]])
    return x  # place 0 is the central replica


def used(points, v):
    p = points
    drop, caps, series = v.get("drop", []), v.get("caps", {}), v.get("series", {})
    keep = [e not in drop and n2 <= caps.get(e, 99) and s == series.get(e, series.get("", "BUILDING")) for e, n2, s in zip(p.ensemble, p.n2, p.series)]
    return p[keep].sort_values("t")


@pytest.mark.parametrize("name", ["ref", "a_no_volume", "b_both_poles", "e_alt_zv", "f_alt_c1", "g_caps", "h_no_c1", "m_no_m", "p_second_term"])
def test_fits_equal_normal_equations(inputs, fits, name):
    points, x, v = inputs[0].toPandas(), arrays(inputs[1]), q_fits.VARIATIONS[name]
    p = used(points, v)
    got = fits.where(F.col("variation") == name).toPandas().set_index("replica")
    assert len(got) == REPLICAS + 1
    terms = list(got.terms.iloc[0])
    off, poles, d = v.get("disable", []), v.get("poles", {}), v.get("n_d", 1)
    assert terms == [f"{ff}.{t}" for ff in ("f_zero", "f_plus") for t in ("c0", "c1", "e1", "e2", "d1", "d2")[: 4 + d] if t not in off]
    y = np.array([x[f"y/{t}"] for t in p.t])
    cov = np.cov(y[:, 1:], bias=True)
    cov *= np.array([[a == b for b in p.ensemble] for a in p.ensemble])
    inverse = np.linalg.inv(cov)
    energy0 = lambda r: (x["m_heavy"][r] ** 2 + x["m_light"][r] ** 2) / (2 * x["m_heavy"][r])
    for r in (-1, 0, 57):
        k = r + 1
        a = np.array([row_of(q, x, k, terms, off, poles) for q in p.itertuples()])
        delta = {ff: poles.get(ff, 0.5 * ((x[f"pole/{ff}"][k] ** 2 - x["m_light"][k] ** 2) / x["m_heavy"][k] - x["m_heavy"][k])) for ff in ("f_zero", "f_plus")}
        con = np.zeros(len(terms))
        for i, t in enumerate(terms):
            ff, t = t.split(".")
            if t[0] == "e" or t == "c0":
                con[i] = (1 if ff == "f_zero" else -1) * (1 if t == "c0" else energy0(k) ** int(t[1:])) / (energy0(k) + delta[ff])
        n = len(terms)
        scale = np.linalg.norm(a, axis=0)
        b = a / scale
        m = np.zeros((n + 1, n + 1))
        m[:n, :n], m[:n, n], m[n, :n] = b.T @ inverse @ b, con / scale, con / scale
        want = np.linalg.solve(m, np.append(b.T @ inverse @ y[:, k], 0))[:n] / scale
        assert np.allclose(got.params[r], want, rtol=2e-5, atol=1e-7), name
        left = a @ np.array(got.params[r]) - y[:, k]
        assert np.isclose(got.chi_sq[r], left @ inverse @ left, rtol=1e-6)
        assert got.dof[r] == len(p) - n + 1
    assert got.gap.max() < 1e-12


def test_all_variations_are_there(fits):
    found = fits.groupBy("variation").agg(F.count("*").alias("n"), F.count_distinct("replica").alias("r")).collect()
    assert {r["variation"] for r in found} == set(q_fits.VARIATIONS) and len(q_fits.VARIATIONS) == 17
    assert all(r["n"] == r["r"] == REPLICAS + 1 for r in found)


def test_chunks_do_not_matter(spark):
    """Replicas 0.. of several chunks, without the constraint, and covariance blocks by form factor."""
    points, values, variations = q_fits.global_inputs(spark, "/root/testdata/sf0.01", 2300)
    values = staged(values)
    some = variations.where("variation in ('ref', 'g_caps')")
    found = staged(gf.fit_variations(points, values, some, 1.0, "BUILDING", constrained=False, by_form_factor=True))
    assert found.where("gap is not null").count() == 0
    assert sorted(r["replica"] for r in found.where("variation = 'ref'").collect()) == list(range(-1, 2300))
    assert {r["dof"] for r in found.where("variation = 'ref'").collect()} == {50 - 10}


def test_band_equals_bounds_of_the_exploded_curves(inputs, fits, spark):
    points, values, variations = inputs
    got = gf.band(fits, values, variations, 1.0, ticks=4).where("variation in ('ref', 'c_vector_pole')").collect()
    assert len(got) == 2 * 2 * 5
    x = arrays(values)
    params = {(r["variation"], r["replica"]): dict(zip(r["terms"], r["params"])) for r in fits.where("variation in ('ref', 'c_vector_pole')").collect()}
    rows = []
    span = (x["m_heavy"][0] - x["m_light"][0]) ** 2
    for (v, r), p in params.items():
        poles = q_fits.VARIATIONS[v].get("poles", {})
        for ff in ("f_zero", "f_plus"):
            h, low = x["m_heavy"][r + 1], x["m_light"][r + 1]
            delta = poles.get(ff, 0.5 * ((x[f"pole/{ff}"][r + 1] ** 2 - low**2) / h - h))
            for k in range(5):
                e = (h * h + low * low - span * k / 4) / (2 * h)
                plain = p[f"{ff}.c0"] + p[f"{ff}.e1"] * e + p[f"{ff}.e2"] * e * e
                rows.append((v, ff, k, r, float(plain / (e + delta)), float(plain)))
    table = spark.createDataFrame(rows, "variation string, form_factor string, tick int, replica int, y double, plain double")
    for c in ("y", "plain"):
        want = {tuple(r)[:3]: r for r in rs.stats(table, c, ("variation", "form_factor", "tick")).collect()}
        for r in got:
            w = want[r["variation"], r["form_factor"], r["tick"]]
            assert all(np.isclose(r[c][n], w[n], rtol=1e-9) for n in ("min", "low", "central", "high", "max"))
    zero = {(r["variation"], r["form_factor"]): r["y"]["central"] for r in got if r["tick"] == 0}
    assert np.isclose(zero["ref", "f_zero"], zero["ref", "f_plus"]) and np.isclose(zero["c_vector_pole", "f_zero"], zero["c_vector_pole", "f_plus"])


def test_volume_curve_equals_its_sum():
    m, length = np.linspace(0.3, 0.36, 7), np.linspace(13.2, 13.6, 7)
    got = gf.finite_volume_curve(m, length, 16)
    assert np.allclose(got, [volume(a, b, 16) for a, b in zip(m, length)], rtol=1e-8)


def test_null_basis():
    a = np.random.default_rng(1).normal(size=(50, 6))
    z = gf.null_basis(a)
    assert np.allclose(np.einsum("rn,rnk->rk", a, z), 0, atol=1e-14) and np.allclose(np.einsum("rnk,rnl->rkl", z, z), np.eye(5))
