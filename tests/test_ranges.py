"""Fit ranges against plain loops, and scans by running moments against fits of each range."""

import json

import numpy as np
import pytest

from corvane.operators import fits as ft
from corvane.operators import ranges as rg
from corvane.plans import q_fits

SCHEMA = "fit_id string, range_id int, offset int, ti int, tf int, dti int, dtf int, thin array<int>, min_points int"


def times(ti, tf, thin):
    """Pairs of step and number; step 0 skips."""
    if tf < ti:
        return []
    if not thin:
        return list(range(ti, tf + 1))
    out, t, k = [], ti, 0
    while t <= tf and k < len(thin):
        step, last = thin[k], k + 1 == len(thin)
        if step == 0:
            t = tf + 1 if last else t + thin[k + 1]
        else:
            n = (tf - t) // step + 1 if last else thin[k + 1]
            while n > 0 and t <= tf:
                out.append(t)
                t, n = t + step, n - 1
        k += 2
    return out


def brute(ranges):
    """ranges of one fit, by range_id: all choices as tuples of lists."""
    by = {r[1]: r for r in ranges}
    order = []
    while len(order) < len(by):
        order += [k for k, r in by.items() if k not in order and (r[2] is None or k + r[2] in order)]
    choices = [{}]
    for k in order:
        _, _, offset, ti, tf, dti, dtf, thin, least = by[k]
        new = []
        for c in choices:
            a, b = (0, 0) if offset is None else c[k + offset][:2]
            for x in range(a + ti, a + ti + dti):
                for y in range(b + tf, b + tf + dtf):
                    ts = times(x, y, thin)
                    if len(ts) >= max(least, 1):
                        new.append(c | {k: (x, y, tuple(ts))})
        choices = new
    return {tuple(c[k][2] for k in sorted(c)) for c in choices}


def found(df):
    return {(r["fit_id"], tuple(tuple(x["fit_times"]) for x in r["ranges"])) for r in df.collect()}


CHAIN = [("f", 0, None, 3, 8, 2, 3, None, 3), ("f", 1, -1, 1, -1, 2, 1, None, 3), ("f", 2, -1, 0, 2, 1, 2, [2, 2, 0, 1, 1], 2)]


@pytest.mark.parametrize("rows", [
    CHAIN, [("g", 0, 1, 1, 0, 2, 2, None, 4), ("g", 1, 1, 0, 1, 1, 2, [2], 3), ("g", 2, None, 0, 6, 3, 1, [0, 2, 1, 3, 3], 1), ("g", 3, -3, 1, 1, 1, 1, [1, 2, 0], 2)],
    [("h", 0, None, 5, 4, 1, 1, None, 1), ("h", 1, None, 0, 3, 1, 1, None, 1)], [("i", 7, None, 2, 4, 1, 3, [3], 2)],
])
def test_combinations(spark, rows):
    want = {(rows[0][0], c) for c in brute(rows)}
    assert found(rg.range_combinations(spark.createDataFrame(rows, SCHEMA))) == want


def test_several_fits_at_once(spark):
    rows = CHAIN + [("k", *r[1:]) for r in CHAIN[:1]]
    assert found(rg.range_combinations(spark.createDataFrame(rows, SCHEMA))) == {("f", c) for c in brute(CHAIN)} | {("k", c) for c in brute(rows[-1:])}
    assert rg.range_combinations(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("rows", [
    [("f", 0, 1, 1, 1, 1, 1, None, 1), ("f", 1, -1, 1, 1, 1, 1, None, 1)], [("f", 0, 0, 1, 1, 1, 1, None, 1)], [("f", 0, None, 1, 3, 1, 1, None, 1), ("f", 1, 5, 1, 1, 1, 1, None, 1)],
])
def test_cycles_and_missing_parents_are_errors(spark, rows):
    with pytest.raises(ValueError, match="depends on itself"):
        rg.range_combinations(spark.createDataFrame(rows, SCHEMA))


def test_thinned_query_equals_loops(spark, sf_dir):
    ranges = q_fits.order_ranges(spark, sf_dir).toPandas()
    want = set()
    for fit, g in ranges.groupby("fit_id"):
        rows = [(fit, int(r.range_id), None if np.isnan(r.offset) else int(r.offset), int(r.ti), int(r.tf), int(r.dti), int(r.dtf), None if r.thin is None else [int(x) for x in r.thin], int(r.min_points)) for r in g.itertuples()]
        want |= {(fit, json.dumps(c, separators=(",", ":"))) for c in brute(rows)}
    got = [(r["fit_id"], r["lists"]) for r in q_fits.h2_thinned_ranges(spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_scan_equals_fits_of_each_range(spark):
    rng = np.random.default_rng(4)
    rows = [(s, r, t, float(40 * np.exp(-0.5 * t) * (1 + 0.01 * rng.normal())), 0.02 * 40 * float(np.exp(-0.5 * t))) for s in "ab" for r in range(-1, 4) for t in range(1, 13) if (s, t) != ("b", 5)]
    p = spark.createDataFrame(rows, "corr_id string, replica int, t int, x double, sigma double")
    w = rg.windows(p, 3)
    assert w.where("corr_id = 'a'").count() == 10 * 11 // 2 and w.where("corr_id = 'b'").count() == 9 * 10 // 2
    got = rg.scan_lines(p, w).toPandas().set_index(["corr_id", "range_id", "replica"])
    each = p.join(w, "corr_id").where("t between ti and tf")
    line = ft.fit_line(each, ("corr_id", "range_id", "replica")).toPandas().set_index(["corr_id", "range_id", "replica"])
    flat = ft.fit_constant(each, ("corr_id", "range_id", "replica")).toPandas().set_index(["corr_id", "range_id", "replica"])
    assert len(got) == len(line) == 100 * 5
    for c in ("intercept", "slope", "chi_sq"):
        assert np.allclose(got[c].sort_index(), line[c].sort_index(), rtol=1e-6, atol=1e-6), c
    assert (got["dof"].sort_index() == line["dof"].sort_index()).all() and np.allclose(got["mean"].sort_index(), flat["value"].sort_index())
    few = spark.createDataFrame([("a", "one", 3, 3), ("a", "none", 40, 50)], "corr_id string, range_id string, ti int, tf int")
    one = rg.scan_lines(p, few).collect()
    assert len(one) == 5 and all(r["slope"] is None and r["range_id"] == "one" for r in one)
    scanned = rg.scan_lines(p, w)._jdf.queryExecution().executedPlan().toString()
    assert scanned.count("Generate") <= 2 and "NestedLoop" not in scanned  # no row for each range and point


#: Several ends give one list, and ranges that hang on them tell them apart again.
ALIKE = [("t", 0, None, 0, 5, 1, 3, [3], 1), ("t", 1, -1, 0, 0, 1, 3, [2], 1), ("t", 2, -2, 1, 1, 2, 2, [4], 1), ("t", 3, -1, 0, 1, 2, 1, [2, 1, 0], 1)]


@pytest.mark.parametrize("rows", [ALIKE, [("u", k, None if k == 0 else -1, 0 if k else 1, 0 if k else 6, 1, 2 if k % 4 == 0 else 1, [2], 1) for k in range(11)]])
def test_choices_need_no_join_and_no_comparison(spark, rows):
    df = rg.range_combinations(spark.createDataFrame(rows, SCHEMA))
    got = df.collect()
    assert {(r["fit_id"], tuple(tuple(x["fit_times"]) for x in r["ranges"])) for r in got} == {(rows[0][0], c) for c in brute(rows)}
    assert len(got) == len(brute(rows)) and all(times(x["ti"], x["tf"], rows[x["range_id"]][7]) == x["fit_times"] for r in got for x in r["ranges"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Aggregate" not in plan
