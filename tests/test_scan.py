"""The registered scan of fits covers every range of the table."""

import numpy as np

from corvane.plans import q_fits


def brute_chi_sq(t, x, s):
    """The least chi-square of c exp(-e t), c at its best for each e of ever finer grids."""
    low, high = 1e-4, 5.0
    for _ in range(6):
        e = np.linspace(low, high, 2001)
        m = np.exp(-np.outer(e, t)) / s
        c = np.maximum(m @ (x / s) / (m * m).sum(axis=1), 0)
        cost = ((c[:, None] * m - x / s) ** 2).sum(axis=1)
        k, step = int(cost.argmin()), e[1] - e[0]
        low, high = max(1e-9, e[k] - 2 * step), e[k] + 2 * step
    return cost[k]


def test_scan_fits_every_range(spark, sf_dir):
    points = q_fits.pts(spark, sf_dir).where("replica = -1").toPandas()
    ranges = {}
    for k in range(5):
        for a in (k % 2, k % 2 + 1):
            for b in (4 + k % 3, 5 + k % 3):
                times = tuple(range(a, b + 1, 1 + k // 3))
                if len(times) >= 4:
                    ranges[f"{k}_{a}_{b}"] = times
    assert {k[0] for k in ranges} == {"0", "1", "2", "4"}  # range 3 has lists of two and three times only
    got = q_fits.j13_scan_fits(spark, sf_dir).where("replica = -1").toPandas().set_index("fit_id")
    assert set(got.index) == {f"{c}_{r}" for c in points.corr_id.unique() for r in ranges}
    for corr_id, p in points.groupby("corr_id"):
        for r, times in ranges.items():
            q = p[p.t.isin(times)]
            t, x, s = (q[c].to_numpy(dtype=float) for c in ("t", "x", "sigma"))
            best = brute_chi_sq(t, x, s)
            assert np.isclose(got.chi_sq[f"{corr_id}_{r}"], best, rtol=1e-3, atol=1e-6), (corr_id, r)
