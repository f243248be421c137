"""Queries: covariance."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import covariance as cv
from corvane.operators import resample

from . import base
from .base import BINNED, REPLICA
from .q_resample import rounded
from .registry import query

COV = """, dev AS (SELECT corr_id, {row} AS row_id, t, re - avg(re) OVER (PARTITION BY corr_id, t) AS x FROM {src}),
cov AS (SELECT a.corr_id, a.t AS i, b.t AS j, sum(a.x * b.x) * {norm} AS cov FROM dev a JOIN dev b USING (corr_id, row_id) GROUP BY ALL)"""
BOOT = REPLICA + COV.format(row="replica", src="replica WHERE replica >= 0", norm="1.0 / count(*)")
BIN = BINNED + COV.format(row="bin", src="binned", norm="(1.0 / (count(*) * (count(*) - 1.0)))")
CORR = """, corr AS (SELECT c.corr_id, c.i, c.j, CASE WHEN c.i = c.j THEN 1.0 ELSE c.cov / sqrt(a.cov * b.cov) END AS corr FROM cov c JOIN cov a ON a.corr_id = c.corr_id AND a.i = c.i AND a.j = c.i JOIN cov b ON b.corr_id = c.corr_id AND b.i = c.j AND b.j = c.j)"""
SHOW = " SELECT corr_id, i, j, round(cov, 2) AS cov FROM cov"


def boot(spark, d):
    return cv.covariance(base.replicas(spark, d).where("replica >= 0"), "replica", "bootstrap", "re")


def bins(spark, d):
    return cv.covariance(base.binned(spark, d), "bin", "raw_binned", "re")


@query(f"WITH {BINNED} SELECT a.corr_id, a.t AS i, b.t AS j, count(*) AS n, round(sum(a.re * b.re), 0) AS product FROM binned a JOIN binned b ON a.corr_id = b.corr_id AND a.bin = b.bin AND b.t <= a.t GROUP BY ALL")
def c11_pair_product(spark, d):
    p = cv.pair_product(base.binned(spark, d), "bin", "re")
    return p.groupBy("corr_id", "i", "j").agg(F.count("*").alias("n"), F.round(F.sum("product"), 0).alias("product"))


@query(f"WITH {BOOT}{SHOW}")
def d10_covariance_bootstrap(spark, d):
    return rounded(boot(spark, d), "cov", digits=2)


@query(f"WITH {BIN}{SHOW}")
def d10_covariance_binned(spark, d):
    return rounded(bins(spark, d), "cov", digits=2)


@query(f"WITH {BINNED}{COV.format(row='bin', src='binned', norm='(1.0 / (count(*) - 1.0))')} SELECT corr_id, i, j, round(cov, 0) AS cov FROM cov")
def d10_covariance_sample(spark, d):
    return rounded(cv.covariance(base.binned(spark, d), "bin", "sample", "re"), "cov", digits=0)


@query(f"""WITH {BINNED}, dev AS (SELECT corr_id, bin, t, re - avg(re) OVER w AS dr, im - avg(im) OVER w AS di FROM binned WINDOW w AS (PARTITION BY corr_id, t))
SELECT a.corr_id, a.t AS i, b.t AS j, round(sum(a.dr * b.dr + a.di * b.di) / (count(*) * (count(*) - 1.0)), 2) AS cov_re, round(sum(a.dr * b.di - a.di * b.dr) / (count(*) * (count(*) - 1.0)), 3) AS cov_im FROM dev a JOIN dev b ON a.corr_id = b.corr_id AND a.bin = b.bin AND b.t <= a.t GROUP BY ALL""")
def d10_covariance_complex(spark, d):
    c = cv.covariance_complex(base.binned(spark, d), "bin", "raw_binned")
    return c.withColumns({"cov_re": F.round("cov_re", 2), "cov_im": F.round("cov_im", 3) + 0.0})


RESAMPLED = REPLICA + """, w AS (SELECT replica, bin, count(*) AS k FROM boot_index GROUP BY ALL),
drawn AS (SELECT corr_id, replica, bin, t, re, k, sum(re * k) OVER g / sum(k) OVER g AS m FROM binned JOIN w USING (bin) WINDOW g AS (PARTITION BY corr_id, replica, t)),
rc AS (SELECT a.corr_id, a.replica, a.t AS i, b.t AS j, sum((a.re - a.m) * (b.re - b.m) * a.k) / 9900.0 AS cov FROM drawn a JOIN drawn b USING (corr_id, replica, bin) GROUP BY ALL)"""


def resampled(spark, d):
    b = base.binned(spark, d).withColumn("x", F.col("re"))
    return cv.resampled_covariance(b, resample.boot_index(spark, base.SEED, base.BINS, base.REPLICAS))


@query(f"WITH {RESAMPLED} SELECT corr_id, replica, i, j, round(cov, 2) AS cov FROM rc")
def d11_resampled_covariance(spark, d):
    return rounded(resampled(spark, d), "cov", digits=2)


@query(f"""WITH {REPLICA}, dev AS (SELECT r.corr_id, r.replica AS row_id, r.t, r.re - c.re AS x FROM replica r JOIN replica c ON c.corr_id = r.corr_id AND c.t = r.t AND c.replica = -1 WHERE r.replica >= 0)
SELECT a.corr_id, a.t AS i, b.t AS j, round(sum(a.x * b.x) / count(*), 2) AS cov FROM dev a JOIN dev b USING (corr_id, row_id) GROUP BY ALL""")
def d12_covariance_about_central(spark, d):
    r = base.replicas(spark, d)
    return rounded(cv.covariance(r.where("replica >= 0"), "replica", "bootstrap", "re", about=r.where("replica = -1")), "cov", digits=2)


@query(f"WITH {BIN}{CORR} SELECT corr_id, i, j, round(corr, 8) AS corr FROM corr")
def d13_correlation(spark, d):
    return rounded(cv.correlation(bins(spark, d)), "corr", digits=8)


@query(f"WITH {BIN}{CORR} SELECT corr_id, i, j, round(0.9 * corr + CASE WHEN i = j THEN 0.1 ELSE 0 END, 8) AS corr FROM corr")
def d14_shrink(spark, d):
    return rounded(cv.shrink(cv.correlation(bins(spark, d)), 0.1), "corr", digits=8)


@query(f"WITH {BIN} SELECT corr_id, i, j, round(CASE WHEN i // 3 = j // 3 THEN cov ELSE 0 END, 2) AS cov FROM cov")
def d15_block_mask(spark, d):
    return rounded(cv.block_mask(bins(spark, d), F.floor(F.col("i") / 3) == F.floor(F.col("j") / 3)), "cov", digits=2)


@query(f"WITH {REPLICA}, p AS (SELECT corr_id AS fit_id, replica, t, re FROM replica WHERE replica >= 0), dev AS (SELECT fit_id, replica, 'p' || t AS n, re - avg(re) OVER (PARTITION BY fit_id, t) AS x FROM p), c AS (SELECT a.fit_id, a.n AS i, b.n AS j, sum(a.x * b.x) AS c FROM dev a JOIN dev b USING (fit_id, replica) GROUP BY ALL) SELECT c.fit_id, c.i, c.j, round(CASE WHEN c.i = c.j THEN 1.0 ELSE c.c / sqrt(a.c * b.c) END, 8) AS corr FROM c JOIN c a ON a.fit_id = c.fit_id AND a.i = c.i AND a.j = c.i JOIN c b ON b.fit_id = c.fit_id AND b.i = c.j AND b.j = c.j")
def d16_param_correlation(spark, d):
    p = base.replicas(spark, d).select(F.col("corr_id").alias("fit_id"), "replica", F.concat(F.lit("p"), "t").alias("name"), F.col("re").alias("value"))
    return rounded(cv.param_correlation(p), "corr", digits=8)


@query()
def d17_block_condition(spark, d):
    return cv.block_condition(bins(spark, d))


@query(f"WITH {BIN} SELECT corr_id, i, j, round(cov, 2) AS cov FROM cov")
def d18_covar_source_binned(spark, d):
    return rounded(cv.covar_source(base.samples(spark, d), base.replicas(spark, d), "binned"), "cov", digits=2)


ORDER = ["config", "o", "pk", "sk", "re", "im", "sd"]


@query(f"""WITH {base.SAMPLES}, placed AS (SELECT *, (row_number() OVER (PARTITION BY corr_id, t ORDER BY {', '.join(ORDER)}) - 1) // 25 AS bin FROM samples),
rb AS (SELECT corr_id, bin, t, avg(re) AS re FROM placed GROUP BY ALL), dev AS (SELECT corr_id, bin AS row_id, t, re - avg(re) OVER (PARTITION BY corr_id, t) AS x FROM rb)
SELECT a.corr_id, a.t AS i, b.t AS j, round(sum(a.x * b.x) * (1.0 / (count(*) * (count(*) - 1.0))), 2) AS cov FROM dev a JOIN dev b USING (corr_id, row_id) GROUP BY ALL""")
def d18_covar_source_rebin(spark, d):
    return rounded(cv.covar_source(base.samples(spark, d), base.replicas(spark, d), "rebin", 25, ORDER), "cov", digits=2)


@query(f"WITH {RESAMPLED}{COV.format(row='bin', src='binned', norm='(1.0 / (count(*) * (count(*) - 1.0)))')} SELECT c.corr_id, v.replica, c.i, c.j, round(c.cov / sqrt(a.cov * b.cov) * sqrt(v.cov * u.cov), 2) AS cov FROM cov c JOIN cov a ON a.corr_id = c.corr_id AND a.i = c.i AND a.j = c.i JOIN cov b ON b.corr_id = c.corr_id AND b.i = c.j AND b.j = c.j JOIN rc v ON v.corr_id = c.corr_id AND v.i = c.i AND v.j = c.i JOIN rc u ON u.corr_id = c.corr_id AND u.replica = v.replica AND u.i = c.j AND u.j = c.j")
def d19_semi_frozen(spark, d):
    return rounded(cv.frozen_modes(bins(spark, d), resampled(spark, d), "semi"), "cov", digits=2)


@query()
def h5_inverse_cholesky(spark, d):
    return cv.inverse_cholesky(bins(spark, d))


@query()
def h4_whiten(spark, d):
    r = base.replicas(spark, d)
    c = r.where("replica = -1").select("corr_id", "t", F.col("re").alias("c"))
    residual = r.where("replica >= 0").join(c, ["corr_id", "t"]).select("corr_id", "replica", "t", (F.col("re") - F.col("c")).alias("r"))
    return cv.whiten(residual, cv.inverse_cholesky(bins(spark, d)))


@query()
def d18_covar_source_reboot(spark, d):
    """A bootstrap of 200 draws within each replica."""
    b = base.binned(spark, d).withColumn("x", F.col("re"))
    return cv.rebooted_covariance(b, resample.boot_index(spark, base.SEED, base.BINS, base.REPLICAS), 200, base.SEED)


@query(f"""WITH {base.SAMPLES}, sized AS (SELECT *, CASE corr_id WHEN 'A' THEN 25 WHEN 'N' THEN 0 ELSE 40 END AS size FROM samples), placed AS (SELECT *, CASE WHEN size = 0 THEN config ELSE (row_number() OVER (PARTITION BY corr_id, t ORDER BY {', '.join(ORDER)}) - 1) // size END AS bin FROM sized),
rb AS (SELECT corr_id, bin, t, avg(re) AS re FROM placed GROUP BY ALL), dev AS (SELECT corr_id, bin AS row_id, t, re - avg(re) OVER (PARTITION BY corr_id, t) AS x FROM rb)
SELECT a.corr_id, a.t AS i, b.t AS j, round(sum(a.x * b.x) * (1.0 / (count(*) * (count(*) - 1.0))), 2) AS cov FROM dev a JOIN dev b USING (corr_id, row_id) GROUP BY ALL""")
def d18_covar_source_sizes(spark, d):
    """A list of bin sizes, one for each series."""
    return rounded(cv.rebinned(base.samples(spark, d), [25, 0, 40], ORDER), "cov", digits=2)
