"""Queries: binning, resampling, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import resample as rs

from . import base
from .registry import query


def rounded(df, *columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


VE = ("min", "low", "central", "high", "max", "check")
VE_SQL = ", ".join(f'round("{c}", 4) AS "{c}"' for c in VE)


@query(f"WITH {base.SAMPLES}, per AS (SELECT corr_id, config, count(*) AS n FROM samples GROUP BY ALL) SELECT corr_id, sum(n)::BIGINT AS measurements, count(*) AS configs, string_agg(config || ':' || n, ' ' ORDER BY config) AS config_count FROM per GROUP BY corr_id")
def d1_manifest(spark, d):
    m = rs.manifest(base.samples(spark, d))
    return m.withColumn("config_count", F.array_join(F.transform("config_count", lambda x: F.concat_ws(":", x["config"], x["n"])), " "))


@query(f"WITH {base.BINNED} SELECT corr_id, bin, t, round(re, 8) AS re, round(im, 8) AS im, n FROM binned")
def d2_bin_auto(spark, d):
    return rounded(base.binned(spark, d), "re", "im", digits=8)


@query(f"WITH {base.BINNED} SELECT corr_id, CASE WHEN min(n) = max(n) THEN max(n) ELSE 0 END AS bin_size FROM binned GROUP BY corr_id")
def d2_bin_size(spark, d):
    return rs.bin_size(base.binned(spark, d))


@query(f"""WITH {base.SAMPLES}, placed AS (SELECT *, (row_number() OVER (PARTITION BY corr_id, t ORDER BY config, o, pk, sk, re, im, sd) - 1) // 25 AS bin FROM samples)
SELECT corr_id, CAST(bin AS INTEGER) AS bin, t, round(avg(re), 4) AS re, round(avg(im), 4) AS im, count(*) AS n FROM placed GROUP BY ALL""")
def d3_bin_fixed(spark, d):
    return rounded(rs.bin_fixed(base.samples(spark, d), 25, ["config", "o", "pk", "sk", "re", "im", "sd"]), "re", "im")


@query(f"WITH {base.CENTRAL} SELECT corr_id, t, round(re, 4) AS re, round(im, 4) AS im FROM central")
def d4_mean(spark, d):
    return rounded(base.central(spark, d), "re", "im")


@query(f"WITH {base.REPLICA} SELECT corr_id, replica, t, round(re, 4) AS re, round(im, 4) AS im FROM replica")
def d5_bootstrap_exact(spark, d):
    return rounded(base.replicas(spark, d), "re", "im")


@query()
def d5_bootstrap_matrix(spark, d):
    return rs.bootstrap(base.binned(spark, d), 2000, base.SEED)


@query()
def d5_bootstrap_poisson(spark, d):
    return rs.bootstrap_poisson(base.binned(spark, d), 50, base.SEED)


JACK = base.BINNED + """, jack AS (
  SELECT corr_id, bin AS replica, t, (sum(re) OVER w - re) / (count(*) OVER w - 1) AS re, (sum(im) OVER w - im) / (count(*) OVER w - 1) AS im FROM binned WINDOW w AS (PARTITION BY corr_id, t)
  UNION ALL SELECT corr_id, -1, t, avg(re), avg(im) FROM binned GROUP BY corr_id, t)"""


@query(f"WITH {JACK} SELECT corr_id, replica, t, round(re, 4) AS re, round(im, 4) AS im FROM jack")
def d6_jackknife(spark, d):
    return rounded(rs.jackknife(base.binned(spark, d)), "re", "im")


STATS = """, placed AS (SELECT *, row_number() OVER (PARTITION BY corr_id, t ORDER BY re) - 1 AS i, count(*) OVER (PARTITION BY corr_id, t) AS n FROM {src} WHERE replica >= 0),
st AS (SELECT corr_id, t, min(re) AS "min", max(CASE WHEN i = floor(0.158655 * n + 0.5) THEN re END) AS low, max(CASE WHEN i = n - 1 - floor(0.158655 * n + 0.5) THEN re END) AS high, max(re) AS "max" FROM placed GROUP BY corr_id, t),
ve AS (SELECT corr_id, t, "min", low, c.re AS central, high, "max", 1.0::DOUBLE AS "check" FROM st JOIN {src} c USING (corr_id, t) WHERE c.replica = -1)"""


@query(f"WITH {base.REPLICA}{STATS.format(src='replica')} SELECT corr_id, t, {VE_SQL} FROM ve")
def d7_bootstrap_stats(spark, d):
    return rounded(rs.stats(base.replicas(spark, d)), *VE)


@query(f"""WITH {JACK}, m AS (SELECT j.corr_id, j.t, min(j.re) AS "min", max(j.re) AS "max", any_value(c.re) AS central, sqrt((count(*) - 1.0) / count(*) * sum((j.re - c.re) * (j.re - c.re))) AS s
FROM jack j JOIN jack c ON j.corr_id = c.corr_id AND j.t = c.t AND c.replica = -1 WHERE j.replica >= 0 GROUP BY ALL)
SELECT corr_id, t, round("min", 4) AS "min", round(central - s, 4) AS low, round(central, 4) AS central, round(central + s, 4) AS high, round("max", 4) AS "max", 1.0::DOUBLE AS "check" FROM m""")
def d8_jackknife_stats(spark, d):
    return rounded(rs.stats_jackknife(rs.jackknife(base.binned(spark, d))), *VE)


@query(f"""WITH {base.REPLICA}, odd AS (SELECT corr_id, t, replica, CASE WHEN replica >= 0 AND t = 0 THEN 'nan'::DOUBLE ELSE re END AS re FROM replica WHERE NOT (t = 1 AND replica >= 0)),
g AS (SELECT corr_id, t, count(*) FILTER (replica >= 0) AS a, count(*) FILTER (replica >= 0 AND isfinite(re)) AS n, max(CASE WHEN replica = -1 THEN re END) AS c FROM odd GROUP BY ALL)
SELECT corr_id, t, a AS replicas, round(CASE WHEN a = 0 THEN 1 ELSE n / a END, 4) AS "check", (a > 0 AND n = 0) AS undefined, (a = 0) AS constant FROM g""")
def d9_degenerate_stats(spark, d):
    r = base.replicas(spark, d).where("NOT (t = 1 AND replica >= 0)")
    r = r.withColumn("re", F.when((F.col("replica") >= 0) & (F.col("t") == 0), float("nan")).otherwise(F.col("re")))
    n = r.groupBy("corr_id", "t").agg(F.count_if(F.col("replica") >= 0).alias("replicas"))
    s = rs.stats(r).join(n, ["corr_id", "t"])
    return s.select("corr_id", "t", "replicas", F.round("check", 4).alias("check"), F.isnan("low").alias("undefined"), ((F.col("low") == F.col("central")) & (F.col("replicas") == 0)).alias("constant"))


BIAS = """, mean AS (SELECT corr_id, t, avg(re) AS m FROM replica WHERE replica >= 0 GROUP BY ALL)"""


@query(f"WITH {base.REPLICA}{STATS.format(src='replica')}{BIAS} SELECT corr_id, t, round(\"min\", 4) AS \"min\", round(low, 4) AS low, round(m, 4) AS central, round(high, 4) AS high, round(\"max\", 4) AS \"max\", \"check\" FROM ve JOIN mean USING (corr_id, t)")
def d20_bias(spark, d):
    return rounded(rs.bias(base.replicas(spark, d)), *VE)


@query(f"WITH {base.REPLICA}{STATS.format(src='replica')} SELECT corr_id, arg_max(t, central) AS t, round(max(central), 4) AS central, round(arg_max((high - low) / (2 * abs(central)), central), 6) AS relative_error FROM ve GROUP BY corr_id")
def d21_arg_max(spark, d):
    from corvane.operators import select

    return rounded(select.max_corr(rs.stats(base.replicas(spark, d))), "central").withColumn("relative_error", F.round("relative_error", 6))


@query(f"WITH {base.BINNED}, per AS (SELECT corr_id, count(DISTINCT bin) AS n FROM binned GROUP BY corr_id) SELECT min(n) AS least, max(n) AS most FROM per")
def d31_sample_sizes(spark, d):
    return rs.sample_sizes(base.binned(spark, d))


@query()
def d30_parametric_replicas(spark, d):
    c = base.table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("value"), (F.abs("s_acctbal") * 0.1 + 1).alias("sigma"))
    return rs.parametric_replicas(c, 20, base.SEED)


@query(f"WITH {base.REPLICA} SELECT corr_id, replica, t, round(re, 4) AS re FROM replica WHERE replica < 10")
def f6_first_replicas(spark, d):
    return rounded(rs.first_replicas(base.replicas(spark, d), 10), "re").drop("im")


ORDERED = "WITH x AS (SELECT l_returnflag AS corr_id, l_orderkey % 100 AS config, CASE WHEN l_linenumber > 2 THEN l_linenumber END AS src_t, l_orderkey || '_' || l_partkey || '_' || l_suppkey || '_' || l_linenumber AS file FROM lineitem GROUP BY ALL) SELECT corr_id, config, src_t, file, CAST(row_number() OVER (PARTITION BY corr_id ORDER BY {k}) AS INTEGER) AS place FROM x"


def _files(spark, d):
    li = base.table(spark, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("corr_id"), (F.col("l_orderkey") % 100).alias("config"), F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).alias("src_t"), F.concat_ws("_", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("file")).distinct()


@query(ORDERED.format(k="config, src_t NULLS FIRST, file"))
def f1_sample_order(spark, d):
    return rs.sample_order(_files(spark, d))


@query(ORDERED.format(k="src_t NULLS FIRST, file, config"))
def f2_sample_order_old(spark, d):
    return rs.sample_order(_files(spark, d), "old")


@query(f"""WITH {base.SAMPLES}, x AS (SELECT corr_id, t, re, im FROM samples UNION ALL SELECT corr_id || '_t_' || (o % 4), t, re, im FROM samples)
SELECT corr_id, t, count(*) AS n, round(avg(re), 4) AS re FROM x GROUP BY ALL""")
def f3_per_timeslice(spark, d):
    s = base.samples(spark, d).withColumn("src_t", F.col("o") % 4)
    return rounded(rs.per_timeslice(s).groupBy("corr_id", "t").agg(F.count("*").alias("n"), F.avg("re").alias("re")), "re")


@query(f"WITH {base.REPLICA} SELECT corr_id, replica, t, round(re, 4) AS re, round(im, 4) AS im FROM replica")
def a0_array_form(spark, d):
    return rounded(rs.to_long(rs.to_arrays(base.replicas(spark, d))), "re", "im").withColumn("t", F.col("t").cast("int"))


@query(f"WITH {base.CENTRAL} SELECT corr_id, t, round(ln(re - 52000), 4) AS x FROM central WHERE re > 52000")
def b12_finite_filter(spark, d):
    return rounded(rs.finite(base.central(spark, d).select("corr_id", "t", F.log(F.col("re") - 52000).alias("x")), "x"), "x")


@query(f"WITH {base.INDEX} SELECT {base.SEED}::BIGINT AS seed, replica, draw, bin FROM boot_index")
def d10_boot_index(spark, d):
    bins = base.binned(spark, d).select("bin").distinct().count()
    return rs.boot_index(spark, base.SEED, bins, base.REPLICAS)
