"""Queries: series algebra and replica joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import series as sr

from . import base
from .base import CENTRAL, FALLING, NT, REPLICA, SAMPLES
from .q_resample import rounded
from .registry import query

X = REPLICA + ", x AS (SELECT corr_id, replica, t, re AS x FROM replica)"
FX = FALLING + ", x AS (SELECT corr_id, replica, t, re AS x FROM falling)"
BOTH = FALLING + ", x AS (SELECT corr_id, replica, t, re AS x FROM falling), y AS (SELECT corr_id, replica, t, im AS x FROM falling)"


def x_of(spark, d):
    return sr.pick(base.replicas(spark, d), "r")


def fx(spark, d, part="r"):
    return sr.pick(base.falling(spark, d), part)


@query(f"WITH {SAMPLES} SELECT corr_id, CAST((((t - o % 7) % 7) + 7) % 7 AS INTEGER) AS t, count(*) AS n, round(avg(re), 6) AS re FROM samples GROUP BY 1, 2")
def b1_align_t(spark, d):
    a = sr.align_t(base.samples(spark, d), F.col("o") % 7, NT)
    return rounded(a.groupBy("corr_id", F.col("t").cast("int").alias("t")).agg(F.count("*").alias("n"), F.avg("re").alias("re")), "re", digits=6)


@query(f"WITH {REPLICA} SELECT corr_id, replica, CAST((((8 - t) % 7) + 7) % 7 AS INTEGER) AS t, round(re, 4) AS re, round(-im, 4) AS im FROM replica")
def b2_time_reverse(spark, d):
    return rounded(sr.time_reverse(base.replicas(spark, d), 2, 4, NT), "re", "im")


MODE = "CASE corr_id WHEN 'A' THEN '-' WHEN 'N' THEN '*' ELSE '-*' END"


@query(f"WITH {REPLICA}, m AS (SELECT *, {MODE} AS m FROM replica) SELECT corr_id, replica, t, round(CASE WHEN contains(m, '-') THEN -re ELSE re END, 4) AS re, round(CASE WHEN contains(m, '-') <> contains(m, '*') THEN -im ELSE im END, 4) AS im FROM m")
def b3_negate_star(spark, d):
    return rounded(sr.negate_star(base.replicas(spark, d), F.expr(MODE)), "re", "im")


@query(f"""WITH {SAMPLES}, p AS (SELECT *, o % 3 - 1 AS px, pk % 3 - 1 AS py, sk % 2 AS pz FROM samples),
s AS (SELECT corr_id, t, 'X' AS component, re / px AS re FROM p WHERE px <> 0 UNION ALL SELECT corr_id, t, 'Y', re / py FROM p WHERE py <> 0 UNION ALL SELECT corr_id, t, 'Z', re / pz FROM p WHERE pz <> 0)
SELECT corr_id, t, component, count(*) AS n, round(sum(re), 2) AS re FROM s GROUP BY ALL""")
def b4_spread_components(spark, d):
    p = base.samples(spark, d).withColumns({"px": F.col("o") % 3 - 1, "py": F.col("pk") % 3 - 1, "pz": F.col("sk") % 2})
    return rounded(sr.spread_components(p).groupBy("corr_id", "t", "component").agg(F.count("*").alias("n"), F.sum("re").alias("re")), "re", digits=2)


OPS = """ops AS (SELECT CASE pk % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'W' ELSE 'A' END AS snk, CASE sk % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'W' ELSE 'A' END AS src, t, re, im FROM samples)"""


def ops(spark, d):
    name = lambda c: F.when(F.col(c) % 3 == 0, "P").when(F.col(c) % 3 == 1, "W").otherwise("A")
    return base.samples(spark, d).select(name("pk").alias("snk"), name("sk").alias("src"), "t", "re", "im")


@query(f"WITH {SAMPLES}, {OPS}, b AS (SELECT * FROM ops UNION ALL SELECT src, snk, t, re, im FROM ops WHERE snk <> src) SELECT least(snk, src) || '_' || greatest(snk, src) AS pair, snk, src, t, count(*) AS n, round(avg(re), 6) AS re FROM b GROUP BY ALL")
def b5_sym_ops(spark, d):
    g = sr.sym_ops(ops(spark, d)).groupBy("pair", "snk", "src", "t")
    return rounded(g.agg(F.count("*").alias("n"), F.avg("re").alias("re")), "re", digits=6)


@query(f"WITH {REPLICA} SELECT corr_id, replica, t, round(im, 4) AS x FROM replica")
def b6_pick_imaginary(spark, d):
    return rounded(sr.pick(base.replicas(spark, d), "i"), "x")


FOLD = "SELECT a.corr_id, a.replica, a.t, round(CASE WHEN a.t = 0 THEN {first} ELSE {half} * (a.x {op} b.x) END, 4) AS x FROM x a JOIN x b ON a.corr_id = b.corr_id AND a.replica = b.replica AND b.t = (7 - a.t) % 7 WHERE a.t < {n}"


@query(f"WITH {X} " + FOLD.format(first="abs(a.x)", half="0.5", op="+", n=4))
def b7_fold_even(spark, d):
    return rounded(sr.fold(base.replicas(spark, d), NT), "x")


@query(f"WITH {X} " + FOLD.format(first="a.x", half="-0.5", op="-", n=3))
def b7_fold_odd_negative(spark, d):
    return rounded(sr.fold(base.replicas(spark, d), NT, odd=True, negative=True, t0_abs=False), "x")


ATTR = "a AS (SELECT DISTINCT l_returnflag AS x, CASE WHEN l_quantity > 25 THEN 'real' ELSE 'imag' END AS r, CASE WHEN l_linenumber > 3 THEN 'even' ELSE 'odd' END AS p, CASE WHEN l_tax > 0.04 THEN 1 ELSE -1 END AS s FROM lineitem)"


@query(f"WITH {ATTR} SELECT a.x AS left_id, b.x AS right_id, CASE WHEN a.r = b.r THEN 'real' ELSE 'imag' END AS reality, CASE WHEN a.p = b.p THEN 'even' ELSE 'odd' END AS parity, a.s * b.s * CASE WHEN a.r = 'imag' AND b.r = 'imag' THEN -1 ELSE 1 END AS sign, count(*) AS n FROM a JOIN a b ON a.x <> b.x GROUP BY ALL")
def b9_reality_parity_sign(spark, d):
    li = base.table(spark, d, "lineitem")
    a = li.select(F.col("l_returnflag").alias("x"), F.when(F.col("l_quantity") > 25, "real").otherwise("imag").alias("r"), F.when(F.col("l_linenumber") > 3, "even").otherwise("odd").alias("p"), F.when(F.col("l_tax") > 0.04, 1).otherwise(-1).alias("s")).distinct()
    b = a.select(*[F.col(c).alias(c + "2") for c in a.columns])
    m = a.join(b, F.col("x") != F.col("x2"))
    r, p, s = sr.rps_mul((F.col("r"), F.col("p"), F.col("s")), (F.col("r2"), F.col("p2"), F.col("s2")))
    return m.select(F.col("x").alias("left_id"), F.col("x2").alias("right_id"), r.alias("reality"), p.alias("parity"), s.alias("sign")).groupBy("left_id", "right_id", "reality", "parity", "sign").agg(F.count("*").alias("n"))


NEIGHBOURS = "n AS (SELECT corr_id, replica, t, x, coalesce(lag(x) OVER w, last_value(x) OVER f) AS p, coalesce(lead(x) OVER w, first_value(x) OVER f) AS q FROM x WINDOW w AS (PARTITION BY corr_id, replica ORDER BY t), f AS (PARTITION BY corr_id, replica ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


@query(f"WITH {FX}, {NEIGHBOURS} SELECT corr_id, replica, t, round(CASE WHEN t = 0 THEN 'nan'::DOUBLE WHEN t <= 3 THEN ln(p / x) ELSE ln(q / x) END, 6) AS log_mass FROM n")
def b10_log_mass(spark, d):
    return sr.eff_mass(fx(spark, d), NT).select("corr_id", "replica", "t", F.round("log_mass", 6).alias("log_mass"))


@query(f"WITH {FX}, {NEIGHBOURS} SELECT corr_id, replica, t, round(acosh((p + q) / (2 * x)), 6) AS cosh_mass FROM n")
def b11_cosh_mass(spark, d):
    return sr.eff_mass(fx(spark, d), NT).select("corr_id", "replica", "t", F.round("cosh_mass", 6).alias("cosh_mass"))


@query(f"WITH {REPLICA} SELECT a.corr_id, a.replica, a.t, round(a.re / c.re, 8) AS div_re, round(a.im / c.im, 8) AS div_im, round(a.re * a.re + a.im * a.im, 2) AS mod_sq, round((c.re - a.re) / a.re, 8) AS rel_re FROM replica a JOIN replica c ON a.corr_id = c.corr_id AND a.t = c.t AND c.replica = -1")
def b13_component_ops(spark, d):
    r = base.replicas(spark, d)
    c = r.where("replica = -1").select("corr_id", "t", F.col("re").alias("re2"), F.col("im").alias("im2"))
    o = sr.component_ops(r.join(c, ["corr_id", "t"]))
    return rounded(o.select("corr_id", "replica", "t", "div_re", "div_im", F.round("mod_sq", 2).alias("mod_sq"), "rel_re"), "div_re", "div_im", "rel_re", digits=8)


@query(f"WITH {CENTRAL} SELECT corr_id, t, round((im * 2000 - re) / re, 8) AS rel FROM central")
def b14_relative_difference(spark, d):
    return base.central(spark, d).select("corr_id", "t", F.round(sr.rel_diff(F.col("re"), F.col("im") * 2000), 8).alias("rel"))


@query(f"WITH {FX} SELECT a.corr_id, a.replica, a.t, round(a.x, 4) AS x, round(b.x, 4) AS y FROM x a JOIN (SELECT * FROM x WHERE replica < 20) b USING (corr_id, replica, t)")
def c1_join_checked(spark, d):
    x = fx(spark, d)
    attr = x.groupBy("corr_id").agg((F.max("t") + 1).alias("nt"), F.lit(base.SEED).alias("seed"), F.lit(base.BINS).alias("sample_size"))
    y = x.where("replica < 20").withColumnRenamed("x", "y")
    return rounded(sr.join_checked(x, y, attr, attr), "x", "y")


@query(f"WITH {X} SELECT a.corr_id, a.replica, a.t, round(a.x / b.x, 8) AS x FROM x a JOIN x b ON a.replica = b.replica AND a.t = b.t AND b.corr_id = 'R'")
def c2_divide(spark, d):
    x = x_of(spark, d)
    return rounded(sr.divide(x, x.where("corr_id = 'R'")), "x", digits=8)


@query(f"WITH {base.BINNED} SELECT a.corr_id, a.bin, a.t, round(a.re / b.re, 8) AS x FROM binned a JOIN binned b ON a.bin = b.bin AND a.t = b.t AND b.corr_id = 'R'")
def c2_divide_binned(spark, d):
    b = base.binned(spark, d).select("corr_id", "bin", "t", F.col("re").alias("x"))
    return rounded(sr.divide(b, b.where("corr_id = 'R'"), on=("bin", "t")), "x", digits=8)


PAIRS = "pairs AS (SELECT snk, src, t, avg(re) AS x FROM ops WHERE snk <> src GROUP BY ALL)"


@query(f"WITH {SAMPLES}, {OPS}, {PAIRS} SELECT a.snk, a.src, a.t, round((a.x + b.x) / 2, 6) AS x FROM pairs a JOIN pairs b ON a.snk = b.src AND a.src = b.snk AND a.t = b.t WHERE a.snk < a.src")
def c3_conj_average(spark, d):
    p = ops(spark, d).where("snk <> src").groupBy("snk", "src", "t").agg(F.avg("re").alias("x"))
    return rounded(sr.conj_average(p, on=("t",)), "x", digits=6)


@query(f"WITH {REPLICA}, w AS (SELECT replica, bin, count(*) AS k FROM boot_index GROUP BY ALL) SELECT corr_id, {base.SEED}::BIGINT AS seed, replica, t, round(sum(re * k) / sum(k), 4) AS re, round(sum(im * k) / sum(k), 4) AS im FROM binned JOIN w USING (bin) GROUP BY ALL")
def c10_draw_means(spark, d):
    from corvane.operators import resample

    return rounded(resample.draw_means(base.binned(spark, d), resample.boot_index(spark, base.SEED, base.BINS, base.REPLICAS)), "re", "im")


@query(f"WITH {BOTH} SELECT a.corr_id, a.t, round(a.x / s.x, 8) AS forward, round(-b.x / s.x, 8) AS reversed FROM x a JOIN y b ON a.corr_id = b.corr_id AND b.t = 6 - a.t AND b.replica = -1 JOIN x s ON s.corr_id = a.corr_id AND s.t = 3 AND s.replica = -1 WHERE a.replica = -1")
def c14_compare_reversed(spark, d):
    c = lambda p: fx(spark, d, p).where("replica = -1").drop("replica")
    return rounded(sr.compare_reversed(c("r"), c("i"), 6, negate=True), "forward", "reversed", digits=8)


@query(f"WITH {X} SELECT corr_id, replica, t, round(a.x, 4) AS a, round(CASE WHEN replica < 20 THEN b.re * (1 + (replica % 3) * 1e-4) END, 4) AS b FROM x a LEFT JOIN replica b USING (corr_id, replica, t) WHERE replica >= 20 OR abs(a.x - b.re * (1 + (replica % 3) * 1e-4)) > 1.5e-4 * abs(a.x)")
def c13_table_diff(spark, d):
    x = x_of(spark, d)
    y = x.where("replica < 20").withColumn("x", F.col("x") * (1 + F.expr("mod(replica, 3)") * 1e-4))
    return rounded(sr.table_diff(x, y, ("corr_id", "replica", "t"), rtol=1.5e-4), "a", "b")


@query(f"WITH {X}, {NEIGHBOURS} SELECT corr_id, replica, t, round(p, 4) AS prev, round(q, 4) AS next FROM n")
def e1_wrap_neighbours(spark, d):
    return rounded(sr.wrap_neighbours(x_of(spark, d)), "prev", "next").drop("x")


@query(f"WITH {FX}, l AS (SELECT corr_id, replica, t, x, lag(t) OVER w AS tp, lag(x) OVER w AS xp FROM x WHERE t IN (0, 1, 3, 6) WINDOW w AS (PARTITION BY corr_id, replica ORDER BY t)) SELECT corr_id, replica, (t + tp) / 2 AS t_mid, round(ln(xp / x) / (t - tp), 8) AS log_ratio FROM l WHERE tp IS NOT NULL")
def e2_gap_log_ratio(spark, d):
    return rounded(sr.gap_log_ratio(fx(spark, d).where("t IN (0, 1, 3, 6)"), by=("corr_id", "replica")), "log_ratio", digits=8)


@query(f"WITH {FX} SELECT a.corr_id, a.replica, a.t, round((a.x + b.x) / 2, 4) AS x FROM x a JOIN x b ON a.corr_id = b.corr_id AND a.replica = b.replica AND b.t = 6 - a.t")
def e3_symmetrise(spark, d):
    return rounded(sr.symmetrise(fx(spark, d), 6), "x")


@query(f"WITH {base.BINNED} SELECT corr_id, bin, t, round((sum(re) OVER w - re) / (count(*) OVER w - 1), 4) AS re FROM binned WINDOW w AS (PARTITION BY corr_id, t)")
def e7_leave_one_out(spark, d):
    from corvane.operators import resample

    return rounded(resample.jackknife(base.binned(spark, d)).where("replica >= 0").withColumnRenamed("replica", "bin").drop("im"), "re")


@query(f"WITH {SAMPLES}, b AS (SELECT corr_id, config, t, avg(re) - 52000 AS x FROM samples GROUP BY ALL), s AS (SELECT corr_id, config, CASE WHEN x < 0 THEN -1 ELSE 1 END AS s FROM b WHERE t = 1) SELECT a.corr_id, a.config, a.t, round(s.s * CASE WHEN a.t = 0 THEN a.x ELSE (a.x + m.x) / 2 END, 6) AS x FROM b a JOIN b m ON a.corr_id = m.corr_id AND a.config = m.config AND m.t = (7 - a.t) % 7 JOIN s ON s.corr_id = a.corr_id AND s.config = a.config WHERE a.t <= 3")
def a5_fold_on_import(spark, d):
    b = base.samples(spark, d).groupBy("corr_id", "config", "t").agg((F.avg("re") - 52000).alias("x"))
    return rounded(sr.fold_raw(b, NT, by=("corr_id", "config")), "x", digits=6)


SINGLE = CENTRAL + ", x AS (SELECT corr_id, -1 AS replica, t, re * exp(-0.4 * t) AS x FROM central)"


@query(f"WITH {SINGLE}, {NEIGHBOURS} SELECT corr_id, t, round(x, 4) AS x, round(CASE WHEN t = 0 THEN 'nan'::DOUBLE WHEN t <= 3 THEN ln(p / x) ELSE ln(q / x) END, 6) AS log_mass, round(acosh((p + q) / (2 * x)), 6) AS cosh_mass FROM n")
def a19_series_summary(spark, d):
    c = base.central(spark, d).select("corr_id", "t", (F.col("re") * F.exp(-0.4 * F.col("t"))).alias("x"))
    return rounded(rounded(sr.series_summary(c, NT), "x"), "log_mass", "cosh_mass", digits=6)
