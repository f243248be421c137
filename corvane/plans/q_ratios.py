"""Queries: ratios, constants, form factors, statistical functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import statistics as st
from corvane.operators import ratios as rt

from . import base
from .base import FALLING
from .q_labels import MOM, mom
from .q_resample import rounded
from .q_series import BOTH, FX, fx
from .registry import query

CONST = "const AS (SELECT corr_id, replica, 0.3 + 1e-6 * re AS e0, 0.35 + 1e-6 * re AS e1, 1.1 + 1e-3 * im AS a0, 0.9 + 1e-3 * im AS a1, 0.8 AS z0, 0.7 AS z1 FROM replica WHERE t = 0)"


def const(spark, d):
    r = base.replicas(spark, d).where("t = 0")
    return r.select("corr_id", "replica", (0.3 + 1e-6 * F.col("re")).alias("e0"), (0.35 + 1e-6 * F.col("re")).alias("e1"), (1.1 + 1e-3 * F.col("im")).alias("a0"), (0.9 + 1e-3 * F.col("im")).alias("a1"), F.lit(0.8).alias("z0"), F.lit(0.7).alias("z1"))


@query(f"WITH {BOTH}, {CONST} SELECT c3.corr_id, c3.replica, c3.t, round((c2.x - k.a0 * k.a0 * exp(-k.e0 * 11)) / c3.x, 8) AS x FROM y c3 JOIN x c2 ON c2.corr_id = c3.corr_id AND c2.replica = c3.replica AND c2.t = 3 JOIN const k ON k.corr_id = c3.corr_id AND k.replica = c3.replica WHERE c3.t <= 3")
def c4_zv_ratio(spark, d):
    k = const(spark, d).select("corr_id", "replica", F.col("e0").alias("e"), F.col("a0").alias("a"))
    return rounded(rt.zv_ratio(fx(spark, d, "i"), fx(spark, d), k, 3, 14), "x", digits=8)


RJ = """, f AS (SELECT x.corr_id, x.replica, x.t, x.x AS fwd, y.x AS rev, x.x * 1.5 AS src, CASE WHEN x.corr_id <> 'N' THEN y.x * 0.5 END AS snk FROM x JOIN y USING (corr_id, replica, t)),
e AS (SELECT corr_id, replica, max(CASE WHEN t = 4 THEN x END) AS c0, max(CASE WHEN t = 6 THEN x END) AS m0 FROM x GROUP BY ALL),
g AS (SELECT corr_id, replica, max(CASE WHEN t = 4 THEN x END) AS c1, max(CASE WHEN t = 6 THEN x END) AS m1 FROM y GROUP BY ALL),
j AS (SELECT f.*, k.*, s.x AS c20, u.x AS c20r, v.x AS c21, w.x AS c21r, e.c0 - 0.5 * e.m0 * exp(-k.e0 * 2) AS t0, g.c1 - 0.5 * g.m1 * exp(-k.e1 * 2) AS t1 FROM f JOIN const k ON k.corr_id = f.corr_id AND k.replica = f.replica JOIN e ON e.corr_id = f.corr_id AND e.replica = f.replica JOIN g ON g.corr_id = f.corr_id AND g.replica = f.replica
 JOIN x s ON s.corr_id = f.corr_id AND s.replica = f.replica AND s.t = f.t JOIN x u ON u.corr_id = f.corr_id AND u.replica = f.replica AND u.t = 4 - f.t JOIN y v ON v.corr_id = f.corr_id AND v.replica = f.replica AND v.t = f.t JOIN y w ON w.corr_id = f.corr_id AND w.replica = f.replica AND w.t = 4 - f.t WHERE f.t <= 4)"""


def _three(spark, d):
    a, b = fx(spark, d), fx(spark, d, "i")
    return {"fwd": a, "rev": b, "src": a.withColumn("x", F.col("x") * 1.5), "snk": b.where("corr_id <> 'N'").withColumn("x", F.col("x") * 0.5)}, {"src": a, "snk": b}


@query(f"WITH {BOTH}, {CONST}{RJ} SELECT corr_id, replica, t, round(2 * sqrt(abs(e0 * e1 * fwd * rev) / abs(t0 * t1) * z0 * z1), 8) AS r1, round(2 * sqrt(abs(e0 * e1 * fwd * rev) / abs(src * snk)), 8) AS r2, round(a0 * a1 * sqrt(z0 * z1) * fwd / (c20 * c21r), 10) AS r3, round(a0 * a1 * sqrt(z0 * z1) * rev / (c21 * c20r), 10) AS r3_rev FROM j")
def c5_ratios(spark, d):
    r = rt.ratios(*_three(spark, d), const(spark, d), 4, 12)
    return r.withColumns({"r1": F.round("r1", 8), "r2": F.round("r2", 8), "r3": F.round("r3", 10), "r3_rev": F.round("r3_rev", 10)})


@query(f"WITH {BOTH}, {CONST}{RJ} SELECT corr_id, replica, t, round(2 * fwd * sqrt(e0 * e1 * exp((e0 - e1) * t + e1 * 4) * z0 * z1 / (c20 * c21r)), 8) AS r3, round(2 * rev * sqrt(e0 * e1 * exp((e1 - e0) * t + e0 * 4) * z0 * z1 / (c21 * c20r)), 8) AS r3_rev FROM j")
def c5_ratios_alternative(spark, d):
    return rounded(rt.ratios(*_three(spark, d), const(spark, d), 4, 12, alt_r3=True).select("corr_id", "replica", "t", "r3", "r3_rev"), "r3", "r3_rev", digits=8)


CUR = "cur AS (SELECT CAST(l_suppkey % 3 AS INTEGER) AS snk, CAST(l_partkey % 3 AS INTEGER) AS src, CAST(l_orderkey % 4 AS INTEGER) AS p, {k} AS x FROM lineitem WHERE {w} GROUP BY ALL)"


def _cur(spark, d, value, where):
    li = base.table(spark, d, "lineitem").where(where)
    g = li.groupBy((F.col("l_suppkey") % 3).cast("int").alias("snk"), (F.col("l_partkey") % 3).cast("int").alias("src"), (F.col("l_orderkey") % 4).cast("int").alias("p"))
    return g.agg(F.sum(value).alias("x"))


TEMPORAL, SPATIAL = "l_linenumber > 3", "l_linenumber <= 3 AND l_orderkey % 4 <> 2 AND l_orderkey % 4 <> 0"
CURRENTS = "WITH t AS (WITH " + CUR.format(k="sum(l_quantity)", w=TEMPORAL) + " SELECT * FROM cur), s AS (WITH " + CUR.format(k="sum(l_linenumber)", w=SPATIAL) + " SELECT * FROM cur)"


@query(CURRENTS + " SELECT t.snk, t.src, t.p, t.x, s.x::BIGINT AS spatial FROM t LEFT JOIN s USING (snk, src, p) WHERE t.p = 0 OR s.x IS NOT NULL")
def c6_match_currents(spark, d):
    return rt.match_currents(_cur(spark, d, "l_quantity", TEMPORAL), _cur(spark, d, "l_linenumber", SPATIAL))


@query(CURRENTS + " SELECT t.snk, t.src, t.p, t.x FROM t WHERE t.p <> 0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.snk = t.snk AND s.src = t.src AND s.p = t.p)")
def c6_unmatched_currents(spark, d):
    return rt.unmatched_currents(_cur(spark, d, "l_quantity", TEMPORAL), _cur(spark, d, "l_linenumber", SPATIAL))


@query("""WITH c AS (SELECT 'k' || (s_suppkey % 5) AS a, 'm' || (s_suppkey % 3) AS b, 'E' || (s_suppkey % 2) AS name, count(*)::DOUBLE AS value FROM supplier GROUP BY ALL),
need AS (SELECT DISTINCT 'k' || (p_partkey % 7) AS a, 'm' || (p_partkey % 3) AS b, 'E' || (p_partkey % 2) AS name, p_size % 2 = 0 AS turn FROM part)
SELECT CASE WHEN turn THEN n.b || '|' || n.a ELSE n.a || '|' || n.b END AS object, name, c.value FROM need n LEFT JOIN c USING (a, b, name)""")
def c7_lookup_constants(spark, d):
    name = lambda p, c, k: F.concat(F.lit(p), (F.col(c) % k).cast("string"))
    s = base.table(spark, d, "supplier")
    c = s.groupBy(F.array(name("k", "s_suppkey", 5), name("m", "s_suppkey", 3)).alias("object"), name("E", "s_suppkey", 2).alias("name")).agg(F.count("*").cast("double").alias("value")).withColumn("replica", F.lit(-1))
    pair = F.array(name("k", "p_partkey", 7), name("m", "p_partkey", 3))
    n = base.table(spark, d, "part").select(F.when(F.col("p_size") % 2 == 0, F.reverse(pair)).otherwise(pair).alias("object"), name("E", "p_partkey", 2).alias("name")).distinct()
    return rt.lookup_constants(n, c).select(F.array_join("object", "|").alias("object"), "name", "value")


@query("SELECT 'k' || (s_suppkey % 5) AS object, 'n' || (s_suppkey % 2) AS name, count(DISTINCT s_nationkey) AS n FROM supplier GROUP BY ALL HAVING count(DISTINCT s_nationkey) > 1")
def c7_conflicting_constants(spark, d):
    c = base.table(spark, d, "supplier").select(F.array(F.concat(F.lit("k"), F.col("s_suppkey") % 5)).alias("object"), F.concat(F.lit("n"), F.col("s_suppkey") % 2).alias("name"), F.lit(-1).alias("replica"), F.col("s_nationkey").alias("value"))
    return rt.conflicting_constants(c).select(F.array_join("object", "|").alias("object"), "name", "n")


@query("WITH l AS (SELECT DISTINCT c_mktsegment AS key, c_nationkey AS n FROM customer), v AS (SELECT n_nationkey AS n, n_regionkey * 1.5 AS value FROM nation WHERE n_nationkey % 3 <> 0) SELECT key || '_' || n AS key, coalesce(v.value, 1.0)::DOUBLE AS value FROM l LEFT JOIN v USING (n)")
def a13_constants_table(spark, d):
    key = lambda a, b: F.concat_ws("_", a, b).alias("key")
    c = base.table(spark, d, "customer").select(key("c_mktsegment", "c_nationkey"), "c_mktsegment", "c_nationkey").distinct()
    n = base.table(spark, d, "nation").where("n_nationkey % 3 <> 0")
    loaded = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("key", (F.col("n_regionkey") * 1.5).alias("value"))
    return rt.constants_table(c.select("key"), loaded)


ROT = "ops AS (SELECT CASE corr_id WHEN 'A' THEN 'P' ELSE 'W' END AS snk, CASE WHEN p = 0 THEN 'P' ELSE 'W' END AS src, replica, t, CASE p WHEN 0 THEN re ELSE im END AS x FROM falling, (SELECT unnest([0, 1]) AS p) WHERE corr_id <> 'R')"
ANG = "(SELECT unnest([0, 30, 90]) AS {n})"
SC = "CASE {n} WHEN 0 THEN 1.0 WHEN 90 THEN 0.0 ELSE cos(radians({n})) END / 1.25", "CASE {n} WHEN 0 THEN 0.0 WHEN 90 THEN 1.0 ELSE sin(radians({n})) END / 0.75"


def _rot(spark, d):
    f = base.falling(spark, d).where("corr_id <> 'R'").withColumn("p", F.explode(F.array(F.lit(0), F.lit(1))))
    s = f.select(F.when(F.col("corr_id") == "A", "P").otherwise("W").alias("snk"), F.when(F.col("p") == 0, "P").otherwise("W").alias("src"), "replica", "t", F.when(F.col("p") == 0, F.col("re")).otherwise(F.col("im")).alias("x"))
    a = spark.createDataFrame([("P", -1, 1.25), ("W", -1, 0.75)], "op string, replica int, a double")
    return s, a, F.array(*[F.lit(x) for x in (0, 30, 90)])


@query(f"WITH {FALLING}, {ROT} SELECT snk, theta, replica, t, round(sum(x * CASE src WHEN 'P' THEN {SC[0].format(n='theta')} ELSE {SC[1].format(n='theta')} END), 6) AS x FROM ops, {ANG.format(n='theta')} GROUP BY ALL")
def c8_rotate_source(spark, d):
    s, a, angles = _rot(spark, d)
    return rounded(rt.rotate(s, a, angles), "x", digits=6)


@query(f"WITH {FALLING}, {ROT} SELECT phi, theta, replica, t, round(sum(x * CASE src WHEN 'P' THEN {SC[0].format(n='theta')} ELSE {SC[1].format(n='theta')} END * CASE snk WHEN 'P' THEN {SC[0].format(n='phi')} ELSE {SC[1].format(n='phi')} END), 6) AS x FROM ops, {ANG.format(n='theta')}, {ANG.format(n='phi')} GROUP BY ALL")
def c8_rotate_both(spark, d):
    s, a, angles = _rot(spark, d)
    return rounded(rt.rotate(s, a, angles, angles), "x", digits=6)


CURVES = """cv AS (SELECT p_brand AS variation, p_size AS x, avg(p_retailprice) AS y FROM part GROUP BY ALL), ref AS (SELECT p_size AS x, avg(p_retailprice) AS y, avg(p_retailprice) - 10 AS lo, avg(p_retailprice) + 20 AS hi FROM part GROUP BY ALL),
cmp AS (SELECT variation, x, ref.y AS ref, (hi - lo) / (2 * ref.y) AS stat, (cv.y - ref.y) / ref.y AS sys FROM cv JOIN ref USING (x))"""


def _compared(spark, d):
    p = base.table(spark, d, "part")
    v = p.groupBy(F.col("p_brand").alias("variation"), F.col("p_size").alias("x")).agg(F.avg("p_retailprice").alias("y"))
    r = p.groupBy(F.col("p_size").alias("x")).agg(F.avg("p_retailprice").alias("y")).withColumns({"y_low": F.col("y") - 10, "y_high": F.col("y") + 20})
    return rt.compare_curves(v, r)


@query(f"WITH {CURVES} SELECT variation, x, round(ref, 6) AS ref, round(stat, 9) AS stat, round(sys, 9) AS sys, round(sqrt(stat * stat + sys * sys), 9) AS total FROM cmp")
def c9_compare_curves(spark, d):
    return rounded(rounded(_compared(spark, d).select("variation", "x", "ref", "stat", "sys", "total"), "ref", digits=6), "stat", "sys", "total", digits=9)


@query(f"WITH {CURVES}, b AS (SELECT x, any_value(stat) AS stat, max(abs(sys)) AS sys FROM cmp GROUP BY x) SELECT x, round(stat, 9) AS stat, round(sys, 9) AS sys, round(sqrt(stat * stat + sys * sys), 9) AS total FROM b")
def d32_error_budget(spark, d):
    return rounded(rt.error_budget(_compared(spark, d)), "stat", "sys", "total", digits=9)


@query(f"WITH {CURVES}, b AS (SELECT x, any_value(stat) AS stat, sqrt(sum(sys * sys)) AS sys FROM cmp GROUP BY x) SELECT x, round(stat, 9) AS stat, round(sys, 9) AS sys, round(sqrt(stat * stat + sys * sys), 9) AS total FROM b")
def d32_error_budget_quadrature(spark, d):
    return rounded(rt.error_budget(_compared(spark, d), "quadrature"), "stat", "sys", "total", digits=9)


ENS = "ens AS (SELECT r_name AS ensemble, 1.5 + r_regionkey * 0.25 AS a_inv, 0.1 + r_regionkey * 0.02 AS m_pi FROM region)"


def ensembles(spark, d):
    r = base.table(spark, d, "region")
    value = F.explode(F.array(F.struct(F.lit("a_inv").alias("name"), (1.5 + F.col("r_regionkey") * 0.25).alias("value")), F.struct(F.lit("m_pi").alias("name"), (0.1 + F.col("r_regionkey") * 0.02).alias("value"))))
    return r.select(F.col("r_name").alias("ensemble"), value.alias("v")).select("ensemble", "v.*")


@query(f"WITH {ENS} SELECT ensemble, c_custkey AS k, round(c_acctbal * a_inv, 6) AS scaled, round(m_pi * a_inv, 9) AS m_pi FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN ens ON ens.ensemble = r_name")
def c12_with_ensemble(spark, d):
    c = base.table(spark, d, "customer").join(base.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(base.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = rt.with_ensemble(c.select(F.col("r_name").alias("ensemble"), F.col("c_custkey").alias("k"), "c_acctbal"), ensembles(spark, d))
    return out.select("ensemble", "k", F.round(F.col("c_acctbal") * F.col("a_inv"), 6).alias("scaled"), F.round(F.col("m_pi") * F.col("a_inv"), 9).alias("m_pi"))


@query(f"WITH {FX} SELECT corr_id, replica, t, round(x * CASE corr_id WHEN 'A' THEN 1 / sqrt(24.0 * 24 * 24) WHEN 'N' THEN 1 / sqrt(24.0 * 24 * 24) / sqrt(64.0) ELSE 1 END, 8) AS x FROM x")
def b28_volume_normalisation(spark, d):
    f = spark.createDataFrame([("W", 24.0**3), ("P", 64.0)], "op string, volume double")
    ops = F.when(F.col("corr_id") == "A", F.array(F.lit("W"), F.lit("g5"))).when(F.col("corr_id") == "N", F.array(F.lit("W"), F.lit("P"))).otherwise(F.array(F.lit("g5")))
    return rounded(rt.vol_norm(fx(spark, d).withColumn("ops", ops), f).drop("ops"), "x", digits=8)


FF = f"{MOM}, ff AS (SELECT k, x, y, z, 1.0 + o_totalprice / 1e6 AS mh, 0.3 AS ml, 0.3 + 0.01 * (x * x + y * y + z * z) AS el, o_totalprice / 1e5 AS mel0, o_totalprice / 2e5 AS meli FROM m)"
AP = "(sqrt(x * x + y * y + z * z) * 2 * pi() / 24)"


@query(f"""WITH {FF}, g AS (SELECT *, mh * mh + ml * ml - 2 * mh * el AS q_sq, 0.72 * 0.95 * mel0 / sqrt(2 * mh) AS f_par, CASE WHEN x * x + y * y + z * z > 0 THEN 0.72 * 0.95 * meli / sqrt(2 * mh) / {AP} ELSE 0 END AS f_perp, mh + ml AS tp, 0.5 * (mh - ml) AS tz FROM ff)
SELECT k, round(q_sq, 8) AS q_sq, round(f_par, 8) AS f_par, round(f_perp, 8) AS f_perp, round(((mh - el) * f_perp + f_par) / sqrt(2 * mh), 8) AS f_plus, round(((el * el - ml * ml) * f_perp + (mh - el) * f_par) * sqrt(2 * mh) / (mh * mh - ml * ml), 8) AS f_zero,
round((sqrt(tp - q_sq) - sqrt(tp - tz)) / (sqrt(tp - q_sq) + sqrt(tp - tz)), 8) AS z_re FROM g""")
def b27_form_factor(spark, d):
    m = mom(spark, d).select("k", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("z").alias("nz"), (1.0 + F.col("o_totalprice") / 1e6).alias("mh"), F.lit(0.3).alias("ml"), (0.3 + 0.01 * (F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("el"), F.lit(0.72).alias("zv0"), F.lit(0.72).alias("zv1"), F.lit(0.95).alias("zv_mixed"), (F.col("o_totalprice") / 1e5).alias("mel0"), (F.col("o_totalprice") / 2e5).alias("meli"))
    return rounded(rt.form_factor(m, 24).select("k", "q_sq", "f_par", "f_perp", "f_plus", "f_zero", "z_re"), "q_sq", "f_par", "f_perp", "f_plus", "f_zero", "z_re", digits=8)


VS = "vs AS (SELECT o_orderkey AS k, 100 + o_totalprice AS v1, 1.0 + o_custkey % 3 AS s1, 200 + o_totalprice / 2 AS v2, 2.0 AS s2 FROM orders)"


def _vs(spark, d):
    o = base.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("k"), (100 + F.col("o_totalprice")).alias("v1"), (1.0 + F.col("o_custkey") % 3).alias("s1"), (200 + F.col("o_totalprice") / 2).alias("v2"), F.lit(2.0).alias("s2"))


@query(f"WITH {VS} SELECT k, round((v1 + v2) / 2, 4) AS v, round(CASE WHEN s1 = s2 THEN s1 ELSE sqrt(pow(s1 / v1, 2) + pow(s2 / v2, 2)) * (v1 + v2) / 2 END, 6) AS s, round((v1 + 2 * v2) / 3, 4) AS wv, round(sqrt((pow(s1 / v1, 2) + 2 * pow(s2 / v2, 2)) / 3) * (v1 + 2 * v2) / 3, 6) AS ws FROM vs")
def d28_average_with_errors(spark, d):
    c = F.col
    v, s = st.average_vs(c("v1"), c("s1"), c("v2"), c("s2"))
    wv, ws = st.average_vs(c("v1"), c("s1"), c("v2"), c("s2"), 1, 2)
    return _vs(spark, d).select("k", F.round(v, 4).alias("v"), F.round(s, 6).alias("s"), F.round(wv, 4).alias("wv"), F.round(ws, 6).alias("ws"))


@query(f"WITH {VS} SELECT k, round(v1 / sqrt(v2 * v1), 8) AS z, round(v1 / sqrt(v2 * v1) * sqrt(pow(s1 / v1, 2) + 0.25 * (pow(s2 / v2, 2) + pow(s1 / v1, 2))), 10) AS s FROM vs")
def d29_z_mixed(spark, d):
    c = F.col
    z, s = st.z_mixed(c("v2"), c("v1"), c("v1"), c("s2") / c("v2"), c("s1") / c("v1"), c("s1") / c("v1"))
    return _vs(spark, d).select("k", F.round(z, 8).alias("z"), F.round(s, 10).alias("s"))


@query("WITH v AS (SELECT c_custkey AS k, c_acctbal AS c, CAST(c_custkey % 7 - 3 AS DOUBLE) AS f FROM customer) SELECT k, round(CASE WHEN f < 0 THEN (c + 2) * f ELSE (c - 2) * f END, 4) + 0.0 AS low, round(c * f, 4) + 0.0 AS central, round(CASE WHEN f < 0 THEN (c - 2) * f ELSE (c + 2) * f END, 4) + 0.0 AS high FROM v")
def b23_scale_value(spark, d):
    c = base.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("c"), (F.col("c_custkey") % 7 - 3).cast("double").alias("f"))
    v = F.struct(*[(F.col("c") + x).alias(n) for n, x in (("min", -3), ("low", -2), ("central", 0), ("high", 2), ("max", 3), ("check", 0))])
    return c.withColumn("s", st.scale_ve(v, F.col("f"))).select("k", *[(F.round(F.col(f"s.{n}"), 4) + 0.0).alias(n) for n in ("low", "central", "high")])


@query()
def b22_value_error_text(spark, d):
    v = _vs(spark, d)
    return v.select("k", st.fmt_val_err(F.col("v1"), F.col("v1") - F.col("s1"), F.col("v1") + F.col("s1")).alias("text"))


@query()
def b24_q_chi_square(spark, d):
    return _vs(spark, d).select("k", st.q_chisq((F.col("k") % 50).cast("double"), (F.col("k") % 9).cast("int")).alias("q"))


@query()
def b25_q_hotelling(spark, d):
    return _vs(spark, d).select("k", st.q_hotelling((F.col("k") % 50).cast("double"), (F.col("k") % 9).cast("int"), F.lit(99)).alias("q"))


@query("SELECT s_suppkey AS k, round(2 * m * m * ln(abs(m / 1.0)), 9) AS chiral FROM (SELECT s_suppkey, 0.1 + abs(s_acctbal) / 20000 AS m FROM supplier)")
def b26_chiral_log(spark, d):
    return base.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.round(st.chiral_log(0.1 + F.abs("s_acctbal") / 20000, 1.0), 9).alias("chiral"))


@query()
def b26_finite_volume(spark, d):
    s = base.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (0.1 + F.abs("s_acctbal") / 20000).alias("m"), F.lit(13.0).alias("l"))
    return st.finite_volume(s, "m", "l", 24, ["k"])
