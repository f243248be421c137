"""Queries: momenta, labels, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import kinematics as kn

from . import base
from .registry import query

MOM = "m AS (SELECT o_orderkey AS k, o_custkey, o_totalprice, CAST(o_orderkey % 5 AS INTEGER) - 2 AS x, CAST(o_custkey % 5 AS INTEGER) - 2 AS y, CAST((o_orderkey // 7) % 3 AS INTEGER) - 1 AS z FROM orders)"
QUARK = "CASE {c} % 4 WHEN 0 THEN 'l' WHEN 1 THEN 's' WHEN 2 THEN 'h385' ELSE 'H6413' END"


def mom(spark, d):
    return base.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), "o_custkey", "o_totalprice", ((F.col("o_orderkey") % 5).cast("int") - 2).alias("x"), ((F.col("o_custkey") % 5).cast("int") - 2).alias("y"),
        ((F.floor(F.col("o_orderkey") / 7) % 3).cast("int") - 1).alias("z"),
    )


def xyz():
    return F.col("x"), F.col("y"), F.col("z")


def quark(c):
    return F.expr(QUARK.format(c=c))


@query(f"WITH {MOM} SELECT k, x * x + y * y + z * z AS p2, abs(x) AS ax, abs(y) AS ay, abs(z) AS az, CASE WHEN x <> 0 THEN x < 0 WHEN y <> 0 THEN y < 0 ELSE z < 0 END AS negative FROM m")
def b15_momentum_predicates(spark, d):
    return mom(spark, d).select("k", kn.p2(*xyz()).alias("p2"), F.abs("x").alias("ax"), F.abs("y").alias("ay"), F.abs("z").alias("az"), kn.is_negative(*xyz()).alias("negative"))


@query(f"WITH {MOM}, v AS (SELECT x, y, z, count(*) AS n FROM m GROUP BY ALL) SELECT a.x AS ax, a.y AS ay, a.z AS az, count(*) AS equal FROM v a JOIN v b ON CASE WHEN a.n % 2 = 0 OR b.n % 2 = 0 THEN a.x*a.x+a.y*a.y+a.z*a.z = b.x*b.x+b.y*b.y+b.z*b.z ELSE a.x = b.x AND a.y = b.y AND a.z = b.z END GROUP BY ALL")
def b15_momentum_equality(spark, d):
    v = mom(spark, d).groupBy("x", "y", "z").agg((F.count("*") % 2 == 0).alias("is_p2"))
    a, b = (v.select(F.struct("x", "y", "z", "is_p2").alias(n), kn.p2(*xyz()).alias("p2_" + n)) for n in "ab")
    met = a.join(b, F.col("p2_a") == F.col("p2_b")).where(kn.same_momentum(F.col("a"), F.col("b")))
    return met.groupBy(F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("a.z").alias("az")).agg(F.count("*").alias("equal"))


GREEDY = """g1 AS (SELECT k, n, CAST(floor(sqrt(n)) AS INTEGER) AS x FROM n), g2 AS (SELECT *, CAST(floor(sqrt(n - x * x)) AS INTEGER) AS y FROM g1), g3 AS (SELECT *, CAST(floor(sqrt(n - x * x - y * y)) AS INTEGER) AS z FROM g2)"""


@query(f"WITH n AS (SELECT o_orderkey AS k, CAST(o_orderkey % 30 AS INTEGER) AS n FROM orders), {GREEDY} SELECT k, n, CASE WHEN x*x+y*y+z*z = n THEN x END AS x, CASE WHEN x*x+y*y+z*z = n THEN y END AS y, CASE WHEN x*x+y*y+z*z = n THEN z END AS z FROM g3")
def b16_p2_components(spark, d):
    o = base.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 30).cast("int").alias("n"))
    return o.withColumn("c", kn.p2_components(F.col("n"))).select("k", "n", "c.x", "c.y", "c.z")


@query(f"WITH {MOM}, v AS (SELECT x, y, z, count(*) AS n FROM m GROUP BY ALL) SELECT x, y, z, n, CAST(row_number() OVER (ORDER BY x*x+y*y+z*z, x, y, z) AS INTEGER) AS place FROM v")
def b17_momentum_order(spark, d):
    from pyspark.sql import Window as W

    v = mom(spark, d).groupBy("x", "y", "z").agg(F.count("*").alias("n"))
    return v.withColumn("place", F.row_number().over(W.orderBy(*kn.momentum_order(*xyz()))))


@query(f"WITH {MOM} SELECT k, '_p_' || x || '_' || y || '_' || z AS vector, '_p2_' || (x*x+y*y+z*z) AS square, x AS px, false AS is_p2, 'C_none_t_5' AS replaced FROM m")
def b18_momentum_names(spark, d):
    m = mom(spark, d).select("k", kn.fmt_momentum("p", *xyz()).alias("vector"), kn.fmt_momentum("p", *xyz(), square=True).alias("square"))
    name = F.concat(F.lit("C"), F.col("vector"), F.lit("_t_5"))
    got = kn.momentum_of(name)
    return m.withColumns({"px": got["x"], "is_p2": got["is_p2"], "replaced": kn.replace_momentum(name, "p", "_none")})


DISP = f"WITH {MOM}, e AS (SELECT k, x, y, z, 0.2 + o_totalprice / 1000000 AS mass FROM m) SELECT k, "
PZERO = "CASE WHEN x = 0 AND y = 0 AND z = 0 THEN mass ELSE {} END"


@query(DISP + ", ".join([
    "round(" + PZERO.format("sqrt(mass * mass + pow(2 * pi() * x / 24, 2) + pow(2 * pi() * y / 24, 2) + pow(2 * pi() * z / 24, 2))") + ", 8) AS continuum",
    "round(" + PZERO.format("2 * asinh(sqrt(pow(sinh(mass / 2), 2) + pow(sin(pi() * x / 24), 2) + pow(sin(pi() * y / 24), 2) + pow(sin(pi() * z / 24), 2)))") + ", 8) AS lattice",
    "round(" + PZERO.format("sqrt(greatest(mass * mass - pow(2 * pi() * x / 24, 2) - pow(2 * pi() * y / 24, 2) - pow(2 * pi() * z / 24, 2), 0))") + ", 8) AS inverse",
]) + " FROM e")
def b19_dispersion(spark, d):
    m = mom(spark, d).withColumn("mass", 0.2 + F.col("o_totalprice") / 1000000)
    e = lambda kind, inverse=False: F.round(kn.dispersion(F.col("mass"), 24, *xyz(), kind, inverse), 8)
    return m.select("k", e("continuum").alias("continuum"), e("lattice").alias("lattice"), e("continuum", True).alias("inverse"))


@query(f"""WITH q AS (SELECT o_orderkey AS k, {QUARK.format(c='o_orderkey')} AS a, {QUARK.format(c='o_custkey')} AS b FROM orders),
w AS (SELECT *, CASE a WHEN 'l' THEN -2 WHEN 's' THEN -1 ELSE CAST(substr(a, 2) AS INTEGER) END AS wa, CASE b WHEN 'l' THEN -2 WHEN 's' THEN -1 ELSE CAST(substr(b, 2) AS INTEGER) END AS wb FROM q),
n AS (SELECT *, CASE WHEN wa >= wb THEN a || '_' || b ELSE b || '_' || a END AS pair, greatest(wa, wb) AS h, least(wa, wb) AS l FROM w)
SELECT k, wa AS weight, pair, CASE WHEN h >= 0 AND l = -1 THEN 'Ds' WHEN h >= 0 AND l = -2 THEN 'D' WHEN h = -1 AND l = -2 THEN 'K' WHEN h = -2 THEN 'Pi' ELSE pair END AS meson FROM n""")
def b20_quark_labels(spark, d):
    q = base.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), quark("o_orderkey").alias("a"), quark("o_custkey").alias("b"))
    return q.select("k", kn.quark_weight(F.col("a")).alias("weight"), kn.concat_heavy_first(F.col("a"), F.col("b")).alias("pair"), kn.meson_name(F.col("a"), F.col("b")).alias("meson"))


@query("WITH c AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'gt' WHEN 1 THEN 'G5' WHEN 2 THEN 'gxyz' ELSE 'g-sXT' END AS name FROM part) SELECT k, name, CASE name WHEN 'gt' THEN 3 WHEN 'G5' THEN 1 WHEN 'gxyz' THEN -2 ELSE 20 END AS code, CASE name WHEN 'gt' THEN 'GammaT' WHEN 'G5' THEN 'Gamma5' WHEN 'gxyz' THEN 'Spatial' ELSE 'MinusSigmaXT' END AS \"long\" FROM c")
def b21_gamma_names(spark, d):
    k = F.col("p_partkey") % 4
    c = base.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.when(k == 0, "gt").when(k == 1, "G5").when(k == 2, "gxyz").otherwise("g-sXT").alias("name"))
    return kn.with_gamma(c, "name").select("k", "name", "code", "long")


@query("SELECT DISTINCT r_regionkey, v FROM region, (SELECT unnest(list_concat(range(0, 91, 20), [45, 90])) AS v)")
def b29_start_stop_step(spark, d):
    return base.table(spark, d, "region").select("r_regionkey", F.explode(kn.start_stop_step(0, 90, 20, [0, 45, 90])).alias("v")).withColumn("v", F.col("v").cast("long"))


@query("WITH g AS (SELECT p_partkey AS k, CAST(p_size * 15 AS INTEGER) AS deg FROM part) SELECT k, deg, round(CASE WHEN deg % 360 IN (0, 180) THEN 0 ELSE sin(radians(deg)) END, 10) AS s, round(CASE WHEN deg % 360 IN (90, 270) THEN 0 ELSE cos(radians(deg)) END, 10) AS c FROM g")
def b30_sincos(spark, d):
    g = base.table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 15).alias("deg"))
    s, c = kn.sincos_deg(F.col("deg"))
    return g.select("k", "deg", F.round(s, 10).alias("s"), F.round(c, 10).alias("c"))


@query("SELECT c_custkey, 'f_' || (c_custkey % 3) AS name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def b31_exclude(spark, d):
    c = base.table(spark, d, "customer").withColumn("name", kn.strip_tokens(F.concat(F.lit("f_"), F.col("c_custkey") % 3, F.lit("_q_1_0_0_junk7")), ["q"], [r"_junk\d+"]))
    return c.join(base.table(spark, d, "supplier"), c["c_custkey"] == F.col("s_suppkey"), "left_anti").select("c_custkey", "name")


@query(f"WITH {MOM} SELECT 'g_p2_' || (x*x+y*y+z*z) AS square, 'g_p_' || abs(x) || '_' || abs(y) || '_' || abs(z) AS sizes, count(*) AS n FROM m GROUP BY ALL")
def b32_group_momenta(spark, d):
    m = mom(spark, d).select(kn.group_key(F.lit("g"), *xyz(), "p2").alias("square"), kn.group_key(F.lit("g"), *xyz(), "abs").alias("sizes"))
    return m.groupBy("square", "sizes").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS k, array_to_string(list_sort(string_split(replace(p_name, ' ', '_') || '_' || lower(p_brand), '_')), '_') AS name FROM part")
def b33_sorted_name(spark, d):
    n = F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), F.lower("p_brand"))
    return base.table(spark, d, "part").select(F.col("p_partkey").alias("k"), kn.sorted_name(n).alias("name"))


@query("SELECT p_partkey AS k, substr(p_name, 1, 1) AS snk, substr(p_type, 1, 1) AS src, 'corr_' || p_size AS name FROM part")
def b34_sink_source(spark, d):
    n = F.concat(F.lit("corr_"), F.col("p_size"), F.lit("_"), F.substring("p_name", 1, 1), F.substring("p_type", 1, 1))
    a, b, rest = kn.extract_sink_source(n, r"_(\w)(\w)$")
    return base.table(spark, d, "part").select(F.col("p_partkey").alias("k"), a.alias("snk"), b.alias("src"), rest.alias("name"))


CAN = f"c AS (SELECT o_orderkey AS k, {QUARK.format(c='o_orderkey')} AS q1, {QUARK.format(c='o_custkey')} AS q2, CAST(o_orderkey // 5 % 2 AS INTEGER) AS p1, CAST(o_custkey // 5 % 2 AS INTEGER) AS p2 FROM orders)"
WT = "CASE lower({c}) WHEN 'l' THEN -2 WHEN 's' THEN -1 ELSE CAST(substr({c}, 2) AS INTEGER) END"


@query(f"WITH {CAN}, b AS (SELECT k, q1, q2, p1, p2, false AS sw FROM c UNION ALL SELECT k, q2, q1, p2, p1, true FROM c) SELECT k, q1, q2, p1, p2 FROM b WHERE ((p1 = 0 AND p2 = 0) OR ({WT.format(c='q1')} >= {WT.format(c='q2')} AND p1 = 0)) AND NOT (q1 = q2 AND sw AND p1 = 0 AND p2 = 0)")
def a17_canonical_pairs(spark, d):
    f = lambda c: (F.floor(F.col(c) / 5) % 2).cast("int")
    c = base.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), quark("o_orderkey").alias("q1"), quark("o_custkey").alias("q2"), f("o_orderkey").alias("p1"), f("o_custkey").alias("p2"))
    return kn.canonical_pairs(c).drop("swapped")


@query("""SELECT o_orderkey AS k, 'run/C1/' AS dir, 'h5' AS ext, CAST(1835672416 AS BIGINT) AS seed, 'fold' AS type, 'g5W' AS op_snk, 'g5P' AS op_src, CASE WHEN o_orderkey % 3 = 0 THEN 'x1.x2' ELSE '' END AS extra,
CAST(o_custkey % 3 AS INTEGER) AS px, CAST(o_orderkey % 96 AS INTEGER) AS timeslice, CAST(12 + 4 * (o_custkey % 4) AS INTEGER) AS delta_t, 2 AS steps, 'gT' AS gamma, 'h' || (o_orderkey % 9) AS quark_h, 's' AS spectator FROM orders""")
def a2_file_attributes(spark, d):
    o = base.table(spark, d, "orders")
    i = lambda c: c.cast("string")
    stem = F.concat(F.lit("3pt_s_h"), i(F.col("o_orderkey") % 9), F.lit("_l_gT_dt_8_"), i(12 + 4 * (F.col("o_custkey") % 4)), F.lit("_p_"), i(F.col("o_custkey") % 3), F.lit("_0_-1_t_"), i(F.col("o_orderkey") % 96))
    path = F.concat(F.lit("run/C1/"), stem, F.when(F.col("o_orderkey") % 3 == 0, ".x1.x2").otherwise(""), F.lit(".g5W_g5P.fold.1835672416.h5"))
    a = kn.with_file_attrs(o.select(F.col("o_orderkey").alias("k"), path.alias("path")), "path")
    return a.select("k", "dir", "ext", "seed", "type", "op_snk", "op_src", "extra", F.col("momentum.x").alias("px"), "timeslice", "delta_t", F.size("delta_ts").alias("steps"), "gamma", "quark_h", "spectator")
