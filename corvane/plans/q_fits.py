"""Queries: models, fits, ranking, global fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import covariance as cv
from corvane.operators import fits as ft
from corvane.operators import globalfit as gf
from corvane.operators import joint as jt
from corvane.operators import ranges as rg
from corvane.operators import select as sl
from corvane.sources.scratch import staged

from . import base
from .base import FALLING
from .q_resample import rounded
from .q_series import FX, fx
from .registry import query

PAR = "p AS (SELECT o_orderkey AS k, CAST(o_orderkey % 12 AS INTEGER) AS t, 0.3 + o_totalprice / 1e6 AS e0, 0.9 + o_totalprice / 1e6 AS e1, 1.0 + o_custkey % 7 AS a0, 0.5 + o_custkey % 5 AS a1 FROM orders)"
c = F.col


def par(spark, d):
    o = base.table(spark, d, "orders")
    return o.select(c("o_orderkey").alias("k"), (c("o_orderkey") % 12).cast("int").alias("t"), (0.3 + c("o_totalprice") / 1e6).alias("e0"), (0.9 + c("o_totalprice") / 1e6).alias("e1"), (1.0 + c("o_custkey") % 7).alias("a0"), (0.5 + c("o_custkey") % 5).alias("a1"))


def two_levels():
    return [c("e0"), c("e1")], [c("a0"), c("a1")]


def shown(df, value, digits=8):
    return df.select("k", F.round(value, digits).alias("x"))


@query(f"WITH {PAR} SELECT k, round(a0 * a0 * exp(-e0 * t) / (2 * e0) + a1 * a1 * exp(-e1 * t) / (2 * e1), 8) AS x FROM p")
def j1_model_exp(spark, d):
    return shown(par(spark, d), ft.m_exp(c("t"), *two_levels()))


WAVE = "a{i} * a{i} * (exp(-e{i} * t) {s} exp(-e{i} * (24 - t))) / (2 * e{i})"


@query(f"WITH {PAR} SELECT k, round({WAVE.format(i=0, s='+')} + {WAVE.format(i=1, s='+')}, 8) AS x FROM p")
def j2_model_cosh(spark, d):
    return shown(par(spark, d), ft.m_cosh(c("t"), *two_levels(), 24))


@query(f"WITH {PAR} SELECT k, round({WAVE.format(i=0, s='-')} + {WAVE.format(i=1, s='-')}, 8) AS x FROM p")
def j2_model_sinh(spark, d):
    return shown(par(spark, d), ft.m_sinh(c("t"), *two_levels(), 24))


TP = "(a0 * a0 * 0.7 * exp(-e0 * (16 - t) - e0 * t) / (4 * e0 * e0) + a0 * a1 * 0.2 * exp(-e0 * (16 - t) - e1 * t) / (4 * e0 * e1) + a1 * a0 * 0.3 * exp(-e1 * (16 - t) - e0 * t) / (4 * e1 * e0))"


def _c3():
    mel = [[F.lit(0.7), F.lit(0.2)], [F.lit(0.3), F.lit(0.1)]]
    e, a = two_levels()
    return ft.m_3pt(c("t"), 16, e, e, a, a, mel)


@query(f"WITH {PAR} SELECT k, round({TP}, 8) AS x FROM p")
def j3_model_3pt(spark, d):
    return shown(par(spark, d), _c3())


TWO = "(a0 * a0 * exp(-e0 * {t}) / (2 * e0))"


@query(f"WITH {PAR} SELECT k, round({TP} / ({TWO.format(t='t')} * {TWO.format(t='(16 - t)')}) * a0 * a0, 8) AS x FROM p")
def j4_model_r3(spark, d):
    two = lambda t: ft.m_exp(t, [c("e0")], [c("a0")])
    return shown(par(spark, d), ft.m_r3(_c3(), two(c("t")), two(16 - c("t")), c("a0"), c("a0")))


@query(f"WITH {PAR} SELECT k, round({TWO.format(t='16')} / {TP}, 8) AS x FROM p")
def j5_model_zv(spark, d):
    return shown(par(spark, d), ft.m_zv(ft.m_exp(F.lit(16), [c("e0")], [c("a0")]), _c3()))


@query(f"WITH {PAR} SELECT k, round(a0 * (1 + a1 * exp(-e0 * t)) + e1, 8) AS x FROM p")
def j6_model_const_misc(spark, d):
    return shown(par(spark, d), ft.m_misc(c("t"), c("a0"), c("a1"), c("e0")) + ft.m_const(c("e1")))


@query(f"WITH {PAR} SELECT k, round(1.0 / (e0 + 0.1) * (a0 * 1.02 + a1 * 0.05 + 0.3 * e0 + 0.1 * e0 * e0 + 0.2 / (e1 * e1)), 8) AS x FROM p")
def j7_model_continuum(spark, d):
    v = ft.m_continuum(c("e0"), c("e1"), F.lit(0.1), 1.0, c("a0"), F.lit(0.02), c("a1"), F.lit(0.05), [F.lit(0.3), F.lit(0.1)], [F.lit(0.2)])
    return shown(par(spark, d), v)


@query("SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'R3' WHEN 1 THEN 'ZV' WHEN 2 THEN 'ThreePoint' ELSE CASE p_size % 3 WHEN 0 THEN 'Cosh' WHEN 1 THEN 'Sinh' ELSE 'Exp' END END AS model FROM part")
def j8_default_model(spark, d):
    p = base.table(spark, d, "part")
    k, s = c("p_partkey") % 4, c("p_size") % 3
    name = F.concat(F.when(k == 0, "R3_l_").when(k == 1, "ZV_l_").when(k == 2, "3pt_l_").otherwise("meson_l_"), c("p_partkey"))
    parity = F.when(s == 0, "even").when(s == 1, "odd").otherwise("unknown")
    return p.select(c("p_partkey").alias("k"), ft.default_model(name, parity).alias("model"))


@query(f"WITH {FX}, l AS (SELECT corr_id, replica, x, t, lag(x) OVER w AS xp FROM x WINDOW w AS (PARTITION BY corr_id, replica ORDER BY t)), g AS (SELECT corr_id, replica, ln(abs(xp / x)) AS e, x FROM l WHERE t = 6) SELECT g.corr_id, g.replica, round(e, 8) AS energy, round(sqrt(abs(2 * e * g.x * exp(e * 6))), 4) AS amplitude, round(m, 4) AS mean FROM g JOIN (SELECT corr_id, replica, avg(x) AS m FROM x GROUP BY ALL) USING (corr_id, replica)")
def j9_guess(spark, d):
    g = ft.guess(fx(spark, d), by=("corr_id", "replica"))
    return rounded(rounded(g, "energy", digits=8), "amplitude", "mean")


@query()
def j9_guess_levels(spark, d):
    """Two levels of each order's series, which has two."""
    p = par(spark, d).select("k", "e0", "a0", "e1", "a1", F.explode(F.sequence(F.lit(1), F.lit(16))).alias("t"))
    x = p.select("k", "t", ft.m_exp(c("t"), *two_levels()).alias("x"))
    return ft.guess_levels(x, 2, by=("k",))


SIG = FX + ", s AS (SELECT corr_id, t, stddev_pop(x) AS sigma FROM x WHERE replica >= 0 GROUP BY ALL), pts AS (SELECT x.corr_id, replica, t, x, sigma FROM x JOIN s USING (corr_id, t))"


def pts(spark, d):
    x = fx(spark, d)
    return x.join(x.where("replica >= 0").groupBy("corr_id", "t").agg(F.stddev_pop("x").alias("sigma")), ["corr_id", "t"])


@query(f"WITH {SIG} SELECT corr_id, replica, round(sum(x / (sigma * sigma)) / sum(1 / (sigma * sigma)), 4) AS value, count(*) AS points FROM pts GROUP BY ALL")
def j10_fit_constant(spark, d):
    return rounded(ft.fit_constant(pts(spark, d)), "value")


@query(f"WITH {SIG}, n AS (SELECT corr_id, replica, sum(1 / sigma ** 2) AS s, sum(t / sigma ** 2) AS sx, sum(t * t / sigma ** 2) AS sxx, sum(x / sigma ** 2) AS sy, sum(t * x / sigma ** 2) AS sxy, count(*) AS n FROM pts WHERE t >= 4 GROUP BY ALL) SELECT corr_id, replica, round((sxx * sy - sx * sxy) / (s * sxx - sx * sx), 2) AS intercept, round((s * sxy - sx * sy) / (s * sxx - sx * sx), 3) AS slope, n - 2 AS dof FROM n")
def j11_fit_line(spark, d):
    f = ft.fit_line(pts(spark, d).where("t >= 4"))
    return f.select("corr_id", "replica", F.round("intercept", 2).alias("intercept"), F.round("slope", 3).alias("slope"), "dof")


@query()
def j11_fit_linear_correlated(spark, d):
    design = pts(spark, d).withColumn("row", F.array(F.lit(1.0), c("t").cast("double")))
    cov = cv.covariance(base.falling(spark, d).where("replica >= 0"), "replica", "bootstrap", "re")
    return ft.fit_linear(design, cv.inverse_cholesky(cov))


@query()
def j12_fit_replicas(spark, d):
    p = pts(spark, d).where("t <= 5").withColumn("fit_id", c("corr_id"))
    return ft.fit_replicas(p.select("fit_id", "replica", "t", "x", "sigma"), "exp", 24, [0.5, 150.0])


def joint_series(spark, d):
    """Of each returnflag the two falling series, which share their energy, and their ratio: (series, replica, t, x, sigma), specs, start values."""
    f = base.falling(spark, d).where("t <= 5")
    name = lambda x: F.concat(c("corr_id"), F.lit(f"_{x}"))
    wide = {"re": c("re"), "im": c("im"), "ratio": c("re") / c("im")}
    p = f.select("corr_id", "replica", "t", F.explode(F.array(*[F.struct(name(k).alias("series"), v.alias("x")) for k, v in wide.items()])).alias("s")).select("corr_id", "replica", "t", "s.*")
    p = p.join(p.where("replica >= 0").groupBy("series", "t").agg(F.stddev_pop("x").alias("sigma")), ["series", "t"])
    spec = lambda x, model, src, *params: F.struct(name(x).alias("series"), F.lit(model).alias("model"), F.lit(src).alias("src"), F.lit(0).alias("snk"), F.lit(0).alias("nt"), F.lit(0).alias("dt"), F.array(*[name(k) for k in params]).alias("params"))
    flags = f.select("corr_id").distinct()
    specs = flags.select(F.explode(F.array(spec("re", "exp", 1, "E", "A"), spec("im", "exp", 1, "E", "B"), spec("ratio", "const", 0, "K"))).alias("s")).select("s.*")
    start = flags.select(F.explode(F.array(*[F.struct(name(k).alias("name"), F.lit(v).alias("value")) for k, v in (("E", 0.5), ("A", 150.0), ("B", 4.0), ("K", 1000.0))])).alias("s")).select("s.*")
    return p, specs, start


@query()
def j12_joint_fit(spark, d):
    p, specs, start = joint_series(spark, d)
    specs = jt.linked_fits(specs)
    start = start.join(jt.positions(specs).select("fit_id", "name"), "name")
    points = p.join(specs.select("series", "fit_id"), "series")
    found = jt.fit_joint(points, specs, start)
    return jt.named(found, jt.positions(specs)).join(found.select("fit_id", "replica", "chi_sq", "dof", "state", "error"), ["fit_id", "replica"])


def _ranges(spark, d):
    r = base.table(spark, d, "region")
    return r.select(c("r_regionkey").alias("range_id"), (c("r_regionkey") % 2).alias("ti"), (4 + c("r_regionkey") % 3).alias("tf"), F.lit(2).alias("dti"), F.lit(2).alias("dtf"), (1 + F.floor(c("r_regionkey") / 3)).cast("int").alias("thin"), F.lit(0).alias("skip"))


@query()
def j13_scan_fits(spark, d):
    r = ft.expand_ranges(_ranges(spark, d), 4).withColumn("range_id", F.concat_ws("_", "range_id", "ti", "tf"))
    return ft.scan_fits(pts(spark, d), r.select("range_id", "fit_times"), "exp", 24, [0.5, 150.0])


@query("WITH r AS (SELECT r_regionkey AS range_id, r_regionkey % 2 AS ti, 4 + r_regionkey % 3 AS tf, CAST(1 + r_regionkey // 3 AS INTEGER) AS thin FROM region), e AS (SELECT range_id, a, b, range(a, b + 1, thin) AS ts FROM r, unnest(range(ti, ti + 2)) AS s(a), unnest(range(tf, tf + 2)) AS u(b)) SELECT DISTINCT range_id, array_to_string(ts, ',') AS fit_times, len(ts)::INTEGER AS n FROM e WHERE len(ts) >= 3")
def h2_expand_ranges(spark, d):
    e = ft.expand_ranges(_ranges(spark, d), 3)
    return e.select("range_id", F.array_join("fit_times", ",").alias("fit_times"), F.size("fit_times").alias("n"))


@query("WITH p AS (SELECT r_regionkey AS range_id, r_regionkey % 2 AS ti, 4 + r_regionkey % 3 AS tf FROM region) SELECT c.range_id, CAST(p.ti + 1 AS INTEGER) AS ti, CAST(p.tf - 1 AS INTEGER) AS tf FROM p c JOIN p ON p.range_id = c.range_id - 1")
def h2_relative_ranges(spark, d):
    r = _ranges(spark, d)
    child = r.where("range_id > 0").select("range_id", F.lit(-1).alias("offset"), F.lit(1).alias("ti"), F.lit(-1).alias("tf"))
    return ft.relative_ranges(child, r).select("range_id", "ti", "tf")


#: An order stands for a fit, its lines for the ranges of its series: every third is absolute, the others hang on the one before, so chains of
#: three; a start or an end of some is open.
LINES = "one AS (SELECT l_orderkey AS fit_id, l_linenumber AS n, CAST(max(l_quantity) AS INTEGER) AS q FROM lineitem GROUP BY ALL), rg AS (SELECT fit_id, CAST(row_number() OVER (PARTITION BY fit_id ORDER BY n) - 1 AS INTEGER) AS k, q FROM one), ranges AS (SELECT fit_id, k, CASE WHEN k % 3 > 0 THEN -1 END AS off, CASE WHEN k % 3 = 0 THEN q % 5 ELSE q % 3 - 1 END AS ti, CASE WHEN k % 3 = 0 THEN q % 5 + 3 + q % 4 ELSE 1 - q % 2 END AS tf, 1 + q % 2 AS dti, 1 + CAST(q % 7 = 0 AS INTEGER) AS dtf FROM rg)"


def order_ranges(spark, d):
    from pyspark.sql import Window as W

    # dealt out by fit once: what follows groups by fit or by more
    lines = base.table(spark, d, "lineitem").select(c("l_orderkey").alias("fit_id"), c("l_linenumber").alias("n"), "l_quantity").repartition("fit_id")
    one = lines.groupBy("fit_id", "n").agg(F.max("l_quantity").cast("int").alias("q"))
    r = one.select("fit_id", (F.row_number().over(W.partitionBy("fit_id").orderBy("n")) - 1).alias("range_id"), "q")
    root, q = c("range_id") % 3 == 0, c("q")
    return r.select("fit_id", "range_id", F.when(~root, -1).alias("offset"), F.when(root, q % 5).otherwise(q % 3 - 1).alias("ti"), F.when(root, q % 5 + 3 + q % 4).otherwise(1 - q % 2).alias("tf"), (1 + q % 2).alias("dti"), (1 + (q % 7 == 0).cast("int")).alias("dtf"), F.when(q % 4 == 0, F.array(F.lit(2), F.lit(2), F.lit(0), F.lit(1), F.lit(1))).alias("thin"), F.lit(2).alias("min_points"))


@query(f"""WITH RECURSIVE {LINES}, c AS (
  SELECT fit_id, -1 AS k, []::STRUCT(a BIGINT, b BIGINT)[] AS picked FROM ranges GROUP BY fit_id
  UNION ALL
  SELECT fit_id, k, picked FROM (
    SELECT r.fit_id, r.k, list_append(c.picked, {{'a': x.a, 'b': y.b}}) AS picked, y.b - x.a + 1 AS n FROM c JOIN ranges r ON r.fit_id = c.fit_id AND r.k = c.k + 1,
      unnest(range(r.ti + CASE WHEN r.off IS NULL THEN 0 ELSE c.picked[r.k].a END, r.ti + CASE WHEN r.off IS NULL THEN 0 ELSE c.picked[r.k].a END + r.dti)) AS x(a),
      unnest(range(r.tf + CASE WHEN r.off IS NULL THEN 0 ELSE c.picked[r.k].b END, r.tf + CASE WHEN r.off IS NULL THEN 0 ELSE c.picked[r.k].b END + r.dtf)) AS y(b))
  WHERE n >= 2
), l AS (SELECT fit_id, max(k) AS k FROM ranges GROUP BY fit_id)
SELECT fit_id, array_to_string(list_transform(picked, lambda p: p.a || '-' || p.b), ',') AS choice, len(picked)::INTEGER AS n FROM c JOIN l USING (fit_id, k)""")
def h2_joint_ranges(spark, d):
    """All joint choices of the ranges of an order's series, relative ones by chains."""
    found = rg.range_combinations(order_ranges(spark, d).withColumn("thin", F.lit(None).cast("array<int>")))
    text = F.transform("ranges", lambda r: F.concat_ws("-", r["ti"], r["tf"]))
    return found.select("fit_id", F.array_join(text, ",").alias("choice"), F.size("ranges").alias("n"))


@query()
def h2_thinned_ranges(spark, d):
    """As h2_joint_ranges, with runs of every second time and skips in some ranges; the lists themselves."""
    found = rg.range_combinations(order_ranges(spark, d))
    return found.select("fit_id", F.to_json(F.transform("ranges", lambda r: r["fit_times"])).alias("lists"))


@query(f"WITH {SIG}, w AS (SELECT a.corr_id, a.t AS ti, b.t AS tf FROM (SELECT DISTINCT corr_id, t FROM pts) a JOIN (SELECT DISTINCT corr_id, t FROM pts) b ON a.corr_id = b.corr_id AND b.t >= a.t + 2), n AS (SELECT p.corr_id, replica, ti, tf, sum(1 / sigma ** 2) AS s, sum(t / sigma ** 2) AS sx, sum(t * t / sigma ** 2) AS sxx, sum(x / sigma ** 2) AS sy, sum(t * x / sigma ** 2) AS sxy, count(*) AS n FROM pts p JOIN w ON w.corr_id = p.corr_id AND t BETWEEN ti AND tf GROUP BY ALL) SELECT corr_id, replica, ti, tf, round(sy / s, 3) AS mean, round((sxx * sy - sx * sxy) / (s * sxx - sx * sx), 2) AS intercept, round((s * sxy - sx * sy) / (s * sxx - sx * sx), 3) AS slope, n - 2 AS dof FROM n")
def j13_scan_lines(spark, d):
    p = pts(spark, d)
    s = rg.scan_lines(p, rg.windows(p, 3))
    return s.select("corr_id", "replica", "ti", "tf", F.round("mean", 3).alias("mean"), F.round("intercept", 2).alias("intercept"), F.round("slope", 3).alias("slope"), "dof")


@query("SELECT l_orderkey AS k, count(DISTINCT l_linenumber)::INTEGER AS n FROM lineitem GROUP BY l_orderkey")
def h3_points_of_lists(spark, d):
    li = base.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    g = li.groupBy(c("l_orderkey").alias("k")).agg(F.collect_list("l_linenumber").alias("t"))
    half = F.floor(F.size("t") / 2).cast("int")
    return g.select("k", sl.n_points(F.array(F.slice("t", 1, half), F.slice("t", half + 1, 100))).alias("n"))


@query(f"WITH {FX} SELECT corr_id, replica, t, CAST(row_number() OVER (PARTITION BY corr_id, replica ORDER BY t) - 1 AS INTEGER) AS position, round(x, 4) AS x FROM x WHERE t IN (1, 2, 5)")
def h1_select_times(spark, d):
    x = fx(spark, d)
    times = x.select("corr_id").distinct().withColumn("t", F.explode(F.array(F.lit(1), F.lit(2), F.lit(5))))
    return rounded(sl.select_times(x, times), "x")


# Customers stand for fits: one a customer, its base the segment.
FITS = "f AS (SELECT c_custkey AS fit_id, c_mktsegment AS base, CAST(c_custkey % 9 - 1 AS INTEGER) AS dof, CAST(c_custkey % 4 AS INTEGER) AS ti, CAST(6 + c_custkey % 5 AS INTEGER) AS tf, abs(c_acctbal) / 1000 AS chi_sq, round(c_acctbal / 10000, 2) AS pvalue_h, CAST(7 + c_custkey % 5 - c_custkey % 4 AS INTEGER) AS points FROM customer)"


def fit_rows(spark, d):
    # pvalue_h: rounded as SQL's round(x, 2) does, by the double 100 x; Spark's rounds the shortest decimal, and 1,450 / 10,000 went up to 0.15
    x = base.table(spark, d, "customer")
    f = x.select(c("c_custkey").alias("fit_id"), c("c_mktsegment").alias("base"), (c("c_custkey") % 9 - 1).cast("int").alias("dof"), (c("c_custkey") % 4).cast("int").alias("ti"), (6 + c("c_custkey") % 5).cast("int").alias("tf"), (F.abs("c_acctbal") / 1000).alias("chi_sq"), (F.round(c("c_acctbal") / 10000 * 100) / 100).alias("pvalue_h"))
    return f.withColumns({"points": c("tf") - c("ti") + 1, "fit_times": F.sequence("ti", "tf"), "load_order": c("fit_id")})


@query(f"WITH {FITS} SELECT fit_id, base, CAST(dense_rank() OVER (PARTITION BY base ORDER BY pvalue_h DESC, ti, tf) AS INTEGER) AS place FROM f")
def f4_rank_fits(spark, d):
    from pyspark.sql import Window as W

    r = sl.rank_fits(fit_rows(spark, d))
    first = F.min("seq").over(W.partitionBy("base", "pvalue_h", "fit_times"))
    return r.withColumn("__f", first).select("fit_id", "base", F.dense_rank().over(W.partitionBy("base").orderBy("__f")).alias("place"))


@query(f"WITH {FITS}, r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY points DESC, pvalue_h DESC, ti, tf) AS n FROM f) SELECT base, points, pvalue_h, ti, tf FROM r WHERE n = 1")
def f5_pick_fit(spark, d):
    return sl.pick_fit(fit_rows(spark, d)).select("base", "points", "pvalue_h", "ti", "tf")


@query(f"WITH {FITS}, g AS (SELECT *, row_number() OVER (PARTITION BY base, ti ORDER BY tf, fit_id) AS place FROM f WHERE ti BETWEEN 1 AND 3 AND tf BETWEEN 7 AND 9 AND chi_sq <= 5) SELECT fit_id, base, ti, tf, CAST(place AS INTEGER) AS place FROM g WHERE place <= 5")
def f11_fit_window(spark, d):
    f = fit_rows(spark, d).withColumn("chi_sq_dof", c("chi_sq"))
    return sl.fit_window(f, (1, 3), (7, 9), 5.0, 5).select("fit_id", "base", "ti", "tf", "place")


@query(f"WITH {FITS} SELECT fit_id, base FROM f WHERE dof >= 2 AND pvalue_h >= 0.05 AND chi_sq / dof <= 2.5")
def b36_accept_fits(spark, d):
    f = fit_rows(spark, d).withColumn("chi_sq_dof", F.when(c("dof") > 0, c("chi_sq") / c("dof")))
    return ft.accept_fits(f, 2, 0.05, 2.5).select("fit_id", "base")


@query()
def j14_fit_stats(spark, d):
    return ft.fit_stats(fit_rows(spark, d).drop("pvalue_h").where("dof >= 0"), 100).select("fit_id", "chi_sq_dof", "pvalue", "pvalue_h")


@query(f"WITH {FITS}, g AS (SELECT base, ti, tf, arg_min(pvalue_h, fit_id) AS p, min(fit_id) AS fit_id FROM f WHERE dof >= 0 GROUP BY base, ti, tf), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p DESC, ti, tf) AS seq FROM g) SELECT fit_id, base, CAST(seq AS INTEGER) AS seq, CAST((seq - 1) // 6 AS INTEGER) AS page FROM r")
def j15_summarise_fits(spark, d):
    return ft.summarise_fits(fit_rows(spark, d), 6).select("fit_id", "base", "seq", "page")


# Levels: orders stand for parameters, the level being the place in a customer's first orders.
LEVELS = "lv AS (SELECT o_custkey AS fit_id, 'E' AS name, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS idx, o_totalprice / 100000 - 1 AS value FROM orders)"


# A customer's orders stand for the parameters of its fit: object the priority, name the status, size by the clerk's orders.
PARAMS = "pr AS (SELECT c_mktsegment AS base, c_custkey AS fit_id, o_orderpriority AS object, o_orderstatus AS name, CAST(1 + o_orderkey % 3 AS INTEGER) AS size FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000)"


def fit_params(spark, d):
    o = base.table(spark, d, "orders").join(base.table(spark, d, "customer").where("c_acctbal > 9000"), c("o_custkey") == c("c_custkey"))
    return o.select(c("c_mktsegment").alias("base"), c("c_custkey").alias("fit_id"), c("o_orderpriority").alias("object"), c("o_orderstatus").alias("name"), (1 + c("o_orderkey") % 3).cast("int").alias("size"))


@query(f"WITH {PARAMS}, n AS (SELECT base, count(DISTINCT fit_id) AS fits FROM pr GROUP BY base) SELECT base, object, name, min(size) AS size FROM pr JOIN n USING (base) GROUP BY base, object, name, fits HAVING count(DISTINCT fit_id) = fits UNION ALL SELECT base, 'any', name, min(size) FROM pr JOIN n USING (base) GROUP BY base, name, fits HAVING count(DISTINCT fit_id) = fits")
def j15_common_params(spark, d):
    """Parameters that all fits of a base have, by object and name, and by name alone."""
    p = fit_params(spark, d)
    return sl.common_fit_params(p).unionByName(sl.common_fit_params(p.withColumn("object", F.lit("any"))))


@query(f"WITH {PARAMS} SELECT base, object, name, max(size) AS size FROM pr GROUP BY ALL")
def j15_all_params(spark, d):
    return sl.merged_fit_params(fit_params(spark, d))


@query(f"""WITH {FITS}, {LEVELS}, s AS (SELECT fit_id, idx, value AS v FROM lv), bad AS (SELECT DISTINCT a.fit_id FROM s a WHERE NOT (a.v - 0.1 > 0 OR a.v + 0.1 < 0) OR a.v > 3 OR EXISTS (SELECT 1 FROM s b WHERE b.fit_id = a.fit_id AND b.idx < a.idx AND NOT (a.v - 0.1 > b.v + 0.1 OR a.v + 0.1 < b.v - 0.1))),
g AS (SELECT base, ti, tf, arg_min(pvalue_h, fit_id) AS p, min(fit_id) AS fit_id FROM f WHERE dof >= 0 AND fit_id NOT IN (SELECT fit_id FROM bad) GROUP BY base, ti, tf), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p DESC, ti, tf) AS seq FROM g) SELECT fit_id, base, CAST(seq AS INTEGER) AS seq, CAST((seq - 1) // 6 AS INTEGER) AS page FROM r""")
def j15_significant_fits(spark, d):
    """As j15_summarise_fits, without fits that have a parameter which is not significant."""
    v = levels(spark, d).select("fit_id", "name", "idx", F.lit(True).alias("monotonic"), *[(c("value") + x).alias(n) for n, x in (("min", -0.3), ("low", -0.1), ("central", 0.0), ("high", 0.1), ("max", 0.3))])
    return ft.summarise_fits(fit_rows(spark, d), 6, v, e_max=3.0).select("fit_id", "base", "seq", "page")


@query(f"WITH {FITS}, r AS (SELECT fit_id, row_number() OVER (PARTITION BY base ORDER BY fit_id) AS seq FROM f) SELECT fit_id, CAST((seq - 1) // 40 AS INTEGER) AS page FROM r")
def e5_pages(spark, d):
    from pyspark.sql import Window as W

    f = fit_rows(spark, d).withColumn("seq", F.row_number().over(W.partitionBy("base").orderBy("fit_id")))
    return sl.with_page(f, 40).select("fit_id", "page")


@query(f"WITH {FITS} SELECT fit_id, base, CAST(row_number() OVER (PARTITION BY base ORDER BY chi_sq, fit_id) AS INTEGER) AS seq FROM f")
def e4_sequence_numbers(spark, d):
    f = fit_rows(spark, d).withColumn("fit_times", F.array("fit_id"))
    return sl.rank_fits(f, "chi_sq", ascending=True).select("fit_id", "base", "seq")


def levels(spark, d):
    from pyspark.sql import Window as W

    o = base.table(spark, d, "orders")
    idx = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return o.select(c("o_custkey").alias("fit_id"), F.lit("E").alias("name"), idx.alias("idx"), (c("o_totalprice") / 100000 - 1).alias("value"))


@query(f"WITH {LEVELS}, r AS (SELECT fit_id, value / lag(value) OVER (PARTITION BY fit_id ORDER BY idx) AS r FROM lv) SELECT fit_id, 'E' AS name, bool_and(coalesce(r >= 0.9, true)) AS ok FROM r GROUP BY fit_id")
def b36_level_separation(spark, d):
    return ft.level_separation(levels(spark, d), 0.9)


@query(f"WITH {LEVELS} SELECT fit_id, idx, round(sum(CASE WHEN idx = 0 THEN value ELSE value * value END) OVER (PARTITION BY fit_id ORDER BY idx), 9) AS value FROM lv")
def b37_from_monotonic(spark, d):
    return rounded(ft.from_monotonic(levels(spark, d), ("fit_id", "name")).drop("name"), "value", digits=9)


@query(f"WITH {LEVELS} SELECT fit_id, idx, round(CASE WHEN idx = 0 THEN value ELSE abs(value) END, 9) AS value FROM lv")
def b37_to_monotonic(spark, d):
    by = ("fit_id", "name")
    return rounded(ft.to_monotonic(ft.from_monotonic(levels(spark, d), by), by).drop("name"), "value", digits=9)


@query(f"WITH {LEVELS} SELECT fit_id, idx, round(sum(CASE WHEN idx = 0 THEN value ELSE value * value END) OVER (PARTITION BY fit_id ORDER BY idx), 9) AS total FROM lv")
def e6_cumulate_squares(spark, d):
    return ft.from_monotonic(levels(spark, d), ("fit_id", "name")).select("fit_id", "idx", F.round("value", 9).alias("total"))


@query(f"WITH {LEVELS} SELECT fit_id, idx, round(CASE WHEN first_value(value) OVER (PARTITION BY fit_id ORDER BY idx) < 0 THEN -value ELSE value END, 9) AS value FROM lv")
def b38_adjust_signs(spark, d):
    return rounded(ft.adjust_signs(levels(spark, d), ("fit_id",)).drop("name"), "value", digits=9)


@query(f"""WITH {LEVELS}, s AS (SELECT fit_id, idx, value AS v, value - 0.1 AS low, value + 0.1 AS high, value - 0.3 AS mn, value + 0.3 AS mx FROM lv)
SELECT a.fit_id, a.idx, ((a.low > 0 OR a.high < 0) AND NOT (a.v > 3) AND NOT EXISTS (SELECT 1 FROM s b WHERE b.fit_id = a.fit_id AND b.idx < a.idx AND NOT (a.mn > b.mx OR a.mx < b.mn))) AS ok FROM s a""")
def b35_check_params(spark, d):
    v = levels(spark, d).select("fit_id", "name", "idx", F.lit(True).alias("monotonic"), *[(c("value") + x).alias(n) for n, x in (("min", -0.3), ("low", -0.1), ("central", 0.0), ("high", 0.1), ("max", 0.3))])
    return ft.check_params(v, strict=2, e_max=3.0).select("fit_id", "idx", "ok")


@query(f"WITH {FX}, c AS (SELECT corr_id, t, x FROM x WHERE replica = -1) SELECT corr_id, t, t - 0.5 AS t_mid, t BETWEEN 1 AND 4 AS fitted, round(x, 4) AS x, round(CASE WHEN t BETWEEN 1 AND 4 THEN x * 1.01 END, 4) AS y, round(ln(lag(x) OVER (PARTITION BY corr_id ORDER BY t) / x), 8) AS log_data FROM c")
def a9_fit_report(spark, d):
    x = fx(spark, d).where("replica = -1").drop("replica")
    y = x.where("t BETWEEN 1 AND 4").select("corr_id", "t", (c("x") * 1.01).alias("y"))
    return rounded(rounded(ft.fit_report(x, y), "x", "y"), "log_data", digits=8).drop("log_theory", "t_mid_theory")


@query(f"WITH {FX}, c AS (SELECT corr_id, t, x FROM x WHERE replica = -1 AND t <> 3), f AS (SELECT corr_id, t, ln(lag(x * 1.01) OVER w / (x * 1.01)) / (t - lag(t) OVER w) AS log_theory, (t + lag(t) OVER w) / 2.0 AS t_mid_theory FROM c WHERE t IN (1, 2, 5) WINDOW w AS (PARTITION BY corr_id ORDER BY t)), l AS (SELECT corr_id, t, ln(lag(x) OVER w / x) / (t - lag(t) OVER w) AS log_data, (t + coalesce(lag(t) OVER w, t - 1)) / 2.0 AS t_mid FROM c WINDOW w AS (PARTITION BY corr_id ORDER BY t)) SELECT corr_id, t, round(t_mid, 3) AS t_mid, round(log_data, 8) AS log_data, round(t_mid_theory, 3) AS t_mid_theory, round(log_theory, 8) AS log_theory FROM l LEFT JOIN f USING (corr_id, t)")
def a9_fit_report_gaps(spark, d):
    """A series without one time, fitted at some: ratios over the time between points, at its middle."""
    x = fx(spark, d).where("replica = -1 and t <> 3").drop("replica")
    y = x.where("t in (1, 2, 5)").select("corr_id", "t", (c("x") * 1.01).alias("y"))
    r = ft.fit_report(x, y).select("corr_id", "t", "t_mid", "log_data", "t_mid_theory", "log_theory")
    return rounded(rounded(r, "log_data", "log_theory", digits=8), "t_mid", "t_mid_theory", digits=3)


@query("WITH s AS (SELECT n_regionkey AS ensemble, n_name AS x_key, avg(s_acctbal) AS m FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL) SELECT ensemble, x_key, round(m - 1, 6) AS data_low, round(m, 6) AS data_central, round(m + 1, 6) AS data_high, round(m - 0.5, 6) AS theory_low, round(m * 1.1, 6) AS theory_central, round(m + 0.5, 6) AS theory_high, length(x_key) AS x FROM s")
def a10_global_report(spark, d):
    s = base.table(spark, d, "supplier").join(base.table(spark, d, "nation"), c("s_nationkey") == c("n_nationkey")).groupBy(c("n_regionkey").alias("ensemble"), c("n_name").alias("x_key")).agg(F.avg("s_acctbal").alias("m"))
    ve = lambda w, k: s.select("ensemble", "x_key", (c("m") - w).alias("low"), (c("m") * k).alias("central"), (c("m") + w).alias("high"))
    r = ft.global_report(ve(1, 1.0), ve(0.5, 1.1), s.select("ensemble", "x_key", F.length("x_key").cast("long").alias("x")))
    return rounded(r, *[x for x in r.columns if "_l" in x or "_c" in x or "_h" in x], digits=6)


# Global fits: suppliers are points, regions ensembles, nations form the x axis.
GLOBAL = "g AS (SELECT s_suppkey AS k, r_name AS ensemble, n_nationkey AS n2, s_acctbal, CASE s_suppkey % 2 WHEN 0 THEN 'f_par' ELSE 'f_perp' END AS form_factor, 1.5 + r_regionkey * 0.25 AS a_inv, 0.2 + n_nationkey * 0.02 AS el FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def points(spark, d):
    s = base.table(spark, d, "supplier").join(base.table(spark, d, "nation"), c("s_nationkey") == c("n_nationkey")).join(base.table(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    return s.select(c("s_suppkey").alias("k"), c("r_name").alias("ensemble"), c("n_nationkey").alias("n2"), "s_acctbal", F.when(c("s_suppkey") % 2 == 0, "f_par").otherwise("f_perp").alias("form_factor"), (1.5 + c("r_regionkey") * 0.25).alias("a_inv"), (0.2 + c("n_nationkey") * 0.02).alias("el"))


@query(f"WITH {GLOBAL} SELECT k, ensemble, n2 FROM g WHERE NOT (ensemble = 'ASIA' AND n2 > 10) AND NOT (ensemble = 'EUROPE' AND n2 > 5)")
def f7_cap_momentum(spark, d):
    caps = spark.createDataFrame([("ASIA", 10), ("EUROPE", 5)], "ensemble string, n2_max int")
    return sl.cap_momentum(points(spark, d), caps).select("k", "ensemble", "n2")


@query(f"WITH {GLOBAL} SELECT k, ensemble, form_factor, n2 FROM g")
def f8_global_order(spark, d):
    return sl.global_order(points(spark, d)).select("k", "ensemble", "form_factor", "n2")


@query(f"WITH {GLOBAL} SELECT k, ensemble, CAST(dense_rank() OVER (ORDER BY ensemble) - 1 AS INTEGER) AS idx FROM g")
def f9_number_ops(spark, d):
    return sl.number_ops(points(spark, d), "ensemble").select("k", "ensemble", "idx")


@query(f"WITH {GLOBAL} SELECT k, ensemble FROM g WHERE ensemble NOT IN ('ASIA', 'AFRICA')")
def f10_leave_out(spark, d):
    return sl.leave_out(points(spark, d), ["ASIA", "AFRICA"]).select("k", "ensemble")


@query("WITH t AS (SELECT DISTINCT o_custkey AS fit_id, CAST(o_orderkey % 40 AS INTEGER) AS t FROM orders), l AS (SELECT *, t - lag(t) OVER w AS d FROM t WINDOW w AS (PARTITION BY fit_id ORDER BY t)), m AS (SELECT *, CASE WHEN lag(d) OVER w IS NULL OR d = lag(d) OVER w THEN 0 ELSE 1 END AS nw FROM l WINDOW w AS (PARTITION BY fit_id ORDER BY t)), r AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY fit_id ORDER BY t) AS BIGINT) AS run FROM m) SELECT fit_id, run, min(t) AS first, max(t) AS last, count(*) AS n FROM r GROUP BY ALL")
def e8_time_runs(spark, d):
    o = base.table(spark, d, "orders").select(c("o_custkey").alias("fit_id"), (c("o_orderkey") % 40).cast("int").alias("t")).distinct()
    return sl.time_runs(o)


KEYS = "a AS (SELECT p_brand AS object, p_type AS name, max(p_size) AS size FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), b AS (SELECT p_brand AS object, p_type AS name, max(p_size) AS size FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL)"


def _keys(spark, d):
    p = base.table(spark, d, "part")
    side = lambda k: p.where(c("p_partkey") % k == 0).groupBy(c("p_brand").alias("object"), c("p_type").alias("name")).agg(F.max("p_size").alias("size"))
    return side(2), side(3)


@query(f"WITH {KEYS} SELECT object, name, least(a.size, b.size) AS size FROM a JOIN b USING (object, name)")
def g1_common_params(spark, d):
    return sl.common_params(*_keys(spark, d))


@query(f"WITH {KEYS} SELECT object, name, max(size) AS size FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL")
def g1_merge_params(spark, d):
    return sl.merge_params(*_keys(spark, d))


@query("WITH x AS (SELECT n_nationkey AS k, ['chi', 'p', 'q' || n_regionkey] AS a, ['p', 'q' || (n_nationkey % 3)] AS b FROM nation) SELECT k, array_to_string(list_filter(a, lambda v: list_contains(b, v)), ',') AS common, array_to_string(list_concat(a, list_filter(b, lambda v: NOT list_contains(a, v))), ',') AS merged FROM x")
def g2_stat_columns(spark, d):
    n = base.table(spark, d, "nation")
    a, b = F.array(F.lit("chi"), F.lit("p"), F.concat(F.lit("q"), "n_regionkey")), F.array(F.lit("p"), F.concat(F.lit("q"), c("n_nationkey") % 3))
    return n.select(c("n_nationkey").alias("k"), F.array_join(sl.common_stats(a, b), ",").alias("common"), F.array_join(sl.merge_stats(a, b), ",").alias("merged"))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'a,' || n_regionkey || ',b,' || n_nationkey ELSE 'a,b,' || n_regionkey END AS z FROM nation")
def g3_zipper(spark, d):
    n = base.table(spark, d, "nation")
    a = F.array(F.lit("a"), F.lit("b"))
    r, k = c("n_regionkey").cast("string"), c("n_nationkey").cast("string")
    b = F.when(c("n_nationkey") % 2 == 0, F.array(r, k)).otherwise(F.array(r))
    return n.select(c("n_nationkey").alias("k"), F.array_join(sl.zipper(a, b), ",").alias("z"))


@query("SELECT DISTINCT l_orderkey || '_' || l_linenumber AS file FROM lineitem")
def g4_dedupe_files(spark, d):
    return sl.dedupe_files(base.table(spark, d, "lineitem").select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("file")))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def g5_duplicates(spark, d):
    return sl.duplicates(base.table(spark, d, "lineitem"), ("l_orderkey", "l_linenumber"))


@query("SELECT o_orderkey FROM orders")
def g5_assert_unique(spark, d):
    return sl.assert_unique(base.table(spark, d, "orders"), ("o_orderkey",))


@query("SELECT 'S' AS ensemble, s_suppkey AS k, s_acctbal AS bal, NULL AS seg FROM supplier UNION ALL SELECT 'C', c_custkey, c_acctbal, c_mktsegment FROM customer")
def g6_stack_ensembles(spark, d):
    s = base.table(spark, d, "supplier").select(c("s_suppkey").alias("k"), c("s_acctbal").alias("bal"))
    return sl.stack_ensembles({"S": s, "C": base.table(spark, d, "customer").select(c("c_custkey").alias("k"), c("c_acctbal").alias("bal"), c("c_mktsegment").alias("seg"))})


@query(f"WITH {GLOBAL}, m AS (SELECT ensemble, s.s_suppkey % 1 AS seed, n2 % 2 AS bin_size FROM g JOIN supplier s ON s.s_suppkey = g.k) SELECT ensemble, count(*) AS models, count(DISTINCT seed) = 1 AS one_seed, CASE WHEN min(bin_size) = max(bin_size) THEN max(bin_size) ELSE 0 END AS bin_size FROM m GROUP BY ensemble")
def d26_ensemble_stats(spark, d):
    return sl.ensemble_stats(points(spark, d).select("ensemble", (c("k") % 1).alias("seed"), (c("n2") % 2).alias("bin_size")))


@query(f"WITH {GLOBAL} SELECT round(min(el), 8) AS x_min, 3.0::DOUBLE AS x_max FROM g WHERE n2 > 3")
def d27_x_domain(spark, d):
    return rounded(sl.x_domain(points(spark, d).select(c("el").alias("x"), (c("n2") > 3).alias("used")), high=3.0), "x_min", digits=8)


@query(f"WITH {GLOBAL} SELECT k, round(el * a_inv * a_inv, 8) AS x, round((s_acctbal - 1) * sqrt(a_inv), 6) AS low, round(s_acctbal * sqrt(a_inv), 6) AS central, round((s_acctbal + 1) * sqrt(a_inv), 6) AS high FROM g")
def b41_to_physical(spark, d):
    p = points(spark, d)
    s = p.select("k", "ensemble", c("el").alias("x"), *[(c("s_acctbal") + v).alias(n) for n, v in (("low", -1), ("central", 0), ("high", 1))])
    out = sl.to_physical(s, p.select("ensemble", "a_inv").distinct())
    return rounded(rounded(out.drop("ensemble"), "x", digits=8), "low", "central", "high", digits=6)


@query("WITH x AS (SELECT p_type AS x, p_size, p_retailprice, 1.0 + p_size / 10.0 AS a_inv FROM part), f AS (SELECT x, arg_max(p_retailprice, a_inv * 1000000 + p_retailprice) AS y, max(a_inv) AS a FROM x GROUP BY x) SELECT x, round(abs(0.3 * pow(1 / (2 * a), 6) / y), 12) AS error FROM f")
def d33_disc_error(spark, d):
    p = base.table(spark, d, "part").select(c("p_type").alias("x"), F.lit(0.3).alias("d_last"), (1.0 + c("p_size") / 10.0).alias("a_inv"), c("p_retailprice").alias("y"))
    one = p.groupBy("x", "a_inv", "d_last").agg(F.max("y").alias("y"))
    return rounded(ft.disc_error(one, 1.0, 2), "error", digits=12)


DISPL = "CASE WHEN nx = 0 AND ny = 0 THEN m ELSE 2 * asinh(sqrt(pow(sinh(m / 2), 2) + pow(sin(pi() * nx / 24), 2) + pow(sin(pi() * ny / 24), 2))) END"


@query(f"WITH m AS (SELECT s_suppkey AS fit_id, 0.3 + abs(s_acctbal) / 20000 AS m FROM supplier), q AS (SELECT unnest([0, 1, 1]) AS nx, unnest([0, 0, 1]) AS ny) SELECT fit_id, nx, ny, round({DISPL}, 8) AS energy FROM m, q")
def j16_derive_energies(spark, d):
    m = base.table(spark, d, "supplier").select(c("s_suppkey").alias("fit_id"), (0.3 + F.abs("s_acctbal") / 20000).alias("value"))
    q = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (1, 1, 0)], "nx int, ny int, nz int")
    return rounded(ft.derive_energies(m, 24, q).select("fit_id", "nx", "ny", "energy"), "energy", digits=8)


COLUMNS = ft.design_columns({"c1": False}, 1, 1)


def design(spark, d):
    p = points(spark, d).select(c("k"), "ensemble", F.lit(0).alias("replica"), c("k").alias("t"), "el", "a_inv", F.lit(0.1).alias("delta"), F.lit(0.02).alias("chi_fv"), F.lit(0.05).alias("d_mpi"), (2 + c("s_acctbal") / 10000).alias("x"), F.lit(0.1).alias("sigma"))
    return ft.with_design(p, 1.0, COLUMNS)


@query(f"WITH {GLOBAL} SELECT k, round(1.02 / (el + 0.1), 8) AS c0, round(el / (el + 0.1), 8) AS e1, round(1 / (a_inv * a_inv) / (el + 0.1), 8) AS d1 FROM g")
def j19_design_columns(spark, d):
    x = design(spark, d)
    return x.select("k", *[F.round(c("row")[k], 8).alias(n) for k, n in enumerate(COLUMNS)])


@query(f"WITH {GLOBAL} SELECT k, round(2 + s_acctbal / 10000 - 2 * (el / (el + 0.1)), 8) AS x, round(1.02 / (el + 0.1) - el / (el + 0.1) * 0.5, 8) AS c0, round(1 / (a_inv * a_inv) / (el + 0.1), 8) AS d1 FROM g")
def j17_constraint(spark, d):
    x = ft.apply_constraint(design(spark, d), [0.5, 1.0, 0.0], 2.0, 1)
    return x.select("k", F.round("x", 8).alias("x"), F.round(c("row")[0], 8).alias("c0"), F.round(c("row")[1], 8).alias("d1"))


@query(f"WITH {GLOBAL} SELECT k, round(m.x * 2 * m.x * ln(abs(m.x)) / (16 * pi() * pi() * 0.0169), 8) AS chi, round(m.x * m.x - 0.0196, 8) AS d_mpi, round(0.25, 8)::DOUBLE AS delta FROM g, (SELECT 0 AS z), LATERAL (SELECT 0.1 + el AS x) m")
def j18_derive_constants(spark, d):
    p = points(spark, d).select("k", "ensemble", F.lit(0).alias("replica"), (0.1 + c("el")).alias("m_pi"))
    const = points(spark, d).select("ensemble").distinct().select("ensemble", F.lit(2.25).alias("m_pole"), F.lit(2.0).alias("m_state"), F.lit(24).alias("l"))
    return rounded(ft.derive_constants(p, const, 1.0, 0.14).select("k", "chi", "d_mpi", "delta"), "chi", "d_mpi", "delta", digits=8)


@query(f"WITH {GLOBAL} SELECT k, form_factor, round(CASE form_factor WHEN 'f_par' THEN s_acctbal * sqrt(a_inv) ELSE s_acctbal / sqrt(a_inv) END, 6) AS x FROM g")
def j20_common_units(spark, d):
    p = points(spark, d).withColumn("x", c("s_acctbal"))
    both = [ft.to_common_units(p.where(c("form_factor") == n), n) for n in ("f_par", "f_perp")]
    return rounded(both[0].unionByName(both[1]).select("k", "form_factor", "x"), "x", digits=6)


@query(f"WITH {FALLING}, p AS (SELECT corr_id, replica, max(CASE WHEN t = 0 THEN re END) AS a, max(CASE WHEN t = 1 THEN re END) AS b FROM falling GROUP BY ALL), xs AS (SELECT range * 2.0 / 20 AS x FROM range(21) UNION ALL SELECT 3.5) SELECT corr_id AS fit_id, replica, round(x, 8) AS x, round(a + b * x, 4) AS y FROM p, xs")
def j21_fit_band(spark, d):
    f = base.falling(spark, d)
    at = lambda k: F.max(F.when(c("t") == k, c("re")))
    p = f.groupBy(c("corr_id").alias("fit_id"), "replica").agg(F.array(at(0), at(1)).alias("params"))
    return rounded(rounded(ft.fit_band(p, 0.0, 2.0, 20, [3.5]), "y"), "x", digits=8)


@query(f"WITH {GLOBAL} SELECT k, round((2 + s_acctbal / 10000 - 0.5 * 0.02 / (el + 0.1) - 0.2 / (a_inv * a_inv) / (el + 0.1)) * (el + 0.1), 8) AS adjusted FROM g")
def j22_adjust_points(spark, d):
    x = design(spark, d).withColumn("fit_id", F.lit("f"))
    p = spark.createDataFrame([("f", 0, [0.5, 0.3, 0.2])], "fit_id string, replica int, params array<double>")
    return rounded(ft.adjust_points(x, p, COLUMNS, 1.0).select("k", "adjusted"), "adjusted", digits=8)


@query()
def j23_variations(spark, d):
    v = spark.createDataFrame([("all", []), ("no_asia", ["ASIA"]), ("no_africa", ["AFRICA"])], "variation string, drop array<string>")
    return ft.run_variations(design(spark, d), v)


@query(f"WITH {FALLING}, {FITS}, b AS (SELECT corr_id, max(CASE WHEN t = 0 THEN re END) AS a, max(CASE WHEN t = 1 THEN re END) AS b FROM falling WHERE replica = -1 GROUP BY ALL) SELECT corr_id AS fit_id, round(a, 4) AS y_low, round(a + 2 * b, 4) AS y_high, 3 AS dof FROM b")
def j24_comparison_table(spark, d):
    f = base.falling(spark, d)
    at = lambda k: F.max(F.when(c("t") == k, c("re")))
    p = f.groupBy(c("corr_id").alias("fit_id"), "replica").agg(F.array(at(0), at(1)).alias("params"))
    attr = p.select("fit_id").distinct().withColumn("dof", F.lit(3))
    return rounded(ft.comparison_table(attr, ft.fit_band(p, 0.0, 2.0, 20), 0.0, 2.0), "y_low", "y_high")


@query()
def j23_all_variations(spark, d):
    """The reference fit and sixteen variations of a global fit, 10000 replicas each, in one job."""
    cu = base.table(spark, d, "customer").join(base.table(spark, d, "nation"), c("c_nationkey") == c("n_nationkey")).join(base.table(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    p = cu.groupBy(c("r_name").alias("ensemble"), "n_nationkey", "n_regionkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("m"), F.count("*").alias("n"))
    p = p.select("ensemble", F.concat_ws("_", "n_nationkey", "c_mktsegment").alias("t"), (0.2 + c("n_nationkey") * 0.02).alias("el"), (1.5 + c("n_regionkey") * 0.25).alias("a_inv"), F.lit(0.1).alias("delta"), F.lit(0.02).alias("chi_fv"), F.lit(0.05).alias("d_mpi"), (2 + c("m") / 10000).alias("x"), (0.3 / F.sqrt(c("n").cast("double"))).alias("sigma"))
    values = ft.gaussian_chunks(p.select("t", "x", "sigma"), 10_000, base.SEED)
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    drops = [[], *[[n] for n in names], *[[a, b] for k, a in enumerate(names) for b in names[:k]], names[:3]]
    design = p.withColumn("v", F.explode(F.array(*[F.struct(F.lit(k).alias("variation"), F.array(*[F.lit(n) for n in x]).cast("array<string>").alias("drop")) for k, x in enumerate(drops)]))).select("*", "v.*").drop("v")
    design = ft.with_design(design.where(~F.array_contains("drop", c("ensemble"))), 1.0, COLUMNS)
    return ft.fit_linear_chunks(design.select("variation", "t", "sigma", "row"), values)


#: Regions stand for ensembles, nations in order for momenta, market segments for series of fits, odd and even customers for form factors.
ENSEMBLES = {"AFRICA": ("C1", 24, 1.78, 0.34), "AMERICA": ("C2", 24, 1.78, 0.43), "ASIA": ("M1", 32, 2.38, 0.30), "EUROPE": ("M2", 32, 2.38, 0.36), "MIDDLE EAST": ("M3", 32, 2.38, 0.41)}
CONSTANTS = {"m_pi_phys": (0.135, 1e-4), "f_pi": (0.13, 1e-4), "m_light": (0.495, 1e-4), "m_heavy": (1.968, 1e-4), "pole/f_zero": (2.318, 1e-3), "pole/f_plus": (2.007, 1e-3)}
ALL_BUT = {"C1": 3, "C2": 3, "M1": 3, "M2": 3, "M3": 3}
#: The reference fit and what each of sixteen variations does otherwise.
VARIATIONS = {
    "ref": {}, "a_no_volume": {"disable": ["V"]}, "b_both_poles": {"poles": {"f_zero": 0.313, "f_plus": -0.005}}, "c_vector_pole": {"poles": {"f_plus": -0.005}}, "d_scalar_pole": {"poles": {"f_zero": 0.313}},
    "e_alt_zv": {"series": {"": "AUTOMOBILE"}}, "f_alt_c1": {"series": {"C1": "FURNITURE"}}, "g_caps": {"caps": ALL_BUT}, "h_no_c1": {"drop": ["C1"]}, "i_no_c2": {"drop": ["C2"]}, "j_no_m1": {"drop": ["M1"]}, "k_no_m2": {"drop": ["M2"]},
    "l_no_m3": {"drop": ["M3"]}, "m_no_m": {"drop": ["M1", "M2", "M3"], "disable": ["d1"]}, "n_jan": {"series": {"": "MACHINERY"}}, "o_dispersion": {"series": {"": "HOUSEHOLD"}}, "p_second_term": {"n_d": 2, "disable": ["d1"]},
}


def global_inputs(spark, d, replicas=10_000):
    """points, values (chunks of replicas) and variations of a global fit made from customers' balances."""
    from pyspark.sql import Window as W

    cu = base.table(spark, d, "customer").join(base.table(spark, d, "nation"), c("c_nationkey") == c("n_nationkey")).join(base.table(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    ff = F.when(c("c_custkey") % 2 == 0, "f_zero").otherwise("f_plus")
    g = cu.groupBy("r_name", "n_nationkey", c("c_mktsegment").alias("series"), ff.alias("form_factor")).agg(F.avg("c_acctbal").alias("m"), F.count("*").alias("n"))
    spec = spark.createDataFrame([(r, *v) for r, v in ENSEMBLES.items()], "r_name string, ensemble string, sites int, a_inv double, m_pi double")
    g = g.join(spec, "r_name").withColumn("n2", F.dense_rank().over(W.partitionBy("r_name").orderBy("n_nationkey")) - 1)
    g = g.withColumn("t", F.row_number().over(W.orderBy("r_name", "n_nationkey", "series", "form_factor")))  # points are few: nations x segments x 2
    el = F.sqrt(0.245 + c("n2") * F.pow(2 * 3.141592653589793 * c("a_inv") / c("sites"), F.lit(2.0)))
    g = g.withColumn("el", el)
    curve = F.when(c("form_factor") == "f_zero", (0.9 - 0.12 * c("el")) / (c("el") + 0.4)).otherwise(0.82 / (c("el") + 0.03))
    g = g.withColumn("y", curve * (1 + 0.02 * (c("m") - 4500) / 4500 / F.sqrt(c("n").cast("double"))))
    table = lambda prefix, x, s: g.select(F.concat(F.lit(prefix), "t").alias("t"), x.alias("x"), s.alias("sigma"))
    own = [(f"a_inv/{e}", a, 0.004) for e, _, a, _ in ENSEMBLES.values()] + [(f"m_pi/{e}", m, 0.001) for e, _, _, m in ENSEMBLES.values()] + [(n, *v) for n, v in CONSTANTS.items()]
    rows = table("y/", c("y"), 0.01 * c("y")).unionByName(table("el/", c("el"), 0.001 * c("el"))).unionByName(spark.createDataFrame(own, "t string, x double, sigma double"))
    values = ft.gaussian_chunks(rows, replicas, base.SEED).withColumnRenamed("t", "name")
    return g.select("t", "ensemble", "form_factor", "n2", "series", "sites"), values, gf.variation_table(spark, VARIATIONS, 2, 1)


@query()
def j23_constrained_variations(spark, d):
    """The reference global fit and sixteen variations, correlated and constrained, 10000 replicas each, in one job."""
    points, values, variations = global_inputs(spark, d)
    return gf.fit_variations(points, staged(values), variations, 1.0, "BUILDING").drop("chunk")


@query()
def j21_global_band(spark, d):
    """Bands of all variations: 201 places from momentum transfer 0 to the largest, with and without the pole."""
    points, values, variations = global_inputs(spark, d, 2000)
    values = staged(values)
    fits = staged(gf.fit_variations(points, values, variations, 1.0, "BUILDING"))
    return gf.band(fits, values, variations, 1.0)
