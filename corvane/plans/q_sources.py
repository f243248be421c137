"""Queries: sources, sinks, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import covariance as cv
from corvane.operators import resample
from corvane.operators import select as sl
from corvane.sources import files as fl
from corvane.sources.scratch import scratch_path

from . import base
from .base import BINNED, REPLICA
from .q_covariance import BIN, CORR, bins
from .q_resample import STATS, VE, rounded
from .registry import query

c = F.col
RAW = "raw AS (SELECT l_orderkey % 100 AS file, l_returnflag AS snk, l_linestatus AS src, CAST(l_linenumber - 1 AS INTEGER) AS t, l_extendedprice AS re, l_quantity AS im FROM lineitem)"


def raw(spark, d):
    return base.table(spark, d, "lineitem").select((c("l_orderkey") % 100).alias("file"), c("l_returnflag").alias("snk"), c("l_linestatus").alias("src"), (c("l_linenumber") - 1).cast("int").alias("t"), c("l_extendedprice").alias("re"), c("l_quantity").alias("im"))


@query(f"WITH {RAW} SELECT file, snk, src, t, count(*) AS n, round(sum(re), 2) AS re FROM raw WHERE (snk = 'R' AND src = 'F') OR (snk = 'A' AND src = 'O') GROUP BY ALL")
def a1_scan_raw(spark, d):
    s = fl.scan_raw(raw(spark, d), [("R", "F"), ("A", "O")])
    return rounded(s.groupBy("file", "snk", "src", "t").agg(F.count("*").alias("n"), F.sum("re").alias("re")), "re", digits=2)


@query(f"WITH {RAW}, one AS (SELECT file, snk, src, t FROM raw WHERE file % 7 <> 0 OR snk <> 'A' GROUP BY ALL), two AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE file % 11 = 0 AND snk = 'R'), h AS (SELECT file, snk, src, count(*) AS n, count(DISTINCT t) AS u FROM two GROUP BY ALL), need AS (SELECT DISTINCT file, p.snk, p.src FROM raw, (VALUES ('A', 'O'), ('R', 'F')) AS p(snk, src)) SELECT file, snk, src, CASE WHEN n IS NULL THEN 'missing' WHEN n > u THEN 'twice' ELSE 'length' END AS fault FROM need LEFT JOIN h USING (file, snk, src) WHERE n IS NULL OR n > u OR u <> 7")
def a1_pair_faults(spark, d):
    one = raw(spark, d).where("file % 7 <> 0 OR snk <> 'A'").groupBy("file", "snk", "src", "t").agg(F.max("re").alias("re"), F.max("im").alias("im"))
    return fl.pair_faults(one.unionByName(one.where("file % 11 = 0 AND snk = 'R'")), [("A", "O"), ("R", "F")], 7)


@query("WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) SELECT CASE CAST(k // 8 AS INTEGER) WHEN 0 THEN 'fwd' WHEN 1 THEN 'rev' ELSE 'mid' END AS corr_id, CAST(k % 8 AS INTEGER) AS t, count(*) AS n, round(avg(x), 8) AS x FROM l WHERE k < 24 GROUP BY ALL")
def a3_import_packed(spark, d):
    layout = spark.createDataFrame([(0, "fwd"), (1, "rev"), (2, "mid")], "slot int, corr_id string")
    e = base.table(spark, d, "embeddings").select(c("vec_id").alias("sample"), c("embedding").alias("values"))
    return rounded(fl.import_packed(e, layout, 8).groupBy("corr_id", "t").agg(F.count("*").alias("n"), F.avg("x").alias("x")), "x", digits=8)


@query("WITH l AS (SELECT vec_id AS replica, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS t FROM embeddings), z AS (SELECT replica, t, CASE WHEN t = replica % 5 THEN 0 ELSE x END AS x FROM l) SELECT CAST(t AS INTEGER) AS t, round(avg(x), 8) AS x FROM z GROUP BY t")
def a4_import_matrix(spark, d):
    nan = F.transform("embedding", lambda v, k: F.when(k == c("vec_id") % 5, float("nan")).otherwise(v.cast("double")))
    e = base.table(spark, d, "embeddings").select(c("vec_id").alias("replica"), nan.alias("values"))
    return rounded(fl.import_matrix(e).where("replica = -1").drop("replica"), "x", digits=8)


@query(f"WITH {REPLICA} SELECT corr_id, replica, t, round(re, 4) AS re FROM replica")
def a6_write_samples(spark, d):
    path = scratch_path(spark, "samples")
    fl.write_samples(base.replicas(spark, d), path)
    fl.write_samples(base.replicas(spark, d).limit(0), path)  # is there already: stays
    return rounded(fl.load_samples(spark, path, "replica int, t int, re double, im double, corr_id string").drop("im"), "re")


@query(f"WITH {REPLICA} SELECT corr_id, replica, t, round(re, 4) AS re FROM replica WHERE replica < 20")
def a7_rehydrate(spark, d):
    b = base.binned(spark, d)
    index = resample.boot_index(spark, base.SEED, base.BINS, base.REPLICAS)
    few = resample.bootstrap_join(b, resample.boot_index(spark, base.SEED, base.BINS, 5))
    return rounded(resample.rehydrated(few, b, index, 20).select("corr_id", "replica", "t", "re"), "re")


SUMMARY = "t int, corr_min double, corr_low double, corr double, corr_high double, corr_max double, corr_check double, corr_id string"


@query(f"WITH {REPLICA}{STATS.format(src='replica')} SELECT corr_id, t, round(central, 4) AS corr, round(low, 4) AS corr_low, round(high, 4) AS corr_high FROM ve")
def a8_write_summary(spark, d):
    path = scratch_path(spark, "summary")
    fl.write_summary(resample.stats(base.replicas(spark, d)), path)
    return rounded(fl.read_summary(spark, path, SUMMARY).select("corr_id", "t", "corr", "corr_low", "corr_high"), "corr", "corr_low", "corr_high")


@query(f"WITH {REPLICA}{STATS.format(src='replica')} SELECT corr_id, round(central, 4) AS value, round(low, 4) AS low, round(high, 4) AS high FROM ve WHERE t = 0")
def a11_read_field(spark, d):
    path = scratch_path(spark, "summary")
    fl.write_summary(resample.stats(base.replicas(spark, d)), path)
    return rounded(fl.read_field(spark, path, "corr", SUMMARY), "value", "low", "high")


@query("SELECT 'cust_' || c_custkey AS key, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment || ' x' END AS value FROM customer WHERE c_custkey % 5 <> 0")
def a12_read_key_values(spark, d):
    path = scratch_path(spark, "list")
    k = c("c_custkey")
    line = F.concat(F.when(k % 5 == 0, "# ").otherwise(""), F.concat(F.lit("cust_"), k), F.when(k % 3 != 0, F.concat(F.lit("  "), "c_mktsegment", F.lit(" x"))).otherwise(""), F.lit("   # note"))
    base.table(spark, d, "customer").select(line).write.text(path)
    return fl.read_kv(spark, path)


@query("WITH p AS (SELECT p_type || (p_size % 3) AS name, p_partkey AS k, p_retailprice AS value FROM part), r AS (SELECT 'ECONOMY' AS request UNION ALL SELECT 'none') SELECT 'ECONOMY' AS request, name, k, value FROM p WHERE starts_with(name, 'ECONOMY') UNION ALL SELECT 'none', NULL, NULL, 0.0 UNION ALL SELECT 'tand', name, k, value FROM p WHERE contains(lower(name), 'tand')")
def a14_get_columns(spark, d):
    p = base.table(spark, d, "part").select(F.concat("p_type", c("p_size") % 3).alias("name"), c("p_partkey").alias("k"), c("p_retailprice").alias("value"))
    return sl.get_columns(p, ["ECONOMY", "none"], ["tand"]).select("request", "name", "k", "value")


@query("WITH k AS (SELECT c_mktsegment AS base, CAST(c_nationkey % 3 AS VARCHAR) AS type, c_nationkey AS seed FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY base, type ORDER BY seed <> 7, seed) AS n FROM k) SELECT base, type, seed FROM r WHERE n = 1")
def a15_prefer_seed(spark, d):
    k = base.table(spark, d, "customer").select(c("c_mktsegment").alias("base"), (c("c_nationkey") % 3).cast("string").alias("type"), c("c_nationkey").alias("seed")).distinct()
    return sl.prefer_seed(k, 7)


@query(f"WITH {BINNED} SELECT corr_id, t, round(re, 8) AS re, round(im, 8) AS im FROM binned")
def a16_payload(spark, d):
    return rounded(sl.select_payload(base.binned(spark, d)), "re", "im", digits=8)


@query(f"WITH {BIN}{CORR} SELECT i, " + ", ".join(f"round(max(CASE WHEN j = {k} THEN corr END), 8) AS c{k}" for k in range(7)) + " FROM corr WHERE corr_id = 'A' GROUP BY i")
def a18_write_matrix(spark, d):
    m = cv.correlation(bins(spark, d)).where("corr_id = 'A'")
    wide = cv.write_matrix(m, scratch_path(spark, "matrix"), labels=list(range(7)))
    return wide.select("i", *[F.round(str(k), 8).alias(f"c{k}") for k in range(7)])


LOG = """CASE event_id % 5 WHEN 0 THEN 'Computing quark propagator ''' || CASE WHEN event_id % 10 = 0 THEN 'SeqProp_a_b_' ELSE 'Prop_a_' END || CASE user_id % 3 WHEN 0 THEN 'l' WHEN 1 THEN 's' ELSE 'h385' END || '_x''' ELSE 'Inner CG iterations ' || CAST(floor(abs(value) * 50) AS INTEGER) || ' Outer ' || (event_id % 120) || ' Final ' || (event_id % 4000) END"""


def logs(spark, d):
    k = c("event_id")
    quark = F.when(c("user_id") % 3 == 0, "l").when(c("user_id") % 3 == 1, "s").otherwise("h385")
    name = F.concat(F.lit("Computing quark propagator '"), F.when(k % 10 == 0, "SeqProp_a_b_").otherwise("Prop_a_"), quark, F.lit("_x'"))
    inner = F.concat(F.lit("Inner CG iterations "), F.floor(F.abs("value") * 50).cast("int"), F.lit(" Outer "), k % 120, F.lit(" Final "), k % 4000)
    e = base.table(spark, d, "events")
    return e.select((c("user_id") % 20).alias("file"), k.alias("line_no"), F.when(k % 5 == 0, name).otherwise(inner).alias("value"))


@query(f"""WITH l AS (SELECT user_id % 20 AS file, event_id AS n, {LOG} AS v FROM events), q AS (SELECT *, last_value(CASE WHEN contains(v, 'propagator') THEN regexp_extract(v, '(?:SeqProp_a_b|Prop_a)_([a-z0-9]+)_x', 1) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY n) AS quark FROM l),
i AS (SELECT file, quark, regexp_extract(v, 'iterations (\\d+)', 1)::INT AS i, regexp_extract(v, 'Outer (\\d+)', 1)::INT AS o, regexp_extract(v, 'Final (\\d+)', 1)::INT AS f FROM q WHERE contains(v, 'Inner') AND quark IS NOT NULL)
SELECT file, quark, min(i) AS inner_min, max(i) AS inner_max, min(o) AS outer_min, max(o) AS outer_max, min(f) AS final_min, max(f) AS final_max, bool_or(i >= CASE quark WHEN 'l' THEN 15000 ELSE 5000 END OR f >= CASE quark WHEN 'l' THEN 15000 ELSE 5000 END OR o >= 100) AS exceeded FROM i GROUP BY ALL""")
def d22_log_iterations(spark, d):
    return fl.log_iterations(logs(spark, d))


@query(f"WITH l AS (SELECT user_id % 20 AS file, {LOG} AS v FROM events) SELECT file, bool_or(contains(v, 'Final 3999')) AS good FROM l GROUP BY file")
def d23_log_status(spark, d):
    return fl.log_status(logs(spark, d), "Final 3999")


@query("""WITH l AS (SELECT user_id % 20 AS file, event_id AS n, user_id, event_id, value FROM events), s AS (SELECT *, last_value(CASE WHEN event_id % 7 = 0 THEN 'stripe' || (user_id % 9) || '_size' || (event_id % 64) || 'M' END IGNORE NULLS) OVER (PARTITION BY file ORDER BY n) AS leaf FROM l)
SELECT file, '/lustre/' || leaf AS dir, regexp_extract(leaf, 'stripe(\\d+)', 1)::INT AS stripe, regexp_extract(leaf, 'size(\\d+)', 1)::INT AS size, 'M' AS suffix, CASE WHEN event_id % 2 = 0 THEN 'C-Lime' ELSE 'std-IO' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'Read' ELSE 'Write' END AS direction, (event_id % 1000 || '.5')::DOUBLE AS rate FROM s WHERE event_id % 7 <> 0 AND leaf IS NOT NULL""")
def d24_log_io(spark, d):
    k = c("event_id")
    here = F.concat(F.lit("-- Directory /lustre/stripe"), c("user_id") % 9, F.lit("_size"), k % 64, F.lit("M"))
    line = F.concat(F.when(k % 2 == 0, "IOobject: ").otherwise(""), F.when(k % 3 == 0, "Read").otherwise("Write"), F.lit(" 100 bytes in 5 us "), k % 1000, F.lit(".5 MB/s"))
    e = base.table(spark, d, "events").select((c("user_id") % 20).alias("file"), k.alias("line_no"), F.when(k % 7 == 0, here).otherwise(line).alias("value"))
    return fl.log_io(e)


@query("SELECT source AS file, sum(CASE WHEN regexp_matches(text, '(?i)license') THEN 1 ELSE 0 END)::BIGINT AS licence, sum(CASE WHEN regexp_matches(text, '\\d{3}') THEN 1 ELSE 0 END)::BIGINT AS numbers FROM documents GROUP BY source")
def d25_count_patterns(spark, d):
    lines = base.table(spark, d, "documents").select(c("source").alias("file"), c("text").alias("value"))
    return fl.count_patterns(lines, {"licence": "(?i)license", "numbers": r"\d{3}"})
