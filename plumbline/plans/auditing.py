"""Quality, contract and artifact-audit queries."""

from pyspark.sql import functions as F

from plumbline.functions.core import zfill
from plumbline.operators import quality as Q
from plumbline.plans.assembly import rnd
from plumbline.plans.registry import query
from plumbline.plans.standins import W


@query("q01_range_checks", "SELECT 'l_quantity' AS \"column\", count(*) FILTER (l_quantity < 2) AS n_below, count(*) FILTER (l_quantity > 49) AS n_above, min(l_quantity) AS min, max(l_quantity) AS max, 'FAIL' AS status FROM lineitem UNION ALL SELECT 'l_tax', 0, 0, min(l_tax), max(l_tax), 'PASS' FROM lineitem")
def _(t):
    return Q.range_checks(t.raw("lineitem"), {"l_quantity": (2.0, 49.0), "l_tax": (0.0, 1.0), "absent": (0.0, 1.0)})


@query("q02_consistency_rules", "SELECT 'flagged_has_discount' AS rule, count(*) FILTER (l_returnflag = 'R') AS n_condition, count(*) FILTER (l_returnflag = 'R' AND NOT l_discount > 0) AS n_violations, 'WARN' AS status FROM lineitem UNION ALL SELECT 'never', 0, 0, 'SKIP' UNION ALL SELECT 'price_positive', count(*), 0, 'PASS' FROM lineitem")
def _(t):
    return Q.consistency_checks(t.raw("lineitem"), [("flagged_has_discount", F.col("l_returnflag") == "R", F.col("l_discount") > 0, "WARN"), ("never", F.col("l_quantity") > 1000, F.lit(True), "ERROR"), ("price_positive", F.lit(True), F.col("l_extendedprice") > 0, "ERROR")])


GAPS = "SELECT zcta_id, k, county_fips, segment, CASE WHEN k % 3 = 0 THEN acct END AS a, CASE WHEN k % 4 > 0 THEN pop END AS b, acct AS c, 5.0 AS d FROM units"


def _gaps(t):
    k = F.col("k")
    return t.units.select("zcta_id", "k", "county_fips", "segment", F.when(k % 3 == 0, F.col("acct")).alias("a"), F.when(k % 4 > 0, F.col("pop")).alias("b"), F.col("acct").alias("c"), F.lit(5.0).alias("d"))


@query("q03_family_coherence", W("units", g=GAPS) + "SELECT 'wide' AS family, round(count(b) / count(*) - count(a) / count(*), 8) AS spread, CASE WHEN count(b) / count(*) - count(a) / count(*) > 0.4 THEN 'WARN' ELSE 'PASS' END AS status FROM g UNION ALL SELECT 'full', 0.0::DOUBLE, 'PASS'")
def _(t):
    return rnd(Q.family_coherence(_gaps(t), {"wide": ["a", "b"], "full": ["c", "d"]}), 8, "spread")


@query("q04_key_checks", "SELECT 'null:o_custkey' AS \"check\", 0::BIGINT AS n, 'PASS' AS status UNION ALL SELECT 'duplicates', count(*) - count(DISTINCT (o_custkey, o_orderdate)), CASE WHEN count(*) > count(DISTINCT (o_custkey, o_orderdate)) THEN 'FAIL' ELSE 'PASS' END FROM orders UNION ALL SELECT 'null:o_orderdate', 0, 'PASS'")
def _(t):
    return Q.key_checks(t.raw("orders"), ["o_custkey", "o_orderdate"])


@query("q05_constant_columns", W("units", g=GAPS) + "SELECT 'd' AS \"column\", 1::BIGINT AS n_distinct, count(*) AS n, 'CONSTANT' AS status FROM g UNION ALL SELECT 'c', count(DISTINCT c), count(c), 'PASS' FROM g UNION ALL SELECT 'f', 3, count(*), 'NEAR_CONSTANT' FROM g")
def _(t):
    return Q.constant_columns(_gaps(t).withColumn("f", F.col("k") % 3), ["c", "d", "f"])


@query("q06_assembly_coverage", W("units", g=GAPS, l="SELECT segment, 'a' AS \"column\", avg((a IS NOT NULL)::INT) AS v, 0.33 AS t FROM g GROUP BY 1 UNION ALL SELECT segment, 'b', avg((b IS NOT NULL)::INT), 0.6 FROM g GROUP BY 1") + "SELECT segment, \"column\", round(v, 8) AS coverage, CASE WHEN v < t THEN 'FAIL' WHEN v < t * 1.5 THEN 'WARN' ELSE 'PASS' END AS status FROM l")
def _(t):
    th = t.units.select("segment").distinct().select("segment", F.explode(F.array(F.struct(F.lit("a").alias("column"), F.lit(0.33).alias("threshold")), F.struct(F.lit("b").alias("column"), F.lit(0.6).alias("threshold")))).alias("x")).select("segment", "x.*")
    return rnd(Q.assembly_coverage(_gaps(t), th, "segment", ["a", "b"]).drop("threshold"), 8, "coverage")


@query("q06_missing_columns", "SELECT DISTINCT p_brand AS feature FROM part WHERE p_brand NOT IN ('Brand#2', 'Brand#17') AND right(p_brand, 1) <> '5'")
def _(t):
    c = t.raw("part").select(F.col("p_brand").alias("feature"), F.when(F.right("p_brand", F.lit(1)) == "5", "post_event").otherwise("pre_event").alias("temporal_class")).distinct()
    return Q.missing_columns(t.raw("part").select(F.col("p_size").alias("Brand#2"), F.col("p_size").alias("Brand#17")), c).select("feature")


@query("q07_box_check", W("units") + "SELECT round(avg((lat BETWEEN 28 AND 45 AND lon BETWEEN -115 AND -75)::INT), 8) AS share_inside, count(*) AS n, CASE WHEN avg((lat BETWEEN 28 AND 45 AND lon BETWEEN -115 AND -75)::INT) >= 0.8 THEN 'PASS' WHEN avg((lat BETWEEN 28 AND 45 AND lon BETWEEN -115 AND -75)::INT) >= 0.3 THEN 'WARN' ELSE 'FAIL' END AS status FROM units")
def _(t):
    return rnd(Q.box_check(t.units, "lat", "lon", (28.0, 45.0, -115.0, -75.0)), 8, "share_inside")


@query("q08_multi_county", W("claims", x="SELECT DISTINCT zcta_id, claim_id % 3 AS c FROM claims") + "SELECT count(*) AS n_units, round(avg((k > 1)::INT), 8) AS share_multi, CASE WHEN avg((k > 1)::INT) > 0.1 THEN 'FAIL' ELSE 'PASS' END AS status FROM (SELECT zcta_id, count(DISTINCT c) AS k FROM x GROUP BY 1)")
def _(t):
    return rnd(Q.multi_county_audit(t.claims.select("zcta_id", (F.col("claim_id") % 3).alias("county_fips"))), 8, "share_multi")


@query("q08_scale_audit", W("units", l="SELECT 'acct' AS feature, county_fips AS g, acct AS v FROM units UNION ALL SELECT 'pop', county_fips, pop FROM units") + "SELECT feature, round(b / v, 8) AS ratio, CASE WHEN b / v < 0.1 THEN 'FAIL' ELSE 'PASS' END AS status FROM (SELECT feature, var_samp(v) AS v FROM l GROUP BY 1) JOIN (SELECT feature, var_samp(m) AS b FROM (SELECT feature, g, avg(v) AS m FROM l GROUP BY 1, 2) GROUP BY 1) USING (feature)")
def _(t):
    return rnd(Q.scale_audit(t.units, "county_fips", ["acct", "pop"]), 8, "ratio")


@query("q08_broadcast_audit", W("units", g=GAPS) + "SELECT segment, 'c' AS \"column\", count(DISTINCT c) AS n_distinct, count(c) AS n, 'PASS' AS status FROM g GROUP BY 1 UNION ALL SELECT segment, 'd', 1, count(*), 'FAIL' FROM g GROUP BY 1")
def _(t):
    return Q.broadcast_audit(_gaps(t), "segment", ["c", "d"])


@query("q08_join_rate", "SELECT round(avg((c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'))::INT), 8) AS join_rate, count(*) AS n, CASE WHEN avg((c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'))::INT) < 0.9 THEN 'FAIL' ELSE 'PASS' END AS status FROM customer")
def _(t):
    return rnd(Q.join_rate_audit(t.raw("customer"), t.raw("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", 0.9), 8, "join_rate")


@query("q08_vintage_gap", "SELECT p_partkey, CAST(abs(2017 - (2008 + p_size % 12)) AS INTEGER) AS gap_years, CASE WHEN abs(2017 - (2008 + p_size % 12)) > 5 THEN 'FAIL' WHEN abs(2017 - (2008 + p_size % 12)) > 3 THEN 'WARN' ELSE 'PASS' END AS status FROM part")
def _(t):
    return Q.vintage_audit(t.raw("part").select("p_partkey", F.lit(2017).alias("y"), (2008 + F.col("p_size") % 12).alias("v")), "y", "v").select("p_partkey", "gap_years", "status")


@query("q08_missingness", W("units", g=GAPS, s="SELECT segment, count(a) AS n1, count(*) - count(a) AS n2, avg(c) FILTER (a IS NOT NULL) AS m1, avg(c) FILTER (a IS NULL) AS m2, var_samp(c) FILTER (a IS NOT NULL) AS v1, var_samp(c) FILTER (a IS NULL) AS v2 FROM g GROUP BY 1") + "SELECT segment, n1, n2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t_stat FROM s")
def _(t):
    return rnd(Q.missingness_audit(_gaps(t), ["segment"], "a", "c").select("segment", "n1", "n2", "t_stat"), 6, "t_stat")


@query("q08_event_overlap", W("claims", q="SELECT scenario AS s, quantile_cont(building, 0.25) AS a, quantile_cont(building, 0.75) AS b FROM claims GROUP BY 1") + "SELECT x.s AS group_a, y.s AS group_b, round(greatest(0, least(1, (least(x.b, y.b) - greatest(x.a, y.a)) / least(x.b - x.a, y.b - y.a))), 7) AS iqr_overlap, 'PASS' AS status FROM q x JOIN q y ON x.s < y.s")
def _(t):
    return rnd(Q.event_overlap_audit(t.claims, "scenario", "building"), 7, "iqr_overlap")


@query("q09_support_audits", W("units", g=GAPS) + "SELECT segment AS stratum, count(*) AS n_rows, count(a) AS n_support, CASE WHEN count(a) >= 100 THEN 'PASS' ELSE 'FAIL' END AS status FROM g GROUP BY 1 UNION ALL SELECT CASE WHEN k % 50 < 20 THEN 'coastal' ELSE 'inland' END, count(*), count(b), CASE WHEN count(b) >= 500 THEN 'PASS' ELSE 'FAIL' END FROM g GROUP BY 1")
def _(t):
    g = _gaps(t)
    a = Q.support_audit(g, F.col("segment"), F.col("a").isNotNull(), 100)
    return a.unionByName(Q.support_audit(g, F.when(F.col("k") % 50 < 20, "coastal").otherwise("inland"), F.col("b").isNotNull(), 500))


@query("q10_manifest_columns", "SELECT DISTINCT p_brand AS name, 'not_in_table' AS finding FROM part WHERE p_brand <> 'Brand#2' UNION ALL SELECT 'other', 'not_in_manifest'")
def _(t):
    return Q.manifest_columns(["Brand#2", "other"], t.raw("part").select(F.col("p_brand").alias("name")).distinct())


AUDITED = """SELECT certificate_id, scenario_id, snapshot_t, zcta_id, embedding_arm, CASE WHEN z % 11 = 0 THEN 'a' ELSE zcta_id END AS target, CASE WHEN z % 3 > 0 THEN 0.1 END AS task_residual_floor, CASE WHEN z % 4 > 0 THEN 'no data' END AS why, CASE WHEN z % 5 > 0 THEN 'g1' END AS gate_reached, CASE WHEN z % 2 > 0 THEN 'late' END AS gate_reason
    FROM (SELECT *, CAST(zcta_id AS INT) AS z FROM certificate) UNION ALL SELECT certificate_id || 'x', scenario_id, snapshot_t, zcta_id, embedding_arm, 'a', 0.1, NULL, NULL, NULL FROM certificate WHERE CAST(zcta_id AS INT) % 11 < 2"""


@query("q11_schema_constraints", W("certificate", "snapshots", "scenario_zctas", a=AUDITED) + """SELECT 'certificate' AS "table", c AS "constraint", n AS n_violations FROM (SELECT unnest(['unit:r', 'unit:s_sup', 'unit:n', 'unit:alpha', 'unit:kappa_compat', 'sigma', 'decision', 'simplex', 'unique:certificate_id', 'fk:scenario_id,snapshot_t', 'fk:scenario_id,zcta_id']) AS c, 0::BIGINT AS n)
    UNION ALL SELECT 'certificate', 'unique:scenario_id,snapshot_t,zcta_id,embedding_arm,target', count(*) FROM (SELECT 1 FROM a GROUP BY scenario_id, snapshot_t, zcta_id, embedding_arm, target HAVING count(*) > 1)
    UNION ALL SELECT 'certificate', 'floor_or_reason', count(*) FROM a WHERE task_residual_floor IS NULL AND why IS NULL UNION ALL SELECT 'certificate', 'gate_pairing', count(*) FROM a WHERE gate_reached IS NULL AND gate_reason IS NOT NULL""")
def _(t):
    z, none = F.col("zcta_id").cast("int"), F.lit(None).cast("string")
    c = t.certificate.withColumns({"target": F.when(z % 11 == 0, "a").otherwise(F.col("zcta_id")), "task_residual_floor": F.when(z % 3 > 0, 0.1), "task_residual_floor_unavailable_reason": F.when(z % 4 > 0, "no data"), "gate_reached": F.when(z % 5 > 0, "g1"), "gate_reason": F.when(z % 2 > 0, "late")})
    more = t.certificate.filter(z % 11 < 2).withColumns({"certificate_id": F.concat("certificate_id", F.lit("x")), "target": F.lit("a"), "task_residual_floor": F.lit(0.1), "task_residual_floor_unavailable_reason": none, "gate_reached": none, "gate_reason": none})
    return Q.certificate_constraints(c.unionByName(more), t.snapshots, t.scenario_zctas)


@query("q11_constraint_violations", "SELECT 'lineitem' AS \"table\", 'quantity' AS \"constraint\", count(*) FILTER (NOT l_quantity < 45) AS n_violations FROM lineitem UNION ALL SELECT 'lineitem', 'unique:l_orderkey', (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) UNION ALL SELECT 'lineitem', 'fk:l_orderkey', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))")
def _(t):
    li = t.raw("lineitem")
    o = t.raw("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return Q.check_constraints(li, "lineitem", {"quantity": F.col("l_quantity") < 45}).unionByName(Q.unique_constraint(li, "lineitem", ["l_orderkey"])).unionByName(Q.foreign_key(li, o, "lineitem", ["l_orderkey"]))


@query("q12_unresolved_templates", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'FAIL_UNRESOLVED_TEMPLATE' ELSE 'PASS' END AS severity FROM part")
def _(t):
    p = t.raw("part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("results/{scenario}_"), "p_name")).otherwise(F.col("p_name")).alias("v"))
    return Q.unresolved_templates(p, "v").select("p_partkey", "severity")


def _keys(t):
    o = t.raw("orders")
    declared = o.select(F.col("o_orderpriority").alias("phase"), F.when(F.col("o_custkey") % 10 > 0, F.concat(F.lit("k"), F.col("o_custkey").cast("string"))).alias("key")).distinct()
    inventory = o.filter("o_orderstatus = 'F'").select(F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("key")).distinct()
    return declared, inventory


KEYS = "WITH d AS (SELECT DISTINCT o_orderpriority AS phase, CASE WHEN o_custkey % 10 > 0 THEN 'k' || CAST(o_custkey AS VARCHAR) END AS key FROM orders), i AS (SELECT DISTINCT 'k' || CAST(o_custkey AS VARCHAR) AS key FROM orders WHERE o_orderstatus = 'F')"


@query("q12_declared_outputs", KEYS + " SELECT phase, key, CASE WHEN key IS NULL THEN 'WARN_CONTRACT_GAP' WHEN key IN (SELECT key FROM i) THEN 'PASS' ELSE 'FAIL_MISSING_OUTPUT' END AS severity FROM d")
def _(t):
    return Q.declared_outputs(*_keys(t)).select("phase", "key", "severity")


@query("q12_convention_outputs", KEYS.replace("CASE WHEN o_custkey % 10 > 0", "CASE WHEN o_custkey % 10 > 0 AND o_orderpriority < '3'") + ", c AS (SELECT DISTINCT o_orderpriority AS phase, 'k' || CAST(o_custkey AS VARCHAR) AS key FROM orders WHERE o_orderpriority > '3' AND o_totalprice > 200000) SELECT phase, key, CASE WHEN key IN (SELECT key FROM i) THEN 'WARN_CONTRACT_GAP' ELSE 'FAIL_MISSING_OUTPUT' END AS severity FROM c UNION ALL SELECT NULL, key, 'WARN_UNDECLARED_ARTIFACT' FROM i WHERE key NOT IN (SELECT key FROM c) AND key NOT IN (SELECT key FROM d WHERE key IS NOT NULL)")
def _(t):
    d, i = _keys(t)
    d = d.withColumn("key", F.when(F.col("phase") < "3", F.col("key")))
    c = t.raw("orders").filter("o_orderpriority > '3' AND o_totalprice > 200000").select(F.col("o_orderpriority").alias("phase"), F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("key")).distinct()
    return Q.convention_outputs(c, d, i)


@query("q12_cell_matrix", "WITH c AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O') SELECT coalesce(c.o_custkey, a.o_custkey) AS o_custkey, CASE WHEN c.o_custkey IS NULL THEN 'WARN_SCOPE_EXTRA' WHEN a.o_custkey IS NULL THEN 'FAIL_MISSING_OUTPUT' ELSE 'PASS' END AS severity FROM c FULL JOIN a ON c.o_custkey = a.o_custkey")
def _(t):
    o = t.raw("orders")
    return Q.cell_matrix(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), ["o_custkey"])


@query("q12_content_gate", "WITH c AS (SELECT DISTINCT o_custkey FROM orders), a AS (SELECT o_custkey, CASE WHEN o_custkey % 4 > 0 THEN max(o_totalprice) END AS m FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) SELECT c.o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'FAIL_CONTENT_INCOMPLETE' WHEN m IS NULL THEN 'FAIL_CONTENT_DEGENERATE' ELSE 'PASS' END AS severity FROM c LEFT JOIN a ON a.o_custkey = c.o_custkey")
def _(t):
    o = t.raw("orders")
    a = o.filter("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("p")).select("o_custkey", F.when(F.col("o_custkey") % 4 > 0, F.col("p")).alias("m"))
    return Q.content_gate(o, a, ["o_custkey"], "m")


@query("q13_timestamp_ordering", "SELECT a.o_orderkey AS before, b.o_orderkey AS after, CASE WHEN a.o_orderkey % 3 > 0 AND b.o_orderkey % 3 > 0 THEN CASE WHEN a.o_orderdate <= b.o_orderdate THEN 'PASS' ELSE 'FAIL_ORDERING_VIOLATION' END WHEN a.o_orderkey % 5 > 0 AND b.o_orderkey % 5 > 0 THEN 'WARN_TIMESTAMP_FALLBACK' ELSE 'WARN_TIMESTAMP_UNVERIFIABLE' END AS severity FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1")
def _(t):
    o, k = t.raw("orders"), F.col("o_orderkey")
    ts = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    art = o.select(k.alias("key"), F.when(k % 3 > 0, ts).alias("internal_timestamp"), F.when(k % 5 > 0, ts).alias("last_modified"))
    rules = o.select(k.alias("before"), (k + 1).alias("after")).join(o.select(k.alias("after")), "after", "left_semi")
    return Q.ordering_gate(rules, art)


@query("q14_cross_validation", "SELECT 'price' AS \"column\", count(*) AS n, round(max(d), 6) AS max_abs_diff, round(avg(d), 6) AS mean_abs_diff, count(*) FILTER (d > 0.11) AS n_over_tolerance, round(corr(p, q), 8) AS corr FROM (SELECT p_retailprice AS p, p_retailprice + (p_partkey % 7) / 50.0 AS q, abs((p_partkey % 7) / 50.0) AS d FROM part WHERE p_size > 10)")
def _(t):
    p = t.raw("part")
    a = p.select("p_partkey", F.col("p_retailprice").alias("price"))
    b = p.filter("p_size > 10").select("p_partkey", (F.col("p_retailprice") + F.col("p_partkey") % 7 / 50.0).alias("price"))
    return rnd(rnd(Q.cross_validation(a, b, "p_partkey", ["price"], 0.11), 6, "max_abs_diff", "mean_abs_diff"), 8, "corr")


@query("q15_coverage_gate", W("units", g=GAPS) + "SELECT count(a) AS n_first, count(b) AS n_second, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_pairable, count(*) FILTER (a IS NOT NULL AND b > 1000) AS n_after_masks, count(*) FILTER (a IS NOT NULL AND b > 1000) >= 30 AS passes FROM g")
def _(t):
    return Q.coverage_gate(_gaps(t), "a", "b", F.col("b") > 1000)
