"""Projection, cleaning and predicate queries."""

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions.core import clip
from plumbline.operators import clean as C
from plumbline.plans.registry import query
from plumbline.plans.standins import W


@query("p01_zip_normaliser", """SELECT c_custkey, CASE WHEN z <> '00000' THEN z END AS zip5 FROM (SELECT c_custkey,
    CASE WHEN length(d) >= 5 THEN d ELSE lpad(d, 5, '0') END AS z FROM (SELECT c_custkey, substr(regexp_replace(trim(' ' || (c_custkey % 900) || '-' || c_nationkey || 'x '), '[^0-9]', '', 'g'), 1, 5) AS d FROM customer))""")
def _(t):
    return t.raw("customer").select("c_custkey", X.zip5(F.concat(F.lit(" "), (F.col("c_custkey") % 900).cast("string"), F.lit("-"), F.col("c_nationkey").cast("string"), F.lit("x "))).alias("zip5"))


def _acs(t):
    c = t.raw("part")
    return c.select("p_partkey", F.when(F.col("p_size") % 7 == 0, -666666666.0).when(F.col("p_size") % 11 != 0, F.col("p_retailprice")).alias("acs_income"),
                    F.when(F.col("p_size") % 5 == 0, -3.0).otherwise(F.col("p_size") * 1.0).alias("acs_median_age"))


ACS = "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN -666666666.0 WHEN p_size % 11 <> 0 THEN p_retailprice END AS acs_income, CASE WHEN p_size % 5 = 0 THEN -3.0 ELSE p_size * 1.0 END::DOUBLE AS acs_median_age FROM part"


@query("p02_sentinel_to_null", f"SELECT p_partkey, CASE WHEN acs_income >= -1e6 THEN acs_income END AS acs_income, acs_median_age FROM ({ACS})")
def _(t):
    return C.sentinels_to_null(_acs(t), ["acs_income", "acs_median_age"])


@query("p02_sentinel_report", f"""SELECT c AS "column", count(*) FILTER (v < -1e6) AS n_sentinel, round(count(*) FILTER (v < -1e6) * 100.0 / count(*), 4) AS pct,
    count(DISTINCT CASE WHEN v < -1e6 THEN v END) AS n_sentinel_values, count(*) FILTER (v IS NULL) AS n_null_before, count(*) FILTER (v IS NULL OR v < -1e6) AS n_null_after
    FROM (SELECT 'acs_income' AS c, acs_income AS v FROM ({ACS}) UNION ALL SELECT 'acs_median_age', acs_median_age FROM ({ACS})) GROUP BY c""")
def _(t):
    return C.sentinel_report(_acs(t), ["acs_income", "acs_median_age"]).withColumn("pct", F.round("pct", 4))


@query("p03_negative_to_null", f"SELECT p_partkey, acs_income, CASE WHEN acs_median_age >= 0 THEN acs_median_age END AS acs_median_age FROM ({ACS})")
def _(t):
    return C.negatives_to_null(_acs(t), ["acs_median_age"])


@query("p04_damage_string", """SELECT p_partkey, coalesce(try_cast(CASE WHEN right(s, 1) IN ('K', 'M', 'B') THEN substr(s, 1, length(s) - 1) ELSE s END AS DOUBLE)
    * CASE right(s, 1) WHEN 'K' THEN 1.0 WHEN 'M' THEN 1000.0 WHEN 'B' THEN 1000000.0 ELSE 0.001 END, 0.0) AS damage_k
    FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_size || 'K' WHEN 1 THEN p_size || '.5M' WHEN 2 THEN 'badK' WHEN 3 THEN CAST(p_size * 100 AS VARCHAR) ELSE '' END AS s FROM part)""")
def _(t):
    s, k = F.col("p_size").cast("string"), F.col("p_size") % 5
    raw = F.when(k == 0, F.concat(s, F.lit("k"))).when(k == 1, F.concat(s, F.lit(".5M"))).when(k == 2, "badK").when(k == 3, (F.col("p_size") * 100).cast("string")).otherwise("")
    return t.raw("part").select("p_partkey", X.damage_thousands(raw).alias("damage_k"))


@query("p05_interval_string", "SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_size + 0.5 END::DOUBLE AS ci_low, CASE WHEN p_size % 4 <> 0 THEN p_size + 2.5 END::DOUBLE AS ci_high, p_size % 4 <> 0 AS has_ci FROM part")
def _(t):
    s = F.col("p_size").cast("string")
    raw = F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("( "), s, F.lit(".5 , "), (F.col("p_size") + 2).cast("string"), F.lit(".5 )"))).otherwise(F.concat(F.lit("n/a "), s))
    lo, hi = X.interval_bounds(raw)
    return t.raw("part").select("p_partkey", lo.alias("ci_low"), hi.alias("ci_high"), lo.isNotNull().alias("has_ci"))


@query("p06_flood_zone_class", """SELECT p_partkey, CASE WHEN z IS NULL THEN 'X' WHEN z IN ('A','AE','AH','AO','AR','A99','VE','V') OR contains(z, 'FLOODWAY') THEN 'A'
    WHEN z = 'X' AND (contains(s, '500') OR contains(s, '0.2') OR contains(s, 'SHADED')) THEN 'X500' WHEN contains(z, '0.2 PCT') THEN 'X500' ELSE 'X' END AS zone_class
    FROM (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'AE' WHEN 1 THEN 'X' WHEN 2 THEN 'FLOODWAY 1' WHEN 3 THEN '0.2 PCT CHANCE' WHEN 4 THEN 'D' END AS z,
    CASE WHEN p_size % 4 = 1 THEN 'SHADED' WHEN p_size % 4 = 2 THEN '' ELSE '0.2 AREA' END AS s FROM part)""")
def _(t):
    k = F.col("p_size") % 6
    z = F.when(k == 0, " ae ").when(k == 1, "x").when(k == 2, "floodway 1").when(k == 3, "0.2 pct chance").when(k == 4, "d")
    s = F.when(F.col("p_size") % 4 == 1, "shaded").when(F.col("p_size") % 4 != 2, "0.2 area")
    return t.raw("part").select("p_partkey", X.flood_zone_class(z, s).alias("zone_class"))


@query("p07_storm_categories", """SELECT p_partkey, CASE WHEN p_size * 3 >= 137 THEN 5 WHEN p_size * 3 >= 113 THEN 4 WHEN p_size * 3 >= 96 THEN 3 WHEN p_size * 3 >= 83 THEN 2 WHEN p_size * 3 >= 64 THEN 1 ELSE 0 END AS wind_cat,
    CASE WHEN p_size / 8.0 < 1.5 THEN '1' WHEN p_size / 8.0 < 2.4 THEN '2' WHEN p_size / 8.0 < 3.7 THEN '3' WHEN p_size / 8.0 < 5.5 THEN '4' ELSE '5' END AS surge_cat FROM part""")
def _(t):
    return t.raw("part").select("p_partkey", X.wind_category(F.col("p_size") * 3).alias("wind_cat"), X.surge_category(F.col("p_size") / 8.0).alias("surge_cat"))


@query("p08_level_labels", """SELECT c_custkey, CASE WHEN x IS NULL THEN NULL WHEN x >= 0.7 THEN 'HIGH' WHEN x >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS zone,
    CASE WHEN x IS NULL THEN 'N/A' WHEN x < 0.25 THEN 'Low' WHEN x < 0.5 THEN 'Moderate' WHEN x < 0.75 THEN 'High' ELSE 'Very High' END AS svi_label
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 17 <> 0 THEN (c_custkey % 100) / 100.0 END AS x FROM customer)""")
def _(t):
    x = F.when(F.col("c_custkey") % 17 != 0, F.col("c_custkey") % 100 / 100.0)
    return t.raw("customer").select("c_custkey", X.zone_bucket(x).alias("zone"), X.vulnerability_label(x).alias("svi_label"))


def _universe(t):
    k = F.col("k")
    return t.units.select("zcta_id", F.when(k % 9 != 0, F.col("acct")).alias("acct"), F.when(k % 4 != 0, F.col("pop")).alias("pop"),
                          F.when(k % 3 == 0, "Y").when(k % 3 == 1, "no").otherwise("").alias("leveed"), F.when(k % 6 != 0, k * 1.0 % 50).alias("wet"),
                          F.when(k % 5 == 0, k % 7 * 1.0).alias("slosh_max_surge_m"), (k * 97 % 40000).cast("double").alias("coastal_distance_m"))


UNIVERSE = """SELECT zcta_id, CASE WHEN k % 9 <> 0 THEN acct END AS acct, CASE WHEN k % 4 <> 0 THEN pop END AS pop, k % 3 = 0 AS leveed,
    CASE WHEN k % 6 <> 0 THEN (k % 50)::DOUBLE END AS wet, CASE WHEN k % 5 = 0 THEN (k % 7)::DOUBLE END AS surge FROM units"""
DOM = C.Domain("coast", (C.Rule("acct", "ge", 1000.0), C.Rule("leveed", "truthy"), C.Rule("pop", "notnull")), "and")
DOM_OR = C.Domain("any", (C.Rule("acct", "lt", 0.0), C.Rule("leveed", "truthy")), "or")


@query("p09_eligibility_rules", W("units", u=UNIVERSE) + "SELECT zcta_id, coalesce(acct >= 1000, false) AS ge_ok, leveed AS truthy_ok, pop IS NOT NULL AS notnull_ok FROM u")
def _(t):
    u = _universe(t)
    return u.select("zcta_id", *[r.test(u).alias(f"{r.op}_ok") for r in DOM.rules])


@query("p10_domain_members", W("units", u=UNIVERSE) + """SELECT zcta_id, 'coast' AS domain FROM u WHERE acct >= 1000 AND leveed AND pop IS NOT NULL
    UNION ALL SELECT zcta_id, 'any' FROM u WHERE coalesce(acct < 0, false) OR leveed""")
def _(t):
    u = _universe(t)
    return DOM.select(u).select("zcta_id", F.lit("coast").alias("domain")).unionByName(DOM_OR.select(u).select("zcta_id", F.lit("any").alias("domain")))


@query("p10_domain_report", W("units", u=UNIVERSE) + """SELECT 'acct' AS rule_column, 'ge' AS op, count(*) FILTER (acct >= 1000) AS n_eligible, count(*) FILTER (acct IS NULL) AS n_null_dropped FROM u
    UNION ALL SELECT 'leveed', 'truthy', count(*) FILTER (leveed), 0 FROM u UNION ALL SELECT 'pop', 'notnull', count(pop), count(*) - count(pop) FROM u
    UNION ALL SELECT '*', 'and', count(*) FILTER (acct >= 1000 AND leveed AND pop IS NOT NULL), 0 FROM u""")
def _(t):
    return DOM.report(_universe(t))


@query("p11_policy_floor", W("units", u=UNIVERSE) + "SELECT zcta_id, CASE WHEN pop < 2000 THEN NULL ELSE acct END AS acct FROM u")
def _(t):
    return C.policy_floor(_universe(t), ["acct"], "pop", 2000).select("zcta_id", "acct")


@query("p12_permanent_water", W("units", u=UNIVERSE) + "SELECT zcta_id, wet FROM u WHERE wet IS NULL OR wet <= 30")
def _(t):
    return C.drop_permanent_water(_universe(t), "wet", 30.0).select("zcta_id", "wet")


@query("p13_mechanism_gate", W("units", u=UNIVERSE) + """SELECT zcta_id, 'surge' AS mechanism FROM u WHERE surge IS NOT NULL UNION ALL SELECT zcta_id, 'pluvial' FROM u WHERE surge IS NULL
    UNION ALL SELECT zcta_id, 'surge_by_coast' FROM units WHERE (k * 97) % 40000 <= 20000""")
def _(t):
    u = _universe(t)
    part = lambda df, m, tag: C.mechanism_gate(df, m).select("zcta_id", F.lit(tag).alias("mechanism"))
    return part(u, "surge", "surge").union(part(u, "pluvial", "pluvial")).union(part(u.drop("slosh_max_surge_m"), "surge", "surge_by_coast"))


@query("p14_same_sensor", "SELECT event_id, CASE event_type WHEN 'view' THEN 'ida2021' WHEN 'click' THEN 'ian2022' END AS event FROM events WHERE event_type IN ('view', 'click')")
def _(t):
    ev = F.when(F.col("event_type") == "view", "ida2021").when(F.col("event_type") == "click", "ian2022").when(F.col("event_type") == "error", "sandy2012").otherwise("unlisted")
    return C.same_sensor(t.raw("events").select("event_id", ev.alias("event")), "event")


@query("p15_forbidden_class", "SELECT 'f_' || p_type AS feature, 'post_event' AS temporal_class, count(*) AS n FROM part WHERE p_type LIKE '%E%' AND p_type IN (SELECT min(p_type) FROM part) GROUP BY p_type")
def _(t):
    p = t.raw("part")
    top = p.agg(F.min("p_type").alias("m")).scalar()
    contract = p.groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("f_"), "p_type").alias("feature"), F.when((F.col("p_type") == top) & F.col("p_type").contains("E"), "post_event").otherwise("pre_event").alias("temporal_class"), "n")
    used = [f"f_{r}" for r in ("ECONOMY", "STANDARD", "PROMO", "MEDIUM", "SMALL", "LARGE")]
    return C.refuse_forbidden_classes(used, contract, ["post_event"])


@query("p16_leakage_safe_columns", "SELECT c_custkey, c_acctbal AS acs_wealth FROM customer")
def _(t):
    df = t.raw("customer").select("c_custkey", F.col("c_acctbal").alias("acs_wealth"), F.col("c_acctbal").alias("acs_median_income"), F.col("c_acctbal").alias("lag_acs_pct_poverty"))
    return df.select(*C.feature_columns(df.columns, **C.TASK_WITHHELD["income"]))


@query("p17_complete_rows", W("units") + "SELECT zcta_id FROM units WHERE acct > 0 AND pop > 4000")
def _(t):
    return C.complete_rows(t.units.select("zcta_id", (F.col("acct") > 0).alias("has_acct"), (F.col("pop") > 4000).alias("has_pop")), ["has_acct", "has_pop"]).select("zcta_id")


@query("p18_structure_features", W("units") + "SELECT zcta_id, round(ln(1 + greatest(pop - 100, 0)), 6) AS struct_log_population, lat AS struct_latitude, lon AS struct_longitude FROM units")
def _(t):
    return C.structure_features(t.units.withColumn("p", F.col("pop") - 100), "p", "lat", "lon").select("zcta_id", F.round("struct_log_population", 6).alias("struct_log_population"), "struct_latitude", "struct_longitude")


@query("p19_terrain_composites", """SELECT p_partkey, round(least(p_size / 3.0 / 15.0, 1), 6) AS twi_pct_high_proxy, round(p_size / 3.0 * (1 - least(p_retailprice / 100 / 100, 1)), 6) AS terrain_flood_index FROM part""")
def _(t):
    df = t.raw("part").select("p_partkey", (F.col("p_size") / 3.0).alias("w"), (F.col("p_retailprice") / 100).alias("s"))
    return C.terrain_composites(df, "w", "s").select("p_partkey", *[F.round(c, 6).alias(c) for c in ("twi_pct_high_proxy", "terrain_flood_index")])


@query("p20_drive_minutes", "SELECT p_partkey, round(p_retailprice / 10 * 1.4 / 50 * 60, 4) AS minutes FROM part")
def _(t):
    return t.raw("part").select("p_partkey", F.round(C.drive_minutes(F.col("p_retailprice") / 10), 4).alias("minutes"))


@query("p21_field_status", W("units", u=UNIVERSE) + "SELECT zcta_id, CASE WHEN acct IS NULL THEN 'missing' ELSE 'present' END AS _fs_acct, CASE WHEN pop IS NULL THEN 'missing' ELSE 'present' END AS _fs_pop FROM u")
def _(t):
    return C.with_field_status(_universe(t), ["acct", "pop"]).select("zcta_id", "_fs_acct", "_fs_pop")


@query("p22_observability", W("units", u=UNIVERSE) + "SELECT zcta_id, 2.0 / 3.0 AS obs_feature_modal_frac, acct IS NULL AND pop IS NULL AS obs_missing_sensor_flag FROM u")
def _(t):
    u = _universe(t).withColumn("empty", F.lit(None).cast("double"))
    return C.observability(u, ["acct", "pop", "empty"], ["wet"], "acct", "pop").select("zcta_id", "obs_feature_modal_frac", "obs_missing_sensor_flag")
