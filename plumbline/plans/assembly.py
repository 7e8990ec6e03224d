"""Join and aggregation queries."""

from pyspark.sql import functions as F

from plumbline.functions.core import zfill
from plumbline.operators import aggregate as A
from plumbline.operators import ranking as R
from plumbline.operators import tables as T
from plumbline.plans.registry import query
from plumbline.plans.standins import W, zf


def rnd(df, n, *cols):
    return df.withColumns({c: F.round(c, n) for c in cols})


CLAIM_AGG = """SELECT zcta_id, count(*) AS claim_count, sum(building) AS b, sum(contents) AS c, sum(building + contents) AS t FROM claims WHERE building + contents > 0 {} GROUP BY zcta_id"""


@query("a01_claims_by_unit", W("units", "claims", g=CLAIM_AGG.format("AND year < 2001")) + """SELECT zcta_id, coalesce(claim_count, 0) AS claim_count, round(coalesce(b, 0), 4) AS building_loss,
    round(coalesce(c, 0), 4) AS contents_loss, round(coalesce(t, 0), 4) AS total_loss, coalesce(claim_count, 0) > 0 AS has_claims FROM units LEFT JOIN g USING (zcta_id)""")
def _(t):
    cols = ["claim_count", "building_loss", "contents_loss", "total_loss"]
    g = T.fill_from(t.units.select("zcta_id"), A.claims_by_unit(t.claims, 2001), ["zcta_id"], cols)
    return rnd(g.select("zcta_id", *cols, F.coalesce("has_claims", F.lit(False)).alias("has_claims")), 4, *cols[1:]).orderBy(F.desc("total_loss"), "zcta_id")


@query("a02_event_claims", W("claims") + "SELECT scenario, zcta_id, count(*) AS event_claim_count, round(sum(building), 4) AS event_total_loss FROM claims GROUP BY 1, 2")
def _(t):
    return rnd(A.event_claims(t.claims, ["scenario", "zcta_id"]), 4, "event_total_loss")


STARTS = "SELECT CAST(y AS VARCHAR) AS event, make_timestamp(y::BIGINT, 7::BIGINT, 1::BIGINT, 0::BIGINT, 0::BIGINT, 0.0) AS start FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)"


@query("a03_history_before_cutoff", W("units", "claims", ev=STARTS) + """SELECT u.zcta_id, ev.event, count(claim_id) AS historical_frequency, round(coalesce(sum(building) / nullif(count(claim_id), 0), 0), 5) AS historical_severity
    FROM units u CROSS JOIN ev LEFT JOIN claims c ON c.zcta_id = u.zcta_id AND c.claim_date < ev.start GROUP BY 1, 2""")
def _(t):
    ev = t.raw("orders").select(F.year("o_orderdate").alias("y")).distinct().select(F.col("y").cast("string").alias("event"), F.make_timestamp("y", F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("start"))
    return rnd(A.history_before(t.claims, ev, t.units), 5, "historical_severity")


SEV = "SELECT n_name AS county_fips, year, CAST(claim_id % 3 AS BIGINT) AS deaths, building / 1000 AS damage_k FROM claims JOIN units USING (zcta_id) JOIN nation ON n_name = county_name"


def _sev(t):
    return t.claims.join(t.units.select("zcta_id", "county_name"), "zcta_id").select(F.col("county_name").alias("county_fips"), "year", (F.col("claim_id") % 3).alias("deaths"), (F.col("building") / 1000).alias("damage_k"))


@query("a04_county_totals", W("units", "claims", s=SEV) + "SELECT county_fips, count(*) AS event_count, CAST(sum(deaths) AS BIGINT) AS deaths, round(sum(damage_k), 5) AS damage_k, count(*) FILTER (year >= 1999) AS event_count_5y, round_even(count(*) / 7.0, 3) AS events_per_year FROM s GROUP BY 1")
def _(t):
    return rnd(A.county_totals(_sev(t), 1999, 7), 5, "damage_k")


@query("a05_county_years", W("units", "claims", s=SEV) + "SELECT county_fips, year, count(damage_k) AS events, CAST(sum(deaths) AS BIGINT) AS deaths, round(sum(damage_k), 5) AS damage_k FROM s GROUP BY 1, 2")
def _(t):
    return rnd(A.county_years(_sev(t)), 5, "damage_k")


@query("a06_epochs_wide", W("claims", y="SELECT zcta_id, year, count(*) AS events, sum(building) AS dmg FROM claims GROUP BY 1, 2") + """SELECT zcta_id, CAST(coalesce(sum(events) FILTER (year BETWEEN 1995 AND 1996), 0) AS BIGINT) AS events_e1,
    CAST(coalesce(sum(events) FILTER (year BETWEEN 1997 AND 2001), 0) AS BIGINT) AS events_e2, round(coalesce(sum(dmg) FILTER (year BETWEEN 1995 AND 1996), 0), 4) AS dmg_e1, round(coalesce(sum(dmg) FILTER (year BETWEEN 1997 AND 2001), 0), 4) AS dmg_e2,
    CAST(sum(events) AS BIGINT) AS events_total, round(sum(dmg), 4) AS dmg_total, round(max(dmg), 4) AS dmg_peak_yr FROM y GROUP BY 1""")
def _(t):
    y = t.claims.groupBy("zcta_id", "year").agg(F.count(F.lit(1)).alias("events"), F.sum("building").alias("dmg"))
    w = A.epochs_wide(y, ["events", "dmg"], {"e1": (1995, 1996), "e2": (1997, 2001)}, "dmg")
    return rnd(w, 4, "dmg_e1", "dmg_e2", "dmg_total", "dmg_peak_yr")


@query("a07_gauge_peaks", W("units", r=f"SELECT {zf('l_suppkey', 6)} AS site_id, max(l_quantity) AS s, max(l_extendedprice) AS f FROM lineitem GROUP BY 1",
       a=f"SELECT {zf('ps * 3')} AS zcta_id, {zf('ps', 6)} AS site_id, ps / 10.0 AS dist_km FROM (SELECT s_suppkey AS ps FROM supplier) UNION ALL SELECT {zf('ps // 2')}, {zf('ps', 6)}, ps / 7.0 FROM (SELECT s_suppkey AS ps FROM supplier)") + """
    SELECT u.zcta_id, max(s) AS peak_stage, max(f) AS peak_flow, count(r.site_id) AS obs_gauge_count, round(min(dist_km), 6) AS obs_gauge_distance_km FROM units u LEFT JOIN a USING (zcta_id) LEFT JOIN r USING (site_id) GROUP BY 1""")
def _(t):
    rd = t.raw("lineitem").select(zfill("l_suppkey", 6).alias("site_id"), F.col("l_quantity").alias("stage"), F.col("l_extendedprice").alias("flow"))
    k = F.col("s_suppkey")
    a = t.raw("supplier").select(zfill(k * 3, 5).alias("zcta_id"), zfill(k, 6).alias("site_id"), (k / 10.0).alias("dist_km")).union(
        t.raw("supplier").select(zfill(F.floor(k / 2), 5), zfill(k, 6), k / 7.0))
    return rnd(A.gauge_peaks(rd, a, t.units), 6, "obs_gauge_distance_km")


@query("a08_tide_peaks", W("units") + """SELECT zcta_id, (SELECT max(value) FROM events) AS max_water_level_m, (SELECT max(s) FROM (SELECT event_type, coalesce(max(CASE WHEN event_type <> 'view' THEN value - 5 END), max(value)) AS s FROM events GROUP BY 1)) AS max_surge_m,
    (SELECT arg_min(ts, (-value, ts)) FROM events) AS peak_time FROM units""")
def _(t):
    lv = t.raw("events").select(F.col("event_type").alias("station"), "ts", F.col("value").alias("level"), F.when(F.col("event_type") != "view", F.col("value") - 5).alias("surge"))
    return A.tide_peaks(lv, t.units)


@query("a09_weighted_means", "SELECT n_name, sum(c_acctbal * w) / sum(w) FILTER (c_acctbal IS NOT NULL) AS acct, round(sum(x * w) / sum(w) FILTER (x IS NOT NULL), 6) AS x FROM (SELECT n_name, c_acctbal, (c_custkey % 11 + 1)::DOUBLE AS w, CASE WHEN c_custkey % 3 > 0 THEN c_custkey::DOUBLE END AS x FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1".replace("sum(c_acctbal * w) / sum(w) FILTER (c_acctbal IS NOT NULL)", "round(sum(c_acctbal * w) / sum(w), 6)"))
def _(t):
    d = t.units.select(F.col("county_name").alias("n_name"), "acct", (F.col("k") % 11 + 1).cast("double").alias("w"), F.when(F.col("k") % 3 > 0, F.col("k").cast("double")).alias("x"))
    return rnd(T.weighted_means(d, ["n_name"], ["acct", "x"], "w"), 6, "acct", "x")


@query("a10_reports_by_unit", W("units") + f"SELECT u.zcta_id, count(event_id) AS report_count, count(event_id) > 0 AS has_reports FROM units u LEFT JOIN (SELECT {zf('user_id')} AS zcta_id, event_id FROM events WHERE event_type = 'error') e USING (zcta_id) GROUP BY 1")
def _(t):
    return A.reports_by_unit(t.raw("events").filter(F.col("event_type") == "error").select(zfill("user_id", 5).alias("zcta_id")), t.units)


@query("a11_modal_stratum", W("units", c="SELECT county_fips, segment, count(*) AS n FROM units GROUP BY 1, 2") + "SELECT county_fips, arg_min(segment, (-n, segment)) AS modal_segment, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1")
def _(t):
    return A.modal_value(t.units, ["county_fips"], "segment")


VR = """SELECT 'acct' AS feature, county_fips AS g, acct AS v FROM units UNION ALL SELECT 'pop', county_fips, pop FROM units"""


@query("a12_variance_ratios", W("units", l=VR) + "SELECT feature, round(b / v, 8) AS ratio FROM (SELECT feature, var_samp(v) AS v FROM l GROUP BY 1) JOIN (SELECT feature, var_samp(m) AS b FROM (SELECT feature, g, avg(v) AS m FROM l GROUP BY 1, 2) GROUP BY 1) USING (feature)")
def _(t):
    return rnd(A.variance_ratios(t.units, "county_fips", ["acct", "pop"]), 8, "ratio")


@query("a12_scale_stability_quadrants", W("units", q="SELECT (lat >= (SELECT quantile_cont(lat, 0.5) FROM units))::INT * 2 + (lon >= (SELECT quantile_cont(lon, 0.5) FROM units))::INT AS g, acct, pop FROM units",
       l="SELECT 'a' AS f, g, acct AS v FROM q UNION ALL SELECT 'p', g, pop FROM q", r="SELECT b / v AS ratio FROM (SELECT f, var_samp(v) AS v FROM l GROUP BY 1) JOIN (SELECT f, var_samp(m) AS b FROM (SELECT f, g, avg(v) AS m FROM l GROUP BY 1, 2) GROUP BY 1) USING (f)") + "SELECT round(greatest(0, least(1, avg(ratio))), 8) AS scale_stability FROM r")
def _(t):
    return rnd(A.scale_stability(t.units, ["acct", "pop"], None), 8, "scale_stability")


@query("a13_support_coverage", W("units") + "SELECT round((avg(CASE WHEN k % 3 > 0 THEN 1.0 ELSE 0 END) + avg(CASE WHEN k % 4 > 0 THEN 1.0 ELSE 0 END)) / 2, 8) AS support_coverage FROM units WHERE k % 5 > 0")
def _(t):
    d = t.units.select(F.when(F.col("k") % 5 > 0, 1).alias("y"), F.when(F.col("k") % 3 > 0, 1).alias("a"), F.when(F.col("k") % 4 > 0, 1).alias("b"))
    return rnd(A.support_coverage(d, "y", ["a", "b"]), 8, "support_coverage")


@query("a14_geometry_kappa", W("units", "edges", s="SELECT zcta_id FROM units WHERE segment IN ('BUILDING', 'MACHINERY')", e="SELECT src, dst FROM edges WHERE src IN (SELECT * FROM s) AND dst IN (SELECT * FROM s)",
       x="SELECT zcta_id, county_fips FROM units UNION ALL SELECT zcta_id, 'other' FROM units WHERE acct < 0", t1="SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e))::DOUBLE / (SELECT count(*) FROM s) AS a",
       t2="SELECT 1 - avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END) AS b FROM (SELECT zcta_id, count(DISTINCT county_fips) AS n FROM x WHERE zcta_id IN (SELECT * FROM s) GROUP BY 1)") + "SELECT round(a, 8) AS spatial_connectivity, round(b, 8) AS admin_alignment, round((a + b) / 2, 8) AS kappa_geom FROM t1, t2")
def _(t):
    s = t.units.filter("segment IN ('BUILDING', 'MACHINERY')")
    x = t.units.select("zcta_id", "county_fips").union(t.units.filter("acct < 0").select("zcta_id", F.lit("other")))
    return rnd(A.geometry_kappa(A.spatial_connectivity(t.edges, s), A.administrative_alignment(x, s)), 8, "spatial_connectivity", "admin_alignment", "kappa_geom")


@query("a15_r_squared", W("oof") + "SELECT task, model_version, round(1 - sum((y_true - y_pred) ** 2) / (count(*) * var_pop(y_true)), 8) AS r2 FROM oof GROUP BY 1, 2")
def _(t):
    return t.oof.groupBy("task", "model_version").agg(F.round(A.r_squared(), 8).alias("r2"))


@query("a16_two_stage_r2", W("oof", x="SELECT DISTINCT zcta AS zcta_id, state_fips AS county_fips FROM oof", u="SELECT task, zcta AS zcta_id, avg(y_true) AS y, avg(y_pred) AS p FROM oof GROUP BY 1, 2") + "SELECT task, county_fips, round(1 - sum((y - p) ** 2) / (count(*) * var_pop(y)), 6) AS metric_value, count(*) AS n_zctas FROM u JOIN x USING (zcta_id) GROUP BY 1, 2 HAVING count(*) >= 3")
def _(t):
    p = t.oof.withColumnRenamed("zcta", "zcta_id")
    return rnd(A.two_stage_r2(p, p.select("zcta_id", F.col("state_fips").alias("county_fips")), ["task"]), 6, "metric_value")


@query("a17_regression_metrics", W("oof") + "SELECT task, fold, count(*) AS n, round(sqrt(avg((y_true - y_pred) ** 2)), 8) AS rmse, round(avg(abs(y_true - y_pred)), 8) AS mae, round(1 - sum((y_true - y_pred) ** 2) / (count(*) * var_pop(y_true)), 8) AS r2, round(stddev_pop(y_true), 8) AS naive_rmse FROM oof GROUP BY 1, 2")
def _(t):
    return rnd(A.regression_metrics(t.oof, ["task", "fold"]), 8, "rmse", "mae", "r2", "naive_rmse")


@query("a17_naive_by_fold", W("oof", m="SELECT a.fold, avg(b.y_true) AS train_mean FROM (SELECT DISTINCT fold FROM oof) a JOIN oof b ON b.fold <> a.fold GROUP BY 1") + "SELECT fold, count(*) AS n, round(any_value(train_mean), 8) AS train_mean, round(sqrt(avg((y_true - train_mean) ** 2)), 6) AS naive_rmse FROM oof JOIN m USING (fold) GROUP BY 1")
def _(t):
    return rnd(rnd(A.naive_by_fold(t.oof, []), 8, "train_mean"), 6, "naive_rmse")


@query("a17_roc_pr_auc", W("oof", d="SELECT task, y_pred AS s, (y_true > 25)::INT AS p FROM oof", r="SELECT *, rank() OVER (PARTITION BY task ORDER BY s) + (count(*) OVER (PARTITION BY task, s) - 1) / 2.0 AS rk FROM d",
       v="SELECT task, s, sum(p) AS p, count(*) AS c FROM d GROUP BY 1, 2", c="SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS k, sum(p) OVER (PARTITION BY task) AS np FROM v WINDOW w AS (PARTITION BY task ORDER BY s DESC)") + """
    SELECT task, round((sum(rk) FILTER (p = 1) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * sum(1 - p)), 8) AS roc_auc, round(any_value(ap), 8) AS pr_auc, count(*) AS n FROM r JOIN (SELECT task, sum(p / np * tp / k) AS ap FROM c GROUP BY 1) USING (task) GROUP BY 1""")
def _(t):
    return rnd(R.roc_pr_auc(t.oof, ["task"], "y_pred", F.col("y_true") > 25), 8, "roc_auc", "pr_auc")


@query("a18_weighted_metrics", W("oof") + "SELECT task, round(sqrt(sum(w * e * e) / sum(w)), 8) AS w_rmse, round(sum(w * abs(e)) / sum(w), 8) AS w_mae, round(sum(w * y_true) / sum(w), 8) AS w_mean_true, round(sum(w * y_pred) / sum(w), 8) AS w_mean_pred FROM (SELECT *, y_true - y_pred AS e, 1.0 + fold AS w FROM oof) GROUP BY 1")
def _(t):
    return rnd(A.weighted_metrics(t.oof.withColumn("w", 1.0 + F.col("fold")), ["task"], "w"), 8, "w_rmse", "w_mae", "w_mean_true", "w_mean_pred")


@query("a19_stratum_stats", W("units") + "SELECT segment, count(*) AS n, round(avg(acct), 6) AS mean, round(stddev_pop(acct), 6) AS std, round(stddev_pop(acct) / avg(acct), 8) AS cv, round(quantile_cont(acct, 0.5), 6) AS median FROM units GROUP BY 1")
def _(t):
    return rnd(rnd(A.stratum_stats(t.units, "segment", "acct"), 6, "mean", "std", "median"), 8, "cv")


@query("a19_heterogeneity", W("units", m="SELECT county_fips, avg(acct) AS m FROM units GROUP BY 1") + "SELECT round(max(m) / min(m), 8) AS ratio, max(m) / min(m) > 1.5 AS heterogeneous FROM m WHERE m > 0")
def _(t):
    return rnd(A.heterogeneity(A.stratum_stats(t.units, "county_fips", "acct"), 1.5), 8, "ratio")


@query("a20_macro_f1", "WITH d AS (SELECT l_returnflag AS t, CASE WHEN l_quantity > 30 THEN 'A' WHEN l_quantity > 15 THEN 'N' ELSE 'R' END AS p FROM lineitem), f AS (SELECT c, 2.0 * count(*) FILTER (t = c AND p = c) / (count(*) FILTER (t = c) + count(*) FILTER (p = c)) AS f1 FROM d CROSS JOIN (VALUES ('A'), ('N'), ('R')) v(c) GROUP BY 1) SELECT round(avg(f1), 8) AS macro_f1, (SELECT count(*) FROM d) AS n FROM f")
def _(t):
    q = F.col("l_quantity")
    d = t.raw("lineitem").select("l_returnflag", F.when(q > 30, "A").when(q > 15, "N").otherwise("R").alias("p"))
    return rnd(A.macro_f1(d, "l_returnflag", "p", ["A", "N", "R"]), 8, "macro_f1")


JUDGE = "SELECT role, length(text) % 2 = 0 AS ml, length(text) % 3 > 0 AS ev, length(text) % 5 > 0 AS ru, length(text) % 7 > 1 AS vi, length(text) % 11 > 2 AS st, length(text) % 13 > 3 AS sc, length(text) % 17 > 4 AS cl FROM conversations"


@query("a21_judgement_rates", f"WITH j AS ({JUDGE}), g AS (SELECT role, avg((ml AND ev AND ru)::INT) AS a, avg((sc AND st)::INT) AS b, avg((vi AND st AND cl)::INT) AS c, avg(sc::INT) AS d, 1 - avg(cl::INT) AS e, count(*) AS n FROM j GROUP BY 1) SELECT role, round(a, 8) AS activation_rate, round(b, 8) AS adherence_rate, round(c, 8) AS grounding_rate, round(d, 8) AS schema_validity_rate, round(e, 8) AS unprovided_claim_rate, n AS n_outputs, round(c, 8) AS \"R\", round(greatest(1 - c - e, 0), 8) AS S_sup, round(e, 8) AS \"N\" FROM g")
def _(t):
    n = F.length("text")
    j = t.raw("conversations").select("role", (n % 2 == 0).alias("map_loaded"), (n % 3 > 0).alias("evidence_table_loaded"), (n % 5 > 0).alias("rubric_loaded"), (n % 7 > 1).alias("used_visual_evidence"),
                                      (n % 11 > 2).alias("used_structured_evidence"), (n % 13 > 3).alias("followed_schema"), (n % 17 > 4).alias("no_unprovided_claims"))
    g = A.judgement_rates(j, ["role"])
    return rnd(g, 8, *[c for c in g.columns if c not in ("role", "n_outputs")])


@query("a27_target_availability", W("units", l="SELECT segment, 'acct' AS c, (acct < 0)::INT AS m FROM units UNION ALL SELECT segment, 'pop', (pop < 1000)::INT FROM units") + """SELECT coalesce(segment, 'all') AS segment, c AS "column", round(avg(m), 8) AS missing_rate, count(*) AS n FROM l GROUP BY GROUPING SETS ((segment, c), (c))""")
def _(t):
    d = t.units.select("segment", F.when(F.col("acct") >= 0, F.col("acct")).alias("acct"), F.when(F.col("pop") >= 1000, F.col("pop")).alias("pop"))
    return rnd(A.target_availability(d, "segment", ["acct", "pop"]), 8, "missing_rate")


@query("a28_scorecard", W("oof", "fold_metrics") + "SELECT model_version, round(avg(metric) FILTER (task = 'A'), 8) AS \"A\", round(avg(metric) FILTER (task = 'N'), 8) AS \"N\", round(avg(metric) FILTER (task = 'R'), 8) AS \"R\", round(avg(metric), 8) AS mean, round(max(metric), 8) AS best, count(*) AS n_cells FROM fold_metrics GROUP BY 1")
def _(t):
    return rnd(A.scorecard(t.fold_metrics, "model_version", "task", ["A", "N", "R"], "metric"), 8, "A", "N", "R", "mean", "best")


@query("a29_sar_anomaly", W("units") + "SELECT zcta_id, pop / 100 - CASE WHEN pop > 4500 THEN k % 20 ELSE 0 END AS sar_anomaly_pct FROM units")
def _(t):
    return A.sar_anomaly(t.units.select("zcta_id", (F.col("pop") / 100).alias("flood_pct")), t.units.filter("pop > 4500").select("zcta_id", (F.col("k") % 20).cast("double").alias("permanent_pct"))).select("zcta_id", "sar_anomaly_pct")


@query("a30_region_embedding", "WITH m AS (SELECT label, CAST(i AS INTEGER) - 1 AS dim, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) SELECT label, dim, round((m - avg(m) OVER (PARTITION BY dim)) / stddev_pop(m) OVER (PARTITION BY dim), 5) AS z FROM m")
def _(t):
    return rnd(A.region_embedding(t.raw("embeddings").withColumn("e", F.col("embedding").cast("array<double>")), "label", "e"), 5, "z")


@query("a31_evidence_text", W("units") + "SELECT zcta_id, 'Unit ' || zcta_id || chr(10) || '- County: ' || county_name || chr(10) || '- Population: ' || CASE WHEN pop >= 3000 THEN CAST(pop::BIGINT AS VARCHAR) ELSE 'N/A' END AS evidence FROM units")
def _(t):
    return t.units.select("zcta_id", A.evidence_text(t.units, "Unit", [("County", F.col("county_name")), ("Population", F.when(F.col("pop") >= 3000, F.col("pop").cast("long")))]).alias("evidence"))


@query("a32_county_centroids", W("units") + "SELECT county_fips, round(avg(lat), 8) AS lat, round(avg(lon), 8) AS lon FROM units GROUP BY 1")
def _(t):
    return rnd(A.centroids(t.units, "county_fips"), 8, "lat", "lon")


@query("a33_coverage_flags", W("units") + "SELECT zcta_id, acct >= 0 AND pop >= 1000 AS has_all, pop >= 1000 AS has_pop FROM units")
def _(t):
    d = t.units.select("zcta_id", F.when(F.col("acct") >= 0, 1).alias("a"), F.when(F.col("pop") >= 1000, 1).alias("p"))
    return A.coverage_flags(d, {"all": ["a", "p"], "pop": ["p"]}).drop("a", "p")


@query("j01_enrich_first", W("units") + f"SELECT u.zcta_id, p AS best_price, b AS n FROM units u LEFT JOIN (SELECT {zf('o_custkey')} AS zcta_id, min(o_totalprice) AS p FROM orders GROUP BY 1) USING (zcta_id) LEFT JOIN (SELECT {zf('user_id')} AS zcta_id, count(*) AS b FROM events GROUP BY 1) USING (zcta_id)")
def _(t):
    o = t.raw("orders").select(zfill("o_custkey", 5).alias("zcta_id"), F.col("o_totalprice").alias("best_price"))
    e = t.raw("events").groupBy(zfill("user_id", 5).alias("zcta_id")).agg(F.count(F.lit(1)).alias("n"))
    return T.enrich(t.units.select("zcta_id"), {"orders": o, "events": e}, ["zcta_id"])


@query("j02_year_spine", W("units", "claims", y="SELECT zcta_id, year, count(*) AS n FROM claims GROUP BY 1, 2") + "SELECT u.zcta_id, CAST(s.year AS INTEGER) AS year, coalesce(n, 0) AS n FROM units u CROSS JOIN (SELECT unnest(range(1995, 2002)) AS year) s LEFT JOIN y ON y.zcta_id = u.zcta_id AND y.year = s.year")
def _(t):
    y = t.claims.groupBy("zcta_id", "year").agg(F.count(F.lit(1)).alias("n"))
    return T.fill_from(T.year_spine(t.units.select("zcta_id"), 1995, 2001), y, ["zcta_id", "year"], ["n"])


@query("j03_county_to_unit", W("units") + "SELECT u.zcta_id, u.county_fips, coalesce(n, 0) AS n FROM units u LEFT JOIN (SELECT lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS county_fips, count(*) AS n FROM supplier WHERE s_acctbal > 2000 GROUP BY 1) USING (county_fips)")
def _(t):
    f = t.raw("supplier").filter("s_acctbal > 2000").groupBy(zfill("s_nationkey", 5).alias("county_fips")).agg(F.count(F.lit(1)).alias("n"))
    return T.county_to_unit(t.units, f, ["n"])


@query("j04_majority_county", "WITH a AS (SELECT o_custkey, l_suppkey % 25 AS c, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT o_custkey, arg_min(c, (-q, c)) AS county, count(DISTINCT c) AS n_counties FROM a GROUP BY 1")
def _(t):
    a = t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", (F.col("l_suppkey") % 25).alias("county")).agg(F.sum("l_quantity").alias("q"))
    return T.majority_county(a, "o_custkey", "county", "q")


@query("j15_tract_to_unit", "SELECT c_nationkey AS zcta_id, round(sum(o_totalprice * w) / sum(w), 4) AS o_totalprice FROM (SELECT o_custkey AS tract, o_totalprice FROM orders) o JOIN (SELECT c_custkey AS tract, c_nationkey, (c_custkey % 7 + 1)::DOUBLE AS w FROM customer) USING (tract) GROUP BY 1")
def _(t):
    x = t.raw("customer").select(F.col("c_custkey").alias("tract"), F.col("c_nationkey").alias("zcta_id"), (F.col("c_custkey") % 7 + 1).cast("double").alias("pop"))
    return rnd(T.tract_to_unit(t.raw("orders").select(F.col("o_custkey").alias("tract"), "o_totalprice"), x, ["o_totalprice"]), 4, "o_totalprice")


@query("j16_catchment_to_unit", """WITH a AS (SELECT p_partkey AS comid, p_size::DOUBLE AS wet FROM part WHERE p_size > 16), b AS (SELECT p_partkey AS comid, p_retailprice AS slope FROM part WHERE p_size < 40), m AS (SELECT * FROM a FULL JOIN b USING (comid)),
    f AS (SELECT l_partkey AS comid, l_suppkey AS zcta_id, sum(l_quantity) AS fraction FROM lineitem GROUP BY 1, 2) SELECT zcta_id, round(sum(wet * fraction) / sum(fraction) FILTER (wet IS NOT NULL), 6) AS wet, round(sum(slope * fraction) / sum(fraction) FILTER (slope IS NOT NULL), 6) AS slope FROM f LEFT JOIN m USING (comid) GROUP BY 1""")
def _(t):
    p = t.raw("part")
    a = p.filter("p_size > 16").select(F.col("p_partkey").alias("comid"), F.col("p_size").cast("double").alias("wet"))
    b = p.filter("p_size < 40").select(F.col("p_partkey").alias("comid"), F.col("p_retailprice").alias("slope"))
    f = t.raw("lineitem").groupBy(F.col("l_partkey").alias("comid"), F.col("l_suppkey").alias("zcta_id")).agg(F.sum("l_quantity").alias("fraction"))
    return rnd(T.catchment_to_unit(a, b, f, ["wet", "slope"]), 6, "wet", "slope")


@query("j19_missing_and_extra", "SELECT o_custkey AS k, 'missing' AS finding FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, 'extra' FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    o = t.raw("orders").withColumn("k", F.col("o_custkey"))
    return T.missing_and_extra(o.filter(F.col("o_orderstatus") == "F"), o.filter(F.col("o_orderstatus") == "P"), ["k"])


@query("j20_many_to_one", W("oof") + "SELECT fold, count(*) AS n, round(avg(s_acctbal), 6) AS acct FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN (SELECT sample_id, fold FROM oof) o ON o.sample_id = l_orderkey * 10 + l_linenumber GROUP BY 1".replace("JOIN (SELECT sample_id, fold FROM oof) o ON o.sample_id = l_orderkey * 10 + l_linenumber", "").replace("SELECT fold", "SELECT CAST(l_orderkey % 5 AS INTEGER) AS fold"))
def _(t):
    f = t.raw("lineitem").select((F.col("l_orderkey") % 5).cast("int").alias("fold"), F.col("l_suppkey").alias("s_suppkey"))
    return rnd(T.many_to_one(f, t.raw("supplier").select("s_suppkey", "s_acctbal"), "s_suppkey").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("s_acctbal").alias("acct")), 6, "acct")


@query("j28_fractions", """WITH p AS (SELECT l_partkey AS comid, l_suppkey AS zcta_id, sum(l_extendedprice) AS area FROM lineitem GROUP BY 1, 2), s AS (SELECT *, greatest(0, least(1, area / 300000.0)) AS f FROM p)
    SELECT comid, zcta_id, round_even(f / sum(f) OVER (PARTITION BY comid), 6) AS fraction FROM s WHERE f > 0.03""")
def _(t):
    p = t.raw("lineitem").groupBy(F.col("l_partkey").alias("comid"), F.col("l_suppkey").alias("zcta_id")).agg(F.sum("l_extendedprice").alias("area")).withColumn("total", F.lit(300000.0))
    return T.normalise_fractions(p, "comid", "area", "total", 0.03).select("comid", "zcta_id", "fraction")


@query("j29_deployment_universe", W("units") + "SELECT zcta_id, county_fips, CASE WHEN pop > 3000 THEN pop END AS pop FROM units WHERE county_fips IN (SELECT county_fips FROM units WHERE acct > 9900)")
def _(t):
    return T.deployment_universe(t.units.filter("acct > 9900"), t.units.select("zcta_id", "county_fips"), t.units.filter("pop > 3000").select("zcta_id", "pop"))


@query("w19_upsert_last", "SELECT p_partkey, CASE WHEN p_size < 20 THEN p_retailprice * 2 ELSE p_retailprice END AS price FROM part WHERE p_size > 10 OR p_size < 20")
def _(t):
    p = t.raw("part")
    old = p.filter("p_size > 10").select("p_partkey", F.col("p_retailprice").alias("price"))
    return T.upsert_last(old, p.filter("p_size < 20").select("p_partkey", (F.col("p_retailprice") * 2).alias("price")), ["p_partkey"])


@query("w20_align_union", "SELECT o_orderkey AS k, o_totalprice AS price, NULL::VARCHAR AS note FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, NULL, o_orderpriority FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    o = t.raw("orders").withColumn("k", F.col("o_orderkey"))
    return T.align_union([o.filter(F.col("o_orderstatus") == "F").select("k", F.col("o_totalprice").alias("price")), o.filter(F.col("o_orderstatus") == "P").select("k", F.col("o_orderpriority").alias("note"))])


@query("w21_coverage_by", "SELECT o_orderstatus, 'a' AS \"column\", round(avg((o_orderkey % 3 > 0)::INT), 8) AS coverage FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, 'b', round(avg((o_custkey % 4 > 0)::INT), 8) FROM orders GROUP BY 1")
def _(t):
    d = t.raw("orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 3 > 0, 1).alias("a"), F.when(F.col("o_custkey") % 4 > 0, 1).alias("b"))
    return rnd(T.coverage_by(d, ["o_orderstatus"], ["a", "b"]), 8, "coverage")


@query("w22_set_overlap", W("units", f="SELECT acct < 2000 AS a, pop < 3000 AS b FROM units") + "SELECT count(*) FILTER (a AND b) AS n_both, count(*) FILTER (a OR b) AS n_either, round(count(*) FILTER (a AND b) / count(*) FILTER (a OR b), 8) AS jaccard, round(count(*) FILTER (a AND b) * count(*) FILTER (NOT a AND NOT b) / (count(*) FILTER (a AND NOT b) * count(*) FILTER (b AND NOT a)), 8) AS odds_ratio FROM f")
def _(t):
    return rnd(T.set_overlap(t.units, F.col("acct") < 2000, F.col("pop") < 3000), 8, "jaccard", "odds_ratio")
