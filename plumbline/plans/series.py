"""Time-series, window, bin and weighting queries."""

from pyspark.sql import functions as F

from plumbline.functions.core import zfill
from plumbline.operators import timeseries as S
from plumbline.operators import weights as B
from plumbline.operators.ranking import percentile_rank
from plumbline.plans import drawsql as D
from plumbline.plans.assembly import rnd
from plumbline.plans.registry import query
from plumbline.plans.spatial import TRACK, _track
from plumbline.plans.standins import W, exact_mean, hav, sql_mean

DENSE = "SELECT u.zcta_id, u.event, h.hour, coalesce(x.rain, 0) AS rain, row_number() OVER (PARTITION BY u.zcta_id, u.event ORDER BY h.hour) AS i FROM (SELECT DISTINCT zcta_id, event FROM hourly) u JOIN (SELECT event, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM hourly GROUP BY 1) h USING (event) LEFT JOIN hourly x ON x.zcta_id = u.zcta_id AND x.event = u.event AND x.hour = h.hour"
ROLL = "SELECT *, sum(rain) OVER (PARTITION BY zcta_id, event ORDER BY hour ROWS 2 PRECEDING) AS s3, sum(rain) OVER (PARTITION BY zcta_id, event ORDER BY hour ROWS 5 PRECEDING) AS s6 FROM d"


@query("w01_rolling_peaks", W("hourly", d=DENSE, r=ROLL) + "SELECT zcta_id, event, round(max(rain), 6) AS peak_1h_mm, round(max(s3) FILTER (i >= 3), 6) AS peak_3h_mm, round(max(s6) FILTER (i >= 6), 6) AS peak_6h_mm FROM r GROUP BY 1, 2")
def _(t):
    return rnd(S.rolling_peaks(t.hourly).select("zcta_id", "event", "peak_1h_mm", "peak_3h_mm", "peak_6h_mm"), 6, "peak_1h_mm", "peak_3h_mm", "peak_6h_mm")


@query("w02_storm_shape", W("hourly", d=DENSE) + "SELECT zcta_id, event, count(*) FILTER (rain > 1) AS storm_duration_h, CAST(coalesce(arg_min(i, (-rain, i)) - min(i) FILTER (rain > 1), 0) AS INTEGER) AS time_to_peak_h, round(CASE WHEN count(*) FILTER (rain > 1) >= 2 THEN stddev_pop(rain) FILTER (rain > 1) / avg(rain) FILTER (rain > 1) ELSE 0 END, 6) AS rainfall_intensity_cv FROM d GROUP BY 1, 2")
def _(t):
    return rnd(S.rolling_peaks(t.hourly).select("zcta_id", "event", "storm_duration_h", "time_to_peak_h", "rainfall_intensity_cv"), 6, "rainfall_intensity_cv")


RT = "SELECT zcta_id, event, max(rain) AS pk, sum(rain) AS tot, CAST(count(*) FILTER (rain > 1) AS DOUBLE) AS dur, epoch(arg_min(hour, (-rain, hour)) - min(hour)) / 3600 AS ph, coalesce(quantile_cont(rain, 0.9) FILTER (rain > 0), 0) AS p90 FROM hourly GROUP BY 1, 2"


@query("w03_rain_timing", W("hourly", r=RT) + "SELECT zcta_id, event, round(pk, 6) AS rain_peak_intensity_mm_hr, round(tot, 6) AS rain_total_mm, dur AS rain_duration_hr, ph AS rain_peak_hour, round(p90, 6) AS rain_p90_intensity FROM r")
def _(t):
    return rnd(S.rain_timing(t.hourly), 6, "rain_peak_intensity_mm_hr", "rain_total_mm", "rain_p90_intensity")


TIDE = "SELECT zcta_id, event, hour, rain / 5 AS observed_m, (extract(hour FROM hour) % 6) / 5.0 AS predicted_m FROM hourly WHERE event IN ('view', 'click', 'error')"
ST = "SELECT zcta_id, event, max(observed_m - predicted_m) AS mx, CAST(count(*) FILTER (observed_m - predicted_m > 0.3) AS DOUBLE) AS dur, epoch(arg_min(hour, (predicted_m - observed_m, hour)) - min(hour)) / 3600 AS ph, max(predicted_m) - min(predicted_m) AS rg FROM td GROUP BY 1, 2"


def _tides(t):
    return t.hourly.filter("event IN ('view', 'click', 'error')").select("zcta_id", "event", "hour", (F.col("rain") / 5).alias("observed_m"), (F.hour("hour") % 6 / 5.0).alias("predicted_m"))


@query("w04_surge_timing", W("hourly", td=TIDE, s=ST) + "SELECT zcta_id, event, round(mx, 6) AS surge_max_m, dur AS surge_duration_hr, ph AS surge_peak_hour, round(rg, 6) AS tide_range_m FROM s")
def _(t):
    return rnd(S.surge_timing(_tides(t)), 6, "surge_max_m", "tide_range_m")


@query("j17_w05_compound_timing", W("hourly", r=RT.replace("FROM hourly", "FROM hourly WHERE event <> 'view'"), td=TIDE, s=ST) + """SELECT zcta_id, event, round(abs(coalesce(r.ph, 0) - coalesce(s.ph, 0)), 6) AS rain_surge_lag_hr, round(greatest(least(coalesce(r.dur, 0), coalesce(s.dur, 0)) - abs(coalesce(r.ph, 0) - coalesce(s.ph, 0)), 0), 6) AS rain_surge_overlap_hr,
    round(coalesce(tot, 0) / (SELECT greatest(max(tot), 1) FROM r) * coalesce(mx, 0) / (SELECT greatest(max(mx), 0.01) FROM s), 8) AS compound_score FROM r FULL JOIN s USING (zcta_id, event)""")
def _(t):
    c = S.compound_timing(S.rain_timing(t.hourly.filter("event <> 'view'")), S.surge_timing(_tides(t)))
    return rnd(rnd(c.select("zcta_id", "event", "rain_surge_lag_hr", "rain_surge_overlap_hr", "compound_score"), 6, "rain_surge_lag_hr", "rain_surge_overlap_hr"), 8, "compound_score")


LEG = hav("plat", "plon", "lat", "lon")
LEG2 = hav("lat", "lon", "nlat", "nlon")


@query("w06_approach_speed", W("units", tr=TRACK, c="SELECT avg(lat) AS clat, avg(lon) AS clon FROM units", f="SELECT *, lag(ts) OVER w AS pts, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lead(ts) OVER w AS nts, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon FROM tr WINDOW w AS (PARTITION BY event ORDER BY ts)",
       v=f"SELECT event, ts, {hav('clat', 'clon', 'lat', 'lon')} AS d, CASE WHEN pts IS NOT NULL THEN {LEG} / (epoch(ts - pts) / 3600) ELSE {LEG2} / (epoch(nts - ts) / 3600) END AS sp FROM f, c", b="SELECT event, arg_min(sp, (d, ts)) AS sp FROM v GROUP BY 1")
       + "SELECT zcta_id, event, round(sp, 6) AS storm_approach_speed_kph FROM units CROSS JOIN b")
def _(t):
    return rnd(S.approach_speed(_track(t), t.units), 6, "storm_approach_speed_kph")


@query("w07_forecast_bias", W("hourly", r=RT, f="SELECT zcta_id, event, sum(rain * 1.1 + 0.5) AS q, max(rain * 1.1 + 0.5) AS p FROM hourly WHERE extract(hour FROM hour) % 6 = 0 GROUP BY 1, 2") + "SELECT zcta_id, event, round(q, 6) AS qpf_total_mm, round(p, 6) AS qpf_peak_mm, round(q - tot, 6) AS forecast_bias_mm FROM f LEFT JOIN r USING (zcta_id, event)")
def _(t):
    f = t.hourly.filter(F.hour("hour") % 6 == 0).withColumn("qpf", F.col("rain") * 1.1 + 0.5)
    return rnd(S.forecast_bias(f, S.rain_timing(t.hourly)), 6, "qpf_total_mm", "qpf_peak_mm", "forecast_bias_mm")


PR = "(rank() OVER ({p} ORDER BY {v}) + (count(*) OVER ({q}) - 1) / 2.0 - 1) / (count(*) OVER ({p}) - 1)"


@query("w08_percentile_rank", W("units", v="SELECT zcta_id, CASE WHEN k % 9 > 0 THEN floor(acct / 50) END AS x FROM units", r="SELECT zcta_id, " + PR.format(p="", q="PARTITION BY x", v="x") + " AS pr FROM v WHERE x IS NOT NULL") + "SELECT zcta_id, round(pr, 8) AS pct_rank FROM v LEFT JOIN r USING (zcta_id)")
def _(t):
    d = t.units.select("zcta_id", F.when(F.col("k") % 9 > 0, F.floor(F.col("acct") / 50)).alias("x"))
    return percentile_rank(d, [], "x", "pct_rank").select("zcta_id", F.round("pct_rank", 8).alias("pct_rank"))


@query("w09_rank_disagreement", W("oof", m="SELECT zcta, model_version AS c, avg(round(y_pred * 10)) AS v FROM oof GROUP BY 1, 2", r="SELECT zcta, c, " + PR.format(p="PARTITION BY c", q="PARTITION BY c, v", v="v") + " AS r FROM m") + "SELECT a.zcta, round(max(abs(a.r - b.r)), 8) AS max_divergence, round(avg(abs(a.r - b.r)), 8) AS mean_divergence FROM r a JOIN r b ON a.zcta = b.zcta AND a.c < b.c GROUP BY 1")
def _(t):
    return rnd(S.rank_disagreement(t.oof.withColumn("y_pred", F.round(F.col("y_pred") * 10)), "zcta", "model_version", "y_pred").drop("n_constructs"), 8, "max_divergence", "mean_divergence")


def edge_sql(col, n, src):
    return ", ".join(f"quantile_cont({col}, {i}/{n}.0) AS {col}{i}" for i in range(1, n))


VALT = """SELECT l_orderkey * 10 + l_linenumber AS id, l_linestatus = 'F' AS is_val, CASE WHEN l_partkey % 23 > 0 THEN l_quantity END AS q, l_extendedprice AS p, l_tax AS x, l_discount AS d, l_shipdate FROM lineitem"""


def _valt(t):
    return t.raw("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_linestatus") == "F").alias("is_val"), F.when(F.col("l_partkey") % 23 > 0, F.col("l_quantity")).alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_tax").alias("x"), F.col("l_discount").alias("d"))


def bin_case(col, n):
    return f"CASE WHEN {col} IS NULL THEN -1 ELSE " + " + ".join(f"({col} > {col}{i})::INT" for i in range(1, n)) + " END"


@query("w10_quantile_bins", f"WITH v AS ({VALT}), e AS (SELECT {edge_sql('q', 5, '')}, {edge_sql('p', 5, '')} FROM v WHERE NOT is_val) SELECT id, {bin_case('q', 5)} AS q_bin, {bin_case('p', 5)} AS p_bin FROM v, e WHERE is_val")
def _(t):
    v = _valt(t)
    return S.apply_bins(v.filter("is_val"), S.quantile_edges(v.filter("NOT is_val"), ["q", "p"]), ["q", "p"]).select("id", "q_bin", "p_bin")


@query("w11_strata", W("units", u="SELECT zcta_id, CASE WHEN k % 15 > 0 THEN acct END AS acct, pop, CASE WHEN k % 20 > 0 THEN (k % 100)::DOUBLE END AS h FROM units", e=f"SELECT {edge_sql('acct', 4, '')} FROM u", f=f"SELECT {edge_sql('pop', 3, '')} FROM u WHERE pop > 0")
       + f"SELECT zcta_id, CASE WHEN acct IS NULL THEN 'Q_missing' ELSE 'Q' || CAST({bin_case('acct', 4)} + 1 AS VARCHAR) END || '_' || CASE WHEN pop > 0 THEN ['rural', 'suburban', 'urban'][{bin_case('pop', 3)} + 1] ELSE 'unknown' END || '_' || CASE WHEN h IS NULL THEN 'unknown' WHEN h > 50 THEN 'remote' ELSE 'accessible' END AS strat_key FROM u, e, f")
def _(t):
    u = t.units.select("zcta_id", F.when(F.col("k") % 15 > 0, F.col("acct")).alias("acct"), "pop", F.when(F.col("k") % 20 > 0, (F.col("k") % 100).cast("double")).alias("h"))
    return S.strata(u, "acct", "pop", "h").select("zcta_id", "strat_key")


LEVELS = f"SELECT l_suppkey AS cell, 'r' || CAST(l_linenumber % 3 AS VARCHAR) AS level, {sql_mean('l_discount', 100)} AS m, {sql_mean('l_tax', 100)} AS d FROM lineitem GROUP BY 1, 2"


def _levels(t):
    return t.raw("lineitem").groupBy(F.col("l_suppkey").alias("cell"), F.concat(F.lit("r"), (F.col("l_linenumber") % 3).cast("string")).alias("level")).agg(exact_mean(F.col("l_discount"), 100).alias("m"), exact_mean(F.col("l_tax"), 100).alias("d"))


@query("w16_ladder_deltas", f"WITH l AS ({LEVELS}) SELECT cell, level, round(m - lag(m) OVER (PARTITION BY cell ORDER BY level), 8) AS delta_m FROM l")
def _(t):
    return rnd(S.ladder_deltas(_levels(t), ["cell"], "level", ["m"]).select("cell", "level", "delta_m"), 8, "delta_m")


WIDEL = "SELECT cell, max(m) FILTER (level = 'r0') AS r0, max(m) FILTER (level = 'r1') AS r1, max(m) FILTER (level = 'r2') AS r2, max(d) FILTER (level = 'r0') AS d0, max(d) FILTER (level = 'r1') AS d1 FROM l GROUP BY 1"


@query("w17_uplift_table", f"WITH l AS ({LEVELS}), w AS ({WIDEL}) SELECT cell, round(r0, 8) AS r0, round(r1, 8) AS r1, round(r2, 8) AS r2, round((r1 - r0) / greatest(abs(r0), 0.001) * 100, 6) AS uplift_r0_r1_pct, round((r2 - r1) / greatest(abs(r1), 0.001) * 100, 6) AS uplift_r1_r2_pct FROM w")
def _(t):
    return rnd(rnd(S.uplift_table(_levels(t), ["cell"], "level", "m", ["r0", "r1", "r2"]), 8, "r0", "r1", "r2"), 6, "uplift_r0_r1_pct", "uplift_r1_r2_pct")


@query("w17_movement_table", f"WITH l AS ({LEVELS}), w AS ({WIDEL}) SELECT cell, round(d0, 8) AS d_r0, round(d1, 8) AS d_r1, round(d1 - d0, 8) AS d_delta_r0_r1 FROM w")
def _(t):
    return rnd(S.movement_table(_levels(t), ["cell"], "level", ["d"], ["r0", "r1"]), 8, "d_r0", "d_r1", "d_delta_r0_r1")


@query("w18_top_arm", f"WITH l AS ({LEVELS}) SELECT cell, arg_min(level, (-m, level)) AS best_arm, round(max(m), 8) AS best_metric, count(*) AS n_arms FROM l GROUP BY 1")
def _(t):
    return rnd(S.top_arm(_levels(t), ["cell"], "level", "m"), 8, "best_metric")


@query("w23_class_breaks", "SELECT 'equal' AS scheme, i::INT AS \"class\", round(lo + (hi - lo) * i / 4, 6) AS break_value FROM (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part), (SELECT unnest(range(0, 5)) AS i) UNION ALL SELECT 'quantile', i::INT, round(q, 6) FROM (SELECT unnest(range(0, 5)) AS i, unnest(quantile_cont(p_retailprice, [0, 0.25, 0.5, 0.75, 1])) AS q FROM part)")
def _(t):
    p = t.raw("part")
    e = S.equal_breaks(p, "p_retailprice").withColumn("scheme", F.lit("equal"))
    return rnd(e.unionByName(S.quantile_breaks(p, "p_retailprice").withColumn("scheme", F.lit("quantile"))), 6, "break_value")


@query("w23_class_of", "SELECT p_partkey, CAST(greatest(0, floor((p_retailprice - lo) / (hi - lo) * 4)) AS INTEGER) AS \"class\" FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) WHERE abs((p_retailprice - lo) / (hi - lo) * 4 - round((p_retailprice - lo) / (hi - lo) * 4)) > 1e-9")
def _(t):
    p = t.raw("part")
    d = S.class_of(p, "p_retailprice", S.equal_breaks(p, "p_retailprice"))
    r = p.agg(F.struct(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))).scalar()
    pos = (F.col("p_retailprice") - F.col("_r.lo")) / (F.col("_r.hi") - F.col("_r.lo")) * 4
    return d.withColumn("_r", r).filter(F.abs(pos - F.round(pos)) > 1e-9).select("p_partkey", "class")


# ---- weighting ---------------------------------------------------------------------------------

BINS = ["q_bin", "x_bin", "d_bin"]
BV = f"SELECT id, is_val, CASE WHEN q IS NULL THEN -1 WHEN q > 40 THEN 3 WHEN q > 25 THEN 2 WHEN q > 10 THEN 1 ELSE 0 END AS q_bin, CASE WHEN x > 0.05 THEN 2 WHEN x > 0.02 THEN 1 ELSE 0 END AS x_bin, CASE WHEN d > 0.07 THEN 2 WHEN d > 0.03 THEN 1 ELSE 0 END AS d_bin, q, p FROM v"
VAL = f"SELECT * FROM b WHERE is_val AND NOT (q_bin = 3 AND p > 60000) AND NOT (x_bin = 0 AND d_bin = 2 AND p < 30000)"
BW = f"WITH v AS ({VALT}), b AS ({BV}), val AS ({VAL}), tgt AS (SELECT * FROM b WHERE NOT is_val)"
LM = ", " + ", ".join(f"{n}m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS descriptor, {c} AS bin, count(*) / (SELECT count(*) FROM {src}) AS mass FROM {src} GROUP BY {c}" for c in BINS) + ")" for n, src in (("v", "val"), ("t", "tgt")))
JOINB = ", fb AS (SELECT coalesce(vm.descriptor, tm.descriptor) AS descriptor, coalesce(vm.bin, tm.bin) AS bin, coalesce(vm.mass, 0) AS p, coalesce(tm.mass, 0) AS q FROM vm FULL JOIN tm ON vm.descriptor = tm.descriptor AND vm.bin = tm.bin)"


def _bins(t):
    q, x, d = F.col("q"), F.col("x"), F.col("d")
    b = _valt(t).withColumns({"q_bin": F.when(q.isNull(), -1).when(q > 40, 3).when(q > 25, 2).when(q > 10, 1).otherwise(0), "x_bin": F.when(x > 0.05, 2).when(x > 0.02, 1).otherwise(0), "d_bin": F.when(d > 0.07, 2).when(d > 0.03, 1).otherwise(0)})
    val = b.filter("is_val AND NOT (q_bin = 3 AND p > 60000) AND NOT (x_bin = 0 AND d_bin = 2 AND p < 30000)")
    return val, b.filter("NOT is_val")


@query("b01_binned_distribution", BW + LM + " SELECT descriptor, bin, round(mass, 8) AS mass FROM vm")
def _(t):
    return rnd(B.long_bins(_bins(t)[0], BINS), 8, "mass")


JS = "SELECT descriptor, sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2 AS js FROM (SELECT descriptor, (p + 1e-12) / sum(p + 1e-12) OVER (PARTITION BY descriptor) AS p, (q + 1e-12) / sum(q + 1e-12) OVER (PARTITION BY descriptor) AS q FROM fb) GROUP BY 1"


@query("b02_js_divergence", BW + LM + JOINB + f" SELECT descriptor, round(js, 8) AS js_divergence FROM ({JS})")
def _(t):
    v, g = _bins(t)
    return rnd(B.js_divergence(B.long_bins(v, BINS), B.long_bins(g, BINS)), 8, "js_divergence")


@query("b03_alignment_gaps", BW.replace("FROM b WHERE is_val AND", "FROM b WHERE is_val AND q_bin < 3 AND") + LM + JOINB + " SELECT descriptor, count(*) FILTER (p > 0) AS validation_bins, count(*) FILTER (q > 0) AS target_bins, count(*) FILTER (q > 0 AND p = 0) AS missing_bins, round(sum(CASE WHEN p = 0 THEN q ELSE 0 END), 8) AS uncovered_target_mass FROM fb GROUP BY 1")
def _(t):
    v, g = _bins(t)
    return rnd(B.alignment_gaps(B.long_bins(v.filter("q_bin < 3"), BINS), B.long_bins(g, BINS)).drop("js_divergence"), 8, "uncovered_target_mass")


FAC = ", f AS (SELECT descriptor, bin, CASE WHEN q > 0 THEN greatest(0.1, least(10, q / p)) ELSE 0 END AS r FROM fb WHERE p > 0), w AS (SELECT id, a.r * b2.r * c.r AS w FROM val JOIN f a ON a.descriptor = 'q_bin' AND a.bin = q_bin JOIN f b2 ON b2.descriptor = 'x_bin' AND b2.bin = x_bin JOIN f c ON c.descriptor = 'd_bin' AND c.bin = d_bin)"


@query("b04_product_weights", BW + LM + JOINB + FAC + " SELECT id, round(1e4 * (0.8 * w / sum(w) OVER () + 0.2 / count(*) OVER ()), 7) AS weight FROM w")
def _(t):
    v, g = _bins(t)
    c = B.shrink_cells(B.product_cells(B.cells_of(v, BINS), B.long_bins(g, BINS), BINS), 0.2)
    return B.attach(v, c, BINS).select("id", F.round(F.col("weight") * 1e4, 7).alias("weight"))


@query("b05_raked_margins", BW + LM + " SELECT descriptor, bin, round(mass, 4) AS mass FROM tm")
def _(t):
    v, g = _bins(t)
    c = B.rake_cells(B.cells_of(v, BINS), B.long_bins(g, BINS), BINS)
    return rnd(B.long_bins(c, BINS, F.col("w") * F.col("n")), 4, "mass")


RAKE = f""", cl AS (SELECT {', '.join(BINS)}, count(*)::DOUBLE AS n FROM val GROUP BY ALL),
 rk AS (SELECT 0 AS step, q_bin, x_bin, d_bin, n, 1.0::DOUBLE AS w FROM cl UNION ALL
 SELECT step + 1, q_bin, x_bin, d_bin, n, w * CASE WHEN mass IS NULL OR mass <= 0 THEN 0 ELSE greatest(0.1, least(10, tot * mass / have)) END FROM
 (SELECT rk.*, tm.mass, sum(w * n) OVER () AS tot, sum(w * n) OVER (PARTITION BY CASE step % 3 WHEN 0 THEN q_bin WHEN 1 THEN x_bin ELSE d_bin END) AS have
 FROM rk LEFT JOIN tm ON tm.descriptor = CASE step % 3 WHEN 0 THEN 'q_bin' WHEN 1 THEN 'x_bin' ELSE 'd_bin' END AND tm.bin = CASE step % 3 WHEN 0 THEN q_bin WHEN 1 THEN x_bin ELSE d_bin END WHERE step < 600))"""


@query("b05_raked_weights", BW.replace("WITH ", "WITH RECURSIVE ", 1) + LM + RAKE + f" SELECT {', '.join(BINS)}, CAST(n AS BIGINT) AS n, round(1e3 * w / sum(w * n) OVER (), 7) AS w FROM rk WHERE step = 600")
def _(t):
    v, g = _bins(t)
    c = B.rake_cells(B.cells_of(v, BINS), B.long_bins(g, BINS), BINS, tol=1e-12)
    total = c.agg(F.sum(F.col("w") * F.col("n"))).scalar()
    return c.withColumn("t", total).select(*BINS, "n", F.round(1e3 * F.col("w") / F.col("t"), 7).alias("w"))


@query("b06_density_ratio_weights")
def _(t):
    v, g = _bins(t)
    return B.density_ratio(v.select("id", "p", "x", "d"), g.select("p", "x", "d"), ["p", "x", "d"]).select("id", "weight")


@query("b07_weight_summary", BW + LM + JOINB + FAC + " SELECT count(*) AS n_validation, round(sum(w) ** 2 / sum(w * w), 4) AS ess, round(sum(w) ** 2 / sum(w * w) / count(*), 8) AS ess_fraction, round(max(w) / sum(w) * count(*), 7) AS max_weight_x_uniform, round(avg((w <= 0)::INT), 8) AS dropped_fraction FROM w")
def _(t):
    v, g = _bins(t)
    s = B.weight_summary(B.product_cells(B.cells_of(v, BINS), B.long_bins(g, BINS), BINS))
    return rnd(rnd(rnd(s, 4, "ess"), 8, "ess_fraction", "dropped_fraction"), 7, "max_weight_x_uniform")


NULL_JS = D.cell_draws("tc", BINS, "n", "SELECT count(*) FROM val", 1000, 0, 7) | {
    "fm": " UNION ALL ".join(f"SELECT rep, '{c}' AS descriptor, {c} AS bin, sum(m) / sum(sum(m)) OVER (PARTITION BY rep) AS p FROM fallen GROUP BY rep, {c}" for c in BINS),
    "fj": "SELECT r.rep, tm.descriptor, coalesce(fm.p, 0) AS p, tm.mass AS q FROM (SELECT DISTINCT rep FROM fallen) r CROSS JOIN tm LEFT JOIN fm ON fm.rep = r.rep AND fm.descriptor = tm.descriptor AND fm.bin = tm.bin",
    "fe": "SELECT rep, descriptor, (p + 1e-12) / sum(p + 1e-12) OVER (PARTITION BY rep, descriptor) AS p, (q + 1e-12) / sum(q + 1e-12) OVER (PARTITION BY rep, descriptor) AS q FROM fj",
    "fs": "SELECT rep, avg(js) AS js FROM (SELECT rep, descriptor, sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2 AS js FROM fe GROUP BY 1, 2) GROUP BY 1"}


@query("b08_js_null_threshold", BW + LM + f", tc AS (SELECT {', '.join(BINS)}, count(*) AS n FROM tgt GROUP BY ALL), " + ", ".join(f"{k} AS ({v})" for k, v in NULL_JS.items()) + " SELECT round(quantile_cont(js, 0.95), 8) AS js_null_threshold, count(*) AS n_reps FROM fs")
def _(t):
    v, g = _bins(t)
    return rnd(B.js_null_threshold(g, BINS, v.agg(F.count(F.lit(1))).scalar(), 1000), 8, "js_null_threshold")


@query("b09_alignment_decision", BW + LM + JOINB + FAC + f", s AS (SELECT count(*) AS n, sum(w) ** 2 / sum(w * w) / count(*) AS ef, max(w) / sum(w) * count(*) AS mw, avg((w <= 0)::INT) AS dr FROM w), j AS (SELECT avg(js) AS j FROM ({JS})) SELECT n AS n_validation, round(ef, 8) AS ess_fraction, round(j, 8) AS mean_js_divergence, CASE WHEN ef < 0.1 OR dr > 0.2 THEN 'FAIL' WHEN ef >= 0.3 AND mw <= 10 AND j <= 0.2 THEN 'PASS' ELSE 'WARN' END AS alignment_decision FROM s, j")
def _(t):
    v, g = _bins(t)
    lv, lg = B.long_bins(v, BINS), B.long_bins(g, BINS)
    d = B.alignment_decision(lv, lg, B.product_cells(B.cells_of(v, BINS), lg, BINS), no_reference=B.no_reference_share(g, "q_bin"))
    return rnd(d.select("n_validation", "ess_fraction", "mean_js_divergence", "alignment_decision"), 8, "ess_fraction", "mean_js_divergence")


@query("b10_residual_margin_gap", BW + LM + JOINB + " SELECT round(max(tv), 8) AS residual_margin_gap FROM (SELECT descriptor, sum(abs(p - q)) / 2 AS tv FROM fb GROUP BY 1)")
def _(t):
    v, g = _bins(t)
    return rnd(B.margin_gap(B.long_bins(v, BINS), B.long_bins(g, BINS)), 8, "residual_margin_gap")


@query("b11_weight_ladder")
def _(t):
    v, g = _bins(t)
    v = v.withColumn("yp", F.col("p") / 2100)
    return B.decompose(v.na.fill(0.0, ["q"]), g, BINS, "q", "yp")


@query("b12_no_reference_fraction", f"WITH v AS ({VALT}) SELECT round(avg((q IS NULL)::INT), 8) AS no_reference_fraction FROM v WHERE NOT is_val")
def _(t):
    return rnd(B.no_reference_share(_bins(t)[1], "q_bin"), 8, "no_reference_fraction")


@query("b13_moe_propagation", "SELECT p_partkey, round(sqrt(CASE WHEN nm * nm - s * s * dm * dm >= 0 THEN nm * nm - s * s * dm * dm ELSE nm * nm + s * s * dm * dm END) / d * 100, 6) AS ratio_moe, round(sqrt(nm * nm + dm * dm), 6) AS sum_moe FROM (SELECT p_partkey, p_size::DOUBLE AS n, p_size / 10.0 AS nm, p_retailprice AS d, p_retailprice / (p_size % 7 + 1) AS dm, p_size / p_retailprice AS s FROM part)")
def _(t):
    z, r = F.col("p_size").cast("double"), F.col("p_retailprice")
    nm, dm = z / 10.0, r / (F.col("p_size") % 7 + 1)
    return t.raw("part").select("p_partkey", F.round(B.ratio_moe(z, nm, r, dm), 6).alias("ratio_moe"), F.round(B.sum_moe(nm, dm), 6).alias("sum_moe"))
