"""Certificate, gate and resampling queries over predictions derived from lineitem."""

from pyspark.sql import functions as F

from plumbline.functions.core import zfill
from plumbline.operators import certificates as C
from plumbline.operators import gates as G
from plumbline.operators import resample as R
from plumbline.plans.assembly import rnd
from plumbline.plans.registry import query
from plumbline.plans.standins import W, exact_mean, hsh, sql_mean

TT = "CASE WHEN task = 'R' THEN 'classification' ELSE 'regression' END"
CELL = f"SELECT task, model_version, avg(metric) AS s, avg(random_metric) AS r, {TT} AS tt, CASE WHEN count(*) < 2 THEN 0 ELSE stddev_samp(metric) END AS sigma, CASE WHEN count(*) < 2 THEN 1 WHEN abs(avg(metric)) < 1e-10 THEN 0.5 ELSE 1 / (1 + stddev_samp(metric) / abs(avg(metric))) END AS tau, count(*) AS nf FROM fold_metrics GROUP BY 1, 2"
REL = f"SELECT *, greatest(0, least(1, CASE WHEN tt = 'classification' THEN 2 * (s - 0.5) ELSE s END)) AS rr FROM cell"
SIM = "SELECT *, CASE WHEN r > s AND r > 0 THEN greatest(0, least(1 - rr, (r - s) / greatest(abs(r), 0.01))) ELSE 0 END AS ss FROM rel"
CERT = "SELECT *, 1 - rr - ss AS nn, CASE WHEN rr + (1 - rr - ss) > 0 THEN rr / (rr + (1 - rr - ss)) ELSE 0 END AS alpha FROM sim"
CW = W("oof", "fold_metrics", cell=CELL, rel=REL, sim=SIM, cert=CERT)
def _cells(t):
    kind = F.when(F.col("task") == "R", "classification").otherwise("regression")
    return C.certify_cells(t.fold_metrics, ["task", "model_version"], "metric", "random_metric", kind)


@query("c01_simplex", CW + 'SELECT task, model_version, round(rr, 7) AS "R", round(ss, 7) AS "S_sup", round(nn, 7) AS "N" FROM cert')
def _(t):
    return rnd(_cells(t).select("task", "model_version", "R", "S_sup", "N"), 7, "R", "S_sup", "N")


@query("c02_signals", CW + "SELECT task, model_version, round(alpha, 7) AS alpha, round(1 - ss, 7) AS omega, round(rr * (1 - nn), 7) AS kappa_compat, round(tau, 7) AS tau, round(sigma, 7) AS sigma, nf AS n_folds FROM cert")
def _(t):
    cols = ["alpha", "omega", "kappa_compat", "tau", "sigma"]
    return rnd(_cells(t).select("task", "model_version", *cols, "n_folds"), 7, *cols)


@query("c03_coherence", CW.rstrip() + """, q AS (SELECT task, model_version, count(*) AS n, quantile_cont(metric, 0.5) AS med, quantile_cont(metric, 0.75) - quantile_cont(metric, 0.25) AS iqr, max(metric) - min(metric) AS span, count(*) FILTER (metric > 0) AS up, count(*) FILTER (metric <= 0) AS dn FROM fold_metrics GROUP BY 1, 2)
    SELECT task, model_version, CASE WHEN alpha < 0.01 THEN 'NOT_COMPUTED_TARGET_DEGENERATE' ELSE 'COMPUTED' END AS coherence_status, CASE WHEN alpha >= 0.01 THEN round(0.6 * CASE WHEN med > 0 THEN up WHEN med < 0 THEN dn ELSE n END / n + 0.4 * CASE WHEN span > 1e-12 THEN greatest(0, least(1, 1 - iqr / span)) ELSE 1 END, 7) END AS coherence FROM q JOIN cert USING (task, model_version)""")
def _(t):
    return rnd(_cells(t).select("task", "model_version", "coherence_status", "coherence"), 7, "coherence")


@query("c04_simplex_from_scores", """SELECT l_orderkey, l_linenumber, round(CASE WHEN a + b + c < 1e-12 THEN 1.0 / 3 ELSE a / (a + b + c) END, 8) AS "R", round(CASE WHEN a + b + c < 1e-12 THEN 1.0 / 3 ELSE b / (a + b + c) END, 8) AS "S", round(CASE WHEN a + b + c < 1e-12 THEN 1.0 / 3 ELSE c / (a + b + c) END, 8) AS "N"
    FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 0 ELSE l_quantity / 7 END AS a, CASE WHEN l_tax = 0 THEN 0 ELSE l_discount * 10 END AS b, l_tax * 13 AS c FROM lineitem)""")
def _(t):
    z = F.col("l_tax") == 0
    s = C.simplex_from_scores(F.when(z, 0.0).otherwise(F.col("l_quantity") / 7), F.when(z, 0.0).otherwise(F.col("l_discount") * 10), F.col("l_tax") * 13)
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", *[F.round(e, 8).alias(k) for k, e in s.items()])


@query("c04_simplex_distance", CW + "SELECT a.task, round(sqrt((a.rr - b.rr) ** 2 + (a.ss - b.ss) ** 2 + (a.nn - b.nn) ** 2), 7) AS distance FROM cert a JOIN cert b ON a.task = b.task AND a.model_version = 'm1_seed1' AND b.model_version = 'm3_seed1'")
def _(t):
    c = _cells(t)
    a = c.filter("model_version = 'm1_seed1'").select("task", "R", "S_sup", "N")
    b = c.filter("model_version = 'm3_seed1'").select("task", *[F.col(x).alias(f"o_{x}") for x in ("R", "S_sup", "N")])
    return a.join(b, "task").select("task", F.round(C.simplex_distance(["R", "S_sup", "N"], ["o_R", "o_S_sup", "o_N"]), 7).alias("distance"))


@query("c05_diagnostic_ratios", CW + 'SELECT task, model_version, round(rr / greatest(rr + nn, 1e-12), 7) AS alpha, round(rr / greatest(rr + ss, 1e-12), 7) AS "SCR_norm", round(ss / greatest(ss + nn, 1e-12), 7) AS "CNR_norm", round(rr + ss, 7) AS leaderboard_scalar FROM cert')
def _(t):
    return _cells(t).select("task", "model_version", *[F.round(e, 7).alias(k) for k, e in C.diagnostic_ratios().items()])


MR = "SELECT task, model_version, greatest(0, least(1, 1 - sum((y_true - y_pred) ** 2) / (count(*) * var_pop(y_true)))) AS r2 FROM oof GROUP BY 1, 2"
FL = "SELECT task, 1 - max(r2) AS trf FROM mr GROUP BY 1"
VP = "SELECT task, var_pop(y_true) AS v FROM oof GROUP BY 1"
CC = "SELECT o.*, r2, trf, greatest(0, least(1, 1 - r2 - trf)) AS sc, greatest(0, least(1, 1 - (y_true - y_pred) ** 2 / v)) AS rp FROM oof o JOIN mr USING (task, model_version) JOIN fl USING (task) JOIN vp USING (task)"


@query("c06_ceiling_certificates", W("oof", mr=MR, fl=FL, vp=VP, cc=CC) + 'SELECT sample_id, task, model_version, round(r2, 7) AS "R_ceiling", round(sc, 7) AS "S_ceiling", round(trf, 7) AS task_residual_floor, round(rp, 7) AS "R_proxy", round(1 - rp, 7) AS "N_proxy" FROM cc')
def _(t):
    cols = ["R_ceiling", "S_ceiling", "task_residual_floor", "R_proxy", "N_proxy"]
    return rnd(C.ceiling_certificates(t.oof).select("sample_id", "task", "model_version", *cols), 7, *cols)


ST = "SELECT task, model_version, state_fips, count(*) AS m, sum(y_true) AS sy, sum(y_true * y_true) AS syy, sum((y_true - y_pred) ** 2) AS sse, row_number() OVER (PARTITION BY task, model_version ORDER BY state_fips) - 1 AS pos, count(*) OVER (PARTITION BY task, model_version) AS n FROM oof GROUP BY 1, 2, 3"
BOOT = f"SELECT a.task, a.model_version, rep, 1 - sum(b.sse) / (sum(b.syy) - sum(b.sy) * sum(b.sy) / sum(b.m)) AS r2 FROM st a CROSS JOIN (SELECT unnest(range(1, 1001)) AS rep) JOIN st b ON a.task = b.task AND a.model_version = b.model_version AND b.pos = {hsh(42, 'rep', 'a.pos')} % a.n GROUP BY 1, 2, 3"
BASE = "regexp_replace(model_version, '_seed[0-9]+$', '')"


@query("c07_residual_floor", W("oof", st=ST, boot=BOOT, p=f"SELECT task, {BASE} AS base, avg(r2) AS r2 FROM (SELECT task, model_version, 1 - sum((y_true - y_pred) ** 2) / (count(*) * var_pop(y_true)) AS r2 FROM oof GROUP BY 1, 2) GROUP BY 1, 2",
       c=f"SELECT task, rep, 1 - max(r2) AS trf FROM (SELECT task, rep, {BASE} AS base, avg(r2) AS r2 FROM boot GROUP BY 1, 2, 3) GROUP BY 1, 2")
       + "SELECT p.task, count(*) AS n_models, arg_min(base, (-r2, base)) AS best_model, round(max(r2), 7) AS best_r2, round(1 - max(r2), 7) AS task_residual_floor, round(any_value(lo), 7) AS ci_lower, round(any_value(hi), 7) AS ci_upper FROM p JOIN (SELECT task, quantile_cont(trf, 0.025) AS lo, quantile_cont(trf, 0.975) AS hi FROM c GROUP BY 1) q USING (task) GROUP BY 1")
def _(t):
    f = C.residual_floor(t.oof, 1000).withColumn("n_models", F.col("n_models"))
    return rnd(f.drop("mean_residual_correlation", "flagged"), 7, "best_r2", "task_residual_floor", "ci_lower", "ci_upper")


@query("c07_residual_correlation", W("oof", r=f"SELECT task, zcta, {BASE} AS base, avg(y_true - y_pred) AS e FROM oof GROUP BY 1, 2, 3", f="SELECT task, zcta FROM r GROUP BY 1, 2 HAVING count(*) = 4")
       + 'SELECT a.task, a.base AS "first", b.base AS "second", round(corr(a.e, b.e), 7) AS corr, count(*) AS n_units FROM r a JOIN r b ON a.task = b.task AND a.zcta = b.zcta AND a.base < b.base JOIN f ON f.task = a.task AND f.zcta = a.zcta GROUP BY 1, 2, 3')
def _(t):
    return rnd(C.residual_correlation(t.oof), 7, "corr")


LOC = "SELECT zcta, task, model_version, any_value(r2) AS r2, avg(rp) AS rp, avg(y_pred) AS p, avg(y_true) AS y FROM cc GROUP BY 1, 2, 3"


@query("c08_blend_certificates", W("oof", mr=MR, fl=FL, vp=VP, cc=CC, loc=LOC, raw="SELECT *, greatest(r2, 0.05) AS w FROM loc", nw="SELECT *, w / sum(w) OVER (PARTITION BY zcta, task) AS v FROM raw")
       + 'SELECT zcta, task, count(*) AS n_models, round(sum(v * rp), 6) AS "R_blended", round(sum(v * p), 6) AS y_pred_blended FROM nw GROUP BY 1, 2')
def _(t):
    c = C.ceiling_certificates(t.oof).groupBy("zcta", "task", "model_version").agg(F.max("r2_model").alias("r2_model"), F.avg("R_proxy").alias("R_proxy"), F.avg("S_proxy").alias("S_proxy"), F.avg("N_proxy").alias("N_proxy"), F.avg("y_pred").alias("y_pred"), F.avg("y_true").alias("y_true"))
    return rnd(C.blend(c, ["zcta", "task"]), 6, "R_blended", "y_pred_blended").select("zcta", "task", F.col("n_models").cast("long").alias("n_models"), "R_blended", "y_pred_blended")


@query("c09_certificate_audit")
def _(t):
    return C.audit_certificates(C.ceiling_certificates(t.oof), C.residual_floor(t.oof, 1000))


GC = """SELECT scenario_id, snapshot_t, zcta_id, embedding_arm, r AS R, n AS N, s_sup, alpha, kappa_compat, sigma, CASE WHEN length(zcta_id) > 0 AND CAST(zcta_id AS BIGINT) % 5 > 0 THEN (CAST(zcta_id AS BIGINT) % 17) / 17.0 END AS coherence, (CAST(zcta_id AS BIGINT) % 13) / 13.0 AS kappa_L FROM certificate"""


def _gc(t):
    z = F.col("zcta_id").cast("long")
    return t.certificate.select("scenario_id", "snapshot_t", "zcta_id", "embedding_arm", F.col("r").alias("R"), F.col("n").alias("N"), F.col("s_sup").alias("S_sup"), "alpha", "kappa_compat", "sigma",
                                F.when(z % 5 > 0, z % 17 / 17.0).alias("coherence"), (z % 13 / 13.0).alias("kappa_L"))


def req(p):
    return f"({p.kappa_base} + {p.lambda_turbulence} / (1 + exp(-{p.steepness} * (sigma - {p.sigma_c}))))"


def gate_sql(p):
    gray = f"(kappa_compat >= {req(p)} - {p.epsilon_L} AND kappa_compat < {req(p)})"
    return f"""CASE WHEN kappa_compat IS NULL THEN 'BLOCK' WHEN N >= {p.N_thr} AND alpha < {p.alpha_min} THEN 'REJECT' WHEN coherence IS NULL AND {p.require_coherence} THEN 'BLOCK' WHEN coherence < {p.c_min} THEN 'BLOCK'
    WHEN {gray} AND sigma > {p.sigma_tiebreaker} THEN 'RE_ENCODE' WHEN kappa_compat < {req(p)} AND NOT {gray} THEN 'RE_ENCODE' WHEN kappa_L < {p.kappa_L_min} THEN 'REPAIR' ELSE 'EXECUTE' END"""


KEY = "scenario_id, snapshot_t, zcta_id, embedding_arm"


@query("c10_kappa_required", W("certificate", g=GC) + f"SELECT {KEY}, " + ", ".join(f'round({req(p)}, 8) AS "{n}"' for n, p in G.PRESETS.items()) + " FROM g")
def _(t):
    return _gc(t).select(*KEY.split(", "), *[F.round(G.kappa_required("sigma", p), 8).alias(n) for n, p in G.PRESETS.items()])


@query("c11_sequential_gates", W("certificate", g=GC) + f"SELECT {KEY}, {gate_sql(G.PRESETS['UNIVERSAL'])} AS decision FROM g")
def _(t):
    return G.gate_decision(_gc(t), G.PRESETS["UNIVERSAL"]).select(*KEY.split(", "), "decision")


FLAT = G.PRESETS["GEOSPATIAL_CONUS27"]
SIG = G.Preset("sigmoid", c_min=0.30, require_coherence=False, kappa_base=0.22, lambda_turbulence=0.4, epsilon_L=0.01, kappa_L_min=0.15)


@query("c12_gate_comparison", W("certificate", g=GC, d=f"SELECT 'flat' AS preset, {gate_sql(FLAT)} AS d, kappa_compat - {req(FLAT)} AS m FROM g UNION ALL SELECT 'sigmoid', {gate_sql(SIG)}, kappa_compat - {req(SIG)} FROM g")
       + "SELECT preset, count(*) AS n, round(avg((d = 'EXECUTE')::INT), 8) AS pass_rate, round(avg(m), 7) AS mean_margin, count(*) FILTER (m < 0) AS n_below FROM d GROUP BY 1")
def _(t):
    return rnd(rnd(G.pass_rates(G.compare_presets(_gc(t), {"flat": FLAT, "sigmoid": SIG}), ["preset"]), 8, "pass_rate"), 7, "mean_margin")


LV = "CASE WHEN {x} >= 0.7 THEN 'HIGH' WHEN {x} >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"


@query("c13_degradation", W("certificate", g=GC, l=f"SELECT *, {LV.format(x='alpha')} AS al, {LV.format(x='kappa_compat')} AS kl FROM g") + f"""SELECT {KEY}, CASE WHEN sigma >= 0.3 THEN 'UNSTABLE' WHEN N > R AND alpha < 0.3 THEN 'NOISE_COLLAPSED' WHEN N > R THEN 'NOISE_DOMINANT' WHEN al = 'LOW' AND kl <> 'LOW' THEN 'CONTENT_DEGRADATION'
    WHEN kl = 'LOW' AND al <> 'LOW' THEN 'GEOMETRY_MISMATCH' WHEN al = 'LOW' AND kl = 'LOW' THEN 'TOTAL_FAILURE' WHEN al = 'HIGH' AND kl = 'HIGH' THEN 'HEALTHY' ELSE 'MILD_CONTENT_ISSUE' END AS degradation FROM l""")
def _(t):
    return _gc(t).select(*KEY.split(", "), G.degradation(FLAT).alias("degradation"))


MET = "SELECT task, CASE fold % 3 WHEN 0 THEN 'random' WHEN 1 THEN 'spatial_blocked' ELSE 'leave_event_out' END AS split, CASE WHEN model_version < 'm3' THEN 'histgbdt' ELSE 'ridge' END AS solver, metric FROM fold_metrics"


def _metrics(t):
    k = F.col("fold") % 3
    return t.fold_metrics.select("task", F.when(k == 0, "random").when(k == 1, "spatial_blocked").otherwise("leave_event_out").alias("split"), F.when(F.col("model_version") < "m3", "histgbdt").otherwise("ridge").alias("solver"), "metric")


DIAG = "SELECT task, avg(metric) FILTER (split = 'random' AND solver = 'histgbdt') AS r, avg(metric) FILTER (split = 'spatial_blocked' AND solver = 'histgbdt') AS s, avg(metric) FILTER (split = 'leave_event_out' AND solver = 'histgbdt') AS l, avg(metric) FILTER (split = 'spatial_blocked' AND solver = 'ridge') AS g FROM met GROUP BY 1"
DR = "SELECT task, 1 - (r - s) / greatest(abs(r), 0.01) AS leak, greatest(0, l / greatest(abs(s), 0.01)) AS transfer, 1 - abs(s - g) / greatest(abs(s), abs(g), 0.01) AS solver FROM dg"


@query("c14_diagnostic_ratios", W("oof", "fold_metrics", met=MET, dg=DIAG, dr=DR) + "SELECT task, round(leak, 7) AS diag_leakage, round(transfer, 7) AS diag_transfer, round(solver, 7) AS diag_solver FROM dr")
def _(t):
    return rnd(G.diagnostic_ratios(_metrics(t), ["task"]), 7, "diag_leakage", "diag_transfer", "diag_solver")


STRICTW = G.Preset("tight", leakage_warn=0.9, solver_warn=0.95)


@query("c15_diagnostic_warnings", W("oof", "fold_metrics", met=MET, dg=DIAG, dr=DR) + "SELECT task, concat_ws(',', CASE WHEN leak > 0.9 THEN 'SPATIAL_BLEED' END, CASE WHEN transfer = 0 THEN 'NO_TRANSFER_SIGNAL' END, CASE WHEN solver < 0.95 THEN 'WEAK_SOLVER' END) AS warnings FROM dr")
def _(t):
    d = G.diagnostic_ratios(_metrics(t), ["task"])
    return d.select("task", F.concat_ws(",", G.diagnostic_warnings(d, STRICTW)).alias("warnings"))


LVL = "SELECT scenario_id, zcta_id, embedding_arm, 'r' || CAST(snapshot_t // 24 AS VARCHAR) AS level, alpha, sigma, kappa_compat, R AS spatial_metric, R, N, s_sup, coherence, kappa_L FROM g"


def _levels(t):
    return _gc(t).select("scenario_id", "zcta_id", "embedding_arm", F.concat(F.lit("r"), F.floor(F.col("snapshot_t") / 24).cast("string")).alias("level"), "alpha", "sigma", "kappa_compat", F.col("R").alias("spatial_metric"), "R", "N", "S_sup", "coherence", "kappa_L", F.lit("p").alias("preset_id"))


CK = ["scenario_id", "zcta_id", "embedding_arm"]
DEC = f"SELECT *, {gate_sql(FLAT)} AS decision FROM lv"


@query("c16_routing_conflicts", W("certificate", g=GC, lv=LVL, d=DEC) + """SELECT scenario_id, zcta_id, embedding_arm, level, decision, admitted, routed, admitted = decision AS admission_replay_match, concat_ws(',', CASE WHEN admitted <> decision THEN 'ADMISSION_REPLAY_MISMATCH' END,
    CASE WHEN decision = 'EXECUTE' AND routed IN ('RE_ENCODE', 'REPAIR') THEN 'ROUTING_OVER_CONSERVATIVE' WHEN decision = 'REPAIR' AND routed = 'REJECT' THEN 'ROUTING_ESCALATION' WHEN routed <> decision THEN 'ROUTING_CONFLICT' END) AS conflicts
    FROM (SELECT scenario_id, zcta_id, embedding_arm, level, decision, CASE WHEN CAST(zcta_id AS INT) % 2 = 0 THEN 'EXECUTE' ELSE 'BLOCK' END AS admitted, CASE CAST(zcta_id AS INT) % 3 WHEN 0 THEN 'REJECT' WHEN 1 THEN 'RE_ENCODE' END AS routed FROM d)""")
def _(t):
    d, keys = G.gate_decision(_levels(t), FLAT), [*CK, "level"]
    z = F.col("zcta_id").cast("int")
    adm = d.select(*keys, F.when(z % 2 == 0, "EXECUTE").otherwise("BLOCK").alias("enforcement_decision"))
    rt = d.select(*keys, F.when(z % 3 == 0, "REJECT").when(z % 3 == 1, "RE_ENCODE").alias("internal_decision"))
    return G.routing_conflicts(d, keys, adm, rt).withColumn("conflicts", F.concat_ws(",", "conflicts"))


TRJ = """SELECT a.scenario_id, a.zcta_id, a.embedding_arm, b.level AS from_level, a.level AS to_level, CASE WHEN a.alpha - b.alpha > 0.02 THEN 'improving' WHEN a.alpha - b.alpha < -0.02 THEN 'regressing' ELSE 'stalled' END AS alpha_trend, CASE WHEN a.sigma - b.sigma > 0.02 THEN 'destabilizing' WHEN a.sigma - b.sigma < -0.02 THEN 'stabilizing' ELSE 'flat' END AS sigma_trend,
    100 * (a.spatial_metric - b.spatial_metric) / b.spatial_metric AS up, a.alpha, a.kappa_compat FROM lv a JOIN lv b ON a.scenario_id = b.scenario_id AND a.zcta_id = b.zcta_id AND a.embedding_arm = b.embedding_arm AND a.level = 'r3' AND b.level = 'r2'"""
CONV = "CASE WHEN up < 0 THEN 'regressing' WHEN abs(up) >= 1 THEN 'active' WHEN alpha >= 0.5 AND kappa_compat >= 0.5 THEN 'healthy_converged' ELSE 'prematurely_stalled' END"


@query("w15_trajectory", W("certificate", g=GC, lv=LVL, tr=TRJ) + f"SELECT scenario_id, zcta_id, embedding_arm, from_level, to_level, alpha_trend, sigma_trend, round(up, 6) AS uplift_pct, {CONV} AS convergence_state, true AS provenance_valid FROM tr")
def _(t):
    return rnd(G.trajectory(_levels(t), CK, FLAT), 6, "uplift_pct")


@query("c17_health_cards", W("certificate", g=GC, lv=LVL, d=DEC, tr=TRJ) + f"""SELECT d.scenario_id, d.zcta_id, d.embedding_arm, d.level, decision, CASE WHEN decision IN ('REJECT', 'BLOCK') OR (decision <> 'EXECUTE' AND alpha_trend = 'regressing') THEN 'critical' WHEN decision <> 'EXECUTE' THEN 'failing'
    WHEN alpha_trend = 'regressing' OR {CONV.replace('alpha >=', 'tr.alpha >=').replace('kappa_compat', 'tr.kappa_compat')} = 'prematurely_stalled' THEN 'warning' ELSE 'healthy' END AS overall_health FROM d LEFT JOIN tr USING (scenario_id, zcta_id, embedding_arm)""")
def _(t):
    return G.health_cards(_levels(t), CK, FLAT).select(*CK, "level", "decision", "overall_health")


WU = "SELECT task, model_version, avg(metric) AS m, stddev_samp(metric) AS sigma, quantile_cont(metric, 0.5) AS med, quantile_cont(metric, 0.75) - quantile_cont(metric, 0.25) AS iqr, avg((metric <= 0)::INT) AS fr, avg((metric <= 0.5)::INT) AS fc FROM fold_metrics GROUP BY 1, 2"
WS = "SELECT task, model_version, 1 / (1 + sigma / abs(m)) AS tau, sigma, CASE WHEN task = 'R' THEN greatest(0, least(1, 2 * (m - 0.5))) ELSE greatest(0, least(1, m)) END AS alpha_warmup, CASE WHEN task = 'R' THEN fc ELSE fr END AS collapse_risk, greatest(0, least(1, 1 - iqr / abs(med))) AS coherence FROM wu"


def _warm(t):
    return G.warmup_signals(t.fold_metrics, ["task", "model_version"], "metric", F.col("task") == "R")


@query("c18_warmup_signals", W("oof", "fold_metrics", wu=WU, ws=WS) + "SELECT task, model_version, round(tau, 7) AS tau, round(sigma, 7) AS sigma, round(alpha_warmup, 7) AS alpha_warmup, round(collapse_risk, 7) AS collapse_risk, round(coherence, 7) AS coherence FROM ws")
def _(t):
    c = ["tau", "sigma", "alpha_warmup", "collapse_risk", "coherence"]
    return rnd(_warm(t).select("task", "model_version", *c), 7, *c)


GEAR = "SELECT ws.*, CASE WHEN collapse_risk > 0.8 THEN -1 WHEN coherence < 0.3 THEN 3 WHEN tau <= b1 THEN 1 WHEN tau <= b2 THEN 2 WHEN tau <= b3 THEN 3 ELSE 4 END AS gear FROM ws, (SELECT quantile_cont(tau, 0.25) AS b1, quantile_cont(tau, 0.5) AS b2, quantile_cont(tau, 0.75) AS b3 FROM ws)"


@query("c18_gear_assignment", W("oof", "fold_metrics", wu=WU, ws=WS, gr=GEAR) + "SELECT task, model_version, gear FROM gr")
def _(t):
    s = _warm(t)
    return G.assign_gear(s, G.gear_boundaries(s)).select("task", "model_version", "gear")


WIDE = "SELECT scenario_id, zcta_id, embedding_arm, " + ", ".join(f"max({c}) FILTER (level = '{l}') AS {l}_{c}" for l in G.LEVELS for c in ("spatial_metric", "kappa_compat", "R", "N", "s_sup", "sigma")) + " FROM lv GROUP BY 1, 2, 3"
BEST = "CASE WHEN r0_spatial_metric >= r1_spatial_metric AND r0_spatial_metric >= r2_spatial_metric THEN 'r0' WHEN r1_spatial_metric >= r2_spatial_metric THEN 'r1' ELSE 'r2' END"
ROUTE = f"""SELECT *, {BEST} AS best, CASE WHEN r0_kappa_compat >= 0.7 THEN 'r0' WHEN r0_s_sup > 0.2 AND r1_kappa_compat >= 0.7 THEN 'r1' WHEN r2_sigma > 0.15 OR r2_kappa_compat < 0.3 THEN NULL ELSE 'r2' END AS arm FROM wide"""


@query("c19_routing_table", W("certificate", g=GC, lv=LVL, wide=WIDE, rt=ROUTE) + """SELECT scenario_id, zcta_id, embedding_arm, 'certificates' AS strategy, best AS recommended_arm, best AS actual_best_arm, true AS correct FROM rt UNION ALL SELECT scenario_id, zcta_id, embedding_arm, 'kappa_first', arm, best, coalesce(arm = best, false) FROM rt""")
def _(t):
    w = G.cells_wide(_levels(t).filter("level <> 'r3'"), CK)
    return G.evaluate_routing(w, CK, {"certificates": G.route_by_certificates(w), "kappa_first": G.route_kappa_first(w)}).select(*CK, "strategy", "recommended_arm", "actual_best_arm", "correct")


@query("c19_routing_hit_rates", W("certificate", g=GC, lv=LVL, wide=WIDE, rt=ROUTE) + "SELECT 'kappa_first' AS strategy, count(*) AS n_cells, count(*) FILTER (arm = best) AS correct_count, round(avg(coalesce(arm = best, false)::INT), 8) AS hit_rate FROM rt")
def _(t):
    w = G.cells_wide(_levels(t).filter("level <> 'r3'"), CK)
    return rnd(G.hit_rates(G.evaluate_routing(w, CK, {"kappa_first": G.route_kappa_first(w)})).drop("near_optimal_rate"), 8, "hit_rate")


GEARED = """SELECT w.*, CAST(zcta_id AS INT) % 6 - 1 AS gear, x.alpha AS aw, x.sigma AS sw FROM rt w LEFT JOIN (SELECT scenario_id, zcta_id, embedding_arm, alpha, sigma FROM lv WHERE level = 'r3') x USING (scenario_id, zcta_id, embedding_arm)"""
HARD = "CASE WHEN r2_R > r2_s_sup AND r2_N < 0.5 THEN 'r2' WHEN r1_R > r1_s_sup AND r1_N < 0.5 THEN 'r1' WHEN r2_kappa_compat < 0.3 THEN NULL ELSE best END"


@query("c19_gear_routing", W("certificate", g=GC, lv=LVL, wide=WIDE, rt=ROUTE, gr=GEARED, o=f"SELECT *, CASE WHEN gear = -1 THEN NULL WHEN gear = 1 AND aw >= 0.3 AND sw <= 0.1 THEN CASE WHEN r0_R > 0.3 THEN 'r0' ELSE best END WHEN gear >= 3 OR aw < 0.1 THEN {HARD} ELSE best END AS rec FROM gr")
       + "SELECT scenario_id, zcta_id, embedding_arm, rec AS recommended_arm, best AS actual_best_arm, coalesce(rec = best, false) AS correct FROM o")
def _(t):
    w = G.cells_wide(_levels(t).filter("level <> 'r3'"), CK)
    gear = _levels(t).filter("level = 'r3'").select(*CK, (F.col("zcta_id").cast("int") % 6 - 1).alias("gear"), F.col("alpha").alias("alpha_warmup"), F.col("sigma").alias("warmup_sigma"), F.lit(0.1).alias("collapse_risk"))
    w = w.join(gear, CK, "left")
    return G.evaluate_routing(w, CK, {"gear_informed": G.route_by_gear(w)}).select(*CK, "recommended_arm", "actual_best_arm", "correct")


TAU = "CASE WHEN omega * alpha + 0.5 * (1 - omega) > 0 THEN 1 / (omega * alpha + 0.5 * (1 - omega)) ELSE 999 END"


@query("c20_block_admission", W("certificate", g=GC, d=f"SELECT *, 1 - s_sup AS omega, {gate_sql(FLAT)} AS decision FROM g", e=f"SELECT *, {TAU} AS tau FROM d") + f"""SELECT {KEY}, decision, round(tau, 7) AS tau, CASE WHEN decision = 'EXECUTE' AND NOT sigma > 0.4 THEN CASE WHEN tau < 1.43 THEN 'headline' WHEN tau < 2.5 THEN 'diagnostic-stabilizer' ELSE 'marginal' END
    WHEN decision = 'EXECUTE' THEN CASE WHEN tau < 2.5 THEN 'diagnostic-stabilizer' ELSE 'marginal' END WHEN decision IN ('RE_ENCODE', 'REPAIR') THEN 'morph-candidate' WHEN decision = 'REJECT' THEN 'rejected' ELSE 'quarantined' END AS admission_tier FROM e""")
def _(t):
    return rnd(G.admission(_gc(t).withColumn("omega", 1 - F.col("S_sup")), FLAT).select(*KEY.split(", "), "decision", "tau", "admission_tier"), 7, "tau")


BLK = f"SELECT l_suppkey AS block, CASE WHEN l_linenumber <= 2 THEN 'block_only' WHEN l_linenumber <= 4 THEN 'full' ELSE 'drop_block' END AS contrast, CASE WHEN l_suppkey % 6 = 0 AND l_linenumber <= 2 THEN NULL ELSE {sql_mean('l_discount', 100)} END AS metric FROM lineitem GROUP BY 1, l_linenumber"
BE = "SELECT block, max(metric) FILTER (contrast = 'block_only') AS i, max(metric) FILTER (contrast = 'full') - max(metric) FILTER (contrast = 'drop_block') AS m FROM b GROUP BY 1"


def _blocks(t):
    b = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("block"), "l_linenumber").agg(exact_mean(F.col("l_discount"), 100).alias("m"))
    ln = F.col("l_linenumber")
    return C.block_evidence(b.select("block", F.when(ln <= 2, "block_only").when(ln <= 4, "full").otherwise("drop_block").alias("contrast"), F.when((F.col("block") % 6 == 0) & (ln <= 2), F.lit(None)).otherwise(F.col("m")).alias("metric")), ["block"])


@query("c29_block_evidence", f"WITH b AS ({BLK}), e AS ({BE}) SELECT block, round(i, 8) AS independent_signal, round(m, 8) AS marginal_signal, CASE WHEN i IS NULL THEN 'INVALID' ELSE 'VALID' END AS certificate_status, CASE WHEN m > 0.001 THEN 'useful' WHEN m < -0.001 THEN 'harmful_or_superfluous' WHEN m IS NOT NULL THEN 'redundant' END AS ablation_interpretation FROM e")
def _(t):
    return rnd(_blocks(t), 8, "independent_signal", "marginal_signal")


@query("c20_invalid_reasons", f"WITH b AS ({BLK}), e AS ({BE}), m AS (SELECT block, CASE WHEN block % 4 = 0 THEN 'STRUCTURAL_NO_FEATURES' WHEN block % 5 = 0 THEN 'SOLVER_BOTH_NULL' ELSE 'SOLVER_PRIMARY_NULL' END AS f FROM e WHERE i IS NULL) SELECT f AS failure_mode, count(*) AS n, count(DISTINCT block) AS n_blocks, CASE f WHEN 'STRUCTURAL_NO_FEATURES' THEN 'check-feature-registry' WHEN 'SOLVER_BOTH_NULL' THEN 'retrain-with-larger-sample' ELSE 'investigate-solver-crash' END AS remediation_action FROM m GROUP BY 1")
def _(t):
    b = F.col("block")
    return G.invalid_reasons(_blocks(t).withColumns({"block_only_valid": b % 4 != 0, "solver_used": F.when(b % 5 != 0, "histgbdt")}))


CON = "SELECT 'c' || CAST(l_linenumber % 5 AS VARCHAR) AS construct, CASE WHEN l_linenumber % 5 <> 4 THEN avg(l_quantity) END AS f, avg(l_discount) * 100 AS s, avg(l_tax) * 100 AS k FROM lineitem GROUP BY l_linenumber % 5"


@query("c21_construct_divergence", f"WITH c AS ({CON}) SELECT a.construct AS construct_a, b.construct AS construct_b, round(sqrt((a.f - b.f) ** 2 + (a.s - b.s) ** 2 + (a.k - b.k) ** 2), 7) AS distance, a.f IS NOT NULL AND b.f IS NOT NULL AS both_available FROM c a JOIN c b ON a.construct < b.construct")
def _(t):
    ln = F.col("l_linenumber") % 5
    c = t.raw("lineitem").groupBy(ln.alias("g")).agg(F.avg("l_quantity").alias("q"), (F.avg("l_discount") * 100).alias("s"), (F.avg("l_tax") * 100).alias("k")).select(F.concat(F.lit("c"), F.col("g").cast("string")).alias("construct"), F.when(F.col("g") != 4, F.col("q")).alias("f"), "s", "k")
    return rnd(C.construct_divergence(c, "construct", ["f", "s", "k"]), 7, "distance")


@query("c21_quadrant_mass", W("units", m="SELECT acct >= (SELECT quantile_cont(acct, 0.5) FROM units) AS a, pop >= (SELECT quantile_cont(pop, 0.5) FROM units) AS b FROM units") + "SELECT count(*) AS n, count(*) FILTER (a AND b) AS high_high, count(*) FILTER (a AND NOT b) AS high_low, count(*) FILTER (NOT a AND b) AS low_high, count(*) FILTER (NOT a AND NOT b) AS low_low, round(count(*) FILTER (a = b) / count(*), 8) AS pct_agreement FROM m")
def _(t):
    return rnd(C.quadrant_mass(t.units, "acct", "pop"), 8, "pct_agreement")


@query("c22_readiness_and_recoverability", W("certificate") + "SELECT certificate_id, CASE WHEN r < 0.45 THEN 'REFUSE' WHEN alpha < 0.65 OR kappa_compat < 0.35 THEN 'CAUTION' ELSE 'EXECUTE' END AS zone, CASE WHEN alpha >= 0.6 AND kappa_compat < 0.33 THEN 'RE_ENCODE' ELSE 'EXECUTE' END AS gate FROM certificate")
def _(t):
    return t.certificate.select("certificate_id", G.readiness_zone("r", "alpha", "kappa_compat", 0.45, 0.65, 0.35).alias("zone"), G.recoverability_gate("alpha", "kappa_compat", 0.6, 0.33).alias("gate"))


@query("c23_reblend", W("certificate") + "SELECT certificate_id, round((1 - s_sup) * alpha + s_sup * 0.5, 8) AS alpha_omega FROM certificate")
def _(t):
    return t.certificate.select("certificate_id", F.round(C.reblend("alpha", 1 - F.col("s_sup")), 8).alias("alpha_omega"))


@query("c23_carry_forward", W("certificate", o="SELECT *, row_number() OVER (PARTITION BY scenario_id, zcta_id, embedding_arm ORDER BY snapshot_t) - 1 AS step FROM certificate").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """, z AS (SELECT scenario_id, zcta_id, embedding_arm, step, (1 - s_sup) * alpha + s_sup * 0.5 AS v FROM o WHERE step = 0
    UNION ALL SELECT o.scenario_id, o.zcta_id, o.embedding_arm, o.step, (1 - s_sup) * alpha + s_sup * z.v FROM z JOIN o ON o.scenario_id = z.scenario_id AND o.zcta_id = z.zcta_id AND o.embedding_arm = z.embedding_arm AND o.step = z.step + 1) SELECT scenario_id, zcta_id, embedding_arm, CAST(step AS INTEGER) AS step, round(v, 8) AS alpha_omega FROM z""")
def _(t):
    c = t.certificate.withColumn("omega", 1 - F.col("s_sup"))
    return rnd(C.carry_forward(c, CK, "snapshot_t", "alpha", "omega"), 8, "alpha_omega").select(*CK, "step", "alpha_omega")


@query("c24_public_projection", W("certificate", g=GC, d=f"SELECT {KEY}, {gate_sql(G.PRESETS['STRICT'])} AS d FROM g") + f"SELECT {KEY}, CASE WHEN d = 'EXECUTE' THEN 'EXECUTE' WHEN d = 'RE_ENCODE' THEN 'CAUTION' ELSE 'REFUSE' END AS public_decision FROM d")
def _(t):
    return G.gate_decision(_gc(t), G.PRESETS["STRICT"]).select(*KEY.split(", "), G.lookup("decision", G.PUBLIC_DECISION, "REFUSE").alias("public_decision"))


SIGNALS = sorted({s for r in G.FAILURE_RANGES.values() for s in r})
SPEC = "VALUES " + ", ".join(f"('{m}', '{s}', {lo}::DOUBLE, {hi}::DOUBLE)" for m, r in G.FAILURE_RANGES.items() for s, (lo, hi) in r.items())


@query("c25_failure_diagnosis", f"""WITH s AS (SELECT p_partkey, [{', '.join(repr(x) for x in SIGNALS)}][i] AS signal, ((p_partkey * i * 7 + p_size) % 101) / 101.0 AS value FROM part CROSS JOIN (SELECT unnest(range(1, {len(SIGNALS) + 1})) AS i)), f(mode, signal, lo, hi) AS ({SPEC}),
    c AS (SELECT p_partkey, mode, avg(greatest(0, 1 - greatest(lo - value, value - hi, 0) / (hi - lo))) AS confidence FROM s JOIN f USING (signal) GROUP BY 1, 2) SELECT p_partkey, mode, round(confidence, 7) AS confidence FROM c QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY confidence DESC, mode) <= 2""")
def _(t):
    names = F.array(*[F.lit(s) for s in SIGNALS])
    s = t.raw("part").select("p_partkey", "p_size", F.posexplode(names).alias("i", "signal")).select("p_partkey", "signal", ((F.col("p_partkey") * (F.col("i") + 1) * 7 + F.col("p_size")) % 101 / 101.0).alias("value"))
    return rnd(G.diagnose_failures(s, "p_partkey", 2), 7, "confidence").select("p_partkey", "mode", "confidence")


@query("c26_trace_process_score", """WITH s AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations), p AS (SELECT conv_id, role AS g, count(*) AS c FROM s GROUP BY 1, 2), q AS (SELECT conv_id, role AS g, count(*) AS c FROM s WHERE n % 3 > 0 GROUP BY 1, 2),
    t AS (SELECT conv_id, count(*) AS np, count(*) FILTER (n % 3 > 0) AS ng, avg((n % 5 > 0)::INT) AS inst, avg((n % 7 > 0)::INT) AS succ FROM s GROUP BY 1), m AS (SELECT p.conv_id, sum(least(p.c, q.c)) AS sh FROM p JOIN q USING (conv_id, g) GROUP BY 1)
    SELECT conv_id, round(inst, 8) AS inst_acc, round(succ, 8) AS tool_call_success_rate, round(coalesce(sh, 0) / greatest(ng, 1), 8) AS tool_acc, round(CASE WHEN coalesce(sh, 0) > 0 THEN 2.0 * sh / (np + ng) ELSE 0 END, 8) AS category_f1 FROM t LEFT JOIN m USING (conv_id)""")
def _(t):
    n = F.length("text")
    plain = t.raw("conversations").select("conv_id", "turn", n.alias("n"), F.struct(F.col("role").alias("tool_name"), F.col("role").alias("tool_group"), F.create_map(F.lit("len"), n.cast("string")).alias("args"), (n % 5 > 0).alias("valid"), (n % 7 > 0).alias("success")).alias("s"))
    by_turn = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("turn", "s"))), lambda a, b: F.when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).otherwise(0)), lambda x: x["s"])
    tr = plain.groupBy("conv_id").agg(by_turn(F.lit(True)).alias("pred"), by_turn(F.col("n") % 3 > 0).alias("gold"))
    c = ["inst_acc", "tool_call_success_rate", "tool_acc", "category_f1"]
    return rnd(G.process_score(tr, "conv_id").select("conv_id", *c), 8, *c)


@query("c26_outcome_gated_score", """WITH f AS (SELECT l_orderkey, l_quantity AS v, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity * (1 + l_discount - 0.05) END AS p, greatest(0.1, 0.03 * l_quantity) AS lam FROM lineitem), s AS (SELECT l_orderkey, avg(coalesce((abs(p - v) <= lam)::INT, 0)) AS h, avg(CASE WHEN p IS NULL THEN 0 WHEN abs(p - v) / lam <= 1 THEN 1 ELSE 2.0 ** (1 - abs(p - v) / lam) END) AS n FROM f GROUP BY 1),
    g AS (SELECT *, CASE l_orderkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.5 ELSE 0.0 END AS k FROM s) SELECT l_orderkey, round(n, 6) AS num_score, round(n * k, 6) AS gated_score, h > 0 AND k = 0 AS lucky_hit FROM g""")
def _(t):
    q = F.col("l_quantity")
    f = t.raw("lineitem").select("l_orderkey", q.alias("value"), F.when(F.col("l_linenumber") != 7, q * (1 + F.col("l_discount") - 0.05)).alias("predicted"), F.lit(0.1).alias("abs_tol"), F.lit(0.03).alias("rel_tol"), F.lit(0.0).alias("floor_scale"))
    k = F.col("l_orderkey") % 5
    o = G.outcome_score(f, "l_orderkey").withColumn("verdict", F.when(k == 0, "PASS").when(k == 1, "WARN").when(k == 2, "ESCALATE").when(k == 3, "FAIL").otherwise("SUPPRESS"))
    return rnd(G.gated_score(o, "verdict"), 6, "num_score", "gated_score").select("l_orderkey", "num_score", "gated_score", "lucky_hit")


@query("c27_residual_classes", W("oof", a="SELECT sample_id, task, fold, abs(y_true - y_pred) AS e FROM oof", q="SELECT task, quantile_cont(e, 1.0/3) AS q1, quantile_cont(e, 2.0/3) AS q2 FROM a WHERE fold > 0 GROUP BY 1") + "SELECT sample_id, CASE WHEN e <= q1 THEN 'R' WHEN e > q2 THEN 'N' ELSE 'S' END AS residual_class FROM a JOIN q USING (task)")
def _(t):
    a = t.oof.withColumn("e", F.abs(F.col("y_true") - F.col("y_pred")))
    return C.residual_classes(a, "e", F.col("fold") > 0, ["task"]).select("sample_id", "residual_class")


@query("c28_ideal_loss", W("oof", l="SELECT zcta, task, model_version, avg(y_true) AS y, avg(y_pred) AS p FROM oof GROUP BY 1, 2, 3", d="SELECT zcta, task, model_version, (y - p) ** 2 AS loss FROM l", e="SELECT *, min(loss) OVER (PARTITION BY zcta, task) AS star FROM d") + "SELECT zcta, task, model_version, round(loss, 6) AS loss, round(star, 6) AS ideal_loss, round(CASE WHEN loss > 1e-12 THEN least(1, star / loss) ELSE 1 END, 5) AS kappa FROM e")
def _(t):
    m = t.oof.groupBy("zcta", "task", "model_version").agg(F.avg("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred"))
    return rnd(rnd(C.ideal_loss(m, ["zcta", "task"], "model_version"), 6, "loss", "ideal_loss"), 5, "kappa")
