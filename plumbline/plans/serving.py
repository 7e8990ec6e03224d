"""Served queries over certificates derived from lineitem."""

from pyspark.sql import functions as F

from plumbline.functions.core import zfill
from plumbline.operators import served as S
from plumbline.plans.assembly import rnd
from plumbline.plans.registry import query
from plumbline.plans.standins import W


def joined(df, *cols):
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in cols})


RC = "SELECT certificate_id, CASE WHEN public_decision = 'EXECUTE' THEN 'CLEAN_EXECUTE' ELSE 'KAPPA_COMPAT_BELOW_KAPPA_REQ' END AS reason_code, 1 AS sort_order FROM certificate UNION ALL SELECT certificate_id, 'N_ABOVE_THRESHOLD', 0 FROM certificate WHERE n > 0.25"


def _rc(t):
    c = t.certificate
    return c.select("certificate_id", F.when(F.col("public_decision") == "EXECUTE", "CLEAN_EXECUTE").otherwise("KAPPA_COMPAT_BELOW_KAPPA_REQ").alias("reason_code"), F.lit(1).alias("sort_order")).union(
        c.filter("n > 0.25").select("certificate_id", F.lit("N_ABOVE_THRESHOLD"), F.lit(0)))


@query("f1_select_event", W("scenarios", "snapshots") + "SELECT s.scenario_id, display_name, anchor_storm, flood_archetype, build_phase, string_agg(CAST(snapshot_t AS VARCHAR), ',' ORDER BY snapshot_t DESC) AS available_snapshots FROM scenarios s JOIN snapshots USING (scenario_id) GROUP BY 1, 2, 3, 4, 5")
def _(t):
    return joined(S.select_event(t.spark, t.scenarios, t.snapshots), "available_snapshots")


@query("f2_select_snapshot", W("certificate", "snapshots") + "SELECT s.scenario_id, s.snapshot_t, count(certificate_id) AS precomputed_cert_count FROM snapshots s LEFT JOIN certificate c ON c.scenario_id = s.scenario_id AND c.snapshot_t = s.snapshot_t GROUP BY 1, 2")
def _(t):
    return S.select_snapshot(t.spark, t.snapshots, t.certificate)


@query("f3_list_zctas", W("certificate", "snapshots", "scenario_zctas", rc=RC) + """SELECT z.scenario_id, n.snapshot_t, z.zcta_id, z.state_fips, z.county_fips, z.huc8_id, c.certificate_id, round(c.r, 8) AS r, round(c.s_sup, 8) AS s_sup, round(c.n, 8) AS n, round(c.alpha, 8) AS alpha, round(c.kappa_compat, 8) AS kappa_compat, round(c.kappa_modal_min, 8) AS kappa_modal_min, round(c.sigma, 8) AS sigma,
    round(c.task_residual_floor, 8) AS task_residual_floor, c.task_residual_floor_unavailable_reason, c.public_decision, c.gate_reached, c.gate_reason, string_agg(reason_code, ',' ORDER BY sort_order) AS reason_codes,
    CASE WHEN c.certificate_id IS NULL THEN 'NOT_COMPUTED' END AS unavailable_reason FROM scenario_zctas z JOIN snapshots n ON n.scenario_id = z.scenario_id LEFT JOIN certificate c ON c.scenario_id = z.scenario_id AND c.zcta_id = z.zcta_id AND c.snapshot_t = n.snapshot_t AND c.embedding_arm = 'graphsage_v1'
    LEFT JOIN rc ON rc.certificate_id = c.certificate_id GROUP BY ALL""")
def _(t):
    d = S.list_zctas(t.spark, t.scenario_zctas, t.snapshots, t.certificate, _rc(t))
    return rnd(joined(d, "reason_codes"), 8, "r", "s_sup", "n", "alpha", "kappa_compat", "kappa_modal_min", "sigma", "task_residual_floor")


@query("f3_session_decisions", W("certificate", "units") + "SELECT 's' AS session_id, certificate_id, scenario_id, public_decision, u.acct AS y_true, u.acct >= CASE WHEN scenario_id = 'storm_A' THEN 3000 ELSE 5000 END AS actually_flooded FROM certificate c LEFT JOIN units u USING (zcta_id) WHERE embedding_arm = 'graphsage_v1'")
def _(t):
    d = S.list_zctas(t.spark, t.scenario_zctas, t.snapshots, t.certificate, _rc(t))
    return S.record_decisions(d, F.lit("s"), t.units.select("zcta_id", F.col("acct").alias("loss")), {"storm_A": 3000.0}, 5000.0).select("session_id", "certificate_id", "scenario_id", "public_decision", "y_true", "actually_flooded")


@query("f4_certificate", W("certificate") + "SELECT certificate_id, round(r, 8) AS r, round(s_sup, 8) AS s_sup, round(n, 8) AS n, public_decision FROM certificate")
def _(t):
    return rnd(S.certificate_detail(t.spark, t.certificate).select("certificate_id", "r", "s_sup", "n", "public_decision"), 8, "r", "s_sup", "n")


@query("f4_reason_codes", W("certificate", rc=RC) + "SELECT certificate_id, reason_code, sort_order FROM rc JOIN certificate USING (certificate_id) WHERE embedding_arm = 'fusion_v1'")
def _(t):
    return S.detail_rows(S.certificate_detail(t.spark, t.certificate, embedding_arm="fusion_v1"), _rc(t))


@query("f4_gate_results", W("certificate") + "SELECT certificate_id, 'GATE_3' AS gate_name, round(kappa_compat, 8) AS active_value, kappa_compat >= 0.36 AS passed FROM certificate WHERE embedding_arm = 'fusion_v1'")
def _(t):
    gr = t.certificate.select("certificate_id", F.lit("GATE_3").alias("gate_name"), F.round("kappa_compat", 8).alias("active_value"), (F.col("kappa_compat") >= 0.36).alias("passed"))
    return S.detail_rows(S.certificate_detail(t.spark, t.certificate, embedding_arm="fusion_v1"), gr)


@query("f4_infrastructure_evidence", W("certificate") + "SELECT certificate_id, 'bayou-' || zcta_id AS bayou_segment_id FROM certificate WHERE scenario_id = 'storm_A' AND embedding_arm = 'fusion_v1'")
def _(t):
    ie = t.certificate.filter("scenario_id = 'storm_A'").select("certificate_id", F.concat(F.lit("bayou-"), "zcta_id").alias("bayou_segment_id"))
    return S.detail_rows(S.certificate_detail(t.spark, t.certificate, embedding_arm="fusion_v1"), ie)


@query("f4_alternative_arms", W("certificate") + "SELECT a.certificate_id, b.embedding_arm, b.public_decision, a.public_decision <> b.public_decision AS would_change_decision FROM certificate a JOIN certificate b USING (scenario_id, snapshot_t, zcta_id) WHERE a.embedding_arm = 'graphsage_v1' AND b.embedding_arm <> a.embedding_arm")
def _(t):
    k = ["scenario_id", "snapshot_t", "zcta_id"]
    c = t.certificate
    own = c.select(*k, "certificate_id", F.col("embedding_arm").alias("own_arm"), F.col("public_decision").alias("own"))
    alt = own.join(c.select(*k, "embedding_arm", "public_decision"), k).filter("embedding_arm <> own_arm").select("certificate_id", "embedding_arm", "public_decision", (F.col("own") != F.col("public_decision")).alias("would_change_decision"))
    return S.detail_rows(S.certificate_detail(t.spark, c, embedding_arm="graphsage_v1"), alt)


@query("f4_source_tags", W("certificate") + "SELECT certificate_id, source_name, md5(certificate_id || source_name) AS etag FROM certificate CROSS JOIN (VALUES ('claims'), ('svi')) v(source_name)")
def _(t):
    tags = t.certificate.withColumn("source_name", F.explode(F.array(F.lit("claims"), F.lit("svi")))).select("certificate_id", "source_name", F.md5(F.concat("certificate_id", "source_name")).alias("etag"))
    return S.detail_rows(S.certificate_detail(t.spark, t.certificate), tags)


SD = W("certificate", "session_decision")


@query("f5_summarize_session", SD.rstrip() + ", c AS (SELECT session_id, count(*) AS t, count(*) FILTER (public_decision = 'EXECUTE') AS e, count(*) FILTER (public_decision = 'EXECUTE' AND actually_flooded) AS f, count(*) FILTER (public_decision = 'EXECUTE' AND NOT actually_flooded) AS d, count(*) FILTER (actually_flooded AND public_decision <> 'EXECUTE') AS m FROM session_decision GROUP BY 1) SELECT session_id, t AS total_zctas, e AS zctas_targeted, f AS zctas_that_flooded, d AS zctas_that_didnt, m AS flooded_zctas_missed, round(f / e, 8) AS precision_at_execute, round(f / (f + m), 8) AS recall_at_execute, round(2 * (f / e) * (f / (f + m)) / (f / e + f / (f + m)), 8) AS f1_at_execute FROM c")
def _(t):
    return rnd(S.summarize_session(t.spark, t.session_decision), 8, "precision_at_execute", "recall_at_execute", "f1_at_execute")


@query("f6_list_scenarios", W("cert_base", "scenarios", "snapshots", "scenario_zctas") + "SELECT s.scenario_id, display_name, anchor_storm, region, flood_archetype, primary_decision, build_phase, total_nfip_claims, round(total_loss_usd, 2) AS total_loss_usd, affected_zctas, peak_extent_km2, fatality_count, n.h AS snapshot_hours, z.k AS in_scope_zcta_count FROM scenarios s JOIN (SELECT scenario_id, string_agg(CAST(snapshot_t AS VARCHAR), ',' ORDER BY snapshot_t DESC) AS h FROM snapshots GROUP BY 1) n USING (scenario_id) JOIN (SELECT scenario_id, count(DISTINCT zcta_id) AS k FROM scenario_zctas GROUP BY 1) z USING (scenario_id)")
def _(t):
    return rnd(joined(S.list_scenarios(t.spark, t.scenarios, t.snapshots, t.scenario_zctas), "snapshot_hours"), 2, "total_loss_usd")


PS = """, p AS (SELECT d.session_id, d.scenario_id, count(DISTINCT d.zcta_id) AS zctas_evaluated, count(*) FILTER (d.public_decision = 'EXECUTE') AS n_execute, count(*) FILTER (d.public_decision = 'CAUTION') AS n_caution, count(*) FILTER (d.public_decision = 'REFUSE') AS n_refuse,
 round(avg(CASE WHEN d.public_decision = 'EXECUTE' THEN d.actually_flooded::INT END), 8) AS precision_at_execute, round(avg(CASE WHEN d.actually_flooded THEN (d.public_decision = 'EXECUTE')::INT END), 8) AS recall_at_execute, round(avg(((d.public_decision = 'EXECUTE') = d.actually_flooded)::INT), 8) AS ground_truth_alignment
 FROM session_decision d JOIN certificate c USING (certificate_id) GROUP BY 1, 2),
 g AS (SELECT d.session_id, d.scenario_id, c.gate_reached AS g, count(*) AS k FROM session_decision d JOIN certificate c USING (certificate_id) WHERE d.public_decision <> 'EXECUTE' GROUP BY 1, 2, 3), m AS (SELECT session_id, scenario_id, arg_min(g, (-k, g)) AS dominant_failure_gate FROM g GROUP BY 1, 2)"""


@query("f7_portfolio_rows", SD.rstrip() + PS + " SELECT p.*, dominant_failure_gate FROM p LEFT JOIN m USING (session_id, scenario_id)")
def _(t):
    return rnd(S.portfolio_rows(t.spark, t.session_decision, t.certificate).drop("core_fields_complete"), 8, "precision_at_execute", "recall_at_execute", "ground_truth_alignment")


@query("f7_summarize_portfolio", SD.rstrip() + PS + " SELECT session_id, count(*) AS scenarios_evaluated, string_agg(scenario_id || ':' || n_execute || ':' || n_caution || ':' || n_refuse, ',' ORDER BY scenario_id) AS per_scenario, true AS schema_fields_identical, 3::BIGINT AS scenarios_available, count(DISTINCT scenario_id) AS scenarios_with_certs FROM p GROUP BY 1")
def _(t):
    d = S.summarize_portfolio(t.spark, t.session_decision, t.certificate, t.scenarios)
    return d.withColumn("per_scenario", F.array_join(F.transform("per_scenario", lambda s: F.concat_ws(":", s["scenario_id"], s["n_execute"].cast("string"), s["n_caution"].cast("string"), s["n_refuse"].cast("string"))), ","))


@query("j18_ablation", W("certificate") + """SELECT c.scenario_id, c.snapshot_t, c.zcta_id, c.embedding_arm, round(c.r, 8) AS r, round(c.s_sup, 8) AS s_sup, round(c.n, 8) AS n, round(c.alpha, 8) AS alpha, round(c.kappa_compat, 8) AS kappa_compat, round(c.kappa_compat - d.kappa_compat, 8) AS kappa_compat_delta, round(c.kappa_modal_min, 8) AS kappa_modal_min,
    round(c.sigma, 8) AS sigma, round(c.task_residual_floor, 8) AS task_residual_floor, c.public_decision, c.gate_reached, c.gate_reason, c.public_decision <> d.public_decision AS would_change_decision, c.live_sensors_used, c.computed_at FROM certificate c JOIN certificate d USING (scenario_id, snapshot_t, zcta_id) WHERE d.embedding_arm = 'graphsage_v1'""")
def _(t):
    return rnd(S.ablation(t.spark, t.certificate), 8, "r", "s_sup", "n", "alpha", "kappa_compat", "kappa_compat_delta", "kappa_modal_min", "sigma", "task_residual_floor")


@query("a26_decision_instability", W("certificate") + "SELECT scenario_id, snapshot_t, count(*) AS total_zctas, count(*) FILTER (b.public_decision <> p.public_decision) AS decision_changes, count(*) FILTER (b.public_decision = 'EXECUTE' AND p.public_decision <> 'EXECUTE') AS execute_to_other, count(*) FILTER (b.public_decision <> 'EXECUTE' AND p.public_decision = 'EXECUTE') AS other_to_execute, round(count(*) FILTER (b.public_decision <> p.public_decision) / count(*), 4) AS instability_rate FROM certificate b JOIN certificate p USING (scenario_id, snapshot_t, zcta_id) WHERE b.embedding_arm = 'graphsage_v1' AND p.embedding_arm = 'fusion_v1' GROUP BY 1, 2")
def _(t):
    return S.instability(t.spark, t.certificate, "fusion_v1")


VEC = """SELECT certificate_id, scenario_id, snapshot_t, zcta_id, CASE public_decision WHEN 'EXECUTE' THEN 'low' WHEN 'CAUTION' THEN 'moderate' ELSE 'high' END AS risk_level, ['trust', 'review', 'escalate', 'suppress'][CAST(zcta_id AS INT) % 4 + 1] AS reliability_action,
    ['high', 'medium', 'low', NULL][CAST(zcta_id AS INT) % 4 + 1] AS population_context, ['high', 'medium', 'low', 'not_applicable', NULL][CAST(zcta_id AS INT) % 5 + 1] AS access_fragility, ['q1', 'q2', 'q3', 'q4', NULL][(CAST(zcta_id AS INT) // 3) % 5 + 1] AS equity_context FROM certificate WHERE embedding_arm = 'graphsage_v1'"""


def _vec(t):
    z = F.col("zcta_id").cast("int")
    pick = lambda i, *v: F.element_at(F.array(*[F.lit(x) for x in v]), i + 1)
    return t.certificate.filter("embedding_arm = 'graphsage_v1'").select(
        "certificate_id", "scenario_id", "snapshot_t", "zcta_id", F.when(F.col("public_decision") == "EXECUTE", "low").when(F.col("public_decision") == "CAUTION", "moderate").otherwise("high").alias("risk_level"),
        pick(z % 4, "trust", "review", "escalate", "suppress").alias("reliability_action"), pick(z % 4, "high", "medium", "low", None).alias("population_context"),
        pick(z % 5, "high", "medium", "low", "not_applicable", None).alias("access_fragility"), pick(F.floor(z / 3).cast("int") % 5, "q1", "q2", "q3", "q4", None).alias("equity_context"))


BY = ["scenario_id", "snapshot_t"]
QUEUE = "SELECT *, row_number() OVER (PARTITION BY scenario_id, snapshot_t ORDER BY CASE risk_level WHEN 'high' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END, CASE equity_context WHEN 'q1' THEN 1 WHEN 'q2' THEN 2 WHEN 'q3' THEN 3 WHEN 'q4' THEN 4 ELSE 5 END, zcta_id) AS pos FROM v WHERE reliability_action <> 'suppress'"


@query("w12_policy_queue", W("certificate", v=VEC, q=QUEUE) + "SELECT scenario_id, snapshot_t, zcta_id, pos AS ordinal_position, CASE reliability_action WHEN 'escalate' THEN 'ESCALATE' WHEN 'review' THEN 'REVIEW' ELSE 'TRUST' END AS operator_verdict FROM q")
def _(t):
    return S.build_queue(_vec(t), BY).select(*BY, "zcta_id", "ordinal_position", "operator_verdict")


def order_sql(fields):
    out = []
    for f in fields:
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.RANK_MAPS[f].items())
        out.append(f"CASE {f} {cases} ELSE 0 END DESC")
    return ", ".join(out) + ", zcta_id"


@query("w13_ranking_conflict", W("certificate", v=VEC) + f"SELECT scenario_id, snapshot_t, zcta_id, a AS rank_first, b AS rank_second, abs(a - b) AS rank_difference FROM (SELECT scenario_id, snapshot_t, zcta_id, row_number() OVER (PARTITION BY scenario_id, snapshot_t ORDER BY {order_sql(S.POLICY_VIEWS['access_restoration'])}) AS a, row_number() OVER (PARTITION BY scenario_id, snapshot_t ORDER BY {order_sql(S.POLICY_VIEWS['equity_stabilization'])}) AS b FROM v WHERE reliability_action <> 'suppress')")
def _(t):
    return S.ranking_conflict(_vec(t), BY, S.POLICY_VIEWS["access_restoration"], S.POLICY_VIEWS["equity_stabilization"])


@query("w14_queue_decisions", W("certificate", v=VEC, q=QUEUE) + "SELECT scenario_id || '-' || CAST(snapshot_t AS VARCHAR) AS policy_view_queue_id, zcta_id, pos AS ordinal_position, public_decision, risk_level, equity_context FROM q JOIN certificate c USING (certificate_id, scenario_id, snapshot_t, zcta_id)")
def _(t):
    v = _vec(t)
    qid = F.concat_ws("-", "scenario_id", F.col("snapshot_t").cast("string")).alias("policy_view_queue_id")
    items = S.build_queue(v, BY).select(qid, "zcta_id", "ordinal_position")
    queue = t.snapshots.select(qid, *BY)
    return S.queue_decisions(queue, items, v, t.certificate).select("policy_view_queue_id", "zcta_id", "ordinal_position", "public_decision", "risk_level", "equity_context")
