"""Decisions on certificates: sequential gates, screening, diagnostics, routing, health cards."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.core import clip, col, ladder, lookup, sigmoid
from plumbline.operators.ranking import quantiles


@dataclass(frozen=True)
class Preset:
    """Gate, diagnostic and trajectory thresholds."""

    preset_id: str
    N_thr: float = 0.50
    alpha_min: float = 0.30
    c_min: float = 0.40
    require_coherence: bool = True
    sigma_thr: float = 0.50
    kappa_base: float = 0.50
    lambda_turbulence: float = 0.40
    epsilon_L: float = 0.05
    steepness: float = 10.0
    sigma_c: float = 0.35
    sigma_tiebreaker: float = 0.40
    kappa_L_min: float = 0.30
    leakage_warn: float = 1.05
    solver_warn: float = 0.50
    residual_spatial_warn: float = 0.40
    collapse_risk_warn: float = 0.40
    coherence_warn: float = 0.30
    trend_delta: float = 0.02
    convergence_uplift_pct: float = 1.0
    converged_alpha_min: float = 0.50
    converged_kappa_min: float = 0.50


# Named threshold sets.
PRESETS = {
    "GEOSPATIAL_CONUS27": Preset("GEOSPATIAL_CONUS27", c_min=0.30, require_coherence=False, kappa_base=0.22, lambda_turbulence=0.0, epsilon_L=0.01, kappa_L_min=0.15),
    "UNIVERSAL": Preset("UNIVERSAL"),
    "STRICT": Preset("STRICT", N_thr=0.35, alpha_min=0.50, c_min=0.50, sigma_thr=0.35, kappa_base=0.60, lambda_turbulence=0.50, epsilon_L=0.03, kappa_L_min=0.50),
}
# Internal decision to public decision.
PUBLIC_DECISION = {"EXECUTE": "EXECUTE", "REJECT": "REFUSE", "BLOCK": "REFUSE", "RE_ENCODE": "CAUTION", "REPAIR": "REFUSE", "WARN": "CAUTION", "FALLBACK": "CAUTION"}
# Routing thresholds.
KAPPA_GOOD, KAPPA_BAD, S_SUP_HIGH, TRANSFER_LOW, SIGMA_HIGH, NEAR_OPTIMAL = 0.7, 0.3, 0.2, 0.5, 0.15, 0.02
WARMUP_ALPHA_HIGH, WARMUP_ALPHA_LOW, WARMUP_SIGMA_STABLE = 0.3, 0.1, 0.10
VERDICT_FACTOR = {"PASS": 1.0, "WARN": 0.8, "ESCALATE": 0.5, "FAIL": 0.0, "SUPPRESS": 0.0}


def kappa_required(sigma, p: Preset) -> Column:
    return F.lit(p.kappa_base) + p.lambda_turbulence * sigmoid(p.steepness * (col(sigma) - p.sigma_c))


def gate_decision(df: DataFrame, p: Preset, prefix: str = "") -> DataFrame:
    """First failing gate decides. Integrity fails when noise and purity both fail; an absent
    coherence blocks only where required; just below the kappa requirement a low sigma forgives;
    an unknown kappa blocks, as does any corner the rules leave open."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    noise = F.coalesce(has("noise_admissibility"), has("N"), F.lit(1.0))
    kappa, sigma, coh = has("kappa_compat"), F.coalesce(has("sigma"), F.lit(0.0)), has("coherence")
    req = kappa_required(sigma, p)
    gray = (kappa >= req - p.epsilon_L) & (kappa < req)
    out = lambda d, g, s: F.struct(F.lit(d).alias("decision"), F.lit(g).alias("gate_reached"), F.lit(s).cast("string").alias("reason"))
    rule = (
        F.when(kappa.isNull(), out("BLOCK", "GATE_3_ADMISSIBILITY", "kappa_unavailable"))
        .when(~(noise < p.N_thr) & ~(F.coalesce(has("alpha"), F.lit(0.0)) >= p.alpha_min), out("REJECT", "GATE_1_INTEGRITY", "N_FLOOR_BREACH"))
        .when(coh.isNull() & F.lit(p.require_coherence), out("BLOCK", "GATE_2_CONSENSUS", "COHERENCE_ABSENT"))
        .when(coh < p.c_min, out("BLOCK", "GATE_2_CONSENSUS", "COHERENCE_BELOW_THRESHOLD"))
        .when(gray & (sigma > p.sigma_tiebreaker), out("RE_ENCODE", "GATE_3_ADMISSIBILITY", "KAPPA_LANDAUER_FAIL"))
        .when((kappa < req) & ~gray, out("RE_ENCODE", "GATE_3_ADMISSIBILITY", "KAPPA_BELOW_REQUIRED"))
        .when(has("kappa_L") < p.kappa_L_min, out("REPAIR", "GATE_4_GROUNDING", "KAPPA_L_BELOW_THRESHOLD"))
        .otherwise(out("EXECUTE", "ALL_PASSED", None))
    )
    return df.withColumn("_g", rule).withColumns({f"{prefix}decision": F.col("_g.decision"), f"{prefix}gate_reached": F.col("_g.gate_reached"), f"{prefix}reason": F.col("_g.reason"), f"{prefix}kappa_req": req, f"{prefix}margin": kappa - req}).drop("_g")


def compare_presets(df: DataFrame, presets: dict[str, Preset]) -> DataFrame:
    """Every certificate under every preset, one row each."""
    frames = [gate_decision(df.withColumn("preset", F.lit(n)), p) for n, p in presets.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def pass_rates(decisions: DataFrame, by: list[str]) -> DataFrame:
    return decisions.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("decision") == "EXECUTE").cast("double")).alias("pass_rate"), F.avg("margin").alias("mean_margin"), F.count_if(F.col("margin") < 0).alias("n_below"))


def quality_level(x) -> Column:
    return ladder(x, [(0.7, "HIGH"), (0.4, "MEDIUM")], "LOW")


def degradation(p: Preset, alpha="alpha", kappa="kappa_compat", sigma="sigma", r="R", n="N") -> Column:
    """Screening class; the order of the tests matters."""
    a, k, s, r, n = col(alpha), F.coalesce(col(kappa), F.lit(0.0)), F.coalesce(col(sigma), F.lit(0.0)), col(r), col(n)
    al, kl = quality_level(a), quality_level(k)
    return (
        F.when(s >= p.coherence_warn, "UNSTABLE").when((n > r) & (a < p.alpha_min), "NOISE_COLLAPSED").when(n > r, "NOISE_DOMINANT")
        .when((al == "LOW") & (kl != "LOW"), "CONTENT_DEGRADATION").when((kl == "LOW") & (al != "LOW"), "GEOMETRY_MISMATCH").when((al == "LOW") & (kl == "LOW"), "TOTAL_FAILURE")
        .when((al == "HIGH") & (kl == "HIGH"), "HEALTHY").otherwise("MILD_CONTENT_ISSUE")
    )


def diagnostic_ratios(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Leakage, transfer and solver ratios from (split, solver, metric) rows."""
    m = lambda split, solver: F.avg(F.when((F.col("split") == split) & (F.col("solver") == solver), F.col("metric")))
    w = metrics.groupBy(*by).agg(m("random", "histgbdt").alias("r"), m("spatial_blocked", "histgbdt").alias("s"), m("leave_event_out", "histgbdt").alias("l"), m("spatial_blocked", "ridge").alias("g"))
    low = lambda *c: F.greatest(*c, F.lit(0.01))
    r, s, l, g = (F.col(c) for c in "rslg")
    return w.select(*by, (1 - (r - s) / low(F.abs(r))).alias("diag_leakage"), F.when(l.isNotNull() & s.isNotNull(), F.greatest(l / low(F.abs(s)), F.lit(0.0))).alias("diag_transfer"),
                    F.when(s.isNotNull() & g.isNotNull(), 1 - F.abs(s - g) / low(F.abs(s), F.abs(g))).alias("diag_solver"))


def with_residual_spatial(diagnostics: DataFrame, moran: DataFrame, by: list[str]) -> DataFrame:
    """Both polarities are kept: ``diag_residual_spatial`` is high when errors do not cluster,
    ``residual_clustering`` is high when they do (the one the warning reads)."""
    m = moran.select(*by, F.col("kappa_spatial").alias("diag_residual_spatial"), (1 - F.col("kappa_spatial")).alias("residual_clustering"))
    return diagnostics.join(m, by, "left")


def diagnostic_warnings(df: DataFrame, p: Preset) -> Column:
    """Array of warning names; columns that are absent raise none, except a missing transfer signal."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    rules = [
        ("SPATIAL_BLEED", has("diag_leakage") > p.leakage_warn), ("NO_TRANSFER_SIGNAL", has("diag_transfer").isNull() | (has("diag_transfer") == 0)),
        ("WEAK_SOLVER", has("diag_solver") < p.solver_warn), ("UNEXPLAINED_SPATIAL_PATTERN", has("residual_clustering") > p.residual_spatial_warn),
        ("COLLAPSE_RISK", has("collapse_risk") >= p.collapse_risk_warn), ("LOW_COHERENCE", has("warmup_coherence") < p.coherence_warn),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))


def trajectory(certs: DataFrame, by: list[str], p: Preset, level: str = "level") -> DataFrame:
    """Last step of each cell over its levels: trends, uplift and convergence."""
    one = W.partitionBy(*by)
    w = one.orderBy(level)
    prev = {c: F.lag(c).over(w).alias(f"p_{c}") for c in (level, "alpha", "sigma", "spatial_metric")}
    s = certs.select(*by, level, "alpha", "sigma", "kappa_compat", "spatial_metric", "preset_id", F.lead(level).over(w).alias("_next"), *prev.values(), F.min("preset_id").over(one).alias("_pa"), F.max("preset_id").over(one).alias("_pb"))
    s = s.filter(F.col("_next").isNull() & F.col(f"p_{level}").isNotNull())
    step = lambda c, up, down, flat: F.when(F.col(c) - F.col(f"p_{c}") > p.trend_delta, up).when(F.col(c) - F.col(f"p_{c}") < -p.trend_delta, down).otherwise(flat)
    valid = F.col("_pa") == F.col("_pb")
    uplift = F.when(F.col("p_spatial_metric") > 0, 100.0 * (F.col("spatial_metric") - F.col("p_spatial_metric")) / F.col("p_spatial_metric")).otherwise(0.0)
    conv = (F.when(uplift < 0, "regressing").when(F.abs(uplift) >= p.convergence_uplift_pct, "active")
            .when((F.col("alpha") >= p.converged_alpha_min) & (F.col("kappa_compat") >= p.converged_kappa_min), "healthy_converged").otherwise("prematurely_stalled"))
    known = lambda e: F.when(valid, e).otherwise("unknown")
    return s.select(*by, F.col(f"p_{level}").alias("from_level"), F.col(level).alias("to_level"), known(step("alpha", "improving", "regressing", "stalled")).alias("alpha_trend"),
                    known(step("sigma", "destabilizing", "stabilizing", "flat")).alias("sigma_trend"), F.when(valid, uplift).alias("uplift_pct"), known(conv).alias("convergence_state"), valid.alias("provenance_valid"))


def routing_conflicts(cells: DataFrame, by: list[str], admission: DataFrame, routed: DataFrame) -> DataFrame:
    """Replay against the admission table and the routed decision."""
    d = cells.select(*by, "decision").join(admission.select(*by, F.col("enforcement_decision").alias("admitted")), by, "left").join(routed.select(*by, F.col("internal_decision").alias("routed")), by, "left")
    g, r = F.col("decision"), F.col("routed")
    kind = F.when((g == "EXECUTE") & r.isin("RE_ENCODE", "REPAIR"), "ROUTING_OVER_CONSERVATIVE").when((g == "REPAIR") & (r == "REJECT"), "ROUTING_ESCALATION").when(r != g, "ROUTING_CONFLICT")
    return d.withColumns({"admission_replay_match": F.col("admitted") == g, "conflicts": F.array_compact(F.array(F.when(F.col("admitted") != g, "ADMISSION_REPLAY_MISMATCH"), kind))})


NEXT_STEP = {
    "SPATIAL_BLEED": "leave one block out to find the leaking feature group", "COLLAPSE_RISK": "check the target's variance and the features' signal", "LOW_COHERENCE": "check the spatial split",
    "WEAK_SOLVER": "try stronger features or another solver", "UNEXPLAINED_SPATIAL_PATTERN": "add spatial lag features",
}


def health_cards(certs: DataFrame, by: list[str], p: Preset, diagnostics: DataFrame | None = None, conflicts: DataFrame | None = None, level: str = "level") -> DataFrame:
    """One card per cell and level: critical > failing > warning > healthy, with next steps."""
    c = gate_decision(certs, p).withColumn("degradation", degradation(p))
    c = c.join(trajectory(certs, by, p, level).select(*by, "alpha_trend", "sigma_trend", "convergence_state"), by, "left")
    if diagnostics is not None:
        c = c.join(diagnostics.select(*by, level, "warnings"), [*by, level], "left")
    if conflicts is not None:
        c = c.join(conflicts.select(*by, "conflicts"), by, "left")
    arr = lambda n: F.coalesce(F.col(n), F.array().cast("array<string>")) if n in c.columns else F.array().cast("array<string>")
    c = c.withColumns({"warnings": arr("warnings"), "conflicts": arr("conflicts")})
    failed, regress, stall = F.col("decision") != "EXECUTE", F.coalesce(F.col("alpha_trend") == "regressing", F.lit(False)), F.coalesce(F.col("convergence_state") == "prematurely_stalled", F.lit(False))
    warned, torn = F.size("warnings") > 0, F.size("conflicts") > 0
    health = F.when(F.col("decision").isin("REJECT", "BLOCK") | (failed & (regress | warned)), "critical").when(failed, "failing").when(warned | regress | stall | torn, "warning").otherwise("healthy")
    gate_step = F.when(F.col("decision") == "REJECT", "noise floor and purity both failed").when(F.col("decision") == "BLOCK", "folds disagree; check split and sample size").when(F.col("decision") == "RE_ENCODE", "kappa below requirement").when(F.col("decision") == "REPAIR", "grounding below threshold")
    extra = F.array_compact(F.array(gate_step, F.when(stall, "stalled early; the feature ladder is not enough"), F.when(regress, "the last level made quality worse"), F.when(F.col("sigma_trend") == "destabilizing", "instability grows across levels")))
    steps = F.concat("conflicts", extra, F.array_compact(F.transform("warnings", lambda w: lookup(w, NEXT_STEP))))
    return c.select(*by, level, "decision", "gate_reached", "reason", "degradation", "alpha_trend", "convergence_state", "warnings", "conflicts", health.alias("overall_health"), steps.alias("next_steps"))


# ---- gears and routing -------------------------------------------------------------------------

def warmup_signals(folds: DataFrame, by: list[str], metric: str, classification: Column) -> DataFrame:
    """Per-cell quality signals from fold metrics; cells with fewer than two folds drop out.
    Coherence here is 1 - IQR / |median| (the certificate's uses the range)."""
    m = F.col(metric)
    g = folds.filter(m.isNotNull()).groupBy(*by).agg(F.avg(metric).alias("mean_metric"), F.stddev_samp(metric).alias("sigma"), F.percentile(metric, 0.25).alias("_q1"), F.percentile(metric, 0.5).alias("_med"), F.percentile(metric, 0.75).alias("_q3"),
                                                     F.avg((m <= 0.0).cast("double")).alias("_fr"), F.avg((m <= 0.5).cast("double")).alias("_fc"), F.count(F.lit(1)).alias("n_folds")).filter("n_folds >= 2")
    cls = classification
    mean, sd = F.col("mean_metric"), F.col("sigma")
    tau = F.when(F.abs(mean) > 1e-12, 1 / (1 + sd / F.abs(mean))).when(sd > 1e-12, 0.0).otherwise(1.0)
    coh = F.when(F.abs("_med") > 1e-12, clip(1 - (F.col("_q3") - F.col("_q1")) / F.abs("_med"), 0, 1)).otherwise(0.0)
    return g.select(*by, tau.alias("tau"), "sigma", F.when(cls, clip(2 * (mean - 0.5), 0, 1)).otherwise(clip(mean, 0, 1)).alias("alpha_warmup"), F.when(cls, F.col("_fc")).otherwise(F.col("_fr")).alias("collapse_risk"), coh.alias("coherence"), "mean_metric", "n_folds")


def gear_boundaries(signals: DataFrame, min_samples: int = 8, gap: float = 1e-6) -> DataFrame:
    """Quartile boundaries of tau, forced apart; null boundaries below ``min_samples`` cells."""
    q = quantiles(signals, [], "tau", {"b1": 0.25, "b2": 0.5, "b3": 0.75, "lo": 0.01, "hi": 0.99})
    ok = (F.col("b1") < F.col("b2")) & (F.col("b2") < F.col("b3"))
    eps = max(gap, 1e-3)
    b1, b2, b3 = F.when(ok, F.col("b1")).otherwise(F.col("b2") - 2 * eps), F.col("b2"), F.when(ok, F.col("b3")).otherwise(F.col("b2") + 2 * eps)
    b2 = F.greatest(b2, b1 + gap)
    enough = F.col("n_values") >= min_samples
    return q.select(F.col("n_values").alias("n_samples"), enough.alias("calibrated"), F.when(enough, b1).alias("b1"), F.when(enough, b2).alias("b2"), F.when(enough, F.greatest(b3, b2 + gap)).alias("b3"), F.col("lo").alias("winsor_lo"), F.col("hi").alias("winsor_hi"))


def assign_gear(signals: DataFrame, bounds: DataFrame) -> DataFrame:
    """Collapse and low coherence override; otherwise tau against the boundaries (or defaults)."""
    b = bounds.select(F.struct("b1", "b2", "b3")).scalar()
    t = F.col("tau")
    s = signals.withColumn("_b", b)
    by_tau = F.when(t <= F.col("_b.b1"), 1).when(t <= F.col("_b.b2"), 2).when(t <= F.col("_b.b3"), 3).otherwise(4)
    plain = F.when(t < 1.0, 1).when(t < 1.43, 2).when(t < 2.5, 3).otherwise(4)
    gear = F.when(F.col("collapse_risk") > 0.8, -1).when(F.col("coherence") < 0.3, 3).when(F.col("_b.b1").isNull(), plain).otherwise(by_tau)
    names = {-1: "REVERSE", 1: "FIRST", 2: "SECOND", 3: "THIRD", 4: "FOURTH"}
    return s.withColumn("gear", gear).withColumn("gear_name", lookup("gear", names)).drop("_b")


LEVELS = ("r0", "r1", "r2")


def cells_wide(certs: DataFrame, by: list[str], level: str = "level") -> DataFrame:
    """One row per cell with a struct column per level (null where the level is missing)."""
    f = [c for c in ("spatial_metric", "kappa_compat", "R", "S_sup", "N", "sigma", "diag_transfer") if c in certs.columns]
    return certs.groupBy(*by).agg(*[F.max(F.when(F.col(level) == l, F.struct(*f))).alias(l) for l in LEVELS])


def _field(df: DataFrame, level: str, name: str, default: float) -> Column:
    known = name in df.schema[level].dataType.fieldNames()
    return F.coalesce(F.col(level)[name], F.lit(default)) if known else F.lit(default)


def _arm(arm: str | None, decision: str) -> Column:
    return F.struct(F.lit(arm).cast("string").alias("arm"), F.lit(decision).alias("decision"))


def best_arm(df: DataFrame) -> Column:
    """Level with the best spatial metric; the lower level on equal values."""
    opts = F.filter(F.array(*[F.struct((-F.col(l)["spatial_metric"]).alias("k"), F.lit(l).alias("l")) for l in LEVELS]), lambda s: s["k"].isNotNull())
    return F.array_min(opts)["l"]


def route_by_certificates(df: DataFrame) -> Column:
    b = best_arm(df)
    return F.when(b.isNull(), _arm("r0", "FALLBACK")).when(b == "r0", _arm("r0", "EXECUTE")).when(b == "r1", _arm("r1", "RE_ENCODE")).otherwise(_arm("r2", "RE_ENCODE"))


def route_kappa_first(df: DataFrame) -> Column:
    v = lambda l, n, d: _field(df, l, n, d)
    there = lambda l: F.col(l).isNotNull()
    return (
        F.when(there("r0") & (v("r0", "kappa_compat", 0) >= KAPPA_GOOD), _arm("r0", "EXECUTE"))
        .when(there("r0") & (v("r0", "S_sup", 0) > S_SUP_HIGH) & there("r1") & (v("r1", "kappa_compat", 0) >= KAPPA_GOOD), _arm("r1", "RE_ENCODE"))
        .when((v("r1", "diag_transfer", 1.0) < TRANSFER_LOW) & there("r2") & (v("r2", "kappa_compat", 0) >= KAPPA_GOOD), _arm("r2", "RE_ENCODE"))
        .when(there("r2") & (v("r2", "sigma", 0) > SIGMA_HIGH), _arm(None, "REPAIR")).when(there("r2") & (v("r2", "kappa_compat", 0) < KAPPA_BAD), _arm(None, "REJECT"))
        .when(there("r2"), _arm("r2", "WARN")).when(there("r1"), _arm("r1", "FALLBACK")).otherwise(_arm("r0", "FALLBACK"))
    )


def route_by_gear(df: DataFrame) -> Column:
    """``df`` also holds gear, alpha_warmup, sigma and collapse_risk of the cell's warm-up."""
    v = lambda l, n, d: _field(df, l, n, d)
    gear, a, s = F.coalesce("gear", F.lit(2)), F.coalesce("alpha_warmup", F.lit(0.0)), F.coalesce("warmup_sigma", F.lit(1.0))
    compare = route_by_certificates(df)
    strong = lambda l: F.col(l).isNotNull() & (v(l, "R", 0) > v(l, "S_sup", 1.0)) & (v(l, "N", 1.0) < 0.5)
    easy = F.when(F.col("r0").isNotNull() & (v("r0", "R", 0) > 0.3), _arm("r0", "EXECUTE")).otherwise(compare)
    hard = F.when(strong("r2"), _arm("r2", "RE_ENCODE")).when(strong("r1"), _arm("r1", "RE_ENCODE")).when(F.col("r2").isNotNull() & (v("r2", "kappa_compat", 0) < KAPPA_BAD), _arm(None, "REJECT")).otherwise(compare)
    return (F.when((gear == -1) | (F.coalesce("collapse_risk", F.lit(0.0)) > 0.8), _arm(None, "REPAIR")).when((gear == 1) & (a >= WARMUP_ALPHA_HIGH) & (s <= WARMUP_SIGMA_STABLE), easy)
            .when((gear >= 3) | (a < WARMUP_ALPHA_LOW), hard).otherwise(compare))


def evaluate_routing(df: DataFrame, by: list[str], strategies: dict[str, Column]) -> DataFrame:
    """Recommended against actually best arm, one row per cell and strategy."""
    rows = F.array(*[F.struct(F.lit(n).alias("strategy"), s.alias("r")) for n, s in strategies.items()])
    metric = lambda arm: F.coalesce(*[F.when(arm == l, F.col(l)["spatial_metric"]) for l in LEVELS])
    d = df.withColumn("actual_best_arm", best_arm(df)).withColumn("_s", F.explode(rows))
    arm, best = F.col("_s.r.arm"), F.col("actual_best_arm")
    hit = F.coalesce(arm == best, F.lit(False))
    near = hit | F.coalesce(F.abs(metric(best) - metric(arm)) <= NEAR_OPTIMAL, F.lit(False))
    return d.select(*by, F.col("_s.strategy").alias("strategy"), arm.alias("recommended_arm"), F.col("_s.r.decision").alias("internal_decision"), lookup(F.col("_s.r.decision"), PUBLIC_DECISION, "REFUSE").alias("public_decision"), "actual_best_arm", hit.alias("correct"), near.alias("near_optimal"))


def hit_rates(routed: DataFrame) -> DataFrame:
    share = lambda c: F.avg(F.col(c).cast("double"))
    return routed.groupBy("strategy").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if("correct").alias("correct_count"), share("correct").alias("hit_rate"), share("near_optimal").alias("near_optimal_rate"))


def admission(certs: DataFrame, p: Preset, prior: float = 0.5, sigma_warning: float = 0.40) -> DataFrame:
    """Tier of a block certificate from its gate decision, gear and sigma warning.

    tau = 1 / (omega alpha + (1 - omega) prior). The gear's tau cuts are the published defaults
    (1, 1.43, 2.5); a sigma warning raises the action one step."""
    d = gate_decision(certs, p)
    ao = F.coalesce("omega", F.lit(1.0)) * F.col("alpha") + prior * (1 - F.coalesce("omega", F.lit(1.0)))
    tau = F.when(ao > 0, 1 / ao).otherwise(999.0)
    gear = F.when(tau < 1.0, "FIRST").when(tau < 1.43, "SECOND").when(tau < 2.5, "THIRD").otherwise("FOURTH")
    v = tau * F.coalesce("sigma", F.lit(0.0))
    advisory = F.when(v < 0.2, "FIRST").when(v < 0.5, "SECOND").when(v < 1.0, "THIRD").when(v < 1.5, "FOURTH").otherwise("REVERSE")
    d = d.withColumns({"tau": tau, "gear": gear, "lyapunov_v": v, "lyapunov_gear": advisory, "sigma_warning": F.coalesce(F.col("sigma") > sigma_warning, F.lit(False))})
    g, ok = F.col("gear"), F.col("decision") == "EXECUTE"
    tier = (F.when(ok & ~F.col("sigma_warning"), F.when(g.isin("FIRST", "SECOND"), "headline").when(g == "THIRD", "diagnostic-stabilizer").otherwise("marginal"))
            .when(ok, F.when(g.isin("FIRST", "SECOND", "THIRD"), "diagnostic-stabilizer").otherwise("marginal"))
            .otherwise(lookup("decision", {"RE_ENCODE": "morph-candidate", "REPAIR": "morph-candidate", "REJECT": "rejected", "BLOCK": "quarantined", "FALLBACK": "fallback"}, "unknown")))
    return d.withColumns({"admission_tier": tier, "gear_agreement": g == F.col("lyapunov_gear")})


def invalid_reasons(blocks: DataFrame) -> DataFrame:
    """Why block certificates are invalid, with the remedy, counted."""
    mode = (F.when(~F.coalesce("block_only_valid", F.lit(False)), "STRUCTURAL_NO_FEATURES").when(F.col("independent_signal").isNull() & F.col("solver_used").isNull(), "SOLVER_BOTH_NULL")
            .when(F.col("independent_signal").isNull(), "SOLVER_PRIMARY_NULL").otherwise("UNKNOWN"))
    fix = {"STRUCTURAL_NO_FEATURES": "check-feature-registry", "SOLVER_BOTH_NULL": "retrain-with-larger-sample", "SOLVER_PRIMARY_NULL": "investigate-solver-crash", "UNKNOWN": "investigate"}
    bad = blocks.filter(F.col("certificate_status") == "INVALID").withColumn("failure_mode", mode)
    return bad.groupBy("failure_mode").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("block").alias("n_blocks")).withColumn("remediation_action", lookup("failure_mode", fix))


def readiness_zone(r2, silhouette, kappa_geom, r_min=0.3, s_min=0.4, k_min=0.7) -> Column:
    return F.when(col(r2) < r_min, "REFUSE").when((col(silhouette) < s_min) | (col(kappa_geom) < k_min), "CAUTION").otherwise("EXECUTE")


def recoverability_gate(forward, reconstruct, forward_floor=0.0, reconstruct_floor=0.3) -> Column:
    return F.when((col(forward) >= forward_floor) & (col(reconstruct) < reconstruct_floor), "RE_ENCODE").otherwise("EXECUTE")


# ---- failure diagnosis and trace scoring ---------------------------------------------------------

# Expected signal ranges per failure mode.
FAILURE_RANGES = {
    "tercile_uniformity": {"label_entropy": (0.85, 1.0), "prediction_entropy": (0.8, 1.0), "delta_structure": (0.0, 0.25), "noisy_control_similarity": (0.7, 1.0), "aggregate_separation": (0.0, 0.35)},
    "label_solver_coupling": {"solver_label_dependence": (0.65, 1.0), "cross_solver_label_agreement": (0.0, 0.45), "delta_structure": (0.35, 0.8), "target_variance": (0.3, 0.75), "aggregate_separation": (0.25, 0.65)},
    "target_difficulty_conflation": {"trf_correlation": (0.6, 1.0), "target_variance": (0.55, 1.0), "cross_solver_label_agreement": (0.5, 1.0), "solver_label_dependence": (0.0, 0.45), "delta_structure": (0.25, 0.65)},
    "scalar_projection": {"alpha_rank_gap": (0.6, 1.0), "sigma_outlier": (0.6, 1.0), "kappa_compression": (0.2, 0.65), "gate_entropy": (0.0, 0.35), "aggregate_separation": (0.35, 0.85)},
    "gate_compression": {"all_execute_rate": (0.85, 1.0), "gate_entropy": (0.0, 0.2), "metric_range": (0.35, 1.0), "kappa_compression": (0.3, 0.8), "false_execute_risk": (0.45, 1.0)},
    "range_compression": {"serious_solver_range": (0.0, 0.3), "native_tightness": (0.65, 1.0), "kappa_compression": (0.55, 1.0), "aggregate_separation": (0.15, 0.55), "fine_routing_accuracy": (0.0, 0.45)},
    "target_solver_conflation": {"alpha_profile_corr": (0.0, 0.35), "target_variance": (0.5, 1.0), "solver_specificity": (0.5, 1.0), "trf_correlation": (0.35, 0.85), "fine_routing_accuracy": (0.0, 0.45)},
    "proxy_calibration_drift": {"kappa_compression": (0.55, 1.0), "proxy_success_corr": (0.0, 0.35), "noisy_control_similarity": (0.55, 1.0), "false_execute_risk": (0.45, 1.0), "gate_entropy": (0.0, 0.4)},
    "fine_routing_failure": {"fine_routing_accuracy": (0.0, 0.4), "serious_solver_range": (0.0, 0.35), "solver_specificity": (0.25, 0.75), "native_tightness": (0.55, 1.0), "gate_entropy": (0.0, 0.4)},
}


def diagnose_failures(signals: DataFrame, key: str, top_k: int = 3, specs: dict = FAILURE_RANGES) -> DataFrame:
    """(key, signal, value) rows scored against every failure mode; the best ``top_k`` per key.

    The modes of a key are columns of one aggregate and are ordered inside its row, so rows are not multiplied by modes and nothing is sorted over rows."""
    v = F.col("value")
    off = lambda lo, hi: F.greatest(F.lit(lo) - v, v - F.lit(hi), F.lit(0.0)) / F.greatest(F.lit(hi) - F.lit(lo), F.lit(1e-6))
    score = lambda ranges: F.coalesce(*[F.when(F.col("signal") == s, F.greatest(1 - off(lo, hi), F.lit(0.0))) for s, (lo, hi) in ranges.items()])
    modes = [m for m in sorted(specs) if specs[m]]
    aggs = [e for i, m in enumerate(modes) for e in (F.avg(score(specs[m])).alias(f"_c{i}"), F.count(score(specs[m])).alias(f"_n{i}"))]
    g = signals.filter(v.isNotNull()).groupBy(key).agg(*aggs)
    cells = F.array(*[F.struct(F.col(f"_c{i}").alias("confidence"), F.lit(-i).alias("i"), F.lit(m).alias("mode"), F.col(f"_n{i}").alias("n")) for i, m in enumerate(modes)])
    best = F.slice(F.sort_array(F.filter(cells, lambda c: c["n"] > 0), asc=False), 1, top_k)  # larger confidence first, then mode
    return g.select(key, F.posexplode(best).alias("_k", "_m")).select(key, F.col("_m.mode").alias("mode"), F.col("_m.confidence").alias("confidence"), F.col("_m.n").alias("n_signals"), (F.col("_k") + 1).alias("rank"))


@F.pandas_udf(T.IntegerType())
def lcs_length(first: pd.Series, second: pd.Series) -> pd.Series:
    """Longest common subsequence of two label arrays (traces of a few dozen steps)."""
    out = []
    for a, b in zip(first, second):
        row = [0] * (len(b) + 1)
        for x in a:
            diag = 0
            for j, y in enumerate(b, 1):
                diag, row[j] = row[j], diag + 1 if x == y else max(row[j], row[j - 1])
        out.append(row[-1])
    return pd.Series(out, dtype="int32")


def process_score(traces: DataFrame, key: str, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Trace against gold trace; both are arrays of (tool_name, tool_group, args, valid, success)."""
    t = traces.select(key, F.transform(pred, lambda s: s["tool_group"]).alias("pg"), F.transform(gold, lambda s: s["tool_group"]).alias("gg"), F.col(pred).alias("p"), F.col(gold).alias("g"))
    np_, ng = F.greatest(F.size("pg"), F.lit(1)), F.greatest(F.size("gg"), F.lit(1))
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    shared = F.aggregate(F.array_intersect("pg", "gg"), F.lit(0), lambda s, x: s + F.least(count("pg", x), count("gg", x)))
    rate = lambda f: F.size(F.filter("p", lambda s: s[f])) / np_
    t = t.withColumns({"shared": shared, "inst_acc": rate("valid"), "tool_call_success_rate": rate("success"), "lcs": lcs_length("pg", "gg")})
    prec, rec = F.col("shared") / np_, F.col("shared") / ng
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    order = (F.size(F.array_intersect("pg", "gg")) / F.greatest(F.size(F.array_distinct("gg")), F.lit(1)) + F.col("shared") / F.greatest(F.size("pg"), F.size("gg"), F.lit(1)) + F.col("lcs") / ng) / 3
    # the i-th call of a tool meets the i-th gold call of the same tool
    rank = lambda arr: F.transform(arr, lambda s, i: F.struct(s["tool_name"].alias("t"), F.size(F.filter(F.slice(arr, 1, i), lambda x: x["tool_name"] == s["tool_name"])).alias("k"), s["args"].alias("a")))
    t = t.withColumns({"pr": rank(F.col("p")), "gr": rank(F.col("g"))})
    pairs = F.flatten(F.transform("pr", lambda x: F.transform(F.filter("gr", lambda y: (y["t"] == x["t"]) & (y["k"] == x["k"])), lambda y: F.struct(x["a"].alias("x"), y["a"].alias("y")))))

    def arg(z: Column) -> Column:
        kx, ky = F.map_keys(z["x"]), F.map_keys(z["y"])
        both = F.array_intersect(kx, ky)
        same = F.size(F.filter(both, lambda k: F.element_at(z["x"], k) == F.element_at(z["y"], k)))
        return (F.size(both) / F.greatest(F.size(F.array_union(kx, ky)), F.lit(1)) + same / F.greatest(F.size(both), F.lit(1))) / 2

    t = t.withColumn("args", F.transform(pairs, arg))
    acc = F.aggregate("args", F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size("args"), F.lit(1))
    t = t.select(key, "inst_acc", "tool_call_success_rate", rec.alias("tool_acc"), f1.alias("category_f1"), acc.alias("arg_acc"), order.alias("order_score"))
    total = 0.30 * F.col("tool_acc") + 0.15 * F.col("inst_acc") + 0.20 * F.col("arg_acc") + 0.15 * F.col("category_f1") + 0.15 * F.col("order_score") + 0.05 * F.col("tool_call_success_rate")
    return t.withColumn("tool_use_score", total)


def outcome_score(fields: DataFrame, key: str) -> DataFrame:
    """Rows (key, value, predicted, abs_tol, rel_tol, floor_scale) to hit share and soft score."""
    lam = F.greatest("abs_tol", F.col("rel_tol") * F.abs("value"), "floor_scale")
    lam = F.when(lam > 0, lam).otherwise(1e-9)
    ratio = F.abs(F.col("predicted") - F.col("value")) / lam
    hit = F.coalesce((F.abs(F.col("predicted") - F.col("value")) <= lam).cast("double"), F.lit(0.0))
    soft = F.coalesce(F.when(ratio <= 1, 1.0).otherwise(F.pow(F.lit(2.0), -(ratio - 1))), F.lit(0.0))
    soft = F.when(F.col("predicted").isNull(), 0.0).otherwise(soft)
    return fields.groupBy(key).agg(F.avg(hit).alias("hit_at_tol"), F.avg(soft).alias("num_score"))


def gated_score(outcomes: DataFrame, verdict: str) -> DataFrame:
    """Outcome times the verdict's factor; a hit under a refused verdict is a lucky one."""
    f = lookup(F.upper(F.coalesce(F.col(verdict), F.lit("FAIL"))), VERDICT_FACTOR, 0.0)
    return outcomes.withColumns({"gated_score": F.col("num_score") * f, "lucky_hit": (F.col("hit_at_tol") > 0) & (f == 0)})
