"""From predictions and fold metrics to certificates: simplex, stability, floors, blends, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.core import clip, col, div
from plumbline.operators.aggregate import r_squared
from plumbline.operators.ranking import quantiles
from plumbline.operators.resample import block_bootstrap_r2, percentile_ci

# Fixed values.
FLOOR_WEIGHT, MAX_WEIGHT_SHARE = 0.05, 0.60
CORRELATION_FLAG = 0.80


def simplex_from_metrics(spatial, random, task_type) -> dict[str, Column]:
    """R, S_sup, N from the honest and the random-split metric; no metric means all noise."""
    s, r, cls = col(spatial), col(random), col(task_type) == "classification"
    rel = F.when(s.isNull(), 0.0).otherwise(clip(F.when(cls, 2.0 * (s - 0.5)).otherwise(s), 0, 1))
    gap = r - s
    sup = F.when((gap > 0) & (r > 0), clip(gap / F.greatest(F.abs(r), F.lit(0.01)), F.lit(0.0), 1 - rel)).otherwise(0.0)
    return {"R": rel, "S_sup": sup, "N": F.when(s.isNull(), 1.0).otherwise(clip(1 - rel - sup, 0, 1))}


def simplex_from_scores(r, s, n) -> dict[str, Column]:
    tot = col(r) + col(s) + col(n)
    part = lambda x: F.when(tot < 1e-12, 1 / 3).otherwise(div(x, tot))
    return {"R": part(r), "S": part(s), "N": part(n)}


def simplex_distance(a: list[str], b: list[str]) -> Column:
    return F.sqrt(sum(((col(x) - col(y)) ** 2 for x, y in zip(a, b)), F.lit(0.0)))


def derived_signals(r="R", s="S_sup", n="N") -> dict[str, Column]:
    r, s, n = col(r), col(s), col(n)
    return {"alpha": F.coalesce(div(r, r + n), F.lit(0.0)), "omega": 1 - s, "kappa_compat": r * (1 - n)}


def diagnostic_ratios(r="R", s="S_sup", n="N", eps: float = 1e-12) -> dict[str, Column]:
    r, s, n = col(r), col(s), col(n)
    over = lambda a, b: a / F.greatest(b, F.lit(eps))
    return {"alpha": over(r, r + n), "SCR_norm": over(r, r + s), "CNR_norm": over(s, s + n), "leaderboard_scalar": r + s}


def fold_stability(metric: str) -> dict[str, Column]:
    """tau and sigma over fold rows (aggregates)."""
    m, sd, n = F.avg(metric), F.stddev_samp(metric), F.count(metric)
    tau = F.when(n < 2, 1.0).when(F.abs(m) < 1e-10, 0.5).otherwise(1 / (1 + div(sd, F.abs(m))))
    return {"tau": tau, "sigma": F.when(n < 2, 0.0).otherwise(sd), "n_folds": n}


def coherence(folds: DataFrame, by: list[str], metric: str, alpha: str | None = None, min_prevalence: float = 0.01) -> DataFrame:
    """Do the folds of a cell tell the same story? (A cell has a handful of folds.)

    valid rate x (0.6 x share on the median's side of zero + 0.4 x (1 - IQR / range))."""
    m = F.col(metric)
    al = [F.max(alpha).alias("_alpha")] if alpha else [F.lit(None).cast("double").alias("_alpha")]
    s = folds.groupBy(*by).agg(F.count(F.lit(1)).alias("n_folds_expected"), F.count(metric).alias("n_folds_valid"), F.percentile(metric, 0.5).alias("_med"), F.percentile(metric, 0.25).alias("_q1"),
                               F.percentile(metric, 0.75).alias("_q3"), (F.max(metric) - F.min(metric)).alias("_span"), F.count_if(m > 0).alias("_up"), F.count_if(m <= 0).alias("_down"), *al)
    med, n = F.col("_med"), F.col("n_folds_valid")
    agree = div(F.when(med > 0, F.col("_up")).when(med < 0, F.col("_down")).otherwise(n), n)
    magnitude = F.when(F.col("_span") > 1e-12, clip(1 - (F.col("_q3") - F.col("_q1")) / F.col("_span"), 0, 1)).otherwise(1.0)
    status = F.when(F.col("_alpha") < min_prevalence, "NOT_COMPUTED_TARGET_DEGENERATE").when(n < 2, "NOT_COMPUTED_INSUFFICIENT_FOLDS").otherwise("COMPUTED")
    ok = lambda e: F.when(F.col("coherence_status") == "COMPUTED", e)
    s = s.withColumn("coherence_status", status)
    value = div(n, F.greatest("n_folds_expected", F.lit(1))) * (0.6 * agree + 0.4 * magnitude)
    return s.select(*by, "n_folds_expected", "n_folds_valid", "coherence_status", ok(agree).alias("fold_directional_agreement"), ok(magnitude).alias("fold_magnitude_stability"), ok(clip(value, 0, 1)).alias("coherence"))


def certify_cells(folds: DataFrame, by: list[str], spatial: str, random: str, task_type: Column, kappa_geom: DataFrame | None = None) -> DataFrame:
    """One certificate per cell from its fold rows; nested detail as a struct column."""
    g = folds.groupBy(*by).agg(F.avg(spatial).alias("spatial_metric"), F.avg(random).alias("random_metric"), *[e.alias(k) for k, e in fold_stability(spatial).items()]).withColumn("task_type", task_type)
    g = g.withColumns(simplex_from_metrics("spatial_metric", "random_metric", "task_type"))
    g = g.withColumns(derived_signals())
    c = coherence(folds.join(g.select(*by, "alpha"), by), by, spatial, "alpha")
    detail = ["n_folds_expected", "n_folds_valid", "fold_directional_agreement", "fold_magnitude_stability"]
    out = g.join(c.select(*by, "coherence", "coherence_status", F.struct(*detail).alias("coherence_detail")), by).withColumn("kappa_source", F.lit("rsn_simplex"))
    return out if kappa_geom is None else out.withColumn("kappa_geom", kappa_geom.scalar())


def ceiling_certificates(preds: DataFrame, floors: DataFrame | None = None, by_task: str = "task", model: str = "model_version") -> DataFrame:
    """Per-prediction certificates: R and floor from model and task, proxy from the row's residual.

    Group statistics are computed once and joined back. There are as many as tasks and models, so they are broadcast:
    a shuffle by task would put all predictions of a task into one task."""
    one = lambda x: clip(x, 0, 1)
    models = preds.groupBy(by_task, model).agg(one(r_squared()).alias("r2_model"))
    if floors is None:
        floors = models.groupBy(by_task).agg((1 - F.max("r2_model")).alias("task_residual_floor"))
    var = preds.groupBy(by_task).agg(F.var_pop("y_true").alias("_v"))
    d = preds.join(F.broadcast(models), [by_task, model]).join(F.broadcast(floors.select(by_task, "task_residual_floor").join(var, by_task)), by_task)
    proxy = F.when(F.col("_v") > 1e-12, one(1 - (F.col("y_true") - F.col("y_pred")) ** 2 / F.col("_v"))).otherwise(0.0)
    return d.withColumns({"R_ceiling": F.col("r2_model"), "S_ceiling": one(1 - F.col("r2_model") - F.col("task_residual_floor")), "R_proxy": proxy, "N_proxy": one(1 - proxy), "S_proxy": F.lit(0.0)}).drop("_v")


def base_model(version) -> Column:
    """Model name without its seed suffix."""
    return F.regexp_replace(col(version), r"_seed[0-9]+$", "")


def residual_floor(preds: DataFrame, reps: int = 1000, seed: int = 42, block: str = "state_fips") -> DataFrame:
    """Task residual floor 1 - best mean-over-seeds R2, its block-bootstrap interval, and how alike
    the models' residuals are. Seeds of one model are averaged, not maximised."""
    by = ["task", "model_version"]
    point = preds.groupBy(*by).agg(r_squared().alias("r2")).groupBy("task", base_model("model_version").alias("base")).agg(F.avg("r2").alias("r2"))
    best = point.groupBy("task").agg(F.min(F.struct((-F.col("r2")).alias("k"), F.col("base").alias("b"))).alias("_b"), F.count(F.lit(1)).alias("n_models"))
    boot = block_bootstrap_r2(preds, by, block, reps, seed).groupBy("task", "rep", base_model("model_version").alias("base")).agg(F.avg("r2").alias("r2"))
    boot = boot.groupBy("task", "rep").agg((1 - F.max("r2")).alias("trf"))
    ci = percentile_ci(boot, ["task"], "trf").select("task", "ci_lower", "ci_upper")
    corr = residual_correlation(preds).groupBy("task").agg(F.avg(F.abs("corr")).alias("mean_residual_correlation"))
    out = best.select("task", "n_models", F.col("_b.b").alias("best_model"), (-F.col("_b.k")).alias("best_r2"), (1 + F.col("_b.k")).alias("task_residual_floor"))
    return out.join(ci, "task").join(corr, "task", "left").withColumn("flagged", F.coalesce(F.col("mean_residual_correlation") > CORRELATION_FLAG, F.lit(False)))


def residual_correlation(preds: DataFrame, unit: str = "zcta") -> DataFrame:
    """Correlation of unit residuals between every two models of a task, over units all share."""
    r = preds.groupBy("task", unit, base_model("model_version").alias("base")).agg(F.avg(F.col("y_true") - F.col("y_pred")).alias("e"))
    n = r.groupBy("task").agg(F.count_distinct("base").alias("_n"))
    full = r.groupBy("task", unit).agg(F.array_sort(F.collect_list(F.struct("base", "e"))).alias("m")).join(n, "task").filter(F.size("m") == F.col("_n"))  # one entry per model
    pairs = full.select("task", F.posexplode("m").alias("i", "a"), "m").select("task", "a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    return pairs.groupBy("task", F.col("a.base").alias("first"), F.col("b.base").alias("second")).agg(F.corr("a.e", "b.e").alias("corr"), F.count(F.lit(1)).alias("n_units"))


def capped_weights(raw: Column, floor: float = FLOOR_WEIGHT, cap: float = MAX_WEIGHT_SHARE, rounds: int = 10) -> Column:
    """Weights from an array of raw scores: floor, normalise, then move what exceeds the cap to the
    uncapped ones in proportion, at most ``rounds`` times."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    floored = F.transform(raw, lambda v: F.greatest(v, F.lit(floor)))

    def redistribute(w: Column) -> Column:
        excess = total(F.transform(w, lambda v: F.greatest(v - cap, F.lit(0.0))))
        free = total(F.filter(w, lambda v: v < cap))
        n = F.size(w).cast("double")
        moved = F.transform(w, lambda v: F.when(free < 1e-12, F.least(v, F.lit(cap)) + excess / n).when(v >= cap, F.lit(cap)).otherwise(v + excess * F.try_divide(v, free)))
        return F.when(excess < 1e-12, F.transform(w, lambda v: F.least(v, F.lit(cap)))).otherwise(moved)

    start = F.transform(floored, lambda v: F.try_divide(v, total(floored)))
    capped = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda w, _: redistribute(w))
    return F.when(F.size(raw) == 1, F.array(F.lit(1.0))).otherwise(capped)


def blend(certs: DataFrame, by: list[str], model: str = "model_version", calibration: str | None = None) -> DataFrame:
    """Blend the models' certificates and predictions per location (one row per model there)."""
    cal = F.col(calibration) if calibration else F.lit(1.0)
    raw = clip("r2_model", 0, 1) * (1 - clip("S_proxy", 0, 1)) * clip(cal, 0, 1)
    row = F.struct(F.col(model).alias("model"), raw.alias("raw"), F.col("R_proxy").alias("r"), F.col("S_proxy").alias("s"), F.col("N_proxy").alias("n"), F.col("y_pred").alias("p"), cal.alias("c"))
    g = certs.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("m"), F.min("y_true").alias("y_true"))
    g = g.withColumn("w", capped_weights(F.transform("m", lambda x: x["raw"])))
    dot = lambda f: F.aggregate(F.zip_with("w", "m", lambda w, x: w * x[f]), F.lit(0.0), lambda s, v: s + v)
    g = g.withColumns({"_r": dot("r"), "_s": dot("s"), "_n": dot("n"), "y_pred_blended": dot("p"), "calibration_blended": dot("c")})
    tot = F.col("_r") + F.col("_s") + F.col("_n")
    part = lambda c: F.when(tot > 0, F.col(c) / tot).otherwise(F.col(c))
    weights = F.map_from_entries(F.zip_with("w", "m", lambda w, x: F.struct(x["model"], w)))
    return g.select(*by, F.size("m").alias("n_models"), part("_r").alias("R_blended"), part("_s").alias("S_blended"), part("_n").alias("N_blended"), "y_pred_blended", "calibration_blended", "y_true", weights.alias("model_weights"))


def audit_certificates(certs: DataFrame, floors: DataFrame, tol: float = 1e-4) -> DataFrame:
    """Findings: S rising with R, several floors per task, floor outside its interval, flagged
    tasks, broken simplex."""
    per = certs.groupBy("task", "model_version").agg(F.max("R_ceiling").alias("r"), F.max("S_ceiling").alias("s"))
    w = W.partitionBy("task").orderBy("r", "model_version")
    mono = per.withColumn("_p", F.lag("s").over(w)).filter(F.col("s") > F.col("_p") + 1e-6).groupBy("task").agg(F.count(F.lit(1)).alias("n")).select("task", F.lit("s_monotonicity").alias("check"), F.lit("error").alias("severity"), "n")
    trf = certs.groupBy("task").agg(F.count_distinct(F.bround("task_residual_floor", 6)).alias("k"), F.max("task_residual_floor").alias("t"), F.count(F.lit(1)).alias("n_certs")).join(floors.select("task", F.col("task_residual_floor").alias("e"), "ci_lower", "ci_upper", "flagged"), "task", "left")
    inside = F.col("t").between(F.col("ci_lower"), F.col("ci_upper"))
    severity = F.when(F.col("k") > 1, "error").when(F.col("e").isNull(), "warning").when(F.abs(F.col("t") - F.col("e")) > tol, "error").when(inside, "info").otherwise("warning")
    inv = trf.select("task", F.lit("trf_invariance").alias("check"), severity.alias("severity"), F.col("k").alias("n"))
    flag = trf.filter("flagged").select("task", F.lit("flagged_task").alias("check"), F.lit("warning").alias("severity"), F.col("n_certs").alias("n"))
    # the ceiling sum may exceed one where a model beats the floor's model, so only the proxy is held to it
    bad = certs.filter(F.abs(F.col("R_proxy") + F.col("S_proxy") + F.col("N_proxy") - 1) > tol).groupBy("task").agg(F.count(F.lit(1)).alias("n")).select("task", F.lit("simplex_integrity").alias("check"), F.lit("error").alias("severity"), "n")
    return mono.unionByName(inv).unionByName(flag).unionByName(bad)


def residual_classes(df: DataFrame, residual: str, train: Column, by: list[str] = (), low_closed: bool = True, min_rows: int = 30) -> DataFrame:
    """R / S / N by terciles of the training residuals. ``low_closed`` picks the convention
    (<= q33 and > q66, or < q33 and >= q66, the latter only from ``min_rows`` rows on)."""
    by = list(by)
    q = quantiles(df.filter(train), by, residual, {"q33": 1 / 3, "q66": 2 / 3})
    d = df.join(q, by, "left") if by else df.withColumns({c: q.select(c).scalar() for c in ("q33", "q66", "n_values")})
    x = F.col(residual)
    lab = F.when(x <= F.col("q33"), "R").when(x > F.col("q66"), "N").otherwise("S") if low_closed else \
        F.when(F.col("n_values") >= min_rows, F.when(x < F.col("q33"), "R").when(x >= F.col("q66"), "N").otherwise("S"))
    return d.withColumn("residual_class", F.when(x.isNotNull(), lab)).drop("q33", "q66", "n_values")


def ideal_loss(preds: DataFrame, sample: list[str], model: str, leave_own_out: bool = False) -> DataFrame:
    """Best achievable squared loss per sample over all representations, against each one's own."""
    loss = (F.col("y_true") - F.col("y_pred")) ** 2
    d = preds.select(*sample, model, loss.alias("loss"))
    two = d.groupBy(*sample).agg(F.slice(F.sort_array(F.collect_list(F.struct("loss", model))), 1, 2).alias("b"))  # one entry per model
    d = d.join(two, sample)
    first, second = F.get("b", F.lit(0)), F.get("b", F.lit(1))
    star = F.when(first[model] == F.col(model), second["loss"]).otherwise(first["loss"]) if leave_own_out else first["loss"]
    ratio = F.when(F.col("loss") > 1e-12, F.least(star / F.col("loss"), F.lit(1.0))).otherwise(1.0)
    return d.select(*sample, model, "loss", star.alias("ideal_loss"), ratio.alias("kappa"))


def construct_divergence(certs: DataFrame, construct: str, signals: list[str]) -> DataFrame:
    """Euclidean distance between every two constructs (there are five); null if either is missing."""
    s = certs.select(F.struct(construct, *signals).alias("c")).agg(F.array_sort(F.collect_list("c")).alias("m"))
    p = s.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    dist = F.sqrt(sum(((F.col("a")[x] - F.col("b")[x]) ** 2 for x in signals), F.lit(0.0)))
    return p.select(F.col("a")[construct].alias("construct_a"), F.col("b")[construct].alias("construct_b"), dist.alias("distance"), dist.isNotNull().alias("both_available"))


def divergence_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance"), F.min(F.when(F.col("distance").isNotNull(), F.struct((-F.col("distance")).alias("k"), F.concat_ws("|", "construct_a", "construct_b").alias("v"))))["v"].alias("max_pair"), F.count_if(F.col("both_available")).alias("n_pairs"))


def quadrant_mass(df: DataFrame, first: str, second: str, min_n: int = 30) -> DataFrame:
    """2 x 2 mass split at both medians; a value on the median counts as high."""
    d = df.filter(F.col(first).isNotNull() & F.col(second).isNotNull()).select(first, second)
    med = {c: quantiles(d, [], c, {"q": 0.5}).select("q").scalar() for c in (first, second)}
    d = d.select((F.col(first) >= med[first]).alias("a"), (F.col(second) >= med[second]).alias("b"))
    a, b = F.col("a"), F.col("b")
    g = d.agg(F.count(F.lit(1)).alias("n"), F.count_if(a & b).alias("high_high"), F.count_if(a & ~b).alias("high_low"), F.count_if(~a & b).alias("low_high"), F.count_if(~a & ~b).alias("low_low"))
    return g.withColumn("pct_agreement", F.when(F.col("n") >= min_n, div(F.col("high_high") + F.col("low_low"), "n")))


def reblend(alpha, omega, prior=0.5) -> Column:
    o = col(omega)
    return o * col(alpha) + (1 - o) * (prior if isinstance(prior, Column) else F.lit(prior))


def carry_forward(df: DataFrame, by: list[str], order: str, alpha: str, omega: str, prior: float = 0.5) -> DataFrame:
    """Sequential reblend: the result of one event is the prior of the next (a unit sees few events)."""
    g = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, F.col(alpha).alias("a"), F.col(omega).alias("o")))).alias("e"))
    step = lambda s, x: x["o"] * x["a"] + (1 - x["o"]) * F.element_at(s, -1)
    path = F.aggregate("e", F.array(F.lit(prior)), lambda s, x: F.concat(s, F.array(step(s, x))))
    return g.select(*by, F.posexplode(F.zip_with("e", F.slice(path, 2, F.size("e")), lambda x, v: F.struct(x[order].alias(order), x["a"].alias("alpha"), v.alias("alpha_omega")))).alias("step", "r")).select(*by, "step", "r.*")


def block_evidence(tests: DataFrame, by: list[str]) -> DataFrame:
    """Standalone and marginal signal of a feature block from its contrast metrics."""
    w = tests.groupBy(*by).agg(*[F.max(F.when(F.col("contrast") == c, F.col("metric"))).alias(c) for c in ("block_only", "full", "drop_block")])
    delta = F.col("full") - F.col("drop_block")
    return w.select(*by, F.col("block_only").alias("independent_signal"), delta.alias("marginal_signal"), F.when(F.col("block_only").isNull(), "INVALID").otherwise("VALID").alias("certificate_status"),
                    F.when(delta > 0.001, "useful").when(delta < -0.001, "harmful_or_superfluous").when(delta.isNotNull(), "redundant").alias("ablation_interpretation"))
