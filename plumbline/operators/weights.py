"""Aligning a validation sample with its deployment target: gaps, weights, raking, decisions.

Rows are reduced to cells (one per combination of descriptor bins) before anything iterates. The
number of cells is the product of the bin counts, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.core import clip, div
from plumbline.operators.replicates import multinomial_cells
from plumbline.session import cut_lineage

SENTINEL_BIN = -1
EPS = 1e-12


def long_bins(df: DataFrame, cols: list[str], weight: Column | None = None) -> DataFrame:
    """(descriptor, bin, mass) with masses of each descriptor summing to one; null bins drop, the
    sentinel stays."""
    w = weight if weight is not None else F.lit(1.0)
    cells = df.select(*cols, w.alias("_w")).groupBy(*cols).agg(F.sum("_w").alias("_w"))
    g = cells.unpivot(["_w"], cols, "descriptor", "bin").filter("bin IS NOT NULL").groupBy("descriptor", "bin").agg(F.sum("_w").alias("m"))
    tot = g.groupBy("descriptor").agg(F.sum("m").alias("_t"))
    return g.join(tot, "descriptor").select("descriptor", "bin", F.coalesce(div("m", "_t"), F.lit(0.0)).alias("mass"))


def _both(validation: DataFrame, target: DataFrame) -> DataFrame:
    v = validation.select("descriptor", "bin", F.col("mass").alias("p"))
    t = target.select("descriptor", "bin", F.col("mass").alias("q"))
    return v.join(t, ["descriptor", "bin"], "outer").na.fill(0.0, ["p", "q"])


def js_divergence(validation: DataFrame, target: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence (natural log) per descriptor; eps is added, then renormalised."""
    b = _both(validation, target)
    n = b.groupBy("descriptor").agg((F.sum("p") + EPS * F.count(F.lit(1))).alias("np"), (F.sum("q") + EPS * F.count(F.lit(1))).alias("nq"))
    b = b.join(n, "descriptor").select("descriptor", ((F.col("p") + EPS) / F.col("np")).alias("p"), ((F.col("q") + EPS) / F.col("nq")).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    return b.groupBy("descriptor").agg((F.sum(F.col("p") * F.log(F.col("p") / m) + F.col("q") * F.log(F.col("q") / m)) / 2).alias("js_divergence"))


def alignment_gaps(validation: DataFrame, target: DataFrame) -> DataFrame:
    b = _both(validation, target)
    g = b.groupBy("descriptor").agg(F.count_if(F.col("p") > 0).alias("validation_bins"), F.count_if(F.col("q") > 0).alias("target_bins"), F.count_if((F.col("q") > 0) & (F.col("p") == 0)).alias("missing_bins"),
                                    F.sum(F.when(F.col("p") == 0, F.col("q")).otherwise(0.0)).alias("uncovered_target_mass"))
    return g.join(js_divergence(validation, target), "descriptor")


def margin_gap(weighted: DataFrame, target: DataFrame) -> DataFrame:
    """Largest total-variation distance between achieved and target margins."""
    tv = _both(weighted, target).groupBy("descriptor").agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tv"))
    return tv.agg(F.max("tv").alias("residual_margin_gap"))


def cells_of(df: DataFrame, cols: list[str], y: str | None = None, p: str | None = None) -> DataFrame:
    """Row count per cell, with the loss sums of a prediction if one is given."""
    e = F.col(y) - F.col(p) if y and p else None
    loss = [F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae")] if e is not None else []
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"), *loss)


def product_cells(cells: DataFrame, target_margins: DataFrame, cols: list[str], cap: float = 10.0) -> DataFrame:
    """Per-row weight of every cell: product of bounded marginal ratios; out of support is zero."""
    v = long_bins(cells, cols, F.col("n").cast("double"))
    ratio = _both(v, target_margins).filter("p > 0").select("descriptor", "bin", (F.col("q") / F.col("p")).alias("r"))
    bounded = F.when(F.col("r") > 0, clip("r", 1 / cap, cap) if cap > 1 else F.col("r")).otherwise(0.0)
    table = ratio.select(F.concat_ws("=", "descriptor", F.col("bin").cast("string")).alias("k"), bounded.alias("f")).agg(F.map_from_entries(F.collect_list(F.struct("k", "f")))).scalar()
    c = cells.withColumn("_m", table)
    w = F.lit(1.0)
    for name in cols:
        w = w * F.coalesce(F.try_element_at("_m", F.concat_ws("=", F.lit(name), F.col(name).cast("string"))), F.lit(0.0))
    return c.withColumn("w", w).drop("_m")


#: up to so many cells one task fits all rounds of a raking; beyond, every adjustment is an aggregate of its own
RAKED_AT_ONCE = 1 << 20


def fit_margins(codes: list[np.ndarray], goals: list[np.ndarray], n: np.ndarray, cap: float, max_iter: int, tol: float) -> tuple[np.ndarray, int, float]:
    """(weights, rounds, last change) of iterative proportional fitting; ``codes`` has the bin of every cell and ``goals`` the target mass of every bin, by descriptor."""
    w, step, change = np.ones(len(n)), 0, 0.0
    while step < max_iter:
        step += 1
        before = w.copy()
        for code, goal in zip(codes, goals):
            have = np.bincount(code, weights=w * n, minlength=len(goal))
            total = have.sum()
            if total <= 0:
                break
            need = total * goal
            f = np.divide(need, have, out=np.zeros_like(need), where=have > 0)
            w = w * np.where(need > 0, np.clip(f, 1 / cap, cap) if cap > 1 else f, 0.0)[code]
        live = before > 0
        change = float(np.abs(w[live] / before[live] - 1).max(initial=0.0))
        if change < tol:
            break
    return w, step, change


def rake_cells(cells: DataFrame, target_margins: DataFrame, cols: list[str], cap: float = 10.0, max_iter: int = 500, tol: float = 1e-6) -> DataFrame:
    """Iterative proportional fitting on the cell table (cells, w, iterations, converged).

    Cells are an aggregate over products of bins. Up to ``RAKED_AT_ONCE`` of them, counted first, one task fits all rounds in one job; more stay distributed: a
    fitted weight is a product of one factor per descriptor and bin, so the state is that table of factors, and each adjustment is one aggregate of the cells by a descriptor's bin."""
    goal: dict[str, dict[str, float]] = {}
    for m in target_margins.select("descriptor", F.col("bin").cast("long").cast("string").alias("bin"), "mass").collect():
        goal.setdefault(m["descriptor"], {})[m["bin"]] = m["mass"]
    used = [c for c in cols if c in goal]
    cells = cut_lineage(cells)
    bin_of = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit("~"))

    if cells.count() <= RAKED_AT_ONCE:
        names = cells.columns
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema) + ", w double, iterations int, converged boolean"

        def fit(batches):
            held = [pdf for pdf in batches if len(pdf)]
            if held:
                pdf = pd.concat(held, ignore_index=True)
                factored = [pd.factorize(pdf[f"_b_{c}"]) for c in used]
                goals = [np.array([goal[c].get(b, 0.0) for b in bins]) for c, (_, bins) in zip(used, factored)]
                w, step, change = fit_margins([code for code, _ in factored], goals, pdf["n"].to_numpy(float), cap, max_iter, tol)
                yield pdf[names].assign(w=w, iterations=step, converged=change < tol)

        return cut_lineage(cells.select(*names, *[bin_of(c).alias(f"_b_{c}") for c in used]).coalesce(1).mapInPandas(fit, schema))

    def product(factors: dict[str, dict[str, float]]) -> Column:
        w = F.lit(1.0)
        for c, f in factors.items():
            if f:
                w = w * F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in f.items() for v in kv]), bin_of(c)), F.lit(1.0))
        return w

    factor: dict[str, dict[str, float]] = {c: {} for c in used}
    step, change = 0, 0.0
    while step < max_iter:
        step += 1
        before = {c: dict(f) for c, f in factor.items()}
        moved: dict[str, dict[str, float]] = {}
        for c in used:
            have = {r["b"]: r["h"] for r in cells.groupBy(bin_of(c).alias("b")).agg(F.sum(product(factor) * F.col("n")).alias("h")).collect()}
            total = sum(have.values())
            if total <= 0:
                break
            moved[c] = {}
            for b, h in have.items():
                need = total * goal[c].get(b, 0.0)
                f = need / h if h > 0 else 0.0
                moved[c][b] = (min(max(f, 1 / cap), cap) if cap > 1 else f) if need > 0 else 0.0
                factor[c][b] = factor[c].get(b, 1.0) * moved[c][b]
        change = cells.agg(F.max(F.when(product(before) > 0, F.abs(product(moved) - 1)).otherwise(0.0))).first()[0] or 0.0
        if change < tol:
            break
    return cells.withColumns({"w": product(factor), "iterations": F.lit(step), "converged": F.lit(change < tol)})


def shrink_cells(cells: DataFrame, lam: float) -> DataFrame:
    """Normalise so that rows sum to one, then mix with the uniform weight over kept rows; a
    dropped cell stays dropped."""
    t = cells.agg(F.struct(F.sum(F.col("w") * F.col("n")).alias("s"), F.sum(F.when(F.col("w") > 0, F.col("n")).otherwise(0)).alias("k"))).scalar()
    c = cells.withColumn("_t", t)
    w = F.coalesce(div(F.col("w"), F.col("_t.s")), F.lit(0.0))
    mixed = (1 - lam) * w + F.when(F.col("w") > 0, lam / F.col("_t.k")).otherwise(0.0)
    return c.withColumn("w", mixed if lam > 0 else w).drop("_t")


def attach(df: DataFrame, cells: DataFrame, cols: list[str]) -> DataFrame:
    """Cell weights back on the rows."""
    k = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols]
    c = cells.select(F.concat_ws("|", *k).alias("_k"), F.col("w").alias("weight"))
    return df.withColumn("_k", F.concat_ws("|", *k)).join(c, "_k", "left").drop("_k")


def weight_summary(cells: DataFrame) -> DataFrame:
    """Kish effective size, its share, the largest weight against uniform, the dropped share."""
    n, w = F.col("n"), F.col("w")
    s = cells.agg(F.sum(n).alias("n_validation"), F.sum(w * n).alias("_s"), F.sum(w * w * n).alias("_q"), F.max("w").alias("_m"), F.sum(F.when(w <= 0, n).otherwise(0)).alias("_d"))
    ess = F.coalesce(div(F.col("_s") * F.col("_s"), F.col("_q")), F.lit(0.0))
    return s.select("n_validation", ess.alias("ess"), (ess / F.col("n_validation")).alias("ess_fraction"), (div("_m", "_s") * F.col("n_validation")).alias("max_weight_x_uniform"), (F.col("_d") / F.col("n_validation")).alias("dropped_fraction"))


def no_reference_share(df: DataFrame, bin_col: str) -> DataFrame:
    return df.filter(F.col(bin_col).isNotNull()).agg(F.avg((F.col(bin_col) == SENTINEL_BIN).cast("double")).alias("no_reference_fraction"))


def density_ratio(validation: DataFrame, target: DataFrame, features: list[str], bounds: tuple[float, float] = (0.001, 0.999), reg: float = 0.01) -> DataFrame:
    """Importance weights p / (1 - p) from a weighted logistic model of target membership."""
    both = validation.select(*features, F.lit(0.0).alias("label")).unionByName(target.select(*features, F.lit(1.0).alias("label"))).na.drop()
    n = both.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    ratio = n.agg(F.max(F.when(F.col("label") == 1, F.col("n"))) / F.max(F.when(F.col("label") == 0, F.col("n")))).scalar()
    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    train = va.transform(both.withColumn("w", F.when(F.col("label") == 0, ratio).otherwise(1.0)))
    model = LogisticRegression(maxIter=100, regParam=reg, weightCol="w").fit(train)
    p = clip(vector_to_array("probability")[1], *bounds)
    out = model.transform(va.transform(validation)).withColumn("weight", p / (1 - p)).drop("features", "rawPrediction", "probability", "prediction")
    tot = out.agg(F.sum("weight")).scalar()
    return out.withColumn("weight", F.col("weight") / tot)


def js_null_threshold(target: DataFrame, cols: list[str], n_validation: int | Column, reps: int = 200, q: float = 0.95, seed: int = 0) -> DataFrame:
    """Quantile of the mean divergence of samples of ``n_validation`` rows drawn from the target itself.

    A sample deals its rows to the cells (products of bins) by binomial splitting, so no row is drawn or repeated."""
    cells = target.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    s = multinomial_cells(cells, cols, "n", n_validation if isinstance(n_validation, Column) else F.lit(n_validation), reps, seed)
    v = s.unpivot(["rep", "m"], cols, "descriptor", "bin").filter("bin IS NOT NULL").groupBy("rep", "descriptor", "bin").agg(F.sum("m").alias("m"))
    v = v.join(v.groupBy("rep", "descriptor").agg(F.sum("m").alias("_t")), ["rep", "descriptor"]).select("rep", "descriptor", "bin", (F.col("m") / F.col("_t")).alias("p"))
    t = long_bins(target, cols).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).select("rep", "descriptor", "bin", F.col("mass").alias("q"))
    b = v.join(t, ["rep", "descriptor", "bin"], "right").na.fill(0.0, ["p"])
    k = b.groupBy("rep", "descriptor").agg((F.sum("p") + EPS * F.count(F.lit(1))).alias("np"), (F.sum("q") + EPS * F.count(F.lit(1))).alias("nq"))
    b = b.join(k, ["rep", "descriptor"]).select("rep", "descriptor", ((F.col("p") + EPS) / F.col("np")).alias("p"), ((F.col("q") + EPS) / F.col("nq")).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    js = b.groupBy("rep", "descriptor").agg((F.sum(F.col("p") * F.log(F.col("p") / m) + F.col("q") * F.log(F.col("q") / m)) / 2).alias("js")).groupBy("rep").agg(F.avg("js").alias("js"))
    return js.agg(F.percentile("js", q).alias("js_null_threshold"), F.count(F.lit(1)).alias("n_reps"))


@dataclass(frozen=True)
class AlignmentGates:
    min_ess_fraction: float = 0.30
    hard_min_ess_fraction: float = 0.10
    max_weight_x_uniform: float = 10.0
    max_missing_bins: int = 0
    max_dropped_fraction: float = 0.20
    max_no_reference_fraction: float = 0.10
    max_mean_js: float = 0.20


def alignment_decision(validation: DataFrame, target: DataFrame, cells: DataFrame, gates: AlignmentGates = AlignmentGates(), no_reference: DataFrame | None = None) -> DataFrame:
    """FAIL on any hard stop, PASS when every soft gate holds, WARN otherwise."""
    g = alignment_gaps(validation, target).agg(F.struct(F.sum("missing_bins").alias("m"), F.avg("js_divergence").alias("j"))).scalar()
    s = weight_summary(cells).withColumn("_g", g).withColumn("_r", no_reference.scalar() if no_reference is not None else F.lit(None).cast("double"))
    hard = (F.col("ess") <= 0) | (F.col("_g.m") > gates.max_missing_bins) | (F.col("ess_fraction") < gates.hard_min_ess_fraction) | (F.col("dropped_fraction") > gates.max_dropped_fraction) | F.coalesce(F.col("_r") > gates.max_no_reference_fraction, F.lit(False))
    soft = (F.col("ess_fraction") >= gates.min_ess_fraction) & (F.col("max_weight_x_uniform") <= gates.max_weight_x_uniform) & F.coalesce(F.col("_g.j") <= gates.max_mean_js, F.lit(True))
    return s.select("n_validation", "ess", "ess_fraction", "max_weight_x_uniform", "dropped_fraction", F.col("_g.m").alias("missing_bins"), F.col("_g.j").alias("mean_js_divergence"), F.col("_r").alias("no_reference_fraction"), F.when(hard, "FAIL").when(soft, "PASS").otherwise("WARN").alias("alignment_decision"))


@dataclass(frozen=True)
class Stack:
    """Which layers are on: coverage gate, matching (none, product, raking), shrinkage."""

    coverage_gate: bool = True
    matching: str = "raking"
    shrinkage: float = 0.2
    cap: float = 10.0
    coverage_tol: float = 0.05
    hard_min_ess: float = 0.10
    min_ess: float = 0.30
    max_gap: float = 0.05
    max_weight: float = 10.0


def stacked_cells(cells: DataFrame, target: DataFrame, cols: list[str], s: Stack) -> DataFrame:
    if s.matching == "none":
        c = cells.withColumn("w", F.lit(1.0))
    elif s.matching == "product":
        c = product_cells(cells, target, cols, s.cap)
    else:
        c = rake_cells(cells, target, cols, s.cap).drop("iterations", "converged")
    return c


def stack_row(cells: DataFrame, target: DataFrame, cols: list[str], s: Stack, name: str, uncovered: Column, metrics: bool = False) -> DataFrame:
    """One certificate row: coverage, matching, what shrinkage bought and cost, typed status.
    Losses come from per-cell sums, so rows are not visited again."""
    pre = cut_lineage(shrink_cells(stacked_cells(cells, target, cols, s), 0.0))
    post = cut_lineage(shrink_cells(pre, s.shrinkage)) if s.shrinkage > 0 else pre
    gap = lambda c: margin_gap(long_bins(c, cols, F.col("w") * F.col("n")), target).scalar()
    r = weight_summary(post).withColumns({"config": F.lit(name), "max_uncovered_target_mass": uncovered, "residual_margin_gap": gap(post), "_gp": gap(pre), "_ep": weight_summary(pre).select("ess").scalar()})
    e = F.col("ess_fraction")
    status = (F.when(F.lit(s.coverage_gate) & (F.col("max_uncovered_target_mass") > s.coverage_tol), "FAIL_COVERAGE").when(F.lit(s.matching == "raking") & (F.col("ess") <= 0), "FAIL_DEGENERATE").when(e < s.hard_min_ess, "FAIL_ESS")
              .when(F.col("residual_margin_gap") > s.max_gap, "WARN_MATCH").when((e < s.min_ess) | (F.col("max_weight_x_uniform") > s.max_weight), "WARN_CONCENTRATION").otherwise("PASS"))
    out = r.select("config", "n_validation", "ess", "ess_fraction", "max_weight_x_uniform", "max_uncovered_target_mass", "residual_margin_gap", (F.col("ess") - F.col("_ep")).alias("shrinkage_delta_ess"), (F.col("residual_margin_gap") - F.col("_gp")).alias("shrinkage_delta_margin_gap"), status.alias("stack_status"))
    if metrics:
        tot = F.sum(F.col("w") * F.col("n"))
        m = post.agg(F.struct(F.sqrt(div(F.sum(F.col("w") * F.col("sse")), tot)).alias("rmse"), div(F.sum(F.col("w") * F.col("sae")), tot).alias("mae"))).scalar()
        out = out.withColumn("_x", m).select("*", F.col("_x.rmse").alias("rmse"), F.col("_x.mae").alias("mae")).drop("_x")
    return out


LADDER = {
    "0_unweighted": Stack(False, "none", 0.0), "1_coverage_gate": Stack(True, "none", 0.0), "2_marginal_product": Stack(True, "product", 0.0),
    "3_marginal_raking": Stack(True, "raking", 0.0), "4_raking_shrunk": Stack(True, "raking", 0.2),
}


def decompose(validation: DataFrame, target: DataFrame, cols: list[str], y: str | None = None, p: str | None = None, ladder: dict[str, Stack] = LADDER) -> DataFrame:
    """One row per rung with the change each layer made."""
    from plumbline.operators.timeseries import ladder_deltas

    cells, lt = cut_lineage(cells_of(validation, cols, y, p)), cut_lineage(long_bins(target, cols))
    unc = alignment_gaps(long_bins(cells, cols, F.col("n").cast("double")), lt).agg(F.max("uncovered_target_mass")).scalar()
    rows = None
    for name, s in ladder.items():
        r = stack_row(cells, lt, cols, s, name, unc, bool(y and p))
        rows = r if rows is None else rows.unionByName(r)
    cols_d = ["ess", "residual_margin_gap"] + (["rmse", "mae"] if y and p else [])
    return ladder_deltas(rows, [], "config", cols_d)


def ratio_moe(num, num_moe, den, den_moe) -> Column:
    """Margin of error of a proportion in percentage points; the sum form where the difference is negative."""
    n, nm, d, dm = (F.col(c) if isinstance(c, str) else c for c in (num, num_moe, den, den_moe))
    share = div(n, d)
    inner = nm * nm - share * share * dm * dm
    return div(F.sqrt(F.when(inner >= 0, inner).otherwise(nm * nm + share * share * dm * dm)), d) * 100


def sum_moe(*moes) -> Column:
    cols = [F.coalesce(F.col(m) if isinstance(m, str) else m, F.lit(0.0)) for m in moes]
    return F.sqrt(sum((c * c for c in cols), F.lit(0.0)))
