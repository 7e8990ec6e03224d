"""Rank statistics, tests, agreement, probes and verdicts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.core import clip, col, div, seeded_hash
from plumbline.operators.ranking import P_RANGES, quantiles, spearman, value_ranks, with_avg_rank
from plumbline.operators.replicates import multinomial_cells
from plumbline.operators.resample import draws, fit_sums, number_blocks, percentile_ci

# Fixed values.
ALPHA_FLOOR, ALPHA_LOWER_Q, MIN_PAIRABLE = 0.67, 0.05, 100
MORAN_RESOLVED, RETENTION = 0.10, 0.50
LAG_EFFECT, LAG_P = 0.20, 0.10


def kendall_tau_b(df: DataFrame, by: list[str], x: str, y: str, min_n: int = 2) -> DataFrame:
    """Kendall tau-b with tie shares, without forming pairs.

    Two rows differ first at one bit of their x rank. For every bit, rows that agree above it meet
    in one group, and the lower side is counted below each y of the upper side. Work grows with
    n log n and every group is ranked range by range."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_kx"), F.col(y).alias("_ky"))
    x, y = "_kx", "_ky"
    rx = value_ranks(d, by, x)
    d = d.join(rx.select(*by, x, F.col("below").alias("_code"), "n"), [*by, x])
    bits = max(1, math.ceil(math.log2(max(2, d.agg(F.max("n")).first()[0] or 2))))
    cells = d.groupBy(*by, "_code", y).agg(F.count(F.lit(1)).alias("_m")).withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    cells = cells.select(*by, "_bit", F.expr("_code >> (_bit + 1)").alias("_above"), (F.expr("(_code >> _bit) & 1") == 0).cast("long").alias("_left"), y, "_m")
    g = value_ranks(cells, [*by, "_bit", "_above"], y, {"l": F.sum(F.col("_left") * F.col("_m")), "r": F.sum((1 - F.col("_left")) * F.col("_m"))})
    tot = g.groupBy(*by, "_bit", "_above").agg(F.sum("l").alias("_lt"))
    g = g.join(tot, [*by, "_bit", "_above"])
    s = g.groupBy(*by).agg(F.sum(F.col("r") * F.col("l_below")).alias("_c"), F.sum(F.col("r") * (F.col("_lt") - F.col("l_below") - F.col("l"))).alias("_d"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    tx = rx.groupBy(*by).agg(pairs("ties").alias("_tx"), F.max("n").alias("n"))
    ty = value_ranks(d, by, y).groupBy(*by).agg(pairs("ties").alias("_ty"))
    if by:
        r = tx.join(ty, by).join(s, by)
    else:
        r = tx.withColumns({"_ty": ty.scalar(), "_c": s.select("_c").scalar(), "_d": s.select("_d").scalar()})
    n0 = F.col("n") * (F.col("n") - 1) / 2
    tau = F.try_divide(F.col("_c") - F.col("_d"), F.sqrt((n0 - F.col("_tx")) * (n0 - F.col("_ty"))))
    return r.select(*by, "n", F.when(F.col("n") >= min_n, tau).alias("tau_b"), F.try_divide(F.col("_tx"), n0).alias("tie_fraction_x"), F.try_divide(F.col("_ty"), n0).alias("tie_fraction_y"))


def bootstrap_spearman(df: DataFrame, by: list[str], x: str, y: str, key: str, reps: int, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile interval of the rank correlation over rows drawn with replacement."""
    from plumbline.operators.ranking import hash_order

    rows = hash_order(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, key, x, y), by, key, seed)
    s = spearman(draws(rows, by, reps, seed, [x, y]), [*by, "rep"], x, y, 2)
    return percentile_ci(s, by, "rho", level)


@F.pandas_udf(T.DoubleType())
def wilcoxon_exact(w: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided exact p of a signed-rank sum (no ties); one value per test."""
    out = []
    for stat, k in zip(w, n):
        if stat is None or k is None or np.isnan(stat) or k < 1 or k > 50:
            out.append(np.nan)
            continue
        k = int(k)
        ways = np.zeros(k * (k + 1) // 2 + 1)
        ways[0] = 1.0
        for r in range(1, k + 1):
            ways[r:] = ways[r:] + ways[:-r].copy()
        cum = np.cumsum(ways) / ways.sum()
        out.append(min(1.0, 2 * cum[int(stat)]))
    return pd.Series(out, dtype="float64")


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal tail by a rational approximation of the error function (error < 1.5e-7)."""
    a = F.abs(z) / math.sqrt(2.0)
    t = 1 / (1 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-a * a)


def signed_rank(df: DataFrame, by: list[str], delta: str) -> DataFrame:
    """Wilcoxon signed-rank sums, rank-biserial effect, Cohen's d and p (exact up to 50 pairs when
    no two sizes tie, normal with tie correction otherwise). Zero differences are left out of the ranks."""
    d = df.filter(F.col(delta).isNotNull())
    base = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(delta).alias("mean_delta"), F.stddev_samp(delta).alias("_sd"), F.bool_and(F.col(delta) > 0).alias("all_positive"))
    nz = d.filter(F.col(delta) != 0).withColumn("_abs", F.abs(delta)).withColumn("_pos", (F.col(delta) > 0).cast("int"))
    r = value_ranks(nz, by, "_abs", {"pos": F.sum("_pos")})
    avg = F.col("below") + (F.col("ties") + 1) / 2.0
    s = r.groupBy(*by).agg(F.sum(F.col("pos") * avg).alias("w_plus"), F.sum((F.col("ties") - F.col("pos")) * avg).alias("w_minus"), F.max("n").alias("n_nonzero"), F.sum(F.pow("ties", 3) - F.col("ties")).alias("_t"))
    out = base.join(s, by, "left") if by else base.withColumns({c: s.select(c).scalar() for c in s.columns})
    n, w = F.col("n_nonzero"), F.least("w_plus", "w_minus")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_t") / 48.0)
    z = F.try_divide(w - n * (n + 1) / 4.0, sd)
    exact = wilcoxon_exact(w.cast("double"), n.cast("double"))
    p = F.when((F.col("_t") == 0) & (n <= 50), exact).otherwise(normal_two_sided(z))
    return out.select(*by, "n_pairs", "mean_delta", "w_plus", "w_minus", w.alias("wilcoxon_stat"), p.alias("wilcoxon_p"), F.coalesce(F.try_divide(F.col("w_plus") - F.col("w_minus"), F.col("w_plus") + F.col("w_minus")), F.lit(0.0)).alias("rank_biserial"),
                      F.try_divide("mean_delta", "_sd").alias("cohens_d"), "all_positive")


def welch(df: DataFrame, by: list[str], group: Column, value: str) -> DataFrame:
    """Welch statistic, degrees of freedom and the audit's approximate p."""
    a, b = F.when(group, F.col(value)), F.when(~group, F.col(value))
    g = df.groupBy(*by).agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    s1, s2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    ok = (F.col("n1") >= 2) & (F.col("n2") >= 2) & (s1 + s2 > 0)
    t = F.when(ok, (F.col("m1") - F.col("m2")) / F.sqrt(s1 + s2)).otherwise(0.0)
    x = F.abs(t)
    p = F.when(ok, clip(2 * (1 - 0.5 * (1 + F.signum(x) * (1 - F.exp(-0.717 * x - 0.416 * x * x)))), 0, 1)).otherwise(1.0)
    dof = F.when(ok, F.try_divide((s1 + s2) ** 2, s1 * s1 / (F.col("n1") - 1) + s2 * s2 / (F.col("n2") - 1)))
    return g.select(*by, "n1", "n2", t.alias("t_stat"), dof.alias("dof"), p.alias("p_approx"))


def holm_adjust(df: DataFrame, p: str, by: list[str] = (), out: str = "p_holm") -> DataFrame:
    """Holm-Bonferroni adjusted p-values; the running maximum is taken over ranges that are even in rank."""
    by = list(by)
    r = value_ranks(df, by, p).withColumn("_q", F.least(F.lit(1.0), F.col(p) * (F.col("n") - F.col("below")))).withColumn("_b", F.floor(F.col("below") * P_RANGES / F.col("n")))
    head = r.groupBy(*by, "_b").agg(F.max("_q").alias("_mq"))
    before = W.partitionBy(*([F.col(b) for b in by] or [F.lit(0)])).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    head = head.withColumn("_earlier", F.max("_mq").over(before)).drop("_mq")
    inside = W.partitionBy(*by, "_b").orderBy(p).rowsBetween(W.unboundedPreceding, 0)
    adj = r.join(head, [*by, "_b"]).select(*by, p, F.greatest(F.max("_q").over(inside), F.coalesce("_earlier", F.lit(0.0))).alias(out))
    return df.join(adj, [*by, p], "left")


def _beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 5000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


@F.pandas_udf(T.StructType([T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())]))
def clopper_pearson(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Exact 95 % binomial interval of summary counts."""

    def bound(p: float, a: float, b: float) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if _beta_cdf(mid, a, b) < p else (lo, mid)
        return (lo + hi) / 2

    rows = []
    for h, m in zip(k, n):
        h, m = int(h), int(m)
        rows.append((0.0, 1.0) if m == 0 else (bound(0.025, h, m - h + 1) if h > 0 else 0.0, bound(0.975, h + 1, m - h) if h < m else 1.0))
    return pd.DataFrame(rows, columns=["lower", "upper"])


def hit_rate(df: DataFrame, by: list[str], signal: str, gain: str) -> DataFrame:
    """Share of cells where a below-median signal goes with an above-median gain (or neither)."""
    d = df.filter(F.col(signal).isNotNull() & F.col(gain).isNotNull())
    m = quantiles(d, by, signal, {"_ms": 0.5}).select(*by, "_ms"), quantiles(d, by, gain, {"_mg": 0.5}).select(*by, "_mg")
    d = d.join(m[0], by).join(m[1], by) if by else d.withColumns({"_ms": m[0].scalar(), "_mg": m[1].scalar()})
    hit = (F.col(signal) < F.col("_ms")) == (F.col(gain) > F.col("_mg"))
    g = d.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    return g.filter("n >= 4").withColumn("hit_rate", F.col("hits") / F.col("n")).withColumn("_ci", clopper_pearson("hits", "n")).select(*by, "hits", "n", "hit_rate", F.col("_ci.lower").alias("ci_lower"), F.col("_ci.upper").alias("ci_upper"))


# ---- agreement --------------------------------------------------------------------------------

def _alpha(groups: DataFrame, by: list[str]) -> DataFrame:
    """Nominal alpha from (by, unit pattern weight, array of labels) rows."""
    lab = F.filter("labels", lambda x: x.isNotNull())
    g = groups.withColumn("_l", lab).withColumn("_m", F.size("_l")).filter("_m >= 2")
    e = g.select(*by, "w", "_m", "_l", F.explode(F.array_distinct("_l")).alias("c")).withColumn("k", F.size(F.filter("_l", lambda x: x == F.col("c"))))
    per = e.groupBy(*by, "c").agg(F.sum(F.col("w") * F.col("k")).alias("nc"), F.sum(F.col("w") * F.col("k") * (F.col("k") - 1) / (F.col("_m") - 1)).alias("dg"))
    s = per.groupBy(*by).agg(F.sum("nc").alias("n"), F.sum("dg").alias("d"), F.sum(F.col("nc") * F.col("nc")).alias("q"))
    seen, expected = F.col("n") - F.col("d"), F.col("n") * F.col("n") - F.col("q")
    a = F.when(F.col("n") <= 1, None).when(expected == 0, F.when(seen == 0, 1.0)).otherwise(1 - (F.col("n") - 1) * F.try_divide(seen, expected))
    return s.select(*by, a.alias("alpha"), F.col("n").alias("n_values"))


def krippendorff_alpha(df: DataFrame, labels: list[str], by: list[str] = ()) -> DataFrame:
    """Nominal agreement with missing labels, from counts of label patterns (no rater pairs)."""
    by = list(by)
    p = df.groupBy(*by, *labels).agg(F.count(F.lit(1)).alias("w")).select(*by, "w", F.array(*labels).alias("labels"))
    return _alpha(p, by)


def alpha_lower(df: DataFrame, labels: list[str], reps: int = 1000, q: float = ALPHA_LOWER_Q, seed: int = 42) -> DataFrame:
    """Lower bootstrap quantile. Units are not drawn one by one: a replicate deals their number to the label patterns."""
    p = df.groupBy(*labels).agg(F.count(F.lit(1)).alias("w"))
    drawn = multinomial_cells(p, labels, "w", p.agg(F.sum("w")).scalar(), reps, seed)  # categories squared
    a = _alpha(drawn.select("rep", F.col("m").alias("w"), F.array(*labels).alias("labels")), ["rep"]).filter("alpha IS NOT NULL")
    return a.agg(F.element_at(F.sort_array(F.collect_list("alpha")), F.greatest(F.lit(1), F.floor(q * F.count(F.lit(1))).cast("int") + 1)).alias("alpha_lower"), F.count(F.lit(1)).alias("n_reps"))


def calibration_gate(df: DataFrame, a: str, b: str, family_a: str, family_b: str, ablation: str, reps: int = 1000, seed: int = 42) -> DataFrame:
    """Agreement is trusted when alpha and its lower bound reach the floor on enough pairs from
    judges of different families, with an ablation for every record."""
    al = krippendorff_alpha(df, [a, b]).select("alpha").scalar()
    lo = alpha_lower(df, [a, b], reps, seed=seed).select("alpha_lower").scalar()
    g = df.agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n_pairable"), F.count_if(F.col(a).isNull()).alias("n_missing_a"), F.count_if(F.col(b).isNull()).alias("n_missing_b"),
               F.count_if(F.col(ablation)).alias("n_ablation_available"), F.bool_and(F.col(family_a) != F.col(family_b)).alias("_ind")).withColumns({"alpha": al, "alpha_lower": lo})
    ok = (F.col("alpha") >= ALPHA_FLOOR) & (F.col("alpha_lower") >= ALPHA_FLOOR) & (F.col("n_pairable") >= MIN_PAIRABLE) & F.col("_ind") & (F.col("n_ablation_available") == F.col("n_records"))
    return g.withColumn("passed", F.coalesce(ok, F.lit(False))).drop("_ind")


def label_summary(df: DataFrame, label: str, status: str, adjudicated: str, gate: DataFrame) -> DataFrame:
    """Resolved labels are R and S claims; rates over them, coverage, adjudication, trust flag."""
    n = F.count(F.lit(1))
    is_ = lambda v: F.count_if(F.col(label) == v)
    res = is_("R_claim") + is_("S_sup_claim")
    st = lambda *v: F.count_if(F.col(status).isin(*v))
    g = df.agg(n.alias("n_records"), F.try_divide(is_("R_claim"), res).alias("grounded_signal_rate"), F.try_divide(is_("S_sup_claim"), res).alias("filler_rate"), (is_("unresolved") / n).alias("unresolved_rate"), (res / n).alias("coverage_rate"),
               (F.count_if(F.col(adjudicated)) / n).alias("adjudication_rate"), (st("adjudicated_by_c") / n).alias("adjudication_resolved_rate"), (st("unresolved_c_abstain", "unresolved_three_way") / n).alias("unresolved_after_adjudication_rate"))
    return g.withColumn("trusted", gate.select("passed").scalar())


def distribution(df: DataFrame, axes: list[str]) -> DataFrame:
    long = df.select(*axes).unpivot([], axes, "axis", "label")
    return long.groupBy("axis", "label").agg(F.count(F.lit(1)).alias("n"))


# ---- variance, overlap, order ------------------------------------------------------------------

def two_way_eta2(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Share of the total sum of squares due to each factor and their interaction, from one cube."""
    c = df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count(F.lit(1))).alias("ss"), F.grouping_id().alias("g"))
    tot = c.filter("g = 3").agg(F.struct(F.max("m").alias("m"), F.max("ss").alias("ss"))).scalar()
    c = c.withColumn("_t", tot)
    dev = F.col("n") * (F.col("m") - F.col("_t.m")) ** 2
    s = c.agg(F.sum(F.when(F.col("g") == 1, dev)).alias("sa"), F.sum(F.when(F.col("g") == 2, dev)).alias("sb"), F.sum(F.when(F.col("g") == 0, dev)).alias("sc"), F.max("_t.ss").alias("t"))
    share = lambda e: F.try_divide(e, F.col("t"))
    return s.select(share(F.col("sa")).alias(f"eta2_{a}"), share(F.col("sb")).alias(f"eta2_{b}"), share(F.col("sc") - F.col("sa") - F.col("sb")).alias("eta2_interaction"))


def iqr_overlap(df: DataFrame, group: str, value: str) -> DataFrame:
    """Overlap of the middle halves of every two groups (scenarios) relative to the narrower one."""
    q = quantiles(df, [group], value, {"q1": 0.25, "q3": 0.75}).drop("n_values")
    m = q.agg(F.array_sort(F.collect_list(F.struct(group, "q1", "q3"))).alias("m"))
    p = m.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    width = F.least("a.q3", "b.q3") - F.greatest("a.q1", "b.q1")
    narrow = F.least(F.col("a.q3") - F.col("a.q1"), F.col("b.q3") - F.col("b.q1"))
    o = F.when((width <= 0) | (narrow <= 0), 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(width, narrow)))
    return p.select(F.col(f"a.{group}").alias("group_a"), F.col(f"b.{group}").alias("group_b"), o.alias("iqr_overlap"))


def order_concordance(df: DataFrame, block: str, sign: str, floor: float = 0.80) -> DataFrame:
    """Majority contribution sign of every block over orderings and how often it holds."""
    c = df.groupBy(block, sign).agg(F.count(F.lit(1)).alias("k"))
    g = c.groupBy(block).agg(F.min(F.struct((-F.col("k")).alias("o"), F.col(sign).alias("s"))).alias("b"), F.sum("k").alias("n_orderings"))
    rate = -F.col("b.o") / F.col("n_orderings")
    return g.select(block, F.col("b.s").alias("majority_sign"), rate.alias("concordance_rate"), "n_orderings", (rate >= floor).alias("order_robust"))


# ---- embeddings as evidence --------------------------------------------------------------------

def noncollapse(df: DataFrame, vector: str, dims: int, min_rank: float = 2.0, warn_rank: float = 3.0, min_coverage: float = 0.8) -> DataFrame:
    """Coverage, total variance, dispersion and effective rank exp(entropy of eigen mass), with a
    verdict. Only the dims x dims covariance leaves the executors."""
    ok = F.col(vector).isNotNull() & (F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    v = df.filter(ok)
    model = PCA(k=dims, inputCol="_v", outputCol="_p").fit(v.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v")))
    mass = [float(x) for x in model.explainedVariance if x > 1e-12]
    rank = math.exp(-sum(x * math.log(x) for x in mass))
    tv = v.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("s")).agg(F.sum("s")).scalar()
    g = df.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(ok).alias("n_units")).withColumns({"coverage": F.try_divide("n_units", "n_total"), "total_variance": tv, "effective_rank": F.lit(rank), "n_dims": F.lit(dims)})
    verdict = (F.when((F.col("coverage") < min_coverage) | (F.col("n_units") < 3) | (F.col("n_dims") < 2), "INSUFFICIENT").when((F.col("total_variance") <= 0) | (F.col("effective_rank") < min_rank), "FAIL")
               .when(F.col("effective_rank") < F.greatest(F.lit(warn_rank), 0.05 * F.col("n_dims")), "WARN").otherwise("PASS"))
    return g.withColumn("pairwise_dispersion", F.col("total_variance")).withColumn("verdict", verdict)


def ridge_out_of_block(df: DataFrame, block: str, key: str, vector: str, targets: str, ridge: float = 1.0) -> DataFrame:
    """Leave-one-block-out ridge predictions for an array of right-hand sides.

    Every partition adds up its own Gram sums per block; those are summed by entry; each block is
    solved from the total minus its own, once for all right-hand sides; predictions are a join.
    Rows whose vector or targets are null, of another length or not finite train nothing and have no prediction; rows
    without a block are left out."""
    df = df.filter(F.col(block).isNotNull())

    def partial(batches):
        acc: dict = {}
        for b in batches:
            z, y, g = np.stack(b["z"].to_numpy()), np.stack(b["y"].to_numpy()), b["blk"].to_numpy()
            for k in np.unique(g):
                m = g == k
                a = np.concatenate([(z[m].T @ z[m]).ravel(), (z[m].T @ y[m]).ravel(), [float(m.sum())]])
                acc[k] = acc[k] + a if k in acc else a
        if acc:  # an empty partition has no row, and Arrow finds no type in an empty list of arrays
            yield pd.DataFrame({"blk": list(acc), "sums": [a.tolist() for a in acc.values()]})

    dims = df.select(F.max(F.size(vector)).alias("d"), F.max(F.size(targets)).alias("r")).first()
    d, r = max(dims["d"] or 0, 0), max(dims["r"] or 0, 0)
    whole = lambda c, n: (F.size(c) == n) & F.forall(F.col(c).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(whole(vector, d) & whole(targets, r), F.lit(False))
    rows = df.filter(usable).select(F.col(block).cast("string").alias("blk"), F.col(vector).cast("array<double>").alias("z"), F.col(targets).cast("array<double>").alias("y"))
    part = rows.mapInPandas(partial, "blk string, sums array<double>")
    s = part.select("blk", F.posexplode("sums").alias("i", "v")).groupBy("blk", "i").agg(F.sum("v").alias("v"))
    tot = s.groupBy("i").agg(F.sum("v").alias("t"))
    rest = s.join(tot, "i").groupBy("blk").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("t") - F.col("v")).alias("v")))), lambda x: x["v"]).alias("a"))  # d*d + d*r + 1 numbers

    @F.pandas_udf("array<array<double>>")
    def solve(a: pd.Series) -> pd.Series:
        out = []
        for x in a:
            x = np.asarray(x)
            n = x[-1]
            out.append(np.linalg.solve(x[: d * d].reshape(d, d) + ridge * np.eye(d), x[d * d : d * d + d * r].reshape(d, r)).T.tolist() if n >= d + 1 else None)
        return pd.Series(out)

    w = rest.select(F.col("blk"), solve("a").alias("w"))
    dot = lambda c: F.aggregate(F.zip_with(c, F.col(vector).cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s_, v_: s_ + v_)
    return df.withColumn("blk", F.col(block).cast("string")).join(w, "blk", "left").select(key, block, targets, F.when(usable, F.transform("w", dot)).alias("predicted"))


def checkability(df: DataFrame, block: str, key: str, vector: str, y: str, reps: int, seed: int = 42, ridge: float = 1.0, min_block: int = 3) -> DataFrame:
    """R2 of the out-of-block probe against the same probe on targets permuted inside blocks."""
    from plumbline.operators.resample import permute_within

    size = df.groupBy(block).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_block)
    d = df.join(size.select(block), block, "left_semi")
    null = permute_within(d, [block], key, y, reps, seed).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rep", y))), lambda x: x[y]).alias("_perm"))  # one per replicate
    d = d.join(null, key).withColumn("_ys", F.concat(F.array(F.col(y).cast("double")), F.col("_perm").cast("array<double>")))
    p = ridge_out_of_block(d, block, key, vector, "_ys", ridge)
    e = p.select(F.posexplode(F.arrays_zip("_ys", "predicted")).alias("rhs", "v"))
    yv, pv = F.col("v._ys"), F.col("v.predicted")
    r2 = e.groupBy("rhs").agg((1 - F.try_divide(F.sum((yv - pv) * (yv - pv)), F.var_pop(yv) * F.count(yv))).alias("r2"))
    obs = r2.filter("rhs = 0").select("r2").scalar()
    return r2.withColumn("_o", obs).filter("rhs > 0").agg(F.max("_o").alias("observed_r2"), F.avg("r2").alias("null_mean_r2"), ((F.count_if(F.col("r2") >= F.col("_o")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


def profile_distances(df: DataFrame, solver: str, task: str, value: str) -> DataFrame:
    """Euclidean distance and correlation of the task profiles of every two solvers (a few dozen)."""
    m = df.groupBy(solver, task).agg(F.avg(value).alias("v"))
    t = m.groupBy(task).agg(F.array_sort(F.collect_list(F.struct(solver, "v"))).alias("m"))  # one entry per solver
    p = t.select(task, F.posexplode("m").alias("i", "a"), "m").select(task, "a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    return p.groupBy(F.col(f"a.{solver}").alias("solver_a"), F.col(f"b.{solver}").alias("solver_b")).agg(F.sqrt(F.sum((F.col("a.v") - F.col("b.v")) ** 2)).alias("distance"), F.corr("a.v", "b.v").alias("corr"), F.count(F.lit(1)).alias("n_tasks"))


def pca_summary(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Variance share and largest loadings of the leading components of standardised columns."""
    st = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).first()
    z = [F.try_divide(F.col(c) - F.lit(st[c]["m"]), F.lit(st[c]["s"])) for c in columns]
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(df.na.drop(subset=columns).select(array_to_vector(F.array(*[F.coalesce(x, F.lit(0.0)) for x in z])).alias("_v")))
    pc = model.pc.toArray()
    rows = [(i, float(model.explainedVariance[i]), columns[int(np.argmax(np.abs(pc[:, i])))], float(np.max(np.abs(pc[:, i])))) for i in range(k)]
    return df.sparkSession.createDataFrame(rows, "component int, variance_share double, top_feature string, top_loading double")


# ---- validation and verdicts -------------------------------------------------------------------

def event_validation(preds: DataFrame, losses: DataFrame, by: list[str], unit: str, pred: str, loss: str) -> DataFrame:
    """Rank correlation of external losses with predictions per (scenario, event, level); null below three units."""
    d = preds.join(losses, [unit, *[c for c in by if c in losses.columns]])
    return spearman(d, by, loss, pred, 3)


def collapsed_validation(preds: DataFrame, losses: DataFrame, by: list[str], unit: str, pred: str, loss: str) -> DataFrame:
    """The same after averaging a unit's predictions over events."""
    return event_validation(preds.groupBy(*by, unit).agg(F.avg(pred).alias(pred)), losses, by, unit, pred, loss)


def validation_robustness(rho: DataFrame, level: str, event: list[str]) -> DataFrame:
    """Spread of the correlation per level over events, and how often the level is the best one."""
    best = rho.filter("rho IS NOT NULL").groupBy(*event).agg(F.min(F.struct((-F.col("rho")).alias("k"), F.col(level).alias("l")))["l"].alias("best"))
    b = best.groupBy(F.col("best").alias(level)).agg(F.count(F.lit(1)).alias("n_best"))
    n = best.agg(F.count(F.lit(1))).scalar()
    g = rho.filter("rho IS NOT NULL").groupBy(level).agg(F.avg("rho").alias("mean_rho"), F.percentile("rho", 0.5).alias("median_rho"), F.min("rho").alias("min_rho"), F.max("rho").alias("max_rho"), F.count(F.lit(1)).alias("n_events"))
    return g.join(b, level, "left").na.fill(0, ["n_best"]).withColumn("ranking_consistent", F.col("n_best") == n)


def ranking_agreement(preds: DataFrame, by: list[str], unit: str, level: str, pred: str, first: str, second: str, min_units: int = 5) -> DataFrame:
    """tau-b of two levels' unit means per event."""
    m = preds.groupBy(*by, unit).agg(F.avg(F.when(F.col(level) == first, F.col(pred))).alias("_a"), F.avg(F.when(F.col(level) == second, F.col(pred))).alias("_b"))
    return kendall_tau_b(m, by, "_a", "_b").filter(F.col("n") >= min_units).select(*by, "n", "tau_b")


def ranking_agreement_with_fallback(preds: DataFrame, scenario: list[str], event: str, unit: str, level: str, pred: str, first: str, second: str) -> DataFrame:
    """Mean over events where any event qualifies, else the unit-level value over all events."""
    ev = ranking_agreement(preds, [*scenario, event], unit, level, pred, first, second).groupBy(*scenario).agg(F.avg("tau_b").alias("_e"), F.count(F.lit(1)).alias("n_events"))
    al = ranking_agreement(preds, scenario, unit, level, pred, first, second).withColumnRenamed("tau_b", "_u")
    r = al.join(ev, scenario, "left")
    return r.select(*scenario, F.coalesce("_e", "_u").alias("mean_tau_b"), F.when(F.col("_e").isNotNull(), "event").otherwise("zcta_collapsed").alias("method"), F.coalesce("n_events", F.lit(0)).alias("n_events"))


def transfer_verdict(cells: DataFrame, scenario: str, level: str, transfer: str, threshold: float = RETENTION) -> DataFrame:
    last = cells.groupBy(scenario).agg(F.max(F.struct(level, transfer)).alias("b")).select(scenario, F.col(f"b.{level}").alias(level), F.col(f"b.{transfer}").alias(transfer))
    t = F.col(transfer)
    return last.withColumn("verdict", F.when(t.isNull(), "INSUFFICIENT").when(t >= threshold, "SUPPORTED").otherwise("PROVISIONAL"))


def clustering_verdict(cells: DataFrame, moran: str) -> DataFrame:
    ok = F.coalesce(F.abs(F.col(moran)) < MORAN_RESOLVED, F.lit(False))
    return cells.withColumn("verdict", F.when(ok, "SUPPORTED").otherwise("INSUFFICIENT"))


def overall_verdict(cells: DataFrame, geometry: str, otherwise: str) -> DataFrame:
    """Supported when more than half of the cells are."""
    g = cells.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("verdict") == "SUPPORTED").alias("n_supported"))
    return g.select(F.lit(geometry).alias("geometry"), F.when(F.col("n_supported") * 2 > F.col("n_cells"), "SUPPORTED").otherwise(otherwise).alias("verdict"), "n_cells", "n_supported")


def relational_verdict(folds: DataFrame, scenario: str, variant: str, fold: str, rmse: str, full: str = "full", without: str = "no_lag", only: str = "lag_only") -> DataFrame:
    """What the neighbour features are worth in every scenario that has a full run: errors with and without them, fold by fold.

    One row per scenario: mean errors and fold counts of the three runs, mean loss without the features, Cohen's d over the pooled spread, two-sided Wilcoxon p (1 without any
    difference) and the verdict: SUPPORTED from ``LAG_EFFECT`` on with p below ``LAG_P``, PROVISIONAL without that p, else NOT_LOAD_BEARING; INSUFFICIENT when fold counts
    differ, PENDING without the run that lacks the features. A scenario whose other two runs are both missing has no row."""
    by = F.col(scenario)
    runs = folds.filter(F.col(rmse).isNotNull() & F.col(variant).isin(full, without, only))
    of = lambda name, agg: agg(F.when(F.col(variant) == name, F.col(rmse)))
    g = runs.groupBy(by.alias("scenario")).agg(*[of(v, F.avg).alias(f"{c}_mean_rmse") for v, c in ((full, "full"), (without, "without"), (only, "only"))], *[of(v, F.count).alias(f"{c}_n_folds") for v, c in ((full, "full"), (without, "without"), (only, "only"))],
                                               of(full, F.var_samp).alias("_vf"), of(without, F.var_samp).alias("_vw")).filter("full_n_folds > 0 AND without_n_folds + only_n_folds > 0")
    side = lambda name, c: runs.filter(F.col(variant) == name).select(by.alias("scenario"), F.col(fold).alias("_fold"), F.col(rmse).alias(c))
    pairs = side(full, "a").join(side(without, "b"), ["scenario", "_fold"]).withColumn("_delta", F.col("b") - F.col("a"))
    tested = signed_rank(pairs, ["scenario"], "_delta").select("scenario", F.coalesce("wilcoxon_p", F.lit(1.0)).alias("wilcoxon_p"))
    g = g.join(tested, "scenario", "left")
    even = (F.col("without_n_folds") > 0) & (F.col("full_n_folds") == F.col("without_n_folds"))
    delta = F.when(even, F.col("without_mean_rmse") - F.col("full_mean_rmse"))
    pooled = F.sqrt((F.col("_vf") + F.col("_vw")) / 2)
    d = F.when(even, F.coalesce(F.try_divide(delta, pooled), F.lit(0.0)))
    p = F.when(even, F.col("wilcoxon_p"))
    verdict = F.when(F.col("without_n_folds") == 0, "PENDING").when(~even, "INSUFFICIENT").when((F.abs(d) >= LAG_EFFECT) & (p < LAG_P), "SUPPORTED").when(F.abs(d) >= LAG_EFFECT, "PROVISIONAL").otherwise("NOT_LOAD_BEARING")
    return g.select("scenario", "full_mean_rmse", "full_n_folds", "without_mean_rmse", "without_n_folds", "only_mean_rmse", "only_n_folds", delta.alias("rmse_delta_mean"), d.alias("cohens_d"), p.alias("wilcoxon_p"), verdict.alias("verdict"))


def relational_rollup(cells: DataFrame) -> DataFrame:
    """One verdict over the scenarios of ``relational_verdict``: SUPPORTED by more than half of those decided, PROVISIONAL by any or when mixed, NOT_LOAD_BEARING when all say so,
    PENDING when none is decided."""
    is_ = lambda *v: F.count_if(F.col("verdict").isin(*v))
    g = cells.agg(F.count(F.lit(1)).alias("n_scenarios"), is_("SUPPORTED", "PROVISIONAL", "NOT_LOAD_BEARING").alias("n_resolved"), is_("SUPPORTED").alias("n_supported"), is_("NOT_LOAD_BEARING").alias("n_not_load_bearing"), is_("PENDING", "INSUFFICIENT").alias("n_pending"))
    n, yes = F.col("n_resolved"), F.col("n_supported")
    verdict = F.when(n == 0, "PENDING").when(yes * 2 > n, "SUPPORTED").when(yes > 0, "PROVISIONAL").when(F.col("n_not_load_bearing") == n, "NOT_LOAD_BEARING").otherwise("PROVISIONAL")
    return g.select(F.lit("relational").alias("geometry"), verdict.alias("verdict"), *g.columns)


def allocation_verdict(events: DataFrame, scenario: str, event: str, when: str, boundary: str) -> DataFrame:
    """How many events of every scenario have rainfall timing, which exists from ``boundary`` on, with the totals and the verdict, which is PARTIAL by design: the rest lack
    support by their age. One row per scenario; an event counts once, by its earliest date."""
    e = events.groupBy(F.col(scenario).alias("scenario"), F.col(event)).agg(F.min(when).alias("_at"))
    g = e.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("_at") >= F.lit(boundary).cast("date")).alias("n_covered"))
    total = g.agg(F.struct(F.sum("n_events").alias("n"), F.sum("n_covered").alias("c"))).scalar()
    return g.withColumn("_t", total).select("scenario", "n_events", "n_covered", (F.col("n_events") - F.col("n_covered")).alias("n_uncovered"), F.col("_t.n").alias("total_events"), F.col("_t.c").alias("covered_events"), F.lit("allocation").alias("geometry"), F.lit("PARTIAL").alias("verdict"))


def exchangeability(vectors: DataFrame, name: str, signals: list[str], reps: int, seed: int = 42) -> DataFrame:
    """Permutation p of every pairwise construct distance: vectors are dealt to labels anew per
    replicate. There are five constructs."""
    n = vectors.agg(F.array_sort(F.collect_list(F.struct(name, F.array(*signals).alias("v")))).alias("m"))
    rep = n.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))
    keyed = F.transform("m", lambda x: F.struct(F.when(F.col("rep") == 0, F.lit("")).otherwise(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), x[name]))).alias("h"), x[name].alias("l"), x["v"].alias("v")))
    order = F.transform(F.array_sort(keyed), lambda x: x["v"])
    d = rep.select("rep", F.zip_with("m", order, lambda x, v: F.struct(x[name].alias("l"), v.alias("v"))).alias("z"))
    p = d.select("rep", F.posexplode("z").alias("i", "a"), "z").select("rep", "a", F.explode(F.slice("z", F.col("i") + 2, F.size("z"))).alias("b"))
    dist = F.sqrt(F.aggregate(F.zip_with("a.v", "b.v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    p = p.select("rep", F.col("a.l").alias("construct_a"), F.col("b.l").alias("construct_b"), dist.alias("d"))
    obs = p.filter("rep = 0").select("construct_a", "construct_b", F.col("d").alias("observed_distance"))
    nul = p.filter("rep > 0").join(obs, ["construct_a", "construct_b"])
    return nul.groupBy("construct_a", "construct_b", "observed_distance").agg(F.avg((F.col("d") >= F.col("observed_distance")).cast("double")).alias("p_value"), F.avg("d").alias("null_mean"))
