"""Exact ranks, quantiles and rank statistics for groups of any size.

A plain window sorts a whole group in one task. Here a group is first reduced to its distinct
values, then cut into ranges by a fixed-size sketch; each range is sorted on its own and gets the
running total of the ranges before it. The cuts only steer the work: ranks are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.core import div, seeded_hash

RANGES = 256  # a power of two
P_RANGES = 1024  # ranges, even in rank, over which running extremes of p-values are taken


def _with_code(df: DataFrame, value: str) -> DataFrame:
    """Add a number that sorts like ``value``; for text, the bytes after the prefix all share."""
    if not isinstance(df.schema[value].dataType, T.StringType):
        return df.withColumn("_code", F.col(value).cast("double"))
    ends = df.agg(F.struct(F.hex(F.min(value)).alias("a"), F.hex(F.max(value)).alias("b"))).scalar()
    d = df.withColumn("_ends", ends)
    steps = F.sequence(F.lit(1), F.greatest(F.length("_ends.a"), F.lit(1)))
    shared = F.size(F.filter(steps, lambda i: F.substring(F.col("_ends.a"), F.lit(1), i) == F.substring(F.col("_ends.b"), F.lit(1), i)))
    tail = F.rpad(F.substring(F.hex(value), shared + 1, F.lit(12)), 12, "0")
    return d.withColumn("_code", F.conv(tail, 16, 10).cast("double")).drop("_ends")


def _range_of(value: str) -> Column:
    """How many of the sorted cuts lie below the value, by halving steps (eight looks, not 255)."""
    steps = [RANGES >> i for i in range(1, RANGES.bit_length())]
    look = lambda at, s: at + F.when(F.element_at("_cuts", at + s) < F.col(value), s).otherwise(0)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), look)


def value_ranks(df: DataFrame, by: list[str], value: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per distinct (by, value): ``ties``, ``below`` (count of smaller values), ``n``; for
    every carried aggregate also ``<name>`` and ``<name>_below``. Null values are left out."""
    carry = {"ties": F.count(F.lit(1)), **(carry or {})}
    names = list(carry)
    freq = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(*[e.alias(n) for n, e in carry.items()])
    freq = _with_code(freq, value)
    probs = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    sketch = F.percentile_approx("_code", probs, F.lit(10 * RANGES))
    if by:
        placed = freq.join(freq.groupBy(*by).agg(sketch.alias("_cuts")), by)
    else:
        placed = freq.withColumn("_cuts", freq.agg(sketch.alias("_cuts")).scalar())
    placed = placed.withColumn("_range", _range_of("_code")).drop("_cuts", "_code")
    totals = placed.groupBy(*by, "_range").agg(*[F.sum(n).alias(f"_t_{n}") for n in names])
    key = [F.col(b) for b in by] or [F.lit(0)]
    before = W.partitionBy(*key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*key)
    offsets = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names], F.sum("_t_ties").over(whole).alias("n"))
    inside = W.partitionBy(*by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    out = placed.join(offsets, [*by, "_range"])
    out = out.withColumns({("below" if n == "ties" else f"{n}_below"): F.coalesce(F.sum(n).over(inside), F.lit(0)) + F.col(f"_o_{n}") for n in names})
    return out.drop("_range", *[f"_o_{n}" for n in names])



def avg_rank() -> Column:
    """1-based rank with ties averaged, from the columns of ``value_ranks``."""
    return F.col("below") + (F.col("ties") + 1) / 2.0


def with_avg_rank(df: DataFrame, by: list[str], value: str, out: str, count: str | None = None) -> DataFrame:
    """Add the averaged rank of ``value`` inside ``by``; null values get a null rank."""
    ranks = value_ranks(df, by, value).select(*by, value, avg_rank().alias(out), *([F.col("n").alias(count)] if count else []))
    return df.join(ranks, [*by, value], "left")


def hash_order(df: DataFrame, by: list[str], key: str, seed) -> DataFrame:
    """Add ``pos`` (0-based place in seeded hash order inside ``by``) and ``n`` (group size).

    Hash values are uniform, so their first three digits cut every group into 4096 even ranges."""
    h = F.concat(F.lpad(F.hex(seeded_hash(seed, key)), 15, "0"), F.lit("|"), F.col(key).cast("string"))
    d = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    g = [F.col(b) for b in by] or [F.lit(0)]
    before = W.partitionBy(*g).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sizes = d.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    sizes = sizes.select(*by, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"), F.sum("_c").over(W.partitionBy(*g)).alias("n"))
    place = F.row_number().over(W.partitionBy(*by, "_b").orderBy("_h")) - 1
    return d.join(sizes, [*by, "_b"]).withColumn("pos", place + F.col("_o")).drop("_h", "_b", "_o")


def percentile_rank(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Rank mapped to [0, 1] with ties averaged; null when fewer than two values exist."""
    return with_avg_rank(df, by, value, "_prk", "_prn").withColumn(out, F.when(F.col("_prn") > 1, (F.col("_prk") - 1) / (F.col("_prn") - 1))).drop("_prk", "_prn")


def quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    A sketch cuts each group into ranges; one pass counts them (no row is shuffled); only the few
    ranges that hold a wanted rank are then reduced to distinct values and ordered."""
    d = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    sketch = F.percentile_approx("_v", F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(10 * RANGES)).alias("_cuts")
    cuts = d.groupBy(*by).agg(sketch)
    d = d.join(cuts, by) if by else d.withColumn("_cuts", cuts.scalar())
    d = d.select(*by, "_v", _range_of("_v").alias("_range"))
    g = [F.col(b) for b in by] or [F.lit(0)]
    before = W.partitionBy(*g).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = d.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumns({"_o": F.coalesce(F.sum("_c").over(before), F.lit(0)), "n": F.sum("_c").over(W.partitionBy(*g))})  # at most RANGES rows per group
    pos = {k: F.lit(float(p)) * (F.col("n") - 1) for k, p in probs.items()}
    inside = F.lit(False)
    for e in pos.values():
        inside = inside | ((F.col("_o") <= F.ceil(e)) & (F.floor(e) < F.col("_o") + F.col("_c")))
    wanted = counts.filter(inside).select(*by, "_range", "_o", "n")
    freq = d.join(wanted.select(*by, "_range"), [*by, "_range"], "left_semi").groupBy(*by, "_range", "_v").agg(F.count(F.lit(1)).alias("_t"))
    w = W.partitionBy(*by, "_range").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    r = freq.join(wanted, [*by, "_range"]).withColumn("_b", F.col("_o") + F.coalesce(F.sum("_t").over(w), F.lit(0)))
    at = lambda k: F.max(F.when((F.col("_b") <= k) & (k < F.col("_b") + F.col("_t")), F.col("_v")))
    cells = []
    for name, e in pos.items():
        lo, hi = at(F.floor(e)), at(F.ceil(e))
        cells.append((lo + (hi - lo) * F.max(e - F.floor(e))).alias(name))
    return r.groupBy(*by).agg(*cells, F.max("n").alias("n_values"))


def quantile_scalar(df: DataFrame, value: str, p: float) -> Column:
    """One exact quantile of a whole column as a scalar subquery."""
    return quantiles(df, [], value, {"q": p}).select("q").scalar()


def spearman(df: DataFrame, by: list[str], x: str, y: str, min_n: int = 3, out: str = "rho") -> DataFrame:
    """Rank correlation per group over complete pairs."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    r = with_avg_rank(with_avg_rank(d, by, x, "_rx"), by, y, "_ry")
    c = F.corr("_rx", "_ry")
    return r.groupBy(*by).agg(F.when((F.count(F.lit(1)) >= min_n) & (F.stddev_pop("_rx") > 0) & (F.stddev_pop("_ry") > 0), c).alias(out), F.count(F.lit(1)).alias("n"))


def roc_pr_auc(df: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """ROC-AUC by rank sums and average precision by distinct thresholds; null for one class only."""
    r = value_ranks(df.withColumn("_p", positive.cast("int")), by, score, {"pos": F.sum("_p")})
    neg, neg_below = F.col("ties") - F.col("pos"), F.col("below") - F.col("pos_below")
    g = r.withColumns({"_win": F.col("pos") * (neg_below + neg / 2.0), "_neg": neg})
    pos_all = r.groupBy(*by).agg(F.sum("pos").alias("_np"))
    g = g.join(pos_all, by) if by else g.withColumn("_np", pos_all.select("_np").scalar())
    # reached at this threshold: everything not smaller
    tp, reached = F.col("_np") - F.col("pos_below"), F.col("n") - F.col("below")
    return g.groupBy(*by).agg(
        div(F.sum("_win"), F.sum("pos") * F.sum("_neg")).alias("roc_auc"),
        F.when((F.sum("pos") > 0) & (F.sum("_neg") > 0), F.sum(F.col("pos") / F.col("_np") * tp / reached)).alias("pr_auc"), F.max("n").alias("n"))


def kolmogorov_smirnov(df: DataFrame, by: list[str], value: str, first: Column) -> DataFrame:
    """Largest gap between the two empirical distributions split by ``first``."""
    r = value_ranks(df.withColumn("_a", first.cast("int")), by, value, {"a": F.sum("_a")})
    tot = r.groupBy(*by).agg(F.sum("a").alias("_na"), F.max("n").alias("_n"))
    r = r.join(tot, by) if by else r.withColumns({c: tot.select(c).scalar() for c in ("_na", "_n")})
    fa = (F.col("a_below") + F.col("a")) / F.col("_na")
    fb = (F.col("below") + F.col("ties") - F.col("a_below") - F.col("a")) / (F.col("_n") - F.col("_na"))
    return r.groupBy(*by).agg(F.max(F.abs(fa - fb)).alias("ks"), F.max("_na").alias("n_a"), (F.max("_n") - F.max("_na")).alias("n_b"))


def mann_whitney(df: DataFrame, by: list[str], value: str, first: Column) -> DataFrame:
    """U of the first sample, rank-biserial effect and tie-corrected normal z."""
    r = value_ranks(df.withColumn("_a", first.cast("int")), by, value, {"a": F.sum("_a")})
    na, n = F.sum("a"), F.max("n")
    nb = n - na
    u = F.sum(F.col("a") * avg_rank()) - na * (na + 1) / 2.0
    ties = F.sum(F.pow("ties", 3) - F.col("ties"))
    sd = F.sqrt(na * nb / 12.0 * ((n + 1) - F.coalesce(div(ties, n * (n - 1)), F.lit(0.0))))
    return r.groupBy(*by).agg(u.alias("u"), (2 * div(u, na * nb) - 1).alias("rank_biserial"), div(u - na * nb / 2.0, sd).alias("z"), na.alias("n_a"), nb.alias("n_b"))
