"""Seeded resampling at scale.

A replicate's draws are hashes of (seed, replicate, slot). What is resampled are summaries (block
sums), not rows: a replicate of a billion rows in fifty states moves fifty rows. Means over rows
are dealt down a tree (``replicates``); only rank statistics still meet their draws by join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.core import div, seeded_even, seeded_hash
from plumbline.operators.ranking import hash_order
from plumbline.operators.replicates import LEAF_ROWS, places, replicate_sums, word
from plumbline.session import spread


def draws(positioned: DataFrame, by: list[str], reps: int, seed, keep: list[str]) -> DataFrame:
    """Resample with replacement: (by, rep, slot) joined to the row at the drawn position.
    ``positioned`` carries ``pos`` (0-based, dense per group) and ``n``."""
    slots = positioned.select(*by, F.col("pos").alias("slot"), "n").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    slots = slots.withColumn("pos", F.pmod(seeded_hash(seed, "rep", "slot"), F.col("n")))
    return slots.select(*by, "rep", "slot", "pos").join(positioned.select(*by, "pos", *keep), [*by, "pos"])


def number_blocks(blocks: DataFrame, by: list[str], block: str) -> DataFrame:
    """Dense positions of block summaries; their count is bounded by the block code (states, folds)."""
    w = W.partitionBy(*([F.col(b) for b in by] or [F.lit(0)]))
    return blocks.withColumns({"pos": (F.row_number().over(w.orderBy(block)) - 1).cast("long"), "n": F.count(F.lit(1)).over(w)})


def fit_sums(preds: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Sums from which R2 and RMSE of any union of groups follow."""
    y, e = F.col(y), F.col(y) - F.col(p)
    return preds.groupBy(*by).agg(F.count(F.lit(1)).alias("m"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.sum(e * e).alias("sse"))


def r2_of_sums(min_rows: int = 0, flat: float | None = None) -> Column:
    m, sy = F.sum("m"), F.sum("sy")
    tot = F.sum("syy") - sy * sy / m
    return F.when(m >= min_rows, F.when(tot > 1e-9, 1 - F.sum("sse") / tot).otherwise(F.lit(flat)))


def block_bootstrap_r2(preds: DataFrame, by: list[str], block: str, reps: int, seed: int = 42, min_rows: int = 10) -> DataFrame:
    """R2 of every replicate. Groups with the same blocks share draws, so they stay paired."""
    b = number_blocks(fit_sums(preds, [*by, block]), by, block)
    return draws(b, by, reps, seed, ["m", "sy", "syy", "sse"]).groupBy(*by, "rep").agg(r2_of_sums(min_rows).alias("r2"))


def percentile_ci(reps: DataFrame, by: list[str], value: str, level: float = 0.95, prefix: str = "") -> DataFrame:
    """Percentile interval over replicates (their number is the replicate count, so small)."""
    a = (1 - level) / 2
    return reps.groupBy(*by).agg(F.percentile(value, a).alias(f"{prefix}ci_lower"), F.percentile(value, 1 - a).alias(f"{prefix}ci_upper"), F.avg(value).alias(f"{prefix}boot_mean"), F.count(value).alias(f"{prefix}n_reps"))


def bootstrap_mean(df: DataFrame, by: list[str], value: str, key: str, reps: int, seed: int = 42, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Mean of every replicate over rows drawn with replacement; rows are dealt, not repeated (``replicates``)."""
    sums = replicate_sums(df.filter(F.col(value).isNotNull()), by, [value], key, reps, seed, leaf_rows)
    return sums.select(*by, "rep", (F.col(f"sum_{value}") / F.col("n")).alias("mean"))


def paired_bootstrap_delta(df: DataFrame, by: list[str], first: str, second: str, key: str, reps: int, seed: int = 42, level: float = 0.95, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Mean difference of two columns with its interval; pairs are drawn together."""
    d = df.withColumn("_d", F.col(second) - F.col(first))
    ci = percentile_ci(bootstrap_mean(d, by, "_d", key, reps, seed, leaf_rows), by, "mean", level)
    obs = d.groupBy(*by).agg(F.avg("_d").alias("delta"), F.count("_d").alias("n"))
    out = obs.join(ci, by) if by else obs.withColumns({c: ci.select(c).scalar() for c in ci.columns})
    return out.withColumn("excludes_zero", (F.col("ci_lower") > 0) | (F.col("ci_upper") < 0))


def fold_direction(df: DataFrame, by: list[str], delta: str) -> DataFrame:
    """How many folds move the same way as the mean."""
    g = df.groupBy(*by).agg(F.avg(delta).alias("mean_delta"), F.count_if(F.col(delta) > 0).alias("n_positive"), F.count_if(F.col(delta) < 0).alias("n_negative"), F.count(delta).alias("n_folds"))
    same = F.when(F.col("mean_delta") >= 0, F.col("n_positive")).otherwise(F.col("n_negative"))
    return g.withColumn("direction_stability", div(same, "n_folds"))


def permute_within(df: DataFrame, blocks: list[str], key: str, value: str, reps: int, seed: int = 42) -> DataFrame:
    """(rep, key, value) with the values of every block shuffled inside it."""
    rep = df.select(*blocks, key, value).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    g = [*blocks, "rep"]
    to = hash_order(rep.select(*g, key), g, key, F.concat(F.lit(f"{seed}t"), F.col("rep").cast("string"))).select(*g, key, "pos")
    src = hash_order(rep, g, key, F.concat(F.lit(f"{seed}f"), F.col("rep").cast("string"))).select(*g, value, "pos")
    return to.join(src, [*g, "pos"]).drop("pos")


def add_one_p(observed: Column, null_values: Column) -> Column:
    """(count of null draws at least as extreme + 1) / (draws + 1), two-sided."""
    return (F.count_if(F.abs(null_values) >= F.abs(observed) - 1e-12) + 1) / (F.count(null_values) + 1)


def permutation_p(df: DataFrame, by: list[str], group: Column, value: str, key: str, reps: int, seed: int = 42) -> DataFrame:
    """Label-shuffling test of a mean difference: (by, observed, p_value); rows without a label or a value do not take part.

    Rows have dense places. In a replicate those whose place a keyed permutation takes below the number of labelled rows carry the label, so labels are
    shuffled without a sort or a join; a task sends one sum per group and replicate."""
    d = df.withColumns({"_g": group.cast("int"), "_x": F.col(value).cast("double")}).filter("_g IS NOT NULL AND _x IS NOT NULL").select(*by, key, "_g", "_x")
    gap = F.avg(F.when(F.col("_g") == 1, F.col("_x"))) - F.avg(F.when(F.col("_g") == 0, F.col("_x")))
    obs = d.groupBy(*by).agg(gap.alias("observed"), F.sum("_g").alias("_n1"), F.sum("_x").alias("_sum"), F.count(F.lit(1)).alias("_all"))
    rows = hash_order(d, by, key, seed).select(*by, F.col("pos").cast("long").alias("_pos"), "_x")
    own = [F.struct(*[F.col(c) for c in by]).alias("_by")] if by else [F.lit(0).alias("_by")]
    rows = (rows.join(obs, by) if by else rows.crossJoin(F.broadcast(obs))).select(*own, "_pos", "_x", "_n1", "_all")  # without groups obs is one row
    kind = rows.schema["_by"].dataType.simpleString()

    def sums(batches):
        for pdf in batches:
            code, names = pd.factorize(pdf["_by"].map(str))
            for k in range(len(names)):
                part = pdf[code == k]
                pos, x, n1, n = part["_pos"].to_numpy(np.int64), part["_x"].to_numpy(float), int(part["_n1"].iloc[0]), int(part["_all"].iloc[0])
                step = max(1, (1 << 20) // len(part))
                found = [(places(np.broadcast_to(pos, (len(r), len(pos))), n, word(seed, r)[:, None]) < n1) @ x for r in np.array_split(np.arange(1, reps + 1), -(-reps // step))]
                yield pd.DataFrame({"_by": [part["_by"].iloc[0]] * reps, "rep": np.arange(1, reps + 1), "_s": np.concatenate(found)})

    sims = rows.mapInPandas(sums, f"_by {kind}, rep int, _s double").groupBy("_by", "rep").agg(F.sum("_s").alias("_s"))
    sims = sims.select("_by.*", "rep", "_s") if by else sims.drop("_by")
    sims = sims.join(obs, by) if by else sims.crossJoin(F.broadcast(obs))
    null = F.try_divide(F.col("_s"), F.col("_n1")) - F.try_divide(F.col("_sum") - F.col("_s"), F.col("_all") - F.col("_n1"))
    return sims.withColumn("null", null).groupBy(*by, "observed").agg(add_one_p(F.col("observed"), F.col("null")).alias("p_value"))


def sign_flip_p(df: DataFrame, by: list[str], diff: str, key: str, exact_up_to: int = 20, reps: int = 999, seed: int = 42, alternative: str = "greater") -> DataFrame:
    """Sign-flip test of a mean paired difference: (by, n, observed, method, p_value).

    ``greater`` asks how many sign patterns over the sizes of the differences have a mean of at least the observed one, ``two-sided`` how many
    are at least as far from zero. All 2^n patterns count up to ``exact_up_to`` pairs (method ``exact``); beyond, ``reps``
    random ones and the observed (method ``sampled``), or none when ``reps`` is 0 (null p). A pair's random sign depends on its
    ``key``, so pairs of equal difference flip apart. The list of an exact group is at most ``exact_up_to`` long."""
    if alternative not in ("greater", "two-sided"):
        raise ValueError(f"alternative must be greater or two-sided, got {alternative}")
    g = by or ["_all"]
    d = df.filter(F.col(diff).isNotNull()).select(*by, F.col(key).alias("_key"), F.col(diff).alias("_d"))
    d = d if by else d.withColumn("_all", F.lit(0))
    n = d.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("observed"))
    extreme = (F.col("null") >= F.col("observed") - 1e-12) if alternative == "greater" else (F.abs("null") >= F.abs("observed") - 1e-12)
    rows = d.join(n, g)
    arr = rows.filter(F.col("n") <= exact_up_to).groupBy(*g, "n", "observed").agg(F.array_sort(F.collect_list(F.abs("_d"))).alias("_a"))
    pat = arr.withColumn("_mask", F.explode(F.expr("sequence(0, shiftleft(1, cast(n AS int)) - 1)")))
    signed = F.transform("_a", lambda x, i: F.when(F.getbit(F.col("_mask"), i) == 1, x).otherwise(-x))
    exact = pat.withColumn("null", F.aggregate(signed, F.lit(0.0), lambda s, v: s + v) / F.col("n")).groupBy(*g).agg(F.avg(extreme.cast("double")).alias("p_value"), F.lit("exact").alias("method"))
    # a row becomes as many as there are replicates: rows are dealt to all tasks first, and a sign is the last bit of the hash, read off its last digit
    sampled = spread(rows.filter((F.col("n") > exact_up_to) & F.lit(reps > 0))).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(max(1, reps)))))
    flip = F.when(seeded_even(seed, "rep", "_key"), 1.0).otherwise(-1.0)
    sampled = sampled.groupBy(*g, "rep", "observed").agg(F.avg(flip * F.abs("_d")).alias("null"))
    sampled = sampled.groupBy(*g).agg(((F.count_if(extreme) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"), F.lit("sampled").alias("method"))
    return n.join(exact.unionByName(sampled), g, "left").select(*by, "n", "observed", F.coalesce("method", F.lit("none")).alias("method"), "p_value")
