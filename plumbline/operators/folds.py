"""Deterministic splits and folds. Every draw is a seeded hash of the id, so a rerun, another
cluster or another partitioning gives the same split.

Units are never collected. Greedy placing works on block, county or state summaries; their number
is bounded by the code length (at most 100,000 five-digit codes), and one array of them is placed
in a single pass over a heap of the loads."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.core import seeded_hash
from plumbline.operators.ranking import hash_order

# Fixed values.
TEST_SHARE, MEGA_SHARE, MIN_BLOCK, MIN_FOLD = 0.20, 0.40, 5, 5
PROTOCOL_FOLDS = {"imputation": 5, "extrapolation": 4, "superres": None}


def holdout(df: DataFrame, by: list[str], key: str, seed, share: float = TEST_SHARE, label: str = "test", rest: str = "train", out: str = "split", rounding: str = "floor") -> DataFrame:
    """The first ``share`` of ids in hash order (at least one per group) are held out."""
    r = hash_order(df, by, key, seed)
    n = F.floor(F.col("n") * share) if rounding == "floor" else F.bround(F.col("n") * share)
    return r.withColumn(out, F.when(F.col("pos") < F.greatest(n, F.lit(1)), label).otherwise(rest)).drop("pos", "n")


def block_keys(units: DataFrame, n_folds: int, key: str = "zcta_id", county: str = "county_fips") -> DataFrame:
    """County blocks when there are at least as many as folds, else three-digit prefixes; a block
    above 40 % of all units is split by four-digit prefix."""
    counties = units.agg(F.count_distinct(county)).scalar()
    total = units.agg(F.count(F.lit(1))).scalar()
    b = units.select(key, F.when(counties >= n_folds, F.coalesce(F.col(county), F.lit("unknown"))).otherwise(F.substring(key, 1, 3)).alias("block"))
    big = b.groupBy("block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_t", total).filter(F.col("_n") > F.floor(F.col("_t") * MEGA_SHARE)).select("block", F.lit(True).alias("_big"))
    return b.join(big, "block", "left").select(key, F.when(F.col("_big"), F.concat_ws("_", "block", F.substring(key, 1, 4))).otherwise(F.col("block")).alias("block"))


@F.pandas_udf(T.StructType([T.StructField("load", T.ArrayType(T.LongType())), T.StructField("place", T.ArrayType(T.IntegerType()))]))
def _lightest(sizes: pd.Series, loads: pd.Series) -> pd.DataFrame:
    """For every row: each size in turn joins the load that is least then, the first of equals. A heap holds the loads, so a size costs the logarithm of their number."""
    out = []
    for items, start in zip(sizes, loads):
        if items is None or start is None or not len(start):
            out.append((None, None))
            continue
        heap = [(int(v), k) for k, v in enumerate(start)]
        heapq.heapify(heap)
        place = []
        for n in items:
            load, k = heap[0]
            heapq.heapreplace(heap, (load + int(n), k))
            place.append(k)
        out.append(([v for _, v in sorted((k, v) for v, k in heap)], place))
    return pd.DataFrame(out, columns=["load", "place"])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _lightest_in_stratum(sizes: pd.Series, strata: pd.Series, folds: pd.Series) -> pd.Series:
    """For every row: each size in turn joins the fold that is lightest in its stratum, then lightest at all, then first."""
    out = []
    for items, own, n_folds in zip(sizes, strata, folds):
        whole, parts, place = [0] * n_folds, {}, []
        for n, s in zip(items, own):
            part = whole if s is None else parts.setdefault(s, [0] * n_folds)
            at = min(range(n_folds), key=lambda f: (part[f], whole[f], f))
            whole[at] += int(n)
            if s is not None:
                part[at] += int(n)
            place.append(at)
        out.append(place)
    return pd.Series(out)


def _place(items: Column, bins: Column | int, size: str = "n") -> Column:
    """Struct (load, place) after each of ``items`` in turn has joined the bin that is lightest then, the first of equals; ``bins`` is their number or their starting loads."""
    start = F.array_repeat(F.lit(0).cast("long"), bins) if isinstance(bins, int) else bins
    return _lightest(F.transform(items, lambda x: x[size]), start)


def _by(items: Column, *order: str) -> Column:
    """Array of structs sorted by the named fields; ``-name`` for falling order of a number."""
    keyed = F.transform(items, lambda x: F.struct(*[(-x[o[1:]] if o[0] == "-" else x[o]).alias(f"o{k}") for k, o in enumerate(order)], x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def merge_targets(sizes: DataFrame, minimum: int) -> DataFrame:
    """(block, n, h, merged): blocks below ``minimum``, largest first, join the big block that is smallest at that moment; without big blocks nothing moves.

    ``sizes`` (block, n, h) has a row per block, at most 100,000 by the code length, and is folded as one array."""
    every = sizes.agg(F.collect_list(F.struct("block", "n", "h")).alias("all"))
    split = every.select("all", _by(F.filter("all", lambda x: x["n"] >= minimum), "block").alias("big"), _by(F.filter("all", lambda x: x["n"] < minimum), "-n", "block").alias("small"))
    split = split.withColumn("to", F.when((F.size("big") > 0) & (F.size("small") > 0), _place(F.col("small"), F.transform("big", lambda x: x["n"]))["place"]).otherwise(F.transform("small", lambda x: F.lit(None).cast("int"))))
    moved = split.select(F.explode(F.arrays_zip("small", "to")).alias("z"), "big").select("z.small.*", F.coalesce(F.try_element_at("big", F.col("z.to") + 1)["block"], F.col("z.small.block")).alias("merged"))
    return split.select(F.explode("big").alias("x")).select("x.*", F.col("x.block").alias("merged")).unionByName(moved)


def place_folds(merged: DataFrame, n_folds: int, min_fold: int) -> DataFrame:
    """(merged, fold): merged blocks in hash order, each to the lightest fold. Of n_folds, n_folds - 1, ... 2 folds (never more than blocks) the first number counts
    whose smallest fold has ``min_fold`` units; if none has, two."""
    whole = merged.groupBy("merged").agg(F.sum("n").alias("n"), F.max(F.when(F.col("block") == F.col("merged"), F.col("h"))).alias("h"))
    one = whole.agg(F.collect_list(F.struct("merged", "n", "h")).alias("all")).select(_by(F.col("all"), "h", "merged").alias("items"))
    one = one.select("items", *[_place(F.col("items"), k).alias(f"k{k}") for k in range(2, max(2, n_folds) + 1)])
    best = F.col("k2")
    for k in range(2, n_folds + 1):
        best = F.when((F.array_min(F.col(f"k{k}")["load"]) >= min_fold) & (F.size("items") >= k), F.col(f"k{k}")).otherwise(best)
    return one.select(F.explode(F.arrays_zip("items", best["place"].alias("fold"))).alias("z")).select("z.items.merged", "z.fold")


def spatial_folds(units: DataFrame, n_folds: int = 5, seed: int = 42, key: str = "zcta_id", county: str = "county_fips", min_block: int = MIN_BLOCK, min_fold: int = MIN_FOLD) -> DataFrame:
    """(unit, block, merged block, fold) with whole blocks kept together."""
    b = block_keys(units, n_folds, key, county)
    sizes = b.groupBy("block").agg(F.count(F.lit(1)).alias("n")).withColumn("h", seeded_hash(seed, "block"))
    merged = merge_targets(sizes, min_block)
    plan = merged.join(place_folds(merged, n_folds, min_fold), "merged").select("block", "merged", "fold")
    return b.join(plan, "block").select(key, "block", "merged", "fold")


def event_folds(df: DataFrame, units: DataFrame, n_folds: int = 5, seed: int = 42) -> DataFrame:
    """Random, spatial-block and leave-event-out assignments for every (unit, event) row."""
    r = holdout(units.select("zcta_id").distinct(), [], "zcta_id", seed, out="fold_random")
    s = spatial_folds(units, n_folds, seed).select("zcta_id", F.col("fold").alias("fold_spatial_blocked"))
    return df.select("zcta_id", "event").join(r, "zcta_id").join(s, "zcta_id").withColumn("fold_leave_event_out", F.col("event"))


def fold_metadata(folds: DataFrame, fold: str) -> DataFrame:
    return folds.groupBy(F.col(fold).cast("string").alias("fold")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("zcta_id").alias("n_zctas"))


def county_summary(units: DataFrame, stratum: str, state: str = "state_fips") -> DataFrame:
    """State, size and most common stratum of every county."""
    c = units.groupBy("county_fips", stratum).agg(F.count(F.lit(1)).alias("_n"), F.min(state).alias("_s"))
    return c.groupBy("county_fips").agg(F.min("_s").alias("state"), F.sum("_n").alias("n_zctas"), F.min(F.struct((-F.col("_n")).alias("k"), F.col(stratum).alias("v")))["v"].alias("stratum"))


def balance_by_stratum(items: DataFrame, n_folds: int) -> DataFrame:
    """(county_fips, fold): counties in hash order, each to the fold lightest in its stratum, then lightest at all, then first.

    ``items`` (county_fips, stratum, n_zctas, h) has a row per county."""
    one = items.agg(F.collect_list(F.struct("county_fips", "stratum", F.col("n_zctas").cast("long").alias("n"), "h")).alias("all"))
    one = one.select(_by(F.col("all"), "h", "county_fips").alias("items"))
    placed = one.select("items", _lightest_in_stratum(F.transform("items", lambda x: x["n"]), F.transform("items", lambda x: x["stratum"].cast("string")), F.lit(n_folds)).alias("fold"))
    return placed.select(F.explode(F.arrays_zip("items", "fold")).alias("z")).select("z.items.county_fips", "z.fold")


def imputation_split(units: DataFrame, counties: DataFrame, n_folds: int = 5, seed: int = 42) -> DataFrame:
    """Stratified test counties; the others are spread over folds, balanced by stratum."""
    c = holdout(counties, ["stratum"], "county_fips", seed, rounding="even")
    rest = c.filter("split = 'train'").select("county_fips", "stratum", "n_zctas", seeded_hash(seed, "county_fips").alias("h"))
    folds = balance_by_stratum(rest, n_folds).select("county_fips", F.concat(F.lit("valid"), (F.col("fold") + 1).cast("string")).alias("split"))
    both = c.filter("split = 'test'").select("county_fips", "split").unionByName(folds)
    return units.select("zcta_id", "county_fips").join(both, "county_fips", "left").select("zcta_id", F.coalesce("split", F.lit("test")).alias("split_imputation"))


def extrapolation_split(units: DataFrame, test_states: list[str], n_folds: int = 4, state: str = "state_fips") -> DataFrame:
    """Fixed test states; the others, largest first, go to the lightest fold."""
    s = units.filter(~F.col(state).isin(*test_states)).groupBy(F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("n"))

    one = s.agg(F.collect_list(F.struct("state", "n")).alias("all")).select(_by(F.col("all"), "-n", "state").alias("items"))
    p = one.select(F.explode(F.arrays_zip("items", _place(F.col("items"), n_folds)["place"].alias("fold"))).alias("z")).select("z.items.state", F.concat(F.lit("valid"), (F.col("z.fold") + 1).cast("string")).alias("split"))
    return units.select("zcta_id", F.col(state).alias("state")).join(p, "state", "left").select("zcta_id", F.coalesce("split", F.lit("test")).alias("split_extrapolation"))


def superres_split(units: DataFrame, counties: DataFrame, seed: int = 42, share: float = TEST_SHARE) -> DataFrame:
    c = holdout(counties, ["stratum"], "county_fips", seed + 7, share, rounding="even").select("county_fips", F.col("split").alias("split_superres"))
    return units.select("zcta_id", "county_fips").join(c, "county_fips", "left").select("zcta_id", F.coalesce("split_superres", F.lit("train")).alias("split_superres"))


def split_leaks(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that sit in more than one fold."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("n_folds")).filter("n_folds > 1")


def split_balance(df: DataFrame, split: str, stratum: str) -> DataFrame:
    """Spread of a stratum's share over folds: smallest, largest and their ratio."""
    c = df.groupBy(split, stratum).agg(F.count(F.lit(1)).alias("c"))
    s = c.withColumn("share", F.col("c") / F.sum("c").over(W.partitionBy(split)))
    every = df.agg(F.count_distinct(split)).scalar()
    g = s.groupBy(stratum).agg(F.min("share").alias("lo"), F.max("share").alias("max_share"), F.count(F.lit(1)).alias("_k")).withColumn("_f", every)
    low = F.when(F.col("_k") < F.col("_f"), 0.0).otherwise(F.col("lo"))
    return g.select(stratum, low.alias("min_share"), "max_share", (F.col("max_share") / F.greatest(low, F.lit(1e-6))).alias("ratio"))


def get_split(df: DataFrame, protocol: str, fold: int = 1, target: str | None = None) -> dict[str, DataFrame]:
    """Train, validation and test frames of a protocol."""
    if protocol not in PROTOCOL_FOLDS:
        raise ValueError(f"protocol must be one of {sorted(PROTOCOL_FOLDS)}")
    top = PROTOCOL_FOLDS[protocol]
    if top is not None and not 1 <= fold <= top:
        raise ValueError(f"{protocol} has folds 1-{top}, got {fold}")
    c, valid = F.col(f"split_{protocol}"), "valid" if top is None else f"valid{fold}"
    d = df if target is None else df.filter(F.col(target).isNotNull())
    return {"train": d.filter(~c.isin(valid, "test")), "val": d.filter(c == valid), "test": d.filter(c == "test")}


def leakage_audit(preds: DataFrame, solver: str, unit: str, task: str) -> DataFrame:
    """Repeated (unit, task) rows per solver and the share of missing values."""
    return preds.groupBy(solver).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(unit).alias("n_units"), F.count_distinct(unit, task).alias("expected_rows"), F.count_distinct(task).alias("n_targets"),
        F.avg((F.col("y_true").isNull() | F.col("y_pred").isNull()).cast("double")).alias("null_share")).withColumn("pass", (F.col("n_rows") == F.col("expected_rows")) & (F.col("null_share") < 0.05))


def ids_in_both(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    return train.select(key).distinct().join(test.select(key), key, "left_semi")


def leave_scenario_out(df: DataFrame, scenario: str, key: str, test_scenarios: list[str], seed: int = 42, share: float = 0.2) -> DataFrame:
    """Test scenarios whole; of the others a hash share is validation."""
    is_test = F.col(scenario).isin(*test_scenarios)
    rest = holdout(df.filter(~is_test), [], key, seed, share, "validation")
    return rest.unionByName(df.filter(is_test).withColumn("split", F.lit("test")))


def stratified_sample(df: DataFrame, stratum: Column, key: str, per_stratum: int, seed: int = 42) -> DataFrame:
    """A fixed number of rows per stratum in hash order."""
    return hash_order(df.withColumn("stratum", stratum), ["stratum"], key, seed).filter(F.col("pos") < per_stratum).drop("pos", "n")


def fold_eligibility(df: DataFrame, by: list[str], fold: str, label: str) -> DataFrame:
    """Class support of every fold's train and test side, from per-fold counts."""
    f = df.groupBy(*by, fold).agg(F.count_if(F.col(label) == 1).alias("test_positive"), F.count_if(F.col(label) == 0).alias("test_negative"))
    w = W.partitionBy(*([F.col(b) for b in by] or [F.lit(0)]))  # one row per fold
    f = f.withColumns({f"train_{s}": F.sum(f"test_{s}").over(w) - F.col(f"test_{s}") for s in ("positive", "negative")})
    one = lambda side: (F.col(f"{side}_positive") == 0) | (F.col(f"{side}_negative") == 0)
    return f.withColumn("eligibility", F.when(one("train"), "SKIP_TRAIN_SINGLE_CLASS").when(one("test"), "SKIP_TEST_SINGLE_CLASS").otherwise("ELIGIBLE"))


def usable_targets(df: DataFrame, targets: list[str], min_rows: int = 20) -> DataFrame:
    long = df.select(*[F.col(c).cast("double").alias(c) for c in targets]).unpivot([], targets, "target", "v")
    g = long.groupBy("target").agg(F.count("v").alias("n"), (F.min("v") < F.max("v")).alias("_vary"))
    return g.select("target", "n", ((F.col("n") >= min_rows) & F.coalesce("_vary", F.lit(False))).alias("usable"))
