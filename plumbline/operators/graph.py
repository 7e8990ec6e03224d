"""Spatial statistics on edge lists: lags, autocorrelation, clusters, pair statistics, regions.

Weights live in an edge table (src, dst, weight) with both directions present; a matrix is never
built. Values are (id, x) tables.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.core import clip, col, div, seeded_hash
from plumbline.operators.ranking import P_RANGES, hash_order, quantile_scalar, quantiles, value_ranks
from plumbline.operators.replicates import places, word
from plumbline.operators.spatial import bbox_pairs
from plumbline.session import cut_lineage, fetched_file

#: permuted places that a task computes at once
DRAWS = 1 << 20
RANGE_UNITS = 50_000


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def row_normalise(edges: DataFrame) -> DataFrame:
    tot = edges.groupBy("src").agg(F.sum("weight").alias("_t"))
    return edges.join(tot, "src").select("src", "dst", (F.col("weight") / F.col("_t")).alias("weight"))


def _at(values: DataFrame, key: str, cols: list[str], end: str, by: list[str] = ()) -> DataFrame:
    return values.select(*by, F.col(key).alias(end), *[F.col(c).alias(f"{end}_{c}") for c in cols])


def spatial_lag(edges: DataFrame, values: DataFrame, cols: list[str], key: str = "zcta_id", missing: str = "skip", by: list[str] = ()) -> DataFrame:
    """Neighbour means of several columns.

    ``missing``: "skip" leaves null neighbours out and gives null without neighbours; "median"
    fills nulls by the column median first and gives 0 without neighbours; "mean" fills by the mean
    of the slice and weights by the edge weights."""
    by = list(by)
    v = values.select(*by, key, *cols)
    if missing == "median":
        v = v.withColumns({c: F.coalesce(F.col(c), quantile_scalar(values, c, 0.5)) for c in cols})
    elif missing == "mean":
        means = v.groupBy(*by).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"_m_{c}") for c in cols])
        v = v.join(means, by) if by else v.withColumns({f"_m_{c}": means.select(f"_m_{c}").scalar() for c in cols})
        v = v.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in cols})
    at = _at(v, key, cols, "dst", by)
    if missing == "mean":
        e = edges.join(at, "dst")
        agg = [div(F.sum(F.col("weight") * F.col(f"dst_{c}")), F.sum("weight")).alias(f"lag_{c}") for c in cols]
    else:
        e = edges.join(at, "dst")
        agg = [F.avg(f"dst_{c}").alias(f"lag_{c}") for c in cols]
    lag = e.groupBy(*by, F.col("src").alias(key)).agg(*agg)
    out = values.select(*by, key).join(lag, [*by, key], "left")
    return out.na.fill(0.0, [f"lag_{c}" for c in cols]) if missing == "median" else out


def centred(values: DataFrame, x: str, by: list[str]) -> DataFrame:
    """Rows with a value, with z = x - mean; the mean is taken per group."""
    v = values.filter(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")))
    m = v.groupBy(*by).agg(F.avg(x).alias("_mean"))
    v = v.join(m, by) if by else v.withColumn("_mean", m.scalar())
    return v.withColumn("z", F.col(x) - F.col("_mean")).drop("_mean")


def global_autocorrelation(edges: DataFrame, values: DataFrame, x: str, key: str = "zcta_id", by: list[str] = ()) -> DataFrame:
    """Moran's I, Geary's C and kappa_spatial per group, over units that have a value.

    Null below three units, for a constant vector, or without any edge inside the set."""
    by = list(by)
    v = centred(values, x, by).select(*by, key, "z")
    tot = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z") * F.col("z")).alias("_ss"))
    e = edges.join(_at(v, key, ["z"], "src", by), "src").join(_at(v, key, ["z"], "dst", by), [*by, "dst"])
    d = F.col("src_z") - F.col("dst_z")
    num = e.groupBy(*by).agg(F.sum("weight").alias("_s0"), F.sum(F.col("weight") * F.col("src_z") * F.col("dst_z")).alias("_num"), F.sum(F.col("weight") * d * d).alias("_sq"))
    if by:
        r = tot.join(num, by, "left")
    else:
        r = tot.withColumns({c: num.select(c).scalar() for c in ("_s0", "_num", "_sq")})
    ok = (F.col("n") >= 3) & (F.col("_ss") > 1e-12) & (F.col("_s0") > 0)
    moran = F.when(ok, F.col("n") / F.col("_s0") * F.col("_num") / F.col("_ss"))
    geary = F.when(ok, (F.col("n") - 1) / (2 * F.col("_s0")) * F.col("_sq") / F.col("_ss"))
    return r.select(*by, "n", moran.alias("moran_i"), clip(1 - F.abs(moran), 0, 1).alias("kappa_spatial"), geary.alias("geary_c"),
                    F.when(geary < 0.95, "positive_autocorrelation").when(geary > 1.05, "negative_autocorrelation").when(geary.isNotNull(), "no_significant_autocorrelation").alias("interpretation"))


def local_moran(edges: DataFrame, values: DataFrame, x: str, key: str = "zcta_id") -> DataFrame:
    """Local Moran with quadrant; missing values count as zero, weights are row-normalised."""
    v = values.select(key, F.coalesce(F.col(x), F.lit(0.0)).alias("x"))
    s = v.agg(F.struct(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"), F.count(F.lit(1)).alias("n"))).scalar()
    v = v.withColumn("_s", s).select(key, ((F.col("x") - F.col("_s.m")) / F.col("_s.sd")).alias("z"), F.col("_s.n").alias("n"))
    lag = row_normalise(edges).join(_at(v, key, ["z"], "dst"), "dst").groupBy(F.col("src").alias(key)).agg(F.sum(F.col("weight") * F.col("dst_z")).alias("lag"), F.count(F.lit(1)).alias("degree"))
    r = v.join(lag, key, "left").na.fill(0, ["lag", "degree"])
    up, lup = F.col("z") > 0, F.col("lag") > 0
    quad = F.when(up & lup, "HH").when(~up & lup, "LH").when(~up & ~lup, "LL").otherwise("HL")
    return r.select(key, "z", "lag", "degree", "n", ((F.col("n") - 1) / F.col("n") * F.col("z") * F.col("lag")).alias("local_i"), quad.alias("quadrant"))


#: up to so many values (32 MB) are broadcast; values that the driver collects at once
HELD_VALUES = PIECE = 1 << 22


def _numbered(units: DataFrame, key: str) -> DataFrame:
    """``units`` with dense places ``pos`` in the order of their keys, from sorted ranges instead of one sort."""
    return units.join(value_ranks(units.select(key), [], key).select(key, F.col("below").alias("pos")), key)


class _ValueFile:
    """Values by place in a fetched file; tasks map it, so what they read of it is shared and held by the system's cache only."""

    def __init__(self, name: str):
        self.name = name

    @property
    def value(self) -> np.ndarray:
        return np.asarray(np.memmap(SparkFiles.get(self.name), np.float64, "r"))


def _held_values(spark, numbered: DataFrame, value: str):
    """The values by place for tasks to read: a broadcast of up to ``HELD_VALUES``; of more, a file of eight bytes a unit, which the driver writes piece by piece."""
    n = numbered.count()

    def piece(at: int) -> np.ndarray:
        z = np.zeros(min(PIECE, n - at))
        rows = numbered.filter((F.col("pos") >= at) & (F.col("pos") < at + PIECE)).select("pos", value).toPandas()
        z[rows["pos"].to_numpy() - at] = rows[value].to_numpy()
        return z

    if n <= min(HELD_VALUES, PIECE):
        return spark.sparkContext.broadcast(piece(0))

    def write(path: str) -> None:
        with open(path, "wb") as out:
            for at in range(0, n, PIECE):
                out.write(piece(at).tobytes())

    return _ValueFile(fetched_file(spark, write))


def local_moran_p(lisa: DataFrame, permutations: int, seed: int, key: str = "zcta_id") -> DataFrame:
    """Conditional pseudo-p: the value stays, its neighbours are drawn from the other units without replacement.

    A unit's neighbours in a replicate are the first ``degree`` places of a permutation keyed by (seed, replicate, unit), so nothing is sorted and
    nothing depends on partitioning. Replicates are counted in the unit's task, with the values of all units at hand, so no draw becomes a row; units of one degree are drawn for together."""
    ranked = cut_lineage(_numbered(lisa, key).select(key, "z", "degree", "n", "local_i", F.col("pos").cast("long").alias("pos")))
    held = _held_values(lisa.sparkSession, ranked, "z")
    kind = dict(ranked.dtypes)[key]

    def count(batches):
        z = held.value
        for pdf in batches:
            own, n, local, pos, degrees = (pdf[c].to_numpy() for c in ("z", "n", "local_i", "pos", "degree"))
            least, ge = local - 1e-12 * np.maximum(1.0, np.abs(local)), np.zeros(len(pdf), np.int64)
            for degree in np.unique(degrees):
                alike, step = np.flatnonzero(degrees == degree), max(1, min(permutations, DRAWS // degree))
                many = max(1, DRAWS // (degree * step))
                for units in (alike[k : k + many] for k in range(0, len(alike), many)):
                    size, at = int(n[units[0]]), pos[units][:, None, None]
                    for first in range(1, permutations + 1, step):
                        reps = np.arange(first, min(first + step, permutations + 1))
                        j = places(np.broadcast_to(np.arange(degree), (len(units), len(reps), degree)), size - 1, word(seed, reps[None, :, None], at))
                        sums = z[j + (j >= at)].sum(axis=2)
                        ge[units] += ((size - 1) / size * own[units][:, None] * sums / degree >= least[units][:, None]).sum(axis=1)
            yield pdf[[key]].assign(ge=ge)

    tasks = max(lisa.sparkSession.sparkContext.defaultParallelism, 2 * ranked.count() // RANGE_UNITS + 1)
    p = ranked.filter("degree > 0").repartition(tasks).mapInPandas(count, f"`{key}` {kind}, ge long")
    extreme = F.least(F.col("ge"), F.lit(permutations) - F.col("ge"))
    return lisa.join(p, key, "left").withColumn("p_sim", F.when(F.col("ge").isNotNull(), (extreme + 1) / F.lit(permutations + 1.0)).otherwise(1.0)).drop("ge")


def global_autocorrelation_p(edges: DataFrame, values: DataFrame, x: str, permutations: int = 999, seed: int = 42, key: str = "zcta_id") -> DataFrame:
    """``global_autocorrelation`` of one set of units with permutation p-values: (..., moran_p, geary_p, permutations).

    A replicate puts the values on other units by a permutation keyed by (seed, replicate). Each task evaluates all replicates on its own edges and sends one array
    of sums, with the values of all units at hand, so no replicate becomes rows. One-sided as is usual: the smaller of
    the shares on either side, one added to both counts. Null where the statistic is."""
    v = centred(values, x, []).select(key, "z")
    ranked = cut_lineage(_numbered(v, key).select(key, "z", F.col("pos").cast("long").alias("pos")))
    held = _held_values(values.sparkSession, ranked, "z")
    at = lambda end: ranked.select(F.col(key).alias(end), F.col("pos").alias(f"{end}_pos"))
    inside = edges.join(at("src"), "src").join(at("dst"), "dst").select("src_pos", "dst_pos", "weight")
    n = ranked.count()
    # both statistics are the same from either end, so an edge and its reverse are one row; neighbours in position share a batch, which places each of its units once
    once = inside.groupBy(F.least("src_pos", "dst_pos").alias("src_pos"), F.greatest("src_pos", "dst_pos").alias("dst_pos")).agg(F.sum("weight").alias("weight"))
    cores = values.sparkSession.sparkContext.defaultParallelism
    once = once.repartitionByRange(max(cores, 2 * n // RANGE_UNITS + 1), "src_pos").sortWithinPartitions("src_pos")

    def ends(pdf, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        units, at = np.unique(pdf[["src_pos", "dst_pos"]].to_numpy(np.int64), return_inverse=True)
        went = places(np.broadcast_to(units, (len(reps), len(units))), n, word(seed, reps)[:, None])
        at = at.reshape(-1, 2)
        return went[:, at[:, 0]], went[:, at[:, 1]]

    pieces = lambda pdf: (np.arange(k, min(k + max(1, DRAWS // len(pdf)), permutations + 1)) for k in range(1, permutations + 1, max(1, DRAWS // len(pdf))))

    def sums(batches):
        z, moran, geary = held.value, np.zeros(permutations), np.zeros(permutations)
        for pdf in batches:
            if len(pdf):
                w = pdf["weight"].to_numpy(float)
                for reps in pieces(pdf):
                    a, b = (z[e] for e in ends(pdf, reps))
                    moran[reps - 1] += (a * b) @ w
                    geary[reps - 1] += ((a - b) ** 2) @ w
        yield pd.DataFrame({"rep": np.arange(1, permutations + 1), "num": moran, "sq": geary})

    sims = once.mapInPandas(sums, "rep int, num double, sq double").groupBy("rep").agg(F.sum("num").alias("num"), F.sum("sq").alias("sq"))
    own = global_autocorrelation(edges, values, x, key)
    tot = ranked.agg(F.sum(F.col("z") * F.col("z")).alias("ss")).crossJoin(inside.agg(F.sum("weight").alias("s0")))  # one row each
    sims = sims.crossJoin(F.broadcast(tot)).select((F.lit(float(n)) / F.col("s0") * F.col("num") / F.col("ss")).alias("i"), ((F.lit(n) - 1) / (2 * F.col("s0")) * F.col("sq") / F.col("ss")).alias("c"))
    reached = sims.crossJoin(F.broadcast(own)).agg(*[F.count_if(F.col(s) >= F.col(o) - 1e-12).alias(f"_{s}") for s, o in (("i", "moran_i"), ("c", "geary_c"))])
    p = lambda s, o: F.when(F.col(o).isNotNull(), (F.least(F.col(f"_{s}"), F.lit(permutations) - F.col(f"_{s}")) + 1) / F.lit(permutations + 1.0))
    return own.crossJoin(F.broadcast(reached)).withColumns({"moran_p": p("i", "moran_i"), "geary_p": p("c", "geary_c"), "permutations": F.lit(permutations)}).drop("_i", "_c")


def turbulence(global_p: DataFrame, lisa: DataFrame, p: str = "p_sim", alpha: float = 0.05) -> DataFrame:
    """One row: the global statistics with their p and the counts of significant local clusters."""
    on = F.col(p) < alpha
    local = lisa.agg(F.count_if(on & (F.col("quadrant") == "HH")).alias("n_hotspots"), F.count_if(on & (F.col("quadrant") == "LL")).alias("n_coldspots"), F.count_if(on & F.col("quadrant").isin("HL", "LH")).alias("n_outliers"), F.avg(on.cast("double")).alias("fraction_significant"))
    return global_p.select("moran_i", "moran_p", "geary_c", "geary_p").crossJoin(F.broadcast(local))


def bh_adjust(df: DataFrame, p: str, by: list[str] = (), out: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values; running minima are taken range by range; the ranges are even in rank, so small values, the usual case, spread over them."""
    by = list(by)
    r = value_ranks(df, by, p).withColumn("_q", F.col(p) * F.col("n") / (F.col("below") + F.col("ties")))
    r = r.withColumn("_b", F.floor(F.col("below") * P_RANGES / F.col("n")))
    tail = r.groupBy(*by, "_b").agg(F.min("_q").alias("_mq"))
    after = W.partitionBy(*([F.col(b) for b in by] or [F.lit(0)])).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    tail = tail.withColumn("_later", F.min("_mq").over(after)).drop("_mq")  # at most P_RANGES rows per group
    inside = W.partitionBy(*by, "_b").orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    adj = r.join(tail, [*by, "_b"]).select(*by, p, F.least(F.lit(1.0), F.least(F.min("_q").over(inside), F.coalesce("_later", F.lit(1.0)))).alias(out))
    return df.join(adj, [*by, p], "left")


def significant_clusters(lisa: DataFrame, p: str, cut: float) -> DataFrame:
    return lisa.withColumn("cluster_label", F.when(F.col(p) < cut, F.col("quadrant")).otherwise("ns"))


def lisa_rollup(lisa: DataFrame, by: list[str] = (), label: str = "cluster_label") -> DataFrame:
    c = F.col(label)
    share = lambda cond: F.avg(cond.cast("double"))
    return lisa.groupBy(*by).agg(share(c == "HH").alias("frac_HH"), share(c == "LL").alias("frac_LL"), share(c.isin("HL", "LH")).alias("frac_outlier"), share(c != "ns").alias("frac_significant"),
                                 F.count_if(c == "HH").alias("n_hotspots"), F.count_if(c == "LL").alias("n_coldspots"), F.count(F.lit(1)).alias("n_zctas"))


def attenuation(rollups: DataFrame, by: list[str], level: str, levels: list[str]) -> DataFrame:
    """Cluster share (HH + LL) per level and its step changes."""
    wide = rollups.withColumn("_f", F.col("frac_HH") + F.col("frac_LL")).groupBy(*by).pivot(level, levels).agg(F.first("_f"))
    wide = wide.select(*by, *[F.coalesce(F.col(l), F.lit(0.0)).alias(f"frac_{l}") for l in levels])
    for a, b in zip(levels, levels[1:]):
        d = F.col(f"frac_{b}") - F.col(f"frac_{a}")
        wide = wide.withColumns({f"delta_{a}_{b}": d, f"sign_{a}_{b}": F.when(d < 0, "attenuated").otherwise("persisted")})
    return wide


def deviance_residual(y, p) -> Column:
    y, q = col(y), clip(p, 1e-7, 1 - 1e-7)
    raw = -2.0 * (y * F.log(q) + (1 - y) * F.log(1 - q))
    return F.signum(y - q) * F.sqrt(F.greatest(raw, F.lit(0.0)))


def mean_residuals(preds: DataFrame, by: list[str], unit: str, classification: bool = False) -> DataFrame:
    r = deviance_residual("y_true", "y_pred") if classification else F.col("y_true") - F.col("y_pred")
    return preds.groupBy(*by, unit).agg(F.avg(r).alias("residual"), F.count(F.lit(1)).alias("n"))


# ---- pair statistics without pair lists -------------------------------------------------------

FINEST, PAIR_WORK = 19, 65_536

def _quads(points: DataFrame, depth: int) -> DataFrame:
    """Cells of a 2-D grid with 2**depth cells a side over the data extent, with their sums."""
    side = float(1 << depth)
    ix = F.least(F.floor(F.col("u") * side), F.lit(side - 1)).cast("long")
    iy = F.least(F.floor(F.col("v") * side), F.lit(side - 1)).cast("long")
    return points.withColumns({"ix": ix, "iy": iy}).groupBy("ix", "iy").agg(
        F.count(F.lit(1)).alias("places"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1")).withColumn("cell", F.col("ix") * F.lit(1 << 20) + F.col("iy"))


def pair_bins(points: DataFrame, x: str, y: str, value: str, width: float, bins: int, depth: int = 7) -> DataFrame:
    """Count and half mean squared difference of all point pairs by distance bin.

    Points of one position are one place with a count and sums, so work grows with the places. Cells, not points, are paired from coarse to fine. A pair of cells whose distances all fall in
    one bin is added in closed form from its sums; pairs beyond the last bin are dropped; only
    what is left at the finest level is resolved place by place."""
    p = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(value).isNotNull()).select(F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"), F.col(value).cast("double").alias("val"))
    ext = p.agg(F.struct(F.min("px").alias("x0"), F.min("py").alias("y0"), F.greatest(F.max("px") - F.min("px"), F.max("py") - F.min("py"), F.lit(1e-12)).alias("w"), F.avg("val").alias("m"))).scalar()
    # differences do not change when all values are moved, and sums of squares lose the least around the mean
    off = F.col("val") - F.col("_e.m")
    p = p.withColumn("_e", ext).groupBy("px", "py", "_e").agg(F.count(F.lit(1)).alias("n"), F.sum(off).alias("s"), F.sum(off * off).alias("q"))
    p = p.select("px", "py", "n", "s", "q", ((F.col("px") - F.col("_e.x0")) / F.col("_e.w")).alias("u"), ((F.col("py") - F.col("_e.y0")) / F.col("_e.w")).alias("v"))
    p = cut_lineage(p)
    rename = lambda d, t: d.select(*[F.col(c).alias(f"{t}_{c}") for c in d.columns])
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    gap = lambda l, h: F.greatest(a(l) - b(h), b(l) - a(h), F.lit(0.0))
    reach = lambda l, h: F.greatest(F.abs(a(l) - b(h)), F.abs(b(l) - a(h)))
    near, far = F.sqrt(gap("x0", "x1") ** 2 + gap("y0", "y1") ** 2), F.sqrt(reach("x0", "x1") ** 2 + reach("y0", "y1") ** 2)
    same = a("cell") == b("cell")
    pairs_n = F.when(same, a("n") * (a("n") - 1) / 2).otherwise(a("n") * b("n"))
    pairs_sq = F.when(same, a("n") * a("q") - a("s") * a("s")).otherwise(b("n") * a("q") + a("n") * b("q") - 2 * a("s") * b("s"))
    slack = 1e-9
    done, todo, above = [], None, 0
    for d in range(1, FINEST + 1, 2):
        cells = _quads(p, d)
        if todo is None:
            ids = cells.agg(F.collect_list("cell")).scalar()  # at most four cells at depth 1
            pairs = rename(cells, "a").withColumn("b_cell", F.explode(ids)).join(rename(cells, "b"), "b_cell")
        else:
            up = d - above
            kids = cells.withColumn("parent", F.shiftright("ix", up) * F.lit(1 << 20) + F.shiftright("iy", up))
            pairs = todo.join(rename(kids, "a"), F.col("pa") == F.col("a_parent")).join(rename(kids, "b"), F.col("pb") == F.col("b_parent")).drop("pa", "pb", "work", "a_parent", "b_parent")
        pairs = pairs.filter(a("cell") <= b("cell")).withColumns({"lo": F.floor(near / width - slack), "hi": F.floor(far / width + slack), "near": near})
        pairs = pairs.filter(F.col("near") < width * bins * (1 + slack))
        whole = (F.col("lo") == F.col("hi")) & (F.floor(near / width + slack) == F.floor(near / width - slack))
        done.append(pairs.filter(whole & (F.col("lo") < bins)).select(F.col("lo").cast("long").alias("bin"), pairs_n.alias("n"), pairs_sq.alias("sq")))
        todo = pairs.filter(~whole).select(F.col("a_cell").alias("pa"), F.col("b_cell").alias("pb"), (a("places") * b("places")).alias("work"))
        # both orders are needed below a mixed pair: children of (A, B) with A < B may sort either way
        todo = todo.unionByName(todo.filter("pa <> pb").select(F.col("pb").alias("pa"), F.col("pa").alias("pb"), "work"))
        above = d
        if d >= depth:  # go on only while some cell pair would still spell out many point pairs
            todo = cut_lineage(todo)
            if (todo.agg(F.max("work")).first()[0] or 0) <= PAIR_WORK:
                break
    last = above
    side = float(1 << last)
    cell = F.least(F.floor(F.col("u") * side), F.lit(side - 1)).cast("long") * F.lit(1 << 20) + F.least(F.floor(F.col("v") * side), F.lit(side - 1)).cast("long")
    pt = lambda t: p.select(cell.alias(f"{t}_cell"), *[F.col(c).alias(f"{t}_{c}") for c in ("px", "py", "n", "s", "q")])
    fine = todo.filter("pa <= pb").join(pt("a"), F.col("pa") == F.col("a_cell")).join(pt("b"), F.col("pb") == F.col("b_cell"))
    key = lambda t: F.struct(f"{t}_px", f"{t}_py")
    fine = fine.filter((F.col("pa") < F.col("pb")) | (key("a") <= key("b")))
    own = (F.col("pa") == F.col("pb")) & (key("a") == key("b"))
    dist = F.sqrt((a("px") - b("px")) ** 2 + (a("py") - b("py")) ** 2)
    cnt = F.when(own, a("n") * (a("n") - 1) / 2).otherwise(a("n") * b("n"))
    sq = F.greatest(F.lit(0.0), F.when(own, a("n") * a("q") - a("s") * a("s")).otherwise(b("n") * a("q") + a("n") * b("q") - 2 * a("s") * b("s")))
    done.append(fine.select(F.floor(dist / width).cast("long").alias("bin"), cnt.alias("n"), sq.alias("sq")).filter(F.col("bin") < bins))
    out = reduce(lambda l, r: l.unionByName(r), done).groupBy("bin").agg(F.sum("n").cast("long").alias("n_pairs"), F.sum("sq").alias("sq")).filter("n_pairs > 0")
    return out.select("bin", ((F.col("bin") + 0.5) * width).alias("bin_center"), "n_pairs", (F.col("sq") / F.col("n_pairs") / 2).alias("semivariance"))


def _hull(p: pd.DataFrame) -> pd.DataFrame:
    """Corners of the convex hull (monotone chain)."""
    pts = sorted(set(zip(p["x"], p["y"])))
    if len(pts) > 2:
        chain = []
        for seq in (pts, pts[::-1]):
            part = []
            for c in seq:
                while len(part) >= 2 and (part[-1][0] - part[-2][0]) * (c[1] - part[-2][1]) - (part[-1][1] - part[-2][1]) * (c[0] - part[-2][0]) <= 0:
                    part.pop()
                part.append(c)
            chain += part[:-1]
        pts = chain
    return pd.DataFrame(pts, columns=["x", "y"])


def block_diameters(units: DataFrame, fold: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Largest distance inside each fold (flat-earth km at the fold's mean latitude).

    The farthest pair sits on the convex hull, so every batch is cut to its hull corners before
    anything is shuffled."""
    mid = units.groupBy(fold).agg(F.avg(lat).alias("_m"), F.count(F.lit(1)).alias("n"))
    pts = units.join(mid, fold).select(F.col(fold).cast("string").alias("fold"), (F.col(lon) * 111.32 * F.cos(F.radians("_m"))).alias("x"), (F.col(lat) * 110.57).alias("y"))

    def per_batch(batches):
        for b in batches:
            for f, g in b.groupby("fold"):
                yield _hull(g).assign(fold=f)[["fold", "x", "y"]]

    def per_fold(key, g: pd.DataFrame) -> pd.DataFrame:
        h = _hull(g).to_numpy()
        best = 0.0
        for i in range(len(h)):
            best = max(best, float((((h - h[i]) ** 2).sum(axis=1)).max()))
        return pd.DataFrame({"fold": [key[0]], "diameter_km": [best**0.5]})

    corners = pts.mapInPandas(per_batch, "fold string, x double, y double")
    return corners.groupBy("fold").applyInPandas(per_fold, "fold string, diameter_km double")


def block_size_verdict(diameters: DataFrame, range_km: float) -> DataFrame:
    med = quantiles(diameters.filter("diameter_km > 0"), [], "diameter_km", {"median_block_km": 0.5}).select("median_block_km")
    r = F.lit(range_km) / F.col("median_block_km")
    return med.select("median_block_km", r.alias("ratio"), F.when(r > 1.5, "WARN_LEAKAGE").when(r < 0.3, "WARN_OVERSIZED").otherwise("PASS").alias("status"))


# ---- adjacency checks -------------------------------------------------------------------------

def adjacency_report(edges: DataFrame, units: DataFrame) -> DataFrame:
    """Self loops, one-way edges, islands, ends outside the unit table, degree statistics."""
    e = edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    one_way = e.filter("src <> dst").join(back, ["src", "dst"], "left_anti").agg(F.count(F.lit(1))).scalar()
    ids = units.select("zcta_id").distinct()
    outside = e.join(ids.withColumnRenamed("zcta_id", "src"), "src", "left_anti").agg(F.count(F.lit(1))).scalar()
    deg = ids.join(e.filter("src <> dst").groupBy(F.col("src").alias("zcta_id")).agg(F.count(F.lit(1)).alias("d")), "zcta_id", "left").na.fill(0, ["d"])
    loops = e.filter("src = dst").agg(F.count(F.lit(1))).scalar()
    return deg.agg(F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("d") == 0).alias("n_islands"), F.min("d").alias("min_degree"), F.max("d").alias("max_degree"), F.avg("d").alias("mean_degree")).withColumns(
        {"n_self_loops": loops, "n_one_way": one_way, "n_outside": outside})


def lag_correlation(edges: DataFrame, values: DataFrame, x: str, key: str = "zcta_id") -> DataFrame:
    lag = spatial_lag(edges, values, [x], key)
    return values.select(key, x).join(lag, key).agg(F.corr(x, f"lag_{x}").alias("lag_corr"), F.count(f"lag_{x}").alias("n"))


def leakage_rate(edges: DataFrame, units: DataFrame, fold: str, key: str = "zcta_id") -> DataFrame:
    """Per fold, the share of its units that have a neighbour outside it (train side)."""
    at = lambda s: units.select(F.col(key).alias(s), F.col(fold).alias(f"{s}_f"))
    leak = edges.join(at("src"), "src").join(at("dst"), "dst").filter(F.col("src_f") != F.col("dst_f")).select(F.col("src").alias(key)).distinct().withColumn("_l", F.lit(1))
    return units.select(key, fold).join(leak, key, "left").groupBy(fold).agg(F.avg(F.coalesce("_l", F.lit(0))).alias("leakage_rate"), F.count(F.lit(1)).alias("n_test"))


def adjacency_coverage(edges: DataFrame, units: DataFrame, pop: str) -> DataFrame:
    has = edges.select(F.col("src").alias("zcta_id")).union(edges.select("dst")).distinct().withColumn("_h", F.lit(1))
    u = units.filter(F.col(pop) > 0).join(has, "zcta_id", "left")
    return u.agg(F.count(F.lit(1)).alias("n_populated"), F.count("_h").alias("n_covered"), F.avg(F.coalesce("_h", F.lit(0))).alias("coverage"))


def permute_weights(edges: DataFrame, units: DataFrame, levels: list[float], seeds: int, key: str = "zcta_id") -> DataFrame:
    """Relabel floor(level*n) neighbour ids, drop self loops, renormalise; all (level, seed) at once.

    The chosen ids in hash order each take the next one's place (a single cycle), which moves every
    chosen id."""
    plan = F.array(*[F.struct(F.lit(float(l)).alias("level"), F.lit(s).alias("seed")) for l in levels for s in range(seeds)])
    d = units.select(F.col(key).alias("id")).withColumn("_p", F.explode(plan)).select("id", "_p.level", "_p.seed")
    r = hash_order(d, ["level", "seed"], "id", F.concat(F.lit("w"), F.col("seed").cast("string")))
    k = F.floor(F.col("level") * F.col("n"))
    chosen = r.withColumn("k", k).filter((F.col("pos") < F.col("k")) & (F.col("k") >= 2))
    chosen = cut_lineage(chosen.select("level", "seed", "id", "pos", "k"))
    nxt = chosen.select("level", "seed", F.col("pos").alias("np"), F.col("id").alias("new"))
    moved = chosen.withColumn("np", F.pmod(F.col("pos") + 1, F.col("k"))).join(nxt, ["level", "seed", "np"]).select("level", "seed", F.col("id").alias("dst"), "new")
    e = edges.withColumn("_p", F.explode(plan)).select("src", "dst", "weight", "_p.level", "_p.seed")
    e = e.join(moved, ["level", "seed", "dst"], "left").withColumn("dst", F.coalesce("new", "dst")).filter("src <> dst")
    g = e.groupBy("level", "seed", "src", "dst").agg(F.sum("weight").alias("weight"))
    return g.join(g.groupBy("level", "seed", "src").agg(F.sum("weight").alias("_t")), ["level", "seed", "src"]).withColumn("weight", F.col("weight") / F.col("_t")).drop("_t")


# ---- recoverability of regions ----------------------------------------------------------------

def region_distances(regions: DataFrame, rid: str, vector: str) -> DataFrame:
    """Squared distance of every two regions. The statistics on it (Mantel, stress) are
    defined on all region pairs; regions are aggregates, and block numbers spread the pairs."""
    blocks = 16
    r = regions.select(F.col(rid).alias("id"), F.col(vector).alias("vec")).withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    a = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.col("id").alias("i"), F.col("vec").alias("vi"), F.col("blk").alias("ba"), F.col("other").alias("bb"))
    b = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.col("id").alias("j"), F.col("vec").alias("vj"), F.col("other").alias("ba"), F.col("blk").alias("bb"))
    d2 = F.aggregate(F.zip_with("vi", "vj", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return a.join(b, ["ba", "bb"]).filter(F.col("i") < F.col("j")).select("i", "j", d2.alias("d2"))


def crossings(edges: DataFrame, at: DataFrame, by: list[str] = ()) -> DataFrame:
    """Properly crossing edge pairs without shared ends; candidates meet in grid cells."""
    pos = lambda s: at.select(F.col("id").alias(s), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
    seg = edges.join(pos("i"), "i").join(pos("j"), "j").select(
        F.struct(*by, "i", "j").alias("eid"), F.array(F.struct(F.col("ix").alias("x"), F.col("iy").alias("y")), F.struct(F.col("jx").alias("x"), F.col("jy").alias("y"))).alias("ring")).distinct()
    p = bbox_pairs(seg, seg, "eid", "eid").filter(F.col("aid") < F.col("bid"))
    for b in by:
        p = p.filter(F.col("aid")[b] == F.col("bid")[b])
    ends = F.array(F.col("bid")["i"], F.col("bid")["j"])
    p = p.filter(~F.array_contains(ends, F.col("aid")["i"]) & ~F.array_contains(ends, F.col("aid")["j"]))
    c = lambda r, n, a: F.col(r)[n][a]
    d1x, d1y = c("aring", 1, "x") - c("aring", 0, "x"), c("aring", 1, "y") - c("aring", 0, "y")
    d2x, d2y = c("bring", 1, "x") - c("bring", 0, "x"), c("bring", 1, "y") - c("bring", 0, "y")
    d3x, d3y = c("bring", 0, "x") - c("aring", 0, "x"), c("bring", 0, "y") - c("aring", 0, "y")
    den = d1x * d2y - d1y * d2x
    t, u = (d3x * d2y - d3y * d2x) / den, (d3x * d1y - d3y * d1x) / den
    hit = F.when(F.abs(den) >= 1e-12, (t > 0) & (t < 1) & (u > 0) & (u < 1)).otherwise(False)
    return p.filter(hit).select(*[F.col("aid")[b].alias(b) for b in by], F.col("aid")["i"].alias("i1"), F.col("aid")["j"].alias("j1"), F.col("bid")["i"].alias("i2"), F.col("bid")["j"].alias("j2"))


def kappa_reconstruct(edges: DataFrame, at: DataFrame, trials: int, seed: int = 42) -> DataFrame:
    """1 - excess crossings / possible pairs, the excess being over random graphs of equal size."""
    edges, at = cut_lineage(edges), cut_lineage(at)
    n_edges = edges.agg(F.count(F.lit(1))).scalar()
    ranked = value_ranks(at.select("id"), [], "id").select("id", F.col("below").alias("pos"), "n")
    ranked = cut_lineage(ranked)
    slots = edges.select(F.concat_ws("|", "i", "j").alias("slot")).withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials)))).withColumn("n", ranked.agg(F.max("n")).scalar())
    first = F.pmod(seeded_hash(f"{seed}a", "trial", "slot"), F.col("n"))
    step = F.pmod(seeded_hash(f"{seed}b", "trial", "slot"), F.col("n") - 1) + 1
    draw = slots.withColumns({"pi": first, "pj": F.pmod(first + step, F.col("n"))})
    rnd = draw.join(ranked.select(F.col("pos").alias("pi"), F.col("id").alias("i")), "pi").join(ranked.select(F.col("pos").alias("pj"), F.col("id").alias("j")), "pj")
    base = crossings(rnd.select("trial", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")), at, ["trial"]).agg(F.count(F.lit(1)) / F.lit(float(trials)).alias("b"))
    own = crossings(edges, at).agg(F.count(F.lit(1)).alias("n_crossings"))
    r = own.withColumns({"n_crossings_baseline": base.scalar(), "n_gabriel_edges": n_edges})
    possible = F.greatest(F.col("n_gabriel_edges") * (F.col("n_gabriel_edges") - 1) / 2, F.lit(1.0))
    return r.withColumn("kappa_reconstruct", clip(1 - F.greatest(F.col("n_crossings") - F.col("n_crossings_baseline"), F.lit(0.0)) / possible, 0, 1))


def mantel(d_first: DataFrame, d_second: DataFrame, ids: DataFrame, permutations: int, seed: int = 42) -> DataFrame:
    """Correlation of two distance tables (i, j, d), its one-sided permutation p, and stress-1."""
    pairs = d_first.select("i", "j", F.col("d").alias("x")).join(d_second.select("i", "j", F.col("d").alias("y")), ["i", "j"])
    obs = cut_lineage(pairs).agg(F.corr("x", "y").alias("mantel_r"), F.sqrt(div(F.sum((F.col("x") - F.col("y")) ** 2), F.sum(F.col("x") ** 2))).alias("stress"), F.count(F.lit(1)).alias("n_pairs"))
    rep = ids.select("id").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    h = F.struct(seeded_hash(seed, "rep", "id").alias("h"), F.col("id").alias("id"))
    by_rep = W.partitionBy("rep")
    rep = rep.withColumn("h", h).withColumns({"from_pos": F.row_number().over(by_rep.orderBy("id")), "to_pos": F.row_number().over(by_rep.orderBy("h"))})
    perm = rep.select("rep", F.col("id").alias("o"), F.col("from_pos").alias("p")).join(rep.select("rep", F.col("to_pos").alias("p"), F.col("id").alias("m")), ["rep", "p"]).select("rep", "o", "m")
    perm = cut_lineage(perm)
    moved = d_first.select("i", "j", F.col("d").alias("x")).join(perm.select("rep", F.col("o").alias("i"), F.col("m").alias("mi")), "i").join(perm.select("rep", F.col("o").alias("j"), F.col("m").alias("mj")), ["rep", "j"])
    y = d_second.select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("d").alias("y"))
    sim = moved.withColumns({"a": F.least("mi", "mj"), "b": F.greatest("mi", "mj")}).join(y, ["a", "b"]).groupBy("rep").agg(F.corr("x", "y").alias("r"))
    ge = sim.withColumn("_o", obs.select("mantel_r").scalar()).agg(F.count_if(F.col("r") >= F.col("_o"))).scalar()
    return obs.withColumn("mantel_p", (ge + 1) / F.lit(permutations + 1.0))


#: parts of a graph that grows in blocks, and least units of one; a step outwards, above every block number; no block yet
PARTS, PART_UNITS = 64, 4_096
STEP, NO_BLOCK = 1 << 31, 1 << 62


def _relaxed(state: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """(part, n, k) of one part with every k lowered to the least k of a unit along ``links`` (ns, nd) plus ``STEP`` for each link."""
    state = state.sort_values("n", ignore_index=True)
    n, k = state["n"].to_numpy(), state["k"].to_numpy().copy()
    links = links.sort_values("ns")
    to = np.searchsorted(n, links["nd"].to_numpy())
    begin, end = (np.searchsorted(links["ns"].to_numpy(), n, side=side) for side in ("left", "right"))
    front = np.flatnonzero(k < NO_BLOCK)
    while len(front):
        size = end[front] - begin[front]
        hit = to[np.repeat(begin[front] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        before = k[hit]
        np.minimum.at(k, hit, np.repeat(k[front], size) + STEP)
        front = np.unique(hit[k[hit] < before])
    return state.assign(k=k)


def grow_blocks(edges: DataFrame, units: DataFrame, n_blocks: int, seed: int = 42, key: str = "zcta_id") -> DataFrame:
    """Spatial blocks grown from hash-chosen seeds along the graph.

    Each round every unassigned unit next to a block joins the smallest such block number; the loop ends when nothing changes. That is the
    smallest (links from a seed, block of the seed) of a unit, so whole parts of the graph are grown at once: units lie in at most ``PARTS`` ranges of their ids, shorter ones first as numbers go, a range is grown to its end
    in one task, then what crosses ranges is passed on. Jobs are as many as ranges on a path, and not as its links. Units no block can reach are dealt out by hash."""
    u = units.select(F.col(key).alias("id")).withColumn("h", seeded_hash(seed, "id"))
    seeds = u.orderBy("h", "id").limit(n_blocks).select("id", F.struct("h", "id").alias("k"))  # a top-n, not a full sort
    first = seeds.withColumn("block", (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("k")) - 1).cast("long")).groupBy("id").agg(F.min("block").alias("block"))
    ids = cut_lineage(u.filter("id IS NOT NULL").select("id").distinct())
    parts = min(PARTS, -(-ids.count() // PART_UNITS)) or 1
    at = cut_lineage(ids.repartitionByRange(parts, F.length("id"), "id")).withColumn("n", F.monotonically_increasing_id())  # the partition's number is in the upper bits
    part = lambda n: F.shiftright(n, 33).alias("part")
    state = at.join(first, "id", "left").select(part("n"), "n", F.coalesce("block", F.lit(NO_BLOCK)).alias("k"))
    links = symmetric(edges).select("src", "dst").distinct().join(at.select(F.col("id").alias("src"), F.col("n").alias("ns")), "src").join(at.select(F.col("id").alias("dst"), F.col("n").alias("nd")), "dst")
    links = cut_lineage(links.select(part("ns"), part("nd").alias("to"), "ns", "nd"))
    inside, across = links.filter("part = to").select("part", "ns", "nd"), links.filter("part <> to").select("ns", "nd")
    moved = True
    while moved:
        state = cut_lineage(state.groupBy("part").cogroup(inside.groupBy("part")).applyInPandas(_relaxed, "part long, n long, k long"))
        told = state.filter(F.col("k") < NO_BLOCK).join(across, F.col("n") == F.col("ns")).groupBy(F.col("nd").alias("n")).agg((F.min("k") + STEP).alias("m"))
        told = cut_lineage(state.join(told, "n").filter("m < k").select("n", "m"))
        moved = not told.isEmpty()
        state = state.join(told, "n", "left").select("part", "n", F.coalesce("m", "k").alias("k")) if moved else state
    grown = state.filter(F.col("k") < NO_BLOCK).join(at, "n").select("id", (F.col("k") % STEP).cast("int").alias("block"))
    return u.join(grown, "id", "left").select(F.col("id").alias(key), F.coalesce("block", F.pmod(seeded_hash(seed, "id"), F.lit(n_blocks)).cast("int")).alias("block"))
