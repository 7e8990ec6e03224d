"""Assembly of unit and unit-event tables: spines, enrichment, crosswalks, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.core import clip, div, zfill


class FanOut(ValueError):
    """An enrichment holds several rows per key."""


def one_per_key(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """First (or last) row per key in ``order``. An aggregate, so a hot key is combined map-side
    instead of being sorted in one task."""
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c not in keys]
    tail = [c for c in rest if c not in lead]
    row = F.struct(*lead, *tail)
    picked = df.groupBy(*keys).agg((F.max if last else F.min)(row).alias("_r"))
    return picked.select(*[F.col(k) if k in keys else F.col("_r")[k].alias(k) for k in df.columns])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def enrich(left: DataFrame, parts: dict[str, DataFrame], keys: list[str], on_fan_out: str = "first") -> DataFrame:
    """Left-join enrichments on the unit key. Columns already present are not taken again."""
    out = left
    for name, part in parts.items():
        take = [c for c in part.columns if c in keys or c not in out.columns]
        part = part.select(*take)
        if on_fan_out == "abort":
            if not duplicate_keys(part, keys).isEmpty():
                raise FanOut(name)
        else:
            part = one_per_key(part, keys, sorted(c for c in take if c not in keys))
        out = out.join(part, keys, "left")
    return out


def refresh_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Drop stale copies of the columns the right side brings, then left-join it."""
    return left.drop(*[c for c in right.columns if c != key and c in left.columns]).join(right, key, "left")


def spine(ids: DataFrame, values: list, name: str) -> DataFrame:
    """Every id with every value of a short list (events, years); an explode, not a join."""
    return ids.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def year_spine(ids: DataFrame, first: int, last: int) -> DataFrame:
    return ids.withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))


def fill_from(left: DataFrame, facts: DataFrame, keys: list[str], zeros: list[str]) -> DataFrame:
    return left.join(facts, keys, "left").na.fill(0, zeros)


def county_to_unit(xwalk: DataFrame, county_facts: DataFrame, zeros: list[str]) -> DataFrame:
    return fill_from(xwalk.select("zcta_id", "county_fips"), county_facts, ["county_fips"], zeros)


def majority_county(parts: DataFrame, unit: str, county: str, area: str) -> DataFrame:
    """The county holding the largest part of each unit; equal parts go to the smaller code."""
    best = F.min(F.struct((-F.col(area)).alias("neg"), F.col(county).alias("county")))
    return parts.groupBy(unit).agg(best.alias("b"), F.count_distinct(county).alias("n_counties")).select(unit, F.col("b.county").alias(county), "n_counties")


def weighted_means(df: DataFrame, by: list[str], columns: list[str], weight: str) -> DataFrame:
    """Means whose weights are re-normalised over the non-null values of each column."""
    w = F.col(weight)
    return df.groupBy(*by).agg(*[div(F.sum(F.col(c) * w), F.sum(F.when(F.col(c).isNotNull(), w))).alias(c) for c in columns])


def tract_to_unit(values: DataFrame, xwalk: DataFrame, columns: list[str], key: str = "tract", unit: str = "zcta_id", weight: str = "pop") -> DataFrame:
    return weighted_means(values.join(xwalk, key), [unit], columns, weight)


def catchment_to_unit(first: DataFrame, second: DataFrame, fractions: DataFrame, columns: list[str]) -> DataFrame:
    """Outer join of two feature sets, then area-weighted means per unit."""
    both = first.join(second, "comid", "outer")
    return weighted_means(fractions.join(both, "comid", "left"), ["zcta_id"], columns, "fraction")


def normalise_fractions(parts: DataFrame, group: str, overlap: str, total: str, floor: float = 0.001) -> DataFrame:
    """Overlap share in [0, 1]; slivers dropped; shares of a group re-scaled to sum to one."""
    share = parts.withColumn("fraction", clip(F.col(overlap) / F.col(total), 0, 1)).filter(F.col("fraction") > floor)
    tot = share.groupBy(group).agg(F.sum("fraction").alias("_t"))
    return share.join(tot, group).withColumn("fraction", F.bround(F.col("fraction") / F.col("_t"), 6)).drop("_t")


def missing_and_extra(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    e, a = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return e.join(a, keys, "left_anti").withColumn("finding", F.lit("missing")).unionByName(a.join(e, keys, "left_anti").withColumn("finding", F.lit("extra")))


def many_to_one(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Inner join that refuses a dimension with repeated keys: a repeated key raises at run time."""
    checked = dim.groupBy(key).agg(F.min(F.struct(*[c for c in dim.columns if c != key])).alias("_d"), F.count(F.lit(1)).alias("_n"))
    bad = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return facts.join(checked.filter(bad).select(key, "_d.*"), key)


def align_union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def upsert_last(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keep the new row where both have one."""
    both = existing.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    return one_per_key(both, keys, ["_gen"], last=True).drop("_gen")


def schema_differences(frames: dict[str, DataFrame]) -> list[tuple[str, str]]:
    """(frame, column) for columns some other frame has and this one lacks."""
    every = {c for f in frames.values() for c in f.columns}
    return [(n, c) for n, f in sorted(frames.items()) for c in sorted(every - set(f.columns))]


def coverage_by(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Non-null rate of each column per group, long form."""
    wide = df.groupBy(*by).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot(by, columns, "column", "coverage")


def set_overlap(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Jaccard index and odds ratio of two row flags."""
    n = lambda c: F.count_if(c)
    both, only_a, only_b, none = n(a & b), n(a & ~b), n(~a & b), n(~a & ~b)
    return df.agg(both.alias("n_both"), n(a | b).alias("n_either"), div(both, n(a | b)).alias("jaccard"), div(both * none, only_a * only_b).alias("odds_ratio"))


def deployment_universe(observed: DataFrame, xwalk: DataFrame, features: DataFrame) -> DataFrame:
    """All units of every county that holds an observed unit; features stay null where absent."""
    counties = xwalk.join(observed.select("zcta_id").distinct(), "zcta_id", "left_semi").select("county_fips").distinct()
    return xwalk.join(counties, "county_fips", "left_semi").select("zcta_id", "county_fips").join(features, "zcta_id", "left")
