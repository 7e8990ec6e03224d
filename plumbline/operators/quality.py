"""Checks that return finding rows (check, subject, status, counts)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.core import div, unpivot
from plumbline.operators.aggregate import stratum_stats
from plumbline.operators.inference import iqr_overlap, welch

_NUMERIC = (T.NumericType,)


def _stack(rows: list[Column], df: DataFrame, fields: list[str]) -> DataFrame:
    """Many one-row summaries from a single aggregate, as rows."""
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r")).select(*fields)


def range_checks(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    rows = []
    for c, (lo, hi) in limits.items():
        if c in df.columns:
            v = F.col(c).cast("double")
            below, above = F.count_if(v < lo), F.count_if(v > hi)
            rows.append(F.struct(F.lit(c).alias("column"), below.alias("n_below"), above.alias("n_above"), F.min(v).alias("min"), F.max(v).alias("max"), F.when(F.count(v) == 0, "SKIP").when(below + above > 0, "FAIL").otherwise("PASS").alias("status")))
    return _stack(rows, df, ["column", "n_below", "n_above", "min", "max", "status"])


def consistency_checks(df: DataFrame, rules: list[tuple[str, Column, Column, str]]) -> DataFrame:
    """(name, condition, check, severity): rows where the condition holds must pass the check."""
    rows = []
    for name, cond, check, severity in rules:
        c, ok = F.coalesce(cond, F.lit(False)), F.coalesce(check, F.lit(False))
        n, bad = F.count_if(c), F.count_if(c & ~ok)
        rows.append(F.struct(F.lit(name).alias("rule"), n.alias("n_condition"), bad.alias("n_violations"), F.when(n == 0, "SKIP").when(bad == 0, "PASS").otherwise("FAIL" if severity == "ERROR" else "WARN").alias("status")))
    return _stack(rows, df, ["rule", "n_condition", "n_violations", "status"])


def family_coherence(df: DataFrame, families: dict[str, list[str]], limit: float = 0.4) -> DataFrame:
    rows = []
    for name, cols in families.items():
        rates = [F.avg(F.col(c).isNotNull().cast("double")) for c in cols if c in df.columns]
        if len(rates) >= 2:
            spread = F.greatest(*rates) - F.least(*rates)
            rows.append(F.struct(F.lit(name).alias("family"), spread.alias("spread"), F.when(spread > limit, "WARN").otherwise("PASS").alias("status")))
    return _stack(rows, df, ["family", "spread", "status"])


def key_checks(df: DataFrame, keys: list[str]) -> DataFrame:
    """Null keys and rows beyond the first per key."""
    nulls = [F.struct(F.lit(f"null:{k}").alias("check"), F.count_if(F.col(k).isNull()).alias("n")) for k in keys]
    d = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0))).scalar()
    out = df.agg(F.array(*nulls).alias("r")).withColumn("_d", d).select(F.inline(F.concat("r", F.array(F.struct(F.lit("duplicates").alias("check"), F.col("_d").alias("n"))))))
    return out.withColumn("status", F.when(F.col("n") > 0, "FAIL").otherwise("PASS"))


def constant_columns(df: DataFrame, columns: list[str], min_rows: int = 5) -> DataFrame:
    """Constant columns, and near-constant ones (at most 3 values over more than 20 rows)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "v").filter("v IS NOT NULL")
    per = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("k")).groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("k").alias("n"))
    return per.withColumn("status", F.when((F.col("n") >= min_rows) & (F.col("n_distinct") == 1), "CONSTANT").when((F.col("n_distinct") <= 3) & (F.col("n") > 20), "NEAR_CONSTANT").otherwise("PASS"))


def assembly_coverage(df: DataFrame, thresholds: DataFrame, scenario: str, columns: list[str]) -> DataFrame:
    """Non-null rate of each column per scenario against its threshold: fail below, warn below 1.5 times."""
    g = df.groupBy(scenario).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns]).unpivot([scenario], columns, "column", "coverage")
    d = g.join(thresholds, [scenario, "column"], "left")
    t, v = F.col("threshold"), F.col("coverage")
    return d.withColumn("status", F.when(v == 0, "ALL_NULL").when(t.isNull() | (t == 0), "PASS").when(v < t, "FAIL").when(v < t * 1.5, "WARN").otherwise("PASS"))


def missing_columns(df: DataFrame, contract: DataFrame, exempt: tuple[str, ...] = ("operational", "post_event")) -> DataFrame:
    """Contract features the table lacks; operational and post-event ones may be absent."""
    return contract.filter(~F.col("temporal_class").isin(*exempt) & ~F.col("feature").isin(*df.columns))


def box_check(df: DataFrame, lat: str, lon: str, box: tuple[float, float, float, float], scope: str = "scenario") -> DataFrame:
    """Share of points inside the bounding box; storm-wide data only has to touch it."""
    inside = F.col(lat).between(box[0], box[1]) & F.col(lon).between(box[2], box[3])
    g = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).agg(F.avg(inside.cast("double")).alias("share_inside"), F.count(F.lit(1)).alias("n"))
    s = F.col("share_inside")
    storm = F.when(s > 0, "PASS").otherwise("FAIL")
    tight = F.when(s >= 0.8, "PASS").when(s >= 0.3, "WARN").otherwise("FAIL")
    return g.withColumn("status", F.when(F.col("n") == 0, "WARN").otherwise(storm if scope == "storm" else tight))


# ---- partition, crosswalk and vintage audits ---------------------------------------------------

def multi_county_audit(xwalk: DataFrame, limit: float = 0.10) -> DataFrame:
    n = xwalk.groupBy("zcta_id").agg(F.count_distinct("county_fips").alias("k"))
    return n.agg(F.count(F.lit(1)).alias("n_units"), F.avg((F.col("k") > 1).cast("double")).alias("share_multi")).withColumn("status", F.when(F.col("share_multi") > limit, "FAIL").otherwise("PASS"))


def scale_audit(df: DataFrame, county: str, features: list[str], limit: float = 0.1) -> DataFrame:
    """Variance of county means over unit variance; a low ratio means the county level loses the signal."""
    from plumbline.operators.aggregate import variance_ratios

    return variance_ratios(df, county, features).withColumn("status", F.when(F.col("ratio") < limit, "FAIL").otherwise("PASS"))


def broadcast_audit(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Columns that carry one value (or at most three over more than ten units) inside a group."""
    long = unpivot(df, [group], columns, "column", "v").filter("v IS NOT NULL")
    g = long.groupBy(group, "column", "v").agg(F.count(F.lit(1)).alias("k")).groupBy(group, "column").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("k").alias("n"))
    return g.withColumn("status", F.when((F.col("n_distinct") == 1) | ((F.col("n_distinct") <= 3) & (F.col("n") > 10)), "FAIL").otherwise("PASS"))


def join_rate_audit(left: DataFrame, right: DataFrame, key: str, expected: float) -> DataFrame:
    hit = right.select(key).distinct().withColumn("_h", F.lit(1))
    return left.join(hit, key, "left").agg(F.avg(F.coalesce("_h", F.lit(0))).alias("join_rate"), F.count(F.lit(1)).alias("n")).withColumn("status", F.when(F.col("join_rate") < expected, "FAIL").otherwise("PASS"))


def vintage_audit(sources: DataFrame, event_year: str, vintage: str, warn: int = 3, fail: int = 5) -> DataFrame:
    gap = F.abs(F.col(event_year) - F.col(vintage))
    return sources.withColumn("gap_years", gap).withColumn("status", F.when(gap > fail, "FAIL").when(gap > warn, "WARN").otherwise("PASS"))


def missingness_audit(df: DataFrame, by: list[str], outcome: str, covariate: str, alpha: float = 0.05) -> DataFrame:
    """Does the covariate differ between units with and without the outcome?"""
    return welch(df.filter(F.col(covariate).isNotNull()), by, F.col(outcome).isNotNull(), covariate).withColumn("status", F.when(F.col("p_approx") < alpha, "FAIL").otherwise("PASS"))


def event_overlap_audit(df: DataFrame, event: str, value: str, floor: float = 0.2) -> DataFrame:
    return iqr_overlap(df, event, value).withColumn("status", F.when(F.col("iqr_overlap") < floor, "FAIL").otherwise("PASS"))


def support_audit(df: DataFrame, stratum: Column, present: Column, min_support: int) -> DataFrame:
    """Rows of each stratum (event, coast/inland, levee, county) that hold what the audit needs."""
    g = df.groupBy(stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(present).alias("n_support"))
    return g.withColumn("status", F.when(F.col("n_support") >= min_support, "PASS").otherwise("FAIL"))


def manifest_columns(columns: list[str], manifest: DataFrame, field: str = "name") -> DataFrame:
    """Manifest entries without a column and columns without an entry."""
    spark = manifest.sparkSession
    have = spark.createDataFrame([(c,) for c in columns], f"{field} string")
    return manifest.select(field).join(have, field, "left_anti").withColumn("finding", F.lit("not_in_table")).unionByName(have.join(manifest.select(field), field, "left_anti").withColumn("finding", F.lit("not_in_manifest")))


# ---- schema constraints ------------------------------------------------------------------------

def check_constraints(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """CHECK rules: a row violates a rule when it is false (null passes, as in SQL)."""
    rows = [F.struct(F.lit(table).alias("table"), F.lit(n).alias("constraint"), F.count_if(~F.coalesce(c, F.lit(True))).alias("n_violations")) for n, c in rules.items()]
    return _stack(rows, df, ["table", "constraint", "n_violations"])


def unique_constraint(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return g.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(table).alias("table"), F.lit("unique:" + ",".join(keys)).alias("constraint"), "n_violations")


def foreign_key(child: DataFrame, parent: DataFrame, table: str, keys: list[str]) -> DataFrame:
    bad = child.na.drop(subset=keys).join(parent.select(*keys).distinct(), keys, "left_anti")
    return bad.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(table).alias("table"), F.lit("fk:" + ",".join(keys)).alias("constraint"), "n_violations")


# Enumerations of the served schema.
DECISIONS = ("EXECUTE", "CAUTION", "REFUSE")


def certificate_constraints(cert: DataFrame, snapshots: DataFrame, zctas: DataFrame) -> DataFrame:
    unit = lambda c: F.col(c).between(0.0, 1.0)
    rules = {f"unit:{c}": unit(c) for c in ("r", "s_sup", "n", "alpha", "kappa_compat")}
    rules |= {"sigma": F.col("sigma") >= 0, "decision": F.col("public_decision").isin(*DECISIONS), "simplex": F.abs(F.col("r") + F.col("s_sup") + F.col("n") - 1) <= 1e-6,
              "floor_or_reason": F.col("task_residual_floor").isNotNull() | F.col("task_residual_floor_unavailable_reason").isNotNull(), "gate_pairing": F.col("gate_reached").isNotNull() | F.col("gate_reason").isNull()}
    parts = [check_constraints(cert, "certificate", rules), unique_constraint(cert, "certificate", ["certificate_id"]), unique_constraint(cert, "certificate", ["scenario_id", "snapshot_t", "zcta_id", "embedding_arm", "target"]),
             foreign_key(cert, snapshots, "certificate", ["scenario_id", "snapshot_t"]), foreign_key(cert, zctas, "certificate", ["scenario_id", "zcta_id"])]
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---- artifact gates ----------------------------------------------------------------------------

def unresolved_templates(contract: DataFrame, text: str) -> DataFrame:
    """Gate 1: contract values that still hold a {placeholder}."""
    return contract.withColumn("severity", F.when(F.col(text).rlike(r"\{[A-Za-z_]+\}"), "FAIL_UNRESOLVED_TEMPLATE").otherwise("PASS"))


def declared_outputs(declared: DataFrame, inventory: DataFrame) -> DataFrame:
    """Gate 2: every declared key must exist; phases without declarations are a contract gap."""
    have = inventory.select("key").distinct().withColumn("_h", F.lit(True))
    d = declared.join(have, "key", "left")
    return d.withColumn("severity", F.when(F.col("key").isNull(), "WARN_CONTRACT_GAP").when(F.col("_h"), "PASS").otherwise("FAIL_MISSING_OUTPUT")).drop("_h")


def convention_outputs(conventions: DataFrame, declared: DataFrame, inventory: DataFrame) -> DataFrame:
    """Gate 3: conventional keys of undeclared phases, and keys nobody declared."""
    undeclared = conventions.join(declared.filter("key IS NOT NULL").select("phase").distinct(), "phase", "left_anti")
    have = inventory.select("key").distinct()
    found = undeclared.join(have.withColumn("_h", F.lit(True)), "key", "left").select("phase", "key", F.when(F.col("_h"), "WARN_CONTRACT_GAP").otherwise("FAIL_MISSING_OUTPUT").alias("severity"))
    known = declared.filter("key IS NOT NULL").select("key").unionByName(undeclared.select("key"))
    extra = have.join(known, "key", "left_anti").select(F.lit(None).cast("string").alias("phase"), "key", F.lit("WARN_UNDECLARED_ARTIFACT").alias("severity"))
    return found.unionByName(extra)


def cell_matrix(contracted: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Gate 4: contracted cells present, missing or extra."""
    c, a = contracted.select(*keys).distinct().withColumn("_c", F.lit(True)), actual.select(*keys).distinct().withColumn("_a", F.lit(True))
    j = c.join(a, keys, "outer")
    return j.select(*keys, F.when(F.col("_c") & F.col("_a"), "PASS").when(F.col("_c"), "FAIL_MISSING_OUTPUT").otherwise("WARN_SCOPE_EXTRA").alias("severity"))


def content_gate(contracted: DataFrame, cells: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Gate 5: contracted cells absent from an artifact, or there with a null metric."""
    j = contracted.select(*keys).distinct().join(cells.select(*keys, metric, F.lit(True).alias("_h")), keys, "left")
    return j.select(*keys, F.when(F.col("_h").isNull(), "FAIL_CONTENT_INCOMPLETE").when(F.col(metric).isNull(), "FAIL_CONTENT_DEGENERATE").otherwise("PASS").alias("severity"))


def ordering_gate(rules: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Gate 6: internal timestamps decide; modification times only suggest; otherwise unverifiable."""
    a = lambda s: artifacts.select(F.col("key").alias(s), F.to_timestamp("internal_timestamp").alias(f"{s}_i"), F.to_timestamp("last_modified").alias(f"{s}_m"))
    j = rules.join(a("before"), "before", "left").join(a("after"), "after", "left")
    both = lambda x: F.col(f"before_{x}").isNotNull() & F.col(f"after_{x}").isNotNull()
    sev = F.when(both("i"), F.when(F.col("before_i") <= F.col("after_i"), "PASS").otherwise("FAIL_ORDERING_VIOLATION")).when(both("m"), "WARN_TIMESTAMP_FALLBACK").otherwise("WARN_TIMESTAMP_UNVERIFIABLE")
    return j.select("before", "after", sev.alias("severity"))


def cross_validation(ours: DataFrame, official: DataFrame, key: str, columns: list[str], tol: float = 0.1) -> DataFrame:
    """Per-column differences to an official table over shared units."""
    j = ours.select(key, *[F.col(c).cast("double").alias(f"a_{c}") for c in columns]).join(official.select(key, *[F.col(c).cast("double").alias(f"b_{c}") for c in columns]), key)
    rows = []
    for c in columns:
        d = F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))
        rows.append(F.struct(F.lit(c).alias("column"), F.count(d).alias("n"), F.max(d).alias("max_abs_diff"), F.avg(d).alias("mean_abs_diff"), F.count_if(d > tol).alias("n_over_tolerance"), F.corr(f"a_{c}", f"b_{c}").alias("corr")))
    return _stack(rows, j, ["column", "n", "max_abs_diff", "mean_abs_diff", "n_over_tolerance", "corr"])


def coverage_gate(df: DataFrame, first: str, second: str, keep: Column, min_n: int = 30) -> DataFrame:
    a, b = F.col(first).isNotNull(), F.col(second).isNotNull()
    g = df.agg(F.count_if(a).alias("n_first"), F.count_if(b).alias("n_second"), F.count_if(a & b).alias("n_pairable"), F.count_if(a & b & F.coalesce(keep, F.lit(False))).alias("n_after_masks"))
    return g.withColumn("passes", F.col("n_after_masks") >= min_n)
