"""Cleaning, masks and declarative eligibility."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.core import all_of, any_of, clip, col, lookup, unpivot

SENTINEL_FLOOR = -1e6
# Event to radar platform.
EVENT_SENSOR = {
    "harvey2017": "sentinel1", "imelda2019": "sentinel1", "beryl2024": "sentinel1",
    "ida2021": "sentinel1", "henri2021": "sentinel1", "sandy2012": "mixed_pre_s1",
    "ian2022": "sentinel1", "helene2024": "sentinel1", "milton2024": "sentinel1",
}
NON_NEGATIVE_COLUMNS = ("acs_gini_index", "acs_median_age", "acs_median_hh_income", "acs_median_home_value", "acs_median_rent", "acs_median_year_built")


class MissingLayer(ValueError):
    """A column an eligibility rule needs is absent."""


class EmptyDomain(ValueError):
    """All layers are present but no row qualifies."""


def replace(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: e for c, e in changes.items() if c in df.columns})


def sentinels_to_null(df: DataFrame, columns: list[str], floor: float = SENTINEL_FLOOR) -> DataFrame:
    return replace(df, {c: F.when(~(F.col(c) < floor), F.col(c)) for c in columns})


def sentinel_report(df: DataFrame, columns: list[str], floor: float = SENTINEL_FLOOR) -> DataFrame:
    """One row per column, from a single pass over the table."""
    v = F.col("value")
    return unpivot(df, [], columns).groupBy("column").agg(
        F.count_if(v < floor).alias("n_sentinel"), (F.count_if(v < floor) * 100.0 / F.count(F.lit(1))).alias("pct"),
        F.count_distinct(F.when(v < floor, v)).alias("n_sentinel_values"), F.count_if(v.isNull()).alias("n_null_before"),
        F.count_if(v.isNull() | (v < floor)).alias("n_null_after"))


def negatives_to_null(df: DataFrame, columns=NON_NEGATIVE_COLUMNS) -> DataFrame:
    return replace(df, {c: F.when(~(F.col(c) < 0), F.col(c)) for c in columns})


def policy_floor(df: DataFrame, columns: list[str], count_col: str, minimum: float) -> DataFrame:
    """Null the signal where the policy count is below the floor; an unknown count masks nothing."""
    if count_col not in df.columns:
        return df
    low = F.coalesce(F.col(count_col) < minimum, F.lit(False))
    return replace(df, {c: F.when(~low, F.col(c)) for c in columns})


def drop_permanent_water(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Rows with an unknown share stay."""
    return df if column not in df.columns else df.filter(~F.coalesce(F.col(column) > threshold, F.lit(False)))


def mechanism_gate(df: DataFrame, mechanism: str, surge_col="slosh_max_surge_m", coast_col="coastal_distance_m", coast_m: float = 20000.0) -> DataFrame:
    """Keep units a flood mechanism can reach; falls back from the surge layer to coast distance."""
    rules = {
        "surge": [(surge_col, F.col(surge_col).isNotNull()), (coast_col, F.col(coast_col) <= coast_m)],
        "pluvial": [(surge_col, F.col(surge_col).isNull()), (coast_col, F.col(coast_col) > coast_m)],
    }
    usable = [cond for name, cond in rules.get(mechanism, []) if name in df.columns]
    return df.filter(usable[0]) if usable else df


def same_sensor(df: DataFrame, event_col: str, sensors: dict[str, str] = EVENT_SENSOR, platform: str = "sentinel1") -> DataFrame:
    """Events of one platform; events without an entry drop out."""
    return df.filter(lookup(event_col, sensors) == platform)


def feature_columns(columns: list[str], drop_exact=(), drop_containing=()) -> list[str]:
    """Columns left after the leakage-prone ones for a task are taken out."""
    return [c for c in columns if c not in drop_exact and not any(s in c.lower() for s in drop_containing)]


# Features withheld per task family.
TASK_WITHHELD = {
    "health": {"drop_exact": ("acs_pct_no_insurance", "lag_acs_pct_no_insurance")},
    "income": {"drop_containing": ("income", "poverty")},
    "home_value": {"drop_containing": ("income", "poverty")},
}


def refuse_forbidden_classes(columns: list[str], contract: DataFrame, forbidden: list[str]) -> DataFrame:
    """Contract rows of used features whose temporal class is forbidden."""
    return contract.filter(F.col("feature").isin(*columns) & F.col("temporal_class").isin(*forbidden))


def require_allowed_classes(columns: list[str], contract: DataFrame, forbidden: list[str]) -> None:
    """Raise when a used feature's temporal class is forbidden."""
    bad = refuse_forbidden_classes(columns, contract, forbidden).select("feature").limit(20).collect()
    if bad:
        raise ValueError(f"features of a forbidden temporal class: {sorted(r[0] for r in bad)}")


def complete_rows(df: DataFrame, flags: list[str]) -> DataFrame:
    return df.filter(all_of([F.col(f) for f in flags]))


def structure_features(df: DataFrame, pop="population", lat="latitude", lon="longitude") -> DataFrame:
    return df.withColumns({"struct_log_population": F.log1p(F.greatest(F.col(pop), F.lit(0.0))),
                           "struct_latitude": F.col(lat).cast("double"), "struct_longitude": F.col(lon).cast("double")})


def terrain_composites(df: DataFrame, wetness: str, slope: str) -> DataFrame:
    w, s = F.col(wetness), F.col(slope)
    return df.withColumns({"twi_mean": w, "twi_pct_high_proxy": clip(w / 15.0, 0, 1), "slope_mean_pct": s,
                           "terrain_flood_index": F.when(w.isNotNull() & s.isNotNull(), F.greatest(w * (1 - clip(s / 100.0, 0, 1)), F.lit(0.0)))})


def drive_minutes(km, detour: float = 1.4, speed_kmh: float = 50.0) -> Column:
    return col(km) * detour / speed_kmh * 60.0


def with_field_status(df: DataFrame, columns: list[str], missing: str = "missing") -> DataFrame:
    return df.withColumns({f"_fs_{c}": F.when(F.col(c).isNotNull(), "present").otherwise(missing) for c in columns})


def observability(df: DataFrame, flood: list[str], proxy: list[str], gauge: str, rain: str) -> DataFrame:
    """Share of flood modalities among the columns that hold any value, and a row flag for both sensors silent."""
    flood, proxy = [c for c in flood if c in df.columns], [c for c in proxy if c in df.columns]
    seen = lambda cols: sum((F.max(F.col(c).isNotNull().cast("int")) for c in cols), F.lit(0))
    frac = df.agg((seen(flood) / F.greatest(seen(flood + proxy), F.lit(1))).alias("f")).scalar()
    silent = all_of([F.col(c).isNull() for c in (gauge, rain) if c in df.columns] or [F.lit(True)])
    return df.withColumns({"obs_feature_modal_frac": frac, "obs_missing_sensor_flag": silent})


@dataclass(frozen=True)
class Rule:
    """One column predicate of a deployment domain; null never qualifies."""

    column: str
    op: str
    threshold: float | None = None
    layer: str = ""

    def __post_init__(self):
        if self.op not in ("ge", "le", "gt", "lt", "eq", "notnull", "truthy"):
            raise ValueError(f"unknown op {self.op}")
        if self.op in ("ge", "le", "gt", "lt") and self.threshold is None:
            raise ValueError(f"{self.op} on {self.column} needs a threshold")

    def number(self) -> Column:
        return F.col(self.column).try_cast("double")

    def test(self, df: DataFrame) -> Column:
        if self.column not in df.columns:
            raise MissingLayer(f"{self.column} (layer {self.layer or 'unspecified'}) is absent")
        c, x = F.col(self.column), self.number()
        if self.op == "truthy":
            kind = df.schema[self.column].dataType
            if isinstance(kind, T.BooleanType):
                hit = c
            elif isinstance(kind, T.NumericType):
                hit = c != 0
            else:
                s = F.lower(F.trim(c))
                hit = (F.when(s.isin("y", "yes", "true", "t", "1"), True).when(c.isNull() | s.isin("n", "no", "false", "f", "0", "", "nan", "none"), False)
                       .otherwise(F.raise_error(F.concat(F.lit(f"{self.column}: unknown boolean token "), s))))
        else:
            hit = {"ge": x >= self.threshold, "le": x <= self.threshold, "gt": x > self.threshold, "lt": x < self.threshold,
                   "eq": c == self.threshold, "notnull": c.isNotNull()}[self.op]
        return F.coalesce(hit, F.lit(False))


@dataclass(frozen=True)
class Domain:
    """Rules joined by and/or, or the whole universe."""

    name: str
    rules: tuple[Rule, ...] = ()
    combine: str = "and"
    full_universe: bool = False

    def __post_init__(self):
        if self.combine not in ("and", "or") or self.full_universe == bool(self.rules):
            raise ValueError(f"{self.name}: give either rules joined by and/or, or full_universe")

    def mask(self, df: DataFrame) -> Column:
        if self.full_universe:
            return F.lit(True)
        tests = [r.test(df) for r in self.rules]
        return all_of(tests) if self.combine == "and" else any_of(tests)

    def select(self, df: DataFrame) -> DataFrame:
        return df.filter(self.mask(df))

    def select_checked(self, df: DataFrame) -> DataFrame:
        out = self.select(df)
        if out.isEmpty():
            raise EmptyDomain(f"{self.name}: no row qualifies")
        return out

    def report(self, df: DataFrame) -> DataFrame:
        """One row per rule plus the combined row, from one aggregate."""
        cells = [F.struct(F.lit(r.column).alias("rule_column"), F.lit(r.op).alias("op"), F.count_if(r.test(df)).alias("n_eligible"),
                          F.count_if((r.number() if r.op in ("ge", "le", "gt", "lt") else F.col(r.column)).isNull()).alias("n_null_dropped")) for r in self.rules]
        whole = F.struct(F.lit("*").alias("rule_column"), F.lit(self.combine).alias("op"), F.count_if(self.mask(df)).alias("n_eligible"), F.lit(0).cast("long").alias("n_null_dropped"))
        return df.agg(F.array(*cells, whole).alias("r")).select(F.inline("r"))
