"""Hourly series, storm timing, ranks, bins and level-to-level tables.

Series are first brought to one row per (unit, event, hour), so a window partition holds at most
the hours of one event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.core import clip, col, div, haversine_km
from plumbline.operators.ranking import percentile_rank, quantiles

WET_MM, SURGE_M = 1.0, 0.3


def dense_hours(series: DataFrame, hour: str = "hour", value: str = "rain") -> DataFrame:
    """Every unit gets every hour of its event; missing or null hours are 0."""
    span = series.groupBy("event").agg(F.min(hour).alias("_a"), F.max(hour).alias("_z"))
    units = series.select("zcta_id", "event").distinct()
    s = units.join(span, "event").select("zcta_id", "event", F.explode(F.sequence("_a", "_z", F.expr("interval 1 hour"))).alias(hour))
    one = series.groupBy("zcta_id", "event", hour).agg(F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias(value))
    return s.join(one, ["zcta_id", "event", hour], "left").na.fill(0.0, [value])


def rolling_peaks(series: DataFrame, hour: str = "hour", value: str = "rain", windows: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    """Largest k-hour sums, storm duration, time to peak and intensity variation per unit and event.

    Dry hours need no rows: rain is never negative, so some best window ends at a recorded hour, and
    a range frame over the hour number sums what a frame over a dense series would. A window
    longer than the series counts with its total, as there."""
    one = series.groupBy("zcta_id", "event", F.floor(F.unix_timestamp(hour) / 3600).alias("_h")).agg(F.sum(F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0))).alias("_v"))
    w = W.partitionBy("zcta_id", "event").orderBy("_h")  # at most the hours of one event
    d = one.withColumns({f"_s{k}": F.sum("_v").over(w.rangeBetween(-(k - 1), 0)) for k in windows})
    wet = F.col("_v") > WET_MM
    g = d.groupBy("zcta_id", "event").agg(
        *[F.max(f"_s{k}").alias(f"peak_{k}h_mm") for k in windows], F.count_if(wet).alias("storm_duration_h"), F.min(F.when(wet, F.col("_h"))).alias("_first"),
        F.min(F.struct((-F.col("_v")).alias("v"), F.col("_h").alias("i")))["i"].alias("_peak"), F.stddev_pop(F.when(wet, F.col("_v"))).alias("_sd"), F.avg(F.when(wet, F.col("_v"))).alias("_m"))
    return g.select("zcta_id", "event", *[f"peak_{k}h_mm" for k in windows], "storm_duration_h", F.coalesce(F.col("_peak") - F.col("_first"), F.lit(0)).cast("int").alias("time_to_peak_h"),
                    F.when(F.col("storm_duration_h") >= 2, div("_sd", "_m")).otherwise(0.0).alias("rainfall_intensity_cv"))


def _hours(a: Column, b: Column) -> Column:
    return F.timestamp_diff("SECOND", a, b) / 3600.0


def _first_peak(value: str, ts: str) -> Column:
    return F.min(F.struct((-F.col(value)).alias("v"), F.col(ts).alias("t")))["t"]


def rain_timing(series: DataFrame, ts: str = "hour", value: str = "rain") -> DataFrame:
    v = F.col(value)
    g = series.groupBy("zcta_id", "event").agg(F.max(v).alias("rain_peak_intensity_mm_hr"), F.sum(v).alias("rain_total_mm"), F.count_if(v > WET_MM).cast("double").alias("rain_duration_hr"),
                                               F.min(ts).alias("_a"), _first_peak(value, ts).alias("_p"), F.coalesce(F.percentile(F.when(v > 0, v), 0.9), F.lit(0.0)).alias("rain_p90_intensity"))
    return g.withColumn("rain_peak_hour", _hours(F.col("_a"), F.col("_p"))).drop("_a", "_p")


def surge_timing(series: DataFrame, ts: str = "hour") -> DataFrame:
    d = series.withColumn("_s", F.col("observed_m") - F.col("predicted_m"))
    g = d.groupBy("zcta_id", "event").agg(F.max("_s").alias("surge_max_m"), F.count_if(F.col("_s") > SURGE_M).cast("double").alias("surge_duration_hr"), F.min(ts).alias("_a"), _first_peak("_s", ts).alias("_p"),
                                          (F.max("predicted_m") - F.min("predicted_m")).alias("tide_range_m"))
    return g.withColumn("surge_peak_hour", _hours(F.col("_a"), F.col("_p"))).drop("_a", "_p")


def compound_timing(rain: DataFrame, surge: DataFrame) -> DataFrame:
    """Lag, overlap and joint intensity; a side that is missing counts as zero."""
    m = rain.join(surge, ["zcta_id", "event"], "outer")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    lag = F.abs(z("rain_peak_hour") - z("surge_peak_hour"))
    top = rain.agg(F.greatest(F.coalesce(F.max("rain_total_mm"), F.lit(0.0)), F.lit(1.0))).scalar()
    tops = surge.agg(F.greatest(F.coalesce(F.max("surge_max_m"), F.lit(0.0)), F.lit(0.01))).scalar()
    return m.withColumns({"rain_surge_lag_hr": lag, "rain_surge_overlap_hr": F.greatest(F.least(z("rain_duration_hr"), z("surge_duration_hr")) - lag, F.lit(0.0)), "compound_score": z("rain_total_mm") / top * (z("surge_max_m") / tops)})


def approach_speed(track: DataFrame, units: DataFrame) -> DataFrame:
    """Forward speed on the leg ending at the fix closest to the units' mean position (the leg
    starting there when it is the first fix)."""
    c = units.agg(F.struct(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))).scalar()
    w = W.partitionBy("event").orderBy("ts")  # a track has a few dozen fixes
    t = track.withColumn("_c", c).withColumn("_d", haversine_km("_c.lat", "_c.lon", "lat", "lon"))
    leg = lambda a, b: haversine_km(a + "lat", a + "lon", b + "lat", b + "lon")
    t = t.select("event", "ts", "lat", "lon", "_d", *[f(c).over(w).alias(p + c) for p, f in (("p_", F.lag), ("n_", F.lead)) for c in ("ts", "lat", "lon")])
    km = F.when(F.col("p_ts").isNotNull(), leg("p_", "")).otherwise(leg("", "n_"))
    hrs = F.when(F.col("p_ts").isNotNull(), _hours(F.col("p_ts"), F.col("ts"))).otherwise(_hours(F.col("ts"), F.col("n_ts")))
    best = t.withColumn("_v", F.when(hrs > 0, km / hrs)).filter(F.col("_d").isNotNull()).groupBy("event").agg(F.min(F.struct("_d", "ts", F.col("_v").alias("v")))["v"].alias("storm_approach_speed_kph"))
    return units.select("zcta_id").withColumn("_e", F.explode(best.agg(F.collect_list(F.struct("event", "storm_approach_speed_kph"))).scalar())).select("zcta_id", "_e.*")


def forecast_bias(forecast: DataFrame, observed: DataFrame, value: str = "qpf", total: str = "rain_total_mm") -> DataFrame:
    v = F.coalesce(F.col(value), F.lit(0.0))
    f = forecast.groupBy("zcta_id", "event").agg(F.sum(v).alias("qpf_total_mm"), F.max(v).alias("qpf_peak_mm"))
    return f.join(observed.select("zcta_id", "event", total), ["zcta_id", "event"], "left").withColumn("forecast_bias_mm", F.col("qpf_total_mm") - F.col(total)).drop(total)


def rank_disagreement(preds: DataFrame, unit: str, construct: str, value: str, prefix: str = "") -> DataFrame:
    """Spread of a unit's percentile ranks over constructs: largest and mean pairwise gap."""
    m = preds.groupBy(unit, construct).agg(F.avg(value).alias("_v"))
    r = percentile_rank(m, [construct], "_v", "_r").filter("_r IS NOT NULL")
    g = r.groupBy(unit).agg(F.sort_array(F.collect_list("_r")).alias("a"))  # one entry per construct
    n = F.size("a")
    # over sorted values the sum of pairwise gaps is sum((2i - n + 1) a_i)
    gaps = F.aggregate(F.transform("a", lambda x, i: x * (2 * i - n + 1)), F.lit(0.0), lambda s, v: s + v)
    pairs = n * (n - 1) / 2
    return g.select(unit, F.when(n > 1, F.element_at("a", -1) - F.element_at("a", 1)).alias(f"{prefix}max_divergence"), F.when(n > 1, gaps / pairs).alias(f"{prefix}mean_divergence"), n.alias("n_constructs"))


SENTINEL_BIN = -1


def quantile_edges(target: DataFrame, columns: list[str], n_bins: int = 5) -> DataFrame:
    """Inner bin edges per column from the target distribution, one row per column."""
    long = target.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "v")
    q = quantiles(long, ["column"], "v", {f"q{i}": i / n_bins for i in range(n_bins + 1)})
    edges = F.array_sort(F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(n_bins + 1)])))
    return q.select("column", F.when(F.size(edges) > 2, F.slice(edges, 2, F.size(edges) - 2)).otherwise(F.array().cast("array<double>")).alias("inner_edges"))


def apply_bins(df: DataFrame, edges: DataFrame, columns: list[str], suffix: str = "_bin") -> DataFrame:
    """Right-closed bins; an unknown value is the sentinel bin, a category of its own."""
    m = edges.agg(F.map_from_entries(F.collect_list(F.struct("column", "inner_edges")))).scalar()
    d = df.withColumn("_edges", m)
    for c in columns:
        e = F.coalesce(F.col("_edges")[c], F.array().cast("array<double>"))
        d = d.withColumn(f"{c}{suffix}", F.when(F.col(c).isNull(), SENTINEL_BIN).otherwise(F.size(F.filter(e, lambda x: x < F.col(c)))))
    return d.drop("_edges")


def strata(df: DataFrame, vulnerability: str, pop: str, hospital_km: str) -> DataFrame:
    """Vulnerability quartile, population tertile, remoteness (> 50 km) and their joint key."""
    svi = df.select(vulnerability).filter(F.col(vulnerability).isNotNull())
    people = df.select(pop).filter(F.col(pop) > 0)
    d = apply_bins(apply_bins(df, quantile_edges(svi, [vulnerability], 4), [vulnerability], "_q"), quantile_edges(people, [pop], 3), [pop], "_t")
    q = F.when(F.col(vulnerability).isNull(), "Q_missing").otherwise(F.concat(F.lit("Q"), (F.col(f"{vulnerability}_q") + 1).cast("string")))
    t = F.when(F.col(pop) > 0, F.element_at(F.array(F.lit("rural"), F.lit("suburban"), F.lit("urban")), F.col(f"{pop}_t") + 1)).otherwise("unknown")
    h = F.when(F.col(hospital_km).isNull(), "unknown").when(F.col(hospital_km) > 50, "remote").otherwise("accessible")
    d = d.withColumns({"strat_svi_quartile": q, "strat_urban_rural": t, "strat_hospital_access": h, "strat_key": F.concat_ws("_", q, t, h)})
    return d.drop(f"{vulnerability}_q", f"{pop}_t")


def ladder_deltas(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """Change of each column from one configuration step to the next."""
    w = W.partitionBy(*([F.col(b) for b in by] or [F.lit(0)])).orderBy(order)  # a handful of steps
    return df.withColumns({f"delta_{c}": F.col(c) - F.lag(c).over(w) for c in columns})


def uplift_table(metrics: DataFrame, by: list[str], level: str, metric: str, levels: list[str]) -> DataFrame:
    """Levels side by side with the percent uplift of every step."""
    w = metrics.groupBy(*by).pivot(level, levels).agg(F.avg(metric))
    up = {}
    for a, b in zip(levels, levels[1:]):
        up[f"uplift_{a}_{b}_pct"] = F.when(F.col(a) != 0, (F.col(b) - F.col(a)) / F.greatest(F.abs(a), F.lit(0.001)) * 100)
    return w.withColumns(up)


def movement_table(diagnostics: DataFrame, by: list[str], level: str, columns: list[str], levels: list[str]) -> DataFrame:
    w = diagnostics.groupBy(*by).pivot(level, levels).agg(*[F.first(c).alias(c) for c in columns])
    if len(columns) == 1:
        w = w.select(*by, *[F.col(l).alias(f"{l}_{columns[0]}") for l in levels])
    return w.select(*by, *[F.col(f"{l}_{c}").alias(f"{c}_{l}") for c in columns for l in levels], *[(F.col(f"{b}_{c}") - F.col(f"{a}_{c}")).alias(f"{c}_delta_{a}_{b}") for c in columns for a, b in zip(levels, levels[1:])])


def top_arm(df: DataFrame, by: list[str], arm: str, metric: str) -> DataFrame:
    best = F.min(F.struct((-F.col(metric)).alias("k"), F.col(arm).alias("a")))
    return df.filter(F.col(metric).isNotNull()).groupBy(*by).agg(best.alias("b"), F.count(F.lit(1)).alias("n_arms")).select(*by, F.col("b.a").alias("best_arm"), (-F.col("b.k")).alias("best_metric"), "n_arms")


def equal_breaks(df: DataFrame, value: str, count: int = 5) -> DataFrame:
    k = min(12, max(2, count))
    r = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return r.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (k - 1))).alias("class", "break_value"))


def quantile_breaks(df: DataFrame, value: str, count: int = 5) -> DataFrame:
    k = min(12, max(2, count))
    q = quantiles(df, [], value, {f"q{i}": i / (k - 1) for i in range(k)})
    return q.select(F.posexplode(F.array(*[F.col(f"q{i}") for i in range(k)])).alias("class", "break_value"))


def class_of(df: DataFrame, value: str, breaks: DataFrame, out: str = "class") -> DataFrame:
    """Class index of every value: the last break not above it."""
    b = breaks.agg(F.sort_array(F.collect_list("break_value"))).scalar()
    return df.withColumn("_b", b).withColumn(out, F.when(F.col(value).isNotNull(), F.greatest(F.size(F.filter("_b", lambda x: x <= F.col(value))) - 1, F.lit(0)))).drop("_b")
