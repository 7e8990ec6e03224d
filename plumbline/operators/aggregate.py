"""Claim, event, metric and evidence aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.core import clip, div, share_where, unpivot
from plumbline.operators.ranking import quantiles


def claims_by_unit(claims: DataFrame, exclude_from_year: int | None = None) -> DataFrame:
    """Paid claims only: count, sums, mean per claim."""
    c = claims if exclude_from_year is None else claims.filter(F.col("year") < exclude_from_year)
    total = F.col("building") + F.col("contents")
    g = c.withColumn("_t", total).filter(F.col("_t") > 0).groupBy("zcta_id").agg(
        F.count(F.lit(1)).alias("claim_count"), F.sum("building").alias("building_loss"), F.sum("contents").alias("contents_loss"), F.sum("_t").alias("total_loss"))
    return g.withColumns({"mean_loss_per_claim": F.bround(F.col("total_loss") / F.col("claim_count"), 2), "has_claims": F.lit(True)})


def event_claims(claims: DataFrame, by: list[str]) -> DataFrame:
    """Every claim counts, paid or not; building payments are summed."""
    return claims.groupBy(*by).agg(F.count(F.lit(1)).alias("event_claim_count"), F.sum("building").alias("event_total_loss"))


def history_before(claims: DataFrame, events: DataFrame, units: DataFrame) -> DataFrame:
    """Frequency and severity of claims strictly before each event start.

    ``events`` is a short list (event, start). Claims become one row per unit and time, whose running totals are read off at each start in one
    ordered pass per unit; the cost is claims plus units x events, which is the size of the result. At equal times the start comes first."""
    daily = claims.groupBy("zcta_id", F.col("claim_date").cast("timestamp").alias("_t")).agg(F.count("building").alias("_n"), F.sum(F.coalesce("building", F.lit(0.0))).alias("_s"))
    starts = events.agg(F.collect_set(F.struct("event", "start"))).scalar()
    asked = units.select("zcta_id").withColumn("_e", F.explode(starts)).select("zcta_id", F.col("_e.start").cast("timestamp").alias("_t"), F.col("_e.event").alias("event"))
    both = daily.withColumns({"event": F.lit(None).cast("string"), "_k": F.lit(1)}).unionByName(asked.withColumns({"event": F.col("event").cast("string"), "_n": F.lit(0).cast("long"), "_s": F.lit(0.0), "_k": F.lit(0)}))
    so_far = W.partitionBy("zcta_id").orderBy("_t", "_k").rowsBetween(W.unboundedPreceding, 0)
    g = both.withColumns({"_n": F.sum("_n").over(so_far), "_s": F.sum("_s").over(so_far)}).filter("_k = 0")
    return g.select("zcta_id", "event", F.col("_n").alias("historical_frequency"), F.coalesce(div("_s", "_n"), F.lit(0.0)).alias("historical_severity"))


def county_totals(events: DataFrame, recent_from: int, n_years: int) -> DataFrame:
    n = F.count(F.lit(1))
    return events.groupBy("county_fips").agg(
        n.alias("event_count"), F.sum("deaths").alias("deaths"), F.sum("damage_k").alias("damage_k"), F.count_if(F.col("year") >= recent_from).alias("event_count_5y"),
        F.bround(n / F.lit(n_years), 3).alias("events_per_year"))


def county_years(events: DataFrame) -> DataFrame:
    return events.groupBy("county_fips", "year").agg(F.count("damage_k").alias("events"), F.sum("deaths").alias("deaths"), F.sum("damage_k").alias("damage_k"))


def epochs_wide(long: DataFrame, metrics: list[str], epochs: dict[str, tuple[int, int]], peak: str) -> DataFrame:
    cells = [F.coalesce(F.sum(F.when(F.col("year").between(*span), F.col(m))), F.lit(0)).alias(f"{m}_{e}") for e, span in epochs.items() for m in metrics]
    cells += [F.coalesce(F.sum(m), F.lit(0)).alias(f"{m}_total") for m in metrics]
    return long.groupBy("zcta_id").agg(*cells, F.coalesce(F.max(peak), F.lit(0)).alias(f"{peak}_peak_yr"))


def gauge_peaks(readings: DataFrame, assigned: DataFrame, units: DataFrame) -> DataFrame:
    """Peak per gauge, then per unit over its gauges; ``assigned`` is (zcta_id, site_id, dist_km)."""
    peaks = readings.groupBy("site_id").agg(F.max("stage").alias("peak_stage"), F.max("flow").alias("peak_flow"))
    g = assigned.join(peaks, "site_id").groupBy("zcta_id").agg(
        F.max("peak_stage").alias("peak_stage"), F.max("peak_flow").alias("peak_flow"), F.count(F.lit(1)).alias("obs_gauge_count"), F.min("dist_km").alias("obs_gauge_distance_km"))
    return units.select("zcta_id").join(g, "zcta_id", "left").na.fill(0, ["obs_gauge_count"])


def tide_peaks(levels: DataFrame, units: DataFrame) -> DataFrame:
    """Highest level and surge over all stations, given to every unit; a station without surge
    readings uses its level."""
    s = levels.groupBy("station").agg(F.max("level").alias("l"), F.max("surge").alias("s"), F.min_by("ts", F.struct((-F.col("level")).alias("l"), "ts")).alias("at"))
    one = s.agg(F.struct(F.max("l").alias("level"), F.max(F.coalesce("s", F.when(F.col("l") > 0, F.col("l")))).alias("surge"), F.min_by("at", F.struct((-F.col("l")).alias("l"), "at")).alias("at")).alias("x"))
    return units.select("zcta_id").withColumn("_x", one.scalar()).select("zcta_id", F.col("_x.level").alias("max_water_level_m"), F.col("_x.surge").alias("max_surge_m"), F.col("_x.at").alias("peak_time"))


def reports_by_unit(reports: DataFrame, units: DataFrame) -> DataFrame:
    g = reports.groupBy("zcta_id").agg(F.count(F.lit(1)).alias("report_count"))
    return units.select("zcta_id").join(g, "zcta_id", "left").na.fill(0, ["report_count"]).withColumn("has_reports", F.col("report_count") > 0)


def modal_value(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Most frequent value per group; equal counts go to the smaller value."""
    c = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return c.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("k"), F.col(value).alias("v"))).alias("_m"), F.sum("_n").alias("n")).select(*by, F.col("_m.v").alias(f"modal_{value}"), "n")


def variance_ratios(df: DataFrame, group: str, features: list[str], min_rows: int = 10) -> DataFrame:
    """Between-group over total sample variance per feature."""
    long = unpivot(df.filter(F.col(group).isNotNull()), [group], features, "feature", "v").filter("v IS NOT NULL")
    per = long.groupBy("feature", group).agg(F.avg("v").alias("_m"))
    tot = long.groupBy("feature").agg(F.count(F.lit(1)).alias("_n"), F.var_samp("v").alias("_v"))
    between = per.groupBy("feature").agg(F.var_samp("_m").alias("_b"), F.count(F.lit(1)).alias("_g"))
    return tot.join(between, "feature").filter((F.col("_n") >= min_rows) & (F.col("_v") >= 1e-12) & (F.col("_g") >= 2)).select("feature", (F.col("_b") / F.col("_v")).alias("ratio"))


def scale_stability(df: DataFrame, features: list[str], county: str | None, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Mean ratio in [0, 1] by county when at least two exist, else by median quadrant, else 0.5."""
    mean = lambda r: r.agg(clip(F.avg("ratio"), 0, 1).alias("v"))
    score = F.lit(None).cast("double")
    if county is not None:
        score = mean(variance_ratios(df, county, features)).scalar()
    if {lat, lon} <= set(df.columns):
        med = {c: quantiles(df, [], c, {"q": 0.5}).select("q").scalar() for c in (lat, lon)}
        quad = df.withColumn("_quad", ((F.col(lat) >= med[lat]).cast("int") * 2 + (F.col(lon) >= med[lon]).cast("int")).cast("string"))
        score = F.coalesce(score, mean(variance_ratios(quad, "_quad", features)).scalar())
    return df.sparkSession.range(1).select(F.coalesce(score, F.lit(0.5)).alias("scale_stability"))


def support_coverage(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    cov = sum((F.avg(F.col(f).isNotNull().cast("double")) for f in features), F.lit(0.0)) / len(features)
    return df.filter(F.col(target).isNotNull()).agg(F.coalesce(cov, F.lit(0.0)).alias("support_coverage"))


def spatial_connectivity(edges: DataFrame, units: DataFrame) -> DataFrame:
    """Share of units with at least one neighbour inside the set."""
    ids = units.select("zcta_id")
    inside = edges.join(ids.withColumnRenamed("zcta_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("zcta_id", "dst"), "dst", "left_semi")
    linked = inside.select(F.explode(F.array("src", "dst")).alias("zcta_id")).distinct().withColumn("_l", F.lit(1))
    return ids.join(linked, "zcta_id", "left").agg(F.coalesce(F.avg(F.coalesce("_l", F.lit(0))), F.lit(0.0)).alias("spatial_connectivity"))


def administrative_alignment(xwalk: DataFrame, units: DataFrame) -> DataFrame:
    per = xwalk.join(units.select("zcta_id"), "zcta_id", "left_semi").groupBy("zcta_id").agg(F.count_distinct("county_fips").alias("n"))
    return per.agg(F.coalesce(1 - share_where(F.col("n") > 1), F.lit(0.5)).alias("admin_alignment"))


def geometry_kappa(*terms: DataFrame) -> DataFrame:
    """Mean of the one-row geometry terms."""
    cols = {t.columns[0]: t.scalar() for t in terms}
    one = terms[0].sparkSession.range(1).select(*[c.alias(n) for n, c in cols.items()])
    return one.withColumn("kappa_geom", sum((F.col(n) for n in cols), F.lit(0.0)) / len(cols))


def r_squared(y: str = "y_true", p: str = "y_pred", flat: float | None = 0.0) -> Column:
    tot = F.var_pop(y) * F.count(F.lit(1))
    res = F.sum((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))
    return F.when(tot > 0, 1 - res / tot).otherwise(F.lit(flat))


def two_stage_r2(preds: DataFrame, xwalk: DataFrame, extra: list[str] = (), min_units: int = 3) -> DataFrame:
    """Mean over events per unit, then a county metric where enough units exist."""
    extra = list(extra)
    unit = preds.groupBy(*extra, "zcta_id").agg(F.avg("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred"))
    return unit.join(xwalk.select("zcta_id", "county_fips").distinct(), "zcta_id").filter("county_fips IS NOT NULL").groupBy(*extra, "county_fips").agg(
        r_squared().alias("metric_value"), F.count(F.lit(1)).alias("n_zctas")).filter(F.col("n_zctas") >= min_units)


def regression_metrics(df: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """RMSE, MAE and R2 beside those of the mean predictor."""
    e = F.col(y) - F.col(p)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), r_squared(y, p).alias("r2"), F.stddev_pop(y).alias("naive_rmse"))


def naive_by_fold(df: DataFrame, by: list[str], fold: str = "fold", y: str = "y_true") -> DataFrame:
    """Mean of the other folds used as prediction, from per-fold sums (no row is repeated)."""
    f = df.groupBy(*by, fold).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q"))
    w = W.partitionBy(*by)
    m = (F.sum("s").over(w) - F.col("s")) / (F.sum("n").over(w) - F.col("n"))
    return f.select(*by, fold, "n", "s", "q", m.alias("train_mean")).select(
        *by, fold, "n", "train_mean", F.sqrt((F.col("q") - 2 * F.col("train_mean") * F.col("s") + F.col("n") * F.col("train_mean") * F.col("train_mean")) / F.col("n")).alias("naive_rmse"))


def weighted_metrics(df: DataFrame, by: list[str], w: str, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    e, w = F.col(y) - F.col(p), F.col(w)
    mean = lambda x: div(F.sum(w * x), F.sum(w))
    return df.groupBy(*by).agg(F.sqrt(mean(e * e)).alias("w_rmse"), mean(F.abs(e)).alias("w_mae"), mean(F.col(y)).alias("w_mean_true"), mean(F.col(p)).alias("w_mean_pred"))


def stratum_stats(df: DataFrame, stratum: str, value: str, min_n: int = 3) -> DataFrame:
    g = df.filter(F.col(value).isNotNull()).groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    med = quantiles(df, [stratum], value, {"median": 0.5}).drop("n_values")
    return g.filter(F.col("n") >= min_n).join(med, stratum).withColumn("cv", F.coalesce(div("std", "mean"), F.lit(0.0)))


def heterogeneity(stats: DataFrame, limit: float = 5.0) -> DataFrame:
    pos = F.when(F.col("mean") > 0, F.col("mean"))
    ratio = F.when(F.count(pos) >= 2, F.max(pos) / F.min(pos)).otherwise(1.0)
    return stats.agg(ratio.alias("ratio")).withColumn("heterogeneous", F.col("ratio") > limit)


def macro_f1(df: DataFrame, truth: str, pred: str, classes: list[str]) -> DataFrame:
    """Mean F1 over the named classes; a class never seen scores 0."""
    t, p = F.col(truth), F.col(pred)
    cells = []
    for c in classes:
        tp, denom = F.count_if((t == c) & (p == c)), F.count_if(t == c) + F.count_if(p == c)
        cells.append(F.coalesce(div(2.0 * tp, denom), F.lit(0.0)))
    return df.agg((sum(cells, F.lit(0.0)) / len(classes)).alias("macro_f1"), F.count(F.lit(1)).alias("n"))


def judgement_rates(df: DataFrame, by: list[str]) -> DataFrame:
    """Activation, adherence, grounding and unsupported-claim rates, and the simplex they give."""
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    clean = F.coalesce(F.col("no_unprovided_claims"), F.lit(True))
    g = df.groupBy(*by).agg(
        share_where(f("map_loaded") & f("evidence_table_loaded") & f("rubric_loaded")).alias("activation_rate"), share_where(f("followed_schema") & f("used_structured_evidence")).alias("adherence_rate"),
        share_where(f("used_visual_evidence") & f("used_structured_evidence") & clean).alias("grounding_rate"), share_where(f("followed_schema")).alias("schema_validity_rate"),
        (1 - share_where(f("no_unprovided_claims"))).alias("unprovided_claim_rate"), F.count(F.lit(1)).alias("n_outputs"))
    r, n = F.col("grounding_rate"), F.col("unprovided_claim_rate")
    return g.withColumns({"R": r, "S_sup": F.greatest(1 - r - n, F.lit(0.0)), "N": n})


def target_availability(df: DataFrame, event: str, columns: list[str]) -> DataFrame:
    """Missing share of each column per event and over all events, by grouping sets."""
    long = df.select(event, *[F.col(c).isNull().cast("double").alias(c) for c in columns]).unpivot([event], columns, "column", "missing")
    g = long.groupingSets([[event, "column"], ["column"]], event, "column").agg(F.avg("missing").alias("missing_rate"), F.count(F.lit(1)).alias("n"), F.grouping(event).alias("is_total"))
    return g.select(F.when(F.col("is_total") == 1, "all").otherwise(F.col(event)).alias(event), "column", "missing_rate", "n")


def scorecard(metrics: DataFrame, by: str, pivot: str, values: list[str], metric: str) -> DataFrame:
    wide = metrics.groupBy(by).pivot(pivot, values).agg(F.avg(metric))
    return wide.join(metrics.groupBy(by).agg(F.avg(metric).alias("mean"), F.max(metric).alias("best"), F.count(metric).alias("n_cells")), by)


def sar_anomaly(observed: DataFrame, permanent: DataFrame) -> DataFrame:
    return observed.join(permanent, "zcta_id", "left").withColumn("sar_anomaly_pct", F.col("flood_pct") - F.coalesce("permanent_pct", F.lit(0.0)))


def region_embedding(df: DataFrame, region: str, vector: str) -> DataFrame:
    """Mean vector per region, each dimension z-scored across regions (constant ones become 0)."""
    m = df.select(region, F.posexplode(vector).alias("dim", "x")).groupBy(region, "dim").agg(F.avg("x").alias("m"))
    d = m.groupBy("dim").agg(F.avg("m").alias("mu"), F.stddev_pop("m").alias("sd"))
    return m.join(d, "dim").select(region, "dim", F.coalesce(div(F.col("m") - F.col("mu"), "sd"), F.lit(0.0)).alias("z"))


def evidence_text(df: DataFrame, title: str, lines: list[tuple[str, Column]]) -> Column:
    """Headline plus one '- label: value' line each; unknown values read N/A."""
    body = [F.concat(F.lit(f"- {label}: "), F.coalesce(v.cast("string"), F.lit("N/A"))) for label, v in lines]
    return F.concat_ws("\n", F.concat(F.lit(title + " "), F.col("zcta_id")), *body)


def centroids(df: DataFrame, by: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.groupBy(by).agg(F.avg(lat).alias(lat), F.avg(lon).alias(lon))


def coverage_flags(df: DataFrame, flags: dict[str, list[str]]) -> DataFrame:
    return df.withColumns({f"has_{name}": F.forall(F.array(*[F.col(c).isNotNull() for c in cols]), lambda x: x) for name, cols in flags.items()})
