"""Readers: unit tables, enrichments, claims, storm tracks, storm events, relationship files,
certificate envelopes, run results, predictions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.core import nan_to_null, zfill
from plumbline.functions.text import damage_thousands

# Fixed values.
FEATURE_PREFIXES = ("acs_", "lag_acs_", "svi_", "flood_", "hifld_", "drive_min_")
FLOOD_EVENT_TYPES = ("Flood", "Flash Flood", "Coastal Flood", "Lakeshore Flood")


def unit_key(df: DataFrame, key: str = "zcta_id") -> DataFrame:
    return df.withColumn(key, zfill(F.trim(F.col(key).cast("string")), 5))


def unit_checks(df: DataFrame, key: str = "zcta_id") -> DataFrame:
    """Row count, repeated keys and negative survey values, in one pass over keys and one over values."""
    neg = [c for c in df.columns if c.startswith("acs_")]
    dup = df.groupBy(key).agg(F.count(F.lit(1)).alias("c")).agg(F.count_if(F.col("c") > 1)).scalar()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), sum((F.count_if(F.col(c) < 0) for c in neg), F.lit(0)).alias("n_negative_acs")).withColumn("n_repeated_keys", dup)


def load_units(spark: SparkSession, path: str, key: str = "zcta_id", check: bool = True) -> DataFrame:
    df = unit_key(nan_to_null(spark.read.parquet(path)), key)
    if check:
        bad = unit_checks(df, key).first()
        if bad["n_repeated_keys"] or bad["n_negative_acs"]:
            raise ValueError(f"unit table: {bad['n_repeated_keys']} repeated keys, {bad['n_negative_acs']} negative survey values")
    return df


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(FEATURE_PREFIXES)]


def load_enrichment(spark: SparkSession, path: str) -> DataFrame | None:
    """An optional enrichment: None when its path does not exist."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    df = df.withColumnRenamed("zcta", "zcta_id") if "zcta" in df.columns and "zcta_id" not in df.columns else df
    return unit_key(nan_to_null(df))


def load_claims(spark: SparkSession, glob: str) -> DataFrame:
    """All claim files under a glob, columns merged, tagged with the number in the file name."""
    df = spark.read.option("mergeSchema", True).parquet(glob)
    n = F.regexp_extract(F.input_file_name(), r"(\d+)\.parquet", 1).try_cast("int")
    return unit_key(df.withColumn("dr_number", n)).withColumn("dateOfLoss", F.col("dateOfLoss").try_cast("timestamp"))


def parse_tracks(files: DataFrame, text: str, file: str, storms: list[str] | None = None) -> DataFrame:
    """Storm-track text: a header line names the storm, the fix lines after it belong to it.

    A file is one history (a few megabytes), so the header is carried forward inside its file."""
    lines = files.select(file, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "line"))
    part = lambda i: F.trim(F.get(F.split("line", ","), F.lit(i)))
    lines = lines.select(file, "line_no", "line", part(0).alias("p0"), part(1).alias("p1"))
    head = F.col("p0").rlike(r"^[A-Z]{2}\d{6}$")
    w = W.partitionBy(file).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    d = lines.withColumns({"storm_id": F.last(F.when(head, F.col("p0")), True).over(w), "storm_name": F.last(F.when(head, F.col("p1")), True).over(w)}).filter(F.col("p0").rlike(r"^\d{8}$") & F.col("storm_id").isNotNull())
    if storms:
        d = d.filter(F.col("storm_id").isin(*storms))
    signed = lambda i, minus: F.substring(part(i), F.lit(1), F.length(part(i)) - 1).try_cast("double") * F.when(F.right(part(i), F.lit(1)) == minus, -1).otherwise(1)
    known = lambda i: F.when(part(i) != "-999", part(i).try_cast("int"))
    ts = F.try_to_timestamp(F.concat("p0", zfill("p1", 4)), F.lit("yyyyMMddHHmm"))
    return d.select("storm_id", "storm_name", ts.alias("timestamp"), part(3).alias("status"), signed(4, "S").alias("lat"), signed(5, "W").alias("lon"), known(6).alias("max_wind_kt"), known(7).alias("min_pressure_mb"))


def load_tracks(spark: SparkSession, path: str, storms: list[str] | None = None) -> DataFrame:
    files = spark.read.text(path, wholetext=True).withColumn("_f", F.input_file_name())
    return parse_tracks(files, "value", "_f", storms)


def clean_storm_events(raw: DataFrame) -> DataFrame:
    """County flood events with five-digit codes, damages in thousands, deaths and injuries."""
    num = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0))
    d = raw.filter(F.initcap(F.trim("EVENT_TYPE")).isin(*FLOOD_EVENT_TYPES) & (F.upper(F.trim("CZ_TYPE")) == "C"))
    return d.select(F.concat(zfill("STATE_FIPS", 2), zfill("CZ_FIPS", 3)).alias("county_fips"), F.col("YEAR").try_cast("int").alias("year"), damage_thousands("DAMAGE_PROPERTY").alias("prop_dmg_k"), damage_thousands("DAMAGE_CROPS").alias("crop_dmg_k"),
                    (num("DEATHS_DIRECT") + num("DEATHS_INDIRECT")).alias("deaths"), (num("INJURIES_DIRECT") + num("INJURIES_INDIRECT")).alias("injuries"))


def load_storm_events(spark: SparkSession, glob: str) -> DataFrame:
    """Gzipped CSV read as text columns (a gz file is one split; pass many yearly files)."""
    return clean_storm_events(spark.read.csv(glob, header=True, encoding="ISO-8859-1", quote='"', escape='"', multiLine=True))


def clean_relationships(raw: DataFrame) -> DataFrame:
    r = raw.filter(F.col("GEOID_ZCTA5_20").isNotNull() & F.col("GEOID_COUNTY_20").isNotNull())
    return r.select(zfill("GEOID_ZCTA5_20", 5).alias("zcta_id"), zfill("GEOID_COUNTY_20", 5).alias("county_fips"), F.col("NAMELSAD_COUNTY_20").alias("county_name"), F.col("AREALAND_PART").try_cast("double").alias("area_part"))


def load_relationships(spark: SparkSession, path: str) -> DataFrame:
    return clean_relationships(spark.read.csv(path, sep="|", header=True))


# ---- JSON envelopes ----------------------------------------------------------------------------

CELL = T.StructType([T.StructField(n, T.StringType()) for n in ("scenario", "target", "task_type")] + [T.StructField(n, T.DoubleType()) for n in
                    ("R", "S_sup", "N", "alpha", "omega", "kappa_compat", "tau", "sigma", "coherence", "spatial_metric", "random_metric", "diag_leakage", "diag_transfer", "diag_solver", "diag_residual_spatial", "r0_metric", "r1_metric", "r2_metric", "kappa_geom")])
ENVELOPE = T.StructType([T.StructField("phase", T.StringType()), T.StructField("experiment", T.StringType()), T.StructField("preset_id", T.StringType()), T.StructField("certificates", T.ArrayType(CELL)), T.StructField("cells", T.ArrayType(CELL))])
RUN = T.StructType([T.StructField(n, T.StringType()) for n in ("scenario", "target", "task", "solver", "split", "fold")] + [T.StructField("metrics", T.StructType([T.StructField(n, T.DoubleType()) for n in ("r2", "rmse", "roc_auc")]))])
RUNS = T.StructType([T.StructField("experiment", T.StringType()), T.StructField("phase", T.StringType()), T.StructField("runs", T.ArrayType(RUN))])


def phase_kind(phase) -> Column:
    p = F.lower(phase)
    return (F.when(p.rlike(r"^certificates[_ ]r?"), "certificates").when(p.startswith("diagnostics_r"), "diagnostics").when(p.contains("block_admission"), "admission").when(p.contains("dgm_routing"), "routing")
            .when(p.contains("gearbox"), "gearbox").when(p.contains("money_table") | p.contains("uplift_table"), "money_table"))


def phase_level(phase) -> Column:
    return F.nullif(F.regexp_extract(F.concat(F.lit("_"), F.lower(phase)), r"[_ ](r\d+)(?:[_ ]|$)", 1), F.lit(""))


def parse_envelopes(files: DataFrame, text: str, file: str) -> DataFrame:
    """Cells of certificate and diagnostics envelopes with kind and level; broken files are kept as
    one row with status MALFORMED_JSON or MISSING_PHASE."""
    d = files.select(file, F.from_json(text, ENVELOPE, {"mode": "PERMISSIVE"}).alias("e"))
    ph = F.col("e.phase")
    status = F.when(F.col("e").isNull() | (ph.isNull() & F.col("e.certificates").isNull() & F.col("e.cells").isNull()), "MALFORMED_JSON").when(ph.isNull(), "MISSING_PHASE").when(phase_kind(ph).isNull(), "OTHER").otherwise("OK")
    rows = F.coalesce(F.col("e.certificates"), F.col("e.cells"))
    return d.withColumn("status", status).select(file, "status", ph.alias("phase"), phase_kind(ph).alias("kind"), F.coalesce(phase_level(ph), F.lit("r0")).alias("level"), F.col("e.preset_id").alias("preset_id"), F.explode_outer(rows).alias("c")).select(file, "status", "phase", "kind", "level", "preset_id", "c.*")


def load_envelopes(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    files = spark.read.text(f"{folder}/*.json", wholetext=True).withColumn("file", F.input_file_name())
    out = parse_envelopes(files, "value", "file")
    if strict and not out.filter(F.col("status").isin("MALFORMED_JSON", "MISSING_PHASE")).isEmpty():
        raise ValueError("malformed or unlabelled envelope")
    return out


def _cell_status(v: Column) -> Column:
    return F.when(v.isNotNull(), "VALID").otherwise("NULL")


def run_cells(files: DataFrame, text: str) -> DataFrame:
    """Best metric per cell from run results (R2 for regression, AUC otherwise)."""
    r = files.select(F.explode(F.from_json(text, RUNS)["runs"]).alias("r")).select("r.*")
    m = F.when(F.col("task") == "regression", F.col("metrics.r2")).otherwise(F.col("metrics.roc_auc"))
    g = r.withColumn("_m", m).groupBy("scenario", "target").agg(F.max("_m").alias("best_metric"), F.min(F.when(F.col("_m").isNotNull(), F.struct((-F.col("_m")).alias("k"), "solver")))["solver"].alias("solver"), F.count(F.lit(1)).alias("n_folds"), F.count_if(F.col("_m").isNull()).alias("n_null_folds"))
    return g.withColumn("status", _cell_status(F.col("best_metric")))


def level_cells(cells: DataFrame) -> DataFrame:
    """Highest level that has a value."""
    v = F.coalesce("r2_metric", "r1_metric", "r0_metric")
    return cells.select("scenario", "target", v.alias("best_metric"), _cell_status(v).alias("status"))


def aggregate_cells(cells: DataFrame, field: str) -> DataFrame:
    return cells.select("scenario", "target", F.col(field).alias("best_metric"), _cell_status(F.col(field)).alias("status"))


# ---- predictions -------------------------------------------------------------------------------

def prediction_format(columns: list[str], n_numeric: int = 0) -> str:
    low = [c.lower() for c in columns]
    if ("task" in columns or "target" in columns) and "y_true" in columns:
        return "long"
    return "wide" if "zcta" in low or n_numeric >= 20 else "unknown"


def long_predictions(pred: DataFrame, truth: DataFrame | None = None, model: str | None = None) -> DataFrame:
    """Long form (zcta, task, model_version, y_true, y_pred) from either layout."""
    kind = prediction_format(pred.columns)
    if kind == "long":
        d = pred.withColumnRenamed("target", "task") if "task" not in pred.columns else pred
        return d.withColumnRenamed("solver", "model_version") if "model_version" not in d.columns else d
    if kind != "wide" or truth is None:
        raise ValueError("wide predictions need a truth table with the same columns")
    tasks = [c for c in pred.columns if c != "zcta" and c in truth.columns]
    melt = lambda d, v: d.select("zcta", *[F.col(c).cast("double").alias(c) for c in tasks]).unpivot(["zcta"], tasks, "task", v)
    return melt(truth, "y_true").join(melt(pred, "y_pred"), ["zcta", "task"]).withColumn("model_version", F.lit(model))


def load_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return long_predictions(nan_to_null(spark.read.option("mergeSchema", True).parquet(folder)))


def task_r2(long: DataFrame, min_rows: int = 10) -> DataFrame:
    d = long.filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    e = F.col("y_true") - F.col("y_pred")
    tot = F.var_pop("y_true") * F.count(F.lit(1))
    return d.groupBy("task").agg(F.when(F.count(F.lit(1)) >= min_rows, F.when(tot > 0, 1 - F.sum(e * e) / tot).otherwise(0.0)).alias("r2"), F.count(F.lit(1)).alias("n"))
