"""Source, sink and streaming queries."""

from pyspark.sql import functions as F

from plumbline.functions.core import zfill
from plumbline.operators import served as V
from plumbline.plans.assembly import rnd
from plumbline.plans.registry import query
from plumbline.plans.standins import W, zf
from plumbline.sources import readers as R
from plumbline.sources import writers as X
from plumbline.streaming import twins as S


@query("s01_unit_checks", "SELECT count(*) AS n_rows, count(*) FILTER (c_acctbal < 0) AS n_negative_acs, 0::BIGINT AS n_repeated_keys FROM customer")
def _(t):
    d = R.unit_key(R.nan_to_null(t.raw("customer")).select(F.col("c_custkey").alias("zcta_id"), F.col("c_acctbal").alias("acs_wealth")))
    return R.unit_checks(d).withColumn("n_negative_acs", F.col("n_negative_acs").cast("long"))


@query("s02_enrichment", f"SELECT {zf('s_suppkey')} AS zcta_id, s_acctbal FROM supplier")
def _(t):
    d = t.raw("supplier").select(F.col("s_suppkey").alias("zcta"), "s_acctbal").withColumnRenamed("zcta", "zcta_id")
    assert R.load_enrichment(t.spark, f"{t.folder}/no_such_table.parquet") is None
    return R.unit_key(d)


@query("s03_claim_files", f"SELECT {zf('o_custkey')} AS zcta_id, o_orderkey, o_totalprice FROM orders")
def _(t):
    d = t.spark.read.option("mergeSchema", True).parquet(f"{t.folder}/orders*.parquet")
    return R.unit_key(d.select(F.col("o_custkey").alias("zcta_id"), "o_orderkey", "o_totalprice"))


TRK = "SELECT 'AL' || lpad(CAST(day(ts) AS VARCHAR), 2, '0') || '2024' AS storm_id, event_type, hour(ts) AS h, max(ts) AS ts, CAST(floor(avg(user_id)) AS INTEGER) AS la, CAST(floor(avg(value)) AS INTEGER) AS lo, CAST(floor(max(value)) AS INTEGER) AS w FROM events GROUP BY 1, 2, 3"


def _track_files(t):
    d = F.dayofmonth("ts")
    f = t.raw("events").groupBy(F.concat(F.lit("AL"), F.lpad(d.cast("string"), 2, "0"), F.lit("2024")).alias("storm_id"), F.col("event_type").alias("name"), F.hour("ts").alias("h"), d.alias("day")).agg(F.floor(F.avg("user_id")).cast("int").alias("la"), F.floor(F.avg("value")).cast("int").alias("lo"), F.floor(F.max("value")).cast("int").alias("w"))
    line = F.concat_ws(",", F.concat(F.lit("202401"), F.lpad("day", 2, "0")), F.concat(F.lit(" "), F.lpad((F.col("h") * 100).cast("string"), 4, "0")), F.lit("  "), F.lit(" HU"), F.concat(F.lit(" "), "la", F.lit(".5N")), F.concat(F.lit("  "), "lo", F.lit(".0W")),
                       F.when(F.col("h") % 4 == 0, F.lit(" -999")).otherwise(F.concat(F.lit(" "), "w")), F.lit(" 1000"))
    # one storm is one file of at most 24 fixes
    g = f.groupBy("storm_id", "name").agg(F.sort_array(F.collect_list(line)).alias("l"))
    return g.select(F.concat_ws("/", "storm_id", "name").alias("file"), F.concat(F.concat_ws(",", "storm_id", F.concat(F.lit("   "), "name"), F.size("l").cast("string"), F.lit("")), F.lit("\n"), F.array_join("l", "\n"), F.lit("\n")).alias("value"))


@query("s04_storm_tracks", f"WITH f AS ({TRK}) SELECT storm_id, event_type AS storm_name, CAST(h AS BIGINT) AS hour, 'HU' AS status, la + 0.5::DOUBLE AS lat, -lo::DOUBLE AS lon, CASE WHEN h % 4 > 0 THEN w END AS max_wind_kt FROM f")
def _(t):
    d = R.parse_tracks(_track_files(t), "value", "file")
    return d.select("storm_id", "storm_name", F.hour("timestamp").cast("long").alias("hour"), "status", "lat", "lon", "max_wind_kt")


@query("s05_storm_events", "SELECT lpad(CAST(p_size % 60 AS VARCHAR), 2, '0') || lpad(CAST(p_partkey % 300 AS VARCHAR), 3, '0') AS county_fips, CAST(2000 + p_size % 20 AS INTEGER) AS year, p_size::DOUBLE AS prop_dmg_k, 0.0::DOUBLE AS crop_dmg_k, CAST(p_size % 3 AS INTEGER) AS deaths, CAST(0 AS INTEGER) AS injuries FROM part WHERE p_size % 4 > 0 AND p_partkey % 3 > 0")
def _(t):
    k, z = F.col("p_partkey"), F.col("p_size")
    s = lambda c: c.cast("string")
    raw = t.raw("part").select(F.when(z % 4 > 0, F.lit(" flash FLOOD")).otherwise("Hail").alias("EVENT_TYPE"), F.when(k % 3 > 0, "c").otherwise("Z").alias("CZ_TYPE"), s(z % 60).alias("STATE_FIPS"), s(k % 300).alias("CZ_FIPS"), s(2000 + z % 20).alias("YEAR"), F.concat(s(z), F.lit("K")).alias("DAMAGE_PROPERTY"), F.lit("").alias("DAMAGE_CROPS"),
                               s(z % 3).alias("DEATHS_DIRECT"), F.lit("x").alias("DEATHS_INDIRECT"), F.lit("0").alias("INJURIES_DIRECT"), F.lit(None).cast("string").alias("INJURIES_INDIRECT"))
    return R.clean_storm_events(raw)


@query("s06_relationship_file", f"SELECT {zf('l_partkey')} AS zcta_id, {zf('l_suppkey')} AS county_fips, 'County ' || CAST(l_suppkey AS VARCHAR) AS county_name, l_quantity AS area_part FROM lineitem WHERE l_linenumber <> 3")
def _(t):
    s = lambda c: F.col(c).cast("string")
    raw = t.raw("lineitem").select(F.when(F.col("l_linenumber") != 3, s("l_partkey")).alias("GEOID_ZCTA5_20"), s("l_suppkey").alias("GEOID_COUNTY_20"), F.concat(F.lit("County "), s("l_suppkey")).alias("NAMELSAD_COUNTY_20"), s("l_quantity").alias("AREALAND_PART"))
    return R.clean_relationships(raw)


def _envelopes(t):
    c = t.certificate
    cell = F.struct(F.col("zcta_id").alias("scenario"), F.col("scenario_id").alias("target"), F.round("r", 6).alias("R"), F.round("alpha", 6).alias("alpha"))
    g = c.groupBy("snapshot_t", "embedding_arm", "scenario_id", F.substring("zcta_id", 4, 2).alias("b")).agg(F.collect_list(cell).alias("certificates"))
    body = F.to_json(F.struct(F.concat(F.lit("certificates_r"), F.floor(F.col("snapshot_t") / 24).cast("string")).alias("phase"), F.lit("p1").alias("preset_id"), "certificates"))
    return g.select(F.concat_ws("/", F.col("snapshot_t").cast("string"), "embedding_arm", "scenario_id", "b").alias("file"), body.alias("value"))


@query("s07_certificate_envelopes", W("certificate") + "SELECT 'certificates' AS kind, 'r' || CAST(snapshot_t // 24 AS VARCHAR) AS level, 'p1' AS preset_id, zcta_id AS scenario, scenario_id AS target, round(r, 6) AS \"R\", round(alpha, 6) AS alpha FROM certificate")
def _(t):
    return R.parse_envelopes(_envelopes(t), "value", "file").select("kind", "level", "preset_id", "scenario", "target", "R", "alpha")


@query("s08_run_cells", W("oof", "fold_metrics") + "SELECT task AS scenario, 't' AS target, round(max(metric), 6) AS best_metric, count(*) AS n_folds, 0::BIGINT AS n_null_folds, 'VALID' AS status FROM fold_metrics GROUP BY 1")
def _(t):
    run = F.struct(F.col("task").alias("scenario"), F.lit("t").alias("target"), F.lit("regression").alias("task"), F.col("model_version").alias("solver"), F.lit("spatial").alias("split"), F.col("fold").cast("string").alias("fold"), F.struct(F.col("metric").alias("r2")).alias("metrics"))
    f = t.fold_metrics.groupBy("task", "model_version").agg(F.to_json(F.struct(F.lit("x").alias("experiment"), F.collect_list(run).alias("runs"))).alias("value"))
    return rnd(R.run_cells(f, "value"), 6, "best_metric").select("scenario", "target", "best_metric", "n_folds", "n_null_folds", "status")


@query("s08_level_cells", "SELECT CAST(l_suppkey AS VARCHAR) AS scenario, 'x' AS target, round(avg(l_tax), 8) AS best_metric, CASE WHEN avg(l_tax) IS NULL THEN 'NULL' ELSE 'VALID' END AS status FROM lineitem GROUP BY l_suppkey")
def _(t):
    c = t.raw("lineitem").groupBy(F.col("l_suppkey").cast("string").alias("scenario")).agg(F.avg("l_discount").alias("r0_metric"), F.avg("l_tax").alias("r1_metric"), F.lit(None).cast("double").alias("r2_metric")).withColumn("target", F.lit("x"))
    return rnd(R.level_cells(c), 8, "best_metric")


@query("s09_predictions", W("oof") + "SELECT zcta, task, model_version, count(*) AS n FROM oof GROUP BY 1, 2, 3")
def _(t):
    return R.long_predictions(R.nan_to_null(t.oof)).groupBy("zcta", "task", "model_version").agg(F.count(F.lit(1)).alias("n"))


@query("s10_wide_predictions", "SELECT 'p' AS task, round(1 - sum((p_retailprice - p_size * 40) ** 2) / (count(*) * var_pop(p_retailprice)), 8) AS r2, count(*) AS n FROM part UNION ALL SELECT 'z', round(1 - sum((p_size - p_retailprice / 40) ** 2) / (count(*) * var_pop(p_size)), 8), count(*) FROM part")
def _(t):
    p, k = t.raw("part"), F.col("p_partkey").cast("string").alias("zcta")
    truth = p.select(k, F.col("p_retailprice").alias("p"), F.col("p_size").alias("z"))
    pred = p.select(k, (F.col("p_size") * 40).alias("p"), (F.col("p_retailprice") / 40).alias("z"))
    return rnd(R.task_r2(R.long_predictions(pred, truth, "m")), 8, "r2")


@query("s11_write_with_provenance", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _(t):
    path = f"{S._home(t.spark, 'release')}/orders"
    X.write_with_provenance(t.raw("orders"), path, ["orders"], ["o_orderstatus"])
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


BITS = " + ".join(f"((xi >> {i}) & 1) * {1 << (2 * i)} + ((yi >> {i}) & 1) * {1 << (2 * i + 1)}" for i in range(16))


@query("s12_morton_order", W("units", b="SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM units", c="SELECT zcta_id, floor((lon - x0) / (x1 - x0) * 65535.0)::BIGINT AS xi, floor((lat - y0) / (y1 - y0) * 65535.0)::BIGINT AS yi FROM units, b") + f"SELECT zcta_id, CAST({BITS} AS BIGINT) AS morton FROM c")
def _(t):
    return X.morton(t.units, "lon", "lat").select("zcta_id", "morton")


@query("s13_file_manifest")
def _(t):
    return X.manifest(t.spark, f"{t.folder}/*.parquet")


@query("s14_seed_registry", W("scenarios") + "SELECT scenario_id, display_name FROM scenarios")
def _(t):
    base = t.scenarios.select("scenario_id", "display_name")
    empty = V.empty_schema(t.spark)["scenarios"].select("scenario_id", "display_name")
    once = empty.unionByName(base.join(empty.select("scenario_id"), "scenario_id", "left_anti"))
    return once.unionByName(base.join(once.select("scenario_id"), "scenario_id", "left_anti"))


# ---- streams -----------------------------------------------------------------------------------

@query("t01_running_totals", f"SELECT {zf('l_suppkey')} AS zcta_id, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS claim_count, round(sum(l_extendedprice * l_discount), 4) AS total_loss FROM lineitem WHERE l_extendedprice * l_discount > 0 GROUP BY 1, 2")
def _(t):
    s = S.file_stream(t.spark, t.folder, "lineitem.parquet").select(zfill("l_suppkey", 5).alias("zcta_id"), F.year("l_shipdate").alias("year"), (F.col("l_extendedprice") * F.col("l_discount")).alias("paid"))
    return rnd(S.run_upsert(S.running_totals(s, ["zcta_id", "year"], F.col("paid")), ["zcta_id", "year"], "totals"), 4, "total_loss")


def _events(t):
    return S.file_stream(t.spark, t.folder, "events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), zfill("user_id", 5).alias("zcta_id"), "event_type", "value")


MARK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query("t02_windowed_totals", f"WITH w AS (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR, date_trunc('hour', ts) - INTERVAL 2 HOUR]) AS s, event_type, value FROM events) SELECT epoch(s)::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w WHERE s + INTERVAL 3 HOUR <= {MARK} GROUP BY 1, 2")
def _(t):
    d = S.run_append(S.windowed_totals(_events(t), "ts", ["event_type"], "value"), "windows")
    return d.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("t03_sessions", f"WITH g AS (SELECT {zf('user_id')} AS zcta_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS brk FROM events), s AS (SELECT *, sum(brk) OVER (PARTITION BY zcta_id ORDER BY ts) AS sid FROM g) SELECT zcta_id, epoch_us(min(ts)) AS session_start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY zcta_id, sid HAVING max(ts) + INTERVAL 2 HOUR <= {MARK}")
def _(t):
    d = S.run_append(S.sessions(_events(t), "ts", ["zcta_id"], "value"), "sessions")
    return d.select("zcta_id", F.unix_micros("session_start").alias("session_start"), "n", F.round("total", 4).alias("total"))


@query("t04_first_seen", "SELECT event_id, event_type FROM events")
def _(t):
    e = _events(t)
    return S.run_append(S.first_seen(e.unionByName(e), "ts", ["event_id"], "1 hour").select("event_id", "event_type"), "first")


@query("t05_keep_last_cache", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def _(t):
    s = S.file_stream(t.spark, t.folder, "orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice")
    return S.run_upsert(s, ["o_custkey"], "cache", "append", "o_orderkey")


@query("t06_session_log", "WITH l AS (SELECT o_orderpriority AS session_id, o_custkey, arg_max(o_orderstatus, o_orderkey) AS s, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1, 2), d AS (SELECT session_id, s = 'F' AS ex, p >= 250000 AS fl FROM l) SELECT session_id, count(*) AS total_zctas, count(*) FILTER (ex) AS zctas_targeted, count(*) FILTER (ex AND fl) AS zctas_that_flooded, round(count(*) FILTER (ex AND fl) / count(*) FILTER (ex), 8) AS precision_at_execute FROM d GROUP BY 1")
def _(t):
    s = S.file_stream(t.spark, t.folder, "orders.parquet").select(F.col("o_orderpriority").alias("session_id"), F.col("o_custkey").alias("certificate_id"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", "EXECUTE").when(F.col("o_orderstatus") == "O", "CAUTION").otherwise("REFUSE").alias("public_decision"), (F.col("o_totalprice") >= 250000).alias("actually_flooded"))
    log = S.run_upsert(s, ["session_id", "certificate_id"], "log", "append", "o_orderkey")
    return V.summarize_session(t.spark, log).select("session_id", "total_zctas", "zctas_targeted", "zctas_that_flooded", F.round("precision_at_execute", 8).alias("precision_at_execute"))
