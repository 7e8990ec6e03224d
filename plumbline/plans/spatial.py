"""Nearest, radius, containment, overlay and region-graph queries."""

from pyspark.sql import functions as F

from plumbline.functions.core import zfill
from plumbline.operators import spatial as S
from plumbline.plans.assembly import rnd
from plumbline.plans.registry import query
from plumbline.plans.standins import W, hav, zf

US = hav("u.lat", "u.lon", "s.lat", "s.lon")
PAIRS = f"SELECT u.zcta_id, s.site_id, s.beds, {US} AS d FROM units u CROSS JOIN sites s"


@query("j05_nearest_site_in_radius", W("units", "sites", p=PAIRS) + "SELECT zcta_id, arg_min(site_id, (d, site_id)) AS site_id, round(min(d), 6) AS dist_km FROM p WHERE d <= 150 GROUP BY 1")
def _(t):
    return rnd(S.k_nearest(t.units, t.sites, "zcta_id", "site_id", max_km=150.0), 6, "dist_km").drop("rank")


EV = f"SELECT event_id, 25.0 + (event_id * 53 % 2400) / 100.0 + 0.001 AS lat, -120.0 + (event_id * 29 % 5000) / 100.0 + 0.001 AS lon FROM events"


def _reports(t):
    e = F.col("event_id")
    return t.raw("events").select("event_id", (25.0 + e * 53 % 2400 / 100.0 + 0.001).alias("lat"), (-120.0 + e * 29 % 5000 / 100.0 + 0.001).alias("lon"))


@query("j06_reports_to_nearest_unit", W("units", e=EV) + f"SELECT event_id, arg_min(zcta_id, (d, zcta_id)) AS zcta_id, round(min(d), 6) AS dist_km FROM (SELECT event_id, zcta_id, {hav('u.lat', 'u.lon', 's.lat', 's.lon')} AS d FROM e u JOIN units s ON abs(u.lat - s.lat) < 0.3 AND abs(u.lon - s.lon) < 0.5) WHERE d <= 20 GROUP BY 1")
def _(t):
    return rnd(S.k_nearest(_reports(t), t.units, "event_id", "zcta_id", max_km=20.0), 6, "dist_km").drop("rank")


@query("j07_facility_counts", W("units", "sites", p=PAIRS, d="SELECT zcta_id, min(d) AS nearest_km FROM p GROUP BY 1", o="SELECT site_id, any_value(beds) AS beds, arg_min(zcta_id, (d, zcta_id)) AS zcta_id FROM p GROUP BY 1", g="SELECT zcta_id, count(*) AS n, sum(beds) AS b FROM o GROUP BY 1")
       + "SELECT d.zcta_id, round(nearest_km, 6) AS nearest_km, coalesce(n, 0) AS n_facilities, coalesce(b, 0) AS total_load FROM d LEFT JOIN g USING (zcta_id)")
def _(t):
    return rnd(S.nearest_with_counts(t.units, t.sites, "zcta_id", "site_id", "beds"), 6, "nearest_km")


MEAN_KM = 6371.0088


@query("j08_nearest_training_by_fold", W("units", u="SELECT zcta_id, lat, lon, k % 5 AS fold, k % 3 AS grp FROM units") + f"SELECT u.zcta_id, round(min({hav('u.lat', 'u.lon', 's.lat', 's.lon', MEAN_KM)}), 6) AS nearest_train_km FROM u JOIN u s ON u.grp = s.grp AND u.fold <> s.fold GROUP BY 1")
def _(t):
    u = t.units.select("zcta_id", "lat", "lon", (F.col("k") % 5).alias("fold"), (F.col("k") % 3).alias("grp"))
    n = S.k_nearest(u, u.withColumnRenamed("zcta_id", "train_id"), "zcta_id", "train_id", by=["grp"], radius=MEAN_KM, other=("fold", "fold"))
    return n.select("zcta_id", F.round("dist_km", 6).alias("nearest_train_km"))


@query("j08_nearest_reference_by_group", W("units", u="SELECT zcta_id, lat, lon, k % 7 AS grp, acct > 6000 AS ref FROM units") + f"SELECT u.zcta_id, round(d, 6) AS nearest_reference_km FROM u LEFT JOIN (SELECT u.zcta_id, min({hav('u.lat', 'u.lon', 's.lat', 's.lon', MEAN_KM)}) AS d FROM u JOIN u s ON u.grp = s.grp AND s.ref AND s.grp <> 4 GROUP BY 1) USING (zcta_id)")
def _(t):
    u = t.units.select("zcta_id", "lat", "lon", (F.col("k") % 7).alias("grp"), "acct")
    ref = u.filter((F.col("acct") > 6000) & (F.col("grp") != 4)).withColumnRenamed("zcta_id", "ref_id")
    n = S.k_nearest(u, ref, "zcta_id", "ref_id", by=["grp"], radius=MEAN_KM)
    return u.select("zcta_id").join(n.select("zcta_id", F.round("dist_km", 6).alias("nearest_reference_km")), "zcta_id", "left")


TRACK = "SELECT event_type AS event, date_trunc('day', ts) + INTERVAL 6 HOUR * (CAST(hour(ts) AS INTEGER) // 6) AS ts, 24.0 + avg(user_id) / 10.0 AS lat, -110.0 + avg(value) / 10.0 AS lon, max(value) AS wind FROM events GROUP BY 1, 2"


def _track(t):
    ts = F.col("ts").cast("timestamp")
    return t.raw("events").groupBy(F.col("event_type").alias("event"), (F.date_trunc("day", ts) + F.make_dt_interval(F.lit(0), F.floor(F.hour("ts") / 6) * 6)).alias("ts")).agg(
        (24.0 + F.avg("user_id") / 10.0).alias("lat"), (-110.0 + F.avg("value") / 10.0).alias("lon"), F.max("value").alias("wind"))


@query("j09_storm_min_distance", W("units", tr=TRACK, c="SELECT event, max(CASE WHEN wind >= 137 THEN 5 WHEN wind >= 113 THEN 4 WHEN wind >= 96 THEN 3 WHEN wind >= 83 THEN 2 WHEN wind >= 64 THEN 1 ELSE 0 END) AS cat FROM tr GROUP BY 1") + f"SELECT u.zcta_id, s.event, round(min({US}), 6) AS storm_min_dist_km, any_value(cat) AS storm_landfall_category FROM units u CROSS JOIN tr s JOIN c USING (event) GROUP BY 1, 2")
def _(t):
    from plumbline.functions.text import wind_category

    tr = _track(t)
    ev = tr.groupBy("event").agg(F.max(wind_category("wind")).alias("storm_landfall_category"))
    u = t.units.select("zcta_id", "lat", "lon", F.explode(tr.agg(F.sort_array(F.collect_set("event"))).scalar()).alias("event"))
    n = S.k_nearest(u, tr.withColumn("site_id", F.col("ts").cast("string")), "zcta_id", "site_id", by=["event"])
    return n.join(ev, "event").select("zcta_id", "event", F.round("dist_km", 6).alias("storm_min_dist_km"), "storm_landfall_category")


@query("j09_closest_approach_flat", W("units", tr=TRACK, p="SELECT zcta_id, event, sqrt(pow((s.lat - u.lat) * 110.57, 2) + pow((s.lon - u.lon) * 111.32 * cos(radians(u.lat)), 2)) AS d, ts, wind, min(ts) OVER (PARTITION BY event) AS a, max(ts) OVER (PARTITION BY event) AS z FROM units u CROSS JOIN tr s",
       b="SELECT zcta_id, event, min(d) AS d, arg_min({'t': ts, 'w': wind}, (d, ts)) AS m, any_value(a) AS a, any_value(z) AS z FROM p GROUP BY 1, 2") + "SELECT zcta_id, event, round(d, 6) AS storm_closest_km, epoch(m.t - a) / 3600 AS storm_closest_hour, m.w AS storm_max_wind_kt, epoch(z - a) / 3600 AS storm_duration_hr FROM b")
def _(t):
    return rnd(S.closest_fix(t.units, _track(t)), 6, "storm_closest_km")


# polygons: boxes around points derived from the part table; every third one is an L shape
BOX = "SELECT p_partkey AS poly_id, -120.0 + (p_partkey * 71 % 5000) / 100.0 + 0.0037 AS x0, 25.0 + (p_partkey * 43 % 2400) / 100.0 + 0.0037 AS y0, (p_size % 13 + 1) / 5.0 AS w, (p_size % 7 + 1) / 5.0 AS h, p_size FROM part"


def _boxes(t, ell: bool = True):
    k = F.col("p_partkey")
    b = t.raw("part").select(k.alias("poly_id"), (-120.0 + k * 71 % 5000 / 100.0 + 0.0037).alias("x0"), (25.0 + k * 43 % 2400 / 100.0 + 0.0037).alias("y0"),
                             ((F.col("p_size") % 13 + 1) / 5.0).alias("w"), ((F.col("p_size") % 7 + 1) / 5.0).alias("h"), "p_size")
    c = lambda fx, fy: F.struct((F.col("x0") + F.col("w") * fx).alias("x"), (F.col("y0") + F.col("h") * fy).alias("y"))
    box, l_shape = F.array(c(0, 0), c(1, 0), c(1, 1), c(0, 1)), F.array(c(0, 0), c(1, 0), c(1, 0.5), c(0.5, 0.5), c(0.5, 1), c(0, 1))
    return b.withColumn("ring", F.when(F.col("poly_id") % 3 == 0, l_shape).otherwise(box) if ell else box)


IN_BOX = "u.lon BETWEEN x0 AND x0 + w AND u.lat BETWEEN y0 AND y0 + h AND NOT (poly_id % 3 = 0 AND u.lon > x0 + w * 0.5 AND u.lat > y0 + h * 0.5)"


@query("j10_first_containing_polygon", W("units", b=BOX) + f"SELECT zcta_id, poly_id FROM units LEFT JOIN (SELECT u.zcta_id, min(poly_id) AS poly_id FROM units u JOIN b ON {IN_BOX} GROUP BY 1) USING (zcta_id)")
def _(t):
    return S.first_polygon(t.units, _boxes(t), "zcta_id", "lon", "lat", "poly_id")


UBOX = "SELECT zcta_id, lon AS x0, lat AS y0, 0.61 + (k % 5) / 10.0 AS w, 0.41 + (k % 3) / 10.0 AS h FROM units"


def _unit_boxes(t):
    w, h = 0.61 + F.col("k") % 5 / 10.0, 0.41 + F.col("k") % 3 / 10.0
    c = lambda dx, dy: F.struct((F.col("lon") + dx).alias("x"), (F.col("lat") + dy).alias("y"))
    z = F.lit(0.0)
    return t.units.select("zcta_id", F.array(c(z, z), c(w, z), c(w, h), c(z, h)).alias("ring"))


OVER = "greatest(0, least(u.x0 + u.w, {x1}) - greatest(u.x0, {x0})) * greatest(0, least(u.y0 + u.h, {y1}) - greatest(u.y0, {y0}))"
AREA = (OVER.format(x0="b.x0", x1="b.x0 + b.w", y0="b.y0", y1="b.y0 + b.h") + " - CASE WHEN poly_id % 3 = 0 THEN "
        + OVER.format(x0="b.x0 + b.w * 0.5", x1="b.x0 + b.w", y0="b.y0 + b.h * 0.5", y1="b.y0 + b.h") + " ELSE 0 END")
OVL = f"SELECT zcta_id, poly_id, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'X500' END AS cls, u.w * u.h AS area, {AREA} AS o FROM u JOIN b ON u.x0 < b.x0 + b.w AND b.x0 < u.x0 + u.w AND u.y0 < b.y0 + b.h AND b.y0 < u.y0 + u.h"


@query("j11_overlay_pairs", W("units", u=UBOX, b=BOX, o=OVL) + "SELECT zcta_id, poly_id, round(o, 7) AS overlap FROM o WHERE o > 1e-9")
def _(t):
    o = S.overlay_lists(_unit_boxes(t), _boxes(t), "zcta_id", "poly_id").filter("overlap > 1e-9")
    return S.expanded(rnd(o, 7, "overlap"), "zcta_id", "poly_id")


@query("j11_zone_percentages", W("units", u=UBOX, b=BOX, o=OVL, g="SELECT zcta_id, sum(CASE WHEN cls = 'A' THEN o ELSE 0 END) AS a, sum(CASE WHEN cls <> 'A' THEN o ELSE 0 END) AS x FROM o GROUP BY 1",
       p="SELECT u.zcta_id, least(coalesce(a, 0) / (w * h) * 100, 100) AS a, least(coalesce(x, 0) / (w * h) * 100, 100) AS x FROM u LEFT JOIN g USING (zcta_id)") + "SELECT zcta_id, round_even(a, 2) AS pct_zone_a, round_even(x, 2) AS pct_zone_x500, a > 0.005 AS sfha FROM p")
def _(t):
    z = _boxes(t).withColumn("cls", F.when(F.col("p_size") % 2 == 0, "A").otherwise("X500"))
    return S.zone_percentages(_unit_boxes(t), z, "zcta_id", "poly_id", "cls").drop("pct_zone_x")


@query("j11_merge_shards", "SELECT l_suppkey AS zcta_id, round_even(least(sum(CASE WHEN l_returnflag = 'A' THEN l_tax ELSE 0 END) / 131.7 * 100, 100), 2) AS pct_zone_a, round_even(least(sum(CASE WHEN l_returnflag = 'R' THEN l_tax ELSE 0 END) / 131.7 * 100, 100), 2) AS pct_zone_x500 FROM lineitem GROUP BY 1")
def _(t):
    li = t.raw("lineitem")
    sh = li.groupBy(F.col("l_suppkey").alias("zcta_id"), F.col("l_linenumber").alias("shard")).agg(
        F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_tax")).otherwise(0.0)).alias("area_a"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_tax")).otherwise(0.0)).alias("area_x500")).withColumn("unit_area", F.lit(131.7))
    return S.merge_zone_shards(sh, "zcta_id")


@query("j12_buildings_in_polygons", W(b=BOX, e=EV) + f"SELECT poly_id, count(*) AS n_buildings, round(sum((event_id % 90 + 10)::DOUBLE), 6) AS footprint FROM e u JOIN b ON {IN_BOX} GROUP BY 1")
def _(t):
    r = _reports(t).withColumn("area", (F.col("event_id") % 90 + 10).cast("double")).withColumn("qk", S.quadkey(F.col("lat"), F.col("lon"), 8))
    return rnd(S.buildings_in_polygons(r, _boxes(t), "lon", "lat", "poly_id", "area", "qk", ["02", "03"]), 6, "footprint")


@query("j12_quadkey_prefix", W("units") + """SELECT zcta_id, CASE WHEN ty >= 4 THEN '2' ELSE '0' END || CASE WHEN tx % 4 >= 2 THEN CASE WHEN ty % 4 >= 2 THEN '3' ELSE '1' END ELSE CASE WHEN ty % 4 >= 2 THEN '2' ELSE '0' END END
    || CASE WHEN tx % 2 = 1 THEN CASE WHEN ty % 2 = 1 THEN '3' ELSE '1' END ELSE CASE WHEN ty % 2 = 1 THEN '2' ELSE '0' END END AS quadkey
    FROM (SELECT zcta_id, floor((lon + 180) / 360 * 8)::INT AS tx, floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 8)::INT AS ty FROM units)""")
def _(t):
    return t.units.select("zcta_id", S.quadkey(F.col("lat"), F.col("lon"), 3).alias("quadkey"))


@query("j13_county_best_rating", W("units") + "SELECT zcta_id, r AS rating FROM units LEFT JOIN (SELECT n_name AS county_name, max(s_suppkey % 6) AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) USING (county_name)")
def _(t):
    key = lambda c: F.lower(F.trim(F.col(c)))
    r = t.sites.groupBy(key("county_name").alias("ck")).agg(F.max(F.col("site_id").cast("long") % 6).alias("rating"))
    return t.units.withColumn("ck", key("county_name")).join(r, "ck", "left").select("zcta_id", "rating")


@query("j14_sites_within_radius", W("units", "sites", p=PAIRS) + "SELECT zcta_id, count(*) FILTER (d <= 300) AS n_within, coalesce(sum(beds) FILTER (d <= 300), 0) AS weight_within, round(min(d) * 1000, 3) AS nearest_m FROM p GROUP BY 1")
def _(t):
    n = S.k_nearest(t.units, t.sites, "zcta_id", "site_id").select("zcta_id", F.round(F.col("dist_km") * 1000, 3).alias("nearest_m"))
    return S.within_radius(t.units, t.sites, "zcta_id", 300.0, "beds").join(n, "zcta_id")


MEM = "SELECT l_suppkey AS region, l_partkey % 60 AS huc, sum(l_extendedprice) / 3000000.0 AS overlap_frac FROM lineitem GROUP BY 1, 2"


def _mem(t):
    return t.raw("lineitem").groupBy(F.col("l_suppkey").alias("region"), (F.col("l_partkey") % 60).alias("huc")).agg((F.sum("l_extendedprice") / 3000000.0).alias("overlap_frac"))


DOM = "SELECT *, row_number() OVER (PARTITION BY region ORDER BY overlap_frac DESC, huc) = 1 AS is_dominant FROM m WHERE overlap_frac >= 0.2"


@query("j21_dominant_membership", f"WITH m AS ({MEM}) SELECT region, huc, round(overlap_frac, 8) AS overlap_frac, is_dominant FROM ({DOM})")
def _(t):
    return rnd(S.dominant_membership(_mem(t), "region", "huc", 0.2), 8, "overlap_frac")


@query("j22_shared_basin_edges", f"WITH m AS ({MEM}), k AS (SELECT * FROM m WHERE overlap_frac >= 0.25) SELECT a.region AS src, b.region AS dst, round(max(least(a.overlap_frac, b.overlap_frac)), 8) AS weight, 'shared_huc' AS relation FROM k a JOIN k b ON a.huc = b.huc AND a.region < b.region GROUP BY 1, 2")
def _(t):
    return rnd(S.shared_basin_edges(_mem(t).filter("overlap_frac >= 0.25"), "region", "huc"), 8, "weight")


FLOW = "SELECT DISTINCT p_partkey % 60 AS f, (p_partkey * 7) % 60 AS t, ((p_partkey % 60) % 9 + 1)::DOUBLE AS w FROM part"


@query("j23_drainage_edges", f"WITH m AS ({MEM}), d AS ({DOM}), k AS (SELECT * FROM d WHERE is_dominant), f AS ({FLOW}) SELECT least(a.region, b.region) AS src, greatest(a.region, b.region) AS dst, max(w) AS weight, 'drainage' AS relation FROM f JOIN k a ON a.huc = f.f JOIN k b ON b.huc = f.t WHERE a.region <> b.region GROUP BY 1, 2")
def _(t):
    k = F.col("p_partkey")
    flow = t.raw("part").select((k % 60).alias("from_basin"), (k * 7 % 60).alias("to_basin"), (k % 60 % 9 + 1).cast("double").alias("weight")).distinct()
    return S.drainage_edges(S.dominant_membership(_mem(t), "region", "huc", 0.2), flow, "region", "huc")


UU = hav("a.lat", "a.lon", "b.lat", "b.lon")
KNN = f"SELECT a.zcta_id AS s, b.zcta_id AS t, {UU} AS d FROM units a JOIN units b ON a.zcta_id <> b.zcta_id QUALIFY row_number() OVER (PARTITION BY a.zcta_id ORDER BY {UU}, b.zcta_id) <= 4"


@query("j24_knn_gaussian_edges", W("units", nn=KNN, g="SELECT quantile_cont(d, 0.5) AS q FROM nn") + "SELECT least(s, t) AS src, greatest(s, t) AS dst, 'centroid_distance' AS relation, round(max(exp(-d * d / (2 * q * q))), 8) AS weight FROM nn, g GROUP BY 1, 2")
def _(t):
    return rnd(S.gaussian_knn_edges(t.units, "zcta_id", 4), 8, "weight")


@query("j25_combine_edges", W("edges", x="SELECT src, dst, relation, weight * 3 AS weight FROM edges UNION ALL SELECT src, dst, 'other', length(src) + weight FROM edges UNION ALL SELECT src, dst, 'other', weight FROM edges") + "SELECT src, dst, relation, round(max(w), 8) AS weight FROM (SELECT *, weight / max(weight) OVER (PARTITION BY relation) AS w FROM x) GROUP BY 1, 2, 3")
def _(t):
    e = t.edges.select("src", "dst", "relation", "weight")
    return rnd(S.combine_edges(e.withColumn("weight", F.col("weight") * 3), e.withColumns({"relation": F.lit("other"), "weight": F.length("src") + F.col("weight")}), e.withColumn("relation", F.lit("other"))), 8, "weight")


@query("j26_adjacency_degree", W("units", "edges", "nbr") + f"SELECT u.zcta_id, count(e.dst) AS degree, round(avg({hav('u.lat', 'u.lon', 's.lat', 's.lon')}), 6) AS mean_neighbor_km FROM units u LEFT JOIN nbr e ON e.src = u.zcta_id LEFT JOIN units s ON s.zcta_id = e.dst GROUP BY 1")
def _(t):
    return rnd(S.degree_and_distance(S.adjacency(t.edges, t.units), t.units), 6, "mean_neighbor_km")


@query("j27_nearest_grid_cell", W("units", c="SELECT (p_partkey // 100)::INT AS r, (p_partkey % 100)::INT AS c, p_retailprice AS v FROM part") + "SELECT zcta_id, v AS elevation FROM units LEFT JOIN c ON r = floor((lat - 25.1) / 1.3 + 0.5) AND c = floor((lon + 119.9) / 0.7 + 0.5)")
def _(t):
    cells = t.raw("part").select(F.floor(F.col("p_partkey") / 100).alias("row"), (F.col("p_partkey") % 100).alias("col"), F.col("p_retailprice").alias("elevation"))
    return S.nearest_cell(t.units.select("zcta_id", "lat", "lon"), cells, 25.1, -119.9, 1.3, 0.7, "elevation").select("zcta_id", "elevation")
