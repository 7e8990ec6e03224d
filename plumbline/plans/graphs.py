"""Spatial statistics queries over the unit graph."""

from pyspark.sql import functions as F

from plumbline.operators import graph as G
from plumbline.operators.balls import gabriel_graph
from plumbline.plans import drawsql as D
from plumbline.plans.assembly import rnd
from plumbline.plans.registry import query
from plumbline.plans.standins import W, hsh, zf

VAL = "SELECT zcta_id, CASE WHEN k % 11 > 0 THEN acct END AS acct, pop FROM units"


def _vals(t):
    return t.units.select("zcta_id", F.when(F.col("k") % 11 > 0, F.col("acct")).alias("acct"), "pop", "k", "county_fips", "lat", "lon")


def _nbr(t):
    return G.symmetric(t.edges)


@query("g01_lag_skip_missing", W("units", "edges", "nbr", v=VAL) + "SELECT v.zcta_id, round(a, 6) AS lag_acct, round(p, 6) AS lag_pop FROM v LEFT JOIN (SELECT src AS zcta_id, avg(acct) AS a, avg(pop) AS p FROM nbr JOIN v ON v.zcta_id = dst GROUP BY 1) USING (zcta_id)")
def _(t):
    return rnd(G.spatial_lag(_nbr(t), _vals(t), ["acct", "pop"]), 6, "lag_acct", "lag_pop")


@query("g02_lag_median_filled", W("units", "edges", "nbr", v=VAL, f="SELECT zcta_id, coalesce(acct, (SELECT quantile_cont(acct, 0.5) FROM v)) AS acct FROM v") + "SELECT v.zcta_id, round(coalesce(a, 0), 6) AS lag_acct FROM v LEFT JOIN (SELECT src AS zcta_id, avg(acct) AS a FROM nbr JOIN f ON f.zcta_id = dst GROUP BY 1) USING (zcta_id)")
def _(t):
    return rnd(G.spatial_lag(_nbr(t), _vals(t), ["acct"], missing="median"), 6, "lag_acct")


EVAL = "SELECT zcta_id, s AS slice, CASE WHEN k % (7 + s) > 0 THEN acct * s END AS x FROM units CROSS JOIN (VALUES (1), (2)) v(s)"


@query("g03_lag_mean_filled_by_event", W("units", "edges", "nbr", v=EVAL, f="SELECT zcta_id, slice, coalesce(x, avg(x) OVER (PARTITION BY slice)) AS x FROM v") + "SELECT v.zcta_id, v.slice, round(a, 6) AS lag_x FROM v LEFT JOIN (SELECT src AS zcta_id, slice, sum(weight * x) / sum(weight) AS a FROM nbr JOIN f ON f.zcta_id = dst GROUP BY 1, 2) USING (zcta_id, slice)")
def _(t):
    v = t.units.withColumn("slice", F.explode(F.array(F.lit(1), F.lit(2)))).select("zcta_id", "slice", F.when(F.col("k") % (7 + F.col("slice")) > 0, F.col("acct") * F.col("slice")).alias("x"))
    return rnd(G.spatial_lag(_nbr(t), v, ["x"], missing="mean", by=["slice"]), 6, "lag_x")


AUTO = """, z AS (SELECT {g} zcta_id, x - avg(x) OVER (PARTITION BY {p}) AS z, count(*) OVER (PARTITION BY {p}) AS n, sum(x * x) OVER (PARTITION BY {p}) - count(*) OVER (PARTITION BY {p}) * avg(x) OVER (PARTITION BY {p}) * avg(x) OVER (PARTITION BY {p}) AS ss FROM x WHERE x IS NOT NULL),
 m AS (SELECT {ga} any_value(a.n) AS n, any_value(a.n) / sum(weight) * sum(weight * a.z * b.z) / any_value(a.ss) AS i, (any_value(a.n) - 1) / (2 * sum(weight)) * sum(weight * (a.z - b.z) * (a.z - b.z)) / any_value(a.ss) AS c FROM nbr JOIN z a ON a.zcta_id = src JOIN z b ON b.zcta_id = dst {on} {grp})
 SELECT {gm} n, round(i, 6) AS moran_i, round(greatest(0, least(1, 1 - abs(i))), 6) AS kappa_spatial, round(c, 6) AS geary_c, CASE WHEN c < 0.95 THEN 'positive_autocorrelation' WHEN c > 1.05 THEN 'negative_autocorrelation' ELSE 'no_significant_autocorrelation' END AS interpretation FROM m"""


@query("g05_global_autocorrelation", W("units", "edges", "nbr", x="SELECT zcta_id, CASE WHEN k % 11 > 0 THEN pop END AS x FROM units").rstrip() + AUTO.format(g="", p="1", ga="", on="", grp="", gm=""))
def _(t):
    v = t.units.select("zcta_id", F.when(F.col("k") % 11 > 0, F.col("pop")).alias("x"))
    return rnd(G.global_autocorrelation(_nbr(t), v, "x"), 6, "moran_i", "kappa_spatial", "geary_c")


@query("g12_autocorrelation_by_group", W("units", "edges", "nbr", x="SELECT zcta_id, (k // 50) % 3 AS grp, pop AS x FROM units").rstrip() + AUTO.format(g="grp,", p="grp", ga="a.grp AS grp,", on="AND a.grp = b.grp", grp="GROUP BY 1", gm="grp,"))
def _(t):
    v = t.units.select("zcta_id", (F.floor(F.col("k") / 50) % 3).alias("grp"), F.col("pop").alias("x"))
    e = _nbr(t)
    return rnd(G.global_autocorrelation(e, v, "x", by=["grp"]), 6, "moran_i", "kappa_spatial", "geary_c").filter("moran_i IS NOT NULL")


LISA = """, s AS (SELECT zcta_id, (coalesce(acct, 0) - avg(coalesce(acct, 0)) OVER ()) / stddev_pop(coalesce(acct, 0)) OVER () AS z, count(*) OVER () AS n, row_number() OVER (ORDER BY zcta_id) - 1 AS pos FROM v),
 l AS (SELECT src AS zcta_id, sum(weight * z) / sum(weight) AS lag, count(*) AS degree FROM nbr JOIN s ON s.zcta_id = dst GROUP BY 1),
 li AS (SELECT s.zcta_id, z, n, pos, coalesce(lag, 0) AS lag, coalesce(degree, 0) AS degree, (n - 1) / n * z * coalesce(lag, 0) AS local_i,
 CASE WHEN z > 0 AND coalesce(lag, 0) > 0 THEN 'HH' WHEN z <= 0 AND coalesce(lag, 0) > 0 THEN 'LH' WHEN z <= 0 THEN 'LL' ELSE 'HL' END AS quadrant FROM s LEFT JOIN l USING (zcta_id))"""


@query("g08_local_moran", W("units", "edges", "nbr", v=VAL).rstrip() + LISA + " SELECT zcta_id, round(local_i, 6) AS local_i, degree, quadrant FROM li")
def _(t):
    return rnd(G.local_moran(_nbr(t), _vals(t), "acct"), 6, "local_i").select("zcta_id", "local_i", "degree", "quadrant")


DK = D.word("SELECT zcta_id, rep, z, n, degree, local_i, pos FROM li, unnest(range(1, 1000)) r(rep) WHERE degree > 0", 7, "rep", "pos")
WALK = D.placed("SELECT zcta_id, rep, z, n, degree, local_i, pos, h AS k, unnest(range(0, degree)) AS slot FROM dk", "slot", "(n - 1)", "k", "j") + " UNION ALL SELECT * RENAME (j2 AS j) FROM (SELECT * EXCLUDE (j) FROM (" + D.placed("SELECT * FROM walk WHERE j >= n - 1", "j", "(n - 1)", "k", "j2") + "))"
PERM = f""", dk AS ({DK}), walk AS ({WALK}), d AS (SELECT * FROM walk WHERE j < n - 1),
 sim AS (SELECT d.zcta_id, rep, any_value(local_i) AS o, (any_value(d.n) - 1) / any_value(d.n) * any_value(d.z) * sum(s.z) / any_value(degree) AS i FROM d JOIN s ON s.pos = d.j + CASE WHEN d.j >= d.pos THEN 1 ELSE 0 END GROUP BY 1, 2),
 p AS (SELECT zcta_id, (least(count(*) FILTER (i >= o - 1e-12 * greatest(1, abs(o))), 999 - count(*) FILTER (i >= o - 1e-12 * greatest(1, abs(o)))) + 1) / 1000.0 AS p_sim FROM sim GROUP BY 1), lp AS (SELECT li.*, coalesce(p_sim, 1.0) AS p_sim FROM li LEFT JOIN p USING (zcta_id)),
 adj AS (SELECT *, least(1, min(p_sim * n / r) OVER (ORDER BY p_sim ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adj FROM (SELECT *, count(*) OVER (ORDER BY p_sim RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM lp)),
 f AS (SELECT *, min(p_adj) OVER (PARTITION BY p_sim) AS pf, CASE WHEN min(p_adj) OVER (PARTITION BY p_sim) < 0.3 THEN quadrant ELSE 'ns' END AS cluster_label FROM adj)"""
LISA_W = W("units", "edges", "nbr", v=VAL).rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + LISA + PERM


def _local(t):
    return G.local_moran_p(G.local_moran(_nbr(t), _vals(t), "acct"), 999, 7)


def _lisa(t):
    return G.significant_clusters(G.bh_adjust(_local(t), "p_sim"), "p_adj", 0.3)


GV = "SELECT zcta_id, CASE WHEN k % 11 > 0 THEN pop + acct END AS x FROM units"
GZ = f"SELECT zcta_id, x - avg(x) OVER () AS z, count(*) OVER () AS n, row_number() OVER (ORDER BY zcta_id) - 1 AS pos FROM ({GV}) WHERE x IS NOT NULL"
GWALK = D.placed("SELECT rep, n, h AS k, unnest(range(0, n)) AS pos FROM gk", "pos", "n", "k", "j") + " UNION ALL SELECT * RENAME (j2 AS j) FROM (SELECT * EXCLUDE (j) FROM (" + D.placed("SELECT * FROM gwalk WHERE j >= n", "j", "n", "k", "j2") + "))"
GSTAT = "any_value({n}) / sum(weight) * sum(weight * {a} * {b}) / (SELECT sum(z * z) FROM gz) AS i, (any_value({n}) - 1) / (2 * sum(weight)) * sum(weight * ({a} - {b}) * ({a} - {b})) / (SELECT sum(z * z) FROM gz) AS c"
GLOBAL = f""", gz AS ({GZ}), ge AS MATERIALIZED (SELECT a.pos AS sp, b.pos AS dp, a.z AS sz, b.z AS dz, a.n AS n, weight FROM nbr JOIN gz a ON a.zcta_id = src JOIN gz b ON b.zcta_id = dst),
 gk AS ({D.word("SELECT rep, (SELECT count(*) FROM gz) AS n FROM unnest(range(1, 1000)) r(rep)", 42, "rep")}), gwalk AS ({GWALK}), gp AS MATERIALIZED (SELECT rep, gwalk.pos, gz.z FROM gwalk JOIN gz ON gz.pos = gwalk.j WHERE j < gwalk.n),
 ga AS MATERIALIZED (SELECT gp.rep, ge.dp, ge.n, ge.weight, gp.z AS az FROM ge JOIN gp ON gp.pos = ge.sp),
 gs AS (SELECT ga.rep, {GSTAT.format(n="ga.n", a="ga.az", b="gp.z")} FROM ga JOIN gp ON gp.rep = ga.rep AND gp.pos = ga.dp GROUP BY 1), go AS (SELECT {GSTAT.format(n="n", a="sz", b="dz")} FROM ge),
 gt AS (SELECT any_value(go.i) AS i, any_value(go.c) AS c, count(*) FILTER (gs.i >= go.i - 1e-12) AS li, count(*) FILTER (gs.c >= go.c - 1e-12) AS lc FROM gs, go)"""
GP = "round(i, 6) AS moran_i, (least(li, 999 - li) + 1) / 1000 AS moran_p, round(c, 6) AS geary_c, (least(lc, 999 - lc) + 1) / 1000 AS geary_p"


def _global(t):
    v = t.units.select("zcta_id", F.when(F.col("k") % 11 > 0, F.col("pop") + F.col("acct")).alias("x"))
    return G.global_autocorrelation_p(_nbr(t), v, "x", 999, 42)


@query("g07_global_permutation_p", W("units", "edges", "nbr").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + GLOBAL + f" SELECT {GP} FROM gt")
def _(t):
    return rnd(_global(t).select("moran_i", "moran_p", "geary_c", "geary_p"), 6, "moran_i", "geary_c")


@query("g10_turbulence", LISA_W + GLOBAL + f""" SELECT {GP}, n_hotspots, n_coldspots, n_outliers, fraction_significant FROM gt, (SELECT count(*) FILTER (p_sim < 0.05 AND quadrant = 'HH') AS n_hotspots, count(*) FILTER (p_sim < 0.05 AND quadrant = 'LL') AS n_coldspots,
    count(*) FILTER (p_sim < 0.05 AND quadrant IN ('HL', 'LH')) AS n_outliers, round(avg((p_sim < 0.05)::INT), 8) AS fraction_significant FROM f)""")
def _(t):
    return rnd(rnd(G.turbulence(_global(t), _local(t)), 6, "moran_i", "geary_c"), 8, "fraction_significant")


@query("g09_lisa_fdr_clusters", LISA_W + " SELECT zcta_id, p_sim, round(pf, 8) AS p_adj, cluster_label FROM f")
def _(t):
    return rnd(_lisa(t), 8, "p_adj").select("zcta_id", "p_sim", "p_adj", "cluster_label")


@query("g10_lisa_rollup", LISA_W + """ SELECT round(avg((cluster_label = 'HH')::INT), 8) AS "frac_HH", round(avg((cluster_label = 'LL')::INT), 8) AS "frac_LL", round(avg((cluster_label IN ('HL', 'LH'))::INT), 8) AS frac_outlier, round(avg((cluster_label <> 'ns')::INT), 8) AS frac_significant,
    count(*) FILTER (cluster_label = 'HH') AS n_hotspots, count(*) FILTER (cluster_label = 'LL') AS n_coldspots, count(*) AS n_zctas FROM f""")
def _(t):
    return rnd(G.lisa_rollup(_lisa(t)), 8, "frac_HH", "frac_LL", "frac_outlier", "frac_significant")


@query("g11_cluster_attenuation", W("units", c="SELECT segment, lv, avg((CASE WHEN lv = 'r0' THEN k % 5 ELSE k % 7 END < 2)::INT) AS f FROM units CROSS JOIN (VALUES ('r0'), ('r1')) v(lv) GROUP BY 1, 2") + "SELECT segment, round(max(f) FILTER (lv = 'r0'), 8) AS frac_r0, round(max(f) FILTER (lv = 'r1'), 8) AS frac_r1, CASE WHEN max(f) FILTER (lv = 'r1') < max(f) FILTER (lv = 'r0') THEN 'attenuated' ELSE 'persisted' END AS sign_r0_r1 FROM c GROUP BY 1")
def _(t):
    u = t.units.withColumn("lv", F.explode(F.array(F.lit("r0"), F.lit("r1")))).withColumn("m", F.when(F.col("lv") == "r0", F.col("k") % 5).otherwise(F.col("k") % 7))
    roll = G.lisa_rollup(u.withColumn("cluster_label", F.when(F.col("m") == 0, "HH").when(F.col("m") == 1, "LL").otherwise("ns")), ["segment", "lv"])
    return rnd(G.attenuation(roll, ["segment"], "lv", ["r0", "r1"]), 8, "frac_r0", "frac_r1").drop("delta_r0_r1")


@query("g13_mean_residuals", W("oof") + "SELECT task, zcta, round(avg(y_true - y_pred), 6) AS residual, count(*) AS n FROM oof GROUP BY 1, 2")
def _(t):
    return rnd(G.mean_residuals(t.oof, ["task"], "zcta"), 6, "residual")


DEV = "greatest(1e-7, least(1 - 1e-7, y_pred / 60))"


@query("g13_deviance_residuals", W("oof") + f"SELECT zcta, round(avg(sign(y - q) * sqrt(greatest(-2 * (y * ln(q) + (1 - y) * ln(1 - q)), 0))), 6) AS residual, count(*) AS n FROM (SELECT zcta, (y_true > 25)::INT AS y, {DEV}::DOUBLE AS q FROM oof) GROUP BY 1")
def _(t):
    d = t.oof.select("zcta", (F.col("y_true") > 25).cast("double").alias("y_true"), (F.col("y_pred") / 60).alias("y_pred"))
    return rnd(G.mean_residuals(d, [], "zcta", True), 6, "residual")


@query("g14_variogram", W("units", p="SELECT zcta_id, lon AS x, lat AS y, acct AS v FROM units", q="SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, (a.v - b.v) * (a.v - b.v) AS s FROM p a JOIN p b ON a.zcta_id < b.zcta_id") + "SELECT floor(d / 1.5013)::BIGINT AS bin, round((floor(d / 1.5013) + 0.5) * 1.5013, 6) AS bin_center, count(*) AS n_pairs, round(avg(s) / 2, 3) AS semivariance FROM q WHERE d < 1.5013 * 12 GROUP BY 1, 2")
def _(t):
    return rnd(rnd(G.pair_bins(t.units, "lon", "lat", "acct", 1.5013, 12), 6, "bin_center"), 3, "semivariance")


@query("g15_block_diameters", W("units", m="SELECT zcta_id, k % 4 AS f, lon * 111.32 * cos(radians(avg(lat) OVER (PARTITION BY k % 4))) AS x, lat * 110.57 AS y FROM units") + "SELECT CAST(a.f AS VARCHAR) AS fold, round(sqrt(max((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS diameter_km FROM m a JOIN m b ON a.f = b.f GROUP BY 1")
def _(t):
    return rnd(G.block_diameters(t.units.withColumn("f", F.col("k") % 4), "f"), 6, "diameter_km")


@query("g15_block_size_verdict", W("units", m="SELECT zcta_id, k % 4 AS f, lon * 111.32 * cos(radians(avg(lat) OVER (PARTITION BY k % 4))) AS x, lat * 110.57 AS y FROM units", d="SELECT a.f AS fold, sqrt(max((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS dk FROM m a JOIN m b ON a.f = b.f GROUP BY 1")
       + "SELECT round(quantile_cont(dk, 0.5), 6) AS median_block_km, round(900 / quantile_cont(dk, 0.5), 8) AS ratio, CASE WHEN 900 / quantile_cont(dk, 0.5) > 1.5 THEN 'WARN_LEAKAGE' WHEN 900 / quantile_cont(dk, 0.5) < 0.3 THEN 'WARN_OVERSIZED' ELSE 'PASS' END AS status FROM d")
def _(t):
    return rnd(rnd(G.block_size_verdict(G.block_diameters(t.units.withColumn("f", F.col("k") % 4), "f"), 900.0), 6, "median_block_km"), 8, "ratio")


BADE = "SELECT src, dst FROM nbr WHERE weight = 1 OR src < dst UNION ALL SELECT src, src FROM edges WHERE weight < 1 UNION ALL SELECT src, 'zz' FROM edges WHERE weight = 1"


@query("g16_adjacency_report", W("units", "edges", "nbr", b=BADE, e="SELECT DISTINCT src, dst FROM b", d="SELECT zcta_id, count(dst) FILTER (src <> dst) AS d FROM units LEFT JOIN e ON src = zcta_id GROUP BY 1") + """SELECT count(*) AS n_units, count(*) FILTER (d = 0) AS n_islands, min(d) AS min_degree, max(d) AS max_degree, round(avg(d), 6) AS mean_degree,
    (SELECT count(*) FROM e WHERE src = dst) AS n_self_loops, (SELECT count(*) FROM e WHERE src <> dst AND (dst, src) NOT IN (SELECT (src, dst) FROM e)) AS n_one_way, (SELECT count(*) FROM e WHERE src NOT IN (SELECT zcta_id FROM units)) AS n_outside FROM d""".replace("(dst, src) NOT IN (SELECT (src, dst) FROM e)", "NOT EXISTS (SELECT 1 FROM e f WHERE f.src = e.dst AND f.dst = e.src)"))
def _(t):
    n, e = _nbr(t), t.edges
    b = n.filter("weight = 1 OR src < dst").select("src", "dst").union(e.filter("weight < 1").select("src", F.col("src").alias("dst"))).union(e.filter("weight = 1").select("src", F.lit("zz")))
    return rnd(G.adjacency_report(b, t.units), 6, "mean_degree")


@query("g16_lag_correlation", W("units", "edges", "nbr", l="SELECT src AS zcta_id, avg(acct) AS l FROM nbr JOIN units ON zcta_id = dst GROUP BY 1") + "SELECT round(corr(acct, l), 8) AS lag_corr, count(l) AS n FROM units JOIN l USING (zcta_id)")
def _(t):
    return rnd(G.lag_correlation(_nbr(t), t.units, "acct"), 8, "lag_corr")


@query("g17_leakage_rate", W("units", "edges", "nbr", u="SELECT zcta_id, (k // 40) % 5 AS f FROM units") + "SELECT f, round(avg(CASE WHEN EXISTS (SELECT 1 FROM nbr JOIN u b ON b.zcta_id = dst WHERE src = u.zcta_id AND b.f <> u.f) THEN 1.0 ELSE 0.0 END), 8) AS leakage_rate, count(*) AS n_test FROM u GROUP BY 1")
def _(t):
    u = t.units.select("zcta_id", F.floor(F.col("k") / 40).alias("f0")).select("zcta_id", (F.col("f0") % 5).alias("f"))
    return rnd(G.leakage_rate(_nbr(t), u, "f"), 8, "leakage_rate")


@query("g18_adjacency_coverage", W("units", "edges") + "SELECT count(*) AS n_populated, count(*) FILTER (h) AS n_covered, round(avg(h::INT), 8) AS coverage FROM (SELECT zcta_id IN (SELECT src FROM edges UNION ALL SELECT dst FROM edges) AS h FROM units WHERE pop - 100 > 0)")
def _(t):
    return rnd(G.adjacency_coverage(t.edges, t.units.withColumn("p", F.col("pop") - 100), "p"), 8, "coverage")


G19 = f"""SELECT v.l, w.s, zcta_id, row_number() OVER (PARTITION BY v.l, w.s ORDER BY {hsh("='w' || CAST(w.s AS VARCHAR)", 'zcta_id')}, zcta_id) - 1 AS pos, floor(v.l * count(*) OVER (PARTITION BY v.l, w.s)) AS k FROM units CROSS JOIN (VALUES (0.2), (0.6)) v(l) CROSS JOIN (VALUES (0), (1)) w(s)"""


@query("g19_permuted_weights", W("units", "edges", "nbr", r=G19, m="SELECT a.l, a.s, a.zcta_id AS dst, b.zcta_id AS new FROM r a JOIN r b ON a.l = b.l AND a.s = b.s AND b.pos = (a.pos + 1) % a.k AND a.pos < a.k",
       e="SELECT v.l, w.s, src, coalesce(new, n.dst) AS dst, weight FROM nbr n CROSS JOIN (VALUES (0.2), (0.6)) v(l) CROSS JOIN (VALUES (0), (1)) w(s) LEFT JOIN m ON m.l = v.l AND m.s = w.s AND m.dst = n.dst", g="SELECT l, s, src, dst, sum(weight) AS w FROM e WHERE src <> dst GROUP BY 1, 2, 3, 4")
       + "SELECT l::DOUBLE AS level, s AS seed, src, dst, round(w / sum(w) OVER (PARTITION BY l, s, src), 8) AS weight FROM g")
def _(t):
    return rnd(G.permute_weights(_nbr(t), t.units, [0.2, 0.6], 2), 8, "weight")


DIMS = 64
REG = "SELECT 'r' || CAST(label AS VARCHAR) || '_' || CAST(vec_id % 4 AS VARCHAR) AS id, " + ", ".join(f"avg(embedding[{i}]::DOUBLE) AS e{i}" for i in range(1, DIMS + 1)) + ", avg(vec_id * 37 % 101)::DOUBLE AS x, avg(vec_id * 61 % 97)::DOUBLE AS y FROM embeddings GROUP BY 1"


def _regions(t):
    e, v = F.col("embedding"), F.col("vec_id")
    return t.raw("embeddings").groupBy(F.concat(F.lit("r"), F.col("label").cast("string"), F.lit("_"), (v % 4).cast("string")).alias("id")).agg(
        F.array(*[F.avg(e[i].cast("double")) for i in range(DIMS)]).alias("vec"), F.avg(v * 37 % 101).alias("x"), F.avg(v * 61 % 97).alias("y"))


D2 = " + ".join(f"(a.e{i} - b.e{i}) ** 2" for i in range(1, DIMS + 1))
GAB = f"SELECT a.id AS i, b.id AS j FROM r a JOIN r b ON a.id < b.id WHERE NOT EXISTS (SELECT 1 FROM d p JOIN d q ON p.j = q.i WHERE p.i = a.id AND q.j = b.id AND p.d2 + q.d2 < {D2})"
DD = f"SELECT a.id AS i, b.id AS j, {D2} AS d2 FROM r a JOIN r b ON a.id <> b.id"


def _gabriel(t):
    return gabriel_graph(_regions(t), "id", "vec")


@query("g20_gabriel_graph", f"WITH r AS ({REG}), d AS ({DD}), p AS (SELECT p.i, q.j, min(p.d2 + q.d2) AS m FROM d p JOIN d q ON p.j = q.i WHERE p.i < q.j GROUP BY 1, 2) SELECT i, j FROM d JOIN p USING (i, j) WHERE m >= d2")
def _(t):
    return _gabriel(t)


CROSS = """, g AS (SELECT i, j FROM d JOIN p USING (i, j) WHERE m >= d2), s AS (SELECT i, j, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM g JOIN r a ON a.id = i JOIN r b ON b.id = j),
 c AS (SELECT a.i AS i1, a.j AS j1, b.i AS i2, b.j AS j2, (a.bx - a.ax) * (b.by - b.ay) - (a.by - a.ay) * (b.bx - b.ax) AS den, (b.ax - a.ax) * (b.by - b.ay) - (b.ay - a.ay) * (b.bx - b.ax) AS tn, (b.ax - a.ax) * (a.by - a.ay) - (b.ay - a.ay) * (a.bx - a.ax) AS un
 FROM s a JOIN s b ON (a.i < b.i OR (a.i = b.i AND a.j < b.j)) AND a.i <> b.i AND a.i <> b.j AND a.j <> b.i AND a.j <> b.j)"""


@query("g21_edge_crossings", f"WITH r AS ({REG}), d AS ({DD}), p AS (SELECT p.i, q.j, min(p.d2 + q.d2) AS m FROM d p JOIN d q ON p.j = q.i WHERE p.i < q.j GROUP BY 1, 2)" + CROSS + " SELECT i1, j1, i2, j2 FROM c WHERE abs(den) >= 1e-12 AND tn / den > 0 AND tn / den < 1 AND un / den > 0 AND un / den < 1")
def _(t):
    return G.crossings(_gabriel(t), _regions(t).select("id", "x", "y"))


@query("g22_kappa_reconstruct")
def _(t):
    return G.kappa_reconstruct(_gabriel(t), _regions(t).select("id", "x", "y"), 20)


@query("g23_mantel_stress", f"WITH r AS ({REG}), q AS (SELECT sqrt({D2}) AS x, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS y FROM r a JOIN r b ON a.id < b.id) SELECT round(corr(x, y), 8) AS mantel_r, round(sqrt(sum((x - y) ** 2) / sum(x * x)), 5) AS stress, count(*) AS n_pairs FROM q")
def _(t):
    r = _regions(t)
    d = lambda v: G.region_distances(r.withColumn("v", v), "id", "v").select("i", "j", F.sqrt("d2").alias("d"))
    return rnd(rnd(G.mantel(d(F.col("vec")), d(F.array("x", "y")), r, 19), 8, "mantel_r"), 5, "stress").drop("mantel_p")


@query("g24_grown_blocks")
def _(t):
    return G.grow_blocks(t.edges, t.units, 60)
