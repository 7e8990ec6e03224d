"""Split and fold queries."""

from pyspark.sql import functions as F

from plumbline.operators import folds as D
from plumbline.plans.assembly import rnd
from plumbline.plans.registry import query
from plumbline.plans.standins import W, hsh

ORD = "row_number() OVER ({p} ORDER BY {h}, {k})"


@query("f01_random_split", W("units") + f"SELECT zcta_id, CASE WHEN {ORD.format(p='', h=hsh(42, 'zcta_id'), k='zcta_id')} <= greatest(1, floor(count(*) OVER () * 0.2)) THEN 'test' ELSE 'train' END AS split FROM units")
def _(t):
    return D.holdout(t.units.select("zcta_id"), [], "zcta_id", 42)


@query("f02_block_keys", W("units", b="SELECT zcta_id, CASE WHEN (SELECT count(DISTINCT state_fips) FROM units) >= 7 THEN state_fips ELSE substr(zcta_id, 1, 3) END AS b FROM units", g="SELECT b, count(*) AS n FROM b GROUP BY 1") + "SELECT zcta_id, CASE WHEN n > floor((SELECT count(*) FROM units) * 0.4) THEN b || '_' || substr(zcta_id, 1, 4) ELSE b END AS block FROM b JOIN g USING (b)")
def _(t):
    return D.block_keys(t.units, 7, "zcta_id", "state_fips")


FOLDS = W("units", b="SELECT zcta_id, CASE WHEN (SELECT count(DISTINCT county_fips) FROM units) >= 5 THEN coalesce(county_fips, 'unknown') ELSE substr(zcta_id, 1, 3) END AS b FROM units", g="SELECT b, count(*) AS n FROM b GROUP BY 1",
          k="SELECT zcta_id, CASE WHEN n > floor((SELECT count(*) FROM units) * 0.4) THEN b || '_' || substr(zcta_id, 1, 4) ELSE b END AS block FROM b JOIN g USING (b)", sz=f"SELECT block, count(*) AS n, {hsh(42, 'block')} AS h FROM k GROUP BY block",
          big="SELECT block, n, row_number() OVER (ORDER BY block) AS j FROM sz WHERE n >= 5", small="SELECT block, n, row_number() OVER (ORDER BY n DESC, block) AS i FROM sz WHERE n < 5").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
 m AS (SELECT 0::BIGINT AS i, (SELECT list(n ORDER BY block) FROM big) AS l, NULL::VARCHAR AS block, 0::BIGINT AS j UNION ALL SELECT i, list_transform(l, lambda v, q: v + CASE WHEN q = j THEN n ELSE 0 END), block, j FROM (SELECT x.i, x.n, x.block, m.l, CAST(list_position(m.l, list_min(m.l)) AS BIGINT) AS j FROM m JOIN small x ON x.i = m.i + 1)),
 t AS (SELECT block, n, h, coalesce((SELECT big.block FROM m JOIN big USING (j) WHERE m.block = sz.block), block) AS merged FROM sz),
 o AS (SELECT merged, n, row_number() OVER (ORDER BY h, merged) AS i FROM (SELECT merged, sum(n)::BIGINT AS n, max(h) FILTER (block = merged) AS h FROM t GROUP BY 1)),
 p AS (SELECT 0::BIGINT AS i, [0::BIGINT, 0, 0, 0, 0] AS l, NULL::VARCHAR AS merged, 0 AS f UNION ALL SELECT i, list_transform(l, lambda v, q: v + CASE WHEN q = f + 1 THEN n ELSE 0 END), merged, f FROM (SELECT o.i, o.n, o.merged, p.l, CAST(list_position(p.l, list_min(p.l)) AS INTEGER) - 1 AS f FROM p JOIN o ON o.i = p.i + 1))
 SELECT zcta_id, block, merged, f AS fold FROM k JOIN t USING (block) JOIN p USING (merged)"""  # five folds always reach the least size here


@query("f03_f04_spatial_folds", FOLDS)
def _(t):
    return D.spatial_folds(t.units, 5)


@query("f05_event_fold_metadata", W("units", "claims", r="SELECT DISTINCT zcta_id, scenario AS event FROM claims") + "SELECT event AS fold, count(*) AS n_rows, count(DISTINCT zcta_id) AS n_zctas FROM r GROUP BY 1")
def _(t):
    rows = t.claims.select("zcta_id", F.col("scenario").alias("event")).distinct()
    return D.fold_metadata(D.event_folds(rows, t.units), "fold_leave_event_out")


CTY = "SELECT county_fips, min(state_fips) AS state, count(*) AS n_zctas, arg_min(segment, (-n, segment)) AS stratum FROM (SELECT *, count(*) OVER (PARTITION BY county_fips, segment) AS n FROM units) GROUP BY 1"


@query("f06_county_summary", W("units") + CTY)
def _(t):
    return D.county_summary(t.units, "segment")


def _least(loads: list[str], also: list[str] | None = None) -> str:
    """Number of the smallest load (then of the smallest second load, then the first)."""
    rows = [f"{{'a': {x}, 'b': {y}, 'f': {f}}}" for f, (x, y) in enumerate(zip(loads, also or loads))]
    return f"list_min([{', '.join(rows)}]).f"


OWN = [f"z.l[x.s * 5 + {f + 1}]" for f in range(5)]
ALL = [f"z.l[{f + 1}]" for f in range(5)]
GREEDY = f"""r AS (SELECT county_fips, stratum, n_zctas, dense_rank() OVER (ORDER BY stratum) AS s, row_number() OVER (ORDER BY {hsh(42, 'county_fips')}, county_fips) AS i FROM h WHERE NOT test),
 z AS (SELECT 0::BIGINT AS i, list_transform(range(60), lambda q: 0::BIGINT) AS l, NULL::VARCHAR AS county_fips, 0 AS f UNION ALL
 SELECT i, list_transform(l, lambda v, q: v + CASE WHEN q = f + 1 OR q = s * 5 + f + 1 THEN n ELSE 0 END) AS l, county_fips, f FROM (SELECT x.i, x.s, x.n_zctas AS n, x.county_fips, z.l, {_least(OWN, ALL)} AS f FROM z JOIN r x ON x.i = z.i + 1))"""


@query("f06_imputation_split", W("units", c=CTY, h=f"SELECT *, {ORD.format(p='PARTITION BY stratum', h=hsh(42, 'county_fips'), k='county_fips')} <= greatest(1, round_even(count(*) OVER (PARTITION BY stratum) * 0.2, 0)) AS test FROM c").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + GREEDY
       + " SELECT zcta_id, coalesce('valid' || CAST(f + 1 AS VARCHAR), 'test') AS split_imputation FROM units LEFT JOIN (SELECT county_fips, f FROM z WHERE i > 0) USING (county_fips)")
def _(t):
    return D.imputation_split(t.units, D.county_summary(t.units, "segment"))


@query("f07_extrapolation_split", W("units", s="SELECT state_fips, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, state_fips) AS i FROM units WHERE state_fips NOT IN ('00', '03') GROUP BY 1").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
       + f""", z AS (SELECT 0::BIGINT AS i, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, NULL::VARCHAR AS state_fips, 0 AS f UNION ALL
 SELECT i, a + CASE WHEN f = 0 THEN n ELSE 0 END, b + CASE WHEN f = 1 THEN n ELSE 0 END, c + CASE WHEN f = 2 THEN n ELSE 0 END, state_fips, f FROM (SELECT s.i, s.n, s.state_fips, z.a, z.b, z.c, {_least(['z.a', 'z.b', 'z.c'])} AS f FROM z JOIN s ON s.i = z.i + 1))
 SELECT zcta_id, coalesce('valid' || CAST(f + 1 AS VARCHAR), 'test') AS split_extrapolation FROM units LEFT JOIN (SELECT state_fips, f FROM z WHERE i > 0) USING (state_fips)""")
def _(t):
    return D.extrapolation_split(t.units, ["00", "03"], 3)


@query("f08_superres_split", W("units", c=CTY, s=f"SELECT county_fips, {ORD.format(p='PARTITION BY stratum', h=hsh(49, 'county_fips'), k='county_fips')} <= greatest(1, round_even(count(*) OVER (PARTITION BY stratum) * 0.2, 0)) AS h FROM c") + "SELECT zcta_id, CASE WHEN h THEN 'test' ELSE 'train' END AS split_superres FROM units JOIN s USING (county_fips)")
def _(t):
    return D.superres_split(t.units, D.county_summary(t.units, "segment"))


@query("f09_split_leaks", W("units", d=f"SELECT county_fips, {hsh(1, 'zcta_id')} % 30 = 0 AS s FROM units") + "SELECT county_fips, count(DISTINCT s) AS n_folds FROM d GROUP BY 1 HAVING count(DISTINCT s) > 1")
def _(t):
    from plumbline.functions.core import seeded_hash

    return D.split_leaks(t.units.withColumn("s", seeded_hash(1, "zcta_id") % 30 == 0), "county_fips", "s")


@query("f09_split_balance", W("units", d="SELECT k % 4 AS s, segment FROM units", c="SELECT s, segment, count(*) / sum(count(*)) OVER (PARTITION BY s) AS share FROM d GROUP BY 1, 2") + "SELECT segment, round(min(share), 8) AS min_share, round(max(share), 8) AS max_share, round(max(share) / min(share), 8) AS ratio FROM c GROUP BY 1")
def _(t):
    return rnd(D.split_balance(t.units.withColumn("s", F.col("k") % 4), "s", "segment"), 8, "min_share", "max_share", "ratio")


@query("f10_get_split", W("units") + "SELECT CASE WHEN k % 6 = 0 THEN 'test' WHEN k % 6 = 2 THEN 'val' ELSE 'train' END AS part, count(*) AS n FROM units WHERE acct >= 0 GROUP BY 1")
def _(t):
    k = F.col("k") % 6
    d = t.units.select(F.when(k == 0, "test").otherwise(F.concat(F.lit("valid"), k.cast("string"))).alias("split_imputation"), F.when(F.col("acct") >= 0, F.col("acct")).alias("y"))
    parts = D.get_split(d, "imputation", 2, "y")
    out = [p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n") for n, p in parts.items()]
    return out[0].union(out[1]).union(out[2])


@query("f11_leakage_audit", W("oof", d="SELECT model_version, zcta, fold, y_true, y_pred FROM oof") + "SELECT model_version, count(*) AS n_rows, count(DISTINCT zcta) AS n_units, count(DISTINCT (zcta, fold)) AS expected_rows, count(DISTINCT fold) AS n_targets, 0.0::DOUBLE AS null_share, count(*) = count(DISTINCT (zcta, fold)) AS pass FROM d GROUP BY 1")
def _(t):
    return D.leakage_audit(t.oof, "model_version", "zcta", "fold")


@query("f11_ids_in_both", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')")
def _(t):
    o = t.raw("orders")
    return D.ids_in_both(o.filter("o_orderpriority = '1-URGENT'"), o.filter("o_orderpriority = '5-LOW'"), "o_custkey")


@query("f12_leave_scenario_out", W("units") + f"SELECT zcta_id, segment, 'test' AS split FROM units WHERE segment = 'BUILDING' UNION ALL SELECT zcta_id, segment, CASE WHEN {ORD.format(p='', h=hsh(42, 'zcta_id'), k='zcta_id')} <= greatest(1, floor(count(*) OVER () * 0.2)) THEN 'validation' ELSE 'train' END FROM units WHERE segment <> 'BUILDING'")
def _(t):
    return D.leave_scenario_out(t.units.select("zcta_id", "segment"), "segment", "zcta_id", ["BUILDING"])


@query("f13_stratified_sample", W("units") + f"SELECT zcta_id, segment AS stratum FROM units QUALIFY {ORD.format(p='PARTITION BY segment', h=hsh(42, 'zcta_id'), k='zcta_id')} <= 7")
def _(t):
    return D.stratified_sample(t.units.select("zcta_id", "segment"), F.col("segment"), "zcta_id", 7).select("zcta_id", "stratum")


@query("f14_fold_eligibility", W("oof", d="SELECT task, fold, (y_true > 49 AND fold < 2)::INT AS y FROM oof", f="SELECT task, fold, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM d GROUP BY 1, 2", g="SELECT *, sum(p) OVER (PARTITION BY task) - p AS tp, sum(n) OVER (PARTITION BY task) - n AS tn FROM f")
       + "SELECT task, fold, p AS test_positive, n AS test_negative, tp::BIGINT AS train_positive, tn::BIGINT AS train_negative, CASE WHEN tp = 0 OR tn = 0 THEN 'SKIP_TRAIN_SINGLE_CLASS' WHEN p = 0 OR n = 0 THEN 'SKIP_TEST_SINGLE_CLASS' ELSE 'ELIGIBLE' END AS eligibility FROM g")
def _(t):
    return D.fold_eligibility(t.oof.withColumn("y", ((F.col("y_true") > 49) & (F.col("fold") < 2)).cast("int")), ["task"], "fold", "y")


@query("f14_usable_targets", W("units") + "SELECT 'acct' AS target, count(acct) AS n, count(acct) >= 20 AS usable FROM units UNION ALL SELECT 'flat', count(*), false FROM units")
def _(t):
    return D.usable_targets(t.units.select("acct", F.lit(1.0).alias("flat")), ["acct", "flat"])
