"""Embedding, model and text-evidence queries."""

from pyspark.sql import functions as F

from plumbline.operators import embeddings as E
from plumbline.operators import evidence as V
from plumbline.operators.balls import cosine_top_k
from plumbline.plans.assembly import rnd
from plumbline.plans.registry import query
from plumbline.plans.standins import W


def _emb(t):
    return t.raw("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")


def _pairs(t):
    e = _emb(t)
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("v"), F.col("label").alias("other")), "vec_id")


@query("e01_pca_projection")
def _(t):
    e = _emb(t)
    return E.project(e, "e", E.fit_projection(e, "e", 4), "projected").select("vec_id", F.posexplode("projected").alias("dim", "x"))


PAIR = "SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS u, CAST(b.embedding AS DOUBLE[]) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


@query("e02_pair_features", f"WITH p AS ({PAIR}), s AS (SELECT vec_id, list_dot_product(u, v) AS uv, list_dot_product(u, u) AS uu, list_dot_product(v, v) AS vv FROM p) SELECT vec_id, 263 AS n_features, round(uv / (sqrt(uu) * sqrt(vv) + 1e-8), 6) AS cosine, round(sqrt(uu + vv - 2 * uv), 6) AS diff_norm, round((uu - 2 * uv + vv) / (sqrt(uu + vv - 2 * uv) + 1e-8), 6) AS asymmetry FROM s")
def _(t):
    f = E.pair_features("e", "v")
    d = _pairs(t).select("vec_id", f.alias("f"))
    return d.select("vec_id", F.size("f").alias("n_features"), *[F.round(F.element_at("f", i), 6).alias(n) for i, n in ((257, "cosine"), (260, "diff_norm"), (263, "asymmetry"))])


@query("e03_relevance_gate")
def _(t):
    p = _pairs(t).withColumn("f", E.pair_features("e", "v")).withColumn("y", F.when(F.col("label") == F.col("other"), 0.0).when(F.abs(F.col("label") - F.col("other")) < 4, 1.0).otherwise(2.0))
    return E.relevance_gate(p, E.train_relevance(p, "f", "y", 5, 3), "f").select("vec_id", "p_superfluous", "action", "confidence")


CEN = "SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2"


@query("e04_cosine_top_k", f"WITH c AS ({CEN}), q AS (SELECT label - 1000 AS q, list(x ORDER BY i) AS v FROM c GROUP BY 1), s AS (SELECT q, vec_id AS p, list_dot_product(v, CAST(embedding AS DOUBLE[])) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) + 1e-8) AS c FROM q CROSS JOIN embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, p) AS k FROM s) SELECT q AS label, p AS match_vec_id, round(c, 6) AS cosine, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 5")
def _(t):
    e = _emb(t)
    q = e.select("label", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy((F.col("label") - 1000).alias("label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("e"))
    return rnd(cosine_top_k(q, e, "label", "vec_id", "e", 5), 6, "cosine").select("label", "match_vec_id", "cosine", "rank")


@query("e04_cosine_neighbours", "WITH v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id AS q, b.vec_id AS p, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-8) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, p) AS k FROM s) SELECT q AS vec_id, p AS match_vec_id, round(c, 6) AS cosine, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 5")
def _(t):
    e = _emb(t)
    return rnd(cosine_top_k(e, e, "vec_id", "vec_id", "e", 5), 6, "cosine")


SENT = r"""WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.;])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents), q AS (SELECT doc_id, unnest(CASE WHEN length(s) > 150 THEN string_split(regexp_replace(s, ',\s+(which|where|while|and|suggesting|indicating)', chr(1), 'g'), chr(1)) ELSE [s] END) AS s FROM p), c AS (SELECT doc_id, regexp_replace(s, '^\s+|\s+$', '', 'g') AS text FROM q)"""


@query("e05_extract_claims", SENT + r""" SELECT doc_id, count(*) AS n_claims, count(*) FILTER (t = 'numeric') AS n_numeric, count(*) FILTER (t = 'generic') AS n_generic, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (SELECT doc_id, text, CASE WHEN regexp_matches(lower(text), '\d+\.?\d*\s*%') OR regexp_matches(lower(text), '\$[\d,]+') OR regexp_matches(lower(text), '(?:population|income|claims|score)\s*(?:of|is|:)?\s*[\d,]+') THEN 'numeric'
    WHEN regexp_matches(lower(text), 'zone a|zone x|zone ae|zone ve|sfha|floodplain|flood zone|minimal hazard|high hazard|coastal') THEN 'categorical' WHEN regexp_matches(lower(text), 'neighbor|adjacent|surrounding|nearby|proximity|border|contiguous|next to') THEN 'spatial' ELSE 'generic' END AS t FROM c WHERE text <> '') GROUP BY 1""")
def _(t):
    c = V.extract_claims(t.raw("documents"), "doc_id", ["text"])
    k = F.col("claim_type")
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(k == "numeric").alias("n_numeric"), F.count_if(k == "generic").alias("n_generic"), F.sum(F.length("text")).alias("n_chars"))


def _response(t):
    """Three sentences per unit; the population is wrong for every third unit and the zone share for every fourth."""
    u = t.units
    said = F.when(F.col("k") % 3 == 0, F.col("pop") * 2 + 50).otherwise(F.col("pop"))
    zone = (F.col("k") % 40 + 0.5).cast("double")
    share = F.when(F.col("k") % 4 == 0, zone + 60).otherwise(zone)
    txt = F.concat(F.lit("Population: "), said.cast("long").cast("string"), F.lit(" people live here. "), share.cast("string"), F.lit("% lies in the special flood hazard area; the 1% annual chance limit applies. Zone X borders the unit. Neighbors are similar."))
    r = u.select("zcta_id", txt.alias("body"), F.array(F.concat(F.lit("population "), said.cast("long").cast("string")), F.lit("blue shading")).alias("cites"))
    s = u.select("zcta_id", F.col("pop").alias("population"), zone.alias("flood_pct_zone_a"), F.lit(30.0).alias("flood_pct_zone_x"), F.concat(F.lit("Residents: "), F.col("pop").cast("long").cast("string")).alias("evidence"))
    return r, s


TRUTH = """x AS (SELECT zcta_id, k % 3 = 0 AND abs(pop + 50) / greatest(pop, 1e-6) > 0.15 AS badpop, k % 4 = 0 AND 60 / (k % 40 + 0.5) > 0.15 AS badzone, contains('residents: ' || CAST(pop::BIGINT AS VARCHAR), CAST((CASE WHEN k % 3 = 0 THEN pop * 2 + 50 ELSE pop END)::BIGINT AS VARCHAR)) AS cited FROM units)"""


@query("e06_verify_claims", W("units").rstrip() + f""", {TRUTH} SELECT zcta_id, 0 AS claim_no, 'numeric' AS claim_type, CASE WHEN badpop THEN 'N_claim' ELSE 'verified' END AS tier1_label FROM x UNION ALL SELECT zcta_id, 1, 'numeric', CASE WHEN badzone THEN 'N_claim' ELSE 'verified' END FROM x UNION ALL SELECT zcta_id, 2, 'numeric', 'unverifiable' FROM x
    UNION ALL SELECT zcta_id, 3, 'categorical', 'verified' FROM x UNION ALL SELECT zcta_id, 4, 'spatial', 'unverifiable' FROM x UNION ALL SELECT zcta_id, 5, 'citation', CASE WHEN cited THEN 'verified' ELSE 'N_claim' END FROM x UNION ALL SELECT zcta_id, 6, 'citation', 'unverifiable' FROM x""")
def _(t):
    r, s = _response(t)
    return V.verify_claims(V.extract_claims(r, "zcta_id", ["body"], citation_fields=["cites"]), s, "zcta_id", "evidence").select("zcta_id", "claim_no", "claim_type", "tier1_label")


@query("e07_response_metrics", W("units").rstrip() + f""", {TRUTH}, m AS (SELECT zcta_id, badpop::INT + badzone::INT + (NOT cited)::INT AS bad, cited FROM x) SELECT zcta_id, 7::BIGINT AS n_claims, bad::BIGINT AS n_fabricated, round(bad / 7.0, 8) AS hallucination_rate, round((4 - bad) / 4.0, 8) AS source_verification_rate, round(CASE WHEN cited THEN 0 ELSE 0.5 END, 8)::DOUBLE AS unsupported_evidence_rate FROM m""")
def _(t):
    r, s = _response(t)
    g = V.verify_claims(V.extract_claims(r, "zcta_id", ["body"], citation_fields=["cites"]), s, "zcta_id", "evidence")
    return rnd(V.response_metrics(g, "zcta_id").select("zcta_id", "n_claims", "n_fabricated", "hallucination_rate", "source_verification_rate", "unsupported_evidence_rate"), 8, "hallucination_rate", "source_verification_rate", "unsupported_evidence_rate")


def _failures(t):
    k = F.col("doc_id")
    return t.raw("documents").select("doc_id", (k % 11 > 0).alias("followed_schema"), (k % 7 > 0).alias("no_unprovided_claims"), (k % 5 > 0).alias("used_structured_evidence"), F.when(k % 2 == 0, "ae").otherwise("X").alias("predicted_zone"), F.when(k % 3 == 0, "A").when(k % 3 == 1, "x500").alias("reference_zone"))


FAIL = """CASE WHEN doc_id % 11 = 0 THEN 'schema_violation' WHEN doc_id % 7 = 0 THEN 'unprovided_external_claim' WHEN doc_id % 5 = 0 THEN 'missing_evidence_citation' WHEN doc_id % 3 = 0 AND doc_id % 2 = 1 THEN 'false_negative_high_reference' WHEN doc_id % 3 > 0 AND doc_id % 2 = 0 THEN 'false_positive_low_reference' END"""


@query("e08_failure_attribution", f"SELECT doc_id, {FAIL} AS failure_type FROM documents")
def _(t):
    return V.attribute_failures(_failures(t)).select("doc_id", "failure_type")


@query("e08_failure_report", f"WITH f AS (SELECT doc_id, {FAIL} AS failure_type FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), r AS (SELECT *, row_number() OVER (PARTITION BY failure_type ORDER BY doc_id) AS k FROM f WHERE failure_type IS NOT NULL) SELECT failure_type, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (k <= 5) AS examples FROM r GROUP BY 1")
def _(t):
    return V.failure_report(_failures(t), "doc_id", t.raw("labels")).withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


FEATS = ["l_extendedprice", "l_discount", "l_tax"]


def _lines(t):
    return t.raw("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_orderkey") % 3).cast("int").alias("fold"), "l_quantity", "l_returnflag", *FEATS)


@query("e09_oof_ridge")
def _(t):
    return E.oof_predictions(_lines(t), "id", "fold", [0, 1, 2], FEATS, "l_quantity")


@query("e09_oof_gbt")
def _(t):
    return E.oof_predictions(_lines(t), "id", "fold", [0, 1, 2], FEATS, "l_quantity", "gbt", depth=3, iters=3)


@query("e09_oof_logistic")
def _(t):
    return E.oof_predictions(_lines(t).withColumn("y", (F.col("l_quantity") > 25).cast("double")), "id", "fold", [0, 1, 2], FEATS, "y", "logistic", "classification")


@query("e10_importance_stability")
def _(t):
    return E.importance_stability(E.importance_by_group(_lines(t), "l_returnflag", ["A", "N", "R"], FEATS, "l_quantity", 3, 3), "l_returnflag")


@query("e11_transfer_matrix")
def _(t):
    return E.transfer_matrix(_lines(t), "l_returnflag", ["A", "N", "R"], FEATS, "l_quantity")


@query("e12_batch_scoring")
def _(t):
    d = _lines(t)
    model = E._pipeline("gbt", "regression", FEATS, 3, 3).fit(d.withColumn("label", F.col("l_quantity")))
    return E.score_batch(d, model).select("id", "score")


@query("e13_cluster_summary")
def _(t):
    return E.cluster_regions(t.units.select("zcta_id", "lat", "lon", "acct"), ["lat", "lon", "acct"], 6)[1]
