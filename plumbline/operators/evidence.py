"""Claims in response text: extraction, typing, checking against source features, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.core import col
from plumbline.session import spread

# Phrases and tolerances of the checks.
TOLERANCE, LONG_SENTENCE = 0.15, 150
CLAUSE_WORDS = ("which", "where", "while", "and", "suggesting", "indicating")
ZONE_TERMS = ("zone a", "zone x", "zone ae", "zone ve", "sfha", "floodplain", "flood zone", "minimal hazard", "high hazard", "coastal")
SPATIAL_TERMS = ("neighbor", "adjacent", "surrounding", "nearby", "proximity", "border", "contiguous", "next to")
CITED_TERMS = ("zone a", "zone x", "zone x500", "population", "income", "svi", "nfip", "311", "flood", "claims")
VISUAL_TERMS = ("map", "image", "color", "blue", "yellow", "red", "gray", "legend", "choropleth", "shading")
ALIASES = {
    "flood_pct_zone_a": ("zone a", "zone ae", "1% annual", "100-year", "sfha", "special flood hazard"),
    "flood_pct_zone_x": ("zone x", "minimal flood", "minimal hazard"),
    "flood_pct_zone_x500": ("zone x500", "x-500", "0.2% annual", "500-year", "moderate flood"),
    "population": ("population", "residents", "people"),
    "acs_median_hh_income": ("median income", "household income", "median household"),
    "svi_overall": ("svi", "social vulnerability", "vulnerability index"),
    "obs_nfip_event_claims": ("nfip claims", "nfip", "insurance claims", "flood claims"),
    "obs_has_311": ("311", "flood reports", "service request"),
}
COVERED = ("flood_pct_zone_a", "flood_pct_zone_x", "flood_pct_zone_x500", "population", "acs_median_hh_income", "svi_overall", "obs_nfip_event_claims")
FLOOD_ZONES, DRY_ZONES = ("A", "AE", "AH", "AO", "V", "VE"), ("X", "X500", "NONE", "")


def _any(text: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def sentences(text) -> Column:
    """Split after '.' or ';'; long sentences are split again at commas before clause words."""
    parts = F.split(F.coalesce(col(text), F.lit("")), r"(?<=[.;])\s+")
    clause = r",\s+(?:" + "|".join(CLAUSE_WORDS) + ")"
    out = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > LONG_SENTENCE, F.split(p, clause)).otherwise(F.array(p))))
    return F.filter(F.transform(out, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def claim_type(text) -> Column:
    """First of numeric, categorical, spatial, else generic."""
    t = F.lower(col(text))
    numeric = t.rlike(r"\d+\.?\d*\s*%") | t.rlike(r"\$[\d,]+") | t.rlike(r"(?:population|income|claims|score)\s*(?:of|is|:)?\s*[\d,]+")
    return F.when(numeric, "numeric").when(_any(t, ZONE_TERMS), "categorical").when(_any(t, SPATIAL_TERMS), "spatial").otherwise("generic")


def extract_claims(responses: DataFrame, key: str, text_fields: list[str], list_fields: list[str] = (), citation_fields: list[str] = ()) -> DataFrame:
    """One row per claim with its field, place and type; citations are typed by their field."""
    item = lambda arr, f: F.transform(arr, lambda s: F.struct(s.alias("text"), F.lit(f).alias("field")))
    trimmed = lambda f: F.filter(F.transform(F.coalesce(F.col(f), F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != ""))
    arrays = [item(sentences(f), f) for f in text_fields] + [item(trimmed(f), f) for f in [*list_fields, *citation_fields]]
    d = spread(responses.select(key, *text_fields, *list_fields, *citation_fields))
    d = d.select(key, F.posexplode(F.concat(*arrays)).alias("claim_no", "c")).select(key, "claim_no", "c.text", "c.field")
    return d.withColumn("claim_type", F.when(F.col("field").isin(*citation_fields), "citation").otherwise(claim_type("text")) if citation_fields else claim_type("text"))


def numbers_in(text) -> Column:
    """Percentages (without the boilerplate 1 % and 0.2 %, told by "annual" or "chance" within the next 15 characters), dollars and counts in context."""
    t = F.lower(col(text))
    plain = F.regexp_replace(t, r"(?<![\d.])(?:1(?:\.0+)?|0\.20*)\s*%(?=.{0,9}(?:annual|chance))", " ")
    num = lambda pattern, src: F.transform(F.regexp_extract_all(src, F.lit(pattern), 1), lambda s: F.regexp_replace(s, ",", "").try_cast("double"))
    every = F.concat(num(r"(\d+\.?\d*)\s*%", plain), num(r"\$\s*([\d,]+\.?\d*)", t), num(r"(?:population|claims|score)[:\s]+(?:of\s+)?([\d,]+)", t))
    return F.filter(every, lambda x: x.isNotNull())


def _numeric_verdict(t: Column, nums: Column, features: list[str]) -> Column:
    """Numbers against every feature the text names, within the tolerance."""
    named = F.array_compact(F.array(*[F.when(_any(t, ALIASES[f]), F.col(f).cast("double")) for f in features]))
    close = lambda v, s: F.when(s == 0, v == 0).otherwise(F.abs(v - s) / F.greatest(F.abs(s), F.lit(1e-6)) <= TOLERANCE)
    matched = F.size(F.filter(nums, lambda v: F.exists(named, lambda s: close(v, s))))
    return F.when(F.size(nums) == 0, None).when(matched < F.size(nums), "N_claim").otherwise("verified")


def _category_verdict(t: Column, cols: set[str]) -> Column:
    val = lambda c: F.col(c).cast("double") if c in cols else F.lit(None).cast("double")
    known = lambda c: F.coalesce(val(c), F.lit(0.0))  # a source without the column counts as 0
    zone_a, svi = val("flood_pct_zone_a"), known("svi_overall")
    invented = _any(t, ("zone ve", "coastal high hazard")) & (known("flood_pct_zone_a") == 0) & (known("flood_pct_zone_x500") == 0)
    wrong = (t.contains("low") & t.contains("vulnerability") & (svi >= 0.5)) | (_any(t, ("very high", "extremely")) & t.contains("vulnerability") & (svi < 0.5))
    named = (_any(t, ("zone a", "zone ae", "1%")) & zone_a.isNotNull()) | (t.contains("zone x") & ~_any(t, ("x500", "x-500")) & val("flood_pct_zone_x").isNotNull())
    return F.when(F.coalesce(invented | wrong, F.lit(False)), "N_claim").when(F.coalesce(named, F.lit(False)), "verified")


def _citation_verdict(t: Column, evidence: Column) -> Column:
    e = F.lower(F.coalesce(evidence, F.lit("")))
    digits = F.regexp_extract_all(t, F.lit(r"([\d,]+\.?\d*)"), 1)
    term = F.lit(False)
    for w in CITED_TERMS:
        term = term | (t.contains(w) & e.contains(w))
    return F.when(F.exists(digits, lambda d: F.contains(e, d)) | term, "verified").when(_any(t, VISUAL_TERMS), "unverifiable").otherwise("N_claim")


def verify_claims(claims: DataFrame, source: DataFrame, key: str, evidence: str | None = None) -> DataFrame:
    """Label every claim verified, N_claim (contradicted or invented) or unverifiable."""
    d = claims.join(source, key, "left")
    feats = [f for f in ALIASES if f in source.columns]
    t = F.lower(F.col("text"))
    d = d.withColumn("_n", numbers_in("text"))
    label = (F.when(F.col("claim_type") == "numeric", _numeric_verdict(t, F.col("_n"), feats)).when(F.col("claim_type") == "categorical", _category_verdict(t, set(source.columns)))
             .when(F.col("claim_type") == "citation", _citation_verdict(t, F.col(evidence) if evidence else F.lit(""))))
    return d.withColumn("tier1_label", F.coalesce(label, F.lit("unverifiable"))).select(*claims.columns, "tier1_label")


def response_metrics(graded: DataFrame, key: str) -> DataFrame:
    """Hallucination, verification, coverage and unsupported-citation rates per response."""
    n, lab, t = F.count(F.lit(1)), F.col("tier1_label"), F.lower(F.col("text"))
    ver, bad = F.count_if(lab == "verified"), F.count_if(lab == "N_claim")
    cite = F.col("claim_type") == "citation"
    seen = sum((F.max(_any(t, ALIASES[f]).cast("int")) for f in COVERED), F.lit(0)) / len(COVERED)
    return graded.groupBy(key).agg(n.alias("n_claims"), ver.alias("n_verified"), bad.alias("n_fabricated"), F.count_if(lab == "unverifiable").alias("n_unverifiable"), (bad / n).alias("hallucination_rate"), ((ver + bad) / n).alias("verifiable_rate"),
                                   F.try_divide(ver, ver + bad).alias("source_verification_rate"), seen.alias("evidence_coverage"), F.try_divide(F.count_if(cite & (lab == "N_claim")), F.count_if(cite)).alias("unsupported_evidence_rate"))


def attribute_failures(df: DataFrame, predicted: str = "predicted_zone", reference: str = "reference_zone") -> DataFrame:
    """First matching failure class per prediction; null when it is fine."""
    p, r = F.upper(F.coalesce(F.col(predicted), F.lit(""))), F.upper(F.coalesce(F.col(reference), F.lit("")))
    yes = lambda c: F.coalesce(F.col(c), F.lit(True))
    f = (F.when(~yes("followed_schema"), "schema_violation").when(~yes("no_unprovided_claims"), "unprovided_external_claim").when(~yes("used_structured_evidence"), "missing_evidence_citation")
         .when(r.isin(*FLOOD_ZONES) & p.isin(*DRY_ZONES), "false_negative_high_reference").when(r.isin(*DRY_ZONES) & p.isin(*FLOOD_ZONES), "false_positive_low_reference"))
    return df.withColumn("failure_type", f)


def failure_report(df: DataFrame, key: str, held_out: DataFrame, examples: int = 5) -> DataFrame:
    """Counts per failure class with the first few ids; held-out units never enter the report."""
    d = attribute_failures(df.join(held_out.select(key), key, "left_anti")).filter("failure_type IS NOT NULL")
    salt = F.pmod(F.xxhash64(key), F.lit(64))
    part = d.select("failure_type", key, salt.alias("_s")).withColumn("_r", F.row_number().over(W.partitionBy("failure_type", "_s").orderBy(key))).filter(F.col("_r") <= examples)
    ids = part.groupBy("failure_type").agg(F.slice(F.array_sort(F.collect_list(key)), 1, examples).alias("examples"))  # at most 64 x examples ids
    return d.groupBy("failure_type").agg(F.count(F.lit(1)).alias("n")).join(ids, "failure_type")
