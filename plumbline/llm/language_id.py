"""Language identification by Bayesian evidence fusion.

posterior(language) ~ prior(language | host) x P(suffix | language) x P(declared | language) x P(text | language)

* text: hashed byte trigrams, tempered to a bounded number of effective observations so that long texts do not drown the rest;
* declared: the language the markup (or a column) states, through a table of how often each statement goes with each text language;
* suffix: the last label of the address;
* host: shares of languages per host, smoothed towards its domain, and the domain's towards all rows.

The tables behind the last three are grouped aggregations over all rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import map_batches, table
from plumbline.llm.url_filter import url_parts
from plumbline.session import cut_lineage

#: about so many labelled rows of each language fit the text model
TRAIN_ROWS = 8_000
#: values of the hash by which rows are drawn
HASHES = 1 << 44
SLOTS = 1 << 14
#: trigrams a text counts for at most
EFFECTIVE = 40.0
#: pseudo-counts of the parent level in a host's or domain's shares, and of each cell in the other tables
HOST_WEIGHT, CELL_WEIGHT = 10.0, 1.0
#: languages with a column of their own, those with the most rows; all others share the column ``OTHER``
LANGUAGES = 256
LEAST_POSTERIOR = 0.5
UNKNOWN = "und"
OTHER = "other"
_LETTER = re.compile(r"[^\W\d_]")
#: bytes as letters: a-z, bytes beyond ASCII, else a blank
_LETTERS = np.full(256, 32, np.uint32)
_LETTERS[97:123] = _LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class TextModel:
    """Log-probabilities of trigram slots, one column per language and a flat one for ``und``."""

    languages: tuple[str, ...]
    table: np.ndarray


def trigram_slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, counts, bytes of each text): the slot of the byte trigram at each place, and whether it counts. A-Z are lower-cased, all that is not a letter (or beyond
    ASCII) is a blank; trigrams with two blanks, or across texts, do not count."""
    raw = [b" " + t.encode("utf-8", "replace") + b"  " for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    b = _LETTERS[np.frombuffer(b"".join(raw), np.uint8)]
    slots = (b[:-2] * np.uint32(40503) + b[1:-1] * np.uint32(10007) + b[2:] * np.uint32(31)) % np.uint32(65521) % np.uint32(SLOTS)
    solid = (b != 32).astype(np.int8)
    counts = solid[:-2] + solid[1:-1] + solid[2:] >= 2
    return np.append(slots, np.zeros(2, np.uint32)), np.append(counts, [False, False]), size


def sample_rows(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows by a hash of their key; all of them when there are no more."""
    n = rows.count()
    return rows if n <= bound else rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int((1 << 20) * bound / n))


def training_rows(rows: DataFrame, bound: int, most: int) -> DataFrame:
    """(column, text): about ``bound`` rows of each label by a hash of the row, all of them when it has no more.

    The ``most`` labels with the most rows are columns of their own; the rows of the others are drawn as those of one column, ``OTHER``. Labels are counted over
    all rows; what reaches the driver is one row per column."""
    sizes = cut_lineage(rows.groupBy("label").agg(F.count("*").alias("n")))
    own = sizes.orderBy(F.desc("n"), "label").limit(most).collect()
    rest = (sizes.agg(F.sum("n")).first()[0] or 0) - sum(r["n"] for r in own)
    limit = lambda n: min(HASHES, int(HASHES * bound / max(n, 1)))
    limits = rows.sparkSession.createDataFrame([(r["label"], r["label"], limit(r["n"])) for r in own], "label string, column string, below long")
    joined = rows.join(F.broadcast(limits), "label", "left")
    drawn = joined.filter(F.pmod(F.xxhash64("id", "text"), F.lit(HASHES)) < F.coalesce("below", F.lit(limit(rest))))
    return drawn.select(F.coalesce("column", F.lit(OTHER)).alias("column"), "text")


def fit_text_model(labelled: DataFrame, bound: int = TRAIN_ROWS, most: int = LANGUAGES) -> TextModel:
    """Fit on about ``bound`` rows of each label of (id, text, label). Counts are summed in Spark; what reaches the driver is bounded by slots x languages."""
    rows = labelled.filter("text is not null and label is not null and label <> ''")
    rows = training_rows(rows, bound, most)

    def count(batches):
        for pdf in batches:
            for label, part in pdf.groupby("column"):
                slots, counts, _ = trigram_slots(part["text"].tolist())
                n = np.bincount(slots[counts], minlength=SLOTS)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"label": label, "slot": at, "n": n[at]})

    counts = map_batches(rows, count, "label string, slot int, n long").groupBy("label", "slot").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts.groupBy("label").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("ns")))
    labels = sorted(r["label"] for r in counts.select("label").collect())
    grid = np.zeros((SLOTS, len(labels)))
    for r in counts.toLocalIterator():
        grid[r["slots"], labels.index(r["label"])] = r["ns"]
    share = (grid + 0.1) / (grid + 0.1).sum(axis=0)
    return TextModel((*labels, UNKNOWN), np.log(np.column_stack([share, np.full(SLOTS, 1 / SLOTS)])).astype(np.float32))


def text_evidence(model: TextModel, texts: list[str]) -> np.ndarray:
    """Log-likelihood per language of each text: the mean over its trigrams times a bounded count. 0 without text."""
    out = np.zeros((len(texts), len(model.languages)))
    if not texts:
        return out
    slots, counts, size = trigram_slots(texts)
    starts = np.cumsum(size) - size
    grams = np.add.reduceat(counts.astype(np.float64), starts)
    for k in range(out.shape[1]):
        out[:, k] = np.add.reduceat(np.where(counts, model.table[:, k][slots], 0).astype(np.float64), starts) / np.maximum(grams, 1)
    out *= np.minimum(grams, EFFECTIVE)[:, None]
    return out


def _soft(scores: Column) -> Column:
    """Normalised shares of an array of logs."""
    top = F.array_max(scores)
    shares = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shares, lambda x: x / total)


def _sums(d: DataFrame, key: str, n: int) -> DataFrame:
    return d.groupBy(key).agg(F.array(*[F.sum(F.col("q")[k]) for k in range(n)]).alias("c"))


def fuse(rows: DataFrame, model: TextModel, least: float = LEAST_POSTERIOR) -> DataFrame:
    """``rows``: (id struct or value, text, declared, host); returns (id, lang, posterior, accepted, letters).

    Null or empty declared, host and text are no evidence, not evidence against. Text without a letter is never accepted; else a row is accepted when
    its best language is one of the model's (not ``und``) with a posterior of at least ``least``. A row whose best is ``other`` has the language it states, when that
    is one of those without a column, else ``other``. Ties go to the first language in order. Repeated rows get equal
    results; an empty table gives no rows. Hosts join as one aggregated row each, so a hot host is cut by the adaptive join."""
    langs = model.languages
    n = len(langs)

    def score(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                part = pdf.iloc[i : i + 500]
                texts = part["text"].fillna("").tolist()
                logs = text_evidence(model, texts)
                yield part.drop(columns="text").assign(ll=list(logs), letters=[_LETTER.search(t) is not None for t in texts])

    known = F.when(F.lower("declared").isin(*langs), F.lower("declared")).when(F.coalesce(F.col("declared"), F.lit("")) != "", OTHER).otherwise("")
    stated = F.when(known == OTHER, F.lower("declared")).otherwise("") if OTHER in langs else F.lit("")
    host = F.coalesce(F.col("host"), F.lit(""))
    labels = F.split(host, r"\.")
    rows = rows.select("id", "text", known.alias("declared"), stated.alias("stated"), host.alias("host"), F.when(F.size(labels) > 2, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).otherwise(host).alias("domain"), F.when(F.size(labels) > 1, F.element_at(labels, -1)).otherwise("").alias("suffix"))
    kind = rows.schema["id"].dataType.simpleString()
    scored = map_batches(rows, score, f"id {kind}, declared string, stated string, host string, domain string, suffix string, ll array<double>, letters boolean")
    scored = cut_lineage(scored.withColumn("q", _soft(F.col("ll"))))

    total = scored.agg(*[F.sum(F.col("q")[k]) for k in range(n)]).first()
    whole = np.array([x or 0.0 for x in total]) + CELL_WEIGHT
    whole = F.array(*[F.lit(float(x)) for x in whole / whole.sum()])
    plus = lambda c, p, w: F.transform(F.arrays_zip(c.alias("a"), p.alias("b")), lambda z: z["a"] + w * z["b"])
    normal = lambda c: F.transform(c, lambda x: x / F.aggregate(c, F.lit(0.0), lambda a, y: a + y))

    domains = _sums(scored.filter("domain <> ''"), "domain", n).select("domain", normal(plus(F.col("c"), whole, HOST_WEIGHT)).alias("dp"))
    hosts = scored.filter("host <> ''").groupBy("host", "domain").agg(F.array(*[F.sum(F.col("q")[k]) for k in range(n)]).alias("c")).join(domains, "domain")
    hosts = hosts.select("host", normal(plus(F.col("c"), F.col("dp"), HOST_WEIGHT)).alias("hp"))
    likely = lambda key: _likelihood(_sums(scored.filter(F.col(key) != ""), key, n), key, n)
    joined = scored.join(hosts, "host", "left").join(likely("suffix"), "suffix", "left").join(likely("declared"), "declared", "left")
    flat = F.array(*[F.lit(0.0)] * n)
    parts = F.arrays_zip(F.coalesce("hp", whole).alias("h"), F.coalesce("suffix_ll", flat).alias("s"), F.coalesce("declared_ll", flat).alias("d"), F.col("ll").alias("t"))
    posterior = _soft(F.transform(parts, lambda z: F.log(z["h"]) + z["s"] + z["d"] + z["t"]))
    done = joined.select("id", "letters", "stated", posterior.alias("p"))
    best = F.array_position("p", F.array_max("p"))
    lang = F.element_at(F.array(*[F.lit(x) for x in langs]), best.cast("int"))
    lang = F.when((lang == OTHER) & (F.col("stated") != ""), F.col("stated")).otherwise(lang)
    done = done.select("id", lang.alias("lang"), F.array_max("p").alias("posterior"), "letters")
    return done.withColumn("accepted", (F.col("lang") != UNKNOWN) & (F.col("posterior") >= least) & F.col("letters"))


def _likelihood(sums: DataFrame, key: str, n: int) -> DataFrame:
    """log P(key | language) from the soft counts of each key; the keys of a table are few or are joined as rows."""
    totals = sums.agg(F.count("*").alias("keys"), *[F.sum(F.col("c")[k]).alias(f"t{k}") for k in range(n)])
    row = totals.first()
    keys = row["keys"] or 1
    logs = [F.log((F.col("c")[k] + CELL_WEIGHT) / F.lit(float((row[f"t{k}"] or 0.0) + CELL_WEIGHT * keys))) for k in range(n)]
    return sums.select(key, F.array(*logs).alias(f"{key}_ll"))


def markup_language(html: Column) -> Column:
    """Primary subtag of the ``lang`` attribute of the html element; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1))


def visible_text(html: Column) -> Column:
    """Text between tags, without scripts, styles, comments and character references."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as evidence rows: the stated language is ``lang``, the host is ``source``."""
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is known, all columns kept. Only the rejected ids are joined back."""
    rows = document_rows(docs)
    model = fit_text_model(rows.select("id", "text", F.col("declared").alias("label")))
    # equal id, text and evidence give equal decisions; rows that share an id are told apart by their evidence
    key = F.struct(F.col("id"), F.xxhash64("text", "declared", "host").alias("h"))
    gone = fuse(rows.withColumn("id", key), model).filter(~F.col("accepted")).select(F.col("id.id").alias("gone_id"), F.col("id.h").alias("gone_h")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"], docs["lang"], docs["source"]) == gone["gone_h"])
    return docs.join(gone, same, "left_anti")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages: (doc_id or page_id, lang, posterior, accepted, letters)."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    rows = document_rows(docs)
    model = fit_text_model(rows.select("id", "text", F.col("declared").alias("label")))
    null = F.lit(None).cast("long")
    key = lambda d, p: F.struct(d.cast("long").alias("doc_id"), p.cast("long").alias("page_id"))
    web = pages.select(key(null, F.col("page_id")).alias("id"), visible_text(F.col("html")).alias("text"), markup_language(F.col("html")).alias("declared"), url_parts(F.col("url"))[0].alias("host"))
    found = fuse(rows.withColumn("id", key(F.col("id"), null)).unionByName(web), model)
    return found.select("id.doc_id", "id.page_id", "lang", F.round("posterior", 6).alias("posterior"), "accepted", "letters")


QUERIES = {"op1_language_id": op1_language_id}
ORACLES: dict[str, str] = {}
