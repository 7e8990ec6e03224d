"""Exact duplicates by distributed most-significant-digit radix partitioning.

A document is read as the digit string (length, byte 1, byte 2, ...). Each round splits the groups that still
hold several documents by their next bytes, until a group has one member or its texts have ended. Equality
is decided by the bytes themselves; no digest takes part. The length is the first digit, so all members of a group end
in the same round. The number of bytes per round grows, so that a text of any length takes few rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import lower_ascii, table, text_or_empty, union_all
from plumbline.session import cut_lineage

FIRST_BYTES = 16
GROWTH = 16
WIDEST = 1 << 20


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: (id_col, keep_id, group_size, *carry).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. ``keep_id`` is the largest id of
    the group. ``carry`` names orderable columns that are computed per row and handed through; a column of ``docs``
    that clashes with an output name is not read unless ``carry`` uses it. Rows that repeat an id are counted one by one and
    share their result; a null id loses to any other. An empty table gives no rows.

    Each round is one aggregation, combined before its shuffle, and one join back to the rows of groups that
    split no further yet. Rows of a hot group meet one row of the aggregate, so an adaptive skew join may cut them anywhere.
    Texts leave the scan only for documents whose length and first bytes are shared."""
    carry = carry or {}
    names = list(carry)
    text = lower_ascii(text_or_empty(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), F.octet_length(text_or_empty(text_col)).cast("long").alias("_n"), text.cast("binary").alias("_rest"), *[c.alias(f"_c_{k}") for k, c in carry.items()])
    held = [f"_c_{k}" for k in names]
    out = lambda d, size, keep: d.select(F.col("_id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), *[F.col(f"_c_{k}").alias(k) for k in names])

    def split(d: DataFrame, keys: list[str]) -> DataFrame:
        groups = d.groupBy(*keys).agg(F.count("*").alias("_size"), F.max("_id").alias("_keep"), *[F.max(c).alias(c) for c in held])
        return cut_lineage(groups.withColumn("_group", F.monotonically_increasing_id()))

    def meet(d: DataFrame, groups: DataFrame, keys: list[str], width: int) -> DataFrame:
        shared = groups.filter("_size > 1").select(*keys, "_group", "_size", "_keep")
        rest = F.substring("_rest", F.lit(width + 1), F.lit(2147483647)).alias("_rest")
        return cut_lineage(d.join(shared, keys).select("_id", "_n", "_group", "_size", "_keep", rest, *held))

    def alone(groups: DataFrame) -> DataFrame:
        return out(groups.filter("_size = 1").withColumn("_id", F.col("_keep")), F.col("_size"), F.col("_keep"))

    width, read = FIRST_BYTES, FIRST_BYTES
    first = rows.withColumn("_digit", F.substring("_rest", F.lit(1), F.lit(width)))
    groups = split(first.select("_id", "_n", "_digit", *held), ["_n", "_digit"])
    done = [alone(groups)]
    longest = groups.filter("_size > 1").agg(F.max("_n")).first()[0]
    if longest is None:
        return done[0]
    active = meet(first, groups, ["_n", "_digit"], width)
    while True:
        done.append(out(active.filter(F.col("_n") <= read), F.col("_size"), F.col("_keep")))
        if read >= longest:
            return union_all(done)
        width = min(width * GROWTH, WIDEST)
        parts = active.filter(F.col("_n") > read).withColumnRenamed("_group", "_parent").drop("_size", "_keep").withColumn("_digit", F.substring("_rest", F.lit(1), F.lit(width)))
        groups = split(parts.drop("_rest"), ["_parent", "_digit"])
        done.append(alone(groups))
        active = meet(parts, groups, ["_parent", "_digit"], width)
        read += width


def exact_duplicates_dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept: of equal texts the one with the largest id.

    Only the dropped ids are joined to the documents. Rows that repeat an id count as one document told several times: one of them stays."""
    text = lower_ascii(text_or_empty(text_col))
    found = cut_lineage(exact_groups(docs, id_col, text_col, {"told": F.xxhash64(text)}))  # tells apart the texts of one id, no more
    gone = found.filter(~F.col(id_col).eqNullSafe(F.col("keep_id"))).select(F.col(id_col).alias("g_id"), F.col("told").alias("g_told")).distinct()
    again = cut_lineage(found.filter(F.col(id_col).eqNullSafe(F.col("keep_id"))).groupBy(F.col(id_col).alias("a_id"), F.col("told").alias("a_told")).count().filter("count > 1").drop("count"))

    def meet(d: DataFrame, other: DataFrame, c: str, how: str) -> DataFrame:
        return d.join(other, d[id_col].eqNullSafe(other[f"{c}_id"]) & (F.xxhash64(text) == other[f"{c}_told"]), how)

    kept = meet(docs, gone, "g", "left_anti")
    if again.isEmpty():
        return kept
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = meet(kept, again, "a", "left_semi").groupBy(F.col(id_col).alias("i"), text.alias("t")).agg(F.first(whole).alias("w")).select("w.*")
    return meet(kept, again, "a", "left_anti").unionByName(one)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = exact_groups(docs, carry={"text_sha256": F.sha2(lower_ascii(text_or_empty("text")).cast("binary"), 256)})
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLES = {
    "op7_exact_dedup": """WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256 FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
}
