"""Filter interaction audit by exact constrained least squares.

Every document gets a bit mask of the filters it fails. Counts by mask say how many documents each of the 2^M coalitions of filters removes. From these, the
efficiency-constrained, kernel-weighted least-squares problem is solved in rationals, whose solution is each filter's Shapley share of the removals; what a filter removes
at a step of an order is the difference of two coalitions.
"""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import permutations
from string import ascii_uppercase

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import map_batches, table, text_or_empty

#: the filter that compares a text with the whole table; the others look at one text
TWIN = "E"
MARKS = "#$%&*|"


def text_filters() -> dict[str, Column]:
    """Failure condition by letter, over the column ``_text``."""
    text = F.col("_text")
    words, distinct = F.col("_words"), F.col("_distinct")
    return {"A": words < 200, "B": 100 * distinct < 50 * words, "C": 100 * (F.length(text) - F.length(F.translate(text, ascii_uppercase, ""))) > 3 * F.length(text), "D": F.length(F.translate(text, MARKS, "")) < F.length(text)}


def failure_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents by part, failed filters (bit k for the k-th letter; the last is ``TWIN``) and labels.

    Null text is empty, a null part is the empty string. A document fails ``TWIN`` when a smaller id has the same text; a null id neither fails it nor counts as smaller, rows that
    repeat an id do not make each other fail. Of repeated labels the largest counts; a null label is none. Texts do not leave the scan: equal
    ones meet by length and SHA-256, counted by part and labels before the shuffle, so a text that a third of all documents share is one row per task."""
    told = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_lid")).agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("_good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("_toxic"))
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), F.coalesce(F.col(part_col), F.lit("")).alias("_part"))
    words = F.filter(F.split("_text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("_list", words).withColumns({"_words": F.size("_list"), "_distinct": F.size(F.array_distinct("_list"))})
    mask = sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << k) for k, c in enumerate(text_filters().values())), F.lit(0))
    rows = rows.select("_id", "_part", mask.alias("_mask"), F.octet_length("_text").alias("_n"), F.sha2(F.col("_text").cast("binary"), 256).alias("_sha"))
    rows = rows.join(told, F.col("_id") == F.col("_lid"), "left")
    # rows of the smallest id of a text are found by counting those of the smallest id of each cell, and then the cells of the smallest id
    cell = ["_n", "_sha", "_mask", "_part", "_good", "_toxic"]
    ids = rows.groupBy(*cell, "_id").agg(F.count("*").alias("_rows"))
    cells = ids.groupBy(*cell).agg(F.sum("_rows").alias("_rows"), F.sum(F.when(F.col("_id").isNull(), F.col("_rows")).otherwise(0)).alias("_null"), F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_rows"))).alias("_first"))
    least = F.min("_first._id").over(Window.partitionBy("_n", "_sha"))
    cells = cells.withColumn("_firsts", F.col("_null") + F.when(F.col("_first._id") == least, F.col("_first._rows")).otherwise(0))
    both = F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("_firsts").alias("n")), F.struct(F.lit(1).alias("e"), (F.col("_rows") - F.col("_firsts")).alias("n")))).alias("x")
    flat = cells.select("_part", "_mask", F.coalesce("_good", F.lit(0)).alias("good"), F.coalesce("_toxic", F.lit(0)).alias("toxic"), both).filter("x.n > 0")
    twin = 1 << len(text_filters())
    return flat.groupBy(F.col("_part").alias("part"), (F.col("_mask") + F.col("x.e") * twin).alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def solve(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """Gauss-Jordan elimination in rationals."""
    rows = [[*r, b] for r, b in zip(matrix, right)]
    for k in range(len(rows)):
        at = next(i for i in range(k, len(rows)) if rows[i][k])
        rows[k], rows[at] = rows[at], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i, r in enumerate(rows):
            if i != k and r[k]:
                rows[i] = [x - r[k] * y for x, y in zip(r, rows[k])]
    return [r[-1] for r in rows]


def shapley(removed: list[int], m: int) -> list[Fraction]:
    """Shares phi of ``m`` filters from what each of the 2^m coalitions removes.

    They minimise sum over proper coalitions S of w(|S|) (removed(S) - sum of phi in S)^2 with w(s) = (m - 1) / (C(m, s) s (m - s)), under the constraint that all
    shares add up to what all filters together remove: the normal equations with one multiplier, solved exactly."""
    full = (1 << m) - 1
    if m == 1:
        return [Fraction(removed[full] - removed[0])]
    sets = [(s, Fraction(m - 1, math.comb(m, s.bit_count()) * s.bit_count() * (m - s.bit_count()))) for s in range(1, full)]
    a = [[sum((w for s, w in sets if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(m)] + [Fraction(1)] for i in range(m)]
    b = [sum((w * (removed[s] - removed[0]) for s, w in sets if s >> i & 1), Fraction(0)) for i in range(m)]
    return solve([*a, [Fraction(1)] * m + [Fraction(0)]], [*b, Fraction(removed[full] - removed[0])])[:m]


def coalition_table(by_mask: list[int]) -> list[int]:
    """Documents that each coalition removes: those that fail at least one of its filters."""
    return [sum(n for mask, n in enumerate(by_mask) if mask & s) for s in range(len(by_mask))]


def audit_rows(letters: str, count: list[int], good: list[int], toxic: list[int]) -> list[tuple]:
    """All orders and steps of one part from its documents by mask."""
    m, full = len(letters), len(count) - 1
    v, vg, vt = coalition_table(count), coalition_table(good), coalition_table(toxic)
    share = [int(x * math.factorial(m)) for x in shapley(v, m)]
    out = []
    for order in permutations(range(m)):
        name, before = "".join(letters[k] for k in order), 0
        for step, k in enumerate(order, 1):
            after = before | 1 << k
            removed = v[after] - v[before]
            out.append((name, step, sum(count) - v[after], removed, v[1 << k] - removed, v[full] - v[full ^ 1 << k], vg[after] - vg[before], vt[after] - vt[before], share[k]))
            before = after
    return out


def interaction_audit(masks: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part, order of all filters and step: (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), from ``failure_masks``.

    ``redundant``: documents failing the step's filter that an earlier one removed; ``unique_fails``: failing no other filter; ``shapley``: what the filter
    removes, summed over all orders. Parts are solved apart, from one row of 2^M counts each; an empty table gives no rows."""
    slots = range(1 << len(letters))
    tally = lambda c: F.array(*[F.sum(F.when(F.col("mask") == k, c).otherwise(0)) for k in slots])
    parts = masks.groupBy("part").agg(tally(F.col("n")).alias("count"), tally(F.col("n") * F.col("good")).alias("good"), tally(F.col("n") * F.col("toxic")).alias("toxic"))
    names = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches):
        for pdf in batches:
            for part, *cells in zip(pdf["part"], pdf["count"], pdf["good"], pdf["toxic"]):
                found = pd.DataFrame(audit_rows(letters, *[[int(x) for x in c] for c in cells]), columns=names)
                found.insert(0, "part", part)
                yield found

    return map_batches(parts, run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names[2:]))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction_audit(failure_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def _sql() -> str:
    """Plain counting: every document against every order."""
    orders = ", ".join(f"('{''.join(o)}')" for o in permutations("ABCDE"))
    return f"""WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, MAP {{'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)}} AS m FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, good, toxic, m['A'] AS a, m['B'] AS b, m['C'] AS c, m['D'] AS d, m['E'] AS e, list_sort(map_keys(map_from_entries(list_filter(map_entries(m), lambda x: x.value)))) AS fails, count(*) AS n FROM f GROUP BY ALL),
o AS (SELECT * FROM (VALUES {orders}) AS v(filter_order)),
s AS (SELECT c.part, o.filter_order, CAST(k AS INTEGER) AS step, good, toxic, n, list_contains(fails, substr(filter_order, k, 1)) AS hit,
 list_has_any(fails, string_split(substr(filter_order, 1, k - 1), '')) AS earlier, len(fails) AS size FROM c CROSS JOIN o CROSS JOIN range(1, 6) AS r(k)),
g AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter, sum(CASE WHEN NOT hit AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT earlier THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN hit AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN hit AND size = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN hit AND NOT earlier THEN n * good ELSE 0 END) AS good_lost,
 sum(CASE WHEN hit AND NOT earlier THEN n * toxic ELSE 0 END) AS toxic_lost FROM s GROUP BY 1, 2, 3)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
 CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM g"""


QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLES = {"op12_filter_audit": _sql()}
