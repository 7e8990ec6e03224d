"""Parsers for the strings found in claims, storm and survey files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.core import col, ladder, lookup, zfill

# Damage suffixes in thousands of dollars; zone codes of the hundred-year area.
DAMAGE_SUFFIX_K = {"K": 1.0, "M": 1000.0, "B": 1000000.0}
ZONE_A_CODES = ("A", "AE", "AH", "AO", "AR", "A99", "VE", "V")


def zip5(x) -> Column:
    """Five-digit postal key, null when the text holds no usable one."""
    padded = zfill(F.substring(F.regexp_replace(F.trim(col(x)), r"[^0-9]", ""), 1, 5), 5)
    return F.when(padded != "00000", padded)


def damage_thousands(x) -> Column:
    """'10K', '1.5M', '2B' or plain dollars, in thousands of dollars; unreadable text is 0."""
    s = F.upper(F.trim(col(x)))
    factor = lookup(F.right(s, F.lit(1)), DAMAGE_SUFFIX_K)
    body = F.when(factor.isNotNull(), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)
    return F.coalesce(body.try_cast("double") * F.coalesce(factor, F.lit(0.001)), F.lit(0.0))


def interval_bounds(x) -> tuple[Column, Column]:
    """'(10.3, 13.2)' -> (10.3, 13.2)."""
    shape = r"^\(\s*([0-9.]+)\s*,\s*([0-9.]+)\s*\)"
    return tuple(F.regexp_extract(col(x), shape, i).try_cast("double") for i in (1, 2))


def flood_zone_class(zone, subtype) -> Column:
    """A (hundred-year), X500 (five-hundred-year) or X."""
    z, sub = F.upper(F.trim(col(zone))), F.coalesce(F.upper(F.trim(col(subtype))), F.lit(""))
    shaded = sub.contains("500") | sub.contains("0.2") | sub.contains("SHADED")
    return (
        F.when(z.isNull(), "X")
        .when(z.isin(*ZONE_A_CODES) | z.contains("FLOODWAY"), "A")
        .when(((z == "X") & shaded) | z.contains("0.2 PCT"), "X500")
        .otherwise("X")
    )


def wind_category(knots) -> Column:
    k = col(knots)
    return F.when(k.isNotNull(), ladder(k, [(137, 5), (113, 4), (96, 3), (83, 2), (64, 1)], 0))


def surge_category(metres) -> Column:
    m = col(metres)
    return F.when(m.isNotNull(), ladder(m, [(5.5, "5"), (3.7, "4"), (2.4, "3"), (1.5, "2")], "1"))


def zone_bucket(x) -> Column:
    """Level of a score: HIGH from 0.7, MEDIUM from 0.4."""
    return F.when(col(x).isNotNull(), ladder(x, [(0.7, "HIGH"), (0.4, "MEDIUM")], "LOW"))


def vulnerability_label(x) -> Column:
    return F.when(col(x).isNull(), "N/A").otherwise(ladder(x, [(0.75, "Very High"), (0.5, "High"), (0.25, "Moderate")], "Low"))
