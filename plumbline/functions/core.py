"""Column helpers shared by all operators. Everything here stays inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_KM = 6371.0
EARTH_KM_MEAN = 6371.0088


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def clip(x, lo, hi) -> Column:
    """Bound to [lo, hi]; null stays null (least/greatest alone would skip it)."""
    x = col(x)
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(x.isNotNull(), F.greatest(lo, F.least(x, hi)))


def div(a, b) -> Column:
    """a / b, null when b is 0 or null."""
    return F.try_divide(col(a), col(b))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def no_nan(x) -> Column:
    x = col(x)
    return F.when(~F.isnan(x), x)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Apply the null model (NULL only, never NaN) to every floating column on read."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[no_nan(c).alias(c) if c in floats else F.col(c) for c in df.columns])


def zfill(x, width: int) -> Column:
    """Left-pad with zeros; longer strings are kept (lpad would cut them)."""
    s = col(x).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dp, dl = (p2 - p1) / 2, F.radians(col(lon2) - col(lon1)) / 2
    a = F.pow(F.sin(dp), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def seeded_hash(seed, *keys) -> Column:
    """60-bit draw that depends on seed and keys only, so any partitioning gives the same value. Taken modulo a population
    of n it reaches every position, with a bias below n / 2**60."""
    return F.conv(F.substring(_seeded_digits(seed, *keys), 1, 15), 16, 10).cast("long")


def seeded_even(seed, *keys) -> Column:
    """Whether ``seeded_hash`` is even, from its last digit alone."""
    return F.substring(_seeded_digits(seed, *keys), 15, 1).isin(*"02468ace")


def _seeded_digits(seed, *keys) -> Column:
    parts = [seed if isinstance(seed, Column) else F.lit(str(seed))] + [col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def seeded_unit(seed, *keys) -> Column:
    return seeded_hash(seed, *keys) / F.lit(float(1 << 60))


def fsum(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds)


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, conds)


def count_where(cond) -> Column:
    return F.count_if(cond)


def share_where(cond) -> Column:
    return F.avg(cond.cast("double"))


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str = "column", value: str = "value") -> DataFrame:
    """Wide to long; all value columns are read as double."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(ids, values, name, value)


def ladder(x, steps: list[tuple[float, object]], otherwise, strict: bool = False) -> Column:
    """First step whose lower bound is reached: [(bound, label), ...] in falling order."""
    x = col(x)
    out = None
    for bound, label in steps:
        cond = x > bound if strict else x >= bound
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def lookup(x, mapping: dict, default=None) -> Column:
    """Small fixed mapping as a map literal."""
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    found = F.try_element_at(m, col(x))
    return found if default is None else F.coalesce(found, F.lit(default))
