"""Places and running sums in a total order, range by range instead of in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a table is cut into, and rows sampled for each to choose the cuts.
RANGES, SAMPLED = 64, 40


def with_ranges(df: DataFrame, keys: list[str], ranges: int = RANGES) -> DataFrame:
    """df with _range: the number of the range of its keys. Ranges follow the order of the keys;
    equal keys share one. The cuts are at most `ranges` of some sampled rows (those with the
    smallest hashes of keys and place: one pass, some rows a task), so _range is a plain
    expression that is the same wherever it is computed; a row is compared with six of 64 cuts."""
    wanted = ranges * SAMPLED
    drawn = df.select(*keys).orderBy(F.xxhash64(*keys, F.monotonically_increasing_id())).limit(wanted).collect()
    order = lambda row: tuple((v is not None, v) if not isinstance(v, float) else (True, v != v, v) for v in row)
    rows = sorted(drawn, key=order) if len(drawn) == wanted else []
    cuts = list(dict.fromkeys(rows[i * len(rows) // ranges] for i in range(1, ranges))) if rows else []
    types = [df.schema[k].dataType for k in keys]
    own = F.struct(*keys)
    bound = [F.struct(*[F.lit(v).cast(t).alias(k) for v, t, k in zip(cut, types, keys, strict=True)]) for cut in cuts]

    def found(lo: int, hi: int) -> Column:
        """The number of cuts below the row's keys, of lo to hi."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(own > bound[mid], found(mid + 1, hi)).otherwise(found(lo, mid))

    return df.withColumn("_range", found(0, len(bound)))


def _before(ranged: DataFrame, total: Column) -> Column:
    """The sum of `total` over the ranges before a row's own, as an expression."""
    sums = dict(ranged.groupBy("_range").agg(total.alias("total")).collect())  # one row a range
    at, so_far = F.when(F.lit(False), F.lit(0)), 0
    for r in sorted(sums):
        at = at.when(F.col("_range") == r, F.lit(so_far))
        so_far += sums[r] or 0
    return at


def numbered(df: DataFrame, name: str, keys: list[str], ranges: int = RANGES) -> DataFrame:
    """df with the place of each row (from 1) in the order of the keys, nulls first. Rows with
    equal keys get neighbouring places in no set order, so keys should tell rows apart."""
    ranged = with_ranges(df, keys, ranges)
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return ranged.withColumn(name, (own + _before(ranged, F.count(F.lit(1)))).cast("bigint")).drop("_range")


def running_sum(df: DataFrame, name: str, value: Column, keys: list[str], ranges: int = RANGES) -> DataFrame:
    """df with the sum of `value` over all rows before each in the order of the keys; rows with
    equal keys are taken in some order. Null counts as 0."""
    v = F.coalesce(value.cast("double"), F.lit(0.0))
    ranged = with_ranges(df, keys, ranges)
    w = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn(name, F.coalesce(F.sum(v).over(w), F.lit(0.0)) + _before(ranged, F.sum(v)).cast("double")).drop("_range")


def with_previous(df: DataFrame, name: str, value: str, ranges: int = RANGES) -> DataFrame:
    """df, whose values are distinct and not null, with the largest value below each."""
    ranged = with_ranges(df, [value], ranges)
    tops = dict(ranged.groupBy("_range").agg(F.max(value)).collect())  # one row a range
    before, last = F.when(F.lit(False), F.lit(None)), None
    for r in sorted(tops):
        before = before.when(F.col("_range") == r, F.lit(last))
        last = tops[r]
    inside = F.lag(value).over(Window.partitionBy("_range").orderBy(value))
    return ranged.withColumn(name, F.coalesce(inside, before.cast(df.schema[value].dataType))).drop("_range")
