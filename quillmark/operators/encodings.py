"""Data decisions of chart encodings: orders, ranks, stacks and their domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators import charts, ordering

# What is known of the domain of a semantic type.
INTRINSIC = {"Latitude": (-90.0, 90.0), "Longitude": (-180.0, 180.0), "Correlation": (-1.0, 1.0)}
RANK_TYPES = ("Rank",)
DISCRETE = ("nominal", "ordinal")


def ordered_categories(df: DataFrame, category: str, rule: str, values: list | None = None, measure: str | None = None, arrival: str | None = None) -> DataFrame:
    """category and place (from 1) by a rule of options.sort_rules: values listed come first, in that
    order; measured orders take the sum of the measure; data takes the first arrival. Ties are
    broken by the category. Categories of a chart are few, once they are grouped."""
    found = df.where(F.col(category).isNotNull()).groupBy(category).agg((F.sum(measure) if measure else F.lit(0.0)).alias("_sum"), (F.min(arrival) if arrival else F.lit(0)).alias("_first"))
    if rule == "list":
        wanted = F.array(*[F.lit(v) for v in values or []])
        at = F.array_position(wanted, F.col(category))
        by = [F.when(at > 0, at).asc_nulls_last(), F.col("_first")]
    elif rule in ("ascending", "descending"):
        by = [F.col(category).desc() if rule == "descending" else F.col(category).asc()]
    elif rule == "data":
        by = [F.col("_first")]
    else:
        by = [F.col("_sum").desc() if rule.startswith("-") else F.col("_sum").asc()]
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*by, category))
    return found.select(category, place.alias("place"))


def stack_order(df: DataFrame, series: str, arrival: str, values: list | None = None) -> DataFrame:
    """series and place: segments are stacked as the legend lists them, as the series arrive
    or as `values` says; no rows where there is one series only."""
    out = ordered_categories(df, series, "list" if values else "data", values, arrival=arrival)
    return out.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).where("_n > 1").drop("_n")


def intrinsic_domain(df: DataFrame, value: str, semantic: str, annotated: tuple[float, float] | None = None) -> DataFrame:
    """One row: lo, hi: the domain that the annotation or the semantic type gives; percentages
    are shares (0 to 1) if four fifths of them are 1 at most, else 0 to 100; else nulls."""
    known = annotated or INTRINSIC.get(semantic)
    if known:
        return df.agg(F.lit(float(known[0])).alias("lo"), F.lit(float(known[1])).alias("hi"))
    number = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    share = F.count_if(F.abs(number) <= 1) >= 0.8 * F.count(number)
    percent = (F.count(number) > 0) & F.lit(semantic == "Percentage")
    return df.agg(F.when(percent, F.lit(0.0)).alias("lo"), F.when(percent, F.when(share, 1.0).otherwise(100.0)).alias("hi"))


def snapped(lo: Column, hi: Column, least: Column, largest: Column) -> Column:
    """struct min, max: the bounds of a domain that data come close to, within a quarter of it
    (of its half, where it has zero inside); null where they don't."""
    inside = (lo < 0) & (hi > 0)
    near_lo, near_hi = 0.25 * F.when(inside, -lo).otherwise(hi - lo), 0.25 * F.when(inside, hi).otherwise(hi - lo)
    return F.struct(F.when((least >= lo) & (least <= lo + near_lo), lo).alias("min"), F.when((largest <= hi) & (largest >= hi - near_hi), hi).alias("max"))


def stacked_axis(df: DataFrame, category: str, value: str, semantic: str, annotated: tuple[float, float] | None = None, coloured: bool = False, discrete: bool = True, bar_like: bool = True, mode: str | None = "zero") -> DataFrame:
    """One row: stacked, highest, lowest, decision, min, max of a measure's axis.

    Bars over a discrete axis are stacked where there is a colour or a category repeats (mode
    None turns that off; normalize leaves the domain alone). A sum beyond the intrinsic domain
    drops it (decision drop); sums close to its bounds are snapped to them (snap); else the
    axis is the data's (data)."""
    repeats = charts.repeated_categories(df, category).select(F.col("repeated"))
    extremes = charts.signed_extremes(df, category, value)
    domain = intrinsic_domain(df, value, semantic, annotated)
    row = repeats.crossJoin(extremes).crossJoin(domain)  # one row each
    stacked = F.lit(bar_like and discrete and mode is not None) & (F.lit(coloured) | F.col("repeated"))
    summed = stacked & F.lit(mode != "normalize")
    slack = (F.col("hi") - F.col("lo")) * 1e-6
    over = (F.col("highest") > F.col("hi") + slack) | (F.col("lowest") < F.col("lo") - slack)
    snap = snapped(F.col("lo"), F.col("hi"), F.col("lowest"), F.col("highest"))
    decision = F.when(summed & over, "drop").when(summed & (snap["min"].isNotNull() | snap["max"].isNotNull()), "snap").otherwise("data")
    keep = lambda c: F.when(decision == "snap", snap[c])
    return row.select(stacked.alias("stacked"), "highest", "lowest", decision.alias("decision"), keep("min").alias("min"), keep("max").alias("max"))


def bump_ranks(df: DataFrame, period: str, series: str, value: str) -> DataFrame:
    """period, series, rank: 1 for the largest sum of a period, equal sums alike; low ranks are
    drawn on top. (An extension: a rank that is a column already needs no computing.)"""
    sums = df.groupBy(period, series).agg(F.sum(value).alias("_v"))
    return sums.select(period, series, F.rank().over(Window.partitionBy(period).orderBy(F.desc("_v"))).cast("bigint").alias("rank"))


def rank_axis(x_semantic: str | None, y_semantic: str | None, x_kind: str, y_kind: str) -> str:
    """Which axis of a bump chart has the ranks: the one whose type says so, else the one
    across from the discrete one, else y."""
    x_rank, y_rank = x_semantic in RANK_TYPES, y_semantic in RANK_TYPES
    if x_rank != y_rank:
        return "x" if x_rank else "y"
    return "x" if y_kind in DISCRETE and x_kind not in DISCRETE else "y"


def gantt_rows(df: DataFrame, task: str, start: str, end: str) -> DataFrame:
    """task, start, end, place: tasks in the order of their first start, then name; a task's
    intervals stay rows of their own."""
    first = df.where(F.col(task).isNotNull()).groupBy(task).agg(F.min(start).alias("_first")).withColumn("_none", F.col("_first").isNull())
    placed = ordering.numbered(first, "place", ["_none", "_first", task]).select(task, "place")
    return df.select(task, start, end).join(placed, task)


def pixel_positions(df: DataFrame, value: str, lo: float, hi: float, pixels: float) -> DataFrame:
    """One row: positions: pixels that values fall on, along an axis from lo to hi."""
    if not hi > lo or pixels <= 0:
        return df.agg(F.lit(1).cast("bigint").alias("positions"))
    at = F.floor((F.col(value).cast("double") - lo) * (pixels / (hi - lo)) + 0.5)
    return df.agg(F.count_distinct(at).alias("positions"))
