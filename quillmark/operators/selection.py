"""Exact order statistics of groups of any size, without a group's values in one buffer or task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A sketch of this accuracy misses a rank by at most 1 / ACCURACY of the group; windows are
#: taken twice as wide on both sides.
ACCURACY = 10_000
#: Tasks that the rows of one group are dealt over.
SHARES = 64


def order_statistics(df: DataFrame, value: str, wanted: dict[str, tuple], by: list[str] = [], accuracy: int = ACCURACY) -> DataFrame:  # noqa: B006
    """by, n and one column per wanted name: the linearly interpolated quantile of a probability
    p (("at", p): place p * (n - 1) from 0), or the value at place floor(n * p) (("index", p)).

    A mergeable sketch per group bounds each wanted place by two values; rows below are counted
    by a plain aggregation, and only rows between the bounds (some n / 2,500) are counted by value
    and ordered. So no task sees more of a group than that, and a value that many rows share is
    one row. Nulls and NaN don't count; a group without values has nulls. If a sketch's bounds
    should miss a place, that is an error, not a wrong value."""
    keys, names = [f"_k{i}" for i in range(len(by))], list(wanted)
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    step = 2.0 / accuracy
    probability = [p for _, p in wanted.values()]
    lo, hi = ([min(1.0, max(0.0, p + side * step)) for p in probability] for side in (-1, 1))
    cut = lambda ps: F.percentile_approx("_v", [float(p) for p in ps], accuracy)
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), cut(lo).alias("_lo"), cut(hi).alias("_hi"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    # places from 0, and the bounds of each; of few rows all lie between
    n = F.col("_n")
    places = []
    for i, (kind, p) in enumerate(wanted.values()):
        at = (n - 1) * p if kind == "at" else F.least(F.floor(n * p), n - 1).cast("double")
        few = n <= accuracy / 2
        places.append(F.struct(F.lit(i).alias("i"), at.alias("at"), F.when(few, F.col("_min")).otherwise(F.col("_lo")[i]).alias("lo"), F.when(few, F.col("_max")).otherwise(F.col("_hi")[i]).alias("hi")))
    bounds = groups.select(*[F.col(k).alias(f"{k}b") for k in keys], F.array(*places).alias("_p"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}b")) for k in keys]
    # a group's rows are dealt over SHARES tasks at least, each with its copy of the bounds
    share = F.pmod(F.xxhash64("_v"), F.lit(SHARES))
    copies = bounds.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    joined = rows.withColumn("_of", share).join(copies, [*same, F.col("_of") == F.col("_share")], "inner") if keys else rows.join(F.broadcast(bounds))  # one row
    # one row per place a value matters for: below its bounds (counted only) or between them
    hits = joined.select(*keys, "_v", F.explode(F.filter("_p", lambda p: F.col("_v") <= p["hi"])).alias("p"))
    inside = F.col("_v") >= F.col("p.lo")
    counted = hits.groupBy(*keys, F.col("p.i").alias("i"), F.col("p.at").alias("at"), F.when(inside, F.col("_v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    # nulls first: what lies below comes before the values between
    w = Window.partitionBy(*keys, "i").orderBy(F.col("v").asc_nulls_first())
    run = counted.withColumns({"end": F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))}).where("v is not null").withColumn("begin", F.col("end") - F.col("c"))
    reach = lambda place: F.max(F.when((F.col("begin") <= place) & (place < F.col("end")), F.col("v")))
    first = F.floor("at")
    picked = run.groupBy(*keys, "i", "at").agg(reach(first).alias("a"), reach(F.ceil("at")).alias("b"))
    between = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a place lies outside its bounds")).cast("double")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - first))
    found = picked.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, between)).alias(name) for i, name in enumerate(names)])
    found = found.select(*[F.col(k).alias(f"{k}b") for k in keys], *names)
    every = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")), 1).alias("_one")).groupBy(*keys).agg(F.count("_one").alias("n"))
    out = every.join(found, same, "left") if keys else every.join(F.broadcast(found), F.lit(True), "left")
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "n", *names)
