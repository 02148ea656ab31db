"""Append-only logs: latest state per key, failures, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_status(status: Column, failure: Column, snapshot: Column, http: Column | None = None) -> Column:
    """ok, partial or fail of a log line; older lines have no status of their own, and a
    snapshot alone doesn't make them ok."""
    bad = (F.coalesce(failure, F.lit("")) != "") | (F.coalesce(snapshot, F.lit("")) == "")
    if http is not None:
        bad = bad | (F.coalesce(http.try_cast("int"), F.lit(0)) >= 400)
    return F.when(status.isin("ok", "partial", "fail"), status).otherwise(F.when(bad, "fail").otherwise("partial"))


def latest(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The last row of each key. One aggregation with map-side combining, no sort."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def last_status(df: DataFrame, url: str, status: str, *order: str) -> DataFrame:
    """url, status: whatever the last line says."""
    return latest(df.select(url, status, *order), [url], *order).select(url, status)


def acquisition(df: DataFrame, url: str, kind: str, status: str, *order: str) -> DataFrame:
    """url, status: the last final line's; without one the last attempt that got something;
    else fail."""
    at = F.struct(*order)
    good = F.col(status).isin("ok", "partial")
    final = F.max_by(F.when(F.col(kind) == "final", F.col(status)), F.when(F.col(kind) == "final", at))
    tried = F.max_by(F.when(good, F.col(status)), F.when(good, at))
    return df.groupBy(url).agg(F.coalesce(final, tried, F.lit("fail")).alias("status"))


def fetch_counts(df: DataFrame, url: str, kind: str, status: str, *order: str) -> DataFrame:
    """One row: attempt_failures (lines that aren't final) and final_failures (addresses whose
    last line failed)."""
    per = df.groupBy(url).agg(
        F.count_if(~F.col(kind).eqNullSafe("final") & (F.col(status) == "fail")).alias("a"), F.max_by(status, F.struct(*order)).alias("s")
    )
    return per.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("attempt_failures"), F.count_if(F.col("s") == "fail").alias("final_failures"))


def failures_by(df: DataFrame, column: str) -> DataFrame:
    """column, n: most failures first, then by name."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def replay_summary(df: DataFrame, status: str = "status") -> DataFrame:
    """status, n, ratio (four places) for ok, partial and fail, those that don't occur too."""
    spark = df.sparkSession
    n = df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    out = spark.createDataFrame([("ok",), ("partial",), ("fail",)], "status string").join(n.withColumnRenamed(status, "status"), "status", "left").crossJoin(F.broadcast(total))
    return out.select("status", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.nullif("total", F.lit(0)), 4).alias("ratio"))


def transitions(left: DataFrame, right: DataFrame, url: str, status: str) -> DataFrame:
    """before, after, n, urls (sorted) for addresses of both runs; addresses of one run only
    have null on the other side."""
    a, b = left.select(url, F.col(status).alias("before")), right.select(url, F.col(status).alias("after"))
    return a.join(b, url, "full_outer").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(url)).alias("urls"))


def replay_row(trace: Column) -> Column:
    """struct tier, reason: the last successful tier and the last reason of an array of tries."""
    good = F.filter(trace, lambda t: t["status"].isin("ok", "partial"))
    bad = F.filter(trace, lambda t: F.coalesce(t["reason"], F.lit("")) != "")
    return F.struct(F.try_element_at(good, F.lit(-1))["tier"].alias("tier"), F.try_element_at(bad, F.lit(-1))["reason"].alias("reason"))


def ladder(attempts: DataFrame, url: str, tier_rank: str, status: str, http: str) -> DataFrame:
    """The outcome of a fetch ladder from its logged attempts: up to the first 404 or 410, the
    first ok in tier order, else the first partial, else the last failure."""
    order = Window.partitionBy(url).orderBy(tier_rank)
    stop = F.max(F.col(http).isin(404, 410).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    live = attempts.withColumn("_stop", F.coalesce(stop, F.lit(0))).where("_stop = 0")
    rank = F.when(F.col(status) == "ok", 0).when(F.col(status) == "partial", 1).otherwise(2)
    place = F.when(F.col(status) == "fail", -F.col(tier_rank)).otherwise(F.col(tier_rank))
    rest = [c for c in attempts.columns if c != url]
    return live.groupBy(url).agg(F.min_by(F.struct(*rest), F.struct(rank, place)).alias("_r")).select(url, "_r.*")


def tier_order(host: Column, routes: list[tuple[str, list[str]]], default: list[str]) -> Column:
    """Tiers for a host: direct first, then those of the first route whose pattern matches,
    then the other defaults."""
    out = F.array(*[F.lit(t) for t in default])
    for pattern, tiers in reversed(routes):
        names = ["direct", *[t for t in tiers if t != "direct"]]
        out = F.when(host.rlike(pattern), F.array(*[F.lit(t) for t in [*names, *[d for d in default if d not in names]]])).otherwise(out)
    return out


def search_log_row(results: DataFrame, url_key: Column, *by: str) -> DataFrame:
    """by, n_returned, n_kept (distinct addresses)."""
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("n_returned"), F.count_distinct(url_key).alias("n_kept"))


def backend_verdict(states: Column) -> Column:
    """One state for an array of backend states: ok if any, blocked or error before empty."""
    return F.when(F.array_contains(states, "ok"), "ok").when(F.array_contains(states, "blocked"), "blocked").when(F.array_contains(states, "error"), "error").otherwise("empty")


def exit_code(states: Column) -> Column:
    """0 if a backend answered (ok or empty), 2 if all were blocked, else 1."""
    return F.when(F.exists(states, lambda s: s.isin("ok", "empty")), 0).when((F.size(states) > 0) & F.forall(states, lambda s: s == "blocked"), 2).otherwise(1)


def first_backend(rows: DataFrame, by: str, rank: str, n: str) -> DataFrame:
    """The first backend in rank order that gave rows, per `by`."""
    rest = [c for c in rows.columns if c != by]
    return rows.where(F.col(n) > 0).groupBy(by).agg(F.min_by(F.struct(*rest), F.col(rank)).alias("_r")).select(by, "_r.*")


def top_up(layers: DataFrame, by: str, layer: str, n: str, wanted: int) -> DataFrame:
    """Layers used: the next one only while fewer than max(3, wanted // 2) results are there."""
    before = F.coalesce(F.sum(n).over(Window.partitionBy(by).orderBy(layer).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return layers.withColumn("before", before).where(F.col("before") < max(3, wanted // 2))
