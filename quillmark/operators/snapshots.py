"""Diffs of keyed snapshots, manifests and multisets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count n."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, failing at run time on a repeated key. The check is a window over the keys, so it
    costs the shuffle that a join on them needs anyway."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    name = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    ok = F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate key: "), name)).cast("boolean")).otherwise(F.lit(True))
    return df.withColumn("_unique", ok).where("_unique").drop("_unique")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str, definition: str, unique: bool = True) -> DataFrame:
    """key, change (added, removed, value_changed, definition_changed), old_value, new_value.

    A full outer join on the key. A key may have changed in both ways and then has two rows;
    null equals null. unique: fail on a key that a snapshot has twice."""
    if unique:
        old, new = require_unique(old, key), require_unique(new, key)
    side = lambda df, s: df.select(F.col(key), F.col(value).alias(f"{s}_value"), F.col(definition).alias(f"{s}_def"), F.lit(True).alias(f"in_{s}"))
    both = side(old, "old").join(side(new, "new"), key, "full_outer")
    inner = F.col("in_old") & F.col("in_new")
    kinds = F.array_compact(
        F.array(
            F.when(F.col("in_old").isNull(), "added"),
            F.when(F.col("in_new").isNull(), "removed"),
            F.when(inner & ~F.col("old_value").eqNullSafe(F.col("new_value")), "value_changed"),
            F.when(inner & ~F.col("old_def").eqNullSafe(F.col("new_def")), "definition_changed"),
        )
    )
    return both.select(key, F.explode(kinds).alias("change"), "old_value", "new_value")


def manifest_diff(stored: DataFrame, current: DataFrame, path: str = "path", sha: str = "sha256") -> DataFrame:
    """path, state: changed, missing (gone now) or new; equal entries are left out."""
    a, b = stored.select(path, F.col(sha).alias("_a"), F.lit(1).alias("_in_a")), current.select(path, F.col(sha).alias("_b"), F.lit(1).alias("_in_b"))
    state = F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "new").when(~F.lower("_a").eqNullSafe(F.lower("_b")), "changed")
    return a.join(b, path, "full_outer").select(path, state.alias("state")).where("state is not null")


def manifest_verdict(diff: DataFrame) -> DataFrame:
    """One row: changed, missing, new (counts) and ok, which needs all to be 0."""
    out = diff.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("changed", "missing", "new")])
    return out.withColumn("ok", (F.col("changed") + F.col("missing") + F.col("new")) == 0)


def reseal(stored: DataFrame, current: DataFrame, path: str = "path", sha: str = "sha256") -> DataFrame:
    """The manifest extended by new entries. Fails if a sealed entry has changed or is gone."""
    diff = manifest_diff(stored, current, path, sha)
    bad = diff.where("state <> 'new'").limit(1)
    if not bad.isEmpty():
        raise ValueError(f"sealed entries have changed or are missing: {bad.first()[path]}")
    return stored.unionByName(current.join(diff.select(path), path, "left_semi"), allowMissingColumns=True)


def multiset_diff(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """columns, only_left, only_right: how many more of a row each side has. One aggregation
    of signed counts instead of two set differences."""
    rows = left.select(*columns, F.lit(1).alias("_d")).union(right.select(*columns, F.lit(-1).alias("_d")))
    d = rows.groupBy(*columns).agg(F.sum("_d").alias("_d")).where("_d <> 0")
    return d.select(*columns, F.greatest(F.col("_d"), F.lit(0)).alias("only_left"), F.greatest(-F.col("_d"), F.lit(0)).alias("only_right"))


def multiset_shortfall(required: DataFrame, given: DataFrame, *columns: str) -> DataFrame:
    """columns, missing: rows of required that given doesn't have often enough."""
    return multiset_diff(required, given, *columns).where("only_left > 0").select(*columns, F.col("only_left").alias("missing"))


def set_equal(a: Column, b: Column) -> Column:
    """Arrays with the same distinct values."""
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def keep_first(df: DataFrame, key: Column, *order: Column, keep_blank: bool = False) -> DataFrame:
    """The first row of each key. keep_blank: rows whose key is empty or null all stay."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    if keep_blank:
        blank = F.coalesce(key, F.lit("")) == ""
        return df.where(blank).unionByName(df.where(~blank).withColumn("_rn", rn).where("_rn = 1").drop("_rn"))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def union_keep_first(frames: list[DataFrame], key: Column, position: str, limit: int | None = None) -> DataFrame:
    """Rows of several ranked sources; of equal keys the earliest source's first row stays,
    rows without a key all stay. limit: first rows in source and position order."""
    ranked = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    out = keep_first(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked), key, F.col("_source"), F.col(position), keep_blank=True)
    return (out.orderBy("_source", position).limit(limit) if limit is not None else out).drop("_source")


def upgrade_first(df: DataFrame, key: Column, filled: str, *order: Column) -> DataFrame:
    """keep_first, but a later row gives its `filled` column where the first lacks it."""
    w = Window.partitionBy(key).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.first(F.when(F.length(F.col(filled)) > 0, F.col(filled)), ignorenulls=True).over(whole)
    return df.withColumn("_rn", F.row_number().over(w)).withColumn(filled, F.coalesce(best, F.col(filled))).where("_rn = 1").drop("_rn")


def blob_dedup(df: DataFrame, sha: str, *order: Column) -> DataFrame:
    """One row per blob, the first in order."""
    return keep_first(df, F.col(sha), *order)


def shared_urls(df: DataFrame, sha: str, url: str) -> DataFrame:
    """sha, urls: sorted distinct addresses of one blob."""
    return df.groupBy(sha).agg(F.array_sort(F.collect_set(url)).alias("urls"))


def digest(df: DataFrame, columns: list[str], *by: str, name: str = "digest") -> DataFrame:
    """SHA-256 over the ordered rows of each group (of df without `by`): equal for equal
    multisets of rows, whatever their order. Nulls differ from empty values.

    Groups are folded in two steps: rows to hashes, hashes to one sorted list, so a group costs
    32 bytes a row and no row's content is gathered."""
    row = F.unhex(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))
    out = F.sha2(F.to_binary(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda h: F.hex(h)), ""), F.lit("utf-8")), 256)
    return df.groupBy(*by).agg(out.alias(name))
