"""Exact dedup: skew-safe combining of equal texts with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", salts: int = SALTS) -> DataFrame:
    """Groups of identical texts: one row per row of docs.

    Three combining stages, each grouping by digest *and* full text: the map side combines the
    rows of a task (partial aggregation; the salt is the task's), salted groups combine tasks,
    and the salt winners combine globally. A group of any size thus sends one row per task to
    the salted stage and at most `salts` rows to the last one. Rows then look their group up by digest alone, which
    is safe because the last stage has counted the texts of each digest; a digest that stands
    for two texts (a broken SHA-256) raises an error instead of merging them.

    Returns doc_id, keep_id (largest id of the group; the smallest with keep="min"),
    group_size, kept and text_sha256 (lowercase hex). Null text counts as empty; an empty table
    gives an empty result; rows that repeat an id count as rows; a row with a null id counts
    and is kept only if its group has no known id; other columns of docs are ignored, so their
    names can't clash.
    """
    best = {"max": F.max, "min": F.min}[keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.sha2(F.encode("text", "UTF-8"), 256))
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "text", "salt")
        .agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    texts = salted.groupBy("digest", "text").agg(best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = texts.groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    groups = groups.select(
        "digest",
        "keep_id",
        F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a digest")).cast("bigint")).alias("group_size"),
    )
    return rows.select("doc_id", "digest").join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
