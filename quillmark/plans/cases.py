"""Queries of encodings and reports over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.catalog import table
from quillmark.operators import encodings, reports

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


# encodings and reports over whole tables


@query("""
WITH v AS (SELECT c_mktsegment AS s, sum(c_acctbal) AS b FROM customer GROUP BY 1) SELECT s AS c_mktsegment, row_number() OVER (ORDER BY b DESC, s) AS place FROM v""")
def segments_by_value(spark: SparkSession, d: str) -> DataFrame:
    """Categories by a falling measure."""
    out = encodings.ordered_categories(table(spark, d, "customer"), "c_mktsegment", "-y", measure="c_acctbal")
    return out.select("c_mktsegment", F.col("place").cast("bigint").alias("place"))


@query("""
SELECT o_orderstatus, row_number() OVER (ORDER BY first, o_orderstatus) AS place FROM (SELECT o_orderstatus, min(o_orderkey) AS first FROM orders GROUP BY 1)""")
def stack_order(spark: SparkSession, d: str) -> DataFrame:
    """Segments are stacked as series arrive."""
    return encodings.stack_order(table(spark, d, "orders"), "o_orderstatus", "o_orderkey").select("o_orderstatus", F.col("place").cast("bigint").alias("place"))


@query("""
SELECT CASE WHEN count(*) FILTER (abs(l_discount) <= 1) >= 0.8 * count(l_discount) THEN 1.0 ELSE 100.0 END::DOUBLE AS hi, 0::DOUBLE AS lo FROM lineitem""")
def percentage_domain(spark: SparkSession, d: str) -> DataFrame:
    """The domain of shares."""
    return encodings.intrinsic_domain(table(spark, d, "lineitem"), "l_discount", "Percentage")


@query("""
WITH v AS (SELECT s_nationkey, sum(CASE WHEN s_acctbal >= 0 THEN s_acctbal ELSE 0 END) AS p, sum(CASE WHEN s_acctbal < 0 THEN s_acctbal ELSE 0 END) AS m, count(*) AS n FROM supplier GROUP BY 1),
e AS (SELECT max(p) AS h, min(m) AS l, bool_or(n > 1) AS stacked FROM v),
x AS (SELECT *, -1000000.0 AS lo, h * 1.2 AS hi FROM e)
SELECT stacked, round(h, 2) AS highest, round(l, 2) AS lowest, CASE WHEN NOT stacked THEN 'data' WHEN h > 5000.0 + 0.006 OR l < -1000.0 - 0.006 THEN 'drop' WHEN l <= -750 OR h >= 3750 THEN 'snap' ELSE 'data' END AS decision FROM x""")
def stacked_axis(spark: SparkSession, d: str) -> DataFrame:
    """Sums of a repeated category against the domain (Z58): most leave it, so it is dropped."""
    out = encodings.stacked_axis(table(spark, d, "supplier"), "s_nationkey", "s_acctbal", "Amount", annotated=(-1000.0, 5000.0))
    return out.select("stacked", F.round("highest", 2).alias("highest"), F.round("lowest", 2).alias("lowest"), "decision")


@query("""
WITH v AS (SELECT year(o_orderdate)::BIGINT AS y, o_orderpriority AS s, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT y, s, rank() OVER (PARTITION BY y ORDER BY v DESC) AS rank FROM v""")
def bump_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of series in each period."""
    orders = table(spark, d, "orders").select(F.year("o_orderdate").cast("bigint").alias("y"), F.col("o_orderpriority").alias("s"), "o_totalprice")
    return encodings.bump_ranks(orders, "y", "s", "o_totalprice")


@query("""
WITH t AS (SELECT user_id, min(ts) AS first FROM events GROUP BY 1), p AS (SELECT user_id, row_number() OVER (ORDER BY first, user_id) AS place FROM t)
SELECT user_id, place, count(*) AS intervals FROM events JOIN p USING (user_id) GROUP BY 1, 2""")
def gantt_rows(spark: SparkSession, d: str) -> DataFrame:
    """Tasks by their first start."""
    out = encodings.gantt_rows(table(spark, d, "events"), "user_id", "ts", "ts")
    return out.groupBy("user_id", F.col("place").cast("bigint").alias("place")).agg(F.count(F.lit(1)).alias("intervals"))


@query("SELECT count(DISTINCT floor((p_retailprice::DOUBLE - 900.0) * (300.0 / 1100.0) + 0.5)) AS positions FROM part")
def pixel_positions(spark: SparkSession, d: str) -> DataFrame:
    """Pixels that values fall on."""
    return encodings.pixel_positions(table(spark, d, "part"), "p_retailprice", 900.0, 2000.0, 300.0)


@query("""
WITH u AS (SELECT trim(url) AS url, min(page_id) AS "order" FROM pages WHERE url IS NOT NULL AND trim(url) <> '' AND trim(url) NOT LIKE '#%' GROUP BY 1) SELECT * FROM u ORDER BY "order" LIMIT 100""")
def url_list(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred addresses of a list, each once."""
    return reports.url_list(table(spark, d, "pages"), "page_id", "url", 100)


@query("""
SELECT CASE WHEN c_custkey % 50 = 0 THEN 'manual' WHEN c_acctbal < 0 THEN 'unresolved' ELSE c_mktsegment END AS source, count(*) AS n FROM customer GROUP BY 1""")
def resolver_stats(spark: SparkSession, d: str) -> DataFrame:
    """References by what resolved them."""
    rows = table(spark, d, "customer").select(F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("resolver"), (F.col("c_custkey") % 50 == 0).alias("manual"))
    return reports.resolver_stats(rows, "resolver", "manual")


@query("""
WITH u AS (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT *, row_number() OVER (ORDER BY n DESC, l_linestatus, l_returnflag) AS place FROM u""")
def usage_counts(spark: SparkSession, d: str) -> DataFrame:
    """Combinations, most common first."""
    return reports.usage_counts(table(spark, d, "lineitem"), "l_linestatus", "l_returnflag").withColumn("place", F.col("place").cast("bigint"))


@query("""
SELECT o_orderkey AS id, EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_size > 45) AS accepted FROM orders""")
def accepted_captures(spark: SparkSession, d: str) -> DataFrame:
    """Facts with an accepted capture (Z20): orders with a part of over 45."""
    evidence = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 45, "accept").otherwise("reject").alias("verdict"))
    listed = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("evidence_ids"))
    facts = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(listed.withColumnRenamed("l_orderkey", "id"), "id", "left")
    return reports.accepted_captures(facts, evidence).select("id", "accepted")


@query("""
WITH e AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next, event_id FROM events)
SELECT event_type, next, count(*) AS n, md5(string_agg(event_id::VARCHAR, ',' ORDER BY event_id)) AS ids FROM e WHERE next IS NOT NULL GROUP BY 1, 2""")
def transition_lists(spark: SparkSession, d: str) -> DataFrame:
    """Transitions with their keys in order."""
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("next", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("next is not null")
    out = reports.transition_lists(e, ["event_type", "next"], "event_id")
    return out.select("event_type", "next", "n", F.md5(F.array_join(F.transform("keys", lambda k: k.cast("string")), ",")).alias("ids"))


@query("""
WITH w AS (SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))) AS n FROM documents) SELECT doc_id, coalesce(n, 0)::BIGINT AS names FROM w""")
def distinct_names(spark: SparkSession, d: str) -> DataFrame:
    """Distinct matches of a text in one array."""
    names = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Z][a-z]+"), F.lit(0)))
    return table(spark, d, "documents").select("doc_id", F.size(names).cast("bigint").alias("names"))
