"""Queries over text structures and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.catalog import table
from quillmark.functions import refs
from quillmark.functions import text as tx
from quillmark.operators import logs, ordering, spans
from quillmark.sources import html, markdown
from quillmark.streaming import logs as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query()
def sentences_of_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.size(markdown.segments(F.col("text"))).alias("sentences"))


@query()
def page_images(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.size(html.page_images("html", "url")).alias("images"))


@query()
def quote_spans(spark: SparkSession, d: str) -> DataFrame:
    """Line windows of the benchmark passages in the documents that contain them."""
    quotes, docs = table(spark, d, "benchmark").select("item_id", "text"), table(spark, d, "documents").select("doc_id", "text")
    hits = spans.contained_quotes(quotes, docs, "item_id", "doc_id")
    pairs = hits.join(quotes.withColumnRenamed("text", "quote"), "item_id").join(docs, "doc_id")
    return pairs.select("item_id", "doc_id", spans.span_of("text", "quote").alias("s")).select("item_id", "doc_id", "s.*")


@query("""
SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN regexp_matches(c_name, '^[A-Za-z0-9]') THEN 0 ELSE 2 END, lower(c_name), c_name, c_custkey) AS place FROM customer""")
def script_collation(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "customer").select("c_custkey", *[k.alias(f"k{i}") for i, k in enumerate(refs.collation(F.col("c_name")))])
    return ordering.numbered(keyed, "place", [c for c in keyed.columns if c != "c_custkey"] + ["c_custkey"]).select("c_custkey", "place")


@query("""
SELECT count(*) FILTER (text LIKE '%@%') AS with_mail, count(*) FILTER (regexp_matches(text, '(?i)(key|secret|password|auth|token)=')) AS with_secret FROM documents""")
def secret_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count_if(F.col("text").contains("@")).alias("with_mail"), F.count_if(F.col("text").rlike("(?i)(key|secret|password|auth|token)=")).alias("with_secret"))


@query("SELECT conv_id, turn, len(regexp_extract_all(text, '\\d[\\d,]*(?:\\.\\d+)?'))::INT AS n FROM conversations")
def number_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(tx.number_tokens(F.col("text"))).alias("n"))


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("""
SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def stream_last_state(spark: SparkSession, d: str) -> DataFrame:
    """The log read as a stream, the last row of each key kept in buckets of a dataset."""
    at = _folder(spark)
    events = table(spark, d, "events")
    stream = streams.read_log(spark, f"{d}/events.parque[t]", events.schema, format="parquet")
    stream = stream.select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    return streams.upsert_once(stream, f"{at}/state", f"{at}/checkpoint", "user_id", "at").read().select("user_id", "event_type")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Extension: counts in tumbling windows."""
    return streams.counts_by_window(table(spark, d, "events"), "ts", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Extension: sessions closed by half an hour without events."""
    return streams.sessions(table(spark, d, "events"), "ts", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_rows(spark: SparkSession, d: str) -> DataFrame:
    return logs.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")
