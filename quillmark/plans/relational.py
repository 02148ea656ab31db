"""Queries of the ledger, log, coverage and set operators over the star-schema tables.

Every query reads its whole tables. The SQL is DuckDB's, over views of the same names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.catalog import table
from quillmark.functions import text as tx
from quillmark.functions import urls
from quillmark.operators import coverage, ledger, logs, snapshots

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_STATUS = "CASE event_type WHEN 'error' THEN 'fail' WHEN 'view' THEN 'partial' ELSE 'ok' END"


def _status() -> F.Column:
    return F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "partial").otherwise("ok")


@query("""
WITH l AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT event_type AS status, count(*) AS n FROM l WHERE rn = 1 GROUP BY 1""")
def latest_status_per_key(spark: SparkSession, d: str) -> DataFrame:
    last = logs.last_status(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")
    return logs.failures_by(last.withColumnRenamed("event_type", "status"), "status")


@query(f"""
WITH e AS (SELECT user_id, ts, event_id, {_STATUS} AS s, CASE WHEN event_type = 'purchase' THEN 'final' ELSE 'attempt' END AS k FROM events),
p AS (SELECT user_id, coalesce(arg_max(s, (ts, event_id)) FILTER (k = 'final'), arg_max(s, (ts, event_id)) FILTER (s IN ('ok', 'partial')), 'fail') AS status FROM e GROUP BY 1)
SELECT user_id, status FROM p""")
def acquisition_status(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", _status().alias("s"), F.when(F.col("event_type") == "purchase", "final").otherwise("attempt").alias("k"))
    return logs.acquisition(e, "user_id", "k", "s", "ts", "event_id")


@query(f"""
WITH e AS (SELECT user_id, ts, event_id, {_STATUS} AS s, event_type = 'purchase' AS f FROM events),
p AS (SELECT user_id, count(*) FILTER (NOT f AND s = 'fail') AS a, arg_max(s, (ts, event_id)) AS s FROM e GROUP BY 1)
SELECT sum(a)::BIGINT AS attempt_failures, count(*) FILTER (s = 'fail') AS final_failures FROM p""")
def fetch_failure_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", _status().alias("s"), F.when(F.col("event_type") == "purchase", "final").otherwise("attempt").alias("k"))
    return logs.fetch_counts(e, "user_id", "k", "s", "ts", "event_id")


@query("""
WITH l AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id AS gate, event_id AS last_event FROM l WHERE rn = 1 AND event_type <> 'error'""")
def completed_gate_order(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.operators import provenance

    e = table(spark, d, "events").select(F.col("user_id").alias("gate"), F.struct("ts", "event_id").alias("seq"), (F.col("event_type") == "error").cast("int").alias("exit"), "event_id")
    return provenance.completed(e, "gate", "seq", "exit").select("gate", F.col("event_id").alias("last_event"))


@query("""
SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS supersedes FROM events""")
def superseded_pointer(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.operators import provenance

    return provenance.supersedes(table(spark, d, "events"), "user_id", "event_id", "ts", "event_id").select("event_id", "supersedes")


@query("""
WITH o AS (SELECT o_orderkey AS k, o_totalprice AS v, o_orderpriority AS f FROM orders WHERE o_orderkey % 10 <> 3),
n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderpriority END AS f FROM orders WHERE o_orderkey % 10 <> 5),
b AS (SELECT coalesce(o.k, n.k) AS k, o.k AS ok, n.k AS nk, o.v AS ov, n.v AS nv, o.f AS of, n.f AS nf FROM o FULL JOIN n ON o.k = n.k)
SELECT k, 'added' AS change, ov AS old_value, nv AS new_value FROM b WHERE ok IS NULL UNION ALL SELECT k, 'removed', ov, nv FROM b WHERE nk IS NULL
UNION ALL SELECT k, 'value_changed', ov, nv FROM b WHERE ok IS NOT NULL AND nk IS NOT NULL AND ov IS DISTINCT FROM nv
UNION ALL SELECT k, 'definition_changed', ov, nv FROM b WHERE ok IS NOT NULL AND nk IS NOT NULL AND of IS DISTINCT FROM nf""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderpriority").alias("f"))
    new = o.where("k % 10 <> 5").select("k", F.when(F.col("k") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("v"), F.when(F.col("k") % 11 == 0, "X").otherwise(F.col("f")).alias("f"))
    return snapshots.snapshot_diff(o.where("k % 10 <> 3"), new, "k", "v", "f")


@query("""
WITH f AS (SELECT 'F' || o_orderkey AS id, ['E' || (o_orderkey * 3 + i) for i in range(0, o_orderkey % 3 + 1)] AS ids, CASE WHEN o_orderkey % 2 = 0 THEN 4 END AS fv FROM orders),
e AS (SELECT 'E' || (o_orderkey * 3 + i) AS id, 'F' || (o_orderkey + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END) AS fact, CASE WHEN o_orderkey % 5 = 0 THEN 4 ELSE 3 END AS ev FROM orders, range(0, 2) t(i)),
l AS (SELECT id AS fact_id, fv, unnest(ids) AS evidence_id FROM f)
SELECT CASE WHEN e.id IS NULL THEN 'missing_evidence' ELSE 'other_fact' END AS issue, l.fact_id, l.evidence_id, coalesce(fv, 3) = 4 OR coalesce(ev, 3) = 4 AS strict
FROM l LEFT JOIN e ON e.id = l.evidence_id WHERE e.id IS NULL OR e.fact IS DISTINCT FROM l.fact_id
UNION ALL SELECT 'not_listed', e.fact, e.id, coalesce(fv, 3) = 4 OR ev = 4 FROM e LEFT JOIN f ON f.id = e.fact WHERE f.id IS NULL OR NOT list_contains(f.ids, e.id)""")
def referential_integrity(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey")
    name = lambda x: F.concat(F.lit("E"), x.cast("string"))
    facts = o.select(F.concat(F.lit("F"), k).alias("id"), F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: name(k * 3 + i)).alias("evidence_ids"), F.when(k % 2 == 0, 4).alias("schema_version"))
    evidence = o.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select(
        name(k * 3 + F.col("i")).alias("id"), F.concat(F.lit("F"), k + F.when(k % 13 == 0, 1).otherwise(0)).alias("fact_id"), F.when(k % 5 == 0, 4).otherwise(3).alias("schema_version")
    )
    return ledger.reference_issues(facts, evidence)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def orphan_reject(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return ledger.reject_orphans(lines, table(spark, d, "part").where("p_size > 5").select("p_partkey"), "l_partkey", "p_partkey")[1].select("l_orderkey", "l_linenumber")


@query("""
SELECT n_name AS target, count(c_custkey) AS facts FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1""")
def coverage_counts(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.array(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))).alias("aliases"))
    facts = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("id"), F.concat(F.lit("N "), F.col("c_nationkey").cast("string")).alias("entity"))
    return coverage.facts_per_target(nation, facts)


@query("""
SELECT r_name AS area, count(*) FILTER (s = 'F') AS "F", count(*) FILTER (s = 'O') AS "O", count(*) FILTER (s = 'P') AS "P", count(*) AS total
FROM (SELECT r_name, o_orderstatus AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY ROLLUP (r_name)""")
def coverage_by_state(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return coverage.coverage_counts(rows.select(F.col("r_name").alias("area"), F.col("o_orderstatus").alias("s")), "area", "s", ["F", "O", "P"])


_RECALL = """
WITH t AS (SELECT s_name AS name, regexp_replace(lower(s_name), '[\\s-]+', '', 'g') AS k1, 'c' || s_suppkey AS k2 FROM supplier),
f AS (SELECT c_name AS name, regexp_replace(lower(c_name), '[\\s-]+', '', 'g') AS k1, 'c' || (c_custkey * 3) AS k2 FROM customer),
fk AS (SELECT k1 AS k FROM f UNION SELECT k2 FROM f)
"""


def _recall(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    alias = lambda x: F.array(F.concat(F.lit("C-"), x.cast("string")))
    truth = table(spark, d, "supplier").select(F.col("s_name").alias("name"), alias(F.col("s_suppkey")).alias("aliases"))
    found = table(spark, d, "customer").select(F.col("c_name").alias("name"), alias(F.col("c_custkey") * 3).alias("aliases"))
    return coverage.recall(truth, found)


@query(_RECALL + "SELECT name FROM t WHERE k1 NOT IN (SELECT k FROM fk) AND k2 NOT IN (SELECT k FROM fk)")
def alias_recall_missed(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d)["missed"].select("name")


@query(_RECALL + "SELECT count(*) FILTER (h) AS found, count(*) AS total, round(count(*) FILTER (h) / count(*), 4) AS ratio FROM (SELECT k1 IN (SELECT k FROM fk) OR k2 IN (SELECT k FROM fk) AS h FROM t)")
def alias_recall(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d)["recall"]


@query(_RECALL + ", tk AS (SELECT k1 AS k FROM t UNION SELECT k2 FROM t) SELECT min(name) AS name FROM f WHERE k1 NOT IN (SELECT k FROM tk) AND k2 NOT IN (SELECT k FROM tk) GROUP BY k1")
def alias_recall_extra(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d)["extra"]


_RUNS = "CASE WHEN o_orderstatus = 'F' THEN 'fail' WHEN o_orderstatus = 'O' THEN 'ok' ELSE 'partial' END"


@query(f"""
WITH a AS (SELECT o_orderkey AS url, {_RUNS} AS s FROM orders WHERE o_orderkey % 4 <> 0), b AS (SELECT o_orderkey AS url, CASE WHEN o_orderpriority < '3' THEN 'ok' ELSE 'fail' END AS s FROM orders WHERE o_orderkey % 5 <> 0)
SELECT a.s AS before, b.s AS after, count(*) AS n FROM a FULL JOIN b ON a.url = b.url GROUP BY 1, 2""")
def run_transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "url")
    a = o.where("url % 4 <> 0").select("url", F.expr(_RUNS).alias("s"))
    b = o.where("url % 5 <> 0").select("url", F.when(F.col("o_orderpriority") < "3", "ok").otherwise("fail").alias("s"))
    return logs.transitions(a, b, "url", "s").select("before", "after", "n")


@query("""
WITH s AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS h FROM documents WHERE doc_id % 9 <> 1), c AS (SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN doc_id % 17 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 8 <> 3)
SELECT coalesce(s.path, c.path) AS path, CASE WHEN c.path IS NULL THEN 'missing' WHEN s.path IS NULL THEN 'new' ELSE 'changed' END AS state FROM s FULL JOIN c ON s.path = c.path WHERE s.path IS NULL OR c.path IS NULL OR s.h <> c.h""")
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    sha = lambda t: F.sha2(F.encode(t, "UTF-8"), 256).alias("sha256")
    path = F.col("doc_id").cast("string").alias("path")
    changed = F.when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return snapshots.manifest_diff(docs.where("doc_id % 9 <> 1").select(path, sha("text")), docs.where("doc_id % 8 <> 3").select(path, sha(changed)))


@query("SELECT sha256(text) AS sha, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def exact_blob_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"), "doc_id")
    return docs.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT sha256(text) AS sha, string_agg(DISTINCT source, ',' ORDER BY source) AS urls FROM documents GROUP BY 1")
def shared_keys_per_blob(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"), "source")
    return snapshots.shared_urls(docs, "sha", "source").select("sha", F.array_join("urls", ",").alias("urls"))


_HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"


@query(f"""
SELECT page_id, {_HOST} AS host, regexp_replace({_HOST}, '^www\\.', '') AS publisher, regexp_replace(trim(url), '/+$', '') AS coverage_key FROM pages""")
def url_hosts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.host(u).alias("host"), urls.publisher(u).alias("publisher"), urls.coverage_key(u).alias("coverage_key"))


_KEY = r"""lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') ||
 coalesce((SELECT '?' || string_agg(CASE WHEN contains(q, '=') THEN q ELSE q || '=' END, '&' ORDER BY CASE WHEN contains(q, '=') THEN q ELSE q || '=' END) FROM unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS t(q)
   WHERE q <> '' AND NOT starts_with(lower(q), 'utm_') AND lower(split_part(q, '=', 1)) NOT IN ('fbclid', 'gclid')), '')"""


@query(f"SELECT page_id, {_KEY} AS key FROM pages")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.search_key(F.col("url")).alias("key"))


@query(f"SELECT min(page_id) AS page_id FROM (SELECT page_id, {_KEY} AS key FROM pages) GROUP BY key")
def url_dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url")
    return snapshots.keep_first(pages, urls.search_key(F.col("url")), F.col("page_id")).select("page_id")


@query(f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1")
def url_host_counts(spark: SparkSession, d: str) -> DataFrame:
    return logs.failures_by(table(spark, d, "pages").select(urls.host(F.col("url")).alias("host")), "host")


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def page_title_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.page_title(F.col("html")).alias("title"))


@query(r"""
WITH p AS (SELECT page_id, length(html) AS size, lower(html) AS low, length(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')) AS n FROM pages)
SELECT page_id, CASE WHEN n >= 1000 THEN 'ok' WHEN regexp_matches(low, 'captcha|cf-challenge|just a moment|checking your browser|attention required') THEN 'challenge' WHEN size < 200 THEN 'empty' ELSE 'partial' END AS verdict FROM p""")
def page_verdict(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.page_verdict(F.col("html"), F.lit(200))["verdict"].alias("verdict"))


_MASK = r"regexp_replace(regexp_replace(text, '(?i)((?:api[_-]?)?key|secret|password|auth|token|mailto|email)=[^&\s]+', '\1=***', 'g'), '(?i)Bearer\s+\S+|[\w.+-]+@[\w-]+\.[\w.]+', '***', 'g')"


@query(f"SELECT doc_id, sha256({_MASK}) AS masked FROM documents")
def secret_mask(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.encode(tx.mask(F.col("text")), "UTF-8"), 256).alias("masked"))


@query(r"SELECT doc_id, length(regexp_replace(text, '\s+', '', 'g')) < 3000 AS thin FROM documents")
def body_floor(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.thin_document(F.col("text")).alias("thin"))


@query(r"SELECT doc_id, rtrim(substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 280)) AS excerpt FROM documents")
def excerpt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.excerpt(F.col("text")).alias("excerpt"))


@query(r"""
WITH t AS (SELECT lang, replace(unnest(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?')), ',', '') AS token FROM documents),
n AS (SELECT token, sum(CASE lang WHEN 'en' THEN 1 ELSE -1 END) AS d FROM t GROUP BY 1)
SELECT token, greatest(d, 0)::BIGINT AS only_left, greatest(-d, 0)::BIGINT AS only_right FROM n WHERE d <> 0""")
def number_token_multiset_diff(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the English documents against those of all others."""
    numbers = table(spark, d, "documents").select("lang", F.explode(tx.number_tokens(F.col("text"))).alias("token"))
    return snapshots.multiset_diff(numbers.where("lang = 'en'"), numbers.where("lang <> 'en'"), "token")


@query("""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents WHERE lang = 'en'), c AS (SELECT word, count(*) AS n FROM w GROUP BY 1),
b AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM benchmark), r AS (SELECT word, count(*) AS n FROM b GROUP BY 1)
SELECT word, (r.n - coalesce(c.n, 0))::BIGINT AS missing FROM r LEFT JOIN c USING (word) WHERE r.n > coalesce(c.n, 0)""")
def multiset_shortfall(spark: SparkSession, d: str) -> DataFrame:
    words = lambda df: df.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    return snapshots.multiset_shortfall(words(table(spark, d, "benchmark")), words(table(spark, d, "documents").where("lang = 'en'")), "word")


@query("""
SELECT item_id, count(*) AS docs FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1""")
def quote_containment(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.operators import spans

    return spans.contained_quotes(table(spark, d, "benchmark").select("item_id", "text"), table(spark, d, "documents").select("doc_id", "text"), "item_id", "doc_id").groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def label_left_coverage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""
SELECT count(*) AS evidence_urls, count(*) FILTER (l.k IS NULL) AS missing_urls, round(count(*) FILTER (l.k IS NULL) / count(*), 4) AS missing_ratio
FROM (SELECT regexp_replace(trim(url), '/+$', '') AS k FROM pages) e LEFT JOIN (SELECT DISTINCT regexp_replace(trim(url), '/+$', '') AS k FROM pages WHERE page_id % 3 <> 0) l USING (k)""")
def evidence_outside_log(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return coverage.sources_outside_log(pages.select(F.col("url").alias("source_url"), F.lit("web").alias("type")), pages.where("page_id % 3 <> 0"))


@query("SELECT 'F' || lpad((max(o_orderkey) + 1)::VARCHAR, greatest(3, length((max(o_orderkey) + 1)::VARCHAR))::INT, '0') AS next_id FROM orders WHERE o_orderkey >= 100")
def next_id(spark: SparkSession, d: str) -> DataFrame:
    return ledger.next_id(table(spark, d, "orders").select(F.concat(F.lit("F"), F.col("o_orderkey").cast("string")).alias("id")), "id")


@query("SELECT doc_id, regexp_replace(lower(source), '[\\s-]+', '', 'g') AS compact, length(text) AS width FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')")
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where(F.col("lang").isin("en", "de", "fr", "es"))
    return t.select("doc_id", tx.compact_key(F.col("source")).alias("compact"), tx.display_width(F.col("text")).cast("bigint").alias("width"))


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def props_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""
WITH t AS (SELECT item_id, unnest(string_split(text, ' ')) AS token, unnest(generate_series(1, len(string_split(text, ' ')))) AS pos FROM benchmark)
SELECT item_id, string_agg(token, ' ' ORDER BY pos) AS abstract FROM t GROUP BY 1""")
def json_inverted_index(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.sources import payloads

    words = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "token"))
    index = words.groupBy("item_id", "token").agg(F.collect_list("pos").alias("at")).groupBy("item_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("token", "at")))).alias("inverted"))
    return index.select("item_id", payloads.abstract_of(F.col("inverted")).alias("abstract"))


@query("SELECT o_orderpriority AS priority, min(o_orderkey) AS first, count(*) AS n FROM orders GROUP BY 1")
def subject_counts(spark: SparkSession, d: str) -> DataFrame:
    return coverage.subject_counts(table(spark, d, "orders"), F.col("o_orderpriority"), "o_orderkey").select(F.col("name").alias("priority"), "first", "n")


@query(f"""
SELECT s AS status, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 4) AS ratio FROM (SELECT {_STATUS} AS s FROM events) GROUP BY 1""")
def replay_summary(spark: SparkSession, d: str) -> DataFrame:
    return logs.replay_summary(table(spark, d, "events").select(_status().alias("status")))


@query("""
WITH p AS (SELECT 'brand' AS kind, p_brand AS fingerprint FROM part UNION ALL SELECT 'type', p_type FROM part)
SELECT kind, fingerprint, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_leads(spark: SparkSession, d: str) -> DataFrame:
    return coverage.duplicate_leads(table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")), "brand", "type")
