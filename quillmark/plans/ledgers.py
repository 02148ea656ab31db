"""Queries of the ledger, its reports and their checks over the tables: orders are facts, their
lines evidence, sentences and drawings are written about them by Spark. The SQL works out from the
tables what the rules must say of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.catalog import table
from quillmark.functions import decode, quantity, semantics, specs, urls
from quillmark.operators import claims, ledger, provenance, reports, rules
from quillmark.sources import markdown

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def _key() -> Column:
    return F.col("o_orderkey")


def _pick(n: Column, *values) -> Column:
    """values[n % len(values)]."""
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _fact(n: Column) -> Column:
    text = n.cast("string")
    return F.concat(F.lit("F"), F.when(F.length(text) >= 3, text).otherwise(F.lpad(text, 3, "0")))


def _price(c: Column) -> Column:
    return c.cast("decimal(14,2)").cast("string")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


def facts(spark: SparkSession, d: str) -> DataFrame:
    """A fact per order: its price in one of three units, its status by the order's."""
    status = F.when(_key() % 10 != 0, F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "disputed").otherwise("draft"))
    return orders(spark, d).select(_fact(_key()).alias("id"), "o_orderkey", status.alias("status"), _price(F.col("o_totalprice")).alias("raw"), _pick(_key(), "USD", "$", "USD (net)", "USD_K", "parsec").alias("unit"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """A sentence per order, of six kinds: with its price and tag, as disputed, with another price
    and the next order's tag, without a tag, as a table row, and with a tag of no fact."""
    own, price = _fact(_key()), _price(F.col("o_totalprice"))
    other = _price(F.col("o_totalprice") + 1)
    text = _pick(
        _key(),
        F.concat(F.lit("Order worth $"), price, F.lit(" ("), own, F.lit(").")),
        F.concat(F.lit("[상충] Order worth $"), price, F.lit(" ("), own, F.lit(").")),
        F.concat(F.lit("It cost $"), other, F.lit(" ("), own, F.lit("), more than ("), _fact(_key() + 1), F.lit(").")),
        F.concat(F.lit("No tag but $"), price, F.lit(" for "), _key().cast("string")),
        F.concat(F.lit("| [상충] row | $"), price, F.lit(" | ["), own, F.lit("] |")),
        F.concat(F.lit("see ("), _fact(_key() + 100000000), F.lit(").")),
    )
    return orders(spark, d).select(_key().alias("sentence_id"), F.when(_key() % 7 == 0, F.concat(text, F.lit(" (partial)"))).otherwise(text).alias("sentence"))


_TAGS = """
WITH o AS (SELECT o_orderkey AS k, o_totalprice AS price, CASE WHEN o_orderkey % 10 <> 0 THEN CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'disputed' ELSE 'draft' END END AS status FROM orders),
t AS (
  SELECT k AS s, k AS f FROM o WHERE k % 6 IN (0, 1, 2, 4) UNION ALL SELECT k, k + 1 FROM o WHERE k % 6 = 2 UNION ALL SELECT k, k + 100000000 FROM o WHERE k % 6 = 5),
j AS (SELECT s, f, 'F' || CASE WHEN f < 1000 THEN lpad(f::VARCHAR, 3, '0') ELSE f::VARCHAR END AS fact_id, o.k IS NOT NULL AS known, status FROM t LEFT JOIN o ON o.k = f)"""


@query(f"""{_TAGS}
SELECT s AS sentence_id, fact_id, CASE WHEN known THEN 'status ' || coalesce(status, 'none') ELSE 'unknown' END AS issue
FROM j WHERE NOT known OR NOT coalesce(status = 'confirmed' OR (status = 'disputed' AND s % 6 IN (1, 4)), FALSE)""")
def tag_issues(spark: SparkSession, d: str) -> DataFrame:
    """Tags of unknown and unconfirmed facts."""
    return claims.tag_issues(sentences(spark, d), facts(spark, d))


@query(f"""{_TAGS}
SELECT k AS sentence_id, CASE WHEN k % 6 IN (0, 1, 2) THEN 'F' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END END AS tag,
       CASE k % 6 WHEN 2 THEN 'mismatch' WHEN 3 THEN 'untagged' WHEN 4 THEN CASE WHEN k % 5 IN (0, 2) THEN 'ok' ELSE 'untagged' END ELSE CASE WHEN k % 5 IN (0, 2) THEN 'ok' ELSE 'mismatch' END END AS state
FROM o WHERE k % 6 <> 5""")
def number_states(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of sentences against the facts they are bound to."""
    return claims.number_states(sentences(spark, d), facts(spark, d)).select("sentence_id", "tag", "state")


@query(f"""{_TAGS}
SELECT k AS sentence_id, 'USD' AS dimension, round(price + CASE WHEN k % 6 = 2 THEN 1 ELSE 0 END, 2) AS low, CASE WHEN k % 6 < 3 THEN k END AS tag FROM o WHERE k % 6 <> 5""")
def number_binding(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and tags of sentences."""
    rows = sentences(spark, d).select("sentence_id", F.explode(quantity.bound_numbers("sentence")).alias("n"))
    return rows.select("sentence_id", "n.dimension", F.round(F.col("n.low").cast("double"), 2).alias("low"), F.regexp_replace("n.tag", "^F0*(?=[0-9])", "").cast("bigint").alias("tag"))


@query(f"""{_TAGS},
good AS (SELECT DISTINCT l_orderkey AS f FROM lineitem WHERE l_returnflag = 'R')
SELECT DISTINCT s AS sentence_id FROM j WHERE s NOT IN (SELECT s FROM j SEMI JOIN good USING (f))""")
def sentences_without_quote(spark: SparkSession, d: str) -> DataFrame:
    """Tagged sentences none of whose facts has a passed quote."""
    lines = table(spark, d, "lineitem")
    name = F.format_string("E%d-%d-%d-%d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    evidence = lines.select(F.concat(name, F.lit("-"), "l_returnflag").alias("id"), _fact(F.col("l_orderkey")).alias("fact_id"))
    passed = lines.where("l_returnflag = 'R'").select(F.concat(name, F.lit("-R")).alias("evidence_id"))
    return claims.sentences_without_quote(sentences(spark, d), evidence, passed)


@query(f"{_TAGS} SELECT s AS sentence_id, fact_id FROM j WHERE known AND f % 4 = 0 AND s % 7 <> 0")
def missing_support_marks(spark: SparkSession, d: str) -> DataFrame:
    """Sentences on partly supported facts without the mark."""
    support = orders(spark, d).select(_fact(_key()).alias("fact_id"), F.when(_key() % 4 == 0, "partial").otherwise("full").alias("support"))
    return claims.missing_support_marks(sentences(spark, d), support)


@query(f"""{_TAGS},
i AS (
  SELECT k, unnest([CASE WHEN k % 5 = 0 THEN 'text changed' END, CASE WHEN k % 13 = 0 THEN 'evidence changed' END, CASE WHEN k % 6 IN (2, 5) THEN 'fact not reviewed' END,
    CASE WHEN k % 6 IN (3, 5) THEN 'fact not in sentence' END, CASE WHEN k % 19 = 0 THEN 'unknown evidence' WHEN k % 17 = 0 THEN 'evidence of another fact' END]) AS issue FROM o WHERE k % 11 <> 0
  UNION ALL SELECT k, 'not reviewed' FROM o WHERE k % 11 = 0 AND k % 6 <> 3
  UNION ALL SELECT -1, 'unknown sentence')
SELECT k AS sentence_id, issue FROM i WHERE issue IS NOT NULL""")
def review_issues(spark: SparkSession, d: str) -> DataFrame:
    """Claim reviews against sentences, facts and evidence."""
    s = sentences(spark, d)
    done = s.where("sentence_id % 11 <> 0")
    k = F.col("sentence_id")
    name = F.concat(F.lit("E"), k.cast("string"))
    reviews = done.select(
        "sentence_id", F.array(_fact(k)).alias("fact_ids"), F.array(name).alias("evidence_ids"),
        F.when(k % 5 == 0, F.lit("x")).otherwise(F.upper(F.sha2(F.encode("sentence", "UTF-8"), 256))).alias("reviewed_text_sha256"), F.when(k % 13 == 0, "old").otherwise("v").alias("evidence_revision"),
    )
    none = F.array().cast("array<string>")
    lost = s.agg(F.min("sentence_id")).select(F.lit(-1).cast("bigint").alias("sentence_id"), none.alias("fact_ids"), none.alias("evidence_ids"), F.lit("x").alias("reviewed_text_sha256"), F.lit("v").alias("evidence_revision"))
    evidence = s.where("sentence_id % 19 <> 0").select(name.alias("id"), F.when(k % 17 == 0, _fact(k + 1)).otherwise(_fact(k)).alias("fact_id"))
    return claims.review_issues(reviews.union(lost), s, facts(spark, d).select("id"), evidence, "v")


@query("""
SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 IN (0, 2) AND o_orderkey % 3 <> 0""")
def high_risk_untagged(spark: SparkSession, d: str) -> DataFrame:
    """High-risk metrics without that risk."""
    rows = orders(spark, d).select(_key().alias("k"), _pick(_key(), "Market Size", "staff", "cagr of sales", "x").alias("metric"), _pick(_key(), F.lit("high"), F.lit("low"), F.lit(None).cast("string")).alias("risk"))
    return claims.high_risk_untagged(rows, ["market size", "cagr"]).select("k")


@query("""
SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 8 IN (1, 3) OR (o_orderkey % 8 = 4 AND o_orderkey % 3 <> 0) OR (o_orderkey % 8 = 6 AND o_orderkey % 3 = 1)""")
def calculation_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Facts whose growth is to be checked."""
    none = F.lit(None).cast("string")
    rows = orders(spark, d).select(
        _key().alias("k"), _pick(_key(), "x", "CAGR 3%", "연평균 3%", "y", "from 2020 → 2025", "in 2020, 2025", "z", "w").alias("claim"), none.alias("raw"), _pick(_key(), "a", "a", "a", "a", "a", "a", "Market size", "a").alias("metric"), none.alias("period"),
        _pick(_key(), "actual", "forecast", "estimate").alias("basis"), F.when(_key() % 8 == 3, _key().cast("string")).alias("base_value"), none.alias("reported_cagr"),
    )
    return claims.calculation_candidates(rows).select("k")


@query("""
WITH o AS (SELECT o_custkey AS chart, 'F' || CASE WHEN o_orderkey < 1000 THEN lpad(o_orderkey::VARCHAR, 3, '0') ELSE o_orderkey::VARCHAR END AS fact_id, o_orderkey AS k FROM orders),
i AS (SELECT chart, fact_id, unnest([CASE WHEN k % 7 = 0 THEN 'unknown fact' WHEN k % 5 = 0 THEN 'value differs' END, CASE WHEN k % 3 = 0 THEN 'not in caption' END]) AS issue FROM o)
SELECT chart, fact_id, issue FROM i WHERE issue IS NOT NULL""")
def sidecar_issues(spark: SparkSession, d: str) -> DataFrame:
    """Drawn values of a chart per customer against ledger and caption."""
    o = orders(spark, d)
    drawn = o.select(F.col("o_custkey").alias("chart"), _fact(_key()).alias("fact_id"), F.when(_key() % 5 == 0, "0").otherwise(_price(F.col("o_totalprice"))).alias("value_raw"), F.lit("USD").alias("unit"))
    known = o.where(_key() % 7 != 0).select(_fact(_key()).alias("id"), _price(F.col("o_totalprice")).alias("raw"), F.lit("USD").alias("unit"))
    caption = F.array_join(F.collect_list(F.when(_key() % 3 != 0, F.concat(F.lit("("), _fact(_key()), F.lit(")")))), " ")
    return claims.sidecar_issues(drawn, known, o.groupBy(F.col("o_custkey").alias("chart")).agg(caption.alias("caption")))


@query("SELECT p_partkey AS key, CASE WHEN p_partkey % 2 > 0 THEN 'orphan' WHEN p_partkey % 3 > 0 THEN 'unresolved' ELSE 'resolved' END AS state FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def decision_states(spark: SparkSession, d: str) -> DataFrame:
    """Tables against decisions."""
    key = table(spark, d, "part").select(F.col("p_partkey").alias("key"))
    return claims.decision_states(key.where("key % 2 = 0"), key.where("key % 3 = 0"))


@query("""
WITH f AS (SELECT lower(n_name) || 'review' AS h, n_nationkey % 4 = 0 AS blank FROM nation WHERE n_nationkey % 2 = 0),
h AS (SELECT n_name, (SELECT max(CASE WHEN blank THEN 0 ELSE 1 END) FROM f WHERE contains(h, replace(lower(n_name), '_', '')) OR contains(replace(h, '_', ''), replace(lower(n_name), '_', ''))) AS m FROM nation)
SELECT '3. ' || n_name AS title, CASE WHEN m IS NULL THEN 'missing' ELSE 'empty' END AS issue FROM h WHERE coalesce(m, 0) = 0""")
def plan_issues(spark: SparkSession, d: str) -> DataFrame:
    """Planned headings against a report's."""
    n = table(spark, d, "nation")
    found = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("## "), "n_name", F.lit(" *review*")).alias("title"), F.when(F.col("n_nationkey") % 4 == 0, " ").otherwise("text").alias("text"))
    return claims.plan_issues(n.select(F.concat(F.lit("3. "), "n_name").alias("title")), found)


@query("SELECT o_orderkey AS line, '## Section ' || o_orderkey % 10 AS title FROM orders WHERE o_orderkey > 500 AND o_orderkey % 10 NOT IN (SELECT r_regionkey FROM region)")
def appendix_issues(spark: SparkSession, d: str) -> DataFrame:
    """Headings after the appendix mark that aren't approved."""
    headings = orders(spark, d).select(_key().alias("line"), F.concat(F.lit("## Section "), (_key() % 10).cast("string")).alias("title"))
    return claims.appendix_issues(headings, 500, table(spark, d, "region").select(F.concat(F.lit("1. section "), F.col("r_regionkey").cast("string")).alias("title")))


@query("""
WITH p AS (SELECT p_partkey AS k, ['assets/', './assets/', '../', 'assets/../'][p_partkey % 4 + 1] || p_partkey || '.svg' AS path FROM part),
i AS (SELECT path, unnest([CASE WHEN k % 3 = 0 THEN 'no file' END, CASE WHEN k % 4 > 1 THEN 'outside assets' END, CASE k % 5 WHEN 0 THEN 'no caption' WHEN 1 THEN 'caption without tag' END, CASE WHEN k % 7 = 0 THEN 'no source' END]) AS issue FROM p)
SELECT path, issue FROM i WHERE issue IS NOT NULL""")
def figure_issues(spark: SparkSession, d: str) -> DataFrame:
    """Figure references."""
    k = F.col("p_partkey")
    path = F.concat(_pick(k, "assets/", "./assets/", "../", "assets/../"), k.cast("string"), F.lit(".svg"))
    figures = table(spark, d, "part").select("p_partkey", path.alias("path"), _pick(k, " ", "plain", "x (F001)", "y [F012]", "(F999)").alias("caption"), F.when(k % 7 > 0, F.lit("s")).alias("source"))
    return claims.figure_issues(figures.select("path", "caption", "source"), figures.where("p_partkey % 3 > 0").select("path"))


@query("""
WITH c AS (SELECT c_custkey AS k FROM customer),
i AS (
  SELECT k, unnest([CASE WHEN (6 + k % 8) * [1.0, 0.75, 0.75][k % 3 + 1] < 9 THEN 'small type' END, CASE WHEN k % 4 = 0 THEN 'no title or description' END,
    CASE k % 5 WHEN 0 THEN 'no fact ids' WHEN 1 THEN 'fact ids differ' END, CASE WHEN k % 6 = 0 THEN 'outside link' END, CASE WHEN k % 7 = 0 THEN 'no Korean font' END, CASE WHEN k % 2 = 0 AND k % 25 > 20 THEN 'too many bars' END]) AS issue FROM c)
SELECT k::VARCHAR AS path, issue FROM i WHERE issue IS NOT NULL""")
def svg_issues(spark: SparkSession, d: str) -> DataFrame:
    """Texts of a drawing per customer (P30): sizes in pt, px and without unit, bars beside a
    background, sidecars with the same or other facts."""
    k = F.col("c_custkey")
    size = F.concat(F.lit("<text font-size='"), (6 + k % 8).cast("string"), _pick(k, "pt", "px", ""), F.lit("'/>"))
    svg = F.concat(
        F.when(k % 5 == 0, "<svg>\n<!-- FACTS: F001 -->").otherwise("<!-- FACTS: F002,F001 --><svg>\n"), F.when(k % 4 == 0, "<title></title><desc>d</desc>").otherwise("<title>t</title><desc>d</desc>"),
        F.when(k % 6 == 0, "<a xlink:href='https://x.org'/>").otherwise("<a href='#x'/>"), F.when(k % 7 == 0, "<g style='font-family: Arial'/>").otherwise("<g style='font-family: Arial, Noto Sans KR'/>"),
        size, F.lit('<rect x="0" width="100%"/>'), F.repeat(F.lit("<rect/>"), (k % 25).cast("int")), F.lit("</svg>"),
    )
    ids = F.when(k % 5 == 1, F.array(F.lit("F001"))).when(k % 5 == 2, F.array(F.lit("F001"), F.lit("F002")))
    return claims.svg_issues(table(spark, d, "customer").select(k.cast("string").alias("path"), svg.alias("svg"), F.when(k % 2 == 1, "line").alias("chart_type"), ids.alias("fact_ids")))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN NULL ELSE c_nationkey END::BIGINT AS place_id FROM customer")
def place_ids(spark: SparkSession, d: str) -> DataFrame:
    """Place names to ids, by folded name or without affixes."""
    n = F.concat(F.lit("Natión "), F.col("c_nationkey").cast("string"), F.lit("x"))
    names = table(spark, d, "customer").select("c_custkey", _pick(F.col("c_custkey"), n, F.concat(F.lit("The "), n), F.concat(n, F.lit(" State")), F.concat(F.lit("No "), n)).alias("name"))
    places = table(spark, d, "nation").select(F.concat(F.lit("nation"), F.col("n_nationkey").cast("string"), F.lit("x")).alias("key"), F.col("n_nationkey").cast("bigint").alias("id"))
    return claims.place_ids(names, places, "name").select("c_custkey", "place_id")


@query(f"""{_TAGS},
e AS (SELECT fact_id, count(*) AS n FROM j GROUP BY 1), h AS (SELECT fact_id, count(*) AS n FROM j WHERE f % 4 > 0 AND s % 3 > 0 GROUP BY 1)
SELECT 'tag' AS kind, fact_id AS token, e.n - coalesce(h.n, 0) AS missing FROM e LEFT JOIN h USING (fact_id) WHERE e.n > coalesce(h.n, 0)
UNION ALL SELECT 'link', 'http://n/' || n_nationkey, 1 FROM nation WHERE n_nationkey % 2 = 1""")
def pdf_expectations(spark: SparkSession, d: str) -> DataFrame:
    """Tags and links that a rendered document lacks."""
    s = sentences(spark, d)
    links = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.concat(F.lit("http://n/"), F.col("n_nationkey").cast("string")).alias("url"))
    report = s.select(F.col("sentence").alias("text")).union(links.select(F.concat(F.lit("[x]("), "url", F.lit(")"))))
    shown = claims.tag_links(s).where("sentence_id % 3 > 0").where(F.regexp_replace("fact_id", "^F", "").cast("bigint") % 4 > 0)
    found = shown.select(F.lit("tag").alias("kind"), F.col("fact_id").alias("token")).union(links.where("n % 2 = 0").select(F.lit("link"), "url"))
    return claims.pdf_expectations(report, found).select("kind", "token", F.col("missing").cast("bigint").alias("missing"))


# the ledger's changes


@query("""
WITH m AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 12 = 0),
c AS (SELECT k, CASE WHEN k % 5 = 0 THEN k - 1 ELSE k END AS claim FROM m),
r AS (SELECT k, claim, concat_ws(', ', CASE WHEN k % 12 = 0 THEN 'id exists' END, CASE WHEN claim % 2 = 0 THEN 'claim exists' END, CASE WHEN count(*) OVER (PARTITION BY claim) > 1 THEN 'claim repeated' END) AS reason FROM c)
SELECT k AS id, claim, nullif(reason, '') AS reason FROM r UNION ALL SELECT o_orderkey, o_orderkey, NULL FROM orders WHERE o_orderkey % 2 = 0""")
def ledger_insert(spark: SparkSession, d: str) -> DataFrame:
    """New facts whose id and claim are new (Z1), and the rejected ones."""
    now = orders(spark, d).where(_key() % 2 == 0).select(_key().alias("id"), _key().alias("claim"))
    more = orders(spark, d).where((_key() % 2 == 1) | (_key() % 12 == 0)).select(_key().alias("id"), F.when(_key() % 5 == 0, _key() - 1).otherwise(_key()).alias("claim"))
    kept, rejected = ledger.insert(now, more, "id", "claim")
    return kept.withColumn("reason", F.lit(None).cast("string")).union(rejected)


@query("""
SELECT c_custkey AS id, 'start' || coalesce(',' || (SELECT string_agg(o_orderpriority, ',' ORDER BY o_orderdate, o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS actions FROM customer""")
def ledger_events(spark: SparkSession, d: str) -> DataFrame:
    """Events appended in the order of their time."""
    none = F.lit(None).cast("string")
    event = lambda by, at, action: F.struct(by.alias("by"), at.alias("at"), action.alias("action"), none.alias("note"), none.alias("reread_sha256"))
    start = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(event(F.lit("w"), F.lit("0"), F.lit("start"))).alias("verify_events"))
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("#"), F.lpad(_key().cast("string"), 12, "0"))
    events = orders(spark, d).select(F.col("o_custkey").alias("fact_id"), event(F.lit("w"), at, F.col("o_orderpriority")).alias("event"))
    return ledger.append_event(start, events).select("id", F.array_join("verify_events.action", ",").alias("actions"))


@query("""
WITH o AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'confirmed' ELSE 'draft' END AS was, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'discarded' ELSE 'disputed' END END AS new FROM orders)
SELECT id, coalesce(new, was) AS status, CASE WHEN was = 'confirmed' AND new IS NOT NULL THEN '2021-01-01' WHEN id % 4 = 0 THEN '2020-01-01' END AS demoted_at,
       CASE WHEN new IS NULL THEN CASE WHEN id % 5 = 0 THEN 'old' END WHEN new = 'discarded' THEN 'wrong' END AS discard_reason FROM o""")
def ledger_status(spark: SparkSession, d: str) -> DataFrame:
    """Status changes (Z3): leaving confirmed is dated, discarding keeps its reason."""
    o = orders(spark, d)
    rows = o.select(_key().alias("id"), F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("draft").alias("status"), F.when(_key() % 4 == 0, "2020-01-01").alias("demoted_at"), F.when(_key() % 5 == 0, "old").alias("discard_reason"))
    changes = o.where(_key() % 3 == 0).select(_key().alias("id"), F.when(_key() % 2 == 0, "discarded").otherwise("disputed").alias("new_status"), F.lit("wrong").alias("reason"))
    return ledger.set_status(rows, changes, "2021-01-01").select("id", "status", "demoted_at", "discard_reason")


@query("""
WITH RECURSIVE n AS (SELECT DISTINCT l_orderkey AS f, l_suppkey % 4 AS g, l_partkey % 5 AS u FROM lineitem),
r AS (SELECT f, g, u, g AS h, u AS v FROM n UNION SELECT r.f, r.g, r.u, n.g, n.u FROM r JOIN n ON n.f = r.f AND (n.g = r.h OR n.u = r.v)),
low AS (SELECT f, g, u, min(h * 10 + v) AS c FROM r GROUP BY ALL)
SELECT f AS fact_id, count(DISTINCT c) AS observers FROM low GROUP BY 1""")
def observer_counts(spark: SparkSession, d: str) -> DataFrame:
    """Independent observers (J25): lines that share a group or an address, also over others."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fact_id"), (F.col("l_suppkey") % 4).cast("string").alias("grp"), (F.col("l_partkey") % 5).cast("string").alias("url"))
    return ledger.observers(rows, "fact_id", ["grp", "url"]).select("fact_id", F.col("observers").cast("bigint").alias("observers"))


@query("""
SELECT p_partkey, 'v4:' || sha256('["' || p_name || '","' || p_brand || '",null,"KR","' || p_size || '",' || CASE WHEN p_partkey % 2 = 0 THEN 'null' ELSE '""' END || ',null,"d|x"]') AS v4,
       p_name || '|' || p_brand || '|KR|' || p_size || '|na|na' AS v3 FROM part""")
def claim_keys(spark: SparkSession, d: str) -> DataFrame:
    """Claim keys, new and old."""
    none = F.lit(None).cast("string")
    values = [F.col("p_name"), F.col("p_brand"), none, F.lit("KR"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 1, ""), none, F.lit("d|x")]
    context = F.struct(*[v.alias(f) for v, f in zip(values, ledger.KEY_FIELDS, strict=True)])
    return table(spark, d, "part").select("p_partkey", context.alias("c")).select("p_partkey", ledger.claim_key(F.col("c")).alias("v4"), ledger.old_claim_key(F.col("c")).alias("v3"))


@query("""
SELECT o_custkey AS receipt_id, o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'current' ELSE 'appeared' END WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE 'current' END AS state FROM orders""")
def reference_states(spark: SparkSession, d: str) -> DataFrame:
    """Files that receipts refer to."""
    sha = F.sha2(_key().cast("string"), 256)
    recorded = F.when(_key() % 7 == 0, F.lit("MISSING")).when(_key() % 3 == 0, F.lit("aa")).otherwise(F.upper(sha))
    refs = orders(spark, d).select(F.col("o_custkey").alias("receipt_id"), _key().alias("path"), recorded.alias("sha256"))
    return provenance.reference_states(refs, orders(spark, d).where(_key() % 5 > 0).select(_key().alias("path"), sha.alias("sha256"))).select("receipt_id", "path", "state")


@query("""
WITH g AS (SELECT event_type AS gate, max(event_id) AS id, row_number() OVER (ORDER BY event_type) AS at FROM events GROUP BY 1),
o AS (
  SELECT g.gate, g.id, g.at, p.gate AS need, p.id AS now, (SELECT max(event_id) FROM events e WHERE e.event_type = p.gate AND e.event_id < g.id) AS had, (SELECT value FROM events WHERE event_id = g.id) > 5 AS failed, g.id % 3 = 0 AS changed
  FROM g LEFT JOIN g p ON p.at = g.at - 1)
SELECT gate, id AS receipt_id, failed, changed, need IS NOT NULL AND had IS DISTINCT FROM now AS stale FROM o""")
def receipt_currency(spark: SparkSession, d: str) -> DataFrame:
    """The latest receipt of each gate: failed, a file changed, or the gate before has a newer one
    (Z6, J20)."""
    e = table(spark, d, "events").select("event_type", "event_id", "value")
    gates = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # the stream's few kinds
    before = F.create_map(*[F.lit(x) for a, b in zip(gates[1:], gates, strict=False) for x in (a, b)])
    last = e.groupBy("event_type").agg(F.max("event_id").alias("event_id"))
    need = last.select(before[F.col("event_type")].alias("need"), F.col("event_id").alias("_at"), F.col("event_type").alias("_of")).where("need is not null")
    had = e.join(need, (F.col("need") == F.col("event_type")) & (F.col("event_id") < F.col("_at"))).groupBy("_of", "need").agg(F.max("event_id").cast("string").alias("had"))
    had = had.select(F.col("_of").alias("event_type"), F.create_map("need", "had").alias("prerequisite_receipts"))
    receipts = e.join(last.select("event_id"), "event_id", "left_semi").join(had, "event_type", "left").select(F.col("event_type").alias("gate"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("receipt_id"), (F.col("value") > 5).cast("int").alias("exit"), "prerequisite_receipts")
    older = e.select(F.col("event_type").alias("gate"), (F.col("event_id") - 1).alias("seq"), F.lit("old").alias("receipt_id"), F.lit(1).alias("exit"), F.lit(None).cast("map<string,string>").alias("prerequisite_receipts"))
    states = receipts.select("receipt_id", F.when(F.col("seq") % 3 == 0, "changed").otherwise("current").alias("state"))
    out = provenance.receipt_issues(receipts.union(older), states, gates)
    has = lambda text: F.exists("issues", lambda x: x.startswith(text))
    return out.select("gate", F.col("receipt_id").cast("bigint").alias("receipt_id"), has("failed").alias("failed"), has("ref_changed").alias("changed"), has("prerequisite_").alias("stale"))


_FACT_SCHEMA = {
    "required": ["id", "claim", "status"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "pattern": r"F\d{3,}"},
        "claim": {"type": "string"},
        "status": {"type": "string", "enum_ref": "status"},
        "schema_version": {"type": "integer"},
        "context": {"type": "object", "required": ["metric"], "properties": {"metric": {"type": "string"}, "year": {"type": "integer"}}},
    },
}


@query("""
WITH i AS (
  SELECT o_orderkey AS k, unnest([CASE WHEN o_orderkey < 100 THEN 'id: pattern' END, CASE WHEN o_orderkey % 3 = 0 THEN 'claim: required' END, CASE WHEN o_orderstatus = 'P' THEN 'status: enum' END, CASE WHEN o_orderkey % 5 = 0 THEN 'schema_version: type' END,
    CASE WHEN o_orderkey % 7 = 0 THEN 'unknown field' END, CASE WHEN o_orderkey % 11 = 0 THEN 'context.metric: required' END]) AS rule FROM orders)
SELECT k, rule FROM i WHERE rule IS NOT NULL""")
def ledger_rule_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rules of a schema over JSON facts."""
    extra = F.when(_key() % 7 == 0, F.lit(1))
    context = F.struct(F.when(_key() % 11 != 0, F.lit("price")).alias("metric"), F.year("o_orderdate").alias("year"))
    plain = F.struct(F.concat(F.lit("F"), _key().cast("string")).alias("id"), F.when(_key() % 3 != 0, F.lit("c")).alias("claim"), F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "draft").otherwise("sure").alias("status"), F.lit(4).alias("schema_version"), context.alias("context"), extra.alias("extra"))
    raw = F.when(_key() % 5 == 0, F.replace(F.to_json(plain), F.lit('"schema_version":4'), F.lit('"schema_version":true'))).otherwise(F.to_json(plain))
    rows = orders(spark, d).select(_key().alias("k"), raw.alias("raw"), F.concat(F.lit("F"), _key().cast("string")).alias("id"))
    return rules.violations(rows, rules.compile_rules(F.col("raw"), _FACT_SCHEMA, {"status": ["draft", "confirmed", "disputed", "discarded"]}), "k")


# texts, numbers and addresses


@query("""
WITH n AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT k, 1 + 2 * n AS segments FROM n""")
def sentence_segments(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of a report per customer, without its appendix."""
    one = F.concat(F.lit("Order "), _key().cast("string"), F.lit(" cost $"), _price(F.col("o_totalprice")), F.lit(" (F001). It (a. b.) went...\nwell.[F002]"))
    texts = orders(spark, d).groupBy(F.col("o_custkey").alias("k")).agg(F.concat(F.lit("# Report\n"), F.array_join(F.collect_list(one), "\n\n"), F.lit("\n\n<!-- FACTSHEET:APPENDIX -->\n## Appendix\nNot this. Nor this.")).alias("text"))
    return texts.select("k", F.size(markdown.segments(markdown.body(F.col("text")))).cast("bigint").alias("segments"))


@query("""
WITH u AS (
  SELECT l_orderkey, ['USD', 'EUR', 'KRW'][l_linenumber % 3 + 1] AS c, ['', '_million', ' billion', '_B', '_x', ' (net)', '_mn'][l_partkey % 7 + 1] AS s, ['', '억', '백만 '][l_suppkey % 3 + 1] AS p FROM lineitem)
SELECT DISTINCT p || c || s AS unit,
  CASE WHEN p = '' THEN CASE WHEN s = '_x' THEN 'UNSUPPORTED' ELSE c END WHEN p LIKE '백만%' OR s IN ('_million', ' billion') THEN c ELSE c END AS dimension,
  CASE WHEN p = '' THEN CASE s WHEN '_million' THEN 6 WHEN ' billion' THEN 9 WHEN '_B' THEN 9 WHEN '_mn' THEN 6 ELSE 0 END WHEN s = '_million' THEN 6 WHEN s = ' billion' THEN 9 WHEN p LIKE '백만%' THEN 6 ELSE 0 END AS power
FROM u""")
def unit_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Units written in many ways."""
    lines = table(spark, d, "lineitem")
    unit = F.concat(_pick(F.col("l_suppkey"), "", "억", "백만 "), _pick(F.col("l_linenumber"), "USD", "EUR", "KRW"), _pick(F.col("l_partkey"), "", "_million", " billion", "_B", "_x", " (net)", "_mn"))
    return lines.select(unit.alias("unit")).distinct().select("unit", quantity.unit_of("unit").alias("u")).select("unit", "u.dimension", F.col("u.power").alias("power"))


@query("""
SELECT event_id, event_id % 8 NOT IN (0, 3) AS bad FROM events""")
def url_safety(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that must not be asked for."""
    k, n = F.col("event_id"), F.col("user_id").cast("string")
    host = _pick(k, "http://example.org/", "http://10.0.0.1/", "http://[fe80::1]:80/", "http://8.8.8.8/", "ftp://a.org/", "http://u@a.org/", "https://localhost/", "http://[::ffff:127.0.0.1]/")
    return table(spark, d, "events").select("event_id", urls.unsafe(F.concat(host, n)).alias("bad"))


@query("SELECT event_id, event_id % 6 IN (1, 4) AS other FROM events")
def redirects(spark: SparkSession, d: str) -> DataFrame:
    """Requests that ended at another document."""
    k, n = F.col("event_id"), F.col("user_id").cast("string")
    asked = _pick(k, "http://a.org/x", "http://a.org/x", "http://a.org/", "http://a.org/x?utm_source=q&id=", "http://a.org/x?id=1", "http://a.org/x")
    requested = F.when(k % 6 == 3, F.concat(asked, n)).otherwise(asked)
    final = _pick(k, F.lit("https://www.a.org/x/"), F.concat(F.lit("http://a.org/y"), n), F.lit("http://a.org/welcome"), F.concat(F.lit("http://m.a.org/x?id="), n), F.lit("http://a.org/x?id=2"), F.lit(None).cast("string"))
    return table(spark, d, "events").select("event_id", urls.redirected_elsewhere(requested, final).alias("other"))


@query("""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'utf-8' WHEN 2 THEN 'utf-16be' WHEN 3 THEN 'latin-1' END AS header, CASE page_id % 4 WHEN 1 THEN 'iso-8859-1' END AS meta, md5(t) AS text FROM (SELECT page_id, CASE page_id % 4 WHEN 1 THEN '<meta charset=iso-8859-1>' WHEN 2 THEN '<meta http-equiv=''Content-Type'' content=''text/html; charset=utf-16be''>' ELSE '' END || regexp_replace(html, '[^\\x00-\\x7F\\xA0-\\xFF]|charset="utf-8"', '', 'g') AS t FROM pages)""")
def page_decoding(spark: SparkSession, d: str) -> DataFrame:
    """Character sets of all pages by header and meta element, and the texts (F16)."""
    k = F.col("page_id")
    html = F.regexp_replace("html", r'[^\x00-\x7F\xA0-\xFF]|charset="utf-8"', "")
    meta = F.when(k % 4 == 1, "<meta charset=iso-8859-1>").when(k % 4 == 2, "<meta http-equiv='Content-Type' content='text/html; charset=utf-16be'>").otherwise("")
    text = F.concat(meta, html)
    raw = F.when(k % 4 == 0, F.encode(text, "UTF-8")).when(k % 4 == 2, F.encode(text, "UTF-16BE")).otherwise(F.encode(text, "ISO-8859-1"))
    # a page in UTF-16 can't be read for its meta element, so its header names the character set
    header = _pick(k, 'text/html; Charset="utf-8"', "text/html", "text/html; charset=utf-16be", "text/html; charset='latin-1'")
    rows = table(spark, d, "pages").select("page_id", raw.alias("raw"), header.alias("type"))
    return rows.select("page_id", decode.header_charset(F.col("type")).alias("header"), decode.meta_charset(F.col("raw")).alias("meta"), F.md5(decode.page_text(F.col("raw"), F.col("type"))).alias("text"))


@query("""
WITH n AS (SELECT o_orderkey AS k, floor(o_totalprice)::BIGINT AS v FROM orders)
SELECT k, CASE WHEN k % 2 = 0 THEN CASE WHEN v >= 1000 THEN v || '|' || format('{:,}', v) ELSE v::VARCHAR END ELSE CASE WHEN v >= 1000 THEN format('{:,}', v) || '|' || v ELSE v::VARCHAR END END AS variants, k % 3 = 0 AS inside FROM n""")
def number_forms(spark: SparkSession, d: str) -> DataFrame:
    """How a number may be written, and whether a text has it by itself."""
    v = F.floor("o_totalprice")
    number = F.when(_key() % 2 == 0, v.cast("string")).otherwise(F.format_number(v, 0))
    text = F.concat(_pick(_key(), "about ", "2", "1."), number, F.lit("% of 7"))
    rows = orders(spark, d).select(_key().alias("k"), number.alias("n"), text.alias("t"))
    return rows.select("k", F.array_join(reports.number_variants(F.col("n")), "|").alias("variants"), reports.standalone(F.col("t"), F.col("n")).alias("inside"))


# reports and tables


@query("""
WITH c AS (SELECT c_custkey AS k FROM customer),
i AS (SELECT k, unnest([CASE WHEN k % 5 = 1 THEN 'another report' END, CASE WHEN k % 3 = 2 THEN 'several appendix marks' END, CASE WHEN k % 4 = 0 THEN 'empty body' END]) AS issue FROM c)
SELECT k::VARCHAR AS report, issue FROM i WHERE issue IS NOT NULL""")
def report_issues(spark: SparkSession, d: str) -> DataFrame:
    """Whole-report checks."""
    k = F.col("c_custkey")
    text = F.concat(F.when(k % 4 == 0, " \n").otherwise(F.concat("c_name", F.lit("\n"))), F.repeat(F.lit("<!--  FACTSHEET:APPENDIX -->\nmore\n"), (k % 3).cast("int")))
    return reports.report_issues(table(spark, d, "customer").select(k.cast("string").alias("report"), text.alias("text"), _pick(k, k.cast("string"), F.lit("x"), F.lit(None).cast("string"), k.cast("string"), k.cast("string")).alias("canonical")))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 < 2 AND o_orderkey % 3 > 0")
def conversion_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Dollar amounts without a decimal to check by."""
    rows = orders(spark, d).select(_key().alias("id"), _pick(_key(), F.lit("USD_M"), F.lit("$ million"), F.lit("KRW"), F.lit(None).cast("string")).alias("unit"), _pick(_key(), F.lit("1.5"), F.lit(""), F.lit(None).cast("string")).alias("decimal"))
    return reports.conversion_warnings(rows)


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS confirmed FROM orders),
i AS (
  SELECT k, unnest([CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN ['failure', 'inputs not recorded'] END,
    CASE k % 4 WHEN 1 THEN [CASE WHEN confirmed THEN 'failure' ELSE 'warning' END, 'rate differs'] WHEN 2 THEN ['failure', CASE WHEN k % 5 = 0 THEN 'bad years' ELSE 'invalid input' END] WHEN 3 THEN ['warning', CASE WHEN k % 5 = 0 THEN 'bad years' ELSE 'not checkable' END] END]) AS f FROM o)
SELECT f[1] AS level, k AS id, f[2] AS message FROM i WHERE f IS NOT NULL""")
def calculation_report(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the calculation audit (K9), strict."""
    rows = orders(spark, d).select(
        _key().alias("id"), F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("draft").alias("status"), F.when(_key() % 3 == 0, "high").alias("risk"), (_key() % 2 == 1).alias("atomic"), _pick(_key(), "MATCH", "CONFLICT", "INVALID_INPUT", "NOT_CHECKABLE").alias("result"), F.when(_key() % 5 == 0, "bad years").alias("reason"),
    )
    return reports.calculation_report(rows, strict=True)


@query("""
SELECT p_partkey, 'a binaryItemIDRef="image' || [4, 2, 1, 10][p_partkey % 4 + 1] || '" image' || p_partkey % 4 || ' binaryItemIDRef="image1' || p_partkey || '"' AS text FROM part""")
def remapped_images(spark: SparkSession, d: str) -> DataFrame:
    """New numbers of image references, all at once."""
    k = F.col("p_partkey")
    text = F.concat(F.lit('a binaryItemIDRef="image'), F.when(k % 4 == 0, "4").otherwise((k % 4).cast("string")), F.lit('" image'), (k % 4).cast("string"), F.lit(' binaryItemIDRef="image1'), k.cast("string"), F.lit('"'))
    # 10 and more stay, as no pair names them
    return table(spark, d, "part").select("p_partkey", reports.remapped(text, {1: 2, 2: 1, 3: 10}).alias("text"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand || ' | n / ' || substr(p_name || ' and more of it', 1, 20) ELSE p_type END AS key FROM part""")
def table_keys(spark: SparkSession, d: str) -> DataFrame:
    """Names of tables by caption, else by content."""
    k = F.col("p_partkey")
    before = F.when(k % 3 == 0, F.array(F.lit("text"), F.concat(F.lit("<표> 표 "), k.cast("string"), F.lit(". "), "p_name", F.lit(" {형식=A}")), F.lit(""))).when(k % 3 == 1, F.array(F.lit("표 1. gone"), F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.concat(F.lit("**[표 1] "), "p_type", F.lit("**")), F.lit("lead in"), F.lit("")))
    return table(spark, d, "part").select("p_partkey", reports.table_key(before, F.array("p_brand", F.lit("n")), F.array("p_name", F.lit("and more of it"))).alias("key"))


@query("""
WITH t AS (SELECT o_custkey AS doc, o_orderkey AS s, o_orderkey + 5 AS e FROM orders WHERE o_orderkey % 2 = 0), f AS (SELECT o_custkey AS doc, o_orderkey AS l FROM orders WHERE o_orderkey % 3 = 0)
SELECT t.doc, s AS start, EXISTS (SELECT 1 FROM f WHERE f.doc = t.doc AND l BETWEEN s - 8 AND e + 8) AS nearby FROM t""")
def figures_nearby(spark: SparkSession, d: str) -> DataFrame:
    """Figures within eight lines of a table (Z21), a document per customer."""
    tables = orders(spark, d).where(_key() % 2 == 0).select(F.col("o_custkey").alias("doc"), _key().alias("start"), (_key() + 5).alias("end"))
    lines = orders(spark, d).select(F.col("o_custkey").alias("doc"), _key().alias("line"), F.when(_key() % 3 == 0, "see ![x](y)").otherwise("no").alias("text"))
    return reports.figure_nearby(tables, lines).select("doc", "start", "nearby")


@query("""
WITH i AS (SELECT p_partkey AS k, 'w/' || p_brand AS folder, ['x', 'sub/x', 'w/x'][p_partkey % 3 + 1] || p_partkey || '.png' AS file FROM part)
SELECT k, folder, file, CASE k % 3 WHEN 2 THEN file ELSE folder || '/x' || k || '.png' END AS path FROM i WHERE k % 5 > 0""")
def image_index(spark: SparkSession, d: str) -> DataFrame:
    """Image records of an index per brand and the files they stand for."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    none = F.lit(None).cast("string")
    file = F.concat(_pick(k, "x", "sub/x", "w/x"), k.cast("string"), F.lit(".png"))
    item = F.struct(file.alias("file"), F.lit("s").alias("source"), none.alias("url"), none.alias("page"), none.alias("license"), none.alias("accessed_at"), k.cast("string").alias("at"))
    folder = F.concat(F.lit("w/"), "p_brand")
    lists = p.groupBy(folder.alias("folder")).agg(F.collect_list(F.when(k % 2 == 0, item)).alias("figures"), F.collect_list(F.when(k % 2 == 1, item)).alias("images"))
    empty = F.array().cast(lists.schema["figures"].dataType)
    index = lists.select("folder", F.lit("S").alias("source"), F.lit("L").alias("license"), none.alias("accessed_at"), F.lit("2020").alias("at"), "figures", "images", empty.alias("files"), empty.alias("candidates"))
    files = p.where(k % 5 > 0).select(F.when(k % 3 == 2, file).otherwise(F.concat(folder, F.lit("/x"), k.cast("string"), F.lit(".png"))).alias("path"))
    found = reports.located_images(reports.image_records(index), files)
    return found.select(F.regexp_extract("file", r"x(\d+)\.png", 1).cast("bigint").alias("k"), "folder", "file", "path")


# requests for charts


@query("""
WITH p AS (SELECT p_partkey AS k FROM part),
i AS (SELECT k, unnest([CASE k % 4 WHEN 0 THEN 'no facts' WHEN 1 THEN 'fact twice' END, CASE WHEN k % 5 IN (1, 2, 4) THEN 'outside assets' END, CASE WHEN k % 3 = 0 AND k % 5 < 4 THEN 'not svg' WHEN k % 5 = 4 THEN NULL END]) AS issue FROM p)
SELECT k, issue FROM i WHERE issue IS NOT NULL""")
def chart_arguments(spark: SparkSession, d: str) -> DataFrame:
    """Fact lists and output places of chart requests."""
    k = F.col("p_partkey")
    name = k.cast("string")
    ids = _pick(k, F.lit(" , "), F.concat(F.lit("F"), name, F.lit(", F"), name), F.concat(F.lit("F"), name), F.concat(F.lit("F"), name, F.lit(",F0")))
    ending = F.when(k % 3 == 0, ".png").otherwise(".svg")
    target = _pick(k, F.concat(F.lit("assets/x/../"), name, ending), F.concat(F.lit("../assets/"), name, ending), F.concat(F.lit("assets/../"), name, ending), F.concat(F.lit("./assets/"), name, ending), F.concat(name, F.lit(".svg")))
    return table(spark, d, "part").select(k.alias("k"), F.explode(specs.argument_issues(ids, target)).alias("issue"))


@query("""
WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, l_extendedprice AS p FROM lineitem)
SELECT k, n, '{"q":' || q::BIGINT || ',"p":' || CASE WHEN p = floor(p) THEN p::BIGINT::VARCHAR ELSE p::VARCHAR END || CASE WHEN n % 2 = 0 THEN ',"even":{"half":' || CASE WHEN n % 4 = 0 THEN (n // 2)::VARCHAR ELSE (n / 2.0)::DOUBLE::BIGINT::VARCHAR END || '}' ELSE '' END || ',"t":"7.0 of ' || n || '.0"}' AS spec FROM l""")
def chart_specs(spark: SparkSession, d: str) -> DataFrame:
    """Specifications with whole numbers as integers and without empty fields."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p")).distinct()
    even = F.when(F.col("n") % 2 == 0, F.struct((F.col("n") / 2).alias("half")))
    return lines.select("k", "n", specs.spec(F.col("q"), F.col("p"), even.alias("even"), F.concat(F.lit("7.0 of "), F.col("n").cast("string"), F.lit(".0")).alias("t")).alias("spec"))


@query("""
SELECT c_custkey, 'research_' || CASE WHEN c_custkey % 3 = 0 THEN 'untitled' ELSE rtrim(substr(c_mktsegment || '_of_' || c_name || '_and_much_more_of_it', 1, 40), '_') END || '_2024010' || (1 + c_custkey % 9) AS x FROM customer""")
def work_folders(spark: SparkSession, d: str) -> DataFrame:
    """Names of work folders by topic and day."""
    k = F.col("c_custkey")
    topic = F.when(k % 3 == 0, " ?: ").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit("?  of\t"), "c_name", F.lit(": and much more of it")))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 9).cast("int"))
    return table(spark, d, "customer").select("c_custkey", specs.work_folder(topic, day).alias("x"))


@query("""
SELECT k, CASE k % 5 WHEN 0 THEN 'TON' WHEN 1 THEN 'EUR' WHEN 2 THEN '대' WHEN 3 THEN 'USD' ELSE 'PCT' END AS dimension,
       CASE k % 5 WHEN 0 THEN k WHEN 1 THEN k * 1e9 WHEN 2 THEN k * 1e4 WHEN 3 THEN (-5 - k) * 1e6 ELSE k + 0.5 END::DOUBLE AS low,
       CASE k % 5 WHEN 0 THEN k + 2 WHEN 1 THEN (k + 5) * 1e9 WHEN 2 THEN k * 1e4 WHEN 3 THEN (-5 + k) * 1e6 ELSE k + 0.5 END::DOUBLE AS high, CASE k % 5 WHEN 1 THEN 'F005' WHEN 4 THEN 'F003' END AS tag
FROM (SELECT o_orderkey AS k FROM orders)""")
def number_cases(spark: SparkSession, d: str) -> DataFrame:
    """Ranges, errors, scales, signs and units of numbers, and their tags."""
    k = _key().cast("string")
    text = _pick(
        _key(), F.concat((_key() + 1).cast("string"), F.lit("±1 톤")), F.concat(F.lit("€"), k, F.lit("-"), (_key() + 5).cast("string"), F.lit("bn (F005)")), F.concat(F.lit("3 대 of "), k, F.lit("만대")),
        F.concat(F.lit("-$5±"), k, F.lit(" million")), F.concat(F.lit("[F003] rose "), k, F.lit(".5%")),
    )
    rows = orders(spark, d).select(_key().alias("k"), F.explode(quantity.bound_numbers(text)).alias("n"))
    return rows.select("k", "n.dimension", F.col("n.low").cast("double").alias("low"), F.col("n.high").cast("double").alias("high"), "n.tag")


@query("""
WITH u AS (SELECT DISTINCT p_partkey % 15 AS k FROM part)
SELECT ['MW', 'mW', 'kt', 'KT', 't', 'million', '%', 'parsec', 'MW (net)', 'USD_B', 'EUR million', '백만 EUR', '억원', 'USD_X', ''][k + 1] AS unit,
       ['W', 'W', 'TON', NULL, 'TON', 'N', 'PCT', NULL, 'W', 'USD', 'EUR', 'EUR', 'KRW', 'UNSUPPORTED', NULL][k + 1] AS dimension, [6, -3, 3, 0, 0, 6, 0, 0, 6, 9, 6, 6, 8, 0, 0][k + 1] AS power FROM u""")
def unit_table(spark: SparkSession, d: str) -> DataFrame:
    """Units (F18): physical ones are told by case, endings of currencies must be known."""
    names = ["MW", "mW", "kt", "KT", "t", "million", "%", "parsec", "MW (net)", "USD_B", "EUR million", "백만 EUR", "억원", "USD_X", ""]
    units = table(spark, d, "part").select(_pick(F.col("p_partkey"), *names).alias("unit")).distinct()
    return units.select("unit", quantity.unit_of("unit").alias("u")).select("unit", "u.dimension", F.col("u.power").alias("power"))


@query("""
WITH o AS (SELECT o_custkey AS t, o_orderkey::VARCHAR AS a, o_orderpriority || ' at ' || CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR) AS b FROM orders),
m AS (SELECT t, max(length(a)) AS a, max(length(b)) AS b, max(list_max(list_transform(string_split(b, ' '), lambda w: length(w)))) AS w FROM o GROUP BY 1),
n AS (SELECT t, greatest(a, 4) AS n0, least(CASE WHEN greatest(b, 8) <= 16 THEN greatest(b, 8) ELSE greatest(w, 8) END, 50) AS n1, greatest(least(a, 40), 4) AS p0, greatest(least(b, 40), 8) AS p1 FROM m),
w AS (SELECT t, n0 + (100 - n0 - n1) * p0 // (p0 + p1) AS w0 FROM n)
SELECT t, 0::BIGINT AS "column", w0::BIGINT AS width FROM w UNION ALL SELECT t, 1, 100 - w0 FROM w""")
def column_widths(spark: SparkSession, d: str) -> DataFrame:
    """Widths of the columns of a table per customer."""
    text = F.concat("o_orderpriority", F.lit(" at "), _price(F.col("o_totalprice")))
    rows = orders(spark, d).select(F.col("o_custkey").alias("t"), (_key() + 1).alias("row"), F.array(_key().cast("string"), text).alias("cells"))
    heads = rows.select("t").distinct().select("t", F.lit(0).cast("bigint").alias("row"), F.array(F.lit("item"), F.lit("priority")).alias("cells"))
    return reports.column_widths(heads.union(rows), ["t"], "cells", 100).select("t", F.col("column").cast("bigint").alias("column"), "width")


@query("""
SELECT 'p_partkey' AS "column", 'Quantity' AS semantic, 'quantitative' AS type, 'sum' AS aggregate, min(p_partkey)::DOUBLE AS lo, max(p_partkey)::DOUBLE AS hi FROM part
UNION ALL SELECT 'p_size', 'Quantity', 'quantitative', 'sum', min(p_size), max(p_size) FROM part UNION ALL SELECT 'p_retailprice', 'Quantity', 'quantitative', 'sum', min(p_retailprice), max(p_retailprice) FROM part
UNION ALL SELECT unnest(['p_name', 'p_brand', 'p_type']), 'Category', 'nominal', NULL, NULL, NULL""")
def field_semantics(spark: SparkSession, d: str) -> DataFrame:
    """What the columns of a table are, from one aggregation over it."""
    return semantics.field_semantics(table(spark, d, "part")).select("column", "semantic", "type", "aggregate", "lo", "hi")
