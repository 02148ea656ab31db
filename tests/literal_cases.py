"""Literal cases of rules with the rows that the rules demand."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import decode, quantity, urls
from quillmark.functions import semantics
from quillmark.operators import claims, ledger, provenance, reports, rules
from quillmark.sources import markdown

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _literal(v) -> str:
    if v is None:
        return "CAST(NULL AS VARCHAR)"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, int):
        return f"CAST({v} AS BIGINT)"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return "'" + v.replace("'", "''") + "'"


def expected(columns: str, *rows: tuple) -> str:
    """SQL of a literal table."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({columns})"


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def _rows(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


# sentences against the ledger


def _sentences(spark: SparkSession) -> DataFrame:
    return _rows(
        spark, "sentence_id long, sentence string",
        (1, "It has 20 MW (F001) and 30 MW."), (2, "[상충] it is 5% (F002)"), (3, "Cost $4 million (F003), F009 (F009)"), (4, "about 21 MW (F001)"), (5, "| [상충] x | 5% | [F002] |"), (6, "between 10~20 톤 (F005)"), (7, "sold 5 parsec (F004)"), (8, "no number, no tag"),
    )


def _facts(spark: SparkSession) -> DataFrame:
    return _rows(spark, "id string, status string, raw string, unit string", ("F001", "confirmed", "20", "MW"), ("F002", "disputed", "5", "%"), ("F003", "draft", "4", "USD_million"), ("F004", None, "5", "parsec"), ("F005", "confirmed", "15±5", "톤"))


@query(expected("sentence_id, fact_id, issue", (3, "F003", "status draft"), (3, "F009", "unknown"), (7, "F004", "status none")))
def tag_issues(spark: SparkSession, d: str) -> DataFrame:
    """Tags of unknown and unconfirmed facts (J4); a marked disputed fact is fine, also in a table row."""
    return claims.tag_issues(_sentences(spark), _facts(spark))


@query(expected("sentence_id, tag, state", (1, "F001", "ok"), (1, None, "untagged"), (2, "F002", "ok"), (3, "F003", "ok"), (4, "F001", "mismatch"), (5, None, "ok"), (6, "F005", "ok")))
def number_states(spark: SparkSession, d: str) -> DataFrame:
    """Numbers against the facts they are bound to (J5, J6): a cell bar keeps a number from a tag, so
    that of a table row is compared with all tags of its row."""
    return claims.number_states(_sentences(spark), _facts(spark)).select("sentence_id", "tag", "state")


@query(expected("sentence_id", (2,), (3,), (5,), (6,), (7,)))
def sentences_without_quote(spark: SparkSession, d: str) -> DataFrame:
    """Tagged sentences none of whose facts has a passed quote."""
    evidence = _rows(spark, "id string, fact_id string", ("E1", "F001"), ("E2", "F002"))
    return claims.sentences_without_quote(_sentences(spark), evidence, _rows(spark, "evidence_id string", ("E1",), ("E9",)))


@query(expected("sentence_id, fact_id", (4, "F001")))
def missing_support_marks(spark: SparkSession, d: str) -> DataFrame:
    """Sentences on partly supported facts without the mark."""
    s = _rows(spark, "sentence_id long, sentence string", (1, "a (F001) (partial)"), (2, "b (F002)"), (3, "c [F001] (부분 근거)"), (4, "d (F001)"))
    return claims.missing_support_marks(s, _rows(spark, "fact_id string, support string", ("F001", "partial"), ("F002", "full")))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@query(expected("sentence_id, issue", ("S9", "unknown sentence"), ("S9", "evidence changed"), ("S9", "unknown evidence"), ("S2", "not reviewed"), ("S4", "text changed"), ("S4", "fact not in sentence"), ("S4", "unknown fact"), ("S4", "evidence of another fact")))
def review_issues(spark: SparkSession, d: str) -> DataFrame:
    """Claim reviews against sentences, facts and evidence."""
    s = _rows(spark, "sentence_id string, sentence string", ("S1", "a (F001)"), ("S2", "b (F002)"), ("S3", "c"), ("S4", "d (F002) now"))
    reviews = _rows(
        spark, "sentence_id string, fact_ids array<string>, evidence_ids array<string>, reviewed_text_sha256 string, evidence_revision string",
        ("S1", ["F001"], ["E1"], _sha("a (F001)").upper(), "v"), ("S4", ["F002", "F008"], ["E1"], _sha("d (F002)"), "v"), ("S9", ["F001"], ["E9"], "x", "old"),
    )
    facts, evidence = _rows(spark, "id string", ("F001",), ("F002",)), _rows(spark, "id string, fact_id string", ("E1", "F001"))
    return claims.review_issues(reviews, s, facts, evidence, "v")


@query(expected("id", ("F2",), ("F4",)))
def high_risk_untagged(spark: SparkSession, d: str) -> DataFrame:
    """High-risk metrics without that risk."""
    facts = _rows(spark, "id string, metric string, risk string", ("F1", "Market Size", "high"), ("F2", "market size", "low"), ("F3", "staff", None), ("F4", "cagr of sales", None))
    return claims.high_risk_untagged(facts, ["market size", "cagr"]).select("id")


@query(expected("id", ("F1",), ("F2",), ("F3",), ("F4",), ("F7",), ("F9",)))
def calculation_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Facts whose growth can be recomputed."""
    facts = _rows(
        spark, "id string, metric string, claim string, raw string, period string, basis string, base_value string, forecast_value string",
        ("F1", "x", "y", None, None, None, "1", "2"), ("F2", "CAGR", "y", None, None, None, None, None), ("F3", "x", "from 2020 to 2025 sales rise", None, None, None, None, None), ("F4", "x", "in 2020", None, None, None, "1", None), ("F5", "x", "연평균 3%", None, None, None, None, None),
        ("F6", "x", "y", None, "2020-2025", "actual", None, None), ("F7", "x", "연평균 3% 성장", None, None, None, None, None), ("F8", "Market size", "y", None, None, "actual", None, None), ("F9", "Market size", "y", None, None, "forecast", None, None),
    )
    return claims.calculation_candidates(facts).select("id")


@query(expected("chart, fact_id, issue", ("c", "F002", "value differs"), ("c", "F003", "unknown fact"), ("c", "F003", "not in caption"), ("e", "F001", "not in caption")))
def sidecar_issues(spark: SparkSession, d: str) -> DataFrame:
    """Drawn values against ledger and caption."""
    drawn = _rows(spark, "chart string, fact_id string, value_raw string, unit string", ("c", "F001", "1", "MW"), ("c", "F002", "2", "MW"), ("c", "F003", "3", None), ("e", "F001", "1", "MW"))
    facts = _rows(spark, "id string, raw string, unit string", ("F001", "1", "MW"), ("F002", "5", "MW"))
    return claims.sidecar_issues(drawn, facts, _rows(spark, "chart string, caption string", ("c", "x (F001)(F002)"), ("e", "no tag")))


@query(expected("key, state", ("a", "unresolved"), ("b", "resolved"), ("z", "orphan")))
def decision_states(spark: SparkSession, d: str) -> DataFrame:
    """Tables against decisions."""
    return claims.decision_states(_rows(spark, "key string", ("a",), ("b",)), _rows(spark, "key string", ("b",), ("z",)))


@query(expected("title, issue", ("Risks", "missing"), ("Outlook", "empty")))
def plan_issues(spark: SparkSession, d: str) -> DataFrame:
    """Planned headings against a report's."""
    plan = _rows(spark, "title string", ("1. Market size",), ("Risks",), ("Outlook",))
    return claims.plan_issues(plan, _rows(spark, "title string, text string", ("## Market size and growth", "x"), ("Outlook", " ")))


@query(expected("line, title", (14, "Notes")))
def appendix_issues(spark: SparkSession, d: str) -> DataFrame:
    """Headings after the appendix mark that aren't approved."""
    headings = _rows(spark, "line long, title string", (2, "Summary"), (12, "## Sources"), (14, "Notes"))
    return claims.appendix_issues(headings, 10, _rows(spark, "title string", ("1. Sources",)))


@query(expected("path, issue", ("assets/b.svg", "no file"), ("assets/b.svg", "caption without tag"), ("../x.png", "outside assets"), ("../x.png", "no caption"), ("../x.png", "no source")))
def figure_issues(spark: SparkSession, d: str) -> DataFrame:
    """Figure references."""
    figures = _rows(spark, "path string, caption string, source string", ("assets/a.svg", "x (F001)", "s"), ("assets/b.svg", "x", "s"), ("../x.png", " ", None))
    return claims.figure_issues(figures, _rows(spark, "path string", ("assets/a.svg",), ("../x.png",)))


@query(expected("path, issue", ("p", "small type"), ("o", "small type"), ("q", "no title or description"), ("q", "no fact ids"), ("q", "outside link"), ("q", "no Korean font"), ("q", "too many bars"), ("r", "fact ids differ")))
def svg_issues(spark: SparkSession, d: str) -> DataFrame:
    """Texts of drawings (P30): a size without unit is in px; a background is no bar."""
    good = "<!-- FACTS: F001, F002 -->\n<svg style=\"font-family: 'Noto Sans KR'\"><title>t</title><desc>d</desc><text font-size='{}'/></svg>"
    many = '<svg><a href="https://x.org"/>' + '<rect width="100%"/>' + "<rect/>" * 21 + "</svg>"
    rows = (
        ("p", good.format("8pt"), None, None), ("o", good.format(9), None, None), ("n", good.format("12px"), None, ["F002", "F001"]), ("m", good.format("0.75em"), "grouped", None), ("q", many, None, None), ("r", good.format("9pt") + "<rect/>" * 30, "line", ["F001"]),
        ("s", good.format("9pt") + '<rect width="100%"/>' + "<rect/>" * 20, "bar", None), ("t", good.format(20) + '<g class="mark-rect x"><path/><path/></g>' + "<rect/>" * 30, "hbar", None),
    )
    return claims.svg_issues(_rows(spark, "path string, svg string, chart_type string, fact_ids array<string>", *rows))


@query(expected("name, place_id", ("Côte d'Ivoire", 384), ("Bavaria State", 9), ("the  Bavaria", 9), ("Nowhere", None)).replace("CAST(NULL AS VARCHAR)", "CAST(NULL AS BIGINT)"))
def place_ids(spark: SparkSession, d: str) -> DataFrame:
    """Place names to ids, by folded name or without affixes."""
    places = _rows(spark, "key string, id long", ("cotedivoire", 384), ("bavaria", 9))
    return claims.place_ids(_rows(spark, "name string", ("Côte d'Ivoire",), ("Bavaria State",), ("the  Bavaria",), ("Nowhere",)), places, "name")


@query(expected("kind, token, missing", ("tag", "F002", 1), ("link", "http://b", 1)))
def pdf_expectations(spark: SparkSession, d: str) -> DataFrame:
    """Tags and links that a rendered document lacks."""
    report = _rows(spark, "text string", ("a (F001) b [F002] [x](http://a) [y](http://b) (F002)",))
    found = _rows(spark, "kind string, token string", ("tag", "F001"), ("tag", "F002"), ("link", "http://a"), ("link", "http://z"))
    return claims.pdf_expectations(report, found).select("kind", "token", F.col("missing").cast("bigint").alias("missing"))


# the ledger's changes


@query(expected("id, claim, reason", ("F001", "a", None), ("F002", "b", None), ("F004", "d", None), ("F001", "new", "id exists"), ("F003", "a", "claim exists"), ("F005", "e", "id repeated"), ("F005", "f", "id repeated")))
def ledger_insert(spark: SparkSession, d: str) -> DataFrame:
    """New facts whose id and claim are new (Z1), and the rejected ones."""
    now = _rows(spark, "id string, claim string", ("F001", "a"), ("F002", "b"))
    more = _rows(spark, "id string, claim string", ("F001", "new"), ("F003", "a"), ("F004", "d"), ("F005", "e"), ("F005", "f"))
    kept, rejected = ledger.insert(now, more, "id", "claim")
    return kept.withColumn("reason", F.lit(None).cast("string")).union(rejected)


@query(expected("id, actions", ("F1", "note,check,reread"), ("F2", ""), ("F3", "reread")))
def ledger_events(spark: SparkSession, d: str) -> DataFrame:
    """Events appended in the order of their time."""
    event = "struct<by:string,at:string,action:string,note:string,reread_sha256:string>"
    facts = _rows(spark, f"id string, verify_events array<{event}>", ("F1", [("w", "2020-01-01", "note", None, None)]), ("F2", []), ("F3", None))
    events = _rows(spark, f"fact_id string, event {event}", ("F1", ("lead", "2020-03-01", "reread", None, "a" * 64)), ("F1", ("w", "2020-02-01", "check", None, None)), ("F3", ("lead", "2020-01-01", "reread", None, "B" * 64)))
    return ledger.append_event(facts, events).select("id", F.array_join("verify_events.action", ",").alias("actions"))


@query(expected("id, status, demoted_at, discard_reason", ("F1", "discarded", "2021-01-01", "wrong"), ("F2", "confirmed", None, None), ("F3", "disputed", "2020-05-05", None), ("F4", "discarded", None, "old")))
def ledger_status(spark: SparkSession, d: str) -> DataFrame:
    """Status changes (Z3): leaving confirmed is dated, discarding keeps its reason."""
    facts = _rows(spark, "id string, status string, demoted_at string, discard_reason string", ("F1", "confirmed", None, None), ("F2", "draft", None, "x"), ("F3", "draft", "2020-05-05", None), ("F4", "discarded", None, "old"))
    changes = _rows(spark, "id string, new_status string, reason string", ("F1", "discarded", "wrong"), ("F2", "confirmed", "ignored"), ("F3", "disputed", None))
    return ledger.set_status(facts, changes, "2021-01-01").select("id", "status", "demoted_at", "discard_reason")


@query(expected("fact_id, observers", ("F1", 2), ("F2", 1), ("F3", 3)))
def observer_counts(spark: SparkSession, d: str) -> DataFrame:
    """Independent observers (J25): shared groups, addresses or hashes join, also over others."""
    rows = _rows(
        spark, "fact_id string, grp string, url string, sha string",
        ("F1", "g", "u1", "h1"), ("F1", "g", "u2", "h2"), ("F1", None, "u3", "h3"), ("F2", "a", "u1", None), ("F2", "b", "u1", "h"), ("F2", "c", None, "h"), ("F3", "a", None, None), ("F3", "b", None, None), ("F3", None, "u", None),
    )
    return ledger.observers(rows, "fact_id", ["grp", "url", "sha"]).select("fact_id", F.col("observers").cast("bigint").alias("observers"))


_CONTEXT = ("m", "e", None, "KR", "2020", "", None, "d|x")


@query(expected("v4, v3", ("v4:" + _sha('["m","e",null,"KR","2020","",null,"d|x"]'), "m|e|KR|2020|na|na")))
def claim_keys(spark: SparkSession, d: str) -> DataFrame:
    """Claim keys, new and old."""
    rows = _rows(spark, "context struct<" + ",".join(f"{f}:string" for f in ledger.KEY_FIELDS) + ">", (_CONTEXT,))
    return rows.select(ledger.claim_key(F.col("context")).alias("v4"), ledger.old_claim_key(F.col("context")).alias("v3"))


@query(expected("receipt_id, path, state", ("r1", "a", "current"), ("r1", "b", "changed"), ("r1", "c", "missing"), ("r2", "a", "appeared"), ("r2", "z", "current")))
def reference_states(spark: SparkSession, d: str) -> DataFrame:
    """Files that receipts refer to."""
    refs_ = _rows(spark, "receipt_id string, path string, sha256 string", ("r1", "a", "AA"), ("r1", "b", "bb"), ("r1", "c", "cc"), ("r2", "a", "missing"), ("r2", "z", "MISSING"))
    return provenance.reference_states(refs_, _rows(spark, "path string, sha256 string", ("a", "aa"), ("b", "xx"))).select("receipt_id", "path", "state")


# numbers, units, references, addresses


@query(expected("unit, dimension, power", ("MW", "W", 6), ("mW", "W", -3), ("USD_B", "USD", 9), ("EUR million", "EUR", 6), ("백만 EUR", "EUR", 6), ("억원", "KRW", 8), ("USD_X", "UNSUPPORTED", 0), ("%", "PCT", 0), ("MW (net)", "W", 6), ("", None, 0), ("parsec", None, 0), ("kt", "TON", 3), ("KT", None, 0), ("t", "TON", 0), ("million", "N", 6)))
def unit_table(spark: SparkSession, d: str) -> DataFrame:
    """Units (F18): physical ones are told by case, endings of currencies must be known."""
    units = _rows(spark, "unit string", *[(u,) for u in ("MW", "mW", "USD_B", "EUR million", "백만 EUR", "억원", "USD_X", "%", "MW (net)", "", "parsec", "kt", "KT", "t", "million")])
    return units.select("unit", quantity.unit_of("unit").alias("u")).select("unit", "u.dimension", F.col("u.power").cast("bigint").alias("power"))


@query(expected("id, dimension, low, high, tag", (1, "W", "2.0E+7", "2.0E+7", "F001"), (1, "W", "3.0E+7", "3.0E+7", "F002"), (2, "USD", "4.5E+6", "4.5E+6", None), (3, "PCT", "3.2", "3.2", "F003"), (4, "TON", "9", "11", None), (5, "KRW", "1.20E+10", "1.20E+10", "F004"), (6, "대", "3E+4", "3E+4", None), (7, "EUR", "1.5E+9", "2E+9", "F005"), (8, "W", "2.0E+7", "2.0E+7", None), (9, "W", "5E+6", "5E+6", "F007")))
def number_cases(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of sentences and the tags they are bound to."""
    texts = (
        "20 MW (F001), 30 MW (F002)", "cost $4.5 million", "[F003] rose 3.2%", "10±1 톤", "120억원 (F004)", "3 대 of 3만대", "€1.5-2bn (F005)", "20 MW | (F001)", "5 MW is what the (F007) says (F008)",
    )
    rows = _rows(spark, "id long, t string", *enumerate(texts, 1))
    number = lambda c: F.regexp_replace(F.format_string("%s", F.col(f"n.{c}")), "^$", "")
    return rows.select("id", F.explode(quantity.bound_numbers("t")).alias("n")).select("id", "n.dimension", number("low").alias("low"), number("high").alias("high"), "n.tag")


@query(expected("url, bad", ("http://example.org/a", False), ("http://10.0.0.1/", True), ("http://[fc00::1]/", True), ("http://[fe80::1]:80/", True), ("http://[::ffff:127.0.0.1]/", True), ("http://224.0.0.1/", True), ("http://240.0.0.1", True), ("http://8.8.8.8/x", False), ("http://[2606:4700::1111]/", False), ("ftp://a.org/", True), ("http://u@a.org/", True), ("https://localhost/", True), ("http:///x", True), ("http://a.org/ x", True)))
def url_safety(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that must not be asked for."""
    given = ("http://example.org/a", "http://10.0.0.1/", "http://[fc00::1]/", "http://[fe80::1]:80/", "http://[::ffff:127.0.0.1]/", "http://224.0.0.1/", "http://240.0.0.1", "http://8.8.8.8/x", "http://[2606:4700::1111]/", "ftp://a.org/", "http://u@a.org/", "https://localhost/", "http:///x", "http://a.org/ x")
    return _rows(spark, "url string", *[(u,) for u in given]).select("url", urls.unsafe(F.col("url")).alias("bad"))


@query(expected("requested, final, other", ("http://a.org/x", "https://www.a.org/x/", False), ("http://a.org/x", "http://a.org/y", True), ("http://a.org/", "http://a.org/welcome", False), ("http://a.org/x?utm_source=q", "http://m.a.org/x", False), ("http://a.org/x?id=1", "http://a.org/x?id=2", True), ("http://a.org/x", None, False)))
def redirects(spark: SparkSession, d: str) -> DataFrame:
    """Requests that ended at another document."""
    pairs = (("http://a.org/x", "https://www.a.org/x/"), ("http://a.org/x", "http://a.org/y"), ("http://a.org/", "http://a.org/welcome"), ("http://a.org/x?utm_source=q", "http://m.a.org/x"), ("http://a.org/x?id=1", "http://a.org/x?id=2"), ("http://a.org/x", None))
    return _rows(spark, "requested string, final string", *pairs).select("requested", "final", urls.redirected_elsewhere(F.col("requested"), F.col("final")).alias("other"))


@query(expected("id, header, meta, text", (1, "utf-8", None, "é"), (2, None, "euc-kr", '<meta charset="euc-kr">가'), (3, "nowhere", None, "a"), (4, None, None, "�!"), (5, "latin-1", "utf-8", '<META charset=utf-8>é'), (6, None, "shift_jis", "<meta http-equiv='Content-Type' content='text/html; charset=shift_jis'>ア"), (7, None, None, "<meta http-equiv='refresh' content='0; charset=x'>é")))
def page_decoding(spark: SparkSession, d: str) -> DataFrame:
    """Character sets of header and page, and the text (F16)."""
    rows = _rows(
        spark, "id long, type string, raw binary",
        (1, "text/html; Charset=\"utf-8\"", "é".encode()), (2, "text/html", '<meta charset="euc-kr">가'.encode("euc-kr")), (3, "text/html; charset=nowhere", b"a"), (4, None, b"\xff!"),
        (5, "text/html; charset='latin-1'", '<META charset=utf-8>é'.encode("latin-1")), (6, "", "<meta http-equiv='Content-Type' content='text/html; charset=shift_jis'>ア".encode("shift_jis")), (7, "x;charset=", "<meta http-equiv='refresh' content='0; charset=x'>é".encode()),
    )
    return rows.select("id", decode.header_charset(F.col("type")).alias("header"), decode.meta_charset(F.col("raw")).alias("meta"), decode.page_text(F.col("raw"), F.col("type")).alias("text"))


@query(expected("number, variants, inside", ("1,234", "1,234|1234", True), ("45", "45", False), ("12000", "12000|12,000", False), ("12.5", "12.5", False), (" 1 2 ", "1 2|12", False)))
def number_forms(spark: SparkSession, d: str) -> DataFrame:
    """How a number may be written, and whether a text has it by itself."""
    rows = _rows(spark, "number string", ("1,234",), ("45",), ("12000",), ("12.5",), (" 1 2 ",))
    return rows.select("number", F.array_join(reports.number_variants(F.col("number")), "|").alias("variants"), reports.standalone(F.lit("in 2045 some 1,234 of 12.57 and 112000"), F.col("number")).alias("inside"))


# reports and tables


@query(expected("report, issue", ("b", "several appendix marks"), ("c", "empty body"), ("d", "another report"), ("d", "empty body")))
def report_issues(spark: SparkSession, d: str) -> DataFrame:
    """Whole-report checks."""
    mark = "<!-- FACTSHEET:APPENDIX -->"
    rows = (("a", f"text {mark} more", "a"), ("b", f"text {mark} x <!--FACTSHEET:APPENDIX-->", None), ("c", f" \n{mark} more", "c"), ("d", "", "e"))
    return reports.report_issues(_rows(spark, "report string, text string, canonical string", *rows))


@query(expected("id", ("F1",), ("F3",)))
def conversion_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Dollar amounts without a decimal to check by."""
    return reports.conversion_warnings(_rows(spark, "id string, unit string, decimal string", ("F1", "USD_M", None), ("F2", "$", "1.5"), ("F3", "$ million", ""), ("F4", "KRW", None), ("F5", None, None)))


@query(expected("level, id, message", ("failure", "F1", "inputs not recorded"), ("failure", "F2", "rate differs"), ("warning", "F3", "rate differs"), ("failure", "F4", "bad years"), ("warning", "F5", "not checkable")))
def calculation_report(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the calculation audit (K9), strict."""
    rows = (("F1", "draft", "high", False, "MATCH", None), ("F2", "confirmed", "low", True, "CONFLICT", None), ("F3", "draft", "low", True, "CONFLICT", None), ("F4", "draft", "high", True, "INVALID_INPUT", "bad years"), ("F5", "draft", None, False, "NOT_CHECKABLE", None))
    return reports.calculation_report(_rows(spark, "id string, status string, risk string, atomic boolean, result string, reason string", *rows), strict=True)


@query(expected("text", ('a binaryItemIDRef="image2" b binaryItemIDRef="image1" c binaryItemIDRef="image10" binaryItemIDRef="image3x" image1',)))
def remapped_images(spark: SparkSession, d: str) -> DataFrame:
    """New numbers of image references, all at once."""
    text = 'a binaryItemIDRef="image1" b binaryItemIDRef="image2" c binaryItemIDRef="image3" binaryItemIDRef="image3x" image1'
    return _rows(spark, "t string", (text,)).select(reports.remapped(F.col("t"), {1: 2, 2: 1, 3: 10}).alias("text"))


@query(expected("id, key", (1, "매출 추이"), (2, "a | b / x y"), (3, "Title"), (4, "h / 01234567890123456789")))
def table_keys(spark: SparkSession, d: str) -> DataFrame:
    """Names of tables by caption, else by content."""
    rows = (
        (1, ["<표> 표 3. 매출 추이 {형식=A}", ""], ["a"], ["x"]), (2, ["text", "more"], ["a", "b"], ["x", "y"]), (3, ["**[표 1] Title**", "lead in", ""], ["a"], ["x"]), (4, ["표 1. gone", "a", "b", "c"], ["h"], ["012345678901234567890"]),
    )
    df = _rows(spark, "id long, before array<string>, header array<string>, first array<string>", *rows)
    return df.select("id", reports.table_key(F.col("before"), F.col("header"), F.col("first")).alias("key"))


@query(expected("doc, start, nearby", (1, 20, True), (1, 60, False), (2, 5, True)))
def figures_nearby(spark: SparkSession, d: str) -> DataFrame:
    """Figures within eight lines of a table."""
    tables = _rows(spark, "doc long, start long, end long", (1, 20, 25), (1, 60, 70), (2, 5, 9))
    lines = _rows(spark, "doc long, line long, text string", (1, 33, "![x](y)"), (1, 51, "![x](y)"), (1, 79, "![z](y)"), (2, 1, "a ![z](y)"), (2, 12, "no"))
    return reports.figure_nearby(tables, lines).select("doc", "start", "nearby")


@query(expected('t, "column", width', (1, 0, 19), (1, 1, 81), (2, 0, 50), (2, 1, 50)))
def column_widths(spark: SparkSession, d: str) -> DataFrame:
    """Widths of a table's columns (A41). Table 1 needs 4 and 5 of 100 and has content of 4 and
    20 for the 91 left: 4 + 15 and 5 + 75, and 1 of rounding; table 2 needs all there is."""
    rows = _rows(spark, "t long, row long, cells array<string>", (1, 0, ["item", "text"]), (1, 1, ["abcd", "some words and so on"]), (2, 0, ["a" * 60, "b" * 70]))
    return reports.column_widths(rows, ["t"], "cells", 100).select("t", F.col("column").cast("bigint").alias("column"), "width")


@query(expected("folder, file, source, license, accessed_at, path", ("w/a", "x.png", "S · p.3", "L", "2020", "w/a/x.png"), ("w/a", "sub/y.png", "http://u", "cc", "2021", "w/a/y.png"), ("w/a", "w/z.png", "S", "L", "2020", "w/z.png")))
def image_index(spark: SparkSession, d: str) -> DataFrame:
    """Image records of an index and the files they stand for."""
    item = "array<struct<file:string,source:string,url:string,page:string,license:string,accessed_at:string,at:string>>"
    index = _rows(
        spark, f"folder string, source string, license string, accessed_at string, at string, figures {item}, images {item}, files {item}, candidates {item}",
        ("w/a", "S", "L", None, "2020", [("x.png", None, None, "3", None, None, None), (" ", "n", None, None, None, None, None)], None, [("sub/y.png", None, "http://u", None, "cc", "2021", None), ("none.png", "S", None, None, None, None, None)], [("w/z.png", "", None, "", None, None, None)]),
    )
    files = _rows(spark, "path string", ("w/a/x.png",), ("w/a/y.png",), ("w/z.png",))
    return reports.located_images(reports.image_records(index), files)


# schemas, segments, receipts


FACT_SCHEMA = {
    "required": ["id", "claim", "status"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "pattern": r"F\d{3,}"},
        "claim": {"type": "string"},
        "status": {"type": "string", "enum_ref": "status"},
        "observed_at": {"type": ["string", "null"], "format": "iso-time"},
        "schema_version": {"type": "integer"},
        "context": {"type": "object", "required": ["metric"], "properties": {"metric": {"type": "string"}, "year": {"type": "integer"}}},
        "evidence_ids": {"type": "array", "minItems": 1},
    },
}
ENUMS = {"status": ["draft", "confirmed", "disputed", "discarded"]}
FACTS = [
    {"id": "F001", "claim": "a", "status": "confirmed", "evidence_ids": ["E001"], "context": {"metric": "m", "year": 2020}},
    {"id": "F1", "claim": " ", "status": "draft"},
    {"id": "F003", "claim": "c", "status": "sure", "observed_at": "2020-13", "schema_version": True},
    {"id": "F004", "status": "draft", "extra": 1, "evidence_ids": [], "context": {"year": "x"}},
]


@query(expected("id, rule", ("F1", "id: pattern"), ("F1", "claim: blank"), ("F003", "status: enum"), ("F003", "observed_at: format"), ("F003", "schema_version: type"), ("F004", "claim: required"),
                ("F004", "unknown field"), ("F004", "evidence_ids: items"), ("F004", "context.metric: required"), ("F004", "context.year: type")))
def ledger_rule_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(json.dumps(f),) for f in FACTS], "raw string")
    return rules.violations(rows.withColumn("id", F.get_json_object("raw", "$.id")), rules.compile_rules(F.col("raw"), FACT_SCHEMA, ENUMS), "id")


REPORT = """# Report
The plant has 20 MW (F001) and cost $4.5 million (F002). Output rose 3.2% [F003]... and more.

| item | value |
|---|---|
| capacity | 120 MW (F004) |

<!-- FACTSHEET:APPENDIX -->
## Appendix
"""


@query(expected("doc, segment, sentence", (1, 0, "# Report"), (1, 1, "The plant has 20 MW (F001) and cost $4.5 million (F002)."), (1, 2, "Output rose 3.2% [F003]... and more."), (1, 3, "| item | value |"), (1, 4, "|---|---|"), (1, 5, "| capacity | 120 MW (F004) |")))
def sentence_segments(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.createDataFrame([(1, REPORT)], "doc int, text string").withColumn("text", markdown.body(F.col("text")))
    rows = docs.select("doc", F.posexplode(markdown.segments(F.col("text"))).alias("segment", "sentence"))
    return rows.select(F.col("doc").cast("bigint").alias("doc"), F.col("segment").cast("bigint").alias("segment"), "sentence")


@query(expected('segment, "start", "end", dimension, low, high, tag', (1, 14, 19, "W", "2.0E+7", "2.0E+7", "F001"), (1, 36, 48, "USD", "4.5E+6", "4.5E+6", "F002"), (2, 12, 16, "PCT", "3.2", "3.2", "F003"), (5, 13, 19, "W", "1.20E+8", "1.20E+8", "F004")))
def number_binding(spark: SparkSession, d: str) -> DataFrame:
    rows = sentence_segments(spark, d).select("segment", F.explode(quantity.bound_numbers("sentence")).alias("n")).select("segment", "n.*")
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("start", "end")})


@query(expected("unit, dimension, power", ("MW", "W", 6), ("mW", "W", -3), ("USD_B", "USD", 9), ("EUR million", "EUR", 6), ("백만 EUR", "EUR", 6), ("억원", "KRW", 8), ("USD_X", "UNSUPPORTED", 0), ("%", "PCT", 0), ("MW (net)", "W", 6), ("", None, 0), ("parsec", None, 0)))
def unit_resolution(spark: SparkSession, d: str) -> DataFrame:
    units = spark.createDataFrame([(u,) for u in ("MW", "mW", "USD_B", "EUR million", "백만 EUR", "억원", "USD_X", "%", "MW (net)", "", "parsec")], "unit string")
    return units.select("unit", quantity.unit_of("unit").alias("u")).select("unit", "u.dimension", F.col("u.power").cast("bigint").alias("power"))


@query(expected("gate, receipt_id, issues, ok", ("G1", "r3", "", True), ("G2", "r2", "prerequisite_G1", False), ("G3", "r4", "ref_changed,below_G2", False), ("G4", "r5", "failed", False)))
def receipt_currency(spark: SparkSession, d: str) -> DataFrame:
    receipts = spark.createDataFrame(
        [("G1", 1, "r1", 0, {}), ("G2", 2, "r2", 0, {"G1": "r1"}), ("G1", 3, "r3", 0, {}), ("G3", 4, "r4", 0, {"G2": "r2"}), ("G4", 5, "r5", 1, {})],
        "gate string, seq int, receipt_id string, exit int, prerequisite_receipts map<string,string>",
    )
    refs_ = spark.createDataFrame([("r4", "a", "aa"), ("r3", "b", "missing")], "receipt_id string, path string, sha256 string")
    files = spark.createDataFrame([("a", "bb")], "path string, sha256 string")
    out = provenance.receipt_issues(receipts, provenance.reference_states(refs_, files), ["G1", "G2", "G3", "G4"])
    return out.select("gate", "receipt_id", F.array_join("issues", ",").alias("issues"), "ok")
