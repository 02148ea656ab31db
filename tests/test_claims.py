"""Report checks on literal rows."""

import hashlib

from pyspark.sql import functions as F

from quillmark.operators import claims


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_tags_and_numbers(spark):
    s = spark.createDataFrame([(1, "It has 20 MW (F001) and 30 MW."), (2, "[상충] it is 5% (F002)"), (3, "Cost $4 million (F003), F009 (F009)"), (4, "about 21 MW (F001)")], "sentence_id int, sentence string")
    f = spark.createDataFrame([("F001", "confirmed", "20", "MW"), ("F002", "disputed", "5", "%"), ("F003", "draft", "4", "USD_million")], "id string, status string, raw string, unit string")
    assert rows(claims.tag_issues(s, f)) == {(3, "F003", "status draft"), (3, "F009", "unknown")}
    got = {(r.sentence_id, r.tag, r.state) for r in claims.number_states(s, f).collect()}
    assert got == {(1, "F001", "ok"), (1, None, "untagged"), (2, "F002", "ok"), (3, "F003", "ok"), (4, "F001", "mismatch")}
    e = spark.createDataFrame([("E1", "F001")], "id string, fact_id string")
    assert rows(claims.sentences_without_quote(s, e, spark.createDataFrame([("E1",)], "evidence_id string"))) == {(2,), (3,)}


def test_reviews(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    s = spark.createDataFrame([("S1", "a (F001)"), ("S2", "b (F002)"), ("S3", "c")], "sentence_id string, sentence string")
    r = spark.createDataFrame(
        [("S1", ["F001"], ["E1"], sha("a (F001)"), "v"), ("S9", ["F001"], ["E9"], "x", "old")],
        "sentence_id string, fact_ids array<string>, evidence_ids array<string>, reviewed_text_sha256 string, evidence_revision string",
    )
    f, e = spark.createDataFrame([("F001",), ("F002",)], "id string"), spark.createDataFrame([("E1", "F001")], "id string, fact_id string")
    assert rows(claims.review_issues(r, s, f, e, "v")) == {("S9", "unknown sentence"), ("S9", "evidence changed"), ("S9", "unknown evidence"), ("S2", "not reviewed")}


def test_charts_and_headings(spark):
    drawn = spark.createDataFrame([("c", "F001", "1", "MW"), ("c", "F002", "2", "MW"), ("c", "F003", "3", None)], "chart string, fact_id string, value_raw string, unit string")
    f = spark.createDataFrame([("F001", "1", "MW"), ("F002", "5", "MW")], "id string, raw string, unit string")
    captions = spark.createDataFrame([("c", "x (F001)(F002)")], "chart string, caption string")
    assert rows(claims.sidecar_issues(drawn, f, captions)) == {("c", "F002", "value differs"), ("c", "F003", "unknown fact"), ("c", "F003", "not in caption")}
    plan = spark.createDataFrame([("1. Market size",), ("Risks",), ("Outlook",)], "title string")
    found = spark.createDataFrame([("## Market size and growth", "x"), ("Outlook", " ")], "title string, text string")
    assert rows(claims.plan_issues(plan, found)) == {("Risks", "missing"), ("Outlook", "empty")}
    t, d = spark.createDataFrame([("a",), ("b",)], "key string"), spark.createDataFrame([("b",), ("z",)], "key string")
    assert rows(claims.decision_states(t, d)) == {("a", "unresolved"), ("b", "resolved"), ("z", "orphan")}
    text = "<svg><!-- FACTS: F001 --><title>t</title><desc>d</desc><text style='font-family: Malgun Gothic' font-size='{}'/></svg>"
    svg = spark.createDataFrame([("p", text.format(8), None, None), ("q", text.format(12), None, None)], "path string, svg string, chart_type string, fact_ids array<string>")
    assert rows(claims.svg_issues(svg)) == {("p", "small type")}
    places = spark.createDataFrame([("cotedivoire", 384), ("bavaria", 9)], "key string, id int")
    names = spark.createDataFrame([("Côte d'Ivoire",), ("Bavaria State",), ("Nowhere",)], "n string")
    assert rows(claims.place_ids(names, places, "n")) == {("Côte d'Ivoire", 384), ("Bavaria State", 9), ("Nowhere", None)}
    assert spark.range(1).select(claims.layout_errors(F.array(F.lit("a")), F.array(F.lit("b")))).first()[0].lost == ["a"]
