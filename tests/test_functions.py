"""Column functions and parsers on literal rows."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillmark.catalog import WorkPaths, slug
from quillmark.functions import quantity, refs, semantics, specs, urls
from quillmark.functions import text as tx
from quillmark.operators import charts, coverage, ledger, logs, provenance, rules, snapshots, spans
from tests import literal_cases
from quillmark.sources import files, html, markdown, payloads


def one(spark, column, **values):
    """Value of a column expression over one literal row."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


def test_url_keys(spark):
    key = lambda u: one(spark, urls.search_key(F.col("u")), u=u)
    assert key("HTTPS://Www.Example.com/a/?utm_source=x&b=2&a=1#f") == "https://www.example.com/a?a=1&b=2"
    assert key(" plain text ") == "plain text" and key("http://x.org/?fbclid=1") == "http://x.org"
    other = lambda a, b: one(spark, urls.redirected_elsewhere(F.col("a"), F.col("b")), a=a, b=b)
    assert not other("http://www.x.org/a%20b/index.html?utm_x=1", "https://m.x.org/a b/")
    assert other("http://x.org/a", "http://x.org/b") and not other("http://x.org/", "http://x.org/start") and not other(None, "http://x.org")
    assert one(spark, urls.unsafe(F.col("u")), u="http://10.0.0.1/") and not one(spark, urls.unsafe(F.col("u")), u="https://example.org/x")
    assert one(spark, urls.document_kind(F.col("m"), F.col("u")), m="application/octet-stream", u="http://x/y.HWP?z") == "hwp"
    assert one(spark, urls.host_allowed(F.lit("a.b.org"), F.array(F.lit("b.org")))) and not one(spark, urls.host_allowed(F.lit("ab.org"), F.array(F.lit("b.org"))))


def test_pages(spark):
    long = "<html><title>Fine</title><body>" + "text " * 300 + "</body></html>"
    verdict = lambda h, s=200: one(spark, tx.page_verdict(F.col("h"), F.col("s")), h=h, s=s)["verdict"]
    assert verdict(long) == "ok" and verdict(long, 404) == "empty"
    assert verdict(long.replace("Fine", "404 - Page Not Found")) == "partial" and verdict("<p>x</p>") == "empty"
    assert verdict("<title>Just a moment</title>" + "<i></i>" * 60) == "challenge"
    suspect = lambda t: one(spark, tx.suspect_title(F.col("t")), t=t)
    assert suspect("404억 계약") is None and suspect("Sign in - Site") == "login" and suspect("not founders") is None
    assert one(spark, tx.page_title(F.col("h")), h='<meta content="Og" property="og:title">') == "Og"
    assert one(spark, tx.mask(F.col("t")), t="api_key=abc&x Bearer qq a.b@c.org") == "api_key=***&x *** ***"
    assert one(spark, tx.thin_document(F.col("t")), t="가" * 1600) is False and one(spark, tx.thin_document(F.col("t")), t="a" * 1600) is True


def test_text(spark):
    has = lambda t, n: one(spark, tx.contains_number(F.col("t"), F.col("n")), t=t, n=n)
    assert has("is 12.5 now", "12.5") and not has("is 12.57", "12.5") and not has("112.5", "12.5")
    assert one(spark, tx.media_seconds(F.col("t")), t="1:02:03") == 3723 and one(spark, tx.media_seconds(F.col("t")), t="x") is None
    for value, ok in (("2020", True), ("2020-13", False), ("2020-02-30", False), ("2020-02-29", True), ("2020-01-01T10:00:00Z", True), ("", False)):
        assert one(spark, tx.iso_time(F.col("v")), v=value) is ok
    assert one(spark, tx.tag_ids(F.col("t")), t="a (F001) [F0022] (F1)") == ["F001", "F0022"]
    assert one(spark, tx.folded(F.col("t")), t="Ａ  ß") == "a ss" and one(spark, tx.accents_folded(F.col("t")), t="Côte d'Ivoire") == "cotedivoire"
    assert one(spark, tx.display_width(F.col("t")), t="가a") == 3.0 and one(spark, tx.js_round(F.lit(-2.5))) == -2


def test_quantities():
    assert quantity.values("45±2") == [43, 47] and quantity.values("1,200~1,300") == [1200, 1300] and quantity.values("about") is None
    assert quantity.values(" 4.5E+3 ") == [4500] and quantity.values("−.5") == [Decimal("-0.5")] and quantity.values("") is None and quantity.values("5.") == [5]
    found = quantity.numbers("제25조 has 45조원, $4.5B and 3대 but 3만대")
    assert [(d, v[0]) for _, _, d, v in found] == [("KRW", Decimal("45e12")), ("USD", Decimal("4.5e9")), ("대", 30000)]
    # a sign before a currency is the first number's
    assert [v for *_, v in quantity.numbers("-$5±1 million, -$5~10 and -€2")] == [[-6000000, -4000000], [-5, 10], [-2]]
    text = "20 MW (F001) | 30 MW (F002)"
    tags = [m.span() for m in quantity.TAG.finditer(text)]
    assert quantity.bind(text, quantity.numbers(text), tags) == {0: 0, 1: 1}


UNIT_CASES = [
    ("MW", "W", 6), ("mW", "W", -3), ("USD_B", "USD", 9), ("EUR million", "EUR", 6), ("백만 EUR", "EUR", 6), ("억원", "KRW", 8), ("USD_X", "UNSUPPORTED", 0), ("%", "PCT", 0),
    ("MW (net)", "W", 6), ("", None, 0), ("parsec", None, 0), ("usd", "USD", 0), ("ABC_million", "ABC", 6), ("abc", "ABC", 0), ("US$ million", "USD", 6), ("thousand units", "N", 3),
    ("십억 USD", "USD", 9), ("capacity in MWh", "WH", 6), ("KT", None, 0), ("kt per year", "TON", 3), ("(GW)", None, 0), ("USDT", "UNSUPPORTED", 0), (None, None, 0), ("수주 5건", "건", 0), ("£ billion", "GBP", 9), ("㎿", "W", 6),
]


def test_units(spark):
    df = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(UNIT_CASES)], "i int, unit string").withColumn("u", quantity.unit_of("unit")).orderBy("i")
    got = [(r["unit"], r["u"]["dimension"], r["u"]["power"]) for r in df.collect()]
    assert got == [case if case[0] != "(GW)" else ("(GW)", "W", 9) for case in UNIT_CASES]
    pairs = [("N", "USD", True), ("EUR", "N", True), ("N", "N", True), ("N", "W", False), ("USD", "EUR", False), (None, None, True), (None, "W", False), ("W", "W", True)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string, want boolean").withColumn("got", quantity.dimensions_compatible(F.col("a"), F.col("b")))
    assert df.where("not (got <=> want)").count() == 0


GAP_CASES = [
    ("20 MW and 5 bbl", [("bbl", "failure")]), ("5 parsec", []), ("3 USDX", []), ("B2B in 2020", []), ("5 percent, 7 t", [("percent", "failure"), ("t", "failure")]), ("10 메가와트를", [("메가와트를", "failure")]),
    ("10 메가와트시장", [("메가와트시장", "warning")]), ("3 그루", [("그루", "warning")]), ("2020년 3월 제5조", []), ("5원 6 원문", [("원문", "warning")]), ("6 원에 7억원", [("원에", "warning")]), ("삼백조원", [("삼백조원", "numeral")]),
    ("제 12조를", []), ("제12항은", []), ("4개 5개월 6개소", [("개소", "warning")]), ("1,000 bbl 2", [("bbl", "failure")]), ("", []),
]


def test_gaps_of_the_number_grammar(spark):
    for text, want in GAP_CASES:
        assert [(u, s) for *_, u, s in quantity.gaps(text)] == want, text
    df = spark.createDataFrame([(t,) for t, _ in GAP_CASES] + [(None,)], "t string").select(quantity.number_gaps("t").alias("g"))
    assert [[(g["unit"], g["state"]) for g in r["g"]] for r in df.collect()] == [w for _, w in GAP_CASES] + [[]]


def test_specs(spark):
    texts = ['{"a":200.0,"b":[1.5,-3.0,1.0E3],"c":"x 2.0 \\" 3.0","d":0.5,"e":-0.0,"f":1e400}', "7.0", None, "{}", '"1.0"']
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(specs.spec_numbers(F.col("t"))).collect()]
    assert got == ['{"a":200,"b":[1.5,-3,1000],"c":"x 2.0 \\" 3.0","d":0.5,"e":0,"f":1e400}', "7", None, "{}", '"1.0"']
    nested = F.struct(F.lit(3.0).alias("x"), F.lit(None).cast("string").alias("y"))
    assert one(spark, specs.spec(F.lit(2.0).alias("a"), nested.alias("n"), F.col("t").alias("gone")), t=None) == '{"a":2,"n":{"x":3}}'
    for value, want in (('"w"', '{"field":"w"}'), ('["a",{"field":"b"}]', '[{"field":"a"},{"field":"b"}]'), ('{"field":"c"}', '{"field":"c"}'), ("3", "3")):
        assert one(spark, specs.channel_settings(F.col("v")), v=value) == want
    cases = [
        ("F001, F002", None, []), (" ,", "assets/a.svg", ["no facts"]), ("F1,F1", "./assets/x/../a.SVG", ["fact twice"]), ("F1", "../assets/a.svg", ["outside assets"]), ("F1", "assets/../a.svg", ["outside assets"]), ("F1", "/assets/a.svg", ["outside assets"]), ("F1", "assets/a.png", ["not svg"]),
        ("F1", "a.svg", ["outside assets"]), ("F1", "x/../../w/assets/a.svg", ["outside assets"]), (None, "assets", ["no facts", "outside assets", "not svg"]),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    assert [r[0] for r in df.orderBy("i").select(specs.argument_issues(F.col("a"), F.col("b"))).collect()] == [w for *_, w in cases]
    names = [" A  topic:! ", "시장  조사?", "", "_", "x" * 39 + " y", None]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(specs.slug(F.col("n"))).collect()
    assert [r[0] for r in rows] == [slug(n or "") for n in names]


def test_growth(spark):
    cases = [
        (("100", 2020, "121", 2022, "10", 2020, 2022), "MATCH"), (("100", 2020, "121", 2022, "10", None, None), "NOT_CHECKABLE"), (("100.00", 2020, "160.00", 2025, "10", 2020, 2025), "CONFLICT"),
        (("100.00", 2020, "160.00", 2025, "9.856", 2020, 2025), "MATCH"), (("100", 2020, "121", 2022, "10", 2019, 2022), "NOT_CHECKABLE"), (("-1", 2020, "1", 2022, "10", 2020, 2022), "INVALID_INPUT"),
        (("0.4", 2020, "x", 2022, "10", 2020, 2022), "INVALID_INPUT"), (("1", 2022, "2", 2022, "10", 2022, 2022), "INVALID_INPUT"), (("0", 2020, "2", 2022, "10", 2020, 2022), "INVALID_INPUT"), ((None, 2020, "2", 2022, "10", 2020, 2022), "NOT_CHECKABLE"),
    ]
    df = spark.createDataFrame([(i, *row) for i, (row, _) in enumerate(cases)], "i int, a string, b int, c string, d int, e string, f int, g int")
    got = df.select("i", quantity.check_cagr("a", "b", "c", "d", "e", "f", "g").alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == [want for _, want in cases]


def test_reports(spark):
    text = "# T\nOne 3.5 ends... here. Two (a. b.) ends.(F001) Three!\n\n| a | b |\n|---|---|\n| 1 | x \\| y |\n\n```\n## no\n```\n## S\nq"
    assert markdown.segments_of(text)[1:4] == ["One 3.5 ends... here.", "Two (a. b.) ends.(F001)", "Three!"]
    docs = spark.createDataFrame([(1, text)], "k int, t string")
    numbered = markdown.lines(docs, "k", "t")
    found = markdown.tables(numbered, "k").first()
    assert found.header == ["a", "b"] and found.rows == [["1", "x | y"]] and (found.start, found.end) == (4, 6)
    s = markdown.sections(numbered, "k")
    assert {r.section for r in s.collect()} == {None, "S"} and markdown.section_errors(s, "k").count() == 0
    assert [r.sentence for r in markdown.tagged(docs, "k", "t").collect()] == ["Two (a. b.) ends.(F001)"]
    assert one(spark, markdown.body(F.col("t")), t="a\n## Appendix\nb") == "a\n"
    assert one(spark, markdown.labels_of(F.col("t")), t="a, b;c/ a;") == ["a", "b", "c"]
    h = spark.createDataFrame([(1, 1, 1), (1, 3, 2), (1, 5, 2), (1, 9, 1)], "k int, line int, level int")
    assert {r.line: r.end for r in markdown.section_ends(h, "k").collect()} == {1: 8, 3: 4, 5: 8, 9: None}


def test_spans(spark):
    lines = ["- first", "the value is", "12.5 MW in total", "end"]
    assert spans.find_span(lines, "value is 12.5 MW") == (2, 3) and spans.find_span(lines, "value is 2.5") is None
    assert spans.find_span(lines, "first … total") == (1, 3) and spans.find_span(lines, "") is None
    e = spark.createDataFrame([("E1", "value is", None, "a" * 64, ""), ("E2", "nope", "k", None, ""), ("E3", " ", "k", None, ""), ("E4", "x", "zz", None, "")], "id string, verbatim string, clean string, sha256 string, local string")
    d = spark.createDataFrame([("a" * 12, "the\nvalue is"), ("k", "t")], "key string, text string")
    got = {r.evidence_id: (r.state, r.line, r.end) for r in spans.check_spans(e, d).collect()}
    assert got == {"E1": ("passed", 2, 2), "E2": ("not_found", None, None), "E3": ("no_quote", None, None), "E4": ("no_document", None, None)}


def test_rules(spark):
    got = {(r.id, r.rule) for r in literal_cases.ledger_rule_violations(spark, "").collect()}
    assert got == {
        ("F1", "id: pattern"), ("F1", "claim: blank"), ("F003", "status: enum"), ("F003", "observed_at: format"), ("F003", "schema_version: type"), ("F004", "claim: required"),
        ("F004", "unknown field"), ("F004", "evidence_ids: items"), ("F004", "context.metric: required"), ("F004", "context.year: type"),
    }
    raw = spark.createDataFrame([('{"schema_version": 4}',), ('{"schema_versoin": 4, "schema-ver": 1}',), ('{"schema_version": 5}',), ("{}",)], "r string")
    assert [len(r[0]) for r in raw.select(rules.version_rules(F.col("r"))).collect()] == [0, 1, 1, 0]


def test_ledger(spark):
    context = "struct<metric:string,entity:string,entity_id:string,geography:string,period:string,basis:string,scenario:string,definition:string>"
    df = spark.createDataFrame([(("m", "e", None, "", "p", None, None, "é"),)], f"context {context}")
    import hashlib
    import json

    want = "v4:" + hashlib.sha256(json.dumps(["m", "e", None, "", "p", None, None, "é"], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert df.select(ledger.claim_key(F.col("context"))).first()[0] == want
    assert df.select(ledger.old_claim_key(F.col("context"))).first()[0] == "m|e|na|p|na|na"
    have, new = spark.createDataFrame([("F001", "a")], "id string, k string"), spark.createDataFrame([("F001", "b"), ("F002", "c"), ("F003", "d"), ("F004", "d")], "id string, k string")
    kept, refused = ledger.insert(have, new, "id", "k")
    assert {r.id for r in kept.collect()} == {"F001", "F002"} and {r.id for r in refused.collect()} == {"F001", "F003", "F004"}
    seen = spark.createDataFrame([("f", "g1", "u1"), ("f", "g1", "u2"), ("f", None, "u2"), ("f", "g2", None), ("h", None, None)], "fact string, g string, u string")
    assert {r.fact: r.observers for r in ledger.observers(seen, "fact", ["g", "u"]).collect()}["f"] == 2
    facts = spark.createDataFrame([("F001", "confirmed", None, None), ("F002", "draft", None, "old")], "id string, status string, demoted_at string, discard_reason string")
    changes = spark.createDataFrame([("F001", "discarded", "bad")], "id string, new_status string, reason string")
    got = {r.id: (r.status, r.demoted_at, r.discard_reason) for r in ledger.set_status(facts, changes, "now").collect()}
    assert got == {"F001": ("discarded", "now", "bad"), "F002": ("draft", None, "old")}


def test_snapshots(spark):
    a, b = spark.createDataFrame([("x",), ("x",), ("y",)], "v string"), spark.createDataFrame([("x",), ("z",)], "v string")
    assert {tuple(r) for r in snapshots.multiset_diff(a, b, "v").collect()} == {("x", 1, 0), ("y", 1, 0), ("z", 0, 1)}
    with pytest.raises(Exception, match="duplicate key"):
        snapshots.require_unique(a, "v").collect()
    assert snapshots.digest(a, ["v"]).first()[0] == snapshots.digest(a.orderBy(F.desc("v")), ["v"]).first()[0] != snapshots.digest(b, ["v"]).first()[0]
    m = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, sha256 string")
    with pytest.raises(ValueError):
        snapshots.reseal(m, m.where("path = 'p'"))
    more = m.union(spark.createDataFrame([("r", "3")], m.schema))
    assert snapshots.reseal(m, more).count() == 3 and snapshots.manifest_verdict(snapshots.manifest_diff(m, m)).first().ok


def test_logs_and_receipts(spark):
    trace = spark.createDataFrame([([("direct", "fail", "x"), ("mirror", "ok", None)],)], "t array<struct<tier:string,status:string,reason:string>>")
    assert trace.select(logs.replay_row(F.col("t"))).first()[0].asDict() == {"tier": "mirror", "reason": "x"}
    tries = spark.createDataFrame([("u", 0, "fail", 500), ("u", 1, "partial", 200), ("u", 2, "ok", 200), ("v", 0, "fail", 404), ("v", 1, "ok", 200)], "url string, rank int, status string, http int")
    assert {r.url: r.status for r in logs.ladder(tries, "url", "rank", "status", "http").collect()} == {"u": "ok", "v": "fail"}
    got = {r.gate: (r.issues, r.ok) for r in literal_cases.receipt_currency(spark, "").collect()}
    assert got == {"G1": ("", True), "G2": ("prerequisite_G1", False), "G3": ("ref_changed,below_G2", False), "G4": ("failed", False)}
    with pytest.raises(Exception, match="own program"):
        r = spark.createDataFrame([("G", 0)], "gate string, exit int")
        provenance.record(r, r, script_owned=("G",)).collect()


def test_payloads(spark):
    df = spark.createDataFrame([('{"results":[{"title":"<b>T</b>","id":"i","doi":"https://doi.org/10.1/x","publication_year":2020,"abstract_inverted_index":{"b":[1],"a":[0,2]}}]}',)], "p string")
    r = payloads.openalex(df, "p").first()
    assert (r.title, r.doi, r.abstract, r.year) == ("T", "10.1/x", "a b a", 2020)
    page = spark.createDataFrame([('<a class="result__a" href="//d.com/l/?uddg=https%3A%2F%2Fx.org%2Fa&amp;r=1">A <b>b</b></a>',)], "h string")
    assert tuple(payloads.result_page(page, "h").first()) == ("A b", "https://x.org/a")
    feed = spark.createDataFrame([("<feed><entry><title>Error</title></entry><entry><title>T</title><link href='http://x/1'/></entry></feed>",)], "x string")
    assert [(e.title, e.url) for e in payloads.atom_entries(feed, "x").collect()] == [("T", "http://x/1")]


def test_references(spark):
    assert one(spark, refs.author_list(F.array(F.lit("Ann B. Clark"), F.lit("Doe, Jo"))), x=1) == "Clark, A. B., & Doe, J."
    assert one(spark, refs.doi_of(F.col("u")), u="https://arxiv.org/abs/2101.00001v2") == "10.48550/arXiv.2101.00001"
    assert one(spark, refs.title_match(F.lit("Deep learning models"), F.lit("models of deep nets"))) and not one(spark, refs.title_match(F.lit("Deep learning models"), F.lit("shallow")))
    assert one(spark, refs.comma_parts(F.lit("a, b (c, d), e"))) == ["a", "b (c, d)", "e"]
    assert one(spark, refs.page_title(F.lit("A story - The Site"))) == "A story"


def test_images_and_boxes(spark):
    page = "<figure><img src='/a.png'><figcaption>Cap <b>x</b></figcaption></figure><p>near</p><img src='b.png' alt='B'><img src='/a.png'>"
    assert [(i["url"], i["caption"]) for i in html.images_of(page, "http://x.org/p/")] == [("http://x.org/a.png", "Cap x"), ("http://x.org/p/b.png", None)]
    assert html.merge_rectangles([(0, 0, 1, 1), (0.5, 0.5, 2, 2), (5, 5, 6, 6)]) == [(0, 0, 2, 2), (5, 5, 6, 6)]


def test_semantics(spark):
    df = spark.createDataFrame([(2000 + i, float(i), "Jan" if i % 2 else "Feb", None) for i in range(12)], "saleYear int, v double, m string, n string")
    got = {r.column: (r.semantic, r.type) for r in semantics.field_semantics(df).collect()}
    assert got["saleYear"][0] == "Year" and got["v"] == ("Quantity", "quantitative") and got["m"][0] == "Category"
    assert semantics.ordinal_order(["Mar", "Jan", "other", "Feb"]) == ["Jan", "Feb", "Mar", "other"] and semantics.ordinal_order(["a", "b"]) is None
    assert semantics.granularity(["2020-01-01", "2021-01-01"]) == "year" and semantics.two_digit_year(50) == 1950 and semantics.epoch_unit(1.6e12) == "ms"


def test_charts(spark):
    assert charts.nice_step(0, 100, 10) == 10 and charts.nice_step(0, 0, 5) == 1
    assert charts.facet_grid(7, 1, 3, 5)["columns"] == 2 and charts.facet_grid(2, 2, 3, 3)["most"] == 4
    none = spark.createDataFrame([], "v double")
    assert charts.histogram(none, "v").count() == 0 and charts.density(none, "v", 1.0).count() == 0
    with pytest.raises(ValueError):
        charts.check_limits(spark.range(30), "id", "category")
    facts = spark.createDataFrame([("F001", "confirmed"), ("F002", "draft")], "id string, status string")
    assert [r.id for r in charts.confirmed_rows(facts, ["F001"]).collect()] == ["F001"]
    with pytest.raises(Exception, match="not confirmed"):
        charts.confirmed_rows(facts, ["F001", "F002"]).collect()
    poly = spark.createDataFrame([(float(x), 1 + 2.0 * x + 3.0 * x * x) for x in range(6)], "x double, y double")
    assert [round(c, 6) for c in charts.regression(poly, "x", "y", method="quad").first().coefficients] == [1, 2, 3]


def test_coverage(spark):
    truth = spark.createDataFrame([("Acme Corp", ["ACME-corp"]), ("Beta", None)], "name string, aliases array<string>")
    found = spark.createDataFrame([("acmecorp", None), ("Gamma", None), ("gam-ma", None)], "name string, aliases array<string>")
    out = coverage.recall(truth, found)
    assert [r.name for r in out["missed"].collect()] == ["Beta"] and out["extra"].count() == 1 and out["recall"].first().ratio == 0.5


def test_files(spark, tmp_path):
    at = str(tmp_path)
    (tmp_path / "facts.jsonl").write_text('{"id": "F001"}\n\n{"id": "F002"}\nbroken\n')
    paths = WorkPaths(at)
    assert files.jsonl(spark, paths.evidence, "id string").count() == 0
    assert files.jsonl(spark, paths.facts, "id string", strict=False).where("id is not null").count() == 2
    with pytest.raises(Exception):
        files.jsonl(spark, paths.facts, "id string").collect()
    assert [(r.line, r.row is None) for r in files.numbered_jsonl(spark, paths.facts, "struct<id:string>").collect()] == [(1, False), (3, False), (4, True)]
    for n in (1, 2):
        files.overwrite(spark.range(n), f"{at}/out")
        assert spark.read.parquet(f"{at}/out").count() == n
    files.overwrite_all({"a": spark.range(3)}, f"{at}/db")
    assert spark.read.parquet(f"{files.current_version(spark, f'{at}/db')}/a").count() == 3
    tree = {r.path: r.label for r in files.file_tree(spark, at).collect()}
    assert tree["facts.jsonl"] == "facts" and slug(" A  topic:! ") == "A_topic!" and slug("/ ? ") == "untitled"
