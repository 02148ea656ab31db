"""Orders by ranges, chart encodings, report checks, quotes in documents."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import decode
from quillmark.operators import charts, encodings, ordering, reports, spans
from quillmark.operators import quotes as quotes_module


def test_places_and_sums_by_ranges(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None, "c"]), float(rng.randint(-5, 5))) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, k string, v double").repartition(7)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    assert ordering.with_ranges(df, ["k", "id"], 8).select("_range").distinct().count() > 4
    got = {r.id: r.place for r in ordering.numbered(df, "place", ["k", "id"], 8).collect()}
    assert got == {r[0]: i for i, r in enumerate(order, 1)}
    sums, so_far = {}, 0.0
    for r in order:
        sums[r[0]] = so_far
        so_far += r[2]
    assert {r.id: r.before for r in ordering.running_sum(df, "before", F.col("v"), ["k", "id"], 8).collect()} == sums
    last = {r.id: r.last for r in ordering.with_previous(df.select("id"), "last", "id", 8).collect()}
    assert last == {i: i - 1 if i else None for i in range(4000)}
    assert ordering.numbered(df.limit(0), "place", ["id"]).count() == 0
    assert ordering.with_previous(df.limit(0).select("id"), "last", "id").count() == 0


def test_strides(spark):
    df = lambda *v: spark.createDataFrame([(float(x),) for x in v], "v double")
    one = lambda f, *v: f(df(*v), "v").first()[0]
    assert one(charts.equal_stride, 1, 2, 3, 4) is True and one(charts.equal_stride, 1, 2, 3, 5) is False and one(charts.equal_stride, 1) is False
    assert one(charts.min_gap, 5, 1, 9) == 4 and one(charts.min_gap, 5) is None


def test_waterfall_with_total(spark):
    df = spark.createDataFrame([(1, 5.0), (2, -2.0), (3, None), (4, 3.0)], "o int, v double")
    got = [(r.ordinal, r.start, r.end, r["class"]) for r in charts.waterfall(df, "v", "o", total_last=True).orderBy("o").collect()]
    assert got == [(1, 0.0, 5.0, "increase"), (2, 5.0, 3.0, "decrease"), (3, 3.0, 3.0, "increase"), (4, 0.0, 3.0, "total")]


def test_quotes_of_all_lengths(spark):
    rng = random.Random(1)
    words = ["alpha", "be", "c.", "delta,", "été", "f"]
    docs = [(i, rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(90, None), (91, ""), (92, "ab")]
    quotes = []
    for i in range(60):
        text = rng.choice(docs[:40])[1]
        a = rng.randrange(len(text) + 1)
        quotes.append((i, text[a : a + rng.randint(0, 70)]))
    quotes += [(100, "not there at all in any of these texts"), (101, None), (102, "b"), (103, "ab"), (104, "")]
    want = sorted((q, d) for q, t in quotes if t is not None for d, u in docs if u is not None and t in u)
    quotes.append((5, quotes[5][1]))
    want = sorted(want + [p for p in want if p[0] == 5])
    frames = spark.createDataFrame(quotes, "q long, text string"), spark.createDataFrame(docs, "d long, text string")
    # all by broadcast, by joins and blocks, and by blocks of a few texts
    for most in (1 << 20, 400, 60):
        got = spans.contained_quotes(*frames, "q", "d", most)
        assert sorted((r.q, r.d) for r in got.collect()) == want
    assert spans.contained_quotes(spark.createDataFrame([], "q long, text string"), spark.createDataFrame(docs, "d long, text string"), "q", "d").count() == 0


def test_sampled_windows_meet():
    rng = random.Random(4)
    for _ in range(300):
        text = bytes(rng.choice(b"ab ") for _ in range(rng.randint(31, 400)))
        a = rng.randrange(len(text) - 30)
        part = text[a : rng.randint(a + 31, len(text))]
        keys = [quotes_module.window_keys(np.frombuffer(x, np.uint8), quotes_module.KEY) for x in (text, part)]
        mine, theirs = ({*k[quotes_module._sampled(k, quotes_module.SPREAD)].tolist()} for k in (keys[1], keys[0]))
        assert mine and mine <= theirs


def plain_inside(text, fragments):
    at = 0
    for f in fragments:
        while True:
            i = text.find(f, at)
            if i < 0:
                return False
            before, after = text[max(0, i - 2) : i], text[i + len(f) : i + len(f) + 2]
            if not ((f[0].isdigit() and re.search(r"\d$|\d[.,]$", before)) or (f[-1].isdigit() and re.match(r"\d|[.,]\d", after))):
                at = i + len(f)
                break
            at = i + 1
    return True


def plain_span(lines, quote, most):
    """Every window of lines, one after the other."""
    fragments = spans._fragments(quote)
    clean = [" ".join(re.sub(r"^\s*(?:[-*+•·]|\d+[.)])\s+", "", x).split()) for x in lines]
    joined = lambda a, b: " ".join(x for x in clean[a : b + 1] if x)
    for a in range(len(clean)):
        for b in range(a, min(len(clean), a + most)):
            if fragments and plain_inside(joined(a, b), fragments):
                while a < b and plain_inside(joined(a + 1, b), fragments):
                    a += 1
                return a + 1, b + 1
    return None


def test_spans_of_random_quotes():
    rng = random.Random(6)
    words = ["a", "b", "1", "12", "2.5", "", "- a", "b a", "3) b", "1,2"]
    found = 0
    for _ in range(4000):
        lines = [rng.choice([" ", "  "]).join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 12))]
        quote = rng.choice([" … ", "...", " "]).join(rng.choice(words) for _ in range(rng.randint(1, 3)))
        most = rng.choice([1, 2, 3, 40])
        want = plain_span(lines, quote, most)
        assert spans.find_span(lines, quote, most) == want, (lines, quote, most)
        found += want is not None
    assert found > 500


def test_files_and_charsets(spark):
    raw = spark.createDataFrame([(bytearray("가나".encode("euc-kr")),), (bytearray("é".encode()),), (bytearray(b"\xff"),), (None,)], "b binary")
    got = [r[0] for r in raw.select(decode.file_text("b")).collect()]
    assert got[1] == "é" and got[2] == "ÿ" and got[3] is None and got[0] is not None


def test_encodings(spark):
    assert encodings.rank_axis("Rank", None, "quantitative", "nominal") == "x" and encodings.rank_axis(None, None, "nominal", "quantitative") == "y"
    df = spark.createDataFrame([("b", 1, 2.0), ("a", 2, 5.0), ("b", 3, 1.0), (None, 4, 9.0)], "c string, t int, v double")
    places = lambda *a, **k: [r.c for r in encodings.ordered_categories(df, "c", *a, **k).orderBy("place").collect()]
    assert places("list", ["a"], arrival="t") == ["a", "b"] and places("data", arrival="t") == ["b", "a"] and places("descending") == ["b", "a"] and places("x", measure="v") == ["b", "a"]
    assert encodings.stack_order(df.where("c = 'a'"), "c", "t").count() == 0
    axis = lambda rows, **k: encodings.stacked_axis(spark.createDataFrame(rows, "c string, v double"), "c", "v", "Percentage", **k).first()
    r = axis([("a", 40.0), ("a", 50.0), ("b", 10.0)])
    assert (r.stacked, r.highest, r.decision, r.min, r.max) == (True, 90.0, "snap", 0.0, 100.0)
    assert axis([("a", 60.0), ("a", 50.0)]).decision == "drop" and axis([("a", 60.0), ("b", 50.0)]).stacked is False
    assert axis([("a", 60.0), ("a", 50.0)], mode="normalize").decision == "data" and axis([("a", 60.0), ("a", 50.0)], mode=None).stacked is False
    assert encodings.intrinsic_domain(df, "v", "Latitude").first().lo == -90 and encodings.intrinsic_domain(df, "v", "Amount").first().lo is None


def test_tables(spark):
    rows = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["x" * 25, "y"])], "t int, row int, cells array<string>")
    widths = spark.createDataFrame([(1, 0, 10), (1, 1, 10)], "t int, column int, width int")
    assert reports.table_heights(rows, widths, ["t"], "cells").first().height == 2 + 1 + 3 + 1
    f = spark.createDataFrame([("F1", "u", "a"), ("F1", "v", "b"), ("F2", "u", "a"), ("F2", "v", "a")], "fact_id string, url string, file string")
    assert {r.fact_id: r.linked for r in reports.card_links(f).collect()} == {"F1": True, "F2": False}
    e = spark.createDataFrame([("E1", None, "ab" * 20, 3, None, None), ("E2", "x", None, None, None, "1:02"), ("E3", "", "", None, None, "")], "id string, span_clean string, sha256 string, line int, end int, t string")
    assert [tuple(r) for r in reports.card_inputs(e).orderBy("id").collect()] == [("E1", "abababababab", "3-3"), ("E2", "x", "t=1:02"), ("E3", None, None)]
    s = reports.audit_summary(spark.createDataFrame([("failure", "a"), ("warning", "a"), ("warning", "b")], "level string, r string"), "r")
    assert {(r.r, r.ok, r.failures, r.warnings) for r in s.collect()} == {("a", False, 1, 1), ("b", True, 0, 1)}
    assert [r[0] for r in spark.createDataFrame([("| a | b  c |",)], "l string").select(reports.cells(F.col("l"))).collect()] == [["a", "b  c"]]
    with pytest.raises(ValueError):
        reports.url_list(f, "url", "file", 0)
