"""Queries that must cover their whole table, and steps against plainer versions."""

import pyarrow as pa
from pyspark.sql import functions as F

from quillmark.catalog import table
from quillmark.functions import arrow, specs
from quillmark.operators import alignment
from quillmark.plans import ledgers
from quillmark.sources import manuscript, markdown

FOLDER = "/root/testdata/sf0.001"


def test_every_page_is_decoded(spark):
    rows = ledgers.page_decoding(spark, FOLDER).collect()
    assert sorted(r.page_id for r in rows) == sorted(r.page_id for r in table(spark, FOLDER, "pages").select("page_id").collect())
    assert {(r.header, r.meta) for r in rows} == {("utf-8", None), (None, "iso-8859-1"), ("utf-16be", None), ("latin-1", None)}


def test_every_unit_is_resolved(spark):
    found = {r.unit: (r.dimension, r.power) for r in ledgers.unit_table(spark, FOLDER).collect()}
    assert len(found) == 15 and found["백만 EUR"] == ("EUR", 6) and found["USD_X"] == ("UNSUPPORTED", 0) and found[""] == (None, 0)


def test_parts_and_blocks_from_one_pass(spark):
    text = "intro\n# Ⅰ. One/a\n## h\n![i](x.png)\n## Ⅱ. Two\n### deep\nend"
    docs = spark.createDataFrame([(1, text), (2, "no chapter"), (3, "# Ⅰ. only"), (4, "")], "k int, t string")
    lines = markdown.lines(docs, "k", "t")
    whole = sorted(tuple(r) for r in manuscript.parts_of(docs, "k", "t", nested=True).collect())
    assert whole == sorted(tuple(r) for r in manuscript.parts(lines, "k", nested=True).collect())
    assert [r[4] for r in whole] == ["00_서문.md", "Ⅰ_Onea.md", "Ⅱ_Two.md", "00_서문.md", "Ⅰ_only.md"] and whole[2][5] == "# Ⅱ. Two\n## deep\nend\n" and "](../x.png)" in whole[1][5]
    found = manuscript.blocks(manuscript.in_parts(lines, "k"), "k", "numeral").where("k = 1").orderBy("line").collect()
    assert [(r.t, r.numeral) for r in found] == [("body1", None), ("title", "Ⅰ"), ("h1", "Ⅰ"), ("image", "Ⅰ"), ("h1", "Ⅱ"), ("h2", "Ⅱ"), ("body1", "Ⅱ")]


def test_slices_are_bounded_by_bytes():
    column = pa.array(["x" * 300_000] * 9 + ["y"] * 5000 + [None])
    parts = list(arrow.slices(column))
    assert pa.concat_arrays(parts).equals(column) and max(len(p) for p in parts) <= arrow.ROWS and max(p.nbytes for p in parts) <= arrow.BYTES
    assert sum(len(a) for a, b in arrow.slices(column, column) if a.equals(b)) == len(column)


def test_whole_numbers_of_specifications(spark):
    cases = {
        '{"a":7.0,"b":"7.0 \\" 8.0","c":-0.0,"d":-12.00,"e":1.50,"f":10}': '{"a":7,"b":"7.0 \\" 8.0","c":0,"d":-12,"e":1.50,"f":10}',
        '{"a":1.5E3,"b":2.0}': '{"a":1500,"b":2}',
        '{"a":' + "1" * 40 + '.0}': '{"a":' + "1" * 40 + ".0}",
        '{"a":1.00000001,"b":"' + "z" * 50_000 + '","c":[3.0,4.0]}': '{"a":1.00000001,"b":"' + "z" * 50_000 + '","c":[3,4]}',
    }
    rows = spark.createDataFrame([(j,) for j in cases], "j string").select("j", specs.spec_numbers(F.col("j")).alias("n")).collect()
    assert {r.j: r.n for r in rows} == cases


def test_lists_with_nulls_are_aligned(spark):
    left = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "b"), (2, 1, "x")], "k int, p int, t string")
    right = spark.createDataFrame([(1, 1, None), (1, 2, "b"), (3, 5, "y")], "k int, p int, t string")
    got = sorted(map(str, (tuple(r) for r in alignment.aligned(left, right, "k", "p", "t").collect())))
    want = [(1, 3, 2, "b", "match"), (1, 1, None, "a", "missing"), (1, 2, None, None, "missing"), (1, None, 1, None, "extra"), (2, 1, None, "x", "missing"), (3, None, 5, "y", "extra")]
    assert got == sorted(map(str, want))
