"""Queries of structures: manuscripts, numbers outside the grammar, aligned lists, forms, chart
options, resolved records. Texts are derived from the tables by Spark, the SQL computes what
must be found from the tables themselves."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.catalog import table
from quillmark.functions import quantity
from quillmark.operators import alignment, citations, options
from quillmark.sources import forms, manuscript, markdown
from quillmark.storage import written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _joined(parts: Column, by: str = "\n") -> Column:
    """Texts of (place, text) structs in order."""
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x["t"]), by)


def manuscripts(spark: SparkSession, d: str) -> DataFrame:
    """o_custkey, text: a report per customer: a part per order status, a section per order with a
    table of its lines, followed by a source, two, a bullet or a footnote."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    row = F.format_string("| %d | %s |", "l_linenumber", F.col("l_quantity").cast("string"))
    tables = lines.groupBy("l_orderkey").agg(_joined(F.collect_list(F.struct(F.col("l_linenumber").alias("at"), row.alias("t")))).alias("rows"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    own = F.col("o_orderpriority")
    after = (
        F.when(own.startswith("1"), F.lit("* 출처 : clerk"))
        .when(own.startswith("2"), F.lit("* 출처 : clerk\n* 주 : estimate"))
        .when(own.startswith("3"), F.concat(F.lit("- "), own))
        .when(own.startswith("4"), F.lit("<sup>1)</sup> late"))
        .otherwise(F.lit("![plan](assets/a.png)\n[그림] drawn"))
    )
    text = F.concat(
        F.format_string("## Order %d\n<표> Lines {형식=a}\n\n| line | n |\n|---|---|\n", "o_orderkey"), F.coalesce("rows", F.lit("| none | 0 |")), F.lit("\n"), after
    )
    sections = orders.join(tables, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_custkey", "o_orderstatus", "o_orderkey", text.alias("t"))
    numeral = F.element_at(F.array(F.lit("Ⅰ"), F.lit("Ⅱ"), F.lit("Ⅲ")), F.array_position(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("o_orderstatus")).cast("int"))
    # a customer's sections meet once, in order of their parts; the first of each opens its part
    by = F.array_sort(F.collect_list(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("at"), F.concat(F.lit("# "), numeral, F.lit(". "), "o_orderstatus", F.lit("\n\n")).alias("head"), "t")))
    whole = sections.groupBy("o_custkey").agg(by.alias("s"))
    first = lambda x, i: F.when((i > 0) & (F.get("s", i - 1)["status"] == x["status"]), x["t"]).otherwise(F.concat(x["head"], x["t"]))
    return whole.select("o_custkey", F.concat(F.format_string("Report of %d\n", "o_custkey"), F.array_join(F.transform("s", first), "\n")).alias("text"))


_SECTIONS = """
WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
o AS (
  SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'Ⅰ' WHEN 'O' THEN 'Ⅱ' WHEN 'P' THEN 'Ⅲ' END AS numeral, substr(o_orderpriority, 1, 1)::INT AS p, greatest(coalesce(n, 0), 1) + 1 AS n
  FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)"""


@query(f"""{_SECTIONS}
SELECT o_custkey, numeral, 1::BIGINT AS title, count(*) AS h1, 0::BIGINT AS h2, 0::BIGINT AS h3, count(*) AS tables, count(*) FILTER (p = 5) AS figures, count(*) FILTER (p = 1) + 2 * count(*) FILTER (p = 2) AS sources,
       count(*) FILTER (p = 4) AS footnotes, count(*) FILTER (p IN (2, 3, 4)) AS paragraphs, sum(n)::BIGINT AS rows
FROM o GROUP BY 1, 2
UNION ALL SELECT DISTINCT o_custkey, NULL, 0, 0, 0, 0, 0, 0, 0, 0, 1, NULL FROM o""")
def manuscript_outline(spark: SparkSession, d: str) -> DataFrame:
    """Blocks per part of each report."""
    lines = manuscript.in_parts(markdown.lines(manuscripts(spark, d), "o_custkey", "text"), "o_custkey")
    return manuscript.outline(manuscript.blocks(lines, "o_custkey", "numeral"), "o_custkey", "numeral")


@query(f"""{_SECTIONS}
SELECT o_custkey, numeral, numeral || '_' || CASE numeral WHEN 'Ⅰ' THEN 'F' WHEN 'Ⅱ' THEN 'O' ELSE 'P' END || '.md' AS name, count(*) AS sections FROM o GROUP BY 1, 2
UNION ALL SELECT DISTINCT o_custkey, NULL, '00_서문.md', 0 FROM o""")
def manuscript_parts(spark: SparkSession, d: str) -> DataFrame:
    """The modules that each report is cut into."""
    found = manuscript.parts_of(manuscripts(spark, d), "o_custkey", "text", nested=True)
    return found.select("o_custkey", "numeral", "name", F.size(F.regexp_extract_all("text", F.lit(r"(?m)^## Order \d+$"), F.lit(0))).cast("bigint").alias("sections"))


_UNITS = ["MW", "bbl", "percent", "메가와트를", "그루", "년", "parsec"]


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 1 THEN 'bbl' WHEN 2 THEN 'percent' WHEN 3 THEN '메가와트를' ELSE '그루' END AS unit,
       CASE l_linenumber % 7 WHEN 4 THEN 'warning' ELSE 'failure' END AS state
FROM lineitem WHERE l_linenumber % 7 IN (1, 2, 3, 4)""")
def unit_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with units that the grammar leaves out (F23), in sentences of order lines."""
    unit = F.element_at(F.array(*map(F.lit, _UNITS)), (F.col("l_linenumber") % 7 + 1).cast("int"))
    text = F.format_string("Order 7-B2B has %d %s, worth $%s (F001) since 2020.", F.col("l_quantity").cast("bigint"), unit, F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(quantity.number_gaps(text)).alias("g"))
    return rows.select("l_orderkey", "l_linenumber", "g.unit", "g.state")


@query()
def document_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What F23 finds in whole documents: regular expressions with look-behinds, so no SQL; the
    tests compare it with a character-wise version."""
    docs = table(spark, d, "documents").select("doc_id", F.explode_outer(quantity.number_gaps("text")).alias("g"))
    count = lambda state: F.count_if(F.col("g.state") == state).alias(state)
    return docs.groupBy("doc_id").agg(count("failure"), count("warning"), count("numeral"))


@query("""
WITH e AS (SELECT l_orderkey, l_returnflag = 'R' AS gone, l_tax > 0.07 AS more FROM lineitem)
SELECT l_orderkey, count(*) FILTER (NOT gone) AS matched, count(*) FILTER (gone) AS missing, count(*) FILTER (more) AS extra FROM e GROUP BY 1""")
def aligned_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each order against a list that lacks some and has others besides."""
    lines = table(spark, d, "lineitem")
    item = F.format_string("%d of %d from %d on %s for %s", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("string"), F.col("l_extendedprice").cast("string"))
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    row = lambda df, text, after: df.select("l_orderkey", F.to_json(F.struct(at, F.lit(after).alias("after"))).alias("place"), text.alias("item"))
    expected = row(lines, item, 0)
    found = row(lines.where("l_returnflag <> 'R'"), item, 0).union(row(lines.where("l_tax > 0.07"), F.concat(F.lit("new "), item), 1))
    rows = alignment.aligned(expected, found, "l_orderkey", "place", "item")
    count = lambda state, name: F.count_if(F.col("state") == state).alias(name)
    return rows.groupBy("l_orderkey").agg(count("match", "matched"), count("missing", "missing"), count("extra", "extra"))


@query()
def aligned_copies(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each document against those of the one before it that begins with the same
    sentence: what near copies share, in order. Tests compare it with a table of all prefixes."""
    docs = written(table(spark, d, "documents").select("doc_id", markdown.segments("text").alias("s")).where(F.size("s") > 0))
    pairs = docs.select("doc_id", F.lag("doc_id").over(Window.partitionBy(F.xxhash64(F.col("s")[0]), F.col("s")[0]).orderBy("doc_id")).alias("other")).where("other is not null")
    listed = lambda by: pairs.join(docs.withColumnRenamed("doc_id", by), by).select("doc_id", F.posexplode("s").alias("place", "item"))
    rows = alignment.aligned(listed("other"), listed("doc_id"), "doc_id", "place", "item")
    count = lambda state, name: F.count_if(F.col("state") == state).alias(name)
    return rows.groupBy("doc_id").agg(count("match", "matched"), count("missing", "missing"), count("extra", "extra"))


@query("""
WITH e AS (SELECT l_orderkey, row_number() OVER w AS n, l_partkey % 50 AS w, l_suppkey % 9 AS h FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
f AS (SELECT l_orderkey, row_number() OVER w AS n, l_partkey % 50 + CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END AS w, l_suppkey % 9 AS h FROM lineitem WHERE l_quantity > 10 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
p AS (SELECT e.l_orderkey, e.n, e.w AS ew, e.h AS eh, f.w AS fw, f.h AS fh FROM e JOIN f USING (l_orderkey, n)),
d AS (SELECT l_orderkey, n, CASE WHEN ew = 0 OR eh = 0 OR fw = 0 OR fh = 0 THEN 'missing_or_zero' WHEN abs(fw / fh - ew / eh) / (ew / eh) > 0.02 THEN 'aspect' END AS defect FROM p),
c AS (SELECT l_orderkey, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b FROM (SELECT l_orderkey, count(*) AS n FROM e GROUP BY 1) a FULL JOIN (SELECT l_orderkey, count(*) AS n FROM f GROUP BY 1) b USING (l_orderkey))
SELECT l_orderkey, n AS place, defect FROM d WHERE defect IS NOT NULL UNION ALL SELECT l_orderkey, NULL, 'count_mismatch' FROM c WHERE a <> b""")
def aspect_defects(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of images as they are against those of a rendered document (P31): some are lost, some are
    wider."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"), "l_quantity", "l_partkey", (F.col("l_partkey") % 50).alias("width"), (F.col("l_suppkey") % 9).alias("height"))
    found = lines.where("l_quantity > 10").withColumn("width", F.col("width") + F.when(F.col("l_partkey") % 4 == 0, 1).otherwise(0))
    return alignment.aspect_defects(lines, found, "l_orderkey", "at").select("l_orderkey", F.col("place").cast("bigint").alias("place"), "defect")


_FORM_HEADER = (
    '<hh:head><hh:fontface lang="HANGUL" fontCnt="2"><hh:font id="0" face="Batang"/><hh:font id="1" face="Gulim"/></hh:fontface>'
    '<hh:charPr id="0" height="1000"><hh:fontRef hangul="0"/></hh:charPr><hh:charPr id="1" height="1400"><hh:fontRef hangul="1"/><hh:bold/></hh:charPr><hh:charPr id="2" height="900"><hh:fontRef hangul="7"/></hh:charPr>'
    '<hh:paraPr id="0"><hh:align horizontal="LEFT"/><hc:left value="5"/><hh:lineSpacing type="PERCENT" value="160"/></hh:paraPr>'
    '<hh:paraPr id="1"><hh:align horizontal="CENTER"/><hp:case><hc:left value="7"/><hh:lineSpacing type="FIXED" value="20"/></hp:case><hc:left value="9"/></hh:paraPr></hh:head>'
)


@F.arrow_udf(T.BinaryType())
def _archive(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Archives with these two members, a few hundred at a time."""

    def one(head: str, body: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(forms.HEADER, head)
            z.writestr(forms.SECTION, body)
        return out.getvalue()

    for heads, bodies in batches:
        for at in range(0, len(heads), 256):
            yield pa.array([one(h, s) for h, s in zip(heads.slice(at, 256).to_pylist(), bodies.slice(at, 256).to_pylist(), strict=True)], pa.binary())


def form_files(spark: SparkSession, d: str) -> DataFrame:
    """o_custkey, content: a form per customer: a paragraph per order, those of open orders in a
    table; the styles are chosen by the order's number."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    p = F.format_string('<hp:p id="%d" paraPrIDRef="%d" styleIDRef="0">\n <hp:run charPrIDRef="%d"><hp:t>x</hp:t></hp:run></hp:p>', "o_orderkey", F.col("o_orderkey") % 2, F.col("o_orderkey") % 4)
    p = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit('<hp:tbl id="1"><hp:tc>'), p, F.lit("\n</hp:tc></hp:tbl>"))).otherwise(p)
    bodies = orders.groupBy("o_custkey").agg(_joined(F.collect_list(F.struct(F.col("o_orderkey").alias("at"), p.alias("t"))), "\n").alias("body"))
    page = F.format_string('<hs:sec><hp:pagePr landscape="W" width="59528" height="%d"><hp:margin header="10" footer="20" left="%d" right="100" top="30" bottom="40"/></hp:pagePr>', F.lit(84188), F.col("o_custkey"))
    return bodies.select("o_custkey", _archive(F.lit(_FORM_HEADER), F.concat(page, "body", F.lit("</hs:sec>"))).alias("content"))


@query("""
WITH u AS (SELECT o_custkey, (o_orderkey % 2)::INT AS para, (o_orderkey % 4)::INT AS char, count(*) AS n FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1, 2, 3)
SELECT o_custkey, para, char, n, CASE char WHEN 0 THEN 'Batang' WHEN 1 THEN 'Gulim' WHEN 2 THEN '' END AS font, CASE char WHEN 0 THEN 10.0 WHEN 1 THEN 14.0 WHEN 2 THEN 9.0 END::DOUBLE AS pt,
       CASE WHEN char < 3 THEN char = 1 END AS bold, CASE para WHEN 0 THEN 'LEFT' ELSE 'CENTER' END AS align, CASE para WHEN 0 THEN 5 ELSE 7 END AS "left", CASE para WHEN 0 THEN '160%' ELSE '20' END AS line_spacing FROM u""")
def form_usage(spark: SparkSession, d: str) -> DataFrame:
    """Styles that the paragraphs of each form outside its tables use."""
    return forms.form_usage(forms.members(form_files(spark, d), "o_custkey"), "o_custkey")


@query("""
WITH c AS (SELECT DISTINCT o_custkey FROM orders)
SELECT o_custkey, 59528 - o_custkey - 100 AS body_w, 84188 - 30 - 40 - 10 - 20 AS body_h, (SELECT count(*) FROM (SELECT DISTINCT o_orderkey % 4 AS k FROM orders o WHERE o.o_custkey = c.o_custkey AND o_orderstatus <> 'O') WHERE k = 3) AS undefined FROM c""")
def form_pages(spark: SparkSession, d: str) -> DataFrame:
    """The body of each form's page, and styles that its header doesn't define."""
    parts = forms.members(form_files(spark, d), "o_custkey")
    lost = forms.undefined_styles(parts, "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("undefined"))
    return forms.page(parts, "o_custkey").join(lost, "o_custkey", "left").select("o_custkey", F.col("body_w").cast("bigint").alias("body_w"), F.col("body_h").cast("bigint").alias("body_h"), F.coalesce("undefined", F.lit(0)).alias("undefined"))


_PLOTTED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("""
WITH v AS (
  SELECT 'l_quantity' AS c, l_quantity::DOUBLE AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem
  UNION ALL SELECT 'l_tax', -l_tax FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber FROM lineitem),
f AS (SELECT c, count(*) FILTER (v < 0) AS neg, count(*) FILTER (v > 0) AS pos, min(v) FILTER (v > 0) AS lo, max(v) FILTER (v > 0) AS hi, sum(v) AS total FROM v GROUP BY c),
t AS (SELECT count(DISTINCT l_shipdate) AS n FROM lineitem)
SELECT c AS chart, 'logScale_y' AS option, neg = 0 AND pos >= 5 AND hi / lo >= 1000 AS applicable, (c = 'l_extendedprice')::VARCHAR AS recommended FROM f WHERE c <> 'l_linenumber'
UNION ALL SELECT c, 'logScale_x', FALSE, NULL FROM f WHERE c <> 'l_linenumber'
UNION ALL SELECT c, 'includeZero_y', c = 'l_discount' OR c = 'l_quantity', (c = 'l_quantity')::VARCHAR FROM f WHERE c <> 'l_linenumber'
UNION ALL SELECT c, 'includeZero_x', FALSE, NULL FROM f WHERE c <> 'l_linenumber'
UNION ALL SELECT c, 'xAxisType', n BETWEEN 2 AND 50, 'temporal' FROM f, t WHERE c <> 'l_linenumber'
UNION ALL SELECT c, 'yAxisType', FALSE, NULL FROM f WHERE c <> 'l_linenumber'
UNION ALL SELECT c, 'independentYAxis', TRUE, NULL FROM f WHERE c <> 'l_linenumber'
UNION ALL SELECT 'table', 'showPercent', neg = 0 OR pos = 0, NULL FROM f WHERE c = 'l_linenumber'""")
def chart_options(spark: SparkSession, d: str) -> DataFrame:
    """Which options apply to line charts of each measure by date, in facets."""
    lines = table(spark, d, "lineitem").withColumn("l_tax", -F.col("l_tax"))
    facts = options.column_facts(lines, _PLOTTED, ["l_shipdate"])
    rows = [(c, "Line Chart", "position", "x", "l_shipdate", "temporal", None, None, None, None) for c in _PLOTTED[:4]]
    zero = {"l_quantity": (True, False), "l_discount": (False, True)}
    for c in _PLOTTED[:4]:
        decided, unsure = zero.get(c, (False, False))
        rows += [(c, "Line Chart", "position", "y", c, "quantitative", "log" if c == "l_extendedprice" else "linear", decided, unsure, None), (c, "Line Chart", "position", "column", "l_returnflag", "nominal", None, None, None, None)]
    rows.append(("table", "Bar Table", "length", "x", "l_linenumber", "quantitative", "linear", None, None, "sum"))
    encodings = spark.createDataFrame(rows, "chart string, chart_type string, mark string, channel string, column string, type string, scale string, zero boolean, zero_uncertain boolean, aggregate string")
    choices = spark.createDataFrame([("l_quantity", "includeZero_y", "true")], "chart string, option string, value string")
    return options.applicable(encodings, facts, choices)


def _wishes(spark: SparkSession, d: str) -> DataFrame:
    """Encodings of a chart per part: categories on x, a measure on y, for some a colour, and
    wishes by the part's number."""
    part = table(spark, d, "part")
    k = F.col("p_partkey")
    by = F.element_at(F.array(F.lit(None).cast("string"), F.lit("x"), F.lit("y"), F.lit("color"), F.lit('["b", "a"]'), F.lit("junk")), (k % 6 + 1).cast("int"))
    order = F.element_at(F.array(F.lit(None).cast("string"), F.lit("ascending"), F.lit("descending")), (F.floor(k / 6) % 3 + 1).cast("int"))
    kind = F.element_at(F.array(F.lit("nominal"), F.lit("ordinal"), F.lit("temporal"), F.lit("quantitative")), (F.floor(k / 18) % 4 + 1).cast("int"))
    none = F.lit(None).cast("string")
    names = ["channel", "column", "type", "aggregate", "sort_by", "sort_order"]
    encoding = lambda *v: F.struct(*[x.alias(n) for x, n in zip(v, names, strict=True)])
    x = encoding(F.lit("x"), F.lit("p_brand"), kind, none, by, order)
    y = encoding(F.lit("y"), F.lit("p_size"), F.lit("quantitative"), F.lit("sum"), none, none)
    colour = encoding(F.lit("color"), F.when(F.col("p_size") % 2 == 0, F.lit("p_type")), F.lit("nominal"), none, none, none)
    canonical = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("a"), F.lit("b")))
    return part.select(k.alias("chart"), "p_size", canonical.alias("canonical"), (F.col("p_size") % 3 == 1).alias("numeric"), F.explode(F.array(x, y, colour)).alias("e")).select("chart", "p_size", "canonical", "numeric", "e.*")


_WISHES = """
WITH w AS (
  SELECT p_partkey AS chart, p_size, [NULL, 'x', 'y', 'color', '["b", "a"]', 'junk'][p_partkey % 6 + 1] AS b, [NULL, 'ascending', 'descending'][p_partkey // 6 % 3 + 1] AS o,
         ['nominal', 'ordinal', 'temporal', 'quantitative'][p_partkey // 18 % 4 + 1] AS k FROM part)"""


@query(f"""{_WISHES}
SELECT chart, CASE
  WHEN b IS NULL AND o IS NOT NULL THEN o
  WHEN b IS NULL AND k NOT IN ('nominal', 'ordinal') THEN 'data'
  WHEN b IS NULL THEN CASE p_size % 3 WHEN 0 THEN 'list' WHEN 1 THEN 'ascending' ELSE 'data' END
  WHEN b = 'x' THEN CASE WHEN o = 'descending' THEN '-x' ELSE 'x' END
  WHEN b = 'y' THEN CASE WHEN o = 'ascending' THEN 'y' ELSE '-y' END
  WHEN b = 'color' THEN CASE WHEN p_size % 2 = 1 THEN 'data' WHEN o = 'ascending' THEN 'color' ELSE '-color' END
  WHEN b = 'junk' OR k = 'temporal' THEN 'data' ELSE 'list' END AS rule,
  CASE WHEN b IS NULL AND o IS NULL AND k IN ('nominal', 'ordinal') AND p_size % 3 = 0 THEN 'a,b' WHEN b LIKE '[%' AND k <> 'temporal' THEN CASE WHEN o = 'descending' THEN 'a,b' ELSE 'b,a' END END AS listed
FROM w""")
def sort_rules(spark: SparkSession, d: str) -> DataFrame:
    """How the categories of each chart are ordered."""
    found = options.sort_rules(spark, _wishes(spark, d)).where("channel = 'x'")
    return found.select("chart", "rule", F.array_join("values", ",").alias("listed"))


@query(f"""{_WISHES},
e AS (SELECT *, CASE WHEN chart % 5 = 0 THEN 'value-desc' WHEN chart % 5 = 1 THEN 'default' WHEN chart % 5 = 2 THEN 'value-asc' END AS wish FROM w),
r AS (SELECT chart, k, CASE wish WHEN 'default' THEN NULL WHEN 'value-desc' THEN 'y' WHEN 'value-asc' THEN 'y' ELSE b END AS b, CASE wish WHEN 'default' THEN NULL WHEN 'value-desc' THEN 'descending' WHEN 'value-asc' THEN 'ascending' ELSE o END AS o FROM e)
SELECT chart, b AS sort_by, o AS sort_order, CASE WHEN b = 'y' THEN CASE WHEN o = 'descending' THEN 'value-desc' ELSE 'value-asc' END END AS shown FROM r WHERE k IN ('nominal', 'ordinal')""")
def sort_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Sort wishes in layers, and what the control shows."""
    k, wishes = F.col("p_partkey"), _wishes(spark, d)
    # two layers: the second wins, a null is no wish
    wish = F.when(k % 5 == 0, "value-desc").when(k % 5 == 1, "default").when(k % 5 == 2, "value-asc")
    layers = table(spark, d, "part").select(k.alias("chart"), F.explode(F.array(F.struct(F.lit(1).alias("layer"), F.when(k % 5 < 3, "value-asc").alias("value")), F.struct(F.lit(2).alias("layer"), wish.alias("value")))).alias("l")).select("chart", "l.*")
    after = options.overridden(wishes, layers)
    return options.shown_sort(after).join(after.where("channel = 'x'").select("chart", "sort_by", "sort_order"), "chart").select("chart", "sort_by", "sort_order", "shown")


@query("""
WITH p AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, row_number() OVER w AS no, lead(o_orderdate) OVER w AS x1, lead(o_totalprice) OVER w AS y1 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, no::INT AS no, o_orderdate AS x0, o_totalprice AS y0, x1, y1, o_orderkey AS colour FROM p WHERE x1 IS NOT NULL""")
def colour_segments(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders by date, in pieces coloured by the order."""
    return options.colour_segments(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_totalprice", "o_orderkey", "o_orderkey")


@query("""
WITH c AS (SELECT c_nationkey, CASE WHEN c_acctbal > 0 THEN -170 + c_acctbal / 90 END AS lon, 18 + c_custkey % 57 AS lat, CASE WHEN c_nationkey % 3 = 0 THEN c_nationkey ELSE c_custkey % 60 END AS place FROM customer),
p AS (SELECT c_nationkey, count(*) FILTER (lon BETWEEN -170 AND -66 AND lat BETWEEN 18 AND 72) AS matched, count(lon + lat) AS n FROM c GROUP BY 1),
k AS (SELECT c_nationkey, count(*) FILTER (place < 50) AS matched, count(*) AS n FROM c GROUP BY 1)
SELECT 'points' AS kind, c_nationkey, CASE c_nationkey % 4 WHEN 0 THEN 'us' WHEN 1 THEN 'world' ELSE CASE WHEN matched < n THEN 'world' ELSE 'us' END END AS scope, matched, n FROM p
UNION ALL SELECT 'places', c_nationkey, CASE WHEN matched < n THEN 'world' ELSE 'us' END, matched, n FROM k""")
def map_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Region of a map per nation, by coordinates and by place ids."""
    c = table(spark, d, "customer").select("c_nationkey", F.when(F.col("c_acctbal") > 0, -170 + F.col("c_acctbal") / 90).alias("lon"), (18 + F.col("c_custkey") % 57).alias("lat"), F.when(F.col("c_nationkey") % 3 == 0, F.col("c_nationkey").cast("bigint")).otherwise(F.col("c_custkey") % 60).alias("place"))
    points = options.map_scopes(c, ["c_nationkey"], "lon", "lat")
    asked = F.when(F.col("c_nationkey") % 4 == 0, "us")
    typed = F.when(F.col("c_nationkey") % 4 == 1, "Country")
    points = points.withColumn("scope", options.picked_scope(asked, typed, F.col("scope")))
    places = options.map_scopes(c, ["c_nationkey"], place_id="place", known=spark.range(50).withColumnRenamed("id", "place_id"))
    return points.select(F.lit("points").alias("kind"), "*").union(places.select(F.lit("places").alias("kind"), "*"))


@query("""
WITH p AS (SELECT page_id, page_id % 9 AS k, html FROM pages), q AS (SELECT count(*) AS parts FROM part)
SELECT page_id, CASE WHEN k = 0 THEN 'manual' WHEN k IN (1, 2, 7) AND page_id < parts THEN 'doi' WHEN k = 3 THEN 'openalex' WHEN k = 4 THEN 'search' WHEN k = 5 THEN 'patent' ELSE 'page' END AS src,
       CASE WHEN k = 0 AND page_id % 2 = 0 THEN 'by hand' WHEN k IN (0, 1, 2, 7) AND page_id < parts THEN 'Part ' || page_id WHEN k = 3 THEN 'Work ' || page_id END AS title,
       CASE WHEN k = 5 THEN (2000 + page_id % 20)::VARCHAR END AS year
FROM p, q""")
def resolved_references(spark: SparkSession, d: str) -> DataFrame:
    """One record per reference, from whichever source comes first (F46, F47): addresses by the
    page's number (an entry by hand, DOIs in the address, a meta field or the text, works, searches,
    patents), titles of the parts as one registry and half of them as another."""
    pages = table(spark, d, "pages").select("page_id", "html")
    k, i = F.col("page_id") % 9, F.col("page_id").cast("string")
    url = (
        F.when(k == 1, F.concat(F.lit("https://doi.org/10.1234/P-"), i)).when(k == 3, F.concat(F.lit("https://api.openalex.org/works/W"), i)).when(k == 4, F.concat(F.lit("https://api.openalex.org/works?search=x%20"), i))
        .when(k == 5, F.concat(F.lit("https://patents.google.com/patent/US"), (2000 + F.col("page_id") % 20).cast("string"), F.lpad(i, 7, "0"), F.lit("A1"))).otherwise(F.concat(F.lit("https://example.org/"), i))
    )
    html = (
        F.when(k == 2, F.concat(F.lit('<meta content="doi:10.1234/p-'), i, F.lit('" name="citation_doi">'), "html")).when(k == 6, F.concat(F.col("html"), F.lit(" doi: 10.1234/p-"), i))
        .when(k == 7, F.concat(F.lit('<meta property="dc.identifier" content="10.1234/p-'), i, F.lit('/">'), "html")).otherwise(F.col("html"))
    )
    refs_ = pages.select("page_id", url.alias("url"), html.alias("html"))
    record = lambda title: F.expr(f"named_struct('kind', 'journal', 'title', {title}, 'authors', array('A. B.'), 'year', cast(null as string), 'container', cast(null as string), 'doi', cast(null as string))")
    registry = table(spark, d, "part").select(F.concat(F.lit("10.1234/P-"), F.col("p_partkey").cast("string")).alias("doi"), record("concat('Part ', p_partkey)").alias("record"))
    other = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("10.1234/p-"), F.col("p_partkey").cast("string")).alias("doi"), record("'second choice'").alias("record"))
    manual = refs_.where(F.col("page_id") % 9 == 0).select("url", record("if(page_id % 2 = 0, 'by hand', null)").alias("record"), F.concat(F.lit("10.1234/P-"), F.col("page_id").cast("string")).alias("doi"))
    works = refs_.where(F.col("page_id") % 9 == 3).select("url", record("concat('Work ', page_id)").alias("record"))
    won = citations.resolved(refs_, manual, [registry, other], works).join(refs_.select("page_id", "url"), "url")
    shown = F.col("src").isin("manual", "doi", "openalex")
    return won.select("page_id", "src", F.when(shown, F.col("record.title")).alias("title"), F.when(F.col("src") == "patent", F.col("record.year")).alias("year"))
