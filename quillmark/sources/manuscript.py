"""Manuscripts of reports: blocks with captions and sources, parts by Roman numerals, outlines.

The grammar depends on what came before a line (a caption waits for its table, a source line
belongs to the table it follows, a figure's caption to the last image). Every such rule is a
running count or a lag over a document's lines, so one shuffle by document serves them all, and
a document is never longer than the text it came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks of the manuscript grammar.
TABLE_MARK, FIGURE_MARK = "<표>", "[그림]"
FORMAT = r"\s*\{형식=([^}]*)\}\s*$"
FORMATS = ("A", "B", "matrix")
NUMERALS = "ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ"
CHAPTER = rf"^(#{{1,2}})\s+([{NUMERALS}]+)\.\s*(.+)$"
HEADINGS = ("title", "h1", "h2", "h3")
#: Circled numbers head a section up to this display width, else a paragraph.
CIRCLED_WIDTH = 60
PREFACE = "00_서문.md"

_IMAGE = r"^!\[(.*?)\]\((.+?)\)$"
_NOTE = r"^\* ([^:\n]{1,20}) : (.*)$"
_FOOTNOTE = r"^<sup>(\d+\))</sup>\s+(.*)$"
_RULE = r"^:?-{2,}:?$"


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _width(s: Column) -> Column:
    """Characters, those above U+2E80 twice."""
    return F.length(s) + F.length(F.regexp_replace(s, r"[^\x{2E81}-\x{10FFFF}]", ""))


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|", -1), _bare)


def classified(numbered: DataFrame, key: str, *carried: str) -> DataFrame:
    """key, line, s, kind: what each line is by itself: blank, a block kind, `row` of a table or
    one of the captions (table_caption, figure_caption); and the carried columns."""
    s = F.col("s")
    hashes = F.length(F.regexp_extract(s, r"^(#{1,4})\s+", 1))
    kind = (
        F.when(s == "", "blank")
        .when(hashes > 0, F.element_at(F.array(*map(F.lit, HEADINGS)), F.greatest(hashes, F.lit(1))))
        .when(s.rlike(r"^[①-⑳]\s"), F.when(_width(s) <= CIRCLED_WIDTH, "h3").otherwise("body1"))
        .when(s.rlike(_FOOTNOTE), "footnote")
        .when(s.startswith(TABLE_MARK), "table_caption")
        .when(s.startswith(FIGURE_MARK), "figure_caption")
        .when(s.rlike(_IMAGE), "image")
        .when(s.startswith("|"), "row")
        .when(s.rlike(_NOTE), "note")
        .when(s.startswith("- "), "body2")
        .otherwise("body1")
    )
    return numbered.select(key, "line", _bare(F.col("content")).alias("s"), *carried).select(key, "line", "s", kind.alias("kind"), *carried)


def _text(s: Column, kind: Column) -> Column:
    """A block's text without the mark of its kind."""
    footnote = F.concat_ws(" ", F.regexp_extract(s, _FOOTNOTE, 1), F.regexp_extract(s, _FOOTNOTE, 2))
    plain = F.when(s.rlike(r"^[❍○] "), F.substring(s, 3, 1 << 30)).otherwise(s)
    return (
        F.when(kind.isin(*HEADINGS) & s.startswith("#"), F.regexp_replace(s, r"^#+\s+", ""))
        .when(kind == "footnote", footnote)
        .when(kind == "body2", F.substring(s, 3, 1 << 30))
        .when(kind == "body1", plain)
        .when(kind.isin("table", "image"), F.lit(None))
        .otherwise(s)
    )


def blocks(numbered: DataFrame, key: str, *carried: str) -> DataFrame:
    """key, line, t, text, caption, fmt, src, rows, alt, path: the blocks of each document in
    order of their first line, with the carried columns of that line. numbered: key, line,
    content, carried.

    Kinds t are title, h1, h2, h3, body1, body2, note, footnote, image and table. A table is a
    run of lines that begin with a bar, without its rules; a run of rules alone is none. Its
    caption is the last table caption since the table before, its src the note right after it;
    further notes are blocks. The last figure caption after an image is the image's; without an
    image before it, it is dropped, like a table caption that no table follows. fmt is the
    format that a caption asks for: A, B or matrix, else empty. Blank lines end a run only."""
    lines = classified(numbered, key, *carried)
    w = Window.partitionBy(key).orderBy("line")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    is_row = F.col("kind") == "row"
    rule = is_row & F.forall(_cells(F.col("s")), lambda c: c.rlike(_RULE))
    rows = lines.withColumn("rule", rule).withColumn("run", F.sum((is_row & (F.coalesce(F.lag("kind").over(w), F.lit("")) != "row")).cast("int")).over(so_far))
    # a run is a table if it has a line that is no rule; its first line stands for it
    of_run = Window.partitionBy(key, "run", "kind")
    rows = rows.withColumn("table", is_row & (F.count_if(~F.col("rule")).over(of_run) > 0))
    rows = rows.withColumn("opens", F.col("table") & (F.col("line") == F.min("line").over(of_run)))
    single = ~F.col("kind").isin("blank", "row", "table_caption", "figure_caption")
    # what can be followed: blocks, and the first line of tables
    event = F.when(F.col("opens"), "table").when(single, F.col("kind"))
    rows = rows.withColumn("event", event)
    before = F.last("event", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns(
        {
            "source_line": (F.col("kind") == "note") & F.coalesce(before == "table", F.lit(False)),
            "tables": F.sum(F.col("opens").cast("int")).over(so_far),
            "images": F.sum((F.col("kind") == "image").cast("int")).over(so_far),
        }
    )
    of = lambda what, number: F.struct(F.lit(what).alias("of"), number.cast("long").alias("no"))
    role = (
        F.when(F.col("table") | F.col("source_line"), of("table", F.col("tables")))
        .when(F.col("kind") == "table_caption", of("table", F.col("tables") + 1))
        .when(F.col("kind") == "image", of("image", F.col("images")))
        .when(F.col("kind") == "figure_caption", F.when(F.col("images") > 0, of("image", F.col("images"))))
        .when(F.col("event").isNotNull(), of("line", F.col("line")))
    )
    parts = rows.withColumn("role", role).where("role is not null")
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("s")), F.when(F.col("kind") == kind, F.col("line")))
    main = F.col("opens") | (F.col("event").isNotNull() & ~F.col("source_line"))
    own = F.struct("line", F.col("event").alias("t"), "s", *carried)
    body = F.collect_list(F.when(F.col("table") & ~F.col("rule"), F.struct("line", _cells(F.col("s")).alias("cells"))))
    whole = parts.groupBy(key, "role").agg(
        F.min(F.when(main, own)).alias("own"),
        last("table_caption").alias("table_caption"),
        last("figure_caption").alias("figure_caption"),
        F.min(F.when(F.col("source_line"), F.col("s"))).alias("src"),
        body.alias("body"),
    )
    t, s = F.col("own.t"), F.col("own.s")
    caption = _bare(F.substring("table_caption", len(TABLE_MARK) + 1, 1 << 30))
    name = _bare(F.regexp_extract(caption, FORMAT, 1))
    name = F.when(F.lower(name) == "matrix", "matrix").otherwise(F.upper(name))
    return whole.where("own is not null").select(
        key,
        F.col("own.line").alias("line"),
        *[F.col(f"own.{c}").alias(c) for c in carried],
        t.alias("t"),
        _text(s, t).alias("text"),
        F.when(t == "table", F.coalesce(F.regexp_replace(caption, FORMAT, ""), F.lit(""))).when(t == "image", F.coalesce(_bare(F.substring("figure_caption", len(FIGURE_MARK) + 1, 1 << 30)), F.lit(""))).alias("caption"),
        F.when(t == "table", F.when(name.isin(*FORMATS), name).otherwise("")).alias("fmt"),
        F.when(t == "table", F.coalesce("src", F.lit(""))).alias("src"),
        F.when(t == "table", F.transform(F.array_sort("body"), lambda r: r["cells"])).alias("rows"),
        F.when(t == "image", F.regexp_extract(s, _IMAGE, 1)).alias("alt"),
        F.when(t == "image", F.regexp_extract(s, _IMAGE, 2)).alias("path"),
    )


def outline(found: DataFrame, *by: str) -> DataFrame:
    """by and counts of blocks: rows (of all tables; null if there is none), headings of each level, tables, figures with a caption or an
    alternative text, sources (of tables, and notes), footnotes, paragraphs."""
    t = F.col("t")
    count = lambda *kinds: F.count_if(t.isin(*kinds))
    figure = (t == "image") & ((F.col("caption") != "") | (F.col("alt") != ""))
    return found.groupBy(*by).agg(
        *[count(h).alias(h) for h in HEADINGS],
        count("table").alias("tables"),
        F.count_if(figure).alias("figures"),
        F.count_if((t == "note") | ((t == "table") & (F.col("src") != ""))).alias("sources"),
        count("footnote").alias("footnotes"),
        count("body1", "body2", "note", "footnote").alias("paragraphs"),
        F.sum(F.size("rows").cast("bigint")).alias("rows"),
    )


def titles(found: DataFrame, key: str) -> DataFrame:
    """key, line, level (1 to 4), text of the headings."""
    level = F.array_position(F.array(*map(F.lit, HEADINGS)), F.col("t"))
    return found.where(level > 0).select(key, "line", level.cast("int").alias("level"), "text")


def in_parts(numbered: DataFrame, key: str) -> DataFrame:
    """numbered lines with part (0 before the first chapter), numeral and title of the part's
    chapter and promoted (chapters of the second level, whose headings go up by one)."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("content").rlike(CHAPTER)
    head = F.when(opens, F.struct(*[F.regexp_extract("content", CHAPTER, i).alias(n) for i, n in ((1, "hashes"), (2, "numeral"), (3, "title"))]))
    rows = numbered.withColumns({"part": F.sum(opens.cast("int")).over(w), "_head": F.last(head, ignorenulls=True).over(w)})
    return rows.select(*numbered.columns, "part", F.col("_head.numeral").alias("numeral"), F.col("_head.title").alias("title"), F.coalesce(F.col("_head.hashes") == "##", F.lit(False)).alias("promoted"))


def parts(numbered: DataFrame, key: str, nested: bool = False) -> DataFrame:
    """key, part, numeral, title, name, text: the modules that a manuscript is cut into.

    A chapter is a heading of the first or second level with a Roman numeral; what is before the
    first one is the preface, which is dropped if it is blank. In parts of the second level every
    heading goes up by one. nested: modules lie in a folder below, so relative link targets get
    ../ before them. Names leave out white space, slashes and colons of the title."""
    whole = numbered.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]).alias("_lines"))
    return _cut(whole, key, nested)


def parts_of(docs: DataFrame, key: str, text: str, nested: bool = False) -> DataFrame:
    """parts of whole texts, which are cut where they are: nothing is shuffled or sorted."""
    return _cut(docs.select(key, F.split(text, "\n", -1).alias("_lines")), key, nested)


def _cut(docs: DataFrame, key: str, nested: bool) -> DataFrame:
    """parts of documents with their lines in an array: chapters are places in it, parts slices."""
    head = lambda x, at: F.when(x.rlike(CHAPTER), F.struct((at + 1).alias("at"), *[F.regexp_extract(x, CHAPTER, i).alias(n) for i, n in ((1, "hashes"), (2, "numeral"), (3, "title"))]))
    preface = F.struct(F.lit(1).alias("at"), *[F.lit(None).cast("string").alias(n) for n in ("hashes", "numeral", "title")])
    heads = docs.select(key, "_lines", F.concat(F.array(preface), F.array_compact(F.transform("_lines", head))).alias("_heads"))
    rows = heads.select(key, "_lines", F.transform("_heads", lambda h: h["at"]).alias("_at"), F.posexplode("_heads").alias("part", "h"))
    ends = F.coalesce(F.get("_at", F.col("part") + 1), F.size("_lines") + 1)
    rows = rows.select(key, "part", F.col("h.numeral").alias("numeral"), F.col("h.title").alias("title"), (F.col("h.hashes") == "##").alias("promoted"), F.slice("_lines", F.col("h.at"), ends - F.col("h.at")).alias("_lines"))
    raised = lambda x: F.when(x.rlike(r"^#{2,5}\s"), F.substring(x, 2, 1 << 30)).otherwise(x)
    lines = F.when(F.col("promoted"), F.transform("_lines", raised)).otherwise(F.col("_lines"))
    if nested:
        lines = F.transform(lines, lambda x: F.regexp_replace(x, r"\]\((?!http|/|\.\.)([^)]*)\)", "](../$1)"))
    out = rows.select(key, "part", "numeral", "title", F.array_join(lines, "\n").alias("text"))
    name = F.when(F.col("part") == 0, PREFACE).otherwise(F.concat("numeral", F.lit("_"), F.regexp_replace("title", r"[\s/:]+", ""), F.lit(".md")))
    ended = F.when((F.col("text") != "") & ~F.endswith("text", F.lit("\n")), F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    return out.where((F.col("part") > 0) | F.col("text").rlike(r"\S")).select(key, "part", "numeral", "title", name.alias("name"), ended.alias("text"))


def part_errors(split: DataFrame, key: str, expected: int | None = None) -> DataFrame:
    """key, error: no chapter, another number of chapters than expected, or two of one name."""
    found = split.groupBy(key).agg(F.count_if(F.col("part") > 0).alias("n"), F.count_distinct(F.when(F.col("part") > 0, F.col("name"))).alias("names"))
    wrong = [F.when(F.col("n") == 0, "no chapter"), F.when(F.col("names") < F.col("n"), "two parts of one name")]
    if expected is not None:
        wrong.append(F.when((F.col("n") > 0) & (F.col("n") != expected), "unexpected number of chapters"))
    return found.select(key, F.explode(F.array_compact(F.array(*wrong))).alias("error"))
