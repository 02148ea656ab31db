"""Reports and worker returns: segments, sections, tables, blocks.

Line-based structures are windows over numbered lines (a running sum marks what a line belongs
to). Sentence segmentation needs nested brackets and is an Arrow UDF per text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import arrow
from quillmark.functions.text import collapse

APPENDIX_MARK = r"(?m)^[ \t]*<!--\s*FACTSHEET:APPENDIX\s*-->[ \t]*$"
APPENDIX_HEAD = r"(?m)^#{1,6}\s*(?:부록|Appendix)\b.*$"


def body(text: Column) -> Column:
    """What stands before the appendix: before its mark, else before its last heading."""
    by_mark = F.split(text, APPENDIX_MARK, 2)
    heads = F.regexp_extract_all(text, F.lit(APPENDIX_HEAD), F.lit(0))
    parts = F.split(text, APPENDIX_HEAD, -1)
    last = F.length(F.element_at(parts, -1)) + F.length(F.try_element_at(heads, F.lit(-1)))
    cut = F.substring(text, F.lit(1), (F.length(text) - last).cast("int"))
    return F.when(F.size(by_mark) > 1, by_mark[0]).when(F.size(heads) > 0, cut).otherwise(text)


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), content."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("_p", "content")).select(key, (F.col("_p") + 1).alias("line"), "content")


def sections(numbered: DataFrame, key: str, marks: str = "^## ") -> DataFrame:
    """lines with section (its heading) and number of it; headings in code fences are text.
    A window over each document's lines: as long as a document, never longer."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.sum(F.col("content").rlike(r"^\s*(?:```|~~~)").cast("int")).over(w)
    head = F.col("content").rlike(marks) & (fence % 2 == 0)
    out = numbered.withColumns({"_head": head, "fence_open": fence % 2 == 1})
    out = out.withColumns({"section_no": F.sum(F.col("_head").cast("int")).over(w), "section": F.last(F.when(F.col("_head"), F.trim(F.regexp_replace("content", r"^#+\s*", ""))), ignorenulls=True).over(w)})
    return out.drop("_head")


def section_errors(sectioned: DataFrame, key: str) -> DataFrame:
    """key, error: sections that occur twice, and a fence that isn't closed."""
    twice = sectioned.where("section is not null").groupBy(key, "section").agg(F.count_distinct("section_no").alias("n")).where("n > 1").select(key, F.concat(F.lit("duplicate section: "), F.col("section")).alias("error"))
    last = sectioned.groupBy(key).agg(F.max_by("fence_open", "line").alias("o")).where("o").select(key, F.lit("unclosed fence").alias("error"))
    return twice.union(last)


def section_ends(headings: DataFrame, key: str) -> DataFrame:
    """headings (key, line, level) with end: the line before the next heading of the same or a
    higher level, null for the last."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    later = F.collect_list(F.struct("line", "level")).over(w)
    return headings.withColumn("_next", F.filter(later, lambda h: h["level"] <= F.col("level"))).withColumn("end", F.try_element_at("_next", F.lit(1))["line"] - 1).drop("_next")


def headings(numbered: DataFrame, key: str) -> DataFrame:
    found = F.regexp_extract("content", r"^(#{1,6})\s+\S", 1)
    return numbered.where(found != "").select(key, "line", F.length(found).alias("level"), F.trim(F.regexp_replace("content", r"^#+\s*", "")).alias("title"))


def cells(line: Column) -> Column:
    """Cells of a pipe-table line; an escaped bar is text."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(F.split(bare, r"(?<!\\)\|", -1), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))


def tables(numbered: DataFrame, key: str, stop: str = APPENDIX_MARK) -> DataFrame:
    """key, start, end, header, rows of each pipe table: adjacent pipe lines, the second one a
    rule; nothing after the appendix mark."""
    w = Window.partitionBy(key).orderBy("line")
    ended = F.max(F.col("content").rlike(stop).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    pipe = F.col("content").rlike(r"^\s*\|.*\|\s*$") & (ended == 0)
    rows = numbered.withColumn("_pipe", pipe)
    new = F.col("_pipe") & ~F.coalesce(F.lag("_pipe").over(w), F.lit(False))
    rows = rows.withColumn("_new", new.cast("int")).withColumn("_table", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_pipe")
    whole = rows.groupBy(key, "_table").agg(F.min("line").alias("start"), F.max("line").alias("end"), F.array_sort(F.collect_list(F.struct("line", "content"))).alias("_l"))
    rule = F.try_element_at("_l", F.lit(2))["content"].rlike(r"^\s*\|(?:\s*:?-+:?\s*\|)+\s*$")
    return whole.where(rule).select(key, "start", "end", cells(F.col("_l")[0]["content"]).alias("header"), F.transform(F.slice("_l", 3, 100000000), lambda x: cells(x["content"])).alias("rows"))


def labels_of(text: Column) -> Column:
    """Names split at commas, semicolons, slashes and their wide forms."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[,，、;/]"), lambda x: F.trim(x)), lambda x: x != ""))


def universe(numbered: DataFrame, key: str) -> DataFrame:
    """name, aliases, sources, include, reason of a universe table of five cells or more; the
    header and rule lines are skipped."""
    c = numbered.where(F.col("content").rlike(r"^\s*\|")).select(key, "line", cells(F.col("content")).alias("c"))
    c = c.where((F.size("c") >= 5) & ~F.col("c")[0].rlike(r"^:?-+:?$") & ~F.lower(F.col("c")[0]).isin("이름", "name", "대상"))
    return c.select(key, "line", F.col("c")[0].alias("name"), labels_of(F.col("c")[1]).alias("aliases"), F.col("c")[2].alias("sources"), F.col("c")[3].alias("include"), F.col("c")[4].alias("reason"))


def universe_by_header(found: DataFrame, names: dict[str, list[str]], flags: dict[str, bool]) -> DataFrame:
    """The same from tables whose columns are told by their header. names: column -> header
    words; flags: word -> included. A word that isn't a flag fails."""
    at = {c: F.array_position(F.transform("header", lambda h: F.lower(h).isin(*words)), True) for c, words in names.items()}  # noqa: B023
    rows = found.where(at["name"] > 0).select(*[a.alias(f"_{c}") for c, a in at.items()], F.explode("rows").alias("r"))
    cell = lambda c: F.when(F.col(f"_{c}") > 0, F.try_element_at("r", F.col(f"_{c}").cast("int")))
    flag = F.lit(None).cast("boolean")
    for word, value in flags.items():
        flag = F.when(F.lower(F.trim(cell("include"))) == word, F.lit(value)).otherwise(flag)
    checked = F.when(flag.isNull(), F.raise_error(F.concat(F.lit("unknown flag: "), F.coalesce(cell("include"), F.lit("null")))).cast("boolean")).otherwise(flag)
    return rows.select(cell("name").alias("name"), labels_of(F.coalesce(cell("aliases"), F.lit(""))).alias("aliases"), checked.alias("include"))


def found_list(spark, path: str) -> DataFrame:
    """name, aliases of a list of findings: .jsonl and .json (texts, or objects with name, or
    facts), .md tables, or plain lines."""
    kind = path.rsplit(".", 1)[-1].lower()
    whole = spark.read.text(path, wholetext=True)
    none = F.array().cast("array<string>")
    if kind in ("json", "jsonl"):
        raw = F.explode(F.from_json("value", "array<string>")) if kind == "json" else F.explode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""))
        item = whole.select(raw.alias("x"))
        text = F.when(F.try_parse_json("x").isNull(), F.col("x")).when(F.schema_of_variant(F.try_parse_json("x")) == "STRING", F.get_json_object(F.concat(F.lit('{"v":'), "x", F.lit("}")), "$.v"))
        name = F.coalesce(text, F.get_json_object("x", "$.name"), F.get_json_object("x", "$.context.entity"), F.get_json_object("x", "$.subject"))
        return item.select(F.trim(name).alias("name"), F.coalesce(F.from_json(F.get_json_object("x", "$.aliases"), "array<string>"), none).alias("aliases")).where(F.length("name") > 0)
    numbered = lines(whole.withColumn("key", F.lit(1)), "key", "value")
    if kind == "md":
        t = tables(numbered, "key").select(F.explode("rows").alias("r"))
        return t.select(F.col("r")[0].alias("name"), labels_of(F.coalesce(F.try_element_at("r", F.lit(2)), F.lit(""))).alias("aliases")).where(F.length("name") > 0)
    bare = F.trim(F.regexp_replace("content", r"^\s*(?:[-*+]|\d+[.)])\s+", ""))
    return numbered.select(bare.alias("name"), none.alias("aliases")).where((F.length("name") > 0) & ~F.col("name").startswith("#"))


def truth_list(spark, path: str) -> DataFrame:
    """name, aliases, fact_count; fails on an entry without a name or with a count below 1."""
    rows = spark.read.schema("name string, aliases array<string>, fact_count long").option("multiLine", True).json(path)
    bad = (F.length(F.trim(F.coalesce("name", F.lit("")))) == 0) | ~F.coalesce(F.col("fact_count") >= 1, F.lit(False))
    return rows.where(F.when(bad, F.raise_error(F.lit("truth entries need a name and a count")).cast("boolean")).otherwise(F.lit(True)))


def references(numbered: DataFrame, key: str, title: str = r"(?i)^#{1,6}\s*(?:references|참고문헌|출처)") -> DataFrame:
    """key, line, url of the reference section's table rows and bullets."""
    s = sections(numbered, key, r"^#{1,6}\s").withColumn("_in", F.last(F.when(F.col("content").rlike(r"^#{1,6}\s"), F.col("content").rlike(title)), ignorenulls=True).over(Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    url = F.regexp_extract("content", r"https?://[^\s|)>\]]+", 0)
    return s.where(F.col("_in") & F.col("content").rlike(r"^\s*(?:\||[-*+]|\d+[.)])")).select(key, "line", url.alias("url")).where("url <> ''")


def chapters(numbered: DataFrame, key: str) -> DataFrame:
    """key, part, title, text: parts start at headings with Roman numerals; what is before the
    first one is part 0."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("content").rlike(r"^#{1,2}\s+[IVXⅠ-Ⅻ]+\s*[.)]")
    rows = numbered.withColumn("part", F.sum(head.cast("int")).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n")
    return rows.groupBy(key, "part").agg(F.first(F.when(head, F.trim(F.regexp_replace("content", r"^#+\s*", ""))), ignorenulls=True).alias("title"), text.alias("text"))


def blocks(numbered: DataFrame, key: str) -> DataFrame:
    """key, line, t, text: the kind of each line: title, h1-h3, table, image, caption, note,
    footnote, bullet, body or blank."""
    c = F.col("content")
    kinds = (
        F.when(F.length(F.trim(c)) == 0, "blank").when(c.rlike(r"^# "), "title").when(c.rlike(r"^## "), "h1").when(c.rlike(r"^### "), "h2").when(c.rlike(r"^#{4,6} "), "h3")
        .when(c.rlike(r"^\s*\|.*\|\s*$"), "table").when(c.rlike(r"^\s*!\[[^\]]*\]\([^)]+\)"), "image").when(c.rlike(r"^\s*(?:\*\*)?[<\[]?(?:표|그림|Table|Figure)\s*\d+"), "caption")
        .when(c.rlike(r"^\s*\*\s*(?:출처|자료|주)\s*:"), "note").when(c.rlike(r"^\[\^[^\]]+\]:"), "footnote").when(c.rlike(r"^\s*(?:[-*+]|\d+[.)])\s"), "bullet").otherwise("body")
    )
    return numbered.select(key, "line", kinds.alias("t"), F.trim(F.regexp_replace(c, r"^#+\s*", "")).alias("text"))


def outline(blocked: DataFrame, key: str) -> DataFrame:
    """key and a count per block kind."""
    kinds = ["title", "h1", "h2", "h3", "table", "image", "caption", "note", "footnote", "bullet", "body"]
    return blocked.groupBy(key).agg(*[F.count_if(F.col("t") == k).alias(k) for k in kinds])


_OPEN, _CLOSE = "([{「『“", ")]}」』”"
_TAG = re.compile(r"\s*(?:\(F\d{3,}\)|\[F\d{3,}\])")


def segments_of(text: str) -> list[str]:
    """Sentences of a report: a table row or heading by itself, paragraphs joined from their
    lines and cut after . ! ? 。 outside brackets; an ellipsis or a decimal point doesn't end
    one, and tags after the stop stay with it."""
    out, para = [], []

    def flush() -> None:
        whole, start, depth, i = " ".join(para), 0, 0, 0
        para.clear()
        while i < len(whole):
            c = whole[i]
            depth += (c in _OPEN) - (c in _CLOSE and depth > 0)
            ends = c in ".!?。" and depth == 0 and whole[i + 1 : i + 2] in ("", " ", *_OPEN)
            if ends and not (c == "." and (whole[max(0, i - 1) : i] == "." or whole[i + 1 : i + 2] == ".")):
                i += 1
                while m := _TAG.match(whole, i):
                    i = m.end()
                out.append(whole[start:i].strip())
                start = i
                continue
            i += 1
        out.append(whole[start:].strip())

    for line in text.split("\n"):
        bare = line.strip()
        if not bare or bare.startswith(("|", "#")) or re.match(r"(?:[-*+]|\d+[.)])\s", bare):
            flush()
        if bare.startswith(("|", "#")):
            out.append(bare)
        elif bare:
            para.append(bare)
    flush()
    return [s for s in out if s]


@F.arrow_udf(T.ArrayType(T.StringType()))
def segments(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Sentences of each text; of a batch, some texts at a time are Python objects."""
    for batch in texts:
        for part in arrow.slices(batch):
            yield pa.array([segments_of(t) if t is not None else [] for t in part.to_pylist()], pa.list_(pa.string()))


def tagged(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, segment, sentence of the segments that have a tag."""
    from quillmark.functions.text import tags

    rows = docs.select(key, F.posexplode(segments(F.col(text))).alias("segment", "sentence"))
    return rows.where(F.size(tags(F.col("sentence"))) > 0)


# The line grammar of worker returns.
WORKER_LINES = {"query": r"^\s*[-*]?\s*QUERY\s*:\s*(.+)$", "gap": r"^\s*[-*]?\s*GAP\s*:\s*(.+)$", "lead": r"^\s*[-*]?\s*LEAD\s*:\s*(.+)$", "dead_end": r"^\s*[-*]?\s*DEAD END\s*:\s*(.+)$"}


def worker_lines(sectioned: DataFrame, key: str) -> DataFrame:
    """key, section, line, kind, text of the marker lines."""
    kind, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, pattern in WORKER_LINES.items():
        hit = F.col("content").rlike(pattern)
        kind, text = F.when(hit, F.lit(k)).otherwise(kind), F.when(hit, collapse(F.regexp_extract("content", pattern, 1))).otherwise(text)
    return sectioned.select(key, "section", "line", kind.alias("kind"), text.alias("text")).where("kind is not null")


def id_plan(rows: DataFrame, worker: str, temp_id: str, defined: str, place: str) -> DataFrame:
    """worker, temp_id, scoped_id, defined, places: what each temporary id becomes."""
    return rows.groupBy(worker, temp_id).agg(F.concat_ws("-", F.first(worker), F.first(temp_id)).alias("scoped_id"), F.bool_or(defined).alias("defined"), F.array_sort(F.collect_list(place)).alias("places"))


def suggest_chart(header: Column, rows: Column) -> Column:
    """Kind of chart a table suggests, null with fewer than three rows or no numeric column: a
    column is numeric if 60 % of its cells are."""
    from quillmark.functions.text import numeric_cell

    share = lambda i: F.size(F.filter(rows, lambda r: F.coalesce(numeric_cell(F.try_element_at(r, i)), F.lit(False)))) / F.size(rows)
    numeric = F.size(F.filter(F.sequence(F.lit(2), F.greatest(F.size(header), F.lit(2))), lambda i: share(i) >= 0.6))
    year = F.exists(rows, lambda r: F.try_element_at(r, F.lit(1)).rlike(r"^(?:19|20)\d{2}"))
    return F.when((F.size(rows) < 3) | (numeric == 0), None).when(year, "line").when(numeric >= 2, "grouped_bar").otherwise("bar")


def table_layout(rows: Column, wide: int = 6, long: int = 40) -> Column:
    """grouped if a table has many columns or a long cell, else matrix."""
    longest = F.array_max(F.transform(F.flatten(rows), lambda c: F.length(c)))
    return F.when((F.array_max(F.transform(rows, lambda r: F.size(r))) > wide) | (longest > long), "grouped").otherwise("matrix")
