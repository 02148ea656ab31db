"""Checks of whole reports, tables and documents, and the tables that audits are kept in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as tx

# The mark before an appendix, and what a table's caption and format tag look like.
APPENDIX_MARK = r"<!--\s*FACTSHEET:APPENDIX\s*-->"
CAPTION = r"^(<표>\s*)?\**\[?표\]?\s*[\d{][^.\s]*[.\s]*\**\s*"
FORMAT_TAG = r"[ \t]*\{형식=(A|B|matrix)\}[ \t]*(?=\r?\n|\z)"


def report_issues(reports: DataFrame) -> DataFrame:
    """report, issue of reports (report, text, canonical): more than one appendix mark, an empty
    body before the first one, another file than the work folder's own report (canonical null:
    it has none)."""
    marks = F.regexp_count("text", F.lit(APPENDIX_MARK))
    body = F.get(F.split("text", APPENDIX_MARK, 2), F.lit(0))
    issues = F.array_compact(
        F.array(
            F.when(F.col("canonical").isNotNull() & (F.col("canonical") != F.col("report")), "another report"),
            F.when(marks > 1, "several appendix marks"),
            F.when(F.coalesce(tx.collapse(body), F.lit("")) == "", "empty body"),
        )
    )
    return reports.select("report", F.explode(issues).alias("issue"))


def conversion_warnings(facts: DataFrame) -> DataFrame:
    """id of facts (id, unit, decimal) in dollars without the decimal that a conversion is
    checked by."""
    dollars = F.col("unit").startswith("USD") | F.col("unit").startswith("$")
    return facts.where(dollars & (F.coalesce(F.col("decimal").cast("string"), F.lit("")) == "")).select("id")


def accepted_captures(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """facts (id, evidence_ids) with accepted: any linked evidence (id, verdict) was accepted."""
    good = evidence.where("verdict = 'accept'").select(F.col("id").alias("_e")).distinct()
    linked = facts.select("id", F.explode("evidence_ids").alias("_e")).join(good, "_e", "left_semi").select("id").distinct()
    return facts.join(linked.withColumn("_ok", F.lit(True)), "id", "left").withColumn("accepted", F.coalesce("_ok", F.lit(False))).drop("_ok")


def calculation_report(checks: DataFrame, strict: bool) -> DataFrame:
    """level, id, message: one row for each finding on checks (id, status of the fact, risk,
    atomic: inputs are recorded, result, reason). Conflicts of confirmed facts, unrecorded
    inputs of high risks and invalid inputs fail if strict and warn otherwise; what can't be
    checked warns."""
    hard = F.lit("failure" if strict else "warning")
    conflict = F.when(F.col("status") == "confirmed", hard).otherwise("warning")
    found = F.array_compact(
        F.array(
            F.when((F.col("risk") == "high") & ~F.col("atomic"), F.struct(hard.alias("level"), F.lit("inputs not recorded").alias("message"))),
            F.when(F.col("result") == "INVALID_INPUT", F.struct(hard.alias("level"), F.coalesce("reason", F.lit("invalid input")).alias("message"))),
            F.when(F.col("result") == "CONFLICT", F.struct(conflict.alias("level"), F.lit("rate differs").alias("message"))),
            F.when(F.col("result") == "NOT_CHECKABLE", F.struct(F.lit("warning").alias("level"), F.coalesce("reason", F.lit("not checkable")).alias("message"))),
        )
    )
    return checks.select("id", F.explode(found).alias("f")).select("f.level", "id", "f.message")


def audit_summary(findings: DataFrame, *by: str) -> DataFrame:
    """by, ok, failures, warnings: a report is good while nothing fails."""
    return findings.groupBy(*by).agg(F.count_if(F.col("level") == "failure").alias("failures"), F.count_if(F.col("level") == "warning").alias("warnings")).withColumn("ok", F.col("failures") == 0)


def url_list(lines: DataFrame, order: str, line: str, limit: int | None = None) -> DataFrame:
    """order, url: the first place of each address of a list, blank lines and # comments left
    out; at most `limit` of them, in the list's order."""
    url = tx.collapse(F.col(line))
    rows = lines.select(F.col(order).alias("order"), F.trim(F.col(line), F.lit(" \t\r\n")).alias("url")).where((url != "") & ~F.coalesce(url.startswith("#"), F.lit(True)))
    first = rows.groupBy("url").agg(F.min("order").alias("order")).select("order", "url")
    if limit is None:
        return first
    if limit < 1:
        raise ValueError("a limit is at least 1")
    return first.orderBy("order").limit(limit)


def usage_counts(df: DataFrame, *columns: str) -> DataFrame:
    """columns, n, place: how often each combination occurs, most common first."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), *columns)))


def resolver_stats(references: DataFrame, resolver: str, manual: str) -> DataFrame:
    """source, n: references by what resolved them: by hand first, else the resolver, else
    nothing."""
    source = F.when(F.col(manual), "manual").otherwise(F.coalesce(F.col(resolver), F.lit("unresolved")))
    return references.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n"))


def number_variants(number: Column) -> Column:
    """How a number may be written: as it is, without commas or, for whole numbers of more than
    three digits, with them, and without spaces; distinct, in this order."""
    n = F.trim(number)
    grouped = F.regexp_replace(F.regexp_replace(n, "^0+(?=[0-9])", ""), r"(?<=\d)(?=(?:\d{3})+$)", ",")
    other = F.when(n.contains(","), F.replace(n, F.lit(","), F.lit(""))).when(n.rlike(r"^\d{4,}$"), grouped)
    return F.array_distinct(F.array_compact(F.array(n, other, F.replace(n, F.lit(" "), F.lit("")))))


def standalone(text: Column, number: Column) -> Column:
    """number occurs with neither a digit nor a comma or point right beside it: 45 isn't in
    2045, but in 45% and 2024-45. Blanks between don't separate."""
    quoted = F.concat(F.lit(r"(?<![.,0-9])\Q"), number, F.lit(r"\E(?![.,0-9])"))
    return F.regexp_like(text, quoted)


def remapped(text: Column, pairs: dict[int, int]) -> Column:
    """References imageN with new numbers, all at once: a number that is new for one reference
    and old for another is not taken twice."""
    parts = F.split(text, r'(?<=binaryItemIDRef="image)(?=\d+")')
    new = F.create_map(*[F.lit(str(x)) for pair in pairs.items() for x in pair]) if pairs else F.create_map().cast("map<string,string>")
    number = lambda p: F.regexp_extract(p, '^[0-9]+(?=")', 0)
    swap = lambda p, i: F.when((i > 0) & F.try_element_at(new, number(p)).isNotNull(), F.concat(F.try_element_at(new, number(p)), F.regexp_replace(p, "^[0-9]+", ""))).otherwise(p)
    return F.array_join(F.transform(parts, swap), "")


def without_format_tags(text: Column) -> Column:
    return F.regexp_replace(text, FORMAT_TAG, "")


def cells(line: Column) -> Column:
    """Cells of a table row as written."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))


def table_key(before: Column, header: Column, first_row: Column) -> Column:
    """A table's name: the title of the nearest caption among the lines before it (array, top to
    bottom, of which the last three count), else its header and the first 20 characters of its
    first row."""
    near = F.reverse(F.slice(before, F.greatest(F.size(before) - 2, F.lit(1)), 3))
    titles = F.transform(near, lambda s: F.when(F.trim(s).rlike(CAPTION), F.trim(F.regexp_replace(without_format_tags(F.trim(s)), CAPTION, ""), F.lit(" *"))))
    title = F.get(F.filter(titles, lambda t: F.coalesce(t, F.lit("")) != ""), F.lit(0))
    return F.coalesce(title, F.concat(F.array_join(header, " | "), F.lit(" / "), F.substring(F.array_join(first_row, " "), 1, 20)))


def figure_nearby(tables: DataFrame, lines: DataFrame, span: int = 8) -> DataFrame:
    """doc, start, end, nearby of tables (doc, start, end: line numbers): a figure stands within
    `span` lines. lines: doc, line, text. Lines meet tables by blocks of lines, which a table
    has few of, so this is an equi-join."""
    width = 4 * span
    block = lambda c: F.floor(c / width)
    wide = tables.select("doc", "start", "end", F.explode(F.sequence(block(F.col("start") - span), block(F.col("end") + span))).alias("_b"))
    figures = lines.where(F.col("text").contains("![")).select("doc", F.col("line").alias("_l"), block(F.col("line")).alias("_b"))
    hit = wide.join(figures, ["doc", "_b"]).where(F.col("_l").between(F.col("start") - span, F.col("end") + span)).select("doc", "start", "end").distinct()
    return tables.select("doc", "start", "end").join(hit.withColumn("_hit", F.lit(True)), ["doc", "start", "end"], "left").select("doc", "start", "end", F.coalesce("_hit", F.lit(False)).alias("nearby"))


def column_widths(rows: DataFrame, by: list[str], cells: str, total: int, label: int = 16, least: int = 3, cap: int = 40) -> DataFrame:
    """by, column, width of tables (by, row number `row`, array of cells): what a column needs at
    least, its longest cell if that is at most `label`, else its longest word (`least` at least
    and half the table at most), and the rest in proportion to its content, of which the
    longest cell counts up to `cap`. The last column takes what rounding leaves; columns that
    need more than there is are shrunk in proportion."""
    each = rows.select(*by, "row", F.posexplode(cells).alias("column", "_cell"))
    size = tx.display_width(F.col("_cell"))
    word = F.array_max(F.transform(F.split("_cell", r"\s+"), lambda w: tx.display_width(w)))
    own = each.groupBy(*by, "column").agg(
        F.max(size).alias("_cell"), F.max(word).alias("_word"), F.max(F.when(F.col("row") == 0, size)).alias("_head"), F.max(F.when(F.col("row") > 0, size)).alias("_data")
    )
    need = F.greatest(F.lit(least), F.least(F.when(F.col("_cell") <= label, F.col("_cell")).otherwise(F.col("_word")), F.lit(total // 2)))
    part = F.greatest(F.lit(3), F.coalesce("_head", F.lit(1)), F.least(F.coalesce("_data", F.lit(1)), F.lit(cap)))
    table = Window.partitionBy(*by)
    sized = own.select(*by, "column", need.cast("bigint").alias("_need"), part.cast("bigint").alias("_part"))
    sized = sized.withColumns({"_needs": F.sum("_need").over(table), "_parts": F.sum("_part").over(table)})
    width = F.when(F.col("_needs") >= total, F.floor(F.col("_need") * total / F.col("_needs"))).otherwise(F.col("_need") + F.floor((total - F.col("_needs")) * F.col("_part") / F.col("_parts")))
    sized = sized.withColumn("_w", width.cast("bigint"))
    last = F.col("column") == F.max("column").over(table)
    return sized.select(*by, "column", (F.col("_w") + F.when(last, total - F.sum("_w").over(table)).otherwise(0)).alias("width"))


def table_heights(rows: DataFrame, widths: DataFrame, by: list[str], cells: str, head: int = 2, line: int = 1, pad: int = 1) -> DataFrame:
    """by, height of tables: for each row the most lines that a cell wraps into, times a line's
    height (another in row 0), and the space around it."""
    each = rows.select(*by, "row", F.posexplode(cells).alias("column", "_cell")).join(widths, [*by, "column"])
    wrapped = F.when(F.col("width") > 0, F.ceil(tx.display_width(F.col("_cell")) / F.col("width"))).otherwise(1)
    high = each.groupBy(*by, "row").agg(F.greatest(F.lit(1), F.max(wrapped)).alias("_lines"))
    return high.groupBy(*by).agg(F.sum(F.col("_lines") * F.when(F.col("row") == 0, head).otherwise(line) + pad).cast("bigint").alias("height"))


def image_records(index: DataFrame) -> DataFrame:
    """folder, file, source, license, accessed_at of image indexes (folder, and arrays figures,
    images, files, candidates of structs file, source, url, page, license, accessed_at, at, and
    source, license, accessed_at, at of the whole index)."""
    lists = F.flatten(F.array_compact(F.array("figures", "images", "files", "candidates")))
    rows = index.select("folder", F.struct("source", "license", "accessed_at", "at").alias("whole"), F.explode(lists).alias("r")).where(F.coalesce(F.trim("r.file"), F.lit("")) != "")
    some = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c], F.lit("unknown"))
    source = some("r.source", "r.url", "whole.source")
    paged = F.when((source != "unknown") & (F.coalesce("r.page", F.lit("")) != ""), F.concat(source, F.lit(" · p."), F.col("r.page"))).otherwise(source)
    return rows.select("folder", F.trim("r.file").alias("file"), paged.alias("source"), some("r.license", "whole.license").alias("license"), some("r.accessed_at", "r.at", "whole.accessed_at", "whole.at").alias("accessed_at"))


def located_images(records: DataFrame, files: DataFrame) -> DataFrame:
    """records with path: the first that exists of the file below the work folder, below the
    index's folder and, by its bare name, in that folder. files: path, relative to the work
    folder. Each candidate is an equi-join; records without a file are left out."""
    there = files.select(F.col("path").alias("_p")).distinct()
    bare = F.element_at(F.split("file", "/"), -1)
    tried = F.array(F.col("file"), F.concat_ws("/", "folder", "file"), F.concat_ws("/", F.col("folder"), bare))
    rows = records.withColumn("_id", F.xxhash64(*records.columns)).select("*", F.posexplode(tried).alias("_rank", "_p"))
    hits = rows.join(there, "_p", "left_semi").groupBy("_id", *records.columns).agg(F.min_by("_p", "_rank").alias("path"))
    return hits.drop("_id")


def transition_lists(pairs: DataFrame, by: list[str], key: str) -> DataFrame:
    """by, n, keys: the keys of each transition in their order."""
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(key)).alias("keys"))


def card_links(evidence: DataFrame) -> DataFrame:
    """fact_id, linked: a fact's evidence may link to source texts if it has as many texts as
    addresses. evidence: fact_id, url, file."""
    return evidence.groupBy("fact_id").agg((F.count_distinct("url") == F.count_distinct("file")).alias("linked"))


def card_inputs(evidence: DataFrame) -> DataFrame:
    """evidence (id, span_clean, sha256, line, end, t, url) with reference (the named source
    text, else the first 12 digits of the hash) and place: a span of lines, else a time."""
    reference = F.coalesce(F.nullif(F.col("span_clean"), F.lit("")), F.nullif(F.substring("sha256", 1, 12), F.lit("")))
    lines = F.when(F.col("line").isNotNull(), F.concat(F.col("line").cast("string"), F.lit("-"), F.coalesce("end", "line").cast("string")))
    return evidence.select("id", reference.alias("reference"), F.coalesce(lines, F.concat(F.lit("t="), F.nullif(F.col("t"), F.lit("")))).alias("place"))
