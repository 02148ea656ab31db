"""Sentences of a report against the ledger: tags, numbers, quotes, reviews, charts, headings."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import quantity
from quillmark.functions import text as tx


def tag_links(sentences: DataFrame) -> DataFrame:
    """sentence_id, fact_id: one row per distinct tag of a sentence (sentence_id, sentence)."""
    return sentences.select("sentence_id", "sentence", F.explode(F.array_distinct(tx.tag_ids(F.col("sentence")))).alias("fact_id"))


def tag_issues(sentences: DataFrame, facts: DataFrame) -> DataFrame:
    """sentence_id, fact_id, issue: tags of facts that don't exist or aren't confirmed; a
    disputed fact is fine in a sentence marked as such."""
    links = tag_links(sentences).join(facts.select(F.col("id").alias("fact_id"), "status", F.lit(1).alias("_in")), "fact_id", "left")
    disputed = F.col("sentence").rlike(r"^\s*(?:[-*+|]\s*)?\[상충\](?=\s|\||$)")
    fine = (F.col("status") == "confirmed") | ((F.col("status") == "disputed") & disputed)
    issue = F.when(F.col("_in").isNull(), "unknown").when(~F.coalesce(fine, F.lit(False)), F.concat(F.lit("status "), F.coalesce("status", F.lit("none"))))
    return links.select("sentence_id", "fact_id", issue.alias("issue")).where("issue is not null")


def ledger_quantities(facts: DataFrame) -> DataFrame:
    """fact_id, dimension, low, high of the facts' values; units are resolved once each."""
    units = facts.select("unit").distinct().select("unit", quantity.unit_of("unit").alias("_u"))
    rows = facts.select(F.col("id").alias("fact_id"), "raw", "unit").join(units, facts["unit"].eqNullSafe(units["unit"]), "left").drop(units["unit"])
    number = r"[+\-−]?(?:\d[\d,]*(?:\.\d+)?|\.\d+)(?:[eE][+\-−]?\d+)?"
    read = lambda i: F.replace(F.replace(F.regexp_extract(F.trim("raw"), rf"^({number})(?:\s*([~∼\-–±])\s*({number}))?$", i), F.lit(","), F.lit("")), F.lit("−"), F.lit("-")).try_cast("double")
    sign = F.regexp_extract(F.trim("raw"), rf"^({number})(?:\s*([~∼\-–±])\s*({number}))?$", 2)
    a, b = read(1), read(3)
    scale = F.pow(F.lit(10.0), F.col("_u.power"))
    low, high = F.when(sign == "±", a - b).otherwise(a), F.when(sign == "±", a + b).otherwise(F.coalesce(b, a))
    return rows.select("fact_id", F.col("_u.dimension").alias("dimension"), (low * scale).alias("low"), (high * scale).alias("high"))


def number_states(sentences: DataFrame, facts: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """sentence_id, start, state of every number of a sentence: bound to a tag with an equal
    value (ok), an unlike one (mismatch) or one that can't be read (unreadable); without a bound
    tag ok if any tag of the sentence has its value, else untagged.

    The fallback is an equi-join on the sentence, whose tags are a handful."""
    found = sentences.select("sentence_id", "sentence", F.explode(quantity.bound_numbers("sentence")).alias("n")).select("sentence_id", "sentence", "n.*")
    ledger = ledger_quantities(facts)
    near = lambda x, y: F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
    lo, hi = F.col("low").cast("double"), F.col("high").cast("double")

    def equal(s: str) -> Column:
        return quantity.dimensions_compatible(F.col("dimension"), F.col(f"{s}.dimension")) & near(lo, F.col(f"{s}.low")) & near(hi, F.col(f"{s}.high"))

    bound = found.join(ledger.select(F.col("fact_id").alias("tag"), F.struct("dimension", "low", "high").alias("own")), "tag", "left")
    others = tag_links(sentences).join(ledger, "fact_id").groupBy("sentence_id").agg(F.collect_list(F.struct("dimension", "low", "high")).alias("_tags"))
    rows = bound.join(others, "sentence_id", "left")
    any_tag = F.exists("_tags", lambda t: quantity.dimensions_compatible(F.col("dimension"), t["dimension"]) & near(lo, t["low"]) & near(hi, t["high"]))
    state = (
        F.when(F.col("tag").isNull(), F.when(F.coalesce(any_tag, F.lit(False)), "ok").otherwise("untagged"))
        .when(F.col("own.dimension") == quantity.UNSUPPORTED, "unsupported unit")
        .when(F.col("own.low").isNull(), "unreadable")
        .when(F.coalesce(equal("own"), F.lit(False)), "ok")
        .otherwise("mismatch")
    )
    return rows.select("sentence_id", "start", "tag", state.alias("state"))


def sentences_without_quote(sentences: DataFrame, evidence: DataFrame, passed: DataFrame) -> DataFrame:
    """sentence_id of the tagged sentences none of whose facts has a passed quote. passed:
    evidence_id; evidence: id, fact_id."""
    good = evidence.join(passed.select(F.col("evidence_id").alias("id")).distinct(), "id", "left_semi").select("fact_id").distinct()
    links = tag_links(sentences).select("sentence_id", "fact_id")
    return links.select("sentence_id").distinct().join(links.join(good, "fact_id", "left_semi").select("sentence_id"), "sentence_id", "left_anti")


def missing_support_marks(sentences: DataFrame, support: DataFrame, mark: str = r"\((?:부분 근거|partial)\)") -> DataFrame:
    """sentence_id, fact_id of sentences on partly supported facts that don't say so."""
    partial = support.where("support = 'partial'").select("fact_id")
    return tag_links(sentences).join(partial, "fact_id", "left_semi").where(~F.col("sentence").rlike(mark)).select("sentence_id", "fact_id")


def review_issues(reviews: DataFrame, sentences: DataFrame, facts: DataFrame, evidence: DataFrame, revision: str) -> DataFrame:
    """sentence_id, issue of claim reviews: the reviewed text is another one, an older evidence
    revision, ids that don't exist or aren't the sentence's, sentences reviewed too rarely."""
    text = sentences.select("sentence_id", "sentence", F.array_sort(F.array_distinct(tx.tag_ids(F.col("sentence")))).alias("_tags"))
    r = reviews.join(text, "sentence_id", "left")
    stale = F.array_compact(
        F.array(
            F.when(F.col("sentence").isNull(), "unknown sentence"),
            F.when(F.col("sentence").isNotNull() & (F.lower("reviewed_text_sha256") != F.sha2(F.encode("sentence", "UTF-8"), 256)), "text changed"),
            F.when(~F.col("evidence_revision").eqNullSafe(F.lit(revision)), "evidence changed"),
            F.when(F.size(F.array_except("_tags", "fact_ids")) > 0, "fact not reviewed"),
            F.when(F.size(F.array_except("fact_ids", "_tags")) > 0, "fact not in sentence"),
        )
    )
    direct = r.select("sentence_id", F.explode(stale).alias("issue"))
    links = reviews.select("sentence_id", F.explode("evidence_ids").alias("id"), "fact_ids")
    there = links.join(evidence.select("id", "fact_id", F.lit(1).alias("_in")), "id", "left")
    odd = there.select("sentence_id", F.when(F.col("_in").isNull(), "unknown evidence").when(~F.array_contains("fact_ids", F.col("fact_id")), "evidence of another fact").alias("issue")).where("issue is not null")
    lost = reviews.select("sentence_id", F.explode("fact_ids").alias("id")).join(facts.select("id"), "id", "left_anti").select("sentence_id", F.lit("unknown fact").alias("issue"))
    from quillmark.operators.snapshots import multiset_shortfall

    tagged = text.where(F.size("_tags") > 0)
    rare = multiset_shortfall(tagged.select("sentence"), r.where("sentence is not null").select("sentence"), "sentence")
    few = tagged.join(rare.select("sentence"), "sentence", "left_semi").select("sentence_id", F.lit("not reviewed").alias("issue"))
    return direct.union(odd).union(lost).union(few).distinct()


def high_risk_untagged(facts: DataFrame, terms: list[str]) -> DataFrame:
    """Facts whose metric has a high-risk term and whose risk isn't high."""
    return facts.where(F.lower("metric").rlike("|".join(terms)) & ~F.col("risk").eqNullSafe("high"))


#: What a growth rate is recomputed from.
ATOMIC_INPUTS = ("base_value", "base_year", "forecast_value", "forecast_year", "reported_cagr", "cagr_start_year", "cagr_end_year")


def calculation_candidates(facts: DataFrame) -> DataFrame:
    """Facts whose growth is to be checked: any atomic input is there, the text speaks of a
    compound rate, a period of two years isn't observed (basis actual), or a forecast is about a
    market. facts: claim, raw, metric, period, basis and the ATOMIC_INPUTS that there are."""
    atoms = [F.col(c).isNotNull() for c in ATOMIC_INPUTS if c in facts.columns]
    text = F.concat_ws(" ", "claim", "raw", "metric", "period")
    period = r"(?i)(?<!\d)(?:19|20)\d{2}\s*년?\s*(?:→|->|~|–|-|부터|to)\s*(?:19|20)\d{2}(?!\d)"
    rules = [
        reduce(or_, atoms, F.lit(False)),
        text.rlike(r"(?i)CAGR|연평균.*성장"),
        text.rlike(period) & ~F.col("basis").eqNullSafe("actual"),
        F.col("basis").eqNullSafe("forecast") & F.coalesce(F.lower("metric").rlike("market|시장"), F.lit(False)),
    ]
    return facts.where(reduce(or_, rules))


def sidecar_issues(drawn: DataFrame, facts: DataFrame, captions: DataFrame) -> DataFrame:
    """chart, fact_id, issue: drawn values (chart, fact_id, value_raw, unit) that aren't the
    ledger's, and facts that the caption (chart, caption) doesn't tag."""
    tags = captions.select("chart", tx.tag_ids(F.col("caption")).alias("_tags"))
    rows = drawn.join(facts.select(F.col("id").alias("fact_id"), F.col("raw").alias("_raw"), F.col("unit").alias("_unit"), F.lit(1).alias("_in")), "fact_id", "left").join(tags, "chart", "left")
    issues = F.array_compact(
        F.array(
            F.when(F.col("_in").isNull(), "unknown fact"),
            F.when(F.col("_in").isNotNull() & ~(F.col("value_raw").eqNullSafe(F.col("_raw")) & F.col("unit").eqNullSafe(F.col("_unit"))), "value differs"),
            F.when(~F.coalesce(F.array_contains("_tags", F.col("fact_id")), F.lit(False)), "not in caption"),
        )
    )
    return rows.select("chart", "fact_id", F.explode(issues).alias("issue"))


def decision_states(tables: DataFrame, decisions: DataFrame) -> DataFrame:
    """key, state: resolved, unresolved (a table without a decision) or orphan."""
    return tables.select("key", F.lit(1).alias("_t")).join(decisions.select("key", F.lit(1).alias("_d")), "key", "full_outer").select("key", F.when(F.col("_t").isNull(), "orphan").when(F.col("_d").isNull(), "unresolved").otherwise("resolved").alias("state"))


def plan_issues(plan: DataFrame, found: DataFrame) -> DataFrame:
    """title, issue: planned headings that no heading of the report contains or is contained
    in, and those whose section has no text. plan: title; found: title, text. Both are one
    document's headings, so the comparison is of a few dozen by a few dozen."""
    a, b = plan.select("title", tx.heading_key(F.col("title")).alias("_k")), found.select(tx.heading_key(F.col("title")).alias("_h"), "text")
    same = F.contains("_k", F.col("_h")) | F.contains("_h", F.col("_k"))
    hit = a.join(F.broadcast(b), same & (F.col("_h") != "") & (F.col("_k") != ""), "left").groupBy("title").agg(F.max(F.coalesce(F.length(F.trim("text")), F.when(F.col("_h").isNotNull(), 0))).alias("_n"))
    return hit.select("title", F.when(F.col("_n").isNull(), "missing").when(F.col("_n") == 0, "empty").alias("issue")).where("issue is not null")


def appendix_issues(headings: DataFrame, mark_line: int, approved: DataFrame) -> DataFrame:
    """Headings (line, title) after the appendix mark that aren't approved (title)."""
    keys = approved.select(tx.heading_key(F.col("title")).alias("_k"))
    return headings.where(F.col("line") > mark_line).withColumn("_k", tx.heading_key(F.col("title"))).join(keys, "_k", "left_anti").drop("_k")


def figure_issues(figures: DataFrame, files: DataFrame) -> DataFrame:
    """path, issue of figure references (path, caption, source): the file exists below assets,
    a caption with a tag, and a source."""
    rows = figures.join(files.select("path", F.lit(1).alias("_in")), "path", "left")
    issues = F.array_compact(
        F.array(
            F.when(F.col("_in").isNull(), "no file"),
            F.when(~F.col("path").rlike(r"^(?:\./)?assets/") | F.col("path").contains(".."), "outside assets"),
            F.when(F.length(F.trim(F.coalesce("caption", F.lit("")))) == 0, "no caption").when(F.size(tx.tags(F.col("caption"))) == 0, "caption without tag"),
            F.when(F.length(F.trim(F.coalesce("source", F.lit("")))) == 0, "no source"),
        )
    )
    return rows.select("path", F.explode(issues).alias("issue"))


# Points of a length unit (no unit is px), the smallest type, and Korean fonts.
POINTS = {"pt": 1.0, "px": 0.75, "em": 12.0, "": 0.75}
LEAST_POINTS, MOST_BARS = 9.0, 20
KOREAN_FONTS = r"(?i)font-family[=:]\s*[\"']?[^;\">]*(?:Malgun Gothic|Noto Sans KR|맑은 고딕)"


def svg_issues(figures: DataFrame) -> DataFrame:
    """path, issue of drawings (path, svg, chart_type, fact_ids: the sidecar's, null where a
    drawing has no sidecar): type below nine points, no title or description, the first line's
    fact comment missing or unlike the sidecar's ids, outside links, no Korean font, too many
    bars. Bars are the paths of bar groups, else rectangles that aren't the background; they
    count for plain bar charts (and where the type isn't known) alone."""
    s = F.col("svg")
    sizes = F.regexp_extract_all(s, F.lit(r"font-size[=:]\s*[\"']?\s*([\d.]+)\s*(?:px|pt|em)?"), F.lit(1))
    units = F.regexp_extract_all(s, F.lit(r"font-size[=:]\s*[\"']?\s*[\d.]+\s*(px|pt|em)?"), F.lit(1))
    factor = F.create_map(*[F.lit(x) for kv in POINTS.items() for x in kv])
    small = F.exists(F.zip_with(sizes, units, lambda v, u: v.try_cast("double") * factor[F.coalesce(u, F.lit(""))]), lambda pt: F.coalesce(pt < LEAST_POINTS, F.lit(False)))
    comment = F.regexp_extract(F.substring_index(s, "\n", 1), r"<!--\s*FACTS:\s*([^>]*?)\s*-->", 1)
    marked = F.substring_index(s, "\n", 1).rlike(r"<!--\s*FACTS:\s*[^>]*?\s*-->")
    ids = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(comment, ","), lambda x: F.trim(x)), lambda x: x != "")))
    listed = F.array_sort(F.array_distinct("fact_ids"))
    groups = F.regexp_extract_all(s, F.lit(r"(?s)<g class=\"mark-rect[^\"]*\"[^>]*>(.*?)</g>"), F.lit(1))
    paths = F.aggregate(groups, F.lit(0), lambda n, g: n + F.size(F.regexp_extract_all(g, F.lit("<path"), F.lit(0))))
    rects = F.size(F.regexp_extract_all(s, F.lit(r"<rect(?![^>]*width=\"100%\")"), F.lit(0)))
    bars = F.when(paths > 0, paths).otherwise(rects)
    issues = F.array_compact(
        F.array(
            F.when(small, "small type"),
            F.when(~(s.rlike(r"(?s)<title>.+?</title>") & s.rlike(r"(?s)<desc>.+?</desc>")), "no title or description"),
            F.when(F.col("fact_ids").isNotNull() & (ids != listed), "fact ids differ").when(F.col("fact_ids").isNull() & ~marked, "no fact ids"),
            F.when(s.rlike(r"(?i)(?:href|url\()\s*=?\s*[\"']?\s*https?:"), "outside link"),
            F.when(~s.rlike(KOREAN_FONTS), "no Korean font"),
            F.when(F.coalesce("chart_type", F.lit("bar")).isin("bar", "hbar") & (bars > MOST_BARS), "too many bars"),
        )
    )
    return figures.select("path", F.explode(issues).alias("issue"))


def place_ids(rows: DataFrame, places: DataFrame, name: str, affixes: str = r"^(?:the|republic of|state of)\s+|\s+(?:state|province|city|county)$") -> DataFrame:
    """rows with place_id: by the folded name or code, else without usual affixes. places (key,
    id) is a dimension of a few hundred rows; its size is Spark's to weigh. Folding is Python's,
    once per distinct name."""
    names = rows.select(name).distinct().withColumn("_k", tx.accents_folded(F.col(name)))
    names = names.withColumn("_k2", tx.accents_folded(F.regexp_replace(F.lower(F.trim(name)), affixes, "")))
    keys = places.select(F.col("key").alias("_k"), F.col("id").alias("_a"))
    found = names.join(keys, "_k", "left").join(keys.toDF("_k2", "_b"), "_k2", "left").select(name, F.coalesce("_a", "_b").alias("place_id"))
    return rows.join(found, name, "left")


def layout_errors(before: Column, after: Column) -> Column:
    """struct same, lost, added of two heading sequences."""
    return F.struct(before.eqNullSafe(after).alias("same"), F.array_except(before, after).alias("lost"), F.array_except(after, before).alias("added"))


def pdf_expectations(report: DataFrame, found: DataFrame) -> DataFrame:
    """kind, token, missing: tags and links of a report (text) that a rendered document (kind,
    token) lacks, counted."""
    from quillmark.operators.snapshots import multiset_shortfall

    tag = report.select(F.lit("tag").alias("kind"), F.explode(tx.tag_ids(F.col("text"))).alias("token"))
    link = report.select(F.lit("link").alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(r"\]\(([^)\s]+)\)"), F.lit(1))).alias("token"))
    return multiset_shortfall(tag.union(link), found.select("kind", "token"), "kind", "token")
