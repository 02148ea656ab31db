"""Bibliographic records: cleaning, names, identifiers, citation lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import collapse

# Characters folded in titles.
FOLDED = {"–": "-", "—": "-", "‐": "-", "‑": "-", "’": "'", "‘": "'", "“": '"', "”": '"', " ": " "}
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " "}


def clean_title(x: Column) -> Column:
    out = F.regexp_replace(x, r"(?i)</?(?:sub|sup|i|b|em|scp)[^>]*>", "")
    for a, b in ENTITIES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return collapse(F.translate(out, "".join(FOLDED), "".join(FOLDED.values())))


def year_of(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1), F.lit("")).cast("int")


def doi_of(url: Column) -> Column:
    """DOI of an address: arXiv and Zenodo numbers, Nature articles, or one in the path."""
    take = lambda p, prefix: F.when(F.regexp_extract(url, p, 1) != "", F.concat(F.lit(prefix), F.regexp_extract(url, p, 1)))
    generic = F.nullif(F.regexp_replace(F.regexp_extract(url, r"(10\.\d{4,9}/[^\s?#\"<>]+)", 1), r"[.,;)]+$", ""), F.lit(""))
    return F.coalesce(
        take(r"arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})", "10.48550/arXiv."), take(r"zenodo\.org/records?/(\d+)", "10.5281/zenodo."), take(r"nature\.com/articles/([a-z]\d+[\w-]*)", "10.1038/"), generic
    )


def body_dois(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"\b10\.\d{4,9}/[^\s\"<>|]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda d: F.regexp_replace(d, r"[.,;)\]]+$", "")))


def initials(author: Column) -> Column:
    """Family, G. M. from "Given Middle Family" or "Family, Given"; Hangul names stay."""
    comma = author.contains(",")
    family = F.when(comma, F.trim(F.substring_index(author, ",", 1))).otherwise(F.element_at(F.split(F.trim(author), r"\s+"), -1))
    given = F.when(comma, F.trim(F.regexp_replace(author, r"^[^,]*,", ""))).otherwise(F.trim(F.regexp_replace(F.trim(author), r"\S+$", "")))
    letters = F.array_join(F.transform(F.filter(F.split(given, r"[\s.-]+"), lambda g: g != ""), lambda g: F.concat(F.upper(F.substring(g, 1, 1)), F.lit("."))), " ")
    return F.when(author.rlike("[가-힣]"), F.trim(author)).when(letters == "", family).otherwise(F.concat(family, F.lit(", "), letters))


def author_list(authors: Column, most: int = 20) -> Column:
    """A, B, & C; beyond `most` the first most - 1, an ellipsis and the last."""
    names = F.transform(authors, initials)
    n = F.size(names)
    short = F.when(n == 1, names[0]).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(", & "), F.element_at(names, -1)))
    return F.when(n <= 0, "").when(n <= most, short).otherwise(F.concat(F.array_join(F.slice(names, 1, most - 1), ", "), F.lit(", … "), F.element_at(names, -1)))


def citation(r: Column) -> Column:
    """struct line, todo: a reference line by kind; todo if author, year or title lacks."""
    who, title = author_list(r["authors"]), r["title"]
    year = F.concat(F.lit("("), F.coalesce(r["year"].cast("string"), F.lit("n.d.")), F.lit(")"))
    volume = F.concat(F.coalesce(r["volume"], F.lit("")), F.when(r["issue"].isNotNull(), F.concat(F.lit("("), r["issue"], F.lit(")"))).otherwise(""))
    place = F.when(r["kind"] == "article", F.concat_ws(", ", r["container"], F.nullif(volume, F.lit("")), r["pages"])).otherwise(r["container"])
    link = F.when(r["doi"].isNotNull(), F.concat(F.lit("https://doi.org/"), r["doi"]))
    line = F.concat_ws(". ", F.nullif(F.concat_ws(" ", F.nullif(who, F.lit("")), year), F.lit("")), title, F.nullif(place, F.lit("")), link)
    return F.struct(line.alias("line"), ((who == "") | r["year"].isNull() | (F.coalesce(title, F.lit("")) == "")).alias("todo"))


def title_match(a: Column, b: Column, share: float = 0.6) -> Column:
    """At least that share of a's words of four letters or more occur in b."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 4))
    mine = words(a)
    return (F.size(mine) > 0) & (F.size(F.array_intersect(mine, words(b))) >= share * F.size(mine))


def collation(x: Column) -> list[Column]:
    """Sort keys: Latin and digits, then Hangul, then the rest; case doesn't count."""
    return [F.when(x.rlike(r"^[\p{IsLatin}0-9]"), 0).when(x.rlike(r"^[\p{IsHangul}]"), 1).otherwise(2), F.lower(x), x]


def record_dedup(df: DataFrame, academic: str, position: str) -> DataFrame:
    """One row per DOI, or per address where there is none; academic rows first, then by place."""
    key = F.coalesce(F.lower("doi"), F.lower("url"))
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(academic), position))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def resolve(row: DataFrame, *sources: tuple[str, DataFrame], key: str = "url") -> DataFrame:
    """key, record, src: the first source in order that has a record for the row. Each source is
    (name, key and record), joined once."""
    out, found = row, []
    for name, records in sources:
        out = out.join(records.select(key, F.col("record").alias(f"_{name}")), key, "left")
        found.append(F.when(F.col(f"_{name}").isNotNull(), F.struct(F.col(f"_{name}").alias("record"), F.lit(name).alias("src"))))
    return out.withColumn("_best", F.coalesce(*found)).select(*row.columns, "_best.*")


def page_title(title: Column) -> Column:
    """A page's title without the site's name behind a separator."""
    return F.trim(F.regexp_replace(collapse(title), r"\s+[-|–—·:]\s+[^-|–—·:]{1,40}$", ""))


def comma_parts(x: Column) -> Column:
    """Parts between commas outside brackets."""
    return F.transform(F.split(x, r",(?![^(（]*[)）])"), lambda p: F.trim(p))
