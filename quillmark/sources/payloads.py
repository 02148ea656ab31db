"""Parsers of search and metadata payloads: string columns to one common record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import collapse

RECORD = "struct<title:string,url:string,source:string,year:int,doi:string,authors:array<string>,abstract:string,snippet:string>"


def strip_tags(x: Column) -> Column:
    return collapse(F.regexp_replace(x, r"<[^>]+>", " "))


def bare_doi(x: Column) -> Column:
    return F.nullif(F.regexp_replace(F.trim(x), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""), F.lit(""))


def record(title: Column, url: Column, source: str, year: Column | None = None, doi: Column | None = None, authors: Column | None = None, abstract: Column | None = None) -> Column:
    """The common record: tags stripped, bare DOI, a snippet of 300 characters."""
    none = F.lit(None)
    text = strip_tags(abstract) if abstract is not None else none.cast("string")
    return F.struct(
        strip_tags(title).alias("title"), url.alias("url"), F.lit(source).alias("source"), (year.try_cast("int") if year is not None else none.cast("int")).alias("year"),
        (bare_doi(doi) if doi is not None else none.cast("string")).alias("doi"), F.coalesce(authors if authors is not None else none.cast("array<string>"), F.array().cast("array<string>")).alias("authors"),
        text.alias("abstract"), F.substring(text, 1, 300).alias("snippet"),
    )


def abstract_of(inverted: Column) -> Column:
    """Text of an inverted index (JSON object: token -> positions)."""
    index = F.map_entries(F.from_json(inverted, "map<string,array<int>>"))
    pairs = F.flatten(F.transform(index, lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("t")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["t"]), " ")


def openalex(df: DataFrame, payload: str) -> DataFrame:
    shape = "results array<struct<title:string,id:string,doi:string,publication_year:int,abstract_inverted_index:map<string,array<int>>,authorships:array<struct<author:struct<display_name:string>>>>>"
    r = F.explode(F.from_json(payload, shape)["results"])
    rows = df.select(r.alias("r"))
    who = F.transform("r.authorships", lambda a: a["author"]["display_name"])
    return rows.select(record(F.col("r.title"), F.coalesce("r.doi", "r.id"), "openalex", F.col("r.publication_year"), F.col("r.doi"), who, abstract_of(F.to_json("r.abstract_inverted_index"))).alias("record")).select("record.*")


def crossref(df: DataFrame, payload: str) -> DataFrame:
    shape = "message struct<items:array<struct<title:array<string>,URL:string,DOI:string,abstract:string,issued:struct<`date-parts`:array<array<int>>>,author:array<struct<given:string,family:string>>>>>"
    rows = df.select(F.explode(F.from_json(payload, shape)["message"]["items"]).alias("r"))
    who = F.transform("r.author", lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    year = F.try_element_at(F.try_element_at(F.col("r.issued.date-parts"), F.lit(1)), F.lit(1))
    return rows.select(record(F.try_element_at("r.title", F.lit(1)), F.col("r.URL"), "crossref", year, F.col("r.DOI"), who, F.col("r.abstract")).alias("record")).select("record.*")


def europe_pmc(df: DataFrame, payload: str) -> DataFrame:
    shape = "resultList struct<result:array<struct<title:string,doi:string,pubYear:string,authorString:string,abstractText:string,id:string,source:string>>>"
    rows = df.select(F.explode(F.from_json(payload, shape)["resultList"]["result"]).alias("r"))
    who = F.split(F.regexp_replace("r.authorString", r"\.$", ""), r",\s*")
    url = F.coalesce(F.concat(F.lit("https://doi.org/"), F.col("r.doi")), F.concat(F.lit("https://europepmc.org/article/"), F.col("r.source"), F.lit("/"), F.col("r.id")))
    return rows.select(record(F.col("r.title"), url, "europepmc", F.col("r.pubYear"), F.col("r.doi"), who, F.col("r.abstractText")).alias("record")).select("record.*")


def semantic_scholar(df: DataFrame, payload: str) -> DataFrame:
    shape = "data array<struct<title:string,url:string,year:int,abstract:string,externalIds:struct<DOI:string>,authors:array<struct<name:string>>>>"
    rows = df.select(F.explode(F.from_json(payload, shape)["data"]).alias("r"))
    return rows.select(record(F.col("r.title"), F.col("r.url"), "semantic_scholar", F.col("r.year"), F.col("r.externalIds.DOI"), F.col("r.authors.name"), F.col("r.abstract")).alias("record")).select("record.*")


def searx(df: DataFrame, payload: str, n: int) -> DataFrame:
    rows = df.select(F.explode(F.slice(F.from_json(payload, "results array<struct<title:string,url:string,content:string>>")["results"], 1, n)).alias("r"))
    return rows.where(F.col("r.url").rlike("^https?://")).select(record(F.col("r.title"), F.col("r.url"), "searx", abstract=F.col("r.content")).alias("record")).select("record.*")


def result_page(df: DataFrame, html: str) -> DataFrame:
    """title, url of the result anchors of a search page, redirect targets decoded."""
    anchor = r"""(?is)<a[^>]+class=["'][^"']*result__a[^"']*["'][^>]*>.*?</a>"""
    a = df.select(F.explode(F.regexp_extract_all(html, F.lit(anchor), F.lit(0))).alias("a"))
    href = F.replace(F.regexp_extract("a", r"""(?i)href=["']([^"']*)["']""", 1), F.lit("&amp;"), F.lit("&"))
    target = F.nullif(F.regexp_extract(href, r"[?&]uddg=([^&]*)", 1), F.lit(""))
    return a.select(strip_tags(F.col("a")).alias("title"), F.coalesce(F.try_url_decode(target), href).alias("url")).where(F.col("url").rlike("^https?://"))


def opensearch(df: DataFrame, payload: str) -> DataFrame:
    """title, snippet, url of an [query, titles, snippets, urls] answer."""
    at = lambda i: F.from_json(F.get_json_object(payload, f"$[{i}]"), "array<string>")
    rows = df.select(F.explode(F.arrays_zip(at(1).alias("title"), at(2).alias("snippet"), at(3).alias("url"))).alias("r"))
    return rows.select("r.title", "r.snippet", "r.url")


def filings(df: DataFrame, payload: str) -> DataFrame:
    """title, url, date of filing-search hits, whose ids are accession:file."""
    shape = "hits struct<hits:array<struct<_id:string,_source:struct<display_names:array<string>,ciks:array<string>,file_date:string,form:string>>>>"
    r = df.select(F.explode(F.from_json(payload, shape)["hits"]["hits"]).alias("r"))
    number, name = F.substring_index("r._id", ":", 1), F.substring_index("r._id", ":", -1)
    cik = F.regexp_replace(F.try_element_at("r._source.ciks", F.lit(1)), "^0+", "")
    url = F.concat_ws("/", F.lit("https://www.sec.gov/Archives/edgar/data"), cik, F.replace(number, F.lit("-"), F.lit("")), name)
    return r.select(F.concat_ws(" ", F.try_element_at("r._source.display_names", F.lit(1)), F.col("r._source.form")).alias("title"), url.alias("url"), F.col("r._source.file_date").alias("date"))


def atom_entries(df: DataFrame, xml: str) -> DataFrame:
    """title, url, summary, updated of a feed's entries or items; an entry titled Error is the
    service's failure and is left out."""
    body = df.select(F.explode(F.regexp_extract_all(xml, F.lit(r"(?is)<(?:entry|item)\b.*?</(?:entry|item)>"), F.lit(0))).alias("e"))

    def tag(name: str) -> Column:
        return F.nullif(collapse(F.regexp_replace(F.regexp_extract("e", rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1), r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")), F.lit(""))

    link = F.coalesce(F.nullif(F.regexp_extract("e", r"""(?is)<link\b[^>]*href=["']([^"']+)["']""", 1), F.lit("")), tag("link"), tag("guid"), tag("id"))
    out = body.select(tag("title").alias("title"), link.alias("url"), F.coalesce(tag("summary"), tag("description")).alias("summary"), F.coalesce(tag("updated"), tag("pubDate")).alias("updated"))
    return out.where(~F.col("title").eqNullSafe("Error"))


def feed_entry(entries: DataFrame, key: Column, wanted: str, title: str | None = None) -> DataFrame:
    """The only entry whose address key is the wanted one, else the only one with the title."""
    by_url = entries.where(key == wanted)
    n = by_url.limit(2).count()
    if n == 1:
        return by_url
    by_title = entries.where(F.col("title") == title) if title else entries.limit(0)
    return by_title if n == 0 and by_title.limit(2).count() == 1 else entries.limit(0)
