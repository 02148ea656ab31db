"""Bibliographic records of references: candidates from several registries, one winner each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import refs
from quillmark.functions.text import collapse

#: Where a record can come from, best first.
ORDER = ["manual", "doi", "body doi", "openalex", "search", "patent", "page"]
RECORD = "struct<kind:string,title:string,authors:array<string>,year:string,container:string,doi:string>"

# Names of meta fields, and words of applicants that are organisations.
DOI_FIELDS = ["citation_doi", "dc.identifier", "prism.doi", "dc.identifier.doi", "bepress_citation_doi"]
TITLE_FIELDS = ["citation_title", "og:title"]
_ORGANISATION = r"\b(?:Co|GmbH|AB|B\.V\.|Ltd|Inc|Corp|KG|AG|SA|Organisatie|Universit|Institut|Kabushiki|Holding|Technologies)\b|Co\."
_DOI = r"10\.\d{4,9}/[^\s\"'<>?#]+"


def meta_values(html: Column, *names: str) -> Column:
    """Contents of meta elements with one of these names or properties, in order of the names,
    whichever attribute comes first."""
    found, low = [], F.lower(html)
    for name in names:
        n = name.replace(".", r"\.")
        label = rf"(?:name|property)\s*=\s*[\"']{n}[\"']"
        for pattern in (rf"(?is)<meta\s[^>]*?{label}[^>]*?content\s*=\s*[\"']([^\"']*)[\"']", rf"(?is)<meta\s[^>]*?content\s*=\s*[\"']([^\"']*)[\"'][^>]*?{label}"):
            # most pages lack most names, and a search for a name costs a fraction of the pattern
            found.append(F.when(F.contains(low, F.lit(name.lower())), F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).otherwise(F.array().cast("array<string>")))
    return F.filter(F.array_distinct(F.flatten(F.array(*found))), lambda v: F.trim(v) != "")


def _doi_in(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(text, _DOI, 0), r"[.,;)]+$", ""), F.lit(""))


def doi_candidates(pages: DataFrame) -> DataFrame:
    """url, doi, place, trusted: DOIs of the address and of the page's meta fields and tagged
    identifiers are trusted, those that its text links or names aren't: they may be another
    work's. pages: url, html. Lower-cased DOIs of an address are told apart once; its own comes
    first."""
    html = F.coalesce(F.col("html"), F.lit(""))
    tagged = F.regexp_extract_all(html, F.lit(r"pub-id-type=\"doi\"[^>]*>\s*(10\.[^<\s]+)"), F.lit(1))
    sure = F.concat(F.array(refs.doi_of(F.col("url"))), F.transform(F.concat(meta_values(html, *DOI_FIELDS), tagged), _doi_in))
    text = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    loose = F.regexp_extract_all(text, F.lit(rf"(?i)(?:doi\.org/|doi[:\s]\s*)({_DOI})"), F.lit(1))
    rows = pages.select("url", F.concat(F.transform(sure, lambda d: F.struct(d.alias("doi"), F.lit(True).alias("trusted"))), F.transform(loose, lambda d: F.struct(_doi_in(d).alias("doi"), F.lit(False).alias("trusted")))).alias("c"))
    flat = rows.select("url", F.posexplode("c").alias("place", "c")).select("url", F.regexp_replace("c.doi", "/$", "").alias("doi"), "place", "c.trusted").where("doi is not null and doi <> ''")
    first = F.row_number().over(Window.partitionBy("url", F.lower("doi")).orderBy("place"))
    return flat.withColumn("_n", first).where("_n = 1").drop("_n")


def _record(kind, title, authors=None, year=None, container=None, doi=None) -> Column:
    text = lambda x: F.lit(None).cast("string") if x is None else x.cast("string")
    names = F.array().cast("array<string>") if authors is None else authors
    return F.struct(F.lit(kind).alias("kind"), text(title).alias("title"), names.alias("authors"), text(year).alias("year"), text(container).alias("container"), text(doi).alias("doi"))


def patent_record(url: Column, html: Column) -> Column:
    """A patent's record: its number from the address; title, year and applicant from the page's
    fields: the last contributor that is an organisation, else the contributors by name; without
    a date the year in the number."""
    number = F.regexp_extract(url, r"/patent/([A-Z0-9]+)", 1)
    people = F.transform(meta_values(html, "DC.contributor"), collapse)
    firms = F.filter(people, lambda c: c.rlike(_ORGANISATION))
    authors = F.when(F.size(firms) > 0, F.slice(firms, -1, 1)).otherwise(F.transform(F.filter(people, lambda c: c.contains(" ")), refs.initials))
    dated = F.nullif(F.regexp_extract(F.element_at(F.concat(F.array(F.lit("")), meta_values(html, "DC.date")), -1), r"(?<!\d)(19[89]\d|20[0-2]\d)(?!\d)", 1), F.lit(""))
    year = F.coalesce(dated, F.nullif(F.regexp_extract(number, r"^(?:WO|US)(\d{4})", 1), F.lit("")), F.lit("n.d."))
    title = collapse(F.coalesce(F.try_element_at(meta_values(html, "DC.title"), F.lit(1)), F.lit("")))
    return _record("patent", title, authors, year, number)


def page_record(html: Column) -> Column:
    """A page's record: its citation or sharing title, else its title without the site's name."""
    found = F.concat(meta_values(html, *TITLE_FIELDS), F.array(refs.page_title(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))))
    title = F.nullif(found[0], F.lit(""))
    year = F.nullif(F.regexp_extract(F.array_join(meta_values(html, "citation_publication_date", "article:published_time"), " "), r"(?<!\d)(19[89]\d|20[0-2]\d)(?!\d)", 1), F.lit(""))
    return F.when(title.isNotNull(), _record("web", collapse(title), F.transform(meta_values(html, "citation_author"), refs.initials), F.coalesce(year, F.lit("n.d.")), F.try_element_at(meta_values(html, "og:site_name"), F.lit(1))))


def title_guess(html: Column) -> Column:
    """All titles that a page gives itself, for comparison with a registry's."""
    return F.concat_ws(" ", F.array_join(meta_values(html, *TITLE_FIELDS), " "), F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def resolved(pages: DataFrame, manual: DataFrame | None = None, registries: list[DataFrame] = [], openalex: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """url, src, record of each reference (url, html): one winner, by rank of ORDER.

    manual: url, record, doi: entries by hand; one that has no title takes the registries' record of
    its DOI. registries: doi, record each, the first that knows a DOI wins. A trusted DOI's
    record needs a title; a DOI from the text counts only if the record's title fits the
    page's. openalex: url, record of works; an address there with a query is a search. Then
    patents and titles of pages. A reference that nothing knows has nulls.

    Each source is an equi-join on address or DOI, so all of it is shuffles; the candidates of a
    reference are a handful, the best by (rank, place) is one aggregation."""
    known = None
    for i, r in enumerate(registries):
        rows = r.select(F.lower("doi").alias("_doi"), F.col("record").cast(RECORD).alias("record"), F.lit(i).alias("_at"))
        known = rows if known is None else known.union(rows)
    pages = pages.select("url", F.coalesce("html", F.lit("")).alias("html")).dropDuplicates(["url"])
    html, url = F.col("html"), F.col("url")
    host = F.regexp_extract(url, r"^https?://(?:www\.)?([^/?#]+)", 1)
    parts = []

    def offer(df: DataFrame, src: str, place: Column) -> None:
        rank = ORDER.index(src)
        parts.append(df.select("url", F.struct(F.lit(rank).alias("rank"), place.cast("int").alias("place")).alias("at"), F.col("record").cast(RECORD).alias("record")))

    if known is not None:
        best = known.groupBy("_doi").agg(F.min_by("record", "_at").alias("record"))
        named = doi_candidates(pages).join(best, F.lower("doi") == F.col("_doi")).where("coalesce(record.title, '') <> ''")
        offer(named.where("trusted"), "doi", F.col("place"))
        guessed = named.where("not trusted").join(pages.select("url", title_guess(html).alias("_t")), "url")
        offer(guessed.where(refs.title_match(F.col("record.title"), F.col("_t"))), "body doi", F.col("place"))
    if manual is not None:
        m = manual.select("url", F.col("record").cast(RECORD).alias("record"), "doi")
        if known is not None:
            m = m.join(best.select("_doi", F.col("record").alias("_r")), F.lower("doi") == F.col("_doi"), "left")
            m = m.withColumn("record", F.when(F.col("record.title").isNull(), F.coalesce("_r", "record")).otherwise(F.col("record")))
        offer(m.join(pages, "url", "left_semi"), "manual", F.lit(0))
    if openalex is not None:
        offer(openalex.select("url", "record").join(pages.where(host.isin("api.openalex.org", "openalex.org")), "url", "left_semi").where("coalesce(record.title, '') <> ''"), "openalex", F.lit(0))
    search = F.when(host.isin("api.openalex.org", "openalex.org") & url.contains("?"), _record("web", F.concat(F.lit("OpenAlex API 검색 결과: "), F.substring(F.try_url_decode(F.substring_index(url, "?", -1)), 1, 90)), F.array(F.lit("OpenAlex")), F.lit("n.d.")))
    for src, record in (("search", search), ("patent", F.when(url.contains("patents.google.com") & url.contains("/patent/"), patent_record(url, html))), ("page", page_record(html))):
        offer(pages.select("url", record.alias("record")).where("record.kind is not null"), src, F.lit(0))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    src = F.element_at(F.array(*map(F.lit, ORDER)), F.col("_b.at.rank") + 1)
    won = every.groupBy("url").agg(F.min(F.struct("at", "record")).alias("_b")).select("url", src.alias("src"), F.col("_b.record").alias("record"))
    return pages.select("url").join(won, "url", "left")
