"""Text functions: pages, excerpts, redaction, identifiers, display."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Phrases that show a page isn't the document asked for.
BODY_SUSPECT = {
    "not_found": ("page not found", "페이지를 찾을 수 없", "요청하신 페이지"),
    "login": ("로그인이 필요", "로그인 후 이용", "sign in to continue"),
    "access_denied": ("access denied", "접근이 거부"),
    "consent": ("쿠키 사용에 동의", "accept all cookies"),
}
TITLE_SUSPECT = {
    "not_found": ("404", "not found", "page not found", "페이지를 찾을 수 없습니다"),
    "login": ("로그인", "sign in", "log in"),
    "access_denied": ("access denied", "접근이 거부"),
}
CHALLENGE = ("captcha", "cf-challenge", "just a moment", "checking your browser", "attention required")
BLOCKED_BODY = r"(?i)captcha|anomaly|cf-challenge|g-recaptcha|hcaptcha|challenge-form"
SECRET = r"(?i)((?:api[_-]?)?key|secret|password|auth|token|mailto|email)=[^&\s]+"
BEARER_OR_MAIL = r"(?i)Bearer\s+\S+|[\w.+-]+@[\w-]+\.[\w.]+"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def excerpt(text: Column, size: int = 280) -> Column:
    """White space collapsed, at most `size` characters, no space at the end."""
    return F.rtrim(F.substring(collapse(text), 1, size))


def mask(text: Column) -> Column:
    """Secrets after key=, password= and the like, bearer tokens and mail addresses hidden."""
    return F.regexp_replace(F.regexp_replace(text, SECRET, "$1=***"), BEARER_OR_MAIL, "***")


def compact_key(text: Column) -> Column:
    """Lower-case, without white space and hyphens."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s-]+", "")


@F.pandas_udf(T.StringType())
def folded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, casefold, white space collapsed. Python: Spark has no Unicode normaliser."""
    import unicodedata

    for s in texts:
        yield s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


@F.pandas_udf(T.StringType())
def accents_folded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFD without marks, lower-case letters and digits only. Python for the same reason."""
    import unicodedata

    for s in texts:
        yield s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t.lower()) if c.isalnum() and not unicodedata.combining(c)))


def page_title(html: Column) -> Column:
    """<title>, else og:title in either attribute order; trimmed, null if there is none."""
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    first = F.regexp_extract(html, r"""(?is)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']*)["']""", 1)
    second = F.regexp_extract(html, r"""(?is)<meta[^>]+content=["']([^"']*)["'][^>]+property=["']og:title["']""", 1)
    found = F.coalesce(*[F.when(F.length(collapse(c)) > 0, collapse(c)) for c in (title, first, second)])
    return found


def page_description(html: Column) -> Column:
    name = r"""(?:property|name)=["'](?:og:)?description["']"""
    first = F.regexp_extract(html, rf"""(?is)<meta[^>]+{name}[^>]+content=["']([^"']*)["']""", 1)
    second = F.regexp_extract(html, rf"""(?is)<meta[^>]+content=["']([^"']*)["'][^>]+{name}""", 1)
    return F.coalesce(*[F.when(F.length(collapse(c)) > 0, collapse(c)) for c in (first, second)])


def html_text(html: Column) -> Column:
    """Scripts, styles and tags replaced by spaces."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    return F.regexp_replace(bare, r"<[^>]+>", " ")


def _starts(low: Column, phrase: str) -> Column:
    rest = F.substring(low, len(phrase) + 1, 1)
    return low.startswith(phrase) & ~rest.rlike(r"[\p{L}\p{N}]")


def suspect_title(title: Column) -> Column:
    """Kind of a title that names an error: it is, starts with or has before the first
    separator one of the phrases; null otherwise."""
    low = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    first = F.trim(F.element_at(F.split(low, r"\s*[-|·:]\s*", 2), 1))
    out = F.lit(None).cast("string")
    for kind, phrases in reversed(TITLE_SUSPECT.items()):
        hit = F.lit(False)
        for p in phrases:
            hit = hit | (low == p) | (first == p) | _starts(low, p)
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def suspect_body(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(None).cast("string")
    for kind, phrases in reversed(BODY_SUSPECT.items()):
        out = F.when(F.reduce(F.array(*[low.contains(p) for p in phrases]), F.lit(False), lambda a, b: a | b), F.lit(kind)).otherwise(out)
    return out


def dead_title(title: Column) -> Column:
    sep = r"[\s:\-|·–—]*"
    return F.coalesce(F.trim(title).rlike(rf"(?i)^(?:(?:error|http){sep}404(?!\d)|404(?!\d){sep}(?:error|(?:page\s+)?not\s+found)(?![a-z])|(?:page\s+)?not\s+found(?![a-z])|페이지를 찾을 수 없습니다)"), F.lit(False))


def page_verdict(html: Column, status: Column, selectors: tuple[str, ...] = (), shells: tuple[str, ...] = (), long: int = 1000, small: int = 200) -> Column:
    """struct verdict, reason: ok, partial, challenge or empty by ordered rules."""
    low, body, title = F.lower(F.coalesce(html, F.lit(""))), html_text(html), page_title(html)
    n, size = F.length(body), F.length(F.coalesce(html, F.lit("")))
    suspect = F.coalesce(F.when(dead_title(title), F.lit("not_found")), F.when(n < long, F.coalesce(suspect_title(title), suspect_body(body))))
    say = lambda verdict, reason: F.struct(F.lit(verdict).alias("verdict"), reason.alias("reason"))
    rules = F.when(~F.coalesce(status.between(200, 299), F.lit(False)), say("empty", F.concat(F.lit("http "), F.coalesce(status.cast("string"), F.lit("none")))))
    for s in selectors:
        rules = rules.when(low.contains(s.lower()), say("ok", F.lit("success selector matched")))
    for s in shells:
        rules = rules.when(low.contains(s), say("partial", F.lit(f"error/shell page: {s}")))
    rules = rules.when(suspect.isNotNull(), say("partial", F.concat(F.lit("suspect:"), suspect)))
    rules = rules.when(n >= long, say("ok", F.concat(F.lit("body "), n.cast("string"), F.lit(" chars"))))
    for s in CHALLENGE:
        rules = rules.when(low.contains(s), say("challenge", F.lit(f"challenge marker: {s}")))
    rules = rules.when(size < small, say("empty", F.concat(F.lit("too small ("), size.cast("string"), F.lit("B)"))))
    return rules.otherwise(say("partial", F.concat(F.lit("thin body ("), n.cast("string"), F.lit(" chars)"))))


def thin_document(text: Column, floor: int = 3000, floor_hangul: int = 1500) -> Column:
    """A document text has fewer visible characters than its floor, which is lower if at least
    half of them are Hangul syllables. Null (no text layer) isn't thin."""
    body = F.regexp_replace(text, r"\s+", "")
    hangul = F.length(F.regexp_replace(body, r"[^가-힣]", ""))
    return F.coalesce(F.length(body) < F.when((F.length(body) > 0) & (hangul * 2 >= F.length(body)), floor_hangul).otherwise(floor), F.lit(False))


def search_block(status: Column, html: Column, hits: Column, results: Column) -> Column:
    """blocked, error, ok or empty from a search page's status, text, raw and kept hits."""
    blocked = F.coalesce(html, F.lit("")).rlike(BLOCKED_BODY)
    return (
        F.when(status.isin(403, 429), "blocked")
        .when(status.between(500, 599), "error")
        .when((results > 0) & (status == 200), "ok")
        .when((hits == 0) & blocked, "blocked")
        .when((status == 200) & (hits == 0), "empty")
        .when((hits > 0) & (results == 0), "error")
        .when(blocked, "blocked")
        .when(results > 0, "ok")
        .otherwise("error")
    )


def retryable(status: Column) -> Column:
    return (status == 429) | status.between(500, 599)


def cell_escape(text: Column) -> Column:
    """Safe in a markdown table cell."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " "))


def display_width(text: Column, wide: float = 2.0, narrow: float = 1.0) -> Column:
    """East Asian characters count `wide`, others `narrow`."""
    broad = F.length(text) - F.length(F.regexp_replace(text, r"[\u1100-\u115F\u2E80-\uA4CF\uAC00-\uD7A3\uF900-\uFAFF\uFE30-\uFE4F\uFF00-\uFF60\uFFE0-\uFFE6]", ""))
    return broad * F.lit(wide) + (F.length(text) - broad) * F.lit(narrow)


def heading_key(text: Column) -> Column:
    """Headings compared without numbering, marks and case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"^#+\s*|^\s*[0-9IVXivx]+[.)]\s*", ""), r"[\s*_`#]+", ""))


def tags(text: Column) -> Column:
    """Ids of (F001) and [F001] tags in order."""
    return F.regexp_extract_all(text, F.lit(r"(?:\((F\d{3,})\)|\[(F\d{3,})\])"), F.lit(0))


def tag_ids(text: Column) -> Column:
    return F.transform(tags(text), lambda t: F.regexp_extract(t, r"F\d{3,}", 0))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the JSON array of normalised parts; null differs from an empty string."""
    return F.sha2(F.to_json(F.array(*[F.lower(collapse(p.cast("string"))) for p in parts])), 256)


def contains_number(text: Column, number: Column) -> Column:
    """number occurs in text and isn't a piece of a longer one: 12.5 isn't in 12.57."""
    quoted = F.concat(F.lit(r"(?<![0-9])(?<![0-9][.,])\Q"), number, F.lit(r"\E(?![0-9])(?![.,][0-9])"))
    return F.expr("1 = 1") & F.regexp_like(text, quoted)


def media_seconds(offset: Column) -> Column:
    """Seconds of m:s or h:m:s, null for anything else."""
    fold = F.aggregate(F.split(offset, ":"), F.lit(0).cast("bigint"), lambda a, x: a * 60 + x.try_cast("bigint"))
    return F.when(offset.rlike(r"^\d+(?::\d{1,2}){1,2}$"), fold)


def number_tokens(text: Column) -> Column:
    """Numbers as written, commas removed."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0)), lambda t: F.replace(t, F.lit(","), F.lit("")))


def numeric_cell(cell: Column) -> Column:
    """An optional sign or currency, a number or range, and a unit of at most ten characters."""
    return F.trim(cell).rlike(r"^[~≈약]?\s*[$€£¥₩]?[+\-−]?\d[\d,]*(?:\.\d+)?(?:\s*[~–-]\s*\d[\d,]*(?:\.\d+)?)?\s*\S{0,10}$")


def iso_time(value: Column, timestamp: bool = False) -> Column:
    """YYYY, YYYY-MM, YYYY-MM-DD or an ISO datetime; only the latter if timestamp."""
    stamp = value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?$") & F.try_to_timestamp(value).isNotNull()
    if timestamp:
        return F.coalesce(stamp, F.lit(False))
    year = value.rlike(r"^\d{4}$") & (value != "0000")
    month = value.rlike(r"^\d{4}-\d{2}$") & F.try_to_timestamp(F.concat(value, F.lit("-01")), F.lit("yyyy-MM-dd")).isNotNull()
    day = value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).isNotNull()
    return F.coalesce(year | month | day | stamp, F.lit(False))


def clean_line(line: Column) -> Column:
    """Bullets off, white space collapsed."""
    return collapse(F.regexp_replace(line, r"^\s*(?:[-*+•·]|\d+[.)])\s+", ""))


def js_round(x: Column) -> Column:
    """Half towards plus infinity."""
    return F.floor(x + 0.5)
