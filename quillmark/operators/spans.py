"""Quotes in documents: containment, minimal line windows, contexts."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions.text import clean_line, collapse
from quillmark.operators.quotes import contained_quotes

WINDOW_LINES = 40


def quote_key(text: Column, size: int = 8) -> Column:
    """The first `size` words of a text, for meeting documents in an equi-join."""
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, size), " ")


def _fragments(quote: str) -> list[str]:
    return [f for f in (" ".join(p.split()) for p in re.split(r"…|\.\.\.", quote)) if f]


def _places(text: str, fragment: str) -> list[int]:
    """Where a fragment stands; one that starts or ends with a digit isn't cut out of a longer
    number."""
    out, i = [], text.find(fragment)
    while i >= 0:
        end = i + len(fragment)
        before, after = text[max(0, i - 2) : i], text[end : end + 2]
        cut = (fragment[0].isdigit() and re.search(r"\d$|\d[.,]$", before)) or (fragment[-1].isdigit() and re.match(r"\d|[.,]\d", after))
        if not cut:
            out.append(i)
        i = text.find(fragment, i + 1)
    return out


def find_span(lines: list[str], quote: str, most: int = WINDOW_LINES) -> tuple[int, int] | None:
    """(line, end), counted from 1, of the smallest window of lines that has the quote: the
    earliest end wins for the earliest start, then the start is moved up as far as it goes.

    Fragments are looked for once in the joined lines. From each place of the first one, the next
    places of the others give the earliest end, so the work is linear in the text and in the
    places of fragments, however many windows there are."""
    fragments = _fragments(quote)
    if not fragments:
        return None
    parts, starts, numbers, size = [], [], [], 0
    for n, x in enumerate(lines):
        clean = " ".join(re.sub(r"^\s*(?:[-*+•·]|\d+[.)])\s+", "", x).split())
        if clean:
            starts.append(size)
            numbers.append(n)
            parts.append(clean)
            size += len(clean) + 1
    text = " ".join(parts)
    places = [_places(text, f) for f in fragments]
    line = lambda at: numbers[bisect_right(starts, at) - 1]
    ends = []
    for first in places[0]:
        at = first + len(fragments[0])
        for f, found in zip(fragments[1:], places[1:], strict=True):
            k = bisect_left(found, at)
            if k == len(found):
                break
            at = found[k] + len(f)
        else:
            ends.append(at)
            continue
        break  # what comes later has no end either
    before = -1
    for first, end in zip(places[0], ends, strict=False):
        last = line(end - 1)
        if max(before + 1, last - most + 1) <= line(first):
            at = max(first for first, e in zip(places[0], ends, strict=False) if line(e - 1) <= last)
            return line(at) + 1, last + 1
        before = line(first)
    return None


@F.pandas_udf(T.StructType().add("line", T.IntegerType()).add("end", T.IntegerType()))
def span_of(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Window of a quote (second column) in a text (first), null if it isn't there. Python:
    the window search has no built-in form; containment is tested before it is called."""
    for text, quote in texts:
        found = [find_span(t.split("\n"), q) if isinstance(t, str) and isinstance(q, str) else None for t, q in zip(text, quote, strict=True)]
        yield pd.DataFrame({"line": pd.array([f[0] if f else None for f in found], "Int32"), "end": pd.array([f[1] if f else None for f in found], "Int32")})


def check_spans(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """evidence_id, state (passed, not_found, no_document, no_quote), line, end.

    evidence: id, verbatim, clean, sha256, local; documents: key, text. The key is the span's
    own clean reference, else the first 12 digits of the hash, else the local file's name."""
    key = F.coalesce(F.nullif(F.col("clean"), F.lit("")), F.lower(F.substring("sha256", 1, 12)), F.regexp_extract("local", r"([^/]+)$", 1))
    e = evidence.select(F.col("id").alias("evidence_id"), "verbatim", key.alias("key")).join(documents, "key", "left")
    found = e.withColumn("s", F.when(F.col("text").isNotNull() & F.col("verbatim").isNotNull(), span_of("text", "verbatim")))
    state = F.when(F.length(F.trim(F.coalesce("verbatim", F.lit("")))) == 0, "no_quote").when(F.col("text").isNull(), "no_document").when(F.col("s.line").isNull(), "not_found").otherwise("passed")
    return found.select("evidence_id", state.alias("state"), F.col("s.line").alias("line"), F.col("s.end").alias("end"))


def lines_of(documents: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """key, line (from 1), content; form feeds don't end a line."""
    return documents.select(key, F.posexplode(F.split(text, "\n", -1)).alias("_p", "content")).select(key, (F.col("_p") + 1).alias("line"), "content")


def context(lines: DataFrame, key: str, n: int = 6) -> DataFrame:
    """lines with the text of n lines before and after."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(-n, n)
    return lines.withColumn("context", F.array_join(F.collect_list("content").over(w), "\n"))


def suggest_support(links: DataFrame) -> DataFrame:
    """fact_id with the best support of its evidence: supported if the quote has the value,
    the entity and every year of the claim, partial if it has the value.

    links: fact_id, evidence_id, verbatim, raw, entity, claim."""
    v, has = collapse(F.col("verbatim")), lambda c: F.contains(collapse(F.col("verbatim")), c)
    years = F.regexp_extract_all("claim", F.lit(r"(?<!\d)(?:19|20)\d{2}(?!\d)"), F.lit(0))
    value = has(F.col("raw"))
    full = value & has(F.col("entity")) & F.forall(years, lambda y: v.contains(y))
    rank = F.when(full, 2).when(value, 1).otherwise(0)
    return links.withColumn("_r", F.coalesce(rank, F.lit(0))).groupBy("fact_id").agg(F.max("_r").alias("_r"), F.max_by("evidence_id", F.struct("_r", "evidence_id")).alias("evidence_id")).select(
        "fact_id", F.when(F.col("_r") == 2, "supported").when(F.col("_r") == 1, "partial").otherwise("unsupported").alias("support"), "evidence_id"
    )


def best_evidence(links: DataFrame) -> DataFrame:
    """The evidence shown for each fact: hash equal to the lead's reread first, then a passed
    quote. links: fact_id, evidence_id, rereads (hashes), sha256, passed."""
    first = F.struct(~F.exists("rereads", lambda h: F.lower(h) == F.lower("sha256")), ~F.coalesce("passed", F.lit(False)), F.col("evidence_id"))
    return links.groupBy("fact_id").agg(F.min_by("evidence_id", first).alias("evidence_id"))


def nearest_caption(figures: DataFrame, lines: DataFrame, most: int = 2) -> DataFrame:
    """Each figure's caption: an explicit one first, then the nearest line within `most`.
    figures: key, figure, at; lines: key, line, content, explicit."""
    near = figures.join(lines, "key").where(F.abs(F.col("line") - F.col("at")) <= most)
    return near.groupBy("key", "figure").agg(F.min_by("content", F.struct(~F.col("explicit"), F.abs(F.col("line") - F.col("at")), "line")).alias("caption"))


__all__ = ["best_evidence", "check_spans", "clean_line", "contained_quotes", "context", "find_span", "lines_of", "nearest_caption", "quote_key", "span_of", "suggest_support"]
