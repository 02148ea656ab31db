"""Character sets of fetched pages, and their text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import arrow

#: Bytes of a page in which a declared character set counts.
HEAD = 2048
# Encodings tried for a local file, in this order.
FILE_ENCODINGS = ("utf-8", "gb18030", "euc-kr", "cp949", "latin-1")


def header_charset(content_type: Column) -> Column:
    """The charset parameter of a Content-Type, without quotes; null if there is none."""
    value = F.trim(F.regexp_extract(content_type, r"(?i);\s*charset=([^;]*)", 1))
    bare = F.regexp_replace(F.regexp_replace(value, '^"+|"+$', ""), "^'+|'+$", "")
    return F.nullif(bare, F.lit(""))


def meta_charset(raw: Column) -> Column:
    """The character set that a page's meta elements name; an http-equiv element counts only if
    it gives the content type. Null if there is none."""
    head = F.decode(F.substring(raw, 1, HEAD), "ISO-8859-1")
    elements = F.regexp_extract_all(head, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    fit = F.filter(elements, lambda m: ~F.lower(m).contains("http-equiv") | F.lower(m).contains("content-type"))
    named = F.transform(fit, lambda m: F.regexp_extract(m, r"(?i)charset\s*=\s*[\"']?\s*([A-Za-z0-9._-]+)", 1))
    return F.get(F.filter(named, lambda n: n != ""), F.lit(0))


@F.arrow_udf(T.StringType())
def decoded(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Bytes as text of a character set; an unknown one, or bytes that aren't of it, are read as
    UTF-8 with replacement characters. Python: Spark decodes a handful of character sets only."""

    def one(raw, charset):
        if raw is None:
            return None
        try:
            return raw.decode(charset)
        except (LookupError, UnicodeDecodeError):
            return raw.decode("utf-8", errors="replace")

    for batch in columns:
        for raws, charsets in arrow.slices(*batch):
            yield pa.array([one(r, c) for r, c in zip(raws.to_pylist(), charsets.to_pylist(), strict=True)], pa.string())


def page_text(raw: Column, content_type: Column) -> Column:
    """The text of a response: the header's character set, else the page's own, else UTF-8."""
    return decoded(raw, F.coalesce(header_charset(content_type), meta_charset(raw), F.lit("utf-8")))


@F.arrow_udf(T.StringType())
def file_text(raws: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Bytes of a file as text of the first of FILE_ENCODINGS that they are."""

    def one(raw):
        for encoding in FILE_ENCODINGS if raw is not None else ():
            try:
                return raw.decode(encoding)
            except UnicodeDecodeError:
                pass
        return None

    for batch in raws:
        for part in arrow.slices(batch):
            yield pa.array([one(raw) for raw in part.to_pylist()], pa.string())
