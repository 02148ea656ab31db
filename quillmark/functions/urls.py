"""URL keys, hosts and derived addresses (three different keys, on purpose)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query names that never tell documents apart.
TRACKING = ("fbclid", "gclid")

_SPLIT = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _SPLIT, i)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_replace(_part(url, 1), ":$", ""))


def authority(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", ""))


def publisher(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def search_key(url: Column) -> Column:
    """Key for deduplicating results: scheme and host lower-case, no fragment, no tracking
    names, no trailing slash, query sorted. Text without a host is its own key."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    pairs = F.filter(F.split(query(raw), "&"), lambda q: (q != "") & ~F.lower(q).startswith("utm_") & ~F.lower(F.substring_index(q, "=", 1)).isin(*TRACKING))
    pairs = F.array_sort(F.transform(pairs, lambda q: F.when(q.contains("="), q).otherwise(F.concat(q, F.lit("=")))))
    rest = F.regexp_replace(path(raw), "/+$", "")
    tail = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return F.when(authority(raw) == "", raw).otherwise(F.concat(scheme(raw), F.lit("://"), F.lower(authority(raw)), rest, tail))


def redirect_key(url: Column) -> Column:
    """Key for comparing a request with where it ended: also without scheme, www., m. and
    index.html, percent-decoded; the port and other query values stay."""
    decode = lambda c: F.coalesce(F.try_url_decode(c), c)
    name = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r"^m\.", "")
    port = F.regexp_extract(authority(url), r":(\d+)$", 1)
    rest = F.regexp_replace(F.regexp_replace(decode(F.replace(path(url), F.lit("+"), F.lit("%2B"))), r"/index\.html?$", ""), "/+$", "")
    pairs = F.transform(F.split(query(url), "&"), lambda q: decode(q))
    pairs = F.array_sort(F.filter(pairs, lambda q: (q != "") & ~F.lower(q).startswith("utm_")))
    return F.concat(name, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), rest, F.lit("?"), F.array_join(pairs, "&"))


def coverage_key(url: Column) -> Column:
    """Key for finding a source in a log: trimmed, no trailing slashes."""
    return F.regexp_replace(F.trim(url), "/+$", "")


def redirected_elsewhere(requested: Column, final: Column) -> Column:
    """The request ended at another document; a home page may lead anywhere."""
    home = path(requested).isin("", "/") & (query(requested) == "")
    known = (F.coalesce(requested, F.lit("")) != "") & (F.coalesce(final, F.lit("")) != "")
    return F.coalesce(known & ~home & (redirect_key(requested) != redirect_key(final)), F.lit(False))


def host_allowed(name: Column, sites: Column) -> Column:
    """name equals one of an array of sites or is below one."""
    return F.exists(sites, lambda s: (name == F.lower(s)) | F.endswith(name, F.concat(F.lit("."), F.lower(s))))


def mobile_urls(url: Column) -> Column:
    """Addresses of the mobile page and of feeds to try, distinct and other than url."""
    base = F.concat(scheme(url), F.lit("://"))
    name = F.regexp_replace(authority(url), r"^www\.", "")
    mobile = F.concat(base, F.lit("m."), name, path(url), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(""))
    feeds = [F.concat(base, authority(url), F.lit(x)) for x in ("/rss", "/feed", "/rss.xml", "/atom.xml")]
    found = F.array(F.when(~name.startswith("m."), mobile), *feeds)
    return F.filter(F.array_distinct(F.array_compact(found)), lambda u: u != url)


@F.pandas_udf(T.BooleanType())
def reserved_address(hosts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether a host is an address that isn't of the public internet: private, loopback,
    link-local, multicast, reserved or unspecified, also one of these as a mapped IPv6 address.
    Names are no addresses. Python: the ranges are the standard library's."""
    import ipaddress

    def one(host):
        try:
            address = ipaddress.ip_address((host or "").strip("[]"))
        except ValueError:
            return False
        address = getattr(address, "ipv4_mapped", None) or address
        return not address.is_global or address.is_multicast or address.is_reserved

    for s in hosts:
        yield s.map(one).astype(bool)


def unsafe(url: Column) -> Column:
    """Static part of URL safety: no http(s), user info, control characters, no host, this
    machine's name or an address that isn't public. Only hosts that look like addresses reach
    Python."""
    name = host(url)
    address = F.when(name.rlike(r"^[\d.]+$|^\["), name)
    return ~scheme(url).isin("http", "https") | authority(url).contains("@") | url.rlike(r"[\x00-\x20\x7f]") | (name == "") | name.rlike(r"^localhost\.?$") | reserved_address(address)


def file_extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1))


# Document types by MIME type and by extension.
DOCUMENT_MIME = {
    "application/pdf": "pdf",
    "application/msword": "doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.ms-excel": "xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.ms-powerpoint": "ppt",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/x-hwp": "hwp",
    "application/haansofthwp": "hwp",
    "application/vnd.hancom.hwp": "hwp",
    "application/vnd.hancom.hwpx": "hwpx",
}


def document_kind(mime: Column, url: Column) -> Column:
    """Kind of a document by its MIME type, by extension for octet streams, else null."""
    base = F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))
    kinds = F.create_map(*[F.lit(x) for pair in DOCUMENT_MIME.items() for x in pair])
    extension = file_extension(url)
    return F.coalesce(F.try_element_at(kinds, base), F.when((base == "application/octet-stream") & extension.isin(*{*DOCUMENT_MIME.values()}), extension))
