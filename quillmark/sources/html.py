"""Images of pages. The parser keeps a stack of open figures, which no expression can; it runs
once per page in an Arrow UDF."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST = 30
_SHAPE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("url", "kind", "caption", "alt", "adjacent_text")]))


class _Images(HTMLParser):
    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.found, self.text, self.hidden = base, [], "", 0
        self.figure: list | None = None
        self.caption: list[str] | None = None

    def _add(self, url: str | None, kind: str, alt: str = "") -> None:
        if url and not url.startswith("data:"):
            item = {"url": urljoin(self.base, url), "kind": kind, "caption": None, "alt": alt, "adjacent_text": " ".join(self.text.split())[-200:]}
            self.found.append(item)
            if self.figure is not None:
                self.figure.append(item)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag == "img":
            self._add(a.get("src") or a.get("data-src"), "img" if self.figure is None else "figure", a.get("alt") or "")
        elif tag == "meta" and a.get("property") == "og:image":
            self._add(a.get("content"), "og")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1
        elif tag == "figcaption" and self.caption is not None:
            for item in self.figure or []:
                item["caption"] = " ".join("".join(self.caption).split())
            self.caption = None
        elif tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if self.caption is not None:
            self.caption.append(data)
        elif not self.hidden:
            self.text = (self.text + " " + data)[-400:]


def images_of(html: str, base: str, most: int = MOST) -> list[dict]:
    """First `most` images, the first of equal addresses, with a later one's caption if it
    lacks its own."""
    parser = _Images(base)
    parser.feed(html or "")
    kept: dict[str, dict] = {}
    for item in parser.found:
        first = kept.setdefault(item["url"], item)
        first["caption"] = first["caption"] or item["caption"]
    return list(kept.values())[:most]


@F.pandas_udf(_SHAPE)
def page_images(pages: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for html, url in pages:
        yield pd.Series([images_of(h, u or "") for h, u in zip(html, url, strict=True)])


def figure_score(area: Column, caption: Column, vectors: Column, aspect: Column, repeats: Column) -> Column:
    """Worth of an image as an infographic: area, caption and drawing density, less for odd
    aspects, small images and repeated layouts."""
    caption_points = F.when(F.length(F.coalesce(caption, F.lit(""))) > 0, 0.3).otherwise(0.0)
    return F.least(area, F.lit(1.0)) * 0.5 + caption_points + F.least(vectors / 100.0, F.lit(1.0)) * 0.2 - F.when((aspect > 4) | (aspect < 0.25), 0.2).otherwise(0.0) - F.when(area < 0.05, 0.3).otherwise(0.0) - F.when(repeats > 2, 0.4).otherwise(0.0)


def layout_signature(*coordinates: Column) -> Column:
    """Coordinates (shares of the page) on a grid of 2 %."""
    return F.array(*[F.round(c / 0.02).cast("int") for c in coordinates])


def repeated_layouts(figures: DataFrame, doc: str, signature: str, page: str) -> DataFrame:
    """doc, signature, pages: on how many pages a layout occurs."""
    return figures.groupBy(doc, signature).agg(F.count_distinct(page).alias("pages"))


def merge_rectangles(rects: list[tuple[float, float, float, float]], gap: float = 0.0) -> list[tuple[float, float, float, float]]:
    """Rectangles (x0, y0, x1, y1) joined where they overlap or are at most `gap` apart."""
    todo, out = [tuple(r) for r in rects], []
    while todo:
        x0, y0, x1, y1 = todo.pop()
        near = [r for r in [*todo, *out] if r[0] <= x1 + gap and x0 <= r[2] + gap and r[1] <= y1 + gap and y0 <= r[3] + gap]
        if near:
            todo = [r for r in todo if r not in near]
            out = [r for r in out if r not in near]
            both = [(x0, y0, x1, y1), *near]
            todo.append((min(r[0] for r in both), min(r[1] for r in both), max(r[2] for r in both), max(r[3] for r in both)))
        else:
            out.append((x0, y0, x1, y1))
    return sorted(out)


_BOXES = T.ArrayType(T.StructType([T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")]))


@F.pandas_udf(_BOXES)
def merge_boxes(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """merge_rectangles of a page's boxes (an array of structs) and a gap; null has none."""
    names = ("x0", "y0", "x1", "y1")
    for rects, gap in columns:
        merged = [merge_rectangles([tuple(r[n] for n in names) for r in boxes], g) if boxes is not None else [] for boxes, g in zip(rects, gap, strict=True)]
        yield pd.Series([[dict(zip(names, r, strict=True)) for r in boxes] for boxes in merged])
