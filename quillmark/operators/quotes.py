"""Which documents contain which quotes, byte for byte."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts of quotes, in bytes, that are sent to every task; more meet the documents in a join.
BROADCAST_BYTES = 16 << 20
#: Bytes of a key, and key positions of which a sampled one is the smallest.
KEY, SPREAD = 16, 16
#: Text bytes looked at at once.
SLICE = 4 << 20

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[1]
    return h ^ (h >> np.uint64(29))


def window_keys(buf: np.ndarray, size: int) -> np.ndarray:
    """A number for the `size` bytes from each place on: up to 8 bytes themselves, of more a
    hash. size is a power of two."""
    n = len(buf) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    value, width = buf.astype(np.uint64), 1
    while width < min(size, 8):
        value = value[: len(value) - width] | (value[width:] << np.uint64(8 * width))
        width *= 2
    while width < size:
        value = _mixed(value[: len(value) - width] * _ODD[0] + value[width:])
        width *= 2
    return value[:n]


def _sampled(keys: np.ndarray, spread: int) -> np.ndarray:
    """Places whose key is the smallest of some `spread` consecutive ones (all, if fewer)."""
    order = _mixed(keys)
    if len(order) <= spread:
        return np.flatnonzero(order == order.min()) if len(order) else np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(order, spread)
    lowest = windows.argmin(axis=1) + np.arange(len(windows))
    return np.unique(lowest)


class Quotes:
    """Distinct texts by a key of each: the rarest-looking window of the largest size that fits."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        by_size: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, text in enumerate(texts):
            if text:
                size = min(KEY, 1 << (len(text).bit_length() - 1))
                keys = window_keys(np.frombuffer(text, np.uint8), size)
                by_size[size][int(keys[_mixed(keys).argmin()])].append(i)
        self.by_size = {size: dict(found) for size, found in by_size.items()}
        self.keys = {size: np.array(sorted(found), np.uint64) for size, found in self.by_size.items()}
        # most windows are ruled out by 16 bits
        self.seen = {}
        for size, keys in self.keys.items():
            self.seen[size] = np.zeros(1 << 16, bool)
            self.seen[size][(_mixed(keys) & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.empty = [i for i, text in enumerate(texts) if not text]

    def inside(self, buf: np.ndarray, bounds: np.ndarray, raw: bytes) -> list[tuple[int, int]]:
        """(text number in the slice, quote number) of every containment."""
        out = [(d, i) for i in self.empty for d in range(len(bounds) - 1)]
        candidates: set[tuple[int, int]] = set()
        for size, keys in self.keys.items():
            every = window_keys(buf, size)
            at = np.flatnonzero(self.seen[size][(_mixed(every) & np.uint64(0xFFFF)).astype(np.int64)])
            value = every[at]
            place = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
            hit = keys[place] == value
            at, value = at[hit], value[hit]
            doc = np.searchsorted(bounds, at, side="right") - 1
            whole = at + size <= bounds[doc + 1]  # no window over the end of a text
            found = self.by_size[size]
            for d, v in set(zip(doc[whole].tolist(), value[whole].tolist(), strict=True)):
                candidates.update((d, i) for i in found[v])
        for d, i in candidates:
            if raw.find(self.texts[i], int(bounds[d]), int(bounds[d + 1])) >= 0:
                out.append((d, i))
        return out


def _slices(batch: pa.RecordBatch):
    """(first row, bytes, offsets) of parts of a batch (id, text) with some SLICE bytes each."""
    text = batch.column(1)
    if pa.types.is_large_string(text.type):
        text = text.cast(pa.string())
    data = text.buffers()[2]
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
        raw = data.slice(offsets[i], offsets[j] - offsets[i]).to_pybytes() if data is not None else b""
        yield i, np.frombuffer(raw, np.uint8), offsets[i : j + 1] - offsets[i], raw
        i = j


def _by_broadcast(texts: list[str], docs: DataFrame) -> DataFrame:
    """(text, d): the texts that each document contains, in one scan without a shuffle."""
    broadcast = docs.sparkSession.sparkContext.broadcast(Quotes([t.encode() for t in texts]))
    kind = docs.schema["d"].dataType

    def run(batches):
        quotes = broadcast.value
        for batch in batches:
            for first, buf, bounds, raw in _slices(batch):
                hits = quotes.inside(buf, bounds, raw)
                if hits:
                    rows = pa.array([first + d for d, _ in hits])
                    yield pa.RecordBatch.from_arrays([pa.array([quotes.texts[i].decode() for _, i in hits]), batch.column(0).take(rows)], ["text", "d"])

    return docs.mapInArrow(run, T.StructType([T.StructField("text", T.StringType()), T.StructField("d", kind)]))


def _sampled_keys(df: DataFrame, key: str) -> DataFrame:
    """key, k: sampled window keys of each row's text (key, text), every key of a text once."""

    def run(batches):
        for batch in batches:
            for first, buf, bounds, _ in _slices(batch):
                rows, found = [], []
                for d in range(len(bounds) - 1):
                    keys = window_keys(buf[bounds[d] : bounds[d + 1]], KEY)
                    mine = np.unique(keys[_sampled(keys, SPREAD)])
                    rows.append(np.full(len(mine), first + d))
                    found.append(mine)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(found).view(np.int64))], [key, "k"])

    schema = T.StructType([df.schema[key], T.StructField("k", T.LongType())])
    return df.select(key, "text").mapInArrow(run, schema)


def _by_join(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """(text, d) of texts of KEY + SPREAD - 1 bytes at least: each has a sampled window that is
    sampled in every document that contains it, too. Of a text one key is looked up; a key's
    texts and documents are compared, not shuffled with it until then."""
    keyed = _sampled_keys(texts.withColumn("q", F.col("text")), "q").groupBy("q").agg(F.min("k").alias("k"))
    places = _sampled_keys(docs, "d")
    hits = places.join(keyed, "k").select("q", "d").distinct()
    return hits.join(docs, "d").where(F.contains("text", F.col("q"))).select(F.col("q").alias("text"), "d")


def contained_quotes(quotes: DataFrame, documents: DataFrame, quote_id: str, doc_id: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """quote_id, doc_id where the document's text contains the quote's text, byte for byte.

    Distinct texts of up to `most` bytes in all are sent to every task, which looks for a window
    of each in its documents and compares: one scan, no shuffle of documents or keys. Of more
    texts, the longer ones meet the documents by sampled windows in an equi-join, and the others
    (of 30 bytes at most) are scanned for in blocks of that size. Null texts match nothing, an
    empty quote is in every text; equal quotes are looked up once; rows that repeat an id are
    rows."""
    q = quotes.select(F.col(quote_id).alias("q"), F.col("text").cast("string").alias("text")).where("text is not null")
    docs = documents.select(F.col(doc_id).alias("d"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = F.octet_length("text")
    long = size >= KEY + SPREAD - 1
    distinct = q.select("text").distinct()
    total, short = distinct.agg(F.sum(size), F.sum(F.when(~long, size + 1))).first()
    parts = []
    if (total or 0) <= most:
        parts.append(_by_broadcast([r["text"] for r in distinct.collect()], docs))
    else:
        parts.append(_by_join(distinct.where(long), docs))
        blocks = -(-(short or 0) // most)
        for b in range(blocks):
            block = distinct.where(~long & (F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)).collect()
            parts.append(_by_broadcast([r["text"] for r in block], docs))
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    return q.join(found, "text").select(F.col("q").alias(quote_id), F.col("d").alias(doc_id))
