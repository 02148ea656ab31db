"""Benchmark decontamination: broadcast n-gram sets of the benchmark, scanned over all texts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import scan
from quillmark.llm.storage import discard, written

WINDOW = 10
#: Bytes of window text in one broadcast set; a larger benchmark is scanned in several blocks.
BLOCK_BYTES = 32 << 20
_SLOTS = 1 << 22


def item_words(text: str | None) -> list[bytes]:
    """Normalised words: A-Z lower-cased, runs of ASCII letters, digits and non-ASCII."""
    buf = scan.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    start, end, _ = scan.words(buf, np.array([0, len(buf)]), scan.ALNUM)
    raw = buf.tobytes()
    return [raw[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]


class WindowSet:
    """Windows of some items: text of the window -> items, and their hashes by length."""

    def __init__(self) -> None:
        self.items: dict[bytes, set] = defaultdict(set)
        self.bytes = 0

    def add(self, item: str, words: list[bytes], size: int) -> None:
        n = min(size, len(words))
        for i in range(len(words) - n + 1) if n else ():
            window = b" ".join(words[i : i + n])
            self.bytes += 0 if window in self.items else len(window)
            self.items[window].add(item)

    def freeze(self) -> dict:
        """(length -> sorted hashes, window -> items), ready for broadcasting."""
        by_size: dict[int, list[int]] = defaultdict(list)
        for window in self.items:
            parts = window.split(b" ")
            buf = np.frombuffer(b" ".join(parts), np.uint8)
            start, end, _ = scan.words(buf, np.array([0, len(buf)]), scan.ALNUM)
            by_size[len(parts)].append(int(scan.row_hashes(scan.span_hashes(buf, start, end), len(parts))[0]))
        return {"hashes": {n: np.unique(np.array(h, np.uint64)) for n, h in by_size.items()}, "items": {w: tuple(sorted(x)) for w, x in self.items.items()}}


def blocks(benchmark: DataFrame, item_col: str, text_col: str, size: int, block_bytes: int) -> Iterator[dict]:
    """Window sets of at most about block_bytes each, read row by row from the benchmark."""
    now = WindowSet()
    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        if item is not None:
            now.add(item, item_words(text), size)
        if now.bytes >= block_bytes:
            yield now.freeze()
            now = WindowSet()
    yield now.freeze()


def _hits(windows: dict, slots: dict, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, raw: bytes) -> Iterator[tuple[int, int, tuple]]:
    """(word, number of words, items) of the verified windows of a buffer."""
    for n, known in windows["hashes"].items():
        seen = scan.row_hashes(hashes, n)
        maybe = np.flatnonzero(slots[n][(seen & np.uint64(_SLOTS - 1)).astype(np.int64)])
        maybe = maybe[known[np.minimum(np.searchsorted(known, seen[maybe]), len(known) - 1)] == seen[maybe]]
        # windows lie in one text
        text = np.searchsorted(first, maybe, side="right")
        maybe = maybe[maybe + n <= first[np.minimum(text, len(first) - 1)]]
        for w in maybe.tolist():
            found = windows["items"].get(b" ".join([raw[s:e] for s, e in zip(start[w : w + n].tolist(), end[w : w + n].tolist(), strict=True)]))
            if found:
                yield w, n, found


def _scan(windows_of):
    """An Arrow function that adds a block's hits to the columns _items and _spans (byte
    ranges of hit words) and sets _words."""

    def run(batches):
        windows = windows_of.value
        slots = {}
        for n, known in windows["hashes"].items():
            slots[n] = np.zeros(_SLOTS, bool)
            slots[n][(known & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
        for batch, buf, bounds in scan.pieces(batches, "text"):
            low = scan.LOWER[buf]
            start, end, first = scan.words(low, bounds, scan.ALNUM)
            hashes, raw = scan.span_hashes(low, start, end), low.tobytes()
            items, hit = defaultdict(set), np.zeros(len(start) + 1, np.int64)
            for w, n, found in _hits(windows, slots, hashes, start, end, first, raw):
                items[int(np.searchsorted(first, w, side="right")) - 1].update(found)
                hit[w] += 1
                hit[w + n] -= 1
            hit = np.cumsum(hit[:-1]) > 0
            old_items, old_spans = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_items", "_spans"))
            new_items, new_spans = [], []
            for k in range(batch.num_rows):
                new_items.append(sorted({*old_items[k], *items.get(k, ())}))
                spans = old_spans[k]
                if k in items:
                    a, b = first[k], first[k + 1]
                    flags = hit[a:b]
                    for span in spans:  # of earlier blocks: words inside are hit as well
                        flags |= (start[a:b] - bounds[k] >= span["start"]) & (end[a:b] - bounds[k] <= span["end"])
                    s, e = scan.runs(flags)
                    spans = [{"start": int(start[a + x] - bounds[k]), "end": int(end[a + y - 1] - bounds[k]), "words": int(y - x)} for x, y in zip(s, e, strict=True)]
                new_spans.append(spans)
            n_words = np.diff(first)
            arrays = {"_items": pa.array(new_items, pa.list_(pa.string())), "_spans": pa.array(new_spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))), "_words": pa.array(n_words, pa.int64())}
            yield pa.RecordBatch.from_arrays([arrays.get(f.name, batch.column(i)) for i, f in enumerate(batch.schema)], [f.name for f in batch.schema])

    return run


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES, with_text: bool = False
) -> DataFrame:
    """Occurrences of benchmark windows in docs: one row per row of docs.

    A window is `size` consecutive normalised words of an item, or all its words if it has
    fewer. The windows are broadcast as a hash set of at most about block_bytes of window text;
    a benchmark beyond that is scanned in one job a block, each over what the one before wrote,
    so that no more than one block is in memory anywhere. Nothing is shuffled. Hashes only
    propose: a hit's words are compared.

    Returns doc_id, n_words, items (ids as strings, sorted), spans (byte ranges of runs of hit
    words in the UTF-8 text, and their words), and the text if with_text. Null or empty texts
    have no words and no hits; items without words or id match nothing; items that repeat an
    id are one item; rows of docs are judged one by one, so repeated or null ids stay; other
    columns are ignored.
    """
    spark = docs.sparkSession
    kinds = {"_items": "array<string>", "_spans": "array<struct<start:bigint,end:bigint,words:bigint>>"}
    out = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.array().cast(k).alias(c) for c, k in kinds.items()], F.lit(0).cast("bigint").alias("_words")
    )
    before, shared = None, None
    for block in blocks(benchmark, item_col, item_text_col, size, block_bytes):
        if shared is not None:  # one block at a time is in memory: the scan of the last one ends first
            done = written(out)
            shared.unpersist()
            if before is not None:
                discard(before)
            out = before = done
        shared = spark.sparkContext.broadcast(block)
        out = out.mapInArrow(_scan(shared), out.schema)
    return out.select("doc_id", F.col("_words").alias("n_words"), F.col("_items").alias("items"), F.col("_spans").alias("spans"), *["text"] * with_text)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False, **options) -> DataFrame:
    """docs without benchmark passages: the spans are cut out of the text or, with whole=True,
    contaminated rows are dropped. Columns stay; ids tell nothing apart here, so repeated and
    null ids are safe. Clean rows are returned as they are, null texts too."""
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc_id"), F.col(text_col).alias("text"))
    found = find_contamination(packed, benchmark, "doc_id", "text", with_text=True, **options)
    if whole:
        return found.where(F.size("spans") == 0).select("doc_id.*")
    raw = F.encode("text", "UTF-8")
    # what lies between the spans: from the end of one to the start of the next
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.col("spans.end"))
    ends = F.concat(F.col("spans.start"), F.array(F.octet_length("text").cast("bigint")))
    kept = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: F.decode(F.substring(raw, (x["s"] + 1).cast("int"), (x["e"] - x["s"]).cast("int")), "UTF-8"))
    clean = F.when(F.size("spans") == 0, F.col("doc_id")[text_col]).otherwise(F.array_join(kept, ""))
    return found.select(*[clean.alias(c) if c == text_col else F.col("doc_id")[c].alias(c) for c in docs.columns])
