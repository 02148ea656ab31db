"""Substring dedup: prefix-partitioned suffix trees over the words of all texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import anchored, scan
from quillmark.llm.storage import discard, written

WINDOW, PREFIX = 50, 16
TREE_BYTES = 32 << 20


def _find(window: int, k: int):
    """Arrow function: texts to their anchors."""

    def run(batches):
        for batch, buf, bounds in scan.pieces(batches, "text"):
            start, end, first = scan.words(buf, bounds, scan.NOT_SPACE)
            hashes = scan.span_hashes(buf, start, end)
            key, j, a, b = anchored.anchors(lambda lo, hi, h=hashes: scan.row_hashes(h[lo : hi + k - 1], k), first, window, k)
            text = np.searchsorted(first, j, side="right") - 1
            doc, mark = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[text] for c in ("doc_id", "mark"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), doc, mark, anchored.place(j - first[text], a - first[text], b - first[text]))], ["key", "doc_id", "mark", "place"])

    return run


def _cut(window: int):
    """Blocks of a text: words joined by one space."""

    def cut(text: bytes, places: list) -> Iterator[tuple[int, int, bytes]]:
        words = text.split()  # of bytes: at 0x20 and 0x09-0x0D
        for x in places:
            j, hi, lo = anchored.unplace(x["place"])
            yield x["place"], x["key"], b" ".join(words[j - hi : j - lo + window])

    return cut


def _common(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _trees(window: int):
    """Arrow function: cells, those of a prefix one after the other, to the ranges of repeated
    windows of each block, from the deep internal nodes of the prefix's suffix tree."""

    def solve(group: list[tuple]) -> Iterator[tuple[bytes, list]]:
        ranges: list[list] = [[(lo, hi, low)] if copies > 1 else [] for _, lo, hi, _, copies, low in group]
        if len(group) > 1:
            words = [block.split(b" ") for _, _, _, block, _, _ in group]
            right = [w[g[2] :] for w, g in zip(words, group, strict=True)]
            order = sorted(range(len(group)), key=right.__getitem__)
            lcp = [0, *(_common(right[x], right[y]) for x, y in zip(order, order[1:], strict=False))]
            lefts = [words[x][: group[x][2]][::-1] for x in order]
            found = anchored.repeats(lcp, lefts, [group[x][4] for x in order], [group[x][5] for x in order], window, _common)
            for x, more in zip(order, found, strict=True):
                ranges[x] += more
        for g, r in zip(group, ranges, strict=True):
            if r:
                yield g[0], r

    def run(batches):
        key, group, out = None, [], []
        for batch in batches:
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "block_id", "lo", "hi", "block", "copies", "low_id"))
            for now, *row in zip(*columns, strict=True):
                if now != key:
                    out += solve(group)
                    key, group = now, []
                group.append(tuple(row))
            if len(out) > 10_000:
                yield anchored.result_rows(out)
                out = []
        out += solve(group)
        if out:
            yield anchored.result_rows(out)

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX, class_blocks: int = anchored.CLASS_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(texts, spans of words covered by windows that a document with a smaller id has too)."""
    if not 0 < prefix <= window:
        raise ValueError("a prefix has at least one word and at most a window's")
    texts = anchored.texts_of(docs, id_col, text_col)
    chosen, found = anchored.candidates(texts, _find(window, prefix))
    members = written(chosen.mapInArrow(anchored.members(_cut(window)), anchored.MEMBER))
    discard(found)
    split = anchored.halves(None, lambda block, i, j: b" ".join(block.split(b" ")[i:j]), window)
    cells, parts = anchored.classes(anchored.cells_of(members), split, window - prefix, class_blocks)
    n = anchored.tasks_for(cells, TREE_BYTES)
    results = written(cells.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_trees(window), anchored.RESULT))
    return texts, anchored.spans(members, parts, results, window, strict=True)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX, class_blocks: int = anchored.CLASS_BLOCKS) -> DataFrame:
    """Removes every word covered by a window of `window` words whose word sequence also starts
    in a document with a smaller id; windows are judged on the input.

    Suffixes are sampled at anchors (see `anchored`) and partitioned by their first `prefix`
    words; a prefix with more than class_blocks distinct blocks is lengthened, window range by
    window range, until its suffixes fit in memory or are all equal. Each prefix has a suffix
    tree; its internal nodes that are deep enough, with what agrees to the left of the anchors,
    are the maximal repeats.

    Returns a row per row of docs: doc_id, n_words, n_removed, spans (runs of removed words:
    first, end) and kept (the other words, joined by one space). Words are runs of bytes other
    than 0x20 and 0x09-0x0D. Null and empty texts have no words; a null id counts as larger
    than any other; rows that repeat an id are one document for "smaller" and each keep their
    own row; an empty table gives no rows; other columns are ignored.
    """
    texts, spans = repeated_spans(docs, id_col, text_col, window, prefix, class_blocks)

    def run(batches):
        for batch in scan.slices(batches, "text"):
            ids, text, found = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "spans"))
            rows = []
            for t, s in zip(text, found.to_pylist(), strict=True):
                words = bytes(t.as_buffer()).split()
                if s is None:
                    rows.append((len(words), 0, [], b" ".join(words).decode()))
                    continue
                flag = anchored.flags(len(words), s)
                a, b = scan.runs(flag)
                keep = [w for w, f in zip(words, flag.tolist(), strict=True) if not f]
                rows.append((len(words), int(flag.sum()), [{"first": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)], b" ".join(keep).decode()))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)]], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    out = texts.join(spans, ["doc_id", "mark"], "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<first:bigint,end:bigint>>, kept string")
    return anchored.known_id(out)
