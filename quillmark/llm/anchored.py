"""Repeated windows by sampled suffixes: what substring and suffix-array dedup share.

A window is W consecutive symbols (bytes or words) of one text. Its anchor is the position of
its least k-symbol hash (leftmost of equals), so equal windows have their anchors at equal
offsets, and a text needs one suffix per anchor instead of one per position. All windows of an
anchor lie in its block; l is how far a window starts before the anchor. Two blocks share the
window l exactly if l symbols before the anchors agree and W - l after them do.

The steps here: anchors of all texts; those whose k-symbol hash occurs again; their blocks,
distinct ones only; classes of blocks with a common core, where a class too large for memory
gets a longer core (half the windows each) until it isn't. How the blocks of a class are
brought in order is the operators' own; `repeats` then turns an ordered class into ranges of l.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import scan
from quillmark.llm.storage import written

#: Most distinct blocks of a class that one task orders at a time.
CLASS_BLOCKS = 2048
_MASK = np.uint64((1 << 21) - 1)
CELL = "key long, block_id binary, lo int, hi int, block binary, copies long, low_id long"


def anchors(hashes: Callable[[int, int], np.ndarray], bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(hash, position, first window, last window) of each anchor of some texts.

    hashes(lo, hi): k-symbol hashes at the positions lo..hi-1; bounds: of texts, in symbols."""
    n, out = int(bounds[-1]), []
    long = np.diff(bounds) >= window
    if not long.any():
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    valid = scan.cover(bounds[:-1][long], bounds[1:][long] - window + 1, n)
    for at in range(0, n - window + 1, scan.SEGMENT):
        to = min(at + scan.SEGMENT, n - window + 1)
        inside = valid[at:to]
        if not inside.any():
            continue
        h = hashes(at, to + window - k)
        low = scan.sliding_min((h & ~_MASK) | np.arange(len(h), dtype=np.uint64), window - k + 1)
        p = np.flatnonzero(inside)
        j = (low[p] & _MASK).astype(np.int64)
        new = np.ones(len(p), bool)
        new[1:] = (j[1:] != j[:-1]) | (p[1:] != p[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(p)) - 1
        out.append((h[j[first]], j[first] + at, p[first] + at, p[last] + at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else anchors(hashes, np.zeros(1, np.int64), window, k)


def place(position: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Position and the range of l in one long."""
    return (position << 24) | ((position - first) << 12) | (position - last)


def unplace(x: int) -> tuple[int, int, int]:
    """(position, largest l, smallest l)."""
    return x >> 24, (x >> 12) & 0xFFF, x & 0xFFF


def block_id(core_key: int, lo: int, hi: int, block: bytes) -> bytes:
    return hashlib.blake2b(block, digest_size=16, key=f"{core_key} {lo} {hi}".encode()).digest()


NO_ID = (1 << 63) - 1


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (tells rows with one id and different texts apart), text. Null ids become
    the largest long, null texts empty."""
    out = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return out.select("doc_id", F.xxhash64("text").alias("mark"), "text")


def known_id(df: DataFrame) -> DataFrame:
    """df with null for the ids that were unknown."""
    return df.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def candidates(texts: DataFrame, find) -> tuple[DataFrame, DataFrame]:
    """texts (doc_id, mark, text) with places: the anchors whose hash occurs again anywhere;
    and the written table of all anchors behind it.

    find: an Arrow function from texts to (key, doc_id, mark, place)."""
    found = written(texts.mapInArrow(find, "key long, doc_id long, mark long, place long"))
    # a table of its own, so that the join below can split a hot key's rows among tasks
    again = written(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    places = found.join(again, "key").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("place", "key")).alias("places"))
    return texts.join(places, ["doc_id", "mark"]), found


MEMBER = "doc_id long, mark long, place long, key long, block_id binary, lo int, hi int, block binary"


def member_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
    names = ["doc_id", "mark", "place", "key", "block_id", "lo", "hi", "block"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def members(cut):
    """An Arrow function from candidates to MEMBER rows; a batch's later copies of a block have
    null for it. cut(text, places): yields (place, key, block)."""

    def run(batches):
        for batch in scan.slices(batches, "text"):
            ids, marks, texts, places = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "mark", "text", "places"))
            rows, seen, size = [], set(), 0
            for doc, mark, text, own in zip(ids.to_pylist(), marks.to_pylist(), texts, places.to_pylist(), strict=True):
                for at, key, block in cut(bytes(text.as_buffer()), own):
                    _, hi, lo = unplace(at)
                    name = block_id(key, lo, hi, block)
                    rows.append((doc, mark, at, key, name, lo, hi, None if name in seen else block))
                    size += 0 if name in seen else len(block)
                    seen.add(name)
                if size > 1 << 23 or len(rows) > 1 << 16:
                    yield member_rows(rows)
                    rows, seen, size = [], set(), 0
            if rows:
                yield member_rows(rows)

    return run


def cells_of(found: DataFrame) -> DataFrame:
    return found.select("key", "block_id", "lo", "hi", "block", F.lit(1).cast("long").alias("copies"), F.col("doc_id").alias("low_id"))


RESULT = "block_id binary, ranges array<struct<a:int,b:int,low:bigint>>"
_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("low", pa.int64())]))


def result_rows(rows: list[tuple]) -> pa.RecordBatch:
    ranges = [[{"a": a, "b": b, "low": low} for a, b, low in r] for _, r in rows]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.binary()), pa.array(ranges, _RANGES)], ["block_id", "ranges"])


def tasks_for(cells: DataFrame, task_bytes: int) -> int:
    """Tasks that get about task_bytes of blocks each."""
    total = cells.agg(F.sum(F.octet_length("block").cast("long") + 64)).first()[0] or 0
    return max(1, -(-total // task_bytes))


def classes(cells: DataFrame, split, spread: int, most: int = CLASS_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(cells in classes of at most `most` distinct blocks, parts of the blocks that were split).

    cells: CELL rows, not yet distinct; a null block says that the block is in another row.
    split(width): an Arrow function from cells to those of the ranges of l of that width.
    spread: largest l there can be.
    parts: root (block_id before any split), offset of l, block_id of the part."""

    def distinct(x: DataFrame) -> DataFrame:
        return x.groupBy("key", "block_id", "lo", "hi").agg(F.max("block").alias("block"), F.sum("copies").alias("copies"), F.min("low_id").alias("low_id"))

    now, done, parts = written(distinct(cells)), [], []
    width = 1 << spread.bit_length()
    while True:
        size = now.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        large = size.where(F.col("n") > most).select("key")
        if large.isEmpty():
            done.append(now)
            break
        large = written(large)
        done.append(now.join(large, "key", "left_anti"))
        width //= 2
        halves = written(now.join(large, "key").mapInArrow(split(width), f"{CELL}, root binary, offset int"))
        parts.append(halves.select("root", "offset", "block_id"))
        now = written(distinct(halves))
    return _union(done), _roots(parts)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.union(x)
    return out


def _roots(levels: list[DataFrame]) -> DataFrame | None:
    """Parts of all levels with the roots of the first one. Ancestors split again have no
    result of their own, so their rows find none."""
    if not levels:
        return None
    out, last = [levels[0]], levels[0]
    for level in levels[1:]:
        up = last.select(F.col("block_id").alias("root"), F.col("root").alias("top"), F.col("offset").alias("before"))
        last = level.distinct().join(up, "root").select(F.col("top").alias("root"), (F.col("offset") + F.col("before")).alias("offset"), "block_id")
        out.append(last)
    return _union(out)


def halves(size_of, cut, window: int):
    """split() for `classes`. size_of(block): symbols; cut(block, i, j): its symbols i..j-1.

    A part has the windows l in [offset, offset + width) for offsets that are multiples of
    width; its virtual anchor lies `offset` before the block's, and its core is what all
    windows of that range have in common."""

    def of(width: int):
        def run(batches):
            for batch in batches:
                rows = []
                for x in batch.to_pylist():
                    lo, hi = x["lo"], x["hi"]
                    for offset in range(lo // width * width, hi + 1, width):
                        a, b = max(lo, offset), min(hi, offset + width - 1)
                        part = cut(x["block"], hi - b, hi - a + window)
                        core = cut(part, b - offset, b - offset + window - width + 1)
                        key = int.from_bytes(hashlib.blake2b(core, digest_size=8, key=f"{width} {x['key']} {offset}".encode()).digest(), "big", signed=True)
                        rows.append((key, block_id(key, a - offset, b - offset, part), a - offset, b - offset, part, x["copies"], x["low_id"], x["block_id"], offset))
                kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
                names = ["key", "block_id", "lo", "hi", "block", "copies", "low_id", "root", "offset"]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        return run

    return of


def nodes(lcp: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Internal nodes (depth, parent's depth, first leaf, last leaf) of the tree of sorted
    suffixes; lcp[i] is the common prefix of the leaves i - 1 and i, lcp[0] is unused."""
    stack: list[tuple[int, int]] = []  # depth, first leaf
    for i in range(1, len(lcp) + 1):
        depth, left = (lcp[i] if i < len(lcp) else 0), i - 1
        while stack and stack[-1][0] > depth:
            d, left = stack.pop()
            yield d, max(depth, stack[-1][0] if stack else 0), left, i - 1
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))


def repeats(lcp: list[int], lefts: list, copies: list[int], low: list[int], window: int, common) -> list[list[tuple[int, int, int]]]:
    """For each ordered block of a class: ranges (from l, to l, smallest id) of windows that
    occur more than once, from the nodes of the tree deep enough for a window.

    lefts: what lies before each anchor, reversed; common(a, b): their common prefix. Own
    copies aren't looked at; `copies` and `low` of others count for the smallest id."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in lcp]
    for depth, above, i, j in nodes(lcp):
        least, most = max(0, window - depth), window - above - 1
        if j == i + 1:
            near = common(lefts[i], lefts[j])
            to = min(most, near)
            if to >= least:
                m = min(low[i], low[j])
                out[i].append((least, to, m))
                out[j].append((least, to, m))
            continue
        order = sorted(range(i, j + 1), key=lefts.__getitem__)
        near = [-1, *(common(lefts[a], lefts[b]) for a, b in zip(order, order[1:])), -1]
        ids = {low[x] for x in order}
        if len(ids) == 1:
            m = ids.pop()
            for at, x in enumerate(order):
                to = min(most, max(near[at], near[at + 1]))
                if to >= least:
                    out[x].append((least, to, m))
            continue
        # ranges of l between the depths at which the groups of equal left sides change
        marks = sorted({d for d in near if least <= d < most} | {min(most, max(near))})
        start = least
        for to in marks:
            if to < start:
                continue
            at = 0
            while at < len(order):
                end = at
                while near[end + 1] >= to and end + 1 < len(order):
                    end += 1
                if end > at:
                    m = min(low[x] for x in order[at : end + 1])
                    for x in order[at : end + 1]:
                        out[x].append((start, to, m))
                at = end + 1
            start = to + 1
    return out


def spans(members: DataFrame, parts: DataFrame | None, results: DataFrame, window: int, strict: bool) -> DataFrame:
    """doc_id, mark, spans: runs of symbols that repeated windows cover, gathered per text.

    members: (doc_id, mark, place, block_id); results: (block_id, ranges: array of (from l, to l,
    smallest id)). strict: only windows that an id smaller than doc_id has."""
    if parts is not None:
        split = parts.join(results, "block_id").select(
            F.col("root").alias("block_id"), F.transform("ranges", lambda r: F.struct((r["a"] + F.col("offset")).alias("a"), (r["b"] + F.col("offset")).alias("b"), r["low"].alias("low"))).alias("ranges")
        )
        results = results.unionByName(split)
    hits = members.join(results, "block_id")
    if strict:
        hits = hits.withColumn("ranges", F.filter("ranges", lambda r: r["low"] < F.col("doc_id"))).where(F.size("ranges") > 0)
    position = F.shiftright("place", 24)
    covered = F.transform("ranges", lambda r: F.struct((position - r["b"]).alias("s"), (position - r["a"] + window).alias("e")))
    # the blocks of an anchor overlap, so its ranges are joined before they travel
    return hits.select("doc_id", "mark", covered.alias("spans")).groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def flags(size: int, found) -> np.ndarray:
    """Covered symbols of a text; found: its spans or None."""
    out = np.zeros(size + 1, np.int64)
    for x in found or ():
        out[x["s"]] += 1
        out[x["e"]] -= 1
    return np.cumsum(out[:-1]) > 0
