"""Suffix-array dedup: a distributed merge sort that never re-compares known prefixes."""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import anchored, scan
from quillmark.llm.storage import discard, written

WINDOW, CORE = 400, 128
RUN_BYTES, MERGE_BYTES = 48 << 20, 24 << 20
#: Splitters are chosen from at most about so many sampled prefixes.
SAMPLE = 8192
_HEAD = struct.Struct("<HHHHHqq16s")


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are known to agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, hi = known, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Run:
    """A sorted run read front-coded: each suffix comes with its common prefix with the one
    before it, and only what follows that prefix."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.key = data, 0, b""

    def next(self) -> tuple[int, bytes, tuple] | None:
        if self.at >= len(self.data):
            return None
        lcp, tail, left, lo, hi, copies, low, name = _HEAD.unpack_from(self.data, self.at)
        at = self.at + _HEAD.size
        self.key = self.key[:lcp] + self.data[at : at + tail]
        before = self.data[at + tail : at + tail + left]
        self.at = at + tail + left
        return lcp, self.key, (name, lo, hi, before, copies, low)


def front_code(rows: list[tuple[bytes, tuple]]) -> bytes:
    """Sorted (suffix, (name, lo, hi, reversed left side, copies, low)) rows as one run."""
    out, last = [], b""
    for key, (name, lo, hi, before, copies, low) in rows:
        lcp = common_prefix(last, key)
        out += (_HEAD.pack(lcp, len(key) - lcp, len(before), lo, hi, copies, low, name), key[lcp:], before)
        last = key
    return b"".join(out)


def merge(runs: list[bytes]) -> Iterator[tuple[int, bytes, tuple]]:
    """(common prefix with the row before, suffix, row) of all runs, in order.

    A loser tree: each inner node holds the stream that lost there and its common prefix with
    the winner that passed. A stream with the longer known prefix is the smaller one; only on
    equal known prefixes are bytes compared, from there on."""
    streams = [Run(r) for r in runs]
    size = 1
    while size < len(streams):
        size *= 2
    keys: list[bytes | None] = [None] * size
    rows: list = [None] * size
    known = [0] * size

    def pull(i: int) -> None:
        got = streams[i].next() if i < len(streams) else None
        known[i], keys[i], rows[i] = got if got else (0, None, None)

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes that with the winner."""
        a, b = keys[x], keys[y]
        if a is None or b is None:
            return (y, x) if a is None else (x, y)
        if known[x] != known[y]:
            return (x, y) if known[x] > known[y] else (y, x)
        n = common_prefix(a, b, known[x])
        if a[n:] <= b[n:]:
            known[y] = n
            return x, y
        known[x] = n
        return y, x

    for i in range(size):
        pull(i)
        known[i] = 0
    loser = [0] * size
    level = list(range(size))
    node = size
    while len(level) > 1:
        node //= 2
        after = []
        for i in range(0, len(level), 2):
            w, lost = play(level[i], level[i + 1])
            loser[node + i // 2] = lost
            after.append(w)
        level = after
    winner = level[0]
    while keys[winner] is not None:
        yield known[winner], keys[winner], rows[winner]
        pull(winner)
        node = (winner + size) // 2
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2


def _find(window: int, k: int):
    """Arrow function: texts to their anchors."""

    def run(batches):
        for batch, buf, bounds in scan.pieces(batches, "text"):
            key, j, a, b = anchored.anchors(lambda lo, hi, t=buf: scan.window_hashes(t[lo : hi + k - 1], k), bounds, window, k)
            text = np.searchsorted(bounds, j, side="right") - 1
            doc, mark = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[text] for c in ("doc_id", "mark"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), doc, mark, anchored.place(j - bounds[text], a - bounds[text], b - bounds[text]))], ["key", "doc_id", "mark", "place"])

    return run


def _cut(window: int):
    def cut(text: bytes, places: list) -> Iterator[tuple[int, int, bytes]]:
        for x in places:
            j, hi, lo = anchored.unplace(x["place"])
            yield x["place"], x["key"], text[j - hi : j - lo + window]

    return cut


def _sort(splitters: list[bytes], core: int):
    """Arrow function: cells to front-coded sorted runs, one for each range of suffixes."""

    def runs_of(rows: list[tuple[bytes, tuple]]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: r[0])
        first = [r[0][:core] for r in rows]
        edges = [0, *(bisect.bisect_left(first, s) for s in splitters), len(rows)]
        target = [t for t in range(len(edges) - 1) if edges[t] < edges[t + 1]]
        yield pa.RecordBatch.from_arrays([pa.array(target, pa.int32()), pa.array([front_code(rows[edges[t] : edges[t + 1]]) for t in target], pa.binary())], ["target", "run"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("block_id", "lo", "hi", "block", "copies", "low_id"))
            for name, lo, hi, block, copies, low in zip(*columns, strict=True):
                rows.append((block[hi:], (name, lo, hi, block[:hi][::-1], copies, low)))
                size += len(block) + 200
            if size > RUN_BYTES:
                yield from runs_of(rows)
                rows, size = [], 0
        if rows:
            yield from runs_of(rows)

    return run


def _merge(window: int, core: int):
    """Arrow function: runs, those of a range one after the other, to the ranges of repeated
    windows of each block. Suffixes that share less than a core are of different classes."""

    def solve(lcp: list[int], rows: list[tuple]) -> Iterator[tuple[bytes, list]]:
        # the smallest id doesn't matter here: any second place makes a window repeated
        found = anchored.repeats(lcp, [r[3] for r in rows], [r[4] for r in rows], [0] * len(rows), window, common_prefix) if len(rows) > 1 else [[]]
        for (name, lo, hi, _, copies, _), ranges in zip(rows, found, strict=True):
            if copies > 1:
                yield name, [(lo, hi, 0)]
            elif ranges:
                yield name, ranges

    def merged(runs: list[bytes]) -> Iterator[tuple[bytes, list]]:
        lcp: list[int] = []
        rows: list[tuple] = []
        for n, _, row in merge(runs):
            if n < core:
                if rows:
                    yield from solve(lcp, rows)
                lcp, rows = [], []
            lcp.append(n)
            rows.append(row)
        if rows:
            yield from solve(lcp, rows)

    def run(batches):
        target, runs, out = None, [], []
        for batch in batches:
            for now, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != target:
                    out += merged(runs)
                    target, runs = now, []
                runs.append(data)
                if len(out) > 10_000:
                    yield anchored.result_rows(out)
                    out = []
        out += merged(runs)
        if out:
            yield anchored.result_rows(out)

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, core: int = CORE, class_blocks: int = anchored.CLASS_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(texts, spans of bytes covered by windows that start anywhere else too)."""
    if not 0 < core <= window <= 4095:
        raise ValueError("a core has at least one byte and at most a window's, which has at most 4095")
    texts = anchored.texts_of(docs, id_col, text_col)
    chosen, found = anchored.candidates(texts, _find(window, core))
    members = written(chosen.mapInArrow(anchored.members(_cut(window)), anchored.MEMBER))
    discard(found)
    cells, parts = anchored.classes(anchored.cells_of(members), anchored.halves(None, lambda block, i, j: block[i:j], window), window - core, class_blocks)
    n = anchored.tasks_for(cells, MERGE_BYTES)
    count = cells.count()
    prefix = F.expr(f"substring(block, hi + 1, {core})").alias("prefix")
    sample = sorted(bytes(r[0]) for r in cells.sample(min(1.0, SAMPLE / max(1, count)), seed=1).select(prefix).collect()) if n > 1 else []
    splitters = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []
    runs = cells.mapInArrow(_sort(splitters, core), "target int, run binary").repartition(len(splitters) + 1, "target").sortWithinPartitions("target")
    results = written(runs.mapInArrow(_merge(window, core), anchored.RESULT))
    return texts, anchored.spans(members, parts, results, window, strict=False)


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, core: int = CORE, class_blocks: int = anchored.CLASS_BLOCKS) -> DataFrame:
    """Removes every byte covered by a string of `window` bytes that also starts anywhere else,
    the same text included; overlaps count, strings are judged on the input.

    The suffix array is sparse: suffixes are sampled at anchors (see `anchored`), to the depth
    of a window. Tasks sort theirs and write front-coded runs, one for each range of suffixes;
    a range's runs are merged by a loser tree that carries known common prefixes, which gives
    the suffixes in order with their common prefixes. What agrees to the left of the anchors
    then decides for each window. A class of more than class_blocks distinct blocks is split
    by a longer core before it is sorted.

    Returns a row per row of docs: doc_id, n_bytes, n_removed, spans (maximal runs of removed
    bytes: first, end) and kept (the other bytes; a cut may fall inside a character). Null
    counts as empty; a null id stays null; rows that repeat an id are places of their own; an
    empty table gives no rows; other columns are ignored.
    """
    texts, spans = repeated_spans(docs, id_col, text_col, window, core, class_blocks)

    def run(batches):
        for batch in scan.slices(batches, "text"):
            ids, text, found = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "spans"))
            rows = []
            for t, s in zip(text, found.to_pylist(), strict=True):
                raw = bytes(t.as_buffer())
                if s is None:
                    rows.append((len(raw), 0, [], raw))
                    continue
                flag = anchored.flags(len(raw), s)
                a, b = scan.runs(flag)
                rows.append((len(raw), int(flag.sum()), [{"first": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.frombuffer(raw, np.uint8)[~flag].tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    out = texts.join(spans, ["doc_id", "mark"], "left").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<first:bigint,end:bigint>>, kept binary")
    return anchored.known_id(out)
