"""Packing: vector bin packing of token sequences by the dot-product heuristic."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import scan

MAX_TOKENS, MAX_SEGMENTS, POOL, CACHE = 2048, 64, 256, 1_800_000

_MODELS: dict = {}
_PLAIN = re.compile(rb" ?(?:[!-~]|[\xc3-\xc9][\x80-\xbf])+")

# Bytes after which a text may be cut before a space: a printable ASCII character, or the first
# byte of a character range without white space.
_SAFE = np.zeros(256, bool)
_SAFE[0x21:0x7F] = True
_SAFE[0xC3:0xE0] = True
_SAFE[0xE4:0xEE] = True
_SAFE[0xF0:0xF5] = True
_PRINT = np.zeros(256, bool)
_PRINT[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True


class ChunkTokenizer:
    """Ids of a byte-level BPE whose pre-tokens keep a leading space with the next word.

    Texts are cut only where the pre-tokenizer must end a token too (before a space that a
    visible character follows, around a single line feed, between a letter and a stop), so the
    chunks' ids, one after the other, are the text's ids. Encoded chunks are kept in a
    bounded table, found by 64-bit hash, length, first and last byte.
    """

    def __init__(self, path: str, cache: int = CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.one = getattr(self.model, "encode_batch_fast", self.model.encode_batch)
        self.line = self._ids(["\n"])[0]
        self.cache, self.mask = cache, (1 << (2 * cache).bit_length()) - 1
        self._forget()

    @classmethod
    def of(cls, path: str) -> ChunkTokenizer:
        """One for each path and Python worker, so that a worker's later tasks find its table."""
        if path not in _MODELS:
            _MODELS[path] = cls(path)
        return _MODELS[path]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.one(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.hash, self.sign, self.row = (np.zeros(self.mask + 1, t) for t in (np.uint64, np.uint32, np.int32))
        self.pool, self.used, self.rows = np.empty(1 << 20, np.uint32), 0, 0
        self.begin, self.length = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64)

    def _learn(self, chunks: list[bytes]) -> np.ndarray:
        """Rows of new chunks. Plain words are encoded many at a time, a line feed between two,
        which the pre-tokenizer keeps apart from both; other chunks one by one."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        got: list = [None] * len(texts)
        plain = [i for i, c in enumerate(chunks) if _PLAIN.fullmatch(c)]
        for at in range(0, len(plain), 512):
            some = plain[at : at + 512]
            ids = np.array(self._ids(["\n".join(texts[i] for i in some)])[0], np.uint32)
            ends = np.flatnonzero(ids == self.line[0])
            if len(self.line) == 1 and len(ends) == len(some) - 1:
                for i, part in zip(some, np.split(ids, ends), strict=True):
                    got[i] = part[1:] if i != some[0] else part
        odd = [i for i, x in enumerate(got) if x is None]
        for i, ids in zip(odd, self._ids([texts[i] for i in odd]), strict=True):
            got[i] = np.array(ids, np.uint32)
        n, length = self.rows, np.fromiter(map(len, got), np.int64, len(got))
        while n + len(got) > len(self.begin):
            self.begin, self.length = (np.concatenate((x, np.empty_like(x))) for x in (self.begin, self.length))
        while self.used + length.sum() > len(self.pool):
            self.pool = np.concatenate((self.pool, np.empty_like(self.pool)))
        self.begin[n : n + len(got)] = self.used + np.cumsum(length) - length
        self.length[n : n + len(got)] = length
        self.pool[self.used : self.used + length.sum()] = np.concatenate(got)
        self.used, self.rows = self.used + int(length.sum()), n + len(got)
        return np.arange(n, self.rows)

    @staticmethod
    def cuts(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Starts of the chunks of all texts."""
        flag = np.zeros(len(buf) + 1, bool)
        if len(buf) > 1:
            here, after, before = buf[1:-1], buf[2:], buf[:-2]
            flag[1 : len(buf) - 1] = ((here == 0x20) & _SAFE[after]) | ((here == 0x0A) & _PRINT[before]) | (_STOP[here] & _LETTER[before])
            line = (here == 0x0A) & _PRINT[before] & _SAFE[after]
            flag[2 : len(buf)] |= line
        flag[bounds] = True
        return np.flatnonzero(flag[: len(buf)])

    def encode(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the texts' bounds in them."""
        if not len(buf):
            return np.empty(0, np.uint32), np.zeros(len(bounds), np.int64)
        start = self.cuts(buf, bounds)
        end = np.append(start[1:], len(buf))
        key = scan.span_hashes(buf, start, end)
        sign = (buf[start].astype(np.uint32) << 24) | (buf[end - 1].astype(np.uint32) << 16) | ((end - start) & 0xFFFF).astype(np.uint32)
        if self.rows > self.cache:
            self._forget()
        slot = (key & np.uint64(self.mask)).astype(np.int64)
        rows = self.row[slot].astype(np.int64)
        new = np.flatnonzero((self.hash[slot] != key) | (self.sign[slot] != sign) | (self.rows == 0))
        if len(new):
            _, first, which = np.unique(key[new], return_index=True, return_inverse=True)
            at = new[first]
            raw = buf.tobytes()
            learnt = self._learn([raw[s:e] for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            rows[new] = learnt[which]
            self.hash[slot[at]], self.sign[slot[at]], self.row[slot[at]] = key[at], sign[at], learnt
        length = self.length[rows]
        ids = self.pool[scan.ragged(self.begin[rows], length)]
        total = np.concatenate(([0], np.cumsum(length)))
        return ids, total[np.searchsorted(start, bounds)]


class Packer:
    """Fills one sequence at a time from a bounded pool of examples.

    An example asks for (tokens, 1 segment, loss-bearing tokens); the next one taken is that
    with the largest dot product of its demand and the sequence's room, each as a share of the
    limit and weighted by the mean demand of the pool. Where examples may be cut, what no whole
    example fills is filled with the head of one.
    """

    def __init__(self, tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int | None = None, cut: bool = True, pool: int = POOL) -> None:
        self.limit = np.array([tokens, segments, tokens if loss is None else loss], np.int64)
        assert (self.limit > 0).all(), "limits are positive"
        self.cut, self.size = cut, pool
        self.items: list[tuple] = []  # key, start, ids, cumulated loss or None, ids of the whole example
        self.need = np.zeros((pool + 1, 3), np.int64)

    def _loss(self, item: tuple, n: int) -> int:
        return n if item[3] is None else int(item[3][n] - item[3][0])

    def _head(self, item: tuple, room: np.ndarray) -> int:
        """Most tokens of an example that fit."""
        n = min(len(item[2]), int(room[0]))
        return min(n, int(room[2])) if item[3] is None else min(n, int(np.searchsorted(item[3], item[3][0] + room[2], side="right")) - 1)

    @staticmethod
    def _split(item: tuple, n: int) -> tuple[tuple, tuple]:
        key, start, ids, loss, total = item
        return (key, start, ids[:n], None if loss is None else loss[: n + 1], total), (key, start + n, ids[n:], None if loss is None else loss[n:], total)

    def add(self, key, ids: np.ndarray, loss: np.ndarray | None = None) -> Iterator[list[tuple]]:
        """loss: flags of the loss-bearing ids; None: all. Gives the sequences that are full.
        What exceeds the limits alone is cut in any case."""
        item = (key, 0, ids, None if loss is None else np.concatenate(([0], np.cumsum(loss))), len(ids))
        while len(item[2]) and ((n := self._head(item, self.limit)) < len(item[2]) or n == self.limit[0]):
            part, item = self._split(item, max(1, n))
            yield [part]
        if len(item[2]):
            self._put(item)
        while len(self.items) >= self.size:
            yield self._fill()

    def _put(self, item: tuple) -> None:
        self.need[len(self.items)] = len(item[2]), 1, self._loss(item, len(item[2]))
        self.items.append(item)

    def _take(self, i: int) -> tuple:
        item, last = self.items[i], self.items.pop()
        if i < len(self.items):
            self.items[i] = last
            self.need[i] = self.need[len(self.items)]
        return item

    def _fill(self) -> list[tuple]:
        room, out = self.limit.copy(), []
        while self.items and room.min() > 0 or not out:
            need = self.need[: len(self.items)]
            share = need / self.limit
            score = share @ (share.mean(0) * room / self.limit)
            fits = (need <= room).all(1)
            if self.cut and room[1] == 1:  # the last segment is to fill what is left
                fits &= need[:, 0] == room[0]
            if fits.any():
                item = self._take(int(np.where(fits, score, -1.0).argmax()))
            elif self.cut:
                item = self._take(int(score.argmax()))
                n = self._head(item, room)
                if not n:
                    self._put(item)
                    break
                if n < len(item[2]):
                    item, rest = self._split(item, n)
                    self._put(rest)
            else:
                break
            out.append(item)
            room -= len(item[2]), 1, self._loss(item, len(item[2]))
        return out

    def finish(self) -> Iterator[list[tuple]]:
        """The rest. Where examples may be cut, a last sequence that isn't full is cut into
        sequences whose lengths are powers of two, which need no padding."""
        while self.items:
            yield from self._powers(self._fill())

    def _powers(self, parts: list[tuple]) -> Iterator[list[tuple]]:
        total = sum(len(x[2]) for x in parts)
        if not self.cut or total == self.limit[0]:
            yield parts
            return
        bit = 1 << total.bit_length()
        while total:
            while bit > total:
                bit >>= 1
            out, room = [], bit
            while room:
                item = parts.pop(0)
                if len(item[2]) > room:
                    item, rest = self._split(item, room)
                    parts.insert(0, rest)
                out.append(item)
                room -= len(item[2])
            total -= bit
            yield out


SCHEMA = "doc_id long, start long, length long, ids binary, loss_tokens long, doc_tokens long, sequence_id long, offset long"


class _Rows:
    """Pieces of packed sequences as Arrow batches."""

    def __init__(self) -> None:
        self.next = TaskContext.get().partitionId() << 32
        self.rows: list[tuple] = []
        self.bytes = 0

    def put(self, packer: Packer, parts: list[tuple]) -> None:
        at = 0
        for item in parts:
            key, start, ids, _, total = item
            raw = ids.astype("<u4").tobytes()
            self.rows.append((key, start, len(ids), raw, packer._loss(item, len(ids)), total, self.next, at))
            self.bytes += len(raw)
            at += len(ids)
        self.next += 1

    def flush(self, most: int = 0) -> Iterator[pa.RecordBatch]:
        if self.rows and self.bytes >= most:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            names = ["doc_id", "start", "length", "ids", "loss_tokens", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows, strict=True), kinds, strict=True)], names)
            self.rows, self.bytes = [], 0


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int | None = None, end_id: int | None = 1, pool: int = POOL
) -> DataFrame:
    """Packs all texts into sequences of at most `tokens` ids, `segments` pieces and `loss`
    loss-bearing ids (all ids of a document bear loss; None: no limit of its own).

    A document's ids are its text's, then end_id (None: nothing). Documents are cut freely;
    every id lies in exactly one piece. Each partition is packed by itself, without a shuffle
    and with a bounded pool; at its end the rest becomes sequences of power-of-two lengths. The
    sequence's number holds the partition's in its upper bits.

    Returns a row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit),
    loss_tokens, doc_tokens, sequence_id, offset. Null and empty texts have only end_id; an
    empty table packs to nothing; rows that repeat an id are documents of their own; a null id
    stays null; other columns are ignored.
    """

    def run(batches):
        model, packer, rows = ChunkTokenizer.of(tokenizer), Packer(tokens, segments, loss, True, pool), _Rows()
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        for batch, buf, bounds in scan.pieces(batches, "text", 2 * scan.SEGMENT):
            ids, at = model.encode(buf, bounds)
            for k, key in enumerate(batch.column(0).to_pylist()):
                for parts in packer.add(key, np.concatenate((ids[at[k] : at[k + 1]], tail))):
                    rows.put(packer, parts)
                yield from rows.flush(1 << 22)
        for parts in packer.finish():
            rows.put(packer, parts)
        yield from rows.flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def pack_conversations(
    turns: DataFrame, tokenizer: str, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text", answer: str = "assistant", tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int | None = None, end_id: int = 1, pool: int = POOL
) -> DataFrame:
    """Packs instruction data: an example is a conversation, its loss-bearing ids are those of
    the turns whose role is `answer`, with the end_id after each such turn. Examples are cut
    only where they exceed a limit alone.

    Returns rows as pack_documents does; doc_id is the conversation's id. Turns are ordered by
    order_col, then text, nulls first; null roles and texts count as empty. The turns of one
    conversation are gathered in one row, so its length must fit in memory.
    """
    turn = F.struct(F.col(order_col).alias("at"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(role_col) == answer, F.lit(False)).alias("bears"))
    whole = turns.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = whole.select("doc_id", F.col("turns.text").alias("texts"), F.col("turns.bears").alias("bears"))

    def run(batches):
        model, packer, rows = ChunkTokenizer.of(tokenizer), Packer(tokens, segments, loss, False, pool), _Rows()
        tail = np.array([end_id], np.uint32)
        for batch in batches:
            for key, texts, bears in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = [t.encode() for t in texts]
                ids, at = model.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))
                parts = [np.concatenate((ids[at[k] : at[k + 1]], tail)) for k in range(len(raw))]
                flags = np.concatenate([np.full(len(p), b) for p, b in zip(parts, bears, strict=True)])
                for sequence in packer.add(key, np.concatenate(parts), flags):
                    rows.put(packer, sequence)
                yield from rows.flush(1 << 22)
        for sequence in packer.finish():
            rows.put(packer, sequence)
        yield from rows.flush()

    return whole.mapInArrow(run, SCHEMA)
