"""LM scoring: masked pseudo-likelihood of a bidirectional window network trained in numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import scan
from quillmark.llm.anchored import texts_of
from quillmark.llm.storage import discard, written

#: Words with an id of their own in the network, and ids that all other words share by hash.
KNOWN, SHARED = 1023, 1024
#: Most words whose own counts are broadcast (16 bytes each); other words of an id share what
#: is left of it evenly.
WORDS = 1 << 20
VOCAB, PAD = KNOWN + SHARED + 1, KNOWN + SHARED
REACH, WIDTH, HIDDEN, CLASSES = 2, 16, 32, 32
SLOTS = VOCAB // CLASSES
BATCH, RATE, ROUNDS = 8192, 0.08, 2
#: Tokens scored at once; what a core's cache holds.
SCORED = 4096
#: Tokens that are trained on one after the other, and most such shards.
SHARD, SHARDS = 1 << 21, 8192
_PARTS = {"embed": (VOCAB, WIDTH), "inner": (2 * REACH * WIDTH, HIDDEN), "bias": (HIDDEN,), "top": (HIDDEN, CLASSES), "top_bias": (CLASSES,), "slot": (CLASSES, HIDDEN, SLOTS), "slot_bias": (CLASSES, SLOTS)}
_SIZE = sum(int(np.prod(s)) for s in _PARTS.values())
_BLOCK = 4096


def _views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _PARTS.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start() -> np.ndarray:
    """Parameters before training, the same everywhere."""
    flat = np.zeros(_SIZE, np.float32)
    rng = np.random.Generator(np.random.PCG64(11))
    for name, x in _views(flat).items():
        if "bias" not in name:
            x[:] = rng.normal(0, 0.3 if name == "embed" else x.shape[-2] ** -0.5 * 0.5, x.shape)
    return flat


@dataclass
class Words:
    """What is known of words: sorted hashes, the ids of each and the log of its share of all
    occurrences of its id, and that share for the words not listed, by shared id."""

    hashes: np.ndarray
    ids: np.ndarray
    share: np.ndarray
    rest: np.ndarray

    @classmethod
    def none(cls) -> Words:
        return cls(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.float32), np.zeros(SHARED, np.float32))

    def known(self) -> Words:
        """Only the words with an id of their own."""
        own = self.ids < KNOWN
        return Words(self.hashes[own], self.ids[own], self.share[own], self.rest)


def token_ids(buf: np.ndarray, bounds: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the words (A-Z lower-cased) of some texts, each text's first word, and the log of
    each word's share of its id."""
    low = scan.LOWER[buf]
    begin, end, first = scan.words(low, bounds, scan.NOT_SPACE)
    h = scan.span_hashes(low, begin, end)
    slot = ((h >> np.uint64(33)) % np.uint64(SHARED)).astype(np.int64)
    ids, share = KNOWN + slot, words.rest[slot]
    if len(words.hashes):
        at = np.minimum(np.searchsorted(words.hashes, h), len(words.hashes) - 1)
        hit = words.hashes[at] == h
        ids[hit], share[hit] = words.ids[at[hit]], words.share[at[hit]]
    return ids, first, share


def contexts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The REACH ids before and after each word in its text, PAD beyond its ends."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full((len(ids), 2 * REACH), PAD, np.int64)
    for k, o in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        a, b = (slice(-o, None), slice(None, o)) if o < 0 else (slice(None, -o), slice(o, None))
        if abs(o) < len(ids):
            same = text[a] == text[b]
            out[a, k] = np.where(same, ids[b], PAD)
    return out


def _exponentials(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of each row up to a factor, in place, and the rows' sums. Rows are brought down by
    their maximum only where one is so large or small that exp could leave float's range."""
    if len(values) and max(values.max(), -values.min()) > 60:
        values -= values.max(1, keepdims=True)
    np.exp(values, out=values)
    return values, values @ np.ones(values.shape[1], np.float32)


class Network:
    """Predicts a word from both sides: p(class of the word) p(word in its class)."""

    def __init__(self, flat: np.ndarray) -> None:
        self.flat = flat
        self.p = _views(flat)
        self._rooms: dict[str, np.ndarray] = {}

    def _room(self, name: str, rows: int, width: int) -> np.ndarray:
        """Space for rows, the same at each call: fresh arrays of this size are fresh pages,
        which cost more time than what is computed in them."""
        have = self._rooms.get(name)
        if have is None or len(have) < rows:
            have = self._rooms[name] = np.empty((rows, width), np.float32)
        return have[:rows]

    def _forward(self, context: np.ndarray, target: np.ndarray):
        """Inputs, hidden values, exponentials of the class and slot values with their sums, and
        the tokens by class; slots are in the order of classes."""
        p, size = self.p, len(target)
        x = self._room("x", size, 2 * REACH * WIDTH)
        np.take(p["embed"], context.ravel(), axis=0, out=x.reshape(-1, WIDTH), mode="clip")
        h = np.matmul(x, p["inner"], out=self._room("h", size, HIDDEN))
        h += p["bias"]
        np.tanh(h, out=h)
        top = np.matmul(h, p["top"], out=self._room("top", size, CLASSES))
        top += p["top_bias"]
        top, top_sum = _exponentials(top)
        kind = (target % CLASSES).astype(np.uint8)  # small numbers are sorted by their digits
        order = np.argsort(kind, kind="stable")
        edges = np.concatenate(([0], np.cumsum(np.bincount(kind, minlength=CLASSES)))).tolist()
        slot = self._room("slot", size, SLOTS)
        ordered = np.take(h, order, axis=0, out=self._room("ordered", size, HIDDEN), mode="clip")
        for c in range(CLASSES):
            a, b = edges[c], edges[c + 1]
            if a < b:
                np.matmul(ordered[a:b], p["slot"][c], out=slot[a:b])
                slot[a:b] += p["slot_bias"][c]
        slot, slot_sum = _exponentials(slot)
        return x, h, top, top_sum, order, edges, ordered, slot, slot_sum

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        _, _, top, top_sum, order, _, _, slot, slot_sum = self._forward(context, target)
        n = np.arange(len(target))
        out = np.log(top[n, target % CLASSES] / top_sum + 1e-30)
        out[order] += np.log(slot[n, (target // CLASSES)[order]] / slot_sum + 1e-30)
        return out

    def train(self, context: np.ndarray, target: np.ndarray, grown: np.ndarray) -> None:
        """One Adagrad step; grown: sums of squared gradients so far."""
        p, n = self.p, np.arange(len(target))
        x, h, top, top_sum, order, edges, ordered, slot, slot_sum = self._forward(context, target)
        top *= (1 / top_sum)[:, None]
        slot *= (1 / slot_sum)[:, None]
        top[n, target % CLASSES] -= 1
        slot[n, (target // CLASSES)[order]] -= 1
        flat = np.zeros(_SIZE, np.float32)
        g = _views(flat)
        g["top"][:] = h.T @ top
        ones = np.ones(len(target), np.float32)
        g["top_bias"][:] = ones @ top
        from_slots = self._room("from_slots", len(target), HIDDEN)  # in the order of classes
        for c in range(CLASSES):
            a, b = edges[c], edges[c + 1]
            if a < b:
                np.matmul(ordered[a:b].T, slot[a:b], out=g["slot"][c])
                np.matmul(ones[a:b], slot[a:b], out=g["slot_bias"][c])
                np.matmul(slot[a:b], p["slot"][c].T, out=from_slots[a:b])
        back = np.matmul(top, p["top"].T, out=self._room("back", len(target), HIDDEN))
        place = np.empty_like(order)
        place[order] = n
        back += np.take(from_slots, place, axis=0, out=ordered, mode="clip")
        h *= h
        np.subtract(1, h, out=h)
        back *= h
        g["inner"][:] = x.T @ back
        g["bias"][:] = ones @ back
        ctx = context.ravel().astype(np.uint16)
        by = np.argsort(ctx, kind="stable")
        rows = np.matmul(back, p["inner"].T, out=x).reshape(-1, WIDTH)
        rows = np.take(rows, by, axis=0, out=self._room("rows", len(by), WIDTH), mode="clip")
        ctx = ctx[by]
        heads = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))
        g["embed"][ctx[heads]] = np.add.reduceat(rows, heads, axis=0)
        flat /= len(target)
        grown += flat * flat
        flat *= RATE
        flat /= np.sqrt(grown)
        self.flat -= flat


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (64-bit hash), n: occurrences in all texts."""

    def run(batches):
        words, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

        for _, buf, bounds in scan.pieces(batches, "text", 4 * scan.SEGMENT):
            low = scan.LOWER[buf]
            begin, end, _ = scan.words(low, bounds, scan.NOT_SPACE)
            w, n = np.unique(scan.span_hashes(low, begin, end), return_counts=True)
            both, at = np.unique(np.concatenate((words, w)), return_inverse=True)
            words, counts = both, np.bincount(at, np.concatenate((counts, n)), len(both)).astype(np.int64)
            if len(words) > 1 << 19:
                yield out()
                words, counts = words[:0], counts[:0]
        if len(words):
            yield out()

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word long, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, text_col: str = "text", most: int = WORDS) -> Words:
    """Counts of all texts' words, as shares of their ids. The KNOWN most frequent words have
    ids of their own. Words with a count from which there are at most `most` are listed; the
    others are known by what they have in all, id by id."""
    return _shares(written(word_counts(docs, text_col)), most)[0]


def _shares(counts: DataFrame, most: int) -> tuple[Words, int]:
    """(words, all occurrences) of written counts, which are removed."""
    # few counts are distinct: n of them need n * (n + 1) / 2 occurrences at least
    by_count = sorted(((r["n"], r["words"]) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    least, listed = (by_count[0][0] + 1 if by_count else 1), 0
    for n, words in by_count:
        listed += words
        if listed > most:
            break
        least = n
    rows = counts.where(F.col("n") >= least).toArrow()
    h, n = rows.column("word").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    slot = F.shiftrightunsigned("word", 33) % SHARED
    sums = counts.groupBy(slot.alias("slot")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") < least, F.col("n"))).alias("left"), F.count(F.when(F.col("n") < least, 1)).alias("words")).collect()
    discard(counts)
    total, left, others = (np.zeros(SHARED) for _ in range(3))
    for r in sums:
        total[r["slot"]], left[r["slot"]], others[r["slot"]] = r["n"], r["left"] or 0, r["words"]
    order = np.lexsort((h.view(np.int64), -n))[:KNOWN]
    own = ((h >> np.uint64(33)) % np.uint64(SHARED)).astype(np.int64)
    ids = KNOWN + own
    ids[order] = np.arange(len(order))
    occurrences = int(total.sum())
    total -= np.bincount(own[order], n[order], SHARED)  # of the words that share an id
    share = np.where(ids < KNOWN, 0.0, np.log(n / np.maximum(total[own], 1)))
    rest = np.log(np.maximum(left, 1) / np.maximum(others, 1) / np.maximum(total, 1))
    by = np.argsort(h)
    return Words(h[by], ids[by], share[by].astype(np.float32), rest.astype(np.float32)), occurrences


def _summed(rows: DataFrame, *by: str) -> DataFrame:
    """Weighted sums of parameter blocks that share the columns `by`."""
    names = [*by, "tokens", "values"]

    def total(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy(), kind="stable")
        values = table.column("values").to_pylist()
        whole = sum(np.frombuffer(values[i], np.float64) for i in order.tolist())
        fixed = {c: table.column(c)[0].as_py() for c in by}
        return pa.table({**{c: pa.array([v], table.schema.field(c).type) for c, v in fixed.items()}, "tokens": [float(sum(table.column("tokens").to_pylist()))], "values": pa.array([whole.tobytes()], pa.binary()), "part": pa.array([min(table.column("part").to_pylist())], pa.int32())})

    kinds = {"block": "int", "salt": "int", "tokens": "double", "values": "binary"}
    return rows.groupBy(*by).applyInArrow(total, ", ".join(f"{c} {kinds[c]}" for c in names) + ", part int")


def train(docs: DataFrame, words: Words, shards: int, text_col: str = "text", id_col: str = "doc_id", rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after `rounds` rounds of local training and averaging.

    Texts are dealt to shards by a hash of id and text and come in its order there, so the
    parameters don't depend on how rows lie in files or partitions. In a round every shard
    starts from the same parameters, learns from all its texts and sends its parameters,
    weighted by its tokens; blocks of them are summed by salt and then in all, so no task gathers
    more than the square root of the number of shards. Round r predicts the tokens at places r,
    r + rounds, ... of each text: over all rounds every token is learnt from once."""
    context = docs.sparkSession.sparkContext
    flat, known, salts = start(), words.known(), math.isqrt(shards) + 1
    order = F.xxhash64("doc_id", "text")
    dealt = texts_of(docs, id_col, text_col).select(order.alias("order"), "text").withColumn("shard", F.pmod("order", F.lit(shards)))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "order").select("shard", "text")
    for r in range(rounds):
        shared = context.broadcast((flat, known))

        def run(batches, r=r, shared=shared):
            begin, words = shared.value
            now, net = None, None

            def sent():
                if len(left_t):
                    net.train(left_c, left_t, grown)
                n = float(tokens + len(left_t))
                at = range(0, _SIZE, _BLOCK)
                values = [(net.flat[i : i + _BLOCK].astype(np.float64) * n).tobytes() for i in at]
                return pa.RecordBatch.from_arrays(
                    [pa.array(range(len(at)), pa.int32()), pa.array([now % salts] * len(at), pa.int32()), pa.array([n] * len(at)), pa.array(values, pa.binary()), pa.array([now] * len(at), pa.int32())],
                    ["block", "salt", "tokens", "values", "part"],
                )

            for batch, buf, bounds in scan.pieces(batches, "text"):
                shard = batch.column(0).to_numpy()
                edges = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    if shard[i] != now:
                        if now is not None:
                            yield sent()
                        now, net, grown, tokens = int(shard[i]), Network(begin.copy()), np.full(_SIZE, 1e-4, np.float32), 0
                        left_c, left_t = np.empty((0, 2 * REACH), np.int64), np.empty(0, np.int64)
                    ids, first, _ = token_ids(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], words)
                    chosen = (np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))) % rounds == r
                    c, t = np.concatenate((left_c, contexts(ids, first)[chosen])), np.concatenate((left_t, ids[chosen]))
                    whole = len(t) // BATCH * BATCH
                    for at in range(0, whole, BATCH):
                        net.train(c[at : at + BATCH], t[at : at + BATCH], grown)
                    tokens += whole
                    left_c, left_t = c[whole:], t[whole:]
            if now is not None:
                yield sent()

        rows = dealt.mapInArrow(run, "block int, salt int, tokens double, values binary, part int")
        total = _summed(_summed(rows, "block", "salt"), "block").orderBy("block").collect()
        shared.unpersist()
        if not total or not total[0]["tokens"]:
            break
        flat = np.concatenate([np.frombuffer(x["values"], np.float64) / x["tokens"] for x in total]).astype(np.float32)
    return flat


def score(docs: DataFrame, words: Words, flat: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over all tokens of the log probability of the
    token given its neighbours), per_token (its mean, null without tokens)."""
    shared = docs.sparkSession.sparkContext.broadcast((flat, words))

    def run(batches):
        parameters, words = shared.value
        net = Network(parameters.copy())
        for batch, buf, bounds in scan.pieces(batches, "text"):
            ids, first, share = token_ids(buf, bounds, words)
            around = contexts(ids, first)
            logs = np.zeros(len(ids) + 1)
            for at in range(0, len(ids), SCORED):
                logs[at + 1 : at + 1 + SCORED] = net.log_probabilities(around[at : at + SCORED], ids[at : at + SCORED])
            logs[1:] += share
            total = np.cumsum(logs)
            n = np.diff(first)
            likelihood = total[first[1:]] - total[first[:-1]]
            mean = pa.array(likelihood / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(likelihood), mean], ["doc_id", "n_tokens", "log_likelihood", "per_token"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, per_token double")


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, tokens_a_shard: int = SHARD) -> DataFrame:
    """Scores all texts with a network trained on all of them; one row per row of docs.

    Words are counted over all texts. The network predicts ids: the KNOWN most frequent words
    have ids of their own, the others share ids by hash. A word's log-probability is its id's
    plus the log of the word's share of all occurrences of the id, so the probabilities of all
    words of the corpus add up to 1 at any place. Null and empty texts have no tokens,
    likelihood 0 and no mean; null and repeated ids are rows like others; an empty table gives
    no rows; other columns are ignored. Results don't depend on how rows lie in partitions (but
    for the rounding of float arithmetic).
    """
    words, tokens = _shares(written(word_counts(docs, text_col)), WORDS)
    shards = min(SHARDS, max(1, -(-tokens // tokens_a_shard)))
    return score(docs, words, train(docs, words, shards, text_col, id_col, rounds), id_col, text_col)
