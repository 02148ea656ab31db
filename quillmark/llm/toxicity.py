"""Toxicity: compression distance between a dictionary of toxic and one of ordinary text."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm import scan

#: Words of a window, and bytes beyond which one is cut into overlapping halves of that size.
WINDOW_WORDS, WINDOW_BYTES = 6, 192
#: Bounds of the sample that the classifier is fitted on: rows of each label, and bytes of a
#: row's text (longer labelled rows aren't drawn).
SAMPLE_ROWS, SAMPLE_BYTES = 2500, 16_384
#: Bytes of the head that both dictionaries share and of a label's own part at last; bytes of
#: that part in the rounds that choose what it is trained on.
HEAD, OWN = 32 << 10, 1 << 10
ROUNDS = (16 << 10, 4 << 10, 2 << 10, OWN, OWN, OWN)
#: Segments and matches that zstandard's training looks for.
SEGMENT, MATCH = 24, 6
#: Percentile of ordinary windows' gains above which a window is chosen.
CHOSEN = 99
THRESHOLD = 0.7
_SPACE = np.uint8(32)
#: Rows of the sample whose sequences are compared at once, words that are copied at once.
_AT_ONCE, _WORDS = 500, 1 << 16


@dataclass
class Windows:
    """Windows of some texts in one buffer: words of letters and digits, A-Z lower-cased, one
    space around each. Window i is raw[start[i] : start[i] + size[i]]; text k has the windows
    at[k] to at[k + 1]; once: no three-word sequence of the window is anywhere else here."""

    raw: bytes
    start: np.ndarray
    size: np.ndarray
    at: np.ndarray
    once: np.ndarray

    def __getitem__(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.start[i] + self.size[i]]


def windows(buf: np.ndarray, bounds: np.ndarray, with_once: bool = False) -> Windows:
    """Consecutive windows of WINDOW_WORDS words. One of more than WINDOW_BYTES is cut into
    overlapping halves of that size, so that it too is compared in full."""
    low = scan.LOWER[buf]
    begin, end, first = scan.words(low, bounds, scan.ALNUM)
    size = end - begin
    goal = np.concatenate(([1], 1 + np.cumsum(size + 1)))  # where each word starts in the new buffer
    raw = np.full(goal[-1], _SPACE, np.uint8)
    for i in range(0, len(begin), _WORDS):
        some = slice(i, i + _WORDS)
        raw[scan.ragged(goal[:-1][some], size[some])] = low[scan.ragged(begin[some], size[some])]
    counts = np.diff(first)
    per = -(-counts // WINDOW_WORDS)
    at = np.concatenate(([0], np.cumsum(per)))
    head = scan.ragged(np.zeros(len(per), np.int64), per) * WINDOW_WORDS + np.repeat(first[:-1], per)
    tail = np.minimum(head + WINDOW_WORDS, np.repeat(first[1:], per))
    start, stop = goal[head] - 1, goal[tail]
    once = np.ones(len(head), bool)
    if with_once and len(begin) > 2:
        repeated = _repeated(scan.row_hashes(scan.span_hashes(low, begin, end), 3))
        text = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        again = np.concatenate(([0], np.cumsum(repeated & (text[2:] == text[:-2]), dtype=np.int32)))
        n = len(repeated)
        once = again[np.minimum(tail, n)] == again[np.clip(head - 2, 0, n)]
    long = stop - start > WINDOW_BYTES
    if long.any():
        half = WINDOW_BYTES // 2
        cuts = np.where(long, -(-(stop - start - half) // half), 1)
        step = scan.ragged(np.zeros(len(cuts), np.int64), cuts) * half
        from_, to = np.repeat(start, cuts) + step, np.repeat(stop, cuts)
        start, stop, once = from_, np.where(np.repeat(long, cuts), np.minimum(from_ + WINDOW_BYTES, to), to), np.repeat(once, cuts)
        at = np.concatenate(([0], np.cumsum(cuts)))[at]
    return Windows(raw.tobytes(), start, stop - start, at, once)


def _repeated(values: np.ndarray) -> np.ndarray:
    """Whether each value occurs more than once."""
    ordered = np.sort(values)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(values), bool)
    return twice[np.minimum(np.searchsorted(twice, values), len(twice) - 1)] == values


def _content(samples: list[bytes], size: int) -> bytes:
    """A dictionary of that size trained by zstandard; too little text is taken as it is."""
    samples = [s for s in samples if len(s) >= 8]
    if sum(map(len, samples)) <= size:
        return b"".join(samples)
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=MATCH).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return b"".join(samples)[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)


def lengths(by: zstandard.ZstdCompressor, raw: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Compressed length of each window."""
    if not len(start):
        return np.empty(0, np.int64)
    out = by.multi_compress_to_buffer(zstandard.BufferWithSegments(raw, np.stack([start, size], 1).astype(np.uint64).tobytes()))
    return np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out))


class Pair:
    """Compressors with the ordinary and with the toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.by = _compressor(ordinary), _compressor(toxic)

    def gains(self, w: Windows) -> np.ndarray:
        """Bytes that each window is shorter with the toxic dictionary."""
        a, b = (lengths(c, w.raw, w.start, w.size) for c in self.by)
        return a - b

    def carriers(self, w: Windows, chosen: np.ndarray) -> list[bytes]:
        """For each text, the words that carry the gains of its chosen windows: of a window, the
        word without which least of the gain is left."""
        raw, owner, n = [], [], 0
        for i in chosen.tolist():
            words = w[i].split()
            raw += [b" " + b" ".join(words[:j] + words[j + 1 :]) + b" " for j in range(len(words))]
            owner += [(i, x) for x in words]
        size = np.array([len(x) for x in raw], np.int64)
        rest = Windows(b"".join(raw), np.cumsum(size) - size, size, np.zeros(1, np.int64), np.empty(0, bool))
        least: dict[int, tuple[int, bytes]] = {}
        for (i, word), left in zip(owner, self.gains(rest).tolist(), strict=True):
            if i not in least or left < least[i][0]:
                least[i] = left, word
        text = np.searchsorted(w.at, np.array(list(least), np.int64), side="right")
        own: dict[int, dict[bytes, None]] = {}
        for k, (_, word) in zip(text.tolist(), least.values(), strict=True):
            own.setdefault(k, {})[word] = None
        return [b" " + b" ".join(words) + b" " for words in own.values()]


def features(gain: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each text: its two largest gains and, logarithmically, its windows that gain a little
    and much and all of its windows."""
    out = np.zeros((len(at) - 1, 5))
    for k in range(len(out)):
        own = gain[at[k] : at[k + 1]]
        if len(own):
            top = np.partition(own, -2)[-2:] if len(own) > 1 else (0, own[0])
            out[k] = top[1], top[0], np.log1p((own >= 3).sum()), np.log1p((own >= 5).sum()), np.log1p(len(own))
    return out


@dataclass
class Model:
    """Two dictionaries and the calibration of the windows' differences."""

    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(6))
    fitted: bool = False

    def scorer(self):
        """A function from texts (buffer, bounds) to their scores."""
        if not self.fitted:
            return lambda buf, bounds: np.zeros(len(bounds) - 1)
        pair = Pair(self.ordinary, self.toxic)

        def score(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            w = windows(buf, bounds)
            z = features(pair.gains(w), w.at) @ self.weights[:-1] + self.weights[-1]
            return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

        return score


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    scale = x.std(0) + 1e-9
    z = np.c_[x / scale, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], 0.05), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        grad = z.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + np.diag(ridge + 1e-9), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return np.r_[w[:-1] / scale, w[-1]]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def _without_copies(sample: list[tuple[bytes, int]]) -> list[tuple[bytes, int]]:
    """The sample without texts that have half of their five-word sequences, or more, from
    earlier ones: nothing is learnt twice or judged by its own copy."""
    buf, bounds = _joined([t for t, _ in sample])
    low = scan.LOWER[buf]
    begin, end, first = scan.words(low, bounds, scan.ALNUM)
    shingles = scan.row_hashes(scan.span_hashes(low, begin, end), 5)
    del buf, low, begin, end
    seen, out = np.empty(0, np.uint64), []
    for at in range(0, len(sample), _AT_ONCE):
        rows = sample[at : at + _AT_ONCE]
        own = [np.unique(shingles[first[at + k] : max(first[at + k], first[at + k + 1] - 4)]) for k in range(len(rows))]
        old = [seen[np.minimum(np.searchsorted(seen, o), len(seen) - 1)] == o if len(seen) else np.zeros(len(o), bool) for o in own]
        # within the rows taken at once: what an earlier one of them has
        text = np.repeat(np.arange(len(rows)), [len(o) for o in own])
        every = np.concatenate(own) if own else np.empty(0, np.uint64)
        by = np.lexsort((text, every))
        again = np.zeros(len(every), bool)
        again[by[1:]] = every[by][1:] == every[by][:-1]
        copied = np.bincount(text, np.concatenate(old) | again, len(rows)) if len(every) else np.zeros(len(rows))
        out += [r for r, o, n in zip(rows, own, copied, strict=True) if not len(o) or 2 * n < len(o)]
        seen = np.union1d(seen, every)
    return out


def fit(sample: list[tuple[bytes, int]], share: dict[int, float]) -> Model:
    """A model of (text, label) rows. share: part of all rows of that label that the sample has.

    Most of a toxic text is ordinary. So each label's dictionary has a head in common, trained
    on ordinary windows, and a part of its own, which says what is compared: that of the toxic
    label is trained on toxic texts, that of the ordinary label on ordinary ones, first on whole
    windows, then, in ROUNDS, on what the compressed lengths choose: the windows of one
    half of the sample that the other half's toxic dictionary favours most, each reduced to the
    word that carries its gain. (In ordinary texts those are the false alarms, which thus become
    cheap with the ordinary dictionary.) The windows' gains are calibrated on each half with the
    other half's dictionaries. Windows that texts share aren't trained on.

    Without two rows of both labels nothing can be told apart, and every score is 0."""
    sample = _without_copies(sample)
    scan.give_back()
    by = [[t for t, label in sample if label == wanted] for wanted in (0, 1)]
    if min(map(len, by)) < 2:
        return Model()
    every = [t[half::2] for half in (0, 1) for t in by]  # ordinary and toxic of one half, then of the other
    buf, bounds = _joined([t for part in every for t in part])
    whole = windows(buf, bounds, with_once=True)
    del buf
    scan.give_back()
    parts, at = [], 0
    for texts in every:
        lo, hi = whole.at[at], whole.at[at + len(texts)]
        parts.append(Windows(whole.raw, whole.start[lo:hi], whole.size[lo:hi], whole.at[at : at + len(texts) + 1] - lo, whole.once[lo:hi]))
        at += len(texts)
    fresh = [np.flatnonzero(p.once) for p in parts]
    samples = [[p[i] for i in idx.tolist()] for p, idx in zip(parts, fresh, strict=True)]
    head = _content(samples[0][::2] + samples[2][::2], HEAD)
    # as many ordinary windows as toxic ones, others than the head's
    now = [samples[0][1::2][: len(samples[1])], samples[1], samples[2][1::2][: len(samples[3])], samples[3]]
    for size in ROUNDS:
        after = list(now)
        for half in (0, 1):
            pair = Pair(*(head + _content(x, size) for x in now[2 - 2 * half : 4 - 2 * half]))
            gain = [pair.gains(parts[2 * half + label]) for label in (0, 1)]
            usual = gain[0][fresh[2 * half]]
            least = max(2, np.percentile(usual, CHOSEN) + 1) if len(usual) else 2
            for label in (0, 1):
                k = 2 * half + label
                after[k] = pair.carriers(parts[k], fresh[k][gain[label][fresh[k]] >= least]) or now[k]
        now = after
    x, y = [], []
    for half in (0, 1):
        pair = Pair(*(head + _content(c, OWN) for c in now[2 - 2 * half : 4 - 2 * half]))
        for label in (0, 1):
            p = parts[2 * half + label]
            x.append(features(pair.gains(p), p.at))
            y.append(np.full(len(p.at) - 1, float(label)))
    y = np.concatenate(y)
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    ordinary, toxic = (head + _content(now[label] + now[2 + label], OWN) for label in (0, 1))
    return Model(ordinary, toxic, _logistic(np.concatenate(x), y, weight / weight.mean()), True)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS, bytes_each: int = SAMPLE_BYTES) -> Model:
    """Fits on at most `rows` labelled rows of each label, drawn by a hash of the id."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    size = F.octet_length(F.col(text_col).cast("string"))
    # ids and sizes are joined and ordered; texts are read for the drawn ids alone
    pool = docs.select(F.col(id_col).alias("id"), size.alias("size")).where((F.col("size") > 0) & (F.col("size") <= bytes_each)).join(known, "id")
    total = {r["label"]: r["n"] for r in pool.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = pool.where("label = 0").orderBy(F.xxhash64("id"), "id").limit(rows).union(pool.where("label = 1").orderBy(F.xxhash64("id"), "id").limit(rows))
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in drawn.select("id", "label").distinct().collect()], "id long, label int")
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where((size > 0) & (size <= bytes_each)).join(F.broadcast(ids), "id")  # 2 * rows at most
    sample = [(r["text"].encode(), r["label"]) for r in chosen.orderBy(F.xxhash64("id"), "id", "text").limit(2 * rows).collect()]
    share = {label: min(1.0, rows / max(1, total.get(label, 0))) for label in (0, 1)}
    return fit(sample, share)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on): one row per row.

    Each whole text is read in windows of words; a window's gain is the difference of its
    compressed lengths with the two dictionaries, and the largest gains and the numbers of
    windows beyond two thresholds, calibrated on labelled rows, give the score. Only the text is read; other columns are carried on. Null and empty
    texts get the score of a text without windows; ids don't matter; an empty table gives no
    rows. Columns named score or predicted are replaced.
    """
    carried = [c for c in docs.columns if c not in ("score", "predicted")]
    source = docs.select(*carried)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    at = carried.index(text_col)

    def run(batches):
        score = broadcast.value.scorer()
        for batch in batches:
            text = batch.column(at)
            whole = pa.RecordBatch.from_arrays([text], ["text"])
            scores = [score(buf, bounds) for _, buf, bounds in scan.pieces([whole], "text", 1 << 18)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.empty(0))], [*carried, "score"])

    schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
