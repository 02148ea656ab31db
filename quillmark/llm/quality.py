"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm import scan

#: Share by which a class's covariance is shrunk towards its own diagonal, and what the
#: diagonal gets besides (in units of the pooled variance).
SHRINKAGE, RIDGE = 0.1, 0.1
THRESHOLD = 0.3
#: Buckets of log-density differences by which scores are calibrated, and their width.
BUCKETS, WIDTH = 400, 0.5

#: Bytes by kind: the first byte of a non-ASCII character counts as a letter.
_KIND = np.zeros(256, np.int8)
SPACE, LOWER, UPPER, DIGIT, STOP, MARK, FOLLOW = range(7)
_KIND[:] = MARK
_KIND[[0x20, *range(0x09, 0x0E)]] = SPACE
_KIND[ord("a") : ord("z") + 1] = LOWER
_KIND[0xC0:] = LOWER
_KIND[0x80:0xC0] = FOLLOW
_KIND[ord("A") : ord("Z") + 1] = UPPER
_KIND[ord("0") : ord("9") + 1] = DIGIT
_KIND[[ord(c) for c in ".,;:'\"()-?/"]] = STOP

STATISTICS = [
    "words", "letters_a_word", "spread_of_lengths", "upper", "digits", "stops", "marks", "marks_at_worst", "upper_at_worst", "unlettered", "repeated", "repeated_at_worst", "distinct", "common", "lines",
]
#: Words of a block; `..._at_worst` is the largest of a text's blocks.
BLOCK = 50


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Shares with the arcsine square root, which evens out their variances."""
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))


def _worst(flags: np.ndarray, per: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text, the largest share sum(flags) / sum(per) of its blocks of BLOCK words."""
    n = np.diff(first)
    out = np.zeros(len(n))
    if not len(flags):
        return out
    of = np.repeat(np.arange(len(n)), n)
    block = (np.arange(len(flags)) - first[of]) // BLOCK
    starts = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (block[1:] != block[:-1]))))
    share = np.add.reduceat(flags, starts) / np.maximum(np.add.reduceat(per, starts), 1)
    np.maximum.at(out, of[starts], share)
    return out


def describe(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The transformed statistics of texts, one row each; a text without words has zeros."""
    kind = _KIND[buf]
    count = {}
    for k in (LOWER, UPPER, DIGIT, STOP, MARK):
        total = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(kind == k, out=total[1:])
        count[k] = total
    doc = {k: t[bounds[1:]] - t[bounds[:-1]] for k, t in count.items()}
    visible = sum(doc.values())
    letters = doc[LOWER] + doc[UPPER]
    start, end, first = scan.words(buf, bounds, scan.NOT_SPACE)
    n = np.diff(first)
    word = {k: t[end] - t[start] for k, t in count.items()}
    size = sum(word.values())
    lettered = word[LOWER] + word[UPPER]

    def per_text(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values.astype(np.float64))))
        return total[first[1:]] - total[first[:-1]]

    hashes = scan.span_hashes(buf, start, end)
    of = np.repeat(np.arange(len(n)), n)
    again = np.zeros(len(start), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    new = np.ones(len(start), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    begins = np.flatnonzero(new)
    often = np.zeros(len(n))
    if len(begins):
        np.maximum.at(often, of[order][begins], np.diff(np.append(begins, len(start))))
    distinct = np.bincount(of[order][new], minlength=len(n)) if len(start) else np.zeros(len(n))
    mean = per_text(lettered) / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(per_text(lettered.astype(np.float64) ** 2) / np.maximum(n, 1) - mean**2, 0))
    breaks = np.concatenate(([0], np.cumsum(buf == 0x0A)))
    shouted = (word[UPPER] > 1) & (word[LOWER] == 0)
    rows = [
        np.log1p(n),
        np.log1p(mean),
        np.log1p(spread),
        _share(doc[UPPER], letters),
        _share(doc[DIGIT], visible),
        _share(doc[STOP], visible),
        _share(doc[MARK], visible),
        np.arcsin(np.sqrt(np.clip(_worst(word[MARK], size, first), 0, 1))),
        np.arcsin(np.sqrt(np.clip(_worst(shouted.astype(np.int64), np.ones(len(start), np.int64), first), 0, 1))),
        _share(per_text(lettered == 0), n),
        _share(per_text(again), n),
        np.arcsin(np.sqrt(np.clip(_worst(again.astype(np.int64), np.ones(len(start), np.int64), first), 0, 1))),
        np.log1p(distinct) / np.maximum(np.log1p(n), 1),
        _share(often, n),
        np.log1p(breaks[bounds[1:]] - breaks[bounds[:-1]]),
    ]
    return np.where(n[:, None] > 0, np.stack(rows, axis=1), 0.0)


@dataclass(frozen=True)
class Model:
    """Means and inverse Cholesky factors of both classes, log-determinants and the slope and
    intercept that turn differences of log-densities into scores."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, by Mahalanobis distances."""
        d = [((x - m) @ f.T) for m, f in zip(self.means, self.factors, strict=True)]
        far = [np.einsum("ij,ij->i", v, v) for v in d]
        return 0.5 * (far[0] - far[1]) + 0.5 * (self.log_dets[0] - self.log_dets[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), self.intercept)
        z = np.clip(self.slope * self.difference(x) + self.intercept, -700, 700)
        return 1 / (1 + np.exp(-z))


def discriminant(n: np.ndarray, sums: np.ndarray, products: np.ndarray, shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> Model:
    """A model from each class's number of rows, sums and sums of products.

    A class covariance is shrunk towards its diagonal, and the more the fewer rows it has
    (k / (n + k) for k statistics at least); the diagonal gets a share of the pooled variance,
    so a statistic that is constant in a class does not decide alone.
    """
    k = sums.shape[1]
    means = sums / n[:, None]
    cov = products / n[:, None, None] - np.einsum("ci,cj->cij", means, means)
    pooled = np.einsum("c,cij->ij", n / n.sum(), cov).diagonal()
    floor = ridge * np.maximum(pooled, pooled[pooled > 0].min() if (pooled > 0).any() else 1.0)
    factors, log_dets = [], []
    for c, rows in zip(cov, n, strict=True):
        a = max(shrinkage, k / (rows + k))
        c = (1 - a) * c + a * np.diag(c.diagonal()) + np.diag(floor)
        lower = np.linalg.cholesky(c)
        factors.append(np.linalg.solve(lower, np.eye(k)))
        log_dets.append(2 * np.log(lower.diagonal()).sum())
    return Model(means, np.stack(factors), np.array(log_dets))


def calibrate(centres: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through counts (2 x buckets) of each label, by
    Newton steps with a weak pull to (0, 0); the slope is never negative."""
    x = np.stack([centres, np.ones_like(centres)], axis=1)
    total, ones = counts.sum(0), counts[1]
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
        gradient = x.T @ (ones - total * p) - 1e-3 * w
        step = np.linalg.solve((x * (total * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        w = w + step / max(1.0, np.abs(step).max() / 2)
    return max(float(w[0]), 1e-6), float(w[1])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the array of transformed statistics of each row's whole text (null: empty)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for part, buf, bounds in scan.pieces(batches, "text"):
            x = describe(buf, bounds)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), values], ["id", "x"])

    return source.mapInArrow(run, T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))]))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """A model of all labelled rows. Spark sums rows, statistics and their products by label,
    then counts differences of log-densities in buckets for the calibration, so the driver gets
    some hundred numbers however many rows are labelled. An id that has several labels counts
    with each; a null or other label is ignored. Without two rows of both labels, the score is
    the share of label 1 (0.5 without any).
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    rows = stats.join(known, "id").select("label", "x")
    k = len(STATISTICS)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(k)]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in pairs]
    found = {r["label"]: r for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()}
    if any(label not in found or found[label]["n"] < 2 for label in (0, 1)):
        n = {label: r["n"] for label, r in found.items()}
        return Model(np.empty((0, k)), np.empty((0, k, k)), np.empty(0), 0.0, n.get(1, 0) / sum(n.values()) if n else 0.5)
    n = np.array([found[label]["n"] for label in (0, 1)], float)
    s = np.array([[found[label][f"s{i}"] for i in range(k)] for label in (0, 1)])
    p = np.zeros((2, k, k))
    for label in (0, 1):
        for i, j in pairs:
            p[label, i, j] = p[label, j, i] = found[label][f"p{i}_{j}"]
    model = discriminant(n, s, p)
    limit = BUCKETS // 2

    def bucket(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, k)
            b = np.clip(np.floor(model.difference(x) / WIDTH), -limit, limit - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(b)], ["label", "bucket"])

    counts = np.zeros((2, BUCKETS))
    for r in rows.mapInArrow(bucket, "label int, bucket long").groupBy("label", "bucket").count().collect():
        counts[r["label"], r["bucket"] + limit] += r["count"]
    slope, intercept = calibrate((np.arange(BUCKETS) - limit + 0.5) * WIDTH, counts)
    return Model(model.means, model.factors, model.log_dets, slope, intercept)


def score_statistics(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """id, score and predicted of what `statistics` returns."""
    broadcast = stats.sparkSession.sparkContext.broadcast(model)  # a few KB

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(broadcast.value.score(x))], ["id", "score"])

    schema = T.StructType([stats.schema["id"], T.StructField("score", T.DoubleType())])
    return stats.select("id", "x").mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, score (0 to 1, higher: label 1 likelier) and predicted (1 from the threshold on), one
    row per row of docs.

    Only the whole text is read: statistics of letters, marks, repetition and lines, shares by
    arcsine square roots and counts by logarithms, go into two normal densities with shrunk
    covariances, whose inverse Cholesky factors are kept in the model. Null and empty texts have
    all statistics zero; ids may be null or repeat; other columns are ignored; an empty table
    gives no rows.
    """
    return score_statistics(statistics(docs, id_col, text_col), model, threshold)
