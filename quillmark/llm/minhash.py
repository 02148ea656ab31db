"""MinHash near-dedup: b-bit signatures after band candidate generation, exact confirmation."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import scan
from quillmark.llm.components import connected_components
from quillmark.llm.storage import discard, written

SHINGLE, BANDS, ROWS, BITS = 5, 32, 5, 2
#: Standard deviations below the threshold at which an estimate rules a pair out.
SLACK = 6.0

_rng = np.random.Generator(np.random.PCG64(7))
_MUL = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_WORDS = -(-BANDS * ROWS // 64)


def shingle_set(buf: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a text of fewer words has its
    whole word sequence as the only one, a text without words none."""
    low = scan.LOWER[buf]
    start, end, _ = scan.words(low, np.array([0, len(buf)]), scan.NOT_SPACE)
    return _distinct(scan.span_hashes(low, start, end), size)


def _distinct(hashes: np.ndarray, size: int) -> np.ndarray:
    if not len(hashes):
        return hashes
    n = min(size, len(hashes))
    return np.unique(scan.row_hashes(hashes, n, n))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sets x BANDS band keys, sets x BITS*_WORDS packed low bits) of non-empty sets."""
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    minima = np.empty((BANDS * ROWS, len(sets)), np.uint32)
    for j in range(BANDS * ROWS):
        minima[j] = np.minimum.reduceat(_scramble(values * _MUL[j] + _ADD[j]), at)
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(sets), band, np.uint64)
        for j in range(band * ROWS, (band + 1) * ROWS):
            h = h * np.uint64(scan.BASE) + minima[j]
        keys[:, band] = scan.mix(h)
    planes = np.zeros((BITS, _WORDS * 64, len(sets)), np.uint8)
    for bit in range(BITS):
        planes[bit, : BANDS * ROWS] = (minima >> np.uint32(bit)) & np.uint32(1)
    packed = np.packbits(planes.transpose(2, 0, 1).reshape(len(sets), -1), axis=1)
    return keys.view(np.int64), np.ascontiguousarray(packed).view(np.int64)


def _scramble(x: np.ndarray) -> np.ndarray:
    """Carries high bits to the low ones, which are the ones retained."""
    return x ^ (x >> np.uint32(15))


def _rows(size: int):
    kinds = {"doc_id": pa.int64(), "mark": pa.int64(), "n_shingles": pa.int64(), "set_hash": pa.binary(), "bands": pa.list_(pa.int64()), "bits": pa.list_(pa.int64())}

    def run(batches):
        for batch, buf, bounds in scan.pieces(batches, "text"):
            low = scan.LOWER[buf]
            start, end, first = scan.words(low, bounds, scan.NOT_SPACE)
            hashes = scan.span_hashes(low, start, end)
            sets = [_distinct(hashes[i:j], size) for i, j in zip(first[:-1], first[1:], strict=True)]
            full = [k for k, s in enumerate(sets) if len(s)]
            bands, bits = [None] * len(sets), [None] * len(sets)
            if full:
                keys, packed = signatures([sets[k] for k in full])
                for k, x, y in zip(full, keys, packed, strict=True):
                    bands[k], bits[k] = x, y
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            columns = [batch.column(0), batch.column(1), [len(s) for s in sets], digest, bands, bits]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    return run


def estimate(x: Column, y: Column) -> Column:
    """Similarity from packed low bits: the share of minima whose retained bits all agree,
    corrected for chance agreement."""
    differ = F.lit(0).cast("bigint")
    for word in range(_WORDS):
        any_bit = F.lit(0).cast("bigint")
        for bit in range(BITS):
            i = bit * _WORDS + word
            any_bit = any_bit.bitwiseOR(x[i].bitwiseXOR(y[i]))
        differ = differ + F.bit_count(any_bit)
    chance = 2.0**-BITS
    return ((1 - differ / (BANDS * ROWS)) - chance) / (1 - chance)


def lowest(threshold: float) -> float:
    """Estimates below this have a similarity under the threshold (SLACK deviations)."""
    chance = 2.0**-BITS
    agree = threshold * (1 - chance) + chance
    return threshold - SLACK * math.sqrt(agree * (1 - agree) / (BANDS * ROWS)) / (1 - chance)


def _texts_of(nodes: DataFrame, texts: DataFrame, marks: DataFrame) -> DataFrame:
    """node, text of the classes among nodes, each by its representative row or rows equal to it."""
    return texts.join(marks.join(nodes, "node", "left_semi"), ["id", "mark"]).select("node", "text")


def _shingles(size: int):
    """Arrow function: node, text to node, shingle."""

    def run(batches):
        for batch in scan.slices(batches, "text"):
            sets = [shingle_set(np.frombuffer(t.as_buffer(), np.uint8), size) for t in batch.column(1)]
            at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.concatenate(sets).view(np.int64))], ["node", "shingle"])

    return run


def _alone(nodes: DataFrame, texts: DataFrame, marks: DataFrame, size: int) -> DataFrame:
    """node, alone: how many shingles of each of the nodes none of the others has."""
    found = _texts_of(nodes, texts, marks).mapInArrow(_shingles(size), "node binary, shingle long")
    single = found.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
    return single.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))


def _confirm(pairs: DataFrame, texts: DataFrame, marks: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs a, b whose full shingle sets meet the threshold."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    own = _texts_of(needed, texts, marks).dropDuplicates(["node"])
    full = pairs.join(own.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(own.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches):
        for batch in batches:
            cache: dict = {}
            a, b, text_a, text_b = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "text_a", "text_b"))
            keep = []
            for x, t, u in zip(a.to_pylist(), text_a, text_b, strict=True):
                if x not in cache:
                    cache = {x: shingle_set(np.frombuffer(t.as_buffer(), np.uint8), size)}
                other = shingle_set(np.frombuffer(u.as_buffer(), np.uint8), size)
                both = len(np.intersect1d(cache[x], other, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(cache[x]) + len(other) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return full.mapInArrow(run, "a binary, b binary")


def _plausible(member: DataFrame, percent: int) -> DataFrame:
    """Members that some other class of their bucket can be linked with, by size alone.

    Of a class with `most` shingles that others have too and `own` that none has, at most `most`
    are shared with a class that has at least the bucket's smallest `own` (the second smallest,
    for the class that has it), and the union has both classes' own ones besides."""
    member = member.withColumn("own", F.col("size") - F.col("most"))
    # two partial minima a bucket, so a hot bucket is combined before it travels
    least = member.groupBy("bucket").agg(F.min(F.struct("own", "node")).alias("x"))
    other = member.join(least, "bucket").where(F.col("node") != F.col("x.node")).groupBy("bucket").agg(F.min("own").alias("second"))
    near = F.when(F.col("node") == F.col("x.node"), F.col("second")).otherwise(F.col("x.own"))
    kept = member.join(least.join(other, "bucket"), "bucket").where(100 * F.col("most") >= percent * (F.col("most") + F.col("own") + near))
    return kept.drop("own", "x", "second")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """Components of documents whose word-shingle sets have a Jaccard similarity of at least
    percent / 100: one row per row of docs.

    1. Each text gets BANDS band keys and the low BITS bits of its minima. Texts with equal
       shingle sets become one class, known by a 128-bit digest, before anything is paired.
    2. Every class is compared with one pivot of each of its band buckets (the class that
       shares most bucket places), which is linear in the number of classes.
    3. In what that leaves apart, classes that can't be linked with any other of their bucket,
       by the number of shingles that no other class has, are ruled out (an exact bound, linear
       as well). The others are paired with the classes of their buckets that they are not yet
       connected with, unless the corrected bit estimate or the same bound rules the pair out.
       No link is given up, and classes already connected are never paired again.
    Each candidate is confirmed on the full sets. At 0.85 a pair shares no band with a
    probability of 7e-9 (0.80: 3e-6).

    Returns doc_id, mark (xxhash64 of the text), n_shingles, component_id (smallest id
    reachable) and kept (it is that id). Ids are whole numbers or strings of such (others raise
    CAST_INVALID_INPUT). Null or empty texts have no shingles and stay by themselves; a null id
    stays null and kept; rows that repeat an id are judged by their own texts; an empty table
    gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marked = rows.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    signed = written(marked.mapInArrow(_rows(size), "doc_id long, mark long, n_shingles long, set_hash binary, bands array<long>, bits array<long>"))
    # a class is a node by its digest, not by an id, which rows with different texts may share
    classes = written(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy(F.col("set_hash").alias("node")).agg(F.min(F.struct("doc_id", "mark")).alias("r"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
        .select("node", F.col("r.doc_id").alias("rep"), F.col("r.mark").alias("mark"), "size", "bands", "bits")
    )
    places = classes.select("node", F.explode("bands").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    places = written(places.join(shared, "bucket"))
    score = places.groupBy("node").agg(F.sum("n").alias("score"))
    pivots = places.join(score, "node").groupBy("bucket").agg(F.min(F.struct((-F.col("score")).alias("score"), "node")).alias("best")).select("bucket", F.col("best.node").alias("a"))
    bits = classes.select("node", "bits")
    cut = lowest(percent / 100)

    star = places.join(pivots, "bucket").where("node != a").select("a", F.col("node").alias("b")).distinct()
    star = star.join(bits.toDF("b", "bits_b"), "b").join(bits.toDF("a", "bits_a"), "a").where(estimate(F.col("bits_a"), F.col("bits_b")) >= cut).select("a", "b")
    texts, marks = marked.withColumnRenamed("doc_id", "id"), classes.select("node", F.col("rep").alias("id"), "mark")
    links = written(_confirm(star, texts, marks, percent, size))

    first = connected_components(links).toDF("node", "part")
    member = places.join(first, "node", "left").select("bucket", "node", F.coalesce("part", "node").alias("part"))
    parts = member.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("bucket", F.col("top.part").alias("main"))
    apart = written(member.join(largest, "bucket"))
    nodes = apart.select("node").distinct()
    alone = _alone(nodes, texts, marks, size)
    sizes = classes.join(nodes, "node", "left_semi").join(alone, "node", "left").select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("most"))
    sized = written(apart.join(sizes, "node"))
    member = written(_plausible(sized, percent).join(classes.select("node", "bands", "bits"), "node"))
    own = lambda s: [F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("part", "bands", "bits", "size", "most")]]
    x = member.where("part != main").select("bucket", *own("a"))
    y = member.select("bucket", *own("b"), (F.col("part") == F.col("main")).alias("is_main"))
    # two sets share at most what either has in common with anyone
    common = F.least("most_a", "most_b")
    possible = 100 * common >= percent * (F.col("size_a") + F.col("size_b") - common)
    other = (F.col("part_a") != F.col("part_b")) & (F.col("is_main") | (F.col("a") < F.col("b")))
    # of several buckets in common the first one gives the pair
    once = F.array_intersect("bands_a", "bands_b")[0] == F.col("bucket")
    rest = x.join(y, "bucket").where(other & possible & (estimate(F.col("bits_a"), F.col("bits_b")) >= cut) & once)
    rest = rest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    label = connected_components(links.union(_confirm(rest, texts, marks, percent, size))).toDF("node", "part")
    labels = written(classes.select("node", "rep").join(label, "node", "left").select("node", "rep", F.coalesce("part", "node").alias("part")))
    for old in (places, links, apart, sized, member, classes):
        discard(old)
    smallest = labels.groupBy("part").agg(F.min("rep").alias("component_id"))
    out = signed.select("doc_id", "mark", "n_shingles", F.col("set_hash").alias("node")).join(labels.join(smallest, "part").select("node", "component_id"), "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "mark", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """docs with the smallest id of each component only; columns stay."""
    gone = near_dedup(docs, id_col, text_col, percent, size).where(~F.col("kept")).select(F.col("doc_id").alias("_gone_id"), F.col("mark").alias("_gone_mark")).distinct()
    mark = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(gone, (docs[id_col].cast("long") == gone["_gone_id"]) & (mark == gone["_gone_mark"]), "left_anti")
