"""Spelling variant grouping: words within one letter of each other, found by anagram hashing."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import scan
from quillmark.llm.storage import discard, written

MIN_LENGTH = 6
MIN_COUNT = 5
#: A word's form is at least this many times as frequent.
RATIO = 5
#: One occurrence in so many (by its hash) loses a letter before it is counted; 0 for none.
NOISE = 199
#: Words are runs of A-Z, a-z and U+00C0-U+00FF, one byte each in Latin-1.
LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]
#: Keys are sums of fifth powers of code points, modulo a prime so that no length overflows.
POWER, PRIME = 5, (1 << 61) - 1
#: Distinct words a task holds before it hands their counts on.
HELD = 200_000

_TABLE = bytes((c + 32 if c < 0x5B else c) if c in LETTERS else 0x20 for c in range(256))
_STEP = np.uint64(scan.BASE)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """word, n: occurrences over all whole texts, A-Z lower-cased.

    With noise, an occurrence whose crc32 of `<id>:<word>` is a multiple of it loses the code
    point at that crc32 modulo the length. Each task sums its words before the shuffle, and
    Spark sums the tasks' rows, so a frequent word sends one row per task and HELD words.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def flush(total: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
        total.clear()
        return out

    def run(batches):
        total: Counter = Counter()
        for part in scan.slices(batches, "text"):
            for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{name}:".encode())
                for word, n in Counter(text.encode("latin-1", "replace").translate(_TABLE).split()).items():
                    size = len(word)
                    if size < min_length:  # a deletion only shortens it
                        continue
                    if noise:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if h % noise == 0:
                            at = h % size
                            word = word[:at] + word[at + 1 :]
                            if size == min_length:
                                continue
                    total[word] += n
            if len(total) > HELD:
                yield flush(total)
        if total:
            yield flush(total)

    counted = texts.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def letter_value(letter: Column) -> Column:
    code = F.ascii(letter).cast("bigint")
    value = code
    for _ in range(POWER - 1):
        value = value * code
    return value % PRIME


def anagram_key(letters: Column) -> Column:
    """Sum of the letters' values: the same for every order of the letters."""
    return F.aggregate(letters, F.lit(0).cast("bigint"), lambda total, c: (total + letter_value(c)) % PRIME)


def _less(key: Column, letter: Column) -> Column:
    return (key - letter_value(letter) + PRIME) % PRIME


def keyed(words: DataFrame) -> DataFrame:
    """words (word, n) with place (an id), key and the sorted distinct letters; written, so that
    places are fixed."""
    chars = F.filter(F.split("word", ""), lambda c: c != "")
    return written(words.select(F.monotonically_increasing_id().alias("place"), "word", "n", anagram_key(chars).alias("key"), F.array_sort(F.array_distinct(chars)).alias("letters")))


def linked_classes(words: DataFrame) -> DataFrame:
    """Anagram classes (key, letters) that another class's key meets, with the letters they meet
    by: removals (letter, rest, by_exchange, by_removal).

    A removal of c leads from key K to K - v(c). Where that is a class's key, the two classes
    differ by that letter's addition; where K - v(c) = L - v(d), by the exchange value
    v(c) - v(d). Classes stand for all words of their letters here, so a class of thousands of
    anagrams is one row, and a rest has at most as many rows as there are letters, but for
    collisions of sums.
    """
    classes = words.groupBy("key", "letters").agg(F.count(F.lit(1)).alias("members")).drop("members")
    removed = classes.select("key", "letters", F.explode("letters").alias("letter")).withColumn("rest", _less(F.col("key"), F.col("letter")))
    meets = (
        removed.select("rest", F.col("key").alias("from_key"))
        .union(classes.select(F.col("key").alias("rest"), F.lit(None).cast("bigint").alias("from_key")))
        .groupBy("rest")
        .agg((F.min("from_key") < F.max("from_key")).alias("by_exchange"), (F.count(F.lit(1)) > F.count("from_key")).alias("by_removal"))
        .where("by_exchange or (by_removal and by_exchange is not null)")
    )
    found = removed.join(meets, "rest")
    return found.groupBy("key", "letters").agg(F.collect_list(F.struct("letter", "rest", "by_exchange", "by_removal")).alias("removals"))


def _hashes(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of whole words, and of each word without the letter at each position."""
    size = np.diff(bounds)
    at = np.arange(len(buf)) - np.repeat(bounds[:-1], size)
    sums = []
    for place in (at, at - 1):  # letters before the gap keep their place, those after move up
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(scan.mix(buf.astype(np.uint64) + place.astype(np.uint64) * _STEP), out=out[1:])
        sums.append(out)
    keep, moved = sums
    lo, hi = np.repeat(bounds[:-1], size), np.repeat(bounds[1:], size)
    j = np.arange(len(buf))
    rest = keep[j] - keep[lo] + moved[hi] - moved[j + 1]
    return scan.mix(keep[bounds[1:]] - keep[bounds[:-1]]).view(np.int64), scan.mix(rest).view(np.int64)


def _orders(batches):
    """Rows (place, kind, rest, at, size, hash): 'word' for each word itself, 'exchange' and
    'removal' for what is left of it without a letter by which its class is linked."""
    names = ["place", "kind", "rest", "at", "size", "hash"]
    for batch in scan.slices(batches, "word", scan.SEGMENT // 4):
        col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        raw = [w.encode("latin-1") for w in col["word"].to_pylist()]
        buf = np.frombuffer(b"".join(raw), np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(w) for w in raw]))).astype(np.int64)
        place, key = col["place"].to_numpy(), col["key"].to_numpy()
        whole, rest = _hashes(buf, bounds)
        size = np.diff(bounds)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (place, np.full(len(raw), 0, np.int8), key, np.zeros(len(raw), np.int32), size, whole)], names)
        exchange, removal = np.zeros((len(raw), 256), bool), np.zeros((len(raw), 256), bool)
        keys = np.zeros((len(raw), 256), np.int64)
        for i, removals in enumerate(col["removals"].to_pylist()):
            for r in removals or ():
                c = ord(r["letter"])
                keys[i, c], exchange[i, c], removal[i, c] = r["rest"], r["by_exchange"], r["by_removal"]
        of = np.repeat(np.arange(len(raw)), size)
        at = np.arange(len(buf)) - bounds[of]
        # of a run of one letter, any removal leaves the same
        first = np.ones(len(buf), bool)
        first[1:] = (buf[1:] != buf[:-1]) | (at[1:] == 0)
        for kind, flag in ((1, exchange[of, buf]), (2, removal[of, buf] & first)):
            j = np.flatnonzero(flag)
            if len(j):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (place[of[j]], np.full(len(j), kind, np.int8), keys[of[j], buf[j]], at[j].astype(np.int32), size[of[j]], rest[j])], names)


def near_words(words: DataFrame) -> DataFrame:
    """Pairs x, y (places of keyed words) that differ by exactly one inserted, deleted or
    replaced code point, in both directions, each pair of a direction once.

    Classes are joined by key first; only letters by which a class is linked are then taken out
    of its words, and what is left, in order, is joined: equal positions for a replacement,
    whole words for an insertion. Words that share a rest at a position differ in that letter
    alone, so such a group has as many members as there are letters at most; no pairs of
    anagrams are formed. Hashes propose; the letters themselves decide.
    """
    classes = written(linked_classes(words))
    joined = words.join(classes, ["key", "letters"], "inner").select("place", "word", "key", "removals")
    # a word whose class has no linked removal can still be the shorter of two
    alone = words.join(classes, ["key", "letters"], "left_anti").select("place", "word", "key", F.lit(None).cast(joined.schema["removals"].dataType).alias("removals"))
    rows = written(joined.unionByName(alone).mapInArrow(_orders, "place long, kind byte, rest long, at int, size long, hash long"))
    kind = lambda k: rows.where(F.col("kind") == k).drop("kind")
    a, b = kind(1).alias("a"), kind(1).alias("b")
    same = (F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("rest", "at", "size", "hash"))
    on = F.col("a.place") != F.col("b.place")
    for c in same:
        on = on & c
    replaced = a.join(b, on).select(F.col("a.place").alias("x"), F.col("b.place").alias("y"), F.col("a.at").alias("at"), F.lit(0).alias("longer"))
    long, short = kind(2).alias("a"), kind(0).alias("b")
    inserted = long.join(short, (F.col("a.rest") == F.col("b.rest")) & (F.col("a.hash") == F.col("b.hash")) & (F.col("a.size") == F.col("b.size") + 1))
    inserted = inserted.select(F.col("a.place").alias("x"), F.col("b.place").alias("y"), F.col("a.at").alias("at"), F.lit(1).alias("longer"))
    mirrored = inserted.select(F.col("y").alias("x"), F.col("x").alias("y"), "at", F.lit(-1).alias("longer"))
    pairs = replaced.union(inserted).union(mirrored)
    left = words.select(F.col("place").alias("x"), F.col("word").alias("x_word"))
    right = words.select(F.col("place").alias("y"), F.col("word").alias("y_word"), F.col("n").alias("y_n"))
    both = pairs.join(left, "x").join(right, "y")
    # what follows the letter that is one word's alone, or differs
    tail = lambda word, own: F.expr(f"substring({word}, at + 1 + {own})")
    agree = (F.expr("left(x_word, at) = left(y_word, at)")) & (
        tail("x_word", "if(longer >= 0, 1, 0)") == tail("y_word", "if(longer <= 0, 1, 0)")
    )
    return both.where(agree & (F.col("x_word") != F.col("y_word"))).select("x", "y", "y_word", "y_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain of forms. A form is RATIO times as frequent, so chains
    are short; each round halves what is left of them."""
    roots = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(roots)
        roots = after
        if not roots.where("moved").take(1):
            return roots.drop("moved")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words with their counts (word, n).

    form is the nearest in spelling with the largest n (ties: smallest in code-point order) if
    that is at least ratio times the word's, else null; root follows forms to the last. Words
    hold letters up to U+00FF only. An empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word, or chains have no end")
    words = keyed(words.select("word", F.col("n").cast("bigint").alias("n")))
    best = near_words(words).groupBy("x").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("y_n")).alias("m"), F.col("y_word").alias("word"))).alias("best"))
    found = words.join(best.withColumnRenamed("x", "place"), "place", "left")
    chosen = -F.col("best.m") >= ratio * F.col("n")
    found = written(
        found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(chosen, F.col("best.word")).alias("form"), F.when(chosen, -F.col("best.m")).alias("form_n"))
    )
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, noise: int = NOISE) -> DataFrame:
    """Spelling variants among the words of whole texts; see count_words and group_variants.

    Null and empty texts have no words, a null id counts as an empty one, rows that repeat an id
    count as rows; other columns of docs are ignored, so their names can't clash. A run of
    letters of any length is a word. Word counts are summed before the shuffle, everything
    after works on distinct words.
    """
    return group_variants(count_words(docs, id_col, text_col, min_length, min_count, noise), ratio)
