"""Two ordered lists per document: what was expected against what was found."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents whose lists Python holds at a time.
LISTS = 500


def common_subsequence(a: list, b: list) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence.

    Equal ends are cut off first. The rest is a longest strictly rising chain among the places
    of equal items, each item of a trying b's places from the back, so time goes with the number
    of such pairs and not with the product of the lengths."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    places = defaultdict(list)
    for j in range(len(b) - hi - 1, lo - 1, -1):
        places[b[j]].append(j)
    ends: list[int] = []  # the smallest last place of a chain of each length
    links: list[tuple] = []
    for i in range(lo, len(a) - hi):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[:2])
        link = link[2]
    tail = [(len(a) - k, len(b) - k) for k in range(hi, 0, -1)]
    return [(i, i) for i in range(lo)] + middle[::-1] + tail


_STEPS = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))


@F.arrow_udf(_STEPS)
def _steps(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Places (i, j) of the items of two lists, each once: matches together, others with null."""
    for left, right in batches:
        for at in range(0, len(left), LISTS):
            ends, own, other = [0], [], []
            for a, b in zip(left.slice(at, LISTS).to_pylist(), right.slice(at, LISTS).to_pylist(), strict=True):
                if None in a or None in b:  # a null item matches none
                    a, b = ([(side, n) if x is None else x for n, x in enumerate(items)] for side, items in enumerate((a, b)))
                pairs = common_subsequence(a, b)
                ours, theirs = {i for i, _ in pairs}, {j for _, j in pairs}
                lost, new = [i for i in range(len(a)) if i not in ours], [j for j in range(len(b)) if j not in theirs]
                own += [i for i, _ in pairs] + lost + [None] * len(new)
                other += [j for _, j in pairs] + [None] * len(lost) + new
                ends.append(len(own))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(own, pa.int32()), pa.array(other, pa.int32())], ["i", "j"]))


def aligned(expected: DataFrame, found: DataFrame, key: str, place: str, item: str) -> DataFrame:
    """key, expected_place, found_place, item, state: every row of both lists once, matched rows
    (a longest common subsequence) together; state is match, missing (expected alone) or extra
    (found alone).

    A document's two lists meet in one row; lists are as long as documents. Python sees the items
    of many documents at a time and gives places only. A null item matches none."""
    plain = lambda df, side: df.select(F.col(key).alias("key"), F.lit(side).alias("side"), F.struct(F.col(place).isNull().alias("last"), F.col(place).alias("place"), F.col(item).cast("string").alias("item")).alias("x"))
    side = lambda n: F.array_sort(F.collect_list(F.when(F.col("side") == n, F.col("x"))))
    both = plain(expected, 0).unionByName(plain(found, 1)).groupBy("key").agg(side(0).alias("a"), side(1).alias("b"))
    items = lambda c: F.transform(c, lambda x: x["item"])
    rows = both.select("key", "a", "b", F.explode(_steps(items("a"), items("b"))).alias("s"))
    rows = rows.select("key", F.get("a", F.col("s.i")).alias("a"), F.get("b", F.col("s.j")).alias("b"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("match")
    return rows.select(F.col("key").alias(key), F.col("a.place").alias("expected_place"), F.col("b.place").alias("found_place"), F.coalesce("a.item", "b.item").alias("item"), state.alias("state"))


def gaps(rows: DataFrame, key: str) -> DataFrame:
    """key, side, start, end, n: the runs of aligned rows that lack a counterpart: between two
    matches, everything missing (by expected places) or extra (by found places)."""
    out = None
    for side, state in (("expected_place", "missing"), ("found_place", "extra")):
        w = Window.partitionBy(key).orderBy(side)
        run = F.sum((F.col("state") == "match").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
        mine = rows.where(F.col("state").isin("match", state)).withColumn("_run", run).where(F.col("state") == state)
        part = mine.groupBy(key, "_run").agg(F.min(side).alias("start"), F.max(side).alias("end"), F.count(F.lit(1)).alias("n")).select(key, F.lit(state).alias("side"), "start", "end", "n")
        out = part if out is None else out.union(part)
    return out


def aspect_defects(expected: DataFrame, found: DataFrame, key: str, place: str, most: float = 0.02) -> DataFrame:
    """key, place, defect, error of images in order (key, place, width, height): the n-th found
    against the n-th expected. count_mismatch (once a document, without a place) where the numbers
    differ; missing_or_zero where either has no size; aspect where the ratios of width to height
    differ by more than `most` of the expected one. What one list has beyond the other's end is
    counted only."""
    number = Window.partitionBy(key).orderBy(place)
    side = lambda df, n: df.select(key, F.row_number().over(number).alias("place"), F.struct("width", "height").alias(n))
    both = side(expected, "e").join(side(found, "f"), [key, "place"], "full_outer")
    size = lambda n: F.coalesce((F.col(f"{n}.width") > 0) & (F.col(f"{n}.height") > 0), F.lit(False))
    ratio = lambda n: F.col(f"{n}.width") / F.nullif(F.col(f"{n}.height").cast("double"), F.lit(0.0))
    error = F.abs(ratio("f") - ratio("e")) / F.nullif(ratio("e"), F.lit(0.0))
    paired = both.where("e is not null and f is not null")
    defect = F.when(~(size("e") & size("f")), "missing_or_zero").when(error > most, "aspect")
    rows = paired.select(key, "place", defect.alias("defect"), F.when(defect == "aspect", F.round(error, 4)).alias("error")).where("defect is not null")
    counts = both.groupBy(key).agg(F.count("e").alias("_e"), F.count("f").alias("_f")).where("_e <> _f")
    return rows.union(counts.select(key, F.lit(None).cast("int"), F.lit("count_mismatch"), F.lit(None).cast("double")))


def cut_words(cells: DataFrame, words: Column, room: Column, unit: float) -> DataFrame:
    """cells with word and need of those whose longest word (by display width, `unit` each) needs
    more than the room."""
    from quillmark.functions.text import display_width

    longest = F.array_max(F.transform(words, lambda x: F.struct(display_width(x).alias("width"), x.alias("word"))))
    return cells.withColumn("_l", longest).withColumns({"word": F.col("_l.word"), "need": F.col("_l.width") * unit}).drop("_l").where(F.col("need") > room)


def page_defects(pages: DataFrame, key: str, page: str, rules: Column, caption: Column, bottom: Column, body_bottom: Column, most_gap: float, spill_rules: int = 3) -> DataFrame:
    """key, page, defect: table_spill (rules of a table, but no caption on the page: it began on
    the one before) and gap (more than most_gap left empty at the bottom, but for the last page)."""
    last = F.lead(page).over(Window.partitionBy(key).orderBy(page)).isNull()
    found = F.array_compact(F.array(F.when(~caption & (rules >= spill_rules), "table_spill"), F.when(~last & (body_bottom - bottom > most_gap), "gap")))
    return pages.withColumn("_found", found).select(key, page, F.explode("_found").alias("defect"))
