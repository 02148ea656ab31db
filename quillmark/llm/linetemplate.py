"""Line dedup: a fixed-depth log-template tree over the lines of all texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import scan
from quillmark.llm.anchored import NO_ID, texts_of
from quillmark.llm.storage import written

#: Leading tokens of the tree's inner levels.
DEPTH = 3
#: Share of equal tokens from which a line joins a template.
SIMILAR = 0.7
#: Distinct lines of a leaf from which it is first clustered in parts.
LEAF_LINES = 2000
MIN_PLACES = 5
WILD = b"<*>"

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_WILD_HASH, _START, _END = (np.uint64(x) for x in (0xA5A5A5A5DEADBEEF, 0x1234567, 0x7654321))


def _fold(values: np.ndarray, start: np.ndarray, count: np.ndarray, limit: int | None = None) -> np.ndarray:
    """A hash of values[start : start + count] (of the first `limit` at most), and of count."""
    n = count if limit is None else np.minimum(count, limit)
    at = scan.ragged(start, n)
    place = scan.ragged(np.zeros(len(n), np.int64), n).astype(np.uint64)
    mixed = scan.mix(values[at] + place * np.uint64(scan.BASE))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    ends = np.cumsum(n)
    return scan.mix(total[ends] - total[ends - n] + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C55))


def parse(buf: np.ndarray, bounds: np.ndarray):
    """(text, line number in it, leaf, line, surroundings, content, token starts,
    token ends, first token, tokens, wild flags) of the lines that have a token.

    Tokens with a digit are variable fields and hash alike; a line that is mostly such tokens
    has no variable fields and is a leaf of its own. A line's surroundings are the
    lines with tokens before and after it in its text."""
    start, end, first = scan.words(buf, bounds, scan.NOT_SPACE)
    hashes = scan.span_hashes(buf, start, end)
    exact = hashes.copy()
    digits = np.concatenate(([0], np.cumsum(_DIGIT[buf], dtype=np.int64)))
    wild = digits[end] > digits[start]
    breaks = np.concatenate(([0], np.cumsum(buf == 10, dtype=np.int64)))
    text = np.searchsorted(first, np.arange(len(start)), side="right") - 1
    number = breaks[start] - breaks[bounds[text]]
    new = np.ones(len(start), bool)
    new[1:] = (text[1:] != text[:-1]) | (number[1:] != number[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(start)))
    varying = np.concatenate(([0], np.cumsum(wild, dtype=np.int64)))
    mostly = 2 * (varying[head + count] - varying[head]) > count
    wild &= ~np.repeat(mostly, count)
    hashes[wild] = _WILD_HASH
    line = _fold(hashes, head, count)
    own = text[head]
    before, after = np.full(len(head), _START), np.full(len(head), _END)
    same, whole = own[1:] == own[:-1], _fold(exact, head, count)
    before[1:][same] = whole[:-1][same]
    after[:-1][same] = whole[1:][same]
    around = scan.mix(before * np.uint64(3) + scan.mix(after))
    leaf = np.where(mostly, line, _fold(hashes, head, count, DEPTH))
    return own, number[head], leaf, line, around, whole, start, end, head, count, wild


def _contents(text: np.ndarray, whole: np.ndarray, count: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Exclusive or of each text's distinct lines, and their tokens in all."""
    by = np.lexsort((whole, text))
    new = np.ones(len(by), bool)
    new[1:] = (text[by][1:] != text[by][:-1]) | (whole[by][1:] != whole[by][:-1])
    by = by[new]
    total, size = np.zeros(texts, np.uint64), np.zeros(texts, np.int64)
    np.bitwise_xor.at(total, text[by], whole[by])
    np.add.at(size, text[by], count[by])
    return total, size


KEYS = ["doc_id", "mark", "number", "leaf", "line", "around", "whole", "n", "total", "size"]


def _keys(batches):
    for batch, buf, bounds in scan.pieces(batches, "text"):
        text, number, leaf, line, around, whole, _, _, _, count, _ = parse(buf, bounds)
        total, size = _contents(text, whole, count, batch.num_rows)
        doc, mark = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[text] for c in ("doc_id", "mark"))
        columns = [doc, mark, number, leaf.view(np.int64), line.view(np.int64), around.view(np.int64), whole.view(np.int64), count, total.view(np.int64)[text], size[text]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], KEYS)


def _tokens(batches):
    """Each distinct line of a slice with its tokens, variable fields as WILD."""
    for _, buf, bounds in scan.pieces(batches, "text"):
        _, _, _, line, _, _, start, end, head, count, wild = parse(buf, bounds)
        names, at = np.unique(line, return_index=True)
        raw, out = buf.tobytes(), []
        for i in at.tolist():
            words = slice(head[i], head[i] + count[i])
            out.append(b" ".join(WILD if w else raw[s:e] for s, e, w in zip(start[words].tolist(), end[words].tolist(), wild[words].tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(out, pa.binary())], ["line", "tokens"])


def cluster(lines: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
    """(line, template's first line, template) of a leaf's lines, which have equally many
    tokens. Lines come in the order of their tokens; each joins the template it shares most
    tokens with, the earliest of equals, if that is at least SIMILAR of them, and what differs
    there becomes variable.

    The places at which lines differ are cut into one range more than a line may differ in, so
    a line and its template agree on a range: templates are looked up by those."""
    if not lines:
        return
    rows = sorted(((t.split(b" "), t, line) for line, t in lines), key=lambda x: x[1:])
    count = len(rows[0][0])
    free = [i for i in range(count) if any(r[0][i] != rows[0][0][i] for r in rows)]
    differ = sum(k < SIMILAR * count for k in range(count + 1))  # how many counts of equal tokens are too few
    ranges = count - differ + 1
    cuts = [free[len(free) * k // ranges : len(free) * (k + 1) // ranges] for k in range(ranges)] if len(free) >= ranges else [[]]
    templates: list[tuple[int, list]] = []
    known: dict[tuple, dict[int, None]] = {}
    joined = []
    for words, _, line in rows:
        keys = [(k, *(words[i] for i in cut)) for k, cut in enumerate(cuts)]
        best, most = None, 0
        for k in sorted({k for key in keys for k in known.get(key, ())}):
            same = sum(map(bytes.__eq__, words, templates[k][1]))
            if same > most:
                best, most = k, same
        if best is None or most < SIMILAR * count:
            best = len(templates)
            templates.append((line, words))
        else:
            pattern = templates[best][1]
            pattern[:] = [p if p == w else WILD for p, w in zip(pattern, words, strict=True)]
            keys = [(k, *(pattern[i] for i in cut)) for k, cut in enumerate(cuts)]
        for key in keys:
            known.setdefault(key, {})[best] = None
        joined.append((line, best))
    for line, k in joined:
        yield line, templates[k][0], b" ".join(templates[k][1])


_CLUSTERED = "leaf long, line long, template long, pattern binary, parts long"


def _leaves(batches):
    """Arrow function: distinct lines, those of a part of a leaf one after the other, to their
    templates."""
    now, group, out = None, [], []

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 3, pa.binary(), pa.int64()), strict=True)], ["leaf", "line", "template", "pattern", "parts"])

    for batch in batches:
        for *key, line, tokens in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("leaf", "part", "parts", "line", "tokens")), strict=True):
            if key != now:
                out += ((now[0], *x, now[2]) for x in cluster(group))
                now, group = key, []
            group.append((line, tokens))
        if len(out) > 10_000:
            yield batch_of(out)
            out = []
    out += ((now[0], *x, now[2]) for x in cluster(group))
    if out:
        yield batch_of(out)


def _clustered(lines: DataFrame) -> DataFrame:
    """Templates of (leaf, part, parts, line, tokens), each part by itself."""
    return written(lines.repartition("leaf", "part").sortWithinPartitions("leaf", "part").mapInArrow(_leaves, _CLUSTERED))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_places: int = MIN_PLACES, leaf_lines: int = LEAF_LINES) -> tuple[DataFrame, DataFrame]:
    """(lines with their template and place, those of recurring templates among others;
    templates that recur)."""
    texts = texts_of(docs, id_col, text_col)
    keys = written(texts.mapInArrow(_keys, ", ".join(f"{c} long" for c in KEYS)))

    # a leaf with few different surroundings and texts has no template with more of them
    places = keys.groupBy("leaf", "around", "total").agg(F.lit(1)).groupBy("leaf").agg(F.count(F.lit(1)).alias("places")).where(F.col("places") >= min_places)
    lines = written(keys.groupBy("leaf", "line").agg(F.lit(1)).join(places.select("leaf"), "leaf").select("leaf", "line"))
    parts = lines.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / leaf_lines).alias("parts"))
    sized = lines.join(parts, "leaf").withColumn("part", F.pmod("line", "parts"))
    tokens = texts.mapInArrow(_tokens, "line long, tokens binary")
    # texts are dealt out at every size alike, rather than the other side broadcast while it is small
    leaves = tokens.hint("merge").join(sized, "line").groupBy("leaf", "part", "parts", "line").agg(F.min("tokens").alias("tokens"))
    first = _clustered(leaves)
    # the templates of a leaf's parts are lines that are clustered again, all of the leaf
    found = first.where("parts > 1").groupBy("leaf", F.col("template").alias("line")).agg(F.min("pattern").alias("tokens"))
    second = _clustered(found.select("leaf", F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("parts"), "line", "tokens"))
    merged = first.where("parts > 1").select("line", F.col("template").alias("first")).join(second.select(F.col("line").alias("first"), "template", "pattern"), "first")
    templates = first.where("parts = 1").select("line", "template", "pattern").union(merged.select("line", "template", "pattern"))

    # a template with more variable than fixed tokens names nothing: its lines stand for themselves
    words = F.split(F.decode("pattern", "UTF-8"), " ")
    fixed = 2 * F.size(F.filter(words, lambda t: t != WILD.decode())) >= F.size(words)
    templates = templates.select("line", F.when(fixed, F.col("template")).otherwise(F.col("line")).alias("template"))
    found = written(keys.join(templates, "line").drop("leaf"))
    return found, _recurring(found, min_places)


def _recurring(found: DataFrame, min_places: int) -> DataFrame:
    """Templates that recur, of the occurrences of all."""

    def counted(rows: DataFrame, what: str) -> DataFrame:
        return rows.groupBy("template").agg(F.count(F.lit(1)).alias(what)).where(F.col(what) >= min_places)

    around = counted(found.select("template", "around").distinct(), "places")
    own = counted(found.select("template", "doc_id", "total").distinct(), "rows")
    held = found.select("template", "total").distinct()
    texts = counted(held, "texts")
    often = around.join(own, "template").where(2 * F.col("places") >= F.col("rows")).select("template")
    # what a text has beside lines that many texts have, for texts that are mostly that
    common = found.select("template", "total", "size", "whole", "n").join(texts.select("template"), "template")
    part = common.select("total", "size", "whole", "n").distinct().groupBy("total", "size").agg(F.bit_xor("whole").alias("shared"), F.sum("n").alias("n"))
    rest = part.where(2 * F.col("n") <= F.col("size")).select("total", F.col("total").bitwiseXOR(F.col("shared")).alias("rest"))
    apart = counted(common.select("template", "total").distinct().join(rest, "total").select("template", "rest").distinct(), "places")
    return often.union(apart.select("template")).distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_places: int = MIN_PLACES, leaf_lines: int = LEAF_LINES) -> DataFrame:
    """Drops lines whose template recurs across documents: docs with its text without them, and
    the columns n_lines and n_dropped.

    The tree's levels are a line's number of tokens and its leading tokens, tokens with a digit
    being variable; a leaf's lines are clustered into templates, in which what differs becomes
    variable as well. A template recurs if at least min_places texts have it and either
    at least min_places texts with different rests do that consist of their rest by half or
    more, a rest being the lines whose templates fewer than min_places texts have; or it has
    min_places different surroundings (lines before and after) and half as many surroundings
    as texts. So copies neither add to a line nor protect it from what else has it, and near
    copies, whose rest is small, keep their lines for near-dedup. At least half of a
    template's tokens are fixed; other lines are held exactly. A leaf
    with more than leaf_lines distinct lines is clustered in parts and then the parts' templates. Equal lines are known by a 64-bit hash.

    Lines end at line feeds; blank lines stay. Null texts stay null with no lines; empty texts
    have one line; ids may be null or repeated; an empty table gives no rows; columns of docs
    named n_lines or n_dropped are replaced, others are carried on.
    """
    found, again = recurring_lines(docs, id_col, text_col, min_places, leaf_lines)
    gone = found.join(again, "template").groupBy("doc_id", "mark").agg(F.collect_list("number").alias("numbers"))
    carried = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    whole = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("mark"), F.struct(*carried).alias("row"))
    rows = F.split(F.col("row")[text_col], "\n", -1)
    kept = F.filter(rows, lambda x, i: ~F.array_contains("numbers", i.cast("long")))
    dropped = F.size(rows) - F.size(kept)
    text = F.when(F.col("numbers").isNull(), F.col("row")[text_col]).otherwise(F.array_join(kept, "\n"))
    out = whole.hint("merge").join(gone, ["doc_id", "mark"], "left")
    return out.select(
        *[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in carried],
        F.when(F.col("row")[text_col].isNull(), 0).otherwise(F.size(rows)).cast("long").alias("n_lines"),
        F.when(F.col("numbers").isNull(), 0).otherwise(dropped).cast("long").alias("n_dropped"),
    )


