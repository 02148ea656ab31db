"""Source divergence audit: exact differences between the sources of a language, by systolic rotation."""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm import scan
from quillmark.llm.storage import written

MIN_DOCS = 3
TOP = 200
#: Shares are counted in parts of a thousand million; computed in three steps of a thousand, so
#: that no product leaves 64 bits for languages of up to 9 * 10^15 occurrences.
STEPS, STEP = 3, 1000
#: Terms of a shard of a language's vocabulary: what one vector may hold.
SHARD_TERMS = 1 << 14
#: Rounds of a tournament per job: a vector travels to half as many others at a time.
ROUNDS = 32
#: Languages (a name and two numbers each) that are broadcast at most.
MOST_LANGS = 10_000
#: Distinct terms a task holds before it hands their counts on.
HELD = 200_000

_TABLE = bytes(0x20 if c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if c < 0x5B else c for c in range(256))
_CELL = "lang string, source string, shard long, vector binary, terms array<struct<term string, value long>>"


def count_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that have it) over all whole texts."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]

    def flush(total: dict[tuple, Counter], rows: dict[tuple, Counter]):
        for (lang, source), n in total.items():
            seen = rows[lang, source]
            yield pa.RecordBatch.from_arrays(
                [*(pa.repeat(pa.scalar(x, pa.string()), len(n)) for x in (lang, source)), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([seen[t] for t in n], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        total.clear()
        rows.clear()

    def run(batches):
        total: dict[tuple, Counter] = {}
        rows: dict[tuple, Counter] = {}
        for part in scan.slices(batches, "text"):
            for lang, source, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                terms = text.encode().translate(_TABLE).split()
                if (lang, source) not in total:
                    total[lang, source], rows[lang, source] = Counter(), Counter()
                # lists and sets are counted in C, mappings aren't
                total[lang, source].update(terms)
                rows[lang, source].update(set(terms))
            if sum(len(n) for n in total.values()) > HELD:
                yield from flush(total, rows)
        yield from flush(total, rows)

    counted = docs.select(*named).where("text <> ''").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / total) in whole numbers."""
    rest = count.astype(np.int64) + 1
    out = rest // total
    rest %= total
    for _ in range(STEPS):
        rest *= STEP
        out = out * STEP + rest // total
        rest %= total
    return out + 1


def weights(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def pack(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending ids and their counts: gaps and counts byte plane by byte plane, by zstandard."""
    if not len(ids):
        return bytes(4)
    planes = [np.diff(ids, prepend=-1).astype("<u4"), counts.astype("<i8")]
    raw = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in planes)
    return len(ids).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(vector: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(vector[:4], "little") if vector else 0
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    raw = np.frombuffer(pa.decompress(vector[4:], 12 * n, "zstd", asbytes=True), np.uint8)
    gaps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(gaps.astype(np.int64)) - 1, np.ascontiguousarray(raw[4 * n :].reshape(8, n).T).view("<i8").ravel()


def meet(own: tuple, own_total: int, peer: tuple, peer_total: int, terms: int) -> tuple[int, int]:
    """Sums over a shard's `terms` terms: of the first vector against the second, and the other
    way round. Terms that neither has are counted at once."""
    ids = np.union1d(own[0], peer[0])
    p, q = (np.zeros(len(ids), np.int64) for _ in range(2))
    p[np.searchsorted(ids, own[0])] = own[1]
    q[np.searchsorted(ids, peer[0])] = peer[1]
    # one more entry for a term that neither has
    p, q = shares(np.append(p, 0), own_total), shares(np.append(q, 0), peer_total)
    there, back = weights(p, q), weights(q, p)
    absent = terms - len(ids)
    return int(there[:-1].sum() + absent * there[-1]), int(back[:-1].sum() + absent * back[-1])


def opponent(place: Column, turn: Column, players: Column) -> Column:
    """Whom a player (from 0) of an even number of players meets in a turn: all but the last
    stand in a circle and meet where their places sum up to the turn; who would meet itself
    meets the last."""
    circle = players - 1
    facing = F.pmod(turn - place, circle)
    return F.when(place == circle, F.pmod(turn * (players / 2).cast("bigint"), circle)).otherwise(F.when(facing == place, circle).otherwise(facing))


def _cells(batches_of, top: int):
    """One resident cell of a group and shard: its vector, and its best terms on a local heap."""

    def run(key, table):
        ids, n, usual = (table.column(c).to_numpy() for c in ("id", "n", "lang_n"))
        order = np.argsort(ids)
        total, lang_total = table.column("total")[0].as_py(), table.column("lang_total")[0].as_py()
        p, q = shares(n, total), shares(usual, lang_total)
        up = np.flatnonzero(p > q)
        value = weights(p[up], q[up])
        if len(up) > top:  # all ties of the last place stay for the heap
            least = np.partition(value, len(value) - top)[len(value) - top]
            up, value = up[value >= least], value[value >= least]
        named = zip(value.tolist(), table.column("term").take(pa.array(up)).to_pylist(), strict=True)
        best = heapq.nsmallest(top, ((-v, t.encode()) for v, t in named))
        return pa.Table.from_arrays(
            [
                *(table.column(c).slice(0, 1) for c in ("lang", "source", "shard")),
                pa.array([pack(ids[order], n[order])], pa.binary()),
                pa.array([[{"term": t.decode(), "value": -v} for v, t in best]], pa.list_(pa.struct([("term", pa.string()), ("value", pa.int64())]))),
            ],
            ["lang", "source", "shard", "vector", "terms"],
        )

    return batches_of.applyInArrow(run, _CELL)


def _evaluate(batches):
    """Rows of a partition in order: each resident cell, then the peers that visit it."""
    names = ["lang", "source", "item", "value"]
    own = at = None
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            here = (r["lang"], r["shard"], r["place"])
            if not r["visits"]:
                own, at = (unpack(r["vector"]), r["source"], r["total"]), here
                continue
            if at != here:
                raise ValueError("a visit without a resident")
            there, back = meet(own[0], own[2], unpack(r["vector"]), r["total"], r["terms"]) if r["terms"] else (0, 0)
            rows += [(r["lang"], own[1], r["source"], there), (r["lang"], r["source"], own[1], back)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)


def audit_sources(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP, shard_terms: int = SHARD_TERMS, rounds: int = ROUNDS) -> DataFrame:
    """How the sources of each language differ: lang, source, part, item, value, rank.

    A language keeps the terms of at least min_docs of its rows; a share is
    1 + floor(10^9 * (count + 1) / (sum of counts + kept terms)), a weight floor((p - q)^2 / q)
    with p the source's share. Part `pair`: item is each other source of the language, value
    the sum of weights against its shares over all kept terms. Part `term`: item is a term the
    source has above its language's share, value its weight against that; the first `top` only.
    Ranks order by value, then by the item's UTF-8 bytes. All arithmetic is in whole numbers.

    The vocabulary of a language is split into shards of about shard_terms, so a vector is bounded
    however large source and language are. A source's vectors stay in the partition of their cell
    (language, shard, source); compressed copies travel to the cells of their opponents in the
    rounds of a round-robin tournament, `rounds` of them a job, and each meeting is evaluated in
    both directions, so one of the two travels (in turn the earlier and the later one). Sums of
    shards are added up afterwards. Local heaps leave `top` terms of each cell to be ranked.

    Null text, lang and source count as empty; a source without terms, or a language that keeps
    none, has its rows of `pair` all the same; rows that repeat an id are rows; an empty table
    gives no rows; other columns are ignored.
    """
    counts = written(count_terms(docs, lang_col, source_col, text_col))
    groups = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_sum"), F.count(F.lit(1)).alias("kept"))
    shards = F.ceil(F.col("kept") / shard_terms).cast("bigint")
    # ids within a shard, which is as large as shard_terms allows. A join that shuffles would deal
    # the terms by language alone; languages are sent to all tasks if they are as few as they should be
    in_shard = Window.partitionBy("lang", "shard")
    langs = written(langs)
    few = langs.limit(MOST_LANGS + 1).count() <= MOST_LANGS
    terms = (kept.join(F.broadcast(langs), "lang") if few else kept.join(langs, "lang").repartition("lang", "term")).withColumn("shard", F.pmod(F.xxhash64("term"), shards))
    terms = written(terms.select("lang", "term", "lang_n", "shard", (F.row_number().over(in_shard.orderBy("term")) - 1).cast("bigint").alias("id")))
    sizes = written(terms.groupBy("lang", "shard").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_n")))
    langs = sizes.groupBy("lang").agg(F.sum("lang_n").alias("lang_sum"), F.sum("terms").alias("kept"))
    rows = written(counts.join(terms, ["lang", "term"]).select("lang", "source", "shard", "id", "term", "n", "lang_n"))
    sums = rows.groupBy("lang", "source").agg(F.sum("n").alias("source_sum"))
    by_lang = Window.partitionBy("lang")
    players = F.col("sources") + F.col("sources") % 2
    groups = written(
        groups.join(sums, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select(
            "lang",
            "source",
            (F.coalesce("source_sum", F.lit(0)) + F.coalesce("kept", F.lit(0))).alias("total"),
            (F.coalesce("lang_sum", F.lit(0)) + F.coalesce("kept", F.lit(0))).alias("lang_total"),
            (F.row_number().over(by_lang.orderBy("source")) - 1).cast("bigint").alias("place"),
            F.count(F.lit(1)).over(by_lang).alias("sources"),
        )
        .withColumn("players", players)
    )
    ready = rows.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    cells = written(_cells(ready.groupBy("lang", "source", "shard"), top))
    # every group has a cell in each shard, and one without terms where its language keeps none
    spots = groups.join(sizes.select("lang", "shard", "terms"), "lang", "left").select("lang", "source", "total", "place", "sources", "players", F.coalesce("shard", F.lit(0)).alias("shard"), F.coalesce("terms", F.lit(0)).alias("terms"))
    residents = written(spots.join(cells.drop("terms"), ["lang", "source", "shard"], "left"))
    turns = groups.agg(F.max("players")).head()[0] or 0
    sums = None
    for first in range(0, turns - 1, rounds):
        turn = F.explode(F.sequence(F.lit(first).cast("bigint"), F.least(F.lit(first + rounds), F.col("players") - 1) - 1))
        travel = residents.where((F.col("sources") > 1) & (F.col("players") - 1 > first)).withColumn("turn", turn)
        travel = travel.withColumn("other", opponent(F.col("place"), F.col("turn"), F.col("players"))).where("other < sources")
        # of two, the earlier one visits where their sum is even, else the later one
        travel = travel.where(F.when((F.col("place") + F.col("other")) % 2 == 0, F.col("place") < F.col("other")).otherwise(F.col("place") > F.col("other")))
        visits = travel.select("lang", "shard", F.col("other").alias("place"), "source", "total", "terms", "vector", F.lit(1).alias("visits"))
        at_home = residents.select("lang", "shard", "place", "source", "total", "terms", "vector", F.lit(0).alias("visits"))
        dealt = at_home.union(visits).repartition("lang", "shard", "place").sortWithinPartitions("lang", "shard", "place", "visits")
        met = dealt.mapInArrow(_evaluate, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        sums = met if sums is None else sums.union(written(met))
    named = cells.select("lang", "source", F.explode("terms").alias("t")).select("lang", "source", F.lit("term").alias("part"), F.col("t.term").alias("item"), F.col("t.value").alias("value"))
    every = named if sums is None else named.union(sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = every.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
