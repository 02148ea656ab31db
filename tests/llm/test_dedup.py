"""Exact, substring, suffix-array and near-duplicate operators against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from quillmark.llm import anchored, exact, minhash, suffixarray, suffixtree

from .fixtures import documents, empty, frame


def brute_substring(rows, size):
    words = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    low = {}
    for i, w in words:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            low[key] = min(low.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - size + 1):
            if low[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def brute_bytes(rows, size):
    raw = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(b[k : k + size] for _, b in raw for k in range(len(b) - size + 1))
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for k in range(len(b) - size + 1):
            if n[b[k : k + size]] > 1:
                gone[k : k + size] = [True] * size
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize(("seed", "blocks"), [(1, 2048), (2, 1), (3, 3)])
def test_substring_dedup(spark, seed, blocks):
    rows = documents(seed)
    got = suffixtree.substring_dedup(frame(spark, rows).repartition(3), window=20, prefix=6, class_blocks=blocks).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute_substring(rows, 20)


@pytest.mark.parametrize(("seed", "blocks"), [(1, 2048), (2, 1), (4, 3)])
def test_suffix_array_dedup(spark, seed, blocks):
    rows = documents(seed)
    got = suffixarray.suffix_array_dedup(frame(spark, rows).repartition(3), window=60, core=16, class_blocks=blocks).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == brute_bytes(rows, 60)


def test_spans_of_edges(spark):
    odd = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, None), (8, "")]
    got = {(r.doc_id, r.n_words, r.n_removed) for r in suffixtree.substring_dedup(frame(spark, odd), window=4, prefix=2).collect()}
    assert got == {(None, 6, 6), (5, 6, 0), (7, 0, 0), (8, 0, 0)}
    assert suffixtree.substring_dedup(empty(spark)).count() == 0
    assert suffixarray.suffix_array_dedup(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        suffixarray.suffix_array_dedup(empty(spark), window=10, core=20)


def test_loser_tree_orders_and_knows_prefixes():
    import random

    rng = random.Random(5)
    keys = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(300)]
    runs = [sorted((k, (bytes(16), 0, len(k), b"", 1, 0)) for k in keys[i::7]) for i in range(7)]
    merged = list(suffixarray.merge([suffixarray.front_code(r) for r in runs]))
    assert [k for _, k, _ in merged] == sorted(keys)
    for (_, a, _), (n, b, _) in zip(merged, merged[1:], strict=False):
        assert n == suffixarray.common_prefix(a, b)
    assert list(suffixarray.merge([])) == []


def test_tree_nodes():
    assert sorted(anchored.nodes([0, 2, 2, 0, 3])) == [(2, 0, 0, 2), (3, 0, 3, 4)]
    assert list(anchored.nodes([0])) == []


def test_exact_dedup(spark):
    rows = [*documents(6), (None, "lonely"), (None, "one"), (900, "one")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = sorted(
        (str(i), str(best := max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""]), i == best, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows
    )
    got = exact.exact_dedup(frame(spark, rows).repartition(3)).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exact.exact_dedup(empty(spark)).count() == 0


def brute_near(rows, percent, size):
    def shingles(t):
        low = bytes(x + 32 if 65 <= x <= 90 else x for x in (t or "").encode())
        w = re.findall(rb"[^\x20\x09-\x0D]+", low)
        n = min(size, len(w))
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


@pytest.mark.parametrize("seed", [1, 8])
def test_near_dedup(spark, seed):
    rows = documents(seed)
    got = minhash.near_dedup(frame(spark, rows).repartition(3), percent=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_near(rows, 85, 5)


def test_near_chain_of_edits(spark):
    """Neighbours of a chain are near, its ends aren't: one component, without its pivot's help."""
    words = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(words)))
        words[15 * i % 200] = f"edit{i}"
    rows += [(100 + i, " ".join(f"{i}u{k}" for k in range(50))) for i in range(3)]
    got = minhash.near_dedup(frame(spark, rows), percent=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_near(rows, 85, 5)


def test_rows_of_one_id_are_nodes_of_their_own(spark):
    one, two = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(0, one + " extra"), (1, one), (1, two), (5, two + " more")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_dedup(frame(spark, rows), percent=85).collect())
    assert got == [(0, 0, True), (1, 0, False), (1, 1, True), (5, 1, False)]
    kept = sorted((r.doc_id, r.text) for r in minhash.drop_near_copies(frame(spark, rows), percent=85).collect())
    assert kept == [(0, one + " extra"), (1, two)]


def test_unlinked_pages_of_a_template_make_no_pairs(spark):
    """120 pages that are a template to nine tenths: no two are linked, none is paired."""
    base = [f"t{k}" for k in range(180)]
    rows = [(i, " ".join([*base, *(f"p{i}w{k}" for k in range(22))])) for i in range(120)]
    rows += [(200, " ".join([*base, "x"])), (201, " ".join([*base, "y"]))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_dedup(frame(spark, rows), percent=92).collect())
    assert got == brute_near(rows, 92, 5)
    member = spark.createDataFrame([(1, bytes([i]), 198, 176) for i in range(120)], "bucket long, node binary, size long, most long")
    assert minhash._plausible(member, 92).count() == 0
    member = member.union(spark.createDataFrame([(1, bytes([200]), 177, 177), (1, bytes([201]), 177, 176)], member.schema))
    assert {r.node[0] for r in minhash._plausible(member, 92).collect()} >= {200, 201}


def test_near_edges(spark):
    odd = [(None, "a b c d e f g"), (3, "a b c d e f g"), (3, "A B C d e f g"), (4, None), (5, "")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_dedup(frame(spark, odd)).collect())
    assert got == [("3", 3, "3", True), ("3", 3, "3", True), ("4", 0, "4", True), ("5", 0, "5", True), ("None", 3, "None", True)]
    assert minhash.near_dedup(empty(spark)).count() == 0
    assert minhash.drop_near_copies(frame(spark, documents(1))).columns == ["doc_id", "text", "mark", "place", "spans"]
