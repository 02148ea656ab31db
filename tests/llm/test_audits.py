"""Spelling variants, source divergence and the quality classifier against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import divergence, quality, variants

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, noise):
    out = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if noise and h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return out


def edits(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def grouped(words, ratio=5):
    out = {}
    for w, n in words.items():
        near = [x for x in words if edits(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= ratio * n else None
        out[w] = [w, form, None, n, len(near), words[form] if form else None]
    for w, row in out.items():
        row[2] = w
        while out[row[2]][1]:
            row[2] = out[row[2]][1]
    return sorted(map(tuple, out.values()))


def collected(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_of_few_letters(spark):
    # few letters: many anagrams, runs of a letter, ties, chains of forms
    rng = random.Random(3)
    words = {"".join(rng.choice("abé×") for _ in range(rng.randint(1, 6))): rng.choice([1, 1, 2, 6, 30, 40, 200, 1000]) for _ in range(400)}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert collected(variants.group_variants(df)) == grouped(words)


def test_variants_of_texts(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdeñ") for _ in range(7)) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(stems).replace("a", rng.choice("aaaaeE"), 1) for _ in range(150)) + "-Ωmega_Ünter1ÿ") for i in range(30)]
    rows += [(None, "aaaaaaaaaa " * 9), (31, None), (32, ""), (33, "!!"), (3, rows[3][1]), (34, ("b" * 300_000 + " ") * 3 + ("b" * 299_999 + " ") * 3)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    words = {w: n for w, n in counted(rows, 3).items() if len(w) >= 6 and n >= 2}
    out = variants.spelling_variants(df, min_count=2, noise=3)
    # too long for the plain version: each is near the other alone
    got = collected(out)
    short = [r for r in got if len(r[0]) < 100]
    assert short == grouped({w: n for w, n in words.items() if len(w) < 100})
    assert {len(r[0]): r[4] for r in got if len(r[0]) >= 100} == {299_999: 1, 300_000: 1}
    assert any(r[1] for r in short)
    assert collected(variants.spelling_variants(df.limit(0))) == []


def test_one_class_of_many_anagrams(spark):
    # 5,040 orders of seven letters and words that differ from some of them: pairs stay few
    import itertools

    words = {"".join(p): 10 for p in itertools.permutations("abcdefg")}
    words |= {"abcdefgh": 60, "abcdefx": 50}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    keyed = variants.keyed(df)
    assert variants.near_words(keyed).count() == 4
    got = {r["word"]: (r["form"], r["n_near"]) for r in variants.group_variants(df).where("n_near > 0").collect()}
    assert got == {"abcdefg": ("abcdefgh", 2), "abcdefgh": (None, 1), "abcdefx": (None, 1)}
    with pytest.raises(ValueError):
        variants.group_variants(df, ratio=1)


def test_a_tournament_meets_every_pair_once(spark):
    for n in range(2, 12):
        m = n + n % 2
        df = spark.range(n).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 2).cast("bigint"))))
        got = df.select("id", "turn", divergence.opponent(F.col("id"), F.col("turn"), F.lit(m)).alias("other")).where(f"other < {n}").collect()
        met = defaultdict(list)
        for r in got:
            met[r["turn"]].append((r["id"], r["other"]))
        for pairs in met.values():
            assert all((b, a) in pairs and a != b for a, b in pairs) and len({a for a, _ in pairs}) == len(pairs)
        assert sorted((r["id"], r["other"]) for r in got) == [(a, b) for a in range(n) for b in range(n) if a != b]


def test_vectors_and_shares_are_exact():
    rng = np.random.default_rng(1)
    for n in (0, 1, 500):
        ids, counts = np.sort(rng.choice(70_000, n, replace=False)).astype(np.int64), rng.integers(1, 1 << 60, n)
        back = divergence.unpack(divergence.pack(ids, counts))
        assert (back[0] == ids).all() and (back[1] == counts).all()
    assert len(divergence.unpack(None)[0]) == 0
    total = 8 * 10**15 + 7
    counts = [0, 1, 5, 10**14, 8 * 10**15]
    assert divergence.shares(np.array(counts), total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts]


def audited(rows, min_docs, top):
    docs = [(lang or "", source or "", Counter(x.translate(LOW) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == lang]
        have, every = Counter(), Counter()
        by = defaultdict(Counter)
        for _, source, terms in here:
            have.update(terms.keys())
            every.update(terms)
            by[source].update(terms)
        kept = sorted(t for t in have if have[t] >= min_docs)

        def share(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        usual, p = share(every), {s: share(c) for s, c in by.items()}
        for s in by:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in by if o != s]
            term = [((p[s][t] - usual[t]) ** 2 // usual[t], t) for t in kept if by[s][t] and p[s][t] > usual[t]]
            for part, items, limit in (("pair", pair, len(pair)), ("term", term, top)):
                for k, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]):
                    out.append((lang, s, part, item, v, k + 1))
    return sorted(out)


@pytest.mark.parametrize(("shard_terms", "rounds"), [(1 << 16, 32), (3, 2)])
def test_divergence(spark, shard_terms, rounds):
    rng = random.Random(8)
    terms = ["aa", "Bb", "cc", "dé", "éd", "ωm", "zz", "q", "Q"]
    rows = [(i, " ".join(rng.choice(terms[: 3 + i % 7]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "é", "", None])) for i in range(90)]
    rows += [(7, None, "en", "mute"), (7, "", "fr", "lone"), (91, "x y", "xx", "a"), (92, "...", "xx", "b"), (93, "z " * 50_000, "en", "s1")]
    df = spark.createDataFrame([(*r, "v", 1) for r in rows], "doc_id long, text string, lang string, source string, term string, n int").repartition(3)
    got = sorted(tuple(r) for r in divergence.audit_sources(df, top=4, shard_terms=shard_terms, rounds=rounds).collect())
    assert got == audited(rows, 3, 4)
    assert divergence.audit_sources(df.limit(0)).count() == 0


def plain_discriminant(x, y, shrinkage, ridge):
    """Log-density difference by inverses and determinants."""
    k, parts = x.shape[1], []
    covs = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).mean() * np.diag(v) for c, v in zip((0, 1), covs, strict=True))
    for c in (0, 1):
        n = (y == c).sum()
        a = max(shrinkage, k / (n + k))
        cov = (1 - a) * covs[c] + a * np.diag(np.diag(covs[c])) + np.diag(ridge * np.maximum(pooled, pooled[pooled > 0].min()))
        gap = x - x[y == c].mean(0)
        parts.append(-0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) - 0.5 * np.log(np.linalg.det(cov)))
    return parts[1] - parts[0]


def texts(rng, n):
    good = ["the", "house", "stands", "near", "water,", "and", "people", "walk", "home.", "évening", "light"]
    rows = []
    for i in range(n):
        words = [rng.choice(good) for _ in range(rng.randint(20, 200))]
        bad = i % 3 == 0
        if bad:
            words = {0: [w.upper() + "!!" for w in words], 1: [w + "###" for w in words], 2: [w for w in words[:6] for _ in range(20)]}[i // 3 % 3]
        rows.append((i, " ".join(words), int(not bad)))
    return rows


def test_quality_against_plain_densities(spark):
    rows = texts(random.Random(4), 300)
    docs = spark.createDataFrame([(i, t, 1, 0.5, "x") for i, t, _ in rows], "doc_id long, text string, predicted int, score double, words string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(1, None), (2, 7), (None, 1)], "doc_id long, quality int")
    stats = quality.statistics(docs)
    model = quality.fit(stats, labels)
    x = {r["id"]: r["x"] for r in stats.collect()}
    used = [(np.array(x[i]), y) for i, _, y in rows if i % 5]
    want = plain_discriminant(np.array([v for v, _ in used]), np.array([y for _, y in used]), quality.SHRINKAGE, quality.RIDGE)
    assert np.allclose(model.difference(np.array([v for v, _ in used])), want)
    got = {r["id"]: r for r in quality.score_quality(docs, model).collect()}
    assert len(got) == 300 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [(got[i]["predicted"], y) for i, _, y in rows if i % 5 == 0]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)


def test_statistics_by_hand():
    texts_ = ["Ab CD CD x1 ||\n.", "", "   ", "é"]
    raw = [t.encode() for t in texts_]
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in raw])))
    x = quality.describe(np.frombuffer(b"".join(raw), np.uint8), bounds)
    row = dict(zip(quality.STATISTICS, x[0], strict=True))
    share = lambda v: np.sin(v) ** 2
    assert np.isclose(np.expm1(row["words"]), 6) and np.isclose(np.expm1(row["lines"]), 1)
    assert np.isclose(np.expm1(row["letters_a_word"]), 7 / 6)
    assert np.isclose(share(row["upper"]), 5 / 7) and np.isclose(share(row["digits"]), 1 / 11)
    assert np.isclose(share(row["marks"]), 2 / 11) and np.isclose(share(row["stops"]), 1 / 11)
    assert np.isclose(share(row["repeated"]), 1 / 6) and np.isclose(share(row["common"]), 2 / 6)
    assert np.isclose(share(row["unlettered"]), 2 / 6) and np.isclose(share(row["upper_at_worst"]), 2 / 6)
    assert not x[1].any() and not x[2].any() and np.isclose(np.expm1(x[3][1]), 1)


def test_quality_edges(spark):
    rows = [(1, None), (1, ""), (None, "word " * 60_000), (2, "\x00\n"), (3, "same"), (3, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    model = quality.fit(quality.statistics(docs), none)
    assert [r["score"] for r in quality.score_quality(docs, model).collect()] == [1.0] * 6
    assert quality.fit(quality.statistics(docs.limit(0)), none).intercept == 0.5
    assert quality.score_quality(docs.limit(0), model).count() == 0
    # every row alike in one class: the ridge keeps the factors finite
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, quality int")
    scores = {(r["id"], r["score"]) for r in quality.score_quality(docs, quality.fit(quality.statistics(docs), labels)).collect()}
    assert all(0 <= s <= 1 for _, s in scores)
