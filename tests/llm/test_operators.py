"""Packing, decontamination, PII, LM, line templates, toxicity and the pipeline."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillmark.llm import decontam, linetemplate, lm, packing, pii, queries, scan, toxicity

from .fixtures import documents, empty, frame, passage

TEXTS = ["", "Hello  world", "It's 3.14\n\nnew\tline ", " leading", "trailing \n", "日本語 テスト　全角", "a b  c", "<|endoftext|> x", "naïve café\r\n\r\n  x", "word," * 50, "a.b;c:d!e?f", "x\n y\n\n  z", "é.\nÉ"]


@pytest.fixture(scope="module")
def tokenizer():
    return queries.tokenizer_path()


def plain_ids(tokenizer, text):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)
    model.encode_special_tokens = True
    return model.encode(text, add_special_tokens=False).ids


def test_chunks_give_the_texts_ids(tokenizer):
    texts = [*TEXTS, *[t or "" for _, t in documents(3)]]
    raw = [t.encode() for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    for model in (packing.ChunkTokenizer(tokenizer), packing.ChunkTokenizer(tokenizer, cache=5)):
        for _ in range(2):
            ids, at = model.encode(np.frombuffer(b"".join(raw), np.uint8), bounds)
            for k, t in enumerate(texts):
                assert ids[at[k] : at[k + 1]].tolist() == plain_ids(tokenizer, t)


def test_pack_documents(spark, tokenizer):
    rows = [*[r for r in documents(2) if r[0] < 40], (70, None), (71, ""), (72, passage(__import__("random").Random(1), 3000))]
    got = packing.pack_documents(frame(spark, rows).repartition(2), tokenizer, tokens=128, segments=4).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in rows}
    for i, t in rows:
        parts = sorted(by_doc[i], key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in parts]).tolist()
        assert ids == [*plain_ids(tokenizer, t or ""), 1]
        assert [r.start for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist()
        assert {r.doc_tokens for r in parts} == {len(ids)}
    for parts in by_sequence.values():
        parts = sorted(parts, key=lambda r: r.offset)
        assert [r.offset for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist()
        assert sum(r.length for r in parts) <= 128 and len(parts) <= 4
    full = [sum(r.length for r in p) for p in by_sequence.values()]
    assert sum(128 - n for n in full if n & (n - 1)) == 0
    assert packing.pack_documents(empty(spark), tokenizer).count() == 0


def test_packer_keeps_all_limits():
    rng = np.random.default_rng(4)
    for cut in (True, False):
        packer, out, want = packing.Packer(100, 5, 40, cut, pool=16), [], {}
        for k in range(300):
            n = int(rng.integers(1, 90))
            ids, loss = np.full(n, k, np.uint32), rng.random(n) < 0.3
            want[k] = (n, int(loss.sum()))
            out += list(packer.add(k, ids, loss))
        out += list(packer.finish())
        have = defaultdict(lambda: [0, 0])
        for parts in out:
            assert sum(len(p[2]) for p in parts) <= 100 and len(parts) <= 5
            assert sum(packer._loss(p, len(p[2])) for p in parts) <= 40
            for p in parts:
                have[p[0]][0] += len(p[2])
                have[p[0]][1] += packer._loss(p, len(p[2]))
        assert {k: tuple(v) for k, v in have.items()} == want


def test_pack_conversations(spark, tokenizer):
    turns = spark.createDataFrame([(1, 0, "user", "hi there"), (1, 1, "assistant", "hello"), (2, 0, None, None), (2, 1, "assistant", "yes. no")], "conv_id long, turn long, role string, text string")
    got = {r.doc_id: r for r in packing.pack_conversations(turns, tokenizer, tokens=64).collect()}
    assert np.frombuffer(got[1].ids, "<u4").tolist() == [*plain_ids(tokenizer, "hi there"), 1, *plain_ids(tokenizer, "hello"), 1]
    assert got[1].loss_tokens == len(plain_ids(tokenizer, "hello")) + 1
    assert got[2].length == len(plain_ids(tokenizer, "yes. no")) + 2


def brute_contamination(docs, items, size):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
    known = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1) if n and i is not None else ():
            known[tuple(w[k : k + n])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in known}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in known:
                    hit.update(range(k, k + n))
                    found |= known[tuple(w[k : k + n])]
        out.append((str(i), len(w), len(hit), sorted(found)))
    return sorted(out)


def test_decontamination(spark):
    docs = [*documents(5), (None, "Quick! brown FOX"), (80, "say quick brown fox."), (81, "quick-brown fox quick brown")]
    texts = dict(docs)
    items = [(7, " ".join((texts[3] or "x y").split()[:25])), (7, "quick brown fox"), (10, texts[5]), (11, None), (12, "!!"), (None, "one"), (13, (texts[8] or "z")[-200:])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(docs, items, 10)
    for block in (1 << 20, 60):
        got = decontam.find_contamination(frame(spark, docs), bench, block_bytes=block).collect()
        assert sorted((str(r.doc_id), r.n_words, sum(s.words for s in r.spans), r.items) for r in got) == want
    clean = decontam.remove_contamination(frame(spark, docs), bench)
    assert clean.columns == ["doc_id", "text", "mark", "place", "spans"]
    after = {r.doc_id: r.text for r in clean.collect()}
    assert after[80] == "say ." and after[81] == " quick brown"
    assert all(after[i] == t for i, t in docs if [w for w in want if w[0] == str(i)][0][2] == 0)
    assert decontam.remove_contamination(frame(spark, docs), bench, whole=True).count() == sum(w[2] == 0 for w in want)
    assert decontam.find_contamination(empty(spark), bench).count() == 0
    assert decontam.find_contamination(frame(spark, docs), bench.limit(0)).where("size(spans) > 0").count() == 0


def luhn(d):
    s = sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(d)))
    return s % 10 == 0


def feistel(kind, left, right, a, b, key):
    import hashlib

    f = lambda i, x: int(hashlib.sha256(f"{key}:{kind}:{i}:{x}".encode()).hexdigest()[:14], 16)
    for i in range(1, pii.ROUNDS + 1):
        if i % 2:
            left = (left + f(i, right)) % a
        else:
            right = (right + f(i, left)) % b
    return left, right


def test_pseudonyms(spark):
    texts = [
        "mail jane.doe42@mail7.example.com, card 4207051279108084 and 4207-0512-7910-8084; not 4207051279108085.", "ip 28.125.121.88. and 300.1.2.3 (375) 555-4393, 123-45-6789 666-12-1234",
        "2020-02-29 29/02/2020 12/31/1999 31.12.1999 2020-02-30 99/99/2000", None, "", "nothing here", "again 4207051279108084 and 28.125.121.88", "1" * 40, "x" * 5000 + " 28.125.121.88",
    ]
    rows = list(enumerate(texts))
    out = {r.doc_id: r for r in pii.pseudonymise(frame(spark, rows).withColumnRenamed("mark", "found"), key="k").collect()}
    found = {(x.kind, x.value): x.pseudonym for r in out.values() for x in r.found}
    assert found["card", "4207051279108084"].replace("-", "") == found["card", "4207-0512-7910-8084"].replace("-", "")
    assert luhn(found["card", "4207051279108084"]) and found["card", "4207051279108084"][0] == "4"
    left, right = feistel("ip", 28 * 256 + 125, 121 * 256 + 88, 65536, 65536, "k")
    assert found["ip", "28.125.121.88"] == f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    assert re.fullmatch(r"[a-z]{4}\.[a-z]{3}\d\d@mail7\.example\.com", found["email", "jane.doe42@mail7.example.com"])
    assert re.fullmatch(r"\([2-9]\d\d\) [2-9]\d\d-\d{4}", found["phone", "(375) 555-4393"])
    assert "666-12-1234" in out[1].text and "300.1.2.3" in out[1].text and "4207051279108085" in out[0].text
    assert found["date", "2020-02-29"] == "-".join(reversed(found["date", "29/02/2020"].split("/")))
    assert "2020-02-30" in out[2].text and "99/99/2000" in out[2].text
    assert out[3].text is None and out[4].text == "" and out[5].text == texts[5] and out[7].text == texts[7]
    assert found["card", "4207051279108084"] in out[6].text and out[8].text.endswith(found["ip", "28.125.121.88"])
    assert pii.pseudonymise(empty(spark), "k").count() == 0


def plain_pseudonym(kind, m, key):
    """The pseudonym by plain Python arithmetic, without Spark."""
    import datetime
    import hashlib

    digits = re.sub(r"\D", "", m)

    def fill(new):
        it = iter(new)
        return "".join(next(it) if c.isdigit() else c for c in m)

    if kind == "ip":
        o = [int(x) for x in m.split(".")]
        x, y = feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key)
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if kind == "ssn":
        areas = [a for a in range(1, 900) if a != 666]
        x, y = feistel("ssn", areas.index(int(digits[:3])), (int(digits[3:5]) - 1) * 9999 + int(digits[5:]) - 1, 898, 99 * 9999, key)
        return f"{areas[x]:03}-{y // 9999 + 1:02}-{y % 9999 + 1:04}"
    if kind == "phone":
        a, e, n = int(digits[:3]), int(digits[3:6]), int(digits[6:])
        low, size = (lambda c: 200 if c >= 200 else 0), (lambda c: 800 if c >= 200 else 200)
        x, y = feistel("phone", a - low(a), (e - low(e)) * 10000 + n, size(a), size(e) * 10000, key)
        return fill(f"{x + low(a):03}{y // 10000 + low(e):03}{y % 10000:04}")
    if kind == "card":
        half = (len(digits) - 2) // 2
        rest = len(digits) - 2 - half
        x, y = feistel("card", int(digits[1 : 1 + half]), int(digits[1 + half : -1]), 10**half, 10**rest, key)
        body = f"{digits[0]}{x:0{half}}{y:0{rest}}"
        return fill(next(body + c for c in "0123456789" if luhn(body + c)))
    if kind == "date":
        orders = ["%Y-%m-%d"] if "-" in m else [f"%d{m[2]}%m{m[2]}%Y", f"%m{m[2]}%d{m[2]}%Y"]
        for order in orders:
            try:
                day = datetime.datetime.strptime(m, order).date()
            except ValueError:
                continue
            start = datetime.date(day.year // 100 * 100, 1, 1)
            rows, parts = (487, 75) if start.year % 400 == 0 else (397, 92)
            if order != orders[-1] or len(orders) == 1:
                n = (day - start).days
                x, y = feistel("date", n // rows, n % rows, parts, rows, key)
                return (start + datetime.timedelta(x * rows + y)).strftime(order)
            every = (start + datetime.timedelta(i) for i in range(36524 + (start.year % 400 == 0)))
            late = [x for x in every if x.day > 12]
            rows, parts = (177, 125) if start.year % 400 == 0 else (5531, 4)
            x, y = feistel("late date", late.index(day) // rows, late.index(day) % rows, parts, rows, key)
            return late[x * rows + y].strftime(order)
    if kind == "email":
        local, domain = m.rsplit("@", 1)
        half = len(local) // 2
        sides = [local[:half], local[half:]]
        for i in range(1, pii.ROUNDS + 1):
            own = 0 if i % 2 else 1
            h = hashlib.sha256(f"{key}:email:{i}:{domain.lower()}:{sides[1 - own]}".encode()).hexdigest()
            moved = ""
            for j, c in enumerate(sides[own]):
                k = int(h[(j % 16) * 4 : (j % 16) * 4 + 4], 16) + j
                low = next((lo for lo, hi in ("09", "az", "AZ") if lo <= c <= hi), None)
                moved += c if low is None else chr(ord(low) + (ord(c) - ord(low) + k) % (10 if low == "0" else 26))
            sides[own] = moved
        return "".join(sides) + "@" + domain
    return m


def test_every_format_against_plain_arithmetic(spark):
    rng = __import__("random").Random(8)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    values = []
    for _ in range(40):
        y, mo, d = rng.randint(1600, 2399), rng.randint(1, 12), rng.randint(1, 28)
        body = rng.choice("3456") + n(rng.randint(11, 17))
        card = next(body + c for c in "0123456789" if luhn(body + c))
        values += [
            ("ip", ".".join(str(rng.randint(0, 255)) for _ in range(4))), ("ssn", f"{rng.choice([1, 665, 667, 899, rng.randint(1, 665)]):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}"),
            ("phone", rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(n(3), n(3), n(4))), ("card", rng.choice([card, " ".join(card), "-".join([card[:4], card[4:]])])),
            ("date", rng.choice(["{0:04}-{1:02}-{2:02}", "{2:02}/{1:02}/{0:04}", "{2:02}.{1:02}.{0:04}"]).format(y, mo, d)), ("date", f"{mo:02}/{rng.randint(13, 28)}/{y:04}"),
            ("email", "".join(rng.choice("abcXYZ019._%+-") for _ in range(rng.randint(1, 40))) + "@" + rng.choice(["a.example.com", "X-1.co.uk"])),
        ]
    frame_ = spark.createDataFrame([(k, f"see {v}, then", 7) for k, (_, v) in enumerate(values)], "matches long, text string, made long")
    out = pii.pseudonymise(frame_, "secret 'key'")
    assert out.columns == ["matches", "text", "made", "found"]
    for r in out.collect():
        kind, v = values[r.matches]
        assert [(x.kind, x.value, x.pseudonym) for x in r.found] == [(kind, v, plain_pseudonym(kind, v, "secret 'key'"))], (kind, v)
        assert r.text == f"see {r.found[0].pseudonym}, then" and r.made == 7
    with pytest.raises(ValueError):
        pii.pseudonymise(frame_, "")


def test_values_without_adjacent_digits_are_found(spark):
    texts = ["ask 8.8.8.8 first", "10 times 8.8.8.8", "4-2-0-7-0-5-1-2-7-9-1-0-8-0-8-4", "a@b.example.com"]
    out = {r.doc_id: r for r in pii.pseudonymise(frame(spark, list(enumerate(texts))), key="k").collect()}
    assert [[x.kind for x in out[i].found] for i in range(4)] == [["ip"], ["ip"], ["card"], ["email"]]
    assert out[0].found[0].pseudonym == out[1].found[0].pseudonym and "8.8.8.8" not in out[0].text


def test_permutation_of_a_small_format(spark):
    """All days of a century get all days of that century."""
    days = spark.sql("select explode(sequence(date'1900-01-01', date'1999-12-31')) d").selectExpr("date_format(d, 'yyyy-MM-dd') m")
    got = [r[0] for r in days.select(pii.pseudonym("m", "k").alias("p")).collect()]
    assert len(set(got)) == len(got) == 36524 and min(got) == "1900-01-01" and max(got) == "1999-12-31"


@pytest.mark.parametrize("century", [19, 20])
def test_no_two_strings_of_a_century_share_a_pseudonym(spark, century):
    """All strings that are read day first, and all that can only be read month first."""
    days = spark.sql(f"select explode(sequence(date'{century}00-01-01', date'{century}99-12-31')) d")
    both = days.selectExpr("date_format(d, 'dd/MM/yyyy') m").union(days.where("day(d) > 12").selectExpr("date_format(d, 'MM/dd/yyyy') m"))
    got = both.select("m", pii.pseudonym("m", "k").alias("p")).collect()
    n = 36524 + 22124 + 2 * (century == 20)
    assert len({r.m for r in got}) == len({r.p for r in got}) == len(got) == n and {r.m for r in got} == {r.p for r in got}


def test_values_that_are_their_own_pseudonym_are_found(spark):
    days = spark.sql("select explode(sequence(date'1900-01-01', date'1999-12-31')) d").selectExpr("date_format(d, 'yyyy-MM-dd') m").cache()
    for k in "abcdefgh":
        same = [r.m for r in days.where(pii.pseudonym("m", k) == days["m"]).collect()]
        if same:
            break
    rows = [*enumerate(same), (90, "1999-02-30 30/02/1999 4207051279108085")]
    out = {r.doc_id: r.found for r in pii.pseudonymise(frame(spark, rows), key=k).collect()}
    assert same and all(out[i][0].value == out[i][0].pseudonym == d for i, d in enumerate(same)) and out[90] == []
    days.unpersist()


def test_gradient_and_likelihood():
    rng = np.random.default_rng(0)
    context, target = rng.integers(0, lm.VOCAB, (40, 4)), rng.integers(0, lm.VOCAB - 1, 40)
    net = lm.Network(lm.start().astype(np.float64).astype(np.float32))
    before = net.log_probabilities(context, target).mean()
    grown = np.full(lm._SIZE, 1e-4, np.float32)
    for _ in range(30):
        net.train(context, target, grown)
    assert net.log_probabilities(context, target).mean() > before + 1
    every = np.array([net.log_probabilities(context[:1], np.array([t]))[0] for t in range(lm.VOCAB)])
    assert math.isclose(np.exp(every).sum(), 1, rel_tol=1e-4)


def test_lm_scores(spark):
    rng = __import__("random").Random(2)
    common = [(i, " ".join(["the cat sat on the mat"] * rng.randint(5, 30))) for i in range(60)]
    rows = [*common, (100, " ".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 20))), (101, None), (102, ""), (None, "the cat"), (103, "x" * 20000)]
    got = {r.doc_id: r for r in lm.pseudo_likelihood(frame(spark, rows).repartition(2)).collect()}
    assert got[101].n_tokens == got[102].n_tokens == 0 and got[101].log_likelihood == 0 and got[102].per_token is None
    assert got[None].n_tokens == 2 and got[103].n_tokens == 1
    assert min(got[i].per_token for i, _ in common) > got[100].per_token
    assert lm.pseudo_likelihood(empty(spark)).count() == 0
    first, bounds = np.frombuffer(b"a b c", np.uint8), np.array([0, 3, 5])
    ids, at = lm.token_ids(first, bounds, lm.Words.none())[:2]
    assert lm.contexts(ids, at).tolist() == [[lm.PAD, lm.PAD, ids[1], lm.PAD], [lm.PAD, ids[0], lm.PAD, lm.PAD], [lm.PAD] * 4]


def test_lm_scores_do_not_depend_on_partitions(spark):
    rows = documents(4, 60)
    want = None
    for parts in (1, 3, 7):
        flat = lm.pseudo_likelihood(frame(spark, rows[parts:] + rows[:parts]).repartition(parts), tokens_a_shard=700).collect()
        got = sorted((r.doc_id, r.n_tokens, r.log_likelihood) for r in flat)
        want = want or got
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want], rtol=1e-5)


def test_shares_of_words_in_their_ids(spark):
    """The likelihood is of words, not of ids: shares of an id's words, by plain counts, add to 1."""
    words = [f"w{k}" for k in range(3000) for _ in range(1 + k % 5)] + ["top"] * 40
    docs = frame(spark, [(i, " ".join(words[i::50])) for i in range(50)])
    for most in (1 << 20, 1300):
        found = lm.vocabulary(docs, most=most)
        names = sorted(set(words))
        buf, bounds = toxicity._joined([" ".join(names).encode()])
        ids, _, share = lm.token_ids(buf, bounds, found)
        own = Counter(words)
        total = defaultdict(int)
        for w, i in zip(names, ids, strict=True):
            total[i] += own[w]
        listed = {w for w in names if own[w] >= (1 if most > 3001 else 4)}
        for w, i, s in zip(names, ids, share, strict=True):
            if i < lm.KNOWN:
                assert s == 0
            elif w in listed:
                assert math.isclose(math.exp(s), own[w] / total[i], rel_tol=1e-4)
        for i in set(ids.tolist()):
            assert i < lm.KNOWN or math.isclose(sum(math.exp(s) for s, j in zip(share, ids, strict=True) if i == j), 1, rel_tol=1e-3)


def test_line_templates(spark):
    rng = __import__("random").Random(7)
    rows = [(i, "\n".join([passage(rng, 8).replace("1", "a"), f"Served by node {i} in {i * 3} ms", passage(rng, 9), "", "All rights reserved."])) for i in range(12)]
    copies = [(50 + i, "one own line\nserved twice here\nlast own line") for i in range(9)]
    odd = [(80, None), (81, ""), (None, "All rights reserved.\nmine"), (82, "All rights reserved.")]
    out = {r.doc_id: r for r in linetemplate.line_dedup(frame(spark, [*rows, *copies, *odd])).collect()}
    for i, t in rows:
        lines = t.split("\n")
        assert out[i].text == "\n".join([lines[0], lines[2], ""]) and (out[i].n_lines, out[i].n_dropped) == (5, 2)
    assert all(out[i].text == t and out[i].n_dropped == 0 for i, t in copies)
    assert out[80].text is None and out[80].n_lines == 0 and out[81].text == "" and out[81].n_lines == 1
    assert out[None].text == "mine" and out[82].text == ""
    few = linetemplate.line_dedup(frame(spark, rows), leaf_lines=1)
    assert {r.n_dropped for r in few.collect()} == {2, 1} or {r.n_dropped for r in few.collect()} == {2}
    assert linetemplate.line_dedup(empty(spark)).count() == 0


def test_copies_keep_no_line_that_recurs_elsewhere(spark):
    rows = [(i, f"own before {'x' * i}\nread our terms of use\nown after {'y' * i}") for i in range(6)]
    copies = [(50 + i, "some line here\nread our terms of use\nanother line there") for i in range(40)]
    out = {r.doc_id: r for r in linetemplate.line_dedup(frame(spark, [*rows, *copies])).collect()}
    assert all("read our terms of use" not in r.text for r in out.values())
    assert all(out[i].text == "some line here\nanother line there" for i, _ in copies)
    base = [f"line {'abcdefghij'[k]} of an article with some words" for k in range(10)]
    near = [(i, "\n".join([*base[: i % 10], base[i % 10] + " more" * (1 + i), *base[i % 10 + 1 :]])) for i in range(60)]
    assert {r.n_dropped for r in linetemplate.line_dedup(frame(spark, near)).collect()} == {0}


def test_inner_lines_of_a_block_go(spark):
    block = "this text is free\nfor all uses\nwithout any warranty\nas stated above"
    rows = [(i, f"{block}\nown line {'x' * (i + 1)} that nobody else has {'y ' * (12 + i)}") for i in range(8)]
    out = linetemplate.line_dedup(frame(spark, rows)).collect()
    assert {r.text for r in out} == {t.split("\n")[-1] for _, t in rows} and {r.n_dropped for r in out} == {4}


def test_equal_lines_of_digits_go(spark):
    rows = [(i, f"own before {'x' * (i + 1)} of this\nTel 030 5550 Fax 030 5551\n{i} {i * 7} {i * 9} at\n{'y' * (i + 1)} and own after") for i in range(6)]
    out = {r.doc_id: r.text for r in linetemplate.line_dedup(frame(spark, rows)).collect()}
    assert all(out[i] == "\n".join(t.split("\n")[k] for k in (0, 2, 3)) for i, t in rows)


def test_a_leaf_in_parts_gives_the_templates_of_the_whole(spark):
    rows = [(i, f"{'x' * (i + 1)} only here\nConnection to host {chr(97 + i)} was closed\n{'y' * (i + 1)} and there") for i in range(12)]
    for limit in (1, 3, 2000):
        out = linetemplate.line_dedup(frame(spark, rows), leaf_lines=limit).collect()
        assert {r.n_dropped for r in out} == {1} and not any("Connection" in r.text for r in out)


def test_cluster_looks_up_what_a_search_of_all_finds():
    rng = __import__("random").Random(5)
    for size in (3, 4, 7, 12):
        lines = [(i, b" ".join(rng.choice((b"a", b"b", b"c")) for _ in range(size))) for i in range(200)]
        templates, want = [], []
        for line, words in sorted(((i, t.split(b" ")) for i, t in lines), key=lambda x: (b" ".join(x[1]), x[0])):
            same = [sum(map(bytes.__eq__, words, p)) for _, p in templates]
            if not same or max(same) < linetemplate.SIMILAR * size:
                templates.append((line, words))
                want.append((line, len(templates) - 1))
            else:
                k = same.index(max(same))
                templates[k][1][:] = [p if p == w else linetemplate.WILD for p, w in zip(templates[k][1], words)]
                want.append((line, k))
        assert list(linetemplate.cluster(lines)) == [(line, templates[k][0], b" ".join(templates[k][1])) for line, k in want]


def test_cluster():
    lines = [(1, b"open file a now"), (2, b"open file b now"), (3, b"close all the things")]
    assert sorted(linetemplate.cluster(lines)) == [(1, 1, b"open file <*> now"), (2, 1, b"open file <*> now"), (3, 3, b"close all the things")]
    assert list(linetemplate.cluster([])) == []


def toxic_rows(rng, n):
    for i in range(n):
        words = passage(rng, rng.randint(20, 120)).split()
        bad = i % 4 == 0
        for _ in range(rng.randint(2, 5) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["horribleness", "wretchedly", "scoundrels", "despicable"]))
        yield i, " ".join(words), int(bad)


def test_toxicity(spark):
    rng = __import__("random").Random(9)
    rows = list(toxic_rows(rng, 600))
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, b) for i, _, b in rows if zlib.crc32(str(i).encode()) % 3 != 1], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(i, b) for i, _, b in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum(got[i].predicted == b for i, b in held)
    assert right >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got.values())
    odd = toxicity.score_toxicity(frame(spark, [(1, None), (None, ""), (2, "z" * 3000)]), model).collect()
    assert len(odd) == 3 and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score_toxicity(empty(spark), model).count() == 0
    blank = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(docs.limit(5), blank).collect()} == {0.0}


def test_windows_cover_every_word():
    texts = [("word, " * 20 + "y" * 1000 + " Tail!").encode(), b"", b"...", b"One"]
    buf, bounds = toxicity._joined(texts)
    w = toxicity.windows(buf, bounds)
    got = [[w[i] for i in range(w.at[k], w.at[k + 1])] for k in range(len(texts))]
    assert got[0][0] == b" " + b"word " * toxicity.WINDOW_WORDS and got[0][-1].endswith(b"y tail ") and got[1:] == [[], [], [b" one "]]
    assert int(w.size.max()) <= toxicity.WINDOW_BYTES
    covered = np.zeros(len(w.raw), bool)
    for a, n in zip(w.start, w.size, strict=True):
        covered[a : a + n] = True
    assert covered.all()


def test_windows_with_sequences_of_other_places_are_marked():
    buf, bounds = toxicity._joined([b"a b c d e f g h i j k l", b"x y z u v w c d e p q r", b"a b"])
    w = toxicity.windows(buf, bounds, with_once=True)
    assert w.once.tolist() == [False, True, True, False, True]


def test_copies_of_the_sample_are_left_out():
    texts = [passage(__import__("random").Random(k), 30).encode() for k in range(3)]
    sample = [(texts[0], 1), (texts[1], 0), (texts[0] + b" more", 0), (b"", 0), (texts[2] + b" " + b" ".join(texts[1].split()[:9]), 1)]
    assert toxicity._without_copies(sample) == [sample[k] for k in (0, 1, 3, 4)]


def test_dictionaries_are_trained_apart_and_lengths_decide():
    rng = __import__("random").Random(4)
    sample = [(t.encode(), b) for _, t, b in toxic_rows(rng, 400)]
    model = toxicity.fit(sample, {0: 1.0, 1: 1.0})
    assert model.fitted and b"scoundrels" in model.toxic and b"scoundrels" not in model.ordinary
    buf, bounds = toxicity._joined([b"Alpha1, despicable! gamma,3", b"alpha1 delta20 gamma,3"])
    w = toxicity.windows(buf, bounds)
    pair = toxicity.Pair(model.ordinary, model.toxic)
    lengths = [[len(c.compress(w[i])) for i in range(2)] for c in pair.by]
    assert pair.gains(w).tolist() == [lengths[0][i] - lengths[1][i] for i in range(2)]
    assert pair.gains(w)[0] >= 3 > pair.gains(w)[1]
    assert pair.carriers(w, np.array([0])) == [b" despicable "]


def test_scan_kernels():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1000, 500).astype(np.uint64)
    for w in (1, 2, 7, 64, 500):
        assert scan.sliding_min(v, w).tolist() == [v[i : i + w].min() for i in range(len(v) - w + 1)]
    start, length = rng.integers(0, 100, 30), rng.integers(0, 5, 30)
    assert scan.ragged(start, length).tolist() == [s + k for s, n in zip(start, length, strict=True) for k in range(n)]
    buf = rng.integers(0, 4, 3000).astype(np.uint8)
    h = scan.window_hashes(buf, 5)
    same = defaultdict(set)
    for i in range(len(h)):
        same[bytes(buf[i : i + 5])].add(int(h[i]))
    assert all(len(x) == 1 for x in same.values()) and len({*h.tolist()}) == len(same)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = __import__("random").Random(3)
    item = passage(rng, 14)
    base = [(i, "\n".join([passage(rng, 40), passage(rng, 30)])) for i in range(30)]
    rows = [*base, *[(40 + i, base[i][1]) for i in range(5)], *[(50 + i, base[i][1] + f"\n{passage(rng, 3)}") for i in range(5, 10)], (70, passage(rng, 20) + " " + item + " " + passage(rng, 20)), (71, None), (72, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        if name == "near_dedup":
            assert {r.doc_id for r in now.collect()} == {i for i, _ in rows if not 40 <= i < 45 and not 55 <= i < 60}
    text = {r.doc_id: r.text for r in now.collect()}
    assert item not in text[70] and text[70] and text[3] == base[3][1]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(text)


def test_network_in_reused_space_is_a_fresh_one():
    rng = np.random.default_rng(5)
    context, target = rng.integers(0, lm.VOCAB, (900, 4)), rng.integers(0, lm.VOCAB - 1, 900)
    used = lm.Network(lm.start())
    used.log_probabilities(context, target)
    space = used._rooms["slot"]
    for n in (7, 300, 1):
        assert np.array_equal(used.log_probabilities(context[:n], target[:n]), lm.Network(lm.start()).log_probabilities(context[:n], target[:n]))
    assert used._rooms["slot"] is space
    # values that leave float's range without the row's maximum
    used._rooms.clear()
    used.flat *= 200
    assert np.isfinite(used.log_probabilities(context, target)).all()
