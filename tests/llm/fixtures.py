"""Small document tables with nulls, empty and long texts, ties, repeats and clashing names."""

import random

WORDS = ["alpha", "Beta", "gamma,", "delta", "été", "straße", "the", "of", "x1", "42", "end.", "ñandú"]


def passage(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


def documents(seed=1, n=40):
    """(doc_id, text) rows: copies, near copies, shared passages, edges."""
    rng = random.Random(seed)
    shared = [passage(rng, 80) for _ in range(3)]
    rows = []
    for i in range(n):
        text = passage(rng, rng.randint(0, 150))
        if i % 4 == 0:
            text = text[: len(text) // 2] + " " + rng.choice(shared) + "\n" + text[len(text) // 2 :]
        if i % 5 == 1 and rows:
            text = rng.choice(rows)[1] or ""
        if i % 7 == 2 and rows:
            words = (rng.choice(rows)[1] or "a b").split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, "   \n\t "), (n + 3, "one"), (n + 4, "ab" * 700), (n + 5, "abab" * 500), (n + 6, "w " * 300)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    """documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", i, None) for i, t in rows], "doc_id long, text string, mark string, place long, spans string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, mark string, place long, spans string")
