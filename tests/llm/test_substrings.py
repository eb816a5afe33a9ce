import hashlib
import random
import re
from collections import Counter

import pytest

from figurant.llm import substrings

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, span):
    words = [WORDS.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + span]) for w in words for i in range(len(w) - span + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - span + 1) if count[tuple(w[i : i + span])] > 1 for j in range(i, i + span)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc, len(w), len(gone), kept))
    return sorted(out, key=str)


def made(seed, span):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice(["", "é", "Q"]) + str(r.randrange(30))
    passages = [[word() for _ in range(r.choice([span - 1, span, span + 1, 2 * span, 90]))] for _ in range(8)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(r.randrange(6)):
            w += [word() for _ in range(r.choice([0, 1, 5, 60]))]
            p = list(r.choice(passages))
            if r.random() < 0.4:
                p[r.randrange(len(p))] = "edit"
            w += p[r.choice([0, 0, 3]) : len(p) - r.choice([0, 0, 2])]
        rows.append((i, r.choice(["", " ", "\n"]) + "".join(x + r.choice([" ", "\n", "\t \x0b"]) for x in w)))
    rows += [rows[3], (61, rows[4][1]), (7, rows[5][1]), (62, "x " * 300), (63, "x y " * 40), (64, "x " * (span - 1)), (65, "x " * span), (66, None), (67, ""), (None, rows[6][1])]
    return rows


@pytest.mark.parametrize(("seed", "span", "k"), [(0, 35, 12), (1, 35, 12), (2, 10, 3), (3, 8, 8), (4, 12, 1)])
def test_against_brute_force(spark, seed, span, k):
    rows = made(seed, span)
    docs = spark.createDataFrame([(*x, "m", 0) for x in rows], "doc_id long, text string, mark string, node int").repartition(3)
    got = substrings.dedup(docs, span, k)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_text"]
    want = brute(rows, span)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(0 < x[2] < x[1] for x in want)
    if seed == 0:
        hashed = [(*x[:3], hashlib.sha256(x[3].encode()).hexdigest()) for x in want]
        assert sorted(map(tuple, substrings.digests(docs, span, k).collect()), key=str) == sorted(hashed, key=str)


def test_small_blocks_and_empty_table(spark, monkeypatch):
    docs = spark.createDataFrame(made(5, 35)[:0], "doc_id long, text string")
    assert substrings.dedup(docs).count() == 0
