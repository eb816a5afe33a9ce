import random
import re

import pytest

from figurant.llm import jaccard

WORDS = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, k):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                top[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = low.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d is not None and c == d))
    return sorted(out, key=str)


def made(seed, n_groups=12):
    r = random.Random(seed)
    word = lambda: f"{r.choice('abcdEFgé')}{r.randrange(60)}"
    rows, i = [(None, "n1 n2 n3 n4 n5"), (900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE "), (905, "one two"), (905, "three four")], 0
    for _ in range(n_groups):
        base = [word() for _ in range(r.choice([3, 8, 11, 12, 20, 30, 64, 66, 70, 75, 120, 400]))]
        for _ in range(r.choice([1, 2, 5, 14])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4, len(w) // 30])):
                p = r.randrange(len(w))
                w[p : p + r.randrange(2)] = [word() for _ in range(r.randrange(3))]
                w = w or ["z"]
            rows.append((i, r.choice([" ", "\n"]).join(w)))
            i += 1
    rows += [(i + 1, rows[9][1]), rows[10], (None, rows[12][1]), (i + 2, "common passage of words " * 9)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "k", "percent"), [(0, 3, 90), (1, 3, 90), (2, 5, 80), (3, 1, 50), (4, 3, 90)])
def test_against_brute_force(spark, monkeypatch, seed, k, percent):
    if seed != 1:
        monkeypatch.setattr(jaccard, "BLOCK_DOCS", 4)
        monkeypatch.setattr(jaccard, "STRIP", 16)
    rows = made(seed)
    docs = spark.createDataFrame([(*x, "m", 1) for x in rows], "doc_id long, text string, mark string, n int").repartition(3)
    out = jaccard.linked(docs, k, percent)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = brute(rows, k, percent)
    assert sorted(map(tuple, out.collect()), key=str) == want
    assert len({x[2] for x in want}) < len(rows) - 10


def test_empty_table(spark):
    assert jaccard.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fragments_suffice_for_every_size():
    """Sets at the similarity bound share a key: a direct check of the pigeonhole."""
    import numpy as np

    r = np.random.default_rng(0)
    for percent in (80, 90):
        for n in [9, 10, 17, 18, 27, 57, 58, 63, 64, 65, 71, 72, 99, 107, 108, 144, 500, 1000]:
            for _ in range(30):
                a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
                drop = int(r.integers(0, n * (100 - percent) // 100 + 1))
                b = np.sort(r.permutation(a)[drop:])
                if 100 * len(b) < percent * len(a):
                    continue
                keys = []
                for x in (a, b):
                    size = np.array([len(x)])
                    h = jaccard.differing(size, percent)
                    d = np.zeros(len(x), np.int64)
                    bits = {int(jaccard.cut_bits(size, percent)[0]), int(jaccard.cut_bits(size * 100 // percent, percent)[0])}
                    keys.append({int(v) for w in bits for v in jaccard._keys(d, x, np.array([w]), h + 1)[1]})
                assert keys[0] & keys[1]


def test_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 1, 2, 3, 4, 5), (2, "a b c d e f", 1, 2, 3, 4, 5), (3, None, 1, 2, 3, 4, 5), (3, "z", 1, 2, 3, 4, 5), (3, "z", 1, 2, 3, 4, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `row` int, chosen int, d int, `a.b` int, again int")
    out = jaccard.deduplicated(docs, 5, 80)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)


def test_partial_overlaps_make_up_the_whole():
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    from figurant.llm.words import pack

    texts = [" ".join(f"w{(i * j) % 97}" for i in range(200)) for j in (1, 2, 3)]
    packed, sizes = pack(pa.array(texts))
    g = pd.DataFrame({"hub": 7, "s": [7, 8, 9], "packed": packed.to_pylist(), "n_bytes": sizes.to_pylist()})
    out = jaccard._with_hub(3)(g)
    assert out.fragment.nunique() == jaccard.FRAGMENTS
    sets = [shingles(t, 3) for t in texts]
    for k, s in ((1, 8), (2, 9)):
        part = out[out.a == s]
        assert part.shared.sum() == len(sets[0] & sets[k]) and set(part.total) <= {len(sets[0]) + len(sets[k])}
    assert np.array_equal(jaccard.overlaps(jaccard._sets(g, 3), jaccard._sets(g, 3)), [[len(a & b) for b in sets] for a in sets])
