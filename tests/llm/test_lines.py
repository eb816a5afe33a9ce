import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from figurant.llm import embeddings, lines
from figurant.llm.stages import identified
from figurant.llm.words import Block, blocks, mix, pack

WORDS = re.compile("[^\x20\x09-\x0d]+")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_bounded_distance():
    r = random.Random(0)
    for _ in range(2000):
        a = [r.randrange(4) for _ in range(r.randrange(12))]
        b = list(a)
        for _ in range(r.randrange(5)):
            p = r.randrange(len(b) + 1)
            b[p : p + r.randrange(2)] = [r.randrange(4) for _ in range(r.randrange(2))]
        k = r.randrange(6)
        assert lines.within(np.array(a), np.array(b), k) == (distance(a, b) <= k), (a, b, k)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def code(words):
    (block,) = blocks(pa.array([" ".join(words)]))
    weight = [(min(max(len(w.encode()), 3), 16) - 2) ** 2 for w in words]
    return sum((2 * sum(w * (int(h) >> b & 1) for h, w in zip(block.hashes, weight)) > sum(weight)) << b for b in range(64))


def heaviest(words):
    """The blocks of a line, pair by pair."""
    (block,) = blocks(pa.array([" ".join(words)]))
    h, n = block.hashes, [len(w.encode()) for w in words]
    left = {i: (-min(n[i] + n[i + 1], 127), int(mix(h[i : i + 1] * np.uint64(3) + h[i + 1])[0]) >> 7) for i in range(len(words) - 1)}
    out = []
    while left and len(out) < 4 and len(words) >= 4:
        out.append(min(left.values()))
        gone = [i for i, x in left.items() if x == out[-1]]
        for i in gone:
            for j in (i - 1, i, i + 1) if len(words) >= 8 else (i,):
                left.pop(j, None)
    return set(out)


def brute(rows):
    """rows: (doc_id, mark, text). Every pair of distinct lines; the first occurrence stays."""
    where = {}
    for doc, mark, text in rows:
        for k, line in enumerate(lower(text).split("\n")):
            if w := tuple(WORDS.findall(line)):
                where.setdefault(w, set()).add((doc is not None, doc or 0, mark, k))
    keys = list(where)
    codes, heavy = [code(w) for w in keys], [heaviest(w) for w in keys]
    top = list(range(len(keys)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(keys):
        for j in range(i):
            b = keys[j]
            n = max(len(a), len(b))
            near = heavy[i] & heavy[j] and (n < 20 or (codes[i] ^ codes[j]).bit_count() <= 28)
            if near and 100 * (n - distance(a, b)) >= 80 * n:
                top[find(i)] = find(j)
    groups, gone = {}, set()
    for i, w in enumerate(keys):
        groups.setdefault(find(i), set()).update(where[w])
    for g in groups.values():
        gone |= g - {min(g)}
    out = []
    for doc, mark, text in rows:
        parts = (text or "").split("\n")
        drop = {k for k in range(len(parts)) if (doc is not None, doc or 0, mark, k) in gone}
        out.append((doc, sum(bool(WORDS.search(x)) for x in parts), len(drop), "\n".join(x for k, x in enumerate(parts) if k not in drop)))
    return sorted(out, key=str), len(keys) - len(groups)


def made(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(50))
    pool = []
    for _ in range(10):
        base = [word() for _ in range(r.choice([1, 4, 5, 20, 60, 90]))]
        for _ in range(r.choice([1, 4, 12])):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2])):
                w[r.randrange(len(w))] = word()
            pool.append(r.choice([" ", "\t", "  "]).join(w))
    rows = []
    for i in range(40):
        rows.append((i, r.choice(["\n", "\n\n", "\n \n"]).join(r.choice([str.upper, str])(r.choice(pool)) if r.random() < 0.7 else " ".join(word() for _ in range(30)) for _ in range(r.randrange(6)))))
    return rows + [(50, None), (51, ""), (52, "\n \n"), rows[3], (4, "other text here for the same id"), (None, rows[5][1]), (53, "same\nsame\nsame"), (54, "w " * 20_000)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    if seed:
        monkeypatch.setattr(embeddings, "BLOCK", 4)
    rows = made(seed)
    docs = spark.createDataFrame([(*x, "m", 7) for x in rows], "doc_id long, text string, mark string, n long").repartition(3)
    marks = {(r.doc_id, r.text): r.mark for r in identified(docs.select("doc_id", "text")).collect()}
    want, merged = brute([(d, marks[d, t], t) for d, t in rows])
    out = lines.dedup(docs)
    assert out.columns == ["doc_id", "n_lines", "n_removed", "kept_text"]
    assert sorted(map(tuple, out.collect()), key=str) == want
    assert merged >= 1
    clean = lines.cleaned(docs)
    assert clean.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in clean.collect()) == sorted((str(x[0]), x[3]) for x in want if x[1] == 0 or WORDS.search(x[3]))


def test_columns_of_any_name(spark):
    rows = [(1, "one two three four five", 7, "x", 1, 2, 3), (2, "one two three four five\nother", 8, "y", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int, d string, `row` int, `left` int, `a.b` int")
    assert [tuple(r) for r in lines.cleaned(docs).orderBy("doc_id").collect()] == [rows[0], (2, "other", *rows[1][2:])]


def test_lines_that_have_few_words(spark):
    rows = [(1, "a b c d"), (2, "a b c d e"), (3, "x y z"), (4, "x y z w"), (5, "q r s t u"), (6, "q r v t u")]
    out = {x.doc_id: x.n_removed for x in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1}


def test_simhash_of_heavy_lines():
    r = np.random.default_rng(0)
    h, w = r.integers(0, 2**64, 5000, dtype=np.uint64), r.integers(1, 197, 5000)
    at = np.array([0, 1, 3, 400, 4900])
    for k, (i, j) in enumerate(zip(at, [*at[1:], 5000])):
        want = sum(int(2 * sum(int(x) for x, y in zip(w[i:j], h[i:j]) if int(y) >> b & 1) > w[i:j].sum()) << b for b in range(64))
        assert int(lines.simhash(h, w, at)[k]) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup(docs).count() == 0 and lines.cleaned(docs).count() == 0


@pytest.mark.parametrize("low, high, share", [(5, 12, 0.2), (13, 20, 0.1), (21, 35, 0.2), (36, 60, 0.1), (36, 90, 0.2), (61, 200, 0.05)])
def test_recall_against_edit_similarity_alone(spark, low, high, share):
    r = random.Random(low)
    word = lambda: "".join(r.choice("aeioustnrlm") for _ in range(r.randrange(1, 10)))
    rows = []
    for k in range(150):
        a = [word() for _ in range(r.randrange(low, high + 1))]
        b = list(a)
        for i in r.sample(range(len(b)), max(1, int(len(b) * share))):
            b[i] = word()
        assert 100 * (len(a) - distance(a, b)) >= 80 * len(a)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    out = {x.doc_id: x.n_removed for x in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[2 * k] == 0 for k in range(150))  # unlike lines stay
    assert sum(out[2 * k + 1] for k in range(150)) >= 0.9 * 150


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_crowded_blocks_lose_nothing(spark, monkeypatch, seed):
    monkeypatch.setattr(lines, "CROWD", 3)
    monkeypatch.setattr(lines, "AT_ONCE", 50)
    if seed:
        monkeypatch.setattr(lines, "HELD", 60)
    r = random.Random(seed + 10)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(60))
    passage = [f"passagepassage{i}" for i in range(6)]
    rows = made(seed)
    for k in range(40):  # lines that share a passage, and families of near copies around it
        base = [word() for _ in range(r.choice([2, 6, 20, 40]))]
        base[1:1] = passage
        for _ in range(r.choice([1, 1, 6])):
            w = list(base)
            for _ in range(r.randrange(1 + len(w) // 6)):
                w[r.randrange(len(w))] = word()
            rows.append((100 + len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = {(x.doc_id, x.text): x.mark for x in identified(docs).collect()}
    want, merged = brute([(d, marks[d, t], t) for d, t in rows])
    assert merged >= 20
    assert sorted(map(tuple, lines.dedup(docs).collect()), key=str) == want


def test_pairs_of_a_crowd_grow_with_its_alike_lines_only():
    r = np.random.default_rng(0)
    passage = r.integers(0, 2**63, 8, dtype=np.uint64)
    words = [np.insert(r.integers(0, 2**63, 60, dtype=np.uint64), 20, passage) for _ in range(3000)]
    words += [np.append(words[k][:-3], words[k][:3]) for k in range(0, 3000, 10)]
    crowd = lines.Crowd(words)
    found = {(int(a), int(b)) for i, j in crowd.pairs(np.arange(len(words))) for a, b in zip(i, j)}
    assert found == {(k, 3000 + k // 10) for k in range(0, 3000, 10)}


def test_only_lines_to_be_compared_are_split_again(spark, monkeypatch):
    runs, split, real, init = [], [], lines.arrow_map, Block.__init__
    monkeypatch.setattr(lines, "arrow_map", lambda df, run, schema: runs.append(run) or real(df, run, schema))
    docs = identified(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    lines.contents(docs, docs.select(F.lit(1).cast("long").alias("line"), "d", "mark", F.lit(0).alias("number")))
    texts = ["\n".join(f"Line {k} of text {t}" for k in range(1000)) for t in range(2)]
    packed, sizes = pack(pa.array(texts))
    batch = pa.RecordBatch.from_pydict({"packed": packed, "n_bytes": sizes, "number": [[5, 7], [0]], "line": [[11, 12], [13]]})
    monkeypatch.setattr(Block, "__init__", lambda self, first, last, data, *more: split.append(len(data)) or init(self, first, last, data, *more))
    got = {s: w for out in runs[-1]([batch]) for s, w in zip(out.column("s").to_pylist(), out.column("words").to_pylist())}
    assert sum(split) < 100
    for s, line in ((11, "line 5 of text 0"), (12, "line 7 of text 0"), (13, "line 0 of text 1")):
        (block,) = blocks(pa.array([line]))
        assert got[s] == block.hashes.tobytes()
