import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from figurant.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 1) for i, t, s in rows], SCHEMA)


def made(n, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = "hot" if r.random() < 0.35 else r.choice(["a", "b", "Z", "é", "", None])
        k = r.choice([0, 1, 3, 40, 90, 700])
        rows.append((i, " ".join(f"w{i}_{j}" for j in range(k)) if k else r.choice([None, "", " \n"]), s))
    return rows


def water(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def check(spark, rows):
    out = mixing.mix(frame(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _, _ in rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    by_id = defaultdict(set)
    for i, _, s in rows:
        by_id[i].add(s)
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        if len(by_id[r.doc_id]) == 1:
            s, = by_id[r.doc_id]
            size[s] += r.size
            taken[s] += r.taken
            target[s] = r.target
            assert r.source_size >= r.size
    return size, taken, target


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_targets_and_takes(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "RUN_DOCS", 17)
    monkeypatch.setattr(mixing, "FAN", 8)
    size, taken, target = check(spark, made(200, seed))
    want = water(size)
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert 0 <= target[s] - taken[s] < 1.001


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 64, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))
        assert n < 64 or [r.p for r in got] != list(range(n))


def test_reruns_and_partitions_agree(spark):
    rows = made(120)
    a = sorted(map(str, mixing.mix(frame(spark, rows)).collect()))
    assert a == sorted(map(str, mixing.mix(frame(spark, rows[::-1]).repartition(7)).collect()))


def test_odd_tables(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    size, taken, _ = check(spark, [(1, None, None), (2, "", "a")])
    assert sum(taken.values()) == 0
    rows = [(5, "x y z", "a")] * 4 + [(None, "p q", None)] * 2
    out = mixing.mix(frame(spark, rows)).collect()
    assert len(out) == 6 and sum(r.taken for r in out) == 17 + 6
    assert {(r.size, r.source_size) for r in out} == {(3, 12), (2, 4)}


def test_mixed_documents_hold_what_was_taken(spark):
    rows = made(80) + [(3, "again and again", "a")] * 2
    docs = frame(spark, rows).withColumn("n_chars", F.lit(0).cast("long"))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got, want = defaultdict(int), defaultdict(int)
    texts = defaultdict(set)
    for i, t, _ in rows:
        texts[i] |= set((t or "").split())
    for r in mixed.collect():
        assert set(r.text.split()) <= texts[r.doc_id] and r.n_chars == len(r.text)
        got[r.doc_id] += len(r.text.split())
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.taken
    assert got == {k: v for k, v in want.items() if v}


def test_takes_against_a_plain_run(spark, monkeypatch):
    """Every slot of every source, one by one, in Python."""
    from struct import pack

    import xxhash

    monkeypatch.setattr(mixing, "RUN_DOCS", 17)

    def hashed(*values, seed=42):  # (format, value), as Spark folds them
        for kind, v in values:
            if v is not None:
                seed = xxhash.xxh64_intdigest(v.encode() if kind == "s" else pack(kind, v), seed)
        return seed - 2**64 if seed >= 2**63 else seed

    rows = made(150, 4)
    out = {r.doc_id: r for r in mixing.mix(frame(spark, rows)).collect()}
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    for rank, name in enumerate(names):
        docs = [(i, t, len((t or "").split())) for i, t, s in rows if s == name]
        runs = -(-len(docs) // 17)
        line = []
        for i, t, n in docs:
            dice = hashed(("<i", 0), ("<q", i), ("s", name), ("<q", hashed(("s", t))), ("<i", 0))
            if n:
                line.append((dice % runs, hashed(("<q", dice)), i, n))
        words = [i for _, _, i, n in sorted(line) for _ in range(n)]
        blocks = [words[k : k + 64] for k in range(0, len(words), 64)]
        want, full, taken, epoch = int(out[docs[0][0]].target), len(words) // 64, defaultdict(int), 0
        while want > 0:
            key = [("<i", 0), ("<q", rank), ("<q", epoch)]
            for j in range(len(blocks)):
                x = j
                for r in range(1, 9) if j < full else ():
                    other = (hashed(*key, ("<i", r)) % full - x) % full
                    if hashed(*key, ("<i", r), ("<q", max(x, other)), ("<i", 7)) & 1:
                        x = other
                block = blocks[x][: max(0, want)]
                want -= len(block)
                for i in block:
                    taken[i] += 1
            epoch += 1
        assert {i: taken[i] for i, _, _ in docs} == {i: out[i].taken for i, _, _ in docs}, name


def test_shards_hold_the_counts_that_were_drawn(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 40)
    docs = frame(spark, made(150, 5))
    sized, sources = mixing.prepared(docs)
    drawn = mixing.shard_counts(sources, 0).collect()
    total = defaultdict(int)
    for r in sorted(drawn, key=lambda r: (r.rank, r.shard)):
        assert r.first == total[r.rank]  # a shard's slots follow those of the ones before
        total[r.rank] += r["count"]
    shards = {r.shard for r in drawn}
    assert len(shards) >= 16
    hot = max(total, key=total.get)
    each = [r["count"] for r in drawn if r.rank == hot]
    assert max(each) < 3 * total[hot] / len(shards) + 10 and len(set(each)) > 3
    names = {r.source: r.rank for r in sources.collect()}
    rows, words = defaultdict(int), defaultdict(int)
    for r in mixing.mixed_blocks(docs).collect():
        rows[(names[r.source], r.shard)] += 1
        words[names[r.source]] += r.n_words
        assert len(r.text.split()) == r.n_words <= mixing.BLOCK
    assert rows == {(r.rank, r.shard): r["count"] for r in drawn}
    assert words == {r.rank: int(r.target) for r in sources.collect() if int(r.target)}
    other = mixing.shard_counts(sources, 1).collect()
    assert [r["count"] for r in other] != [r["count"] for r in drawn]


def test_halves_are_binomial(spark):
    for n in (1, 64, 100, 256, 5000):
        got = [r.k for r in spark.range(4000).select(mixing.halved(F.lit(n).cast("long"), F.col("id")).alias("k")).collect()]
        mean = sum(got) / len(got)
        assert 0 <= min(got) and max(got) <= n and abs(mean - n / 2) < 0.08 * n**0.5 + 0.02
        assert 0.9 < sum((k - n / 2) ** 2 for k in got) / len(got) / (n / 4) < 1.1


def test_columns_of_any_name(spark):
    rows = [(1, "x y z", "a", 1, 2, 3, 4), (2, "p q", None, 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k_mark int, `row` int, m int, `a.b` int")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and {tuple(r)[3:] for r in out.collect()} == {(1, 2, 3, 4)}
