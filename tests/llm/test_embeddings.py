import math

import numpy as np
import pytest

from figurant.llm import embeddings


def brute(rows, cosine):
    fit = [v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    at = [i for i, f in enumerate(fit) if f]
    m = [np.array(rows[i][1], np.float32).astype(float) for i in at]
    m = [v / np.linalg.norm(v) for v in m]
    near = np.array([[i != j and len(a) == len(b) and a @ b >= cosine for j, b in enumerate(m)] for i, a in enumerate(m)])
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in zip(*np.nonzero(near)):
        top[find(at[a])] = find(at[b])
    links = dict(zip(at, near.sum(axis=1).tolist()))
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, links.get(i, 0), low.get(find(i))) for i, (d, _) in enumerate(rows)]


def made(seed):
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(60):
        base = r.normal(size=24)
        for _ in range(int(r.choice([1, 1, 2, 3, 30]))):
            rows.append((len(rows), (base + r.normal(size=24) * r.choice([0.0, 0.05, 0.15])).tolist()))
    rows += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [1.0] * 23 + [math.nan]), (2004, [math.inf] * 24), (2005, [1.0] * 23 + [None]), (2006, [1.0, 2.0]), (2009, [1.0, 2.001]), (2010, [2.0, -1.0]), (2011, [-1.0] * 5), (2012, [-1.0] * 4 + [-1.1])]
    rows += [(2007, rows[4][1]), (None, rows[5][1]), rows[6], (2008, [3 * x for x in rows[7][1]])]
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_recall_and_components(spark, monkeypatch, seed):
    if seed:
        monkeypatch.setattr(embeddings, "BLOCK", 8)
    rows = made(seed)
    frame = spark.createDataFrame([(*x, 1, "s") for x in rows], "vec_id long, embedding array<float>, size int, code string").repartition(3)
    out = embeddings.linked(frame)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = {(str(r[0]), r[1], r[2]) for r in map(tuple, out.collect())}
    want = {(str(a), b, c) for a, b, c in brute(rows, 0.9)}
    total, found = sum(x[1] for x in want), sum(x[1] for x in got)
    assert len(out.collect()) == len(rows) and 0.97 * total <= found <= total
    assert len(want & got) >= 0.9 * len(want)
    assert {("2006", 1, 2006), ("2009", 1, 2006), ("2010", 0, 2010), ("2011", 1, 2011), ("2012", 1, 2011)} <= got
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in out.collect())


def test_meeting_is_one_bucket_of_both():
    r = np.random.default_rng(3)
    tables = embeddings.layout(1000, 64)
    a = r.integers(0, 2**64, 500, dtype=np.uint64)
    b = a ^ np.array([sum(1 << int(k) for k in set(r.integers(0, 64, r.integers(0, 20)))) for _ in a], np.uint64)
    where, bucket = embeddings.meeting(a, b, tables)
    for x, y, t, z in zip(a, b, where, bucket):
        both = [set(embeddings._probes(np.array([x]), s)[0].tolist()) & set(embeddings._probes(np.array([y]), s)[0].tolist()) for s in tables]
        first = next((k for k, s in enumerate(both) if s), -1)
        assert t == first and (t < 0 or int(z) in both[t])


def test_empty_and_unfit_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.linked(spark.createDataFrame([], schema)).count() == 0
    assert embeddings.linked(spark.createDataFrame([(1, None), (None, [0.0])], schema)).collect()[0].n_links == 0
    assert embeddings.linked(spark.createDataFrame([(1, [1.0])], schema)).collect()[0].component_id == 1


def planted(x, cosine, seed):
    """A partner for each unit vector at exactly ``cosine``."""
    d = np.random.default_rng(seed).normal(size=x.shape)
    d -= (d * x).sum(axis=1, keepdims=True) * x
    return cosine * x + math.sqrt(1 - cosine**2) * d / np.linalg.norm(d, axis=1, keepdims=True)


def test_components_of_any_size(spark):
    rows = [(1, [1e200, 2e200, 0.0]), (2, [1e200, 2.1e200, 0.0]), (3, [1e-300, -1e-300, 1e-310]), (4, [2e-300, -2e-300, 0.0]), (5, [0.0, 0.0, 5.0])]
    out = embeddings.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in out} == {(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5)}


@pytest.mark.parametrize("bits", [16, 32, 64])
@pytest.mark.parametrize("count", [100, 2000, 47_000, 70_000, 10**6, 3_000_000, 10**9, 2**33])
def test_recall_does_not_fall_with_the_count(bits, count):
    r = np.random.default_rng(bits)
    x = r.normal(size=(4000, bits)) * np.linspace(1, 2, bits) + r.normal(size=bits)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, projection = embeddings.learn(x)
    tables = embeddings.layout(count, bits)
    for cosine in (0.9, 0.91, 0.92):
        a, b = (embeddings.encode(v, mean, projection) for v in (x, planted(x, cosine, count % 97)))
        met = embeddings.meeting(a, b, tables)[0] >= 0
        assert (met & (np.bitwise_count(a ^ b) <= embeddings.RADIUS)).mean() >= 0.98, cosine
