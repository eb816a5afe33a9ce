"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learnt on a bounded sample so that the signs of the
rotated values make balanced codes. Each table takes some of the code's bits; vectors enter the
buckets of those bits and of all values one bit away, so two codes meet in a table if they
differ in at most two of its bits. Tables are as many, and as wide, as it takes to lose no more
than ``MISSED`` of the pairs at the least cosine however large the collection is. Pairs within a
Hamming radius are reranked by the cosine of the original vectors in double precision. Vectors
of other lengths than the commonest have codes of random hyperplanes, and buckets of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figurant.llm.stages import arrow_map, components, discard, least_labels, stage
from figurant.llm.words import mix

COSINE = 0.9
#: Bits of a code, Hamming radius of candidates, and vectors that the rotation is learnt on.
BITS, RADIUS, SAMPLE, ROUNDS = 64, 20, 10_000, 40
#: Chance of a pair at the least cosine to meet in no table.
MISSED = 0.005
#: Vectors of a block of a large bucket; blocks are compared two at a time.
BLOCK = 1024


def units(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; components of any size neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hyperplanes(d: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) for vectors of ``d`` components without learning."""
    return np.zeros(d), np.random.default_rng(d).normal(size=(d, bits))


def learn(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of unit vectors: principal axes, then the rotation that brings the
    projected sample nearest to its own signs, found by turns (codes, then Procrustes)."""
    x = units(sample)
    mean = x.mean(axis=0)
    bits = min(bits, x.shape[1])
    _, _, axes = np.linalg.svd((x - mean).T @ (x - mean))
    axes = axes[:bits].T
    v = (x - mean) @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(rounds):
        signs = np.where(v @ turn >= 0, 1.0, -1.0)
        a, _, b = np.linalg.svd(v.T @ signs)
        turn = a @ b
    return mean, axes @ turn


def encode(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes (uint64) of vectors, the first bit highest."""
    signs = ((units(x) - mean) @ projection) >= 0
    bits = projection.shape[1]
    return (signs.astype(np.uint64) << np.arange(bits - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fewest(bits: int, cosine: float = COSINE, missed: float = MISSED) -> int:
    """Fewest tables for codes of ``bits`` bits in which a pair at ``cosine`` is lost with a
    chance of ``missed`` at most: a bit differs with the chance angle / pi, and a lost pair
    differs in three bits or more of every table."""
    p = math.acos(cosine) / math.pi
    for t in range(1, bits + 1):
        w = -(-bits // t)
        met = sum(math.comb(w, k) * p**k * (1 - p) ** (w - k) for k in range(min(w, 2) + 1))
        if (1 - met) ** t <= missed:
            return t
    return bits


def needed(width: int, bits: int, cosine: float = COSINE, missed: float = MISSED) -> int:
    """Fewest tables of ``width`` of the ``bits`` bits, chosen at random, in which a pair at
    ``cosine`` is lost with a chance of ``missed`` at most. Codes differ in k bits with a
    binomial chance; of those, at most two must be among a table's."""
    p = math.acos(cosine) / math.pi
    chance = np.array([math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(bits + 1)])
    lost = np.array([1 - sum(math.comb(k, j) * math.comb(bits - k, width - j) for j in range(min(k, 2) + 1) if width - j <= bits - k) / math.comb(bits, width) for k in range(bits + 1)])
    tables = 1
    while float(chance @ lost**tables) > missed and tables < 4096:
        tables += 1
    return tables


def layout(count: int, bits: int, cosine: float = COSINE) -> list[int]:
    """The mask of each table's bits. Buckets are kept small by wider tables as the collection
    grows, and there are more of them, so that the share of pairs that is lost stays the same."""
    least = fewest(bits, cosine)
    width = min(bits // 2, math.ceil(math.log2(max(2, count))) - 6)
    if width <= -(-bits // least):
        tables = max(least, bits // max(8, math.ceil(math.log2(max(2, count)))))
        cuts = [round(i * bits / tables) for i in range(tables + 1)]
        return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    r = np.random.default_rng(width)
    return [sum(1 << int(b) for b in r.choice(bits, width, replace=False)) for _ in range(needed(width, bits, cosine))]


def _bucket(table: np.ndarray, part: np.ndarray, d: np.ndarray) -> np.ndarray:
    """A 64-bit name of a bucket: the values ``part`` of a table's bits, of vectors of length d."""
    return mix(part + mix(np.asarray(table).astype(np.uint64) << np.uint64(40) | np.asarray(d).astype(np.uint64)))


def _probes(codes: np.ndarray, mask: int) -> np.ndarray:
    flips = np.array([0, *(1 << b for b in range(64) if mask >> b & 1)], np.uint64)
    return (codes & np.uint64(mask))[:, None] ^ flips[None, :]


def meeting(a: np.ndarray, b: np.ndarray, tables: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The one (table, value) in which each pair of codes is counted: the first table where
    they meet, and there the least value of both; table -1 where they don't meet."""
    where, value = np.full(len(a), -1), np.zeros(len(a), np.uint64)
    for t in range(len(tables) - 1, -1, -1):
        x, y = a & np.uint64(tables[t]), b & np.uint64(tables[t])
        diff = x ^ y
        low = diff & (~diff + np.uint64(1))  # the lowest differing bit
        apart = np.bitwise_count(diff)
        least = np.where(apart == 2, np.minimum(x ^ low, y ^ low), np.minimum(x, y))
        met = apart <= 2
        where[met], value[met] = t, least[met]
    return where, value


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups from batches sorted by ``keys``, with each row's group."""
    held: list[pa.RecordBatch] = []

    def numbered(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.cumsum(new)

    for batch in batches:
        held.append(batch)
        t = pa.Table.from_batches(held).combine_chunks()
        g = numbered(t)
        if len(g) and g[-1]:
            cut = int(np.searchsorted(g, g[-1]))
            yield t.slice(0, cut), g[:cut]
            held = t.slice(cut).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        if t.num_rows:
            yield t, numbered(t)


def _pairs(group: np.ndarray, same: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within groups, by distance. In groups of two blocks only pairs across."""
    n, d = len(group), 1
    at = np.arange(n)
    while True:
        at = at[at + d < n]
        at = at[group[at] == group[at + d]]
        if not len(at):
            return
        use = at[same[at] | (side[at] != side[at + d])]
        if len(use):
            yield use, use + d
        d += 1


def _blocked(rows: DataFrame) -> DataFrame:
    """``rows`` (with bucket and s) of buckets of two or more, as groups (bucket, x, y) of at
    most about two blocks; ``side`` is the row's own block."""
    count = rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    r = rows.join(count, "bucket").withColumn("parts", F.ceil(F.col("m") / BLOCK)).drop("m")
    r = r.withColumn("side", F.pmod(F.xxhash64("s"), F.col("parts")))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return r.withColumn("x", F.least("side", "other")).withColumn("y", F.greatest("side", "other")).drop("other")


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")


class _Group:
    """Rows of buckets (code and length of each), and the pairs of them that are counted here."""

    def __init__(self, t: pa.Table, group: np.ndarray, tables: dict[int, list[int]], main: int, radius: int):
        self.group, self.same, self.side = group, t.column("x").to_numpy() == t.column("y").to_numpy(), t.column("side").to_numpy()
        self.bucket, self.codes = (t.column(c).to_numpy().view(np.uint64) for c in ("bucket", "code"))
        self.d, self.tables, self.main, self.radius = t.column("d").to_numpy(), tables, main, radius

    def pairs(self):
        for i, j in _pairs(self.group, self.same, self.side):
            close = (np.bitwise_count(self.codes[i] ^ self.codes[j]) <= self.radius) & (self.d[i] == self.d[j])
            i, j = i[close], j[close]
            for main in (True, False):
                use = (self.d[i] == self.main) == main
                if use.any():
                    p, q = i[use], j[use]
                    where, value = meeting(self.codes[p], self.codes[q], self.tables[main])
                    here = _bucket(where, value, self.d[p]) == self.bucket[p]
                    yield p[here], q[here]


_MET = ["bucket", "x", "y", "side", "s"]


def candidates(coded: DataFrame, tables: dict[int, list[int]], main: int, radius: int) -> DataFrame:
    """bucket, x, y, side, s: the vectors of each bucket that have a candidate there, each pair
    in one bucket only. ``tables`` has the masks for vectors of length ``main`` (True) and for
    others (False)."""

    def enter(batches):
        for batch in batches:
            s, codes, d = batch.column("s").to_numpy(), batch.column("code").to_numpy().view(np.uint64), batch.column("d").to_numpy()
            for own in (True, False):
                at = np.flatnonzero((d == main) == own)
                for t, mask in enumerate(tables[own] if len(at) else ()):
                    b = _bucket(np.array(t), _probes(codes[at], mask), d[at][:, None])
                    n = b.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(b.ravel().view(np.int64)), pa.array(np.repeat(s[at], n)), pa.array(np.repeat(codes[at].view(np.int64), n)), pa.array(np.repeat(d[at], n))], ["bucket", "s", "code", "d"])

    def meet(batches):
        for t, group in whole_groups(batches, ["bucket", "x", "y"]):
            has = np.zeros(len(group), bool)
            for i, j in _Group(t, group, tables, main, radius).pairs():
                has[i] = has[j] = True
            yield from t.select(_MET).filter(pa.array(has)).to_batches()

    entered = stage(arrow_map(coded, enter, "bucket long, s long, code long, d int"))
    out = stage(arrow_map(_sorted(_blocked(entered)), meet, "bucket long, x long, y long, side long, s long"))
    discard(entered)
    return out


def reranked(found: DataFrame, vectors: DataFrame, tables: dict[int, list[int]], main: int, radius: int, cosine: float) -> DataFrame:
    """s, links, root: for each vector of a bucket the rows it links with there (``links``, by
    the sizes of their classes), and one vector of its component there."""

    def rank(batches):
        for t, group in whole_groups(batches, ["bucket", "x", "y"]):
            size, s, d = t.column("size").to_numpy(), t.column("s").to_numpy(), t.column("d").to_numpy()
            place, by_length = np.zeros(len(s), np.int64), {}
            for k in np.unique(d).tolist():
                own = np.flatnonzero(d == k)
                place[own] = np.arange(len(own))
                values = t.column("v").take(pa.array(own)).combine_chunks().flatten()
                by_length[k] = units(np.array(values, np.float64).reshape(len(own), k))
            links, left, right = np.zeros(len(s), np.int64), [], []
            for i, j in _Group(t, group, tables, main, radius).pairs():
                near = np.zeros(len(i), bool)
                for k, v in by_length.items():
                    own = d[i] == k
                    near[own] = np.einsum("ij,ij->i", v[place[i[own]]], v[place[j[own]]]) >= cosine
                i, j = i[near], j[near]
                np.add.at(links, i, size[j])
                np.add.at(links, j, size[i])
                left.append(i)
                right.append(j)
            if left:
                root = least_labels(len(s), np.concatenate(left), np.concatenate(right))
                use = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(s[use]), pa.array(links[use]), pa.array(s[root[use]])], ["s", "links", "root"])

    return arrow_map(_sorted(found.join(vectors, "s")), rank, "s long, links long, root long")


def linked(rows: DataFrame, cosine: float = COSINE, radius: int = RADIUS) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per row of ``rows`` (vec_id, embedding).

    Vectors link at a cosine of ``cosine`` or more, computed in double precision; no pair below
    it is linked, and pairs at or above it are found if their codes meet in a table within
    ``radius`` bits (recall is measured in the tests, for collections of any size: 0.99 at a
    cosine of 0.9, more above it). Vectors of different lengths don't link.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest vec_id
    reachable, the own one included. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing. Equal vectors are one class. A null vec_id takes part but names no component. An empty
    table gives no rows; further columns are ignored.
    """
    v = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    fit = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("v", lambda x: x != 0), F.lit(False))
    v = v.withColumn("fit", fit).withColumn("s", F.when(F.col("fit"), F.xxhash64("v")))
    base = stage(v)
    lengths = base.where("fit").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    main = int(lengths["d"])
    classes = stage(base.where("fit").groupBy("s").agg(F.first("v").alias("v"), F.count("*").alias("size"), F.min("vec_id").alias("rep")))
    sample = np.array([r["v"] for r in classes.where(F.size("v") == main).select("s", "v").orderBy("s").limit(SAMPLE).collect()])
    learnt = learn(sample)
    count = classes.count()
    tables = {True: layout(count, learnt[1].shape[1], cosine), False: layout(count, BITS, cosine)}

    def code(batches):
        for batch in batches:
            d = batch.column("v").value_lengths().to_numpy().astype(np.int32)
            codes = np.zeros(len(d), np.uint64)
            for k in np.unique(d).tolist():
                at = np.flatnonzero(d == k)
                x = np.array(batch.column("v").take(pa.array(at)).flatten(), np.float64).reshape(len(at), k)
                codes[at] = encode(x, *(learnt if k == main else hyperplanes(k)))
            yield pa.RecordBatch.from_arrays([batch.column("s"), batch.column("v"), batch.column("size"), pa.array(codes.view(np.int64)), pa.array(d)], ["s", "v", "size", "code", "d"])

    coded = stage(arrow_map(classes.select("s", "v", "size"), code, "s long, v array<double>, size long, code long, d int"))
    found = candidates(coded.select("s", "code", "d"), tables, main, radius)
    near = stage(reranked(found, coded, tables, main, radius, cosine))
    discard(found, coded)
    component = components(near.select(F.col("s").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "s")
    links = near.groupBy("s").agg(F.sum("links").alias("links"))
    named = classes.select("s", "size", "rep").join(links, "s", "left").join(component, "s", "left").withColumn("component", F.coalesce("component", "s"))
    best = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(best, "component").select("s", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    out = base.select("vec_id", "s").join(named, "s", "left")
    own = F.when(F.col("s").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
