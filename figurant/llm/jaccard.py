"""Near-duplicate documents by Jaccard similarity of word shingles, with vertical partitioning.

The global order of shingles is that of their 64-bit hashes. It is cut into fragments, the
number of which grows with a document's set. Two sets that differ in at most h shingles agree
on all but h fragments, so linked documents share one of their first h + 1 non-empty
fragments: those are the join keys (small sets use single shingles, the finest fragments).
Documents with a common key are compared with the key's hub: texts travel compressed, partial
overlaps are counted for each of ``FRAGMENTS`` fragments of the global order, and summed per pair
by an aggregate. Documents that didn't join their hub's component are then compared with all
others at that hub, in blocks, whose overlaps are counted by fragment too. Documents with equal
sets are one class from the start, and no list of pairs within a group is ever made. Before sets
are fetched, pairs are screened by a parity bitmap of each set: bits in which two bitmaps differ
are at most the shingles in which the sets differ, so no link is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figurant.llm.embeddings import _pairs, whole_groups
from figurant.llm.stages import WORD, arrow_map, components, discard, stage
from figurant.llm.words import Block, blocks, mix, pack

#: The query's shingles and percent of similarity; the pipeline's are five words and 80.
WORDS, PERCENT = 3, 90
#: Sets of fewer shingles use single shingles as keys.
SMALL = 64
#: Fragments of the global order by which overlaps with a hub are counted and summed (a power
#: of two); documents and shingles of a block (on average); shingles of a fragment that blocks
#: count at a time.
FRAGMENTS, BLOCK_DOCS, BLOCK_SHINGLES, STRIP = 4, 256, 1 << 18, 2048

#: 64-bit words of a parity bitmap.
BITMAP = 4

_SECOND, _THIRD = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_BITS = [f"b{i}" for i in range(BITMAP)]


def differing(n: np.ndarray, percent: int) -> np.ndarray:
    """The most shingles by which a set of ``n`` can differ from one that it links with."""
    return n * (100 - percent) // percent


def cut_bits(n: np.ndarray, percent: int) -> np.ndarray:
    """log2 of the number of fragments for a set of ``n``; 64 where shingles stand alone. Past
    ``SMALL`` there are 1.25 to 2.5 fragments for each that must agree or differ."""
    need = np.maximum(1.25 * (differing(n, percent) + 1), 1)
    return np.where(n < SMALL, 64, np.ceil(np.log2(need)).astype(np.int64))


def shingle_sets(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each document's distinct shingles, in order. A document of fewer
    than ``k`` words has its whole sequence as one; one without words has none."""
    at, grams = block.grams(k)
    doc = block.doc_of(at)
    short = np.flatnonzero((block.n_words > 0) & (block.n_words < k))
    if len(short):
        whole = block.spans(block.words_of[short], block.words_of[short + 1], 0x5851F42D)
        doc, grams = np.concatenate([doc, short]), np.concatenate([grams, whole])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return doc[new], grams[new]


def _keys(doc: np.ndarray, grams: np.ndarray, bits: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of the first ``keep[d]`` non-empty fragments of each document."""
    if not len(doc):
        return doc, grams
    b = bits[doc]
    part = grams >> (64 - b).astype(np.uint64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
    at = np.flatnonzero(new)
    owner = doc[at]
    first = np.searchsorted(owner, owner)
    use = np.arange(len(at)) - first < keep[owner]
    total = np.add.reduceat(mix(grams), at)
    key = mix(total + mix(part[at] * np.uint64(0x9E3779B97F4A7C15) + b[at].astype(np.uint64)))
    return owner[use], key[use]


def bitmaps(doc: np.ndarray, grams: np.ndarray, n_docs: int) -> np.ndarray:
    """The parity bitmap of each document: each shingle flips one of its bits."""
    out = np.zeros((BITMAP, n_docs), np.uint64)
    if len(doc):
        place = mix(grams ^ _THIRD)
        bit = np.uint64(1) << (place & np.uint64(63))
        word = (place >> np.uint64(32)) % np.uint64(BITMAP)
        at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        for w in range(BITMAP):
            out[w, doc[at]] = np.bitwise_xor.reduceat(np.where(word == w, bit, np.uint64(0)), at)
    return out


def profiles(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """A row per document: doc_id, mark (hash of the text), n (set size), s, s2 (128-bit hash
    of the set; ``s`` is its node's id), the words of its bitmap, keys (array<long>)."""

    def run(batches):
        for batch in batches:
            ids, marks = batch.column("doc_id"), batch.column("mark")
            for block in blocks(batch.column("text"), lower=True):
                doc, grams = shingle_sets(block, k)
                n = np.bincount(doc, minlength=block.n_docs)
                sums = []
                for seed in (np.uint64(0), _SECOND):
                    total = np.append(np.uint64(0), np.cumsum(mix(grams ^ seed), dtype=np.uint64))
                    bounds = np.append(0, np.cumsum(n))
                    sums.append(mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64)))
                h = differing(n, percent)
                keep = np.where(h > 0, h + 1, 0)
                bits, up = cut_bits(n, percent), cut_bits(n * 100 // percent, percent)
                parts = [_keys(doc, grams, bits, keep)]
                if (more := (up != bits) & (h > 0)).any():  # a larger partner has finer fragments
                    parts.append(_keys(doc[more[doc]], grams[more[doc]], up, keep))
                owner, key = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(owner, kind="stable")
                starts = np.searchsorted(owner[order], np.arange(block.n_docs + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(key[order].view(np.int64)))
                rows = slice(block.first, block.last)
                yield pa.RecordBatch.from_arrays([ids[rows], marks[rows], pa.array(n.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (*sums, *bitmaps(doc, grams, block.n_docs))), lists], ["doc_id", "mark", "n", "s", "s2", *_BITS, "keys"])

    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return arrow_map(docs, run, f"doc_id long, mark long, n int, s long, s2 long, {', '.join(f'{b} long' for b in _BITS)}, keys array<long>")


def packed_texts(docs: DataFrame) -> DataFrame:
    """mark, packed, n_bytes: the texts, compressed; equal ones are repeated."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("mark"), *pack(batch.column("text"))], ["mark", "packed", "n_bytes"])

    texts = docs.where("text <> ''").select("text", F.xxhash64("text").alias("mark"))
    return arrow_map(texts, run, "mark long, packed binary, n_bytes long")


def _sets(part: pd.DataFrame, k: int) -> list[np.ndarray]:
    """The shingle sets of packed texts."""
    codec, out = pa.Codec("zstd"), []
    for z, size in zip(part.packed, part.n_bytes, strict=True):
        (block,) = blocks(pa.array([codec.decompress(z, int(size), asbytes=True)], pa.large_binary()), lower=True, limit=1 << 62)
        out.append(shingle_sets(block, k)[1])
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all left with all right sets. The global order of shingles is cut
    into fragments that hold about ``STRIP`` of these shingles; partial overlaps are counted in
    each and summed."""
    words = np.unique(np.concatenate([*left, np.zeros(0, np.uint64)]))  # others can't overlap
    rows = []
    for part in (left, right):
        found = []
        for x in part:
            f = np.searchsorted(words, x)
            found.append(f[(f < len(words)) & (words[np.minimum(f, len(words) - 1)] == x)] if len(words) else f[:0])
        owner, at = np.repeat(np.arange(len(part)), [len(f) for f in found]), np.concatenate([*found, np.zeros(0, np.int64)])
        order = np.argsort(at, kind="stable")
        rows.append((owner[order], at[order]))
    total = np.zeros((len(left), len(right)))
    cuts = 1 << max(0, int(np.ceil(np.log2(max(1, len(words)) / STRIP))))
    bounds = np.searchsorted(words, np.array([k * 2**64 // cuts for k in range(cuts)], np.uint64)).tolist() + [len(words)]
    for low, high in zip(bounds, bounds[1:], strict=False):
        dense = []
        for (owner, at), part in zip(rows, (left, right), strict=True):
            i, j = np.searchsorted(at, [low, high])
            x = np.zeros((len(part), high - low), np.float32)
            x[owner[i:j], at[i:j] - low] = 1
            dense.append(x)
        total += dense[0] @ dense[1].T
    return total


def _links(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    shared = overlaps(left, right)
    sizes = [np.array([len(x) for x in part], np.float64) for part in (left, right)]
    return 100 * shared >= percent * (sizes[0][:, None] + sizes[1][None, :] - shared)


def _with_hub(k: int):
    """a, b, fragment, shared, total: the partial overlaps of a block's documents with their hub,
    which is one of its rows, and the sum of both sets' sizes."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        hub, rest = g[g.s == g.hub], g[g.s != g.hub]
        if hub.empty or rest.empty:
            return pd.DataFrame({c: [] for c in ("a", "b", "fragment", "shared", "total")}, dtype="int64")
        (own,), sets = _sets(hub[:1], k), _sets(rest, k)
        cuts = np.array([f * 2**64 // FRAGMENTS for f in range(1, FRAGMENTS)], np.uint64)
        shared = np.zeros((len(sets), FRAGMENTS), np.int64)
        for i, x in enumerate(sets):
            at = np.minimum(np.searchsorted(own, x), len(own) - 1)
            shared[i] = np.diff(np.searchsorted(x[own[at] == x], cuts), prepend=0, append=(own[at] == x).sum())
        i, f = np.nonzero(shared)
        s, total = rest.s.to_numpy(), np.array([len(x) for x in sets]) + len(own)
        return pd.DataFrame({"a": s[i], "b": hub.s.iloc[0], "fragment": f, "shared": shared[i, f], "total": total[i]}, dtype="int64")

    return run


def _compare(k: int, percent: int):
    """All outsiders of a block against all documents of another: links that join components."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out, all_ = g[g.outsider], g[~g.outsider]
        if out.empty or all_.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        a, b = np.nonzero(_links(_sets(out, k), _sets(all_, k), percent))
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := top.get(x, x)) != x:
                top[x] = x = top.get(y, y)
            return x

        made, left, right = [], out.component.to_numpy(), all_.component.to_numpy()
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            p, q = find(int(left[i])), find(int(right[j]))
            if p != q:
                top[p] = q
                made.append((int(left[i]), int(right[j])))
        return pd.DataFrame(made, columns=["a", "b"], dtype="int64")

    return run


def _labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``nodes`` (with ``s``) and the component of each: its own id where it has no link."""
    return nodes.join(found.withColumnRenamed("id", "s"), "s", "left").withColumn("component", F.coalesce("component", "s"))


def _may_link(percent: int) -> Column:
    """Whether sizes and bitmaps allow a link of ``s`` and ``hub``."""
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"hub_{b}"))) for b in _BITS[1:]), F.bit_count(F.col(_BITS[0]).bitwiseXOR(F.col(f"hub_{_BITS[0]}"))))
    total = F.col("n") + F.col("hub_n")
    return (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")) & (apart * (100 + percent) <= total * (100 - percent))


def _parts(more: list[Column] = ()) -> list[Column]:
    """Aggregates of rows (s, n): their number m, and the blocks to deal them to."""
    parts = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    return [F.count("*").alias("m"), parts.alias("parts"), *more]


def _tasks(met: DataFrame, *carried: str) -> DataFrame:
    """From rows (hub, s, n, outsider, ``carried``): hub, x, y, s, ``carried``, outsider. Each
    outsider of block x meets each document of block y, its own block too. Hubs without
    outsiders, or with one document, give no tasks."""
    open_ = met.groupBy("hub").agg(*_parts([F.count_if("outsider").alias("out")])).where("out > 0 and m > 1").drop("out", "m")
    r = met.join(open_, "hub").withColumn("own", F.pmod(F.xxhash64("s"), F.col("parts")))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    asks = r.where("outsider").select("hub", F.col("own").alias("x"), F.col("other").alias("y"), "s", *carried, F.lit(True).alias("outsider"))
    return asks.union(r.select("hub", F.col("other").alias("x"), F.col("own").alias("y"), "s", *carried, F.lit(False).alias("outsider")))


def _screened(at_hub: DataFrame, percent: int) -> DataFrame:
    """hub, s: the documents that can't link with their hub, but by size and bitmap may link
    with another document there, and those others."""
    tasks = _tasks(at_hub.withColumn("outsider", ~F.col("near")), "n", *_BITS)

    def run(batches):
        for t, group in whole_groups(batches, ["hub", "x", "y"]):
            n, asks, s = (t.column(c).to_numpy(zero_copy_only=False) for c in ("n", "outsider", "s"))
            bits = [t.column(b).to_numpy().view(np.uint64) for b in _BITS]
            has = np.zeros(len(group), bool)
            for i, j in _pairs(group, np.zeros(len(group), bool), asks):
                use = (s[i] != s[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
                i, j = i[use], j[use]
                apart = sum(np.bitwise_count(b[i] ^ b[j]).astype(np.int64) for b in bits)
                use = apart * (100 + percent) <= (n[i].astype(np.int64) + n[j]) * (100 - percent)
                has[i[use]] = has[j[use]] = True
            yield from t.select(["hub", "s"]).filter(pa.array(has)).to_batches()

    dealt = tasks.repartition("hub", "x", "y").sortWithinPartitions("hub", "x", "y")
    return arrow_map(dealt, run, "hub long, s long").distinct()


def _classified(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, mark, n, component, component_id for each row, the last two null where n = 0; and
    the tables behind that."""
    docs = docs.select("doc_id", "text")
    rows = stage(profiles(docs, k, percent))
    same = ["n", "s", "s2"]
    firsts = [F.first(c).alias(c) for c in _BITS]
    classes = stage(rows.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.min("mark").alias("mark"), *firsts))
    posted = rows.where("n > 0").select("s", F.explode("keys").alias("key"))
    # keys of one class alone, however many copies it has, lead nowhere
    often = posted.groupBy("key").agg(F.min("s").alias("x"), F.max("s").alias("y")).where("x <> y").select("key")
    shared = stage(posted.join(often, "key").distinct())
    # a key's hub: the class with most shared keys, which edited copies of it have fewer of
    score = shared.groupBy("s").agg(F.count("*").cast("int").alias("score"))
    hubs = shared.join(score, "s").groupBy("key").agg(F.max(F.struct("score", "s"))["s"].alias("hub"))
    slim = classes.select("s", "n", *_BITS)
    at_hub = shared.join(hubs, "key").where("s <> hub").select("s", "hub").distinct().join(slim, "s")
    at_hub = at_hub.join(slim.select(*(F.col(c).alias(f"hub_{c}" if c != "s" else "hub") for c in slim.columns)), "hub")
    at_hub = stage(at_hub.withColumn("near", _may_link(percent)).select("hub", *slim.columns, "near"))
    discard(shared)
    stars = at_hub.where("near").select("s", "hub", "n")
    others = stage(_screened(at_hub, percent))
    ends = stars.select("s").union(stars.select("hub")).union(others.select("s")).distinct()
    wanted = classes.join(ends, "s", "left_semi").select("s", "mark")
    texts = packed_texts(docs).join(wanted, "mark").groupBy("s").agg(F.first("packed").alias("packed"), F.first("n_bytes").alias("n_bytes"))
    texts = stage(texts)

    count = stars.groupBy("hub").agg(*_parts()).drop("m")
    placed = stars.join(count, "hub").select("hub", F.pmod(F.xxhash64("s"), F.col("parts")).alias("x"), "s")
    every = count.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("x"), F.col("hub").alias("s"))
    partial = placed.union(every).join(texts, "s").groupBy("hub", "x").applyInPandas(_with_hub(k), "a long, b long, fragment int, shared long, total long")
    summed = partial.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("total").alias("total"))
    links = stage(summed.where(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b"))
    first = components(links)

    # what isn't in its hub's component meets everything at that hub
    members = stars.select("s", "hub").union(others.select("s", "hub")).distinct().join(classes.select("s", "n"), "s")
    met = _labelled(members, first).join(first.select(F.col("id").alias("hub"), F.col("component").alias("hub_component")), "hub", "left")
    met = stage(met.select("hub", "s", "n", "component", (F.col("component") != F.coalesce("hub_component", "hub")).alias("outsider")))
    discard(at_hub, others, links)
    tasks = _tasks(met, "component").join(texts, "s")
    rest = stage(tasks.groupBy("hub", "x", "y").applyInPandas(_compare(k, percent), "a long, b long"))
    discard(met, texts)
    second = components(rest)
    discard(rest)
    joined = first.join(second.select(F.col("id").alias("component"), F.col("component").alias("c2")), "component", "left").select("id", F.coalesce("c2", "component").alias("component"))
    alone = second.join(first, "id", "left_anti").select("id", "component")
    named = _labelled(classes.select(*same, "rep"), joined.union(alone))
    best = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(best, "component").select(*same, "component", "component_id")
    out = rows.select("doc_id", "mark", *same).join(named, same, "left").select("doc_id", "mark", "n", "component", "component_id")
    return out, [rows, classes, first, second]


def linked(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of ``docs``.

    A document's set holds the distinct ``k``-word shingles of its text after lower-casing
    A-Z (of a shorter text its whole sequence; none without words). Two documents link when
    100 * intersection >= percent * union; empty sets link with nothing. ``component_id`` is
    the smallest doc_id reachable by links, the document's own included; ``kept`` marks one
    row id of each component, that with doc_id = component_id.

    Null texts count as empty. Rows with equal ids are documents of their own. A null doc_id
    takes part in links but never names a component, unless it has no other: then
    component_id is null (and kept false). An empty table gives no rows; further columns are
    ignored. Shingles are compared by 64-bit hashes.
    """
    out, _ = _classified(docs, k, percent)
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null last), of
    equal ids that of the smallest text hash. Documents without words all stay. All columns
    are kept, whatever their names."""
    key = ["d", "none", "mark"]
    rows, held = _classified(docs, k, percent)
    chosen = rows.where("n > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("d"), "mark")).alias("c")).select("c.*")
    chosen = stage(chosen)  # the texts are dealt out when all else is done
    discard(*held)
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("mark"))
    wordless = ~F.coalesce("row.text", F.lit("")).rlike(WORD)
    joined = marked.join(chosen.withColumn("chosen", F.lit(True)), key, "left").where(wordless | F.col("chosen"))
    again = F.row_number().over(Window.partitionBy(*key).orderBy("chosen"))
    return joined.withColumn("again", again).where(wordless | (F.col("again") == 1)).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
