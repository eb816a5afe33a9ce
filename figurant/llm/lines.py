"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, connected groups.

Lines are lower-cased (A-Z) and their white space is made even. Equal lines are one class. A
class has two SimHashes. One, of 64 bits over its words, is compared whole. The other has
``KEYS`` blocks, which are the join keys: a block is the SimHash of the line's pairs of
neighbouring words under weights so steep that each pair outweighs all lighter ones together
(the sum then has the signs of the heaviest pair, so no sum is needed), without the pairs that
touch an earlier block's. Edits change a block only if they touch its pair or bring a heavier
one, so alike lines nearly always agree on a block (README has the recall; the pigeonhole blocks
of a SimHash with even weights lose half of them and more). The words of classes that meet
in a block are then compared by edit distance.

A block with many classes (a common passage, a family of near copies) isn't compared pair by pair.
One pass over leaders joins families; among the rest, an edit changes two pairs of words at most,
so alike lines also share one of their rarest pairs, as many as may change and one more: lines
that share none of these are left out without loss (``Crowd``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figurant.llm.embeddings import _pairs, _sorted, whole_groups
from figurant.llm.stages import arrow_map, components, discard, identified, stage
from figurant.llm.words import Block, blocks, mix, pack, unpacked_texts

#: Least edit similarity in percent. Lines of under MIN_WORDS words can't be that alike to
#: another: one edit in four words or fewer leaves 75 percent at most.
PERCENT, MIN_WORDS = 80, 4
#: Blocks of a line. Lines of LONG words or more that meet are compared only if their 64-bit
#: SimHashes differ in at most RADIUS bits; in lines of APART words or more no two blocks' pairs
#: share a word.
KEYS, LONG, RADIUS, APART = 4, 20, 28, 8
#: Classes above which a bucket is a crowd; words of a block of a crowd, of which two are compared
#: at a time; pairs that are looked at together.
CROWD, HELD, AT_ONCE = 64, 1 << 19, 1 << 18
#: Bits of a line's words, by which unlike lines are told apart.
MARKS = 512

_KEY = ["d", "mark"]
_KEYS = [f"k{t}" for t in range(KEYS)]
_FOLDS = [f"f{t}" for t in range(KEYS // 2)]
_NONE = np.uint64(2**64 - 1)


def word_lines(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, line number, index of its first word) of each line that has a word; lines
    are those of a split at newlines, numbered from 0 in each document."""
    breaks = np.flatnonzero(block.raw == 10)
    doc = np.repeat(np.arange(block.n_docs), block.n_words)
    number = np.searchsorted(breaks, block.starts) - np.searchsorted(breaks, block.offsets)[doc]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
    at = np.flatnonzero(new)
    return doc[at], number[at], at


def weights(lengths: np.ndarray) -> np.ndarray:
    """Weight of a word by its length in bytes: short words are common, and would make the
    SimHashes of all lines of a language alike."""
    return np.square(np.clip(lengths, 3, 16) - 2).astype(np.int64)


#: The lowest bit of each of four 16-bit lanes.
_LANES = np.uint64(0x0001000100010001)


def simhash(hashes: np.ndarray, weight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SimHash of each run of weighted word hashes that starts at ``at``: bit by bit what the
    words of more than half the weight have. Four bits at a time are summed in the lanes of one
    number, which is exact while a line's weight fits a lane."""
    ends = np.append(at[1:], len(hashes))
    total = np.add.reduceat(weight, at)
    out, w, part = np.empty((len(at), 64), bool), weight.astype(np.uint64), np.empty(len(hashes), np.uint64)
    for k in range(16):
        np.right_shift(hashes, np.uint64(k), out=part)
        np.bitwise_and(part, _LANES, out=part)
        np.multiply(part, w, out=part)
        lanes = np.add.reduceat(part, at).astype("<u8", copy=False).view("<u2").reshape(-1, 4)
        out[:, k::16] = 2 * lanes.astype(np.int64) > total[:, None]
    for i in np.flatnonzero(total > 0xFFFF).tolist():
        part = slice(at[i], ends[i])
        bits = np.unpackbits(hashes[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[i] = 2 * (weight[part] @ bits.astype(np.int64)) > total[i]
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64).ravel()


def pair_blocks(hashes: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(line, ``KEYS``) blocks of each line, least value first: 64 bits that tell the heaviest
    pair of neighbouring words. Pairs of long words, which are rare, are heavier, ties by hash.
    The last value stands for none: a line has fewer blocks if it has few pairs, and none at
    all under ``MIN_WORDS`` words."""
    out = np.full((len(at), KEYS), _NONE)
    if not len(hashes):
        return out
    n = np.diff(np.append(at, len(hashes)))
    line = np.repeat(np.arange(len(at)), n)
    inner = np.flatnonzero((line[:-1] == line[1:]) & (n[line[:-1]] >= MIN_WORDS))
    light = (127 - np.minimum(lengths[inner] + lengths[inner + 1], 127)).astype(np.uint64)
    value = np.full(len(hashes) + 1, _NONE)
    value[inner] = light << np.uint64(57) | mix(hashes[inner] * np.uint64(3) + hashes[inner + 1]) >> np.uint64(7)
    for t in range(KEYS):
        out[:, t] = np.minimum.reduceat(value[:-1], at)
        hit = np.flatnonzero((value[:-1] == np.repeat(out[:, t], n)) & (value[:-1] != _NONE))
        value[hit] = _NONE
        hit = hit[n[line[hit]] >= APART]
        value[hit + 1] = _NONE  # the last pair of a line begins at its last word but one
        value[hit[hit > at[line[hit]]] - 1] = _NONE
    return out


def folds(keys: np.ndarray) -> np.ndarray:
    """32 bits of each block, never 0; 0 for none."""
    return np.where(keys == _NONE, np.uint64(0), (mix(keys) >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)


def within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the edit distance of two sequences is at most ``most``. It is if they differ in so
    few places, with one gap where lengths differ. Else equal ends are cut off; then the columns
    of the distance table follow as bit vectors (whole integers) of its vertical steps, a few
    operations for each element."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    short = min(n, m)
    same = a[:short] == b[:short]
    if abs(n - m) + int(np.count_nonzero(~same)) <= most:
        return True
    if n != m:  # the gap after k equal or changed places
        ends = a[n - short :] == b[m - short :]
        if abs(n - m) + int(np.count_nonzero(~ends)) + min(0, int(np.cumsum(ends.astype(np.int8) - same, dtype=np.int64).min())) <= most:
            return True
    front = short if same.all() else int(same.argmin())
    a, b = a[front:], b[front:]
    short = min(len(a), len(b))
    same = a[len(a) - short :][::-1] == b[len(b) - short :][::-1]
    back = short if same.all() else int(same.argmin())
    a, b = a[: len(a) - back].tolist(), b[: len(b) - back].tolist()
    if not a or not b:
        return max(len(a), len(b)) <= most
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score, left = full, 0, len(a), len(b)
    for x in b:
        equal = at.get(x, 0)
        diagonal = equal | down
        level = (((equal & up) + up) ^ up) | equal
        rise, fall = down | ~(level | up) & full, up & level
        score += bool(rise & last) - bool(fall & last)
        left -= 1
        if score - left > most:
            return False
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = (fall | ~(diagonal | rise)) & full, rise & diagonal
    return score <= most


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Edit similarity of two word sequences: 1 - distance / length of the longer."""
    longest = max(len(a), len(b))
    return within(a, b, longest * (100 - percent) // 100)


def _packed(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *_KEY)), *pack(batch.column("text"))], ["doc_id", *_KEY, "packed", "n_bytes"])

    return arrow_map(docs.select("doc_id", *_KEY, "text"), run, "doc_id long, d long, mark long, packed binary, n_bytes long")


def listed(docs: DataFrame) -> DataFrame:
    """line (hash), sim, n (words), d, mark, number, the blocks k0 .. and their folds, two to a
    long: a row for each line with a word."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column("text"), lower=True):
                doc, number, at = word_lines(block)
                if not len(at):
                    continue
                ends = np.append(at[1:], len(block.starts))
                n = (ends - at).astype(np.int32)
                h = mix(block.spans(at, ends) + n.astype(np.uint64))
                lengths = block.ends - block.starts
                keys = pair_blocks(block.hashes, lengths, at)
                sims, fold = simhash(block.hashes, weights(lengths), at), np.ascontiguousarray(folds(keys)).view(np.int64)
                row = pa.array(doc + block.first)
                columns = [pa.array(h.view(np.int64)), pa.array(sims.view(np.int64)), pa.array(n), batch.column("d").take(row), batch.column("mark").take(row), pa.array(number.astype(np.int32))]
                columns += [pa.array(keys[:, t].view(np.int64), mask=keys[:, t] == _NONE) for t in range(KEYS)]
                columns += [pa.array(np.ascontiguousarray(fold[:, t])) for t in range(KEYS // 2)]
                yield pa.RecordBatch.from_arrays(columns, ["line", "sim", "n", *_KEY, "number", *_KEYS, *_FOLDS])

    longs = ", ".join(f"{c} long" for c in (*_KEYS, *_FOLDS))
    return arrow_map(docs.select(*_KEY, "text"), run, f"line long, sim long, n int, d long, mark long, number int, {longs}")


def _bucketed(rows: DataFrame) -> DataFrame:
    """``rows`` (with bucket, s and n) of buckets of two or more, as groups (bucket, x, y): a
    bucket, with side -1, or two blocks of a crowd, where ``side`` is the row's own."""
    count = rows.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n").alias("held")).where("m > 1")
    parts = F.when(F.col("m") > CROWD, F.ceil(F.col("held") / HELD))
    r = rows.join(count, "bucket").withColumn("parts", parts).drop("m", "held")
    r = r.withColumn("side", F.coalesce(F.pmod(F.xxhash64("s"), F.col("parts")), F.lit(-1)).cast("long"))
    others = F.when(F.col("side") < 0, F.array(F.col("side"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    r = r.withColumn("other", F.explode(others)).drop("parts")
    return r.withColumn("x", F.least("side", "other")).withColumn("y", F.greatest("side", "other")).drop("other")


class _Group:
    """Rows of buckets, and the pairs of them that are to be compared."""

    def __init__(self, t: pa.Table, group: np.ndarray):
        self.group, self.same, self.side = group, t.column("x").to_numpy() == t.column("y").to_numpy(), t.column("side").to_numpy()
        self.sim, self.n = t.column("sim").to_numpy().view(np.uint64), t.column("n").to_numpy()
        self.folds = np.column_stack([t.column(c).to_numpy() for c in _FOLDS]).view(np.uint32)
        self.own = folds(t.column("bucket").to_numpy().view(np.uint64))

    def fitting(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs have fitting lengths and SimHashes."""
        most = np.maximum(self.n[i], self.n[j])
        use = 100 * np.minimum(self.n[i], self.n[j]) >= PERCENT * most
        return use & ((np.bitwise_count(self.sim[i] ^ self.sim[j]) <= RADIUS) | (most < LONG))

    def here(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that fit, each in one bucket: that of the least fold among the
        blocks that both lines have."""
        use = self.fitting(i, j)
        i, j = i[use], j[use]
        if not len(i):
            return i, j
        a, b = self.folds[i], self.folds[j]
        least = np.full(len(i), 2**32 - 1, np.uint32)
        for x in range(KEYS):
            for y in range(KEYS):
                least = np.where((a[:, x] == b[:, y]) & (a[:, x] > 0), np.minimum(least, a[:, x]), least)
        use = least == self.own[i]
        return i[use], j[use]

    def pairs(self):
        """Index pairs to be compared in buckets that are no crowds."""
        few = np.flatnonzero(self.side < 0)
        for i, j in _pairs(self.group[few], self.same[few], self.side[few]):
            yield self.here(few[i], few[j])

    def crowds(self) -> list[np.ndarray]:
        """The rows of each crowd."""
        at = np.flatnonzero(self.side >= 0)
        return np.split(at, np.flatnonzero(np.diff(self.group[at])) + 1) if len(at) else []


class Crowd:
    """The pairs of neighbouring words of lines that share one: ``line`` and ``rank`` (by number
    of lines, least first) of each, a line's own together and in order of rank. Rows of ``first``
    are those among which a line alike to theirs has one of its own ``first``: of n words up to
    n / 4 may be edited at 80 percent, and each edit changes two pairs at most."""

    def __init__(self, words: list[np.ndarray]):
        n = np.array([len(w) for w in words])
        flat, line = np.concatenate(words), np.repeat(np.arange(len(n)), n)
        inner = line[:-1] == line[1:]
        value = mix(flat[:-1][inner] * np.uint64(3) + flat[1:][inner])
        _, kind = np.unique(value, return_inverse=True)
        kinds = int(kind.max()) + 1
        line, kind = np.divmod(np.unique(line[:-1][inner] * kinds + kind), kinds)
        often = np.bincount(kind)
        rank = np.empty(kinds, np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(kinds)
        self.often = np.sort(often)
        self.line, self.rank = np.divmod(np.sort(line * kinds + rank[kind]), kinds)
        self.n, self.size = n, np.bincount(self.line, minlength=len(n))
        start = np.cumsum(self.size) - self.size
        most = 2 * (n * (100 - PERCENT) // PERCENT)
        self.first = np.arange(len(self.line)) - start[self.line] <= most[self.line]
        #: Lines that have the commonest of a line's first pairs.
        self.met = self.often[self.rank[start + np.minimum(most, self.size - 1)]]

    def sharing(self, i: int) -> np.ndarray:
        """Lines that have as many pairs in common with line ``i`` as alike ones must."""
        own = np.zeros(len(self.often), bool)
        own[self.rank[self.line == i]] = True
        common = np.bincount(self.line[own[self.rank]], minlength=len(self.n))
        lost = 2 * (np.maximum(self.n, self.n[i]) * (100 - PERCENT) // 100)
        return np.flatnonzero((common >= self.size - lost) & (common >= self.size[i] - lost))

    def pairs(self, label: np.ndarray):
        """Index pairs of lines of different labels that share one of their first pairs."""
        line, rank = self.line[self.first], self.rank[self.first]
        own = label[line]
        order = np.lexsort((own, rank))
        line, rank, own = line[order], rank[order], own[order]
        stop = np.searchsorted(rank, rank, "right")
        change = np.flatnonzero((np.diff(rank) != 0) | (np.diff(own) != 0)) + 1
        after = np.append(change, len(line))[np.searchsorted(change, np.arange(len(line)), "right")]
        n = stop - after
        total = np.cumsum(n)
        at = 0
        while at < len(line):
            done = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, done + AT_ONCE, "right")))
            some = n[at:end]
            i = np.repeat(np.arange(at, end), some)
            j = np.arange(len(i)) - np.repeat(total[at:end] - some - done, some) + after[i]
            if len(i):
                i, j = line[i], line[j]
                yield np.minimum(i, j), np.maximum(i, j)
            at = end


_MET = ["bucket", "x", "y", "side", "s", "sim", "n", *_FOLDS]


def candidates(lines: DataFrame) -> DataFrame:
    """bucket, x, y, side, s (the line), sim, n, folds: lines of a bucket that have a candidate
    there, and all lines of crowds."""

    def run(batches):
        for t, group in whole_groups(batches, ["bucket", "x", "y"]):
            rows = _Group(t, group)
            has = rows.side >= 0
            for i, j in rows.pairs():
                has[i] = has[j] = True
            yield from t.select(_MET).filter(pa.array(has)).to_batches()

    entered = lines.where("k0 is not null").select(F.col("line").alias("s"), "sim", "n", *_FOLDS, F.explode(F.array(*_KEYS)).alias("bucket")).where("bucket is not null")
    kinds = {"side": "long", "n": "int"}
    return arrow_map(_sorted(_bucketed(entered)).select(*_MET), run, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in _MET))


class _Links:
    """Links that join components among lines of which ``words`` are given. ``marks`` are the
    bits of each line's words."""

    def __init__(self, words: list[np.ndarray]):
        self.words, self.sets = words, {}
        self.n = np.array([len(w) for w in words])
        bits = np.zeros((len(words), MARKS), bool)
        bits[np.repeat(np.arange(len(words)), self.n), np.concatenate(words) & np.uint64(MARKS - 1)] = True
        self.marks = np.packbits(bits, axis=1).view(np.uint64)
        self.label, self.top, self.left, self.right = np.arange(len(words)), list(range(len(words))), [], []

    def _find(self, a: int) -> int:
        top = self.top
        while top[a] != a:
            top[a] = a = top[top[a]]
        return a

    def add(self, i: np.ndarray, j: np.ndarray) -> int:
        """Compare pairs whose ends aren't joined yet; the number of links found."""
        apart = self.label[i] != self.label[j]
        i, j = i[apart], j[apart]
        # each bit of the one that the other lacks is a word that it lacks, and so an edit
        a, b, most = self.marks[i], self.marks[j], np.maximum(self.n[i], self.n[j]) * (100 - PERCENT) // 100
        near = np.maximum(np.bitwise_count(a & ~b).sum(axis=1), np.bitwise_count(b & ~a).sum(axis=1)) <= most
        words, sets, before = self.words, self.sets, len(self.left)
        for p, q in zip(i[near].tolist(), j[near].tolist(), strict=True):
            a, b = self._find(p), self._find(q)
            if a == b:
                continue
            if p not in sets:
                sets[p] = frozenset(words[p].tolist())
            # each word of the one that the other lacks is an edit
            longest = max(len(words[p]), len(words[q]))
            common = sum(map(sets[p].__contains__, words[q].tolist()))
            if 100 * common >= PERCENT * longest and alike(words[p], words[q]):
                self.top[a] = b
                self.left.append(p)
                self.right.append(q)
        if len(self.left) > before:
            label = np.array(self.top)
            while (label[label] != label).any():
                label = label[label]
            self.label = label
        return len(self.left) - before


def _compare(rows: _Group, at: np.ndarray, links: _Links) -> None:
    """Link the lines ``at`` of a crowd. Leaders are the lines whose first pairs are the most
    common ones, as long as some of them have a family: that saves comparing its members."""
    crowd = Crowd([links.words[k] for k in at.tolist()])
    free, vain, family = crowd.met > CROWD // 4, 0, max(8, int(len(at) ** 0.5))
    while free.any() and vain < 4:
        k = int(np.argmax(np.where(free, crowd.met, 0)))
        near = at[crowd.sharing(k)]
        lead = np.full(len(near), at[k])
        fit = rows.fitting(lead, near) & (lead != near)
        vain = 0 if links.add(lead[fit], near[fit]) >= family else vain + 1
        free &= links.label[at] != links.label[at[k]]
    for i, j in crowd.pairs(links.label[at]):
        i, j = at[i], at[j]
        use = (links.label[i] != links.label[j]) & (rows.same[i] | (rows.side[i] != rows.side[j]))
        i, j = rows.here(i[use], j[use])
        one = np.unique(i * len(rows.n) + j)
        links.add(*np.divmod(one, len(rows.n)))


def verified(found: DataFrame, contents: DataFrame) -> DataFrame:
    """a, b: links that join components within each bucket, by edit similarity."""

    def run(batches):
        for t, group in whole_groups(batches, ["bucket", "x", "y"]):
            s, rows = t.column("s").to_numpy(), _Group(t, group)
            links = _Links([np.frombuffer(w, np.uint64) for w in t.column("words").to_pylist()])
            for i, j in rows.pairs():
                links.add(i, j)
            for at in rows.crowds():
                _compare(rows, at, links)
            yield pa.RecordBatch.from_arrays([pa.array(s[links.left]), pa.array(s[links.right])], ["a", "b"])

    return arrow_map(_sorted(found.join(contents, "s")), run, "a long, b long")


def contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """s, words (hashes, as bytes) of the lines ``wanted`` (line, d, mark, number). Of a text
    only those lines are split into words."""
    lists = wanted.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("number", "line"))).alias("asked"))
    rows = _packed(docs).join(lists, _KEY).select(*_KEY, "packed", "n_bytes", F.col("asked.number").alias("number"), F.col("asked.line").alias("line"))

    def run(batches):
        for batch in batches:
            for texts, part in unpacked_texts(batch):
                held = []
                for text, numbers in zip(texts, part.column("number").to_pylist(), strict=True):
                    every = text.split(b"\n")
                    held += [every[k] for k in numbers]
                (block,) = blocks(pa.array(held, pa.large_binary()), lower=True, limit=1 << 62)
                lines = part.column("line").flatten()
                words = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer((8 * block.words_of).astype(np.int32)), pa.py_buffer(block.hashes)])
                yield pa.RecordBatch.from_arrays([lines, words], ["s", "words"])

    return arrow_map(rows.dropDuplicates(_KEY), run, "s long, words binary")


def removed(docs: DataFrame) -> DataFrame:
    """d, mark, gone (array<int>): the numbers of the lines to remove, as a table."""
    every = stage(listed(docs))
    # of one row each, as one aggregate takes them: some place of the line, to read its words at
    firsts = [F.first(c).alias(c) for c in ("sim", "n", *_KEYS, *_FOLDS, *_KEY, "number")]
    classes = stage(every.groupBy("line").agg(F.count("*").alias("c"), *firsts))
    found = stage(candidates(classes))
    wanted = classes.select("line", *_KEY, "number").join(found.select(F.col("s").alias("line")).distinct(), "line", "left_semi")
    links = stage(verified(found, contents(docs, wanted)))
    discard(found)
    groups = components(links).withColumnRenamed("id", "line")
    judged = classes.select("line", "c").join(groups, "line", "left").where("c > 1 or component is not null").select("line", F.coalesce("component", "line").alias("component"))
    places = stage(every.select("line", *_KEY, "number").join(judged, "line").drop("line"))
    discard(every, classes, links, groups)
    keep = places.groupBy("component").agg(F.min(F.struct(*_KEY, "number")).alias("keep"))
    out = places.join(keep, "component").where(F.struct(*_KEY, "number") != F.col("keep"))
    out = stage(out.groupBy(*_KEY).agg(F.collect_set("number").alias("gone")))
    discard(places)
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, kept_text: a row per row of ``docs``.

    Of each connected group of alike lines the first occurrence by (doc_id, a hash of the
    text, line number) is kept and the others are removed, within documents and across them.
    Lines are alike if they are equal after normalisation, or have an edit similarity over words
    of ``PERCENT`` or more and meet in a block (of ``LONG`` words or more: with SimHashes within
    ``RADIUS`` bits). What is found doesn't depend on the number of lines. Lines without words
    stay. Null texts count as empty. Rows equal in doc_id and text are one document and are
    treated alike; a null doc_id comes first. An empty table gives no rows; further columns are
    ignored.
    """
    docs = identified(docs.select("doc_id", "text"))
    rows = _packed(docs).join(removed(docs), _KEY, "left").select("doc_id", "packed", "n_bytes", "gone")

    def run(batches):
        for batch in batches:
            for texts, part in unpacked_texts(batch):
                drop = part.column("gone").to_pylist()
                counts, left = [], []
                for text, gone in zip(texts, drop, strict=True):
                    parts = text.split(b"\n")
                    counts.append(sum(not x.isspace() and x != b"" for x in parts))
                    out = set(gone or ())
                    left.append(b"\n".join([x for i, x in enumerate(parts) if i not in out]) if out else text)
                n = [len(x or ()) for x in drop]
                kept = pa.array(left, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(n, pa.int64()), kept], ["doc_id", "n_lines", "n_removed", "kept_text"])

    return arrow_map(rows, run, "doc_id long, n_lines long, n_removed long, kept_text string")


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with their lines deduplicated: all columns, text replaced and n_chars (where
    it exists) set to the new text's length. Documents that lose every line with a word are
    copies and go; those that had none stay. Columns may have any names."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text")
    gone = removed(identified(docs.select("doc_id", "text")))
    joined = identified(rows).drop("doc_id", "text").join(gone, _KEY, "left")
    lines = F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("gone", i))
    joined = joined.withColumn("left", F.when(F.col("gone").isNotNull(), F.array_join(lines, "\n")))
    joined = joined.where("left is null or left rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    text = F.when(F.col("left").isNull(), F.col("row.text")).otherwise(F.col("left"))
    new = {"text": text, "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("long")}
    return joined.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
