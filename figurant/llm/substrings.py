"""Removal of long repeated word spans through a compacted De Bruijn graph.

The edges of the graph are the windows of ``span`` words. A window's node is that of its runs of
``k`` words that is least by hash; equal windows choose the same node at the same place. Windows
of a document that follow each other and have the same node make a path, one run of words, which
is kept as one edge with a hash in place of a row for each window. One aggregate counts equal
paths, another their nodes, and joins take the counts back to the places: on a path that occurs
twice or more, which then doesn't branch there, all windows are repeated, and none of them is
looked at again. Only windows on a path that occurs once and whose node occurs again are still
open (near edits, and where passages end): those are verified one by one, with those of one
place of each repeated path through the same node, by 128 bits of hash over all their words,
read at their coordinates in the source.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figurant.llm.stages import arrow_map, discard, identified, stage
from figurant.llm.words import Block, blocks, mix, pack, unpacked

#: Words of a window, and of a node.
SPAN, NODE = 35, 12

_OTHER = 0x6C62272E
_KEY = ["d", "mark"]


class Paths:
    """The windows, nodes and paths of a block of documents. ``windows`` are the word indexes
    where windows start, ``nodes`` those of the nodes, ``node_of`` the index (into ``nodes``) of
    each window's node, ``doc`` and ``ordinal`` each node's document and number."""

    def __init__(self, block: Block, span: int, k: int):
        self.block, self.span, self.k = block, span, k
        bounds = block.words_of
        ends_of = np.repeat(bounds[1:], block.n_words)
        at = np.arange(len(block.starts))
        self.windows = at[at + span <= ends_of]
        n = len(at)
        if not len(self.windows):
            self.nodes = self.node_of = self.doc = self.ordinal = np.zeros(0, np.int64)
            return
        self.hash = np.zeros(n, np.uint64)
        self.hash[: n - k + 1] = block.spans(at[: n - k + 1], at[: n - k + 1] + k)
        chosen = self._least(span - k + 1)[self.windows]  # never falls
        new = np.append(True, chosen[1:] != chosen[:-1])
        self.nodes, self.node_of = chosen[new], np.cumsum(new) - 1
        self.doc = np.searchsorted(bounds, self.nodes, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(block.n_docs + 1))
        self.ordinal = np.arange(len(self.nodes)) - self.first[self.doc]

    def _least(self, width: int) -> np.ndarray:
        """Position of the least hash among ``width`` from each on; the first of equal ones."""
        best, where, have = self.hash, np.arange(len(self.hash)), 1
        while have < width:
            step = min(have, width - have)
            other = np.concatenate([best[step:], np.full(step, 2**64 - 1, np.uint64)])
            place = np.concatenate([where[step:], np.full(step, len(best) - 1)])
            less = other < best
            best, where = np.where(less, other, best), np.where(less, place, where)
            have += step
        return where

    def paths(self) -> np.ndarray:
        """A hash of each node's path, which ends with its last window, and of the node's place
        on it."""
        low = self.windows[np.searchsorted(self.node_of, np.arange(len(self.nodes)))]
        high = self.windows[np.searchsorted(self.node_of, np.arange(len(self.nodes)), "right") - 1] + self.span
        place = (self.nodes - low).astype(np.uint64) << np.uint64(32) | (high - low).astype(np.uint64)
        return mix(self.block.spans(low, high) + mix(place))

    def split(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By the nodes' states (0 occurs once, 1 repeats on a path that doesn't, 2 on one that
        does, 3 as 2 and tells the others): the windows on repeated paths, those that are open,
        and those that tell."""
        own = states[self.node_of]
        return self.windows[own >= 2], self.windows[own == 1], self.windows[own == 3]


def _states(paths: Paths, flags: pa.Array) -> np.ndarray:
    out = np.zeros(len(paths.nodes), np.int8)
    if len(out):
        n = flags.value_lengths().fill_null(0).to_numpy()
        marks = flags.flatten().to_numpy()
        out[np.repeat(paths.first[:-1], n) + (marks >> 2)] = 1 + (marks & 3)
    return out


def _packed(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *_KEY)), *pack(batch.column("text"))], ["doc_id", *_KEY, "packed", "n_bytes"])

    return arrow_map(docs.select("doc_id", *_KEY, "text"), run, "doc_id long, d long, mark long, packed binary, n_bytes long")


def occurrences(docs: DataFrame, span: int = SPAN, k: int = NODE) -> DataFrame:
    """node, path, d, mark, ordinal: a row for each place of a node."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column("text")):
                p = Paths(block, span, k)
                if not len(p.nodes):
                    continue
                row = pa.array(p.doc + block.first)
                yield pa.RecordBatch.from_arrays([pa.array(p.hash[p.nodes].view(np.int64)), pa.array(p.paths().view(np.int64)), batch.column("d").take(row), batch.column("mark").take(row), pa.array(p.ordinal.astype(np.int32))], ["node", "path", *_KEY, "ordinal"])

    return arrow_map(docs.select(*_KEY, "text"), run, "node long, path long, d long, mark long, ordinal int")


def repeated_paths(docs: DataFrame, span: int = SPAN, k: int = NODE) -> DataFrame:
    """d, mark, flags (array<int>), as a table: four times the ordinal of each node that occurs
    more than once, plus 1 if its path does, or 2 if it does and this place has to tell those
    nodes' other paths. Counts are summed in each task first and joined to counts, so a node
    with much of the table costs no more than others until the places are joined, where Spark
    can split it."""
    places = stage(occurrences(docs, span, k))
    place = F.xxhash64(*_KEY, "ordinal")
    paths = stage(places.groupBy("node", "path").agg(F.count("*").alias("n"), F.min(place).alias("teller")))
    nodes = paths.groupBy("node").agg(F.sum("n").alias("all"), F.count_if(F.col("n") == 1).alias("open")).where("all > 1")
    teller = F.when((F.col("n") > 1) & (F.col("open") > 0), F.col("teller"))
    again = paths.join(nodes, "node").select("node", "path", (F.col("n") > 1).cast("int").alias("whole"), teller.alias("teller"))
    state = F.when(F.col("teller") == place, 2).otherwise(F.col("whole"))
    flags = places.join(again, ["node", "path"]).select(*_KEY, (F.col("ordinal") * 4 + state).alias("flag"))
    out = stage(flags.groupBy(*_KEY).agg(F.collect_set("flag").alias("flags")))
    discard(places, paths)
    return out


def repeated_windows(docs: DataFrame, flags: DataFrame, span: int = SPAN, k: int = NODE) -> DataFrame:
    """d, mark, starts (array<int>), as a table: the open windows that occur twice or more.

    A window that occurs twice in a block of documents is repeated, and only one of its rows
    there has to tell the others: a very common window doesn't crowd one task."""

    def run(batches):
        for batch in batches:
            for block, part in unpacked(batch):
                p = Paths(block, span, k)
                _, asks, tells = p.split(_states(p, part.column("flags")))
                at = np.concatenate([asks, tells])
                if not len(at):
                    continue
                doc = block.doc_of(at)
                row = pa.array(doc)
                h, g = block.spans(at, at + span), block.spans(at, at + span, _OTHER)
                order = np.lexsort((g, h))
                new = np.append(True, (np.diff(h[order]) != 0) | (np.diff(g[order]) != 0))
                first, sure = np.zeros(len(at), bool), np.zeros(len(at), bool)
                first[order[new]] = True
                sure[order] = (np.bincount(np.cumsum(new) - 1) > 1)[np.cumsum(new) - 1]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), part.column("d").take(row), part.column("mark").take(row), pa.array((at - block.words_of[doc]).astype(np.int32)), pa.array(first), pa.array(sure), pa.array(np.arange(len(at)) < len(asks))], ["h", "g", *_KEY, "start", "first", "sure", "asks"])

    open_ = flags.where(F.exists("flags", lambda x: x % 4 != 1))
    rows = _packed(docs).join(open_, _KEY).select(*_KEY, "packed", "n_bytes", "flags")
    windows = stage(arrow_map(rows, run, "h long, g long, d long, mark long, start int, first boolean, sure boolean, asks boolean"))
    again = windows.where("first").groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    alone = windows.where("asks and not sure").join(again, ["h", "g"]).select(*_KEY, "start")
    starts = windows.where("asks and sure").select(*_KEY, "start").union(alone)
    out = stage(starts.groupBy(*_KEY).agg(F.collect_set("start").alias("starts")))
    discard(windows)
    return out


def dedup(docs: DataFrame, span: int = SPAN, k: int = NODE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: a row per row of ``docs``.

    A word goes if it lies in a window of ``span`` words whose word sequence also starts
    anywhere else, in the same document or another (every occurrence goes, the first too);
    windows are judged on the input. The kept words are joined by one space. Words are runs
    outside ``[\\x20\\x09-\\x0D]``, unchanged. Null and empty texts give no words and ''.
    Repeated rows repeat each other's windows. Rows are told apart by doc_id and a hash of the
    text, so equal ids with different texts are different documents. An empty table gives no
    rows; further columns are ignored.
    """
    return _finished(docs, span, k, False)


def digests(docs: DataFrame, span: int = SPAN, k: int = NODE) -> DataFrame:
    """As ``dedup``, with kept_sha256 in place of the text."""
    return _finished(docs, span, k, True)


def _finished(docs: DataFrame, span: int, k: int, hashed: bool) -> DataFrame:
    docs = identified(docs.select("doc_id", "text"))
    flags = repeated_paths(docs, span, k)
    starts = repeated_windows(docs, flags, span, k)
    rows = _packed(docs).join(flags, _KEY, "left").join(starts, _KEY, "left").select("doc_id", "packed", "n_bytes", "flags", "starts")

    def run(batches):
        for batch in batches:
            for block, part in unpacked(batch):
                p = Paths(block, span, k)
                gone = np.zeros(len(block.starts) + 1, np.int64)
                safe, _, _ = p.split(_states(p, part.column("flags"))) if len(p.nodes) else (p.windows, None, None)
                found = part.column("starts")
                each = np.repeat(block.words_of[:-1], found.value_lengths().fill_null(0).to_numpy()) + found.flatten().to_numpy()
                for at in (safe, each):
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + span, -1)
                gone = np.cumsum(gone[:-1]) > 0
                total, removed, texts = block.n_words, [], []
                for d in range(block.n_docs):
                    a, b = block.words_of[d], block.words_of[d + 1]
                    words, out = block.text(d).split(), gone[a:b]
                    removed.append(int(out.sum()))
                    kept = b" ".join([w for w, x in zip(words, out.tolist(), strict=True) if not x] if removed[-1] else words)
                    texts.append(hashlib.sha256(kept).hexdigest() if hashed else kept.decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", name])

    name = "kept_sha256" if hashed else "kept_text"
    return arrow_map(rows, run, f"doc_id long, n_words long, n_removed long, {name} string")
