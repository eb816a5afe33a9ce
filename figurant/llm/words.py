"""Vectorised word splitting and rolling hashes over Arrow string columns.

Words are the runs of bytes outside ``[\\x20\\x09-\\x0D]``. All functions work on the UTF-8
bytes of a block of whole documents, so no Python code runs per word. Blocks hold about
``BLOCK_BYTES`` of text (one document at least), which bounds the memory of a task.
Null texts count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

_TABLE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        _POWERS[base] = have = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def in_words(data: np.ndarray) -> np.ndarray:
    """Which bytes are no white space (arithmetic, which is much faster than a table's look-up)."""
    return (data != 0x20) & (data - np.uint8(9) > 4)


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _span_hash(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[s + j] * base**j over each span, modulo 2**64, then mixed."""
    inverse = pow(base, -1, 2**64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, _powers(base, len(values)), out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(inverse, len(values) + 1)[starts])


class Block:
    """Documents ``first .. last`` of a batch: their words, and each document's words' range."""

    def __init__(self, first: int, last: int, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.first, self.last, self.offsets = first, last, offsets
        self.raw = data
        self.data = lowered(data) if lower else data
        word = in_words(data)
        cut = np.zeros(len(data) + 1, bool)  # a document starts here
        cut[offsets] = True
        before = np.zeros(len(data), bool)
        before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (~before | cut[:-1]))
        after = np.zeros(len(data), bool)
        after[:-1] = word[1:]
        self.ends = np.flatnonzero(word & (~after | cut[1:])) + 1
        self.words_of = np.searchsorted(self.starts, offsets)
        self._hashes: np.ndarray | None = None

    @property
    def n_docs(self) -> int:
        return self.last - self.first

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words_of)

    @property
    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if self._hashes is None:
            h = _span_hash(np.take(_TABLE, self.data.astype(np.intp), mode="clip"), _BYTE_BASE, self.starts, self.ends)
            self._hashes = mix(h + (self.ends - self.starts).astype(np.uint64))
        return self._hashes

    def spans(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each span of words ``starts[i] .. ends[i]``."""
        values = mix(self.hashes ^ np.uint64(seed)) if seed else self.hashes
        return _span_hash(values, _WORD_BASE, starts, ends)

    def grams(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(word index, hash) of each run of k words that lies within one document."""
        ends_of = np.repeat(self.words_of[1:], self.n_words)
        at = np.arange(len(self.starts))
        at = at[at + k <= ends_of]
        return at, self.spans(at, at + k, seed)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        """Index (within the block) of the document that holds each word."""
        return np.repeat(np.arange(self.n_docs), self.n_words)[at]

    def text(self, i: int) -> bytes:
        return self.raw[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(texts: pa.Array, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole documents over a string or binary column, in order."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string()
    texts = texts.cast(kind)
    if texts.null_count:
        texts = texts.fill_null(b"" if kind == pa.large_binary() else "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield Block(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], lower)
        first = last


def pack(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Compressed texts and their sizes in bytes; null texts are empty."""
    codec = pa.Codec("zstd", 3)
    raw = [t.as_buffer() for t in texts]
    sizes = [r.size if r else 0 for r in raw]
    return pa.array([codec.compress(r, asbytes=True) if n else b"" for r, n in zip(raw, sizes, strict=True)], pa.binary()), pa.array(sizes, pa.int64())


def unpacked_texts(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], pa.RecordBatch]]:
    """The texts of the rows of a batch whose texts are packed (columns packed, n_bytes), and
    those rows: about ``BLOCK_BYTES`` of text at a time, one row at least."""
    codec, i, n = pa.Codec("zstd"), 0, batch.num_rows
    sizes, column = batch.column("n_bytes").to_pylist(), batch.column("packed")
    while i < n:
        j, held = i, 0
        while j < n and (j == i or held + sizes[j] <= BLOCK_BYTES):
            held += sizes[j]
            j += 1
        yield [codec.decompress(column[k].as_buffer(), sizes[k], asbytes=True) if sizes[k] else b"" for k in range(i, j)], batch.slice(i, j - i)
        i = j


def unpacked(batch: pa.RecordBatch, lower: bool = False) -> Iterator[tuple[Block, pa.RecordBatch]]:
    """As ``unpacked_texts``, with the texts as a block."""
    for texts, rows in unpacked_texts(batch):
        (block,) = blocks(pa.array(texts, pa.large_binary()), lower=lower, limit=1 << 62)
        yield block, rows
