"""Byte-level BPE encoding and decoding with a contiguous rank array."""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figurant.llm.stages import arrow_map

#: How byte-level BPE cuts a text into words (fixed by the vocabulary's format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words of more bytes than this are merged with a heap: the scan is for short words.
LONG_WORD = 128
#: Entries of each of the two generations of a worker's word cache. When the young one is full
#: it becomes the old one, from which words still in use come back.
CACHE = 1 << 18

_NONE = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The format's printable stand-in for each byte: printable bytes stand for themselves,
    the others follow from code point 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """An encoder and decoder for one vocabulary file (the tokenizers library's JSON)."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.ids = {as_bytes(t): i for t, i in d["model"]["vocab"].items()}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for r, pair in enumerate(d["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((as_bytes(left), as_bytes(right)), r)
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def boundaries(self, word: bytes) -> list[int]:
        """Ends of the parts of a short word after all merges. ``cuts`` holds the parts'
        boundaries and ``rank`` the rank of each pair of neighbours, side by side."""
        ranks = self.ranks
        cuts = list(range(len(word) + 1))
        rank = [ranks.get((word[i : i + 1], word[i + 1 : i + 2]), _NONE) for i in range(len(word) - 1)]
        while rank:
            best = min(rank)
            if best == _NONE:
                break
            i = rank.index(best)
            del cuts[i + 1], rank[i]
            middle = word[cuts[i] : cuts[i + 1]]
            if i < len(rank):
                rank[i] = ranks.get((middle, word[cuts[i + 1] : cuts[i + 2]]), _NONE)
            if i:
                rank[i - 1] = ranks.get((word[cuts[i - 1] : cuts[i]], middle), _NONE)
        return cuts

    def boundaries_long(self, word: bytes) -> list[int]:
        """The same for a long word: the next merge comes from a heap, parts are linked."""
        ranks, n = self.ranks, len(word)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get((word[i : i + 1], word[i + 1 : i + 2]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if end[i] != mid or after[i] != mid or end[mid] != stop:
                continue  # one of the two parts has changed since
            end[i], after[i], end[mid] = stop, after[mid], -1
            if stop < n:
                before[stop] = i
                if (r := ranks.get((word[i:stop], word[stop : end[stop]]))) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get((word[p:i], word[i:stop]))) is not None:
                heapq.heappush(heap, (r, p, i, stop))
        cuts, i = [0], 0
        while i < n:
            cuts.append(end[i])
            i = end[i]
        return cuts

    def word(self, word: str) -> bytes:
        """Ids of one word, each as a little-endian unsigned 32-bit integer."""
        out = self.old.get(word)
        if out is None:
            raw = word.encode()
            cuts = self.boundaries(raw) if len(raw) <= LONG_WORD else self.boundaries_long(raw)
            out = b"".join([self.ids[raw[i:j]].to_bytes(4, "little") for i, j in zip(cuts, cuts[1:])])  # noqa: B905
            if len(raw) > LONG_WORD:
                return out
        if len(self.cache) >= CACHE:
            self.old, self.cache = self.cache, {}
        self.cache[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers. The vocabulary's
        special tokens are recognised in the text, as the library does."""
        if self.cut is not None and self.cut.search(text):
            return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self.encode(p) for p in self.cut.split(text) if p)
        return b"".join([self.cache.get(w) or self.word(w) for w in self.find(text)])

    def decode(self, ids: bytes) -> str:
        """The text of encoded ids; bytes that aren't UTF-8 become U+FFFD. Unknown ids are
        dropped."""
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in array("I", ids)]).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def _codec(spec: str) -> Codec:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


def read_spec(path: str) -> str:
    """The vocabulary file's text; it is read once, on the driver, and broadcast (a few MB,
    whatever the corpus)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (array<int>) to ``docs``; an existing column of that name is replaced.

    One narrow stage, a document at a time. Null and empty texts give an empty array.
    """
    return _mapped(docs, path, text, {ids: ("array<int>", pa.list_(pa.int32()), lambda codec, t: memoryview(codec.encode(t)).cast("I").tolist())})


def decode(docs: DataFrame, path: str, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text`` (string), the decoding of the column ``ids``; null ids give ''. Ids that
    the vocabulary lacks are dropped."""
    return _mapped(docs, path, ids, {text: ("string", pa.string(), lambda codec, x: codec.decode(array("I", x or []).tobytes()))})


def round_trip(docs: DataFrame, path: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers) and decoded_sha256 (of the decoded ids in UTF-8).

    The digests are made where the ids are, so neither ids nor texts leave the task. Repeated
    rows give equal results; null and empty texts give no tokens and the digests of no bytes.
    """
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def both(codec: Codec, t: str) -> tuple[int, str, str]:
        ids = codec.encode(t)
        return len(ids) // 4, sha(ids), sha(codec.decode(ids).encode())

    kind = pa.struct([("n", pa.int64()), ("i", pa.string()), ("d", pa.string())])
    out = _mapped(docs.select(*keep, F.col(text).alias("__text")), path, "__text", {"__r": ("struct<n:bigint,i:string,d:string>", kind, lambda c, t: dict(zip("nid", both(c, t), strict=True)))})
    return out.select(*keep, F.col("__r.n").alias("n_tokens"), F.col("__r.i").alias("ids_sha256"), F.col("__r.d").alias("decoded_sha256"))


def _mapped(docs: DataFrame, path: str, source: str, made: dict) -> DataFrame:
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    names = [c for c in docs.columns if c not in made]
    (name, (ddl, kind, make)), = made.items()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for batch in batches:
            values = [make(codec, x) for x in (v or "" for v in _plain(batch.column(source)))]
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(values, kind)], [*names, name])

    from pyspark.sql.types import StructType

    schema = StructType([docs.schema[c] for c in names])
    return arrow_map(docs, run, StructType([*schema.fields, *StructType.fromDDL(f"{name} {ddl}").fields]))


def _plain(column: pa.Array) -> Iterator:
    for x in column:
        yield x.as_py()

