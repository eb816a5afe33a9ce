import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from figurant.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pair():
    return bpe.Codec(bpe.read_spec(PATH)), Tokenizer.from_file(PATH)


def same(pair, text):
    codec, library = pair
    ids = library.encode(text, add_special_tokens=False).ids
    got = codec.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == ids, text
    assert codec.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_random_texts_equal_the_library(pair):
    r = random.Random(1)
    alphabet = "ab' sdtlm\n\t\x0b\x85   09é漢字😀.,|<"
    for _ in range(3000):
        s = "".join(r.choice(alphabet) for _ in range(r.randrange(40)))
        same(pair, s[:9] + "<|endoftext|>" * r.randrange(3) + s[9:])


@pytest.mark.parametrize("n", [127, 128, 129, 500, 5000])
def test_long_words(pair, n):
    r = random.Random(n)
    for _ in range(5):
        same(pair, "".join(r.choice("abcdeinrst") for _ in range(n)))
    same(pair, "a" * n)


def test_invalid_bytes_decode_as_the_library_does(pair):
    codec, library = pair
    r = random.Random(2)
    for _ in range(500):
        ids = [r.randrange(50257) for _ in range(r.randrange(20))]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    codec, library = bpe.Codec(bpe.read_spec(PATH)), Tokenizer.from_file(PATH)
    for text in ["one two three four five six one two", "seven one eight", "one"] * 2:
        same((codec, library), text)


def test_frames(spark, pair):
    rows = [(1, None, "x"), (2, "", "y"), (3, "Hello <|endoftext|> wörld", None), (3, "Hello <|endoftext|> wörld", None), (None, "a\n" * 3000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((r.decoded for r in out.collect())) == sorted(t or "" for _, t, _ in rows)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH).collect()}
    want = set()
    for i, t, _ in rows:
        ids = pair[1].encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
