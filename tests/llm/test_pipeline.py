import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from figurant.llm import langid
from figurant.llm.stages import identified
from tests.llm import test_jaccard, test_lines

SMALL = "/root/testdata/sf0.001"


def written(spark, tmp_path_factory, docs):
    kept = []
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path_factory.mktemp("stage") / str(i))
        f(spark, docs, SMALL).write.parquet(out)
        docs = spark.read.parquet(out)
        kept.append(docs)
    return kept


def test_every_stage_against_brute_force(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars < 3000")
    extra = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "12 34 % 56", "en", "src1", 9), (9003, "", None, None, 0)], docs.schema)
    docs = docs.union(extra).withColumn("extra", F.lit(1))
    language, line, near, mix, last = written(spark, tmp_path_factory, docs)
    before = {r.doc_id: r for r in docs.collect()}

    kept = {r.doc_id: r for r in language.collect()}
    assert language.columns == docs.columns and all(kept[i] == before[i] for i in kept)
    scores = {r.doc_id: r.best for r in langid.scored(docs.select("doc_id", "text"), langid.fit(docs)).collect()}
    letterless = {i for i, r in before.items() if not re.search(r"[A-Za-z]|[^\x00-\x7F]", r.text or "")}
    assert {9001, 9002, 9003} <= letterless <= set(before) - set(kept) <= letterless | {i for i, b in scores.items() if b == "und"}

    marks = {r.doc_id: r.mark for r in identified(language.select("doc_id", "text")).collect()}
    want, _ = test_lines.brute([(i, marks[i], r.text) for i, r in kept.items()])
    got = {r.doc_id: r for r in line.collect()}
    assert {i: r.text for i, r in got.items()} == {x[0]: x[3] for x in want if x[3].strip()}
    assert len(got) < len(want)  # copies lose every line, and go
    assert all(r.n_chars == len(r.text) and (r.source, r.lang) == (kept[i].source, kept[i].lang) for i, r in got.items())

    groups = test_jaccard.brute([(i, r.text) for i, r in got.items()], 5, 80)
    stay = {x[0] for x in groups if x[0] == x[2]}
    assert {r.doc_id: r for r in near.collect()} == {i: got[i] for i in stay}

    sizes, taken, source = defaultdict(int), Counter(), {}
    for r in near.collect():
        sizes[r.source] += len(r.text.split())
        source[r.doc_id] = (r.source, r.text)
    words = Counter()
    for r in mix.collect():
        assert set(r.text.split()) <= set(source[r.doc_id][1].split()) and r.source == source[r.doc_id][0]
        taken[r.doc_id] += len(r.text.split())
        words[r.source] += len(r.text.split())
    assert all(n <= 2 * len(source[i][1].split()) for i, n in taken.items())
    assert abs(sum(words.values()) - 1.5 * sum(sizes.values())) <= len(sizes)

    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    expect = Counter()
    for r in mix.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        expect[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())] += 1
    assert Counter(map(tuple, last.collect())) == expect


def test_odd_rows_and_empty_tables(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [d.count() for d in written(spark, tmp_path_factory, docs.limit(0))] == [0] * 5
    odd = spark.createDataFrame([(None, "the same words in the text again and again here", "en", None, 1)] * 3 + [(7, "other words of the text that stand here", "en", "a", 2)] * 2, docs.schema)
    counts = [d.count() for d in written(spark, tmp_path_factory, docs.where("doc_id < 60").union(odd))]
    assert counts[0] >= 50 and counts[0] - 5 <= counts[1] <= counts[0]
