import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from figurant.llm import langid
from figurant.llm.words import mix

WORDS = {"en": "the of and house with water which that river stone", "de": "der die und haus mit wasser welche dass fluss stein über", "fr": "le les et maison avec eau qui que rivière pierre été"}


def text(r, lang, n):
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(0)
    rows = [(text(r, k, 60), k.upper() if i % 5 == 0 else k) for i in range(40) for k in WORDS] + [("x", None), (None, "en")]
    return langid.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_model_and_scores(spark, model):
    assert model.languages == ["de", "en", "fr", "und"]
    assert all(abs(sum(map(math.exp, row)) - 1) < 1e-9 for row in model.logs)
    r = random.Random(1)
    rows = [(k, text(r, k, 30)) for k in WORDS for _ in range(20)]
    out = langid.scored(spark.createDataFrame(rows, "k string, text string"), model).collect()
    assert sum(x.k == x.best for x in out) >= 59


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, declared string, host string, domain string, suffix string, prior string").withColumns({"language": F.lit("?"), "best": F.lit(1), "h": F.lit(2), "x": F.lit(3), "scores": F.lit(4)})


def test_fusion(spark, model):
    r = random.Random(2)
    rows = [(i, text(r, "de", 20), "de", "a.x.de", "x.de", "de", "z") for i in range(30)] + [(100 + i, text(r, "en", 20), None, "b.y.com", "y.com", "com", "z") for i in range(30)]
    rows += [(200, "mit", "de", "a.x.de", "x.de", "de", ""), (201, None, "de", "a.x.de", "x.de", "de", ""), (202, "", None, None, None, None, ""), (203, "12 %% 34 !!", "en", None, None, None, "")]
    rows += [(204, "жзх щъы эюя фцч " * 20, None, "b.y.com", "y.com", "com", ""), (205, text(r, "fr", 3000), "en", "b.y.com", "y.com", "com", ""), (206, text(r, "en", 20), "en-GB", None, None, None, "")]
    out = {x.id: x for x in langid.identify(frame(spark, rows), model).collect()}
    assert len(out) == len(rows) and out[206].best == 1 and out[206].scores == 4 and out[0].prior == "z"
    assert all(out[i].language == "de" and out[i].accepted for i in range(30)) and all(out[100 + i].language == "en" for i in range(30))
    assert out[200].language == "de" and out[206].language == "en" and out[205].language == "fr"
    assert [(out[i].language, out[i].accepted) for i in (201, 202, 203)] == [(None, False)] * 3
    assert out[204].language == "und" and not out[204].accepted


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def plain_scores(t, model):
    """Trigram by trigram."""
    x = (t or "").encode().translate(LOWER)
    prose, letter = set(b"abcdefghijklmnopqrstuvwxyz \t\n.,'-") | set(range(128, 256)), set(b"abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
    codes = [x[i] | x[i + 1] << 8 | x[i + 2] << 16 for i in range(len(x) - 2) if prose >= set(x[i : i + 3]) and letter & set(x[i : i + 3])]
    cls = [int(mix(np.array([c], np.uint64))[0]) % langid.BUCKETS for c in codes]
    return [sum(row[c] for c in cls) * (min(len(cls), langid.EVIDENCE) / len(cls) if cls else 0) for row in model.logs], bool(cls)


def plain(rows, model):
    """rows (text, declared, host, domain, suffix): language, posterior, accepted of each, with
    every count taken over the other rows."""
    names, k = model.languages, len(model.languages)
    scores, best = [], []
    for r in rows:
        x, seen = plain_scores(r[0], model)
        scores.append(x)
        best.append(x.index(max(x)) if seen else None)
    out = []
    for i, (t, declared, host, domain, suffix) in enumerate(rows):
        others = [(rows[j], best[j]) for j in range(len(rows)) if j != i and best[j] is not None]
        prior = [(1 - langid.UND_PRIOR) / (k - 1)] * (k - 1) + [langid.UND_PRIOR]
        for same in (lambda r: True, lambda r: r[3] == domain, lambda r: r[2:4] == (host, domain)):
            c = Counter(b for r, b in others if same(r))
            prior = [(c[j] + langid.SMOOTH * prior[j]) / (sum(c.values()) + langid.SMOOTH) for j in range(k)]
        n, here, all_ = len({r[4] for r in rows if r[4] is not None}), Counter(b for r, b in others if r[4] == suffix), Counter(b for r, b in others if r[4] is not None)
        like = [(here[j] + 1) / (all_[j] + n) if suffix is not None else 1 for j in range(k)]
        claim = re.match("[A-Za-z]*", declared or "")[0].lower()
        said = [(0.9 if names[j] == claim else 0.1 / (k - 1)) if claim in names[:-1] else 1 for j in range(k)]
        logs = [a + math.log(p * q * v) for a, p, q, v in zip(scores[i], prior, like, said)]
        top = max(logs)
        language, posterior = names[logs.index(top)], 1 / sum(math.exp(x - top) for x in logs)
        seen = re.search(r"[A-Za-z]|[^\x00-\x7F]", t or "")
        out.append((language, posterior, language != "und" and posterior >= 0.5) if seen else (None, None, False))
    return out


def test_pages_against_a_plain_run(spark, model):
    pages = langid.page_evidence(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).where("length(text) < 4000")
    r = random.Random(5)
    odd = [(-k, text(r, lang, 3), said, host, dom, suf) for k, (lang, said, host, dom, suf) in enumerate([("de", "fr", "solo.de", "solo.de", "de"), ("fr", None, None, None, None), ("en", "de-AT", "a.b.c", "b.c", "c")], 1)]
    odd += [(-9, None, "de", "a.b.c", "b.c", "c"), (-10, "12 34", None, "a.b.c", "b.c", "c"), (-11, "x", "en", "a.b.c", "b.c", "c")]
    rows = pages.select("page_id", "text", "declared", "host", "domain", "suffix").union(spark.createDataFrame(odd, "page_id long, text string, declared string, host string, domain string, suffix string")).orderBy("page_id")
    plain_rows = [tuple(x) for x in rows.collect()]
    fitted = langid.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    got = {x.page_id: x for x in langid.identify(rows, fitted).collect()}
    for (i, *_), (language, posterior, accepted) in zip(plain_rows, plain([x[1:] for x in plain_rows], fitted)):
        assert (got[i].language, got[i].accepted) == (language, accepted), i
        assert got[i].posterior == (posterior if posterior is None else pytest.approx(posterior, abs=1e-9))


def test_a_text_does_not_back_itself(spark, model):
    """A lone host's prior comes from the others: with or without a host, the same posterior."""
    r = random.Random(7)
    rows = [(1, "mit", None, "lone.example", "lone.example", None, "")] + [(2 + i, text(r, "en", 30), None, "b.y.com", "y.com", None, "") for i in range(20)]
    out = {x.id: x for x in langid.identify(frame(spark, rows), model).collect()}
    ((_, posterior, _), *_) = plain([x[1:6] for x in rows], model)
    assert out[1].posterior == pytest.approx(posterior)


def test_rare_labels_have_a_model(spark):
    r = random.Random(3)
    rows = [(text(r, "en", 6), "en") for _ in range(3000)] + [(text(r, "de", 30), "de") for _ in range(3)] + [("copy of one text", "xx")] * 500
    assert langid.fit(spark.createDataFrame(rows, "text string, lang string"), texts=50).languages == ["de", "en", "xx", "und"]


def test_pages(spark):
    rows = [(1, "https://www.a.co.uk:80/x?y", '<html x lang="en-GB"><script>le la</script>Hi<style>p</style><!-- der --> there &amp; &#65;<p>you'), (2, None, None), (3, "nonsense", "plain"), (3, "http://u@Host/", "<HTML LANG=fr>")]
    got = sorted((r.page_id, " ".join(r.text.split()), r.declared, r.host, r.domain, r.suffix) for r in langid.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")).collect() if r.host or r.page_id < 3)
    assert got[0] == (1, "Hi there you", "en-GB", "www.a.co.uk", "co.uk", "uk")
    assert got[1][:5] == (2, "", None, None, None) and got[2] == (3, "", "fr", "host", "host", "host")


def test_empty_tables(spark, model):
    assert langid.identify(frame(spark, []), model).count() == 0
    nothing = langid.fit(spark.createDataFrame([], "text string, lang string"))
    out = langid.identify(frame(spark, [(1, "some text", "en", "h", "d", "s", "")]), nothing).collect()
    assert not out[0].accepted


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 100")
    fit_on = F.pmod(F.xxhash64("text"), F.lit(2)) == 0
    model = langid.fit(docs.where(fit_on))
    out = langid.scored(docs.where(~fit_on), model).agg(F.avg((F.col("best") == F.col("lang")).cast("int"))).first()[0]
    assert out > 0.97
