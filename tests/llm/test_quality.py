import math
import random
import re
from collections import Counter, defaultdict

import pytest

from figurant.llm import quality

WORDS = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    t = text or ""
    w = WORDS.findall(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def histograms(text, lang):
    t = text or ""
    w = WORDS.findall(t)
    sub = lambda p: sum(len(x) for x in re.findall(p, t))
    caps, digits, points, symbols = sub("[A-Z]"), sub("[0-9]"), sub("[.,;:!?'\"()-]"), sub(r"[#*$%&|<>]")
    wide, letters = sum(x > "\x7f" for x in t), sum(map(len, w))
    classes = [letters - symbols - digits - caps - points - wide, caps, digits, points, symbols, wide, len(t) - letters]
    assert sum(classes) == len(t) and min(classes) >= 0
    names = quality.COMMON.get((lang or "").lower())
    counts = names and [sum(x.lower() == n for x in w) for n in names]
    return classes, counts and counts + [len(w) - sum(counts)]


def jsd(p, q):
    if not p or not q or not sum(p) or not sum(q):
        return None
    p, q, s = [x / sum(p) for x in p], [x / sum(q) for x in q], 0
    for a, b in zip(p, q):
        s += sum(v * math.log2(2 * v / (a + b)) for v in (a, b) if v) / 2
    return math.sqrt(max(0, s))


def made(seed):
    r = random.Random(seed)
    rows = []
    for i in range(120):
        n = r.choice([0, 3, 9, 10, 11, 60, 90, 300])
        vocabulary = r.choice([["the", "of", "And", "stone", "rain", "a", "x9", "é"], ["%%%", "x", "|", "$1", "9"], [f"w{j}" for j in range(400)]])
        text = "".join(r.choice(vocabulary) + r.choice([" ", "\n", "  ", "\t", "\x0b", ", "]) for _ in range(n))
        rows.append((i, text if n else r.choice([None, "", "\n \n"]), r.choice(["en", "EN", "fr", "xx", None]), "c"))
    return rows + rows[5:9] + [(None, "ein Haus und der Mann " * 30, "de", "c"), (500, "x " * 20_000, "en", "c"), (501, "α β γ δ " * 20, "en", "c")]


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    rows = made(seed)
    sums = defaultdict(lambda: [[0] * 7, [0] * 25])

    def counts(t, lang):
        n, _, _, _, again = base(t)
        return (lang or "").lower() in quality.COMMON and n >= quality.MIN_WORDS and len(t) >= quality.MIN_CHARS and 100 * again <= 20 * n

    for i, t, lang, _ in rows:
        key = (lang or "").lower()
        if counts(t, lang):
            for total, part in zip(sums[key], histograms(t, lang)):
                total[:] = map(sum, zip(total, part))
    want = []
    for i, t, lang, _ in rows:
        b = base(t)
        failed = b[0] < 10 or 100 * b[4] > 20 * b[0]
        ref = sums.get((lang or "").lower(), [None, None])
        classes, common = histograms(t, lang)
        if counts(t, lang):  # the other documents'
            ref = [[a - b for a, b in zip(x, y)] for x, y in zip(ref, (classes, common))]
        c = jsd(classes, ref[0]) if len(t or "") >= quality.MIN_CHARS else None
        w = jsd(common, ref[1]) if b[0] >= quality.MIN_WORDS else None
        kept = not failed and (c or 0) <= quality.MAX_CHAR_DISTANCE and (w or 0) <= quality.MAX_WORD_DISTANCE
        want.append((i, *b, failed, kept, c and round(c, 9), w and round(w, 9)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, words string")
    got = [(*r[:8], r[8] and round(r[8], 9), r[9] and round(r[9], 9)) for r in map(tuple, quality.judge(docs).collect())]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(w[7] for w in want) and any(not w[7] and not w[6] for w in want)


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_words_alone_reject_texts_without_common_words(spark):
    r = random.Random(7)
    invented = lambda: "".join(r.choice("aeioustnrlm") for _ in range(r.randrange(2, 9)))
    prose = lambda common: " ".join(r.choice(quality.COMMON["en"]) if r.random() < common else invented() for _ in range(200)) + "."
    rows = [(i, prose(r.uniform(0.15, 0.25)), "en") for i in range(60)] + [(100 + i, prose(0), "en") for i in range(3)]
    out = {x.doc_id: x for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i].kept for i in range(60))
    for i in range(100, 103):
        assert not out[i].base_failed and out[i].char_distance <= quality.MAX_CHAR_DISTANCE and not out[i].kept


def test_no_text_that_is_labelled_good_is_rejected_for_its_words(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    labelled = quality.judge(read("documents")).join(read("labels").where("quality = 1").select("doc_id").distinct(), "doc_id")
    got = [x for x in labelled.collect() if not x.base_failed]
    assert len(got) > 300 and all((x.word_distance or 0) <= quality.MAX_WORD_DISTANCE for x in got)
