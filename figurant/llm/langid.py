"""Language identification by fusing evidence with Bayes' rule.

The likelihood of the text under each language comes from byte trigrams; a flat "und" model
stands for text of no known language. Declared language and address suffix add likelihoods,
and the host adds a prior that is smoothed towards its domain's, and that towards the whole
corpus's. Counts for all three are grouped aggregates over every row; what a row itself adds to
them is taken off again before it is judged, so that its text counts once.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from figurant.llm.stages import arrow_map, stage
from figurant.llm.words import Block, blocks, lowered, mix

#: Expected number of distinct texts of a label that the text model is fit on at most, and the
#: most labels.
FIT_TEXTS, MAX_LANGUAGES = 1000, 64
#: Trigram classes; trigrams that count as evidence at most (they aren't independent).
BUCKETS, EVIDENCE = 1 << 14, 100
#: Chance that a declared language is right; weight of the coarser prior at each level, in rows.
DECLARED_RIGHT, SMOOTH = 0.9, 20.0
UND, UND_PRIOR, LEAST = "und", 1e-3, 0.5


class Model(NamedTuple):
    languages: list[str]  # the last is UND
    logs: np.ndarray  # languages x BUCKETS


_LETTER = np.zeros(256, bool)
_LETTER[0x80:] = _LETTER[97:123] = True
_PROSE = _LETTER.copy()
_PROSE[[*b" \t\n.,'-"]] = True


def _lowered(block: Block) -> Block:
    return Block(block.first, block.last, lowered(block.raw), block.offsets, False)


def _trigrams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(document, class) of each three bytes of a document, lower-cased, that are prose and hold
    a letter (of ASCII, or a byte of another script): numbers, keys and markup say nothing."""
    x = block.data.astype(np.uint64)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter, prose = _LETTER[block.data], _PROSE[block.data]
    n = len(x) - 2
    some = (letter[:n] | letter[1 : n + 1] | letter[2:]) & prose[:n] & prose[1 : n + 1] & prose[2:]
    doc = np.repeat(np.arange(block.n_docs), np.diff(block.offsets))
    at = np.flatnonzero(some & (doc[:n] == doc[2:]))
    code = x[at] | (x[at + 1] << np.uint64(8)) | (x[at + 2] << np.uint64(16))
    return doc[at], (mix(code) % np.uint64(BUCKETS)).astype(np.int64)


def fit(labelled: DataFrame, texts: int = FIT_TEXTS) -> Model:
    """Fit the text model on rows (text, lang): about ``texts`` distinct texts, chosen by hash,
    of each of the ``MAX_LANGUAGES`` labels that have most distinct texts in all rows (counted
    approximately; ties by name). Labels are lower-cased. So a rare label has a model however
    large the table is, and copies of a text count once."""
    rows = labelled.where("lang is not null and text is not null").select(F.lower("lang").alias("lang"), "text", F.xxhash64("text").alias("h"))
    known = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    names = [r["lang"] for r in known]
    least = F.create_map(*(x for r in known for x in (F.lit(r["lang"]), F.lit(int((1 << 30) * min(1.0, texts / max(1, r["n"]))))))) if known else F.create_map(F.lit(""), F.lit(0))
    rows = rows.where(F.col("lang").isin(names) & (F.pmod("h", F.lit(1 << 30)) < F.element_at(least, F.col("lang")))).dropDuplicates(["lang", "h"])

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for block in blocks(batch.column("text")):
                doc, cls = _trigrams(_lowered(block))
                bounds = np.searchsorted(doc, np.arange(block.n_docs + 1))
                for d in range(block.n_docs):
                    c = sums.setdefault(langs[block.first + d], np.zeros(BUCKETS, np.int64))
                    c += np.bincount(cls[bounds[d] : bounds[d + 1]], minlength=BUCKETS)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at], pa.int64())], ["lang", "cls", "c"])

    # MAX_LANGUAGES x BUCKETS rows at most
    counts = arrow_map(rows.select("text", "lang"), count, "lang string, cls long, c long").groupBy("lang", "cls").agg(F.sum("c").alias("c")).toPandas()
    languages = sorted(set(counts.lang))
    logs = np.zeros((len(languages) + 1, BUCKETS))
    for i, lang in enumerate(languages):
        part = counts[counts.lang == lang]
        c = np.full(BUCKETS, 0.5)
        c[part.cls.to_numpy()] += part.c.to_numpy()
        logs[i] = np.log(c / c.sum())
    logs[-1] = math.log(1 / BUCKETS)
    return Model([*languages, UND], logs)


def scored(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``rows`` with ``scores``: the log-likelihood of the text under each language, and
    ``best``: the likeliest (null where no trigram tells). The text is read whole; its mean
    log-likelihood counts as that of ``EVIDENCE`` trigrams at most."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS, fixed
    names = rows.columns

    def run(batches):
        languages, logs = shared.value
        table = logs.T.copy()
        for batch in batches:
            scores = np.zeros((batch.num_rows, len(languages)))
            seen = np.zeros(batch.num_rows, bool)
            for block in blocks(batch.column(text)):
                doc, cls = _trigrams(_lowered(block))
                n = np.bincount(doc, minlength=block.n_docs)
                have = np.flatnonzero(n)
                if len(have):
                    first = np.searchsorted(doc, have)
                    rows_ = block.first + have
                    seen[rows_] = True
                    for k in range(len(languages)):
                        scores[rows_, k] = np.add.reduceat(table[cls, k], first) * (np.minimum(n[have], EVIDENCE) / n[have])
            best = pa.array([languages[i] if s else None for i, s in zip(scores.argmax(axis=1), seen, strict=True)], pa.string())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, scores.size + 1, len(languages), dtype=np.int32)), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists, best], [*names, "scores", "best"])

    return arrow_map(rows, run, StructType([*rows.schema.fields, StructField("scores", ArrayType(DoubleType())), *StructType.fromDDL("best string").fields]))


def _counts(languages: list[str]) -> Column:
    return F.array(*(F.count_if(F.col("best") == k).cast("double") for k in languages))


def _smoothed(counts: Column, coarser: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, coarser, lambda c, p: (c + SMOOTH * p) / (total + SMOOTH))


class Evidence(NamedTuple):
    hosts: DataFrame  # h, hd, c, d: counts of the languages on each host and its domain
    suffixes: DataFrame  # x, sc: those of each suffix
    overall: list[float]  # those of all rows
    with_suffix: list[float]  # those of rows that have a suffix
    n_suffixes: int


def evidence(best: DataFrame, model: Model) -> Evidence:
    """Counts of the likeliest languages from rows (host, domain, suffix, best), as arrays over
    the languages. All rows count; partial sums are made in each task, so a host with much of
    the table costs no more than others."""
    languages = model.languages
    add = lambda name: F.array(*(F.sum(F.get(name, F.lit(i))) for i in range(len(languages))))
    numbers = lambda df, name: [float(x or 0.0) for x in df.agg(add(name).alias("s")).first()["s"]]  # noqa: E731  one for each language
    hosts = stage(best.groupBy("host", "domain").agg(_counts(languages).alias("c")))
    domains = hosts.groupBy("domain").agg(add("c").alias("d")).select(F.col("domain").alias("k"), "d")
    joined = hosts.join(domains, F.col("domain").eqNullSafe(F.col("k"))).select(F.col("host").alias("h"), F.col("domain").alias("hd"), "c", "d")
    suffixes = stage(best.where("suffix is not null").groupBy(F.col("suffix").alias("x")).agg(_counts(languages).alias("sc")))
    return Evidence(stage(joined), suffixes, numbers(hosts, "c"), numbers(suffixes, "sc"), suffixes.count())


def _fused(found: Evidence, languages: list[str]) -> tuple[Column, Column]:
    """The prior and the suffix's likelihood of a row (best, c, d, sc), its own text left out."""
    own = F.array(*(F.coalesce(F.col("best") == k, F.lit(False)).cast("double") for k in languages))
    zeros, flat = F.array(*[F.lit(0.0)] * len(languages)), F.array(*[F.lit(1.0)] * len(languages))
    rest = lambda counts: F.zip_with(F.coalesce(counts, zeros), own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    base = F.array(*(F.lit(UND_PRIOR if k == UND else (1 - UND_PRIOR) / (len(languages) - 1)) for k in languages)) if len(languages) > 1 else flat
    prior = base
    for counts in (F.array(*map(F.lit, found.overall)), F.col("d"), F.col("c")):
        prior = _smoothed(rest(counts), prior)
    n = float(max(1, found.n_suffixes))
    suffix = F.zip_with(rest(F.col("sc")), rest(F.array(*map(F.lit, found.with_suffix))), lambda c, t: (c + 1.0) / (t + n))
    return prior, F.when(F.col("sc").isNotNull(), suffix).otherwise(flat)


def identify(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (any columns, with text, declared, host, domain, suffix) with language,
    posterior, text_language, accepted.

    ``declared`` counts where it is one of the model's languages (``en-GB`` as ``en``); null
    hosts, domains and suffixes are groups of their own, except that a null suffix is no
    evidence. A row is accepted if a known language has a posterior of ``LEAST`` or more and
    the text has a letter; null, empty and letterless texts aren't (language null). Repeated
    rows are judged alike; columns of the names that are added are replaced. The text is scored
    twice, which is cheaper than to store the scores; both tables of evidence are joined by
    broadcast only where Spark finds them small.
    """
    known = model.languages
    given, made = ("text", "declared", "host", "domain", "suffix"), ("language", "posterior", "text_language", "accepted")
    others = [c for c in rows.columns if c not in given + made]
    slim = rows.select("text", "host", "domain", "suffix")
    found = evidence(scored(slim, model).select("host", "domain", "suffix", "best"), model)
    s = scored(rows.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in others)).alias("__row"), *given), model)
    s = s.join(found.hosts, F.col("host").eqNullSafe(F.col("h")) & F.col("domain").eqNullSafe(F.col("hd")), "left").join(found.suffixes, F.col("suffix") == F.col("x"), "left")
    prior, suffix = _fused(found, known)
    flat = F.array(*[F.lit(1.0)] * len(known))
    claim = F.lower(F.regexp_extract(F.coalesce("declared", F.lit("")), "^[A-Za-z]+", 0))
    wrong = (1 - DECLARED_RIGHT) / max(1, len(known) - 1)
    said = F.when(claim.isin(known[:-1]), F.array(*(F.when(claim == k, F.lit(DECLARED_RIGHT)).otherwise(F.lit(wrong)) for k in known))).otherwise(flat)
    logs = F.col("scores")
    for part in (said, prior, suffix):
        logs = F.zip_with(logs, part, lambda a, p: a + F.log(p))
    s = s.withColumn("__logs", logs).withColumn("__top", F.array_max("__logs"))
    s = s.withColumn("__sum", F.aggregate("__logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__top"))))
    pick = F.element_at(F.array(*map(F.lit, known)), F.array_position("__logs", F.col("__top")).cast("int"))
    seen = F.coalesce(F.col("text").rlike(r"[A-Za-z]|[^\x00-\x7F]"), F.lit(False))
    language, posterior = F.when(seen, pick), F.when(seen, 1.0 / F.col("__sum"))
    accepted = F.coalesce(seen & (pick != UND) & (posterior >= LEAST), F.lit(False))
    kept = (F.col(c) if c in given else F.col(f"__row.`{c}`").alias(c) for c in rows.columns if c not in made)
    return s.select(*kept, language.alias("language"), posterior.alias("posterior"), F.col("best").alias("text_language"), accepted.alias("accepted"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text (without tags, scripts and styles), declared (the html element's lang),
    host, domain (its last two labels), suffix (its last label)."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]*>", " "), r"&[a-zA-Z]+;|&#\d+;", " ")
    declared = F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1), F.lit(""))
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    p = pages.select("page_id", text.alias("text"), declared.alias("declared"), host.alias("host"))
    return p.withColumn("domain", F.regexp_extract("host", r"[^.]+(\.[^.]+)?$", 0)).withColumn("suffix", F.nullif(F.regexp_extract("host", r"[^.]+$", 0), F.lit("")))


def document_evidence(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under ``__doc``, with its lang as declared and source as host."""
    return docs.select(F.struct(*docs.columns).alias("__doc"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("suffix"))
