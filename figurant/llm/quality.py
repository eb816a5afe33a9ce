"""Quality rules by distribution divergence, with DataFrame functions only.

Each document's histograms of character classes and of its language's common words are
compared with the language's own, which are summed over all other documents, by Jensen-Shannon
distance. Documents under a minimum length get no verdict from a histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figurant.llm.stages import WORD, stage

#: Common words of each language that has a reference (fixed values).
COMMON = {
    "de": ("der", "die", "und", "in", "den", "das", "von", "zu", "ist", "mit", "sich", "auf", "für", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an", "werden", "aus"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "are", "as", "with", "be", "by", "at", "this", "from", "or", "an", "have", "not"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como", "más", "o", "pero"),
    "fr": ("de", "la", "le", "et", "les", "des", "un", "une", "en", "du", "que", "est", "dans", "qui", "il", "pour", "pas", "au", "sur", "ne", "se", "plus", "par", "ce"),
}
#: A text of fewer characters or words gets no verdict from that histogram.
MIN_CHARS, MIN_WORDS = 200, 80
#: A text farther than this from its language's reference fails. The word distance and its
#: guard are set by labels: no text labelled good is lost for its words, and of those labelled bad
#: that pass the base rules 11 percent are kept (texts without common words have about 0.34).
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.29
#: The base rules: least words, and the most words in repeated windows, in percent.
BASE_WORDS, WINDOW, BASE_REPEATED = 10, 5, 20


def word_array(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def window_hashes(words: Column, n: Column) -> Column:
    """64-bit hashes of the five-word windows: pairs, then pairs of pairs, then the last word."""
    m = F.greatest(n - (WINDOW - 1), F.lit(0))
    join = lambda a, b: F.xxhash64(a, b)
    one = F.transform(words, lambda w: F.xxhash64(w))
    pairs = F.zip_with(F.slice(one, 1, m + 2), F.slice(one, 2, m + 2), join)
    return F.zip_with(F.zip_with(F.slice(pairs, 1, m), F.slice(pairs, 3, m), join), F.slice(one, WINDOW, m), join)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of counts; null if either is
    null or sums to 0."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    share = lambda a: F.transform(a, lambda x: x / F.nullif(total(a), F.lit(0.0)))

    def term(x: Column, y: Column) -> Column:
        middle = (x + y) / 2
        part = lambda v: F.when(v > 0, v * F.log2(v / middle)).otherwise(0.0)
        return (part(x) + part(y)) / 2

    square = F.aggregate(F.zip_with(share(p), share(q), term), F.lit(0.0), lambda s, x: s + x)
    return F.when(square.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), square)))


def measures(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, lang, the base counts, and the histograms ``classes``
    (array<double>: other letters, capitals, digits, points, symbols, characters beyond ASCII and
    white space, which add up to the text) and ``common`` (array<double>; null if the language has no word list)."""
    d = docs.select("doc_id", F.lower("lang").alias("lang"), F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumn("words", word_array(F.col("t"))).withColumn("n", F.size("words"))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)))
    d = d.withColumn("h", window_hashes(F.col("words"), F.col("n")))
    d = d.withColumn("z", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    again = F.filter("z", lambda s, i: ((i > 0) & (F.get("z", i - 1)["x"] == s["x"])) | (F.get("z", i + 1)["x"] == s["x"]))
    d = d.withColumn("at", F.sort_array(F.transform(again, lambda s: s["i"])))
    steps = F.zip_with(F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0))), F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), lambda b, a: F.least(F.lit(WINDOW), b - a))
    repeated = F.when(F.coalesce(F.size("at"), F.lit(0)) > 0, WINDOW + F.aggregate(steps, F.lit(0), lambda s, x: s + x)).otherwise(0)
    chars, letters = F.length("t"), F.length(F.array_join("words", ""))
    without = lambda runs: F.length("t") - F.length(F.regexp_replace("t", runs, ""))
    known = F.create_map(*(x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    listed = sorted({w for v in COMMON.values() for w in v})
    d = d.select(
        "doc_id", "lang", chars.alias("chars"), F.col("n").cast("long").alias("n_words"), letters.cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        without("[0-9]+").alias("digits"), without("[A-Z]+").alias("capitals"), without("[.,;:!?'\"()-]+").alias("points"),
        without(r"[^\x00-\x7F]+").alias("wide"),
        F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(listed)).alias("seen"), F.element_at(known, F.col("lang")).alias("list"),
    )
    rest = F.col("word_chars") - F.col("n_symbols") - F.col("digits") - F.col("capitals") - F.col("points") - F.col("wide")
    spaces = F.col("chars") - F.col("word_chars")
    classes = F.array(*(c.cast("double") for c in (rest, F.col("capitals"), F.col("digits"), F.col("points"), F.col("n_symbols"), F.col("wide"), spaces)))
    counts = F.transform("list", lambda c: F.size(F.filter("seen", lambda w: w == c)).cast("double"))
    return d.withColumn("classes", classes).withColumn("counts", counts).select(
        "doc_id", "lang", "chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes",
        F.when(F.col("list").isNotNull(), F.concat("counts", F.array(F.col("n_words") - F.aggregate("counts", F.lit(0.0), lambda s, x: s + x)))).alias("common"),
    )


def _referred() -> Column:
    """Whether a document counts in its language's reference."""
    return F.coalesce(F.col("lang").isin(list(COMMON)), F.lit(False)) & ~base_failed() & (F.col("chars") >= MIN_CHARS) & (F.col("n_words") >= MIN_WORDS)


def references(measured: DataFrame) -> DataFrame:
    """lang, ref_classes, ref_common: sums over all documents that pass the base rules and the
    length guards; a row for each language of ``COMMON`` at most."""
    fit = measured.where(_referred())
    size = 1 + max(map(len, COMMON.values()))
    sums = lambda name, k: F.array(*(F.sum(F.get(name, F.lit(i)).cast("long")).cast("double") for i in range(k)))
    return fit.groupBy("lang").agg(sums("classes", 7).alias("ref_classes"), sums("common", size).alias("ref_common"))


def base_failed() -> Column:
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATED * F.col("n_words"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs), base_failed,
    kept, char_distance and word_distance (doubles, null where there was no verdict).

    Null texts count as empty and fail the base rules. Documents with a null language or one
    without a reference are kept if the base rules pass. Repeated rows are judged alike; an
    empty table gives no rows; further columns are ignored. Windows are compared by 64-bit
    hashes within a document. The texts are read once: what is measured (a few hundred bytes a
    document) goes through the shared folder, since the references need all of it.
    """
    measured = stage(measures(docs))
    refs = F.broadcast(references(measured).withColumnRenamed("lang", "l"))  # a row per language of COMMON
    d = measured.join(refs, F.col("lang") == F.col("l"), "left").withColumn("base_failed", base_failed())
    others = lambda ref, own: F.when(_referred(), F.zip_with(ref, own, lambda a, b: a - b)).otherwise(F.col(ref))
    d = d.withColumn("ref_classes", others("ref_classes", "classes")).withColumn("ref_common", others("ref_common", "common"))
    d = d.withColumn("char_distance", F.when(F.col("chars") >= MIN_CHARS, distance(F.col("classes"), F.col("ref_classes"))))
    d = d.withColumn("word_distance", F.when(F.col("n_words") >= MIN_WORDS, distance(F.col("common"), F.col("ref_common"))))
    fine = (F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fine).alias("kept"), "char_distance", "word_distance")
