"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents form one line of tokens, packed into blocks of ``BLOCK`` tokens. A
source's share of the mix is a number of block slots. How many slots of each source an output
shard gets is drawn: the counts are multinomial, given the sources' totals, which are fixed so
that each source meets its target. A shard's slots of a source are those between its counts and
the ones before it; a slot's index goes through the source's own pseudorandom permutation of
block indexes, and the blocks are joined by that index.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figurant.llm.stages import WORD, discard, stage

#: Tokens of a block.
BLOCK = 64
#: Weights of the sources in order of their names, repeated; the mix's size over the input's.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: Slots of an output shard, on average.
SHARD_SLOTS = 8192
#: Documents of a run within a source that one task lays out: runs grow in number, not in size.
RUN_DOCS = 2_000
ROUNDS = 8
#: Shards, and runs, that are listed and summed together: two steps reach a million times more.
FAN = 1024
#: Up to so many slots are halved by fair coins one by one, more by a normal draw.
COINS = 256


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, mark (a hash of the text), copy (0 for the first of equal rows), size
    (words; 0 for null and empty texts)."""
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("mark"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return rows.withColumn("copy", F.row_number().over(W.partitionBy("doc_id", "source", "mark").orderBy("size")) - 1)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """A row per source: source, rank, docs, source_size, target.

    Sources weigh ``weights`` in order of their code points, null last. Targets split ``share``
    times all sizes by weight and stop at ``cap`` times the source's own size; what is over is
    shared again by weight among the rest. In order of cap over weight the stopped sources come
    first, so a running sum over the sources (one row each) finds the level of the others.
    """
    each = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    rank = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    s = each.withColumn("rank", rank).withColumn("weight", weight.cast("long"))
    whole, before = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("weight"))
    s = s.withColumn("left", F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0)))
    s = s.withColumn("w", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("stopped", F.col("most") * F.col("w") <= F.col("left") * F.col("weight"))
    level = F.first(F.when(~F.col("stopped"), F.col("left") / F.col("w")), ignorenulls=True).over(W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    s = s.withColumn("level", level)
    target = F.when(F.col("stopped"), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")))
    return s.select("source", "rank", "docs", "source_size", target.alias("target"))


def permuted(index: Column, size: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. size - 1 for each ``key``, at ``index``: rounds of
    swap-or-not, each of which exchanges x and k - x or leaves both (no search, any size)."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), size) - x, size)
        swap = F.xxhash64(*key, r, F.greatest(x, other), F.lit(7)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), step)


def halved(n: Column, *key: Column) -> Column:
    """A binomial draw: how many of ``n`` slots fall in the first of two halves. Up to ``COINS``
    are the bits of hashes, more a normal draw rounded (two uniform hashes, Box and Muller)."""
    bits = F.lit(0).cast("long")
    for word in range(COINS // 64):
        left = F.greatest(F.least(n - 64 * word, F.lit(64)), F.lit(0)).cast("int")
        mask = F.when(left >= 64, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), left) - 1)
        bits = bits + F.bit_count(F.xxhash64(*key, F.lit(word)).bitwiseAND(mask))
    uniform = lambda k: (F.pmod(F.xxhash64(*key, F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = F.sqrt(-2 * F.ln(uniform(101))) * F.cos(2 * math.pi * uniform(102))
    drawn = F.round(n / 2 + normal * F.sqrt(n.cast("double")) / 2).cast("long")
    return F.when(n <= COINS, bits).otherwise(F.least(F.greatest(drawn, F.lit(0)), n)).cast("long")


def shard_counts(sources: DataFrame, seed: int, block: int = BLOCK) -> DataFrame:
    """The columns of ``sources`` that slots need, with shard, first, count: a row for each
    source and shard that has some of its slots, ``first`` being the number of the source's
    slots in earlier shards. The shards are halved again and again (there are a power of two of
    them), and each half's count is drawn, so no row has to know another."""
    want = F.floor("target")
    s = sources.where("source_size > 0").select("rank", "source_size", want.alias("want"))
    s = s.withColumn("full", F.floor(F.col("source_size") / block)).withColumn("tail", F.col("source_size") - F.col("full") * block)
    s = s.withColumn("passes", F.floor(F.col("want") / F.col("source_size"))).withColumn("rest", F.col("want") - F.col("passes") * F.col("source_size"))
    per = F.col("full") + F.when(F.col("tail") > 0, 1).otherwise(0)
    s = s.withColumn("per", per).withColumn("n", F.col("passes") * per + F.ceil(F.col("rest") / block))
    total = F.sum("n").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    s = s.withColumn("levels", F.greatest(F.lit(0), F.ceil(F.log2(total / SHARD_SLOTS))).cast("int")).where("n > 0")
    shards = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("levels"))
    s = s.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((shards - 1) / FAN))))
    s = s.withColumn("shard", F.explode(F.sequence(F.col("x") * FAN, F.least(shards, (F.col("x") + 1) * FAN) - 1))).drop("x")

    def step(at: Column, level: Column) -> Column:
        rest = F.col("levels") - level
        branch = F.call_function("shiftright", F.col("shard"), rest)
        low = halved(at["count"], F.lit(seed), F.lit("shard"), F.col("rank"), level, F.call_function("shiftright", branch, F.lit(1)))
        second = branch.bitwiseAND(F.lit(1)) == 1
        return F.struct(F.when(second, at["first"] + low).otherwise(at["first"]).alias("first"), F.when(second, at["count"] - low).otherwise(low).alias("count"))

    zero = F.struct(F.lit(0).cast("long").alias("first"), F.col("n").alias("count"))
    levels = F.when(F.col("levels") > 0, F.sequence(F.lit(1), F.col("levels"))).otherwise(F.array().cast("array<int>"))
    s = s.withColumn("drawn", F.aggregate(levels, zero, step)).drop("levels", "n", "want", "source_size")
    return s.select("*", "drawn.first", "drawn.count").drop("drawn").where("count > 0")


def slots(sources: DataFrame, seed: int, block: int = BLOCK) -> DataFrame:
    """rank, slot, epoch, shard, block, length: a row per slot of the mix. Whole passes over a
    source come first; the last pass takes whole blocks in permuted order, then what is missing."""
    s = shard_counts(sources, seed, block)
    # a number of its own: the rows are few before they are exploded, and would be put together
    s = s.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rank", "shard")
    s = s.withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)))
    s = s.withColumn("epoch", F.floor(F.col("slot") / F.col("per"))).withColumn("j", F.col("slot") - F.col("epoch") * F.col("per"))
    index = F.when(F.col("j") < F.col("full"), permuted(F.col("j"), F.col("full"), F.lit(seed), F.col("rank"), F.col("epoch"))).otherwise(F.col("full"))
    whole = F.when(F.col("j") < F.col("full"), F.lit(block)).otherwise(F.col("tail"))
    length = F.when(F.col("epoch") < F.col("passes"), whole).otherwise(F.least(whole, F.col("rest") - F.col("j") * block))
    return s.select("rank", "slot", "epoch", "shard", index.alias("block"), length.alias("length"))


def laid_out(sized: DataFrame, sources: DataFrame, seed: int, block: int = BLOCK) -> DataFrame:
    """doc_id, source, mark, copy, rank, block, part_from, part_to (in the block), word_from:
    the pieces of documents that blocks hold. Documents lie in pseudorandom order within runs
    of about ``RUN_DOCS``, so a source of any size is laid out by many tasks."""
    key = ("doc_id", "source", "mark", "copy")
    d = sized.where("size > 0").join(sources.select(F.col("source").alias("s"), "rank", "docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    dice = F.xxhash64(F.lit(seed), *key)
    d = d.withColumn("dice", dice).withColumn("run", F.pmod("dice", F.ceil(F.col("docs") / RUN_DOCS)))
    in_run = W.partitionBy("rank", "run").orderBy(F.xxhash64("dice"), *key).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("start", F.coalesce(F.sum("size").over(in_run), F.lit(0)))
    runs = d.groupBy("rank", "run").agg(F.sum("size").alias("n"))
    before = lambda *by: F.coalesce(F.sum("n").over(W.partitionBy("rank", *by).orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("far", F.floor(F.col("run") / FAN))
    far = runs.groupBy("rank", F.col("far").alias("run")).agg(F.sum("n").alias("n")).select("rank", F.col("run").alias("far"), before().alias("far_base"))
    runs = runs.withColumn("base", before("far")).join(far.hint("merge"), ["rank", "far"]).select("rank", "run", (F.col("base") + F.col("far_base")).alias("base"))
    d = d.join(runs.hint("merge"), ["rank", "run"]).withColumn("start", F.col("start") + F.col("base")).withColumn("end", F.col("start") + F.col("size"))
    d = d.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    low, high = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("end"), (F.col("block") + 1) * block)
    return d.select(*key, "rank", "block", (low - F.col("block") * block).alias("part_from"), (high - F.col("block") * block).alias("part_to"), (low - F.col("start")).alias("word_from"))


def taken_pieces(sized: DataFrame, sources: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """doc_id, source, mark, copy, rank, slot, epoch, shard, part_from, word_from, words: what the
    mix takes. Both sides
    grow with the corpus though Spark takes the exploded slots for small: the hint keeps them
    from a broadcast, here and below."""
    parts, drawn = laid_out(sized, sources, seed, block), slots(sources, seed, block)
    words = F.least("part_to", "length") - F.col("part_from")
    return parts.join(drawn.hint("merge"), ["rank", "block"]).withColumn("words", words).where("words > 0").select("doc_id", "source", "mark", "copy", "rank", "slot", "epoch", "shard", "part_from", "word_from", "words")


def prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``sizes`` and ``targets`` of all documents, as tables in the shared folder."""
    sized = stage(sizes(docs))
    return sized, stage(targets(sized).coalesce(1))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken: a row per row of ``docs``.

    ``taken`` counts the document's words in the mix, repeats included; it is at most twice its
    size, and a source's sum is its target rounded down. Documents without words take none. A
    null source is a source. Rows that are equal count as documents of their own. An empty
    table gives no rows; further columns are ignored. Equal input and seed give equal output,
    however it is partitioned.
    """
    sized, sources = prepared(docs)
    key = ["doc_id", "source", "mark", "copy"]
    sums = taken_pieces(sized, sources, seed).groupBy(*key).agg(F.sum("words").alias("t"))
    sums = sums.select(*(F.col(c).alias(f"k_{c}") for c in key), "t")
    same = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in key]
    out = sized.join(sums.hint("merge"), same[0] & same[1] & same[2] & same[3], "left")
    out = out.join(sources.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("t", F.lit(0)).cast("long").alias("taken"))


def _with_pieces(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """``pieces`` (k_doc_id, k_source, k_mark, k_copy) with ``row``, the row of ``docs``, and its
    ``words``."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("text").alias("m"))
    copy = (F.row_number().over(W.partitionBy("row.doc_id", "row.source", "m").orderBy("m")) - 1).alias("k")
    rows = rows.select("row", F.col("row.doc_id").alias("i"), F.col("row.source").alias("s"), "m", copy)
    same = F.col("i").eqNullSafe(F.col("k_doc_id")) & F.col("s").eqNullSafe(F.col("k_source")) & F.col("m").eqNullSafe(F.col("k_mark")) & (F.col("k") == F.col("k_copy"))
    return rows.join(pieces.hint("merge"), same).withColumn("words", F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)))


def _cut(piece: Column) -> Column:
    return F.slice("words", (piece["word_from"] + 1).cast("int"), piece["words"].cast("int"))


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix as documents: a row for each document and pass that takes words of it, with the
    columns of ``docs``, whatever their names. A document taken whole keeps its text; of others
    the taken words stand in their order, joined by spaces. ``n_chars`` follows the text where it
    exists."""
    sized, sources = prepared(docs)
    key = ["doc_id", "source", "mark", "copy"]
    spans = taken_pieces(sized, sources, seed).groupBy(*key, "epoch").agg(F.sort_array(F.collect_list(F.struct("word_from", "words"))).alias("spans"), F.sum("words").alias("t"))
    spans = stage(spans)  # the texts are dealt out when all else is done
    discard(sized, sources)
    both = _with_pieces(docs, spans.select(*(F.col(c).alias(f"k_{c}") for c in key), "spans", "t"))
    cut = F.flatten(F.transform("spans", _cut))
    both = both.withColumn("new_text", F.when(F.col("t") == F.size("words"), F.col("row.text")).otherwise(F.array_join(cut, " ")))
    new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return both.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mixed_blocks(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix as blocks: shard, source, slot, n_words, text (words joined by one space).
    A shard has as many rows of each source as were drawn for it; write by ``shard``."""
    sized, sources = prepared(docs)
    key = ["doc_id", "source", "mark", "copy"]
    pieces = taken_pieces(sized, sources, seed)
    of_document = pieces.groupBy(*key).agg(F.collect_list(F.struct("shard", "rank", "slot", "part_from", "word_from", "words")).alias("pieces"))
    both = _with_pieces(docs, of_document.select(*(F.col(c).alias(f"k_{c}") for c in key), "pieces"))
    parts = both.select("s", F.explode(F.transform("pieces", lambda p: F.struct(p["shard"].alias("shard"), p["rank"].alias("rank"), p["slot"].alias("slot"), p["part_from"].alias("part_from"), _cut(p).alias("cut")))).alias("p")).select("s", "p.*")
    blocks = parts.groupBy("shard", "rank", "slot").agg(F.first("s").alias("source"), F.sort_array(F.collect_list(F.struct("part_from", "cut"))).alias("parts"))
    words = F.flatten(F.transform("parts", lambda x: x["cut"]))
    return blocks.select("shard", "source", "slot", F.size(words).cast("long").alias("n_words"), F.array_join(words, " ").alias("text"))
