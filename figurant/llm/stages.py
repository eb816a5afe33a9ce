"""Shared pieces: tables in the shared scratch folder, and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: code points 9 to 13 and 32.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``. Where that is unset, which is so
    only on a single machine (tests), a temporary folder takes its place for the session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="figurant-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Shuffle files of a query that is over go at once, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. This cuts the lineage, and a lost
    executor costs no more than the tasks that were running on it. The shuffle files behind
    ``df`` are deleted when it is written, the table itself by ``discard``."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stage`` returned, after their last reader has been written. Other
    DataFrames are left alone."""
    for df in tables:
        if path := df.__dict__.pop("staged_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def identified(rows: DataFrame) -> DataFrame:
    """``rows`` with ``d`` and ``mark``, which are never null and tell documents apart: the
    doc_id (null: the least long) and a 64-bit hash of the text and of whether the id is null."""
    return rows.withColumn("d", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("mark", F.xxhash64("text", F.col("doc_id").isNull()))


#: Bytes of the batches that go to Python: texts may be long, so rows alone don't bound them.
BATCH_BYTES = 4 << 20


def _trim() -> None:
    """Give memory that a finished task no longer needs back to the machine, since the worker
    stays for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such call
        pass


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` in batches of about ``BATCH_BYTES``, a setting of the session that is
    only ever lowered."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _trim()

    return df.mapInArrow(mapped, schema)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over as many tasks as the session's shuffles have, for input of few splits
    and much work a row."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n)


#: Links (16 bytes each) up to which one task finds the components.
LINKS_OF_ONE_TASK = 1 << 20


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 .. n - 1 and links a - b the least node of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            return label


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
    if got:
        a, b = (np.concatenate(x) for x in zip(*got, strict=True))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = least_labels(len(ids), at[: len(a)], at[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["id", "component"])


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has longs ``a`` and ``b``. Returns (id, component) for every end of an edge;
    ``component`` is the smallest id reachable from it. Nulls and loops are dropped; repeats
    count once.

    ``edges`` should be a staged table, as it is read twice: the links are counted first. Up to
    ``LINKS_OF_ONE_TASK`` of them are a few megabytes, which one task labels. Beyond that, large-star and small-star steps alternate until nothing
    changes: each is one aggregate and one join on the node, so no neighbourhood is ever
    gathered in one place, and a hub's rows can be split between tasks.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if edges.count() <= LINKS_OF_ONE_TASK:
        return stage(arrow_map(edges.coalesce(1), _labelled, "id long, component long"))
    now, mark = stage(edges.distinct()), None
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(hung.union(low.select("a", F.col("m").alias("b"))).distinct())
        seen = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    ends = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.union(now.select(F.col("b"), F.col("b")).distinct())
