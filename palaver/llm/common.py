"""Helpers shared by the training-data operators: shared folders and joins that
stay even when one key holds a large share of all rows."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_SHARE of the rows, so there are
#: fewer than HOT_SHARE hot keys whatever the size of the input.
HOT_SHARE = 1000


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  A temporary one if none is set, only where they are one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palaver-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """URI of a new folder below the shared one."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back.

    For loops of many rounds: with checkpoints, rounds on a chain of 60 links grew
    from one second to minutes, probably by constraints that a checkpoint carries
    along from its plan; with written tables they stay level.
    """
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def hot_left_join(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """Left join on ``key``; ``right`` has one row a key and ``count``, how many
    rows ``left`` has of it.

    Rows of hot keys meet a broadcast of fewer than HOT_SHARE rows of ``right``
    and stay where they are; only the others are shuffled.  ``right`` should be
    materialised, as it is read twice.  ``count`` is dropped.  Null keys match
    nothing and are not shuffled.
    """
    total = right.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    hot = right.filter(F.col(count) * HOT_SHARE > F.lit(total))
    cold = right.filter(F.col(count) * HOT_SHARE <= F.lit(total)).drop(count)
    mark = hot.select(key, F.lit(True).alias("_hot"))
    marked = left.join(F.broadcast(mark), key, "left")
    stays = F.col("_hot").isNotNull() | F.col(key).isNull()
    there = marked.filter(stays).drop("_hot").join(F.broadcast(hot.drop(count)), key, "left")
    rest = marked.filter(~stays).drop("_hot").join(cold, key, "left")
    return there.unionByName(rest)


def values(column: pa.Array, rows: int = 64) -> Iterator[bytes | None]:
    """The texts of an Arrow column as bytes, ``rows`` of them copied at a time."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).cast(pa.large_binary()).to_pylist()


def lean(apply: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``apply``, after which the worker gives freed memory back to the system.

    Workers serve the tasks of one stage after the other, and what an allocator keeps
    of each stage's peak counts against the executor in all later ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from apply(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return run


def guarded(docs: DataFrame, needed: set[str], apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``apply`` to ``docs`` with all columns but ``needed`` under names that clash with none of its own."""
    safe = [(c, c if c in needed else f"_own_{k}") for k, c in enumerate(docs.columns)]
    out = apply(docs.select(*[F.col(f"`{c}`").alias(own) for c, own in safe]))
    return out.select(*[F.col(own).alias(c) for c, own in safe])
