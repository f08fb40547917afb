"""The index kept fresh by a stream of appended lines, and tables merged by key from streams.

A table of rows by key is kept in buckets; a batch rewrites the buckets that it touches
and no others.  Of rows of one key that with the greatest order stays, of equal orders
the greatest row: that does not depend on the sequence of batches, so one that comes
late or twice, as after a restart, changes nothing that it should not.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from palaver.operators import index
from palaver.sources.lease import Lease
from palaver.sources.store import Store
from palaver.streaming import source


def keep_fresh(spark: SparkSession, corpus: str, root: str, work: str, seconds: int = 30, home: str = "/", once: bool = False) -> StreamingQuery:
    """A running query that brings the index up to date with what is appended; ``work`` holds its checkpoint and snapshots.

    A batch names the sessions that grew, so these alone are listed and read; one without lines (files were deleted, or
    only parts of lines came) is a sweep.  With ``once`` it ends when all is read.
    """
    stream = source.appended(spark, corpus, f"{work}/snapshots")

    def sweep(batch: DataFrame, _: int) -> None:
        paths = [r[0] for r in batch.select("session_path").distinct().limit(index.NAMED + 1).collect()]
        index.refresh(batch.sparkSession, corpus, root, paths if 0 < len(paths) <= index.NAMED else None, home)

    writer = stream.writeStream.foreachBatch(sweep).option("checkpointLocation", f"{work}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


class KeyedTable:
    """A table of one row a key below ``root``, in buckets of the key."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, order: str, buckets: int = 64) -> None:
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark, root)
        self.schema, self.key, self.order, self.buckets = StructType.fromDDL(schema), key, order, buckets

    def _state(self) -> tuple[int, dict]:
        """The number of the present state, and the folder of each bucket that has rows."""
        names = sorted(n for n, _ in self.store.names() if re.match(r"_table-\d{12}\.json$", n))
        return (int(names[-1][7:19]), json.loads(self.store.read(names[-1]))) if names else (0, {"folders": {}, "retired": []})

    def _read(self, folders: dict[str, str]) -> DataFrame:
        found = [self.spark.read.schema(self.schema).parquet(f"{self.root}/{folder}/bucket={b}") for b, folder in folders.items()]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        return self._read(self._state()[1]["folders"])

    def merge(self, batch: DataFrame) -> list[int]:
        """Take the rows of ``batch`` in; the buckets rewritten.  Rows without key are passed over."""
        bucket = F.pmod(F.crc32(F.col(self.key).cast("string").cast("binary")), F.lit(self.buckets)).cast("int")
        columns = [f.name for f in self.schema]
        row = F.struct(F.col(self.order).alias("_order"), *columns)
        best = lambda df: df.groupBy(self.key).agg(F.max(row).alias("_r")).select("_r.*").drop("_order")
        with Lease(self.store) as lease:
            number, state = self._state()
            folder = f"merge-{number + 1}-{uuid.uuid4().hex[:8]}"
            given = best(batch.select(*columns).filter(F.col(self.key).isNotNull()))
            given.write.parquet(f"{self.root}/{folder}-given")
            given = self.spark.read.schema(self.schema).parquet(f"{self.root}/{folder}-given")
            touched = sorted(r[0] for r in given.select(bucket.alias("b")).distinct().collect())
            if touched:
                old = self._read({str(b): state["folders"][str(b)] for b in touched if str(b) in state["folders"]})
                both = best(old.unionByName(given)).withColumn("bucket", bucket)
                both.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
                folders = state["folders"] | {str(b): folder for b in touched}
                retired = sorted(set(state["folders"].values()) - set(folders.values()))
                lease.check()
                self.store.write(f"_table-{number + 1:012d}.json", json.dumps({"folders": folders, "retired": retired}))
                for name in [*state["retired"], f"_table-{number - 1:012d}.json"]:
                    self.store.delete(name)
            self.store.delete(f"{folder}-given")
        return touched


def merge_stream(stream: DataFrame, table: KeyedTable, checkpoint: str, once: bool = False, seconds: int = 1) -> StreamingQuery:
    """A running query that merges each batch of ``stream`` into ``table``."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: table.merge(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``old`` with the latest row of each key of ``new`` in its place."""
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
    return old.join(last, key, "left_anti").unionByName(last)
