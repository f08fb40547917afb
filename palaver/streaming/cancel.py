"""Results as they come, and searches that a newer one ends."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession


class Latest:
    """Runs one result at a time: what starts ends what ran before it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._lock, self._tag = spark, threading.Lock(), None

    def cancel(self) -> None:
        """End the running result, if there is one."""
        with self._lock:
            if self._tag:
                self.spark.sparkContext.cancelJobsWithTag(self._tag)
                self._tag = None

    def rows(self, df: DataFrame) -> Iterator[Row]:
        """Rows of ``df``, a partition at a time, until they end or another result begins; then no more come."""
        self.cancel()
        tag = f"palaver-{uuid.uuid4().hex}"
        with self._lock:
            self._tag = tag
        context = self.spark.sparkContext
        context.addJobTag(tag)
        try:
            for row in df.toLocalIterator():
                if self._tag != tag:
                    return
                yield row
        finally:
            context.removeJobTag(tag)
            with self._lock:
                if self._tag == tag:
                    self._tag = None
