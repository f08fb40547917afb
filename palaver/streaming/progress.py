"""What streaming queries and index builds have done so far, as tables.

A Progress listens to the queries of a session from when it is registered.  It holds one
row a query, of the KEPT seen last, so it stays small however long the queries run.
Events come after the fact and on another thread: counts lag behind the work.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent

from palaver.operators import index

KEPT = 1000
SCHEMA = "run_id string, query_id string, name string, state string, batches long, rows long, last_batch long, error string"


class Progress(StreamingQueryListener):
    """One row for each run of a streaming query: ``running``, ``waiting`` for rows, ``ended`` or ``failed``;
    its batches that had rows, and their rows.  A query started again from its checkpoint is another run."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._lock, self._runs = spark, threading.Lock(), {}

    def __enter__(self) -> Progress:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.streams.removeListener(self)

    def _note(self, run: object, **new: object) -> dict:
        """The row of a run, changed; it becomes the last one seen."""
        row = self._runs.pop(str(run), {"query_id": None, "name": None, "state": "running", "batches": 0, "rows": 0, "last_batch": None, "error": None})
        self._runs[str(run)] = row | new
        while len(self._runs) > KEPT:
            del self._runs[next(iter(self._runs))]
        return row

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        with self._lock:
            self._note(event.runId, query_id=str(event.id), name=event.name, state="running")

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        with self._lock:
            row = self._note(p.runId, query_id=str(p.id), name=p.name, state="running")
            if p.numInputRows > 0:
                self._note(p.runId, batches=row["batches"] + 1, rows=row["rows"] + p.numInputRows, last_batch=p.batchId)

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        with self._lock:
            self._note(event.runId, query_id=str(event.id), state="waiting")

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        with self._lock:
            self._note(event.runId, query_id=str(event.id), state="failed" if event.exception else "ended", error=event.exception)

    def runs(self) -> DataFrame:
        """The rows, as of now."""
        with self._lock:
            rows = [{"run_id": run, **row} for run, row in self._runs.items()]
        return self.spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


def index_counts(spark: SparkSession, corpus: str, root: str) -> DataFrame:
    """One row: the sessions on disk and those of them indexed, the blocks, whether a writer is at work, and the share done."""
    now = index.status(spark, corpus, root)
    share = now["indexed_sessions"] / now["total_sessions"] if now["total_sessions"] else 1.0
    return spark.createDataFrame([(now["total_sessions"], now["indexed_sessions"], now["blocks"], now["building"], share)], "total_sessions long, indexed_sessions long, blocks long, building boolean, share double")
