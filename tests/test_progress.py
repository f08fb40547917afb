"""Counts of streams and of builds while they run."""

from __future__ import annotations

import json
import threading
import time

import pytest

from palaver.functions import text as T
from palaver.operators import index
from palaver.streaming import progress, refresh
from pyspark.sql import functions as F


def said(text):
    return json.dumps({"type": "user", "message": {"content": text}}) + "\n"


def until(seen, seconds=60):
    """``seen`` until it holds; events come on another thread."""
    end = time.time() + seconds
    while not (found := seen()) and time.time() < end:
        time.sleep(0.1)
    return found


def test_listener_counts_batches_and_states(spark, tmp_path):
    own, corpus = tmp_path / "projects" / "p", f"file:{tmp_path}/projects"
    own.mkdir(parents=True)
    follow = lambda: refresh.keep_fresh(spark, corpus, f"file:{tmp_path}/index", f"file:{tmp_path}/work", once=True)
    with progress.Progress(spark) as seen:
        ids = []
        for name, n in (("a", 3), ("b", 2)):
            (own / f"{name}.jsonl").write_text("".join(said(f"widget {k}") for k in range(n)))
            query = follow()
            query.awaitTermination()
            ids.append((str(query.id), str(query.runId)))
            assert until(lambda: seen.runs().filter((F.col("run_id") == ids[-1][1]) & (F.col("state") == "ended")).count())
        rows = {r["run_id"]: r for r in seen.runs().collect()}
        assert ids[0][0] == ids[1][0] and [(rows[r]["query_id"], rows[r]["rows"], rows[r]["batches"], rows[r]["error"]) for _, r in ids] == [(ids[0][0], 3, 1, None), (ids[0][0], 2, 1, None)]

        def fail(batch, _):
            raise ValueError("no")

        bad = spark.readStream.format("rate").load().writeStream.foreachBatch(fail).option("checkpointLocation", f"{tmp_path}/bad").queryName("bad").start()
        with pytest.raises(Exception):
            bad.awaitTermination()
        assert until(lambda: seen.runs().filter("name = 'bad' and state = 'failed' and error is not null").count())
    after = seen.runs().count()
    follow().awaitTermination()
    time.sleep(1)
    assert seen.runs().count() == after  # it listens no more


def test_no_more_runs_are_kept_than_said(spark, monkeypatch):
    monkeypatch.setattr(progress, "KEPT", 3)
    seen = progress.Progress(spark)
    assert seen.runs().count() == 0
    for k in range(5):
        seen._note(k, name=f"q{k}")
    seen._note(2, state="ended")
    assert [(r["name"], r["state"]) for r in seen.runs().collect()] == [("q3", "running"), ("q4", "running"), ("q2", "ended")]


def test_counts_grow_while_a_build_runs(spark, tmp_path):
    own, corpus, root = tmp_path / "projects" / "p", f"file:{tmp_path}/projects", f"file:{tmp_path}/index"
    own.mkdir(parents=True)
    empty = progress.index_counts(spark, corpus, root).first()
    assert (empty["total_sessions"], empty["indexed_sessions"], empty["share"]) == (0, 0, 1.0)
    for k in range(4):
        (own / f"{k}.jsonl").write_text(said(f"widget {k}") * 40)
    size = (own / "0.jsonl").stat().st_size
    build = threading.Thread(target=lambda: index.refresh(spark, corpus, root, wave_bytes=size))
    build.start()
    seen = []
    while build.is_alive():
        row = progress.index_counts(spark, corpus, root).first()
        seen.append((row["indexed_sessions"], row["building"]))
    build.join()
    done = progress.index_counts(spark, corpus, root).first()
    assert (done["total_sessions"], done["indexed_sessions"], done["share"], done["building"]) == (4, 4, 1.0, False)
    grown = [n for n, _ in seen]
    assert grown == sorted(grown) and any(0 < n < 4 for n in grown) and any(b for _, b in seen)


def test_result_briefs_round_as_doubles_do(spark):
    sizes = {0: "0 chars", 1: "1 char", 999: "999 chars", 1000: "1.0k chars", 1049: "1.0k chars", 1150: "1.1k chars", 1250: "1.3k chars", 1350: "1.4k chars", 1750: "1.8k chars", 2250: "2.3k chars", 1234567: "1234.6k chars"}
    rows = spark.createDataFrame([(n,) for n in sizes], "n int").select("n", T.tool_result_brief(F.repeat(F.lit("x"), F.col("n")), F.lit(False)).alias("b")).collect()
    assert {r["n"]: r["b"] for r in rows} == {n: f"OK · {s}" for n, s in sizes.items()}
