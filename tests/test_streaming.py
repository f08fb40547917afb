"""Appends as a stream, and keyed merges of batches that come late or twice."""

from __future__ import annotations

import json
import os
import random

from palaver.operators import index, search
from palaver.streaming import refresh, source


def run(spark, tmp_path, range_bytes=source.RANGE_BYTES):
    """All there is, written by a query that starts from its checkpoint each time."""
    stream = source.appended(spark, f"file:{tmp_path}/projects", f"file://{tmp_path}/snapshots", range_bytes)
    query = (
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.schema(source.SCHEMA).parquet(f"{tmp_path}/out").collect()
    return sorted((os.path.basename(r["session_path"]), r["version"], r["at"], r["line"]) for r in rows)


def test_appends_arrive_once(spark, tmp_path):
    own = tmp_path / "projects" / "p"
    (own / "subagents").mkdir(parents=True)
    a, b = own / "a.jsonl", own / "b.jsonl"
    a.write_text("one\ntwo\nhal")
    (own / "agent-z.jsonl").write_text("no\n")
    (own / "subagents" / "x.jsonl").write_text("no\n")
    first = run(spark, tmp_path)
    assert first == [("a.jsonl", 0, 0, "one"), ("a.jsonl", 0, 4, "two")]
    assert run(spark, tmp_path) == first  # nothing new, nothing again
    with a.open("a") as f:
        f.write("f\nthrée\n")
    b.write_text("\nx\n")
    second = run(spark, tmp_path)
    assert second == sorted([*first, ("a.jsonl", 0, 8, "half"), ("a.jsonl", 0, 13, "thrée"), ("b.jsonl", 0, 0, ""), ("b.jsonl", 0, 1, "x")])
    a.write_text("new\n")  # replaced by a shorter one
    b.write_text("other, and longer\n")  # and by a longer one
    third = run(spark, tmp_path)
    assert third == sorted([*second, ("a.jsonl", 1, 0, "new"), ("b.jsonl", 1, 0, "other, and longer")])
    a.unlink()
    assert run(spark, tmp_path) == third
    a.write_text("back\n")
    assert [r for r in run(spark, tmp_path) if r not in third] == [("a.jsonl", 2, 0, "back")]


def test_long_appends_are_read_in_ranges(spark, tmp_path):
    own = tmp_path / "projects" / "p"
    own.mkdir(parents=True)
    lines = [f"{'x' * (k % 90)}é{k}" for k in range(400)]
    (own / "a.jsonl").write_text("".join(f"{line}\n" for line in lines))
    got = run(spark, tmp_path, 100)
    at, want = 0, []
    for line in lines:
        want.append(("a.jsonl", 0, at, line))
        at += len(line.encode()) + 1
    assert got == want


def test_small_files_share_tasks(spark, tmp_path, monkeypatch):
    """Many small files are few tasks, each new one is opened once by the driver, and every line comes once, in batches."""
    own = tmp_path / "projects" / "p"
    own.mkdir(parents=True)
    for k in range(300):
        (own / f"{k:03d}.jsonl").write_text("".join(f"{k} {n}\n" for n in range(k % 4)) + "rest" * (k % 2))
    (own / "long.jsonl").write_text("".join(f"long {n} {'x' * 400}\n" for n in range(4000)))
    stream = source.SessionStream({"path": f"file:{tmp_path}/projects", "snapshots": f"file://{tmp_path}/looked", "rangebytes": str(1 << 20)})
    looked, real = [], stream._look
    monkeypatch.setattr(stream, "_look", lambda fs, i, was: looked.append(i.path) or real(fs, i, was))
    parts = stream.partitions(stream.initialOffset(), stream.latestOffset())
    assert len(looked) == len(set(looked)) == 301
    assert len(parts) < 300 // 10
    ranges = [r for p in parts for r in p.parts]
    assert len(ranges) == len(set(ranges)) and {r[0] for r in ranges} == {f"{own}/{k:03d}.jsonl" for k in range(300) if k % 4} | {f"{own}/long.jsonl"}
    assert stream.latestOffset() == {"snapshot": 1} and len(looked) == 301
    # a snapshot as it was written before, in one line, is taken on
    kept = tmp_path / "looked" / f"{1:012d}.json"
    kept.write_text(json.dumps({path: entry for path, *entry in map(json.loads, kept.read_text().splitlines())}))
    assert stream.latestOffset() == {"snapshot": 1} and len(looked) == 301
    monkeypatch.setattr(source, "BATCH_BYTES", 1000)
    at_once = [b.num_rows for p in parts for b in stream.read(p)]
    assert len(at_once) > 20 and sum(at_once) == 75 * (1 + 2 + 3) + 4000
    got = run(spark, tmp_path, 1 << 20)
    assert len(got) == len(set(got)) == sum(at_once)
    assert [r[3] for r in got if r[0] == "007.jsonl"] == ["7 0", "7 1", "7 2"]
    assert len(list((tmp_path / "out").glob("*.parquet"))) < 300 // 10


def said(text):
    return json.dumps({"type": "user", "message": {"content": text}}) + "\n"


def test_the_index_follows_the_stream(spark, tmp_path, monkeypatch):
    own, corpus, root = tmp_path / "projects" / "p", f"file:{tmp_path}/projects", f"file:{tmp_path}/index"
    own.mkdir(parents=True)
    asked, real = [], index.refresh
    monkeypatch.setattr(index, "refresh", lambda spark, corpus, root, paths=None, *more: asked.append(paths) or real(spark, corpus, root, paths, *more))

    def follow():
        refresh.keep_fresh(spark, corpus, root, f"file:{tmp_path}/work", once=True).awaitTermination()
        return {w: search.matches(index.open_index(spark, root), w).count() for w in ("widget", "gadget")}

    (own / "a.jsonl").write_text(said("a widget"))
    (own / "b.jsonl").write_text(said("no gadget"))
    assert follow() == {"widget": 1, "gadget": 1}
    with (own / "a.jsonl").open("a") as f:
        f.write(said("the gadget"))
    assert follow() == {"widget": 1, "gadget": 2}
    assert [p.rsplit("/", 1)[-1] for p in asked[-1]] == ["a.jsonl"]  # the other one is not looked at
    n = len(asked)
    assert follow() == {"widget": 1, "gadget": 2} and len(asked) == n
    (own / "b.jsonl").unlink()
    assert follow() == {"widget": 1, "gadget": 1}


SCHEMA = "k string, at long, v string"


def test_merges_do_not_depend_on_the_sequence(spark, tmp_path):
    """Batches in any sequence, late ones and ones that come again give the same table; only touched buckets are rewritten."""
    rng = random.Random(1)
    rows = [(f"k{rng.randint(0, 30)}", rng.randint(0, 5), rng.choice("abc")) for _ in range(200)]
    want = {}
    for k, at, v in rows:
        want[k] = max(want.get(k, (-1, "")), (at, v))
    batches = [rows[k : k + 50] for k in range(0, 200, 50)]
    for name, turns in (("a", [0, 1, 2, 3]), ("b", [3, 1, 0, 0, 2, 3, 1])):
        table = refresh.KeyedTable(spark, f"file:{tmp_path}/{name}", SCHEMA, "k", "at", 8)
        for t in turns:
            table.merge(spark.createDataFrame(batches[t], SCHEMA))
        assert {r["k"]: (r["at"], r["v"]) for r in table.rows().collect()} == want
    before = table._state()[1]["folders"]
    touched = table.merge(spark.createDataFrame([("k1", 9, "z"), (None, 9, "z")], SCHEMA))
    after = table._state()[1]["folders"]
    assert len(touched) == 1 and [b for b in after if after[b] != before.get(b)] == [str(touched[0])]
    assert table.merge(spark.createDataFrame([], SCHEMA)) == []
    want["k1"] = (9, "z")
    assert {r["k"]: (r["at"], r["v"]) for r in table.rows().collect()} == want
    live = {*after.values(), *table._state()[1]["retired"]}
    assert {p.name for p in (tmp_path / "b").iterdir() if p.name.startswith("merge-")} == live


def test_a_stream_is_merged_from_its_checkpoint(spark, tmp_path):
    table = refresh.KeyedTable(spark, f"file:{tmp_path}/table", SCHEMA, "k", "at", 4)

    def follow(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        refresh.merge_stream(stream, table, f"{tmp_path}/checkpoint", once=True).awaitTermination()
        return sorted(map(tuple, table.rows().collect()))

    assert follow([("a", 1, "x"), ("b", 5, "y")]) == [("a", 1, "x"), ("b", 5, "y")]
    assert follow([("a", 2, "z"), ("b", 4, "late")]) == [("a", 2, "z"), ("b", 5, "y")]
