"""Large session files read in byte ranges, against the same files read whole."""

from __future__ import annotations

import random

import pytest

from palaver.sources import jsonl


@pytest.fixture
def ranges(spark, monkeypatch):
    """Ranges of some hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    was = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    monkeypatch.setattr(jsonl, "RANGE_BYTES", 500)
    yield
    for k, v in was.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def found(spark, root, paths=None):
    return sorted((r["session_path"], r["line_no"], r["project"], r["line"]) for r in jsonl.read_lines(spark, root, paths).collect())


def test_ranges_give_the_lines_of_whole_files(spark, tmp_path, ranges, monkeypatch):
    rng, own = random.Random(5), tmp_path / "projects" / "a b+c%20"
    own.mkdir(parents=True)
    draw = lambda n: "".join(rng.choice(["x", "é", "日本", "\r", " ", "word ", '"', "\\"]) for _ in range(n))
    long = "\n".join(draw(rng.randint(0, 90)) for _ in range(300))
    cases = {
        "ends": long + "\n", "open": long + "\nlast", "blank": "\n" * 1500, "one line": "y" * 6000, "one ended": "y" * 6000 + "\n", "crlf": long.replace("\n", "\r\n") + "\r\n",
        "marked": "﻿" + long + "\n", "marked open": "﻿" + long + "\nz", "small": "a\nb\n", "empty": "", "agent-x": long,
    }
    for name, text in cases.items():
        (own / f"{name}.jsonl").write_bytes(text.encode())
    (own / "broken.jsonl").write_bytes(long.encode() + b"\n\xff\xfe\n" + long.encode())
    root = str(tmp_path / "projects")
    got = found(spark, root)
    assert jsonl._ranged(spark, root, None).rdd.getNumPartitions() > 1
    paths = [r["session_path"] for r in jsonl.list_sessions(spark, root).collect() if "marked" in r["session_path"] or "small" in r["session_path"]]
    some = found(spark, root, paths)
    monkeypatch.setattr(jsonl, "RANGE_BYTES", 1 << 40)
    want = found(spark, root)
    assert got == want and some == found(spark, root, paths)
    by = {}
    for path, _, _, line in want:
        by.setdefault(path.rsplit("/", 1)[-1][:-6], []).append(line)
    assert {k: "\n".join(v) for k, v in by.items()} == {k: v for k, v in cases.items() if k not in ("agent-x", "empty")}  # an empty file has no line


def test_a_long_session_is_read_by_many_tasks(spark, tmp_path, ranges):
    own = tmp_path / "projects" / "p"
    own.mkdir(parents=True)
    (own / "long.jsonl").write_text("".join(f"line {k}\n" for k in range(5000)))
    for k in range(3):
        (own / f"s{k}.jsonl").write_text("a\n")
    root = str(tmp_path / "projects")
    text = spark.read.format("text").option("lineSep", "\n").load([f"{own}/long.jsonl"])
    assert text.rdd.getNumPartitions() > 20  # what the ranges are
    got = found(spark, root)
    assert [(n, line) for path, n, _, line in got if path.endswith("long.jsonl")] == [(k, f"line {k}") for k in range(5000)] + [(5000, "")]
