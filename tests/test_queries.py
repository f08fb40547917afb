"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from palaver.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    return int(v) if isinstance(v, float) and v == int(v) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, db, name):
    found = QUERIES[name](spark, SF)
    names = sorted(found.columns)
    cur = db.execute(ORACLES[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == names
    mine = sorted(repr([plain(r[c]) for c in names]) for r in found.collect())
    theirs = sorted(repr([plain(r[have.index(c)]) for c in names]) for r in cur.fetchall())
    assert mine == theirs


def test_whole_tables(spark, tmp_path):
    """Texts that hold tags, blanks and long runs: every row is taken."""
    long = "x " * 200 + "the teh thee end"
    texts = ["plain", "a <b> c", "  \n blanks \n", "x </summary> y", "the <summary>z", "of the", long]
    data = [(c, t, "user", text) for c in range(10) for t, text in enumerate(texts)]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"file://{tmp_path}/conversations.parquet")
    sf = f"file://{tmp_path}"
    assert QUERIES["jump_to_row"](spark, sf).count() == len(data)
    found = QUERIES["task_notification"](spark, sf).filter("session_path = 'conv/3.jsonl'").collect()
    assert {r["line_no"]: r["summary"] for r in found} == dict(enumerate(["plain", "a <b> c", "blanks", "x", "the <summary>z", "of the", long]))
    row = QUERIES["fuzzy_highlights"](spark, sf).filter("session_path = 'conv/3.jsonl' and line_no = 6").first()
    assert (row["joined"], row["marked"]) == (long, "the|thee")
    assert QUERIES["warm_cold_union"](spark, sf).groupBy("tier").count().count() == 2


def test_forks_keep_three_lines_of_every_session(spark, tmp_path):
    """Sessions of fewer lines are neither left out nor an error."""
    data = [(c, t, "user", "x") for c in range(1, 6) for t in range(c)]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"file://{tmp_path}/conversations.parquet")
    found = QUERIES["fork_prefix"](spark, f"file://{tmp_path}").collect()
    assert sorted((r["session_path"], r["line_no"]) for r in found) == [(f"conv/{c}.jsonl", t) for c in range(1, 6) for t in range(min(c, 3))]
