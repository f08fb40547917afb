"""The Merkle manifest against a tree built row by row."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from palaver.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree(hashes):
    """The root, and of each leaf the pairs (left, right) on its way up."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for k, path in enumerate(paths):
            sibling = at[k] ^ 1
            found = level[sibling] if sibling < len(level) else ""
            path.append((found, "") if sibling < at[k] else ("", found))
            at[k] >>= 1
        level = [sha("".join(level[k : k + 2])) for k in range(0, len(level), 2)]
    return level[0], paths


def tampers(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subtrees = []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        subtrees.append((own, *tree([leaf(*r) for r in own])))
    root, tops = tree([s[1] for s in subtrees])
    out = []
    for (own, subroot, paths), top in zip(subtrees, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            folded = leaf(*r[:4], r[4] + 1) if tampers(r[0]) and r[4] is not None else leaf(*r)
            for left, right in path + top:
                folded = sha(left + folded + right)
            out.append((r[0], leaf(*r), subroot, root, sha("".join(a + b for a, b in path + top)), folded, folded == root))
    return sorted(map(repr, out))


def report(df):
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.report(merkle.audit(df, {"n_chars": F.when(struck, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}))
    return sorted(repr(tuple(r)) for r in found.collect())


@pytest.mark.parametrize("span", [2, 10])
def test_nulls_ties_and_repeated_rows(spark, monkeypatch, span):
    monkeypatch.setattr(merkle, "SPAN", span)
    rows = [(k, f"t{k}", None if k % 5 == 0 else f"l{k % 3}", "s", None if k % 11 == 0 else k) for k in range(37)]
    rows += [(3, "t3", "l0", "s", 3)] * 3 + [(None, None, None, None, None)] * 2 + [(1, "é" * 70_000, "", "", -4)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as g", "2 as h", "3 as at", "4 as level", "5 as root", "6 as `a b`")
    assert report(df) == brute(rows)


def test_a_hot_group_beside_many_small_ones(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SPAN", 3)
    rng = random.Random(2)
    rows = [(k, str(rng.random()), "hot" if k % 3 else f"lone {k}", "s", k) for k in range(700)]
    assert report(spark.createDataFrame(rows, DOCS)) == brute(rows)


def test_small_tables(spark):
    one = [(5, "x", "en", "s", 1)]
    assert report(spark.createDataFrame(one, DOCS)) == brute(one)
    assert report(spark.createDataFrame([], DOCS)) == []


def test_no_node_is_sought_by_more_rows_than_a_span_has(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SPAN", 4)
    rows = spark.range(3000).select(F.lit("=x").alias("g"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("h"))
    placed = merkle.positions(rows).cache()
    held = merkle.nodes(placed, 12)
    for bottom in (0, 4, 8):
        units = (placed if bottom == 0 else held.filter(F.col("level") == bottom)).select("g", "n", "at")
        steps = merkle._steps(units, held, bottom).select("at", F.explode("path").alias("x"))
        found = steps.groupBy("x.level", F.coalesce("x.left", "x.right").alias("h")).count().filter("h is not null")
        assert found.agg(F.max("count")).first()[0] <= 16


def test_a_kept_path_proves_a_row(spark):
    rows = [(k, f"t{k}", "en", "s", k) for k in range(50)]
    df = spark.createDataFrame(rows, DOCS)
    leaves = df.select(F.col("lang").alias("g"), F.col("doc_id").alias("id"), merkle.leaf(doc_id=F.col("doc_id"), text=F.col("text")).alias("h"), "text")
    kept = merkle.manifest(leaves).withColumn("other", F.when(F.col("id") == 7, merkle.leaf(doc_id=F.col("id"), text=F.lit("forged"))).otherwise(F.col("h")))
    found = merkle.check(kept, "other", "path", "root")
    assert {r["id"] for r in found.filter("not verified").collect()} == {7}
