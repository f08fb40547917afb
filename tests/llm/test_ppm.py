"""Language identification against context trees walked byte by byte."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.llm import ppm, queries

DOCS = "text string, lang string"


def trees(rows, order):
    """Successors of every context, by language."""
    out = defaultdict(lambda: defaultdict(Counter))
    for text, lang in rows:
        data = text.encode()
        for k, byte in enumerate(data):
            for n in range(min(k, order) + 1):
                out[lang][data[k - n : k]][byte] += 1
    return out


def length(tree, data, order):
    """Code length in 1/UNIT bits, each step rounded as it is paid."""
    total = 0
    for k, byte in enumerate(data):
        for n in range(min(k, order), -1, -1):
            seen = tree[data[k - n : k]] if data[k - n : k] in tree else None
            if not seen:
                continue
            whole, distinct = sum(seen.values()), len(seen)
            if byte in seen:
                total += round(math.log2((whole + distinct) / seen[byte]) * ppm.UNIT)
                break
            total += round(math.log2((whole + distinct) / distinct) * ppm.UNIT)
        else:
            total += 8 * ppm.UNIT
    return total


@pytest.mark.parametrize("order", [0, 2, 4])
def test_code_lengths_are_exact(spark, order):
    rng = random.Random(order)
    draw = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 200)))
    rows = [(draw("abcde "), "x") for _ in range(20)] + [(draw("cdefé "), "y") for _ in range(30)] + [("ab" * 500, "z")]
    model = ppm.learn(spark.createDataFrame(rows, DOCS), order)
    held = trees(rows, order)
    assert model.langs == ["x", "y", "z"]
    texts = [draw("abcdefgé z").encode() for _ in range(50)] + [b"a", "é".encode(), b"\xf0\x9f\x99\x82"]
    assert model.lengths(texts).tolist() == [[length(held[g], t, order) for g in model.langs] for t in texts]


def test_long_texts_are_coded_whole(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 102, n, np.uint8)) for n in (1, 2, 3, 700, 64, 1000, 65)]
    counts = list(ppm.ngrams([b"abcabcabcdaab"], 2))
    number = [np.concatenate([np.full(len(k), n) for n, k, _ in counts]), *(np.concatenate([x[j] for x in counts]) for j in (1, 2))]
    model = ppm.build(["x"], 2, np.array(["x"] * len(number[0]), object), *number)
    once = model.lengths(texts)
    monkeypatch.setattr(ppm, "CODED", 64)
    assert (model.lengths(texts) == once).all() and (once > 0).all()


def test_bounded_trees_keep_the_most_frequent(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("abcdefgh") for _ in range(2000)) + "qqqqq" * 400, "x"), ("zzzz" * 100, "y")]
    model = ppm.learn(spark.createDataFrame(rows, DOCS), 3, 800)
    sizes = {n: len(t.rows) for n, t in model.costs.items()}
    assert all(0 < n <= 200 for n in sizes.values()) and model.costs[4].find(ppm.packed(np.frombuffer(b"qqqq", np.uint8), 3)[-1:])[0] >= 0


def test_defined_cases(spark):
    rows = [(k, "the cat and the hat", "en") for k in range(5)] + [(k, "der hund und die katze", "de") for k in range(5)] + [(7, None, "en"), (8, "etwas", None)]
    known = spark.createDataFrame(rows, "k int, text string, lang string")
    model = ppm.learn(known)
    texts = [(1, None), (2, ""), (None, "12 ½ !! "), (4, "the hat"), (4, "the hat"), (5, "und der " * 100_000), (6, "日")]
    df = spark.createDataFrame(texts, "k int, text string").selectExpr("*", "'fr' as lang", "1 as score0", "2 as `a b`")
    out = [(r["k"], r["lang_pred"], r["score"]) for r in ppm.predict(df, model).collect()]
    assert [x[:2] for x in out] == [(1, "und"), (2, "und"), (None, "und"), (4, "en"), (4, "en"), (5, "de"), (6, "de")]
    assert all(x[2] == 0 for x in out[:3]) and all(0 < x[2] <= 1 for x in out[3:])
    blank = ppm.learn(known.filter("false"))
    assert {(r["lang_pred"], r["score"]) for r in ppm.predict(df, blank).collect()} == {("und", 0.0)}
    assert ppm.predict(df.filter("false"), model).count() == 0


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op13_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_nothing_is_learned_from_held_out_documents(spark):
    """Held-out labels may say anything."""
    held_out = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lied = docs.withColumn("lang", F.expr(f"case when {held_out} then 'lie' else lang end")).withColumn("source", F.lit("lie"))
    a, b = (ppm.learn(d.filter(f"not ({held_out})")) for d in (docs, lied))
    assert a.langs == b.langs and all((a.costs[n].rows == b.costs[n].rows).all() for n in a.costs)
