"""Alignment of two tokenizers against loops over the tokens of whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from palaver.llm import align

FILES = tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))
DOCS = "doc_id long, text string"


def intervals(tokens):
    at, out = 0, []
    for number, data in tokens:
        out.append((number, at, at + len(data)))
        at += len(data)
    return out


def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    whole, pieces = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    whole.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char, rest = {chr(b): b for b in plain}, [b for b in range(256) if b not in plain]
    char |= {chr(256 + k): b for k, b in enumerate(rest)}

    def both(text):
        found = whole.encode(" " + text, add_special_tokens=False)
        a = [(k, bytes(char[c] for c in t)) for k, t in zip(found.ids, found.tokens, strict=True)]
        b = [(k, bytes([int(pieces.id_to_piece(k)[3:5], 16)]) if pieces.is_byte(k) else pieces.id_to_piece(k).replace("▁", " ").encode()) for k in pieces.encode(text)]
        same = b"".join(x for _, x in a) == (" " + text).encode() == b"".join(x for _, x in b)
        return (intervals(a), intervals(b)) if same else None

    return both


def brute(rows):
    both, docs, total = encoders(), [], Counter()
    for doc_id, text in rows:
        found = both(text) if text else None
        if not found:
            docs.append((doc_id, None))
            continue
        a, b = found
        links, j = [], 0
        for x, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((x, b[k][0]))
                k += 1
        ends = {x[2] for x in a} & {x[2] for x in b}
        sides = []
        for side in (a, b):
            out = [[]]
            for x, _, e in side:
                out[-1].append(str(x))
                if e in ends:
                    out.append([])
            sides.append([",".join(x) for x in out[:-1]])
        docs.append((doc_id, (len(a), len(b), len(sides[0]), links, hashlib.sha256(";".join(map("|".join, zip(*sides, strict=True))).encode()).hexdigest())))
        total.update(links)
    best = Counter()
    for (_, b), n in total.items():
        best[b] = max(best[b], n)
    rows = [(d, 0, 0, 0, 0, 0, 0, "") if x is None else (d, *x[:3], len(x[3]), sum(total[v] == best[v[1]] for v in x[3]), sum(total[v] for v in x[3]), x[4]) for d, x in docs]
    return sorted(map(repr, rows))


def found(df):
    return sorted(repr(tuple(r)) for r in align.align(df, *FILES).collect())


@pytest.mark.parametrize("unit", [3_000, 6 << 20])
def test_texts_of_all_kinds(spark, monkeypatch, unit):
    """White space of all kinds, bytes, letters B changes, control strings, repeated, null and long texts; many units and few."""
    monkeypatch.setattr(align, "UNIT", unit)
    rng = random.Random(5)
    bits = ["a", "the ", "x", " ", "  ", "\n", " \n", "é", "ﬁ", "中文", "<|endoftext|>", "</s>", "\xa0", "\x85", "\x1c", "'s", "don't ", "123 ", "!!! ", "\t", "🙂", "　", "word. ", "﻿", "\x00", "é ", "<0x41>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    rows = list(enumerate(texts)) + [(k, f"▁{k} the") for k in range(3)] + [(None, None), (3, ""), (3, "the the"), (3, "the the")]
    rows += [(9, "the cat sat on the mat. " * 5_000), (10, "x" * 50_000)]
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows += [tuple(r) for r in sample.collect()]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as kind", "2 as unit", "3 as a", "4 as n_a", "5 as `a b`").repartition(3)
    assert found(df) == brute(rows)


def test_empty_tables_and_tables_without_tokens(spark):
    assert found(spark.createDataFrame([], DOCS)) == []
    assert found(spark.createDataFrame([(1, None), (1, "")], DOCS)) == [repr((1, 0, 0, 0, 0, 0, 0, ""))] * 2


def test_parts_are_tokenised_as_in_the_whole_text():
    both, own = encoders(), align.Tokens(*FILES)
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice(["ab", " ", "  ", "x.", "Don't", "\n", "7", "é", "—", " t", "."]) for _ in range(30))
        whole = both(text)
        if whole is None or not text:
            continue
        _, a, b = own.encode_all(own.parts(text))
        assert ([x for few in a for x in few], [x for few in b for x in few]) == ([x[0] for x in whole[0]], [x[0] for x in whole[1]]), repr(text)
