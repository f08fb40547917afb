"""Language identification by prediction by partial matching (13).

For each language a tree of byte contexts of up to ORDER bytes holds how often each
byte followed.  A byte is coded in the longest context known; if it was never seen
there, an escape is coded (method C: as likely as the context has distinct
successors) and the next shorter context is tried, down to all bytes alike.  The
statistics are frozen after learning, so the code length of a text is a sum over its
bytes, and the language with the shortest code wins.

Learning counts all n-grams of all labelled texts: tasks count units of some
megabytes, Spark adds up.  Of each language and length the most frequent are kept,
up to NGRAMS // (languages x lengths); the cut is a count, found from a histogram, so
nothing is sorted in one place.  The trees then have a bounded size, whatever the
corpus, and are broadcast.

Tasks look n-grams up in one hash table a length, for all languages at once: a row has
the code length of its last byte in each, escapes included.  Lengths are whole
multiples of 1/UNIT bits, so sums do not depend on how texts are dealt out.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is
every text if nothing was learned.  Ties go to the language that sorts first.  Score:
the share of 2**-length that the language has among all.  Texts of any length are
coded whole, repeated rows each.  Null texts and null languages teach nothing.  An
empty table gives an empty result.  Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stored, values

ORDER = 4
NGRAMS = 1 << 21
UNIT = 1 << 16
#: Bytes counted or coded at once.
COUNTED, CODED = 4 << 20, 1 << 18
UNKNOWN = "und"


def packed(data: np.ndarray, order: int) -> np.ndarray:
    """Of each byte, it and the ``order`` before it as one number; those before the first are 0."""
    keys = data.astype(np.int64)
    for k in range(1, order + 1):
        keys[k:] |= data[:-k].astype(np.int64) << (8 * k)
    return keys


def places(sizes: np.ndarray) -> np.ndarray:
    """The places 0, 1, ... of bytes in texts of ``sizes`` laid end to end."""
    starts = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(starts, sizes)


def ngrams(texts: list[bytes], order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, n-grams, counts) for all lengths up to ``order`` + 1."""
    place = places(np.array(list(map(len, texts)), np.int64))
    keys = packed(np.frombuffer(b"".join(texts), np.uint8), order)
    held, n = np.unique(keys[place >= order], return_counts=True)
    for length in range(order + 1, 0, -1):
        yield length, held, n
        # shorter ones end the longer ones, or texts begin with them
        begin = keys[place == length - 2] if length > 1 else keys[:0]
        mask = (1 << (8 * (length - 1))) - 1
        found, at = np.unique(np.concatenate([held, begin]) & mask, return_inverse=True)
        n = np.bincount(at, np.concatenate([n, np.ones(len(begin), np.int64)]), len(found)).astype(np.int64)
        held = found


class Table:
    """Numbers with a row each, found by hash."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rows = np.append(keys, -1), rows
        self.slots = np.full(1 << bits, len(keys), np.int32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.slots[at] == len(keys)
            self.slots[at[free]] = left[free]
            placed = self.slots[at] == left
            left, at = left[~placed], (at[~placed] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if it has none."""
        out, at = np.full(len(keys), -1, np.int64), self._home(keys)
        left = np.arange(len(keys))
        none = len(self.keys) - 1
        while len(left):
            seen = self.slots[at]
            same = self.keys[seen] == keys[left]
            out[left[same]] = seen[same]
            more = ~same & (seen != none)
            left, at = left[more], (at[more] + 1) & self.mask
        return out


class Model:
    """Frozen context trees of all languages."""

    def __init__(self, langs: list[str], order: int) -> None:
        self.langs, self.order = langs, order
        #: By n-gram length: code lengths of the last byte, and escapes from contexts one shorter.
        self.costs: dict[int, Table] = {}
        self.escapes: dict[int, Table] = {}

    def add(self, length: int, keys: np.ndarray, counts: np.ndarray) -> None:
        """All n-grams of ``length``, sorted, with counts by language; the shorter lengths must be there."""
        before, start = np.unique(keys >> 8, return_index=True)
        total, distinct = (np.add.reduceat(x, start, axis=0) if len(start) else x for x in (counts, (counts > 0).astype(np.int64)))
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2((total + distinct) / distinct), 0)
            of = np.repeat(np.arange(len(before)), np.diff(np.append(start, len(keys))))
            own = np.log2((total + distinct)[of] / counts)
        self.escapes[length] = Table(before, np.rint(escape * UNIT).astype(np.int32))
        shorter = self.price(keys & ((1 << (8 * (length - 1))) - 1), length - 1)
        # escapes are added as the rounded numbers that a text not found here would pay
        known = np.rint(np.where(counts > 0, own, 0) * UNIT).astype(np.int32)
        self.costs[length] = Table(keys, np.where(counts > 0, known, self.escapes[length].rows[of] + shorter).astype(np.int32))

    def price(self, keys: np.ndarray, longest: int | np.ndarray) -> np.ndarray:
        """Code lengths of the last bytes by language, ``longest`` being the n-gram lengths to begin with."""
        out = np.zeros((len(keys), len(self.langs)), np.int32)
        longest = np.broadcast_to(longest, len(keys))
        left = np.arange(len(keys))
        for length in range(int(longest.max(initial=0)), 0, -1):
            here = longest[left] >= length
            waits, left = left[~here], left[here]
            own = keys[left] & ((1 << (8 * length)) - 1)
            row = self.costs[length].find(own)
            hit = row >= 0
            out[left[hit]] += self.costs[length].rows[row[hit]]
            left, own = left[~hit], own[~hit]
            gone = self.escapes[length].find(own >> 8)
            out[left[gone >= 0]] += self.escapes[length].rows[gone[gone >= 0]]
            left = np.concatenate([left, waits])
        out[left] += 8 * UNIT
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """The code lengths of texts by language, in 1/UNIT bits."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        few, size = [], 0
        for k, text in enumerate(texts):
            if len(text) > CODED:
                for a in range(0, len(text), CODED):
                    data = np.frombuffer(text, np.uint8)[max(0, a - self.order) : a + CODED]
                    keys, skip = packed(data, self.order), min(a, self.order)
                    place = np.arange(a, a + len(keys) - skip)
                    out[k] += self.price(keys[skip:], np.minimum(place, self.order) + 1).sum(axis=0, dtype=np.int64)
                continue
            if text:
                few.append(k)
                size += len(text)
            if size > CODED:
                self._few(texts, few, out)
                few, size = [], 0
        if few:
            self._few(texts, few, out)
        return out

    def _few(self, texts: list[bytes], few: list[int], out: np.ndarray) -> None:
        sizes = np.array([len(texts[k]) for k in few], np.int64)
        keys = packed(np.frombuffer(b"".join([texts[k] for k in few]), np.uint8), self.order)
        found = self.price(keys, np.minimum(places(sizes), self.order) + 1)
        out[few] = np.add.reduceat(found, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64)

    def judge(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        said = [t is not None and next(filter(str.isalpha, t.decode()), None) is not None for t in texts]
        if not self.langs:
            said = [False] * len(texts)
        bits = self.lengths([t if s else b"" for t, s in zip(texts, said, strict=True)]) / UNIT
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best, said, strict=True)], np.where(said, share, 0.0)


def _counted(order: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            for length, keys, n in ngrams(held.pop(lang), order):
                for a in range(0, len(keys), 1 << 16):
                    z = min(len(keys), a + (1 << 16))
                    cells = [pa.array([lang] * (z - a)), pa.array(np.full(z - a, length, np.int32)), pa.array(keys[a:z]), pa.array(n[a:z])]
                    yield pa.RecordBatch.from_arrays(cells, ["lang", "length", "ngram", "n"])
            size.pop(lang)

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), values(batch["text"]), strict=True):
                # the parts of a very long text are taken for texts; their first contexts are shorter
                for a in range(0, len(text), COUNTED):
                    held.setdefault(lang, []).append(text[a : a + COUNTED])
                    size[lang] = size.get(lang, 0) + len(held[lang][-1])
                    if size[lang] >= COUNTED:
                        yield from out(lang)
            while sum(size.values()) > 2 * COUNTED:
                yield from out(max(size, key=size.get))
        for lang in list(held):
            yield from out(lang)

    return lean(apply)


def learn(docs: DataFrame, order: int = ORDER, most: int = NGRAMS) -> Model:
    """Context trees from all rows (text, lang) of ``docs``."""
    own = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    parts = own.mapInArrow(_counted(order), "lang string, length int, ngram long, n long")
    counts = stored(parts.groupBy("lang", "length", "ngram").agg(F.sum("n").alias("n")), "ppm-counts")
    size = F.floor(F.log2("n") * 8).cast("int")
    seen = counts.groupBy("lang", "length", size.alias("size")).agg(F.count("*").alias("n")).collect()  # some hundred a language and length
    langs = sorted({r["lang"] for r in seen}, key=str.encode)
    if not langs:
        return Model([], order)
    room = most // (len(langs) * (order + 1))
    sizes: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for r in seen:
        sizes.setdefault((r["lang"], r["length"]), []).append((r["size"], r["n"]))
    cuts = []
    for of, rows in sizes.items():
        cut, upto = 0, 0
        for at, n in sorted(rows, reverse=True):
            upto += n
            if upto > room:
                cut = at + 1
                break
        cuts.append((*of, cut))
    least = F.broadcast(docs.sparkSession.createDataFrame(cuts, "lang string, length int, cut int"))
    found = counts.join(least, ["lang", "length"]).filter(size >= F.col("cut")).toArrow()  # at most ``most`` rows
    return build(langs, order, *(found[c].to_numpy() for c in ("lang", "length", "ngram", "n")))


def build(langs: list[str], order: int, lang: np.ndarray, length: np.ndarray, ngram: np.ndarray, n: np.ndarray) -> Model:
    """A model of counted n-grams."""
    model = Model(langs, order)
    number = np.array([langs.index(x) for x in lang], np.int64) if len(lang) else np.zeros(0, np.int64)
    for size in range(1, order + 2):
        own = length == size
        keys, at = np.unique(ngram[own], return_inverse=True)
        counts = np.zeros((len(keys), len(langs)), np.int64)
        counts[at, number[own]] = n[own]
        model.add(size, keys, counts)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only ``text`` is looked at."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by NGRAMS

    def apply(df: DataFrame) -> DataFrame:
        shape = df.schema
        wide = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape)

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs, scores = [], []
                for a in range(0, batch.num_rows, 256):
                    found, score = held.value.judge(list(values(batch["text"].slice(a, 256))))
                    langs += found
                    scores.append(score)
                cells = [*batch.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())]
                yield pa.RecordBatch.from_arrays(cells, [*batch.schema.names, "lang_pred", "score"])

        return df.mapInArrow(lean(judged), f"{wide}, lang_pred string, score double")

    names = [(c, c if c == "text" else f"_own_{k}") for k, c in enumerate(docs.columns)]
    out = apply(docs.select(*[F.col(f"`{c}`").alias(own) for c, own in names]))
    return out.select(*[F.col(own).alias(c) for c, own in names], "lang_pred", "score")
