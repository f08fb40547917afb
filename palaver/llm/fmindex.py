"""Benchmark decontamination (8) with an FM-index per training shard.

Test phrases (windows of ten words of each benchmark item) are sought in an
FM-index of each shard of training text: backward search through wavelet ranks
narrows a suffix interval word by word, occurrences are located by walking to
sampled suffix positions, and the hit spans are merged per document.

A shard is what one task gathers of its documents, about SHARD_WORDS words.  What
a longer document adds is indexed in parts that overlap by a window less a word.
Its alphabet is the benchmark's vocabulary.  A word outside it can be in no
window, so it only breaks the text; runs of vocabulary words shorter than the
shortest window can hold none and are left out of the index.  Both are exact.

The phrases are sent to the tasks in blocks of about BLOCK_BYTES of item text,
one block after the other, whatever the size of the benchmark; a document's spans
from several blocks are merged.

Defined results: null and empty texts have no words and are clean; items without
words have no windows.  Items with a null item_id hit words but are not named.
Repeated rows give repeated results.  Columns other than doc_id, text and
item_id, text are not read, except those named to be carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, guarded, hot_left_join, lean, values

WINDOW = 10
SHARD_WORDS = 1 << 19
BLOCK_BYTES = 2 << 20
SAMPLE = 8
#: Bytes to lower case; what is no word byte becomes a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORD = re.compile(rb"[^ ]+")  # of folded text
BREAK = 1  # symbol between runs; 0 ends the text


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words; bytes beyond ASCII belong to words, so no decoding is needed."""
    return (text or b"").translate(FOLD).split()


def symbols_of(text: bytes | None, symbol: dict[bytes, int], step: int = 1 << 22) -> np.ndarray:
    """Symbols of the words (0: unknown); words of about ``step`` bytes are held at a time."""
    folded, at, out = (text or b"").translate(FOLD), 0, [np.zeros(0, np.int64)]
    while at < len(folded):
        end = folded.find(b" ", at + step)
        words = folded[at : end if end >= 0 else len(folded)].split()
        out.append(np.fromiter((symbol.get(w, 0) for w in words), np.int64, len(words)))
        at = end if end >= 0 else len(folded)
    return np.concatenate(out)


class Wavelet:
    """Ranks of symbols in a sequence: one bit plane a level, most significant first."""

    def __init__(self, values: np.ndarray, top: int) -> None:
        self.levels = max(1, int(top).bit_length())
        self.planes, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            self.planes.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(values) - int(self.planes[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start, end = np.zeros_like(upto), upto
        for k, (ones, zero) in enumerate(zip(self.planes, self.zeros, strict=True)):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            s1, e1 = ones[start], ones[end]
            start = np.where(bit, zero + s1, start - s1)
            end = np.where(bit, zero + e1, end - e1)
        return end - start

    def at(self, position: np.ndarray) -> np.ndarray:
        """The symbols at positions."""
        symbol = np.zeros_like(position)
        for ones, zero in zip(self.planes, self.zeros, strict=True):
            before = ones[position]
            bit = ones[position + 1] - before
            symbol = (symbol << 1) | bit
            position = np.where(bit, zero + before, position - before)
        return symbol


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by prefix doubling; only suffixes still tied are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    firsts = np.concatenate([[True], text[order][1:] != text[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(firsts, np.arange(n), 0))
    step = 1
    while True:
        starts = np.flatnonzero(firsts)
        sizes = np.diff(np.append(starts, n))
        if sizes.max() == 1:
            return order
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
        own = order[tied]
        next_rank = np.where(own + step < n, rank[np.minimum(own + step, n - 1)] + 1, 0)
        group = rank[own]
        again = np.lexsort((next_rank, group))
        order[tied] = own[again]
        g, r = group[again], next_rank[again]
        fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])])
        firsts[tied] |= fresh
        head = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[order[tied]] = head
        step *= 2


class FMIndex:
    """FM-index of a sequence of symbols over 2..top; ``text`` must end with its only 0."""

    def __init__(self, text: np.ndarray, top: int, sample: int = SAMPLE) -> None:
        order = suffix_array(text)
        self.n = len(text)
        self.wavelet = Wavelet(text[order - 1], top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.sampled = order % sample == 0
        self.slot = np.cumsum(self.sampled) - 1
        self.places = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of equally long phrases (a row each), word by word from the back."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k]
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        high = np.maximum(high, low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a sampled one."""
        rows, place = rows.copy(), np.full(len(rows), -1, np.int64)
        steps, live = 0, np.arange(len(rows))
        while len(live):
            there = self.sampled[rows[live]]
            done = live[there]
            place[done] = self.places[self.slot[rows[done]]] + steps
            live = live[~there]
            symbol = self.wavelet.at(rows[live])
            rows[live] = self.before[symbol] + self.wavelet.rank(symbol, rows[live])
            steps += 1
        return place % self.n


class Phrases:
    """Windows of benchmark items over their own vocabulary; symbols start at 2."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int = WINDOW) -> None:
        self.symbol: dict[bytes, int] = {}
        of: dict[tuple[int, ...], set[int]] = {}
        self.names = [None if name is None else str(name) for name, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [self.symbol.setdefault(w, len(self.symbol) + 2) for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                of.setdefault(tuple(ids[at : at + window]), set()).add(k)
        self.top = len(self.symbol) + 1
        self.groups = []
        for length in sorted({len(p) for p in of}):
            same = [p for p in of if len(p) == length]
            self.groups.append((length, np.array(same, np.int64), [sorted(of[p]) for p in same]))
        self.shortest = self.groups[0][0] if self.groups else 0


def _runs(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of known words that are long enough."""
    edge = np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    enough = ends - starts >= shortest
    return starts[enough], ends[enough]


def _parts(docs: list[np.ndarray], phrases: Phrases, most: int) -> Iterator[list[tuple[int, int, int]]]:
    """Runs as (document, start, end), in groups of about ``most`` words; of longer runs, overlapping parts."""
    group, size = [], 0
    longest = phrases.groups[-1][0]
    for d, ids in enumerate(docs):
        for a, b in zip(*_runs(ids, phrases.shortest), strict=True):
            for at in range(a, max(a + 1, b - longest + 1), most):
                end = min(b, at + most + longest - 1)
                if group and size + end - at > most + longest:
                    yield group
                    group, size = [], 0
                group.append((d, at, end))
                size += end - at
    if group:
        yield group


def search_shard(docs: list[np.ndarray], phrases: Phrases, most: int = SHARD_WORDS) -> list[tuple[list[tuple[int, int]], list[int]]]:
    """Per document, given as symbols (0: not in the vocabulary): merged hit spans and items."""
    marks: list[set[tuple[int, int]]] = [set() for _ in docs]
    items: list[set[int]] = [set() for _ in docs]
    for group in _parts(docs, phrases, most) if phrases.groups else ():
        text = [x for d, a, b in group for x in (docs[d][a:b], [BREAK])]
        index = FMIndex(np.concatenate([*text, [0]]).astype(np.int64), phrases.top)
        start = np.cumsum([0] + [b - a + 1 for _, a, b in group[:-1]])
        for length, rows, owners in phrases.groups:
            low, high = index.search(rows)
            for p in np.flatnonzero(high > low):
                places = index.locate(np.arange(low[p], high[p]))
                piece = np.searchsorted(start, places, side="right") - 1
                for place, k in zip(places.tolist(), piece.tolist(), strict=True):
                    d, origin, _ = group[k]
                    at = int(origin) + place - int(start[k])
                    marks[d].add((at, at + length))
                    items[d].update(owners[p])
    out = []
    for spans, own in zip(marks, items, strict=True):
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out.append(([tuple(s) for s in merged], sorted(own)))
    return out


FOUND = "n_words long, spans array<struct<start: long, stop: long>>, items array<string>"


def _search(docs: DataFrame, carry: list[str], phrases: Phrases) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = phrases  # about BLOCK_BYTES of items
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            first, size, ids, counts = 0, 0, [], []

            def flush(first: int, ids: list, counts: list) -> pa.RecordBatch:
                found = search_shard(ids, known)
                spans = pa.array([[{"start": int(a), "stop": int(b)} for a, b in s] for s, _ in found], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
                items = pa.array([[known.names[k] for k in i if known.names[k] is not None] for _, i in found], pa.list_(pa.string()))
                own = [batch.column(c).slice(first, len(ids)) for c in range(len(carry))]
                return pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), spans, items], names=[*carry, "n_words", "spans", "items"])

            for k in range(batch.num_rows):
                ids.append(symbols_of(texts[k].as_py(), known.symbol))
                counts.append(len(ids[-1]))
                size += counts[-1]
                if size >= SHARD_WORDS:
                    yield flush(first, ids, counts)
                    first, size, ids, counts = k + 1, 0, [], []
            if ids:
                yield flush(first, ids, counts)

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", " + FOUND
    own = [F.col(f"`{c}`") for c in carry]
    return docs.select(*own, F.col("text").alias("_text")).mapInArrow(lean(apply), schema)


def find(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``carry`` columns of every row, its number of words, merged hit spans (word numbers) and items found."""
    carry = carry or ["doc_id"]
    items = benchmark.select("item_id", "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = 1 + int(total) // block_bytes
    if blocks == 1:
        return _search(docs, carry, _phrases(items, window))
    # rows need a name under which the blocks' findings meet again
    rows = docs.withColumn("_row", F.sha2(F.coalesce("text", F.lit("")), 256))
    # equal texts are searched once
    texts = cut(rows.groupBy("_row").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"), F.count("*").alias("_rows")))
    parts = None
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        part = cut(_search(texts, ["_row"], _phrases(own, window)))  # before the next block is fetched
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy("_row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    joined = F.expr(
        "aggregate(spans, cast(array() as array<struct<start: bigint, stop: bigint>>), (a, s) -> "
        "case when size(a) > 0 and s.start <= element_at(a, -1).stop then "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'stop', greatest(s.stop, element_at(a, -1).stop)))) "
        "else concat(a, array(s)) end)"
    )
    merged = merged.withColumn("spans", joined)
    merged = cut(merged.join(texts.select("_row", "_rows"), "_row").select("_row", *[F.col(c).alias(f"_{c}") for c in ("n_words", "spans", "items")], "_rows"))
    found = hot_left_join(rows.select(*{f"`{c}`": 0 for c in [*carry, "_row"]}), merged, "_row", "_rows")
    return found.select(*[f"`{c}`" for c in carry], F.col("_n_words").alias("n_words"), F.col("_spans").alias("spans"), F.col("_items").alias("items"))


def _phrases(items: DataFrame, window: int) -> Phrases:
    rows = items.select("item_id", F.col("text").cast("binary").alias("text")).orderBy("item_id").collect()
    return Phrases([(r["item_id"], None if r["text"] is None else bytes(r["text"])) for r in rows], window)


def report(found: DataFrame) -> DataFrame:
    """Digest columns of ``find``'s result."""
    names = F.array_sort(F.array_distinct("items"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def strip_spans(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; a line break stands for each."""
    folded, out, last, start, k = text.translate(FOLD), [], 0, 0, 0
    for number, word in enumerate(WORD.finditer(folded)):
        if k == len(spans):
            break
        if number == spans[k][0]:
            start = word.start()
        if number == spans[k][1] - 1:
            out.append(text[last:start].rstrip())
            last, k = word.end(), k + 1
            while last < len(text) and folded[last : last + 1] == b" " and text[last : last + 1] not in b" \n":
                last += 1  # punctuation that closed the passage
    out.append(text[last:].lstrip())
    return b"\n".join(p for p in out if p).decode()


def clean(docs: DataFrame, benchmark: DataFrame, least_words: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the hit spans cut out; documents of which fewer than ``least_words`` words stay go.

    Clean documents are unchanged.  A column n_chars follows the new text.
    """
    return guarded(docs, {"doc_id", "text", "n_chars"}, lambda d: _cut_out(d, benchmark, least_words, block_bytes))


def _cut_out(docs: DataFrame, benchmark: DataFrame, least_words: int, block_bytes: int) -> DataFrame:
    names = docs.columns
    found = find(docs, benchmark, names, block_bytes=block_bytes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = values(b.column(at))
            spans = b.column(b.num_columns - 1).to_pylist()
            new = pa.array([strip_spans(t, [(s["start"], s["stop"]) for s in w]) if w else None if t is None else t.decode() for t, w in zip(texts, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == at else b.column(c) for c in range(len(names))], names=names)

    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    stays = (F.size("spans") == 0) | (F.col("n_words") - hit >= least_words)
    out = found.filter(stays).select(*names, "spans").mapInArrow(lean(apply), docs.schema)
    if "n_chars" in names:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out.select(*names)
