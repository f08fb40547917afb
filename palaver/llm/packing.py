"""Vector bin packing of tokenised examples (6).

Every example has a demand on three resources of a sequence: tokens, segments
and loss-bearing tokens.  Which tokens bear loss is said by spans of the text
(those of chat formatting, say); without spans all ids but the closing one do.
Full sequences are cut off long examples first.  What remains is packed by the
dot-product heuristic: of all remainders that fit, the open sequence takes the one
whose demand has the largest dot product with what is left of the three limits
(each as a share of its limit).  When none fits whole, one is cut to fill the
sequence to its end, or, when the segment or loss limit closes it early, to the
next power of two below, where no padding is needed.  What is left of a pool is
laid into sequences of powers of two.

For plain documents nearly every token bears loss, so with equal limits the loss
limit coincides with the token limit; it binds where prompts are masked.

Packing goes by pools of at most POOL examples and about POOL_IDS ids inside each
task, so memory is bounded and nothing is shuffled; a task run again gives the
same sequences.

Defined results: a null or empty text is its closing id alone.  Repeated rows
are packed each.  A null doc_id is kept, and ids keep their type.  An empty table
gives no pieces.  Texts of any length are encoded whole.  Null spans bear no loss.
Other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import lean, values

MAX_TOKENS = 1024
MAX_SEGMENTS = 64
MAX_LOSS = 1024
POOL = 2048
POOL_IDS = 1 << 22
CLOSING = 0
PIECES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")


def below(n: int) -> int:
    """The largest power of two up to n."""
    return 1 << (n.bit_length() - 1)


class Encoder:
    """Ids of a text by the ``tokenizers`` file; by its twin of BPE ranks, which is
    several times faster, where both are sure to agree.

    They agree on texts without special tokens and without two white-space
    characters in a row, where the split pattern needs no look-ahead.
    """

    def __init__(self, tokenizer: str, ranks: str | None = None) -> None:
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer)
        self.quick, self.sizes = None, np.zeros(0, np.int64)
        if ranks:
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            pattern = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
            self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
            self.sizes = np.zeros(max(table.values()) + 1, np.int64)
            for token, number in table.items():
                self.sizes[number] = len(token)
        self.odd = re.compile(r"\s{2}|<\||[\x1c-\x1f\x85\ufeff]").search

    def ids(self, text: str) -> np.ndarray:
        if self.quick and not self.odd(text):
            return np.array(self.quick(text), np.uint32)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def starts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and of each the code point it begins in."""
        if self.quick and not self.odd(text):
            ids = np.array(self.quick(text), np.uint32)
            at = np.cumsum(np.append(0, self.sizes[ids]))[:-1]
            first = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
            return ids, np.cumsum(first)[at] - 1 if len(ids) else at
        found = self.whole.encode(text, add_special_tokens=False)
        return np.array(found.ids, np.uint32), np.array([a for a, _ in found.offsets], np.int64)


@lru_cache(maxsize=1)
def encoder(tokenizer: str, ranks: str | None = None) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(tokenizer, ranks)


def bearing(starts: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which ids begin within spans (start, length)."""
    edge = np.zeros(int(max([starts.max(initial=0), *(a + n for a, n in spans)])) + 2, np.int64)
    for a, n in spans:
        edge[a] += 1
        edge[a + n] -= 1
    return np.cumsum(edge)[starts] > 0


class Packer:
    """Sequences of pieces (example, start, length) under the three limits."""

    def __init__(self, tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS) -> None:
        self.limits = (tokens, segments, loss)
        self.sequences: list[list[tuple[int, int, int]]] = []

    def pack(self, examples: list[np.ndarray]) -> None:
        """Examples as masks: which of their tokens bear loss."""
        most, _, most_loss = self.limits
        self.upto = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in examples]
        number, start = [], []
        for k, upto in enumerate(self.upto):
            at, n = 0, len(upto) - 1
            while n - at >= most and upto[at + most] - upto[at] <= most_loss:
                self.sequences.append([(k, at, most)])
                at += most
            if at < n:
                number.append(k)
                start.append(at)
        self.number, self.start = np.array(number, np.int64), np.array(start, np.int64)
        self.tokens = np.array([len(self.upto[k]) - 1 for k in number], np.int64) - self.start
        self.loss = np.array([self.upto[k][-1] - self.upto[k][at] for k, at in zip(number, start, strict=True)], np.int64)
        while len(self.number):
            self._fill()
            live = self.tokens > 0
            if 2 * live.sum() < len(live) or not live.any():
                self.number, self.start, self.tokens, self.loss = (x[live] for x in (self.number, self.start, self.tokens, self.loss))

    def choose(self, left: int, spare: int) -> int:
        """Of all remainders that fit, that of the largest dot product; -1 if there is none."""
        most, _, most_loss = self.limits
        score = self.tokens * (left / most**2) + self.loss * (spare / most_loss**2)
        score[(self.tokens > left) | (self.loss > spare) | (self.tokens == 0)] = -1
        best = int(score.argmax())
        return best if score[best] >= 0 else -1

    def _fill(self) -> None:
        most, segments, most_loss = self.limits
        used, loss, own = 0, 0, []
        while used < most and len(own) < segments and self.tokens.any():
            left, spare, last = most - used, most_loss - loss, len(own) + 1 == segments
            best = self.choose(left, spare)
            if best < 0 or last and self.tokens[best] < left:
                best, size = self._cut(left, spare)
                if last and used + size < most:
                    size = min(size, below(used + size) - used)
                if size <= 0:
                    break
            else:
                size = int(self.tokens[best])
            k, at = int(self.number[best]), int(self.start[best])
            bearing = int(self.upto[k][at + size] - self.upto[k][at])
            own.append((k, at, size))
            used, loss = used + size, loss + bearing
            self.start[best] += size
            self.tokens[best] -= size
            self.loss[best] -= bearing
        if used and used & (used - 1) and used < most:
            self._split(own)
        elif own:
            self.sequences.append(own)

    def _cut(self, left: int, spare: int) -> tuple[int, int]:
        """The remainder of which most can go into what is left, and how much."""
        best, size = -1, 0
        for row in np.argsort(-self.tokens, kind="stable")[:1] if spare >= left else np.flatnonzero(self.tokens):
            upto, at = self.upto[self.number[row]], self.start[row]
            n = min(left, int(self.tokens[row]), int(np.searchsorted(upto, upto[at] + spare, side="right")) - 1 - int(at))
            if n > size:
                best, size = int(row), n
        return best, size

    def _split(self, own: list[tuple[int, int, int]]) -> None:
        """Lay pieces into sequences of powers of two, the largest first."""
        while total := sum(n for _, _, n in own):
            room, taken = below(total), []
            while room:
                number, start, n = own.pop(0)
                if n > room:
                    own.insert(0, (number, start + room, n - room))
                    n = room
                taken.append((number, start, n))
                room -= n
            self.sequences.append(taken)


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS, spans: str | None = None) -> DataFrame:
    """A row per piece of the rows of ``docs`` (doc_id, text).

    ``spans`` names a column of arrays of (start, length) in code points: the parts of the text that
    bear loss.  Without it all ids but the closing one do.
    """
    kind = docs.schema["doc_id"].dataType

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        sequence = TaskContext.get().partitionId() << 40
        names: list = []
        ids: list[np.ndarray] = []
        masks: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            packer = Packer(tokens, segments, loss)
            packer.pack(masks)
            owners, rows = [], [[] for _ in PIECES]
            for own in packer.sequences:
                offset = 0
                for k, start, n in own:
                    part = ids[k][start : start + n]
                    owners.append(k)
                    piece = (start, n, zlib.crc32(part.tobytes()), len(ids[k]), sequence, offset, int(packer.upto[k][start + n] - packer.upto[k][start]))
                    for column, value in zip(rows, piece, strict=True):
                        column.append(value)
                    offset += n
                sequence += 1
            first = pa.concat_arrays(names).take(pa.array(owners, pa.int64()))
            out = pa.RecordBatch.from_arrays([first, *(pa.array(c, pa.int64()) for c in rows)], names=["doc_id", *PIECES])
            names.clear(), ids.clear(), masks.clear()
            return out

        size = 0
        for batch in batches:
            said = batch.column(2).to_pylist() if spans else None
            for k, raw in enumerate(values(batch.column(1))):
                text = (raw or b"").decode()
                if spans:
                    own, starts = encode.starts(text)
                    mask = bearing(starts, [(s["start"], s["length"]) for s in said[k] or ()])
                else:
                    own = encode.ids(text)
                    mask = np.ones(len(own), bool)
                names.append(batch.column(0).slice(k, 1))
                ids.append(np.append(own, np.uint32(CLOSING)).astype("<u4"))
                masks.append(np.append(mask, False))
                size += len(own) + 1
                if len(ids) == POOL or size >= POOL_IDS:
                    yield flush()
                    size = 0
        if ids:
            yield flush()

    columns = [F.col("doc_id"), F.col("text")]
    if spans:
        columns.append(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["length"].cast("int").alias("length"))).alias("spans"))
    return docs.select(*columns).mapInArrow(lean(apply), StructType([StructField("doc_id", kind), *(StructField(c, LongType()) for c in PIECES)]))
