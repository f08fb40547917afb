"""How the tokens of two tokenizers lie over each other (12).

Both tokenizers cut the same bytes.  Tokens are linked where they overlap; byte
offsets where tokens of both end cut the text into groups.

1. A text falls into parts at single spaces between two characters that are not
   white space: there both tokenizers cut whatever else the text holds, so parts
   are tokenised on their own.  Each task takes its rows in units of some megabytes
   and tokenises each distinct part of a unit once.
2. The tokens of a unit's parts, laid end to end, are two tables of intervals in
   DuckDB.  An ASOF join finds the token that holds another's first byte; joined in
   both directions, the second for bytes inside a range only, this gives every overlap
   once.  Window sums over the common ends number the groups.  A unit gives its
   documents with the numbers of their parts, the parts with the numbers of their
   pairs, and a partial count for each id pair.
3. Spark adds up the pair counts, marks the highest of each B id, and brings both
   back to the units that hold the pair, where documents sum over their links.

Pairs are counted by unit before they are shuffled, so a frequent one is one row a
unit.  A unit is bounded by UNIT bytes, or one text if that is longer.

Defined results: a null or empty text, and one whose tokens of either kind do not
join to a space and the text (letters that B's normaliser changes, U+2581), has no
tokens: all numbers are 0 and the digest is empty.  Repeated rows are kept each, with
ids null or not.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, scratch, values

UNIT = 6 << 20
#: Between two parts: one space, no other white space beside it.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Texts without such white space fall apart at every space.
BESIDE = re.compile(r"\s\s|\A\s|\s\Z").search
#: White space and marks on which the quick tokenizer of A might differ.
ODD = re.compile(r"\s{2}|[\x1c-\x1f\x85\ufeff]").search
#: Parts that begin and end with neither, so that they may stand between spaces.
PLAIN = re.compile(r"\S(?:.*\S)?\Z", re.S).match
COUNTS = ("n_a", "n_b", "n_groups", "n_links")

# a, b: (id, part, s, e), the tokens' bytes laid end to end
LINKS = """CREATE OR REPLACE TEMP TABLE links AS
SELECT a.part, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.s >= b.s
UNION ALL SELECT b.part, a.id, b.id FROM b ASOF JOIN a ON b.s >= a.s WHERE b.s > a.s"""
PAIRS = """SELECT a, b, CAST(sum(times) AS BIGINT) AS n, row_number() OVER (ORDER BY a, b) - 1 AS pair FROM links JOIN given USING (part) GROUP BY a, b ORDER BY pair"""
NUMBERED = "SELECT part, pair FROM links JOIN pairs USING (a, b) ORDER BY part"
GROUPS = """WITH ends AS (SELECT a.e FROM a JOIN b ON a.e = b.e),
tokens AS (SELECT part, s, e, id, 0 AS kind FROM a UNION ALL SELECT part, s, e, id, 1 FROM b)
SELECT part, kind, id, coalesce(sum(CASE WHEN ends.e IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY kind ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp
FROM tokens LEFT JOIN ends USING (e) ORDER BY grp, kind, s"""


class Tokens:
    """Ids and lengths in bytes of a part by both tokenizers; none where they do not join to a space and the part."""

    def __init__(self, tokenizer: str, ranks: str, pieces: str) -> None:
        import duckdb
        import sentencepiece
        from tokenizers import Tokenizer

        from .packing import Encoder

        self.whole = Tokenizer.from_file(tokenizer)
        self.whole.encode_special_tokens = True
        quick = Encoder(tokenizer, ranks)
        self.quick = quick.quick
        self.a = self._bytes()
        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.b = [self._piece(p, self.model.is_byte(k)) for k, p in enumerate(names)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a, self.b))
        #: Whether no piece goes on after a space that follows another character, so that texts may be cut there.
        self.cuts = not any("▁" in p.lstrip("▁") for p in names)
        #: Ids as text after what stands between groups, kinds and tokens.
        self.marked = [[f"{m}{k}" for k in range(max(len(self.a), len(self.b)))] for m in ";|,"]
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": "", "preserve_insertion_order": False})

    @staticmethod
    def _piece(piece: str, byte: bool) -> bytes:
        return bytes([int(piece[3:5], 16)]) if byte else piece.replace("▁", " ").encode()

    def _bytes(self) -> list[bytes]:
        """The bytes of A's tokens: its printable characters stand for bytes."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        found = sorted((k, t) for t, k in self.whole.get_vocab().items())
        return [bytes(char[c] for c in t) if set(t) <= char.keys() else t.encode() for _, t in found]

    def parts(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        return CUT.split(text) if BESIDE(text) else text.split(" ")

    def encode(self, given: str) -> tuple[list[int], list[int]] | None:
        """Ids of ``given`` by A and B; none if either do not join to it.  It starts with a space."""
        a = self.whole.encode(given, add_special_tokens=False).ids if ODD(given) else self.quick(given)
        b, whole = self.model.encode(given[1:]), given.encode()
        same = b"".join(map(self.a.__getitem__, a)) == whole == b"".join(map(self.b.__getitem__, b))
        return (a, b) if same else None

    def encode_all(self, parts: list[str]) -> tuple[np.ndarray, list[list[int]], list[list[int]]]:
        """Which parts are good, and the ids of these by A and B, one after the other.

        Parts that lie between spaces are encoded many at once, with spaces between them as in a text.
        """
        good, a, b = np.ones(len(parts), bool), [], []
        at = 0
        while at < len(parts):
            many = parts[at : at + 512]
            found = self.encode(" " + " ".join(many)) if self.cuts and all(map(PLAIN, many)) else None
            if found:
                a.append(found[0])
                b.append(found[1])
            else:
                for k, part in enumerate(many, at):
                    found = self.encode(" " + part) if part else None
                    good[k] = found is not None
                    if found:
                        a.append(found[0])
                        b.append(found[1])
            at += len(many)
        return good, a, b


@lru_cache(maxsize=1)
def tokens(*files: str) -> Tokens:
    return Tokens(*files)


class Unit:
    """Rows gathered until their texts reach UNIT bytes, and what is made of them."""

    def __init__(self, number: int) -> None:
        self.number, self.size = number, 0
        self.index: dict[str, int] = defaultdict(count().__next__)
        self.docs: list[tuple[object, np.ndarray | None]] = []

    def add(self, doc_id: object, text: str | None, own: Tokens) -> None:
        seq = np.fromiter(map(self.index.__getitem__, own.parts(text)), np.int32) if text else None
        self.docs.append((doc_id, seq))
        self.size += len(text or "")

    def tables(self, own: Tokens) -> tuple[pa.Table, pa.Table]:
        """The interval tables of all good parts."""
        parts = sorted(self.index, key=self.index.__getitem__)
        good, *found = own.encode_all(parts)
        self.bad = ~good
        numbers = np.flatnonzero(good)
        # a part's bytes with the space before it
        ends = np.cumsum([len(parts[k].encode()) + 1 for k in numbers.tolist()])
        out = []
        for ids, sizes in zip(found, (own.a_sizes, own.b_sizes), strict=True):
            flat = np.fromiter((x for few in ids for x in few), np.int32)
            size = sizes[flat]
            e = np.cumsum(size)
            out.append(pa.table({"id": flat, "part": numbers[np.searchsorted(ends, e)].astype(np.int32), "s": e - size, "e": e}))
        return out[0], out[1]

    def rows(self, own: Tokens) -> Iterator[pa.RecordBatch]:
        con, n = own.con, len(self.index)
        for name, found in zip("ab", self.tables(own), strict=True):
            con.register("given", found)
            con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
            con.unregister("given")
        con.execute(LINKS)
        held = con.execute(GROUPS).fetchnumpy()
        part, kind, grp = (np.asarray(held[c], np.int64) for c in ("part", "kind", "grp"))
        numbers = np.zeros((len(COUNTS), n), np.int64)
        numbers[0], numbers[1] = np.bincount(part[kind == 0], minlength=n), np.bincount(part[kind == 1], minlength=n)
        numbers[2] = np.bincount(part[np.flatnonzero(np.diff(grp, prepend=-1))], minlength=n)
        # ids as text, each with what stands before it
        mark = np.where(np.diff(grp, prepend=-1) != 0, 0, np.where(np.diff(kind, prepend=0) != 0, 1, 2))
        words = [own.marked[m][k] for m, k in zip(mark.tolist(), held["id"].tolist(), strict=True)]
        edges = np.searchsorted(part, np.arange(n + 1)).tolist()  # groups lie within parts, in their order
        said = ["".join(words[a:z]) for a, z in zip(edges, edges[1:], strict=False)]
        del held, words, kind, grp, part
        times, docs = np.zeros(n, np.int64), []
        for doc_id, seq in self.docs:
            if seq is None or self.bad[seq].any():
                docs.append((doc_id, None, ""))
                continue
            np.add.at(times, seq, 1)
            docs.append((doc_id, seq, hashlib.sha256("".join(map(said.__getitem__, seq.tolist()))[1:].encode()).hexdigest()))
        con.register("given", pa.table({"part": np.arange(n, dtype=np.int32), "times": times}))
        con.execute(f"CREATE OR REPLACE TEMP TABLE pairs AS {PAIRS}")
        con.unregister("given")
        links = con.execute(NUMBERED).fetchnumpy()
        numbers[3] = np.bincount(links["part"], minlength=n)
        yield from self._docs(docs, numbers)
        yield from self._links(np.asarray(links["pair"], np.int32), numbers[3])
        pairs = con.sql("SELECT a, b, n, pair FROM pairs").to_arrow_table().combine_chunks()
        for batch in pairs.to_batches(1 << 16):
            yield self._batch("pairs", {c: batch[c] for c in batch.schema.names}, batch.num_rows)

    def _docs(self, docs: list[tuple], numbers: np.ndarray, rows: int = 256) -> Iterator[pa.RecordBatch]:
        """Rows of documents: their counts, digest and parts, in order."""
        for k in range(0, len(docs), rows):
            few = docs[k : k + rows]
            sums = [numbers[:, seq].sum(axis=1) if seq is not None else np.zeros(len(COUNTS), np.int64) for _, seq, _ in few]
            own = {"doc_id": pa.array([d[0] for d in few]), "groups_sha256": pa.array([d[2] for d in few], pa.string())}
            own |= {c: pa.array([int(x[j]) for x in sums], pa.int64()) for j, c in enumerate(COUNTS)}
            yield self._batch("docs", own | {"numbers": pa.array([seq if seq is not None else [] for _, seq, _ in few], pa.list_(pa.int32()))}, len(few))

    def _links(self, pairs: np.ndarray, sizes: np.ndarray, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        """Rows of parts from ``first`` on: the numbers of their pairs, one after the other, and how many each has."""
        upto = np.append(0, np.cumsum(sizes))
        for k in range(0, len(sizes), rows):
            few = sizes[k : k + rows].astype(np.int32)
            own = {"first": pa.array([k], pa.int32()), "sizes": pa.array([few], pa.list_(pa.int32()))}
            yield self._batch("links", own | {"numbers": pa.array([pairs[upto[k] : upto[k + len(few)]]], pa.list_(pa.int32()))}, 1)

    def _batch(self, kind: str, own: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        own = own | {"kind": pa.array([kind] * n), "unit": pa.array([self.number] * n, pa.int64())}
        return pa.RecordBatch.from_arrays([own[f.name].cast(f.type) if f.name in own else pa.nulls(n, f.type) for f in self.schema], schema=self.schema)

    schema: pa.Schema


def schema(id_type: pa.DataType) -> pa.Schema:
    """Rows of all kinds; what is another kind's is null."""
    longs = [(c, pa.int64()) for c in COUNTS]
    numbers = [(c, pa.list_(pa.int32())) for c in ("numbers", "sizes")]
    pairs = [(c, pa.int32()) for c in ("first", "a", "b", "pair")]
    return pa.schema([("kind", pa.string()), ("unit", pa.int64()), ("doc_id", id_type), *longs, ("groups_sha256", pa.string()), *numbers, *pairs, ("n", pa.int64())])


def units(docs: DataFrame, files: tuple[str, str, str], folder: str) -> DataFrame:
    """What all units give, by kind, written to ``folder``."""
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

    shape = schema(to_arrow_type(docs.schema["doc_id"].dataType))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = tokens(*files), TaskContext.get().partitionId() << 32
        numbers = count(first)

        def fresh() -> Unit:
            made = Unit(next(numbers))
            made.schema = shape
            return made

        unit = fresh()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), values(batch["text"]), strict=True):
                unit.add(doc_id, text.decode() if text else None, own)
                if unit.size >= UNIT:
                    yield from unit.rows(own)
                    unit = fresh()
        if unit.docs:
            yield from unit.rows(own)

    out = docs.select("doc_id", "text").mapInArrow(lean(apply), from_arrow_schema(shape))
    out.write.partitionBy("kind").parquet(folder)
    return docs.sparkSession.read.schema(out.schema).parquet(folder)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, links, best): links of each id pair over the corpus, and whether its B id has none more frequent."""
    summed = pairs.groupBy("a", "b").agg(F.sum("n").alias("links"))
    # at most as many rows a B id as A has ids
    return summed.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))


def _attach(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of one unit with the sums over their links."""
    pair = right["pair"].to_numpy()
    by_pair = np.zeros((2, int(pair.max(initial=-1)) + 1), np.int64)
    by_pair[0, pair], by_pair[1, pair] = right["best"].to_numpy(), right["links"].to_numpy()
    links = left.filter(pa.compute.equal(left["kind"], "links")).sort_by("first")
    sizes, numbers = (np.concatenate([np.zeros(0, np.int32), *[x.values.to_numpy() for x in links[c].chunks]]) for c in ("sizes", "numbers"))
    upto = np.append(0, np.cumsum(sizes, dtype=np.int64))
    by_part = np.stack([np.diff(np.append(0, np.cumsum(x[numbers]))[upto]) for x in by_pair])
    docs = left.filter(pa.compute.equal(left["kind"], "docs"))
    sums = [by_part[:, x.as_py()].sum(axis=1) if len(x) else (0, 0) for x in docs["numbers"]]
    out = docs.select(["doc_id", *COUNTS])
    for k, c in enumerate(("n_best", "count_sum")):
        out = out.append_column(c, pa.array([int(x[k]) for x in sums], pa.int64()))
    return out.append_column("groups_sha256", docs["groups_sha256"])


def align(docs: DataFrame, tokenizer: str, ranks: str, pieces: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    A is the byte-level ``tokenizer`` with its twin of ``ranks``, B the model ``pieces``.
    """
    found = units(docs, (tokenizer, ranks, pieces), scratch(docs.sparkSession, "alignment"))
    pairs = found.filter("kind = 'pairs'").select("unit", "pair", "a", "b", "n")
    weighed = pairs.drop("n").join(pair_counts(pairs), ["a", "b"]).select(F.col("unit").alias("of"), "pair", F.col("best").cast("int").alias("best"), "links")
    own = found.filter("kind <> 'pairs'").select("kind", "unit", "doc_id", *COUNTS, "groups_sha256", "first", "sizes", "numbers")
    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name in ("doc_id", *COUNTS)]
    out = ", ".join([*shape, "n_best bigint", "count_sum bigint", "groups_sha256 string"])
    return own.groupBy("unit").cogroup(weighed.groupBy("of")).applyInArrow(_attach, out)
