"""SimHash near-duplicates (10) with pivot distance tables.

Fingerprints: 64 bits by majority over the XXH64 of all word shingles.
Links: fingerprints at most ``radius`` (3) bits apart.

1. Texts become fingerprints; rows of one fingerprint are one node from here on,
   so thousands of exact copies cost one row.
2. Every distinct fingerprint gets its row of the pivot table, computed once:
   Hamming distances to one base reference, to NEAR references that are the base
   with one pair of bits turned, and to FAR random references.
3. Cells.  The distance to the base less that to a near reference is -2, 0 or 2:
   a coordinate that one differing bit moves by a step, and no bit moves two
   coordinates.  Fingerprints ``radius`` bits apart thus differ in ``radius``
   coordinates at most, and of GROUPS groups of coordinates all but ``radius``
   agree throughout.  A fingerprint goes to the cells named by the coordinates of
   every choice of that many groups (20 cells of about 24 bits for three bits), so
   each link meets in a cell, whatever the data.
4. Cells with one member go.  A crowded cell is dealt into tiles of at most about
   TILE members, and each pair of tiles is one bounded unit of work: no link is
   lost and no task holds an unbounded group.  Rows of very crowded cells meet a
   broadcast of their counts and are not shuffled to one task.
5. Within a unit, pairs are discarded whose rows of the table differ by more than
   ``radius`` in any coordinate (triangle inequality), coordinate by coordinate;
   survivors are verified on the fingerprints.  A unit returns a spanning forest
   of its links, not all pairs.
6. Star contraction joins the forests into components.

Single random references pass half of all random pairs, so cells come from the
near references, whose coordinates are independent of each other, and discarding
from the far ones, which see all bits.

Defined results: null, empty and blank texts have fingerprint zero and are
linked like others.  Repeated rows are repeated in the result.  A null doc_id
keeps its row and is never a component's name; a component of null ids only has
a null name.  An empty table has an empty result.  Texts of any length are read
whole.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, guarded, hot_left_join, lean, values
from .graph import components

SHINGLE = 3
SEED = 42
RADIUS = 3
NEAR = 32
FAR = 16
GROUPS = 6
TILE = 1500
#: Links held at a time, about.
HELD = 1 << 18
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit fingerprint; zero without words."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in values(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(lean(apply), f"doc_id {kind}, fp long")


def references() -> tuple[int, list[int], list[int]]:
    """The base reference, the near ones and the far ones, as signed longs."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = xxhash.xxh64_intdigest(b"base reference", SEED)
    near = [base ^ (3 << (64 // NEAR * k)) for k in range(NEAR)]
    far = [xxhash.xxh64_intdigest(f"far reference {k}".encode(), SEED) for k in range(FAR)]
    return signed(base), [signed(x) for x in near], [signed(x) for x in far]


def distance(reference: int) -> Column:
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(reference)))


def table_columns(groups: int = GROUPS) -> list[Column]:
    """The pivot table's row: the near distances as a code for each group of coordinates, ``g0`` and
    so on, and the far ones, eight to a long, ``p0`` and ``p1``."""
    base, near, far = references()
    codes = []
    for k in range(groups):
        code = F.lit(0)
        for reference in near[k::groups]:
            code = code * 3 + 1 + ((distance(base) - distance(reference)) / 2).cast("int")
        codes.append(code.cast("long").alias(f"g{k}"))
    packed = []
    for at in range(0, FAR, 8):
        value = F.lit(0).cast("long")
        for k, reference in enumerate(far[at : at + 8]):
            value = value.bitwiseOR(F.shiftleft(distance(reference).cast("long"), 8 * k))
        packed.append(value.alias(f"p{at // 8}"))
    return codes + packed


def cells(radius: int = RADIUS, groups: int = GROUPS) -> Column:
    """The cells of a table row: the choice of groups and their codes."""
    names = []
    for number, chosen in enumerate(combinations(range(groups), groups - radius)):
        name = F.lit(number).cast("long")
        for k in chosen:
            name = name * 3 ** len(range(k, NEAR, groups)) + F.col(f"g{k}")
        names.append(name)
    return F.explode(F.array(*names))


def forest(fps: np.ndarray, table: np.ndarray, unit: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(k, m): every row k of a component of links within its unit, but the component's first row m.

    Rows of a unit stand together.  Where a unit has rows of two sides, only pairs across count.
    """
    n = len(fps)
    end = np.searchsorted(unit, unit, side="right")
    two = side != side[np.searchsorted(unit, unit)]
    mixed = np.zeros(n, bool)
    mixed[:] = np.isin(unit, unit[two]) if two.any() else False
    low = np.arange(n)
    firsts, seconds, held = [], [], 0
    rows = np.arange(n)
    for gap in range(1, int(np.bincount(unit - unit[0]).max()) if n else 1):
        rows = rows[rows + gap < end[rows]]
        i, j = rows, rows + gap
        keep = ~mixed[i] | (side[i] != side[j])
        i, j = i[keep], j[keep]
        for c in range(table.shape[1]):  # the pivot table discards, coordinate by coordinate
            near = np.abs(table[i, c] - table[j, c]) <= radius
            i, j = i[near], j[near]
            if not len(i):
                break
        true = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        firsts.append(i[true])
        seconds.append(j[true])
        held += len(firsts[-1])
        if held > HELD:  # crowds are full of links: those so far are folded into the components
            low = _joined(low, np.concatenate(firsts), np.concatenate(seconds))
            firsts, seconds, held = [], [], 0
    if held:
        low = _joined(low, np.concatenate(firsts), np.concatenate(seconds))
    moved = np.flatnonzero(low != np.arange(n))
    return moved, low[moved]


def _joined(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first row of each row's component, with the links (i, j) added to the components of ``low``."""
    while True:
        least = np.minimum(low[i], low[j])
        now = low.copy()
        for at in (i, j, low[i], low[j]):
            np.minimum.at(now, at, least)
        now = now[now]
        if (now == low).all():
            return low
        low = now


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, groups: int = GROUPS) -> DataFrame:
    """(u, v): for ``nodes`` (fp, all distinct), links whose components are those of all links."""
    if not 0 <= radius < groups:
        raise ValueError("more groups than bits are needed")
    rows = cut(nodes.select("fp", *table_columns(groups)))
    keyed = rows.select("fp", "p0", "p1", cells(radius, groups).alias("cell"))
    shared = cut(keyed.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").withColumn("rows", F.col("n")))
    met = hot_left_join(keyed, shared, "cell", "n").filter("rows is not null")
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    units = (
        met.withColumn("k", F.ceil(F.col("rows") / F.lit(tile)).cast("int")).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .groupBy("cell", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
        .agg(F.collect_list(F.struct("own", "fp", "p0", "p1")).alias("m"))
        .filter(F.size("m") > 1)
        .select(F.col("m.own").alias("own"), F.col("m.fp").alias("fp"), F.col("m.p0").alias("p0"), F.col("m.p1").alias("p1"))
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column(0).offsets))
            order = np.argsort(sizes, kind="stable")  # units of like size together
            at, ends = np.asarray(batch.column(0).offsets), np.cumsum(sizes[order])
            own, fp, p0, p1 = (batch.column(k).values.to_numpy(zero_copy_only=False) for k in range(4))
            us, vs, first = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
            while first < len(order):  # about a tile of rows at a time
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + TILE)))
                part = order[first:last]
                rows = np.concatenate([np.arange(at[r], at[r + 1]) for r in part])
                unit = np.repeat(np.arange(len(part)), sizes[part])
                table = np.concatenate([np.ascontiguousarray(p[rows]).view(np.uint8).reshape(-1, 8) for p in (p0, p1)], axis=1).astype(np.int16)
                a, b = forest(fp[rows].view(np.uint64), table, unit, own[rows], radius)
                us.append(fp[rows][a])
                vs.append(fp[rows][b])
                first = last
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return units.mapInArrow(lean(apply), "u long, v long").distinct()


def _classes(docs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp), and of each fingerprint: rep (its smallest doc_id), n, component and component_id."""
    rows = cut(fingerprints(docs).withColumn("doc_id", F.col("doc_id").cast("long")))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    # nodes are named by fingerprint, as all rows of one may have null ids
    joined = components(links(nodes.select("fp"), radius))
    named = nodes.join(joined, nodes["fp"] == joined["node"], "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return rows, cut(named.join(least, "component").select("fp", "rep", "n", "component", "component_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    rows, of = _classes(docs, radius)
    return hot_left_join(rows, of.select("fp", "component_id", "n"), "fp", "n")


def _with_fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` and their fingerprint as ``_simhash``."""
    names = docs.columns
    at = names.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in values(b.column(at))], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], names=[*names, "_simhash"])

    return docs.mapInArrow(lean(apply), StructType([*docs.schema.fields, StructField("_simhash", LongType())]))


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component: that with the smallest doc_id (null ids last), then the smallest fingerprint.

    Where that id stands on one row only, the row is found by it.  Rows of a
    repeated or null id are told apart by their fingerprints, and of equal ones
    any is taken.
    """
    return guarded(docs, {"doc_id", "text"}, lambda d: _first_rows(d, radius))


def _first_rows(docs: DataFrame, radius: int) -> DataFrame:
    names = [f"`{c}`" for c in docs.columns]
    rows, of = _classes(docs, radius)
    first = of.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("last"), "rep", "fp")).alias("w"))
    first = cut(first.select(F.col("w.rep").alias("doc_id"), F.col("w.fp").alias("_fp")))
    counts = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n"))
    wanted = cut(counts.join(first.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("_once", F.col("_n") == 1))
    kept = hot_left_join(docs, wanted, "doc_id", "_n").filter("_once").select(*names)
    if wanted.filter("not _once").isEmpty() and first.filter("doc_id is null").isEmpty():
        return kept
    repeated = hot_left_join(docs.filter("doc_id is not null"), wanted, "doc_id", "_n").filter("not _once").select(*names)
    unclear = _with_fingerprint(repeated.unionByName(docs.filter("doc_id is null")))
    one = unclear.groupBy("doc_id", "_simhash").agg(F.first(F.struct(*names)).alias("_row"))
    same = (one["_simhash"] == first["_fp"]) & one["doc_id"].eqNullSafe(first["doc_id"])
    return kept.unionByName(one.join(first, same, "left_semi").select("_row.*"))
