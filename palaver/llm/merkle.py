"""Merkle manifest of a dataset, with proofs by coordinate lookup (11).

Rows are leaves; the leaves of a group, in order, form a binary tree, and the
groups' roots, in order, form the tree of the whole.  A node is known by its
coordinates (group, level, position).

1. Leaves get gapless positions: they are sorted over range partitions, and each
   partition is shifted by the sizes of those before.
2. Nodes are made SPAN levels at a time: 2**SPAN neighbours meet in one row, which
   holds all levels above them.  All nodes are written to the shared folder.
3. A leaf computes from its position and the size of its group which siblings it
   needs, explodes their coordinates and joins the nodes.  It does so for SPAN levels
   only; above them the node that it lies under asks once for all its 2**SPAN
   leaves, and so on upwards.  So no node is sought by more than 2**SPAN rows,
   however large its group is, and each path is joined to that of the node above it.
4. A path has one step a level, a digest on the left or on the right, or none where
   a node is alone.  Folding a leaf along it gives a root to compare.

Groups may be of any size; nothing is held by the driver but the number of rows and
the largest group's size.

Defined results: a null value counts as ``-``, so it differs from every text.  Rows
of one group are ordered by id, null first, then by leaf; repeated rows are leaves
each.  The null group comes first.  An empty table gives an empty result.  Columns
that are not hashed may have any name and are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SPAN = 10
#: Rows of a range partition, at least as many partitions as shuffles have.
RANGE_ROWS = 1_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<level: int, left: binary, right: binary>>"


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SHA-256 of the digests' lower-case hex, one after the other; null ones are passed over."""
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.lower(F.hex(p)), F.lit("")) for p in parts]), 256))


def leaf(**columns: Column) -> Column:
    """The digest of a row's fields, in the given order."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns.values()]), 256))


def _ceil(n: Column, level: Column) -> Column:
    """Nodes at ``level`` above ``n`` leaves."""
    return _up(n - 1, level) + 1


def _up(at: Column, levels: Column) -> Column:
    """The position of the node ``levels`` above."""
    return F.call_function("shiftright", at, levels)


def positions(leaves: DataFrame) -> DataFrame:
    """``leaves`` (g, id, h, more) with ``at``, gapless from 0 in each group, and the group's size ``n``."""
    spark = leaves.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), leaves.count() // RANGE_ROWS)
    # equal rows may lie in several partitions; which of them is which makes no difference
    dealt = leaves.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(partitions, "g", "id", "h", "_row")
    placed = dealt.sortWithinPartitions("g", "id", "h", "_row").drop("_row")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(placed.select("*", F.spark_partition_id().alias("part"), row.alias("row")), "merkle-leaves")
    sizes = placed.groupBy("g", "part").agg(F.count("*").alias("size"), F.min("row").alias("first"))
    whole = Window.partitionBy("g")
    before = F.coalesce(F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = stored(sizes.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("size").over(whole).alias("n")), "merkle-shifts")
    return placed.join(shifts, ["g", "part"]).withColumn("at", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def _levels(first: Column) -> Column:
    """All SPAN + 1 levels over up to 2**SPAN neighbours, from ``first`` up."""

    def above(held: Column, _: Column) -> Column:
        last = F.element_at(held, -1)
        pairs = F.sequence(F.lit(0), F.floor((F.size(last) - 1) / 2).cast("int"))
        return F.concat(held, F.array(F.transform(pairs, lambda k: digest(F.get(last, 2 * k), F.get(last, 2 * k + 1)))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(SPAN)), F.array(first), above)


def nodes(leaves: DataFrame, depth: int) -> DataFrame:
    """(g, n, level, at, h): all nodes over ``leaves`` (g, n, at, h), materialised; ``depth`` is the deepest tree's."""
    base, made = leaves.select("g", "n", "at", "h"), []
    for bottom in range(0, max(depth, 1), SPAN):
        rows = base.groupBy("g", "n", _up(F.col("at"), F.lit(SPAN)).alias("unit")).agg(F.sort_array(F.collect_list(F.struct("at", "h"))).alias("rows"))
        held = rows.select("g", "n", "unit", F.posexplode(_levels(F.col("rows.h"))).alias("up", "hs"))
        held = held.select("g", "n", "unit", "up", F.posexplode("hs").alias("k", "h"))
        level, at = F.col("up") + F.lit(bottom), F.call_function("shiftleft", F.col("unit"), F.lit(SPAN) - F.col("up")) + F.col("k")
        # the last level of one span is the first of the next; above a root there is nothing
        alone = (F.col("up") > 0) & (_ceil(F.col("n"), level - 1) == 1)
        keep = held.select("g", "n", level.cast("int").alias("level"), at.alias("at"), "h", alone.alias("alone"), "up").filter("not alone")
        made.append(stored(keep.filter(F.lit(bottom == 0) | (F.col("up") > 0)).drop("alone", "up"), "merkle-nodes"))
        base = made[-1].filter(F.col("level") == bottom + SPAN).select("g", "n", "at", "h")
    return reduce(DataFrame.unionByName, made)


def _steps(units: DataFrame, held: DataFrame, bottom: int) -> DataFrame:
    """(g, n, at, path): of each unit (g, n, at) at level ``bottom``, its steps over the next SPAN levels."""
    n, at, level = F.col("n"), F.col("at"), F.col("level")
    needed = F.filter(F.sequence(F.lit(bottom), F.lit(bottom + SPAN - 1)), lambda x: _ceil(n, x) > 1)
    # roots need none and keep one row, below all levels; a sibling beyond the last node is sought in vain
    asked = units.select("g", "n", "at", F.explode_outer(needed).alias("level")).withColumn("level", F.coalesce("level", F.lit(-1)))
    asked = asked.withColumn("own", _up(at, F.greatest(level - bottom, F.lit(0)))).withColumn("sibling", F.col("own").bitwiseXOR(F.lit(1).cast("long")))
    there = held.filter((level >= bottom) & (level < bottom + SPAN)).select("g", "level", F.col("at").alias("sibling"), "h")
    found = asked.join(there, ["g", "level", "sibling"], "left")
    left = F.col("own") % 2 == 1
    step = F.when(level >= 0, F.struct("level", F.when(left, F.col("h")).alias("left"), F.when(~left, F.col("h")).alias("right")))
    return found.groupBy("g", "n", "at").agg(F.sort_array(F.collect_list(step)).cast(PATH).alias("path"))


def tree(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (g, n, at, h, more) with the ``root`` of their group and their ``path`` to it; and (g, root)."""
    most = leaves.agg(F.max("n")).first()[0] or 1
    depth = (most - 1).bit_length()
    held = nodes(leaves, depth)
    roots = held.filter(_ceil(F.col("n"), F.col("level")) == 1).select("g", "level", F.col("h").alias("root"))
    above = None
    for bottom in reversed(range(0, max(depth, 1), SPAN)):
        if bottom:
            units = held.filter(F.col("level") == bottom).select("g", "n", "at")
        else:
            units = leaves.select("g", "n", "at")
        own = _steps(units, held, bottom)
        if above is None:
            # at most 2**SPAN units of a group meet its root
            own = own.join(roots.select("g", "root"), "g")
        else:
            # shallower groups have no nodes up there: their paths end here
            ended = roots.filter(F.col("level") < bottom + SPAN).select("g", F.lit(0).cast("long").alias("at"), F.array().cast(PATH).alias("path"), "root")
            higher = above.unionByName(ended).select("g", F.col("at").alias("unit"), F.col("path").alias("rest"), "root")
            own = own.withColumn("unit", _up(F.col("at"), F.lit(SPAN))).join(higher, ["g", "unit"]).withColumn("path", F.concat("path", "rest"))
        above = stored(own.select("g", "at", "path", "root"), "merkle-paths")
    return leaves.join(above, ["g", "at"]), roots.select("g", "root")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf gives along its path."""
    return F.aggregate(path, start, lambda held, x: digest(x["left"], held, x["right"]))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, in its order."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(*[F.coalesce(F.lower(F.hex(x[c])), F.lit("")) for c in ("left", "right")])), ""), 256)


def manifest(leaves: DataFrame) -> DataFrame:
    """``leaves`` (g: their group's name, null first; id; h; more) with ``subroot``, ``root`` and ``path``, from leaf to root.

    ``path`` can be kept with a row and is enough, with the root, to check the row later.
    """
    # names that sort as the groups do and are never null
    named = leaves.withColumn("g", F.when(F.col("g").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("g"))))
    own, roots = tree(positions(named))
    own = own.withColumnRenamed("root", "subroot").withColumnRenamed("path", "_path")
    top, _ = tree(positions(roots.select(F.lit("").alias("g"), F.col("g").alias("id"), F.col("root").alias("h"))))
    top = top.select(F.col("id").alias("g"), "root", F.col("path").alias("top"))
    return own.join(top, "g").withColumn("path", F.concat("_path", "top")).drop("_path", "top", "at", "n")


def check(df: DataFrame, h: str, path: str, root: str) -> DataFrame:
    """``df`` with ``folded``, what leaf ``h`` gives along ``path``, and ``verified``: whether that is ``root``."""
    return df.withColumn("folded", fold(F.col(h), F.col(path))).withColumn("verified", F.col("folded") == F.col(root))


def audit(docs: DataFrame, tampered: dict[str, Column], by: str = "lang") -> DataFrame:
    """A manifest of ``docs`` and a check of rows in which ``tampered`` columns have taken other values.

    (doc_id, leaf, subroot, root, path, folded, verified), the leaf as it was.
    """
    fields = {c: F.col(c) for c in FIELDS}
    rows = stored(docs.select(F.col(by).cast("string").alias("g"), F.col("doc_id").alias("id"), leaf(**fields).alias("h"), leaf(**{**fields, **tampered}).alias("h2")), "merkle-rows")
    found = check(manifest(rows), "h2", "path", "root")
    return found.select(F.col("id").alias("doc_id"), F.col("h").alias("leaf"), "subroot", "root", "path", "folded", "verified")


def report(found: DataFrame) -> DataFrame:
    """Digests as text, and the siblings' digest."""
    text = lambda c: F.lower(F.hex(c))
    return found.select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
        text("folded").alias("folded_root"), "verified",
    )
