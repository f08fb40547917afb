"""One segment of the index: sessions, blocks, postings and dictionary, each dealt by size.

Every table is written in as many parts as its size asks for, one task and one folder a
part, and every row's part follows from its key, so a reader opens only the parts that
it needs.

* ``sessions`` numbers the segment's sessions (``sid``).
* ``blocks`` go by session and run of lines, so a very long session spans many parts.
* ``postings`` go by term and salt.  A term has as many salts as it has rows for whole
  parts: frequent words span many parts, and no part holds much more than its share.
* ``dictionary`` has every term's counts under the term and under each word that lacks
  one of its letters, by checksum.  Two words at most one edit or swap apart share such
  a key, so a word's neighbours are found by a dozen keys.

What a segment holds of sessions that were changed or deleted later is dead.  A
*vector* has a bit for each dead session; a *delta* is a dictionary of what their blocks
held, with counts below zero, so sums over dictionaries are those of the present texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import text as T

DOC = ["session_path", "line_no", "block_no"]
SESSIONS = "session_path string, project string, project_display string, sid long"
BLOCKS = "session_path string, project string, line_no long, block_no long, ts_ms long, uuid string, source string, text string, sid long, part int"
POSTINGS = "term string, session_path string, project string, line_no long, block_no long, ts_ms long, tf int, dl int, sid long, part int"
DICTIONARY = "key long, term string, n int, own boolean, df long, cf long, salts int, part int"
VECTORS = "segment string, word long, bits long"
#: What a part is meant to hold: bytes of lines, postings, rows of the dictionary; and parts of a table, at most.
PART_BYTES, PART_ROWS, MOST_PARTS = 16 << 20, 1 << 18, 1 << 16
#: Lines of a session that lie in one part.
RUN = 4_096


def parts(size: int, each: int) -> int:
    """Parts for a table of ``size``; beyond MOST_PARTS they grow."""
    return min(MOST_PARTS, -(-size // each)) or 1


def home(keys: Iterable[Column | str], n: int) -> Column:
    """The part of a key among ``n``."""
    return F.pmod(F.crc32(F.concat_ws("#", *keys).cast("binary")), F.lit(n)).cast("int")


def home_of(keys: Iterable[object], n: int) -> int:
    """The same on the driver."""
    return zlib.crc32("#".join(map(str, keys)).encode()) % n


def _write(df: DataFrame, n: int, order: list[str], folder: str) -> None:
    df.repartitionById(n, F.col("part")).sortWithinPartitions(*order).write.partitionBy("part").parquet(folder)


def read(spark: SparkSession, folder: str, schema: str, only: Iterable[int] | None = None) -> DataFrame:
    """A table, or those of its parts that are named; parts without rows have no folder."""
    if only is None:
        return spark.read.schema(schema).parquet(folder)
    paths = [f"{folder}/part={p}" for p in sorted(set(only))]
    found = spark.read.schema(schema).option("basePath", folder).option("ignoreMissingFiles", "true")
    there = [p for p in paths if exists(spark, p)]
    return found.parquet(*there) if there else spark.createDataFrame([], schema)


def exists(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)


def postings(blocks: DataFrame) -> DataFrame:
    """(doc, project, ts_ms, sid, dl, term, tf), as far as ``blocks`` has them: one row per block and term.  Made row by row, without a shuffle."""
    kept = [c for c in (*DOC, "project", "ts_ms", "sid") if c in blocks.columns]
    words = blocks.select(*kept, F.array(F.struct(F.sort_array(T.tokens(F.col("text"))).alias("w"))).alias("_one"))

    def runs(own: Column) -> Column:
        w, n = own["w"], F.size(own["w"])
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: (n > 0) & ((i == 0) | (F.get(w, i) != F.get(w, i - 1))))
        made = F.transform(F.array(F.struct(starts.alias("s"))), lambda x: F.transform(x["s"], lambda s, k: F.struct(F.get(w, s).alias("term"), (F.coalesce(F.get(x["s"], k + 1), n) - s).alias("tf"))))
        return F.struct(n.alias("dl"), made[0].alias("runs"))

    counted = words.select(*kept, F.transform("_one", runs)[0].alias("_c"))
    return counted.select(*kept, F.col("_c.dl").alias("dl"), F.inline("_c.runs"))


def variants(term: Column) -> Column:
    """The term and what is left of it without one of its letters."""
    each = F.transform(F.sequence(F.lit(1), F.length(term)), lambda i: F.concat(F.substring(term, F.lit(1), i - 1), F.substring(term, i + 1, F.length(term))))
    return F.array_distinct(F.concat(F.array(term), each))


def variants_of(word: str) -> list[str]:
    """The same on the driver."""
    return list(dict.fromkeys([word, *(word[:k] + word[k + 1 :] for k in range(len(word)))]))


def key_of(variant: str) -> int:
    return zlib.crc32(variant.encode())


def dictionary(terms: DataFrame, n: int) -> DataFrame:
    """Rows of ``terms`` (term, df, cf, salts) under all their keys, in ``n`` parts."""
    spread = terms.select("*", F.explode(variants(F.col("term"))).alias("variant")).withColumn("key", F.crc32(F.col("variant").cast("binary")))
    return spread.select("key", "term", F.length("term").alias("n"), (F.col("variant") == F.col("term")).alias("own"), "df", "cf", "salts", F.pmod("key", F.lit(n)).cast("int").alias("part"))


def write_dictionary(terms: DataFrame, n_terms: int, folder: str) -> int:
    """Write it; the number of parts.  A term has some eight keys."""
    n = parts(8 * n_terms, PART_ROWS)
    _write(dictionary(terms, n), n, ["key", "term"], folder)
    return n


def write(blocks: DataFrame, sessions: DataFrame, size: int, folder: str) -> dict[str, int]:
    """Write a segment of ``blocks`` (no project) and ``sessions`` (path, labels); ``size``: bytes of their lines.

    The numbers of parts and rows, for the manifest.
    """
    spark = blocks.sparkSession
    numbered = sessions.withColumn("sid", F.monotonically_increasing_id())
    numbered.write.parquet(f"{folder}/sessions")
    held = spark.read.schema(SESSIONS).parquet(f"{folder}/sessions")
    n_blocks = parts(size, PART_BYTES)
    own = blocks.join(held.select("session_path", "project", "sid"), "session_path")
    own = own.select(*[c.split()[0] for c in BLOCKS.split(", ")[:-1]], home(["session_path", F.floor(F.col("line_no") / RUN).cast("string")], n_blocks).alias("part"))
    _write(own, n_blocks, DOC, f"{folder}/blocks")
    posts = postings(read(spark, f"{folder}/blocks", BLOCKS))
    posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).write.parquet(f"{folder}/terms")
    terms = spark.read.schema("term string, df long, cf long").parquet(f"{folder}/terms")
    told = terms.agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("rows"), F.coalesce(F.max("df"), F.lit(0)).alias("most")).first()
    n_posts = parts(told["rows"], PART_ROWS)
    each = max(PART_ROWS, told["rows"] // MOST_PARTS)
    terms = terms.withColumn("salts", F.ceil(F.col("df") / each).cast("int"))
    salt = F.lit(0)
    if told["most"] > each:
        # fewer than the postings have parts
        posts = posts.join(F.broadcast(terms.filter("salts > 1").select("term", "salts")), "term", "left")
        salt = F.pmod(F.xxhash64(*DOC), F.coalesce("salts", F.lit(1)))
    dealt = posts.withColumn("part", home(["term", salt.cast("string")], n_posts)).select(*[c.split()[0] for c in POSTINGS.split(", ")])
    _write(dealt, n_posts, ["term", *DOC], f"{folder}/postings")
    n_terms = write_dictionary(terms, told["terms"], f"{folder}/dictionary")
    return {"blocks": n_blocks, "postings": n_posts, "dictionary": n_terms, "rows": told["rows"], "each": each, "terms": told["terms"]}


def vectors(dead: DataFrame) -> DataFrame:
    """(segment, word, bits) of dead sessions (segment, sid): one word for 64 numbers of which some are dead."""
    return dead.groupBy("segment", F.expr("sid div 64").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("sid", F.lit(64)).cast("int"))).alias("bits"))


def alive(df: DataFrame, vector: DataFrame) -> DataFrame:
    """Rows of ``df`` whose session has no bit in ``vector`` (word, bits)."""
    marked = df.withColumn("_word", F.expr("sid div 64")).join(vector.withColumnRenamed("word", "_word"), "_word", "left")
    return marked.filter(F.col("bits").isNull() | (F.getbit("bits", F.pmod("sid", F.lit(64)).cast("int")) == 0)).drop("_word", "bits")
