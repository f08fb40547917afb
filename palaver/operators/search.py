"""Ranked, typo-tolerant search over stored postings.

A query is tokenised like the text.  Its words are sought in the index's dictionary:
each query token scores the blocks that hold it by three times BM25, and, from three
letters on, blocks with any word one edit away by one.  A page takes three jobs: the
dictionary's parts that hold the words and their neighbours, with their counts; the
postings' parts of these terms, scored and cut to the best on narrow rows; and the
blocks' parts of these alone.  Statistics describe the whole corpus, filters come after.
Ties end by session and place.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palaver.functions import text as T
from palaver.operators import segments as S
from palaver.operators.index import DOC, Index, postings
from palaver.sources import jsonl

__all__ = ["Filters", "Terms", "cold", "cold_hits", "corpus_stats", "matches", "neighbours", "postings", "query_tokens", "search", "summary", "term_df", "tiers", "two_tier"]

BOOST, K1, B = 3.0, 1.2, 0.75
FUZZY_LEAST = 3
DEFAULT_LIMIT = 500
#: Hits fetched by name, at most; beyond, the blocks are joined.
NAMED = 10_000


@dataclass
class Filters:
    """Inclusive bounds in epoch milliseconds; no projects means all."""

    start: int | None = None
    stop: int | None = None
    projects: list[str] = field(default_factory=list)
    session_path: str | None = None

    def condition(self) -> Column:
        out = F.lit(True)
        if self.projects:
            out &= F.col("project").isin(self.projects)
        if self.start is not None:
            out &= F.col("ts_ms") >= self.start
        if self.stop is not None:
            out &= F.col("ts_ms") <= self.stop
        if self.session_path is not None:
            out &= F.col("session_path") == self.session_path
        return out


def query_tokens(query: str) -> list[str]:
    """The query's tokens, repeated ones kept."""
    return [w.lower() for w in re.findall(r"[^\W_]+", query) if len(w.encode()) < T.TOKEN_BYTES]


def corpus_stats(index: Index) -> DataFrame:
    """One row: number of blocks, words, and words a block."""
    files = index.files().agg(F.coalesce(F.sum("n_blocks"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    return files.withColumn("avg_len", F.col("n_tokens") / F.nullif(F.col("n_docs"), F.lit(0)))


def term_df(index: Index) -> DataFrame:
    """(term, df): in how many blocks each term is, as the dictionary knows it."""
    return index.vocabulary().select("term", "df")


def _met(index: Index, words: list[str]) -> DataFrame:
    """(tok, word, term, segment, key, df, salts, fuzzy): the dictionary's rows under the keys of the words that are near them."""
    asked = [(k, w, S.key_of(v)) for k, w in enumerate(words) for v in (S.variants_of(w) if len(w) >= FUZZY_LEAST else [w])]
    spark = index.spark
    keyed = F.broadcast(spark.createDataFrame(asked, "tok int, word string, key long"))
    rows = index.dictionary({key for _, _, key in asked}).join(keyed, "key")
    long = F.length("word") >= FUZZY_LEAST
    near = rows.filter((F.col("word") == F.col("term")) | long & T.one_edit(F.col("word"), F.col("term")))
    return near.select("tok", "word", "term", "segment", "key", "df", "salts", long.alias("fuzzy"))


def neighbours(index: Index, words: list[str]) -> DataFrame:
    """(tok, term, segment, exact, fuzzy, df, salts) of the terms that the words reach: equal, or one edit or swap away if long enough.

    Terms and words that far apart share the word itself or what is left without a letter, so the dictionary is
    joined on a dozen keys a word and only their parts are opened.
    """
    # a term may be met under several keys, under each with all its counts
    summed = _met(index, words).groupBy("tok", "word", "term", "segment", "key", "fuzzy").agg(F.sum("df").alias("df"), F.max("salts").alias("salts"))
    once = summed.groupBy("tok", "word", "term", "segment", "fuzzy").agg(F.max("df").alias("df"), F.max("salts").alias("salts")).filter("df > 0")
    return once.select("tok", "term", "segment", (F.col("word") == F.col("term")).alias("exact"), "fuzzy", "df", "salts")


@dataclass
class Terms:
    """The stored terms that a query reaches, fetched by one job without a shuffle: few, as all are within one edit of a word."""

    index: Index
    words: list[str]
    rows: list[dict]

    @classmethod
    def of(cls, index: Index, query: str) -> Terms:
        """``neighbours`` of the query's words, summed here."""
        words = query_tokens(query)
        summed: dict[tuple, list[int]] = {}
        for r in _met(index, words).collect() if words and not index.empty else []:
            held = summed.setdefault((r["tok"], r["term"], r["segment"], r["fuzzy"], r["key"]), [0, 0])
            held[0], held[1] = held[0] + r["df"], max(held[1], r["salts"])
        once = {key[:4]: held for key, held in summed.items() if held[0] > 0}
        rows = [{"tok": k, "term": t, "segment": s, "exact": words[k] == t, "fuzzy": f, "df": n, "salts": salts} for (k, t, s, f), (n, salts) in once.items()]
        return cls(index, words, rows)

    def df(self) -> dict[str, int]:
        by_segment = {(r["term"], r["segment"]): r["df"] for r in self.rows}
        out: dict[str, int] = {}
        for (term, _), n in by_segment.items():
            out[term] = out.get(term, 0) + n
        return out

    def idf(self, df: int) -> float:
        n = self.index.totals()[0]
        return math.log(1 + (n - df + 0.5) / (df + 0.5))

    def weights(self) -> dict[str, int]:
        """The words that are terms themselves, and how much each tells, in millionths."""
        df = self.df()
        return {w: round(self.idf(df[w]) * 1_000_000) for w in dict.fromkeys(self.words) if w in df}

    def matches(self, filters: Filters | None = None) -> DataFrame:
        """(doc, project, ts_ms, score) of all matching blocks."""
        index, words = self.index, self.words
        spark, df = index.spark, self.df()
        if not self.rows:
            return spark.createDataFrame([], "session_path string, line_no long, block_no long, project string, ts_ms long, score double")
        posts = index.postings(index.posting_homes((r["segment"], r["term"], r["salts"]) for r in self.rows)).filter(F.col("term").isin(sorted(df)))
        known = sorted({(r["tok"], r["term"], r["exact"], r["fuzzy"], self.idf(df[r["term"]])) for r in self.rows})
        asked = F.broadcast(spark.createDataFrame(known, "tok int, term string, exact boolean, fuzzy boolean, idf double"))
        n_docs, n_tokens = index.totals()
        weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(n_tokens / n_docs)))
        if filters:
            # the statistics are taken already: what a filter drops need not be scored
            posts = posts.filter(filters.condition())
        near = [F.max(F.when((F.col("tok") == k) & F.col("fuzzy"), 1.0).otherwise(0.0)) for k in range(len(words))]
        exact = F.coalesce(F.sum(F.when(F.col("exact"), BOOST * F.col("idf") * weight)), F.lit(0.0))
        hits = posts.join(asked, "term").groupBy(*DOC, "project", "ts_ms").agg(F.round(reduce(Column.__add__, near, exact), 6).alias("score"))
        return hits.filter("score > 0")

    def top(self, filters: Filters | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
        return self.matches(filters).orderBy(F.desc("score"), *DOC).limit(limit)

    def shown(self, found: DataFrame) -> DataFrame:
        """Blocks ``found`` as hits: the fragment that tells most, and ranges within it: literal ones, or words one edit away."""
        cut = found.withColumn("snippet", T.best_fragment(F.col("text"), self.weights()))
        literal = T.match_ranges(F.col("snippet"), self.words)
        ranges = F.when(F.size(literal) > 0, literal).otherwise(T.fuzzy_ranges(F.col("snippet"), self.words))
        return cut.select("session_path", "project", F.when(F.col("ts_ms") != 0, F.col("ts_ms")).alias("ts_ms"), "line_no", "block_no", "uuid", "source", "snippet", ranges.alias("match_ranges"), "score")


def matches(index: Index, query: str, filters: Filters | None = None) -> DataFrame:
    """(doc, project, ts_ms, score) of all matching blocks."""
    return Terms.of(index, query).matches(filters)


def top(index: Index, query: str, filters: Filters | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(doc, project, ts_ms, score) of the best ``limit`` blocks, in order."""
    return Terms.of(index, query).top(filters, limit)


def _all_hits(index: Index, found: DataFrame) -> DataFrame:
    """``found`` with the stored columns of its blocks, however many."""
    return found.join(index.blocks().select(*DOC, "uuid", "source", "text"), DOC)


def _named_hits(index: Index, rows: list, schema: StructType) -> DataFrame:
    """The same for a page of rows: only the parts that hold them are opened."""
    named = index.spark.createDataFrame(rows, schema)
    stored = index.blocks(F.col("session_path").isin(sorted({r["session_path"] for r in rows})), index.block_homes((r["session_path"], r["line_no"]) for r in rows))
    return stored.select(*DOC, "uuid", "source", "text").join(F.broadcast(named), DOC)  # NAMED rows at most


def _page(terms: Terms, filters: Filters | None, limit: int) -> tuple[DataFrame, int | None]:
    """The best ``limit`` hits in order, and how many there are if that is known."""
    best = terms.top(filters, limit)
    if limit > NAMED:
        found, n = _all_hits(terms.index, best), None
    else:
        rows = best.collect()
        found, n = _named_hits(terms.index, rows, best.schema), len(rows)
    return terms.shown(found).orderBy(F.desc("score"), *DOC), n


def search(index: Index, query: str, filters: Filters | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The best ``limit`` blocks with snippets, in order; ranges are of literal matches within the snippet, or of words
    one edit away where it has none."""
    return _page(Terms.of(index, query), filters, limit)[0]


def summary(index: Index, query: str, filters: Filters | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One row: hits returned, blocks matched, and whether some were left out."""
    found = matches(index, query, filters).agg(F.count("*").alias("scanned"))
    return found.select(F.least(F.col("scanned"), F.lit(limit).cast("long")).alias("hits"), "scanned", (F.col("scanned") > limit).alias("truncated"))


def cold(blocks: DataFrame, query: str, filters: Filters | None = None) -> DataFrame:
    """Blocks of files not indexed yet: tokens found as substrings, ASCII case aside; score: how many."""
    low = T.ascii_lower(F.col("text"))
    words = [T.ascii_lower_text(w) for w in query_tokens(query)]
    score = sum((F.when(F.instr(low, F.lit(w)) > 0, 1).otherwise(0) for w in words), F.lit(0))
    allowed = blocks.filter(filters.condition()) if filters else blocks
    return allowed.withColumn("score", score.cast("double")).filter("score > 0")


def cold_hits(blocks: DataFrame, query: str, filters: Filters | None = None) -> DataFrame:
    """Cold matches as hits: what surrounds the earliest match, and the ranges of all matches in it."""
    words = [T.ascii_lower_text(w) for w in query_tokens(query)]
    found = cold(blocks, query, filters).withColumn("snippet", T.cold_snippet(F.col("text"), words))
    ranges = T.cold_ranges(F.col("snippet"), words)
    return found.select("session_path", "project", "ts_ms", "line_no", "block_no", "uuid", "source", "snippet", ranges.alias("match_ranges"), "score")


def unindexed(index: Index, corpus: str, home: str = "/") -> DataFrame:
    """The blocks of session files on disk that the index does not know, whatever their age."""
    spark = index.spark
    late = jsonl.list_sessions(spark, corpus).join(index.files().select("session_path"), "session_path", "left_anti")
    paths = [r["session_path"] for r in late.select("session_path").limit(NAMED + 1).collect()]
    if len(paths) <= NAMED:
        lines = jsonl.read_lines(spark, corpus, paths)
    else:
        lines = jsonl.read_lines(spark, corpus).join(late.select("session_path"), "session_path", "left_semi")
    return jsonl.search_blocks(lines).drop("project").join(jsonl.project_labels(lines, home).select("session_path", "project"), "session_path")


def tiers(index: Index, corpus: str, query: str, filters: Filters | None = None, limit: int | None = DEFAULT_LIMIT, home: str = "/") -> Iterator[DataFrame]:
    """Hits of indexed sessions, then of the others, as ``tier`` 0 and 1: the first can be shown before the second is looked for.

    Files not indexed yet are looked at only if the index leaves room: neither more matches than ``limit`` nor as
    many.  A block is a hit once.  With a limit each tier is in order; without one neither is, and nothing is gathered.
    """
    if not query_tokens(query):
        return
    n = 0
    if not index.empty:
        terms = Terms.of(index, query)
        if limit is None:
            warm = terms.shown(_all_hits(index, terms.matches(filters)))
        else:
            warm, n = _page(terms, filters, limit)
            n = warm.count() if n is None else n
        yield warm.withColumn("tier", F.lit(0))
    if limit is not None and n >= limit:
        return
    late = cold_hits(unindexed(index, corpus, home), query, filters)
    yield (late if limit is None else late.orderBy(F.desc("score"), *DOC).limit(limit - n)).withColumn("tier", F.lit(1))


def two_tier(index: Index, corpus: str, query: str, filters: Filters | None = None, limit: int | None = DEFAULT_LIMIT, home: str = "/") -> DataFrame:
    """Both ``tiers`` as one table, in order if there is a limit."""
    both = list(tiers(index, corpus, query, filters, limit, home))
    if not both:
        return index.spark.createDataFrame([], HITS)
    found = reduce(DataFrame.unionByName, both)
    return found if limit is None else found.orderBy("tier", F.desc("score"), *DOC)


HITS = "session_path string, project string, ts_ms long, line_no long, block_no long, uuid string, source string, snippet string, match_ranges array<struct<start: int, end: int>>, score double, tier int"
