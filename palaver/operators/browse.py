"""Listing pages: sessions joined with what is known of them, grouped hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import text as T

PATH = "session_path"


def browse_rows(stubs: DataFrame, enriched: DataFrame) -> DataFrame:
    """Stubs with their enrichment; cleaned sessions go, enrichment without stub is ignored."""
    known = enriched.withColumn("_known", F.lit(True))
    joined = stubs.join(known, PATH, "left").filter(~F.coalesce(F.col("cleaned"), F.lit(False)))
    return joined.select(PATH, "project", "mtime", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("line_count", F.lit(0).cast("long")).alias("line_count"), F.coalesce("_known", F.lit(False)).alias("enriched"))


def browse_page(sessions: DataFrame, n: int = 100, projects: list[str] | None = None) -> DataFrame:
    """The ``n`` most recent sessions."""
    own = sessions.filter(F.col("project").isin(projects)) if projects else sessions
    return own.orderBy(F.desc_nulls_last("mtime"), PATH).limit(n)


def browse_groups(page: DataFrame) -> DataFrame:
    """Projects in the order of their most recent session, with their sessions."""
    groups = page.groupBy("project").agg(F.max("mtime").alias("latest"), F.count("*").alias("n_sessions"), F.array_sort(F.collect_list(F.struct(F.col("mtime").isNull().alias("late"), (-F.col("mtime")).alias("at"), PATH))).alias("s"))
    return groups.select("project", "latest", "n_sessions", F.array_join(F.transform("s", lambda x: x[PATH]), ",").alias("sessions"))


def browse_cards(stubs: DataFrame, enriched: DataFrame) -> DataFrame:
    """Stubs as session rows with empty defaults until they are enriched, and their line of facts."""
    rows = stubs.join(enriched.withColumn("_known", F.lit(True)), PATH, "left").filter(~F.coalesce(F.col("cleaned"), F.lit(False)))
    known = F.coalesce(F.col("_known"), F.lit(False))
    dates = T.date_range(F.col("first_ms"), F.col("last_ms"))
    full = T.card_line(F.coalesce("user_count", F.lit(0)), F.coalesce("subagents", F.lit(0)), F.col("size"), dates, F.col("model"))
    return rows.select(PATH, "project", known.alias("enriched"), F.when(known, full).otherwise(T.stub_line(F.col("size"), F.col("mtime"))).alias("card"))


def project_hits(hits: DataFrame) -> DataFrame:
    """Projects of a page of ranked hits, in order of their best, each with its sessions in order of theirs.  Hits are (rank, project, session_path)."""
    sessions = hits.groupBy("project", PATH).agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
    groups = sessions.groupBy("project").agg(F.min("rank").alias("rank"), F.sum("n").alias("n_hits"), F.array_sort(F.collect_list(F.struct("rank", PATH))).alias("s"))
    return groups.select("project", "rank", "n_hits", F.array_join(F.transform("s", lambda x: x[PATH]), ",").alias("sessions"))


def grouped_hits(hits: DataFrame) -> DataFrame:
    """Sessions of hits, best first: rank of a session is that of its best hit.  ``hits`` is a page."""
    best = hits.groupBy("project", PATH).agg(F.max("score").alias("best"), F.count("*").alias("n_hits"))
    return best.withColumn("session_rank", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("best"), PATH)))


def hits_with_titles(hits: DataFrame, meta: DataFrame) -> DataFrame:
    """Hits with session titles; without one, the file name."""
    return hits.join(meta.select(PATH, "title"), PATH, "left").withColumn("title", F.coalesce("title", F.element_at(F.split(PATH, "/"), -1)))
