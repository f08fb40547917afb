"""What leaves the engine: backups, static pages, results as a stream of rows."""

from __future__ import annotations

import html
import re
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from palaver.sources.store import Store

STYLE = "body{font-family:sans-serif;max-width:50em;margin:auto}.user{background:#eef}.turn{padding:.5em;margin:.5em 0}"


def clean_name(s: str) -> str:
    """ASCII letters and digits in small letters, the rest as single underscores between them."""
    return re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_").lower()


def file_name(project: str, title: str) -> str:
    return f"{clean_name(project or 'project')}_{clean_name(title or 'session')}.html"


def slot_name(relative: str) -> str:
    """A session's backup folder: letters and digits of any script, all else as underscores."""
    return "".join(c if c.isalnum() else "_" for c in relative)


def page(title: str, turns: list[tuple[str, str]]) -> str:
    """A static page of one session's turns (role, text)."""
    body = "".join(f'<div class="turn {html.escape(role)}"><b>{html.escape(role)}</b><pre>{html.escape(text)}</pre></div>' for role, text in turns)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{STYLE}</style></head><body>{body}</body></html>"


def _slot(corpus: str, path: str) -> str:
    """The name of a session's backup folder; the session must lie below ``corpus``."""
    own, root = (re.sub("^file:/+", "/", p.rstrip("/")) for p in (path, corpus))
    if not own.startswith(root + "/") or ".." in own.split("/"):
        raise ValueError(f"{path} is not below {corpus}")
    return slot_name(own.removeprefix(root + "/"))


def backup(spark: SparkSession, corpus: str, backups: str, path: str) -> str:
    """Copy a session below ``corpus`` to its single backup slot; the new path."""
    store, slot = Store(spark, backups), _slot(corpus, path)
    store.delete(slot)
    name = f"{slot}/v001-{int(time.time())}.jsonl"
    store.copy(path, name)
    return f"{store.root}/{name}"


def list_backups(spark: SparkSession, corpus: str, backups: str, path: str) -> DataFrame:
    """(version, timestamp, path, size) of a session's backups, newest first."""
    store, slot = Store(spark, backups), _slot(corpus, path)
    rows = [(f"{store.root}/{slot}/{name}", name, size) for name, size in store.names(slot)]
    found = spark.createDataFrame(rows, "path string, name string, size long")
    at = r"^v(\d+)-(\d+)\.jsonl$"
    own = found.filter(F.col("name").rlike(at)).select(F.regexp_extract("name", at, 1).cast("int").alias("version"), F.regexp_extract("name", at, 2).cast("long").alias("timestamp"), "path", "size")
    return own.orderBy(F.desc("timestamp"))


def export_pages(sessions: DataFrame, *more: str) -> DataFrame:
    """(file_name, html) of sessions (project, title, turns: array of role and text), a page each; with the columns ``more``."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    clean = lambda c, other: F.lower(F.regexp_replace(F.regexp_replace(F.when(F.coalesce(c, F.lit("")) == "", other).otherwise(c), "[^A-Za-z0-9]+", "_"), "^_|_$", ""))
    quoted = lambda c: F.replace(F.replace(safe(c), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    one = lambda t: F.concat(F.lit('<div class="turn '), quoted(t["role"]), F.lit('"><b>'), quoted(t["role"]), F.lit("</b><pre>"), safe(t["text"]), F.lit("</pre></div>"))
    body = F.array_join(F.transform("turns", one), "")
    page_ = F.concat(F.lit("<!DOCTYPE html><html><head><meta charset='utf-8'><title>"), safe(F.col("title")), F.lit(f"</title><style>{STYLE}</style></head><body>"), body, F.lit("</body></html>"))
    return sessions.select(*more, F.concat(clean(F.col("project"), "project"), F.lit("_"), clean(F.col("title"), "session"), F.lit(".html")).alias("file_name"), page_.alias("html"))


def stream(hits: DataFrame) -> Iterator[Row]:
    """Rows as they come, a partition at a time; cancel with the session's job tags."""
    return hits.toLocalIterator(prefetchPartitions=True)
