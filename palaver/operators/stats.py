"""Counts, first and last values and titles of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.sources import jsonl

PATH = "session_path"
RECENT_S = 900


def filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def first_of(c: str) -> Column:
    """First non-empty value in file order, or ''."""
    return F.coalesce(F.min_by(F.when(filled(c), F.col(c)), F.when(filled(c), F.col("line_no"))), F.lit(""))


def last_of(c: str) -> Column:
    return F.coalesce(F.max_by(F.when(filled(c), F.col(c)), F.when(filled(c), F.col("line_no"))), F.lit(""))


def session_stats(rows: DataFrame) -> DataFrame:
    """Line and role counts and time bounds of each session."""
    return rows.groupBy(PATH).agg(
        F.count("*").alias("line_count"), F.count_if(F.col("source") == "user").alias("user_count"),
        F.count_if(F.col("source") == "assistant").alias("assistant_count"),
        F.min_by("ts_ms", "line_no").alias("first_ts"), F.max_by("ts_ms", "line_no").alias("last_ts"),
    )


def models_first_seen(rows: DataFrame) -> DataFrame:
    """Distinct models of a session in the order they first appear, comma-joined."""
    seen = rows.filter(filled("model")).groupBy(PATH, "model").agg(F.min("line_no").alias("at"))
    return seen.groupBy(PATH).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "model"))), lambda s: s["model"]), ",").alias("models"))


def session_meta(rows: DataFrame, most: int = 80) -> DataFrame:
    """Title (first user text, cleaned), date and project of each session."""
    title = T.truncate(T.clean_title(F.min_by(F.when(F.col("source") == "user", F.col("text")), F.when(F.col("source") == "user", F.col("line_no")))), most)
    meta = rows.groupBy(PATH).agg(title.alias("title"), F.min_by("ts_ms", "line_no").alias("ts_ms"), F.min("project").alias("project"))
    day = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd")
    return meta.select(PATH, F.when(F.coalesce("title", F.lit("")) == "", "Untitled").otherwise(F.col("title")).alias("title"), day.alias("day"), "project")


def cleanup_candidates(sessions: DataFrame, now_s: int, recent_s: int = RECENT_S) -> DataFrame:
    """Sessions without turns and title that have rested long enough; an unknown age is never enough."""
    rested = F.greatest(F.lit(now_s) - F.col("mtime"), F.lit(0)) >= recent_s
    return sessions.filter((F.col("user_count") == 0) & (F.col("assistant_count") == 0) & (F.col("title") == "") & F.col("mtime").isNotNull() & rested)


def project_facet(sessions: DataFrame) -> DataFrame:
    """Sessions of each project, in order of the label."""
    return sessions.groupBy("project").agg(F.count("*").alias("n_sessions")).orderBy("project")


def _distinct(rows: DataFrame, column: str) -> DataFrame:
    """(session_path, column): the distinct non-empty values of a session, in the order they first appear."""
    seen = rows.filter(filled(column)).groupBy(PATH, column).agg(F.min("line_no").alias("at"))
    return seen.groupBy(PATH).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", column))), lambda s: s[column]).alias(column))


def scan(lines: DataFrame) -> DataFrame:
    """Statistics of sessions from their lines: counts, bounds, folder, title, models.

    Lines that do not parse, or hold a field of another type, count as lines only.
    """
    rows = jsonl.typed_lines(lines)
    out = rows.groupBy(PATH).agg(
        F.count("*").alias("line_count"), F.count_if(F.col("type") == "user").alias("user_count"), F.count_if(F.col("type") == "assistant").alias("assistant_count"),
        first_of("timestamp").alias("first_ts"), last_of("timestamp").alias("last_ts"), first_of("cwd").alias("cwd"), last_of("custom_title").alias("custom_title"),
    )
    empty = lines.select(PATH).distinct().join(out, PATH, "left").fillna(0).fillna("")
    models = _distinct(rows, "model").withColumnRenamed("model", "models")
    return empty.join(models, PATH, "left").withColumn("models", F.coalesce("models", F.array().cast("array<string>")))


def info(lines: DataFrame) -> DataFrame:
    """Header of a session in the editor: folder, branch, versions, models, mode, bounds and counts, blank lines aside.

    Each field counts where it is a string, whatever else its line holds.
    """
    rows = jsonl.entries(lines)
    counted = lines.groupBy(PATH).agg(F.count_if(jsonl.not_blank(F.col("line"))).alias("line_count"))
    out = rows.groupBy(PATH).agg(
        first_of("cwd").alias("cwd"), first_of("git_branch").alias("git_branch"),
        F.coalesce(F.max_by("permission_mode", F.when(F.col("permission_mode").isNotNull(), F.col("line_no"))), F.lit("")).alias("permission_mode"),
        first_of("timestamp").alias("first_ts"), last_of("timestamp").alias("last_ts"),
        F.count_if(F.col("type") == "user").alias("user_count"), F.count_if(F.col("type") == "assistant").alias("assistant_count"),
    )
    versions, models = _distinct(rows, "version").withColumnRenamed("version", "versions"), _distinct(rows, "any_model").withColumnRenamed("any_model", "models")
    both = counted.join(out, PATH, "left").join(versions, PATH, "left").join(models, PATH, "left")
    none = F.array().cast("array<string>")
    return both.fillna("").fillna(0).withColumn("versions", F.coalesce("versions", none)).withColumn("models", F.coalesce("models", none))


def custom_titles(lines: DataFrame) -> DataFrame:
    """(session_path, custom_title): the last title given, an empty one too."""
    given = jsonl.entries(lines).filter("custom_title is not null")
    return given.groupBy(PATH).agg(F.max_by("custom_title", "line_no").alias("custom_title"))


def _meta(rows: DataFrame, heard: Column) -> DataFrame:
    """Title, date and model of sessions: users' rows count until one with a time is passed; ``heard`` is a row's title."""
    user, some = F.col("type") == "user", F.coalesce("timestamp", F.lit("")) != ""
    until = F.min(F.when(user & some, F.col("line_no"))).over(Window.partitionBy(PATH))
    seen = rows.withColumn("_heard", heard).withColumn("_until", until)
    near = user & (F.col("line_no") <= F.coalesce("_until", F.col("line_no"))) & (F.coalesce("_heard", F.lit("")) != "")
    found = seen.groupBy(PATH).agg(
        F.min_by(F.when(near, F.col("_heard")), F.when(near, F.col("line_no"))).alias("raw"),
        F.coalesce(F.min_by(F.when(user & some, F.col("timestamp")), F.when(user & some, F.col("line_no"))), F.lit("")).alias("date"),
        F.coalesce(F.min_by(F.when(filled("model"), F.col("model")), F.when(filled("model"), F.col("line_no"))), F.lit("")).alias("model"),
    )
    title = T.squeeze(T.truncate(T.clean_title(F.coalesce("raw", F.lit("")))))
    return found.select(PATH, F.when(title == "", "Untitled").otherwise(title).alias("title"), "date", "model")


def preview_meta(lines: DataFrame) -> DataFrame:
    """(session_path, title, date, model) from the first lines: a user's string that is no echo, or the text that an array begins with."""
    rows = jsonl.entries(jsonl.preview(lines))
    first = F.when(F.try_variant_get("v", "$.message.content[0].type", "string") == "text", F.try_variant_get("v", "$.message.content[0].text", "string"))
    heard = F.when(F.col("content_kind") == "STRING", F.when(~jsonl.echo(F.col("said")), F.col("said"))).when(F.col("content_kind").startswith("ARRAY"), first)
    return lines.select(PATH).distinct().join(_meta(rows, heard), PATH, "left").fillna({"title": "Untitled", "date": "", "model": ""})


def entry_meta(lines: DataFrame) -> DataFrame:
    """The same from whole sessions as a reader sees them: the first text of an entry, of whatever place, that is no echo."""
    rows = jsonl.view_entries(lines)
    parts = F.from_json(F.to_json(F.try_variant_get("v", "$.message.content", "variant")), "array<variant>")
    texts = F.transform(F.filter(parts, lambda p: F.try_variant_get(p, "$.type", "string") == "text"), lambda p: F.try_variant_get(p, "$.text", "string"))
    said = F.when(F.col("is_interruption"), F.lit(jsonl.INTERRUPTED)).otherwise(F.col("said"))
    text = F.when(F.col("is_notice"), None).when(F.col("content_kind") == "STRING", said).when(F.col("content_kind").startswith("ARRAY"), F.get(texts, 0))
    return lines.select(PATH).distinct().join(_meta(rows, F.when(~jsonl.echo(text), text)), PATH, "left").fillna({"title": "Untitled", "date": "", "model": ""})


def shown_titles(lines: DataFrame, renamed: DataFrame | None = None) -> DataFrame:
    """(session_path, title) as a list shows them: renamed just now, else the last title given, else from the preview."""
    own = preview_meta(lines).select(PATH, F.col("title").alias("derived")).join(custom_titles(lines), PATH, "left")
    own = own.join(renamed.select(PATH, F.col("title").alias("renamed")), PATH, "left") if renamed is not None else own.withColumn("renamed", F.lit(None).cast("string"))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return own.select(PATH, F.coalesce(some("renamed"), some("custom_title"), F.col("derived")).alias("title"))


def enrichment(lines: DataFrame, listing: DataFrame, now_s: int) -> DataFrame:
    """What a scan adds to each listed session, newest first, ages unknown last; ``cleaned`` marks those that may go."""
    found = scan(lines).join(listing.select(PATH, "mtime", "size"), PATH)
    rested = F.greatest(F.lit(now_s) - F.col("mtime"), F.lit(0)) >= RECENT_S
    cleaned = (F.col("user_count") == 0) & (F.col("assistant_count") == 0) & (F.col("custom_title") == "") & F.col("mtime").isNotNull() & rested
    return found.withColumn("cleaned", F.coalesce(cleaned, F.lit(False))).orderBy(F.desc_nulls_last("mtime"), PATH)


def enrichment_summary(enriched: DataFrame) -> DataFrame:
    """One row: sessions enriched and cleaned."""
    return enriched.agg(F.count_if(~F.col("cleaned")).alias("enriched"), F.count_if("cleaned").alias("cleaned"))
