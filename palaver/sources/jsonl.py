"""Session files: listing, lines, and the blocks inside entries.

``root/<project>/<session>.jsonl``.  Listing reads no contents; lines keep their
physical number; malformed lines are kept as lines and give no entries.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.sources.store import Store

# Entry types without conversation, and prefixes of echoes of commands.
META_TYPES = [
    "mode",
    "permission-mode",
    "ai-title",
    "file-history-snapshot",
    "last-prompt",
    "queue-operation",
    "attachment",
    "bridge-session",
    "skill-listing",
    "deferred-tools-delta",
    "system",
]
ECHOES = [
    "<command-name>",
    "<local-command-stdout>",
    "<command-message>",
    "<command-args>",
    "<local-command-caveat>",
    "<system-reminder>",
    "<teammate-message",
    "<task-notification>",
]
INTERRUPTED = "[Request interrupted by user]"
NOTICE = "<task-notification>"
SPECIAL = ["subagents", "tool-results"]
#: Where sessions lie below a configuration folder, and the folder below a home.
PROJECTS, CONFIG = "projects", ".claude"
PREVIEW = 50
#: Files of more bytes are read in ranges; of those at most NAMED are named to the reader one by one.
RANGE_BYTES, NAMED = 256 << 20, 10_000
LISTING = "session_path string, project string, mtime long, size long"
LINES = "session_path string, project string, line_no long, line string"


def corpus_root(spark: SparkSession, override: str | None = None, home: str | None = None) -> str | None:
    """The folder of projects: below ``override`` (or CLAUDE_CONFIG_DIR) if it is there, else below the home; None without either."""
    override = os.environ.get("CLAUDE_CONFIG_DIR") if override is None else override
    if override and Store(spark, f"{override}/{PROJECTS}").exists():
        return f"{override}/{PROJECTS}"
    own = f"{home or os.path.expanduser('~')}/{CONFIG}/{PROJECTS}"
    return own if Store(spark, own).exists() else None


def _files(spark: SparkSession, root: str, paths: list[str] | None) -> DataFrame | None:
    """Binary files of the sessions; None if there are none to read."""
    reader = spark.read.format("binaryFile")
    if paths is not None:
        return reader.load(paths) if paths else None
    return reader.option("pathGlobFilter", "*.jsonl").load(f"{root}/*/") if Store(spark, root).matches("*") else None


def _session(files: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    own = files.withColumn("project", F.element_at(parts, -2)).withColumn("name", F.element_at(parts, -1))
    return own.filter(F.col("name").endswith(".jsonl") & ~F.col("name").startswith("agent-") & ~F.col("project").isin(SPECIAL))


def list_sessions(spark: SparkSession, root: str) -> DataFrame:
    """(session_path, project, mtime, size) of the session files, without reading them."""
    files = _files(spark, root, None)
    if files is None:
        return spark.createDataFrame([], LISTING)
    return _session(files).select(F.col("path").alias("session_path"), "project", F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"))


def count_subagents(spark: SparkSession, root: str, stubs: DataFrame) -> DataFrame:
    """``stubs`` with the number of agent files beside each."""
    if not Store(spark, root).matches("*/subagents"):
        return stubs.withColumn("subagents", F.lit(0).cast("long"))
    agents = spark.read.format("binaryFile").option("pathGlobFilter", "agent-*.jsonl").load(f"{root}/*/subagents/")
    counts = agents.select(F.element_at(F.split("path", "/"), -3).alias("project")).groupBy("project").agg(F.count("*").alias("subagents"))
    return stubs.join(counts, "project", "left").withColumn("subagents", F.coalesce("subagents", F.lit(0)))


def read_session(spark: SparkSession, path: str) -> str:
    """The whole text of one session; an error if it is not UTF-8."""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    return bytes(row["content"]).decode()


def read_lines(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """(session_path, project, line_no, line) of all physical lines, of ``paths`` only if given; files that are not UTF-8 are skipped.

    Files of more than RANGE_BYTES are read in byte ranges, by as many tasks; smaller ones are a row each.
    """
    files = _files(spark, root, paths)
    if files is None:
        return spark.createDataFrame([], LINES)
    large = [r["path"] for r in _session(files.filter(F.col("length") > RANGE_BYTES)).select("path").limit(NAMED + 1).collect()]
    small = _whole(files.filter(F.col("length") <= RANGE_BYTES))
    if not large:
        return small
    return small.unionByName(_ranged(spark, root, large if len(large) <= NAMED else None))


def _ranged(spark: SparkSession, root: str, paths: list[str] | None) -> DataFrame:
    """The lines of large files by ranges, ``paths`` or all below the root.

    A range numbers the lines that begin in it; what the ranges before hold comes from a first pass that counts.
    Spark's reader leaves out a mark of byte order and what follows the last line break; the bytes tell where.
    """
    reader = spark.read.format("text").option("lineSep", "\n")
    text = reader.load(paths) if paths is not None else reader.option("pathGlobFilter", "*.jsonl").load(f"{root}/*/")
    text = text.filter(F.col("_metadata.file_size") > RANGE_BYTES)
    path = F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "^file:///", "file:/")
    found = _session(text.select(path.alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("line")))
    size = (F.octet_length("line") + 1).cast("long")
    counts = found.groupBy("path", "project", "start", "size").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.every(F.is_valid_utf8("line")).alias("valid"))
    whole = Window.partitionBy("path")
    before = whole.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.select(
        "path", "project", "start", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("lines"),
        F.sum("bytes").over(whole).alias("bytes"), F.every("valid").over(whole).alias("valid"), (F.row_number().over(whole.orderBy("start")) == 1).alias("first"),
    ).filter("valid")
    # with the break after each line the bytes are those of the file, one more if it does not end with one, three fewer if it begins with a mark
    marked = F.col("size") - F.col("bytes") >= 2
    at = F.row_number().over(Window.partitionBy("path", "start").orderBy("id")) - 1
    numbered = found.select("path", "start", "line", F.monotonically_increasing_id().alias("id")).withColumn("at", at).join(ranges, ["path", "start"])
    line = F.when(marked & (F.col("before") + F.col("at") == 0), F.concat(F.lit("\ufeff"), "line")).otherwise(F.col("line"))
    lines = numbered.select(F.col("path").alias("session_path"), "project", (F.col("before") + F.col("at")).cast("long").alias("line_no"), line.alias("line"))
    ended = ranges.filter(F.col("first") & ((F.col("size") == F.col("bytes")) | (F.col("size") == F.col("bytes") + 3)))
    return lines.unionByName(ended.select(F.col("path").alias("session_path"), "project", F.col("lines").cast("long").alias("line_no"), F.lit("").alias("line")))


def _whole(files: DataFrame) -> DataFrame:
    """The lines of files, each read as one row."""
    text = _session(files).select(F.col("path").alias("session_path"), "project", F.col("content").cast("string").alias("text"))
    lines = text.filter(F.is_valid_utf8("text")).select("session_path", "project", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.withColumn("line_no", F.col("line_no").cast("long"))


def not_blank(line: Column) -> Column:
    """Whether a line counts for extraction and for the editor's header."""
    return T.squeeze(line) != ""


def stat_lines(lines: DataFrame) -> DataFrame:
    """The lines that statistics count: those not empty, blanks counted, a carriage return at the end taken off."""
    return lines.withColumn("line", F.regexp_replace("line", "\r$", "")).filter("line <> ''")


def preview(lines: DataFrame, most: int = PREVIEW) -> DataFrame:
    """The first physical lines of each session, blank ones too."""
    return lines.filter(F.col("line_no") < most)


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def _text(path: str) -> Column:
    """A field's value if it is a string."""
    return F.when(F.schema_of_variant(F.try_variant_get("v", path, "variant")) == "STRING", _get(path))


def variant(line: Column) -> Column:
    """A line's JSON value; null if it does not parse.  Of keys that an object repeats at its top the last value counts."""
    pairs = F.map_entries(F.from_json(line, "map<string, variant>"))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda x: x["key"] == e["key"]))
    repeated = F.size(F.array_distinct(F.json_object_keys(line))) < F.size(F.json_object_keys(line))
    return F.coalesce(F.try_parse_json(line), F.when(repeated, F.to_variant_object(F.map_from_entries(last))))


def parse(lines: DataFrame) -> DataFrame:
    """Lines that are JSON objects, with ``v``.  Of objects that repeat a key at the top the last value counts."""
    known = lines.filter(not_blank(F.col("line")))
    return known.withColumn("v", variant(F.col("line"))).filter("v is not null").filter(F.schema_of_variant("v").startswith("OBJECT"))


def entries(lines: DataFrame) -> DataFrame:
    """Lines that are JSON objects, with their scalar fields and ``v``."""
    parsed = parse(lines)
    kind = F.coalesce(_text("$.type"), F.lit(""))
    return parsed.select(
        "session_path", "project", "line_no", "line", "v", kind.alias("type"), F.coalesce(_text("$.uuid"), F.lit("")).alias("uuid"),
        _text("$.parentUuid").alias("parent_uuid"), _text("$.requestId").alias("request_id"), _text("$.timestamp").alias("timestamp"),
        T.ts_millis(_text("$.timestamp")).alias("ts_ms"), F.coalesce(_get("$.isSidechain", "boolean"), F.lit(False)).alias("is_sidechain"),
        F.to_json(_get("$.toolUseResult", "variant")).alias("tool_use_result"),
        _text("$.cwd").alias("cwd"), _text("$.gitBranch").alias("git_branch"), _text("$.version").alias("version"), _text("$.sessionId").alias("session_id"),
        F.when(kind == "permission-mode", _text("$.permissionMode")).alias("permission_mode"), F.when(kind == "custom-title", _text("$.customTitle")).alias("custom_title"),
        _text("$.message.model").alias("any_model"), F.when(kind == "assistant", _text("$.message.model")).alias("model"),
        F.coalesce(F.schema_of_variant(_get("$.message.content", "variant")), F.lit("")).alias("content_kind"),
        F.when(F.schema_of_variant(_get("$.message.content", "variant")) == "STRING", _get("$.message.content")).alias("said"),
    )


def typed_lines(lines: DataFrame) -> DataFrame:
    """What statistics see of each counted line: strings, '' where absent; ``known`` is false for lines that do not
    parse or hold a field of another type, of which nothing but the line itself counts."""
    own = stat_lines(lines).withColumn("v", variant(F.col("line")))
    fields = {"type": "$.type", "timestamp": "$.timestamp", "cwd": "$.cwd", "custom_title": "$.customTitle", "model": "$.message.model"}
    fits = F.schema_of_variant("v").startswith("OBJECT")
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    for path in fields.values():
        fits &= F.coalesce(kind(path) == "STRING", F.lit(True))
    fits &= F.coalesce(kind("$.message").startswith("OBJECT"), F.lit(True))
    known = F.coalesce(fits, F.lit(False))
    return own.select("session_path", "project", "line_no", known.alias("known"), *[F.when(known, F.coalesce(_get(path), F.lit(""))).otherwise("").alias(name) for name, path in fields.items()])


def echo(text: Column) -> Column:
    return text.rlike("^(?:" + "|".join(ECHOES) + ")")


def content_blocks(found: DataFrame) -> DataFrame:
    """The blocks of array contents, one to one: content_no, kind and fields."""
    arrays = found.filter(F.col("content_kind").startswith("ARRAY"))
    parts = F.from_json(F.to_json(_get("$.message.content", "variant")), "array<variant>")
    raw = arrays.select("session_path", "project", "line_no", "type", "uuid", "ts_ms", F.posexplode(parts).alias("content_no", "b")).withColumn("content_no", F.col("content_no").cast("long"))
    get = lambda path, of="b": F.when(F.schema_of_variant(F.try_variant_get(of, path, "variant")) == "STRING", F.try_variant_get(of, path, "string"))
    kind = F.coalesce(get("$.type"), F.lit(""))
    known = kind.isin("text", "thinking", "tool_use", "tool_result")
    shape = F.coalesce(F.schema_of_variant(F.try_variant_get("b", "$.content", "variant")), F.lit(""))
    # of a result's parts those that are texts count, whatever else the list holds
    parts = F.when(shape.startswith("ARRAY"), F.try_variant_get("b", "$.content", "array<variant>"))
    texts = F.transform(F.filter(parts, lambda p: get("$.type", p) == "text"), lambda p: get("$.text", p))
    joined = F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n")
    some = lambda path: F.coalesce(get(path), F.lit(""))
    return raw.select(
        "session_path", "project", "line_no", "type", "uuid", "ts_ms", "content_no", F.when(known, kind).otherwise("unknown").alias("kind"), kind.alias("raw_type"),
        F.when(kind == "text", some("$.text")).when(kind == "thinking", some("$.thinking")).when(kind == "tool_result", F.when(shape == "STRING", get("$.content")).otherwise(F.coalesce(joined, F.lit("")))).alias("text"),
        F.when(kind == "tool_use", F.coalesce(F.nullif(get("$.name"), F.lit("")), F.lit("unknown"))).alias("tool_name"),
        F.when(kind == "tool_use", some("$.id")).when(kind == "tool_result", some("$.tool_use_id")).alias("tool_id"),
        F.when(kind == "tool_use", F.to_json(F.try_variant_get("b", "$.input", "variant"))).alias("tool_input"),
        F.coalesce(F.try_variant_get("b", "$.is_error", "boolean"), F.lit(False)).alias("is_error"),
    )


def _heads(found: DataFrame) -> Column:
    """Whether a user's content begins with an echo: the string itself, or the first element of an array if it is a text."""
    first = F.when(F.try_variant_get("v", "$.message.content[0].type", "string") == "text", F.try_variant_get("v", "$.message.content[0].text", "string"))
    lead = F.when(F.col("content_kind") == "STRING", F.col("said")).when(F.col("content_kind").startswith("ARRAY"), first)
    return (F.col("type") == "user") & F.coalesce(echo(lead), F.lit(False))


def view_entries(lines: DataFrame) -> DataFrame:
    """The entries a reader sees: no meta types and no echoes; task notifications stay, marked ``is_notice`` and without
    blocks; ``is_interruption``; ``has_user_text`` and ``has_blocks``, whether there is anything to show."""
    found = entries(lines).filter(~F.col("type").isin(META_TYPES))
    notice = F.coalesce((F.col("type") == "user") & F.col("said").startswith(NOTICE), F.lit(False))
    found = found.filter(notice | ~_heads(found)).withColumn("is_notice", notice)
    user, array = F.col("type") == "user", F.col("content_kind").startswith("ARRAY")
    parts = F.from_json(F.to_json(_get("$.message.content", "variant")), "array<variant>")
    kinds = F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.type", "string"), F.lit("")))
    talk = F.when(F.col("content_kind") == "STRING", T.squeeze("said") != "").when(array, F.exists(kinds, lambda k: k != "tool_result")).otherwise(False)
    size = F.when(~notice & user & (F.col("content_kind") == "STRING"), 1).when(F.col("type").isin("user", "assistant") & array, F.size(parts)).otherwise(0)
    texts = F.when(user & (F.col("content_kind") == "STRING"), True).when(array, F.exists(kinds, lambda k: k == "text")).otherwise(False)
    return (
        found.withColumn("is_interruption", F.coalesce(user & ~notice & F.col("said").contains(INTERRUPTED), F.lit(False)))
        .withColumn("has_user_text", F.coalesce(talk, F.lit(False))).withColumn("n_blocks", size)
        .withColumn("has_blocks", F.col("n_blocks") > 0).withColumn("has_text", F.coalesce(texts & (F.col("n_blocks") > 0), F.lit(False)))
    )


def search_blocks(lines: DataFrame) -> DataFrame:
    """The searchable text blocks: a user's string, and the text parts of user and assistant arrays."""
    found = entries(lines).filter(F.col("type").isin("user", "assistant"))
    found = found.filter(~_heads(found))
    strings = found.filter((F.col("type") == "user") & (F.col("content_kind") == "STRING"))
    text = F.when(F.col("said").contains(INTERRUPTED), F.lit(INTERRUPTED)).otherwise(F.col("said"))
    one = strings.select("session_path", "project", "line_no", F.lit(0).cast("long").alias("block_no"), "ts_ms", "uuid", F.col("type").alias("source"), text.alias("text"))
    texts = content_blocks(found).filter("kind = 'text'")
    number = F.row_number().over(Window.partitionBy("session_path", "line_no").orderBy("content_no")) - 1
    many = texts.withColumn("block_no", number.cast("long")).select("session_path", "project", "line_no", "block_no", "ts_ms", "uuid", F.col("type").alias("source"), "text")
    return one.unionByName(many).filter(not_blank(F.coalesce("text", F.lit(""))))


def first_cwd(lines: DataFrame) -> DataFrame:
    """(session_path, cwd): the first non-empty ``"cwd":"…"`` in the raw text; '' if there is none."""
    raw = F.regexp_extract("line", '"cwd":"([^"]*)"', 1)
    found = lines.groupBy("session_path").agg(F.min_by(F.when(raw != "", raw), F.when(raw != "", F.col("line_no"))).alias("cwd"))
    return found.withColumn("cwd", F.coalesce("cwd", F.lit("")))


def project_labels(lines: DataFrame, home: str) -> DataFrame:
    """(session_path, project, project_display): labels by working folder; without one the raw folder's name in the
    index, and its readable end on display."""
    cwd = first_cwd(lines).join(lines.select("session_path", "project").distinct(), "session_path")
    return cwd.select("session_path", T.project_label(F.col("cwd"), F.col("project"), home).alias("project"), T.project_label(F.col("cwd"), T.decode_project(F.col("project")), home).alias("project_display"))
