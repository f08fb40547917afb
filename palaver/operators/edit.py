"""Edits of sessions as dataset operations: deletion with cascade, forks, renames, text edits."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.operators import export, index, sequence
from palaver.sources.store import Store

BLOCK = ["session_path", "line_no", "content_no"]


def tool_pairs(blocks: DataFrame) -> DataFrame:
    """Blocks (…, tool_id, kind) with their partners: same id, other kind, same session."""
    own = blocks.filter((F.coalesce("tool_id", F.lit("")) != "") & F.col("kind").isin("tool_use", "tool_result"))
    other = own.select("session_path", "tool_id", F.col("kind").alias("partner_kind"), F.col("line_no").alias("partner_line"), F.col("content_no").alias("partner_no"))
    return own.join(other, ["session_path", "tool_id"]).filter(F.col("kind") != F.col("partner_kind"))


def cascade(deleted: DataFrame, blocks: DataFrame) -> DataFrame:
    """Deleted blocks and, one step away, the other halves of their tool calls."""
    pairs = tool_pairs(blocks).join(deleted.select(*BLOCK).distinct(), BLOCK, "left_semi")
    partners = pairs.select("session_path", F.col("partner_line").alias("line_no"), F.col("partner_no").alias("content_no"))
    return deleted.select(*BLOCK).union(partners).distinct()


def apply_deletions(blocks: DataFrame, deleted: DataFrame) -> DataFrame:
    """What becomes of each row: untouched, rebuilt without some blocks, or dropped."""
    gone = deleted.select(*BLOCK).distinct().withColumn("_gone", F.lit(1))
    counts = blocks.join(gone, BLOCK, "left").groupBy("session_path", "line_no").agg(F.count("*").alias("n_blocks"), F.coalesce(F.sum("_gone"), F.lit(0)).alias("n_deleted"))
    fate = F.when(F.col("n_deleted") == 0, "verbatim").when(F.col("n_deleted") == F.col("n_blocks"), "dropped").otherwise("rebuilt")
    return counts.withColumn("fate", fate)


def changes(blocks: DataFrame, deleted: DataFrame, edited: DataFrame) -> DataFrame:
    """Of each session: edited rows and deleted blocks, whether anything changed, whether nothing is left."""
    gone = deleted.select(*BLOCK).distinct().withColumn("_gone", F.lit(True))
    rows = edited.select("session_path", "line_no").distinct().groupBy("session_path").agg(F.count("*").alias("n_edited"))
    own = blocks.join(gone, BLOCK, "left").groupBy("session_path").agg(F.count("_gone").alias("n_deleted"), F.bool_and(F.col("_gone").isNotNull()).alias("all_deleted"))
    both = own.join(rows, "session_path", "left").withColumn("n_edited", F.coalesce("n_edited", F.lit(0)))
    total = F.col("n_edited") + F.col("n_deleted")
    return both.select("session_path", total.alias("n_changes"), (total > 0).alias("dirty"), "all_deleted")


def draft_lines(lines: DataFrame) -> DataFrame:
    """The rows of a draft: physical lines but the empty one after the last line feed, blank ones aside."""
    return lines.filter(T.squeeze(F.col("line")) != "")


def build_draft(lines: DataFrame) -> DataFrame:
    """Rows (session_path, line_no, line, row_key, uuid, type) of sessions, their lines untouched."""
    own = draft_lines(lines).select("session_path", "line_no", "line")
    known = own.withColumn("v", F.try_parse_json("line"))
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get("v", path, "variant")) == "STRING", F.try_variant_get("v", path, "string"))
    rows = known.select("session_path", "line_no", "line", text("$.uuid").alias("uuid"), F.coalesce(text("$.type"), F.lit("")).alias("type"))
    return sequence.row_keys(rows).select("session_path", "line_no", "line", "row_key", "uuid", "type")


def unit_blocks(units: DataFrame, blocks: DataFrame) -> DataFrame:
    """All blocks of the rows of chosen units (session_path, line_no), those of unknown kinds too."""
    return blocks.select(*BLOCK).join(units.select("session_path", "line_no").distinct(), ["session_path", "line_no"], "left_semi")


def set_deleted(deleted: DataFrame, chosen: DataFrame, gone: bool = True) -> DataFrame:
    """The deleted blocks with ``chosen`` added, or taken out."""
    if gone:
        return deleted.select(*BLOCK).union(chosen.select(*BLOCK)).distinct()
    return deleted.select(*BLOCK).join(chosen.select(*BLOCK), BLOCK, "left_anti")


def delete_blocks(deleted: DataFrame, chosen: DataFrame) -> DataFrame:
    """Delete texts or thinking, which have no partners."""
    return set_deleted(deleted, chosen)


def delete_units(deleted: DataFrame, chosen: DataFrame, blocks: DataFrame) -> DataFrame:
    """Delete blocks of tool groups, turns or selections, and the other halves of their tool calls."""
    return set_deleted(deleted, cascade(chosen, blocks))


def undelete(deleted: DataFrame, chosen: DataFrame, blocks: DataFrame) -> DataFrame:
    """Restore blocks and the other halves of their tool calls."""
    return set_deleted(deleted, cascade(chosen, blocks), False)


def all_deleted(units: DataFrame, blocks: DataFrame, deleted: DataFrame) -> DataFrame:
    """(session_path, unit, all_deleted) of units (session_path, unit, line_no): whether each has blocks and none is left."""
    gone = deleted.select(*BLOCK).distinct().withColumn("_gone", F.lit(True))
    own = units.select("session_path", "unit", "line_no").distinct().join(blocks.select(*BLOCK), ["session_path", "line_no"], "left").join(gone, BLOCK, "left")
    full = F.count("content_no") == F.count("_gone")
    return own.groupBy("session_path", "unit").agg(((F.count("content_no") > 0) & full).alias("all_deleted"))


def _rewrite(rows: DataFrame, change: Callable[[str, list], str | None], extra: str) -> DataFrame:
    """``rows`` (session_path, line_no, line, extra) with changed lines; those of which nothing is left go."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != extra)
    names = [c for c in rows.columns if c != extra]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            line = b.column(b.schema.get_field_index("line")).to_pylist()
            own = b.column(b.schema.get_field_index(extra)).to_pylist()
            new = [change(x, e) if e else x for x, e in zip(line, own, strict=True)]
            kept = pa.array([x is not None for x in new])
            columns = [pa.array(new, pa.string()) if c == "line" else b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(kept)

    return rows.mapInArrow(apply, kinds)


def edit_texts(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``rows`` with the texts of ``edits`` (session_path, line_no, text_no, text) put in; all other bytes stay.
    What does not fit a line leaves it as it is."""
    each = edits.groupBy("session_path", "line_no").agg(F.array_sort(F.collect_list(F.struct("text_no", "text"))).alias("_edits"))

    def change(line: str, own: list) -> str:
        for e in own:
            line = edit_text(line, e["text_no"], e["text"])
        return line

    return _rewrite(rows.join(each, ["session_path", "line_no"], "left"), change, "_edits")


def serialize(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """``rows`` as they are saved: without deleted blocks; rows of which all blocks are deleted go, others stay byte for byte."""
    each = deleted.groupBy("session_path", "line_no").agg(F.array_sort(F.collect_set("content_no")).alias("_gone"))
    return _rewrite(rows.join(each, ["session_path", "line_no"], "left"), lambda line, own: drop_blocks(line, set(own)), "_gone")


def dirty_sessions(rows: DataFrame, original: DataFrame, deleted: DataFrame) -> DataFrame:
    """(session_path, n_changes, dirty): rows whose line differs from the original's, and deleted blocks."""
    was = original.select("session_path", "line_no", F.col("line").alias("_was"))
    edited = rows.join(was, ["session_path", "line_no"]).groupBy("session_path").agg(F.count_if(F.col("line") != F.col("_was")).alias("e"))
    gone = deleted.select(*BLOCK).distinct().groupBy("session_path").agg(F.count("*").alias("d"))
    total = F.coalesce("e", F.lit(0)) + F.coalesce("d", F.lit(0))
    return edited.join(gone, "session_path", "left").select("session_path", total.alias("n_changes"), (total > 0).alias("dirty"))


def session_text(rows: DataFrame) -> DataFrame:
    """(session_path, text): the rows of each session joined, with a line feed after each.  A session is one file, so one row."""
    ordered = rows.groupBy("session_path").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return ordered.select("session_path", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def write_session(spark: SparkSession, corpus: str, root: str | None, path: str, text: str, home: str = "/") -> None:
    """Overwrite a session in one step and, with an index, refresh it at once."""
    folder, _, name = path.rpartition("/")
    Store(spark, folder).write(name, text)
    if root:
        index.index_file(spark, corpus, root, path, home)


def save(spark: SparkSession, corpus: str, backups: str, root: str | None, path: str, rows: DataFrame, deleted: DataFrame, home: str = "/") -> str:
    """Back the session up, write the draft's ``rows`` without ``deleted``, refresh the index; the backup's path."""
    own = session_text(serialize(rows, deleted)).filter(F.col("session_path") == path).first()
    kept = export.backup(spark, corpus, backups, path)
    write_session(spark, corpus, root, path, own["text"] if own else "\n", home)
    return kept


def save_copy(spark: SparkSession, corpus: str, root: str | None, path: str, rows: DataFrame, deleted: DataFrame, home: str = "/") -> str:
    """The draft as a new session beside the old one; its path."""
    own = session_text(serialize(rows, deleted)).filter(F.col("session_path") == path).first()
    new = f"{path.removesuffix('.jsonl')}-edited-{int(time.time())}.jsonl"
    write_session(spark, corpus, root, new, own["text"] if own else "\n", home)
    return new


def discard(original: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A fresh draft's rows, and no deletions."""
    rows = build_draft(original)
    return rows, rows.sparkSession.createDataFrame([], "session_path string, line_no long, content_no long")


def session_uuid(path: Column, seed: str) -> Column:
    """A version 4 identifier for each session, the same for all its lines."""
    drawn = F.sha2(F.concat_ws("|", path, F.lit(seed)), 256)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.ascii(F.substring(drawn, 17, 1)) % 4) + 1)
    return F.concat_ws("-", F.substring(drawn, 1, 8), F.substring(drawn, 9, 4), F.concat(F.lit("4"), F.substring(drawn, 14, 3)), F.concat(variant, F.substring(drawn, 18, 3)), F.substring(drawn, 21, 12))


def fork(lines: DataFrame, upto: int, new_id: str | None = None, strict: bool = True) -> DataFrame:
    """Lines 0 to ``upto`` with the first sessionId value of each replaced, by a new one for each session if none is given.

    A session of no such line fails the query; unless ``strict`` it is forked after its last line.
    """
    last = Window.partitionBy("session_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = lines.withColumn("_last", F.max("line_no").over(last)).withColumn("_tail", F.last("line").over(last))
    own = own.withColumn("_last", F.when(F.col("_tail") == "", F.col("_last") - 1).otherwise(F.col("_last")))
    short = F.when(F.col("_last") < upto, F.raise_error(F.lit("line index out of range")).cast("long")).otherwise(F.col("line_no"))
    kept = own.withColumn("line_no", short).filter(F.col("line_no") <= upto) if strict else own.filter(F.col("line_no") <= F.least(F.lit(upto), "_last"))
    given = F.lit(new_id) if new_id else session_uuid(F.col("session_path"), uuid.uuid4().hex)
    at = F.locate('"sessionId":"', F.col("line"))
    head = at + len('"sessionId":"') - 1
    rest = F.substring(F.col("line"), head + 1, F.length("line"))
    swapped = F.concat(F.substring(F.col("line"), F.lit(1), head), given, F.substring(rest, F.locate('"', rest), F.length("line")))
    new = F.when((at > 0) & (F.locate('"', rest) > 0), swapped).otherwise(F.col("line"))
    return kept.withColumn("line", new).drop("_last", "_tail")


def rename_lines(lines: DataFrame, names: DataFrame) -> DataFrame:
    """``lines`` of sessions with two more, (session_path, title, session_id) of ``names``; what was there stays."""
    last = lines.filter("line <> ''").groupBy("session_path").agg(F.max("line_no").alias("at"))
    own = last.join(names, "session_path")
    tail = lambda kind, field, k: own.select("session_path", (F.col("at") + k).alias("line_no"), F.to_json(F.struct(F.lit(kind).alias("type"), F.col("title").alias(field), F.col("session_id").alias("sessionId"))).alias("line"))
    kept = lines.filter("line <> ''").select("session_path", "line_no", "line")
    return kept.unionByName(tail("custom-title", "customTitle", 1)).unionByName(tail("agent-name", "agentName", 2))


def rename(text: str, title: str, session: str) -> str:
    """The session file with two lines appended; what was there stays as it was."""
    tail = [{"type": "custom-title", "customTitle": title, "sessionId": session}, {"type": "agent-name", "agentName": title, "sessionId": session}]
    body = text if not text or text.endswith("\n") else text + "\n"
    return body + "".join(json.dumps(x, ensure_ascii=False, separators=(",", ":")) + "\n" for x in tail)


def _object(raw: str) -> bool:
    """Whether the line is a JSON object that repeats no key."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    try:
        return isinstance(json.loads(raw, object_pairs_hook=once), dict)
    except (ValueError, RecursionError):
        return False


def _span(raw: str, at: int) -> int:
    """End of the JSON value that begins at ``at``."""
    if raw[at] == '"':
        return re.compile(r'"(?:[^"\\]|\\.)*"', re.S).match(raw, at).end()
    if raw[at] not in "[{":
        return re.compile(r"[^\s,\]}]+").match(raw, at).end()
    depth, k = 0, at
    while True:
        if raw[k] == '"':
            k = _span(raw, k)
            continue
        depth += (raw[k] in "[{") - (raw[k] in "]}")
        k += 1
        if not depth:
            return k


def _members(raw: str, at: int) -> list[tuple[str | None, int, int]]:
    """(key, start, end) of the values of the object or array at ``at``."""
    out, k = [], at + 1
    skip = re.compile(r"[\s,]*")
    while True:
        k = skip.match(raw, k).end()
        if raw[k] in "]}":
            return out
        key = None
        if raw[at] == "{":
            end = _span(raw, k)
            key = json.loads(raw[k:end])
            k = re.compile(r"\s*:\s*").match(raw, end).end()
        end = _span(raw, k)
        out.append((key, k, end))
        k = end


def _find(raw: str, *path: str) -> tuple[int, int] | None:
    at = re.compile(r"\s*").match(raw).end()
    end = len(raw)
    for key in path:
        if at >= len(raw) or raw[at] != "{":
            return None
        found = [(a, b) for k, a, b in _members(raw, at) if k == key]
        if not found:
            return None
        at, end = found[-1]
    return at, end


def edit_text(raw: str, ordinal: int, new: str) -> str:
    """The line with its ``ordinal``-th text block set to ``new``; all other bytes stay.

    Anything that does not fit (no JSON, no such block, same text) leaves the line.
    """
    if not _object(raw):
        return raw
    place = _find(raw, "message", "content")
    if not place:
        return raw
    at, end = place
    if raw[at] == '"':
        spots = [(at, end)]
    elif raw[at] == "[":
        spots = []
        for _, a, b in _members(raw, at):
            if raw[a] == "{":
                own = {k: (x, y) for k, x, y in _members(raw, a)}
                if "type" in own and raw[slice(*own["type"])] == '"text"' and "text" in own and raw[own["text"][0]] == '"':
                    spots.append(own["text"])
    else:
        return raw
    if not 0 <= ordinal < len(spots):
        return raw
    a, b = spots[ordinal]
    return raw if json.loads(raw[a:b]) == new else raw[:a] + json.dumps(new, ensure_ascii=False) + raw[b:]


def drop_blocks(raw: str, numbers: set[int]) -> str | None:
    """The line without the numbered content blocks, other bytes unchanged; None if none is left."""
    if not _object(raw):
        return raw
    place = _find(raw, "message", "content")
    if not place or not numbers:
        return raw
    at, end = place
    if raw[at] == '"':
        return None if 0 in numbers else raw
    if raw[at] != "[":
        return raw
    members = _members(raw, at)
    kept = [raw[a:b] for k, (_, a, b) in enumerate(members) if k not in numbers]
    if len(kept) == len(members):
        return raw
    return raw[:at] + "[" + ",".join(kept) + "]" + raw[end:] if kept else None
