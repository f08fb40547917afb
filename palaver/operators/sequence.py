"""Turns, tool groups and spans: folds over the rows of a session, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PATH, LINE = "session_path", "line_no"


def _by_line() -> Window:
    return Window.partitionBy(PATH).orderBy(LINE)


def _placed(rows: DataFrame) -> DataFrame:
    """Conversation rows with the number of their turn."""
    kept = rows.filter(F.col("source").isin("user", "assistant"))
    w = _by_line()
    user = F.col("source") == "user"
    kept = kept.withColumn("_seg", F.sum(user.cast("int")).over(w))
    inner = Window.partitionBy(PATH, "_seg").orderBy(LINE)
    before = F.last(F.when(~user, F.nullif("request_id", F.lit(""))), ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, -1))
    # a row that names a request opens a turn unless the open one has that request; one that was opened without any has none
    request = F.coalesce(F.col("request_id"), F.lit(""))
    opens = user | (F.coalesce(F.lag("source").over(w), F.lit("user")) == "user") | (request != "") & (F.coalesce(before, F.lit("")) != request)
    return kept.withColumn("_opens", opens).withColumn("turn_id", F.sum(F.col("_opens").cast("int")).over(w))


def turns(rows: DataFrame) -> DataFrame:
    """Rows (session_path, line_no, source, request_id, text, ts_ms) as turns.

    A user's text is a turn of its own.  Assistant rows join the open turn unless
    their request differs from its last one.  Rows of other sources belong to none.
    """
    timed = F.col("ts_ms").isNotNull()
    more = [F.min_by(F.when(named("model"), F.col("model")), F.when(named("model"), F.col(LINE))).alias("model")] if "model" in rows.columns else []
    return _placed(rows).groupBy(PATH, "turn_id").agg(
        F.min_by("source", LINE).alias("role"), F.count("*").alias("n_rows"), F.min(LINE).alias("first_line"), F.max(LINE).alias("last_line"),
        F.min_by(F.when(timed, F.col("ts_ms")), F.when(timed, F.col(LINE))).alias("ts_ms"), *more,
    )


def named(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def build_turns(seen: DataFrame) -> DataFrame:
    """The turns of sessions as a reader sees them (``view_entries``), with ``interrupted``.

    Users' rows without text, and task notifications, form no turn and end none; an
    interruption marks a turn instead.
    """
    user = F.col("type") == "user"
    own = seen.filter((F.col("type") == "assistant") | user & F.col("has_user_text") & ~F.col("is_notice"))
    rows = own.select(PATH, LINE, F.col("type").alias("source"), "request_id", "ts_ms", "model", "is_interruption")
    marked = interrupted_turns(rows, F.col("is_interruption")).withColumn("interrupted", F.lit(True))
    found = turns(rows.filter(~F.col("is_interruption")))
    return found.join(marked, [PATH, "turn_id"], "left").withColumn("interrupted", F.coalesce("interrupted", F.lit(False)))


def window_of_items(items: DataFrame, shown: int = 300) -> DataFrame:
    """The first ``shown`` display items of each session, as an editor opens with."""
    number = F.row_number().over(Window.partitionBy(PATH).orderBy("first_line"))
    return items.withColumn("_n", number).filter(F.col("_n") <= shown).drop("_n")


def interrupted_turns(rows: DataFrame, mark: Column) -> DataFrame:
    """(session_path, turn_id) of turns that an interruption falls on; rows where ``mark`` holds form no turn.

    The last closed turn is marked: a user's turn closes at once, an assistant's
    when the next begins.  Only where none is closed is the open one marked.
    """
    marks = rows.filter(mark).select(PATH, LINE, F.lit(None).cast("struct<turn_id: bigint, source: string>").alias("at"))
    own = _placed(rows.filter(~F.coalesce(mark, F.lit(False)))).select(PATH, LINE, F.struct("turn_id", "source").alias("at"))
    seen = own.unionByName(marks).withColumn("last", F.last("at", ignorenulls=True).over(_by_line()))
    open_turn = (F.col("last.source") == "assistant") & (F.col("last.turn_id") > 1)
    hit = seen.filter(F.col("at").isNull() & F.col("last").isNotNull())
    return hit.select(PATH, (F.col("last.turn_id") - open_turn.cast("int")).alias("turn_id")).distinct()


def display_items(rows: DataFrame, has_text: Column) -> DataFrame:
    """Messages, and maximal runs of rows without text as tool groups, in order."""
    items = _islands(rows, has_text).groupBy(PATH, "_g", "_t").agg(F.min(LINE).alias("first_line"), F.max(LINE).alias("last_line"), F.count("*").alias("n_rows"))
    return items.select(PATH, F.when(F.col("_t"), "message").otherwise("toolgroup").alias("kind"), "first_line", "last_line", "n_rows")


def _islands(rows: DataFrame, has_text: Column) -> DataFrame:
    flagged = rows.withColumn("_t", has_text)
    return flagged.withColumn("_g", F.sum(F.col("_t").cast("int")).over(_by_line()))


def turn_units(rows: DataFrame, starts: Column, has_text: Column) -> DataFrame:
    """The display items of each turn span, by their first lines."""
    both = _islands(rows.withColumn("_starts", starts), has_text)
    both = both.withColumn("span", F.sum(F.col("_starts").cast("int")).over(_by_line()))
    both = both.withColumn("_item", F.min(LINE).over(Window.partitionBy(PATH, "_g", "_t")))
    return both.groupBy(PATH, "span").agg(F.array_sort(F.collect_set("_item")).alias("units"))


def jump(rows: DataFrame, has_text: Column, uuids: DataFrame, shown: int = 300, more: int = 50) -> DataFrame:
    """For (session_path, uuid): the first row with the uuid, the number of its display item, and
    how many items must be shown to see it."""
    both = _islands(rows, has_text)
    item = F.dense_rank().over(Window.partitionBy(PATH).orderBy("_g", F.desc("_t"))) - 1
    placed = both.withColumn("item", item).join(uuids.select(PATH, "uuid").distinct(), [PATH, "uuid"], "left_semi")
    found = placed.groupBy(PATH, "uuid").agg(F.min(F.struct(LINE, "item")).alias("f"))
    need = F.when(F.col("f.item") >= shown, F.col("f.item") + more).otherwise(shown)
    return found.select(PATH, "uuid", F.col("f.line_no").alias(LINE), F.col("f.item").alias("item"), need.alias("shown"))


def text_ordinals(blocks: DataFrame) -> DataFrame:
    """Blocks (…, content_no, kind) with ``text_no``, their number among the texts of the row; -1 for others."""
    text = F.col("kind") == "text"
    upto = F.sum(text.cast("int")).over(Window.partitionBy(PATH, LINE).orderBy("content_no"))
    return blocks.withColumn("text_no", F.when(text, upto - 1).otherwise(-1))


def turn_spans(rows: DataFrame, starts: Column) -> DataFrame:
    """Spans from one turn start to before the next; rows ahead of the first form span 0."""
    spans = rows.withColumn("span", F.sum(starts.cast("int")).over(_by_line()))
    return spans.groupBy(PATH, "span").agg(F.min(LINE).alias("first_line"), F.max(LINE).alias("last_line"), F.count("*").alias("n_rows"))


def row_keys(rows: DataFrame) -> DataFrame:
    """A row's key: its uuid if it has one and is the first with it, else its place."""
    first = F.row_number().over(Window.partitionBy(PATH, "uuid").orderBy(LINE)) == 1
    named = (F.coalesce(F.col("uuid"), F.lit("")) != "") & first
    return rows.withColumn("row_key", F.when(named, F.col("uuid")).otherwise(F.concat(F.lit("idx:"), F.col(LINE))))
