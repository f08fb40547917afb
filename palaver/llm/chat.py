"""Chat formatting with a grammar round trip (2), in DataFrame operations only.

A conversation is rendered turn by turn as ``<|im_start|>role\\ntext<|im_end|>\\n``
and parsed again by a deterministic grammar.  Where the recovered turns differ
from the source, the content is escaped and rendered again; a conversation whose
escaped rendering did not read back would fail the query.

Escape: between ``<`` and ``|`` of a text one more backslash is put, so
``<|`` becomes ``<\\|`` and ``<\\|`` becomes ``<\\\\|``; the parser takes one away.
In roles, backslash and line feed are written ``\\b`` and ``\\n`` as well.

A conversation is one result row, so it is gathered in one task; rows meet by
conversation, never by a larger group.

Defined results: a null text or role is empty; rows of one conversation with
equal turns are ordered by role and text; null turns come first; rows with a null
conv_id form one conversation.  Texts of any length are taken whole.  An empty
table has an empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def _escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return _escape_text(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # after every backslash of an escaped role stands b or n, so the order is free of conflicts
    return F.replace(F.replace(_unescape_text(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def render(turns: Column, escaped: bool) -> Column:
    role = _escape_role if escaped else (lambda c: c)
    text = _escape_text if escaped else (lambda c: c)
    one = lambda t: F.concat(F.lit(START), role(t["role"]), F.lit("\n"), text(t["text"]), F.lit(END + "\n"))
    return F.array_join(F.transform(turns, one), "")


def pieces(formatted: Column) -> Column:
    """What stands after each start mark; the first must follow nothing."""
    return F.split(formatted, r"<\|im_start\|>", -1)


def raw_turns(formatted: Column) -> Column:
    """(role, text) as written, of a text of the grammar."""
    body = F.slice(pieces(formatted), 2, F.greatest(F.size(pieces(formatted)) - 1, F.lit(0)))

    def one(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        skip = F.length(role) + 1
        return F.struct(role.alias("role"), F.substring(p, skip + 1, F.length(p) - skip - len(END) - 1).alias("text"))

    return F.transform(body, one)


def well_formed(formatted: Column) -> Column:
    """Whether the text is of the grammar: marks in turn, a line feed after each role and end mark."""
    parts = pieces(formatted)
    body = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    # the only end mark of a piece is its last characters, and the role's line ends before it
    fits = lambda p: p.endswith(END + "\n") & (F.instr(p, F.lit(END)) == F.length(p) - len(END)) & (F.instr(p, F.lit("\n")) < F.length(p))
    return (F.element_at(parts, 1) == "") & F.forall(body, fits)


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation; null if it is not of the grammar."""
    read = F.transform(raw_turns(formatted), lambda t: F.struct(_unescape_role(t["role"]).alias("role"), _unescape_text(t["text"]).alias("text")))
    return F.when(well_formed(formatted), read)


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns, formatted, escaped, loss) of ``rows`` (conv_id, turn, role, text).

    ``turns`` and ``loss`` are read back from ``formatted``; ``loss`` has the
    spans (start, length) in code points of what the assistant says.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    grouped = rows.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    source = grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    tried = source.withColumn("plain", render(F.col("source"), False))
    tried = tried.withColumn("clear", F.coalesce(parse(F.col("plain")) == F.col("source"), F.lit(False)))
    tried = tried.withColumn("formatted", F.when(F.col("clear"), F.col("plain")).otherwise(render(F.col("source"), True)))
    read = tried.withColumn("turns", parse(F.col("formatted")))
    same = F.coalesce(F.col("turns") == F.col("source"), F.lit(False))
    read = read.withColumn("turns", F.when(same, F.col("turns")).otherwise(F.raise_error(F.lit("a conversation does not read back")).cast("array<struct<role: string, text: string>>")))
    return read.select("conv_id", "turns", "formatted", (~F.col("clear")).alias("escaped"), loss_spans(F.col("formatted")).alias("loss"))


def loss_spans(formatted: Column) -> Column:
    """(start, length) of the assistant's texts in a formatted conversation, from 0."""

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + len(START) + F.length(t["role"]) + 1
        n = F.length(t["text"])
        span = F.struct(start.alias("start"), n.alias("length"))
        own = F.when(_unescape_role(t["role"]) == TRAINED, F.array(span)).otherwise(F.slice(F.array(span), 1, 0))
        return F.struct((start + n + len(END) + 1).alias("at"), F.concat(a["spans"], own).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, length: int>>)").alias("spans"))
    return F.aggregate(raw_turns(formatted), zero, step, lambda a: a["spans"])


def report(found: DataFrame) -> DataFrame:
    """Digest columns of the formatted conversations, read back from them."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join(F.transform("loss", lambda s: _unescape_text(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(under).cast("long").alias("loss_chars"), F.sha2(under, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
