"""One-line descriptions of tool calls and of groups of blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.text import BLANK, squeeze

# The field of a tool's input that says what it is for.
INTENT = {
    "Bash": "command",
    "BashOutput": "bash_id",
    "Read": "file_path",
    "Edit": "file_path",
    "Write": "file_path",
    "NotebookEdit": "notebook_path",
    "Grep": "pattern",
    "Glob": "pattern",
    "Task": "description",
    "WebFetch": "url",
    "WebSearch": "query",
    "TodoWrite": "todos",
}
MOST = 140


def tool_intent(name: Column, given: Column) -> Column:
    """``name: value`` from the JSON text of a tool's input; the name alone if nothing says more.

    The tool's own field comes first: a list gives its number of items, numbers
    and flags their text; an object or a blank string says nothing.  Else the first
    field that holds a non-blank string counts, whatever the string looks like.
    """
    field = F.try_element_at(F.create_map(*[F.lit(x) for pair in INTENT.items() for x in pair]), name)
    fields = F.from_json(given, "map<string, variant>")
    own = F.try_element_at(fields, field)
    kind = F.schema_of_variant(own)
    text = lambda v: F.try_variant_get(v, "$", "string")
    strings = F.filter(F.transform(F.json_object_keys(given), lambda k: F.try_element_at(fields, k)), lambda v: F.schema_of_variant(v) == "STRING")
    first = F.try_element_at(F.filter(F.transform(strings, text), lambda v: squeeze(v) != ""), F.lit(1))
    items = F.when(kind.startswith("ARRAY"), F.size(F.try_variant_get(own, "$", "array<variant>")))
    number = F.regexp_replace(text(own), r"(\.\d*?)0+$", "$1")
    brief = (
        F.when(kind == "STRING", F.when(squeeze(text(own)) != "", text(own))).when(items.isNotNull(), F.concat(items.cast("string"), F.when(items == 1, " item").otherwise(" items")))
        .when(kind == "BOOLEAN", text(own)).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.regexp_replace(number, r"\.$", ""))
    )
    said = F.coalesce(brief, first)
    flat = squeeze(F.regexp_replace(said, rf"{BLANK}+", " "))
    short = F.when(F.length(flat) > MOST, F.concat(F.substring(flat, 1, MOST - 1), F.lit("…"))).otherwise(flat)
    return F.when(F.coalesce(short, F.lit("")) == "", name).otherwise(F.concat_ws(": ", name, short))


def group_summary(kinds: Column, n_items: Column) -> Column:
    """Counts of the kinds of blocks in a group, in words; of a group with none of them, its number of rows."""
    parts = []
    for kind, one, many in (("tool_use", " tool call", " tool calls"), ("tool_result", " result", " results"), ("thinking", " thinking", " thinking")):
        n = F.size(F.filter(kinds, _is(kind)))
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.when(n == 1, one).otherwise(many))))
    said = F.concat_ws(" · ", *parts)
    return F.when(said != "", said).otherwise(F.concat(n_items.cast("string"), F.when(n_items == 1, " item").otherwise(" items")))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda k: k == kind
