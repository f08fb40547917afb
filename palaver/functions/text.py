"""Column functions: tokens, typo distance, titles, labels, commands, highlights."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers see it, which Java's \s is not.
BLANK = r"[\s   -     　﻿]"
TOKEN_BYTES = 200


def squeeze(c: Column) -> Column:
    """Trimmed of all white space."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def tokens(c: Column) -> Column:
    """Runs of letters and digits under 200 bytes, lower-cased last (a capital may fold to two letters)."""
    words = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(F.filter(words, lambda w: F.octet_length(w) < TOKEN_BYTES), F.lower)


def one_edit(a: Column, b: Column) -> Column:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    at = F.sequence(F.lit(1), F.length(a) - 1)

    def swapped(i: Column) -> Column:
        return F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b

    plain = F.levenshtein(a, b, 1) >= 0
    swap = F.when((F.length(a) == F.length(b)) & (F.length(a) > 1), F.exists(at, swapped)).otherwise(False)
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (plain | swap)


def clean_title(c: Column) -> Column:
    """One line without control characters, list marks and quotes around it."""
    out = F.regexp_replace(c, rf"{BLANK}+", " ")
    out = F.regexp_replace(out, r"[\x00-\x1f\x7f]", "")
    out = F.regexp_replace(out, rf"^(?:{BLANK}|[#>*\-`'\"‘’“”])+", "")
    return squeeze(F.regexp_replace(out, "['\"‘’“”]+$", ""))


def truncate(c: Column, most: int = 80) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def decode_project(raw: Column) -> Column:
    """Readable end of a dashed folder name: its last part, with the one before if both are long enough."""
    parts = F.filter(F.split(raw, "-+"), lambda p: p != "")
    last, second = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    return (
        F.when(F.size(parts) == 0, raw)
        .when((F.size(parts) >= 2) & (F.length(last) > 3) & (F.length(second) > 2), F.concat_ws("/", second, last))
        .otherwise(last)
    )


def project_label(cwd: Column, fallback: Column, home: str) -> Column:
    """``~`` for the home folder, ``~/rest`` below it, the folder itself elsewhere."""
    below = F.concat(F.lit("~/"), F.substring(cwd, F.lit(len(home) + 2), F.length(cwd)))
    return F.when(F.coalesce(cwd, F.lit("")) == "", fallback).when(cwd == home, "~").when(cwd.startswith(home + "/"), below).otherwise(cwd)


def shell_quote(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def session_id(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.jsonl$", "")


#: Fixed value: the program that reopens a session.
RESUME = "claude --resume"


def resume_command(cwd: Column, sid: Column, program: str = RESUME) -> Column:
    """Shell line that reopens a session, entering its folder first if it is known."""
    run = F.concat(F.lit(program + " "), shell_quote(sid))
    return F.when(squeeze(F.coalesce(cwd, F.lit(""))) == "", run).otherwise(F.concat(F.lit("cd "), shell_quote(cwd), F.lit(" && "), run))


def fold(c: Column) -> Column:
    """Lower case of the same length: a letter that would become two stays as it is."""
    one = lambda x: F.when(F.length(F.lower(x)) == 1, F.lower(x)).otherwise(x)
    return F.when(F.length(F.lower(c)) == F.length(c), F.lower(c)).otherwise(F.array_join(F.transform(F.split(c, ""), one), ""))


def ascii_lower_text(s: str) -> str:
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in s)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def best_fragment(text: Column, weights: dict[str, int], most: int = 240) -> Column:
    """The fragment whose words weigh most, of those that ``text`` falls into at words, up to ``most`` characters each.

    Words of ``weights`` count as often as they stand there; of equal fragments the first counts.  The first begins
    with the text, others with a word; each ends with one.  Without any such word: the beginning.
    """
    word = r"[\p{L}\p{N}]+"
    state = "struct<at: int, start: int, stop: int, score: long, best_start: int, best_stop: int, best: long>"
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.expr("cast(map() as map<string, bigint>)")

    def best(own: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            begin = s["at"] + F.length(x["gap"])
            end = begin + F.length(x["word"])
            fresh = end - s["start"] > most
            better = s["score"] > s["best"]
            score = F.when(fresh, 0).otherwise(s["score"]) + F.coalesce(F.try_element_at(known, F.lower(x["word"])), F.lit(0))
            kept = lambda a, b: F.when(fresh & better, s[a]).otherwise(s[b])
            return F.struct(
                end.alias("at"), F.when(fresh, begin).otherwise(s["start"]).alias("start"), end.alias("stop"), score.alias("score"),
                kept("start", "best_start").alias("best_start"), kept("stop", "best_stop").alias("best_stop"), kept("score", "best").alias("best"),
            ).cast(state)

        first = F.struct(*[F.lit(0).alias(c) for c in ("at", "start", "stop")], F.lit(0).alias("score"), F.lit(0).alias("best_start"), F.lit(0).alias("best_stop"), F.lit(0).alias("best")).cast(state)
        pairs = F.zip_with(own["found"], F.slice(own["gaps"], 1, F.size(own["found"])), lambda w, g: F.struct(w.alias("word"), g.alias("gap")))
        last = F.aggregate(pairs, first, step)
        cut = lambda x: F.when(x["score"] > x["best"], F.substring(text, x["start"] + 1, x["stop"] - x["start"])).when(x["best"] > 0, F.substring(text, x["best_start"] + 1, x["best_stop"] - x["best_start"])).otherwise(F.substring(text, 1, most))
        return F.transform(F.array(last), cut)[0]

    return _once(best, found=F.regexp_extract_all(text, F.lit(word), F.lit(0)), gaps=F.split(text, word, -1))


def _ranges(low: Column, words: list[str]) -> Column:
    def of(w: str) -> Column:
        between = F.split(low, re.escape(w), -1)
        at = lambda i: F.length(F.array_join(F.slice(between, 1, i + 1), w))
        return F.transform(F.slice(between, 1, F.size(between) - 1), lambda _, i: F.struct(at(i).alias("start"), (at(i) + len(w)).alias("end")))

    parts = [of(w) for w in words]
    return F.array_sort(F.concat(*parts)) if parts else F.expr("cast(array() as array<struct<start: int, end: int>>)")


def match_ranges(text: Column, words: list[str]) -> Column:
    """(start, end) of the literal matches of the words, also within longer ones, from 0, in code points, sorted."""
    return _ranges(fold(text), list(dict.fromkeys(words)))


def cold_ranges(snippet: Column, words: list[str]) -> Column:
    """The ranges in a snippet of a file not indexed yet: ASCII case aside, a repeated word again; the dots of an omission count."""
    return _ranges(ascii_lower(snippet), words)


def _once(build: Callable[[Column], Column], **parts: Column) -> Column:
    """``build`` over a struct of ``parts``, each made once a row: in a lambda they would be made for each element."""
    return F.transform(F.array(F.struct(*[c.alias(k) for k, c in parts.items()])), build)[0]


def fuzzy_ranges(text: Column, words: list[str]) -> Column:
    """(start, end) of words one insertion, deletion or substitution away from a query word of three
    letters or more; what is shown where nothing matches literally."""
    word = r"[\p{L}\p{N}]+"
    found, gaps = F.regexp_extract_all(text, F.lit(word), F.lit(0)), F.split(text, word, -1)
    long = [w for w in dict.fromkeys(words) if len(w) >= 3]
    empty = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    if not long:
        return empty

    def places(own: Column) -> Column:
        def place(w: Column, i: Column) -> Column:
            start = F.length(F.array_join(F.slice(own["gaps"], 1, i + 1), "")) + F.length(F.array_join(F.slice(own["found"], 1, i), ""))
            near = F.lit(False)
            for q in long:
                near |= F.levenshtein(F.lower(w), F.lit(q), 1) >= 0
            return F.when(near, F.struct(start.alias("start"), (start + F.length(w)).alias("end")))

        return F.filter(F.transform(own["found"], place), lambda r: r.isNotNull())

    return F.coalesce(_once(places, found=found, gaps=gaps), empty)


def cold_snippet(text: Column, words: list[str], before: int = 60, after: int = 180) -> Column:
    """What surrounds the earliest match, ASCII case aside, with dots where text is left out."""
    low = ascii_lower(text)
    found = [F.when(F.instr(low, F.lit(w)) > 0, F.instr(low, F.lit(w)) - 1) for w in words]
    first = F.coalesce(F.least(*found, F.lit(None).cast("int")), F.lit(0)) if found else F.lit(0)
    start, stop = F.greatest(first - before, F.lit(0)), F.least(first + after, F.length(text))
    dots = lambda c: F.when(c, F.lit("…")).otherwise("")
    return F.concat(dots(start > 0), F.substring(text, start + 1, stop - start), dots(stop < F.length(text)))


def highlight(text: Column, ranges: Column) -> Column:
    """``text`` as segments (text, hl) by sorted ranges; where ranges overlap the earlier one counts."""

    def segments(own: Column) -> Column:
        text, ranges = own["text"], own["ranges"]
        ends = lambda i: F.coalesce(F.array_max(F.transform(F.slice(ranges, 1, i), lambda r: r["end"])), F.lit(0))
        part = lambda a, b, hit: F.struct(F.substring(text, a + 1, b - a).alias("text"), F.lit(hit).alias("hl"))
        pieces = F.flatten(F.transform(ranges, lambda r, i: F.array(part(ends(i), r["start"], False), part(F.greatest(r["start"], ends(i)), r["end"], True))))
        whole = F.concat(pieces, F.array(part(ends(F.size(ranges)), F.length(text), False)))
        return F.filter(whole, lambda p: F.length(p["text"]) > 0)

    return _once(segments, text=text, ranges=ranges)


def hit_key(path: Column, line: Column, block: Column) -> Column:
    return F.concat_ws(":", path, line, block)


def source_badge(source: Column, names: dict[str, str] | None = None) -> Column:
    """Who speaks, in words; unknown sources as they are."""
    # Labels of the two sources.
    names = names or {"user": "You", "assistant": "Claude"}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), source), source)


def human_size(n: Column) -> Column:
    """Bytes, or units of 1,024 with one digit after the point; halves round up."""
    kilo, mega = F.lit(1024), F.lit(1024 * 1024)
    return (
        F.when(n < kilo, F.concat(n.cast("string"), F.lit(" B"))).when(n < mega, F.format_string("%.1f KB", n / kilo))
        .otherwise(F.format_string("%.1f MB", n / mega))
    )


def date_range(first: Column, last: Column, fallback: Column | None = None) -> Column:
    """``MMM d`` of a day, or of two with a dash; without a first time the fallback's ``MMM d, yyyy``.  Days are UTC."""
    day = lambda c: F.date_format(F.timestamp_millis(c), "MMM d")
    same = F.to_date(F.timestamp_millis(first)) == F.to_date(F.timestamp_millis(last))
    full = F.coalesce(F.date_format(F.timestamp_millis(fallback), "MMM d, yyyy"), F.lit("")) if fallback is not None else F.lit("")
    return F.when(first.isNull(), full).when(last.isNull() | same, day(first)).otherwise(F.concat_ws(" – ", day(first), day(last)))


def model_name(model: Column) -> Column:
    """A model without what stands in brackets after it."""
    return F.trim(F.regexp_replace(F.coalesce(model, F.lit("")), r"(?s)\[.*", ""))


def card_line(turns: Column, subagents: Column, size: Column, dates: Column, model: Column) -> Column:
    """A session in one line; what is empty is left out."""
    some = lambda c: F.nullif(c, F.lit(""))
    agents = F.when(subagents > 0, F.concat(subagents.cast("string"), F.lit(" subagents")))
    spoken = F.concat(turns.cast("string"), F.when(turns == 1, " turn").otherwise(" turns"))
    return F.concat_ws(" · ", spoken, agents, human_size(size), some(dates), some(model_name(model)))


def stub_line(size: Column, mtime: Column) -> Column:
    """A session of which only the file is known: its size and day; ``mtime`` in seconds."""
    day = F.when(F.coalesce(mtime, F.lit(0)) != 0, F.date_format(F.timestamp_seconds(mtime), "MMM d, yyyy"))
    return F.concat_ws(" · ", human_size(size), day)


def ts_millis(raw: Column) -> Column:
    """Epoch milliseconds of an RFC 3339 time; null for anything looser."""
    strict = raw.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.when(strict, F.unix_millis(F.try_to_timestamp(raw)))


def task_notification(text: Column) -> Column:
    """Fields of a task notification as a map; dashes in names become underscores, counters become ``usage``."""
    # Tags of the format.
    plain = ["task-id", "tool-use-id", "output-file", "status", "summary", "note", "result"]
    counters = ["subagent_tokens", "tool_uses", "duration_ms"]
    get = lambda tag, inner: F.regexp_extract(text, rf"(?s)<{tag}>({inner})</{tag}>", 1)
    has = lambda tag, inner: text.rlike(rf"(?s)<{tag}>{inner}</{tag}>")
    pairs = [x for tag in plain for x in (F.lit(tag.replace("-", "_")), F.when(has(tag, ".*?"), squeeze(get(tag, ".*?"))))]
    used = F.concat_ws(" | ", *[F.when(has(tag, "[0-9]+"), F.concat(F.lit(f"{tag}: "), get(tag, "[0-9]+"))) for tag in counters])
    return F.map_filter(F.create_map(*pairs, F.lit("usage"), F.nullif(used, F.lit(""))), lambda _, v: v.isNotNull())


def tool_result_brief(text: Column, error: Column) -> Column:
    """``OK`` or ``Error`` and the size; thousands with one decimal, by the exact value of the quotient in double precision."""
    n = F.length(text)
    # format_number takes exact halves (.25, .75) to the even digit; here they go up
    thousands = F.replace(F.format_number((n + F.when(n % 1000 == 250, 1).otherwise(0)) / 1000, 1), F.lit(","), F.lit(""))
    size = F.when(n >= 1000, F.concat(thousands, F.lit("k chars"))).otherwise(F.concat(n.cast("string"), F.when(n == 1, " char").otherwise(" chars")))
    return F.concat_ws(" · ", F.when(error, "Error").otherwise("OK"), size)
