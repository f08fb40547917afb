"""The engine's queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.functions import tools
from palaver.operators import browse, edit, export, index, search, sequence, stats
from palaver.plans.corpus import HOME, LINES_SQL, as_rows, blocks, edited_index, lines, lone_files, project_files, session_files, session_index, shared_folder
from palaver.sources import jsonl
from palaver.streaming import refresh, source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
QUERY, TYPO, SHORT = "the thouesed erblest", "teh adn", "of in"
FROM, TO = 1704067200000 + 10 * 3600000, 1704067200000 + 60 * 3600000
NOW = 1_700_100_000
WORDS_SQL = "list_transform(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda w: strlen(w) < 200), lambda w: lower(w))"


def register(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def one_edit_sql(a: str, b: str) -> str:
    """Characters, not bytes, at most one edit or swap apart."""
    drop = lambda x, y: f"len(list_filter(range(1, length({x}) + 1), lambda i: concat(substr({x}, 1, i - 1), substr({x}, i + 1)) = {y})) > 0"
    return (
        f"({a} = {b} OR (length({a}) = length({b}) AND (len(list_filter(range(1, length({a}) + 1), lambda i: substr({a}, i, 1) <> substr({b}, i, 1))) <= 1 "
        f"OR len(list_filter(range(1, length({a})), lambda i: concat(substr({a}, 1, i - 1), substr({a}, i + 1, 1), substr({a}, i, 1), substr({a}, i + 2)) = {b})) > 0)) "
        f"OR (length({a}) = length({b}) + 1 AND {drop(a, b)}) OR (length({b}) = length({a}) + 1 AND {drop(b, a)}))"
    )


def scores_sql(query: str) -> str:
    """CTEs up to ``scored``: every block of ``blocks`` that matches, with its score."""
    asked = ", ".join(f"({k}, '{w}')" for k, w in enumerate(search.query_tokens(query)))
    return f"""{LINES_SQL},
words AS (SELECT session_path, line_no, block_no, {WORDS_SQL} AS w FROM blocks),
stats AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM words),
posts AS (SELECT session_path, line_no, block_no, len(w) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(w) AS term FROM words) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
asked(tok, word) AS (VALUES {asked}),
terms AS (SELECT tok, term, df, word = term AS exact, length(word) >= 3 AS fuzzy FROM dfs, asked
          WHERE abs(length(word) - length(term)) <= 1 AND (word = term OR (length(word) >= 3 AND {one_edit_sql("word", "term")}))),
by_token AS (SELECT session_path, line_no, block_no, tok,
    coalesce(sum(CASE WHEN exact THEN 3.0::DOUBLE * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_len))) END), 0) AS exact,
    max(CASE WHEN fuzzy THEN 1.0::DOUBLE ELSE 0 END) AS near
  FROM posts JOIN terms USING (term), stats GROUP BY ALL),
scored AS (SELECT session_path, line_no, block_no, round(sum(exact + near), 6) AS score FROM by_token GROUP BY ALL),
hits AS (SELECT b.*, s.score FROM blocks b JOIN scored s USING (session_path, line_no, block_no))"""


SHORT_ROW = "session_path, line_no, block_no, score"
TOP = "ORDER BY score DESC, session_path, line_no, block_no"


def _ranked(spark: SparkSession, sf: str, query: str, filters: search.Filters | None = None, limit: int = 100) -> DataFrame:
    return as_rows(search.top(session_index(spark, sf), query, filters, limit)).select("session_path", "line_no", "block_no", "score")


@register(f"WITH {scores_sql(QUERY)} SELECT {SHORT_ROW} FROM hits {TOP} LIMIT 20")
def bm25_search(spark, sf):
    return _ranked(spark, sf, QUERY, limit=20)


DOC_SQL = "session_path, line_no, block_no"
#: Up to ``shown``: the best 100 hits with the fragment whose words weigh most.
SHOWN_SQL = f"""WITH RECURSIVE {scores_sql(QUERY)}, best AS (SELECT * FROM hits {TOP} LIMIT 100),
weights AS (SELECT term, CAST(round(1000000 * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) AS BIGINT) AS weight FROM dfs, stats WHERE term IN ({", ".join(f"'{w}'" for w in search.query_tokens(QUERY))})),
split AS (SELECT {DOC_SQL}, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS w, regexp_split_to_array(text, '[\\p{{L}}\\p{{N}}]+') AS g FROM best),
tok AS (SELECT {DOC_SQL}, k, coalesce(weight, 0) AS weight, length(array_to_string(list_slice(g, 1, k), '')) + length(array_to_string(list_slice(w, 1, k - 1), '')) AS a, length(array_to_string(list_slice(g, 1, k), '')) + length(array_to_string(list_slice(w, 1, k), '')) AS z
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM split) LEFT JOIN weights ON term = lower(w[k])),
frag({DOC_SQL}, first, start) AS (SELECT {DOC_SQL}, k, CASE WHEN z > 240 THEN a ELSE 0 END FROM tok WHERE k = 1
  UNION ALL SELECT {DOC_SQL}, min(k), arg_min(a, k) FROM frag JOIN tok USING ({DOC_SQL}) WHERE k > first AND z - start > 240 GROUP BY {DOC_SQL}, first),
ends AS (SELECT *, lead(first) OVER (PARTITION BY {DOC_SQL} ORDER BY first) AS next FROM frag),
scored_frag AS (SELECT {DOC_SQL}, start, max(z) AS stop, sum(weight) AS weight FROM ends JOIN tok USING ({DOC_SQL}) WHERE k >= first AND (next IS NULL OR k < next) GROUP BY ALL),
chosen AS (SELECT * FROM scored_frag WHERE weight > 0 QUALIFY row_number() OVER (PARTITION BY {DOC_SQL} ORDER BY weight DESC, start) = 1),
shown AS (SELECT b.*, CASE WHEN start IS NULL THEN substr(text, 1, 240) ELSE substr(text, start + 1, stop - start) END AS snippet FROM best b LEFT JOIN chosen USING ({DOC_SQL}))"""


@register(f"{SHOWN_SQL} SELECT session_path, project, ts_ms, line_no, block_no, uuid, source, snippet, score FROM shown {TOP}")
def search_hits(spark, sf):
    return as_rows(search.search(session_index(spark, sf), QUERY, limit=100).drop("match_ranges"))


@register(f"""{SHOWN_SQL}, asked_words AS (SELECT DISTINCT word FROM asked),
literal AS (SELECT {DOC_SQL}, CAST(list_sum(list_transform(list_slice(parts, 1, k), lambda p: length(p))) AS BIGINT) + (k - 1) * length(word) AS a, length(word) AS n
  FROM (SELECT {DOC_SQL}, word, parts, unnest(range(1, len(parts))) AS k FROM (SELECT {DOC_SQL}, word, string_split(lower(snippet), word) AS parts FROM shown, asked_words))),
words_of AS (SELECT {DOC_SQL}, regexp_extract_all(snippet, '[\\p{{L}}\\p{{N}}]+') AS w, regexp_split_to_array(snippet, '[\\p{{L}}\\p{{N}}]+') AS g FROM shown),
near AS (SELECT DISTINCT {DOC_SQL}, length(array_to_string(list_slice(g, 1, k), '')) + length(array_to_string(list_slice(w, 1, k - 1), '')) AS a, length(w[k]) AS n
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM words_of), asked_words WHERE length(word) >= 3 AND levenshtein(lower(w[k]), word) <= 1),
ranges AS (SELECT * FROM literal UNION ALL SELECT * FROM near WHERE NOT EXISTS (SELECT 1 FROM literal l WHERE l.session_path = near.session_path AND l.line_no = near.line_no AND l.block_no = near.block_no))
SELECT {DOC_SQL}, concat('[', coalesce(array_to_string(list(concat('{{"start":', a, ',"end":', a + n, '}}') ORDER BY a, n) FILTER (a IS NOT NULL), ','), ''), ']') AS ranges FROM shown LEFT JOIN ranges USING ({DOC_SQL}) GROUP BY {DOC_SQL}""")
def search_ranges(spark, sf):
    return as_rows(search.search(session_index(spark, sf), QUERY, limit=100)).select("session_path", "line_no", "block_no", F.to_json("match_ranges").alias("ranges"))


@register(f"WITH {scores_sql(QUERY)} SELECT {SHORT_ROW} FROM hits WHERE project IN ('p1', 'p3') {TOP} LIMIT 100")
def search_project_filter(spark, sf):
    return _ranked(spark, sf, QUERY, search.Filters(projects=["~/p1", "~/p3"]))


@register(f"WITH {scores_sql(QUERY)} SELECT {SHORT_ROW} FROM hits WHERE ts_ms BETWEEN {FROM} AND {TO} {TOP} LIMIT 100")
def search_date_range(spark, sf):
    return _ranked(spark, sf, QUERY, search.Filters(start=FROM, stop=TO))


@register(f"WITH {scores_sql(QUERY)} SELECT {SHORT_ROW} FROM hits WHERE session_path = 'conv/2.jsonl' {TOP} LIMIT 100")
def search_single_session(spark, sf):
    own = session_index(spark, sf)
    path = own.files().filter(F.col("session_path").endswith("/2.jsonl")).first()
    return as_rows(search.top(own, QUERY, search.Filters(session_path=path["session_path"] if path else ""), 100)).select("session_path", "line_no", "block_no", "score")


@register(f"WITH {scores_sql(TYPO)} SELECT {SHORT_ROW} FROM hits {TOP} LIMIT 100")
def search_fuzzy_typo(spark, sf):
    return _ranked(spark, sf, TYPO)


@register(f"WITH {scores_sql(SHORT)} SELECT {SHORT_ROW} FROM hits {TOP} LIMIT 100")
def search_short_token_exact_only(spark, sf):
    return _ranked(spark, sf, SHORT)


@register(f"WITH {scores_sql(QUERY)} SELECT least(count(*), 100) AS hits, count(*) AS scanned, count(*) > 100 AS truncated FROM hits")
def match_count(spark, sf):
    return search.summary(session_index(spark, sf), QUERY, limit=100)


@register(f"WITH {LINES_SQL} SELECT session_path, line_no, array_to_string({WORDS_SQL}, ' ') AS tokens, CAST(len({WORDS_SQL}) AS BIGINT) AS n_tokens FROM blocks")
def tokenize(spark, sf):
    w = T.tokens(F.col("text"))
    return blocks(spark, sf).select("session_path", "line_no", F.array_join(w, " ").alias("tokens"), F.size(w).cast("long").alias("n_tokens"))


@register(f"WITH {LINES_SQL}, w AS (SELECT len({WORDS_SQL}) AS n FROM blocks) SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, round(avg(n), 6) AS avg_len FROM w")
def corpus_stats(spark, sf):
    return search.corpus_stats(session_index(spark, sf)).withColumn("avg_len", F.round("avg_len", 6))


@register(f"WITH {LINES_SQL} SELECT term, count(DISTINCT uuid) AS df FROM (SELECT uuid, unnest({WORDS_SQL}) AS term FROM blocks) GROUP BY term")
def term_df(spark, sf):
    return search.term_df(session_index(spark, sf))


@register(f"""WITH {LINES_SQL}, vocab AS (SELECT DISTINCT unnest({WORDS_SQL}) AS term FROM blocks), asked(tok, word) AS (VALUES (0, 'the'), (1, 'htose'), (2, 'éque'), (3, 'of'))
SELECT tok, term, word = term AS exact FROM vocab, asked WHERE word = term OR (length(word) >= 3 AND abs(length(word) - length(term)) <= 1 AND {one_edit_sql("word", "term")})""")
def fuzzy_vocab(spark, sf):
    return search.neighbours(session_index(spark, sf), ["the", "htose", "éque", "of"]).select("tok", "term", "exact").distinct()


def cold_sql(query: str, source: str) -> str:
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    points = " + ".join(f"(CASE WHEN contains({low}, '{w}') THEN 1 ELSE 0 END)" for w in search.query_tokens(query))
    return f"SELECT * FROM (SELECT *, CAST({points} AS DOUBLE) AS score FROM {source}) WHERE score > 0"


@register(f"WITH {LINES_SQL} SELECT {SHORT_ROW} FROM ({cold_sql(QUERY, 'blocks')})")
def cold_search(spark, sf):
    return search.cold(blocks(spark, sf), QUERY).select(*search.DOC, "score")


@register(f"""WITH {scores_sql(QUERY).replace("FROM blocks)", "FROM warm)").replace("FROM blocks b", "FROM warm b").replace("words AS", "warm AS (SELECT * FROM blocks WHERE project <> 'p0'), words AS", 1)},
cold AS ({cold_sql(QUERY, "(SELECT * FROM blocks WHERE project = 'p0')")}),
top AS (SELECT session_path, line_no, block_no, score FROM hits)
SELECT session_path, line_no, block_no, score, 0 AS tier FROM top UNION ALL SELECT session_path, line_no, block_no, score, 1 FROM cold""")
def warm_cold_union(spark, sf):
    return as_rows(search.two_tier(session_index(spark, sf, True), session_files(spark, sf), QUERY, limit=None, home=HOME)).select(*search.DOC, "score", "tier")


@register(f"WITH {LINES_SQL} SELECT DISTINCT session_path FROM blocks WHERE project = 'p0'")
def cold_sessions(spark, sf):
    return as_rows(search.unindexed(session_index(spark, sf, True), session_files(spark, sf), HOME)).select("session_path").distinct()


@register(f"""WITH {scores_sql(QUERY)}, page AS (SELECT * FROM hits {TOP} LIMIT {search.DEFAULT_LIMIT}), best AS (SELECT project, session_path, max(score) AS best, count(*) AS n_hits FROM page GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY best DESC, session_path) AS INTEGER) AS session_rank FROM best""")
def grouped_hits(spark, sf):
    """The sessions of a page of hits."""
    return browse.grouped_hits(as_rows(search.top(session_index(spark, sf), QUERY)))


CLEAN_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '[\x00-\x1f\x7f]', '', 'g'), '^[\s#>*\-`''"‘’“”]+', ''), '[''"‘’“”]+$', ''))"""
META_SQL = f"""firsts AS (SELECT session_path, arg_min(text, line_no) FILTER (source = 'user') AS t, arg_min(ts_ms, line_no) AS ts_ms, min(project) AS project FROM lines GROUP BY session_path),
cleaned AS (SELECT *, {CLEAN_SQL.format("t")} AS c FROM firsts),
meta AS (SELECT session_path, CASE WHEN coalesce(c, '') = '' THEN 'Untitled' WHEN length(c) > 80 THEN concat(substr(c, 1, 80), '…') ELSE c END AS title, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, project FROM cleaned)"""


@register(f"WITH {LINES_SQL}, {META_SQL} SELECT * FROM meta")
def session_meta(spark, sf):
    return stats.session_meta(lines(spark, sf))


@register(f"WITH {scores_sql(QUERY)}, {META_SQL} SELECT h.session_path, line_no, block_no, score, coalesce(title, string_split(h.session_path, '/')[-1]) AS title FROM hits h LEFT JOIN (SELECT * FROM meta WHERE project <> 'p2') m USING (session_path)")
def hits_with_titles(spark, sf):
    known = stats.session_meta(lines(spark, sf)).filter("project <> 'p2'")
    return browse.hits_with_titles(as_rows(search.matches(session_index(spark, sf), QUERY)).select(*search.DOC, "score"), known)


@register(f"WITH {LINES_SQL} SELECT session_path, project, ts_ms, line_no, block_no, uuid, source, text FROM blocks")
def extract_blocks(spark, sf):
    """From the session files, with the labels of their working folders."""
    found = jsonl.read_lines(spark, session_files(spark, sf))
    own = jsonl.search_blocks(found).drop("project").join(jsonl.project_labels(found, HOME).select("session_path", "project"), "session_path")
    return as_rows(own).select("session_path", "project", "ts_ms", "line_no", "block_no", "uuid", "source", "text")


STATS_SQL = "stats AS (SELECT session_path, count(*) AS line_count, count(*) FILTER (source = 'user') AS user_count, count(*) FILTER (source = 'assistant') AS assistant_count, arg_min(ts_ms, line_no) AS first_ts, arg_max(ts_ms, line_no) AS last_ts FROM lines GROUP BY session_path)"


@register(f"WITH {LINES_SQL}, {STATS_SQL} SELECT * FROM stats")
def session_stats(spark, sf):
    return stats.session_stats(lines(spark, sf))


@register(f"WITH {LINES_SQL}, seen AS (SELECT session_path, model, min(line_no) AS pos FROM lines GROUP BY ALL) SELECT session_path, string_agg(model, ',' ORDER BY pos, model) AS models FROM seen GROUP BY session_path")
def models_first_seen(spark, sf):
    return stats.models_first_seen(lines(spark, sf))


@register(f"SELECT conv_id, turn, {CLEAN_SQL.format('text')} AS title FROM (SELECT conv_id, turn, concat('## “', text, '\"”`') AS text FROM conversations)")
def clean_title(spark, sf):
    raw = spark.read.parquet(f"{sf}/conversations.parquet")
    return raw.select("conv_id", "turn", T.clean_title(F.concat(F.lit("## “"), "text", F.lit('"”`'))).alias("title"))


@register("""WITH r AS (SELECT doc_id, concat('-home-', replace(source, 'src', 'source-'), '--', lang, CASE WHEN doc_id % 2 = 0 THEN '-project' ELSE '' END) AS raw FROM documents),
p AS (SELECT *, list_filter(regexp_split_to_array(raw, '-+'), lambda x: x <> '') AS parts FROM r)
SELECT doc_id, CASE WHEN len(parts) = 0 THEN raw WHEN len(parts) >= 2 AND length(parts[-1]) > 3 AND length(parts[-2]) > 2 THEN concat(parts[-2], '/', parts[-1]) ELSE parts[-1] END AS project FROM p""")
def decode_project(spark, sf):
    raw = F.concat(F.lit("-home-"), F.replace("source", F.lit("src"), F.lit("source-")), F.lit("--"), "lang", F.when(F.col("doc_id") % 2 == 0, "-project").otherwise(""))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.decode_project(raw).alias("project"))


@register(f"""WITH {LINES_SQL} SELECT DISTINCT session_path, concat(CASE WHEN project = 'p0' THEN '' ELSE concat('cd ''/home/it''\\''''s/', project, ''' && ') END, 'claude --resume ''', regexp_replace(string_split(session_path, '/')[-1], '\\.jsonl$', ''), '''') AS command FROM lines""")
def resume_command(spark, sf):
    cwd = F.when(F.col("project") == "p0", "  ").otherwise(F.concat(F.lit("/home/it's/"), "project"))
    return lines(spark, sf).select("session_path", T.resume_command(cwd, T.session_id(F.col("session_path"))).alias("command")).distinct()


@register(f"WITH {LINES_SQL}, {META_SQL} SELECT project, count(*) AS n_sessions FROM meta GROUP BY project")
def project_facet(spark, sf):
    return stats.project_facet(stats.session_meta(lines(spark, sf)))


STUBS_SQL = f"stubs AS (SELECT session_path, min(project) AS project, CASE WHEN min(ts_ms) % 11 = 0 THEN NULL ELSE {NOW} - (min(ts_ms) // 3600000) % 2000 END AS mtime FROM lines GROUP BY session_path)"


def _stubs(spark: SparkSession, sf: str) -> DataFrame:
    own = lines(spark, sf).groupBy("session_path").agg(F.min("project").alias("project"), F.min("ts_ms").alias("t"))
    return own.select("session_path", "project", F.when(F.col("t") % 11 != 0, F.lit(NOW) - F.expr("t div 3600000") % 2000).alias("mtime"))


ROWS_SQL = f"""{LINES_SQL}, {STATS_SQL}, {META_SQL}, {STUBS_SQL},
enriched AS (SELECT session_path, title, line_count, user_count = 1 AS cleaned FROM stats JOIN meta USING (session_path) WHERE project <> 'p4'),
page AS (SELECT s.session_path, s.project, s.mtime, coalesce(e.title, '') AS title, coalesce(e.line_count, 0) AS line_count, e.session_path IS NOT NULL AS enriched FROM stubs s LEFT JOIN enriched e USING (session_path) WHERE NOT coalesce(e.cleaned, false))"""


@register(f"WITH {ROWS_SQL} SELECT * REPLACE (coalesce(mtime, -1) AS mtime) FROM page")
def browse_rows(spark, sf):
    own = lines(spark, sf)
    known = stats.session_stats(own).join(stats.session_meta(own), "session_path").filter("project <> 'p4'")
    return browse.browse_rows(_stubs(spark, sf), known.select("session_path", "title", "line_count", (F.col("user_count") == 1).alias("cleaned"))).fillna({"mtime": -1})


@register(f"WITH {LINES_SQL}, {STUBS_SQL} SELECT session_path, project, coalesce(mtime, -1) AS mtime FROM stubs ORDER BY stubs.mtime DESC NULLS LAST, session_path LIMIT 100")
def browse_page(spark, sf):
    return browse.browse_page(_stubs(spark, sf)).fillna({"mtime": -1})


@register(f"""WITH {LINES_SQL}, {STUBS_SQL}, page AS (SELECT * FROM stubs ORDER BY mtime DESC NULLS LAST, session_path LIMIT 60)
SELECT project, coalesce(max(mtime), -1) AS latest, count(*) AS n_sessions, string_agg(session_path, ',' ORDER BY mtime IS NULL, -mtime, session_path) AS sessions FROM page GROUP BY project""")
def browse_groups(spark, sf):
    return browse.browse_groups(browse.browse_page(_stubs(spark, sf), 60)).fillna({"latest": -1})


@register(f"""WITH {LINES_SQL}, c AS (SELECT DISTINCT session_path, CAST(regexp_extract(session_path, '(\\d+)', 1) AS BIGINT) AS conv FROM lines) SELECT session_path FROM c WHERE conv % 4 = 0 AND conv % 8 <> 0""")
def cleanup_candidates(spark, sf):
    """Of session files of which every fourth has no turns, and half of these a title."""
    root = lone_files(spark, sf)
    known = stats.scan(jsonl.read_lines(spark, root)).withColumnRenamed("custom_title", "title").join(jsonl.list_sessions(spark, root).select("session_path", "mtime"), "session_path")
    rested = known.agg(F.coalesce(F.max("mtime"), F.lit(0))).first()[0] + stats.RECENT_S
    return as_rows(stats.cleanup_candidates(known, rested).select("session_path"))


@register(f"""WITH {LINES_SQL}, k AS (SELECT *, sum(CASE WHEN source = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_path ORDER BY line_no) AS seg FROM lines WHERE source IN ('user', 'assistant')),
l AS (SELECT *, lag(source) OVER (PARTITION BY session_path ORDER BY line_no) AS prev,
  last_value(CASE WHEN source = 'assistant' THEN nullif(request_id, '') END IGNORE NULLS) OVER (PARTITION BY session_path, seg ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
t AS (SELECT *, sum(CASE WHEN source = 'user' OR coalesce(prev, 'user') = 'user' OR (request_id <> '' AND coalesce(before, '') <> request_id) THEN 1 ELSE 0 END) OVER (PARTITION BY session_path ORDER BY line_no) AS turn_id FROM l)
SELECT session_path, CAST(turn_id AS BIGINT) AS turn_id, arg_min(source, line_no) AS role, count(*) AS n_rows, min(line_no) AS first_line, max(line_no) AS last_line, arg_min(ts_ms, line_no) AS ts_ms, arg_min(model, line_no) AS model FROM t GROUP BY session_path, turn_id""")
def turns(spark, sf):
    return sequence.turns(lines(spark, sf))


@register(f"""WITH {LINES_SQL}, f AS (SELECT *, source = 'user' AS t FROM lines), g AS (SELECT *, sum(CASE WHEN t THEN 1 ELSE 0 END) OVER (PARTITION BY session_path ORDER BY line_no) AS g FROM f)
SELECT session_path, CASE WHEN t THEN 'message' ELSE 'toolgroup' END AS kind, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_rows FROM g GROUP BY session_path, g, t""")
def display_items(spark, sf):
    return sequence.display_items(lines(spark, sf), F.col("source") == "user")


@register(f"""WITH {LINES_SQL}, g AS (SELECT *, CAST(sum(CASE WHEN source = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_path ORDER BY line_no) AS BIGINT) AS span FROM lines)
SELECT session_path, span, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_rows FROM g GROUP BY session_path, span""")
def turn_spans(spark, sf):
    return sequence.turn_spans(lines(spark, sf), F.col("source") == "user")


@register(f"""WITH {LINES_SQL}, u AS (SELECT session_path, line_no, CASE WHEN line_no % 5 = 4 THEN '' ELSE concat('u', line_no // 2) END AS uuid FROM lines)
SELECT session_path, line_no, CASE WHEN uuid <> '' AND row_number() OVER (PARTITION BY session_path, uuid ORDER BY line_no) = 1 THEN uuid ELSE concat('idx:', line_no) END AS row_key FROM u""")
def row_keys(spark, sf):
    named = lines(spark, sf).withColumn("uuid", F.when(F.col("line_no") % 5 == 4, "").otherwise(F.concat(F.lit("u"), F.expr("line_no div 2"))))
    return sequence.row_keys(named).select("session_path", "line_no", "row_key")


TOOLS_SQL = "tools AS (SELECT session_path, line_no, CAST(0 AS BIGINT) AS content_no, concat('t', line_no // 2) AS tool_id, CASE WHEN line_no % 2 = 0 THEN 'tool_use' ELSE 'tool_result' END AS kind FROM lines UNION ALL SELECT session_path, line_no, 1, '', 'text' FROM lines)"


def _tools(spark: SparkSession, sf: str) -> DataFrame:
    own = lines(spark, sf)
    zero, one = F.lit(0).cast("long").alias("content_no"), F.lit(1).cast("long").alias("content_no")
    use = own.select("session_path", "line_no", zero, F.concat(F.lit("t"), F.expr("line_no div 2")).alias("tool_id"), F.when(F.col("line_no") % 2 == 0, "tool_use").otherwise("tool_result").alias("kind"))
    return use.unionByName(own.select("session_path", "line_no", one, F.lit("").alias("tool_id"), F.lit("text").alias("kind")))


@register(f"WITH {LINES_SQL}, {TOOLS_SQL} SELECT a.session_path, a.line_no, b.line_no AS partner_line, a.tool_id FROM tools a JOIN tools b ON a.session_path = b.session_path AND a.tool_id = b.tool_id AND a.kind <> b.kind WHERE a.tool_id <> ''")
def tool_pairs(spark, sf):
    return edit.tool_pairs(_tools(spark, sf)).select("session_path", "line_no", "partner_line", "tool_id")


@register(f"""WITH {LINES_SQL}, {TOOLS_SQL}, d AS (SELECT session_path, line_no, content_no, tool_id, kind FROM tools WHERE (line_no % 3 = 0 AND content_no = 0) OR (line_no % 6 = 0)),
c AS (SELECT session_path, line_no, content_no FROM d UNION SELECT t.session_path, t.line_no, t.content_no FROM tools t JOIN d ON t.session_path = d.session_path AND t.tool_id = d.tool_id AND t.tool_id <> '' AND t.kind <> d.kind),
n AS (SELECT t.session_path, t.line_no, count(*) AS n_blocks, count(c.line_no) AS n_deleted FROM tools t LEFT JOIN c USING (session_path, line_no, content_no) GROUP BY ALL)
SELECT *, CASE WHEN n_deleted = 0 THEN 'verbatim' WHEN n_deleted = n_blocks THEN 'dropped' ELSE 'rebuilt' END AS fate FROM n""")
def apply_deletions(spark, sf):
    tools = _tools(spark, sf)
    chosen = tools.filter("(line_no % 3 = 0 and content_no = 0) or line_no % 6 = 0")
    return edit.apply_deletions(tools, edit.cascade(chosen, tools))


@register(f"""WITH {LINES_SQL} SELECT session_path, line_no, concat('{{"sessionId":"new-id","n":', line_no, ',"sessionId":"old"}}') AS line FROM lines WHERE line_no <= 2""")
def fork_prefix(spark, sf):
    """All sessions, forked after their third line; shorter ones after their last."""
    raw = F.concat(F.lit('{"sessionId":"'), "session_path", F.lit('","n":'), "line_no", F.lit(',"sessionId":"old"}'))
    return edit.fork(lines(spark, sf).select("session_path", "line_no", raw.alias("line")), 2, "new-id", strict=False)


@register(f"WITH {LINES_SQL} SELECT (SELECT count(DISTINCT session_path) FROM lines) AS sessions, (SELECT count(*) FROM blocks) AS n_blocks")
def build_index_stats(spark, sf):
    """Of an index built from the session files."""
    return session_index(spark, sf).files().agg(F.count("*").alias("sessions"), F.sum("n_blocks").cast("long").alias("n_blocks"))


LISTING_SQL = "listing AS (SELECT session_path, min(ts_ms) // 1000 AS mtime, count(*) AS size, min(project) AS project FROM lines GROUP BY session_path)"


@register(f"""WITH {LINES_SQL}, {LISTING_SQL}, known AS (SELECT session_path, mtime, CASE WHEN project = 'p1' THEN size + 1 ELSE size END AS size FROM listing WHERE project <> 'p2'),
here AS (SELECT * FROM listing WHERE project <> 'p3')
SELECT coalesce(h.session_path, k.session_path) AS session_path, CASE WHEN k.session_path IS NULL THEN 'new' WHEN h.session_path IS NULL THEN 'deleted' WHEN h.mtime = k.mtime AND h.size = k.size THEN 'unchanged' ELSE 'changed' END AS status FROM here h FULL JOIN known k USING (session_path)""")
def sweep_classify(spark, sf):
    listing = lines(spark, sf).groupBy("session_path").agg(F.expr("min(ts_ms) div 1000").alias("mtime"), F.count("*").alias("size"), F.min("project").alias("project"))
    known = listing.filter("project <> 'p2'").withColumn("size", F.when(F.col("project") == "p1", F.col("size") + 1).otherwise(F.col("size")))
    return index.classify(listing.filter("project <> 'p3'"), known)


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as lines of a session file: a text, a tool call and a result a row."""
    call = F.to_json(F.struct(F.concat(F.lit("f"), "line_no").alias("file_path")))
    content = F.concat(
        F.lit('[{"type":"thinking","thinking":"hm"},{"type":"text","text":'), F.regexp_replace(F.to_json(F.struct("text")), r'^\{"text":|\}$', ""),
        F.lit('},{"type":"tool_use","id":"t1","name":"Read","input":'), call, F.lit('},{"type":"tool_result","tool_use_id":"t1","content":["z",{"type":"text","text":"a"},{"type":"text","text":5},null,{"type":"text","text":"b"}]},{"type":"image"},7,{"type":"text","text":7}]'),
    )
    line = F.concat(F.lit('{"type":"'), "source", F.lit('","uuid":"'), "uuid", F.lit('","timestamp":"2026-07-02T10:00:00.000Z","message":{"content":'), content, F.lit("}}"))
    return jsonl.entries(lines(spark, sf).select("session_path", "project", "line_no", line.alias("line")))


@register(f"""WITH {LINES_SQL}, k(content_no, kind, raw_type, tool_name, tool_id) AS (VALUES (0, 'thinking', 'thinking', '', ''), (1, 'text', 'text', '', ''), (2, 'tool_use', 'tool_use', 'Read', 't1'), (3, 'tool_result', 'tool_result', '', 't1'), (4, 'unknown', 'image', '', ''), (5, 'unknown', '', '', ''), (6, 'text', 'text', '', ''))
SELECT session_path, line_no, CAST(content_no AS BIGINT) AS content_no, kind, raw_type, tool_name, tool_id, uuid, CASE content_no WHEN 0 THEN 'hm' WHEN 1 THEN text WHEN 3 THEN concat('a', chr(10), 'b') ELSE '' END AS text, CAST(1782986400000 AS BIGINT) AS ts_ms FROM lines, k""")
def view_blocks(spark, sf):
    found = jsonl.content_blocks(_entries(spark, sf))
    return found.select("session_path", "line_no", "content_no", "kind", "raw_type", "tool_name", "tool_id", "uuid", "text", "ts_ms").fillna("")


@register(f"""WITH {LINES_SQL}, n AS (SELECT session_path, project, count(*) AS n FROM lines GROUP BY ALL)
SELECT session_path, n AS n_lines, CASE WHEN project = 'p0' THEN concat(n, CASE WHEN n = 1 THEN ' item' ELSE ' items' END)
  ELSE concat(n, CASE WHEN n = 1 THEN ' tool call · ' ELSE ' tool calls · ' END, n, CASE WHEN n = 1 THEN ' result · ' ELSE ' results · ' END, n, ' thinking') END AS summary FROM n""")
def toolgroup_summary(spark, sf):
    found = jsonl.content_blocks(_entries(spark, sf)).groupBy("session_path", "project").agg(F.count_distinct("line_no").alias("n_lines"), F.collect_list("kind").alias("kinds"))
    kinds = F.when(F.col("project") == "p0", F.filter("kinds", lambda k: k == "unknown")).otherwise(F.col("kinds"))
    return found.select("session_path", "n_lines", tools.group_summary(kinds, F.col("n_lines")).alias("summary"))


@register(f"""WITH {LINES_SQL} SELECT session_path, line_no, CASE line_no % 9 WHEN 0 THEN concat('Read: f', line_no) WHEN 1 THEN 'TodoWrite: 2 items' WHEN 2 THEN 'Skill: yes it is' WHEN 3 THEN concat('BashOutput: b', line_no)
  WHEN 4 THEN 'Bash' WHEN 5 THEN 'Skill: [1,2]' WHEN 6 THEN concat('Bash: n', line_no) WHEN 7 THEN concat('BashOutput: ', line_no) ELSE 'Read: [draft] fix it' END AS intent FROM lines""")
def tool_intent(spark, sf):
    """Inputs of all types: lists, numbers, flags and objects in the tool's own field and in others."""
    n = F.col("line_no") % 9
    name = F.when(n.isin(0, 8), "Read").when(n == 1, "TodoWrite").when(n.isin(2, 5), "Skill").when(n.isin(3, 7), "BashOutput").otherwise("Bash")
    given = F.when(n == 0, F.concat(F.lit('{"a":"x","file_path":"f'), "line_no", F.lit('"}'))).when(n == 1, '{"todos":[{"a":1},{"b":2}]}').when(n == 2, '{"k":[1],"b":" ","n":5,"f":true,"a":" yes \\n it  is"}')
    given = given.when(n == 3, F.concat(F.lit('{"a":"zz","bash_id":"b'), "line_no", F.lit('"}'))).when(n == 4, '{"command":{"a":1}}').when(n == 5, '{"s":"[1,2]"}')
    given = given.when(n == 6, F.concat(F.lit('{"command":{"a":1},"t":"n'), "line_no", F.lit('"}'))).when(n == 7, F.concat(F.lit('{"a":"x","bash_id":'), "line_no", F.lit("}"))).otherwise('{"file_path":" ","s":"[draft] fix it"}')
    return lines(spark, sf).select("session_path", "line_no", tools.tool_intent(name, given).alias("intent"))


@register(f"""WITH {LINES_SQL} SELECT session_path, line_no, concat('t', line_no) AS task_id, 'done' AS status, regexp_replace(trim(regexp_replace(text, '\\s+$', '')), '^\\s+', '') AS summary,
  concat('n', line_no) AS note, concat('subagent_tokens: ', line_no, ' | duration_ms: 7') AS usage FROM (SELECT * REPLACE (string_split(text, '</summary>')[1] AS text) FROM blocks)""")
def task_notification(spark, sf):
    """Every block as the summary of a notification; one that holds the closing tag ends there."""
    said = F.concat(
        F.lit("<task-notification>\n<task-id>t"), "line_no", F.lit("</task-id>\n<status> done </status><summary>"), "text", F.lit("</summary><note>n"), "line_no",
        F.lit("</note><usage><subagent_tokens>"), "line_no", F.lit("</subagent_tokens><tool_uses>x</tool_uses><duration_ms>7</duration_ms></usage></task-notification>"),
    )
    found = blocks(spark, sf).select("session_path", "line_no", T.task_notification(said).alias("m"))
    return found.select("session_path", "line_no", *[F.col(f"m.{k}").alias(k) for k in ("task_id", "status", "summary", "note", "usage")])


TURNS_SQL = """k AS (SELECT *, sum(CASE WHEN source = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_path ORDER BY line_no) AS seg FROM lines WHERE source IN ('user', 'assistant') AND line_no % 5 <> 3),
l AS (SELECT *, lag(source) OVER (PARTITION BY session_path ORDER BY line_no) AS prev,
  last_value(CASE WHEN source = 'assistant' THEN nullif(request_id, '') END IGNORE NULLS) OVER (PARTITION BY session_path, seg ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
t AS (SELECT *, sum(CASE WHEN source = 'user' OR coalesce(prev, 'user') = 'user' OR (request_id <> '' AND coalesce(before, '') <> request_id) THEN 1 ELSE 0 END) OVER (PARTITION BY session_path ORDER BY line_no) AS turn_id FROM l)"""


@register(f"""WITH {LINES_SQL}, {TURNS_SQL}, m AS (SELECT session_path, line_no FROM lines WHERE line_no % 5 = 3),
f AS (SELECT m.session_path, m.line_no, arg_max(t.turn_id, t.line_no) AS turn_id, arg_max(t.source, t.line_no) AS source FROM m JOIN t ON t.session_path = m.session_path AND t.line_no < m.line_no GROUP BY ALL)
SELECT DISTINCT session_path, CAST(CASE WHEN source = 'assistant' AND turn_id > 1 THEN turn_id - 1 ELSE turn_id END AS BIGINT) AS turn_id FROM f""")
def interrupted_turns(spark, sf):
    return sequence.interrupted_turns(lines(spark, sf), F.col("line_no") % 5 == 3)


STOPPED_SQL = TURNS_SQL.replace("line_no % 5 <> 3", "NOT (source = 'user' AND (line_no % 5 = 3 OR trim(regexp_replace(text, '\\s+', ' ', 'g')) = ''))")


@register(f"""WITH {LINES_SQL}, {STOPPED_SQL}, m AS (SELECT session_path, line_no FROM lines WHERE line_no % 5 = 3 AND source = 'user'),
f AS (SELECT m.session_path, m.line_no, arg_max(t.turn_id, t.line_no) AS turn_id, arg_max(t.source, t.line_no) AS source FROM m JOIN t ON t.session_path = m.session_path AND t.line_no < m.line_no GROUP BY ALL),
hit AS (SELECT DISTINCT session_path, CASE WHEN source = 'assistant' AND turn_id > 1 THEN turn_id - 1 ELSE turn_id END AS turn_id FROM f)
SELECT t.session_path, CAST(t.turn_id AS BIGINT) AS turn_id, arg_min(source, line_no) AS role, count(*) AS n_rows, bool_or(hit.turn_id IS NOT NULL) AS interrupted FROM t LEFT JOIN hit USING (session_path, turn_id) GROUP BY t.session_path, t.turn_id""")
def interrupted_files(spark, sf):
    """Turns of lines of which some users' texts are interruptions and some requests are empty."""
    own = lines(spark, sf).filter(F.col("source").isin("user", "assistant"))
    user = F.col("source") == "user"
    said = F.when(F.col("line_no") % 5 == 3, F.concat(F.lit("oh "), F.lit(jsonl.INTERRUPTED))).otherwise(F.col("text"))
    message = F.when(user, F.to_json(F.struct(said.alias("content")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content"))))
    line = F.concat(F.lit('{"type":"'), "source", F.lit('","requestId":"'), "request_id", F.lit('","message":'), message, F.lit("}"))
    found = sequence.build_turns(jsonl.view_entries(own.select("session_path", "project", "line_no", line.alias("line"))))
    return found.select("session_path", "turn_id", "role", "n_rows", "interrupted")


@register(f"""WITH {LINES_SQL} SELECT session_path, max(line_no) + 6 AS line_no, concat('the ok', chr(10), 'done') AS text FROM lines GROUP BY session_path""")
def result_texts(spark, sf):
    """Of results whose lists hold strings, numbers, nulls and images too."""
    found = jsonl.content_blocks(jsonl.view_entries(_lines(spark, sf)))
    return as_rows(found.filter("kind = 'tool_result'").select("session_path", "line_no", "text"))


@register(f"""WITH {LINES_SQL}, r AS (SELECT *, line_no % 3 = 0 AS t FROM lines),
g AS (SELECT *, sum(CASE WHEN t THEN 1 ELSE 0 END) OVER w AS g, CAST(sum(CASE WHEN source = 'user' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS span FROM r WINDOW w AS (PARTITION BY session_path ORDER BY line_no)),
i AS (SELECT *, min(line_no) OVER (PARTITION BY session_path, g, t) AS item FROM g)
SELECT session_path, span, string_agg(DISTINCT item, ',' ORDER BY item) AS units FROM i GROUP BY session_path, span""")
def turn_units(spark, sf):
    found = sequence.turn_units(lines(spark, sf), F.col("source") == "user", F.col("line_no") % 3 == 0)
    return found.withColumn("units", F.array_join(F.col("units").cast("array<string>"), ","))


@register(f"""WITH {LINES_SQL}, r AS (SELECT *, line_no % 3 = 0 AS t FROM lines),
g AS (SELECT *, sum(CASE WHEN t THEN 1 ELSE 0 END) OVER (PARTITION BY session_path ORDER BY line_no) AS g FROM r),
i AS (SELECT *, dense_rank() OVER (PARTITION BY session_path ORDER BY g, t DESC) - 1 AS item FROM g)
SELECT session_path, uuid, line_no, item, CASE WHEN item >= 2 THEN item + 50 ELSE 2 END AS shown FROM i""")
def jump_to_row(spark, sf):
    """All rows as targets."""
    own = lines(spark, sf)
    return sequence.jump(own, F.col("line_no") % 3 == 0, own, shown=2)


@register(f"""WITH {LINES_SQL}, k(content_no, kind, text_no) AS (VALUES (0, 'thinking', -1), (1, 'text', 0), (2, 'tool_use', -1), (3, 'tool_result', -1), (4, 'unknown', -1), (5, 'unknown', -1), (6, 'text', 1))
SELECT session_path, line_no, CAST(content_no AS BIGINT) AS content_no, kind, CAST(text_no AS BIGINT) AS text_no FROM lines, k""")
def text_ordinals(spark, sf):
    return sequence.text_ordinals(jsonl.content_blocks(_entries(spark, sf))).select("session_path", "line_no", "content_no", "kind", "text_no")


@register(f"""WITH {LINES_SQL}, {TOOLS_SQL}, d AS (SELECT session_path, count(*) FILTER ((line_no % 3 = 0 AND content_no = 0) OR line_no % 6 = 0) AS n, count(*) AS n_all FROM tools GROUP BY session_path),
e AS (SELECT session_path, count(*) AS n_edited FROM lines WHERE line_no % 7 = 2 GROUP BY session_path)
SELECT session_path, n + coalesce(n_edited, 0) AS n_changes, n + coalesce(n_edited, 0) > 0 AS dirty, n = n_all AS all_deleted FROM d LEFT JOIN e USING (session_path)""")
def edit_changes(spark, sf):
    tools = _tools(spark, sf)
    return edit.changes(tools, tools.filter("(line_no % 3 = 0 and content_no = 0) or line_no % 6 = 0"), lines(spark, sf).filter("line_no % 7 = 2"))


@register(f"""WITH {LINES_SQL}, w AS (SELECT *, least(nullif(instr(low, 'the'), 0), nullif(instr(low, 'of'), 0)) - 1 AS hit FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM blocks)),
c AS (SELECT *, greatest(coalesce(hit, 0) - 60, 0) AS a, least(coalesce(hit, 0) + 180, length(text)) AS b FROM w)
SELECT concat(session_path, ':', line_no, ':', block_no) AS hit_key, CASE source WHEN 'user' THEN 'You' ELSE 'Claude' END AS badge,
  concat(CASE WHEN a > 0 THEN '…' ELSE '' END, substr(text, a + 1, b - a), CASE WHEN b < length(text) THEN '…' ELSE '' END) AS snippet FROM c""")
def cold_snippets(spark, sf):
    key = T.hit_key(F.col("session_path"), F.col("line_no"), F.col("block_no"))
    return blocks(spark, sf).select(key.alias("hit_key"), T.source_badge(F.col("source")).alias("badge"), T.cold_snippet(F.col("text"), ["the", "of"]).alias("snippet"))


def _highlights(short: DataFrame) -> DataFrame:
    parts = short.withColumn("p", T.highlight(F.col("t"), T.fuzzy_ranges(F.col("t"), ["the", "of"])))
    said = lambda c: F.transform(c, lambda x: x["text"])
    hits = F.filter("p", lambda x: x["hl"])
    return parts.select("session_path", "line_no", F.array_join(said(F.col("p")), "").alias("joined"), F.size(hits).cast("long").alias("n_marked"), F.array_join(said(hits), "|").alias("marked"))


@register(f"""WITH {LINES_SQL}, w AS (SELECT *, list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), lambda x: levenshtein(lower(x), 'the') <= 1) AS w FROM blocks)
SELECT session_path, line_no, text AS joined, CAST(len(w) AS BIGINT) AS n_marked, array_to_string(w, '|') AS marked FROM w""")
def fuzzy_highlights(spark, sf):
    return _highlights(blocks(spark, sf).select("session_path", "line_no", F.col("text").alias("t")))


@register(f"""WITH {LINES_SQL}, s AS (SELECT session_path, count(*) FILTER (source = 'user') AS n, sum(length(text)) AS size, arg_min(model, line_no) AS model FROM lines GROUP BY session_path)
SELECT session_path, concat_ws(' · ', concat(n, CASE WHEN n = 1 THEN ' turn' ELSE ' turns' END), CASE WHEN n % 3 > 0 THEN concat(n % 3, ' subagents') END,
  CASE WHEN size < 1024 THEN concat(size, ' B') WHEN size < 1048576 THEN printf('%.1f KB', floor(size * 10 / 1024 + 0.5) / 10) ELSE printf('%.1f MB', floor(size * 10 / 1048576 + 0.5) / 10) END, nullif(model, 'm0')) AS card FROM s""")
def session_cards(spark, sf):
    own = lines(spark, sf).groupBy("session_path").agg(F.count_if(F.col("source") == "user").alias("n"), F.sum(F.length("text")).alias("size"), F.min_by("model", "line_no").alias("model"))
    model = F.when(F.col("model") != "m0", F.col("model")).otherwise("")
    return own.select("session_path", T.card_line(F.col("n"), F.col("n") % 3, F.col("size"), F.lit(""), model).alias("card"))


# over the session files ----------------------------------------------------------------------


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return jsonl.read_lines(spark, session_files(spark, sf))


ISO = "strftime(make_timestamp({0} * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"
CONV_SQL = "CAST(regexp_extract(session_path, '(\\d+)', 1) AS BIGINT)"
TITLES = f"CASE WHEN {CONV_SQL} % 3 = 0 THEN 2 ELSE 0 END"


@register(f"WITH {LINES_SQL} SELECT session_path, 'conv' AS project, true AS sized, true AS dated FROM lines GROUP BY session_path")
def list_sessions(spark, sf):
    """The listing; sizes and times are those of files just written."""
    found = as_rows(jsonl.list_sessions(spark, session_files(spark, sf)))
    return found.select("session_path", "project", (F.col("size") > 0).alias("sized"), (F.col("mtime") > 0).alias("dated"))


@register(f"""WITH {LINES_SQL}, n AS (SELECT session_path, count(*) + {TITLES} AS n FROM lines GROUP BY session_path)
SELECT session_path, n + 7 AS physical, n + 6 AS for_stats, n + 5 AS not_blank, n + 7 AS preview FROM n""")
def line_scans(spark, sf):
    """Lines of each session: physical, counted by statistics, not blank, within the preview."""
    own = _lines(spark, sf)
    count = lambda df, name: df.groupBy("session_path").agg(F.count("*").alias(name))
    found = count(own, "physical").join(count(jsonl.stat_lines(own), "for_stats"), "session_path").join(count(own.filter(jsonl.not_blank(F.col("line"))), "not_blank"), "session_path")
    return as_rows(found.join(count(jsonl.preview(own), "preview"), "session_path"))


@register(f"""WITH {LINES_SQL}, seen AS (SELECT session_path, model, min(line_no) AS pos FROM lines WHERE source = 'assistant' GROUP BY ALL),
m AS (SELECT session_path, string_agg(model, ',' ORDER BY pos) AS models FROM seen GROUP BY session_path),
s AS (SELECT session_path, count(*) + 6 + {TITLES} AS line_count, count(*) FILTER (source = 'user') + 2 AS user_count, count(*) FILTER (source = 'assistant') AS assistant_count,
  {ISO.format("min(ts_ms)")} AS first_ts, {ISO.format("max(ts_ms)")} AS last_ts, concat('{HOME}/', min(project)) AS cwd, CASE WHEN {CONV_SQL} % 3 = 0 THEN concat('Talk ', {CONV_SQL}) ELSE '' END AS custom_title FROM lines GROUP BY session_path)
SELECT s.*, coalesce(models, '') AS models FROM s LEFT JOIN m USING (session_path)""")
def session_scan(spark, sf):
    """Typed statistics; the broken line and the one with a null folder count as lines only."""
    return as_rows(stats.scan(_lines(spark, sf))).withColumn("models", F.array_join("models", ","))


@register(f"""WITH {LINES_SQL}, seen AS (SELECT session_path, model, min(line_no) AS pos FROM lines WHERE source = 'assistant' GROUP BY ALL),
m AS (SELECT session_path, string_agg(model, ',' ORDER BY pos) AS models FROM seen GROUP BY session_path)
SELECT l.session_path, count(*) + 5 + {TITLES.replace("session_path", "l.session_path")} AS line_count, count(*) FILTER (source = 'user') + 3 AS user_count, count(*) FILTER (source = 'assistant') AS assistant_count,
  concat('{HOME}/', min(project)) AS cwd, 'main' AS git_branch, 'plan' AS permission_mode, {ISO.format("min(ts_ms)")} AS first_ts, {ISO.format("max(ts_ms)")} AS last_ts,
  CASE WHEN max(line_no) = 0 THEN '1.0' ELSE '1.0,1.1' END AS versions, coalesce(min(models), '') AS models FROM lines l LEFT JOIN m USING (session_path) GROUP BY l.session_path""")
def session_info(spark, sf):
    found = as_rows(stats.info(_lines(spark, sf)))
    return found.withColumn("models", F.array_join("models", ",")).withColumn("versions", F.array_join("versions", ","))


FIRST_SQL = f"""f AS (SELECT session_path, arg_min(text, line_no) FILTER (source = 'user') AS t, min(ts_ms) FILTER (source = 'user') AS ts, arg_min(model, line_no) FILTER (source = 'assistant') AS model FROM lines GROUP BY session_path),
titled AS (SELECT session_path, {CLEAN_SQL.format("coalesce(t, '')")} AS c, coalesce({ISO.format("ts")}, '') AS date, coalesce(model, '') AS model FROM f),
derived AS (SELECT session_path, CASE WHEN c = '' THEN 'Untitled' WHEN length(c) > 80 THEN concat(substr(c, 1, 80), '…') ELSE c END AS title, date, model FROM titled)"""


@register(f"WITH {LINES_SQL}, {FIRST_SQL} SELECT * FROM derived")
def preview_titles(spark, sf):
    return as_rows(stats.preview_meta(_lines(spark, sf)))


@register(f"WITH {LINES_SQL}, {FIRST_SQL} SELECT * FROM derived")
def entry_titles(spark, sf):
    return as_rows(stats.entry_meta(_lines(spark, sf)))


@register(f"""WITH {LINES_SQL}, {FIRST_SQL} SELECT session_path, CASE WHEN {CONV_SQL} % 5 = 1 THEN 'Mine' WHEN {CONV_SQL} % 3 = 0 THEN concat('Talk ', {CONV_SQL}) ELSE title END AS title FROM derived""")
def shown_titles(spark, sf):
    own = _lines(spark, sf)
    renamed = own.filter(F.regexp_extract("session_path", r"(\d+)\.jsonl$", 1).cast("long") % 5 == 1).select("session_path", F.lit("Mine").alias("title")).distinct()
    return as_rows(stats.shown_titles(own, renamed))


@register(f"WITH {LINES_SQL} SELECT session_path, concat('~/', min(project)) AS label, concat('~/', min(project)) AS display FROM lines GROUP BY session_path")
def project_labels(spark, sf):
    found = jsonl.project_labels(_lines(spark, sf), HOME).select("session_path", F.col("project").alias("label"), F.col("project_display").alias("display"))
    return as_rows(found)


@register(f"""WITH {LINES_SQL}, k AS (SELECT *, sum(CASE WHEN source = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_path ORDER BY line_no) AS seg FROM lines WHERE source = 'assistant' OR source = 'user' AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
l AS (SELECT *, lag(source) OVER (PARTITION BY session_path ORDER BY line_no) AS prev,
  last_value(CASE WHEN source = 'assistant' THEN nullif(request_id, '') END IGNORE NULLS) OVER (PARTITION BY session_path, seg ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
t AS (SELECT *, sum(CASE WHEN source = 'user' OR coalesce(prev, 'user') = 'user' OR (request_id <> '' AND coalesce(before, '') <> request_id) THEN 1 ELSE 0 END) OVER (PARTITION BY session_path ORDER BY line_no) AS turn_id FROM l)
SELECT session_path, CAST(turn_id AS BIGINT) AS turn_id, arg_min(source, line_no) AS role, count(*) AS n_rows, min(line_no) AS first_line, max(line_no) AS last_line, arg_min(ts_ms, line_no) AS ts_ms,
  coalesce(arg_min(model, line_no) FILTER (source = 'assistant'), '') AS model, false AS interrupted FROM t GROUP BY session_path, turn_id""")
def session_turns(spark, sf):
    """Turns from the files: echoes, notices and results form none."""
    return as_rows(sequence.build_turns(jsonl.view_entries(_lines(spark, sf)))).fillna({"model": ""})


@register(f"""WITH {LINES_SQL} SELECT session_path, line_no, source AS type, CAST(CASE source WHEN 'user' THEN 1 ELSE 3 END AS INTEGER) AS n_blocks, source = 'assistant' OR trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' AS has_user_text, true AS has_text
FROM lines WHERE source IN ('user', 'assistant')
UNION ALL SELECT session_path, max(line_no) + 6, 'user', 1, false, false FROM lines GROUP BY session_path""")
def renderable_rows(spark, sf):
    """Rows with something to show."""
    seen = jsonl.view_entries(_lines(spark, sf)).filter("has_blocks")
    return as_rows(seen.select("session_path", "line_no", "type", "n_blocks", "has_user_text", "has_text"))


@register(f"""WITH {LINES_SQL}, n AS (SELECT session_path, count(*) AS n FROM lines GROUP BY session_path)
SELECT session_path, line_no, uuid AS row_key, source AS type FROM lines
UNION ALL SELECT session_path, n + k, CASE k WHEN 0 THEN concat('idx:', n) WHEN 2 THEN concat('idx:', n + 2) WHEN 3 THEN 'echo' WHEN 4 THEN 'notice' WHEN 5 THEN 'result' ELSE concat('idx:', n + k) END,
  CASE k WHEN 0 THEN '' WHEN 2 THEN 'permission-mode' WHEN 6 THEN 'custom-title' WHEN 7 THEN 'custom-title' ELSE 'user' END
FROM n, (VALUES (0), (2), (3), (4), (5), (6), (7)) t(k) WHERE k < 6 OR {CONV_SQL} % 3 = 0""")
def draft_rows(spark, sf):
    """Keys and types of the rows of a draft of each session."""
    return as_rows(edit.build_draft(_lines(spark, sf))).select("session_path", "line_no", "row_key", "type")


@register(f"""WITH {LINES_SQL} SELECT session_path, line_no, block_no, source, CASE WHEN line_no % 3 = 0 THEN concat('new "', line_no, '"') ELSE text END AS text FROM blocks
UNION ALL SELECT session_path, line_no, 0, source, concat('new "', line_no, '"') FROM lines WHERE source IN ('user', 'assistant') AND line_no % 3 = 0 AND NOT EXISTS (SELECT 1 FROM blocks b WHERE b.uuid = lines.uuid)""")
def edited_texts(spark, sf):
    """The texts of sessions of which every third line's first text was edited, read back from the edited lines."""
    own = _lines(spark, sf)
    rows = edit.build_draft(own)
    edits = rows.filter("line_no % 3 = 0").select("session_path", "line_no", F.lit(0).alias("text_no"), F.concat(F.lit('new "'), "line_no", F.lit('"')).alias("text"))
    edits = edits.join(as_told(own), ["session_path", "line_no"], "left_semi")
    new = edit.edit_texts(rows, edits).withColumn("project", F.lit("conv"))
    return as_rows(jsonl.search_blocks(new)).select("session_path", "line_no", "block_no", "source", "text")


def as_told(own: DataFrame) -> DataFrame:
    """Lines that are turns of the conversation: they have a time."""
    return jsonl.entries(own).filter("timestamp is not null and type in ('user', 'assistant')").select("session_path", "line_no")


@register(f"""WITH {LINES_SQL}, n AS (SELECT session_path, count(*) AS n, count(*) FILTER (source = 'user' AND line_no % 2 = 0) AS gone FROM lines GROUP BY session_path),
a AS (SELECT session_path, count(*) FILTER (source = 'assistant' AND line_no % 2 = 0) AS a FROM lines GROUP BY session_path)
SELECT session_path, n - gone + 5 + {TITLES} AS n_lines, a AS without_text FROM n JOIN a USING (session_path)""")
def saved_sessions(spark, sf):
    """Sessions saved without the texts of every other line: users' lines go, assistants' lose a block."""
    own = _lines(spark, sf)
    rows, told = edit.build_draft(own), as_told(own).filter("line_no % 2 = 0")
    text_at = jsonl.entries(own).select("session_path", "line_no", F.when(F.col("content_kind") == "STRING", 0).otherwise(1).cast("long").alias("content_no"))
    gone = text_at.join(told, ["session_path", "line_no"], "left_semi")
    kept = edit.serialize(rows, edit.set_deleted(gone.limit(0), gone))
    short = F.col("line").contains('"role":"assistant"') & ~F.col("line").contains('"type":"text"')
    return as_rows(kept.groupBy("session_path").agg(F.count("*").alias("n_lines"), F.count_if(short).alias("without_text")))


@register(f"""WITH {LINES_SQL}, {TOOLS_SQL}, d AS (SELECT session_path, line_no, content_no, tool_id, kind FROM tools WHERE (line_no % 3 = 0 AND content_no = 0) OR (line_no % 6 = 0)),
c AS (SELECT session_path, line_no, content_no FROM d UNION SELECT t.session_path, t.line_no, t.content_no FROM tools t JOIN d ON t.session_path = d.session_path AND t.tool_id = d.tool_id AND t.tool_id <> '' AND t.kind <> d.kind),
u AS (SELECT * FROM tools WHERE line_no % 4 = 0), r AS (SELECT session_path, line_no, content_no FROM u UNION SELECT t.session_path, t.line_no, t.content_no FROM tools t JOIN u ON t.session_path = u.session_path AND t.tool_id = u.tool_id AND t.tool_id <> '' AND t.kind <> u.kind)
SELECT * FROM c EXCEPT SELECT * FROM r""")
def undeleted_blocks(spark, sf):
    """What stays deleted when some rows are restored, tool calls with their results."""
    tools_ = _tools(spark, sf)
    chosen = tools_.filter("(line_no % 3 = 0 and content_no = 0) or line_no % 6 = 0")
    gone = edit.delete_units(chosen.limit(0), chosen, tools_)
    return edit.undelete(gone, edit.unit_blocks(tools_.filter("line_no % 4 = 0"), tools_), tools_)


@register(f"""WITH {LINES_SQL}, {TOOLS_SQL} SELECT session_path, CAST(line_no // 3 AS BIGINT) AS unit, bool_and(line_no % 2 = 0 OR line_no // 3 = 1) AS all_deleted FROM tools GROUP BY ALL""")
def deleted_units(spark, sf):
    tools_ = _tools(spark, sf)
    units = tools_.select("session_path", F.expr("line_no div 3").alias("unit"), "line_no")
    return edit.all_deleted(units, tools_, tools_.filter("line_no % 2 = 0 or line_no div 3 = 1"))


@register(f"""WITH {LINES_SQL}, n AS (SELECT session_path, count(*) + 6 + {TITLES} AS n FROM lines GROUP BY session_path)
SELECT session_path, n + 2 AS n_lines, 'It''s "new"' AS title FROM n""")
def renamed_sessions(spark, sf):
    own = _lines(spark, sf)
    names = own.select("session_path").distinct().select("session_path", F.lit('It\'s "new"').alias("title"), F.lit("x").alias("session_id"))
    new = edit.rename_lines(own, names).withColumn("project", F.lit("conv"))
    return as_rows(new.groupBy("session_path").agg(F.count("*").alias("n_lines")).join(stats.custom_titles(new), "session_path").withColumnRenamed("custom_title", "title"))


@register(f"""WITH {LINES_SQL}, s AS (SELECT count(DISTINCT session_path) AS n FROM lines), c AS (SELECT count(DISTINCT session_path) AS n FROM lines WHERE project = 'p0')
SELECT s.n - c.n AS unchanged, c.n AS new FROM s, c""")
def index_status(spark, sf):
    """A sweep's classification of the files on disk against an index of most projects."""
    found = index.classify(jsonl.list_sessions(spark, session_files(spark, sf)), session_index(spark, sf, True).files())
    return found.agg(F.count_if(F.col("status") == "unchanged").alias("unchanged"), F.count_if(F.col("status") == "new").alias("new"))


@register(f"""WITH {scores_sql(QUERY)}, ranked AS (SELECT *, row_number() OVER ({TOP}) AS rank FROM hits QUALIFY rank <= 100),
s AS (SELECT project, session_path, min(rank) AS rank, count(*) AS n FROM ranked GROUP BY ALL)
SELECT project, min(rank) AS rank, CAST(sum(n) AS BIGINT) AS n_hits, string_agg(session_path, ',' ORDER BY rank) AS sessions FROM s GROUP BY project""")
def project_hits(spark, sf):
    """A page of hits by project and session, best first."""
    best = as_rows(search.top(session_index(spark, sf), QUERY, limit=100))
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *search.DOC)).cast("long"))  # a page
    return browse.project_hits(ranked)


@register(f"""WITH {LINES_SQL}, w AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM blocks),
h AS (SELECT *, least(nullif(instr(low, 'the'), 0), nullif(instr(low, 'of'), 0)) - 1 AS hit FROM w), c AS (SELECT *, greatest(hit - 60, 0) AS a, least(hit + 180, length(text)) AS b FROM h WHERE hit IS NOT NULL),
s AS (SELECT *, concat(CASE WHEN a > 0 THEN '…' ELSE '' END, substr(text, a + 1, b - a), CASE WHEN b < length(text) THEN '…' ELSE '' END) AS snippet FROM c),
l AS (SELECT *, translate(snippet, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS sl FROM s)
SELECT session_path, line_no, snippet, CAST((instr(low, 'the') > 0)::INT + (instr(low, 'of') > 0)::INT AS DOUBLE) AS score, CAST((length(sl) - length(replace(sl, 'the', ''))) // 3 + (length(sl) - length(replace(sl, 'of', ''))) // 2 AS BIGINT) AS n_ranges FROM l""")
def cold_hits(spark, sf):
    """Hits of files not indexed yet, with snippets and the number of ranges."""
    found = search.cold_hits(blocks(spark, sf), "the OF")
    return found.select("session_path", "line_no", "snippet", "score", F.size("match_ranges").cast("long").alias("n_ranges"))


@register(f"""WITH {LINES_SQL}, s AS (SELECT session_path, min(project) AS project, count(*) FILTER (source = 'user') AS n, sum(length(text)) AS size, min(ts_ms) AS a, max(ts_ms) AS b, arg_min(model, line_no) AS model FROM lines GROUP BY session_path),
z AS (SELECT *, CASE WHEN size < 1024 THEN concat(size, ' B') WHEN size < 1048576 THEN printf('%.1f KB', floor(size * 10 / 1024 + 0.5) / 10) ELSE printf('%.1f MB', floor(size * 10 / 1048576 + 0.5) / 10) END AS human,
  strftime(make_timestamp(a * 1000), '%b %-d') AS d1, strftime(make_timestamp(b * 1000), '%b %-d') AS d2, strftime(make_timestamp(a * 1000), '%b %-d, %Y') AS day FROM s)
SELECT session_path, project, project <> 'p4' AS enriched, CASE WHEN project = 'p4' THEN concat(human, ' · ', day)
  ELSE concat(n, CASE WHEN n = 1 THEN ' turn · ' ELSE ' turns · ' END, human, ' · ', CASE WHEN d1 = d2 THEN d1 ELSE concat(d1, ' – ', d2) END, ' · ', model) END AS card FROM z WHERE project <> 'p6'""")
def browse_cards(spark, sf):
    own = lines(spark, sf).groupBy("session_path", "project").agg(F.count_if(F.col("source") == "user").alias("user_count"), F.sum(F.length("text")).alias("size"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.min_by("model", "line_no").alias("m"))
    stubs = own.select("session_path", "project", "size", F.expr("first_ms div 1000").alias("mtime"))
    known = own.filter("project <> 'p4'").select("session_path", "user_count", F.lit(0).alias("subagents"), "first_ms", "last_ms", F.concat("m", F.lit(" [x]")).alias("model"), (F.col("project") == "p6").alias("cleaned"))
    return browse.browse_cards(stubs, known)


@register(f"""WITH {LINES_SQL} SELECT session_path, line_no, uuid, CASE WHEN line_no > 0 THEN concat(conv, ':', line_no - 1) END AS parent_uuid, line_no % 4 = 1 AS is_sidechain,
  CASE WHEN line_no % 3 = 0 THEN concat('{{"n":', line_no, ',"ok":true}}') END AS tool_use_result, CASE WHEN source = 'assistant' THEN model END AS model, ts_ms FROM (SELECT *, {CONV_SQL} AS conv FROM lines) WHERE source IN ('user', 'assistant')""")
def scalar_fields(spark, sf):
    """The fields of users' and assistants' lines; absent ones are null, a missing mark of a side chain is false."""
    own = jsonl.entries(_lines(spark, sf)).filter("timestamp is not null and type in ('user', 'assistant')")
    return as_rows(own.select("session_path", "line_no", "uuid", "parent_uuid", "is_sidechain", "tool_use_result", "model", "ts_ms"))


@register(f"""WITH {LINES_SQL} SELECT session_path, line_no, CASE WHEN line_no % 5 = 3 THEN '{jsonl.INTERRUPTED}' ELSE text END AS text FROM lines WHERE source = 'user' AND (line_no % 5 = 3 OR trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '')""")
def interruption_texts(spark, sf):
    """What search sees of users' texts of which some hold the mark of an interruption among other words."""
    said = F.when(F.col("line_no") % 5 == 3, F.concat(F.lit("oh "), F.lit(jsonl.INTERRUPTED), F.col("text"))).otherwise(F.col("text"))
    line = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(said.alias("content")).alias("message")))
    own = lines(spark, sf).filter("source = 'user'").select("session_path", "project", "line_no", line.alias("line"))
    return jsonl.search_blocks(own).select("session_path", "line_no", "text")


@register(f"""WITH {LINES_SQL}, n AS (SELECT session_path, line_no, length(text) AS n FROM blocks)
SELECT session_path, line_no, concat(CASE WHEN line_no % 2 = 0 THEN 'Error' ELSE 'OK' END, ' · ', CASE WHEN n = 1 THEN '1 char' WHEN n < 1000 THEN concat(n, ' chars')
  ELSE concat(printf('%.1f', CASE WHEN n % 1000 = 250 THEN n + 1 ELSE n END / 1000.0::DOUBLE), 'k chars') END) AS brief FROM n""")
def result_briefs(spark, sf):
    return blocks(spark, sf).select("session_path", "line_no", T.tool_result_brief(F.col("text"), F.col("line_no") % 2 == 0).alias("brief"))


SAFE_SQL = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@register(f"""WITH {LINES_SQL}, s AS (SELECT session_path, min(project) AS project, coalesce(arg_min(text, line_no) FILTER (source = 'user'), '') AS title,
  string_agg('<div class="turn ' || source || '"><b>' || source || '</b><pre>' || {SAFE_SQL.format("text")} || '</pre></div>', '' ORDER BY line_no) AS body FROM lines GROUP BY session_path)
SELECT session_path, concat('my_', project, '_', lower(regexp_replace(regexp_replace(CASE WHEN title = '' THEN 'session' ELSE title END, '[^A-Za-z0-9]+', '_', 'g'), '^_|_$', '', 'g')), '.html') AS file_name,
  concat('<!DOCTYPE html><html><head><meta charset=''utf-8''><title>', {SAFE_SQL.format("title")}, '</title><style>{export.STYLE}</style></head><body>', body, '</body></html>') AS html FROM s""")
def export_pages(spark, sf):
    """A static page of each session, named by project and title."""
    turn = F.struct("line_no", F.col("source").alias("role"), "text")
    title = F.min_by(F.when(F.col("source") == "user", F.col("text")), F.when(F.col("source") == "user", F.col("line_no")))
    own = lines(spark, sf).groupBy("session_path").agg(F.concat(F.lit("~/My "), F.min("project")).alias("project"), F.coalesce(title, F.lit("")).alias("title"), F.array_sort(F.collect_list(turn)).alias("turns"))
    return export.export_pages(own, "session_path")


@register(f"SELECT * FROM ({ORACLES['display_items']}) QUALIFY row_number() OVER (PARTITION BY session_path ORDER BY first_line) <= 4")
def editor_window(spark, sf):
    """The first items of each session, as an editor that shows four opens with."""
    return sequence.window_of_items(QUERIES["display_items"](spark, sf), 4)


@register(f"WITH {LINES_SQL} SELECT session_path, line_no, block_no, CAST(0 AS DOUBLE) AS score FROM blocks WHERE length(text) < 0")
def search_empty_query(spark, sf):
    """Blanks and punctuation ask for nothing and find nothing."""
    return _ranked(spark, sf, " ?! \n … ")


@register(f"""WITH {LINES_SQL}, c AS (SELECT DISTINCT session_path, project, {CONV_SQL} AS conv FROM lines) SELECT session_path, project, count(*) FILTER (conv % 2 = 0) OVER (PARTITION BY project) AS subagents FROM c""")
def subagent_counts(spark, sf):
    """Agent files beside the sessions of each project."""
    root = project_files(spark, sf)
    return as_rows(jsonl.count_subagents(spark, root, jsonl.list_sessions(spark, root))).select("session_path", "project", "subagents")


@register(f"WITH {LINES_SQL} SELECT session_path, min(project) AS project, count(*) + 7 AS n_lines FROM lines WHERE {CONV_SQL} % 3 <> 0 GROUP BY session_path")
def valid_sessions(spark, sf):
    """Lines of the sessions that are UTF-8; the others are skipped whole."""
    own = jsonl.read_lines(spark, project_files(spark, sf))
    return as_rows(own.groupBy("session_path", "project").agg(F.count("*").alias("n_lines")))


@register(f"""WITH {LINES_SQL}, s AS (SELECT session_path, CASE WHEN {CONV_SQL} % 9 = 0 THEN NULL ELSE {CONV_SQL} // 2 END AS mtime, count(*) + 6 + {TITLES} AS line_count, count(*) FILTER (source = 'assistant') AS assistant_count FROM lines GROUP BY session_path)
SELECT *, row_number() OVER (ORDER BY mtime DESC NULLS LAST, session_path) AS place FROM s ORDER BY place LIMIT 200""")
def enriched_newest(spark, sf):
    """The first page of what a scan adds to the listing: newest first, ages unknown last."""
    conv = F.regexp_extract("session_path", r"(\d+)\.jsonl$", 1).cast("long")
    listing = jsonl.list_sessions(spark, session_files(spark, sf)).withColumn("mtime", F.when(conv % 9 != 0, F.floor(conv / 2)))
    page = stats.enrichment(_lines(spark, sf), listing, NOW).limit(200)
    placed = page.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("mtime"), "session_path")).cast("long"))  # a page
    return as_rows(placed).select("session_path", "mtime", "line_count", "assistant_count", "place")


@register(f"WITH {scores_sql(QUERY).replace('blocks AS (SELECT * FROM lines WHERE', f'blocks AS (SELECT * FROM lines WHERE {CONV_SQL} % 4 <> 0 AND')} SELECT {SHORT_ROW} FROM hits")
def refreshed_hits(spark, sf):
    """All hits after an index took in that every fourth session was written over."""
    return as_rows(search.matches(edited_index(spark, sf), QUERY)).select("session_path", "line_no", "block_no", "score")


@register(f"WITH {LINES_SQL} SELECT session_path, count(*) + 6 + {TITLES} AS n_lines, count(*) + 6 + {TITLES} AS n_places, true AS from_start FROM lines GROUP BY session_path")
def streamed_lines(spark, sf):
    """Lines that the streaming source brings of files that are there when it starts."""
    work = shared_folder(spark, "streamed")
    rows = source.appended(spark, session_files(spark, sf), f"{work}/snapshots")
    query = rows.writeStream.format("parquet").option("path", f"{work}/rows").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(source.SCHEMA).parquet(f"{work}/rows").groupBy("session_path")
    return as_rows(found.agg(F.count("*").alias("n_lines"), F.count_distinct("at").alias("n_places"), (F.min("at") == 0).alias("from_start")))


@register("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def merged_stream(spark, sf):
    """The last turn of each conversation, from a stream of turns merged into a keyed table."""
    path = f"{sf}/conversations.parque[t]"  # a pattern, so that a single file is taken too
    given = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").schema
    root = shared_folder(spark, "merged")
    table = refresh.KeyedTable(spark, f"{root}/table", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given), "conv_id", "turn")
    refresh.merge_stream(spark.readStream.schema(given).parquet(path), table, f"{root}/checkpoint", once=True).awaitTermination()
    return table.rows()
