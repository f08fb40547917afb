"""The driver's tables as a corpus of sessions: as rows, in Spark and in SQL, and as session files with an index."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.operators import index

HOME = "/home/it"
LINES_SQL = """lines AS (
  SELECT concat('conv/', conv_id, '.jsonl') AS session_path, concat('p', conv_id % 7) AS project,
         1704067200000 + conv_id * 3600000 + turn * 60000 AS ts_ms, turn AS line_no, CAST(0 AS BIGINT) AS block_no,
         concat(conv_id, ':', turn) AS uuid, role AS source, CASE WHEN (conv_id + turn) % 5 < 2 THEN '' ELSE concat('r', turn // 2) END AS request_id,
         concat('m', (conv_id + turn) % 3) AS model, text
  FROM conversations),
blocks AS (SELECT * FROM lines WHERE source IN ('user', 'assistant') AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '')"""
#: What every session file ends with: a broken line, a blank one, a mode, an echo, a notice, a result with a field of a wrong type.
TAIL = [
    "not json {",
    "   ",
    '{"type":"permission-mode","permissionMode":"plan"}',
    '{"type":"user","uuid":"echo","message":{"content":"<system-reminder>the thoused erblest"}}',
    '{"type":"user","uuid":"notice","message":{"content":"<task-notification><status>done</status></task-notification>"}}',
    '{"type":"user","uuid":"result","cwd":null,"message":{"content":[{"type":"tool_result","tool_use_id":"t1","content":["z",{"type":"text","text":5},{"type":"text","text":"the ok"},null,{"type":"image"},{"type":"text","text":"done"}]}]}}',
]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.concat(F.lit("conv/"), c, F.lit(".jsonl")).alias("session_path"), F.concat(F.lit("p"), c % 7).alias("project"),
        (F.lit(1704067200000) + c * 3600000 + t * 60000).alias("ts_ms"), t.alias("line_no"), F.lit(0).cast("long").alias("block_no"),
        F.concat(c, F.lit(":"), t).alias("uuid"), F.col("role").alias("source"), F.when((c + t) % 5 < 2, "").otherwise(F.concat(F.lit("r"), F.expr("turn div 2"))).alias("request_id"),
        F.concat(F.lit("m"), (c + t) % 3).alias("model"), "text",
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).filter(F.col("source").isin("user", "assistant") & (T.squeeze(F.col("text")) != ""))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share; below the temporary one only where they are one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="palaver-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def session_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, text): the conversations as session files, a line a turn, and TAIL; of every third one two titles more."""
    own = lines(spark, sf_dir).withColumn("conv", F.regexp_extract("session_path", r"(\d+)", 1))
    both = [
        F.col("uuid"), F.col("request_id").alias("requestId"), F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.concat(F.lit(HOME + "/"), "project").alias("cwd"), F.lit("main").alias("gitBranch"), F.col("conv").alias("sessionId"), F.concat(F.lit("1."), F.col("line_no") % 2).alias("version"),
        F.when(F.col("line_no") > 0, F.concat("conv", F.lit(":"), F.col("line_no") - 1)).alias("parentUuid"), (F.col("line_no") % 4 == 1).alias("isSidechain"),
        F.when(F.col("line_no") % 3 == 0, F.struct(F.lit(True).alias("ok"), F.col("line_no").alias("n"))).alias("toolUseResult"),
    ]
    part = lambda kind, name, value: F.struct(F.lit(kind).alias("type"), value.alias(name))
    user = F.to_json(F.struct(F.lit("user").alias("type"), *both, F.struct(F.lit("user").alias("role"), F.col("text").alias("content")).alias("message")))
    thinking, said = F.to_json(part("thinking", "thinking", F.lit("hm"))), F.to_json(part("text", "text", F.col("text")))
    call = F.to_json(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), "line_no").alias("id"), F.lit("Read").alias("name"), F.struct(F.concat(F.lit("f"), "line_no").alias("file_path")).alias("input")))
    head = F.regexp_replace(F.to_json(F.struct(F.lit("assistant").alias("type"), *both)), r"\}$", "")
    assistant = F.concat(head, F.lit(',"message":{"role":"assistant","model":"'), "model", F.lit('","content":['), F.concat_ws(",", thinking, said, call), F.lit("]}}"))
    other = F.to_json(F.struct("source", *both, F.col("text").alias("content")))
    other = F.regexp_replace(other, '^\\{"source":', '{"type":')
    line = F.when(F.col("source") == "user", user).when(F.col("source") == "assistant", assistant).otherwise(other)
    grouped = own.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))).alias("l"))
    title = lambda t: F.concat(F.lit('{"type":"custom-title","customTitle":"' + t), "conv", F.lit('"}\n'))
    titles = F.when(F.col("conv").cast("long") % 3 == 0, F.concat(title("old "), title("Talk "))).otherwise("")
    text = F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n" + "\n".join(TAIL) + "\n"), titles)
    return grouped.select(F.concat("conv", F.lit(".jsonl")).alias("name"), text.alias("text"))


def write_files(texts: DataFrame, folder: str) -> int:
    """Write texts or bytes (name, text) as files below a folder; how many."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        made = set()
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = f"{root}/{name}".rpartition("/")[0]
                if own not in made:
                    fs.create_dir(own, recursive=True)
                    made.add(own)
                with fs.open_output_stream(f"{root}/{name}") as out:
                    out.write(text.encode() if isinstance(text, str) else text)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    return texts.mapInArrow(apply, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


_known: dict[tuple[str, str], str] = {}


def session_files(spark: SparkSession, sf_dir: str) -> str:
    """The folder of projects that holds the conversations as session files, written once a session of Spark."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _known:
        root = shared_folder(spark, "sessions")
        write_files(session_texts(spark, sf_dir), f"{root}/projects/conv")
        _known[key] = f"{root}/projects"
    return _known[key]


def lone_files(spark: SparkSession, sf_dir: str) -> str:
    """The same in another folder, every fourth session without turns, and half of these with a title."""
    key = (spark.sparkContext.applicationId, f"{sf_dir} lone")
    if key not in _known:
        root = shared_folder(spark, "lone")
        conv = F.regexp_extract("name", r"(\d+)", 1).cast("long")
        mode, title = '{"type":"permission-mode","permissionMode":"plan"}\n', '{"type":"custom-title","customTitle":"kept"}\n'
        text = F.when(conv % 8 == 0, mode + title).when(conv % 4 == 0, mode).otherwise(F.col("text"))
        write_files(session_texts(spark, sf_dir).select("name", text.alias("text")), f"{root}/projects/conv")
        _known[key] = f"{root}/projects"
    return _known[key]


def project_files(spark: SparkSession, sf_dir: str) -> str:
    """The same in a folder for each project, every third session not UTF-8, and beside every second an agent's file."""
    key = (spark.sparkContext.applicationId, f"{sf_dir} projects")
    if key not in _known:
        root = shared_folder(spark, "projects")
        conv = F.regexp_extract("name", r"(\d+)", 1).cast("long")
        own, raw = F.concat(F.lit("p"), conv % 7), F.encode("text", "UTF-8")
        texts = session_texts(spark, sf_dir)
        odd = F.when(conv % 3 == 0, F.concat(raw, F.lit(b"\xff"))).otherwise(raw)
        write_files(texts.select(F.concat(own, F.lit("/"), "name").alias("name"), odd.alias("text")), f"{root}/projects")
        agents = texts.filter(conv % 2 == 0)
        write_files(agents.select(F.concat(own, F.lit("/subagents/agent-"), "name").alias("name"), raw.alias("text")), f"{root}/projects")
        _known[key] = f"{root}/projects"
    return _known[key]


def edited_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """An index of the session files after every fourth of these was written over by one without turns: one file is
    indexed by itself, the others are found by a sweep."""
    key = (spark.sparkContext.applicationId, f"{sf_dir} edited")
    if key not in _known:
        root = shared_folder(spark, "edited")
        corpus, own = f"{root}/projects", f"{root}/index"
        texts = session_texts(spark, sf_dir)
        write_files(texts, f"{corpus}/conv")
        index.refresh(spark, corpus, own, None, HOME)
        conv = F.regexp_extract("name", r"(\d+)", 1).cast("long")
        mode = '{"type":"permission-mode","permissionMode":"plan"}\n'
        write_files(texts.filter(conv % 4 == 0).select("name", F.lit(mode).alias("text")), f"{corpus}/conv")
        one = index.jsonl.list_sessions(spark, corpus).filter(F.col("size") == len(mode)).agg(F.min("session_path")).first()[0]
        if one:
            index.index_file(spark, corpus, own, one, HOME)
        index.refresh(spark, corpus, own, None, HOME)
        _known[key] = own
    return index.open_index(spark, _known[key])


def session_index(spark: SparkSession, sf_dir: str, some: bool = False) -> index.Index:
    """The index of these files, built once a session of Spark; with ``some``, of those of most projects only."""
    key = (spark.sparkContext.applicationId, f"{sf_dir} index {some}")
    if key not in _known:
        corpus = session_files(spark, sf_dir)
        root = f"{corpus.removesuffix('/projects')}/index-{int(some)}"
        most = F.regexp_extract("session_path", r"(\d+)\.jsonl$", 1).cast("long") % 7 != 0
        index.refresh(spark, corpus, root, most if some else None, HOME)
        _known[key] = root
    return index.open_index(spark, _known[key])


def as_rows(df: DataFrame) -> DataFrame:
    """Results over the files named as the rows are: paths from ``conv/`` on, projects without their folder."""
    out = df.withColumn("session_path", F.concat(F.lit("conv/"), F.element_at(F.split("session_path", "/"), -1)))
    return out.withColumn("project", F.regexp_replace("project", "^~/", "")) if "project" in df.columns else out
