"""WARC archives: a writer with revisit records and a splittable reader (4).

Writing: pages of equal payloads become one response record, that of the smallest
page_id, and revisits.  Each task writes one file of gzip members, a member a
record, under a name of its own attempt and then renames it, so a task that runs
again leaves the same files.

Reading: the files are cut into byte ranges regardless of records.  A task scans
its range for gzip magic, validates each candidate by decompressing it and reading
a WARC header, and owns the records that start inside; the last may end beyond.
Once a member is read, the next candidate is sought after its end, so magic
bytes inside compressed data are never taken up in the middle of a member.

Files are reached by pyarrow's file systems, in the shared checkpoint folder.

Defined results: null html is an empty payload; null URLs give no target URI.
Rows of equal page_id and payload are responses all, if that id is the smallest;
where all rows of a payload have null ids, all are responses.  Empty
tables give no files and no rows.  Payloads of any length are whole; a record is
held in memory by its task.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hot_left_join

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
LEVEL = 4
#: Characters of a URL that stand as they are; the rest, percent signs too, is encoded.
URL_SAFE = "!#$&'()*+,/:;=?@[]~"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    name = "none" if page_id is None else page_id
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=URL_SAFE))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = HTTP + (b"" if revisit else payload)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def parse(data: bytes) -> dict | None:
    """A decompressed record; None if it is not a WARC record."""
    if not data.startswith(b"WARC/1."):
        return None
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not mark:
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        fields[key.strip().lower()] = value.strip()
    if "content-length" not in fields or "warc-type" not in fields:
        return None
    block = rest[: int(fields["content-length"])]
    fields["payload"] = block.partition(b"\r\n\r\n")[2]
    return fields


def page_number(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").rpartition(":")[2]
    return int(name) if name.lstrip("-").isdigit() else None


def plan(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to) with the page a revisit refers to."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("_digest", F.when(F.octet_length("html") >= least_bytes, F.unhex(F.sha1("html"))))
    groups = keyed.filter("_digest is not null").groupBy("_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return (
        hot_left_join(keyed, cut(groups), "_digest", "n")
        .withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
        .select("page_id", "url", "html", "refers_to")
    )


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> list[tuple[str, int]]:
    """Write a record per row of ``pages`` (page_id, url, html) below the URI ``folder``; the files and their sizes."""
    run = uuid.uuid4().hex[:8]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        final = f"{root}/part-{run}-{task.partitionId():06d}.warc.gz"
        own = f"{root}/.{run}-{task.partitionId()}-{task.taskAttemptId()}"
        out, size = None, 0
        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(own)
                member = record(page_id, url, html.encode(), refers_to, refers_to is not None)
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
            fs.move(own, final)
            yield pa.RecordBatch.from_arrays([pa.array([final.removeprefix(root + "/")]), pa.array([size], pa.int64())], names=["name", "size"])

    # a row a task: the list of files of the archive
    return sorted((r["name"], r["size"]) for r in plan(pages, least_bytes).mapInArrow(apply, "name string, size long").collect())


def members(source: pa.NativeFile, size: int, start: int, stop: int) -> Iterator[dict]:
    """The records of the gzip members that start in [start, stop)."""
    at, held = start, b""

    def more() -> bool:
        nonlocal held
        source.seek(at + len(held))
        part = source.read(READ_BYTES)
        held += part
        return bool(part)

    while at < stop:
        if len(held) < len(MAGIC) and not more() and len(held) < len(MAGIC):
            return
        k = held.find(MAGIC)
        if k < 0:  # magic may lie across the end of what is held
            at, held = at + len(held) - len(MAGIC) + 1, held[len(held) - len(MAGIC) + 1 :]
            if not more():
                return
            continue
        at, held = at + k, held[k:]
        if at >= stop:
            return
        found, used = _member(source, held, at)
        if found is None:
            at, held = at + 1, held[1:]
            continue
        yield found
        at, held = at + used, held[used:]


def _member(source: pa.NativeFile, held: bytes, at: int) -> tuple[dict | None, int]:
    """The record of the member at ``at`` and its compressed length; None if there is none."""
    press, out, used, part = zlib.decompressobj(31), [], 0, held
    checked = False
    while True:
        try:
            out.append(press.decompress(part))
        except zlib.error:
            return None, 0
        used += len(part)
        if not checked and sum(map(len, out)) >= 7:
            out, checked = [b"".join(out)], True
            if not out[0].startswith(b"WARC/1."):
                return None, 0
        if press.eof:
            used -= len(press.unused_data)
            return parse(b"".join(out)), used
        source.seek(at + used)
        part = source.read(READ_BYTES)
        if not part:
            return None, 0


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size) of the archives in ``folder``, by Spark's own listing; contents are not read."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    if fs.get_file_info(root).type == pyarrow.fs.FileType.NotFound:
        return spark.createDataFrame([], "name string, size long")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def read(spark: SparkSession, folder: str, files: list[tuple[str, int]] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the archives below ``folder``: RECORD columns; html is null for revisits."""
    listed = _listed(spark, folder) if files is None else spark.createDataFrame(files, "name string, size long")
    listed = listed.filter("size > 0")
    count = listed.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 0
    # the ranges are made by the tasks: the driver holds no more than the list of files
    ranges = listed.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))))
    tasks = ranges.withColumn("stop", F.least("size", F.col("start") + split_bytes)).repartition(max(1, min(int(count), 10_000)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        names = [c.split()[0] for c in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for name, size, start, stop in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                rows, held = [], 0
                with fs.open_input_file(f"{root}/{name}") as source:
                    for f in members(source, size, start, stop):
                        kind, said = f["warc-type"], f.get("warc-payload-digest", "").removeprefix("sha1:")
                        if kind == "response":
                            payload = f["payload"]
                            n, html = len(payload), payload.decode("utf-8", "replace")
                            said = digest(payload)
                        else:
                            n, html = int(f.get("warc-payload-length", 0)), None
                        url = f.get("warc-target-uri")
                        rows.append((page_number(f.get("warc-record-id")), None if url is None else unquote(url), kind, page_number(f.get("warc-refers-to")), n, said, html))
                        held += n
                        if held > 16 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return tasks.mapInArrow(apply, RECORD)


def remove(folder: str) -> None:
    """Delete the archives below ``folder``."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    if fs.get_file_info(root).type != pyarrow.fs.FileType.NotFound:
        fs.delete_dir(root)

