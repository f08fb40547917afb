"""Session files as a stream: what was appended since the last batch.

Spark's file source follows new paths only, while sessions grow in place.  Here an
offset names a snapshot of the listing: how far each file was read, always up to a line
break.  A batch is the byte ranges between two snapshots: a long one is several tasks,
short ones share a task.  A file that became shorter or was replaced is read anew from
its start, under the next ``version``.  Snapshots lie beside the query's checkpoint, so a query
that starts again goes on where it was and repeats nothing.

Columns: session_path, version, at (the byte where the line begins), line.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "session_path string, version int, at long, line string"
NAME = "palaver_sessions"
#: Bytes that one task reads, about.
RANGE_BYTES = 64 << 20
#: Bytes read at once in search of a line break; opening a file counts as many.
STEP = 1 << 16
#: New or grown files that the driver looks into at a time, and for how many it holds what came of that together.
LOOKS, LOOKED = 16, 1024
#: Bytes of lines in one Arrow batch, about.
BATCH_BYTES = 4 << 20
ARROW = pa.schema([("session_path", pa.string()), ("version", pa.int32()), ("at", pa.int64()), ("line", pa.string())])


class Ranges(InputPartition):
    """What one task reads: (path, version, start, stop) of each range."""

    def __init__(self, parts: list[tuple[str, int, int, int]]) -> None:
        self.parts = parts


class SessionStream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root, self.state = options["path"].rstrip("/"), options["snapshots"].rstrip("/")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def _open(self, uri: str) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")

    def _snapshot(self, number: int) -> Iterator[tuple[str, list]]:
        """path, [version, read up to, size, mtime, first bytes], a line each; none for number 0."""
        if not number:
            return
        fs, root = self._open(self.state)
        with fs.open_input_stream(f"{root}/{number:012d}.json") as f:
            for line in io.TextIOWrapper(f, "utf-8"):
                found = json.loads(line)
                if isinstance(found, dict):  # as snapshots were written before
                    yield from found.items()
                else:
                    yield found[0], found[1:]

    def _last(self) -> int:
        fs, root = self._open(self.state)
        fs.create_dir(root, recursive=True)
        names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(root)) if i.base_name.endswith(".json")]
        return max((int(n[:12]) for n in names), default=0)

    def _whole_lines(self, f: pafs.NativeFile, start: int, size: int) -> int:
        """Up to where the file consists of whole lines; it is read backwards to the last break."""
        stop = size
        while stop > start:
            a = max(start, stop - STEP)
            found = f.read_at(stop - a, a).rfind(b"\n")
            if found >= 0:
                return a + found + 1
            stop = a
        return start

    def _look(self, fs: pafs.FileSystem, i: pafs.FileInfo, was: list | None) -> list:
        """The entry of a new or changed file, which is opened once.

        By its first bytes a file that was replaced by a longer one is told from one that grew.
        """
        version, start, head = (was[0], was[1], was[4]) if was else (0, 0, "")
        with fs.open_input_file(i.path) as f:
            now = f.read_at(min(i.size, 64), 0).hex()
            if was and (i.size < start or not now.startswith(head)):
                version, start = version + 1, 0
            return [version, self._whole_lines(f, start, i.size), i.size, i.mtime_ns, now]

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        last = self._last()
        known = dict(self._snapshot(last))
        fs, root = self._open(self.root)
        now, fresh = {}, []
        for project in fs.get_file_info(pafs.FileSelector(root)):
            if project.type != pafs.FileType.Directory or project.base_name in ("subagents", "tool-results"):
                continue
            for i in fs.get_file_info(pafs.FileSelector(project.path)):
                if i.type != pafs.FileType.File or not i.base_name.endswith(".jsonl") or i.base_name.startswith("agent-"):
                    continue
                was = known.get(i.path)
                if was and was[2:4] == [i.size, i.mtime_ns]:
                    now[i.path] = was
                else:
                    fresh.append(i)
        with ThreadPoolExecutor(LOOKS) as pool:
            for k in range(0, len(fresh), LOOKED):
                some = fresh[k : k + LOOKED]
                now.update(zip([i.path for i in some], pool.map(lambda i: self._look(fs, i, known.get(i.path)), some), strict=True))
        del fresh
        # deleted files stay known, so one that comes back is a new version
        merged = known | now
        for path in known.keys() - now.keys():
            version, _, size, *_ = known[path]
            merged[path] = [version + (size >= 0), 0, -1, 0, ""]
        if merged.keys() == known.keys() and all(x[:2] == known[p][:2] for p, x in merged.items() if x[1] or known[p][1]):
            return {"snapshot": last}
        own, folder = self._open(self.state)
        name = f"{folder}/{last + 1:012d}.json"
        with own.open_output_stream(f"{name}.tmp") as out:
            for path, entry in merged.items():
                out.write(json.dumps([path, *entry]).encode() + b"\n")
        own.move(f"{name}.tmp", name)
        return {"snapshot": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        """Tasks of ``range_bytes`` at most, where opening a file counts as STEP: very many small files are few tasks."""
        before = {path: entry[:2] for path, entry in self._snapshot(start["snapshot"])}
        out, parts, held = [], [], 0
        for path, version, upto in sorted((path, entry[0], entry[1]) for path, entry in self._snapshot(end["snapshot"])):
            was = before.get(path, [0, 0])
            a = was[1] if was[0] == version else 0
            while a < upto:
                z = min(upto, a + self.range_bytes)
                if parts and held + z - a + STEP > self.range_bytes:
                    out.append(Ranges(parts))
                    parts, held = [], 0
                parts.append((path, version, a, z))
                held += z - a + STEP
                a = z
        return [*out, Ranges(parts)] if parts else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        """The lines of the ranges, in Arrow batches; one batch may hold lines of many files."""
        fs, root = self._open(self.root)
        # named as Spark names files
        shown = re.sub("^file:/+", "/", self.root)
        shown = ("file:" if shown.startswith("/") else "") + shown
        rows, held = [], 0
        for path, version, start, stop in partition.parts:
            name = shown + path[len(root) :]
            for at, line in self._lines(fs, path, start, stop):
                rows.append((name, version, at, line))
                held += len(line) + 64
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    def _lines(self, fs: pafs.FileSystem, path: str, start: int, stop: int) -> Iterator[tuple[int, str]]:
        """The lines that begin in the range, from the first on that follows a break; the last may end beyond it."""
        with fs.open_input_file(path) as f:
            at = start
            if at:
                # a range that begins within a line leaves it to the one before
                f.seek(at - 1)
                at += self._skip(f)
            f.seek(at)
            rest, pos = b"", at
            while pos - len(rest) < stop:
                data = f.read(STEP)
                if not data:
                    return
                *lines, tail = (rest + data).split(b"\n")
                begin = pos - len(rest)
                for line in lines:
                    if begin >= stop:
                        return
                    yield begin, line.decode("utf-8", "replace")
                    begin += len(line) + 1
                rest, pos = tail, pos + len(data)

    def _skip(self, f: pafs.NativeFile) -> int:
        """Bytes up to the next line; the file stands one byte before the range."""
        skipped = -1
        while data := f.read(STEP):
            found = data.find(b"\n")
            if found >= 0:
                return skipped + found + 1
            skipped += len(data)
        return skipped + 1

    def commit(self, end: dict) -> None:
        """Snapshots before the last batch's are needed no more."""
        fs, root = self._open(self.state)
        for i in fs.get_file_info(pafs.FileSelector(root)):
            if i.base_name.endswith(".json") and int(i.base_name[:12]) < end["snapshot"] - 1:
                fs.delete_file(i.path)


class SessionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> SessionStream:
        return SessionStream(dict(self.options))


def appended(spark: SparkSession, root: str, snapshots: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of the lines appended to the sessions below ``root``; ``snapshots`` is a folder of the query's own."""
    spark.dataSource.register(SessionSource)
    return spark.readStream.format(NAME).option("snapshots", snapshots).option("rangebytes", range_bytes).load(root)
