"""URL rules in a sorted digest array (5).

Rules are (action, host, path prefix).  Their 64-bit xxHash keys form a sorted
array in a file that tasks map into memory; a URL probes it, by vectorised binary
search, with each of its parent hosts joined to each prefix length in use, and the
stored strings confirm the hits, so hash collisions cannot decide.

The longest rule that fits wins, at equal length the one of the longer host.
Without a rule the verdict is ``allow``.

The file lies in the shared checkpoint folder.  Workers map it where it is, if
their file system can, and else a private copy of it.

Defined results: a null URL and one without ``://`` have empty host and path and
fit no rule.  Repeated rows give repeated results; URLs of any length are taken
whole; an empty table has an empty result.  Other columns are not read.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import scratch

#: The rules of the query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT = "allow"
MAGIC = b"PLVRURL1"
LOWER = {k: k + 32 for k in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Lower-cased host and path."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((at for c in "/?#" if (at := rest.find(c)) >= 0), default=len(rest))
    host, rest = rest[:end].translate(LOWER), rest[end:]
    end = min((at for c in "?#" if (at := rest.find(c)) >= 0), default=len(rest))
    return host, rest[:end]


def write_index(spark: SparkSession, rules: tuple[tuple[str, str, str], ...]) -> str:
    """Write the digest array of the rules; returns its URI.

    Layout: magic, counts, prefix lengths, sorted keys, offsets of the strings, strings.
    """
    rows = sorted({(xxhash.xxh64_intdigest((h + p).encode()), action, h, p) for action, h, p in rules})
    strings = [f"{action}\t{h}\t{p}".encode() for _, action, h, p in rows]
    lengths = sorted({len(p) for _, _, p in rules})
    offsets = np.cumsum([0, *map(len, strings)], dtype="<u8")
    body = MAGIC + struct.pack("<QQ", len(rows), len(lengths)) + np.array(lengths, "<u8").tobytes()
    body += np.array([r[0] for r in rows], "<u8").tobytes() + offsets.tobytes() + b"".join(strings)
    uri = scratch(spark, "url-rules") + ".bin"
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(body)
    return uri


class Index:
    """The digest array, mapped into memory."""

    def __init__(self, uri: str) -> None:
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        if isinstance(fs, pyarrow.fs.LocalFileSystem):
            raw = np.memmap(path, np.uint8, "r")
        else:
            with tempfile.NamedTemporaryFile() as own, fs.open_input_stream(path) as source:
                while part := source.read(1 << 20):
                    own.write(part)
                own.flush()
                raw = np.memmap(own.name, np.uint8, "r")  # the mapping outlives the name
        n, m = struct.unpack("<QQ", raw[8:24].tobytes())
        at = 24
        self.lengths = raw[at : at + 8 * m].view("<u8").tolist()
        at += 8 * m
        self.keys = raw[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.offsets = raw[at : at + 8 * (n + 1)].view("<u8")
        self.strings = raw[at + 8 * (n + 1) :]

    def entry(self, k: int) -> tuple[str, str, str]:
        return tuple(self.strings[int(self.offsets[k]) : int(self.offsets[k + 1])].tobytes().decode().split("\t"))

    def find(self, urls: list[tuple[str, str]]) -> list[tuple[str, str, str] | None]:
        """The deciding rule of each (host, path)."""
        owner, keys, said = [], [], []
        for k, (host, path) in enumerate(urls):
            parent = host
            while parent:
                for n in self.lengths:
                    if n <= len(path):
                        owner.append(k)
                        said.append((parent, path[:n]))
                        keys.append(xxhash.xxh64_intdigest((parent + path[:n]).encode()))
                parent = parent.partition(".")[2]
        best: list[tuple[str, str, str] | None] = [None] * len(urls)
        probe = np.array(keys, np.uint64)
        at = np.searchsorted(self.keys, probe)
        hits = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, max(0, len(self.keys) - 1))] == probe)) if len(self.keys) else []
        for i in hits:
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == probe[i]:  # equal digests stand together
                rule = self.entry(k)
                if rule[1:] == said[i]:
                    now = best[owner[i]]
                    if now is None or (len(rule[1]) + len(rule[2]), len(rule[1])) > (len(now[1]) + len(now[2]), len(now[1])):
                        best[owner[i]] = rule
                k += 1
        return best


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url)."""
    uri = write_index(pages.sparkSession, rules)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(uri)
        for b in batches:
            urls = [split_url(u) for u in b.column(1).to_pylist()]
            found = index.find(urls)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([h for h, _ in urls], pa.string()), pa.array([p for _, p in urls], pa.string()),
                    pa.array([r and r[1] + r[2] for r in found], pa.string()), pa.array([r[0] if r else DEFAULT for r in found], pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url").mapInArrow(apply, f"page_id {kind}, host string, path string, rule string, verdict string")
