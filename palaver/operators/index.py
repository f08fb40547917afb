"""The search index as Parquet: full build, incremental sweep, single files, version wipe.

An index is a manifest and what it names: segments (see ``segments``), a table of files,
vectors of dead sessions and deltas of their words.  A refresh reads only files that are
new or changed and writes them as one more segment.  The table of files has each
session's fingerprint, label, counts, and the segment that holds its present text;
searches need neither it nor any job to count: postings name their project, the
dictionary knows how many a term has.  Of more than SEGMENTS segments the smaller ones
are merged.

A refresh of much goes in waves of WAVE_BYTES, each published when it is done, so a
build that is ended goes on where it was, and its progress shows in the table of files.

Manifests are named by the writer's token and their number, and the highest counts;
readers see whole states.  What the present one no longer names is removed one refresh
later, when no reader starts with it.  Only writers remove anything, and only under the
lease; a reader that finds another version's index finds none.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.operators import segments as S
from palaver.operators.segments import DOC, postings
from palaver.sources import jsonl
from palaver.sources.lease import Lease, name_is_partial
from palaver.sources.store import Store

__all__ = ["DOC", "Index", "build", "classify", "fingerprints", "index_file", "open_index", "postings", "refresh", "status", "version"]

ENGINE = "3"
SEGMENTS = 8
#: Stale files named to the reader one by one, at most; beyond, their folder is scanned and joined.
NAMED = 10_000
#: Bytes of session files that one wave of a refresh reads, more or less.
WAVE_BYTES = 1 << 40
FILES = "session_path string, project string, project_display string, mtime long, size long, indexed_at long, segment string, sid long, n_blocks long, n_tokens long"


def version() -> str:
    """Engine version and a hash of the tables' columns."""
    shape = json.dumps([S.BLOCKS, S.POSTINGS, S.DICTIONARY, S.VECTORS, FILES, S.RUN])
    return f"{ENGINE}-{hashlib.sha256(shape.encode()).hexdigest()[:16]}"


def classify(listing: DataFrame, known: DataFrame) -> DataFrame:
    """(session_path, status): new, changed, unchanged or deleted, by mtime and size."""
    a = listing.select("session_path", F.col("mtime").alias("m"), F.col("size").alias("s"), F.lit(True).alias("here"))
    b = known.select("session_path", F.col("mtime").alias("km"), F.col("size").alias("ks"), F.lit(True).alias("there"))
    both = a.join(b, "session_path", "full_outer")
    status = (
        F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "deleted")
        .when(F.col("m").eqNullSafe(F.col("km")) & F.col("s").eqNullSafe(F.col("ks")), "unchanged").otherwise("changed")
    )
    return both.select("session_path", status.alias("status"))


@dataclass
class Index:
    """A state of an index, as its manifest had it when it was opened."""

    spark: SparkSession
    root: str
    meta: dict = field(default_factory=dict)

    @property
    def empty(self) -> bool:
        return not self.meta

    @property
    def segments(self) -> dict[str, dict]:
        return self.meta.get("segments", {})

    def _union(self, frames: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def files(self) -> DataFrame:
        """The fingerprint, label, segment and counts of each session."""
        return self.spark.read.schema(FILES).parquet(f"{self.root}/{self.meta['files']}") if self.meta else self.spark.createDataFrame([], FILES)

    def vectors(self) -> DataFrame:
        """(segment, word, bits): the dead sessions of all segments."""
        dead = self.meta.get("dead")
        return self.spark.read.schema(S.VECTORS).parquet(f"{self.root}/{dead}") if dead else self.spark.createDataFrame([], S.VECTORS)

    def table(self, segment: str, name: str, schema: str, only: Iterable[int] | None = None) -> DataFrame:
        """What a segment holds of present texts, of some parts only if these are given."""
        found = S.read(self.spark, f"{self.root}/{segment}/{name}", schema, only)
        if self.segments[segment].get("dead"):
            found = S.alive(found, self.vectors().filter(F.col("segment") == segment).drop("segment"))
        return found.drop("part").withColumn("segment", F.lit(segment))

    def blocks(self, among: Column | None = None, homes: dict[str, set[int]] | None = None) -> DataFrame:
        """The blocks of all present texts; ``homes`` are the parts to open by segment."""
        found = [self.table(s, "blocks", S.BLOCKS, homes.get(s, ()) if homes is not None else None) for s in self.segments if homes is None or homes.get(s)]
        out = self._union(found, S.BLOCKS.replace("part int", "segment string"))
        return out if among is None else out.filter(among)

    def block_homes(self, docs: Iterable[tuple[str, int]]) -> dict[str, set[int]]:
        """The parts of blocks (path, line), by segment."""
        named = {(path, line // S.RUN) for path, line in docs}
        return {s: {S.home_of(k, m["blocks"]) for k in named} for s, m in self.segments.items()}

    def postings(self, homes: dict[str, set[int]] | None = None) -> DataFrame:
        """The postings of all present texts; ``homes`` are the parts to open by segment."""
        found = [self.table(s, "postings", S.POSTINGS, homes.get(s, ()) if homes is not None else None) for s in self.segments if homes is None or homes.get(s)]
        return self._union(found, S.POSTINGS.replace("part int", "segment string"))

    def posting_homes(self, terms: Iterable[tuple[str, str, int]]) -> dict[str, set[int]]:
        """The parts of terms (segment, term, salts), by segment."""
        out: dict[str, set[int]] = {}
        for segment, term, salts in terms:
            out.setdefault(segment, set()).update(S.home_of((term, k), self.segments[segment]["postings"]) for k in range(salts))
        return out

    def dictionary(self, keys: Iterable[int] | None = None) -> DataFrame:
        """(key, term, n, own, df, cf, salts, segment): counts by segment and key, of the keys given only; deltas as rows without salts."""
        tables = [(s, f"{s}/dictionary", m["dictionary"]) for s, m in self.segments.items()]
        tables += [(s, name, n) for s, name, n in self.meta.get("deltas", []) if s in self.segments]
        found = []
        for segment, name, n in tables:
            rows = S.read(self.spark, f"{self.root}/{name}", S.DICTIONARY, None if keys is None else {k % n for k in keys})
            found.append((rows if keys is None else rows.filter(F.col("key").isin(sorted(keys)))).drop("part").withColumn("segment", F.lit(segment)))
        return self._union(found, S.DICTIONARY.replace("part int", "segment string"))

    def vocabulary(self) -> DataFrame:
        """(term, n, df, cf): the terms of all present texts."""
        return self.dictionary().filter("own").groupBy("term", "n").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df > 0")

    def totals(self) -> tuple[int, int]:
        """Number of blocks and of their words."""
        if "n_blocks" in self.meta:
            return self.meta["n_blocks"], self.meta["n_tokens"]
        row = self.files().agg(F.coalesce(F.sum("n_blocks"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
        return int(row[0]), int(row[1])


def manifests(store: Store) -> list[str]:
    """The names of manifests, the present one last."""
    return sorted(name for name, _ in store.names() if re.match(r"_meta-\d{12}-\d{12}\.json$", name))


def _read(store: Store) -> dict:
    """The present manifest; writers may remove an older one meanwhile."""
    for _ in range(10):
        names = manifests(store)
        if not names:
            return {}
        text = store.read(names[-1])
        if text:
            return json.loads(text)
    return {}


def open_index(spark: SparkSession, root: str) -> Index:
    """The present state; an empty one if there is none or it is another version's."""
    meta = _read(Store(spark, root))
    return Index(spark, root.rstrip("/"), meta if meta.get("version") == version() else {})


def fingerprints(spark: SparkSession, root: str) -> DataFrame:
    return open_index(spark, root).files().select("session_path", "mtime", "size")


def status(spark: SparkSession, corpus: str, root: str) -> dict:
    """Sessions indexed and on disk, blocks, and whether a writer is at work; while one is, the counts grow wave by wave."""
    own = open_index(spark, root)
    on_disk = jsonl.list_sessions(spark, corpus)
    indexed = own.files().join(on_disk, "session_path", "left_semi").count()
    return {"indexed_sessions": indexed, "total_sessions": on_disk.count(), "blocks": own.totals()[0], "building": bool(Lease(Store(spark, root)).tokens())}


def _fresh(spark: SparkSession, corpus: str, stale: DataFrame, n: int, home: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Blocks and labels of the stale files; no others are read, and these once, into ``folder``."""
    if n <= NAMED:
        lines = jsonl.read_lines(spark, corpus, [r["session_path"] for r in stale.select("session_path").collect()])
    else:
        lines = jsonl.read_lines(spark, corpus).join(stale.select("session_path"), "session_path", "left_semi")
    lines.write.parquet(folder)
    held = spark.read.schema(jsonl.LINES).parquet(folder)
    return jsonl.search_blocks(held).drop("project"), jsonl.project_labels(held, home)


class Writer:
    """One refresh: what it reads, writes and publishes under its lease."""

    def __init__(self, spark: SparkSession, root: str, lease: Lease) -> None:
        self.spark, self.store, self.lease = spark, Store(spark, root), lease
        self.meta, self.made = _read(self.store), set()
        if self.meta and self.meta.get("version") != version():  # another engine's files
            self._keep(set())
            self.meta = {}
        else:
            self._keep(self._named(self.meta) | set(self.meta.get("retired", [])) | set(manifests(self.store)[-1:]))
        self.own = Index(spark, root.rstrip("/"), self.meta)

    def _keep(self, names: set[str]) -> None:
        """Remove all else: what writers left that died, and what no reader starts with."""
        for name, _ in self.store.names():
            if name not in names and not name.startswith(("_lock-", "_beat-")) and not name_is_partial(name):
                self.store.delete(name)

    @staticmethod
    def _named(meta: dict) -> set[str]:
        found = {*meta.get("segments", {}), *(name for _, name, _ in meta.get("deltas", [])), meta.get("files"), meta.get("dead")}
        return {name.split("/")[0] for name in found - {None}}

    def _name(self, kind: str) -> str:
        name = f"{kind}-{self.meta.get('number', 0) + 1}-{uuid.uuid4().hex[:8]}"
        self.made.add(name)
        return name

    def _drop(self, name: str) -> None:
        """Remove what was made for a while."""
        self.made.discard(name)
        self.store.delete(name)

    def _segment(self, blocks: DataFrame, sessions: DataFrame, size: int) -> tuple[str, dict, DataFrame]:
        """Write a segment: its name, its entry, and (session_path, labels, sid, n_blocks, n_tokens) of all its sessions."""
        name = self._name("segment")
        folder = f"{self.own.root}/{name}"
        entry = S.write(blocks, sessions, size, folder) | {"size": size}
        held = S.read(self.spark, f"{folder}/blocks", S.BLOCKS).groupBy("session_path").agg(F.count("*").alias("n_blocks"), F.sum(F.size(T.tokens(F.col("text"))).cast("long")).alias("n_tokens"))
        told = self.spark.read.schema(S.SESSIONS).parquet(f"{folder}/sessions").join(held, "session_path", "left")
        return name, entry, told.withColumn("segment", F.lit(name)).fillna(0, ["n_blocks", "n_tokens"])

    def _bury(self, dead: DataFrame, segments: dict[str, dict], deltas: list) -> str | None:
        """Vectors and deltas of ``dead`` sessions (session_path, segment, sid); the vectors' new name."""
        folder = f"{self.own.root}/{self._name('gone')}"
        dead.write.parquet(folder)
        dead = self.spark.read.schema(dead.schema).parquet(folder)
        counts = {r["segment"]: r["count"] for r in dead.groupBy("segment").count().collect()}
        if not counts:
            self._drop(folder.rsplit("/", 1)[-1])
            return self.meta.get("dead")
        for segment, n in counts.items():
            segments[segment] = segments[segment] | {"dead": segments[segment].get("dead", 0) + n}
            gone = self.own.table(segment, "blocks", S.BLOCKS).join(dead.filter(F.col("segment") == segment).select("sid"), "sid", "left_semi")
            less = S.postings(gone).groupBy("term").agg((-F.count("*")).alias("df"), (-F.sum("tf")).alias("cf")).withColumn("salts", F.lit(0))
            name = self._name("delta")
            less.write.parquet(f"{self.own.root}/{name}/terms")
            held = self.spark.read.schema(less.schema).parquet(f"{self.own.root}/{name}/terms")
            deltas.append([segment, f"{name}/dictionary", S.write_dictionary(held, held.count(), f"{self.own.root}/{name}/dictionary")])
        name = self._name("dead")
        both = self.own.vectors().unionByName(S.vectors(dead))
        both.groupBy("segment", "word").agg(F.bit_or("bits").alias("bits")).write.parquet(f"{self.own.root}/{name}")
        self._drop(folder.rsplit("/", 1)[-1])
        return name

    def _publish(self, segments: dict[str, dict], files: str, deltas: list, dead: str | None) -> None:
        """The new manifest; only while the lease is held."""
        after = Index(self.spark, self.own.root, {"segments": segments, "files": files})
        n_blocks, n_tokens = after.totals()
        number = self.meta.get("number", 0) + 1
        deltas = [d for d in deltas if d[0] in segments]
        meta = {"version": version(), "number": number, "token": self.lease.token, "segments": segments, "files": files, "deltas": deltas, "dead": dead, "n_blocks": n_blocks, "n_tokens": n_tokens}
        meta["retired"] = sorted((self._named(self.meta) | {n for n in self.made if n.startswith(("segment-", "files-"))}) - self._named(meta))
        self.lease.check()
        old = manifests(self.store)
        self.store.write(f"_meta-{self.lease.token:012d}-{number:012d}.json", json.dumps(meta))
        for name in [*self.meta.get("retired", []), *old[:-1]]:
            self.store.delete(name)
        self.meta, self.made, self.own = meta, set(), Index(self.spark, self.own.root, meta)

    def wave(self, corpus: str, found: DataFrame, listing: DataFrame, home: str) -> None:
        """Bring sessions ``found`` (session_path, status) up to date; all others stay as they are."""
        root, known = self.own.root, self.own.files()
        stale = found.filter("status in ('new', 'changed')")
        n = stale.count()
        segments, deltas = dict(self.own.segments), list(self.meta.get("deltas", []))
        gone = known.join(found.filter("status = 'deleted'"), "session_path", "left_semi")
        read = None
        if n:
            size = listing.join(stale, "session_path", "left_semi").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
            lines = self._name("lines")
            blocks, labels = _fresh(self.spark, corpus, stale, n, home, f"{root}/{lines}")
            segment, entry, told = self._segment(blocks, labels, size)
            segments[segment] = entry
            read = listing.select("session_path", "mtime", "size").join(told, "session_path").withColumn("indexed_at", F.lit(int(time.time())).cast("long"))
            read = read.select(*[c.split()[0] for c in FILES.split(", ")])
            # what could not be read keeps its old text
            gone = gone.unionByName(known.join(read.select("session_path"), "session_path", "left_semi"))
        keep = known.join(gone.select("session_path"), "session_path", "left_anti")
        files = self._name("files")
        (keep.unionByName(read) if read is not None else keep).write.parquet(f"{root}/{files}")
        used = {r[0] for r in Index(self.spark, root, {"segments": segments, "files": files}).files().select("segment").distinct().collect()}
        segments = {s: m for s, m in segments.items() if s in used}  # what is all dead goes as it is
        dead = self._bury(gone.select("session_path", "segment", "sid").filter(F.col("segment").isin(sorted(used))), segments, deltas)
        self._publish(segments, files, deltas, dead)
        if n:
            self._drop(lines)

    def merge(self) -> None:
        """The smaller half of the segments as one, so each text is rewritten a few times only, however often files change."""
        by_size = sorted(self.own.segments, key=lambda s: (self.own.segments[s]["rows"], s))
        chosen = by_size[: max(2, len(by_size) - SEGMENTS // 2)]
        own = Index(self.spark, self.own.root, self.meta | {"segments": {s: self.own.segments[s] for s in chosen}})
        files = self.own.files()
        inside = files.filter(F.col("segment").isin(chosen))
        labels = inside.select("session_path", "project", "project_display")
        name, entry, told = self._segment(own.blocks().drop("project", "sid", "segment"), labels, sum(m["size"] for m in own.segments.values()))
        moved = inside.drop("segment", "sid", "n_blocks", "n_tokens", "project", "project_display").join(told, "session_path").select(*[c.split()[0] for c in FILES.split(", ")])
        table = self._name("files")
        files.filter(~F.col("segment").isin(chosen)).unionByName(moved).write.parquet(f"{self.own.root}/{table}")
        segments = {s: m for s, m in self.own.segments.items() if s not in chosen} | {name: entry}
        self._publish(segments, table, self.meta.get("deltas", []), self.meta.get("dead"))


def refresh(spark: SparkSession, corpus: str, root: str, paths: list[str] | Column | None = None, home: str = "/", wait_s: float = 60, wave_bytes: int | None = None) -> dict[str, int]:
    """Bring the index up to date, for ``paths`` only if given; counts by status.  Nothing is written if nothing changed.

    Many paths are better given as a condition on ``session_path``, which names none of them on the driver.

    A changed file that cannot be read keeps its old text and fingerprint; a new one stays unknown.  Stale files are
    taken in waves of ``wave_bytes``.
    """
    with Lease(Store(spark, root), wait_s) as lease:
        writer = Writer(spark, root, lease)
        listing, known = jsonl.list_sessions(spark, corpus), writer.own.files()
        if paths is not None:
            chosen = paths if isinstance(paths, Column) else F.col("session_path").isin(paths)
            listing, known = listing.filter(chosen), known.filter(chosen)
        work = f"{writer.own.root}/{writer._name('stale')}"
        sized = classify(listing, known).join(listing.select("session_path", "size", "mtime", "project"), "session_path", "left")
        # what was listed when the refresh began, dealt into waves by a hash; one file is never split over two
        told = sized.groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).collect()
        counts = {r["status"]: r["n"] for r in told}
        if set(counts) <= {"unchanged"} and (writer.meta or not counts):
            return counts
        waves = max(1, -(-sum(r["size"] for r in told if r["status"] in ("new", "changed")) // (wave_bytes or WAVE_BYTES)))
        sized.filter("status <> 'unchanged'").withColumn("wave", F.pmod(F.xxhash64("session_path"), F.lit(waves)).cast("int")).write.parquet(work)
        del listing, known, sized  # the driver holds every file's status with a listing; a wave makes one of its own
        held = spark.read.schema("session_path string, status string, size long, mtime long, project string, wave int").parquet(work)
        for k in range(waves):
            now = held.filter(F.col("wave") == k)
            if waves == 1 or not now.isEmpty():
                writer.wave(corpus, now.select("session_path", "status"), now.filter("status <> 'deleted'").select("session_path", "project", "mtime", "size"), home)
            if len(writer.own.segments) > SEGMENTS:
                writer.merge()
        writer._drop(work.rsplit("/", 1)[-1])
    return counts


def build(spark: SparkSession, corpus: str, root: str, home: str = "/") -> dict[str, int]:
    """A full build if nothing is indexed yet, else a sweep: sessions and blocks before and after, and the counts by status."""
    before = open_index(spark, root).files().count()
    counts = refresh(spark, corpus, root, home=home)
    after = open_index(spark, root)
    return {"before": before, "sessions": after.files().count(), "blocks": after.totals()[0], **counts}


def index_file(spark: SparkSession, corpus: str, root: str, path: str, home: str = "/") -> dict[str, int]:
    """Refresh one file at once, as after a save."""
    return refresh(spark, corpus, root, [path], home)
