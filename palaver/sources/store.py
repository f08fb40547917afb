"""Small files beside Spark's tables, through Hadoop's file systems: whatever Spark can reach, this can."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Store:
    """Files below ``root``, named by their path relative to it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._hadoop = self._jvm.org.apache.hadoop.fs
        self._gateway = spark.sparkContext._gateway

    def path(self, name: str = ""):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self.path().getFileSystem(self._conf)

    def exists(self, name: str = "") -> bool:
        return self._fs().exists(self.path(name))

    def matches(self, pattern: str) -> bool:
        """Whether any path below the root fits a glob pattern."""
        found = self._fs().globStatus(self.path(pattern))
        return found is not None and len(found) > 0

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self._fs().open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str, overwrite: bool) -> None:
        stream = self._fs().create(self.path(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replace a file in one step: readers see the old text or the new."""
        own = f"{name}.{uuid.uuid4().hex}"
        self._put(own, text, False)
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        option = self._gateway.new_array(kind, 1)
        option[0] = kind.OVERWRITE
        context = self._hadoop.FileContext.getFileContext(self.path().toUri(), self._conf)
        qualified = lambda p: self._fs().makeQualified(p)
        context.rename(qualified(self.path(own)), qualified(self.path(name)), option)

    def create(self, name: str, text: str) -> bool:
        """Make a file that must not exist yet; False if it does."""
        try:
            self._put(name, text, False)
        except Exception as error:  # Py4J wraps the file system's own exceptions
            if "exists" in str(error):
                return False
            raise
        return True

    def names(self, folder: str = "") -> list[tuple[str, int]]:
        """(name, size) of the entries of a folder; none if it is absent."""
        if not self.exists(folder):
            return []
        return sorted((s.getPath().getName(), s.getLen()) for s in self._fs().listStatus(self.path(folder)))

    def copy(self, source: str, name: str) -> None:
        fs = self._fs()
        self._hadoop.FileUtil.copy(fs, self._hadoop.Path(source), fs, self.path(name), False, True, self._conf)

    def delete(self, name: str = "") -> None:
        self._fs().delete(self.path(name), True)
