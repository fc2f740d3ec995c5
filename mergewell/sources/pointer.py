"""A numbered sequence of small documents, the last of which is the current one.

Publishing is a compare-and-swap: number ``n + 1`` can be published once, by whoever is first, and appears
whole or not at all.  Local folders use a hard link, file systems with an atomic rename that refuses an
existing target use that; an object store has neither, so it must be one whose creation of an object is
conditional, which its user has to state.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

#: Schemes of file systems whose rename is atomic and fails where the target is there.
RENAMING = {"hdfs", "viewfs", "webhdfs", "abfs", "abfss", "ofs", "o3fs"}


class LostRace(FileExistsError):
    """Another writer has published this number."""


class Pointer:
    """``folder`` is any path that Spark reads and writes."""

    def __init__(self, spark: SparkSession, folder: str, conditional_create: bool = False):
        self.folder, self.conditional_create = folder.rstrip("/"), conditional_create
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.scheme = self.fs.getUri().getScheme()

    def numbers(self) -> list[int]:
        folder = self.path(self.folder)
        if not self.fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, number: int) -> dict:
        source = self.fs.open(self.path(f"{self.folder}/{number}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def current(self) -> tuple[int, dict | None]:
        """The last number and its document; 0 and None where there is none."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, None)

    def _write(self, path, text: str) -> None:
        out = self.fs.create(path, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def publish(self, number: int, document: dict) -> None:
        """Publish ``document`` as ``number``; ``LostRace`` if that has been published."""
        text = json.dumps(document)
        target = self.path(f"{self.folder}/{number}")
        if self.scheme != "file" and self.scheme not in RENAMING:
            if not self.conditional_create:
                raise RuntimeError(f"{self.scheme}: say that this store creates objects conditionally, or use another")
            try:
                return self._write(target, text)
            except Exception as error:
                raise LostRace(f"{target}: {error}") from error
        draft = self.path(f"{self.folder}/_draft-{uuid.uuid4().hex}")
        self.fs.mkdirs(target.getParent())
        self._write(draft, text)
        try:
            if self.scheme == "file":
                files, local = self.jvm.java.nio.file.Files, lambda p: self.fs.pathToFile(p).toPath()
                try:
                    files.createLink(local(target), local(draft))
                except Exception as error:
                    if self.fs.exists(target):
                        raise LostRace(f"{target} was published by another writer") from error
                    raise
            elif self.fs.exists(target) or not self.fs.rename(draft, target):
                raise LostRace(f"{target} was published by another writer")
        finally:
            self.fs.delete(draft, False)
