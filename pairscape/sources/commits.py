"""A commit log beside tables: what an entry names is visible, whatever else lies in the folders."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class CommitLog:
    """Small JSON entries in one folder, on any file system that Hadoop reads.

    An entry is written under a temporary name and renamed to its own, so that
    readers see it whole or not at all; a name is given once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark.sparkContext._jvm
        self.folder = self._path(folder)
        self.files = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts):
        return self.jvm.org.apache.hadoop.fs.Path(*parts)

    def entries(self) -> dict[str, dict]:
        """All entries by name, in the order of names."""
        if not self.files.exists(self.folder):
            return {}
        names = sorted(f.getPath().getName() for f in self.files.listStatus(self.folder))
        return {n.removesuffix(".json"): self._read(n) for n in names if n.endswith(".json")}

    def _read(self, name: str) -> dict:
        stream = self.files.open(self._path(self.folder, name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def add(self, name: str, entry: dict) -> None:
        """Make ``entry`` visible as ``name``; an error if the name is taken."""
        target = self._path(self.folder, f"{name}.json")
        self.files.mkdirs(self.folder)
        half = self._path(self.folder, f".{uuid.uuid4().hex}.tmp")
        stream = self.files.create(half, True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        if self.files.exists(target) or not self.files.rename(half, target):
            self.files.delete(half, False)
            raise RuntimeError(f"{target} was written by another run")
