"""Small files through Hadoop's file systems, so that any path Spark knows will do."""

from __future__ import annotations

import os
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder; a local one only where that isn't set and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"/tmp/checkpoints/{os.getpid()}"
    return f"{root.rstrip('/')}/tidemark-{name}-{uuid4().hex}"


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def mkdirs(self) -> None:
        self.fs.mkdirs(self._path(""))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(""))) if self.fs.exists(self._path("")) else []

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_new(self, name: str, raw: bytes) -> None:
        """Writes under a temporary name of its own and gives that file its name in one step, which fails if the name is
        taken: by a rename, which Hadoop's file systems refuse then, or by a link on a local disk, where they don't."""
        temp, to = self._path(f".{name}.{uuid4().hex}.tmp"), self._path(name)
        stream = self.fs.create(temp, False)
        try:
            stream.write(bytearray(raw))
            stream.hsync()
        finally:
            stream.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                at = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(at(to), at(temp))
            elif not self.fs.rename(temp, to):
                raise FileExistsError(name)
        except Py4JJavaError as e:
            raise FileExistsError(name) from e
        finally:
            self.fs.delete(temp, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength()
