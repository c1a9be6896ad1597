"""Small files of a table through Hadoop's FileSystem, so that local, HDFS and object-store paths all work."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._new_path = self._jvm.org.apache.hadoop.fs.Path  # each part of such a name is a call
        top = self._new_path(self.root)
        self._fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._new_path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        if not self._fs.exists(p):
            return []
        paths = self._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(self._fs.listStatus(p))
        if not len(paths):
            return []
        top = f"{paths[0].getParent().toString().rstrip('/')}/"  # all names in one string: a call for each would take longer than the listing
        return sorted(self._jvm.org.apache.commons.lang3.ArrayUtils.toString(paths)[1 + len(top) : -1].split(f",{top}"))

    def size(self, folder: str) -> int:
        p = self._path(folder)
        return int(self._fs.getContentSummary(p).getLength()) if self._fs.exists(p) else 0

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file whole or not at all; False where the name is taken. Two writers of one name: one wins."""
        draft = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        self._fs.mkdirs(self._path(name).getParent())
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            self._put(draft, self._path(name))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            return False
        finally:
            self._fs.delete(draft, False)
        return True

    def _put(self, draft, final) -> None:
        """Give the draft its final name in one step, which fails where the name is taken."""
        if self._fs.getUri().getScheme() == "file":  # a rename would replace what is there; a second link to the file can't
            at = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
            self._jvm.java.nio.file.Files.createLink(at(final), at(draft))
            return
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        keep = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(draft, final, keep)

    def move(self, name: str, to: str) -> None:
        """Give a file or folder another name in a folder that is there; what has that name goes."""
        at = self._path(to)
        self._fs.delete(at, True)
        if not self._fs.rename(self._path(name), at):
            raise OSError(f"{self.root}/{name} can't be moved to {to}")

    def copy(self, name: str, to: str) -> None:
        """A copy under another name in a folder that is there; what has that name goes."""
        self.delete(to)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path(name), self._fs, self._path(to), False, self.spark.sparkContext._jsc.hadoopConfiguration())

    def delete(self, name: str) -> bool:
        return bool(self._fs.delete(self._path(name), True))
