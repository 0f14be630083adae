"""Small files and folders of the store that Spark itself uses (any Hadoop file system)."""

from __future__ import annotations

import datetime as dt

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import SparkSession


class Store:
    """Paths under one root; nothing here reads data files."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self.root = spark._jvm, root.rstrip("/")
        base = self._path("")
        self._fs = base.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        """Names in a folder, in order; none if it is not there."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def modified(self, name: str) -> dt.datetime | None:
        """When the newest file at or directly under a path was written (UTC)."""
        if not self.exists(name):
            return None
        status = self._fs.getFileStatus(self._path(name))
        times = [status.getModificationTime()]
        if status.isDirectory():
            times += [s.getModificationTime() for s in self._fs.listStatus(self._path(name)) if s.isFile()]
        return dt.datetime.fromtimestamp(max(times) / 1000, dt.timezone.utc)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not be there yet; False if it is."""
        path = self._path(name)
        self._fs.mkdirs(path.getParent())
        try:
            stream = self._fs.create(path, False)
        except Exception as error:
            if self.exists(name) and isinstance(error, CapturedException) or "already exists" in str(error):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
