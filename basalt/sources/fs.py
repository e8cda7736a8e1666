"""The few file operations that tables need, through Hadoop's FileSystem.

Tables may lie in any store that Spark reads, so nothing here uses the driver's own disk.
"""
from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession):
        self._sc = spark.sparkContext
        self._jvm = self._sc._jvm
        self._conf = self._sc._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_dir(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def mkdirs(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
        finally:
            stream.close()

    def write(self, path: str, text: str, replace: bool = False) -> None:
        """Writes aside and renames, so that a reader sees all of the text or none."""
        fs, p = self._at(path)
        aside = self._jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
        stream = fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if replace and fs.exists(p):
            fs.delete(p, False)
        if not fs.rename(aside, p):
            raise OSError(f"rename failed: {path}")

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
