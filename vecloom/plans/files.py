"""Small files and folders on any Hadoop file system, through the session's JVM."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from vecloom.errors import InvalidArgument


class SharedFile:
    """One file on any Hadoop file system: a plain path, or an address such as file:, http:, https: or hdfs:."""

    def __init__(self, spark: SparkSession, source: str):
        self._jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path(source)
        try:
            self._fs = self._path.getFileSystem(conf)
        except Py4JJavaError as e:
            raise InvalidArgument(f"unsupported address: {source}") from e

    def _read(self, take):
        try:
            stream = self._fs.open(self._path)
        except Py4JJavaError as e:
            raise InvalidArgument(f"{self._path.toString()}: {e.java_exception.getMessage()}") from None
        try:
            return take(stream)
        finally:
            stream.close()

    def head(self, most: int) -> bytes:
        """The first bytes of the file, all of them if there are no more than ``most``."""
        return bytes(self._read(lambda stream: stream.readNBytes(most)))

    def all(self) -> bytes:
        return self.head(self.size())

    def sha256(self) -> str:
        """Lower-case hexadecimal digest; the content passes through the JVM in pieces."""
        return self._read(self._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex)

    def size(self) -> int:
        return self._fs.getFileStatus(self._path).getLen()


class Folder:
    """A folder that a table's versions live in."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(""))) if self._fs.exists(self._at("")) else []

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._at(name), True)

    def read_json(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write_json(self, name: str, value: dict) -> None:
        """Written under another name, then renamed over the old file: readers see the old or the new one."""
        temporary = f".{name}-{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(temporary), False)
        try:
            stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
            stream.hsync()
        finally:
            stream.close()
        self._replace(temporary, name)

    def _replace(self, temporary: str, name: str) -> None:
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = rename
        context.rename(context.makeQualified(self._at(temporary)), context.makeQualified(self._at(name)), options)

    def write_bytes(self, name: str, content: bytes, overwrite: bool, check) -> None:
        """A file that is written under another name, read back, passed to ``check`` and renamed; it may replace another with ``overwrite`` only."""
        if not overwrite and self.exists(name):
            raise InvalidArgument(f"{self.path}/{name} exists")
        temporary = f".{name}-{uuid.uuid4().hex}"
        try:
            stream = self._fs.create(self._at(temporary), False)
            try:
                stream.write(bytearray(content))
                stream.hsync()
            finally:
                stream.close()
            check(SharedFile(self.spark, f"{self.path}/{temporary}").head(len(content) + 1))
            self._replace(temporary, name)
        finally:
            self.delete(temporary)

    def claim(self, name: str, value: dict) -> None:
        """Create a file that must not exist yet."""
        if self.exists(name):
            raise InvalidArgument(f"{self.path}/{name} exists")
        self.write_json(name, value)
