"""Small files and folders of the shared store, through Hadoop's file systems, so that any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder by its address; names are relative to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self.at().getFileSystem(self._conf)

    def names(self, name: str = "") -> list[str]:
        fs = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(self.at(name))) if fs.exists(self.at(name)) else []

    def exists(self, name: str) -> bool:
        return self._fs().exists(self.at(name))

    def age_ms(self, name: str) -> int:
        return self._jvm.java.lang.System.currentTimeMillis() - self._fs().getFileStatus(self.at(name)).getModificationTime()

    def remove(self, name: str = "") -> None:
        self._fs().delete(self.at(name), True)

    def read(self, name: str) -> str:
        stream = self._fs().open(self.at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs().create(self.at(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Writes the file aside and renames it, so that it is seen whole or not at all; false if there is one of this name already."""
        aside = f"{name.rsplit('/', 1)[0]}/.{name.rsplit('/', 1)[-1]}.{self._jvm.java.util.UUID.randomUUID().toString()}"
        self.write(aside, text)
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at().toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self.at(aside), self.at(name), none)
        except Exception as e:
            self.remove(aside)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True
