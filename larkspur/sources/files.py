"""Small files and renames on whatever file system Spark reads, through its own Hadoop client."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = self._path(root)
        self._fs = path.getFileSystem(self._conf)
        self.root = self._fs.makeQualified(path).toString()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(self.at(name)), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Put `text` in place of `name`, all or nothing."""
        temporary = f"{name}.{uuid.uuid4().hex}"
        self._write(temporary, text)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        context.rename(self._path(self.at(temporary)), self._path(self.at(name)), options)

    def create(self, name: str, text: str) -> bool:
        """Write `name` only if it does not exist; whether it was written."""
        if not self._fs.createNewFile(self._path(self.at(name))):
            return False
        self.replace(name, text)
        return True

    def move(self, name: str, to: str) -> bool:
        """Rename a file; whether it was this call that did."""
        return self._fs.exists(self._path(self.at(name))) and self._fs.rename(self._path(self.at(name)), self._path(self.at(to)))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)

    def make_folder(self) -> None:
        self._fs.mkdirs(self._path(self.root))

    def listed(self, folder: str, suffix: str = ".parquet") -> list[str]:
        """Qualified names of the data files in a folder, or the file itself."""
        path = self._path(folder)
        fs = path.getFileSystem(self._conf)
        found = [s for s in fs.listStatus(path)]
        names = [s.getPath().toString() for s in found if s.isFile()]
        return sorted(n for n in names if n.endswith(suffix) and not n.rpartition("/")[2].startswith(("_", ".")))

    def children(self, name: str = "") -> list[str]:
        path = self._path(self.at(name) if name else self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []
