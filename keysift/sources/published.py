"""Tables that readers see whole or not at all.

A table is a folder with data folders, written first and named by nobody, and numbered versions: small files that say which data folders belong to the table.
A version is written aside and renamed to its number, which fails if another writer took that number; a reader takes the highest one.  So a reader never
sees half a table, an append or a replacement is one step, and of two writers at once one fails and changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer published first; what this one wrote is not part of the table."""


class Published:
    """The named parts of a table under ``root``, a folder that the whole cluster shares."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def version(self) -> int:
        """The highest published number; 0 before the first."""
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def parts(self, version: int | None = None) -> dict[str, list[str]]:
        """The data folders of each part in a version, the current one unless told."""
        number = self.version() if version is None else version
        if not number:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/versions/{number}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, df: DataFrame) -> str:
        """Writes a data folder that no version names yet."""
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return name

    def publish(self, parts: dict[str, list[str]], after: int) -> int:
        """Makes ``parts`` the version that follows ``after``."""
        aside, target = self._path(f"{self.root}/versions/.{uuid.uuid4().hex}"), self._path(f"{self.root}/versions/{after + 1}")
        out = self._fs.create(aside, False)
        try:
            out.writeBytes(json.dumps(parts))
        finally:
            out.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(aside, target, options)
        except Exception as error:
            self._fs.delete(aside, False)
            if self._fs.exists(target):
                raise Conflict(f"version {after + 1} of {self.root} was published meanwhile") from error
            raise
        return after + 1

    def replace(self, **frames: DataFrame) -> int:
        after = self.version()
        return self.publish({name: [self.write(df)] for name, df in frames.items()}, after)

    def append(self, **frames: DataFrame) -> int:
        after = self.version()
        parts = self.parts(after)
        return self.publish(parts | {name: [*parts.get(name, []), self.write(df)] for name, df in frames.items()}, after)

    def read(self, part: str, version: int | None = None) -> DataFrame | None:
        """The rows of a part, or None if the version has none."""
        folders = self.parts(version).get(part)
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders]) if folders else None
