"""A pointer to what the last successful run left, replaced at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Pointer:
    """A small JSON document under a folder of the shared file system.

    ``set`` writes it aside and renames it over the old one: a reader sees the old or the new document, and a
    run that fails before the rename leaves the old one in force.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def get(self) -> dict | None:
        """The document, None before the first."""
        p = self._path(f"{self.path}/CURRENT")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def set(self, document: dict) -> None:
        new = self._path(f"{self.path}/CURRENT-{uuid.uuid4().hex}")
        f = self._fs.create(new, True)
        f.write(bytearray(json.dumps(document).encode()))
        f.close()
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        replace = self.spark.sparkContext._gateway.new_array(rename, 1)
        replace[0] = rename.OVERWRITE
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(new, self._path(f"{self.path}/CURRENT"), replace)

    def drop(self, *names: str) -> None:
        """Remove folders that the document no longer names."""
        for n in names:
            self._fs.delete(self._path(f"{self.path}/{n}"), True)
