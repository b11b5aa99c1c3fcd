"""Tables that cut lineage, kept in the folder that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only where the setting is absent and the session runs in one process (tests)
    a temporary folder is made and set; on a cluster its absence is an error.
    """
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cohortspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; what is written there is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`stored` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Folder:
    """Small texts and folders of tables below a path, on whatever file system it lies."""

    def __init__(self, spark: SparkSession, path: str):
        self._hadoop, self.path = spark._jvm.org.apache.hadoop.fs, path.rstrip("/")
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def names(self) -> list[str]:
        """Names below the path, sorted; none if it doesn't exist."""
        top = self._hadoop.Path(self.path)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(top)) if self._fs.exists(top) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The text appears under its name as a whole or not at all; FileExistsError if there is such a name."""
        part = self._at(f".{name}-{uuid.uuid4().hex}")
        stream = self._fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(part, self._at(name)):
            self._fs.delete(part, False)
            raise FileExistsError(f"{self.path}/{name}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
