"""The driver's tables, read with only the columns an operator asks for; and where intermediate tables go."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch: long texts then don't add up to more than a worker can hold.
ARROW_BYTES = 2 << 20
#: Bytes of a row group of an intermediate table: its writer holds one in memory.
ROW_GROUP_BYTES = 8 << 20
_LEFT: dict[str, SparkSession] = {}


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches in this session, once; a bound of the user's own stays. No result depends on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it. Only a local master, whose executors are this machine,
    gets one of its own if there is none; a cluster without one is an error, as its executors can't see each other's disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder:
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder: lost executors don't lose them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Intermediate Parquet tables in the shared folder: `written` makes one, `drop` deletes those that nothing needs any more.

    What a result still reads stays until the driver's process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """The same rows from a table; columnar, so later readers take only what they need."""
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        keep(self.spark, path)
        self.paths.setdefault(name, []).append(path)
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, []):
                delete(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """One intermediate table, kept until the driver's process ends."""
    return Scratch(df.sparkSession).written(df, name)


def keep(spark: SparkSession, path: str) -> None:
    """Remembers a path to be deleted when the driver's process ends."""
    _LEFT[path] = spark


def delete(path: str) -> None:
    """Deletes a path that `keep` remembers, in whatever file system it is."""
    spark = _LEFT.pop(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for path in list(_LEFT):
        # the session may be gone by now; the shared folder is then the cluster's to clean
        with contextlib.suppress(Exception):
            delete(path)
