"""Where tables that outlive a query go, and how few input splits are spread over all cores."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch: long texts then don't add up to more than a worker can hold.
ARROW_BYTES = 4 << 20
_LEFT: dict[str, SparkSession] = {}


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches in this session, once; a bound of the user's own stays. No result depends on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, str(ARROW_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share: the checkpoint folder if the cluster names one, else the warehouse. Only a local
    master, whose executors are this machine, gets one under /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local"):
        return "file:///tmp/checkpoints/store"
    return spark.conf.get("spark.sql.warehouse.dir")


def new_path(spark: SparkSession, name: str, temporary: bool = True) -> str:
    """A path in the shared folder that nothing else has; a temporary one is deleted when the driver's process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if temporary:
        _LEFT[path] = spark
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table that is written now: what many parts of a plan read is computed once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as its kind of object."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    _LEFT.pop(path, None)
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Puts a finished folder in another's place."""
    fs, where = file_system(spark, old)
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{old} can't be renamed to {new}")


def version(spark: SparkSession, df: DataFrame) -> str:
    """The input files of a table with their sizes and times: another version of the table has another one."""
    out = []
    for path in sorted(df.inputFiles()):
        fs, where = file_system(spark, path)
        status = fs.getFileStatus(where)
        out.append(f"{path}:{status.getLen()}:{status.getModificationTime()}")
    return "|".join(out)


def spread(df: DataFrame) -> DataFrame:
    """The same rows in as many partitions as there are cores, if the input has fewer splits than that: one file with one row
    group would keep all other cores idle. Large inputs have more splits and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@atexit.register
def _sweep() -> None:
    for path, spark in list(_LEFT.items()):
        # the session may be gone by now; the shared folder is then the cluster's to clean
        with contextlib.suppress(Exception):
            delete(spark, path)
