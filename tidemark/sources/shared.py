"""Tables and the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; only where that is unset and the master is local a folder of our own.

    A cluster whose shared folder nobody named raises: its executors can't see a folder of the driver's machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{(root or _own_folder()).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Folders handed out, by application.
_MADE: dict[str, list[str]] = {}


def clear_folders(spark: SparkSession) -> int:
    """Delete the folders that this application's queries left; frames that read them, and logs without a path of their own, end with this."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        drop_folder(spark, path)
    return len(made)


def written(df: DataFrame, name: str, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
    return spark.read.schema(schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as Hadoop's."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def move_into_place(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder; false, and nothing moved, where the target exists: another writer was first.

    FileSystem.rename would put the folder inside the target then.
    """
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(source), at, none)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
            return False
        raise
    return True


def place(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder to where nothing is yet, or raise."""
    if not move_into_place(spark, source, target):
        raise FileExistsError(target)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
