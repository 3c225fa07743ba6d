"""A folder every executor can reach, for tables a job writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

# Removes a query's shuffle files as soon as the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local session that names none (a test) gets a temporary one.

    Raises ``ValueError`` on a cluster without ``spark.checkpoint.dir``: a folder of the driver's machine
    would hide each executor's files from all others.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tallyshelf-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses; it is removed when the session's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/tallyshelf/{label}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, for a result that is used several times.

    Unlike a cache it survives the loss of executors, and its readers start from the files. So nothing needs the shuffle files behind it once it
    is written: they go at once, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, label), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _PLACES[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes the files of ``stored`` tables that nothing reads any more, so that a long job's tables don't add up.

    Every table made from them must be stored itself by then. Other DataFrames are left alone.
    """
    for table in tables:
        if path := _PLACES.pop(table, None):
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
