"""Upserts into partitioned Parquet: rows replace those of the same key, the latest version wins."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ASIDE = "_pending"  # below the table's folder; Spark's readers pass names with an underscore by
FILES = 16  # most files per partition and upsert


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a job's output is whole: Spark writes this mark last."""
    place, files = _files(spark, f"{path}/_SUCCESS")
    return files.exists(place)


def latest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row per key: that of the greatest ``version``, among equals the greatest by the other columns. Rows with a null in the key are
    left out; a null version is the least. Combined map-side, so a key that very many rows share costs no more than others."""
    rest = [c for c in rows.columns if c not in key and c != version]
    best = rows.dropna(subset=key).groupBy(*key).agg(F.max(F.struct(version, *rest)).alias("best"))
    return best.select(*key, "best.*").select(*rows.columns)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table; one that was never written is empty."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def upsert(batch: DataFrame, path: str, key: list[str], version: str, partition: str, files: int = FILES) -> None:
    """Merges ``batch`` into the table at ``path``, which is partitioned by ``partition``.

    Only partitions are rewritten that a row of the batch goes to or that hold an older row of one of its keys (a row can change its
    partition; one that is left empty disappears). A row of the batch that is older than the table's changes nothing, so a batch may be applied
    again at any time.

    The new content of the touched partitions is written aside, and replaces them only when it is whole. If the driver is lost before
    that, the table is as it was; if later, ``recover`` or the next upsert replaces them (once more) with the same rows. One writer
    at a time; readers may see old and new partitions while they are replaced.
    """
    spark = batch.sparkSession
    recover(spark, path)
    _write_aside(batch, path, key, version, partition, files)
    recover(spark, path)


def recover(spark: SparkSession, path: str) -> None:
    """Finishes or forgets an upsert whose driver was lost."""
    aside = f"{path.rstrip('/')}/{_ASIDE}"
    if _finished(spark, f"{aside}/rows"):
        _replace(spark, path, aside)
    place, files = _files(spark, aside)
    files.delete(place, True)


def _write_aside(batch: DataFrame, path: str, key: list[str], version: str, partition: str, files: int) -> None:
    spark, aside = batch.sparkSession, f"{path.rstrip('/')}/{_ASIDE}"
    table = read(spark, path, batch.schema)
    latest(batch, key, version).write.parquet(f"{aside}/changes")
    changes = spark.read.schema(batch.schema).parquet(f"{aside}/changes")
    held = table.select(*key, partition).join(changes.select(*key), key, "left_semi").select(partition)
    changes.select(partition).union(held).distinct().write.parquet(f"{aside}/touched")
    # One value per partition; known before the scan, so that other partitions' files are not even listed.
    values = [row[0] for row in spark.read.parquet(f"{aside}/touched").collect()]
    wanted = F.col(partition).isin([v for v in values if v is not None])
    if None in values:
        wanted = wanted | F.col(partition).isNull()
    merged = latest(table.where(wanted).unionByName(changes), key, version)
    # A large partition is several tasks and files, a small one no more than it has rows for.
    dealt = merged.repartition(F.col(partition), F.pmod(F.xxhash64(*key), F.lit(files)))
    dealt.write.parquet(f"{aside}/rows")


def _replace(spark: SparkSession, path: str, aside: str) -> None:
    touched = spark.read.parquet(f"{aside}/touched")
    partition = touched.columns[0]
    rows = spark.read.parquet(f"{aside}/rows")
    rows.write.mode("overwrite").partitionBy(partition).option("partitionOverwriteMode", "dynamic").parquet(path)
    filled = {row[0] for row in rows.select(partition).distinct().collect()}
    for value in {row[0] for row in touched.collect()} - filled:
        place, files = _files(spark, f"{path.rstrip('/')}/{partition}={_folder(value)}")
        files.delete(place, True)


def _folder(value: object) -> str:
    """How Spark writes a partition's value: of integers, dates and plain words as they are."""
    text = "__HIVE_DEFAULT_PARTITION__" if value is None else str(value)
    if not re.fullmatch(r"[\w.+ -]+", text):
        raise ValueError(f"a partition named {text!r} cannot be emptied")
    return text
