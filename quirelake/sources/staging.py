"""Tables in the folder that driver and executors share, for what several later steps read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A folder's path in spark.checkpoint.dir that nothing else writes to.

    Where that setting is unset, a folder of our own serves sessions that run in one process; others raise.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="quirelake-")
        folder = _own[app]
    return f"{folder.rstrip('/')}/quirelake/{label}-{uuid.uuid4().hex}"


#: Whether a query's shuffle files go once it has ended, not once the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(rows: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: worked out once, kept when executors are lost, read by name of column.

    What was shuffled for them is deleted as soon as the table is written.
    """
    spark = rows.sparkSession
    path = fresh_folder(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        rows.write.parquet(path, compression="zstd")
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(rows.schema).parquet(path)
    table.staged_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of staged() that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
