"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where what is staged lies, until it is unstaged.
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only where none is set and all runs in one process (tests) a temporary one."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(at)
    return at


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder by Spark's own file system; a session that has ended leaves it to the cluster."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001
        pass


def stored(spark: SparkSession, path: str) -> bool:
    """Whether something lies at a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(removed, spark, path)
    return path


#: Whether the shuffle files of a query go when it has ended.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, *, partition_by: list[str] | None = None, tidy: bool = False) -> DataFrame:
    """``df`` written once and read back: lineage ends here and no executor's loss reaches behind it.

    The files go when the driver's Python ends, or with :func:`unstage`.  With ``tidy`` the shuffle files of the write go when it
    is done, not when the driver next collects its garbage: for tables of a small result from a large input, one after the other.
    """
    spark = df.sparkSession
    path = new_folder(spark, "staged")
    before = spark.conf.get(_TIDY, None)
    if tidy:
        spark.conf.set(_TIDY, "true")
    try:
        df.write.partitionBy(*(partition_by or [])).parquet(path)
    finally:
        if tidy:
            spark.conf.set(_TIDY, before) if before is not None else spark.conf.unset(_TIDY)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (out, path)
    return out


def unstage(*frames: DataFrame) -> None:
    """Remove the files of staged frames that nothing will read any more."""
    for df in frames:
        _, path = _PATHS.pop(id(df), (None, None))
        if path:
            removed(df.sparkSession, path)
