"""Work tables: results that several later steps read are written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a temporary folder if that is unset."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir", None):
        return named
    if held := spark.conf.get("spark.ledgerloom.tables", None):
        return held
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="ledgerloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.ledgerloom.tables", f"file://{own}")
    return f"file://{own}"


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes the shuffle files of an action when the action ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old) if old is not None else spark.conf.unset(key)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet and reads it back: it is computed once, its lineage is cut, its size is known to the joins after it, and its
    shuffle files go when it is written."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes work tables that nothing reads any longer."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._work_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
