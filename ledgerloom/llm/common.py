"""Shared plumbing of the training-data operators: work tables in the shared folder, text normal forms, worker caches."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import string
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Bitmaps of 32,768 bits in a filter of hashes: 4 MB at most, whatever the data; beyond its capacity it passes more rows.
FILTER_BUCKETS = 1024
#: Rows in an Arrow batch. Texts differ a lot in length, so batches are kept short.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package in local runs and bounds the rows of an Arrow batch."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def work_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode a temporary one if that is unset."""
    sc = spark.sparkContext
    if set_dir := sc.getConf().get("spark.checkpoint.dir", None):
        return set_dir
    if held := spark.conf.get("spark.ledgerloom.workDir", None):
        return held
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="ledgerloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.ledgerloom.workDir", f"file://{own}")
    return f"file://{own}"


def work_path(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


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


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors, has known sizes."""
    with swept(spark):
        df.write.parquet(path := work_path(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes work tables that nothing reads any longer."""
    for t in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._work_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_az(c: Column) -> Column:
    """Lower-cases A-Z alone; other letters stay."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def worker_cache(owner: str) -> dict:
    """What an operator keeps in a Python worker, until another operator's work comes to that worker: workers live through many stages,
    and the memories of all of them together would not fit."""
    module = sys.modules.setdefault("_ledgerloom_worker_cache", types.ModuleType("_ledgerloom_worker_cache"))
    held = module.__dict__.setdefault("held", {})
    if owner not in held:
        held.clear()
    return held.setdefault(owner, {})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _filter_value(h: str) -> Column:
    return F.pmod(F.col(h), F.lit(FILTER_BUCKETS * 32768)) + 1


def hash_filter(rows: DataFrame, h: str) -> DataFrame:
    """(bucket, bitmap) of the values of the long column h: of fixed size, so it may be broadcast. Join it with in_filter."""
    value = _filter_value(h)
    bits = rows.select(F.bitmap_bucket_number(value).alias("__bucket"), F.bitmap_bit_position(value).alias("__bit"))
    return F.broadcast(bits.groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bitmap")))


def _bit(h: str) -> Column:
    at = F.bitmap_bit_position(_filter_value(h))
    byte = F.conv(F.hex(F.substring(F.col("__bitmap"), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i).cast("long") for i in range(8)]), (at % 8).cast("int") + 1)) > 0


def in_filter(h: str) -> Column:
    """Join condition with a hash_filter: true for all values in it, and for few others."""
    return (F.bitmap_bucket_number(_filter_value(h)) == F.col("__bucket")) & _bit(h)


def marked(rows: DataFrame, bitmaps: DataFrame, h: str, name: str) -> DataFrame:
    """rows with the boolean column `name`: false for values of h that can't be in the hash_filter. No row is shuffled."""
    bucket = F.bitmap_bucket_number(_filter_value(h)) == F.col("__bucket")
    return rows.join(bitmaps, bucket, "left").withColumn(name, F.coalesce(_bit(h), F.lit(False))).drop("__bucket", "__bitmap")


def without(docs: DataFrame, gone: DataFrame, on: Column) -> DataFrame:
    """docs without the rows that match gone(__id, ...) by the condition `on`, which asks for doc_id <=> __id at least.
    Only rows that a filter of fixed size can't clear are shuffled for the join."""
    bitmaps = hash_filter(gone.select(F.xxhash64("__id").alias("__h")), "__h")
    tried = marked(docs.withColumn("__h", F.xxhash64("doc_id")), bitmaps, "__h", "__maybe").drop("__h")
    clear, maybe = tried.where(~F.col("__maybe")).drop("__maybe"), tried.where("__maybe").drop("__maybe")
    return clear.unionByName(maybe.join(gone, on, "left_anti"))
