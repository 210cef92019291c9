"""Exact deduplication through a log-structured merge index, in DataFrame operations alone.

flush    Documents come in batches and fall into memtables by a hash of doc_id. A batch's memtables become runs: their digests
         with the id that stays and a count, sorted by digest, in Parquet, and for each run a filter of its digests (a
         bitmap of fixed size, FILTER_BUCKETS x 4 KB).
compact  Runs merge FAN_IN at a time, tier by tier, into one level: per digest the id that stays (the smallest by default,
         the largest on request) and the total count. Each run probes the filters of the runs that it merges with: digests
         that no other of them can hold pass as they are, and only the others meet in a shuffle.
lookup   Digests that occur more than once are hits; a filter of them clears all documents that can't belong to one, which
         are their own group without a join. The others find their digest in the level, and the bytes of all documents
         of a hit are compared: a digest is verified if its least and greatest texts are the same. Texts that the filter
         clears are never shuffled. Where bytes differ under one digest (never seen with the default 256 bits), its documents
         are grouped anew by their bytes, so results are exact at any digest width (tests use a few bits).

Filters only spare work: beyond their capacity (some ten million digests) they pass more, and results stay the same.
Texts equal after lower-casing A-Z are the same; null counts as empty. Only digests and ids are shuffled, besides the
texts of digests that occur more than once. A hot digest is combined before each shuffle, and joins on it can be split by
adaptive execution, as the other side has one row for it.

Edge cases: repeated rows (equal doc_id and text) are copies, of which one row stays; with null ids a row with an id stays
if there is one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import discard, hash_filter, in_filter, lower_az, marked, prepare, stored, text_of, without

MEMTABLES, BATCHES, FAN_IN = 2, 2, 2


def normal(name: str = "text") -> Column:
    return lower_az(text_of(name))


class LsmIndex:
    """Runs in the shared folder; `keep` is "min" or "max" and says which id of a digest stays."""

    def __init__(self, spark: SparkSession, keep: str = "min"):
        self.spark, self.keep = spark, keep
        self.runs: list[DataFrame] = []
        self.written: list[DataFrame] = []

    def age(self) -> Column:
        """Rows compete by id; a null id never wins over another one; tag tells repeated rows apart."""
        known = F.col("doc_id").isNull() if self.keep == "min" else F.col("doc_id").isNotNull()
        return F.struct(known.alias("known"), "doc_id", "tag")

    def pick(self, c: Column | str) -> Column:
        return (F.min if self.keep == "min" else F.max)(c)

    def flush(self, rows: DataFrame, memtables: int = MEMTABLES) -> None:
        """rows(doc_id, tag, digest) -> a sorted run for each memtable."""
        table = F.pmod(F.xxhash64("doc_id"), F.lit(memtables)).cast("int").alias("run")
        runs = rows.groupBy(table, "digest").agg(self.pick(self.age()).alias("stays"), F.count(F.lit(1)).alias("n"))
        written = stored(self.spark, runs.sortWithinPartitions("run", "digest"), "lsm-runs")
        self.runs += [written.where(F.col("run") == i).drop("run") for i in range(memtables)]
        self.written.append(written)

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """One sorted run of several."""
        hashed = [r.withColumn("h", F.xxhash64("digest")) for r in runs]
        filters = [hash_filter(r, "h") for r in hashed]
        alone, met = [], []
        for i, run in enumerate(hashed):
            for j, bits in enumerate(filters):
                if i != j:
                    run = marked(run, bits, "h", f"in_{j}")
            other = reduce(or_, [F.col(f"in_{j}") for j in range(len(runs)) if j != i])
            alone.append(run.where(~other).select("digest", "stays", "n"))
            met.append(run.where(other).select("digest", "stays", "n"))
        both = reduce(DataFrame.unionByName, met).groupBy("digest").agg(self.pick("stays").alias("stays"), F.sum("n").alias("n"))
        out = stored(self.spark, reduce(DataFrame.unionByName, [*alone, both]).sortWithinPartitions("digest"), "lsm-run")
        self.written.append(out)
        return out

    def compact(self) -> DataFrame:
        """Merges all runs into one level: (digest, stays, n)."""
        while len(self.runs) > 1:
            tier = [self.runs[i : i + FAN_IN] for i in range(0, len(self.runs), FAN_IN)]
            self.runs = [self.merged(group) if len(group) > 1 else group[0] for group in tier]
        return self.runs[0]

    def drop(self) -> None:
        """Deletes the runs."""
        discard(self.spark, *self.written)
        self.runs, self.written = [], []


def exact_dedup(spark: SparkSession, docs: DataFrame, *, keep: str = "min", digest_bits: int = 256, memtables: int = MEMTABLES, batches: int = BATCHES) -> DataFrame:
    """(doc_id, tag, keep_id, group_size, kept, text_sha256): one row per row of docs; tag tells repeated rows apart."""
    prepare(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal().alias("text"))
    cut = lambda c: F.substring(c, 1, digest_bits // 4)
    narrow = slim.select("doc_id", F.monotonically_increasing_id().alias("tag"), F.sha2("text", 256).alias("text_sha256"))
    rows = stored(spark, narrow, "digests").withColumn("digest", cut("text_sha256"))
    index = LsmIndex(spark, keep)
    for i in range(batches):
        index.flush(rows.where(F.pmod(F.xxhash64("tag"), F.lit(batches)) == i), memtables)
    level = index.compact()
    more = stored(spark, level.where("n > 1"), "hits")
    index.drop()
    bitmaps = hash_filter(more.select(F.xxhash64("digest").alias("h")), "h")

    hits = slim.withColumn("digest", cut(F.sha2("text", 256))).withColumn("h", F.xxhash64("digest")).join(bitmaps, in_filter("h")).select("doc_id", "text", "digest")
    # Texts of a digest are combined before they are shuffled; digests that only the filter takes for hits have one text.
    bytes_of = hits.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("greatest"))
    mixed = stored(spark, bytes_of.where("least <> greatest").select("digest"), "mixed")

    def result(rows, found, on):
        """found(on, stays, n) has the groups of more than one row; a row without one is a group of its own."""
        own = F.struct(F.lit(True).alias("known"), "doc_id", "tag")
        out = rows.withColumns({"stays": F.lit(None), "n": F.lit(None)}) if found is None else rows.join(found.select(on, "stays", "n"), on, "left")
        out = out.withColumn("stays", F.coalesce("stays", own)).withColumn("n", F.coalesce("n", F.lit(1)))
        kept = (F.col("stays.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("stays.tag") == F.col("tag"))
        return out.select("doc_id", "tag", F.col("stays.doc_id").alias("keep_id"), F.col("n").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")

    probed = marked(rows.withColumn("h", F.xxhash64("digest")), bitmaps, "h", "hit").drop("h")
    alone, maybe = result(probed.where("not hit"), None, "digest"), probed.where("hit")
    if mixed.isEmpty():
        return alone.unionByName(result(maybe, more, "digest"))
    again = stored(spark, hits.join(mixed, "digest", "left_semi").select("doc_id", "text", F.monotonically_increasing_id().alias("tag")), "mixed-texts")
    groups = again.groupBy("text").agg(index.pick(index.age()).alias("stays"), F.count(F.lit(1)).alias("n"))
    apart = again.withColumn("text_sha256", F.sha2("text", 256))
    return alone.unionByName(result(maybe.join(mixed, "digest", "left_anti"), more, "digest")).unionByName(result(apart, groups, "text"))


def keep_one(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs without the copies that exact_dedup drops; all columns stay. Of repeated rows (equal doc_id and text) one stays."""
    rows = exact_dedup(spark, docs, **options)
    rows = rows.groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).agg(F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__rows"))
    rows = stored(spark, rows.where("not __kept or __rows > 1"), "decided")
    gone, repeated = rows.where("not __kept"), rows.where("__kept and __rows > 1")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.sha2(normal(), 256) == F.col("__sha"))
    out = without(docs, gone, same)
    if not repeated.isEmpty():
        both = out.join(repeated, same, "left_semi").withColumn("__sha", F.sha2(normal(), 256)).dropDuplicates(["doc_id", "__sha"]).drop("__sha")
        out = without(out, repeated, same).unionByName(both)
    return out
