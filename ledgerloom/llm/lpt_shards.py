"""Sharding by longest-processing-time scheduling of groups of equal texts.

A group's weight is the sum of its documents' sizes. Groups are taken in order of weight, largest first, and each goes to
the shard with the least load, kept in a heap. The order is cut into runs of equal weight; a heap step deals a whole run
at once, so the driver sees a row for each distinct weight and not for each group. Weights are exact to 17 significant
bits: groups of over 2^17 bytes that are within 1 part in 65,536 of each other form one run, and its mean stands for each.
That bounds the runs by 2^17 + 46 x 2^16 whatever the data; a group alone in its run has its exact weight. Within a run, groups are numbered by digest and the numbers are cut by the shards' quotas.

Numbers are found without gathering a run or a shard in one task: rows fall into SALTS parts by a hash, counts of parts
are accumulated first, then rows are numbered within each part. A hot text is one row before it meets its documents
again, in a join that adaptive execution can split.

Law: `bytes` (sizes of shards near equal; LPT is within 4/3 of the best largest load). grown_shard is null.

Edge cases: a null text counts as empty, size 1, and empty texts form a group like others; repeated rows are rows of their
group, each with its own slot; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import prepare, stored, text_of

SALTS = 1024
EXACT_BITS = 17


def deal_equal(loads: list[float], weight: float, count: int) -> list[int]:
    """How many of `count` items of one weight the least-loaded rule gives to each shard; loads are updated."""
    k = len(loads)
    quota = [0] * k
    if count > 4 * k:
        # Fill up to a level that all but a few items reach for certain, then go on one by one.
        order = sorted(range(k), key=loads.__getitem__)
        total, used = 0.0, 0
        for used in range(1, k + 1):
            total += loads[order[used - 1]]
            level = (total + (count - k) * weight) / used
            if used == k or level <= loads[order[used]]:
                break
        for s in order[:used]:
            quota[s] = max(0, int((level - loads[s]) // weight))
        for s in range(k):
            loads[s] += quota[s] * weight
    heap = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(count - sum(quota)):
        load, s = heap[0]
        quota[s] += 1
        loads[s] = load + weight
        heapq.heapreplace(heap, (load + weight, s))
    return quota


def lpt(runs: Iterable[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """runs (run, groups, bytes), heaviest first -> (run, running sums of the shards' quotas)."""
    loads, out = [0.0] * shards, []
    for run, groups, total in runs:
        quota, sums = deal_equal(loads, total / groups, groups), []
        for q in quota:
            sums.append((sums[-1] if sums else 0) + q)
        out.append((run, sums))
    return out


def run_of(weight: Column) -> Column:
    """The weight, with its lower bits cleared beyond EXACT_BITS significant ones."""
    spare = F.greatest(F.lit(0), F.length(F.bin(weight)) - EXACT_BITS).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", weight, spare), spare)


def numbered(df: DataFrame, within: list[str], by: list[str], name: str) -> DataFrame:
    """Adds a gapless number from 0 in each group of `within`, in parts by a hash of the columns `by`, which order a part."""
    df = df.withColumn("__part", F.pmod(F.xxhash64(*by), F.lit(SALTS)))
    counts = df.groupBy(*within, "__part").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*within, "__part", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    own = Window.partitionBy(*within, "__part").orderBy(*by)
    ranked = df.withColumn("__own", F.row_number().over(own))
    return ranked.join(offsets, [*within, "__part"]).withColumn(name, F.col("__before") + F.col("__own") - 1).drop("__part", "__before", "__own")


def shard(spark: SparkSession, docs: DataFrame, *, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, group_rows): one row per row of docs."""
    prepare(spark)
    text = text_of()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = stored(spark, slim.withColumn("tag", F.monotonically_increasing_id()), "sizes")
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_rows"), F.sum("size").alias("weight"))
    groups = stored(spark, groups.withColumn("run", run_of(F.col("weight"))), "groups")
    runs = groups.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("bytes"))
    plan = lpt([tuple(r) for r in runs.orderBy(F.desc("run")).collect()], shards)
    quotas = spark.createDataFrame(plan, "run long, quotas array<long>")
    placed = numbered(groups, ["run"], ["digest"], "nth").join(quotas, "run")
    placed = placed.select("digest", "group_rows", F.size(F.filter("quotas", lambda q: q <= F.col("nth"))).alias("shard"))
    return numbered(rows.join(placed, "digest"), ["shard"], ["doc_id", "tag"], "slot").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_rows")
