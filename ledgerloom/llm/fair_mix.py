"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations alone.

Each source's documents are shuffled by a hash, once for each repeat. A copy starts at the words of its source that come
before it; the words up to its end, divided by the source's weight, are its virtual finish time. All copies of all sources
are sorted by virtual finish time (a global range sort), their words are summed in this order, and the queue is truncated
where the sum reaches the total budget; the copy there counts with what is left of it (`taken`). A source that runs out has no
more copies in the queue, so its share goes to the others by weight. Documents are queued whole, or in slices of up to
`slice_words` words, as packets of a long message: then each source's sum is within a slice of its target, which is
min(weight x V, repeats x its size) with V such that targets sum to the budget (`source_targets`, in closed form).

Running sums don't gather a source in one task: a source's copies fall into BUCKETS ranges of the shuffle hash; sums of
ranges are accumulated first, then the copies within each range. Sums over the sorted queue are accumulated over its
partitions first, then within each of them. Tables by source have a row for each source.

Edge cases: a null text has size 0; null is a source of its own, the last one; documents of size 0 take nothing and get
the virtual time at which their turn comes; repeated rows are rows of their own; ties of the hash fall to doc_id and size; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import prepare, stored, text_of, word_count

BUCKETS = 1024
WEIGHTS = (5, 2, 1)


def shuffle_hash(doc_id: str, repeat: str, seed: int) -> Column:
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(repeat), F.lit(seed))


def hash_range(repeat: str, shuffle: str) -> Column:
    """The top bits of the hash, as an unsigned number, after the repeat: ranges come in the order of the queue."""
    return F.col(repeat) * BUCKETS + F.shiftright(shuffle, 54) + BUCKETS // 2


def source_targets(rows: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """rows(source, size) -> (source, source_size, weight, target): the water level V in closed form over sources."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    sources = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth))
    sources = sources.withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every, before = Window.partitionBy(), by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(every) * F.lit(float(share))
    full = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (budget - full) / open_weight
    sources = sources.withColumn("level", level)
    # The level rises over sources that run out and falls after the last of them.
    water = F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).over(every)
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * water, F.col("cap")))
    return sources.select("source", "source_size", "weight", target.alias("target"))


def queued(spark: SparkSession, docs: DataFrame, *, weights: tuple, share: float, repeats: int, seed: int, slice_words: int | None) -> tuple[DataFrame, DataFrame]:
    """The sizes of documents with their source's target; and the queue, also beyond the cut, with taken 0 there."""
    prepare(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text_of()).alias("size"))
    rows = stored(spark, slim.withColumn("tag", F.monotonically_increasing_id()), "sizes")
    targets = stored(spark, source_targets(rows, weights, share, repeats), "targets")
    copies = rows.where("size > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    copies = copies.withColumn("shuffle", shuffle_hash("doc_id", "repeat", seed)).withColumn("range", hash_range("repeat", "shuffle"))

    sums = copies.groupBy("source", "range").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("o_source"), F.col("range").alias("o_range"), F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "range").orderBy("shuffle", "doc_id", "size", "tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    copies = copies.withColumn("sum", F.sum("size").over(within))
    placed = copies.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")))
    placed = placed.join(targets.select(F.col("source").alias("t_source"), "weight"), F.col("source").eqNullSafe(F.col("t_source")))
    step = F.lit(slice_words).cast("long") if slice_words else F.col("size")
    placed = placed.withColumn("start", F.col("offset") + F.col("sum") - F.col("size")).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / step) - 1)))
    end = F.least(F.col("size"), (F.col("slice") + 1) * step)
    order = ["virtual_finish", "doc_id", "size", "repeat", "slice", "tag"]
    packets = placed.select(*order[1:], "source", "range", "shuffle", (end - F.col("slice") * step).alias("words"), ((F.col("start") + end) / F.col("weight")).alias("virtual_finish"))
    queue = packets.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    queue = stored(spark, queue, "queue")

    parts = queue.groupBy("part").agg(F.sum("words").alias("words"))
    before = parts.select(F.col("part").alias("b_part"), F.coalesce(F.sum("words").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = rows.agg(F.floor(F.coalesce(F.sum("size"), F.lit(0)) * F.lit(float(share)) + 1e-6).cast("long")).first()[0]
    summed = queue.withColumn("sum", F.sum("words").over(own)).join(before, F.col("part") == F.col("b_part"))
    left = F.lit(budget) - (F.col("before") + F.col("sum") - F.col("words"))
    summed = summed.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("words"), left)).cast("long")).drop("part", "b_part", "before", "sum")
    return rows.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source"), summed


def mix(spark: SparkSession, docs: DataFrame, *, weights: tuple = WEIGHTS, share: float = 1.5, repeats: int = 2, seed: int = 7, slice_words: int | None = None) -> DataFrame:
    """(doc_id, source, size, tag, repeat, slice, words, virtual_finish, taken): what the mix holds, in its order. Documents
    of size 0 are not in it."""
    queue = queued(spark, docs, weights=weights, share=share, repeats=repeats, seed=seed, slice_words=slice_words)[1].where("taken > 0")
    return queue.drop("range", "shuffle").orderBy("virtual_finish", "doc_id", "size", "repeat", "slice", "tag")


def mixed_documents(spark: SparkSession, docs: DataFrame, *, weights: tuple = WEIGHTS, share: float = 1.5, repeats: int = 2, seed: int = 7) -> DataFrame:
    """The documents of the mix with all their columns, repeats as repeated rows. The copy at the cut is left out;
    documents of size 0 come once; repeated rows of one size stand at one place of the queue and stay or go together.

    What a source gives is the beginning of its queue, so the place of the last whole copy (a row for each source) decides on
    each document by its own hash: no text is shuffled.
    """
    copies = queued(spark, docs, weights=weights, share=share, repeats=repeats, seed=seed, slice_words=None)[1].where("taken = size")
    cuts = copies.groupBy(F.col("source").alias("__source")).agg(F.max(F.struct("range", "shuffle", "doc_id", "size")).alias("__cut"))
    cuts = stored(spark, cuts, "mix-cuts")
    marked = docs.withColumn("__size", word_count(text_of())).withColumn("__repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    marked = marked.withColumn("__shuffle", shuffle_hash("doc_id", "__repeat", seed))
    place = F.struct(hash_range("__repeat", "__shuffle").alias("range"), F.col("__shuffle").alias("shuffle"), F.col("doc_id").cast("long").alias("doc_id"), F.col("__size").alias("size"))
    held = marked.join(cuts, F.col("source").cast("string").eqNullSafe(F.col("__source")), "left")
    keep = F.when(F.col("__size") == 0, F.col("__repeat") == 0).otherwise(F.coalesce(place <= F.col("__cut"), F.lit(False)))
    return held.where(keep).select(*docs.columns)


def taken_words(spark: SparkSession, docs: DataFrame, *, weights: tuple = WEIGHTS, share: float = 1.5, repeats: int = 2, seed: int = 7, slice_words: int = 256) -> DataFrame:
    """One row per row of docs: (doc_id, size, source_size, target, taken)."""
    rows, queue = queued(spark, docs, weights=weights, share=share, repeats=repeats, seed=seed, slice_words=slice_words)
    taken = queue.where("taken > 0").groupBy("tag").agg(F.sum("taken").alias("taken"))
    return rows.join(taken, "tag", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
