"""Connected components of a link table, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import discard, stored


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (node, root): equal roots for nodes that links join, for every node of a link.

    Each round hashes the nodes anew, points every node at the smallest hash among itself and its neighbours and
    contracts the links along those pointers. A path shrinks by a constant factor in expectation, so the number of
    rounds is logarithmic for chains and stars alike. A hub costs no more than its links: minima are combined before
    the shuffle and joins on a hub's id can be split by adaptive execution. Rounds go through the shared folder.
    Self-links and repeated links do no harm; rows with a null end are ignored; an empty table gives an empty one.
    """
    both = links.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = stored(spark, both.union(both.select("b", "a")).distinct(), "links")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), F.col(c)).alias("h"), F.col(c).alias("v"))
        to = edges.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["v"].alias("root"))
        steps.append(to := stored(spark, to, "pointers"))
        left = edges.join(to.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        near = left.join(to.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        fewer = stored(spark, near.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
        discard(spark, edges)
        edges = fewer
    if not steps:
        return spark.createDataFrame([], "node long, root long")
    out = steps[0]
    for to in steps[1:]:
        out = out.join(to.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return stored(spark, out, "components")
