"""Page order: summaries of pages, scores of links between pages of a statement, and the chain of best links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_summaries(txns: DataFrame) -> DataFrame:
    """(doc_id, page, start_date, end_date, start_c, end_c, first_credit_c, first_debit_c, rows), in the rows' own order."""
    day = F.try_to_date("date", "yyyy-MM-dd")
    return txns.groupBy("doc_id", "page").agg(
        F.min(day).alias("start_date"), F.max(day).alias("end_date"), F.min_by("balance_c", "row_idx").alias("start_c"), F.max_by("balance_c", "row_idx").alias("end_c"),
        F.min_by(F.coalesce("credit_c", F.lit(0)), "row_idx").alias("first_credit_c"), F.min_by(F.coalesce("debit_c", F.lit(0)), "row_idx").alias("first_debit_c"), F.count(F.lit(1)).alias("rows"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(doc_id, page_a, page_b, score) for all ordered pairs of a statement's pages: close dates and matching balances.

    The join is on doc_id; a statement has few pages."""
    a = pages.select("doc_id", F.col("page").alias("page_a"), F.col("end_date").alias("to"), "end_c")
    b = pages.select("doc_id", F.col("page").alias("page_b"), F.col("start_date").alias("since"), "start_c", "first_credit_c", "first_debit_c")
    pairs = a.join(b, "doc_id").where("page_a <> page_b")
    days, off = F.date_diff("since", "to"), F.abs(F.col("end_c") + F.col("first_credit_c") - F.col("first_debit_c") - F.col("start_c"))
    dates = F.when(days < 0, -300).when(days <= 2, 150).when(days <= 10, 80).when(days > 10, 30).otherwise(0)
    balances = F.when(off <= 100, 200).when(off <= 1000, 100).when(off > 1000, -200).otherwise(0)
    near = F.when(F.abs(F.col("page_a") - F.col("page_b")) == 1, 5).otherwise(0)
    return pairs.select("doc_id", "page_a", "page_b", (dates + balances + near).alias("score"))


def page_chain(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, place, page): from the page of the earliest date on, the unused page with the best link, ties to the smaller page.

    Greedy and so sequential within a statement, whose pages are folded in the JVM: a step reads the links of the last page only.
    """
    own = F.collect_list(F.struct(F.col("page_b").cast("int").alias("page"), F.col("score").cast("int").alias("score")))
    away = links.groupBy("doc_id", F.col("page_a").cast("int").alias("page_a")).agg(own.alias("to"))
    maps = away.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page_a", "to"))).alias("links"))
    page = F.col("page").cast("int")
    docs = pages.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("start_date").isNotNull(), F.struct("start_date", page.alias("page"))))["page"], F.min(page)).alias("first"), F.count(F.lit(1)).cast("int").alias("n"))
    start = F.array(F.col("first")).cast("array<int>")

    def step(order: Column, _: Column) -> Column:
        to = F.filter(F.element_at("links", F.element_at(order, -1)), lambda l: ~F.array_contains(order, l["page"]))
        best = F.array_max(F.transform(to, lambda l: F.struct(l["score"].alias("score"), (-l["page"]).alias("page"))))
        return F.array_append(order, -best["page"])

    places = F.when(F.col("n") > 1, F.sequence(F.lit(2), F.col("n"))).otherwise(F.array().cast("array<int>"))
    chained = docs.join(maps, "doc_id", "left").select("doc_id", F.posexplode(F.aggregate(places, start, step)).alias("at", "page"))
    return chained.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("at") + 1).alias("place"), "page")


def repair_pages(txns: DataFrame) -> DataFrame:
    """txns with row_idx numbered anew along the chain of best page links; rows of a page keep their order."""
    pages = page_summaries(txns)
    chain = page_chain(pages, page_links(pages))
    placed = txns.join(chain, ["doc_id", "page"])
    return placed.withColumn("row_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "row_idx")) - 1).select(*txns.columns)


def page_reversals(txns: DataFrame) -> DataFrame:
    """Per statement: page boundaries at which the date goes back."""
    day = F.try_to_date("date", "yyyy-MM-dd")
    by = Window.partitionBy("doc_id").orderBy("row_idx")
    dated = txns.withColumn("day", day).where("day is not null")
    turned = dated.withColumn("back", (F.col("day") < F.lag("day").over(by)) & (F.col("page") != F.lag("page").over(by)))
    return turned.groupBy("doc_id").agg(F.count_if("back").alias("reversals")).withColumn("anomaly", F.col("reversals") > 0)
