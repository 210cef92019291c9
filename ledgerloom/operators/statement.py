"""A whole parse: text lines to audited transactions, with the replies of a model for statements that the parser can't read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import dates, replies
from ledgerloom.functions.money import parse_amount, to_cents
from ledgerloom.operators import ledger, recovery
from ledgerloom.sources.work import stored


def reply_rows(texts: DataFrame) -> DataFrame:
    """Replies(doc_id, text) -> transactions: the objects of a reply's array in order; `details` stands for a missing narration."""
    each = texts.select("doc_id", F.posexplode(replies.rows(F.col("text"))).alias("row_idx", "r"))
    cents = [to_cents(parse_amount(F.col("r")[c])).alias(f"{c}_c") for c in ("debit", "credit", "balance")]
    return each.select("doc_id", "row_idx", F.lit(1).alias("page"), F.col("r")["date"].alias("date"), F.coalesce(F.col("r")["narration"], F.col("r")["details"]).alias("narration"), *cents)


def parse_statements(lines: DataFrame, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """lines(doc_id, line_no, text), answers(doc_id, text) -> transactions(doc_id, row_idx, page, date, narration, debit_c, credit_c, balance_c, source) and a
    report of each statement with its audit.

    Statements that the text parser fails on take the rows of their model's answer, if there is one. Dates are normalised; a statement
    without rows has no audit.
    """
    found, report = recovery.parse(lines)
    rows = found.select("doc_id", F.col("row_no").alias("row_idx"), "page", "date", "narration", "debit_c", "credit_c", "balance_c", F.lit("text").alias("source"))
    if answers is not None:
        failed = report.where("hard_failure IS NOT NULL").select("doc_id")
        rows = rows.unionByName(reply_rows(answers.join(failed, "doc_id", "left_semi")).withColumn("source", F.lit("reply")))
    rows = stored(rows.withColumn("date", dates.normalize_date(F.col("date"))), "parsed")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("row_idx")) - 1
    audit = ledger.financial_audit(rows.withColumn("row_idx", number)).drop("rows")
    sources = rows.groupBy("doc_id").agg(F.max("source").alias("source"), F.count(F.lit(1)).alias("transactions"))
    return rows, report.join(sources, "doc_id", "left").join(audit, "doc_id", "left")
