"""Corpus reports over the results of the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reject_histogram(decisions: DataFrame, banks: DataFrame) -> DataFrame:
    """Per bank and reason: rejected rows, their share of the bank's, and their rank."""
    n = decisions.where("not accepted").join(banks, "doc_id").groupBy("bank", "reason").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("bank")
    rank = F.row_number().over(whole.orderBy(F.desc("n"), "reason"))
    return n.select("bank", "reason", "n", F.round(100.0 * F.col("n") / F.sum("n").over(whole), 2).alias("percent"), rank.alias("rank"))


def bank_failure_matrix(breaks: DataFrame, banks: DataFrame) -> DataFrame:
    """Break reasons as columns, banks as rows."""
    reasons = ["MISSING_TRANSACTION", "DIRECTION_ERROR", "AMOUNT_EXTRACTION_ERROR", "BALANCE_CORRUPTION"]
    return breaks.join(banks, "doc_id").groupBy("bank").pivot("reason", reasons).count().na.fill(0)


def fix_impact(decisions: DataFrame, banks: DataFrame) -> DataFrame:
    """Rejected rows by reason that a fix would win back, per bank and overall (bank null): one rollup."""
    rows = decisions.join(banks, "doc_id")
    flag = lambda *reasons: F.count_if(F.col("reason").isin(*reasons))
    return rows.rollup("bank").agg(F.count(F.lit(1)).alias("rows"), flag("both_debit_and_credit").alias("two_sided"), flag("no_debit_or_credit", "NO_TRANSACTION_SEED").alias("sideless"), flag("no_date").alias("dateless"))


def waterfall(txns: DataFrame, decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """Stages of a statement's rows, how many reach each, and the share of the stage before."""
    seeded = truth.where("agreement_state <> 'UNSEEDED'")
    full = truth.where("agreement_state = 'FULL_AGREEMENT'")
    stages = [("1 rows", txns), ("2 accepted", decisions.where("accepted")), ("3 seeded", seeded), ("4 full agreement", full)]
    counts = None
    for name, rows in stages:
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.lag("n").over(Window.orderBy("stage")), 2))


def continuity_by_bank(audit: DataFrame, banks: DataFrame) -> DataFrame:
    """Per bank: statements, transitions, breaks and continuity over all its statements."""
    out = audit.join(banks, "doc_id").groupBy("bank").agg(F.count(F.lit(1)).alias("statements"), F.sum("total").alias("total"), F.sum("valid").alias("valid"))
    return out.select("bank", "statements", "total", (F.col("total") - F.col("valid")).alias("breaks"), F.round(100.0 * F.col("valid") / F.col("total"), 2).alias("continuity"))


def state_counts(truth: DataFrame) -> DataFrame:
    return truth.groupBy("agreement_state").agg(F.count(F.lit(1)).alias("n"))


def reject_class(date: Column, debit: Column, credit: Column, balance: Column, log: Column, conservation: Column) -> Column:
    """struct(primary, layer, confidence): why a row was lost, first rule that holds; log is what the parser said of it."""
    low = F.lower(F.coalesce(log, F.lit("")))
    rules = (
        (date.isNull() | (date == ""), "MISSING_DATE", "DECLARATIVE_PARSER", 0.95), (low.rlike("date_zone|date in|date_in_numeric"), "DATE_IN_NUMERIC_ZONE", "COLUMN_DETECTOR", 0.92), (balance.isNull(), "MISSING_BALANCE", "DECLARATIVE_PARSER", 0.95),
        (debit.isNull() & credit.isNull(), "MISSING_AMOUNT", "DECLARATIVE_PARSER", 0.90), (debit.isNotNull() & credit.isNotNull(), "DUAL_AMOUNT", "CANDIDATE_SELECTOR", 0.90),
        (F.coalesce(conservation == "FAIL", F.lit(False)) | low.rlike("conservation|reconcil"), "FAILED_RECONCILIATION", "VALIDATION_ENGINE", 0.92), (F.contains(low, F.lit("continuity")), "FAILED_CONTINUITY", "VALIDATION_ENGINE", 0.90),
        (low.rlike("(?s)column.*not found|not found.*column"), "COLUMN_NOT_FOUND", "COLUMN_DETECTOR", 0.85), (F.lit(True), "UNKNOWN", "DECLARATIVE_PARSER", 0.40),
    )
    return F.coalesce(*[F.when(c, F.struct(F.lit(p).alias("primary"), F.lit(layer).alias("layer"), F.lit(n).alias("confidence"))) for c, p, layer, n in rules])


def layer_funnel(tokens: DataFrame, boxes: DataFrame, decisions: DataFrame) -> DataFrame:
    """(doc_id, layer, count, dropped): how many items of a statement reach each layer of the parser."""
    counts = tokens.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens")).join(boxes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")), "doc_id", "left")
    counts = counts.join(decisions.groupBy("doc_id").agg(F.count_if("accepted").alias("emitted"), F.count_if(~F.col("accepted")).alias("rejected")), "doc_id", "left").na.fill(0)
    layer = lambda name, count, dropped: F.struct(F.lit(name).alias("layer"), count.cast("long").alias("count"), dropped.cast("long").alias("dropped"))
    rows = F.col("rows")
    layers = F.array(layer("OCR Tokens", F.col("tokens"), F.lit(0)), layer("Rows Built", rows, F.greatest(F.lit(0), F.col("tokens") - rows)), layer("Rows Parsed", rows, F.lit(0)), layer("Transactions Emitted", F.col("emitted"), F.col("rejected")))
    return counts.select("doc_id", F.inline(layers))
