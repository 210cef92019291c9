"""Statement confidence: balance candidates, sanity, and the weighted score of the audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import ledger as L
from ledgerloom.operators import ordering
from ledgerloom.sources.work import stored


def sane_balances(candidates: DataFrame) -> DataFrame:
    """candidates(doc_id, row_idx, pos, value, decimal_present, watermark, shifted) -> (doc_id, row_idx, balance).

    Values over 100 times the statement's median of trusted candidates go (10 times for suspects without decimals); if none of a
    row is left, the one closest to the median stays. A value with decimals is preferred, then a shifted one, then the first.
    """
    trusted = F.col("decimal_present") & ~F.col("watermark")
    median = candidates.groupBy("doc_id").agg(F.coalesce(F.median(F.when(trusted, F.col("value"))), F.median("value")).alias("m"))
    rows = candidates.join(median, "doc_id").withColumn("m", F.greatest("m", F.lit(1.0)))
    limit = F.when(F.col("watermark") & ~F.col("decimal_present"), F.col("m") * 10).otherwise(F.col("m") * 100)
    rank = F.when(F.col("value") > limit, 3).when(F.col("decimal_present"), 0).when(F.col("shifted"), 1).otherwise(2)
    # Survivors come first by kind and position; without any, the value next to the median.
    order = F.struct(rank.alias("rank"), F.when(rank == 3, F.abs(F.col("value") - F.col("m"))).otherwise(0.0).alias("away"), "pos")
    return rows.groupBy("doc_id", "row_idx").agg(F.min_by("value", order).alias("balance"))


def in_page_order(txns: DataFrame) -> DataFrame:
    """Ascending statements; of more than three pages, under 90 % continuity and dates that go back at a page's beginning,
    along the repaired order of pages. The ascending rows are stored, as three questions are asked of them."""
    ordered = stored(L.ascending(txns), "ascending")
    pages = ordered.groupBy("doc_id").agg(F.count_distinct("page").alias("pages")).where("pages > 3")
    broken = L.running_balance_audit(ordered).where("continuity < 90").select("doc_id")
    turned = ordering.page_reversals(ordered).where("anomaly").select("doc_id")
    doubtful = pages.join(broken, "doc_id").join(turned, "doc_id").select("doc_id")
    repaired = L.ascending(ordering.repair_pages(ordered.join(doubtful, "doc_id", "left_semi")))
    return ordered.join(doubtful, "doc_id", "left_anti").unionByName(repaired)


def statement_confidence(txns: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Per statement: continuity .40, reconciliation .35 and direction .15 of the healed rows, completeness .10, after the repair
    of page order; over 95 AUTO_APPROVE, from 80 REVIEW, else MANUAL_CHECK. Rounds half to even. expected(doc_id, expected) has
    the rows that statements should have; without it they are complete. The healed rows are stored for the three audits."""
    healed = stored(L.heal_directions(in_page_order(txns)), "healed")
    keep = ["doc_id", "continuity", "rows"]
    scores = L.running_balance_audit(healed).select(*keep).join(L.reconcile(healed).select("doc_id", "reconciliation"), "doc_id").join(L.direction_score(healed).select("doc_id", "direction_score"), "doc_id")
    complete = F.lit(100.0)
    if expected is not None:
        scores = scores.join(expected, "doc_id", "left")
        complete = F.when(F.col("expected") > F.col("rows"), F.col("rows") * 100.0 / F.col("expected")).otherwise(100.0)
    total = F.col("continuity") * 0.40 + F.col("reconciliation") * 0.35 + F.col("direction_score") * 0.15 + complete * 0.10
    out = scores.withColumn("confidence", F.bround(F.round(total, 6), 0).cast("int")).drop("rows", "expected")
    return out.withColumn("status", F.when(F.col("confidence") > 95, "AUTO_APPROVE").when(F.col("confidence") >= 80, "REVIEW").otherwise("MANUAL_CHECK"))


def row_scores(txns: DataFrame) -> DataFrame:
    """Per row: reconciled 40, date 10, amount 15, full marks for column and narration 35 (as no layout doubt is known)."""
    rows = L.transitions(txns)
    ok = F.coalesce(F.abs("diff_c") <= L.NEAR, F.lit(False))
    one = F.col("debit_c").isNotNull() != F.col("credit_c").isNotNull()
    score = F.when(ok, 40).otherwise(0) + F.when(F.col("date").isNotNull(), 10).otherwise(0) + F.when(one, 15).otherwise(0) + 20 + F.when(F.col("narration").isNotNull(), 15).otherwise(0)
    return rows.select("doc_id", "row_idx", ok.alias("reconciled"), score.alias("score"))


def statement_scores(scored: DataFrame) -> DataFrame:
    """Mean of row scores, less a fifth if over a fifth of the rows don't reconcile."""
    out = scored.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("reconciled")).alias("failed"), F.avg("score").alias("mean"))
    return out.select("doc_id", "failed", F.round(F.when(F.col("failed") > F.col("rows") * 0.2, F.col("mean") * 0.8).otherwise(F.col("mean")), 2).alias("statement_score"))
