"""Where amounts stand in relation to their columns: overlaps of zones, distances to their edges, and what failed rows have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import parse_float_safe, to_cents

#: Rows closer than this were merged; zones that overlap by such a percentage, and edges within NEAR of each other, were cut wrongly;
#: FAR is how far from its column's centre an amount has drifted.
MERGED, OVERLAP, NEAR, FAR, NO_ROW = 5.0, 15, 15, 50, 999.0


def zone_overlap(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    """Percent of a zone's width that another one covers; 0 for missing zones."""
    covered = F.least(hi, other_hi) - F.greatest(lo, other_lo)
    return F.coalesce(F.when((covered > 0) & (hi > lo), covered / (hi - lo) * 100), F.lit(0.0))


def distance_to_edge(x: Column, lo: Column, hi: Column) -> Column:
    """To the nearer edge; 999 without a zone."""
    return F.coalesce(F.least(F.abs(x - lo), F.abs(x - hi)), F.lit(NO_ROW))


def drift_rows(tokens: DataFrame, rows: DataFrame, zones: DataFrame) -> DataFrame:
    """Block tokens, accepted rows(doc_id, row_idx, page, block, credit_c, balance_c, conservation) and zones -> a row for each accepted
    row whose amount is found: (doc_id, row_idx, assigned, x, to_credit, to_balance, from_centre, next_distance, merged, failed, cause).

    The amount is the credit, else the balance. cause of a failed row: ROW_GROUPING, ZONE_CREATION, OCR_DRIFT or UNKNOWN, the first that holds.
    """
    bound = zones.groupBy("doc_id").agg(*[F.max(F.when(F.col("zone") == z, F.struct("lo", "hi"))).alias(z) for z in ("credit", "balance")])
    target = F.coalesce(F.nullif("credit_c", F.lit(0)), F.col("balance_c"))
    cells = tokens.join(rows.select("doc_id", "page", "block", target.alias("target")), ["doc_id", "page", "block"])
    same = to_cents(parse_float_safe(F.col("text"))) == F.col("target")
    found = cells.groupBy("doc_id", "page", "block").agg(F.min("y0").alias("top"), F.max("y1").alias("low"), F.min_by("x0", F.when(same, F.col("seq"))).alias("x"))
    by = Window.partitionBy("doc_id").orderBy("row_idx")
    each = rows.join(found, ["doc_id", "page", "block"]).withColumn("next_distance", F.coalesce(F.lead("top").over(by) - F.col("low"), F.lit(NO_ROW))).where("x IS NOT NULL").join(bound, "doc_id", "left")
    centre = lambda z: F.coalesce((F.col(f"{z}.lo") + F.col(f"{z}.hi")) / 2, F.lit(0.0))
    x = F.col("x")
    out = each.withColumns({
        "overlap": zone_overlap(*[F.col(f"{z}.{e}") for z in ("credit", "balance") for e in ("lo", "hi")]), "to_credit": distance_to_edge(x, F.col("credit.lo"), F.col("credit.hi")), "to_balance": distance_to_edge(x, F.col("balance.lo"), F.col("balance.hi")),
        "from_centre": F.when(centre("balance") != 0, F.abs(x - centre("balance"))).otherwise(NO_ROW), "merged": F.col("next_distance") < MERGED, "failed": F.col("conservation") != "PASS",
    })
    cause = F.when(F.col("merged"), "ROW_GROUPING").when((F.col("overlap") > OVERLAP) | (F.abs(F.col("to_credit") - F.col("to_balance")) < NEAR), "ZONE_CREATION").when((x > centre("balance") + NEAR) | (x < centre("credit") - NEAR), "OCR_DRIFT").otherwise("UNKNOWN")
    assigned = F.when(F.coalesce(F.col("credit_c"), F.lit(0)) != 0, "credit").otherwise("balance")
    return out.select("doc_id", "row_idx", assigned.alias("assigned"), x.cast("double").alias("x"), "to_credit", "to_balance", "from_centre", F.col("next_distance").cast("double").alias("next_distance"), "merged", "failed", F.when(F.col("failed"), cause).alias("cause"), "overlap")


def drift_causes(rows: DataFrame) -> DataFrame:
    """drift_rows -> (doc_id, rows, failures, overlap, cause): the suspected cause of a statement's failures."""
    failed = F.col("failed")
    out = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(failed).alias("failures"), F.max("overlap").alias("overlap"), F.max(failed & F.col("merged")).alias("m"), F.max(failed & (F.col("from_centre") > FAR)).alias("f"))
    cause = F.when(F.col("overlap") > OVERLAP, "ZONE_CREATION").when(F.col("m"), "ROW_GROUPING").when(F.col("f"), "OCR_DRIFT").otherwise("UNKNOWN")
    return out.select("doc_id", "rows", "failures", "overlap", cause.alias("cause"))
