"""Which column of numbers is the running balance? rows(doc_id, row_idx, numbers array<bigint>), cents, left to right."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEAR, ROUNDING = 200, 5


def number_rows(txns: DataFrame) -> DataFrame:
    """A ledger as rows of bare numbers, as a text line shows them."""
    return txns.select("doc_id", "row_idx", F.array_compact(F.array("debit_c", "credit_c", "balance_c")).alias("numbers"))


def column_scores(rows: DataFrame) -> DataFrame:
    """(doc_id, b, n, hits, score) of each candidate column: a hit is a row whose move from the previous row with that
    column equals another number of the row within 2.00, or is at most 0.05; score = hits / max(1, n - 1)."""
    cells = rows.select("doc_id", "row_idx", "numbers", F.posexplode("numbers").alias("b", "value"))
    by = Window.partitionBy("doc_id", "b").orderBy("row_idx")
    moved = cells.withColumn("move", F.abs(F.col("value") - F.lag("value").over(by)))
    away = F.array_min(F.transform(F.col("numbers"), lambda v, i: F.when(i != F.col("b"), F.abs(v - F.col("move")))))
    hit = (away <= NEAR) | (F.col("move") <= ROUNDING)
    out = moved.groupBy("doc_id", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
    return out.withColumn("score", F.col("hits") / F.greatest(F.lit(1), F.col("n") - 1))


def solve(rows: DataFrame) -> DataFrame:
    """Per statement the best column: .97 of the score, a hint of .0009 for the last column, ties to the first."""
    widest = rows.groupBy("doc_id").agg(F.max(F.size("numbers")).alias("width"))
    scored = column_scores(rows).join(widest, "doc_id").withColumn("total", F.col("score") * 0.97 + F.when(F.col("b") == F.col("width") - 1, 0.0009).otherwise(0.0))
    best = scored.groupBy("doc_id").agg(F.max_by(F.struct("b", "n", "hits"), F.struct("total", -F.col("b"))).alias("best"))
    return best.select("doc_id", "best.b", "best.n", "best.hits")


def missing_rows(found: DataFrame, all_rows: DataFrame) -> DataFrame:
    """Candidate rows whose signature (date, balance, how many numbers, narration digest) was not extracted: a left anti join."""
    key = F.substring(F.md5(F.lower(F.substring(F.regexp_replace("narration", r"\s+", ""), 1, 50))), 1, 8)
    count = F.size(F.array_compact(F.array("debit_c", "credit_c", "balance_c"))).cast("string")
    signed = lambda t: t.withColumn("signature", F.concat_ws("_", "date", F.col("balance_c").cast("string"), count, key))
    return signed(all_rows).join(signed(found).select("doc_id", "signature"), ["doc_id", "signature"], "left_anti").select("doc_id", "row_idx", "signature")
