"""Comparison of readings of the same statements, by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS, TOLERANCE = ("debit_c", "credit_c", "balance_c"), 100


def side(txns: DataFrame, name: str) -> DataFrame:
    return txns.select("doc_id", "row_idx", F.lit(True).alias(f"in_{name}"), *[F.col(c).alias(f"{name}_{c}") for c in FIELDS])


def differs(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) > TOLERANCE, a.isNull() != b.isNull())


def first_divergence(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per statement the first row that differs: (doc_id, row_idx, field); field row_count if a reading lacks the row."""
    both = side(old, "a").join(side(new, "b"), ["doc_id", "row_idx"], "full")
    field = F.when(F.col("in_a").isNull() | F.col("in_b").isNull(), "row_count")
    for c in FIELDS:
        field = field.when(differs(F.col(f"a_{c}"), F.col(f"b_{c}")), c)
    return both.withColumn("field", field).where("field is not null").groupBy("doc_id").agg(F.min("row_idx").alias("row_idx"), F.min_by("field", "row_idx").alias("field"))


def three_way(one: DataFrame, two: DataFrame, three: DataFrame) -> DataFrame:
    """Rows on which three readings disagree: a spread over 1.00 in a field, or a row that is absent."""
    on = ["doc_id", "row_idx"]
    rows = side(one, "v1").join(side(two, "v2"), on, "full").join(side(three, "v3"), on, "full")
    spread = {c: F.greatest(*[F.col(f"v{i}_{c}") for i in (1, 2, 3)]) - F.least(*[F.col(f"v{i}_{c}") for i in (1, 2, 3)]) for c in FIELDS}
    absent = reduce(lambda a, b: a | b, [F.col(f"in_v{i}").isNull() for i in (1, 2, 3)])
    flags = [F.coalesce(spread[c] > TOLERANCE, F.lit(False)).alias(f"{c}_spread") for c in FIELDS]
    out = rows.select(*on, *flags, absent.alias("absent"))
    return out.where("absent or " + " or ".join(f"{c}_spread" for c in FIELDS))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1 in percent, two places, 0 where undefined."""
    p, r = F.coalesce(F.try_divide(tp * F.lit(100.0), tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp * F.lit(100.0), tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(tp * F.lit(200.0), 2 * tp + fp + fn), F.lit(0.0))
    return [F.round(p, 2).alias("precision"), F.round(r, 2).alias("recall"), F.round(f1, 2).alias("f1")]


def corpus_matrix(truth: DataFrame, parsed: DataFrame, banks: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Per bank: counts, missing and extra rows of its statements, amount and balance errors by position, order errors,
    precision, recall, F1 and the gate (error counts at most, qualities at least the limits)."""
    n = lambda t, name: t.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    counts = n(truth, "expected").join(n(parsed, "parsed"), "doc_id", "full").na.fill(0)
    pairs = side(truth, "a").join(side(parsed, "b"), ["doc_id", "row_idx"])
    off = lambda c: F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) > TOLERANCE, F.lit(False))
    errors = pairs.groupBy("doc_id").agg(F.count_if(off("debit_c") | off("credit_c")).alias("amount_errors"), F.count_if(off("balance_c")).alias("balance_errors"))
    from ledgerloom.operators.ledger import by

    order = parsed.withColumn("back", F.col("date") < F.lag("date").over(by())).groupBy("doc_id").agg(F.count_if("back").alias("ordering_errors"))
    docs = counts.join(errors, "doc_id", "left").join(order, "doc_id", "left").na.fill(0).join(banks, "doc_id")
    sums = ("expected", "parsed", "amount_errors", "balance_errors", "ordering_errors")
    out = docs.groupBy("bank").agg(*[F.sum(c).alias(c) for c in sums], F.sum(F.greatest(F.lit(0), F.col("expected") - F.col("parsed"))).alias("missing"), F.sum(F.greatest(F.lit(0), F.col("parsed") - F.col("expected"))).alias("extra"))
    out = out.select("*", *prf(F.col("expected") - F.col("missing"), F.col("extra"), F.col("missing")))
    checks = [F.col(k) >= v if k in ("precision", "recall", "f1") else F.col(k) <= v for k, v in limits.items()]
    return out.withColumn("passed", reduce(lambda a, b: a & b, checks, F.lit(True)))


def positional_accuracy(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per statement: rows compared, missing and extra ones, and errors of each field by position."""
    both = side(truth, "a").join(side(parsed, "b"), ["doc_id", "row_idx"], "full")
    here = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    errors = [F.count_if(here & differs(F.col(f"a_{c}"), F.col(f"b_{c}"))).alias(f"{c}_errors") for c in FIELDS]
    return both.groupBy("doc_id").agg(F.count_if(here).alias("compared"), F.count_if(F.col("in_b").isNull()).alias("missing"), F.count_if(F.col("in_a").isNull()).alias("extra"), *errors)
