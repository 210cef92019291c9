"""Order-dependent audits of statements. Money is in cents; rows are ordered by row_idx within doc_id.

All windows share one specification, so a plan with several of these operators has one exchange and one sort. "Previous
balance" means the previous row's (null breaks the chain), unless an operator says the last one that is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

NEAR, CONSERVED = 100, 150


def by() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("row_idx")


def before() -> WindowSpec:
    return by().rowsBetween(Window.unboundedPreceding, -1)


def amount(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def share(part: Column, whole: Column) -> Column:
    """Percent, rounded to two places; null if the whole is 0."""
    return F.round(F.try_divide(part * F.lit(100.0), whole), 2)


def break_reason(diff: Column, credit: Column, debit: Column) -> Column:
    """The first rule that holds: a large jump unlike either amount, twice an amount, an amount present, none present."""
    d = F.abs(diff)
    unlike = (F.abs(d - credit) > NEAR) & (F.abs(d - debit) > NEAR)
    twice = ((credit > 0) & (F.abs(d - 2 * credit) <= NEAR)) | ((debit > 0) & (F.abs(d - 2 * debit) <= NEAR))
    return (
        F.when((d > 1000) & unlike, "MISSING_TRANSACTION").when(twice, "DIRECTION_ERROR").when(((credit > 0) | (debit > 0)) & (d > NEAR), "AMOUNT_EXTRACTION_ERROR")
        .when((credit == 0) & (debit == 0), "BALANCE_CORRUPTION").otherwise("UNKNOWN_LEDGER_BREAK")
    )


def transitions(txns: DataFrame) -> DataFrame:
    """Adds prev_c, expected_c and diff_c (null where the chain is broken)."""
    prev = F.lag("balance_c").over(by())
    expected = F.col("prev_c") + amount("credit_c") - amount("debit_c")
    return txns.withColumn("prev_c", prev).withColumn("expected_c", expected).withColumn("diff_c", F.col("balance_c") - F.col("expected_c"))


def ledger_breaks(txns: DataFrame) -> DataFrame:
    """Rows whose balance is more than 1.00 off the one before, with a reason."""
    found = transitions(txns).where(F.abs("diff_c") > NEAR)
    return found.select("doc_id", "row_idx", "prev_c", "balance_c", "expected_c", "diff_c", break_reason(F.col("diff_c"), amount("credit_c"), amount("debit_c")).alias("reason"))


def running_balance_audit(txns: DataFrame) -> DataFrame:
    """Per statement: rows, transitions, valid ones, breaks by reason, continuity percent (100 for a single row, 0 without transitions)."""
    rows = transitions(txns)
    broken = F.abs("diff_c") > NEAR
    reason = F.when(broken, break_reason(F.col("diff_c"), amount("credit_c"), amount("debit_c")))
    names = ("MISSING_TRANSACTION", "DIRECTION_ERROR", "AMOUNT_EXTRACTION_ERROR", "BALANCE_CORRUPTION")
    out = rows.withColumn("reason", reason).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count("diff_c").alias("total"), F.count_if(~broken).alias("valid"), *[F.count_if(F.col("reason") == n).alias(n.lower()) for n in names])
    return out.withColumn("continuity", F.coalesce(share(F.col("valid"), F.col("total")), F.when(F.col("rows") == 1, 100.0).otherwise(0.0)))


def order_matches(txns: DataFrame, tolerance: int, null_is_zero: bool) -> tuple[Column, Column]:
    """Whether a row follows the one before it, and whether that one follows it."""
    value = (lambda c: F.coalesce(c, F.lit(0))) if null_is_zero else (lambda c: c)
    prev, own = value(F.lag("balance_c").over(by())), value(F.col("balance_c"))
    first = F.col("row_idx") == 0
    forward = F.abs(prev + amount("credit_c") - amount("debit_c") - own) <= tolerance
    back = F.abs(own + F.coalesce(F.lag("credit_c").over(by()), F.lit(0)) - F.coalesce(F.lag("debit_c").over(by()), F.lit(0)) - prev) <= tolerance
    return F.coalesce(forward & ~first, F.lit(False)), F.coalesce(back & ~first, F.lit(False))


def transaction_order(txns: DataFrame) -> DataFrame:
    """Per statement: matches of either order, whether it is descending, and confidence in whole percent, cut off."""
    forward, back = order_matches(txns, NEAR, False)
    out = txns.withColumn("f", forward).withColumn("b", back).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("f").alias("asc_matches"), F.count_if("b").alias("desc_matches"))
    descending, total = F.col("desc_matches") > F.col("asc_matches"), F.col("asc_matches") + F.col("desc_matches")
    winner, loser = F.greatest("asc_matches", "desc_matches"), F.least("asc_matches", "desc_matches")
    confidence = F.when(F.col("rows") < 2, 100).when(total == 0, 0).when(loser > 0, F.floor(winner * 100 / total)).otherwise(100)
    return out.select("doc_id", "asc_matches", "desc_matches", descending.alias("is_descending"), confidence.cast("int").alias("confidence"))


def ascending(txns: DataFrame) -> DataFrame:
    """Statements in ascending order: descending ones are reversed (row_idx is numbered anew)."""
    forward, back = order_matches(txns, NEAR, False)
    whole = Window.partitionBy("doc_id")
    rows = txns.withColumn("__turn", F.lit(0)).withColumn("__f", forward).withColumn("__b", back)
    turn = F.count_if(F.col("__b")).over(whole) > F.count_if(F.col("__f")).over(whole)
    place = F.when(turn, F.max("row_idx").over(whole) - F.col("row_idx")).otherwise(F.col("row_idx"))
    return rows.withColumn("row_idx", place).drop("__turn", "__f", "__b")


def heal_directions(txns: DataFrame) -> DataFrame:
    """Swaps debit and credit where the balance moved the other way by the same amount, against the last known balance.
    Adds ocr_direction, ledger_direction, direction_corrected and checked."""
    last = F.last("balance_c", ignorenulls=True).over(before())
    own = F.coalesce(F.when(F.col("credit_c") > 0, F.col("credit_c")), F.when(F.col("debit_c") > 0, F.col("debit_c")))
    seen = F.when(F.col("credit_c") > 0, "credit").when(F.col("debit_c") > 0, "debit")
    rows = txns.withColumn("delta_c", F.col("balance_c") - last).withColumn("ocr_direction", seen).withColumn("own_c", own)
    fits = F.abs(F.abs("delta_c") - F.col("own_c")) <= NEAR
    moved = F.when(fits, F.when(F.col("delta_c") > 0, "credit").otherwise("debit"))
    swap = F.coalesce(moved != F.col("ocr_direction"), F.lit(False))
    return rows.select(
        *[c for c in txns.columns if c not in ("debit_c", "credit_c")], F.when(swap, F.col("credit_c")).otherwise(F.col("debit_c")).alias("debit_c"), F.when(swap, F.col("debit_c")).otherwise(F.col("credit_c")).alias("credit_c"),
        "ocr_direction", F.coalesce(moved, "ocr_direction").alias("ledger_direction"), swap.alias("direction_corrected"), F.coalesce(F.col("delta_c").isNotNull() & F.col("own_c").isNotNull(), F.lit(False)).alias("checked"),
    )


def direction_score(healed: DataFrame) -> DataFrame:
    out = healed.groupBy("doc_id").agg(F.count_if("checked").alias("total_amounts"), F.count_if("direction_corrected").alias("corrected_amounts"))
    return out.withColumn("direction_score", F.coalesce(share(F.col("total_amounts") - F.col("corrected_amounts"), F.col("total_amounts")), F.lit(100.0)))


def reconcile(txns: DataFrame) -> DataFrame:
    """Per statement: opening from the first known balance, closing from the last one, the difference, and percent
    reconciled (100 within 1.00, else less by the difference's share of the volume)."""
    known = F.col("balance_c").isNotNull()
    opening = F.when(known, F.col("balance_c") - amount("credit_c") + amount("debit_c"))
    out = txns.withColumn("open_c", opening).groupBy("doc_id").agg(
        F.sum(amount("credit_c")).alias("credits_c"), F.sum(amount("debit_c")).alias("debits_c"), F.min_by("open_c", F.when(known, F.col("row_idx"))).alias("opening_c"), F.max_by("balance_c", F.when(known, F.col("row_idx"))).alias("closing_c"),
        F.min(F.when(known, F.col("row_idx"))).alias("opening_row"), F.max(F.when(known, F.col("row_idx"))).alias("closing_row"),
    )
    diff = F.col("opening_c") + F.col("credits_c") - F.col("debits_c") - F.col("closing_c")
    volume = F.col("credits_c") + F.col("debits_c")
    percent = F.when(F.abs(diff) <= NEAR, 100.0).when(diff.isNotNull() & (volume > 0), F.greatest(F.lit(0.0), 100.0 - F.abs(diff) * 100.0 / volume)).otherwise(0.0)
    return out.select("*", diff.alias("difference_c"), F.coalesce(F.abs(diff) <= NEAR, F.lit(False)).alias("is_reconciled"), F.round(percent, 2).alias("reconciliation"))


def financial_audit(txns: DataFrame) -> DataFrame:
    """Per statement: the strict audit, where a missing balance counts as 0 and a cent is a break, in the majority order."""
    forward, back = order_matches(txns, 0, True)
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = txns.withColumn("f", forward).withColumn("b", back)
    out = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("f").alias("asc_matches"), F.count_if("b").alias("desc_matches"), F.count_if((F.col("debit_c") < 0) | (F.col("credit_c") < 0)).alias("negative_amounts"),
        F.sum(amount("credit_c")).alias("credits_c"), F.sum(amount("debit_c")).alias("debits_c"), F.min_by(F.struct("balance_c", "credit_c", "debit_c"), "row_idx").alias("first"), F.max_by(F.struct("balance_c", "credit_c", "debit_c"), "row_idx").alias("last"),
    )
    descending = F.col("desc_matches") > F.col("asc_matches")
    valid = F.greatest("asc_matches", "desc_matches")
    side = lambda f: F.when(descending, F.col(f"last.{f}")).otherwise(F.col(f"first.{f}"))
    opening = zero(side("balance_c")) - zero(side("credit_c")) + zero(side("debit_c"))
    closing = zero(F.when(descending, F.col("first.balance_c")).otherwise(F.col("last.balance_c")))
    issues = F.col("rows") - 1 - valid
    reconciled = opening + F.col("credits_c") - F.col("debits_c") == closing
    passed = (issues == 0) & (F.col("negative_amounts") == 0) & reconciled & ((F.col("credits_c") != 0) | (F.col("debits_c") != 0))
    return out.select("doc_id", "rows", descending.alias("is_descending"), issues.alias("running_balance_issues"), "negative_amounts", reconciled.alias("opening_balance_reconciled"), passed.alias("audit_passed"))


def conservation(prev: Column, credit: Column, debit: Column, balance: Column) -> Column:
    return F.when(prev.isNull() | balance.isNull(), "UNSEEDED").when(F.abs(prev + credit - debit - balance) <= CONSERVED, "PASS").otherwise("FAIL")


def qualify(txns: DataFrame) -> DataFrame:
    """Accepts or rejects each candidate row: no date, nothing at all, no side, both sides; an unconserved row is accepted as a
    conflict. The previous balance is that of the last accepted row, which may be null."""
    none, both = F.col("debit_c").isNull() & F.col("credit_c").isNull(), F.col("debit_c").isNotNull() & F.col("credit_c").isNotNull()
    hard = F.when(F.col("date").isNull() | (F.col("date") == ""), "no_date").when(none & F.col("balance_c").isNull(), "NO_TRANSACTION_SEED").when(none, "no_debit_or_credit").when(both, "both_debit_and_credit")
    rows = txns.withColumn("hard", hard)
    prev = F.last(F.when(F.col("hard").isNull(), F.struct("balance_c")), ignorenulls=True).over(before())["balance_c"]
    rows = rows.withColumn("prev_c", prev)
    state = F.when(F.col("hard").isNull(), conservation(F.col("prev_c"), amount("credit_c"), amount("debit_c"), F.col("balance_c"))).otherwise("UNSEEDED")
    rows = rows.withColumn("conservation", state)
    reason = F.coalesce("hard", F.when(F.col("conservation") == "FAIL", "conservation_conflict").otherwise("ok"))
    return rows.select("doc_id", "row_idx", F.col("hard").isNull().alias("accepted"), reason.alias("reason"), "conservation")


def corruptions(txns: DataFrame) -> DataFrame:
    """(doc_id, row_idx, kind): a row for each sign of corruption; the ledger is checked against the last known balance."""
    last = F.last("balance_c", ignorenulls=True).over(before())
    rows = txns.withColumn("last_c", last)
    off = F.abs(F.col("last_c") + amount("credit_c") - amount("debit_c") - F.col("balance_c")) > CONSERVED
    kinds = F.array_compact(F.array(
        F.when(F.col("credit_c") == F.col("balance_c"), "BALANCE_AS_CREDIT"), F.when(F.col("debit_c") == F.col("balance_c"), "BALANCE_AS_DEBIT"),
        F.when(F.col("credit_c").isNotNull() & F.col("debit_c").isNotNull(), "MULTIPLE_AMOUNTS"), F.when(off, "LEDGER_FAIL"),
    ))
    return rows.select("doc_id", "row_idx", F.explode(kinds).alias("kind"))


def monotonic(txns: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Per statement: is the sequence of known balances rising or falling, but for a share of its steps?"""
    known = txns.where("balance_c is not null")
    step = known.withColumn("step", F.col("balance_c") - F.lag("balance_c").over(by()))
    out = step.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("step") >= 0).alias("rising"), F.count_if(F.col("step") <= 0).alias("falling"))
    most = F.greatest("rising", "falling")
    return out.withColumn("is_monotonic", F.coalesce((F.col("n") >= 3) & (most >= (F.col("n") - 1) * (1 - tolerance) - 1e-9), F.lit(False)))


def ledger_truth(txns: DataFrame) -> DataFrame:
    """Agreement of each row's amount with the balance's move: FULL, PARTIAL, CONFLICT, or UNSEEDED with a reason."""
    rows = txns.withColumn("prev_c", F.lag("balance_c").over(by()))
    delta = F.col("balance_c") - F.col("prev_c")
    own = F.coalesce("debit_c", "credit_c", F.lit(0))
    seen = F.when(F.col("debit_c").isNotNull(), "debit").when(F.col("credit_c").isNotNull(), "credit").otherwise("none")
    expected = F.when(delta == 0, "none").when(delta > 0, "credit").otherwise("debit")
    near, same = F.abs(own - F.abs(delta)) <= CONSERVED, (seen == expected) | ((delta == 0) & (own == 0))
    reason = F.when(F.col("row_idx") == 0, "NO_PREVIOUS_BALANCE").when(F.col("balance_c").isNull(), "NO_CURRENT_BALANCE").when(F.col("prev_c").isNull(), "NO_PREVIOUS_BALANCE")
    state = F.when(reason.isNotNull(), "UNSEEDED").when(near & same, "FULL_AGREEMENT").when(near | same, "PARTIAL_AGREEMENT").otherwise("CONFLICT")
    return rows.select("doc_id", "row_idx", state.alias("agreement_state"), reason.alias("reason"), F.when(reason.isNull(), F.abs(delta)).alias("expected_delta_c"), F.when(reason.isNull(), expected).alias("expected_direction"))


def anomaly_chain(txns: DataFrame) -> DataFrame:
    """Anomalies of a statement in order: a residual opens one, the opposite residual closes it as its downstream effect,
    a clean row drops it, unseeded rows leave it. (doc_id, row_idx, kind, anomaly_id, root_row)

    A fold over each statement's residuals (a few numbers a row) with a higher-order function, inside the JVM.
    """
    from ledgerloom.functions.signals import ledger_suspicion

    rows = transitions(txns).where("diff_c is not null")
    kind = F.coalesce(ledger_suspicion(F.col("diff_c")), F.lit("PRIMARY_BALANCE_ANOMALY"))
    steps = F.sort_array(F.collect_list(F.struct("row_idx", "diff_c", kind.alias("kind"))))
    state = "struct<error:bigint,root:int,n:int,out:array<struct<row_idx:int,kind:string,anomaly:int,root_row:int>>>"
    start = F.struct(F.lit(0).cast("long").alias("error"), F.lit(None).cast("int").alias("root"), F.lit(0).alias("n"), F.array().cast("array<struct<row_idx:int,kind:string,anomaly:int,root_row:int>>").alias("out")).cast(state)

    def entry(s, kind, n, root):
        return F.struct(s["row_idx"].alias("row_idx"), kind.alias("kind"), n.alias("anomaly"), root.alias("root_row"))

    def step(acc, s):
        closes = acc["root"].isNotNull() & (F.abs(s["diff_c"] + acc["error"]) <= 1)
        none = F.lit(None).cast("int")
        clean = F.struct(F.lit(0).cast("long").alias("error"), none.alias("root"), acc["n"].alias("n"), acc["out"].alias("out"))
        closed = F.struct(F.lit(0).cast("long").alias("error"), none.alias("root"), acc["n"].alias("n"), F.array_append(acc["out"], entry(s, F.lit("DOWNSTREAM_CHAIN_EFFECT"), acc["n"], acc["root"])).alias("out"))
        opened = F.struct(s["diff_c"].alias("error"), s["row_idx"].alias("root"), (acc["n"] + 1).alias("n"), F.array_append(acc["out"], entry(s, s["kind"], acc["n"] + 1, s["row_idx"])).alias("out"))
        return F.when(s["diff_c"] == 0, clean.cast(state)).when(closes, closed.cast(state)).otherwise(opened.cast(state))

    folded = rows.groupBy("doc_id").agg(steps.alias("steps")).select("doc_id", F.explode(F.aggregate("steps", start, step)["out"]).alias("e"))
    return folded.select("doc_id", "e.row_idx", "e.kind", F.format_string("A%04d", "e.anomaly").alias("anomaly_id"), "e.root_row")


def worst_breaks(txns: DataFrame, n: int = 3) -> DataFrame:
    """The n largest breaks of all statements (a top-k report), ties by statement and row."""
    return ledger_breaks(txns).orderBy(F.desc(F.abs("diff_c")), "doc_id", "row_idx").limit(n)


def last_rows(txns: DataFrame, n: int = 5) -> DataFrame:
    """The last n rows of each statement."""
    back = Window.partitionBy("doc_id").orderBy(F.desc("row_idx"))
    return txns.withColumn("from_end", F.row_number().over(back)).where(F.col("from_end") <= n)
