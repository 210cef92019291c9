"""Rows that the solver lost: each is tried in every gap of its statement, and the report of a whole text parse.

A lost row fits a gap if its balance moves from the balance before the gap by one of its other numbers. That is a band
join: for every number the balance before the gap is known to within NEAR, so gaps are joined on (statement, bucket of that
balance), and no row meets all gaps of its statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.textlines import NEAR, statement_summary
from ledgerloom.sources.work import stored

#: Recovery is tried for statements that lack so many rows at most, and such a part of them.
MOST_ROWS, MOST_SHARE = 5, 0.20
#: Points of a fit, in tenths: a number matches the move, no other number is there, the next row fits on, a base; and what suffices.
MATCH, SINGLE, NEXT, BASE, ENOUGH = 4, 3, 2, 1, 7
WIDTH = 2 * NEAR + 1


def signature(date: Column, balance_c: Column, numbers: Column, raw: Column) -> Column:
    """date_balance_count_digest of a row, the digest from the first 50 characters of its text without blanks."""
    digest = F.substring(F.md5(F.lower(F.substring(F.regexp_replace(raw, r"\s+", ""), 1, 50))), 1, 8)
    return F.concat_ws("_", date, balance_c.cast("string"), numbers.cast("string"), digest)


def opened(txns: DataFrame, seeds: DataFrame) -> DataFrame:
    """Transactions of which a statement's first row without an amount takes its move from the balance to start from."""
    first = Window.partitionBy("doc_id").orderBy("row_no")
    rows = txns.join(seeds.select("doc_id", F.col("value_c").alias("seed_c")), "doc_id", "left").withColumn("nth", F.row_number().over(first) - 1)
    move = F.when((F.col("nth") == 0) & F.col("debit_c").isNull() & F.col("credit_c").isNull(), F.col("balance_c") - F.col("seed_c"))
    debit, credit = F.when(move < -1, -move).otherwise(F.col("debit_c")), F.when(move > 1, move).otherwise(F.col("credit_c"))
    return rows.withColumns({"debit_c": debit, "credit_c": credit, "opened": F.coalesce(F.abs(move) > 1, F.lit(False))}).drop("seed_c")


def gaps(rows: DataFrame) -> DataFrame:
    """(doc_id, slot, before_c, after_c, after_amount, last): the gaps between kept rows, the first before the first of them."""
    by = Window.partitionBy("doc_id").orderBy("row_no")
    amount = F.coalesce(F.nullif("credit_c", F.lit(0)), F.col("debit_c"))
    kept = rows.where("taken").select("doc_id", "row_no", "nth", "balance_c", "seed_c", amount.alias("amount"))
    kept = kept.withColumns({"next_c": F.lead("balance_c").over(by), "next_amount": F.lead("amount").over(by), "last": F.lead("nth").over(by).isNull()})
    after = F.struct((F.col("nth") + 1).alias("slot"), F.col("balance_c").alias("before_c"), F.col("next_c").alias("after_c"), F.col("next_amount").alias("after_amount"), F.col("last"))
    head = F.struct(F.col("nth").alias("slot"), F.col("seed_c").alias("before_c"), F.col("balance_c").alias("after_c"), F.col("amount").alias("after_amount"), F.lit(False).alias("last"))
    each = kept.select("doc_id", F.explode(F.when(F.col("nth") == 0, F.array(head, after)).otherwise(F.array(after))).alias("g")).select("doc_id", "g.*")
    return each.where("before_c IS NOT NULL")


def fits(lost: DataFrame, gaps: DataFrame) -> DataFrame:
    """lost(doc_id, row_no, balance_c, others) in gaps -> (doc_id, row_no, best(slot, confidence, amount_c, move)): the best gap of each."""
    low = lambda v, sign: F.col("balance_c") + sign * v - NEAR
    reach = F.flatten(F.transform("others", lambda v: F.flatten(F.array(*[F.sequence(F.floor(low(v, s) / WIDTH), F.floor((low(v, s) + 2 * NEAR) / WIDTH)) for s in (-1, 1)]))))
    wanted = lost.withColumn("bucket", F.explode(F.array_distinct(reach)))
    met = wanted.join(gaps.withColumn("bucket", F.floor(F.col("before_c") / WIDTH)), ["doc_id", "bucket"])
    move = F.col("balance_c") - F.col("before_c")
    matching = F.get(F.filter("others", lambda v: F.abs(v - F.abs(F.col("move"))) <= NEAR), F.lit(0))
    met = met.withColumn("move", move).withColumn("amount_c", matching).where("amount_c IS NOT NULL")
    on = F.coalesce(F.abs(F.abs(F.col("after_c") - F.col("balance_c")) - F.nullif("after_amount", F.lit(0))) <= NEAR, F.lit(False)) | (F.col("after_c").isNull() & F.col("last"))
    points = F.lit(MATCH + BASE) + F.when(F.size("others") == 1, SINGLE).otherwise(0) + F.when(on, NEXT).otherwise(0)
    return met.groupBy("doc_id", "row_no").agg(F.max_by(F.struct("slot", points.alias("confidence"), "amount_c", "move"), F.struct(points.alias("p"), -F.col("slot"))).alias("best"))


def recover(candidates: DataFrame, txns: DataFrame, seeds: DataFrame) -> DataFrame:
    """candidates (raw rows), txns (solved, opened) and seeds(doc_id, value_c) -> every candidate with its state:
    (doc_id, row_no, page, date, narration, debit_c, credit_c, balance_c, state, confidence, tried, place).

    kept: the solver had it; recovered: it fits a gap; lost: its signature is no kept row's and it fits none; unread: neither. Rows are
    tried for statements that lack few of them. `place` orders the kept and recovered rows; of rows recovered in one gap the later
    candidate stands first.
    """
    own = txns.select("doc_id", "row_no", "debit_c", "credit_c", "balance_column", "opened")
    rows = candidates.join(own, ["doc_id", "row_no"], "left").join(seeds.select("doc_id", F.col("value_c").alias("seed_c")), "doc_id", "left").withColumn("taken", F.col("balance_column").isNotNull())
    doc = Window.partitionBy("doc_id")
    upto = doc.orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    column, had, got = F.max("balance_column").over(doc), F.count(F.lit(1)).over(doc), F.count("balance_column").over(doc)
    rows = rows.withColumns({"column": column, "lacks": had - got, "had": had, "nth": F.coalesce(F.count("balance_column").over(upto), F.lit(0)).cast("int")})
    rows = rows.withColumn("tried", (F.col("lacks") > 0) & (F.col("lacks") <= MOST_ROWS) & (F.round(F.col("lacks") / F.col("had"), 4) <= MOST_SHARE))
    rows = rows.withColumn("balance_c", F.get("numbers", F.col("column"))["cents"])
    others = F.transform(F.filter("numbers", lambda n, i: i != F.col("column")), lambda n: n["cents"])
    rows = rows.withColumns({"others": others, "signature": signature(F.col("date"), F.col("balance_c"), F.size("numbers"), F.array_join("lines", " "))})
    known = F.max("taken").over(Window.partitionBy("doc_id", "signature"))
    rows = rows.withColumn("lost", F.col("tried") & F.col("balance_c").isNotNull() & ~known)
    best = fits(rows.where("lost").select("doc_id", "row_no", "balance_c", "others"), gaps(rows))
    rows = rows.join(best, ["doc_id", "row_no"], "left").withColumn("saved", F.coalesce(F.col("best.confidence") >= ENOUGH, F.lit(False)))
    state = F.when(F.col("taken"), "kept").when(F.col("saved"), "recovered").when(F.col("lost"), "lost").otherwise("unread")
    side = lambda c, sign: F.when(F.col("saved"), F.when(F.col("best.move") * sign > 0, F.col("best.amount_c"))).otherwise(F.col(c)).alias(c)
    spot = lambda slot, kind, turn: F.struct(slot.alias("slot"), F.lit(kind).alias("kind"), turn.cast("int").alias("turn"))
    place = F.when(F.col("taken"), spot(F.col("nth"), 1, F.lit(0))).when(F.col("saved"), spot(F.col("best.slot"), 0, -F.col("row_no")))
    confidence = F.when(F.col("saved"), F.col("best.confidence") / 10.0).alias("confidence")
    return rows.select("doc_id", "row_no", "page", "date", "narration", side("debit_c", -1), side("credit_c", 1), "balance_c", state.alias("state"), confidence, "tried", F.coalesce("opened", F.lit(False)).alias("opened"), place.alias("place"))


def transactions(states: DataFrame) -> DataFrame:
    """The kept and recovered rows of recover, numbered anew."""
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) - 1).alias("row_no")
    return states.where("place IS NOT NULL").select("doc_id", number, "page", "date", "narration", "debit_c", "credit_c", "balance_c", (F.col("state") == "recovered").alias("recovered"), "confidence")


def report(texts: DataFrame, states: DataFrame, seeds: DataFrame) -> DataFrame:
    """A row for each statement of texts(doc_id, text): (doc_id, candidates, accepted, missing_ratio, opened, tried, recovered, failed, seed_source,
    seed_score, page_failure, summary_found, summary_match, hard_failure, status), states from recover.

    A page fails if two of its rows or more were candidates and none is left. Status: FAIL without
    rows or without any amount, WARNING from 5 % missing rows, a failed page or a summary that contradicts, else PASS.
    """
    in_state = lambda *names: F.count_if(F.col("state").isin(*names))
    live = F.col("state").isin("kept", "recovered")
    pages = states.groupBy("doc_id", "page").agg(
        F.count(F.lit(1)).alias("candidates"), in_state("kept", "recovered").alias("rows"), in_state("recovered").alias("recovered"), in_state("lost").alias("failed"), F.count_if("opened").alias("opened"),
        F.sum(F.when(live, F.col("debit_c"))).alias("debits"), F.sum(F.when(live, F.col("credit_c"))).alias("credits"), F.max("tried").alias("tried"),
    )
    counts = ("candidates", "rows", "recovered", "failed", "opened", "debits", "credits")
    sums = pages.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in counts], F.max("tried").alias("tried"), F.max((F.col("candidates") >= 2) & (F.col("rows") == 0)).alias("page_failure"))
    out = texts.select("doc_id", statement_summary(F.col("text")).alias("s")).join(sums, "doc_id", "left").join(seeds.select("doc_id", F.col("source").alias("seed_source"), F.col("score").alias("seed_score")), "doc_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts} | {c: F.coalesce(c, F.lit(False)) for c in ("tried", "page_failure")})
    hard = F.when(F.col("candidates") == 0, "NO_ROWS_EXTRACTED").when(F.col("rows") == 0, "ZERO_EXTRACTED_TRANSACTIONS").when((F.col("debits") == 0) & (F.col("credits") == 0), "ZERO_DEBIT_AND_CREDIT")
    found = F.coalesce(F.col("s.dr_count"), F.col("s.cr_count"), F.col("s.total_debit_c"), F.col("s.total_credit_c")).isNotNull()
    against = lambda n, total: F.coalesce(F.col(f"s.{n}") > 0, F.lit(False)) & (F.col(total) == 0)
    ratio = F.when(F.col("candidates") > 0, F.round((F.col("candidates") - F.col("rows")) / F.col("candidates"), 4)).otherwise(1.0)
    out = out.withColumns({"hard_failure": hard, "summary_found": found, "summary_match": ~(against("dr_count", "debits") | against("cr_count", "credits")), "missing_ratio": ratio})
    warned = (F.col("missing_ratio") >= 0.05) | F.col("page_failure") | (F.col("summary_found") & ~F.col("summary_match"))
    status = F.when(F.col("hard_failure").isNotNull(), "FAIL").when(warned, "WARNING").otherwise("PASS")
    accepted = F.when(F.col("hard_failure").isNull(), F.col("rows")).otherwise(0)
    return out.select("doc_id", "candidates", accepted.alias("accepted"), "missing_ratio", "opened", "tried", "recovered", "failed", "seed_source", "seed_score", "page_failure", "summary_found", "summary_match", "hard_failure", status.alias("status"))


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines(doc_id, line_no, text) -> transactions and the report of each statement: the whole text parser."""
    from ledgerloom.operators import textlines

    clean = stored(textlines.preprocess(lines), "lines")
    rows, seeds = stored(textlines.raw_rows(clean), "raw-rows"), stored(textlines.statement_seeds(clean), "seeds")
    states = stored(recover(rows, stored(opened(textlines.solved(rows, seeds), seeds), "transactions"), seeds), "states")
    done = report(textlines.whole_texts(lines.withColumn("part", F.lit(0))), states, seeds)
    return transactions(states).join(done.where("hard_failure IS NULL").select("doc_id"), "doc_id", "left_semi"), done
