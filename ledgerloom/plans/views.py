"""Statement-shaped tables built from the supplied ones: ledger L, a second reading of it, amount strings A, lines and tokens T."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_ROWS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, row_idx, page, date, narration, debit_c, credit_c, balance_c, k): an account's orders as a statement in
    cents, with faults by order key: no balance, balances off by 1000.00 or 3.00, sides swapped, both sides, no side."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", "o_orderdate", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"))
    by = Window.partitionBy("doc_id").orderBy("o_orderdate", "o_orderkey")
    k = F.col("o_orderkey")
    credit = k % 3 != 0
    rows = orders.withColumn("row_idx", F.row_number().over(by) - 1).withColumn("true_c", F.sum(F.when(credit, F.col("amount")).otherwise(-F.col("amount"))).over(by))
    shown = (credit & (k % 41 != 0)) | (~credit & (k % 41 == 0))
    amount = F.when(k % 53 != 0, F.col("amount"))
    both = k % 61 == 0
    balance = F.when(k % 29 != 0, F.col("true_c") + F.when(k % 17 == 0, 100000).when(k % 23 == 0, 300).otherwise(0))
    return rows.select(
        "doc_id", "row_idx", (F.floor(F.col("row_idx") / PAGE_ROWS) + 1).cast("int").alias("page"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("UPI "), F.col("o_orderpriority"), F.lit(" "), k).alias("narration"), F.when(~shown | both, amount).alias("debit_c"), F.when(shown | both, amount).alias("credit_c"), balance.alias("balance_c"), k.alias("k"),
    )


def second_reading(txns: DataFrame) -> DataFrame:
    """Another parser's result for the same statements: rows lost, amounts and balances misread, by order key."""
    k = F.col("k")
    kept = txns.where(k % 31 != 0)
    by = Window.partitionBy("doc_id").orderBy("row_idx")
    return kept.select("doc_id", (F.row_number().over(by) - 1).alias("row_idx"), "page", "date", "narration", F.when(k % 37 == 0, F.col("debit_c") + 5000).otherwise(F.col("debit_c")).alias("debit_c"), "credit_c", F.when(k % 43 == 0, None).otherwise(F.col("balance_c")).alias("balance_c"), "k")


def banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, bank): the segment of a customer stands for the bank of a statement."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("bank"))


def amount_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): prices of line items as a scanner may read them."""
    item = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    whole, part = F.floor(cents / 100).cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    head, tail = F.regexp_replace(whole, r"(\d{3})$", ""), F.right(whole, F.lit(3))
    kind = F.col("l_orderkey") % 10
    text = (
        F.when(kind == 0, F.concat(head, F.lit(","), tail, F.lit("."), part)).when(kind == 1, F.concat(head, F.lit("."), tail, F.lit("."), part)).when(kind == 2, F.concat(whole, F.lit("."), part, F.lit(" CR")))
        .when(kind == 3, F.concat(head, F.lit("."), tail)).when(kind == 4, F.concat(F.right(whole, F.lit(2)), F.lit("."), tail, part)).when(kind == 5, F.concat(whole, F.lit(","), part))
        .when(kind == 6, F.concat(F.lit("-"), whole, F.lit("."), part)).when(kind == 7, F.concat(F.lit("Rs "), head, F.lit(","), tail, F.lit("O"))).when(kind == 8, F.concat(whole, F.lit("."), part, F.lit("L128"))).otherwise(F.lit("n/a"))
    )
    return item.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), text.alias("text"))


def statement_lines(txns: DataFrame) -> DataFrame:
    """(doc_id, page, line_idx, text): the ledger as printed lines, each page with a header and a footer line."""
    money = lambda c: F.when(F.col(c).isNotNull(), F.format_number(F.col(c) / 100.0, 2))
    day = F.concat_ws("/", F.substring("date", 9, 2), F.substring("date", 6, 2), F.substring("date", 1, 4))
    row = txns.select("doc_id", "page", (F.col("row_idx") % PAGE_ROWS + 1).cast("int").alias("line_idx"), F.concat_ws("  ", day, "narration", money("debit_c"), money("credit_c"), money("balance_c")).alias("text"))
    pages = txns.select("doc_id", "page").distinct()
    head = pages.select("doc_id", "page", F.lit(0).alias("line_idx"), F.lit("DATE  NARRATION  DEBIT  CREDIT  BALANCE").alias("text"))
    foot = pages.select("doc_id", "page", F.lit(PAGE_ROWS + 1).alias("line_idx"), F.concat(F.lit("Statement of Account Page "), "page").alias("text"))
    return row.unionByName(head).unionByName(foot)


def tokens(lines: DataFrame) -> DataFrame:
    """(doc_id, page, tok_idx, text, x0, x1, y0, y1): words of printed lines with a geometry in whole units, rows 12 apart, words up to 2 off."""
    words = lines.select("doc_id", "page", "line_idx", F.posexplode(F.split("text", r"\s+")).alias("w", "text"))
    y = 12 * F.col("line_idx") + F.col("w") % 3
    return words.select("doc_id", "page", (F.col("line_idx") * 100 + F.col("w")).alias("tok_idx"), "text", (40 * F.col("w")).alias("x0"), (40 * F.col("w") + 6 * F.length("text")).alias("x1"), y.alias("y0"), (y + 8).alias("y1"), "line_idx")


def printed_statement(txns: DataFrame) -> DataFrame:
    """(doc_id, line_no, text): a statement as its lines come out of a page: page marks, headings, balances to start from, rows with
    dates in three shapes and balances 5,000,000.00 higher (so that none is negative), wrapped narration, payments without a date, footers, totals and stray text."""
    k, money = F.col("k"), lambda c: F.when(F.col(c).isNotNull(), F.format_number(F.col(c) / 100.0, 2))
    day = F.to_date("date")
    shown = F.when(k % 5 == 0, F.date_format(day, "dd-MMM-yyyy")).when(k % 5 == 1, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    first = F.col("row_idx") == 0
    lines = (
        F.when(F.col("row_idx") % PAGE_ROWS == 0, F.concat(F.lit("PAGE "), "page")), F.when(F.col("row_idx") % PAGE_ROWS == 0, F.lit("Date Narration Withdrawal Deposit Balance")),
        F.when(first & (F.col("doc_id") % 3 == 0), F.lit("Opening Balance 5,000,000.00")).when(first & (F.col("doc_id") % 3 == 1), F.lit("Balance as on 01-02-1990 77.00")),
        F.concat_ws("  ", shown, "narration", money("debit_c"), money("credit_c"), F.format_number((F.col("balance_c") + 500_000_000) / 100.0, 2)), F.when(k % 7 == 0, F.concat(F.lit("   wrapped under "), k)),
        F.when(k % 11 == 0, F.concat(F.lit("UPI/CR/"), F.lpad(k.cast("string"), 9, "0"), F.lit("/HDFC rent 12.34 99.99"))), F.when(k % 13 == 0, F.lit("*** End of statement ***")),
        F.when(k % 19 == 0, F.lit("Grand Total 1,234.00")), F.when(k % 19 == 0, F.lit("stray text")),
    )
    printed = F.col("debit_c").isNotNull() | F.col("credit_c").isNotNull() | F.col("balance_c").isNotNull()
    lines = [line if i < 3 else F.when(printed, line) for i, line in enumerate(lines)]
    each = txns.select("doc_id", "row_idx", F.posexplode(F.array(*lines)).alias("at", "text")).where("text is not null")
    return each.select("doc_id", (F.col("row_idx") * 10 + F.col("at")).alias("line_no"), "text")


def column_tokens(txns: DataFrame) -> DataFrame:
    """(doc_id, page, tok_idx, text, x0, x1, y0, y1): pages with columns, balances 5,000,000.00 higher. Some balances are split in two
    tokens or end with CR, some rows go on below, some have a label of totals, some pages begin with their balance."""
    k, y = F.col("k"), 28 * (F.col("row_idx") % PAGE_ROWS + 1)
    money = lambda c: F.format_number(c / 100.0, 2)
    balance = money(F.col("balance_c") + 500_000_000)
    cell = lambda text, x, dy=0: F.struct(text.alias("text"), F.lit(x).alias("x0"), (y + dy).alias("y0"))
    head = [F.struct(F.lit(w).alias("text"), F.lit(x).alias("x0"), F.lit(0).alias("y0")) for w, x in (("DATE", 20), ("NARRATION", 100), ("DEBIT", 300), ("CREDIT", 400), ("BALANCE", 500))]
    on_top = F.col("row_idx") % PAGE_ROWS == 0
    opening = on_top & (F.col("page") == 1) & (F.col("doc_id") % 3 == 0)
    cells = [F.when(on_top, c) for c in head]
    cells += [F.when(opening, F.struct(F.lit(w).alias("text"), F.lit(x).alias("x0"), F.lit(14).alias("y0"))) for w, x in (("Opening", 100), ("Balance", 150), ("5,000,000.00", 500))]
    cells += [cell(F.date_format(F.to_date("date"), "dd/MM/yyyy"), 20), cell(F.when(k % 23 == 0, "closing").otherwise("UPI"), 100), cell(F.concat(F.lit("ref"), k), 140)]
    cells += [F.when(F.col("debit_c").isNotNull(), cell(money(F.col("debit_c")), 300)), F.when(F.col("credit_c").isNotNull(), cell(money(F.col("credit_c")), 400))]
    cells += [F.when(F.col("balance_c").isNotNull(), cell(F.when(k % 7 == 0, F.expr("left(format_number((balance_c + 500000000) / 100.0, 2), 3)")).when(k % 9 == 0, F.concat(balance, F.lit("CR"))).otherwise(balance), 500))]
    cells += [F.when(F.col("balance_c").isNotNull() & (k % 7 == 0), cell(F.expr("substring(format_number((balance_c + 500000000) / 100.0, 2), 4)"), 540)), F.when(k % 5 == 0, cell(F.lit("more"), 100, 14)), F.when(k % 5 == 0, cell(F.lit("Branch"), 140, 14))]
    each = txns.select("doc_id", "page", "row_idx", F.posexplode(F.array(*cells)).alias("at", "c")).where("c is not null")
    return each.select("doc_id", "page", (F.col("row_idx") * 100 + F.col("at")).cast("int").alias("tok_idx"), "c.text", "c.x0", (F.col("c.x0") + 6 * F.length("c.text")).alias("x1"), F.col("c.y0").cast("int").alias("y0"), (F.col("c.y0") + 8).cast("int").alias("y1"))
