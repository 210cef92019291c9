"""Statements as text lines: rows of a line state machine, and the balance solver that gives their amounts a direction.

The state machine is a running one over the lines of a statement: a block opens at a line with a date and an amount, and
at a payment line without a date while a block is open; other lines continue an open block, and footers, page marks,
seeds and totals close it. Whether a block is open is the last opening or closing before a line, so windows over a
statement's lines give all of it; no line is folded in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import SEED_DATE, parse_seed_date, statement_period
from ledgerloom.functions.signals import DATE, DECIMAL

# Patterns of lines that close a block, of balances to start from, and of payment lines.
FOOTER_LINE = r"computer generated statement|does not require a signature|end of statement|^\*{3,}|^=+$"
PAGE_LINE = r"^PAGE\s+(\d+)$"
SEED_LINE = r"(?i)\b(opening|prev(ious)?|brought.?forward|b/?f|balance as on)\b"
SKIP_LINE = r"(?i)(grand.?total|opening.?balance|closing.?balance|total.?debit|total.?credit|registered.?office|statement.?period|account.?no|customer\.?\s*$|page\s+\d+\s+of\s+\d+)"
PAYMENT_LINE = r"(?i)^(UPI/CR/|UPI/DR/|IMPS/|NEFT/|RTGS/|AEPS/|ATM/|POS/|WDL\s+TFR\s+UP/DR/)"
PAYMENT_WORD = r"(?i)\b(UPI|SBIN|YESB|HDFC|UTIB|BKID|MAHB|FDRL|paytm|okaxis|ybl|apl)\b"
HEADER_WORD = r"(?i)\b(debit|credit|balance|withdrawal|deposit|particulars|narration|description|transaction|cheque|reference|amount)\b"
MANGLED = r"(?<=\b\d{1,3})\.(?=\d{3}(?:\.\d{3})*\.\d{2}\b)"
DEBIT_WORD, CREDIT_WORD = r"\b(dr|debit|ach/dr|upi/dr|sent|paid)\b", r"\b(cr|credit|ach/cr|upi/cr|received|refund|reversal)\b"
SEED_SCORES = {"opening": 100, "brought_forward": 95, "balance_as_on": 0}
#: Cents: the largest amount; how far an amount may be from a move of the balance; a move that is rounding.
LARGEST, NEAR, ROUNDING = 1_000_000_000, 200, 5


def cents(c: Column) -> Column:
    return F.round(F.replace(c, F.lit(","), F.lit("")).try_cast("double") * 100).cast("long")


def preprocess(lines: DataFrame) -> DataFrame:
    """lines(doc_id, line_no, text) -> (doc_id, line_no, part, text): dots that stand for grouping commas are commas, and a line
    of over 200 characters with two dates is cut before its dates, if that gives a dated part with an amount."""
    text = F.regexp_replace("text", MANGLED, ",")
    rows = lines.select("doc_id", "line_no", text.alias("text"))
    parts = F.filter(F.split("text", rf"(?={DATE})"), lambda p: F.trim(p) != "")
    row_like = F.exists(parts, lambda p: p.rlike(rf"^{DATE}") & p.rlike(DECIMAL))
    cut = (F.length("text") > 200) & (F.regexp_count("text", F.lit(DATE)) >= 2) & row_like
    return rows.select("doc_id", "line_no", F.posexplode(F.when(cut, F.transform(parts, lambda p: F.trim(p))).otherwise(F.array("text"))).alias("part", "text"))


def classified(lines: DataFrame) -> DataFrame:
    """Adds `kind` to non-empty lines: footer, page, seed or skip; null for the others."""
    text = F.trim("text")
    kind = F.when(F.lower(text).rlike(FOOTER_LINE), "footer").when(text.rlike(PAGE_LINE), "page").when(text.rlike(SEED_LINE), "seed").when(text.rlike(SKIP_LINE), "skip")
    return lines.withColumn("text", text).where("text <> ''").withColumn("kind", kind)


def seed_candidates(lines: DataFrame) -> DataFrame:
    """(doc_id, ord, source, score, value_c, day): balances that lines state before or beside the rows, for detect.best_seed."""
    found = classified(lines).where("kind = 'seed'").withColumn("amounts", F.filter(F.transform(F.regexp_extract_all("text", F.lit(DECIMAL), 0), cents), lambda v: v <= LARGEST)).where(F.size("amounts") > 0)
    source = F.when(F.col("text").rlike(r"(?i)\bopening\b"), "opening").when(F.col("text").rlike(r"(?i)\b(prev(ious)?|brought.?forward|b/?f)\b"), "brought_forward").otherwise("balance_as_on")
    day = parse_seed_date(F.regexp_extract("text", SEED_DATE, 1))
    score = F.create_map(*[F.lit(x) for kv in SEED_SCORES.items() for x in kv])[source]
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "part"))
    return found.select("doc_id", place.alias("ord"), source.alias("source"), score.alias("score"), F.element_at("amounts", -1).alias("value_c"), F.date_format(day, "yyyy-MM-dd").alias("day"))


def raw_rows(lines: DataFrame) -> DataFrame:
    """lines(doc_id, line_no, part, text) -> (doc_id, row_no, page, date, narration, numbers, lines, payment): candidate rows.
    numbers holds (cents, x) with x the amount's place in the joined text."""
    by = Window.partitionBy("doc_id").orderBy("line_no", "part")
    before, upto = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text, free = F.col("text"), F.col("kind").isNull()
    dated = free & text.rlike(DATE)
    opens = dated & text.rlike(DECIMAL)
    wordy = F.length(F.regexp_replace("text", r"[\d,\.\-\s/]", "")) > 3
    payment = free & ~dated & text.rlike(PAYMENT_LINE) & wordy & text.rlike(r"\d{6,}") & text.rlike(PAYMENT_WORD)
    rows = classified(lines).withColumns({"opens": opens, "dated": dated, "payment": payment})
    rows = rows.withColumn("open", F.coalesce(F.last(F.when(~free, F.lit(False)).when(F.col("opens"), F.lit(True)), ignorenulls=True).over(before), F.lit(False)))
    rows = rows.withColumn("begins", F.col("opens") | (F.col("payment") & F.col("open")))
    date_of = F.last(F.when(F.col("dated"), F.regexp_extract("text", DATE, 1)), ignorenulls=True).over(upto)
    page = F.coalesce(F.last(F.when(F.col("kind") == "page", F.regexp_extract("text", PAGE_LINE, 1).cast("int")), ignorenulls=True).over(upto), F.lit(1))
    rows = rows.withColumns({"block": F.sum(F.col("begins").cast("int")).over(upto), "page": page, "last_date": date_of}).where(free & (F.col("begins") | F.col("open")))
    given = F.when(F.col("begins") & F.col("payment"), F.concat_ws(" ", "last_date", "text")).otherwise(text)
    joined = rows.groupBy("doc_id", "block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("line_no", "part", given.alias("text")))), lambda x: x["text"]).alias("lines"), F.min("page").alias("page"), F.max(F.col("begins") & F.col("payment")).alias("payment")
    )
    joined = joined.withColumn("raw", F.array_join("lines", " ")).withColumn("date", F.regexp_extract("raw", DATE, 1)).where("date <> ''")
    blank = F.aggregate(F.regexp_extract_all("raw", F.lit(DATE), 1), F.col("raw"), lambda acc, d: F.replace(acc, d, F.repeat(F.lit(" "), F.length(d))))
    joined = joined.withColumn("blank", blank).withColumns({"found": F.regexp_extract_all("blank", F.lit(DECIMAL), 0), "between": F.split("blank", DECIMAL)})
    place = lambda i: F.length(F.array_join(F.slice("between", F.lit(1), i + 1), "")) + F.length(F.array_join(F.slice("found", F.lit(1), i), ""))
    numbers = F.filter(F.transform("found", lambda x, i: F.struct(cents(x).alias("cents"), place(i).alias("x"))), lambda n: n["cents"] <= LARGEST)
    at = F.instr("raw", F.col("date"))
    rest = F.concat(F.substring(F.col("raw"), F.lit(1), at - 1), F.substring(F.col("raw"), at + F.length("date"), F.length("raw")))
    narration = F.trim(F.regexp_replace(F.regexp_replace(rest, DECIMAL, ""), r"\s+", " "))
    out = joined.select("doc_id", "block", "page", "date", narration.alias("narration"), numbers.alias("numbers"), "lines", "payment")
    out = out.where((F.size("numbers") > 0) & ~((F.col("narration") == "") & F.col("payment")))
    out = out.where((F.size("numbers") <= 8) & (F.regexp_count("narration", F.lit(HEADER_WORD)) < 3))
    return out.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("block")) - 1).alias("row_no"), "page", "date", "narration", "numbers", "lines", "payment")


def solved(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """raw_rows and seeds(doc_id, value_c) -> transactions by the column of numbers that behaves like a running balance:
    (doc_id, row_no, page, date, narration, debit_c, credit_c, balance_c, seen_c, conflict, balance_column, completeness).

    Each column is tried: a move of the balance that another number of the row matches within 2.00, or of 0.05 at most, is a
    hit. The chosen column has the most hits a move (a hint for the last column, ties to the first). A number that doesn't match the move stays, with
    the move's direction, as a conflict. Rows without a direction take that of the column of text where their amount
    stands (within 15 characters of the mean place of debits or credits), else that of a word.
    """
    cells = rows.join(seeds.select("doc_id", F.col("value_c").alias("seed_c")), "doc_id", "left").select("*", F.posexplode("numbers").alias("b", "cell"))
    by = Window.partitionBy("doc_id", "b").orderBy("row_no")
    cells = cells.withColumn("balance_c", F.col("cell.cents")).withColumn("move", F.col("balance_c") - F.coalesce(F.lag("cell.cents").over(by), "seed_c"))
    others = F.filter("numbers", lambda n, i: i != F.col("b"))
    cells = cells.withColumn("others", others)
    nearest = F.element_at(F.array_sort(F.transform("others", lambda n, i: F.struct(F.abs(n["cents"] - F.abs("move")).alias("away"), i.alias("i"), n["cents"].alias("cents"), n["x"].alias("x")))), 1)
    single = F.when(F.size("others") == 1, F.struct(F.lit(None).cast("long").alias("away"), F.lit(0).alias("i"), F.get("others", F.lit(0))["cents"].alias("cents"), F.get("others", F.lit(0))["x"].alias("x")))
    cells = cells.withColumn("best", F.when(F.col("move").isNotNull(), F.when(F.size("others") > 0, nearest)).otherwise(single))
    matched = F.coalesce((F.col("move").isNotNull()) & (F.col("best.away") <= NEAR), F.lit(False))
    tiny = F.coalesce(F.abs("move") <= ROUNDING, F.lit(False))
    cells = cells.withColumns({"matched": matched, "hit": matched | tiny, "conflict": F.col("move").isNotNull() & ~matched & ~tiny})

    width = rows.groupBy("doc_id").agg(F.max(F.size("numbers")).alias("width"))
    scores = cells.groupBy("doc_id", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits")).join(width, "doc_id")
    total = F.col("hits") / F.greatest(F.lit(1), F.col("n") - 1) * 0.97 + F.when(F.col("b") == F.col("width") - 1, 0.0009).otherwise(0.0)
    chosen = scores.groupBy("doc_id").agg(F.max_by("b", F.struct(total.alias("total"), (-F.col("b")).alias("first"))).alias("chosen"))

    took = F.col("matched") | F.col("conflict")
    txns = cells.join(chosen, "doc_id").where("b = chosen")
    txns = txns.withColumns({"credit_c": F.when(took & (F.col("move") > 0), F.col("best.cents")), "debit_c": F.when(took & (F.col("move") <= 0), F.col("best.cents"))})
    # Equal numbers of a row stand for each other: the first place counts.
    place = F.array_min(F.transform(F.filter("others", lambda n: n["cents"] == F.col("best.cents")), lambda n: n["x"]))
    txns = txns.withColumn("x", place)
    doc = Window.partitionBy("doc_id")
    sure = ~F.col("conflict")
    mean = {c: F.avg(F.when(sure & F.col(f"{c}_c").isNotNull(), F.col("x"))).over(doc) for c in ("debit", "credit")}
    txns = txns.withColumns({f"{c}_x": m for c, m in mean.items()})
    open_row = F.col("debit_c").isNull() & F.col("credit_c").isNull() & F.col("best.cents").isNotNull()
    near = {c: F.coalesce(F.abs(F.col("x") - F.col(f"{c}_x")) <= 15, F.lit(False)) for c in ("debit", "credit")}
    low = F.lower("narration")
    side = F.when(near["debit"] & ~near["credit"], "debit").when(near["credit"] & ~near["debit"], "credit").when(low.rlike(DEBIT_WORD), "debit").when(low.rlike(CREDIT_WORD), "credit")
    txns = txns.withColumn("side", F.when(open_row, side))
    debit, credit = (F.when(F.col("side") == c, F.col("best.cents")).otherwise(F.col(f"{c}_c")) for c in ("debit", "credit"))
    texts = F.exists("lines", lambda x: F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, DATE, ""), DECIMAL, ""), r"\s+", "")) > 2)
    short = (F.length("narration") < 15) | (F.col("narration") == F.col("date"))
    blank_source = ~texts & (debit.isNotNull() | credit.isNotNull())
    lost = F.when(short & ~blank_source, 40).otherwise(0) + F.when(F.col("best.cents").isNull() & (debit.isNotNull() | credit.isNotNull()), 20).otherwise(0)
    return txns.select("doc_id", "row_no", "page", "date", "narration", debit.alias("debit_c"), credit.alias("credit_c"), "balance_c", F.col("best.cents").alias("seen_c"), "conflict", F.col("chosen").alias("balance_column"), (100 - lost).alias("completeness"))


def whole_texts(lines: DataFrame) -> DataFrame:
    """(doc_id, text): the lines of each statement in order."""
    each = F.sort_array(F.collect_list(F.struct("line_no", "part", "text")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(each, lambda x: x["text"]), "\n").alias("text"))


def periods(texts: DataFrame) -> DataFrame:
    """(doc_id, start, end): the period that a statement states, as ISO dates."""
    found = texts.select("doc_id", statement_period(F.col("text")).alias("p")).where("p is not null")
    return found.select("doc_id", *[F.date_format(f"p.{c}", "yyyy-MM-dd").alias(c) for c in ("start", "end")])


def statement_seeds(clean: DataFrame) -> DataFrame:
    """Preprocessed lines -> the best balance to start from, dated ones checked against the stated period."""
    from ledgerloom.operators.detect import best_seed

    return best_seed(seed_candidates(clean).join(periods(whole_texts(clean)), "doc_id", "left"))


def text_transactions(lines: DataFrame) -> DataFrame:
    """lines(doc_id, line_no, text) -> transactions, through preprocess, raw_rows, the best seed and the solver."""
    clean = preprocess(lines)
    return solved(raw_rows(clean), statement_seeds(clean))


def statement_summary(text: Column) -> Column:
    """Struct of the counts and totals that a statement prints of itself."""
    count = lambda words: F.regexp_extract(text, rf"(?is)(?:{words})[^\d]*(\d+)", 1).try_cast("int")
    total = lambda side: cents(F.regexp_extract(text, rf"(?is)total\s+{side}[^\d]*([\d,]+\.\d{{2}})", 1))
    return F.struct(
        count(r"dr\s*count|debit\s*count|no\.?\s*of\s*debits").alias("dr_count"), count(r"cr\s*count|credit\s*count|no\.?\s*of\s*credits").alias("cr_count"), total("debit").alias("total_debit_c"), total("credit").alias("total_credit_c")
    )
