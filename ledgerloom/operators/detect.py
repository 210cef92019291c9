"""Identity of a statement, canonical columns, card summaries and seeds: ordered lookups and first matches.

Lookup tables carry an explicit order; the first entry that matches wins, as with any ordered list of rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Header words and the fields that they name, in order of precedence.
CANONICAL = (
    ("date", "DATE"), ("txn date", "DATE"), ("transaction date", "DATE"), ("value date", "VALUE_DATE"), ("val date", "VALUE_DATE"), ("narration", "NARRATION"), ("description", "NARRATION"), ("particulars", "NARRATION"), ("details", "NARRATION"),
    ("cheque", "CHEQUE"), ("chq", "CHEQUE"), ("ref", "REFERENCE"), ("withdrawal", "DEBIT"), ("debit", "DEBIT"), ("dr", "DEBIT"), ("deposit", "CREDIT"), ("credit", "CREDIT"), ("cr", "CREDIT"), ("balance", "BALANCE"), ("bal", "BALANCE"),
)
# Phrases of card statements.
CARD_PHRASES = ("TOTAL AMOUNT DUE", "MINIMUM AMOUNT DUE", "AVAILABLE CREDIT LIMIT", "PAYMENT DUE DATE", "CARD STATEMENT", "LEGEND CREDIT CARD", "PLATINUM CREDIT CARD", "CASH LIMIT")
# Labels of card summary amounts, in order of precedence.
CARD_AMOUNTS = {
    "statement_due_amount": ("TOTAL AMOUNT DUE", "TOTAL DUE", "NEW BALANCE", "STATEMENT DUE", "AMOUNT DUE"),
    "minimum_amount_due": ("MINIMUM AMOUNT DUE", "MINIMUM DUE", "MINIMUM PAYMENT DUE", "MIN AMT DUE"),
    "previous_balance": ("PREVIOUS BALANCE", "OPENING BALANCE", "LAST STATEMENT BALANCE"),
    "total_purchases": ("TOTAL PURCHASES", r"PURCHASES\s*(?:AND|&)?\s*OTHER CHARGES", "PURCHASES", "DEBITS"),
    "total_payments": (r"PAYMENTS\s*(?:AND|&)?\s*CREDITS", "TOTAL PAYMENTS", "PAYMENTS RECEIVED", "PAYMENTS", "CREDITS"),
    "total_fees": ("FINANCE CHARGES", "TOTAL FEES", r"FEES\s*(?:AND|&)?\s*TAXES"),
}


def canonical_field(header: Column) -> Column:
    """The field of a header word: an exact entry, else the first entry that it contains."""
    text = F.lower(F.trim(header))
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in CANONICAL for x in kv]), text)
    inside = F.coalesce(*[F.when(F.contains(text, F.lit(k)), v) for k, v in CANONICAL])
    return F.when(text != "", F.coalesce(exact, inside))


def document_family(text: Column) -> Column:
    """CREDIT_CARD from a score of 5: three for each card phrase, five for CREDIT CARD in the first 15 % of the text."""
    upper = F.upper(text)
    head = F.substring(upper, F.lit(1), F.greatest(F.lit(1), F.floor(F.length(upper) * 0.15).cast("int")))
    score = reduce(add, [F.when(F.contains(upper, F.lit(p)), 3).otherwise(0) for p in CARD_PHRASES]) + F.when(F.contains(head, F.lit("CREDIT CARD")), 5).otherwise(0)
    return F.when(score >= 5, "CREDIT_CARD").otherwise("BANK_STATEMENT")


def card_summary(text: Column) -> Column:
    """Struct of six summary amounts; for each the first label with an amount after it."""
    flat = F.regexp_replace(text, r"[ \n]+", " ")

    def amount(label: str) -> Column:
        found = F.regexp_extract(flat, rf"(?i){label}\s*[:=\-]?\s*(?:Rs\.?|INR|₹)?\s*([\d,]+\.\d{{2}})", 1)
        return F.replace(F.when(found != "", found), F.lit(","), F.lit("")).try_cast("double")

    return F.struct(*[F.coalesce(*map(amount, labels)).alias(name) for name, labels in CARD_AMOUNTS.items()])


def identify(texts: DataFrame, names: Sequence[tuple[str, str]], codes: DataFrame) -> DataFrame:
    """texts(doc_id, text), names (pattern, bank) in order of precedence, codes(prefix, bank) -> (doc_id, bank, layer).

    Names are looked for in the top fifth of the lines first, then in the whole text, both as printed and without blanks; then the
    first branch code with a known prefix. Names are a short list and become one expression, so no text is joined with
    them; each layer sees only what the layer before left.
    """
    lines = F.split(F.upper("text"), "\n")
    top = F.array_join(F.slice(lines, 1, F.greatest(F.lit(1), F.floor(F.size(lines) / 5).cast("int"))), "\n")
    docs = texts.select("doc_id", F.upper("text").alias("whole"), top.alias("top"))

    def by_name(docs: DataFrame, column: str, layer: str) -> DataFrame:
        text, tight = F.col(column), F.replace(F.col(column), F.lit(" "), F.lit(""))
        held = [F.contains(text, F.lit(p.upper())) | F.contains(tight, F.lit(p.upper().replace(" ", ""))) for p, _ in names]
        bank = F.coalesce(*[F.when(h, F.lit(b)) for h, (_, b) in zip(held, names)], F.lit(None))
        return docs.select("doc_id", bank.alias("bank")).where("bank is not null").withColumn("layer", F.lit(layer))

    header = by_name(docs, "top", "header")
    rest = docs.join(header, "doc_id", "left_anti")
    keyword = by_name(rest, "whole", "keyword")
    rest = rest.join(keyword, "doc_id", "left_anti")
    found = rest.select("doc_id", F.posexplode(F.regexp_extract_all("whole", F.lit(r"\b([A-Z]{4})0[A-Z0-9]{6}\b"), 1)).alias("at", "prefix"))
    code = found.join(codes, "prefix").groupBy("doc_id").agg(F.min_by("bank", "at").alias("bank")).withColumn("layer", F.lit("code"))
    known = header.unionByName(keyword).unionByName(code)
    return texts.select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("bank", F.lit("UNKNOWN")).alias("bank"), F.coalesce("layer", F.lit("none")).alias("layer"))


def best_seed(candidates: DataFrame) -> DataFrame:
    """candidates(doc_id, ord, source, score, value_c, day, start, end) -> (doc_id, value_c, source, score): a dated balance counts
    80 inside the statement period, 0 outside and 50 without one; the first best wins, none at 0."""
    dated = (F.col("source") == "balance_as_on") & F.col("day").isNotNull()
    period = F.col("start").isNotNull() & F.col("end").isNotNull()
    score = F.when(dated & period, F.when(F.col("day").between(F.col("start"), F.col("end")), 80).otherwise(0)).when(dated, 50).otherwise(F.col("score"))
    best = candidates.withColumn("final", score).groupBy("doc_id").agg(F.max_by(F.struct("value_c", "source", F.col("final").alias("score")), F.struct("final", -F.col("ord"))).alias("b"))
    return best.where("b.score > 0").select("doc_id", "b.*")


def zone_candidates(cells: DataFrame) -> DataFrame:
    """cells(doc_id, row_no, texts array<string>), tokens of a zone from left to right -> (doc_id, row_no, text, value, score, first, last): the
    best reading among all runs of neighbouring tokens joined together.

    Points: 5 for reaching the zone's end (or the end but for CR/DR), 5 for decimals, 4 for CR/DR, 4 for joining, 3 for confidence,
    2 for grouping commas, -6 for several dots, -5 for a lone token among several without CR/DR. Ties go to the first run.
    """
    from ledgerloom.functions.money import parse_amount

    n = F.size("texts")
    starts = F.sequence(F.lit(0), n - 1)
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.struct(i.alias("i"), j.alias("j"), F.array_join(F.slice(F.col("texts"), i + 1, j - i), "").alias("text")))))
    each = cells.where(n > 0).select("doc_id", "row_no", n.alias("n"), F.upper(F.element_at("texts", -1)).isin("CR", "DR").alias("sided"), F.explode(runs).alias("r"))
    text = F.col("r.text")
    value, side = parse_amount(text), F.upper(text).rlike("CR|DR")
    width = F.col("r.j") - F.col("r.i")
    points = (
        ((F.col("r.j") == F.col("n")) | ((F.col("r.j") == F.col("n") - 1) & F.col("sided")), 5), (text.rlike(r"\.\d+$"), 5), (side, 4), (width > 1, 4), (text.rlike(r",\d{3}(\.|$)"), 2),
        (F.length(text) - F.length(F.replace(text, F.lit("."), F.lit(""))) > 1, -6), ((width == 1) & (F.col("n") > 1) & ~side, -5),
    )
    score = reduce(add, [F.when(c, v).otherwise(0) for c, v in points], F.lit(3))
    scored = each.select("doc_id", "row_no", "r.i", "r.j", text.alias("text"), value.alias("value"), score.alias("score")).where("value > 0")
    best = scored.groupBy("doc_id", "row_no").agg(F.max_by(F.struct("text", "value", "score", F.col("i").alias("first"), F.col("j").alias("last")), F.struct("score", -F.col("i"), -F.col("j"))).alias("b"))
    return best.select("doc_id", "row_no", "b.*")


def balance_candidates(tokens: DataFrame) -> DataFrame:
    """tokens(doc_id, row_idx, pos, text) of the balance zone -> readings with evidence: value, decimal_present, watermark, shifted.
    A long run of bare digits also gives its hundredth, in case the point was lost. A text is parsed once: no condition on a
    value is pushed below the generator that it comes out of."""
    from ledgerloom.functions.money import parse_amount

    bare = ~F.contains("text", F.lit("."))
    rows = tokens.select("doc_id", "row_idx", "pos", "text", F.explode(F.array(parse_amount(F.col("text")))).alias("value")).where("value > 0")
    rows = rows.withColumns({"decimal_present": ~bare, "watermark": bare & F.col("text").rlike(r"^\d{4,}$"), "shifted": F.explode(F.when(bare & (F.length("text") >= 6), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))})
    return rows.select("doc_id", "row_idx", (F.col("pos") * 2 + F.col("shifted").cast("int")).alias("pos"), F.when(F.col("shifted"), F.col("value") / 100).otherwise(F.col("value")).alias("value"), "decimal_present", "watermark", "shifted")


def classify_rejection(text: Column, rows: Column, balances: Column, reason: Column, has_date: Column, has_amount: Column) -> Column:
    """Why a block was lost, first rule that holds."""
    edge = F.lower(text).rlike(r"\b(brought forward|carried forward|opening balance|closing balance|statement summary|total)\b")
    sides = reason.isin("both_debit_and_credit", "no_debit_or_credit")
    return (
        F.when(balances > 1, "ROW_MERGE_COLLAPSE").when(edge, "PAGE_BOUNDARY_COLLAPSE").when((rows >= 3) & sides, "MULTILINE_NARRATION_COLLAPSE")
        .when(~has_date | ~has_amount, "TRUE_OCR_FAILURE").otherwise("POLICY_REJECT")
    )
