"""Line, token and cell classes from their text."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of statement text.
FOOTER_WORDS = ("GRAND TOTAL", "TOTAL", "DISCLAIMER", "ABBREVIATIONS USED", "END OF STATEMENT", "COMPUTER GENERATED", "SYSTEM GENERATED", "PAGE ", "CLOSING BALANCE", "FOR ANY QUERIES", "GENERATED ON")
TERMINAL_WORDS = ("GRAND TOTAL", "END OF STATEMENT", "DISCLAIMER", "ABBREVIATIONS USED", "COMPUTER GENERATED STATEMENT", "END OF REPORT")
HEADER_CELLS = ("DATE", "NARRATION", "PARTICULARS", "CHQ NO", "DEBIT", "CREDIT", "BALANCE", "WITHDRAWAL", "DEPOSIT")
FOOTER_CELLS = ("PAGE", "GENERATED ON", "GRAND TOTAL", "IFSC", "MICR", "BRANCH")
DATE = r"\b(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}|\d{4}[/\-\.]\d{1,2}[/\-\.]\d{1,2}|\d{1,2}[\s\-\./][A-Za-z]{3,9}[\s\-\./]\d{2,4})\b"
DISCOVERY_DATE = r"\b(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}|\d{2,4}[/\-\.]\d{1,2}[/\-\.]\d{1,2}|\d{1,2}[\s\-/][A-Za-z]{3,9}(?:[\s\-/]\d{2,4})?)\b"
DECIMAL = r"[\d,]+\.\d{2}"
MONEY = r"\b\d{1,3}(?:[,]\d{2,3})*(?:\.\d{1,2})?\b"
NARRATION_WORD = r"(?i)\b(UPI|NEFT|IMPS|RTGS|ATM|ACH|NACH|ECS|CHEQUE|CHQ|DD|BY CLRG|TO CLRG|SALARY|EMI|LOAN|INTEREST|DIVIDEND|REFUND|CASHBACK|CREDIT|DEBIT|TRANSFER|TRF|IFT|MANDATE|AUTO)\b"
HEADER_WORD = r"(?i)\b(DATE|NARRATION|PARTICULARS|DESCRIPTION|DEBIT|CREDIT|BALANCE|WITHDRAWAL|DEPOSIT|AMOUNT)\b"
ACCOUNT_WORD = r"(?i)\b(ACCOUNT|A/C|BRANCH|IFSC|MICR|CUSTOMER|CUST ID|STATEMENT|GENERATED|PAGE|OPENING|CLOSING|NAME|ADDRESS)\b"
PERIOD = r"(?i)(FROM\s+\d{1,2}.*?TO\s+\d{1,2}|\b\d{1,2}[\s\-/][A-Za-z]{3,9}[\s\-/]\d{2,4}\s*-\s*\d{1,2}[\s\-/][A-Za-z]{3,9}[\s\-/]\d{2,4}\b)"
ROW_CHANNEL = r"\b(upi|neft|imps|rtgs)\b"
ROW_SUMMARY = r"\b(statement|summary|closing|opening|brought forward|carried forward|total|page)\b"
ROW_ACCOUNT = r"\b(branch|ifsc|micr|open date|account no|customer id|address|email)\b"
DATE_AT_START = r"^\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}"
AMOUNT = r"\b\d{1,3}(?:,\d{3})*\.\d{2}\b"

# Abbreviations of institutions, how grave a sign of misreading is, and how near a column's edge is doubtful.
ABBREVIATIONS = {"BOI": "BANK OF INDIA", "SBI": "STATE BANK OF INDIA", "HDFC": "HDFC BANK", "ICICI": "ICICI BANK", "AXIS": "AXIS BANK", "TJSB": "TJSB SAHAKARI BANK"}
SEVERITIES = {"MULTIPLE_DOTS": "HIGH", "PUNCTUATION_CORRUPTION": "MEDIUM", "NUMERIC_SHAPE_ANOMALY": "LOW", "COLUMN_BOUNDARY_SUSPECT": "LOW", "DATE_NARRATION_MERGE": "HIGH"}
BOUNDARY = 15.0


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def footer_decision(text: Column, position: Column, anchor: Column) -> Column:
    """struct(is_footer, confidence, action). Weights: no transaction structure .40, foot of the page .20, keyword .35;
    a footer from .70. A terminal keyword outside an anchor row ends the page; two amounts in a dated anchor row never do."""
    upper = F.upper(text)
    structure = F.when(anchor, 0.6).when(text.rlike(DATE_AT_START), 0.4).otherwise(0.0) + F.when(F.regexp_count(text, F.lit(AMOUNT)) >= 2, 0.4).otherwise(0.0)
    base = F.when(structure < 0.5, 40).otherwise(0) + F.when(position > 0.85, 20).otherwise(0) + F.when(any_word(upper, FOOTER_WORDS), 35).otherwise(0)
    terminal, solid = any_word(upper, TERMINAL_WORDS) & ~anchor, structure >= 0.8
    confidence = F.when(solid, 0).when(terminal, F.greatest(base, F.lit(95))).otherwise(base)
    footer = ~solid & (terminal | (base >= 70))
    action = F.when(~footer, "CONTINUE").when(terminal, "STOP_PAGE").otherwise("IGNORE_ROW")
    return F.struct(footer.alias("is_footer"), (confidence / 100).alias("confidence"), action.alias("action"))


def entity_class(c: Column) -> Column:
    """UNKNOWN, DATE, NUMERIC, FOOTER (short), HEADER or TEXT, tested in this order."""
    text = F.trim(c)
    upper = F.upper(text)
    return (
        F.when(text == "", "UNKNOWN").when(text.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$"), "DATE")
        .when(F.lower(text).rlike(r"^(₹?(rs\.?)?\s*)[0-9][0-9\s,.]*(\s*[a-z]{2})?$"), "NUMERIC")
        .when(any_word(upper, FOOTER_CELLS) & (F.length(text) < 30), "FOOTER").when(upper.isin(*HEADER_CELLS), "HEADER").otherwise("TEXT")
    )


def ocr_signature(c: Column) -> Column:
    """MULTIPLE_DOTS, then PUNCTUATION_CORRUPTION (3 or 5 decimals), then NUMERIC_SHAPE_ANOMALY (a letter like a digit next
    to a digit, in text that is half digits); null for clean text."""
    text = F.trim(c)
    plain = F.replace(text, F.lit(","), F.lit(""))
    digits = F.length(F.regexp_replace(text, r"[^0-9]", ""))
    shape = (F.length(text) >= 2) & (2 * digits >= F.length(text)) & text.rlike(r"[OoIlSsBbGg](?=\d)|(?<=\d)[OoIlSsBbGg]")
    return (
        F.when(text.rlike(r"^[\d.,]+$") & (F.regexp_count(text, F.lit(r"\.")) > 1), "MULTIPLE_DOTS")
        .when(plain.rlike(r"^\d+\.(\d{3}|\d{5})$"), "PUNCTUATION_CORRUPTION").when(shape, "NUMERIC_SHAPE_ANOMALY")
    )


def ledger_suspicion(diff_cents: Column) -> Column:
    """POWER_OF_TEN_DRIFT, then SMALL_DIGIT_SUBSTITUTION (whole 1 to 9), of the absolute difference; else null."""
    d = F.abs(diff_cents) / 100.0
    log = F.log10(F.when(d > 0.001, d))
    power = F.abs(log - F.round(log)) < 0.01
    small = (d > 0.5) & (d <= 9) & (F.abs(d - F.round(d)) < 0.01)
    return F.when(power, "POWER_OF_TEN_DRIFT").when(small, "SMALL_DIGIT_SUBSTITUTION")


def money_values(text: Column) -> Column:
    """Amounts in a text, left to right; bare years from 1990 to 2100 are none."""
    found = F.regexp_extract_all(text, F.lit(MONEY), 0)
    year = lambda m: m.rlike(r"^\d{4}$") & m.try_cast("int").between(1990, 2100)
    return F.transform(F.filter(found, lambda m: ~year(m)), lambda m: F.replace(m, F.lit(","), F.lit("")).try_cast("double"))


def row_score(text: Column, dated: Column) -> Column:
    """Likelihood that a printed row is a transaction: date 5, one amount 4, a second 4, channel 3, long reference 2, words of
    summaries -10, words of the account -10."""
    low = F.lower(text)
    amounts = F.regexp_count(text, F.lit(r"\b\d{1,3}(?:,\d{2,3})*\.\d{2}\b"))
    points = ((dated, 5), (amounts >= 1, 4), (amounts >= 2, 4), (low.rlike(ROW_CHANNEL), 3), (text.rlike(r"\b\d{10,20}\b") | text.rlike(r"\b[A-Z0-9]{10,15}\b"), 2), (low.rlike(ROW_SUMMARY), -10), (low.rlike(ROW_ACCOUNT), -10))
    return reduce(add, [F.when(c, n).otherwise(0) for c, n in points])


def hypothesis_scores(text: Column) -> Column:
    """struct(transaction, header, account): three readings of a block of text. Words of headers and of the account, and a
    statement period, speak against a transaction and for the others. Each sign is looked for once: the readings are functions of a struct of them."""
    when = lambda c, n: F.when(c, n).otherwise(0)
    signs = F.struct(F.size(money_values(text)).alias("amounts"), text.rlike(HEADER_WORD).alias("header"), text.rlike(ACCOUNT_WORD).alias("account"), text.rlike(PERIOD).alias("period"))

    def readings(s: Column) -> Column:
        for_row = when(text.rlike(DISCOVERY_DATE), 5) + when(s["amounts"] >= 1, 4) + when(s["amounts"] >= 2, 4) + when(text.rlike(NARRATION_WORD), 3) + when(text.rlike(r"\b\d{10,}\b"), 2)
        return F.struct((for_row - when(s["header"], 10) - when(s["account"], 10) - when(s["period"], 15)).alias("transaction"), when(s["header"], 10).alias("header"), (when(s["account"], 10) + when(s["period"], 10)).alias("account"))

    return F.get(F.transform(F.array(signs), readings), F.lit(0))


def text_score(text: Column) -> Column:
    """Quality of a page's text: 10 a date, 5 an amount, 2 a line of three words, 0.5 a line; -1000 for one line of over 200
    characters, -500 for lines of over 300 on average, as text that lost its line ends; 0 without text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))
    n = F.size(lines)
    total = lambda f: F.aggregate(F.transform(lines, f), F.lit(0), lambda a, x: a + x)
    mean = total(lambda x: F.length(x)) / n
    words = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    points = 10.0 * total(lambda x: F.regexp_count(x, F.lit(DATE))) + 5.0 * total(lambda x: F.regexp_count(x, F.lit(DECIMAL))) + 2.0 * F.size(F.filter(lines, lambda x: words(x) >= 3)) + 0.5 * n
    return F.when(n <= 0, 0.0).when((n == 1) & (mean > 200), -1000.0).when(mean > 300, -500.0).when(text.isNotNull(), points)


def institution_name(c: Column) -> Column:
    """Upper case; of a name with brackets the part before them (TJSB wherever it stands); abbreviations are written out; THE and legal
    suffixes go, also repeated ones. UNKNOWN for a blank name."""
    name = F.upper(F.trim(c))
    parts = F.filter(F.transform(F.split(name, r"[()]"), F.trim), lambda p: p != "")
    inside = F.contains(name, F.lit("(")) & F.contains(name, F.lit(")")) & (F.size(parts) > 0)
    name = F.when(inside, F.when(F.exists(parts, lambda p: F.contains(p, F.lit("TJSB"))), "TJSB").otherwise(F.get(parts, F.lit(0)))).otherwise(name)
    full = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    bare = F.trim(F.regexp_replace(name, r"^THE ", ""))
    bare = F.regexp_replace(bare, r"(?:[\s,]*\b(?:LIMITED|LTD\.?|PVT\.?|PRIVATE))*[\s,]*$", "")
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "UNKNOWN").otherwise(F.coalesce(F.try_element_at(full, name), F.try_element_at(full, bare), bare))


def date_merge(c: Column) -> Column:
    """Whether a token of the date zone is a date that runs on by more than three characters."""
    text = F.trim(c)
    return F.coalesce(F.length(text) > F.length(F.regexp_extract(text, r"^(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}\D)", 1)) + 3, F.lit(False)) & text.rlike(r"^\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}\D")


def ocr_signatures(debit: Column, credit: Column, balance: Column, date: Column, debit_x: Column, credit_x: Column, boundary: Column) -> Column:
    """array<struct(field, reason, severity)> of a row: signs of misreading in its amounts, sides within BOUNDARY of where debit and credit meet, and a
    date that runs on. Empty for a clean row."""
    severity = F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])
    found = lambda field, reason: F.when(reason.isNotNull(), F.struct(F.lit(field).alias("field"), reason.alias("reason"), severity[reason].alias("severity")))
    near = lambda x: F.when(F.abs(x - boundary) <= BOUNDARY, "COLUMN_BOUNDARY_SUSPECT")
    cells = [found(f, F.when(c != "", ocr_signature(c))) for f, c in (("balance", balance), ("debit", debit), ("credit", credit))]
    return F.array_compact(F.array(*cells, found("debit", near(debit_x)), found("credit", near(credit_x)), found("date", F.when(date_merge(date), "DATE_NARRATION_MERGE"))))
