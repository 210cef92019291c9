"""Amounts in text: Column -> Column, built-in expressions only, safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def _number_run(c: Column) -> Column:
    """First run of digits, dots, commas and blanks with its sign, without blanks and without dots or commas at its end."""
    run = F.regexp_extract(F.trim(c), r"-?[\d][\d,\.\s]*", 0)
    return F.regexp_replace(F.regexp_replace(run, r"[ .,]+$", ""), r"\s", "")


def sanitize_balance_text(c: Column) -> Column:
    """The number run; a trailing CR or DR is kept after one blank. Null without digits."""
    side = F.upper(F.regexp_extract(F.trim(c), r"(?i)(CR|DR)\.?$", 1))
    return nonempty(F.rtrim(F.concat_ws(" ", nonempty(_number_run(c)), F.when(_number_run(c) != "", side))))


def _repaired(digits: Column, few: str) -> Column:
    """Digits, dots and commas to a plain number, as one chain of replacements that mentions its input once:

    without a dot, a last comma before two digits is the decimal point; other commas go; of several dots the last one
    counts; three decimals were a group of thousands, five were a group and cents, if the whole part looks like `few`.
    """
    point = F.regexp_replace(digits, r"^([^.]*),(\d{2})$", "$1.$2")
    plain = F.regexp_replace(F.regexp_replace(point, ",", ""), r"\.(?=.*\.)", "")
    grouped = F.regexp_replace(plain, rf"^({few})\.(\d{{3}})$", "$1$2")
    eaten = F.regexp_replace(grouped, rf"^({few})\.(\d{{3}})(\d{{2}})$", "$1$2.$3")
    return F.regexp_extract(eaten, r"-?\d+(\.\d+)?", 0).try_cast("double")


def parse_amount(c: Column) -> Column:
    """The canonical reading of an amount; null if there is none. `2.000` is two thousand, `2.00000` two thousand with cents;
    whole parts of over three characters, sign included, are left alone."""
    repaired = _repaired(F.regexp_replace(_number_run(c), r"[^\d.,\-]", ""), r"(?=[^.]{0,3}\.)-?\d*")
    # Plain amounts need no repair, and texts without digits have none: most texts are one or the other, and one match is cheap.
    return F.when(c.rlike(r"\A-?\d[\d,]*\.\d{2}\z"), F.replace(c, F.lit(","), F.lit("")).try_cast("double")).when(c.rlike(r"\d"), repaired)


def normalize_amount_v2(c: Column) -> Column:
    """The reading for OCR text: letters that look like digits are digits, and repairs don't ask for a short whole part."""
    seen = F.translate(F.trim(c), "oOliI|", "001")
    return _repaired(F.regexp_replace(seen, r"[^\d.,\-]", ""), r"-?\d+")


def parse_float_safe(c: Column) -> Column:
    """The weak reading: commas and CR/DR go, the rest must be a number."""
    return F.trim(F.regexp_replace(c, r"(?i),|\s*(cr|dr)\.?\s*$", "")).try_cast("double")


def to_cents(c: Column) -> Column:
    return F.round(c * 100).cast("long")


def is_negative(c: Column) -> Column:
    return F.coalesce(parse_amount(c) < 0, F.lit(False))


def all_amounts(c: Column) -> Column:
    """Decimal amounts up to ten million, left to right."""
    found = F.regexp_extract_all(c, F.lit(r"(?<![\d.,])(\d{1,3}(?:,\d{2,3})+\.\d{2}|\d+\.\d{2})(?![\d])"), 1)
    return F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), lambda v: v <= 1e7)
