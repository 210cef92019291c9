"""Readings of numeric cells: every way to read a token is kept with a confidence, and the best one is chosen last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Columns of numbers.
NUMERIC_COLUMNS = ("debit", "credit", "balance", "withdrawal", "deposit", "cheque")
GROUPED = r"^((\d{1,2}(,\d{2})*(,\d{3})?)?\.\d{2})$"
READING = "struct<value:double,text:string,confidence:double,by:string>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row, however often body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9.,]", "")


def _reading(text: Column, confidence: Column | float, by: Column | str) -> Column:
    """A reading of a plain number; null for other texts."""
    confidence, by = (x if isinstance(x, Column) else F.lit(x) for x in (confidence, by))
    return bound(text, lambda t: F.when(t.rlike(r"^(\d+\.?\d*|\.\d+)$"), F.struct(t.try_cast("double").alias("value"), t.alias("text"), confidence.alias("confidence"), by.alias("by")).cast(READING)))


def hypotheses(c: Column) -> Column:
    """array<struct(value, text, confidence, by)>: all readings of a cell in the order in which they are tried.

    The digits with commas taken out; of several dots the last one; each part between blanks, and all parts together; what stands before the first
    other character; a colon as the point. Digits are never invented. Empty without digits.
    """
    none = F.array().cast(f"array<{READING}>")

    def every(clean: Column, bare: Column) -> Column:
        indian, decimal = clean.rlike(GROUPED), bare.rlike(r"^\d+\.\d{2}$")
        format_ = F.when(indian, 0.98).when(decimal, 0.95).otherwise(0.60)
        how = F.when(indian, "matched_indian_format").when(decimal, "stripped_commas; standard_decimal").otherwise("stripped_commas")
        dots = F.when(F.length(clean) - F.length(F.replace(clean, F.lit("."), F.lit(""))) > 1, _reading(F.regexp_replace(clean, r"\.(?=.*\.)", ""), 0.70, "converted_internal_dots_to_commas"))
        spaced = F.contains(c, F.lit(" "))
        part = lambda p: _reading(F.replace(_digits(p), F.lit(","), F.lit("")), 0.40, F.concat(F.lit("extracted_part_from_space: "), p))
        parts = F.transform(F.filter(F.split(c, r"\s+"), lambda p: p != ""), part)
        prefix = F.regexp_replace(F.regexp_extract(c, r"^([0-9.,\s]+)", 1), r"^\s+|\s+$", "")
        cut = bound(prefix, lambda p: F.when((p != "") & (p != clean), _reading(F.replace(p, F.lit(","), F.lit("")), 0.85, "truncated_trailing_alpha_noise")))
        colon = F.when(F.contains(c, F.lit(":")), _reading(F.replace(_digits(F.replace(c, F.lit(":"), F.lit("."))), F.lit(","), F.lit("")), 0.80, "replaced_colon_with_dot"))
        return F.concat(F.array(_reading(bare, format_, how), dots), F.when(spaced, F.concat(parts, F.array(_reading(bare, 0.50, "removed_internal_space")))).otherwise(none), F.array(cut, colon))

    return bound(_digits(c), lambda clean: F.when(clean.rlike(r"\d"), F.array_compact(bound(F.replace(clean, F.lit(","), F.lit("")), lambda bare: every(clean, bare)))).otherwise(none))


def candidates(readings: Column) -> Column:
    """One reading of each value: the text of the first, the highest confidence and who first had it; the most confident first."""

    def of(value: Column, same: Column) -> Column:
        best = lambda top: F.struct(value.alias("value"), F.get(same, F.lit(0))["text"].alias("text"), top.alias("confidence"), F.get(F.filter(same, lambda r: r["confidence"] == top), F.lit(0))["by"].alias("by"))
        return bound(F.array_max(F.transform(same, lambda r: r["confidence"])), best)

    def each(all_: Column) -> Column:
        values = F.array_distinct(F.transform(all_, lambda r: r["value"]))
        return F.transform(values, lambda v, i: F.struct(bound(F.filter(all_, lambda r: r["value"] == v), lambda same: of(v, same)).alias("c"), i.alias("i")))

    order = lambda a, b: F.when(a["c"]["confidence"] > b["c"]["confidence"], -1).when(a["c"]["confidence"] < b["c"]["confidence"], 1).otherwise(a["i"] - b["i"])
    return F.transform(F.array_sort(bound(readings, each), order), lambda x: x["c"])


def select_best(candidates: Column) -> Column:
    """The most confident candidate; null without any."""
    return F.get(candidates, F.lit(0))


def decision(kind: Column, column: Column, text: Column) -> Column:
    """struct(action, reason) for an entity of a class in a column: headers and footers go, and of number columns dates and words of over
    three letters."""
    numeric = F.coalesce(column.isin(*NUMERIC_COLUMNS), F.lit(False))
    alnum = F.regexp_replace(text, r"[^\p{L}\p{N}]", "")
    reason = (
        F.when(kind == "FOOTER", "FOOTER").when(kind == "HEADER", "HEADER").when((kind == "DATE") & numeric, "DATE_IN_NUMERIC_COLUMN")
        .when((kind == "TEXT") & numeric & alnum.rlike(r"^\p{L}{4,}$"), "TEXT_IN_NUMERIC_COLUMN").otherwise("VALID")
    )
    return F.struct(F.when(reason == "VALID", "KEEP").otherwise("DROP").alias("action"), reason.alias("reason"))
