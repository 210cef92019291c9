"""Dates in text, as ISO strings or dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of statement dates, in the order in which they are tried, and their shapes.
FORMATS = ("d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "d MMM yyyy", "d-MMM-yyyy", "d-MMM-yy")
# Formats of dates beside stated balances and in statement periods, in order, and the pattern of a period.
SEED_FORMATS = ("d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "d-M-yy", "d/M/yy", "d.M.yy", "d-MMM-yyyy", "d/MMM/yyyy")
SEED_SHAPES = (r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}\.\d{1,2}\.\d{4}$", r"^\d{1,2}-\d{1,2}-\d{2}$", r"^\d{1,2}/\d{1,2}/\d{2}$", r"^\d{1,2}\.\d{1,2}\.\d{2}$", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", r"^\d{1,2}/[A-Za-z]{3}/\d{4}$")
SEED_DATE = r"(\d{1,2}[-/\.](\d{1,2}|[A-Za-z]{3})[-/\.]\d{2,4})"
PERIOD = rf"(?i)(?:from|between)?\s*{SEED_DATE}\s*(?:to|and|-)\s*{SEED_DATE}"
SHAPES = (r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2} [A-Za-z]{3} \d{4}$", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", r"^\d{1,2}-[A-Za-z]{3}-\d{2}$")


def parse_date(c: Column) -> Column:
    """The first format that reads the text; a shape guards each, as formats read more than they print."""
    text = F.initcap(F.trim(c))
    return F.coalesce(*[F.when(text.rlike(s), F.try_to_date(text, f)) for f, s in zip(FORMATS, SHAPES)])


def normalize_date(c: Column) -> Column:
    """ISO date; text that no format reads stays, trimmed; empty text is null."""
    return F.when(F.trim(c) != "", F.coalesce(F.date_format(parse_date(c), "yyyy-MM-dd"), F.trim(c)))


def parse_seed_date(c: Column) -> Column:
    """A date beside a stated balance, by the first of SEED_FORMATS that reads it. Two-digit years from 69 on are of the last century."""
    text = F.initcap(F.trim(c))
    dates = []
    for f, s in zip(SEED_FORMATS, SEED_SHAPES):
        day = F.try_to_date(text, f)
        dates.append(F.when(text.rlike(s), day if f.endswith("yyyy") else F.when(F.year(day) >= 2069, F.add_months(day, F.lit(-1200))).otherwise(day)))
    return F.coalesce(*dates)


def statement_period(c: Column) -> Column:
    """The first `date to date` (or `and`, or a dash) with start <= end, as struct(start, end)."""
    starts, ends = (F.transform(F.regexp_extract_all(c, F.lit(PERIOD), k), parse_seed_date) for k in (1, 3))
    both = F.filter(F.arrays_zip(starts.alias("start"), ends.alias("end")), lambda p: p["start"] <= p["end"])
    return F.get(both, F.lit(0))
