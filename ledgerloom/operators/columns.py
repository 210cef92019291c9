"""Columns of a statement's table: the header is looked for in windows of three rows, and rows are anchored in the date's zone.

A window has the column types that its rows' words name. It qualifies with a date, a balance and a debit or a credit; the one
with most types wins, the later one of equals, as tables come after summaries. Its words, down to the last row that added a type,
give the columns; zones are cut midway between the columns' centres.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.signals import DATE
from ledgerloom.operators.layout import LEFT, PAGE, row_boxes

# Words of column headers, in order of precedence.
WORDS = {
    "value_date": ("VALUE DATE", "VALUE DT", "VAL DT", "VAL.DATE", "EFFECTIVE DATE"),
    "cheque": ("CHQ", "CHEQUE", "REF", "REFERENCE", "INSTRUMENT"),
    "date": ("DATE",),
    "narration": ("PARTICULARS", "NARRATION", "DESCRIPTION", "DETAILS", "REMARKS"),
    "debit": ("WITHDRAWAL", "WITHDRAWALS", "DEBIT", "DR"),
    "credit": ("DEPOSIT", "DEPOSITS", "CREDIT", "CR"),
    "balance": ("BALANCE", "BAL"),
}
#: Of several words of a type the left-most counts for these, the right-most for the others.
LEFTMOST = ("value_date", "cheque", "date", "narration")
#: How far beyond the date zone a date may begin.
REACH = 70
# A date with letters or marks for digits and dashes, and a date that runs into the next word.
MISREAD = r"(?i)^(?:[Jj\|]?[Ool\d]{1,2}[\-\.\/\|\):][Ool\d]{1,2}[\-\.\/\|\):]\d{2,4}[a-zA-Z]?|[Jj\|]?[Ool\d]{1,2}[\-\.\/\|\):]\d{2,4}[a-zA-Z]?|[Jj\|]?[a-zA-Z]{3}[\-\.\/\|\):]\d{2,4}[a-zA-Z]?)$"
RUN_ON = r"^\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}\D"


def names(text: Column, kind: str) -> Column:
    """Whether a text in capitals has a word of a column type."""
    return text.rlike(r"\b(?:" + "|".join(map(re.escape, WORDS[kind])) + r")\b")


def _windows(boxes: DataFrame) -> DataFrame:
    """windows with `places`, the (page, row_no) of their three rows. Rows go through the window with a bit for each type, without their texts."""
    bits = {k: 1 << i for i, k in enumerate(WORDS)}
    text, own = F.upper("text"), F.lit(0)
    for k, bit in bits.items():
        own = own.bitwiseOR(F.when(names(text, k), bit).otherwise(0))
    by = Window.partitionBy("doc_id").orderBy("page", "row_no")
    rows = boxes.select(*PAGE, "row_no", own.alias("t0")).withColumns({"nth": F.row_number().over(by), **{f"t{i}": F.coalesce(F.lead("t0", i).over(by), F.lit(0)) for i in (1, 2)}, "places": F.array(*[F.lead(F.struct("page", "row_no"), i).over(by) for i in range(3)])})
    two = F.col("t0").bitwiseOR(F.col("t1"))
    every, has = two.bitwiseOR(F.col("t2")), lambda k: F.col("every").bitwiseAND(F.lit(bits[k])) != 0
    count = F.when(F.col("t2").bitwiseAND(F.bitwise_not(two)) != 0, 3).when(F.col("t1").bitwiseAND(F.bitwise_not(F.col("t0"))) != 0, 2).otherwise(1)
    found = rows.withColumns({"every": every, "rows": count}).where(has("date") & has("balance") & (has("debit") | has("credit")))
    types = F.sort_array(F.array_compact(F.array(*[F.when(has(k), k) for k in WORDS])))
    return found.select("doc_id", "nth", "rows", types.alias("types"), "places")


def windows(boxes: DataFrame) -> DataFrame:
    """boxes(doc_id, page, row_no, text) -> (doc_id, nth, rows, types): qualified windows of rows nth to nth + 2, types by name, and
    `rows`, how many of its rows count."""
    return _windows(boxes).drop("places")


def header_tokens(rows: DataFrame) -> DataFrame:
    """Tokens with row_no -> (doc_id, ord, text, x0, x1): the words of each statement's best header, row by row from left to right."""
    best = _windows(row_boxes(rows)).groupBy("doc_id").agg(F.max_by(F.struct("rows", "places"), F.struct(F.size("types"), "nth")).alias("b"))
    lines = best.select("doc_id", F.posexplode(F.slice("b.places", F.lit(1), F.col("b.rows"))).alias("nth", "at")).select("doc_id", "at.page", "at.row_no", "nth")
    words = rows.join(lines, [*PAGE, "row_no"])
    return words.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("nth", "x0", "tok_idx")).alias("ord"), "text", "x0", "x1")


def columns_of(header: DataFrame) -> DataFrame:
    """header_tokens -> (doc_id, ord, part, kind, x0, xc): the columns that words name. A word of both sides is cut in the middle, unless it
    is a mere DR/CR mark."""
    text, half = F.trim(F.replace(F.upper("text"), F.lit("."), F.lit(""))), (F.col("x0") + F.col("x1")) / 2.0
    debit, credit = names(text, "debit"), names(text, "credit")
    first = lambda k: F.least(*[F.when(F.instr(text, w) > 0, F.instr(text, w)) for w in WORDS[k]])
    ahead = first("debit") < first("credit")
    column = lambda kind, x0, xc: F.struct(kind.alias("kind"), x0.cast("double").alias("x0"), xc.cast("double").alias("xc"))
    left = column(F.when(ahead, "debit").otherwise("credit"), F.col("x0"), (F.col("x0") + half) / 2.0)
    right = column(F.when(ahead, "credit").otherwise("debit"), half, (half + F.col("x1")) / 2.0)
    kind = F.coalesce(*[F.when(names(text, k), k) for k in WORDS])
    marks = F.regexp_replace(text, r"[ /\\\-]", "").isin("DRCR", "CRDR")
    found = F.when(debit & credit & marks, F.array().cast("array<struct<kind:string,x0:double,xc:double>>")).when(debit & credit, F.array(left, right)).otherwise(F.array(column(kind, F.col("x0"), half)))
    return header.select("doc_id", "ord", F.posexplode(found).alias("part", "c")).select("doc_id", "ord", "part", "c.*").where("kind IS NOT NULL")


def zones(rows: DataFrame) -> DataFrame:
    """Tokens with row_no -> (doc_id, zone, lo, hi), none for statements without a header."""
    found = columns_of(header_tokens(rows))
    item, place = F.struct("x0", "xc", "ord", "part"), F.struct("ord", "part")
    one = found.groupBy("doc_id", "kind").agg(F.min_by(item, F.struct("x0", place)).alias("low"), F.max_by(item, F.struct("x0", -F.col("ord"), -F.col("part"))).alias("high"))
    kept = one.select("doc_id", F.col("kind").alias("zone"), F.when(F.col("kind").isin(*LEFTMOST), F.col("low")).otherwise(F.col("high")).alias("c"))
    by = Window.partitionBy("doc_id").orderBy("c.x0", "c.ord", "c.part")
    xc = F.col("c.xc")
    return kept.select("doc_id", "zone", F.coalesce((F.lag(xc).over(by) + xc) / 2, F.lit(0.0)).alias("lo"), F.coalesce((xc + F.lead(xc).over(by)) / 2, F.lit(9999.0)).alias("hi"))


def mended(text: Column) -> Column:
    """A misread date with digits and dashes in place; null for other texts."""
    bare = F.when(text.rlike(r"^[Jj][0-9Oo]") | text.startswith("|"), F.expr("1")).otherwise(F.expr("0"))
    cut = F.regexp_replace(F.substring(text, bare + 1, F.length(text)), r"[A-Za-z]$", "")
    return F.when(text.rlike(MISREAD), F.translate(cut, "Ool|:)", "001---"))


def anchored(rows: DataFrame, zones: DataFrame, *, mend: bool = False) -> DataFrame:
    """Tokens with row_no and zones -> row boxes with zone_text, dated, mended and anchor.

    zone_text is that of tokens that begin in the date zone, REACH wider on both sides, or left of LEFT if the statement has no date zone;
    the whole text if there are none. `dated`: it, or else the whole text, has a date, begins with one that runs on, or is a
    misread one. An anchor has a plain date within the first 20 characters of either; with `mend`, misread dates and run-on
    dates at the beginning are anchors too.
    """
    boxes = anchored_twice(rows, zones)
    return (boxes.withColumn("anchor", F.col("mended_anchor")) if mend else boxes).drop("mended_anchor")


def anchored_twice(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """`anchored` with the anchors of both ways, `anchor` and `mended_anchor`, in one pass over the tokens."""
    bound = zones.where("zone = 'date'").select("doc_id", (F.col("lo") - REACH).alias("from_x"), (F.col("hi") + REACH).alias("to_x"))
    held = rows.join(bound.hint("shuffle_hash"), "doc_id", "left")
    inside = F.coalesce(F.col("x0").between(F.col("from_x"), F.col("to_x")), F.col("x0") < LEFT)
    words = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(inside, F.struct("x0", "tok_idx", "text")))), lambda t: t["text"]), " ")
    boxes = row_boxes(held, words.alias("zone_text")).withColumn("zone_text", F.coalesce(F.nullif("zone_text", F.lit("")), F.col("text")))

    def plain(c: Column) -> Column:
        return c.rlike(DATE) | c.rlike(RUN_ON)

    healed = F.coalesce(mended(F.col("zone_text")), mended(F.col("text")))
    boxes = boxes.withColumn("mended", F.when(~plain(F.col("zone_text")), healed))
    early = rf"^.{{0,19}}?{DATE}"
    anchor = F.col("zone_text").rlike(early) | F.col("text").rlike(early)
    said = plain(F.col("zone_text")) | plain(F.col("text"))
    saved = F.coalesce(plain(F.col("mended")), F.lit(False))
    more = saved | F.col("zone_text").rlike(RUN_ON) | F.col("text").rlike(RUN_ON)
    return boxes.withColumns({"dated": said | saved, "anchor": anchor, "mended_anchor": anchor | more})
