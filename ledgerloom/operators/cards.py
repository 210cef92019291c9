"""Card statements: rows without a running balance.

Blocks go on over pages. A row that names a closing section ends its block; a later dated row opens a table again. The side of an amount
comes from a mark at its end, from its column, from a mark behind it, and else from standing far right, which is a purchase.
Those readings are events of a block's tokens in order, and the first event of a side counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import parse_amount, to_cents
from ledgerloom.operators import columns, layout
from ledgerloom.sources.work import stored

# Sections that end the rows of a card statement, in order, and the dates of its rows.
STOP_SECTIONS = (
    "Reward Summary", "Rewards Summary", "Important Messages", "Marketing Message", "Statement Generated", "Insurance", "Billing & Statement", "Fees & Charges", "How To Make Payments",
    "Credit Limit", "Available Credit Limit", "Cash Limit", "Minimum Amount Due", "Total Amount Due", "Total", "DISCOVER IRRESISTIBLE GIFTS", "NEVER FALL FOR FAKE THREATS",
)
CARD_DATE = r"^(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}|\d{2,4}[/\-\.]\d{1,2}[/\-\.]\d{1,2}|\d{1,2}[\s\-][A-Za-z]{3,9}[\s\-]\d{2,4})"
#: A date may stand left of LEFT whatever the date zone; bare amounts right of FAR are purchases.
LEFT, FAR = 150, 300
BLOCK = ("doc_id", "block")


def cents(text: Column) -> Column:
    return to_cents(parse_amount(text))


def stop_word(text: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(w.lower())), w) for w in STOP_SECTIONS])


def block_tokens(rows: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens with row_no and zones -> tokens of blocks above their stop row (..., block, seq, row, lead), and (doc_id, block, stop_word, rows)."""
    blocks = layout.transaction_blocks(columns.anchored(rows, zones), across=True)
    lines = blocks.join(layout.row_boxes(rows).select(*layout.PAGE, "row_no", "text"), [*layout.PAGE, "row_no"]).withColumn("stop", stop_word(F.col("text")))
    by = Window.partitionBy(*BLOCK).orderBy("page", "row_no")
    lines = lines.withColumns({"row": F.row_number().over(by), "open": F.count("stop").over(by) == 0})
    facts = lines.groupBy(*BLOCK).agg(F.min_by("stop", F.when(F.col("stop").isNotNull(), F.col("row"))).alias("stop_word"), F.count_if("open").alias("rows"), F.min("page").alias("page"))
    held = rows.join(lines.where("open").select(*layout.PAGE, "row_no", "block", "row"), [*layout.PAGE, "row_no"])
    in_row = Window.partitionBy(*BLOCK, "row").orderBy("x0", "tok_idx")
    held = held.withColumns({"text": F.trim("text"), "pos": F.row_number().over(in_row), "next": F.upper(F.trim(F.lead("text").over(in_row)))})
    text, mark = F.col("text"), F.right(F.upper("text"), F.lit(2))
    # Readings of a text are columns of the stored tokens, so that it is parsed once for all that asks for them.
    marked = F.when(mark.isin("DR", "CR"), cents(F.trim(F.expr("left(upper(text), greatest(length(text) - 2, 0))"))))
    bare = F.when(mark.isin("DR", "CR"), cents(F.expr("left(text, greatest(length(text) - 2, 0))")))
    return held.select(*BLOCK, "row", "pos", "text", "x0", "next", cents(text).alias("value"), marked.alias("marked"), bare.alias("bare")), facts


def sides(tokens: DataFrame, zones: DataFrame) -> DataFrame:
    """Tokens of blocks -> (doc_id, block, debit_c, credit_c)."""
    bound = zones.groupBy("doc_id").agg(*[F.max(F.when(F.col("zone") == z, F.struct("lo", "hi"))).alias(z) for z in ("debit", "credit")])
    text = F.upper("text")
    mark = F.right(text, F.lit(2))
    cells = tokens.join(bound, "doc_id", "left")
    inside = lambda z: F.coalesce(F.col("x0").between(F.col(f"{z}.lo"), F.col(f"{z}.hi")), F.lit(False))
    real = F.col("value") > 0
    own = F.when(F.col("marked").isNotNull(), F.when(mark == "DR", "debit").otherwise("credit")).when(real & inside("credit"), "credit").when(real & inside("debit"), "debit")
    behind = F.when(real, F.when(F.col("next") == "DR", "debit").when(F.col("next") == "CR", "credit"))
    cells = cells.withColumns({"own": own, "behind": behind, "own_c": F.coalesce("marked", "value")})
    block = Window.partitionBy(*BLOCK)
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.col("row"))).over(block)
    cells = cells.withColumns({"own_row": first("own"), "behind_row": first("behind")})
    # Marks behind amounts are looked at while nothing is found: in one row, before any other reading in it.
    counted = (F.col("row") == F.col("behind_row")) & (F.col("own_row").isNull() | (F.col("own_row") > F.col("behind_row")))
    cells = cells.withColumn("behind", F.when(counted, F.col("behind")))

    def side(z: str) -> Column:
        one = F.min(F.when(F.col("own") == z, F.struct("row", "pos", F.col("own_c").alias("cents"))))
        two = F.min(F.when(F.col("behind") == z, F.struct("row", "pos", F.col("value").alias("cents"))))
        return F.least(one, two)["cents"]

    far = F.min(F.when(real & (F.col("x0") > FAR), F.struct("row", "pos", F.col("value").alias("cents"))))["cents"]
    out = cells.groupBy(*BLOCK).agg(side("debit").alias("debit_c"), side("credit").alias("credit_c"), far.alias("far_c"))
    return out.select(*BLOCK, F.coalesce("debit_c", F.when(F.col("credit_c").isNull(), F.col("far_c"))).alias("debit_c"), "credit_c")


def dates(tokens: DataFrame, zones: DataFrame) -> DataFrame:
    """(doc_id, block, date): the first date of a block's first row, in the date zone's reach or left of LEFT."""
    bound = zones.where("zone = 'date'").select("doc_id", (F.col("lo") - columns.REACH).alias("lo"), (F.col("hi") + columns.REACH).alias("hi"))
    cells = tokens.where("row = 1").join(bound, "doc_id", "left")
    placed = F.coalesce(F.col("x0").between(F.col("lo"), F.col("hi")), F.lit(True)) | (F.col("x0") <= LEFT)
    date = F.regexp_extract("text", rf"(?i){CARD_DATE}", 1)
    return cells.where(placed & (date != "")).groupBy(*BLOCK).agg(F.min_by(date, "pos").alias("date"))


def card_rows(tokens: DataFrame) -> DataFrame:
    """Page tokens -> (doc_id, block, page, date, narration, debit_c, credit_c, reason, stop_word): a row for each block.

    reason is null for accepted rows; else hit_stop_word (nothing stands before the section), no_date_in_anchor or no_amount_found. Narration is
    all that is neither the date nor an amount that counts nor a mark.
    """
    rows = stored(layout.detect_rows(tokens), "rows")
    zones = stored(columns.zones(rows), "zones")
    cells, facts = block_tokens(rows, zones)
    cells = stored(cells, "card-tokens")
    found = facts.join(dates(cells, zones), list(BLOCK), "left").join(sides(cells, zones), list(BLOCK), "left")
    reason = F.when(F.col("rows") == 0, "hit_stop_word").when(F.col("date").isNull(), "no_date_in_anchor").when(F.col("debit_c").isNull() & F.col("credit_c").isNull(), "no_amount_found")
    found = found.withColumn("reason", reason)
    text, value, bare = F.col("text"), F.col("value"), F.col("bare")
    mark = F.right(F.upper(text), F.lit(2))
    is_side = lambda v, c: F.coalesce((F.col(c) != 0) & (v == F.col(c)), F.lit(False))
    taken = (
        (text == F.col("date")) | is_side(value, "debit_c") | is_side(value, "credit_c") | F.upper(text).isin("DR", "CR") | ((mark == "DR") & is_side(bare, "debit_c")) | ((mark == "CR") & is_side(bare, "credit_c"))
    )
    words = cells.join(found.where("reason IS NULL").select(*BLOCK, "date", "debit_c", "credit_c"), list(BLOCK)).where(~taken)
    said = words.groupBy(*BLOCK).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "pos", "text"))), lambda t: t["text"]), " ").alias("narration"))
    out = found.join(said, list(BLOCK), "left")
    good = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return out.select(*BLOCK, "page", good("date"), F.when(F.col("reason").isNull(), F.coalesce("narration", F.lit(""))).alias("narration"), good("debit_c"), good("credit_c"), "reason", "stop_word")
