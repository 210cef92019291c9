"""Transactions from page geometry: every token of a block belongs to its date, balance, debit, credit or narration.

Rows, blocks and zones come from `layout`; a block's cells are read by `detect.zone_candidates`; the rest is joins and
aggregates on (doc_id, page, block), so pages are independent but for the running balance of the last step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import parse_amount, to_cents
from ledgerloom.functions.signals import DATE
from ledgerloom.operators import detect, layout
from ledgerloom.operators.ledger import amount, conservation
from ledgerloom.sources.work import discard, stored

# Labels that no transaction has, labels of page balances, words of directions.
STRUCTURAL = r"(?i)\b(closing|opening|brought\s+forward|carried?\s+forward|balance\s+b/?f|balance\s+c/?f|grand\s+total|page\s+total|total\s+debit|total\s+credit|statement\s+of\s+account|end\s+of\s+statement)\b"
PAGE_BALANCE = r"(?i)\b(opening\s+balance|closing\s+balance|balance\s+b/?f|balance\s+c/?f|brought\s+forward|carried?\s+forward|balance\s+b\.?f\.?|balance\s+c\.?f\.?)\b"
CLOSING, OPENING = ("closing", "carried", "c/f", "c.f", "balance c"), ("opening", "brought", "b/f", "b.f", "balance b")
CONTAMINANTS = (
    "IFSC", "MICR", "Account No", "Account Number", "Branch", "Branch Code", "Currency", "Nomination", "Nominee", "Customer ID", "Cust ID", "Phone", "Mobile", "Email", "Address", "Page No",
    "Statement Period", "Opening Balance", "Closing Balance", "Generated On", "Printed On",
)
DATE_PREFIX = r"^(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4})\D"
# Payment references that tell a direction.
SAYS_CREDIT = r"(?i)(UPI[/\-]CR[/\-]|IMPS[/\-]CR[/\-]|NEFT[\s/\-\.]+CR\b|RTGS[\s/\-\.]+CR\b|ACH[/\-]CR\b|NACH[/\-]CR\b|COLL[/\-]CR\b|MB[/\-]CR[/\-]|IB[/\-]CR[/\-]|TFR[/\-]CR[/\-])"
SAYS_DEBIT = r"(?i)(UPI[/\-]DR[/\-]|IMPS[/\-]DR[/\-]|NEFT[\s/\-\.]+DR\b|RTGS[\s/\-\.]+DR\b|ACH[/\-]DR\b|NACH[/\-]DR\b|MB[/\-]DR[/\-]|IB[/\-]DR[/\-]|TFR[/\-]DR[/\-]|ATM[/\-]WDL[/\-]|WDL[\s][TT]FR[\s]UP[/\-]DR)"
#: Blocks of a statement that tell whether its columns are swapped; reasons of accepted rows.
SAMPLED, ACCEPTED = 60, ("ok", "conservation_conflict")
BLOCK = ("doc_id", "page", "block")


def block_tokens(rows: DataFrame) -> DataFrame:
    """Tokens with row_no -> those of transaction blocks, with `block` and their order `seq` in it."""
    return numbered(rows, layout.transaction_blocks(layout.row_boxes(rows)))


def numbered(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    held = rows.join(blocks.select("doc_id", "page", "row_no", "block"), ["doc_id", "page", "row_no"])
    return held.withColumn("seq", F.row_number().over(Window.partitionBy(*BLOCK).orderBy("row_no", "x0", "tok_idx")))


def in_zones(tokens: DataFrame, zones: DataFrame) -> DataFrame:
    """Tokens with the zone in which they begin, null for none. A token where two zones meet is the right one's. The few zones of a statement are
    the side that a task holds, so tokens are not sorted."""
    own = zones.select(F.col("doc_id").alias("z_doc"), "zone", "lo", "hi").hint("shuffle_hash")
    inside = (F.col("doc_id") == F.col("z_doc")) & (F.col("x0") >= F.col("lo")) & (F.col("x0") < F.col("hi"))
    return tokens.join(own, inside, "left").drop("z_doc", "lo", "hi")


def dates_of(tokens: DataFrame) -> DataFrame:
    """tokens(..., zone, seq) -> (doc_id, page, block, date, first, last): the first token of the date zone that is or begins with
    a date; else a date in all of the zone's tokens together, which claims them all (first and last: claimed places)."""
    text = F.trim("text")
    own = F.when(text.rlike(f"^{DATE}"), text).otherwise(F.nullif(F.regexp_extract(text, DATE_PREFIX, 1), F.lit("")))
    cells = tokens.where("zone = 'date'").withColumn("own", own)
    each = F.sort_array(F.collect_list(F.struct("seq", "text", "own")))
    grouped = cells.groupBy(*BLOCK).agg(each.alias("t"))
    single = F.get(F.filter("t", lambda x: x["own"].isNotNull()), F.lit(0))
    merged = F.array_join(F.transform("t", lambda x: x["text"]), " ")
    together = F.coalesce(F.nullif(F.regexp_extract(merged, DATE, 1), F.lit("")), F.nullif(F.regexp_extract(merged, DATE_PREFIX, 1), F.lit("")))
    found = grouped.select(*BLOCK, single.alias("s"), together.alias("m"), F.element_at("t", 1)["seq"].alias("lo"), F.element_at("t", -1)["seq"].alias("hi"))
    out = found.select(*BLOCK, F.coalesce("s.own", "m").alias("date"), F.coalesce("s.seq", "lo").alias("first"), F.coalesce("s.seq", "hi").alias("last"))
    return out.where("date is not null")


def amounts_of(tokens: DataFrame) -> DataFrame:
    """tokens(..., zone, seq) -> (doc_id, page, block, zone, value_c, claimed): the best reading of each amount zone, and the places
    of its tokens. CR and DR at a token's end are cells of their own."""
    text = F.trim("text")
    side = F.nullif(F.regexp_extract(text, r"(?i)^.+?(CR|DR)$", 1), F.lit(""))
    parts = F.when(side.isNotNull(), F.array(F.trim(F.expr("left(trim(text), length(trim(text)) - 2)")), side)).otherwise(F.array(text))
    cells = tokens.where("zone in ('debit', 'credit', 'balance') and trim(text) <> ''").select(*BLOCK, "zone", "seq", F.posexplode(F.filter(parts, lambda p: p != "")).alias("at", "cell"))
    runs = cells.groupBy(*BLOCK, "zone").agg(F.sort_array(F.collect_list(F.struct("seq", "at", "cell"))).alias("cells"))
    runs = runs.select(F.col("doc_id"), F.struct("page", "block", "zone").alias("row_no"), F.transform("cells", lambda c: c["cell"]).alias("texts"), F.transform("cells", lambda c: c["seq"]).alias("places"))
    best = detect.zone_candidates(runs.select("doc_id", "row_no", "texts"))
    out = runs.select("doc_id", "row_no", "places").join(best, ["doc_id", "row_no"])
    claimed = F.array_distinct(F.slice("places", F.col("first") + 1, F.col("last") - F.col("first")))
    return out.select("doc_id", "row_no.page", "row_no.block", "row_no.zone", to_cents(F.col("value")).alias("value_c"), claimed.alias("claimed"))


def extract_blocks(tokens: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Page tokens -> cells of their blocks, with the zones of the header words unless others are given."""
    rows = stored(layout.detect_rows(tokens), "rows")
    out = row_cells(rows, zones)
    discard(rows)
    return out


def row_cells(rows: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Stored tokens with row_no -> cells of their blocks. Tokens in their zones are read for dates, amounts and narration, so they are stored too; the
    steps to them are stored apart, as the shuffle files of one go before the next begins."""
    held = stored(block_tokens(rows), "block-tokens")
    zoned = stored(in_zones(held, layout.header_zones(rows) if zones is None else zones), "zoned-tokens")
    discard(held)
    return cells(zoned)


def cells(held: DataFrame) -> DataFrame:
    """Tokens of blocks with zones -> (doc_id, row_idx, page, block, date, narration, debit_c, credit_c, balance_c, anchor, tokens): a row for each block.

    Narration is what no other role claims, from left to right, without bare numbers. If the balance is missing while debit
    and credit are there, the right-most amount with a CR or DR is the balance, and leaves its column.
    """
    dates, amounts = dates_of(held), stored(amounts_of(held), "amounts")
    value = lambda z: F.max(F.when(F.col("zone") == z, F.col("value_c"))).alias(f"{z}_c")
    wide = amounts.groupBy(*BLOCK).agg(*[value(z) for z in ("debit", "credit", "balance")], F.flatten(F.collect_list("claimed")).alias("claimed"))
    item = F.struct("x0", "seq", F.trim("text").alias("text"), "row_no")
    blocks = held.where("trim(text) <> ''").groupBy(*BLOCK).agg(F.sort_array(F.collect_set(item)).alias("t"), F.min("row_no").alias("anchor_row"))
    blocks = blocks.join(dates, list(BLOCK), "left").join(wide, list(BLOCK), "left")
    mine = lambda x: F.array_contains(F.coalesce("claimed", F.array().cast("array<int>")), x["seq"]) | F.coalesce(x["seq"].between(F.col("first"), F.col("last")), F.lit(False))
    free = F.filter("t", lambda x: ~mine(x) & ~x["text"].rlike(r"^[\d,\.]+$"))
    texts = lambda items: F.array_join(F.transform(items, lambda x: x["text"]), " ")
    blocks = blocks.withColumn("narration", F.nullif(texts(free), F.lit("")))
    blocks = blocks.withColumn("anchor", F.lower(texts(F.filter("t", lambda x: x["row_no"] == F.col("anchor_row")))))
    priced = F.filter(F.transform("t", lambda x, i: F.struct(x["x0"].alias("x0"), to_cents(parse_amount(x["text"])).alias("cents"), (F.upper(x["text"]).rlike("CR|DR") | F.coalesce(F.upper(F.get(F.col("t"), i + 1)["text"]).isin("CR", "DR"), F.lit(False))).alias("sided"))), lambda x: x["cents"] > 0)
    right = F.element_at(F.array_sort(priced, lambda a, b: F.when(a["x0"] < b["x0"], -1).when(a["x0"] > b["x0"], 1).otherwise(0)), -1)
    blocks = blocks.withColumn("right", F.when(F.size(priced) > 0, right))
    owed = F.col("balance_c").isNull() & F.col("debit_c").isNotNull() & F.col("credit_c").isNotNull() & F.coalesce(F.col("right.sided"), F.lit(False))
    moved = F.col("right.cents")
    out = blocks.withColumn("owed", owed).withColumn("from_credit", F.col("owed") & (F.col("credit_c") == moved))
    balance = F.when(F.col("owed"), moved).otherwise(F.col("balance_c"))
    debit = F.when(F.col("owed") & ~F.col("from_credit") & (F.col("debit_c") == moved), None).otherwise(F.col("debit_c"))
    credit = F.when(F.col("from_credit"), None).otherwise(F.col("credit_c"))
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "block")) - 1).alias("row_idx")
    return out.select("doc_id", number, "page", "block", "date", "narration", debit.alias("debit_c"), credit.alias("credit_c"), balance.alias("balance_c"), "anchor", F.size("t").alias("tokens"))


def page_seeds(boxes: DataFrame) -> DataFrame:
    """boxes(doc_id, page, row_no, text) -> (doc_id, page, seed_c): balances that pages state. A closing one seeds the next page and
    the last one counts; an opening one seeds its own page unless it has a seed by then."""
    any_of = lambda words: F.lower("text").rlike("|".join(w.replace(".", r"\.") for w in words))
    words = F.filter(F.transform(F.split("text", r"\s+"), lambda w: to_cents(parse_amount(w))), lambda v: v > 0)
    rows = boxes.where(F.col("text").rlike(PAGE_BALANCE)).withColumn("found", words).where(F.size("found") > 0)
    closing = any_of(CLOSING)
    rows = rows.withColumns({"closing": closing, "value_c": F.element_at("found", -1)}).where(closing | any_of(OPENING))
    seeds = rows.select("doc_id", F.when(F.col("closing"), F.col("page") + 1).otherwise(F.col("page")).alias("page"), "closing", "value_c", F.struct("page", "row_no").alias("at"))
    best = seeds.groupBy("doc_id", "page").agg(F.max_by("value_c", F.when(F.col("closing"), F.col("at"))).alias("closed"), F.min_by("value_c", F.when(~F.col("closing"), F.col("at"))).alias("opened"))
    return best.select("doc_id", "page", F.coalesce("closed", "opened").alias("seed_c"))


def zones_swapped(tokens: DataFrame, zones: DataFrame) -> DataFrame:
    """block_tokens(doc_id, page, block, seq, text, x0) and zones -> (doc_id, agrees, disagrees, swapped): do payment references of one
    direction stand in that direction's column?

    Of a statement's first SAMPLED blocks those count that have references of one direction only and whose first amount stands in
    the debit or the credit zone. Swapped if three blocks tell and 60 % of them disagree.
    """
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda t: t["text"]), " ")
    amount_x = F.min_by("x0", F.when(F.trim("text").rlike(r"^[\d,]+\.\d{2}$"), F.col("seq")))
    blocks = tokens.groupBy(*BLOCK).agg(text.alias("text"), amount_x.alias("amount_x"))
    blocks = blocks.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "block")))
    bound = zones.groupBy("doc_id").agg(*[F.max(F.when(F.col("zone") == z, F.struct("lo", "hi"))).alias(z) for z in ("debit", "credit")]).where("debit IS NOT NULL AND credit IS NOT NULL")
    told = blocks.where(F.col("nth") <= SAMPLED).join(bound, "doc_id").withColumns({"says_credit": F.col("text").rlike(SAYS_CREDIT), "says_debit": F.col("text").rlike(SAYS_DEBIT)}).where("says_credit <> says_debit")
    inside = lambda z: F.col("amount_x").between(F.col(f"{z}.lo"), F.col(f"{z}.hi"))
    told = told.withColumns({"in_debit": inside("debit"), "in_credit": inside("credit")}).where("in_debit or in_credit")
    agrees = (F.col("says_credit") & F.col("in_credit")) | (F.col("says_debit") & F.col("in_debit"))
    out = told.groupBy("doc_id").agg(F.count_if(agrees).alias("agrees"), F.count_if(~agrees).alias("disagrees"))
    total = F.col("agrees") + F.col("disagrees")
    return out.withColumn("swapped", (total >= 3) & (F.col("disagrees") / total >= 0.6))


def unswapped(zones: DataFrame, swaps: DataFrame) -> DataFrame:
    """zones with debit and credit exchanged where a statement's columns are swapped."""
    other = F.when(F.col("zone") == "debit", "credit").when(F.col("zone") == "credit", "debit").otherwise(F.col("zone"))
    swapped = zones.join(swaps.where("swapped").select("doc_id", "swapped"), "doc_id", "left")
    return swapped.select("doc_id", F.when(F.col("swapped"), other).otherwise(F.col("zone")).alias("zone"), "lo", "hi")


def decided(blocks: DataFrame, seeds: DataFrame) -> DataFrame:
    """extract_blocks and page_seeds -> (doc_id, row_idx, accepted, reason, conservation, contaminated, balance_missing).

    No date, nothing at all, no side and both sides are rejected. An unconserved row is accepted as a conflict; of the others
    those whose first row has a structural label are rejected. The previous balance is the last accepted row's, and whether a row is
    accepted may hang on it, so a statement's rows are folded in order, in the JVM. Where a page begins without a previous
    balance, the page's seed stands for it.
    """
    none, both = F.col("debit_c").isNull() & F.col("credit_c").isNull(), F.col("debit_c").isNotNull() & F.col("credit_c").isNotNull()
    hard = F.when(F.col("date").isNull(), "no_date").when(none & F.col("balance_c").isNull(), "NO_TRANSACTION_SEED").when(none, "no_debit_or_credit").when(both, "both_debit_and_credit")
    dirty = F.coalesce(F.upper("narration").rlike("|".join(map(str.upper, CONTAMINANTS))), F.lit(False))
    label = F.coalesce(F.col("anchor").rlike(STRUCTURAL), F.lit(False))
    rows = blocks.join(seeds, ["doc_id", "page"], "left")
    item = F.struct("row_idx", "page", "seed_c", hard.alias("hard"), label.alias("label"), amount("credit_c").alias("credit_c"), amount("debit_c").alias("debit_c"), "balance_c", dirty.alias("contaminated"))
    each = "struct<row_idx:int,reason:string,conservation:string,contaminated:boolean,balance_missing:boolean>"
    state = f"struct<prev:bigint,page:int,out:array<{each}>>"
    start = F.struct(F.lit(None).cast("bigint").alias("prev"), F.lit(None).cast("int").alias("page"), F.array().cast(f"array<{each}>").alias("out")).cast(state)

    def step(acc: Column, r: Column) -> Column:
        prev = F.when(acc["prev"].isNull() & ~acc["page"].eqNullSafe(r["page"]), r["seed_c"]).otherwise(acc["prev"])
        kept = F.when(r["hard"].isNull(), conservation(prev, r["credit_c"], r["debit_c"], r["balance_c"])).otherwise("UNSEEDED")
        reason = F.coalesce(r["hard"], F.when(kept == "FAIL", "conservation_conflict").when(r["label"], "structural_label").otherwise("ok"))
        after = F.when(reason.isin(*ACCEPTED), r["balance_c"]).otherwise(prev)
        own = F.struct(r["row_idx"].cast("int").alias("row_idx"), reason.alias("reason"), kept.alias("conservation"), r["contaminated"].alias("contaminated"), r["balance_c"].isNull().alias("balance_missing"))
        return F.struct(after.alias("prev"), r["page"].cast("int").alias("page"), F.array_append(acc["out"], own).alias("out")).cast(state)

    folded = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("rows"))
    out = folded.select("doc_id", F.explode(F.aggregate("rows", start, step)["out"]).alias("o"))
    return out.select("doc_id", "o.row_idx", F.col("o.reason").isin(*ACCEPTED).alias("accepted"), "o.reason", "o.conservation", "o.contaminated", "o.balance_missing")


def rescued(blocks: DataFrame, zones: DataFrame) -> DataFrame:
    """Blocks of statements without a balance zone: if both sides are there, the right-most side took the balance and gives it back."""
    bound = zones.groupBy("doc_id").agg(F.max(F.col("zone") == "balance").alias("has_balance"), *[F.coalesce(F.max(F.when(F.col("zone") == z, F.col("hi"))), F.lit(0.0)).alias(f"{z}_hi") for z in ("debit", "credit")])
    rows = blocks.join(bound, "doc_id", "left")
    owed = ~F.coalesce("has_balance", F.lit(False)) & F.col("debit_c").isNotNull() & F.col("credit_c").isNotNull()
    right = F.coalesce(F.col("credit_hi") > F.col("debit_hi"), F.lit(False))
    rows = rows.withColumns({"from_credit": owed & right, "from_debit": owed & ~right})
    balance = F.when(F.col("from_credit"), F.col("credit_c")).when(F.col("from_debit"), F.col("debit_c")).otherwise(F.col("balance_c"))
    out = rows.withColumns({"balance_c": balance, "credit_c": F.when(~F.col("from_credit"), F.col("credit_c")), "debit_c": F.when(~F.col("from_debit"), F.col("debit_c"))})
    return out.drop("has_balance", "debit_hi", "credit_hi", "from_credit", "from_debit")


def parse(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Page tokens -> (blocks with their cells, decisions)."""
    return parse_steps(tokens)[2:]


def parse_steps(tokens: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Page tokens -> (zones, tokens of blocks, blocks with their cells, decisions): zones from the best header window, blocks anchored in the date
    zone, swapped columns put right before any token is owned, cells, rescue without a balance zone, and the fold."""
    from ledgerloom.operators import columns

    rows = stored(layout.detect_rows(tokens), "rows")
    zones = stored(columns.zones(rows), "zones")
    dated = rows.join(zones.where("zone = 'date'").select("doc_id"), "doc_id", "left_semi")
    held = stored(numbered(dated, layout.transaction_blocks(columns.anchored(dated, zones))), "block-tokens")
    seeds = stored(page_seeds(layout.row_boxes(rows)), "seeds")
    discard(rows)
    given, zones = zones, stored(unswapped(zones, zones_swapped(held, zones)), "zones")
    zoned = stored(in_zones(held, zones), "zoned-tokens")
    blocks = stored(rescued(cells(zoned), zones), "blocks")
    discard(given, zoned)
    return zones, held, blocks, decided(blocks, seeds)
