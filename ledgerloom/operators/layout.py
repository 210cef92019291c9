"""Tokens to rows, zones and columns; page furniture. Tokens have doc_id, page, tok_idx, text, x0, x1, y0, y1."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ("doc_id", "page")
# Words of table headers, and of page furniture.
HEADER_WORDS = ("DATE", "BALANCE", "DEPOSIT", "WITHDRAWAL", "PARTICULARS", "AMOUNT", "DEBIT", "CREDIT", "NARRATION", "DESCRIPTION", "TRANSACTION", "DR", "CR", "CHQ", "REF")
BLOCK_FURNITURE = ("IFSC", "MICR", "Branch", "Address", "Statement", "Page", "Customer", "Nomination", "Registered", "Closing balance")
FURNITURE = ("BANK", "IFSC", "MICR", "PAGE", "STATEMENT", "ACCOUNT", "CURRENCY", "CUSTOMER", "NOMINATION")
PAGE_NUMBERS = (r"(?i)page\s+\d+\s+of\s+\d+", r"(?i)page\s+no\.?\s*\d+", r"(?i)page\s+\d+")
#: Where dates stand if no date zone is known.
LEFT = 150
ZONE_OF = {"DATE": "date", "NARRATION": "narration", "DEBIT": "debit", "CREDIT": "credit", "BALANCE": "balance"}


def y_tolerances(tokens: DataFrame) -> DataFrame:
    """Per page: half the upper median of token heights, 3 at least."""
    heights = F.sort_array(F.collect_list(F.col("y1") - F.col("y0")))
    return tokens.groupBy(*PAGE).agg(heights.alias("h")).select(*PAGE, F.greatest(F.lit(3.0), F.get("h", F.floor(F.size("h") / 2).cast("int")) * 0.5).alias("tolerance"))


def detect_rows(tokens: DataFrame) -> DataFrame:
    """Adds row_no to tokens: by y centre and x, a new row begins beyond the tolerance from the row's FIRST token, which a
    difference to the previous token can't express; so each page (bounded by what a page prints) is folded in the JVM.
    Tokens travel with their page, each column once, so one exchange does for tolerance, fold and result."""
    centre = (F.col("y0") + F.col("y1")) / 2.0
    sent = [c for c in tokens.columns if c not in (*PAGE, "x0", "tok_idx")]
    item = F.struct(centre.cast("double").alias("yc"), "x0", "tok_idx", F.struct(*[F.col(c) for c in sent]).alias("token"))
    pages = tokens.groupBy(*PAGE).agg(F.sort_array(F.collect_list(item)).alias("t"))
    pages = pages.withColumn("h", F.sort_array(F.array_compact(F.transform("t", lambda t: t["token"]["y1"] - t["token"]["y0"]))))
    tolerance = F.greatest(F.lit(3.0), F.get("h", F.floor(F.size("h") / 2).cast("int")) * 0.5)
    state = "struct<anchor:double,row:int,out:array<int>>"
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("row"), F.array().cast("array<int>").alias("out")).cast(state)

    def step(acc: Column, yc: Column) -> Column:
        new = acc["anchor"].isNull() | (F.abs(yc - acc["anchor"]) > F.col("tolerance"))
        row = F.when(new, acc["row"] + 1).otherwise(acc["row"])
        return F.struct(F.when(new, yc).otherwise(acc["anchor"]).alias("anchor"), row.alias("row"), F.array_append(acc["out"], row).alias("out")).cast(state)

    numbered = pages.withColumn("tolerance", tolerance).withColumn("rows", F.aggregate(F.transform("t", lambda t: t["yc"]), start, step)["out"])
    each = F.zip_with("t", "rows", lambda t, r: F.struct(t["x0"].alias("x0"), t["tok_idx"].alias("tok_idx"), t["token"].alias("token"), r.alias("row_no")))
    place = {c: c if c in PAGE else f"o.{c}" if c in ("x0", "tok_idx") else f"o.token.{c}" for c in tokens.columns}
    return numbered.select(*PAGE, F.explode(each).alias("o")).select(*[F.col(at).alias(c) for c, at in place.items()], "o.row_no")


def row_boxes(rows: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, page, row_no, y0, y1, n, text, left_text): rows with their tokens' text by x, and that of tokens that begin left of LEFT; and `more` aggregates."""
    words = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "tok_idx", "text"))), lambda t: t["text"]), " ")
    left = F.array_join(F.transform(F.filter(F.sort_array(F.collect_list(F.struct("x0", "tok_idx", "text"))), lambda t: t["x0"] < LEFT), lambda t: t["text"]), " ")
    return rows.groupBy(*PAGE, "row_no").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n"), words.alias("text"), left.alias("left_text"), *more)


def header_zones(rows: DataFrame) -> DataFrame:
    """(doc_id, zone, lo, hi): of each statement's header words in the row that has most of them, zones cut midway between
    neighbours' centres; the first begins at 0, the last ends at 9999. Ties: the first page and row. Rows carry their zones,
    so the tokens are read once."""
    zone = F.create_map(*[F.lit(x) for kv in ZONE_OF.items() for x in kv])
    cells = rows.withColumn("zone", F.try_element_at(zone, F.upper("text"))).where("zone is not null")
    each = cells.groupBy("doc_id", "page", "row_no", "zone").agg(F.min((F.col("x0") + F.col("x1")) / 2.0).alias("xc"))
    found = each.groupBy("doc_id", "page", "row_no").agg(F.collect_list(F.struct("zone", "xc")).alias("zones"))
    best = found.groupBy("doc_id").agg(F.max_by("zones", F.struct(F.size("zones"), -F.col("page"), -F.col("row_no"))).alias("zones"))
    centres = best.select("doc_id", F.inline("zones"))
    by = Window.partitionBy("doc_id").orderBy("xc")
    lo, hi = (F.lag("xc").over(by) + F.col("xc")) / 2, (F.col("xc") + F.lead("xc").over(by)) / 2
    return centres.select("doc_id", "zone", F.coalesce(lo, F.lit(0.0)).alias("lo"), F.coalesce(hi, F.lit(9999.0)).alias("hi"))


def assign_zones(tokens: DataFrame, zones: DataFrame) -> DataFrame:
    """Tokens with the zones that hold their left edge (both ends closed, so an edge token may be in two). An equi join on
    doc_id with a residual range predicate: a statement has few zones, so they are the side that a task holds, and tokens are not sorted. The
    zones' own exchange keeps their making and this join in different tasks."""
    own = zones.select(F.col("doc_id").alias("z_doc"), "zone", "lo", "hi").repartition("z_doc", "zone").hint("shuffle_hash")
    held = tokens.join(own, (F.col("doc_id") == F.col("z_doc")) & F.col("x0").between(F.col("lo"), F.col("hi")))
    return held.select("doc_id", "page", "tok_idx", "text", "zone")


def page_norm(text: Column) -> Column:
    """A token's text with page numbers alike."""
    norm = F.trim(text)
    for shape in PAGE_NUMBERS:
        norm = F.regexp_replace(norm, shape, "PAGE_N")
    return F.when(F.contains(F.lower(text), F.lit("page")), norm).otherwise(F.trim(text))


def suppressed_texts(tokens: DataFrame) -> DataFrame:
    """(doc_id, norm, score): repeated page furniture. 3 for over 70 % of the pages, 2 if mostly in the outer 15 % of the
    used height, 2 for each furniture word; from 5 on, and only on two pages or more.
    Most texts are on one page of a statement: windows over sorted tokens leave them out, where aggregates would keep an entry for each in memory."""
    page, doc, same = Window.partitionBy(*PAGE), Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "norm")
    top, low = F.min("y0").over(page), F.max("y1").over(page)
    at = F.try_divide((F.col("y0") + F.col("y1")) / 2.0 - top, low - top)
    placed = tokens.select("doc_id", "page", page_norm(F.col("text")).alias("norm"), "y0", "y1").withColumn("edge", F.coalesce((at <= 0.15) | (at >= 0.85), F.lit(False)))
    placed = placed.withColumn("pages", F.size(F.collect_set("page").over(doc))).drop("y0", "y1").where("norm <> ''").repartition("doc_id", "norm")
    several = placed.withColumns({"low": F.min("page").over(same), "high": F.max("page").over(same)}).where("low < high")
    seen = several.groupBy("doc_id", "norm").agg(F.size(F.collect_set("page")).alias("on_pages"), F.count(F.lit(1)).alias("n"), F.count_if("edge").alias("edge"), F.max("pages").alias("pages"))
    words = reduce(add, [F.when(F.contains(F.upper("norm"), F.lit(w)), 2).otherwise(0) for w in FURNITURE])
    score = F.when(F.col("on_pages") > F.col("pages") * 0.7, 3).otherwise(0) + F.when(F.col("edge") > F.col("n") * 0.5, 2).otherwise(0) + words
    return seen.select("doc_id", "norm", score.alias("score")).where("score >= 5")


def protected_rows(boxes: DataFrame) -> DataFrame:
    """Rows with three header words or more, and how many: their tokens are kept by suppression."""
    hits = F.size(F.filter(F.array(*[F.lit(w) for w in HEADER_WORDS]), lambda w: F.array_contains(F.split(F.upper("text"), r"\W+"), w)))
    return boxes.select(*PAGE, "row_no", hits.alias("hits")).where("hits >= 3")


def protect_tokens(rows: DataFrame) -> DataFrame:
    """Tokens with row_no -> the same with `protected`: those of rows with three header words or more."""
    kept = protected_rows(row_boxes(rows)).select(*PAGE, "row_no", F.lit(True).alias("protected"))
    return rows.join(kept, [*PAGE, "row_no"], "left").withColumn("protected", F.coalesce("protected", F.lit(False)))


def period_bands(tokens: DataFrame) -> DataFrame:
    """(doc_id, page, tok_idx) of page headings that state a period: within 20 of a token with `statement of account`, if that
    band has two dates and a from or to, the token itself, dates, and tokens with from or to."""
    low, yc = F.lower("text"), (F.col("y0") + F.col("y1")) / 2.0
    dated = r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}"
    heads = tokens.where(F.contains(low, F.lit("statement of account"))).select(F.col("doc_id").alias("h_doc"), F.col("page").alias("h_page"), F.col("tok_idx").alias("head"), yc.alias("h_yc"))
    near = (F.col("doc_id") == F.col("h_doc")) & (F.col("page") == F.col("h_page")) & (F.abs(yc - F.col("h_yc")) <= 20)
    band = tokens.select(*PAGE, "tok_idx", low.alias("low"), "y0", "y1").join(heads, near)
    one = Window.partitionBy(*PAGE, "head")
    stated = (F.sum(F.regexp_count("low", F.lit(dated))).over(one) >= 2) & (F.max(F.col("low").rlike("from|to").cast("int")).over(one) == 1)
    return band.withColumn("stated", stated).where(F.col("stated") & F.col("low").rlike(f"statement of account|from|to|{dated}")).select(*PAGE, "tok_idx").distinct()


def suppress(tokens: DataFrame) -> DataFrame:
    """Tokens(..., protected) without repeated page furniture: of statements of two pages or more, tokens go whose text, with
    page numbers alike, is one of suppressed_texts, and those of period_bands, unless they are protected."""
    several = tokens.groupBy("doc_id").agg(F.count_distinct("page").alias("pages")).where("pages > 1").select("doc_id")
    gone = suppressed_texts(tokens).select("doc_id", "norm", F.lit(True).alias("furniture"))
    bands = period_bands(tokens).join(several, "doc_id").withColumn("band", F.lit(True))
    marked = tokens.withColumn("norm", page_norm(F.col("text"))).join(gone, ["doc_id", "norm"], "left").join(bands, [*PAGE, "tok_idx"], "left")
    return marked.where("protected or furniture is null and band is null").drop("norm", "furniture", "band")


def discover_blocks(boxes: DataFrame) -> DataFrame:
    """Candidate transactions: blocks of rows that begin with a date, on a new page, or after a gap of over 15, read as a
    transaction, as a header and as account data; the first must score 8 at least and more than the others.
    Here the gap is to the previous row, so a running sum of beginnings numbers the blocks."""
    from ledgerloom.functions.signals import DISCOVERY_DATE, hypothesis_scores

    by = Window.partitionBy("doc_id").orderBy("page", "row_no")
    new = F.col("text").rlike(DISCOVERY_DATE) | (F.col("page") != F.lag("page").over(by)) | (F.col("y0") - F.lag("y1").over(by) > 15)
    rows = boxes.withColumn("new", F.coalesce(new, F.lit(True)).cast("int"))
    rows = rows.withColumn("block", F.sum("new").over(by))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "row_no", "text"))), lambda r: r["text"]), " ")
    blocks = rows.groupBy("doc_id", "block").agg(F.min("page").alias("page"), F.count(F.lit(1)).alias("rows"), text.alias("text"))
    # A generator's output: the scores are computed once for a block, not again for each condition on them.
    scored = blocks.select("*", F.explode(F.array(hypothesis_scores(F.col("text")))).alias("s"))
    return scored.where("s.transaction >= 8 and s.transaction > s.header and s.transaction > s.account").select("doc_id", "block", "page", "rows", "text", F.col("s.transaction").alias("score"))


def transaction_blocks(boxes: DataFrame, *, across: bool = False) -> DataFrame:
    """boxes(doc_id, page, row_no, y0, y1, text, left_text or anchor) -> (doc_id, page, row_no, block): rows of candidate transactions.

    A row that is an `anchor` opens a block; without that column, one with a date in the first 20 characters of its text, or of
    its part left of LEFT. Other rows continue it if the gap to the block's last row is
    from -50 to 45 and they are not furniture in the page's outer quarter or eighth. A third row, a second date or a second amount row opens a block of
    its own. Footer rows go, and a terminal one ends its page. With `across`, blocks go on over pages (where no gap counts), and a
    terminal row ends the statement. The state is the last row that was taken, so pages or statements are folded in the JVM.
    """
    from ledgerloom.functions.signals import AMOUNT, DATE, any_word, footer_decision

    page, keys = Window.partitionBy(*PAGE), ["doc_id"] if across else list(PAGE)
    rows = boxes.withColumn("at", F.col("y1") / F.greatest(F.max("y1").over(page), F.lit(1)))
    if "anchor" not in boxes.columns:
        rows = rows.withColumn("anchor", F.col("left_text").rlike(rf"^.{{0,19}}?{DATE}") | F.col("text").rlike(rf"^.{{0,19}}?{DATE}"))
    rows = rows.withColumn("action", footer_decision(F.col("text"), F.col("at"), F.col("anchor"))["action"])
    stopped = F.max((F.col("action") == "STOP_PAGE").cast("int")).over(Window.partitionBy(*keys).orderBy("page", "row_no"))
    rows = rows.withColumn("stopped", stopped).where("stopped = 0 and action = 'CONTINUE'")
    edge = ((F.col("at") > 0.88) | (F.col("at") < 0.25)) & any_word(F.lower("text"), tuple(map(str.lower, BLOCK_FURNITURE)))
    item = F.struct("page", "row_no", "y0", "y1", "anchor", edge.alias("edge"), F.col("text").rlike(DATE).alias("dated"), F.col("text").rlike(AMOUNT).alias("priced"))
    each = "struct<page:int,row_no:int,block:int>"
    state = f"struct<block:int,n:int,page:int,y1:double,dated:boolean,priced:boolean,out:array<{each}>>"
    start = F.struct(F.lit(-1).alias("block"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("page"), F.lit(0.0).alias("y1"), F.lit(False).alias("dated"), F.lit(False).alias("priced"), F.array().cast(f"array<{each}>").alias("out")).cast(state)

    def step(acc, r):
        gap = F.when(acc["page"] == r["page"], r["y0"] - acc["y1"])
        skip = ~r["anchor"] & ((acc["block"] < 0) | F.coalesce((gap < -50) | (gap > 45), F.lit(False)) | r["edge"])
        new = r["anchor"] | (acc["n"] >= 2) | (acc["dated"] & r["dated"]) | (acc["priced"] & r["priced"])
        block = F.when(new, acc["block"] + 1).otherwise(acc["block"])
        own = F.struct(r["page"].cast("int").alias("page"), r["row_no"].cast("int").alias("row_no"), block.alias("block"))
        taken = F.struct(block.alias("block"), F.when(new, 1).otherwise(acc["n"] + 1).alias("n"), r["page"].cast("int").alias("page"), r["y1"].cast("double").alias("y1"), r["dated"].alias("dated"), r["priced"].alias("priced"), F.array_append(acc["out"], own).alias("out")).cast(state)
        return F.when(skip, acc).otherwise(taken)

    folded = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("rows"))
    return folded.select("doc_id", F.explode(F.aggregate("rows", start, step)["out"]).alias("o")).select("doc_id", "o.page", "o.row_no", "o.block")
