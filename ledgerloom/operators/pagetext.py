"""Words of a page to text lines by column position, wrapped rows laid over each other, and lines cleaned for the text parser.

Words have doc_id, page, tok_idx, text, x0, x1, y0, y1 and the page's `width`; lines have doc_id, page, line_no, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.signals import DATE, DECIMAL
from ledgerloom.operators.layout import LEFT, PAGE

# Phrases of footer lines, and words at which no rows are laid over each other.
FOOTER_PHRASES = (
    "this is a computer generated", "does not require signature", "need not normally be signed", "contents of this statement will be", "no error is reported within", "treated that the entries",
    "please do not share your atm", "bank never asks for", "if you receive any alerts", "registered office address", "hdfcbanklimited", "closingbalanceincludes", "contentsofthisstatement",
    "stateaccountbranchgstn", "hdfcbankgstinnumber", "stateaccountbranch", "cin:", "customer care", "toll free", "end of statement", "*** end of", "powered by", "beware of cyber", "nevershare",
    "never share your", "scan for", "disclaimer", "deposit insurance", "yes bank gstin", "through sms", "w.e.f", "please refer to the notice", "please visit",
)
STOP_WORDS = ("PAGE", "Opening Balance", "TOTAL")
#: Columns in which a line's date stands.
DATE_COLUMNS = 30


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def without_sidebars(words: DataFrame) -> DataFrame:
    """Words of each page's main strips (tenths of its width with 15 % of the fullest one's words) and a margin of one and a half strips.
    All words stay where the main strips span nine tenths, or where no more than 40 % would."""
    strip = F.col("width") / 10.0
    page = Window.partitionBy(*PAGE)
    # Dealt by page at first, which does for strips, pages and lines.
    rows = words.repartition(*PAGE).withColumn("strip", F.floor(F.col("x0") / strip))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "strip"))).withColumn("main", F.col("n") >= F.max("n").over(page) * 0.15)
    rows = rows.withColumns({"lo": F.min(F.when(F.col("main"), F.col("strip"))).over(page) * strip, "hi": (F.max(F.when(F.col("main"), F.col("strip"))).over(page) + 1) * strip})
    inside = (F.col("x0") >= F.col("lo") - strip * 1.5) & (F.col("x1") <= F.col("hi") + strip * 1.5)
    whole = (F.col("width") <= 0) | ((F.col("hi") - F.col("lo")) / F.col("width") >= 0.9) | (F.count_if(inside).over(page) <= F.count(F.lit(1)).over(page) * 0.4)
    return rows.withColumns({"inside": inside, "whole": whole}).where("inside or whole").drop("strip", "n", "main", "lo", "hi", "inside", "whole")


def grouped(words: DataFrame, *, split_dates: bool = True) -> DataFrame:
    """Adds line_no and char_w. A line takes words whose centre is within the tolerance of its first word's (0.85 of the median height, 2.5 to 10);
    with split_dates a second date left of LEFT begins a line. A character is as wide as in the median word.
    Words travel with their page, so one exchange does for the fold and its result."""
    others = [c for c in words.columns if c not in (*PAGE, "tok_idx")]
    centre = (F.col("y0") + F.col("y1")) / 2.0
    main_date = (F.col("x0") < LEFT) & F.col("text").rlike(DATE) & F.lit(split_dates)
    wide = (F.col("x1") - F.col("x0")) / F.length("text")
    sample = F.sort_array(F.collect_list(F.when((F.length("text") > 2) & (wide > 2.0) & (wide < 15.0), wide)))
    heights = F.sort_array(F.collect_list(F.col("y1") - F.col("y0")))
    median = lambda a: F.get(F.col(a), F.floor(F.size(a) / 2).cast("int"))
    pages = words.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(centre.cast("double").alias("yc"), "x0", "tok_idx", main_date.alias("dated"), F.struct(*others).alias("word")))).alias("t"), sample.alias("sample"), heights.alias("h"))
    pages = pages.withColumns({"tolerance": F.greatest(F.lit(2.5), F.least(median("h") * 0.85, F.lit(10.0))), "char_w": F.when(F.size("sample") > 0, median("sample")).otherwise(F.greatest(F.lit(3.0), median("h") * 0.52))})
    state = "struct<y:double,line:int,dated:boolean,out:array<int>>"
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(-1).alias("line"), F.lit(False).alias("dated"), F.array().cast("array<int>").alias("out")).cast(state)

    def step(acc: Column, w: Column) -> Column:
        new = acc["y"].isNull() | (F.abs(w["yc"] - acc["y"]) > F.col("tolerance")) | (w["dated"] & acc["dated"])
        line = F.when(new, acc["line"] + 1).otherwise(acc["line"])
        return F.struct(F.when(new, w["yc"]).otherwise(acc["y"]).alias("y"), line.alias("line"), F.when(new, w["dated"]).otherwise(acc["dated"] | w["dated"]).alias("dated"), F.array_append(acc["out"], line).alias("out")).cast(state)

    placed = F.transform("t", lambda w: F.struct(w["yc"].alias("yc"), w["dated"].alias("dated")))
    lines = pages.withColumn("lines", F.aggregate(placed, start, step)["out"])
    each = F.zip_with("t", "lines", lambda w, n: F.struct(w["tok_idx"].alias("tok_idx"), w["word"].alias("word"), n.alias("line_no")))
    return lines.select(*PAGE, "char_w", F.explode(each).alias("o")).select(*PAGE, "o.tok_idx", "o.word.*", "char_w", "o.line_no")


def grid_lines(words: DataFrame, *, split_dates: bool = True) -> DataFrame:
    """Words -> lines: each word is written at its column, over what stands there, from left to right; lines end 20 columns beyond the page."""
    rows = grouped(words, split_dates=split_dates)
    centre = (F.col("y0") + F.col("y1")) / 2.0
    column = F.bround(F.col("x0") / F.col("char_w")).cast("int")
    item = F.struct("x0", centre.alias("yc"), "tok_idx", column.alias("at"), "text")
    last = F.max((F.col("width") / F.col("char_w")).cast("int") + 20)

    def write(acc: Column, w: Column) -> Column:
        return F.concat(F.rpad(F.substring(acc, F.lit(1), w["at"]), w["at"], F.lit(" ")), w["text"], F.substring(acc, w["at"] + F.length(w["text"]) + 1, F.length(acc)))

    lines = rows.groupBy(*PAGE, "line_no").agg(F.sort_array(F.collect_list(item)).alias("words"), last.alias("last"))
    return lines.select(*PAGE, "line_no", rstrip(F.substring(F.aggregate("words", F.lit(""), write), F.lit(1), F.col("last"))).alias("text"))


def _cells(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def fits_over(upper: Column, lower: Column) -> Column:
    """Whether a line may be laid over another: not both have a date, not both an amount, and no column has a mark in both."""
    both = lambda p: upper.rlike(p) & lower.rlike(p)
    meet = F.exists(F.zip_with(_cells(upper), _cells(lower), lambda a, b: F.coalesce((a != " ") & (b != " "), F.lit(False))), lambda x: x)
    return ~both(DATE) & ~both(DECIMAL) & ~meet


def laid_over(upper: Column, lower: Column) -> Column:
    """Both lines in one grid; the upper one's marks stay."""
    return rstrip(F.array_join(F.zip_with(_cells(upper), _cells(lower), lambda a, b: F.coalesce(F.when(a != " ", a), b, a)), ""))


def _overlaid(lines: DataFrame) -> DataFrame:
    """lines with `merged` (laid over the line before) and `deep` (would have been, but that one has two already).

    A line is laid over the one before it if it fits and that one is not laid over another. So of lines in succession that each fit
    the one before, every other one is: their places in such runs tell, and no line waits for another.
    """
    by = Window.partitionBy(*PAGE).orderBy("line_no")
    stop = F.lit(False)
    for w in STOP_WORDS:
        stop = stop | F.contains("text", F.lit(w))
    rows = lines.withColumns({"before": F.lag("text").over(by), "before2": F.lag("text", 2).over(by), "stop": stop})
    rows = rows.withColumn("fits", ~F.col("stop") & F.coalesce(fits_over(F.col("before"), F.col("text")), F.lit(False)))
    rows = rows.withColumn("run", F.count_if(~F.col("fits")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*PAGE, "run").orderBy("line_no")))
    # A run begins with the line that doesn't fit, unless the page does: places 2, 4, ... are laid over the places before them.
    rows = rows.withColumn("merged", F.col("fits") & (F.col("nth") % 2 == 0))
    deep = F.coalesce(F.lag("merged").over(by), F.lit(False)) & ~F.col("stop") & F.coalesce(fits_over(laid_over(F.col("before2"), F.col("before")), F.col("text")), F.lit(False))
    return rows.withColumn("deep", deep)


def overlaid_lines(lines: DataFrame) -> DataFrame:
    """lines -> (doc_id, page, line_no, text, rows): wrapped rows in one line, two at most; blank lines go."""
    by = Window.partitionBy(*PAGE).orderBy("line_no")
    rows = _overlaid(lines).withColumns({"below": F.lead("text").over(by), "takes": F.coalesce(F.lead("merged").over(by), F.lit(False))})
    out = rows.where("not merged").select(*PAGE, "line_no", F.when(F.col("takes"), laid_over(F.col("text"), F.col("below"))).otherwise(F.col("text")).alias("text"), F.when(F.col("takes"), 2).otherwise(1).alias("rows"))
    return out.where(F.trim(F.regexp_replace("text", r"\s", "")) != "")


def overlay_stats(lines: DataFrame) -> DataFrame:
    """(doc_id, page, before, overlaid, appended, safe_rejected)"""
    return _overlaid(lines).groupBy(*PAGE).agg(F.count(F.lit(1)).alias("before"), F.count_if("merged").alias("overlaid"), F.count_if(~F.col("merged")).alias("appended"), F.count_if("deep").alias("safe_rejected"))


def has_date_at_left(c: Column) -> Column:
    return F.substring(c, 1, DATE_COLUMNS).rlike(DATE)


def is_continuation(c: Column) -> Column:
    """A line that begins with a blank and has no date."""
    return c.rlike(r"^ .*\S") & ~c.rlike(DATE)


def joined_hyphens(lines: DataFrame) -> DataFrame:
    """A line that ends with a hyphen takes the next one in the hyphen's place. What a line ends with may hang on all before it, so a
    page's lines are folded in the JVM."""
    each = "struct<line_no:int,text:string>"
    state = f"struct<last:{each},out:array<{each}>>"
    start = F.struct(F.lit(None).cast(each).alias("last"), F.array().cast(f"array<{each}>").alias("out")).cast(state)

    def step(acc: Column, line: Column) -> Column:
        text = acc["last"]["text"]
        joins = F.coalesce(text.endswith("-"), F.lit(False))
        held = F.struct(acc["last"]["line_no"].alias("line_no"), F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.regexp_replace(line["text"], r"^\s+", "")).alias("text")).cast(each)
        out = F.when(joins | acc["last"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["last"]))
        return F.struct(F.when(joins, held).otherwise(line.cast(each)).alias("last"), out.alias("out")).cast(state)

    pages = lines.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(F.col("line_no").cast("int").alias("line_no"), "text"))).alias("lines"))
    done = F.aggregate("lines", start, step, lambda acc: F.array_append(acc["out"], acc["last"]))
    return pages.select(*PAGE, F.explode(done).alias("l")).select(*PAGE, "l.line_no", "l.text")


def without_footers(lines: DataFrame) -> DataFrame:
    low, gone = F.lower("text"), F.lit(False)
    for p in FOOTER_PHRASES:
        gone = gone | F.contains(low, F.lit(p))
    return lines.where(~gone)


def collapsed_blanks(lines: DataFrame) -> DataFrame:
    """Lines without blanks at their end; of blank lines in succession the first stays."""
    text = rstrip(F.col("text"))
    before = F.lag(text).over(Window.partitionBy(*PAGE).orderBy("line_no"))
    return lines.select(*PAGE, "line_no", text.alias("text"), before.alias("before")).where("text <> '' or before is null or before <> ''").drop("before")


def cleaned(lines: DataFrame) -> DataFrame:
    """Lines as the text parser takes them: glyph marks out, hyphens joined, footers and spare blanks gone."""
    plain = lines.withColumn("text", F.regexp_replace("text", r"\(cid:\d+\)", ""))
    return collapsed_blanks(without_footers(joined_hyphens(plain)))


def page_lines(words: DataFrame) -> DataFrame:
    """Words -> clean lines: side bars out, grid, wrapped rows, clean-up."""
    lines = grid_lines(without_sidebars(words), split_dates=False)
    return cleaned(overlaid_lines(lines).drop("rows"))
