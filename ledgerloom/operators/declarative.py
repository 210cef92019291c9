"""Transactions from entities: tokens are merged by their geometry, classed, put under the words of the header row, filtered, read as numbers,
and gathered row by row. No column words but the header's own are asked for.

Merging and row building look at the box or row so far, so the tokens of one group (a page, or a line of it) are folded in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.signals import entity_class
from ledgerloom.operators import detect, readings

#: Width of a character; how far rows of a header and of a transaction reach down.
CHAR, HEADER_REACH, ROW_REACH = 10.0, 10, 15
PAGE = ("doc_id", "page")
_BOX = "text:string,x0:double,y0:double,x1:double,y1:double,confidence:double,children:array<int>"


def _fold(tokens: DataFrame, keys: Sequence[str], extra: str, merged) -> DataFrame:
    """Tokens of a group from left to right; merged(box, token) gives whether to merge, the joining text, and the merged box's other fields."""
    box = f"struct<{_BOX},{extra}>"
    state = f"struct<box:{box},out:array<{box}>>"
    start = F.struct(F.lit(None).cast(box).alias("box"), F.array().cast(f"array<{box}>").alias("out")).cast(state)
    names = [f.split(":")[0] for f in extra.split(",")]

    def step(acc: Column, t: Column) -> Column:
        held = acc["box"]
        goes, joint, confidence, more = merged(held, t)
        goes = held.isNotNull() & F.coalesce(goes, F.lit(False))
        wide = F.struct(
            F.concat(held["text"], joint, t["text"]).alias("text"), F.least(held["x0"], t["x0"]).alias("x0"), F.least(held["y0"], t["y0"]).alias("y0"), F.greatest(held["x1"], t["x1"]).alias("x1"), F.greatest(held["y1"], t["y1"]).alias("y1"),
            confidence.alias("confidence"), F.concat(held["children"], F.array(t["tok_idx"])).alias("children"), *[c.alias(n) for n, c in zip(names, more)],
        ).cast(box)
        own = F.struct(t["text"].alias("text"), *[t[c].alias(c) for c in ("x0", "y0", "x1", "y1", "confidence")], F.array(t["tok_idx"]).alias("children"), *[F.lit(None).alias(n) for n in names]).cast(box)
        out = F.when(goes | held.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], held))
        return F.struct(F.when(goes, wide).otherwise(own).alias("box"), out.alias("out")).cast(state)

    item = F.struct(F.col("x0").cast("double").alias("x0"), F.col("tok_idx").cast("int").alias("tok_idx"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y0", "y1", "confidence")], "text")
    groups = tokens.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("t"))
    done = F.aggregate("t", start, step, lambda acc: F.array_append(acc["out"], acc["box"]))
    return groups.select(*keys, F.posexplode(done).alias("entity", "e")).select(*keys, "entity", "e.*")


def _overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def group_entities(tokens: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Tokens with confidence -> (keys, entity, text, x0, y0, x1, y1, confidence, children, x_gap, baseline, height, overlap, strategy).

    A token joins the box before it if the gap is from -2 to 2.5 characters, their baselines are alike by half and they overlap by three tenths of the
    lower height. Evidence is that of the last merge: suffix_attach for CR and DR, currency_prefix_merge after a currency, else
    horizontal_merge; null for lone tokens.
    """

    def merged(a: Column, b: Column):
        ha, hb = a["y1"] - a["y0"], b["y1"] - b["y0"]
        low = F.least(ha, hb)
        gap = b["x0"] - a["x1"]
        overlap = F.when(low > 0, _overlap(a, b) / low).otherwise(0.0)
        baseline = F.when(low > 0, 1.0 - F.abs(a["y1"] - b["y1"]) / low).otherwise(0.0)
        height = F.when(F.greatest(ha, hb) > 0, low / F.greatest(ha, hb)).otherwise(0.0)
        strategy = F.when(F.upper(b["text"]).isin("CR", "DR"), "suffix_attach").when((a["text"] == "₹") | F.upper(a["text"]).isin("RS", "RS.", "INR"), "currency_prefix_merge").otherwise("horizontal_merge")
        goes = (gap <= CHAR * 2.5) & (gap >= -CHAR * 2) & (baseline >= 0.5) & (overlap >= 0.3)
        return goes, F.lit(" "), F.least(a["confidence"], b["confidence"]), (gap, baseline, height, overlap, strategy)

    return _fold(tokens, keys, "x_gap:double,baseline:double,height:double,overlap:double,strategy:string", merged)


def reconstruct_entities(tokens: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Tokens -> (keys, entity, text, x0, y0, x1, y1, confidence, children): neighbours that overlap by half the lower height with a gap from -10 to 20,
    the confidence being the least of the merges' (0.99 up to a gap of 5, 0.90 up to 10, 0.75 up to 20), 1 for lone tokens. Text
    closer than 3 is joined without a blank."""

    def merged(a: Column, b: Column):
        gap, low = b["x0"] - a["x1"], F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])
        apart = (gap > 30.0) | (gap < -10.0) | ((low > 0) & (_overlap(a, b) / F.nullif(low, F.lit(0.0)) < 0.5))
        sure = F.when(F.coalesce(apart, F.lit(False)), 0.0).when(gap <= 5.0, 0.99).when(gap <= 10.0, 0.90).when(gap <= 20.0, 0.75).otherwise(0.40)
        return sure >= 0.70, F.when(gap > 3, " ").otherwise(""), F.least(a["confidence"], sure), (gap,)

    return _fold(tokens.withColumn("confidence", F.lit(1.0)), keys, "x_gap:double", merged).drop("x_gap")


def rows_down(items: DataFrame, reach: int, name: str) -> DataFrame:
    """Numbers the rows of a page: a row takes what begins less than `reach` below its first item. Only the distinct heights of a page are folded. Items
    travel with their page, so items that come by page are not shuffled."""
    state = "struct<y:double,row:int,out:array<struct<y0:double,row:int>>>"
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(-1).alias("row"), F.array().cast("array<struct<y0:double,row:int>>").alias("out")).cast(state)

    def step(acc: Column, y: Column) -> Column:
        new = acc["y"].isNull() | (F.abs(y - acc["y"]) >= reach)
        row = F.when(new, acc["row"] + 1).otherwise(acc["row"])
        return F.struct(F.when(new, y).otherwise(acc["y"]).alias("y"), row.alias("row"), F.array_append(acc["out"], F.struct(y.alias("y0"), row.alias("row"))).alias("out")).cast(state)

    item = F.struct(*[F.col(c) for c in items.columns if c not in PAGE])
    pages = items.where("y0 is not null").groupBy(*PAGE).agg(F.collect_list(item).alias("items"))
    heights = F.sort_array(F.array_distinct(F.transform("items", lambda t: t["y0"])))
    rows = pages.withColumn("heights", F.map_from_entries(F.aggregate(heights, start, step)["out"]))
    return rows.select(*PAGE, "heights", F.explode("items").alias("o")).select(*PAGE, "o.*", F.element_at("heights", F.col("o.y0")).alias(name))


def in_columns(entities: DataFrame) -> DataFrame:
    """Classed entities -> the same with `column` and `field`: the header row has most HEADER entities of its page (the first of equals); each of its
    entities gives a column from its left edge to the next one's, and an entity is in the column of its centre."""
    names = [c for c in entities.columns if c not in PAGE]
    rows = rows_down(entities, HEADER_REACH, "line").withColumn("n", F.count_if(F.col("class") == "HEADER").over(Window.partitionBy(*PAGE, "line")))
    best = F.max_by("line", F.when(F.col("n") > 0, F.struct("n", -F.col("line"))))
    pages = rows.groupBy(*PAGE).agg(F.collect_list(F.struct(*names, "line")).alias("items"), best.alias("best"))
    heads = F.sort_array(F.transform(F.filter("items", lambda t: t["line"] == F.col("best")), lambda t: F.struct(t["x0"].alias("x0"), t["y0"].alias("y0"), t["entity"].alias("entity"), t["text"].alias("text"))))
    pages = pages.withColumn("heads", heads)
    zones = F.transform("heads", lambda h, i: F.struct(h["text"].alias("header"), h["x0"].alias("lo"), F.coalesce(F.get(F.col("heads"), i + 1)["x0"], F.lit(9999.0)).alias("hi"))).cast("array<struct<header:string,lo:double,hi:double>>")
    held = pages.select(*PAGE, zones.alias("zones"), F.explode("items").alias("o")).select(*PAGE, "zones", *[f"o.{c}" for c in names])
    centre = (F.col("x0") + F.col("x1")) / 2.0
    held = held.withColumn("header", F.get(F.filter("zones", lambda z: (z["lo"] <= centre) & (centre < z["hi"])), F.lit(0))["header"])
    return held.select("*", F.lower("header").alias("column"), detect.canonical_field(F.col("header")).alias("field")).drop("zones", "header")


def declarative_rows(tokens: DataFrame) -> DataFrame:
    """Tokens with confidence -> (doc_id, page, row, date, value_date, narration, cheque, debit, credit, balance).

    Of several entities of a field the lowest counts; narrations are joined from top to bottom. Numbers come from entities that the
    filter keeps, in their most confident reading. Each page is a group of its own: tokens are brought together by page once, and all that follows stays there.
    """
    entities = group_entities(tokens).select(*PAGE, "entity", "text", "x0", "x1", "y0", entity_class(F.col("text")).alias("class"))
    placed = in_columns(entities).withColumn("action", readings.decision(F.col("class"), F.col("column"), F.col("text"))["action"])
    number = F.when(F.col("action") == "KEEP", readings.select_best(readings.candidates(readings.hypotheses(F.col("text"))))["value"])
    placed = placed.withColumns({"number": number, "worded": F.col("class").isin("DATE", "TEXT")})
    items = rows_down(placed.where("worded or number is not null"), ROW_REACH, "row")
    place = F.struct("y0", "entity")
    said = lambda field: F.max_by("text", F.when(F.col("worded") & (F.col("field") == field), place))
    value = lambda field: F.max_by("number", F.when(F.col("number").isNotNull() & (F.col("field") == field), place))
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("worded") & (F.col("field") == "NARRATION"), F.struct("y0", "entity", "text")))), lambda t: t["text"]), " ")
    return items.groupBy(*PAGE, "row").agg(
        said("DATE").alias("date"), said("VALUE_DATE").alias("value_date"), F.nullif(told, F.lit("")).alias("narration"), said("CHEQUE").alias("cheque"), value("DEBIT").alias("debit"), value("CREDIT").alias("credit"), value("BALANCE").alias("balance")
    )
