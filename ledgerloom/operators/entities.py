"""Words to visual lines and entities: folds whose state is more than the previous element, one page or statement at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.work import stored


def visual_lines(tokens: DataFrame) -> DataFrame:
    """Adds line_no: words by y centre belong to a line while they are within the tolerance of the RUNNING MEAN of its words
    (0.7 x median height, 3 to 30), which neither the first word nor the previous one can stand for. A fold in the JVM per page."""
    centre = (F.col("y0") + F.col("y1")) / 2.0
    pages = tokens.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct(centre.alias("yc"), "x0", "tok_idx"))).alias("t"), F.greatest(F.lit(3.0), F.least(F.lit(30.0), F.median(F.col("y1") - F.col("y0")) * 0.7)).alias("tol"))
    state = "struct<total:double,n:int,line:int,out:array<struct<tok_idx:int,line_no:int>>>"
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(-1).alias("line"), F.array().cast("array<struct<tok_idx:int,line_no:int>>").alias("out")).cast(state)

    def step(acc, t):
        new = (acc["n"] == 0) | (F.abs(t["yc"] - F.try_divide(acc["total"], acc["n"])) > F.col("tol"))
        line = F.when(new, acc["line"] + 1).otherwise(acc["line"])
        return F.struct(F.when(new, t["yc"]).otherwise(acc["total"] + t["yc"]).alias("total"), F.when(new, 1).otherwise(acc["n"] + 1).alias("n"), line.alias("line"), F.array_append(acc["out"], F.struct(t["tok_idx"].cast("int").alias("tok_idx"), line.alias("line_no"))).alias("out")).cast(state)

    lines = pages.select("doc_id", "page", F.explode(F.aggregate("t", start, step)["out"]).alias("o")).select("doc_id", "page", "o.tok_idx", "o.line_no")
    return tokens.join(lines, ["doc_id", "page", "tok_idx"])


def merge_entities(tokens: DataFrame, width: float = 10.0) -> DataFrame:
    """(doc_id, page, line_no, entity, text, x0, x1, tokens): neighbours on a line become one entity while the gap to the entity so
    far is from -2 to 2.5 character widths. Words of a line are numbered by running sums over gaps to the furthest right edge."""
    from pyspark.sql import Window

    by = Window.partitionBy("doc_id", "page", "line_no").orderBy("x0", "tok_idx")
    gap = F.col("x0") - F.max("x1").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = tokens.withColumn("new", F.coalesce((gap > 2.5 * width) | (gap < -2 * width), F.lit(True)).cast("int"))
    rows = rows.withColumn("entity", F.sum("new").over(by) - 1)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "tok_idx", "text"))), lambda t: t["text"]), " ")
    return rows.groupBy("doc_id", "page", "line_no", "entity").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count(F.lit(1)).alias("tokens"))


def match_rows(left: DataFrame, right: DataFrame, least: float = 0.6) -> DataFrame:
    """left, right (doc_id, row_idx, text) -> (doc_id, left_idx, right_idx, ratio): a one-to-one greedy match of each statement's rows by
    similarity of their texts (difflib's ratio; containment counts 0.8 at least), best first.

    Equal texts come first, the nth of a text with the nth, so a join finds them; only rows that it leaves in both readings are compared, greedily and so
    in sequence in a statement.
    """
    import pandas as pd
    from pyspark.sql import Window

    def match(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        pairs = []
        for i, x in zip(a["row_idx"], a["text"].str.lower()):
            for j, y in zip(b["row_idx"], b["text"].str.lower()):
                ratio = 1.0 if x == y else SequenceMatcher(None, x, y).ratio()
                if x and y and (x in y or y in x):
                    ratio = max(ratio, 0.8)
                if ratio > least:
                    pairs.append((-ratio, i, j))
        used_a, used_b, out = set(), set(), []
        for r, i, j in sorted(pairs):
            if i not in used_a and j not in used_b:
                used_a.add(i), used_b.add(j)
                out.append((key[0], i, j, -r))
        return pd.DataFrame(out, columns=["doc_id", "left_idx", "right_idx", "ratio"])

    nth = lambda name: F.row_number().over(Window.partitionBy("doc_id", "low").orderBy(f"{name}_idx"))
    sides = [t.where("text is not null").select("doc_id", F.col("row_idx").alias(f"{name}_idx"), F.lower("text").alias("low"), F.col("text").alias(name)).withColumn("nth", nth(name)) for t, name in ((left, "left"), (right, "right"))]
    both = stored(sides[0].join(sides[1], ["doc_id", "low", "nth"], "full"), "row-pairs")
    same = both.where("left_idx is not null and right_idx is not null")
    rest = [both.where(f"{other}_idx is null").select("doc_id", F.col(f"{name}_idx").alias("row_idx"), F.col(name).alias("text")) for name, other in (("left", "right"), ("right", "left"))]
    rest[0] = rest[0].join(rest[1].select("doc_id").distinct(), "doc_id", "left_semi")
    out = "doc_id long, left_idx int, right_idx int, ratio double"
    close = rest[0].withColumnRenamed("doc_id", "key").groupBy("key").cogroup(rest[1].join(rest[0].select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id")).applyInPandas(match, out)
    return same.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("left_idx").cast("int").alias("left_idx"), F.col("right_idx").cast("int").alias("right_idx"), F.lit(1.0).alias("ratio")).unionByName(close)


def reading_order(tokens: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Adds band and place: by y centre tokens belong to a band while they are within `ratio` of the median height (4 at least) of the running
    mean of its tokens; bands are read from left to right, one below the other."""
    from pyspark.sql import Window

    height, centre = F.col("y1") - F.col("y0"), (F.col("y0") + F.col("y1")) / 2.0
    tolerance = F.greatest(F.lit(4.0), F.coalesce(F.median(F.when(height > 0, height)), F.lit(12.0)) * ratio)
    pages = tokens.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct(centre.cast("double").alias("yc"), "tok_idx"))).alias("t"), tolerance.alias("tol"))
    each = "struct<tok_idx:int,band:int>"
    state = f"struct<total:double,n:int,band:int,out:array<{each}>>"
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(-1).alias("band"), F.array().cast(f"array<{each}>").alias("out")).cast(state)

    def step(acc, t):
        new = (acc["n"] == 0) | (F.abs(t["yc"] - F.try_divide(acc["total"], acc["n"])) > F.col("tol"))
        band = F.when(new, acc["band"] + 1).otherwise(acc["band"])
        own = F.struct(t["tok_idx"].cast("int").alias("tok_idx"), band.alias("band"))
        return F.struct(F.when(new, t["yc"]).otherwise(acc["total"] + t["yc"]).alias("total"), F.when(new, 1).otherwise(acc["n"] + 1).alias("n"), band.alias("band"), F.array_append(acc["out"], own).alias("out")).cast(state)

    bands = pages.select("doc_id", "page", F.explode(F.aggregate("t", start, step)["out"]).alias("o")).select("doc_id", "page", "o.tok_idx", "o.band")
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("band", "x0", centre, "tok_idx")) - 1
    return tokens.join(bands, ["doc_id", "page", "tok_idx"]).withColumn("place", place)


def logical_lines(tokens: DataFrame) -> DataFrame:
    """Tokens with line_no -> (doc_id, page, logical_no, text, lines, x0, x1, y0, y1): lines with the wrapped ones below them.

    A line goes on the row above if it is indented by over 20 from the page's margin, overlaps the row, is less than one and a half usual
    line steps below it, has no amount of its own, and has under five words or begins no further left. A row grows with what it takes, so
    a page's lines are folded in the JVM.
    """
    from pyspark.sql import Window

    amount = r"(?<!\d)\d{1,3}(?:,\d{2,3})*\.\d{2}(?!\d)"
    words = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "tok_idx", "text"))), lambda t: t["text"]), " ")
    lines = tokens.groupBy("doc_id", "page", "line_no").agg(words.alias("text"), F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.avg((F.col("y0") + F.col("y1")) / 2.0).alias("yc"))
    down = F.col("yc") - F.lag("yc").over(Window.partitionBy("doc_id", "page").orderBy("line_no"))
    lines = lines.withColumns({"down": F.when(down > 0, down), "priced": F.col("text").rlike(amount)})
    item = F.struct("line_no", "x0", "x1", "y0", "y1", "n", "priced", "text")
    pages = lines.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(item)).alias("lines"), F.min("x0").alias("margin"), F.when(F.count(F.lit(1)) > 1, F.median("down")).otherwise(15.0).alias("down"))
    each = "struct<text:string,lines:int,x0:double,x1:double,y0:double,y1:double>"
    state = f"struct<row:{each},out:array<{each}>>"
    start = F.struct(F.lit(None).cast(each).alias("row"), F.array().cast(f"array<{each}>").alias("out")).cast(state)

    def step(acc, line):
        row = acc["row"]
        close = F.coalesce(line["y0"] - row["y1"] < F.col("down") * 1.5, F.lit(False))
        beside = (line["x1"] >= row["x0"]) & (line["x0"] <= row["x1"])
        goes = F.coalesce((line["x0"] > F.col("margin") + 20.0) & beside & close & ~line["priced"] & ((line["n"] < 5) | (line["x0"] >= row["x0"])), F.lit(False))
        own = F.struct(line["text"].alias("text"), F.lit(1).alias("lines"), line["x0"].alias("x0"), line["x1"].alias("x1"), line["y0"].alias("y0"), line["y1"].alias("y1")).cast(each)
        grown = F.struct(F.concat(row["text"], F.lit(" "), line["text"]).alias("text"), (row["lines"] + 1).alias("lines"), F.least(row["x0"], line["x0"]).alias("x0"), F.greatest(row["x1"], line["x1"]).alias("x1"), row["y0"].alias("y0"), F.greatest(row["y1"], line["y1"]).alias("y1")).cast(each)
        out = F.when(goes | row.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], row))
        return F.struct(F.when(goes, grown).otherwise(own).alias("row"), out.alias("out")).cast(state)

    done = F.aggregate("lines", start, step, lambda acc: F.array_append(acc["out"], acc["row"]))
    return pages.select("doc_id", "page", F.posexplode(done).alias("logical_no", "r")).select("doc_id", "page", "logical_no", "r.*")
