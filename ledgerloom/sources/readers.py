"""Sources and sinks: token, line and statement files in; results, traces and run logs out. All schemas are explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TOKENS = "doc_id STRING, page INT, tok_idx INT, text STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, source STRING, confidence DOUBLE, protected BOOLEAN"
STATEMENT = "date STRING, narration STRING, debit STRING, credit STRING, balance STRING"
LAYOUT = "pages ARRAY<STRUCT<page_idx: INT, blocks: ARRAY<STRUCT<lines: ARRAY<STRUCT<spans: ARRAY<STRUCT<text: STRING, bbox: ARRAY<DOUBLE>>>>>>>>>"
RUNS = "pdf_path STRING, bank STRING, parser STRING, txns_count INT, debit_total DOUBLE, credit_total DOUBLE, closing_balance DOUBLE, merge_ratio DOUBLE, rows_before INT, rows_after INT, fallback_used BOOLEAN, status STRING, notes STRING, created_at TIMESTAMP"


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Token tables as JSON lines; a row that breaks the schema fails the read."""
    return spark.read.schema(TOKENS).json(path, mode="FAILFAST")


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """CSV statements with a header, as a ledger in cents; doc_id is the file's path and row_idx its order in the file."""
    from ledgerloom.functions.dates import normalize_date
    from ledgerloom.functions.money import parse_amount, to_cents

    rows = spark.read.schema(STATEMENT).csv(path, header=True)
    rows = rows.select("*", F.col("_metadata.file_path").alias("doc_id"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("place"))
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) - 1
    money = [to_cents(parse_amount(F.col(c))).alias(f"{c}_c") for c in ("debit", "credit", "balance")]
    return rows.select("doc_id", number.alias("row_idx"), F.lit(1).alias("page"), normalize_date(F.col("date")).alias("date"), "narration", *money)


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """Layout JSON to tokens; its pages count from 0, tokens' from 1."""
    doc = spark.read.schema(LAYOUT).option("multiLine", True).json(path).withColumn("doc_id", F.input_file_name())
    page = doc.select("doc_id", F.explode("pages").alias("p")).select("doc_id", (F.col("p.page_idx") + 1).alias("page"), F.flatten(F.transform("p.blocks", lambda b: F.flatten(F.transform(b["lines"], lambda x: x["spans"])))).alias("spans"))
    span = page.select("doc_id", "page", F.posexplode("spans").alias("tok_idx", "s"))
    return span.select("doc_id", "page", "tok_idx", F.col("s.text").alias("text"), *[F.get("s.bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


def table_cells(html: DataFrame) -> DataFrame:
    """html(doc_id, page, html) -> (doc_id, page, row, cell, text, x0, y0, x1, y1): cells of tables on a grid of 150 by 30,
    a cell as wide as its columns; a cell's place counts the columns of the cells before it in its row."""
    rows = html.select("doc_id", "page", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)).alias("row", "tr"))
    cell = F.regexp_extract_all("tr", F.lit(r"(?is)(<t[dh]\b[^>]*>.*?)</t[dh]>"), 1)
    cells = rows.select("doc_id", "page", "row", F.posexplode(cell).alias("cell", "td"))
    span = lambda c: F.coalesce(F.regexp_extract("td", rf'(?i){c}="?(\d+)', 1).try_cast("int"), F.lit(1))
    from pyspark.sql import Window

    left = Window.partitionBy("doc_id", "page", "row").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("doc_id", "page", "row", "cell", F.trim(F.regexp_replace("td", r"<[^>]*>", "")).alias("text"), span("colspan").alias("cols"), span("rowspan").alias("down"))
    x = F.coalesce(F.sum("cols").over(left), F.lit(0)) * 150
    return cells.select("doc_id", "page", "row", "cell", "text", x.alias("x0"), (F.col("row") * 30).alias("y0"), (x + 140 * F.col("cols")).alias("x1"), (F.col("row") * 30 + 20 * F.col("down")).alias("y1"))


def split_pages(texts: DataFrame) -> DataFrame:
    """texts(doc_id, text) -> (doc_id, page, text): pages between runs of 80 `=`; blank ones and bare page numbers go, and a
    text without any other page is one page."""
    parts = F.filter(F.split("text", "={80,}"), lambda p: (F.trim(p) != "") & ~p.rlike(r"(?i)^\s*PAGE\s+\d+\s*$"))
    pages = F.when(F.size(parts) > 0, parts).otherwise(F.array("text"))
    return texts.select("doc_id", F.posexplode(pages).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page"), "text")


def document_types(tokens: DataFrame) -> DataFrame:
    """Per document: digital if its first three pages have 30 words on average, else scanned."""
    pages = tokens.where("page <= 3").groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))
    mean = pages.groupBy("doc_id").agg(F.avg("n").alias("words"))
    return mean.withColumn("type", F.when(F.col("words") >= 30, "digital").otherwise("scanned"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) of the files under a path."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"))


def to_json_text(txns: DataFrame) -> DataFrame:
    """(doc_id, transactions): a statement's rows as one JSON array, in their order."""
    rows = F.sort_array(F.collect_list(F.struct("row_idx", F.to_json(F.struct(*[c for c in txns.columns if c != "doc_id"])).alias("j"))))
    return txns.groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["j"]), ","), F.lit("]")).alias("transactions"))


def log_traces(events: DataFrame, path: str) -> None:
    """Appends events(trace_type, ...) as JSON, a folder for each type."""
    events.write.mode("append").partitionBy("trace_type").json(path)


def log_runs(runs: DataFrame, path: str) -> None:
    """Appends benchmark runs to their table, with the columns of RUNS; others are left out and missing ones are null."""
    fields = StructType.fromDDL(RUNS).fields
    runs = runs.select(*[F.col(f.name).cast(f.dataType) if f.name in runs.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    runs.write.mode("append").parquet(path)


def lifecycle(events: DataFrame) -> DataFrame:
    """events(job_id, event, ts) -> the last stamp of each event, and the timeline in order."""
    last = events.groupBy("job_id", "event").agg(F.max("ts").alias("ts"))
    line = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event"))), lambda e: e["event"])
    return last.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("event", "ts"))).alias("stamps"), line.alias("timeline"))
