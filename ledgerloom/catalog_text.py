"""Queries over statements as text lines, and independently written SQL for them; `catalog` takes them in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import signals
from ledgerloom.operators import confidence, detect, geometry, layout, ledger, reporting, textlines
from ledgerloom.plans import views
from ledgerloom.sources.work import stored


def lines(spark: SparkSession, d: str) -> DataFrame:
    return views.printed_statement(views.ledger(spark, d))


def columns(spark: SparkSession, d: str) -> DataFrame:
    return views.column_tokens(views.ledger(spark, d))


def flat(rows: DataFrame) -> DataFrame:
    numbers = F.array_join(F.transform("numbers", lambda n: n["cents"].cast("string")), " ")
    return rows.select("doc_id", "row_no", "page", "date", "narration", numbers.alias("numbers"), F.size("lines").alias("lines"), "payment")


# What the printed lines say, from the ledger itself: a row for each printed row, one more for each payment line.
PRINTED = """
p AS (SELECT *, CASE WHEN k % 5 = 0 THEN strftime(CAST(date AS DATE), '%d-%b-%Y') WHEN k % 5 = 1 THEN date ELSE strftime(CAST(date AS DATE), '%d/%m/%Y') END AS shown,
      list_filter([debit_c, credit_c, balance_c + 500000000], lambda x: x IS NOT NULL) AS nums FROM l WHERE debit_c IS NOT NULL OR credit_c IS NOT NULL OR balance_c IS NOT NULL),
printed AS (SELECT doc_id, row_idx * 2 AS ord, page, shown AS date, nums, false AS payment, narration || CASE WHEN k % 7 = 0 THEN ' wrapped under ' || k ELSE '' END AS narration,
      list_transform(nums, lambda x: format('{:,.2f}', x / 100.0)) AS texts, shown || '  ' || narration AS head, CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END AS lines FROM p
   UNION ALL SELECT doc_id, row_idx * 2 + 1, page, shown, [1234, 9999], true, 'UPI/CR/' || lpad(CAST(k AS VARCHAR), 9, '0') || '/HDFC rent', ['12.34', '99.99'], shown || ' UPI/CR/' || lpad(CAST(k AS VARCHAR), 9, '0') || '/HDFC rent', 1 FROM p WHERE k % 11 = 0),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS row_no FROM printed)"""
SOLVED = """
cells AS (SELECT r.*, unnest(nums) AS v, generate_subscripts(nums, 1) - 1 AS b, CASE doc_id % 3 WHEN 0 THEN 500000000 WHEN 1 THEN 7700 END AS seed FROM rows_ r),
moved AS (SELECT *, v - coalesce(lag(v) OVER (PARTITION BY doc_id, b ORDER BY row_no), seed) AS mv FROM cells),
cand AS (SELECT *, list_filter(range(len(nums)), lambda i: i <> b) AS oth FROM moved),
pick AS (SELECT *, CASE WHEN len(oth) = 0 THEN NULL WHEN mv IS NULL THEN CASE WHEN len(oth) = 1 THEN oth[1] END
         ELSE list_sort(list_transform(oth, lambda i: {'d': abs(nums[i + 1] - abs(mv)), 'i': i}))[1].i END AS pos FROM cand),
seen AS (SELECT *, nums[pos + 1] AS s, coalesce(abs(nums[pos + 1] - abs(mv)) <= 200 AND mv IS NOT NULL, false) AS ok, coalesce(abs(mv) <= 5, false) AS tiny,
         length(head) + list_sum(list_transform(range(list_filter(oth, lambda i: nums[i + 1] = nums[pos + 1])[1]), lambda j: length(texts[j + 1]) + CASE WHEN payment THEN 1 ELSE 2 END)) AS x0,
         list_filter(oth, lambda i: nums[i + 1] = nums[pos + 1])[1] AS fi FROM pick),
score AS (SELECT doc_id, b, count(*) FILTER (ok OR tiny) / greatest(1, count(*) - 1) * 0.97 AS sc FROM seen GROUP BY doc_id, b),
best AS (SELECT doc_id, b FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sc + CASE WHEN b = mb THEN 0.0009 ELSE 0 END DESC, b) AS rk
         FROM (SELECT *, max(b) OVER (PARTITION BY doc_id) AS mb FROM score)) WHERE rk = 1),
took AS (SELECT seen.*, mv IS NOT NULL AND NOT ok AND NOT tiny AS conflict, coalesce(x0, length(head)) + CASE WHEN payment THEN 1 ELSE 2 END AS x,
         CASE WHEN (ok OR mv IS NOT NULL AND NOT tiny) AND mv > 0 THEN s END AS cr, CASE WHEN (ok OR mv IS NOT NULL AND NOT tiny) AND mv <= 0 THEN s END AS dr FROM seen JOIN best USING (doc_id, b)),
means AS (SELECT *, avg(x) FILTER (NOT conflict AND dr IS NOT NULL) OVER (PARTITION BY doc_id) AS dx, avg(x) FILTER (NOT conflict AND cr IS NOT NULL) OVER (PARTITION BY doc_id) AS cx FROM took),
sided AS (SELECT *, CASE WHEN dr IS NULL AND cr IS NULL AND s IS NOT NULL THEN CASE WHEN coalesce(abs(x - dx) <= 15, false) <> coalesce(abs(x - cx) <= 15, false) THEN CASE WHEN coalesce(abs(x - dx) <= 15, false) THEN 'd' ELSE 'c' END
          WHEN payment THEN 'c' END END AS side FROM means)"""

# Pages with columns: what each row's tokens say.
BOXED = """
e AS (SELECT *, k % 5 = 0 AND (28 * (row_idx % 4 + 1) + 22.0) / max(28 * (row_idx % 4 + 1) + CASE WHEN k % 5 = 0 THEN 22 ELSE 8 END) OVER (PARTITION BY doc_id, page) <= 0.88 AS more FROM l),
g AS (SELECT doc_id, CAST(row_idx AS INTEGER) AS row_idx, page, k, more, strftime(CAST(date AS DATE), '%d/%m/%Y') AS date, CASE WHEN k % 23 = 0 THEN 'closing ' ELSE 'UPI ' END || CASE WHEN more THEN 'more ref' || k || ' Branch' ELSE 'ref' || k END AS narration,
      debit_c, credit_c, balance_c + 500000000 AS balance_c, CAST(3 + (debit_c IS NOT NULL)::INT + (credit_c IS NOT NULL)::INT + CASE WHEN balance_c IS NULL THEN 0 WHEN k % 7 = 0 THEN 2 ELSE 1 END + CASE WHEN more THEN 2 ELSE 0 END AS INTEGER) AS tokens FROM e)"""
DECIDED = """
h1 AS (SELECT *, CASE WHEN debit_c IS NULL AND credit_c IS NULL AND balance_c IS NULL THEN 'NO_TRANSACTION_SEED' WHEN debit_c IS NULL AND credit_c IS NULL THEN 'no_debit_or_credit' WHEN debit_c IS NOT NULL AND credit_c IS NOT NULL THEN 'both_debit_and_credit' END AS hard,
       k % 23 = 0 AS label, more AS contaminated, CASE WHEN doc_id % 3 = 0 THEN 500000000 END AS seed FROM g),
a1 AS (SELECT *, max(CASE WHEN hard IS NULL AND NOT label THEN row_idx END) OVER (PARTITION BY doc_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pr FROM h1),
s1 AS (SELECT a.*, CASE WHEN a.hard IS NULL AND a.label AND abs(CASE WHEN a.pr IS NULL THEN a.seed ELSE b.balance_c END + coalesce(a.credit_c, 0) - coalesce(a.debit_c, 0) - a.balance_c) > 150 THEN true ELSE a.hard IS NULL AND NOT a.label END AS acc
       FROM a1 a LEFT JOIN h1 b ON b.doc_id = a.doc_id AND b.row_idx = a.pr),
a2 AS (SELECT *, max(CASE WHEN acc THEN row_idx END) OVER (PARTITION BY doc_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pr2 FROM s1),
d AS (SELECT a.*, CASE WHEN a.hard IS NOT NULL OR a.balance_c IS NULL OR CASE WHEN a.pr2 IS NULL THEN a.seed ELSE b.balance_c END IS NULL THEN 'UNSEEDED'
      WHEN abs(CASE WHEN a.pr2 IS NULL THEN a.seed ELSE b.balance_c END + coalesce(a.credit_c, 0) - coalesce(a.debit_c, 0) - a.balance_c) <= 150 THEN 'PASS' ELSE 'FAIL' END AS state FROM a2 a LEFT JOIN h1 b ON b.doc_id = a.doc_id AND b.row_idx = a.pr2)"""

QUERIES = {
    "raw_rows": lambda spark, d: flat(textlines.raw_rows(textlines.preprocess(lines(spark, d)))),
    "text_transactions": lambda spark, d: textlines.text_transactions(lines(spark, d)).drop("page", "date", "narration"),
    "discovered_blocks": lambda spark, d: layout.discover_blocks(layout.row_boxes(layout.detect_rows(views.tokens(views.statement_lines(views.ledger(spark, d))).drop("x1", "line_idx")))),
    "line_kinds": lambda spark, d: textlines.classified(textlines.preprocess(lines(spark, d))).groupBy("doc_id", F.coalesce("kind", F.lit("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
    "line_seeds": lambda spark, d: textlines.seed_candidates(textlines.preprocess(lines(spark, d))),
    "row_hypotheses": lambda spark, d: lines(spark, d).select("doc_id", "line_no", signals.hypothesis_scores(F.col("text")).alias("s")).select("doc_id", "line_no", "s.*"),
    "row_likelihood": lambda spark, d: lines(spark, d).select("doc_id", "line_no", signals.row_score(F.col("text"), F.col("text").rlike(signals.DATE)).alias("score")),
    "statement_summaries": lambda spark, d: summary_texts(spark, d).select("o_orderkey", textlines.statement_summary(F.col("text")).alias("s")).select("o_orderkey", "s.*"),
    "cut_lines": lambda spark, d: textlines.preprocess(mashed(spark, d)),
    "header_fields": lambda spark, d: headers(spark, d).select("c_custkey", detect.canonical_field(F.col("header")).alias("field")),
    "geometry_rows": lambda spark, d: geometry.extract_blocks(columns(spark, d)).drop("anchor", "block"),
    "geometry_decisions": lambda spark, d: decisions(stored(layout.detect_rows(columns(spark, d)), "rows")),
    "page_seeds": lambda spark, d: geometry.page_seeds(layout.row_boxes(layout.detect_rows(columns(spark, d).drop("x1")))),
    "layer_funnel": lambda spark, d: funnel(columns(spark, d)),
    "reject_classes": lambda spark, d: rejects(views.ledger(spark, d)),
    "expected_confidence": lambda spark, d: expected_confidence(views.ledger(spark, d)),
    "page_text_scores": lambda spark, d: page_texts(spark, d).select("o_orderkey", signals.text_score(F.col("text")).alias("score")),
}


def decisions(rows: DataFrame) -> DataFrame:
    return geometry.decided(geometry.row_cells(rows), geometry.page_seeds(layout.row_boxes(rows)))


def funnel(tokens: DataFrame) -> DataFrame:
    rows = stored(layout.detect_rows(tokens), "rows")
    return reporting.layer_funnel(rows.drop("row_no"), layout.row_boxes(rows), decisions(rows))


def rejects(t: DataFrame) -> DataFrame:
    """Every ledger row classed as if it had been lost, with what a parser may say of it."""
    said = F.when(F.col("k") % 31 == 0, "date_in_numeric_zone").when(F.col("k") % 37 == 0, "Continuity gap").when(F.col("k") % 43 == 0, "Column DEBIT not found").when(F.col("k") % 47 == 0, "failed to reconcile")
    date = F.when(F.col("k") % 59 != 0, F.col("date"))
    rows = t.join(ledger.qualify(t).select("doc_id", "row_idx", "conservation"), ["doc_id", "row_idx"])
    return rows.select("doc_id", "row_idx", reporting.reject_class(date, F.col("debit_c"), F.col("credit_c"), F.col("balance_c"), said, F.col("conservation")).alias("r")).select("doc_id", "row_idx", "r.*")


def expected_confidence(t: DataFrame) -> DataFrame:
    expected = t.groupBy("doc_id").agg((F.count(F.lit(1)) + F.col("doc_id") % 5).alias("expected"))
    return confidence.statement_confidence(t, expected)


def summary_texts(spark: SparkSession, d: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.format_number("o_totalprice", 2)
    text = F.concat_ws("\n", F.when(k % 2 == 0, F.concat(F.lit("No. of Debits: "), k % 97)), F.when(k % 3 == 0, F.concat(F.lit("CR Count  "), k % 89)), F.when(k % 5 == 0, F.concat(F.lit("TOTAL DEBIT Rs "), price)), F.when(k % 7 == 0, F.concat(F.lit("Total  Credit\n"), price)), F.lit("end"))
    return views.table(spark, d, "orders").select("o_orderkey", text.alias("text"))


def mashed(spark: SparkSession, d: str) -> DataFrame:
    """Lines that a scanner ran together: two dated rows and padding; without amounts for some, short for others, with dots for commas."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "dd/MM/yyyy")
    pad = F.when(k % 3 == 0, "").otherwise(F.lit("x " * 110))
    amount = F.when(k % 2 == 0, F.lit("728.662.39")).otherwise("none")
    return views.table(spark, d, "orders").select(k.alias("doc_id"), F.lit(0).alias("line_no"), F.concat(F.lit("head "), day, F.lit(" rent "), amount, F.lit(" "), pad, day, F.lit(" pay "), amount).alias("text"))


def headers(spark: SparkSession, d: str) -> DataFrame:
    """Header words as banks print them: exact, within longer text, of several fields, or of none."""
    words = ["Txn Date", "Value Date ", "Closing Bal", "Narration/Details", "Chq No", "Withdrawal (Dr)", "Deposit Amt", "Cr", "BAL", "Remarks", "", "Ref.No", "Total Debit", "Branch Code"]
    return views.table(spark, d, "customer").select("c_custkey", F.get(F.array(*[F.lit(w) for w in words]), (F.col("c_custkey") % len(words)).cast("int")).alias("header"))


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of pages: rows, one long line, long lines, blank."""
    k = F.col("o_orderkey")
    row = F.concat(F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" paid the rent 1,200.50\n2 words\n\n  \nOn "), F.date_format("o_orderdate", "dd-MMM-yyyy"), F.lit(" again"))
    text = F.when(k % 5 == 0, F.lit("y" * 201)).when(k % 5 == 1, F.lit("z " * 160 + "\n" + "w" * 290)).when(k % 5 == 2, F.lit(" \n")).otherwise(row)
    return views.table(spark, d, "orders").select("o_orderkey", text.alias("text"))


def oracles(ledger_sql: str, page_lines: str, qualified: str) -> dict[str, str]:
    """The ledger view, the lines of its pages and the qualified rows in SQL, as common table expressions."""
    printed, solved = f"WITH {ledger_sql}, {PRINTED} ", f"WITH {ledger_sql}, {PRINTED}, {SOLVED} "
    counted = "SELECT doc_id, '{}' AS kind, count(*) AS n FROM {} WHERE {} GROUP BY doc_id"
    kinds = {"page": "row_idx % 4 = 0", "seed": "row_idx = 0 AND doc_id % 3 < 2", "footer": "k % 13 = 0", "skip": "k % 19 = 0"}
    text = "SELECT doc_id, 'text' AS kind, CAST(sum(CASE WHEN row_idx % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(debit_c, credit_c, balance_c) IS NULL THEN 0 ELSE 1 + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END END) AS BIGINT) AS n FROM l GROUP BY doc_id"
    flag = lambda pattern, n: f"CASE WHEN regexp_matches(text, '{pattern}') THEN {n} ELSE 0 END"
    texts = f"""WITH {ledger_sql}, {PRINTED}, s AS (SELECT l.*, p.shown, p.nums FROM l LEFT JOIN p USING (doc_id, row_idx)),
        lines_ AS (SELECT doc_id, CAST(row_idx * 10 AS INTEGER) AS line_no, 'PAGE ' || page AS text FROM s WHERE row_idx % 4 = 0 UNION ALL SELECT doc_id, row_idx * 10 + 1, 'Date Narration Withdrawal Deposit Balance' FROM s WHERE row_idx % 4 = 0
        UNION ALL SELECT doc_id, row_idx * 10 + 2, CASE doc_id % 3 WHEN 0 THEN 'Opening Balance 5,000,000.00' ELSE 'Balance as on 01-02-1990 77.00' END FROM s WHERE row_idx = 0 AND doc_id % 3 < 2
        UNION ALL SELECT doc_id, row_idx * 10 + 3, shown || '  ' || narration || '  ' || array_to_string(list_transform(nums, lambda x: format('{{:,.2f}}', x / 100.0)), '  ') FROM s WHERE nums IS NOT NULL
        UNION ALL SELECT doc_id, row_idx * 10 + 4, '   wrapped under ' || k FROM s WHERE nums IS NOT NULL AND k % 7 = 0 UNION ALL SELECT doc_id, row_idx * 10 + 5, 'UPI/CR/' || lpad(CAST(k AS VARCHAR), 9, '0') || '/HDFC rent 12.34 99.99' FROM s WHERE nums IS NOT NULL AND k % 11 = 0
        UNION ALL SELECT doc_id, row_idx * 10 + 6, '*** End of statement ***' FROM s WHERE nums IS NOT NULL AND k % 13 = 0 UNION ALL SELECT doc_id, row_idx * 10 + 7, 'Grand Total 1,234.00' FROM s WHERE nums IS NOT NULL AND k % 19 = 0 UNION ALL SELECT doc_id, row_idx * 10 + 8, 'stray text' FROM s WHERE nums IS NOT NULL AND k % 19 = 0)"""
    amounts = r"len(regexp_extract_all(text, '\b\d{1,3}(?:,\d{2,3})*\.\d{2}\b'))"
    money = f"len(list_filter(regexp_extract_all(text, '{signals.MONEY}'), lambda m: NOT (regexp_full_match(m, '\\d{{4}}') AND TRY_CAST(m AS INTEGER) BETWEEN 1990 AND 2100)))"
    long_number = r"\b\d{10,}\b"
    low = lambda pattern, n: f"CASE WHEN regexp_matches(lower(text), '{pattern}') THEN {n} ELSE 0 END"
    points = f"{flag(signals.DISCOVERY_DATE, 5)} + CASE WHEN {money} > 1 THEN 8 WHEN {money} = 1 THEN 4 ELSE 0 END + {flag(signals.NARRATION_WORD, 3)} + {flag(long_number, 2)} + {flag(signals.HEADER_WORD, -10)} + {flag(signals.ACCOUNT_WORD, -10)} + {flag(signals.PERIOD, -15)}"
    return {
        "raw_rows": printed + "SELECT doc_id, CAST(row_no AS INTEGER) AS row_no, page, date, narration, array_to_string(nums, ' ') AS numbers, CAST(lines AS INTEGER) AS lines, payment FROM rows_",
        "text_transactions": solved + """SELECT doc_id, CAST(row_no AS INTEGER) AS row_no, CASE WHEN side = 'd' THEN s ELSE dr END AS debit_c, CASE WHEN side = 'c' THEN s ELSE cr END AS credit_c, v AS balance_c, s AS seen_c, conflict, CAST(b AS INTEGER) AS balance_column,
            CAST(CASE WHEN length(narration) < 15 THEN 60 ELSE 100 END AS INTEGER) AS completeness FROM sided""",
        "line_kinds": printed + " UNION ALL ".join([counted.format(n, "l" if n in ("page", "seed") else "p", w) for n, w in kinds.items()] + [text]),
        "line_seeds": printed + "SELECT doc_id, 1 AS ord, CASE doc_id % 3 WHEN 0 THEN 'opening' ELSE 'balance_as_on' END AS source, CASE doc_id % 3 WHEN 0 THEN 100 ELSE 0 END AS score, CAST(CASE doc_id % 3 WHEN 0 THEN 500000000 ELSE 7700 END AS BIGINT) AS value_c, CASE doc_id % 3 WHEN 1 THEN '1990-02-01' END AS day FROM l WHERE row_idx = 0 AND doc_id % 3 < 2",
        "row_likelihood": texts + f"SELECT doc_id, line_no, {flag(signals.DATE, 5)} + CASE WHEN {amounts} > 1 THEN 8 WHEN {amounts} = 1 THEN 4 ELSE 0 END + {low(signals.ROW_CHANNEL, 3)} + CASE WHEN regexp_matches(text, '\\b\\d{{10,20}}\\b') OR regexp_matches(text, '\\b[A-Z0-9]{{10,15}}\\b') THEN 2 ELSE 0 END + {low(signals.ROW_SUMMARY, -10)} + {low(signals.ROW_ACCOUNT, -10)} AS score FROM lines_",
        "row_hypotheses": texts + f"""SELECT doc_id, line_no, {points} AS "transaction",
            {flag(signals.HEADER_WORD, 10)} AS header, {flag(signals.ACCOUNT_WORD, 10)} + {flag(signals.PERIOD, 10)} AS account FROM lines_""",
        "discovered_blocks": f"""WITH {ledger_sql}, {page_lines}, one AS (SELECT l.doc_id, l.page, l.row_idx + 1 + l.page AS block, CASE WHEN row_idx % 4 >= 2 AND row_idx = max(row_idx) OVER (PARTITION BY l.doc_id, l.page) THEN 2 ELSE 1 END AS rows,
            regexp_replace(text, '\\s+', ' ', 'g') || CASE WHEN row_idx % 4 >= 2 AND row_idx = max(row_idx) OVER (PARTITION BY l.doc_id, l.page) THEN ' Statement of Account Page ' || l.page ELSE '' END AS text FROM l JOIN lines ON lines.doc_id = l.doc_id AND lines.page = l.page AND line_idx = row_idx % 4 + 1),
            scored AS (SELECT *, {points} AS score, {flag(signals.HEADER_WORD, 10)} AS header, {flag(signals.ACCOUNT_WORD, 10)} + {flag(signals.PERIOD, 10)} AS account FROM one)
            SELECT doc_id, block, page, rows, text, score FROM scored WHERE score >= 8 AND score > header AND score > account""",
        "layer_funnel": f"""WITH {ledger_sql}, {BOXED}, {DECIDED}, c AS (SELECT doc_id, sum(3 + (debit_c IS NOT NULL)::INT + (credit_c IS NOT NULL)::INT + CASE WHEN balance_c IS NULL THEN 0 WHEN k % 7 = 0 THEN 2 ELSE 1 END + CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END + CASE WHEN row_idx % 4 = 0 THEN 5 ELSE 0 END
            + CASE WHEN row_idx = 0 AND doc_id % 3 = 0 THEN 3 ELSE 0 END) AS t, sum(1 + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN row_idx % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN row_idx = 0 AND doc_id % 3 = 0 THEN 1 ELSE 0 END) AS r FROM l GROUP BY doc_id),
            o AS (SELECT doc_id, count(*) FILTER (hard IS NULL AND (state = 'FAIL' OR NOT label)) AS e, count(*) AS n FROM d GROUP BY doc_id)
            SELECT doc_id, 'OCR Tokens' AS layer, CAST(t AS BIGINT) AS count, CAST(0 AS BIGINT) AS dropped FROM c UNION ALL SELECT doc_id, 'Rows Built', CAST(r AS BIGINT), CAST(t - r AS BIGINT) FROM c UNION ALL SELECT doc_id, 'Rows Parsed', CAST(r AS BIGINT), 0 FROM c UNION ALL SELECT doc_id, 'Transactions Emitted', e, n - e FROM o""",
        "reject_classes": f"""WITH {ledger_sql}, {qualified}, z AS (SELECT l.*, CASE WHEN k % 31 = 0 THEN 1 WHEN k % 37 = 0 THEN 2 WHEN k % 43 = 0 THEN 3 WHEN k % 47 = 0 THEN 4 ELSE 0 END AS said, conservation FROM l JOIN q USING (doc_id, row_idx)),
            y AS (SELECT doc_id, row_idx, CASE WHEN k % 59 = 0 THEN 1 WHEN said = 1 THEN 2 WHEN balance_c IS NULL THEN 3 WHEN debit_c IS NULL AND credit_c IS NULL THEN 4 WHEN debit_c IS NOT NULL AND credit_c IS NOT NULL THEN 5 WHEN conservation = 'FAIL' OR said = 4 THEN 6 WHEN said = 2 THEN 7 WHEN said = 3 THEN 8 ELSE 9 END AS i FROM z)
            SELECT doc_id, row_idx, ['MISSING_DATE', 'DATE_IN_NUMERIC_ZONE', 'MISSING_BALANCE', 'MISSING_AMOUNT', 'DUAL_AMOUNT', 'FAILED_RECONCILIATION', 'FAILED_CONTINUITY', 'COLUMN_NOT_FOUND', 'UNKNOWN'][i] AS "primary",
            ['DECLARATIVE_PARSER', 'COLUMN_DETECTOR', 'DECLARATIVE_PARSER', 'DECLARATIVE_PARSER', 'CANDIDATE_SELECTOR', 'VALIDATION_ENGINE', 'VALIDATION_ENGINE', 'COLUMN_DETECTOR', 'DECLARATIVE_PARSER'][i] AS layer, CAST([0.95, 0.92, 0.95, 0.9, 0.9, 0.92, 0.9, 0.85, 0.4][i] AS DOUBLE) AS confidence FROM y""",
        "statement_summaries": """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 97 AS INTEGER) END AS dr_count, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 89 AS INTEGER) END AS cr_count,
            CASE WHEN o_orderkey % 5 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS total_debit_c, CASE WHEN o_orderkey % 7 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS total_credit_c FROM orders""",
        "cut_lines": """WITH t AS (SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%d/%m/%Y') AS day, CASE WHEN o_orderkey % 2 = 0 THEN '728,662.39' ELSE 'none' END AS a, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE repeat('x ', 110) END AS pad FROM orders)
            SELECT doc_id, 0 AS line_no, 0 AS part, CASE WHEN a <> 'none' AND pad <> '' THEN 'head' ELSE 'head ' || day || ' rent ' || a || ' ' || pad || day || ' pay ' || a END AS text FROM t
            UNION ALL SELECT doc_id, 0, 1, trim(day || ' rent ' || a || ' ' || pad) FROM t WHERE a <> 'none' AND pad <> '' UNION ALL SELECT doc_id, 0, 2, day || ' pay ' || a FROM t WHERE a <> 'none' AND pad <> ''""",
        "header_fields": "SELECT c_custkey, ['DATE', 'VALUE_DATE', 'BALANCE', 'NARRATION', 'CHEQUE', 'DEBIT', 'CREDIT', 'CREDIT', 'BALANCE', NULL, NULL, 'REFERENCE', 'DEBIT', NULL][c_custkey % 14 + 1] AS field FROM customer",
        "geometry_rows": f"WITH {ledger_sql}, {BOXED} SELECT doc_id, row_idx, page, date, narration, debit_c, credit_c, balance_c, tokens FROM g",
        "geometry_decisions": f"WITH {ledger_sql}, {BOXED}, {DECIDED} SELECT doc_id, row_idx, reason IN ('ok', 'conservation_conflict') AS accepted, reason, state AS conservation, contaminated, balance_c IS NULL AS balance_missing FROM (SELECT *, CASE WHEN hard IS NOT NULL THEN hard WHEN state = 'FAIL' THEN 'conservation_conflict' WHEN label THEN 'structural_label' ELSE 'ok' END AS reason FROM d)",
        "page_seeds": f"WITH {ledger_sql} SELECT DISTINCT doc_id, 1 AS page, CAST(500000000 AS BIGINT) AS seed_c FROM l WHERE doc_id % 3 = 0",
        "page_text_scores": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN -1000.0 WHEN 1 THEN -500.0 WHEN 2 THEN 0.0 ELSE 2 * 10.0 + 5.0 + 2 * 2.0 + 3 * 0.5 END AS score FROM orders",
    }
