"""Scanned pages, card statements and cells made from the sample tables, in SQL that Spark and DuckDB read alike: queries run it on
the tables, and oracles take it in as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("orders", "lineitem", "customer", "documents")


def money(x: str) -> str:
    """Cents as printed, with commas between groups of three."""
    w = f"CAST(CAST(floor(({x}) / 100.0) AS bigint) AS string)"
    grouped = f"CASE WHEN length({w}) > 6 THEN substr({w}, 1, length({w}) - 6) || ',' || substr({w}, length({w}) - 5, 3) || ',' || substr({w}, length({w}) - 2, 3) WHEN length({w}) > 3 THEN substr({w}, 1, length({w}) - 3) || ',' || substr({w}, length({w}) - 2, 3) ELSE {w} END"
    return f"({grouped}) || '.' || lpad(CAST(({x}) % 100 AS string), 2, '0')"


#: Rows of an account: (doc_id, k, i, day, dmy, a, credit, bal), balances high enough never to be negative.
ROWS = """
rows0 AS (SELECT o_custkey AS doc_id, o_orderkey AS k, substr(CAST(o_orderdate AS string), 1, 10) AS day, CAST(round(o_totalprice * 100) AS bigint) % 5000000 + 100 AS a, o_orderkey % 3 <> 0 AS credit,
          CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS int) AS i FROM orders),
acct AS (SELECT *, substr(day, 9, 2) || '/' || substr(day, 6, 2) || '/' || substr(day, 1, 4) AS dmy, CAST(floor(i / 4.0) AS int) + 1 AS page,
         900000000 + CAST(sum(CASE WHEN credit THEN a ELSE -a END) OVER (PARTITION BY doc_id ORDER BY i) AS bigint) AS bal FROM rows0)"""

_HEADERS = {
    0: [(30, "Date", 20), (30, "Particulars", 100), (30, "Chq", 240), (30, "Withdrawal", 300), (30, "Deposit", 400), (30, "Balance", 500)],
    1: [(30, "Txn", 20), (30, "Narration", 100), (30, "Debit", 300), (30, "Credit", 400), (44, "Date", 24), (44, "Amount", 300), (44, "Amount", 400), (44, "Balance", 500)],
    2: [(2, "Date", 10), (2, "Description", 200), (2, "Debit", 250), (2, "Credit", 350), (2, "Balance", 450), (16, "1", 10), (60, "Date", 20), (60, "Particulars", 100), (60, "Withdrawals", 300), (60, "Deposits", 400), (60, "Bal.", 500)],
    3: [(30, "Date", 20), (30, "Value Date", 70), (30, "Details", 160), (30, "Withdrawal(Dr)/Deposit(Cr)", 300), (30, "Balance", 500), (30, "Dr/Cr", 560)],
    4: [(30, "Date", 20), (30, "Narration", 100), (30, "Debit", 300), (30, "Credit", 400)],
    5: [(30, "DATE", 20), (30, "NARRATION", 100), (30, "DEBIT", 300), (30, "CREDIT", 400), (30, "BALANCE", 500)],
}
_HEAD = ", ".join(f"({v}, {y}, {n}, '{t}', {x})" for v, words in _HEADERS.items() for n, (y, t, x) in enumerate(words))
#: Page tokens. A sixth of the statements each: one header row, two rows, a summary before the table, merged sides, no
#: balance column, sides in each other's columns. Dates are misread or run on for some rows; some rows go on below.
TOKENS = f"""
head AS (SELECT * FROM (VALUES {_HEAD}) AS h(v, y, n, t, x)),
cells AS (
    SELECT doc_id, 1 AS page, n AS tok_idx, t AS text, x AS x0, y AS y0 FROM (SELECT DISTINCT doc_id FROM acct) d JOIN head ON v = doc_id % 6
    UNION ALL SELECT doc_id, page, i * 10 + 100, CASE WHEN k % 11 = 0 THEN 'J' || substr(dmy, 1, 2) || '-' || substr(dmy, 4, 2) || '-' || substr(dmy, 7, 4) WHEN k % 11 = 1 THEN replace(dmy, '/', ':') WHEN k % 11 = 2 THEN replace(substr(dmy, 1, 5), '0', 'O') || substr(dmy, 6, 5)
        WHEN k % 11 = 3 THEN substr(dmy, 1, 6) || substr(dmy, 9, 2) || 'NEFT' ELSE dmy END, CASE WHEN k % 13 = 0 THEN 60 ELSE 20 END, 80 + 28 * (i % 4) FROM acct
    UNION ALL SELECT doc_id, page, i * 10 + 101, 'UPI/' || CASE WHEN credit THEN 'CR' ELSE 'DR' END || '/' || CAST(k AS string) || '/x', 110, 80 + 28 * (i % 4) FROM acct
    UNION ALL SELECT doc_id, page, i * 10 + 102, {money("a")}, CASE WHEN credit = (doc_id % 6 = 5) THEN 300 ELSE 400 END, 80 + 28 * (i % 4) FROM acct
    UNION ALL SELECT doc_id, page, i * 10 + 103, {money("bal")}, 500, 80 + 28 * (i % 4) FROM acct
    UNION ALL SELECT doc_id, page, i * 10 + 104, 'more', 110, 94 + 28 * (i % 4) FROM acct WHERE k % 5 = 0
    UNION ALL SELECT doc_id, page, i * 10 + 105, 'Branch', 150, 94 + 28 * (i % 4) FROM acct WHERE k % 10 = 0),
tok AS (SELECT doc_id, page, tok_idx, text, x0, x0 + 6 * CAST(length(text) AS int) AS x1, y0, y0 + 8 AS y1 FROM cells)"""

#: Tokens of card statements: amounts with CR or DR at their end, behind them, in columns, or bare on the right; sections
#: that end the rows and a table that opens again after them; rows without a date or an amount; statements with and without headers.
CARDS = f"""
lines0 AS (SELECT *, 40 + 28 * (i % 6) AS y, CAST(floor(i / 6.0) AS int) + 1 AS pg, k % 8 AS kind FROM acct),
cells AS (
    SELECT DISTINCT doc_id, 1 AS page, n AS tok_idx, t AS text, x AS x0, 10 AS y0 FROM acct JOIN (VALUES (0, 'Date', 20), (1, 'Details', 100), (2, 'Debit', 300), (3, 'Credit', 380), (4, 'Balance', 460)) AS h(n, t, x) ON doc_id % 2 = 0
    UNION ALL SELECT doc_id, pg, i * 10 + 100, CASE WHEN k % 9 = 0 THEN substr(dmy, 1, 2) || ' Mar ' || substr(dmy, 7, 4) WHEN k % 17 = 0 THEN 'pending' ELSE dmy END, 20, y FROM lines0
    UNION ALL SELECT doc_id, pg, i * 10 + 101, CASE WHEN k % 23 = 0 THEN 'Reward Summary' ELSE 'SHOP' END, 100, y FROM lines0
    UNION ALL SELECT doc_id, pg, i * 10 + 102, 'no' || CAST(k AS string), 170, y FROM lines0
    UNION ALL SELECT doc_id, pg, i * 10 + 103, CASE WHEN kind = 0 THEN {money("a")} || 'CR' WHEN kind = 1 THEN {money("a")} || ' Dr' ELSE {money("a")} END, CASE WHEN kind = 2 THEN 380 WHEN kind = 3 THEN 200 ELSE 305 END, y FROM lines0 WHERE kind <> 7
    UNION ALL SELECT doc_id, pg, i * 10 + 104, CASE WHEN kind = 4 THEN 'CR' ELSE 'dr' END, 440, y FROM lines0 WHERE kind IN (4, 5)
    UNION ALL SELECT doc_id, pg, i * 10 + 105, CASE WHEN k % 4 = 0 THEN 'Insurance' ELSE 'EMI offer' END, 100, y + 14 FROM lines0 WHERE k % 5 = 0
    UNION ALL SELECT doc_id, pg, i * 10 + 106, '77.00', 320, y + 14 FROM lines0 WHERE k % 5 = 0),
tok AS (SELECT doc_id, page, tok_idx, text, x0, x0 + 6 * CAST(length(text) AS int) AS x1, y0, y0 + 8 AS y1 FROM cells)"""

#: Blocks with their cells: labels come singly and in succession, some pages have seeds, some balances or sides are missing.
BLOCKS = """
blocks AS (SELECT doc_id, i AS row_idx, page, CASE WHEN k % 37 <> 0 THEN day END AS date, CASE WHEN k % 7 = 0 THEN 'Branch note' ELSE 'UPI' END AS narration, CASE WHEN NOT credit OR k % 41 = 0 THEN a END AS debit_c, CASE WHEN credit AND k % 43 <> 0 THEN a END AS credit_c,
           CASE WHEN k % 19 <> 0 THEN bal + CASE WHEN k % 5 = 0 THEN 70000 ELSE 0 END END AS balance_c, CASE WHEN k % 4 < 2 THEN 'closing x' ELSE 'upi' END AS anchor FROM acct),
seeds AS (SELECT DISTINCT doc_id, page, CAST(900000000 AS bigint) AS seed_c FROM acct WHERE (doc_id + page) % 3 = 0)"""

#: Words of pages 1000 wide: the page tokens, words at the side of some statements, and references below rows where nothing stands above.
WORDS = """
wd AS (SELECT * FROM tok UNION ALL SELECT doc_id, page, i * 10 + 107, 'Visit', 900, 930, 80 + 28 * (i % 4), 88 + 28 * (i % 4) FROM acct WHERE doc_id % 4 = 1 AND k % 3 = 0
       UNION ALL SELECT doc_id, page, i * 10 + 108, 'ref9', 230, 254, 94 + 28 * (i % 4), 102 + 28 * (i % 4) FROM acct WHERE k % 6 < 2 UNION ALL SELECT doc_id, page, i * 10 + 109, 'TOTAL', 600, 630, 94 + 28 * (i % 4), 102 + 28 * (i % 4) FROM acct WHERE k % 12 = 0),
words AS (SELECT *, 1000 AS width FROM wd)"""
#: Words a little up or down of their line.
SHAKEN = """
shaken AS (SELECT doc_id, page, tok_idx, text, x0, x1, y0 + tok_idx % 3 AS y0, y0 + tok_idx % 3 + 8 AS y1, y0 AS line FROM tok)"""
#: Tokens with a confidence, those of a line close together: amounts with marks and currencies beside them, words a little up or down.
CLOSE = """
close AS (SELECT doc_id, page, tok_idx, text, CAST(x0 AS double) AS x0, CAST(x1 AS double) AS x1, CAST(y0 AS double) AS y0, CAST(y1 AS double) AS y1, CAST((tok_idx % 7 + 3) / 10.0 AS double) AS confidence FROM tok
          UNION ALL SELECT doc_id, page, i * 10 + 106, CASE WHEN credit THEN 'CR' ELSE 'Dr' END, 560.0 + k % 30, 575.0 + k % 30, 81.0 + 28 * (i % 4) + k % 5, 89.0 + 28 * (i % 4) + k % 5, 0.5 FROM acct WHERE k % 3 < 2
          UNION ALL SELECT doc_id, page, i * 10 + 107, CASE WHEN k % 2 = 0 THEN 'Rs.' ELSE 'of' END, 480.0, 497.0 + k % 9, 80.0 + 28 * (i % 4), 88.0 + 28 * (i % 4), 0.4 FROM acct WHERE k % 4 = 0),
lined AS (SELECT *, CAST(round((y0 - 2) / 7.0) AS int) AS line FROM close)"""
#: Lines that end with hyphens, are blank, have glyph marks or a footer's phrase.
LINES = """
lines AS (SELECT doc_id, page, i AS line_no, CASE k % 10 WHEN 0 THEN 'wraps-' WHEN 1 THEN '  double--' WHEN 2 THEN '' WHEN 3 THEN '   ' WHEN 4 THEN 'Call Toll Free ' || CAST(k AS string) WHEN 5 THEN '(cid:12)x (cid:3)y' WHEN 6 THEN ' -' WHEN 7 THEN '(cid:7)' WHEN 8 THEN '  next ' ELSE 'line ' || dmy END AS text FROM acct)"""
#: Replies of models: arrays and objects, plain, fenced, cut off, with slips, with text around them.
REPLIES = """
replies AS (SELECT o_orderkey AS id, CASE o_orderkey % 12 WHEN 0 THEN '[{"date": "' || d || '", "debit": 5}, {"date": null}]' WHEN 1 THEN '```json [{"date": "' || d || '"}] ```' WHEN 2 THEN 'Rows: [{"date": "' || d || '"}, {"date": "x' WHEN 3 THEN '[{"date": "' || d || '"}, {"rows": [1]'
            WHEN 4 THEN 'none' WHEN 5 THEN 'see [] ' WHEN 6 THEN '```{"a": True, "b": [1, 2,], "c": None, }```' WHEN 7 THEN 'It is {"a": {"b": "' || d || '"} so' WHEN 8 THEN '{"a": {"b": 1' WHEN 9 THEN '} {' WHEN 10 THEN '{"a": nope}' ELSE '[{"date": "' || d || '"} {"date": "y"}]' END AS text
            FROM (SELECT o_orderkey, substr(CAST(o_orderdate AS string), 1, 10) AS d FROM orders))"""
#: Cells as scanners read them, with a class and a column.
CELLS = f"""
cells AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_orderkey % 13 WHEN 0 THEN m WHEN 1 THEN replace(m, ',', '.') WHEN 2 THEN replace(m, ',', ' ') WHEN 3 THEN m || 'L128' WHEN 4 THEN substr(m, 1, length(m) - 1) WHEN 5 THEN replace(m, '.', ':') WHEN 6 THEN m || ' CR' WHEN 7 THEN 'Rs ' || m
          WHEN 8 THEN replace(m, '.', ' ') WHEN 9 THEN 'cr' WHEN 10 THEN 'Interest' WHEN 11 THEN '1,' || m ELSE ',' END AS text,
          CASE l_linenumber % 5 WHEN 0 THEN 'TEXT' WHEN 1 THEN 'NUMERIC' WHEN 2 THEN 'DATE' WHEN 3 THEN 'HEADER' ELSE 'FOOTER' END AS class, CASE l_orderkey % 3 WHEN 0 THEN 'balance' WHEN 1 THEN 'narration' END AS col
          FROM (SELECT l_orderkey, l_linenumber, {money("CAST(round(max(l_extendedprice) * 100) AS bigint)")} AS m FROM lineitem GROUP BY l_orderkey, l_linenumber))"""


def frame(spark: SparkSession, sf_dir: str, ctes: tuple[str, ...], select: str) -> DataFrame:
    """`select` over the common table expressions and the sample tables."""
    held = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if any(t in c for c in (*ctes, select))}
    text = f"WITH {', '.join(ctes)} {select}".replace("{", "{{").replace("}", "}}")
    for t in held:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **held)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, (ROWS, TOKENS), "SELECT * FROM tok")


def card_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, (ROWS, CARDS), "SELECT * FROM tok")
