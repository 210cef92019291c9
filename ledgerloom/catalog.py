"""Registry of the engine's queries over the supplied tables, and of independently written SQL for their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import catalog_pages, catalog_text
from ledgerloom.functions import dates, money, signals
from ledgerloom.operators import compare, confidence, detect, entities, layout, ledger, ordering, reporting, solver
from ledgerloom.plans import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The same tables in SQL. L: ledger, R: second reading, B: banks.
L = """
raw AS (SELECT o_custkey AS doc_id, o_orderkey AS k, o_orderdate AS d, o_orderpriority AS p, CAST(round(o_totalprice * 100) AS BIGINT) AS a,
        row_number() OVER w - 1 AS row_idx, CAST(sum(CASE WHEN o_orderkey % 3 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE -CAST(round(o_totalprice * 100) AS BIGINT) END) OVER w AS BIGINT) AS t
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
shown AS (SELECT *, (k % 3 <> 0) <> (k % 41 = 0) AS cr, k % 61 = 0 AS two, CASE WHEN k % 53 <> 0 THEN a END AS x FROM raw),
l AS (SELECT doc_id, row_idx, CAST(floor(row_idx / 4) AS INTEGER) + 1 AS page, strftime(d, '%Y-%m-%d') AS date, 'UPI ' || p || ' ' || k AS narration,
      CASE WHEN NOT cr OR two THEN x END AS debit_c, CASE WHEN cr OR two THEN x END AS credit_c,
      CASE WHEN k % 29 <> 0 THEN t + CASE WHEN k % 17 = 0 THEN 100000 WHEN k % 23 = 0 THEN 300 ELSE 0 END END AS balance_c, k FROM shown),
m AS (SELECT *, coalesce(credit_c, 0) AS c, coalesce(debit_c, 0) AS d, lag(balance_c) OVER w AS pb, lag(coalesce(credit_c, 0)) OVER w AS pc, lag(coalesce(debit_c, 0)) OVER w AS pd,
      last_value(balance_c IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lb FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY row_idx))"""
R = """
r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY row_idx) - 1 AS row_idx, page, date, narration, debit_c + CASE WHEN k % 37 = 0 THEN 5000 ELSE 0 END AS debit_c, credit_c,
      CASE WHEN k % 43 <> 0 THEN balance_c END AS balance_c, k FROM l WHERE k % 31 <> 0)"""
B = "b AS (SELECT c_custkey AS doc_id, c_mktsegment AS bank FROM customer)"
BROKEN = """
t AS (SELECT *, balance_c - (pb + c - d) AS diff FROM m),
broken AS (SELECT *, CASE WHEN abs(diff) > 1000 AND abs(abs(diff) - c) > 100 AND abs(abs(diff) - d) > 100 THEN 'MISSING_TRANSACTION'
           WHEN c > 0 AND abs(abs(diff) - 2 * c) <= 100 OR d > 0 AND abs(abs(diff) - 2 * d) <= 100 THEN 'DIRECTION_ERROR' WHEN c > 0 OR d > 0 THEN 'AMOUNT_EXTRACTION_ERROR'
           ELSE 'BALANCE_CORRUPTION' END AS reason FROM t WHERE abs(diff) > 100)"""
QUALIFIED = """
h AS (SELECT *, CASE WHEN debit_c IS NULL AND credit_c IS NULL AND balance_c IS NULL THEN 'NO_TRANSACTION_SEED' WHEN debit_c IS NULL AND credit_c IS NULL THEN 'no_debit_or_credit'
      WHEN debit_c IS NOT NULL AND credit_c IS NOT NULL THEN 'both_debit_and_credit' END AS hard FROM m),
acc AS (SELECT doc_id, row_idx, c, d, balance_c, lag(balance_c) OVER (PARTITION BY doc_id ORDER BY row_idx) AS prev FROM h WHERE hard IS NULL),
q AS (SELECT h.doc_id, h.row_idx, h.hard IS NULL AS accepted, coalesce(h.hard, CASE WHEN abs(acc.prev + acc.c - acc.d - acc.balance_c) > 150 THEN 'conservation_conflict' ELSE 'ok' END) AS reason,
      CASE WHEN h.hard IS NOT NULL OR acc.prev IS NULL OR acc.balance_c IS NULL THEN 'UNSEEDED' WHEN abs(acc.prev + acc.c - acc.d - acc.balance_c) <= 150 THEN 'PASS' ELSE 'FAIL' END AS conservation
      FROM h LEFT JOIN acc USING (doc_id, row_idx))"""
TRUTH = """
u AS (SELECT *, balance_c - pb AS delta, coalesce(debit_c, credit_c, 0) AS own, CASE WHEN debit_c IS NOT NULL THEN 'debit' WHEN credit_c IS NOT NULL THEN 'credit' ELSE 'none' END AS seen,
      CASE WHEN balance_c = pb THEN 'none' WHEN balance_c > pb THEN 'credit' ELSE 'debit' END AS moved FROM m),
truth AS (SELECT doc_id, row_idx, CASE WHEN row_idx = 0 OR delta IS NULL THEN 'UNSEEDED' WHEN near AND same THEN 'FULL_AGREEMENT' WHEN near OR same THEN 'PARTIAL_AGREEMENT' ELSE 'CONFLICT' END AS agreement_state,
          CASE WHEN row_idx = 0 THEN 'NO_PREVIOUS_BALANCE' WHEN balance_c IS NULL THEN 'NO_CURRENT_BALANCE' WHEN pb IS NULL THEN 'NO_PREVIOUS_BALANCE' END AS reason,
          CASE WHEN row_idx > 0 THEN abs(delta) END AS expected_delta_c, CASE WHEN row_idx > 0 AND delta IS NOT NULL THEN moved END AS expected_direction
          FROM (SELECT *, abs(own - abs(delta)) <= 150 AS near, seen = moved OR delta = 0 AND own = 0 AS same FROM u))"""
HEALED = """
v AS (SELECT *, CASE WHEN credit_c > 0 THEN credit_c WHEN debit_c > 0 THEN debit_c END AS own, CASE WHEN credit_c > 0 THEN 'credit' WHEN debit_c > 0 THEN 'debit' END AS ocr, balance_c - lb AS delta FROM m),
w AS (SELECT *, CASE WHEN abs(abs(delta) - own) <= 100 THEN CASE WHEN delta > 0 THEN 'credit' ELSE 'debit' END END AS moved FROM v),
healed AS (SELECT doc_id, row_idx, coalesce(moved <> ocr, false) AS swapped, CASE WHEN coalesce(moved <> ocr, false) THEN credit_c ELSE debit_c END AS debit_c,
           CASE WHEN coalesce(moved <> ocr, false) THEN debit_c ELSE credit_c END AS credit_c, balance_c, ocr, coalesce(moved, ocr) AS led, delta IS NOT NULL AND own IS NOT NULL AS checked FROM w)"""
LINES = """
pages AS (SELECT DISTINCT doc_id, page FROM l),
money AS (SELECT *, strftime(CAST(date AS DATE), '%d/%m/%Y') AS day FROM l),
lines AS (SELECT doc_id, page, CAST(row_idx % 4 + 1 AS INTEGER) AS line_idx, concat_ws('  ', day, narration, format('{:,.2f}', debit_c / 100.0), format('{:,.2f}', credit_c / 100.0), format('{:,.2f}', balance_c / 100.0)) AS text FROM money
          UNION ALL SELECT doc_id, page, 0, 'DATE  NARRATION  DEBIT  CREDIT  BALANCE' FROM pages UNION ALL SELECT doc_id, page, 5, 'Statement of Account Page ' || page FROM pages)"""
TOKENS = """
cut AS (SELECT doc_id, page, line_idx, regexp_split_to_array(text, '\\s+') AS ws FROM lines),
tok AS (SELECT doc_id, page, line_idx, line_idx * 100 + i AS tok_idx, text, 40 * i AS x0, 40 * i + 6 * length(text) AS x1, 12 * line_idx + i % 3 AS y0, 12 * line_idx + i % 3 + 8 AS y1
        FROM (SELECT doc_id, page, line_idx, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS i FROM cut))"""


def register(name: str, query: Query, sql: str | None = None, *ctes: str) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql


def on_ledger(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(views.ledger(spark, d))


def with_banks(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(views.ledger(spark, d), views.banks(spark, d))


def two_readings(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(t := views.ledger(spark, d), views.second_reading(t))


def on_tokens(f: Callable[[DataFrame], DataFrame]) -> Query:
    return on_ledger(lambda t: f(views.tokens(views.statement_lines(t))))


def on_amounts(f) -> Query:
    return lambda spark, d: views.amount_texts(spark, d).select("id", f(F.col("text")))


# Ledger audits
AUDIT = """audit AS (SELECT doc_id, count(*) AS rows, count(t.diff) AS total, count(*) FILTER (abs(t.diff) <= 100) AS valid, count(*) FILTER (b.reason = 'MISSING_TRANSACTION') AS missing_transaction,
    count(*) FILTER (b.reason = 'DIRECTION_ERROR') AS direction_error, count(*) FILTER (b.reason = 'AMOUNT_EXTRACTION_ERROR') AS amount_extraction_error,
    count(*) FILTER (b.reason = 'BALANCE_CORRUPTION') AS balance_corruption FROM t LEFT JOIN (SELECT doc_id, row_idx, reason FROM broken) b USING (doc_id, row_idx) GROUP BY doc_id)"""
register("running_balance_audit", on_ledger(ledger.running_balance_audit), "SELECT *, CASE WHEN total > 0 THEN round(valid * 100.0 / total, 2) WHEN rows = 1 THEN 100.0 ELSE 0.0 END AS continuity FROM audit", L, BROKEN, AUDIT)
register("ledger_breaks", on_ledger(ledger.ledger_breaks), "SELECT doc_id, row_idx, pb AS prev_c, balance_c, pb + c - d AS expected_c, diff AS diff_c, reason FROM broken", L, BROKEN)
MATCHES = "SELECT doc_id, count(*) AS n, count(*) FILTER (abs(pb + c - d - balance_c) <= 100) AS f, count(*) FILTER (abs(balance_c + pc - pd - pb) <= 100) AS g FROM m GROUP BY doc_id"
register("transaction_order", on_ledger(ledger.transaction_order), f"""SELECT doc_id, f AS asc_matches, g AS desc_matches, g > f AS is_descending, CAST(CASE WHEN n < 2 THEN 100 WHEN f + g = 0 THEN 0 WHEN least(f, g) > 0
    THEN floor(greatest(f, g) * 100 / (f + g)) ELSE 100 END AS INTEGER) AS confidence FROM ({MATCHES})""", L)
register("ascending_statements", on_ledger(lambda t: ledger.ascending(t).select("doc_id", "row_idx", "k")), f"""SELECT doc_id, CASE WHEN g > f THEN n - 1 - row_idx ELSE row_idx END AS row_idx, k
    FROM m JOIN ({MATCHES}) USING (doc_id)""", L)
register("direction_heal", on_ledger(lambda t: ledger.heal_directions(t).select("doc_id", "row_idx", "debit_c", "credit_c", "balance_c", "ocr_direction", "ledger_direction", "direction_corrected")),
         "SELECT doc_id, row_idx, debit_c, credit_c, balance_c, ocr AS ocr_direction, led AS ledger_direction, swapped AS direction_corrected FROM healed", L, HEALED)
register("direction_score", on_ledger(lambda t: ledger.direction_score(ledger.heal_directions(t))), """SELECT doc_id, count(*) FILTER (checked) AS total_amounts, count(*) FILTER (swapped) AS corrected_amounts,
    CASE WHEN count(*) FILTER (checked) = 0 THEN 100.0 ELSE round((count(*) FILTER (checked) - count(*) FILTER (swapped)) * 100.0 / count(*) FILTER (checked), 2) END AS direction_score FROM healed GROUP BY doc_id""", L, HEALED)
RECONCILED = """ends AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS credits_c, CAST(sum(d) AS BIGINT) AS debits_c, min(row_idx) FILTER (balance_c IS NOT NULL) AS opening_row, max(row_idx) FILTER (balance_c IS NOT NULL) AS closing_row FROM m GROUP BY doc_id),
    rec AS (SELECT e.*, o.balance_c - o.c + o.d AS opening_c, z.balance_c AS closing_c, o.balance_c - o.c + o.d + credits_c - debits_c - z.balance_c AS difference_c FROM ends e
    LEFT JOIN m o ON o.doc_id = e.doc_id AND o.row_idx = opening_row LEFT JOIN m z ON z.doc_id = e.doc_id AND z.row_idx = closing_row)"""
register("statement_reconcile", on_ledger(ledger.reconcile), """SELECT *, coalesce(abs(difference_c) <= 100, false) AS is_reconciled, round(CASE WHEN abs(difference_c) <= 100 THEN 100.0
    WHEN difference_c IS NOT NULL AND credits_c + debits_c > 0 THEN greatest(0.0, 100.0 - abs(difference_c) * 100.0 / (credits_c + debits_c)) ELSE 0.0 END, 2) AS reconciliation FROM rec""", L, RECONCILED)
register("financial_audit", on_ledger(ledger.financial_audit), """SELECT doc_id, n AS rows, g > f AS is_descending, n - 1 - greatest(f, g) AS running_balance_issues, neg AS negative_amounts, rec AS opening_balance_reconciled,
    n - 1 = greatest(f, g) AND neg = 0 AND rec AND (cs <> 0 OR ds <> 0) AS audit_passed FROM (SELECT s.*, CASE WHEN g > f THEN z.bal - z.c + z.d ELSE o.bal - o.c + o.d END + cs - ds = CASE WHEN g > f THEN o.bal ELSE z.bal END AS rec
    FROM (SELECT doc_id, count(*) AS n, count(*) FILTER (row_idx > 0 AND coalesce(pb, 0) + c - d = coalesce(balance_c, 0)) AS f, count(*) FILTER (row_idx > 0 AND coalesce(balance_c, 0) + pc - pd = coalesce(pb, 0)) AS g,
    count(*) FILTER (debit_c < 0 OR credit_c < 0) AS neg, sum(c) AS cs, sum(d) AS ds FROM m GROUP BY doc_id) s JOIN (SELECT *, coalesce(balance_c, 0) AS bal FROM m WHERE row_idx = 0) o USING (doc_id)
    JOIN (SELECT *, coalesce(balance_c, 0) AS bal FROM m) z ON z.doc_id = s.doc_id AND z.row_idx = n - 1)""", L)
register("qualify_rows", on_ledger(ledger.qualify), "SELECT * FROM q", L, QUALIFIED)
register("corruption_types", on_ledger(ledger.corruptions), """SELECT doc_id, row_idx, 'BALANCE_AS_CREDIT' AS kind FROM m WHERE credit_c = balance_c UNION ALL SELECT doc_id, row_idx, 'BALANCE_AS_DEBIT' FROM m WHERE debit_c = balance_c
    UNION ALL SELECT doc_id, row_idx, 'MULTIPLE_AMOUNTS' FROM m WHERE credit_c IS NOT NULL AND debit_c IS NOT NULL UNION ALL SELECT doc_id, row_idx, 'LEDGER_FAIL' FROM m WHERE abs(lb + c - d - balance_c) > 150""", L)
register("monotonic_balance", on_ledger(ledger.monotonic), """SELECT doc_id, count(*) AS n, count(*) FILTER (step >= 0) AS rising, count(*) FILTER (step <= 0) AS falling,
    count(*) >= 3 AND greatest(count(*) FILTER (step >= 0), count(*) FILTER (step <= 0)) >= (count(*) - 1) * 0.95 - 1e-9 AS is_monotonic
    FROM (SELECT doc_id, balance_c - lag(balance_c) OVER (PARTITION BY doc_id ORDER BY row_idx) AS step FROM l WHERE balance_c IS NOT NULL) GROUP BY doc_id""", L)
register("ledger_truth", on_ledger(ledger.ledger_truth), "SELECT * FROM truth", L, TRUTH)
SUSPECT = """CASE WHEN abs(log10(abs(diff) / 100.0) - round(log10(abs(diff) / 100.0))) < 0.01 THEN 'POWER_OF_TEN_DRIFT'
    WHEN abs(diff) > 50 AND abs(diff) <= 900 AND abs(abs(diff) / 100.0 - round(abs(diff) / 100.0)) < 0.01 THEN 'SMALL_DIGIT_SUBSTITUTION'"""
register("ledger_suspicion", on_ledger(lambda t: ledger.transitions(t).where("diff_c <> 0").select("doc_id", "row_idx", signals.ledger_suspicion(F.col("diff_c")).alias("suspicion"))),
         f"SELECT doc_id, row_idx, {SUSPECT} END AS suspicion FROM t WHERE diff <> 0", L, BROKEN)
register("anomaly_chain", on_ledger(ledger.anomaly_chain), f"""SELECT doc_id, CAST(row_idx AS INTEGER) AS row_idx, kind, 'A' || lpad(CAST(num AS VARCHAR), 4, '0') AS anomaly_id, CAST(root AS INTEGER) AS root_row FROM chain WHERE kind IS NOT NULL""",
         "RECURSIVE " + L.strip(), BROKEN, f"""s AS (SELECT doc_id, row_idx, diff, {SUSPECT} ELSE 'PRIMARY_BALANCE_ANOMALY' END AS kd, row_number() OVER (PARTITION BY doc_id ORDER BY row_idx) AS i FROM (SELECT * FROM t WHERE diff IS NOT NULL)),
    chain AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS row_idx, CAST(0 AS BIGINT) AS err, false AS is_open, CAST(NULL AS BIGINT) AS root, 0 AS num, CAST(NULL AS VARCHAR) AS kind FROM s GROUP BY doc_id
    UNION ALL SELECT s.doc_id, s.i, s.row_idx, CASE WHEN s.diff = 0 OR is_open AND abs(s.diff + err) <= 1 THEN 0 ELSE s.diff END, NOT (s.diff = 0 OR is_open AND abs(s.diff + err) <= 1),
    CASE WHEN s.diff = 0 THEN NULL WHEN is_open AND abs(s.diff + err) <= 1 THEN root ELSE s.row_idx END, CASE WHEN s.diff = 0 OR is_open AND abs(s.diff + err) <= 1 THEN num ELSE num + 1 END,
    CASE WHEN s.diff = 0 THEN NULL WHEN is_open AND abs(s.diff + err) <= 1 THEN 'DOWNSTREAM_CHAIN_EFFECT' ELSE kd END FROM chain JOIN s ON s.doc_id = chain.doc_id AND s.i = chain.i + 1)""")  # fmt: skip
register("worst_breaks", on_ledger(ledger.worst_breaks), "SELECT doc_id, row_idx, pb AS prev_c, balance_c, pb + c - d AS expected_c, diff AS diff_c, reason FROM broken ORDER BY abs(diff) DESC, doc_id, row_idx LIMIT 3", L, BROKEN)
register("last_rows", on_ledger(lambda t: ledger.last_rows(t).select("doc_id", "row_idx", "balance_c", "from_end")), """SELECT doc_id, row_idx, balance_c, from_end FROM
    (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row_idx DESC) AS from_end FROM l) WHERE from_end <= 5""", L)

# Confidence
register("statement_confidence", on_ledger(confidence.statement_confidence))
register("row_scores", on_ledger(confidence.row_scores), """SELECT doc_id, row_idx, coalesce(abs(diff) <= 100, false) AS reconciled,
    CASE WHEN coalesce(abs(diff) <= 100, false) THEN 40 ELSE 0 END + 45 + CASE WHEN (debit_c IS NULL) <> (credit_c IS NULL) THEN 15 ELSE 0 END AS score FROM t""", L, BROKEN)
register("statement_scores", on_ledger(lambda t: confidence.statement_scores(confidence.row_scores(t))), """SELECT doc_id, failed, round(CASE WHEN failed > n * 0.2 THEN mean * 0.8 ELSE mean END, 2) AS statement_score FROM
    (SELECT doc_id, count(*) AS n, count(*) FILTER (NOT coalesce(abs(diff) <= 100, false)) AS failed,
    avg(CASE WHEN coalesce(abs(diff) <= 100, false) THEN 40 ELSE 0 END + 45 + CASE WHEN (debit_c IS NULL) <> (credit_c IS NULL) THEN 15 ELSE 0 END) AS mean FROM t GROUP BY doc_id)""", L, BROKEN)


def candidates(t: DataFrame) -> DataFrame:
    """Two readings of each balance: as printed, and with the decimal point lost where the key says so."""
    rows = t.where("balance_c is not null")
    first = rows.select("doc_id", "row_idx", F.lit(0).alias("pos"), F.when(F.col("k") % 13 == 0, F.col("balance_c") * 1.0).otherwise(F.col("balance_c") / 100.0).alias("value"), (F.col("k") % 13 != 0).alias("decimal_present"), (F.col("k") % 26 == 0).alias("watermark"), F.lit(False).alias("shifted"))
    second = rows.where("k % 13 = 0 and k % 5 = 0").select("doc_id", "row_idx", F.lit(1).alias("pos"), (F.col("balance_c") / 100.0).alias("value"), F.lit(False).alias("decimal_present"), F.lit(False).alias("watermark"), F.lit(True).alias("shifted"))
    return first.unionByName(second)


register("balance_sanity", on_ledger(lambda t: confidence.sane_balances(candidates(t))), """SELECT doc_id, row_idx, arg_min(value, [CAST(rank AS DOUBLE), CASE WHEN rank = 3 THEN abs(value - md) ELSE 0 END, pos]) AS balance FROM
    (SELECT *, CASE WHEN value > md * CASE WHEN wm AND NOT dp THEN 10 ELSE 100 END THEN 3 WHEN dp THEN 0 WHEN sh THEN 1 ELSE 2 END AS rank FROM cand JOIN med USING (doc_id)) GROUP BY doc_id, row_idx""", L,
    """cand AS (SELECT doc_id, row_idx, 0 AS pos, CASE WHEN k % 13 = 0 THEN CAST(balance_c AS DOUBLE) ELSE balance_c / 100.0 END AS value, k % 13 <> 0 AS dp, k % 26 = 0 AS wm, false AS sh FROM l WHERE balance_c IS NOT NULL
    UNION ALL SELECT doc_id, row_idx, 1, balance_c / 100.0, false, false, true FROM l WHERE balance_c IS NOT NULL AND k % 65 = 0),
    med AS (SELECT doc_id, greatest(1.0, coalesce(median(value) FILTER (dp AND NOT wm), median(value))) AS md FROM cand GROUP BY doc_id)""")  # fmt: skip

# Comparison
DIFF = "CASE WHEN (a.{0} IS NULL) <> (z.{0} IS NULL) OR abs(a.{0} - z.{0}) > 100 THEN"
FIELD = "CASE WHEN a.doc_id IS NULL OR z.doc_id IS NULL THEN 'row_count' ELSE coalesce(" + ", ".join(DIFF.format(c) + f" '{c}' END" for c in compare.FIELDS) + ") END"
register("first_divergence", two_readings(compare.first_divergence), f"""SELECT doc_id, min(row_idx) AS row_idx, arg_min(field, row_idx) AS field FROM (SELECT coalesce(a.doc_id, z.doc_id) AS doc_id, coalesce(a.row_idx, z.row_idx) AS row_idx, {FIELD} AS field
    FROM l a FULL JOIN r z ON a.doc_id = z.doc_id AND a.row_idx = z.row_idx) WHERE field IS NOT NULL GROUP BY doc_id""", L, R)
register("three_way_diff", two_readings(lambda a, b: compare.three_way(a, b, a.where("k % 47 <> 0"))), """SELECT * FROM (SELECT doc_id, row_idx, """ + ", ".join(f"coalesce(list_max(list_filter([a.{c}, z.{c}, y.{c}], lambda x: x IS NOT NULL)) - list_min(list_filter([a.{c}, z.{c}, y.{c}], lambda x: x IS NOT NULL)) > 100, false) AS {c}_spread" for c in compare.FIELDS) + """,
    a.k IS NULL OR z.k IS NULL OR y.k IS NULL AS absent FROM l a FULL JOIN r z USING (doc_id, row_idx) FULL JOIN (SELECT * FROM l WHERE k % 47 <> 0) y USING (doc_id, row_idx)) WHERE absent OR debit_c_spread OR credit_c_spread OR balance_c_spread""", L, R)
LIMITS = {"missing": 500, "extra": 0, "amount_errors": 1e9, "recall": 90.0, "precision": 99.0}
register("corpus_matrix", lambda spark, d: compare.corpus_matrix(t := views.ledger(spark, d), views.second_reading(t), views.banks(spark, d), LIMITS), """SELECT *, missing <= 500 AND extra <= 0 AND recall >= 90 AND precision >= 99 AS passed FROM (
    SELECT bank, CAST(sum(e) AS BIGINT) AS expected, CAST(sum(p) AS BIGINT) AS parsed, CAST(sum(coalesce(ae, 0)) AS BIGINT) AS amount_errors, CAST(sum(coalesce(be, 0)) AS BIGINT) AS balance_errors, CAST(sum(coalesce(oe, 0)) AS BIGINT) AS ordering_errors,
    CAST(sum(greatest(e - p, 0)) AS BIGINT) AS missing, CAST(sum(greatest(p - e, 0)) AS BIGINT) AS extra, round((sum(e) - sum(greatest(e - p, 0))) * 100.0 / (sum(e) - sum(greatest(e - p, 0)) + sum(greatest(p - e, 0))), 2) AS precision,
    round((sum(e) - sum(greatest(e - p, 0))) * 100.0 / sum(e), 2) AS recall, round((sum(e) - sum(greatest(e - p, 0))) * 200.0 / (2 * (sum(e) - sum(greatest(e - p, 0))) + sum(greatest(p - e, 0)) + sum(greatest(e - p, 0))), 2) AS f1
    FROM (SELECT doc_id, count(*) AS e FROM l GROUP BY doc_id) LEFT JOIN (SELECT doc_id, count(*) AS p0 FROM r GROUP BY doc_id) USING (doc_id) CROSS JOIN LATERAL (SELECT coalesce(p0, 0) AS p)
    LEFT JOIN (SELECT a.doc_id, count(*) FILTER (abs(a.debit_c - z.debit_c) > 100 OR abs(a.credit_c - z.credit_c) > 100) AS ae, count(*) FILTER (abs(a.balance_c - z.balance_c) > 100) AS be FROM l a JOIN r z USING (doc_id, row_idx) GROUP BY a.doc_id) USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) FILTER (date < prev) AS oe FROM (SELECT doc_id, date, lag(date) OVER (PARTITION BY doc_id ORDER BY row_idx) AS prev FROM r) GROUP BY doc_id) USING (doc_id) JOIN b USING (doc_id) GROUP BY bank)""", L, R, B)
register("positional_accuracy", two_readings(compare.positional_accuracy), """SELECT coalesce(a.doc_id, z.doc_id) AS doc_id, count(*) FILTER (a.k IS NOT NULL AND z.k IS NOT NULL) AS compared, count(*) FILTER (z.k IS NULL) AS missing, count(*) FILTER (a.k IS NULL) AS extra, """
         + ", ".join(f"count(*) FILTER (a.k IS NOT NULL AND z.k IS NOT NULL AND ((a.{c} IS NULL) <> (z.{c} IS NULL) OR abs(a.{c} - z.{c}) > 100)) AS {c}_errors" for c in compare.FIELDS) + " FROM l a FULL JOIN r z ON a.doc_id = z.doc_id AND a.row_idx = z.row_idx GROUP BY 1", L, R)

# Page order
PAGES = """pg AS (SELECT doc_id, page, min(CAST(date AS DATE)) AS start_date, max(CAST(date AS DATE)) AS end_date, list(balance_c ORDER BY row_idx)[1] AS start_c, list(balance_c ORDER BY row_idx DESC)[1] AS end_c,
    list(c ORDER BY row_idx)[1] AS first_credit_c, list(d ORDER BY row_idx)[1] AS first_debit_c, count(*) AS rows FROM m GROUP BY doc_id, page)"""
LINKS = """links AS (SELECT x.doc_id, x.page AS page_a, y.page AS page_b, CASE WHEN y.start_date < x.end_date THEN -300 WHEN y.start_date - x.end_date <= 2 THEN 150 WHEN y.start_date - x.end_date <= 10 THEN 80 ELSE 30 END
    + CASE WHEN abs(x.end_c + y.first_credit_c - y.first_debit_c - y.start_c) <= 100 THEN 200 WHEN abs(x.end_c + y.first_credit_c - y.first_debit_c - y.start_c) <= 1000 THEN 100
    WHEN x.end_c + y.first_credit_c - y.first_debit_c - y.start_c IS NOT NULL THEN -200 ELSE 0 END + CASE WHEN abs(x.page - y.page) = 1 THEN 5 ELSE 0 END AS score FROM pg x JOIN pg y ON x.doc_id = y.doc_id AND x.page <> y.page)"""
register("page_summaries", on_ledger(ordering.page_summaries), "SELECT * FROM pg", L, PAGES)
register("page_links", on_ledger(lambda t: ordering.page_links(ordering.page_summaries(t))), "SELECT * FROM links", L, PAGES, LINKS)
CHAIN = """
first AS (SELECT doc_id, page FROM (SELECT doc_id, page, min(date) AS d FROM l GROUP BY doc_id, page) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d, page) = 1),
chain AS (SELECT doc_id, 1 AS place, page, [page] AS used FROM first
    UNION ALL SELECT doc_id, place + 1, nx, list_append(used, nx) FROM (SELECT c.doc_id, c.place, any_value(c.used) AS used, arg_max(k.page_b, k.score * 100000 - k.page_b) AS nx FROM chain c JOIN links k ON k.doc_id = c.doc_id AND k.page_a = c.page AND NOT list_contains(c.used, k.page_b) GROUP BY c.doc_id, c.place))"""
register("page_chain", on_ledger(lambda t: ordering.page_chain(p := ordering.page_summaries(t), ordering.page_links(p))), "SELECT doc_id, place, page FROM chain", f"RECURSIVE {L}", PAGES, LINKS, CHAIN)
register("page_reversals", lambda spark, d: ordering.page_reversals(views.ledger(spark, d).withColumn("row_idx", F.when(F.col("k") % 7 == 0, -F.col("row_idx")).otherwise(F.col("row_idx")))), """SELECT doc_id, count(*) FILTER (date < pd AND page <> pp) AS reversals, count(*) FILTER (date < pd AND page <> pp) > 0 AS anomaly
    FROM (SELECT doc_id, date, page, lag(date) OVER w AS pd, lag(page) OVER w AS pp FROM (SELECT * REPLACE (CASE WHEN k % 7 = 0 THEN -row_idx ELSE row_idx END AS row_idx) FROM l) WINDOW w AS (PARTITION BY doc_id ORDER BY row_idx)) GROUP BY doc_id""", L)

# Amounts and texts
A = """cents AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey % 10 AS kind, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem),
    parts AS (SELECT id, kind, v, CAST(v // 100 AS VARCHAR) AS w, lpad(CAST(v % 100 AS VARCHAR), 2, '0') AS p FROM cents)"""
register("parse_amount", on_amounts(lambda c: money.parse_amount(c).alias("value")), """SELECT id, CASE kind WHEN 9 THEN NULL WHEN 3 THEN CASE WHEN length(w) <= 6 THEN CAST(w AS DOUBLE) ELSE CAST(substring(w, 1, length(w) - 3) || '.' || right(w, 3) AS DOUBLE) END
    WHEN 4 THEN CAST(right(w, 2) || right(w, 3) || '.' || p AS DOUBLE) WHEN 6 THEN -v / 100.0 WHEN 7 THEN CAST(w AS DOUBLE) ELSE v / 100.0 END AS value FROM parts""", A)
register("normalize_amount_v2", on_amounts(lambda c: money.normalize_amount_v2(c).alias("value")))
register("sanitize_balance_text", on_amounts(lambda c: money.sanitize_balance_text(c).alias("value")))
register("ocr_signatures", on_amounts(lambda c: signals.ocr_signature(c).alias("signature")), """SELECT id, CASE kind WHEN 1 THEN 'MULTIPLE_DOTS' WHEN 3 THEN CASE WHEN length(w) > 3 THEN 'PUNCTUATION_CORRUPTION' END WHEN 4 THEN 'PUNCTUATION_CORRUPTION'
    WHEN 7 THEN CASE WHEN length(w) >= 5 THEN 'NUMERIC_SHAPE_ANOMALY' END END AS signature FROM parts""", A)
register("entity_classes", lambda spark, d: views.statement_lines(views.ledger(spark, d)).select("doc_id", "page", F.explode(F.split("text", "  ")).alias("cell")).groupBy("doc_id", signals.entity_class(F.col("cell")).alias("class")).agg(F.count(F.lit(1)).alias("n")),
         """SELECT doc_id, CASE WHEN regexp_full_match(cell, '\\d{2}/\\d{2}/\\d{4}') THEN 'DATE' WHEN regexp_full_match(cell, '[0-9][0-9,.]*') THEN 'NUMERIC' WHEN cell LIKE 'Statement%' THEN 'FOOTER'
    WHEN cell IN ('DATE', 'NARRATION', 'DEBIT', 'CREDIT', 'BALANCE') THEN 'HEADER' ELSE 'TEXT' END AS class, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '  ')) AS cell FROM lines) GROUP BY 1, 2""", L, LINES)  # fmt: skip
register("normalize_dates", lambda spark, d: views.table(spark, d, "orders").select("o_orderkey", dates.normalize_date(F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "d/M/yyyy")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "dd-MMM-yyyy"))
         .when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "d/M/yy"))).alias("iso")), """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d')
    ELSE day(o_orderdate) || '/' || month(o_orderdate) || '/' || strftime(o_orderdate, '%y') END AS iso FROM orders""")  # fmt: skip
register("footer_rows", lambda spark, d: views.statement_lines(views.ledger(spark, d)).select("doc_id", "page", "line_idx", signals.footer_decision(F.col("text"), F.col("line_idx") / 5.0, F.col("line_idx").between(1, 4)).alias("f")).select("doc_id", "page", "line_idx", "f.*"),
         """SELECT doc_id, page, line_idx, line_idx = 5 AS is_footer, CASE WHEN line_idx = 5 THEN 0.95 WHEN line_idx = 0 THEN 0.4 WHEN n >= 2 THEN 0.0 ELSE 0.0 END AS confidence, CASE WHEN line_idx = 5 THEN 'IGNORE_ROW' ELSE 'CONTINUE' END AS action
    FROM (SELECT *, length(text) - length(replace(text, '.', '')) AS n FROM lines)""", L, LINES)  # fmt: skip
register("text_scores", lambda spark, d: views.table(spark, d, "documents").select("doc_id", signals.text_score(F.col("text")).alias("score")), f"""SELECT doc_id, CASE WHEN n = 0 THEN 0.0 WHEN n = 1 AND chars > 200 THEN -1000.0 WHEN chars > 300 * n THEN -500.0 ELSE
    10.0 * list_sum(list_transform(ls, lambda x: len(regexp_extract_all(x, '{signals.DATE}')))) + 5.0 * list_sum(list_transform(ls, lambda x: len(regexp_extract_all(x, '{signals.DECIMAL}'))))
    + 2.0 * len(list_filter(ls, lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> '')) >= 3)) + 0.5 * n END AS score
    FROM (SELECT *, len(ls) AS n, coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) AS chars FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS ls FROM documents))""")

# Layout
register("y_tolerances", on_tokens(layout.y_tolerances), "SELECT doc_id, page, greatest(3.0, list_sort(list(y1 - y0))[count(*) // 2 + 1] * 0.5) AS tolerance FROM tok GROUP BY doc_id, page", L, LINES, TOKENS)
register("detect_rows", on_tokens(lambda t: layout.row_boxes(layout.detect_rows(t)).drop("left_text")), """SELECT doc_id, page, CAST(line_idx - low AS INTEGER) AS row_no, min(y0) AS y0, max(y1) AS y1, count(*) AS n, string_agg(text, ' ' ORDER BY x0) AS text
    FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY line_idx) - 1 AS rk FROM tok) CROSS JOIN LATERAL (SELECT line_idx - rk AS low) GROUP BY doc_id, page, line_idx, low""", L, LINES, TOKENS)
register("zone_assignment", on_tokens(lambda t: layout.assign_zones(t, layout.header_zones(layout.detect_rows(t))).groupBy("doc_id", "zone").agg(F.count(F.lit(1)).alias("n"))), """SELECT doc_id, zone, count(*) AS n FROM tok JOIN (SELECT * FROM
    (SELECT doc_id AS zd, zone, coalesce((lag(xc) OVER w + xc) / 2, 0) AS lo, coalesce((xc + lead(xc) OVER w) / 2, 9999) AS hi FROM (SELECT DISTINCT doc_id, lower(text) AS zone, (x0 + x1) / 2.0 AS xc FROM tok WHERE line_idx = 0) WINDOW w AS (PARTITION BY doc_id ORDER BY xc)))
    ON doc_id = zd AND x0 BETWEEN lo AND hi GROUP BY doc_id, zone""", L, LINES, TOKENS)
register("suppressed_texts", on_tokens(layout.suppressed_texts), """SELECT doc_id, norm, score FROM (SELECT doc_id, text AS norm, count(DISTINCT page) AS np, CASE WHEN count(DISTINCT page) > any_value(pages) * 0.7 THEN 3 ELSE 0 END
    + CASE WHEN count(*) FILTER (pos <= 0.15 OR pos >= 0.85) > count(*) * 0.5 THEN 2 ELSE 0 END + 2 * len(list_filter(['BANK', 'IFSC', 'MICR', 'PAGE', 'STATEMENT', 'ACCOUNT', 'CURRENCY', 'CUSTOMER', 'NOMINATION'], lambda x: contains(upper(text), x))) AS score
    FROM (SELECT *, ((y0 + y1) / 2.0 - min(y0) OVER p) / (max(y1) OVER p - min(y0) OVER p) AS pos FROM tok WINDOW p AS (PARTITION BY doc_id, page)) JOIN (SELECT doc_id, count(DISTINCT page) AS pages FROM tok GROUP BY doc_id) USING (doc_id) GROUP BY doc_id, text)
    WHERE np >= 2 AND score >= 5""", L, LINES, TOKENS)
register("protected_rows", on_tokens(lambda t: layout.protected_rows(layout.row_boxes(layout.detect_rows(t)))), "SELECT doc_id, page, 0 AS row_no, 5 AS hits FROM pages", L, LINES)
register("transaction_blocks", on_tokens(lambda t: layout.transaction_blocks(layout.row_boxes(layout.detect_rows(t)))), "SELECT doc_id, page, CAST(row_idx % 4 + 1 AS INTEGER) AS row_no, CAST(row_idx % 4 AS INTEGER) AS block FROM l", L)

# Column solver
NUMS = "nums AS (SELECT doc_id, row_idx, list_filter([debit_c, credit_c, balance_c], lambda x: x IS NOT NULL) AS numbers FROM l)"
COLS = """cells AS (SELECT doc_id, row_idx, numbers, unnest(numbers) AS v, generate_subscripts(numbers, 1) - 1 AS b FROM nums),
    moves AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY doc_id, b ORDER BY row_idx)) AS mv FROM cells),
    cols AS (SELECT doc_id, CAST(b AS INTEGER) AS b, count(*) AS n, count(*) FILTER (mv <= 5 OR list_min(list_transform(list_filter(numbers, lambda x, i: i - 1 <> b), lambda x: abs(x - mv))) <= 200) AS hits FROM moves GROUP BY doc_id, b)"""
register("column_scores", on_ledger(lambda t: solver.column_scores(solver.number_rows(t))), "SELECT *, hits / greatest(1, n - 1) AS score FROM cols", L, NUMS, COLS)
register("solve_balance_column", on_ledger(lambda t: solver.solve(solver.number_rows(t))), """SELECT doc_id, b, n, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits / greatest(1, n - 1) * 0.97 + CASE WHEN b = width - 1 THEN 0.0009 ELSE 0 END DESC, b) AS rk
    FROM cols JOIN (SELECT doc_id, max(len(numbers)) AS width FROM nums GROUP BY doc_id) USING (doc_id)) WHERE rk = 1""", L, NUMS, COLS)
register("missing_rows", two_readings(lambda a, b: solver.missing_rows(b, a)), """SELECT doc_id, row_idx, sig AS signature FROM (SELECT doc_id, row_idx, concat_ws('_', date, CAST(balance_c AS VARCHAR), CAST((debit_c IS NOT NULL)::INT + (credit_c IS NOT NULL)::INT + (balance_c IS NOT NULL)::INT AS VARCHAR), substring(md5(lower(substring(replace(narration, ' ', ''), 1, 50))), 1, 8)) AS sig FROM l) x
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, concat_ws('_', date, CAST(balance_c AS VARCHAR), CAST((debit_c IS NOT NULL)::INT + (credit_c IS NOT NULL)::INT + (balance_c IS NOT NULL)::INT AS VARCHAR), substring(md5(lower(substring(replace(narration, ' ', ''), 1, 50))), 1, 8)) AS sig FROM r) y WHERE y.doc_id = x.doc_id AND y.sig = x.sig)""", L, R)

# Reports
register("reject_histogram", with_banks(lambda t, b: reporting.reject_histogram(ledger.qualify(t), b)), """SELECT bank, reason, n, round(n * 100.0 / sum(n) OVER (PARTITION BY bank), 2) AS percent, row_number() OVER (PARTITION BY bank ORDER BY n DESC, reason) AS rank
    FROM (SELECT bank, reason, count(*) AS n FROM q JOIN b USING (doc_id) WHERE NOT accepted GROUP BY bank, reason)""", L, QUALIFIED, B)
register("bank_failure_matrix", with_banks(lambda t, b: reporting.bank_failure_matrix(ledger.ledger_breaks(t), b)), "SELECT bank, " + ", ".join(f"count(*) FILTER (reason = '{x}') AS \"{x}\"" for x in ("MISSING_TRANSACTION", "DIRECTION_ERROR", "AMOUNT_EXTRACTION_ERROR", "BALANCE_CORRUPTION")) + " FROM broken JOIN b USING (doc_id) GROUP BY bank", L, BROKEN, B)
register("fix_impact", with_banks(lambda t, b: reporting.fix_impact(ledger.qualify(t), b)), """SELECT bank, count(*) AS rows, count(*) FILTER (reason = 'both_debit_and_credit') AS two_sided, count(*) FILTER (reason IN ('no_debit_or_credit', 'NO_TRANSACTION_SEED')) AS sideless, count(*) FILTER (reason = 'no_date') AS dateless
    FROM q JOIN b USING (doc_id) GROUP BY ROLLUP (bank)""", L, QUALIFIED, B)
register("waterfall", on_ledger(lambda t: reporting.waterfall(t, ledger.qualify(t), ledger.ledger_truth(t))), """SELECT stage, n, round(n * 100.0 / lag(n) OVER (ORDER BY stage), 2) AS percent FROM (SELECT '1 rows' AS stage, count(*) AS n FROM l UNION ALL SELECT '2 accepted', count(*) FROM q WHERE accepted
    UNION ALL SELECT '3 seeded', count(*) FROM truth WHERE agreement_state <> 'UNSEEDED' UNION ALL SELECT '4 full agreement', count(*) FROM truth WHERE agreement_state = 'FULL_AGREEMENT')""", L, QUALIFIED, TRUTH)
register("continuity_by_bank", with_banks(lambda t, b: reporting.continuity_by_bank(ledger.running_balance_audit(t), b)), """SELECT bank, count(*) AS statements, CAST(sum(total) AS BIGINT) AS total, CAST(sum(total) - sum(valid) AS BIGINT) AS breaks, round(sum(valid) * 100.0 / sum(total), 2) AS continuity
    FROM audit JOIN b USING (doc_id) GROUP BY bank""", L, BROKEN, AUDIT, B)
register("state_counts", on_ledger(lambda t: reporting.state_counts(ledger.ledger_truth(t))), "SELECT agreement_state, count(*) AS n FROM truth GROUP BY agreement_state", L, TRUTH)

# Identity, seeds, candidates and entities
register("canonical_fields", lambda spark, d: views.statement_lines(views.ledger(spark, d)).where("line_idx = 0").select("doc_id", "page", F.posexplode(F.split("text", "  ")).alias("pos", "header")).select("doc_id", "page", "pos", detect.canonical_field(F.col("header")).alias("field")),
         "SELECT doc_id, page, CAST(i AS INTEGER) AS pos, ['DATE', 'NARRATION', 'DEBIT', 'CREDIT', 'BALANCE'][i + 1] AS field FROM pages, range(5) AS g(i)", L, LINES)
CARD = """card AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'CREDIT CARD statement' ELSE 'Account statement' END || CASE WHEN o_orderkey % 5 = 0 THEN ' TOTAL AMOUNT DUE: Rs. ' || format('{:,.2f}', o_totalprice) ELSE '' END
    || CASE WHEN o_orderkey % 7 = 0 THEN ' MINIMUM AMOUNT DUE = ' || format('{:,.2f}', o_totalprice / 20) ELSE '' END || repeat(' text', 40) AS text, o_totalprice AS p FROM orders)"""


def card_texts(spark: SparkSession, d: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    text = F.concat(F.when(k % 3 == 0, "CREDIT CARD statement").otherwise("Account statement"), F.when(k % 5 == 0, F.concat(F.lit(" TOTAL AMOUNT DUE: Rs. "), F.format_number(price, 2))).otherwise(""), F.when(k % 7 == 0, F.concat(F.lit(" MINIMUM AMOUNT DUE = "), F.format_number(price / 20, 2))).otherwise(""), F.lit(" text" * 40))
    return views.table(spark, d, "orders").select("o_orderkey", text.alias("text"), price.alias("p"))


register("document_families", lambda spark, d: card_texts(spark, d).select("o_orderkey", detect.document_family(F.col("text")).alias("family")), "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 35 = 0 THEN 'CREDIT_CARD' ELSE 'BANK_STATEMENT' END AS family FROM card", CARD)
register("card_summaries", lambda spark, d: card_texts(spark, d).select("o_orderkey", detect.card_summary(F.col("text")).alias("s")).select("o_orderkey", "s.statement_due_amount", "s.total_fees"), """SELECT o_orderkey,
    CASE WHEN o_orderkey % 5 = 0 THEN p WHEN o_orderkey % 7 = 0 THEN CAST(replace(format('{:,.2f}', p / 20), ',', '') AS DOUBLE) END AS statement_due_amount, CAST(NULL AS DOUBLE) AS total_fees FROM card""", CARD)


def identities(spark: SparkSession, d: str) -> DataFrame:
    """Customers' segments as bank names, in the header, in the text, as a code, or nowhere."""
    c = views.table(spark, d, "customer")
    k, name = F.col("c_custkey"), F.col("c_mktsegment")
    body = F.concat(F.lit("x\n" * 9), F.when(k % 4 == 1, F.concat(F.lit("at "), name, F.lit(" house"))).when(k % 4 == 2, F.concat(F.lit("IFSC "), F.substring(name, 1, 4), F.lit("0AB1234"))).otherwise("nothing"))
    texts = c.select(k.alias("doc_id"), F.concat(F.when(k % 4 == 0, name).otherwise("statement"), F.lit("\n"), body).alias("text"))
    banks = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    return detect.identify(texts, [(b, b) for b in banks], spark.createDataFrame([(b[:4], b) for b in banks], "prefix string, bank string"))


register("bank_identity", identities, "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 < 3 THEN c_mktsegment ELSE 'UNKNOWN' END AS bank, ['header', 'keyword', 'code', 'none'][c_custkey % 4 + 1] AS layer FROM customer")


def seeds(t: DataFrame) -> DataFrame:
    """Seed candidates of each statement: its first balance as the opening one, and every dated balance of a key class."""
    period = t.groupBy("doc_id").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    rows = t.where("balance_c is not null and (row_idx = 0 or k % 5 = 0)").join(period, "doc_id")
    first = F.col("row_idx") == 0
    return detect.best_seed(rows.select("doc_id", F.col("row_idx").alias("ord"), F.when(first & (F.col("k") % 2 == 0), "opening").otherwise("balance_as_on").alias("source"), F.lit(80).alias("score"), F.col("balance_c").alias("value_c"), F.when(F.col("k") % 10 == 0, "1990-01-01").otherwise(F.col("date")).alias("day"), "start", "end"))


register("seed_balances", on_ledger(seeds), """SELECT doc_id, value_c, source, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, row_idx) AS rk FROM (SELECT doc_id, row_idx, balance_c AS value_c,
    CASE WHEN row_idx = 0 AND k % 2 = 0 THEN 'opening' ELSE 'balance_as_on' END AS source, CASE WHEN row_idx = 0 AND k % 2 = 0 THEN 80 WHEN k % 10 = 0 THEN 0 ELSE 80 END AS score FROM l WHERE balance_c IS NOT NULL AND (row_idx = 0 OR k % 5 = 0))) WHERE rk = 1 AND score > 0""", L)
register("zone_candidates", lambda spark, d: detect.zone_candidates(views.amount_texts(spark, d).where("text <> 'n/a'").select(F.col("id").alias("doc_id"), F.lit(0).alias("row_no"), F.filter(F.array(F.expr("left(text, length(text) - 2)"), F.expr("right(text, 2)")), lambda x: x != "").alias("texts"))))
register("balance_readings", lambda spark, d: detect.balance_candidates(views.amount_texts(spark, d).select(F.col("id").alias("doc_id"), F.lit(0).alias("row_idx"), F.lit(0).alias("pos"), F.when(F.col("id") % 3 == 0, F.regexp_replace("text", r"\D", "")).otherwise(F.col("text")).alias("text"))))
register("visual_lines", on_tokens(lambda t: entities.visual_lines(t).groupBy("doc_id", "page", "line_no").agg(F.count(F.lit(1)).alias("n"))), """SELECT doc_id, page, CAST(dense_rank() OVER (PARTITION BY doc_id, page ORDER BY line_idx) - 1 AS INTEGER) AS line_no, n
    FROM (SELECT doc_id, page, line_idx, count(*) AS n FROM tok GROUP BY doc_id, page, line_idx)""", L, LINES, TOKENS)
register("merged_entities", on_tokens(lambda t: entities.merge_entities(entities.visual_lines(t))), """SELECT doc_id, page, line_no, entity, string_agg(text, ' ' ORDER BY x0, tok_idx) AS text, min(x0) AS x0, max(x1) AS x1, count(*) AS tokens FROM (
    SELECT *, CAST(count(*) FILTER (fresh) OVER (PARTITION BY doc_id, page, line_no ORDER BY x0, tok_idx) - 1 AS BIGINT) AS entity FROM (
        SELECT *, coalesce(x0 - max(x1) OVER (PARTITION BY doc_id, page, line_no ORDER BY x0, tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) NOT BETWEEN -20 AND 25, true) AS fresh
        FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY doc_id, page ORDER BY line_idx) - 1 AS INTEGER) AS line_no FROM tok))) GROUP BY doc_id, page, line_no, entity""", L, LINES, TOKENS)
register("matched_rows", two_readings(lambda a, b: entities.match_rows(a.select("doc_id", "row_idx", F.col("narration").alias("text")), b.select("doc_id", "row_idx", F.col("narration").alias("text")))))

# Text lines
for _name, _query in catalog_text.QUERIES.items():
    register(_name, _query, catalog_text.oracles(L, LINES, QUALIFIED).get(_name))

# Scanned pages
for _name, _query in catalog_pages.QUERIES.items():
    register(_name, _query, catalog_pages.oracles(L).get(_name))
