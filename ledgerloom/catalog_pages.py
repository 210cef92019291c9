"""Queries over scanned pages and their SQL, written on the same tokens in other terms: numbered rows and self joins where
the operators use windows, recursion where they fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import catalog_text
from ledgerloom.functions import dates, replies, signals
from ledgerloom.operators import cards, columns, declarative, drift, entities, geometry, layout, pagetext, readings, recovery, statement, textlines
from ledgerloom.plans import scans, views
from ledgerloom.sources.work import stored


def with_tokens(f):
    return lambda spark, d: f(stored(layout.detect_rows(scans.tokens(spark, d)), "rows"))


def recovered(lines: DataFrame) -> DataFrame:
    """A text parse that lost a nineteenth of its rows before the solver, and gets them back."""
    clean = stored(textlines.preprocess(lines), "lines")
    rows, seeds = stored(textlines.raw_rows(clean), "raw-rows"), stored(textlines.statement_seeds(clean), "seeds")
    txns = textlines.solved(rows.where((F.col("doc_id") * 7 + F.col("row_no")) % 19 != 0), seeds)
    return recovery.transactions(recovery.recover(rows, stored(recovery.opened(txns, seeds), "transactions"), seeds)).select("doc_id", "row_no", "debit_c", "credit_c", "balance_c", "recovered", "confidence")


def reported_lines(t: DataFrame) -> DataFrame:
    """Printed lines, with a stated period on top of some and counts of sides below others."""
    ends = t.groupBy("doc_id").agg(F.max("row_idx").alias("n"))
    period = ends.where("doc_id % 4 = 0").select("doc_id", F.lit(-1).alias("line_no"), F.when(F.col("doc_id") % 8 == 0, "Period From 01-Jan-1992 and 31/12/1999").otherwise("Period between 1-1-1989 TO 31/Dec/1999").alias("text"))
    said = ends.where("doc_id % 5 = 0").select("doc_id", (F.col("n") * 10 + 9).alias("line_no"), F.concat(F.lit("No. of Debits: "), F.col("doc_id") % 3).alias("text"))
    return views.printed_statement(t).unionByName(period).unionByName(said)


def period_texts(spark, d) -> DataFrame:
    k, day, end = F.col("o_orderkey"), F.col("o_orderdate"), F.date_add("o_orderdate", 30)
    shape = lambda f, between, first=day, last=end: F.concat(F.lit("Acct 12-2 x\nfrom "), F.date_format(first, f), F.lit(between), F.date_format(last, f), F.lit(" rest"))
    text = (
        F.when(k % 7 == 0, shape("dd/MM/yyyy", " to ")).when(k % 7 == 1, shape("dd.MM.yyyy", " AND ")).when(k % 7 == 2, shape("d-MMM-yyyy", "-")).when(k % 7 == 3, shape("dd/MM/yyyy", " to ", end, day)).when(k % 7 == 4, shape("dd-MM-yy", "\nto "))
        .when(k % 7 == 5, shape("yyyy/MM/dd", " to ")).otherwise(F.concat(shape("dd-MM-yyyy", " to ", end, day), F.lit(" "), shape("dd/MMM/yyyy", " To ")))
    )
    return views.table(spark, d, "orders").select(k.alias("doc_id"), text.alias("text"))


def parsed(tokens: DataFrame) -> DataFrame:
    blocks, decisions = geometry.parse(tokens)
    return blocks.select("doc_id", "row_idx", "page", "date", "debit_c", "credit_c", "balance_c").join(decisions.select("doc_id", "row_idx", "reason", "conservation"), ["doc_id", "row_idx"])


def swaps(rows: DataFrame) -> DataFrame:
    zones = stored(columns.zones(rows), "zones")
    return geometry.zones_swapped(geometry.numbered(rows, layout.transaction_blocks(columns.anchored(rows, zones))), zones)


def anchors(rows: DataFrame) -> DataFrame:
    zones = stored(columns.zones(rows), "zones")
    return columns.anchored_twice(rows, zones).select("doc_id", "page", "row_no", "zone_text", "dated", "mended", "anchor", "mended_anchor")


def words(spark, d) -> DataFrame:
    return scans.frame(spark, d, (scans.ROWS, scans.TOKENS, scans.WORDS), "SELECT * FROM words")


def shaken(spark, d) -> DataFrame:
    return scans.frame(spark, d, (scans.ROWS, scans.TOKENS, scans.SHAKEN), "SELECT * FROM shaken").drop("line")


def lined(spark, d) -> DataFrame:
    return scans.frame(spark, d, (scans.ROWS, scans.TOKENS, scans.CLOSE), "SELECT * FROM lined")


def named(entities: DataFrame) -> DataFrame:
    return entities.withColumn("children", F.array_join(F.transform("children", lambda c: c.cast("string")), " "))


def said(spark, d) -> DataFrame:
    return scans.frame(spark, d, (scans.REPLIES,), "SELECT * FROM replies")


def drifted(tokens: DataFrame) -> DataFrame:
    zones, held, blocks, decisions = geometry.parse_steps(tokens)
    rows = blocks.select("doc_id", "row_idx", "page", "block", "credit_c", "balance_c").join(decisions.where("accepted").select("doc_id", "row_idx", "conservation"), ["doc_id", "row_idx"])
    return drift.drift_rows(held, rows, zones)


def institutions(spark, d) -> DataFrame:
    """Names of banks as statements print them."""
    names = ["State Bank of India", " sbi ", "The Federal Bank Ltd.", "HDFC Bank Limited", "TJSB (Thane Janata Sahakari Bank)", "Bank of Baroda (BOB)", "Acme Pvt. Ltd.,", "", "Unlimited Co", "(SBI) Mumbai", "the axis", "Private", "ICICI LTD"]
    return views.table(spark, d, "customer").select("c_custkey", F.get(F.array(*[F.lit(n) for n in names]), (F.col("c_custkey") % len(names)).cast("int")).alias("name"))


def signed_rows(spark, d) -> DataFrame:
    """Cells as balances, debits or credits of rows near and far from where the sides meet."""
    cells = scans.frame(spark, d, (scans.CELLS,), "SELECT * FROM cells")
    k, text = F.col("id"), F.col("text")
    date = F.when(k % 4 == 0, "07/02/22UPI-X").when(k % 4 == 1, "07/02/22UPI").when(k % 4 == 2, "07/02/2022")
    sides = [F.when(k % 3 == i, text) for i in range(3)]
    found = signals.ocr_signatures(*sides, date, F.when(k % 3 == 0, 370.0 + k % 40), F.when(k % 3 == 1, 370.0 + k % 40), F.lit(400.0))
    return cells.select("id", F.posexplode(found).alias("nth", "s")).select("id", "nth", "s.*")


def parsed_statements(spark, d) -> DataFrame:
    """Statements of which a sixth have no line that the parser reads; a model's answer stands in for half of those."""
    t = views.ledger(spark, d)
    lines = views.printed_statement(t.where("doc_id % 6 <> 0")).unionByName(t.where("doc_id % 6 = 0 AND row_idx = 0").select("doc_id", F.lit(0).alias("line_no"), F.lit("no rows here").alias("text")))
    rows = F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "date", "narration", "debit_c", "credit_c", "balance_c"))), lambda r: F.struct(r["date"].alias("date"), r["narration"].alias("details"), (r["debit_c"] / 100).alias("debit"), (r["credit_c"] / 100).alias("credit"), (r["balance_c"] / 100).alias("balance"))))
    answers = t.where("doc_id % 12 = 0").groupBy("doc_id").agg(F.concat(F.lit("```json"), rows, F.lit("```")).alias("text"))
    report = statement.parse_statements(lines, answers)[1]
    return report.select("doc_id", "source", "transactions", "hard_failure", "is_descending", "running_balance_issues", "opening_balance_reconciled", "audit_passed")


def cell_readings(spark, d) -> DataFrame:
    cells = scans.frame(spark, d, (scans.CELLS,), "SELECT * FROM cells")
    found = readings.candidates(readings.hypotheses(F.col("text")))
    return cells.select("id", F.posexplode(found).alias("rank", "c")).select("id", "rank", "c.value", F.col("c.text").alias("normalized"), "c.confidence", "c.by")


def chosen(spark, d) -> DataFrame:
    """Cells that the filter keeps, with their best reading."""
    cells = scans.frame(spark, d, (scans.CELLS,), "SELECT * FROM cells").withColumn("d", readings.decision(F.col("class"), F.col("col"), F.col("text")))
    best = F.when(F.col("d.action") == "KEEP", readings.select_best(readings.candidates(readings.hypotheses(F.col("text")))))
    return cells.withColumn("best", best).select("id", "d.action", "d.reason", "best.value", "best.confidence")


def decisions(spark, d) -> DataFrame:
    frame = lambda t: scans.frame(spark, d, (scans.ROWS, scans.BLOCKS), f"SELECT * FROM {t}")
    return geometry.decided(frame("blocks"), frame("seeds"))


QUERIES = {
    "recovered_rows": lambda spark, d: recovered(catalog_text.lines(spark, d)),
    "text_reports": lambda spark, d: recovery.parse(reported_lines(views.ledger(spark, d)))[1],
    "statement_periods": lambda spark, d: textlines.periods(period_texts(spark, d)),
    "seed_dates": lambda spark, d: period_texts(spark, d).select("doc_id", dates.parse_seed_date(F.regexp_extract("text", r"from (\S+)", 1)).alias("day")),
    "header_windows": with_tokens(lambda rows: columns.windows(layout.row_boxes(rows)).withColumn("types", F.array_join("types", " "))),
    "header_columns": with_tokens(columns.zones),
    "block_anchors": with_tokens(anchors),
    "zone_swaps": with_tokens(swaps),
    "decision_folds": decisions,
    "amount_hypotheses": lambda spark, d: cell_readings(spark, d),
    "chosen_amounts": lambda spark, d: chosen(spark, d),
    "grid_lines": lambda spark, d: pagetext.grid_lines(words(spark, d)),
    "page_lines": lambda spark, d: pagetext.page_lines(words(spark, d)),
    "overlay_stats": lambda spark, d: pagetext.overlay_stats(pagetext.grid_lines(words(spark, d))),
    "clean_lines": lambda spark, d: pagetext.cleaned(scans.frame(spark, d, (scans.ROWS, scans.LINES), "SELECT * FROM lines")),
    "reading_order": lambda spark, d: entities.reading_order(shaken(spark, d)).select("doc_id", "page", "tok_idx", "band", "place"),
    "logical_lines": lambda spark, d: entities.logical_lines(entities.visual_lines(shaken(spark, d))),
    "grouped_entities": lambda spark, d: named(declarative.group_entities(lined(spark, d), ("doc_id", "page", "line"))),
    "rebuilt_entities": lambda spark, d: named(declarative.reconstruct_entities(lined(spark, d), ("doc_id", "page", "line"))),
    "declarative_rows": lambda spark, d: declarative.declarative_rows(lined(spark, d)),
    "reply_rows": lambda spark, d: said(spark, d).select("id", replies.rows(F.col("text")).alias("r")).select("id", F.size("r").cast("long").alias("n"), F.get("r", F.lit(0))["date"].alias("first_date"), F.get("r", F.lit(0))["debit"].alias("first_debit")),
    "reply_objects": lambda spark, d: said(spark, d).select("id", replies.object_of(F.col("text")).alias("o")).select("id", "o.*"),
    "drift_rows": lambda spark, d: drifted(scans.tokens(spark, d)),
    "column_drift": lambda spark, d: drift.drift_causes(drifted(scans.tokens(spark, d))),
    "institution_names": lambda spark, d: institutions(spark, d).select("c_custkey", signals.institution_name(F.col("name")).alias("institution")),
    "row_signatures": lambda spark, d: signed_rows(spark, d),
    "statement_parses": lambda spark, d: parsed_statements(spark, d),
    "card_rows": lambda spark, d: cards.card_rows(scans.card_tokens(spark, d)),
    "page_transactions": lambda spark, d: parsed(scans.tokens(spark, d)),
}

# Rows of pages, numbered through a statement.
NUMBERED = """
rws AS (SELECT doc_id, page, y0, min(x0) AS x, string_agg(text, ' ' ORDER BY x0, tok_idx) AS t, upper(string_agg(text, ' ' ORDER BY x0, tok_idx)) AS u, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0) AS rn,
        CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY y0) - 1 AS INTEGER) AS row_no FROM tok GROUP BY doc_id, page, y0)"""
# Fixed values, as the operator has them: words of column headers.
WORDS = """
words(kind, pr, pattern, lefty) AS (VALUES ('value_date', 1, '\\b(VALUE DATE|VALUE DT|VAL DT|VAL\\.DATE|EFFECTIVE DATE)\\b', true), ('cheque', 2, '\\b(CHQ|CHEQUE|REF|REFERENCE|INSTRUMENT)\\b', true), ('date', 3, '\\bDATE\\b', true),
    ('narration', 4, '\\b(PARTICULARS|NARRATION|DESCRIPTION|DETAILS|REMARKS)\\b', true), ('debit', 5, '\\b(WITHDRAWAL|WITHDRAWALS|DEBIT|DR)\\b', false), ('credit', 6, '\\b(DEPOSIT|DEPOSITS|CREDIT|CR)\\b', false), ('balance', 7, '\\b(BALANCE|BAL)\\b', false))"""
WINDOWS = """
said AS (SELECT doc_id, rn, kind FROM rws JOIN words ON regexp_matches(u, pattern)),
wins AS (SELECT doc_id, rn AS nth, max(j) + 1 AS rows, string_agg(kind, ' ' ORDER BY kind) AS types, count(*) AS score FROM (SELECT a.doc_id, a.rn, kind, min(b.rn - a.rn) AS j FROM rws a JOIN said b ON b.doc_id = a.doc_id AND b.rn - a.rn BETWEEN 0 AND 2 GROUP BY ALL) GROUP BY doc_id, rn
         HAVING bool_or(kind = 'date') AND bool_or(kind = 'balance') AND bool_or(kind IN ('debit', 'credit'))),
best AS (SELECT * FROM wins QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, nth DESC) = 1),
hw AS (SELECT doc_id, rn * 1000 + row_number() OVER (PARTITION BY doc_id, rn ORDER BY x0, tok_idx) AS ord, x0, x1, (x0 + x1) / 2.0 AS xm, trim(replace(upper(text), '.', '')) AS w FROM tok JOIN rws USING (doc_id, page, y0) JOIN best USING (doc_id) WHERE rn BETWEEN nth AND nth + rows - 1),
hk AS (SELECT hw.*, list(kind ORDER BY pr) AS kinds FROM hw JOIN words ON regexp_matches(w, pattern) GROUP BY ALL),
cols AS (SELECT doc_id, ord, 0 AS part, kinds[1] AS kind, x0 * 1.0 AS x, xm AS xc FROM hk WHERE NOT (list_contains(kinds, 'debit') AND list_contains(kinds, 'credit'))
         UNION ALL SELECT doc_id, ord, 0, CASE WHEN first_ THEN 'debit' ELSE 'credit' END, x0, (x0 + xm) / 2 FROM both_ UNION ALL SELECT doc_id, ord, 1, CASE WHEN first_ THEN 'credit' ELSE 'debit' END, xm, (xm + x1) / 2 FROM both_),
both_ AS (SELECT *, least(nullif(strpos(w, 'WITHDRAWAL'), 0), nullif(strpos(w, 'DEBIT'), 0), nullif(strpos(w, 'DR'), 0)) < least(nullif(strpos(w, 'DEPOSIT'), 0), nullif(strpos(w, 'CREDIT'), 0), nullif(strpos(w, 'CR'), 0)) AS first_ FROM hk
          WHERE list_contains(kinds, 'debit') AND list_contains(kinds, 'credit') AND regexp_replace(w, '[ /\\\\-]', '', 'g') NOT IN ('DRCR', 'CRDR')),
one AS (SELECT cols.* FROM cols JOIN words USING (kind) QUALIFY row_number() OVER (PARTITION BY doc_id, kind ORDER BY CASE WHEN lefty THEN x ELSE -x END, ord, part) = 1),
zones AS (SELECT doc_id, kind AS zone, coalesce((lag(xc) OVER w + xc) / 2, 0) AS lo, coalesce((xc + lead(xc) OVER w) / 2, 9999) AS hi FROM one WINDOW w AS (PARTITION BY doc_id ORDER BY x, ord, part))"""
_PARTS = WINDOWS.split(",\n")
# both_ is used before it is written: common table expressions need it first.
_BOTH = next(i for i, p in enumerate(_PARTS) if p.startswith("both_"))
WINDOWS = ",\n".join([p for i, p in enumerate(_PARTS[: _BOTH - 1])] + [_PARTS[_BOTH], _PARTS[_BOTH - 1]] + _PARTS[_BOTH + 1 :])
ANY_DATE = r"\b(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|\d{4}[/.-]\d{1,2}[/.-]\d{1,2}|\d{1,2}[\s./-][A-Za-z]{3,9}[\s./-]\d{2,4})\b"
ANCHORS = rf"""
zt AS (SELECT r.*, coalesce((SELECT string_agg(text, ' ' ORDER BY x0, tok_idx) FROM tok WHERE tok.doc_id = r.doc_id AND tok.page = r.page AND tok.y0 = r.y0 AND CASE WHEN z.lo IS NULL THEN tok.x0 < 150 ELSE tok.x0 BETWEEN z.lo - 70 AND z.hi + 70 END), r.t) AS zone_text
       FROM rws r LEFT JOIN (SELECT * FROM zones WHERE zone = 'date') z ON z.doc_id = r.doc_id),
zp AS (SELECT *, regexp_matches(zone_text, '{ANY_DATE}') AS zd, regexp_matches(t, '{ANY_DATE}') AS td, regexp_matches(zone_text, '^\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}}\D') AS zr, regexp_matches(t, '^\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}}\D') AS tr,
       CASE WHEN regexp_full_match(zone_text, '(?i)[J|]?[Ol\d]{{1,2}}[./|):-][Ol\d]{{1,2}}[./|):-]\d{{2,4}}[a-z]?|[J|]?([Ol\d]{{1,2}}|[a-z]{{3}})[./|):-]\d{{2,4}}[a-z]?') THEN zone_text END AS odd FROM rws JOIN zt USING (doc_id, page, y0, x, t, u, rn, row_no)),
zm AS (SELECT *, CASE WHEN NOT zd AND NOT zr AND odd IS NOT NULL THEN translate(regexp_replace(regexp_replace(odd, '^([Jj]([0-9Oo])|\|)', '\2'), '[A-Za-z]$', ''), 'Ool|:)', '001---') END AS mended FROM zp),
anch AS (SELECT *, coalesce(regexp_matches(mended, '{ANY_DATE}') OR regexp_matches(mended, '^\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}}\D'), false) AS saved,
         zd AND length(regexp_extract(zone_text, '^(.*?){ANY_DATE}', 1)) < 20 OR td AND length(regexp_extract(t, '^(.*?){ANY_DATE}', 1)) < 20 AS anchor FROM zm)"""
# Rows of an account open blocks, misread ones once their page has an anchor: each has an amount, and no block has two.
SWAPS = r"""
live AS (SELECT *, bool_or(anchor) OVER (PARTITION BY doc_id, page ORDER BY rn) AS open FROM anch),
rowz AS (SELECT v.*, row_number() OVER (PARTITION BY v.doc_id ORDER BY rn) AS nth, contains(t, '/CR/') AS cr, (SELECT min(x0) FROM tok k WHERE k.doc_id = v.doc_id AND k.page = v.page AND k.y0 = v.y0 AND regexp_full_match(text, '[\d,]+\.\d{2}')) AS ax FROM live v WHERE open AND contains(t, 'UPI/')),
ends AS (SELECT d.doc_id, d.lo AS dlo, d.hi AS dhi, c.lo AS clo, c.hi AS chi FROM zones d JOIN zones c USING (doc_id) WHERE d.zone = 'debit' AND c.zone = 'credit'),
told AS (SELECT doc_id, (cr AND ax BETWEEN clo AND chi) OR (NOT cr AND ax BETWEEN dlo AND dhi) AS agree FROM rowz JOIN ends USING (doc_id) WHERE nth <= 60 AND (ax BETWEEN dlo AND dhi OR ax BETWEEN clo AND chi)),
swaps AS (SELECT doc_id, count(*) FILTER (agree) AS agrees, count(*) FILTER (NOT agree) AS disagrees, count(*) >= 3 AND count(*) FILTER (NOT agree) / count(*) >= 0.6 AS swapped FROM told GROUP BY doc_id)"""
PARSED = """
pt AS (SELECT r.doc_id, CAST(nth - 1 AS INTEGER) AS row_idx, r.page, CASE WHEN k % 11 IN (0, 1) OR k % 11 = 2 AND contains(substr(dmy, 1, 5), '0') THEN NULL WHEN k % 11 = 3 THEN substr(dmy, 1, 6) || substr(dmy, 9, 2) ELSE dmy END AS date,
       (ax BETWEEN dlo AND dhi) = (NOT coalesce(swapped, false)) AS deb, a, bal FROM rowz r JOIN ends USING (doc_id) LEFT JOIN swaps USING (doc_id) JOIN acct ON acct.doc_id = r.doc_id AND acct.page = r.page AND r.y0 = 80 + 28 * (i % 4)),
blocks AS (SELECT doc_id, row_idx, page, date, CASE WHEN deb THEN a END AS debit_c, CASE WHEN NOT deb THEN a END AS credit_c, bal AS balance_c, '' AS anchor FROM pt),
seeds AS (SELECT 0 AS doc_id, 0 AS page, NULL::BIGINT AS seed_c WHERE false)"""
FOLD = """
nb AS (SELECT b.*, seed_c, row_number() OVER (PARTITION BY b.doc_id ORDER BY row_idx) AS rn, anchor LIKE '%closing%' AS label, CASE WHEN date IS NULL THEN 'no_date' WHEN coalesce(debit_c, credit_c, balance_c) IS NULL THEN 'NO_TRANSACTION_SEED'
       WHEN coalesce(debit_c, credit_c) IS NULL THEN 'no_debit_or_credit' WHEN debit_c IS NOT NULL AND credit_c IS NOT NULL THEN 'both_debit_and_credit' END AS hard FROM blocks b LEFT JOIN seeds USING (doc_id, page)),
fold AS (SELECT doc_id, 0::BIGINT AS rn, NULL::BIGINT AS prev, NULL::INTEGER AS page, NULL::VARCHAR AS reason, NULL::VARCHAR AS state FROM (SELECT DISTINCT doc_id FROM nb)
    UNION ALL SELECT doc_id, rn, CASE WHEN reason IN ('ok', 'conservation_conflict') THEN balance_c ELSE prev END, page, reason, state FROM (
        SELECT *, coalesce(hard, CASE WHEN state = 'FAIL' THEN 'conservation_conflict' WHEN label THEN 'structural_label' ELSE 'ok' END) AS reason FROM (
            SELECT *, CASE WHEN hard IS NOT NULL OR prev IS NULL OR balance_c IS NULL THEN 'UNSEEDED' WHEN abs(prev + coalesce(credit_c, 0) - coalesce(debit_c, 0) - balance_c) <= 150 THEN 'PASS' ELSE 'FAIL' END AS state FROM (
                SELECT nb.*, CASE WHEN f.prev IS NULL AND f.page IS DISTINCT FROM nb.page THEN nb.seed_c ELSE f.prev END AS prev FROM fold f JOIN nb ON nb.doc_id = f.doc_id AND nb.rn = f.rn + 1))))"""

# Card statements: no row of these has a footer's words, so rows follow the rules of blocks alone.
CARD_ROWS = rf"""
rr AS (SELECT *, regexp_matches(t, '{ANY_DATE}') AS dated, regexp_matches(t, '\b\d{{1,3}}(,\d{{3}})*\.\d{{2}}\b') AS priced FROM rws),
walk AS (SELECT doc_id, 0::BIGINT AS rn, -1 AS block, 0 AS n, 0 AS page, 0 AS low, false AS dated, false AS priced, false AS taken FROM (SELECT DISTINCT doc_id FROM rr)
    UNION ALL SELECT doc_id, rn, CASE WHEN skip THEN block WHEN fresh THEN block + 1 ELSE block END, CASE WHEN skip THEN n WHEN fresh THEN 1 ELSE n + 1 END, CASE WHEN skip THEN page ELSE rpage END, CASE WHEN skip THEN low ELSE y0 + 8 END,
        CASE WHEN skip THEN dated ELSE rdated END, CASE WHEN skip THEN priced ELSE rpriced END, NOT skip FROM (
        SELECT w.doc_id, r.rn, w.block, w.n, w.page, w.low, w.dated, w.priced, r.page AS rpage, r.y0, r.dated AS rdated, r.priced AS rpriced, NOT r.dated AND (w.block < 0 OR w.page = r.page AND r.y0 - w.low NOT BETWEEN -50 AND 45) AS skip,
            r.dated OR w.n >= 2 OR w.priced AND r.priced AS fresh FROM walk w JOIN rr r ON r.doc_id = w.doc_id AND r.rn = w.rn + 1)),
inb AS (SELECT rr.*, w.block, row_number() OVER (PARTITION BY rr.doc_id, w.block ORDER BY rr.rn) AS row, CASE WHEN contains(t, 'Reward Summary') THEN 'Reward Summary' WHEN contains(t, 'Insurance') THEN 'Insurance' END AS stop FROM rr JOIN walk w ON w.doc_id = rr.doc_id AND w.rn = rr.rn AND w.taken),
cut AS (SELECT *, min(CASE WHEN stop IS NOT NULL THEN row END) OVER (PARTITION BY doc_id, block) AS stop_row FROM inb),
blk AS (SELECT doc_id, block, min(page) AS page, count(*) FILTER (stop_row IS NULL OR row < stop_row) AS rows, arg_min(stop, row) FILTER (stop IS NOT NULL) AS stop_word FROM cut GROUP BY doc_id, block),
tk AS (SELECT c.doc_id, block, row, row * 1000 + row_number() OVER (PARTITION BY c.doc_id, block, row ORDER BY x0, tok_idx) AS ord, text, x0, upper(lead(text) OVER (PARTITION BY c.doc_id, block, row ORDER BY x0, tok_idx)) AS nx, upper(right(text, 2)) AS mk,
       CASE WHEN text LIKE 'no%' THEN CAST(substr(text, 3) AS BIGINT) * 100 WHEN regexp_matches(text, '^\d\d[/ ]') THEN CAST(substr(text, 1, 2) AS BIGINT) * 100 WHEN regexp_matches(text, '^[\d,]+\.\d\d') THEN CAST(regexp_replace(text, '[^0-9]', '', 'g') AS BIGINT) END AS val,
       regexp_matches(text, '^(\d\d/\d\d/\d{{4}}|\d\d Mar \d{{4}})$') AS is_date FROM cut c JOIN tok USING (doc_id, page, y0) WHERE stop_row IS NULL OR row < stop_row),
zn AS (SELECT doc_id, max(lo) FILTER (zone = 'debit') AS dlo, max(hi) FILTER (zone = 'debit') AS dhi, max(lo) FILTER (zone = 'credit') AS clo, max(hi) FILTER (zone = 'credit') AS chi FROM zones GROUP BY doc_id),
e0 AS (SELECT tk.*, CASE WHEN val IS NOT NULL AND mk = 'DR' THEN 'd' WHEN val IS NOT NULL AND mk = 'CR' THEN 'c' WHEN val > 0 AND x0 BETWEEN clo AND chi THEN 'c' WHEN val > 0 AND x0 BETWEEN dlo AND dhi THEN 'd' END AS own, CASE WHEN val > 0 AND nx = 'DR' THEN 'd' WHEN val > 0 AND nx = 'CR' THEN 'c' END AS bh FROM tk LEFT JOIN zn USING (doc_id)),
e1 AS (SELECT *, min(row) FILTER (own IS NOT NULL) OVER (PARTITION BY doc_id, block) AS r0, min(row) FILTER (bh IS NOT NULL) OVER (PARTITION BY doc_id, block) AS r1 FROM e0),
e2 AS (SELECT *, CASE WHEN own IS NOT NULL THEN own WHEN row = r1 AND coalesce(r0 > r1, true) THEN bh END AS ev FROM e1),
amt AS (SELECT doc_id, block, arg_min(val, ord) FILTER (ev = 'd') AS d, arg_min(val, ord) FILTER (ev = 'c') AS c, arg_min(val, ord) FILTER (val > 0 AND x0 > 300) AS far, arg_min(text, ord) FILTER (is_date AND row = 1) AS date FROM e2 GROUP BY doc_id, block),
fin AS (SELECT b.*, date, coalesce(d, CASE WHEN c IS NULL THEN far END) AS d, c, CASE WHEN rows = 0 THEN 'hit_stop_word' WHEN date IS NULL THEN 'no_date_in_anchor' WHEN coalesce(d, c, far) IS NULL THEN 'no_amount_found' END AS reason FROM blk b LEFT JOIN amt USING (doc_id, block)),
nar AS (SELECT f.doc_id, f.block, string_agg(text, ' ' ORDER BY ord) AS narration FROM fin f JOIN tk USING (doc_id, block) WHERE reason IS NULL AND text <> date AND coalesce(val <> d, true) AND coalesce(val <> c, true) AND upper(text) NOT IN ('DR', 'CR') GROUP BY ALL)"""

HYPOTHESES = r"""
base AS (SELECT *, regexp_replace(text, '[^0-9.,]', '', 'g') AS cl FROM cells),
tried AS (
    SELECT id, 1 AS o, replace(cl, ',', '') AS s, CASE WHEN regexp_full_match(cl, '((\d{1,2}(,\d{2})*(,\d{3})?)?\.\d{2})') THEN 0.98 WHEN regexp_full_match(replace(cl, ',', ''), '\d+\.\d{2}') THEN 0.95 ELSE 0.6 END AS conf,
        CASE WHEN regexp_full_match(cl, '((\d{1,2}(,\d{2})*(,\d{3})?)?\.\d{2})') THEN 'matched_indian_format' WHEN regexp_full_match(replace(cl, ',', ''), '\d+\.\d{2}') THEN 'stripped_commas; standard_decimal' ELSE 'stripped_commas' END AS src FROM base
    UNION ALL SELECT id, 2, array_to_string(string_split(cl, '.')[:-2], '') || '.' || string_split(cl, '.')[-1], 0.7, 'converted_internal_dots_to_commas' FROM base WHERE len(string_split(cl, '.')) > 2
    UNION ALL SELECT id, 2 + i, replace(regexp_replace(p, '[^0-9.,]', '', 'g'), ',', ''), 0.4, 'extracted_part_from_space: ' || p FROM (SELECT id, unnest(string_split(text, ' ')) AS p, generate_subscripts(string_split(text, ' '), 1) AS i FROM base WHERE contains(text, ' ')) WHERE p <> ''
    UNION ALL SELECT id, 50, replace(cl, ',', ''), 0.5, 'removed_internal_space' FROM base WHERE contains(text, ' ')
    UNION ALL SELECT id, 51, replace(pre, ',', ''), 0.85, 'truncated_trailing_alpha_noise' FROM (SELECT *, trim(regexp_extract(text, '^[0-9.,\s]+')) AS pre FROM base) WHERE pre <> '' AND pre <> cl
    UNION ALL SELECT id, 52, replace(regexp_replace(replace(text, ':', '.'), '[^0-9.,]', '', 'g'), ',', ''), 0.8, 'replaced_colon_with_dot' FROM base WHERE contains(text, ':')),
nums AS (SELECT id, o, s, conf, src, CAST(s AS DOUBLE) AS v FROM tried JOIN (SELECT id AS bid, cl FROM base) ON bid = id WHERE regexp_full_match(s, '\d+\.?\d*|\.\d+') AND regexp_matches(cl, '\d')),
cand AS (SELECT id, v AS value, arg_min(s, o) AS normalized, max(conf) AS confidence, arg_min(src, -conf * 1000 + o) AS src, min(o) AS o FROM nums GROUP BY id, v),
rnk AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY confidence DESC, o) - 1 AS INTEGER) AS rank, value, normalized, CAST(confidence AS DOUBLE) AS confidence, src FROM cand)"""
GRID = """
src AS (SELECT * FROM {source}),
ln AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY doc_id, page ORDER BY y0) - 1 AS INTEGER) AS line_no, row_number() OVER (PARTITION BY doc_id, page, y0 ORDER BY x0, tok_idx) AS ord FROM src),
marks AS (SELECT doc_id, page, line_no, p, arg_max(text[j], ord) AS c FROM (SELECT *, CAST(round(x0 / 6.0) AS BIGINT) + j - 1 AS p FROM (SELECT *, unnest(range(1, length(text) + 1)) AS j FROM ln)) GROUP BY ALL),
spots AS (SELECT doc_id, page, line_no, unnest(range(0, m + 1)) AS p FROM (SELECT doc_id, page, line_no, max(p) AS m FROM marks GROUP BY ALL)),
grid AS (SELECT doc_id, page, line_no, rtrim(string_agg(coalesce(c, ' '), '' ORDER BY p)) AS text FROM spots LEFT JOIN marks USING (doc_id, page, line_no, p) GROUP BY ALL)"""
MAIN = """
strips AS (SELECT doc_id, page, x0 // 100 AS b, count(*) AS n FROM words GROUP BY ALL),
mains AS (SELECT doc_id, page, min(b) FILTER (n >= top * 0.15) * 100 AS lo, (max(b) FILTER (n >= top * 0.15) + 1) * 100 AS hi FROM (SELECT *, max(n) OVER (PARTITION BY doc_id, page) AS top FROM strips) GROUP BY ALL),
kept AS (SELECT w.*, lo, hi, w.x0 >= lo - 150 AND w.x1 <= hi + 150 AS ins FROM words w JOIN mains USING (doc_id, page)),
near AS (SELECT doc_id, page, tok_idx, text, x0, x1, y0, y1 FROM (SELECT *, count(*) FILTER (ins) OVER (PARTITION BY doc_id, page) <= 0.4 * count(*) OVER (PARTITION BY doc_id, page) AS few FROM kept) WHERE ins OR few OR hi - lo >= 900)"""
OVERLAY = rf"""
gn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS rn, contains(text, 'PAGE') OR contains(text, 'Opening Balance') OR contains(text, 'TOTAL') AS stop FROM grid),
lay AS (SELECT doc_id, page, rn, line_no, text, 1 AS n, 0 AS deep FROM gn WHERE rn = 1
    UNION ALL SELECT doc_id, page, rn, CASE WHEN safe AND n < 2 THEN head ELSE line_no END, CASE WHEN safe AND n < 2 THEN rtrim(array_to_string(list_transform(range(1, greatest(length(cur), length(text)) + 1), lambda i: CASE WHEN i <= length(cur) AND cur[i] <> ' ' THEN cur[i] WHEN i <= length(text) THEN text[i] ELSE ' ' END), '')) ELSE text END,
        CASE WHEN safe AND n < 2 THEN n + 1 ELSE 1 END, CASE WHEN safe AND n >= 2 THEN 1 ELSE 0 END FROM (
        SELECT g.doc_id, g.page, g.rn, g.line_no, l.line_no AS head, l.text AS cur, g.text, l.n, NOT g.stop AND NOT (regexp_matches(l.text, '{ANY_DATE}') AND regexp_matches(g.text, '{ANY_DATE}')) AND NOT (regexp_matches(l.text, '[\d,]+\.\d\d') AND regexp_matches(g.text, '[\d,]+\.\d\d'))
            AND len(list_filter(range(1, least(length(l.text), length(g.text)) + 1), lambda i: l.text[i] <> ' ' AND g.text[i] <> ' ')) = 0 AS safe FROM lay l JOIN gn g ON g.doc_id = l.doc_id AND g.page = l.page AND g.rn = l.rn + 1)),
over_ AS (SELECT doc_id, page, line_no, arg_max(text, rn) AS text, max(n) AS n FROM lay GROUP BY ALL)"""
CLEAN = r"""
cn AS (SELECT doc_id, page, line_no, regexp_replace(text, '\(cid:\d+\)', '', 'g') AS text, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS rn FROM lines),
hy AS (SELECT doc_id, page, rn, line_no, text FROM cn WHERE rn = 1 UNION ALL SELECT c.doc_id, c.page, c.rn, CASE WHEN h.text LIKE '%-' THEN h.line_no ELSE c.line_no END, CASE WHEN h.text LIKE '%-' THEN h.text[:-2] || ltrim(c.text) ELSE c.text END FROM hy h JOIN cn c ON c.doc_id = h.doc_id AND c.page = h.page AND c.rn = h.rn + 1),
hj AS (SELECT doc_id, page, line_no, rtrim(arg_max(text, rn)) AS text FROM hy GROUP BY ALL HAVING NOT contains(lower(arg_max(text, rn)), 'toll free')),
cb AS (SELECT *, lag(text) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS pt FROM hj)"""
LOGICAL = r"""
vl AS (SELECT doc_id, page, line, CAST(dense_rank() OVER (PARTITION BY doc_id, page ORDER BY line) AS BIGINT) AS rn, string_agg(text, ' ' ORDER BY x0, tok_idx) AS text, count(*) AS n, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, avg((y0 + y1) / 2.0) AS yc FROM shaken GROUP BY doc_id, page, line),
vg AS (SELECT doc_id, page, min(x0) AS margin, CASE WHEN count(*) > 1 THEN median(dn) FILTER (dn > 0) ELSE 15 END AS dn FROM (SELECT *, yc - lag(yc) OVER (PARTITION BY doc_id, page ORDER BY rn) AS dn FROM vl) GROUP BY ALL),
lg AS (SELECT doc_id, page, rn, rn AS head, text, 1 AS lines, x0, x1, y0, y1 FROM vl WHERE rn = 1
    UNION ALL SELECT doc_id, page, rn, CASE WHEN go THEN head ELSE rn END, CASE WHEN go THEN ltext || ' ' || text ELSE text END, CASE WHEN go THEN lines + 1 ELSE 1 END, CASE WHEN go THEN least(lx0, x0) ELSE x0 END, CASE WHEN go THEN greatest(lx1, x1) ELSE x1 END, CASE WHEN go THEN ly0 ELSE y0 END, CASE WHEN go THEN greatest(ly1, y1) ELSE y1 END FROM (
        SELECT v.*, l.head, l.text AS ltext, l.lines, l.x0 AS lx0, l.x1 AS lx1, l.y0 AS ly0, l.y1 AS ly1, v.x0 > margin + 20 AND NOT (v.x1 < l.x0 OR v.x0 > l.x1) AND coalesce(v.y0 - l.y1 < dn * 1.5, false) AND NOT regexp_matches(v.text, '(^|[^\d])\d{1,3}(,\d{2,3})*\.\d{2}($|[^\d])') AND (v.n < 5 OR v.x0 >= l.x0) AS go
        FROM lg l JOIN vl v ON v.doc_id = l.doc_id AND v.page = l.page AND v.rn = l.rn + 1 JOIN vg ON vg.doc_id = v.doc_id AND vg.page = v.page))"""

DRIFT = """
low AS (SELECT doc_id, page, max(y1) AS low FROM tok GROUP BY ALL),
acc AS (SELECT f.doc_id, nb.row_idx, f.state, nb.credit_c, nb.page, nb.bal, 80 + 28 * (nb.i % 4) AS top, CASE WHEN nb.k % 5 = 0 AND NOT (nb.k % 10 = 0 AND ((102 + 28 * (nb.i % 4)) / low > 0.88 OR (102 + 28 * (nb.i % 4)) / low < 0.25)) THEN 102 + 28 * (nb.i % 4) ELSE 88 + 28 * (nb.i % 4) END AS bot
        FROM fold f JOIN (SELECT nb.*, acct.bal, acct.k, acct.i FROM nb JOIN acct ON acct.doc_id = nb.doc_id AND acct.page = nb.page AND acct.bal = nb.balance_c) nb ON nb.doc_id = f.doc_id AND nb.rn = f.rn JOIN low ON low.doc_id = f.doc_id AND low.page = nb.page WHERE f.reason IN ('ok', 'conservation_conflict')),
zz AS (SELECT c.doc_id, c.lo AS clo, c.hi AS chi, b.lo AS blo, b.hi AS bhi FROM placed c JOIN placed b USING (doc_id) WHERE c.zone = 'credit' AND b.zone = 'balance'),
placed AS (SELECT doc_id, CASE WHEN coalesce(swapped, false) AND zone = 'debit' THEN 'credit' WHEN coalesce(swapped, false) AND zone = 'credit' THEN 'debit' ELSE zone END AS zone, lo, hi FROM zones LEFT JOIN swaps USING (doc_id)),
spots2 AS (SELECT acc.*, CASE WHEN credit_c IS NULL THEN 500.0 ELSE ax END AS x, coalesce(lead(top) OVER (PARTITION BY acc.doc_id ORDER BY row_idx) - bot, 999) AS nd FROM acc JOIN (SELECT doc_id, CAST(nth - 1 AS INTEGER) AS row_idx, ax FROM rowz) USING (doc_id, row_idx)),
dr AS (SELECT s.doc_id, row_idx, CASE WHEN credit_c IS NULL THEN 'balance' ELSE 'credit' END AS assigned, x, least(abs(x - clo), abs(x - chi)) AS to_credit, least(abs(x - blo), abs(x - bhi)) AS to_balance, abs(x - (blo + bhi) / 2) AS from_centre, nd, nd < 5 AS merged, state <> 'PASS' AS failed,
       CASE WHEN least(chi, bhi) > greatest(clo, blo) THEN (least(chi, bhi) - greatest(clo, blo)) / (chi - clo) * 100 ELSE 0 END AS overlap, (blo + bhi) / 2 AS bc, (clo + chi) / 2 AS cc FROM spots2 s JOIN zz USING (doc_id)),
dc AS (SELECT *, CASE WHEN failed THEN CASE WHEN merged THEN 'ROW_GROUPING' WHEN overlap > 15 OR abs(to_credit - to_balance) < 15 THEN 'ZONE_CREATION' WHEN x > bc + 15 OR x < cc - 15 THEN 'OCR_DRIFT' ELSE 'UNKNOWN' END END AS cause FROM dr)"""
_DRIFT = DRIFT.split(",\n")
_PLACED = next(i for i, p in enumerate(_DRIFT) if p.startswith("placed"))
DRIFT = ",\n".join(_DRIFT[: _PLACED - 1] + [_DRIFT[_PLACED], _DRIFT[_PLACED - 1]] + _DRIFT[_PLACED + 1 :])
# Entities by recursion over the tokens of a group, numbered from left to right.
ENTITIES = """
tn AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY x0, tok_idx) AS rn FROM lined),
eg AS (SELECT {keys}, rn, rn AS head, text, x0, y0, x1, y1, {first} AS confidence, [tok_idx] AS children, NULL::DOUBLE AS x_gap, NULL::DOUBLE AS baseline, NULL::DOUBLE AS height, NULL::DOUBLE AS overlap, NULL::VARCHAR AS strategy FROM tn WHERE rn = 1
    UNION ALL SELECT {tkeys}, rn, CASE WHEN go THEN head ELSE rn END, CASE WHEN go THEN btext || joint || text ELSE text END, CASE WHEN go THEN least(bx0, x0) ELSE x0 END, CASE WHEN go THEN least(by0, y0) ELSE y0 END, CASE WHEN go THEN greatest(bx1, x1) ELSE x1 END, CASE WHEN go THEN greatest(by1, y1) ELSE y1 END,
        CASE WHEN go THEN least(bconf, sure) ELSE {first} END, CASE WHEN go THEN list_append(bch, tok_idx) ELSE [tok_idx] END, CASE WHEN go THEN gap END, CASE WHEN go THEN bl END, CASE WHEN go THEN hs END, CASE WHEN go THEN ov END, CASE WHEN go THEN st END FROM (
        SELECT *, {go} AS go, {joint} AS joint, {sure} AS sure FROM (
            SELECT *, 1 - abs(by1 - y1) / low AS bl, low / greatest(by1 - by0, y1 - y0) AS hs, greatest(0, least(by1, y1) - greatest(by0, y0)) / low AS ov, CASE WHEN upper(text) IN ('CR', 'DR') THEN 'suffix_attach' WHEN upper(btext) IN ('RS', 'RS.', 'INR') THEN 'currency_prefix_merge' ELSE 'horizontal_merge' END AS st FROM (
                SELECT t.*, e.head, e.text AS btext, e.x0 AS bx0, e.y0 AS by0, e.x1 AS bx1, e.y1 AS by1, e.confidence AS bconf, e.children AS bch, t.x0 - e.x1 AS gap, least(e.y1 - e.y0, t.y1 - t.y0) AS low FROM eg e JOIN tn t ON {on} AND t.rn = e.rn + 1)))),
ents AS (SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY head) - 1 AS INTEGER) AS entity FROM (SELECT * FROM eg QUALIFY row_number() OVER (PARTITION BY {keys}, head ORDER BY rn DESC) = 1))"""
GROUP = {"first": "confidence", "go": "gap BETWEEN -20 AND 25 AND bl >= 0.5 AND ov >= 0.3", "joint": "' '", "sure": "confidence"}
REBUILD = {"first": "1.0::DOUBLE", "go": "gap BETWEEN -10 AND 20 AND ov >= 0.5", "joint": "CASE WHEN gap > 3 THEN ' ' ELSE '' END", "sure": "CASE WHEN gap <= 5 THEN 0.99 WHEN gap <= 10 THEN 0.9 ELSE 0.75 END"}
BY_LINE = {"keys": "doc_id, page, line", "tkeys": "doc_id, page, line", "on": "t.doc_id = e.doc_id AND t.page = e.page AND t.line = e.line"}
DECLARED = r"""
ec AS (SELECT *, CASE WHEN regexp_full_match(text, '\d{1,2}[/-]\d{1,2}[/-]\d{2,4}') THEN 'DATE' WHEN regexp_full_match(lower(text), '(₹?(rs\.?)?\s*)[0-9][0-9\s,.]*(\s*[a-z]{2})?') THEN 'NUMERIC' WHEN contains(upper(text), 'BRANCH') AND length(text) < 30 THEN 'FOOTER'
       WHEN upper(text) IN ('DATE', 'NARRATION', 'PARTICULARS', 'CHQ NO', 'DEBIT', 'CREDIT', 'BALANCE', 'WITHDRAWAL', 'DEPOSIT') THEN 'HEADER' ELSE 'TEXT' END AS class FROM ents),
hl AS (SELECT doc_id, page, y0 FROM (SELECT doc_id, page, y0, count(*) FILTER (class = 'HEADER') AS n FROM ec GROUP BY ALL) WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, y0) = 1),
hz AS (SELECT doc_id, page, lower(text) AS header, x0 AS lo, coalesce(lead(x0) OVER (PARTITION BY doc_id, page ORDER BY x0), 9999) AS hi FROM ec JOIN hl USING (doc_id, page, y0)),
eh AS (SELECT ec.*, header, CASE WHEN header = 'value date' THEN 'VALUE_DATE' WHEN header = 'date' THEN 'DATE' WHEN header IN ('particulars', 'narration', 'details') OR header LIKE '%description%' THEN 'NARRATION' WHEN header = 'chq' THEN 'CHEQUE' WHEN header LIKE 'withdrawal%' OR header = 'debit' OR header = 'dr/cr' THEN 'DEBIT'
       WHEN header LIKE 'deposit%' OR header = 'credit' THEN 'CREDIT' WHEN header LIKE 'bal%' THEN 'BALANCE' END AS field FROM ec LEFT JOIN hz ON hz.doc_id = ec.doc_id AND hz.page = ec.page AND (ec.x0 + ec.x1) / 2 >= lo AND (ec.x0 + ec.x1) / 2 < hi),
texts AS (SELECT row_number() OVER () AS id, text FROM (SELECT DISTINCT text FROM ec))"""
ROW_BY_ROW = """
it AS (SELECT eh.*, class IN ('DATE', 'TEXT') AS worded, CASE WHEN class NOT IN ('FOOTER', 'HEADER') AND NOT (coalesce(header IN ('debit', 'credit', 'balance', 'withdrawal', 'deposit', 'cheque'), false) AND (class = 'DATE' OR class = 'TEXT' AND regexp_full_match(regexp_replace(eh.text, '[^A-Za-z0-9]', '', 'g'), '[A-Za-z]{4,}'))) THEN value END AS num
       FROM eh JOIN texts c ON c.text = eh.text LEFT JOIN (SELECT id, value FROM rnk WHERE rank = 0) r ON r.id = c.id),
its AS (SELECT *, y0 * 100000 + entity AS pl FROM it WHERE worded OR num IS NOT NULL),
ys AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0) AS rn FROM (SELECT DISTINCT doc_id, page, y0 FROM its)),
yr AS (SELECT doc_id, page, y0, rn, y0 AS a, 0 AS row FROM ys WHERE rn = 1 UNION ALL SELECT s.doc_id, s.page, s.y0, s.rn, CASE WHEN s.y0 - a >= 15 THEN s.y0 ELSE a END, CASE WHEN s.y0 - a >= 15 THEN row + 1 ELSE row END FROM yr JOIN ys s ON s.doc_id = yr.doc_id AND s.page = yr.page AND s.rn = yr.rn + 1)
SELECT doc_id, page, row, arg_max(text, pl) FILTER (worded AND field = 'DATE') AS date, arg_max(text, pl) FILTER (worded AND field = 'VALUE_DATE') AS value_date, string_agg(text, ' ' ORDER BY pl) FILTER (worded AND field = 'NARRATION') AS narration, arg_max(text, pl) FILTER (worded AND field = 'CHEQUE') AS cheque,
    arg_max(num, pl) FILTER (num IS NOT NULL AND field = 'DEBIT') AS debit, arg_max(num, pl) FILTER (num IS NOT NULL AND field = 'CREDIT') AS credit, arg_max(num, pl) FILTER (num IS NOT NULL AND field = 'BALANCE') AS balance
FROM its JOIN yr USING (doc_id, page, y0) GROUP BY doc_id, page, row"""
BY_PAGE = {"keys": "doc_id, page", "tkeys": "doc_id, page", "on": "t.doc_id = e.doc_id AND t.page = e.page"}


def oracles(ledger_sql: str) -> dict[str, str]:
    pages = f"WITH {scans.ROWS}, {scans.TOKENS}, {NUMBERED}, {WORDS}, {WINDOWS}"
    drawn = f"WITH RECURSIVE {scans.ROWS}, {scans.TOKENS}, {scans.WORDS}"
    close = f"WITH RECURSIVE {scans.ROWS}, {scans.TOKENS}, {scans.CLOSE}"
    lost = catalog_text.PRINTED.replace("rows_ AS", "all_rows AS") + ", rows_ AS (SELECT * FROM all_rows WHERE (doc_id * 7 + row_no) % 19 <> 0)"
    taken = """
        tx AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row_no) - 1 AS nth, CASE WHEN side = 'd' THEN s ELSE dr END AS d0, CASE WHEN side = 'c' THEN s ELSE cr END AS c0 FROM sided),
        ox AS (SELECT *, CASE WHEN nth = 0 AND d0 IS NULL AND c0 IS NULL AND v - seed < -1 THEN seed - v ELSE d0 END AS d, CASE WHEN nth = 0 AND d0 IS NULL AND c0 IS NULL AND v - seed > 1 THEN v - seed ELSE c0 END AS c FROM tx),
        got AS (SELECT doc_id, count(*) AS e, any_value(b) AS b, sum(d) AS ds, sum(c) AS cs, count(*) FILTER (d IS DISTINCT FROM d0 OR c IS DISTINCT FROM c0) AS op FROM ox GROUP BY doc_id)"""
    dated = catalog_text.SOLVED.replace("WHEN 1 THEN 7700", "WHEN 1 THEN CASE WHEN doc_id % 8 <> 0 THEN 7700 END")
    return {
        "recovered_rows": f"""WITH {ledger_sql}, {lost}, {catalog_text.SOLVED}, {taken},
            had AS (SELECT doc_id, count(*) AS n FROM all_rows GROUP BY doc_id),
            away AS (SELECT a.doc_id, a.row_no, a.nums[b + 1] AS bal, list_filter(a.nums, lambda x, i: i <> b + 1) AS oth FROM all_rows a JOIN had USING (doc_id) JOIN got USING (doc_id)
                     WHERE (a.doc_id * 7 + a.row_no) % 19 = 0 AND len(a.nums) > b AND n - e BETWEEN 1 AND 5 AND round((n - e) / n, 4) <= 0.2),
            gaps AS (SELECT doc_id, nth + 1 AS slot, v AS pb, lead(v) OVER w AS nv, lead(coalesce(nullif(c, 0), d)) OVER w AS na, lead(v) OVER w IS NULL AS last FROM ox WINDOW w AS (PARTITION BY doc_id ORDER BY nth)
                     UNION ALL SELECT doc_id, 0, seed, v, coalesce(nullif(c, 0), d), false FROM ox WHERE nth = 0),
            tries AS (SELECT a.doc_id, a.row_no, slot, bal, bal - pb AS mv, list_filter(oth, lambda x: abs(x - abs(bal - pb)) <= 200)[1] AS amt, 5 + CASE WHEN len(oth) = 1 THEN 3 ELSE 0 END + CASE WHEN nv IS NOT NULL THEN CASE WHEN na <> 0 AND abs(abs(nv - bal) - na) <= 200 THEN 2 ELSE 0 END WHEN last THEN 2 ELSE 0 END AS conf
                      FROM away a JOIN gaps g ON g.doc_id = a.doc_id AND pb IS NOT NULL),
            top AS (SELECT * FROM tries WHERE amt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, row_no ORDER BY conf DESC, slot) = 1),
            merged AS (SELECT doc_id, nth AS slot, 1 AS kind, 0 AS turn, d AS debit_c, c AS credit_c, v AS balance_c, false AS recovered, NULL AS conf FROM ox
                       UNION ALL SELECT doc_id, slot, 0, -row_no, CASE WHEN mv < 0 THEN amt END, CASE WHEN mv > 0 THEN amt END, bal, true, conf FROM top WHERE conf >= 7)
            SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY slot, kind, turn) - 1 AS INTEGER) AS row_no, debit_c, credit_c, balance_c, recovered, conf / 10.0 AS confidence FROM merged""",
        "text_reports": f"""WITH {ledger_sql}, {catalog_text.PRINTED}, {dated}, {taken},
            had AS (SELECT doc_id, count(*) AS n FROM rows_ GROUP BY doc_id),
            bad AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, page FROM rows_ GROUP BY doc_id, page HAVING count(*) >= 2) WHERE (doc_id, page) NOT IN (SELECT (doc_id, page) FROM ox)),
            base AS (SELECT DISTINCT doc_id FROM l),
            j AS (SELECT base.doc_id, coalesce(n, 0) AS n, coalesce(e, 0) AS e, op, coalesce(ds, 0) AS ds, coalesce(cs, 0) AS cs, bad.doc_id IS NOT NULL AS pf, base.doc_id % 5 = 0 AS f, coalesce(base.doc_id % 5 = 0 AND base.doc_id % 3 > 0 AND coalesce(ds, 0) = 0, false) AS against
                  FROM base LEFT JOIN had USING (doc_id) LEFT JOIN got USING (doc_id) LEFT JOIN bad USING (doc_id)),
            h AS (SELECT *, CASE WHEN n = 0 THEN 'NO_ROWS_EXTRACTED' WHEN e = 0 THEN 'ZERO_EXTRACTED_TRANSACTIONS' WHEN ds = 0 AND cs = 0 THEN 'ZERO_DEBIT_AND_CREDIT' END AS hard, CASE WHEN n > 0 THEN round((n - e) / n, 4) ELSE 1.0 END AS ratio FROM j)
            SELECT doc_id, n AS candidates, CASE WHEN hard IS NULL THEN e ELSE 0 END AS accepted, ratio AS missing_ratio, CAST(coalesce(op, 0) AS BIGINT) AS opened, n - e BETWEEN 1 AND 5 AND ratio <= 0.2 AS tried, CAST(0 AS BIGINT) AS recovered, CAST(0 AS BIGINT) AS failed, CASE WHEN doc_id % 3 = 0 THEN 'opening' WHEN doc_id % 3 = 1 AND doc_id % 8 <> 0 THEN 'balance_as_on' END AS seed_source,
                CASE WHEN doc_id % 3 = 0 THEN 100 WHEN doc_id % 3 = 1 AND doc_id % 8 = 4 THEN 80 WHEN doc_id % 3 = 1 AND doc_id % 8 <> 0 THEN 50 END AS seed_score, pf AS page_failure, f AS summary_found, NOT against AS summary_match, hard AS hard_failure,
                CASE WHEN hard IS NOT NULL THEN 'FAIL' WHEN ratio >= 0.05 OR pf OR f AND against THEN 'WARNING' ELSE 'PASS' END AS status FROM h""",
        "statement_periods": "SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS \"start\", strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS \"end\" FROM orders WHERE o_orderkey % 7 IN (0, 1, 2, 4, 6)",
        "seed_dates": "SELECT o_orderkey AS doc_id, CASE o_orderkey % 7 WHEN 5 THEN NULL WHEN 3 THEN CAST(o_orderdate + INTERVAL 30 DAY AS DATE) WHEN 6 THEN CAST(o_orderdate + INTERVAL 30 DAY AS DATE) WHEN 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders",
        "header_windows": pages + " SELECT doc_id, CAST(nth AS INTEGER) AS nth, CAST(rows AS INTEGER) AS rows, types FROM wins",
        "header_columns": pages + " SELECT doc_id, zone, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM zones",
        "block_anchors": f"{pages}, {ANCHORS} SELECT doc_id, page, row_no, zone_text, zd OR zr OR td OR tr OR saved AS dated, mended, anchor, anchor OR saved OR zr OR tr AS mended_anchor FROM anch",
        "amount_hypotheses": f"WITH {scans.CELLS}, {HYPOTHESES} SELECT id, rank, value, normalized, confidence, src AS \"by\" FROM rnk",
        "chosen_amounts": f"""WITH {scans.CELLS}, {HYPOTHESES}, why AS (SELECT *, CASE WHEN class IN ('FOOTER', 'HEADER') THEN class WHEN class = 'DATE' AND col = 'balance' THEN 'DATE_IN_NUMERIC_COLUMN' WHEN class = 'TEXT' AND col = 'balance' AND text = 'Interest' THEN 'TEXT_IN_NUMERIC_COLUMN' ELSE 'VALID' END AS reason FROM cells)
            SELECT id, CASE WHEN reason = 'VALID' THEN 'KEEP' ELSE 'DROP' END AS action, reason, CASE WHEN reason = 'VALID' THEN value END AS value, CASE WHEN reason = 'VALID' THEN confidence END AS confidence FROM why LEFT JOIN (SELECT * FROM rnk WHERE rank = 0) USING (id)""",
        "grid_lines": f"{drawn}, {GRID.format(source='words')} SELECT * FROM grid",
        "page_lines": f"{drawn}, {MAIN}, {GRID.format(source='near')}, {OVERLAY} SELECT doc_id, page, line_no, text FROM over_ WHERE text <> ''",
        "overlay_stats": f"{drawn}, {GRID.format(source='words')}, {OVERLAY} SELECT doc_id, page, count(*) AS before, count(*) FILTER (n = 2) AS overlaid, count(*) FILTER (n = 1) AS appended, CAST(sum(deep) AS BIGINT) AS safe_rejected FROM lay GROUP BY doc_id, page",
        "clean_lines": f"WITH RECURSIVE {scans.ROWS}, {scans.LINES}, {CLEAN} SELECT doc_id, page, line_no, text FROM cb WHERE text <> '' OR pt IS NULL OR pt <> ''",
        "reading_order": f"WITH {scans.ROWS}, {scans.TOKENS}, {scans.SHAKEN} SELECT doc_id, page, tok_idx, CAST(dense_rank() OVER (PARTITION BY doc_id, page ORDER BY line) - 1 AS INTEGER) AS band, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY line, x0, y0, tok_idx) - 1 AS INTEGER) AS place FROM shaken",
        "logical_lines": f"WITH RECURSIVE {scans.ROWS}, {scans.TOKENS}, {scans.SHAKEN}, {LOGICAL} SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY head) - 1 AS INTEGER) AS logical_no, text, lines, CAST(x0 AS DOUBLE) AS x0, CAST(x1 AS DOUBLE) AS x1, CAST(y0 AS DOUBLE) AS y0, CAST(y1 AS DOUBLE) AS y1 FROM (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY doc_id, page, head ORDER BY rn DESC) = 1)",
        "grouped_entities": f"{close}, {ENTITIES.format(**GROUP, **BY_LINE)} SELECT doc_id, page, line, entity, text, x0, y0, x1, y1, confidence, array_to_string(children, ' ') AS children, x_gap, baseline, height, overlap, strategy FROM ents",
        "declarative_rows": f"{close}, {ENTITIES.format(**GROUP, **BY_PAGE)}, {DECLARED}, {HYPOTHESES.replace('FROM cells', 'FROM texts')}, {ROW_BY_ROW}",
        "reply_rows": f"WITH {scans.REPLIES}, a AS (SELECT id, nullif(regexp_extract(text, '(?s)(\\[.*\\])', 1), '') AS t0, CASE WHEN NOT contains(t0, ',]') THEN t0 END AS t FROM replies) SELECT id, CASE WHEN json_valid(t) THEN json_array_length(t) ELSE 0 END AS n, CASE WHEN json_valid(t) THEN t ->> '$[0].date' END AS first_date, CASE WHEN json_valid(t) THEN t ->> '$[0].debit' END AS first_debit FROM a",
        "reply_objects": f"""WITH {scans.REPLIES}, a AS (SELECT *, trim(replace(replace(text, '```json', ''), '```', '')) AS t FROM replies),
            b AS (SELECT *, CASE WHEN contains(t, '{{') AND contains(t, '}}') THEN substr(t, strpos(t, '{{'), greatest(0, length(t) - strpos(reverse(t), '}}') + 2 - strpos(t, '{{'))) ELSE t END AS o FROM a),
            c AS (SELECT *, replace(replace(replace(replace(o, ', }}', '}}'), ',]', ']'), ': True', ': true'), ': None', ': null') AS q FROM b),
            d AS (SELECT *, q || repeat('}}', greatest(0, len(string_split(q, '{{')) - len(string_split(q, '}}')))) AS j FROM c)
            SELECT id, CASE WHEN json_valid(j) THEN 'read' WHEN regexp_matches(text, '\\{{.*\\}}') THEN 'invalid' ELSE 'missing' END AS state, CASE WHEN json_valid(j) THEN j END AS json FROM d""",
        "drift_rows": f"{pages.replace('WITH', 'WITH RECURSIVE', 1)}, {ANCHORS}, {SWAPS}, {PARSED}, {FOLD}, {DRIFT} SELECT doc_id, row_idx, assigned, CAST(x AS DOUBLE) AS x, CAST(to_credit AS DOUBLE) AS to_credit, CAST(to_balance AS DOUBLE) AS to_balance, CAST(from_centre AS DOUBLE) AS from_centre, CAST(nd AS DOUBLE) AS next_distance, merged, failed, cause, CAST(overlap AS DOUBLE) AS overlap FROM dc",
        "column_drift": f"{pages.replace('WITH', 'WITH RECURSIVE', 1)}, {ANCHORS}, {SWAPS}, {PARSED}, {FOLD}, {DRIFT} SELECT doc_id, count(*) AS rows, count(*) FILTER (failed) AS failures, CAST(max(overlap) AS DOUBLE) AS overlap, CASE WHEN max(overlap) > 15 THEN 'ZONE_CREATION' WHEN bool_or(failed AND merged) THEN 'ROW_GROUPING' WHEN bool_or(failed AND from_centre > 50) THEN 'OCR_DRIFT' ELSE 'UNKNOWN' END AS cause FROM dc GROUP BY doc_id",
        "statement_parses": f"""WITH {ledger_sql}, {catalog_text.PRINTED}, {catalog_text.SOLVED}, {taken},
            hd AS (SELECT b.doc_id, CASE WHEN b.doc_id % 6 = 0 OR n.doc_id IS NULL THEN 'NO_ROWS_EXTRACTED' WHEN g.doc_id IS NULL THEN 'ZERO_EXTRACTED_TRANSACTIONS' WHEN coalesce(ds, 0) = 0 AND coalesce(cs, 0) = 0 THEN 'ZERO_DEBIT_AND_CREDIT' END AS hard
                   FROM (SELECT DISTINCT doc_id FROM l) b LEFT JOIN (SELECT DISTINCT doc_id FROM rows_) n USING (doc_id) LEFT JOIN got g USING (doc_id)),
            al AS (SELECT doc_id, nth AS row_idx, d, c, v AS b, 'text' AS source FROM ox JOIN hd USING (doc_id) WHERE hard IS NULL UNION ALL SELECT doc_id, row_idx, debit_c, credit_c, balance_c, 'reply' FROM l WHERE doc_id % 12 = 0),
            am AS (SELECT doc_id, row_idx, source, coalesce(d, 0) AS d, coalesce(c, 0) AS c, coalesce(b, 0) AS b, lag(coalesce(b, 0)) OVER w AS pb, lag(coalesce(c, 0)) OVER w AS pc, lag(coalesce(d, 0)) OVER w AS pd FROM al WINDOW w AS (PARTITION BY doc_id ORDER BY row_idx)),
            ag AS (SELECT doc_id, any_value(source) AS source, count(*) AS n, count(*) FILTER (pb + c - d = b) AS f, count(*) FILTER (b + pc - pd = pb) AS g, sum(c) AS cs, sum(d) AS ds, arg_min(b, row_idx) AS b1, arg_min(b - c + d, row_idx) AS o1, arg_max(b, row_idx) AS b2, arg_max(b - c + d, row_idx) AS o2 FROM am GROUP BY doc_id),
            ar AS (SELECT *, CASE WHEN g > f THEN o2 ELSE o1 END + cs - ds = CASE WHEN g > f THEN b1 ELSE b2 END AS rec FROM ag)
            SELECT doc_id, source, n AS transactions, hard AS hard_failure, g > f AS is_descending, n - 1 - greatest(f, g) AS running_balance_issues, rec AS opening_balance_reconciled, n - 1 = greatest(f, g) AND rec AND (cs <> 0 OR ds <> 0) AS audit_passed FROM hd LEFT JOIN ar USING (doc_id)""",
        "institution_names": "SELECT c_custkey, ['STATE BANK OF INDIA', 'STATE BANK OF INDIA', 'FEDERAL BANK', 'HDFC BANK', 'TJSB SAHAKARI BANK', 'BANK OF BARODA', 'ACME', 'UNKNOWN', 'UNLIMITED CO', 'STATE BANK OF INDIA', 'AXIS BANK', '', 'ICICI BANK'][c_custkey % 13 + 1] AS institution FROM customer",
        "row_signatures": f"""WITH {scans.CELLS}, sg AS (SELECT id, CASE WHEN regexp_full_match(text, '[0-9.,]+') AND len(string_split(text, '.')) > 2 THEN 'MULTIPLE_DOTS' WHEN regexp_full_match(replace(text, ',', ''), '[0-9]+[.]([0-9]{{3}}|[0-9]{{5}})') THEN 'PUNCTUATION_CORRUPTION'
                WHEN length(text) >= 2 AND 2 * length(regexp_replace(text, '[^0-9]', '', 'g')) >= length(text) AND (regexp_matches(text, '[OoIlSsBbGg][0-9]') OR regexp_matches(text, '[0-9][OoIlSsBbGg]')) THEN 'NUMERIC_SHAPE_ANOMALY' END AS r FROM cells),
            s AS (SELECT id, 0 AS o, ['debit', 'credit', 'balance'][id % 3 + 1] AS field, r AS reason FROM sg WHERE r IS NOT NULL UNION ALL SELECT id, 1, ['debit', 'credit'][id % 3 + 1], 'COLUMN_BOUNDARY_SUSPECT' FROM cells WHERE id % 3 < 2 AND id % 40 BETWEEN 15 AND 45
                UNION ALL SELECT id, 2, 'date', 'DATE_NARRATION_MERGE' FROM cells WHERE id % 4 = 0)
            SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS INTEGER) AS nth, field, reason, CASE WHEN reason IN ('MULTIPLE_DOTS', 'DATE_NARRATION_MERGE') THEN 'HIGH' WHEN reason = 'PUNCTUATION_CORRUPTION' THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM s""",
        "rebuilt_entities": f"{close}, {ENTITIES.format(**REBUILD, **BY_LINE)} SELECT doc_id, page, line, entity, text, x0, y0, x1, y1, confidence, array_to_string(children, ' ') AS children FROM ents",
        "card_rows": f"""WITH RECURSIVE {scans.ROWS}, {scans.CARDS}, {NUMBERED}, {WORDS}, {WINDOWS}, {CARD_ROWS} SELECT doc_id, block, page, CASE WHEN reason IS NULL THEN date END AS date, CASE WHEN reason IS NULL THEN coalesce(narration, '') END AS narration,
            CASE WHEN reason IS NULL THEN d END AS debit_c, CASE WHEN reason IS NULL THEN c END AS credit_c, reason, stop_word FROM fin LEFT JOIN nar USING (doc_id, block)""",
        "zone_swaps": f"{pages}, {ANCHORS}, {SWAPS} SELECT * FROM swaps",
        "page_transactions": f"{pages.replace('WITH', 'WITH RECURSIVE', 1)}, {ANCHORS}, {SWAPS}, {PARSED}, {FOLD} SELECT f.doc_id, nb.row_idx, nb.page, nb.date, nb.debit_c, nb.credit_c, nb.balance_c, f.reason, f.state AS conservation FROM fold f JOIN nb USING (doc_id, rn)",
        "decision_folds": f"WITH RECURSIVE {scans.ROWS}, {scans.BLOCKS}, {FOLD} SELECT f.doc_id, nb.row_idx, f.reason IN ('ok', 'conservation_conflict') AS accepted, f.reason, f.state AS conservation, nb.narration LIKE 'Branch%' AS contaminated, nb.balance_c IS NULL AS balance_missing FROM fold f JOIN nb USING (doc_id, rn)",
    }
