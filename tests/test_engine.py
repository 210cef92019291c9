"""Cases, properties and the SQL oracles of the statement engine."""

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.catalog import ORACLES, QUERIES
from ledgerloom.functions import dates, money, replies, signals
from ledgerloom.operators import cards, columns, compare, confidence, declarative, detect, entities, geometry, layout, ledger, ordering, pagetext, readings, recovery, solver
from ledgerloom.plans import views
from ledgerloom.sources import readers
from ledgerloom.streaming import audits

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TXNS = "doc_id long, row_idx int, page int, date string, narration string, debit_c long, credit_c long, balance_c long"


def values(spark, cases, f):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    return [r["v"] for r in rows.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


def statement(spark, rows, doc=1):
    return spark.createDataFrame([(doc, i, 1, "2024-01-01", "UPI", d, c, b) for i, (d, c, b) in enumerate(rows)], TXNS)


def test_amounts(spark):
    cases = {"161,835.18": 161835.18, "1,00,000.00": 100000.0, "403.836.10": 403836.10, "2.000": 2000.0, "2.00000": 2000.0, "161835.000": 161835.0, "67882.00L128": 67882.0, "01/04/2026": 1.0, "81,510,17": 81510.17, "5,000.00 CR": 5000.0, "-250.50": -250.5, "ABC": None, "": None, None: None}
    assert values(spark, cases, money.parse_amount) == list(cases.values())
    assert values(spark, ["1O,000.50", "l2.000", "|5"], money.normalize_amount_v2) == [10000.5, 12000.0, 5.0]
    assert values(spark, ["Rs 1,200.50 CR", "  77. ", "none"], money.sanitize_balance_text) == ["1,200.50 CR", "77", None]
    assert values(spark, ["1,200.50 Dr", "x"], money.parse_float_safe) == [1200.5, None]
    assert values(spark, ["a 1,234.50 b 12.00 99,999,999.00"], money.all_amounts) == [[1234.5, 12.0]]
    assert values(spark, ["-1.00", "2", None], money.is_negative) == [True, False, False]


def test_dates(spark):
    cases = {"03/10/2024": "2024-10-03", "3/10/2024": "2024-10-03", "03-Oct-2024": "2024-10-03", "03-Oct-24": "2024-10-03", "2024-10-03": "2024-10-03", "03/10/24": "03/10/24", "31/02/2024": "31/02/2024", "": None, None: None}
    assert values(spark, cases, dates.normalize_date) == list(cases.values())
    (period,) = values(spark, ["from 05/03/2024 to 01/01/2024, 01/04/2024 to 30/04/2024"], dates.statement_period)
    assert str(period["start"]) == "2024-04-01" and str(period["end"]) == "2024-04-30"


def test_cell_and_line_classes(spark):
    assert values(spark, ["2.000", "260.065.93", "1O000", "2,000.00", "abc"], signals.ocr_signature) == ["PUNCTUATION_CORRUPTION", "MULTIPLE_DOTS", "NUMERIC_SHAPE_ANOMALY", None, None]
    assert values(spark, ["", "01/02/2024", "₹ 1,200.50 CR", "Page 3", "BALANCE", "rent for may"], signals.entity_class) == ["UNKNOWN", "DATE", "NUMERIC", "FOOTER", "HEADER", "TEXT"]
    diffs = spark.createDataFrame([(100000,), (300,), (100,), (450,)], "d long").select(signals.ledger_suspicion(F.col("d")).alias("s")).collect()
    assert [r["s"] for r in diffs] == ["POWER_OF_TEN_DRIFT", "SMALL_DIGIT_SUBSTITUTION", "POWER_OF_TEN_DRIFT", None]
    lines = [("05/06/2024 rent 1,200.00 9,000.00", 0.95, True, False, "CONTINUE"), ("GRAND TOTAL 9,000.00", 0.5, False, True, "STOP_PAGE"), ("DISCLAIMER", 0.2, False, True, "STOP_PAGE"), ("Generated on 5 June", 0.9, False, True, "IGNORE_ROW"), ("page 1 OF 3", 0.9, False, True, "IGNORE_ROW"), ("rent", 0.9, False, False, "CONTINUE")]
    rows = spark.createDataFrame([(i, *x[:3]) for i, x in enumerate(lines)], "i int, t string, p double, a boolean")
    got = rows.select("i", signals.footer_decision(F.col("t"), F.col("p"), F.col("a")).alias("f")).orderBy("i").collect()
    assert [(r["f"]["is_footer"], r["f"]["action"]) for r in got] == [x[3:] for x in lines]
    assert got[5]["f"]["confidence"] == pytest.approx(0.6)
    assert values(spark, ["The Big Bank (India) Pvt Ltd.", "Small Bank Limited"], signals.institution_name) == ["BIG BANK", "SMALL BANK"]


def test_break_reasons(spark):
    cases = [((1000, 100, None, 900), "MISSING_TRANSACTION"), ((1000, 4, None, 996), "DIRECTION_ERROR"), ((1000, 500, None, 1000), "AMOUNT_EXTRACTION_ERROR"), ((1000, None, None, 1005), "BALANCE_CORRUPTION"), ((1000, None, None, 1050), "MISSING_TRANSACTION"), ((1000, None, 500, 950), "MISSING_TRANSACTION")]
    for (prev, credit, debit, balance), reason in cases:
        c = lambda v: None if v is None else v * 100
        got = ledger.ledger_breaks(statement(spark, [(None, None, c(prev)), (c(debit), c(credit), c(balance))])).collect()
        assert [r["reason"] for r in got] == [reason]


def test_previous_balance_rules(spark):
    t = statement(spark, [(None, 100, 1000), (None, 50, None), (None, 200, 1250), (300, None, 1550)])
    audit = ledger.running_balance_audit(t).first()
    assert (audit["total"], audit["valid"]) == (1, 0)
    healed = ledger.heal_directions(t).orderBy("row_idx").collect()
    assert [r["direction_corrected"] for r in healed] == [False, False, False, True]
    assert (healed[3]["debit_c"], healed[3]["credit_c"]) == (None, 300)
    assert [r["balance_c"] for r in healed] == [1000, None, 1250, 1550]
    assert ledger.running_balance_audit(statement(spark, [(None, 1, 1)])).first()["continuity"] == 100.0


def test_descending_statements_turn_once(spark):
    rows = [(None, 1000, 1000), (None, 500, 1500), (200, None, 1300), (None, 7000, 8300)]
    back = statement(spark, rows[::-1])
    once = ledger.ascending(back)
    assert [r["balance_c"] for r in once.orderBy("row_idx").collect()] == [r[2] for r in rows]
    assert once.exceptAll(ledger.ascending(once)).count() == 0
    assert ledger.transaction_order(back).first()["is_descending"]


def test_anomaly_chain(spark):
    t = statement(spark, [(None, 0, 1000), (None, 100, 1400), (None, 100, 1200), (None, 100, 1300), (None, 100, 1900)])
    got = [(r["row_idx"], r["kind"], r["anomaly_id"], r["root_row"]) for r in ledger.anomaly_chain(t).orderBy("row_idx").collect()]
    assert got == [(1, "SMALL_DIGIT_SUBSTITUTION", "A0001", 1), (2, "DOWNSTREAM_CHAIN_EFFECT", "A0001", 1), (4, "SMALL_DIGIT_SUBSTITUTION", "A0002", 4)]


def test_rows_by_anchor(spark):
    tokens = spark.createDataFrame([(1, 1, i, "w", i, i + 1, y - 5, y + 5) for i, y in enumerate((0, 3, 6, 9, 30, 33))], "doc_id long, page int, tok_idx int, text string, x0 int, x1 int, y0 int, y1 int")
    rows = {r["tok_idx"]: r["row_no"] for r in layout.detect_rows(tokens).collect()}
    assert [rows[i] for i in range(6)] == [0, 0, 1, 1, 2, 2]


def test_transaction_blocks(spark):
    lines = ["01/02/2024 rent 5.00", "for the house", "and more", "02/02/2024 pay 7.00", "fee 1.00", "GRAND TOTAL 9.00", "03/02/2024 late 1.00"]
    boxes = spark.createDataFrame([(1, 1, i, 12 * i, 12 * i + 10, x, x) for i, x in enumerate(lines)], "doc_id int, page int, row_no int, y0 int, y1 int, text string, left_text string")
    assert [(r["row_no"], r["block"]) for r in layout.transaction_blocks(boxes).orderBy("row_no").collect()] == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3)]


def test_block_anchors_read_all_date_shapes(spark):
    lines = ["2024-02-01 rent 5.00", "more of it", "05-Jan-2024 pay 7.00", "paid on the 05/02/2024 to the house 1.00"]
    boxes = spark.createDataFrame([(1, 1, i, 12 * i, 12 * i + 10, x, x) for i, x in enumerate(lines)], "doc_id int, page int, row_no int, y0 int, y1 int, text string, left_text string")
    assert [r["block"] for r in layout.transaction_blocks(boxes).orderBy("row_no").collect()] == [0, 0, 1, 2]


def test_suppression_keeps_protected_rows(spark):
    rows = [(p, i, t, 10 * i, 5 if t != "Page 1" else 190) for p in (1, 2, 3) for i, t in enumerate(["Statement", "Date", "Debit", "Balance", f"x{p}", "Page 1"])]
    tokens = spark.createDataFrame([(1, p, i, t, x, x + 8, y, y + 8) for p, i, t, x, y in rows], "doc_id int, page int, tok_idx int, text string, x0 int, x1 int, y0 int, y1 int")
    protected = layout.protect_tokens(layout.detect_rows(tokens))
    left = sorted((r["page"], r["text"]) for r in layout.suppress(protected).collect())
    assert [t for p, t in left if p == 1] == ["Balance", "Date", "Debit", "Statement", "x1"]
    bare = sorted(r["text"] for r in layout.suppress(protected.withColumn("protected", F.lit(False))).where("page = 1").collect())
    assert bare == ["x1"]


def test_period_bands(spark):
    texts = [(1, "Statement of Account"), (1, "from 01/02/2024"), (1, "to 01/03/2024"), (1, "Mr X"), (9, "rent 05/02/2024")]
    tokens = spark.createDataFrame([(1, 1, i, t, 10 * i, 10 * i + 8, 10 * y, 10 * y + 8) for i, (y, t) in enumerate(texts)], "doc_id int, page int, tok_idx int, text string, x0 int, x1 int, y0 int, y1 int")
    assert sorted(r["tok_idx"] for r in layout.period_bands(tokens).collect()) == [0, 1, 2]


def test_zone_swap(spark):
    zones = spark.createDataFrame([(d, z, lo, lo + 99.0) for d in (1, 2, 3) for z, lo in (("debit", 300.0), ("credit", 400.0))], "doc_id int, zone string, lo double, hi double")
    said = {1: ["UPI/CR/1 x"] * 4, 2: ["UPI/DR/1"] * 3 + ["salary paid"], 3: ["NEFT CR y", "IMPS/CR/1 and ATM/WDL/2", "interest credit"]}
    tokens = [(d, 1, b, seq, text, x) for d, texts in said.items() for b, t in enumerate(texts) for seq, (text, x) in enumerate([(t, 100.0), ("n1.00", 320.0), ("5.00", 310.0), ("9.00", 500.0)])]
    got = {r["doc_id"]: (r["agrees"], r["disagrees"], r["swapped"]) for r in geometry.zones_swapped(spark.createDataFrame(tokens, "doc_id int, page int, block int, seq int, text string, x0 double"), zones).collect()}
    assert got == {1: (0, 4, True), 2: (3, 0, False), 3: (0, 1, False)}


def test_tokens_are_folded_into_rows_once_for_all_cells(spark):
    """The cells' plan reads stored tokens: the page's fold and its sources are not in it."""
    tokens = spark.createDataFrame([("d", 1, i, t, float(x), float(x + 40), y, y + 8.0) for y in (0.0, 28.0) for i, (t, x) in enumerate((("DATE", 20), ("DEBIT", 300), ("BALANCE", 500)) if y == 0 else (("01/02/2020", 20), ("10.00", 300), ("90.00", 500)))], "doc_id string, page int, tok_idx int, text string, x0 double, x1 double, y0 double, y1 double")
    cells = geometry.extract_blocks(tokens)
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "tolerance" not in plan
    assert [(r["date"], r["debit_c"], r["balance_c"]) for r in cells.collect()] == [("01/02/2020", 1000, 9000)]


def test_declarative_rows_bring_pages_together_once(spark):
    words = (("Date", 20), ("Narration", 100), ("Debit", 300), ("Balance", 500)), (("01/02/2020", 20), ("rent", 100), ("10.00", 300), ("90.00", 500))
    tokens = spark.createDataFrame([("d", 1, i * 10 + n, t, float(x), x + 6.0 * len(t), 28.0 * i, 28.0 * i + 8, 0.9) for i, row in enumerate(words) for n, (t, x) in enumerate(row)], "doc_id string, page int, tok_idx int, text string, x0 double, x1 double, y0 double, y1 double, confidence double")
    found = declarative.declarative_rows(tokens)
    assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    assert ("01/02/2020", "rent") in [(r["date"], r["narration"]) for r in found.collect()]
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2


def test_work_tables_leave_no_shuffle_files(spark):
    """A stored step's shuffle files go when it is written, and a discarded table's files too."""
    import time

    from ledgerloom.sources import work

    sc = spark.sparkContext

    def shuffles() -> set[str]:
        files = sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before = shuffles()
    table = work.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "swept")
    for _ in range(50):
        if not (left := shuffles() - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 7
    work.discard(table)
    path = sc._jvm.org.apache.hadoop.fs.Path(table._work_path)
    assert not path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path)


def test_labels_in_succession_are_folded(spark):
    """A rejected label row leaves the balance before it, so the row after two labels still conserves."""
    rows = [(1, 0, 1, None, 10000, 10000, "upi"), (1, 1, 1, None, 500, 50000, "upi"), (1, 2, 1, None, 1000, 51000, "closing"), (1, 3, 1, None, 500, 51500, "closing"), (1, 4, 1, None, 500, 52000, "upi")]
    blocks = spark.createDataFrame([(d, i, p, "2024-01-01", "n", dr, cr, bal, a) for d, i, p, dr, cr, bal, a in rows], "doc_id int, row_idx int, page int, date string, narration string, debit_c bigint, credit_c bigint, balance_c bigint, anchor string")
    seeds = spark.createDataFrame([(1, 1, 0)], "doc_id int, page int, seed_c bigint")
    got = [(r["reason"], r["conservation"]) for r in geometry.decided(blocks, seeds).orderBy("row_idx").collect()]
    assert got == [("ok", "PASS"), ("conservation_conflict", "FAIL"), ("structural_label", "PASS"), ("conservation_conflict", "FAIL"), ("ok", "PASS")]


def test_balance_swallowed_by_the_right_most_side(spark):
    zones = spark.createDataFrame([(1, "debit", 300.0, 400.0), (1, "credit", 400.0, 9999.0), (2, "credit", 300.0, 400.0), (2, "debit", 400.0, 9999.0), (3, "debit", 1.0, 2.0), (3, "balance", 2.0, 3.0)], "doc_id int, zone string, lo double, hi double")
    blocks = spark.createDataFrame([(d, 500, 900, None) for d in (1, 2, 3)], "doc_id int, debit_c bigint, credit_c bigint, balance_c bigint")
    got = {r["doc_id"]: (r["debit_c"], r["credit_c"], r["balance_c"]) for r in geometry.rescued(blocks, zones).collect()}
    assert got == {1: (500, None, 900), 2: (None, 900, 500), 3: (500, 900, None)}


def test_misread_dates(spark):
    texts = ["J03-11-2021", "Jo3-11-2021", "05-11-2021l", "O5|11|2021", "l2:O1:2022", "|01)02/22", "Jan-2021", "JOURNAL", "05-11-2021", "5 Mar 2021", ""]
    want = ["03-11-2021", "03-11-2021", "05-11-2021", "05-11-2021", "12-01-2022", "01-02/22", "Jan-2021", None, "05-11-2021", None, None]
    assert values(spark, texts, columns.mended) == want


def test_header_over_two_rows_and_merged_sides(spark):
    words = [(0, "DATE", 20), (0, "DETAILS", 100), (1, "VAL.DATE", 60), (1, "DR/CR", 560), (1, "Deposits-Withdrawals", 300), (1, "BAL", 500), (2, "x", 0)]
    rows = spark.createDataFrame([(1, 1, i, r, t, x, x + 100, 10 * r, 10 * r + 8) for i, (r, t, x) in enumerate(words)], "doc_id int, page int, tok_idx int, row_no int, text string, x0 int, x1 int, y0 int, y1 int")
    got = {r["zone"]: (r["lo"], r["hi"]) for r in columns.zones(rows).collect()}
    # VAL.DATE loses its dot before its kind is told, so it names none.
    assert got == {"date": (0.0, 110.0), "narration": (110.0, 237.5), "credit": (237.5, 350.0), "debit": (350.0, 462.5), "balance": (462.5, 9999.0)}


def test_lost_rows_find_their_gap(spark):
    """The second of three rows is lost; another one fits nowhere, and a statement that lacks too many is left alone."""
    number = lambda *units: [(1000 * u, 10 * i) for i, u in enumerate(units)]
    rows = [(1, i, 1, "01/01/2024", f"n{i}", n, [f"n{i}"]) for i, n in enumerate([number(100, 1000), number(50, 1050), number(25, 1075), *[number(10, 1075 + 10 * j) for j in range(1, 9)], number(7, 77777)])]
    rows += [(2, i, 1, "01/01/2024", f"n{i}", number(1, i), [f"n{i}"]) for i in range(4)]
    candidates = spark.createDataFrame(rows, "doc_id int, row_no int, page int, date string, narration string, numbers array<struct<cents:bigint,x:int>>, lines array<string>")
    kept = [(d, i, 1, "01/01/2024", f"n{i}", None, n[0][0], n[1][0], 1, False) for d, i, _, _, _, n, _ in rows if (d, i) not in ((1, 1), (1, 11), (2, 1))]
    txns = spark.createDataFrame(kept, "doc_id int, row_no int, page int, date string, narration string, debit_c bigint, credit_c bigint, balance_c bigint, balance_column int, opened boolean")
    seeds = spark.createDataFrame([(1, 900_000)], "doc_id int, value_c bigint")
    states = recovery.recover(candidates, txns, seeds)
    got = {(r["doc_id"], r["row_no"]): (r["state"], r["credit_c"], r["confidence"]) for r in states.where("state <> 'kept'").collect()}
    assert got == {(1, 1): ("recovered", 50_000, 1.0), (1, 11): ("lost", None, None), (2, 1): ("unread", None, None)}
    assert [r["balance_c"] for r in recovery.transactions(states).where("doc_id = 1").orderBy("row_no").collect()][:3] == [1_000_000, 1_050_000, 1_075_000]


def test_merged_dates_and_owed_balances(spark):
    cells = [("DATE", 20, 0), ("NARRATION", 100, 0), ("DEBIT", 300, 0), ("CREDIT", 400, 0), ("BALANCE", 500, 0), ("02", 20, 20), ("Feb", 32, 20), ("2026", 48, 20), ("rent", 100, 20), ("5.00", 300, 20), ("95.00", 400, 20), ("CR", 440, 20)]
    tokens = spark.createDataFrame([(1, 1, i, t, x, x + 10, y, y + 8) for i, (t, x, y) in enumerate(cells)], "doc_id int, page int, tok_idx int, text string, x0 int, x1 int, y0 int, y1 int")
    row = geometry.extract_blocks(tokens).first()
    assert (row["date"], row["narration"], row["debit_c"], row["credit_c"], row["balance_c"]) == ("02 Feb 2026", "rent", 500, None, 9500)


def test_column_solver(spark):
    rows = spark.createDataFrame([(1, 0, [100000]), (1, 1, [10000, 110000]), (1, 2, [5000, 105000])], "doc_id long, row_idx int, numbers array<long>")
    best = solver.solve(rows.where("row_idx > 0")).first()
    assert (best["b"], best["hits"]) == (1, 1)


def test_page_chain_restores_shuffled_pages(spark):
    t = views.ledger(spark, SF).where("k % 29 <> 0 and k % 17 <> 0 and k % 23 <> 0 and k % 41 <> 0 and k % 53 <> 0 and k % 61 <> 0")
    pages = ordering.page_summaries(t)
    chain = ordering.page_chain(pages, ordering.page_links(pages))
    assert chain.count() == pages.count()
    first = chain.where("place = 1").join(pages.groupBy("doc_id").agg(F.min("start_date").alias("first")), "doc_id").join(pages, ["doc_id", "page"])
    assert first.where("start_date <> first").count() == 0


def test_compare_with_itself(spark):
    t = views.ledger(spark, SF)
    assert compare.first_divergence(t, t).count() == 0 and compare.three_way(t, t, t).count() == 0
    rows = spark.range(1).select(*compare.prf(F.lit(8), F.lit(2), F.lit(0)), *[c.alias(f"z{i}") for i, c in enumerate(compare.prf(F.lit(0), F.lit(0), F.lit(0)))]).first()
    assert (rows["precision"], rows["recall"], rows["f1"]) == (80.0, 100.0, 88.89) and rows["z0"] == rows["z1"] == rows["z2"] == 0


def test_results_dont_depend_on_partitions(spark):
    t = views.ledger(spark, SF)
    for f in (ledger.running_balance_audit, ledger.ledger_truth, ledger.qualify, confidence.statement_confidence):
        assert f(t).exceptAll(f(t.repartition(7, "narration"))).count() == 0
    decided = ledger.qualify(t)
    assert decided.count() == t.count()


def test_confidence_of_a_clean_statement(spark):
    got = confidence.statement_confidence(statement(spark, [(None, 1000, 1000), (None, 500, 1500), (200, None, 1300)])).first()
    assert (got["confidence"], got["status"]) == (100, "AUTO_APPROVE")


def test_confidence_repairs_page_order_and_counts_expected_rows(spark):
    rows = [(1, i, 1 + i // 4, f"2024-01-{i + 1:02d}", "UPI", None, 10000, 10000 * (i + 1)) for i in range(20)]
    shuffled = [(d, n, p, *rest) for n, (d, _, p, *rest) in enumerate(sorted(rows, key=lambda r: ([3, 1, 5, 2, 4].index(r[2]), r[1])))]
    t = spark.createDataFrame(shuffled, TXNS)
    assert [r["page"] for r in confidence.in_page_order(t).orderBy("row_idx").collect()] == [1 + i // 4 for i in range(20)]
    assert confidence.statement_confidence(t).first()["confidence"] == 100
    expected = spark.createDataFrame([(1, 40)], "doc_id long, expected long")
    assert confidence.statement_confidence(t, expected).first()["confidence"] == 95


WORDS = "doc_id int, page int, tok_idx int, text string, x0 double, x1 double, y0 double, y1 double, width double"


def words_of(spark, cells, width=600.0):
    return spark.createDataFrame([(1, 1, i, t, float(x), x + 6.0 * len(t), float(y), y + 8.0, width) for i, (t, x, y) in enumerate(cells)], WORDS)


def test_a_second_date_begins_a_line(spark):
    words = words_of(spark, [("01/02/2024", 20, 10), ("rent", 100, 11), ("03/02/2024", 20, 14), ("pay", 100, 15), ("later", 30, 40)])
    lines = [r["text"] for r in pagetext.grid_lines(words).orderBy("line_no").collect()]
    assert lines == ["   01/02/2024    rent", "   03/02/2024    pay", "     later"]
    assert [r["text"] for r in pagetext.grid_lines(words, split_dates=False).orderBy("line_no").collect()][0].endswith("payt")


def test_side_bars_go_and_narrow_pages_stay(spark):
    main = [("word", 20 + 60 * (i % 5), 10 * i) for i in range(20)]
    assert pagetext.without_sidebars(words_of(spark, [*main, ("Visit", 560, 50)], 700.0)).count() == 20
    assert pagetext.without_sidebars(words_of(spark, [("a", 0, 0), ("b", 695, 0)], 700.0)).count() == 2


def merged_by_hand(lines):
    """The rule one line after the other: (line, rows)."""
    date, amount = re.compile(signals.DATE), re.compile(signals.DECIMAL)
    out = []
    for line in lines:
        if out and not any(w in line for w in pagetext.STOP_WORDS):
            last, rows = out[-1]
            safe = not (date.search(last) and date.search(line)) and not (amount.search(last) and amount.search(line)) and all(" " in (a, b) for a, b in zip(last, line))
            if safe and rows < 2:
                wide = max(len(last), len(line))
                out[-1] = ("".join(a if a != " " else b for a, b in zip(last.ljust(wide), line.ljust(wide))).rstrip(), 2)
                continue
        out.append((line, 1))
    return [x for x in out if x[0].strip()]


def test_lines_are_laid_over_as_one_by_one(spark):
    rnd = random.Random(5)
    pieces = ["", "    ", "a", "   b", "      c", "1.00", "     2.00", "01/02/2024", "            03/02/2024", "PAGE 2", "         TOTAL", " é", "                x-"]
    pages = {p: [rnd.choice(pieces) for _ in range(rnd.randint(1, 14))] for p in range(120)}
    lines = spark.createDataFrame([(1, p, i, t) for p, texts in pages.items() for i, t in enumerate(texts)], "doc_id int, page int, line_no int, text string")
    got = {}
    for r in pagetext.overlaid_lines(lines).orderBy("page", "line_no").collect():
        got.setdefault(r["page"], []).append((r["text"], r["rows"]))
    assert got == {p: m for p, texts in pages.items() if (m := merged_by_hand(texts))}


def test_line_clean_up(spark):
    texts = ["one-", "  two--", "-", "", " ", "Beware of cyber fraud", "(cid:3)x ", "y-"]
    lines = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(texts)], "doc_id int, page int, line_no int, text string")
    assert [r["text"] for r in pagetext.cleaned(lines).orderBy("line_no").collect()] == ["onetwo", "x", "y-"]
    assert values(spark, [" x", "x", "  ", " 01/02/2024", "  a b"], pagetext.is_continuation) == [True, False, False, False, True]
    assert values(spark, ["x 01/02/2024", " " * 25 + "01/02/2024"], pagetext.has_date_at_left) == [True, False]


def test_readings_of_numbers(spark):
    best = lambda c: F.transform(readings.candidates(readings.hypotheses(c)), lambda r: F.struct(r["value"], r["confidence"], r["text"]))
    cases = {
        "161835.18": [(161835.18, 0.95, "161835.18")], "1,61,835.18": [(161835.18, 0.98, "161835.18")], "61,835.18": [(61835.18, 0.98, "61835.18")], "87.034.17": [(87034.17, 0.7, "87034.17")],
        "67882.00L128": [(67882.0, 0.85, "67882.00"), (67882.00128, 0.6, "67882.00128")], "161835:18": [(161835.0, 0.85, "161835"), (161835.18, 0.8, "161835.18"), (16183518.0, 0.6, "16183518")], "87.03 4.17": [(87034.17, 0.7, "87034.17"), (87.03, 0.4, "87.03"), (4.17, 0.4, "4.17")], "CR": [], "": [], None: [], ".": [],
    }
    got = dict(zip(cases, values(spark, list(cases), best)))
    assert {k: v and [tuple(r) for r in v] for k, v in got.items()} == cases


def test_replies(spark):
    texts = ['x ```json [{"a": 1}] ```', '[{"a": 1}, {"b": [1]', "[1] and [2]", "", None, '[{"a": NaN']
    assert [r and [dict(m) for m in r] for r in values(spark, texts, replies.rows)] == [[{"a": "1"}], [], [], [], [], []]
    objects = ['{"a": True,}', '{"a": {"b": 2', '{"a": 1} {"b": 2}', "no", '{"a": 1}} x {"b": 1}']
    assert [(r["state"], r["json"]) for r in values(spark, objects, replies.object_of)] == [("read", '{"a": true}'), ("read", '{"a": {"b": 2}}'), ("invalid", None), ("missing", None), ("invalid", None)]


def test_entities_keep_evidence(spark):
    cells = [(0, "Rs", 0, 12, 0, 8), (1, "5.00", 14, 38, 1, 9), (2, "CR", 40, 52, 0, 8), (3, "far", 90, 108, 0, 8), (4, "low", 112, 130, 7, 15)]
    tokens = spark.createDataFrame([(1, 1, i, t, *map(float, xy), 0.5 + i / 10) for i, t, *xy in cells], "doc_id int, page int, tok_idx int, text string, x0 double, x1 double, y0 double, y1 double, confidence double")
    got = [(r["text"], r["strategy"], r["confidence"], r["children"]) for r in declarative.group_entities(tokens).orderBy("entity").collect()]
    assert got == [("Rs 5.00 CR", "suffix_attach", 0.5, [0, 1, 2]), ("far", None, 0.8, [3]), ("low", None, 0.9, [4])]
    assert [r["text"] for r in declarative.reconstruct_entities(tokens).orderBy("entity").collect()] == ["Rs5.00CR", "far", "low"]


def test_empty_pages(spark):
    none = words_of(spark, [("x", 0, 0)]).where("false").withColumn("confidence", F.lit(1.0))
    assert pagetext.page_lines(none).count() == cards.card_rows(none).count() == declarative.declarative_rows(none).count() == geometry.parse(none)[1].count() == entities.reading_order(none).count() == 0


def test_card_sides_and_stops(spark):
    cells = [("05/03/2024", 20, 0), ("SHOP", 100, 0), ("12.00", 320, 0), ("CR", 380, 0), ("06-Mar-2024", 20, 20), ("7.00CR", 320, 20), ("8.00", 330, 34), ("07/03/2024", 20, 60), ("Reward Summary", 90, 60), ("08/03/2024", 20, 80), ("fee", 90, 80), ("3.50", 310, 80)]
    rows = [(r["date"], r["narration"], r["debit_c"], r["credit_c"], r["reason"]) for r in cards.card_rows(words_of(spark, cells)).orderBy("block").collect()]
    assert rows[0] == ("05/03/2024", "SHOP", None, 1200, None) and rows[1] == ("06-Mar-2024", "8.00", None, 700, None)
    assert (None, None, None, None, "hit_stop_word") in rows and rows[-1] == ("08/03/2024", "fee", 350, None, None)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "one.csv").write_text('date,narration,debit,credit,balance\n05/03/2024,rent,"1,200.00",,"8,800.00"\n06-Mar-2024,pay,,500.00,"9,300.00 CR"\n')
    got = [tuple(r) for r in readers.read_statements(spark, str(tmp_path / "one.csv")).orderBy("row_idx").collect()]
    assert got[0][0].endswith("/one.csv")
    assert [("one.csv", *r[1:]) for r in got] == [("one.csv", 0, 1, "2024-03-05", "rent", 120000, None, 880000), ("one.csv", 1, 1, "2024-03-06", "pay", None, 50000, 930000)]
    (tmp_path / "l.json").write_text('{"pages": [{"page_idx": 0, "blocks": [{"lines": [{"spans": [{"text": "a", "bbox": [1, 2, 3, 4]}]}]}]}]}')
    assert [tuple(r)[1:] for r in readers.read_layout(spark, str(tmp_path / "l.json")).collect()] == [(1, 0, "a", 1.0, 2.0, 3.0, 4.0)]
    html = spark.createDataFrame([(1, 1, "<table><tr><th colspan=2>A</th><td>B</td></tr><tr><td>1</td></tr></table>")], "doc_id int, page int, html string")
    assert [tuple(r)[2:] for r in readers.table_cells(html).orderBy("row", "cell").collect()] == [(0, 0, "A", 0, 0, 280, 20), (0, 1, "B", 300, 0, 440, 20), (1, 0, "1", 0, 30, 140, 50)]
    texts = spark.createDataFrame([(1, "one" + "=" * 80 + "PAGE 2" + "=" * 80 + "two"), (2, "PAGE 1")], "doc_id int, text string")
    assert [(r["doc_id"], r["text"]) for r in readers.split_pages(texts).orderBy("doc_id", "page").collect()] == [(1, "one"), (1, "two"), (2, "PAGE 1")]
    readers.log_runs(spark.createDataFrame([("x", 3, 1)], "bank string, txns_count long, other int"), str(tmp_path / "runs"))
    runs = spark.read.parquet(str(tmp_path / "runs"))
    assert len(runs.columns) == 14 and tuple(runs.select("bank", "txns_count", "status").first()) == ("x", 3, None)
    readers.log_traces(spark.createDataFrame([("a", 1), ("b", 2)], "trace_type string, n int"), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 2
    assert readers.file_digests(spark, str(tmp_path / "one.csv")).first()["file"] == "one.csv"
    life = readers.lifecycle(spark.createDataFrame([("j", "start", 1), ("j", "end", 3), ("j", "start", 2)], "job_id string, event string, ts int")).first()
    assert life["stamps"] == {"start": 2, "end": 3} and life["timeline"] == ["start", "end"]


def test_stream_equals_batch(spark, tmp_path):
    t = views.ledger(spark, SF).where("doc_id < 20").select("doc_id", F.col("row_idx").cast("long").alias("row_idx"), "debit_c", "credit_c", "balance_c")
    for k in range(3):
        t.where((F.col("row_idx") >= 5 * k) & ((F.col("row_idx") < 5 * k + 5) | F.lit(k == 2))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = audits.stream_continuity(stream).writeStream.format("memory").queryName("continuity").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = ledger.transitions(t).where("diff_c is not null").select("doc_id", "row_idx", "diff_c", (F.abs("diff_c") <= 100).alias("ok"))
    assert sorted(map(tuple, spark.table("continuity").collect())) == sorted(map(tuple, batch.collect()))


def test_windowed_breaks(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", True), ("2024-01-01 00:20:00", False), ("2024-01-01 01:10:00", False)], "ts string, ok boolean").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["transitions"], r["breaks"]) for r in audits.windowed_breaks(rows).collect()) == [(1, 1), (2, 1)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, bool) or isinstance(v, str):
            return v
        return round(float(v), 6) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    own = sorted(got.columns)
    names = [d[0] for d in want.description]
    assert sorted(names) == own
    at = [names.index(c) for c in own]
    assert plain(got.select(*[F.col(f"`{c}`") for c in own]).collect()) == plain([tuple(r[i] for i in at) for r in want.fetchall()])


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 150
    assert set(entry.oracle_sql()) <= set(entry.queries())


def expressions(df, name):
    """How often a function stands in the plan of df."""
    return df._jdf.queryExecution().analyzed().toString().count(f"{name}(")


def test_readings_are_computed_once(spark):
    cells = spark.createDataFrame([("67882.00L128",)], "text string")
    best = cells.select(readings.select_best(readings.candidates(readings.hypotheses(F.col("text")))).alias("r"))
    assert expressions(best, "regexp_replace") <= 10
    assert best.first()["r"]["value"] == 67882.0


def test_page_chain_is_folded_in_the_jvm(spark):
    days = [None, "2024-01-05", "2024-01-01", "2024-01-09"]
    pages = spark.createDataFrame([(1, p, d) for p, d in enumerate(days, 1)] + [(2, 7, None)], "doc_id long, page int, start_date string")
    score = {(3, 1): 5, (3, 2): 5, (3, 4): 1, (1, 2): -300, (1, 4): -200}
    links = spark.createDataFrame([(1, a, b, score.get((a, b), 0)) for a in range(1, 5) for b in range(1, 5) if a != b], "doc_id long, page_a int, page_b int, score int")
    chain = ordering.page_chain(pages, links)
    assert "Pandas" not in chain._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, chain.collect())) == [(1, 1, 3), (1, 2, 1), (1, 3, 4), (1, 4, 2), (2, 1, 7)]


def test_equal_rows_are_matched_by_a_join(spark):
    from time import perf_counter

    n = 2500
    one = [(1, i, f"UPI row number {i // 2}") for i in range(n)] + [(2, 0, "Salary for May"), (2, 1, "rent"), (3, 0, "x")]
    two = [(1, i, f"upi ROW number {i // 2}") for i in range(n)] + [(2, 0, "rent paid"), (2, 5, "salary for Mai"), (2, 6, None)]
    began = perf_counter()
    rows = entities.match_rows(*[spark.createDataFrame(r, "doc_id long, row_idx int, text string") for r in (one, two)]).collect()
    assert perf_counter() - began < 30
    assert sorted((r["left_idx"], r["right_idx"]) for r in rows if r["doc_id"] == 1) == [(i, i) for i in range(n)]
    assert sorted((r["left_idx"], r["right_idx"], round(r["ratio"], 2)) for r in rows if r["doc_id"] == 2) == [(0, 5, 0.93), (1, 0, 0.8)]
    assert not [r for r in rows if r["doc_id"] == 3]


def test_tokens_of_pages_are_dealt_once(spark):
    from ledgerloom.operators import columns, pagetext

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    words = spark.createDataFrame([(1, 1, i, "a", 10 * i, 10 * i + 8, 5, 13, 1000) for i in range(3)], "doc_id long, page int, tok_idx int, text string, x0 int, x1 int, y0 int, y1 int, width int")
    assert plan(pagetext.grid_lines(pagetext.without_sidebars(words))).count("Exchange hashpartitioning") == 1
    rows, zones = words.withColumn("row_no", words.tok_idx), spark.createDataFrame([(1, "date", 0.0, 5.0)], "doc_id long, zone string, lo double, hi double")
    assert plan(columns.anchored_twice(rows, zones)).count("Aggregate(key") <= 2


def test_suppressed_texts_keep_no_entry_for_texts_of_one_page(spark):
    """Texts of one page go by a filter over sorted windows, before any aggregate by text."""
    rows = [(1, p, i, t, 10 * i, 10 * i + 8) for p in (1, 2, 3) for i, t in enumerate(["Bank of X", f"row {p}", "Page 1 of 3".replace("1", str(p)), " "])]
    found = layout.suppressed_texts(spark.createDataFrame(rows, "doc_id int, page int, tok_idx int, text string, y0 int, y1 int").repartition(2))
    assert sorted((r["norm"], r["score"]) for r in found.collect()) == [("Bank of X", 7), ("PAGE_N", 5)]
    plan = optimized(found)
    assert "Join" not in plan and plan.index("Aggregate [") < plan.index("Window [") and plan.count("Aggregate [") == 1


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_balance_candidates_parse_a_text_once(spark):
    cells = spark.createDataFrame([(1, 0, 0, "1.234.56"), (1, 0, 1, "123456"), (1, 0, 2, "n/a")], "doc_id int, row_idx int, pos int, text string").repartition(2)
    found = detect.balance_candidates(cells)
    assert sorted((r["pos"], r["value"]) for r in found.collect()) == [(0, 1234.56), (2, 123456.0), (3, 1234.56)]
    assert optimized(found).count("(?=[^.]{0,3}") == 2


def test_header_zones_number_rows_once(spark):
    words = words_of(spark, [("Date", 20, 10), ("Debit", 300, 10), ("Balance", 500, 11), ("Date", 20, 40), ("Balance", 90, 40)]).repartition(2)
    found = layout.header_zones(layout.detect_rows(words))
    assert sorted((r["zone"], r["lo"], r["hi"]) for r in found.collect()) == [("balance", 418.0, 9999.0), ("date", 0.0, 173.5), ("debit", 173.5, 418.0)]
    assert optimized(found).count("collect_list(struct(yc") == 1


def test_page_seeds_shuffle_tokens_no_more(spark):
    """A page's tokens stay where its statement's rows are: the ledger's exchange is the only one."""
    plan = QUERIES["page_seeds"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_discovery_looks_for_a_sign_once(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0, 8, "01/02/2024 UPI rent 1,200.00 4,000.00"), (1, 1, 1, 40, 48, "Account branch")], "doc_id int, page int, row_no int, y0 int, y1 int, text string").repartition(2)
    found = layout.discover_blocks(boxes)
    assert [(r["rows"], r["score"]) for r in found.collect()] == [(1, 16)]
    assert optimized(found).count("IFSC|MICR|CUSTOMER") == 1


def test_card_tokens_carry_their_readings(spark):
    rows = layout.detect_rows(words_of(spark, [("01/02/2024", 20, 10), ("SHOP", 100, 10), ("1,234.50CR", 305, 10)]))
    cells, _ = cards.block_tokens(rows, columns.zones(rows))
    assert [(r["text"], r["value"], r["marked"], r["bare"]) for r in cells.orderBy("pos").collect()][1:] == [("SHOP", None, None, None), ("1,234.50CR", 123450, 123450, 123450)]


def test_plain_amounts_are_read_like_others(spark):
    cases = ["1,234.56", "-12.00", "1,,2.34", "1,.50", "0.05", "12.345", " 7.00", "7.00 ", "7.00\n", "SHOP", "", "-", "1.2.34", "12,34", None]
    slow = lambda c: money._repaired(F.regexp_replace(money._number_run(c), r"[^\d.,\-]", ""), r"(?=[^.]{0,3}\.)-?\d*")
    frame = spark.createDataFrame([(c,) for c in cases], "c string").repartition(2)
    assert frame.where(~money.parse_amount(F.col("c")).eqNullSafe(slow(F.col("c")))).count() == 0
