"""Operators on small fixtures, and the catalog's contract."""

import json

import pytest

import __spark_entry__ as entry
from ledgerloom import catalog
from ledgerloom.operators import folds, receipt, registry, segment, slip
from ledgerloom.sources import boxes


def lines(spark, *docs):
    return spark.createDataFrame([(d, n, t) for d, doc in enumerate(docs) for n, t in enumerate(doc)], "doc_id long, line_no long, text string")


def test_totals_by_tier(spark):
    got = receipt.receipt_totals(
        lines(
            spark,
            ["SUBTOTAL 1,00", "TOTAL: 59.50", "TOTAL TVA 9.50"],
            ["TOTAL", "COTA TVA 21,00 %", "TOTAL TVA 106,41", "REST 700,00", "bani 4.14 613.10"],
            ["CARD 12,30", "x 12,30", "y 99,10"],
            ["TOTAL 21,00", "nothing"],
            ["only words", None],
            ["CUI 33,33 44,44", "TRX 33,33"],
        )
    )
    assert {r["doc_id"]: r["total"] for r in got.collect()} == {0: 59.5, 1: 613.1, 2: 12.3, 3: None, 4: None, 5: None}


def test_item_total_with_discount_and_doubles(spark):
    got = receipt.item_totals(lines(spark, ["GOOD GIRL 443.00 A", "GOOD GIRL 443.00 A A", "BAD BOY 243.00 A", "72.90-A 72.90-A", "TOTAL 613.10 A"]))
    assert [r["item_total"] for r in got.collect()] == [613.1]


def test_fields_and_resolution(spark):
    docs = receipt.receipt_fields(lines(spark, ["MOL ROMANIA SRL", "CLIENT CUI 30630040", "COD FISCAL: R07745478", "DATA: 14.05.2026", "BF 0012", "NON CASH"], ["x", "CARD"]))
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert rows[0]["read_id"] == "7745478" and rows[0]["date"] == "2026-05-14" and rows[0]["number"] == "12" and rows[0]["payment"] == "numerar" and rows[1]["payment"] == "card"
    reg = spark.createDataFrame([("7745470", "MOL ROMANIA PETROLEUM SRL"), ("8745478", "HAGIU PF"), ("7745470", "MOL ROMANIA PETROLEUM SRL")], "cui string, name string")
    got = {r["doc_id"]: (r["cui"], r["status"]) for r in registry.resolve(docs, reg).collect()}
    assert got[0][0] == "7745470" and got[1] == (None, "fara_cui")


def test_lines_do_not_depend_on_row_order(spark):
    rows = [(1, i, t, x, y, 40.0, 10.0) for i, (t, x, y) in enumerate([("b", 50.0, 1.0), ("a", 0.0, 0.0), ("A", 3.0, 0.5), ("c", 0.0, 30.0), ("c", 60.0, 32.0), (" ", 0.0, 60.0)])]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, box_id long, text string, x double, y double, w double, h double")
        kept = folds.dedupe_words(df, "doc_id")
        assert sorted(r["text"] for r in folds.group_lines(kept, "doc_id").collect()) == ["a b", "c"]


def test_suppression_and_repeats(spark):
    det = spark.createDataFrame([(1, i, x, 0.0, 100.0, 200.0, s) for i, (x, s) in enumerate([(0.0, 5.0), (10.0, 9.0), (300.0, 1.0), (305.0, 1.0)])], "page long, det_id long, x double, y double, w double, h double, score double")
    assert {r["det_id"] for r in folds.suppress(det, "page").collect()} == {1, 2}
    fields = "page long, rec_id long, cui string, total double, date string, x double, y double, w double, h double, completeness double"
    rec = spark.createDataFrame([(1, 0, "1234", 10.0, "d", 0.0, 0.0, 9.0, 9.0, 9.0), (1, 1, "1234", 20.0, "d", 50.0, 0.0, 9.0, 9.0, 8.0), (1, 2, "1234", 10.01, "e", 99.0, 0.0, 9.0, 9.0, 7.0), (1, 3, None, 10.0, "d", 500.0, 0.0, 9.0, 9.0, 6.0), (1, 4, None, None, None, 700.0, 0.0, 9.0, 9.0, 5.0)], fields)
    assert {r["rec_id"] for r in folds.dedupe_receipts(rec, "page").collect()} == {0, 1}


def test_segmentation_is_a_partition(spark):
    b = [(p, 100 * c + i, "word", 500.0 * (c % 3) + 60 * (i % 3), 600.0 * (c // 3) + 16 * (i // 3), 50.0, 12.0) for p in range(2) for c in range(6) for i in range(15)]
    b += [(0, 9000 + i, "few", 5000.0 + i, 0.0, 5.0, 12.0) for i in range(3)]
    got = segment.segment(spark.createDataFrame(b, "page long, box_id long, text string, x double, y double, w double, h double"), "page").collect()
    assert len({(r["page"], r["box_id"]) for r in got}) == len(got) == 180
    assert {(r["page"], r["box_id"] // 100, r["cluster"]) for r in got} == {(p, c, [0, 2, 4, 1, 3, 5][c]) for p in range(2) for c in range(6)}


def test_pieces_of_one_document_are_joined(spark):
    def words(x, y, *lines):
        return [(t, x + 55.0 * i, y + 16.0 * n) for n, line in enumerate(lines) for i, t in enumerate(line.split())]

    slip_body = words(0, 0, "am primit de la firma X SRL", "adresa strada lunga numarul zece", "suma de 344,77 adica trei sute")
    slip_title = words(700, 0, "CHITANTA", "Seria DSE", "Numar 12", "data 14.05.2026 la sediul", "firmei noastre din oras")
    head = words(0, 500, "MAGAZIN UNU SRL str mare", "COD FISCAL 7745470 oras", "BON FISCAL seria doi trei")
    body = words(0, 580, "paine 2,00 A lapte 3,00 A", "TOTAL 5,00 lei plata CARD", "multumim va mai asteptam aici")
    other = words(0, 660, "MAGAZIN DOI SRL str mica", "COD FISCAL 34626689 oras", "TOTAL 9,00 NUMERAR lei platit")
    stray = words(600, 590, "rest 0,00")
    rows = [(1, i, t, x, y, 50.0, 12.0) for i, (t, x, y) in enumerate(slip_body + slip_title + head + body + other + stray)]
    got = segment.segment(spark.createDataFrame(rows, "page long, box_id long, text string, x double, y double, w double, h double"), "page").collect()
    by = {}
    for r in got:
        by.setdefault(r["cluster"], set()).add(r["box_id"])
    n = [len(x) for x in (slip_body, slip_title, head, body, other, stray)]
    ends = [sum(n[: i + 1]) for i in range(6)]
    sets = [set(range(e - k, e)) for e, k in zip(ends, n, strict=True)]
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, [sets[0] | sets[1], sets[2] | sets[3] | sets[5], sets[4]]))


def test_slips(spark):
    s = spark.createDataFrame([(1, "a", None, "1", "d", None), (2, "a", None, "1", "d", None), (3, "a", None, "1", "d", 5.0)], "slip_id long, issuer string, series string, number string, date string, amount double")
    assert {r["slip_id"] for r in slip.distinct_slips(s).collect()} == {1, 3}
    v = spark.range(1).select(slip.digit_variants(slip.F.lit("1D8"), {"D": "04", "8": "83"}).alias("v")).first()["v"]
    assert v == ["108", "103", "148", "143"]


def test_box_dumps(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"text": "x", "x": 1, "y": 2, "w": 3, "h": 4}, {"t": "y", "x": 1, "y": 2, "w": 3, "h": 4}]))
    assert [(r["box_id"], r["text"]) for r in boxes.read_box_dumps(spark, str(tmp_path)).orderBy("box_id").collect()] == [(0, "x"), (1, "y")]


def test_entry_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(catalog.ORACLES) <= set(catalog.QUERIES) and len(q) >= 50
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["reconcile_branches", "ledger_entries", "segment_plate", "stream_queue_expand"])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "lineitem", "supplier", "documents", "events", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    mine = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    theirs = con.execute(catalog.ORACLES[name]).fetchdf()
    rows = lambda d: sorted(tuple("" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False, name=None))
    a, b = rows(mine), rows(theirs)
    assert len(a) == len(b) and sorted(mine.columns) == sorted(theirs.columns)
    as_float = lambda rs: sorted(tuple(f"{float(v):.6g}" if v.replace(".", "", 1).replace("-", "", 1).replace("e+", "", 1).isdigit() else v for v in r) for r in rs)
    assert as_float(a) == as_float(b)
