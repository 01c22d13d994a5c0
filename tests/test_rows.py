from pyspark.sql import functions as F

from ledgerloom.functions import ids, text
from ledgerloom.operators import rows


def test_pairs_of_rates_and_vat(spark):
    said = [
        (1, 1, "TVA A 21% 7,01"), (1, 2, "TVA B 11% 37,66"), (1, 3, "TVA A 21% 99,99"),
        (2, 1, "TVA A 21% 30,00 TVA B 9% 4,50"), (3, 1, "TVA A 21% 1,00 2,00 3,00"), (4, 1, "TVA A 21% TVA B 11% 3,00"), (5, 1, None), (5, 2, "TVA A 21% 9,00"), (6, 1, "no rate 3,00"),
    ]
    lines = spark.createDataFrame(said, "doc_id long, line_no int, text string")
    pairs = rows.vat_pairs(lines)
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, 11.0, 37.66, 2), (1, 21.0, 7.01, 1), (2, 9.0, 4.5, 2), (2, 21.0, 30.0, 1), (3, 21.0, 3.0, 1)]
    totals = spark.createDataFrame([(1, 420.45), (2, None), (3, 5.0)], "doc_id long, total double")
    got = {r["doc_id"]: r for r in rows.multi_rate(pairs, totals).collect()}
    assert set(got) == {1, 2} and got[1]["rates"] == "21, 11" and got[1]["vat_total"] == 44.67 and got[1]["base_total"] == 375.74
    assert got[1]["verified"] is True and got[1]["warning"] is None and got[2]["verified"] is None
    assert rows.vat_pairs(lines.where("doc_id < 0")).count() == 0


def test_a_row_for_each_rate(spark):
    b = "array<struct<rate: double, base: double, vat: double>>"
    docs = spark.createDataFrame([(1, 10.0, [(21.0, 100.0, 21.0), (11.0, 50.0, 5.5)]), (2, 119.0, [(19.0, 100.0, 19.5)]), (3, None, [(19.0, 100.0, 19.0)]), (4, 7.0, []), (5, None, None)], f"doc_id long, total double, breakdown {b}")
    got = sorted((r["doc_id"], r["rate"] or 0, r["total"]) for r in rows.split_by_rate(docs).collect())
    assert got == [(1, 11.0, 55.5), (1, 21.0, 121.0), (2, 19.0, 119.0), (3, 19.0, 119.0), (4, 0, 7.0), (5, 0, None)]


def test_rows_of_both_kinds_accounts_and_templates(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0, "u"), (2, None, None, "u")], "doc_id long, total double, vat double, upload string")
    flat = rows.receipt_rows(df).unionByName(rows.slip_rows(df))
    assert [c for c in flat.columns if c != "doc_id"] == list(rows.ROW)
    assert {(r["kind"], r["doc_id"], r["vat"]) for r in flat.collect()} == {("Bon Fiscal", 1, 1.0), ("Bon Fiscal", 2, None), ("Chitanță", 1, None), ("Chitanță", 2, None)}
    numbered = rows.reindexed(flat.join(df.select("doc_id", "upload"), "doc_id"))
    assert [(r["index"], r["kind"], r["doc_id"]) for r in numbered.orderBy("index").collect()] == [(1, "Bon Fiscal", 1), (2, "Bon Fiscal", 2), (3, "Chitanță", 1), (4, "Chitanță", 2)]
    rules = spark.createDataFrame([(1, "lidl", "602"), (0, "OMV", "6022")], "ordinal int, keyword string, account string")
    shops = spark.createDataFrame([(1, "omv by Lidl"), (2, "Lidl"), (3, None)], "k long, t string")
    assert sorted(map(tuple, rows.keyword_accounts(shops, rules, "k", "t", "628").collect())) == [(1, "6022"), (2, "602"), (3, "628")]
    out = rows.export_rows(df, ["Total", "Else"], {"total": F.col("total").cast("string")})
    assert [tuple(r) for r in out.collect()] == [("5.0", ""), ("", "")]


def test_trade_register_drinks_and_bytes(spark):
    df = spark.createDataFrame([("x J40 / 1234/ 2020 y",), ("j1/2/1999",), ("J40/1/2120",), (None,)], "t string")
    assert [r[0] for r in df.select(ids.trade_register(F.col("t"))).collect()] == ["J40/1234/2020", "J1/2/1999", None, None]
    df = spark.createDataFrame([("Pizza cu bere",), ("PIZZA",), ("bere",), (None,)], "t string")
    assert [r[0] for r in df.select(text.mixed_rates(F.col("t"))).collect()] == [True, False, False, False]
    n = spark.createDataFrame([(0,), (9,), (1023,), (1024,), (1280,), (10_240,), (3 * 1024**4,), (5000 * 1024**4,), (None,)], "n long")
    assert [r[0] for r in n.select(text.bytes_text(F.col("n"))).collect()] == ["0.0 B", "9.0 B", "1023 B", "1.0 KB", "1.2 KB", "10 KB", "3.0 TB", "5000 TB", None]
