"""Expressions against hand-checked vectors."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import ids, money, rects, text
from ledgerloom.operators import slip


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_company_ids(spark):
    good = ["7745470", "34626689", "7709175", "22254794", "30630040", "8609468", "14399840", "123453", "1234565", "12345674", "123456789", "9876544", "55553", "87654329", "77454781", "8745478", "27", "19"]
    bad = ["46653585", "7745478", "25", "", "1", "12345678901", "12a", None]
    assert column(spark, good + bad, ids.company_id_ok) == [True] * len(good) + [False] * len(bad)
    made = [p + str(d) for p in ("774547", "3462668", "1") for d in range(10)]
    assert sum(column(spark, made, ids.company_id_ok)) <= 3
    assert column(spark, ["1800101221144", "1800101221145", "2", None], ids.personal_id_ok) == [True, False, False, False]


def test_repair_and_candidates(spark):
    assert column(spark, ["r0@77o9i75", None], ids.repair_digits) == ["R007709175", None]
    assert column(spark, ["RO007745478", "R0Z5", "00", "RO"], ids.normal_id) == ["7745478", "25", "00", "0"]
    got = column(spark, ["7745478"], ids.id_candidates)[0]
    assert got[0] == "7745478" and {"77454781", "8745478", "7745470"} <= set(got) and len(got) == len(set(got))
    assert column(spark, ["x", None, "1"], ids.id_candidates) == [[], [], []]
    pairs = spark.createDataFrame([("123", "123"), ("123", "1234"), ("1234", "1294"), ("12345", "99345")], "a string, b string")
    assert [r[0] for r in pairs.select(ids.digit_distance(F.col("a"), F.col("b"))).collect()] == [0, 1, 1, 2]


def test_amounts_and_rounding(spark):
    lines = ["TOTAL 420,45", "COTA TVA 21,00%", "Suma de 6d7,00", "4,04 X44,74 LITRU 180,75 B", "CUI 12.34", None]
    assert column(spark, lines, money.amounts) == [[420.45], [], [], [4.04, 180.75], [], None]
    assert column(spark, [1.005, 2.675, -1.234], money.ron2, "double") == [1.0, 2.68, -1.23]
    assert column(spark, ["1.234,56", "1,234.56", "1 234.56", "1.000", "12", ""], money.parse_grouped) == [1234.56, 1234.56, 1234.56, 1000.0, 12.0, None]


def test_rates_by_date(spark):
    d = datetime.date
    got = column(spark, [None, d(2025, 7, 31), d(2025, 8, 1), d(2026, 7, 31), d(2026, 8, 1)], money.rates_at, "date")
    assert got == [[21, 11, 19, 9, 5], [19, 9, 5], [21, 11, 9], [21, 11, 9], [21, 11]]


@pytest.mark.parametrize(
    ("total", "vat", "printed", "want"),
    [
        (188.16, 32.66, None, (188.16, 32.66, True, "ocr")),
        (188.75, 31.37, [180.75], (180.75, 31.37, True, "derivat_din_tva")),
        (None, 31.84, [183.48], (183.48, 31.84, True, "derivat_din_tva")),
        (100.0, 5.0, [], (100.0, 17.36, False, "ocr")),
        (100.0, None, [], (100.0, 17.36, False, "ocr")),
        (None, None, [], (None, None, False, "lipsa")),
    ],
)
def test_reconcile(spark, total, vat, printed, want):
    df = spark.createDataFrame([(total, vat, printed)], "t double, v double, p array<double>")
    assert tuple(df.select(money.reconcile(F.col("t"), F.col("v"), F.lit(21.0), F.col("p")).alias("r")).first()["r"]) == want


def test_dates_kinds_and_accounts(spark):
    assert column(spark, ["DATA: 22/84/2826", "31.02.2026", "84.84.2026", "99.01.2026", None], text.receipt_date) == ["2026-04-22", "2026-02-31", "2026-04-04", None, None]
    assert column(spark, ["BENZINA OMV", "restaurant x", "nimic", None], text.first_rule) == ["6022", "623", "628", "628"]
    assert column(spark, ["FACTURA BON FISCAL", "BON FISCAL", "DEPOSIT", "chitanta", "motorina", "x"], text.document_kind) == ["Factură", "Bon Fiscal", "Chitanță POS", "Chitanță de mână", "Fișă Combustibil", "Necunoscut"]
    assert column(spark, ["CHITANTA SERIA NUMAR", "CHITANTA", "BON FISCAL CHITANTA SERIA NUMAR", "HITANDA SERIE NUMAR SUMA", "PRIMIT DE LA SUMA", None], text.looks_like_slip) == [True, False, False, True, True, False]
    assert column(spark, ["<a & b>"], text.html_escape) == ["&lt;a &amp; b&gt;"]


def test_ledger_balances(spark):
    df = spark.createDataFrame([(121.0, 21.0, True), (50.0, None, False), (0.0, 1.0, True), (None, 1.0, None), (10.0, 99.0, None)], "t double, v double, c boolean")
    for r in df.select("t", money.ledger_entries(F.col("t"), F.col("v"), F.lit("604"), F.col("c")).alias("e")).collect():
        credit = sum(e["amount"] for e in r["e"] if e["credit"] == "401")
        assert credit == pytest.approx(sum(e["amount"] for e in r["e"] if e["debit"] == "401")) and bool(r["e"]) == bool(r["t"])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 500)] * 4, st.integers(-5, 7)), min_size=1, max_size=20))
def test_turning_back_is_the_identity(spark, rows):
    df = spark.createDataFrame([tuple(float(x) for x in r[:4]) + (r[4],) for r in rows], "x double, y double, w double, h double, t int")
    r = F.struct("x", "y", "w", "h")
    back = rects.from_base(rects.to_base(r, F.col("t"), F.lit(900.0), F.lit(700.0)), F.col("t"), F.lit(900.0), F.lit(700.0))
    assert df.where(~(back == r)).count() == 0


def test_sums_in_words():
    say = slip.spoken_sum
    assert say("douăzeci și cinci lei") == 25 and say("trei sute patruzeci si patru lei si 77 bani") == 344.77 and say("o mie doua sute let") == 1200
    assert say("un milion lei") == 1_000_000 and say("") is None and say(None) is None and say("xyz") is None and say("150") == 150 and say("cinci lei si zece bani") == 5.10


def test_crops(spark):
    df = spark.createDataFrame([(10.0, 20.0, 100.0, 50.0)], "x double, y double, w double, h double")
    r = F.struct("x", "y", "w", "h")
    grown = df.select(rects.with_margin(r, 0.1, F.lit(115.0), F.lit(500.0), deeper=0.5).alias("r")).first()["r"]
    assert tuple(grown) == (0.0, 15.0, 115.0, 85.0)
    assert tuple(df.select(rects.from_crop(r, F.lit(5.0), F.lit(6.0), F.lit(2.0)).alias("r")).first()["r"]) == (10.0, 16.0, 50.0, 25.0)
