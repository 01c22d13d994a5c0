from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import parties, receipt, rows
from ledgerloom.plans import render
from ledgerloom.sources import boxes


def _id(spark, key):
    return spark.range(1).select(render.company_id(F.lit(key))).first()[0]


def test_sellers_and_buyers(spark):
    a, b, c = (_id(spark, k) for k in (7, 8, 9))
    said = [
        (1, 1, f"cod fiscal: R0{a.replace('0', 'O')}"), (1, 2, f"CIF CLIENT RO{b}"), (1, 3, "Client: Firma Doi S.R.L."), (1, 4, f"RO {c}"),
        (2, 1, None), (2, 2, f"Str. Lunga ro {a}"), (3, 1, "GAZ 20250114"), (3, 2, f"CARD {a}"), (3, 3, "GAZ 123456"),
        (4, 1, f"COD CLIENT {b}"), (4, 2, f"x {b}"), (4, 3, f"x {c}"), (4, 4, f"x {c}"), (5, 1, ""), (6, 1, f"CUI {b}"), (6, 2, f"CUI CLIENT {b}"), (6, 3, f"CUI {a}"),
    ]
    lines = spark.createDataFrame(said, "doc_id long, line_no int, text string").withColumn("labels", F.lit("of another"))
    got = {r["doc_id"]: r for r in parties.parties(lines.unionByName(lines)).collect()}
    brief = {k: (r["seller_id"], r["seller_ok"], r["labelled"], r["buyer_id"], r["buyer_name"]) for k, r in got.items()}
    assert brief == {
        1: (a, True, True, b, "Firma Doi S.R.L."), 2: (a, True, True, None, None), 3: ("123456", False, False, None, None),
        4: (c, True, False, b, None), 5: (None, False, False, None, None), 6: (b, True, True, b, None),
    }
    assert got[1]["candidates"][0] == a and c in got[1]["candidates"] and b not in got[1]["candidates"]
    assert got[4]["candidates"] == [c] and got[5]["candidates"] == [] and got[6]["candidates"][:2] == [b, a]
    told = spark.createDataFrame([(4, c), (4, c), (9, a)], "doc_id long, buyer_id string")
    only = parties.parties(lines.where("doc_id = 4"), told).first()
    assert (only["seller_id"], only["buyer_id"]) == (b, c)
    assert parties.parties(lines.where("doc_id < 0")).count() == 0
    known = spark.createDataFrame([(b, "BETA"), (b, "ALFA"), (None, "x")], "cui string, name string")
    named = {r["doc_id"]: (r["buyer_name"], r["buyer_known"]) for r in parties.named_buyers(parties.parties(lines), known).collect()}
    assert named[1] == named[4] == ("ALFA", True) and named[2] == (None, False) and len(named) == 6


def test_an_id_with_a_prefix_alone_is_read(spark):
    a = _id(spark, 11)
    lines = spark.createDataFrame([(1, 1, "ACASA SRL"), (1, 2, f"RO{a}"), (2, 1, f"CLIENT RO{a}")], "doc_id long, line_no int, text string")
    assert {r["doc_id"]: r["read_id"] for r in receipt.receipt_fields(lines).collect()} == {1: a, 2: None}


def test_choices_of_the_uploader(spark):
    said = [("Bon", "chitanta", True, False), ("CHITANTA", None, False, True), (None, "bon", True, False), (None, None, True, True), ("auto", "bon", True, True), (None, None, None, None)]
    df = spark.createDataFrame(said, "t string, m string, looks boolean, want boolean")
    assert all(r["got"] == r["want"] for r in df.select(text.treated_as_slip(F.col("t"), F.col("m"), F.col("looks")).alias("got"), "want").collect())
    schema = "doc_id int, kind string, kind_unsure boolean, total double, base double, vat double, rates string, vat_unsure boolean, breakdown string, account string, forced string"
    row = (None, True, 12.1, 10.0, 2.1, "21", True, "x", "604")
    docs = spark.createDataFrame([(1, *row, None), (2, *row, "Chitanță POS"), (3, *row, "Chitanță de mână"), (4, *row, "Factură"), (4, *row, "Factură")], schema)
    got = sorted(map(tuple, rows.forced_kinds(docs).drop("forced").collect()))
    slip = lambda i, kind, account: (i, kind, False, 12.1, 12.1, 0.0, "-", False, None, account)
    assert got == [(1, *row), slip(2, "Chitanță POS", "5125"), slip(3, "Chitanță de mână", "5311"), (4, "Factură", False, *row[2:]), (4, "Factură", False, *row[2:])]


def test_responses(spark):
    df = spark.createDataFrame([("u", "Chitanță", 2, "b"), ("u", "Bon Fiscal", 1, 'a"'), ("v", "Chitanță", 1, None)], "upload string, kind string, index int, name string")
    got = {r["upload"]: r["response"] for r in boxes.responses(df, "upload", ["name"]).collect()}
    first = '{"index":1,"name":"a\\""}'
    assert got["u"] == f'{{"success":true,"message":"1 bonuri, 1 chitante detectate","receipts":[{first}],"chitante":[{{"index":2,"name":"b"}}],"accounting_data":{first},"accounting_data_array":[{first},{{"index":2,"name":"b"}}]}}'
    assert got["v"].startswith('{"success":true,"message":"0 bonuri, 1 chitante detectate","receipts":[],"chitante":[{"index":1}]')
