"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom import oracles as O
from ledgerloom.functions import ids, money, rects, text
from ledgerloom.operators import arbitration, folds, orientation, parties, receipt, registry, rows, segment, slip, slip_reader, spatial
from ledgerloom.plans import render
from ledgerloom.sources import boxes
from ledgerloom.streaming import jobs, state

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# --- fields of printed receipts --------------------------------------------------------------------------------------


@query(O.with_heads("SELECT doc_id, total / 100.0 AS total FROM heads"))
def receipt_total_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return receipt.receipt_totals(render.receipt_lines(spark, d))


# an amount that equals a rate is never read as one, so such VAT is recomputed from the total
_NO_AMOUNT = "(500, 900, 1100, 1900, 2100)"


@query(O.with_heads(f"SELECT doc_id, CAST(rate AS DOUBLE) AS rate, vat / 100.0 AS amount FROM heads WHERE vat NOT IN {_NO_AMOUNT}"))
def receipt_vat_lines(spark: SparkSession, d: str) -> DataFrame:
    return receipt.vat_lines(render.receipt_lines(spark, d)).select("doc_id", "rate", "amount")


@query(O.with_heads("""
SELECT h.doc_id, upper(s_name) || ' SRL' AS header, CASE WHEN h.doc_id % 5 = 1 THEN left(cui, 7) ELSE cui END AS read_id, strftime(date, '%Y-%m-%d') AS date,
  CAST(h.doc_id AS VARCHAR) AS number, CASE WHEN cash THEN 'numerar' ELSE 'card' END AS payment FROM heads h JOIN supplier ON s_suppkey = seller"""))
def receipt_header_fields(spark: SparkSession, d: str) -> DataFrame:
    return receipt.receipt_fields(render.receipt_lines(spark, d)).select("doc_id", "header", "read_id", "date", "number", "payment")


@query(O.with_heads(f"SELECT doc_id, total / 100.0 AS total, vat / 100.0 AS vat, CAST(rate AS DOUBLE) AS rate, vat NOT IN {_NO_AMOUNT} AS verified, 'ocr' AS total_source FROM heads"))
def full_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return arbitration.read_receipts(render.receipt_lines(spark, d)).select("doc_id", "total", "vat", "rate", "verified", "total_source")


# ten kinds of receipt whose lines leave each rule of the arbitration its case; amounts come from the order's price
_ARBITRATED = """
WITH o AS (
  SELECT o_orderkey AS doc_id, (o_orderkey // 4 + o_orderkey) % 10 AS k, o_orderkey AS key, CAST(o_orderdate + INTERVAL 28 YEAR AS DATE) AS date, 100000 + CAST(floor(o_totalprice) AS BIGINT) % 400000 AS t FROM orders),
p AS (SELECT *, CASE WHEN date < DATE '2025-08-01' THEN 19 ELSE 21 END AS r, CASE WHEN date < DATE '2025-08-01' THEN 9 ELSE 11 END AS r2, (40 + key % 100) * (700 + key % 90) AS f FROM o),
v AS (SELECT *, (2 * t * r + 100 + r) // (2 * (100 + r)) AS v, t // 300 AS m1, t // 700 + 1 AS m2, (2 * f * r + 100 + r) // (2 * (100 + r)) AS fv FROM p),
w AS (SELECT *, CASE k WHEN 6 THEN (100 + r) * m1 + (100 + r2) * m2 + CASE WHEN key % 2 = 1 THEN 500 ELSE 0 END WHEN 7 THEN f WHEN 9 THEN NULL ELSE t END AS total FROM v)
SELECT doc_id, CAST(total AS BIGINT) / 100.0 AS total, CAST(CASE k WHEN 6 THEN r * m1 + r2 * m2 WHEN 7 THEN fv WHEN 9 THEN NULL ELSE v END AS BIGINT) / 100.0 AS vat,
  CASE WHEN k = 6 THEN key % 2 = 0 ELSE k NOT IN (5, 8, 9) END AS verified,
  CASE WHEN k IN (1, 2, 5, 7) THEN 'derivat_din_articole' WHEN k IN (3, 4) THEN 'derivat_din_tva' WHEN k = 9 THEN 'lipsa' ELSE 'ocr' END AS total_source,
  CASE k WHEN 6 THEN 2 WHEN 9 THEN 0 ELSE 1 END AS n_rates,
  CASE k WHEN 1 THEN 'total rebuilt from items' WHEN 3 THEN 'total by the VAT: a product line' WHEN 4 THEN 'total by the VAT: a printed amount'
    WHEN 5 THEN 'rate not read: VAT by the usual one; VAT computed from the total: none was read'
    WHEN 6 THEN CASE WHEN key % 2 = 1 THEN 'total differs from bases and VAT of several rates' ELSE '' END
    WHEN 7 THEN 'rate not read: VAT by the usual one; VAT computed from the total: none was read; total by litres and price'
    WHEN 8 THEN 'VAT recomputed from the total: the read one disagrees' WHEN 9 THEN 'no rate: VAT not computed; total not read' ELSE '' END AS warnings
FROM w"""


@query(_ARBITRATED)
def receipt_arbitration(spark: SparkSession, d: str) -> DataFrame:
    """A total with the rule that chose it and its warnings, of receipts that each lack or misprint something else."""
    o = render.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr("(o_orderkey div 4 + o_orderkey) % 10").alias("k"), F.add_months(F.col("o_orderdate").cast("date"), 12 * render.YEARS).alias("date"), F.expr("100000 + cast(floor(o_totalprice) as bigint) % 400000").alias("t"))
    old = F.col("date") < F.lit("2025-08-01").cast("date")
    o = o.withColumn("r", F.when(old, 19).otherwise(21)).withColumn("r2", F.when(old, 9).otherwise(11))
    o = o.withColumns({"v": F.expr("(2 * t * r + 100 + r) div (2 * (100 + r))"), "m1": F.expr("t div 300"), "m2": F.expr("t div 700 + 1"), "l": F.expr("40 + doc_id % 100"), "p": F.expr("700 + doc_id % 90")})
    o = o.withColumn("s", F.expr("(100 + r) * m1 + (100 + r2) * m2 + doc_id % 2 * 500"))
    say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    m = lambda e: render.money(F.expr(e))
    vat = lambda e: say("TOTAL TVA A ", F.col("r"), ",00% ", m(e))
    total = lambda e: say("TOTAL ", m(e))
    product, items = say("MARFA BUC ", m("t"), " G"), (say("PAINE X1 ", m("t div 3"), " A"), say("LAPTE X1 ", m("t - t div 3"), " A"))
    several = (total("s"), say("TVA A ", F.col("r"), ",00% ", m("r * m1")), say("TVA B ", F.col("r2"), ",00% ", m("r2 * m2")))
    fuel = say("MOTORINA ", F.col("l"), ".00 X ", m("p"), " L ", m("l * p"), " B")
    kinds = [(total("t"), vat("v")), (*items, vat("v")), (product, vat("v")), (product, total("t + 800"), vat("v")), (total("t + 800"), vat("v"), say("CARD ", m("t"))), (*items, total("t div 4")), several, (fuel, total("l * p + 300")), (total("t"), vat("v + 150")), ()]
    body = F.array().cast("array<string>")
    for k, said in enumerate(kinds):
        body = F.when(F.col("k") == k, F.array(*said)).otherwise(body) if said else body
    said = F.concat(F.array(F.lit("MAGAZIN SRL"), F.lit("COD FISCAL: RO7745478"), F.concat(F.lit("DATA: "), F.date_format("date", "dd.MM.yyyy"))), body)
    lines = o.select("doc_id", F.posexplode(said).alias("line_no", "text"))
    out = arbitration.read_receipts(lines)
    return out.select("doc_id", "total", "vat", "verified", "total_source", F.size("vat_lines").alias("n_rates"), F.array_join("warnings", "; ").alias("warnings"))


@query(f"""
WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, {O.CENTS} AS c, lag({O.CENTS}) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {O.CENTS}) AS b FROM lineitem WHERE {O.CENTS} NOT IN (500, 900, 1100, 1900, 2100))
SELECT l_orderkey AS doc_id, sum(c)::BIGINT / 100.0 AS item_total FROM i WHERE b IS NULL OR b <> c GROUP BY l_orderkey""")
def item_sum_collapse(spark: SparkSession, d: str) -> DataFrame:
    item = render.table(spark, d, "lineitem")
    cents = F.floor("l_extendedprice").cast("long")
    # lines are numbered by number and amount, so that equal numbers keep one order
    lines = item.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber").cast("long") * 10_000_000_000 + cents).alias("line_no"), F.concat(F.lit("item "), render.money(cents), F.lit(" A")).alias("text"))
    return receipt.item_totals(lines)


@query(f"""
WITH c AS (SELECT l_orderkey AS doc_id, {O.CENTS} // 1000 * 1000 + 1000 AS v FROM lineitem), n AS (SELECT doc_id, v, count(*) AS n FROM c GROUP BY doc_id, v HAVING count(*) >= 2)
SELECT doc_id, max(v) / 100.0 AS total FROM n GROUP BY doc_id""")
def amount_frequency_mode(spark: SparkSession, d: str) -> DataFrame:
    rounded = F.expr("floor(l_extendedprice) div 1000 * 1000 + 1000").cast("long")
    lines = render.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("line_no"), F.concat(F.lit("pay "), render.money(rounded)).alias("text"))
    return receipt.receipt_totals(lines).where("total IS NOT NULL")


@query(f"""
SELECT o_orderkey AS doc_id, o_totalprice AS price, length(o_orderpriority) AS n, {O.ron2("o_totalprice")} AS r2, floor(o_totalprice) * 1.0 AS parsed FROM orders""")
def amount_parsing(spark: SparkSession, d: str) -> DataFrame:
    """Amounts with thousands separators read back, and rounding."""
    o = render.table(spark, d, "orders")
    grouped = F.concat(F.format_number(F.floor("o_totalprice"), 0), F.lit(".00"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("price"), F.length("o_orderpriority").cast("long").alias("n"), money.ron2(F.col("o_totalprice")).alias("r2"), money.parse_grouped(grouped).alias("parsed"))


@query(f"""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate + INTERVAL 28 YEAR AS DATE) AS d FROM orders)
SELECT o_orderkey AS doc_id, {O.VAT_PERIODS_SQL} AS rates, NOT contains(',' || {O.VAT_PERIODS_SQL} || ',', ',9,') AS warns_nine FROM o""")
def vat_rate_validity_join(spark: SparkSession, d: str) -> DataFrame:
    o = render.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.add_months(F.col("o_orderdate").cast("date"), 336).alias("d"))
    periods = spark.createDataFrame([(a, b, list(r)) for a, b, r in money.VAT_PERIODS], "a string, b string, rates array<double>").select(F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"), "rates")
    joined = o.join(F.broadcast(periods), F.col("d").between(F.col("a"), F.col("b")))  # three rows, whatever the input
    return joined.select("doc_id", F.array_join(F.transform("rates", lambda r: r.cast("int").cast("string")), ",").alias("rates"), money.rate_warning(F.lit(9.0), F.col("d")).isNotNull().alias("warns_nine"))


_RECONCILE_IN = f"""
x AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 = 1 THEN t + 8 ELSE t END AS total,
  CASE WHEN o_orderkey % 5 = 3 THEN NULL ELSE {O.ron2("t * 21 / 121")} + CASE WHEN o_orderkey % 5 = 2 THEN 5 ELSE 0 END END AS vat, t AS printed FROM (SELECT o_orderkey, floor(o_totalprice) / 100 AS t FROM orders))"""


@query(f"""
WITH {_RECONCILE_IN}, y AS (SELECT *, {O.ron2("vat * 121 / 21")} AS implied FROM x), z AS (SELECT *, CASE WHEN abs(printed - implied) <= 0.06 THEN printed END AS m FROM y)
SELECT doc_id,
  CASE WHEN total IS NOT NULL AND vat IS NOT NULL AND abs(vat - total * 21 / 121) <= 0.06 THEN total WHEN m IS NOT NULL THEN m ELSE total END AS total,
  CASE WHEN total IS NOT NULL AND vat IS NOT NULL AND abs(vat - total * 21 / 121) <= 0.06 THEN vat WHEN m IS NOT NULL THEN vat WHEN total IS NOT NULL THEN {O.ron2("total * 21 / 121")} ELSE vat END AS vat,
  coalesce(total IS NOT NULL AND vat IS NOT NULL AND abs(vat - total * 21 / 121) <= 0.06, false) OR m IS NOT NULL AS verified,
  CASE WHEN coalesce(abs(vat - total * 21 / 121) <= 0.06, false) THEN 'ocr' WHEN m IS NOT NULL THEN CASE WHEN total IS NULL OR abs(total - m) > 0.06 THEN 'derivat_din_tva' ELSE 'ocr' END WHEN total IS NOT NULL THEN 'ocr' ELSE 'lipsa' END AS source
FROM z""")
def reconcile_branches(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("o_orderkey") % 5, F.floor("o_totalprice") / 100
    o = render.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.when(k == 4, None).when(k == 1, t + 8).otherwise(t).alias("total"),
        F.when(k == 3, None).otherwise(money.ron2(t * 21 / 121) + F.when(k == 2, 5).otherwise(0)).alias("vat"),
        F.array(t).alias("printed"),
    )
    return o.select("doc_id", money.reconcile(F.col("total"), F.col("vat"), F.lit(21.0), F.col("printed")).alias("r")).select("doc_id", "r.*")


# --- identifiers and the registry ------------------------------------------------------------------------------------


@query(f"SELECT c_custkey AS k, CAST(1000 + c_custkey * 7 AS VARCHAR) AS cui, {O.id_ok_sql('CAST(1000 + c_custkey * 7 AS VARCHAR)')} AS ok, {O.id_ok_sql(O.company_id_sql('c_custkey'))} AS made_ok FROM customer")
def id_checksum(spark: SparkSession, d: str) -> DataFrame:
    c = render.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (1000 + F.col("c_custkey") * 7).cast("string").alias("cui"))
    return c.select("k", "cui", ids.company_id_ok(F.col("cui")).alias("ok"), ids.company_id_ok(render.company_id(F.col("k"))).alias("made_ok"))


@query(f"SELECT s_suppkey AS k, {O.company_id_sql('s_suppkey')} AS cui FROM supplier")
def id_repair(spark: SparkSession, d: str) -> DataFrame:
    s = render.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("RO0"), F.translate(render.company_id(F.col("s_suppkey")), "01258", "oiZSb")).alias("seen"))
    return s.select("k", ids.normal_id(F.upper("seen")).alias("cui"))


_ADDED = ", ".join(f"'{i}'" for i in range(10))


@query(f"""
WITH s AS (SELECT s_suppkey AS k, {O.company_id_sql('s_suppkey')} AS c FROM supplier), r AS (SELECT k, left(c, 7) AS d FROM s), n AS (SELECT unnest([{_ADDED}]) AS x),
g AS (SELECT k, d || x AS v FROM r, n UNION SELECT k, d || a.x || b.x FROM r, n a, n b UNION SELECT k, substr(d, 2) FROM r UNION SELECT k, left(d, 6) FROM r
  UNION SELECT k, substr(d, 1, i - 1) || x || substr(d, i + 1) FROM r, n, (SELECT unnest(range(1, 8)) AS i) p),
ok AS (SELECT k, v FROM g WHERE {O.id_ok_sql('v')} UNION SELECT k, d FROM r)
SELECT k, count(*) AS n, string_agg(v, ',' ORDER BY v) AS candidates FROM ok GROUP BY k""")
def id_candidates(spark: SparkSession, d: str) -> DataFrame:
    s = render.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.substring(render.company_id(F.col("s_suppkey")), 1, 7).alias("d"))
    s = s.select("k", ids.id_candidates(F.col("d")).alias("c"))
    return s.select("k", F.size("c").cast("long").alias("n"), F.array_join(F.array_sort("c"), ",").alias("candidates"))


@query(O.with_heads("SELECT doc_id, cui, upper(s_name) || ' SRL' AS name FROM heads JOIN supplier ON s_suppkey = seller WHERE doc_id % 5 <> 1"))
def registry_lookup_join(spark: SparkSession, d: str) -> DataFrame:
    """The read form of each id against the registry."""
    docs = receipt.receipt_fields(render.receipt_lines(spark, d)).select("doc_id", F.col("read_id").alias("cui"))
    return docs.join(render.registry(spark, d), "cui").select("doc_id", "cui", "name")


@query(O.with_heads("SELECT doc_id, cui FROM heads"))
def registry_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Damaged ids find their company among all their candidates, told by its name."""
    docs = receipt.receipt_fields(render.receipt_lines(spark, d)).select("doc_id", "header", "read_id")
    return registry.resolve(docs, render.registry(spark, d)).select("doc_id", "cui")


@query("""
WITH t AS (SELECT p_partkey AS k, p_name AS n, list_distinct(list_concat(list_filter(string_split(upper(p_name), ' '), lambda w: length(w) > 2), list_transform(list_filter(range(4, 9), lambda i: length(replace(p_name, ' ', '')) >= i), lambda i: substr(upper(replace(p_name, ' ', '')), 1, i)))) AS a,
  list_distinct(list_concat(list_filter(string_split(upper(p_type || ' RING'), ' '), lambda w: length(w) > 2), list_transform(range(4, 9), lambda i: substr(upper(replace(p_type || 'RING', ' ', '')), 1, i)))) AS b, p_type || ' RING' AS m FROM part)
SELECT k, least(1.0, len(list_intersect(a, b)) / least(len(a), len(b)) + 0.15 * len(list_filter(a, lambda x: length(x) >= 4 AND contains(upper(replace(m, ' ', '')), x))) + 0.10 * len(list_filter(b, lambda x: length(x) >= 4 AND contains(upper(replace(n, ' ', '')), x)))) AS score FROM t""")
def name_match_score(spark: SparkSession, d: str) -> DataFrame:
    p = render.table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name", F.concat("p_type", F.lit(" RING")).alias("m"))
    return p.select("k", text.name_score(F.col("p_name"), F.col("m")).alias("score"))


@query("SELECT p_partkey AS k, levenshtein(upper(p_name), 'SMALL RING') <= 4 AS near FROM part")
def fuzzy_label(spark: SparkSession, d: str) -> DataFrame:
    return render.table(spark, d, "part").select(F.col("p_partkey").alias("k"), text.fuzzy_equal(F.col("p_name"), F.lit("small ring"), 4).alias("near"))


# --- accounts and ledger ---------------------------------------------------------------------------------------------

_SHOPS = ("omv", "engie", "orange", "fan courier", "hotel", "vulcanizare", "rca", "bcr", "notar", "chirie", "reclama", "pizza", "laptop", "dedeman", "toner", "catena", "lidl", "peaj", "parcare", "x")
_SHOP_SQL = "CASE p_partkey % 20 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SHOPS)) + " END"


@query(f"SELECT p_partkey AS k, {O.rules_sql(f'({_SHOP_SQL} || chr(32) || p_name)')} AS account FROM part")
def account_by_rules(spark: SparkSession, d: str) -> DataFrame:
    shop = F.element_at(F.array(*map(F.lit, _SHOPS)), (F.col("p_partkey") % 20 + 1).cast("int"))
    return render.table(spark, d, "part").select(F.col("p_partkey").alias("k"), text.first_rule(F.concat(shop, F.lit(" "), F.col("p_name"))).alias("account"))


@query("SELECT p_partkey AS k, CASE WHEN contains(upper(p_name), 'RING') THEN '6022' WHEN contains(upper(p_name), 'SMALL') THEN '604' ELSE '602' END AS account FROM part")
def account_user_rules(spark: SparkSession, d: str) -> DataFrame:
    """Ordered keyword rules of a user as a table: the first that the text holds."""
    rules = spark.createDataFrame([(0, "RING", "6022"), (1, "SMALL", "604")], "ordinal int, keyword string, account string")
    return rows.keyword_accounts(render.table(spark, d, "part").withColumn("k", F.col("p_partkey")), rules, "k", "p_name", "602")


@query(O.with_heads(f"""
, e AS (SELECT doc_id, total / 100.0 AS t, vat / 100.0 AS v, cash FROM heads)
SELECT doc_id, '604' AS debit, '401' AS credit, {O.ron2('t - v')} AS amount FROM e UNION ALL SELECT doc_id, '4426', '401', {O.ron2('v')} FROM e WHERE v > 0
UNION ALL SELECT doc_id, '401', CASE WHEN cash THEN '5311' ELSE '5125' END, {O.ron2('t')} FROM e"""))
def ledger_entries(spark: SparkSession, d: str) -> DataFrame:
    h = render.receipt_heads(spark, d)
    e = h.select("doc_id", F.explode(money.ledger_entries(F.col("total") / 100, F.col("vat") / 100, F.lit("604"), F.col("cash"))).alias("e"))
    return e.select("doc_id", "e.*")


@query("""
SELECT l_orderkey AS doc_id, CASE WHEN l_returnflag = 'A' THEN 21 ELSE 11 END AS rate, sum(CAST(floor(l_extendedprice) AS BIGINT))::BIGINT AS base,
  (sum(CAST(floor(l_extendedprice) AS BIGINT)) * any_value(CASE WHEN l_returnflag = 'A' THEN 21 ELSE 11 END) // 100)::BIGINT AS vat FROM lineitem GROUP BY 1, 2""")
def vat_split_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per document and VAT rate."""
    rate = F.when(F.col("l_returnflag") == "A", 21).otherwise(11)
    return rows.by_rate(render.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), rate.alias("rate"), F.floor("l_extendedprice").cast("long").alias("base")))


@query("SELECT rate, n, total FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'Bon Fiscal' ELSE 'Chitanță' END AS rate, count(*) AS n, sum(CAST(floor(o_totalprice) AS BIGINT))::BIGINT AS total FROM orders GROUP BY 1)")
def legacy_rows(spark: SparkSession, d: str) -> DataFrame:
    """Receipts and slips flattened to one kind of row, then counted by kind."""
    o = render.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.floor("o_totalprice").cast("long").alias("total"))
    flat = rows.receipt_rows(o.where("doc_id % 2 = 0")).unionByName(rows.slip_rows(o.where("doc_id % 2 <> 0")))
    return flat.groupBy(F.col("kind").alias("rate")).agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("total"))


@query("""
SELECT o_orderkey AS doc_id, o_custkey AS upload, kind, row_number() OVER (PARTITION BY o_custkey ORDER BY kind, o_orderkey) AS index
FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'Chitanță' ELSE 'Bon Fiscal' END AS kind FROM orders)""")
def reindexed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an upload numbered anew: receipts first, then slips."""
    o = render.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("upload"))
    flat = rows.receipt_rows(o.where("doc_id % 3 <> 0")).unionByName(rows.slip_rows(o.where("doc_id % 3 = 0")))
    return rows.reindexed(flat.join(o, "doc_id")).select("doc_id", "upload", "kind", "index")


_BY_RATE_SQL = """
WITH g AS (
  SELECT l_orderkey AS doc_id, CASE WHEN l_returnflag = 'A' THEN 21 WHEN l_returnflag = 'N' THEN 11 ELSE 9 END AS rate, sum(CAST(floor(l_extendedprice / 100) AS BIGINT))::BIGINT AS base
  FROM lineitem GROUP BY 1, 2),
p AS (SELECT * FROM g WHERE base * rate NOT IN (500, 900, 1100, 1900, 2100))
"""


def _rate_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lines that state the VAT of each rate of an order, with the rate's letter, and the orders' totals, every third of which is off."""
    rate = F.when(F.col("l_returnflag") == "A", 21).when(F.col("l_returnflag") == "N", 11).otherwise(9)
    g = render.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), rate.alias("rate")).agg(F.sum(F.floor(F.col("l_extendedprice") / 100).cast("long")).alias("base"))
    vat = F.col("base") * F.col("rate")
    said = F.concat(F.lit("SUMA TVA "), F.when(F.col("rate") == 21, "A").when(F.col("rate") == 11, "B").otherwise("C"), F.lit(" "), F.col("rate").cast("string"), F.lit("% "), F.expr("string(base * rate div 100)"), F.lit(","), F.lpad(F.expr("string(base * rate % 100)"), 2, "0"))
    lines = g.select("doc_id", (30 - F.col("rate")).alias("line_no"), said.alias("text"))
    totals = g.groupBy("doc_id").agg(((F.sum("base") * 100 + F.sum(vat) + F.when(F.col("doc_id") % 3 == 0, 25).otherwise(0)) / 100).alias("total"))
    return lines, totals


@query(_BY_RATE_SQL + "SELECT doc_id, CAST(rate AS DOUBLE) AS rate, base * rate / 100.0 AS amount FROM p")
def vat_pairs_multi(spark: SparkSession, d: str) -> DataFrame:
    """Rates with the VAT beside them; an amount that equals a rate is none."""
    return rows.vat_pairs(_rate_lines(spark, d)[0]).select("doc_id", "rate", "amount")


@query(_BY_RATE_SQL + """,
t AS (SELECT doc_id, (sum(base * 100 + base * rate) + CASE WHEN doc_id % 3 = 0 THEN 25 ELSE 0 END)::BIGINT AS cents FROM g GROUP BY doc_id),
m AS (SELECT doc_id, string_agg(CAST(rate AS VARCHAR), ', ' ORDER BY rate DESC) AS rates, count(*) AS n_rates, sum(base * rate)::BIGINT AS v, sum(base)::BIGINT AS b FROM p GROUP BY doc_id HAVING count(*) > 1)
SELECT doc_id, rates, n_rates, v / 100.0 AS vat_total, CAST(b AS DOUBLE) AS base_total, cents / 100.0 AS total, abs(cents - v - b * 100) <= 10 AS verified FROM m JOIN t USING (doc_id)""")
def vat_multi_rate(spark: SparkSession, d: str) -> DataFrame:
    """Documents of several rates: bases follow from VAT, and both are held against the total."""
    lines, totals = _rate_lines(spark, d)
    return rows.multi_rate(rows.vat_pairs(lines), totals).drop("warning")


@query("SELECT p_partkey AS k, p_partkey % 4 IN (0, 3) AS mixed FROM part")
def mixed_rate_warning(spark: SparkSession, d: str) -> DataFrame:
    says = F.element_at(F.array(*map(F.lit, ("Restaurant Zori bere", "Pizzeria suc", "Magazin vin rosu", "Cafea si cocktail"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return render.table(spark, d, "part").select(F.col("p_partkey").alias("k"), text.mixed_rates(says).alias("mixed"))


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'J' || (s_suppkey % 50 + 1) || '/' || s_suppkey || '/' || (1990 + s_suppkey % 30) END AS number FROM supplier")
def trade_register_numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    number = F.concat(F.lit("Reg. com. j "), (k % 50 + 1).cast("string"), F.lit(" / "), k.cast("string"), F.when(k % 5 == 0, F.lit(" din ")).otherwise(F.lit("/ ")), (k % 30 + 1990).cast("string"), F.lit(", sediu"))
    return render.table(spark, d, "supplier").select(k.alias("k"), ids.trade_register(number).alias("number"))


@query("""
SELECT k, (CASE WHEN v >= 10 THEN printf('%.0f', v) ELSE printf('%.1f', v) END) || ' ' || u AS shown FROM (
  SELECT k, CASE WHEN n < 1024 THEN n::DOUBLE WHEN n < 1048576 THEN n / 1024.0 WHEN n < 1073741824 THEN n / 1048576.0 ELSE n / 1073741824.0 END AS v,
         CASE WHEN n < 1024 THEN 'B' WHEN n < 1048576 THEN 'KB' WHEN n < 1073741824 THEN 'MB' ELSE 'GB' END AS u
  FROM (SELECT p_partkey AS k, (p_partkey * p_partkey * p_partkey * 8)::BIGINT AS n FROM part) WHERE n < 1000000000000)""")
def bytes_for_people(spark: SparkSession, d: str) -> DataFrame:
    # keys beyond 2 ** 20 have no such number of bytes in 64 bits: null, and so not below the bound
    k = F.col("p_partkey")
    cube = F.try_multiply(F.try_multiply(F.try_multiply(k, k), k), F.lit(8).cast("long"))
    p = render.table(spark, d, "part").select(k.alias("k"), cube.alias("n")).where("n < 1000000000000")
    return p.select("k", text.bytes_text(F.col("n")).alias("shown"))


@query(O.with_heads("""SELECT doc_id AS "Nr", CASE WHEN doc_id % 4 = 0 THEN '' ELSE CAST(vat AS VARCHAR) END AS "TVA", CASE WHEN doc_id % 4 = 0 THEN '' ELSE CAST(total AS VARCHAR) END AS "Total", CASE WHEN doc_id % 4 = 0 THEN CAST(total AS VARCHAR) ELSE '' END AS "Suma", '' AS "Altele" FROM heads"""))
def excel_export_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows under a template's headers: fields by their mapping, slips with their sum in a column of its own, unmapped headers blank."""
    h, slip = render.receipt_heads(spark, d), F.col("doc_id") % 4 == 0
    fields = {"nr": F.col("doc_id"), "tva": F.when(slip, "").otherwise(F.col("vat").cast("string")), "total": F.when(slip, "").otherwise(F.col("total").cast("string")), "suma": F.when(slip, F.col("total").cast("string")).otherwise("")}
    return rows.export_rows(h, ["Nr", "TVA", "Total", "Suma", "Altele"], fields)


# --- classification --------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN contains(upper(text), 'FACTURA') OR contains(upper(text), 'INVOICE') THEN 'Factură' WHEN contains(upper(text), 'BON FISCAL') OR contains(upper(text), 'CASA DE MARCAT') OR contains(upper(text), 'BF.') OR contains(upper(text), 'BF ') THEN 'Bon Fiscal'
  WHEN contains(upper(text), 'TERMINAL ID') OR contains(upper(text), 'PIN VERIFICAT') OR contains(upper(text), 'TRANZACTIE ACCEPTATA') OR contains(upper(text), 'TRANZACTIE APROBATA') OR contains(upper(text), 'POS') THEN 'Chitanță POS'
  WHEN contains(upper(text), 'CHITANTA') THEN 'Chitanță de mână' WHEN contains(upper(text), 'BENZINA') OR contains(upper(text), 'MOTORINA') OR contains(upper(text), 'DIESEL') THEN 'Fișă Combustibil' ELSE 'Necunoscut' END AS kind FROM documents""")
def doc_type_classify(spark: SparkSession, d: str) -> DataFrame:
    return render.table(spark, d, "documents").select("doc_id", text.document_kind(F.col("text")).alias("kind"))


@query("SELECT o_orderkey AS doc_id, o_orderkey % 4 IN (0, 3) AS slip FROM orders")
def slip_vs_receipt(spark: SparkSession, d: str) -> DataFrame:
    says = F.element_at(F.array(*map(F.lit, ("CHITANȚĂ SERIA NUMAR 12 AM PRIMIT DE LA", "BON FISCAL CHITANTA SERIA NUMAR SUMA", "CHITANTA 44", "AM PRIMIT DE LA X SUMA DE 10 LEI"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return render.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), text.looks_like_slip(says).alias("slip"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def html_escape_pages(spark: SparkSession, d: str) -> DataFrame:
    return render.table(spark, d, "pages").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


# --- boxes, lines and pages ------------------------------------------------------------------------------------------


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Words of all receipt lines, laid out 24 apart down and 60 across, shaken by up to 2; items of one number lie below each other."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "text"))
    lines = render.receipt_lines(spark, d).select("doc_id", nth.cast("long").alias("line_no"), "text")
    t = lines.select("doc_id", "line_no", F.posexplode(F.split("text", " ")).alias("pos", "text"))
    shake = F.pmod(F.col("doc_id") * 7 + F.col("pos") * 13, F.lit(5)) - 2
    return t.select("doc_id", (F.col("line_no") * 1000 + F.col("pos")).alias("box_id"), "text", (10.0 + 60 * F.col("pos")).alias("x"), (24.0 * F.col("line_no") + shake).alias("y"), F.lit(50.0).alias("w"), F.lit(12.0).alias("h"))


_LINES_SQL = O.with_heads("""
, t AS (
  SELECT doc_id, 1 AS n, upper(s_name) || ' SRL' AS text FROM heads JOIN supplier ON s_suppkey = seller
  UNION ALL SELECT doc_id, 2, 'COD FISCAL: RO' || CASE doc_id % 5 WHEN 0 THEN replace(cui, '0', 'O') WHEN 1 THEN left(cui, 7) ELSE cui END FROM heads
  UNION ALL SELECT doc_id, 3, 'NUMAR BON FISCAL: ' || doc_id FROM heads
  UNION ALL SELECT doc_id, 900, 'TOTAL ' || (total // 100) || '.' || lpad(CAST(total % 100 AS VARCHAR), 2, '0') FROM heads WHERE doc_id % 7 <> 0
  UNION ALL SELECT doc_id, 901, 'TOTAL TVA A ' || rate || ',00% ' || (vat // 100) || '.' || lpad(CAST(vat % 100 AS VARCHAR), 2, '0') FROM heads
  UNION ALL SELECT doc_id, 902, 'DATA: ' || strftime(date, '%d.%m.%Y') FROM heads
  UNION ALL SELECT doc_id, 903, CASE WHEN cash THEN 'NUMERAR ' ELSE 'CARD ' END || (total // 100) || '.' || lpad(CAST(total % 100 AS VARCHAR), 2, '0') FROM heads
  UNION ALL SELECT doc_id, 904, 'SUMA ' || (total // 100) || '.' || lpad(CAST(total % 100 AS VARCHAR), 2, '0') FROM heads WHERE doc_id % 7 = 0
  UNION ALL SELECT doc_id, n, p_name || ' ' || q || ' X' || (c // q // 100) || '.' || lpad(CAST(c // q % 100 AS VARCHAR), 2, '0') || ' ' || (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || ' A'
    FROM (SELECT l_orderkey AS doc_id, l_linenumber + 10 AS n, p_name, CAST(l_quantity AS BIGINT) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS c FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey))
""")


# a line shows a word that follows itself once
@query(_LINES_SQL + "SELECT doc_id, array_to_string(list_filter(w, lambda x, i: i = 1 OR lower(x) <> lower(w[i - 1])), ' ') AS text FROM (SELECT doc_id, string_split(text, ' ') AS w FROM t)")
def line_grouping(spark: SparkSession, d: str) -> DataFrame:
    return folds.group_lines(_boxes(spark, d), "doc_id").select("doc_id", "text")


@query(_LINES_SQL + "SELECT doc_id, sum(len(string_split(text, ' ')))::BIGINT AS n FROM t GROUP BY doc_id")
def word_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Every third word is seen twice, a little aside; each stays once."""
    b = _boxes(spark, d)
    again = F.struct((F.col("box_id") + 500).alias("box_id"), F.lower("text").alias("text"), (F.col("x") + 5).alias("x"), (F.col("y") + 1).alias("y"), "w", "h")
    seen = F.array_compact(F.array(F.struct("box_id", "text", "x", "y", "w", "h"), F.when(F.col("box_id") % 3 == 0, again)))
    return folds.dedupe_words(b.select("doc_id", F.explode(seen).alias("b")).select("doc_id", "b.*"), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey AS k, greatest(4.0, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1]) AS mh FROM lineitem GROUP BY l_orderkey")
def upper_median_height(spark: SparkSession, d: str) -> DataFrame:
    return render.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(folds.upper_median(F.collect_list("l_quantity")).alias("mh"))


def _rects(spark: SparkSession, d: str) -> DataFrame:
    i = render.table(spark, d, "lineitem")
    return i.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("det_id"), F.col("l_quantity").alias("x"), (F.col("l_partkey") % 40).cast("double").alias("y"), F.lit(20.0).alias("w"), (10.0 + F.col("l_suppkey") % 30).alias("h"))


_RECTS_SQL = "r AS (SELECT l_orderkey AS k, l_linenumber * 10000000 + l_partkey AS i, l_quantity AS x, (l_partkey % 40) * 1.0 AS y, 20.0 AS w, 10.0 + l_suppkey % 30 AS h FROM lineitem)"


@query(f"""WITH {_RECTS_SQL}, p AS (SELECT a.k, a.i AS a, b.i AS b, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS c, a.w * a.h AS m, b.w * b.h AS n FROM r a JOIN r b ON a.k = b.k AND a.i < b.i),
q AS (SELECT *, c / (m + n - c) AS iou, c / least(m, n) AS cover, greatest(m, n) / least(m, n) AS ratio FROM p WHERE c > 0)
SELECT k, a, b, round(iou, 9) AS iou, iou > 0.28 OR (cover > 0.55 AND ratio < 3.5) OR (cover > 0.40 AND ratio < 2.8 AND iou > 0.12) AS same FROM q""")
def bbox_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return spatial.overlaps(_rects(spark, d), "k", "det_id").select("k", "a", "b", F.round("iou", 9).alias("iou"), "same")


@query("SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_orderkey")
def nms_documents(spark: SparkSession, d: str) -> DataFrame:
    """Detections of one line number lie almost on each other, those of others apart: one of each stays."""
    i = render.table(spark, d, "lineitem")
    det = i.select(F.col("l_orderkey").alias("k"), F.monotonically_increasing_id().alias("det_id"), (100.0 * F.col("l_linenumber") + F.col("l_partkey") % 5).alias("x"), F.lit(0.0).alias("y"), F.lit(90.0).alias("w"), F.lit(200.0).alias("h"), F.col("l_extendedprice").alias("score"))
    return folds.suppress(det, "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderkey % 4 AS t, o_orderkey % 97 * 1.0 AS x, o_custkey % 89 * 1.0 AS y, 20.0 AS w, 30.0 AS h FROM orders)
SELECT k, CASE t WHEN 0 THEN x WHEN 1 THEN 200 - (y + h) WHEN 2 THEN 150 - (x + w) ELSE y END AS bx, CASE t WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN 200 - (y + h) ELSE 150 - (x + w) END AS by, CASE WHEN t % 2 = 0 THEN w ELSE h END AS bw, true AS back FROM r""")
def rect_rotate_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    o = render.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 4 - 4 * (F.col("o_orderkey") % 2)).alias("t"), F.struct((F.col("o_orderkey") % 97).cast("double").alias("x"), (F.col("o_custkey") % 89).cast("double").alias("y"), F.lit(20.0).alias("w"), F.lit(30.0).alias("h")).alias("r"))
    wide, tall = F.lit(150.0), F.lit(200.0)
    o = o.withColumn("b", rects.to_base(F.col("r"), F.col("t"), wide, tall))
    return o.select("k", F.col("b.x").alias("bx"), F.col("b.y").alias("by"), F.col("b.w").alias("bw"), (rects.from_base(F.col("b"), F.col("t"), wide, tall) == F.col("r")).alias("back"))


_AMOUNT_BOXES = "a AS (SELECT l_orderkey AS doc_id, l_linenumber * 10000000 + l_partkey AS box_id, l_quantity AS x, (l_partkey % 40) * 1.0 AS y, CASE WHEN l_partkey % 3 = 0 THEN 19.0 ELSE floor(l_extendedprice) / 100 END AS amount FROM lineitem)"


@query(f"""WITH {_AMOUNT_BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (x - 10) * (x - 10) + (y - 20) * (y - 20), box_id) AS r FROM a)
SELECT doc_id, min_by(amount, r) AS amount FROM r WHERE r <= 8 AND amount > 1 AND amount NOT IN (5, 9, 11, 19, 21) GROUP BY doc_id""")
def nearest_amount_knn8(spark: SparkSession, d: str) -> DataFrame:
    i = render.table(spark, d, "lineitem")
    a = i.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("box_id"), F.col("l_quantity").alias("x"), (F.col("l_partkey") % 40).cast("double").alias("y"), F.when(F.col("l_partkey") % 3 == 0, 19.0).otherwise(F.floor("l_extendedprice") / 100).alias("amount"))
    labels = a.select("doc_id").distinct().select("doc_id", F.lit(10.0).alias("x"), F.lit(20.0).alias("y"))
    return spatial.nearest_amounts(labels, a)


@query(f"""WITH a AS (SELECT l_orderkey AS doc_id, l_linenumber * 10000000 + l_partkey AS i, floor(l_extendedprice) / 100 AS v FROM lineitem UNION ALL SELECT l_orderkey, 5000000000 + l_linenumber * 10000000 + l_partkey, {O.ron2("floor(l_extendedprice) / 100 * 19 / 100")} FROM lineitem WHERE l_partkey % 2 = 0),
p AS (SELECT x.doc_id, x.i AS i, y.i AS j, x.v AS base, y.v AS vat FROM a x JOIN a y ON x.doc_id = y.doc_id WHERE x.v <> y.v AND abs(y.v - x.v * 19 / 100) <= 0.05)
SELECT doc_id, base, vat FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j, base, vat) AS r FROM p) WHERE r = 1""")
def base_vat_pairs(spark: SparkSession, d: str) -> DataFrame:
    i, v = render.table(spark, d, "lineitem"), F.floor("l_extendedprice") / 100
    at = F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_partkey")
    a = i.select(F.col("l_orderkey").alias("doc_id"), at.alias("ordinal"), v.alias("amount")).unionByName(i.where("l_partkey % 2 = 0").select(F.col("l_orderkey").alias("doc_id"), (at + 5_000_000_000).alias("ordinal"), money.ron2(v * 19 / 100).alias("amount")))
    return spatial.vat_pairs(a, 19.0)


@query("""WITH r AS (SELECT user_id AS k, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 30 AS e FROM events), g AS (SELECT k, s, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS till FROM r)
SELECT k, max(s - till) AS gap, arg_max((s + till) / 2, [s - till, -(s + till) / 2]) AS cut FROM g WHERE s - till > 2 GROUP BY k""")
def largest_gap_cut(spark: SparkSession, d: str) -> DataFrame:
    return spatial.largest_gap(_seconds(spark, d).select("k", "s", (F.col("s") + 30).alias("e")), "k", "s", "e")


def _seconds(spark: SparkSession, d: str) -> DataFrame:
    e = render.table(spark, d, "events")
    return e.select(F.col("user_id").alias("k"), "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("s"), "value", "event_type")


@query("SELECT k, max(b - value) AS reset FROM (SELECT user_id AS k, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) GROUP BY k")
def largest_reset_split(spark: SparkSession, d: str) -> DataFrame:
    return spatial.largest_reset(_seconds(spark, d), "k", ["s", "event_id"], "value")


@query("""WITH r AS (SELECT user_id AS k, event_id, epoch_us(ts) // 1000000 AS s FROM events), n AS (SELECT *, coalesce((s - lag(s) OVER (PARTITION BY k ORDER BY s, event_id) >= 7200)::INT, 0) AS w FROM r),
x AS (SELECT k, sum(w) OVER (PARTITION BY k ORDER BY s, event_id) AS session FROM n) SELECT k, session::BIGINT AS session, count(*) AS n FROM x GROUP BY k, session""")
def anchor_sessions_prev(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.sessions(_seconds(spark, d), "k", ["s", "event_id"], F.col("s"), 7200)
    return out.groupBy("k", "session").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE r AS (SELECT user_id AS k, (epoch_us(ts) // 1000000)::DOUBLE AS s FROM events), h AS (
  SELECT k, min(s) AS s FROM r GROUP BY k UNION ALL
  SELECT h.k, (SELECT min(r.s) FROM r WHERE r.k = h.k AND r.s - h.s >= 7200) AS s FROM h WHERE (SELECT min(r.s) FROM r WHERE r.k = h.k AND r.s - h.s >= 7200) IS NOT NULL)
SELECT k, count(*) AS n, sum(s) AS total FROM h GROUP BY k""")
def anchor_groups_head(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.head_groups(_seconds(spark, d), "k", "s", 7200)
    return out.select("k", F.size("heads").cast("long").alias("n"), F.aggregate("heads", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("""SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS ahead FROM events""")
def lookahead6_max(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("k").orderBy("s", "event_id").rowsBetween(1, 6)
    return _seconds(spark, d).select("event_id", F.max("value").over(w).alias("ahead"))


@query("SELECT k, event_id, value FROM (SELECT event_type AS k, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 180")
def metrics_ring_buffer(spark: SparkSession, d: str) -> DataFrame:
    rows = _seconds(spark, d).select(F.col("event_type").alias("k"), "event_id", "value", "s")
    return spatial.ring(rows, "k", [F.desc("s"), F.desc("event_id")], 180).drop("s")


@query("""WITH r AS (SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events)
SELECT event_id, CASE WHEN coalesce(t > 0, false) THEN greatest(0.0, least(1.0, b / t)) ELSE 0.0 END AS used FROM r""")
def metrics_delta(spark: SparkSession, d: str) -> DataFrame:
    return spatial.utilisation(_seconds(spark, d), "k", ["s", "event_id"], "value", "event_id").select("event_id", "used")


@query("SELECT p AS plate, c AS cluster, n FROM (SELECT o_orderkey // 4 AS p, row_number() OVER (PARTITION BY o_orderkey // 4 ORDER BY o_orderkey % 4) - 1 AS c, 12 + o_orderkey % 9 AS n FROM orders)")
def segment_plate(spark: SparkSession, d: str) -> DataFrame:
    """Four documents on a plate, side by side and below each other; every fifth plate is turned."""
    o = render.table(spark, d, "orders").select((F.expr("o_orderkey div 4")).alias("plate"), (F.col("o_orderkey") % 4).alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), 11 + F.col("o_orderkey") % 9)).alias("i"))
    x = F.expr("q div 2") * 600.0 + (F.col("i") % 3) * 55
    y = (F.col("q") % 2) * 400.0 + F.expr("i div 3") * 16
    b = o.select("plate", (F.col("q") * 1000 + F.col("i")).alias("box_id"), F.lit("word").alias("text"), x.alias("x"), y.alias("y"), F.lit(50.0).alias("w"), F.lit(12.0).alias("h"))
    turn = F.col("plate") % 5 == 0
    b = b.select("plate", "box_id", "text", F.when(turn, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(turn, 2000 - F.col("x") - 50).otherwise(F.col("y")).alias("y"), F.when(turn, 12.0).otherwise(50.0).alias("w"), F.when(turn, 50.0).otherwise(12.0).alias("h"))
    return segment.segment(b, "plate").groupBy("plate", "cluster").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH o AS (SELECT o_orderkey AS plate, o_orderkey % 5 AS kind FROM orders)
SELECT plate, c AS cluster, n FROM o, (VALUES (0, 0, 15), (0, 1, 15), (1, 0, 33), (1, 1, 33), (2, 0, 15), (2, 1, 15), (3, 0, 19), (4, 0, 18)) v(k, c, n) WHERE k = kind""")
def segment_documents(spark: SparkSession, d: str) -> DataFrame:
    """Real words on plates of five kinds: two short receipts above each other and two long ones, parted by their headers; two side
    by side without a gap; a receipt whose sums stand far right; a slip that names two companies."""
    key = F.col("o_orderkey")
    ro = lambda n: F.concat(F.lit("RO"), render.company_id(key + n))

    def words(x: float, y: float, lines, step: float = 55, w: float = 50):
        return [F.struct((F.lit(t) if isinstance(t, str) else t).alias("text"), F.lit(x + step * i).alias("x"), F.lit(y + 16.0 * n).alias("y"), F.lit(w).alias("w"), F.lit(12.0).alias("h")) for n, line in enumerate(lines) for i, t in enumerate(line)]

    def printed(n: int, items: int = 2):
        return [["MAGAZIN", "UNU", "SRL"], ["COD", "FISCAL", ro(n)], *([["paine", f"{i + 2},00", "A"] for i in range(items)]), ["lei", "5,00", "TOTAL"]]

    kinds = [
        words(0, 0, printed(0)) + words(0, 88, printed(1)),
        words(0, 0, printed(0, 8)) + words(0, 184, printed(1, 8)),
        words(0, 0, printed(0), 72, 70) + words(219, 0, printed(1), 72, 70),
        words(0, 0, printed(0)) + words(360, 32, [["TOTAL", "5,00"], ["TVA", "0,87"]]),
        words(0, 0, [["CHITANTA", "Seria", "NUMAR", "12"], ["furnizor", "CUI", ro(0), "oras"], ["am", "primit", "de", "la", "firma"], ["CUI", ro(1), "suma", "de", "344,77"]]),
    ]
    boxes_ = F.array(*kinds[0])
    for k, said in enumerate(kinds[1:], 1):
        boxes_ = F.when(key % 5 == k, F.array(*said)).otherwise(boxes_)
    o = render.table(spark, d, "orders").select(key.alias("plate"), F.posexplode(boxes_).alias("box_id", "b")).select("plate", "box_id", "b.*")
    return segment.segment(o, "plate").groupBy("plate", "cluster").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH p AS (SELECT o_orderkey AS page, o_orderkey % 4 AS kind, 12 + o_orderkey % 7 AS n FROM orders)
SELECT page, turns, CAST(CASE WHEN kind = 3 THEN 5 ELSE n END AS BIGINT) AS n_words, CAST(CASE WHEN kind = 3 THEN 800 ELSE 160 END AS DOUBLE) AS w
FROM p, (VALUES (0, 0), (1, 1), (2, 0), (2, 1), (3, 2)) v(k, turns) WHERE k = kind""")
def orientation_choice(spark: SparkSession, d: str) -> DataFrame:
    """Pages that read best upright, turned once, half of each, and hardly at all."""
    o = render.table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 4).alias("kind"), (12 + F.col("o_orderkey") % 7).alias("n"))
    kind, n = F.col("kind"), F.col("n")
    # turn, number of words, length of a word, left edge: a document in its turn, and what the wrong turn makes of it
    shown = lambda turns, words, text, left, there: F.when(there, F.struct(F.lit(turns).alias("turns"), words.cast("long").alias("words"), F.lit(text).alias("text"), F.lit(left).alias("left")))
    none = F.lit(5)
    all_ = F.array_compact(F.array(
        shown(0, n, "cuvinte", 0.0, kind.isin(0, 2)), shown(1, n, "cuvinte", 600.0, kind.isin(1, 2)), shown(1, none, "l", 0.0, kind == 0), shown(0, none, "l", 600.0, kind == 1),
        shown(2, none, "abc", 0.0, kind == 3), shown(3, none, "ab", 0.0, kind == 3),
    ))
    w = o.select("page", F.posexplode(all_).alias("part", "s")).select("page", "part", "s.*").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("words") - 1)).alias("i"))
    words = w.select("page", F.col("turns").cast("long").alias("turns"), (F.col("part") * 1000 + F.col("i")).alias("box_id"), "text", (F.col("left") + (F.col("i") % 3) * 55).alias("x"), (F.floor(F.col("i") / 3) * 16.0).alias("y"), F.lit(50.0).alias("w"), F.lit(12.0).alias("h"))
    sizes = o.select("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("turns")).withColumns({"width": F.lit(800.0), "height": F.lit(800.0)})
    found = orientation.read_pages(words, sizes, words.select("page", "turns", "text", F.lit(1.0).alias("confidence")), "page")
    side = F.when((F.col("turns") % 2 == 1) & (F.col("w") < 800), F.col("h")).otherwise(F.col("w"))
    return found.select("page", F.col("turns").cast("int").alias("turns"), "n_words", side.alias("w"))


@query("""
WITH e AS (SELECT event_id, user_id AS page, CAST(floor(value * 100) AS BIGINT) % 7 AS amounts FROM events)
SELECT page, event_id AS det_id, CASE WHEN amounts >= 3 THEN 'page' ELSE 'cell' END AS source FROM e""")
def richest_reading(spark: SparkSession, d: str) -> DataFrame:
    """Each document of a page is read from its cell, which has the better score, and with the whole page: the reading with more money stays."""
    e = render.table(spark, d, "events").select("event_id", F.col("user_id").alias("page"), F.expr("cast(floor(value * 100) as bigint) % 7").alias("amounts"))
    place = F.row_number().over(Window.partitionBy("page").orderBy("event_id")) * 300.0
    e = e.withColumn("x", place)
    say = lambda c: F.repeat(F.lit("suma 12,50 "), c.cast("int"))
    seen = lambda source, dx, score, text: e.select("page", F.lit(source).alias("source"), F.col("event_id").alias("det_id"), (F.col("x") + dx).alias("x"), F.lit(0.0).alias("y"), F.lit(200.0).alias("w"), F.lit(400.0).alias("h"), F.lit(score).alias("score"), text.alias("text"))
    both = seen("cell", 0.0, 500.0, F.concat(F.lit("COD FISCAL 1234 "), say(F.lit(2)))).unionByName(seen("page", 8.0, 380.0, F.concat(F.lit("COD FISCAL 1234 "), say(F.col("amounts")))))
    return orientation.richest(both, "page").select("page", "det_id", "source")


@query("""
WITH RECURSIVE d AS (SELECT o_custkey AS page, o_orderkey AS i, CAST(o_orderkey * 7 % 90 AS DOUBLE) AS y, CAST(o_orderkey * 13 % 500 AS DOUBLE) AS x FROM orders),
h AS (SELECT page, min(y) AS head, 0 AS r FROM d GROUP BY page UNION ALL SELECT h.page, (SELECT min(d.y) FROM d WHERE d.page = h.page AND d.y - h.head > 20), r + 1 FROM h WHERE head IS NOT NULL),
r AS (SELECT d.page, d.i, d.x, d.y, max(h.r) AS r FROM d JOIN h ON h.page = d.page AND h.head <= d.y GROUP BY d.page, d.i, d.x, d.y)
SELECT page, i, CAST(row_number() OVER (PARTITION BY page ORDER BY r, x, y, i) - 1 AS INTEGER) AS nth FROM r""")
def row_tolerant_order(spark: SparkSession, d: str) -> DataFrame:
    o = render.table(spark, d, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("i"), (F.col("o_orderkey") * 7 % 90).cast("double").alias("y"), (F.col("o_orderkey") * 13 % 500).cast("double").alias("x"))
    return orientation.row_order(o, "page", "i").select("page", "i", "nth")


# --- slips and repeats -----------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS k, (1 + o_orderkey * 37 % 499999) + (o_orderkey % 100) / 100.0 AS amount, (1 + o_orderkey * 37 % 499999) + (o_orderkey % 100) / 100.0 AS chosen FROM orders")
def slip_amount_words(spark: SparkSession, d: str) -> DataFrame:
    """Sums said in words are read back, and correct digits that were misread by a little."""
    n, bani = 1 + F.col("o_orderkey") * 37 % 499_999, F.col("o_orderkey") % 100
    o = render.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), slip.sum_in_words(slip.sum_to_words(n, bani)).alias("amount"), (n + bani / 100 + F.when(F.col("o_orderkey") % 3 == 0, 7).otherwise(0)).alias("digits"))
    return o.select("k", "amount", slip.decide(F.col("digits"), F.col("amount")).alias("chosen"))


@query("SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber >= 4 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4) THEN 'payer' ELSE 'issuer' END AS section, count(*) AS n FROM lineitem GROUP BY 1, 2")
def payer_issuer_split(spark: SparkSession, d: str) -> DataFrame:
    i = render.table(spark, d, "lineitem")
    lines = i.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), F.when(F.col("l_linenumber") == 4, "Am primit de la X").otherwise("row").alias("text"))
    return slip.sections(lines).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, sum(k)::BIGINT AS keys FROM (SELECT min(o_orderkey) AS k FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE))")
def slip_dedup(spark: SparkSession, d: str) -> DataFrame:
    o = render.table(spark, d, "orders")
    slips = o.select(F.col("o_orderkey").alias("slip_id"), F.col("o_custkey").cast("string").alias("issuer"), F.lit(None).cast("string").alias("series"), F.lit("7").alias("number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit(None).cast("double").alias("amount"))
    return slip.distinct_slips(slips).agg(F.count(F.lit(1)).alias("n"), F.sum("slip_id").alias("keys"))


@query("SELECT o_orderkey // 4 AS plate, count(*) AS n FROM orders GROUP BY 1")
def receipt_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each receipt of a plate seen once whole, once without its total at the same place, and every third once more elsewhere."""
    o = render.table(spark, d, "orders").select(F.expr("o_orderkey div 4").alias("plate"), F.col("o_orderkey").alias("k"), (F.lit(100_000) + F.col("o_orderkey")).cast("string").alias("cui"), F.floor("o_totalprice").cast("double").alias("total"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), ((F.col("o_orderkey") % 4) * 500.0).alias("x"))
    seen = lambda n, total, x, c, cui=F.col("cui"): o.select("plate", (F.col("k") * 10 + n).alias("rec_id"), cui.alias("cui"), total.alias("total"), "date", x.alias("x"), F.lit(0.0).alias("y"), F.lit(300.0).alias("w"), F.lit(600.0).alias("h"), F.lit(c).alias("completeness"))
    nothing = F.lit(None).cast("double")
    rows = seen(0, F.col("total"), F.col("x"), 200.0).unionByName(seen(1, nothing, F.col("x") + 10, 20.0)).unionByName(seen(2, F.col("total"), F.col("x") + 9000, 150.0).where("rec_id % 3 = 0")).unionByName(seen(3, nothing, F.col("x") + 20_000, 5.0, F.lit("12")))
    return folds.dedupe_receipts(rows, "plate").groupBy("plate").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS k, greatest(0.0, least(1.0, round((0.35 + CASE WHEN o_orderkey % 2 = 0 THEN 0.15 ELSE 0.0 END + CASE WHEN o_orderkey % 3 = 0 THEN 0.20 ELSE 0.0 END + 0.10 + CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE 0.10 END + 0.05 - 0.04 * (o_orderkey % 4)) * 100) / 100)) AS confidence,
  CASE WHEN o_orderkey % 5 = 0 THEN -50.0 ELSE 100.0 END + 40 + 30 + 15 + 10 + CASE WHEN o_orderkey % 3 = 0 THEN 20 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 10 ELSE 0 END AS completeness FROM orders""")
def confidence_score(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    total = F.when(k % 5 != 0, F.col("o_totalprice"))
    c = receipt.confidence(k % 2 == 0, k % 3 == 0, F.col("o_orderdate"), total, k, k % 4)
    q = receipt.completeness(total, F.lit(True), k, F.col("o_orderdate"), F.lit("SUPPLIER"), k % 3 == 0, k % 2 == 0)
    return render.table(spark, d, "orders").select(k.alias("k"), c.alias("confidence"), q.alias("completeness"))


# --- sources and streams ---------------------------------------------------------------------------------------------


@query("""SELECT doc_id, i - 1 AS box_id, l[i] AS text, (i - 1) * 20.0 AS y FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents WHERE length(trim(text)) > 50) a) b""")
def native_text_boxes(spark: SparkSession, d: str) -> DataFrame:
    return boxes.text_boxes(render.table(spark, d, "documents"), "doc_id", "text").select("doc_id", "box_id", "text", "y")


@query("""SELECT doc_id, count(*) AS n, count(DISTINCT w) AS distinct_n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')) AS w FROM documents) GROUP BY doc_id""")
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    return boxes.words(render.table(spark, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("word").alias("distinct_n"))


def _streamed(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    folder = jobs.scratch(spark)
    jobs.run_to_end(stream, f"{folder}/out", f"{folder}/state", mode)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("SELECT doc_id, md5(line) AS line_md5 FROM (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS line FROM documents)")
def stream_queue_expand(spark: SparkSession, d: str) -> DataFrame:
    schema = render.table(spark, d, "documents").schema
    return _streamed(spark, jobs.expand_documents(jobs.read_files(spark, schema, f"{d}/documents.parque*")))


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS start, event_type, count(*) AS n, sum(CAST(trunc(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY 1, 2")
def stream_metric_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows of a metrics stream, in complete mode."""
    schema = render.table(spark, d, "events").schema
    out = jobs.metric_windows(jobs.read_files(spark, schema, f"{d}/events.parque*"))
    folder = jobs.scratch(spark)
    jobs.keep_latest(out, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "cents")


@query("SELECT event_type AS k, event_id AS id, value FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 180")
def stream_metrics_ring(spark: SparkSession, d: str) -> DataFrame:
    """The last 180 samples of each kind of event, as keyed state of a stream."""
    e = jobs.read_files(spark, render.table(spark, d, "events").schema, f"{d}/events.parque*")
    samples = e.select(F.col("event_type").alias("k"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")
    return state.latest(_streamed(spark, state.rings(samples))).drop("at")


# an answer stands for three days; the chain of first requests after each expiry is followed for every id
@query(f"""
WITH RECURSIVE r AS (SELECT event_id, {O.company_id_sql("user_id")} AS cui, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
h AS (SELECT cui, min(sec) AS sec FROM r GROUP BY cui UNION ALL SELECT h.cui, (SELECT min(r.sec) FROM r WHERE r.cui = h.cui AND r.sec >= h.sec + 259200) FROM h WHERE h.sec IS NOT NULL),
f AS (SELECT r.cui, r.sec, min(event_id) AS event_id FROM r JOIN h ON h.cui = r.cui AND h.sec = r.sec GROUP BY r.cui, r.sec)
SELECT r.event_id AS request_id, r.cui, upper(s_name) || ' SRL' AS name, CASE WHEN f.event_id IS NOT NULL THEN 'registry' ELSE 'cache' END AS answered_by
FROM r LEFT JOIN f ON f.event_id = r.event_id LEFT JOIN supplier ON s_suppkey = r.user_id""")
def stream_registry_cache(spark: SparkSession, d: str) -> DataFrame:
    """Each event asks for a company, every third of which is unknown; answers stand for three days."""
    e = jobs.read_files(spark, render.table(spark, d, "events").schema, f"{d}/events.parque*")
    asked = e.select(F.col("event_id").alias("request_id"), render.company_id(F.col("user_id")).alias("cui"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"))
    return _streamed(spark, state.cached_answers(asked, render.registry(spark, d), stands=3 * 86_400)).drop("at")


# --- more fields and page geometry -----------------------------------------------------------------------------------

_DETS_SQL = "d AS (SELECT o_orderkey // 4 AS page, o_orderkey AS i, (o_orderkey % 2) * 180.0 + o_custkey % 60 AS x, (o_orderkey % 4 // 2) * 250.0 + o_custkey % 45 AS y, 120.0 + o_custkey % 50 AS w, 200.0 + o_custkey % 80 AS h FROM orders)"


@query(f"""WITH {_DETS_SQL}, p AS (SELECT a.page, a.i, a.x + a.w / 2 AS ax, a.y + a.h / 2 AS ay, b.x + b.w / 2 AS ox, b.y + b.h / 2 AS oy, b.i AS j,
  greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) / least(a.w, b.w) AS xs, greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) / least(a.h, b.h) AS ys, greatest(a.w, b.w) AS mw, greatest(a.h, b.h) AS mh
  FROM d a LEFT JOIN d b ON a.page = b.page AND a.i <> b.i),
q AS (SELECT *, CASE WHEN ys > 0.2 AND xs <= 0.2 THEN true WHEN xs > 0.2 AND ys <= 0.2 THEN false ELSE abs(ax - ox) / mw >= abs(ay - oy) / mh END AS across FROM p)
SELECT page, i AS det_id, least(greatest(coalesce(max((ax + ox) / 2) FILTER (across AND ox < ax), 0), 0), ax - 2) AS left, least(greatest(coalesce(max((ay + oy) / 2) FILTER (NOT across AND oy < ay), 0), 0), ay - 2) AS top,
  greatest(least(coalesce(min((ax + ox) / 2) FILTER (across AND ox > ax), 520), 520), ax + 2) AS right, greatest(least(coalesce(min((ay + oy) / 2) FILTER (NOT across AND oy > ay), 620), 620), ay + 2) AS bottom FROM q GROUP BY page, i, ax, ay""")
def isolated_cells(spark: SparkSession, d: str) -> DataFrame:
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    det = render.table(spark, d, "orders").select(F.expr("o_orderkey div 4").alias("page"), k.alias("det_id"), ((k % 2) * 180.0 + c % 60).alias("x"), (F.expr("o_orderkey % 4 div 2") * 250.0 + c % 45).alias("y"), (120.0 + c % 50).alias("w"), (200.0 + c % 80).alias("h"))
    return spatial.isolated_cells(det, "page", F.lit(520.0), F.lit(620.0))


@query("SELECT o_orderkey // 3 AS cluster, o_orderkey % 3 - (SELECT 0) AS part, 4 AS n FROM orders WHERE o_orderkey // 3 * 3 + 2 <= (SELECT max(o_orderkey) FROM orders)")
def anchor_split_lines(spark: SparkSession, d: str) -> DataFrame:
    """Three receipts in one column of lines, cut between them."""
    o = render.table(spark, d, "orders").select(F.expr("o_orderkey div 3").alias("cluster"), (F.col("o_orderkey") % 3).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    whole = o.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n = 12").select("cluster")
    lines = o.join(whole, "cluster").select("cluster", (F.col("q") * 400.0 + F.col("i") * 20 + F.when(F.col("i") > 2, 30).otherwise(0)).alias("y"), (F.col("i") < 2).alias("anchor"))
    return spatial.split_at_anchors(lines, "cluster", 12.0).groupBy("cluster", F.col("part").cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS doc_id, 30.5 + o_orderkey % 70 AS liters, (300 + o_orderkey % 500) / 100.0 AS price, 'MOTORINA EURO' AS product FROM orders")
def fuel_lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    price = render.money(300 + k % 500)
    o = render.table(spark, d, "orders").select(k.alias("doc_id"), F.explode(F.array(F.lit("MOTORINA EURO"), F.concat(F.translate(price, ".", ","), F.lit(" X"), (30 + k % 70).cast("string"), F.lit(",5 LITRU")))).alias("text"))
    return receipt.fuel(o.withColumn("line_no", F.when(F.col("text").startswith("M"), 1).otherwise(2)))


@query("SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 3 = 0 THEN 'OMV' ELSE s_name || ' SRL' END AS merchant FROM supplier")
def merchant_names(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("s_suppkey") % 3 == 0, "STATIE OMV 12").otherwise(F.concat("s_name", F.lit("  SRL srl")))
    rows = render.table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.posexplode(F.array(F.lit("BON FISCAL 12"), F.lit("183,48 8,00 31,84"), s)).alias("line_no", "text"))
    return receipt.merchants(rows)


@query("SELECT o_orderkey AS doc_id, 'DSE' AS series, '9' || o_orderkey AS number, 'AB 77' AS invoice FROM orders")
def slip_numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.concat(F.lit("9"), F.col("o_orderkey").cast("string"))
    lines = F.array(F.lit("Nr.Reg.Com. J40/1234 nr. 99"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Chitanță Seria DSE Numar "), k)).otherwise(F.concat(F.lit("Seria DSE nr. "), k)), F.lit("c/v factura nr AB 77"))
    return slip.slip_heads(render.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.posexplode(lines).alias("line_no", "text")))


@query(f"SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN '5311' ELSE '401' END AS debit, CASE WHEN o_orderkey % 3 = 0 THEN '4111' ELSE '5311' END AS credit, {O.ron2('o_totalprice')} AS amount FROM orders")
def slip_entries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    way = slip.direction(F.lit("1"), F.when(k % 3 == 0, "1").otherwise("2"), F.when(k % 3 == 1, "1").otherwise("3"))
    return render.table(spark, d, "orders").select(k.alias("k"), slip.slip_entry(F.col("o_totalprice"), way).alias("e")).select("k", "e.*")


_SAID = """
WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 8 AS k, 100 + o_orderkey % 900 AS n, CAST(floor(o_totalprice) AS BIGINT) % 90 + 10 AS b, 10 * (10 + o_orderkey % 90) AS q FROM orders),
p AS (SELECT *, n + b / 100.0 AS a FROM o),
c AS (SELECT *, CASE WHEN k = 4 THEN n + 0.5 WHEN k = 5 THEN q + 0.5 WHEN k = 6 THEN NULL ELSE a END AS digits, CASE WHEN k IN (0, 1) THEN a WHEN k = 5 THEN q + 0.5 WHEN k = 7 THEN a + 3 END AS words FROM p)
SELECT doc_id, CAST(digits AS DOUBLE) AS digits, CAST(words AS DOUBLE) AS words, CAST(CASE WHEN k = 7 THEN words ELSE digits END AS DOUBLE) AS amount, k IN (0, 1, 5) AS confirmed,
  CASE k WHEN 2 THEN 'sum in words not read' WHEN 3 THEN 'sum in words not read' WHEN 4 THEN 'letters of the sum were repaired; sum in words not read'
    WHEN 5 THEN 'ambiguous letters of the sum settled by the words' WHEN 6 THEN 'ambiguous letters of the sum were not guessed; sum not read'
    WHEN 7 THEN 'digits and words differ: the words count' ELSE '' END AS warnings
FROM c"""


def _readings(o: DataFrame, *said) -> DataFrame:
    """doc_id, reading, line_no, text of (reading, line, condition)."""
    rows = F.array_compact(F.array(*(F.when(there, F.struct(F.lit(r).alias("reading"), F.lit(i).alias("line_no"), line.alias("text"))) for i, (r, line, there) in enumerate(said))))
    return o.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


@query(_SAID)
def slip_amount_choice(spark: SparkSession, d: str) -> DataFrame:
    """Sums that readings confirm, that words settle, that stand without a separator, under letters, or on the line below."""
    o = render.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 8).alias("k"), (100 + F.col("o_orderkey") % 900).alias("n"), F.expr("cast(floor(o_totalprice) as bigint) % 90 + 10").alias("b"), (10 + F.col("o_orderkey") % 90).alias("q"))
    k, n, b, q = (F.col(c) for c in "knbq")
    say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    words = lambda n_, b_: F.concat(F.lit("adica "), slip.sum_to_words(n_, b_), F.lit(" reprezentand marfa"))
    lines = _readings(
        o,
        ("text", say("Suma de ", n, ",", b, " lei"), k.isin(0, 2)), ("text", words(n, b), k == 0),
        ("digits", say("Suma de ", n + 700, ",", b), k == 1), ("text", say("Sumă de ", n, ".", b), k == 1), ("text", words(n, b), k == 1),
        ("focused", say("SUMA: ", n + 50, ",", b), k == 2), ("focused", say("SUMA DE ", n, ",", b), k == 2),
        ("focused", say("Suma de ", n, b), k == 3),
        ("digits", say("Suma ", n, ",5O"), k == 4),
        ("digits", say("Suma de ", q, "D,50"), k.isin(5, 6)), ("text", words(q * 10, F.lit(50)), k == 5),
        ("text", F.lit("Suma"), k == 7), ("text", say(n, ",", b), k == 7), ("text", words(n + 3, b), k == 7),
    )
    return slip_reader.read_sums(lines).withColumn("warnings", F.array_join("warnings", "; "))


@query(f"""
WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey AS k, {O.company_id_sql("o_orderkey")} AS own, {O.company_id_sql("(o_orderkey + 1)")} AS other, CAST(o_orderdate AS DATE) + INTERVAL 28 YEAR AS date FROM orders)
SELECT doc_id, CASE k % 3 WHEN 0 THEN 'FIRMA UNU' WHEN 1 THEN 'DOI ALIMENTE SRL' END AS issuer, own AS issuer_id, CASE WHEN k % 4 = 3 THEN 'CLIENT MARE SA' ELSE 'CLIENT TREI SRL' END AS payer,
  CASE k % 5 WHEN 4 THEN NULL WHEN 1 THEN '00' || other ELSE other END AS payer_id, CASE WHEN k % 5 = 4 THEN '1960517221146' END AS payer_person, true AS payer_ok, strftime(date, '%Y-%m-%d') AS date, 'MARFA' AS subject
FROM o""")
def slip_fields(spark: SparkSession, d: str) -> DataFrame:
    """Issuer, payer, their ids, date and subject: behind labels, on the line below, repaired, and by the user's own id."""
    k = F.col("o_orderkey")
    other = render.company_id(k + 1)
    wrong = F.concat(F.left(other, F.char_length(other) - 1), ((F.right(other, F.lit(1)).cast("int") + 1) % 10).cast("string"))
    o = render.table(spark, d, "orders").withColumns({"doc_id": k, "own": render.company_id(k), "other": other, "wrong": wrong, "date": F.add_months(F.col("o_orderdate").cast("date"), 12 * render.YEARS)})
    say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    day = lambda f: F.date_format("date", f)
    always = F.lit(True)
    lines = _readings(
        o,
        ("text", F.lit("Furnizor: Firma Unu CUI 12"), k % 3 == 0), ("text", F.lit("Chitanță SRL"), k % 3 == 1), ("text", F.lit("DOI ALIMENTE SRL"), k % 3 == 1),
        ("digits", say("COD FISCAL: RO", F.col("own")), always),
        ("text", say("Data: ", F.translate(day("dd.MM.yyyy"), "0", "O")), k % 2 == 0), ("digits", say("din ", day("yyyy-MM-dd")), k % 2 == 1), ("text", F.lit("c/v factura din 01.02.2003"), always),
        ("text", F.lit("Am primit de la Client Trei SRL CUI"), k % 4 != 3), ("text", F.lit("Am primit de la ."), k % 4 == 3), ("text", F.lit("Client Mare SA"), k % 4 == 3),
        ("digits", F.lit("Am primit de la"), always),
        ("digits", say("CUI: RO", F.col("other")), k % 5 == 0), ("digits", say("CUI: RO000", F.col("other")), k % 5 == 1), ("digits", say("CIF ", F.translate("other", "0158", "OISB")), k % 5 == 2), ("digits", say("CUI ", F.col("wrong")), k % 5 == 3), ("digits", F.lit("CNP 1960517221146"), k % 5 == 4),
        ("text", F.lit("Reprezentând marfa Casier X"), always),
    )
    return slip_reader.read_fields(lines, render.company_id(F.col("doc_id") + 1)).withColumns({"issuer": F.trim("issuer"), "payer": F.trim("payer"), "subject": F.trim("subject")})


# --- smaller rules and sinks -----------------------------------------------------------------------------------------


@query("SELECT o_custkey AS k, string_agg('order ' || o_orderkey, E'\\n\\n---\\n\\n' ORDER BY o_orderkey) AS full_text FROM orders GROUP BY o_custkey")
def full_text_response(spark: SparkSession, d: str) -> DataFrame:
    o = render.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey")).alias("t"))
    return boxes.full_text(o, "k", "o_orderkey", "t")


@query("SELECT p_partkey AS k, CASE WHEN contains(lower(p_name), 'small') THEN 'total' WHEN contains(lower(p_name), 'ring') THEN 'vat' END AS field FROM part")
def template_mapping_guess(spark: SparkSession, d: str) -> DataFrame:
    p = render.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("header"))
    return p.select("k", boxes.guess_mapping({"total": "Small sum", "vat": "Ring value"}).alias("field"))


@query("""SELECT b.l_orderkey AS doc_id, count(*) AS n FROM lineitem b WHERE b.l_linenumber > 1 AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = b.l_orderkey AND l.l_linenumber = 1
  AND ((abs((b.l_partkey % 50) - (l.l_partkey % 50)) < 15 AND (b.l_quantity - l.l_quantity) * 5 > 0 AND (b.l_quantity - l.l_quantity) * 5 < 120) OR ((b.l_partkey % 50) - (l.l_partkey % 50) > 0 AND (b.l_partkey % 50) - (l.l_partkey % 50) < 25 AND abs((b.l_quantity - l.l_quantity) * 5) < 60))) GROUP BY b.l_orderkey""")
def buyer_label_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that a label left of them or above them marks."""
    i = render.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", (F.col("l_quantity") * 5).alias("x"), (F.col("l_partkey") % 50).cast("double").alias("y"))
    return spatial.labelled_boxes(i.where("l_linenumber > 1"), i.where("l_linenumber = 1"), 10.0).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH x AS (SELECT o_orderkey AS k, floor(o_totalprice) AS t, floor(o_totalprice * CASE o_orderkey % 3 WHEN 0 THEN 0.8 WHEN 1 THEN 0.7 ELSE 0.1 END) AS b, floor(o_totalprice) - floor(o_totalprice * 0.8) AS v FROM orders)
SELECT k, CASE WHEN abs(t - (b + v)) > 0.02 AND abs(t - (b + v)) < 0.5 * t THEN {O.ron2('t - v')} ELSE b END AS base, abs(t - (b + v)) > 0.02 AND abs(t - (b + v)) >= 0.5 * t AS error FROM x""")
def legacy_total_check(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    t, v = F.floor(p).cast("double"), (F.floor(p) - F.floor(p * 0.8)).cast("double")
    b = F.floor(p * F.when(k % 3 == 0, 0.8).when(k % 3 == 1, 0.7).otherwise(0.1)).cast("double")
    return render.table(spark, d, "orders").select(k.alias("k"), money.legacy_check(t, b, v).alias("r")).select("k", "r.*")


@query("SELECT o_orderkey AS k, (CASE WHEN o_orderkey % 2 = 0 AND o_totalprice > 5000 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 <> 0 AND o_totalprice > 100 * 4.97 THEN 1 ELSE 0 END)::BIGINT AS n FROM orders")
def cash_cap_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Warnings against an exchange rate that is a table of one row."""
    fx = spark.createDataFrame([("EUR", 4.97)], "currency string, rate double").where("currency = 'EUR'").select("rate")
    o = render.table(spark, d, "orders").join(F.broadcast(fx), F.lit(True), "left")
    return o.select(F.col("o_orderkey").alias("k"), F.size(money.cap_warnings(F.col("o_totalprice"), F.col("o_orderkey") % 2 == 0, F.col("rate"), F.col("o_orderkey") % 3 == 0)).cast("long").alias("n"))


@query("""WITH RECURSIVE s AS (SELECT s_suppkey AS k, replace(CAST(1000000 + s_suppkey * 37 AS VARCHAR), '0', 'D') AS t FROM supplier), r AS (
  SELECT k, t, '' AS v, 1::BIGINT AS i FROM s UNION ALL SELECT k, t, v || unnest(CASE WHEN substr(t, i, 1) = 'D' THEN ['0', '4'] ELSE [substr(t, i, 1)] END), i + 1 FROM r WHERE i <= length(t))
SELECT k, least(count(*), 32) AS n, min(v) AS first FROM r WHERE i > length(t) GROUP BY k""")
def ambiguous_digit_variants(spark: SparkSession, d: str) -> DataFrame:
    s = render.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.translate((1_000_000 + F.col("s_suppkey") * 37).cast("string"), "0", "D").alias("t"))
    s = s.withColumn("v", slip.digit_variants(F.col("t"), {"D": "04"}))
    return s.select("k", F.size("v").cast("long").alias("n"), F.array_min("v").alias("first"))


@query("SELECT l_orderkey AS k, list_sort(list(l_extendedprice) FILTER (r <= 4)) AS best FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS r FROM lineitem) GROUP BY l_orderkey")
def alternative_readings(spark: SparkSession, d: str) -> DataFrame:
    out = boxes.best_readings(render.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_extendedprice"), "k", "l_extendedprice")
    return out.groupBy("k").agg(F.array_sort(F.collect_list("l_extendedprice")).alias("best"))


@query("""WITH t AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'BON FISCAL COD FISCAL X SRL 14.05.2026 10.00 20.00' WHEN 1 THEN '10.00 20.00 30.00' ELSE 'words ' || o_orderkey END AS s FROM orders)
SELECT k, length(replace(s, ' ', '')) + CASE k % 3 WHEN 0 THEN 350.0 + 180 + 120 + 80 + CASE WHEN true THEN 40 ELSE 0 END WHEN 1 THEN 120.0 - 150 ELSE 0.0 END AS quality FROM t""")
def document_quality_scores(spark: SparkSession, d: str) -> DataFrame:
    """The date's first two numbers are an amount by its form, so it counts as one of three."""
    k = F.col("o_orderkey")
    s = F.when(k % 3 == 0, "BON FISCAL COD FISCAL X SRL 14.05.2026 10.00 20.00").when(k % 3 == 1, "10.00 20.00 30.00").otherwise(F.concat(F.lit("words "), k))
    q = receipt.document_quality(s, F.size(F.split(s, " ")), F.char_length(F.replace(s, F.lit(" "), F.lit(""))))
    return render.table(spark, d, "orders").select(k.alias("k"), q.alias("quality"))


@query("SELECT o_orderkey // 5 AS page, o_orderkey AS box_id, round(((o_orderkey // 5) % 40 - 20) / 100.0, 6) AS angle, round((o_orderkey % 5) * 40.0 + 7, 6) AS cx, round((o_orderkey % 3) * 15.0 + 3, 6) AS cy FROM orders")
def deskewed_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a page turned by a slope of its own, turned back."""
    k = F.col("o_orderkey")
    o = render.table(spark, d, "orders").select(F.expr("o_orderkey div 5").alias("page"), k.alias("box_id"), ((k % 5) * 40.0 + 7).alias("x"), ((k % 3) * 15.0 + 3).alias("y"), ((F.expr("o_orderkey div 5") % 40 - 20) / 100).alias("a"))
    c, s = F.cos("a"), F.sin("a")
    cx, cy = F.col("x") * c - F.col("y") * s, F.col("x") * s + F.col("y") * c
    quads = o.select("page", "box_id", cx.alias("cx"), cy.alias("cy"), (cx - 10 * c).alias("x1"), (cy - 10 * s).alias("y1"), (cx + 10 * c).alias("x2"), (cy + 10 * s).alias("y2"))
    return spatial.deskew(quads, "page").select("page", "box_id", F.round("angle", 6).alias("angle"), F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query("SELECT p_partkey // 12 AS page, p_partkey AS box_id, p_partkey - p_partkey % 12 % 4 AS cluster FROM part")
def proximity_groups(spark: SparkSession, d: str) -> DataFrame:
    """Runs of four boxes 30 apart, the runs far from each other."""
    k = F.col("p_partkey")
    b = render.table(spark, d, "part").select(F.expr("p_partkey div 12").alias("page"), k.alias("box_id"), ((k % 12 % 4) * 60.0).alias("x"), (F.expr("p_partkey % 12 div 4") * 300.0).alias("y"), F.lit(30.0).alias("w"), F.lit(12.0).alias("h"))
    return segment.near_groups(b, "page")


# --- parties, choices of the uploader, rows and responses ---------------------------------------------------------------

_SELLER, _BUYER_KEY = "(o_orderkey % 900 + 1)", "(20000 + o_custkey)"


@query(f"""
WITH o AS (SELECT o_orderkey AS doc_id, (o_orderkey // 8 + o_orderkey) % 6 AS k, o_custkey AS c, {O.company_id_sql(_SELLER)} AS seller, {O.company_id_sql(_BUYER_KEY)} AS buyer FROM orders)
SELECT doc_id, CASE WHEN k < 4 THEN seller END AS seller_id, k < 4 AS seller_ok, k IN (0, 1) AS labelled, CASE WHEN k IN (0, 3, 5) THEN buyer END AS buyer_id,
  CASE WHEN k IN (0, 3, 5) AND c_custkey IS NOT NULL THEN upper(c_name) WHEN k IN (0, 4) THEN 'FIRMA ' || c || ' SRL' WHEN k = 5 THEN 'R0 ' || buyer END AS buyer_name, k IN (0, 3, 5) AND c_custkey IS NOT NULL AS buyer_known
FROM o LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) x ON c = c_custkey""")
def buyer_fields(spark: SparkSession, d: str) -> DataFrame:
    """Sellers by label, by prefix and by bare number; buyers by what is printed and what the registry calls them.

    On a line of `C.I.F. CLIENT.` what follows is read as id and, as the line says no CIF, as name too."""
    seller, buyer = render.company_id(F.expr(_SELLER)), render.company_id(F.expr(_BUYER_KEY))
    say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    client, cif = say("Client: FIRMA ", F.col("o_custkey"), " SRL"), say("CIF CLIENT: RO", buyer)
    kinds = [
        (say("COD FISCAL: RO", F.translate(seller, "0", "O")), cif, client),
        (say("Str. Lunga ro ", seller),),
        (say("STATIE GPL GAZ ", seller, " 12345"),),
        (say("CUI CLIENT ", buyer), say("raft ", buyer), say("raft ", seller)),
        (say("MAGAZIN SRL 20250114"), client, say("POS ", seller)),
        (say("C.I.F. CLIENT. R0 ", buyer),),
    ]
    k, body = F.expr("(o_orderkey div 8 + o_orderkey) % 6"), F.array().cast("array<string>")
    for i, said in enumerate(kinds):
        body = F.when(k == i, F.array(*said)).otherwise(body)
    lines = render.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.posexplode(F.concat(F.array(F.lit("MAGAZIN SRL")), body)).alias("line_no", "text"))
    known = render.table(spark, d, "customer").where("c_custkey % 2 = 0").select(render.company_id(20000 + F.col("c_custkey")).alias("cui"), F.upper("c_name").alias("name"))
    return parties.named_buyers(parties.parties(lines), known).drop("candidates")


@query("""
WITH o AS (SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'Bon' WHEN 1 THEN 'CHITANTA' WHEN 2 THEN 'auto' END AS t, CASE o_custkey % 3 WHEN 0 THEN 'bon' WHEN 1 THEN 'chitanta' END AS m, o_totalprice > 150000 AS looks FROM orders)
SELECT doc_id, CASE lower(coalesce(t, m, 'auto')) WHEN 'chitanta' THEN true WHEN 'bon' THEN false ELSE looks END AS slip FROM o""")
def mode_override(spark: SparkSession, d: str) -> DataFrame:
    """The type an uploader chose goes before the mode, and both before what the document looks like."""
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey") % 3
    doc_type, mode = F.when(k == 0, "Bon").when(k == 1, "CHITANTA").when(k == 2, "auto"), F.when(c == 0, "bon").when(c == 1, "chitanta")
    return render.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), text.treated_as_slip(doc_type, mode, F.col("o_totalprice") > 150000).alias("slip"))


@query(O.with_heads("""
, f AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'Chitanță POS' WHEN 1 THEN 'Chitanță de mână' WHEN 2 THEN 'Factură' END AS forced FROM heads)
SELECT doc_id, coalesce(forced, 'Bon Fiscal') AS kind, forced IS NULL AND cash AS kind_unsure, total / 100.0 AS total, CASE WHEN forced LIKE 'Chit%' THEN total / 100.0 ELSE (total - vat) / 100.0 END AS base,
  CASE WHEN forced LIKE 'Chit%' THEN 0.0 ELSE vat / 100.0 END AS vat, CASE WHEN forced LIKE 'Chit%' THEN '-' ELSE CAST(rate AS VARCHAR) END AS rates, cash AND coalesce(forced NOT LIKE 'Chit%', true) AS vat_unsure,
  CASE WHEN forced LIKE 'Chit%' THEN NULL ELSE rate END AS breakdown, CASE forced WHEN 'Chitanță POS' THEN '5125' WHEN 'Chitanță de mână' THEN '5311' ELSE '604' END AS account FROM f"""))
def forced_types(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose kind is forced: VAT and account follow from it."""
    k = F.col("doc_id") % 4
    forced = F.when(k == 0, "Chitanță POS").when(k == 1, "Chitanță de mână").when(k == 2, "Factură")
    docs = render.receipt_heads(spark, d).select(
        "doc_id", F.lit("Bon Fiscal").alias("kind"), F.col("cash").alias("kind_unsure"), (F.col("total") / 100).alias("total"), ((F.col("total") - F.col("vat")) / 100).alias("base"),
        (F.col("vat") / 100).alias("vat"), F.col("rate").cast("string").alias("rates"), F.col("cash").alias("vat_unsure"), F.col("rate").alias("breakdown"), F.lit("604").alias("account"), forced.alias("forced"),
    )
    return rows.forced_kinds(docs).drop("forced")


@query("""
WITH o AS (SELECT o_custkey AS upload, o_orderkey AS doc, CAST(floor(o_totalprice) AS BIGINT) AS total, o_orderkey % 3 = 0 AS slip, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 = 0, o_orderkey) AS i FROM orders),
j AS (SELECT *, '{"index":' || i || ',"doc_id":' || doc || ',"total":' || total || '}' AS j FROM o),
g AS (SELECT upload, count(*) FILTER (NOT slip) AS n, count(*) FILTER (slip) AS m, coalesce(string_agg(j, ',' ORDER BY i) FILTER (NOT slip), '') AS r, coalesce(string_agg(j, ',' ORDER BY i) FILTER (slip), '') AS c, string_agg(j, ',' ORDER BY i) AS a, arg_min(j, i) AS f FROM j GROUP BY upload)
SELECT upload, '{"success":true,"message":"' || n || ' bonuri, ' || m || ' chitante detectate","receipts":[' || r || '],"chitante":[' || c || '],"accounting_data":' || f || ',"accounting_data_array":[' || a || ']}' AS response FROM g""")
def json_responses(spark: SparkSession, d: str) -> DataFrame:
    """The response to each upload, as JSON text."""
    o = render.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("upload"), F.floor("o_totalprice").cast("long").alias("total"))
    flat = rows.receipt_rows(o.where("doc_id % 3 <> 0")).unionByName(rows.slip_rows(o.where("doc_id % 3 = 0")))
    return boxes.responses(rows.reindexed(flat.join(o.select("doc_id", "upload"), "doc_id")), "upload", ["doc_id", "total"])


@query(O.with_heads("""
SELECT doc_id, CASE WHEN cash THEN 'Chitanță' ELSE 'Bon Fiscal' END AS kind, CAST(doc_id AS VARCHAR) AS number, strftime(date, '%Y-%m-%d') AS date, upper(s_name) AS company, total / 100.0 AS total,
  CASE WHEN NOT cash THEN (total - vat) / 100.0 END AS base, CASE WHEN NOT cash THEN vat / 100.0 END AS vat, CASE WHEN NOT cash THEN CAST(rate AS VARCHAR) END AS rates FROM heads JOIN supplier ON s_suppkey = seller"""))
def legacy_row_values(spark: SparkSession, d: str) -> DataFrame:
    """Receipts and slips as rows of one kind, with all their values."""
    supplier = render.table(spark, d, "supplier").select(F.col("s_suppkey").alias("seller"), F.upper("s_name").alias("company"))
    h = render.receipt_heads(spark, d).join(supplier, "seller")
    full = h.select(
        "doc_id", F.col("doc_id").cast("string").alias("number"), F.date_format("date", "yyyy-MM-dd").alias("date"), "company", (F.col("total") / 100).alias("total"),
        ((F.col("total") - F.col("vat")) / 100).alias("base"), (F.col("vat") / 100).alias("vat"), F.col("rate").cast("string").alias("rates"), "cash",
    )
    return rows.receipt_rows(full.where("NOT cash")).unionByName(rows.slip_rows(full.where("cash")))


@query(f"""
WITH g AS (SELECT l_orderkey AS doc_id, CASE WHEN l_returnflag = 'A' THEN 21 WHEN l_returnflag = 'N' THEN 11 ELSE 9 END AS rate, sum(CAST(floor(l_extendedprice / 100) AS BIGINT))::BIGINT AS b FROM lineitem GROUP BY 1, 2),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, sum(b) OVER (PARTITION BY doc_id) AS all_b FROM g)
SELECT doc_id, CASE WHEN n > 1 THEN {O.ron2('CAST(b AS DOUBLE) + b * rate / 100.0')} ELSE CAST(all_b AS DOUBLE) END AS total, CAST(rate AS DOUBLE) AS rate, CAST(b AS DOUBLE) AS base, b * rate / 100.0 AS vat FROM n""")
def rows_per_rate(spark: SparkSession, d: str) -> DataFrame:
    """One ledger row for each VAT rate of a document; with one rate its printed total stands."""
    rate = F.when(F.col("l_returnflag") == "A", 21).when(F.col("l_returnflag") == "N", 11).otherwise(9)
    g = render.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), rate.alias("rate")).agg(F.sum(F.floor(F.col("l_extendedprice") / 100).cast("long")).alias("b"))
    part = F.struct(F.col("rate").cast("double").alias("rate"), F.col("b").cast("double").alias("base"), (F.col("b") * F.col("rate") / 100).alias("vat"))
    docs = g.groupBy("doc_id").agg(F.sum("b").cast("double").alias("total"), F.collect_list(part).alias("breakdown"))
    return rows.split_by_rate(docs)
