"""Receipts printed from the star schema, so that what is read back from them has a known truth: one document per order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Years added to order dates, so that they lie on both sides of a change of VAT rates.
YEARS = 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(cents: Column) -> Column:
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def company_id(key: Column) -> Column:
    """Seven digits from a key and their control digit."""
    p = (1_000_000 + key * 37).cast("string")
    total = sum((F.substring(p, i + 1, 1).cast("int") * w for i, w in enumerate((3, 2, 1, 7, 5, 3, 2))), F.lit(0))
    return F.concat(p, (total * 10 % 11 % 10).cast("string"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(company_id(F.col("s_suppkey")).alias("cui"), F.concat(F.upper("s_name"), F.lit(" SRL")).alias("name"))


def receipt_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seller, date, rate, total and vat in cents, cash: what a receipt of each order with items says."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.floor("l_extendedprice").cast("long")).alias("total"), F.min("l_suppkey").alias("seller"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.add_months(F.col("o_orderdate").cast("date"), 12 * YEARS).alias("date"), F.col("o_orderpriority").startswith("1").alias("cash"))
    out = orders.join(items, F.col("doc_id") == F.col("l_orderkey")).drop("l_orderkey")
    out = out.withColumn("rate", F.when(F.col("date") < F.lit("2025-08-01").cast("date"), 19).otherwise(21).cast("long"))
    return out.withColumn("vat", F.expr("(2 * total * rate + 100 + rate) div (2 * (100 + rate))"))


def receipt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, text. Every fifth id has its zeros read as letters, every fifth has lost its last digit, every seventh receipt has no total line."""
    heads = receipt_heads(spark, sf_dir)
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seller"), "s_name")
    key, cui = F.col("doc_id") % 5, company_id(F.col("seller"))
    printed = F.when(key == 0, F.translate(cui, "0", "O")).when(key == 1, F.substring(cui, 1, 7)).otherwise(cui)
    odd = F.col("doc_id") % 7 == 0
    row = lambda n, text, there=F.lit(True): F.when(there, F.struct(F.lit(n).cast("long").alias("line_no"), text.alias("text")))
    rows = F.array_compact(
        F.array(
            row(1, F.concat(F.upper("s_name"), F.lit(" SRL"))),
            row(2, F.concat(F.lit("COD FISCAL: RO"), printed)),
            row(3, F.concat(F.lit("NUMAR BON FISCAL: "), F.col("doc_id"))),
            row(900, F.concat(F.lit("TOTAL "), money(F.col("total"))), ~odd),
            row(901, F.concat(F.lit("TOTAL TVA A "), F.col("rate"), F.lit(",00% "), money(F.col("vat")))),
            row(902, F.concat(F.lit("DATA: "), F.date_format("date", "dd.MM.yyyy"))),
            row(903, F.concat(F.when(F.col("cash"), "NUMERAR ").otherwise("CARD "), money(F.col("total")))),
            row(904, F.concat(F.lit("SUMA "), money(F.col("total"))), odd),
        )
    )
    frame = heads.join(supplier, "seller")
    frame = frame.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.line_no", "r.text")
    item = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    cents, qty = F.floor("l_extendedprice").cast("long"), F.col("l_quantity").cast("long")
    # two rows of an order may have one number: the part key tells their lines apart
    text = F.concat_ws(" ", F.col("p_name"), qty.cast("string"), F.concat(F.lit("X"), money(F.floor(cents / qty))), money(cents), F.lit("A"))
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    items = item.join(known, "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") + 10).cast("long").alias("line_no"), text.alias("text"))
    return frame.unionByName(items)
