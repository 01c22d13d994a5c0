"""Readers of recognised text: box dumps, page text, words; and writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOX = "text string, t string, x double, y double, w double, h double"


def read_box_dumps(spark: SparkSession, path: str) -> DataFrame:
    """file, box_id, text, x, y, w, h of JSON dumps: arrays of boxes; words are called text or t."""
    raw = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.from_json("value", f"array<struct<{BOX}>>").alias("b"))
    return raw.select("file", F.posexplode("b").alias("box_id", "b")).select("file", "box_id", F.coalesce("b.text", "b.t").alias("text"), "b.x", "b.y", "b.w", "b.h")


def text_boxes(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, box_id, text, x, y, w, h: each line of a page's own text that is not blank, as a box 20 apart, if the page says more than 50 characters."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != "")
    out = pages.where(F.char_length(F.trim(text)) > 50).select(key, F.posexplode(lines).alias("box_id", "text"))
    return out.select(key, "box_id", "text", F.lit(0.0).alias("x"), (F.col("box_id") * 20.0).alias("y"), F.lit(500.0).alias("w"), F.lit(20.0).alias("h"))


def words(lines: DataFrame, key: str, text: str) -> DataFrame:
    """key, word_no, word: the runs of characters other than white space."""
    return lines.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"[^ \t\n\x0b\f\r]+"), F.lit(0))).alias("word_no", "word"))


def best_readings(readings: DataFrame, key: str, score: str, k: int = 4) -> DataFrame:
    """The k likeliest readings of each observation; of equally likely ones those that come first by their other columns."""
    ties = [c for c in readings.columns if c not in (key, score)]
    return readings.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), *ties))).where(F.col("_r") <= k).drop("_r")


def response(columns: list[str]) -> Column:
    """A row as the JSON text of a response document."""
    return F.to_json(F.struct(*columns))


def responses(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and response: per upload the JSON text of its receipts and slips, in the order of their index, all entries and the first of them.

    rows as of `rows.reindexed`: kind, index and columns. An upload of one kind only has an empty list for the other; null
    values are left out of their row. A response holds one upload's documents, so its size is that of the upload.
    """
    entry = F.struct("index", *(c for c in columns if c != "index"))
    by = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("index").alias("_i"), (F.col("kind") == "Chitanță").alias("_slip"), entry.alias("_row")))).alias("_all"))
    of = lambda keep: F.transform(F.filter("_all", keep), lambda x: x["_row"])
    n = lambda slip: F.size(F.filter("_all", (lambda x: x["_slip"]) if slip else (lambda x: ~x["_slip"]))).cast("string")
    message = F.concat(n(False), F.lit(" bonuri, "), n(True), F.lit(" chitante detectate"))
    parts = F.struct(
        F.lit(True).alias("success"), message.alias("message"),
        of(lambda x: ~x["_slip"]).alias("receipts"), of(lambda x: x["_slip"]).alias("chitante"),
        F.get(of(lambda x: F.lit(True)), F.lit(0)).alias("accounting_data"), of(lambda x: F.lit(True)).alias("accounting_data_array"),
    )
    return by.select(key, F.to_json(parts).alias("response"))


def full_text(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """key, full_text: all documents of an upload in order, parted by a rule."""
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n\n---\n\n").alias("full_text"))


def guess_mapping(labels: dict[str, str]) -> Column:
    """The field whose label's first word a template header holds, fields in order; null for none."""
    out = F.when(F.lit(False), None)
    for field, label in labels.items():
        out = out.when(F.contains(F.lower("header"), F.lit(label.split(" ")[0].lower())), field)
    return out
