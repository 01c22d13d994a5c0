"""Line dedup: explode normalised lines, hash, count documents per hash, drop frequent lines, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_lower, dealt, if_small, stage

#: Stripped from both ends of a line to make its key.
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANK)))


def split_lines(text: Column) -> Column:
    """The lines of a text, without end marks; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_lines(df: DataFrame, id_col: str, text_col: str, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(h1, h2, keeper): hashes of the keys that stand in min_docs documents or more, with the largest id that holds each.

    Each row is a document, so a repeated row is one more. A document's lines are made distinct before they leave its row,
    and the count is combined before the shuffle, so a line of all documents costs one row per task.
    """
    keys = F.filter(F.transform(split_lines(F.col(text_col)), line_key), lambda k: F.char_length(k) >= min_chars)
    pairs = F.array_distinct(F.transform(keys, lambda k: F.struct(F.xxhash64(F.lit(1), k).alias("h1"), F.xxhash64(F.lit(2), k).alias("h2"))))
    return (
        df.select(F.col(id_col).alias("_ll_id"), F.explode(pairs).alias("_ll_h"))
        .groupBy("_ll_h.h1", "_ll_h.h2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("_ll_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """df with text_col cut to the kept lines, plus n_lines (before) and n_dropped.

    A line's key is the line stripped of ASCII white space with A-Z lowered. Keys of min_chars code points or more that
    stand in min_docs documents or more lose all their lines, but for those in the largest id that holds the key. Null and
    empty texts are one empty line and come back as the empty text; shorter keys always stay; lines that repeat inside one
    document count once and fall or stay together; rows with equal ids are documents of their own, and a drop found in one
    applies to the lines of the same key in all of them. A null id never holds a key. Columns n_lines and n_dropped of the
    input are replaced; other columns stay. An empty table gives an empty table.
    """
    df = dealt(df)
    hot = stage(repeated_lines(df, id_col, text_col, min_chars, min_docs))
    row = [F.col(id_col).alias("_ll_id"), F.xxhash64(text_col).alias("_ll_row")]  # rows with equal ids may differ in text
    lines = df.select(*row, F.posexplode(split_lines(F.col(text_col))).alias("_ll_pos", "_ll_line")).withColumn("_ll_key", line_key(F.col("_ll_line")))
    drops = (
        lines.where(F.char_length("_ll_key") >= min_chars)
        .select("_ll_id", "_ll_row", "_ll_pos", F.xxhash64(F.lit(1), "_ll_key").alias("h1"), F.xxhash64(F.lit(2), "_ll_key").alias("h2"))
        .join(if_small(hot), ["h1", "h2"])
        .where(F.col("_ll_id") != F.col("keeper"))
        .groupBy("_ll_id", "_ll_row")
        .agg(F.collect_set("_ll_pos").alias("_ll_gone"))
    )
    kept = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    # few touched documents are broadcast, so that no text is shuffled
    out = df.select(*kept, *row).join(if_small(stage(drops)), ["_ll_id", "_ll_row"], "left").withColumn("_ll_lines", split_lines(F.col(text_col)))
    out = out.withColumn("n_lines", F.size("_ll_lines").cast("long")).withColumn("n_dropped", F.coalesce(F.size("_ll_gone"), F.lit(0)).cast("long"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_ll_lines") - 1), F.col("_ll_gone"))
    text = F.when(F.col("_ll_gone").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_ll_lines", i)), "\n"))
    return out.withColumn(text_col, text).select(*kept, "n_lines", "n_dropped")
