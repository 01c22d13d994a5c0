"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, packing; each stage a written table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontam, lines, near, packing, toxic
from ledgerloom.llm.common import shared_dir, table
from ledgerloom.llm.queries import tokenizer_path, toxicity_model


# All stages take nulls in any column, empty and very long texts, ties, repeated rows, empty tables and further columns,
# whose names may be those of columns that an operator adds; all but the last return the columns of docs.


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that score as toxic; the model is fitted on the labelled rows of the tables.

    Null and blank texts score 0 and stay; equal texts score alike, so repeated rows go or stay together. Where the labels
    teach nothing all rows stay.
    """
    return toxic.drop_toxic(docs, toxicity_model(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with frequent lines cut out of their texts, and n_chars of what is left.

    All rows stay. Null texts become empty. Of documents that hold a line the largest id keeps it, in all its rows; a null id
    keeps its lines and never holds one for others.
    """
    aside = {c: f"_ll_own_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    out = lines.dedup_lines(docs.withColumnsRenamed(aside), min_chars=40, min_docs=5).drop("n_lines", "n_dropped")
    out = out.withColumnsRenamed({v: k for k, v in aside.items()})
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id: five-word shingles, similarity 0.8.

    Null, empty and blank texts have no shingles and all stay; of rows that repeat id and text one stays. A group without
    any id keeps one row.
    """
    return near.keep_one(docs, k=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a benchmark item, or a long run of one.

    Null and empty texts hold none and stay; all rows of an id that is found go, null ids with the others that are null. An
    empty benchmark leaves docs as they are.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), run_words=decontam.RUN_WORDS, short_items=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids and their places in sequences of at most 1024 tokens.

    Null and empty texts are their end id alone; repeated rows and ids are packed each; other columns of docs are left out.
    """
    out = packing.pack(docs.select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=1024)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, function in STAGES:
        function(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
