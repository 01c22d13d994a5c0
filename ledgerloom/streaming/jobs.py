"""The same work on streams: uploads become rows one file at a time, metrics become windows, both restart from their checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, schema, path: str, per_trigger: int = 1) -> DataFrame:
    """Files of a table as they come, so many per batch; path is a pattern or a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that is there now and stop; a second run goes on after the last file, and each file is written once."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def keep_latest(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Write the whole result as it stands after each batch over the one before, and stop at the end of what is there now.

    The result stays on the executors; a batch that is repeated after a restart writes the same again."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder of the session; on one machine a temporary one where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="ledgerloom-")
    return f"{found.rstrip('/')}/stream-{uuid.uuid4().hex}"


def expand_documents(docs: DataFrame) -> DataFrame:
    """One upload to many rows: each document's lines that are not blank."""
    return docs.select("doc_id", F.explode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("line")).select("doc_id", F.md5(F.encode("line", "UTF-8")).alias("line_md5"))


def metric_windows(events: DataFrame, watermark: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of metric samples by tumbling window; samples later than the watermark are left out."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return at.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") * 100).cast("long")).alias("cents")).select(F.col("w.start").alias("start"), "event_type", "n", "cents")
