"""What the operators share: reading tables, cutting lineage in the shared folder, joins against checked small sides."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after its rows and bytes were counted and found to be at most so many.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: Keys with so many rows are hot; so many of the hottest keys are joined by broadcast.
HOT_ROWS, HOT_KEYS = 1000, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir of the session; on one machine (tests) a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, and a lost executor costs one task's work."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(name: str, kind: str):
    """Bytes of a column's values, about."""
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(name), F.lit(0))
    if kind == "array<string>":
        return F.coalesce(F.aggregate(name, F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16), F.lit(0))
    return F.coalesce(F.size(name) * 8, F.lit(0)) if kind.startswith("array") else F.lit(8)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df (a staged table), marked for broadcast if it has at most so many rows and bytes; Spark chooses the join otherwise."""
    n, held = df.agg(F.count(F.lit(1)), F.sum(sum((_width(c, k).cast("long") for c, k in df.dtypes), F.lit(0)))).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df


def hottest(counts: DataFrame, on: str, n: str = "n") -> DataFrame | None:
    """The keys with HOT_ROWS or more rows, HOT_KEYS of the hottest at most: a table whose size is bounded; None if there are none.

    A key that is not among them has fewer than HOT_ROWS rows or less than a HOT_KEYS-th of all.
    """
    found = counts.where((F.col(n) >= HOT_ROWS) & F.col(on).isNotNull())
    return stage(found.orderBy(F.desc(n), on).limit(HOT_KEYS).select(on)) if found.limit(1).count() else None


def spread_join(left: DataFrame, right: DataFrame, on: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left join right on one column, where right has one row per key: rows of hot keys stay where they are and meet their
    few rows of right by broadcast, the others meet by shuffle; so no task gathers the rows of one hot key."""
    there = left.where(F.col(on).isNotNull())
    if hot is not None:
        there = there.join(F.broadcast(hot), on, "left_anti")
    out = there.join(right, on, how)
    if hot is not None:
        here = left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), on, "left_semi")), on, how)
        out = out.unionByName(here)
    return out.unionByName(left.where(F.col(on).isNull()), allowMissingColumns=True) if how == "left" else out


def dealt(df: DataFrame) -> DataFrame:
    """df, dealt anew if it has fewer partitions than there are cores: one small file is else one task's work. Large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def giving_back(run):
    """run, a generator over Arrow data for one task, which at its end returns to the system what Arrow's pool holds and does not
    use. A Python worker lives on between tasks and stages; what it keeps there counts against the executor, also while the
    JVM alone works."""

    def out(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return out


def ascii_lower(c):
    """A-Z only; other letters stay as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
