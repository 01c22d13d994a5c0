"""Hilbert-curve ordering: quantise several metadata dimensions, sort by curve index, cut runs into shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import hottest, if_small, spread_join, stage

#: Bits of each dimension on the curve; 2 ** BITS quantiles each.
BITS = 5


def string_places(df: DataFrame, dim: str, bits: int) -> tuple[DataFrame, DataFrame]:
    """(dim, _ll_place) of every distinct value of a string column: the quantile of its rows, from 0 to 2 ** bits - 1, and (dim, n).

    Values are sorted by range partitions; what goes to the driver is one sum per partition.
    """
    counts = df.where(F.col(dim).isNotNull()).groupBy(dim).agg(F.count(F.lit(1)).alias("n"))
    ranged = stage(counts.repartitionByRange(dim).withColumn("_ll_part", F.spark_partition_id()))
    before, total = {}, 0
    for part, n in sorted(map(tuple, ranged.groupBy("_ll_part").agg(F.sum("n")).collect())):
        before[part] = total
        total += n
    starts = df.sparkSession.createDataFrame([*before.items()] or [(0, 0)], "_ll_part int, _ll_before long")
    so_far = F.sum("n").over(Window.partitionBy("_ll_part").orderBy(dim)) - F.col("n") / 2 + F.col("_ll_before")
    places = ranged.join(F.broadcast(starts), "_ll_part").select(dim, F.least(F.floor(so_far * 2**bits / max(total, 1)), F.lit(2**bits - 1)).cast("double").alias("_ll_place"))
    return places, ranged.select(dim, "n")


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of rows of bits-bit coordinates (Skilling's transposed form)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the excess rotations
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(on, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def with_curve(df: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """df with `curve`: each dimension becomes its quantile among at most 2 ** bits, and these the index on the curve.

    The cut points of numbers are percentiles of all rows, a fixed number whatever the input; a string's place is the quantile
    of its whole value among those of all rows. Nulls take the lowest place.
    """
    kinds, own = dict(df.dtypes), df.columns
    for i, d in enumerate(dims):
        if kinds[d] == "string":
            places, counts = string_places(df, d, bits)
            places = places.withColumnRenamed("_ll_place", f"_ll_d{i}")
            df = spread_join(df, if_small(places), d, hottest(counts, d), "left")
        else:
            df = df.withColumn(f"_ll_d{i}", F.col(d).cast("double"))
    shares = [i / 2**bits for i in range(1, 2**bits)]
    found = df.agg(*(F.percentile_approx(f"_ll_d{i}", shares, 1000) for i, d in enumerate(dims) if kinds[d] != "string"), F.lit(None)).first()
    found = iter(found)
    cuts = [range(1, 2**bits) if kinds[d] == "string" else sorted(set(next(found) or [])) for d in dims]

    @F.pandas_udf("long")
    def curve(codes: pd.DataFrame) -> pd.Series:
        points = np.column_stack([np.where(np.isnan(v := codes.iloc[:, i].to_numpy(float)), 0, np.searchsorted(np.asarray(c, float), v, "right")) for i, c in enumerate(cuts)])
        return pd.Series(hilbert_index(points, bits))

    return df.select(*own, curve(F.struct(*(f"_ll_d{i}" for i in range(len(dims))))).alias("curve"))


def hilbert_shards(df: DataFrame, dims: list[str], shards: int, tie: list[str], bits: int = BITS) -> DataFrame:
    """df in curve order, cut into runs of rows whose counts are at most one apart: plus curve, shard and slot (gapless from 0).

    Rows are sorted by curve, then by a hash of the tie columns, so that a place that holds a third of all rows is still
    spread over tasks, and by the tie columns; equal rows take any order. Input columns named curve, shard or slot are
    replaced. Fewer rows than shards leave shards empty; an empty table gives an empty table.
    """
    df = with_curve(df.drop(*({"curve", "shard", "slot"} - {*dims, *tie})), dims, bits)
    df = df.withColumn("_ll_tie", F.xxhash64(*tie))
    # the number of a row in its task comes with its id; tasks are kept apart by the table they are written to
    rows = stage(df.repartitionByRange("curve", "_ll_tie", *tie).sortWithinPartitions("curve", "_ll_tie", *tie).withColumn("_ll_id", F.monotonically_increasing_id()))
    task, place = F.shiftright("_ll_id", 33), F.col("_ll_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["task"], r["count"]) for r in rows.groupBy(task.alias("task")).count().collect())  # one row per task of a shuffle
    n, before, total = [], [], 0
    for t, k in sizes:
        n.append(t), before.append(total)
        total += k
    starts = rows.sparkSession.createDataFrame([*zip(n, before, strict=True)] or [(0, 0)], "_ll_task int, _ll_before long")
    rank = F.col("_ll_before") + place
    out = rows.withColumn("_ll_task", task.cast("int")).join(F.broadcast(starts), "_ll_task")
    out = out.withColumn("shard", F.expr(f"int((_ll_before + (_ll_id & {(1 << 33) - 1}L)) * {shards} div {max(total, 1)})"))
    out = out.withColumn("slot", rank - F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) div {shards}"))
    return out.drop("_ll_id", "_ll_task", "_ll_before", "_ll_tie")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order: readers that filter on the dimensions skip files by their statistics."""
    sharded.repartitionByRange("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
