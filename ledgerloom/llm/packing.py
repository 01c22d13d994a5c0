"""Harmonic packing: cut documents into pieces of near reciprocal lengths and fill each class's bins by a fixed count."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import dealt, stage
from ledgerloom.llm.tokens import batches, encoder

#: Share of a sequence that the bins of a piece's class may leave empty before the piece is cut at the next reciprocal.
SLACK = 1 / 32
#: Pieces that one worker packs by itself, about.
PIECES_PER_WORKER = 20_000


def cuts(n: int, capacity: int, slack: float = SLACK) -> list[int]:
    """Lengths of a document's pieces, in order: full sequences first, then the largest reciprocals that fit.

    Class k holds lengths in (capacity/(k+1), capacity/k], k to a bin. A rest stays whole if k of its like fill a bin up to
    the slack; else the next reciprocal, capacity // (k+1), is cut off it, which fills its bins, and the rest goes on.
    """
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        if capacity - k * n <= slack * capacity or k == capacity:
            out.append(n)
            break
        out.append(capacity // (k + 1))
        n -= out[-1]
    return out


def tokenized_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = 1024, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens and (with_ids) ids, little-endian uint32 bytes.

    Null texts are empty and so hold the end id alone.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def run(rows):
        enc, end = encoder(path, True), np.asarray([end_id], "<u4").tobytes()
        for batch in rows:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for part in batches(texts):
                cols: list[list] = [[] for _ in range(5 + with_ids)]
                for doc, body in zip(ids[part], enc.encode(texts[part]), strict=True):
                    body += end
                    start = 0
                    for length in cuts(len(body) // 4, capacity):
                        piece = body[4 * start : 4 * (start + length)]
                        for c, x in zip(cols, (doc, start, length, zlib.crc32(piece), len(body) // 4, piece), strict=False):
                            c.append(x)
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 5 else pa.binary()) for i, c in enumerate(cols)], schema=arrow)

    arrow = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [("ids", pa.binary())] * with_ids)
    return dealt(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, schema)


def harmonic_bins(pieces: DataFrame, capacity: int = 1024, pieces_per_worker: int = PIECES_PER_WORKER) -> DataFrame:
    """pieces (a staged table with doc_id, start, length) with sequence_id, offset and sequence_tokens.

    Rows are dealt to workers by a hash. Each worker numbers the pieces of each class and puts k = capacity // length of
    them into a bin; what is left over of each class, fewer than k pieces, meets in one small group per worker that is
    filled by first fit, longest first. That group has fewer pieces than the sum of all k, whatever the input. Ids are
    unique, not gapless. Ties are broken by doc_id and start; equal rows take any order among themselves.
    """
    workers = max(1, -(-pieces.count() // pieces_per_worker))
    n_ids = (capacity + 1) * workers
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset", "sequence_tokens")]
    # a document's pieces go to different workers: a copied doc_id must not fill one of them
    df = pieces.select(*own, (F.lit(capacity) / F.col("length")).cast("int").alias("_ll_k"), F.pmod(F.xxhash64("doc_id", "start", F.rand(7)), F.lit(workers)).cast("int").alias("_ll_w"))
    df = df.withColumn("_ll_n", F.row_number().over(Window.partitionBy("_ll_w", "_ll_k").orderBy("doc_id", "start")) - 1)
    df = df.withColumn("_ll_all", F.count(F.lit(1)).over(Window.partitionBy("_ll_w", "_ll_k")))
    df = df.withColumn("_ll_bin", F.floor(F.col("_ll_n") / F.col("_ll_k")))
    df = stage(df)
    whole = F.col("_ll_bin") < F.floor(F.col("_ll_all") / F.col("_ll_k"))
    here = Window.partitionBy("_ll_w", "_ll_k", "_ll_bin")
    full = df.where(whole).select(
        *own,
        (F.col("_ll_bin") * n_ids + F.col("_ll_k") * workers + F.col("_ll_w")).alias("sequence_id"),
        (F.sum("length").over(here.orderBy("_ll_n").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"),
        F.sum("length").over(here).alias("sequence_tokens"),
    )

    def first_fit(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        fill: list[int] = []
        bins, offsets = [], []
        for length in pdf["length"]:
            at = next((i for i, x in enumerate(fill) if x + length <= capacity), len(fill))
            if at == len(fill):
                fill.append(0)
            bins.append(at)
            offsets.append(fill[at])
            fill[at] += length
        pdf["sequence_id"] = [b * n_ids + w for b, w in zip(bins, pdf["_ll_w"], strict=True)]  # class 0 is free for these
        pdf["offset"], pdf["sequence_tokens"] = offsets, [fill[b] for b in bins]
        return pdf[out.fieldNames()]

    out = full.schema
    rest = df.where(~whole).select(*own, "_ll_w").groupBy("_ll_w").applyInPandas(first_fit, out)
    return full.unionByName(rest)


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = 1024, with_ids: bool = True) -> DataFrame:
    """Pack all texts into sequences of at most capacity tokens; one row per piece, with its ids if asked for.

    Each text is encoded whole, the end id is appended, and each id lies in exactly one piece. Null texts are empty; a
    document of an empty text is its end id. Rows with equal ids are documents of their own. An empty table gives none.
    """
    pieces = tokenized_pieces(df, path, id_col, text_col, end_id, capacity, with_ids)
    if not with_ids:
        return harmonic_bins(stage(pieces), capacity)
    # ids are the bulk of a piece: they are shuffled once, to the places found without them
    pieces = stage(pieces.withColumn("_ll_piece", F.monotonically_increasing_id()))
    placed = harmonic_bins(pieces.drop("ids"), capacity).join(pieces.select("_ll_piece", "ids"), "_ll_piece")
    return placed.select(*(c for c in pieces.columns if c != "_ll_piece"), "sequence_id", "offset", "sequence_tokens")


def sequences(packed: DataFrame, capacity: int = 1024, pad_id: int = 0) -> DataFrame:
    """The sequences themselves from pack(..., with_ids=True): sequence_id, input_ids (padded to capacity unless their count is a power of two), doc_ids, starts, lengths."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids"))).alias("p"), F.max("sequence_tokens").alias("n"))

    def fill(batches_):
        for pdf in batches_:
            ids = []
            for p, n in zip(pdf["p"], pdf["n"], strict=True):
                x = np.frombuffer(b"".join(q["ids"] for q in p), "<u4").astype("int64")
                ids.append(x if n & (n - 1) == 0 else np.pad(x, (0, capacity - n), constant_values=pad_id))
            yield pdf.assign(input_ids=ids, doc_ids=[[q["doc_id"] for q in p] for p in pdf["p"]], starts=[[q["start"] for q in p] for p in pdf["p"]], lengths=[[q["length"] for q in p] for p in pdf["p"]])[["sequence_id", "input_ids", "doc_ids", "starts", "lengths"]]

    return rows.mapInPandas(fill, "sequence_id long, input_ids array<long>, doc_ids array<long>, starts array<long>, lengths array<long>")
