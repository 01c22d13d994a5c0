"""Token ids in length-delimited binary records with masked checksums, and a separate index of offsets for shuffled reads.

A shard is a run of records in id order. A record: length of the payload (uint64), masked CRC-32 of those eight bytes (uint32),
payload, masked CRC-32 of the payload (uint32). Payload: doc_id (int64), width of an id in bytes (uint8), ids. All little-endian.
The index beside it (.idx) holds, per record, doc_id (int64) and offset (uint64). Files that no manifest row names are leavings
of lost tasks and are never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import shared_dir, stage
from ledgerloom.llm.tokens import batches, encoder

_MANIFEST = "file string, first_id long, n_docs long, n_tokens long"


def masked(data: bytes) -> int:
    """CRC-32 turned by 15 bits plus a constant, so that the checksum of data that holds checksums stays telling."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def unframe(data, at: int) -> tuple[bytes, int]:
    """The payload of the record at an offset, and the offset after it; ValueError if a checksum or length is wrong."""
    head = bytes(data[at : at + 8])
    if len(head) < 8 or masked(head) != struct.unpack_from("<I", data, at + 8)[0]:
        raise ValueError(f"bad record head at {at}")
    size = struct.unpack("<Q", head)[0]
    body = bytes(data[at + 12 : at + 12 + size])
    if len(body) < size or masked(body) != struct.unpack_from("<I", data, at + 12 + size)[0]:
        raise ValueError(f"bad record body at {at}")
    return body, at + 16 + size


def _open(folder: str):
    return fs.FileSystem.from_uri(folder)


def write_records(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Encode all texts and write them as shards in ascending id order; the manifest: file, first_id, n_docs, n_tokens, start.

    start is the number of ids in all shards before. Null texts are empty and hold the end id alone; a null id becomes -1,
    which sorts first with any other negatives; rows with equal ids are records of their own, ordered by text hash. An empty
    table writes no shard. Each task writes under a name of its own, so a repeated or doubled task harms nothing.
    """
    spark = df.sparkSession
    folder = folder or f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://")

    def run(rows):
        enc = encoder(path, False)
        wide = "<u2" if max(enc.tokenizer.get_vocab_size(), end_id) <= 0xFFFF else "<u4"
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        name, out, idx, at, first, docs, tokens = f"shard-{uuid.uuid4().hex}", None, None, 0, None, 0, 0
        for batch in rows:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for part in batches(texts):
                for doc, body in zip(ids[part], enc.encode(texts[part]), strict=True):
                    if out is None:
                        out, idx, first = store.open_output_stream(f"{root}/{name}.rec"), store.open_output_stream(f"{root}/{name}.idx"), doc
                    x = np.append(np.frombuffer(body, "<u4"), end_id).astype(wide)
                    rec = frame(struct.pack("<qB", doc, x.itemsize) + x.tobytes())
                    out.write(rec)
                    idx.write(struct.pack("<qQ", doc, at))
                    at, docs, tokens = at + len(rec), docs + 1, tokens + len(x)
        if out is not None:
            out.close()
            idx.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "first_id": [first], "n_docs": [docs], "n_tokens": [tokens]})

    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("tie"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    manifest = stage(rows.mapInArrow(run, _MANIFEST))
    before = Window.orderBy("first_id", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_records(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian uint32 bytes) of all records of the manifest's shards; checksums are verified."""
    schema = "doc_id long, start long, n_tokens long, ids binary"
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(rows):
        for batch in rows:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder, _, name = file.rpartition("/")
                store, root = _open(folder)
                offsets = np.frombuffer(store.open_input_stream(f"{root}/{name}.idx").read(), np.dtype([("doc", "<i8"), ("at", "<u8")]))
                with store.open_input_file(f"{root}/{name}.rec") as f:
                    size = f.size()
                    ends = np.append(offsets["at"][1:], size).astype(np.int64)
                    i = 0
                    while i < len(offsets):  # a few MB at a time
                        j = max(i + 1, int(np.searchsorted(ends, int(offsets["at"][i]) + 4_000_000, "right")))
                        base = int(offsets["at"][i])
                        f.seek(base)
                        data = memoryview(f.read(int(ends[j - 1]) - base))
                        cols: list[list] = [[], [], [], []]
                        for at in offsets["at"][i:j]:
                            body, _end = unframe(data, int(at) - base)
                            doc, width = struct.unpack_from("<qB", body)
                            x = np.frombuffer(body, f"<u{width}", offset=9).astype("<u4")
                            for c, v in zip(cols, (doc, start, len(x), x.tobytes()), strict=True):
                                c.append(v)
                            start += len(x)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow, strict=True)], schema=arrow)
                        i = j

    n = max(1, manifest.count())
    return manifest.select("file", "start").repartition(n, "file").mapInArrow(run, schema)
