"""MinHash near-dedup: universal hash minima, banding, signature verification, confirmation on full sets, components."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import dealt, giving_back, hottest, if_small, spread_join, stage
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.shingles import mix, shingle_set

#: Bands and rows: a pair of similarity 0.8 shares no band with probability (1 - 0.8 ** 6) ** 42, three in a million.
BANDS, ROWS = 42, 6
#: A bucket's members are joined to its head into one group if their signatures agree in so large a share at least; those that
#: agree in less than the second share meet another head of the same bucket, HEADS in all. What is then left of a bucket is a
#: group of its own. Distances of sets obey the triangle inequality: of two linked documents both are near a head, or both go on.
GROUP_FLOOR, HEADED, HEADS = 0.35, 0.65, 2
#: Standard errors below the threshold from which the signatures of two documents rule out a link.
SIGMAS = 5
#: Documents of a group, and bytes of their sets, that one task holds against as many others, about.
BLOCK, BLOCK_BYTES = 1000, 32 << 20
#: Shingles that one matrix product counts.
COLUMNS = 4096


@functools.lru_cache(maxsize=4)
def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n functions of the multiply-add-shift family over 32-bit keys."""
    r = np.random.default_rng(11)
    return r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """The least value of each of n universal hashes over a set, 64 bits each."""
    a, b = _family(n)
    out = np.full(n, 2**64 - 1, np.uint64)
    keys = shingles >> np.uint64(32)
    for i in range(0, len(keys), 256):  # blocks that stay in the processor's cache
        h = a[:, None] * keys[None, i : i + 256]
        h += b[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return out


def set_node(s: np.ndarray) -> int:
    """A hash of a whole set, never 0."""
    folded = np.bitwise_xor.reduce(mix(s), keepdims=True) + np.uint64(len(s))
    return int((mix(folded) + s.sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0]) or 1


def features(df: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (a hash of the whole set, 0 for none), sig (a byte of each scrambled minimum: unequal
    minima agree in one of 256) and bands (a hash for each)."""
    schema = "doc_id long, text_hash long, n_shingles long, node long, sig binary, bands array<long>"
    arrow = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])
    place = np.arange(bands, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in arrow]
            for doc, text, of in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                s = shingle_set((text.as_py() or "").encode(), k)
                if len(s):
                    low = minima(s, bands * rows)
                    h = mix(place + np.uint64(1))
                    for r in range(rows):
                        h = mix(h + low[r::rows])
                    x = (doc, of, len(s), set_node(s), (mix(low) & np.uint64(255)).astype(np.uint8).tobytes(), h.view(np.int64).tolist())
                else:
                    x = (doc, of, 0, 0, b"", [])
                for c, v in zip(cols, x, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(giving_back(run), schema)


def signature_agreement(a: str, b: str):
    """Share of equal bytes of two signature columns."""

    @F.pandas_udf("double")
    def share(x, y):
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype="float64")
        left = np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1)
        right = np.frombuffer(b"".join(y), np.uint8).reshape(len(y), -1)
        return pd.Series((left == right).mean(axis=1))

    return share(F.col(a), F.col(b))


def _by_key(batches, n_key: int):
    """Lists of rows with equal leading columns, from batches that are sorted by them."""
    key, held = None, []
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols, strict=True):
            if row[:n_key] != key:
                if held:
                    yield held
                key, held = row[:n_key], []
            held.append(row)
    if held:
        yield held


def agreements(sig: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The number of bytes in which each row of sig equals one; the width is a multiple of 8 and below 2,048."""
    equal = (sig == one).view(np.uint64).sum(axis=1)  # eight counts in the bytes of a word
    return equal.view(np.uint8).reshape(-1, 8).sum(axis=1)


def common_counts(sets: list[np.ndarray], first: int | None = None) -> np.ndarray:
    """The sizes of the intersections of sets (sorted distinct hashes), exact: of the first ones with the others, or, without
    first, of all pairs (i, j) with i < j; other places of that matrix mean nothing.

    A shingle of one set counts for no pair. One of few sets counts pair by pair; one of a fifth of the sets or more is a
    column of 0 and 1 in a matrix product. So the work of a set's shingle is bounded by the number of sets.
    """
    n = len(sets)
    left, right = (slice(None), slice(None)) if first is None else (slice(0, first), slice(first, n))
    out = np.zeros((n, n) if first is None else (first, n - first), np.int64)
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    rows, values = rows[order], values[order]
    del order  # arrays of all shingles are the bulk of a task's memory
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    width = np.diff(np.r_[start, len(values)]).astype(np.int32)
    del values, start
    rows, width = rows[np.repeat(width > 1, width)], width[width > 1]
    start, many = np.cumsum(width) - width, width >= n / 5
    wide = np.repeat(many, width)
    column, row = np.repeat(np.cumsum(many, dtype=np.int32) - 1, width)[wide], rows[wide]
    for c in range(0, int(many.sum()), COLUMNS):
        low, high = np.searchsorted(column, [c, c + COLUMNS])
        m = np.zeros((n, COLUMNS), np.float32)
        m[row[low:high], column[low:high] - c] = 1
        out += (m[left] @ m[right].T).astype(np.int64)
    place = np.flatnonzero(~wide)
    end, lag = np.repeat((start + width)[~many], width[~many]), 1
    while (going := place + lag < end).any():  # rows of one shingle whose places are lag apart
        place, end = place[going], end[going]
        x, y = rows[place].astype(np.int64), rows[place + lag]
        if first is not None:
            across = (x < first) & (y >= first)
            x, y = x[across], y[across] - first
        out += np.bincount(x * out.shape[1] + y, minlength=out.size).reshape(out.shape)
        lag += 1
    return out


def forest(linked: np.ndarray, offset: int, n: int) -> list[tuple[int, int]]:
    """Pairs (i, j + offset) of a matrix of links that connect all that it connects, without a cycle; i and j + offset are below n."""
    root, found = np.arange(n), []
    for i in range(len(linked)):
        to = np.flatnonzero(linked[i]) + offset
        roots, at = np.unique(root[to], return_index=True)
        new = roots != root[i]
        if new.any():
            found += [(i, int(j)) for j in to[at[new]]]
            root[np.isin(root, roots)] = root[i]
    return found


def linked_rows(sig: np.ndarray, sets: list[np.ndarray], first: int | None, percent: int, floor: float) -> list[tuple[int, int]]:
    """Pairs of rows that connect all rows of similarity percent or more, of the first rows with the others or (first None) of
    all: signatures that agree in fewer than floor bytes rule a pair out, full sets decide on the others."""
    n = np.array([len(s) for s in sets])
    offset, heads = (0, len(sets)) if first is None else (first, first)
    fit = np.zeros((heads, len(sets) - offset), bool)
    for i in range(heads):
        low = i + 1 if first is None else first
        m = n[low:]
        fit[i, low - offset :] = (agreements(sig[low:], sig[i]) >= floor) & (100 * np.minimum(m, n[i]) >= percent * np.maximum(m, n[i]))
    used = np.zeros(len(sets), bool)  # rows of no candidate pair need no sets
    used[:heads] = fit.any(axis=1)
    used[offset:] |= fit.any(axis=0)
    at = np.flatnonzero(used)
    if not len(at):
        return []
    before = None if first is None else int(used[:first].sum())
    common = common_counts([sets[i] for i in at], before)
    a, b = (at, at) if before is None else (at[:before], at[before:])
    fit = fit[np.ix_(a, b - offset)] & (100 * common >= percent * (n[a][:, None] + n[b][None, :] - common))
    return [(int(at[i]), int(at[j])) for i, j in forest(fit, before or 0, len(at))]


def links(sets: DataFrame, members: DataFrame, percent: int, n_minima: int) -> DataFrame:
    """Links (a, b) that join, within each group, all nodes that are connected by similarities of percent or more.

    sets: node, shingles; members: node, n_shingles, sig, group. Each group is dealt into blocks of bounded rows and bytes;
    each pair of blocks is one task's work, which compares all signatures, counts what is common to the full sets of those
    that they leave, and emits a forest of the links. So each pair of the group is settled, and none is emitted that adds nothing.
    """
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") * 8 / BLOCK_BYTES)).cast("int")
    sizes = stage(members.groupBy("group").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    placed = spread_join(members, sizes.drop("n"), "group", hottest(sizes, "group")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.join(sets, "node")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    placed = placed.withColumn("p", F.explode(pair)).select("group", "p.i", "p.j", "block", "node", "sig", "shingles")
    floor = n_minima * (percent / 100 - SIGMAS * math.sqrt(percent / 100 * (1 - percent / 100) / n_minima))
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    spare = -n_minima % 8

    def run(batches):
        for rows in _by_key(batches, 3):
            sig = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(len(rows), -1)
            sig = np.pad(sig, ((0, 0), (0, spare)))
            one = rows[0][1] == rows[0][2]
            first = None if one else sum(r[3] == r[1] for r in rows)
            if first == len(rows) or first == 0:
                continue
            found = linked_rows(sig, [np.frombuffer(r[6], np.uint64) for r in rows], first, percent, floor + spare)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([rows[x][4] for x in c], pa.int64()) for c in zip(*found, strict=True)], schema=arrow)

    order = ["group", "i", "j"]
    return placed.repartition(*order).sortWithinPartitions(*order, "block").mapInArrow(giving_back(run), "a long, b long")


def shingle_sets(df: DataFrame, k: int) -> DataFrame:
    """node and shingles (the set's sorted 64-bit hashes) of the column `text`."""
    arrow = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for batch in batches:
            for text in batch.column(0):  # a row at a time: sets are large
                if len(s := shingle_set((text.as_py() or "").encode(), k)):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((set_node(s), s.tobytes()), arrow, strict=True)], schema=arrow)

    return df.select("text").mapInArrow(giving_back(run), "node long, shingles binary")


def grouped(own: DataFrame) -> DataFrame:
    """node and group: groups of nodes that share a band and may be linked; a node may be in several.

    own: node, sig, bands. In each round the least node of a bucket is its head; members that agree with it far enough are
    done, the others meet the next head. So most buckets are settled without pairing their members with each other, also one
    that many unlike documents share because of a common passage. Who is far from all heads of a bucket stays with the others
    that are, as a group; equal ones of several buckets are one.
    """
    sigs = own.select("node", "sig")
    left, edges, rest = own.select("node", F.explode("bands").alias("bucket")), sigs.select("node", F.col("node").alias("head")).where("false"), None
    for last in [False] * (HEADS - 1) + [True]:
        heads = stage(left.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"))
        if not heads.limit(1).count():
            break
        met = spread_join(left, heads.drop("n"), "bucket", hottest(heads, "bucket")).where("node <> head")
        pairs = stage(met.select("node", "head").distinct())
        head_sigs = sigs.select(F.col("node").alias("head"), F.col("sig").alias("head_sig"))
        judged = spread_join(pairs.join(sigs, "node"), head_sigs, "head", hottest(heads.groupBy("head").agg(F.sum("n").alias("n")), "head"))
        judged = stage(judged.select("node", "head", signature_agreement("sig", "head_sig").alias("share")))
        edges = edges.unionByName(judged.where(F.col("share") >= GROUP_FLOOR).select("node", "head"))
        far = judged.where(F.col("share") < HEADED).select("node", "head")
        if not far.limit(1).count():
            break
        left = stage(met.join(far, ["node", "head"], "left_semi").select("node", "bucket"))
        if last:
            rest = left
    groups = connected_components(edges).withColumnRenamed("component", "group")
    if rest is None:
        return groups
    groups = stage(groups)
    sums = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    buckets = stage(rest.groupBy("bucket").agg(*sums).where("n > 1"))
    own_group = F.xxhash64("n", "x", "y").alias("group")
    rest = stage(spread_join(rest, buckets.select("bucket", own_group), "bucket", hottest(buckets, "bucket")).select("node", "group").distinct())
    # left groups that lie in one component's are settled there
    among = rest.join(groups.withColumnRenamed("group", "in"), "node", "left").groupBy("group").agg(F.min("in").alias("low"), F.max("in").alias("high"), F.count_if(F.col("in").isNull()).alias("none"), F.count(F.lit(1)).alias("n"))
    open_ = stage(among.where("none > 0 OR low <> high").select("group", "n"))
    return groups.unionByName(spread_join(rest, open_.drop("n"), "group", hottest(open_, "group")).select("node", "group"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of df: doc_id, text_hash, n_shingles, component_id (the smallest doc_id reachable by links) and kept (doc_id = component_id).

    Two documents are linked if 100 * intersection >= percent * union of their k-word shingle sets. Equal sets are one node.
    Null, empty and blank texts have no shingles and link with nothing: each is its own component. Rows with equal ids count
    as documents that may differ; each gets a row. An empty table gives an empty table.
    """
    docs = dealt(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).withColumn("text_hash", F.xxhash64("text"))
    found = stage(features(docs.select("doc_id", "text", "text_hash"), k, bands, rows))
    # the row that stands for a set; one with an id if there is one
    sets = found.where("n_shingles > 0").groupBy("node")
    nodes = sets.agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    nodes = stage(nodes)
    own = stage(sets.agg(F.min_by(F.struct("text_hash", "n_shingles", "sig", "bands"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("r")).select("node", "r.*"))
    groups = stage(grouped(own))
    members = stage(groups.join(own.select("node", "text_hash", "n_shingles", "sig"), "node"))
    texts = docs.join(if_small(members.select("text_hash").distinct()), "text_hash", "left_semi").dropDuplicates(["text_hash"])
    verified = stage(links(shingle_sets(texts, k), members.select("node", "n_shingles", "sig", "group"), percent, bands * rows))
    reached = stage(connected_components(verified))
    ends = reached.join(nodes, "node")
    sizes = stage(ends.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    of_node = spread_join(reached, sizes.drop("n"), "component", hottest(sizes, "component")).select("node", "component_id")
    of_class = nodes.withColumnRenamed("doc_id", "class_id").join(of_node, "node", "left").select("node", F.coalesce("component_id", "class_id").alias("component_id"))
    rows_of = found.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
    out = spread_join(rows_of, stage(of_class), "node", hottest(nodes, "node"), "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with one row of each component of near_duplicates: that of the smallest id, of rows with equal ids any one of the first text by hash.

    Rows without shingles stay. Columns are those of df.
    """
    found = near_duplicates(df, id_col, text_col, **options).where("kept").groupBy("doc_id", "text_hash").agg(F.min("component_id").alias("component_id"), F.min("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows"))
    found = stage(found)
    same = Window.partitionBy("component_id", F.when((F.col("n") == 0) | F.col("component_id").isNull(), F.struct("doc_id", "text_hash"))).orderBy("text_hash")
    kept = found.withColumn("_ll_nth", F.row_number().over(same)).where("_ll_nth = 1").select(F.col("doc_id").alias("_ll_id"), F.col("text_hash").alias("_ll_hash"))
    own = df.withColumn("_ll_of", F.xxhash64(F.col(text_col).cast("string")))
    out = own.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("_ll_id")) & (F.col("_ll_of") == F.col("_ll_hash")), "left_semi")
    if found.where("rows > 1 AND n > 0").limit(1).count():  # rows that repeat id and text
        out = out.withColumn("_ll_n", F.row_number().over(Window.partitionBy(id_col, "_ll_of").orderBy(F.lit(0)))).where((F.col("_ll_n") == 1) | (F.length(F.trim(F.coalesce(text_col, F.lit("")))) == 0)).drop("_ll_n")
    return out.drop("_ll_of")
