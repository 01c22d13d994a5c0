"""Centroid clustering of integer vectors with Exponion search: exact assignments, bounds carried from round to round."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import dealt, stage

#: Distances are kept as doubles with this relative slack, outwards, so that rounding never hides a centroid or a tie.
SLACK = 1e-9
#: Largest component, of vector or centroid, for which squared distances of up to 256 dimensions fit in 64 bits; beyond, Python's integers count.
NARROW = 1 << 26
#: Sums travel as limbs of so many bits, whose own sums fit in 64 bits for 2 ** 31 tasks.
LIMB = 32
_LONG = (1 << 63) - 1


def _exact(x: np.ndarray) -> np.ndarray:
    """Whole doubles as integers: 64 bits where squares of differences fit, else Python's own."""
    if not x.size or (np.abs(x).max() < NARROW and x.shape[1] <= 256):
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    if a.dtype == object or b.dtype == object:
        d = a.astype(object) - b.astype(object)
        return (d * d).sum(axis=1)
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def _root(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(np.asarray(squared, float))


class Search:
    """Centroids with, for each of them, all others in order of their distance to it."""

    def __init__(self, centroids: list[list[int]]) -> None:
        wide = any(abs(v) >= NARROW for c in centroids for v in c) or (centroids and len(centroids[0]) > 256)
        self.at = np.array(centroids, object if wide else np.int64)
        k = len(self.at)
        apart = np.array([_root(_squared(self.at, np.repeat(self.at[i : i + 1], k, axis=0))) for i in range(k)]).reshape(k, k)
        apart[np.arange(k), np.arange(k)] = -1  # itself first
        self.near = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.far = np.take_along_axis(apart, self.near, axis=1)

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector (ties: the smaller number) with new bounds, and how many distances were needed.

        upper bounds the distance to the present centroid, lower those to all others. A vector stays if upper lies under lower
        or under half the way to the next centroid; then with the exact distance as upper; else the centroids in the ball of
        radius 2 * (upper + half the way) around its centroid are scanned: the nearest and the second nearest lie in it, those
        at the rim as well.
        """
        own, upper, lower, k = own.copy(), upper.copy(), lower.copy(), len(self.at)
        if k == 1:
            return own, upper, lower, 0
        half = self.far[:, 0] * (0.5 * (1 - SLACK))
        open_ = np.flatnonzero(upper >= np.maximum(lower, half[own]))
        exact = _squared(x[open_], self.at[own[open_]])
        upper[open_] = _root(exact) * (1 + SLACK)
        left = upper[open_] >= np.maximum(lower[open_], half[own[open_]])
        open_, exact, scanned = open_[left], exact[left], len(open_)
        was = own[open_]
        radius = (2 * upper[open_] + self.far[was, 0]) * (1 + SLACK)
        for a in np.unique(was):
            of = np.flatnonzero(was == a)
            n = np.searchsorted(self.far[a], radius[of], side="right")
            of, n = of[order := np.argsort(-n, kind="stable")], n[order]
            rows, best, at = open_[of], exact[of].copy(), np.full(len(of), a)
            second = np.full(len(of), np.inf)
            for j in range(int(n[0]) if len(n) else 0):  # the balls grow smaller, so those that hold the next one stand first
                m = np.searchsorted(-n, -j, side="left")
                c = self.near[a, j]
                d = _squared(x[rows[:m]], np.broadcast_to(self.at[c], (m, self.at.shape[1])))
                scanned += m
                closer = (d < best[:m]) | ((d == best[:m]) & (c < at[:m]))
                loser = np.where(closer, best[:m], d)
                second[:m] = np.minimum(second[:m], _root(loser))
                best[:m] = np.where(closer, d, best[:m])
                at[:m] = np.where(closer, c, at[:m])
            own[rows], upper[rows], lower[rows] = at, _root(best) * (1 + SLACK), second * (1 - SLACK)
        return own, upper, lower, scanned


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _round(df: DataFrame, centroids: list[list[int]], dims: int, moved: tuple[list[float], list[float]] | None) -> DataFrame:
    """df (row, x, and after the first round own, upper, lower) with the nearest of the centroids. moved: how far each went, and the farthest of its others."""
    arrow = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.float64())), ("own", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64())])

    def run(batches):
        search = Search(centroids)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _exact(_vectors(batch.column(1), dims))
            if moved is None:
                own, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
            else:
                own, upper, lower = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                own = own.astype(np.int64)
                upper, lower = upper + np.array(moved[0])[own], lower - np.array(moved[1])[own]
            own, upper, lower, _ = search.assign(x, own, upper, lower)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(upper), pa.array(lower)], schema=arrow)

    return df.mapInArrow(run, "vec_id long, x array<double>, own int, upper double, lower double")


def _means(df: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Of each cluster its rows and the exact sums of its components: summed within tasks, then by Spark as limbs."""

    def run(batches):
        rows, sums = {}, {}
        for batch in batches:
            x, own = _exact(_vectors(batch.column(0), dims)), batch.column(1).to_numpy()
            for c in np.unique(own):
                part = x[own == c]
                rows[c] = rows.get(c, 0) + len(part)
                sums[c] = [a + int(b) for a, b in zip(sums.get(c, [0] * dims), part.sum(axis=0), strict=True)]
        out: list[tuple[int, int, int, int]] = [(int(c), -1, 0, n) for c, n in rows.items()]
        for c, s in sums.items():
            for i, v in enumerate(s):
                limb = 0
                while v not in (0, -1) or not limb:  # the topmost limb has the sign
                    out.append((int(c), i, limb, v & ((1 << LIMB) - 1)))
                    v, limb = v >> LIMB, limb + 1
                if v:
                    out.append((int(c), i, limb, v))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["own", "dim", "limb", "v"])

    parts = df.select("x", "own").mapInArrow(run, "own long, dim long, limb long, v long")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("own", "dim", "limb").agg(F.sum("v").alias("v")).collect():  # clusters x dimensions x limbs
        n, sums = out.get(r["own"], (0, [0] * dims))
        if r["dim"] < 0:
            n = r["v"]
        else:
            sums[r["dim"]] += r["v"] << (LIMB * r["limb"])
        out[r["own"]] = (n, sums)
    return out


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: float = 64, k: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the vectors with `dims` components, none of them null or not finite.

    A component x becomes the integer floor(scale * x); one whose product passes the doubles counts as not finite. The k
    vectors with the least SHA-256 of `seed:id` are the first centroids. In each round every vector goes to its nearest centroid
    (squared distance; of equal ones the smaller number) and each centroid that has vectors becomes the floor of their
    mean, all in exact integers; at last the vectors are assigned once more. Distances are squared.

    Fewer vectors than k make as many clusters; none, an empty table. Rows that repeat an id count each; a null id stays
    null and hashes as empty; further columns do not matter. A distance, or a sum of distances, that does not fit in 64 bits
    is null, while clusters and centroids stay exact. k * dims integers and k * k distances are held by the driver and each
    task; nothing else depends on k. Each round is a written table, read by the next.
    """
    whole = F.forall("x", lambda v: v.isNotNull() & (F.abs(v * scale) <= 1.7976931348623157e308))
    x = F.col(vector_col).cast("array<double>")
    kept = dealt(df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))).where((F.size("x") == dims) & whole)
    # floor() of a double is a long; what does not fit in one is whole as it is
    floor = lambda v: F.when(F.abs(v * scale) < 2.0**53, F.floor(v * scale).cast("double")).otherwise(v * scale)
    kept = stage(kept.select("vec_id", F.transform("x", floor).alias("x")))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [[int(v) for v in r["x"]] for r in kept.orderBy(order, "x").limit(k).select("x").collect()]

    state, moved = kept, None
    for last in [False] * rounds + [True]:
        state = stage(_round(state, centroids, dims, moved) if centroids else _empty(kept))
        if last or not centroids:
            break
        found = _means(state, dims)
        fresh = [[s // found[i][0] for s in found[i][1]] if i in found else c for i, c in enumerate(centroids)]
        went = [float(np.sqrt(float(sum((a - b) ** 2 for a, b in zip(c, d, strict=True))))) * (1 + SLACK) for c, d in zip(centroids, fresh, strict=True)]
        others = [max((w for j, w in enumerate(went) if j != i), default=0.0) for i in range(len(went))]
        centroids, moved = fresh, (went, others)

    def measured(batches):
        at = Search(centroids).at if centroids else None
        for batch in batches:
            if batch.num_rows:
                own = batch.column(2).to_numpy()
                d = _squared(_exact(_vectors(batch.column(1), dims)), at[own])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([int(v) if v <= _LONG else None for v in d], pa.int64())], names=["vec_id", "cluster", "distance"])

    placed = stage(state.select("vec_id", "x", "own").mapInArrow(measured, "vec_id long, cluster int, distance long"))
    sums = {r["cluster"]: (None if r["nulls"] else int(r["d"])) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d"), F.count_if(F.col("distance").isNull()).alias("nulls")).collect()}
    fits = lambda v: v if v is not None and v <= _LONG else None
    whole_sum = fits(None if None in sums.values() else sum(sums.values()))
    rows = [(c, fits(sums[c]), whole_sum, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sorted(sums)]
    facts = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _empty(kept: DataFrame) -> DataFrame:
    return kept.where("false").select("vec_id", "x", F.lit(0).alias("own"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
