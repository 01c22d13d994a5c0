"""Exact metric range join of embeddings: pivots cut the vectors into cells, the triangle inequality says which vectors a cell needs besides its own, cells join independently."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import hottest, if_small, spread_join, stage
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.near import _by_key

#: Vectors that a cell should have at most, and bytes of all pivots together.
CELL, PIVOT_BYTES = 2000, 32 << 20
#: Vectors of a cell that one task holds against as many others.
BLOCK = 2000


def pivots(nodes: DataFrame) -> dict:
    """Unit vectors by (label, dimensions): of every label the vectors with the least hashes, about.

    A label of n vectors gets the fourth root of n, and no fewer than n / CELL; if all pivots would have more than PIVOT_BYTES,
    every label gets fewer in proportion, and one that would get fewer than two is one cell. Cells are then larger, and
    results the same.
    """
    sizes = nodes.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n"))
    sizes = stage(sizes.withColumn("want", F.greatest(F.ceil(F.pow("n", F.lit(0.25))), F.ceil(F.col("n") / CELL)).cast("double")).where("n > 1"))
    held = sizes.agg(F.sum(F.col("want") * F.col("dims") * 8)).first()[0] or 0
    share = (F.col("want") * min(1.0, PIVOT_BYTES / max(held, 1.0))).alias("get")
    sizes = sizes.select("label", "dims", "n", share).where("get >= 2")
    picked = nodes.join(if_small(sizes), ["label", "dims"]).where(F.pmod(F.xxhash64(F.lit(9), "node"), F.lit(1 << 30)) < F.col("get") / F.col("n") * (1 << 30))
    out: dict = {}
    for r in picked.select("label", "dims", "vec").collect():  # PIVOT_BYTES, about
        out.setdefault((r["label"], r["dims"]), []).append(np.frombuffer(r["vec"], "<f8"))
    return {k: np.array(v) for k, v in out.items()}


def cells(nodes: DataFrame, centres: dict, radius: float) -> DataFrame:
    """label, dims, cell, node, weight, vec, home: each vector in the cell of its nearest pivot, and a copy in each cell that may hold a partner.

    If u lies in cell p and v within the radius r of u, then d(v, p) <= d(u, p) + r <= d(u, q) + r <= d(v, q) + 2 r for v's own
    pivot q. As distances are Euclidean, d(v, p) ** 2 - d(v, q) ** 2 <= 2 r d(p, q) holds as well, which spares about half of the copies.
    """
    schema = "label long, dims int, cell int, node long, weight long, vec binary, home boolean"
    arrow = pa.schema([("label", pa.int64()), ("dims", pa.int32()), ("cell", pa.int32()), ("node", pa.int64()), ("weight", pa.int64()), ("vec", pa.binary()), ("home", pa.bool_())])
    sent = nodes.sparkSession.sparkContext.broadcast(centres)  # PIVOT_BYTES, about

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in arrow]
            for label, dims, node, weight, vec in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = sent.value.get((label, dims))
                if mine is None:
                    places, home = [0], 0
                else:
                    d = np.linalg.norm(mine - np.frombuffer(vec, "<f8"), axis=1)
                    home = int(d.argmin())
                    near = np.flatnonzero(d <= d[home] + 2 * radius + 1e-9)
                    apart = np.linalg.norm(mine[near] - mine[home], axis=1)
                    places = near[d[near] ** 2 - d[home] ** 2 <= 2 * radius * apart + 1e-9].tolist()
                for p in places:
                    for c, x in zip(out, (label, dims, p, node, weight, vec, p == home), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, arrow, strict=True)], schema=arrow)

    return nodes.select("label", "dims", "node", "weight", "vec").mapInArrow(run, schema)


def cell_links(placed: DataFrame, cosine: float) -> DataFrame:
    """node, links (weights of the other nodes it links with, so far) and at (a node that it reaches) from each pair of blocks of each cell.

    A node's links are counted in its home cell alone, where all its partners are. Instead of pairs, each block gives each
    node's least reachable node, which connects the same.
    """
    key = ["label", "dims", "cell"]
    sizes = placed.groupBy(*key).agg(F.ceil(F.sum(F.col("home").cast("long")) / BLOCK).cast("int").alias("own"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("all"))
    rows = placed.join(if_small(stage(sizes)), key).where("own > 0").withColumn("h", F.xxhash64(F.lit(4), "node"))
    mine = rows.where("home").select(*key, F.pmod("h", "own").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"), F.lit(0).alias("side"), "node", "weight", "vec")
    other = rows.select(*key, F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"), F.pmod("h", "all").cast("int").alias("j"), F.lit(1).alias("side"), "node", "weight", "vec")
    by = [*key, "i", "j"]
    arrow = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("at", pa.int64())])

    def run(batches):
        for group in _by_key(batches, 5):
            side = np.array([r[5] for r in group])
            node, weight = np.array([r[6] for r in group]), np.array([r[7] for r in group])
            u, m = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(u) or not len(m):
                continue
            x = np.frombuffer(b"".join(r[8] for r in group), "<f8").reshape(len(group), -1)
            near = x[u] @ x[m].T >= cosine
            near &= node[u][:, None] != node[m][None, :]
            links = near @ weight[m]
            row, col = np.nonzero(near)
            least = np.arange(len(group))
            order = node.argsort(kind="stable")
            least[order] = np.arange(len(group))  # rank by node, lowered along links until all agree
            same = {n: i for i, n in enumerate(node.tolist())}
            twin = np.array([same[n] for n in node.tolist()])
            while True:
                new = least.copy()
                np.minimum.at(new, u[row], least[m[col]])
                np.minimum.at(new, m[col], new[u[row]])
                np.minimum.at(new, twin, new)
                new = new[twin]
                if (new == least).all():
                    break
                least = new
            to = node[order][least]
            say = m[to[m] != node[m]]
            first = np.concatenate([u, say])
            count = np.concatenate([links, np.zeros(len(say), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(node[first], pa.int64()), pa.array(count.astype(np.int64), pa.int64()), pa.array(to[first], pa.int64())], schema=arrow)

    return mine.unionByName(other).repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "node long, links long, at long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """One row per row of df: vec_id, n_links (other rows linked with it), component_id (smallest vec_id reachable), kept.

    Rows link if their labels are equal and their cosine in double precision is cosine or more. Rows whose label or vector
    is null, or whose vector is zero or holds a null or a number that is not finite, link with nothing, nor do vectors of
    different lengths. Equal vectors of one label are one node with their number as weight, so copies cost no pairs. Rows
    with equal ids are vectors of their own. An empty table gives an empty table.
    """
    v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.xxhash64(label_col).alias("label"), F.col(label_col).isNotNull().alias("_ll_has"), F.col(vec_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda e: F.coalesce((F.abs(e) < F.lit(math.inf)) & ~F.isnan(e), F.lit(False)))
    good = F.coalesce(F.col("_ll_has") & F.col("x").isNotNull() & finite & F.exists("x", lambda e: e != 0), F.lit(False))
    v = v.withColumn("node", F.when(good, F.xxhash64(F.lit(6), "label", "x")))
    classes = v.where("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("x").alias("x"))

    def unit(batches):
        for batch in batches:
            node, weight, label, x = (c.to_pylist() for c in batch.columns)
            vecs = [np.asarray(e, "<f8") for e in x]
            scaled = [e / np.abs(e).max() for e in vecs]  # squares of very large or small numbers would leave the range
            yield pa.RecordBatch.from_pydict(
                {"node": node, "weight": weight, "label": label, "dims": pa.array([len(e) for e in vecs], pa.int32()), "vec": [(e / np.linalg.norm(e)).tobytes() for e in scaled]}
            )

    by_node = stage(classes)
    nodes = stage(by_node.select("node", "weight", "label", "x").mapInArrow(unit, "node long, weight long, label long, dims int, vec binary"))
    found = stage(cell_links(cells(nodes, pivots(nodes), math.sqrt(2 - 2 * cosine)), cosine))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = stage(connected_components(found.where("node <> at").select("node", "at")))
    sizes = stage(reached.join(by_node, "node").groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    of_component = spread_join(reached, sizes.drop("n"), "component", hottest(sizes, "component")).select("node", "component_id")
    of_node = by_node.select("node", "first_id", "weight").join(links, "node", "left").join(of_component, "node", "left")
    of_node = stage(of_node.select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id")))
    out = spread_join(v.select("vec_id", "node"), of_node, "node", hottest(by_node, "node", "weight"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
