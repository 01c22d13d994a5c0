import math

import numpy as np
import pytest

from ledgerloom.llm import embed


def brute(rows, cosine=0.98):
    root, links = list(range(len(rows))), [0] * len(rows)

    def good(v, label):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows[:i]):
            if la == lb and good(a, la) and good(b, lb) and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    old = root[i]
                    root = [root[j] if r == old else r for r in root]
    least: dict = {}
    for (d, _, _), r in zip(rows, root, strict=True):
        least[r] = min(d, least.get(r, d))
    return sorted((d, n, least[r], d == least[r]) for (d, _, _), n, r in zip(rows, links, root, strict=True))


@pytest.mark.parametrize(("cell", "block"), [(2000, 2000), (20, 2000), (40, 7)])
def test_against_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embed, "CELL", cell)
    monkeypatch.setattr(embed, "BLOCK", block)
    r = np.random.default_rng(4)
    centres = r.normal(size=(25, 8))
    rows = []
    for i in range(300):
        v = centres[i % 25] * r.uniform(0.5, 2) + r.normal(size=8) * r.choice([0.02, 0.1, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 25 % 3)))
    same = rows[5][1]
    rows += [(1000 + i, same, rows[5][2]) for i in range(40)] + [(1100, same, 77), (1101, same, None), (1102, None, 1), (1103, [0.0] * 8, 1), (1104, [None, *same[1:]], 1), (1105, [math.nan, *same[1:]], 1), (1106, [math.inf, *same[1:]], 1), (1107, same[:7], 1), (1108, [], 1), (5, same, rows[5][2]), (1109, [1e-30] * 8, 2), (1110, [1e30] * 8, 2)]
    df = spark.createDataFrame([(*x, "c") for x in rows], "vec_id long, embedding array<float>, label int, node string")
    got = sorted(tuple(x) for x in embed.near_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == brute(rows)


def test_empty_table(spark):
    assert embed.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pivots_part_labels_of_any_size_under_the_shipped_sizes(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(30, 16))
    rows = [(i, [float(x) for x in centres[i % 30] + r.normal(size=16) * 0.03], i % 2) for i in range(700)]
    nodes = spark.createDataFrame([(int(lab), 16, i, (np.array(v) / np.linalg.norm(v)).tobytes(), 1) for i, v, lab in rows], "label long, dims int, node long, vec binary, weight long")
    found = embed.pivots(nodes)
    assert set(found) == {(0, 16), (1, 16)} and all(2 <= len(v) <= 24 for v in found.values())
    placed = embed.cells(nodes, found, math.sqrt(0.04)).collect()
    assert sum(x["home"] for x in placed) == 700 and len(placed) < 3 * 700
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(x) for x in embed.near_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect()) == brute(rows)
