import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import near
from ledgerloom.llm.common import giving_back
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.shingles import shingle_set, word_hashes


def brute(rows, k, percent):
    def words(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            t = t.replace(c, " ")
        return [w for w in t.split(" ") if w]

    sets = []
    for _, t in rows:
        w = words(t)
        j = min(k, len(w))
        sets.append({tuple(w[i : i + j]) for i in range(len(w) - j + 1)} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for o in range(i):
            c = len(sets[i] & sets[o])
            if c and 100 * c >= percent * (len(sets[i]) + len(sets[o]) - c):
                old = root[i]
                root = [root[o] if r == old else r for r in root]
    least: dict = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min(d, least.get(r, d))
    return sorted((d, len(s), least[r], d == least[r]) for (d, _), s, r in zip(rows, sets, root, strict=True))


def corpus():
    r = random.Random(3)
    vocab = [f"w{i}é" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.choice([3, 30, 120]))] for _ in range(12)]
    rows, i = [], 0
    for b in base:
        for _ in range(r.choice([1, 2, 8, 25])):
            w = list(b)
            for _ in range(r.randrange(0, max(1, len(w) // 9))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((i, r.choice([" ", "\n", "\t "]).join(w).upper() if i % 5 == 0 else " ".join(w)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n "), (i + 3, "one"), (i + 4, "ONE"), (i + 5, "x " * 40_000), (i + 6, "y x " * 20_000 + "x"), (i + 7, rows[3][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "block"), [(2, 1000), (5, 7)])
def test_against_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, "n") for d, t in rows], "doc_id long, text string, node int, bucket string")
    got = sorted(tuple(x) for x in near.near_duplicates(df, k=k).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == brute(rows, k, 80)


def test_equal_ids_and_an_empty_table(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "q r s t u"), (0, "q r s t u")]
    got = sorted(tuple(x) for x in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).select("doc_id", "component_id", "kept").collect())
    assert got == [(0, 0, True), (1, 0, False), (1, 1, True), (1, 1, True)]
    df = spark.createDataFrame([*rows, (7, None), (7, ""), (8, "one two"), (None, "one two"), (None, "x y z")], "doc_id long, text string").withColumn("node", near.F.lit("n"))
    kept = near.keep_one(df, k=2)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())) == [(False, 0, "q r s t u"), (False, 1, "a b c d"), (False, 7, ""), (False, 7, ""), (False, 8, "one two"), (True, 0, "x y z")]
    assert near.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_word_hashes_tell_words_apart():
    text = "Alpha beta\tGAMMA\x0balpha  \n"
    h = word_hashes(text.encode())
    assert len(h) == 4 and h[0] == h[3] and len(set(h.tolist())) == 3
    assert len(shingle_set(b"", 2)) == 0 and len(shingle_set(b"a", 2)) == 1 and len(shingle_set(b"a b a b", 2)) == 2
    big = " ".join(f"{i:x}" for i in range(50_000))
    assert len(np.unique(word_hashes(big.encode()))) == 50_000


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (3, 2)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(1000, 1200), 1000)}
    assert connected_components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_unrelated_long_texts_agree_by_chance_alone():
    r = random.Random(1)
    sets = [shingle_set(" ".join(r.choice(["ab", "cd", "ef", "gh", "ij"]) + str(r.randrange(10_000)) for _ in range(2000)).encode(), 5) for _ in range(6)]
    sigs = [near.mix(near.minima(s, 252)) & np.uint64(255) for s in sets]
    for i in range(6):
        for o in range(i):
            assert (sigs[i] == sigs[o]).mean() < 0.05
    part = np.concatenate([sets[0][: int(len(sets[0]) * 0.9)], sets[1][:100]])
    alike = (near.mix(near.minima(part, 252)) & np.uint64(255) == sigs[0]).mean()
    assert abs(alike - len(np.intersect1d(part, sets[0])) / len(np.union1d(part, sets[0]))) < 0.1


def test_very_long_words_are_told_apart():
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    assert word_hashes(a.encode())[0] != word_hashes(b.encode())[0]


def test_links_of_long_texts_against_brute_force(spark):
    """Documents of 300 to 3,000 words whose similarities lie on both sides of the threshold; every component must be right."""
    r = random.Random(9)
    rows, i = [], 0
    for f in range(25):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([300, 800, 3000]))]
        for copy in range(8):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0.0, 0.005, 0.01, 0.02, 0.025, 0.05]))):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append((i, " ".join(w)))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(x) for x in near.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == brute(rows, 5, 80)


def test_copies_without_ids_do_not_part_a_group(spark):
    words = [f"v{i}" for i in range(200)]
    other = [*words]
    other[100] = "else"
    df = spark.createDataFrame([(None, " ".join(words)), (7, " ".join(words)), (None, " ".join(other)), (3, " ".join(other).upper()), (None, "alone here")], "doc_id long, text string")
    got = {tuple(x) for x in near.near_duplicates(df).select("doc_id", "component_id", "kept").collect()}
    assert got == {(None, 3, False), (7, 3, False), (3, 3, True), (None, None, True)}
    assert sorted(str(x["doc_id"]) for x in near.keep_one(df).collect()) == ["3", "None"]


def test_hubs_and_hot_keys_give_the_same(spark, monkeypatch):
    from ledgerloom.llm import common, components

    r = random.Random(2)
    edges = [(0, i) for i in range(1, 60)] + [(r.randrange(100, 140), r.randrange(100, 140)) for _ in range(30)] + [(59, 100)]
    df = spark.createDataFrame(edges, "x long, y long")
    plain = sorted(map(tuple, connected_components(df).collect()))
    monkeypatch.setattr(components, "HUB_EDGES", 5)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    assert sorted(map(tuple, connected_components(df).collect())) == plain
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(x) for x in near.near_duplicates(docs, k=2).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == brute(rows, 2, 80)


def test_common_counts_against_pairwise_intersections():
    r = np.random.default_rng(4)
    for _ in range(40):
        n, of = int(r.integers(2, 30)), int(r.integers(5, 200))
        sets = [np.sort(r.choice(of, r.integers(0, of), replace=False)).astype(np.uint64) for _ in range(n)]
        for first in (None, int(r.integers(1, n))):
            counts = near.common_counts(sets, first)
            for i in range(n if first is None else first):
                for j in range(i + 1 if first is None else first, n):
                    assert counts[i, j - (first or 0)] == len(np.intersect1d(sets[i], sets[j]))


def test_rows_are_joined_by_a_forest_of_all_links():
    r = np.random.default_rng(6)
    for _ in range(40):
        n = int(r.integers(2, 25))
        for first in (None, int(r.integers(1, n))):
            a, b = (n, n) if first is None else (first, n - first)
            linked = r.random((a, b)) < 0.08
            if first is None:
                linked = np.triu(linked, 1)
            found = near.forest(linked, first or 0, n)
            assert all(linked[i, j - (first or 0)] for i, j in found)
            root = list(range(n))
            for i, j in found:
                assert root[i] != root[j]  # no cycle
                root = [root[i] if x == root[j] else x for x in root]
            assert all(root[i] == root[j + (first or 0)] for i, j in zip(*np.nonzero(linked), strict=True))


def test_members_far_from_every_head_are_settled_as_a_group(spark, monkeypatch):
    """Nodes 20 and 30 are alike, but far from the head 10 of each of their buckets; 40 is like the head."""
    monkeypatch.setattr(near, "HEADS", 1)
    sig = {10: 0, 20: 1, 30: 1, 40: 0}
    own = spark.createDataFrame([(n, bytes([b] * 16), [5, 6]) for n, b in sig.items()], "node long, sig binary, bands array<long>")
    groups: dict = {}
    for r in near.grouped(own).collect():
        groups.setdefault(r["group"], []).append(r["node"])
    assert sorted(map(sorted, groups.values())) == [[10, 40], [20, 30]]


def test_a_task_gives_back_what_arrow_held():
    """At the end of a task its worker keeps none of the memory that Arrow's pool had for it."""

    def held():
        return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024

    def run(batches):
        for n in batches:
            parts = [pa.allocate_buffer(1 << 20) for _ in range(n)]
            for b in parts:
                np.frombuffer(b, np.uint8)[:] = 1
            yield held()

    before = held()
    during = list(giving_back(run)(iter([96])))
    assert during[0] >= before + 80 and held() < before + 30
