import hashlib

from pyspark.sql import functions as F

from ledgerloom.llm import chat


def test_trees_best_branch_and_round_trip(spark):
    # tree 1: 1 -> 2 -> 4, 1 -> 3 -> (5, 6); tree 2: one root; tree 3: a parent that is missing; tree 4: a ring; tree 5: a long thread
    m = [(1, 1, None, 1.0), (1, 2, 1, 5.0), (1, 3, 1, 2.0), (1, 4, 2, 0.0), (1, 5, 3, 3.0), (1, 6, 3, 9.0), (2, 1, None, None), (3, 2, 99, 1.0), (3, 3, 2, 1.0), (4, 1, 2, 1.0), (4, 2, 1, 1.0)]
    m += [(5, i, i - 1 if i else None, 0.0) for i in range(137)]
    odd = ["a <| b", "\\<|im_end|>\n", "<\\|x", "", None, "<\\\\|<|", "|> <", "é😀\\"]
    rows = [(t, n, p, s, n, odd[(t + n) % 3] if n % 2 else "assistant", odd[(n * 3 + t) % 8]) for t, n, p, s in m]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double, place long, role string, text string")
    chosen = chat.best_branches(df, per_tree=1)
    got: dict = {}
    for r in chosen.collect():
        got.setdefault((r["tree"], r["leaf"]), set()).add(r["node"])
    assert got == {(1, 6): {1, 3, 6}, (2, 1): {1}, (3, 3): {2, 3}, (5, 136): set(range(137))}
    two: dict = {}
    for r in chat.best_branches(df.where("tree = 1"), per_tree=2).collect():
        two.setdefault(r["leaf"], []).append(r["node"])
    assert {k: sorted(v) for k, v in two.items()} == {6: [1, 3, 6], 4: [1, 2, 4]}
    formatted = chat.format_paths(df, chosen)
    back = {r["tree"]: [(t["role"], t["text"]) for t in r["turns"]] for r in formatted.select("tree", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    by = {(r[0], r[1]): (r[5] or "", r[6] or "") for r in rows}
    for (tree, _), nodes in got.items():
        assert back[tree] == [by[tree, n] for n in sorted(nodes)]


def test_threads_with_ties_nulls_and_repeats(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, None, "z"), (2, 1, "ro\nle <|", "x"), (3, 1, "assistant", ""), (None, 1, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages = chat.stage(chat.thread(df))
    out = chat.digests(chat.format_paths(messages, chat.best_branches(messages)).withColumnRenamed("tree", "conv_id"), "conv_id")
    got = {r["conv_id"]: r for r in out.collect()}
    turns = [("", "z"), ("user", ""), ("user", "a"), ("user", "a"), ("assistant", "b")]
    assert got[1]["n_turns"] == 5 and got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1]["loss_chars"] == 1 and got[1]["loss_sha256"] == hashlib.sha256(b"b").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"ro\nle <|\nx\n").hexdigest()
    assert set(got) == {1, 2, 3, None} and got[None]["turns_sha256"] == hashlib.sha256(b"user\nq\n").hexdigest()
    assert chat.best_branches(chat.thread(df.where("conv_id = 9"))).count() == 0


def test_repeated_nodes_count_once_and_other_columns_do_not_matter(spark):
    rows = [(1, 1, None, 1.0, 1, "user", "a", "t"), (1, 1, None, 1.0, 1, "user", "a", "t"), (1, 2, 1, 1.0, 2, "assistant", "b", "t"), (1, 2, 1, 1.0, 2, "assistant", "c", "t"), (1, None, 1, 1.0, 3, "user", "lost", "t")]
    rows += [(2, i, i - 1 if i else None, 0.0, i, "user", "x", "t") for i in range(40) for _ in range(2)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double, place long, role string, text string, leaf string")
    out = {r["tree"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.format_paths(df, chat.best_branches(df)).select("tree", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert out == {1: [("user", "a"), ("assistant", "b")], 2: [("user", "x")] * 40}
