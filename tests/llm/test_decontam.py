import random

from ledgerloom.llm.decontam import contaminated, decontaminate


def test_planted_passages(spark):
    r = random.Random(5)
    vocab = [f"wört{i}" for i in range(3000)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [say(n) for n in (8, 15, 30, 60)] + [say(5)]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(10, None), (11, ""), (12, "; ".join(items[2]).upper())]
    docs, want = [], set()
    for n, w in enumerate(items[:4]):
        for kind in range(6):
            x = list(w)
            if kind == 1:  # every tenth word replaced
                for i in range(4, len(x), 10):
                    x[i] = "other"
            if kind == 2 and len(x) > 20:  # a word put in, a word left out
                x.insert(len(x) // 2, "extra")
                del x[3]
            if kind == 3:
                x = x[: len(x) // 2] if len(x) > 8 else x[:4]
            body = {4: x, 5: x + say(20_000)}.get(kind, say(50) + x + say(40))
            docs.append((len(docs), ("!\n" if kind == 0 else " ").join(body)))
            if kind != 3 and not (kind == 1 and len(x) == 8):
                want.add((docs[-1][0], n))
                if n == 2:
                    want.add((docs[-1][0], 12))
    docs += [(100, None), (101, ""), (102, " ".join(say(500))), (103, " ".join(items[4])), (104, "...")]
    df = spark.createDataFrame([(d, t, "x", 7) for d, t in docs], "doc_id long, text string, item string, key int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in contaminated(df, b).collect()}
    assert got == want
    kept = decontaminate(df, b)
    assert kept.columns == df.columns
    assert {x["doc_id"] for x in kept.select("doc_id").collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert contaminated(df.where("doc_id < 0"), b).count() == 0
    assert contaminated(df, b.where("item_id < 0")).count() == 0
    assert decontaminate(df, b.where("item_id < 0")).count() == len(docs)


def test_a_long_run_of_a_long_item(spark):
    item = [f"w{i}" for i in range(400)]
    docs = [item[100:134], item[:200], item[50:57] + ["x"] + item[58:64], item[50:56] + ["x"] * 3 + item[59:66], item[50:62], item[:12] + ["x"] * 40 + item[200:212]]
    df = spark.createDataFrame([(i, "before it " + " ".join(w) + " after it") for i, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {x["doc_id"]: x["matched_words"] for x in contaminated(df, b, run_words=13).collect()}
    assert got == {0: 34, 1: 200, 2: 13}
    assert {x["doc_id"] for x in decontaminate(df, b, run_words=13).collect()} == {3, 4, 5}


def test_short_items_common_words_and_null_ids(spark):
    item = [f"w{i}" for i in range(40)]
    text = " ".join(item)
    # ten places of a long text hold four words of the item each, after a seed of eight: no passage
    scattered = " ".join(f"{' '.join(item[:8])} {'x ' * (5 * k + 1)} {' '.join(item[4 * k : 4 * k + 4])}" for k in range(10))
    docs = [(1, f"so they say one two three Four and more"), (2, "one two three x four"), (3, "yes no"), (None, f"a {text} b"), (None, "clean row"), (4, scattered)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, "One two, three four!"), (2, "yes no"), (3, text), (4, "one two three four five six seven")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"], x["matched_words"]) for x in contaminated(df, b, short_items=True).collect()}
    assert got == {(1, 1, 4), (None, 3, 40)}
    assert [x["doc_id"] for x in decontaminate(df, b, short_items=True).orderBy("doc_id").collect()] == [2, 3, 4]


def test_recall_by_substitution_rate(spark):
    """At least these shares of items of 12, 20 and 40 words are found when so many of their words are replaced at random."""
    r = random.Random(11)
    items = [[f"q{r.randrange(10**5)}" for _ in range(n)] for n in (12, 20, 40) for _ in range(100)]
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    rates, docs = (0.05, 0.1, 0.2, 0.3), []
    for k, rate in enumerate(rates):
        for i, w in enumerate(items):
            docs.append((k * 1000 + i, " ".join(["before"] * 9 + [f"z{r.randrange(10**5)}" if r.random() < rate else x for x in w] + ["after"] * 9)))
    found = {x["doc_id"] for x in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()}
    recall = {(rate, n): sum(k * 1000 + i in found for i in range(100 * j, 100 * j + 100)) / 100 for k, rate in enumerate(rates) for j, n in enumerate((12, 20, 40))}
    print(recall)
    least = {0.05: (0.9, 0.95, 0.98), 0.1: (0.7, 0.9, 0.95), 0.2: (0.35, 0.6, 0.85), 0.3: (0.1, 0.2, 0.4)}
    assert all(recall[rate, n] >= least[rate][j] for rate in rates for j, n in enumerate((12, 20, 40)))
