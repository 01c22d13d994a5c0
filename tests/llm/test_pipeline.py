import random

import pytest

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with a toxic document, a frequent line, near copies, a benchmark passage, nulls, repeated rows and extra columns."""
    r = random.Random(9)
    vocab = ["".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(r.choice([1, 2, 3]))) for _ in range(1500)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    bad = ["vilehead", "muckwit", "grobshite"]
    docs, labels = [], []
    for i in range(800):
        t = say(60).split()
        if i % 5 == 0:
            for _ in range(6):
                t.insert(r.randrange(len(t)), r.choice(bad))
        docs.append((i, " ".join(t)))
        labels.append((i, 1, int(i % 5 == 0)))
    footer = "All rights of this text lie with its maker, who asks for nothing but a mention of its source"
    item = say(40)
    docs += [(1000 + i, f"{say(50)}\n{footer}") for i in range(8)]
    base = say(80).split()
    docs += [(2000 + i, " ".join([*base[:79], f"end{i}"])) for i in range(6)]
    docs += [(3000, f"{say(30)} {item} {say(30)}"), (3001, None), (3002, ""), (3003, say(9000)), (1003, dict(docs)[1003])]
    d = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "extra") for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), footer


def test_stages_one_by_one(spark, folder):
    sf, footer = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        out = cp.near.stage(stage(spark, docs, sf))
        kept[name] = out
        if name != "packing":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
            docs = out
    ids = {n: [x["doc_id"] for x in df.select("doc_id").collect()] for n, df in kept.items()}
    clean = [i for i in range(800) if i % 5]
    assert sum(i in set(ids["toxicity"]) for i in clean) >= 0.97 * len(clean)
    assert sum(i in set(ids["toxicity"]) for i in range(0, 800, 5)) <= 16
    assert sorted(ids["line_dedup"]) == sorted(ids["toxicity"])
    assert {1000 + i for i in range(8)} <= set(ids["toxicity"])
    with_footer = [x["doc_id"] for x in kept["line_dedup"].where(kept["line_dedup"].text.contains(footer)).collect()]
    assert with_footer == [1007]
    assert all(x["n_chars"] == len(x["text"]) for x in kept["line_dedup"].collect())
    near = set(ids["line_dedup"]) - set(ids["near_dedup"])
    assert near == {2001, 2002, 2003, 2004, 2005} & set(ids["line_dedup"]) and ids["near_dedup"].count(1003) == 1
    assert set(ids["near_dedup"]) - set(ids["benchmark_decontamination"]) == {3000} & set(ids["near_dedup"])
    assert {3001, 3002, 3003} <= set(ids["packing"]) and set(ids["packing"]) == set(ids["benchmark_decontamination"])
    assert cp.run(spark, sf).count() == kept["packing"].count()


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").where("doc_id < 0")
    for _, stage in cp.STAGES:
        out = stage(spark, docs, folder[0])
        assert out.count() == 0
