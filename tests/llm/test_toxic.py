import gc
import random
import tracemalloc

import pyarrow as pa
import pytest

from ledgerloom.llm import toxic


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    parts = ["the", "and", "ing", "tion", "er", "st", "ou", "ble", "wh", "re", "ha", "ea"]
    vocab = ["".join(r.choice(parts) for _ in range(r.choice([1, 2, 3]))) for _ in range(900)]
    bad = ["grobshite", "muckwit", "scumble", "vilehead"]
    out = []
    for i in range(1600):
        w = [r.choice(vocab) for _ in range(r.choice([20, 80, 200]))]
        y = int(i % 4 == 0)
        if y:
            for _ in range(max(2, len(w) // 25)):
                w.insert(r.randrange(len(w)), r.choice(bad))
        out.append((i, " ".join(w), y, "n"))
    return out


def test_held_out_accuracy_and_odd_texts(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")
    labels = df.select("doc_id", "toxic").where("doc_id % 5 <> 0")
    model = toxic.train(df.drop("toxic"), labels)
    again = toxic.train(df.repartition(3), labels.unionByName(labels).repartition(2))
    assert model == again  # the sample does not depend on how rows are dealt
    got = toxic.score_texts(df.where("doc_id % 5 = 0"), model).select("score", "toxic").collect()
    hit = sum((x["score"] >= 0.5) == (x["toxic"] == 1) for x in got)
    assert hit / len(got) > 0.93
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "word"), (5, "x" * 200_000), (6, "muckwit scumble " * 20_000)], "doc_id long, text string")
    s = {x["doc_id"]: x["score"] for x in toxic.score_texts(odd, model).collect()}
    assert s[1] == s[2] == s[3] == 0.0 and s[6] > 0.5 and all(0 <= v <= 1 for v in s.values())
    kept = toxic.drop_toxic(df.select("doc_id", "text", "score"), model)
    assert kept.columns == ["doc_id", "text", "score"]
    ids = {x["doc_id"] for x in kept.collect()}
    assert sum(r[0] in ids for r in rows if r[2] == 0) > 0.95 * 1200 and sum(r[0] in ids for r in rows if r[2] == 1) < 0.1 * 400


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([(1, "a b", 0), (2, None, 1), (3, "c", None)], "doc_id long, text string, toxic int")
    assert toxic.train(none, none) == {} and toxic.train(none, none.where("doc_id < 0")) == {}
    assert {x["score"] for x in toxic.score_texts(none, {}).collect()} == {0.0}


def test_short_and_rare_telling_words_are_found(spark, rows):
    """A few short words in long texts: some toxic documents hold but two of them, and some ordinary ones one."""
    r = random.Random(4)
    plain = [w for _, t, y, _ in rows if not y for w in t.split()]
    bad = ["scum", "vile", "oaf", "idiot", "grub", "loser", "crud", "moron", "swine", "twit"]
    docs = []
    for i in range(2400):
        w = [r.choice(plain) for _ in range(r.choice([60, 150, 300]))]
        for _ in range(r.choice([2, 3, 6]) if i % 6 == 0 else i % 49 == 0):
            w.insert(r.randrange(len(w)), r.choice(bad))
        docs.append((i, " ".join(w), int(i % 6 == 0)))
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxic.train(df.drop("toxic"), df.where("doc_id % 5 <> 0").select("doc_id", "toxic"))
    got = toxic.score_texts(df.where("doc_id % 5 = 0"), model).select("score", "toxic").collect()
    hit = sum(x["score"] >= 0.5 for x in got if x["toxic"])
    assert hit > 0.85 * sum(x["toxic"] for x in got) and hit > 0.85 * sum(x["score"] >= 0.5 for x in got)


def test_dictionaries_come_from_whole_texts_of_their_kind(rows):
    by = {y: [x for _, t, k, _ in rows if k == y for x in toxic.windows(t)] for y in (0, 1)}
    a, b = toxic.dictionaries(by[1], by[0])
    held = lambda content, samples: {w for w in set(samples) if w in content}
    assert len(held(a, by[1])) > 100  # no list of chosen words: what toxic texts say often, ordinary words too
    assert held(a, [toxic._token(w) for w in ("grobshite", "muckwit", "scumble", "vilehead")]) and len(held(a, by[0])) > 100
    saved = toxic._saver(a, b)
    assert max(saved(w) for w in set(by[0])) < toxic.GRADES[0] and saved(toxic._token("muckwit")) > 16


def test_the_driver_holds_the_bytes_of_a_window_once(spark):
    """Repeated words of the sample must not cost the driver a digest each."""
    r = random.Random(6)
    rows = [(i, " ".join(f"w{r.randrange(300)}" for _ in range(1000)) + " bad" * (i % 2), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    gc.collect()
    tracemalloc.start()
    toxic.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    left, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 14_000_000, peak
    assert not toxic._word_saver.cache_info().currsize, left


def test_workers_keep_no_words_after_scoring(spark, rows):
    """Workers live on through later stages; what they remember would count against the executor there."""
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")
    model = toxic.train(df, df.select("doc_id", "toxic"))
    assert model and toxic.score_texts(df.repartition(8), model).where("score IS NULL").count() == 0

    def held(batches):
        for batch in batches:
            n = toxic._word_saver.cache_info().currsize + toxic._compressor.cache_info().currsize
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64())], ["n"])

    assert spark.range(0, 64, 1, 8).mapInArrow(held, "n long").where("n > 0").count() == 0
