import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import phrases


def brute(rows, longest=3, min_count=10, held=50, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    out: dict = {}
    for (lang, p), a in found.items():
        if any(q != p and lang == la and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= held * a for (la, q), b in found.items() if len(q) > len(p)):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), a, left, right, n[lang], score))
    return sorted((lang, r, x[2].decode(), *x[3:]) for lang, all_ in out.items() for r, x in enumerate(sorted(all_)[:top], 1))


def sentences(r, n):
    vocab = [*"abcdefgh", "É", "it's", "x\x00y", "New", "YORK", "ß"]
    def one():
        w = [r.choice(vocab) for _ in range(r.randint(0, 30))]
        if r.random() < 0.5:
            w.insert(r.randint(0, len(w)), r.choice(["new york city", "a  b\tc", "of the", "x, y. z"]))
        return "".join(x + r.choice([" ", " ", " ", "\t", ". ", "\n", " ;"]) for x in w)
    return [one() for _ in range(n)]


@pytest.mark.parametrize(("shard", "branch", "longest"), [(1 << 20, 1 << 16, 3), (50, 7, 3), (300, 64, 5)])
def test_against_brute_force(spark, monkeypatch, shard, branch, longest):
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
    monkeypatch.setattr(phrases, "BRANCH", branch)
    r = random.Random(3)
    rows = [(r.choice(["en", "fr", None, ""]), t) for t in sentences(r, 900)] + [("en", None), ("en", ""), (None, ".;!"), ("de", "ja ja ja ja ja ja ja ja ja ja ja ja"), ("fr", "long " * 3000)] + [("es", "el perro")] * 12
    df = spark.createDataFrame([(i, *x, 7, "c") for i, x in enumerate(rows)], "doc_id long, lang string, text string, phrase int, n string")
    got = sorted(tuple(x) for x in phrases.collocations(df, longest=longest).collect())
    assert got == brute(rows, longest) and len(got) > 50


def test_a_small_top_and_ties(spark):
    rows = [("en", f"w{i % 9} v{i % 9}.") for i in range(180)]
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), top=4).orderBy("rank").collect()
    assert [tuple(x)[1:4] for x in got] == [(i + 1, f"w{i} v{i}", 20) for i in range(4)]


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_bitmaps_carry_over_bytes():
    ids = np.array([1, 2] * 20 + [0] + [2, 1], np.int32)
    maps = phrases.Bitmaps(ids, 3)
    one = maps.word == 1
    row, word, block, bits = maps.extend(maps.block[one], maps.bits[one])
    assert np.bitwise_count(bits[word == 2]).sum() == 20 and np.bitwise_count(bits[word == 1]).sum() == 0
