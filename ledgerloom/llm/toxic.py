"""Toxicity by compression distance: one zstandard dictionary trained on toxic text, one on ordinary text, compared window by window."""

from __future__ import annotations

import collections
import functools
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import dealt, giving_back

#: Labelled rows that the dictionaries and the calibration are fitted on, and code points of their texts, at most, by the hash of the id.
SAMPLE_ROWS, SAMPLE_TEXT = 12_000, 12_000_000
#: Longer texts are not drawn into that sample; scoring reads all texts, whole.
SAMPLE_CHARS = 50_000
#: Bytes that stand for a word, whatever its length: only whole words match, and each saves alike.
WORD_BYTES = 32
#: Words that the two dictionaries are trained to hold, about.
TOXIC_WORDS, ORDINARY_WORDS = 2000, 6000
#: A window that toxic text says more than so often, and ordinary text at less than this share of that rate, is no sample of ordinary text.
STRAY_COUNT, STRAY = 5, 0.05
#: Savings of a window, in bytes, from which it counts; it counts once for each. The first is what chance may save.
GRADES = (3, 5, 8, 11, 16, 21)
#: Savings that a worker remembers within a task.
KEPT_WINDOWS = 200_000
#: Score of documents without a word.
EMPTY_SCORE = 0.0

_EDGE = re.compile(r"^\W+|\W+$")


def _token(word: str) -> bytes:
    return hashlib.blake2b(_EDGE.sub("", word.lower()).encode(), digest_size=WORD_BYTES).digest()


def windows(text: str) -> list[bytes]:
    """All windows of a text: one word each, as bytes that the word determines."""
    return [_token(w) for w in text.split()]


@functools.lru_cache(maxsize=4)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    """A compressor that knows a dictionary's content; frames carry nothing but data, so lengths compare."""
    p = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
        window_log=20, hash_log=18, chain_log=18, search_log=4, min_match=6, target_length=0, strategy=zstandard.STRATEGY_GREEDY,
    )
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


def trained(words: int, samples: list[bytes]) -> bytes:
    """A dictionary of about so many words, trained on windows in mixed order; a smaller one where there is too little text for it, none for none."""
    samples = [samples[i] for i in np.random.default_rng(0).permutation(len(samples))]
    while words:
        try:
            return zstandard.train_dictionary(words * WORD_BYTES, samples, k=WORD_BYTES, d=8).as_bytes()
        except zstandard.ZstdError:
            words //= 2
    return b""


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The dictionary of toxic windows and that of ordinary ones.

    A stray insult in ordinary texts does not make it ordinary (STRAY). The trainer passes over some frequent windows. Ordinary windows that the toxic dictionary compresses better all the same
    are laid behind the trained ordinary one, so that what both kinds of text say tells nothing.
    """
    t, o = collections.Counter(toxic), collections.Counter(ordinary)
    ordinary = [w for w in ordinary if o[w] * len(toxic) >= STRAY * (t[w] - STRAY_COUNT) * len(ordinary)]
    a, b = trained(TOXIC_WORDS, toxic), trained(ORDINARY_WORDS, ordinary)
    saved = _saver(a, b)
    return a, b + b"".join(sorted(w for w in set(ordinary) if saved(w) >= GRADES[0]))


def _saver(toxic: bytes, ordinary: bytes):
    a, b = _compressor(toxic), _compressor(ordinary)
    return lambda w: len(b.compress(w)) - len(a.compress(w))


@functools.lru_cache(maxsize=2)
def _word_saver(toxic: bytes, ordinary: bytes):
    """The saving of a word's window; a task compresses the same word once, as long as it is remembered."""
    saved = _saver(toxic, ordinary)
    kept = functools.lru_cache(maxsize=KEPT_WINDOWS)(lambda w: saved(_token(w)))
    return lambda w: kept(w) if len(w) <= 40 else saved(_token(w))


def features(text: str, toxic: bytes, ordinary: bytes) -> list[float] | None:
    """What the windows save under the toxic dictionary against the ordinary one; None without words.

    Of the windows that save: mean saving, shares and logarithms of counts at each of GRADES, logarithm of all that is saved, and most.
    """
    saved = np.array([*map(_word_saver(toxic, ordinary), text.split())])
    if not len(saved):
        return None
    counts = [int((saved >= k).sum()) for k in GRADES]
    total = int(saved.clip(0).sum())
    return [total / len(saved), *(n / len(saved) for n in counts), *(math.log1p(n) for n in counts), math.log1p(total), min(max(int(saved.max()), 0), WORD_BYTES)]


def _fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Logistic regression by Newton steps with classes of equal weight, and the cut of the best F1 on the same rows."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    used = np.ones(z.shape[1], bool)
    while True:  # savings never speak against toxicity: a feature that would goes
        w, pull = np.zeros(z.shape[1]), 1e-3 * len(y) * np.r_[np.ones(x.shape[1]), 0.01]
        u = z[:, used]
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w[used] -= np.linalg.solve((u * (weight * p * (1 - p))[:, None]).T @ u + np.diag(pull[used]), u.T @ (weight * (p - y)) + (pull * w)[used])
        if (w[:-1] >= 0).all():
            break
        used[int(w[:-1].argmin())] = False
    s = np.sort(z @ w)
    s, y_by = s, y[np.argsort(z @ w, kind="stable")]
    hit = y_by[::-1].cumsum()[::-1]
    f1 = 2 * hit / (np.arange(len(y), 0, -1) + y.sum())
    best = int(f1.argmax())
    cut = (s[best] + s[max(best - 1, 0)]) / 2
    return {"mean": mean.tolist(), "scale": scale.tolist(), "w": w[:-1].tolist(), "b": float(w[-1] - cut)}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> dict:
    """A model from a bounded sample of labelled rows: dictionaries from three quarters of each kind, calibration from the rest.

    The sample is the labelled ids of least hash, SAMPLE_ROWS rows and SAMPLE_TEXT code points at most, so it does not depend
    on how the tables are dealt; it is drawn from the narrow table of labels, and only its texts leave the scan of docs. Null
    labels, texts that are null or have more than SAMPLE_CHARS code points, and ids without a text are left out of it; of
    repeated ids the highest label and the least text count. With fewer than two rows of either kind, or where those
    held back have no words, nothing can be told: the model is empty, and all texts score 0.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_ll_id")).agg(F.max(label_col).cast("int").alias("_ll_y"))
    drawn = known.orderBy(F.xxhash64(F.lit(3), "_ll_id"), "_ll_id").limit(sample_rows)
    rows = docs.where(F.char_length(text_col) <= SAMPLE_CHARS).join(F.broadcast(drawn), F.col(id_col) == F.col("_ll_id"))
    rows = rows.groupBy("_ll_id").agg(F.min(text_col).alias("t"), F.max("_ll_y").alias("y")).select(F.xxhash64(F.lit(3), "_ll_id").alias("h"), "t", "y")
    so_far = F.sum(F.char_length("t")).over(Window.orderBy("h", "t").rowsBetween(Window.unboundedPreceding, 0))  # of sample_rows rows
    sample = sorted((r["h"], r["t"], r["y"]) for r in rows.withColumn("n", so_far).where(F.col("n") <= SAMPLE_TEXT).select("h", "t", "y").toLocalIterator())
    sample.reverse()
    fit: dict[int, list[bytes]] = {0: [], 1: []}
    seen, rest, one = [0, 0], [], {}
    while sample:  # the driver holds each text until it is cut, and each window's bytes once
        _, text, y = sample.pop()
        seen[y] += 1
        if seen[y] % 4 == 2:
            rest.append((text, y))
        else:
            fit[y] += [one.setdefault(w, w) for w in windows(text)]
    del one
    if min(seen) < 2:
        return {}
    pair = dictionaries(fit.pop(1), fit.pop(0))
    found = [(f, y) for text, y in rest if (f := features(text, *pair))]
    _word_saver.cache_clear()  # on the driver these words and compressors are of no more use
    _compressor.cache_clear()
    if {y for _, y in found} != {0, 1} or not all(pair):
        return {}
    return _fit(np.array([f for f, _ in found]), np.array([y for _, y in found])) | {"dictionaries": pair}


def score_texts(df: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with a score from 0 to 1 of each whole text: 0.5 is the calibrated cut.

    Null and blank texts score EMPTY_SCORE, and all texts 0 under an empty model. Equal texts score alike, rows that repeat
    stay; a column of the score's name is replaced, all others stay. An empty table gives an empty table.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)  # of bounded size: two dictionaries and a few numbers

    def scored(batches):
        m = sent.value
        mean, scale, w = (np.array(m[k]) for k in ("mean", "scale", "w")) if m else (None, None, None)
        for texts in batches:
            out = []
            for t in texts:  # a text at a time leaves Arrow's batch
                f = features(x, *m["dictionaries"]) if m and (x := t.as_py()) else None
                out.append((EMPTY_SCORE if m else 0.0) if f is None else float(1 / (1 + np.exp(-np.clip((np.array(f) - mean) / scale @ w + m["b"], -30, 30)))))
            yield pa.array(out, pa.float64())

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            yield from giving_back(scored)(batches)
        finally:  # the worker lives on through later stages, which have no use for these
            _word_saver.cache_clear()
            _compressor.cache_clear()

    return dealt(df).withColumn(score_col, score(F.col(text_col).cast("string")))


def drop_toxic(df: DataFrame, model: dict, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """df without the rows that score cut or more under a model of train(); columns as before."""
    return score_texts(df, model, text_col, "_ll_score").where(F.col("_ll_score") < cut).drop("_ll_score")
