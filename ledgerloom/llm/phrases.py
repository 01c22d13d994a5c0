"""Phrase collocations: compressed position bitmaps of words, extended depth-first by shift, AND and popcount; counts are summed over shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import dealt, hottest, if_small, spread_join, stage
from ledgerloom.llm.shingles import mix

#: A shard takes documents until it holds so many words; a document is never cut.
SHARD_WORDS = 1 << 20
#: Bitmap bytes that are extended at once; a word of more bytes is extended part by part.
BRANCH = 1 << 16
#: Bits of the hashes by which pairs of words are counted first, and of the table that tells which of them may be frequent.
SLOT_BITS, FILTER_BITS = 40, 25
#: Rows and bytes of counts that are broadcast at most.
SMALL_ROWS, SMALL_BYTES = 100_000, 8 << 20
#: Parts into which a language's phrases are dealt before the last ranking.
RANK_PARTS = 64

#: A-Z are lowered, a tab is a blank, what ends a piece becomes a full stop, which stands in no word.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz .........")
_COUNTS = pa.schema([("key", pa.string()), ("n", pa.int64())])


class _Numbers(dict):
    """A number for each word in order of arrival."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Bitmaps:
    """Positions of the words of a shard. Word 0 ends a piece. A word's bitmap is stored by bytes of eight positions, of which
    only those that are not empty are kept: `word`, `block` and `bits` in order of the blocks, `first` tells where each begins."""

    def __init__(self, ids: np.ndarray, words: int) -> None:
        at = np.flatnonzero(ids)
        key = (at >> 3) * words + ids[at]
        order = np.argsort(key, kind="stable")
        key, bit = key[order], np.left_shift(1, at[order] & 7).astype(np.uint8)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        self.bits = np.add.reduceat(bit, start) if len(start) else bit
        self.word, self.block = (key[start] % words).astype(np.int32), key[start] // words
        self.first = np.searchsorted(self.block, np.arange(len(ids) // 8 + 3))

    def extend(self, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bitmaps of phrase ends, shifted by one position and held against those of all words: for each byte that is left, its
        row of the input, the word that follows, the block and the bits."""
        row = np.arange(len(block))
        over = np.flatnonzero(bits >> 7)  # the last position of a byte goes on in the next
        row, block, bits = np.concatenate([row, over]), np.concatenate([block, block[over] + 1]), np.concatenate([(bits << 1).astype(np.uint8), np.ones(len(over), np.uint8)])
        n = self.first[block + 1] - self.first[block]
        of = np.repeat(np.arange(len(row)), n)
        entry = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + self.first[block][of]
        both = self.bits[entry] & bits[of]
        left = np.flatnonzero(both)
        of, entry = of[left], entry[left]
        return row[of], self.word[entry], block[of], both[left]


def _summed(prefix: np.ndarray, word: np.ndarray, words: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of prefix number and word, their popcounts, and the pair that each byte belongs to."""
    key, of = np.unique(prefix.astype(np.int64) * words + word, return_inverse=True)
    return key // words, key % words, np.bincount(of, np.bitwise_count(bits), len(key)).astype(np.int64), of


def _pair_slots(hashes: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of SLOT_BITS bits of each pair of word numbers."""
    return (mix(hashes[first] * np.uint64(0x9E3779B97F4A7C15) + hashes[second]) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Shard:
    """The words of some documents of one language: numbers in order of their places (0 where a piece ends), names, hashes, bitmaps."""

    def __init__(self, lang: str, numbers: dict, ids: list[np.ndarray]) -> None:
        self.words, self.ids = list(numbers), np.concatenate(ids)
        seed = xxhash.xxh32_intdigest(lang)
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        self.maps = Bitmaps(self.ids, len(self.words))

    def branches(self):
        """First words with their bitmaps, some at a time."""
        order = np.argsort(self.maps.word, kind="stable")
        for i in range(0, len(order), BRANCH):
            part = order[i : i + BRANCH]
            first, of = np.unique(self.maps.word[part], return_inverse=True)
            yield first[:, None].astype(np.int64), of, self.maps.block[part], self.maps.bits[part]

    def grow(self, prefixes: np.ndarray, of: np.ndarray, block: np.ndarray, bits: np.ndarray, longest: int, frequent: np.ndarray | None):
        """(phrases as rows of word numbers, counts) of all extensions of the prefixes to `longest` words, depth first.

        of: the prefix of each byte of the bitmaps. frequent: bits of the pairs that may be frequent; a phrase with another is left.
        """
        row, word, block, bits = self.maps.extend(block, bits)
        of = of[row]
        if frequent is not None:
            slot = _pair_slots(self.hashes, prefixes[of, -1], word) >> (SLOT_BITS - FILTER_BITS)
            left = np.flatnonzero(frequent[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            of, word, block, bits = of[left], word[left], block[left], bits[left]
        if not len(of):
            return
        before, last, n, of = _summed(of, word, len(self.words), bits)
        longer = np.column_stack([prefixes[before], last])
        yield longer, n
        if longer.shape[1] < longest:
            yield from self.grow(longer, of, block, bits, longest, frequent)


def _shards(batches):
    """Shards of the documents (lang, text as bytes) of a task, one for each language they hold."""
    held, n = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = (text.as_py() or b"").translate(_PLAIN).replace(b".", b" . ").split()
            if not text:
                continue
            if lang not in held:
                held[lang] = _Numbers({b".": 0}), []
            numbers, ids = held[lang]
            ids += [np.fromiter((numbers[w] for w in text), np.int32, len(text)), np.zeros(1, np.int32)]
            n += len(text)
            if n >= SHARD_WORDS:
                yield from ((k, Shard(k, *v)) for k, v in held.items())
                held, n = {}, 0
    yield from ((k, Shard(k, *v)) for k, v in held.items())


def _frequent_pairs(docs: DataFrame, min_count: int):
    """Bits of hashes, as broadcast bytes: those of all pairs that occur min_count times or more are set."""
    arrow = pa.schema([("slot", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for _, shard in _shards(batches):
            for branch in shard.branches():
                for phrases, n in shard.grow(*branch, 2, None):
                    yield pa.RecordBatch.from_arrays([pa.array(_pair_slots(shard.hashes, *phrases.T)), pa.array(n)], schema=arrow)

    slots = docs.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    bit = F.shiftright("slot", SLOT_BITS - FILTER_BITS)
    found = slots.groupBy(F.shiftright(bit, 5).alias("place")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(31)).cast("int"))).alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 5), "<u4")
    out[found["place"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return docs.sparkSession.sparkContext.broadcast(out.tobytes())


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 3, min_count: int = 10) -> DataFrame:
    """lang, size, phrase, n: all phrases of one to `longest` words that occur min_count times or more in a language, and for size 0
    (phrase empty) the number of all its words.

    Texts are read twice. First the pairs of words are counted by hashes of SLOT_BITS bits: a hash that is seldom has seldom
    pairs only. Then words are counted, and phrases all of whose pairs may be frequent. Which these are travels as a table of
    2 ** FILTER_BITS bits, whatever the corpus; one that is set by chance costs work, never a count.
    """
    docs = dealt(docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text")))
    marked = _frequent_pairs(docs, min_count)

    def run(batches):
        frequent = np.frombuffer(marked.value, np.uint8)
        for lang, shard in _shards(batches):
            names = pa.array(shard.words, pa.binary()).cast(pa.string())

            def rows(phrases: np.ndarray, n: np.ndarray, lang=lang, names=names) -> pa.RecordBatch:
                text = pc.binary_join_element_wise(*(names.take(pa.array(c)) for c in phrases.T), " ")
                return pa.RecordBatch.from_arrays([pc.binary_join_element_wise(lang, text, "\t"), pa.array(n, pa.int64())], schema=_COUNTS)

            yield pa.RecordBatch.from_arrays([pa.array([f"{lang}\t"]), pa.array([np.count_nonzero(shard.ids)], pa.int64())], schema=_COUNTS)
            if longest > 0:
                n = np.bincount(shard.ids, minlength=len(shard.words))
                yield rows(np.arange(1, len(n))[:, None], n[1:])
            for branch in shard.branches() if longest > 1 else ():
                for phrases, n in shard.grow(*branch, longest, frequent):
                    yield rows(phrases, n)

    # one short string is the key of the widest shuffle: language, tab, phrase
    counts = docs.mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).where((F.col("n") >= min_count) | F.col("key").endswith("\t"))
    counts = counts.withColumn("phrase", F.substring_index("key", "\t", -1))
    size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return counts.select(F.expr("left(key, char_length(key) - char_length(phrase) - 1)").alias("lang"), size.alias("size"), "phrase", "n")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 3, min_count: int = 10, held_percent: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two to `longest` words of each language.

    Words are runs of what is no blank or tab within pieces that end at .,;:!? and at line ends; A-Z are lowered. a counts the
    phrase, n all words of the language. The cut after the first words with the least score floor(1000000 * a * a / (l * r))
    counts, l and r being the counts of both parts; of equal ones the first. A phrase that lies in a longer one of min_count
    or more occurrences and held_percent or more of its own is dropped. Ranks go by score, then a, both descending, then by
    the bytes of the phrase. Counts are exact up to 10 ** 16 for a phrase.

    A null language is `und`, null and empty texts have no words, repeated rows count each, further columns do not matter, an
    empty table gives an empty one. All texts are counted; only the result is cut at `top`.
    """
    counts = stage(phrase_counts(docs, lang_col, text_col, longest, min_count))
    known = stage(counts.where("size > 0").select(F.struct("lang", "phrase").alias("part"), "n", "size"))
    found = known.where("size > 1").select("part.lang", "part.phrase", "size", F.col("n").alias("a"))

    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), F.struct("lang", F.call_function("substring_index", "phrase", F.lit(" "), k).alias("phrase")).alias("first"), F.struct("lang", F.call_function("substring_index", "phrase", F.lit(" "), k - F.col("size")).alias("phrase")).alias("rest")))
    cut = found.select("lang", "phrase", "size", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "size", "a", "c.k", "c.first", "c.rest")
    small = if_small(known.select("part", "n"), SMALL_ROWS, SMALL_BYTES)
    for name, count in (("first", "l"), ("rest", "r")):
        hot = hottest(stage(cut.groupBy(name).agg(F.count(F.lit(1)).alias("n"))), name)
        cut = spread_join(cut, small.select(F.col("part").alias(name), F.col("n").alias(count)), name, hot)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    scored = cut.withColumn("score", F.expr("CAST(1000000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)) div (CAST(l AS DECIMAL(38,0)) * CAST(r AS DECIMAL(38,0)))"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "size", "a", "l", "r")).alias("s")).select("lang", "phrase", "s.*")

    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, m), " "))))
    inside = found.where("size > 2").select("lang", "a", F.explode(parts).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = lowest.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * held_percent))

    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    best = left.withColumn("_p", part).withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_p").orderBy(*order))).where(F.col("_n") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", F.col("n").alias("total"))
    out = best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
    return out
