"""Benchmark decontamination by spaced seeds: masked word windows are hashed on both sides and joined, then overlaps around hits are verified."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import dealt, if_small, stage

#: A 1 marks a word that counts, a 0 one that may differ. All have eight words that count and begin with two of them.
MASKS = ("11111111", "111101111", "1110111011", "11011011011")
#: Share of a benchmark item's words that must be found, in place, for a document to count as contaminated.
MIN_SHARE = 0.6
#: Words that match along one alignment, with at most so many others between them, for a part of a long item to count.
RUN_WORDS, RUN_OTHERS = 13, 2
#: Alignments of a document and an item that lie so near to each other count as one: words put in or left out move it.
DRIFT = 3
#: Words of the shortest item that is found, if it stands whole in a document, though it is too short for the masks.
SHORT_WORDS = 4
#: Bits of the table of benchmark words that documents are held against first.
WORD_BITS = 16


def words(text: Column) -> Column:
    """The lower-cased runs of letters and digits of a text; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _slot(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << WORD_BITS) - 1))


def _windows(hashes: str, base: str, number: int) -> Column:
    """Structs (pos, key) of one mask's windows whose words that count are all there."""
    offsets = _offsets(MASKS[number])
    at = lambda i, o: F.get(F.col(hashes), i + F.lit(o))

    def there(i: Column) -> Column:
        out = at(i, offsets[-1]).isNotNull()  # an end beyond the text is null, too
        for o in offsets[2:-1]:
            out = out & at(i, o).isNotNull()
        return out

    return F.transform(F.filter(F.col(base), there), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(number), *(at(i, o) for o in offsets)).alias("key")))


def _seeds(df: DataFrame, ident: str) -> DataFrame:
    """(ident, pos, key) of all windows over the column `_ll_h` of word hashes, in which null is a word no benchmark has."""
    here = F.filter(F.sequence(F.lit(0), F.size("_ll_h") - 1), lambda i: F.get(F.col("_ll_h"), i).isNotNull() & F.get(F.col("_ll_h"), i + 1).isNotNull())
    df = df.where(F.size("_ll_h") > 0).select(ident, "_ll_h", here.alias("_ll_base"))
    return df.select(ident, F.explode(F.concat(*(_windows("_ll_h", "_ll_base", m) for m in range(len(MASKS))))).alias("s")).select(ident, "s.pos", "s.key")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_share: float = MIN_SHARE, run_words: int | None = None, short_items: bool = False) -> DataFrame:
    """(doc_id, item_id, item_words, matched_words): documents that hold so large a share of an item's words, in place.

    Words are lower-cased runs of letters and digits. A seed hit fixes how document and item lie to each other; along it
    equal words count, so substituted ones are tolerated; hits of one pair whose alignments differ by DRIFT at most count
    together, once per word of the item, so a passage with words left out or put in still counts whole, and common words
    that lie elsewhere in a long text do not. With run_words, a pair also counts if one alignment holds so many matched
    words with at most RUN_OTHERS others between them, however long the item is. Items of fewer than eight words have no
    seeds: with short_items, those of SHORT_WORDS or more are found where they stand whole; others are no evidence and are
    never found. Null texts have no words; a null id is an id like any other, also for `decontaminate`. Rows with equal ids
    are searched each, and their matches put together. Repeated items are items of their own if their ids differ, else one.
    Empty tables on either side give an empty table; other columns do not matter.
    """
    items = stage(benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("item")))
    item_hashes = items.select("item_id", F.transform("item", lambda w: F.xxhash64(w)).alias("_ll_h"))
    item_seeds = stage(_seeds(item_hashes, "item_id").withColumnRenamed("pos", "item_pos").distinct())
    # which of 2 ** WORD_BITS places hold a benchmark word: a table of fixed size, whatever the benchmark
    places = item_hashes.select(F.explode("_ll_h").alias("h")).select(F.shiftrightunsigned(_slot(F.col("h")), 6).cast("int").alias("i"), F.expr("shiftleft(1L, int(h & 63))").alias("bit"))
    held = {r["i"]: r["bits"] for r in places.groupBy("i").agg(F.bit_or("bit").alias("bits")).collect()}
    table = F.from_json(F.lit(json.dumps([held.get(i, 0) for i in range(1 << (WORD_BITS - 6))])), "array<bigint>")
    known = lambda h: F.call_function("shiftright", F.get(table, F.shiftrightunsigned(_slot(h), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    # a row is known by its id and text together; null ids meet as structs
    rows = dealt(docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("of")).alias("doc_id"), F.col(text_col).alias("text")))
    hashed = rows.select("doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("_ll_x"))
    hashed = hashed.select("doc_id", F.transform("_ll_x", lambda h: F.when(known(h), h)).alias("_ll_h"))
    hits = _seeds(hashed, "doc_id").join(if_small(item_seeds), "key").select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"))
    hits = stage(hits.distinct())
    texts = rows.join(if_small(hits.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("_ll_w"))
    pairs = texts.join(if_small(hits), "doc_id").join(if_small(items), "item_id")
    # only the words that lie along the item leave the document
    first = F.greatest("shift", F.lit(0))
    part = F.slice("_ll_w", (first + 1).cast("int"), F.greatest(F.size("item") + F.col("shift") - first, F.lit(0)).cast("int"))
    along = pairs.select("doc_id", "item_id", "item", "shift", (F.col("shift") - first).alias("_ll_from"), part.alias("_ll_part"))
    same = F.filter(F.sequence(F.lit(0), F.size("item") - 1), lambda i: F.get("item", i) == F.get("_ll_part", i + F.col("_ll_from").cast("int")))
    along = along.select("doc_id", "item_id", "shift", F.size("item").cast("long").alias("item_words"), same.alias("_ll_same"))
    run = F.lit(False)
    if run_words:
        last = F.slice("_ll_same", run_words, F.greatest(F.size("_ll_same"), F.lit(1)))  # the last words of runs, in step with their first ones
        run = F.exists(F.zip_with(last, "_ll_same", lambda b, a: F.coalesce(b - a < run_words + RUN_OTHERS, F.lit(False))), lambda x: x)
    near = F.explode(F.sequence(F.col("shift") - DRIFT, F.col("shift") + DRIFT)).alias("at")
    matched = along.select("doc_id", "item_id", "item_words", run.alias("run"), "_ll_same", near)
    matched = matched.select("doc_id", "item_id", "item_words", "run", "at", F.explode("_ll_same").alias("i"))
    matched = matched.groupBy("doc_id.id", "item_id", "at", "i").agg(F.max("item_words").alias("item_words"), F.max("run").alias("run"))
    found = matched.groupBy("id", "item_id", "at").agg(F.max("item_words").alias("item_words"), F.count(F.lit(1)).alias("n"), F.max("run").alias("run"))
    found = found.groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.max("item_words").alias("item_words"), F.max("n").alias("matched_words"), F.max("run").alias("run"))
    found = found.where((F.col("matched_words") >= min_share * F.col("item_words")) | F.col("run")).drop("run")
    return found.unionByName(_whole_short_items(hashed, items)) if short_items else found


def _whole_short_items(hashed: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_words, matched_words) of items too short for the masks that stand whole in a document: runs of
    as many words are hashed and joined."""
    short = stage(items.where((F.size("item") >= SHORT_WORDS) & (F.size("item") < len(MASKS[0]))).distinct())
    lengths = [r["n"] for r in short.select(F.size("item").alias("n")).distinct().collect()]  # SHORT_WORDS to 7
    keys = short.select("item_id", F.size("item").cast("long").alias("item_words"), F.xxhash64(F.size("item"), F.transform("item", lambda w: F.xxhash64(w))).alias("key")).distinct()

    def keys_of(n: int) -> Column:
        whole = F.filter(F.sequence(F.lit(1), F.size("_ll_h") - n + 1), lambda i: ~F.exists(F.slice("_ll_h", i, n), lambda h: h.isNull()))
        hashes = F.array_distinct(F.transform(whole, lambda i: F.xxhash64(F.lit(n), F.slice("_ll_h", i, n))))
        return F.when(F.size("_ll_h") >= n, hashes).otherwise(F.array().cast("array<bigint>"))

    runs = [keys_of(n) for n in lengths]
    runs = F.concat(*runs) if runs else F.array().cast("array<bigint>")
    hits = hashed.select("doc_id.id", F.explode(runs).alias("key")).join(if_small(stage(keys)), "key")
    return hits.select(F.col("id").alias("doc_id"), "item_id", "item_words", F.col("item_words").alias("matched_words")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that `contaminated` finds."""
    bad = stage(contaminated(docs, benchmark, id_col, text_col, **options).select(F.struct(F.col("doc_id").alias("id")).alias("_ll_bad")).distinct())
    return docs.join(if_small(bad), F.struct(F.col(id_col).alias("id")) == F.col("_ll_bad"), "left_anti")
