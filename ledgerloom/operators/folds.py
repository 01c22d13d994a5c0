"""Order-dependent operators of one document at a time, as folds over its sorted array: what was kept decides what comes next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import rects


def upper_median(values: Column) -> Column:
    """The element at n div 2 of the sorted values, nulls last, 4 at least."""
    return F.greatest(F.get(F.sort_array(F.filter(values, lambda v: v.isNotNull())), F.floor(F.size(values) / 2).cast("int")), F.lit(4.0))


def _sorted_words(boxes: DataFrame, *keys: str, by: tuple[Column, ...] = ()) -> DataFrame:
    # sort_array has a compiled order where array_sort calls a lambda; no word is null, so both give one order
    word = F.struct(*by, (F.col("y") + F.col("h") / 2).alias("c"), "x", "box_id", "y", "w", "h", "text")
    return boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(word)).alias("words"))


def dedupe_words(boxes: DataFrame, *keys: str) -> DataFrame:
    """boxes (keys, box_id, text, x, y, w, h) without those that repeat the text of a kept one at almost the same place; blank ones go, too."""
    centre = lambda b: b["x"] + b["w"] / 2

    def near(o, w):
        dx, dy = F.abs(centre(o) - centre(w)), F.abs(o["c"] - w["c"])
        return (dx < F.greatest(o["w"], w["w"], F.lit(8.0)) * 0.55) & (dy < F.greatest(o["h"], w["h"], F.lit(6.0)) * 0.7)

    rows = _sorted_words(boxes.withColumn("text", F.trim("text")).where(F.col("text") != ""), *keys, by=(F.upper("text").alias("upper"),))
    # words of one text follow each other, so each is held against the kept ones of its text alone
    none = F.slice("words", 1, 0)
    state = lambda upper, same, out: F.struct(upper.alias("upper"), same.alias("same"), out.alias("out"))

    def step(s, w):
        again = s["upper"] == w["upper"]
        new = state(w["upper"], F.array(w), F.concat(s["out"], s["same"]))
        return F.when(again & F.exists(s["same"], lambda o: near(o, w)), s).when(again, state(s["upper"], F.concat(s["same"], F.array(w)), s["out"])).otherwise(new)

    kept = F.aggregate("words", state(F.lit(""), none, none), step, lambda s: F.concat(s["out"], s["same"]))
    return rows.select(*keys, F.explode(kept).alias("b")).select(*keys, "b.box_id", "b.text", "b.x", "b.y", "b.w", "b.h")


def group_lines(boxes: DataFrame, *keys: str) -> DataFrame:
    """keys, line_no, text: words in order of their middles join the line whose running mean lies within 0.7 of the median height; equal neighbours on a line are read once."""
    rows = _sorted_words(boxes, *keys).withColumn("near", upper_median(F.transform("words", lambda w: w["h"])) * 0.7)
    token = "struct<x:double,box_id:bigint,text:string>"
    start = F.struct(F.lit(-1e18).alias("mean"), F.lit(0.0).alias("n"), F.array().cast(f"array<{token}>").alias("line"), F.array().cast(f"array<array<{token}>>").alias("out"))

    def step(s, w):
        said = F.array(F.struct(w["x"].cast("double").alias("x"), w["box_id"].cast("long").alias("box_id"), w["text"].alias("text")))
        state = lambda mean, n, line, out: F.struct(mean.alias("mean"), n.alias("n"), line.alias("line"), out.alias("out"))
        longer = state((s["mean"] * s["n"] + w["c"]) / (s["n"] + 1), s["n"] + 1, F.concat(s["line"], said), s["out"])
        return F.when(F.abs(w["c"] - s["mean"]) < F.col("near"), longer).otherwise(state(w["c"], F.lit(1.0), said, F.concat(s["out"], F.array(s["line"]))))

    # the first of the lines is the empty one before them
    lines = rows.select(*keys, F.posexplode(F.aggregate("words", start, step, lambda s: F.concat(s["out"], F.array(s["line"])))).alias("line_no", "line")).where("line_no > 0")
    lines = lines.select(*keys, "line_no", F.transform(F.sort_array("line"), lambda x: x["text"]).alias("w"))
    once = F.filter("w", lambda x, i: (i == 0) | (F.upper(F.get(F.col("w"), i - 1)) != F.upper(x)))
    return lines.select(*keys, "line_no", F.array_join(once, " ").alias("text"))


def keep_best(rows: DataFrame, keys: list[str], order: list[Column], same, payload: list[str]) -> DataFrame:
    """Greedy choice: rows in order; one stays unless it is the same as one that stays already. same(kept, row) is a Column."""
    item = F.struct(*(o.alias(f"_k{i}") for i, o in enumerate(order)), *payload)
    sets = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, r: F.when(F.exists(acc, lambda k: same(k, r)), acc).otherwise(F.concat(acc, F.array(r))))
    return sets.select(*keys, F.explode(kept).alias("r")).select(*keys, *(f"r.{p}" for p in payload))


def suppress(detections: DataFrame, *keys: str) -> DataFrame:
    """Detections (keys, det_id, x, y, w, h, score), best score first, without those that show a document that is kept already."""
    return keep_best(detections, list(keys), [-F.col("score"), F.col("det_id")], rects.same_document, ["det_id", "x", "y", "w", "h", "score"])


def dedupe_receipts(receipts: DataFrame, *keys: str) -> DataFrame:
    """Receipts (keys, rec_id, cui, total, date, x, y, w, h, completeness), most complete first, without repeats of kept ones and empty fragments.

    Repeats: one company and about equal totals; one company and place with one total missing; no company at the same place;
    no company with total and date of a kept one. Two receipts of one company with other totals both stay.
    """
    near = lambda a, b: F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) < 0.05)

    def same(o, r):
        known = F.char_length(F.coalesce(r["cui"], F.lit(""))) >= 4
        place, company = rects.same_document(o, r), known & r["cui"].eqNullSafe(o["cui"])
        return (company & near(r["total"], o["total"])) | (company & place & (r["total"].isNull() | o["total"].isNull())) | (~known & place) | (~known & r["total"].isNotNull() & r["date"].isNotNull() & near(o["total"], r["total"]) & o["date"].eqNullSafe(r["date"]))

    kept = keep_best(receipts, list(keys), [-F.col("completeness"), F.col("rec_id")], same, ["rec_id", "cui", "total", "date", "x", "y", "w", "h", "completeness"])
    return kept.where(F.col("total").isNotNull() | (F.char_length(F.coalesce("cui", F.lit(""))) >= 4))
