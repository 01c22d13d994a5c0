"""Operators over boxes of a page: nearest amounts, overlaps, labels beside boxes, gaps; joins on the document, never across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import money, rects


def nearest_amounts(labels: DataFrame, amounts: DataFrame, k: int = 8) -> DataFrame:
    """doc_id, amount: of the k boxes nearest to a document's label (by squared distance, then box_id) the first with more than 1 that is no rate.

    labels: doc_id, x, y; amounts: doc_id, box_id, x, y, amount.
    """
    far = (F.col("a.x") - F.col("l.x")) ** 2 + (F.col("a.y") - F.col("l.y")) ** 2
    pairs = amounts.alias("a").join(labels.alias("l"), "doc_id").select("doc_id", "a.box_id", "amount", far.alias("far"))
    near = pairs.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("far", "box_id"))).where(F.col("r") <= k)
    return near.where((F.col("amount") > 1) & ~money.is_rate(F.col("amount"))).groupBy("doc_id").agg(F.min_by("amount", "r").alias("amount"))


def overlaps(boxes: DataFrame, key: str, ident: str) -> DataFrame:
    """key, a, b, iou, same: pairs of boxes of one page that overlap."""
    a, b = (boxes.select(key, F.col(ident).alias(n), F.struct("x", "y", "w", "h").alias("r" + n)) for n in "ab")
    pairs = a.join(b, key).where("a < b")
    return pairs.select(key, "a", "b", rects.iou(F.col("ra"), F.col("rb")).alias("iou"), rects.same_document(F.col("ra"), F.col("rb")).alias("same")).where("iou > 0")


def vat_pairs(amounts: DataFrame, rate: float) -> DataFrame:
    """doc_id, base, vat: the first base in document order with a later or earlier amount that is its VAT at the rate, within 0.05."""
    a = amounts.select("doc_id", F.col("ordinal").alias("i"), F.col("amount").alias("base"))
    b = amounts.select("doc_id", F.col("ordinal").alias("j"), F.col("amount").alias("vat"))
    hit = a.join(b, "doc_id").where((F.col("base") != F.col("vat")) & (F.abs(F.col("vat") - F.col("base") * rate / 100) <= 0.05))
    return hit.groupBy("doc_id").agg(F.min(F.struct("i", "j", "base", "vat")).alias("m")).select("doc_id", "m.base", "m.vat")


def labelled_boxes(boxes: DataFrame, labels: DataFrame, height: float) -> DataFrame:
    """boxes that have a label left of them in their row, or right above them: a semi-join within the page."""
    dx, dy = F.col("b.x") - F.col("l.x"), F.col("b.y") - F.col("l.y")
    beside = (F.abs(dy) < 1.5 * height) & (dx > 0) & (dx < 12 * height)
    above = (dy > 0) & (dy < 2.5 * height) & (F.abs(dx) < 6 * height)
    return boxes.alias("b").join(labels.alias("l"), (F.col("b.doc_id") == F.col("l.doc_id")) & (beside | above), "left_semi")


def largest_gap(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, gap, cut: the widest stretch that no interval covers (starts within 2 of the end so far join), with its middle."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    gaps = rows.withColumn("till", F.max(end).over(w)).select(key, (F.col(start) - F.col("till")).alias("gap"), ((F.col(start) + F.col("till")) / 2).alias("cut")).where("gap > 2")
    return gaps.groupBy(key).agg(F.max("gap").alias("gap"), F.max_by("cut", F.struct("gap", -F.col("cut"))).alias("cut"))


def largest_reset(rows: DataFrame, key: str, order: list, value: str) -> DataFrame:
    """key, reset: how far a value falls back at most from one row to the next."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("d", F.lag(value).over(w) - F.col(value)).groupBy(key).agg(F.max("d").alias("reset"))


def sessions(rows: DataFrame, key: str, order: list, at: Column, gap) -> DataFrame:
    """rows with session: a new one where the row before lies gap or more behind."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.coalesce((at - F.lag(at).over(w) >= gap).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def head_groups(rows: DataFrame, key: str, at: str, reach: float) -> DataFrame:
    """key, heads: values that open a group; a value within reach of its group's head, not of its neighbour, belongs to it."""
    sorted_ = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.col(at).cast("double"))).alias("v"))
    heads = F.aggregate("v", F.array().cast("array<double>"), lambda acc, v: F.when((F.size(acc) > 0) & (v - F.element_at(acc, -1) < reach), acc).otherwise(F.concat(acc, F.array(v))))
    return sorted_.select(key, heads.alias("heads"))


def ring(rows: DataFrame, key: str, order: list, keep: int) -> DataFrame:
    """The last rows of each key, as a buffer of so many would hold them."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= keep).drop("_r")


def utilisation(rows: DataFrame, key: str, order: list, busy: str, total: str) -> DataFrame:
    """rows with used: growth of busy over growth of total since the row before, 0 to 1; 0 without growth."""
    w = Window.partitionBy(key).orderBy(*order)
    grown = lambda c: F.col(c) - F.lag(c).over(w)
    return rows.withColumn("_b", grown(busy)).withColumn("_t", grown(total)).withColumn("used", F.when(F.coalesce(F.col("_t") > 0, F.lit(False)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_b") / F.col("_t")))).otherwise(0.0)).drop("_b", "_t")


def isolated_cells(detections: DataFrame, key: str, width: Column, height: Column) -> DataFrame:
    """key, det_id, left, top, right, bottom: the part of its page that belongs to each detection alone.

    Towards each other detection of the page a cell ends half way between the middles, across where they share rows and not
    columns, down where it is the other way round, else along the axis on which the middles lie farther apart for their
    size. A cell reaches 2 beyond its own middle at least.
    """
    mid = lambda r, p, s: F.col(f"{r}.{p}") + F.col(f"{r}.{s}") / 2

    def share(p, s):
        common = F.least(F.col(f"a.{p}") + F.col(f"a.{s}"), F.col(f"b.{p}") + F.col(f"b.{s}")) - F.greatest(F.col(f"a.{p}"), F.col(f"b.{p}"))
        small = F.least(F.col(f"a.{s}"), F.col(f"b.{s}"))
        return F.when((common > 0) & (small > 0), common / small).otherwise(0.0)

    def apart(p, s):
        return F.abs(mid("a", p, s) - mid("b", p, s)) / F.greatest(F.col(f"a.{s}"), F.col(f"b.{s}"), F.lit(1.0))

    xs, ys = share("x", "w"), share("y", "h")
    across = F.when((ys > 0.2) & (xs <= 0.2), True).when((xs > 0.2) & (ys <= 0.2), False).otherwise(apart("x", "w") >= apart("y", "h"))
    page = detections.select(key, "det_id", "x", "y", "w", "h")
    pairs = page.alias("a").join(page.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.det_id") != F.col("b.det_id")), "left")
    ax, bx, ay, by = mid("a", "x", "w"), mid("b", "x", "w"), mid("a", "y", "h"), mid("b", "y", "h")
    cut = lambda on, c, v: F.when(F.col("b.det_id").isNotNull() & on & c, v)
    out = pairs.groupBy(F.col(f"a.{key}").alias(key), F.col("a.det_id").alias("det_id"), ax.alias("mx"), ay.alias("my")).agg(
        F.max(cut(across, bx < ax, (ax + bx) / 2)).alias("l"),
        F.min(cut(across, bx > ax, (ax + bx) / 2)).alias("r"),
        F.max(cut(~across, by < ay, (ay + by) / 2)).alias("t"),
        F.min(cut(~across, by > ay, (ay + by) / 2)).alias("b"),
    )
    least, most = lambda c, m: F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.col(m) - 2), lambda c, page, m: F.greatest(F.least(F.coalesce(c, page), page), F.col(m) + 2)
    return out.select(key, "det_id", least("l", "mx").alias("left"), least("t", "my").alias("top"), most("r", width, "mx").alias("right"), most("b", height, "my").alias("bottom"))


def split_at_anchors(lines: DataFrame, key: str, height: float) -> DataFrame:
    """lines (key, y, anchor) with part: cut at the widest gap between lines from one anchor group to the next.

    Anchors within twelve heights of the first of their group are one header. Of equal gaps the first counts.
    """
    ys = lines.groupBy(key).agg(F.array_sort(F.collect_list("y")).alias("ys"), F.array_sort(F.collect_list(F.when(F.col("anchor"), F.col("y")))).alias("at"))
    heads = F.aggregate("at", F.array().cast("array<double>"), lambda acc, v: F.when((F.size(acc) > 0) & (v - F.element_at(acc, -1) < 12 * height), acc).otherwise(F.concat(acc, F.array(v))))

    def cut(k):
        between = F.filter("ys", lambda y: (y >= F.get(F.col("heads"), k)) & (y <= F.get(F.col("heads"), k + 1)))
        gaps = F.zip_with(between, F.slice(between, F.lit(2), F.size(between)), lambda a, b: F.struct((b - a).alias("gap"), (-a).alias("first"), ((a + b) / 2).alias("cut")))
        return F.array_max(F.filter(gaps, lambda g: g["gap"].isNotNull()))["cut"]

    pairs = F.when(F.size("heads") >= 2, F.transform(F.sequence(F.lit(0), F.size("heads") - 2), cut)).otherwise(F.array().cast("array<double>"))
    cuts = ys.withColumn("heads", heads).select(key, pairs.alias("cuts"))
    return lines.join(cuts, key).withColumn("part", F.size(F.filter("cuts", lambda c: F.col("y") >= c))).drop("cuts")


def deskew(quads: DataFrame, key: str) -> DataFrame:
    """quads (key, box_id, the top corners x1, y1, x2, y2 and the middle cx, cy) with the page's slope turned back: angle, cx, cy.

    The slope is the upper median of the boxes' top edges.
    """
    angles = F.array_sort(F.collect_list(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))))
    slopes = quads.groupBy(key).agg(angles.alias("a")).select(key, F.get("a", F.floor(F.size("a") / 2).cast("int")).alias("angle"))
    c, s = F.cos("angle"), F.sin("angle")
    return quads.join(slopes, key).select(key, "box_id", "angle", (F.col("cx") * c + F.col("cy") * s).alias("cx"), (F.col("cy") * c - F.col("cx") * s).alias("cy"))
