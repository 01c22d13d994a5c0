"""Rectangles as columns x, y, w, h: turns, overlap, document likeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _rect(x, y, w, h) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def to_base(r: Column, turns: Column, width: Column, height: Column) -> Column:
    """A rectangle of a page turned by quarter turns (its own width and height given), on the upright page."""
    x, y, w, h = (r[k] for k in "xywh")
    t = F.pmod(turns, F.lit(4))
    return F.when(t == 1, _rect(height - (y + h), x, h, w)).when(t == 2, _rect(width - (x + w), height - (y + h), w, h)).when(t == 3, _rect(y, width - (x + w), h, w)).otherwise(_rect(x, y, w, h))


def from_base(r: Column, turns: Column, width: Column, height: Column) -> Column:
    """Inverse of to_base, with the width and height of the turned page."""
    x, y, w, h = (r[k] for k in "xywh")
    t = F.pmod(turns, F.lit(4))
    return F.when(t == 1, _rect(y, height - (x + w), h, w)).when(t == 2, _rect(width - (x + w), height - (y + h), w, h)).when(t == 3, _rect(width - (y + h), x, h, w)).otherwise(_rect(x, y, w, h))


def common_area(a: Column, b: Column) -> Column:
    side = lambda p, s: F.greatest(F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]), F.lit(0.0))
    return side("x", "w") * side("y", "h")


def iou(a: Column, b: Column) -> Column:
    common = common_area(a, b)
    union = a["w"] * a["h"] + b["w"] * b["h"] - common
    return F.when(union > 0, common / union).otherwise(0.0)


def same_document(a: Column, b: Column) -> Column:
    """Two rectangles that show one document: they overlap much, or one covers the other and is not much larger."""
    small, large = F.least(a["w"] * a["h"], b["w"] * b["h"]), F.greatest(a["w"] * a["h"], b["w"] * b["h"])
    cover, ratio, over = common_area(a, b) / small, large / small, iou(a, b)
    return F.when((common_area(a, b) > 0) & (small > 0), (over > 0.28) | ((cover > 0.55) & (ratio < 3.5)) | ((cover > 0.40) & (ratio < 2.8) & (over > 0.12))).otherwise(False)


def with_margin(r: Column, share: float, width: Column, height: Column, wider: float = 0.0, deeper: float = 0.0) -> Column:
    """A rectangle grown by a share of its sides, more to the right and down if asked for, within the page."""
    dx, dy = r["w"] * share, r["h"] * share
    x, y = F.greatest(r["x"] - dx, F.lit(0.0)), F.greatest(r["y"] - dy, F.lit(0.0))
    right, bottom = F.least(r["x"] + r["w"] + dx + r["w"] * wider, width), F.least(r["y"] + r["h"] + dy + r["h"] * deeper, height)
    return _rect(x, y, F.greatest(right - x, F.lit(0.0)), F.greatest(bottom - y, F.lit(0.0)))


def from_crop(r: Column, origin_x: Column, origin_y: Column, scale: Column) -> Column:
    """A rectangle read in an enlarged crop, on the page the crop was cut from."""
    return _rect(r["x"] / scale + origin_x, r["y"] / scale + origin_y, r["w"] / scale, r["h"] / scale)
