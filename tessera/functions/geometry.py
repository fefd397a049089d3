"""Column functions on boxes (arrays of x1, y1, x2, y2) and image sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once for a row: inside a lambda an expression is evaluated anew for each element."""
    return F.transform(F.array(value), body)[0]


def area(b: Column) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for disjoint boxes and for an empty union."""
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = w * h
    union = area(a) + area(b) - both
    return F.when((both > 0) & (union > 0), both.cast("double") / union.cast("double")).otherwise(F.lit(0.0))


def is_box(b: Column) -> Column:
    return F.coalesce((b[0] < b[2]) & (b[1] < b[3]), F.lit(False))


def rescale(b: Column, sx: Column, sy: Column) -> Column:
    """Coordinates scaled and rounded half to even."""
    return F.array(*(F.rint(b[i] * (sx if i % 2 == 0 else sy)).cast("long") for i in range(4)))


def holds_point(boxes: Column, x: Column, y: Column) -> Column:
    return F.exists(boxes, lambda b: (b[0] <= x) & (x <= b[2]) & (b[1] <= y) & (y <= b[3]))


def best_iou(b: Column, others: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(others, lambda o: iou(b, o))), F.lit(0.0))


def best_match(b: Column, others: Column, least: float = 0.75) -> Column:
    """Index of the other box with the greatest overlap if that is over least, else -1; the first of equals."""
    best = F.array_max(F.transform(others, lambda o, i: F.struct(iou(b, o).alias("v"), (-i).alias("i"))))
    return F.when(best["v"] > least, -best["i"]).otherwise(F.lit(-1))


def parsed_boxes(s: Column) -> Column:
    """The valid boxes of a response."""
    return F.filter(F.transform(text.tags(s, "box"), text.box), is_box)


def box_validity(s: Column) -> tuple[Column, Column]:
    """(share of well-formed boxes, number of boxes); both 0 if one of the first half overlaps another by more than 0.9."""
    overlaps = lambda some, good: F.exists(F.transform(some, lambda a, i: F.exists(F.transform(good, lambda b, j: (i != j) & (iou(a, b) > 0.9)), lambda x: x)), lambda x: x)

    def judged(bodies: Column, good: Column) -> Column:
        total = F.size(bodies)
        half = F.slice(good, 1, F.greatest(F.lit(0), F.floor(total / 2).cast("int")))
        return _once(overlaps(half, good), lambda twice: F.struct(F.when((total == 0) | twice, F.lit(0.0)).otherwise(F.size(good) / total).alias("share"), F.when(twice, F.lit(0)).otherwise(total).alias("n")))

    out = _once(text.tags(s, "box"), lambda bodies: _once(F.filter(F.transform(bodies, text.box), is_box), lambda good: judged(bodies, good)))
    return out["share"], out["n"]


def box_reward(s: Column, targets: Column) -> Column:
    """Mean of precision and recall by best overlap; without targets 1 if there is a box; without valid boxes 0."""
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)

    def judged(found: Column, targets: Column) -> Column:
        both = 0.5 * (mean(F.transform(targets, lambda t: best_iou(t, found))) + mean(F.transform(found, lambda p: best_iou(p, targets))))
        return F.when(F.size(found) == 0, F.lit(0.0)).otherwise(both)

    bare = F.when(F.size(text.tags(s, "box")) > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.coalesce(F.size(targets), F.lit(0)) <= 0, bare).otherwise(_once(parsed_boxes(s), lambda found: _once(targets, lambda t: judged(found, t))))


def resized(width: Column, height: Column, least: int, most: int) -> tuple[Column, Column]:
    """Image dimensions brought between two pixel counts, the aspect kept; whole parts."""
    def brought(w, h):
        pixels = w * h
        goal = F.when(pixels > most, F.lit(most)).when(pixels < least, F.lit(least)).otherwise(pixels)
        return F.sqrt(goal.cast("double") / pixels)

    f = brought(width, height)
    return F.floor(width * f).cast("long"), F.floor(height * f).cast("long")


def out_of_range(width: Column, height: Column, least: int, most: int) -> Column:
    return (width * height < least) | (width * height > most)
