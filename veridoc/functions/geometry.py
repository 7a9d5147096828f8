"""Box algebra as Column expressions.  Boxes are half-open pixel rectangles; x2 and y2 are exclusive."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*(F.col(prefix + c) for c in ("x1", "y1", "x2", "y2")))

    @staticmethod
    def in_struct(s: Column) -> Box:
        return Box(s["x1"], s["y1"], s["x2"], s["y2"])

    def named(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for n, c in zip(("x1", "y1", "x2", "y2"), self, strict=True)]

    def struct(self) -> Column:
        return F.struct(*self.named())


def _zero() -> Column:
    return F.lit(0)


def area(b: Box) -> Column:
    return (b.x2 - b.x1) * (b.y2 - b.y1)


def sides(a: Box, b: Box) -> tuple[Column, Column]:
    """Width and height of the intersection; not positive if there is none."""
    return F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; disjoint boxes and empty unions give 0.  Corners are taken as they are."""
    w, h = sides(a, b)
    inter = w * h
    union = area(a) + area(b) - inter
    return F.when((w > 0) & (h > 0) & (union > 0), inter.cast("double") / union).otherwise(F.lit(0.0))


def iou_clamped(a: Box, b: Box) -> Column:
    """IoU with sides and areas never below 0."""
    w, h = sides(a, b)
    inter = F.greatest(w, _zero()) * F.greatest(h, _zero())
    own = lambda x: F.greatest(x.x2 - x.x1, _zero()) * F.greatest(x.y2 - x.y1, _zero())
    union = own(a) + own(b) - inter
    return F.when(union > 0, inter.cast("double") / union).otherwise(F.lit(0.0))


def intersection_over_min(a: Box, b: Box) -> Column:
    w, h = sides(a, b)
    least = F.least(F.greatest(area(a), F.lit(1)), F.greatest(area(b), F.lit(1)))
    return F.when((w > 0) & (h > 0), (w * h).cast("double") / least).otherwise(F.lit(0.0))


def sorted_corners(b: Box) -> Box:
    return Box(F.least(b.x1, b.x2), F.least(b.y1, b.y2), F.greatest(b.x1, b.x2), F.greatest(b.y1, b.y2))


def overlap_fraction(a: Box, b: Box) -> Column:
    """Share of b's area that a covers, whatever the order of corners."""
    a, b = sorted_corners(a), sorted_corners(b)
    w, h = sides(a, b)
    return F.when((w > 0) & (h > 0), (w * h).cast("double") / F.greatest(area(b), F.lit(1))).otherwise(F.lit(0.0))


def union_box(*boxes: Box) -> Box:
    if len(boxes) == 1:
        return boxes[0]
    low = [F.least(*(b[i] for b in boxes)) for i in (0, 1)]
    return Box(*low, *[F.greatest(*(b[i] for b in boxes)) for i in (2, 3)])


def polygon_box(points: Column) -> Box:
    """Bounding box of an array of (x, y) structs of doubles, truncated to integers."""
    end = lambda f, c: f(F.transform(points, lambda p: p[c])).cast("int")
    return Box(end(F.array_min, "x"), end(F.array_min, "y"), end(F.array_max, "x"), end(F.array_max, "y"))


def half_even(c: Column) -> Column:
    return F.rint(c).cast("bigint")


def clip_box(b: Box, width: Column, height: Column, variant: str = "sorted") -> Box:
    """The part of a box on the canvas.  Variants: "sorted" rounds half to even, sorts corners and clips; "clip_first"
    clips each corner to its own border and sorts then; "unsorted" clips only; "edge" also keeps the first corner
    inside the last pixel, so boxes beyond the right or bottom edge leave a strip of one pixel."""
    put = lambda c, most, least=0: F.greatest(F.lit(least), F.least(most, c))
    if variant == "clip_first":
        return sorted_corners(Box(F.greatest(_zero(), b.x1), F.greatest(_zero(), b.y1), F.least(width, b.x2), F.least(height, b.y2)))
    if variant == "unsorted":
        return Box(put(b.x1, width), put(b.y1, height), put(b.x2, width), put(b.y2, height))
    if variant == "edge":
        s = sorted_corners(b)
        return Box(put(s.x1, width - 1), put(s.y1, height - 1), put(s.x2, width), put(s.y2, height))
    if variant == "sorted":
        s = sorted_corners(Box(*(half_even(c) for c in b)))
        return Box(put(s.x1, width), put(s.y1, height), put(s.x2, width), put(s.y2, height))
    raise ValueError(f"no such variant: {variant}")


def rescale(b: Box, sx: Column, sy: Column) -> Box:
    return sorted_corners(Box(half_even(b.x1 * sx), half_even(b.y1 * sy), half_even(b.x2 * sx), half_even(b.y2 * sy)))


def tile_starts(size: Column, patch: int, origin: int = 0) -> Column:
    """Starts of tiles that cover a side; the last is flush with the border."""
    last = size - patch
    steps = F.when(last >= origin, F.sequence(F.lit(origin), F.greatest(last, F.lit(origin)), F.lit(patch))).otherwise(F.array().cast("array<int>"))
    every = F.array_sort(F.array_union(F.array_union(F.array(F.lit(0)), steps), F.array(F.greatest(last, _zero()))))
    return F.when(size <= patch, F.array(F.lit(0))).otherwise(every)


def _snap(c: Column, factor: int) -> Column:
    return half_even(c / factor) * factor


def smart_resize(height: Column, width: Column, least_pixels: int, most_pixels: int, factor: int = 28) -> tuple[Column, Column]:
    """(height, width) in multiples of factor whose product is between the bounds, the aspect kept nearly."""
    h, w = (F.greatest(c, F.lit(factor)).cast("double") for c in (height, width))
    hb, wb = (F.greatest(_snap(c, factor), F.lit(factor)) for c in (h, w))
    shrink, grow = F.sqrt(h * w / most_pixels), F.sqrt(F.lit(float(least_pixels)) / (h * w))
    pick = lambda c, cb: (
        F.when(hb * wb > most_pixels, F.greatest(F.floor(c / shrink / factor) * factor, F.lit(factor))).when(hb * wb < least_pixels, F.ceil(c * grow / factor) * factor).otherwise(cb)
    )
    return pick(h, hb), pick(w, wb)


def smart_resize_approx(width: Column, height: Column, most_pixels: int, factor: int = 28) -> tuple[Column, Column]:
    """(width, height): scaled and snapped, then the width, then the height, lowered until the product fits."""
    if most_pixels <= 0:
        return width, height
    ratio = F.sqrt(F.lit(float(most_pixels)) / (width * height))
    w, h = (F.greatest(_snap(c * ratio, factor), F.lit(factor)) for c in (width, height))
    lower = lambda c, other: F.greatest(F.lit(factor), F.least(c, F.floor(F.lit(most_pixels) / other / factor) * factor))
    w2 = lower(w, h)
    h2 = lower(h, w2)
    fits = width * height <= most_pixels
    return F.when(fits, _snap(width, factor)).otherwise(w2), F.when(fits, _snap(height, factor)).otherwise(h2)


def image_tokens(width: Column, height: Column, patch: int = 28) -> Column:
    """One token for each patch, at least one a side."""
    n = lambda c: F.greatest(F.floor(c / patch), F.lit(1))
    return n(width) * n(height)
