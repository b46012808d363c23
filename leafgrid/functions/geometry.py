"""Box arithmetic as column expressions. A box is four columns, or a struct with fields x1, y1, x2, y2."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F



def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: keeps nested expressions from growing exponentially."""
    return F.transform(F.array(value), use)[0]


@dataclass(frozen=True)
class Box:
    """Four column expressions."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, c: Column) -> Box:
        return cls(c["x1"], c["y1"], c["x2"], c["y2"])

    @classmethod
    def named(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{n}") for n in ("x1", "y1", "x2", "y2")))

    @classmethod
    def at(cls, c: Column) -> Box:
        """From an array of four."""
        return cls(*(F.get(c, F.lit(i)) for i in range(4)))

    def struct(self) -> Column:
        return F.struct(self.x1.alias("x1"), self.y1.alias("y1"), self.x2.alias("x2"), self.y2.alias("y2"))

    def array(self) -> Column:
        return F.array(self.x1, self.y1, self.x2, self.y2)

    def map(self, fx, fy) -> Box:
        return Box(fx(self.x1), fy(self.y1), fx(self.x2), fy(self.y2))

    def ordered(self) -> Box:
        """Corners swapped so that x1 <= x2 and y1 <= y2."""
        return Box(F.least(self.x1, self.x2), F.least(self.y1, self.y2), F.greatest(self.x1, self.x2), F.greatest(self.y1, self.y2))

    def empty(self) -> Column:
        return (self.x2 <= self.x1) | (self.y2 <= self.y1)


def _positive(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def area(b: Box) -> Column:
    return _positive(b.x2 - b.x1) * _positive(b.y2 - b.y1)


def intersection(a: Box, b: Box) -> Column:
    return _positive(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * _positive(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))


def overlap_box(a: Box, b: Box) -> Column:
    """The common box as struct, null where there is none."""
    c = Box(F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1), F.least(a.x2, b.x2), F.least(a.y2, b.y2))
    return F.when(~c.empty(), c.struct())


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))


def coverage(a: Box, b: Box) -> Column:
    """Share of a that b covers."""
    return ratio(intersection(a, b), area(a))


def iou(a: Box, b: Box) -> Column:
    i = intersection(a, b)
    return ratio(i, area(a) + area(b) - i)


def overlaps(a: Box, b: Box) -> Column:
    return (a.x1 < b.x2) & (b.x1 < a.x2) & (a.y1 < b.y2) & (b.y1 < a.y2)


def checked(b: Box) -> Column:
    """Box with ordered corners as struct, null if it is empty or a corner is missing."""
    o = b.ordered()
    known = b.x1.isNotNull() & b.y1.isNotNull() & b.x2.isNotNull() & b.y2.isNotNull()
    return F.when(known & ~o.empty(), o.struct())


def clamped(b: Box, width: Column, height: Column) -> Column:
    """Ordered corners, rounded half to even, clamped to 0..width and 0..height; null if empty then."""
    whole = lambda c, limit: F.least(F.greatest(F.rint(c).cast("int"), F.lit(0)), limit)
    o = b.ordered().map(lambda c: whole(c, width), lambda c: whole(c, height))
    known = b.x1.isNotNull() & b.y1.isNotNull() & b.x2.isNotNull() & b.y2.isNotNull()
    return F.when(known & ~o.empty(), o.struct())


def clamped_1000(b: Box) -> Column:
    return clamped(b, F.lit(1000), F.lit(1000))


def _page(width: Column, height: Column) -> Column:
    return Box(F.lit(0), F.lit(0), width.cast("int"), height.cast("int")).struct()


def pixels_of_1000(b: Box, width: Column, height: Column) -> Column:
    """0..1000 grid to pixels; the whole page where the result is empty."""
    scaled = b.map(lambda c: c / 1000 * width, lambda c: c / 1000 * height)
    return F.coalesce(clamped(scaled, width, height), _page(width, height))


def grid_of_pixels(b: Box, width: Column, height: Column) -> Column:
    """Pixels to the 0..1000 grid, without a test for emptiness."""
    put = lambda c, size: F.least(F.greatest(F.rint(c / F.greatest(size, F.lit(1)) * 1000).cast("int"), F.lit(0)), F.lit(1000))
    return b.map(lambda c: put(c, width), lambda c: put(c, height)).struct()


def rescaled(b: Box, content: Box, width: Column, height: Column) -> Column:
    """Model pixels to page pixels through the content rectangle; the whole page where nothing is left."""
    inside = b.map(
        lambda c: F.least(F.greatest(c, content.x1), content.x2), lambda c: F.least(F.greatest(c, content.y1), content.y2)
    )
    sx = width / F.greatest(content.x2 - content.x1, F.lit(1))
    sy = height / F.greatest(content.y2 - content.y1, F.lit(1))
    moved = inside.map(lambda c: (c - content.x1) * sx, lambda c: (c - content.y1) * sy)
    return F.when(inside.empty(), _page(width, height)).otherwise(F.coalesce(clamped(moved, width, height), _page(width, height)))


def union_area(boxes: Column) -> Column:
    """Area of the union of an array of box structs: slabs between successive x, merged intervals of y in each."""
    return let(boxes, _union_area)


def _union_area(boxes: Column) -> Column:
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("end"))

    def step(acc: Column, s: Column) -> Column:
        new = F.when(acc["end"].isNull() | (s["t"] >= acc["end"]), s["b"] - s["t"]).otherwise(F.greatest(s["b"] - acc["end"], F.lit(0.0)))
        return F.struct((acc["sum"] + new).alias("sum"), F.greatest(F.coalesce(acc["end"], s["b"]), s["b"]).alias("end"))

    def height(left: Column, right: Column) -> Column:
        inside = F.filter(boxes, lambda b: (b["x1"] < right) & (b["x2"] > left))
        spans = F.array_sort(F.transform(inside, lambda b: F.struct(b["y1"].alias("t"), b["y2"].alias("b"))))
        return F.aggregate(spans, start, step)["sum"]

    def over(xs: Column) -> Column:
        n = F.greatest(F.size(xs) - 1, F.lit(0))
        slabs = F.zip_with(F.slice(xs, F.lit(1), n), F.slice(xs, F.lit(2), n), lambda a, b: (b - a) * height(a, b))
        return F.aggregate(slabs, F.lit(0.0), lambda acc, s: acc + s)

    return let(F.array_sort(F.array_distinct(F.flatten(F.transform(boxes, lambda b: F.array(b["x1"], b["x2"]))))), over)


def group_coverage(b: Box, others: Column) -> Column:
    """Share of b that an array of box structs covers together."""
    def covered(s: Column) -> Column:
        own = Box.of(s)
        common = F.filter(F.transform(others, lambda o: overlap_box(own, Box.of(o))), lambda o: o.isNotNull())
        return ratio(union_area(common), area(own))

    return let(b.struct(), covered)


def max_pair_overlap(boxes: Column) -> Column:
    """Greatest overlap of two boxes of an array, over the smaller box."""
    indexed = F.transform(boxes, lambda b, i: F.struct(b.alias("b"), i.alias("i")))

    def with_later(x: Column) -> Column:
        later = F.filter(indexed, lambda y: y["i"] > x["i"])
        each = lambda y: ratio(intersection(Box.of(x["b"]), Box.of(y["b"])), F.least(area(Box.of(x["b"])), area(Box.of(y["b"]))))
        return F.coalesce(F.array_max(F.transform(later, each)), F.lit(0.0))

    return F.coalesce(F.array_max(F.transform(indexed, with_later)), F.lit(0.0))
