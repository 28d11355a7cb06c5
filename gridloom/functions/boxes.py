"""Column functions on boxes. Corners are (x1, y1, x2, y2), centre form is (cx, cy, w, h)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTINUOUS, INCLUSIVE, CLIPPED = "continuous", "inclusive", "clipped"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def overlap(a: tuple, b: tuple, inclusive: bool = False) -> Column:
    """Area that two boxes share; with ``inclusive`` corners are pixels, so a side is one longer."""
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = map(lambda t: tuple(map(_c, t)), (a, b))
    more = 1.0 if inclusive else 0.0
    w = F.least(ax2, bx2) - F.greatest(ax1, bx1) + F.lit(more)
    h = F.least(ay2, by2) - F.greatest(ay1, by1) + F.lit(more)
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def area(b: tuple, inclusive: bool = False) -> Column:
    x1, y1, x2, y2 = map(_c, b)
    more = F.lit(1.0 if inclusive else 0.0)
    return (x2 - x1 + more) * (y2 - y1 + more)


def iou(a: tuple, b: tuple, mode: str = CONTINUOUS) -> Column:
    """Intersection over union of two boxes given by their corners.

    ``continuous``: touching boxes and an empty union give 0. ``inclusive``: corners are pixels, and 1e-6 is added to the
    union. ``clipped``: sides under 0 count as 0, and 1e-9 is added to the union.
    """
    if mode == INCLUSIVE:
        shared = overlap(a, b, True)
        return shared / (area(a, True) + area(b, True) - shared + F.lit(1e-6))
    shared = overlap(a, b)
    if mode == CLIPPED:
        sides = [F.greatest(_c(t[2]) - _c(t[0]), F.lit(0.0)) * F.greatest(_c(t[3]) - _c(t[1]), F.lit(0.0)) for t in (a, b)]
        return shared / (sides[0] + sides[1] - shared + F.lit(1e-9))
    union = area(a) + area(b) - shared
    return F.when((shared > 0) & (union > 0), shared / union).otherwise(F.lit(0.0))


def corners(cx, cy, w, h) -> tuple[Column, Column, Column, Column]:
    cx, cy, w, h = map(_c, (cx, cy, w, h))
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def centre_form(box: tuple, width, height, clamp: bool = True) -> tuple[Column, Column, Column, Column]:
    """Normalised centre form of pixel corners, each value held to [0, 1] with ``clamp``."""
    x1, y1, x2, y2 = map(_c, box)
    width, height = _c(width), _c(height)
    out = ((x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height)
    return tuple(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) for v in out) if clamp else out


def short_side(box: tuple) -> Column:
    x1, y1, x2, y2 = map(_c, box)
    return F.least(x2 - x1, y2 - y1)


def aspect(box: tuple) -> Column:
    """Width by height; 0 where the height is 0."""
    x1, y1, x2, y2 = map(_c, box)
    return F.when(y2 - y1 == 0, F.lit(0.0)).otherwise((x2 - x1) / (y2 - y1))


#: Upper bounds of the density bins and their names, in order.
DENSITY = [(2, "<=2"), (5, "3-5"), (10, "6-10"), (15, "11-15"), (None, ">15")]


def density_bin(count) -> Column:
    """The density bin of a number of boxes; null stays null."""
    n, out = _c(count), None
    for bound, name in DENSITY[:-1]:
        out = (out.when if out is not None else F.when)(n <= bound, name)
    return out.when(n.isNotNull(), DENSITY[-1][1])


def density_order(name) -> Column:
    name, out = _c(name), None
    for at, (_, label) in enumerate(DENSITY):
        out = (out.when if out is not None else F.when)(name == label, at)
    return out


DENSITY_SQL = "CASE WHEN {0} <= 2 THEN '<=2' WHEN {0} <= 5 THEN '3-5' WHEN {0} <= 10 THEN '6-10' WHEN {0} <= 15 THEN '11-15' WHEN {0} IS NOT NULL THEN '>15' END"
ORDER_SQL = "CASE {0} WHEN '<=2' THEN 0 WHEN '3-5' THEN 1 WHEN '6-10' THEN 2 WHEN '11-15' THEN 3 WHEN '>15' THEN 4 END"


def poly_bbox(poly) -> tuple[Column, Column, Column, Column]:
    """Smallest and largest x and y of an array of (x, y) structs."""
    poly = _c(poly)
    xs, ys = F.transform(poly, lambda p: p["x"]), F.transform(poly, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def bbox_poly(box: tuple) -> Column:
    """The four corners of a box as a polygon, clockwise from the top left."""
    x1, y1, x2, y2 = map(_c, box)
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))])


def inner_border(side, overlap_share: float, frac: float) -> Column:
    """Width of the border that a tile's inner window leaves out."""
    return (_c(side) * overlap_share * min(max(frac, 0.0), 1.0)).cast("int")


def in_polygon(poly: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a polygon (array of (x, y) structs), by the even-odd rule; points on an edge may count either way."""

    def crossed(p, i):
        q = F.get(poly, ((i + 1) % F.size(poly)).cast("int"))
        return ((p["y"] > y) != (q["y"] > y)) & (x < p["x"] + (q["x"] - p["x"]) * F.try_divide(y - p["y"], q["y"] - p["y"]))

    return F.size(F.filter(poly, crossed)) % 2 == 1
