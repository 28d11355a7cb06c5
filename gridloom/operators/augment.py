"""Geometry of label augmentation: copies of an image with their own rotation, scale, shift and crop."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.polygons import Rings, as_rings, in_groups, parts_of

_MOVED = T.StructType().add("ring", T.ArrayType(T.StructType().add("x", "double").add("y", "double"))).add("parts", "integer").add("x1", "double").add("y1", "double").add("x2", "double").add("y2", "double")


@F.arrow_udf(_MOVED)
def _moved_part(polys: pa.Array, a: pa.Array, b: pa.Array, sx: pa.Array, sy: pa.Array, dx: pa.Array, dy: pa.Array, fit: pa.Array, ox: pa.Array, oy: pa.Array, cw: pa.Array, ch: pa.Array, clipped: pa.Array) -> pa.Array:
    """Polygons fitted and moved: the largest part within the frame and the moved image with its box, or, of those that are not
    clipped, the box of all corners and no ring."""
    missing = polys.is_null().to_numpy(zero_copy_only=False)
    of = [v.to_numpy(zero_copy_only=False).astype(np.float64) for v in (a, b, sx, sy, dx, dy, fit, ox, oy, cw, ch)]
    clipped = clipped.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
    count, box, out = np.zeros(len(missing), np.int32), np.full((4, len(missing)), np.nan), []
    for rows, held in in_groups(polys):
        ka, kb, w, h, kx, ky, f, fx, fy, iw, ih = (v[rows][:, None] for v in of)

        def moved(px, py):
            x, y = px - w / 2, py - h / 2
            return ka * x + kb * y + w / 2 + kx * w, ka * y - kb * x + h / 2 + ky * h

        ring = Rings(*moved(held.x * f + fx, held.y * f + fy), held.n)
        corners = [moved(x, y) for x, y in ((fx, fy), (fx + iw, fy), (fx + iw, fy + ih), (fx, fy + ih))]
        quad = Rings(*(np.concatenate([c[i] for c in corners], axis=1) for i in (0, 1)), np.full(len(rows), 4))
        side = np.sign(quad.areas())[:, None]
        ea, eb = (quad.y - quad.next(quad.y)) * side, (quad.next(quad.x) - quad.x) * side
        one, none = np.ones((len(rows), 1)), np.zeros((len(rows), 1))
        frame = np.stack([np.concatenate(v, axis=1) for v in ((one, -one, none, none), (none, none, one, -one), (none, w, none, h))], axis=2)
        planes = np.concatenate([frame, np.stack([ea, eb, -(ea * quad.x + eb * quad.y)], axis=2)], axis=1)
        if (own := clipped[rows]).any():
            cut, count[rows[own]] = parts_of(Rings(ring.x[own], ring.y[own], ring.n[own]), planes[own])
            out.append((rows[own], cut))
            _boxed(box, rows[own], cut)
        if not own.all():
            _boxed(box, rows[~own], Rings(ring.x[~own], ring.y[~own], ring.n[~own]))
    for rows, part in out:
        part.n = np.where(missing[rows], 0, part.n)
    none = missing | ~clipped
    ends = [pa.array(v, mask=np.isnan(v)) for v in box]
    return pa.StructArray.from_arrays([as_rings(len(missing), out, none), pa.array(count, pa.int32(), mask=none), *ends], ["ring", "parts", "x1", "y1", "x2", "y2"])


def _boxed(box: np.ndarray, rows: np.ndarray, rings: Rings) -> None:
    """The smallest and largest coordinates of rings, into ``box``."""
    real = rings.real & (rings.n > 0)[:, None]
    for at, v in ((0, rings.x), (1, rings.y)):
        low, high = np.where(real, v, np.inf).min(axis=1), np.where(real, v, -np.inf).max(axis=1)
        box[at, rows], box[at + 2, rows] = np.where(rings.n > 0, low, np.nan), np.where(rings.n > 0, high, np.nan)


def fan_out(images: DataFrame, augs: int) -> DataFrame:
    """Rows (image_id, aug): ``augs`` copies, one more for two tags or more, two more for four or more."""
    n = F.lit(augs) + F.when(F.col("tags") >= 2, 1).otherwise(0) + F.when(F.col("tags") >= 4, 2).otherwise(0)
    return images.select("*", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("aug"))


def draw(seed: int, name: str, low: float, high: float) -> Column:
    """A number in [low, high) that depends on seed, image, copy and name alone, not on partitioning."""
    share = F.pmod(F.xxhash64(F.lit(seed), "image_id", "aug", F.lit(name)), F.lit(1 << 30)) / float(1 << 30)
    return F.lit(low) + share * (high - low)


def drawn(copies: DataFrame, seed: int, angle: float, scale: float, shift: float) -> DataFrame:
    return copies.withColumns({"angle": draw(seed, "angle", -angle, angle), "scale": draw(seed, "scale", 1 - scale, 1 + scale), "dx": draw(seed, "dx", -shift, shift), "dy": draw(seed, "dy", -shift, shift)})


def transform_polygons(rows: DataFrame, target: int | None = None, tag_class: int = 1, least_area: float = 4.0) -> DataFrame:
    """Labels (image_id, aug, box_id, cls, x1, y1, x2, y2, poly) of polygons turned by ``angle`` degrees and scaled about the centre,
    then shifted by shares (``dx``, ``dy``) of the sides. Columns cos and sin, if there, are taken instead of the angle.

    Without ``target`` the frame is the image. With it, an image is first fitted into a square of that side, its sides truncated
    to whole pixels, and centred. Panels (all classes but ``tag_class``) need three corners or more; each is clipped to the frame
    and to the moved image within it, and its label is the largest part with its box. A tag is the box of its moved corners,
    held to the frame. Boxes under ``least_area`` square pixels or without a side go. Corners are rounded to 1e-6 pixel.
    """
    turn = {n: F.col(n) if n in rows.columns else f(F.radians("angle")) for n, f in (("cos", F.cos), ("sin", F.sin))}
    a, b = F.col("scale") * turn["cos"], F.col("scale") * turn["sin"]
    if target is None:
        fit, side, content, off = F.lit(1.0), (F.col("width"), F.col("height")), (F.col("width"), F.col("height")), (F.lit(0), F.lit(0))
    else:
        fit, side = F.least(F.lit(float(target)) / F.col("height"), F.lit(float(target)) / F.col("width")), (F.lit(target), F.lit(target))
        content = tuple((F.col(c) * fit).cast("long") for c in ("width", "height"))
        off = tuple(F.floor((F.lit(target) - c) / 2) for c in content)
    named = {"_fit": fit, "_a": a, "_b": b, "_sx": side[0].cast("double"), "_sy": side[1].cast("double"), "_cw": content[0], "_ch": content[1], "_ox": off[0], "_oy": off[1]}
    out = rows.where((F.col("cls") == tag_class) | (F.size("poly") >= 3)).withColumns(named)

    part = _moved_part("poly", *(F.col(c).cast("double") for c in ("_a", "_b", "_sx", "_sy", "dx", "dy", "_fit", "_ox", "_oy", "_cw", "_ch")), F.col("cls") != tag_class)
    out = out.withColumn("_moved", part).select(*(c for c in out.columns if c != "poly"), F.explode(F.array("_moved")).alias("_part"))
    out = out.where((F.col("cls") == tag_class) | (F.col("_part.parts") > 0))

    def held(v, axis):
        return F.least(F.greatest(v, F.lit(0.0)), F.col(f"_s{axis}"))

    boxed = {}
    for c in ("x1", "y1", "x2", "y2"):
        own = F.col(f"_part.{c}")
        boxed[c] = F.round(F.when(F.col("cls") == tag_class, held(own, c[0])).otherwise(own), 6) + F.lit(0.0)
    out = out.withColumns(boxed).where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) >= least_area))
    return out.select("image_id", "aug", "box_id", "cls", "x1", "y1", "x2", "y2", F.col("_part.ring").alias("poly"))
