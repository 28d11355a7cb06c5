"""Tile grids, labels of tiles, crops and regions: generators and range joins within an image."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.boxes import bbox_poly, in_polygon, overlap, poly_bbox
from gridloom.operators.cells import meet, touched
from gridloom.operators.polygons import RING, box_window, signed_area, with_part

CORNERS = ("x1", "y1", "x2", "y2")


def stride_of(tile: int, share: float) -> int:
    """Python's round is half to even."""
    return max(1, round(tile * (1 - share)))


def _starts(side: Column, tile: int, stride: int, cover: bool) -> Column:
    last = F.greatest(side - tile, F.lit(0)).cast("long")
    steps = F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long"))
    return F.array_union(steps, F.array(last)) if cover else steps


def tile_grid(images: DataFrame, tile: int, overlap_share: float, cover_edges: bool = False) -> DataFrame:
    """Windows (tx, ty, tx2, ty2) of each image. The last stride may leave a strip at the right and bottom edge uncovered;
    with ``cover_edges`` a last tile reaches to the edge."""
    stride = stride_of(tile, overlap_share)
    grid = images.select("image_id", "width", "height", F.explode(_starts(F.col("width"), tile, stride, cover_edges)).alias("tx"))
    grid = grid.select("*", F.explode(_starts(F.col("height"), tile, stride, cover_edges)).alias("ty"))
    return grid.select("image_id", "tx", "ty", F.least(F.col("tx") + tile, "width").alias("tx2"), F.least(F.col("ty") + tile, "height").alias("ty2"))


def preview_grid(images: DataFrame, tile: int, overlap_share: float, centred: bool = False) -> DataFrame:
    """A grid that covers to the edge: as many strides as are needed, all moved by half of what they exceed if ``centred``."""
    stride = stride_of(tile, overlap_share)

    def starts(side):
        n = F.greatest(F.lit(0), F.ceil((F.col(side) - tile) / stride)).cast("long")
        shift = F.floor((n * stride + tile - F.greatest(F.col(side), F.lit(tile))) / 2) if centred else F.lit(0)
        return F.transform(F.sequence(F.lit(0).cast("long"), n), lambda k: (k * stride - shift).cast("long"))

    grid = images.select("image_id", F.explode(starts("width")).alias("tx"), "height")
    return grid.select("image_id", "tx", F.explode(starts("height")).alias("ty"))


def mining_grid(images: DataFrame, tile: int, share: float = 0.8) -> DataFrame:
    """Whole tiles only, at steps of the truncated share of a tile."""
    step = int(tile * share)
    big = images.where((F.col("width") >= tile) & (F.col("height") >= tile))

    def starts(side):
        return F.explode(F.sequence(F.lit(0).cast("long"), (F.col(side) - tile).cast("long"), F.lit(step).cast("long")))

    return big.select("image_id", starts("width").alias("tx"), "height").select("image_id", "tx", starts("height").alias("ty"))


def empty_tiles(tiles: DataFrame, boxes: DataFrame, tile: int) -> DataFrame:
    """Tiles that no box touches; intervals are closed, so a shared edge is a touch."""
    keys = ["image_id", "tx", "ty"]
    met = touched(tiles, boxes, ("tx", "ty", F.col("tx") + tile, F.col("ty") + tile), CORNERS, keys, cell=tile)
    return tiles.join(met, keys, "left_anti")


def _outlined(boxes: DataFrame) -> DataFrame:
    """image_id, box_id, cls, the corners and, if there, poly; the corners of a row with a polygon of three points or more are the
    polygon's, other polygons count as none."""
    if "poly" not in boxes.columns:
        return boxes.select("image_id", "box_id", "cls", *CORNERS)
    b = boxes.withColumn("poly", F.when(F.size("poly") >= 3, F.col("poly").cast(RING)))
    return b.select("image_id", "box_id", "cls", *(F.coalesce(v, F.col(c)).alias(c) for v, c in zip(poly_bbox("poly"), CORNERS, strict=True)), "poly")


def _cut_to(met: DataFrame, window: tuple[Column, Column, Column, Column]) -> DataFrame:
    """Rows with their corners held to a window. Polygons are clipped: the corners are those of the largest part, the column area
    is that part's, and rows without a part go; the area of other rows is their box's."""
    low = {c: F.greatest(c, w) if c.endswith("1") else F.least(c, w) for c, w in zip(CORNERS, window, strict=True)}
    if "poly" not in met.columns:
        return met.withColumns(low).withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    cut = with_part(met, F.col("poly"), box_window(*window)).where("_part IS NULL OR _part.parts > 0").withColumn("poly", F.col("_part.ring"))
    ring = dict(zip(CORNERS, poly_bbox("poly"), strict=True))
    cut = cut.withColumns({c: F.coalesce(ring[c], low[c]) for c in CORNERS})
    return cut.withColumn("area", F.coalesce(F.abs(signed_area(F.col("poly"))), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))))


def tile_labels(tiles: DataFrame, boxes: DataFrame, tile: int, least: float = 0.0015) -> DataFrame:
    """Boxes clipped to the tiles they overlap, normalised by the tile; parts whose box is under ``least`` of a tile go.

    Tiles of the same place count once. Where ``boxes`` has a column poly (corners in pixels), a label is the box of the largest
    part of its polygon within the tile, and poly holds that part, normalised; a row without a polygon is its box.
    """
    t, b = tiles.select("image_id", "tx", "ty").dropDuplicates(["image_id", "ty", "tx"]), _outlined(boxes)
    window = (F.col("tx"), F.col("ty"), F.col("tx") + tile, F.col("ty") + tile)
    met = meet(t, b, window, CORNERS, cell=tile).where((F.col("x1") < window[2]) & (F.col("x2") > window[0]) & (F.col("y1") < window[3]) & (F.col("y2") > window[1]))
    label = _cut_to(met, window).withColumns({
        "cx": ((F.col("x1") + F.col("x2")) / 2 - F.col("tx")) / tile, "cy": ((F.col("y1") + F.col("y2")) / 2 - F.col("ty")) / tile,
        "w": (F.col("x2") - F.col("x1")) / tile, "h": (F.col("y2") - F.col("y1")) / tile,
    })
    local = [F.transform("poly", lambda p: F.struct(((p["x"] - F.col("tx")) / tile).alias("x"), ((p["y"] - F.col("ty")) / tile).alias("y"))).alias("poly")] if "poly" in boxes.columns else []
    return label.where(F.col("w") * F.col("h") >= least).select("image_id", "tx", "ty", "box_id", "cls", "cx", "cy", "w", "h", *local)


def retile(tiles: DataFrame, boxes: DataFrame, images: DataFrame, tile: int, least_share: float) -> DataFrame:
    """Rows (image_id, tx, ty, new_tx, new_ty, moved): tiles with labels, moved onto their largest label if that is too small.

    A tile whose largest label covers less than ``least_share`` of it is centred on that label, and the new place is adopted if
    its largest label then reaches both the old one and ``least_share``. Ties go to the smaller box_id. Tiles that end at the
    same place count once (``moved`` first).
    """
    sizes = tile_labels(tiles, boxes, tile).withColumn("area", F.col("w") * F.col("h"))
    best = sizes.groupBy("image_id", "tx", "ty").agg(F.max(F.struct("area", (-F.col("box_id")).alias("n"), "cx", "cy")).alias("b")).select("image_id", "tx", "ty", "b.area", "b.cx", "b.cy")
    size = images.select("image_id", "width", "height")

    def new(axis, side, centre):
        at = F.col(axis) + F.col(centre) * tile - tile / 2
        return F.greatest(F.lit(0.0), F.least(F.col(side) - F.lit(float(tile)), at)).cast("long")

    small = best.where(F.col("area") < least_share).join(size, "image_id").select("image_id", "tx", "ty", "area", new("tx", "width", "cx").alias("new_tx"), new("ty", "height", "cy").alias("new_ty"))
    tried = tile_labels(small.select("image_id", F.col("new_tx").alias("tx"), F.col("new_ty").alias("ty")), boxes, tile)
    found = tried.groupBy("image_id", F.col("tx").alias("new_tx"), F.col("ty").alias("new_ty")).agg(F.max(F.col("w") * F.col("h")).alias("new_area"))
    adopted = small.join(found, ["image_id", "new_tx", "new_ty"]).where(F.col("new_area") >= F.greatest("area", F.lit(least_share))).select("image_id", "tx", "ty", "new_tx", "new_ty")
    out = best.join(adopted, ["image_id", "tx", "ty"], "left").select("image_id", "tx", "ty", F.coalesce("new_tx", "tx").alias("new_tx"), F.coalesce("new_ty", "ty").alias("new_ty"), F.col("new_tx").isNotNull().alias("moved"))
    first = F.row_number().over(Window.partitionBy("image_id", "new_tx", "new_ty").orderBy(F.desc("moved"), "ty", "tx"))
    return out.withColumn("_nth", first).where("_nth = 1").drop("_nth")


def crop_windows(panels: DataFrame, tags: DataFrame, images: DataFrame, pad: float = 0.22) -> DataFrame:
    """A window around each panel: padded on all sides, enlarged to the tags whose centre is strictly inside the panel, then
    truncated to whole pixels and held to the image. Panels under one pixel and empty windows go.

    Where ``panels`` has a column poly (corners in pixels), a centre must lie in the polygon, by the even-odd rule, as well as in
    its box; a row without a polygon is its box.
    """
    p = panels.where("x2 - x1 >= 1 AND y2 - y1 >= 1").select("image_id", F.col("box_id").alias("panel_id"), *(F.col(c).alias(f"p{c}") for c in CORNERS), *(["poly"] if "poly" in panels.columns else []))
    cx, cy = F.col("tcx"), F.col("tcy")
    t = tags.select("image_id", *CORNERS, ((F.col("x1") + F.col("x2")) / 2).alias("tcx"), ((F.col("y1") + F.col("y2")) / 2).alias("tcy"))
    inside = (cx > F.col("px1")) & (cx < F.col("px2")) & (cy > F.col("py1")) & (cy < F.col("py2"))
    if "poly" in panels.columns:
        inside = inside & (F.col("poly").isNull() | in_polygon(F.col("poly"), cx, cy))
    held = meet(p, t, ("px1", "py1", "px2", "py2"), ("tcx", "tcy", "tcx", "tcy")).where(inside).groupBy("image_id", "panel_id").agg(F.min("x1").alias("tx1"), F.min("y1").alias("ty1"), F.max("x2").alias("tx2"), F.max("y2").alias("ty2"), F.count(F.lit(1)).alias("tags"))
    out = panels.where("x2 - x1 >= 1 AND y2 - y1 >= 1").select("image_id", F.col("box_id").alias("panel_id"), *CORNERS).join(held, ["image_id", "panel_id"], "left").join(images.select("image_id", "width", "height"), "image_id")
    w, h = (F.col("x2") - F.col("x1")) * F.lit(pad), (F.col("y2") - F.col("y1")) * F.lit(pad)
    out = out.select(
        "image_id", "panel_id", F.coalesce("tags", F.lit(0)).alias("tags"),
        F.greatest(F.lit(0), F.least(F.col("x1") - w, "tx1").cast("long")).alias("cx1"), F.greatest(F.lit(0), F.least(F.col("y1") - h, "ty1").cast("long")).alias("cy1"),
        F.least(F.col("width"), F.greatest(F.col("x2") + w, "tx2").cast("long")).alias("cx2"), F.least(F.col("height"), F.greatest(F.col("y2") + h, "ty2").cast("long")).alias("cy2"),
    )
    return out.where("cx2 > cx1 AND cy2 > cy1")


def letterbox(crops: DataFrame, boxes: DataFrame, target: int) -> DataFrame:
    """Labels of the boxes that overlap a crop, in the square of ``target`` pixels into which the crop is fitted and centred.

    Parts of under one square pixel, or of a normalised side under 1e-4, go. Where ``boxes`` has a column poly (corners in
    pixels), a row of class 0 is clipped as a polygon, its area is that of the largest part, and poly holds the part (of a row
    without a polygon, its box) in the square; poly is null for other classes, which are boxes.
    """
    b = _outlined(boxes.withColumn("poly", F.when(F.col("cls") == 0, F.col("poly"))) if "poly" in boxes.columns else boxes)
    window = tuple(map(F.col, ("cx1", "cy1", "cx2", "cy2")))
    met = meet(crops.select("image_id", "panel_id", "cx1", "cy1", "cx2", "cy2"), b, window, CORNERS).where("x1 < cx2 AND x2 > cx1 AND y1 < cy2 AND y2 > cy1")
    cut = _cut_to(met, window).where("area >= 1").withColumns({"cw": F.col("cx2") - F.col("cx1"), "ch": F.col("cy2") - F.col("cy1")})
    cut = cut.withColumn("scale", F.lit(float(target)) / F.greatest("cw", "ch"))
    cut = cut.withColumns({"left": F.floor((F.lit(target) - (F.col("cw") * F.col("scale")).cast("long")) / 2), "top": F.floor((F.lit(target) - (F.col("ch") * F.col("scale")).cast("long")) / 2)})
    local = []
    if "poly" in boxes.columns:
        ring = F.when(F.col("cls") == 0, F.coalesce("poly", bbox_poly(tuple(F.col(c).cast("double") for c in CORNERS))))
        local = [F.transform(ring, lambda p: F.struct((((p["x"] - F.col("cx1")) * F.col("scale") + F.col("left")) / target).alias("x"), (((p["y"] - F.col("cy1")) * F.col("scale") + F.col("top")) / target).alias("y"))).alias("poly")]
    out = cut.select(
        "image_id", "panel_id", "box_id", "cls",
        ((((F.col("x1") + F.col("x2")) / 2 - F.col("cx1")) * F.col("scale") + F.col("left")) / target).alias("cx"), ((((F.col("y1") + F.col("y2")) / 2 - F.col("cy1")) * F.col("scale") + F.col("top")) / target).alias("cy"),
        ((F.col("x2") - F.col("x1")) * F.col("scale") / target).alias("w"), ((F.col("y2") - F.col("y1")) * F.col("scale") / target).alias("h"), *local,
    )
    return out.where("w >= 1e-4 AND h >= 1e-4")


def manifest_boxes(rois: DataFrame, images: DataFrame) -> DataFrame:
    """Regions of inclusive corners held to their image. A missing corner is that of the image, so a region without any is the
    whole image; inverted ones go. A region may be one pixel wide."""
    r = rois.join(images.select("image_id", "width", "height"), "image_id")
    whole = F.coalesce("x0", "y0", "x1", "y1").isNull()

    def held(c, side, missing):
        return F.greatest(F.lit(0), F.least(F.coalesce(F.col(c), missing), F.col(side) - 1)).cast("long").alias(c)

    out = r.select("image_id", held("x0", "width", F.lit(0)), held("y0", "height", F.lit(0)), held("x1", "width", F.col("width") - 1), held("y1", "height", F.col("height") - 1), whole.alias("whole"))
    return out.where("x1 >= x0 AND y1 >= y0")


def roi_labels(rois: DataFrame, boxes: DataFrame, least: float = 0.0, by_centre: bool = True) -> DataFrame:
    """Labels of boxes within a region of inclusive corners (x0, y0, x1, y1), normalised by its size and held to [0, 1].

    A box stays if at least ``least`` of it is visible, or, with ``by_centre``, if its centre lies in the region.
    """
    r, b = rois.select("image_id", F.col("x0").alias("rx0"), F.col("y0").alias("ry0"), F.col("x1").alias("rx1"), F.col("y1").alias("ry1")), boxes.select("image_id", "box_id", "cls", *CORNERS)
    met = meet(r, b, ("rx0", "ry0", "rx1", "ry1"), CORNERS).withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2, "inter": overlap(("rx0", "ry0", "rx1", "ry1"), CORNERS)})
    share = F.col("inter") / F.greatest((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), F.lit(1e-6))
    inside = F.col("cx").between(F.col("rx0"), F.col("rx1")) & F.col("cy").between(F.col("ry0"), F.col("ry1")) & F.lit(by_centre)
    kept = met.where(((F.col("inter") > 0) & (share >= least)) | inside)
    return _in_region(kept)


def _in_region(met: DataFrame) -> DataFrame:
    def held(c, low, high):
        return F.least(F.greatest(F.col(c), F.col(low)), F.col(high))

    w, h = F.greatest(F.lit(1), F.col("rx1") - F.col("rx0") + 1), F.greatest(F.lit(1), F.col("ry1") - F.col("ry0") + 1)
    out = met.select("image_id", "box_id", "cls", *(F.col(c) for c in ("rx0", "ry0", "rx1", "ry1")), held("x1", "rx0", "rx1").alias("a"), held("x2", "rx0", "rx1").alias("b"), held("y1", "ry0", "ry1").alias("c"), held("y2", "ry0", "ry1").alias("d"))

    def unit(v):
        return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))

    return out.select("image_id", "box_id", "cls", unit(((F.col("a") + F.col("b")) / 2 - F.col("rx0")) / w).alias("cx"), unit(((F.col("c") + F.col("d")) / 2 - F.col("ry0")) / h).alias("cy"), unit((F.col("b") - F.col("a")) / w).alias("w"), unit((F.col("d") - F.col("c")) / h).alias("h"))


def roi_labels_nearest(rois: DataFrame, boxes: DataFrame, least: float) -> DataFrame:
    """``roi_labels`` without the centre rule; a region that loses all its boxes keeps the one that overlaps it most."""
    kept = roi_labels(rois, boxes, least, by_centre=False)
    r = rois.select("image_id", F.col("x0").alias("rx0"), F.col("y0").alias("ry0"), F.col("x1").alias("rx1"), F.col("y1").alias("ry1")).join(kept.select("image_id").distinct(), "image_id", "left_anti")
    met = meet(r, boxes.select("image_id", "box_id", "cls", *CORNERS), ("rx0", "ry0", "rx1", "ry1"), CORNERS).withColumn("inter", overlap(("rx0", "ry0", "rx1", "ry1"), CORNERS)).where("inter > 0")
    nth = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("inter"), "box_id"))
    best = met.withColumn("_nth", nth).where("_nth = 1")
    return kept.withColumn("forced", F.lit(False)).unionByName(_in_region(best).withColumn("forced", F.lit(True)))


def clip_polygons(polys: DataFrame, keys: Sequence[str], window: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """Polygons (array of (x, y) structs in ``poly``) clipped to their row's window: the largest part, and how many ``parts``
    there are. Rows without a part go."""
    out = with_part(polys, F.col("poly"), box_window(*map(F.col, window)))
    return out.where("_part.parts > 0").select(*keys, F.col("_part.ring").alias("poly"), F.col("_part.parts").alias("parts"))
