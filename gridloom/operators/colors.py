"""Colour histograms, dominant colours, colour masks and the regions they give, over tables of pixels (image_id, x, y, r, g, b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RGB = ("r", "g", "b")


def to_hex(r="r", g="g", b="b") -> Column:
    return F.format_string("#%02X%02X%02X", *(F.col(c).cast("int") if isinstance(c, str) else c for c in (r, g, b)))


def to_text(r="r", g="g", b="b") -> Column:
    return F.concat(F.lit("("), F.concat_ws(",", *(F.col(c).cast("int").cast("string") for c in (r, g, b))), F.lit(")"))


def from_text(text) -> Column:
    """A struct (r, g, b) from text such as ``(173, 173, 173)``; null where it is not three whole numbers."""
    parts = F.filter(F.split(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"[()\s]", ""), ","), lambda p: p != "")
    return F.when(F.size(parts) == 3, F.struct(*(F.get(parts, F.lit(i)).try_cast("int").alias(c) for i, c in enumerate(RGB))))


def quantised(c: str, q: int) -> Column:
    q = max(1, q)
    return (F.floor(F.col(c) / q) * q).alias(c)


def luma(r="r", g="g", b="b") -> Column:
    """BT.601."""
    return 0.299 * F.col(r) + 0.587 * F.col(g) + 0.114 * F.col(b)


def near_neutral(tol: int, low: int, high: int) -> Column:
    return (F.abs(F.col("r") - F.col("g")) <= tol) & (F.abs(F.col("r") - F.col("b")) <= tol) & F.col("r").between(low, high)


def color_hist(pixels: DataFrame, quantise: int = 1, ignore_bg: int = 0) -> DataFrame:
    """Pixels of each colour of each image; colours whose channels all reach ``ignore_bg`` count as white."""
    if ignore_bg > 0:
        bright = (F.col("r") >= ignore_bg) & (F.col("g") >= ignore_bg) & (F.col("b") >= ignore_bg)
        pixels = pixels.select("image_id", *(F.when(bright, 255).otherwise(F.col(c)).alias(c) for c in RGB))
    return pixels.select("image_id", *(quantised(c, quantise) for c in RGB)).groupBy("image_id", *RGB).agg(F.count(F.lit(1)).alias("pixels"))


def top_colors(hist: DataFrame, n: int, gray_only: bool = True, tol: int = 8, low: int = 0, high: int = 255) -> DataFrame:
    """Rows (image_id, rank, r, g, b, pixels, total_pixels): the most frequent colours; ties by r, g, b. Shares are of all pixels."""
    total = hist.groupBy("image_id").agg(F.sum("pixels").alias("total_pixels"))
    kept = hist.where(near_neutral(tol, low, high)) if gray_only else hist
    nth = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("pixels"), *RGB))
    return kept.withColumn("rank", nth).where(F.col("rank") <= n).join(total, "image_id").select("image_id", "rank", *RGB, "pixels", "total_pixels")


def top_colors_wide(top: DataFrame, n: int) -> DataFrame:
    """One row for each image: total_pixels, then text, hex and percentage of each colour."""
    cells = []
    for i in range(1, n + 1):
        at = F.col("rank") == i
        cells += [F.max(F.when(at, to_text())).alias(f"color{i}_rgb"), F.max(F.when(at, to_hex())).alias(f"color{i}_hex"), F.max(F.when(at, F.col("pixels") * 100.0 / F.col("total_pixels"))).alias(f"color{i}_pct")]
    return top.groupBy("image_id").agg(F.max("total_pixels").alias("total_pixels"), *cells)


def hsv() -> dict[str, Column]:
    """Hue (0 to 179), saturation and value (0 to 255) of 8-bit r, g, b, in the fixed-point arithmetic usual for 8-bit images."""
    r, g, b = (F.col(c).cast("long") for c in RGB)
    v = F.greatest(r, g, b)
    d = v - F.least(r, g, b)

    def scaled(n, top, by):  # n x round(top x 4096 / by) / 4096, rounded
        return F.when(by == 0, 0).otherwise(F.floor((n * F.bround(F.try_divide(F.lit(top * 4096.0), by)) + 2048) / 4096)).cast("long")

    h = scaled(F.when(v == r, g - b).when(v == g, b - r + 2 * d).otherwise(r - g + 4 * d), 30, d)
    return {"h": F.when(h < 0, h + 180).otherwise(h), "s": scaled(d, 255, v), "v": v}


def color_mask(pixels: DataFrame, palette: DataFrame, tol: int, pad: int = 0, pad_gray_only: bool = True, gray_chroma: int = 8, two_of_three: bool = False, black_cutoff: int = 0, most_sat: int | None = None, hue: tuple[int, int] | None = None, value: tuple[int, int] | None = None) -> DataFrame:
    """Pixels within ``tol`` of a colour of their image's ``palette`` (image_id, r, g, b) on all channels, or on two of three.

    ``pad`` is added once to the tolerance, for near-gray colours only unless told otherwise. Pixels darker than
    ``black_cutoff`` go, and those beyond a greatest saturation or outside a range of hue or value, both ends included.
    """
    p, c = pixels.alias("p"), palette.select("image_id", *(F.col(x).alias(f"c{x}") for x in RGB)).alias("c")
    chroma = F.greatest(F.abs(F.col("cr") - F.col("cg")), F.abs(F.col("cg") - F.col("cb")), F.abs(F.col("cb") - F.col("cr")))
    reach = F.lit(tol) + (F.when(chroma <= gray_chroma, pad).otherwise(0) if pad_gray_only else F.lit(pad))
    hits = [(F.abs(F.col(f"p.{x}") - F.col(f"c{x}")) <= F.least(F.lit(255), reach)).cast("int") for x in RGB]
    near = (F.col("p.image_id") == F.col("c.image_id")) & (hits[0] + hits[1] + hits[2] >= (2 if two_of_three else 3))
    out = p.join(c, near, "left_semi")
    if most_sat is not None:
        out = out.where(hsv()["s"] <= most_sat)
    for name, limits in (("h", hue), ("v", value)):
        out = out.where(hsv()[name].between(*limits)) if limits else out
    return out.where(luma() >= black_cutoff) if black_cutoff > 0 else out


def mask_roi(mask: DataFrame, pixels: DataFrame, scale: float, pad: float, width: int, height: int) -> DataFrame:
    """Coverage and the box of each image's mask in full-size pixels; images without a masked pixel have no box.

    ``scale`` is that of the table's pixels against the full image of ``width`` x ``height``; ``pad`` is a share of the sides.
    """
    places = pixels.select("image_id", "x", "y").distinct().groupBy("image_id").agg(F.count(F.lit(1)).alias("places"))
    found = mask.select("image_id", "x", "y").distinct().groupBy("image_id").agg(F.count(F.lit(1)).alias("masked"), *(f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("a", F.min), ("b", F.max))))
    out = places.join(found, "image_id", "left").fillna(0, ["masked"]).withColumn("coverage", F.col("masked") / F.col("places"))
    inverse = 1.0 / scale if scale > 0 else 1.0
    for c, side in (("x", width), ("y", height)):
        out = out.withColumns({f"{c}0": F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor(F.col(f"a{c}") * inverse))), f"{c}1": F.greatest(F.lit(0), F.least(F.lit(side - 1), F.ceil(F.col(f"b{c}") * inverse)))})
        more = F.bround((F.col(f"{c}1") - F.col(f"{c}0") + 1) * F.lit(pad)).cast("long")
        out = out.withColumn("_more", more).withColumns({f"{c}0": F.when(F.col("masked") > 0, F.greatest(F.lit(0), F.col(f"{c}0") - F.col("_more"))), f"{c}1": F.when(F.col("masked") > 0, F.least(F.lit(side - 1), F.col(f"{c}1") + F.col("_more")))}).drop("_more")
    return out.select("image_id", "masked", "coverage", "x0", "y0", "x1", "y1")


def manifest_stats(rois: DataFrame, boxes: DataFrame, kept: DataFrame) -> DataFrame:
    """Source and kept boxes of each region, with a note where all were lost."""
    src, dst = (df.groupBy("image_id").agg(F.count(F.lit(1)).alias(n)) for df, n in ((boxes, "src_box_count"), (kept, "kept_box_count")))
    out = rois.join(src, "image_id", "left").join(dst, "image_id", "left").fillna(0, ["src_box_count", "kept_box_count"])
    return out.withColumn("remap_note", F.when((F.col("src_box_count") > 0) & (F.col("kept_box_count") == 0), "all boxes lost"))
