"""Label lines: parsing, writing, validation and audits. Bad lines become rows of an issues table, never silent losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAMES = ("cx", "cy", "w", "h")


def tokens(line: str | Column = "line") -> Column:
    return F.split(F.trim(F.col(line) if isinstance(line, str) else line), r"\s+")


def _number(token: Column) -> Column:
    return token.try_cast("double")


def rounded_class(token: Column) -> Column:
    """A class id from text such as 1 or 1.0; halves go to the even number."""
    return F.bround(_number(token)).try_cast("int")


def whole_class(token: Column) -> Column:
    """A class id from the text of a whole number; all other text is unreadable."""
    return F.when(token.rlike(r"^[+-]?[0-9]+$"), token.try_cast("int"))


def truncated_class(token: Column) -> Column:
    """A class id from the text of a number, its fraction cut off."""
    return _number(token).try_cast("int")


#: How readers take the first token of a line.
CLASS_RULES = {"rounded": rounded_class, "whole": whole_class, "truncated": truncated_class}


def with_tokens(lines: DataFrame, rule: str = "rounded") -> DataFrame:
    """Add tok, n and the parsed fields; blank lines go."""
    out = lines.withColumn("tok", tokens()).where(F.trim("line") != "").withColumn("n", F.size("tok"))
    fields = {name: _number(F.get("tok", F.lit(i + 1))) for i, name in enumerate(NAMES)}
    return out.withColumns({"cls": CLASS_RULES[rule](F.get("tok", F.lit(0))), **fields})


def parse_labels(lines: DataFrame, classes: Sequence[int] | None = None, least_tokens: int = 5, rule: str = "rounded", strict: bool = False) -> DataFrame:
    """Box rows from label lines; lines that do not parse are left out (``malformed`` has them).

    ``rule`` is one of ``CLASS_RULES``. With ``strict`` a line of enough tokens that does not parse ends the job with an error
    that names it; short lines are skipped either way. A polygon is read from lines of eleven tokens or more with an even rest.
    """
    good = with_tokens(lines, rule).where(F.col("n") >= least_tokens)
    fault = F.raise_error(F.concat(F.lit("unreadable label line of image "), F.coalesce(F.col("image_id").cast("string"), F.lit("null")), F.lit(": "), "line")).cast("boolean")
    good = good.where(F.when(_parsed(), True).otherwise(fault if strict else F.lit(False)))
    if classes is not None:
        good = good.where(F.col("cls").isin(*classes))
    rest = F.transform(F.slice("tok", 6, F.greatest(F.lit(0), F.col("n") - 5)), _number)
    pairs = F.transform(F.sequence(F.lit(0), ((F.col("n") - 7) / 2).cast("int")), lambda i: F.struct(F.get(rest, (i * 2).cast("int")).alias("x"), F.get(rest, (i * 2 + 1).cast("int")).alias("y")))
    poly = F.when((F.col("n") >= 11) & (F.col("n") % 2 == 1), pairs)
    return good.select("image_id", "line_no", "cls", *NAMES, poly.alias("poly"))


def _parsed() -> Column:
    ok = F.col("cls").isNotNull()
    for name in NAMES:
        ok = ok & F.col(name).isNotNull()
    return ok


def malformed(lines: DataFrame, least_tokens: int = 5) -> DataFrame:
    return with_tokens(lines).where((F.col("n") < least_tokens) | ~_parsed()).select("image_id", "line_no", "line")


def _issues(rows: DataFrame, found: list[Column], keys: Sequence[str]) -> DataFrame:
    """A row for each text of ``found`` that is not null."""
    return rows.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("issue"))


def _ranges() -> list[Column]:
    out = [F.when(~F.col(n).between(0.0, 1.0), F.lit(f"{n}_out_of_range")) for n in NAMES]
    return [*out, F.when((F.col("w") <= 0) | (F.col("h") <= 0), F.lit("non_positive_size"))]


def validate_detection(lines: DataFrame, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Issues of detection lines. A class that does not parse, a count other than five tokens and a box that does not parse
    each end a line's checks, in this order."""
    boxed = F.col("cx").isNotNull() & F.col("cy").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    stop = F.when(F.col("cls").isNull(), "class_unreadable").when(F.col("n") != 5, "token_count").when(~boxed, "box_unreadable")
    rows = with_tokens(lines).withColumn("stop", stop)
    more = [F.when(F.col("stop").isNull(), c) for c in (*_ranges(), F.when(~F.col("cls").isin(*classes), F.lit("class_not_allowed")))]
    return _issues(rows, [F.col("stop"), *more], ["image_id", "line_no"])


def validate_segmentation(lines: DataFrame) -> DataFrame:
    """Issues of segmentation lines: class 0 needs three polygon pairs or more, all others a box alone."""
    boxed = F.col("cx").isNotNull() & F.col("cy").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    stop = F.when(F.col("cls").isNull(), "class_unreadable").when(F.col("n") < 5, "token_count").when(~boxed, "box_unreadable")
    rows = with_tokens(lines).withColumn("stop", stop)
    rest = F.transform(F.slice("tok", 6, F.greatest(F.lit(0), F.col("n") - 5)), _number)
    rows = rows.withColumn("rest", rest)
    poly = F.when(F.col("cls") != 0, F.when(F.col("n") != 5, "tag_with_polygon")).when(F.col("n") - 5 < 6, "polygon_short").when((F.col("n") - 5) % 2 != 0, "polygon_odd")
    poly = poly.when(F.exists("rest", lambda v: v.isNull()), "polygon_unreadable").when(F.exists("rest", lambda v: ~v.between(0.0, 1.0)), "polygon_out_of_range")
    more = [F.when(F.col("stop").isNull(), c) for c in (*_ranges(), poly)]
    return _issues(rows, [F.col("stop"), *more], ["image_id", "line_no"])


def detect_format(lines: DataFrame) -> DataFrame:
    """segmentation if any line of the file has more than five tokens, else detection."""
    return with_tokens(lines).groupBy("image_id").agg(F.when(F.max("n") > 5, "segmentation").otherwise("detection").alias("format"))


def audit(lines: DataFrame, files: DataFrame, classes: Sequence[int] | None = (0, 1)) -> DataFrame:
    """Rows (image_id, line_no, issue) of the files in ``files``: an empty file is one, and lines count from 1 without blanks."""
    rows = with_tokens(lines).join(files.select("image_id"), "image_id", "left_semi").join(detect_format(lines), "image_id")
    rows = rows.withColumn("line_no", F.row_number().over(Window.partitionBy("image_id").orderBy("line_no")))
    plain = F.col("format") == "detection"
    stop = F.when(plain & (F.col("n") != 5), "tokens_not_5").when(~plain & (F.col("n") < 5), "too_few_tokens").when(~_parsed(), "parse_error")
    allowed = F.lit(True) if classes is None else F.col("cls").isin(*classes)
    rest = F.transform(F.slice("tok", 6, F.greatest(F.lit(0), F.col("n") - 5)), _number)
    rows = rows.withColumn("stop", stop).withColumn("rest", rest)
    poly = F.when(F.col("n") <= 5, F.lit(None)).when((F.col("n") - 5) % 2 != 0, "polygon_odd").when(F.exists("rest", lambda v: v.isNull()), "polygon_unreadable").when(F.exists("rest", lambda v: ~v.between(0.0, 1.0)), "polygon_out_of_range")
    more = [F.when(F.col("stop").isNull(), c) for c in (F.when(~allowed, F.lit("class_not_allowed")), *_ranges(), poly)]
    found = _issues(rows, [F.col("stop"), *more], ["image_id", "line_no"])
    empty = files.select("image_id").join(with_tokens(lines).select("image_id"), "image_id", "left_anti").select("image_id", F.lit(0).alias("line_no"), F.lit("empty_file").alias("issue"))
    return found.unionByName(empty)


def class_hist(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Lines by class: those that parse, whether or not they pass the range checks."""
    rows = with_tokens(lines).join(files.select("image_id"), "image_id", "left_semi").join(detect_format(lines), "image_id")
    fits = F.when(F.col("format") == "detection", F.col("n") == 5).otherwise(F.col("n") >= 5)
    return rows.where(fits & _parsed()).groupBy("cls").agg(F.count(F.lit(1)).alias("lines"))


def pairing(images: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (image_id, status): paired, missing_label or orphan_label."""
    a, b = images.select("image_id", F.lit(1).alias("a")), files.select("image_id", F.lit(1).alias("b"))
    status = F.when(F.col("b").isNull(), "missing_label").when(F.col("a").isNull(), "orphan_label").otherwise("paired")
    return a.join(b, "image_id", "full_outer").select("image_id", status.alias("status"))


def audit_stats(images: DataFrame, files: DataFrame, lines: DataFrame, classes: Sequence[int] | None = (0, 1)) -> DataFrame:
    """One row of totals over the files that pair with an image; ``lines`` counts all lines, bad ones too."""
    status = pairing(images, files)
    paired = status.where("status = 'paired'").select("image_id")
    issues = audit(lines, paired, classes).agg(F.count_distinct("image_id").alias("files_with_issues"), F.count(F.lit(1)).alias("issues"))
    counts = status.agg(F.count_if(F.col("status") != "orphan_label").alias("images"), *(F.count_if(F.col("status") == s).alias(s) for s in ("paired", "missing_label", "orphan_label")))
    total = with_tokens(lines).join(paired, "image_id", "left_semi").agg(F.count(F.lit(1)).alias("lines"))
    out = counts.crossJoin(F.broadcast(issues)).crossJoin(F.broadcast(total))  # one row each
    return out.withColumn("lines_per_image", F.when(F.col("paired") > 0, F.col("lines") / F.col("paired")).otherwise(0.0))


def audit_sample(issues: DataFrame, per_file: int, files: int) -> DataFrame:
    """The first issues of the first files."""
    nth = F.row_number().over(Window.partitionBy("image_id").orderBy("line_no", "issue"))
    first = issues.select("image_id").distinct().orderBy("image_id").limit(files)
    return issues.join(F.broadcast(first), "image_id", "left_semi").withColumn("nth", nth).where(F.col("nth") <= per_file)


def label_line(cls, *values) -> Column:
    """A label's text with six decimals; halves go to the even digit."""
    text = [F.format_string("%.6f", F.bround(F.col(v) if isinstance(v, str) else v, 6)) for v in values]
    return F.concat_ws(" ", F.col(cls).cast("string") if isinstance(cls, str) else cls, *text)


def label_text(labels: DataFrame, images: DataFrame, order: str) -> DataFrame:
    """One text for each image, a line for each label in the order of ``order``; images without labels have an empty text."""
    rows = labels.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["text"]), "\n")
    return images.select("image_id").join(rows, "image_id", "left").select("image_id", F.coalesce(text, F.lit("")).alias("text"))


def relabel(images: DataFrame, sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Labels (image_id, source, box_id) of each image from the first source, in the given order, that has any; images that no
    source knows come with nulls."""
    every = None
    for at, (name, df) in enumerate(sources):
        one = df.select("image_id", "box_id", F.lit(name).alias("source"), F.lit(at).alias("_at"))
        every = one if every is None else every.unionByName(one)
    first = every.groupBy("image_id").agg(F.min("_at").alias("_at"))
    return images.select("image_id").join(every.join(first, ["image_id", "_at"]), "image_id", "left").select("image_id", "source", "box_id")
