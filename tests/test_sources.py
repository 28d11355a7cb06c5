import pytest

from gridloom.operators import labels
from gridloom.sources import files, sinks
from gridloom.streaming.pending import ingest_stream


@pytest.fixture
def folder(tmp_path):
    where = tmp_path / "labels"
    where.mkdir()
    (where / "a.txt").write_text("0 0.5 0.5 0.1 0.1\n\n0 1.5 0.5 0.1 0.1\n")
    (where / "b.txt").write_text("")
    (where / "c.txt").write_text("1 0.2 0.2 0.1 0.1")
    return where


def test_label_files(spark, folder):
    assert {(r["stem"], r["size"] > 0) for r in files.label_inventory(spark, str(folder)).collect()} == {("a", True), ("b", False), ("c", True)}
    got = sorted(map(tuple, files.label_lines(spark, str(folder)).select("image_id", "line_no").collect()))
    assert got == [("a", 1), ("a", 3), ("c", 1)]


def test_stream_equals_batch_and_adds_nothing_twice(spark, folder, tmp_path):
    out = [str(tmp_path / n) for n in ("boxes", "issues", "checkpoint")]
    source = tmp_path / "pending"
    source.mkdir()
    (source / "a.txt").write_text((folder / "a.txt").read_text())
    for name in (None, "c.txt", None):
        if name:
            (source / name).write_text((folder / name).read_text())
        ingest_stream(spark, str(source), *out).awaitTermination()
    lines = files.label_lines(spark, str(folder))
    good = labels.parse_labels(lines).join(labels.validate_detection(lines).select("image_id", "line_no"), ["image_id", "line_no"], "left_anti")
    columns = ["image_id", "line_no", "cls", "cx"]
    assert sorted(map(tuple, spark.read.parquet(out[0]).select(*columns).collect())) == sorted(map(tuple, good.select(*columns).collect()))
    assert spark.read.parquet(out[1]).count() == labels.validate_detection(lines).count() == 1


def test_sinks_round_trip(spark, tmp_path):
    texts = spark.createDataFrame([(1, "0 0.5 0.5 0.1 0.1"), (2, "")], "image_id long, text string")
    sinks.write_label_text(texts, str(tmp_path / "text"))
    assert {r["image_id"] for r in spark.read.text(str(tmp_path / "text")).collect()} == {1, 2}
    one = spark.createDataFrame([("v", 3)], "gt_set string, total_gt long")
    for _ in range(2):
        sinks.append_summary(one, str(tmp_path / "summary"))
    back = spark.read.option("header", True).csv(str(tmp_path / "summary"))
    assert tuple(back.columns) == sinks.SUMMARY and back.count() == 2
    sinks.write_metrics(one, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 1


def test_manifest_and_score_hook(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"image": "a", "roi_image": "b", "roi_label": "c", "bbox": {"x0": 1, "y0": 2, "x1": 3, "y1": 4}}\n\n{"image": "a"}\n{"image": "d", "roi_image": "e", "roi_label": "f", "bbox": null}\n')
    assert files.manifest(spark, str(tmp_path / "m.jsonl")).count() == 2
    import pandas as pd

    def stub(frames):
        for f in frames:
            yield pd.DataFrame({"image_id": f["id"], "det_id": 0, "x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0, "score": 0.5, "cls": 0})

    assert files.score_images(spark.range(5), stub).count() == 5


def test_pixels_and_downscale_factor(spark, tmp_path):
    import struct

    # a bitmap of 3 x 2 pixels, rows from the bottom, bytes in the order B, G, R, rows padded to four bytes
    colours = [[(10 * x + y, 20 * x, 200 - y) for x in range(3)] for y in range(2)]
    rows = b"".join(b"".join(bytes(reversed(c)) for c in row) + bytes(3) for row in reversed(colours))
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(rows), 0, 0, 54, 40, 3, 2, 1, 24, 0, len(rows), 0, 0, 0, 0)
    (tmp_path / "a.bmp").write_bytes(head + rows)
    got = files.pixels(spark.read.format("image").load(str(tmp_path))).collect()
    assert {(r.x, r.y): (r.r, r.g, r.b) for r in got} == {(x, y): colours[y][x] for y in range(2) for x in range(3)}
    assert all(r.image_id.endswith("a.bmp") for r in got) and len(got) == 6
    sides = spark.createDataFrame([(4096, 100), (100, 8192), (2048, 2048), (1, 1)], "h int, w int")
    assert [r[0] for r in sides.select(files.downscale_factor(sides["h"], sides["w"], 2048)).collect()] == [0.5, 0.25, 1.0, 1.0]
