import os
import random
import time

import pytest

from gridloom.operators import keys
from gridloom.sources import folders
from gridloom.streaming import pairs


def test_listing_finds_empty_and_nested_files(spark, tmp_path):
    for d, n in (("", 3), ("a", 2), ("a/b/c", 4), ("z", 0)):
        (tmp_path / d).mkdir(parents=True, exist_ok=True)
        for i in range(n):
            (tmp_path / d / f"{d.replace('/', '_')}x{i}.txt").write_text("" if i == 0 else f"0 0.5 0.5 0.1 0.{i}\n\n  \n1 2\r\n")
    (tmp_path / "a" / "picture.JPG").write_text("p")
    (tmp_path / "noext").write_text("p")
    listed = folders.label_files(spark, str(tmp_path))
    assert {r.stem: r.size for r in listed.collect()} == {p.stem: p.stat().st_size for p in tmp_path.rglob("*.txt")}
    assert {r.stem for r in folders.label_files(spark, str(tmp_path), "jpg").collect()} == {"picture"}
    assert folders.label_files(spark, str(tmp_path), "").count() == 11
    lines = folders.numbered_lines(listed, 3).collect()
    assert {r.image_id for r in lines if r.line_no is None} == {p.stem for p in tmp_path.rglob("*.txt") if not p.stat().st_size}
    assert sorted((r.image_id, r.line_no, r.line) for r in lines if r.image_id == "a_b_cx2") == [("a_b_cx2", 1, "0 0.5 0.5 0.1 0.2"), ("a_b_cx2", 4, "1 2")]
    assert folders.label_files(spark, f"file://{tmp_path}/z").collect() == []


def test_many_files_are_listed_by_tasks(spark, tmp_path):
    for d in range(20):
        (tmp_path / f"d{d}").mkdir()
        for i in range(150):
            os.close(os.open(tmp_path / f"d{d}" / f"{d}_{i}.txt", os.O_CREAT))
    listed = folders.label_files(spark, str(tmp_path))
    assert listed.count() == 3000 and listed.rdd.getNumPartitions() == 21


def test_label_files_come_back(spark, tmp_path):
    out = str(tmp_path / "out")
    texts = spark.createDataFrame([(i, f"0 0.5 0.5 0.1 0.{i}" if i % 3 else None) for i in range(1, 200)] + [(7, "1 0.1 0.1 0.1 0.1")], "image_id long, text string").repartition(7)
    for _ in range(2):  # again: no doubles
        folders.write_label_files(texts, out)
        assert len(os.listdir(out)) == 199 and all(n.endswith(".txt") for n in os.listdir(out))
    assert open(f"{out}/7.txt").read() == "0 0.5 0.5 0.1 0.7\n1 0.1 0.1 0.1 0.1" and open(f"{out}/9.txt").read() == ""
    back = folders.numbered_lines(folders.label_files(spark, out))
    assert back.where("line_no IS NULL").count() == 66 and back.where("line_no IS NOT NULL").count() == 134
    folders.write_label_files(texts.limit(0), out, overwrite=False)
    assert len(os.listdir(out)) == 199
    with pytest.raises(Exception, match="no file can have the name"):
        folders.write_label_files(spark.createDataFrame([("a/b", "x"), ("ok", "y")], "image_id string, text string"), out, overwrite=False)
    assert len(os.listdir(out)) == 199  # a failed job leaves nothing


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_the_batch_in_any_order_of_arrival(spark, tmp_path, seed):
    rng = random.Random(seed)
    labels, images = tmp_path / "labels", tmp_path / "images"
    labels.mkdir()
    images.mkdir()
    files = [(labels, f"s{i}.txt") for i in range(12)] + [(images, f"s{i}.{e}") for i in range(14) for e in ("jpg", "jpeg", "png", "gif") if rng.random() < 0.4]
    rng.shuffle(files)
    rows = pairs.paired(pairs.arrivals(spark, str(labels)), pairs.arrivals(spark, str(images)), 14_000)
    query = rows.writeStream.format("memory").queryName(f"told{seed}").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for part in (files[::2], files[1::2]):
            for where, name in part:
                (where / name).write_text("x")
            time.sleep(4)
        until = time.time() + 60
        while spark.table(f"told{seed}").count() < 12 and time.time() < until:
            time.sleep(1)
        got = spark.table(f"told{seed}").collect()
    finally:
        query.stop()
    frame = spark.createDataFrame([(n.split(".")[0], n.split(".")[1]) for w, n in files if w == images], "stem string, ext string")
    stems = spark.createDataFrame([(f"s{i}",) for i in range(12)], "stem string")
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, keys.ingest(stems, frame, stems.limit(0)).select("stem", "ext", "status").collect()), key=str)
