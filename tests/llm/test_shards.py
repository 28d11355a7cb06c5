import math
import zlib
from collections import Counter

import pytest
import xxhash

from gridloom.llm import shards
from tests.llm.util import docs, odd_rows


def plain_place(key, tree):
    """The descent in plain Python."""
    key = "\0null" if key is None else str(key)

    def won(children):
        def draw(name, weight):
            h = xxhash.xxh64_intdigest(name.encode(), xxhash.xxh64_intdigest(key.encode(), 42))
            return -math.log(((h >> 11) + 0.5) / 2**53) / weight

        return min(range(len(children)), key=lambda i: (draw(*children[i][:2]), i))

    first, racks, leaves = tree.levels()
    a = won(first)
    b = won(racks[a])
    return leaves[a][b][won(leaves[a][b])][2]


def placed(spark, keys, *trees):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    return [tuple(r) for r in df.select("k", *(shards.place(df["k"], t).alias(f"t{i}") for i, t in enumerate(trees))).collect()]


def test_descent_equals_the_plain_one(spark):
    tree = shards.grown(shards.even(11, 2, 3), 2.5)
    for k, at in placed(spark, [None, *range(-5, 200)], tree):
        assert at == plain_place(k, tree)


def test_rows_follow_weights(spark):
    tree = shards.Tree(tuple(shards.Leaf(n, n // 4, n // 2 % 2, 1.0 + n % 3) for n in range(8)))
    n, total = Counter(at for _, at in placed(spark, range(30000), tree)), sum(leaf.weight for leaf in tree.leaves)
    for leaf in tree.leaves:
        share = leaf.weight / total
        assert abs(n[leaf.shard] / 30000 - share) < 5 * math.sqrt(share / 30000)


def test_one_more_shard_takes_rows_only_into_itself_at_every_count(spark):
    trees = [shards.even(7, 2, 2)]
    while len(trees) < 12:
        trees.append(shards.grown(trees[-1]))
    rows = placed(spark, range(4000), *trees)
    for i in range(1, len(trees)):
        moved = [(r[i], r[i + 1]) for r in rows if r[i] != r[i + 1]]
        assert {b for _, b in moved} == {6 + i}
        assert len({a for a, _ in moved}) == 6 + i  # from all others
        assert abs(len(moved) - 4000 / (7 + i)) < 5 * math.sqrt(4000 / (7 + i))


def test_movement_stays_in_the_subtrees_whose_weights_change(spark):
    a = shards.even(16, 2, 4)
    b = shards.Tree(tuple(shards.Leaf(x.shard, x.region, x.rack, 3.0 if x.shard == 5 else 1.0) for x in a.leaves))
    moved = [(p, q) for _, p, q in placed(spark, range(5000), a, b) if p != q]
    region = {x.shard: x.region for x in a.leaves}
    rack = {x.shard: (x.region, x.rack) for x in a.leaves}
    assert moved and all(region[q] == region[5] for _, q in moved)  # nothing enters a region whose weight stays
    inside = [(p, q) for p, q in moved if region[p] == region[5]]
    assert inside and all(rack[q] == rack[5] for _, q in inside)  # within the region only the changed rack takes rows
    assert all(q == 5 for p, q in inside if rack[p] == rack[5])


@pytest.mark.parametrize("leaves", [(), (shards.Leaf(0, 0, 0, 0.0),), (shards.Leaf(0, 0, 0), shards.Leaf(0, 1, 0))])
def test_trees_that_are_none(leaves):
    with pytest.raises(ValueError):
        shards.Tree(leaves)


def test_assignment(spark):
    rows = [*odd_rows(), *((7, "copy") for _ in range(400)), *((100 + i, f"text {i}") for i in range(600)), (None, "b"), (None, None)]
    tree = shards.even(40)
    got = shards.assignment(docs(spark, rows).repartition(5), tree).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", plain_place(i, tree), plain_place(i, shards.grown(tree))) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in held.values())
    again = shards.assignment(docs(spark, rows).coalesce(1), tree).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert shards.assignment(docs(spark, []), tree).collect() == []


def test_one_doc_id_for_all_rows_spreads_over_partitions(spark):
    df = spark.range(0, 20000, 1, 4).selectExpr("CAST(5 AS BIGINT) doc_id", "'same' text")
    got = shards.assignment(df, shards.even(40))
    assert [r.slot for r in got.orderBy("slot").select("slot").collect()] == list(range(20000))


def test_written_shards_hold_their_rows(spark, tmp_path):
    rows = [(i, f"t{i % 9}") for i in range(300)]
    shards.write_shards(docs(spark, rows), shards.even(6), str(tmp_path / "out"), per_file=20)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text, r.shard) for r in got.collect()) == sorted((i, t, plain_place(i, shards.even(6))) for i, t in rows)
