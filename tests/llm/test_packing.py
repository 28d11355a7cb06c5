import functools
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from gridloom.llm import packing
from gridloom.llm.vocab import public_path
from tests.llm.util import docs, odd_rows


def plain_best(at, price, length):
    prices = dict(zip(at, price, strict=True))

    @functools.cache
    def f(j):
        if j == 0:
            return 0
        best = 10**9
        for i in [0, *at]:
            if i < j and j - i <= length:
                n = j - i
                best = min(best, f(i) + (0 if n & (n - 1) == 0 else length - n) + prices[j])
        return best

    return f(at[-1])


def test_least_cost():
    rng = random.Random(4)
    for _ in range(60):
        at, j = [], 0
        for _ in range(rng.randint(1, 25)):
            j += rng.randint(1, 14)
            at.append(j)
        price = [rng.choice([0, 1, 5]) for _ in at]
        cuts, cost = packing.best_cuts(at, price, 16)
        assert cost == plain_best(tuple(at), tuple(price), 16)
        assert cuts[-1] == at[-1] and set(cuts) <= set(at) and all(b - a <= 16 for a, b in zip([0, *cuts], cuts, strict=False))


def test_every_sentence_end_is_a_possible_cut():
    ids = np.array([5, 9, 9, 5, 5, 9, 5, 2, 9, 2], np.int64)
    at, price = packing.possible_cuts(ids, np.array([8, 10]), np.array([9]))
    assert list(zip(at.tolist(), price.tolist(), strict=True)) == [(2, 8), (3, 8), (6, 8), (8, 0), (9, 8), (10, 0)]


def test_pieces(spark):
    rows = [*odd_rows(), *((50 + i, f"Some words here. And more of them {i}! " * (i * 7)) for i in range(30))]
    got = packing.pack(docs(spark, rows).coalesce(3), public_path("word_bpe_49k.json")).collect()
    plain = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    copies = {i: sum(r[0] == i for r in rows) for i, _ in rows}
    held = {i: [0] * len(v) for i, v in ids.items()}
    sequences = {}
    for r in got:
        v = ids[r["doc_id"]]
        part = v[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(v)
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        for k in range(r["start"], r["start"] + r["length"]):
            held[r["doc_id"]][k] += 1
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(set(h) == {copies[i]} for i, h in held.items())
    assert sorted(sequences) == list(range(len(sequences)))
    padding = tokens = 0
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096
        tokens += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding < 0.02 * tokens
    assert packing.pack(docs(spark, []), public_path("word_bpe_49k.json")).collect() == []
