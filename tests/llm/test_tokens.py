import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import tokens
from gridloom.llm.scratch import new_path
from gridloom.llm.vocab import PieceEncoder, public_path
from tests.llm.util import docs, odd_rows

NAMES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
ODD = ["a  b", " a", "a ", "x\n y", "q \n r s\tt u<|endoftext|> v", "don't 's I'll", "", "ﬁ Ⅷ ́ a ́b é", "a\u00a0b\u2003c", "日本 語。 x", "İI ΣΑΣ Σ", "\x1c a\x1c b", "x_y a_ w%%% v&&&. The|x <y z< f!!??", "a.\nB c.\n\nD", "A.\r\nB", "ĲŉÞß ſ"]


@pytest.fixture(scope="module", params=NAMES)
def coder(request):
    return PieceEncoder(public_path(request.param[0]), request.param[1], "<u2")


def test_pieces_equal_the_library(coder):
    for t in ODD + ODD:
        assert coder.encode(t) == coder.whole(t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["the", "Word,", "a", "x.\ny", "é", "!!", "<|endoftext|>"])), max_size=12))
def test_pieces_equal_the_library_on_any_text(coder, parts):
    t = " ".join(parts)
    t = t.encode("utf-8", "ignore").decode()
    assert coder.encode(t) == coder.whole(t)


def test_shard_round_trip_and_lookup():
    rng = np.random.default_rng(0)
    rows = sorted((int(i), rng.integers(0, 50000, rng.integers(0, 400)).astype("<u2").tobytes()) for i in [*rng.integers(-(2**40), 2**40, 3000), 5, 5, 5, -1, 0])
    out = io.BytesIO()
    writer = tokens.ShardWriter(out, 2)
    for i, v in rows:
        writer.add(i, v)
    writer.close()
    reader = tokens.ShardReader(io.BytesIO(out.getvalue()))
    assert list(reader) == rows
    assert len(reader.index) > 3
    by = {}
    for i, v in rows:
        by.setdefault(i, []).append(v)
    for i in [*list(by)[:200], 5, -1]:
        assert reader.lookup(i) == by[i]
    missing = [i for i in range(10**13, 10**13 + 500)]
    assert all(reader.lookup(i) == [] for i in missing)
    assert sum(reader.may_hold(i) for i in missing) < 30


def test_query_equals_plain_encoding(spark):
    rows = [r for r in odd_rows() if r[0] is not None] + [(100 - i, t) for i, t in enumerate(ODD)]
    manifest = tokens.write_shards(docs(spark, [*rows, (None, "no key")]), new_path(spark, "t"), public_path("byte_bpe_50k.json"))
    got = sorted(map(tuple, tokens.token_spans(manifest).collect()))
    plain = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    empty = tokens.write_shards(docs(spark, []), new_path(spark, "t"), public_path("byte_bpe_50k.json"))
    assert tokens.token_spans(empty).collect() == []


def test_schemes_of_spark_and_arrow():
    assert tokens.arrow_uri("s3a://b/x/y.sst") == "s3://b/x/y.sst" and tokens.arrow_uri("file:///tmp/x") == "file:///tmp/x" and tokens.arrow_uri("/tmp/x") == "/tmp/x"
