import hashlib
import tracemalloc
import zlib

import numpy as np
import pytest

from gridloom.llm import media
from tests.llm.util import docs, odd_rows


def test_payloads_survive():
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes() for n in (1, 2, 3, 9, 10, 65, 200)] + [bytes(64), b"\xff" * 640, b"\x7f\x80" * 32]
    streams = media.encode(payloads)
    assert [media.payload_of(p) for p in media.decode(streams)] == payloads
    assert [media.payload_of(media.decode([s])[0]) for s in streams] == payloads


def test_equal_texts_do_not_depend_on_their_batch():
    a, b = media.padded("some text")[0], media.padded("other " * 100)[0]
    assert media.encode([a, b])[0] == media.encode([b, a])[1] == media.encode([a])[0]


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, n):
        self.text += format(value, f"0{n}b") if n else ""

    def bytes(self):
        full = self.text + "1" * (-len(self.text) % 8)
        return bytes(int(full[i : i + 8], 2) for i in range(0, len(full), 8)).replace(b"\xff", b"\xff\x00")


def codes(symbols):
    n = max(1, (len(symbols)).bit_length())
    return {s: (i, n) for i, s in enumerate(symbols)}, bytes([0] * (n - 1) + [len(symbols)] + [0] * (16 - n)) + symbols


DC, DC_BODY = codes(bytes(range(12)))
AC, AC_BODY = codes(bytes([0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 9))]))


def put_block(bits, block, last):
    """A block's codes, one after the other; its predecessor had the DC coefficient ``last``."""

    def extra(v):
        size = abs(v).bit_length()
        bits.put(v if v >= 0 else v + (1 << size) - 1, size)

    bits.put(*DC[abs(block[0] - last).bit_length()])
    extra(block[0] - last)
    run = 0
    top = max([i for i in range(64) if block[i]], default=0)
    for v in block[1 : top + 1]:
        if not v:
            run += 1
            continue
        for _ in range(run // 16):
            bits.put(*AC[0xF0])
        bits.put(*AC[run % 16 << 4 | abs(v).bit_length()])
        extra(v)
        run = 0
    if top < 63:
        bits.put(*AC[0])


def write_scan(units, every, fill=b""):
    """Units are lists of (component, block); ``fill`` bytes come before each restart marker."""
    scan, bits, last = b"", Bits(), {}
    for at, unit in enumerate(units):
        if every and at and at % every == 0:
            scan += bits.bytes() + fill + bytes([0xFF, 0xD0 + (at // every - 1) % 8])
            bits, last = Bits(), {}
        for part, block in unit:
            put_block(bits, block, last.get(part, 0))
            last[part] = block[0]
    return scan + bits.bytes()


def write_jpeg(size, parts, every=0, scans=None, fill=b"", extra=b""):
    """A plain bit-by-bit writer: parts are (id, h, v, quantiser, rows of blocks), scans the indices of components in each."""
    seg, (width, height) = media._segment, size
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(parts)])
    out = b"\xff\xd8" + extra
    for nth, (i, h, v, quant, _) in enumerate(parts):
        frame += bytes([i, h << 4 | v, nth])
        out += fill + seg(0xDB, bytes([nth, *quant]))
    out += fill + seg(0xC0, frame) + seg(0xC4, b"\0" + DC_BODY) + fill + seg(0xC4, b"\x10" + AC_BODY) + (seg(0xDD, every.to_bytes(2, "big")) if every else b"")
    for scan in scans or [list(range(len(parts)))]:
        if len(scan) == 1:
            units = [[(scan[0], b)] for row in parts[scan[0]][4] for b in row]
        else:
            units = []
            for y in range(-(-height // (8 * most_v))):
                for x in range(-(-width // (8 * most_h))):
                    unit = []
                    for k in scan:
                        _, h, v, _, grid = parts[k]
                        for dy in range(v):
                            for dx in range(h):
                                row = grid[min(y * v + dy, len(grid) - 1)]
                                unit.append((k, row[min(x * h + dx, len(row) - 1)]))
                    units.append(unit)
        out += fill + seg(0xDA, bytes([len(scan)]) + b"".join(bytes([parts[k][0], 0]) for k in scan) + b"\0\x3f\0") + write_scan(units, every, fill)
    return out + fill + b"\xff\xd9"


def some_blocks(rng, width, height):
    rows = []
    for _ in range(height):
        row = []
        for _ in range(width):
            b = np.zeros(64, int)
            b[0] = rng.integers(-500, 500)
            for at in (1, 2, 5, 22, 40, 41, 58, 63)[: rng.integers(0, 9)]:
                b[at] = rng.integers(-200, 200)
            row.append(b.tolist())
        rows.append(row)
    return rows


def light(grid, quant):
    return [[b[0] * int(quant[0]) / 8 + 128 for b in row] for row in grid]


def shown(rows):
    return [[min(255, max(0, round(v))) for v in row] for row in rows]


def test_general_baseline_streams():
    rng = np.random.default_rng(3)
    for width, height, every in ((3, 2, 0), (4, 5, 3), (2, 2, 1), (5, 5, 7)):
        grid, quant = some_blocks(rng, width, height), [int(rng.integers(1, 20)) for _ in range(64)]
        stream = write_jpeg((width * 8 - 3, height * 8), [(1, 1, 1, quant, grid)], every)
        image = media.decode([stream])[0]
        assert image["size"] == (width * 8 - 3, height * 8)
        assert image["coefficients"].tolist() == [b for row in grid for b in row]
        assert media.thumbnail(image).tolist() == shown(light(grid, quant))


def colour(rng, size, factors, ids=(1, 2, 3)):
    most_h, most_v = max(h for h, _ in factors), max(v for _, v in factors)
    return [(i, h, v, [int(rng.integers(1, 20)) for _ in range(64)], some_blocks(rng, -(-size[0] * h // (8 * most_h)), -(-size[1] * v // (8 * most_v)))) for i, (h, v) in zip(ids, factors, strict=True)]


def test_colour_streams_of_one_and_of_several_scans():
    rng = np.random.default_rng(5)
    streams, wants = [], []
    for size in ((33, 17), (16, 16), (7, 40), (1, 1)):
        for factors in ([(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 2)], [(4, 1), (1, 1), (2, 1)]):
            for scans, every, fill in ((None, 0, b""), (None, 2, b"\xff\xff"), ([[0], [1], [2]], 3, b""), ([[0], [1, 2]], 1, b"\xff")):
                parts = colour(rng, size, factors)
                streams.append(write_jpeg(size, parts, every, scans, fill))
                wants.append((size, parts))
    for image, (size, parts) in zip(media.decode(streams), wants, strict=True):
        assert image["size"] == size and not image["rgb"]
        assert [p["coefficients"].tolist() for p in image["parts"]] == [p[4] for p in parts]
        assert media.thumbnail(image).tolist() == shown(light(parts[0][4], parts[0][3]))


def test_luminance_of_red_green_and_blue():
    rng = np.random.default_rng(7)
    adobe = media._segment(0xEE, b"Adobe\0\x64\0\0\0\0\0")
    for ids, extra in (((1, 2, 3), adobe), (tuple(b"RGB"), b"")):
        parts = colour(rng, (20, 11), [(1, 1)] * 3, ids)
        image = media.decode([write_jpeg((20, 11), parts, extra=extra)])[0]
        r, g, b = (light(p[4], p[3]) for p in parts)
        assert image["rgb"]
        assert media.thumbnail(image).tolist() == shown([[0.299 * x + 0.587 * y + 0.114 * z for x, y, z in zip(*rows, strict=True)] for rows in zip(r, g, b, strict=True)])


def test_streams_that_cannot_be_read_raise():
    rng = np.random.default_rng(9)
    whole = write_jpeg((24, 24), colour(rng, (24, 24), [(2, 2), (1, 1), (1, 1)]), 1)
    progressive = whole.replace(b"\xff\xc0", b"\xff\xc2")
    no_restart = whole.replace(b"\xff\xd0", b"", 1)
    for bad in (b"", b"text", whole[:-2], whole[:40], whole[:200], progressive, no_restart):
        with pytest.raises(ValueError):
            media.decode([bad])


def test_long_payloads_in_chunks_of_bounded_memory():
    rng = np.random.default_rng(11)
    payload = rng.integers(0, 256, 6 * media.BATCH_BYTES + 64, dtype=np.uint8).tobytes()
    short = payload[: media.BATCH_BYTES - 64]
    assert media._encode_long(short) == media.encode([short])[0]
    tracemalloc.start()
    stream = media.encode([payload])[0]
    image = media.decode([stream])[0]
    assert media.payload_of(image) == payload
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # some 30 times a chunk, and a few copies of the payload
    assert peak < 60 * media.BATCH_BYTES + 8 * len(payload)


def test_query_columns(spark):
    rows = odd_rows()
    got = media.media_features(media.with_media(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        want[i] = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert all((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == want[r["doc_id"]] for r in got)
    again = media.with_media(docs(spark, rows)).collect()
    by = {r["doc_id"]: r for r in got}
    assert all(hashlib.sha256(r["media"]).hexdigest() == by[r["doc_id"]]["media_sha256"] and len(r["media"]) == by[r["doc_id"]]["media_bytes"] for r in again)
    assert media.media_features(media.with_media(docs(spark, []))).collect() == []
