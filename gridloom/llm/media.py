"""Media columns: baseline JPEG written and read in numpy, with DC-only luminance thumbnails and their hashes.

``encode`` stores a payload losslessly in grey baseline JPEG streams whose unit is the quantised coefficient: each 8 x 8
block holds 64 payload bytes. A byte becomes a coefficient of magnitude category 8 (128..255 as itself, 0..127 as the byte
minus 255), so its eight extra bits are the byte. One Huffman code of one bit is enough, and a restart marker after each
block makes every block a segment of its own. The payload's length is in a comment marker.

``decode`` reads any baseline stream of one or three components: it parses the markers (fill bytes, tables between scans,
sampling factors), removes the stuffing, cuts scans at restart markers and Huffman-decodes the segments of many streams side
by side, one symbol of each at a time. Scans may hold one component or several interleaved ones. Both directions work in
chunks, so that one long text needs a few bytes of memory a byte.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Payload or scan bytes that are coded or decoded side by side at most (a longer segment goes alone).
BATCH_BYTES = 1 << 21
MAX_SIDE = 8191  # blocks: a JPEG side has at most 65,535 samples

ZERO_PAYLOAD = bytes(64)

#: A marker that ends a scan: no stuffed byte and no restart.
_END_OF_SCAN = re.compile(rb"\xff+[\x01-\xcf\xd8-\xfe]")
#: Fill bytes before a restart marker.
_FILL = re.compile(rb"\xff+(?=\xff[\xd0-\xd7])")


def padded(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 payload, filled with zero bytes to a positive multiple of 64, and its length before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64) if raw else ZERO_PAYLOAD, len(raw)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(width: int, height: int, n: int) -> bytes:
    one_code = bytes([1] + [0] * 15) + b"\x08"
    return b"".join([
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
        _segment(0xFE, struct.pack(">Q", n)),
        _segment(0xDB, b"\0" + bytes([1] * 64)),
        _segment(0xC0, struct.pack(">BHHB", 8, height * 8, width * 8, 1) + b"\x01\x11\0"),
        _segment(0xC4, b"\0" + one_code + b"\x10" + one_code),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, b"\x01\x01\0\0\x3f\0"),
    ])


def _grid(blocks: int) -> tuple[int, int]:
    width = int(np.ceil(np.sqrt(blocks)))
    height = -(-blocks // width)
    if width > MAX_SIDE:
        raise ValueError(f"{blocks} blocks do not fit one JPEG stream")
    return width, height


def _coded(data: np.ndarray, block: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scan bytes of 64-byte blocks with these numbers, the end of the stream after the ``last`` ones, and where blocks end."""
    bits = np.zeros((len(data), 9), np.uint8)
    bits[:, 1:] = np.unpackbits(data[:, None], axis=1)
    marked = np.empty((len(block), 74), np.uint8)
    marked[:, :72], marked[:, 72], marked[:, 73] = np.packbits(bits.reshape(-1, 576), axis=1), 0xFF, 0xD0 + block % 8
    marked[last, 72:] = 0xFF, 0xD9  # in place of a restart
    stuffed = np.flatnonzero((marked[:, :72] == 0xFF).any(axis=1))
    at = np.flatnonzero((marked[stuffed, :72] == 0xFF).reshape(-1))
    at = stuffed[at // 72] * 74 + at % 72
    ends = np.arange(1, len(block) + 1) * 74
    return np.insert(marked.reshape(-1), at + 1, 0), ends + np.searchsorted(at, ends)


def _encode_long(payload: bytes) -> bytes:
    """The stream of one payload, coded chunk by chunk."""
    width, height = _grid(len(payload) // 64)
    parts, step = [_header(width, height, len(payload))], BATCH_BYTES // 64
    for at in range(0, width * height, step):
        block = np.arange(at, min(at + step, width * height))
        data = np.zeros(len(block) * 64, np.uint8)
        held = np.frombuffer(payload, np.uint8)[at * 64 : (at + step) * 64]
        data[: len(held)] = held
        parts.append(_coded(data, block, block == width * height - 1)[0].tobytes())
    return b"".join(parts)


def encode(payloads: list[bytes]) -> list[bytes]:
    """One JPEG stream for each payload (its length is a positive multiple of 64)."""
    if len(payloads) == 1 and len(payloads[0]) > BATCH_BYTES:
        return [_encode_long(payloads[0])]
    grids = [_grid(len(p) // 64) for p in payloads]
    rows = [w * h for w, h in grids]
    data = np.frombuffer(b"".join(p + bytes(64 * n - len(p)) for p, n in zip(payloads, rows, strict=True)), np.uint8)
    ends = np.cumsum(rows)
    block = np.arange(ends[-1]) - np.repeat(ends - rows, rows)
    flat, stops = _coded(data, block, ends - 1)
    body, stops = flat.tobytes(), stops[ends - 1]
    return [_header(w, h, len(p)) + body[a:b] for (w, h), p, a, b in zip(grids, payloads, [0, *stops[:-1]], stops, strict=True)]


@functools.lru_cache(64)
def _table(body: bytes) -> np.ndarray:
    """For each 16-bit prefix: the code's length in the high byte and its symbol in the low byte.

    Where there is no code the length is 0 and the symbol a run of 15 that soon leaves the block.
    """
    symbols = body[16:]
    table, code, k = np.full(65536, 0xFF, np.uint16), 0, 0
    for n, many in enumerate(body[:16], 1):
        for _ in range(many):
            table[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _frame(body: bytes) -> dict:
    """Size in pixels and the components: identifier, sampling factors, quantiser, and size in blocks and in padded units."""
    bits, height, width, many = struct.unpack(">BHHB", body[:6])
    if bits != 8 or many not in (1, 3) or not height or not width:
        raise ValueError("only streams of 8-bit samples, one or three components and a known height are read")
    parts = [{"id": i, "h": hv >> 4, "v": hv & 15, "quant_id": q} for i, hv, q in zip(*(iter(body[6 : 6 + 3 * many]),) * 3, strict=True)]
    most_h, most_v = max(p["h"] for p in parts), max(p["v"] for p in parts)
    for p in parts:
        p["width"], p["height"] = -(-width * p["h"] // (8 * most_h)), -(-height * p["v"] // (8 * most_v))
    units = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    return {"size": (width, height), "parts": parts, "units": units, "width": parts[0]["width"], "height": parts[0]["height"]}


def parse(stream: bytes) -> dict:
    """The markers of a baseline JPEG stream: size, components, comment, and the scans with their tables and bytes.

    A stream that is cut off, progressive, or has other than one or three components raises ValueError.
    """
    if stream[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG stream")
    found: dict = {"comment": b"", "parts": [], "scans": [], "rgb": None}
    huff: dict[int, bytes] = {}
    quant: dict[int, np.ndarray] = {}
    at, every = 2, 0
    while True:
        start = at
        while stream[at : at + 1] == b"\xff":  # fill bytes may come before any marker
            at += 1
        marker, size = int.from_bytes(stream[at : at + 1]), int.from_bytes(stream[at + 1 : at + 3], "big")
        if at == start or not marker:
            raise ValueError("no marker where one belongs")
        if marker == 0xD9:
            break
        body, at = stream[at + 3 : at + 1 + size], at + 1 + size
        if len(body) != size - 2:
            raise ValueError("the stream ends within its markers")
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15], body = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1"), body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]], body = body[1 : 17 + n], body[17 + n :]
        elif marker == 0xC0:
            found |= _frame(body)
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline stream")
        elif marker == 0xDD:
            every = int.from_bytes(body, "big")
        elif marker == 0xFE:
            found["comment"] = body
        elif marker == 0xE0 and body[:5] == b"JFIF\0":
            found["rgb"] = False
        elif marker == 0xEE and body[:5] == b"Adobe" and found["rgb"] is None:
            found["rgb"] = body[11] == 0
        elif marker == 0xDA:
            end = _END_OF_SCAN.search(stream, at)
            if not end:
                raise ValueError("the stream ends within a scan")
            ids, scan = [p["id"] for p in found["parts"]], {"parts": [], "pattern": [], "every": every, "data": memoryview(stream)[at : end.start()]}
            for nth, (i, tables) in enumerate(zip(body[1 : 1 + 2 * body[0] : 2], body[2 : 2 + 2 * body[0] : 2], strict=True)):
                part = found["parts"][ids.index(i)]
                part["quant"] = quant[part["quant_id"]]
                blocks = part["h"] * part["v"] if body[0] > 1 else 1
                scan["parts"].append(part)
                scan["pattern"] += [(nth, huff[tables >> 4], huff[16 | tables & 15])] * blocks
            (width, height), one = found["units"], scan["parts"][0]
            scan["units"] = width * height if body[0] > 1 else one["width"] * one["height"]
            found["scans"].append(scan)
            at = end.start()
    if not found["parts"] or any("quant" not in p for p in found["parts"]):
        raise ValueError("a component has no scan")
    if found["rgb"] is None:
        found["rgb"] = bytes(p["id"] for p in found["parts"]) == b"RGB"
    found["rgb"] &= len(found["parts"]) == 3
    return found


def _restarts(data: np.ndarray) -> np.ndarray:
    """Where restart markers begin."""
    found = [np.empty(0, np.int64)]
    for at in range(0, len(data) - 1, BATCH_BYTES):
        part = data[at : at + BATCH_BYTES + 1]
        found.append(at + np.flatnonzero((part[:-1] == 0xFF) & (part[1:] >= 0xD0) & (part[1:] <= 0xD7)))
    return np.concatenate(found)


def _decode_run(scan: np.ndarray, cuts: np.ndarray, left: np.ndarray, first: np.ndarray, pattern: list[tuple], out: np.ndarray) -> None:
    """Decode segments side by side: bytes with restart markers at ``cuts``, the number of blocks and the first row of each in ``out``."""
    keep = np.ones(len(scan), bool)
    keep[cuts], keep[cuts + 1] = False, False
    keep[np.flatnonzero((scan[:-1] == 0xFF) & (scan[1:] == 0)) + 1] = False
    before = np.concatenate([[0], np.cumsum(keep)])
    starts = before[np.concatenate([[0], cuts])]  # first byte of each segment once stuffing and markers are out
    data = np.concatenate([scan[keep], np.zeros(8, np.uint8)]).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    where, predicted = starts.astype(np.int64) * 8, np.zeros((1 + max(nth for nth, _, _ in pattern), len(left)), np.int32)

    def take(live: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next symbol of each live segment and the value of its extra bits."""
        pos = np.minimum(where[live], 8 * (len(window) - 4))
        got = table[(window[pos >> 3] >> (16 - (pos & 7)).astype(np.uint32)) & 0xFFFF]
        pos += got >> 8
        size = (got & 15).astype(np.uint32)
        extra = (window[pos >> 3] << (pos & 7).astype(np.uint32)) >> (31 - size) >> 1
        value = extra.astype(np.int32)
        value -= np.where(value < (1 << size) >> 1, (1 << size) - 1, 0).astype(np.int32)
        where[live] = pos + size
        return got & 0xFF, value

    for nth_block in range(int(left.max(initial=0))):
        part, dc, ac = pattern[nth_block % len(pattern)]
        live = np.flatnonzero(left > nth_block)
        symbol, value = take(live, _table(dc))
        if (symbol > 11).any():
            raise ValueError("a DC code is none of the baseline's")
        predicted[part, live] += value
        row, ac = first + nth_block, _table(ac)
        out[row[live], 0] = predicted[part, live]
        k = np.ones(len(left), np.int64)
        while len(live):
            symbol, value = take(live, ac)
            at = k[live] + (symbol >> 4)
            real = (symbol & 15) > 0
            if real.all():
                out[row[live], at] = value
            else:
                out[row[live[real]], at[real]] = value[real]
            k[live] = np.where(symbol == 0, 64, at + 1)  # 0: the rest of the block is zero; 0xF0: sixteen zeros
            if (done := k[live] >= 64).any():
                live = live[~done]


def _decode_alike(scans: list[dict]) -> list[np.ndarray]:
    """Coefficients (blocks in the scan's order x 64, zigzag) of scans that share their pattern of components and tables."""
    pattern = scans[0]["pattern"]
    units = np.array([p["units"] for p in scans])
    every = np.array([p["every"] or n for p, n in zip(scans, units, strict=True)])
    joined = b"\xff\xd0".join(p["data"] for p in scans)
    if b"\xff\xff" in joined:
        joined = _FILL.sub(b"", joined)
    data = np.frombuffer(joined, np.uint8)
    cuts = _restarts(data)
    segments = -(-units // every)
    if len(cuts) + 1 != segments.sum():
        raise ValueError("restart markers do not fit the interval")
    owner = np.repeat(np.arange(len(scans)), segments)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(segments) - segments, segments)
    left = np.minimum(every[owner], units[owner] - nth * every[owner]) * len(pattern)  # blocks of each segment
    first = ((np.cumsum(units) - units)[owner] + nth * every[owner]) * len(pattern)
    out = np.zeros((units.sum() * len(pattern), 64), np.int16)
    begins, ends = np.concatenate([[0], cuts + 2]), np.concatenate([cuts, [len(data)]])
    a = 0
    while a < len(owner):
        b = max(a + 1, int(np.searchsorted(ends, begins[a] + BATCH_BYTES)))
        try:
            _decode_run(data[begins[a] : ends[b - 1]], cuts[a : b - 1] - begins[a], left[a:b], first[a:b], pattern, out)
        except IndexError:
            raise ValueError("a scan has codes that its tables do not hold, or blocks of more than 64 coefficients") from None
        a = b
    return np.split(out, (np.cumsum(units) * len(pattern))[:-1])


def _place(image: dict, scan: dict, rows: np.ndarray) -> None:
    """Give the components of a scan their coefficients: (height, width, 64) without the blocks that pad the last units."""
    if len(scan["parts"]) == 1:
        part = scan["parts"][0]
        part["coefficients"] = rows.reshape(part["height"], part["width"], 64)
        return
    (across, down), at = image["units"], 0
    rows = rows.reshape(down, across, -1, 64)
    for part in scan["parts"]:
        h, v = part["h"], part["v"]
        mine = rows[:, :, at : at + h * v].reshape(down, across, v, h, 64).transpose(0, 2, 1, 3, 4).reshape(down * v, across * h, 64)
        part["coefficients"] = mine[: part["height"], : part["width"]]
        at += h * v


def decode(streams: list[bytes]) -> list[dict]:
    """Each stream's markers and components; ``coefficients`` are the blocks of the first component, row by row."""
    images = [parse(s) for s in streams]
    alike: dict[tuple, list[tuple[dict, dict]]] = {}
    for p in images:
        for scan in p["scans"]:
            alike.setdefault(tuple(scan["pattern"]), []).append((p, scan))
    for group in alike.values():
        for (p, scan), rows in zip(group, _decode_alike([scan for _, scan in group]), strict=True):
            _place(p, scan, rows)
    for p in images:
        p["coefficients"] = p["parts"][0]["coefficients"].reshape(-1, 64)
    return images


def payload_of(image: dict) -> bytes:
    """The payload that ``encode`` stored."""
    v = image["coefficients"].reshape(-1)
    data = (v + (v < 0) * np.int16(255)).astype(np.uint8)
    return data[: int.from_bytes(image["comment"], "big")].tobytes()


def thumbnail(image: dict) -> np.ndarray:
    """Luminance from the DC coefficients alone, one sample for each block: of the first component, or of red, green and blue."""
    shown = image["parts"] if image["rgb"] else image["parts"][:1]
    planes = [p["coefficients"][:, :, 0].astype(np.float64) * int(p["quant"][0]) / 8 + 128 for p in shown]
    if image["rgb"]:
        high, wide = (max(p.shape[k] for p in planes) for k in (0, 1))
        planes = [p[np.ix_(np.arange(high) * p.shape[0] // high, np.arange(wide) * p.shape[1] // wide)] for p in planes]
        # fixed values: the luminance of ITU-R BT.601
        planes = [0.299 * planes[0] + 0.587 * planes[1] + 0.114 * planes[2]]
    return np.clip(np.rint(planes[0]), 0, 255).astype(np.uint8)


def thumbnail_hash(thumb: np.ndarray) -> str:
    """Average hash: the thumbnail at 8 x 8 (nearest sample), a bit for each sample above their mean."""
    at = [np.arange(8) * n // 8 for n in thumb.shape]
    small = thumb[np.ix_(*at)].astype(np.float64)
    return np.packbits(small > small.mean()).tobytes().hex()


def _batches(values: list, size) -> Iterator[list]:
    part, total = [], 0
    for v in values:
        if part and total + size(v) > BATCH_BYTES:
            yield part
            part, total = [], 0
        part.append(v)
        total += size(v)
    if part:
        yield part


def with_media(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, media): each whole text as a grey baseline JPEG stream. Null texts count as empty.

    An empty text is one block of zero bytes. Rows are independent: repeated rows and null doc_ids are kept as they are, and
    other columns of ``docs`` are not read. A text of over 4 GB does not fit a JPEG stream and raises ValueError.
    """

    def run(batches):
        for b in batches:
            at = 0
            for part in _batches(b["text"].to_pylist(), lambda t: len(t or "") + 256):
                pairs = [padded(t) for t in part]
                media = encode([p for p, _ in pairs])
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(at, len(part)), pa.array([n for _, n in pairs], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                at += len(part)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Read the streams of ``with_media`` back: digests of payload and stream, dimensions and thumbnail hash."""
    names = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]

    def run(batches):
        for b in batches:
            at = 0
            for part in _batches(b["media"].to_pylist(), len):
                rows = []
                for stream, image in zip(part, decode(part), strict=True):
                    payload, thumb = payload_of(image), thumbnail(image)
                    width, height = image["size"]
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), f"{width}x{height}:{thumbnail_hash(thumb)}", width, height))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(at, len(part)), b["n_bytes"].slice(at, len(part)), *columns], ["doc_id", "n_bytes", *(x.split()[0] for x in names.split(", "))])
                at += len(part)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, {names}")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(with_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op2_media": op2_media}
ORACLE_SQL: dict[str, str] = {}
