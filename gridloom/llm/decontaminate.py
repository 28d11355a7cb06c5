"""Benchmark decontamination: pigeonhole pieces found exactly, then Myers' bit-parallel distance.

Documents and test items are compared as runs of lower-case letters and digits with single spaces between them. An item of n
characters may occur with up to ``floor(rate * n)`` edits. Cut into one piece more than that, at least one piece occurs
unchanged in any such occurrence, so an automaton over all pieces finds each place worth a look. The pieces of an item are
the leaves of a binary tree. As a stretch of L pieces may have L - 1 edits, and one half of a stretch within its budget is
within its own, an occurrence has a piece all of whose ancestors are within theirs: from a hit the stretches are tried from
small to large, by Myers' distance on whole-integer bit vectors, and most false hits end at the first one.

Items so short that their budget is no edit are searched exactly and as whole words.

The test items are the query set. They are taken in blocks of ``BLOCK_CHARS`` characters, each of which is sent to the tasks. The
result of a block is written before the next but one is drawn, so a benchmark of any size is searched with bounded memory;
documents are read once for each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.scratch import cut

RATE = 0.1
BLOCK_CHARS = 8_000_000

_other = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    """Lower-case letters and digits of a text, single spaces between the runs."""
    return _other.sub(" ", (text or "").lower()).strip()


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """(offset, piece) of the error budget plus one pieces of an item."""
    n = int(rate * len(item)) + 1
    edges = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def bit_places(item: str) -> dict[str, int]:
    """For each character the bits of its places in an item."""
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    return where


def myers(item: str, text: str, where: dict[str, int] | None = None) -> tuple[int, int]:
    """The least edit distance of ``item`` to a stretch of ``text``, and where the first such stretch ends."""
    m, where = len(item), where or bit_places(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        same = where.get(c, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | ~(across | up) & full, up & across
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = (fall | ~(vertical | rise)) & full, rise & vertical
        if score < best:
            best, end = score, at
            if not score:
                break
    return best, end


class Item:
    """A test item with its tree of pieces."""

    def __init__(self, item_id: int, text: str, rate: float):
        self.item_id, self.text, self.behind = item_id, text, 0
        if not int(rate * len(text)):
            self.text, self.behind = f" {text} ", 1
        self.pieces = [(0, self.text)] if self.behind else pieces(text, rate)
        self.budget = len(self.pieces) - 1
        self.places: dict[tuple[int, int], dict[str, int]] = {}

    def above(self, leaf: int) -> list[tuple[int, int]]:
        """The stretches of pieces that hold a leaf, from the smallest of two pieces up to the whole item."""
        low, high, path = 0, len(self.pieces), []
        while high - low > 1:
            path.append((low, high))
            mid = (low + high) // 2
            low, high = (low, mid) if leaf < mid else (mid, high)
        return path[::-1] or [(0, len(self.pieces))]

    def distance(self, low: int, high: int, text: str, start: int) -> tuple[int, int]:
        """Edits of pieces low..high at their place in the text, the item starting about ``start``, and their end."""
        a = self.pieces[low][0]
        b = self.pieces[high][0] if high < len(self.pieces) else len(self.text)
        slack = high - low - 1
        if (low, high) not in self.places:
            self.places[low, high] = bit_places(self.text[a:b])
        at = max(0, start + a - slack)
        edits, end = myers(self.text[a:b], text[at : max(0, start + b + slack)], self.places[low, high])
        return edits, at + end


class Searcher:
    """Finds the items of one block in plain texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.items, self.automaton = [Item(i, t, rate) for i, t in items], ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int, int]]] = {}
        for nth, item in enumerate(self.items):
            for leaf, (offset, piece) in enumerate(item.pieces):
                places.setdefault(piece, []).append((nth, leaf, offset))
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        if places:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(item, edits, end in the text) of each item that occurs within its budget, with the least edits of any occurrence.

        Of occurrences with equally few edits it is the first that was found."""
        found: dict[int, tuple[int, int]] = {}
        if not self.items:
            return []
        text, done = f" {text} ", set()
        for last, (size, at) in self.automaton.iter(text):
            for nth, leaf, offset in at:
                best, start = found.get(nth), last + 1 - size - offset
                if best and (best[0] == 0 or (nth, start) in done):
                    continue
                item = self.items[nth]
                for low, high in item.above(leaf):
                    edits, end = item.distance(low, high, text, start)
                    if edits > high - low - 1:
                        break
                else:
                    done.add((nth, start))
                    if best is None or edits < best[0]:
                        found[nth] = (edits, end - 1 - item.behind)
        return [(nth, *best) for nth, best in found.items()]


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """Blocks of (item_id, plain text), and whether another follows. Items stream through the driver; two blocks are held at most."""
    part, size = [], 0
    for row in benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        item = plain(row["text"])
        if not item:
            continue
        if part and size + len(item) > BLOCK_CHARS:
            yield part, True
            part, size = [], 0
        part.append((row["item_id"], item))
        size += len(item)
    yield part, False


def _search_block(docs: DataFrame, items: list[tuple[int, str]], rate: float) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    held: list[Searcher] = []

    def run(batches):
        if not held:
            held.append(Searcher(items, rate))
        for b in batches:
            rows = [(i, items[nth][0], edits, held[0].items[nth].budget, end) for i, t in enumerate(b["text"]) for nth, edits, end in held[0].search(plain(t.as_py()))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "item_id", "edits", "budget", "end_at"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id long, edits long, budget long, end_at long")


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """Rows (doc_id, item_id, edits, budget, end_at): each document that holds a test item, and the item.

    end_at is where the best occurrence ends, in characters of the plain text. Null and empty texts hold nothing; null items and
    items without a letter or digit are left out. Repeated rows of documents and items are each reported. An empty table on
    either side gives an empty result; other columns are not read.
    """
    out = None
    for items, more in _blocks(benchmark):
        found = _search_block(docs, items, rate)
        found = cut(found, "leaks") if more else found
        out = found if out is None else out.unionByName(found)
    return out


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """Documents that hold a test item go; all other rows stay as they are, those with a null doc_id or text among them."""
    for items, more in _blocks(benchmark):
        docs = cut(_clean_of(docs, items, rate), "clean") if more else _clean_of(docs, items, rate)
    return docs


def _clean_of(docs: DataFrame, items: list[tuple[int, str]], rate: float) -> DataFrame:
    held: list[Searcher] = []

    def run(batches):
        if not held:
            held.append(Searcher(items, rate))
        for b in batches:
            yield b.filter(pa.array([not held[0].search(plain(t.as_py())) for t in b["text"]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


QUERIES = {"op10_decontaminate": op10_decontaminate}
ORACLE_SQL: dict[str, str] = {}
