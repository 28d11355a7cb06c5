"""Whole-text encoding with a public tokenizer, word by word through a bounded memo.

Both vocabularies used here end a token before a single space that stands between two visible characters, so a text can be
cut there, each distinct piece encoded once by the library and the ids strung together. A piece of Latin letters goes
straight to the library's merge model; any other piece goes through its whole pipeline, and so does the whole text where a
space stands beside other white space or a special token's text may be inside.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Pieces in a worker's memo; it starts afresh when full.
MEMO = 800_000
#: Letters that are the same in any normal form and have a lower case of one letter, then visible ASCII marks but ' and <: a
#: word and a run of marks are two pieces to either vocabulary.
_marked = re.compile("([A-Za-zÀ-ÖØ-öø-įĲ-ɏ]+)([!-&(-/:;=-@[-`{-~]*)").fullmatch
_loaded: dict[tuple[str, bool], PieceEncoder] = {}


class _ByteLetters(dict):
    """The letters that stand for a character's UTF-8 bytes in a byte-level vocabulary: visible Latin-1 as itself, others from 256 on."""

    def __init__(self):
        super().__init__()
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))
        self.letters = [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]

    def __missing__(self, code: int) -> str:
        self[code] = found = "".join(self.letters[b] for b in chr(code).encode("utf-8", "surrogatepass"))
        return found


class PieceEncoder:
    """Encodes texts to little-endian ids of ``dtype``.

    ``spaced``: the vocabulary keeps white space, and a space belongs to the piece after it; else it drops white space and case.
    """

    def __init__(self, path: str, spaced: bool, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced, self.dtype = Tokenizer.from_file(path), spaced, dtype
        self.model, self.letters = self.tokenizer.model, _ByteLetters()
        self.memo: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}  # pieces without a space before them, where that matters
        self.marks: dict[str, bytes] = {"": b""}  # runs of marks
        self.newline = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, word: str, before: str) -> bytes:
        """A word of Latin letters by the merge model alone."""
        text = before + (word if self.spaced else word.lower())
        return np.array([t.id for t in self.model.tokenize(text.translate(self.letters))], self.dtype).tobytes()

    def _piece(self, piece: str, memo: dict[str, bytes], before: str) -> bytes | None:
        """The ids of a piece with ``before`` in front; None where it can't be told apart from its surroundings."""
        if (found := memo.get(piece)) is not None:
            return found
        if parts := _marked(piece):
            word, run = parts.groups()
            if run not in self.marks:
                self.marks[run] = self.whole(run)
            found = (self._piece(word, memo, before) if run else self._word(word, before)) + self.marks[run]
        elif not piece or piece[0].isspace() or piece[-1].isspace() or "<|" in piece:
            return None
        elif "\n" in piece:
            head, *rest = piece.split("\n")
            parts = [self._piece(head, memo, before), *(self._piece(r, self.bare, "") for r in rest)]
            return None if None in parts else self.newline.join(parts)
        else:
            found = self.whole(before + piece)
        memo[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        if not text:
            return b""
        before = " " if self.spaced else ""
        if not self.spaced and "\n" in text:
            text = text.replace("\n", " ")
        if len(self.memo) + len(self.bare) > MEMO:
            self.memo.clear()
            self.bare.clear()
            self.marks = {"": b""}
        pieces = text.split(" ")
        found = list(map(self.memo.get, pieces))
        if self.spaced:
            found[0] = self._piece(pieces[0], self.bare, "")
        if None in found:
            for i, got in enumerate(found):
                if got is None:
                    found[i] = self._piece(pieces[i], self.memo, before) if i or not self.spaced else None
                    if found[i] is None:
                        return self.whole(text)
        return b"".join(found)


def encoder(path: str, spaced: bool, dtype: str = "<u2") -> PieceEncoder:
    """The worker's encoder of a tokenizer file; it lives as long as the Python worker."""
    if (path, spaced) not in _loaded:
        _loaded[path, spaced] = PieceEncoder(path, spaced, dtype)
    return _loaded[path, spaced]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
