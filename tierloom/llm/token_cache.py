"""Exact, memoised encoding with the ``tokenizers`` library.

Both supported vocabularies tokenize white-space-delimited pieces independently of each other, so
the ids of a text are the concatenation of its pieces' ids. Every distinct piece is encoded once by
the library and remembered (bounded); texts outside the character range for which that split is
provably the library's own go through the library whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Letters whose lower case, composition and class agree between Python and the library.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-įı-ňŊ-ž]*")
_CONTRACTED = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ž]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-zA-Z0-9\xaa\xb5\xba\xb2\xb3\xb9\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-ž]+")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: A run of white space around a space may be one token: such spaces are no place to cut.
_WIDE = ("  ", " \n", "\n ", "\t", "\r")
#: Pieces kept in memory per worker; beyond half of it the memo becomes the older half (a speed bound only).
MEMO_PIECES = 1_300_000
#: A mark after letters is a word of its own to both vocabularies.
_STOPS = (".", ",", ";", ":", "!", "?")


class _Memo(dict):
    """Ids by piece; an unknown piece is encoded when first asked for."""

    def __init__(self, encode: Callable[[str, _Memo], bytes], older: dict[str, bytes]):
        super().__init__()
        self.encode, self.older = encode, older
        if isinstance(older, _Memo):
            older.older = {}  # what is two halves old is forgotten

    def __missing__(self, piece: str) -> bytes:
        known = self.older.get(piece)
        ids = self[piece] = self.encode(piece, self) if known is None else known
        return ids


class PieceEncoder:
    """Encodes whole texts to arrays of ids, equal to ``Tokenizer.encode`` without specials added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.size, self.dtype, self.code = size, ("<u2" if size <= 1 << 16 else "<u4"), ("H" if size <= 1 << 16 else "I")
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.word_ends = spec["model"].get("end_of_word_suffix") == "</w>"
        self.symbols = {b: ord(c) for c, b in byte_alphabet().items()}
        self.stops = {c: self._whole(c) for c in _STOPS}
        self.line_end = b"" if self.word_ends else self._whole("\n")
        self.memo = _Memo(self._piece, {})

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text (null: empty), in order; dtype is little-endian ``self.dtype``."""
        return [np.frombuffer(self._ids(t), dtype=self.dtype) for t in texts]

    def _ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.specials):
            return self._whole(text)
        if len(self.memo) > MEMO_PIECES // 2:
            self.memo = _Memo(self._piece, self.memo)
        known = self.memo.__getitem__
        if self.word_ends:
            return b"".join(map(known, text.lower().split()))
        pieces = _SINGLE_SPACE.split(text) if any(w in text for w in _WIDE) else text.split(" ")
        return self._whole(pieces[0]) + b"".join(map(known, pieces[1:]))  # no space stands before the first

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _piece(self, piece: str, memo: _Memo) -> bytes:
        """Ids of one piece: of its words where it is made of words and marks, else by the library whole."""
        if piece.isalpha():
            return self._word(piece if self.word_ends else " " + piece)
        if piece[-1:] in self.stops and piece[:-1].isalpha():
            return memo[piece[:-1]] + self.stops[piece[-1]]
        if "\n" in piece and all(lines := piece.split("\n")) and not any(x[0].isspace() for x in lines[1:]):  # a line end between two words is a token of its own
            return memo[lines[0]] + b"".join(self.line_end + self._line_start(x) for x in lines[1:])
        return self._whole(piece if self.word_ends else " " + piece)

    def _line_start(self, text: str) -> bytes:
        if text.isalpha():
            return self._word(text)
        if text[-1:] in self.stops and text[:-1].isalpha():
            return self._word(text[:-1]) + self.stops[text[-1]]
        return self._whole(text)

    def _word(self, word: str) -> bytes:
        """Ids of a run of letters, by the library's merges alone: nothing is left to cut."""
        symbols = word.encode().decode("latin-1").translate(self.symbols)
        return array(self.code, [t.id for t in self.model.tokenize(symbols)]).tobytes()


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(0x100 + i)] = b
    return out


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and vocabulary."""
    return PieceEncoder(path)
