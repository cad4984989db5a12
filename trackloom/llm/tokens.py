"""Whole-text encoding with the tokenizers library, pieces of text being encoded once per worker."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces in each of the two generations that a worker keeps; results never depend on it.
CACHED_PIECES = 500_000


#: ASCII white space but space and newline.
RARE_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and up, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in plain)}


class _Pieces(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers.

    When the table is full it becomes the older generation, in which later misses look first;
    frequent pieces so survive.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is None:
            ids = self.make(piece)
        if len(self) >= CACHED_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


#: Letters, then ASCII punctuation; marks would join the letters.
_TAILED = re.compile(r"([^\W\d_]+)([!-/:-@\[-^`{-~]+)")


class Encoder:
    """Texts to id bytes, equal to encoding each whole text.

    Texts are split only where the tokenizer's own pre-tokenizer always splits:

    * byte-level BPE: before a space that a non-space follows, and around a newline that
      stands alone.  Texts with other white space (a space before white space or at the
      end, the separators U+001C to U+001F) are encoded whole.
    * BPE that drops white space: at white space; texts with U+001C to U+001F are encoded whole.

    A piece of nothing but Latin letters is one pre-token, which the tokenizer's model takes
    directly; punctuation after letters is a pre-token of its own, so that both parts are kept
    for themselves.  Texts that hold the content of an added token, and any other tokenizer's texts, are
    encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = (spec.get("pre_tokenizer") or {}).get("type")
        parts = [x["type"] for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        plain_spaces = "Replace" in [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.mode = "byte" if kind == "ByteLevel" and spec.get("normalizer") is None else "word" if parts == ["Split", "ByteLevel"] and plain_spaces else "whole"
        # an added token's text is one id wherever it stands; letter case may be lost in normalising
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(added) or r"(?!)", re.IGNORECASE if spec.get("normalizer") else 0)
        self.openers = sorted({x for t in self.tokenizer.get_added_tokens_decoder().values() if t.content for x in (t.content[0].lower(), t.content[0].upper())})
        self.letters = _byte_letters()
        self.bare, self.spaced, self.tails = _Pieces(self.bare_piece), _Pieces(self.spaced_piece), _Pieces(self.whole)
        self.newline = self.whole("\n")
        # white space but space and newline, then where spaces and newlines stand as well
        self.rare = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        self.odd = re.compile(r" \s| \Z|\n\s|\s\n|[\x1c-\x1f]")

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def bare_piece(self, piece: str) -> bytes:
        if (two := _TAILED.fullmatch(piece)) and two[1].isalpha():
            return self.bare[two[1]] + self.tails[two[2]]
        if self.mode == "word" and piece.isalpha() and (low := piece.lower()) != piece and max(piece) < "\u0250":
            return self.bare[low]
        return self.piece(piece)

    def spaced_piece(self, piece: str) -> bytes:
        if piece[:1] == "\n":  # a line's first word
            return self.newline + (self.bare[piece[1:]] if len(piece) > 1 else b"")
        if (two := _TAILED.fullmatch(piece)) and two[1].isalpha():
            return self.spaced[two[1]] + self.tails[two[2]]
        return self.piece(" " + piece)

    def piece(self, piece: str) -> bytes:
        word = piece.lstrip(" ") if self.mode == "byte" else piece
        if not word.isalpha() or not (word.isascii() or max(word) < "\u0250"):
            return self.whole(piece)
        if self.mode == "word":
            piece = piece.lower()
        text = piece if piece.isascii() and piece[0] != " " else piece.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        # single characters are found far faster than patterns
        if any(x in text for x in self.openers) and self.added.search(text):
            return self.whole(text)
        if self.mode == "word" and not any(x in text for x in "\x1c\x1d\x1e\x1f"):
            bare = self.bare
            return b"".join([bare[x] for x in text.split()])
        if self.mode != "byte":
            return self.whole(text)
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text.endswith(" ") or (not text.isascii() or any(x in text for x in RARE_ASCII)) and self.rare.search(text) and self.odd.search(text):
            return self.whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        spaced = self.spaced
        return (self.bare[first] if first else b"") + b"".join([spaced[x] for x in rest])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary file."""
    return Encoder(path)
