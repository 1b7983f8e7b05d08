"""Encoding with a public tokenizer, word by word through a cache.

The tokenizers library does all encoding. A text is cut only where the tokenizer's own splitting always cuts, before a
single space between two other characters, so the ids of the pieces in a row are those of the text; pieces repeat a lot,
and each is encoded once per worker while the cache holds it. Most pieces are a word of Latin letters between ASCII
punctuation, which the tokenizer splits just there: those words go to the library's BPE model directly, without the
normalising and splitting that leave them as they are; what stands beside a mark or in capitals is looked up without
them, so each word is encoded once. Texts with other runs of white space are cut at the safe places only, or encoded whole.
"""

from __future__ import annotations

import codecs
import os
import re
import sys
from array import array

#: Pieces that a worker's cache holds at most; a full one starts anew, which changes speed only.
CACHE_PIECES = 500_000
#: Longer pieces are not kept.
CACHE_LENGTH = 48

#: What may pass for white space beyond ASCII's six.
_RARE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LINES = re.compile(r" ?[^\s]+(?:\n[^\s]+)+")
#: (space) punctuation, letters, punctuation: ASCII punctuation but the apostrophe, and the letters of Latin-1.
_PLAIN = re.compile(r"( ?)([!-&(-/:-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: The letters of _PLAIN.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_CODECS: dict = {}


def _byte_letters() -> str:
    """By byte, the letters that byte-level vocabularies write bytes with: printable bytes stand for themselves, the others follow."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    known = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return "".join(known[b] for b in range(256))


def _rare(text: str) -> bool:
    """Whether a text has rare white space; the letters of most texts are Latin-1, in which little needs a look."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(_RARE.search(text))
    return any(c in text for c in "\x1c\x1d\x1e\x1f\x85\xa0")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers. ``lower``: the tokenizer lower-cases and drops white space."""

    def __init__(self, path: str, lower: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.lower, self.letters = self.tokenizer.model, lower, _byte_letters()
        # Strings that the tokenizer takes out of a text before it splits it: texts with them are encoded whole.
        added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile(added, re.I if lower else 0) if added else None
        self.cache = _Pieces(self)

    def pieces(self, text: str) -> list[str]:
        if self.lower:
            return re.split("[ \t\n\r\f\v]+", text.strip(" \t\n\r\f\v")) if _rare(text) else text.split()
        parts = text.split(" ")
        if "" in parts or " \n" in text or "\n " in text or any(c in text for c in "\t\r\f\v") or _rare(text):
            parts = _CUT.split(text)
        return parts[:1] + [" " + p for p in parts[1:]]

    def whole(self, piece: str) -> bytes:
        return _packed(self.tokenizer.encode(piece, add_special_tokens=False).ids) if piece else b""

    def word(self, word: str) -> bytes:
        """Ids of letters, with the space before them if they have one."""
        form = codecs.charmap_decode(word.encode(), "strict", self.letters)[0]
        return _packed([t.id for t in self.model.tokenize(form)])

    def piece(self, piece: str) -> bytes:
        body = piece[1:] if piece[:1] == " " else piece
        if _LETTERS(body):  # most are a word, or a word and a mark
            word = piece.lower() if self.lower else piece
            return self.word(word) if word == piece else self.cache[word]
        if body[-1:] in ".,;:!?" and _LETTERS(body[:-1]):
            return self.cache[piece[:-1]] + self.cache[body[-1]]
        m = _PLAIN.fullmatch(piece)
        if not m:
            if not self.lower and _LINES.fullmatch(piece):
                return self.cache["\n"].join([self.cache[p] for p in piece.split("\n")])
            return self.whole(piece)
        space, before, letters, after = m.groups()
        if self.lower:
            letters, space = letters.lower(), ""
        if before:
            return self.cache[space + before] + self.cache[letters] + (self.cache[after] if after else b"")
        return self.cache[space + letters] + (self.cache[after] if after else b"")

    def encode(self, texts: list[str]) -> list[bytes]:
        out, added, get = [], self.added, self.cache.__getitem__
        for text in texts:
            if not text:
                out.append(b"")
            elif added and added.search(text):
                out.append(self.whole(text))
            else:
                out.append(b"".join(map(get, self.pieces(text))))
        return out


class _Pieces(dict):
    """Ids by piece; what isn't known is encoded, and kept if it is short."""

    def __init__(self, codec: Encoder):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        got = self.codec.piece(piece)
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = got
        return got


def _packed(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def encoder(path: str, lower: bool) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    key = path, lower
    if key not in _CODECS:
        _CODECS[key] = Encoder(path, lower)
    return _CODECS[key]
