"""Fast encoding of whole texts with the tokenizers library.

Both byte-pair files split a text into words before they merge, and a place where a
single space or newline meets other characters is always such a split. So a text's ids
are the ids of its words in a row. Words recur: each worker keeps the ids of words it
has met and asks the library's model for new ones only. Pieces for which the split isn't
certain (odd white space, digits, apostrophes, rare scripts) go through the library's
whole pipeline instead, and so do texts in which one of the file's added tokens is written
out, which the library takes as that token. So the ids are always those of the whole text.
"""

from __future__ import annotations

import os
import re
import struct

#: Words that one worker keeps, with and without their punctuation. When full, further
#: words are encoded each time they come.
KEPT_WORDS, KEPT_PIECES = 300_000, 300_000

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = ".,|*#%&$!?:;"
#: White space for which byte-level splitting looks ahead: other than single spaces and newlines.
ODD_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
PLAIN = re.compile(rf"( ?[{LETTERS}]+)([{MARKS}]*)")

_loaded: dict[str, TextEncoder] = {}


def byte_letters() -> dict[int, str]:
    """The published byte-level alphabet: printable bytes stand for themselves, the rest, in order, for code points from 256."""
    kept = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Pieces(dict):
    """Letters, with a leading space or without, or marks -> packed ids."""

    def __init__(self, model, lower: bool, width: int):
        self.table, self.tokenize, self.lower = byte_letters(), model.tokenize, lower
        self.space = self.table[ord(" ")]
        self.pack = {n: struct.Struct(f"<{n}{'H' if width == 2 else 'I'}").pack for n in range(64)}
        self.width = width

    def __missing__(self, piece: str) -> bytes:
        text = piece.lower() if self.lower else piece
        if text[1:].isalpha() and text.isascii() and text[0] == " ":  # ASCII letters stand for themselves
            text = self.space + text[1:]
        else:
            text = text.encode().decode("latin-1").translate(self.table)
        ids = [t.id for t in self.tokenize(text)]
        got = self.pack[len(ids)](*ids) if len(ids) < 64 else b"".join([i.to_bytes(self.width, "little") for i in ids])
        if len(self) < KEPT_PIECES:
            self[piece] = got
        return got


class _Words(dict):
    """A word between spaces (which follows a space, or is one newline and a word) -> packed ids."""

    def __init__(self, pieces: _Pieces, between, space: str):
        self.pieces, self.between, self.space = pieces, between, space

    def __missing__(self, word: str) -> bytes:
        letters = word.rstrip(MARKS)
        if letters.isalpha() and letters.isascii():  # most words; PLAIN says the same
            pieces = self.pieces
            got = pieces[self.space + letters]
            if len(letters) < len(word):
                got += pieces[word[len(letters) :]]
        else:
            got = self.between(word if word[:1] == "\n" else self.space + word)
        if len(self) < KEPT_WORDS:
            self[word] = got
        return got


class TextEncoder:
    """Ids of whole texts, packed as little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65536 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self._np = np
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Finds added tokens in a text, in any case; their first letters, which most texts don't have.
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.firsts = sorted({c for t in added for c in (t[0].lower(), t[0].upper())})
        self.drops_space = self.ask(" a  \n\n b ") == self.ask("a b")
        self.pieces = _Pieces(self.model, self.drops_space, self.width)
        self.words = _Words(self.pieces, self.between, "" if self.drops_space else " ")

    def ask(self, text: str) -> bytes:
        """Ids from the library's whole pipeline."""
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return self._np.array(ids, dtype=self.dtype).tobytes()

    def between(self, part: str) -> bytes:
        """Ids of what stands between two spaces, with its leading space if spaces count."""
        if "\n" in part:
            line = b"" if self.drops_space else self.pieces["\n"]
            return line.join([self.between(x) if x else b"" for x in part.split("\n")])
        if m := PLAIN.fullmatch(part):
            return self.pieces[m[1]] + (self.pieces[m[2]] if m[2] else b"")
        return self.ask(part) if part else b""

    def encode(self, text: str) -> bytes:
        if any(c in text for c in self.firsts) and self.added.search(text):
            return self.ask(text)
        if self.drops_space:
            return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or ODD_SPACE.search(text):
            return self.ask(text)
        # A newline goes with the word after it, so lines' ends and starts are known words too.
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.between(first) + b"".join(map(self.words.__getitem__, rest))


def encoder(path: str) -> TextEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _loaded:
        _loaded[path] = TextEncoder(path)
    return _loaded[path]
