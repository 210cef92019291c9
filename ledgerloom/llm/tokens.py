"""Token ids by the tokenizers library, with the ids of pieces of text remembered.

A text is cut at places that no token crosses, and the ids of each distinct piece are computed once by the library:

* word ids (`word_bpe`): white space is dropped by the tokenizer and ends every word, so pieces end at spaces and newlines.
* byte ids (`byte_bpe`): a space between two other characters opens a new pre-token whatever stands around it, and a
  newline between two others is a pre-token of its own, so pieces begin at such spaces and at both sides of such newlines.

A piece of letters alone, or of letters and final marks, is one pre-token or two: it goes straight to the tokenizer's
model. Any other piece goes through the whole tokenizer. Ids are those of `encode(text, add_special_tokens=False)` on the
whole text (tests compare them on random text); strings of added tokens in a text are those tokens, as the library reads them.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import unicodedata
from array import array

from ledgerloom.llm.common import worker_cache

#: Pieces remembered by each of two generations; longer pieces than PIECE_CHARS are not remembered.
REMEMBERED, PIECE_CHARS = 200_000, 40
SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")
#: Letters, then ASCII marks but the apostrophe, which opens contractions: two pre-tokens.
MARKED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)\Z")
#: Letters below are lower-cased one by one, alike in Python and in the library.
SIMPLE = "ɐ"


def byte_letters() -> dict[int, int]:
    """Latin-1 code points to the letters that stand for bytes in byte-level vocabularies: printable bytes for
    themselves, the others for U+0100 and up in their order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in printable)}


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" and array("I").itemsize == 4 else struct.pack(f"<{len(ids)}I", *ids)


class Memory(dict):
    """Piece -> ids; misses are computed, and pieces unused for a generation are forgotten."""

    def __init__(self, compute, remembered: int = REMEMBERED):
        super().__init__()
        self.compute, self.remembered, self.old = compute, remembered, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.compute(piece)
        if len(piece) <= PIECE_CHARS:
            self[piece] = ids
        return ids

    def age(self) -> None:
        if len(self) > self.remembered:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Documents to ids, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError(f"{path} has added tokens that take their surroundings in")
        self.added = {t.content: packed([i]) for i, t in added.items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.space = chr(self.letters[0x20])
        # Probes, not the file's name, decide: does white space carry ids, and is text lower-cased?
        self.drops_space = len(self.whole("a  \n\t b")) == 2 * 4
        self.lowers = self.whole("AB") == self.whole("ab")
        self.plain = Memory(lambda p: self.piece(p, ""), remembered)
        self.spaced = Memory(self.after_space, remembered)

    @staticmethod
    def of(path: str, remembered: int = REMEMBERED) -> Encoder:
        cache = worker_cache("tokens")
        if ("encoder", path, remembered) not in cache:
            cache["encoder", path, remembered] = Encoder(path, remembered)
        return cache["encoder", path, remembered]

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def token(self, text: str) -> bytes:
        """Ids of one pre-token."""
        if not text.isascii():
            lead, text = (self.space, text[1:]) if text[0] == self.space else ("", text)
            text = lead + text.encode().decode("latin-1").translate(self.letters)
        return packed([t.id for t in self.model.tokenize(text)])

    def piece(self, p: str, lead: str) -> bytes:
        if not p:
            return self.whole(lead) if lead else b""
        word, mark = (p, "") if p.isalpha() else m.groups() if (m := MARKED.match(p)) else ("", "")
        if not word.isalpha() or not word.isascii() and (max(word) >= SIMPLE or not unicodedata.is_normalized("NFC", word)):
            return self.whole(lead + p)
        if mark:
            return (self.spaced if lead else self.plain)[word] + (self.plain[mark] if len(mark) < 4 else self.whole(mark))
        return self.token((self.space if lead else "") + (word.lower() if self.lowers else word))

    def encode(self, texts: list[str]) -> list[bytes]:
        self.plain.age()
        self.spaced.age()
        one = self.words if self.drops_space else self.bytes
        return [self.parts(t, one) if any(a in t for a in self.added) else one(t) for t in texts]

    def parts(self, text: str, one) -> bytes:
        """Ids of a text with strings of added tokens: those are tokens, and what stands between them is encoded by itself."""
        return b"".join(self.added[p] if i % 2 else one(p) for i, p in enumerate(self.split_added(text)))

    def words(self, text: str) -> bytes:
        return b"".join(map(self.plain.__getitem__, text.replace("\n", " ").split(" ")))

    def after_space(self, p: str) -> bytes:
        """Ids of a piece after a space; of one after a newline if it begins so."""
        line, p = (self.plain["\n"], p[1:]) if p[:1] == "\n" else (b"", p)
        if not p or p[0].isspace() or p[-1].isspace():
            raise Irregular
        return line + self.plain[p] if line else self.piece(p, " ")

    def bytes(self, text: str) -> bytes:
        """In a regular text white space never meets white space or an end."""
        if not text:
            return b""
        first, more, rest = text.replace("\n", " \n").partition(" ")
        try:
            if not first or first[0].isspace() or first[-1].isspace():
                raise Irregular
            return self.plain[first] + (b"".join(map(self.spaced.__getitem__, rest.split(" "))) if more else b"")
        except Irregular:
            return b"".join(map(self.plain.__getitem__, SAFE.split(text)))


class Irregular(Exception):
    """White space meets white space or an end."""


def slices(values: list, most: int):
    """Consecutive parts of a list of texts with about `most` characters at most, at least one text each: (start, part)."""
    start, held = 0, 0
    for i, t in enumerate(values):
        if held and held + len(t) > most:
            yield start, values[start:i]
            start, held = i, 0
        held += len(t)
    if start < len(values):
        yield start, values[start:]
