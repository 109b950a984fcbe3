"""Encoding of whole texts with a public tokenizer, as the tokenizers library does it.

The library is asked once for each distinct piece of text that a task meets. Texts are
cut where the tokenizer's own pre-tokenizer always cuts, whatever stands around:

* byte-level: before a single space. Where white space stands on both sides of a space
  the cut could fall elsewhere, so such texts are encoded whole.
* lower-case words: at spaces and line feeds, which that tokenizer drops.

A piece of Latin letters is one word for either pre-tokenizer and goes straight to the
library's model; so do its parts if marks of punctuation follow, or lines meet in it. Other
pieces go through the whole tokenizer. What was not met for a while is forgotten.
"""

from __future__ import annotations

import re
from array import array
from functools import cache
from string import punctuation

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from docweft.llm.process import kept

#: Pieces kept by a task.
KEPT = 800_000
#: Bytes of a generation of words, and of one of them besides its letters and ids.
GENERATION, ENTRY = 48 << 20, 200
#: A space before other white space; Python's white space includes all that the tokenizer takes as such.
UNSAFE = re.compile(r" \s")
MARKS, BEYOND_LATIN = ".,;:!?", "ɐ"
WHOLE = object()


@cache
def library(name: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(name))


@cache
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes as they are, others from 256 on."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(rest)}


class Encoder(dict):
    """``ids(texts)``: the ids of each text as little-endian unsigned 32-bit integers.

    As a table it holds the ids of pieces. Keys are what stands between spaces and mean it
    with the space before it. A key that begins with a space means the rest of the key as
    it is: the start of a text, or the space at its end. A piece that begins with white
    space makes its text ``WHOLE``.
    """

    #: Pieces kept, where other than ``KEPT``.
    most: int | None = None

    def __init__(self, name: str, drops_space: bool):
        super().__init__()
        self.tokenizer, self.model, self.drops_space = library(name), library(name).model, drops_space
        self.letters = {b: c for c, b in byte_letters().items()}
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if self.drops_space:
            return text.replace("\n", " ").split(" ")
        out = text.split(" ")
        out[0] = " " + out[0]
        if len(out) > 1 and not out[-1]:
            out[-1] = "  "
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def meaning(self, key: str) -> str:
        if self.drops_space:
            return key
        return key[1:] if key[:1] == " " else " " + key

    def word(self, letters: str, space: bool) -> bytes | None:
        """One word, if it is of Latin letters only."""
        if self.drops_space:
            letters = letters.lower()
        if not letters.isalpha() or max(letters) >= BEYOND_LATIN:
            return None
        if not letters.isascii():
            letters = "".join([self.letters[b] for b in letters.encode()])
        found = self.model.tokenize(self.letters[32] + letters if space else letters)
        return array("I", [t.id for t in found]).tobytes()

    def part(self, key: str) -> bytes | None:
        """A piece without line feeds: a word, perhaps with marks after it."""
        if (known := self.parts.get(key)) is not None:
            return known
        stem = key.rstrip(MARKS)
        if len(stem) < len(key):
            head, tail = self.part(stem) if stem.strip(" ") else None, key[len(stem) :]
            if head is None or not stem[-1].isalpha():
                return None
            if (marks := self.parts.get(tail + "\n")) is None:
                marks = self.parts[tail + "\n"] = self.whole(tail)
            return head + marks
        bare = key.removeprefix(" ")
        found = self.word(bare, len(bare) == len(key) and not self.drops_space)
        if found is not None:
            self.parts[key] = found
        return found

    def lines(self, key: str) -> bytes | None:
        """A piece with single line feeds inside: for the byte-level tokenizer each is a word of its own."""
        first, *rest = key.split("\n")
        if not rest:
            return self.part(key)
        found = [self.part(first) if first.strip(" ") else None, *(self.part(" " + x) if x else None for x in rest)]
        return None if None in found else self["  \n"].join(found)

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            if not self.drops_space and (not key or key[0] != " " and key[0].isspace()):
                found = WHOLE
            else:
                found = None if key == "  \n" or not key else self.lines(key)
                if found is None:
                    found = self.whole(key[2:] if key == "  \n" else self.meaning(key))
        self[key] = found
        return found

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            try:
                out.append(b"".join(map(self.__getitem__, self.pieces(text))) if text else b"")
            except TypeError:  # a piece that makes its text whole
                out.append(self.whole(text))
        most = (self.most or KEPT) // 2
        if len(self) > most:
            self.older = dict(self)
            self.clear()
        if len(self.parts) > most:
            self.parts.clear()
        return out


class WordEncoder(Encoder):
    """For a tokenizer that drops spaces and line feeds: a piece is a word, perhaps with marks after it.

    Pieces are told apart by Arrow, so each is looked up once for all texts of a call. One table
    holds words, runs of marks and other pieces, but no word with its marks. It is bounded by bytes:
    when a generation is full it becomes the older one, and what is still met moves over from there.
    """

    def __init__(self, name: str):
        super().__init__(name, drops_space=True)
        self.held = 0
        #: What stands for each byte, where that is another letter.
        self.other = {b: c for b, c in self.letters.items() if chr(b) != c}

    def word(self, letters: str, space: bool = False) -> bytes | None:
        low = letters.lower()
        if low != letters and (known := self.get(low)) is not None:
            return known
        if not low.isascii():
            if max(low) >= BEYOND_LATIN:
                return None
            low = low.encode().decode("latin-1").translate(self.other)
        return array("I", [t.id for t in self.model.tokenize(low)]).tobytes()

    def __missing__(self, key: str) -> bytes:
        found = self.older.pop(key, None)
        if found is None:
            if key.isalpha():
                found = self.word(key)
            else:
                # ASCII marks after a letter are one word of the pre-tokenizer, whatever they are
                stem = key.rstrip(punctuation)
                if len(stem) < len(key) and stem.isalpha():
                    return self[stem] + self[key[len(stem) :]]
            if found is None:
                found = self.whole(key)
        self[key] = found
        self.held += ENTRY + len(key) + len(found)
        return found

    def ids(self, texts: list[str | None]) -> list[bytes]:
        spaced = pc.replace_substring(pa.array([x or "" for x in texts], pa.string()), "\n", " ")
        pieces = pc.split_pattern(spaced, " ")
        coded = pieces.values.dictionary_encode()
        found = list(map(self.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        known, codes = np.frombuffer(b"".join(found), "<u4"), coded.indices.to_numpy()
        sizes = np.fromiter(map(len, found), "i8", len(found)) // 4
        starts, lengths = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        out = known[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)]
        if self.held > GENERATION:
            self.older = dict(self)
            self.clear()
            self.held = 0
        bounds = ends[pieces.offsets.to_numpy()].tolist()
        return [out[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


def encoder(name: str) -> Encoder:
    """The task process's encoder."""
    return kept(("encoder", name), lambda: WordEncoder(name) if name.startswith("word_") else Encoder(name, drops_space=False))
