"""Byte-level BPE with a minimal acyclic transducer as lexicon.

The frequent words of the corpus are compiled, with their ids as output, into a
deterministic automaton whose equal suffixes are shared (built from sorted words, each
finished state merged with an equal one). Arcs carry numbers whose sum along a word is the
word's number, which leads to its ids. The automaton is one file in the shared folder; a
task maps it into memory, so all tasks of a machine share its pages, and follows a word
byte by byte. Words that are not in it are merged exactly, pair by pair in the order of
the vocabulary's merges. What a task has found is kept in a table of bounded size.

Frequent means at least ``SHARE`` of all words of all texts, so the lexicon has at most
1 / SHARE words whatever the input; it decides about speed only, never about ids. Word
counts are combined before they are shuffled.

Texts are cut as in ``encode``: special tokens first, then where the pre-tokenizer always
cuts, and the pre-tokenizer of the library cuts what is left.

Defined cases: a null text is empty and has no ids; an id outside the vocabulary decodes to
nothing, as do null ids; bytes that are no UTF-8 decode to U+FFFD; repeated rows are
encoded as often as they occur; an empty table gives an empty lexicon and an empty result;
other columns pass through.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import struct
import tempfile
from array import array
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from docweft.llm import files
from docweft.llm.encode import BEYOND_LATIN, Encoder, byte_letters, library
from docweft.llm.process import kept
from docweft.session import new_path, stored

TOKENIZER = "byte_bpe_50k.json"
#: Least share of a lexicon word, symbols above which merging uses a heap, texts taken at once.
SHARE, LONG, BATCH = 1 / 100_000, 48, 256
#: A merge is one number: its rank, then the id it makes in the low bits.
ID_BITS, NO_MERGE = 24, 1 << 62
ID_MASK = (1 << ID_BITS) - 1
HEADER = "<8s4Q"
MAGIC = b"DWLEXIC1"


# --- vocabulary -----------------------------------------------------------------------
class Vocabulary:
    """Merges by rank, bytes by id, special tokens."""

    def __init__(self, name: str):
        data = json.loads(Path(public_tokenizers.path(name)).read_text("utf-8"))
        letters, ids = byte_letters(), data["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in ids.items() if all(c in letters for c in token)}
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.single = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a], ids[b]] = rank << ID_BITS | ids[a + b]
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of lowest rank is merged, the first of equals, until none is left."""
        ids = [self.single[b] for b in word]
        return self.merged_long(ids) if len(ids) > LONG else self.merged_short(ids)

    def merged_short(self, ids: list[int]) -> list[int]:
        get = self.merges.get
        #: For each neighbouring pair its merge; the smallest has the lowest rank.
        pairs = [get(p, NO_MERGE) for p in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) != NO_MERGE:
            k = pairs.index(best)
            ids[k : k + 2] = [best & ID_MASK]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = get((ids[k], ids[k + 1]), NO_MERGE)
            if k:
                pairs[k - 1] = get((ids[k - 1], ids[k]), NO_MERGE)
        return ids

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list: n log n."""
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0 and (got := self.merges.get((ids[k], ids[after[k]]))) is not None:
                heapq.heappush(heap, (got >> ID_BITS, k, ids[k], ids[after[k]], got & ID_MASK))

        for k in range(n):
            offer(k)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            other = after[k]
            if ids[k] != a or other < 0 or ids[other] != b:
                continue
            ids[k], ids[other] = new, -1
            after[k] = after[other]
            if after[k] >= 0:
                before[after[k]] = k
            offer(k)
            offer(before[k])
        return [x for x in ids if x >= 0]


@cache
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(name)


# --- the automaton --------------------------------------------------------------------
def compiled(words: dict[bytes, list[int]]) -> bytes:
    """The file of the automaton that maps each word to its ids."""
    #: Finished states by content: final, arcs (label, target). The number of words below a state gives the arcs' numbers.
    register: dict[tuple, int] = {}
    states: list[tuple] = []
    below: list[int] = []

    def finish(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            below.append(final + sum(below[t] for _, t in arcs))
        return register[key]

    order = sorted(words)
    #: States on the path of the last word: final, finished arcs, label of the arc that is open.
    path: list[list] = [[False, [], None]]
    last = b""

    def fold(down_to: int) -> None:
        while len(path) > down_to + 1:
            final, arcs, _ = path.pop()
            path[-1][1].append((path[-1][2], finish(final, arcs)))

    for word in order:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        fold(same)
        for b in word[same:]:
            path[-1][2] = b
            path.append([False, [], None])
        path[-1][0] = True
        last = word
    fold(0)
    root = finish(path[0][0], path[0][1])
    first, labels, targets, skips = [0], bytearray(), [], []
    for final, arcs in states:
        count = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            skips.append(count)
            count += below[target]
        first.append(len(labels))
    ends = np.cumsum([0, *(len(words[w]) for w in order)], dtype="<i4")
    ids = np.array([i for w in order for i in words[w]], "<i4")
    final = np.array([s[0] for s in states], "<i4")
    head = struct.pack(HEADER, MAGIC, root, len(states), len(labels), len(order))
    numbers = [np.array(first, "<i4"), final, np.array(targets, "<i4"), np.array(skips, "<i4"), ends, ids]
    return head + b"".join(x.tobytes() for x in numbers) + bytes(labels)


class Lexicon:
    """The compiled automaton, mapped into memory."""

    def __init__(self, path: str):
        system, inner = files.opened(path)
        if isinstance(system, pafs.LocalFileSystem):
            self.file = open(inner, "rb")
        else:  # a store: this process's own copy is mapped
            self.file = tempfile.TemporaryFile()
            with system.open_input_stream(inner) as source:
                while piece := source.read(1 << 20):
                    self.file.write(piece)
            self.file.flush()
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        magic, self.root, states, arcs, words = struct.unpack_from(HEADER, self.map)
        if magic != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        view, at = memoryview(self.map), struct.calcsize(HEADER)

        def numbers(n: int) -> memoryview:
            nonlocal at
            at += 4 * n
            return view[at - 4 * n : at].cast("i")

        self.first, self.final, self.target, self.skip = numbers(states + 1), numbers(states), numbers(arcs), numbers(arcs)
        self.ends = numbers(words + 1)
        self.ids = numbers(self.ends[words])
        self.labels = at

    def get(self, word: bytes) -> list[int] | None:
        state, number, find, base = self.root, 0, self.map.find, self.labels
        for k in range(len(word)):
            arc = find(word[k : k + 1], base + self.first[state], base + self.first[state + 1]) - base
            if arc < 0:
                return None
            number += self.skip[arc]
            state = self.target[arc]
        return self.ids[self.ends[number] : self.ends[number + 1]].tolist() if self.final[state] else None


def frequent_words(docs: DataFrame, text: str = "text", share: float = SHARE) -> DataFrame:
    """Words (what lies between single spaces, with the space before it) that make up at least ``share`` of all words."""
    found = docs.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), " ")).alias("word"))
    counts = stored(found.groupBy("word").agg(F.count("*").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter((F.col("n") >= total * share) & (F.length("word") > 0) & (F.length("word") <= 64)).select("word", "n")


def build_lexicon(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, share: float = SHARE) -> str:
    """Counts the words of all texts, compiles the frequent ones and returns the path of the file."""
    words, vocab, cut = {}, vocabulary(tokenizer), library(tokenizer).pre_tokenizer
    for (word,) in frequent_words(docs, text, share).select("word").collect():  # at most 1 / share words
        for chunk in (word, " " + word):
            for _, (a, b) in cut.pre_tokenize_str(chunk):
                piece = chunk[a:b].encode("utf-8", "surrogatepass")
                if piece not in words:
                    words[piece] = vocab.merged(piece)
    path = new_path(docs.sparkSession, "lexicon")
    system, inner = files.opened(path)
    system.create_dir(str(Path(inner).parent), recursive=True)
    with system.open_output_stream(inner) as out:
        out.write(compiled(words))
    return path


# --- encoding and decoding ------------------------------------------------------------
class LexiconEncoder(Encoder):
    """Cuts texts as ``encode`` does; words are found in the lexicon or merged here."""

    #: Merging costs more here than in the library, so more is kept.
    most = 1_200_000

    def __init__(self, path: str, tokenizer: str):
        super().__init__(tokenizer, drops_space=False)
        self.lexicon, self.vocab, self.cut = Lexicon(path), vocabulary(tokenizer), self.tokenizer.pre_tokenizer

    def found(self, piece: bytes) -> list[int]:
        known = self.lexicon.get(piece)
        return self.vocab.merged(piece) if known is None else known

    def word(self, letters: str, space: bool) -> bytes | None:
        if not letters.isalpha() or max(letters) >= BEYOND_LATIN:
            return None
        return array("I", self.found((" " + letters if space else letters).encode())).tobytes()

    def whole(self, text: str) -> bytes:
        out: list[int] = []
        parts = self.vocab.cut_special.split(text) if self.vocab.cut_special else [text]
        for part in parts:
            if part in self.vocab.special:
                out.append(self.vocab.special[part])
                continue
            for _, (a, b) in self.cut.pre_tokenize_str(part) if part else []:
                out += self.found(part[a:b].encode("utf-8", "surrogatepass"))
        return array("I", out).tobytes()


def encoder(path: str, tokenizer: str = TOKENIZER):
    """A column function: text to array of ids, by the lexicon in the file."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = kept(("lexicon", path), lambda: LexiconEncoder(path, tokenizer))
        for batch in batches:
            yield pd.Series(encoded(run, batch))

    return encode


def encoded(run: LexiconEncoder, texts: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, "<i4") for x in run.ids([x if isinstance(x, str) else None for x in texts])]


def decoded(ids: list[int], tokenizer: str = TOKENIZER) -> str:
    get = vocabulary(tokenizer).bytes_of.get
    return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


def decoder(tokenizer: str = TOKENIZER):
    """A column function: array of ids to text."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([decoded(x.tolist(), tokenizer) if x is not None else "" for x in batch])

    return decode


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids, decoded``: encodes each text and decodes its ids, in one task process and ``BATCH`` texts at once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = kept(("lexicon", path), lambda: LexiconEncoder(path, tokenizer))
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                part = frame.iloc[at : at + BATCH]
                ids = encoded(coder, part["text"])
                texts = [decoded(x.tolist(), tokenizer) for x in ids]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(), "ids": ids, "decoded": texts})

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc_id long, ids array<int>, decoded string")
