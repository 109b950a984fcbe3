"""Language ID by unigram pieces summed over all segmentations.

The vocabulary is that of a public tokenizer; each language has its own probability for
each piece. The probability of a word is the sum over all ways to cut it into pieces,
found by the forward algorithm; a text's is the product over its words. The piece
probabilities are fitted by expectation-maximisation (forward and backward sums give the
expected piece counts), on all words of a bounded sample of labelled texts.

The sample takes ``PER_LANGUAGE`` texts of each language in the order of a hash of the id,
whole; that bound is for fitting only (``types`` can bound the words of a language too; by default
all are taken). The ids are chosen within ``SALTS`` shares of each
language first, so no task holds those of a frequent one. Prediction reads every whole text; a task computes a word's probabilities
once and keeps them in a table of bounded size. The model has one number for each piece
and language, whatever the input, and is broadcast.

Words are whole runs of letters (Unicode category L) between white space, in lower case. Words of more
than ``LONGEST`` characters are summed one by one: the sums are scaled as they are carried along, so no
length is cut or underflows. Only for fitting are words cut after ``LONGEST`` characters. Characters outside the vocabulary get the same small probability in every
language.

Defined cases: a null text, one without a letter, and any text where nothing was learned
is ``und`` with score 0; ties go to the first language in binary order; rows without label
or id are not learned from; repeated rows count as often as they occur; an empty table gives
an empty result; other columns pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docweft.llm.process import kept

VOCABULARY = "piece_bpe_32k.model"
UND = "und"
#: Sampled texts of a language, shares in which they are chosen, steps of the fit, characters of a word in the fit,
#: words fitted in one go, words kept by a task (as many of the generation before, without what lies between white space).
PER_LANGUAGE, SALTS, STEPS, LONGEST, BATCH, KEPT = 1000, 64, 4, 24, 4000, 150_000
#: Texts and characters predicted in one go, words learned in one go: what a task holds beside the words it keeps.
TEXTS, CHARACTERS, LEARN = 256, 1 << 20, 2000
#: Pseudo-count of each piece, probability of a character outside the vocabulary, mark of a word's start.
PSEUDO, UNKNOWN, START = 0.02, 1e-6, "▁"
LETTERS = regex.compile(r"\p{L}+")
SPACE = " \t\n\v\f\r"


class Trie:
    """The pieces that can occur in a word as a tree of characters, in sorted arrays."""

    def __init__(self, name: str):
        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.pieces: dict[str, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            bare = piece.removeprefix(START)
            special = model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
            if not special and piece not in self.pieces and (piece == START or bare.isalpha() and bare == bare.lower()):
                self.pieces[piece] = len(self.pieces)
        node, self.chars, arcs = {"": 0}, 0x110000, {}
        for piece in self.pieces:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in node:
                    node[piece[:k]] = len(node)
                    arcs[node[piece[: k - 1]] * self.chars + ord(piece[k - 1])] = node[piece[:k]]
        self.keys = np.array(sorted(arcs), "i8")
        self.targets = np.array([arcs[k] for k in self.keys.tolist()], "i8")
        self.piece_at = np.full(len(node), -1, "i4")
        for piece, number in self.pieces.items():
            self.piece_at[node[piece]] = number

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The node that each character leads to, -1 where none."""
        wanted = nodes * self.chars + chars
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.targets[at], -1)


@cache
def vocabulary(name: str = VOCABULARY) -> Trie:
    return Trie(name)


def words_of(chunk: str) -> list[str]:
    """The words in lower case with the mark of a start."""
    return [START + run for run in LETTERS.findall(chunk.lower())]


def parts_of(chunk: str) -> list[str]:
    """``words_of`` for fitting: long words in parts."""
    return [START + word[k : k + LONGEST] for word in words_of(chunk) for k in range(1, len(word), LONGEST)]


@dataclass
class Arcs:
    """All pieces in all words: word, first character, end, piece (-1: a character outside the vocabulary)."""

    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, words: list[str], name: str = VOCABULARY) -> Arcs:
        trie = vocabulary(name)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype("i8")
        lengths = np.array([len(w) for w in words], "i8")
        word = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(chars)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        left = lengths[word] - place
        # from every character at once: one step further each time, where the tree goes on
        live, nodes, depth, found = np.arange(len(chars)), np.zeros(len(chars), "i8"), 0, []
        while len(live):
            nodes = trie.step(nodes, chars[live + depth])
            depth += 1
            piece = np.where(nodes >= 0, trie.piece_at[nodes], -1)
            # a character that is no piece may stand alone, as an unknown one
            hit = piece >= 0 if depth > 1 else np.ones(len(live), bool)
            found.append((word[live[hit]], place[live[hit]], place[live[hit]] + depth, piece[hit]))
            go = (nodes >= 0) & (left[live] > depth)
            live, nodes = live[go], nodes[go]
        empty = np.empty(0, "i8")
        return cls(*(np.concatenate([empty, *x]) for x in (zip(*found) if found else [()] * 4)), lengths)

    def weights(self, chances: np.ndarray) -> np.ndarray:
        """``chances``: piece by language, and a last row for characters outside the vocabulary."""
        return chances[self.piece]

    def by(self, ends: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """The arcs of each end (or start), in rising order."""
        order = np.argsort(ends, kind="stable")
        values, first = np.unique(ends[order], return_index=True)
        return list(zip(values.tolist(), np.split(order, first[1:])))

    def add(self, sums: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        """Adds the arcs' values to their words, language by language."""
        for k in range(values.shape[1]):
            sums[:, k] += np.bincount(self.word[at], values[:, k], len(sums))

    def forward(self, weights: np.ndarray) -> np.ndarray:
        """Sum over all segmentations of the first e characters: word, e, language."""
        alpha = np.zeros((len(self.lengths), int(self.lengths.max(initial=0)) + 1, weights.shape[1]))
        alpha[:, 0] = 1
        for e, at in self.by(self.end):
            self.add(alpha[:, e], at, alpha[self.word[at], self.start[at]] * weights[at])
        return alpha

    def backward(self, weights: np.ndarray) -> np.ndarray:
        beta = np.zeros((len(self.lengths), int(self.lengths.max(initial=0)) + 1, weights.shape[1]))
        beta[np.arange(len(self.lengths)), self.lengths] = 1
        for s, at in reversed(self.by(self.start)):
            self.add(beta[:, s], at, beta[self.word[at], self.end[at]] * weights[at])
        return beta

    def totals(self, chances: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        alpha = self.forward(self.weights(chances))
        return np.log(alpha[np.arange(len(self.lengths)), self.lengths])


def long_total(word: str, chances: np.ndarray) -> np.ndarray:
    """Log probability of one word of any length in each language.

    A piece reaches back a few characters only: every ``LONGEST`` characters the sums within that reach are divided by
    the last one, whose logarithm is kept.
    """
    arcs = Arcs.of([word])
    weights, reach = arcs.weights(chances), int((arcs.end - arcs.start).max())
    alpha, logs = np.zeros((len(word) + 1, chances.shape[1])), np.zeros(chances.shape[1])
    alpha[0] = 1
    # each character may stand alone, so every place is an end and its sum is above zero
    for e, at in arcs.by(arcs.end):
        alpha[e] = (alpha[arcs.start[at]] * weights[at]).sum(0)
        if e % LONGEST == 0:
            last = alpha[e].copy()
            alpha[max(0, e - reach) : e + 1] /= last
            logs += np.log(last)
    return logs + np.log(alpha[len(word)])


@dataclass
class Model:
    languages: list[str]
    chances: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def with_unknown(chances: np.ndarray) -> np.ndarray:
    return np.vstack([chances, np.full((1, chances.shape[1]), UNKNOWN)])


def expected_pieces(words: list[str], seen: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """How often each piece is expected in each language. ``seen``: occurrences by word and language."""
    arcs = Arcs.of(words)
    weights = arcs.weights(chances)
    alpha, beta = arcs.forward(weights), arcs.backward(weights)
    whole = alpha[np.arange(len(words)), arcs.lengths]
    share = alpha[arcs.word, arcs.start] * weights * beta[arcs.word, arcs.end] / whole[arcs.word] * seen[arcs.word]
    known = arcs.piece >= 0
    size = len(chances) - 1
    return np.stack([np.bincount(arcs.piece[known], share[known, k], size) for k in range(seen.shape[1])], 1)


def fit_counts(counts: pd.DataFrame, steps: int = STEPS) -> Model:
    """From rows ``lang, word, n``; words as ``parts_of`` gives them."""
    languages = sorted(counts["lang"].unique())
    size = len(vocabulary().pieces)
    if not languages:
        return Model([], np.zeros((size + 1, 0)))
    words = sorted(counts["word"].unique())
    number = {w: i for i, w in enumerate(words)}
    seen = np.zeros((len(words), len(languages)))
    np.add.at(seen, (counts["word"].map(number), counts["lang"].map(languages.index)), counts["n"])
    chances = with_unknown(np.full((size, len(languages)), 1 / size))
    for _ in range(steps):
        expected = np.full((size, len(languages)), PSEUDO)
        for at in range(0, len(words), BATCH):
            expected += expected_pieces(words[at : at + BATCH], seen[at : at + BATCH], chances)
        chances = with_unknown(expected / expected.sum(0))
    return Model(languages, chances)


def fit(
    docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE,
    types: int | None = None, steps: int = STEPS, salts: int = SALTS,
) -> Model:
    """Fits on the bounded sample. ``docs``: the rows that may be learned from."""
    rows = docs.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("id"), F.col(label).alias("lang"), F.col(text).alias("text")
    )
    # which texts: ids and labels only; the texts of the chosen ids are read again
    first = F.xxhash64("id"), F.col("id")
    share = W.partitionBy("lang", F.pmod(F.xxhash64(F.lit(salts), "id"), F.lit(salts))).orderBy(*first)
    chosen = rows.select("id", "lang").withColumn("k", F.row_number().over(share)).filter(F.col("k") <= per_language)
    chosen = chosen.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(*first))).filter(F.col("k") <= per_language)
    # at most PER_LANGUAGE ids for each language
    sample = rows.join(F.broadcast(chosen.select("id", "lang").distinct()), ["id", "lang"], "left_semi")
    runs = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(\\p{L}+)"), 1)).alias("run"))
    counts = runs.groupBy("lang", "run").agg(F.count("*").alias("n"))
    if types is not None:
        best = W.partitionBy("lang").orderBy(F.desc("n"), "run")
        counts = counts.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= types).drop("k")
    counts = counts.toPandas()  # the words of at most PER_LANGUAGE texts for each language
    parts = [(lang, w, n) for lang, run, n in counts.itertuples(index=False) for w in parts_of(run)]
    return fit_counts(pd.DataFrame(parts, columns=["lang", "word", "n"]).groupby(["lang", "word"], as_index=False).sum(), steps)


class Scorer:
    """Predicts texts. What lies between white space, and each word, is scored once; what was not met for a while is forgotten."""

    def __init__(self, model: Model):
        self.model = model
        self.seen: dict[str, int] = {}
        self.words: dict[str, np.ndarray] = {}
        self.older: dict[str, np.ndarray] = {}
        #: Log probability of each thing seen in each language, and whether it has a letter in the last column.
        self.logs = np.zeros((1024, len(model.languages) + 1))

    def learn(self, new: list[str]) -> None:
        parts = [words_of(chunk) for chunk in new]
        fresh = sorted({w for p in parts for w in p}.difference(self.words))
        # copied, since a row of an array keeps all of it
        self.words.update((w, self.older[w].copy()) for w in fresh if w in self.older)
        fresh = [w for w in fresh if w not in self.words]
        long = [w for w in fresh if len(w) > LONGEST + 1]
        self.words.update((w, long_total(w, self.model.chances)) for w in long)
        fresh = [w for w in fresh if len(w) <= LONGEST + 1]
        for at in range(0, len(fresh), LEARN):
            some = fresh[at : at + LEARN]
            self.words.update(zip(some, Arcs.of(some).totals(self.model.chances)))
        base, end = len(self.seen), len(self.seen) + len(new)
        while len(self.logs) < end:
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
        for n, p in enumerate(parts, base):
            self.logs[n, :-1] = sum((self.words[w] for w in p), np.zeros(len(self.model.languages)))
            self.logs[n, -1] = bool(p)
        self.seen.update(zip(new, range(base, end)))

    def forget(self) -> None:
        self.seen, self.words, self.older = {}, {}, self.words

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        chunks = [x.split() if x else [] for x in texts]
        new = set().union(*chunks).difference(self.seen)
        if len(self.seen) + len(new) > KEPT:
            self.forget()
            new = set().union(*chunks)
        self.learn(sorted(new))
        out, place = [], self.seen.__getitem__
        for found in chunks:
            total = self.logs[np.fromiter(map(place, found), "i8", len(found))].sum(0)
            if not self.model.languages or not total[-1]:
                out.append((UND, 0.0))
                continue
            best = int(total[:-1].argmax())
            out.append((self.model.languages[best], float(1 / np.exp(total[:-1] - total[best]).sum())))
        return out


def slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of at most ``TEXTS`` texts and, where that is more than one text, ``CHARACTERS`` characters."""
    start = held = 0
    for at, x in enumerate(texts):
        size = len(x) if x else 0
        if at - start == TEXTS or at > start and held + size > CHARACTERS:
            yield texts[start:at]
            start, held = at, 0
        held += size
    if start < len(texts):
        yield texts[start:]


def scorer_of(model: Model) -> Scorer:
    """The task process's scorer."""
    return kept(("scorer", model.name), lambda: Scorer(model))


def identify(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """Adds a struct ``lang, score``; every row is kept, only the text goes to Python."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = scorer_of(held.value)
        for batch in batches:
            found = []
            for some in slices([x if isinstance(x, str) else None for x in batch]):
                found += scorer.predict(some)
            yield pd.DataFrame(found, columns=["lang", "score"])

    return docs.withColumn(into, scored(F.col(text)))


def held_out(key: Column) -> Column:
    """True for ids that are never learned from: crc32 of the id as text is divisible by 5. Null counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0
