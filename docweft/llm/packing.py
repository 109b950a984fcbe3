"""Lexical retrieval packing: a seed's window is filled with its best unused neighbours by BM25.

Whole texts are encoded once and stored as ids; the number of documents that hold each
token is counted over all of them (one number for each token of the vocabulary). Then
each task packs its own part of the stored documents, shard by shard: it builds an
inverted index of a shard with BM25 weights, takes the longest unused document as seed,
looks up all its tokens and places the best-scoring unused neighbours, whole where
they fit; the best one that does not fit is cut to fill the window, and its rest stays
unused. Documents longer than a window are first cut into full windows of their own. What
a shard cannot fill goes into the next one. The last rest of a task is cut into sequences
whose lengths are powers of two, which need no padding; so no sequence does.

Shards are bounded by tokens and documents, and no text or id is shuffled. A repeated task
finds the same documents in the same order and gives the same sequences.

Defined cases: a null text is empty and holds the end id only; a row without id is packed
like any other; repeated rows are packed as often as they occur, so a piece is known by
its sequence and offset; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from docweft.llm.encode import encoder, library
from docweft.llm.process import release
from docweft.llm.token_files import batches_of
from docweft.session import stored

WINDOW, END = 2048, 1
#: BM25 parameters, tokens of a seed that are looked up (no limit), neighbours looked at in one go.
K1, B, TERMS, NEAR = 1.2, 0.75, sys.maxsize, 64
#: Tokens and documents of a shard.
SHARD_TOKENS, SHARD_DOCS = 3_000_000, 8192
#: Lists that hold more than one in so many documents of a shard also become rows; these take no more than COMMON times the lists.
COMMON = 6
#: Texts encoded at once.
TEXTS = 512
TOKENS = "doc_id long, ids binary, n long, holders binary"
PIECES = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


# --- ids ------------------------------------------------------------------------------
def tokenized(name: str, end: int, size: int):
    """Rows with ids; the last row of a task has none, but the number of its documents that hold each token."""
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        holders, closing = np.zeros(size, "<i8"), end.to_bytes(4, "little")
        for frame in batches_of(frames, "text", TEXTS):
            out = []
            for got in encoder(name).ids([x if isinstance(x, str) else None for x in frame["text"]]):
                ids = np.frombuffer(got + closing, "<u4")
                holders[ids] += 1  # a token that is met twice counts once
                out.append((ids.astype(kind).tobytes(), len(ids), None))
            table = pd.DataFrame(out, columns=["ids", "n", "holders"])
            table.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
            yield table
        if holders.any():
            yield pd.DataFrame({"doc_id": [None], "ids": [None], "n": [None], "holders": [holders.tobytes()]}).astype(
                {"doc_id": "Int64", "n": "Int64"}
            )

    return run


def document_frequencies(tokens: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each token."""

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, "i8")
        for frame in frames:
            for x in frame["holders"]:
                total += np.frombuffer(x, "<i8")
        held = np.flatnonzero(total)
        yield pd.DataFrame({"token": held.astype("i4"), "n": total[held]})

    rows = tokens.filter("holders is not null").select("holders").mapInPandas(summed, "token int, n long")
    out = np.zeros(size, "i8")
    for r in rows.groupBy("token").agg(F.sum("n").alias("n")).collect():  # one row per token of the vocabulary at most
        out[r["token"]] = r["n"]
    return out


# --- one shard ------------------------------------------------------------------------
class Index:
    """Inverted index of a shard with BM25 weights."""

    def __init__(self, parts: list[np.ndarray], idf: np.ndarray, mean: float):
        sizes = np.array([len(x) for x in parts])
        joint = np.repeat(np.arange(len(parts), dtype="i8"), sizes) * len(idf) + np.concatenate(parts)
        joint, tf = np.unique(joint, return_counts=True)
        doc, token = joint // len(idf), joint % len(idf)
        norm = K1 * (1 - B + B * sizes[doc] / mean)
        weight = idf[token] * tf * (K1 + 1) / (tf + norm)
        self.first = np.searchsorted(doc, np.arange(len(parts) + 1))
        self.token = token
        order = np.argsort(token, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        self.lists = np.searchsorted(token[order], np.arange(len(idf) + 1))
        self.size = len(parts)
        self.order_common()

    def order_common(self) -> None:
        """Lists of more than one in ``COMMON`` documents of the shard become rows of weights, which add up faster."""
        self.row = np.full(len(self.lists) - 1, -1)
        common = np.flatnonzero(np.diff(self.lists) * COMMON > self.size)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.size))
        for k, (a, b) in enumerate(zip(self.lists[common].tolist(), self.lists[common + 1].tolist())):
            self.rows[k, self.docs[a:b]] = self.weights[a:b]

    def neighbours(self, seed: int) -> np.ndarray:
        """BM25 score of every document of the shard for all tokens of the seed; zero for dropped documents."""
        held = self.token[self.first[seed] : self.first[seed + 1]]
        row = self.row[held]
        held, row = held[row < 0], row[row >= 0]
        # added row by row, so always in the same order
        total = self.rows[row].sum(axis=0)
        if not len(held):
            return total
        spans = [slice(a, b) for a, b in zip(self.lists[held].tolist(), self.lists[held + 1].tolist())]
        return total + np.bincount(
            np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), self.size
        )

    def drop(self, gone: np.ndarray) -> None:
        """Leaves documents out of the lists; they may not be seeds any more."""
        keep = ~gone[self.docs]
        self.lists = np.concatenate([[0], np.cumsum(keep)])[self.lists]
        self.docs, self.weights = self.docs[keep], self.weights[keep]
        self.order_common()


def pack_shard(parts: list[np.ndarray], idf: np.ndarray, mean: float, window: int):
    """Yields full windows as lists of (part, from, to); at the end, as a list of the same kind, what is left."""
    index = Index(parts, idf, mean)
    sizes = np.array([len(x) for x in parts])
    done = np.zeros(len(parts), "i8")
    order = np.argsort(-sizes, kind="stable")
    total, at, listed = int(sizes.sum()), 0, len(parts)
    while total >= window:
        while done[order[at]] == sizes[order[at]]:
            at += 1
        seed = order[at]
        room, placed = window, []

        def place(p: int, most: int) -> int:
            n = min(int(sizes[p] - done[p]), most)
            placed.append((int(p), int(done[p]), int(done[p]) + n))
            done[p] += n
            return n

        room -= place(seed, room)
        if room and (live := np.count_nonzero(done < sizes)) < 0.8 * listed:
            index.drop(done == sizes)
            listed = live
        scores = index.neighbours(seed) if room else None
        while room:
            scores[done == sizes] = 0
            near = np.argpartition(-scores, NEAR)[:NEAR] if len(scores) > NEAR else np.arange(len(scores))
            near = near[scores[near] > 0]
            near = near[np.lexsort((near, -scores[near]))]
            if not len(near):  # no word in common with anything left: the next in order
                rest = at
                while room:
                    if done[order[rest]] < sizes[order[rest]]:
                        room -= place(order[rest], room)
                    rest += 1
                break
            best = near[0]
            for p in near:
                if room and sizes[p] - done[p] <= room:
                    room -= place(p, room)
            if room and done[best] < sizes[best]:
                room -= place(best, room)
        total -= window
        yield placed
    yield [(int(p), int(done[p]), int(sizes[p])) for p in order if done[p] < sizes[p]]


def packer(idf: np.ndarray, mean: float, window: int, width: int, shard_tokens: int, shard_docs: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        number = TaskContext.get().partitionId() << 40
        #: Unplaced parts of documents: id, start, length of the document, ids.
        waiting: list[tuple] = []
        tokens, rows = 0, []

        def emit(placed: list[tuple]) -> None:
            nonlocal number
            offset = 0
            for key, start, whole, ids in placed:
                rows.append((key, start, ids.astype("<u4").tobytes(), whole, number, offset))
                offset += len(ids)
            number += 1

        def table() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")]).astype({"doc_id": "Int64"})
            rows.clear()
            return out

        def part(p: tuple, a: int, b: int) -> tuple:
            return p[0], p[1] + a, p[2], p[3][a:b]

        def pack() -> None:
            nonlocal waiting, tokens
            if not waiting:
                return
            *full, left = pack_shard([w[3] for w in waiting], idf, mean, window)
            for placed in full:
                emit([part(waiting[p], a, b) for p, a, b in placed])
            waiting = [part(waiting[p], a, b) for p, a, b in left]
            tokens = sum(len(w[3]) for w in waiting)

        for frame in frames:
            for key, data in zip(frame["doc_id"], frame["ids"]):
                ids = np.frombuffer(data, f"<u{width}")
                n, cut = len(ids), len(ids) // window * window
                for a in range(0, cut, window):
                    emit([(key, a, n, ids[a : a + window])])
                if cut < n:
                    waiting.append((key, cut, n, ids[cut:]))
                    tokens += n - cut
                if tokens >= shard_tokens or len(waiting) >= shard_docs:
                    pack()
                if len(rows) >= 2000:
                    yield table()
        pack()
        # what is left is less than a window: sequences of the powers of two that sum up to it
        size = 1 << max(0, tokens.bit_length() - 1)
        while tokens:
            room, placed = size, []
            while room:
                key, start, whole, ids = waiting[0]
                placed.append((key, start, whole, ids[:room]))
                waiting[:1] = [(key, start + room, whole, ids[room:])] if len(ids) > room else []
                room -= len(placed[-1][3])
            emit(placed)
            tokens -= size
            size = 1 << max(0, tokens.bit_length() - 1)
        yield table()

    return run


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", end: int = END,
    window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """``doc_id, start, ids, doc_tokens, sequence_id, offset``: the pieces; ids as little-endian unsigned 32-bit integers."""
    size = max(library(tokenizer).get_vocab_size(), end + 1)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tokens = stored(rows.mapInPandas(tokenized(tokenizer, end, size), TOKENS), "tokens")
    holders = document_frequencies(tokens, size)
    count, total = tokens.filter("ids is not null").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    idf = np.log(1 + (count - holders + 0.5) / (holders + 0.5))
    run = packer(idf, total / max(1, count), window, 2 if size <= 1 << 16 else 4, shard_tokens, shard_docs)
    return tokens.filter("ids is not null").select("doc_id", "ids").mapInPandas(run, PIECES)
