"""SimHash near-duplicates: 64-bit fingerprints, blocks that close pairs must share, verified links, components.

A fingerprint is split into ``PARTS`` parts; two fingerprints that differ in at most
``DISTANCE`` bits have ``PARTS - DISTANCE`` parts in common, whichever these are. So each
fingerprint is filed under every choice of that many parts (20 choices of 32 bits or so),
and only fingerprints filed together are compared.

Documents of one fingerprint are one class before anything is filed, so copies cost
nothing. Within a file of fingerprints a search from link to link compares each one with
those not yet reached and returns a star (smallest id, other id) for each connected set:
never more rows than the file has members. A file of more than ``GROUP`` members is dealt
into pairs of slices, so that no task holds an unbounded file; no candidate is dropped.

The stars are joined into components by alternating star steps, each written to the shared
folder, so a lost executor costs its own tasks only.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; a
text of one or two words is one shingle; a row without id takes no part and is left out;
repeated rows are rows of one class; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from docweft.session import stored

SEED, SHINGLE, DISTANCE = 42, 3, 3
#: Bits of the parts, members of a file that are compared in one go.
PARTS = (11, 11, 11, 11, 10, 10)
GROUP = 2048


# --- fingerprints ---------------------------------------------------------------------
def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """As an unsigned number; a bit is set if it is in over half the hashes of the shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[min(shingle, len(found)) - 1 :].tolist()
    hash_of = xxhash.xxh64_intdigest
    hashes = np.array([hash_of(line[a:b], SEED) for a, b in zip(starts, stops)], "<u8")
    ones = np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, print`` (the fingerprint as a signed 64-bit number) of every row that has an id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prints = [fingerprint(x if isinstance(x, str) else None, shingle) for x in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("i8"), "print": np.array(prints, "u8").view("i8")})

    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc_id long, print long")


# --- links ----------------------------------------------------------------------------
def masks(parts: tuple[int, ...] = PARTS, distance: int = DISTANCE) -> list[int]:
    """One mask for each choice of parts that close fingerprints share, as signed numbers."""
    if sum(parts) != 64 or len(parts) <= distance:
        raise ValueError("the parts must have 64 bits together and be more than the distance")
    shifts = np.concatenate([[0], np.cumsum(parts)[:-1]])
    fields = [((1 << int(n)) - 1) << int(s) for n, s in zip(parts, shifts)]
    chosen = [sum(x) for x in combinations(fields, len(parts) - distance)]
    return [x - (1 << 64) if x >> 63 else x for x in chosen]


def reached(prints: np.ndarray, ids: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the connected sets among the given fingerprints: smallest id, other id."""
    order = np.argsort(ids)
    prints, ids = prints[order], ids[order]
    left = np.arange(len(ids))
    hubs, others = [], []
    while len(left):
        hub, left = left[0], left[1:]
        todo = [hub]
        while todo and len(left):
            near = np.bitwise_count(prints[left] ^ prints[todo.pop()]) <= distance
            got, left = left[near], left[~near]
            todo += got.tolist()
            hubs.append(np.full(len(got), ids[hub]))
            others.append(ids[got])
    empty = np.empty(0, "i8")
    return np.concatenate([empty, *hubs]), np.concatenate([empty, *others])


def star_maker(distance: int):
    """Files come one after the other, sorted; a file that a batch cuts waits for the next batch."""

    def stars(frame: pd.DataFrame) -> pd.DataFrame:
        prints, ids = frame["print"].to_numpy("i8"), frame["id"].to_numpy("i8")
        number = frame.groupby(["mask", "key", "a", "b"], sort=False).ngroup().to_numpy()
        first = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1]) if len(number) else np.empty(0, int)
        size = np.diff(np.append(first, len(number)))
        pair = first[size == 2]
        close = pair[np.bitwise_count(prints[pair] ^ prints[pair + 1]) <= distance]
        low, high = np.minimum(ids[close], ids[close + 1]), np.maximum(ids[close], ids[close + 1])
        hubs, others = [low], [high]
        for at, n in zip(first[size > 2], size[size > 2]):
            a, b = reached(prints[at : at + n], ids[at : at + n], distance)
            hubs.append(a)
            others.append(b)
        return pd.DataFrame({"a": np.concatenate(hubs), "b": np.concatenate(others)}).drop_duplicates()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            last = frame.iloc[-1][["mask", "key", "a", "b"]]
            tail = (frame[["mask", "key", "a", "b"]] == last).all(axis=1).to_numpy()
            if tail.all():
                held.append(frame)
                # still the file that was held back, or the first rows of a new one
                if len(held) > 1 and tuple(held[-2].iloc[-1][["mask", "key", "a", "b"]]) != tuple(last):
                    yield stars(pd.concat(held[:-1]))
                    held = [frame]
                continue
            yield stars(pd.concat([*held, frame[~tail]]))
            held = [frame[tail]]
        if held:
            yield stars(pd.concat(held))

    return run


def links(classes: DataFrame, distance: int = DISTANCE, parts: tuple[int, ...] = PARTS, group: int = GROUP) -> DataFrame:
    """``a, b``: stars that connect all fingerprints linked within a file. ``classes``: stored rows ``print, id``."""
    filed = classes.select(
        "id", "print", F.posexplode(F.array(*(F.col("print").bitwiseAND(F.lit(m)) for m in masks(parts, distance)))).alias("mask", "key")
    )
    shared = stored(filed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1"), "files")
    slices = F.ceil(F.col("n") / (group // 2)).cast("int")
    own = F.pmod(F.xxhash64("print"), F.col("slices")).cast("int")
    members = filed.join(shared, ["mask", "key"]).withColumn("slices", F.when(F.col("n") > group, slices).otherwise(1))
    dealt = members.withColumn("own", own).select(
        "mask", "key", "id", "print", "own", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other")
    ).select("mask", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "id", "print")
    dealt = dealt.repartition("mask", "key", "a", "b").sortWithinPartitions("mask", "key", "a", "b")
    return dealt.mapInPandas(star_maker(distance), "a long, b long").distinct()


# --- components -----------------------------------------------------------------------
def star_step(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or smaller) neighbours to the smallest node around it; ``edges``: stored rows a < b."""
    turned = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    around = turned.union(edges.select("a", "b")) if large else turned
    least = stored(around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    met = around.join(least, "u")
    if large:
        met = met.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        met = met.select(F.explode(F.array(F.struct("m", F.col("u").alias("w")), F.struct("m", F.col("v").alias("w")))).alias("x"))
        met = met.select(F.col("x.m").alias("a"), F.col("x.w").alias("b"))
    return stored(met.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest id connected to each id that has a link."""
    now, was = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"), None
    while was != (seen := state(now)) and seen[0]:
        was = seen
        now = star_step(star_step(now, large=True), large=False)
    return now.select(F.col("b").alias("id"), F.col("a").alias("component"))


def near_duplicates(prints: DataFrame, distance: int = DISTANCE, parts: tuple[int, ...] = PARTS, group: int = GROUP) -> DataFrame:
    """``doc_id, print, component_id``: the smallest id reachable over links. ``prints``: a stored table of fingerprints."""
    classes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("id")), "classes")
    found = components(links(classes, distance, parts, group))
    named = classes.join(found, "id", "left").select("print", F.coalesce("component", "id").alias("component_id"))
    return prints.join(stored(named, "named"), "print").select("doc_id", "print", "component_id")
