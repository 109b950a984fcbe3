"""Near copies of the pipeline: shingle sets of at least ``SIMILAR`` Jaccard similarity, linked into components.

Texts of one set of shingles are one class. Classes that agree in one of ``BANDS`` bands of
``WIDTH`` minimum hashes are candidates, and a candidate pair is a link only if the exact
similarity of its sets suffices. Two sets of similarity 0.8 meet in no band with a chance of
``(1 - 0.8 ** WIDTH) ** BANDS``, which is 5 in a million.

A band shared by many classes never makes all their pairs: first each member is compared
with the smallest and the largest, which leaves few components; then members of one band that
still holds several components come together with their sets, in slices bounded by number and
bytes, and a search within two slices gives one row for each link that joins two components:
fewer rows than members, never the pairs. Sets are made for candidates only.

Defined cases: as for the fingerprints of ``simhash``; a text of up to five words is one
shingle, and blank texts are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from docweft.llm.process import release
from docweft.llm.simhash import GROUP, components
from docweft.session import stored

SHINGLE, SIMILAR, SEED = 5, 0.8, 42
BANDS, WIDTH = 40, 6
#: Bytes of the sets that are searched in one go.
BYTES = 16 << 20
DRAWN = np.random.default_rng(SEED)
MIXED, TIMES = (DRAWN.integers(0, 1 << 32, (BANDS * WIDTH, 1), "u4") for _ in range(2))
TIMES |= np.uint32(1)
JOINED = DRAWN.integers(0, 1 << 63, (BANDS, WIDTH), "u8") | np.uint64(1)
APART = DRAWN.integers(0, 1 << 63, BANDS, "u8")


# --- sets -----------------------------------------------------------------------------
def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not found:
        return np.empty(0, "u8")
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[min(shingle, len(found)) - 1 :].tolist()
    hash_of = xxhash.xxh64_intdigest
    return np.unique(np.array([hash_of(line[a:b], SEED) for a, b in zip(starts, stops)], "u8"))


def class_of(held: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(held.tobytes(), SEED)).view("i8"))


def bands(held: np.ndarray) -> np.ndarray:
    """One key for each band."""
    if not len(held):
        return np.empty(0, "i8")
    short = (held >> np.uint64(32)).astype("u4")
    least = np.concatenate([
        ((short ^ MIXED[k : k + BANDS]) * TIMES[k : k + BANDS]).min(1) for k in range(0, len(MIXED), BANDS)
    ])
    return ((least.reshape(BANDS, WIDTH).astype("u8") * JOINED).sum(1, dtype="u8") ^ APART).view("i8")


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def sketches(rows: DataFrame) -> DataFrame:
    """``doc_id, text_hash, class, n, keys`` of each row ``doc_id, text_hash, text``: its set, the size of that and the bands."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for frame in frames:
            held = [shingles(x if isinstance(x, str) else None) for x in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text_hash": frame["text_hash"], "class": [class_of(x) for x in held], "n": [len(x) for x in held], "keys": [bands(x) for x in held]})

    return rows.mapInPandas(run, "doc_id long, text_hash long, class long, n int, keys array<long>")


def sets(rows: DataFrame) -> DataFrame:
    """``class, held`` of each row ``text``: the set as bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for frame in frames:
            held = [shingles(x if isinstance(x, str) else None) for x in frame["text"]]
            yield pd.DataFrame({"class": [class_of(x) for x in held], "held": [x.tobytes() for x in held]})

    return rows.select("text").mapInPandas(run, "class long, held binary")


# --- links ----------------------------------------------------------------------------
def verified(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets are similar enough."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = [similar(np.frombuffer(x, "u8"), np.frombuffer(y, "u8"), least) for x, y in zip(frame["x"], frame["y"])]
            yield frame.loc[np.array(good, bool), ["a", "b"]]

    first = held.select(F.col("class").alias("a"), F.col("held").alias("x"))
    second = held.select(F.col("class").alias("b"), F.col("held").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def close_in_size(a: str, b: str, least: float):
    return F.least(a, b) >= least * F.greatest(a, b) - 1e-9


def overlaps(held: list[np.ndarray]):
    """A function that gives the number of shingles that the set of one number has in common with each set."""
    size = np.array([len(x) for x in held])
    owner = np.repeat(np.arange(len(held)), size)
    token = np.unique(np.concatenate([np.empty(0, "u8"), *held]), return_inverse=True)[1]
    first = np.concatenate([[0], np.cumsum(size)])
    owners = owner[np.argsort(token, kind="stable")]
    ends = np.cumsum(np.bincount(token))
    starts = ends - np.bincount(token)

    def of(k: int) -> np.ndarray:
        mine = token[first[k] : first[k + 1]]
        length = ends[mine] - starts[mine]
        at = np.repeat(starts[mine] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        return np.bincount(owners[at], minlength=len(held))

    return of


def search_maker(least: float):
    """Links that join different components within a slice of a band, or between two slices."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        # pairs within the most frequent component need no look, so its members come last and ask for nothing
        often = frame["component"].map(frame["component"].value_counts()).to_numpy()
        frame = frame.iloc[np.lexsort((frame["class"], frame["component"], often))]
        ids, own, label = (frame[c].to_numpy().copy() for c in ("class", "own", "component"))
        held = [np.frombuffer(x, "u8") for x in frame["held"]]
        size, across = np.array([len(x) for x in held]), frame["s"].iloc[0] != frame["t"].iloc[0]
        shared, out = overlaps(held), []
        asking = np.flatnonzero(label != label[-1])
        for k in range(int(asking[-1]) + 1 if len(asking) else 0):
            rest = slice(k + 1, None)
            wanted = (label[rest] != label[k]) & (np.minimum(size[rest], size[k]) >= least * np.maximum(size[rest], size[k]) - 1e-9)
            if across:
                wanted &= own[rest] != own[k]
            if not wanted.any():
                continue
            both = shared(k)[rest]
            for j in k + 1 + np.flatnonzero(wanted & (both >= least * (size[k] + size[rest] - both) - 1e-9)):
                if label[j] != label[k]:
                    out.append((min(ids[k], ids[j]), max(ids[k], ids[j])))
                    label[label == label[j]] = label[k]
        return pd.DataFrame(out, columns=["a", "b"], dtype="i8")

    return run


def near_copies(rows: DataFrame, least: float = SIMILAR, group: int = GROUP, most: int = BYTES) -> DataFrame:
    """``doc_id, text_hash, class, component`` of each row ``doc_id, text`` that has an id."""
    rows = rows.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    seen = stored(sketches(rows), "sketches")
    classes = stored(seen.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")
    filed = classes.select("class", "n", F.explode("keys").alias("key"))
    one = F.struct("class", "n")
    shared = filed.groupBy("key").agg(F.count("*").alias("size"), F.min(one).alias("low"), F.max(one).alias("high")).filter("size > 1")
    members = stored(filed.join(stored(shared, "shared"), "key"), "members")
    # each member with the smallest and the largest of its band
    stars = members.select("class", "n", F.explode(F.array("low", "high")).alias("hub")).filter(
        (F.col("class") != F.col("hub.class")) & close_in_size("n", "hub.n", least)
    ).select(F.least("class", "hub.class").alias("a"), F.greatest("class", "hub.class").alias("b")).distinct()
    met = members.select("class").distinct().join(classes.select("class", "doc_id"), "class").select("doc_id").distinct()
    texts = rows.join(met, "doc_id", "left_semi")
    held = stored(sets(texts).dropDuplicates(["class"]), "sets")
    links = stored(verified(stars, held, least), "links")
    found = stored(components(links), "found")
    # what is still apart in a band of more than two
    apart = members.filter("size > 2").join(found.withColumnRenamed("id", "class"), "class", "left").withColumn(
        "component", F.coalesce("component", "class")
    )
    apart = stored(apart, "apart")
    mixed = apart.groupBy("key").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.sum(8 * F.col("n").cast("long")).alias("bytes")
    ).filter("x <> y")
    slices = F.greatest(
        F.when(F.col("size") > group, F.ceil(F.col("size") / (group // 2))).otherwise(1),
        F.when(F.col("bytes") > most, F.ceil(F.col("bytes") / (most // 2))).otherwise(1),
    ).cast("int")
    rest = apart.join(mixed.select("key", "bytes"), "key")
    rest = rest.filter((F.col("class") != F.col("low.class")) & (F.col("class") != F.col("high.class")))
    rest = rest.withColumn("slices", slices).withColumn("own", F.pmod(F.xxhash64("class"), F.col("slices")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        "key", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"), "own", "class", "component"
    )
    met = rest.join(held, "class").groupBy("key", "s", "t")
    more = stored(met.applyInPandas(search_maker(least), "a long, b long").distinct(), "more")
    named = components(links.union(more)) if more.head(1) else found
    return seen.select("doc_id", "text_hash", "class").join(named.withColumnRenamed("id", "class"), "class", "left").select(
        "doc_id", "text_hash", "class", F.coalesce("component", "class").alias("component")
    )
