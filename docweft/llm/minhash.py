"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning, exact confirmation, components.

A document's set are its distinct shingles. Documents of one set are one class. Classes that
agree in one of ``BANDS`` bands of ``WIDTH`` minimum hashes share a bucket and are candidates;
two sets of similarity 0.85 share none with a chance of ``(1 - 0.85 ** WIDTH) ** BANDS``,
which is 2 in a million.

A candidate pair is first compared by signature, one batch of hashes after the other. With a
uniform prior the similarity has a beta posterior after ``n`` hashes with ``m`` matches, and it
reaches the threshold with probability ``P(Bin(n + 1, threshold) <= m)``; a pair is dropped as
soon as that is below ``MISS``. What is left is confirmed on the full sets, in whole numbers.

A bucket never makes all its pairs. First each member meets three members of its bucket (the
first, the smallest, the largest), with each of these sent once for up to ``GROUP`` members.
That leaves few components. Only where a bucket still holds several of them, its members are
gathered, once for all buckets that hang together, in slices bounded by number and bytes;
within two slices a search links components and gives one row for each link that joins two
of them. No candidate is dropped.

Defined cases: letters A-Z are lowered, words stand between ASCII white space; a text of one
to four words is one shingle; a null or blank text has an empty set, size 0, and is linked with
nothing; a row without id is left out; repeated rows are of one class, and an id with several
texts has a row for each; very long texts are taken in pieces of bounded size; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from docweft.llm.simhash import components
from docweft.session import stored

SHINGLE, PERCENT, SEED, MISS = 5, 85, 42, 1e-5
BANDS, WIDTH = 28, 6
#: Members that are compared in one go, bytes of their sets, shingles hashed in one go.
GROUP, BYTES, PIECE = 1024, 16 << 20, 1 << 15
DRAWN = np.random.default_rng(SEED)
MIXED, TIMES = (DRAWN.integers(0, 1 << 32, (BANDS * WIDTH, 1), "u4") for _ in range(2))
TIMES |= np.uint32(1)
NOTHING = np.empty(0, "u8")


# --- sets and signatures --------------------------------------------------------------
def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not found:
        return NOTHING
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[min(shingle, len(found)) - 1 :].tolist()
    hash_of = xxhash.xxh64_intdigest
    return np.unique(np.array([hash_of(line[a:b], SEED) for a, b in zip(starts, stops)], "u8"))


def signature(held: np.ndarray) -> np.ndarray:
    """Minimum hashes, band after band."""
    short = (held >> np.uint64(32)).astype("u4")
    least = np.full(len(MIXED), np.iinfo("u4").max, "u4")
    for at in range(0, len(short), PIECE):
        piece = short[at : at + PIECE]
        for k in range(0, len(MIXED), BANDS):
            rows = slice(k, k + BANDS)
            np.minimum(least[rows], ((piece ^ MIXED[rows]) * TIMES[rows]).min(1), out=least[rows])
    return least


def class_of(held: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(held.tobytes(), SEED)


def sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, n, class, signature`` of each row ``doc_id, text``; an empty set has no class."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, text in zip(frame["doc_id"], frame["text"]):
                held = shingles(text if isinstance(text, str) else None, shingle)
                out.append((key, len(held), *((class_of(held), signature(held).tobytes()) if len(held) else (None, None))))
            yield pd.DataFrame(out, columns=["doc_id", "n", "class", "signature"])

    return rows.mapInPandas(run, "doc_id long, n long, class binary, signature binary")


def sets(rows: DataFrame, shingle: int) -> DataFrame:
    """``class, held`` of each row ``text``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held = [shingles(x if isinstance(x, str) else None, shingle) for x in frame["text"]]
            yield pd.DataFrame({"class": [class_of(x) for x in held], "held": [x.tobytes() for x in held]})

    return rows.select("text").mapInPandas(run, "class binary, held binary")


# --- pairs ----------------------------------------------------------------------------
def least_matches(percent: int, miss: float) -> list[int]:
    """After each batch of ``BANDS`` hashes: the fewest matches with which a pair is kept."""
    out = []
    for n in range(BANDS, BANDS * WIDTH + 1, BANDS):
        total, chance = 0.0, percent / 100
        for m in range(n + 2):
            total += comb(n + 1, m) * chance**m * (1 - chance) ** (n + 1 - m)
            if total >= miss:
                out.append(m)
                break
    return out


class Rule:
    """When two sets are linked."""

    def __init__(self, percent: int, miss: float):
        self.percent, self.needed = percent, least_matches(percent, miss)
        # a batch takes one hash of each band
        self.batches = [np.arange(k, BANDS * WIDTH, WIDTH) for k in range(WIDTH)]

    def plausible(self, one: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Which of the other signatures survive all batches."""
        left, matches = np.arange(len(others)), np.zeros(len(others), "i4")
        for batch, needed in zip(self.batches, self.needed):
            matches = matches + np.count_nonzero(others[left][:, batch] == one[batch], axis=1)
            stay = matches >= needed
            left, matches = left[stay], matches[stay]
            if not len(left):
                break
        return left

    def exact(self, a: np.ndarray, b: np.ndarray) -> bool:
        if not self.close(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)

    def close(self, n, m):
        return 100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)


def signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u4").reshape(-1, BANDS * WIDTH)


def hub_maker(rule: Rule):
    """Links of members with their hub; the rows of a hub come together, the hub first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, of = None, None
        for frame in frames:
            out = []
            number = (frame["hub"].ne(frame["hub"].shift()) | frame["salt"].ne(frame["salt"].shift())).cumsum()
            for _, rows in frame.groupby(number, sort=False):
                if rows["role"].iloc[0] == 0:
                    of, hub = rows["id"].iloc[0], (signatures(rows["signature"][:1])[0], np.frombuffer(rows["held"].iloc[0], "u8"))
                    rows = rows[1:]
                if not len(rows):
                    continue
                for k in rule.plausible(hub[0], signatures(rows["signature"])):
                    if rule.exact(hub[1], np.frombuffer(rows["held"].iloc[k], "u8")):
                        out.append((min(of, rows["id"].iloc[k]), max(of, rows["id"].iloc[k])))
            yield pd.DataFrame(out, columns=["a", "b"])

    return run


def search_maker(rule: Rule):
    """Links that join different components within a slice, or between two slices."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        ids, own, label = frame["id"].to_numpy(), frame["own"].to_numpy(), frame["component"].to_numpy().copy()
        held = [np.frombuffer(x, "u8") for x in frame["held"]]
        size, seen = np.array([len(x) for x in held]), signatures(frame["signature"])
        bands = seen.reshape(len(ids), BANDS, WIDTH)
        across = frame["x"].iloc[0] != frame["y"].iloc[0]
        out = []
        for k in range(len(ids) - 1):
            rest = slice(k + 1, None)
            wanted = (label[rest] != label[k]) & rule.close(size[rest], size[k])
            if across:
                wanted &= own[rest] != own[k]
            others = k + 1 + np.flatnonzero(wanted)
            if len(others):
                others = others[(bands[others] == bands[k]).all(2).any(1)]
            if len(others):
                others = others[rule.plausible(seen[k], seen[others])]
            for j in others:
                if label[j] != label[k] and rule.exact(held[k], held[j]):
                    out.append((ids[k], ids[j]))
                    label[label == label[j]] = label[k]
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def around_hubs(members: DataFrame, facts: DataFrame, rule: Rule, group: int) -> DataFrame:
    """Links of each member with the hubs of its buckets. ``facts``: ``id, signature, held``."""
    close = F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * rule.percent
    pairs = stored(
        members.select("id", "n", F.explode(F.array("first", "small", "large")).alias("hub")).filter((F.col("id") != F.col("hub.id")) & close)
        # a pair whose two members are hubs of each other is taken once
        .select(F.col("hub.id").alias("hub"), "id").distinct(),
        "pairs",
    )
    salts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / group).cast("int").alias("salts"))
    dealt = pairs.join(salts, "hub").select("hub", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), F.lit(1).alias("role"), "id")
    own = salts.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("hub").alias("id"))
    files = dealt.unionByName(own).join(facts, "id").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")
    return stored(files.mapInPandas(hub_maker(rule), "a long, b long"), "links")


def between(members: DataFrame, facts: DataFrame, found: DataFrame, rule: Rule, group: int, most: int) -> DataFrame | None:
    """Links between components that still share a bucket; None if there are no such buckets."""
    named = members.select("key", "id", "n").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = stored(named, "named")
    mixed = stored(
        named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key", "low"), "mixed"
    )
    if not mixed.head(1):
        return None
    apart = named.join(mixed, "key")
    joined = components(apart.select(F.col("low").alias("a"), F.col("component").alias("b")).distinct())
    joined = joined.select(F.col("id").alias("component"), F.col("component").alias("cluster"))
    left = apart.select("id", "n", "component").distinct().join(joined, "component", "left").withColumn("cluster", F.coalesce("cluster", "component"))
    left = stored(left, "left")
    slices = F.greatest(F.ceil(F.count("*") / group), F.ceil(F.sum("n") * 8 / most)).cast("int")
    slices = left.groupBy("cluster").agg(slices.alias("slices"))
    dealt = left.join(slices, "cluster").withColumn("own", F.pmod(F.xxhash64("id"), "slices").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        "cluster", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "component"
    )
    links = dealt.join(facts, "id").groupBy("cluster", "x", "y").applyInPandas(search_maker(rule), "a long, b long")
    return stored(links.distinct(), "more")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, miss: float = MISS,
    group: int = GROUP, most: int = BYTES,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row that has an id: its set's size and the smallest id reachable."""
    rule = Rule(percent, miss)
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    seen = stored(sketches(rows, shingle), "sketches")
    classes = seen.filter("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature")
    )
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("signature", k * 4 * WIDTH + 1, F.lit(4 * WIDTH))))
    filed = classes.select("id", "n", F.explode(band).alias("key"))
    shared = filed.groupBy("key").agg(
        F.count("*").alias("size"), F.min(F.struct("id", "n")).alias("first"), F.min(F.struct("n", "id")).alias("small"),
        F.max(F.struct("n", "id")).alias("large"),
    ).filter("size > 1")
    hubs = [F.struct(F.col(c)["id"].alias("id"), F.col(c)["n"].alias("n")).alias(c) for c in ("first", "small", "large")]
    members = stored(filed.join(stored(shared.select("key", *hubs), "shared"), "key"), "members")
    met = classes.join(members.select("id").distinct(), "id", "left_semi")
    wanted = met.select("class", "id", "signature")
    held = sets(rows.join(met.select("doc_id").distinct(), "doc_id", "left_semi"), shingle)
    facts = stored(held.join(wanted, "class").select("id", "signature", "held").dropDuplicates(["id"]), "facts")
    links = around_hubs(members, facts, rule, group)
    found = stored(components(links), "found")
    more = between(members, facts, found, rule, group, most)
    if more is not None:
        found = components(links.unionByName(more))
    linked = classes.select("class", "id", "doc_id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = stored(linked.join(least, "component").select("class", "component_id"), "named")
    return seen.select("doc_id", "n", "class").join(named, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
