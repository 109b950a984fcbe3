"""Divergence audit of sources: how far apart their vocabularies are, and which terms set a source off from its language.

Each language keeps the terms that enough of its documents hold. A group (language, source)
gives each kept term a smoothed share ``p`` in billionths, all in whole numbers. Two shares
differ by ``floor((p - q)^2 / (p + q))``; two sources by the sum of that over all kept terms.

A share depends on the term's count in the group alone. So the kept terms of a language are
put in an order that brings equal counts together (sorted by their lists of source and
count), and the counts of a group become runs: start and count. For two groups the
boundaries of their runs are intersected, and each stretch between two boundaries counts
once, times its length, however many terms lie in it. The order is cut into blocks of at
most ``BLOCK`` terms at the borders of Spark's range partitions; a block and two slices of
at most ``SLICE`` groups each are one unit of work, and the sums of the blocks are added.

Terms are counted per task first, so a frequent term moves as one row of each task and group.
A list of sources is as long as the language has sources; all pairs of them are the result.

Defined cases: null text, language and source are empty texts; a group whose documents have
no term has counts of zero; a language without kept terms has values of zero and no term
rows; very long texts are counted as a whole; repeated rows count as often as they occur;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docweft.llm.columns import UPPER
from docweft.session import stored

#: Documents that hold a kept term at least, terms of a group that are reported, units of a share.
HOLDERS, TERMS, UNITS = 10, 10, 1_000_000_000
#: Terms of a block, groups of a slice, terms that a task counts before it passes them on.
BLOCK, SLICE, HELD = 1 << 15, 64, 300_000
#: Bytes of a term stay, capitals are lowered, all else is a space.
LETTERS = bytes(b + 32 if chr(b) in UPPER else b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


# --- counts ---------------------------------------------------------------------------
def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()


def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``lang, source, term, n, docs`` of the documents of a task, in several parts."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def table() -> pd.DataFrame:
        out = [
            (lang, source, term.decode("utf-8", "surrogatepass"), n, docs[term])
            for (lang, source), (counts, docs) in held.items() for term, n in counts.items()
        ]
        held.clear()
        return pd.DataFrame(out, columns=["lang", "source", "term", "n", "docs"])

    size = 0
    for frame in frames:
        for lang, source, text in zip(frame["lang"], frame["source"], frame["text"]):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found, before = terms_of(text), len(docs)
            counts.update(found)
            docs.update(set(found))
            size += len(docs) - before
            if size >= HELD:
                yield table()
                size = 0
    if held:
        yield table()


def vocabulary(rows: DataFrame, holders: int = HOLDERS) -> DataFrame:
    """``lang, term, total, cells`` of each kept term; ``cells`` are its sources and counts. ``rows``: ``lang, source, text`` without nulls."""
    counts = rows.mapInPandas(counted, "lang string, source string, term string, n long, docs long")
    # one shuffle: what is dealt by language and term stays together for both sums
    per = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = per.groupBy("lang", "term").agg(
        F.sum("docs").alias("holders"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("cells")
    )
    return stored(kept.filter(F.col("holders") >= holders).select("lang", "term", "total", "cells"), "vocabulary")


def groups_of(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source``, the group's ``size``, and of its language the ``kept`` terms, ``lang_size`` and number of ``sources``."""
    groups = rows.select("lang", "source").distinct()
    sizes = kept.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size"))
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    return stored(
        groups.join(sources, "lang").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
        .fillna(0, ["size", "kept", "lang_size"]),
        "groups",
    )


def share(count: Column, size: str, kept: str = "kept") -> Column:
    """``1 + floor(UNITS (count + 2) / (size + 2 kept))``, exact for any count."""
    wide = "decimal(20,0)"
    over = F.lit(UNITS).cast("decimal(10,0)") * (count + 2).cast(wide)
    return F.call_function("div", over, (F.col(size) + 2 * F.col(kept)).cast(wide)) + 1


# --- pairs ----------------------------------------------------------------------------
def run_starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(counts)) + 1])


def encoder(block: int):
    """Runs of each group that has a term in the block: ``lang, block, terms, source, starts, counts``. Rows come in order."""

    def encoded(lang: str, number: int, cells: list) -> pd.DataFrame:
        where: dict[str, tuple[list[int], list[int]]] = {}
        for at, (sources, counts) in enumerate(cells):
            for source, n in zip(sources, counts):
                places = where.setdefault(source, ([], []))
                places[0].append(at)
                places[1].append(n)
        out = []
        for source, (places, counts) in where.items():
            dense = np.zeros(len(cells), "i8")
            dense[places] = counts
            starts = run_starts(dense)
            out.append((lang, number, len(cells), source, starts.astype("i4"), dense[starts]))
        return pd.DataFrame(out, columns=["lang", "block", "terms", "source", "starts", "counts"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        held, of = [], None
        for frame in frames:
            for lang, sources, counts in zip(frame["lang"], frame["sources"], frame["counts"]):
                if held and (lang != of or len(held) >= block):
                    yield encoded(of, number, held)
                    held, number = [], number + 1
                of = lang
                held.append((sources, counts))
        if held:
            yield encoded(of, number, held)

    return run


def apart(starts_a: np.ndarray, a: np.ndarray, starts_b: np.ndarray, b: np.ndarray, terms: int) -> int:
    """Sum of the differences of two groups over a block, from their runs."""
    bounds = np.union1d(starts_a, starts_b)
    p = a[np.searchsorted(starts_a, bounds, "right") - 1]
    q = b[np.searchsorted(starts_b, bounds, "right") - 1]
    return int((((p - q) ** 2 // (p + q)) * np.diff(np.append(bounds, terms))).sum())


def compared(frame: pd.DataFrame) -> pd.DataFrame:
    """All pairs of a block's groups within a slice, or between two slices."""
    rows = sorted(zip(frame["own"], frame["source"], frame["starts"], frame["shares"]), key=lambda x: x[:2])
    lang, terms, within = frame["lang"].iloc[0], int(frame["terms"].iloc[0]), frame["x"].iloc[0] == frame["y"].iloc[0]
    out = []
    for k, (own, source, starts, shares) in enumerate(rows):
        for other, item, more, against in rows[k + 1 :]:
            if within or own != other:
                out.append((lang, source, item, apart(starts, shares, more, against, terms)))
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def pair_sums(kept: DataFrame, groups: DataFrame, block: int = BLOCK, slice_size: int = SLICE) -> DataFrame:
    """``lang, source, item, value``: each pair of sources of a language with kept terms, in one direction."""
    listed = kept.repartitionByRange("lang", "cells", "term").sortWithinPartitions("lang", "cells", "term").select(
        "lang", F.transform("cells", lambda c: c["source"]).alias("sources"), F.transform("cells", lambda c: c["n"]).alias("counts")
    )
    runs = stored(
        listed.mapInPandas(encoder(block), "lang string, block long, terms int, source string, starts array<int>, counts array<long>"), "runs"
    )
    blocks = runs.select("lang", "block", "terms").distinct()
    zero = F.array(F.lit(0))
    # a group without a term of the block has one run of zeros
    full = blocks.join(groups, "lang").join(runs.drop("terms"), ["lang", "block", "source"], "left").select(
        "lang", "block", "terms", "source", "sources", F.coalesce("starts", zero).alias("starts"),
        F.transform(F.coalesce("counts", zero.cast("array<long>")), lambda c: share(c, "size")).alias("shares"),
    )
    slices = F.ceil(F.col("sources") / slice_size).cast("int")
    full = full.withColumn("own", F.pmod(F.xxhash64("source"), slices).cast("int"))
    dealt = full.withColumn("other", F.explode(F.sequence(F.lit(0), slices - 1))).select(
        "lang", "block", "terms", "source", "starts", "shares", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")
    )
    sums = dealt.groupBy("lang", "block", "x", "y").applyInPandas(compared, "lang string, source string, item string, value long")
    return sums.groupBy("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item")).agg(F.sum("value").alias("value"))


# --- report ---------------------------------------------------------------------------
def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", holders: int = HOLDERS, terms: int = TERMS,
    block: int = BLOCK, slice_size: int = SLICE,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: the other sources of the language by distance (part ``pair``), and
    the terms that are more frequent in the source than in its language (part ``term``, the first ``terms`` of them)."""
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    kept = vocabulary(rows, holders)
    groups = groups_of(rows, kept)
    one_way = pair_sums(kept, groups, block, slice_size)
    both = one_way.unionByName(one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    names = groups.select("lang", "source")
    pairs = names.join(names.withColumnRenamed("source", "item"), "lang").filter("source <> item")
    values = pairs.join(both, ["lang", "source", "item"], "left").fillna(0, ["value"])
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    order = ("lang", "source", "part", "item", "value", "rank")
    distances = values.select("*", F.lit("pair").alias("part"), rank.alias("rank")).select(*order)
    p, q = F.col("p"), F.col("q")
    cells = kept.select("lang", F.col("term").alias("item"), "total", F.inline("cells")).join(groups, ["lang", "source"])
    more = cells.select("lang", "source", "item", share(F.col("n"), "size").alias("p"), share(F.col("total"), "lang_size").alias("q"))
    value = F.call_function("div", (p - q) * (p - q), p + q)
    told = more.filter("p > q").withColumn("value", value).withColumn("rank", rank).filter(F.col("rank") <= terms)
    return distances.unionByName(told.select("*", F.lit("term").alias("part")).select(*order))
