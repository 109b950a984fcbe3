"""Cumulative-snapshot collapse: keep the conversations that no longer one continues, then render them.

Chat logs often hold one conversation many times, each time with a few more turns. A
turn's hash covers its position, role and text; the XOR of the hashes of the turns so
far is the hash of that prefix (two independent halves, 128 bits). A conversation whose
whole hash is that of a shorter part of another one is a snapshot of it and goes; of
equal conversations the one with the smallest id stays.

Positions and running hashes are found in pieces of ``PIECE`` turn numbers, and the
totals of the pieces are summed first, so that one endless conversation is spread over
many tasks. Texts order turns of equal number and role only: where a conversation has such turns,
their rank by text is found first, and no other text is sorted. Copies are merged by a combining aggregate before the anti-join, so a hash
shared by a third of all conversations meets the join once. Texts move only for
conversations that stay.

Defined cases: turns are ordered by number, null first, then role and text; a row that
repeats in a conversation counts once; null role and null text differ from empty ones
and are rendered as empty; rows without ``conv_id`` form no conversation and are left
out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docweft.session import stored

PIECE = 256
START, END = "<|im_start|>", "<|im_end|>"


def turn_hash(place: Column, role: Column, text: Column, half: int) -> Column:
    return F.xxhash64(F.lit(half), place, role.isNull(), role, text.isNull(), text)


def distinct_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per turn: ``conv, turn, role, text``, rows that repeat once."""
    named = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    return named.distinct()


def text_digests() -> list[Column]:
    return [F.xxhash64(F.lit(half), F.col("text").isNull(), "text").alias(f"t{half}") for half in (1, 2)]


def ranked_ties(turns: DataFrame) -> DataFrame:
    """``conv, turn, role, t1, t2, tie``: rank by text among turns of one conversation, number and role, where there are several.

    Which they are is found by a count without texts and stored, so that Spark knows the size and, where it is
    small, looks for their texts without an exchange.
    """
    keys = ["conv", "turn", "role"]
    tied = stored(turns.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*(F.col(k).alias(f"tied_{k}") for k in keys)), "tied")
    several = turns.join(tied, [F.col(k).eqNullSafe(F.col(f"tied_{k}")) for k in keys], "left_semi")
    order = W.partitionBy(*keys).orderBy(F.col("text").asc_nulls_first())
    return several.select(*keys, *text_digests(), F.row_number().over(order).alias("tie"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``conv, n, h1, h2``: a row for each turn with the hash of the conversation up to it."""
    piece = F.coalesce(F.floor(F.col("turn") / PIECE).cast("long"), F.lit(-(2**62)))
    # the text itself goes no further: a digest of it is hashed, and ties are ranked apart
    slim = turns.select("conv", piece.alias("piece"), "turn", "role", *text_digests())
    known = ["conv", "turn", "role", "t1", "t2"]
    ranks = ranked_ties(turns).select(*(F.col(k).alias(f"tied_{k}") for k in known), "tie")
    slim = slim.join(ranks, [F.col(k).eqNullSafe(F.col(f"tied_{k}")) for k in known], "left").select(
        "piece", *known, F.coalesce("tie", F.lit(1)).alias("tie")
    )
    sizes = slim.groupBy("conv", "piece").agg(F.count("*").alias("rows"))
    before = W.partitionBy("conv").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("conv", "piece", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("ahead"))
    inside = W.partitionBy("conv", "piece").orderBy("turn", "role", "tie")
    placed = (
        slim.withColumn("k", F.row_number().over(inside))
        .join(sizes, ["conv", "piece"])
        .withColumn("n", F.col("ahead") + F.col("k"))
        .select("conv", "piece", "n", *(
            F.xxhash64(F.lit(half), F.col("n"), F.col("role").isNull(), F.col("role"), F.col(f"t{half}")).alias(f"h{half}")
            for half in (1, 2)
        ))
    )
    totals = placed.groupBy("conv", "piece").agg(F.bit_xor("h1").alias("p1"), F.bit_xor("h2").alias("p2"))
    totals = totals.select(
        "conv", "piece", *(F.coalesce(F.bit_xor(f"p{h}").over(before), F.lit(0)).alias(f"p{h}") for h in (1, 2))
    )
    running = W.partitionBy("conv", "piece").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    return placed.select(
        "conv", "piece", "n", *(F.bit_xor(f"h{h}").over(running).alias(f"h{h}") for h in (1, 2))
    ).join(totals, ["conv", "piece"]).select(
        "conv", "n", *(F.col(f"h{h}").bitwiseXOR(F.col(f"p{h}")).alias(f"h{h}") for h in (1, 2))
    )


def maximal(prefixes: DataFrame) -> DataFrame:
    """``conv, n_turns, copies``: the conversations that no other continues, one of each set of equal ones.

    ``prefixes`` is read twice: pass a stored table.
    """
    ends = prefixes.groupBy("conv").agg(F.max_by(F.struct("n", "h1", "h2"), "n").alias("end"))
    ends = ends.groupBy("end.n", "end.h1", "end.h2").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    # a prefix is proper if some conversation goes on after it
    last = prefixes.groupBy("conv").agg(F.max("n").alias("length"))
    proper = prefixes.join(last, "conv").filter("n < length").select("n", "h1", "h2").distinct()
    return ends.join(proper, ["n", "h1", "h2"], "left_anti").select(
        "conv", F.col("n").alias("n_turns"), "copies"
    )


def render(turns: DataFrame, chosen: DataFrame) -> DataFrame:
    """``conv, n_turns, copies, text``: the chosen conversations as marked-up text, one row each."""
    empty = F.lit("")
    shown = F.concat(
        F.lit(START), F.coalesce(F.col("role"), empty), F.lit("\n"), F.coalesce(F.col("text"), empty), F.lit(f"{END}\n")
    )
    kept = turns.join(chosen.select("conv"), "conv", "left_semi").select(
        "conv", F.struct("turn", "role", "text", shown.alias("shown")).alias("x")
    )
    texts = kept.groupBy("conv").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["shown"]), "").alias("text")
    )
    return chosen.join(texts, "conv")
